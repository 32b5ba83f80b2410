"""Ordered blocks of a text, and chunks that follow its structure."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET, MOST, OVERLAP = 350, 500, 60
#: Code points of text, and rows, that a task holds as blocks or chunks before it hands them on; one longer block more.
CHARS, ROWS = 1 << 20, 4096
_HEADING = re.compile(r"(#{1,6})[ \t]+(.*)")
_WORD = re.compile(r"[^ \t\n\r]+")
_SENTENCE_END = re.compile(r"[.!?][ \t]+")


@dataclass(frozen=True)
class Block:
    """A line that isn't blank: code points [start, end) of the text, without white space at its ends."""

    start: int
    end: int
    kind: str
    path: str


def blocks(text: str) -> Iterator[Block]:
    """Headings (`#` to `######`) and paragraphs, each with the path of the headings above it; a heading's ends with itself."""
    open_: list[tuple[int, str]] = []
    at = 0
    for line in text.split("\n"):
        plain = line.strip(" \t\r")
        start = at + line.index(plain) if plain else at
        at += len(line) + 1
        if not plain:
            continue
        heading = _HEADING.fullmatch(plain)
        if heading:
            depth = len(heading[1])
            open_ = [x for x in open_ if x[0] < depth] + [(depth, heading[2])]
        yield Block(start, start + len(plain), "heading" if heading else "paragraph", " > ".join(x for _, x in open_))


@dataclass(frozen=True)
class _Unit:
    start: int
    end: int
    n: int


def _units(text: str, start: int, end: int, target: int, most: int) -> Iterator[_Unit]:
    """A block, or its sentences where it's too long, or runs of words of a sentence that is still too long."""
    words = [m.span() for m in _WORD.finditer(text, start, end)]
    if len(words) <= most:
        yield _Unit(start, end, len(words))
        return
    stops = [m.end() for m in _SENTENCE_END.finditer(text, start, end)] + [end]
    at = 0
    for stop in stops:
        begin = at
        while at < len(words) and words[at][0] < stop:
            at += 1
        size = target if at - begin > most else max(at - begin, 1)
        for i in range(begin, at, size):
            last = min(i + size, at)
            yield _Unit(words[i][0], words[last - 1][1], last - i)


def chunks(text: str, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, words, heading path) of chunks: whole units up to ``target`` words, never over ``most``.

    A heading begins a chunk.  Any other chunk begins with the last units of the one before it, as many as have
    ``overlap`` words or fewer between them.  Every word is in a chunk.
    """
    held: list[_Unit] = []
    fresh = False
    path = ""

    def closed() -> tuple[int, int, int, str]:
        return held[0].start, held[-1].end, sum(u.n for u in held), path

    def tail(room: int) -> list[_Unit]:
        out: list[_Unit] = []
        for u in reversed(held):
            if sum(x.n for x in out) + u.n > min(overlap, room):
                break
            out.insert(0, u)
        return out if len(out) < len(held) else out[1:]

    for block in blocks(text):
        if block.kind == "heading":
            if held and fresh:
                yield closed()
            held, fresh = [], False
        path = block.path
        for unit in _units(text, block.start, block.end, target, most):
            n = sum(u.n for u in held)
            if held and (n >= target or n + unit.n > most):
                if fresh:
                    yield closed()
                held, fresh = tail(most - unit.n), False
            held.append(unit)
            fresh = True
    if held and fresh:
        yield closed()


def document_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, kind, heading_path, start, length, text) of each block; a null or blank text has none."""

    def rows(doc: int, text: str) -> Iterator[tuple]:
        return ((doc, i, b.kind, b.path, b.start, b.end - b.start, text[b.start : b.end]) for i, b in enumerate(blocks(text)))

    return _each_text(docs, rows, BLOCKS)


def structure_chunks(docs: DataFrame, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_no, heading_path, start, length, n_words, text) of each chunk, made within the scan's stage."""

    def rows(doc: int, text: str) -> Iterator[tuple]:
        return ((doc, i, path, a, b - a, n, text[a:b]) for i, (a, b, n, path) in enumerate(chunks(text, target, most, overlap)))

    return _each_text(docs, rows, CHUNKS)


def _each_text(docs: DataFrame, rows: Callable[[int, str], Iterator[tuple]], columns: dict[str, str]) -> DataFrame:
    """The rows of every text, one text at a time; they go on when their strings come to ``CHARS`` or they to ``ROWS``."""
    strings = [i for i, kind in enumerate(columns.values()) if kind == "string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                for row in rows(doc.as_py(), text.as_py() or ""):
                    held.append(row)
                    size += sum(len(row[i]) for i in strings)
                    if size >= CHARS or len(held) >= ROWS:
                        yield _batch(held, columns)
                        held, size = [], 0
        yield _batch(held, columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ddl(columns))


BLOCKS = {"doc_id": "long", "ord": "long", "kind": "string", "heading_path": "string", "start": "long", "length": "long", "text": "string"}
CHUNKS = {"doc_id": "long", "chunk_no": "long", "heading_path": "string", "start": "long", "length": "long", "n_words": "long", "text": "string"}


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def _batch(rows: list[tuple], columns: dict[str, str]) -> pa.RecordBatch:
    types = [pa.int64() if kind == "long" else pa.string() for kind in columns.values()]
    cells = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cells, types, strict=True)], names=list(columns))
