"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of each text.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lower-cased: runs of digits, letters and anything beyond
ASCII.  A *window* is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window.  The
windows are the patterns, each between blanks; a text is scanned with one blank between its words, and a match's place
among the blanks gives the words that it covers, hence bytes and characters of the original text.

The items are the stated query set.  They are read by the driver in slices of at most ``SLICE`` characters, counted
first; each slice is one automaton and one pass, and the benchmark tables here make one slice.  Nothing is shuffled, so
frequent passages cost their matches only.

A null text has no words and no hits.  An item with a null id or text, or without words, is ignored; items with one id
count once.  No items: no hits.  An empty table gives an empty one.  Rows are independent: equal rows get equal results.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import arrow_map, kept, saved, small_batches
from .textkit import buffers, words

WIDTH = 10
#: Characters of items in one automaton; it takes some 50 bytes of memory for each character of its windows.
SLICE = 1 << 21

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.ones(256, bool)
_BLANK[0x30:0x3A] = _BLANK[0x61:0x7B] = _BLANK[0x80:] = False
_FOLD[_BLANK[_FOLD]] = 32
_TABLE = _FOLD.tobytes()


def normal_words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def windows(items: list[tuple[int, str]], width: int) -> dict[str, tuple[int, list[int]]]:
    """Each window's pattern, with its number of words and the items that have it."""
    found: dict[str, tuple[int, list[int]]] = {}
    for item, text in items:
        own = normal_words(text)
        size = min(width, len(own))
        for i in range(len(own) - size + 1) if own else ():
            pattern = f" {b' '.join(own[i : i + size]).decode('latin-1')} "
            holders = found.setdefault(pattern, (size, []))[1]
            if item not in holders[-1:]:
                holders.append(item)
    return found


def _automaton(items: list[tuple[int, str]], width: int) -> ahocorasick.Automaton | None:
    """Built once in each Python worker."""

    def make() -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for pattern, (size, holders) in windows(items, width).items():
            made.add_word(pattern, (len(pattern), size, holders))
        made.make_automaton()
        return made

    made = kept(("windows", width, tuple(items)), make)
    return made if len(made) else None


def _hits(automaton: ahocorasick.Automaton | None, text: str) -> tuple[int, np.ndarray, set[int]]:
    """(number of words, mark of each word that a window covers, items found)."""
    own = normal_words(text)
    marks, items, blanks = None, set(), None
    if automaton is not None and own:
        line = f" {b' '.join(own).decode('latin-1')} "
        for end, (length, size, holders) in automaton.iter(line):
            if marks is None:
                marks = np.zeros(len(own) + 1, np.int32)
                blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
            first = int(np.searchsorted(blanks, end - length + 1))
            marks[first] += 1
            marks[first + size] -= 1
            items.update(holders)
    return len(own), None if marks is None else np.cumsum(marks[:-1]) > 0, items


def _places(text: str, marks: np.ndarray) -> list[dict[str, int]]:
    """Where in the text, in characters, the runs of marked words lie."""
    data, offsets = buffers(pa.array([text]))
    start, end, _ = words(data, offsets, _BLANK[_FOLD])
    edges = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
    characters = np.cumsum((data & 0xC0) != 0x80)
    return [{"start": int(characters[start[a]]) - 1, "stop": int(characters[end[b] - 1])} for a, b in zip(first, last, strict=True)]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _scan(items: list[tuple[int, str]], width: int, last: bool):
    """One pass; between passes the marks of words stay with the texts, after the last one they become spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(items, width)
        for batch in batches:
            n, hit, found, marked = [], [], [], []
            earlier = zip(batch.column("items").to_pylist(), batch.column("marks").to_pylist(), strict=True)
            for text, (names, marks) in zip(batch.column("text"), earlier, strict=True):
                text = text.as_py() or ""
                count, now, new = _hits(automaton, text)
                if marks is not None:
                    before = np.unpackbits(np.frombuffer(marks, np.uint8), count=count).astype(bool)
                    now = before if now is None else now | before
                n.append(count)
                hit.append(0 if now is None else int(now.sum()))
                found.append(sorted({*new, *names}))
                marked.append(([] if now is None else _places(text, now)) if last else (None if now is None else np.packbits(now).tobytes()))
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            more = [pa.array(marked, _SPANS)] if last else [pa.array(marked, pa.binary()), batch.column("text")]
            yield pa.RecordBatch.from_arrays([*columns, *more], names=["doc_id", "n_words", "n_hit", "items", *(["hits"] if last else ["marks", "text"])])

    return scan


def _slices(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The items by slices; their size comes to the driver before their texts do."""
    rows = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).where("item is not null and text is not null")
    total = rows.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).head()[0]
    count = max(1, -(-total // SLICE))
    for i in range(count):
        own = rows if count == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == i)
        yield sorted((r.item, r.text) for r in own.collect()), i == count - 1


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, hits) of every row: the items whose windows occur, and the characters that they cover."""
    small_batches(docs.sparkSession)
    state = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.array().cast("array<long>").alias("items"), F.lit(None).cast("binary").alias("marks")
    )
    for items, last in _slices(benchmark, item_col, item_text_col):
        schema = "doc_id long, n_words long, n_hit long, items array<long>, "
        schema += "hits array<struct<start:int,stop:int>>" if last else "marks binary, text string"
        state = arrow_map(state.select("doc_id", "text", "items", "marks"), _scan(items, width, last), schema)
        state = state if last else saved(state, "scanned")
    return state


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows, with all their columns, in which no item's window occurs."""

    def without(items: list[tuple[int, str]]):
        def clean_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(items, width)
            for batch in batches:
                yield batch.filter(pa.array([_hits(automaton, x.as_py() or "")[1] is None for x in batch.column(text_col)], pa.bool_()))

        return clean_rows

    small_batches(docs.sparkSession)
    for items, last in _slices(benchmark, item_col, item_text_col):
        docs = arrow_map(docs, without(items), docs.schema)
        docs = docs if last else saved(docs, "scanned")
    return docs


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of ``contamination``."""
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return result.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(names, "utf-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
