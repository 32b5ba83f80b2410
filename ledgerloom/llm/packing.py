"""Packing tokenised documents into sequences by vector best fit.

A document's ids are those of a public byte-level BPE, then one closing id.  Only documents longer than a sequence are
cut, into pieces of its capacity; the first piece may be shorter.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece lengths).  Pieces go by
descending length to the sequence that is left with the least weighted norm of its residual capacities, among those
where every capacity holds; a new one is opened if there is none.

Pieces of one length are alike, so the driver packs the *histogram* of lengths, at most ``capacity`` numbers, and
whole ranges of equal pieces go to whole ranges of alike sequences, as many to each as fit, which is where they would
go one by one.  The plan's size depends on the capacity, not on the number of documents.  Each piece then finds its
place from its rank among the pieces of its length: its place in its task plus the counts of the tasks before, so no
task holds all pieces of a length.

A null text is empty: one piece, the closing id.  Strings of special tokens in a text are ordinary text.  Rows are
packed independently of their ids; a null id, or one that repeats, stays as it is.  An empty table gives an empty one.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import arrow_map, kept, saved, small_batches

CAPACITY, CLOSING = 1024, 2
#: Texts without anything else take the faster of two equal encoders.
_PLAIN = re.compile(r"[\t\n\r -~¡-¬®-ɏ]*")
#: Blanks in a row on which the faster encoder's pattern search runs out of stack.
_BLANKS = re.compile(r"[\t\n\r ]{1000}")


class Encoder:
    """Ids of a text by the vocabulary in a file of the `tokenizers` library.

    ``ranks`` may name the same vocabulary as a file of ranks.  Plain texts are then encoded by tiktoken, about four
    times as fast; on others, where Unicode versions of the two libraries may differ, `tokenizers` itself is used.
    """

    def __init__(self, path: str, ranks: str | None):
        self.path, self.fast = path, None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @classmethod
    def of(cls, path: str, ranks: str | None) -> Encoder:
        """Loaded once in each Python worker."""
        return kept(("encoder", path, ranks), lambda: cls(path, ranks))

    @cached_property
    def exact(self):
        """Of the `tokenizers` library; loaded when a text needs it."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.encode_special_tokens = True
        return made

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and _PLAIN.fullmatch(text) and not _BLANKS.search(text):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")


@dataclass(frozen=True)
class Limits:
    tokens: int = CAPACITY
    documents: int = CAPACITY
    attention: int = CAPACITY * CAPACITY
    #: Weights of the three residuals, each as a part of its capacity.
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)


def plan(histogram: dict[int, int], limits: Limits = Limits()) -> np.ndarray:
    """Where the pieces of each length go: rows (length, first rank, count, first sequence, offset).

    The pieces of a row go to as many consecutive sequences, all at one offset.
    """
    capacity = np.array([limits.tokens, limits.documents, limits.attention], float)
    weights = np.array(limits.weights)
    left = np.zeros((0, 3))  # residual capacities of each kind of sequence
    kinds: list[list[tuple[int, int]]] = []  # ranges (first, count) of sequences of each kind
    rows: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        need = np.array([length, 1, length * length], float)
        if (need > capacity).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        rank, todo = 0, histogram[length]
        while todo:
            after = left - need
            fits = np.flatnonzero((after >= 0).all(axis=1))
            if len(fits):
                norm = ((weights * after[fits] / capacity) ** 2).sum(axis=1)
                best = int(fits[np.argmin(norm)])
            else:
                fresh = -(-todo // int((capacity // need).min()))
                kinds.append([(opened, fresh)])
                left = np.vstack([left, capacity])
                opened += fresh
                best = len(kinds) - 1
            # The sequence that took a piece is the best for the next one too, until the length no longer fits there.
            layers = min(todo, int((left[best] // need).min()))
            offset = int(capacity[0] - left[best, 0])
            moved = []
            while todo >= layers and kinds[best]:
                first, count = kinds[best].pop()
                used = min(count, todo // layers)
                if used < count:
                    kinds[best].append((first + used, count - used))
                for i in range(layers):
                    rows.append((length, rank, used, first, offset + i * length))
                    rank += used
                moved.append((first, used))
                todo -= layers * used
            state = left[best] - layers * need
            if not kinds[best]:
                kinds[best], left[best] = moved, state
            else:
                kinds.append(moved)
                left = np.vstack([left, state])
            full = left[:, 0] < 1
            if full.any():
                kinds = [k for k, f in zip(kinds, full, strict=True) if not f]
                left = left[~full]
            left, kinds = _joined(left, kinds)
    return np.array(rows, np.int64).reshape(-1, 5)


def _joined(left: np.ndarray, kinds: list[list[tuple[int, int]]]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Kinds with equal residuals become one."""
    same: dict[tuple, int] = {}
    out: list[list[tuple[int, int]]] = []
    for row, ranges in zip(map(tuple, left.tolist()), kinds, strict=True):
        if row in same:
            out[same[row]] = out[same[row]] + ranges
        else:
            same[row] = len(out)
            out.append(list(ranges))
    return (left if len(out) == len(kinds) else np.array(list(same)).reshape(-1, 3)), out


def _cut(path: str, ranks: str | None, capacity: int, closing: int):
    """Pieces, numbered by length within the task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path, ranks)
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        end = np.array([closing], "<u4").tobytes()
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for own, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encoder.ids(text.as_py() or "").tobytes() + end
                n = len(ids) // 4
                first = n % capacity or capacity
                edges = [0, *range(min(first, n), n + 1, capacity)]
                for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    doc.append(own)
                    piece.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            sizes = np.array(length, np.int64)
            order = np.argsort(sizes, kind="stable")
            ordered = sizes[order]
            head = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
            count = np.diff(np.append(head, len(ordered)))
            nth = np.empty(len(sizes), np.int64)
            nth[order] = np.arange(len(sizes)) - np.repeat(head, count) + seen[ordered]
            seen[ordered[head]] += count
            columns = [
                pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64()),
                pa.array(np.full(len(sizes), task, np.int32)), pa.array(nth),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return cut


def _place(rows: np.ndarray):
    """The plan row of a piece, by its length and rank."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    keys = (rows[:, 0] << 48) | rows[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("before").to_numpy() + batch.column("nth").to_numpy()
            row = rows[np.searchsorted(keys, (length << 48) | rank, "right") - 1]
            same = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns = [*same, pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits(), closing: int = CLOSING) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
    pieces = saved(arrow_map(rows, _cut(tokenizer, ranks, limits.tokens, closing), schema), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["total"] for r in counts.groupBy("length").agg(F.sum("n").alias("total")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    ranked = pieces.join(counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("before")), ["length", "task"])
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return arrow_map(ranked, _place(plan(histogram, limits)), schema)
