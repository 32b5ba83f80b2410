"""Spans to remove, brought back to the documents that they lie in.

Documents are known by (doc, stamp): the id, with the least 64-bit value for a null, and the 64-bit hash of the text,
which tell apart rows that share an id.  Rows with equal id and text are alike for every operator here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import PACKED, dealt, heads, pack, part_of, parts, unpack
from .textkit import U, buffers, mix

NO_ID = -(1 << 63)
SPAN = np.dtype([("doc", "<i8"), ("stamp", "<i8"), ("start", "<i4"), ("stop", "<i4")])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, stamp, text) of each row; other columns, whatever their names, are left behind."""
    text = F.col(f"`{text_col}`")
    stamp: Column = F.xxhash64(text)
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc"),
        stamp.alias("stamp"),
        text.cast("string").alias("text"),
    )


def id_of(doc: pa.Array) -> pa.Array:
    """The id that ``doc`` stands for."""
    return pc.if_else(pc.equal(doc, NO_ID), pa.scalar(None, pa.int64()), doc)


def doc_part(doc: np.ndarray, stamp: np.ndarray, count: int) -> np.ndarray:
    return part_of(mix(doc.astype(np.uint64) * U(31) + stamp.astype(np.uint64)), count)


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted spans; those of one document that overlap or touch become one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["stamp"], spans["doc"]))]
    base = (np.cumsum(heads(spans["doc"], spans["stamp"])).astype(np.int64)) << 32
    reach = np.maximum.accumulate(base + spans["stop"])
    new = np.ones(len(spans), bool)
    new[1:] = (base + spans["start"])[1:] > reach[:-1]
    first = np.flatnonzero(new)
    out = spans[first].copy()
    last = np.append(first[1:], len(spans)) - 1
    out["stop"] = reach[last] - base[last]
    return out


def by_document(spans: np.ndarray) -> pa.RecordBatch:
    """(doc, stamp, spans) with the merged spans of a document as packed pairs of 32-bit numbers."""
    spans = merged(spans)
    first = np.flatnonzero(heads(spans["doc"], spans["stamp"]))
    stop = np.append(first[1:], len(spans))
    pairs = np.stack([spans["start"], spans["stop"]], axis=1)
    columns = [pa.array(spans["doc"][first]), pa.array(spans["stamp"][first]), pa.array([pairs[a:b].tobytes() for a, b in zip(first, stop, strict=True)], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["doc", "stamp", "spans"])


def packed_spans(spans: np.ndarray, count: int, kind: int = 0) -> Iterator[pa.RecordBatch]:
    spans = merged(spans)
    yield from pack(spans, doc_part(spans["doc"], spans["stamp"], count), kind)


def gathered(packed: DataFrame) -> DataFrame:
    """Packed spans from anywhere to one row (doc, stamp, spans) for each document that has any."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (spans,) = unpack(batches, SPAN)
        if len(spans):
            yield by_document(spans)

    return dealt(packed, reduce, "doc long, stamp long, spans binary", parts(packed.sparkSession))


def per_document(ask: np.dtype):
    """Packed spans (kind 0) and questions (kind 1) to rows (doc, stamp, spans, asks), with one of the two null."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, asks = unpack(batches, SPAN, ask)
        if len(spans):
            rows = by_document(spans)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(len(rows), pa.binary())], names=["doc", "stamp", "spans", "asks"])
        if len(asks):
            asks = asks[np.lexsort((asks["first"], asks["stamp"], asks["doc"]))]
            first = np.flatnonzero(heads(asks["doc"], asks["stamp"]))
            stop = np.append(first[1:], len(asks))
            packed = pa.array([asks[a:b].tobytes() for a, b in zip(first, stop, strict=True)], pa.binary())
            columns = [pa.array(asks["doc"][first]), pa.array(asks["stamp"][first]), pa.nulls(len(first), pa.binary()), packed]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "stamp", "spans", "asks"])

    return reduce


def masks(offsets: np.ndarray, *columns: pa.Array) -> np.ndarray:
    """Marks what the spans of these columns cover in a batch of documents at ``offsets``."""
    change = np.zeros(int(offsets[-1]) + 1, np.int32)
    for column in columns:
        data, at = buffers(column)
        pairs = data.view(np.int32).reshape(-1, 2).astype(np.int64) if len(data) else np.zeros((0, 2), np.int64)
        shift = np.repeat(offsets[:-1], np.diff(at) // 8)
        np.add.at(change, pairs[:, 0] + shift, 1)
        np.add.at(change, pairs[:, 1] + shift, -1)
    return np.cumsum(change[:-1]) > 0


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, document) of the maximal marked runs, which end with their document; places within it."""
    before = np.zeros(len(mask) + 1, bool)
    before[1:] = mask
    inner = np.zeros(len(mask) + 1, bool)
    inner[offsets] = True
    start = np.flatnonzero(mask & (~before[:-1] | inner[:-1]))
    after = np.append(mask[1:], False) if len(mask) else mask
    stop = np.flatnonzero(mask & (~after | inner[1:])) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return start - offsets[doc], stop - offsets[doc], doc


def span_lists(start: np.ndarray, stop: np.ndarray, doc: np.ndarray, count: int) -> pa.Array:
    offsets = np.zeros(count + 1, np.int32)
    np.cumsum(np.bincount(doc, minlength=count), out=offsets[1:])
    pairs = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)


__all__ = ["PACKED", "SPAN", "by_document", "doc_part", "gathered", "id_of", "keyed", "masks", "merged", "packed_spans", "per_document", "runs", "span_lists"]
