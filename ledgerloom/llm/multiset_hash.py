"""Homomorphic multiset fingerprints of documents.

A paragraph (a line that isn't empty) is hashed to a wide vector, and a document's fingerprint is the sum of its
paragraphs' vectors modulo powers of two, so the order of paragraphs doesn't matter and one is inserted or deleted by
adding or subtracting its vector (``Fingerprint.insert``, ``delete``).  The vector has two parts:

* ``WIDE`` lanes modulo 2**64, expanded from two independent hashes of the whole paragraph.  Equal sums mean equal
  multisets of paragraphs, up to collisions of 1024-bit sums.
* ``LANES`` lanes modulo 2**32 to which each run of three words of the paragraph adds 1 or -1 at a place chosen by its
  hash.  The cosine of two such sums estimates that of the documents' multisets of word triples, with a standard
  error of about ``LANES`` ** -0.5; it's the *likeness*, not below 0 nor above 1.  Equal fingerprints have likeness 1.

``edited_fingerprints`` compares each document with its edited text and with the next document in descending id order.
Ids are dealt to parts by value ranges; the first document of a part is sent to the part before as well, so one shuffle
of the texts gives each its next, and no task sees all ids.

A null text is empty: its fingerprint is zero.  Equal ids follow each other by text; rows with a null id come last.  One
row alone is its own next.  An empty table gives an empty one.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import arrow_map, parts, small_batches
from .spans import NO_ID
from .textkit import Hasher, U, buffers, chunks, mix, stream, words

WIDE, LANES = 16, 256
_EXPAND, _EXPAND_TOO = stream(31, WIDE), stream(37, WIDE)
_OTHER_BYTE = stream(41, 256)
_TRIPLE = stream(43, 3) | U(1)
#: Rows that are fingerprinted together.
STEP = 2000


def _paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    breaks = np.zeros(256, bool)
    breaks[10] = True
    return words(data, offsets, breaks)


def _sums(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(wide sums, lane sums) of each document."""
    count = len(offsets) - 1
    wide, lanes = np.zeros((count, WIDE), np.uint64), np.zeros((count, LANES), np.int32)
    start, end, doc = _paragraphs(data, offsets)
    if not len(start):
        return wide, lanes
    hasher = Hasher(data)
    one, two = hasher(start, end), Hasher(_OTHER_BYTE[data])(start, end)
    vectors = mix(one[:, None] ^ _EXPAND) + mix(two[:, None] ^ _EXPAND_TOO)
    head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    wide[doc[head]] = np.add.reduceat(vectors, head, axis=0)
    first, last, owner = words(data, offsets)
    if not len(first):
        return wide, lanes
    word = hasher(first, last)
    line = np.searchsorted(start, first, "right") - 1
    size = np.bincount(line, minlength=len(start))
    at = np.cumsum(size) - size
    found, home = [], []
    if len(word) > 2:
        whole = line[:-2] == line[2:]
        found.append((word[:-2] * _TRIPLE[0] + word[1:-1] * _TRIPLE[1] + word[2:] * _TRIPLE[2])[whole])
        home.append(owner[:-2][whole])
    for few in (1, 2):
        own = np.flatnonzero(size == few)
        found.append(sum(word[at[own] + j] * _TRIPLE[j] for j in range(few)) + U(few))
        home.append(doc[own])
    feature, home = mix(np.concatenate(found)), np.concatenate(home)
    sign = 1.0 - 2.0 * ((feature >> U(40)) & U(1)).astype(float)
    place = home * LANES + (feature % U(LANES)).astype(np.int64)
    total = np.bincount(place, weights=sign, minlength=count * LANES).astype(np.int64)
    return wide, total.astype(np.uint64).astype(np.uint32).view(np.int32).reshape(count, LANES)


class Fingerprint:
    """One document's sums; adding and subtracting are modulo the lanes' powers of two."""

    def __init__(self, text: str = ""):
        wide, lanes = fingerprints([text])
        self.wide, self.lanes = wide[0], lanes[0]

    def insert(self, text: str) -> Fingerprint:
        other = Fingerprint(text)
        self.wide, self.lanes = self.wide + other.wide, self.lanes + other.lanes
        return self

    def delete(self, text: str) -> Fingerprint:
        other = Fingerprint(text)
        self.wide, self.lanes = self.wide - other.wide, self.lanes - other.lanes
        return self

    def __str__(self) -> str:
        return self.wide.tobytes().hex() + self.lanes.tobytes().hex()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and str(self) == str(other)

    __hash__ = None


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers(pa.array([(x or "").encode() for x in texts], pa.large_binary()))
    found = [_sums(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets)]
    if not found:
        return np.zeros((0, WIDE), np.uint64), np.zeros((0, LANES), np.int32)
    return np.concatenate([w for w, _ in found]), np.concatenate([x for _, x in found])


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of the fingerprints in equal rows."""
    x, y = a[1].astype(float), b[1].astype(float)
    norm = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cosine = np.divide((x * y).sum(axis=1), norm, out=np.zeros(len(x)), where=norm > 0)
    return np.where((a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1), 1.0, np.clip(cosine, 0.0, 1.0))


def _strings(prints: tuple[np.ndarray, np.ndarray]) -> list[str]:
    return [w.tobytes().hex() + x.tobytes().hex() for w, x in zip(*prints, strict=True)]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one part in descending order, then the first of the next part (``guest``)."""
    rows: list[tuple[int, str, int]] = []

    def made(rows: list[tuple[int, str, int]]) -> pa.RecordBatch:
        texts = [x[1] for x in rows]
        own = fingerprints(texts)
        edited = []
        for text, after in zip(texts[:-1], texts[1:], strict=True):
            half = len(text) // 2
            edited.append(text[: len(text) - half] + after[:half])
        changed = fingerprints(edited)
        here, following = tuple(x[:-1] for x in own), tuple(x[1:] for x in own)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None if x[0] == NO_ID else x[0] for x in rows[:-1]], pa.int64()),
                pa.array([len(x) for x in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                pa.array(_strings(here)),
                pa.array(_strings(changed)),
                pa.array(likeness(here, changed)),
                pa.array(likeness(here, following)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for batch in batches:
        for lo in range(0, len(batch), STEP):
            part = batch.slice(lo, STEP)
            new = zip(part.column("doc").to_pylist(), [x or "" for x in part.column("text").to_pylist()], part.column("guest").to_pylist(), strict=True)
            for row in new:
                if row[2] and rows and rows[-1][2]:
                    continue
                rows.append(row)
            if len(rows) > 1:
                yield made(rows)
                rows = rows[-1:]


def _bucket(cuts: list[int]):
    """0 for the largest ids, up to len(cuts) for the least."""
    limits = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def bucket(doc: pd.Series) -> pd.Series:
        return pd.Series((len(limits) - np.searchsorted(limits, doc.to_numpy(), "left")).astype(np.int32))

    return bucket


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text: its last half, rounded down, replaced by as many first characters of the next document, or all.
    """
    spark = docs.sparkSession
    small_batches(spark)
    count = parts(spark)
    doc = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc")
    rows = docs.select(doc, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    ids = docs.select(doc)
    cuts = ids.agg(F.percentile_approx("doc", [i / count for i in range(1, count)] or [0.5], 10_000)).head()[0] or []
    bucket = _bucket(sorted(set(cuts)))
    # One row a part: the parts that have documents, each with its largest id.
    first = sorted((r["part"], r["top"]) for r in ids.select("doc", bucket("doc").alias("part")).groupBy("part").agg(F.max("doc").alias("top")).collect())
    before = {top: first[i - 1][0] for i, (_, top) in enumerate(first)}
    tops = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.lit(None).cast("map<bigint,int>")
    placed = rows.select("doc", "text", bucket("doc").alias("part"), F.element_at(tops, F.col("doc")).alias("also") if before else F.lit(None).cast("int").alias("also"))
    homes = F.array(F.struct(F.col("part"), F.lit(0).alias("guest")), F.struct(F.col("also").alias("part"), F.lit(1).alias("guest")))
    dealt = placed.select("doc", "text", F.explode(F.filter(homes, lambda x: x["part"].isNotNull())).alias("at")).select("doc", "text", "at.part", "at.guest")
    ordered = dealt.repartitionById(max(count, len(cuts) + 1), "part").sortWithinPartitions("guest", F.desc("doc"), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return arrow_map(ordered.select("doc", "text", "guest"), _compare, schema)
