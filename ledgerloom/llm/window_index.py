"""Incremental deduplication of repeated word windows with a log-structured fingerprint index.

``deduplicate`` removes every word that a window of ``length`` consecutive words covers whose word sequence also starts
in a document with a smaller id; windows are judged on the input.  Words are `[^\\x20\\x09-\\x0D]+`, unchanged.

A window is known by its least ``key``-word run (textkit.Anchors).  The index holds *runs*: immutable arrays, sorted by
(hash of the run, hash of the windows that share it), with the smallest document that has them.  They lie in parts by
the first hash, and a part works on its own:

1. The documents come in batches of ascending ids.  A batch's fingerprints are sorted and merge-joined with the runs.
   Windows that an earlier document has as well are removed; where only the least run was seen before, with other
   windows around it, both sides go to verification.
2. The batch becomes a new run of what the index did not have.  Runs of similar size are merged (``FANOUT``), keeping
   the smallest document, so a lookup meets few of them.  Joins and merges go by binary search in sorted runs; only
   the batch is ever sorted.
3. Verification fetches the words of both sides and compares two independent 64-bit hashes of every window.

A map task keeps one of its equal windows to itself, so a group of copies sends one record per task, not one per copy.
Given a ``FingerprintIndex``, the runs outlive the call and later loads are checked against them; ``history`` then has
the documents loaded before, for verification.  A load adds one run and compacts the index by the same rule, so it
keeps a number of runs that grows with the logarithm of the loads.  A load reads the runs through one shuffle by part.  Ids must ascend from load to load, or earlier documents keep words
that a later, smaller id has too.

A null text has no words, a document of fewer than ``length`` words keeps all.  A row with a null id loses nothing, and
nothing is lost because of it.  Rows with one id are no repeats of each other.  An empty table gives an empty one.
Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import FLUSH, PACKED, arrow_map, dealt, heads, pack, part_of, parts, saved, small_batches, table_path, unpack
from .spans import NO_ID, SPAN, doc_part, gathered, id_of, keyed, masks, packed_spans, per_document, runs, span_lists
from .textkit import Anchors, Hasher, U, buffers, chunks, mix, words

LENGTH, KEY = 50, 16
#: Batches that one load comes in, and how much larger than the next younger run a run may be and still be merged.
BATCHES, FANOUT = 3, 4

_ENTRY = np.dtype([("key", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("stamp", "<i8"), ("first", "<i4"), ("run", "<u2")])
_ASK = np.dtype([("doc", "<i8"), ("stamp", "<i8"), ("first", "<i4"), ("run", "<u2"), ("open", "u1")])
_WINDOW = np.dtype([("hash", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("stamp", "<i8"), ("start", "<i4"), ("open", "u1")])


@dataclass
class FingerprintIndex:
    """Where the runs of earlier loads lie, oldest first; ``count`` parts each, a part's entries sorted in one row.

    Runs are never changed: one that is merged becomes part of a new one, and its table stays for older manifests.
    """

    count: int
    tables: list[str] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)

    def rows(self, spark: SparkSession) -> DataFrame | None:
        return spark.read.schema(PACKED).parquet(*self.tables) if self.tables else None

    def add(self, spark: SparkSession, path: str) -> None:
        """A new youngest run, merged with those before it for as long as they aren't much larger."""
        size = _bytes(spark, path)
        if not size:
            return
        self.tables.append(path)
        self.sizes.append(size)
        oldest = len(self.tables) - 1
        while oldest and self.sizes[oldest - 1] < FANOUT * sum(self.sizes[oldest:]):
            oldest -= 1
        self.compact(spark, oldest)

    def compact(self, spark: SparkSession, oldest: int = 0) -> None:
        """All runs from the ``oldest`` on become one."""
        if len(self.tables) - oldest < 2:
            return
        count = self.count

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            entries = _all_merged(_arrays(batches, 1)[1])
            yield from pack(entries, part_of(entries["key"], count), 1)

        path = table_path(spark, "run")
        dealt(spark.read.schema(PACKED).parquet(*self.tables[oldest:]), merge, PACKED, count).write.parquet(path)
        self.tables[oldest:], self.sizes[oldest:] = [path], [_bytes(spark, path)]

    def save(self, spark: SparkSession, path: str) -> None:
        manifest = json.dumps({"count": self.count, "tables": self.tables, "sizes": self.sizes})
        spark.createDataFrame([(manifest,)], "manifest string").write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        return cls(**json.loads(spark.read.text(path).head().value))


def _bytes(spark: SparkSession, path: str) -> int:
    return spark.read.schema(PACKED).parquet(path).agg(F.sum(F.octet_length("payload").cast("long"))).head()[0] or 0


def _arrays(batches: Iterator[pa.RecordBatch], *kinds: int) -> dict[int, list[np.ndarray]]:
    """The rows of a part, each an array of its own, by kind; those of ``kinds`` are entries, the others spans."""
    found: dict[int, list[np.ndarray]] = {0: [], 1: [], 2: []}
    for batch in batches:
        for kind, payload in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            found[kind].append(np.frombuffer(payload, _ENTRY if kind in kinds else SPAN))
    return found


def _ordered(entries: np.ndarray) -> np.ndarray:
    return entries[np.lexsort((entries["first"], entries["doc"], entries["context"], entries["key"]))]


def _spans_of(entries: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(entries), SPAN)
    for name, source in (("doc", "doc"), ("stamp", "stamp"), ("start", "first")):
        out[name] = entries[source]
    out["stop"] = entries["first"].astype(np.int64) + entries["run"] + length
    return out


def _first_of(entries: np.ndarray) -> np.ndarray:
    """Marks, in sorted entries, those of the smallest document with their windows."""
    new = heads(entries["key"], entries["context"])
    return entries["doc"] == entries["doc"][new][np.cumsum(new) - 1]


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, doc = words(data, offsets)
    at = np.zeros(len(offsets), np.int64)
    np.cumsum(np.bincount(doc, minlength=len(offsets) - 1), out=at[1:])
    return (Hasher(data)(start, end) if len(start) else np.zeros(0, np.uint64)), at


def _send(length: int, key: int, count: int):
    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        entries = _ordered(np.concatenate(held))
        first = _first_of(entries)
        yield from pack(entries[first], part_of(entries["key"][first], count))
        yield from packed_spans(_spans_of(entries[~first], length), count, 2)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            doc, stamp = batch.column("doc").to_numpy(), batch.column("stamp").to_numpy()
            for lo, hi in chunks(offsets):
                symbols, at = _word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                found = Anchors(symbols, at, length, key)
                out = np.zeros(len(found.first), _ENTRY)
                out["key"], out["context"], out["doc"], out["stamp"] = found.key, found.context, doc[lo + found.doc], stamp[lo + found.doc]
                out["first"], out["run"] = found.first - at[found.doc], found.last - found.first
                held.append(out)
                n += len(out)
            if n >= FLUSH:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return send


def _key_range(run: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.ascontiguousarray(run["key"])
    return np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")


def _place(run: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the entries lies in a sorted run, or would be inserted, and whether it's there."""
    context = np.ascontiguousarray(run["context"])
    at, end = _key_range(run, entries["key"])
    stop = end.copy()
    while len(left := np.flatnonzero(at < stop)):
        middle = (at[left] + stop[left]) >> 1
        less = context[middle] < entries["context"][left]
        at[left[less]] = middle[less] + 1
        stop[left[~less]] = middle[~less]
    there = at < end
    there[there] = context[at[there]] == entries["context"][there]
    return at, there


def _within(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    size = stop - start
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _merged(old: np.ndarray, young: np.ndarray) -> np.ndarray:
    """Two sorted runs as one, with the smaller document where both have the windows."""
    at, there = _place(old, young)
    out, both = old.copy(), np.flatnonzero(there)
    both = both[young["doc"][both] < old["doc"][at[both]]]
    out[at[both]] = young[both]
    return np.insert(out, at[~there], young[~there])


def _all_merged(runs: list[np.ndarray]) -> np.ndarray:
    """Sorted runs as one, the smallest first, so that no entry is moved often."""
    out = np.zeros(0, _ENTRY)
    for run in sorted(runs, key=len):
        out = _merged(run, out)
    return out


class _Runs:
    """The sorted runs of one part, youngest last."""

    def __init__(self, old: list[np.ndarray]):
        self.runs = sorted((x for x in old if len(x)), key=len, reverse=True)

    def join(self, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Merge-join of a batch with the runs: (entries removed, entries in doubt, what they're in doubt with, new to the index).

        Only the batch is sorted; of a run, only entries that share a key with the batch are looked at.
        """
        batch = _ordered(batch)
        new = heads(batch["key"], batch["context"])
        own, group = batch[new], np.cumsum(new) - 1
        if not len(own):
            return batch, batch, batch, batch
        head = heads(own["key"])
        keys, key = own["key"][head], np.cumsum(head) - 1
        smallest = np.minimum.reduceat(own["doc"], np.flatnonzero(head))
        seen = np.full(len(own), np.iinfo(np.int64).max)
        ranges = []
        for run in self.runs:
            at, there = _place(run, own)
            seen[there] = np.minimum(seen[there], run["doc"][at[there]])
            start, stop = _key_range(run, keys)
            held = np.flatnonzero(stop > start)
            if len(held):
                size = (stop - start)[held]
                least = np.minimum.reduceat(run["doc"][_within(start[held], stop[held])], np.cumsum(size) - size)
                smallest[held] = np.minimum(smallest[held], least)
                ranges.append((run, held, start[held], stop[held]))
        first = batch["doc"] == np.minimum(own["doc"], seen)[group]
        doubt = first & (batch["doc"] > smallest[key[group]])
        largest = np.full(len(keys), np.iinfo(np.int64).min)
        np.maximum.at(largest, key[group[doubt]], batch["doc"][doubt])
        other = [own[(own["doc"] < seen) & (own["doc"] < largest[key])]]
        for run, held, start, stop in ranges:
            asked = largest[held] > np.iinfo(np.int64).min
            held, start, stop = held[asked], start[asked], stop[asked]
            entries = run[_within(start, stop)]
            other.append(entries[entries["doc"] < np.repeat(largest[held], stop - start)])
        return batch[~first], batch[doubt], np.concatenate(other), own[own["doc"] < seen]

    def add(self, run: np.ndarray) -> None:
        """A new run; compaction while the one before it is not much larger."""
        if not len(run):
            return
        self.runs.append(run)
        while len(self.runs) > 1 and len(self.runs[-2]) < FANOUT * len(self.runs[-1]):
            young = self.runs.pop()
            self.runs[-1] = _merged(self.runs[-1], young)


def _look_up(length: int, count: int, cuts: list[int], keep: bool):
    def asked(entries: np.ndarray, open_: int) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(entries), _ASK)
        for name in ("doc", "stamp", "first", "run"):
            out[name] = entries[name]
        out["open"] = open_
        yield from pack(out, doc_part(out["doc"], out["stamp"], count), 1)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = _arrays(batches, 0, 1)
        entries, old, spans = np.concatenate([np.zeros(0, _ENTRY), *arrays[0]]), arrays[1], np.concatenate([np.zeros(0, SPAN), *arrays[2]])
        del arrays
        index, fresh = _Runs(old), []
        number = np.searchsorted(np.array(cuts, np.int64), entries["doc"], "left")
        for b in range(len(cuts) + 1):
            removed, doubt, other, new = index.join(entries[number == b])
            yield from packed_spans(_spans_of(removed, length), count)
            yield from asked(doubt, 1)
            yield from asked(other, 0)
            index.add(new)
            fresh.append(new)
        yield from packed_spans(spans, count)
        if keep:
            new = _all_merged(fresh)
            yield from pack(new, part_of(new["key"], count), 2)

    return look_up


def _fetch(length: int, count: int):
    """Every window of the contexts in doubt."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            doc, stamp = batch.column("doc").to_numpy(), batch.column("stamp").to_numpy()
            packed, at = buffers(batch.column("asks"))
            all_asks, at = packed.view(_ASK), at // _ASK.itemsize
            for lo, hi in chunks(offsets):
                symbols, base = _word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                asks = all_asks[at[lo] : at[hi]]
                if not len(asks) or len(symbols) < length:
                    continue
                row = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
                size = asks["run"].astype(np.int64) + 1
                ask = np.repeat(np.arange(len(asks)), size)
                start = asks["first"][ask] + np.arange(len(ask)) - np.repeat(np.cumsum(size) - size, size)
                own = row[ask]
                out = np.zeros(len(ask), _WINDOW)
                out["hash"] = Hasher(symbols).windows(length)[base[own] + start]
                out["check"] = Hasher(mix(symbols ^ U(0x5851F42D4C957F2D))).windows(length)[base[own] + start]
                out["doc"], out["stamp"], out["start"], out["open"] = doc[lo + own], stamp[lo + own], start, asks["open"][ask]
                yield from pack(out, part_of(out["hash"], count))

    return fetch


def _verify(length: int, count: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (windows,) = unpack(batches, _WINDOW)
        if not len(windows):
            return
        windows = windows[np.lexsort((windows["doc"], windows["check"], windows["hash"]))]
        new = heads(windows["hash"], windows["check"])
        late = (windows["doc"] > windows["doc"][new][np.cumsum(new) - 1]) & (windows["open"] == 1)
        found = windows[late]
        out = np.zeros(len(found), SPAN)
        out["doc"], out["stamp"], out["start"], out["stop"] = found["doc"], found["stamp"], found["start"], found["start"] + length
        yield from packed_spans(out, count)

    return verify


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        _, at = buffers(whole.column("text"))
        for lo, hi in chunks(at):
            batch = whole.slice(lo, hi - lo)
            texts = [(x or "").encode().split() for x in batch.column("text").to_pylist()]
            offsets = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(x) for x in texts], out=offsets[1:])
            gone = masks(offsets, batch.column("spans"), batch.column("more"))
            start, stop, doc = runs(gone, offsets)
            for i in np.unique(doc).tolist():
                texts[i] = compress(texts[i], (~gone[offsets[i] : offsets[i + 1]]).tolist())
            kept = pa.array([b" ".join(x) for x in texts], pa.binary()).cast(pa.string())
            columns = [id_of(batch.column("doc")), pa.array(np.diff(offsets)), kept, span_lists(start, stop, doc, len(texts))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "kept", "removed"])


def _cuts(rows: DataFrame, batches: int) -> list[int]:
    """Ids that split the documents into batches of about equal size; any cuts give the same result."""
    if batches < 2:
        return []
    at = rows.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 1000)).head()[0]
    return sorted(set(at or []))


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    key: int = KEY,
    batches: int = BATCHES,
    index: FingerprintIndex | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, n_words, kept, removed): the words that stay, joined by a space, and the maximal removed runs of words."""
    if not 0 < key <= length:
        raise ValueError("key must lie between 1 and length")
    spark = docs.sparkSession
    small_batches(spark)
    count = index.count if index else parts(spark)
    rows = keyed(docs, id_col, text_col)
    named = rows.where(F.col("doc") != NO_ID)
    sent = arrow_map(named, _send(length, key, count), PACKED)
    if index and index.tables:
        sent = sent.unionByName(index.rows(spark))
    looked = dealt(sent, _look_up(length, count, _cuts(named, batches), index is not None), PACKED, count)
    if index is not None:
        looked = saved(looked, "looked-up")
        path = table_path(spark, "run")
        looked.where("kind = 2").withColumn("kind", F.lit(1)).write.parquet(path)
        index.add(spark, path)
        looked = looked.where("kind < 2")
    known = saved(dealt(looked, per_document(_ASK), "doc long, stamp long, spans binary, asks binary", count), "windows")
    texts = rows.repartition(count, "doc", "stamp")
    older = texts if history is None else texts.unionByName(keyed(history, id_col, text_col).repartition(count, "doc", "stamp"))
    asked = older.join(known.where("asks is not null").select("doc", "stamp", "asks"), ["doc", "stamp"])
    verified = gathered(dealt(arrow_map(asked, _fetch(length, count), PACKED), _verify(length, count), PACKED, count))
    whole = known.where("spans is not null").select("doc", "stamp", "spans")
    out = texts.join(whole, ["doc", "stamp"], "left").join(verified.withColumnRenamed("spans", "more"), ["doc", "stamp"], "left")
    schema = "doc_id long, n_words long, kept string, removed array<struct<start:int,stop:int>>"
    return arrow_map(out.select("doc", "text", "spans", "more"), _finish, schema)


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of ``deduplicate``."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return result.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))
