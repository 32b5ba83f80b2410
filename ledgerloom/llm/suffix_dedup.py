"""Suffix-array deduplication of byte strings repeated anywhere in a corpus.

``remove_repeats`` removes every byte that a string of ``length`` bytes covers which also starts anywhere else, in
another document or at another place of the same one.  Matches never cross documents, overlaps count, and strings are
judged on the input.

1. Each window of ``length`` bytes picks its least ``key``-byte run (textkit.Anchors): equal windows pick equal runs at
   equal places.  Consecutive windows with one pick make a *context*, about one for every 60 bytes of text, and only
   contexts are shuffled, packed, by the hash of the run.  A map task sends one of its equal contexts, marked.
2. Equal contexts repeat as a whole.  A context whose run occurs in other contexts only may repeat in part; its text
   is fetched, together with one of each of those others.
3. The contexts with one run are sorted by suffix (lyndon.suffix_order, linear grouping by Lyndon prefixes), and
   neighbours in that order are compared byte by byte.  A large set is first split by longer runs around the common
   one, each window going with one of them, so that no sort grows with the number of copies.
4. Spans return to their documents, merged, in one join.

Shuffles: packed contexts (about the size of the compressed input), the texts once (both joins read one exchange), the
texts of partly repeated contexts.  A run that very many *different* contexts hold goes to one task as 35 bytes each.

A null text is empty; a text of fewer than ``length`` bytes keeps all; rows with a null id are documents like others.
Equal rows count as separate documents, so all of their long texts go.  An empty table gives an empty one.  Columns
other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import FLUSH, PACKED, arrow_map, dealt, heads, pack, part_of, parts, saved, small_batches, unpack
from .lyndon import FIRST_BYTE, SENTINEL, SEPARATOR, suffix_order
from .spans import SPAN, doc_part, gathered, id_of, keyed, masks, packed_spans, per_document, runs, span_lists
from .textkit import Anchors, Hasher, buffers, chunks

LENGTH, KEY = 200, 64
#: Bytes of contexts that are sorted together; a larger set is split first.
LARGE = 1 << 14
#: Symbols of a batch of sorts.
BATCH = 1 << 19

_CONTEXT = np.dtype([("key", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("stamp", "<i8"), ("first", "<i4"), ("run", "<u2"), ("at", "<u2"), ("many", "u1")])
_ASK = np.dtype([("doc", "<i8"), ("stamp", "<i8"), ("key", "<u8"), ("first", "<i4"), ("run", "<u2"), ("at", "<u2"), ("open", "u1")])
_TEXTS = "part int, key long, doc long, stamp long, first int, run int, at int, open int, text binary"


def _spans_of(contexts: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(contexts), SPAN)
    out["doc"], out["stamp"], out["start"] = contexts["doc"], contexts["stamp"], contexts["first"]
    out["stop"] = contexts["first"].astype(np.int64) + contexts["run"] + length
    return out


def _collapsed(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one of each of the equal contexts, marked if there are many; the contexts that have an equal one)."""
    contexts = contexts[np.lexsort((contexts["context"], contexts["key"]))]
    new = heads(contexts["key"], contexts["context"])
    group = np.cumsum(new) - 1
    many = np.bincount(group, weights=1 + contexts["many"].astype(float)) > 1 if len(contexts) else np.zeros(0, bool)
    single = contexts[new].copy()
    single["many"] = many
    return single, contexts[many[group]]


def _send_contexts(length: int, key: int, count: int):
    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        single, equal = _collapsed(np.concatenate(held))
        yield from pack(single, part_of(single["key"], count))
        yield from packed_spans(_spans_of(equal, length), count, 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            doc, stamp = batch.column("doc").to_numpy(), batch.column("stamp").to_numpy()
            for lo, hi in chunks(offsets):
                base = offsets[lo : hi + 1] - offsets[lo]
                found = Anchors(data[offsets[lo] : offsets[hi]], base, length, key)
                out = np.zeros(len(found.first), _CONTEXT)
                out["key"], out["context"], out["doc"], out["stamp"] = found.key, found.context, doc[lo + found.doc], stamp[lo + found.doc]
                out["first"], out["run"], out["at"] = found.first - base[found.doc], found.last - found.first, found.at - found.first
                held.append(out)
                n += len(out)
            if n >= FLUSH:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return send


def _match_contexts(length: int, count: int):
    """Spans of equal contexts; and the contexts to look into, by document."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, spans = unpack(batches, _CONTEXT, SPAN)
        single, equal = _collapsed(contexts)
        yield from packed_spans(np.concatenate([spans, _spans_of(equal, length)]), count)
        new = heads(single["key"])
        group = np.cumsum(new) - 1
        if not len(single):
            return
        several = np.bincount(group) > 1
        unsure = np.bincount(group, weights=1 - single["many"].astype(float)) > 0
        asked = single[(several & unsure)[group]]
        out = np.zeros(len(asked), _ASK)
        for name in ("doc", "stamp", "key", "first", "run", "at"):
            out[name] = asked[name]
        out["open"] = 1 - asked["many"]
        yield from pack(out, doc_part(out["doc"], out["stamp"], count), 1)

    return match


def _fetch(length: int, count: int):
    """The texts of the contexts asked for."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            packed, at = buffers(batch.column("asks"))
            asks = packed.view(_ASK)
            row = np.repeat(np.arange(len(batch)), np.diff(at) // _ASK.itemsize)
            start = offsets[row] + asks["first"]
            texts = [data[a:b].tobytes() for a, b in zip(start, start + asks["run"] + length, strict=True)]
            numbers = [asks[n].astype(np.int32) for n in ("first", "run", "at", "open")]
            columns = [part_of(asks["key"], count).astype(np.int32), asks["key"].astype(np.int64), asks["doc"], asks["stamp"], *numbers]
            names = ["part", "key", "doc", "stamp", "first", "run", "at", "open", "text"]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(texts, pa.binary())], names=names)

    return fetch


class _Sets:
    """Sets of context pieces whose suffixes are to be sorted together: a piece is (context, first start, last start)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.data, self.offsets, self.length = data, offsets, length
        self.sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.sure: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def text(self, context: int, lo: int, hi: int) -> bytes:
        return self.data[self.offsets[context] + lo : self.offsets[context] + hi].tobytes()

    def add(self, context: np.ndarray, first: np.ndarray, last: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """left..right: the bytes that all windows of a piece hold, equal in all pieces."""
        todo = [(context, first, last, left, right)]
        while todo:
            context, first, last, left, right = todo.pop()
            if len(context) < 2:
                continue
            if int(right[0] - left[0]) >= self.length:
                self.sure.append((context, first, last))
            elif int((last - first + self.length).sum()) <= LARGE:
                self.sets.append((context, first, last))
            else:
                rest = self.length - int(right[0] - left[0])
                half = -(-rest // 2)
                cut = left - half
                for piece in (
                    (context, first, np.minimum(last, cut), cut, right),
                    (context, np.maximum(first, cut + 1), last, left, right + rest - half + 1),
                ):
                    todo += self.split(*piece)

    def split(self, context, first, last, left, right) -> list[tuple[np.ndarray, ...]]:
        """Pieces by the bytes left..right; those that are equal altogether stay as one and are surely repeated."""
        groups: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(first <= last).tolist():
            groups.setdefault(self.text(context[i], left[i], right[i]), []).append(i)
        out = []
        for group in groups.values():
            if len(group) < 2:
                continue
            alike: dict[tuple[bytes, int], list[int]] = {}
            for i in group:
                alike.setdefault((self.text(context[i], first[i], last[i] + self.length), int(left[i] - first[i])), []).append(i)
            for same in alike.values():
                if len(same) > 1:
                    self.sure.append((context[same], first[same], last[same]))
            one = np.array([same[0] for same in alike.values()])
            out.append((context[one], first[one], last[one], left[one], right[one]))
        return out

    def batches(self) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        held, n = [], 0
        for x in sorted(self.sets, key=lambda x: int((x[2] - x[1]).sum()) + self.length * len(x[0])):
            held.append(x)
            n += int((x[2] - x[1] + self.length + 1).sum())
            if n >= BATCH:
                yield held
                held, n = [], 0
        if held:
            yield held

    def repeated(self, batch) -> tuple[np.ndarray, np.ndarray]:
        """(context, start) of the windows of these sets that occur more than once, found by sorting suffixes."""
        context, first, last = (np.concatenate(x) for x in zip(*batch, strict=True))
        sizes = np.array([len(x[0]) for x in batch])
        lengths = last - first + self.length
        at = np.cumsum(lengths + 1) - lengths - 1
        piece = np.repeat(np.arange(len(context)), lengths)
        offset = np.arange(len(piece)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        symbols = np.full(int((lengths + 1).sum()), SEPARATOR, np.int64)
        place = at[piece] + offset
        symbols[place] = self.data[(self.offsets[context] + first)[piece] + offset].astype(np.int64) + FIRST_BYTE
        ends = np.cumsum(sizes)
        symbols[(at + lengths)[ends - 1]] = SENTINEL
        order = suffix_order(symbols, at[np.append(0, ends[:-1])])
        start_of = np.full(len(symbols), -1, np.int64)
        start_of[place] = np.where(offset <= (last - first)[piece], piece, -1)
        order = order[start_of[order] >= 0]
        hashes = Hasher(symbols.astype(np.uint8)).windows(self.length)[order]
        same = np.flatnonzero(hashes[1:] == hashes[:-1])
        step = np.arange(self.length)
        for lo in range(0, len(same), 1 << 13):
            block = same[lo : lo + (1 << 13)]
            equal = (symbols[order[block][:, None] + step] == symbols[order[block + 1][:, None] + step]).all(axis=1)
            same[lo : lo + (1 << 13)][~equal] = -1
        same = same[same >= 0]
        found = np.unique(np.concatenate([order[same], order[same + 1]]))
        piece = start_of[found]
        return context[piece], first[piece] + found - at[piece]


def _sort_contexts(length: int, key_length: int, count: int):
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        del rows
        data, offsets = buffers(table.column("text"))
        key, doc, stamp, start, run, at, open_ = (table.column(n).to_numpy() for n in ("key", "doc", "stamp", "first", "run", "at", "open"))
        order = np.argsort(key, kind="stable")
        sets = _Sets(data, offsets, length)
        first = np.flatnonzero(heads(key[order]))
        zero = np.zeros(len(key), np.int64)
        run, at = run.astype(np.int64), at.astype(np.int64)
        for a, b in zip(first, np.append(first[1:], len(order)), strict=True):
            own = order[a:b]
            sets.add(own, zero[own], run[own], at[own], at[own] + key_length)
        spans = []

        def take(context: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
            own = open_[context] == 1
            context, lo, hi = context[own], lo[own], hi[own]
            out = np.zeros(len(context), SPAN)
            out["doc"], out["stamp"], out["start"], out["stop"] = doc[context], stamp[context], start[context] + lo, start[context] + hi + length
            spans.append(out)

        for x in sets.sure:
            take(*x)
        for batch in sets.batches():
            context, place = sets.repeated(batch)
            take(context, place, place)
        if spans:
            yield from packed_spans(np.concatenate(spans), count)

    return sort


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        gone = masks(offsets, batch.column("spans"), batch.column("more"))
        start, stop, doc = runs(gone, offsets)
        left = np.zeros(len(offsets), np.int64)
        np.cumsum(np.bincount(doc, weights=(stop - start).astype(float), minlength=len(batch)).astype(np.int64), out=left[1:])
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer((offsets - left).astype(np.int64)), pa.py_buffer(data[~gone].tobytes())])
        columns = [id_of(batch.column("doc")), pa.array(np.diff(offsets)), kept.cast(pa.binary()), span_lists(start, stop, doc, len(batch))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "kept", "removed"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, key: int = KEY) -> DataFrame:
    """(doc_id, n_bytes, kept, removed): the bytes that stay and the maximal removed runs, for every row."""
    if not 0 < key <= length:
        raise ValueError("key must lie between 1 and length")
    spark = docs.sparkSession
    small_batches(spark)
    count = parts(spark)
    rows = keyed(docs, id_col, text_col)
    sent = arrow_map(rows, _send_contexts(length, key, count), PACKED)
    matched = dealt(sent, _match_contexts(length, count), PACKED, count)
    known = saved(dealt(matched, per_document(_ASK), "doc long, stamp long, spans binary, asks binary", count), "contexts")
    texts = rows.repartition(count, "doc", "stamp")
    asked = texts.join(known.where("asks is not null").select("doc", "stamp", "asks"), ["doc", "stamp"])
    fetched = arrow_map(asked.select("text", "asks"), _fetch(length, count), _TEXTS)
    sorted_ = gathered(dealt(fetched, _sort_contexts(length, key, count), PACKED, count))
    whole = known.where("spans is not null").select("doc", "stamp", "spans")
    out = texts.join(whole, ["doc", "stamp"], "left").join(sorted_.withColumnRenamed("spans", "more"), ["doc", "stamp"], "left")
    schema = "doc_id long, n_bytes long, kept binary, removed array<struct<start:int,stop:int>>"
    return arrow_map(out.select("doc", "text", "spans", "more"), _finish, schema)


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of ``remove_repeats``."""
    kept = F.octet_length("kept").cast("long")
    return result.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - kept).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
