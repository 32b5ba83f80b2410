"""Exact Jaccard self-join of word n-gram sets, and the groups that its links form.

A document's set are the distinct 64-bit hashes of its ``n``-word shingles (A-Z lower-cased, words
`[^\\x20\\x09-\\x0D]+`); with fewer words, the whole sequence is its one shingle; without words it is empty and linked
with nothing.  Two documents link when 100 * |intersection| >= percent * |union|.

The join runs on *classes*, documents with one set (a 64-bit hash of it), so copies cost one record per task.  With sets
in hash order, classes that link share at least l of the first p + l - 1 elements, p = n - ceil(t n) + 1, for any l.

1. Base prefixes (l = 1) meet by element; elements that one class alone has are dropped, which settles most classes.
2. A class whose elements are shared with many lengthens its prefix.  With l - 1 more elements, l must be shared, so
   it need not be looked up under the l - 1 most frequent ones.  Each class takes the l of 1, 2, 4, ... or its whole
   set that makes the estimated candidates plus the elements to send fewest.  Two classes meet at the lesser l: of
   equals both must look the element up, else the one with the lesser l does.
3. Each class is first compared with one class of a like size that holds its elements (the hub of the lists it stands
   in): the one with many frequent elements, in later rounds of a part drawn by hash.  What links connect is one
   group; the next round looks for a hub outside the own group.  So a group of near copies costs a few stars of
   comparisons, not its pairs.  A last round goes by lengthened prefixes: their frequencies show the class with the
   fewest edits, and what links only with it would be a candidate of most of its group.
4. Only pairs between two groups are then looked for in the lists.  They are counted by shared elements; that count
   bounds the intersection from above, and pairs whose bound is too low are never verified.
5. What is left is verified on the whole sets: of each group some pairs with most shared elements, then more, while
   they find links and what they connect drops out; then all pairs that remain.  Links become components by distributed star
   contraction.

No step holds more of one list than its classes, and no step writes the pairs within a connected group.  Component ids
are exact up to collisions of 64-bit hashes.

A row with a null id has no part: its component is null.  Equal rows, and rows with one id and different texts, are
documents of their own.  Null and empty texts and texts of blanks have empty sets.  An empty table gives an empty one.
Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .exchange import FLUSH, PACKED, arrow_map, dealt, discard, heads, pack, part_of, parts, saved, small_batches, small_or_not, unpack
from .textkit import LOWER, Hasher, U, buffers, chunks, mix, stream, words

WORDS, PERCENT = 5, 75
#: The level of a class whose prefix is its whole set.
WHOLE = 1 << 30
#: Shared elements that fill a part.
FILL = 50_000
#: Lists up to this size are paired as they are; of larger ones only what lies outside the largest group is.
SHORT = 64
#: Rounds of comparisons with hubs, which end when fewer classes than ``LONE`` find no link.
TURNS, LONE = 2, 1000
#: Candidates are compared at once if there are so few, or fewer than so many times those of the round before.
FEW, FAIR = 4096, 2

_PLACE = stream(23, 64) | U(1)
_TOKEN = np.dtype([("h", "<u8"), ("c", "<u8")])
_META = np.dtype([("doc", "<i8"), ("c", "<u8"), ("n", "<i4")])
_SHARED = np.dtype([("c", "<u8"), ("h", "<u8"), ("df", "<u4")])
_SCORED = np.dtype([("h", "<u8"), ("c", "<u8"), ("group", "<u8"), ("n", "<i4"), ("score", "<f8")])
_HUB = np.dtype([("c", "<u8"), ("hub", "<u8"), ("n", "<i4")])
_LONGER = np.dtype([("h", "<u8"), ("c", "<u8"), ("n", "<i4"), ("level", "<i4"), ("rank", "<i4"), ("df", "<u4")])
_ROOT = np.dtype([("c", "<u8"), ("root", "<u8")])
_MEMBER = np.dtype([("h", "<u8"), ("c", "<u8"), ("n", "<i4"), ("level", "<i4"), ("own", "<i4"), ("drop", "<i4"), ("looks", "u1"), ("group", "<u8")])
_PAIR = np.dtype([("x", "<u8"), ("y", "<u8"), ("gx", "<u8"), ("gy", "<u8"), ("nx", "<i4"), ("ny", "<i4"), ("level", "<i4"), ("drop", "<i4"), ("shared", "<i4")])


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection that a set of n has with any that it links to."""
    return (percent * n + 99) // 100


def base(n: np.ndarray, percent: int) -> np.ndarray:
    return n - needed(n, percent) + 1


def prefix(n: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n, base(n, percent) + np.minimum(level, WHOLE) - 1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each document's set, sorted; and where it begins."""
    data = LOWER[data]
    start, end, doc = words(data, offsets)
    count = len(offsets) - 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(count + 1, np.int64)
    word = Hasher(data)(start, end)
    n = np.bincount(doc, minlength=count)
    first = np.cumsum(n) - n
    found, owner = [], []
    if len(word) >= size:
        stop = len(word) - size + 1
        whole = doc[:stop] == doc[size - 1 :]
        h = sum(word[j : stop + j] * _PLACE[j] for j in range(size))
        found.append(mix(h[whole]))
        owner.append(doc[:stop][whole])
    for few in range(1, size):
        own = np.flatnonzero(n == few)
        if len(own):
            found.append(mix(sum(word[first[own] + j] * _PLACE[j] for j in range(few)) + U(few)))
            owner.append(own)
    h, doc = np.concatenate(found), np.concatenate(owner)
    if len(found) > 1:
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    at = np.zeros(count + 1, np.int64)
    np.cumsum(np.bincount(doc, minlength=count), out=at[1:])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h[a:b].sort()
    new = heads(doc, h)
    at = np.zeros(count + 1, np.int64)
    np.cumsum(np.bincount(doc[new], minlength=count), out=at[1:])
    return h[new], at


def classes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The class of each set; 0 of an empty one."""
    n = np.diff(at)
    out = np.zeros(len(n), np.uint64)
    some = n > 0
    if some.any():
        out[some] = mix(np.add.reduceat(mix(h ^ U(0xA0761D6478BD642F)), at[:-1][some]) + n[some].astype(np.uint64)) | U(1)
    return out


def _sets(batches: Iterator[pa.RecordBatch], size: int):
    """(batch, first row, sets, where each begins, classes) of every chunk."""
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for lo, hi in chunks(offsets):
            h, at = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
            yield batch, lo, h, at, classes(h, at)


def _rank(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return row, np.arange(len(row)) - at[:-1][row]


def _send_base(size: int, percent: int, count: int):
    def flush(tokens: list, metas: list) -> Iterator[pa.RecordBatch]:
        if tokens:
            token = np.unique(np.concatenate(tokens)) if len(tokens) > 1 else tokens[0]
            yield from pack(token, part_of(token["h"], count))
        meta = np.concatenate(metas)
        yield from pack(meta, part_of(meta["c"], count), 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, metas, seen, n = [], [], set(), 0
        for batch, lo, h, at, c in _sets(batches, size):
            meta = np.zeros(len(c), _META)
            meta["doc"], meta["c"], meta["n"] = batch.column("doc").to_numpy()[lo : lo + len(c)], c, np.diff(at)
            metas.append(meta)
            fresh = np.zeros(len(c), bool)
            for i, x in enumerate(c.tolist()):
                if x and x not in seen:
                    seen.add(x)
                    fresh[i] = True
            row, rank = _rank(at)
            take = fresh[row] & (rank < base(meta["n"].astype(np.int64), percent)[row])
            token = np.zeros(int(take.sum()), _TOKEN)
            token["h"], token["c"] = h[take], c[row[take]]
            tokens.append(token)
            n += len(token)
            if n >= FLUSH:
                yield from flush(tokens, metas)
                tokens, metas, seen, n = [], [], set(), 0
        if metas:
            yield from flush(tokens, metas)

    return send


def _share(count: int):
    """Elements that more than one class has, with their number, to their classes."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, metas = unpack(batches, _TOKEN, _META)
        yield from pack(metas, part_of(metas["c"], count), 1)
        if not len(tokens):
            return
        tokens = tokens[np.lexsort((tokens["c"], tokens["h"]))]
        tokens = tokens[heads(tokens["h"], tokens["c"])]
        group = np.cumsum(heads(tokens["h"])) - 1
        df = np.bincount(group)[group]
        out = np.zeros(int((df > 1).sum()), _SHARED)
        out["c"], out["h"], out["df"] = tokens["c"][df > 1], tokens["h"][df > 1], df[df > 1]
        yield from pack(out, part_of(out["c"], count))

    return share


def choose_level(df: np.ndarray, n: int, percent: int) -> int:
    """The l with the fewest estimated candidates and elements: lengthened prefixes are taken to be like the base one."""
    p = int(base(np.int64(n), percent))
    costs = np.sort(df.astype(np.int64) - 1)
    best, cost = 1, int(costs.sum())
    level = 2
    while cost > p:
        size = min(n, p + level - 1)
        share = p / size
        kept = max(0, int(p * share) - (p - len(costs)))
        estimate = float(costs[:kept].sum()) / share + size
        if estimate < cost:
            best, cost = (WHOLE if size == n else level), estimate
        if size == n:
            break
        level *= 2
    return best


_KNOWN = "kind int, doc long, c long, h long, df int, n int, level int, score double"


def _known(kind: int, rows: int, **columns: np.ndarray) -> pa.RecordBatch:
    types = {"kind": pa.int32(), "doc": pa.int64(), "c": pa.int64(), "h": pa.int64(), "df": pa.int32(), "n": pa.int32(), "level": pa.int32(), "score": pa.float64()}
    columns["kind"] = np.full(rows, kind)
    cells = [pa.array(columns[k].astype(t.to_pandas_dtype())) if k in columns else pa.nulls(rows, t) for k, t in types.items()]
    return pa.RecordBatch.from_arrays(cells, names=list(types))


def _describe(percent: int, choose: Callable[[np.ndarray, int, int], int]):
    """Kind 0: documents; 1: classes, with their first document and level; 2: shared elements of base prefixes."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, metas = unpack(batches, _SHARED, _META)
        if not len(metas):
            return
        yield _known(0, len(metas), doc=metas["doc"], c=metas["c"], n=metas["n"])
        metas = metas[metas["n"] > 0]
        metas = metas[np.lexsort((metas["doc"], metas["c"]))]
        one = metas[heads(metas["c"])]
        level, score = np.ones(len(one), np.int64), np.zeros(len(one))
        shared = shared[np.lexsort((shared["h"], shared["c"]))]
        if len(shared):
            first = np.flatnonzero(heads(shared["c"]))
            stop = np.append(first[1:], len(shared))
            own = np.searchsorted(one["c"], shared["c"][first])
            score[own] = np.add.reduceat(shared["df"].astype(float), first)
            costs = np.add.reduceat(shared["df"].astype(np.int64) - 1, first)
            for i in np.flatnonzero(costs > base(one["n"][own].astype(np.int64), percent)).tolist():
                level[own[i]] = choose(shared["df"][first[i] : stop[i]], int(one["n"][own[i]]), percent)
            row = np.repeat(own, stop - first)
            yield _known(2, len(shared), c=shared["c"], h=shared["h"], df=shared["df"], n=one["n"][row], level=level[row], score=score[row])
        yield _known(1, len(one), doc=one["doc"], c=one["c"], n=one["n"], level=level, score=score)

    return describe


def _send(dtype: np.dtype, by: str, count: int, kind: int = 0):
    """Rows with the columns of ``dtype``, packed by one of them."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(len(batch), dtype)
            for name in dtype.names:
                out[name] = batch.column(name).to_numpy(zero_copy_only=False)
            yield from pack(out, part_of(out[by], count), kind)

    return send


def _similar_size(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b).astype(np.int64) >= percent * np.maximum(a, b).astype(np.int64)


def _hubs(percent: int, count: int, turn: int):
    """Of each list and size the class with the most frequent elements, later of a fourth drawn by hash; to those of other groups.

    The classes of the hub's own group get the best one outside of it.
    """

    def hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (rows,) = unpack(batches, _SCORED)
        if not len(rows):
            return
        size = np.floor(np.log(rows["n"]) / np.log(100 / percent) + turn % 2 / 2) if percent < 100 else rows["n"]
        drawn = mix(rows["c"] ^ U(turn)) % U(4) == 0 if turn else np.zeros(len(rows), bool)
        order = np.lexsort((rows["c"], rows["score"], drawn, size, rows["h"]))
        rows, size = rows[order], size[order]
        new = heads(rows["h"], size)
        group = np.cumsum(new) - 1
        stop = np.append(np.flatnonzero(new)[1:], len(rows))
        hub = (stop - 1)[group]
        # The last row of each list that is not of the hub's group.
        at = np.where(rows["group"] != rows["group"][hub], np.arange(len(rows)), -1)
        other = np.maximum.reduceat(at, np.flatnonzero(new))[group]
        to = np.where(at >= 0, hub, other)
        take = to >= 0
        take &= _similar_size(rows["n"][to], rows["n"], percent)
        out = np.zeros(int(take.sum()), _HUB)
        out["c"], out["hub"], out["n"] = rows["c"][take], rows["c"][to[take]], rows["n"][take]
        yield from pack(out, part_of(out["c"], count))

    return hubs


def _best_hub(percent: int, least: int):
    """The hub that a class shares most lists with, if they are at least one in ``least`` of its prefix."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (rows,) = unpack(batches, _HUB)
        if not len(rows):
            return
        rows = rows[np.lexsort((rows["hub"], rows["c"]))]
        new = heads(rows["c"], rows["hub"])
        size = np.bincount(np.cumsum(new) - 1)
        rows = rows[new]
        order = np.lexsort((rows["hub"], -size, rows["c"]))
        rows, size = rows[order], size[order]
        take = heads(rows["c"]) & (least * size >= base(rows["n"].astype(np.int64), percent))
        yield pa.RecordBatch.from_arrays([pa.array(rows["c"][take].astype(np.int64)), pa.array(rows["hub"][take].astype(np.int64))], names=["x", "y"])

    return best


def _send_longer(size: int, percent: int, count: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, h, at, c in _sets(batches, size):
            rows = slice(lo, lo + len(c))
            n, level = np.diff(at), batch.column("level").to_numpy()[rows].astype(np.int64)
            right = c == batch.column("c").to_numpy()[rows].astype(np.uint64)
            row, rank = _rank(at)
            take = right[row] & (rank < prefix(n, level, percent)[row])
            row, rank = row[take], rank[take]
            out = np.zeros(len(row), _LONGER)
            out["h"], out["c"], out["n"], out["level"], out["rank"] = h[take], c[row], n[row], level[row], rank
            yield from pack(out, part_of(out["h"], count))

    return send


def _share_longer(count: int):
    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (rows,) = unpack(batches, _LONGER)
        if not len(rows):
            return
        rows = rows[np.lexsort((rows["c"], rows["h"]))]
        rows = rows[heads(rows["h"], rows["c"])]
        group = np.cumsum(heads(rows["h"])) - 1
        df = np.bincount(group)[group]
        rows = rows[df > 1].copy()
        rows["df"] = df[df > 1]
        yield from pack(rows, part_of(rows["c"], count))

    return share


def _group_of(c: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """The group of each class: its root, or itself without links."""
    if not len(roots):
        return c
    roots = roots[np.argsort(roots["c"])]
    at = np.minimum(np.searchsorted(roots["c"], c), len(roots) - 1)
    return np.where(roots["c"][at] == c, roots["root"][at], c)


def _score_longer(count: int):
    """The lists that lengthened classes stand in, with how frequent all elements of their longer prefixes are."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, roots = unpack(batches, _LONGER, _ROOT)
        if not len(rows):
            return
        rows = rows[np.lexsort((rows["h"], rows["c"]))]
        first = np.flatnonzero(heads(rows["c"]))
        out = np.zeros(len(rows), _SCORED)
        out["h"], out["c"], out["n"] = rows["h"], rows["c"], rows["n"]
        out["group"] = _group_of(rows["c"], roots)
        out["score"] = np.repeat(np.add.reduceat(rows["df"].astype(float), first), np.diff(np.append(first, len(rows))))
        yield from pack(out, part_of(out["h"], count))

    return score


def _look(percent: int, count: int):
    """The lists that lengthened classes stand in; a class looks up all of its elements but the most frequent l - 1."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, roots = unpack(batches, _LONGER, _ROOT)
        if not len(rows):
            return
        rows = rows[np.lexsort((rows["h"], rows["df"], rows["c"]))]
        first = np.flatnonzero(heads(rows["c"]))
        size = np.diff(np.append(first, len(rows)))
        n = rows["n"][first].astype(np.int64)
        p = base(n, percent)
        alone = prefix(n, rows["level"][first].astype(np.int64), percent) - size
        looked = np.clip(p - alone, 0, size)
        nth = np.arange(len(rows)) - np.repeat(first, size)
        out = np.zeros(len(rows), _MEMBER)
        for name in ("h", "c", "n", "level"):
            out[name] = rows[name]
        out["group"] = _group_of(rows["c"], roots)
        out["own"], out["drop"] = np.maximum(1, rows["rank"] - np.repeat(p, size) + 2), np.repeat(size - looked, size)
        out["looks"] = nth < np.repeat(looked, size)
        yield from pack(out, part_of(out["h"], count))

    return look


def _pairs_of(rows: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of rows a and b of one list that may link and that nothing connects yet."""
    x, y = rows[a], rows[b]
    lower = np.minimum(x["level"], y["level"])
    xs, ys = x["level"] == lower, y["level"] == lower
    take = (x["group"] != y["group"]) & _similar_size(x["n"], y["n"], percent)
    take &= (x["own"] <= lower) & (y["own"] <= lower)
    take &= (~xs | (x["looks"] == 1)) & (~ys | (y["looks"] == 1))
    x, y, lower, xs, ys = x[take], y[take], lower[take], xs[take], ys[take]
    out = np.zeros(len(x), _PAIR)
    swap = x["c"] > y["c"]
    out["x"], out["y"] = np.where(swap, y["c"], x["c"]), np.where(swap, x["c"], y["c"])
    out["gx"], out["gy"] = np.where(swap, y["group"], x["group"]), np.where(swap, x["group"], y["group"])
    out["nx"], out["ny"] = np.where(swap, y["n"], x["n"]), np.where(swap, x["n"], y["n"])
    out["level"], out["drop"] = lower, np.maximum(np.where(xs, x["drop"], 0), np.where(ys, y["drop"], 0))
    out["shared"] = 1
    return out


def _counted(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[np.lexsort((pairs["y"], pairs["x"]))]
    new = heads(pairs["x"], pairs["y"])
    out = pairs[new].copy()
    out["shared"] = np.bincount(np.cumsum(new) - 1, weights=pairs["shared"]).astype(np.int32) if len(pairs) else 0
    return out


def _pair_up(percent: int, count: int):
    def ragged(rows: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
        """All pairs of short lists, some lists at a time."""
        stop = np.repeat(first + size, size)
        a = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(stop))
        left = stop - a - 1
        done = 0
        total = np.cumsum(left)
        while done < len(a):
            to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + (1 << 20), "right")))
            n = left[done:to]
            x = np.repeat(a[done:to], n)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            yield _pairs_of(rows, x, y, percent)
            done = to

    def outsiders(rows: np.ndarray, first: int, size: int) -> Iterator[np.ndarray]:
        """What isn't in a long list's largest group, against the whole list."""
        member, looks = rows["group"][first : first + size], rows["looks"][first : first + size] == 1
        groups, n = np.unique(member, return_counts=True)
        out = np.flatnonzero(member != groups[np.argmax(n)])
        inside = np.ones(size, bool)
        inside[out] = False
        looking = np.flatnonzero(inside & looks)
        rank = np.full(size, size)
        rank[out] = np.arange(len(out))
        for i in out.tolist():
            # Of a pair at least one looks the element up.
            other = np.flatnonzero(inside | ~looks | (rank > rank[i])) if looks[i] else looking
            if len(other):
                yield _pairs_of(rows, np.full(len(other), first + i), first + other, percent)

    def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (rows,) = unpack(batches, _MEMBER)
        if not len(rows):
            return
        rows = rows[np.lexsort((rows["c"], rows["h"]))]
        first = np.flatnonzero(heads(rows["h"]))
        size = np.diff(np.append(first, len(rows)))
        mixed = np.add.reduceat(rows["group"] != rows["group"][np.repeat(first, size)], first) > 0
        mixed &= np.add.reduceat(rows["looks"].astype(np.int64), first) > 0
        held, n = [], 0

        def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            pairs = _counted(np.concatenate(held))
            yield from pack(pairs, part_of(mix(pairs["x"] ^ mix(pairs["y"])), count))

        def found() -> Iterator[np.ndarray]:
            short = mixed & (size <= SHORT)
            yield from ragged(rows, first[short], size[short])
            for i in np.flatnonzero(mixed & (size > SHORT)).tolist():
                yield from outsiders(rows, int(first[i]), int(size[i]))

        for pairs in found():
            held.append(pairs)
            n += len(pairs)
            if n >= FLUSH:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return pair_up


def _bounded(percent: int):
    """Pairs whose shared elements leave room for a link."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (pairs,) = unpack(batches, _PAIR)
        if not len(pairs):
            return
        pairs = _counted(pairs)
        nx, ny, level = (pairs[x].astype(np.int64) for x in ("nx", "ny", "level"))
        rest = np.maximum(nx - prefix(nx, level, percent), ny - prefix(ny, level, percent))
        least = (percent * (nx + ny) + 99 + percent) // (100 + percent)
        pairs = pairs[pairs["shared"] + pairs["drop"] + rest >= least]
        yield pa.RecordBatch.from_arrays([*(pa.array(pairs[x].astype(np.int64)) for x in ("x", "y", "gx", "gy")), pa.array(pairs["shared"])], names=["x", "y", "gx", "gy", "shared"])

    return bounded


def _give_sets(size: int):
    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, h, at, c in _sets(batches, size):
            right = np.flatnonzero(c == batch.column("c").to_numpy()[lo : lo + len(c)].astype(np.uint64))
            sets = pa.array([h[at[i] : at[i + 1]].tobytes() for i in right.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c[right].astype(np.int64)), sets], names=["c", "elements"])

    return give


def _compare(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take = []
            for a, b in zip(batch.column("ex"), batch.column("ey"), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                take.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["x", "y"]).filter(pa.array(take, pa.bool_()))

    return compare


class _Join:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, choose: Callable):
        if not 0 < percent <= 100 or size < 1:
            raise ValueError("percent must lie in 1..100 and size be positive")
        self.spark, self.size, self.percent = docs.sparkSession, size, percent
        self.count = parts(self.spark)
        small_batches(self.spark)
        text = F.col(f"`{text_col}`").cast("string").alias("text")
        self.docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), text).where("doc is not null")
        sent = arrow_map(self.docs, _send_base(size, percent, self.count), PACKED)
        shared = dealt(sent, _share(self.count), PACKED, self.count)
        known = saved(dealt(shared, _describe(percent, choose), _KNOWN, self.count), "classes")
        self.members = known.where("kind = 0").select("doc", "c", "n")
        self.classes = known.where("kind = 1").select("doc", "c", "n", "level")
        self.tokens = known.where("kind = 2").select("c", "h", "n", "level", "score")
        #: Parts that the shared elements need, of all that there are.
        self.filled = min(self.count, 1 + self.tokens.count() // FILL)

    def packed(self, rows: DataFrame, dtype: np.dtype, by: str, count: int, kind: int = 0) -> DataFrame:
        return arrow_map(rows.select(*dtype.names), _send(dtype, by, count, kind), PACKED)

    def texts_of(self, rows: DataFrame) -> DataFrame:
        """The text of the first document of each class of ``rows``, which has ``doc`` besides its other columns."""
        return self.docs.join(small_or_not(rows), "doc")

    def sets_of(self, pairs: DataFrame) -> DataFrame:
        """(c, elements) of the classes in pairs (x, y)."""
        wanted = pairs.select(F.col("x").alias("c")).union(pairs.select("y")).distinct()
        wanted = saved(self.classes.select("doc", "c").join(wanted, "c"), "wanted")
        sets = arrow_map(self.texts_of(wanted).select("text", "c"), _give_sets(self.size), "c long, elements binary").dropDuplicates(["c"])
        sets = saved(sets, "sets")
        discard(wanted)
        return sets

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of the pairs (x, y) of classes that link."""
        x, y = sets.select(F.col("c").alias("x"), F.col("elements").alias("ex")), sets.select(F.col("c").alias("y"), F.col("elements").alias("ey"))
        return saved(arrow_map(pairs.select("x", "y").join(x, "x").join(y, "y").select("x", "y", "ex", "ey"), _compare(self.percent), "x long, y long"), "links")

    def grouped(self, rows: DataFrame, roots: DataFrame | None) -> DataFrame:
        """Rows (c, ...) with the group of their class; classes without links are groups of their own."""
        if roots is None:
            return rows.withColumn("group", F.col("c"))
        return rows.join(roots, "c", "left").withColumn("group", F.coalesce("root", "c")).drop("root")

    def stars(self) -> tuple[DataFrame, DataFrame]:
        """Links with hubs, round after round while a fair part of what is compared links; and the groups they form."""
        links, roots, turn = None, None, 0
        while True:
            scored = self.packed(self.grouped(self.tokens, roots), _SCORED, "h", self.filled)
            new, tried, found = self.star(scored, turn, 2 if turn else 5, self.filled)
            if links is None or new:
                links = found if links is None else links.unionByName(found)
                roots = _roots(links)
            turn += 1
            if tried - new < LONE or turn == TURNS:
                return links, roots

    def star(self, scored: DataFrame, turn: int, least: int, count: int) -> tuple[int, int, DataFrame]:
        """How many classes link with the hub of the lists they stand in, how many were compared, and the links."""
        hubs = dealt(scored, _hubs(self.percent, count, turn), PACKED, count)
        pairs = saved(dealt(hubs, _best_hub(self.percent, least), "x long, y long", count), "stars")
        sets = self.sets_of(pairs)
        found = self.verified(pairs, sets)
        tried, new = pairs.count(), found.count()
        discard(pairs, sets)
        return new, tried, found

    def lengthened(self) -> DataFrame:
        """Shared elements of the prefixes that were lengthened, packed by class."""
        longer = saved(self.classes.where("level > 1").select("doc", "c", "level"), "longer")
        sent = arrow_map(self.texts_of(longer).select("text", "c", "level"), _send_longer(self.size, self.percent, self.count), PACKED)
        out = saved(dealt(sent, _share_longer(self.count), PACKED, self.count), "lengthened")
        discard(longer)
        return out

    def with_roots(self, lengthened: DataFrame, roots: DataFrame) -> DataFrame:
        return lengthened.unionByName(self.packed(roots, _ROOT, "c", self.count, 1))

    def center_stars(self, lengthened: DataFrame, links: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``links`` and ``roots`` after a round with hubs whose longer prefixes are the most frequent.

        Base prefixes don't tell a hub with edits from one without: what links only with the latter would otherwise
        stay a group of its own, and be a candidate of a large part of the group.
        """
        scored = dealt(self.with_roots(lengthened, roots), _score_longer(self.count), PACKED, self.count)
        new, _, found = self.star(scored, 0, 2, self.count)
        if not new:
            return links, roots
        links = links.unionByName(found)
        return links, _roots(links)

    def candidates(self, lengthened: DataFrame, roots: DataFrame) -> DataFrame:
        """(x, y, gx, gy, shared): pairs that may link, and the two groups that they are in."""
        far = dealt(self.with_roots(lengthened, roots), _look(self.percent, self.count), PACKED, self.count)
        near = self.tokens.select("c", "h", "n", "level", F.lit(1).alias("own"), F.lit(0).alias("drop"), F.when(F.col("level") == 1, 1).otherwise(0).alias("looks"))
        near = self.packed(self.grouped(near, small_or_not(roots)), _MEMBER, "h", self.filled)
        pairs = [dealt(lists, _pair_up(self.percent, self.count), PACKED, n) for lists, n in ((near, self.filled), (far, self.count))]
        return saved(dealt(pairs[0].unionByName(pairs[1]), _bounded(self.percent), "x long, y long, gx long, gy long, shared int", self.count), "pairs")

    def others(self, links: DataFrame, roots: DataFrame) -> DataFrame:
        """``links`` and what links the groups that they form."""
        lengthened = self.lengthened()
        links, roots = self.center_stars(lengthened, links, roots)
        pairs, each = self.candidates(lengthened, roots), 4
        discard(lengthened)
        left = pairs.count()
        sets = self.sets_of(pairs) if left else None
        while left > FEW:
            best = saved(_nearest(pairs, each), "nearest")
            found = self.verified(best, sets)
            links, tried, new = links.unionByName(found), best.count(), found.count()
            group = small_or_not(_roots(links))
            x, y = (group.select(F.col("c").alias(f"g{a}"), F.col("root").alias(f"r{a}")) for a in "xy")
            ends = pairs.select("gx", "gy").distinct().join(x, "gx", "left").join(y, "gy", "left")
            apart = saved(ends.withColumns({"rx": F.coalesce("rx", "gx"), "ry": F.coalesce("ry", "gy")}).where("rx <> ry"), "apart")
            rest = pairs.join(apart, ["gx", "gy"]).join(best, ["x", "y"], "left_anti")
            rest = saved(rest.select("x", "y", F.col("rx").alias("gx"), F.col("ry").alias("gy"), "shared"), "pairs")
            discard(pairs, best, apart)
            pairs, left, each = rest, rest.count(), 4 * each
            if not new or left < FAIR * tried:
                break
        return links.unionByName(self.verified(pairs, sets)) if left else links


def _roots(links: DataFrame) -> DataFrame:
    return components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("c"), "root")


def _nearest(pairs: DataFrame, each: int) -> DataFrame:
    """(x, y): of each group the pairs with most shared elements, about ``each``; by maxima in each task, not a sort."""
    rows = pairs.select(F.col("gx").alias("g"), "x", "y", "shared").unionByName(pairs.select(F.col("gy").alias("g"), "x", "y", "shared"))
    best = rows.groupBy("g", F.pmod(F.xxhash64("x", "y"), F.lit(each)).alias("nth")).agg(F.max(F.struct("shared", "x", "y")).alias("best"))
    return best.select("best.x", "best.y").distinct()


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, percent: int = PERCENT, choose: Callable[[np.ndarray, int, int], int] = choose_level
) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row; n_links: verified links of its set with other sets.

    ``n_links`` counts the links that were verified: enough to connect every group, not all within one.  ``choose``
    gives a class's l from the frequencies of its shared base elements, its size and ``percent``; any choice of
    1, 2, 4, ... or WHOLE gives the same groups.
    """
    join = _Join(docs, id_col, text_col, size, percent, choose)
    links = join.others(*join.stars())
    roots = _roots(links)
    ends = links.select(F.col("x").alias("c")).union(links.select("y")).groupBy("c").agg(F.count("*").alias("n_links"))
    grouped = saved(join.classes.select("c", "doc").join(roots.join(ends, "c"), "c"), "grouped")
    least = grouped.groupBy("root").agg(F.min("doc").alias("least"))
    grouped = grouped.join(least, "root").select("c", "least", "n_links")
    first = join.classes.select("c", F.col("doc").alias("first"))
    empty = F.col("n") == 0
    named = join.members.join(first, "c", "left").join(grouped, "c", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
        F.when(empty, F.col("doc")).otherwise(F.coalesce("least", "first")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    unnamed = docs.where(F.col(f"`{id_col}`").isNull()).select(F.col(f"`{text_col}`").cast("string").alias("text"))
    unnamed = arrow_map(unnamed, _sizes(size), "n_shingles long").select(
        F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(0).cast("long").alias("n_links")
    )
    return named.unionByName(unnamed)


def _sizes(size: int):
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, at, _ in _sets(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(at))], names=["n_shingles"])

    return sizes
