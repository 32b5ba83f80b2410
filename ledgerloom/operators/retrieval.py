"""Chunking, lexical and vector retrieval, rank fusion, and their evaluation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW, OVERLAP, FUSION = 350, 60, 60
K1, B = 1.2, 0.75
#: Queries that one pass over the documents answers; (document, query) cells and bytes of text that a task scores at a time.
BLOCK, CELLS, BYTES = 1024, 1 << 20, 1 << 22
#: Vectors in a packed row, vectors that a task compares with a block of queries, and blocks whose best rows a task holds.
PACK, GROUP, HELD = 2048, 1 << 14, 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123)]] = True


def tokens(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, one after the other; how many each text has): runs of ASCII letters and digits, A-Z lower-cased."""
    text = pc.fill_null(text.cast(pa.large_binary()), b"")
    if not len(text):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    data = _LOWER[np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    inside = _ALNUM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = inside[heads]
    start = np.flatnonzero(begins)
    letters = data[inside]
    ends = np.append((np.cumsum(inside) - 1)[start], len(letters)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(letters))
    return words, np.diff(np.searchsorted(start, offsets))


def fixed_chunks(docs: DataFrame, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Windows of ``size`` words, each sharing ``overlap`` with the next; generated within the scan's stage."""
    words = F.filter(F.split(F.trim("text"), r"[ \t\n\r]+"), lambda x: x != "")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size("words") - overlap) / step).cast("int") - 1)
    rows = docs.select("doc_id", words.alias("words")).where(F.size("words") > 0)
    rows = rows.select("doc_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    part = F.slice("words", F.col("chunk_no") * step + 1, F.lit(size))
    return rows.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.size(part).cast("long").alias("n_words"), F.array_join(part, " ").alias("text"))


def with_context(chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """Chunks with their document's title in front, for the index only."""
    return chunks.join(titles, "doc_id").select("doc_id", "chunk_no", F.concat_ws("\n", "title", "text").alias("indexed"))


def lexical_top(docs: DataFrame, queries: DataFrame, k: int, rankings: tuple[str, ...] = ("bm25",)) -> DataFrame:
    """(ranking, query_id, doc_id, score, rank): the k best documents of each query that share a term with it.

    ``rankings``: `bm25`, and `overlap`, the number of distinct query terms; any of them come from one scoring.  The
    queries, a stated set, are taken in blocks of ``BLOCK``.  Documents are read twice a block, once to count in how
    many each query term is, and nothing of them is shuffled: a task scores its documents in chunks of ``CELLS`` and
    keeps k rows of each query, so what is shuffled is queries x tasks x k.
    """
    words = docs.select("doc_id", "text")
    asked = queries.select("query_id", "text").orderBy("query_id")
    out = None
    for lo in range(0, max(asked.count(), 1), BLOCK):
        own = asked.offset(lo).limit(BLOCK).collect()
        names = np.array([r.query_id for r in own], object)
        sought, many = tokens(pa.array([r.text for r in own], pa.string()))
        terms = pc.unique(sought)
        # (term, query), sorted, once each.
        pairs = np.unique(np.stack([pc.index_in(sought, value_set=terms).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(own)), many)], axis=1).astype(np.int64), axis=0)
        df, n, mean = _document_frequencies(words, terms)
        score = _score(names, terms, pairs, np.log(1 + (n - df + 0.5) / (df + 0.5)), mean, k, rankings)
        part = words.mapInArrow(score, "ranking string, query_id string, doc_id long, score double")
        part = part.withColumn("query_id", F.col("query_id").cast(queries.schema["query_id"].dataType))
        out = part if out is None else out.unionByName(part)
    return top(out, k, "ranking")


def _found(batch: pa.RecordBatch, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term) of every word of the batch that is a query term, and the rows' lengths."""
    words, lengths = tokens(batch.column("text"))
    term = pc.fill_null(pc.index_in(words, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(batch)), lengths)
    return row[term >= 0], term[term >= 0], lengths


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Rows that have at most ``BYTES`` of text together, or one longer text."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    end, lo = np.cumsum(size, dtype=np.int64), 0
    while lo < len(end):
        hi = int(np.searchsorted(end, end[lo] - size[lo] + BYTES, "right"))
        hi = min(lo + rows, max(lo + 1, hi))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _document_frequencies(words: DataFrame, terms: pa.Array) -> tuple[np.ndarray, int, float]:
    """(documents that hold each term, all documents, mean words of those with a text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(len(terms), np.int64), np.zeros(3, np.int64)
        for batch in (x for whole in batches for x in _slices(whole, CELLS)):
            row, term, lengths = _found(batch, terms)
            df += np.bincount(np.unique(row * len(terms) + term) % max(1, len(terms)), minlength=len(terms))
            total += (len(batch), len(batch) - batch.column("text").null_count, lengths.sum())
        ids = np.append(np.flatnonzero(df), [-1, -2, -3])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.append(df[df > 0], total))], names=["term", "n"])

    found = {r.term: r.n for r in words.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    df = np.array([found.get(i, 0) for i in range(len(terms))], np.int64)
    return df, found.get(-1, 0), found.get(-3, 0) / max(1, found.get(-2, 0))


def _score(names: np.ndarray, terms: pa.Array, pairs: np.ndarray, idf: np.ndarray, mean: float, k: int, rankings: tuple[str, ...]):
    """``pairs``: (term, query), by term.  A posting adds its weight to every query that has its term."""
    first = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))
    many, width = np.diff(first), len(names)

    def chunk(row: np.ndarray, term: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
        posting, tf = np.unique(row * len(terms) + term, return_counts=True)
        row, term = posting // len(terms), posting % len(terms)
        weight = idf[term] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / mean)))
        size = many[term]
        query = pairs[np.repeat(first[term] - (np.cumsum(size) - size), size) + np.arange(size.sum()), 1]
        cell = np.repeat(row, size) * width + query
        weights = {"bm25": np.repeat(weight, size), "overlap": None}
        # Rounded before ranking, so engines that add in another order rank alike.
        sums = {r: np.round(np.bincount(cell, weights[r], len(lengths) * width), 4).reshape(-1, width) for r in rankings}
        shared = np.bincount(cell, minlength=len(lengths) * width).reshape(-1, width) > 0
        return {r: np.where(shared, x, -np.inf) for r, x in sums.items()}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {r: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for r in rankings}
        for batch in (x for whole in batches for x in _slices(whole, max(1, CELLS // max(1, width)))):
            if not width:
                continue
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for ranking, cells in chunk(*_found(batch, terms)).items():
                least = np.partition(cells, -k, axis=0)[-k] if len(cells) > k else np.full(width, -np.inf)
                at, query = np.nonzero((cells >= least) & (cells > -np.inf))
                query, doc, value = (np.concatenate(x) for x in zip(best[ranking], (query, ids[at], cells[at, query]), strict=True))
                order = np.lexsort((doc, -value, query))
                query, doc, value = query[order], doc[order], value[order]
                keep = np.arange(len(query)) - np.searchsorted(query, query) < k
                best[ranking] = query[keep], doc[keep], value[keep]
        for ranking, (query, doc, value) in best.items():
            columns = [pa.array([ranking] * len(query), pa.string()), pa.array([str(names[q]) for q in query], pa.string()), pa.array(doc), pa.array(value)]
            yield pa.RecordBatch.from_arrays(columns, names=["ranking", "query_id", "doc_id", "score"])

    return score


def top(scores: DataFrame, k: int, *within: str) -> DataFrame:
    """The k best of each query with their rank; Spark keeps only k rows a partition before it shuffles."""
    order = Window.partitionBy(*within, "query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def fuse(rankings: DataFrame, k: int = FUSION) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, doc_id, rank), one after the other in one table: a sum, no join."""
    return rankings.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 8).alias("score"))


def vector_top(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(query_id, doc_id, score, rank) by exact cosine, without the query itself.

    All pairs, so the work is the product of both tables.  Both are packed, ``block`` queries and up to ``PACK`` vectors in
    a row, and every task compares some ``GROUP`` vectors with one block or two: nothing is collected, and a task holds
    two packed rows, ``CELLS`` scores and k rows of each query of a few blocks.  Shuffled are the packed vectors once for
    each block, and k rows of each query for each group.  Vectors that are null, empty or infinite have no cosine.
    """
    return compared(packed(vectors, "vec_id"), vectors.count(), queries, k, block)


def packed(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """(ids, units and ints of the columns ``more`` of up to ``PACK`` vectors in a row), as they follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), PACK):
                part = batch.slice(lo, PACK)
                units = _unit(dense(part.column("embedding")))
                has = np.isfinite(units).all(axis=1)
                ids, *own = (part.column(c).to_numpy(zero_copy_only=False)[has] for c in ("id", *more))
                cells = [ids.astype(np.int64).tobytes(), units[has].tobytes(), *(x.astype(np.int32).tobytes() for x in own)]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in cells], names=["ids", "units", *more])

    usable = rows.where(f"size(embedding) > 0 and {key} is not null").select(F.col(key).cast("long").alias("id"), "embedding", *more)
    return usable.mapInArrow(run, ", ".join(f"{c} binary" for c in ("ids", "units", *more)))


def dense(vectors: pa.Array) -> np.ndarray:
    """Vectors of one width as a matrix."""
    wide = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if len(wide) > 1:
        raise ValueError(f"vectors of different widths: {sorted(wide)}")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), *wide or [0])


def compared(packs: DataFrame, count: int, queries: DataFrame, k: int, block: int, choose: Callable | None = None) -> DataFrame:
    """The k best of each query in ``packs`` of some ``count`` vectors, by a cartesian product of packed rows.

    ``choose``: from a block's matrix of queries, which of them are compared with what value of the column ``own``.
    """
    size = math.ceil(queries.count() / block) or 1
    # Packed again as a whole, so a block is full however many files the queries come from.
    asked = packed(queries.select("query_id", "embedding").repartition(size), "query_id").toDF("names", "matrix").repartition(size)
    pairs = packs.repartition(math.ceil(count / GROUP) or 1).hint("shuffle_replicate_nl").crossJoin(asked)
    return top(pairs.mapInArrow(_nearest(k, choose), "query_id long, doc_id long, score double"), k)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


class _Best:
    """The k best of each query of a block so far, by score, then by id."""

    def __init__(self, names: np.ndarray, matrix: np.ndarray, k: int):
        self.names, self.matrix, self.k = names, matrix, k
        self.score, self.id = np.full((len(names), k), -np.inf), np.full((len(names), k), np.iinfo(np.int64).max)

    def offer(self, asking: np.ndarray, ids: np.ndarray, units: np.ndarray) -> None:
        """Compares the queries at ``asking`` with vectors, ``CELLS`` scores at a time."""
        size = max(1, CELLS // max(1, len(asking)))
        matrix = self.matrix if len(asking) == len(self.names) else self.matrix[asking]
        for lo in range(0, len(ids) if len(asking) else 0, size):
            self._take(asking, ids[lo : lo + size], matrix @ units[lo : lo + size].T)

    def _take(self, asking: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        # What can't come among the best once it's rounded goes first; of the rest, what its own k + 1 best exclude.
        near = score >= self.score[asking, -1:] - 2e-6
        if score.shape[1] > self.k + 1 and np.count_nonzero(near) > 4 * self.k * len(asking):
            near &= score >= np.partition(score, -self.k - 1, axis=1)[:, [-self.k - 1]] - 2e-6
        query, at = np.nonzero(near)
        # Rounded before ranking, so engines that add in another order rank alike.
        value, query, doc = np.round(score[query, at], 6), asking[query], ids[at]
        least = self.score[query, -1]
        keep = (doc != self.names[query]) & ((value > least) | ((value == least) & (doc < self.id[query, -1])))
        value, query, doc = value[keep], query[keep], doc[keep]
        own = np.unique(query)
        query = np.append(query, np.repeat(own, self.k))
        value, doc = np.append(value, self.score[own]), np.append(doc, self.id[own])
        order = np.lexsort((doc, -value, query))
        query, value, doc = query[order], value[order], doc[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.score[own], self.id[own] = value[keep].reshape(-1, self.k), doc[keep].reshape(-1, self.k)

    def rows(self) -> pa.RecordBatch:
        keep = self.score > -np.inf
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.names, keep.sum(axis=1))), pa.array(self.id[keep]), pa.array(self.score[keep])], names=["query_id", "doc_id", "score"])


def _nearest(k: int, choose: Callable | None):
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[_Best, Callable | None]] = {}
        for batch in batches:
            for at in range(len(batch)):
                row = {name: batch.column(name)[at].as_buffer() for name in batch.schema.names}
                block, ids = row["names"].to_pybytes(), np.frombuffer(row["ids"], np.int64)
                if not block or not len(ids):
                    continue
                if block not in held:
                    if len(held) == HELD:
                        yield held.pop(next(iter(held)))[0].rows()
                    names = np.frombuffer(block, np.int64)
                    matrix = np.frombuffer(row["matrix"], float).reshape(len(names), -1).copy()
                    held[block] = _Best(names, matrix, k), choose and choose(matrix)
                best, chosen = held[block]
                units = np.frombuffer(row["units"], float).reshape(len(ids), -1)
                if chosen is None:
                    best.offer(np.arange(len(best.names)), ids, units)
                    continue
                own = np.frombuffer(row["own"], np.int32)
                order = np.argsort(own, kind="stable")
                for same in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                    best.offer(chosen(own[same[0]]), ids[same], units[same])
        for best, _ in held.values():
            yield best.rows()

    return nearest


def quality(ranked: DataFrame, relevant: DataFrame, cutoff: int = 5) -> DataFrame:
    """Per query: hit at 1 and at ``cutoff``, reciprocal rank, nDCG; ``relevant`` (query_id, doc_id) in binary grades."""
    hits = ranked.join(relevant.withColumn("hit", F.lit(True)), ["query_id", "doc_id"], "left")
    return _measures(hits, relevant.groupBy("query_id").agg(F.count("*").alias("n")), cutoff)


def label_quality(ranked: DataFrame, labels: DataFrame, queries: DataFrame, cutoff: int = 5) -> DataFrame:
    """``quality`` where those of a query's label are relevant, without the query itself; (doc_id, label), (query_id, label).

    The pairs of a label, the square of how many have it, are never made: labels are compared where something is ranked,
    and how many are relevant is a count of the label.
    """
    found = labels.select("doc_id", F.col("label").alias("found")).distinct()
    asked = queries.select("query_id", "label").distinct()
    # Few rows of a query, and a row of each document: neither side has a key with many rows.
    hits = ranked.join(found, "doc_id").join(asked, "query_id").withColumn("hit", F.col("found") == F.col("label"))
    many = labels.groupBy("label").agg(F.count("*").alias("many"))
    own = asked.join(labels.groupBy(F.col("doc_id").alias("query_id"), "label").agg(F.count("*").alias("own")), ["query_id", "label"], "left")
    ideal = own.join(many, "label").select("query_id", (F.col("many") - F.coalesce("own", F.lit(0))).alias("n")).where("n > 0")
    return _measures(hits, ideal, cutoff)


def _measures(hits: DataFrame, ideal: DataFrame, cutoff: int) -> DataFrame:
    """``hits``: ranked rows with their ``hit``; ``ideal``: (query_id, n), how many are relevant, of the queries that have any."""
    gain = F.when(F.col("hit"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    found = hits.groupBy("query_id").agg(
        F.max(F.when(F.col("hit") & (F.col("rank") <= 1), 1).otherwise(0)).alias("hit_1"), F.max(F.when(F.col("hit") & (F.col("rank") <= cutoff), 1).otherwise(0)).alias("hit_k"),
        F.coalesce(F.max(F.when(F.col("hit"), 1 / F.col("rank"))), F.lit(0.0)).alias("rr"), F.sum(F.when(F.col("rank") <= cutoff, gain).otherwise(0.0)).alias("dcg"),
    )
    ideal = ideal.select("query_id", F.least("n", F.lit(cutoff)).cast("int").alias("m"))
    best = F.aggregate(F.sequence(F.lit(1), F.col("m")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return found.join(ideal, "query_id").select("query_id", "hit_1", "hit_k", F.round("rr", 6).alias("rr"), F.round(F.col("dcg") / best, 6).alias("ndcg"))


def paired(a: DataFrame, b: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, wins, ties, losses, mean_a, mean_b) of ranking a against b by reciprocal rank; both as ``quality`` gives them.

    A query that only one of them has counts with 0 for the other.
    """
    both = a.select("query_id", F.col("rr").alias("a")).join(b.select("query_id", F.col("rr").alias("b")), "query_id", "full_outer")
    x, y = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    rows = both.join(categories, "query_id").select("category", x.alias("a"), y.alias("b"))
    times = [F.count(F.when(c, 1)).alias(name) for c, name in ((F.col("a") > F.col("b"), "wins"), (F.col("a") == F.col("b"), "ties"), (F.col("a") < F.col("b"), "losses"))]
    return rows.groupBy("category").agg(*times, F.round(F.avg("a"), 5).alias("mean_a"), F.round(F.avg("b"), 5).alias("mean_b"))


def invalid_citations(rankings: DataFrame, cited: str, retrieved: str) -> DataFrame:
    """What one ranking (ranking, query_id, doc_id) cites and the other has not retrieved."""
    has = lambda name: F.bool_or(F.col("ranking") == name)
    return rankings.groupBy("query_id", "doc_id").agg(has(cited).alias("cited"), has(retrieved).alias("retrieved")).where("cited and not retrieved").select("query_id", "doc_id")


def answer_decision(score: Column, answer: float, clarify: float) -> Column:
    return F.when(score >= answer, "answer").when(score >= clarify, "clarify").otherwise("abstain")
