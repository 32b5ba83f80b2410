"""Approximate nearest vectors: cells around centres, of which a query visits a few.

The centres are fitted on a bounded sample of vectors; every vector is assigned to a cell and stored.  Within the cells
that are visited the search is exact, so recall is lost only where a neighbour lies in a cell that isn't visited.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import GROUP, PACK, _unit, compared, dense, packed

#: The most vectors that the centres are fitted on, and the most centres; their product with the width bounds the driver.
SAMPLE, CENTRES = 20_000, 1024


def fit(vectors: DataFrame, sample: int = SAMPLE, centres: int | None = None, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Unit centres by spherical k-means on the ``sample`` vectors of the least hashed ids, so the sample is repeatable."""
    usable = vectors.where("size(embedding) > 0").select("vec_id", "embedding")
    rows = usable.orderBy(F.xxhash64(F.col("vec_id"), F.lit(seed)), "vec_id").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    m = _unit(np.array([r.embedding for r in rows], float))
    count = min(len(m), CENTRES, centres or max(1, round(math.sqrt(len(m)))))
    own = m[np.random.default_rng(seed).choice(len(m), count, replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(m @ own.T, axis=1)
        total = np.zeros_like(own)
        np.add.at(total, nearest, m)
        empty = np.bincount(nearest, minlength=count) == 0
        own = np.where(empty[:, None], own, _unit(total))
    return own


def assign(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(cell, vec_id, unit) of every vector; those that are null or empty are in no cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in _slices(whole)):
            m = _unit(dense(batch.column("embedding")))
            cell = np.argmax(m @ centres.T, axis=1).astype(np.int32)
            units = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("vec_id"), units], names=["cell", "vec_id", "unit"])

    usable = vectors.where("size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return usable.mapInArrow(run, "cell int, vec_id long, unit array<double>")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    yield from (batch.slice(lo, PACK) for lo in range(0, len(batch), PACK))


def _order(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The cells of each vector, nearest first."""
    return np.argsort(-(m @ centres.T), axis=1, kind="stable")


def search(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, visits: int, block: int = 2048) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best in the ``visits`` cells nearest to each query, without the query itself.

    Vectors are packed by cell, and a task compares each pack of its group with those queries of a block that visit the
    pack's cells, as ``vector_top`` does: no cell, however large, meets in one task, and no query is collected.
    ``visits`` as large as the number of centres is an exact search.
    """
    count = index.count()
    # By range of (cell, id): a pack has few cells, and a large cell is in many packs.
    own = index.select(F.col("cell").alias("own"), "vec_id", F.col("unit").alias("embedding")).repartitionByRange(math.ceil(count / GROUP) or 1, "own", "vec_id").sortWithinPartitions("own", "vec_id")

    def choose(matrix: np.ndarray) -> Callable[[int], np.ndarray]:
        visited = np.zeros((len(centres), len(matrix)), bool)
        visited[_order(matrix, centres)[:, :visits].T, np.arange(len(matrix))] = True
        return lambda cell: np.flatnonzero(visited[cell])

    return compared(packed(own, "vec_id", "own"), count, queries, k, block, choose)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n, recall): the share of the exact neighbours that were found."""
    hits = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return hits.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


def visits_for(index: DataFrame, centres: np.ndarray, trial: DataFrame, exact: DataFrame, k: int, least: float = 0.95) -> int:
    """The fewest cells, of an eighth of them, a quarter, a half, three quarters and all, that find ``least`` of ``exact``.

    Measured on the trial queries; vectors without clusters need many cells, in the end all, which is the exact search.
    The search within cells is exact, so it finds what lies in a visited cell: where the cell of each exact neighbour
    stands among its query's cells tells the recall of any number of visits, without a search.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in _slices(whole)):
            near = _order(_unit(dense(batch.column("embedding"))), centres)
            at = np.argmax(near == batch.column("cell").to_numpy()[:, None], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    asked = trial.where("size(embedding) > 0").select("query_id", "embedding")
    pairs = exact.where(F.col("rank") <= k).select("query_id", F.col("doc_id").alias("vec_id"))
    placed = pairs.join(index.select("vec_id", "cell"), "vec_id").join(asked, "query_id").select("cell", "embedding").mapInArrow(place, "at long")
    shares = [max(1, math.ceil(share * len(centres))) for share in (0.125, 0.25, 0.5, 0.75)]
    total = pairs.count()
    found = placed.agg(*(F.count(F.when(F.col("at") < visits, 1)).alias(str(i)) for i, visits in enumerate(shares))).head()
    return next((visits for i, visits in enumerate(shares) if not total or round(found[i] / total, 6) >= least), max(1, len(centres)))
