import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import retrieval as R
from ledgerloom.operators import vector_index as V


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    heart = rng.normal(size=(12, 16))
    rows = [(i, (heart[i % 12] + 0.1 * rng.normal(size=16)).tolist()) for i in range(600)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


def asked(vectors):
    return vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def test_finds_neighbours_of_clusters_in_few_cells(clustered):
    centres, exact = V.fit(clustered), R.vector_top(clustered, asked(clustered), 5)
    index = V.assign(clustered, centres)
    assert index.count() == 600
    visits = V.visits_for(index, centres, asked(clustered), exact, 5)
    assert visits <= len(centres) // 2
    got = V.recall(V.search(index, centres, asked(clustered), 5, visits), exact).head()
    assert got.n == 150 and got.recall >= 0.95


def test_all_cells_are_the_exact_search(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    centres = V.fit(v)
    found = V.search(V.assign(v, centres), centres, asked(v), 5, len(centres))
    plain = lambda df: sorted((r.query_id, r.rank, r.doc_id) for r in df.collect())
    assert plain(found) == plain(R.vector_top(v, asked(v), 5))


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").where("vec_id < 10")
    centres = V.fit(v.where("vec_id < 4"))
    q = spark.createDataFrame([(1, [1.0, 0.0]), (9, None)], "query_id long, embedding array<float>")
    found = V.search(V.assign(v, centres), centres, q, 2, len(centres))
    assert [(r.query_id, r.doc_id, r.rank) for r in found.orderBy("rank").collect()] == [(1, 2, 1), (1, 3, 2)]
    assert V.search(V.assign(v.limit(0), centres), centres, q, 2, 1).count() == 0
