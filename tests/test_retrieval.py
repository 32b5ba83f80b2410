import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import retrieval as R


@pytest.fixture
def peaks(spark, monkeypatch, tmp_path):
    """MB that each run of an Arrow function in a Python worker has allocated at most."""
    frame = type(spark.range(0))
    plain = frame.mapInArrow

    def traced(self, f, schema, *rest, **more):
        def run(batches):
            import tracemalloc

            tracemalloc.start()
            before = pa.total_allocated_bytes()
            yield from f(batches)
            peak = tracemalloc.get_traced_memory()[1] + max(0, pa.total_allocated_bytes() - before)
            tracemalloc.stop()
            (tmp_path / uuid.uuid4().hex).write_text(str(peak / 1e6))

        return plain(self, run, schema, *rest, **more)

    monkeypatch.setattr(frame, "mapInArrow", traced)
    return lambda: [float(p.read_text()) for p in tmp_path.iterdir()]


def brute(ids, m, asked, k):
    with np.errstate(invalid="ignore"):
        unit = np.nan_to_num(m / np.sqrt((m * m).sum(axis=1, keepdims=True)))
    score = np.round(unit[asked] @ unit.T, 6)
    out = set()
    for q, line in zip(ids[asked], score, strict=True):
        order = [i for i in np.lexsort((ids, -line)) if ids[i] != q][:k]
        out |= {(int(q), int(ids[i]), rank) for rank, i in enumerate(order, 1)}
    return out


def test_exact_search_holds_few_scores_at_a_time(spark, peaks):
    m = np.random.default_rng(5).integers(-2, 3, (20_000, 4)).astype(float)
    table = spark.createDataFrame([(i, x) for i, x in enumerate(m.tolist())], "vec_id long, embedding array<float>").coalesce(1)
    asked = table.where("vec_id % 20 < 2").select(F.col("vec_id").alias("query_id"), "embedding")
    found = R.vector_top(table, asked, 3).collect()
    assert len(found) == 6000 and max(peaks()) < 120
    some = np.arange(0, 20_000, 2000)
    assert {(r.query_id, r.doc_id, r.rank) for r in found if r.query_id in some} == brute(np.arange(20_000), m, some, 3)


@pytest.mark.parametrize("block", [1, 7, 2048])
def test_exact_search_in_packs(spark, monkeypatch, block):
    for name, value in (("PACK", 16), ("GROUP", 40), ("HELD", 2), ("CELLS", 30)):
        monkeypatch.setattr(R, name, value)
    m = np.random.default_rng(block).integers(-1, 2, (150, 3)).astype(float)
    ids = np.random.default_rng(1).permutation(150)
    table = spark.createDataFrame([(int(i), x) for i, x in zip(ids, m.tolist(), strict=True)], "vec_id long, embedding array<float>").repartition(3)
    got = R.vector_top(table, table.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5, block)
    assert {(r.query_id, r.doc_id, r.rank) for r in got.collect()} == brute(ids, m, np.flatnonzero(ids % 4 == 0), 5)


def test_exact_search_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [float("inf"), 1.0]), (None, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = table.select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r.doc_id, r.score) for r in R.vector_top(table, asked, 5).collect()}
    assert got == {(1, 2, 1.0), (2, 1, 1.0), (1, 3, 0.0), (2, 3, 0.0), (3, 1, 0.0), (3, 2, 0.0)}
    assert R.vector_top(table.limit(0), asked, 5).collect() == R.vector_top(table, asked.limit(0), 5).collect() == []
    wide = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="different widths"):
        R.vector_top(wide, wide.select(F.col("vec_id").alias("query_id"), "embedding"), 1).collect()


def test_relevance_by_label_makes_no_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist(), None if i % 9 == 0 else 7 if i == 5 else int(rng.integers(3))) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    asked = table.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    ranked = R.vector_top(table, asked, 5)
    pairs = asked.select("query_id", "label").join(table.select("vec_id", "label"), "label").where("vec_id <> query_id").select("query_id", F.col("vec_id").alias("doc_id"))
    by_pairs = sorted(map(tuple, R.quality(ranked, pairs).collect()))
    by_label = R.label_quality(ranked, table.select(F.col("vec_id").alias("doc_id"), "label"), asked)
    assert sorted(map(tuple, by_label.collect())) == by_pairs and 5 not in [x[0] for x in by_pairs]


@pytest.mark.parametrize("name", ["recall_mrr_ndcg", "paired_comparison"])
def test_labels_meet_their_counts_only(spark, sf, name):
    from ledgerloom.plans.queries import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    by_label = [x for x in plan if "Join Inner" in x and "(label#" in x]
    assert by_label and all("many#" in x for x in by_label)


def test_cells_are_searched_in_packs(spark, peaks, monkeypatch):
    from ledgerloom.operators import vector_index as V

    rng = np.random.default_rng(4)
    heart = rng.normal(size=(4, 4))
    m = [(i, (heart[i % 4] + 0.1 * rng.normal(size=4)).tolist()) for i in range(20_000)]
    table = spark.createDataFrame(m, "vec_id long, embedding array<float>").coalesce(1)
    asked = table.where("vec_id % 20 < 2").select(F.col("vec_id").alias("query_id"), "embedding")
    centres = V.fit(table, sample=200, centres=4)
    index, exact = V.assign(table, centres), R.vector_top(table, asked, 3).persist()
    searches = []
    monkeypatch.setattr(V, "compared", lambda *a: searches.append(a) or R.compared(*a))
    visits = V.visits_for(index, centres, asked, exact, 3)
    assert not searches and visits < 4
    found = V.recall(V.search(index, centres, asked, 3, visits), exact).head()
    assert found.n == 6000 and found.recall >= 0.95 and max(peaks()) < 120
    exact.unpersist()


def test_places_tell_the_recall_that_a_search_has(spark):
    from ledgerloom.operators import vector_index as V

    rng = np.random.default_rng(6)
    table = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(400)], "vec_id long, embedding array<float>").repartition(3)
    asked = table.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    centres, exact = V.fit(table), R.vector_top(table, asked, 4).persist()
    index = V.assign(table, centres)
    searched = [V.recall(V.search(index, centres, asked, 4, n), exact).head().recall for n in (5, 10, 15)]
    for n, least in zip((5, 10, 15), searched, strict=True):
        assert V.visits_for(index, centres, asked, exact, 4, least) <= n
    assert searched[0] < 1 and V.visits_for(index, centres, asked, exact, 4, searched[0] + 1e-6) == 10 and len(centres) == 20
    exact.unpersist()


@pytest.mark.parametrize("name", ["document_blocks", "structure_chunks"])
def test_blocks_go_on_before_many_long_texts_are_held(spark, peaks, name):
    from ledgerloom.operators import chunking as K

    line = F.concat(F.lit("# h"), F.col("id").cast("string"), F.repeat(F.lit(" word"), 200), F.lit("\n"))
    docs = spark.range(0, 1500, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(line, 20).alias("text"))
    rows = getattr(K, name)(docs).groupBy().agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.sum("length").alias("size"))
    assert tuple(rows.head()) == (30_000, 1500, 20 * sum(1003 + len(str(i)) for i in range(1500)))
    assert max(peaks()) < 75
