import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import changes as C
from ledgerloom.operators import chunking as K
from ledgerloom.operators import documents as D
from ledgerloom.operators import tenancy as T
from ledgerloom.operators import usage as G
from ledgerloom.sources.snapshots import AppendLog, SnapshotTable


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_insert_refuses_keys_that_are_there_or_repeat(spark):
    have = spark.createDataFrame([(1, "a"), (2, None)], "id long, key string")
    new = spark.createDataFrame([(3, "a"), (5, "b"), (4, "b"), (6, None), (7, None)], "id long, key string")
    after, refused = C.inserted(have, new, ["key"], "id")
    assert rows(after) == [(1, "a"), (2, None), (4, "b"), (6, None), (7, None)]
    assert rows(refused) == [(3, "a"), (5, "b")]
    assert rows(C.inserted(have.limit(0), new.limit(0), ["key"], "id")[0]) == []


def test_update_and_delete_leave_rows_of_unknown_condition(spark):
    have = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "id long, v int")
    after, changed = C.updated(have, F.col("v") > 6, {"v": F.col("v") + 1})
    assert rows(after) == [(1, 5), (2, None), (3, 10)] and rows(changed) == [(3, 10)]
    kept, gone = C.deleted(have, F.col("v") > 6)
    assert rows(kept) == [(1, 5), (2, None)] and rows(gone) == [(3, 9)]


def test_references_to_what_is_gone_become_null(spark):
    have = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id long, ref long")
    assert rows(C.without_reference(have, "ref", spark.createDataFrame([(10,), (10,)], "id long"), "id")) == [(1, 10), (2, None), (3, None)]
    assert rows(C.duplicate_keys(have.unionByName(have.where("id > 1")), ["id"])) == [(2, 2), (3, 2)]


def test_context_ends_and_does_not_leak(spark):
    have = spark.createDataFrame([(1, 10, 7), (2, 20, 8), (3, None, 8)], "id long, workspace_id long, user_id long")
    with T.context(spark, workspace=10):
        own = T.in_context(have)
        refused = T.refused_writes(have)
    assert [r.id for r in own.collect()] == [1]
    assert sorted(r.id for r in refused.collect()) == [2, 3]
    assert T.in_context(have).count() == 0 and T.for_worker(have).count() == 0
    with pytest.raises(ZeroDivisionError), T.context(spark, user=8, workspace=10, worker="w"):
        assert T.visible_memberships(have).count() == 3 and T.for_worker(have).count() == 3
        raise ZeroDivisionError
    assert T.in_context(have).count() == 0 and T.visible_memberships(have).count() == 0


def test_retrieval_sees_active_versions_only(spark):
    documents = spark.createDataFrame([(1, 10, False, 100), (2, 10, True, 101), (3, 10, False, 102), (4, 20, False, 103)], "id long, workspace_id long, deleted boolean, active_version_id long")
    versions = spark.createDataFrame([(100, 10, "active"), (99, 10, "active"), (101, 10, "active"), (102, 10, "failed"), (103, 20, "active")], "id long, workspace_id long, status string")
    assert [r.id for r in D.searchable_versions(documents, versions, 10).collect()] == [100]
    assert D.searchable_versions(documents, versions, None).count() == 0


def test_repeated_lines_go_and_odd_texts_stay(spark):
    texts = ["head\n\na", "head\nb\nhead", "head\n", None, "", "c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in G.without_repeated_lines(docs, 3).collect()}
    assert got == {0: ("\na", 1), 1: ("b", 2), 2: ("", 1), 3: (None, 0), 4: ("", 0), 5: ("c", 0)}


def test_blocks_have_heading_paths():
    text = "intro\n# A\n\ntext one\n## B\n  text two \n# C\nend"
    found = [(text[b.start : b.end], b.kind, b.path) for b in K.blocks(text)]
    assert found == [
        ("intro", "paragraph", ""), ("# A", "heading", "A"), ("text one", "paragraph", "A"), ("## B", "heading", "A > B"), ("text two", "paragraph", "A > B"),
        ("# C", "heading", "C"), ("end", "paragraph", "C"),
    ]


@pytest.mark.parametrize("seed", range(40))
def test_chunks_cover_every_word_within_the_limit(seed):
    rng = random.Random(seed)
    lines = []
    for _ in range(rng.randrange(12)):
        words = ["w" + rng.choice(["", ".", "!", "é"]) for _ in range(rng.choice([0, 1, 5, 30, 90]))]
        lines.append(rng.choice(["", "", "# ", "## "]) + " ".join(words) if words else "")
    text = "\n".join(lines)
    covered, last, target, most, overlap = set(), -1, 20, 30, 6
    for start, end, n, _ in K.chunks(text, target, most, overlap):
        spans = [m.span() for m in K._WORD.finditer(text, start, end)]
        assert len(spans) == n <= most and end > last
        assert len([s for s in spans if s in covered]) <= overlap
        covered.update(spans)
        last = end
    assert covered == {m.span() for m in K._WORD.finditer(text)}


def test_chunks_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t"), (None, "one two"), (4, "x " * 1200)], "doc_id long, text string")
    got = [(r.doc_id, r.chunk_no, r.n_words) for r in K.structure_chunks(docs).collect()]
    assert got == [(None, 0, 2), (4, 0, 350), (4, 1, 350), (4, 2, 350), (4, 3, 150)]
    assert K.document_blocks(docs.limit(0)).count() == 0


def test_snapshots_appear_whole(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.publish(spark.range(3)) == 1
    assert table.publish(table.read().where("id > 0"), after=1) == 2
    assert table.read().count() == 2 and table.read(1).count() == 3
    with pytest.raises(RuntimeError):
        table.publish(spark.range(9), after=1)
    broken = spark.range(4).selectExpr("raise_error('no') as id")
    with pytest.raises(Exception, match="no"):
        table.publish(broken, after=2)
    assert table.numbers() == [1, 2] and table.publish(spark.range(1), after=2) == 3


def test_a_claimed_snapshot_is_refused_until_it_is_given_up(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    table._fs.create(table._path(f"{table.root}/claims/1"), False).close()
    with pytest.raises(RuntimeError):
        table.publish(spark.range(1))
    table.release(1)
    assert table.publish(spark.range(1)) == 1
    table.release(1)
    assert table.numbers() == [1]


def test_log_only_grows(spark, tmp_path):
    log = AppendLog(spark, f"file://{tmp_path}/log", "at timestamp_ntz, actor string, action string")
    for day in ("2024-01-01", "2024-01-02"):
        log.append(spark.sql(f"SELECT 'a' AS actor, 'read' AS action, timestamp_ntz'{day} 00:00:00' AS at, 1 AS other"))
    assert log.read().count() == 2 and log.read("2024-01-02 00:00:00").count() == 1
