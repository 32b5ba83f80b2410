import os
from datetime import datetime, timedelta
from uuid import UUID

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import jobs as J
from ledgerloom.operators import registry as P
from ledgerloom.operators import sessions as Z
from ledgerloom.sources.objects import ObjectStore


@pytest.fixture
def now(spark):
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).head().x


@pytest.mark.parametrize(
    "name, expected",
    [
        ("../../customer\x00-guide.md", "customer-guide.md"), ("..\\..\\billing guide.md", "billing guide.md"), ("   ", "upload"), (None, "upload"), ("é<>ü.md", "é_ü.md"), ("a" * 300, "a" * 255),
        ("ﬁle①.txt", "file1.txt"),
    ],
)
def test_sanitize_filename(spark, name, expected):
    assert one(spark, S.sanitize_filename(F.col("n")), n=name) == expected


@pytest.mark.parametrize(
    "name, declared, content, expected",
    [
        ("guide.pdf", "application/pdf", b"%PDF-1.7\n", "application/pdf"), ("guide.md", "text/markdown", b"# Guide\n", "text/markdown"), ("guide.html", "text/html", b"<!doctype html>", "text/html"),
        ("fake.pdf", "application/pdf", b"not-pdf", None), ("guide.md", "application/pdf", b"# x", None), ("a.txt", "text/plain", b"a\x00b", None), ("a.txt", "text/plain", b"\xff", None),
        ("a.html", "text/html", b"plain", None), ("a.exe", "text/plain", b"x", None), ("a.md", "Text/Plain; charset=utf-8", b"x", "text/markdown"), ("a.txt", "text/plain", b"a" * 8191 + "é".encode(), None),
        ("a.txt", "text/plain", b" 0", "text/plain"),
    ],
)
def test_media_type(spark, name, declared, content, expected):
    assert one(spark, S.media_type(F.col("n"), F.col("d"), F.col("c")), n=name, d=declared, c=content) == expected


def test_roles(spark):
    roles = list(S.ROLE_RANK)
    pairs = spark.createDataFrame([(a, b) for a in roles for b in roles], "a string, b string").select("a", "b", S.can_manage(F.col("a"), F.col("b")).alias("ok"))
    allowed = {(r.a, r.b) for r in pairs.collect() if r.ok}
    assert allowed == {("owner", "admin"), ("owner", "agent"), ("owner", "viewer"), ("admin", "agent"), ("admin", "viewer")}


@pytest.mark.parametrize("token", ["", "not-a-token", "not-a-uuid.secret", "00000000-0000-4000-8000-000000000101.short"])
def test_malformed_tokens(spark, token):
    assert one(spark, S.refresh_token(F.col("t")), t=token) is None


@pytest.mark.parametrize("key, ok", [("a/b", True), ("", False), ("/a", False), ("a\\b", False), ("a/../b", False), ("..", False), ("a/..b", True)])
def test_contained(spark, key, ok):
    assert one(spark, S.is_contained(F.col("k")), k=key) is ok


JOB = "id long, state string, available_at timestamp_ntz, created_at timestamp_ntz, lease_owner string, lease_expires_at timestamp_ntz, attempt_count int, max_attempts int, error_code string, error_message string, workspace_id long"


def jobs(spark, *rows):
    return spark.createDataFrame([(*r, "old", "older", 1) for r in rows], JOB)


def at(second):
    return datetime(2024, 1, 1, 0, 0, second) if second >= 0 else datetime(2023, 12, 31, 23, 59, 60 + second)


def test_claim_and_reclaim(spark, now):
    rows = jobs(
        spark, (1, "queued", at(-5), at(-9), None, None, 0, 5), (2, "queued", at(5), at(-9), None, None, 0, 5), (3, "leased", at(-9), at(-9), "old", at(-1), 9, 5),
        (4, "leased", at(-9), at(-9), "old", at(0), 1, 5), (5, "failed", at(-9), at(-9), None, None, 1, 5),
    )
    taken = J.claim(rows, "new", 5, 60, now).collect()
    assert [(r.id, r.lease_owner, r.attempt_count) for r in sorted(taken)] == [(1, "new", 1), (3, "new", 10)]
    assert J.claim(rows, "new", 1, 60, now).head().id == 3
    why = {r.id: r.why for r in rows.select("id", J.ownership(F.lit("old"), now).alias("why")).collect()}
    assert why[3] == why[4] == "lease_expired" and why[1] == "not_owner"


def test_dead_letter_and_retry(spark, now):
    rows = jobs(
        spark, (1, "processing", at(-5), at(-9), "w", at(9), 1, 1), (2, "processing", at(-5), at(-9), "w", at(9), 1, 5), (3, "leased", at(-5), at(-9), "other", at(9), 1, 5),
        (4, "leased", at(-5), at(-9), "w", at(0), 1, 5), (5, "queued", at(-5), at(-9), "w", at(9), 1, 5),
    )
    after = {r.id: r for r in J.failed(rows, F.lit("w"), F.lit(True), F.lit("e" * 200), F.lit("m"), now).collect()}
    assert after[1].state == "dead_letter" and after[2].state == "retrying" and len(after[1].error_code) == 64
    assert at(1) <= after[2].available_at <= at(2)
    assert after[1].lease_owner is after[1].lease_expires_at is None
    assert [after[i].rejected for i in (1, 2, 3, 4, 5)] == [None, None, "not_owner", "lease_expired", "not_held"]
    assert (after[3].state, after[3].lease_owner, after[3].error_code) == ("leased", "other", "old")
    dead = rows.withColumn("state", F.lit("dead_letter"))
    got = J.manual_retry(dead, F.lit(1), now).collect()
    assert {(r.state, r.attempt_count, r.lease_owner, r.error_code, r.rejected) for r in got} == {("retrying", 0, None, None, None)}
    assert {r.rejected for r in J.manual_retry(dead, F.lit(2), now).collect()} == {"not_found"}
    assert {r.rejected for r in J.manual_retry(rows, F.lit(1), now).collect()} == {"conflict"}
    done = {r.id: r for r in J.transition(rows, "complete", F.lit("w"), now).collect()}
    assert (done[2].state, done[2].lease_owner, done[2].error_code, done[3].state) == ("completed", None, None, "leased")
    assert {r.error_code for r in J.claim(jobs(spark, (1, "queued", at(-5), at(-9), None, None, 0, 5)), "n", 1, 9, now).collect()} == {None}


def test_failure_touches_versions_of_document_jobs_only(spark):
    rows = spark.createDataFrame(
        [("process_document", "failed", None, 1), ("process_document", "retrying", None, 2), ("delete_object", "failed", None, 3), ("process_document", "dead_letter", "not_owner", 4)],
        "job_type string, state string, rejected string, v long",
    ).withColumn("payload", F.format_string('{"document_version_id":"%d"}', "v"))
    assert {(r.version_id, r.status) for r in J.version_updates(rows, "fail").collect()} == {(1, "failed"), (2, "queued")}
    assert {r.version_id for r in J.version_updates(rows, "start").collect()} == {1, 2}


def test_session_rotation(spark, now):
    kind = "id long, family_id long, user_id long, token_hash string, expires_at timestamp_ntz, used_at timestamp_ntz, revoked_at timestamp_ntz, reused boolean"
    rows = [
        (1, 1, 1, "h", at(9), at(-9), at(-9), True), (2, 1, 1, "h", at(9), None, at(-5), False), (3, 1, 1, "h", at(9), None, None, False), (4, 2, 1, "h", at(0), None, None, False),
        (5, 3, 2, "h", at(9), None, None, False), (6, 4, 1, "h", at(9), None, None, False), (7, 5, 1, "h", at(9), None, None, False), (8, 6, 1, "h", at(9), None, at(-4), False),
    ]
    sessions = spark.createDataFrame(rows, kind)
    users = spark.createDataFrame([(1, True), (2, False)], "id long, is_active boolean")
    asked = spark.createDataFrame([(1, "h", 101), (4, "h", 104), (5, "h", 105), (6, "h", 106), (7, "x", 107)], "id long, secret_hash string, new_id long")
    got = {r.id: (r.outcome, r.used_at, r.revoked_at, r.replaced_by) for r in Z.rotation(sessions, asked, users, now).collect()}
    zero = at(0)
    assert got == {
        1: ("family_revoked", at(-9), zero, None), 2: (None, None, zero, None), 3: (None, None, zero, None), 4: ("expired", None, zero, None), 5: ("inactive", None, zero, None),
        6: ("rotated", zero, zero, 106), 7: ("invalid", None, None, None), 8: (None, None, at(-4), None),
    }
    assert [tuple(r)[:3] for r in Z.replacements(Z.rotation(sessions, asked, users, now), now, 14).collect()] == [(106, 4, 1)]
    revoked = {r.id: r.revoked_at for r in Z.revoke_families(sessions, now).collect()}
    assert revoked[1] == revoked[2] == revoked[3] == zero and revoked[8] == at(-4) and revoked[4] is None


def test_texts_end_where_they_end(spark):
    assert one(spark, S.is_slug(F.col("k")), k="abc") is True and one(spark, S.is_slug(F.col("k")), k="abc\n") is False
    assert one(spark, S.normal_email(F.col("k")), k="\t A@B.co\u2003\n") == "a@b.co"
    plain = "00000000-0000-4000-8000-00000000000a"
    for text in (plain, plain.replace("-", "").upper(), "{" + plain + "}", "urn:uuid:" + plain):
        assert one(spark, S.parse_uuid(F.col("k")), k=text) == plain
    assert one(spark, S.parse_uuid(F.col("k")), k=plain + "\n") is None and one(spark, S.parse_uuid(F.col("k")), k="zz") is None


def test_objects(spark, tmp_path):
    store = ObjectStore(spark, str(tmp_path))
    assert store.write("staging/1/a", b"hello world") == 11
    with pytest.raises(Exception, match="exist"):
        store.write("staging/1/a", b"again")
    with pytest.raises(ValueError):
        store.write("../a", b"")
    store.move("staging/1/a", "workspaces/1/a")
    assert [(r.key, r.length) for r in store.stat("workspaces").collect()] == [("workspaces/1/a", 11)]
    assert bytes(store.read("workspaces/1/a").head().content) == b"hello world"
    with pytest.raises(FileNotFoundError):
        store.move("staging/1/gone", "workspaces/1/a")
    store.write("staging/1/c", b"newer")
    store.move("staging/1/c", "workspaces/1/a")
    assert [(r.key, r.length) for r in store.stat("workspaces").collect()] == [("workspaces/1/a", 5)]
    store.write("staging/1/b", b"x")
    assert store.delete_stale_staging(datetime(2000, 1, 1)) == 0
    assert store.delete_stale_staging(datetime(2100, 1, 1)) == 1
    store.delete("workspaces/1/a")
    store.delete("workspaces/1/a")


def test_member_decisions(spark):
    from ledgerloom.operators.tenancy import member_decisions

    members = spark.createDataFrame([(1, 1, "owner"), (1, 2, "admin"), (1, 3, "agent")], "workspace_id long, user_id long, role string")
    asked = [
        (1, 1, 2, 9, "add", "agent", 201), (2, 1, 2, 3, "add", "agent", 409), (3, 1, 2, 1, "update", "agent", 403), (4, 1, 2, 2, "remove", None, 409), (5, 1, 2, 9, "remove", None, 404),
        (6, 1, 2, 9, "add", "admin", 403), (7, 1, 1, 9, "add", "owner", 422), (8, 1, 1, 2, "remove", None, 204), (9, 1, 1, 3, "update", "viewer", 200), (10, 1, 3, 9, "add", "viewer", 403),
    ]
    rows = spark.createDataFrame([r[:6] for r in asked], "request_id long, workspace_id long, actor_id long, target_id long, action string, new_role string")
    assert {r.request_id: r.decision for r in member_decisions(rows, members).collect()} == {r[0]: r[6] for r in asked}


def test_stream_fences_late_results(spark, tmp_path):
    from ledgerloom.streaming import queue as Q

    rows = [(1, at(0), 7, "click", 0.0, ""), (2, at(10), 7, "purchase", 0.0, ""), (3, at(20), 7, "purchase", 0.0, ""), (4, at(1), 8, "purchase", 0.0, "")]
    spark.createDataFrame(rows, Q.EVENTS).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    stream = spark.readStream.schema(Q.EVENTS).parquet(str(tmp_path / "events.parquet")).withColumn("at", F.col("ts").cast("timestamp"))
    found = {r.user_id: (r.attempts, r.fenced) for r in Q.run_once(Q.lease_outcomes(stream), "update").collect()}
    assert found == {7: (1, 1), 8: (0, 1)}


def test_uuids(spark):
    rows = spark.range(50).select(S.new_uuid().alias("a"), S.natural_uuid(F.lit("k"), F.col("id")).alias("b"), S.natural_uuid(F.lit("k"), F.lit(None)).alias("c")).collect()
    assert len({r.a for r in rows}) == len({r.b for r in rows}) == 50 and all(UUID(r.b).version == 8 and UUID(r.a).version == 4 for r in rows)
    assert all(UUID(r.b).variant == "specified in RFC 4122" and r.c is None for r in rows)


def test_registry_numbers_on_and_replays(spark):
    entries = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("q", 1, "a")], "name string, version long, digest string")
    offered = spark.createDataFrame([("p", 9, "d"), ("p", 8, "c"), ("p", 7, "a"), ("p", 10, "c"), ("r", 1, "a"), ("q", 2, None)], "name string, seq long, digest string")
    assert sorted(map(tuple, P.register(entries, offered).collect())) == [("p", 3, "c"), ("p", 4, "d"), ("r", 1, "a")]
    assert P.register(entries, offered.limit(0)).collect() == []


def test_lease_state_of_idle_jobs_is_dropped(spark, tmp_path):
    """Job 1 comes back long after its last event, when its state is gone; without eviction it goes on counting."""
    from ledgerloom.streaming import queue as Q

    batches = [[(1, 0, 1, "click"), (2, 100, 1, "error")], [(3, 9000, 2, "click")], [(4, 9001, 2, "view")], [(5, 9500, 1, "click")]]
    for i, batch in enumerate(batches):
        rows = [(e, datetime(2024, 1, 1) + timedelta(seconds=s), u, kind, 0.0, "") for e, s, u, kind in batch]
        spark.createDataFrame(rows, Q.EVENTS).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        part = next((tmp_path / f"b{i}").glob("part-*"))
        (tmp_path / "in" / str(i)).mkdir(parents=True)
        part.rename(tmp_path / "in" / str(i) / "events.parquet")
        os.utime(tmp_path / "in" / str(i) / "events.parquet", (1_700_000_000 + 60 * i,) * 2)
    for idle, expected in ((None, [(1, 1), (2, 1)]), (300, [(1, 1), (1, 0)])):
        stream = spark.readStream.schema(Q.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        rows = Q.run_once(Q.lease_outcomes(stream.withColumn("at", F.col("ts").cast("timestamp")), idle_seconds=idle), "update").where("user_id = 1").collect()
        assert sorted((r.attempts, r.fenced) for r in rows) == sorted(expected)


def test_tokens_of_any_text():
    import random
    import re

    import pyarrow as pa

    from ledgerloom.operators.retrieval import tokens

    rnd = random.Random(1)
    lower = str.maketrans("KZ", "kz")
    for _ in range(300):
        texts = [rnd.choice([None, "", "".join(rnd.choice("aZ9 é-\nKK") for _ in range(rnd.randrange(12)))]) for _ in range(rnd.randrange(6))]
        words, many = tokens(pa.array(["xx", *texts], pa.string()).slice(1))
        expected = [re.findall("[a-z0-9]+", (x or "").translate(lower)) for x in texts]
        assert words.to_pylist() == [w for x in expected for w in x] and many.tolist() == [len(x) for x in expected]
