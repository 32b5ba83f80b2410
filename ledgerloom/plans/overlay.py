"""The document-operations relations, laid over the star-schema test tables.

Each relation is a lazy projection of one table, so filters and column pruning reach its Parquet scan.  ``SQL`` has the
same relations as DuckDB common table expressions, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import object_key

#: Logical documents that the rows of `documents` are versions of, and workspaces.
DOCUMENTS, WORKSPACES = 200, 25
#: The clock of every query: results don't depend on when they run.
NOW = "1995-06-15 00:00:00"

JOB_STATES = ("queued", "leased", "processing", "retrying", "failed", "dead_letter", "completed")
VERSION_STATES = ("queued", "processing", "active", "failed")
ROLES = ("owner", "admin", "agent", "viewer")


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def choose(index: Column, names: tuple[str, ...]) -> Column:
    """The name at an index, as a CASE expression."""
    out = F.when(index == 0, names[0])
    for i, name in enumerate(names[1:], 1):
        out = out.when(index == i, name)
    return out


class Overlay:
    """The relations of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def workspaces(self) -> DataFrame:
        key = F.col("n_nationkey").cast("long")
        return self.table("nation").select(key.alias("id"), F.col("n_name").alias("name"), F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))).alias("slug"), key.alias("created_by"))

    def users(self) -> DataFrame:
        email = F.concat(F.lower("c_name"), F.lit("@example.com"))
        return self.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("display_name"), email.alias("email"), (F.col("c_acctbal") >= 0).alias("is_active"))

    def memberships(self) -> DataFrame:
        user, home = F.col("c_custkey"), F.col("c_nationkey").cast("long")
        second = F.when(user % 5 == 0, (home + 1) % WORKSPACES)
        # One pass: the second membership is a generated row, not a second scan.
        spaces = F.explode(F.array_compact(F.array(home, second))).alias("workspace_id")
        rows = self.table("customer").select(user.alias("user_id"), spaces)
        return rows.select((F.col("user_id") * WORKSPACES + F.col("workspace_id")).alias("id"), "workspace_id", "user_id", choose(F.col("user_id") % 4, ROLES).alias("role"))

    def versions(self) -> DataFrame:
        document = F.col("doc_id") % DOCUMENTS
        rows = self.table("documents").select(
            F.col("doc_id").alias("id"), document.alias("document_id"), (document % WORKSPACES).alias("workspace_id"), F.octet_length("text").cast("long").alias("byte_size"),
            F.sha2(F.encode("text", "utf-8"), 256).alias("sha256"), choose(F.col("doc_id") % 4, VERSION_STATES).alias("status"), F.col("lang"),
            F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("original_filename"), F.lit("text/markdown").alias("media_type"), (F.col("doc_id") % 7).alias("created_by"),
        )
        rows = rows.withColumn("object_key", object_key(F.col("workspace_id"), F.col("document_id"), F.col("id"), F.col("original_filename")))
        number = F.row_number().over(Window.partitionBy("document_id").orderBy("id")).cast("long")
        return rows.withColumn("version_number", number)

    def documents(self) -> DataFrame:
        document = F.col("doc_id") % DOCUMENTS
        active = F.max(F.when(F.col("doc_id") % 4 == 2, F.col("doc_id")))
        rows = self.table("documents").groupBy(document.alias("id")).agg(F.min("doc_id").alias("created_seq"), active.alias("active_version_id"))
        deleted = F.col("id") % 11 == 0
        return rows.select(
            "id", (F.col("id") % WORKSPACES).alias("workspace_id"), F.concat(F.lit("Document "), F.col("id").cast("string")).alias("display_name"), deleted.alias("deleted"), "created_seq",
            F.when(~deleted, F.col("active_version_id")).alias("active_version_id"),
        )

    def jobs(self) -> DataFrame:
        key = F.col("o_orderkey")
        state = choose(key % 7, JOB_STATES)
        held = state.isin("leased", "processing")
        return self.table("orders").select(
            key.alias("id"), (F.col("o_custkey") % WORKSPACES).alias("workspace_id"), state.alias("state"),
            F.when(key % 9 == 0, "delete_object").otherwise("process_document").alias("job_type"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("attempt_count"), F.lit(4).alias("max_attempts"),
            F.col("o_orderdate").alias("available_at"), F.col("o_orderdate").alias("created_at"),
            F.when(held, F.concat(F.lit("worker-"), (key % 4).cast("string"))).alias("lease_owner"),
            F.when(held, F.col("o_orderdate") + F.expr("INTERVAL 60 SECOND")).alias("lease_expires_at"),
            F.when(state.isin("failed", "dead_letter", "processing"), "storage_error").alias("error_code"), F.when(state.isin("failed", "dead_letter", "processing"), "gone").alias("error_message"),
            F.concat(F.lit("process:"), (F.col("o_custkey") % 500).cast("string")).alias("idempotency_key"),
            F.to_json(F.struct((F.col("o_custkey") % DOCUMENTS).cast("string").alias("document_id"), key.cast("string").alias("document_version_id"))).alias("payload"),
        )

    def sessions(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("family_id"), F.col("user_id").alias("user_id"), F.sha2(F.encode(F.col("event_id").cast("string"), "utf-8"), 256).alias("token_hash"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 14 DAY")).alias("expires_at"),
            F.when(kind.isin("purchase", "signup"), F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("used_at"), ((kind == "error") & (F.col("value") > 100)).alias("reused"),
            F.when(kind == "signup", F.col("ts") + F.expr("INTERVAL 2 HOUR")).alias("revoked_at"),
        )


class StreamOverlay(Overlay):
    """The same relations as streams, with the schemas of the tables; for relations without windows or joins."""

    def table(self, name: str) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.sf_dir)


def _names(index: str, names: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {index} = {i} THEN '{x}'" for i, x in enumerate(names)) + " END"


SQL = {
    "workspaces_": "SELECT n_nationkey::BIGINT AS id, n_name AS name, lower(replace(n_name, '_', '-')) AS slug, n_nationkey::BIGINT AS created_by FROM nation",
    "users_": "SELECT c_custkey AS id, c_name AS display_name, lower(c_name) || '@example.com' AS email, c_acctbal >= 0 AS is_active FROM customer",
    "memberships_": f"""SELECT user_id * {WORKSPACES} + workspace_id AS id, workspace_id, user_id, {_names("user_id % 4", ROLES)} AS role FROM (
        SELECT c_custkey AS user_id, c_nationkey::BIGINT AS workspace_id FROM customer
        UNION ALL SELECT c_custkey, (c_nationkey::BIGINT + 1) % {WORKSPACES} FROM customer WHERE c_custkey % 5 = 0)""",
    "versions_": f"""SELECT doc_id AS id, doc_id % {DOCUMENTS} AS document_id, doc_id % {DOCUMENTS} % {WORKSPACES} AS workspace_id, octet_length(encode(text))::BIGINT AS byte_size,
        sha256(text) AS sha256, {_names("doc_id % 4", VERSION_STATES)} AS status, lang, 'doc-' || doc_id || '.md' AS original_filename, 'text/markdown' AS media_type, doc_id % 7 AS created_by,
        'workspaces/' || (doc_id % {DOCUMENTS} % {WORKSPACES}) || '/documents/' || (doc_id % {DOCUMENTS}) || '/versions/' || doc_id || '/doc-' || doc_id || '.md' AS object_key,
        row_number() OVER (PARTITION BY doc_id % {DOCUMENTS} ORDER BY doc_id)::BIGINT AS version_number FROM documents""",
    "documents_": f"""SELECT doc_id % {DOCUMENTS} AS id, doc_id % {DOCUMENTS} % {WORKSPACES} AS workspace_id, 'Document ' || (doc_id % {DOCUMENTS}) AS display_name,
        doc_id % {DOCUMENTS} % 11 = 0 AS deleted, min(doc_id) AS created_seq,
        CASE WHEN doc_id % {DOCUMENTS} % 11 <> 0 THEN max(doc_id) FILTER (WHERE doc_id % 4 = 2) END AS active_version_id FROM documents GROUP BY doc_id % {DOCUMENTS}""",
    "jobs_": f"""SELECT id, workspace_id, state, job_type, attempt_count, 4 AS max_attempts, available_at, available_at AS created_at, idempotency_key, payload,
        CASE WHEN state IN ('failed', 'dead_letter', 'processing') THEN 'storage_error' END AS error_code, CASE WHEN state IN ('failed', 'dead_letter', 'processing') THEN 'gone' END AS error_message,
        CASE WHEN state IN ('leased', 'processing') THEN 'worker-' || (id % 4) END AS lease_owner,
        CASE WHEN state IN ('leased', 'processing') THEN available_at + INTERVAL 60 SECOND END AS lease_expires_at FROM (
        SELECT o_orderkey AS id, o_custkey % {WORKSPACES} AS workspace_id, {_names("o_orderkey % 7", JOB_STATES)} AS state,
        CASE WHEN o_orderkey % 9 = 0 THEN 'delete_object' ELSE 'process_document' END AS job_type, substr(o_orderpriority, 1, 1)::INT AS attempt_count, o_orderdate AS available_at,
        'process:' || (o_custkey % 500) AS idempotency_key,
        '{{"document_id":"' || (o_custkey % {DOCUMENTS}) || '","document_version_id":"' || o_orderkey || '"}}' AS payload FROM orders)""",
    "sessions_": """SELECT event_id AS id, user_id AS family_id, user_id, sha256(event_id::VARCHAR) AS token_hash, ts AS created_at, ts + INTERVAL 14 DAY AS expires_at,
        CASE WHEN event_type IN ('purchase', 'signup') THEN ts + INTERVAL 1 HOUR END AS used_at, event_type = 'error' AND value > 100 AS reused,
        CASE WHEN event_type = 'signup' THEN ts + INTERVAL 2 HOUR END AS revoked_at FROM events""",
}


def with_relations(query: str) -> str:
    """A DuckDB query over the relations that it names, each with a trailing underscore."""
    used = [name for name in SQL if name in query]
    own = query.removeprefix("WITH ")
    return "WITH " + ", ".join(f"{name} AS ({SQL[name]})" for name in used) + (", " if own != query else " ") + own if used else query
