"""The durable queue as pure functions from job rows to next job rows; rejected rows carry a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import backoff_seconds

CODE_LENGTH, MESSAGE_LENGTH, OWNER_LENGTH = 64, 1000, 128
HELD = ("leased", "processing")
PENDING = ("queued", "leased", "processing", "retrying")


def is_claimable(now: Column) -> Column:
    """Due, or held under a lease that ran out; attempts aren't limited here."""
    due = F.col("state").isin("queued", "retrying") & (F.col("available_at") <= now)
    expired = F.col("state").isin(*HELD) & F.col("lease_expires_at").isNotNull() & (F.col("lease_expires_at") < now)
    return due | expired


def claim(jobs: DataFrame, worker: str, batch: int, lease_seconds: int, now: Column) -> DataFrame:
    """The next rows of the first claimable jobs; planned as a distributed top-k, not a sort."""
    first = jobs.where(is_claimable(now)).orderBy("available_at", "created_at", "id").limit(batch)
    return first.select(
        "id", F.lit("leased").alias("state"), F.lit(worker[:OWNER_LENGTH]).alias("lease_owner"), (now + F.make_dt_interval(secs=F.lit(lease_seconds))).alias("lease_expires_at"),
        (F.col("attempt_count") + 1).alias("attempt_count"), *_no_error(),
    )


def _no_error() -> list[Column]:
    return [F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message")]


def ownership(worker: Column, now: Column) -> Column:
    """Why a worker may not act on a job; null if it may.  At the very end of a lease nobody owns the job."""
    return (
        F.when(~F.col("lease_owner").eqNullSafe(worker), "not_owner").when(~F.col("state").isin(*HELD), "not_held")
        .when(~F.coalesce(F.col("lease_expires_at") > now, F.lit(False)), "lease_expired")
    )


def transition(jobs: DataFrame, event: str, worker: Column, now: Column, lease_seconds: int = 60) -> DataFrame:
    """The next rows after start, renew or complete, and why one is rejected; a rejected row stays as it is."""
    rejected = ownership(worker, now)
    none = F.lit(None).cast("string")
    set_to = {
        "start": {"state": F.lit("processing")},
        "renew": {"lease_expires_at": now + F.make_dt_interval(secs=F.lit(lease_seconds))},
        "complete": {"state": F.lit("completed"), "lease_owner": none, "lease_expires_at": F.lit(None).cast("timestamp_ntz"), "error_code": none, "error_message": none},
    }[event]
    return _next(jobs, rejected, set_to, "state", "lease_owner", "lease_expires_at", "error_code", "error_message")


def _next(jobs: DataFrame, rejected: Column, set_to: dict[str, Column], *shown: str) -> DataFrame:
    new = [(F.when(rejected.isNull(), set_to[c]).otherwise(F.col(c)) if c in set_to else F.col(c)).alias(c) for c in shown]
    return jobs.select("id", *new, rejected.alias("rejected"))


def failed(jobs: DataFrame, worker: Column, retryable: Column, code: Column, message: Column, now: Column) -> DataFrame:
    """The next rows after a worker reports a failure: retried after a delay, dead after the last attempt, else failed.

    Only the owner of a running lease may report; other rows are rejected and stay as they are.  The lease ends.
    """
    left = F.col("attempt_count") < F.col("max_attempts")
    state = F.when(retryable & left, "retrying").when(~left, "dead_letter").otherwise("failed")
    delay = backoff_seconds(F.col("attempt_count"), F.col("id"))
    set_to = {
        "state": state, "available_at": F.when(state == "retrying", now + F.make_dt_interval(secs=delay)).otherwise(F.col("available_at")), "lease_owner": F.lit(None).cast("string"),
        "lease_expires_at": F.lit(None).cast("timestamp_ntz"), "error_code": F.substring(code, 1, CODE_LENGTH), "error_message": F.substring(message, 1, MESSAGE_LENGTH),
    }
    kept = [c for c in ("job_type", "payload") if c in jobs.columns]
    return _next(jobs, ownership(worker, now), set_to, *kept, *set_to)


def version_updates(next_jobs: DataFrame, event: str) -> DataFrame:
    """(version_id, status) that starting or failing jobs set; only accepted jobs that process a document touch a version."""
    target = F.get_json_object("payload", "$.document_version_id").cast("long").alias("version_id")
    status = F.lit("processing") if event == "start" else F.when(F.col("state").isin("failed", "dead_letter"), "failed").otherwise("queued")
    return next_jobs.where("rejected is null and job_type = 'process_document'").select(target, status.alias("status"))


def manual_retry(jobs: DataFrame, workspace: Column, now: Column) -> DataFrame:
    """A workspace's failed and dead jobs start over; others are refused, and those of other workspaces aren't found."""
    refused = F.when(F.col("workspace_id") != workspace, "not_found").when(~F.col("state").isin("failed", "dead_letter"), "conflict")
    none = F.lit(None).cast("string")
    set_to = {
        "state": F.lit("retrying"), "attempt_count": F.lit(0), "available_at": now, "lease_owner": none, "lease_expires_at": F.lit(None).cast("timestamp_ntz"),
        "error_code": none, "error_message": none,
    }
    return _next(jobs, refused, set_to, *set_to)


def dispatched(jobs: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """(id, action) of each leased job: what its worker does, or the error that fails it.

    A document job activates its version if version and document are there, the document not deleted; a delete job
    removes the objects of all versions of its document.  Other types are errors.
    """
    version = F.get_json_object("payload", "$.document_version_id").cast("long").alias("version_id")
    document = F.get_json_object("payload", "$.document_id").cast("long").alias("target_id")
    rows = jobs.where(F.col("state") == "leased").select("id", "job_type", version, document)
    v = versions.select(F.col("id").alias("version_id"), "document_id")
    d = documents.select(F.col("id").alias("document_id"), "deleted")
    counts = versions.groupBy(F.col("document_id").alias("target_id")).agg(F.count("*").alias("objects"))
    rows = rows.join(v, "version_id", "left").join(d, "document_id", "left").join(counts, "target_id", "left")
    process = F.when(F.col("document_id").isNull(), "error:version_missing").when(F.coalesce("deleted", F.lit(True)), "error:document_gone").otherwise("activate")
    delete = F.concat(F.lit("delete:"), F.coalesce("objects", F.lit(0)).cast("string"))
    action = F.when(F.col("job_type") == "process_document", process).when(F.col("job_type") == "delete_object", delete).otherwise("error:unknown_type")
    return rows.select("id", action.alias("action"))


def first_enqueued(jobs: DataFrame) -> DataFrame:
    """For each idempotency key the job that was enqueued first, which replays return, and how many replays there were."""
    first = F.min(F.struct("created_at", "id")).alias("first")
    rows = jobs.groupBy("workspace_id", "job_type", "idempotency_key").agg(first, (F.count("*") - 1).alias("replays"))
    return rows.select("workspace_id", "job_type", "idempotency_key", F.col("first.id").alias("job_id"), "replays")


def for_document(jobs: DataFrame, document: str) -> DataFrame:
    """Jobs whose payload names a document: the JSON field is read in the scan's stage, nothing is fetched to be filtered."""
    return jobs.where(F.get_json_object("payload", "$.document_id") == document)


def latest_state(log: DataFrame, key: str, order: str) -> DataFrame:
    """The current rows of an append-only log of states: one aggregate with map-side maxima."""
    rest = [c for c in log.columns if c not in (key, order)]
    return log.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("v")).select(key, "v.*")


def pending_documents(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Whether any job of a document is under way, which its reader waits for, and the first such job; no list of jobs is built."""
    target = F.get_json_object("payload", "$.document_id").cast("long").alias("document_id")
    due = jobs.where(F.col("state").isin(*PENDING)).groupBy(target).agg(F.min("id").alias("first_pending"))
    rows = documents.select(F.col("id").alias("document_id")).join(due, "document_id", "left")
    return rows.select("document_id", F.col("first_pending").isNotNull().alias("pending"), "first_pending")
