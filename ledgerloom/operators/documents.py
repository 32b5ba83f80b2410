"""Documents and immutable versions: listing, versioning, quotas, deletion, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import object_key

from .tenancy import scoped

IMMUTABLE = ("workspace_id", "document_id", "version_number", "object_key", "original_filename", "media_type", "byte_size", "sha256", "created_by")


def latest_versions(versions: DataFrame) -> DataFrame:
    """The newest version of each document: an aggregate with map-side maxima, no sort of all versions."""
    fields = [c for c in versions.columns if c not in ("document_id", "version_number")]
    newest = F.max(F.struct("version_number", *fields)).alias("v")
    return versions.groupBy("document_id").agg(newest).select("document_id", "v.*")


def workspace_documents(documents: DataFrame, versions: DataFrame, workspace: int | None) -> DataFrame:
    """A workspace's documents that aren't deleted, newest first, each with its latest version: one plan, no lookups."""
    latest = latest_versions(scoped(versions, workspace).select("document_id", "version_number", "status", "byte_size"))
    rows = scoped(documents, workspace).where(~F.col("deleted")).withColumnRenamed("id", "document_id")
    return rows.join(latest, "document_id", "left").select("document_id", "display_name", "created_seq", "active_version_id", "version_number", "status", "byte_size").orderBy(F.desc("created_seq"), "document_id")


def document_detail(documents: DataFrame, versions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each document with its versions, newest first, and its jobs, newest first: two aggregates joined on the document."""
    listed = F.sort_array(F.collect_list(F.struct("version_number", "status")), False)
    lists = versions.groupBy(F.col("document_id").alias("id")).agg(listed.alias("versions"))
    target = F.get_json_object("payload", "$.document_id").cast("long").alias("document_id")
    own = jobs.select(target, "created_at", F.col("id").alias("job_id"), "job_type", "state").groupBy(F.col("document_id").alias("id"))
    own = own.agg(F.sort_array(F.collect_list(F.struct("created_at", "job_id", "job_type", "state")), False).alias("jobs"))
    rows = documents.where(~F.col("deleted")).select("id", "display_name").join(lists, "id", "left").join(own, "id", "left")
    return rows.select("id", "display_name", *(F.coalesce(x, F.array()).alias(x) for x in ("versions", "jobs")))


def storage_usage(workspaces: DataFrame, versions: DataFrame) -> DataFrame:
    """Bytes of all versions of each workspace; those of deleted documents count."""
    used = versions.groupBy("workspace_id").agg(F.sum("byte_size").alias("used"))
    return workspaces.join(used, workspaces["id"] == used["workspace_id"], "left").select(F.col("id").alias("workspace_id"), F.coalesce("used", F.lit(0)).alias("used_bytes"))


def quota_violations(usage: DataFrame, added: int, limit: int) -> DataFrame:
    """Workspaces that an upload of ``added`` bytes would take beyond the limit; reaching it is allowed."""
    return usage.where(F.col("used_bytes") + added > limit)


def next_version_numbers(documents: DataFrame, versions: DataFrame) -> DataFrame:
    last = versions.groupBy("document_id").agg(F.max("version_number").alias("last"))
    return documents.join(last, documents["id"] == last["document_id"], "left").select(F.col("id").alias("document_id"), (F.coalesce("last", F.lit(0)) + 1).alias("next_version"))


def duplicate_content(versions: DataFrame, within: str) -> DataFrame:
    """Versions whose content an earlier one within the same scope has; the first stays."""
    firsts = versions.groupBy(within, "sha256").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return versions.join(firsts, [within, "sha256"]).where("id > first_id").select("id", "first_id")


def activation_candidates(versions: DataFrame, documents: DataFrame, objects: DataFrame) -> DataFrame:
    """Versions under way, with whether their stored object has the recorded size and their document is still there."""
    due = versions.where("status = 'processing'").select("id", "document_id", "byte_size")
    stored = objects.select("id", "length")
    there = documents.where(~F.col("deleted")).select(F.col("id").alias("document_id"), F.lit(True).alias("there"))
    verdict = (
        F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("byte_size"), "size_mismatch")
        .when(F.col("there").isNull(), "document_gone").otherwise("activate")
    )
    return due.join(stored, "id", "left").join(there, "document_id", "left").select("id", "document_id", verdict.alias("verdict"))


def activate(versions: DataFrame, documents: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions, documents) afterwards: accepted versions are active, and their documents point at the newest of them."""
    accepted = verdicts.where("verdict = 'activate'").select("id", "document_id")
    marked = versions.join(accepted.select("id", F.lit(True).alias("ok")), "id", "left")
    newest = accepted.groupBy(F.col("document_id").alias("id")).agg(F.max("id").alias("newest"))
    pointed = documents.join(newest, "id", "left").select("id", "deleted", F.coalesce("newest", "active_version_id").alias("active_version_id"))
    return marked.select("id", "document_id", F.when(F.col("ok"), "active").otherwise(F.col("status")).alias("status")), pointed


def invalid_active_pointers(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Documents whose active version isn't an active version of that document and workspace."""
    right = versions.where("status = 'active'").select(F.col("id").alias("active_version_id"), F.col("document_id").alias("id"), "workspace_id")
    return documents.where("active_version_id is not null").join(right, ["active_version_id", "id", "workspace_id"], "left_anti").select("id", "active_version_id")


def immutability_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Versions whose protected columns differ between two snapshots; nulls compare as equal."""
    old = before.select("id", F.struct(*IMMUTABLE).alias("old"))
    new = after.select("id", F.struct(*IMMUTABLE).alias("new"))
    return old.join(new, "id").where(~F.col("old").eqNullSafe(F.col("new"))).select("id")


def soft_delete(documents: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with the targets deleted and without active version; a delete job for each target not deleted before)."""
    marked = documents.join(targets.select("id", F.lit(True).alias("target")), "id", "left").withColumn("target", F.coalesce("target", F.lit(False)) & ~F.col("deleted"))
    kept = marked.select("id", "workspace_id", (F.col("deleted") | F.col("target")).alias("deleted"), F.when(~F.col("target"), F.col("active_version_id")).alias("active_version_id"))
    return kept, marked.where("target").select(F.concat(F.lit("delete:"), F.col("id").cast("string")).alias("idempotency_key"), "workspace_id", F.lit("delete_object").alias("job_type"))


def objects_to_delete(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Keys of all objects of deleted documents; their rows stay."""
    gone = documents.where("deleted").select(F.col("id").alias("document_id"))
    return versions.join(gone, "document_id", "left_semi").select("id", object_key(F.col("workspace_id"), F.col("document_id"), F.col("id"), F.col("original_filename")).alias("object_key"))


def cascade_delete(workspaces: DataFrame, memberships: DataFrame, documents: DataFrame, users: DataFrame, gone: DataFrame) -> DataFrame:
    """What deleting workspaces does: (relation, action, n); members and documents go, a creator that is referred to may not."""
    ids = gone.select(F.col("id").alias("workspace_id")).distinct()
    counts = [
        memberships.join(ids, "workspace_id", "left_semi").agg(F.lit("memberships").alias("relation"), F.lit("cascade").alias("action"), F.count("*").alias("n")),
        documents.join(ids, "workspace_id", "left_semi").agg(F.lit("documents").alias("relation"), F.lit("cascade").alias("action"), F.count("*").alias("n")),
        users.join(workspaces.select(F.col("created_by").alias("id")), "id", "left_semi").agg(F.lit("users").alias("relation"), F.lit("restrict").alias("action"), F.count("*").alias("n")),
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def prior_numbers(versions: DataFrame) -> DataFrame:
    """Each version with the one before it: the history of a document."""
    order = Window.partitionBy("document_id").orderBy("version_number")
    return versions.select("id", "document_id", "version_number", F.lag("id").over(order).alias("previous_id"))


def searchable_versions(documents: DataFrame, versions: DataFrame, workspace: int | None) -> DataFrame:
    """The versions that retrieval may see: active ones that their document, not deleted, points at, of one workspace.

    Applied before anything is ranked, so a candidate of another tenant takes up no place.
    """
    shown = scoped(documents, workspace).where(~F.col("deleted")).select(F.col("active_version_id").alias("id"))
    return scoped(versions, workspace).where("status = 'active'").join(shown, "id", "left_semi")


def version_cards(versions: DataFrame) -> DataFrame:
    """How a version is shown: size in KiB, rounded up, and its status as words."""
    words = F.replace("status", F.lit("_"), F.lit(" "))
    shown = F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 100))
    return versions.select("id", F.ceil(F.col("byte_size") / 1024).cast("long").alias("kib"), shown.alias("status"))


def quarantined(versions: DataFrame, verdict: Column) -> DataFrame:
    """Versions that a scanner, a column that is null for a clean object, objects to."""
    return versions.select("id", verdict.alias("verdict")).where("verdict is not null")
