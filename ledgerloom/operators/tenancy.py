"""Workspaces, members and roles; every tenant read goes through ``scoped``."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import can_manage


def scoped(rows: DataFrame, workspace: int | None) -> DataFrame:
    """The rows of one workspace; none if no workspace is set.  On a relation stored by workspace only its files are read."""
    return rows.where(F.lit(False)) if workspace is None else rows.where(F.col("workspace_id") == workspace)


def stored(rows: DataFrame, path: str, files: int = 1) -> DataFrame:
    """A relation as a table with a folder for each workspace, of up to ``files`` files each."""
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(files))
    rows.repartition("workspace_id", part).write.partitionBy("workspace_id").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def workspaces_of(workspaces: DataFrame, memberships: DataFrame, user: int) -> DataFrame:
    """A user's workspaces with the role in each, by name."""
    own = memberships.where(F.col("user_id") == user).select("workspace_id", "role")
    return workspaces.join(own, workspaces["id"] == own["workspace_id"]).select("id", "name", "slug", "role").orderBy("name", "id")


def members_with_users(memberships: DataFrame, users: DataFrame, workspace: int) -> DataFrame:
    """One join instead of a lookup for each member."""
    people = users.select(F.col("id").alias("user_id"), "display_name", "email", "is_active")
    return scoped(memberships, workspace).join(people, "user_id", "left").select("id", "user_id", "role", "display_name", "email", "is_active")


def visible_workspaces(workspaces: DataFrame, memberships: DataFrame, user: int, workspace: int) -> DataFrame:
    """The workspace in context, and those that the user created or is a member of."""
    own = memberships.where(F.col("user_id") == user).select(F.col("workspace_id").alias("id"), F.lit(True).alias("member")).distinct()
    seen = (F.col("id") == workspace) | (F.col("created_by") == user) | F.col("member")
    return workspaces.join(own, "id", "left").where(seen).select("id", "name", "slug")


def member_decisions(requests: DataFrame, memberships: DataFrame) -> DataFrame:
    """(request, decision) of requests (id, workspace_id, actor_id, target_id, new_role): add if new_role is set and there's no membership.

    Checked in order: no change of oneself (409), an owner is never assigned (422), what the actor may manage (403), no
    second membership (409), no change without one (404); accepted: 201, 200, or 204 for a removal.
    """
    actor = memberships.select("workspace_id", F.col("user_id").alias("actor_id"), F.col("role").alias("actor_role"))
    target = memberships.select("workspace_id", F.col("user_id").alias("target_id"), F.col("role").alias("target_role"))
    rows = requests.join(actor, ["workspace_id", "actor_id"], "left").join(target, ["workspace_id", "target_id"], "left")
    add, remove = F.col("action") == "add", F.col("action") == "remove"
    allowed = F.coalesce(can_manage(F.col("actor_role"), F.when(add, F.col("new_role")).otherwise(F.col("target_role"))), F.lit(False))
    grants = F.coalesce(can_manage(F.col("actor_role"), F.col("new_role")), F.lit(False))
    decision = (
        F.when(F.col("actor_id") == F.col("target_id"), 409).when(~remove & (F.col("new_role") == "owner"), 422).when(F.col("target_role").isNull() & ~add, 404)
        .when(~allowed | (~remove & ~grants), 403).when(add & F.col("target_role").isNotNull(), 409).when(add, 201).when(remove, 204).otherwise(200)
    )
    return rows.select("request_id", decision.alias("decision"))


#: Session variables that late-bound filters read, as null until a context sets them.
CONTEXT = ("app_user_id", "app_workspace_id", "app_worker_id")


@contextmanager
def context(spark: SparkSession, user: int | None = None, workspace: int | None = None, worker: str | None = None) -> Iterator[None]:
    """Sets who asks for the queries that are made inside; everything is null again afterwards, also after an error.

    A DataFrame keeps the values it was made under, so it may run after the context has ended.
    """
    values = dict(zip(CONTEXT, (user, workspace, worker), strict=True))
    try:
        for name, value in values.items():
            kind = "STRING" if name == "app_worker_id" else "BIGINT"
            spark.sql(f"DECLARE OR REPLACE VARIABLE {name} {kind} DEFAULT NULL")
            if value is not None:
                spark.sql(f"SET VAR {name} = :value", {"value": value})
        yield
    finally:
        for name in CONTEXT:
            spark.sql(f"SET VAR {name} = NULL")


def in_context(rows: DataFrame) -> DataFrame:
    """The rows of the workspace in context; none if none is set, since a comparison with null holds for no row."""
    return rows.where("workspace_id = session.app_workspace_id")


def visible_memberships(memberships: DataFrame) -> DataFrame:
    """Those of the workspace in context, and the asking user's own in any workspace."""
    return memberships.where("workspace_id = session.app_workspace_id OR user_id = session.app_user_id")


def for_worker(rows: DataFrame) -> DataFrame:
    """What a queue worker may read or change: everything; others only the workspace in context."""
    return rows.where("workspace_id = session.app_workspace_id OR session.app_worker_id IS NOT NULL")


def refused_writes(rows: DataFrame) -> DataFrame:
    """Rows that may not be written in this context; a write goes ahead only if there's none."""
    return rows.where("NOT coalesce(workspace_id = session.app_workspace_id, false)")


def workspace_counts(users: DataFrame, memberships: DataFrame) -> DataFrame:
    """How many workspaces each user is a member of, none included."""
    counts = memberships.groupBy("user_id").agg(F.count("*").alias("workspaces"))
    return users.select(F.col("id").alias("user_id")).join(counts, "user_id", "left").select("user_id", F.coalesce("workspaces", F.lit(0)).alias("workspaces"))
