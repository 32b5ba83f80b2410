"""Refresh-session rotation: reuse of a spent token revokes its whole family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reused_families(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("family_id").agg(F.sum(F.col("reused").cast("int")).cast("long").alias("reuses"), F.count("*").alias("sessions")).where("reuses > 0")


def revoke_families(sessions: DataFrame, now: Column) -> DataFrame:
    """Every session of a reused family is revoked at this time, those revoked before as well.

    The flag of a family is an aggregate that is joined back: no window holds a whole family in one task.
    """
    flagged = reused_families(sessions).select("family_id", F.lit(True).alias("hit"))
    return sessions.join(flagged, "family_id", "left").select("id", "family_id", F.when(F.col("hit"), now).otherwise(F.col("revoked_at")).alias("revoked_at"))


def rotation(sessions: DataFrame, presented: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """(id, family_id, user_id, outcome, used_at, revoked_at, replaced_by) of every session after tokens were presented.

    ``presented`` (id, secret_hash, new_id) has a row for each token.  A wrong hash changes nothing; a spent or revoked
    session revokes its whole family; an expired one, or one whose user is missing or inactive, is revoked; any other is
    spent, revoked and points at its replacement.  A session that nobody presented has no outcome.
    """
    asked = presented.select("id", "secret_hash", "new_id")
    active = users.where("is_active").select(F.col("id").alias("user_id"), F.lit(True).alias("active"))
    rows = sessions.join(asked, "id", "left").join(active, "user_id", "left")
    outcome = (
        F.when(F.col("secret_hash").isNull(), None).when(F.col("secret_hash") != F.col("token_hash"), "invalid")
        .when(F.col("used_at").isNotNull() | F.col("revoked_at").isNotNull(), "family_revoked").when(F.col("expires_at") <= now, "expired")
        .when(F.col("active").isNull(), "inactive").otherwise("rotated")
    )
    rows = rows.withColumn("outcome", outcome)
    spent = F.col("outcome") == "rotated"
    hit = rows.where("outcome = 'family_revoked'").select("family_id", F.lit(True).alias("hit")).distinct()
    ended = F.coalesce("hit", F.lit(False)) | F.col("outcome").isin("rotated", "expired", "inactive")
    return rows.join(hit, "family_id", "left").select(
        "id", "family_id", "user_id", "outcome", F.when(spent, now).otherwise(F.col("used_at")).alias("used_at"),
        F.when(ended, now).otherwise(F.col("revoked_at")).alias("revoked_at"), F.when(spent, F.col("new_id")).alias("replaced_by"),
    )


def replacements(rotated: DataFrame, now: Column, days: int) -> DataFrame:
    """The sessions that ``rotation`` issues, in the families of those that they replace."""
    expires = (now + F.make_dt_interval(days=F.lit(days))).alias("expires_at")
    return rotated.where("outcome = 'rotated'").select(F.col("replaced_by").alias("id"), "family_id", "user_id", now.alias("created_at"), expires)


def logout(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.select("id", F.coalesce("revoked_at", now).alias("revoked_at"))
