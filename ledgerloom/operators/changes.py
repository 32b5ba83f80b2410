"""Inserts, updates and deletes as next states of a relation, each with the rows that it touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inserted(rows: DataFrame, new: DataFrame, key: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(next rows, refused rows): a key that is there, or that an earlier new row has, is refused; nothing is replaced.

    A null in a key makes it unlike all others, as in a unique constraint.  The first of a key is an aggregate with
    map-side minima, so a key that most new rows share meets in no one task as rows.
    """
    named = F.lit(True)
    for name in key:
        named &= F.col(name).isNotNull()
    first = new.where(named).groupBy(*key).agg(F.min(order).alias("_first"))
    taken = rows.select(*key).where(named).distinct().withColumn("_taken", F.lit(True))
    state = first.join(taken, key, "left")
    marked = new.join(state, key, "left").withColumn("_ok", ~named | (F.col("_taken").isNull() & (F.col("_first") == F.col(order))))
    accepted = marked.where("_ok").select(*new.columns)
    return rows.unionByName(accepted), marked.where("NOT _ok").select(*new.columns)


def updated(rows: DataFrame, where: Column, values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(next rows, the changed rows as they are afterwards); a condition that is null changes nothing."""
    hit = F.coalesce(where, F.lit(False))
    changed = {name: F.when(hit, value).otherwise(F.col(name)).alias(name) for name, value in values.items()}
    return rows.select(*[changed.get(c, F.col(c)) for c in rows.columns]), rows.where(hit).select(*[values[c].alias(c) if c in values else F.col(c) for c in rows.columns])


def deleted(rows: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """(next rows, the deleted rows); a condition that is null deletes nothing."""
    hit = F.coalesce(where, F.lit(False))
    return rows.where(~hit), rows.where(hit)


def without_reference(rows: DataFrame, column: str, kept: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is set to null where the row that it names isn't among ``kept``."""
    there = kept.select(F.col(key).alias(column), F.lit(True).alias("_there")).distinct()
    return rows.join(there, column, "left").withColumn(column, F.when(F.col("_there"), F.col(column))).select(*rows.columns)


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has: a unique constraint holds if there's none."""
    return rows.dropna(subset=key).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
