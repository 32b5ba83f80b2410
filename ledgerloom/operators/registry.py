"""Registries of prompts and models: names with numbered versions that never change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def register(entries: DataFrame, offered: DataFrame) -> DataFrame:
    """(name, version, digest) of what ``offered`` (name, seq, digest) adds to ``entries`` (name, version, digest).

    Content that the name has already is a replay and adds nothing, nor does null content; new contents are numbered
    on from the name's last version, in the order in which they were first offered.
    """
    new = offered.where("digest is not null").groupBy("name", "digest").agg(F.min("seq").alias("seq"))
    new = new.join(entries.select("name", "digest"), ["name", "digest"], "left_anti")
    last = entries.groupBy("name").agg(F.max("version").alias("last"))
    nth = F.row_number().over(Window.partitionBy("name").orderBy("seq", "digest"))
    return new.join(last, "name", "left").select("name", (F.coalesce("last", F.lit(0)) + nth).cast("long").alias("version"), "digest")
