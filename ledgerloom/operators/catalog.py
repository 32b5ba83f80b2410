"""The session's catalog as relations: columns of tables, and the references that the names of keys imply."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "table_name string, column_name string"
KEY = "_([a-z]+)key$"


def columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name) as the catalog lists them; its size is that of the schemas, not of the data."""
    found = []
    for name, table in tables.items():
        view = f"catalog_{uuid.uuid4().hex}"
        table.createTempView(view)
        try:
            found += [(name, c.name) for c in spark.catalog.listColumns(view)]
        finally:
            spark.catalog.dropTempView(view)
    return spark.createDataFrame(found, COLUMNS)


def references(listed: DataFrame) -> DataFrame:
    """(source_table, source_column, target_table, target_column): a key column of one table that names the key of another.

    The catalog joined with itself: the part before `key` is the start of the target's name.
    """
    keys = listed.where(F.col("column_name").rlike(KEY)).withColumn("stem", F.regexp_extract("column_name", KEY, 1))
    own = F.startswith("table_name", "stem")
    targets = keys.where(own).select("stem", F.col("table_name").alias("target_table"), F.col("column_name").alias("target_column"))
    sources = keys.select("stem", F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"))
    return sources.join(targets, "stem").where("source_table <> target_table").drop("stem")
