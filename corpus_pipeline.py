"""A training-data pipeline over `documents`: five stages, each a table that the next one reads.

1. toxicity: rows that the learned lexicon scores 0.3 or more go.
2. n-gram Jaccard join: of each group of near copies the row with the smallest id stays, a null id being the largest.
3. benchmark decontamination: rows in which a ten-word window of a test item occurs go.
4. PII: found spans are replaced by their kind; `n_chars` follows the new text.
5. best-fit packing: what is left, in sequences of 1024 tokens.

The first four return the columns of their input.  Stages 1 to 3 drop rows and change none.  Rows that repeat an id
and text count as one document in stage 2, those with a null id only if the text has words; rows that share an id but
not a text are documents of their own.  They are known by a 64-bit hash of both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, language, ngram_join, packing, pii, toxicity
from ledgerloom.llm.exchange import saved, small_or_not
from ledgerloom.llm.queries import tokenizer_files


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.fit(docs, labels.where(~language.fold_of("doc_id", 4, 2))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = F.xxhash64(docs["doc_id"], docs["text"])
    groups = ngram_join.near_duplicate_groups(docs.select(row.alias("row"), "text"), id_col="row")
    groups = saved(groups.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")), "groups")
    linked = groups.where("row <> component").distinct()
    linked = saved(linked.unionByName(linked.select(F.col("component").alias("row"), "component").distinct()), "linked")
    named = linked.join(docs.select(row.alias("row"), "doc_id").distinct(), "row")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first"))
    gone = saved(linked.join(first.select("first.row"), "row", "left_anti").select(F.col("row").alias("gone")), "gone")
    kept = docs.join(small_or_not(gone), row == gone["gone"], "left_anti")
    if groups.groupBy("row").count().where("count > 1").limit(1).count():
        known = F.coalesce(F.col("doc_id").isNotNull() | F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
        kept = kept.where(known).dropDuplicates(["doc_id", "text"]).unionByName(kept.where(~known))
    return kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, *tokenizer_files())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", hide_private),
    ("best_fit_packing", pack_sequences),
]

#: Learned scores and tokenisation have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
