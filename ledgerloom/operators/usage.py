"""Usage, cost and conversation analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cost(turns: DataFrame, input_price: float, output_price: float) -> DataFrame:
    """Cost of each conversation at prices for a million tokens; a token is taken to be four characters."""
    n = F.ceil(F.length("text") / 4)
    sent = F.sum(F.when(F.col("role") == "assistant", 0).otherwise(n))
    made = F.sum(F.when(F.col("role") == "assistant", n).otherwise(0))
    rows = turns.groupBy("conv_id").agg(sent.alias("input_tokens"), made.alias("output_tokens"))
    price = (F.col("input_tokens") * input_price + F.col("output_tokens") * output_price) / 1_000_000
    return rows.select("conv_id", F.col("input_tokens").cast("long").alias("input_tokens"), F.col("output_tokens").cast("long").alias("output_tokens"), F.round(price, 9).alias("cost"))


def rate_limited(events: DataFrame, limit: int) -> DataFrame:
    """Users with more events in an hour than the limit."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return events.groupBy("user_id", hour.alias("hour")).agg(F.count("*").alias("n")).where(F.col("n") > limit)


def outcome_rates(events: DataFrame) -> DataFrame:
    """Share of each event type in a user's events, as ratios of conditional counts in one grouping."""
    n = F.count("*")
    share = [F.round(F.sum(F.when(F.col("event_type") == x, 1).otherwise(0)) / n, 6).alias(f"{x}_rate") for x in ("purchase", "error", "signup")]
    return events.groupBy("user_id").agg(n.alias("n"), *share)


def history(turns: DataFrame) -> DataFrame:
    """Each turn with the role before it and the characters so far."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    so_far = F.sum(F.length("text").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return turns.select("conv_id", "turn", "role", F.lag("role").over(order).alias("previous_role"), so_far.alias("chars_so_far"))


def repeated_lines(docs: DataFrame, least: int) -> DataFrame:
    """Lines that at least so many documents have, as headers and footers do; counted with map-side sums."""
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "").distinct()
    return lines.groupBy("line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least)


def without_repeated_lines(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, text, n_dropped) without the lines that ``least`` documents have; blank lines stay.

    Texts are never taken apart and put together again by a shuffle: what travels are the repeated lines that a document
    has, which are then dropped within its row.
    """
    lines = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.trim("line") != "").distinct()
    often = lines.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("line")
    own = lines.join(often, "line").groupBy("doc_id").agg(F.collect_set("line").alias("gone"))
    every = F.split("text", "\n")
    kept = F.filter(every, lambda x: ~F.array_contains("gone", x))
    rows = docs.select("doc_id", "text").join(own, "doc_id", "left")
    return rows.select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size(every) - F.size(kept)).cast("long").alias("n_dropped"),
    )


def by_workspace(costs: DataFrame, owners: DataFrame) -> DataFrame:
    """Conversations, tokens and cost of each workspace; ``owners``: (conv_id, workspace_id)."""
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens")]
    return costs.join(owners, "conv_id").groupBy("workspace_id").agg(F.count("*").alias("conversations"), *sums, F.round(F.sum("cost"), 9).alias("cost"))


def outcomes_by_workspace(events: DataFrame) -> DataFrame:
    """Shares of what was deflected, escalated and accepted in each workspace; ``events``: (workspace_id, outcome)."""
    share = [F.round(F.count(F.when(F.col("outcome") == x, 1)) / F.count("*"), 6).alias(x) for x in ("deflected", "escalated", "accepted")]
    return events.groupBy("workspace_id").agg(F.count("*").alias("n"), *share)
