"""Caps and limits that keep the losing rows, demoted, and others that drop them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def demote_beyond(df: DataFrame, k: int, among: Column, score: str, key: str, to: str, reason: str, decision: str = "decision", why: str = "reject_reason") -> DataFrame:
    """Rows of `among` that are not the k best by score (then key) change their decision.

    The k best are found by a top-k (no global sort), and come back as a flag by a broadcast of k keys.
    """
    best = df.where(among).orderBy(F.desc(score), key).limit(k).select(key, F.lit(True).alias("is_best"))
    flagged = df.join(F.broadcast(best), key, "left")
    lost = among & F.col("is_best").isNull()
    return flagged.withColumns({why: F.when(lost, reason).otherwise(F.col(why)), decision: F.when(lost, to).otherwise(F.col(decision))}).drop("is_best")


def rate_limit(df: DataFrame, k: int, score: str = "final_score", key: str = "paper_id") -> DataFrame:
    """Accepted rows beyond the k best go to review."""
    return demote_beyond(df, k, F.col("decision") == "accept", score, key, "review", f"auto-add limit of {k} per run reached")


def request_limit(df: DataFrame, k: int, score: str = "final_score", key: str = "paper_id") -> DataFrame:
    """Accepted and reviewed rows beyond the k best are rejected."""
    return demote_beyond(df, k, F.col("decision").isin("accept", "review"), score, key, "reject", f"beyond the requested limit of {k}")


def adjudication_band(df: DataFrame, threshold: float, k: int, score: str = "final_score", key: str = "paper_id", margin: float = 0.1) -> DataFrame:
    """The k best of those in review, or accepted within a margin of the threshold."""
    near = (F.col("decision") == "review") | ((F.col("decision") == "accept") & (F.col(score) < threshold + margin))
    return df.where(near).orderBy(F.desc(score), key).limit(k)


def near_misses(df: DataFrame, least: float = 0.55, k: int = 15, score: str = "final_score", key: str = "paper_id") -> DataFrame:
    """The k best rejected rows above a score that weren't rejected outright."""
    return df.where((F.col("decision") == "reject") & (F.col(score) >= least) & ~F.col("hard_rejected")).orderBy(F.desc(score), key).limit(k)


def top_with_overflow(df: DataFrame, k: int, score: str, key: str) -> DataFrame:
    """The k best rows, and on each how many more there are."""
    total = df.agg(F.count("*").alias("n_all"))
    return df.orderBy(F.desc(score), key).limit(k).crossJoin(F.broadcast(total)).withColumn("overflow", F.greatest(F.lit(0).cast("long"), F.col("n_all") - k)).drop("n_all")


def best_per_group(df: DataFrame, group: str | list[str], *order: Column, k: int = 1) -> DataFrame:
    """The first k rows of each group (W06, W07); Spark limits them before the shuffle."""
    groups = [group] if isinstance(group, str) else group
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("place") <= k)


def first_occurrences(values: Column) -> Column:
    """Distinct values in order of first occurrence."""
    return F.array_distinct(values)
