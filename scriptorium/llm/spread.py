"""Joins to a table with one row a key, where a few keys of the other side may hold most of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with over 1 / SHARE of all rows is dealt to tasks of its own: there are fewer than SHARE of them, so a broadcast
#: of their hashes (16 bytes each) has a proven bound. LEAST rows of a key are never too many.
SHARE, LEAST = 1_000, 100


def hot_keys(counts: DataFrame, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """(hash, salts) of counts (hash, n): the keys over the share, and how many tasks each is dealt to."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    most = max(least, total / share)
    rows = counts.where(F.col("n") > most).select("hash", F.ceil(F.col("n") / most).cast("int").alias("salts")).limit(share).collect()
    return counts.sparkSession.createDataFrame([tuple(r) for r in rows], "hash long, salts int")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], salt_by: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left joined to right, which has one row a key; rows of a hot key are dealt by the columns of salt_by.

    counts: (hash, n) by xxhash64 of the keys, if known already. A hash that two keys share only makes both hot.
    """
    hashed = F.xxhash64(*keys)
    if counts is None:
        counts = left.groupBy(hashed.alias("hash")).agg(F.count("*").alias("n"))
    hot = F.broadcast(hot_keys(counts))
    salts = F.coalesce("salts", F.lit(1))
    one = left.withColumn("hash", hashed).join(hot, "hash", "left").withColumn("salt", F.pmod(F.xxhash64(*salt_by), salts).cast("int")).drop("hash", "salts")
    each = right.withColumn("hash", hashed).join(hot, "hash", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("hash", "salts")
    return one.join(each, [*keys, "salt"], how).drop("salt")
