"""Places of rows within groups that no task has to hold whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import settle

#: monotonically_increasing_id() counts a partition's rows in its lower bits.
_ROW = (1 << 33) - 1


def places(df: DataFrame, key: str, order: str, name: str = "place") -> DataFrame:
    """df with the place of each row among those of its key, from 0, in an order; null keys are a key.

    Rows are dealt by ranges of (key, order) and sorted there, which splits a key that holds most of them; a running sum over
    the ranges of each key, a row for each, then says how many of its rows stand in ranges before. Rows that the order
    doesn't tell apart stand next to each other in any order.
    """
    at = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(key, order).sortWithinPartitions(key, order)
    rows, _ = settle(dealt.withColumns({"_part": F.shiftright(at, 33).cast("int"), "_row": at.bitwiseAND(F.lit(_ROW))}), "ranges")
    ranges = rows.groupBy(key, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(F.col(key).alias("_key"), F.col("_part").alias("_range"), (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_start"))
    met = rows.join(starts, (F.col("_part") == F.col("_range")) & F.col(key).eqNullSafe(F.col("_key")))
    return met.withColumn(name, F.col("_row") + F.col("_start")).select(*df.columns, name)


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """df with the place of each row in an order over all rows, from 0; ties stand next to each other in any order.

    Rows are dealt by ranges and sorted there; a running sum over the ranges, a row for each, says where each begins.
    """
    at = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows, _ = settle(dealt.withColumns({"_part": F.shiftright(at, 33).cast("int"), "_row": at.bitwiseAND(F.lit(_ROW))}), "ranges")
    ranges = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_row") + F.col("_start")).select(*df.columns, name)
