"""Connected components of an edge table, by alternating star contraction.

Large-star: every node's larger neighbours are joined to its smallest neighbour; small-star: its smaller ones and the
node itself are. Both keep components, and repeating them ends in one star per component around its smallest node.
Neighbourhoods are only ever reduced to their minimum (partial aggregation before the shuffle), never gathered, so a
node with a third of all edges costs no task more than its share; joins back to that minimum are split by adaptive
execution. Each round is written to the shared folder, and nothing but two sums per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import drop_path, settle

#: Star contraction needs about log2(nodes) squared rounds at worst; real graphs take three to six.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(low, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node with an edge to another; component is the smallest node reachable.

    Self-links and null ends are ignored, repeated links count once; an empty edge table gives an empty result. The ends
    must be of one ordered type.
    """
    a, b = F.col(src), F.col(dst)
    ordered = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    spark = edges.sparkSession
    now, path = settle(ordered, "components")
    before = _state(now)
    for _ in range(MAX_ROUNDS if before[0] else 0):
        after, new_path = settle(_small_star(_large_star(now)), "components")
        drop_path(spark, path)
        now, path = after, new_path
        state = _state(now)
        if state == before:
            break
        before = state
    else:
        if before[0]:
            raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v"), F.col("v")).distinct())
