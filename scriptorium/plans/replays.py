"""Queries on streams whose last micro-batch runs again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.plans.registry import query
from scriptorium.session import drop_path, hadoop, scratch_path, table
from scriptorium.streaming import flows
from scriptorium.streaming.library import CHANGE, keep_library, library


def lose_last_commit(spark: SparkSession, checkpoint: str) -> None:
    """Take the last commit from a stream's checkpoint, as a crash before it would have left it."""
    fs, system = hadoop(spark, checkpoint)
    numbers = [int(f.getPath().getName()) for f in system.listStatus(fs.Path(f"{checkpoint}/commits")) if f.getPath().getName().isdigit()]
    for name in (f"{max(numbers)}", f".{max(numbers)}.crc"):
        drop_path(spark, f"{checkpoint}/commits/{name}")


@query("SELECT DISTINCT user_id FROM events")
def stream_seen_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a stream settles, when its last micro-batch is run again after its commit was lost."""
    out = scratch_path(spark, "seen-again")
    table(spark, sf_dir, "events").repartition(3, F.col("event_id") % 3).write.parquet(f"{out}/in")
    for _ in range(2):
        events = flows.read_stream(spark, f"{out}/in", files_per_batch=1)
        flows.seen_batches(events.select(F.col("user_id").cast("string").alias("seen_key")), f"{out}/out", f"{out}/checkpoint", F.lit(True))
        lose_last_commit(spark, f"{out}/checkpoint")
    return spark.read.schema("seen_key string").parquet(f"{out}/out/rows").select(F.col("seen_key").cast("long").alias("user_id"))


_CHANGES_SQL = """e AS (SELECT event_id AS seq, 'c' || user_id % 7 AS cache, 'k' || user_id AS key, event_type AS t, value FROM events),
o AS (SELECT *, count(*) FILTER (WHERE t = 'error' AND seq % 50 = 0) OVER (PARTITION BY cache ORDER BY seq) AS owner FROM e WHERE t <> 'error' OR seq % 50 < 2),
last AS (SELECT cache, max(owner) AS owner, arg_max(t = 'error' AND seq % 50 = 1, seq) AS stale FROM o GROUP BY 1),
c AS (SELECT o.* FROM o JOIN last USING (cache, owner) WHERE t <> 'error'),
k AS (SELECT cache, key, arg_max(t, seq) AS t, arg_max(seq, seq) AS seq FROM c GROUP BY 1, 2)"""


@query(f"""WITH {_CHANGES_SQL} SELECT cache, key, 'i' || seq AS item, stale FROM k JOIN last USING (cache) WHERE t NOT IN ('signup', 'purchase')""")
def library_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Libraries kept by a stream of changes: items come, are trashed or deleted, owners change, refreshes fail; the last batch runs twice."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("c"), F.col("user_id") % 7).alias("cache"), F.concat(F.lit("k"), "user_id").alias("name"), F.col("event_type").alias("t"))
    switch, fails = (F.col("t") == "error") & (F.col("seq") % 50 == 0), (F.col("t") == "error") & (F.col("seq") % 50 == 1)
    owner = F.concat(F.lit("o"), F.count(F.when(switch, 1)).over(Window.partitionBy("cache").orderBy("seq"))).alias("owner")
    op = F.when(switch, "owner").when(fails, "failed").when(F.col("t") == "purchase", "delete").when(F.col("t") != "error", "upsert")
    rows = e.select("cache", "seq", op.alias("op"), owner, F.col("name").alias("key"), F.col("seq").alias("version"), (F.col("t") == "signup").alias("deleted"), F.concat(F.lit("i"), "seq").alias("item")).where("op is not null")
    out = scratch_path(spark, "library")
    rows.repartitionByRange(3, "seq").sortWithinPartitions("seq").write.parquet(f"{out}/in")
    files = sorted(r[0] for r in spark.read.parquet(f"{out}/in").select(F.input_file_name()).distinct().collect())
    fs, system = hadoop(spark, out)
    system.mkdirs(fs.Path(f"{out}/landed"))
    for f in [*files, None]:
        if f:
            system.rename(fs.Path(f), fs.Path(f"{out}/landed/{f.rpartition('/')[2]}"))
        else:
            lose_last_commit(spark, f"{out}/checkpoint")
        keep_library(spark.readStream.schema(CHANGE).parquet(f"{out}/landed"), f"{out}/rows", f"{out}/checkpoint")
    return library(spark, f"{out}/rows")
