"""Plans that run alike on batches and streams, and runners for streams over landed files.

Streams read files as they land; late rows are those behind the watermark. The seen-filter of unbounded history isn't
kept in stream state: seen_batches() holds it in a bucketed table (operators/seen.py), so that rows which weren't settled
come again and the history isn't shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scriptorium.operators.seen import BUCKETS, SeenTable
from scriptorium.session import scratch_path


def tumbling(events: DataFrame, width: str, late: str = "10 days") -> DataFrame:
    """(start, event_type, n, total) by windows of event time."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str = "10 days") -> DataFrame:
    """(start, n) by overlapping windows."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n")).select("window.start", "n")


def sessions(events: DataFrame, gap: str, late: str = "10 days") -> DataFrame:
    """(user_id, start, n): runs of a user's events with less than a gap between them."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", "session_window.start", "n")


def once(events: DataFrame, key: str, late: str = "10 days") -> DataFrame:
    """Each key once: within the watermark on a stream (T03), over all rows of a batch."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def read_stream(spark: SparkSession, path: str, ts: str = "ts", files_per_batch: int | None = None) -> DataFrame:
    """A stream over parquet files, a folder's or a single one, with event time as a timestamp; files_per_batch bounds the
    rate at which landed files are taken (T08)."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else spark.readStream
    return reader.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn(ts, F.col(ts).cast("timestamp"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what has landed, into parquet files, and wait for its end."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def replay_once(spark: SparkSession, path: str) -> DataFrame:
    """Events of a path, streamed twice into one, each kept once."""
    events = read_stream(spark, path)
    out = scratch_path(spark, "stream")
    run_to_table(once(events.union(events), "event_id"), f"{out}/rows", f"{out}/state")
    return spark.read.schema(events.schema).parquet(f"{out}/rows")


def seen_batches(stream: DataFrame, path: str, checkpoint: str, settled: Column, key: str = "seen_key", buckets: int = BUCKETS) -> None:
    """New rows of each micro-batch to `path`/rows; keys of settled ones are remembered, so that others are tried again.

    A batch sees what earlier batches remembered and never its own keys, and replaces what it wrote before, so a batch that
    runs again leaves the same rows.
    """
    table = SeenTable(stream.sparkSession, f"{path}/seen", key, buckets)

    def write(batch: DataFrame, number: int) -> None:
        fixed = table.unseen(batch.dropDuplicates([key]), number).withColumn("_settled", settled)
        folder = f"{path}/rows/batch={number}"
        fixed.write.mode("overwrite").parquet(folder)
        written = batch.sparkSession.read.schema(fixed.schema).parquet(folder)
        table.remember(written.where("_settled"), number)

    run_batches(stream, write, checkpoint)


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what has landed, each micro-batch by `write`, and wait for its end."""
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def running_state(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, n, last_ts) for each key and micro-batch, from state of our own: counts so far and the latest time."""

    def update(keys, frames, state: GroupState):
        n, last = state.get if state.exists else (0, pd.Timestamp(0))
        for frame in frames:
            n, last = n + len(frame), max(last, frame["ts"].max())
        state.update((n, last))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "last_ts": [last]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} long, n long, last_ts timestamp", "n long, last timestamp", "update", GroupStateTimeout.NoTimeout)


def latest_state(updates: DataFrame, path: str, checkpoint: str) -> None:
    """Write the updates of a stateful stream, a folder for each micro-batch, over what has landed."""
    run_batches(updates, lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"), checkpoint, "update")
