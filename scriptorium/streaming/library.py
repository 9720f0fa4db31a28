"""The state of libraries, kept by a stream of their changes.

A change is a row (cache, seq, op, owner, key, version, item): `upsert` brings an item, or takes it away where `deleted` is true;
`delete` takes one away; `owner` says whose library the cache holds from now on, and empties it if that is another one;
`failed` tells that a refresh failed: what is known stays in use and is marked stale until the next change. Changes of one
cache count in the order of `seq`, and never those of another owner, nor versions behind what is known.

State is keyed by cache and shard, so that a library's items spread over SHARDS tasks: items go to the shard of their key, and
what concerns the cache as a whole goes to all of them. A shard holds its owner, its stamp and a map of its items in the
state store, one entry an item, so nothing is rewritten but what changes. Batches that run again find the state they
began with.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scriptorium.session import path_exists
from scriptorium.streaming.flows import run_batches

SHARDS = 8
#: The provider that state of several variables needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CHANGE = "cache string, seq long, op string, owner string, key string, version long, deleted boolean, item string"
UPDATE = "cache string, shard int, key string, seq long, item string, stale boolean"


class LibraryShard(StatefulProcessor):
    """What a shard of a cache holds; it gives a row for each item that came, changed or went, and one without a key for each
    stamp."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owner = handle.getValueState("owner", "owner string")
        self.items = handle.getMapState("items", "key string", "version long, item string")

    def handleInitialState(self, key, rows: pd.DataFrame, timers) -> None:
        for r in rows.itertuples(index=False):
            self.owner.update((r.owner,))
            self.items.updateValue((r.key,), (int(r.version), r.item))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        """Each item that a micro-batch names is read from the state once and written once, whatever its changes."""
        cache, shard = key
        changes = pd.concat(rows).sort_values("seq", kind="stable")
        told: dict[str, tuple] = {}
        began = mine = self.owner.get()[0] if self.owner.exists() else None
        held: dict[str, tuple | None] = {}  # the items named so far, as they now stand
        stored: dict[str, tuple | None] = {}  # the same as the state has them
        emptied, stale = False, None

        def known(name: str) -> tuple | None:
            if name not in held:
                held[name] = stored[name] = None if emptied else self.items.getValue((name,))
            return held[name]

        for r in changes[["seq", "op", "owner", "key", "version", "deleted", "item"]].itertuples(index=False):
            seq = int(r.seq)
            if r.op == "failed":
                stale = (seq, True)
                continue
            if r.op == "owner":
                if r.owner != mine:
                    names = [] if emptied else [name for (name,) in self.items.keys() if name not in held]
                    for name in (*names, *(n for n, v in held.items() if v is not None)):
                        told[name] = (seq, None)
                    held, stored, emptied = {}, {}, True
                    mine = r.owner
                stale = (seq, False)
                continue
            if mine is None:
                mine = r.owner
            if r.owner != mine or pd.isna(r.key):
                continue
            stale = (seq, False)
            before = known(r.key)
            if before is not None and int(r.version) < before[0]:
                continue
            if r.op == "delete" or r.deleted is True:
                if before is not None:
                    held[r.key] = None
                    told[r.key] = (seq, None)
            else:
                held[r.key] = (int(r.version), r.item)
                told[r.key] = (seq, r.item)
        if emptied:
            self.items.clear()
        if mine != began:
            self.owner.update((mine,))
        for name, value in held.items():
            if value is not None and value != stored[name]:
                self.items.updateValue((name,), value)
            elif value is None and stored[name] is not None:
                self.items.removeKey((name,))
        rows_out = [(cache, shard, name, seq, item, None) for name, (seq, item) in told.items()]
        if stale:
            rows_out.append((cache, shard, None, stale[0], None, stale[1]))
        yield pd.DataFrame(rows_out, columns=["cache", "shard", "key", "seq", "item", "stale"])

    def close(self) -> None:
        """Nothing is held outside the state store."""


def _shard(key, shards: int):
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def library_updates(changes: DataFrame, base: DataFrame | None = None, shards: int = SHARDS) -> DataFrame:
    """Updates of a stream of changes. base: (cache, owner, key, version, item), what is known before the first change.

    The session needs PROVIDER.
    """
    whole = F.col("op").isin("owner", "failed")
    dealt = changes.withColumn("shard", F.explode(F.when(whole, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(_shard("key", shards)))))
    start = None
    if base is not None:
        start = base.select("cache", _shard("key", shards).alias("shard"), "owner", "key", "version", "item").groupBy("cache", "shard")
    return dealt.groupBy("cache", "shard").transformWithStateInPandas(LibraryShard(), UPDATE, "update", "none", initialState=start)


def keep_library(changes: DataFrame, path: str, checkpoint: str, base: DataFrame | None = None, shards: int = SHARDS) -> None:
    """Run a stream of changes over what has landed; a micro-batch that runs again replaces its own updates."""
    spark = changes.sparkSession
    if base is not None and not path_exists(spark, f"{path}/batch=0"):
        base.select("cache", _shard("key", shards).alias("shard"), "key", F.lit(-1).cast("long").alias("seq"), "item", F.lit(None).cast("boolean").alias("stale")).write.mode("overwrite").parquet(f"{path}/batch=-1")
    name, provider = PROVIDER
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        run_batches(library_updates(changes, base, shards), lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"), checkpoint, "update")
    finally:
        spark.conf.set(name, before)


def library(spark: SparkSession, path: str) -> DataFrame:
    """(cache, key, item, stale) of what libraries hold now: the last word on each item."""
    rows = spark.read.schema(f"{UPDATE}, batch long").parquet(path)
    last = Window.partitionBy("cache", "key").orderBy(F.desc("batch"), F.desc("seq"))
    held = rows.where("key is not null").withColumn("place", F.row_number().over(last)).where("place = 1 and item is not null").drop("stale")
    stamps = rows.where("key is null").groupBy("cache").agg(F.max_by("stale", F.struct("batch", "seq")).alias("stale"))
    return held.join(stamps, "cache", "left").select("cache", "key", "item", F.coalesce("stale", F.lit(False)).alias("stale"))
