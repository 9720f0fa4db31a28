"""A sink whose items and audit lines appear together or not at all.

`df.write.format("ledger")` stages a file for each task: rows go in chunks of CHUNK through a gate, which may refuse single
items, or a whole chunk by raising Refused. A file gets its name when its task ends, and what a run staged is seen only
once the driver has committed the run's manifest, by one rename. A killed task, a lost executor or a crashed driver
therefore leaves nothing that readers see, and running again writes each item once. A refused chunk stops what follows:
the manifest takes the parts before it and the chunks before it in its own part, in the order of the rows, and tells it.

Layout: `staged/run=.../` with a Parquet file for each task, `manifests/` with a JSON file for each run, a line a file. An
item and its audit line are one row, so neither can be without the other. One writer at a time is expected of a path.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from importlib import import_module

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from scriptorium.session import path_exists

#: Items that are sent together; rows that a task holds before it writes them.
CHUNK, HELD = 50, 5_000
#: What a gate says of each row of a chunk, and the argument it is given.
Gate = Callable[[list[dict], str], list[bool]]
_ROW = "key string, item_id string, decision string, item string, collections array<string>, chunk int, refused boolean, file string"
_ARROW = pa.schema([("key", pa.string()), ("item_id", pa.string()), ("decision", pa.string()), ("item", pa.string()), ("collections", pa.list_(pa.string())), ("chunk", pa.int32()), ("refused", pa.bool_()), ("file", pa.string())])
_MANIFEST = "run string, file string, part int, chunks int, message string"


class Refused(Exception):
    """A target that takes no more of a chunk."""


def documents(chunk: list[dict], _: str) -> list[bool]:
    """The gate where none is named: items are JSON objects."""
    return [bool(row["item"]) and row["item"].lstrip().startswith("{") for row in chunk]


def file_system(path: str):
    """(file system, path in it) of a path or an address."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


@dataclass
class Staged(WriterCommitMessage):
    """What a task staged: its file, how many chunks of it are whole, and why it stopped, if it did."""

    part: int
    file: str
    chunks: int
    message: str | None


class LedgerWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.run = options["path"].rstrip("/"), options["run"]
        self.gate, self.argument = options.get("gate", f"{__name__}:documents"), options.get("argument", "")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        import pyarrow.parquet as pq

        module, _, name = self.gate.partition(":")
        gate: Gate = getattr(import_module(module), name)
        system, root = file_system(self.path)
        file = uuid.uuid4().hex
        folder = f"{root}/staged/run={self.run}"
        system.create_dir(folder, recursive=True)
        chunks, message, held = 0, None, []
        with system.open_output_stream(f"{folder}/_{file}") as out, pq.ParquetWriter(out, _ARROW, compression="zstd") as writer:
            for chunk in _chunks(iterator):
                try:
                    fits = gate(chunk, self.argument)
                except Refused as e:
                    message = f"chunk {chunks + 1} was refused, nothing after it was sent: {e}"
                    break
                held += [row | {"chunk": chunks, "refused": not fit, "file": file} for row, fit in zip(chunk, fits, strict=True)]
                chunks += 1
                if len(held) >= HELD:
                    writer.write_table(pa.Table.from_pylist(held, _ARROW))
                    held = []
            writer.write_table(pa.Table.from_pylist(held, _ARROW))
        system.move(f"{folder}/_{file}", f"{folder}/{file}.parquet")
        return Staged(TaskContext.get().partitionId(), file, chunks, message)

    def commit(self, messages: list[Staged | None]) -> None:
        """Publish by one rename the parts up to the first that stopped."""
        lines = []
        for m in sorted((m for m in messages if m), key=lambda m: m.part):
            lines.append(json.dumps({"run": self.run, "file": m.file, "part": m.part, "chunks": m.chunks, "message": m.message}))
            if m.message:
                break
        system, root = file_system(self.path)
        system.create_dir(f"{root}/manifests", recursive=True)
        with system.open_output_stream(f"{root}/manifests/_{self.run}") as out:
            out.write("\n".join(lines).encode())
        system.move(f"{root}/manifests/_{self.run}", f"{root}/manifests/{self.run}.json")

    def abort(self, messages: list[Staged | None]) -> None:
        system, root = file_system(self.path)
        for m in messages:
            if m:
                system.delete_file(f"{root}/staged/run={self.run}/{m.file}.parquet")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for batch in batches:
        for begin in range(0, batch.num_rows, HELD):
            held += batch.slice(begin, HELD).to_pylist()
            while len(held) >= CHUNK:
                yield held[:CHUNK]
                held = held[CHUNK:]
    if held:
        yield held


class Ledger(DataSource):
    """spark.write.format("ledger"), with options path, run and, if items pass a gate of one's own, gate (module:name) and argument."""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def writer(self, schema: StructType, overwrite: bool) -> LedgerWriter:
        if overwrite:
            raise ValueError("a ledger only grows: mode must be append")
        return LedgerWriter(dict(self.options))


def append(planned: DataFrame, path: str, gate: str | None = None, argument: str = "") -> str:
    """Write (key, item_id, decision, item, collections) rows in the order of their keys as one run, and return its name."""
    spark = planned.sparkSession
    spark.dataSource.register(Ledger)
    run = uuid.uuid4().hex
    rows = planned.select("key", "item_id", "decision", "item", "collections").repartitionByRange("key").sortWithinPartitions("key")
    writer = rows.write.format("ledger").option("path", path).option("run", run).option("argument", argument)
    (writer.option("gate", gate) if gate else writer).mode("append").save()
    return run


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, f"{path}/manifests"):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).json(f"{path}/manifests")


def published(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """Rows of all runs whose manifests stand, or of one; nothing else that lies in the folder."""
    manifests = _manifests(spark, path).select("run", "file", "chunks")
    if not path_exists(spark, f"{path}/staged"):
        return spark.createDataFrame([], f"{_ROW}, run string")
    rows = spark.read.schema(f"{_ROW}, run string").parquet(f"{path}/staged")
    if run:
        rows, manifests = rows.where(F.col("run") == run), manifests.where(F.col("run") == run)
    return rows.join(manifests, ["run", "file"]).where("chunk < chunks").drop("chunks")


def items(spark: SparkSession, path: str) -> DataFrame:
    """(key, item_id, decision, item, collections) of everything written."""
    return published(spark, path).where("not refused").select("key", "item_id", "decision", "item", "collections")


def audit(spark: SparkSession, path: str) -> DataFrame:
    """(key, action, item_id, run), a line for each item."""
    return published(spark, path).where("not refused").select("key", F.lit("create").alias("action"), "item_id", "run")


def errors(spark: SparkSession, path: str) -> DataFrame:
    """(run, key, message): chunks that stopped a run, and single items that were refused."""
    stopped = _manifests(spark, path).where("message is not null").select("run", F.lit(None).cast("string").alias("key"), "message")
    return stopped.unionByName(published(spark, path).where("refused").select("run", "key", F.lit("the item was refused").alias("message")))
