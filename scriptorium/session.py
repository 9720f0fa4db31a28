"""Session helpers: tables, the shared scratch folder, and materialised steps that survive lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: dict[str, SparkSession] = {}


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false")
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by Spark's own reader, so any store that Spark reaches will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores: a reader gives a few MB to one task, however much work their rows are."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


#: Rows that an exchange deals to a task, where a step is told how many there are.
ROWS_A_TASK = 500_000


def tasks_of(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows: as many as there are cores at least, and so many that none gets more than its share."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; on a local master that sets none, one of our own."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="scriptorium-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; dropped with drop_path() or when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def hadoop(spark: SparkSession, path: str):
    """(Hadoop's fs package, the file system of a path), wherever it is."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    return fs, fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path."""
    fs, system = hadoop(spark, path)
    system.delete(fs.Path(path), True)
    _written.pop(path, None)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, system = hadoop(spark, path)
    return system.exists(fs.Path(path))


@contextmanager
def shuffle_files_dropped(spark: SparkSession):
    """Within: an action's shuffle files go when it ends, so a written step doesn't hold its input twice."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


@contextmanager
def _held(spark: SparkSession, settings: dict[str, str]):
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def dealt_by_rows(spark: SparkSession, rows: int):
    """Within: an action's exchanges have tasks in proportion to rows, so what one of them holds doesn't grow with the table.

    Nothing is brought together again by bytes: rows of many equal or missing values are small when compressed, not when sorted.
    """
    return _held(spark, {"spark.sql.shuffle.partitions": str(tasks_of(spark, rows)), "spark.sql.adaptive.coalescePartitions.enabled": "false"})


def settle(df: DataFrame, label: str = "step", compression: str = "zstd", rows: int | None = None) -> tuple[DataFrame, str]:
    """Write a frame to the shared folder and read it back: lineage is cut, and lost executors cost nothing. rows: how many
    its steps handle; tasks are then dealt by them (dealt_by_rows)."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with shuffle_files_dropped(spark), dealt_by_rows(spark, rows) if rows else nullcontext():
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@atexit.register
def _sweep() -> None:
    for path, spark in list(_written.items()):
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have ended first
            local = path.removeprefix("file://")
            if os.path.isdir(local) and "scriptorium-" in local:
                import shutil

                shutil.rmtree(local, ignore_errors=True)
