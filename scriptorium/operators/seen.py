"""Tables of earlier runs that aren't shuffled to be asked, and what those runs have settled.

A table's rows lie in files by hash of one column, so a join on it moves only the asking run's own rows; where the table is
large and the run small, Spark filters its scan by a Bloom filter of what the run asks for. Runs are numbered partitions: a
run asks those before its own number, and writing replaces its own partition, so a run that is repeated neither sees itself
nor counts twice. Older runs can be merged, which leaves one file a bucket.
"""

from __future__ import annotations

import uuid
from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import drop_path, hadoop, settle

#: Files of a run; as many tasks read the table at least.
BUCKETS = 16
#: The number of the partition that merged runs go to.
MERGED = -1


class BucketedRuns:
    """The table at a path, of columns told in DDL and dealt by one of them; any session finds it again."""

    def __init__(self, spark: SparkSession, path: str, columns: str, by: str, buckets: int = BUCKETS):
        self.path, self.by, self.buckets = path, by, buckets
        self.names = [c.split()[0] for c in columns.split(", ")]
        self.name = f"runs_{sha1(path.encode()).hexdigest()[:16]}_{buckets}"
        if not spark.catalog.tableExists(self.name):
            fs, system = hadoop(spark, path)
            system.mkdirs(fs.Path(path))
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, batch BIGINT) USING parquet PARTITIONED BY (batch) CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
            spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def before(self, spark: SparkSession, number: int) -> DataFrame:
        """Rows of all runs before one, without their numbers."""
        return self.numbered(spark, number).select(*self.names)

    def numbered(self, spark: SparkSession, number: int) -> DataFrame:
        return spark.table(self.name).where(F.col("batch") < number)

    def write(self, rows: DataFrame, number: int) -> None:
        """Keep rows as those of a run, in place of what that run has kept before."""
        spark, view = rows.sparkSession, f"rows_{uuid.uuid4().hex}"
        rows.select(*self.names).repartition(self.buckets, self.by).createOrReplaceTempView(view)
        spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = {number}) SELECT {', '.join(self.names)} FROM {view}")
        spark.catalog.dropTempView(view)

    def merge(self, spark: SparkSession, number: int) -> None:
        """Bring all runs before one into a single partition, equal rows once."""
        old = [r["batch"] for r in self.numbered(spark, number).where(F.col("batch") != MERGED).select("batch").distinct().collect()]
        kept, path = settle(self.before(spark, number).distinct(), "merged-runs")
        self.write(kept, MERGED)
        drop_path(spark, path)
        for b in old:
            spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (batch = {b})")
            drop_path(spark, f"{self.path}/batch={b}")


class SeenTable(BucketedRuns):
    """Keys that earlier runs have settled."""

    def __init__(self, spark: SparkSession, path: str, key: str = "seen_key", buckets: int = BUCKETS):
        super().__init__(spark, path, f"{key} STRING", key, buckets)
        self.key = key

    def unseen(self, df: DataFrame, number: int) -> DataFrame:
        """The rows of df whose key no earlier run has settled; null keys are never seen."""
        met = self.before(df.sparkSession, number).join(df.select(self.key), self.key, "left_semi").distinct()
        return df.join(met, self.key, "left_anti")

    def remember(self, df: DataFrame, number: int) -> None:
        """Keep the keys of df as those of a run."""
        self.write(df.where(F.col(self.key).isNotNull()).select(self.key).distinct(), number)
