"""Clusters of works that are kept from run to run, and take in new records only.

A run brings records. What they can be linked by (identifiers, titles, pieces of titles) is looked up among the anchors of
all earlier records, a bucketed table that doesn't move; records that share an anchor are fetched (more than are linked: all
that hold a common piece of a new title, too), and the links among these and the new ones are found as for a whole table. Each earlier record stands for its tree, so components of the small graph
of links and roots say which trees become one, and only members of trees whose root changes are written again.

The result is that of clustering all records at once, where a record that comes later has a larger key than earlier ones
of the same title (similar titles are compared by the identifiers of their smallest key). Keys are whole numbers and new in
each run; a run that is repeated replaces what it wrote. A new record never takes an old link back: a title link that later
identifiers would veto stays until its tree is clustered again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.components import connected_components
from scriptorium.operators.dedup import all_links, anchors
from scriptorium.operators.records import with_ids, with_title_key
from scriptorium.operators.seen import BUCKETS, BucketedRuns
from scriptorium.session import settle

_IDS = "map<string,string>"


class Forest:
    """Clusters at a path."""

    def __init__(self, spark: SparkSession, path: str, key: str = "paper_id", threshold: float = 0.96, buckets: int = BUCKETS):
        self.spark, self.key, self.threshold = spark, key, threshold
        table = lambda name, columns, by: BucketedRuns(spark, f"{path}/{name}", columns, by, buckets)
        self.records = table("records", f"{key} BIGINT, ids {_IDS}, title_key STRING", key)
        self.anchors = table("anchors", f"anchor BIGINT, {key} BIGINT", "anchor")
        self.roots = table("roots", f"{key} BIGINT, root BIGINT", key)
        self.trees = table("trees", f"root BIGINT, {key} BIGINT", "root")

    def add(self, papers: DataFrame, run: int) -> None:
        """Take in the records of a run; runs are numbered from 0."""
        spark, key = self.spark, self.key
        new, _ = settle(with_title_key(with_ids(papers)).select(F.col(key).cast("long").alias(key), "ids", "title_key"), "new-records")
        own, _ = settle(anchors(new, key, self.threshold), "new-anchors")
        if self.records.before(spark, run).isEmpty():  # nothing to look up: the trees are those of the new records
            found, _ = settle(connected_components(all_links(new, key, self.threshold)), "trees-that-meet")
            changed = self._named(new, found)
        else:
            changed = self._met(new, own, run)
        changed, _ = settle(changed, "changed-roots")
        self.records.write(new, run)
        self.anchors.write(own.select(F.xxhash64("hash", "kind").alias("anchor"), key), run)
        self.trees.write(changed, run)
        self.roots.write(changed, run)

    def _named(self, new: DataFrame, found: DataFrame) -> DataFrame:
        """(key, root) of new records: the component that was found, or themselves."""
        return new.select(self.key).join(found.withColumnRenamed("node", self.key), self.key, "left").select(self.key, F.coalesce("component", self.key).alias("root"))

    def _met(self, new: DataFrame, own: DataFrame, run: int) -> DataFrame:
        """(key, root) of new records and of earlier ones whose trees get another root."""
        spark, key = self.spark, self.key
        wanted = own.select(F.xxhash64("hash", "meets").alias("anchor"))
        touched = self.anchors.before(spark, run).join(wanted, "anchor", "left_semi").select(key).distinct()
        old, _ = settle(self.records.before(spark, run).join(touched, key, "left_semi"), "touched-records")
        rooted, _ = settle(self._roots(run).join(old.select(key), key, "left_semi"), "touched-roots")
        links = all_links(new.unionByName(old), key, self.threshold)
        graph = links.unionAll(rooted.select(F.col(key).alias("src"), F.col("root").alias("dst")))
        found, _ = settle(connected_components(graph), "trees-that-meet")
        moved = rooted.select("root").distinct().join(found, F.col("root") == F.col("node")).where("root <> component").select("root", F.col("component").alias("to"))
        members = self.trees.before(spark, run).join(moved, "root").select(key, F.col("to").alias("root")).distinct()
        return self._named(new, found).unionAll(members)

    def _roots(self, run: int) -> DataFrame:
        """(key, root) before a run: the last word on each record."""
        return self.roots.numbered(self.spark, run).groupBy(self.key).agg(F.max_by("root", "batch").alias("root"))

    def clusters(self) -> DataFrame:
        """(key, cluster) of all records: the smallest key of each one's tree."""
        return self._roots(1 << 60).withColumnRenamed("root", "cluster")
