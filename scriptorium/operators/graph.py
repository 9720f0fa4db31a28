"""Citation graphs as edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.session import settle


def expand(seeds: DataFrame, edges: dict[str, DataFrame], seed_key: str = "seed_id") -> DataFrame:
    """(seed, paper_id, relations): papers one edge away, with the kinds of edges that lead to them.

    edges: by relation, (src, dst) with dst the paper found.
    """
    s = seeds.select(F.col(seed_key).alias("src")).distinct()
    tagged = [e.join(s, "src").select(F.col("src").alias(seed_key), F.col("dst").alias("paper_id"), F.lit(kind).alias("relation")) for kind, e in edges.items()]
    found = reduce(DataFrame.unionByName, tagged).where(F.col(seed_key) != F.col("paper_id"))
    return found.groupBy(seed_key, "paper_id").agg(F.array_sort(F.collect_set("relation")).alias("relations"))


def cocitations(members: DataFrame, references: DataFrame, least: int = 2, known: DataFrame | None = None) -> DataFrame:
    """(ref, citing): works that at least `least` members refer to, without those known.

    members: (member); references: (member, ref). Counts are partial before the shuffle, so a work that all members
    refer to is no skew; the known ones leave by an anti-join after the count has thinned the rows.
    """
    cited = references.join(members.select("member").distinct(), "member", "left_semi").select("member", "ref").distinct()
    counted = cited.groupBy("ref").agg(F.count("*").alias("citing")).where(F.col("citing") >= least)
    return counted if known is None else counted.join(known.select("ref").distinct(), "ref", "left_anti")


def relationship(base: Column, year: Column, citations: Column, topics: Column, subtopics: Column, seed_year: int | None, seed_topics: tuple[str, ...]) -> Column:
    """What a record is to the seed it was found from."""
    own = F.coalesce(year, F.lit(0))
    unsure = F.array_contains(topics, "uncertainty") & F.lit("uncertainty" not in seed_topics)
    older = (own < (seed_year or 9999) - 1) | (F.coalesce(citations, F.lit(0)) > 200)
    return (
        F.when(F.array_contains(subtopics, "type:benchmark-dataset"), "benchmark/dataset")
        .when((base == "citing") & unsure, "uncertainty/reliability extension")
        .when(base == "reference", F.when(older, "foundational predecessor").otherwise("direct competitor"))
        .when(base == "citing", "methodological follow-up")
        .when(base == "similar", F.when(F.abs(own - (seed_year or 0)) <= 1, "direct competitor").otherwise("related work"))
        .otherwise(F.coalesce(F.when(base != "", base), F.lit("related")))
    )


def without_seed(df: DataFrame, seed_key: str, title_key: str = "title_key") -> DataFrame:
    """Rows but those of the seed itself, under whatever identifier."""
    return df.where(F.col(title_key) != seed_key)


def short_name_match(title_head: Column, title_key: Column, query_key: str) -> Column:
    """Whether a title goes by a short name: its part before a colon, or its first three words or more."""
    long = F.lit(len(query_key.split()) >= 3) & title_key.startswith(query_key)
    return F.lit(len(query_key) >= 3) & ((title_head == query_key) | long)


def with_paths(nodes: DataFrame, key: str = "key", name: str = "name", parent: str = "parentCollection", deleted: str = "deleted") -> DataFrame:
    """(key, path, level, gone): paths of a tree from parent pointers; what hangs below a deleted node is gone too.

    A level is one join, written before the next; the loop ends with the tree, however deep. Nodes on a cycle, or below a
    parent that doesn't exist, have no path.
    """
    n = nodes.select(F.col(key).alias("k"), F.col(name).alias("name"), F.col(parent).alias("parent"), F.coalesce(F.col(deleted), F.lit(False)).alias("own_gone"))
    below, _ = settle(n.where(F.col("parent").isNull() | (F.col("parent") == "")).select("k", F.col("name").alias("path"), F.lit(0).alias("level"), F.col("own_gone").alias("gone")), "level")
    levels = [below]
    while not below.isEmpty():
        up = below.select(F.col("k").alias("parent"), F.col("path").alias("up"), F.col("gone").alias("up_gone"))
        below, _ = settle(n.join(up, "parent").select("k", F.concat_ws("/", "up", "name").alias("path"), F.lit(len(levels)).alias("level"), (F.col("own_gone") | F.col("up_gone")).alias("gone")), "level")
        levels.append(below)
    return reduce(DataFrame.unionAll, levels).withColumnRenamed("k", key)


def missing_levels(paths: DataFrame, existing: DataFrame, column: str = "path") -> DataFrame:
    """(path, level): every level of the paths that doesn't exist, in the order in which to make them."""
    parts = F.split(F.col(column), "(?<! )/(?! )")
    levels = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), i.alias("level")))).alias("l")).select("l.*").distinct()
    return levels.join(existing.select(F.col(column).alias("path")), "path", "left_anti").orderBy("level", "path")


def resolve_path(paths: DataFrame, wanted: str, root: str, column: str = "path") -> DataFrame:
    """The rows whose path is the wanted one, or ends in its segments, those under the root first.

    One row is an answer; none or several tell that the name is unknown or ambiguous.
    """
    want = [s.lower() for s in wanted.strip().strip("/").split("/") if s]
    own = F.transform(F.filter(F.split(F.col(column), "(?<! )/(?! )"), lambda s: s != ""), F.lower)
    asked = F.array(*[F.lit(s) for s in want])
    exact = (own == asked) | (own == F.concat(F.array(F.lit(root.lower())), asked))
    ends = (F.size(own) >= len(want)) & (F.slice(own, -len(want), len(want)) == asked)
    under = F.get(own, F.lit(0)) == root.lower()
    ranked = paths.withColumn("fit", F.when(exact, 0).when(ends & under, 1).when(ends, 2)).where("fit is not null")
    return ranked.join(F.broadcast(ranked.agg(F.min("fit").alias("fit"))), "fit").drop("fit")
