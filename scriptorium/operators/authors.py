"""Author names: matching, watched authors, and names shared by several author ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import normalize_author_name


def name_keys_match(a: Column, b: Column, strict: bool = False) -> Column:
    """Whether two normalized names can be one person's (J13): equal surnames, and given names that are equal, or,
    unless strict, agree in an initial or are missing."""
    x, y = F.split(a, " "), F.split(b, " ")
    first = lambda parts: F.replace(F.get(parts, F.lit(0)), F.lit("-"), F.lit(""))
    fx, fy = first(x), first(y)
    alone = (F.size(x) == 1) | (F.size(y) == 1)
    full = (F.length(fx) > 1) & (F.length(fy) > 1)
    loose = F.lit(not strict)
    given = F.when(alone, loose).when(full, fx == fy).otherwise(loose & (F.substring(fx, 1, 1) == F.substring(fy, 1, 1)))
    return F.coalesce((a != "") & (b != "") & (F.element_at(x, -1) == F.element_at(y, -1)) & given, F.lit(False))


def full_name(a: Column) -> Column:
    """What is equal of two normalized names just when name_keys_match() holds strictly: the given name, without hyphens and of
    two letters or more, and the surname; null of a name without both."""
    parts = F.split(a, " ")
    given = F.replace(F.get(parts, F.lit(0)), F.lit("-"), F.lit(""))
    return F.when((F.size(parts) > 1) & (F.length(given) > 1), F.concat_ws(" ", given, F.element_at(parts, -1)))


def name_matches(a: Column, b: Column, strict: bool = False, unicode: bool = True) -> Column:
    """name_keys_match() of raw names."""
    return name_keys_match(normalize_author_name(a, unicode), normalize_author_name(b, unicode), strict)


def byline_guard(authors: Column, name: str) -> Column:
    """Whether a byline can hold the author; an empty one can."""
    return (F.size(authors) == 0) | F.exists(authors, lambda a: name_matches(F.lit(name), a))


def watch_authors(papers: DataFrame, watched: DataFrame, key: str = "paper_id") -> DataFrame:
    """papers with author_watch, the first watched author (by position) who wrote them.

    watched: (position, name, pinned array<string> of source:id). A pinned id decides; a paper with another id of a
    source where the author is pinned is someone else's; else the full name must match. Matches are equi-joins on
    pinned ids and on the given name and surname that must be equal (full_name), so a paper meets no others who only share
    a surname. Names are normalized once each, before they are joined.
    """
    of = lambda ids: F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda p: F.substring_index(p, ":", 1))
    w = watched.withColumns({"w_sources": of(F.col("pinned")), "w_name": full_name(normalize_author_name(F.col("name")))})
    by_id = papers.select(key, F.explode("author_ids").alias("pin")).join(w.select("position", "name", F.explode("pinned").alias("pin")), "pin").select(key, "position", "name")
    # names without a pinned id need no look at the paper's: the first of them is enough
    free = w.where(F.size("w_sources") == 0).groupBy("w_name").agg(F.min("position").alias("position"), F.min_by("name", "position").alias("name"))
    others = w.where(F.size("w_sources") > 0).select("w_name", "position", "name", "w_sources")
    listed = free.select("w_name", "position", "name", F.array().cast("array<string>").alias("w_sources")).unionByName(others).where("w_name is not null")
    named = papers.select(key, of(F.col("author_ids")).alias("p_sources"), F.explode("authors").alias("author")).select(key, "p_sources", full_name(normalize_author_name(F.col("author"))).alias("w_name"))
    by_name = named.where("w_name is not null").join(listed, "w_name").where(~F.arrays_overlap("w_sources", "p_sources")).select(key, "position", "name")
    first = by_id.unionAll(by_name).groupBy(key).agg(F.min_by("name", "position").alias("found_author"))
    return papers.join(first, key, "left").withColumn("author_watch", F.coalesce("author_watch", "found_author")).drop("found_author")


def aliases_by_institution(authors: DataFrame, key: str = "author_id", name: str = "name", institutions: str = "institutions", rank: str = "rank") -> DataFrame:
    """Ids that share a name and an institution with that name's top candidate."""
    top = authors.groupBy(name).agg(F.min_by(F.struct(key, institutions), rank).alias("top"))
    return authors.join(top, name).where((F.col(key) == F.col(f"top.{key}")) | F.arrays_overlap(institutions, f"top.{institutions}")).select(name, F.col(f"top.{key}").alias("canonical_id"), key)


def affinity(works: DataFrame, keywords: tuple[str, ...], key: str = "author_id") -> DataFrame:
    """Candidates ranked by how often keywords occur in their topics and titles, then by works, up to 50."""
    pattern = "(?i)" + "|".join(keywords)
    hits = F.sum(F.regexp_count(F.concat_ws(" ", "topic", "title"), F.lit(pattern)))
    return works.groupBy(key).agg(hits.alias("hits"), F.least(F.lit(50), F.count("*")).alias("works")).withColumn("affinity", F.col("hits") * 10 + F.col("works"))
