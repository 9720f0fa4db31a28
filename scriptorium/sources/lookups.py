"""Point, edge and entity look-ups over landed records: semi-joins and ranked aggregates, no calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import blank, filled
from scriptorium.operators.authors import affinity
from scriptorium.operators.enrich import same_work
from scriptorium.operators.topk import best_per_group


def by_ids(papers: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Records whose identifier is listed (S03): a semi-join, whatever the list's size."""
    return papers.join(ids.select(key).distinct(), key, "left_semi")


def batch(papers: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """A row for each asked identifier, with null fields for those not found."""
    return ids.select(key).join(papers.dropDuplicates([key]), key, "left")


def first_found(papers: DataFrame, **ids: str) -> DataFrame:
    """The record of the first identifier (in the order given) that is known."""
    rank = F.lit(None).cast("int")
    for i, (name, value) in reversed(list(enumerate(ids.items()))):
        rank = F.when(F.lower(F.col(name)) == value.lower(), i).otherwise(rank)
    return papers.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", "title").limit(1).drop("_rank")


def by_title(papers: DataFrame, title_key: str, least: float = 0.9) -> DataFrame:
    """The record whose title key is nearest to one that is asked for, if it can be the same work."""
    from scriptorium.functions.text import title_similarity

    near = papers.where(same_work(F.col("title_key"), F.lit(title_key), least))
    return near.withColumn("similarity", title_similarity(F.col("title_key"), F.lit(title_key))).orderBy(F.desc("similarity"), "title_key").limit(1)


def by_author(papers: DataFrame, author_ids: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """An author's records within a window of dates."""
    out = papers.where(F.arrays_overlap("author_ids", F.array(*[F.lit(i) for i in author_ids])))
    on = F.col("publication_date")
    if start:
        out = out.where(on.isNull() | (on >= start))
    return out.where(on.isNull() | (on <= end)) if end else out


def in_sources(papers: DataFrame, keys: list[str], start: str | None = None) -> DataFrame:
    """Records of some venues, from a day on."""
    out = papers.where(F.col("venue_key").isin(*keys))
    return out.where(F.col("publication_date") >= start) if start else out


def citing(papers: DataFrame, edges: DataFrame, cited: str, key: str) -> DataFrame:
    """Records that cite one (S03, S10). edges: (src, dst), src citing dst."""
    return papers.join(edges.where(F.col("dst") == cited).select(F.col("src").alias(key)).distinct(), key, "left_semi")


def related(papers: DataFrame, links: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """Records that a source calls related to the seeds, or recommends after them."""
    found = links.join(seeds.select(F.col(key).alias("src")), "src", "left_semi").select(F.col("dst").alias(key)).distinct()
    return papers.join(found, key, "left_semi").join(seeds.select(key), key, "left_anti")


def resolve_author(works: DataFrame, candidates: DataFrame, keywords: tuple[str, ...], key: str = "author_id") -> DataFrame:
    """Candidates of a name with their affinity to the keywords, the best first."""
    ranked = candidates.join(affinity(works, keywords, key), key, "left")
    return ranked.withColumn("affinity", F.coalesce("affinity", F.lit(0))).orderBy(F.desc("affinity"), key)


def venue_source_ids(sources: DataFrame, venue: str, k: int = 3) -> DataFrame:
    """The k sources with most works whose name holds a venue's."""
    return sources.where(F.lower("display_name").contains(venue.lower())).orderBy(F.desc("works_count"), "id").limit(k)


def preferred_document(arxiv: DataFrame, mirror: DataFrame, pmc: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, source, page): the full text of the first place that has one with sections."""
    usable = lambda df, name, fits: df.select(key, F.when(fits, F.col("page")).alias(name))
    html = F.col("page").contains("ltx_section")
    one = usable(arxiv, "a", html).join(usable(mirror, "m", html), key, "full").join(usable(pmc, "p", ~blank(F.col("page"))), key, "full")
    source = F.when(F.col("a").isNotNull(), "arxiv_html").when(F.col("m").isNotNull(), "ar5iv").when(F.col("p").isNotNull(), "pmc")
    return one.select(key, source.alias("source"), F.coalesce("a", "m", "p").alias("page")).where("source is not null")


def source_merge(records: DataFrame, key: str, priority: tuple[str, ...], fields: tuple[str, ...], source: str = "source") -> DataFrame:
    """One row for each key: every field from the first source (by priority) that fills it."""
    ranks = F.create_map(*[F.lit(x) for i, s in enumerate(priority) for x in (s, i)])
    rank = F.coalesce(F.try_element_at(ranks, F.col(source)), F.lit(len(priority)))
    order = F.struct(rank, F.col(source))
    text = {f.name for f in records.schema.fields if f.dataType.typeName() == "string"}
    value = lambda n: filled(F.col(n)) if n in text else F.col(n)
    return records.groupBy(key).agg(*[F.min_by(value(n), F.when(value(n).isNotNull(), order)).alias(n) for n in fields])


def apply_patches(items: DataFrame, patches: DataFrame, fields: tuple[str, ...], key: str = "key", version: str = "version") -> DataFrame:
    """Items with patches applied where the patch was made for the item's own version; others are left, and told.

    patches: (key, version, fields). Each applied patch raises the version. conflict tells a patch that came too late.
    """
    p = best_per_group(patches, key, F.desc(version)).select(key, F.col(version).alias("_for"), *[F.col(n).alias(f"_{n}") for n in fields])
    j = items.join(p, key, "left")
    fits = F.coalesce(F.col("_for") == F.col(version), F.lit(False))
    changed = {n: F.when(fits & F.col(f"_{n}").isNotNull(), F.col(f"_{n}")).otherwise(F.col(n)) for n in fields}
    late = F.col("_for").isNotNull() & ~fits
    return j.withColumns(changed | {"conflict": late, version: F.when(fits, F.col(version) + 1).otherwise(F.col(version))}).select(*items.columns, "conflict")


def difference(a: Column, b: Column) -> Column:
    """Values of one list that another lacks."""
    return F.array_except(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))


def complete_bibliography(entries: DataFrame, trusted: DataFrame, looked_up: DataFrame, most: int = 15, shortest: int = 12) -> DataFrame:
    """(doc_id, bid, title): titles of entries from trusted records, else from look-ups of the first `most` long ones."""
    joined = entries.join(trusted.select("doc_id", "bid", F.col("title").alias("known")), ["doc_id", "bid"], "left")
    missing = best_per_group(joined.where(F.col("known").isNull() & (F.length("title_key") >= shortest)), "doc_id", F.col("bid"), k=most)
    found = missing.join(looked_up.select(F.col("title_key").alias("hit_key"), F.col("title").alias("hit")), F.col("hit_key") == F.col("title_key")).select("doc_id", "bid", "hit")
    return joined.join(found, ["doc_id", "bid"], "left").select("doc_id", "bid", F.coalesce("known", "hit").alias("title")).where("title is not null")


def newest_model(names: DataFrame, family: str, name: str = "name") -> DataFrame:
    """The newest stable model of a family, by its version as numbers."""
    said = F.regexp_extract(name, rf"^{family}-(\d+(?:\.\d+)*)$", 1)
    fits = names.withColumn("_v", said).where("_v <> ''")
    version = F.transform(F.split("_v", r"\."), lambda x: x.cast("int"))
    return fits.agg(F.max_by(name, version).alias(name))
