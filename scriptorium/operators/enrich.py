"""Look-up joins that fill in records: plain, guarded by a title, and to a published version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import blank, distinguishing_tokens, title_similarity


def lookup(df: DataFrame, table: DataFrame, on: str | list[str], fill: dict[str, str], guard: Column | None = None) -> DataFrame:
    """df with its missing fields filled from a table of one row for each key (J08); with a guard, only where it holds.

    fill: field of df, and the table's column that fills it. Column names of the table must differ from df's.
    """
    keys = [on] if isinstance(on, str) else on
    joined = df.join(table.withColumn("_met", F.lit(True)), keys, "left")
    ok = F.coalesce(F.col("_met"), F.lit(False)) & (F.lit(True) if guard is None else F.coalesce(guard, F.lit(False)))
    text = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    missing = lambda n: blank(F.col(n)) if n in text else F.col(n).isNull()
    filled = {n: F.when(missing(n) & ok, F.col(c)).otherwise(F.col(n)) for n, c in fill.items()}
    return joined.withColumns(filled).select(*df.columns)


def titles_agree(a: Column, b: Column, letters: int = 40) -> Column:
    """The guard of a look-up by identifier: title keys begin alike."""
    return F.substring(a, 1, letters) == F.substring(b, 1, letters)


def promising(df: DataFrame, relevance: str = "relevance_score", least: float = 0.3) -> Column:
    """Records worth a look-up: relevant enough, of a type that can be read, and with something missing."""
    lacking = blank(F.col("abstract")) | blank(F.col("venue")) | F.col("citation_count").isNull()
    return (F.col(relevance) >= least) & ~F.col("scores.excluded_type") & lacking


#: The least similarity of a preprint's title and its published version's.
SAME_TITLE = 0.96


def same_work(a: Column, b: Column, least: float) -> Column:
    """Title keys of one work: equal distinguishing tokens and similar enough."""
    return (a != "") & (b != "") & (distinguishing_tokens(a) == distinguishing_tokens(b)) & (title_similarity(a, b) >= least)


def published_version(preprints: DataFrame, hits: DataFrame, key: str = "paper_id", hits_taken: int = 3) -> DataFrame:
    """(key, published_id): the first of a preprint's first hits that is a journal or conference paper of its title, not
    older (J10). hits: (key, place, hit_id, hit_key, hit_type, hit_year), found by title."""
    near = hits.where((F.col("place") < hits_taken) & F.col("hit_type").isin("journal", "conference"))
    met = preprints.select(key, "title_key", "year").join(near, key)
    dated = met.where(F.coalesce(F.col("hit_year"), F.lit(0)) >= F.coalesce(F.col("year"), F.lit(0)))
    a, b = F.col("title_key"), F.col("hit_key")
    # no ratio is computed where lengths, letters or tokens already tell titles apart: few pairs leave the JVM
    apart = F.floor((F.length(a) + F.length(b)) * (1 - SAME_TITLE) + 1e-9).cast("int")
    close = (F.abs(F.length(a) - F.length(b)) <= apart) & (F.levenshtein(a, b) <= apart) & (distinguishing_tokens(a) == distinguishing_tokens(b))
    ok = dated.where((a != "") & ((a == b) | close)).where(title_similarity(a, b) >= SAME_TITLE)
    return ok.groupBy(key).agg(F.min_by("hit_id", "place").alias("published_id"))


def merge_sources(records: DataFrame, key: str, priority: tuple[str, ...] = ("crossref", "pubmed", "openalex", "semantic_scholar", "arxiv")) -> DataFrame:
    """Records of one work from several sources, with source_rank: the order in which they are merged."""
    ranks = F.create_map(*[F.lit(x) for i, s in enumerate(priority) for x in (s, i)])
    return records.withColumn("source_rank", F.coalesce(F.try_element_at(ranks, F.col("source")), F.lit(len(priority))))
