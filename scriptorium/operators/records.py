"""Canonical records: one projection from raw fields, and predicates on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import blank, filled, found, is_preprint_doi, normalize_arxiv_id, normalize_doi, normalize_pmid, normalize_title, squeeze, strip_markup
from scriptorium.functions.venues import canonical_venue
from scriptorium.schema import conform


def finalize(raw: DataFrame) -> DataFrame:
    """Raw records with markup gone, identifiers and venues canonical, and what follows from them filled in."""
    df = conform(raw)
    doi = normalize_doi(F.col("doi"))
    given = F.coalesce(filled(F.col("arxiv_id")), F.when(doi.startswith("10.48550/arxiv."), doi))
    venue = canonical_venue(F.col("venue"), F.col("venue_type"))
    vague = blank(F.col("venue_key")) | (F.col("venue_key") == "unknown")
    df = df.withColumns(
        {
            "title": F.regexp_replace(strip_markup(F.col("title")), r"\.+$", ""),
            "abstract": F.regexp_replace(strip_markup(F.col("abstract")), r"(?i)^(abstract|summary)[\s:.-]+", ""),
            "doi": doi,
            "arxiv_id": normalize_arxiv_id(given),
            "pmid": normalize_pmid(F.col("pmid")),
            "authors": F.filter(F.transform("authors", squeeze), lambda a: a.isNotNull() & (a != "")),
            "year": F.coalesce(F.when(F.col("year") != 0, F.col("year")), F.substring("publication_date", 1, 4).try_cast("int")),
            "own_venue": F.when(vague, venue).otherwise(F.struct(F.col("venue_key").alias("key"), F.col("venue_type").alias("type"))),
        }
    )
    server = F.col("own_venue.key").isin("arxiv", "medrxiv")
    pdf = F.concat(F.lit("https://arxiv.org/pdf/"), F.col("arxiv_id"))
    keep_pdf = F.col("arxiv_id").isNull() | F.map_contains_key("pdf_candidates", F.lit("arxiv"))
    page = F.coalesce(
        F.when(~is_preprint_doi(F.col("doi")) | ~F.col("doi").startswith("10.48550/"), F.concat(F.lit("https://doi.org/"), F.col("doi"))),
        F.concat(F.lit("https://arxiv.org/abs/"), F.col("arxiv_id")),
        F.lit(""),
    )
    return df.withColumns(
        {
            "venue_key": F.col("own_venue.key"),
            "venue_type": F.when(server, "preprint").otherwise(F.col("own_venue.type")),
            "sources": F.when(blank(F.col("source")), F.col("sources")).otherwise(F.array_union("sources", F.array("source"))),
            "pdf_candidates": F.when(keep_pdf, F.col("pdf_candidates")).otherwise(F.map_concat("pdf_candidates", F.create_map(F.lit("arxiv"), pdf))),
            "url": F.when(blank(F.col("url")), page).otherwise(F.col("url")),
        }
    ).drop("own_venue")


def with_ids(df: DataFrame) -> DataFrame:
    """Adds ids, a map of the identifiers that a record has."""
    entries = [F.when(~blank(F.col(n)), F.struct(F.lit(n).alias("key"), F.col(n).alias("value"))) for n in ("doi", "pmid", "arxiv_id", "openalex_id", "semantic_scholar_id")]
    return df.withColumn("ids", F.map_from_entries(F.array_compact(F.array(*entries))))


def peer_reviewed(venue_type: Column) -> Column:
    return F.coalesce(venue_type.isin("journal", "conference"), F.lit(False))


def is_preprint_record(item_type: Column, ids: Column) -> Column:
    """Whether a library record is a preprint: by type, by its DOI, or by an arXiv id without a publisher's DOI."""
    doi = F.try_element_at(ids, F.lit("doi"))
    arxiv = F.try_element_at(ids, F.lit("arxiv_id"))
    return F.coalesce((item_type == "preprint") | is_preprint_doi(doi) | (arxiv.isNotNull() & blank(doi)), F.lit(False))


#: Where identifiers stand in a library item's extra field.
_EXTRA = {"arxiv_id": r"(?i)arxiv:\s*([^\s]+)", "pmid": r"(?i)pmid:\s*(\d+)", "openalex_id": r"(?i)openalex:\s*(W\d+)", "semantic_scholar_id": r"(?i)semantic scholar:\s*([0-9a-f]{40})", "doi": r"(?i)doi:\s*(10\.\S+)"}


def library_records(items: DataFrame) -> DataFrame:
    """(key, title, ids, item_type, year) of library items (F12); notes, attachments and deleted items are left out."""
    of = lambda name: found(F.col("extra"), _EXTRA[name], 1)
    live = items.where(~F.col("itemType").isin("note", "attachment", "annotation") & ~F.coalesce(F.col("deleted"), F.lit(False)))
    doi = F.coalesce(normalize_doi(F.col("DOI")), normalize_doi(of("doi")))
    arxiv = F.coalesce(
        normalize_arxiv_id(F.col("archiveID")),
        F.when(F.col("url").contains("arxiv.org"), normalize_arxiv_id(F.col("url"))),
        normalize_arxiv_id(of("arxiv_id")),
        F.when(doi.startswith("10.48550/"), normalize_arxiv_id(doi)),
    )
    pmid = F.coalesce(normalize_pmid(of("pmid")), F.when(F.col("url").contains("pubmed.ncbi.nlm.nih.gov"), normalize_pmid(F.col("url"))))
    ids = {"doi": doi, "arxiv_id": arxiv, "pmid": pmid, "openalex_id": of("openalex_id"), "semantic_scholar_id": of("semantic_scholar_id")}
    entries = [F.when(~blank(v), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in ids.items()]
    return live.select(
        "key",
        F.coalesce("title", F.lit("")).alias("title"),
        F.map_from_entries(F.array_compact(F.array(*entries))).alias("ids"),
        F.col("itemType").alias("item_type"),
        found(F.col("date"), r"(19|20)\d{2}").cast("int").alias("year"),
    )


def with_title_key(df: DataFrame, title: str = "title", unicode: bool = True) -> DataFrame:
    return df.withColumn("title_key", normalize_title(F.col(title), unicode))
