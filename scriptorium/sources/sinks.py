"""Sinks: items, destinations, attachments, audit lines and proposals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import blank, is_preprint_doi, safe_filename
from scriptorium.functions.venues import conference_name, venue_tag
from scriptorium.schema import Settings
from scriptorium.session import settle
from scriptorium.sources import ledger

#: Particles that belong to a surname, kinds of PDFs in order of preference and their titles.
PARTICLES = ("van", "von", "de", "der", "den", "da", "di", "del", "la", "le", "dos", "du")
PDF_KINDS = {"official_oa": "Full Text PDF (open access)", "arxiv": "arXiv PDF", "pmc": "PubMed Central PDF", "proceedings": "Proceedings PDF"}
#: Names of the branches of the radiology hierarchy.
MODALITY_BRANCHES = {"cxr": "CXR", "ct": "CT", "mammo": "Mammography", "radiology-general": "General Radiology"}
RELIABILITY = {"calibration": "Calibration", "conformal-prediction": "Conformal Prediction", "ood": "OOD / Shift", "selective-prediction": "Selective Prediction", "vlm-reliability": "VLM Reliability"}


def split_name(name: Column) -> Column:
    """struct<firstName, lastName, name> of an author's name; particles stay with the surname."""
    whole = F.trim(F.regexp_replace(name, r"\s+", " "))
    particles = "|".join(PARTICLES)
    last = F.regexp_extract(whole, rf"(?i)^\S+(?:\s+\S+)*?\s+((?:(?:{particles})\s+)*\S+)$", 1)
    comma = whole.contains(",")
    first_part, rest = F.trim(F.substring_index(whole, ",", 1)), F.trim(F.regexp_replace(whole, r"^[^,]*,", ""))
    none = F.lit(None).cast("string")
    one = ~comma & ~whole.contains(" ")
    first = F.when(comma, rest).when(one, none).otherwise(F.trim(F.substring(whole, F.lit(1), F.length(whole) - F.length(last))))
    return F.struct(first.alias("firstName"), F.when(comma, first_part).when(one, none).otherwise(last).alias("lastName"), F.when(one, whole).alias("name"))


def tags(settings: Settings, source_tag: str) -> Column:
    """Tags of a decided record, in order, each once."""
    known = ~blank(F.col("author_watch")) & F.lit(source_tag != "author-watch")
    fixed = F.array(
        F.lit(f"source:{source_tag}"),
        F.when(known, "source:author-watch"),
        F.lit("status:unread"),
        F.when(F.col("decision") == "review", "status:review-required").when(F.col("final_score") >= settings.high_priority_score, "status:high-priority"),
        venue_tag(F.col("venue_key")),
        F.when(F.col("venue_type") == "preprint", "type:preprint"),
    )
    prefix = lambda c, p: F.transform(c, lambda x: F.concat(F.lit(p), x))
    topics = F.filter("topics", lambda t: t != "hallucination")
    return F.array_distinct(F.array_compact(F.concat(prefix(F.col("modalities"), "modality:"), prefix(topics, "topic:"), F.col("subtopics"), fixed)))


def extra() -> Column:
    """Identifiers that an item has no field for, a line each."""
    lines = {"arXiv": "arxiv_id", "PMID": "pmid", "PMCID": "pmcid", "OpenAlex": "openalex_id", "Semantic Scholar": "semantic_scholar_id"}
    return F.concat_ws("\n", *[F.when(~blank(F.col(n)), F.concat(F.lit(f"{label}: "), n)) for label, n in lines.items()])


def items(df: DataFrame, settings: Settings, source_tag: str = "manual-prompt") -> DataFrame:
    """df with item, a JSON document in the shape that its venue type asks for."""
    text = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    dated = F.coalesce(F.when(~blank(F.col("publication_date")), F.col("publication_date")), F.col("year").cast("string"), F.lit(""))
    common = [
        F.col("title"), F.transform("authors", split_name).alias("creators"), F.col("abstract").alias("abstractNote"), dated.alias("date"), text("url").alias("url"),
        extra().alias("extra"), F.transform(tags(settings, source_tag), lambda t: F.struct(t.alias("tag"))).alias("tags"),
    ]
    kind = lambda name: F.lit(name).alias("itemType")
    journal = F.struct(kind("journalArticle"), *common, F.col("venue").alias("publicationTitle"), *[text(n).alias(a) for n, a in (("volume", "volume"), ("issue", "issue"), ("pages", "pages"), ("doi", "DOI"), ("issn", "ISSN"))])
    meeting = F.struct(kind("conferencePaper"), *common, F.col("venue").alias("proceedingsTitle"), conference_name(F.col("venue_key"), F.col("year")).alias("conferenceName"), *[text(n).alias(a) for n, a in (("pages", "pages"), ("doi", "DOI"), ("publisher", "publisher"), ("volume", "volume"))])
    arxiv = ~blank(F.col("arxiv_id"))
    doi = F.coalesce(F.when(~blank(F.col("doi")), F.col("doi")), F.when(arxiv, F.concat(F.lit("10.48550/arXiv."), "arxiv_id")), F.lit(""))
    preprint = F.struct(kind("preprint"), *common, F.when(arxiv, "arXiv").otherwise(text("venue")).alias("repository"), F.when(arxiv, F.concat(F.lit("arXiv:"), "arxiv_id")).otherwise("").alias("archiveID"), doi.alias("DOI"))
    item = F.when(F.col("venue_type") == "journal", F.to_json(journal)).when(F.col("venue_type").isin("conference", "workshop"), F.to_json(meeting)).otherwise(F.to_json(preprint))
    return df.withColumn("item", item)


def provenance(df: DataFrame, today: date) -> DataFrame:
    """df with note: how a record was found and scored."""
    said = [
        F.lit("Found automatically."), F.concat(F.lit("Source: "), F.array_join("sources", ", ")), F.concat(F.lit("Discovery query: "), F.array_join(F.slice("queries", 1, 5), "; ")),
        F.lit(f"Discovery date: {today.isoformat()}"),
        F.concat(F.lit("Relevance score: "), F.format_number("relevance_score", 2), F.lit(" | Quality score: "), F.format_number("quality_score", 2), F.lit(" | Final score: "), F.format_number("final_score", 2)),
        F.concat(F.lit("Decision: "), "decision", F.when(blank(F.col("reject_reason")), "").otherwise(F.concat(F.lit(" ("), "reject_reason", F.lit(")")))),
    ]
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return df.withColumn("note", F.concat_ws("", *[F.concat(F.lit("<p>"), safe(s), F.lit("</p>")) for s in said]))


def destinations(settings: Settings, source_tag: str, label: str | None = None) -> Column:
    """Paths that a decided record is filed under."""
    review, accepted, watch = (F.lit(n) for n in (settings.review_collection, settings.accepted_collection, settings.watch_collection))
    watched = F.lit(source_tag == "author-watch")
    if not settings.radiology:
        own = F.lit(label.replace("/", "-").strip()) if label else accepted
        seen = F.when(watched | ~blank(F.col("author_watch")), watch)
        return F.array_distinct(F.array_compact(F.array(F.when(F.col("decision") == "review", review).otherwise(own), seen)))
    has = lambda t: F.array_contains("topics", t)
    names = F.create_map(*[F.lit(x) for pair in MODALITY_BRANCHES.items() for x in pair])
    branches = F.transform(F.filter("modalities", lambda m: m.isin(*MODALITY_BRANCHES)), lambda m: names[m])
    none = F.array().cast("array<string>")
    under = lambda branch, on: F.when(on, F.transform(branches, lambda b: F.concat(F.lit(f"{branch}/"), b))).otherwise(none)
    shift = has("distribution-shift")
    told = {t: has(t) | ((shift & has("uncertainty")) if t == "ood" else F.lit(False)) for t in RELIABILITY}
    any_told = F.array_compact(F.array(*[F.when(told[t], F.lit(f"Uncertainty & Reliability/{n}")) for t, n in RELIABILITY.items()]))
    paths = F.concat(
        under("Foundation Models", has("foundation-model") | has("image-text-pretraining")),
        under("Vision-Language Models", has("vlm") | has("report-generation")),
        F.when(F.size(any_told) > 0, any_told).when(has("uncertainty"), F.array(F.lit("Uncertainty & Reliability"))).otherwise(none),
        F.array_compact(F.array(
            F.when(has("robustness") | (shift & ~has("uncertainty")), "Robustness & Evaluation"),
            F.when(watched | ~blank(F.col("author_watch")), watch),
            F.when(F.lit(source_tag == "auto-discovery"), accepted),
        )),
    )
    filed = F.when(F.size(paths) > 0, paths).otherwise(F.array(accepted))
    untopical = F.array_compact(F.array(accepted, F.when(watched, watch)))
    return F.array_distinct(F.when(F.col("decision") == "review", F.array_compact(F.array(review, F.when(watched, watch)))).when(F.size("modalities") == 0, untopical).otherwise(filed))


def hierarchy(settings: Settings) -> list[str]:
    """The paths that a library is laid out in, parents first."""
    own = [settings.watch_collection, settings.review_collection, settings.accepted_collection]
    if not settings.radiology:
        return [settings.root_collection, *(f"{settings.root_collection}/{n}" for n in own)]
    branches = {"Foundation Models": MODALITY_BRANCHES.values(), "Vision-Language Models": MODALITY_BRANCHES.values(), "Uncertainty & Reliability": RELIABILITY.values(), "Robustness & Evaluation": ()}
    out = [settings.root_collection]
    for branch, leaves in branches.items():
        out += [f"{settings.root_collection}/{branch}", *(f"{settings.root_collection}/{branch}/{leaf}" for leaf in leaves)]
    return [*out, *(f"{settings.root_collection}/{n}" for n in own)]


def choose_pdf(candidates: Column) -> Column:
    """struct<kind, url, filename, title> of the preferred PDF, or null."""
    of = lambda k, t: F.when(~blank(F.try_element_at(candidates, F.lit(k))), F.struct(F.lit(k).alias("kind"), candidates[k].alias("url"), safe_filename(candidates[k]).alias("filename"), F.lit(t).alias("title")))
    return F.coalesce(*[of(k, t) for k, t in PDF_KINDS.items()])


def is_pdf(content: Column) -> Column:
    """Whether a file's first bytes are a PDF's."""
    return F.substring(content, 1, 4) == F.lit(b"%PDF")


def file_existing(existing: DataFrame, filed: DataFrame, target: str, key: str = "library_key") -> DataFrame:
    """Items to add to a target: in the library, not there yet, not trashed, no child, not awaiting review."""
    fine = ~F.coalesce("deleted", F.lit(False)) & F.col("parentItem").isNull() & ~F.array_contains(F.transform("tags", lambda t: t["tag"]), "status:review-required")
    there = filed.where(F.col("collection") == target).select(key)
    return existing.where(fine).join(there, key, "left_anti").select(key, F.lit(target).alias("collection"))


def annotate_upgrades(library: DataFrame, upgrades: DataFrame) -> DataFrame:
    """Library items with the published version noted in extra, once (K06). upgrades: (key, doi, venue, year)."""
    up = upgrades.where(~blank(F.col("doi")) & ~is_preprint_doi(F.col("doi"))).select("key", F.concat_ws(" ", F.concat(F.lit("Published DOI: "), "doi"), F.concat(F.lit("("), F.concat_ws(" ", "venue", F.col("year").cast("string")), F.lit(")"))).alias("line"), F.col("doi").alias("new_doi"))
    known = F.coalesce("extra", F.lit(""))
    noted = F.col("line").isNull() | F.contains(F.lower(known), F.lower("new_doi"))
    joined = library.join(up, "key", "left")
    return joined.withColumn("extra", F.when(noted, F.col("extra")).otherwise(F.trim(F.concat_ws("\n", F.when(known != "", known), F.col("line"))))).drop("line", "new_doi")


def ingest(df: DataFrame, path: str, key: str = "paper_id", writes_enabled: bool = False, gate: str | None = None, argument: str = "") -> DataFrame:
    """Write accepted and reviewed items, each with its audit line; returns what was written.

    Keys that a run has published before are left out, and a run publishes all it wrote at once (sources/ledger.py), so one
    that died is simply run again. An item's id is a hash of its key. Without writes_enabled nothing is written: the plan
    alone is returned. gate: what the items have to pass, `module:name`.
    """
    planned = df.where(F.col("decision").isin("accept", "review")).select(F.col(key).cast("string").alias("key"), F.substring(F.sha1(F.col(key).cast("string")), 1, 16).alias("item_id"), "decision", "item", "collections")
    if not writes_enabled:
        return planned
    spark = df.sparkSession
    planned, _ = settle(planned, "planned")
    new = planned.dropDuplicates(["key"]).join(ledger.audit(spark, path).select("key"), "key", "left_anti")
    run = ledger.append(new, path, gate, argument)
    return ledger.published(spark, path, run).where("not refused").select(*planned.columns)


def save_proposals(df: DataFrame, path: str, score: str = "final_score", key: str = "paper_id") -> None:
    """Overwrite the snapshot of accepted and reviewed rows, best first within a file."""
    df.where(F.col("decision").isin("accept", "review")).sortWithinPartitions(F.desc(score), key).write.mode("overwrite").json(path)


def load_proposals(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
