"""The data model: records, their sub-structures, and requests."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_L = T.ArrayType(_S)

EVIDENCE = T.StructType(
    [T.StructField("score", _D), T.StructField("label", _S), T.StructField("evidence", _S), T.StructField("evidence_source", _S), T.StructField("influential", _B), T.StructField("intents", _L)]
    + [T.StructField(f"cited_in_{n}", _I) for n in ("experiments", "tables", "baseline_section")]
)
#: Names and types of a record's fields. Missing text is empty or null, missing lists are empty.
PAPER = T.StructType(
    [T.StructField(n, _S) for n in ("title", "abstract", "venue", "venue_key", "venue_type", "publication_date", "publication_type")]
    + [T.StructField("year", _I), T.StructField("citation_count", _I)]
    + [T.StructField(n, _S) for n in ("doi", "arxiv_id", "pmid", "pmcid", "openalex_id", "semantic_scholar_id", "url", "pdf_url")]
    + [T.StructField(n, _S) for n in ("volume", "issue", "pages", "publisher", "issn", "source", "journal_ref")]
    + [T.StructField(n, _L) for n in ("authors", "author_ids", "sources", "queries", "references", "extra_tags", "topics", "modalities", "subtopics")]
    + [T.StructField("pdf_candidates", T.MapType(_S, _S)), T.StructField("graph_evidence", EVIDENCE)]
    + [T.StructField(n, _S) for n in ("author_watch", "relationship")]
)
LIBRARY = T.StructType([T.StructField("key", _S), T.StructField("title", _S), T.StructField("ids", T.MapType(_S, _S)), T.StructField("item_type", _S), T.StructField("year", _I)])


def conform(df: DataFrame, schema: T.StructType = PAPER) -> DataFrame:
    """df with exactly the schema's fields: others are dropped, missing ones are null, or empty lists and maps."""
    have = set(df.columns)

    def column(f: T.StructField) -> Column:
        value = F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.ArrayType):
            value = F.coalesce(value, F.array().cast(f.dataType))
        if isinstance(f.dataType, T.MapType):
            value = F.coalesce(value, F.create_map().cast(f.dataType))
        return value.alias(f.name)

    return df.select(*[column(f) for f in schema.fields])


INTENTS = ("scan", "topic_search", "venue_search", "author_search", "similar", "citations", "related", "baselines", "missing_lit", "add_doi")


@dataclass(frozen=True)
class Request:
    """A declarative search; compiled into DataFrame operations, never a row itself."""

    intent: str = "topic_search"
    topics: tuple[str, ...] = ()
    modalities: tuple[str, ...] = ()
    venues: tuple[str, ...] = ()
    author: str | None = None
    author_openalex_id: str | None = None
    author_s2_id: str | None = None
    free_text: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    seed: str | None = None
    include_seed: bool = False
    collection: str | None = None
    top_venues_only: bool = False
    limit: int | None = None
    action: str = "add_by_threshold"
    source_tag: str = "manual-prompt"
    strict_request_match: bool = True
    extra_tags: tuple[str, ...] = ()
    label: str | None = None
    notes: tuple[str, ...] = ()

    def but(self, **changes) -> Request:
        return replace(self, **changes)


@dataclass(frozen=True)
class Settings:
    """What a run is configured by. The numbers and lists are defaults that a user may change."""

    profile: str = "general"
    auto_add: float = 0.82
    review: float = 0.68
    fuzzy: float = 0.96
    high_priority_score: float = 0.90
    max_auto_add: int = 25
    max_calls: int = 40
    overlap_days: int = 10
    lookback_days: int = 20
    first_run_years: int = 3
    normalize_citation_age: bool = True
    prefer_peer_reviewed: bool = True
    root_collection: str = "Literature"
    review_collection: str = "Auto Discovery - Review"
    accepted_collection: str = "Auto Discovery - Accepted"
    watch_collection: str = "Author Watches"
    high_priority_venues: tuple[str, ...] = (
        "neurips", "icml", "iclr", "cvpr", "iccv", "eccv", "miccai", "midl", "tpami", "tmi", "medical_image_analysis", "radiology_ai", "radiology", "jmlr", "tnnls",
    )
    #: Retrieval priors of venues.
    venue_weights: dict[str, float] = field(
        default_factory=lambda: {
            "neurips": 1.00, "icml": 1.00, "iclr": 1.00, "cvpr": 0.98, "iccv": 0.98, "eccv": 0.98, "miccai": 1.00, "midl": 0.95, "tpami": 1.00, "tmi": 1.00,
            "medical_image_analysis": 1.00, "radiology_ai": 1.00, "tnnls": 0.95, "jmlr": 1.00, "radiology": 1.00, "aaai": 0.90, "ijcai": 0.90, "isbi": 0.85,
            "european_radiology": 0.85, "jdi": 0.80, "aim": 0.80, "rsna": 0.80, "workshop": 0.55, "other_journal": 0.60, "other_conference": 0.55,
            "preprint": 0.40, "unknown": 0.40,
        }
    )
    authors: tuple[dict, ...] = ()

    @property
    def radiology(self) -> bool:
        return self.profile == "radiology"
