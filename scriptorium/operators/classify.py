"""Text classification by weighted dictionaries.

One Arrow pass measures every dimension of a record (weights, occurrences, strong terms); all rules over these numbers
are Columns. dictionary_score() is the same measure as generated Columns, for a single dictionary without look-arounds.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scriptorium.functions import ontology as O
from scriptorium.functions.text import blank

PRIMARY = ("cxr", "ct", "mammo")
GROUPED = ("uncertainty", "calibration", "conformal-prediction", "selective-prediction", "ood", "hallucination")
LISTED = ("foundation-model", "vlm", "uncertainty", "calibration", "conformal-prediction", "selective-prediction", "ood", "distribution-shift", "robustness", "report-generation", "image-text-pretraining")
TITLED = ("foundation-model", "vlm", "uncertainty", "calibration", "conformal-prediction", "selective-prediction", "ood", "distribution-shift", "robustness", "hallucination")

_MAP = T.MapType(T.StringType(), T.DoubleType())
_MEASURED = T.StructType(
    [T.StructField("score", _MAP), T.StructField("title", _MAP), T.StructField("patterns", T.MapType(T.StringType(), T.ArrayType(T.StringType())))]
    + [T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("ct_context", T.BooleanType())]
)


def _dimension(title: O.Hits, abstract: O.Hits) -> float:
    """Titles over abstracts, weak terms capped."""
    cap = lambda h, w: min(1.0 if h.strong else O.WEAK_CAP, w)
    t, a = cap(title, title.weight), cap(abstract, abstract.weight / 2)
    return round(min(1.0, max(t * 0.85 + a * 0.15, a * 0.7 + min(1.0, abstract.occurrences / 5) * 0.1)), 4)


def _measure(ontology: O.Ontology, title: str, abstract: str) -> tuple:
    """One pass over the text tells which terms may match; only their patterns are run."""
    text = f"{title} {abstract}"
    some = O.index_of(ontology).candidates(text)
    scores, titles, patterns = {}, {}, {}
    for name, found in ontology.dimensions:
        if name.startswith("topic:"):
            found = O.in_context(found, text, some)
        t, a = O.hits(found, title, some), O.hits(found, abstract, some)
        scores[name], titles[name], patterns[name] = _dimension(t, a), t.weight, sorted({*t.patterns, *a.patterns})
    tags = [name for name, found in ontology.tags if (h := O.hits(found, text, some)).strong or h.weight >= 1.0]
    return scores, titles, patterns, tags, bool(re.search(O.CT_CONTEXT, text, re.IGNORECASE))


def measured(title: Column, abstract: Column, ontology: O.Ontology | None = None) -> Column:
    """struct<score, title, patterns, tags, ct_context> of a record: scores, title weights and matched terms by dimension."""
    known = ontology or O.radiology()

    @F.arrow_udf(_MEASURED)
    def run(t: pa.Array, a: pa.Array) -> pa.Array:
        texts = list(zip(*(c.fill_null("").to_pylist() for c in (t, a)), strict=True))
        once = {pair: i for i, pair in enumerate(dict.fromkeys(texts))}
        listed = ([list(x.items()) if isinstance(x, dict) else x for x in _measure(known, *pair)] for pair in once)
        found = pa.array([dict(zip(_MEASURED.names, row, strict=True)) for row in listed], pa.struct(to_arrow_schema(_MEASURED)))
        return found.take(pa.array([once[pair] for pair in texts], pa.int32()))  # texts that are the same are measured and written out once

    return run(title, abstract)


def dimension(m: Column) -> Column:
    """_dimension() as a Column over struct<title, title_strong, abstract, abstract_strong, occurrences>."""
    title = F.least(F.when(m["title_strong"], 1.0).otherwise(O.WEAK_CAP), m["title"])
    abstract = F.least(F.when(m["abstract_strong"], 1.0).otherwise(O.WEAK_CAP), m["abstract"] / 2)
    often = F.least(F.lit(1.0), m["occurrences"] / F.lit(5.0))
    return F.round(F.least(F.lit(1.0), F.greatest(title * 0.85 + abstract * 0.15, abstract * 0.7 + often * 0.1)), 4)


def dictionary_score(title: Column, abstract: Column, terms: list[tuple[str, float]]) -> Column:
    """The score of a dictionary of (pattern, weight) as generated Columns."""
    total = lambda text: sum((F.when(text.rlike(p), w).otherwise(0.0) for p, w in terms), F.lit(0.0))
    strong = lambda text: F.greatest(F.lit(False), F.lit(False), *[text.rlike(p) for p, w in terms if w >= O.STRONG])
    count = sum((F.regexp_count(abstract, F.lit(p)) for p, _ in terms), F.lit(0))
    m = F.struct(
        total(title).alias("title"), strong(title).alias("title_strong"), total(abstract).alias("abstract"), strong(abstract).alias("abstract_strong"), count.alias("occurrences")
    )
    return dimension(m)


def excluded_type(title: Column, publication_type: Column) -> Column:
    """Editorials, errata, retractions and the like."""
    return F.trim(F.coalesce(publication_type, F.lit(""))).rlike(f"(?i){O.EXCLUDED_TYPE}") | F.trim(title).rlike(f"(?i){O.EXCLUDED_TITLE}")


def type_tags(title: Column, publication_type: Column) -> Column:
    """Kinds of papers told by their title."""
    meeting = F.trim(title).rlike(f"(?i){O.MEETING_TITLE}") | F.coalesce(publication_type, F.lit("")).rlike(f"(?i){O.MEETING_TYPE}")
    told = [(title.rlike(f"(?i){O.SURVEY_TITLE}"), "type:survey"), (title.rlike(f"(?i){O.BENCHMARK_TITLE}"), "type:benchmark-dataset"), (meeting, "type:meeting-abstract")]
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in told]))


def classify(papers: DataFrame, ontology: O.Ontology | None = None) -> DataFrame:
    """papers with topics, modalities, subtopics and scores, a struct of all dimensions."""
    df = papers.withColumns({"title": F.coalesce("title", F.lit("")), "abstract": F.coalesce("abstract", F.lit(""))})
    df = df.withColumn("m", measured(F.col("title"), F.col("abstract"), ontology))
    d = lambda name: F.col("m.score")[name]
    topic = lambda name: d(f"topic:{name}")
    context = (d("radiology-general") > 0) | (d("secondary-radiology") > 0) | F.col("m.ct_context")
    elsewhere = (F.col("m.title")["secondary-radiology"] > 0) | (d("secondary-radiology") >= O.ENOUGH)
    mammo = F.when((d("mammo") > 0) & (d("mammo-specific") < O.ENOUGH) & elsewhere, F.round(d("mammo") * 0.4, 4)).otherwise(d("mammo"))
    df = df.withColumns({"s_cxr": d("cxr"), "s_ct": F.when(context, d("ct")).otherwise(d("ct-phrases")), "s_mammo": mammo})
    grouped = F.greatest(*[topic(t) for t in GROUPED])
    shifted = F.least(topic("distribution-shift"), F.greatest(topic("ood"), topic("uncertainty"), topic("calibration")) + 0.3) * 0.8
    df = df.withColumns(
        {
            "relevant": F.greatest("s_cxr", "s_ct", "s_mammo", d("radiology-general"), d("secondary-radiology") * 0.7),
            "unsure": F.greatest(grouped, shifted),
        }
    )
    other = (d("other-modality") >= 0.6) & (F.col("relevant") < 0.45)
    own = F.array_compact(F.array(*[F.when(F.col(f"s_{m}") >= O.ENOUGH, F.lit(m)) for m in PRIMARY]))
    general = (d("radiology-general") >= O.ENOUGH) | (d("secondary-radiology") >= O.ENOUGH)
    none = F.array().cast("array<string>")
    modalities = F.when(other, none).when(F.size(own) > 0, own).when(general, F.array(F.lit("radiology-general"))).otherwise(none)
    listed = F.array_compact(F.array(*[F.when(topic(t) >= O.ENOUGH, F.lit(t)) for t in LISTED], F.when((topic("hallucination") >= O.ENOUGH) & (topic("vlm") >= O.ENOUGH), F.lit("vlm-reliability"))))
    df = df.withColumn("listed", listed)
    reliable = F.arrays_overlap("listed", F.array(*[F.lit(t) for t in ("calibration", "conformal-prediction", "selective-prediction", "ood", "vlm-reliability")]))
    add = (F.col("unsure") >= O.ENOUGH) & ~F.array_contains("listed", "uncertainty") & reliable
    tagged = lambda prefix, on: F.when(on, F.filter("m.tags", lambda t: t.startswith(prefix))).otherwise(none)
    models = (topic("foundation-model") >= O.ENOUGH) | (topic("vlm") >= O.ENOUGH)
    matched = F.map_filter("m.patterns", lambda k, v: ~k.isin("secondary-radiology", "mammo-specific", "ct-phrases"))
    in_title = [F.when(F.col("m.title")[m] > 0, F.lit(m)) for m in PRIMARY] + [F.when(F.col("m.title")[f"topic:{t}"] >= 0.7, F.lit(t)) for t in TITLED]
    scores = F.struct(
        F.round("relevant", 4).alias("radiology_relevance"),
        *[F.col(f"s_{m}").alias(f"{m}_relevance") for m in PRIMARY],
        d("radiology-general").alias("general_radiology_relevance"),
        d("secondary-radiology").alias("secondary_radiology_relevance"),
        d("other-modality").alias("other_modality_relevance"),
        topic("foundation-model").alias("foundation_model_relevance"),
        topic("vlm").alias("vlm_relevance"),
        F.round("unsure", 4).alias("uncertainty_relevance"),
        F.greatest(topic("robustness"), topic("distribution-shift")).alias("robustness_relevance"),
        F.create_map(*[x for t in O.TOPICS for x in (F.lit(t), topic(t))]).alias("topic_scores"),
        other.alias("is_other_modality"),
        excluded_type(F.col("title"), F.col("publication_type")).alias("excluded_type"),
        matched.alias("matched_terms"),
        F.array_compact(F.array(*in_title)).alias("title_dimensions"),
    )
    return df.withColumns(
        {
            "modalities": modalities,
            "topics": F.when(add, F.concat("listed", F.array(F.lit("uncertainty")))).otherwise(F.col("listed")),
            "subtopics": F.concat(tagged("uncertainty:", F.col("unsure") >= O.ENOUGH), tagged("fm:", models), type_tags(F.col("title"), F.col("publication_type"))),
            "scores": scores,
        }
    ).drop("m", "relevant", "unsure", "listed", *[f"s_{m}" for m in PRIMARY])


def main_topic(s: Column) -> Column:
    """The strongest main theme, raised by further strong ones."""
    strong = [s[f"{n}_relevance"] for n in ("foundation_model", "vlm", "uncertainty")]
    many = sum((F.when(c >= O.ENOUGH, 1).otherwise(0) for c in strong), F.lit(0))
    return F.round(F.least(F.lit(1.0), F.greatest(*strong, s["robustness_relevance"] * 0.75) + F.greatest(F.lit(0), many - 1) * 0.05), 4)


def modality_match(s: Column, wanted: tuple[str, ...] = ()) -> Column:
    """How well a record fits the wanted modalities, or any."""
    own = {m: s[f"{m}_relevance"] for m in PRIMARY}
    if wanted:
        of = own | {"radiology-general": s["radiology_relevance"]}
        return F.round(F.greatest(F.lit(0.0), F.lit(0.0), *[of[m] for m in wanted if m in of]), 4)
    return F.round(F.greatest(*own.values(), s["general_radiology_relevance"] * 0.6, s["secondary_radiology_relevance"] * 0.5, F.lit(0.2)), 4)


def hard_filter(df: DataFrame, allow_editorials: bool = False) -> Column:
    """Why a classified record is out before any score, or null."""
    s = F.col("scores")
    kind = F.when(blank(F.col("publication_type")), "title pattern").otherwise(F.col("publication_type"))
    return (
        F.when(blank(F.col("title")), "missing title")
        .when(F.lit(not allow_editorials) & s["excluded_type"], F.concat(F.lit("excluded publication type ("), kind, F.lit(")")))
        .when(s["is_other_modality"], "non-radiology imaging modality")
        .when(s["radiology_relevance"] < 0.3, "not related to radiology / medical imaging")
        .when(F.size("modalities") == 0, "no CXR / CT / mammography / general-radiology relevance")
    )


def looks_radiological(title: Column, abstract: Column) -> Column:
    """Whether any modality term occurs (P09), as one alternation."""
    text = F.concat_ws(" ", title, abstract)
    either = [t for name in (*PRIMARY, "radiology-general") for t in O.terms(O.MODALITIES[name])]
    any_of = lambda exact: "|".join(t.pattern for t in either if t.exact_case == exact)
    return text.rlike(rf"(?iU)(?<!\w)({any_of(False)})(?!\w)") | text.rlike(rf"(?U)(?<!\w)({any_of(True)})(?!\w)")
