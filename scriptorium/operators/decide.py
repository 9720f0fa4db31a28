"""Scoring and decisions: score columns from a record's fields, ladders of conditions that give a decision and its reason."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import scores as S
from scriptorium.functions.dates import age_years, outside_window, parse_date
from scriptorium.functions.ontology import ENOUGH
from scriptorium.functions.text import blank
from scriptorium.operators.authors import name_matches
from scriptorium.operators.classify import PRIMARY, hard_filter, main_topic, modality_match
from scriptorium.operators.records import peer_reviewed
from scriptorium.plans.boolean import Query
from scriptorium.schema import Request, Settings

#: Topics scored by a group of dimensions, and by one of their own.
_GROUP_SCORES = {"foundation-model": "foundation_model_relevance", "vlm": "vlm_relevance", "uncertainty": "uncertainty_relevance", "robustness": "robustness_relevance"}
_OWN_SCORES = ("calibration", "conformal-prediction", "selective-prediction", "ood", "distribution-shift", "report-generation", "image-text-pretraining", "hallucination")
#: What peer review of a venue type is worth.
_PEER = {"journal": 1.0, "conference": 1.0, "workshop": 0.6}


def ladder(*steps: tuple[Column, str, Column | str]) -> tuple[Column, Column]:
    """(decision, reason): the first step whose condition holds. The last one should always hold."""
    decision, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for condition, what, why in reversed(steps):
        holds = F.coalesce(condition, F.lit(False))
        decision = F.when(holds, F.lit(what)).otherwise(decision)
        reason = F.when(holds, why if isinstance(why, Column) else F.lit(why)).otherwise(reason)
    return decision, reason


def requested_topic(s: Column, topics: tuple[str, ...]) -> Column:
    """How well a record fits all requested topics."""
    wanted = []
    for t in topics:
        if t in _GROUP_SCORES:
            wanted.append(s[_GROUP_SCORES[t]])
        elif t in _OWN_SCORES:
            wanted.append(s["topic_scores"][t])
        elif t == "vlm-reliability":
            wanted.append(F.least(s["vlm_relevance"], s["topic_scores"]["hallucination"] + 0.2))
    return S.blend(wanted) if wanted else main_topic(s)


def _words(text: str) -> list[str]:
    return [w for w in text.lower().replace(",", " ").split() if len(w) > 2]


def keyword_match(df: DataFrame, request: Request) -> Column:
    """The share of the request's words in the text, or the breadth of what the dictionaries found."""
    words = _words(request.free_text or "")
    if words:
        return S.keyword_share(F.lower(F.concat_ws(" ", "title", "abstract")), words)
    found = F.size(F.map_filter(F.col("scores.matched_terms"), lambda k, v: (F.size(v) > 0) & (k != "other-modality")))
    return F.round(F.least(F.lit(1.0), F.size("scores.title_dimensions") * 0.3 + found * 0.1), 4)


def with_quality(df: DataFrame, settings: Settings, today: date) -> DataFrame:
    """df with age, its quality and the parts of it."""
    weights = F.create_map(*[F.lit(x) for pair in settings.venue_weights.items() for x in pair])
    age = age_years(parse_date(F.col("publication_date")), F.when(F.col("year") != 0, F.col("year")), today)
    meeting = F.array_contains("subtopics", "type:meeting-abstract")
    fallback = F.when(F.col("venue_type") == "preprint", F.try_element_at(weights, F.lit("preprint"))).otherwise(F.try_element_at(weights, F.lit("unknown")))
    venue = F.coalesce(F.try_element_at(weights, F.col("venue_key")), fallback, F.lit(0.4))
    peer = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in _PEER.items() for x in pair]), F.col("venue_type")), F.lit(0.0))
    methods = F.size(F.filter("subtopics", lambda t: t.startswith("uncertainty:") | t.startswith("fm:")))
    checks = [~blank(F.col("doi")) | ~blank(F.col("arxiv_id")) | ~blank(F.col("pmid")), F.size("authors") > 0, ~blank(F.col("abstract"))]
    checks += [F.col("venue_key") != "unknown", ~blank(F.col("publication_date")) | F.coalesce(F.col("year") != 0, F.lit(False))]
    df = df.withColumn("age", age).withColumns(
        {
            "venue_weight": F.when(meeting, F.least(venue, F.lit(0.5))).otherwise(venue),
            "peer_review": F.when(meeting, 0.3).otherwise(peer),
            "citation_signal": S.citation_signal(F.col("citation_count"), F.col("age"), settings.normalize_citation_age),
            "methodological_relevance": S.methodological_relevance(methods, F.array_contains("subtopics", "type:survey")),
            "metadata_confidence": S.metadata_confidence(checks, F.size("sources")),
            "recency": S.recency(F.col("age")),
        }
    )
    parts = [F.col(c) for c in ("venue_weight", "peer_review", "citation_signal", "methodological_relevance", "metadata_confidence")]
    return df.withColumn("raw_quality", S.quality(*parts))


_PARTS = ("venue_weight", "peer_review", "citation_signal", "methodological_relevance", "metadata_confidence")


def score(df: DataFrame, settings: Settings, request: Request, today: date) -> DataFrame:
    """Classified records with relevance, quality, final score and their breakdown."""
    df = with_quality(df, settings, today)
    if request.author:
        named = F.exists("authors", lambda a: name_matches(F.lit(request.author), a))
        df = df.withColumn("author_watch", F.coalesce("author_watch", F.when(named, F.lit(request.author))))
    watched = F.when(blank(F.col("author_watch")), 0.0).otherwise(1.0)
    if settings.radiology:
        s = F.col("scores")
        parts = {
            "semantic_topic_match": requested_topic(s, request.topics) if request.topics else main_topic(s),
            "modality_match": modality_match(s, request.modalities),
            "keyword_match": keyword_match(df, request),
            "author_watch_match": watched,
            "recency": F.col("recency"),
        }
        df = df.withColumn("relevance_parts", F.struct(*[v.alias(k) for k, v in parts.items()]))
        p = F.col("relevance_parts")
        relevance = S.topical_relevance(*[p[k] for k in parts])
    else:
        query = Query.of(request.free_text)
        none = F.array().cast("array<string>")
        df = df.withColumns({"modalities": none, "topics": none, "subtopics": F.filter("subtopics", lambda t: t.startswith("type:"))})
        df = df.withColumn("query_hits", F.array(*query.hits(F.col("title"), F.col("abstract"))).cast("array<double>"))
        hits, n = F.col("query_hits"), float(len(query.groups))
        total = F.aggregate(hits, F.lit(0.0), lambda a, h: a + h)
        parts = {
            "query_coverage": total / n if n else F.lit(0.5),
            "all_terms_present": F.when(F.forall(hits, lambda h: h > 0), 1.0).otherwise(0.0),
            "title_coverage": F.size(F.filter(hits, lambda h: h == 1.0)) / F.lit(n) if n else F.lit(0.0),
            "author_watch_match": watched,
            "recency": F.col("recency"),
        }
        df = df.withColumn("relevance_parts", F.struct(*[v.alias(k) for k, v in parts.items()]))
        p = F.col("relevance_parts")
        relevance = S.general_relevance(*[p[k] for k in parts])
    breakdown = [x for k in parts for x in (F.lit(k), F.round(p[k], 4))] + [x for k in _PARTS for x in (F.lit(k), F.col(k))]
    return (
        df.withColumn("raw_relevance", relevance)
        .withColumns(
            {
                "relevance_score": F.round("raw_relevance", 4),
                "quality_score": F.round("raw_quality", 4),
                "final_score": S.final_score(F.col("raw_relevance"), F.col("raw_quality")),
                "score_breakdown": F.create_map(*breakdown),
            }
        )
        .drop("relevance_parts", "raw_relevance", "raw_quality", "age", *_PARTS, "recency")
    )


def cocitation_bonus(df: DataFrame, count: str = "cocitations") -> DataFrame:
    """0.02 for each further member that cites a record, up to a score of 1."""
    return df.withColumn("final_score", F.when(F.col(count) > 1, F.round(F.least(F.lit(1.0), F.col("final_score") + (F.col(count) - 1) * 0.02), 4)).otherwise(F.col("final_score")))


def request_mismatch(request: Request, settings: Settings) -> Column:
    """Which of a request's own conditions a record fails, or null."""
    out = F.lit(None).cast("string")
    if not request.strict_request_match:
        return out
    s, venue = F.col("scores"), F.coalesce("venue_key", F.lit(""))
    if request.top_venues_only:
        out = F.when(~venue.isin(*Settings().high_priority_venues), "not from a top venue")
    if request.venues:
        out = F.coalesce(F.when(~venue.isin(*request.venues), "not from requested venue " + "/".join(request.venues)), out)
    if request.topics:
        out = F.coalesce(F.when(requested_topic(s, request.topics) < ENOUGH, "does not match requested topic " + "/".join(request.topics)), out)
    if request.modalities:
        out = F.coalesce(F.when(modality_match(s, request.modalities) < ENOUGH, "does not match requested modality " + "/".join(request.modalities)), out)
    return out


def _blockers(settings: Settings, weak_modality: bool) -> Column:
    """What keeps a high score from being accepted, joined."""
    told = []
    if settings.high_priority_venues or settings.radiology:
        told.append(F.when(~F.coalesce(F.col("venue_key").isin(*settings.high_priority_venues), F.lit(False)), "venue not in high-priority list"))
    if settings.prefer_peer_reviewed:
        told.append(F.when(~peer_reviewed(F.col("venue_type")), "not peer reviewed"))
    told.append(F.when(F.array_contains("subtopics", "type:meeting-abstract"), "meeting abstract"))
    if weak_modality:
        own = F.arrays_overlap("modalities", F.array(*[F.lit(m) for m in PRIMARY]))
        told.append(F.when(~own & (F.col("scores.general_radiology_relevance") < 0.8), "weak modality evidence"))
    return F.concat_ws("; ", *told)


def _two(c: Column) -> Column:
    return F.format_number(c, 2)


def decide(df: DataFrame, settings: Settings, request: Request, allow_editorials: bool | None = None) -> DataFrame:
    """Scored records with decision, reject_reason and hard_rejected."""
    if allow_editorials is None:
        allow_editorials = "editorial" in (request.free_text or "").lower()
    final, always = F.col("final_score"), F.lit(True)
    below = F.concat(F.lit("score "), _two(final), F.lit(f" below review threshold {settings.review:.2f}"))
    hard = F.lit(None).cast("string")
    if request.intent == "baselines":
        label = F.col("graph_evidence.label")
        steps = [
            (F.col("scores.excluded_type"), "reject", "excluded publication type"),
            (label.isin("seed", "likely baseline"), "accept", ""),
            (label == "possible baseline", "review", "possible baseline - check the evidence"),
            (always, "reject", F.concat(F.lit("not a baseline ("), F.coalesce(label, F.lit("no evidence")), F.lit(")"))),
        ]
        better = label.isNotNull() & (label != "seed")
        df = df.withColumn("final_score", F.when(better, F.greatest(final, F.coalesce(F.col("graph_evidence.score"), F.lit(0.0)))).otherwise(final))
    elif settings.radiology:
        hard = hard_filter(df, allow_editorials)
        mismatch = request_mismatch(request, settings)
        themed = main_topic(F.col("scores")) >= ENOUGH
        if request.topics:
            themed = F.lit(True) if request.strict_request_match else themed | (requested_topic(F.col("scores"), request.topics) >= ENOUGH)
        own = {a["name"]: float(a["auto_add_threshold"]) for a in settings.authors if a.get("auto_add_threshold") is not None}
        auto = F.lit(settings.auto_add)
        if own:
            auto = F.least(auto, F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in own.items() for x in pair]), F.coalesce("author_watch", F.lit(""))), auto))
        blockers = _blockers(settings, True)
        steps = [
            (hard.isNotNull(), "reject", hard),
            (mismatch.isNotNull(), "reject", mismatch),
            (~themed, "reject", "no foundation-model / VLM / uncertainty / robustness signal"),
            ((final >= auto) & (blockers == ""), "accept", ""),
            (final >= auto, "review", blockers),
            (final >= settings.review, "review", ""),
            (always, "reject", below),
        ]
    else:
        groups = Query.of(request.free_text).groups
        kind = F.when(blank(F.col("publication_type")), "title pattern").otherwise(F.col("publication_type"))
        missing = F.array_compact(F.array(*[F.when(F.col("query_hits")[i] == 0, F.lit(g[0])) for i, g in enumerate(groups)]).cast("array<string>"))
        blockers = _blockers(settings, False)
        unasked = (F.col("quality_score") >= 0.55) & (final >= settings.review - 0.1)
        steps = [
            (blank(F.col("title")), "reject", "missing title"),
            (F.lit(not allow_editorials) & F.col("scores.excluded_type"), "reject", F.concat(F.lit("excluded publication type ("), kind, F.lit(")"))),
            (F.lit(request.intent == "add_doi"), "accept", ""),
            (F.size(missing) > 0, "reject", F.concat(F.lit("does not mention: "), F.concat_ws(", ", F.slice(missing, 1, 4)))),
        ]
        if request.venues:
            steps.append((~F.coalesce(F.col("venue_key").isin(*request.venues), F.lit(False)), "reject", "not from requested venue " + "/".join(request.venues)))
        if not groups:
            steps += [(unasked, "review", "no query terms to judge relevance - check manually"), (always, "reject", F.concat(F.lit("quality "), _two(F.col("quality_score")), F.lit(" too low without a query")))]
        steps += [
            ((final >= settings.auto_add) & (blockers == ""), "accept", ""),
            (final >= settings.auto_add, "review", blockers),
            (final >= settings.review, "review", ""),
            (always, "reject", below),
        ]
    decision, reason = ladder(*steps)
    return df.withColumns({"decision": decision, "reject_reason": reason, "hard_rejected": hard.isNotNull()})


def apply_window(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Records outside a window are rejected, whatever their score."""
    why = outside_window(F.col("publication_date"), F.col("year"), start, end)
    out = why.isNotNull() & (F.col("decision") != "reject")
    return df.withColumns({"decision": F.when(out, "reject").otherwise(F.col("decision")), "reject_reason": F.when(out, why).otherwise(F.col("reject_reason"))})


def manual_add(df: DataFrame) -> DataFrame:
    """What a user asked for by identifier is never rejected, and is filed if it has topics and modalities (C11)."""
    was, why = F.col("decision"), F.col("reject_reason")
    reason = F.when(was == "reject", F.concat(F.lit("manually requested (would be rejected: "), why, F.lit(")"))).when((was == "review") & blank(why), "manual add below auto-add threshold").otherwise(why)
    filed = (was != "accept") & (F.size("topics") > 0) & (F.size("modalities") > 0)
    return df.withColumns({"reject_reason": reason, "decision": F.when(filed, "accept").when(was == "reject", "review").otherwise(was)})


def adjudicate(df: DataFrame, verdicts: DataFrame, key: str, keep: str = "relevant") -> DataFrame:
    """Records of the review band meet verdicts (key, verdict, reason); a verdict can only demote."""
    joined = df.join(verdicts.select(key, F.col("verdict"), F.col("reason").alias("verdict_reason")), key, "left")
    demoted = F.coalesce(F.col("verdict") != keep, F.lit(False)) & F.col("decision").isin("accept", "review")
    to = F.when(F.col("decision") == "accept", "review").otherwise("reject")
    return joined.withColumns({"reject_reason": F.when(demoted, F.concat(F.lit("adjudicated: "), "verdict_reason")).otherwise(F.col("reject_reason")), "decision": F.when(demoted, to).otherwise(F.col("decision"))}).drop("verdict", "verdict_reason")


#: Names shown for modalities and topics.
MODALITY_NAMES = {"cxr": "CXR", "ct": "CT", "mammo": "Mammography", "radiology-general": "General radiology"}
TOPIC_NAMES = {
    "foundation-model": "foundation model", "vlm": "VLM", "uncertainty": "uncertainty", "calibration": "calibration", "conformal-prediction": "conformal prediction",
    "ood": "OOD", "distribution-shift": "distribution shift", "robustness": "robustness", "selective-prediction": "selective prediction",
    "report-generation": "report generation", "vlm-reliability": "VLM reliability", "image-text-pretraining": "image-text pretraining",
}


def explain(df: DataFrame) -> Column:
    """What a record was found for."""
    names = F.create_map(*[F.lit(x) for pair in (MODALITY_NAMES | TOPIC_NAMES).items() for x in pair])
    parts = F.transform(F.concat("modalities", F.slice("topics", 1, 4)), lambda n: F.coalesce(F.try_element_at(names, n), n))
    base = F.when(F.size(parts) > 0, F.concat_ws(" + ", parts)).otherwise(F.lit("keyword match"))
    watch = F.when(~blank(F.col("author_watch")), F.concat(F.lit("author watch: "), "author_watch"))
    return F.concat_ws("; ", base, watch, F.when(~blank(F.col("relationship")), F.col("relationship")))
