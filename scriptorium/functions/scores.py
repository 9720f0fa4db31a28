"""Scores between 0 and 1, to four places. The constants are the contract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of relevance and quality in the final score.
FINAL = (0.70, 0.30)


def four(c: Column) -> Column:
    """Four places, by way of ten: sums that differ in their last bits round alike."""
    return F.round(F.round(c, 10), 4)


def recency(age: Column) -> Column:
    """1 within a year, 0 from five years on."""
    return four(F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), age - 1) / 4))


def citation_signal(citations: Column, age: Column, normalize_age: bool = True) -> Column:
    """Citations a year on a log scale; very new records lean on 0.5."""
    old = F.greatest(age, F.lit(0.5))
    count = F.coalesce(citations, F.lit(0))
    signal = F.least(F.lit(1.0), F.log1p(count / old if normalize_age else count / F.lit(3.0)) / F.log1p(F.lit(50.0)))
    trust = F.least(F.lit(1.0), old / 2)
    return four(trust * signal + (1 - trust) * 0.5 if normalize_age else signal)


def metadata_confidence(checks: list[Column], sources: Column) -> Column:
    """The share of metadata present, raised by further sources, lowered by none."""
    share = sum((F.when(c, 1).otherwise(0) for c in checks), F.lit(0)) / F.lit(len(checks))
    return four(F.least(F.lit(1.0), share * 0.85 + F.least(F.lit(1.0), (sources - 1) / F.lit(2.0)) * 0.15))


def methodological_relevance(method_tags: Column, survey: Column) -> Column:
    """More method tags count more; surveys are capped."""
    score = F.least(F.lit(1.0), F.least(F.lit(2), method_tags) * 0.2 + 0.6)
    return four(F.when(survey, F.least(score, F.lit(0.7))).otherwise(score))


def quality(venue: Column, peer: Column, citations: Column, method: Column, metadata: Column) -> Column:
    """Weighted quality, not rounded."""
    return venue * 0.40 + peer * 0.20 + citations * 0.15 + method * 0.15 + metadata * 0.10


def general_relevance(coverage: Column, all_present: Column, title_coverage: Column, author: Column, recent: Column) -> Column:
    """Relevance to a query's own terms, not rounded."""
    return coverage * 0.45 + all_present * 0.25 + title_coverage * 0.10 + author * 0.10 + recent * 0.10


def topical_relevance(topic: Column, modality: Column, keyword: Column, author: Column, recent: Column) -> Column:
    """Relevance to a fixed ontology, not rounded."""
    return topic * 0.35 + modality * 0.25 + keyword * 0.20 + author * 0.10 + recent * 0.10


def final_score(relevance: Column, quality_: Column) -> Column:
    """M08."""
    return four(relevance * FINAL[0] + quality_ * FINAL[1])


def keyword_share(text: Column, words: list[str]) -> Column:
    """The share of query words contained in lower-case text."""
    hits = sum((F.when(text.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    return four(hits / F.lit(len(words)))


def blend(scores: list[Column]) -> Column:
    """0.6 of the least and 0.4 of the mean of requested scores."""
    least = scores[0] if len(scores) == 1 else F.least(*scores)
    return four(least * 0.6 + sum(scores[1:], scores[0]) / F.lit(float(len(scores))) * 0.4)
