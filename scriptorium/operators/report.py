"""Counts, histograms, quality metrics, and a run's report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rejection_histogram(df: DataFrame) -> DataFrame:
    """(reason, n) of rejected rows, reasons cut at their details, score reasons together."""
    cut = F.substring_index("reject_reason", " (", 1)
    reason = F.when(cut.rlike("^score .* below"), "score below review threshold").when(cut == "", "unspecified").otherwise(cut)
    return df.where(F.col("decision") == "reject").groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def run_counters(df: DataFrame) -> DataFrame:
    """One row of a run's counts (A05); rows carry decision, route and hard_rejected."""
    is_route = lambda r: F.count_if(F.col("route") == r)
    of = lambda d: F.count_if((F.col("decision") == d) & (F.col("route") == "candidate"))
    return df.agg(
        F.count("*").alias("retrieved"), F.count_if(~F.col("hard_rejected")).alias("after_filtering"), is_route("existing").alias("existing"),
        is_route("upgrade").alias("upgrades"), of("accept").alias("accepted"), of("review").alias("review"), of("reject").alias("rejected"),
    )


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n) of references by role."""
    return df.groupBy(label).agg(F.count("*").alias("n"))


def usage(calls: DataFrame) -> DataFrame:
    """Calls and tokens of a run's model calls, by task (A13). calls: (task, input_tokens, output_tokens)."""
    return calls.groupBy("task").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def metrics(df: DataFrame, label: str = "label", decision: str = "decision", wrong: str | None = None, checked: str | None = None) -> DataFrame:
    """Precision of accepted rows, recall of accepted and reviewed ones, false positives, metadata errors; null without a
    denominator (A06)."""
    kept = F.col(decision).isin("accept", "review")
    share = lambda of, among: F.round(F.try_divide(F.count_if(of & among), F.count_if(among)), 3)
    columns = [
        F.count("*").alias("n"),
        share(F.col(label) == "relevant", F.col(decision) == "accept").alias("precision_auto_add"),
        share(kept, F.col(label) == "relevant").alias("recall_review"),
        share(kept, F.col(label) == "irrelevant").alias("false_positive_rate"),
    ]
    if wrong and checked:
        columns.append(F.round(F.try_divide(F.sum(wrong), F.sum(checked)), 3).alias("metadata_error_rate"))
    return df.agg(*columns)


def by_decision(df: DataFrame, decision: str, score: str = "final_score", key: str = "paper_id") -> DataFrame:
    """Rows of a decision, best first."""
    return df.where(F.col("decision") == decision).orderBy(F.desc(score), key)


def render(result: DataFrame, title: str, notes: tuple[str, ...] = (), shown: int = 30, missed: int = 15) -> str:
    """A run's report as markdown (K10); lists are cut to what a reader can take in, counts are of all rows."""
    from scriptorium.operators.topk import near_misses

    c = run_counters(result).first().asDict()
    lines = [f"# {title}", "", *[f"- {k.replace('_', ' ')}: {v}" for k, v in c.items()], *[f"- {n}" for n in notes]]
    entry = F.concat_ws(" ", F.format_number("final_score", 2), F.col("title"), F.concat(F.lit("("), F.coalesce("venue", F.lit("unknown venue")), F.lit(")")), F.when(F.col("reject_reason") != "", F.concat(F.lit("- "), "reject_reason")))
    for heading, rows, k in (
        ("Accepted", by_decision(result.where("route = 'candidate'"), "accept"), shown),
        ("To review", by_decision(result.where("route = 'candidate'"), "review"), shown),
        ("Already in the library", result.where("route = 'existing'").orderBy(F.desc("final_score"), "paper_id"), shown),
        ("Upgrades of preprints", result.where("route = 'upgrade'").orderBy(F.desc("final_score"), "paper_id"), shown),
        ("Near misses", near_misses(result.where("route = 'candidate'"), k=missed), missed),
    ):
        told = [r["entry"] for r in rows.limit(k).select(entry.alias("entry")).collect()]
        if told:
            lines += ["", f"## {heading}", *[f"- {t}" for t in told]]
    reasons = rejection_histogram(result).limit(shown).collect()
    if reasons:
        lines += ["", "## Why rows were rejected", *[f"- {r['reason']}: {r['n']}" for r in reasons]]
    return "\n".join(lines) + "\n"
