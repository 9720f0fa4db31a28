"""Judgements by language models as data (H10): which rows to ask about, what to ask, and what the landed answers say.

What calls a model is outside the engine: it reads requests() and lands answers; verdicts() reads them. Which provider and
model are asked follows from the credentials that there are and from the names that a provider lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import blank
from scriptorium.operators.topk import adjudication_band, best_per_group
from scriptorium.plans.config import secret

#: What a verdict may be, and how much of an abstract is shown.
VERDICTS, SHOWN = ("accept", "review", "reject"), 4000
_SAID = "decision string, reason string, input_tokens long, output_tokens long"


def provider(credentials: dict[str, str], wanted: str | None = None) -> str | None:
    """The provider that is wanted, or the first, among those whose credential is in the environment.

    credentials: by provider, in order of preference, the name of the variable that holds its credential.
    """
    there = [name for name, variable in credentials.items() if secret(variable)]
    return (wanted if wanted in there else None) if wanted else next(iter(there), None)


def requests(decided: DataFrame, threshold: float, most: int, asked: str = "", key: str = "paper_id") -> DataFrame:
    """(key, prompt) of the rows nearest to the threshold, as many as a run may ask about."""
    band = adjudication_band(decided, threshold, most, key=key)
    abstract = F.when(blank(F.col("abstract")), "(no abstract)").otherwise(F.substring("abstract", 1, SHOWN))
    lines = [F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Venue: "), F.coalesce("venue", F.lit("")), F.lit(" ("), F.coalesce("venue_type", F.lit("")), F.lit(")")), F.concat(F.lit("Abstract: "), abstract)]
    return band.select(key, F.concat_ws("\n", *lines, F.lit(asked) if asked else F.lit(None).cast("string")).alias("prompt"))


def verdicts(answers: DataFrame, key: str = "paper_id") -> DataFrame:
    """(key, verdict, reason) of landed answers (key, landed_at, body): the last one of each row that is a verdict at all."""
    said = answers.withColumn("said", F.from_json("body", _SAID)).where(F.col("said.decision").isin(*VERDICTS))
    last = best_per_group(said, key, F.desc("landed_at"))
    # "relevant" is what a verdict must say for a row to keep its decision
    verdict = F.when(F.col("said.decision") == "accept", "relevant").otherwise(F.col("said.decision"))
    return last.select(key, verdict.alias("verdict"), F.coalesce("said.reason", F.lit("")).alias("reason"))


def tokens_used(answers: DataFrame, task: str = "relevance") -> DataFrame:
    """(task, input_tokens, output_tokens) of each landed answer, for report.usage()."""
    said = answers.select(F.from_json("body", _SAID).alias("said"))
    return said.select(F.lit(task).alias("task"), *[F.coalesce(f"said.{n}", F.lit(0)).alias(n) for n in ("input_tokens", "output_tokens")])
