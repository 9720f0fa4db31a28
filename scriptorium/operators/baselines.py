"""Which references a paper compares itself with: cues in citation contexts, signals from the full text, verified roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import blank, clip

#: Cues of comparison and of results, titles and contexts of datasets and tools, score limits.
STRONG_CUE = (
    r"(?i)\b(outperform\w*|better (?:than|performance|results?)|superior to|surpass\w*|compar(?:e|ed|ing|ison)\s+(?:to|with|against)"
    r"|baselines?|state[- ]of[- ]the[- ]art|sota|competing|competitors?|versus|vs\.?)\b"
)
MEDIUM_CUE = (
    r"(?i)\b(table|tab\.|figure|fig\.|results?|performance|accuracy|auc|f1|zero[- ]shot|fine[- ]tun\w*|re-?implement\w*|reproduc\w*"
    r"|following|in[- ]line with|same setting|evaluated)\b"
)
DATASET_TITLE = r"(?i)\b(dataset|database|benchmark|challenge|corpus|cohort)\b"
DATASET_CONTEXT = r"(?i)\b(dataset|database|benchmark|collected from|publicly available|images? from|split)\b"
TOOL_TITLE = r"(?i)\b(deep residual learning|an image is worth 16x16|attention is all you need|bert: pre-training|adam: a method|batch normalization|dropout: a simple|imagenet)\b"
LIKELY, POSSIBLE = 0.55, 0.30
#: What each kind of evidence adds.
WEIGHTS = {"strong": 0.45, "medium": 0.20, "table_rows": 0.30, "influential": 0.25, "result": 0.20, "methodology": 0.10, "shared_topic": 0.10, "recent": 0.05}
SECTION_WEIGHTS = {"baseline_section": 0.50, "tables": 0.35, "experiments": 0.25}
ABSENT, BACKGROUND = -0.10, -0.15


def _et_al(c: Column) -> Column:
    return F.regexp_count(c, F.lit("et al"))


def context_features(contexts: Column) -> dict[str, Column]:
    """Contexts by kind (C14): arrays strong, medium and table_rows, and whether all are long background lists."""
    strong = lambda c: c.rlike(STRONG_CUE)
    lists = F.filter(contexts, lambda c: (_et_al(c) + F.regexp_count(c, F.lit(";")) >= 4) & ~strong(c))
    return {
        "strong": F.filter(contexts, strong),
        "medium": F.filter(contexts, lambda c: c.rlike(MEDIUM_CUE)),
        "table_rows": F.filter(contexts, lambda c: (F.size(F.split(F.trim(c), r"\s+")) <= 25) & (_et_al(c) >= 2) & ~strong(c)),
        "background_only": (F.size(contexts) > 0) & (F.size(lists) == F.size(contexts)),
    }


def _if(condition: Column, weight: float) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), weight).otherwise(0.0)


def score_references(refs: DataFrame, seed_year: int | None = None, seed_topics: tuple[str, ...] = ()) -> DataFrame:
    """refs with graph_evidence.

    refs: (title, year, topics, contexts, intents, influential), and signals struct<experiments, tables, baseline_section,
    dataset_section, snippets> or null where no full text was read.
    """
    c = F.filter(F.coalesce("contexts", F.array().cast("array<string>")), lambda x: ~blank(x))
    intents = F.coalesce("intents", F.array().cast("array<string>"))
    df = refs.withColumns({"c": c, "i": intents}).withColumn("f", F.struct(*[v.alias(k) for k, v in context_features(F.col("c")).items()]))
    sig = F.col("signals")
    count = lambda n: F.coalesce(sig[n], F.lit(0)) > 0
    models = F.array(F.lit("foundation-model"), F.lit("vlm"))
    seed = F.array(*[F.lit(t) for t in seed_topics]).cast("array<string>")
    both = F.arrays_overlap("topics", models) & F.lit(bool({"foundation-model", "vlm"} & set(seed_topics)))
    evidence = {
        "strong": F.size("f.strong") > 0,
        "medium": F.size("f.medium") > 0,
        "table_rows": F.size("f.table_rows") > 0,
        "influential": F.col("influential"),
        "result": F.array_contains("i", "result"),
        "methodology": F.array_contains("i", "methodology"),
        "shared_topic": F.arrays_overlap("topics", seed) | both,
        "recent": (F.lit(seed_year) - F.col("year")).between(0, 4) if seed_year else F.lit(False),
    }
    total = sum((_if(evidence[k], w) for k, w in WEIGHTS.items()), F.lit(0.0))
    read = sig.isNotNull()
    total = total + sum((_if(read & count(k), w) for k, w in SECTION_WEIGHTS.items()), F.lit(0.0))
    total = total + _if(read & ~count("experiments") & ~count("tables"), ABSENT) + _if(F.col("f.background_only") & ~count("experiments"), BACKGROUND)
    df = df.withColumn("s", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 3))
    data_only = count("dataset_section") & ~count("baseline_section")
    data_contexts = (F.size("c") > 0) & F.forall("c", lambda x: x.rlike(DATASET_CONTEXT)) & (F.size("f.strong") == 0)
    label = (
        F.when(F.coalesce(F.col("title").rlike(DATASET_TITLE), F.lit(False)) | data_only | data_contexts, "benchmark/dataset")
        .when(F.col("title").rlike(TOOL_TITLE), "backbone/tool")
        .when(F.col("s") >= LIKELY, "likely baseline")
        .when(F.col("s") >= POSSIBLE, "possible baseline")
        .otherwise("background reference")
    )
    first = F.coalesce(*[F.get(x, F.lit(0)) for x in (F.col("f.strong"), sig["snippets"], F.col("f.table_rows"), F.col("f.medium"), F.col("c"))], F.lit(""))
    cited = [F.coalesce(sig[n], F.lit(0)).cast("int").alias(f"cited_in_{n}") for n in ("experiments", "tables", "baseline_section")]
    found = F.struct(
        F.col("s").alias("score"), label.alias("label"), clip(first).alias("evidence"), F.lit("citation context").alias("evidence_source"),
        F.coalesce("influential", F.lit(False)).alias("influential"), F.array_sort("i").alias("intents"), *cited,
    )
    return df.withColumn("graph_evidence", found).drop("c", "i", "f", "s")


def combine_roles(label: Column, score: Column, role: Column, was_read: Column) -> tuple[Column, Column]:
    """(label, score) of a reference after a verified role, or after a reading that named none."""
    likely = label == "likely baseline"
    out = (
        F.when((role == "baseline") & (label == "benchmark/dataset"), "possible baseline")
        .when(role == "baseline", "likely baseline")
        .when(role == "dataset", "benchmark/dataset")
        .when(role == "backbone", F.when(likely & (score >= 0.75), "possible baseline").otherwise("backbone/tool"))
        .when(role == "background", F.when(likely, "possible baseline").otherwise("background reference"))
        .when(was_read & likely, "possible baseline")
        .otherwise(label)
    )
    raised = F.when((role == "baseline") & (label != "benchmark/dataset"), F.greatest(score, F.lit(0.8))).otherwise(score)
    return out, raised


def verified_roles(verdicts: DataFrame, read: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ref_id, role, quote): verdicts whose quote stands in the text that was read (C13). read: (key, text)."""
    from scriptorium.operators.fulltext import MARKER, quote_verified

    known = F.col("role").isin("baseline", "dataset", "backbone", "background")
    cited = F.col("text").contains(F.concat(F.lit("["), F.col("ref_id"), F.lit("]")))
    met = verdicts.where(known).join(read, key).where(cited & quote_verified(F.col("evidence"), F.col("text")))
    return met.select(key, "ref_id", "role", clip(F.regexp_replace("evidence", MARKER, "")).alias("quote"))
