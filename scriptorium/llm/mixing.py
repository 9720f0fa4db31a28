"""Mixing sources to target weights by iterative proportional fitting.

Every document belongs to a cell (source, lang, topic); what a target table doesn't name is "*". Its topic is the one whose
patterns weigh most in its text, if they weigh LEAST in a thousand words, or prose. One aggregation sums the words of each
cell. The driver rakes the cells' word weights, of which there are at most as many as the target tables' sizes multiply
to, to the source, language and topic marginals in turn, ROUNDS times. A cell's density is its raked weight over its words;
with `rate` as the share of words to draw, a document is drawn with probability least(1, rate * density), by a hash of its
doc_id, so the draw is the same on any cluster and no row is moved. weight is rate * density over the probability: 1, or
more where a cell can't give as much as its target asks for. Words stand for tokens: they need no tokenizer and are the same
in Spark and SQL.

Targets of categories that hold no words are spread over the others in proportion. A category without a target (and no "*")
is drawn with probability 0; where no category that holds words has one, the marginal stays as it is. Null texts have no
words; cells without words have density 0 before raking and their documents, which carry no weight in any marginal, are
drawn with probability `rate`. Null sources and languages are "*". Rows that share a doc_id (or have none) are drawn
together. All columns of the input stay; mix_topic, mix_words, mix_probability and mix_weight are added, with "_" before
them as often as it takes for no column of the input to begin like them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER, ROUNDS, SEED = "*", 25, "mix"
MARGINALS = ("source", "lang", "topic")

#: Topics: what tells them in lower-cased texts, each pattern with a string that all it matches hold, and the weight of each
#: time it does; ties go to the first.
TOPICS = {
    "legal": ((("licen", "licen[cs]e"), ("copyright", "copyright"), ("warrant", "warrant"), ("permission", "permission"), ("liabilit", "liabilit")), 10),
    "contact": ((("@", "@[a-z0-9-]+[.][a-z]"), ("http", "https?://"), ("-", "[0-9]{3}-[0-9]{3,4}-[0-9]{4}")), 10),
    "symbols": ((("", "[#%&$*<>]{3,}"),), 4),
    "table": (((" | ", " [|] "),), 1),
}
PROSE, LEAST = "prose", 10


@dataclass(frozen=True)
class Targets:
    """Shares of words by category of each marginal."""

    source: dict[str, float] = field(default_factory=lambda: {"src0": 0.30, OTHER: 0.70})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 0.57, "de": 0.15, "fr": 0.14, "es": 0.11, OTHER: 0.03})
    topic: dict[str, float] = field(default_factory=lambda: {"legal": 0.06, "table": 0.02, "symbols": 0.03, "contact": 0.06, PROSE: 0.83})


RATE = 0.6


def hits_of(low: Column, topic: str) -> Column:
    """What a topic's patterns weigh in a lower-cased text."""
    patterns, weight = TOPICS[topic]
    count = lambda p: F.coalesce(F.regexp_count(low, F.lit(p)), F.lit(0)).cast("long")
    each = [F.when(low.contains(held), count(p)).otherwise(F.lit(0).cast("long")) if held else count(p) for held, p in patterns]
    return sum(each[1:], each[0]) * weight


def topic_of(hits: dict[str, Column], words: Column) -> Column:
    """The topic whose patterns weigh most, if they weigh enough for so many words."""
    best = F.greatest(*hits.values())
    out = F.when((best == 0) | (best * 1000 < words * LEAST), PROSE)
    for topic, n in hits.items():
        out = out.when(n == best, topic)
    return out.otherwise(PROSE)


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _category(column: Column, target: dict[str, float]) -> Column:
    return F.when(column.isin(*[k for k in target if k != OTHER]), column).otherwise(OTHER)


def rake(cells: dict[tuple[str, ...], float], targets: list[dict[str, float]], rounds: int = ROUNDS) -> dict[tuple[str, ...], float]:
    """Weights of cells (a category of each marginal) whose sums by category are fitted to the targets' shares."""
    total = float(sum(cells.values()))
    weights = {k: float(w) for k, w in cells.items()}
    if not total:
        return weights
    goals = []
    for i, target in enumerate(targets):
        present = {k[i] for k, w in cells.items() if w > 0}
        known = {c: target.get(c, 0.0) for c in present}
        whole = sum(known.values())
        if whole > 0:
            goals.append((i, {c: total * share / whole for c, share in known.items()}))
    for _ in range(rounds):
        for i, goal in goals:
            sums: dict[str, float] = {}
            for k in sorted(weights):
                sums[k[i]] = sums.get(k[i], 0.0) + weights[k]
            weights = {k: w * goal.get(k[i], 0.0) / sums[k[i]] if sums[k[i]] else 0.0 for k, w in weights.items()}
    return weights


def mix(df: DataFrame, targets: Targets | None = None, rate: float = RATE, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """The drawn rows of df, with mix_topic, mix_words, mix_probability and mix_weight."""
    targets, prefix = targets or Targets(), "mix_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    name = lambda n: f"{prefix}{n}"
    tables = [getattr(targets, m) for m in MARGINALS]
    cells = [name(f"cell_{m}") for m in MARGINALS]
    # columns of their own, so that each text is lowered once and each pattern counted once
    placed = df.withColumns({name("words"): words_of(F.col(text)), name("low"): F.lower(F.coalesce(F.col(text), F.lit("")))})
    placed = placed.withColumns({name(f"hits_{t}"): hits_of(F.col(name("low")), t) for t in TOPICS}).drop(name("low"))
    placed = placed.withColumn(name("topic"), topic_of({t: F.col(name(f"hits_{t}")) for t in TOPICS}, F.col(name("words"))))
    own = [F.col("source"), F.col("lang"), F.col(name("topic"))]
    placed = placed.withColumns({c: _category(o, t) for c, o, t in zip(cells, own, tables, strict=True)})
    summed = placed.groupBy(*cells).agg(F.sum(name("words")).alias("w")).collect()
    before = {tuple(r[c] for c in cells): float(r["w"]) for r in summed}
    raked = rake(before, tables, rounds)
    rows = [(*k, raked[k] / w * rate if w else rate) for k, w in sorted(before.items())]
    assert len(rows) <= prod(len({*t, OTHER}) for t in tables)  # what is broadcast is bounded by the targets
    schema = ", ".join(f"{c} string" for c in cells) + f", {name('density')} double"
    found = placed.join(F.broadcast(df.sparkSession.createDataFrame(rows, schema)), cells)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    probability = F.round(F.least(F.lit(1.0), F.col(name("density"))), 9)
    drawn = found.withColumn(name("probability"), probability).where(draw < F.col(name("probability")))
    drawn = drawn.withColumn(name("weight"), F.round(F.greatest(F.lit(1.0), F.col(name("density"))), 9))
    return drawn.select(*df.columns, *map(name, ("topic", "words", "probability", "weight")))


def oracle(targets: Targets | None = None, rate: float = RATE, rounds: int = ROUNDS, seed: str = SEED) -> str:
    """DuckDB SQL of mix() over documents, in the columns of op4."""
    targets = targets or Targets()
    tables = [getattr(targets, m) for m in MARGINALS]

    def listed(names):
        return ", ".join(f"'{n}'" for n in names)

    summed = lambda patterns: " + ".join(f"len(regexp_extract_all(low, '{p}'))::BIGINT" for _, p in patterns)
    hits = ", ".join(f"{weight} * ({summed(patterns)}) AS h{i}" for i, (patterns, weight) in enumerate(TOPICS.values()))
    best = f"greatest({', '.join(f'h{i}' for i in range(len(TOPICS)))})"
    told = " ".join(f"WHEN h{i} = {best} THEN '{t}'" for i, t in enumerate(TOPICS))
    topic = f"CASE WHEN {best} = 0 OR {best} * 1000 < words * {LEAST} THEN '{PROSE}' {told} END"
    cells = ", ".join(f"CASE WHEN {m} IN ({listed(c for c in t if c != OTHER)}) THEN {m} ELSE '{OTHER}' END AS c{i}" for i, (m, t) in enumerate(zip(MARGINALS, tables, strict=True)))
    parts = [
        f"told AS (SELECT *, {hits} FROM (SELECT doc_id, source, lang, lower(coalesce(text, '')) AS low, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words FROM documents))",
        f"placed AS MATERIALIZED (SELECT *, {cells} FROM (SELECT doc_id, source, lang, words, {topic} AS topic FROM told))",
        "before AS MATERIALIZED (SELECT c0, c1, c2, sum(words)::DOUBLE AS n FROM placed GROUP BY ALL)",
        "r0 AS MATERIALIZED (SELECT *, n AS w FROM before)",
    ]
    goals = []
    for i, target in enumerate(tables):
        values = ", ".join(f"('{c}', {share!r}::DOUBLE)" for c, share in target.items())
        parts.append(f"t{i} AS MATERIALIZED (SELECT c, share / sum(share) OVER () * (SELECT sum(n) FROM before) AS goal FROM (VALUES {values}) v(c, share) WHERE c IN (SELECT c{i} FROM before WHERE n > 0))")
        goals.append(f"t{i}")
    last = 0
    for _ in range(rounds):
        for i in range(len(tables)):
            parts.append(f"r{last + 1} AS MATERIALIZED (SELECT c0, c1, c2, n, CASE WHEN (SELECT count(*) FROM t{i}) = 0 THEN w ELSE coalesce(w * goal / nullif(sum(w) OVER (PARTITION BY c{i}), 0), 0) END AS w FROM r{last} LEFT JOIN t{i} ON c = c{i})")
            last += 1
    parts.append(f"density AS (SELECT c0, c1, c2, CASE WHEN n > 0 THEN w / n * {rate!r} ELSE {rate!r} END AS d FROM r{last})")
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT doc_id, source, lang, topic, words, round(least(1.0, d), 9)::DOUBLE AS probability, round(greatest(1.0, d), 9)::DOUBLE AS weight"
        f" FROM placed JOIN density USING (c0, c1, c2) WHERE ('0x' || substr(md5('{seed}:' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < round(least(1.0, d), 9)"
    )
