"""Queries on scans, filters, boolean search, scoring, decisions and caps."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import scores as S
from scriptorium.functions.dates import age_years, outside_window
from scriptorium.functions.text import normalize_title, strip_markup
from scriptorium.operators import report, topk
from scriptorium.operators.decide import ladder
from scriptorium.plans.boolean import Query, cross_queries, term_pattern
from scriptorium.plans.registry import query
from scriptorium.session import table

TODAY = date(2000, 1, 1)
AUTO, REVIEW, CAP = 0.80, 0.68, 25
SEARCH = Query.of("(the OR and) AND (with OR that)")
_P = {t: "(?i)" + term_pattern(t, False) for t in ("the", "and", "with", "that")}


def _title(text: F.Column) -> F.Column:
    return F.substring_index(text, "\n", 1)


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers with the hits of SEARCH: the first line is the title, equal texts are one.

    Hits and the key of a text are made where it is read; no text is shuffled, and documents are read once.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    key = F.lower(F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " ")))
    h0, h1 = SEARCH.hits(_title(F.col("text")), F.col("text"), lookbehind=False)
    told = d.select(F.sha2(key, 256).alias("text_key"), F.struct("doc_id", "n_chars", h0.alias("h0"), h1.alias("h1")).alias("paper"))
    return told.groupBy("text_key").agg(F.min_by("paper", "paper.doc_id").alias("paper")).select("paper.*")


def _hit_sql(a: str, b: str) -> str:
    p = f"{_P[a]}|{term_pattern(b, False)}"
    return f"CASE WHEN regexp_matches(title, '{p}') THEN 1.0 WHEN regexp_matches(text, '{p}') THEN 0.6 ELSE 0.0 END"


_DOCS_SQL = """d AS (SELECT doc_id, text, source, n_chars, split_part(text, chr(10), 1) AS title,
  sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')))) AS text_key FROM documents),
p AS (SELECT d.* FROM d JOIN (SELECT text_key, min(doc_id) AS doc_id FROM d GROUP BY text_key) f USING (doc_id)),"""
_DECIDED_SQL = f"""
h AS (SELECT *, ({_hit_sql("the", "and")})::DOUBLE AS h0, ({_hit_sql("with", "that")})::DOUBLE AS h1 FROM p),
s AS (SELECT *, (h0 + h1) / 2 AS coverage, CASE WHEN h0 > 0 AND h1 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS whole,
  ((h0 = 1.0)::INT + (h1 = 1.0)::INT) / 2.0::DOUBLE AS in_title, least(1.0, n_chars / 6000.0)::DOUBLE AS quality FROM h),
f AS (SELECT *, round((0.70 * (coverage * 0.45 + whole * 0.25 + in_title * 0.10 + 0.10 + 0.05) + 0.30 * quality)::DECIMAL(18,10), 4)::DOUBLE AS final_score FROM s),
x AS (SELECT *, CASE WHEN whole = 0 THEN 'reject' WHEN final_score >= {AUTO} THEN 'accept' WHEN final_score >= {REVIEW} THEN 'review' ELSE 'reject' END AS decision,
  CASE WHEN whole = 0 THEN 'does not mention a term of every group' WHEN final_score >= {REVIEW} THEN '' ELSE 'score below review threshold' END AS reject_reason FROM f)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _papers(spark, sf_dir)
    whole = F.when((F.col("h0") > 0) & (F.col("h1") > 0), 1.0).otherwise(0.0)
    in_title = ((F.col("h0") == 1.0).cast("int") + (F.col("h1") == 1.0).cast("int")) / F.lit(2.0)
    relevance = S.general_relevance((F.col("h0") + F.col("h1")) / 2, whole, in_title, F.lit(1.0), F.lit(0.5))
    quality = F.least(F.lit(1.0), F.col("n_chars") / F.lit(6000.0))
    df = df.withColumns({"whole": whole, "final_score": S.final_score(relevance, quality)})
    always = F.lit(True)
    decision, reason = ladder(
        (F.col("whole") == 0, "reject", "does not mention a term of every group"),
        (F.col("final_score") >= AUTO, "accept", ""),
        (F.col("final_score") >= REVIEW, "review", ""),
        (always, "reject", "score below review threshold"),
    )
    return df.withColumns({"decision": decision, "reject_reason": reason, "hard_rejected": F.lit(False)})


@query(f"""WITH {_DOCS_SQL}{_DECIDED_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY final_score DESC, doc_id) AS place FROM x)
SELECT doc_id, final_score, CASE WHEN decision = 'accept' AND place > {CAP} THEN 'review' ELSE decision END AS decision,
  CASE WHEN decision = 'accept' AND place > {CAP} THEN 'auto-add limit of {CAP} per run reached' ELSE reject_reason END AS reject_reason FROM r""")
def search_decide_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boolean search, exact dedup, scores, decisions, and the cap on accepted rows."""
    return topk.rate_limit(_scored(spark, sf_dir), CAP, key="doc_id").select("doc_id", "final_score", "decision", "reject_reason")


@query(f"""WITH {_DOCS_SQL}{_DECIDED_SQL}
SELECT doc_id, final_score FROM x WHERE decision = 'reject' AND final_score >= 0.55 ORDER BY final_score DESC, doc_id LIMIT 15""")
def near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rejected rows, a top-k report."""
    return topk.near_misses(_scored(spark, sf_dir), key="doc_id").select("doc_id", "final_score")


@query(f"""WITH {_DOCS_SQL}{_DECIDED_SQL}
SELECT doc_id, final_score, decision FROM x WHERE decision = 'review' OR (decision = 'accept' AND final_score < {AUTO} + 0.1) ORDER BY final_score DESC, doc_id LIMIT 40""")
def adjudication_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows nearest to the threshold, up to the number of calls that a run may make."""
    return topk.adjudication_band(_scored(spark, sf_dir), AUTO, 40, key="doc_id").select("doc_id", "final_score", "decision")


@query(f"""WITH {_DOCS_SQL}{_DECIDED_SQL} SELECT reject_reason AS reason, count(*) AS n FROM x WHERE decision = 'reject' GROUP BY 1""")
def rejection_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why rows were rejected."""
    return report.rejection_histogram(_scored(spark, sf_dir))


_QUERY_TEXTS = {"both": "(the OR and) AND (with OR that)", "phrase": '"of the"; that', "plain": "thing other"}
_COMPILED = {k: Query.of(v, k, expand=False) for k, v in _QUERY_TEXTS.items()}


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS query, doc_id FROM documents WHERE {q.sql('text')}" for k, q in _COMPILED.items()) + ")")
def boolean_query_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that match each of several boolean queries, in one pass over the table."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = F.array_compact(F.array(*[F.when(q.matches(F.col("text"), lookbehind=False), F.lit(k)) for k, q in _COMPILED.items()]))
    return d.select(F.explode(names).alias("query"), "doc_id")


_CROSS = [Query(((m,), tuple(t)), f"{m}+{'/'.join(t)}") for m in ("the", "and") for t in (["with", "from"], ["that"])]


@query("SELECT doc_id, string_agg(label, ';' ORDER BY label) AS labels FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{q.label}' AS label FROM documents WHERE {q.sql('text')}" for q in _CROSS) + ") GROUP BY doc_id")
def query_expansion_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cross product of queries, its scans united, with the labels that each document was found by."""
    assert len(cross_queries()) == 12
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = F.array_compact(F.array(*[F.when(q.matches(F.col("text"), lookbehind=False), F.lit(q.label)) for q in _CROSS]))
    return d.select("doc_id", F.array_join(F.array_sort(labels), ";").alias("labels")).where("labels <> ''")


_WORDS = ["the", "that", "with", "ing", "und"]


@query("SELECT doc_id, round((" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in _WORDS) + f") / {len(_WORDS)}.0::DOUBLE, 4) AS share FROM documents")
def keyword_match_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of query words in each text."""
    return table(spark, sf_dir, "documents").select("doc_id", S.keyword_share(F.lower("text"), _WORDS).alias("share"))


_TERMS = [(r"(?i)\bthat\b", 1.0), (r"(?i)\bfrom\b", 0.9), (r"(?i)\bwith\b", 0.6), (r"(?i)\bthis\b", 0.4)]


def _total_sql(column: str) -> str:
    return "(" + " + ".join(f"CASE WHEN regexp_matches({column}, '{p}') THEN {w} ELSE 0.0 END" for p, w in _TERMS) + ")::DOUBLE"


def _strong_sql(column: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p}')" for p, w in _TERMS if w >= 0.9) + ")"


_COUNT_SQL = "(" + " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p, _ in _TERMS) + ")"


_LADDER_SQL = """CASE WHEN o_orderstatus = 'P' THEN 'reject' WHEN o_totalprice >= 300000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'accept'
  WHEN o_totalprice >= 300000 THEN 'review' WHEN o_totalprice >= 100000 THEN 'review' ELSE 'reject' END AS decision,
  CASE WHEN o_orderstatus = 'P' THEN 'status is pending' WHEN o_totalprice >= 300000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN ''
  WHEN o_totalprice >= 300000 THEN 'low priority' WHEN o_totalprice >= 100000 THEN '' ELSE 'price below threshold' END AS reject_reason"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    dear = F.col("o_totalprice") >= 300000
    decision, reason = ladder(
        (F.col("o_orderstatus") == "P", "reject", "status is pending"),
        (dear & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "accept", ""),
        (dear, "review", "low priority"),
        (F.col("o_totalprice") >= 100000, "review", ""),
        (F.lit(True), "reject", "price below threshold"),
    )
    return o.withColumns({"decision": decision, "reject_reason": reason, "hard_rejected": F.col("o_orderstatus") == "P"})


@query(f"""WITH x AS (SELECT o_orderkey, o_totalprice, {_LADDER_SQL} FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY o_totalprice DESC, o_orderkey) AS place FROM x)
SELECT o_orderkey, CASE WHEN decision = 'accept' AND place > 25 THEN 'review' ELSE decision END AS decision,
  CASE WHEN decision = 'accept' AND place > 25 THEN 'auto-add limit of 25 per run reached' ELSE reject_reason END AS reject_reason FROM r""")
def rate_limit_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap on accepted rows; those beyond it are demoted, not dropped."""
    return topk.rate_limit(_orders(spark, sf_dir), 25, "o_totalprice", "o_orderkey").select("o_orderkey", "decision", "reject_reason")


@query(f"""WITH x AS (SELECT o_orderkey, o_totalprice, {_LADDER_SQL} FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY decision IN ('accept', 'review') ORDER BY o_totalprice DESC, o_orderkey) AS place FROM x)
SELECT o_orderkey, CASE WHEN decision IN ('accept', 'review') AND place > 100 THEN 'reject' ELSE decision END AS decision,
  CASE WHEN decision IN ('accept', 'review') AND place > 100 THEN 'beyond the requested limit of 100' ELSE reject_reason END AS reject_reason FROM r""")
def request_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request's own limit over accepted and reviewed rows."""
    return topk.request_limit(_orders(spark, sf_dir), 100, "o_totalprice", "o_orderkey").select("o_orderkey", "decision", "reject_reason")


@query(f"""WITH x AS (SELECT o_orderkey, o_orderstatus, {_LADDER_SQL} FROM orders)
SELECT count(*) AS retrieved, count(*) FILTER (WHERE o_orderstatus <> 'P') AS after_filtering, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS existing,
  0::BIGINT AS upgrades, count(*) FILTER (WHERE decision = 'accept' AND o_orderkey % 10 <> 0) AS accepted,
  count(*) FILTER (WHERE decision = 'review' AND o_orderkey % 10 <> 0) AS review, count(*) FILTER (WHERE decision = 'reject' AND o_orderkey % 10 <> 0) AS rejected FROM x""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a run in one pass."""
    routed = _orders(spark, sf_dir).withColumn("route", F.when(F.col("o_orderkey") % 10 == 0, "existing").otherwise("candidate"))
    return report.run_counters(routed)


@query("SELECT o_orderkey, o_totalprice, greatest(0, (SELECT count(*) FROM orders) - 30) AS overflow FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def top_existing_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's list of the best rows, and how many more there are."""
    return topk.top_with_overflow(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 30, "o_totalprice", "o_orderkey")


@query(f"""WITH x AS (SELECT o_orderkey, o_totalprice, {_LADDER_SQL} FROM orders)
SELECT o_orderkey, decision, o_totalprice FROM x WHERE decision IN ('accept', 'review')""")
def proposals_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run proposes: accepted and reviewed rows, written and read back."""
    from scriptorium.session import scratch_path
    from scriptorium.sources.sinks import load_proposals, save_proposals

    path = scratch_path(spark, "proposals")
    save_proposals(_orders(spark, sf_dir).select("o_orderkey", "decision", "o_totalprice"), path, "o_totalprice", "o_orderkey")
    return load_proposals(spark, path, "o_orderkey bigint, decision string, o_totalprice double")


_AGE = "greatest(0, date_diff('day', o_orderdate::DATE, DATE '2000-01-01') / 365.25)"


@query(f"SELECT o_orderkey, round(greatest(0.0, 1 - greatest(0.0, {_AGE} - 1) / 4), 4)::DOUBLE AS recency FROM orders")
def recency_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How recent each row is at a given day."""
    age = age_years(F.col("o_orderdate").cast("date"), F.lit(None).cast("int"), TODAY)
    return table(spark, sf_dir, "orders").select("o_orderkey", S.recency(age).alias("recency"))


@query("""WITH u AS (SELECT user_id, count(*) AS n, greatest(0.0, date_diff('day', min(ts)::DATE, DATE '2024-06-30') / 365.25) AS age FROM events GROUP BY user_id),
s AS (SELECT user_id, least(1.0, ln(1 + n / greatest(age, 0.5)) / ln(51)) AS signal, least(1.0, greatest(age, 0.5) / 2) AS w FROM u)
SELECT user_id, round(w * signal + (1 - w) * 0.5, 4)::DOUBLE AS citation_signal FROM s""")
def citation_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a year of each user on a log scale, new users held near a half."""
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").cast("date").alias("first"))
    age = age_years(F.col("first"), F.lit(None).cast("int"), date(2024, 6, 30))
    return u.select("user_id", S.citation_signal(F.col("n"), age).alias("citation_signal"))


_WEIGHTS = {"Brand#11": 1.0, "Brand#12": 0.9, "Brand#23": 0.8, "Brand#34": 0.6}


@query("""WITH w AS (SELECT p_partkey, CASE p_brand """ + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _WEIGHTS.items()) + """ ELSE 0.4 END::DOUBLE AS venue,
  CASE WHEN p_size > 25 THEN 1.0 WHEN p_size > 10 THEN 0.6 ELSE 0.0 END::DOUBLE AS peer, p_size, p_retailprice FROM part)
SELECT p_partkey, round((venue * 0.40 + peer * 0.20 + least(1.0, p_retailprice / 2000) * 0.15 + least(1.0, 0.6 + 0.2 * least(2, p_size % 3)) * 0.15 + 0.85 * 0.10)::DECIMAL(18,10), 4)::DOUBLE AS quality FROM w""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted quality with a look-up of weights."""
    weights = F.create_map(*[F.lit(x) for pair in _WEIGHTS.items() for x in pair])
    p = table(spark, sf_dir, "part")
    venue = F.coalesce(F.try_element_at(weights, F.col("p_brand")), F.lit(0.4))
    peer = F.when(F.col("p_size") > 25, 1.0).when(F.col("p_size") > 10, 0.6).otherwise(0.0)
    method = S.methodological_relevance(F.col("p_size") % 3, F.lit(False))
    quality = S.quality(venue, peer, F.least(F.lit(1.0), F.col("p_retailprice") / 2000), method, F.lit(0.85))
    return p.select("p_partkey", S.four(quality).alias("quality"))


@query("""WITH a AS (SELECT l_partkey, avg(l_discount) * 10 AS relevance, avg(l_tax) * 12 AS quality FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, round((0.7 * least(1.0, round(relevance, 6)) + 0.3 * least(1.0, round(quality, 6)))::DECIMAL(18,10), 4)::DOUBLE AS final_score FROM a""")
def final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final blend over aggregates."""
    a = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg((F.avg("l_discount") * 10).alias("relevance"), (F.avg("l_tax") * 12).alias("quality"))
    one = F.lit(1.0)
    return a.select("l_partkey", S.final_score(F.least(one, F.round("relevance", 6)), F.least(one, F.round("quality", 6))).alias("final_score"))


@query("""SELECT o_orderkey, CASE WHEN strftime(o_orderdate, '%Y-%m-%d') < '1995-01-01' THEN 'published ' || strftime(o_orderdate, '%Y-%m-%d') || ', before requested window (1995-01-01)'
  WHEN strftime(o_orderdate, '%Y-%m-%d') > '1996-12-31' THEN 'published ' || strftime(o_orderdate, '%Y-%m-%d') || ', after requested window (1996-12-31)' END AS reason FROM orders""")
def outside_window_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a row lies outside the requested window."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", outside_window(day, F.year("o_orderdate"), "1995-01-01", "1996-12-31").alias("reason"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def scan_pushdown_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan with its window and columns pushed into the reader."""
    at = F.col("o_orderdate")
    low, high = (F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz") for y in (1995, 1996))
    return table(spark, sf_dir, "orders").where((at >= low) & (at < high)).select("o_orderkey", "o_custkey")


@query("""SELECT year(o_orderdate)::INT AS year, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2)::DOUBLE AS total FROM orders
WHERE year(o_orderdate) IN (1994, 1996) AND o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1, 2""")
def partition_prune_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes kept by year: those asked for are the only ones listed and read, the priority is tested in the reader."""
    from scriptorium.session import scratch_path

    path = scratch_path(spark, "volumes")
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_orderpriority", "o_totalprice")
    o.repartition("year").write.partitionBy("year").parquet(path)
    volumes = spark.read.schema("o_orderpriority string, o_totalprice double, year int").parquet(path)
    chosen = volumes.where(F.col("year").isin(1994, 1996) & F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    return chosen.groupBy("year", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT sha256(text) AS text_key, string_agg(DISTINCT source, ';' ORDER BY source) AS sources, count(*) AS n FROM documents GROUP BY 1""")
def scan_union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans of several sources as one frame, with the sources that each text came from."""
    from scriptorium.sources.readers import union_sources

    d = table(spark, sf_dir, "documents").select("text", "source")
    halves = {"low": d.where("source < 'src2'"), "high": d.where("source >= 'src2'"), "none": d.where("source is null")}
    found, _ = union_sources(spark, {k: (lambda v=v: v) for k, v in halves.items()})
    return found.groupBy(F.sha2("text", 256).alias("text_key")).agg(F.array_join(F.array_sort(F.collect_set("source")), ";").alias("sources"), F.count("*").alias("n"))


@query("""SELECT page_id, length(t)::BIGINT AS n, sha256(t) AS digest FROM (SELECT page_id,
  trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM pages)""")
def strip_markup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable text of pages."""
    from scriptorium.functions.text import strip_scripts

    text = strip_markup(strip_scripts(F.col("html")), entities=False)
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).cast("long").alias("n"), F.sha2(text, 256).alias("digest"))


@query("""SELECT p_partkey, k AS title_key, left(replace(regexp_replace(k, '^(?:(?:a|an|the|towards?|on)\\s+)+', ''), ' ', ''), 6) AS bucket FROM (SELECT p_partkey,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[^\\w\\s]', ' ', 'g'), '\\b(preprint|extended abstract|extended version|full version|v\\d+)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS k FROM part)""")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title keys and buckets of ASCII names."""
    from scriptorium.functions.text import title_bucket

    p = table(spark, sf_dir, "part").select("p_partkey", normalize_title(F.col("p_name"), unicode=False).alias("title_key"))
    return p.withColumn("bucket", title_bucket(F.col("title_key")))


@query("""SELECT CASE WHEN a = 0 THEN NULL ELSE round(ar / a, 3) END::DOUBLE AS precision_auto_add, CASE WHEN r = 0 THEN NULL ELSE round(rk / r, 3) END::DOUBLE AS recall_review,
  CASE WHEN i = 0 THEN NULL ELSE round(ik / i, 3) END::DOUBLE AS false_positive_rate, n FROM (
  SELECT count(*) AS n, count(*) FILTER (WHERE d = 'accept') AS a, count(*) FILTER (WHERE d = 'accept' AND l = 'relevant') AS ar, count(*) FILTER (WHERE l = 'relevant') AS r,
  count(*) FILTER (WHERE l = 'relevant' AND d <> 'reject') AS rk, count(*) FILTER (WHERE l = 'irrelevant') AS i, count(*) FILTER (WHERE l = 'irrelevant' AND d <> 'reject') AS ik
  FROM (SELECT CASE WHEN quality = 1 THEN 'relevant' ELSE 'irrelevant' END AS l, CASE WHEN toxic = 1 THEN 'reject' WHEN n_chars > 2000 THEN 'accept' ELSE 'review' END AS d
    FROM labels JOIN documents USING (doc_id)))""")
def evaluate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and false positives of decisions against labels."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    label = F.when(F.col("quality") == 1, "relevant").otherwise("irrelevant")
    decision = F.when(F.col("toxic") == 1, "reject").when(F.col("n_chars") > 2000, "accept").otherwise("review")
    return report.metrics(j.select(label.alias("label"), decision.alias("decision")))


@query(f"""WITH m AS (SELECT doc_id, least(CASE WHEN {_strong_sql("title")} THEN 1.0 ELSE 0.6 END, {_total_sql("title")}) AS t,
  least(CASE WHEN {_strong_sql("text")} THEN 1.0 ELSE 0.6 END, {_total_sql("text")} / 2) AS a, least(1.0, {_COUNT_SQL} / 5.0) AS o
  FROM (SELECT doc_id, text, split_part(text, chr(10), 1) AS title FROM documents))
SELECT doc_id, round(least(1.0, greatest(t * 0.85 + a * 0.15, a * 0.7 + o * 0.1)), 4)::DOUBLE AS score FROM m""")
def dictionary_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of a weighted dictionary over all documents."""
    from scriptorium.operators import classify

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", classify.dictionary_score(_title(F.col("text")), F.col("text"), _TERMS).alias("score"))
