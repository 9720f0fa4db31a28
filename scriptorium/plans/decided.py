"""Queries that classify, score and decide with the library's own operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import scores as S
from scriptorium.operators import baselines, classify, decide, report, topk
from scriptorium.operators.records import peer_reviewed
from scriptorium.plans.registry import query
from scriptorium.schema import PAPER, Request, Settings, conform
from scriptorium.session import spread, table

_LISTS = "array<string>"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _named(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast(_LISTS)


def _joined(name: str) -> Column:
    return F.array_join(name, ";").alias(name)


#: Records that tell one rule each: title, abstract, publication type; modalities, topics, subtopics, why they are out.
_CASES = (
    ("Calibration of chest X-ray readers", "Temperature scaling on chest radiographs.", "", "cxr", "calibration;uncertainty", "uncertainty:calibration", None),
    ("A foundation model for mammography", "Pretraining on mammograms.", "", "mammo", "foundation-model", "", None),
    ("Whole-slide images in a foundation model", "Histopathology only.", "", "", "foundation-model", "", "non-radiology imaging modality"),
    ("Weaving of long carpets", "Wool and looms.", "", "", "", "", "not related to radiology / medical imaging"),
    ("Erratum: chest CT", "", "", "ct", "", "", "excluded publication type (title pattern)"),
    ("Chest CT notes", "", "editorial", "ct", "", "", "excluded publication type (editorial)"),
    ("A survey of conformal prediction for chest CT", "", "", "ct", "conformal-prediction;uncertainty", "uncertainty:conformal-prediction;type:survey", None),
    ("SAM in radiology reports", "Small attention modules.", "", "radiology-general", "", "", None),
    ("SAM in radiology reports", "They segment ribs.", "", "radiology-general", "foundation-model", "", None),
    ("", "chest x-rays", "", "", "", "", "missing title"),
)


@query("SELECT p_partkey, modalities, topics, subtopics, why FROM part JOIN (VALUES " + ", ".join(f"({i}, '{m}', '{t}', '{s}', {'NULL' if w is None else repr(w)})" for i, (*_, m, t, s, w) in enumerate(_CASES)) + f") v(i, modalities, topics, subtopics, why) ON p_partkey % {len(_CASES)} = i")
def classified_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modalities, topics and taxonomy tags of records, and why a record is out before any score."""
    cases = spark.createDataFrame([(i, t, a, k) for i, (t, a, k, *_) in enumerate(_CASES)], "i int, title string, abstract string, publication_type string")
    p = spread(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", (F.col("p_partkey") % len(_CASES)).cast("int").alias("i")).join(F.broadcast(cases), "i")
    df = classify.classify(p)
    return df.select("p_partkey", _joined("modalities"), F.array_join(F.array_sort("topics"), ";").alias("topics"), _joined("subtopics"), classify.hard_filter(df).alias("why"))


@query("""SELECT p_partkey, p_partkey % 2 = 0 AS has_term, p_partkey % 2 = 0 AND p_partkey % 3 = 0 AS counted FROM part""")
def context_gated_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ambiguous acronym counts only where its context occurs."""
    k = F.col("p_partkey")
    title = F.when(k % 2 == 0, "CLIP on shelves").otherwise("Shelves")
    abstract = F.when(k % 3 == 0, "a contrastive loss").otherwise("a metal clamp")
    df = table(spark, sf_dir, "part").select(k, classify.measured(title, abstract).alias("m"), title.alias("t"))
    return df.select("p_partkey", F.col("t").contains("CLIP").alias("has_term"), (F.col("m.title")["topic:vlm"] > 0).alias("counted"))


@query("""SELECT p_partkey, p_partkey % 5 = 0 OR p_size = 7 AS excluded, CASE p_partkey % 5 WHEN 1 THEN 'type:survey' WHEN 2 THEN 'type:benchmark-dataset' WHEN 3 THEN 'type:meeting-abstract' ELSE '' END AS tags FROM part""")
def type_exclusion_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of records that are no papers, and kinds told by titles."""
    k = F.col("p_partkey")
    heads = F.when(k % 5 == 0, "Author Correction: ").when(k % 5 == 1, "A systematic review of ").when(k % 5 == 2, "The challenge of ").when(k % 5 == 3, "Poster 12: ").otherwise("On ")
    title, kind = F.concat(heads, "p_name"), F.when(F.col("p_size") == 7, "retracted publication").otherwise("journal article")
    return table(spark, sf_dir, "part").select("p_partkey", classify.excluded_type(title, kind).alias("excluded"), F.array_join(classify.type_tags(title, kind), ";").alias("tags"))


@query("""SELECT doc_id, regexp_matches(split_part(text, chr(10), 1) || CASE WHEN doc_id % 4 = 0 THEN ' and a mammogram' ELSE '' END, '(?i)(^|[^a-z])mammogram') AS looks FROM documents""")
def radiology_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any term of a modality occurs, as one alternation."""
    head = F.concat(F.substring_index("text", "\n", 1), F.when(F.col("doc_id") % 4 == 0, " and a mammogram").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", classify.looks_radiological(head, F.lit("")).alias("looks"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'missing title' WHEN o_orderstatus = 'P' THEN 'excluded publication type (news)' WHEN o_orderpriority = '5-LOW' THEN 'non-radiology imaging modality'
WHEN o_totalprice < 60000 THEN 'not related to radiology / medical imaging' WHEN o_orderkey % 3 = 0 THEN 'no CXR / CT / mammography / general-radiology relevance' END AS reason FROM orders
WHERE o_orderkey % 50 = 0 OR o_orderstatus = 'P' OR o_orderpriority = '5-LOW' OR o_totalprice < 60000 OR o_orderkey % 3 = 0""")
def hard_filter_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason that rules a classified record out."""
    k = F.col("o_orderkey")
    scores = F.struct((F.col("o_orderstatus") == "P").alias("excluded_type"), (F.col("o_orderpriority") == "5-LOW").alias("is_other_modality"), (F.col("o_totalprice") / 200000).alias("radiology_relevance"))
    df = table(spark, sf_dir, "orders").select(k, F.when(k % 50 == 0, "").otherwise("t").alias("title"), F.lit("news").alias("publication_type"), scores.alias("scores"), F.when(k % 3 == 0, _named()).otherwise(_named("ct")).alias("modalities"))
    return df.select("o_orderkey", classify.hard_filter(df).alias("reason")).where("reason is not null")


def _scores(x: Column, y: Column) -> Column:
    """Scores of a classified record made of two numbers from 0 to 1."""
    zero = F.lit(0.0)
    topics = F.create_map(F.lit("calibration"), y, F.lit("hallucination"), zero)
    fields = {
        "foundation_model_relevance": x, "vlm_relevance": y, "uncertainty_relevance": zero, "robustness_relevance": zero, "radiology_relevance": x, "cxr_relevance": x, "ct_relevance": y,
        "mammo_relevance": zero, "general_radiology_relevance": zero, "secondary_radiology_relevance": zero, "topic_scores": topics, "excluded_type": F.lit(False), "is_other_modality": F.lit(False),
    }
    return F.struct(*[v.alias(n) for n, v in fields.items()])


_X, _Y = "round(p_size / 50.0, 4)", "round(p_partkey % 97 / 97.0, 4)"


@query(f"""SELECT p_partkey, round(least(1.0, greatest(x, y) + CASE WHEN x >= 0.45 AND y >= 0.45 THEN 0.05 ELSE 0 END)::DECIMAL(18,8), 4)::DOUBLE AS main, round((0.6 * least(x, y) + 0.2 * (x + y))::DECIMAL(18,8), 4)::DOUBLE AS both, round(greatest(0.2, x, y)::DECIMAL(18,8), 4)::DOUBLE AS any_modality,
round(y::DECIMAL(18,8), 4)::DOUBLE AS ct FROM (SELECT p_partkey, {_X} AS x, {_Y} AS y FROM part)""")
def topic_and_modality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main theme, the fit to requested topics, and the fit to modalities."""
    p = table(spark, sf_dir, "part").select("p_partkey", _scores(F.round(F.col("p_size") / 50.0, 4), F.round((F.col("p_partkey") % 97) / 97.0, 4)).alias("scores"))
    s = F.col("scores")
    both = decide.requested_topic(s, ("foundation-model", "vlm"))
    return p.select("p_partkey", classify.main_topic(s).alias("main"), both.alias("both"), classify.modality_match(s).alias("any_modality"), classify.modality_match(s, ("ct",)).alias("ct"))


@query(f"""SELECT p_partkey, CASE WHEN y < 0.45 THEN 'does not match requested modality ct' WHEN x < 0.45 THEN 'does not match requested topic foundation-model' WHEN p_partkey % 3 = 0 THEN 'not from requested venue tmi' END AS reason
FROM (SELECT p_partkey, {_X} AS x, {_Y} AS y FROM part)""")
def request_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a request's own conditions a record fails."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "radiology").otherwise("tmi").alias("venue_key"), _scores(F.round(F.col("p_size") / 50.0, 4), F.round((F.col("p_partkey") % 97) / 97.0, 4)).alias("scores"))
    request = Request(topics=("foundation-model",), modalities=("ct",), venues=("tmi",))
    return p.select("p_partkey", decide.request_mismatch(request, Settings(profile="radiology")).alias("reason"))


@query("""SELECT l_partkey, round((0.85 * (1 + (n > 20)::INT + (s > 5)::INT + (q > 30)::INT + 1) / 5.0 + 0.15 * least(1.0, (r - 1) / 2.0))::DECIMAL(18,8), 4)::DOUBLE AS confidence, round((0.35 * d + 0.25 * t + 0.20 * 0.5 + 0.10 * 1 + 0.10 * d)::DECIMAL(18,8), 4)::DOUBLE AS relevance
FROM (SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS s, max(l_quantity) AS q, count(DISTINCT l_returnflag) AS r, round(avg(l_discount) * 10, 4) AS d, round(avg(l_tax) * 10, 4) AS t FROM lineitem GROUP BY 1)""")
def metadata_and_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How complete a record's metadata is, and its relevance to a fixed ontology."""
    a = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("s"), F.max("l_quantity").alias("q"), F.count_distinct("l_returnflag").alias("r"), F.round(F.avg("l_discount") * 10, 4).alias("d"), F.round(F.avg("l_tax") * 10, 4).alias("t"))
    sure = S.metadata_confidence([F.lit(True), F.col("n") > 20, F.col("s") > 5, F.col("q") > 30, F.lit(True)], F.col("r"))
    relevance = S.topical_relevance(F.col("d"), F.col("t"), F.lit(0.5), F.lit(1.0), F.col("d"))
    return a.select("l_partkey", sure.alias("confidence"), S.four(relevance).alias("relevance"))


_GENERAL_SQL = """CASE WHEN o_orderkey % 40 = 0 THEN 'reject' WHEN o_orderstatus = 'P' THEN 'reject' WHEN o_orderkey % 9 = 0 THEN 'reject' WHEN f >= 0.82 AND o_orderkey % 2 = 0 AND o_orderkey % 7 <> 0 THEN 'accept' WHEN f >= 0.82 THEN 'review' WHEN f >= 0.68 THEN 'review' ELSE 'reject' END AS decision,
CASE WHEN o_orderkey % 40 = 0 THEN 'missing title' WHEN o_orderstatus = 'P' THEN 'excluded publication type (news)' WHEN o_orderkey % 9 = 0 THEN 'does not mention: loom' WHEN f >= 0.82 THEN concat_ws('; ', CASE WHEN o_orderkey % 2 = 1 THEN 'venue not in high-priority list' END,
CASE WHEN o_orderkey % 2 = 1 THEN 'not peer reviewed' END, CASE WHEN o_orderkey % 7 = 0 THEN 'meeting abstract' END) WHEN f >= 0.68 THEN '' ELSE 'score ' || printf('%.2f', f) || ' below review threshold 0.68' END AS reject_reason"""
_ORDERS_SQL = "(SELECT *, round(least(1.0, o_totalprice / 350000.0), 1)::DOUBLE AS f FROM orders)"


def _decided(spark: SparkSession, sf_dir: str, request: Request, settings: Settings) -> DataFrame:
    k, good = F.col("o_orderkey"), F.col("o_orderkey") % 2 == 0
    x = F.round(F.least(F.lit(1.0), F.col("o_totalprice") / 350000.0), 1)
    zero = F.lit(0.0)
    df = table(spark, sf_dir, "orders").select(
        k, F.when(k % 40 == 0, "").otherwise("t").alias("title"), F.lit("news").alias("publication_type"), x.alias("final_score"), F.lit(0.5).alias("quality_score"),
        F.when(good, "tmi").otherwise("arxiv").alias("venue_key"), F.when(good, "journal").otherwise("preprint").alias("venue_type"),
        F.when(k % 7 == 0, _named("type:meeting-abstract")).otherwise(_named()).alias("subtopics"), F.when(k % 11 == 0, _named("radiology-general")).otherwise(_named("ct")).alias("modalities"),
        F.array(F.when(k % 9 == 0, 0.0).otherwise(1.0), F.lit(0.6)).alias("query_hits"), F.lit(None).cast("string").alias("author_watch"),
        _scores(F.when(k % 9 == 0, zero).otherwise(0.5), zero).withField("excluded_type", F.col("o_orderstatus") == "P").withField("radiology_relevance", F.lit(0.9)).alias("scores"),
        F.struct(F.when(k % 4 == 0, "likely baseline").when(k % 4 == 1, "possible baseline").when(k % 4 == 2, "background reference").alias("label"), F.lit(0.9).alias("score")).alias("graph_evidence"),
    )
    return decide.decide(df, settings, request)


@query(f"SELECT o_orderkey, {_GENERAL_SQL} FROM {_ORDERS_SQL}")
def decision_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general ladder: what a record lacks, its score, and what keeps a high one from being accepted."""
    return _decided(spark, sf_dir, Request(free_text="loom weaving"), Settings()).select("o_orderkey", "decision", "reject_reason")


@query("""SELECT o_orderkey, CASE WHEN why <> '' THEN 'reject' WHEN f >= 0.82 AND blockers = '' THEN 'accept' WHEN f >= 0.68 THEN 'review' ELSE 'reject' END AS decision,
CASE WHEN why <> '' THEN why WHEN f >= 0.82 THEN blockers WHEN f >= 0.68 THEN '' ELSE 'score ' || printf('%.2f', f) || ' below review threshold 0.68' END AS reject_reason FROM (SELECT *,
CASE WHEN o_orderkey % 40 = 0 THEN 'missing title' WHEN o_orderstatus = 'P' THEN 'excluded publication type (news)' WHEN o_orderkey % 9 = 0 THEN 'no foundation-model / VLM / uncertainty / robustness signal' ELSE '' END AS why,
concat_ws('; ', CASE WHEN o_orderkey % 2 = 1 THEN 'venue not in high-priority list' END, CASE WHEN o_orderkey % 2 = 1 THEN 'not peer reviewed' END, CASE WHEN o_orderkey % 7 = 0 THEN 'meeting abstract' END,
CASE WHEN o_orderkey % 11 = 0 THEN 'weak modality evidence' END) AS blockers FROM """ + _ORDERS_SQL + ")")  # fmt: skip
def decision_ladder_of_the_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder of the fixed ontology: hard reasons, a main theme, the score, and what keeps a high one from being accepted."""
    return _decided(spark, sf_dir, Request(intent="scan", strict_request_match=False), Settings(profile="radiology")).select("o_orderkey", "decision", "reject_reason")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'reject' WHEN o_orderkey % 4 = 0 THEN 'accept' WHEN o_orderkey % 4 = 1 THEN 'review' ELSE 'reject' END AS decision,
CASE WHEN o_orderstatus = 'P' THEN 'excluded publication type' WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN 'possible baseline - check the evidence' WHEN o_orderkey % 4 = 2 THEN 'not a baseline (background reference)' ELSE 'not a baseline (no evidence)' END AS reject_reason,
CASE WHEN o_orderkey % 4 = 3 THEN f ELSE greatest(f, 0.9) END AS final_score FROM """ + _ORDERS_SQL)  # fmt: skip
def decision_ladder_of_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by their role: likely baselines are accepted, possible ones reviewed, and scores are raised to the evidence's."""
    return _decided(spark, sf_dir, Request(intent="baselines"), Settings()).select("o_orderkey", "decision", "reject_reason", "final_score")


def _simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decided records: by price."""
    price, k = F.col("o_totalprice"), F.col("o_orderkey")
    decision = F.when(price >= 300000, "accept").when(price >= 100000, "review").otherwise("reject")
    reason = F.when(price >= 300000, "").when(price >= 200000, "late").when(price >= 100000, "").otherwise("cheap")
    return table(spark, sf_dir, "orders").select(k, price, decision.alias("decision"), reason.alias("reject_reason"), F.when(k % 2 == 0, _named("vlm")).otherwise(_named()).alias("topics"), F.when(k % 3 == 0, _named("ct")).otherwise(_named()).alias("modalities"))


_SIMPLE_SQL = "(SELECT o_orderkey, o_totalprice AS p, CASE WHEN o_totalprice >= 300000 THEN 'accept' WHEN o_totalprice >= 100000 THEN 'review' ELSE 'reject' END AS d, CASE WHEN o_totalprice >= 300000 THEN '' WHEN o_totalprice >= 200000 THEN 'late' WHEN o_totalprice >= 100000 THEN '' ELSE 'cheap' END AS r FROM orders)"


@query(f"""SELECT o_orderkey, CASE WHEN d <> 'accept' AND o_orderkey % 6 = 0 THEN 'accept' WHEN d = 'reject' THEN 'review' ELSE d END AS decision,
CASE WHEN d = 'reject' THEN 'manually requested (would be rejected: cheap)' WHEN d = 'review' AND r = '' THEN 'manual add below auto-add threshold' ELSE r END AS reject_reason FROM {_SIMPLE_SQL}""")
def manual_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user asked for by identifier is never rejected."""
    return decide.manual_add(_simple(spark, sf_dir)).select("o_orderkey", "decision", "reject_reason")


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND d = 'accept' THEN 'review' WHEN o_orderkey % 5 = 0 AND d = 'review' THEN 'reject' ELSE d END AS decision,
CASE WHEN o_orderkey % 5 = 0 AND d <> 'reject' THEN 'adjudicated: off topic' ELSE r END AS reject_reason FROM {_SIMPLE_SQL}""")
def adjudicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on records can only demote them."""
    k = F.col("o_orderkey")
    verdicts = table(spark, sf_dir, "orders").where("o_orderkey % 5 < 2").select(k, F.when(k % 5 == 0, "irrelevant").otherwise("relevant").alias("verdict"), F.lit("off topic").alias("reason"))
    return decide.adjudicate(_simple(spark, sf_dir), verdicts, "o_orderkey").select("o_orderkey", "decision", "reject_reason")


@query(f"SELECT o_orderkey, p AS o_totalprice FROM {_SIMPLE_SQL} WHERE d = 'review'")
def rows_by_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one decision, best first."""
    return report.by_decision(_simple(spark, sf_dir), "review", "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("""SELECT p_partkey, concat_ws('; ', CASE WHEN p_partkey % 3 = 0 THEN 'CT + VLM' WHEN p_partkey % 3 = 1 THEN 'CXR + foundation model + OOD' ELSE 'keyword match' END, CASE WHEN p_size = 1 THEN 'author watch: Ada' END, CASE WHEN p_size > 40 THEN 'related' END) AS why FROM part""")
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What records were found for, in words."""
    k = F.col("p_partkey")
    df = table(spark, sf_dir, "part").select(
        k, F.when(k % 3 == 0, _named("ct")).when(k % 3 == 1, _named("cxr")).otherwise(_named()).alias("modalities"), F.when(k % 3 == 0, _named("vlm")).when(k % 3 == 1, _named("foundation-model", "ood")).otherwise(_named()).alias("topics"),
        F.when(F.col("p_size") == 1, "Ada").alias("author_watch"), F.when(F.col("p_size") > 40, "related").alias("relationship"),
    )
    return df.select("p_partkey", decide.explain(df).alias("why"))


_EVIDENCE_SQL = "least(1.0, greatest(0.0, 0.45 * strong + 0.20 * medium + 0.25 * influential + 0.20 * result + 0.05 * recent))"


@query(f"""SELECT conv_id, round({_EVIDENCE_SQL}::DECIMAL(18,8), 3)::DOUBLE AS score, CASE WHEN conv_id % 10 = 0 THEN 'benchmark/dataset' WHEN round({_EVIDENCE_SQL}::DECIMAL(18,8), 3) >= 0.55 THEN 'likely baseline' WHEN round({_EVIDENCE_SQL}::DECIMAL(18,8), 3) >= 0.30 THEN 'possible baseline' ELSE 'background reference' END AS label
FROM (SELECT conv_id, (max(turn) >= 3)::INT AS strong, (count(*) FILTER (WHERE role = 'user') > 0)::INT AS medium, (conv_id % 2 = 0)::INT AS influential, (conv_id % 3 = 0)::INT AS result, (conv_id % 7 <= 4)::INT AS recent FROM conversations GROUP BY conv_id)""")
def role_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as references: evidence of citation contexts, intents and age, and the role that it tells."""
    k = F.col("conv_id")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"), F.count_if(F.col("role") == "user").alias("asked"))
    contexts = F.array_compact(F.array(F.when(F.col("last") >= 3, "we outperform it"), F.when(F.col("asked") > 0, "see the figure"), F.lit("as they say")))
    none = "struct<experiments:bigint,tables:bigint,baseline_section:bigint,dataset_section:bigint,snippets:array<string>>"
    refs = c.select(
        k, F.when(k % 10 == 0, "A dataset of looms").otherwise("Looms").alias("title"), (2020 - k % 7).cast("int").alias("year"), _named().alias("topics"), contexts.alias("contexts"), F.when(k % 3 == 0, _named("result")).otherwise(_named()).alias("intents"),
        (k % 2 == 0).alias("influential"), F.lit(None).cast(none).alias("signals"),
    )
    found = baselines.score_references(refs, 2020)
    return found.select("conv_id", F.col("graph_evidence.score").alias("score"), F.col("graph_evidence.label").alias("label"))


@query("""SELECT label, count(*) AS n FROM (SELECT conv_id, CASE WHEN conv_id % 10 = 0 THEN 'benchmark/dataset' ELSE 'background reference' END AS label FROM conversations GROUP BY conv_id) GROUP BY 1""")
def references_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References counted by role."""
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return report.label_counts(c.select(F.when(F.col("conv_id") % 10 == 0, "benchmark/dataset").otherwise("background reference").alias("label")))


@query("""SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS strong, count(*) FILTER (WHERE role = 'assistant') AS medium, count(*) FILTER (WHERE role = 'system') AS table_rows, count(*) FILTER (WHERE role NOT IN ('user', 'assistant', 'system')) = count(*) AS background_only FROM conversations GROUP BY 1""")
def marker_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation contexts by kind: comparisons, results, rows of tables, long background lists."""
    said = F.when(F.col("role") == "user", "better than theirs").when(F.col("role") == "assistant", "we evaluated").when(F.col("role") == "system", "A et al 1 B et al 2").otherwise("A; B; C; D; E")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(said).alias("c"))
    f = baselines.context_features(F.col("c"))
    return c.select("conv_id", *[F.size(f[n]).cast("long").alias(n) for n in ("strong", "medium", "table_rows")], f["background_only"].alias("background_only"))


@query("SELECT event_type AS task, count(*) AS calls, sum(event_id % 100)::BIGINT AS input_tokens, sum(event_id % 7)::BIGINT AS output_tokens FROM events GROUP BY 1")
def model_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and tokens by task."""
    return report.usage(table(spark, sf_dir, "events").select(F.col("event_type").alias("task"), (F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens")))


@query("""SELECT conv_id, string_agg(role, ';' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1""")
def first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of a list in order of first occurrence."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    return c.select("conv_id", F.array_join(topk.first_occurrences(F.transform("turns", lambda t: t["role"])), ";").alias("roles"))


@query("""SELECT p_partkey, round((0.45 * cover + 0.25 * (cover = 1)::INT + 0.10 * title + 0.10 * 0 + 0.10 * 1.0)::DECIMAL(18,8), 4)::DOUBLE AS relevance_score, round((0.4 * venue + 0.2 * peer + 0.15 * 0.375 + 0.15 * 0.6 + 0.1 * 0.85)::DECIMAL(18,8), 4)::DOUBLE AS quality_score
FROM (SELECT p_partkey, ((p_partkey % 2 = 0)::INT * 1.0 + (p_partkey % 3 = 0)::INT * 0.6) / 2 AS cover0, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 0.8 WHEN p_partkey % 2 = 0 THEN 0.5 WHEN p_partkey % 3 = 0 THEN 0.3 ELSE 0.0 END AS cover,
(p_partkey % 2 = 0)::INT / 2.0 AS title, CASE WHEN p_partkey % 5 = 0 THEN 1.0 ELSE 0.4 END AS venue, CASE WHEN p_partkey % 5 = 0 THEN 1.0 ELSE 0.0 END AS peer FROM part) WHERE NOT (p_partkey % 2 = 0 AND p_partkey % 3 = 0)""")
def scored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance to a query's terms and quality, from classified records."""
    from datetime import date

    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").where("not (p_partkey % 2 = 0 and p_partkey % 3 = 0)")
    raw = p.select(
        F.concat(F.when(k % 2 == 0, "looms").otherwise("wool"), F.lit(" here")).alias("title"), F.when(k % 3 == 0, "of carpets").otherwise("of towns").alias("abstract"), k.cast("string").alias("issue"), F.lit("2020-05-01").alias("publication_date"),
        F.when(k % 5 == 0, "tmi").otherwise("arxiv").alias("venue_key"), F.when(k % 5 == 0, "journal").otherwise("preprint").alias("venue_type"), F.lit("10.1/x").alias("doi"), _named("A B").alias("authors"), _named("one").alias("sources"),
    )
    settings = Settings(normalize_citation_age=True)
    scored = decide.score(classify.classify(conform(raw, PAPER)), settings, Request(free_text="looms carpets"), date(2020, 5, 1))
    return scored.select(F.col("issue").cast("long").alias("p_partkey"), "relevance_score", "quality_score")


@query("SELECT p_partkey, p_size % 2 = 0 AS reviewed FROM part")
def peer_reviewed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venue types whose papers are peer reviewed."""
    return table(spark, sf_dir, "part").select("p_partkey", peer_reviewed(F.when(F.col("p_size") % 2 == 0, "journal").when(F.col("p_size") % 3 == 0, "preprint")).alias("reviewed"))
