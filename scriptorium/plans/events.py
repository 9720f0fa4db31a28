"""Queries on incremental runs, streams, sections, citations and roles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.dates import next_run, normalize_date, parse_date, parse_interval, window_start
from scriptorium.functions.text import clip, seen_key, slug
from scriptorium.operators import incremental
from scriptorium.operators.baselines import combine_roles
from scriptorium.plans.registry import query
from scriptorium.session import table
from scriptorium.streaming import flows


@query("""SELECT event_id FROM events WHERE left(sha1(event_id::VARCHAR), 16) NOT IN (SELECT left(sha1(event_id::VARCHAR), 16) FROM events WHERE ts < TIMESTAMP '2024-01-20')
AND ts >= TIMESTAMP '2024-01-10'""")
def seen_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a replayed window that no earlier window had."""
    e = table(spark, sf_dir, "events").withColumn("seen_keys", F.array(seen_key(F.col("event_id").cast("string"))))
    at = lambda d: F.lit(f"2024-01-{d} 00:00:00").cast("timestamp_ntz")
    seen = e.where(F.col("ts") < at(20)).select(F.explode("seen_keys").alias("seen_key"))
    return incremental.unseen(e.where(F.col("ts") >= at(10)), seen, "event_id").select("event_id")


@query("SELECT event_id, ts FROM events")
def incremental_overlap_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two windows that overlap, the second without what the first had: together, all rows once."""
    e = table(spark, sf_dir, "events").withColumn("seen_keys", F.array(seen_key(F.col("event_id").cast("string"))))
    cut = lambda d: F.lit(f"2024-01-{d} 00:00:00").cast("timestamp_ntz")
    first = e.where(F.col("ts") < cut(18))
    seen = incremental.remember(first.select(F.explode("seen_keys").alias("seen_key")).limit(0), first.select(F.explode("seen_keys").alias("seen_key")))
    second = incremental.unseen(e.where(F.col("ts") >= cut(12)), seen, "event_id")
    return first.unionByName(second).select("event_id", "ts")


@query("""WITH a AS (SELECT c_custkey, c_mktsegment, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 7 <> 0 OR o_orderkey IS NOT NULL GROUP BY 1, 2)
SELECT c_custkey FROM a WHERE c_mktsegment <> 'MACHINERY' AND (last IS NULL OR last + INTERVAL 30 DAY <= TIMESTAMP '1998-07-15')""")
def alerts_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, as saved searches, that are active and due."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    a = c.where((F.col("c_custkey") % 7 != 0) | F.col("o_orderkey").isNotNull()).groupBy("c_custkey", "c_mktsegment").agg(F.max("o_orderdate").alias("last"))
    status = F.when(F.col("c_mktsegment") == "MACHINERY", "paused").otherwise("active")
    now = F.lit("1998-07-15 00:00:00").cast("timestamp_ntz")
    return a.where(incremental.is_due(status, F.col("last") + F.expr("INTERVAL 30 DAYS"), now)).select("c_custkey")


@query("""SELECT o_orderkey, strftime(CASE WHEN o_orderstatus = 'P' THEN o_orderdate::DATE + 1 ELSE o_orderdate::DATE + (7 + o_orderkey % 30)::INT END, '%Y-%m-%d') AS next_run FROM orders""")
def next_run_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next slot after a run, sooner after an error."""
    status = F.when(F.col("o_orderstatus") == "P", "error").otherwise("ok")
    slot = next_run(status, F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 30 + 7).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(slot, "yyyy-MM-dd").alias("next_run"))


@query("""SELECT o_orderkey, strftime(greatest(since, CASE WHEN last IS NULL THEN since ELSE least(last - 10, now - 20) END), '%Y-%m-%d') AS window_start FROM (
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate::DATE END AS last, (o_orderdate::DATE + 9) AS now, (o_orderdate::DATE - (o_orderkey % 40)::INT) AS since FROM orders)""")
def window_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where incremental windows begin: overlap, least look-back, never before a first day."""
    day = F.col("o_orderdate").cast("date")
    last = F.when(F.col("o_orderkey") % 3 != 0, day)
    start = window_start(last, F.date_sub(day, (F.col("o_orderkey") % 40).cast("int")), F.date_add(day, 9))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(start, "yyyy-MM-dd").alias("window_start"))


@query("""SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY 1, 2""")
def stream_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day and type; the same plan runs on a stream."""
    return flows.tumbling(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, parted by two quiet hours; the same plan runs on a stream."""
    found = flows.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "2 hours")
    return found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT event_id, user_id FROM events")
def stream_dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over events, twice in the input, each kept once within the watermark."""
    return flows.replay_once(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id")


@query("""SELECT doc_id, count(*) AS n, min(item_id) AS first_item FROM documents, benchmark WHERE contains(trim(regexp_replace(lower(documents.text), '[^a-z0-9]+', ' ', 'g')),
left(trim(regexp_replace(lower(benchmark.text), '[^a-z0-9]+', ' ', 'g')), 120)) GROUP BY doc_id""")
def quote_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages, as quotes, that stand in documents: found by a word, then compared whole."""
    from scriptorium.functions.text import match_text

    d = table(spark, sf_dir, "documents").select("doc_id", match_text(F.col("text")).alias("t"))
    quote = F.substring(match_text(F.col("text")), 1, 120)
    b = table(spark, sf_dir, "benchmark").select("item_id", quote.alias("q"))
    # inner words of a quote stand whole in any text that holds it: texts meet quotes by the longest of these
    inner = F.slice(F.split("q", " "), F.lit(2), F.greatest(F.lit(1), F.size(F.split("q", " ")) - 2))
    keyed = b.select("item_id", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("word"))
    words = d.select("doc_id", F.explode(F.array_distinct(F.split("t", " "))).alias("word"))
    pairs = words.join(keyed, "word").select("doc_id", "item_id").distinct()  # words meet without their texts
    met = pairs.join(d, "doc_id").join(b, "item_id").where(F.col("t").contains(F.col("q")))
    return met.groupBy("doc_id").agg(F.count_distinct("item_id").alias("n"), F.min("item_id").alias("first_item"))


@query("""SELECT c_custkey AS id, CASE WHEN failed THEN 'error' WHEN retrieved = 0 AND errors > 0 THEN 'error' WHEN action = 'report_only' THEN 'report-only' WHEN dry THEN 'dry-run' ELSE 'ok' END AS last_status,
strftime(CASE WHEN failed THEN TIMESTAMP '2024-06-02 07:30:00' ELSE TIMESTAMP '2024-06-01 07:30:00' + to_days(7 + (c_custkey % 20)::INT) END, '%Y-%m-%d %H:%M:%S') AS next_run_at,
NOT failed AND NOT (retrieved = 0 AND errors > 0) AND action <> 'report_only' AND NOT dry AS covered FROM (SELECT c_custkey, c_custkey % 11 = 0 AS failed, c_custkey % 4 AS retrieved, c_custkey % 2 AS errors,
c_custkey % 5 = 0 AS dry, CASE WHEN c_mktsegment = 'BUILDING' THEN 'report_only' ELSE 'add_by_threshold' END AS action FROM customer)""")
def alert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of saved searches after a scheduled run."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    none = lambda n: F.lit(None).cast("timestamp_ntz").alias(n)
    a = c.select(k.alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "report_only").otherwise("add_by_threshold").alias("action"), (k % 20 + 7).cast("int").alias("interval_days"), F.lit(None).cast("string").alias("last_status"), *map(none, ("last_run_at", "last_success_at", "last_dry_run_at", "next_run_at")))
    o = c.select(k.alias("id"), (k % 11 == 0).alias("failed"), (k % 4).alias("retrieved"), (k % 2).alias("errors"), (k % 5 == 0).alias("dry_run"))
    new = incremental.after_run(a, o, datetime(2024, 6, 1, 7, 30), scheduled=True)
    return new.select("id", "last_status", F.date_format("next_run_at", "yyyy-MM-dd HH:mm:ss").alias("next_run_at"), F.col("last_success_at").isNotNull().alias("covered"))


_INTERVALS = (("30", 30), ("2w", 14), ("1m", 30), ("every 2 weeks", 14), ("monthly", 30), ("Weekly", 7), ("quarterly", 91), ("a week", 7), ("six months", 180), ("400", None), ("soon", None), ("0d", None))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 20 < 12 THEN days ELSE (1 + o_orderkey % 17) * 7 END::INT AS days FROM orders LEFT JOIN (VALUES {", ".join(f"({i}, {'NULL' if d is None else d})" for i, (_, d) in enumerate(_INTERVALS))}) v(i, days) ON i = o_orderkey % 20""")
def interval_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of written intervals, one for each order."""
    k = F.col("o_orderkey")
    said = F.concat(F.lit("every "), (1 + k % 17).cast("string"), F.lit(" weeks"))
    for i, (text, _) in enumerate(_INTERVALS):
        said = F.when(k % 20 == i, text).otherwise(said)
    return table(spark, sf_dir, "orders").select("o_orderkey", parse_interval(said).alias("days"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-01-01') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01') WHEN 2 THEN strftime(CASE WHEN strftime(o_orderdate, '%m-%d') = '02-29' THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate END, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y-12-01') END AS held,
CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-01-01') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS exact FROM orders""")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial dates, held within bounds or refused."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    said = F.when(k % 5 == 0, F.date_format(day, "yyyy")).when(k % 5 == 1, F.date_format(day, "yyyy-MM")).when(k % 5 == 2, F.date_format(day, "yyyy-MM-dd")).when(k % 5 == 3, F.concat(F.date_format(day, "yyyy"), F.lit("-13-00"))).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(parse_date(said), "yyyy-MM-dd").alias("held"), normalize_date(said).alias("exact"))


_COMBINED_SQL = """SELECT key, CASE WHEN role = 'baseline' AND label = 'benchmark/dataset' THEN 'possible baseline' WHEN role = 'baseline' THEN 'likely baseline' WHEN role = 'dataset' THEN 'benchmark/dataset'
WHEN role = 'backbone' AND label = 'likely baseline' AND score >= 0.75 THEN 'possible baseline' WHEN role = 'backbone' THEN 'backbone/tool' WHEN role = 'background' AND label = 'likely baseline' THEN 'possible baseline'
WHEN role = 'background' THEN 'background reference' WHEN was_read AND label = 'likely baseline' THEN 'possible baseline' ELSE label END AS result, CASE WHEN role = 'baseline' AND label <> 'benchmark/dataset' THEN greatest(score, 0.8) ELSE score END AS new_score"""


@query(f"""{_COMBINED_SQL} FROM (SELECT l_orderkey * 10 + l_linenumber AS key, round(l_discount * 10, 2)::DOUBLE AS score, CASE l_linenumber % 3 WHEN 0 THEN 'benchmark/dataset' WHEN 1 THEN 'likely baseline' ELSE 'background reference' END AS label,
CASE l_partkey % 5 WHEN 0 THEN 'baseline' WHEN 1 THEN 'dataset' WHEN 2 THEN 'backbone' WHEN 3 THEN 'background' ELSE '' END AS role, l_linestatus = 'F' AS was_read FROM lineitem)""")
def role_combination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and scores of references after verified roles, or after a reading that named none."""
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    label = F.when(n % 3 == 0, "benchmark/dataset").when(n % 3 == 1, "likely baseline").otherwise("background reference")
    role = F.when(p % 5 == 0, "baseline").when(p % 5 == 1, "dataset").when(p % 5 == 2, "backbone").when(p % 5 == 3, "background").otherwise("")
    m = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("key"), label.alias("label"), F.round(F.col("l_discount") * 10, 2).alias("score"), role.alias("role"), (F.col("l_linestatus") == "F").alias("was_read"))
    result, score = combine_roles(F.col("label"), F.col("score"), F.col("role"), F.col("was_read"))
    return m.select("key", result.alias("result"), score.alias("new_score"))


@query("""WITH n AS (SELECT p_partkey, p_type, regexp_replace(regexp_replace(lower(p_type || ' ' || p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS base FROM part)
SELECT p_partkey, CASE WHEN length(base) <= 20 THEN base WHEN contains(left(base, 21), '-') THEN regexp_replace(left(base, 21), '-[^-]*$', '') ELSE left(base, 20) END AS slug,
CASE WHEN length(p_type) <= 12 THEN p_type ELSE regexp_replace(left(p_type, 11), ' [^ ]*$', '') || '…' END AS clipped FROM n""")
def slug_and_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short ids of names, cut at a word, and text cut at a word."""
    return table(spark, sf_dir, "part").select("p_partkey", slug(F.concat_ws(" ", "p_type", "p_name", "p_brand"), 20).alias("slug"), clip(F.col("p_type"), 12).alias("clipped"))
