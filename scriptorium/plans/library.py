"""Queries on look-ups, merges of sources, patches, and small state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import inverted_text, rebuild_abstract
from scriptorium.operators import incremental
from scriptorium.plans.registry import query
from scriptorium.session import table
from scriptorium.sources import lookups


@query("""SELECT k.id AS c_custkey, c_name FROM (SELECT DISTINCT (o_custkey * 3) % 2500 AS id FROM orders) k LEFT JOIN customer ON c_custkey = k.id""")
def batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every asked key, with nulls for those unknown."""
    asked = table(spark, sf_dir, "orders").select(((F.col("o_custkey") * 3) % 2500).alias("c_custkey")).distinct()
    return lookups.batch(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), asked, "c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def scan_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of listed keys, by a semi-join."""
    ids = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return lookups.by_ids(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ids, "o_custkey").select("o_orderkey")


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem)
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT src FROM e WHERE dst = 7)""")
def citing_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows one edge before a given one."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return lookups.citing(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), edges, 7, "o_orderkey")


@query("""WITH r AS (SELECT o_custkey AS key, o_orderpriority AS source, max(o_totalprice) AS price, CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE max(o_orderstatus) END AS status FROM orders GROUP BY 1, 2),
k AS (SELECT *, CASE source WHEN '5-LOW' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END * 10 + ascii(source) - 48 AS rank FROM r)
SELECT key, arg_min(price, rank) AS price, arg_min(status, rank) FILTER (WHERE status IS NOT NULL) AS status FROM k GROUP BY key""")
def source_priority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of each key from the first source, by priority, that fills them."""
    o = table(spark, sf_dir, "orders")
    r = o.groupBy(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("source")).agg(F.max("o_totalprice").alias("price"), F.max("o_orderstatus").alias("s"))
    r = r.withColumn("status", F.when(F.col("source") != "2-HIGH", F.col("s")))
    return lookups.source_merge(r, "key", ("5-LOW", "2-HIGH", "1-URGENT"), ("price", "status"))


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'patched' ELSE c_name END AS name, c_nationkey::BIGINT + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS version, c_custkey % 3 = 1 AS conflict FROM customer""")
def patch_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches that fit the version they were made for; others are told as conflicts."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("version"))
    made_for = F.when(F.col("key") % 3 == 0, F.col("version")).otherwise(F.col("version") - 1)
    patches = c.where("key % 3 < 2").select("key", made_for.alias("version"), F.lit("patched").alias("name"))
    return lookups.apply_patches(c, patches, ("name",))


@query("""SELECT conv_id, string_agg(role, ';' ORDER BY role) AS lacking FROM (SELECT conv_id, unnest(list_filter(['assistant', 'system', 'user'], lambda x: NOT list_contains(roles, x))) AS role
FROM (SELECT conv_id, list(DISTINCT role) AS roles FROM conversations GROUP BY conv_id)) GROUP BY conv_id""")
def tag_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a list that another lacks."""
    wanted = F.array(*[F.lit(r) for r in ("assistant", "system", "user")])
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return c.select("conv_id", F.array_join(lookups.difference(wanted, F.col("roles")), ";").alias("lacking")).where("lacking <> ''")


@query("""SELECT l_suppkey AS author_id, hits, works, hits * 10 + works AS affinity FROM (SELECT l_suppkey, sum(len(regexp_extract_all(p_type || ' ' || p_name, '(?i)steel|promo')))::BIGINT AS hits, least(50, count(*))::BIGINT AS works
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)""")
def author_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates ranked by keywords in what they made."""
    from scriptorium.operators.authors import affinity

    works = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("author_id"), F.col("p_type").alias("topic"), F.col("p_name").alias("title"))
    return affinity(works, ("steel", "promo"))


@query("""SELECT user_id, strftime(greatest(max(ts) FILTER (WHERE event_type = 'view'), max(ts) FILTER (WHERE event_type = 'click')), '%Y-%m-%d %H:%M:%S') AS stamp,
date_diff('day', greatest(max(ts) FILTER (WHERE event_type = 'view'), max(ts) FILTER (WHERE event_type = 'click'))::DATE, DATE '2024-02-05') >= 10 AS due FROM events GROUP BY user_id""")
def scan_if_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of several stamps, and whether a scan is due after it."""
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(incremental.latest_stamp(last("view"), last("click")).alias("at"))
    due = incremental.scan_due(F.col("at").cast("date"), F.lit("2024-02-05").cast("date"))
    return e.select("user_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("stamp"), due.alias("due"))


_WORDS_SQL = "string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' ')"


@query(f"SELECT doc_id, sha256(array_to_string({_WORDS_SQL}, ' ')) AS digest FROM documents")
def rebuild_inverted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through an inverted index of word positions and back, every document whole; null texts have no digest."""
    words = F.split(F.trim(F.regexp_replace("text", "[ \\t\\n\\r\\f\\x0B]+", " ")), " ")
    index = table(spark, sf_dir, "documents").select("doc_id", "text", inverted_text(words).alias("inverted"))
    return index.select("doc_id", F.when(F.col("text").isNotNull(), F.sha2(rebuild_abstract(F.col("inverted")), 256)).alias("digest"))
