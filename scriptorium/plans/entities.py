"""Queries on joins, matching, deduplication, libraries and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import normalize_doi, redact, seen_key
from scriptorium.operators import enrich, graph, incremental, topk
from scriptorium.operators.authors import aliases_by_institution
from scriptorium.operators.components import connected_components
from scriptorium.plans.registry import query
from scriptorium.session import table


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def lookup_enrich_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows filled in from a look-up by key; none is lost."""
    none = F.lit(None).cast("string")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), none.alias("c_name"), none.alias("c_mktsegment"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("found_name"), F.col("c_mktsegment").alias("found_segment"))
    return enrich.lookup(o, c, "key", {"c_name": "found_name", "c_mktsegment": "found_segment"}).drop("key")


@query("""SELECT s_suppkey, CASE WHEN left(s_name, 4) = left(n_name, 4) OR s_suppkey % 3 = 0 THEN n_name END AS filled FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""")
def guarded_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A look-up that counts only where a residual condition holds."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("key"), F.lit(None).cast("string").alias("filled"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    guard = enrich.titles_agree(F.col("s_name"), F.col("n_name"), 4) | (F.col("s_suppkey") % 3 == 0)
    return enrich.lookup(s, n, "key", {"filled": "n_name"}, guard).select("s_suppkey", "filled")


@query("""WITH n AS (SELECT lower(p_name) AS k, min(p_partkey) AS id FROM part GROUP BY 1),
w AS (SELECT id, k, list_distinct(string_split(k, ' ')) AS words FROM n), e AS (SELECT id, k, unnest(words) AS word FROM w)
SELECT DISTINCT a.id AS src, b.id AS dst, levenshtein(a.k, b.k)::BIGINT AS distance FROM e a JOIN e b ON a.word = b.word AND a.id > b.id WHERE levenshtein(a.k, b.k) <= 3""")
def levenshtein_block_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that share a word and differ in three letters at most; names are distinct before they meet."""
    n = table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("k")).agg(F.min("p_partkey").alias("id"))
    e = n.select("id", "k", F.explode(F.array_distinct(F.split("k", " "))).alias("word"))
    met = e.alias("a").join(e.alias("b"), (F.col("a.word") == F.col("b.word")) & (F.col("a.id") > F.col("b.id")) & (F.abs(F.length("a.k") - F.length("b.k")) <= 3))
    near = met.withColumn("distance", F.levenshtein("a.k", "b.k", 3)).where("distance between 0 and 3")
    return near.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.col("distance").cast("long").alias("distance")).distinct()


@query("""WITH RECURSIVE b AS (SELECT c_custkey AS id, 'n' || c_nationkey || ':' || (floor(c_acctbal / 50))::BIGINT AS k FROM customer
  UNION ALL SELECT c_custkey, 's' || c_mktsegment || ':' || (floor(c_acctbal / 5))::BIGINT FROM customer),
e AS (SELECT b.id AS src, h.dst FROM b JOIN (SELECT k, min(id) AS dst FROM b GROUP BY k) h USING (k) WHERE id <> dst),
two AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT src AS node, src AS reach FROM two UNION SELECT node, dst FROM r JOIN two ON reach = src)
SELECT node, min(reach) AS component FROM r GROUP BY node""")
def dedup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of customers that share a key of either of two kinds."""
    c = table(spark, sf_dir, "customer")
    key = lambda mark, name, width: F.concat(F.lit(mark), F.col(name).cast("string"), F.lit(":"), F.floor(F.col("c_acctbal") / width).cast("string"))
    b = c.select(F.col("c_custkey").alias("id"), F.explode(F.array(key("n", "c_nationkey", 50), key("s", "c_mktsegment", 5))).alias("k"))
    heads = b.groupBy("k").agg(F.min("id").alias("dst"))
    return connected_components(b.join(heads, "k").where("id <> dst").select(F.col("id").alias("src"), "dst"))


@query("""SELECT page_id, lower(regexp_replace(regexp_extract(u, '(?i)10\\.\\d{4,9}/[^\\s"<>]+', 0), '[.,;)\\]}]+$', '')) AS doi, left(sha1(url), 16) AS seen_key,
regexp_replace(u, '(?i)\\b(api_key|apikey|key|token|access_token|email|mailto|password)=([^&\\s]+)', '\\1=***', 'g') AS safe_url
FROM (SELECT page_id, url, url || '?token=abc' || page_id || '&doi=https://doi.org/10.1234/ABC.' || page_id || ').' AS u FROM pages)""")
def normalize_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers found in URLs, their seen keys, and URLs without credentials."""
    page = F.col("page_id").cast("string")
    u = F.concat("url", F.lit("?token=abc"), page, F.lit("&doi=https://doi.org/10.1234/ABC."), page, F.lit(")."))
    return table(spark, sf_dir, "pages").select("page_id", normalize_doi(u).alias("doi"), seen_key(F.col("url")).alias("seen_key"), redact(u).alias("safe_url"))


@query("SELECT event_id, left(sha1(event_id::VARCHAR), 16) AS seen_key FROM events")
def seen_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that rows are remembered by."""
    return table(spark, sf_dir, "events").select("event_id", seen_key(F.col("event_id").cast("string")).alias("seen_key"))


@query("""WITH m AS (SELECT DISTINCT o_orderkey AS member FROM orders WHERE o_orderpriority = '1-URGENT'),
c AS (SELECT l_partkey AS ref, count(DISTINCT l_orderkey) AS citing FROM lineitem JOIN m ON l_orderkey = member GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 2)
SELECT ref, citing, round(least(1.0, 0.5 + 0.02 * (citing - 1)), 4)::DOUBLE AS final_score FROM c WHERE ref NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)""")
def cocitation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that two urgent orders or more refer to and the library lacks, with the bonus that this brings."""
    from scriptorium.operators.decide import cocitation_bonus

    m = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("member"))
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("member"), F.col("l_partkey").alias("ref"))
    known = table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("ref"))
    return cocitation_bonus(graph.cocitations(m, r, 2, known).withColumn("final_score", F.lit(0.5)), "citing")


@query("""WITH s AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000),
e AS (SELECT c_custkey AS seed_id, o_orderkey AS paper_id, 'reference' AS r FROM s JOIN orders ON o_custkey = c_custkey
UNION ALL SELECT c_custkey, o_orderkey, 'citing' FROM s JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F')
SELECT seed_id, paper_id, string_agg(DISTINCT r, ';' ORDER BY r) AS relations FROM e WHERE seed_id <> paper_id GROUP BY 1, 2""")
def graph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies one edge away from the seeds, with the kinds of edges."""
    s = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 9000").select(F.col("c_custkey").alias("seed_id"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), "o_orderstatus")
    found = graph.expand(s, {"reference": o.select("src", "dst"), "citing": o.where("o_orderstatus = 'F'").select("src", "dst")})
    return found.withColumn("relations", F.array_join("relations", ";"))


@query("""WITH a AS (SELECT s_suppkey AS author_id, 'n' || (s_suppkey % 20) AS name, [s_nationkey, (s_nationkey + s_suppkey) % 25] AS inst FROM supplier),
t AS (SELECT name, min(author_id) AS canonical_id FROM a GROUP BY name)
SELECT a.name, canonical_id, a.author_id FROM a JOIN t USING (name) JOIN a top ON top.author_id = canonical_id WHERE a.author_id = canonical_id OR list_has_any(a.inst, top.inst)""")
def alias_by_institution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of one name that share an institution with its first candidate."""
    s = table(spark, sf_dir, "supplier")
    inst = F.array(F.col("s_nationkey").cast("long"), (F.col("s_nationkey") + F.col("s_suppkey")) % 25)
    a = s.select(F.col("s_suppkey").alias("author_id"), F.concat(F.lit("n"), (F.col("s_suppkey") % 20).cast("string")).alias("name"), inst.alias("institutions"), F.col("s_suppkey").alias("rank"))
    return aliases_by_institution(a)


@query("""SELECT 'r' || r_regionkey AS key, r_name AS path, 0::BIGINT AS level FROM region UNION ALL
SELECT 'n' || n_nationkey, r_name || '/' || n_name, 1 FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL
SELECT 's' || s_suppkey, r_name || '/' || n_name || '/' || s_name, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def collection_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a tree of regions, nations and suppliers."""
    node = lambda t, mark, key, name, parent: table(spark, sf_dir, t).select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("key"), F.col(name).alias("name"), parent.alias("parentCollection"), F.lit(False).alias("deleted"))
    up = lambda mark, name: F.concat(F.lit(mark), F.col(name).cast("string"))
    tree = node("region", "r", "r_regionkey", "r_name", F.lit(None).cast("string")).unionAll(node("nation", "n", "n_nationkey", "n_name", up("r", "n_regionkey"))).unionAll(node("supplier", "s", "s_suppkey", "s_name", up("n", "s_nationkey")))
    return graph.with_paths(tree).select("key", "path", F.col("level").cast("long").alias("level"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 2")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two dearest lines of each order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_extendedprice")
    return topk.best_per_group(li, "l_orderkey", F.desc("l_extendedprice"), F.col("l_linenumber"), k=2).drop("place")


@query("""SELECT page_id, path, count(*) AS n FROM (SELECT page_id, unnest(string_split(split_part(regexp_replace(url, '^https?://[^/]*/?', ''), '?', 1), '/')) AS path FROM pages) WHERE path <> '' GROUP BY 1, 2""")
def split_path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of URL paths."""
    from scriptorium.functions.text import split_path

    path = F.substring_index(F.regexp_replace("url", "^https?://[^/]*/?", ""), "?", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.explode(split_path(path)).alias("path")).groupBy("page_id", "path").agg(F.count("*").alias("n"))


@query("""SELECT level, path FROM (SELECT DISTINCT 1 AS level, r_name AS path FROM region UNION SELECT 2, r_name || '/' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey)
WHERE path NOT IN (SELECT r_name FROM region WHERE r_regionkey < 2)""")
def missing_path_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of paths that don't exist yet, in the order in which to make them."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    paths = n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("path"))
    return graph.missing_levels(paths, r.where("r_regionkey < 2").select(F.col("r_name").alias("path")))


@query("""WITH b AS (SELECT user_id AS key, event_id AS version, event_type FROM events)
SELECT key, version, event_type FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS r FROM b)
WHERE r = 1 AND key NOT IN (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) % 2 = 0)""")
def cdc_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each user from a base and its changes, without deleted users."""
    e = table(spark, sf_dir, "events")
    b = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), "event_type")
    gone = e.where("event_type = 'error'").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n")).where("n % 2 = 0")
    return incremental.snapshot(b.where("version % 2 = 0"), b.where("version % 2 = 1"), gone)
