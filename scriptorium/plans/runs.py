"""Queries that run the engine as a whole, its report, and paged sources."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.api import Engine
from scriptorium.operators import report
from scriptorium.plans.registry import query
from scriptorium.schema import PAPER, Settings, conform
from scriptorium.session import hadoop, scratch_path, spread, table
from scriptorium.sources.paged import ERRORS, first_kept, register, split_batches

TODAY = date(2020, 5, 1)


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records of a source: every other one is about looms and carpets, every fifth in a journal."""
    k = F.col("p_partkey")
    word = F.translate(F.md5(k.cast("string")), "0123456789", "ghijklmnop")
    rows = spread(table(spark, sf_dir, "part").select("p_partkey")).select(
        F.when(k % 2 == 0, _text("looms ", word, " carpets")).otherwise(_text("wool ", word, " yarn")).alias("title"), F.lit("Said of it.").alias("abstract"), _text("10.5555/", k).alias("doi"), F.lit("2020-05-01").alias("publication_date"),
        F.when(k % 5 == 0, "tmi").otherwise("arxiv").alias("venue_key"), F.when(k % 5 == 0, "journal").otherwise("preprint").alias("venue_type"), F.lit("V").alias("venue"), F.array(F.lit("A B")).alias("authors"), F.lit("one").alias("source"),
    )
    return conform(rows, PAPER)


_FOUND_SQL = """p AS (SELECT p_partkey AS k, 'looms ' || translate(md5(p_partkey::VARCHAR), '0123456789', 'ghijklmnop') || ' carpets' AS title FROM part WHERE p_partkey % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY k % 5 = 0 ORDER BY sha1('10.5555/' || k || '|' || title || '|2020')) AS place FROM p)"""


@query(f"""WITH {_FOUND_SQL} SELECT '10.5555/' || k AS doi, CASE WHEN k % 5 = 0 THEN 0.8794 ELSE 0.7474 END::DOUBLE AS final_score, CASE WHEN k % 5 = 0 AND place <= 25 THEN 'accept' ELSE 'review' END AS decision,
CASE WHEN k % 5 = 0 AND place > 25 THEN 'auto-add limit of 25 per run reached' ELSE '' END AS reject_reason, CASE WHEN k % 7 = 0 THEN 'existing' ELSE 'candidate' END AS route FROM r WHERE k % 7 <> 0
UNION ALL SELECT '10.5555/' || k, CASE WHEN k % 5 = 0 THEN 0.8794 ELSE 0.7474 END, CASE WHEN k % 5 = 0 THEN 'accept' ELSE 'review' END, '', 'existing' FROM r WHERE k % 7 = 0""".replace("FROM p)", "FROM p WHERE k % 7 <> 0 UNION ALL SELECT *, 0 FROM p WHERE k % 7 = 0)"))
def engine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search from scan to route: what doesn't match never leaves the scan, what the library has isn't capped."""
    library = table(spark, sf_dir, "part").where("p_partkey % 7 = 0").select(
        _text("K", F.col("p_partkey")).alias("key"), F.lit("other").alias("title"), F.create_map(F.lit("doi"), _text("10.5555/", F.col("p_partkey"))).alias("ids"), F.lit("journalArticle").alias("item_type"), F.lit(2020).alias("year")
    )
    engine = Engine(spark, TODAY, Settings(), {"one": lambda: _papers(spark, sf_dir)}, library)
    return engine.search("looms carpets").rows.select("doi", "final_score", "decision", "reject_reason", "route")


@query("SELECT '10.5555/1' AS doi, 'accept' AS decision, '' AS reject_reason WHERE 1 IN (SELECT p_partkey FROM part)")
def engine_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record that a user wants whatever its score."""
    engine = Engine(spark, TODAY, Settings(), {"one": lambda: _papers(spark, sf_dir)})
    return engine.add(doi="10.5555/1").rows.select("doi", "decision", "reject_reason")


@query("""SELECT unnest(['- retrieved: ' || count(*), '- existing: ' || count(*) FILTER (WHERE o_orderkey % 10 = 0), '- accepted: ' || count(*) FILTER (WHERE o_orderkey % 10 <> 0 AND o_totalprice >= 300000), '- review: ' || count(*) FILTER (WHERE o_orderkey % 10 <> 0 AND o_totalprice BETWEEN 100000 AND 299999.999),
'- rejected: ' || count(*) FILTER (WHERE o_orderkey % 10 <> 0 AND o_totalprice < 100000), '- cheap: ' || count(*) FILTER (WHERE o_totalprice < 100000)]) AS line FROM orders""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and reasons of a run's report."""
    price, k = F.col("o_totalprice"), F.col("o_orderkey")
    decision = F.when(price >= 300000, "accept").when(price >= 100000, "review").otherwise("reject")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("paper_id"), _text("order ", k).alias("title"), F.lit("V").alias("venue"), (price / 600000).alias("final_score"), decision.alias("decision"), F.when(price < 100000, "cheap").otherwise("").alias("reject_reason"),
        F.when(k % 10 == 0, "existing").otherwise("candidate").alias("route"), F.lit(False).alias("hard_rejected"),
    )
    told = report.render(rows, "Run").splitlines()
    names = ("- retrieved", "- existing", "- accepted", "- review", "- rejected", "- cheap")
    return spark.createDataFrame([(line,) for line in told if line.split(":")[0] in names], "line string")


#: Keys whose orders stand on a page: pages have a bounded size, and their number grows with the input.
PAGE_KEYS = 50_000


def _pages(spark: SparkSession, sf_dir: str, query, page) -> str:
    """Orders landed as pages of JSON, `query`/`page` in a folder."""
    o = table(spark, sf_dir, "orders")
    results = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus")))
    path = scratch_path(spark, "pages")
    lines = o.groupBy(query.alias("query"), page.alias("page")).agg(F.to_json(F.struct(results.alias("results"))).alias("value"))
    lines.withColumn("page", F.lpad("page", 9, "0")).write.partitionBy("query", "page").text(path)
    return path


def _landed(spark: SparkSession, path: str, out: str) -> None:
    """Move pages that Spark wrote by partition to a folder for each query, a file for each page."""
    fs, system = hadoop(spark, path)
    for q in system.listStatus(fs.Path(path)):
        if not q.isDirectory():
            continue
        for p in system.listStatus(q.getPath()):
            to = fs.Path(f"{out}/{q.getPath().getName().partition('=')[2]}/{p.getPath().getName().partition('=')[2]}.json")
            system.mkdirs(to.getParent())
            for f in system.listStatus(p.getPath()):
                system.rename(f.getPath(), to)


ORDERS = "o_orderkey long, o_orderpriority string, o_orderstatus string"
_PAGED = "_query string, _page string, _place int, _error string"


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey >= 1000 AND o_orderstatus = 'F'")
def paged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages of a source by a reader of its own, which tests bounds and equalities while it reads."""
    folder = scratch_path(spark, "landed")
    _landed(spark, _pages(spark, sf_dir, F.lit("q"), F.floor(F.col("o_orderkey") / PAGE_KEYS).cast("string")), folder)
    register(spark)
    found = spark.read.format("paged").option("schema", ORDERS).option("folder", folder).load()
    return found.where("o_orderkey >= 1000 and o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority")


@query("""WITH p AS (SELECT *, o_custkey % 3 AS q, o_orderkey // 2000 AS page FROM orders WHERE o_orderstatus = 'F')
SELECT 'q' || q AS _query, o_orderkey FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY page, o_orderkey) <= 400""")
def paged_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 400 rows of each query that pass a filter, in the order of its pages."""
    folder = scratch_path(spark, "landed")
    _landed(spark, _pages(spark, sf_dir, F.concat(F.lit("q"), F.col("o_custkey") % 3), F.floor(F.col("o_orderkey") / PAGE_KEYS).cast("string")), folder)
    register(spark)
    rows = spark.read.format("paged").option("schema", f"{ORDERS}, {_PAGED}").option("folder", folder).load()
    return first_kept(rows.where("o_orderstatus = 'F'"), 400).select("_query", "o_orderkey")


@query("""SELECT 'row' AS kind, o_orderkey AS k FROM orders UNION ALL SELECT 'error', n FROM (SELECT unnest([0, 1, 2]) AS n) WHERE (SELECT count(*) FROM orders) > 0""")
def paged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages taken by a stream in three micro-batches as they land, each with a page that can't be read, which an error row tells."""
    staged = _pages(spark, sf_dir, F.concat(F.lit("q"), F.col("o_custkey") % 2), (F.col("o_orderkey") % 3).cast("string"))
    folder, out = scratch_path(spark, "landed"), scratch_path(spark, "paged-stream")
    register(spark)
    whole = scratch_path(spark, "pages-whole")
    _landed(spark, staged, whole)
    fs, system = hadoop(spark, whole)
    for n in range(3):
        for q in system.listStatus(fs.Path(whole)):
            to = fs.Path(f"{folder}/{q.getPath().getName()}/{n:09d}.json")
            system.mkdirs(to.getParent())
            system.rename(fs.Path(q.getPath(), f"{n:09d}.json"), to)
        broken = system.create(fs.Path(f"{folder}/broken/{n:09d}.json"))
        broken.write(bytearray(b"{no json"))
        broken.close()
        stream = spark.readStream.format("paged").option("schema", f"{ORDERS}, {_PAGED}").option("folder", folder).load()
        split_batches(stream, out, f"{out}/checkpoint")
    rows = spark.read.schema(f"{ORDERS}, _query string, _page string, _place int").parquet(f"{out}/rows")
    errors = spark.read.schema(ERRORS).parquet(f"{out}/errors")
    return rows.select(F.lit("row").alias("kind"), F.col("o_orderkey").alias("k")).unionAll(errors.select(F.lit("error"), F.col("_page").substr(1, 9).cast("long")))
