"""Queries on sinks, state of incremental runs, saved searches, prompts and streams."""

from __future__ import annotations

import os
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import incremental
from scriptorium.plans import alerts, prompt
from scriptorium.plans.boolean import Query, parse_groups, scan_queries
from scriptorium.plans.config import settings_of
from scriptorium.plans.registry import query
from scriptorium.schema import PAPER, Settings, conform
from scriptorium.session import hadoop, scratch_path, table
from scriptorium.sources import judgements, ledger, lookups, readers, sinks
from scriptorium.streaming import flows

_LISTS = "array<string>"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _named(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast(_LISTS)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as decided records."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(
        k.cast("string").alias("issue"), F.translate("c_name", "#", " ").alias("title"), F.array(_text("Ada van der ", F.col("c_mktsegment")), F.lit("Moss, K."), F.lit("Group")).alias("authors"),
        F.when(k % 3 == 0, "journal").when(k % 3 == 1, "conference").otherwise("preprint").alias("venue_type"), F.when(k % 3 == 0, "tmi").when(k % 3 == 1, "neurips").otherwise("arxiv").alias("venue_key"), F.lit("V").alias("venue"),
        (2000 + F.col("c_nationkey")).cast("int").alias("year"), _text("10.5555/", k).alias("doi"), F.when(k % 3 == 2, _text("1901.", k)).alias("arxiv_id"),
        F.when(k % 2 == 0, _named("ct")).otherwise(_named("cxr", "mammo")).alias("modalities"), F.when(k % 4 == 0, _named("vlm")).when(k % 4 == 1, _named("ood", "hallucination")).otherwise(_named("robustness")).alias("topics"), F.when(k % 7 == 0, "Ada").alias("author_watch"),
    )
    number = F.col("issue").cast("long")
    return conform(c, PAPER).withColumns({"paper_id": number, "decision": F.when(number % 5 == 0, "review").when(number % 5 == 1, "reject").otherwise("accept"), "final_score": F.when(number % 10 == 2, 0.95).otherwise(0.85)})


@query("""SELECT c_custkey, replace(c_name, '#', ' ') AS title, CASE c_custkey % 3 WHEN 0 THEN 'journalArticle' WHEN 1 THEN 'conferencePaper' ELSE 'preprint' END AS kind, 'van der ' || c_mktsegment AS last_name, 'K.' AS second_first, 'Group' AS third,
(2000 + c_nationkey)::VARCHAR AS date, CASE WHEN c_custkey % 3 = 1 THEN 'NeurIPS ' || (2000 + c_nationkey) END AS conference, CASE WHEN c_custkey % 3 = 2 THEN 'arXiv:1901.' || c_custkey END AS archive,
concat_ws(';', CASE WHEN c_custkey % 2 = 0 THEN 'modality:ct' ELSE 'modality:cxr;modality:mammo' END, CASE c_custkey % 4 WHEN 0 THEN 'topic:vlm' WHEN 1 THEN 'topic:ood' ELSE 'topic:robustness' END, 'source:manual-prompt', CASE WHEN c_custkey % 7 = 0 THEN 'source:author-watch' END, 'status:unread',
CASE WHEN c_custkey % 5 = 0 THEN 'status:review-required' WHEN c_custkey % 10 = 2 THEN 'status:high-priority' END, CASE c_custkey % 3 WHEN 0 THEN 'venue:tmi' WHEN 1 THEN 'venue:neurips' ELSE 'venue:arxiv' END, CASE WHEN c_custkey % 3 = 2 THEN 'type:preprint' END) AS tags FROM customer""")
def item_json_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON items in the shape of their venue type, read back: names split, tags in order."""
    found = sinks.items(_records(spark, sf_dir), Settings(profile="radiology"))
    back = "itemType string, title string, date string, conferenceName string, archiveID string, creators array<struct<firstName:string,lastName:string,name:string>>, tags array<struct<tag:string>>"
    i = found.select(F.col("paper_id").alias("c_custkey"), F.from_json("item", back).alias("i"))
    return i.select(
        "c_custkey", "i.title", F.col("i.itemType").alias("kind"), F.col("i.creators")[0]["lastName"].alias("last_name"), F.col("i.creators")[1]["firstName"].alias("second_first"), F.col("i.creators")[2]["name"].alias("third"),
        "i.date", F.col("i.conferenceName").alias("conference"), F.col("i.archiveID").alias("archive"), F.array_join(F.transform("i.tags", lambda t: t["tag"]), ";").alias("tags"),
    )


@query("""SELECT c_custkey, unnest(CASE WHEN c_custkey % 5 = 0 THEN ['Auto Discovery - Review'] ELSE list_distinct(
CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey % 2 = 0 THEN ['Vision-Language Models/CT'] ELSE ['Vision-Language Models/CXR', 'Vision-Language Models/Mammography'] END WHEN 1 THEN ['Uncertainty & Reliability/OOD / Shift'] ELSE ['Robustness & Evaluation'] END
|| CASE WHEN c_custkey % 7 = 0 THEN ['Author Watches'] ELSE [] END) END) AS target FROM customer""")
def fanout_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each decided record to one or more destinations."""
    r = _records(spark, sf_dir)
    return r.select(F.col("paper_id").alias("c_custkey"), F.explode(sinks.destinations(Settings(profile="radiology"), "manual-prompt")).alias("target"))


@query("SELECT c_custkey AS key, substr(sha1(c_custkey::VARCHAR), 1, 16) AS item_id, 'create' AS action FROM customer WHERE c_custkey % 5 <> 1")
def written_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items written once, though ingested twice, with an audit line for each."""
    rows = _records(spark, sf_dir).withColumns({"item": F.lit("{}"), "collections": _named("x")})
    path = scratch_path(spark, "written")
    sinks.ingest(rows.where("paper_id % 2 = 0"), path, writes_enabled=True)
    sinks.ingest(rows, path, writes_enabled=True)
    return ledger.audit(spark, path).select(F.col("key").cast("long").alias("key"), "item_id", "action")


def first_try_dies(chunk: list[dict], marker: str) -> list[bool]:
    """A gate that ends the first worker to reach it, with what it had staged, and lets all others pass."""
    system, path = ledger.file_system(marker)
    if not system.get_file_info(path).is_file:
        with system.open_output_stream(path):
            pass
        os._exit(1)
    return ledger.documents(chunk, "")


@query("SELECT c_custkey AS key, 1 AS items, 1 AS audit_lines FROM customer WHERE c_custkey % 5 <> 1")
def written_after_a_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each item and its audit line stand, when a task was killed while it wrote and the run was made again."""
    rows = _records(spark, sf_dir).withColumns({"item": F.to_json(F.struct("paper_id")), "collections": _named("x")})
    path = scratch_path(spark, "crashed")
    fs, system = hadoop(spark, path)
    system.mkdirs(fs.Path(path))
    for _ in range(2):
        try:
            sinks.ingest(rows, path, writes_enabled=True, gate=f"{__name__}:first_try_dies", argument=f"{path}/died")
        except Exception as e:  # noqa: BLE001  a cluster tries the task again, a local master doesn't
            if "exited unexpectedly" not in str(e) and "crashed" not in str(e):
                raise
    items = ledger.items(spark, path).groupBy("key").agg(F.count("*").cast("int").alias("items"))
    lines = ledger.audit(spark, path).groupBy("key").agg(F.count("*").cast("int").alias("audit_lines"))
    return items.join(lines, "key", "full").select(F.col("key").cast("long").alias("key"), "items", "audit_lines")


@query("SELECT c_custkey AS key, decision FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'review' WHEN 1 THEN 'reject' ELSE 'accept' END AS decision FROM customer) WHERE decision <> 'reject'")
def planned_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dry run would write: the plan alone."""
    rows = _records(spark, sf_dir).withColumns({"item": F.lit("{}"), "collections": _named("x")})
    return sinks.ingest(rows, scratch_path(spark, "never")).select(F.col("key").cast("long").alias("key"), "decision")


@query("""SELECT o_orderkey AS library_key, 'Target' AS collection FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_custkey % 3 <> 0""")
def existing_filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items to add to a collection: not trashed, no child, not awaiting review, not there yet."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    items = o.select(k.alias("library_key"), F.when(F.col("o_orderstatus") == "P", True).alias("deleted"), F.when(k % 5 == 0, "parent").alias("parentItem"), F.array(F.struct(F.when(k % 7 == 0, "status:review-required").otherwise("x").alias("tag"))).alias("tags"))
    filed = o.where("o_custkey % 3 = 0").select(k.alias("library_key"), F.lit("Target").alias("collection")).unionAll(o.select(k.alias("library_key"), F.lit("Other").alias("collection")))
    return sinks.file_existing(items, filed, "Target")


@query("""SELECT c_custkey AS key, CASE c_custkey % 4 WHEN 0 THEN 'seen' || chr(10) || 'Published DOI: 10.5555/' || c_custkey || ' (TMI 2020)' WHEN 1 THEN 'DOI: 10.5555/' || c_custkey WHEN 2 THEN 'Published DOI: 10.5555/' || c_custkey || ' (TMI 2020)' ELSE 'kept' END AS extra FROM customer""")
def upgrades_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library items with the published version noted, once."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    extra = F.when(k % 4 == 0, "seen").when(k % 4 == 1, _text("DOI: 10.5555/", k)).when(k % 4 == 3, "kept")
    ups = c.select(k.alias("key"), F.when(k % 4 == 3, _text("10.1101/", k)).otherwise(_text("10.5555/", k)).alias("doi"), F.lit("TMI").alias("venue"), F.lit(2020).alias("year"))
    return sinks.annotate_upgrades(c.select(k.alias("key"), extra.alias("extra")), ups)


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'official_oa' WHEN 1 THEN 'arxiv' WHEN 2 THEN 'pmc' END AS kind, CASE p_partkey % 4 WHEN 0 THEN 'a_b.pdf' WHEN 1 THEN 'x.pdf' WHEN 2 THEN 'paper.pdf' END AS filename, p_size % 2 = 0 AS is_pdf FROM part""")
def pdf_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preferred PDF of a record, its file name, and whether a file's first bytes are a PDF's."""
    k = F.col("p_partkey")
    entry = lambda fits, name, url: F.when(fits, F.struct(F.lit(name).alias("key"), F.lit(url).alias("value")))
    found = F.map_from_entries(F.array_compact(F.array(entry(k % 4 == 0, "official_oa", "https://h.org/a b.pdf"), entry(k % 4 < 2, "arxiv", "https://h.org/x"), entry(k % 4 < 3, "pmc", "https://h.org/paper.pdf/"))))
    p = table(spark, sf_dir, "part").select(k, sinks.choose_pdf(found).alias("c"), sinks.is_pdf(F.when(F.col("p_size") % 2 == 0, "%PDF-1.7").otherwise("<html>").cast("binary")).alias("is_pdf"))
    return p.select("p_partkey", "c.kind", "c.filename", "is_pdf")


@query("""SELECT c_custkey, '<p>Found automatically.</p><p>Source: a, b</p><p>Discovery query: q &lt;1&gt;</p><p>Discovery date: 2020-01-02</p><p>Relevance score: 0.50 | Quality score: 0.25 | Final score: 0.85</p><p>Decision: accept' || CASE WHEN c_custkey % 2 = 0 THEN ' (late &amp; odd)' ELSE '' END || '</p>' AS note FROM customer""")
def provenance_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How records were found and scored, as notes."""
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", _named("a", "b").alias("sources"), _named("q <1>").alias("queries"), F.lit(0.5).alias("relevance_score"), F.lit(0.25).alias("quality_score"), F.lit(0.85).alias("final_score"), F.lit("accept").alias("decision"), F.when(F.col("c_custkey") % 2 == 0, "late & odd").otherwise("").alias("reject_reason")
    )
    return sinks.provenance(c, date(2020, 1, 2)).select("c_custkey", "note")


@query("""SELECT level::INT AS level, path FROM (VALUES (1, 'Literature'), (2, 'Literature/Author Watches'), (2, 'Literature/Auto Discovery - Review'), (2, 'Literature/Auto Discovery - Accepted')) v(level, path) WHERE (SELECT count(*) FROM region) = 5""")
def library_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels of a library's layout that don't exist, in the order in which to make them."""
    from scriptorium.operators.graph import missing_levels

    wanted = spark.createDataFrame([(p,) for p in sinks.hierarchy(Settings())], "path string")
    return missing_levels(wanted, table(spark, sf_dir, "region").select(F.col("r_name").alias("path"))).select("level", "path")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW') AND o_orderkey % 6 <> 0 AND o_custkey % 4 = 0""")
def collection_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live items of a collection: no trash, notes, attachments or children."""
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "note").when(F.col("o_orderpriority") == "5-LOW", "attachment").otherwise("journalArticle")
    items = o.select("o_orderkey", kind.alias("itemType"), F.when(F.col("o_orderstatus") == "P", True).alias("deleted"), F.when(F.col("o_orderkey") % 6 == 0, "p").alias("parentItem"), F.array(_text("c", F.col("o_custkey") % 4)).alias("collections"))
    return incremental.items_of(items, "c0").select("o_orderkey")


@query("""SELECT DISTINCT c_custkey AS key FROM customer UNION SELECT 10000000 + o_orderkey FROM orders WHERE o_orderstatus = 'F'""")
def written_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library with what this run wrote, so that its later rows match it too."""
    library = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    written = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select((F.col("o_orderkey") + 10000000).alias("key"), F.lit("more").alias("other"))
    return incremental.with_written(library, written)


@query("""SELECT DISTINCT left(sha1(event_id::VARCHAR), 16) AS seen_key FROM events WHERE event_type = 'error' OR user_id % 4 IN (0, 1) OR value > 50""")
def settled_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of records that need no other run: rejected, written, in the library, or upgrades."""
    from scriptorium.functions.text import seen_key

    e = table(spark, sf_dir, "events")
    route = F.when(F.col("user_id") % 4 == 0, "existing").when(F.col("user_id") % 4 == 1, "upgrade").otherwise("candidate")
    rows = e.select(F.array(seen_key(F.col("event_id").cast("string"))).alias("seen_keys"), F.when(F.col("event_type") == "error", "reject").otherwise("accept").alias("decision"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("written"), route.alias("route"))
    return incremental.settled(rows)


@query("""SELECT conv_id, list_has_any(list(DISTINCT role), ['system', 'none']) AS shares FROM conversations GROUP BY 1""")
def shared_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two lists have a value in common."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return c.select("conv_id", incremental.shares_any(F.col("roles"), _named("system", "none")).alias("shares"))


@query("""SELECT c_custkey AS id, strftime(CASE WHEN c_custkey % 4 = 0 THEN least(n, TIMESTAMP '2024-06-01 00:00:00') WHEN c_custkey % 4 = 1 THEN TIMESTAMP '2024-05-01 00:00:00' + to_days(14) ELSE n END, '%Y-%m-%d') AS next_run,
CASE WHEN c_custkey % 4 = 1 THEN 14 ELSE 30 END::INT AS interval_days, c_custkey % 4 <> 0 AS covered FROM (SELECT c_custkey, TIMESTAMP '2024-05-31 00:00:00' + to_days((c_custkey % 9)::INT) AS n FROM customer)""")
def alerts_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of saved searches after edits: a new interval counts from the last run, a changed search starts anew."""
    k = F.col("c_custkey")
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    a = table(spark, sf_dir, "customer").select(k.alias("id"), F.lit(30).alias("interval_days"), at("2024-05-01 00:00:00").alias("last_run_at"), at("2024-05-01 00:00:00").alias("last_success_at"), (at("2024-05-31 00:00:00") + F.make_dt_interval((k % 9).cast("int"))).alias("next_run_at"))
    edits = table(spark, sf_dir, "customer").where("c_custkey % 4 < 2").select(k.alias("id"), F.when(k % 4 == 1, 14).cast("int").alias("interval_days"), (k % 4 == 0).alias("changed_search"))
    new = incremental.after_edit(a, edits, datetime(2024, 6, 1))
    return new.select("id", F.date_format("next_run_at", "yyyy-MM-dd").alias("next_run"), F.col("interval_days").cast("int").alias("interval_days"), F.col("last_success_at").isNotNull().alias("covered"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus <> 'F', o_orderdate, o_orderkey) AS place FROM orders")
def alerts_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved searches in the order in which they are listed: active ones first, then by next run and name."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "active").otherwise("paused").alias("status"), F.col("o_orderdate").alias("next_run_at"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("name"))
    return incremental.alert_places(o).select("o_orderkey", "place")


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'one' ELSE 'two' END AS source, n_nationkey FROM nation UNION ALL SELECT 'failed', NULL")
def failing_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans of several sources, one of which fails: the others' rows, and which one failed."""
    n = table(spark, sf_dir, "nation")

    def broken():
        raise OSError("no answer")

    half = lambda k: lambda: n.where(f"n_nationkey % 2 = {k}").select(F.lit(("one", "two")[k]).alias("source"), "n_nationkey")
    rows, failed = readers.union_sources(spark, {"one": half(0), "broken": broken, "two": half(1)})
    return rows.unionByName(failed.select(F.lit("failed").alias("source"), F.lit(None).cast("int").alias("n_nationkey")))


@query("""SELECT 'rows' AS kind, 'q' || c_nationkey % 4 AS source, count(*) AS n FROM customer WHERE c_nationkey % 4 <> 2 AND c_acctbal > 0 GROUP BY ALL
UNION ALL SELECT 'counted', 'q' || c_nationkey % 4, count(*) FROM customer WHERE c_nationkey % 4 <> 2 AND c_acctbal > 0 GROUP BY ALL UNION ALL SELECT 'failed', 'q2', 1 WHERE (SELECT count(*) FROM customer WHERE c_nationkey % 4 = 2) > 0""")
def source_failing_in_a_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sources, of which one fails in its tasks: the others' rows, how many were counted while they were written, and what failed."""
    c = table(spark, sf_dir, "customer")
    own = lambda k: c.where(F.col("c_nationkey") % 4 == k).select(F.lit(f"q{k}").alias("source"), "c_custkey", "c_acctbal")
    breaks = lambda df: df.withColumn("c_custkey", F.when(F.length("source") > 0, F.raise_error(F.lit("no answer"))).otherwise(F.col("c_custkey")))
    scan = readers.scan_sources(spark, {f"q{k}": (lambda k=k: breaks(own(k)) if k == 2 else own(k)) for k in range(4)}, lambda df: df.where("c_acctbal > 0"))
    rows = scan.rows.groupBy("source").agg(F.count("*").alias("n"))
    told = [rows.select(F.lit("rows").alias("kind"), "source", "n"), scan.counts.select(F.lit("counted"), "source", "rows"), scan.errors.select(F.lit("failed"), "source", F.lit(1).cast("long"))]
    return told[0].unionAll(told[1]).unionAll(told[2])


@query("SELECT 'm-' || max(p_size) || '.0' AS name FROM part")
def newest_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest stable model of a family, by its version as numbers."""
    p = table(spark, sf_dir, "part")
    names = p.select(_text("m-", F.col("p_size"), ".0").alias("name")).unionAll(p.select(_text("m-", F.col("p_size") + 1, ".0-preview").alias("name"))).unionAll(p.select(_text("other-", F.col("p_size") + 5).alias("name")))
    return lookups.newest_model(names, "m")


def _nations(spark: SparkSession, sf_dir: str) -> list:
    """The fixed table of nations, on the driver: prompts and searches are read there."""
    return [(r["n_nationkey"], r["n_name"]) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]


@query("""SELECT n_nationkey, '("' || n_name || '"[tiab] OR "chest x-ray"[tiab]) AND ("wool"[tiab])' AS pubmed, '(abs:' || n_name || ' OR abs:"chest x ray") AND (abs:wool)' AS arxiv, '(' || n_name || ' OR "chest x-ray") AND (wool)' AS openalex,
'(' || n_name || ' | "chest x-ray") + (wool)' AS semantic_scholar FROM nation""")
def queries_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boolean query in the syntaxes of four sources."""
    asked = [(k, Query.of(f"({n} OR chest x-ray) AND wool")) for k, n in _nations(spark, sf_dir)]
    return spark.createDataFrame([(k, q.pubmed(), q.arxiv(), q.openalex(), q.semantic_scholar()) for k, q in asked], "n_nationkey int, pubmed string, arxiv string, openalex string, semantic_scholar string")


@query("SELECT n_nationkey, 2 AS n_groups, n_name || '/wool' AS first_group, 12 AS n_scans FROM nation")
def query_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of alternatives from explicit syntax; repeated alternatives count once."""
    rows = []
    for k, n in _nations(spark, sf_dir):
        groups = parse_groups(f"{n} OR wool; looms; ")
        rows.append((k, len(groups), "/".join(groups[0]), len(scan_queries())))
    return spark.createDataFrame(rows, "n_nationkey int, n_groups int, first_group string, n_scans int")


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'topic_search' WHEN 1 THEN 'author_search' WHEN 2 THEN 'similar' WHEN 3 THEN 'venue_search' ELSE 'baselines' END AS intent, CASE n_nationkey % 5 WHEN 1 THEN 'Ada Quill' END AS author,
CASE n_nationkey % 5 WHEN 2 THEN 'Looms of ' || n_name WHEN 4 THEN '10.5555/' || n_nationkey END AS seed, CASE n_nationkey % 5 WHEN 0 THEN 'looms in ' || n_name WHEN 1 THEN 'wool' WHEN 3 THEN 'wool' END AS subject,
CASE n_nationkey % 5 WHEN 0 THEN '1995-01-01' WHEN 1 THEN '2020-05-02' WHEN 3 THEN '2019-01-01' END AS date_from, CASE n_nationkey % 5 WHEN 3 THEN '2019-12-31' END AS date_to FROM nation""")
def prompts_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts as requests: intent, author, seed, subject and window."""
    said = ("please find papers about looms in {n} published since 1995", "papers by Ada Quill on wool from the last 30 days", 'find papers similar to "Looms of {n}"', "add MICCAI 2019 papers on wool", "what are the baselines of 10.5555/{k}?")
    rows = []
    for k, n in _nations(spark, sf_dir):
        r, _ = prompt.parse(said[k % 5].format(n=n, k=k), date(2020, 6, 1))
        rows.append((k, r.intent, r.author, r.seed, r.free_text, r.date_from, r.date_to))
    return spark.createDataFrame(rows, "n_nationkey int, intent string, author string, seed string, subject string, date_from string, date_to string")


@query("""SELECT n_nationkey, 'Ada' AS author, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS seed FROM nation""")
def proposals_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that a model proposes keep only authors and seeds that the prompt holds."""
    from scriptorium.schema import Request

    rows = []
    for k, n in _nations(spark, sf_dir):
        kept = prompt.only_said(Request(author="Ada", seed=n), f"what did Ada write on {n if k % 2 == 0 else 'wool'}?")
        rows.append((k, kept.author, kept.seed))
    return spark.createDataFrame(rows, "n_nationkey int, author string, seed string")


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'pause' WHEN 1 THEN 'create' WHEN 2 THEN 'update' ELSE 'delete' END AS op, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 2 THEN n_name WHEN 3 THEN n_name END AS ref,
CASE n_nationkey % 4 WHEN 1 THEN 'looms of ' || n_name || ' every 2 weeks' END AS query, CASE n_nationkey % 4 WHEN 2 THEN 7 END::INT AS days FROM nation""")
def alert_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands on saved searches in plain words."""
    said = ("pause the {n} alert", "create an alert for looms of {n} every 2 weeks", "change the '{n}' alert to weekly", "delete alert {n}")
    rows = []
    for k, n in _nations(spark, sf_dir):
        c = prompt.parse_alert_command(said[k % 4].format(n=n))
        rows.append((k, c["op"], c.get("ref"), c.get("query"), c.get("interval_days")))
    return spark.createDataFrame(rows, "n_nationkey int, op string, ref string, query string, days int")


@query("""SELECT n_nationkey, CASE n_nationkey % 2 WHEN 0 THEN 'Looms of ' || n_name ELSE 'CT calibration' END AS name, CASE n_nationkey % 2 WHEN 0 THEN 'looms-of-' || replace(lower(n_name), '_', '-') ELSE 'ct-calibration-2' END AS id, CASE n_nationkey % 2 WHEN 0 THEN 14 ELSE 30 END::INT AS days FROM nation""")
def alerts_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, ids and intervals of saved searches: from their description, or from what they search for."""
    rows = []
    for k, n in _nations(spark, sf_dir):
        days, rest = prompt.take_interval(f"new papers about Looms of {n} since 1999 every 2 weeks")
        if k % 2 == 0:
            name, taken = prompt.title_of(rest), set()
        else:
            name, taken, days = alerts.default_name(alerts.Alert(id="", name="", modalities=("ct",), topics=("calibration",))), {"ct-calibration"}, 30
        rows.append((k, name, alerts.slug_of(name, taken), days))
    return spark.createDataFrame(rows, "n_nationkey int, name string, id string, days int")


@query("""SELECT n_nationkey, 'mammo;ct' AS modalities, 'uncertainty' AS topics, lower(n_name) AS passed, CASE WHEN n_nationkey % 2 = 0 THEN '1995-01-01' ELSE '1995-03-01' END AS since, 'unknown value ''' || n_name || '''' AS error FROM nation""")
def vocabulary_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's words as canonical ids: unknown ones are errors, or pass in lower case."""
    rows = []
    for k, n in _nations(spark, sf_dir):
        try:
            alerts.topics_of(n)
            error = ""
        except alerts.AlertError as e:
            error = str(e)
        passed = alerts.lenient(n, {"vlm"}, alerts.MODALITY_SYNONYMS)
        rows.append((k, ";".join(alerts.modalities_of("breast, computed tomography; mammography")), ";".join(alerts.topics_of(["reliability"])), ";".join(passed), alerts.first_day("1995" if k % 2 == 0 else "1995-03"), error))
    return spark.createDataFrame(rows, "n_nationkey int, modalities string, topics string, passed string, since string, error string")


@query("SELECT n_nationkey, (n_nationkey / 100.0)::DOUBLE AS auto_add, 0.68::DOUBLE AS review, n_name AS high_priority FROM nation")
def settings_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings from configurations: what they say, and defaults elsewhere."""
    rows = []
    for k, n in _nations(spark, sf_dir):
        s = settings_of({"thresholds": {"auto_add": k / 100}, "high_priority_venues": [n]})
        rows.append((k, s.auto_add, s.review, s.high_priority_venues[0]))
    return spark.createDataFrame(rows, "n_nationkey int, auto_add double, review double, high_priority string")


@query("SELECT user_id, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the latest time of each user, from state of a stream's own; the last update of each."""
    events = flows.read_stream(spark, f"{sf_dir}/events.parquet", files_per_batch=1)
    out = scratch_path(spark, "state")
    flows.latest_state(flows.running_state(events), f"{out}/rows", f"{out}/checkpoint")
    rows = spark.read.schema("user_id long, n long, last_ts timestamp").parquet(f"{out}/rows/*")
    last = rows.groupBy("user_id").agg(F.max("n").alias("n"), F.max("last_ts").alias("last_ts"))
    return last.select("user_id", "n", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last"))


@query("SELECT DISTINCT user_id % 50 AS user_id FROM events")
def stream_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a stream that no earlier micro-batch had settled."""
    events = flows.read_stream(spark, f"{sf_dir}/events.parquet")
    keyed = events.select((F.col("user_id") % 50).cast("string").alias("seen_key"))
    out = scratch_path(spark, "seen")
    flows.seen_batches(keyed, f"{out}/out", f"{out}/checkpoint", F.lit(True))
    return spark.read.schema("seen_key string").parquet(f"{out}/out/rows").select(F.col("seen_key").cast("long").alias("user_id"))


@query("""SELECT strftime(s, '%Y-%m-%d') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY 1""")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by overlapping windows; the same plan runs on a stream."""
    found = flows.sliding(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "2 days", "1 day")
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "n")


@query("""SELECT c_custkey AS paper_id, CASE c_custkey % 3 WHEN 0 THEN 'relevant' ELSE 'reject' END AS verdict, CASE c_custkey % 3 WHEN 0 THEN '' ELSE 'off topic' END AS reason FROM customer WHERE c_custkey % 3 < 2""")
def judgements_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of a model from its landed answers: the last one of each row, broken ones left out."""
    k = F.col("c_custkey")
    first = F.when(k % 3 == 0, '{"decision": "accept"}').when(k % 3 == 1, '{"decision": "accept"}').otherwise("no JSON")
    later = F.when(k % 3 == 1, '{"decision": "reject", "reason": "off topic"}').otherwise('{"decision": "perhaps"}')
    c = table(spark, sf_dir, "customer")
    answers = c.select(k.alias("paper_id"), F.lit(1).alias("landed_at"), first.alias("body")).unionAll(c.select(k, F.lit(2), later))
    return judgements.verdicts(answers)


@query("""SELECT c_custkey AS paper_id, 'Title: ' || c_name || chr(10) || 'Venue: V (journal)' || chr(10) || 'Abstract: (no abstract)' AS prompt FROM customer WHERE c_acctbal >= 5000 ORDER BY c_acctbal DESC, c_custkey LIMIT 40""")
def judgements_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is asked about the rows nearest to the threshold, as many as a run may ask."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper_id"), F.col("c_name").alias("title"), F.lit("").alias("abstract"), F.lit("V").alias("venue"), F.lit("journal").alias("venue_type"), F.col("c_acctbal").alias("final_score"), F.when(F.col("c_acctbal") >= 5000, "review").otherwise("reject").alias("decision"))
    return judgements.requests(rows, 0.8, 40)
