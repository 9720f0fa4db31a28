"""Look-ups, configuration and the remaining operators."""

import json
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from scriptorium.functions.text import edit_distance
from scriptorium.operators import authors, enrich, graph, incremental, report
from scriptorium.plans.config import dotted, load_config, secret, settings_of
from scriptorium.plans.prompt import typo_candidates
from scriptorium.sources import landing, lookups
from scriptorium.streaming import flows


def test_points_and_edges(spark):
    p = spark.createDataFrame([("a", "10.1/x", "alpha beta gamma delta", ["s2:1"], "2024-01-01"), ("b", None, "alpha beta gamma delte", ["s2:2"], "2020-01-01")], "id string, doi string, title_key string, author_ids array<string>, publication_date string").withColumn("title", F.col("title_key"))
    asked = spark.createDataFrame([("b",), ("z",)], "id string")
    assert sorted((r.id, r.title) for r in lookups.batch(p, asked, "id").collect()) == [("b", "alpha beta gamma delte"), ("z", None)]
    assert [r.id for r in lookups.by_ids(p, asked, "id").collect()] == ["b"]
    assert lookups.first_found(p, doi="10.1/X", id="b").first().id == "a" and lookups.first_found(p, doi="none").count() == 0
    assert lookups.by_title(p, "alpha beta gamma delta").first().id == "a" and lookups.by_title(p, "other").count() == 0
    assert [r.id for r in lookups.by_author(p, ["s2:1", "s2:2"], start="2021-01-01").collect()] == ["a"]
    edges = spark.createDataFrame([("a", "c"), ("b", "c"), ("a", "b")], "src string, dst string")
    assert sorted(r.id for r in lookups.citing(p, edges, "c", "id").collect()) == ["a", "b"]
    assert [r.id for r in lookups.related(p, edges, p.where("id = 'a'"), "id").collect()] == ["b"]
    sources = spark.createDataFrame([("S1", "Radiology", 5), ("S2", "European Radiology", 9), ("S3", "Other", 99)], "id string, display_name string, works_count int")
    assert [r.id for r in lookups.venue_source_ids(sources, "radiology", 1).collect()] == ["S2"]
    names = spark.createDataFrame([("m-2.9",), ("m-2.10",), ("m-3-preview",), ("n-9",)], "name string")
    assert lookups.newest_model(names, "m").first().name == "m-2.10"


def test_documents_and_bibliographies(spark):
    page = lambda *rows: spark.createDataFrame(list(rows), "doc_id string, page string")
    got = {r.doc_id: r.source for r in lookups.preferred_document(page(("1", "x ltx_section"), ("2", "abstract only")), page(("2", "ltx_section"), ("3", "no")), page(("3", "<article/>"), ("4", None))).collect()}
    assert got == {"1": "arxiv_html", "2": "ar5iv", "3": "pmc"}
    entries = spark.createDataFrame([("d", f"bib{i}", f"a title of some length {i}") for i in range(4)] + [("d", "bib9", "short")], "doc_id string, bid string, title_key string")
    trusted = spark.createDataFrame([("d", "bib0", "Known")], "doc_id string, bid string, title string")
    found = spark.createDataFrame([("a title of some length 1", "Hit"), ("a title of some length 3", "Late")], "title_key string, title string")
    assert sorted((r.bid, r.title) for r in lookups.complete_bibliography(entries, trusted, found, most=2).collect()) == [("bib0", "Known"), ("bib1", "Hit")]


def test_published_version_and_guard(spark):
    pre = spark.createDataFrame([("p", "a robust method for things", 2023)], "paper_id string, title_key string, year int")
    hits = spark.createDataFrame([("p", 0, "h0", "other things", "journal", 2024), ("p", 1, "h1", "a robust method for things", "journal", 2022), ("p", 2, "h2", "a robust method for things", "conference", 2024), ("p", 3, "h3", "a robust method for things", "journal", 2024)], "paper_id string, place int, hit_id string, hit_key string, hit_type string, hit_year int")
    assert [r.published_id for r in enrich.published_version(pre, hits).collect()] == ["h2"]


def test_published_versions_compared_in_the_jvm_first(spark):
    """Only titles that few letters part are compared by their ratio, and equal ones are found without tokens."""
    title = "a robust method for the weaving of things part 2"
    pre = spark.createDataFrame([("p", title, 2023), ("q", "", 2023)], "paper_id string, title_key string, year int")
    hits = [("p", 0, "h0", "other things that are as long as the title is", "journal", 2024), ("p", 1, "h1", title.replace("2", "3"), "journal", 2024), ("p", 2, "h2", title.replace("things", "thing"), "journal", 2024), ("q", 0, "h3", "", "journal", 2024)]
    hits = spark.createDataFrame(hits, "paper_id string, place int, hit_id string, hit_key string, hit_type string, hit_year int")
    found = enrich.published_version(pre, hits)
    assert [(r.paper_id, r.published_id) for r in found.collect()] == [("p", "h2")]
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    compared = next(i for i, line in enumerate(lines) if "ArrowEvalPython" in line)
    assert any("levenshtein" in line for line in lines[compared:])


def test_watched_authors(spark):
    papers = spark.createDataFrame([("p1", ["s2:9"], ["J. Doe"], None), ("p2", ["s2:8"], ["Jane Doe"], None), ("p3", [], ["Jane Doe"], None), ("p4", [], ["J. Doe"], None)], "paper_id string, author_ids array<string>, authors array<string>, author_watch string")
    watched = spark.createDataFrame([(0, "Jane Doe", ["s2:9"])], "position int, name string, pinned array<string>")
    assert {r.paper_id: r.author_watch for r in authors.watch_authors(papers, watched).collect()} == {"p1": "Jane Doe", "p2": None, "p3": "Jane Doe", "p4": None}


def test_watched_authors_of_one_surname(spark):
    """Thousands who share a surname meet none but those of their whole name; papers and authors without ids are matched by name."""
    letters = F.translate(F.lpad(F.col("id").cast("string"), 5, "0"), "0123456789", "abcdefghij")
    papers = spark.range(4000).select(F.col("id").alias("paper_id"), F.lit(None).cast("array<string>").alias("author_ids"), F.array(F.concat(F.lit("D. Loom"), letters), F.concat(F.lit("Zo-"), letters, F.lit(" Mid Wéaver"))).alias("authors"), F.lit(None).cast("string").alias("author_watch"))
    watched = spark.range(0, 8000, 2).select(F.col("id").cast("int").alias("position"), F.concat(F.lit("Zo"), letters, F.lit(" Weaver")).alias("name"), F.lit(None).cast("array<string>").alias("pinned"))
    begin = time.time()
    got = {r.paper_id for r in authors.watch_authors(papers, watched).where("author_watch is not null").collect()}
    assert got == set(range(0, 4000, 2)) and time.time() - begin < 60


def test_paths(spark):
    nodes = spark.createDataFrame([("r", "Root", None, False), ("a", "A", "r", True), ("b", "B / C", "a", False), ("c", "C", "r", False)], "key string, name string, parentCollection string, deleted boolean")
    got = {r.key: (r.path, r.gone) for r in graph.with_paths(nodes).collect()}
    assert got == {"r": ("Root", False), "a": ("Root/A", True), "b": ("Root/A/B / C", True), "c": ("Root/C", False)}
    paths = spark.createDataFrame([("Root/X/CXR",), ("Other/X/CXR",), ("Root/Y",)], "path string")
    assert [r.path for r in graph.resolve_path(paths, "x/cxr", "Root").collect()] == ["Root/X/CXR"]
    assert graph.resolve_path(paths, "nothing", "Root").count() == 0 and graph.resolve_path(paths, "y", "Root").count() == 1


def test_typo_join_equals_brute_force(spark):
    tokens, words = ["calibraton", "chset", "robust", "visoin", "xyzzy"], ["calibration", "chest", "vision", "robustness"]
    t, w = spark.createDataFrame([(x,) for x in tokens], "token string"), spark.createDataFrame([(x,) for x in words], "word string")
    assert {(r.token, r.word) for r in typo_candidates(t, w).collect()} == {("calibraton", "calibration"), ("chset", "chest"), ("visoin", "vision")}
    assert t.select(edit_distance(F.col("token"), F.lit("chest")).alias("d")).collect()[1].d == 1


def test_configuration(tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text(json.dumps({"profile": "radiology", "thresholds": {"auto_add": 0.9}, "safety": {"max_auto_add_per_scan": 3}, "venue_weights": {"x": 1.0}}))
    config = load_config(tmp_path / "c.json")
    s = settings_of(config, [{"name": "A"}])
    assert (s.radiology, s.auto_add, s.review, s.max_auto_add, s.venue_weights, s.authors) == (True, 0.9, 0.68, 3, {"x": 1.0}, ({"name": "A"},))
    assert dotted(config, "thresholds.nothing", 5) == 5
    monkeypatch.setenv("SOME_KEY", " ")
    assert secret("SOME_KEY") is None


def test_alert_frames(spark):
    now = datetime(2025, 1, 1, 7)
    schema = "id string, action string, interval_days int, last_status string, last_run_at timestamp_ntz, last_success_at timestamp_ntz, last_dry_run_at timestamp_ntz, next_run_at timestamp_ntz"
    before = datetime(2024, 12, 1)
    a = spark.createDataFrame([("a", "add_by_threshold", 7, "ok", before, before, None, now), ("b", "report_only", 7, None, None, None, None, None)], schema)
    out = spark.createDataFrame([("a", True, 0, 0, False), ("b", False, 2, 0, False)], "id string, failed boolean, retrieved int, errors int, dry_run boolean")
    got = {r.id: r for r in incremental.after_run(a, out, now, True).collect()}
    assert (got["a"].last_status, got["a"].next_run_at, got["a"].last_success_at) == ("error", now + timedelta(days=1), before)
    assert (got["b"].last_status, got["b"].next_run_at, got["b"].last_success_at, got["b"].last_dry_run_at) == ("report-only", now + timedelta(days=7), None, now)
    edits = spark.createDataFrame([("a", 3, False)], "id string, interval_days int, changed_search boolean")
    assert {r.id: r.next_run_at for r in incremental.after_edit(a, edits, now).collect()}["a"] == before + timedelta(days=3)
    assert incremental.advances(True, True, before.date(), None) and not incremental.advances(True, True, now.date(), before.date())


def test_metrics_without_denominators(spark):
    none = spark.createDataFrame([], "label string, decision string")
    assert report.metrics(none).first().asDict() == {"n": 0, "precision_auto_add": None, "recall_review": None, "false_positive_rate": None}


def test_more_streams(spark, tmp_path):
    rows = [(i, i % 3, datetime(2024, 1, 1) + timedelta(minutes=i), 1.0) for i in range(12)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double").write.parquet(src)
    assert sum(r.n for r in flows.sliding(spark.read.parquet(src), "10 minutes", "5 minutes").collect()) == 24
    q = flows.running_state(flows.read_stream(spark, src)).writeStream.format("memory").queryName("state_out").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.user_id: r.n for r in spark.table("state_out").collect()} == {0: 4, 1: 4, 2: 4}


def test_landing_zone(spark):
    now = datetime(2025, 1, 10)
    key = landing.request_key(F.lit("get"), F.col("url"), F.col("p"))
    a, b = (r[0] for r in spark.createDataFrame([("http://x", {"q": "1", "api_key": "A"}), ("http://x", {"api_key": "B", "q": "1"})], "url string, p map<string,string>").select(key).collect())
    assert a == b
    rows = [("k1", "default", now - timedelta(hours=30), 200, "old"), ("k2", "lookup", now - timedelta(hours=30), 200, "fine"), ("k3", "default", now, 503, ""), ("k4", "default", now, 404, "")]
    zone = spark.createDataFrame(rows, "request_key string, kind string, fetched_at timestamp_ntz, status int, body string")
    asked = spark.createDataFrame([(f"k{i}",) for i in range(1, 6)], "request_key string")
    assert sorted(r.request_key for r in landing.needed(asked, zone, now).collect()) == ["k1", "k3", "k4", "k5"]
    assert {r.request_key: r.again for r in landing.failures(zone).collect()} == {"k3": True, "k4": False}


def test_library_reads(spark):
    rows = [("a", "book", False, None, ["C"]), ("b", "note", False, None, ["C"]), ("c", "book", True, None, ["C"]), ("d", "book", False, "a", ["C"]), ("e", "book", None, None, [])]
    items = spark.createDataFrame(rows, "key string, itemType string, deleted boolean, parentItem string, collections array<string>")
    assert sorted(r.key for r in incremental.live_items(items).collect()) == ["a", "e"]
    assert [r.key for r in incremental.items_of(items, "C").collect()] == ["a"]
    calls = spark.createDataFrame([("roles", 10, 2), ("roles", 5, 1)], "task string, input_tokens long, output_tokens long")
    assert report.usage(calls).first().asDict() == {"task": "roles", "calls": 2, "input_tokens": 15, "output_tokens": 3}
    assert graph.without_seed(spark.createDataFrame([("a",), ("b",)], "title_key string"), "a").count() == 1
