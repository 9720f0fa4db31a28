"""Shapes that grow with the data: long titles, titles that many records share, deep trees, and plans without rows by the square."""

import time

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import dedup, graph
from scriptorium.operators.components import connected_components


def records(spark, rows):
    return spark.createDataFrame(rows, "paper_id long, title_key string, ids map<string,string>")


def test_one_long_title_among_others(spark):
    """A title that holds its whole text meets only those of about its length."""
    body = " ".join(f"w{i % 97}" for i in range(6000))[:20_000]
    rows = [(1, body, {}), (2, body[:-1], {}), (3, "a short title of looms", {}), (4, "a short title of loom", {}), (5, body[:15_000], {})]
    begin = time.time()
    got = {(r.src, r.dst) for r in dedup.fuzzy_links(records(spark, rows), "paper_id").collect()}
    assert got == {(2, 1), (4, 3)} and time.time() - begin < 120


def test_pieces_of_every_length():
    """Each class has room for its pieces, and a title asks in few places."""
    for threshold in (0.7, 0.9, 0.96, 0.9999):
        classes = dedup.length_classes(threshold)
        assert all(width >= 1 and (edits + 1) * width <= low for low, _, edits, width in classes)
        assert all(edits + 1e-6 >= (1 - threshold) * 2 * high - 1 for _, high, edits, _ in classes)


def test_rows_of_similar_titles(spark):
    """Below 150 rows a title, whose pieces many share or not; a boilerplate beginning gives candidates in proportion."""
    letters = F.translate(F.concat(F.md5(F.col("id").cast("string")), F.md5((F.col("id") + 7).cast("string"))), "0123456789", "ghijklmnop")
    made = {}
    for n in (1_000, 4_000):
        titles = spark.range(n).select(F.col("id").alias("node"), F.concat(F.lit("proceedings of the yearly meeting"), letters).alias("title_key"))
        heads = titles.withColumns({"side": F.lit(None).cast("boolean"), "tokens": F.lit(""), "size": F.length("title_key")})
        _, as_long = dedup._lengths(spark, 0.96)
        assert dedup._asked(heads.join(as_long, "size"), "0").count() < 150 * n
        made[n] = dedup._piece_pairs(heads, 0.96).count()
    assert made[4_000] <= 6 * made[1_000] + 1_000


def test_common_pieces_lose_nothing(spark, monkeypatch):
    from random import Random

    from scriptorium.functions.text import title_ratio

    monkeypatch.setattr(dedup, "COMMON", 3)
    monkeypatch.setattr(dedup._piece_pairs, "__defaults__", (3,))
    rnd = Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(4, 9)))
    titles = {f"{begin} {' '.join(word() for _ in range(9))}" for begin in ("annual report of the society", "minutes of the board of the town") for _ in range(40)}
    for t in list(titles):
        for _ in range(2):
            for _ in range(rnd.randint(1, 3)):
                at = rnd.randrange(len(t))
                t = " ".join((t[:at] + rnd.choice(["", "x", t[at]]) + t[at + 1 :]).split())
            titles.add(t)
    rows = [(i, t, {}) for i, t in enumerate(sorted(titles))]
    got = {(r.src, r.dst) for r in dedup.fuzzy_links(records(spark, rows), "paper_id").collect()}
    want = {(a, b) for a, ta, _ in rows for b, tb, _ in rows if a > b and title_ratio(ta, tb) >= 0.96}
    assert got == want and len(want) > 60


def test_one_title_of_many_dois(spark):
    """Thousands of records of one title and different DOIs give a star, and those without a DOI join them all."""
    n = 50_000
    many = spark.range(n).select(F.col("id").alias("paper_id"), F.lit("editorial").alias("title_key"), F.create_map(F.lit("doi"), F.concat(F.lit("10.5555/"), F.col("id").cast("string"))).alias("ids"))
    assert dedup.title_links(many, "paper_id").count() == 0
    with_free = many.unionByName(records(spark, [(n, "editorial", {}), (n + 1, "editorial", {})]))
    links = dedup.title_links(with_free, "paper_id")
    assert links.count() <= n + 2
    found = connected_components(links)
    assert found.select("component").distinct().count() == 1 and found.count() == n + 2


@pytest.mark.parametrize("seed", range(4))
def test_title_links_join_what_all_pairs_join(spark, seed):
    from random import Random

    rnd = Random(seed)
    rows = []
    for i in range(60):
        ids = {}
        if rnd.random() < 0.6:
            ids["doi"] = f"10.5555/{rnd.randint(0, 4)}"
        if rnd.random() < 0.5:
            ids["arxiv_id"] = f"1901.0000{rnd.randint(0, 3)}"
        if rnd.random() < 0.1 and seed % 2:
            ids = {}
        rows.append((i, f"title {rnd.randint(0, 3)}", ids))

    def apart(a, b):
        return any(a.get(k) and b.get(k) and a[k] != b[k] for k in ("doi", "arxiv_id"))

    label = list(range(60))
    for _ in range(60):
        for i, t, a in rows:
            for j, u, b in rows:
                if t == u and not apart(a, b):
                    label[i] = label[j] = min(label[i], label[j])
    found = {r.node: r.component for r in connected_components(dedup.title_links(records(spark, rows), "paper_id")).collect()}
    assert {i: found.get(i, i) for i in range(60)} == dict(enumerate(label))


def test_deep_tree(spark):
    rows = [(f"k{i}", f"n{i}", f"k{i - 1}" if i else None, False) for i in range(60)] + [("loop", "x", "loop", False)]
    got = graph.with_paths(spark.createDataFrame(rows, "key string, name string, parentCollection string, deleted boolean"))
    assert got.count() == 60 and got.agg(F.max("level")).first()[0] == 59


def test_places_of_one_key(spark):
    """A key with nearly all rows is spread over all tasks, and every place is that of a sort."""
    from scriptorium.operators import ranks

    n = 200_000
    df = spark.range(n).select(F.when(F.col("id") % 1000 == 7, "small").when(F.col("id") % 1000 == 8, None).otherwise("big").alias("host"), F.xxhash64("id").alias("o"), F.lit("clash").alias("place0"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = df.repartitionByRange("host", "o").groupBy(F.spark_partition_id()).count().collect()
        assert len(dealt) == 4 and max(r["count"] for r in dealt) < n / 2
        got = ranks.places(df, "host", "o")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.columns == [*df.columns, "place"]
    by = got.groupBy("host").agg(F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high"), F.count_distinct("place").alias("places")).collect()
    assert all((r.low, r.high, r.places) == (0, r.n - 1, r.n) for r in by) and len(by) == 3
    some = got.where("host = 'small'").orderBy("place").select("o").collect()
    assert [r.o for r in some] == sorted(r.o for r in some)


def test_large_cluster_merges_in_the_size_of_its_result(spark):
    """100,000 records of one work leave lists of its distinct values, and no plan gathers a list of each record."""
    from scriptorium.schema import PAPER, conform

    n = 100_000
    rows = spark.range(n).select(F.lit("A work").alias("title"), F.array(F.concat(F.lit("r"), F.col("id") % 3), F.lit("r0")).alias("references"), F.create_map(F.concat(F.lit("k"), F.col("id") % 2), F.col("id").cast("string")).alias("pdf_candidates"), F.array(F.lit("one")).alias("sources"), F.col("id"))
    papers = conform(rows, PAPER).withColumns({"paper_id": F.monotonically_increasing_id(), "cluster": F.lit(0), "source_rank": F.lit(1), "graph_evidence": F.lit(None).cast("struct<score:double,label:string,evidence:string>")})
    merged = dedup.merge_clusters(papers)
    r = merged.first()
    assert (r.n_records, r.references, r.sources, sorted(r.pdf_candidates), r.queries) == (n, ["r0", "r1", "r2"], ["one"], ["k0", "k1"], [])
    assert r.pdf_candidates["k0"] == "0"


def test_library_matches_of_large_keys(spark, tmp_path):
    """Identifiers made of keys beyond a million stay apart."""
    from scriptorium import catalogue

    spark.createDataFrame([(k,) for k in (2, 8, 100_000, 100_001, 1_000_000, 1_000_002, 1_000_006, 7_000_003, 12_345_678)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.paper_id: (r.library_key, r.match_method) for r in catalogue.queries()["id_cascade_match"](spark, str(tmp_path)).collect()}
    told = lambda k: (f"d{k}", "doi") if k % 3 == 0 else (f"m{k}", "pmid") if k % 3 == 1 else (f"t{k}", "title") if k % 6 == 2 else (None, None)
    assert got == {k: told(k) for k in got} and len(got) == 9


def test_saved_searches_numbered_by_ranges(spark):
    """Their order is found by ranges: no task sorts all of them, and ties of the first keys go by the last."""
    from scriptorium.operators import incremental

    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "active").otherwise("paused").alias("status"), F.when(F.col("id") % 5 > 0, F.timestamp_seconds(F.col("id") % 7)).alias("next_run_at"), F.lpad(F.col("id").cast("string"), 5, "0").alias("name"))
    placed = incremental.alert_places(df)
    rows = placed.collect()
    key = lambda r: (r.status != "active", r.next_run_at is not None, r.next_run_at.timestamp() if r.next_run_at else 0, r.name)
    assert [r.name for r in sorted(rows, key=lambda r: r.place)] == [r.name for r in sorted(rows, key=key)] and sorted(r.place for r in rows) == list(range(1, 5001))


@pytest.mark.parametrize("name, queries", [("paged_scan", 1), ("paged_limit", 3)])
def test_landed_pages_are_bounded(spark, tmp_path, monkeypatch, name, queries):
    """A page holds the orders of so many keys and no more, and there are no more pages than that takes."""
    from scriptorium import catalogue
    from scriptorium.plans import runs
    from scriptorium.sources.paged import landed

    made, path = [], runs.scratch_path
    monkeypatch.setattr(runs, "scratch_path", lambda *given: made.append(path(*given)) or made[-1])
    keys = spark.range(0, 300_000, 30).select(F.col("id").alias("o_orderkey"), (F.col("id") / 30).cast("long").alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.lit("p").alias("o_orderpriority"))
    keys.write.parquet(f"{tmp_path}/orders.parquet")
    got = catalogue.queries()[name](spark, str(tmp_path)).collect()
    assert len(got) == (10_000 - 34 if name == "paged_scan" else 1200)
    pages = [p for folder in made for paths in landed(folder).values() for p in paths if p.endswith(".json")]
    assert len(pages) == queries * 6
    spans = spark.read.json(pages).select(F.array_max("results.o_orderkey") - F.array_min("results.o_orderkey")).collect()
    assert max(r[0] for r in spans) < 50_000


def test_merge_is_dealt_by_rows(spark, monkeypatch):
    """Versions are merged by tasks in proportion to their number, whatever the session's partitions are."""
    from scriptorium import catalogue, session

    monkeypatch.setattr(session, "ROWS_A_TASK", 500)
    sf, before = "/root/testdata/sf0.001", spark.conf.get("spark.sql.shuffle.partitions")
    found = catalogue.queries()["merge_best_version"](spark, sf)
    assert len(found.inputFiles()) == -(-session.table(spark, sf, "lineitem").count() // 500) > int(before)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_merged_doi_and_abstract(spark):
    """A publisher's DOI before a better version's of a preprint server; the longest abstract, a blank one if there is no other."""
    from scriptorium.schema import PAPER, conform

    said = [(1, "journal", "10.1101/a", "", "9"), (1, "preprint", "10.5555/b", None, "8"), (2, "journal", None, "", None), (2, "preprint", "10.1101/c", "long", "7"), (3, "journal", "", None, None), (3, "preprint", None, "", "6")]
    given = spark.createDataFrame([(str(c), *r, str(i)) for i, (c, *r) in enumerate(said)], "issue string, venue_type string, doi string, abstract string, volume string, pages string")
    keyed = conform(given, PAPER).withColumns({"venue_key": F.lit("v"), "cluster": F.col("issue").cast("long"), "paper_id": F.col("pages").cast("long"), "source_rank": F.lit(1)})
    got = {r.cluster: (r.doi, r.abstract, r.volume) for r in dedup.merge_clusters(keyed).collect()}
    assert got == {1: ("10.5555/b", "", "9"), 2: ("10.1101/c", "long", None), 3: (None, None, None)}


def test_similar_titles_ask_python_once(spark):
    """One worker a task compares titles, and the table of lengths starts none (F16)."""
    rows = [(i, f"a tale of looms and of threads {'abcdef'[i % 6] * 3}{' x' * (i // 6)}", {}) for i in range(12)]
    plan = dedup.fuzzy_links(records(spark, rows), "paper_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    for lengths in dedup._lengths(spark, 0.96):
        assert "PythonRDD" not in lengths._jdf.queryExecution().toRdd().toDebugString()


def test_likeness_of_titles_within_titles(spark):
    """What follows from lengths alone is the ratio itself, at the gates and where letters are passed over, too."""
    from random import Random

    from scriptorium.functions.text import title_likeness, title_ratio

    rnd, rows = Random(5), [("", ""), ("", "a"), (None, "a"), ("abc", "abc")]
    for n in (3, 20, 34, 100, 180, 198, 199, 200, 230):
        text = "".join(rnd.choice("abcde ") for _ in range(n))
        for cut in (0, 1, 2, n // 7, n // 6, n // 5):
            rows += [(text, text[cut:]), (text[: n - cut], text), (text[cut // 2 : n - cut], text), (text, text[: n // 2] + "é" + text[n // 2 + 1 :])]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", title_likeness(F.col("a"), F.col("b")).alias("s")).collect()
    assert len(got) == len(rows) and all(r.s == title_ratio(r.a, r.b) for r in got)


def test_first_run_of_a_forest_looks_nothing_up(spark, tmp_path, monkeypatch):
    """With no earlier records, a run makes its trees only."""
    from scriptorium.operators import forest

    monkeypatch.setattr(forest.Forest, "_met", None)
    rows = spark.createDataFrame([(1, "10.5555/a", "one tale of looms"), (2, "10.5555/a", "another name"), (3, None, "a third text")], "paper_id long, doi string, title string")
    from scriptorium.schema import PAPER, conform

    kept = forest.Forest(spark, str(tmp_path / "forest"), buckets=2)
    kept.add(conform(rows.withColumn("issue", F.col("paper_id").cast("string")), PAPER).withColumn("paper_id", F.col("issue").cast("long")), 0)
    assert {r.paper_id: r.cluster for r in kept.clusters().collect()} == {1: 1, 2: 1, 3: 3}


def test_threshold_that_lets_no_letter_differ(spark):
    """There are no classes of lengths then: short titles have no similar one, long ones are still met by length (F1)."""
    assert [(df.columns[:4], df.count()) for df in dedup._lengths(spark, 0.9999)] == [(["size", "c", "edits", "width"], 0)] * 2
    body = " ".join(f"w{i % 97}" for i in range(6000))[:20_000]
    rows = records(spark, [(1, body, {}), (2, body[:-1], {}), (3, "a short title of looms", {}), (4, "a short title of loom", {"doi": "10.5555/a"}), (5, "another", {"doi": "10.5555/a"})])
    assert [(r.src, r.dst) for r in dedup.fuzzy_links(rows, "paper_id", 0.9999).collect()] == [(2, 1)]
    assert sorted((r.src, r.dst) for r in dedup.all_links(rows, "paper_id", 0.9999).collect()) == [(2, 1), (5, 4)]
    assert {r.kind for r in dedup.anchors(rows, "paper_id", 0.9999).collect()} == {"same", "long", "about"}


def test_clusters_of_customers_go_by_their_keys(spark, tmp_path):
    """Names that are missing or alike, and large balances, join nothing (F1)."""
    from scriptorium import catalogue

    rows = [(0, "Customer#1", 1, 700.0), (3, "Customer#1", 1, 990.0), (4, "Customer#1", 1, 12_345_678.0), (8, None, 1, 12_345_789.0), (9, None, 1, None), (12, "", 1, 800.0), (16, "Customer#1", 2, 850.0), (10**12 + 8, "Customer#1", 2, 899.0), (None, "Customer#1", 2, 1.0)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.paper_id: r.cluster for r in catalogue.queries()["dedup_exact_clusters"](spark, str(tmp_path)).collect()}
    assert got == {k: 0 if k in (0, 3, 12, 16, 10**12 + 8) else k for k, *_ in rows}


def test_library_match_where_no_letter_may_differ(spark, tmp_path, monkeypatch):
    """Records without a match are kept as they are, nothing is cut into pieces, and keys of either sign stay apart (F2)."""
    from scriptorium import catalogue

    monkeypatch.setattr(dedup, "_piece_pairs", None)
    keys = [(k,) for k in (5, 8, 11, 2, -2, -3, -8, 0, 1, None)]
    spark.createDataFrame(keys, "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.paper_id: (r.library_key, r.match_method) for r in catalogue.queries()["id_cascade_match"](spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys((5, 11, -2, -8, None), (None, None)) | {8: ("t8", "title"), 2: ("t2", "title"), -3: ("d-3", "doi"), 0: ("d0", "doi"), 1: ("m1", "pmid")}


def test_shortest_similar_titles(spark):
    """Titles of the least length that lets a letter differ are still compared, and shorter ones have no similar title."""
    from scriptorium.functions.text import title_ratio

    letters = "abcdefghijklmnopqrstuvwxyz" * 2
    for threshold in (0.96, 0.98):
        n = dedup.least_length(threshold)
        short, fits = letters[: n - 1], letters[:n]
        assert title_ratio(short, short + "-") < threshold <= title_ratio(fits, fits + "-")
        got = dedup.fuzzy_links(records(spark, [(1, fits, {}), (2, fits + "-", {}), (3, short[::-1], {}), (4, short[::-1][1:], {})]), "paper_id", threshold).collect()
        assert [(r.src, r.dst) for r in got] == [(2, 1)]
