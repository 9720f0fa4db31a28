"""The engine: requests over landed sources, compiled into one plan and routed into a library."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import normalize_title
from scriptorium.operators import baselines, classify, decide, dedup, enrich, fulltext, graph, incremental, report, topk
from scriptorium.operators.authors import byline_guard, watch_authors
from scriptorium.operators.records import finalize
from scriptorium.plans.alerts import Alert, AlertStore
from scriptorium.plans.boolean import Query, cross_queries, scan_queries
from scriptorium.plans.prompt import parse, parse_alert_command
from scriptorium.schema import LIBRARY, PAPER, Request, Settings, conform
from scriptorium.session import settle
from scriptorium.sources import sinks
from scriptorium.sources.readers import scan_sources, union_sources


@dataclass
class Result:
    """What a run found: all rows with decision and route, lazily counted."""

    request: Request
    rows: DataFrame
    start: str | None = None
    end: str | None = None
    errors: DataFrame | None = None
    notes: list[str] = field(default_factory=list)

    def counters(self) -> dict:
        return report.run_counters(self.rows).first().asDict()

    def by_decision(self, decision: str) -> DataFrame:
        return report.by_decision(self.rows.where("route = 'candidate'"), decision)

    def existing(self) -> DataFrame:
        return self.rows.where("route = 'existing'")

    def upgrades(self) -> DataFrame:
        return self.rows.where("route = 'upgrade'")

    def markdown(self, title: str = "Run") -> str:
        return report.render(self.rows, title, tuple(self.notes))


@dataclass
class Engine:
    """Sources are functions that give frames of records (see sources.readers); the library is a frame of LIBRARY rows."""

    spark: SparkSession
    today: date
    settings: Settings = field(default_factory=Settings)
    sources: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    library: DataFrame | None = None
    edges: dict[str, DataFrame] = field(default_factory=dict)
    alerts: AlertStore | None = None

    def ask(self, prompt: str, least: float = 0.6) -> Result | dict:
        """Run what a prompt asks for; a command on saved searches is returned as parsed (1, 1')."""
        command = parse_alert_command(prompt)
        if command:
            return self.command(command)
        request, sure = parse(prompt, self.today, self.settings.profile)
        if sure < least:
            raise ValueError(f"not understood well enough ({sure:.2f}): {'; '.join(request.notes) or prompt}")
        return self.run(request)

    def command(self, command: dict) -> dict:
        """Carry out a command on saved searches."""
        store, now = self.alerts, datetime.combine(self.today, datetime.min.time())
        if store is None:
            raise ValueError("no store of saved searches")
        ref = command.get("ref")
        done = {
            "list": lambda: store.all(),
            "create": lambda: store.create(now, query=command["query"], profile=self.settings.profile),
            "pause": lambda: store.pause(ref, now),
            "resume": lambda: store.resume(ref, now),
            "delete": lambda: store.delete(ref),
            "update": lambda: store.change(ref, now, **({"interval_days": command["interval_days"]} if command.get("interval_days") else {})),
            "run": lambda: self.run_alert(store.find(ref), now, scheduled=False),
        }[command["op"]]()
        return command | {"result": done}

    def queries(self, request: Request) -> list[Query]:
        """The boolean queries that a request scans with."""
        if request.intent == "scan" and self.settings.radiology:
            return scan_queries()
        if request.free_text:
            return [Query.of(request.free_text, request.label or "query")]
        return cross_queries(request.modalities, request.topics) if request.topics or request.modalities else []

    def retrieve(self, request: Request) -> tuple[DataFrame, DataFrame]:
        """All sources' rows that a request's predicates leave, and the sources that failed."""
        title, text = F.col("title"), F.concat_ws(" ", "title", "abstract")
        wanted: Column | None = None
        for q in self.queries(request):
            wanted = q.matches(text) if wanted is None else wanted | q.matches(text)

        def narrow(raw: DataFrame) -> DataFrame:
            rows = conform(raw)
            if wanted is not None:
                rows = rows.where(wanted)
            if request.venues and request.intent == "venue_search":
                rows = rows.where(F.col("venue_key").isin(*request.venues))
            if request.author:
                ids = [i for i in (request.author_openalex_id and f"openalex:{request.author_openalex_id}", request.author_s2_id and f"s2:{request.author_s2_id}") if i]
                own = F.arrays_overlap("author_ids", F.array(*[F.lit(i) for i in ids])) if ids else F.lit(False)
                rows = rows.where(own | ((F.size("authors") > 0) & byline_guard(F.col("authors"), request.author)))
            return rows.where(~title.isNull())

        scan = scan_sources(self.spark, self.sources, narrow)
        return scan.rows, scan.errors

    def run(self, request: Request, start: str | None = None, end: str | None = None, raw: DataFrame | None = None, seen: DataFrame | None = None, verdicts: DataFrame | None = None) -> Result:
        """Scan, resolve, classify, score, decide, route and cap (entry A)."""
        s = self.settings
        if request.intent in ("similar", "citations", "related", "missing_lit") and raw is None:
            return self.expand(request) if request.intent != "missing_lit" else self.gaps(request)
        start = start or request.date_from or (self.today - timedelta(days=365 * s.first_run_years)).isoformat()
        end = end or request.date_to
        errors = None
        if raw is None:
            raw, errors = self.retrieve(request)
        ranked = enrich.merge_sources(finalize(raw).withColumn("paper_id", F.expr("sha1(concat_ws('|', source, doi, arxiv_id, pmid, openalex_id, semantic_scholar_id, title, year))")).dropDuplicates(["paper_id"]), "paper_id")
        if seen is not None:
            keyed = incremental.with_seen_keys(ranked.withColumn("title_key", normalize_title(F.col("title"))))
            ranked = incremental.unseen(keyed, seen, "paper_id").drop("seen_keys", "title_key")
        merged, _ = settle(dedup.dedupe(ranked, threshold=s.fuzzy), "merged")
        kept = conform(merged).withColumn("paper_id", F.expr("sha1(concat_ws('|', doi, arxiv_id, pmid, openalex_id, semantic_scholar_id, title, year))"))
        if s.authors:
            watched = self.spark.createDataFrame(
                [(i, a["name"], [x for x in (a.get("openalex_id") and f"openalex:{a['openalex_id']}", a.get("semantic_scholar_id") and f"s2:{a['semantic_scholar_id']}") if x]) for i, a in enumerate(s.authors)],
                "position int, name string, pinned array<string>",
            )
            kept = watch_authors(kept, watched)
        scored = decide.score(classify.classify(kept), s, request, self.today)
        counted = F.regexp_extract(F.coalesce(F.get(F.filter("queries", lambda q: q.startswith("cocitation:")), F.lit(0)), F.lit("")), r"(\d+)$", 1).try_cast("int")
        scored = decide.cocitation_bonus(scored.withColumn("cocitations", F.coalesce(counted, F.lit(0)))).drop("cocitations")
        decided = decide.apply_window(decide.decide(scored, s, request), start if raw is None or errors is not None else None, end)
        library = conform(self.library, LIBRARY) if self.library is not None else self.spark.createDataFrame([], LIBRARY)
        routed = dedup.route(dedup.match_library(decided, library, threshold=s.fuzzy), library)
        settled, _ = settle(routed, "routed")
        if verdicts is not None:
            settled = decide.adjudicate(settled, verdicts, "paper_id")
        candidates = topk.rate_limit(settled.where("route = 'candidate'"), s.max_auto_add)
        if request.limit:
            candidates = topk.request_limit(candidates, request.limit)
        rows = candidates.unionByName(settled.where("route <> 'candidate'"))
        rows = rows.withColumn("discovery_reason", decide.explain(rows))
        return Result(request, rows, start, end, errors, list(request.notes))

    def scan(self, last_success: date | None = None) -> Result:
        """A scheduled scan from the watermark on, with overlap."""
        s = self.settings
        start = incremental.scan_window(last_success, self.today, s.overlap_days, s.lookback_days, s.first_run_years)
        return self.run(Request(intent="scan", source_tag="auto-discovery", strict_request_match=False), start.isoformat())

    def search(self, text: str, **fields) -> Result:
        """Records on a subject, in words or boolean syntax."""
        return self.run(Request(free_text=text, **fields))

    def venue(self, *venues: str, **fields) -> Result:
        """Records of venues."""
        return self.run(Request(intent="venue_search", venues=venues, **fields))

    def author(self, name: str, **fields) -> Result:
        """An author's records."""
        return self.run(Request(intent="author_search", author=name, source_tag="author-watch", strict_request_match=bool(fields.get("topics") or fields.get("modalities")), **fields))

    def watch(self) -> list[Result]:
        """Records of every watched author, with the topics and modalities they are watched for."""
        return [self.author(a["name"], author_openalex_id=a.get("openalex_id"), author_s2_id=a.get("semantic_scholar_id"), topics=tuple(a.get("topics", ())), modalities=tuple(a.get("modalities", ()))) for a in self.settings.authors]

    def similar(self, seed: str) -> Result:
        return self.expand(Request(intent="similar", seed=seed), ("similar",))

    def citations(self, seed: str) -> Result:
        return self.expand(Request(intent="citations", seed=seed), ("reference",))

    def related(self, seed: str) -> Result:
        return self.expand(Request(intent="related", seed=seed))

    def save(self, result: Result, path: str) -> None:
        """The snapshot of what a run proposes."""
        sinks.save_proposals(result.rows.where("route = 'candidate'"), path)

    def proposals(self, path: str) -> DataFrame:
        """The last snapshot's rows."""
        return sinks.load_proposals(self.spark, path, "paper_id string, title string, decision string, reject_reason string, final_score double, doi string, arxiv_id string, venue string, year int")

    def check(self) -> dict:
        """What the engine can see: rows of each source (or why not), library rows, watched authors, due searches."""
        seen = {}
        for name, source in self.sources.items():
            try:
                seen[name] = source().count()
            except Exception as e:  # noqa: BLE001  told
                seen[name] = str(e).splitlines()[0]
        due = len(self.alerts.due(datetime.combine(self.today, datetime.min.time()))) if self.alerts else 0
        return {"sources": seen, "library": self.library.count() if self.library is not None else 0, "authors": len(self.settings.authors), "due": due, "profile": self.settings.profile}

    def add(self, **ids: str) -> Result:
        """Records with an identifier, which a user wants whatever their score."""
        fits = F.lit(False)
        for name, value in ids.items():
            fits = fits | (F.lower(F.col(name)) == value.lower())
        scan = scan_sources(self.spark, self.sources, lambda raw: finalize(conform(raw)).where(fits))
        result = self.run(Request(intent="add_doi", strict_request_match=False), raw=scan.rows)
        result.rows, result.errors = decide.manual_add(result.rows), scan.errors
        return result

    def expand(self, request: Request, kinds: tuple[str, ...] = ("reference", "citing", "similar")) -> Result:
        """Neighbours of a seed in the citation graph, with their relation to it."""
        raw, _ = union_sources(self.spark, self.sources)
        papers = conform(finalize(raw))
        seed = papers.where((F.lower("doi") == (request.seed or "").lower()) | (F.col("arxiv_id") == request.seed) | (F.lower("title") == (request.seed or "").lower())).limit(1)
        known = classify.classify(seed).first()
        if known is None:
            raise ValueError(f"could not resolve seed paper: {request.seed}")
        key = known["semantic_scholar_id"] or known["openalex_id"] or known["doi"]
        seeds = self.spark.createDataFrame([(key,)], "seed_id string")
        found = graph.expand(seeds, {k: e for k, e in self.edges.items() if k in kinds})
        own = F.coalesce("semantic_scholar_id", "openalex_id", "doi")
        near = papers.withColumn("node", own).join(found.select(F.col("paper_id").alias("node"), "relations"), "node").withColumn("relationship", F.get("relations", F.lit(0)))
        near = near.withColumn("queries", F.array_union("queries", F.array(F.concat(F.lit("graph:"), "relationship")))).drop("node", "relations")
        result = self.run(request.but(strict_request_match=bool(request.topics or request.modalities)), raw=near)
        label = graph.relationship(F.col("relationship"), F.col("year"), F.col("citation_count"), F.col("topics"), F.col("subtopics"), known["year"], tuple(known["topics"]))
        result.rows = result.rows.withColumn("relationship", label)
        return result

    def gaps(self, request: Request, members: DataFrame | None = None, least: int = 2) -> Result:
        """What a collection's members refer to and the library lacks (A01). members: (member), by the graph's ids."""
        if members is None or "reference" not in self.edges:
            raise ValueError("missing-literature analysis needs the members of a collection and reference edges")
        refs = self.edges["reference"].select(F.col("src").alias("member"), F.col("dst").alias("ref"))
        counted = graph.cocitations(members, refs, least)
        raw, _ = union_sources(self.spark, self.sources)
        papers = conform(finalize(raw)).withColumn("ref", F.coalesce("semantic_scholar_id", "openalex_id", "doi"))
        told = F.concat(F.lit("cocitation:"), F.col("citing").cast("string"))
        rows = papers.join(counted, "ref").withColumns({"queries": F.array_union("queries", F.array(told)), "relationship": F.concat(F.lit("cited by "), F.col("citing").cast("string"), F.lit(" papers"))}).drop("ref", "citing")
        return self.run(request.but(intent="missing_lit", strict_request_match=bool(request.topics or request.modalities)), raw=rows)

    def baselines(self, seed: dict, references: DataFrame, pages: DataFrame | None = None, verdicts: DataFrame | None = None) -> Result:
        """Which references a paper compares itself with (entry B).

        seed: year, topics, and the doc_id of its full text among pages (doc_id, page); without one the first page is it.
        references: records with ref_pos, contexts, intents and influential; of those with one title the first stands.
        """
        own = ("ref_pos", "contexts", "intents", "influential")
        if "ref_pos" not in references.columns:
            references = references.withColumn("ref_pos", F.monotonically_increasing_id())
        first = topk.best_per_group(references.withColumn("ref_key", normalize_title(F.col("title"))), "ref_key", F.col("ref_pos")).drop("place")
        papers = classify.classify(finalize(first.drop(*own, "ref_key")).withColumn("ref_key", normalize_title(F.col("title"))))
        rows = papers.join(first.select("ref_key", *own), "ref_key")
        none = "struct<experiments:bigint,tables:bigint,baseline_section:bigint,dataset_section:bigint,snippets:array<string>>"
        page = None
        if pages is not None:
            doc = seed.get("doc_id")
            page = pages.where(F.col("doc_id") == doc) if doc is not None else pages.orderBy("doc_id").limit(1)
        if page is None:
            rows = rows.withColumn("signals", F.lit(None).cast(none))
        else:
            docs = fulltext.documents(page.withColumn("doc_id", F.lit("seed")))
            bib = docs.select("doc_id", F.explode("document.bib").alias("b")).select("doc_id", "b.bid", normalize_title(F.col("b.entry")).alias("entry_key"), normalize_title(F.col("b.title")).alias("title_key"))
            refs = rows.select(F.lit("seed").alias("doc_id"), "ref_pos", F.col("ref_key").alias("ref_id"), "ref_key")
            mapped = fulltext.last_bibliography_id(fulltext.map_bibliography(bib, refs))
            signals = F.struct("experiments", "tables", "baseline_section", "dataset_section", "snippets").cast(none)
            found = fulltext.citation_signals(docs).join(mapped, ["doc_id", "bid"]).select(F.col("ref_id").alias("ref_key"), signals.alias("signals"))
            rows = rows.join(found, "ref_key", "left")
        scored = baselines.score_references(rows, seed.get("year"), tuple(seed.get("topics", ())))
        if verdicts is not None:
            roles = verdicts.withColumnRenamed("ref_id", "ref_key")
            scored = scored.join(roles.select("ref_key", "role", "quote"), "ref_key", "left")
            label, score = baselines.combine_roles(F.col("graph_evidence.label"), F.col("graph_evidence.score"), F.coalesce("role", F.lit("")), F.lit(True))
            scored = scored.withColumn("graph_evidence", F.col("graph_evidence").withField("label", label).withField("score", score).withField("evidence", F.coalesce("quote", "graph_evidence.evidence"))).drop("role", "quote")
        kept = scored.where(F.col("graph_evidence.label").isin("likely baseline", "possible baseline"))
        return self.run(Request(intent="baselines", strict_request_match=False), raw=conform(kept, PAPER))

    def run_alert(self, alert: Alert, now: datetime, scheduled: bool = True, seen: DataFrame | None = None, dry_run: bool = False) -> tuple[Alert, Result | None]:
        """Run a saved search and record its outcome; an exception is recorded, and told by a missing result."""
        start = alert.window_start(self.settings, now).isoformat()
        try:
            result = self.run(alert.request(), start, seen=seen if alert.last_success_at else None)
            outcome = result.counters() | {"window_from": start, "dry_run": dry_run, "errors": [r["message"] for r in result.errors.collect()] if result.errors is not None else []}
        except Exception as e:  # noqa: BLE001  one failing search must not stop the others
            if not scheduled:
                self.alerts.record(alert, now, scheduled, None, f"{type(e).__name__}: {e}")
                raise
            return self.alerts.record(alert, now, scheduled, None, f"{type(e).__name__}: {e}"), None
        return self.alerts.record(alert, now, scheduled, outcome), result

    def run_due(self, now: datetime, **options) -> list[tuple[Alert, Result | None]]:
        return [self.run_alert(a, now, **options) for a in self.alerts.due(now)]

    def evaluate(self, gold: DataFrame) -> DataFrame:
        """Quality of decisions on labelled records."""
        papers = finalize(gold.withColumn("source", F.lit("gold"))).withColumn("title_key", normalize_title(F.col("title")))
        decided = decide.decide(decide.score(classify.classify(papers), self.settings, Request(), self.today), self.settings, Request())
        labels = gold.select(normalize_title(F.regexp_replace("title", r"\.+$", "")).alias("title_key"), "label")
        return report.metrics(decided.join(labels, "title_key"))

    def plan_hierarchy(self, existing: DataFrame) -> DataFrame:
        """Levels of the library's layout that don't exist yet, in order."""
        wanted = self.spark.createDataFrame([(p,) for p in sinks.hierarchy(self.settings)], "path string")
        return graph.missing_levels(wanted, existing)

    def ingest(self, result: Result, path: str, source_tag: str = "manual-prompt", writes_enabled: bool = False) -> DataFrame:
        """Write what a run accepted or leaves to review, once."""
        rows = sinks.items(result.rows.where("route = 'candidate'"), self.settings, source_tag)
        rows = rows.withColumn("collections", sinks.destinations(self.settings, source_tag, result.request.label))
        return sinks.ingest(rows, path, writes_enabled=writes_enabled and result.request.action != "report_only")
