"""python -m scriptorium COMMAND ...: searches, look-ups and saved searches over landed answers of sources.

python -m scriptorium ask "papers on looms since 2020" --source openalex=DIR, or with a command of its own:
python -m scriptorium search --query looms --since 2020 --source openalex=DIR --out DIR --write
"""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict
from datetime import date, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from scriptorium.api import Engine, Result
from scriptorium.functions.dates import interval_days
from scriptorium.operators.records import library_records
from scriptorium.plans import alerts as saved
from scriptorium.plans.config import load_config, settings_of
from scriptorium.schema import Request, Settings
from scriptorium.sources import readers

_JSON = {"openalex": (readers.openalex, readers.OPENALEX), "semantic_scholar": (readers.semantic_scholar, readers.SEMANTIC_SCHOLAR), "crossref": (readers.crossref, readers.CROSSREF)}
_TEXT = {"pubmed": readers.pubmed, "arxiv": readers.arxiv}
_ITEMS = "key string, itemType string, title string, DOI string, extra string, url string, archiveID string, date string, deleted boolean"
_GOLD = "doi string, arxiv_id string, pmid string, title string, abstract string, venue string, venue_type string, year int, authors array<string>, citation_count int, label string"
_REFERENCES = "title string, abstract string, doi string, arxiv_id string, year int, authors array<string>, venue string, ref_pos int, contexts array<string>, intents array<string>, influential boolean"


def source(spark: SparkSession, kind: str, path: str):
    """A function that reads a source's landed answers."""
    if kind in _JSON:
        mapper, schema = _JSON[kind]
        return lambda: mapper(readers.landing(spark, path, schema), kind) if kind != "crossref" else mapper(readers.landing(spark, path, schema))
    if kind in _TEXT:
        return lambda: _TEXT[kind](spark.read.text(path, wholetext=True))
    raise SystemExit(f"no such source: {kind} (known: {', '.join([*_JSON, *_TEXT])})")


def _pairs(values: list[str]) -> list[tuple[str, str]]:
    return [(kind, path) for kind, _, path in (v.partition("=") for v in values)]


def engine_of(given: argparse.Namespace) -> Engine:
    """The engine that the common options describe."""
    spark = SparkSession.builder.getOrCreate()
    config = load_config(given.config) if given.config else {}
    watched = load_config(given.authors) if given.authors else {}
    settings = settings_of(config, watched.get("authors") if isinstance(watched, dict) else watched)
    if given.profile:
        settings = Settings(**{**settings.__dict__, "profile": given.profile})
    library = library_records(spark.read.schema(_ITEMS).json(given.library)) if given.library else None
    edges = {kind: spark.read.parquet(path) for kind, path in _pairs(given.edges)}
    sources = {kind: source(spark, kind, path) for kind, path in _pairs(given.source)}
    store = saved.AlertStore(given.alerts) if given.alerts else None
    return Engine(spark, given.today or date.today(), settings, sources, library, edges, store)


def _request(given: argparse.Namespace, **fields) -> dict:
    """Fields of a request that searches share."""
    wanted = {"topics": tuple(saved.lenient(given.topic, set(saved.TOPIC_TERMS), saved.TOPIC_SYNONYMS)), "modalities": tuple(saved.lenient(given.modality, set(saved.MODALITY_TERMS), saved.MODALITY_SYNONYMS))}
    return wanted | {"date_from": saved.first_day(given.since), "limit": given.limit, "action": "report_only" if given.report_only else "add_by_threshold"} | fields


def _scan(engine: Engine, given: argparse.Namespace) -> Result | str:
    """A scan from the last success on, which the state file keeps; --if-due ends at once before the interval has passed."""
    state = Path(given.state) if given.state else None
    kept = json.loads(state.read_text()) if state and state.exists() else {}
    last = date.fromisoformat(kept["last_success"]) if kept.get("last_success") else None
    if given.if_due and last and (engine.today - last).days < given.interval:
        return f"not due: last scan {last.isoformat()}"
    if given.days:
        start = (engine.today - timedelta(days=given.days)).isoformat()
        return engine.run(Request(intent="scan", source_tag="auto-discovery", strict_request_match=False), start)
    result = engine.scan(last)
    if state and given.write:
        state.write_text(json.dumps({"last_success": engine.today.isoformat()}))
    return result


def _venue(engine: Engine, given: argparse.Namespace) -> Result:
    venues = tuple(saved.lenient(given.venue, set(), saved.VENUE_SYNONYMS))
    fields = _request(given, free_text=given.query)
    if given.year:
        fields |= {"date_from": f"{given.year}-01-01", "date_to": f"{given.year}-12-31"}
    return engine.venue(*venues, **fields)


def _baselines(engine: Engine, given: argparse.Namespace) -> Result:
    references = engine.spark.read.schema(_REFERENCES).json(given.references)
    pages = engine.spark.read.parquet(given.pages) if given.pages else None
    return engine.baselines({"year": given.year, "doc_id": given.doc_id}, references, pages)


def _gaps(engine: Engine, given: argparse.Namespace) -> Result:
    return engine.gaps(Request(intent="missing_lit", collection=given.collection), engine.spark.read.parquet(given.members), given.min_cocitations)


def _alert(engine: Engine, given: argparse.Namespace):
    """A command on saved searches."""
    store, now = engine.alerts, datetime.combine(engine.today, datetime.min.time())
    if store is None:
        raise SystemExit("--alerts names the file of saved searches")
    fields = {"topics": given.topic, "modalities": given.modality, "venues": given.venue, "author": given.author, "author_openalex_id": None, "free_text": given.text, "since": saved.first_day(given.since), "limit": given.limit}
    fields = {k: v for k, v in fields.items() if v}
    if given.top_venues:
        fields["top_venues_only"] = True
    if given.report_only or given.add:
        fields["action"] = "report_only" if given.report_only else "add_by_threshold"
    if given.every:
        fields["interval_days"] = interval_days(given.every)
    canonical = {"topics": saved.topics_of, "modalities": saved.modalities_of, "venues": saved.venues_of}
    fields = {k: tuple(canonical[k](v)) if k in canonical else v for k, v in fields.items()}
    if given.name and given.do in ("create", "edit"):
        fields["name"] = given.name
    listed = lambda: [a for a in store.all() if not given.status or a.status == given.status]
    return {
        "create": lambda: store.create(now, engine.today, engine.settings.profile, **fields, **({"query": given.query} if given.query else {}), **({"status": "paused"} if given.paused else {})),
        "list": lambda: sorted(listed(), key=lambda a: (a.status != "active", a.next_run_at or "", a.name.lower())),
        "show": lambda: store.find(given.ref),
        "edit": lambda: store.change(given.ref, now, **fields, **({"author": None} if given.clear_author else {}), **({"since": None} if given.clear_since else {})),
        "pause": lambda: store.pause(given.ref, now),
        "resume": lambda: store.resume(given.ref, now),
        "delete": lambda: store.delete(given.ref),
        "run": lambda: engine.run_alert(store.find(given.ref), now, scheduled=False, dry_run=not given.write)[1],
        "run-due": lambda: [f"{a.id}: {a.last_status}" for a, _ in engine.run_due(now, dry_run=not given.write)],
    }[given.do]()


def _add(engine: Engine, given: argparse.Namespace) -> Result:
    ids = {"doi": given.doi, "arxiv_id": given.arxiv, "pmid": given.pmid, "title": given.title}
    return engine.add(**{k: v for k, v in ids.items() if v})


def _report(frame: DataFrame) -> str:
    return "\n".join("\t".join("" if v is None else str(v) for v in row) for row in frame.collect())


#: What each command does with the engine and the options.
COMMANDS = {
    "ask": lambda e, g: e.ask(" ".join(g.prompt)),
    "scan": _scan,
    "search": lambda e, g: e.search(" ".join(filter(None, (g.query, g.text))), **_request(g, venues=tuple(saved.lenient(g.venue, set(), saved.VENUE_SYNONYMS)), top_venues_only=g.top_venues)),
    "venue": _venue,
    "author": lambda e, g: e.author(g.name, **_request(g, author_openalex_id=g.openalex_id, author_s2_id=g.s2_id, free_text=g.query)),
    "watch": lambda e, g: e.watch(),
    "add": _add,
    "similar": lambda e, g: e.similar(g.seed),
    "citations": lambda e, g: e.citations(g.seed),
    "related": lambda e, g: e.related(g.seed),
    "baselines": _baselines,
    "gaps": _gaps,
    "alerts": _alert,
    "review": lambda e, g: _report(e.proposals(g.proposals).where("decision = 'review'").select("title", "final_score", "reject_reason")),
    "check": lambda e, g: e.check(),
    "init-collections": lambda e, g: _report(e.plan_hierarchy(e.spark.createDataFrame([(p,) for p in g.existing], "path string")).select("path")),
    "evaluate": lambda e, g: e.evaluate(readers.gold_rows(e.spark, g.gold, _GOLD)).first().asDict(),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="scriptorium", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--source", action="append", default=[], metavar="KIND=PATH", help="landed answers of a source")
    common.add_argument("--edges", action="append", default=[], metavar="KIND=PATH", help="(src, dst) of a citation graph: reference, citing, similar")
    common.add_argument("--library", help="JSON items of the library")
    common.add_argument("--config", help="configuration, JSON or YAML")
    common.add_argument("--authors", help="watched authors, JSON or YAML")
    common.add_argument("--alerts", help="file of saved searches")
    common.add_argument("--profile", choices=("general", "radiology"))
    common.add_argument("--out", help="folder to write proposals, items and audit lines to")
    common.add_argument("--write", action="store_true", help="write items too, not only proposals")
    common.add_argument("--today", type=date.fromisoformat, default=None)
    search = argparse.ArgumentParser(add_help=False)
    search.add_argument("--query", "-q")
    search.add_argument("--topic", action="append", default=[])
    search.add_argument("--modality", action="append", default=[])
    search.add_argument("--venue", action="append", default=[])
    search.add_argument("--since")
    search.add_argument("--limit", type=int)
    search.add_argument("--text")
    search.add_argument("--top-venues", action="store_true")
    search.add_argument("--report-only", action="store_true")
    commands = out.add_subparsers(dest="command", required=True)
    add = lambda name, *more: commands.add_parser(name, parents=[common, *more])
    add("ask").add_argument("prompt", nargs="+")
    scan = add("scan")
    scan.add_argument("--days", type=int)
    scan.add_argument("--if-due", action="store_true")
    scan.add_argument("--interval", type=int, default=10)
    scan.add_argument("--state", help="file that keeps the last success")
    add("search", search)
    add("venue", search).add_argument("--year", type=int)
    author = add("author", search)
    author.add_argument("--name", required=True)
    author.add_argument("--openalex-id")
    author.add_argument("--s2-id")
    add("watch")
    one = add("add")
    for name in ("--doi", "--arxiv", "--pmid", "--title"):
        one.add_argument(name)
    for name in ("similar", "citations", "related"):
        add(name).add_argument("--seed", required=True)
    compared = add("baselines")
    compared.add_argument("--references", required=True, help="JSON records with ref_pos, contexts, intents and influential")
    compared.add_argument("--pages", help="(doc_id, page) of full texts")
    compared.add_argument("--doc-id")
    compared.add_argument("--year", type=int)
    gaps = add("gaps")
    gaps.add_argument("--collection", required=True)
    gaps.add_argument("--members", required=True, help="(member) of the collection, by the graph's ids")
    gaps.add_argument("--min-cocitations", type=int, default=2)
    alert = add("alerts", search)
    alert.add_argument("do", choices=("create", "list", "show", "edit", "pause", "resume", "delete", "run", "run-due"))
    alert.add_argument("ref", nargs="?")
    for name in ("--name", "--author", "--every", "--status"):
        alert.add_argument(name)
    for name in ("--add", "--paused", "--clear-author", "--clear-since"):
        alert.add_argument(name, action="store_true")
    add("review").add_argument("--proposals", required=True)
    add("check")
    add("init-collections").add_argument("--existing", action="append", default=[])
    add("evaluate").add_argument("--gold", required=True)
    return out


def _told(found) -> str:
    if isinstance(found, list):
        return "\n".join(map(_told, found))
    if isinstance(found, saved.Alert):
        return json.dumps({k: v for k, v in asdict(found).items() if v not in (None, "", (), [], {})})
    return str(found)


def main(args: list[str] | None = None) -> None:
    given = parser().parse_args(args)
    engine = engine_of(given)
    found = COMMANDS[given.command](engine, given)
    for result in found if isinstance(found, list) and found and isinstance(found[0], Result) else [found]:
        if not isinstance(result, Result):
            print(_told(result))
            continue
        print(result.markdown(given.command))
        if given.out:
            engine.save(result, f"{given.out}/proposals")
            planned = engine.ingest(result, given.out, result.request.source_tag, given.write)
            print(f"{planned.count()} items {'written' if given.write else 'planned'}")


if __name__ == "__main__":
    main()
