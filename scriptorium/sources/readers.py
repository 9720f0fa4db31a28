"""Sources: JSON, XML and HTML landings of seven catalogues, mapped to records; other inputs.

Each source lands its responses as files; a mapper is one projection from their schema to records, so scans, filters and
column pruning are Spark's own, XML included. No mapper calls a network. XML that can't be parsed gives no records, and a row
of unreadable() that tells it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions.text import blank, filled, normalize_arxiv_id, strip_markup
from scriptorium.functions.venues import canonical_venue
from scriptorium.operators.classify import looks_radiological
from scriptorium.operators.records import finalize
from scriptorium.session import scratch_path, shared_dir, shuffle_files_dropped

#: The fields of each source's responses that its mapper reads.
OPENALEX = (
    "id string, title string, display_name string, doi string, type string, publication_year int, publication_date string, cited_by_count int, "
    "ids struct<pmid:string>, abstract_inverted_index map<string,array<int>>, referenced_works array<string>, "
    "biblio struct<volume:string,issue:string,first_page:string,last_page:string>, "
    "primary_location struct<landing_page_url:string,source:struct<display_name:string,type:string,issn_l:string>>, best_oa_location struct<pdf_url:string>, "
    "locations array<struct<landing_page_url:string,pdf_url:string,is_oa:boolean,source:struct<display_name:string>>>, "
    "authorships array<struct<author:struct<id:string,display_name:string>>>"
)
SEMANTIC_SCHOLAR = (
    "paperId string, title string, abstract string, year int, publicationDate string, venue string, url string, citationCount int, publicationTypes array<string>, "
    "externalIds struct<DOI:string,ArXiv:string,PubMed:string,PubMedCentral:string>, publicationVenue struct<name:string,type:string>, "
    "journal struct<name:string,volume:string,pages:string>, openAccessPdf struct<url:string>, authors array<struct<authorId:string,name:string>>"
)
_PARTS = "struct<`date-parts`:array<array<int>>>"
CROSSREF = (
    f"DOI string, URL string, type string, subtype string, title array<string>, `container-title` array<string>, abstract string, volume string, issue string, page string, publisher string, "
    f"ISSN array<string>, `is-referenced-by-count` int, author array<struct<given:string,family:string,name:string>>, event struct<name:string>, assertion array<struct<name:string,value:string>>, "
    f"issued {_PARTS}, `published-online` {_PARTS}, `published-print` {_PARTS}, created {_PARTS}"
)
OPENREVIEW = "id string, forum string, content map<string,string>"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
EXCLUDED_PUBMED = ("Editorial", "Comment", "Letter", "Published Erratum", "Retraction of Publication", "Retracted Publication", "News")
CROSSREF_HINTS = {"journal-article": "journal", "proceedings-article": "conference", "book-chapter": "book-series", "posted-content": "preprint"}


def landing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON responses as they landed; fields that a response lacks are null."""
    return spark.read.schema(schema).json(path)


def _last(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def _pdfs(**kinds: Column) -> Column:
    pairs = [F.when(~blank(url), F.struct(F.lit(kind).alias("key"), url.alias("value"))) for kind, url in kinds.items()]
    return F.map_from_entries(F.array_compact(F.array(*pairs)))


def _first(array: Column, fits: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(array, fits), F.lit(0))


# Arrow UDFs, not higher-order functions, where the text is cleaned by another UDF later: Spark can't tell that two copies of
# a UDF are the same one if lambda variables stand in their arguments.
@F.pandas_udf(T.StringType())
def _rebuilt(inverted: pd.Series) -> pd.Series:
    def one(words) -> str:
        pairs = words.items() if isinstance(words, dict) else words if words is not None else ()
        return " ".join(w for _, w in sorted((at, w) for w, places in pairs for at in (places if places is not None else ())))

    return inverted.map(one)


@F.pandas_udf(T.StringType())
def _container(titles: pd.Series) -> pd.Series:
    def one(found) -> str | None:
        named = [t for t in (found if found is not None else ()) if t]
        own = [t for t in named if not t.lower().startswith(("lecture notes", "communications in computer", "proceedings of spie"))]
        return (own or named or [None])[0]

    return titles.map(one)


@F.pandas_udf(T.StringType())
def _conference(assertions: pd.Series) -> pd.Series:
    return assertions.map(lambda found: next((a["value"] for a in (found if found is not None else ()) if a["name"] == "conference_name"), None))


def openalex(raw: DataFrame, label: str = "") -> DataFrame:
    """Records of OpenAlex works."""
    source = F.col("primary_location.source")
    venue = canonical_venue(source["display_name"], source["type"])
    preprint = (F.lower("type") == "preprint") & ~venue["type"].isin("journal", "conference")
    where = lambda l: F.lower(F.coalesce(l["source"]["display_name"], F.lit("")))
    free = F.filter("locations", lambda l: F.coalesce(l["is_oa"], F.lit(False)) & ~blank(l["pdf_url"]))
    central = lambda l: where(l).contains("pubmed central") | where(l).contains("europe pmc")
    linked = lambda l: F.concat_ws(" ", l["landing_page_url"], l["pdf_url"])
    best = F.col("best_oa_location.pdf_url")
    official = F.coalesce(_first(free, lambda l: ~central(l) & ~where(l).contains("arxiv"))["pdf_url"], F.when(~best.contains("arxiv"), best))
    pages = F.concat_ws("-", F.col("biblio.first_page"), F.when(F.col("biblio.last_page") != F.col("biblio.first_page"), F.col("biblio.last_page")))
    ids = F.filter(F.transform("authorships", lambda a: a["author"]["id"]), lambda i: ~blank(i))
    out = raw.select(
        F.coalesce("title", "display_name").alias("title"), F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"),
        F.col("publication_year").alias("year"), "publication_date", source["display_name"].alias("venue"), venue["key"].alias("venue_key"),
        F.when(preprint, "preprint").otherwise(venue["type"]).alias("venue_type"), "doi",
        normalize_arxiv_id(linked(_first(F.col("locations"), lambda l: linked(l).contains("arxiv.org")))).alias("arxiv_id"),
        F.col("ids.pmid").alias("pmid"), _last(F.col("id")).alias("openalex_id"), F.col("primary_location.landing_page_url").alias("url"),
        _rebuilt(F.col("abstract_inverted_index")).alias("abstract"), F.col("cited_by_count").alias("citation_count"), F.lit("openalex").alias("source"),
        F.lower("type").alias("publication_type"), "biblio.volume", "biblio.issue", filled(pages).alias("pages"), source["issn_l"].alias("issn"),
        _pdfs(pmc=_first(free, central)["pdf_url"], arxiv=_first(free, lambda l: where(l).contains("arxiv"))["pdf_url"], official_oa=official).alias("pdf_candidates"),
        official.alias("pdf_url"), F.transform("referenced_works", _last).alias("references"), F.transform(ids, lambda i: F.concat(F.lit("openalex:"), _last(i))).alias("author_ids"),
        F.array(F.lit(f"openalex:{label}")).alias("queries"),
    )
    return finalize(out)


def semantic_scholar(raw: DataFrame, label: str = "") -> DataFrame:
    """Records of Semantic Scholar papers."""
    kinds = F.transform(F.coalesce("publicationTypes", F.array().cast("array<string>")), F.lower)
    has = lambda k: F.array_contains(kinds, k)
    name = F.coalesce(filled(F.col("publicationVenue.name")), filled(F.col("venue")), F.col("journal.name"), F.lit(""))
    hint = F.coalesce(filled(F.lower("publicationVenue.type")), F.when(has("conference"), "conference").when(has("journalarticle"), "journal"))
    venue = canonical_venue(name, hint)
    ids = F.col("externalIds")
    only = (venue["key"] == "unknown") & ~blank(ids["ArXiv"]) & blank(ids["DOI"])
    volume = filled(F.trim("journal.volume"))
    pseudo = F.coalesce(F.lower(F.trim("journal.name")).isin("arxiv", "arxiv.org") | F.lower(volume).startswith("abs/"), F.lit(False))
    kind = F.when(has("editorial") | has("lettersandcomments"), "editorial").when(has("review") & ~has("journalarticle"), "review").otherwise(F.array_join(kinds, ","))
    pdf = F.col("openAccessPdf.url")
    official = F.when(~pdf.contains("arxiv.org"), pdf)
    out = raw.select(
        "title", F.transform("authors", lambda a: a["name"]).alias("authors"), "year", F.col("publicationDate").alias("publication_date"), name.alias("venue"),
        F.when(only, "arxiv").otherwise(venue["key"]).alias("venue_key"), F.when(only, "preprint").otherwise(venue["type"]).alias("venue_type"),
        ids["DOI"].alias("doi"), ids["ArXiv"].alias("arxiv_id"), ids["PubMed"].alias("pmid"), F.concat(F.lit("PMC"), filled(ids["PubMedCentral"])).alias("pmcid"),
        F.col("paperId").alias("semantic_scholar_id"), "abstract", F.col("citationCount").alias("citation_count"), F.lit("semantic_scholar").alias("source"),
        kind.alias("publication_type"), F.when(~pseudo, volume).alias("volume"), F.when(~pseudo, filled(F.trim("journal.pages"))).alias("pages"),
        _pdfs(arxiv=F.when(pdf.contains("arxiv.org"), pdf), official_oa=official).alias("pdf_candidates"), official.alias("pdf_url"),
        F.transform(F.filter("authors", lambda a: ~blank(a["authorId"])), lambda a: F.concat(F.lit("s2:"), a["authorId"])).alias("author_ids"),
        F.array(F.lit(f"semantic_scholar:{label}")).alias("queries"), F.when(blank(ids["DOI"]) & blank(ids["ArXiv"]), F.col("url")).alias("url"),
    )
    return finalize(out)


def crossref_date(*fields: Column) -> Column:
    """The first date that has a year, as far as its parts go."""
    parts = lambda c: F.get(c["date-parts"], F.lit(0))
    text = lambda p: F.array_join(F.transform(p, lambda x, i: F.when(i == 0, x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, "0"))), "-")
    return F.coalesce(*[F.when(F.get(parts(c), F.lit(0)).isNotNull(), text(parts(c))) for c in fields])


def crossref(raw: DataFrame) -> DataFrame:
    """Records of Crossref works (S16): a volume's title goes before its series', a conference's name helps."""
    container = _container(F.col("container-title"))
    event = F.coalesce(F.col("event.name"), _conference(F.col("assertion")))
    hints = F.create_map(*[F.lit(x) for pair in CROSSREF_HINTS.items() for x in pair])
    name = F.coalesce(container, event, F.lit(""))
    venue = canonical_venue(F.concat_ws(" ", name, event), F.try_element_at(hints, F.col("type")))
    posted = F.col("type") == "posted-content"
    published = crossref_date(*[F.col(f"`{n}`") for n in ("issued", "published-online", "published-print", "created")])
    out = raw.select(
        strip_markup(F.get("title", F.lit(0))).alias("title"),
        F.transform("author", lambda a: F.coalesce(filled(F.concat_ws(" ", a["given"], a["family"])), a["name"], F.lit(""))).alias("authors"),
        published.alias("publication_date"), F.substring(published, 1, 4).try_cast("int").alias("year"), name.alias("venue"),
        F.when(posted & ~venue["key"].isin("arxiv", "medrxiv"), "preprint").otherwise(venue["key"]).alias("venue_key"), F.when(posted, "preprint").otherwise(venue["type"]).alias("venue_type"),
        F.col("DOI").alias("doi"), F.col("URL").alias("url"), strip_markup(F.col("abstract")).alias("abstract"), F.col("`is-referenced-by-count`").alias("citation_count"),
        F.lit("crossref").alias("source"), F.when(F.col("subtype") == "editorial", "editorial").otherwise(F.col("type")).alias("publication_type"),
        "volume", "issue", F.col("page").alias("pages"), "publisher", F.get("ISSN", F.lit(0)).alias("issn"),
    )
    return finalize(out)


def openreview(raw: DataFrame, venue_id: str, venue_key: str, year: int, prefilter: bool = False) -> DataFrame:
    """Records of OpenReview notes of a venue (S17); content values may be wrapped in {"value": ...}."""
    value = lambda k: F.coalesce(F.get_json_object(F.col("content")[k], "$.value"), F.col("content")[k])
    venue, pdf = F.coalesce(value("venue"), F.lit("")), value("pdf")
    out = raw.select(
        value("title").alias("title"), F.coalesce(F.from_json(value("authors"), "array<string>"), F.array().cast("array<string>")).alias("authors"), F.lit(year).alias("year"),
        F.coalesce(filled(venue), F.lit(f"{venue_key.upper()} {year}")).alias("venue"), F.lit(venue_key).alias("venue_key"),
        F.when(F.lower(venue).contains("workshop"), "workshop").otherwise("conference").alias("venue_type"), value("abstract").alias("abstract"),
        F.concat(F.lit("https://openreview.net/forum?id="), F.coalesce("forum", "id")).alias("url"), F.lit("openreview").alias("source"), F.lit("conference-paper").alias("publication_type"),
        _pdfs(proceedings=F.when(pdf.startswith("/"), F.concat(F.lit("https://openreview.net"), pdf)).otherwise(pdf)).alias("pdf_candidates"), F.array(F.lit(f"openreview:{venue_id}")).alias("queries"),
    )
    found = finalize(out)
    return found.where(looks_radiological(F.col("title"), F.col("abstract"))) if prefilter else found


_ROW = "title string, abstract string, authors array<string>, publication_date string, year int, venue string, doi string, arxiv_id string, pmid string, pmcid string, publication_type string, volume string, issue string, pages string, issn string, journal_ref string, abs_url string, pdf_url string"


def _rows(df: DataFrame, column: str, parse: Callable[[str], list[dict]]) -> DataFrame:
    """A row for each record in each file of text; a file that can't be read gives none."""
    names = [f.split(" ")[0] for f in _ROW.split(", ")]

    def run(frames):
        for frame in frames:
            found = [r for text in frame[column] for r in parse(text or "")]
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in found], dtype=object) for n in names})

    return df.select(column).mapInPandas(run, _ROW)


#: Elements of a PubMed answer and of an arXiv feed that are read. What can't be parsed goes to the last column.
_PUBMED_DATE = "struct<_PubStatus:string,Year:string,Month:string,Day:string,MedlineDate:string>"
_PUBMED = (
    "PubmedArticle array<struct<MedlineCitation:struct<PMID:string,Article:struct<Journal:struct<ISSN:string,Title:string,JournalIssue:struct<Volume:string,Issue:string,"
    f"PubDate:{_PUBMED_DATE}>>,ArticleTitle:string,Pagination:struct<MedlinePgn:string>,Abstract:struct<AbstractText:array<string>>,"
    "AuthorList:struct<Author:array<struct<ForeName:string,LastName:string,CollectiveName:string>>>,PublicationTypeList:struct<PublicationType:array<string>>,"
    f"ArticleDate:array<{_PUBMED_DATE}>>>,PubmedData:struct<History:struct<PubMedPubDate:array<{_PUBMED_DATE}>>,ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>>>"
)
_ARXIV = "entry array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>,doi:string,journal_ref:string>>"
_XML = {"columnNameOfCorruptRecord": "_bad", "ignoreNamespace": "true"}
#: A tag inside text that is read whole: with a name, and attributes that have values.
_TAG = r"""</?[A-Za-z][\w:.-]*(\s+[\w:.-]+\s*=\s*("[^"]*"|'[^']*'))*\s*/?>"""


def _answers(files: DataFrame, column: str, schema: str) -> DataFrame:
    return files.select(F.from_xml(column, f"{schema}, _bad string", _XML).alias("answer"))


def unreadable(files: DataFrame, column: str = "value") -> DataFrame:
    """(answer, error): a row for each XML answer that can't be parsed, which gives no records."""
    parsed = files.select(F.col(column).alias("answer"), F.from_xml(column, "_any string, _bad string", _XML).alias("x"))
    return parsed.where(F.col("x._bad").isNotNull()).select("answer", F.when(F.trim("answer") == "", "empty").otherwise("no well-formed XML").alias("error"))


def _bare(c: Column) -> Column:
    """Text of an element that may hold others."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _TAG, ""))


def _pubmed_date(d: Column) -> Column:
    """YYYY-MM-DD of a date that begins with a year, months by name or number; null for any other."""
    given = F.trim(F.coalesce(F.when(~blank(d["Year"]), d["Year"]), d["MedlineDate"], F.lit("")))
    year = F.regexp_extract(given, r"^\d{4}", 0)
    month, day = F.trim(F.coalesce(d["Month"], F.lit(""))), F.trim(F.coalesce(d["Day"], F.lit("")))
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(month, 1, 3)))
    number = F.when(named > 0, named.cast("int")).otherwise(F.coalesce(F.when(month.rlike(r"^\d+$"), month.try_cast("int")), F.lit(1)))
    of_day = F.coalesce(F.when(day.rlike(r"^\d+$"), day.try_cast("int")), F.lit(1))
    return F.when(year != "", F.format_string("%s-%02d-%02d", year, number, of_day))


def _pubmed_rows(files: DataFrame, column: str) -> DataFrame:
    """Rows of PubMed answers."""
    e = _answers(files, column, _PUBMED).select(F.explode("answer.PubmedArticle").alias("e")).select("e.*")
    a, issue = F.col("MedlineCitation.Article"), F.col("MedlineCitation.Article.Journal.JournalIssue")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    ids = F.coalesce(F.col("PubmedData.ArticleIdList.ArticleId"), none("struct<_IdType:string,_VALUE:string>"))
    own_id = lambda kind: F.trim(F.try_element_at(F.filter(ids, lambda i: i["_IdType"] == kind), F.lit(-1))["_VALUE"])
    kinds = F.transform(F.coalesce(a["PublicationTypeList"]["PublicationType"], none("string")), _bare)
    left_out = F.get(F.filter(kinds, lambda k: k.isin(*EXCLUDED_PUBMED)), F.lit(0))
    kind = F.coalesce(left_out, F.when(F.array_contains(kinds, "Preprint"), "Preprint").when(F.array_contains(kinds, "Review"), "Review").otherwise("Journal Article"))
    name = lambda x: F.trim(F.concat_ws(" ", *[F.when(~blank(x[n]), F.trim(x[n])) for n in ("ForeName", "LastName")]))
    people = F.transform(F.coalesce(a["AuthorList"]["Author"], none("struct<ForeName:string,LastName:string,CollectiveName:string>")), lambda x: F.coalesce(F.when(name(x) != "", name(x)), _bare(x["CollectiveName"])))
    history = F.filter(F.coalesce(F.col("PubmedData.History.PubMedPubDate"), none(_PUBMED_DATE)), lambda d: d["_PubStatus"] == "pubmed")
    dated = F.coalesce(_pubmed_date(F.get(history, F.lit(0))), _pubmed_date(F.get(a["ArticleDate"], F.lit(0))), _pubmed_date(issue["PubDate"]))
    texts = F.coalesce(a["Abstract"]["AbstractText"], none("string"))
    return _as_rows(e, {
        "title": _bare(a["ArticleTitle"]), "abstract": F.array_join(F.transform(texts, _bare), " "), "authors": F.filter(people, lambda n: n != ""), "publication_date": dated, "venue": _bare(a["Journal"]["Title"]),
        "doi": own_id("doi"), "pmid": F.trim("MedlineCitation.PMID"), "pmcid": own_id("pmc"), "publication_type": F.lower(kind),
        "volume": filled(issue["Volume"]), "issue": filled(issue["Issue"]), "pages": filled(a["Pagination"]["MedlinePgn"]), "issn": filled(a["Journal"]["ISSN"]),
    })


def _as_rows(df: DataFrame, known: dict[str, Column]) -> DataFrame:
    """The columns of _ROW, those that a source doesn't tell null."""
    kinds = [f.split(" ") for f in _ROW.split(", ")]
    return df.select(*[known.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in kinds])


def pubmed(files: DataFrame, column: str = "value") -> DataFrame:
    """Records of PubMed XML answers, one in each row of `column`."""
    rows = _pubmed_rows(files, column)
    venue = canonical_venue(F.col("venue"), F.lit("journal"))
    preprint = (F.col("publication_type") == "preprint") | (venue["type"] == "preprint")
    pdf = F.concat(F.lit("https://europepmc.org/articles/"), "pmcid", F.lit("?pdf=render"))
    page = F.when(blank(F.col("doi")), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/")))
    return finalize(rows.withColumns({"venue_key": venue["key"], "venue_type": F.when(preprint, "preprint").otherwise("journal"), "source": F.lit("pubmed"), "pdf_candidates": _pdfs(pmc=pdf), "url": page}))


def _arxiv_rows(files: DataFrame, column: str) -> DataFrame:
    """Rows of arXiv feeds."""
    e = _answers(files, column, _ARXIV).select(F.explode("answer.entry").alias("e")).select("e.*")
    say = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    people = F.transform(F.coalesce("author", F.array().cast("array<struct<name:string>>")), lambda x: say(x["name"]))
    return _as_rows(e, {
        "title": say(F.col("title")), "abstract": say(F.col("summary")), "authors": people, "publication_date": filled(F.substring(say(F.col("published")), 1, 10)), "arxiv_id": say(F.col("id")),
        "doi": filled(say(F.col("doi"))), "journal_ref": filled(say(F.col("journal_ref"))),
    })


def arxiv(files: DataFrame, column: str = "value") -> DataFrame:
    """Records of arXiv feeds (S15): a claimed journal counts only with a DOI."""
    rows = _arxiv_rows(files, column).withColumn("arxiv_id", normalize_arxiv_id(F.col("arxiv_id"))).where("arxiv_id is not null")
    claimed = canonical_venue(F.col("journal_ref"))
    real = ~blank(F.col("journal_ref")) & ~blank(F.col("doi")) & (claimed["key"] != "unknown")
    pick = lambda a, b: F.when(real, a).otherwise(F.lit(b))
    url = F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id")
    return finalize(rows.withColumns({"venue": pick(F.col("journal_ref"), "arXiv"), "venue_key": pick(claimed["key"], "arxiv"), "venue_type": pick(claimed["type"], "preprint"), "source": F.lit("arxiv"), "url": url}))


def parse_pmlr(page: str) -> list[dict]:
    """Rows of a proceedings volume's index."""
    out = []
    for block in re.findall(r'(?s)<div class="paper">(.*?)</div>', page):
        of = lambda p: (m := re.search(p, block)) and m[1]  # noqa: B023, E731
        title, names = of(r'(?s)<p class="title">(.*?)</p>'), of(r'(?s)<span class="authors">(.*?)</span>')
        if title:
            authors = [" ".join(a.split()) for a in re.sub(r"<[^>]+>", "", names or "").replace("&nbsp;", " ").split(",")]
            out.append({"title": title, "authors": [a for a in authors if a], "abs_url": of(r'href="(https?://proceedings\.mlr\.press/v\d+/[^"]+\.html)"'), "pdf_url": of(r'href="([^"]+\.pdf)"'), "pages": of(r"PMLR \d+:([\w\-]+)")})
    return out


def pmlr(files: DataFrame, volume: int, venue_key: str, year: int, abstracts: DataFrame | None = None, prefilter_over: int | None = None, column: str = "value") -> DataFrame:
    """Records of a proceedings volume (S18), with abstracts (abs_url, html) joined to them; large volumes may be filtered first."""
    rows = _rows(files, column, parse_pmlr)
    if prefilter_over is not None and rows.count() > prefilter_over:
        rows = rows.where(looks_radiological(F.col("title"), F.lit("")))
    if abstracts is not None:
        found = abstracts.select("abs_url", strip_markup(F.regexp_extract("html", r'(?s)<div id="abstract" class="abstract">(.*?)</div>', 1)).alias("found"), filled(F.replace(F.regexp_extract("html", r'name="citation_publication_date" content="([\d/]+)"', 1), F.lit("/"), F.lit("-"))).alias("on"))
        rows = rows.join(found, "abs_url", "left").withColumns({"abstract": F.col("found"), "publication_date": F.col("on")}).drop("found", "on")
    named = {"venue": F.lit({"icml": "International Conference on Machine Learning", "midl": "Medical Imaging with Deep Learning"}.get(venue_key, venue_key.upper()))}
    return finalize(rows.withColumns(named | {"venue_key": F.lit(venue_key), "venue_type": F.lit("conference"), "year": F.lit(year), "source": F.lit("pmlr"), "volume": F.lit(str(volume)), "url": F.col("abs_url"), "publication_type": F.lit("conference-paper"), "queries": F.array(F.lit(f"pmlr:v{volume}")), "pdf_candidates": _pdfs(proceedings=F.col("pdf_url"))}))


def reference_edges(raw: DataFrame, seed: str = "seed_id") -> DataFrame:
    """(seed, dst, contexts, intents, influential) of a seed's references (S10, S11). raw: seed and citedPaper with its context."""
    none = F.array().cast("array<string>")
    return raw.where(~blank(F.col("citedPaper.title"))).select(
        seed, F.col("citedPaper.paperId").alias("dst"), F.coalesce("contexts", none).alias("contexts"), F.coalesce("intents", none).alias("intents"), F.coalesce("isInfluential", F.lit(False)).alias("influential")
    )


def gold_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without comments and empty lines."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def union_sources(spark: SparkSession, tasks: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(rows of all sources, (source, message) of those that couldn't be planned): one failing source stops no other.

    Nothing runs yet, so what fails while it runs isn't told here: scan_sources() does that.
    """
    frames, failed = [], []
    for name, task in tasks.items():
        try:
            frames.append(task())
        except Exception as e:  # noqa: BLE001  told in the second frame
            failed.append((name, _message(e)))
    if not frames:
        raise RuntimeError(f"no source could be read: {failed}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), spark.createDataFrame(failed, FAILED)


FAILED, COUNTED = "source string, message string", "source string, rows long"
#: Sources that are scanned at a time.
TOGETHER = 8


def _message(e: Exception) -> str:
    said = [line.strip() for line in str(e).splitlines() if line.strip()]
    return (said[0] if said else type(e).__name__)[:500]


@dataclass
class Scan:
    """Rows of the sources that could be read, (source, message) of the others, and (source, rows) as they were written."""

    rows: DataFrame
    errors: DataFrame
    counts: DataFrame


def scan_sources(spark: SparkSession, tasks: dict[str, Callable[[], DataFrame]], narrow: Callable[[DataFrame], DataFrame] = lambda df: df) -> Scan:
    """Scan sources, TOGETHER at a time, each written down on its own: one that fails in its tasks leaves the others' rows and a
    row that tells it (U01, A05, H11). narrow is applied to each source before it is written, so its filters reach the scan. Rows are
    counted while they are written.
    """
    shared_dir(spark)

    def scan(name: str) -> tuple[DataFrame | None, str | None, int]:
        seen = Observation()
        try:
            found = narrow(tasks[name]())
            path = scratch_path(spark, "source")
            found.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(path)
            return spark.read.schema(found.schema).parquet(path), None, int(seen.get["rows"])
        except Exception as e:  # noqa: BLE001  told in the errors
            return None, _message(e), 0

    with shuffle_files_dropped(spark), ThreadPoolExecutor(max_workers=TOGETHER) as pool:
        found = dict(zip(tasks, pool.map(inheritable_thread_target(spark)(scan), tasks), strict=True))
    frames = [df for df, _, _ in found.values() if df is not None]
    failed = [(name, message) for name, (_, message, _) in found.items() if message]
    if not frames:
        raise RuntimeError(f"no source could be read: {failed}")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return Scan(rows, spark.createDataFrame(failed, FAILED), spark.createDataFrame([(n, k) for n, (df, _, k) in found.items() if df is not None], COUNTED))
