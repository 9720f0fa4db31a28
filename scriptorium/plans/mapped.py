"""Queries that map sources' answers to records, look records up, and read other inputs.

Answers are made from tables, in the shape in which a source lands them, so a mapper runs over whole tables.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.records import finalize, is_preprint_record, library_records
from scriptorium.plans.registry import query
from scriptorium.session import scratch_path, spread, table
from scriptorium.sources import landing as zone
from scriptorium.sources import lookups, readers


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _answers(df: DataFrame, schema: str, **fields: Column) -> DataFrame:
    """Rows read from JSON, as a source lands them."""
    said = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    return spread(df).select(F.from_json(said, schema).alias("r")).select("r.*")


def _by(k: Column, *values) -> Column:
    out = F.lit(None)
    for i, v in enumerate(values):
        out = F.when(k % len(values) == i, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def _joined(name: str) -> Column:
    return F.array_join(name, ";").alias(name)


@query("""SELECT p_name AS title, '10.1234/part.' || p_partkey AS doi, 'W' || p_partkey AS openalex_id, (1000000 + p_partkey)::VARCHAR AS pmid, (1990 + p_size % 30)::INT AS year,
CASE p_partkey % 4 WHEN 0 THEN 'radiology' WHEN 1 THEN 'neurips' WHEN 2 THEN 'arxiv' ELSE 'other_journal' END AS venue_key,
CASE p_partkey % 4 WHEN 1 THEN 'conference' WHEN 2 THEN 'preprint' ELSE 'journal' END AS venue_type, 'of ' || lower(p_brand) || ' of steel' AS abstract, p_size::INT AS citation_count,
p_size || CASE WHEN p_size % 2 = 0 THEN '' ELSE '-' || (p_size + 9) END AS pages, 'W1;W' || p_size AS "references", 'Maker ' || p_size AS authors, 'openalex:A' || p_size AS author_ids FROM part""")
def openalex_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of OpenAlex as records: abstracts from inverted indexes, identifiers from URLs, pages from first and last."""
    k, n = F.col("p_partkey"), F.col("p_size")
    source = F.struct(_by(k, "Radiology", "NeurIPS 2020", "arXiv (Cornell University)", "Annals of Carpets").alias("display_name"), _by(k, "journal", "conference", "repository", "journal").alias("type"))
    index = F.map_from_arrays(F.array(F.lower("p_brand"), F.lit("steel"), F.lit("of")), F.array(F.array(F.lit(1)), F.array(F.lit(3)), F.array(F.lit(0), F.lit(2))))
    author = F.struct(F.struct(_text("https://openalex.org/A", n).alias("id"), _text("Maker ", n).alias("display_name")).alias("author"))
    raw = _answers(
        table(spark, sf_dir, "part"), readers.OPENALEX, id=_text("https://openalex.org/W", k), title=_text(F.col("p_name"), ". "), doi=_text("https://doi.org/10.1234/PART.", k), type=_by(k, "article", "article", "preprint", "article"),
        publication_year=1990 + n % 30, cited_by_count=n, ids=F.struct(_text("https://pubmed.ncbi.nlm.nih.gov/", k + 1000000).alias("pmid")), abstract_inverted_index=index,
        biblio=F.struct(n.cast("string").alias("first_page"), F.when(n % 2 == 0, n).otherwise(n + 9).cast("string").alias("last_page")), primary_location=F.struct(source.alias("source")),
        referenced_works=F.array(F.lit("https://openalex.org/W1"), _text("https://openalex.org/W", n)), authorships=F.array(author),
    )
    found = readers.openalex(raw, "parts")
    return found.select("title", "doi", "openalex_id", "pmid", "year", "venue_key", "venue_type", "abstract", "citation_count", "pages", _joined("references"), _joined("authors"), _joined("author_ids"))


@query("""SELECT c_name AS title, CASE WHEN c_custkey % 3 <> 1 THEN '10.5555/c' || c_custkey END AS doi, CASE WHEN c_custkey % 3 = 1 THEN '1901.' || lpad(c_custkey::VARCHAR, 5, '0') END AS arxiv_id, 's' || c_custkey AS semantic_scholar_id,
CASE c_custkey % 3 WHEN 0 THEN 'tmi' WHEN 1 THEN 'arxiv' ELSE 'other_conference' END AS venue_key, CASE c_custkey % 3 WHEN 0 THEN 'journal' WHEN 1 THEN 'preprint' ELSE 'conference' END AS venue_type,
CASE c_custkey % 3 WHEN 0 THEN c_nationkey::VARCHAR END AS volume, CASE c_custkey % 3 WHEN 2 THEN 'editorial' WHEN 0 THEN 'review,journalarticle' ELSE '' END AS publication_type, 's2:' || c_nationkey AS author_ids FROM customer""")
def semantic_scholar_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of Semantic Scholar as records: venues by a chain of fields, pseudo-journals of preprint servers scrubbed."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    preprint, text = k % 3 == 1, F.lit(None).cast("string")
    raw = _answers(
        table(spark, sf_dir, "customer"), readers.SEMANTIC_SCHOLAR, paperId=_text("s", k), title=F.col("c_name"), year=1990 + n,
        externalIds=F.struct(F.when(~preprint, _text("10.5555/C", k)).alias("DOI"), F.when(preprint, _text("1901.", F.lpad(k.cast("string"), 5, "0"))).alias("ArXiv")),
        publicationVenue=F.when(k % 3 == 0, F.struct(F.lit("IEEE Transactions on Medical Imaging").alias("name"), F.lit("journal").alias("type"))), venue=_by(k, "", "", "Gathering of Weavers"),
        journal=F.struct(_by(k, "IEEE TMI", "ArXiv", text).alias("name"), _by(k, n.cast("string"), "abs/1901.1", text).alias("volume")),
        publicationTypes=F.when(k % 3 == 0, F.array(F.lit("Review"), F.lit("JournalArticle"))).when(k % 3 == 2, F.array(F.lit("Conference"), F.lit("Editorial"))), authors=F.array(F.struct(n.cast("string").alias("authorId"), _text("Name ", n).alias("name"))),
    )
    found = readers.semantic_scholar(raw, "customers")
    return found.select("title", "doi", "arxiv_id", "semantic_scholar_id", "venue_key", "venue_type", "volume", F.coalesce("publication_type", F.lit("")).alias("publication_type"), _joined("author_ids"))


@query("""SELECT s_name AS title, '10.7777/s' || s_suppkey AS doi, CASE WHEN s_suppkey % 3 = 0 THEN '2001-0' || (1 + s_suppkey % 9) ELSE '20' || lpad((s_suppkey % 20)::VARCHAR, 2, '0') END AS publication_date,
CASE WHEN s_suppkey % 3 = 0 THEN 2001 ELSE 2000 + s_suppkey % 20 END::INT AS year, CASE WHEN s_suppkey % 2 = 0 THEN 'Weaving of Maps' ELSE 'Lecture Notes in Computer Science' END AS venue,
CASE WHEN s_suppkey % 2 = 0 THEN 'other_journal' ELSE 'miccai' END AS venue_key, CASE WHEN s_suppkey % 2 = 0 THEN 'journal' ELSE 'conference' END AS venue_type, 'Ada N' || s_nationkey || ';Group' AS authors, s_nationkey::INT AS citation_count FROM supplier""")
def crossref_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of Crossref as records: a volume's title before its series', dates as far as their parts go."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    parts = lambda c: F.struct(F.array(c).alias("date-parts"))
    none = F.lit(None).cast("int")
    raw = _answers(
        table(spark, sf_dir, "supplier"), readers.CROSSREF, DOI=_text("10.7777/S", k), type=_by(k, "journal-article", "proceedings-article"), title=F.array(_text("<i>", F.col("s_name"), "</i>")),
        **{"container-title": _by(k, F.array(F.lit("Lecture Notes in Computer Science"), F.lit("Weaving of Maps")), F.array(F.lit("Lecture Notes in Computer Science"))), "is-referenced-by-count": n},
        issued=parts(F.when(k % 3 == 0, F.array(none)).otherwise(F.array(2000 + k % 20))), created=parts(F.array(F.lit(2001).cast("long"), 1 + k % 9)), event=F.when(k % 2 == 1, F.struct(F.lit("MICCAI").alias("name"))),
        author=F.array(F.struct(F.lit("Ada").alias("given"), _text("N", n).alias("family"), F.lit(None).cast("string").alias("name")), F.struct(F.lit(None).cast("string").alias("given"), F.lit(None).cast("string").alias("family"), F.lit("Group").alias("name"))),
    )
    return readers.crossref(raw).select("title", "doi", "publication_date", "year", "venue", "venue_key", "venue_type", _joined("authors"), "citation_count")


@query("""SELECT p_name AS title, (10000000 + p_partkey)::VARCHAR AS pmid, '10.8888/p' || p_partkey AS doi, '19' || (50 + p_size % 50) || '-' || lpad((1 + p_partkey % 12)::VARCHAR, 2, '0') || '-01' AS publication_date,
CASE WHEN p_partkey % 5 = 0 THEN 'editorial' WHEN p_partkey % 5 = 1 THEN 'review' ELSE 'journal article' END AS publication_type, 'First part. Second ' || p_size AS abstract, 'B. ' || p_brand || ';The Group' AS authors FROM part""")
def pubmed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of PubMed answers as records: months by name, types by rank, collective authors."""
    k, n = F.col("p_partkey"), F.col("p_size")
    months = F.array(*[F.lit(m.capitalize()) for m in readers.MONTHS])
    kind = F.when(k % 5 == 0, "Editorial").when(k % 5 == 1, "Review").otherwise("Journal Article")
    xml = _text(
        "<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>", k + 10000000, "</PMID><Article><Journal><Title>Annals</Title><JournalIssue><PubDate><Year>", 1950 + n % 50, "</Year><Month>", F.get(months, (k % 12).cast("int")),
        "</Month></PubDate></JournalIssue></Journal><ArticleTitle>", F.col("p_name"), ".</ArticleTitle><Abstract><AbstractText>First part.</AbstractText><AbstractText>Second ", n,
        "</AbstractText></Abstract><AuthorList><Author><ForeName>B.</ForeName><LastName>", F.col("p_brand"), "</LastName></Author><Author><CollectiveName>The Group</CollectiveName></Author></AuthorList><PublicationTypeList><PublicationType>Journal Article</PublicationType><PublicationType>", kind,
        '</PublicationType></PublicationTypeList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.8888/P', k, "</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>",
    )
    found = readers.pubmed(spread(table(spark, sf_dir, "part")).select(xml.alias("value")))
    return found.select("title", "pmid", "doi", "publication_date", "publication_type", "abstract", _joined("authors"))


@query("""SELECT s_name AS title, '2105.' || lpad(s_suppkey::VARCHAR, 5, '0') AS arxiv_id, CASE WHEN s_suppkey % 2 = 0 THEN 'radiology' ELSE 'arxiv' END AS venue_key, CASE WHEN s_suppkey % 2 = 0 THEN 'journal' ELSE 'preprint' END AS venue_type,
'https://arxiv.org/abs/2105.' || lpad(s_suppkey::VARCHAR, 5, '0') AS url, '2021-05-0' || (1 + s_suppkey % 9) AS publication_date FROM supplier""")
def arxiv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of arXiv feeds as records: a claimed journal counts only with a DOI."""
    k = F.col("s_suppkey")
    feed = _text(
        '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2105.', F.lpad(k.cast("string"), 5, "0"), "v2</id><title>", F.col("s_name"), "</title><published>2021-05-0", 1 + k % 9,
        "T00:00:00Z</published><author><name>A B</name></author><arxiv:journal_ref>Radiology</arxiv:journal_ref>", F.when(k % 2 == 0, _text("<arxiv:doi>10.1148/r", k, "</arxiv:doi>")).otherwise(""), "</entry></feed>",
    )
    return readers.arxiv(table(spark, sf_dir, "supplier").select(feed.alias("value"))).select("title", "arxiv_id", "venue_key", "venue_type", "url", "publication_date")


@query("""SELECT c_name AS title, 'A ' || c_nationkey || ';B' AS authors, c_custkey || '-' || (c_custkey + 9) AS pages, 'http://proceedings.mlr.press/v7/c' || c_custkey || '.html' AS url, 'http://proceedings.mlr.press/v7/c' || c_custkey || '.pdf' AS pdf,
CASE WHEN c_custkey % 2 = 0 THEN 'About ' || c_mktsegment ELSE '' END AS abstract FROM customer""")
def pmlr_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of a proceedings volume's index as records, with abstracts joined to them."""
    k, c = F.col("c_custkey"), table(spark, sf_dir, "customer")
    page = _text("http://proceedings.mlr.press/v7/c", k)
    block = _text('<div class="paper"><p class="title">', F.col("c_name"), '</p><span class="authors">A ', F.col("c_nationkey"), ",&nbsp;B</span> PMLR 7:", k, "-", k + 9, ' <a href="', page, '.html">abs</a><a href="', page, '.pdf">pdf</a></div>')
    abstracts = c.where("c_custkey % 2 = 0").select(_text(page, ".html").alias("abs_url"), _text('<div id="abstract" class="abstract">About <b>', F.col("c_mktsegment"), "</b></div>").alias("html"))
    found = readers.pmlr(c.select(block.alias("value")), 7, "midl", 2020, abstracts)
    return found.select("title", _joined("authors"), "pages", "url", F.col("pdf_candidates")["proceedings"].alias("pdf"), "abstract")


@query("""SELECT p_name AS title, 'A;' || p_brand AS authors, CASE WHEN p_partkey % 3 = 0 THEN 'workshop' ELSE 'conference' END AS venue_type, 'https://openreview.net/forum?id=f' || p_partkey AS url,
'https://openreview.net/pdf/' || p_partkey || '.pdf' AS pdf, 'neurips' AS venue_key FROM part""")
def openreview_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of a venue as records; wrapped and bare values are read alike."""
    k, p = F.col("p_partkey"), table(spark, sf_dir, "part")
    wrapped = lambda v: F.when(k % 2 == 0, F.to_json(F.struct(v.alias("value")))).otherwise(v)
    names = F.array(F.lit("A"), F.col("p_brand"))
    content = F.create_map(
        F.lit("title"), wrapped(F.col("p_name")), F.lit("authors"), F.when(k % 2 == 0, F.to_json(F.struct(names.alias("value")))).otherwise(F.to_json(names)),
        F.lit("venue"), wrapped(F.when(k % 3 == 0, "NeurIPS 2020 Workshop").otherwise("NeurIPS 2020 poster")), F.lit("pdf"), wrapped(_text("/pdf/", k, ".pdf")),
    )
    raw = p.select(_text("n", k).alias("id"), _text("f", k).alias("forum"), content.alias("content"))
    return readers.openreview(raw, "v", "neurips", 2020).select("title", _joined("authors"), "venue_type", "url", F.col("pdf_candidates")["proceedings"].alias("pdf"), "venue_key")


@query("SELECT DISTINCT l_orderkey AS seed_id, 'p' || l_partkey AS dst, 'c' || l_linenumber || ';d' AS contexts, CASE WHEN l_returnflag = 'A' THEN 'result' ELSE '' END AS intents, l_linestatus = 'F' AS influential, l_linenumber::BIGINT AS line FROM lineitem WHERE l_suppkey % 7 <> 0")
def reference_edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of seeds with contexts and intents; works without a title are no works."""
    li = table(spark, sf_dir, "lineitem")
    cited = F.struct(_text("p", F.col("l_partkey")).alias("paperId"), F.when(F.col("l_suppkey") % 7 != 0, "a title").alias("title"))
    raw = li.select(
        F.col("l_orderkey").alias("seed_id"), cited.alias("citedPaper"), F.array(_text("c", F.col("l_linenumber")), F.lit("d")).alias("contexts"),
        F.when(F.col("l_returnflag") == "A", F.array(F.lit("result"))).alias("intents"), F.when(F.col("l_linestatus") == "F", True).alias("isInfluential"),
    )
    found = readers.reference_edges(raw).select("seed_id", "dst", _joined("contexts"), _joined("intents"), "influential")
    return found.withColumn("line", F.regexp_extract("contexts", r"c(\d+)", 1).cast("long")).distinct()


@query("SELECT o_orderkey AS key, o_orderpriority AS label FROM orders")
def gold_rows_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines among comments and empty lines, written and read back."""
    o = table(spark, sf_dir, "orders")
    lines = o.select(F.explode(F.array(F.lit("# a comment"), F.lit("  "), F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("label"))))).alias("value"))
    path = scratch_path(spark, "gold")
    lines.write.text(path)
    return readers.gold_rows(spark, path, "key long, label string")


@query("""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'arxiv_html' WHEN c_custkey % 3 = 0 THEN 'ar5iv' ELSE 'pmc' END AS source FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0""")
def preferred_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full text of the first place that has a usable one."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    page = lambda fits, text: c.select("doc_id", F.when(fits, text).otherwise("<p>nothing</p>").alias("page"))
    arxiv, mirror = page(F.col("doc_id") % 2 == 0, '<section class="ltx_section">'), page(F.col("doc_id") % 3 == 0, '<section class="ltx_section">')
    pmc = c.where("doc_id % 5 = 0").select("doc_id", F.lit("<article/>").alias("page"))
    return lookups.preferred_document(arxiv, mirror, pmc).select("doc_id", "source")


@query("""SELECT s_nationkey AS asked, min(s_suppkey) AS found FROM supplier GROUP BY 1""")
def entity_by_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of candidates with one name, the one whose works hold the most keywords; ties go to the first."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("author_id"), F.col("s_nationkey").alias("asked"))
    works = s.join(s.groupBy("asked").agg(F.min("author_id").alias("best")), "asked").select("author_id", F.when(F.col("author_id") == F.col("best"), "steel steel").otherwise("steel").alias("topic"), F.lit("").alias("title"))
    ranked = lookups.resolve_author(works, s, ("steel",))
    return ranked.groupBy("asked").agg(F.min_by("author_id", F.struct(-F.col("affinity"), F.col("author_id"))).alias("found"))


@query("SELECT s_suppkey::VARCHAR AS id FROM supplier WHERE s_name LIKE '%1%' ORDER BY s_acctbal DESC, s_suppkey::VARCHAR LIMIT 3")
def venue_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three sources with most works whose name holds a venue's, a top-k."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("display_name"), F.col("s_acctbal").alias("works_count"))
    return lookups.venue_source_ids(s, "1").select("id")


@query("""SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-01-01' AND '1996-12-31'""")
def works_of_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An author's records within a window of dates."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    papers = o.select("o_orderkey", F.array(_text("n", F.col("c_nationkey"))).alias("author_ids"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"))
    return lookups.by_author(papers, ["n3", "n99"], "1995-01-01", "1996-12-31").select("o_orderkey")


@query("""SELECT p_partkey FROM part WHERE p_partkey = (SELECT min_by(p_partkey, p_name) FROM part WHERE p_size = 7)""")
def first_known_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of the first identifier, in the order asked, that is known."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lit(None).cast("string").alias("doi"), _text("PM", F.col("p_size")).alias("pmid"), F.col("p_name").alias("title"))
    return lookups.first_found(p, doi="10.1/x", pmid="pm7", title="no such").select("p_partkey")


@query("""SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey % 5 <> 0""")
def related_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a source calls related to the seeds, without the seeds."""
    node = lambda mark, c: _text(mark, F.col(c))
    links = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(node("o", "o_orderkey").alias("src"), node("c", "o_custkey").alias("dst"))
    papers = table(spark, sf_dir, "customer").where("c_mktsegment = 'FURNITURE'").select("c_custkey", node("c", "c_custkey").alias("id"))
    seeds = table(spark, sf_dir, "orders").select(node("o", "o_orderkey").alias("id")).unionAll(papers.where("c_custkey % 5 = 0").select("id"))
    return lookups.related(papers, links, seeds, "id").select("c_custkey")


@query("""WITH z AS (SELECT user_id, event_type, ts, event_id % 10 = 0 AS bad FROM events), l AS (SELECT user_id, max(ts) AS last FROM z WHERE NOT bad GROUP BY 1)
SELECT DISTINCT user_id FROM z WHERE user_id NOT IN (SELECT user_id FROM l WHERE date_diff('second', last, TIMESTAMP '2024-01-31 00:00:00') <= (CASE user_id % 3 WHEN 0 THEN 24 WHEN 1 THEN 168 ELSE 720 END) * 3600)""")
def requests_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests without an answer that is fresh enough for its kind."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("user_id") % 3 == 0, "default").when(F.col("user_id") % 3 == 1, "lookup").otherwise("fulltext")
    landed = e.select(F.col("user_id").alias("request_key"), kind.alias("kind"), F.col("ts").alias("fetched_at"), F.when(F.col("event_id") % 10 == 0, 500).otherwise(200).alias("status"), F.lit("{}").alias("body"))
    asked = e.select(F.col("user_id").alias("request_key")).distinct()
    return zone.needed(asked, landed, datetime(2024, 1, 31)).select(F.col("request_key").alias("user_id"))


@query("""WITH z AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' THEN 503 WHEN event_type = 'signup' THEN 404 ELSE 200 END AS status FROM events),
l AS (SELECT user_id, arg_max(status, ts) AS status FROM z GROUP BY 1) SELECT user_id, status::INT AS status, (SELECT count(*) FROM z WHERE z.user_id = l.user_id AND z.status <> 200) AS tries, status = 503 AS again,
greatest(1, least(60, pow(2, (SELECT count(*) FROM z WHERE z.user_id = l.user_id AND z.status <> 200) - 1)))::DOUBLE AS wait FROM l WHERE status <> 200""")
def request_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose last answer failed: how often, whether another try makes sense, and after how many seconds."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "signup", 404).otherwise(200)
    found = zone.failures(e.select(F.col("user_id").alias("request_key"), F.col("ts").alias("fetched_at"), status.alias("status")))
    return found.select(F.col("request_key").alias("user_id"), "status", "tries", "again", zone.backoff_seconds(F.col("tries")).alias("wait"))


@query("""SELECT event_id, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(CASE host WHEN 'arxiv' THEN 3100 WHEN 'pubmed' THEN 350 ELSE 200 END * (row_number() OVER (PARTITION BY host ORDER BY event_id) - 1)), '%Y-%m-%d %H:%M:%S.%g') AS at
FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'arxiv' WHEN 'view' THEN 'pubmed' ELSE 'elsewhere' END AS host FROM events)""")
def request_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each request may go out: those of a host one after another, by its least interval."""
    host = F.when(F.col("event_type") == "click", "arxiv").when(F.col("event_type") == "view", "pubmed").otherwise("elsewhere")
    found = zone.schedule(table(spark, sf_dir, "events").select("event_id", host.alias("host")), datetime(2024, 1, 1), "event_id")
    return found.select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"))


@query("""SELECT sha1('GET ' || 'https://h.org/x?' || CASE WHEN c_custkey % 2 = 0 THEN 'a=' || c_nationkey || '&key=***' ELSE 'b=1&key=***' END) AS request_key, count(*) AS n FROM customer GROUP BY 1""")
def request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests keyed whatever the order of their parameters, and without credentials."""
    k = F.col("c_custkey")
    one = F.create_map(F.lit("key"), k.cast("string"), F.lit("a"), F.col("c_nationkey").cast("string"))
    two = F.create_map(F.lit("b"), F.lit("1"), F.lit("key"), F.lit("secret"))
    key = zone.request_key(F.lit("get"), F.lit("https://h.org/x"), F.when(k % 2 == 0, one).otherwise(two))
    return table(spark, sf_dir, "customer").select(key.alias("request_key")).groupBy("request_key").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN '10.1101/c' || c_custkey WHEN c_custkey % 3 = 1 THEN '10.5555/c' || c_custkey END AS doi, CASE WHEN c_custkey % 3 = 2 THEN '1901.' || lpad(c_custkey::VARCHAR, 5, '0') END AS arxiv_id,
(10000 + c_custkey)::VARCHAR AS pmid, (1950 + c_nationkey)::INT AS year, c_custkey % 3 <> 1 AS preprint FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 7 <> 0""")
def library_items_as_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a library as records: identifiers out of fields, URLs and free text; notes and deleted items left out."""
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    items = table(spark, sf_dir, "customer").select(
        k.alias("key"), F.when(k % 7 == 0, "note").otherwise("journalArticle").alias("itemType"), F.col("c_name").alias("title"), F.when(k % 3 == 1, _text("https://doi.org/10.5555/C", k)).alias("DOI"),
        F.when(k % 3 == 0, _text("PMID: ", k + 10000, "\nDOI: 10.1101/C", k)).otherwise(_text("seen\nPMID: ", k + 10000)).alias("extra"),
        F.when(k % 3 == 2, _text("https://arxiv.org/abs/1901.", F.lpad(k.cast("string"), 5, "0"), "v3")).alias("url"), none.alias("archiveID"), _text("May ", 1950 + F.col("c_nationkey")).alias("date"), F.when(k % 11 == 0, True).alias("deleted"),
    )
    found = library_records(items)
    id_ = lambda n: F.try_element_at("ids", F.lit(n)).alias(n)
    return found.select("key", id_("doi"), id_("arxiv_id"), id_("pmid"), "year", is_preprint_record(F.col("item_type"), F.col("ids")).alias("preprint"))


@query("""SELECT p_partkey AS k, p_name AS title, CASE WHEN p_partkey % 4 = 0 THEN '10.48550/arxiv.1902.' || lpad(p_partkey::VARCHAR, 5, '0') WHEN p_partkey % 4 = 1 THEN '10.5555/p' || p_partkey END AS doi,
CASE WHEN p_partkey % 4 = 0 THEN '1902.' || lpad(p_partkey::VARCHAR, 5, '0') END AS arxiv_id, 'study of ' || p_brand AS abstract, (1990 + p_size % 20)::INT AS year,
CASE WHEN p_partkey % 4 = 0 THEN 'https://arxiv.org/abs/1902.' || lpad(p_partkey::VARCHAR, 5, '0') WHEN p_partkey % 4 = 1 THEN 'https://doi.org/10.5555/p' || p_partkey ELSE '' END AS url,
CASE WHEN p_partkey % 4 = 0 THEN 'https://arxiv.org/pdf/1902.' || lpad(p_partkey::VARCHAR, 5, '0') END AS pdf, 'J. M. Weaver' AS authors FROM part""")
def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records made canonical: markup gone, identifiers derived, years from dates, pages and PDFs filled in."""
    k = F.col("p_partkey")
    doi = F.when(k % 4 == 0, _text("https://doi.org/10.48550/arXiv.1902.", F.lpad(k.cast("string"), 5, "0"))).when(k % 4 == 1, _text("doi:10.5555/P", k, "."))
    raw = table(spark, sf_dir, "part").select(
        _text("<b>", F.col("p_name"), "...</b>").alias("title"), doi.alias("doi"), _text("Abstract: study  of <i>", F.col("p_brand"), "</i>").alias("abstract"), _text(1990 + F.col("p_size") % 20, "-03").alias("publication_date"),
        F.array(F.lit(" J. M.  Weaver "), F.lit("")).alias("authors"), F.col("p_partkey").cast("string").alias("volume"), F.lit("x").alias("source"),
    )
    found = finalize(raw)
    return found.select(F.col("volume").cast("long").alias("k"), "title", "doi", "arxiv_id", "abstract", "year", "url", F.try_element_at("pdf_candidates", F.lit("arxiv")).alias("pdf"), _joined("authors"))


@query("""SELECT doc_id, count(*) AS n, min(CASE WHEN known IS NOT NULL THEN known ELSE hit END) AS first_title FROM (
SELECT l_orderkey AS doc_id, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'known ' || l_partkey END AS known, CASE WHEN l_linenumber % 2 = 1 AND largest > 25 THEN 'found ' || name END AS hit FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) JOIN part ON p_partkey = l_partkey
JOIN (SELECT lower(p_name) AS k, max(p_size) AS largest, min(p_name) AS name FROM part GROUP BY 1) ON k = lower(p_name))
WHERE known IS NOT NULL OR hit IS NOT NULL GROUP BY 1""")
def bibliography_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of bibliography entries from trusted records, else from look-ups of long ones."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    li = li.join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    line = F.col("l_linenumber").cast("string").alias("bid")
    entries = li.select(F.col("l_orderkey").alias("doc_id"), line, F.lower("p_name").alias("title_key"))
    trusted = li.where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("doc_id"), line, _text("known ", F.col("l_partkey")).alias("title"))
    looked = table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("title_key")).agg(F.max("p_size").alias("p_size"), F.min("p_name").alias("p_name")).where("p_size > 25").select("title_key", _text("found ", F.col("p_name")).alias("title"))
    found = lookups.complete_bibliography(entries, trusted, looked, shortest=3)
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("title").alias("first_title"))
