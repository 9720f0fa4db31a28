"""Queries that resolve entities with the library's own operators: links, clusters, merges, routes, authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.functions.venues import canonical_venue, conference_name, venue_display, venue_tag
from scriptorium.operators import authors, dedup, enrich, fulltext, graph, records
from scriptorium.plans.registry import query
from scriptorium.schema import PAPER, conform
from scriptorium.session import settle, table, tasks_of

_LISTS = "array<string>"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _ids(**values: Column) -> Column:
    entries = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))) for k, v in values.items()]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


# documents as records: the first line is the title; equal titles meet, sources play publishers
_TITLE_SQL = "trim(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g'))"
_TITLES_SQL = f"t AS (SELECT doc_id, source, {_TITLE_SQL} AS k FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
    head = F.lower(F.substring_index("text", "\n", 1))
    return d.select("doc_id", "source", F.trim(F.regexp_replace(F.regexp_replace(head, "[^a-z0-9_ ]", " "), " +", " ")).alias("title_key"))


_EDGES_SQL = """WITH RECURSIVE two AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT src AS node, src AS reach FROM two UNION SELECT node, dst FROM r JOIN two ON reach = src)"""


@query(f"""WITH {_TITLES_SQL}, h AS (SELECT k, source, min(doc_id) AS head FROM t WHERE k <> '' GROUP BY 1, 2)
SELECT doc_id AS src, head AS dst FROM t JOIN h USING (k, source) WHERE doc_id <> head""")
def title_exact_match_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of equal title keys: sources, as publisher DOIs, veto a match of two different ones."""
    t = _titled(spark, sf_dir).select("doc_id", "title_key", _ids(doi=_text("10.5555/", F.col("source"))).alias("ids"))
    return dedup.title_links(t, "doc_id")


@query(f"""WITH {_TITLES_SQL}, h AS (SELECT k, CASE WHEN source = 'src1' THEN source ELSE '' END AS own, min(doc_id) AS head FROM t WHERE k <> '' GROUP BY 1, 2),
f AS (SELECT k, min(head) AS dst, count(*) AS n FROM h GROUP BY 1) SELECT doc_id, least(head, dst) AS component FROM t JOIN h ON t.k = h.k AND CASE WHEN source = 'src1' THEN source ELSE '' END = own JOIN f ON f.k = t.k
WHERE (SELECT count(*) FROM t t2 WHERE t2.k = t.k) > 1""")
def title_links_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a DOI join those of one publisher: components of title links."""
    t = _titled(spark, sf_dir).select("doc_id", "title_key", _ids(doi=F.when(F.col("source") == "src1", _text("10.5555/", F.col("source")))).alias("ids"))
    from scriptorium.operators.components import connected_components

    return connected_components(dedup.title_links(t, "doc_id")).select(F.col("node").alias("doc_id"), "component")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records: every third shares a DOI with its nation's like, every fourth a PMID with its segment's; titles
    spell the keys, so all are different."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    doi = F.when(k % 3 == 0, _text("10.5555/n", F.col("c_nationkey"), ".", F.floor(F.col("c_acctbal") / 500)))
    pmid = F.when(k % 4 == 0, _text("9", F.floor(F.col("c_acctbal") / 100) + 100))
    title = _text("customer", F.translate(k.cast("string"), "-0123456789", "kabcdefghij"))
    return conform(c.select(title.alias("title"), doi.alias("doi"), pmid.alias("pmid"), k.cast("string").alias("issue")), PAPER).withColumn("paper_id", F.col("issue").cast("long"))


_CUSTOMERS_SQL = """b AS (SELECT c_custkey AS id, 'd' || c_nationkey || '.' || floor(c_acctbal / 500)::BIGINT AS k FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'p' || floor(c_acctbal / 100)::BIGINT FROM customer WHERE c_custkey % 4 = 0), e AS (SELECT b.id AS src, h.dst FROM b JOIN (SELECT k, min(id) AS dst FROM b GROUP BY k) h USING (k) WHERE id <> dst)"""


@query(f"""{_EDGES_SQL.replace("WITH RECURSIVE ", f"WITH RECURSIVE {_CUSTOMERS_SQL}, ")}, m AS (SELECT node, min(reach) AS component FROM r GROUP BY node)
SELECT c_custkey AS paper_id, coalesce(component, c_custkey) AS cluster FROM customer LEFT JOIN m ON node = c_custkey""")
def dedup_exact_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of records that share a DOI or a PMID, through any number of others; titles are all different."""
    return dedup.clusters(_customers(spark, sf_dir), threshold=0.9999).select("paper_id", "cluster")


@query("""SELECT l_orderkey AS paper_id, count(*) AS n_records, arg_max('t' || l_linenumber || '.' || part, (CASE WHEN status = 'F' THEN 3 ELSE 1 END) * 100 - l_linenumber) AS title, max(quantity)::INT AS citation_count,
CASE WHEN bool_or(status = 'F') THEN 'journal' ELSE 'preprint' END AS venue_type, CASE WHEN bool_or(status = 'F') THEN '10.5555/f' || l_orderkey ELSE '10.48550/o' || l_orderkey END AS doi, string_agg(DISTINCT flag, ';' ORDER BY flag) AS sources
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, max(l_quantity) AS quantity, min(l_linestatus) AS status, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def merge_best_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as versions of one work: the best venue type gives the title, a publisher's DOI goes first."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_linestatus", "l_returnflag")
    n = lines.count()
    li = lines.repartition(tasks_of(spark, n), "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.max("l_quantity").alias("quantity"), F.min("l_linestatus").alias("status"), F.min("l_returnflag").alias("flag"))
    final = F.col("status") == "F"
    rows = li.select(
        _text("t", F.col("l_linenumber"), ".", F.col("part")).alias("title"), F.when(final, "journal").otherwise("preprint").alias("venue_type"), F.when(final, "radiology").otherwise("arxiv").alias("venue_key"), F.lit("v").alias("venue"),
        F.when(final, _text("10.5555/f", F.col("l_orderkey"))).otherwise(_text("10.48550/o", F.col("l_orderkey"))).alias("doi"), F.col("quantity").cast("int").alias("citation_count"), F.col("l_orderkey").cast("string").alias("issue"), F.array("flag").alias("sources"),
    )
    line = F.regexp_extract("title", r"^t(\d+)", 1).cast("int")
    df = conform(rows, PAPER).withColumns({"cluster": F.col("issue").cast("long"), "source_rank": line, "paper_id": F.regexp_extract("title", r"\.(\d+)$", 1).cast("long")})
    merged = dedup.merge_clusters(df, "paper_id", "cluster", "source_rank")
    found = merged.select(F.col("cluster").alias("paper_id"), "n_records", "title", "citation_count", "venue_type", "doi", F.array_join(F.array_sort("sources"), ";").alias("sources"))
    return settle(found, "merged", rows=n)[0]


@query("""SELECT p_partkey AS paper_id, CASE WHEN p_partkey % 3 = 0 THEN 'd' || p_partkey WHEN p_partkey % 3 = 1 THEN 'm' || p_partkey WHEN p_partkey % 6 = 2 THEN 't' || p_partkey END AS library_key,
CASE WHEN p_partkey % 3 = 0 THEN 'doi' WHEN p_partkey % 3 = 1 THEN 'pmid' WHEN p_partkey % 6 = 2 THEN 'title' END AS match_method FROM part""")
def id_cascade_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records matched with a library by identifiers in order of priority, then by title."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey")
    word = F.translate(k.cast("string"), "-0123456789", "kabcdefghij")
    title = _text("work of ", word, word, word, " and ", word)
    pmid = (100_000_000 + k).cast("string")  # nine digits, which no two keys share
    papers = conform(p.select(title.alias("title"), F.when(k % 3 < 2, _text("10.5555/", k)).alias("doi"), F.when(k % 3 == 1, pmid).alias("pmid"), k.cast("string").alias("issue")), PAPER)
    papers = papers.withColumn("paper_id", F.col("issue").cast("long"))
    row = lambda mark, fits, name, ids: p.where(fits).select(_text(mark, k).alias("key"), name.alias("title"), ids.alias("ids"), F.lit("journalArticle").alias("item_type"), F.lit(None).cast("int").alias("year"))
    library = (
        row("d", k % 3 == 0, F.lit("other name"), _ids(doi=_text("10.5555/", k), pmid=pmid))
        .unionAll(row("m", k % 3 == 1, _text("renamed ", word, word), _ids(pmid=pmid)))
        .unionAll(row("t", k % 6 == 2, title, F.create_map().cast("map<string,string>")))
    )
    return dedup.match_library(papers, library, threshold=0.9999).select("paper_id", "library_key", "match_method")


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, matched with labels as a library by id: labels of quality 0 are preprints, long documents are published."""
    lib = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    library = lib.select(_text("k", F.col("doc_id")).alias("key"), _ids(arxiv_id=F.when(F.col("quality") == 0, "1901.00001")).alias("ids"), F.when(F.col("quality") == 0, "preprint").otherwise("journalArticle").alias("item_type"))
    d = table(spark, sf_dir, "documents").join(lib, "doc_id", "left")
    published = F.col("n_chars") > 1000
    matched = d.select("doc_id", "source", F.when(published, _text("10.5555/", F.col("doc_id"))).alias("doi"), F.when(published, "journal").otherwise("preprint").alias("venue_type"), F.when(F.col("quality").isNotNull(), _text("k", F.col("doc_id"))).alias("library_key"))
    return dedup.route(matched, library)


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def library_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the library doesn't hold."""
    return _routed(spark, sf_dir).where("route = 'candidate'").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE NOT (quality = 0 AND n_chars > 1000)")
def library_existing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the library holds."""
    return _routed(spark, sf_dir).where("route = 'existing'").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND n_chars > 1000")
def preprint_upgrades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published rows whose preprint the library holds."""
    return _routed(spark, sf_dir).where("route = 'upgrade'").select("doc_id", "source")


@query("""SELECT c_custkey AS paper_id, min(s_suppkey) AS watched FROM customer JOIN supplier ON s_nationkey = c_nationkey AND right(s_name, 2) = right(c_name, 2) GROUP BY c_custkey""")
def author_watch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first watched author of each record: equal surnames (the number's end) and full given names (the nation)."""
    digits = lambda c: F.translate(c.cast("string"), "0123456789", "abcdefghij")
    name = lambda n, text: F.concat(F.lit("given"), digits(F.col(n)), F.lit(" sur"), digits(F.right(F.col(text), F.lit(2))))
    papers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper_id"), F.array(F.lit("Some Body"), name("c_nationkey", "c_name")).alias("authors"), F.array().cast(_LISTS).alias("author_ids"), F.lit(None).cast("string").alias("author_watch"))
    s = table(spark, sf_dir, "supplier").groupBy(name("s_nationkey", "s_name").alias("name")).agg(F.min("s_suppkey").alias("position"))
    found = authors.watch_authors(papers, s.select("position", "name", F.array().cast(_LISTS).alias("pinned")))
    return found.join(s.select(F.col("name").alias("author_watch"), F.col("position").alias("watched")), "author_watch").select("paper_id", "watched")


@query("""SELECT c_custkey AS paper_id, min(s_suppkey) AS watched FROM customer JOIN supplier ON s_suppkey = c_custkey % 400 GROUP BY 1""")
def pinned_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watched authors by pinned ids; another id of the same source is someone else's."""
    papers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper_id"), F.array(F.lit("Ada Quill")).alias("authors"), F.array(_text("openalex:A", F.col("c_custkey") % 400)).alias("author_ids"), F.lit(None).cast("string").alias("author_watch"))
    watched = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("position"), F.lit("Ada Quill").alias("name"), F.array(_text("openalex:A", F.col("s_suppkey"))).alias("pinned"))
    named = watched.withColumn("name", _text("Ada Quill ", F.translate(F.col("position").cast("string"), "0123456789", "abcdefghij")))
    found = authors.watch_authors(papers, named).where("author_watch is not null")
    return found.join(named.select(F.col("name").alias("author_watch"), "position"), "author_watch").select("paper_id", F.col("position").alias("watched"))


@query("""SELECT c_custkey, c_custkey % 4 < 2 AS guarded, c_custkey % 4 = 0 AS strict FROM customer""")
def byline_guard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bylines that can hold an author: none given, or a name that fits; initials fit unless the match is strict."""
    k = F.col("c_custkey")
    names = F.when(k % 4 == 0, F.array(F.lit("José  Álvarez"))).when(k % 4 == 1, F.array(F.lit("B. C"), F.lit("J. Alvarez"))).when(k % 4 == 2, F.array(F.lit("Juan Alvarez"))).otherwise(F.array(F.lit("Jose Alvares")))
    c = table(spark, sf_dir, "customer").select(k, names.alias("a"))
    return c.select("c_custkey", authors.byline_guard(F.col("a"), "Jose Alvarez").alias("guarded"), F.exists("a", lambda a: authors.name_matches(F.lit("Jose Alvarez"), a, strict=True)).alias("strict"))


@query("""SELECT n_nationkey, 'jo' || regexp_extract(lower(n_name), '^[a-z]+') || ' o-connor' AS key FROM nation""")
def author_name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in plain lower-case letters: accents, points and digits gone, hyphens kept."""
    c = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("  Jö"), F.col("n_name"), F.lit("  O-Cönnor 3.")).alias("a"))
    return c.select("n_nationkey", X.normalize_author_name(F.col("a")).alias("key"))


_ARXIV = ("1901.%s", "arXiv:1901.%sv2", "https://arxiv.org/abs/1901.%s", "10.48550/arXiv.1901.%s", "hep-th/99%s", "nothing %s")


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 5 THEN NULL WHEN 4 THEN 'hep-th/99' || n ELSE '1901.' || n END AS arxiv_id, '77' || n AS pmid FROM (SELECT p_partkey, lpad((p_partkey % 99999)::VARCHAR, 5, '0') AS n FROM part)")
def arxiv_and_pubmed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versionless arXiv ids out of ids, URLs and DOIs, and PubMed ids out of text."""
    k = F.col("p_partkey")
    n = F.lpad((k % 99999).cast("string"), 5, "0")
    said = F.lit(None).cast("string")
    for i, form in enumerate(_ARXIV):
        said = F.when(k % 6 == i, _text(form.split("%s")[0], n, form.split("%s")[1])).otherwise(said)
    return table(spark, sf_dir, "part").select("p_partkey", X.normalize_arxiv_id(said).alias("arxiv_id"), X.normalize_pmid(_text("PMID:77", n)).alias("pmid"))


@query("""SELECT p_partkey, p_size % 4 < 2 AS preprint, 'part ' || p_size AS file FROM part""")
def preprint_registrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a DOI was registered by a preprint server, and safe names of files from URLs."""
    n = F.col("p_size")
    doi = F.when(n % 4 == 0, _text("10.48550/ARXIV.", n)).when(n % 4 == 1, _text("10.1101/", n)).when(n % 4 == 2, _text("10.1148/", n))
    file = X.safe_filename(_text("https://h.org/a/part ", n, "/"))
    return table(spark, sf_dir, "part").select("p_partkey", X.is_preprint_doi(doi).alias("preprint"), F.regexp_replace(F.regexp_replace(file, "_", " "), r"\.pdf$", "").alias("file"))


_VENUES = (
    ("Proceedings of the 37th International Conference on Machine Learning", "conference", "icml", "conference", "ICML 2020", "venue:icml"),
    ("International Conference on Machine Learning and Cybernetics", "conference", "other_conference", "conference", "International Conference on Machine Learning and Cybernetics 2020", None),
    ("NeurIPS 2020 Workshop on Looms", None, "neurips", "workshop", "NeurIPS 2020", "venue:neurips"),
    ("Medical Image Analysis", "journal", "medical_image_analysis", "journal", "MedIA 2020", "venue:media"),
    ("arXiv.org", "repository", "arxiv", "preprint", "arXiv 2020", "venue:arxiv"),
    ("Journal of Looms", None, "other_journal", "journal", "Journal of Looms 2020", None),
    ("", None, "unknown", "preprint", "Unknown venue 2020", None),
    ("Research Square", "posted-content", "medrxiv", "preprint", "Research Square 2020", None),
)


@query("SELECT p_partkey, venue_key, venue_type, shown, tag FROM part JOIN (VALUES " + ", ".join(f"({i}, '{k}', '{t}', '{s}', {'NULL' if g is None else repr(g)})" for i, (_, _, k, t, s, g) in enumerate(_VENUES)) + f") v(i, venue_key, venue_type, shown, tag) ON p_partkey % {len(_VENUES)} = i")
def venue_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical keys, types, tags and display names of venue strings."""
    named = spark.createDataFrame([(i, v, h) for i, (v, h, *_) in enumerate(_VENUES)], "i int, venue string, hint string")
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(_VENUES)).cast("int").alias("i")).join(F.broadcast(named), "i")
    p = p.withColumn("c", canonical_venue(F.col("venue"), F.col("hint")))
    return p.select("p_partkey", F.col("c.key").alias("venue_key"), F.col("c.type").alias("venue_type"), venue_display(F.col("c.key"), F.col("venue"), F.lit(2020)).alias("shown"), venue_tag(F.col("c.key")).alias("tag"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'NeurIPS 2021' WHEN 1 THEN 'IEEE TMI' ELSE '' END AS name FROM nation")
def conference_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of conferences with their years."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k, conference_name(F.when(k % 3 == 0, "neurips").when(k % 3 == 1, "tmi").otherwise("no_such"), F.when(k % 3 == 0, 2021)).alias("name"))


@query("""SELECT l_orderkey, min(l_suppkey) AS published FROM (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) - 1 AS place, l_returnflag FROM lineitem)
WHERE place < 3 AND l_returnflag = 'R' AND place = (SELECT 0) GROUP BY 1""")
def published_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preprint's published version: its first hit here, if it is a journal paper of its title and not older."""
    from scriptorium.operators.topk import best_per_group

    li = table(spark, sf_dir, "lineitem")
    word = F.translate(F.col("l_orderkey").cast("string"), "0123456789", "abcdefghij")
    ranked = best_per_group(li, "l_orderkey", F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey"), k=5)
    first = F.col("place") == 1
    hits = ranked.select(
        F.col("l_orderkey").alias("paper_id"), (F.col("place") - 1).alias("place"), F.col("l_suppkey").alias("hit_id"), F.when(first, _text("weaving of ", word, " in towns")).otherwise("another work").alias("hit_key"),
        F.when(F.col("l_returnflag") == "R", "journal").otherwise("preprint").alias("hit_type"), F.lit(2020).alias("hit_year"),
    )
    papers = li.select("l_orderkey").distinct().select(F.col("l_orderkey").alias("paper_id"), _text("weaving of ", word, " in towns").alias("title_key"), F.lit(2019).alias("year"))
    return enrich.published_version(papers, hits).select(F.col("paper_id").alias("l_orderkey"), F.col("published_id").alias("published"))


@query("""SELECT l_orderkey AS doc_id, CAST(l_linenumber AS VARCHAR) AS bid, min(p_partkey) AS ref_id FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN (SELECT DISTINCT l_orderkey AS o, l_partkey FROM lineitem) ON o = l_orderkey
JOIN part ON p_partkey = l_partkey WHERE l_linenumber % 2 = 1 AND length('the ' || lower(p_name) || ' story of the weavers') >= 12 AND p_size % 7 = l_linenumber % 7 GROUP BY 1, 2""")
def bibliography_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a bibliography to the first trusted reference of the same document whose title they hold."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    title = lambda name, n: _text("the ", F.lower(name), " story of the weavers ", F.translate((n % 7).cast("string"), "0123456", "abcdefg"))
    refs = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("p_partkey")).distinct().join(part, "p_partkey")
    refs = refs.select("doc_id", F.col("p_partkey").alias("ref_pos"), F.col("p_partkey").alias("ref_id"), title(F.col("p_name"), F.col("p_size")).alias("ref_key"))
    names = refs.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("ref_key")), " | ").alias("all_keys"))
    lines = li.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber").distinct()
    kept = F.array_join(F.filter(F.split("all_keys", r" \| "), lambda t: t.endswith(F.concat(F.lit(" "), F.translate((F.col("l_linenumber") % 7).cast("string"), "0123456", "abcdefg")))), " | ")
    bib = lines.join(names, "doc_id").select("doc_id", F.col("l_linenumber").cast("string").alias("bid"), kept.alias("entry_key"), F.lit(None).cast("string").alias("title_key"))
    return fulltext.map_bibliography(bib, refs)


@query("""WITH p AS (SELECT r_name || '/' || n_name AS path FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'Attic/' || n_name FROM nation WHERE n_nationkey < 5)
SELECT path FROM p WHERE lower(split_part(path, '/', 2)) = (SELECT lower(n_name) FROM nation WHERE n_nationkey = 3) AND path LIKE 'Attic/%'""")
def paths_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path by its last segments, those under the root first."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    paths = n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("path")).unionAll(n.where("n_nationkey < 5").select(F.concat(F.lit("Attic/"), "n_name").alias("path")))
    wanted = n.where("n_nationkey = 3").first()["n_name"]  # one row of a fixed table names what is asked for
    return graph.resolve_path(paths, wanted.upper(), "Attic").select("path")


@query("""SELECT p_partkey, p_size % 3 = 0 AS by_short, p_size % 3 <> 2 AS by_words FROM part""")
def short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that go by a short name: the part before a colon, or three first words."""
    n = F.col("p_size")
    key = F.when(n % 3 == 0, "loomnet weaves of the north").when(n % 3 == 1, "weaves of the north").otherwise("other weaves of north")
    head = F.when(n % 3 == 0, "loomnet").otherwise(key)
    short = graph.short_name_match(head, key, "loomnet")
    return table(spark, sf_dir, "part").select("p_partkey", short.alias("by_short"), (short | graph.short_name_match(head, key, "weaves of the")).alias("by_words"))


_RELATION_SQL = "CASE WHEN kind = 'dataset' THEN 'benchmark/dataset' WHEN base = 'citing' AND unsure THEN 'uncertainty/reliability extension' WHEN base = 'reference' THEN CASE WHEN year < 2014 OR cites > 200 THEN 'foundational predecessor' ELSE 'direct competitor' END WHEN base = 'citing' THEN 'methodological follow-up' WHEN abs(year - 2015) <= 1 THEN 'direct competitor' ELSE 'related work' END"


@query(f"""SELECT p_partkey, {_RELATION_SQL} AS relation FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'dataset' ELSE '' END AS kind, CASE p_partkey % 3 WHEN 0 THEN 'reference' WHEN 1 THEN 'citing' ELSE 'similar' END AS base,
p_partkey % 4 = 0 AS unsure, 1990 + p_size % 30 AS year, p_size * 5 AS cites FROM part)""")
def relations_to_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What records are to the seed that they were found from."""
    k, n = F.col("p_partkey"), F.col("p_size")
    told = lambda fits, what: F.when(fits, F.array(F.lit(what))).otherwise(F.array().cast(_LISTS))
    base = F.when(k % 3 == 0, "reference").when(k % 3 == 1, "citing").otherwise("similar")
    relation = graph.relationship(base, 1990 + n % 30, n * 5, told(k % 4 == 0, "uncertainty"), told(k % 10 == 0, "type:benchmark-dataset"), 2015, ("vlm",))
    return table(spark, sf_dir, "part").select("p_partkey", relation.alias("relation"))


@query("""SELECT p_partkey FROM part WHERE lower(p_name) <> (SELECT lower(p_name) FROM part WHERE p_partkey = 8)""")
def seed_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records but those that are the seed itself under another identifier."""
    p = table(spark, sf_dir, "part").select("p_partkey", X.normalize_title(F.col("p_name"), unicode=False).alias("title_key"))
    seed = p.where("p_partkey = 8").first()["title_key"]
    return graph.without_seed(p, seed).select("p_partkey")


@query("""SELECT p_partkey, array_to_string(list_sort(CASE p_size % 3 WHEN 0 THEN ['2'] WHEN 1 THEN ['3d', 'iv'] ELSE [] END), ';') AS tokens FROM part""")
def distinguishing_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that make nearly equal titles different works."""
    n = F.col("p_size")
    key = F.when(n % 3 == 0, "the weaving part 2").when(n % 3 == 1, "the 3d weaving volume iv").otherwise("the weaving")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.distinguishing_tokens(key), ";").alias("tokens"))


@query("""SELECT o_orderkey, o_totalprice / 600000 >= 0.3 AND o_orderstatus <> 'P' AND (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) AS promising FROM orders""")
def promising_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records worth a look-up: relevant, of a type that can be read, and with something missing."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        k, (F.col("o_totalprice") / 600000).alias("relevance_score"), F.struct((F.col("o_orderstatus") == "P").alias("excluded_type")).alias("scores"),
        F.when(k % 3 != 0, "text").alias("abstract"), F.when(k % 5 != 0, "Annals").otherwise("").alias("venue"), F.lit(1).alias("citation_count"),
    )
    return o.select("o_orderkey", enrich.promising(o).alias("promising"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN 'd' || c_custkey END, 'p' || c_custkey) AS one FROM customer""")
def records_with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's identifiers as a map, and a row for each in order of priority."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    df = c.select(k, F.when(k % 3 != 0, _text("D", k)).otherwise("").alias("doi"), _text("p", k).alias("pmid"), *[F.lit(None).cast("string").alias(n) for n in ("arxiv_id", "openalex_id", "semantic_scholar_id")])
    pairs = dedup.id_pairs(records.with_ids(df), "c_custkey")
    return pairs.groupBy("c_custkey").agg(F.min_by("value", "priority").alias("one"))
