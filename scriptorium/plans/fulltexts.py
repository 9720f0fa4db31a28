"""Queries on full texts, similar titles and misspelled words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import html_text, seed_tag, title_similarity
from scriptorium.operators import dedup, fulltext
from scriptorium.plans.prompt import TRIGGERS, typo_candidates
from scriptorium.plans.registry import query
from scriptorium.session import spread, table


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# orders as papers: lines are citations of parts; returned ones are compared with, final ones stand in a table
_LINES_SQL = "l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, min(l_returnflag) AS flag, min(l_linestatus) AS status FROM lineitem GROUP BY 1, 2, 3)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page): an order as a paper in the HTML of LaTeXML."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey").agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
    k = F.col("l_partkey")
    cited = _text('<a href="#bib.bib', k, '">', k, "</a>")
    entry = _text('<li id="bib.bib', k, '" class="ltx_bibitem"><span class="ltx_bibblock">A. Weaver</span><span class="ltx_bibblock">Looms of part ', k, ".</span></li>")
    place = lambda value, fits: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(fits, F.struct("l_linenumber", "l_partkey", value.alias("v"))))), lambda s: s["v"]), "")
    compared, final = F.col("flag") == "R", F.col("status") == "F"
    parts = li.groupBy("doc_id").agg(
        place(_text("<p>We follow ", cited, ".</p>"), ~compared).alias("related"), place(_text("<p>We beat ", cited, ".</p>"), compared).alias("beaten"), place(cited, final).alias("cells"),
        F.array_join(F.array_sort(F.collect_set(entry)), "").alias("bib"),
    )
    figure = F.when(F.col("cells") != "", F.concat(F.lit('<figure id="T1" class="ltx_table">'), "cells", F.lit("</figure>"))).otherwise("")
    page = _text(
        '<section id="S1" class="ltx_section"><h2>1 Related Work</h2>', F.col("related"), '</section><section id="S2" class="ltx_section"><h2>2 Experiments</h2><section id="S2.SS1" class="ltx_subsection"><h3>2.1 Baselines</h3>',
        F.col("beaten"), figure, '</section></section><section id="S3" class="ltx_section"><h2>3 Conclusion</h2><p>The end.</p></section><section class="ltx_bibliography"><ul class="ltx_biblist">', F.col("bib"), "</ul></section>",
    )
    return parts.select("doc_id", page.alias("page"))


@query(f"""WITH {_LINES_SQL}, d AS (SELECT o, count(*) FILTER (WHERE flag <> 'R') AS r, count(*) FILTER (WHERE flag = 'R') AS b, count(*) FILTER (WHERE status = 'F') AS f FROM l GROUP BY 1)
SELECT o AS doc_id, title, chosen, n::BIGINT AS n_cited FROM (SELECT o, '1 Related Work' AS title, TRUE AS chosen, r AS n FROM d WHERE r > 0 UNION ALL SELECT o, '2 Experiments / 2.1 Baselines', TRUE, b + f FROM d WHERE b + f > 0
UNION ALL SELECT o, '3 Conclusion', FALSE, 0 FROM d)""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of full texts, those chosen that tell what a paper compares itself with, and their citations."""
    parts = fulltext.sections(fulltext.documents(_pages(spark, sf_dir)))
    return parts.select("doc_id", "title", F.col("is_chosen").alias("chosen"), F.regexp_count("text", F.lit(fulltext.MARKER)).cast("long").alias("n_cited"))


@query(f"""WITH {_LINES_SQL} SELECT o AS doc_id, 'bib' || p AS bid, 'Looms of part ' || p AS title FROM l GROUP BY 1, p""")
def bibliographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of bibliographies with their titles."""
    docs = fulltext.documents(_pages(spark, sf_dir))
    return docs.select("doc_id", F.explode("document.bib").alias("b")).select("doc_id", "b.bid", "b.title")


@query(f"""WITH {_LINES_SQL} SELECT o AS doc_id, 'bib' || p AS bid, count(*) FILTER (WHERE flag = 'R') + count(*) FILTER (WHERE status = 'F') AS experiments, count(*) FILTER (WHERE status = 'F') AS tables, count(*) FILTER (WHERE flag <> 'R') AS related,
count(*) FILTER (WHERE flag = 'R') + count(*) FILTER (WHERE status = 'F') AS baseline_section, CASE WHEN bool_or(flag = 'R') THEN 'We beat ' || p || ' .' END AS told FROM l GROUP BY o, p""")
def fulltext_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of each reference by kind of section and in tables, with a sentence that compares."""
    signals = fulltext.citation_signals(fulltext.documents(_pages(spark, sf_dir)))
    said = F.get(F.filter("snippets", lambda s: s.startswith("We beat ")), F.lit(0))
    return signals.select("doc_id", "bid", "experiments", "tables", "related", "baseline_section", said.alias("told"))


@query("""SELECT c_custkey AS doc_id, unnest(['Methods', 'Methods / Looms', 'Results']) AS title, unnest(['The ' || c_mktsegment || ' looms . 1 [bib:r1]', 'Threads.', '[TABLE] wool [/TABLE]']) AS text FROM customer""")
def jats_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of JATS XML, nested ones with the path of their titles."""
    xml = _text(
        '<article xmlns:x="u"><body><sec><title>Methods</title><p>The ', F.col("c_mktsegment"), ' looms .<xref ref-type="bibr" rid="r1">1</xref></p><sec><title>Looms</title><p>Threads.</p></sec></sec>',
        "<sec><title>Results</title><table-wrap><td>wool</td></table-wrap></sec></body><back><ref-list><ref id=\"r1\"><article-title>A tale</article-title></ref></ref-list></back></article>",
    )
    docs = fulltext.documents(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), xml.alias("page")))
    rows = docs.select("doc_id", F.explode("document.sections").alias("s")).select("doc_id", "s.title", "s.text")
    return rows.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))


@query("""SELECT l_orderkey AS doc_id, 'LOOM' || 'ABCDEFG'[1 + l_linenumber % 7] AS name, min('bib' || l_partkey) AS bid FROM lineitem GROUP BY 1, 2, l_linenumber % 7 HAVING count(DISTINCT l_partkey) = 1""")
def method_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of methods that stand before the citations of one reference only."""
    letter = F.substring(F.lit("ABCDEFG"), (F.col("l_linenumber") % 7 + 1).cast("int"), F.lit(1))
    said = _text("see LOOM", letter, " (Weaver et al., 2020) [bib", F.col("l_partkey"), "] here. ")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.collect_list(said), "").alias("text"))
    return fulltext.method_aliases(rows)


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a < b & "c"' ELSE 'plain' END AS text FROM pages""")
def readable_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable text of HTML: scripts and tags gone, entities resolved."""
    body = F.when(F.col("page_id") % 2 == 0, "<p>a &lt; b</p><script>var x = '<b>';</script> &amp; <i>&quot;c&quot;</i>").otherwise(" <style>p {}</style>plain ")
    return table(spark, sf_dir, "pages").select("page_id", html_text(body).alias("text"))


@query("""SELECT p_partkey, 'weaver' || (1990 + p_size) || '-looms' AS tag FROM part""")
def seed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surname, year and first long title word."""
    return table(spark, sf_dir, "part").select("p_partkey", seed_tag(F.lit("Ada B. Weaver"), 1990 + F.col("p_size"), F.lit("on the looms of towns")).alias("tag"))


def _tales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records: two neighbours share a title of 40 letters but for two letters at its end; some pairs have DOIs."""
    k = F.col("p_partkey")
    body = F.translate(F.md5((F.floor(k / 2)).cast("string")), "0123456789", "ghijklmnop")
    title = F.concat(F.lit("tale of "), body, F.when(k % 2 == 1, " x").otherwise(""))
    ids = F.when(F.floor(k / 2) % 5 == 0, F.create_map(F.lit("doi"), _text("10.5555/", k))).otherwise(F.create_map().cast("map<string,string>"))
    return spread(table(spark, sf_dir, "part").select("p_partkey")).select(k.alias("paper_id"), title.alias("title_key"), ids.alias("ids"))


@query("""SELECT b.p_partkey AS src, a.p_partkey AS dst, round(80.0 / 82.0, 4)::DOUBLE AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 2 = 0 AND (a.p_partkey // 2) % 5 <> 0""")
def fuzzy_title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of similar titles, but those whose publisher DOIs tell them apart."""
    return dedup.fuzzy_links(_tales(spark, sf_dir), "paper_id", 0.96).select("src", "dst", F.round("similarity", 4).alias("similarity"))


@query("""SELECT p_partkey AS paper_id, CASE WHEN p_partkey % 2 = 1 AND (p_partkey // 2) % 5 <> 0 AND p_partkey - 1 IN (SELECT p_partkey FROM part) THEN p_partkey - 1 ELSE p_partkey END AS cluster FROM part""")
def fuzzy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the same work by similar titles."""
    from scriptorium.schema import PAPER, conform

    t = _tales(spark, sf_dir)
    papers = conform(t.select(F.col("title_key").alias("title"), F.try_element_at("ids", F.lit("doi")).alias("doi"), F.col("paper_id").cast("string").alias("issue")), PAPER).withColumn("paper_id", F.col("issue").cast("long"))
    return dedup.clusters(papers).select("paper_id", "cluster")


@query("""SELECT p_partkey AS paper_id, CASE WHEN p_partkey % 2 = 1 AND (p_partkey // 2) % 5 <> 0 AND p_partkey - 1 IN (SELECT p_partkey FROM part) THEN p_partkey - 1 ELSE p_partkey END AS cluster FROM part""")
def clusters_in_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the same work by similar titles, taken in by a forest in two runs: even ones first, then those that join them."""
    from scriptorium.operators.forest import Forest
    from scriptorium.schema import PAPER, conform
    from scriptorium.session import scratch_path

    t = _tales(spark, sf_dir)
    papers = conform(t.select(F.col("title_key").alias("title"), F.try_element_at("ids", F.lit("doi")).alias("doi"), F.col("paper_id").cast("string").alias("issue")), PAPER).withColumn("paper_id", F.col("issue").cast("long"))
    forest = Forest(spark, scratch_path(spark, "forest"))
    for run in range(2):
        forest.add(papers.where(F.col("paper_id") % 2 == run), run)
    return forest.clusters()


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN round(2 * 20.0 / 41, 4) WHEN 2 THEN round(2 * 19.0 / 40, 4) ELSE 0.0 END::DOUBLE AS similarity FROM part""")
def title_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of title keys: equal ones, one with a letter more, one with another letter, and one too short to compare."""
    k = F.col("p_partkey")
    a = F.lit("abcdefghijklmnopqrst")
    b = F.when(k % 4 == 0, a).when(k % 4 == 1, F.concat(a, F.lit("z"))).when(k % 4 == 2, F.lit("abcdefghi1klmnopqrst")).otherwise(F.lit("abc"))
    return table(spark, sf_dir, "part").select(k, F.round(title_similarity(a, b), 4).alias("similarity"))


_WORDS_SQL = "(VALUES " + ", ".join(f"('{w}')" for w in TRIGGERS) + ") v(word)"


@query(f"""WITH t AS (SELECT DISTINCT token FROM (SELECT unnest(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')) AS token FROM documents) WHERE regexp_full_match(token, '[a-z]+') AND length(token) >= 5),
m AS (SELECT token, word, damerau_levenshtein(token, word)::INT AS distance, CASE WHEN length(token) <= 7 THEN 1 ELSE 2 END AS most FROM t JOIN {_WORDS_SQL} ON left(token, 1) = left(word, 1) AND abs(length(token) - length(word)) <= 2 AND token <> word),
n AS (SELECT token, word, distance FROM m WHERE distance <= most), b AS (SELECT token, min(distance) AS distance FROM n GROUP BY 1)
SELECT token, distance, min(word) AS word FROM n JOIN b USING (token, distance) GROUP BY 1, 2 HAVING count(*) = 1""")
def typo_correction_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole words of documents that are misspellings of one trigger word, by a blocked join."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    d = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(words)).alias("token")).where(F.col("token").rlike("^[a-z]{5,}$"))
    vocabulary = spark.createDataFrame([(w,) for w in TRIGGERS], "word string")
    return typo_candidates(d, vocabulary)
