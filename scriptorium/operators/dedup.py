"""Entity resolution: identifier and title matches, connected components, and the merge of each component.

Links come from equal identifiers, from equal title keys, and from similar title keys; title links are dropped where
publisher DOIs or arXiv ids prove different works. Candidates for similar titles share their distinguishing tokens and a
piece of text, by equi-joins; pieces are lossless for the threshold (see _piece_pairs).
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import ID_FIELDS, blank, distinguishing_tokens, is_preprint_doi, title_likeness
from scriptorium.functions.venues import GENERIC_VENUES, type_rank
from scriptorium.operators.components import connected_components
from scriptorium.operators.records import is_preprint_record, peer_reviewed, with_ids, with_title_key
from scriptorium.session import settle


def id_pairs(df: DataFrame, key: str) -> DataFrame:
    """(key, priority, kind, value): a row for each identifier."""
    listed = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(n).alias("kind"), F.lower(F.try_element_at("ids", F.lit(n))).alias("value")) for i, n in enumerate(ID_FIELDS)])
    return df.select(key, F.explode(listed).alias("id")).select(key, "id.*").where(~blank(F.col("value")))


def conflict(ids_a: Column, ids_b: Column) -> Column:
    """Whether two records are proven different: other publisher DOIs, or other arXiv ids."""
    doi = lambda m: F.lower(F.try_element_at(m, F.lit("doi")))
    arxiv = lambda m: F.lower(F.try_element_at(m, F.lit("arxiv_id")))
    published = ~blank(doi(ids_a)) & ~blank(doi(ids_b)) & ~is_preprint_doi(doi(ids_a)) & ~is_preprint_doi(doi(ids_b))
    return F.coalesce(published & (doi(ids_a) != doi(ids_b)), F.lit(False)) | F.coalesce(~blank(arxiv(ids_a)) & ~blank(arxiv(ids_b)) & (arxiv(ids_a) != arxiv(ids_b)), F.lit(False))


def id_links(df: DataFrame, key: str) -> DataFrame:
    """(src, dst): each record with an identifier, to the smallest that has it: a star for each value, not all pairs."""
    pairs = id_pairs(df, key)
    heads = pairs.groupBy("kind", "value").agg(F.min(key).alias("dst"), F.count("*").alias("n")).where("n > 1")
    return pairs.join(heads, ["kind", "value"]).where(F.col(key) != F.col("dst")).select(F.col(key).alias("src"), "dst")


def title_links(df: DataFrame, key: str) -> DataFrame:
    """(src, dst) links that join what equal title keys without a conflict join.

    Records of a title are first reduced to one head for each (publisher DOI, arXiv id). A head without either fits any
    other of its title; else a head without an arXiv id fits those of its DOI, one without a DOI those of its arXiv id, and
    each of the former each of the latter. All of these are stars around a smallest head, so a title that thousands of DOIs
    share gives as many rows as heads, never their pairs.
    """
    doi = F.lower(F.coalesce(F.try_element_at("ids", F.lit("doi")), F.lit("")))
    keyed = df.where(~blank(F.col("title_key"))).select(
        key, "title_key", F.when(is_preprint_doi(doi), "").otherwise(doi).alias("own_doi"), F.lower(F.coalesce(F.try_element_at("ids", F.lit("arxiv_id")), F.lit(""))).alias("own_arxiv")
    )
    heads = keyed.groupBy("title_key", "own_doi", "own_arxiv").agg(F.min(key).alias("head"))
    inside = keyed.join(heads, ["title_key", "own_doi", "own_arxiv"]).where(F.col(key) != F.col("head")).select(F.col(key).alias("src"), F.col("head").alias("dst"))
    no_doi, no_arxiv = F.col("own_doi") == "", F.col("own_arxiv") == ""
    least = lambda fits: F.min(F.when(fits, F.col("head")))
    by_title = heads.groupBy("title_key").agg(least(no_doi & no_arxiv).alias("free"), least(no_arxiv & ~no_doi).alias("of_doi"), least(no_doi & ~no_arxiv).alias("of_arxiv"))
    by_doi = heads.where(no_arxiv & ~no_doi).select("title_key", "own_doi", F.col("head").alias("same_doi"))
    by_arxiv = heads.where(no_doi & ~no_arxiv).select("title_key", "own_arxiv", F.col("head").alias("same_arxiv"))
    met = heads.join(by_title, "title_key").join(by_doi, ["title_key", "own_doi"], "left").join(by_arxiv, ["title_key", "own_arxiv"], "left")
    other = F.when(no_doi, F.col("of_doi")).when(no_arxiv, F.col("of_arxiv"))
    to = F.when(F.col("free").isNotNull(), F.array("free")).otherwise(F.array("same_doi", "same_arxiv", other))
    across = met.select("head", F.explode(F.array_compact(to)).alias("to")).where("head <> to")
    return inside.unionAll(across.select(F.greatest("head", "to").alias("src"), F.least("head", "to").alias("dst")).distinct())


#: Longest title whose pieces are joined; longer ones, mostly texts in the wrong field, meet those of about their length.
LONG_TITLE = 400
#: A piece that more titles hold is common: their rarest stretch is cut instead, into pieces of at least LEAST_PIECE letters.
COMMON, LEAST_PIECE = 50, 4


def fuzzy_links(df: DataFrame, key: str, threshold: float = 0.96, side: str | None = None) -> DataFrame:
    """(src, dst, similarity) of similar title keys with equal distinguishing tokens and no conflict.

    side: a boolean column; only titles of different sides are compared, src being one whose side is true. Blocking is
    lossless (_piece_pairs). Equal titles of a side are one row before any comparison, and the edit distance, computed in
    the JVM, goes before the ratio. Titles beyond LONG_TITLE meet by length instead. Titles so short that no letter of them
    may differ are left out first (least_length).
    """
    given = df.where(~blank(F.col("title_key"))).withColumn("side", F.col(side) if side else F.lit(None).cast("boolean"))
    given = given.where(F.length("title_key") >= least_length(threshold))
    heads = given.groupBy("title_key", "side").agg(F.min(key).alias("node"), F.min_by("ids", key).alias("ids"))
    heads, _ = settle(heads.withColumns({"tokens": F.array_join(distinguishing_tokens(F.col("title_key")), " "), "size": F.length("title_key")}), "titles")
    if len(heads.select("node").limit(2).collect()) < 2:
        return df.sparkSession.createDataFrame([], f"src {heads.schema['node'].dataType.simpleString()}, dst {heads.schema['node'].dataType.simpleString()}, similarity double")
    pairs = _piece_pairs(heads.where(F.col("size") <= LONG_TITLE), threshold).unionAll(_length_pairs(heads, threshold))
    named = lambda n, title: heads.select(F.col("node").alias(n), F.col("title_key").alias(title), F.col("ids").alias(f"{title}_ids"), F.col("tokens").alias(f"{title}_tokens"), F.col("side").alias(f"{title}_side"))
    if side:
        met = pairs.select(F.when(F.col("side"), F.col("a")).otherwise(F.col("b")).alias("src"), F.when(F.col("side"), F.col("b")).otherwise(F.col("a")).alias("dst"))
    else:
        met = pairs.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst"))
    apart = F.floor((F.length("new") + F.length("old")) * (1 - threshold) + 1e-9)
    long = F.greatest(F.length("new"), F.length("old")) > LONG_TITLE
    both = met.distinct().join(named("src", "new"), "src").join(named("dst", "old"), "dst").where("new_tokens = old_tokens")
    near = both.where(~conflict(F.col("new_ids"), F.col("old_ids"))).where(long | (F.levenshtein("new", "old") <= apart))
    scored = near.withColumn("similarity", title_likeness(F.col("new"), F.col("old")))
    return scored.where(F.col("similarity") >= threshold).select("src", "dst", "similarity")


def length_classes(threshold: float, longest: int = LONG_TITLE) -> list[tuple[int, int, int, int]]:
    """(least, most, edits, width): lengths in classes, the letters outside matching blocks that a shorter title of the class
    and its longer partner may have together, and the width of edits + 1 pieces of the shorter one."""
    if threshold < 0.7:
        raise ValueError("below a ratio of 0.7 titles have no pieces to join by")
    reach, found, low = 2 / threshold - 1, [], 1
    while low <= longest:
        high = max(low, math.floor(low * reach + 1e-9))
        edits = math.floor((1 - threshold) * (high + math.floor(high * reach + 1e-9)) + 1e-9)
        while low // (edits + 1) == 0 and high > low:
            high -= 1
            edits = math.floor((1 - threshold) * (high + math.floor(high * reach + 1e-9)) + 1e-9)
        if edits:
            found.append((low, high, edits, low // (edits + 1)))
        low = high + 1
    return found


def least_length(threshold: float) -> int:
    """The length of the shortest title that can be similar to another: it is of a class, or about as long as those beyond LONG_TITLE."""
    return min([low for low, *_ in length_classes(threshold)] + [int(LONG_TITLE * threshold / (2 - threshold))])


def _lengths(spark: SparkSession, threshold: float) -> tuple[DataFrame, DataFrame]:
    """For each length, at most LONG_TITLE of them: (size, c, edits, width), its class as the shorter title, and (size, c, edits,
    width, least_gap, most_gap), the classes of shorter partners, with how much shorter those are. Both are empty where the
    threshold lets no letter of such titles differ."""
    reach, own, other = 2 / threshold - 1, [], []
    classes = length_classes(threshold)
    for c, (low, high, edits, width) in enumerate(classes):
        for size in range(low, min(LONG_TITLE, math.floor(high * reach + 1e-9)) + 1):
            if size <= high:
                own.append((size, c, edits, width))
            gaps = [size - n for n in range(low, min(high, size) + 1) if size <= n * reach + 1e-9]
            if gaps:
                other.append((size, c, edits, width, min(gaps), max(gaps)))
    made = lambda rows, *names: spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], pa.int32()) for i, n in enumerate(names)}))  # noqa: E731  Arrow goes to the JVM without Python workers
    return made(own, "size", "c", "edits", "width"), made(other, "size", "c", "edits", "width", "least_gap", "most_gap")


#: Where piece i may stand in the longer title: no more letters were added or lost before it than i, nor after it than edits - i.
_SHIFTS = "sequence(greatest(0, {begin} + i * width + greatest(-i, least_gap - (edits - i))), least(size - width, {begin} + i * width + least(i, most_gap + edits - i)))"


def _asked(titles: DataFrame, begin: str) -> DataFrame:
    """A row (b, side, hash) for each text that a shorter title's piece may be in a title; begin: where the pieces start."""
    places = _SHIFTS.format(begin=begin)
    each = F.expr(f"transform(sequence(0, edits), i -> transform(filter({places}, at -> at >= 0 and at <= size - width), at -> xxhash64(tokens, c, {begin}, width, i, substring(title_key, at + 1, width))))")
    return titles.select(F.col("node").alias("b"), "side", F.explode(F.array_distinct(F.flatten(each))).alias("hash"))


def _pieces(titles: DataFrame, begin: str) -> DataFrame:
    """A row (a, side, i, hash) for each of a title's edits + 1 pieces of `width` letters from `begin` on."""
    each = F.expr(f"transform(sequence(0, edits), i -> xxhash64(tokens, c, {begin}, width, i, substring(title_key, {begin} + i * width + 1, width)))")
    return titles.select(F.col("node").alias("a"), "side", F.posexplode(each).alias("i", "hash"))


def _piece_pairs(heads: DataFrame, threshold: float, common: int = COMMON) -> DataFrame:
    """(a, b, side) of titles of which the longer one, b, holds a piece of the shorter one where it may stand; side is a's.

    A ratio of t or more lets at most d = (1 - t)(|a| + |b|) letters of both lie outside the matching blocks. Of d + 1 pieces
    of a, then, some piece i is whole in b with just i such letters before it and at most d - i after it: if i pieces hold i
    of them, the count of letters less that of pieces starts at 0, falls by at most one a piece, and ends below 0. So b is
    asked for each piece in a few places only, the same for all lengths of a class (length_classes), some 60 for 100 letters.

    The argument holds for any d + 1 pieces, one after another. Where titles share common pieces, as a boilerplate
    beginning, each is cut again, into d + 1 pieces of its longest stretch without one. The whole piece of the argument may
    be one of a's others: those are joined as they are. Or it is a common one: then b, which holds it, is asked for the pieces
    of that stretch. Titles whose stretch is too short for that are joined by their common pieces.
    """
    spark = heads.sparkSession
    as_short, as_long = (F.broadcast(x) for x in _lengths(spark, threshold))
    slim = heads.select("node", "side", "title_key", "tokens", "size")
    short, longer = slim.join(as_short, "size"), slim.join(as_long, "size")
    pieces, _ = settle(_pieces(short, "0"), "pieces")
    asked, _ = settle(_asked(longer, "0"), "asked")
    often, _ = settle(pieces.groupBy("hash").count().where(F.col("count") > common).select("hash"), "common")

    def meet(p: DataFrame, q: DataFrame) -> DataFrame:
        fits = (F.col("a") != F.col("b")) & (F.col("side").isNull() | (F.col("side") != F.col("other")))
        return p.join(q.withColumnRenamed("side", "other"), "hash").where(fits).select("a", "b", "side")

    if often.isEmpty():
        return meet(pieces, asked)
    held = pieces.join(often, "hash", "left_semi")
    at = held.groupBy("a").agg(F.array_sort(F.collect_set("i")).alias("at")).withColumnRenamed("a", "node")
    ends = "concat(array(-1), at, array(edits + 1))"
    gaps = F.expr(f"transform(sequence(0, size(at)), k -> struct({ends}[k + 1] - {ends}[k] - 1 as free, {ends}[k] + 1 as first))")
    stretch = short.join(at, "node").withColumn("gap", F.array_max(gaps)).withColumn("begin", F.col("gap.first") * F.col("width"))
    last = F.when(F.col("gap.first") + F.col("gap.free") > F.col("edits"), F.col("size")).otherwise((F.col("gap.first") + F.col("gap.free")) * F.col("width"))
    cut, _ = settle(stretch.withColumn("width", F.floor((last - F.col("begin")) / (F.col("edits") + 1)).cast("int")).where(F.col("width") >= LEAST_PIECE).select("node", "side", "title_key", "tokens", "size", "c", "edits", "begin", "width"), "stretches")
    again = pieces.join(cut.select(F.col("node").alias("a"), "c", "begin", F.col("width").alias("cut_width")), "a", "left")
    plain = again.where("begin is null").drop("c", "begin", "cut_width").unionByName(again.where("begin is not null").drop("c", "begin", "cut_width").join(often, "hash", "left_anti"))
    runs = again.where("begin is not null").join(often, "hash", "left_semi").select("hash", "c", "begin", F.col("cut_width").alias("width")).distinct()
    known = asked.join(often, "hash", "left_semi").join(runs, "hash").select(F.col("b").alias("node"), "c", "begin", "width").distinct()
    asks = known.join(longer.drop("width"), ["node", "c"])
    return meet(plain, asked).unionByName(meet(_pieces(cut, "begin"), _asked(asks, "begin")))


def _length_pairs(heads: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of titles of which one is beyond LONG_TITLE, and whose lengths can be similar."""
    ratio = threshold / (2 - threshold)  # of lengths: all letters of the shorter one match
    step = F.floor(F.log(F.col("size")) / -math.log(ratio)).cast("int")
    some = heads.where(F.col("size") >= int(LONG_TITLE * ratio)).select("node", "tokens", "size", "side", step.alias("step"))
    a = some.select(F.col("node").alias("a"), "tokens", F.col("size").alias("size_a"), "side", "step")
    b = some.select(F.col("node").alias("b"), "tokens", F.col("size").alias("size_b"), F.col("side").alias("other"), F.explode(F.array("step", F.col("step") - 1)).alias("step"))
    fits = (F.col("a") != F.col("b")) & (F.col("side").isNull() | (F.col("side") != F.col("other")))
    met = a.join(b, ["tokens", "step"]).where(fits & (F.greatest("size_a", "size_b") > LONG_TITLE))
    return met.where(F.least("size_a", "size_b") >= ratio * F.greatest("size_a", "size_b")).select("a", "b", "side")


def all_links(slim: DataFrame, key: str, threshold: float = 0.96) -> DataFrame:
    """(src, dst) of every kind among records (key, ids, title_key)."""
    return id_links(slim, key).unionAll(title_links(slim, key)).unionAll(fuzzy_links(slim, key, threshold).select("src", "dst"))


def clusters(papers: DataFrame, key: str = "paper_id", threshold: float = 0.96) -> DataFrame:
    """papers with cluster, the smallest key reachable by identifier, title and similar-title links."""
    df, _ = settle(with_title_key(with_ids(papers)), "records")
    found = connected_components(all_links(df.select(key, "ids", "title_key"), key, threshold))
    return df.join(found.withColumnRenamed("node", key), key, "left").withColumn("cluster", F.coalesce("component", key)).drop("component")


def anchors(df: DataFrame, key: str, threshold: float = 0.96) -> DataFrame:
    """(key, hash, kind, meets): what a record can be linked by, and the kind of anchor that it meets: equal identifiers and
    titles meet each other, pieces of titles those asked for, long titles those of about their length."""
    ids = id_pairs(df, key).select(key, F.xxhash64(F.lit("id"), "kind", "value").alias("hash"), F.lit("same").alias("kind"), F.lit("same").alias("meets"))
    titled = df.where(~blank(F.col("title_key")))
    same = titled.select(key, F.xxhash64(F.lit("title"), "title_key").alias("hash"), F.lit("same").alias("kind"), F.lit("same").alias("meets"))
    heads = titled.select(F.col(key).alias("node"), "title_key", F.array_join(distinguishing_tokens(F.col("title_key")), " ").alias("tokens"), F.length("title_key").alias("size"), F.lit(None).cast("boolean").alias("side"))
    as_short, as_long = (F.broadcast(x) for x in _lengths(df.sparkSession, threshold))
    cut = heads.where(F.col("size") <= LONG_TITLE)
    pieces = _pieces(cut.join(as_short, "size"), "0").select(F.col("a").alias(key), "hash", F.lit("piece").alias("kind"), F.lit("asked").alias("meets"))
    asked = _asked(cut.join(as_long, "size"), "0").select(F.col("b").alias(key), "hash", F.lit("asked").alias("kind"), F.lit("piece").alias("meets"))
    ratio = threshold / (2 - threshold)
    step = F.floor(F.log(F.col("size")) / -math.log(ratio)).cast("int")
    near = F.explode(F.array(step - 1, step, step + 1)).alias("step")
    long = heads.where(F.col("size") >= int(LONG_TITLE * ratio))
    by_length = lambda steps, kind, meets: long.select(F.col("node").alias(key), "tokens", steps).select(key, F.xxhash64(F.lit("long"), "tokens", "step").alias("hash"), F.lit(kind).alias("kind"), F.lit(meets).alias("meets"))
    return ids.unionAll(same).unionAll(pieces).unionAll(asked).unionAll(by_length(step.alias("step"), "long", "about")).unionAll(by_length(near, "about", "long"))


_FILLED = ("doi", "arxiv_id", "pmid", "pmcid", "openalex_id", "semantic_scholar_id", "url", "publication_date", "year", "volume", "issue", "pages", "publisher", "issn", "pdf_url", "publication_type", "author_watch", "relationship")
_LISTS = ("sources", "queries", "references", "author_ids", "extra_tags")
_LOCATORS = ("volume", "issue", "pages", "publisher", "issn")
_SERIES = r"(?i)^(lecture notes|communications in computer|proceedings of spie)"


def united(df: DataFrame, key: str, cluster: str, order: str) -> DataFrame:
    """(cluster, lists, pdf_candidates): the values of a cluster's lists and the entries of its maps, each where it stands first.

    Distinct values are found first, each with its least place, by an aggregation that tasks begin on their own rows; only
    then are those of a cluster put in order, so what one task holds has the size of the result, however many records there are.
    """
    place = lambda at: F.struct(F.col(order).alias("rank"), F.col(key).alias("record"), at.alias("at"))
    row = lambda field, name, value, at: F.struct(F.lit(field).alias("field"), name.alias("name"), value.alias("value"), place(at).alias("place"))
    listed = lambda n: F.transform(F.coalesce(F.col(n), F.array().cast("array<string>")), lambda x, i: row(n, x, F.lit(None).cast("string"), i))
    each = [listed(n) for n in _LISTS]
    entries = F.coalesce(F.map_entries("pdf_candidates"), F.array().cast("array<struct<key:string,value:string>>"))
    rows = df.select(cluster, F.explode(F.concat(*each, F.transform(entries, lambda e, i: row("pdf_candidates", e["key"], e["value"], i)))).alias("r")).select(cluster, "r.*")
    distinct = rows.groupBy(cluster, "field", "name").agg(F.min("place").alias("place"), F.min_by("value", "place").alias("value"))
    of = lambda field: F.array_sort(F.collect_list(F.when(F.col("field") == field, F.struct("place", "name", "value"))))
    return distinct.groupBy(cluster).agg(*[F.transform(of(n), lambda s: s["name"]).alias(n) for n in _LISTS], F.map_from_entries(F.transform(of("pdf_candidates"), lambda s: F.struct(s["name"], s["value"]))).alias("pdf_candidates"))


def merge_clusters(df: DataFrame, key: str = "paper_id", cluster: str = "cluster", order: str = "source_rank") -> DataFrame:
    """One record for each cluster (A10).

    The version of the best venue type (then with a named venue, then first in order) gives venue, locators, year and
    date; a publisher's DOI goes before a preprint server's; the longest abstract and author list, the most
    citations and the strongest graph evidence are kept; lists and maps are united in order. Nothing here depends on the
    order of arrival: ties go by `order` and key. Every value is an aggregate of its own, so a large cluster needs no
    task to hold its records; united lists are gathered from their distinct values (united). What goes by the
    same order shares an aggregate. Aggregates nobody asks for are left out, so settle() the columns wanted, with the count of rows.
    """
    rank = type_rank(F.col("venue_type"))
    named = ~F.col("venue_key").isin(*GENERIC_VENUES)
    early = [-F.coalesce(F.col(order), F.lit(99)), F.col(key)]
    series = F.coalesce(F.col("venue"), F.lit("")).rlike(_SERIES)
    df = df.withColumns(
        {
            "is_version": F.struct(rank, named.cast("int"), early[0], F.negate(F.xxhash64(key)), early[1]),
            "is_venue": F.struct(rank, (~series).cast("int"), named.cast("int"), early[0], F.negate(F.xxhash64(key)), early[1]),
        }
    )
    best = lambda value, by: F.max_by(value, by)
    present = lambda n: ~blank(F.col(n).cast("string"))
    filled = {n: best(F.when(present(n), F.col(n)), F.when(present(n), F.col("is_version"))) for n in _FILLED if n not in ("doi", *_LOCATORS)}
    publisher = F.coalesce(~is_preprint_doi(F.col("doi")), F.lit(False))
    filled["doi"] = best(F.col("doi"), F.when(present("doi"), F.struct(publisher, F.col("is_version"))))
    no_abstract = F.coalesce(F.length("abstract") == 0, F.lit(True))
    # locators never come from a version below the best; where no abstract has text, it is missing or empty as the best version's
    version = best(F.struct(*_LOCATORS, F.when(no_abstract, F.col("abstract")).alias("abstract")), F.col("is_version"))
    by_length = lambda n, size, some: best(F.col(n), F.when(some, F.struct(size, F.col("is_version"))))
    venue = best(F.struct("venue", "venue_key", "venue_type"), F.col("is_venue"))
    dated = best(F.struct("year", "publication_date"), F.when(F.col("year").isNotNull() | present("publication_date"), F.col("is_version")))
    out = df.groupBy(cluster).agg(
        F.min(key).alias(key),
        F.count("*").alias("n_records"),
        best(F.col("title"), F.col("is_version")).alias("title"),
        version.alias("best_version"),
        venue.alias("v"),
        dated.alias("dated"),
        by_length("abstract", F.length("abstract"), ~no_abstract).alias("abstract"),
        by_length("authors", F.size("authors"), F.col("authors").isNotNull()).alias("authors"),
        F.max("citation_count").alias("citation_count"),
        best(F.col("graph_evidence"), F.col("graph_evidence.score")).alias("graph_evidence"),
        *[c.alias(n) for n, c in filled.items()],
    )
    out = out.join(united(df, key, cluster, order), cluster, "left").withColumns({n: F.coalesce(n, F.array().cast("array<string>")) for n in _LISTS} | {"pdf_candidates": F.coalesce("pdf_candidates", F.create_map().cast("map<string,string>"))})
    same = F.coalesce(F.substring("publication_date", 1, 4) == F.col("dated.year").cast("string"), F.lit(True))
    return out.withColumns(
        {n: F.col(f"best_version.{n}") for n in _LOCATORS}
        | {
            "abstract": F.coalesce("abstract", "best_version.abstract"),
            "venue": F.col("v.venue"),
            "venue_key": F.col("v.venue_key"),
            "venue_type": F.col("v.venue_type"),
            "publication_date": F.coalesce("dated.publication_date", F.when(same, F.col("publication_date"))),
            "year": F.coalesce("dated.year", "year"),
        }
    ).drop("v", "dated", "best_version")


def dedupe(papers: DataFrame, key: str = "paper_id", threshold: float = 0.96, order: str = "source_rank") -> DataFrame:
    """Records of the same work as one."""
    return merge_clusters(clusters(papers, key, threshold), key, "cluster", order)


def match_library(papers: DataFrame, library: DataFrame, key: str = "paper_id", threshold: float = 0.96) -> DataFrame:
    """papers with library_key and match_method: by identifiers in order of priority, then by title, then by similar title
    (J01-J03)."""
    p, _ = settle(with_title_key(with_ids(papers)), "papers")
    lib, _ = settle(with_title_key(library).select("key", "title_key", "ids"), "library")
    by_id = id_pairs(p, key).join(id_pairs(lib, "key").drop("priority"), ["kind", "value"]).select(key, F.col("key").alias("found"), "priority", F.col("kind").alias("method"), F.lit(1.0).alias("similarity"))
    titles = lib.select("key", "title_key", F.col("ids").alias("l_ids")).where(~blank(F.col("title_key")))
    by_title = p.join(titles, "title_key").where(~conflict(F.col("ids"), F.col("l_ids"))).select(key, F.col("key").alias("found"), F.lit(10).alias("priority"), F.lit("title").alias("method"), F.lit(1.0).alias("similarity"))
    met, _ = settle(by_id.unionAll(by_title), "matched")
    left = p.join(met.select(key), key, "left_anti").where(~blank(F.col("title_key")))
    if not left.isEmpty() and not lib.isEmpty():
        met = met.unionAll(_similar(left, lib, key, threshold))
    first = met.groupBy(key).agg(F.min_by(F.struct("found", "method"), F.struct("priority", -F.col("similarity"), "found")).alias("match"))
    return p.join(first, key, "left").withColumns({"library_key": F.col("match.found"), "match_method": F.col("match.method")}).drop("match")


def _similar(p: DataFrame, lib: DataFrame, key: str, threshold: float) -> DataFrame:
    """Matches of records by similar titles."""
    side = lambda df, mark, own: df.select(F.concat(F.lit(mark), F.col(own).cast("string")).alias("node"), "title_key", "ids", F.lit(mark == "p:").alias("mine"))
    near = fuzzy_links(side(p, "p:", key).unionAll(side(lib, "l:", "key")), "node", threshold, "mine")
    heads = p.groupBy("title_key").agg(F.min(F.concat(F.lit("p:"), F.col(key).cast("string"))).alias("src"))
    return (
        near.join(heads, "src").join(p.select(key, "title_key"), "title_key")
        .select(key, F.substring("dst", 3, 1 << 30).alias("found"), F.lit(20).alias("priority"), F.format_string("fuzzy_title(%.3f)", F.col("similarity")).alias("method"), "similarity")
    )


def route(matched: DataFrame, library: DataFrame) -> DataFrame:
    """matched records with route: candidate, existing, or upgrade of a preprint in the library."""
    lib = library.select(F.col("key").alias("library_key"), F.col("ids").alias("l_ids"), "item_type")
    own, theirs = F.lower("doi"), F.lower(F.try_element_at("l_ids", F.lit("doi")))
    published = ~blank(own) & ~is_preprint_doi(own) & (blank(theirs) | (theirs != own))
    better = peer_reviewed(F.col("venue_type")) & is_preprint_record(F.col("item_type"), F.col("l_ids")) & published
    kept = F.coalesce(F.col("decision") != "reject", F.lit(True)) if "decision" in matched.columns else F.lit(True)
    to = F.when(F.col("library_key").isNull(), "candidate").when(better & kept, "upgrade").otherwise("existing")
    return matched.join(lib, "library_key", "left").withColumn("route", to).drop("l_ids", "item_type")
