"""Near copies by SimHash: wide fingerprints in Gray-ordered trees, then exact Jaccard similarity of word shingles.

A text is the set of XXH64 values of its SHINGLE-word shingles, and two texts are near copies at a Jaccard similarity of
LEAST or more. Their fingerprints then differ in about a seventh of the bits, too many for top nodes made of shared chunks
to prune anything. So the top nodes of this index are shared shingles: sets are sorted by one global order, and two that are
similar enough share a value among the first n - ceil(LEAST * n) + 1 of each (n: its size), so a fingerprint stands under
each of these values. The order puts values that are frequent in a sample last: any order gives the same links, this one small
nodes. Under a top node fingerprints are sorted by Gray rank and searched down the levels as in simhash, within RADIUS bits;
a pair that a search reaches is a candidate if its second 64 bits and its sizes allow the similarity. At a similarity of 0.8
a pair's gap of 128 bits has its mean at 19 and a deviation of 4; with WIDE at 40 fewer than one link in 10,000 can be lost.

Candidates are passed on as forests, a row for each node at most; their components are clusters of texts that may be near
copies. The sets of a cluster's texts, made again, meet in one task and decide exactly. A cluster beyond BLOCK texts or
VALUES shingles is dealt into blocks, each of which holds the same PIVOTS as well, so that a group of near copies becomes one
part at once; then the texts outside a cluster's largest part meet every block of it.

Null texts are empty; texts without a word are one set, as are texts with equal sets. Rows without a key aren't compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.batches import pieces, small_batches
from scriptorium.llm.itq import _groups
from scriptorium.llm.sampling import bounded_sample
from scriptorium.llm.simhash import BLOCK as NODE_BLOCK
from scriptorium.llm.simhash import forest_links, grouped_links, majority, shingle_hashes
from scriptorium.operators.components import connected_components
from scriptorium.session import settle

SHINGLE = 5
#: Least similarity, as a fraction.
UP, DOWN = 4, 5
#: Bits that may differ: of the 64 that trees hold, and of all 128.
RADIUS, WIDE = 24, 40
#: Texts sampled for frequent shingles, in how many of these one is frequent, and how many are kept: they set costs, not results.
SAMPLE, FREQUENT, MOST_FREQUENT = 4_000, 3, 100_000
#: Texts and shingles of a block, and texts that all blocks of a cluster hold.
BLOCK, VALUES, PIVOTS = 1_024, 1 << 21, 4


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(np.array(shingle_hashes((text or "").encode("utf-8", "surrogatepass"), size), np.uint64))


def prefix_size(n):
    """How many first values of a set of n must meet those of any set similar to it."""
    return n - (UP * n + DOWN - 1) // DOWN + 1


def similar(common, one, two):
    """Whether sets of sizes `one` and `two` with so many common values have the least similarity, in whole numbers."""
    return (UP + DOWN) * common >= UP * (one + two)


def could(one, two):
    """Whether sets of these sizes can have the least similarity."""
    return DOWN * np.minimum(one, two).astype(np.int64) >= UP * np.maximum(one, two).astype(np.int64)


def wide_fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of each set: of its values, and of another hash of them."""
    with np.errstate(over="ignore"):
        others = []
        for s in sets:
            x = (s ^ (s >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            others.append(x ^ (x >> np.uint64(31)))
    return majority(sets), majority(others)


def frequent_shingles(df: DataFrame, key: str, text: str, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, rank) of shingles that are frequent in a sample, sorted by hash; the most frequent rank highest."""

    def run(batches):
        for batch in pieces(batches, text):
            found = [shingle_set(t, size) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    sample = bounded_sample(df.select(key, text), key, SAMPLE)
    counted = sample.repartition(F.xxhash64(key)).mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= FREQUENT)
    rows = counted.orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).toArrow()
    found = rows.column("h").to_numpy().view(np.uint64)
    rank = np.arange(len(found), 0, -1)
    order = np.argsort(found)
    return found[order], rank[order]


def prefix(values: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first values of a sorted set in the global order: frequent ones last, by rank."""
    known, ranks = frequent
    rank = np.zeros(len(values), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        rank = np.where(known[at] == values, ranks[at], 0)
    return values[np.lexsort((values, rank))][: prefix_size(len(values))]


def _points(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).view(np.int64)))


def described(df: DataFrame, frequent: tuple[np.ndarray, np.ndarray], key: str, text: str, size: int = SHINGLE) -> DataFrame:
    """(key, point, size, fp, more, prefix) of each text; point: a hash of its set; fp, more: its fingerprints."""
    shared = df.sparkSession.sparkContext.broadcast(frequent)
    longs = [T.StructField(n, T.LongType()) for n in ("point", "size", "fp", "more")]
    schema = T.StructType([df.schema[key], *longs, T.StructField("prefix", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in pieces(batches, text):
            sets = [shingle_set(t, size) for t in batch.column(text).to_pylist()]
            fp, more = wide_fingerprints(sets)
            firsts = [prefix(s, shared.value) if len(s) else s for s in sets]
            columns = [pa.array(_points(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp.view(np.int64)), pa.array(more.view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns, _lists(firsts)], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def deal(rows: DataFrame) -> DataFrame:
    """(node, point) for each top node that a point stands under; a task deals a point once, however many copies it reads."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            points = batch.column("point").to_pylist()
            new = np.zeros(len(points), bool)
            for i, p in enumerate(points):
                if p not in seen:
                    seen.add(p)
                    new[i] = True
            part = batch.filter(pa.array(new))
            firsts = part.column("prefix")
            count = np.diff(firsts.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([firsts.flatten(), pa.array(np.repeat(part.column("point").to_numpy(), count))], names=["key", "point"])

    return rows.select("point", "prefix").mapInArrow(run, "key long, point long")


def met(entries: DataFrame) -> DataFrame:
    """Entries (key, point) of top nodes that hold two points or more, each once; rows stream through."""

    def run(batches):
        last = np.zeros((0, 2), np.int64)  # the row before, which may yet be met
        told = False  # whether it has been put out
        for batch in batches:
            rows = np.concatenate([last, np.stack([batch.column(n).to_numpy() for n in ("key", "point")], axis=1)])
            if not len(rows):
                continue
            new = np.ones(len(rows), bool)
            new[1:] = np.any(rows[1:] != rows[:-1], axis=1)
            rows = rows[new]
            same = rows[1:, 0] == rows[:-1, 0]
            some = np.zeros(len(rows), bool)
            some[1:] |= same
            some[:-1] |= same
            put = some.copy()
            if len(last) and told:
                put[0] = False
            told = bool(some[-1]) or (len(rows) == 1 and told)
            last = rows[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(rows[put, k].copy()) for k in (0, 1)], names=["key", "point"])

    return entries.repartition("key").sortWithinPartitions("key", "point").mapInArrow(run, "key long, point long")


def candidates(rows: DataFrame, block: int = NODE_BLOCK) -> DataFrame:
    """(src, dst): forest links among points whose fingerprints and sizes allow the least similarity."""
    entries, _ = settle(met(deal(rows)), "top-nodes", "lz4")
    points = rows.groupBy("point").agg(*[F.first(c).alias(c) for c in ("size", "fp", "more")])
    dealt = entries.join(points, "point").select(F.lit(0).alias("t"), "key", F.col("point").alias("node"), "fp", "more", "size")
    dealt, _ = settle(dealt, "fingerprints-of-nodes", "lz4")

    def accept(columns, a, b):
        fp, more, sizes = columns[6:]
        gap = np.bitwise_count(fp[a] ^ fp[b]).astype(np.int64) + np.bitwise_count(more[a] ^ more[b])
        return (gap <= WIDE) & could(sizes[a], sizes[b])

    def link(columns):
        columns[6:8] = [c.view(np.uint64) for c in columns[6:8]]
        return forest_links(columns, columns[6], RADIUS, accept)

    return grouped_links(dealt, ["fp", "more", "size"], block, link)


def made_sets(clustered: DataFrame, rows: DataFrame, df: DataFrame, key: str, text: str, size: int = SHINGLE) -> DataFrame:
    """(point, cluster, hashes) of clustered points, made from the text of one row of each."""

    def run(batches):
        for batch in pieces(batches, text):
            sets = [shingle_set(t, size) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(_points(sets)), _lists(sets)], names=["point", "hashes"])

    # the smallest key's row; a repeated key brings other texts, whose points aren't in the cluster or are there already
    one = rows.join(clustered, "point", "left_semi").groupBy("point").agg(F.min(key).alias(key)).select(key).distinct()
    made = df.select(key, text).join(one, key, "left_semi").mapInArrow(run, "point long, hashes array<long>")
    return made.dropDuplicates(["point"]).join(clustered, "point")


def links_of_sets(values: np.ndarray, offsets: np.ndarray, part: np.ndarray, asks: np.ndarray) -> list[tuple[int, int]]:
    """Links between rows of different parts, asking rows against all; a row linked to a part isn't compared with it again."""
    sizes, out = np.diff(offsets), []
    _, place = np.unique(values, return_inverse=True)
    mark = np.zeros(int(place.max()) + 1 if len(place) else 0, np.int64)
    label = np.unique(part, return_inverse=True)[1]
    for i in np.flatnonzero(asks).tolist():
        others = np.flatnonzero((label != label[i]) & could(sizes, sizes[i]))
        if not len(others):
            continue
        own = place[offsets[i] : offsets[i + 1]]
        mark[own] = 1
        if 4 * len(others) < len(sizes):
            common = np.array([mark[place[offsets[k] : offsets[k + 1]]].sum() for k in others.tolist()])
        else:
            common = np.add.reduceat(mark[place], offsets[:-1])[others]
        mark[own] = 0
        near = others[similar(common, sizes[i], sizes[others])]
        if len(near):
            _, first = np.unique(label[near], return_index=True)
            out += [(i, int(near[k])) for k in first]
            label[np.isin(label, label[near])] = label[i]
    return out


def _decided(members: DataFrame, keys: list[str]) -> DataFrame:
    """(src, dst) of links among the members (keys, point, part, asks, hashes) of each group."""
    names = [*keys, "point", "part", "asks", "hashes"]
    grouped = members.select(*names).repartition(*keys).sortWithinPartitions(*keys, "point")

    def run(batches):
        for table in _groups(batches, keys):
            rows = table.select(["point", "part", "asks", "hashes"]).to_batches()[0]
            point, part, asks = (rows.column(n).to_numpy(zero_copy_only=False) for n in ("point", "part", "asks"))
            sets = rows.column("hashes")
            offsets = sets.offsets.to_numpy().astype(np.int64)
            found = links_of_sets(sets.flatten().to_numpy(), offsets - offsets[0], part, asks)
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(point[a]), pa.array(point[b])], names=["src", "dst"])

    return grouped.mapInArrow(run, "src long, dst long")


def decided_links(sets: DataFrame, block: int = BLOCK, values: int = VALUES) -> DataFrame:
    """(src, dst): links of the least similarity that join what all such links join, among sets (point, cluster, hashes)."""
    sized = sets.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.size("hashes")).alias("v"), *[F.min(F.struct(F.xxhash64("point", F.lit(k)), "point")).getField("point").alias(f"pivot{k}") for k in range(PIVOTS)])
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("v") / values)).cast("int")
    sized, _ = settle(sized.where("n > 1").withColumn("blocks", blocks), "clusters")
    alone = sets.join(sized.where("blocks <= 1").select("cluster"), "cluster")
    small = _decided(alone.withColumns({"part": F.col("point"), "asks": F.lit(True)}), ["cluster"])
    large = sized.where("blocks > 1")
    if large.isEmpty():
        return small
    found, _ = settle(small, "links-of-clusters")
    pivots = F.array(*[F.col(f"pivot{k}") for k in range(PIVOTS)])
    own, _ = settle(sets.join(large, "cluster").select("cluster", "point", "hashes", "blocks", F.array_contains(pivots, F.col("point")).alias("pivot"), F.pmod(F.xxhash64("point"), "blocks").cast("int").alias("own")), "large-clusters")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    first = own.withColumn("j", F.explode(F.when(F.col("pivot"), every).otherwise(F.array("own"))))
    once, _ = settle(_decided(first.withColumns({"part": F.col("point"), "asks": F.lit(True)}), ["cluster", "j"]), "links-of-blocks")
    joined = connected_components(once).select(F.col("node").alias("point"), F.col("component").alias("part"))
    marked, _ = settle(own.join(joined, "point", "left").withColumn("part", F.coalesce("part", "point")), "parts")
    parts = marked.groupBy("cluster", "part").count()
    main = parts.groupBy("cluster").agg(F.max(F.struct("count", "part")).getField("part").alias("main"), F.sum("count").alias("all"), F.max("count").alias("most"))
    main = main.where(F.col("all") > F.col("most"))
    rest = marked.join(main.select("cluster", "main"), "cluster").withColumn("asks", F.col("part") != F.col("main"))
    counts = rest.where("asks").groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("rows"))
    asking = rest.where("asks").join(counts, "cluster").withColumns({"i": F.pmod(F.xxhash64("point", F.lit("i")), "rows").cast("int"), "j": F.explode(every)})
    asked = rest.join(counts, "cluster").withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("rows") - 1)), "j": F.col("own"), "asks": F.lit(False)})
    columns = ["cluster", "i", "j", "point", "part", "asks", "hashes"]
    met_again = _decided(asking.select(*columns).unionAll(asked.select(*columns)), ["cluster", "i", "j"])
    return found.unionAll(once).unionAll(met_again)


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(key, point, part) of each row with a key: rows of one part are joined by links of the least similarity."""
    small_batches(df.sparkSession)
    df = df.where(F.col(key).isNotNull())
    rows, _ = settle(described(df, frequent_shingles(df, key, text, size), key, text, size), "described", "lz4")
    clustered = connected_components(candidates(rows.select("point", "size", "fp", "more", "prefix"))).select(F.col("node").alias("point"), F.col("component").alias("cluster"))
    sets, _ = settle(made_sets(clustered, rows.select(key, "point"), df, key, text, size), "shingle-sets")
    links, _ = settle(decided_links(sets, block), "links")
    found = connected_components(links).select(F.col("node").alias("point"), F.col("component").alias("part"))
    return rows.select(key, "point").join(found, "point", "left").select(key, "point", F.coalesce("part", "point").alias("part"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """df with one row of each group, that of the smallest key; rows without a key stay.

    The texts move once, to meet the keys that stay. Where keys are repeated, one row of each stays.
    """
    found, _ = settle(groups(df, key, text, size), "groups-of-rows")
    own = found.join(found.groupBy("part").agg(F.min(key).alias(key)), ["part", key], "left_semi")
    heads = own.groupBy(key).agg(F.count("*").alias("rows_of_key"))
    named, nameless = df.where(F.col(key).isNotNull()), df.where(F.col(key).isNull())
    kept = named.join(heads.select(key).hint("shuffle_hash"), key, "left_semi")  # no sort of the texts
    if not heads.where("rows_of_key > 1").isEmpty():
        kept = kept.dropDuplicates([key])
    return kept.unionByName(nameless)
