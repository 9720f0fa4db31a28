"""SimHash near-duplicates through hierarchical indexes over Gray-ordered fingerprints.

A fingerprint's 64 bits are cut into n chunks. Two that differ in at most d bits agree on n - d chunks at least, so for
every choice of n - d chunks the bits are permuted to put the chosen ones first, and fingerprints that agree on them
stand together: they are the children of one top node, whose mask is the chosen chunks. Within it they are sorted by
Gray rank, FANOUT neighbours at a time share a node that keeps the bits all of them agree on and its ancestors don't
hold (mask and pattern), and a search goes down the levels adding up the differences found in each node's own bits; a
node over d prunes its whole group. Links found are merged into a forest at once, so a group of n near copies gives
n - 1 links, not all pairs; components of the forests are then found by star contraction.

n grows with the number of distinct fingerprints (5 chunks to 2**25 of them, 6 to 2**33, 7 beyond) so that a top node
keeps a few thousand children; one with over BLOCK children is dealt into blocks by hash, and every pair of its blocks
is searched on its own.

Null texts are empty. Empty texts and texts without a word have fingerprint zero, and link like any other. Rows with
the same fingerprint are one point of the index. Rows with the same or a null doc_id each keep their row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.batches import give_back, pieces, small_batches
from scriptorium.operators.components import connected_components
from scriptorium.session import settle

SHINGLE, SEED, MAX_BITS, FANOUT, BLOCK = 4, 42, 4, 8, 1 << 15
#: Query-node pairs held at once while an index is searched: about 100 MB.
FRONTIER = 1 << 21

_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(data: bytes, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle of a text's words (ASCII lower case, joined with blanks); all words if there are fewer."""
    words = data.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, seed)]
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - size].tolist(), stops[size - 1 :].tolist(), strict=True)]


def majority(hashes: list) -> np.ndarray:
    """Of each list of 64-bit hashes, the bits set in over half of them (uint64); zero for none.

    Eight byte-wide counters lie in one word: each byte of a hash is spread over one, and sums of 255 hashes are widened.
    """
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    if not sizes.sum():
        return out
    flat = np.concatenate([np.array(h, np.uint64) for h in hashes if len(h)])
    some = np.flatnonzero(sizes)
    ends = np.cumsum(sizes[some])
    pieces = -(-sizes[some] // 255)
    first = np.cumsum(pieces) - pieces
    starts = np.repeat(ends - sizes[some], pieces) + 255 * (np.arange(int(pieces.sum())) - np.repeat(first, pieces))
    rows = flat.astype("<u8").view(np.uint8).reshape(-1, 8)
    for k in range(8):
        narrow = np.add.reduceat(_SPREAD[rows[:, k]], starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        wide = np.add.reduceat(narrow.astype(np.int64), first, axis=0)
        bits = (2 * wide > sizes[some][:, None]).astype(np.uint64)
        out[some] |= (bits << np.arange(8, dtype=np.uint64)).sum(axis=1).astype(np.uint64) << np.uint64(8 * k)
    return out


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(key, fp): the fingerprint of each text as a signed 64-bit integer, made where it is read."""
    schema = T.StructType([df.schema[key], T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in pieces(batches, text):
            found = majority([shingle_hashes((t or "").encode(), size) for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found.view(np.int64))], names=[key, "fp"])

    return df.select(key, text).mapInArrow(run, schema)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The position of each code in the reflected Gray order."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Hierarchical index of codes that are sorted by (group, Gray rank); every group has a tree of its own.

    levels: from the leaves up, (bits that a node holds itself, their pattern, first child, number of children).
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray, fanout: int = FANOUT):
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.codes = codes
        fixed, pattern = np.full(len(codes), full), codes
        self.levels, owner = [], group
        first, count = np.arange(len(codes)), np.ones(len(codes), np.int64)
        while True:
            new = np.ones(len(owner), bool)
            new[1:] = owner[1:] != owner[:-1]
            starts = np.flatnonzero(new)
            if len(starts) == len(owner):
                break
            place = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
            lead = np.flatnonzero(place % fanout == 0)
            every = np.bitwise_and.reduceat(pattern, lead)
            some = np.bitwise_or.reduceat(pattern, lead)
            agreed = np.bitwise_and.reduceat(fixed, lead) & ~(every ^ some)
            size = np.diff(np.append(lead, len(owner)))
            self.levels.append((fixed & ~np.repeat(agreed, size), pattern, first, count))
            owner, fixed, pattern, first, count = owner[lead], agreed, every, lead, size
        self.levels.append((fixed, pattern, first, count))
        self.root_group = owner

    def search(self, codes: np.ndarray, group: np.ndarray, most: int, above: np.ndarray | None = None):
        """Yield (query, leaf) within `most` differing bits, in pieces; with `above`, only leaves after that one."""
        root = np.searchsorted(self.root_group, group)
        ok = root < len(self.root_group)
        ok[ok] = self.root_group[root[ok]] == group[ok]
        query = np.flatnonzero(ok)
        stack = [(len(self.levels) - 1, query, root[ok], np.zeros(len(query), np.int64), False)]
        while stack:
            level, query, node, gone, counted = stack.pop()
            own, pattern, first, count = self.levels[level]
            if not counted:
                gone = gone + np.bitwise_count((codes[query] ^ pattern[node]) & own[node])
                near = gone <= most
                query, node, gone = query[near], node[near], gone[near]
            if not level:
                if above is not None:
                    after = node > above[query]
                    query, node = query[after], node[after]
                if len(query):
                    yield query, node
                continue
            size = count[node]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            if total > FRONTIER and len(query) > 1:
                half = len(query) // 2
                stack += [(level, query[s], node[s], gone[s], True) for s in (slice(half), slice(half, None))]
            elif total:
                child = np.repeat(first[node] - (ends - size), size) + np.arange(total)
                stack.append((level - 1, np.repeat(query, size), child, np.repeat(gone, size), False))


class Forest:
    """Disjoint sets over positions, in numpy: links are added in arrays, labels are smallest positions."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                jumped = self.label[self.label]
                if np.array_equal(jumped, self.label):
                    break
                self.label = jumped


def chunk_plan(n: int, most: int = MAX_BITS) -> tuple[int, list[tuple[int, ...]]]:
    """(number of chunks, the choices of chunks that must agree) for n distinct fingerprints."""
    chunks = most + (1 if n <= 1 << 25 else 2 if n <= 1 << 33 else 3)
    return chunks, list(combinations(range(chunks), chunks - most))


def _permuted(fp: np.ndarray, chosen: tuple[int, ...], chunks: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits of the chosen chunks, the code with these first)."""
    edges = [64 * i // chunks for i in range(chunks + 1)]
    key, code = np.zeros_like(fp), np.zeros_like(fp)
    for c in [*chosen, *(c for c in range(chunks) if c not in chosen)]:
        width = edges[c + 1] - edges[c]
        bits = (fp >> np.uint64(64 - edges[c + 1])) & np.uint64((1 << width) - 1)
        code = (code << np.uint64(width)) | bits
        if c in chosen:
            key = (key << np.uint64(width)) | bits
    return key, code


GROUP = ["t", "key", "one", "two"]


def by_group(columns: list[np.ndarray], code: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(columns, codes, group numbers) sorted by GROUP, the first columns, and within a group by Gray rank."""
    order = np.lexsort((gray_rank(code), *columns[3::-1]))
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)
    return columns, code[order], np.cumsum(new) - 1


def forest_links(columns: list[np.ndarray], code: np.ndarray, most: int, accept=None) -> tuple[np.ndarray, np.ndarray]:
    """Links of the forest of each group, as two arrays of nodes; columns are GROUP, block, node and what `accept` takes.

    accept(columns, a, b) tells which pairs of rows that are within `most` bits are links; all of them if it is None.
    """
    columns, code, group = by_group(columns, code)
    one, two, block, node = columns[2:6]
    index, forest = GrayIndex(code, group), Forest(len(code))
    for query, leaf in index.search(code, group, most, above=np.arange(len(code))):
        keep = (one[query] == two[query]) | (block[query] != block[leaf])
        if accept:
            keep &= accept(columns, query, leaf)
        forest.add(query[keep], leaf[keep])
    linked = np.flatnonzero(forest.label != np.arange(len(code)))
    return node[linked], node[forest.label[linked]]


def grouped_links(dealt: DataFrame, extra: list[str], block: int, link) -> DataFrame:
    """(src, dst): links that `link` finds in each group (t, key) of dealt (t, key, node, and the extra columns).

    A group of over `block` rows is dealt into blocks by a hash of the node, and each pair of blocks is a group. `link`
    takes the columns GROUP, block, node and the extra ones of whole groups, and returns two arrays of nodes.
    """
    large, _ = settle(dealt.groupBy("t", "key").count().where(F.col("count") > block), "large-nodes")
    if large.isEmpty():
        paired = dealt.withColumns({"one": F.lit(0), "two": F.lit(0), "block": F.lit(0)})
    else:
        blocks = F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
        mine = F.col("block")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(mine, other).alias("one"), F.greatest(mine, other).alias("two")))
        paired = (
            dealt.join(large, ["t", "key"], "left")
            .withColumn("blocks", blocks)
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("pair", F.explode(pairs))
            .select(*dealt.columns, "pair.one", "pair.two", "block")
        )
    names = [*GROUP, "block", "node", *extra]
    grouped = paired.select(*names).repartition(*GROUP).sortWithinPartitions(*GROUP)

    def run(batches):
        held: list[list[np.ndarray]] = []

        def flush(columns):
            a, b = link(columns)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"])

        for batch in batches:
            held.append([batch.column(n).to_numpy() for n in names])
            if sum(len(h[0]) for h in held) < 200_000:
                continue
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0))
            if not len(change):
                held = [columns]
                continue
            cut = int(change[-1]) + 1
            yield flush([c[:cut] for c in columns])
            held = [[c[cut:] for c in columns]]
        if held:
            yield flush([np.concatenate(c) for c in zip(*held, strict=True)])
        held = []
        give_back()

    return grouped.mapInArrow(run, "src long, dst long").distinct()


def permuted_codes(table_no: np.ndarray, fp: np.ndarray, chunks: int, choices) -> np.ndarray:
    """The code of each fingerprint in its index."""
    code = np.empty(len(fp), np.uint64)
    for t in np.unique(table_no).tolist():
        at = table_no == t
        code[at] = _permuted(fp[at], choices[t], chunks)[1]
    return code


def near_links(points: DataFrame, most: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(src, dst): forest links among points (fp, node), distinct in fp, that differ in `most` bits or fewer."""
    chunks, choices = chunk_plan(points.count(), most)

    def deal(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for t, chosen in enumerate(choices):
                key, _ = _permuted(fp, chosen, chunks)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), t, np.int32)), pa.array(key.view(np.int64)), batch.column("fp"), batch.column("node")], names=["t", "key", "fp", "node"])

    def link(columns):
        return forest_links(columns, permuted_codes(columns[0], columns[6].view(np.uint64), chunks, choices), most)

    dealt = points.select("fp", "node").mapInArrow(deal, "t int, key long, fp long, node long")
    return grouped_links(dealt, ["fp"], block, link)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, most: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id): component_id is the smallest key reachable by links.

    A null key is never a component's name unless all of its fingerprint's rows have null keys; these have none.
    """
    small_batches(df.sparkSession)
    marked, _ = settle(fingerprints(df, key, text, size), "fingerprints")
    points, _ = settle(marked.where(F.col(key).isNotNull()).groupBy("fp").agg(F.min(key).alias("node")), "points")
    found = connected_components(near_links(points, most, block))
    named = points.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(named, "fp", "left").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, most: int = MAX_BITS) -> DataFrame:
    """df with one row of each component, that of the smallest key; rows without a key stay.

    The texts move once, to meet the keys that stay. Where keys are repeated, one row of each stays.
    """
    found, _ = settle(near_duplicates(df, key, text, size, most), "components-of-rows")
    own = found.where(F.col(key) == F.col("component_id"))
    heads = own.groupBy(key).agg(F.count("*").alias("rows_of_key"))
    named, nameless = df.where(F.col(key).isNotNull()), df.where(F.col(key).isNull())
    kept = named.join(heads.select(key).hint("shuffle_hash"), key, "left_semi")  # no sort of the texts
    if not heads.where("rows_of_key > 1").isEmpty():
        kept = kept.dropDuplicates([key])
    return kept.unionByName(nameless)
