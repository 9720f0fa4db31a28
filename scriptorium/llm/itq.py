"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation is learned on a bounded sample (SAMPLE vectors, those with the smallest hash of their id): principal
directions, then alternating sign codes and orthogonal Procrustes solutions, so that the signs make balanced binary codes of
up to 64 bits that keep angles. The radius is learned too: vectors of the sample are moved to the least cosine, along random
directions and along the sample's own differences, and RECALL of the codes must stay within it; a strong common mean or few
bits so widen or narrow it. Every vector's code is cut into as many substrings as make codes within the radius agree on some
substring up to PROBE bits, so a vector stands in the bucket of each of its substrings and asks in those that differ in up
to PROBE bits; of two vectors only the one with the larger substring asks. What a bucket yields is filtered by whole codes,
each pair is kept by its first table only, and the original vectors decide in double precision.

First only codes are dealt to buckets, and the entries that have a candidate there are kept; their vectors are fetched,
once for each bucket, and the bucket verifies its pairs again with them. It passes on, for each node, how many vectors its
links reach and the root of its forest: never pairs, so a group of n near copies costs n rows a bucket. A bucket with over
BLOCK entries is dealt into blocks by hash, every pair of them compared on its own; comparisons go in slices.

Vectors that are null, empty, zero or hold a null or a non-finite number, and those with a null label, link with nothing.
Vectors of different length or label aren't compared. Equal vectors with one label are one point, and count each other
as links. Rows with the same vec_id stay rows of their own; links are between rows' vectors.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.batches import give_back
from scriptorium.llm.sampling import bounded_sample
from scriptorium.llm.simhash import Forest
from scriptorium.operators.components import connected_components
from scriptorium.session import settle

SAMPLE, MAX_BITS, ROUNDS, PROBE, BLOCK, LEAST_COSINE = 20_000, 64, 50, 1, 2_048, 0.93
#: Share of pairs at the least cosine that codes must keep, by the sample, and how many of it are moved to tell.
RECALL, MOVED = 0.998, 4_000
SEED = 7
#: Pairs of codes held at once while a bucket is read, and pairs of vectors compared at once.
SLICE, PAIRS = 1 << 22, 1 << 16


def fit_rotation(sample: np.ndarray, bits: int = MAX_BITS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to `bits` numbers whose signs are the code) of unit vectors."""
    dim = sample.shape[1]
    bits = min(bits, dim)
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dim)
    centred = sample - mean
    _, directions = np.linalg.eigh(centred.T @ centred + 1e-12 * np.eye(dim))
    main = directions[:, ::-1][:, :bits]
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    flat = centred @ main
    for _ in range(rounds if len(sample) else 0):
        code = np.where(flat @ rotation >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(code.T @ flat)
        rotation = (u @ v).T
    return mean, main @ rotation


def codes(unit: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Binary codes (uint64) of unit vectors."""
    signs = ((unit - mean) @ projection) >= 0
    return (signs.astype(np.uint64) << np.arange(signs.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def moved(unit: np.ndarray, side: np.ndarray, least: float) -> np.ndarray:
    """Unit vectors at the least cosine to the given ones, towards the part of `side` that is orthogonal to them."""
    side = side - (side * unit).sum(axis=1, keepdims=True) * unit
    size = np.sqrt((side * side).sum(axis=1, keepdims=True))
    return least * unit + np.sqrt(1 - least * least) * np.divide(side, size, out=np.zeros_like(side), where=size > 1e-9)


def fit_radius(sample: np.ndarray, mean: np.ndarray, projection: np.ndarray, least: float = LEAST_COSINE, seed: int = SEED) -> int:
    """The bits within which RECALL of pairs at the least cosine differ, whichever way they lie apart."""
    bits = projection.shape[1]
    if len(sample) < 2:
        return bits
    rnd = np.random.default_rng(seed)
    unit = sample[rnd.permutation(len(sample))[:MOVED]]
    sides = (rnd.standard_normal(unit.shape), sample[rnd.integers(0, len(sample), len(unit))] - sample[rnd.integers(0, len(sample), len(unit))])
    own = codes(unit, mean, projection)
    gaps = [np.bitwise_count(own ^ codes(moved(unit, side, least), mean, projection)) for side in sides]
    return min(bits, int(max(np.quantile(g, RECALL, method="higher") for g in gaps)) + 1)


def _cuts(bits: int, radius: int) -> list[tuple[int, int]]:
    """Substrings so many that codes within the radius agree on one of them up to PROBE bits."""
    tables = min(bits, radius // (PROBE + 1) + 1)
    edges = [bits * i // tables for i in range(tables + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _substring(code: np.ndarray, low: int, high: int) -> np.ndarray:
    return (code >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)


def _usable(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    single = df.schema[vector].dataType.simpleString() == "array<float>"
    v = F.col(vector) if single else F.col(vector).cast("array<double>")
    whole = F.col(vector).isNotNull() & F.col(label).isNotNull() & (F.size(v) > 0)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), v.alias("v")).where(whole & F.coalesce(finite & some, F.lit(False)))


def _unit(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """Unit vectors of one length, in double precision; scaled first, so that no square overflows."""
    rows = batch.column(name)
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _by_length(batch: pa.RecordBatch, name: str):
    sizes = np.diff(batch.column(name).offsets.to_numpy())
    for size in np.unique(sizes):
        yield int(size), batch.take(pa.array(np.flatnonzero(sizes == size)))


#: Bits and radius of the codes of vectors of a length.
Plan = dict[int, tuple[int, int]]


def _coded(points: DataFrame, least: float = LEAST_COSINE, radius: int | None = None) -> tuple[DataFrame, Plan]:
    """(node, label, dim, code) of points, and the plan of the codes; each length of vector has a rotation of its own."""
    spark = points.sparkSession
    sample = bounded_sample(points, "node", SAMPLE).select("v").collect()
    by: dict[int, list[list[float]]] = {}
    for row in sample:
        by.setdefault(len(row["v"]), []).append(row["v"])
    fitted, plan = {}, {}
    for dim, rows in by.items():
        unit = _unit(pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], names=["v"]), "v")
        fitted[dim] = fit_rotation(unit)
        plan[dim] = (min(MAX_BITS, dim), fit_radius(unit, *fitted[dim], least) if radius is None else radius)
    shared = spark.sparkContext.broadcast(fitted)

    def run(batches):
        known = shared.value
        for batch in batches:
            for dim, rows in _by_length(batch, "v"):
                mean, projection = known.get(dim) or fit_rotation(np.zeros((0, dim)))
                found = codes(_unit(rows, "v"), mean, projection)
                yield pa.RecordBatch.from_arrays([rows.column("node"), rows.column("label"), pa.array(np.full(len(found), dim, np.int32)), pa.array(found.view(np.int64))], names=["node", "label", "dim", "code"])

    return points.select("node", "label", "v").mapInArrow(run, "node long, label string, dim int, code long"), plan


def _planned(plan: Plan, dim: int) -> tuple[int, int]:
    """A length that the sample lacks has so few vectors that all its codes may be compared."""
    bits = min(MAX_BITS, dim)
    return plan.get(dim, (bits, bits))


def _dealt(coded: DataFrame, plan: Plan) -> DataFrame:
    """A row for each bucket that a code stands in (asks false) or asks in (asks true)."""

    def run(batches):
        names = ["label", "dim", "t", "bucket", "asks", "node", "code"]
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = batch.take(pa.array(np.flatnonzero(dims == dim)))
                code = rows.column("code").to_numpy().view(np.uint64)
                for t, (low, high) in enumerate(_cuts(*_planned(plan, int(dim)))):
                    own = _substring(code, low, high)
                    for flips in (c for k in range(min(PROBE, high - low) + 1) for c in combinations(range(high - low), k)):
                        mask = np.uint64(sum(1 << b for b in flips))
                        asks = (own ^ mask) < own if flips else np.ones(len(own), bool)
                        at = pa.array(np.flatnonzero(asks))
                        part, n = rows.take(at), len(at)
                        bucket = (own ^ mask)[asks].view(np.int64)
                        yield pa.RecordBatch.from_arrays([part.column("label"), part.column("dim"), pa.array(np.full(n, t, np.int32)), pa.array(bucket), pa.array(np.full(n, bool(flips))), part.column("node"), part.column("code")], names=names)

    return coded.mapInArrow(run, "label string, dim int, t int, bucket long, asks boolean, node long, code long")


def _close(code_a: np.ndarray, code_b: np.ndarray, t: int, cuts, radius: int) -> np.ndarray:
    """Pairs within the radius whose first table that finds them is `t`."""
    gap = code_a ^ code_b
    keep = np.bitwise_count(gap) <= radius
    for low, high in cuts[:t]:
        keep &= np.bitwise_count(_substring(gap, low, high)) > PROBE
    return keep


def _groups(batches, keys: list[str]):
    """The rows of each group of equal keys, of batches sorted by them, as a table; a group may span batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.array(batch.column(k).to_pylist(), object) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        bounds = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    held = []
    give_back()


def _candidates(part: dict, plan: Plan):
    """Yield (asking, standing) positions of pairs of one bucket's two blocks whose codes are within the radius, each
    pair of nodes in its first table only."""
    t, dim = int(part["t"][0]), int(part["dim"][0])
    bits, radius = _planned(plan, dim)
    cuts = _cuts(bits, radius)
    same = part["one"][0] == part["two"][0]
    stands = np.flatnonzero(~part["asks"])
    for asks in (np.flatnonzero(part["asks"]), stands):
        step = max(1, SLICE // max(1, len(stands)))
        for k in range(0, len(asks), step):
            a = asks[k : k + step]
            keep = _close(part["code"][a][:, None], part["code"][stands][None, :], t, cuts, radius)
            if not same:
                keep &= part["block"][a][:, None] != part["block"][stands][None, :]
            if asks is stands:
                keep &= part["node"][a][:, None] > part["node"][stands][None, :]
            i, j = np.nonzero(keep)
            if len(i):
                yield a[i], stands[j]


_KEYS = ["label", "dim", "t", "bucket", "one", "two"]
_PLAIN = ["t", "dim", "one", "two", "asks", "block", "node", "code"]
_MEMBER = "label string, dim int, t int, bucket long, one int, two int, asks boolean, block int, node long, code long"


def _arrays(table: pa.Table) -> dict:
    out = {n: table.column(n).to_numpy() for n in _PLAIN}
    out["code"] = out["code"].view(np.uint64)
    return out


def members(coded: DataFrame, plan: Plan, block: int = BLOCK) -> DataFrame:
    """The entries of buckets that have a candidate there: a row for each, never one for each pair."""
    keys = ["label", "dim", "t", "bucket"]
    dealt, _ = settle(_dealt(coded, plan), "buckets")
    large, _ = settle(dealt.groupBy(*keys).count().where(F.col("count") > block), "large-buckets")
    if large.isEmpty():
        paired = dealt.withColumns({"one": F.lit(0), "two": F.lit(0), "block": F.lit(0)})
    else:
        mine = F.col("block")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(mine, o).alias("one"), F.greatest(mine, o).alias("two")))
        paired = (
            dealt.join(large, keys, "left")
            .withColumn("blocks", F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int"))
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("pair", F.explode(pairs))
            .select(*keys, "asks", "node", "code", "pair.one", "pair.two", "block")
        )
    names = [*_KEYS, "asks", "block", "node", "code"]
    grouped = paired.select(*names).repartition(*_KEYS).sortWithinPartitions(*_KEYS)

    def run(batches):
        for table in _groups(batches, _KEYS):
            part = _arrays(table)
            has = np.zeros(table.num_rows, bool)
            for a, b in _candidates(part, plan):
                has[a] = has[b] = True
            if has.any():
                yield from table.filter(pa.array(has)).select(names).to_batches()

    return grouped.mapInArrow(run, _MEMBER)


def links(points: DataFrame, least: float = LEAST_COSINE, block: int = BLOCK, radius: int | None = None) -> DataFrame:
    """(node, others, root) of points (node, label, v, n): in each bucket, how many vectors a node's own links reach, and
    the root of its forest of links. Pairs are counted where they are verified, and not passed on."""
    coded, plan = _coded(points, least, radius)
    met, _ = settle(members(coded, plan, block), "members")
    entries = met.join(points.select("node", "v", "n"), "node")
    names = [*_KEYS, "asks", "block", "node", "code", "n", "v"]
    grouped = entries.select(*names).repartition(*_KEYS).sortWithinPartitions(*_KEYS)

    def run(batches):
        for table in _groups(batches, _KEYS):
            part, size = _arrays(table), table.column("n").to_numpy()
            unit = _unit(table.select(["v"]).to_batches()[0], "v")
            nodes, place = np.unique(part["node"], return_inverse=True)
            others, forest = np.zeros(len(nodes), np.int64), Forest(len(nodes))
            for a, b in _candidates(part, plan):
                for k in range(0, len(a), PAIRS):
                    x, y = a[k : k + PAIRS], b[k : k + PAIRS]
                    near = np.einsum("ij,ij->i", unit[x], unit[y]) >= least
                    x, y = x[near], y[near]
                    np.add.at(others, place[x], size[y])
                    np.add.at(others, place[y], size[x])
                    forest.add(place[x], place[y])
            some = np.flatnonzero(others)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(others[some]), pa.array(nodes[forest.label[some]])], names=["node", "others", "root"])

    return grouped.mapInArrow(run, "node long, others long, root long")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST_COSINE, block: int = BLOCK, radius: int | None = None) -> DataFrame:
    """(key, n_links, component_id, kept) of every vector; kept ones are the smallest of their component."""
    usable = _usable(df, key, vector, label)
    points, _ = settle(usable.groupBy("label", "v").agg(F.min("id").alias("node"), F.count("*").alias("n")), "points")
    found, _ = settle(links(points, least, block, radius), "links")
    linked = found.groupBy("node").agg(F.sum("others").alias("others"))
    components = connected_components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    named = points.join(linked, "node", "left").join(components, "node", "left")
    rows = named.select("label", "v", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    marked = usable.join(rows, ["label", "v"]).select(F.col("id").alias(key), "n_links", "component_id")
    per_row = marked.groupBy(key).agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = df.select(F.col(key).cast("long").alias(key)).join(per_row, key, "left")
    component = F.coalesce("component_id", key)
    return out.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col(key)).alias("kept"))
