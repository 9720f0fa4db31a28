"""Near-duplicate operators and the pipeline against brute force."""

from random import Random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scriptorium.llm import itq, simhash


def closure(keys, linked):
    label = {k: k for k in keys}
    while True:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
        if not changed:
            return label


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 3 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def corpus(n=150):
    rnd = Random(2)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(500)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 120))) for _ in range(n)]
    for t in list(texts[:60]):
        own = t.split()
        if own:
            own[rnd.randrange(len(own))] = "CHANGED"
        texts += [t, t.upper(), " ".join(own)]
    return [*texts, "", None, " \t ", "é É", "one two"]


def test_fingerprints(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(df).collect()}
    assert got == {i: fingerprint(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("block", [simhash.BLOCK, 8])
def test_simhash_components(spark, block):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"fp": F.lit("clash"), "node": F.lit(1)})
    prints = [fingerprint(t) for t in texts]
    want = closure(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    got = simhash.near_duplicates(df, block=block).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in enumerate(prints)}


@pytest.mark.parametrize("points", [100, 1 << 30, 1 << 40])
def test_every_chunk_plan_finds_all_links(points):
    rnd = np.random.default_rng(1)
    codes = rnd.integers(0, 2**63, 400, dtype=np.uint64)
    near = codes.copy()
    for i in range(len(near)):
        for b in rnd.choice(64, rnd.integers(0, 7), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    dense = np.full(300, codes[0])
    for i in range(len(dense)):
        for b in rnd.choice(64, rnd.integers(1, 4), replace=False):
            dense[i] ^= np.uint64(1) << np.uint64(b)
    codes = np.unique(np.concatenate([codes, near, dense]))
    links = np.argwhere(np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4, 1)).tolist()
    chunks, choices = simhash.chunk_plan(points)
    table = np.repeat(np.arange(len(choices), dtype=np.int32), len(codes))
    key = np.concatenate([simhash._permuted(codes, c, chunks)[0] for c in choices]).view(np.int64)
    zero = np.zeros(len(table), np.int32)
    columns = [table, key, zero, zero, zero, np.tile(np.arange(len(codes)), len(choices))]
    a, b = simhash.forest_links(columns, simhash.permuted_codes(table, np.tile(codes, len(choices)), chunks, choices), 4)
    assert closure(range(len(codes)), zip(a.tolist(), b.tolist(), strict=True)) == closure(range(len(codes)), links)
    assert len(a) <= len(table)  # a forest a group, not all pairs


def test_gray_index_search():
    rnd = np.random.default_rng(5)
    codes = rnd.integers(0, 2**16, 600, dtype=np.uint64)
    group = np.sort(rnd.integers(0, 5, 600))
    order = np.lexsort((simhash.gray_rank(codes), group))
    codes = codes[order]
    index = simhash.GrayIndex(codes, group)
    got = {(int(q), int(leaf)) for qs, leaves in index.search(codes, group, 3) for q, leaf in zip(qs, leaves, strict=True)}
    want = {(a, b) for a in range(600) for b in range(600) if group[a] == group[b] and int(codes[a] ^ codes[b]).bit_count() <= 3}
    assert got == want
    ranks = simhash.gray_rank(np.array([0, 1, 3, 2, 6, 7, 5, 4], np.uint64))
    assert ranks.tolist() == list(range(8))


def test_simhash_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    rows = [(None, "a b c d e f"), (None, "only nameless words here now"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df.drop("component_id")).collect() if r.component_id is not None)
    assert got == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 3)]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None", "None"]


def vectors(n=300, dim=24, labels=3):
    rnd = np.random.default_rng(3)
    base = rnd.standard_normal((n, dim))
    near = base[: n // 3] + 0.12 * rnd.standard_normal((n // 3, dim))
    edge = base[: n // 4] + 0.35 * rnd.standard_normal((n // 4, dim))
    dense = base[0] + 0.05 * rnd.standard_normal((80, dim))
    rows = np.concatenate([base, near, edge, dense, base[:10], base[:10] * 3])
    label = np.concatenate([np.arange(n) % labels, np.arange(n // 3) % labels, np.arange(n // 4) % labels, np.zeros(80, int), np.arange(10) % labels, np.arange(10) % labels])
    return rows, label


def brute_links(rows, label, least=0.93):
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    return [(a, b) for a in range(len(rows)) for b in range(a) if label[a] == label[b] and unit[a] @ unit[b] >= least]


@pytest.mark.parametrize("block", [itq.BLOCK, 25])
def test_embedding_links(spark, block):
    rows, label = vectors()
    df = spark.createDataFrame([(i, r.tolist(), int(x)) for i, (r, x) in enumerate(zip(rows, label, strict=True))], "vec_id long, embedding array<double>, label int").withColumns({"node": F.lit("clash"), "v": F.lit(1)})
    got = {r.vec_id: r for r in itq.near_duplicates(df, block=block).collect()}
    want = brute_links(rows, label)
    degree = np.bincount(np.array(want).ravel(), minlength=len(rows))
    found = sum(r.n_links for r in got.values())
    assert found <= degree.sum() and found >= 0.97 * degree.sum()
    assert all(r.n_links <= degree[r.vec_id] for r in got.values())
    assert got[0].n_links >= 80 and all(r.kept == (r.component_id == r.vec_id) for r in got.values())


@pytest.mark.parametrize("dim", [16, 24, 64, 256, 768])
@pytest.mark.parametrize("shape", ["isotropic", "skewed", "mean", "clusters"])
def test_recall_at_the_threshold(dim, shape):
    """Pairs of unit vectors at a cosine of 0.93 exactly, the hardest that must be found, apart along random directions and along
    the data's own; vectors spread alike, by a steep spectrum, around a strong common mean, or in clusters."""
    rnd = np.random.default_rng(9)
    a = rnd.standard_normal((4000, dim))
    if shape == "skewed":
        a *= np.linspace(1, 0.05, dim) ** 2
    if shape == "mean":
        a += 1.2
    if shape == "clusters":
        a = 0.5 * a + rnd.standard_normal((40, dim))[rnd.integers(0, 40, 4000)]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    fit, asked = a[:2000], a[2000:]
    mean, projection = itq.fit_rotation(fit)
    radius = itq.fit_radius(fit, mean, projection)
    for side in (rnd.standard_normal(asked.shape), asked[rnd.permutation(len(asked))] - asked):
        gap = itq.codes(asked, mean, projection) ^ itq.codes(itq.moved(asked, side, 0.93), mean, projection)
        near = np.bitwise_count(gap) <= radius
        tables = np.any([np.bitwise_count(itq._substring(gap, low, high)) <= itq.PROBE for low, high in itq._cuts(min(64, dim), radius)], axis=0)
        assert (near <= tables).all() and near.mean() >= 0.98


def test_embedding_links_around_a_common_mean(spark):
    """End to end with production parameters: planted copies in 64 dimensions, a third of all rows with one label."""
    rnd = np.random.default_rng(12)
    base = rnd.standard_normal((600, 64)) + 1.0
    near = base[:200] + 0.3 * rnd.standard_normal((200, 64))
    rows = np.concatenate([base, near, base[:5]])
    label = np.where(np.arange(len(rows)) % 3 == 0, 0, np.arange(len(rows)) % 7)
    label[600:800], label[800:] = label[:200], label[:5]
    df = spark.createDataFrame([(i, r.tolist(), int(x)) for i, (r, x) in enumerate(zip(rows, label, strict=True))], "vec_id long, embedding array<double>, label int")
    want = brute_links(rows, label)
    degree = np.bincount(np.array(want).ravel(), minlength=len(rows))
    got = {r.vec_id: r for r in itq.near_duplicates(df).collect()}
    assert degree.sum() > 300 and sum(r.n_links for r in got.values()) >= 0.97 * degree.sum()
    assert all(r.n_links <= degree[r.vec_id] for r in got.values())


def test_rotation_balances_codes():
    rnd = np.random.default_rng(4)
    skewed = rnd.standard_normal((2000, 32)) * np.linspace(3, 0.2, 32)
    skewed /= np.linalg.norm(skewed, axis=1, keepdims=True)
    mean, projection = itq.fit_rotation(skewed)
    signs = (skewed - mean) @ projection >= 0
    assert np.abs(signs.mean(axis=0) - 0.5).max() < 0.1
    _, raw = itq.fit_rotation(skewed, rounds=0)
    loss = lambda p: np.mean((np.sign((skewed - mean) @ p) - (skewed - mean) @ p) ** 2)
    assert loss(projection) <= loss(raw)


def test_embedding_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 1), (13, [1e-300, 0.0], 1), (14, [1e300, 1e299], 1), (None, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in itq.near_duplicates(df).collect()}
    assert got[1] == got[12] == (4, 1) and got[2] == got[13] == (4, 1) and got[14] == (4, 1)
    assert all(got[k] == (0, k) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert itq.near_duplicates(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = Random(8)
    words = ["".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(3, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        text = [rnd.choice(words) for _ in range(60)]
        if i % 8 == 0:
            text[5] = "vermin" + rnd.choice("abcdef")
        labels.append((i, 1, int(i % 8 == 0)))
        rows.append((i, " ".join(text), "en", f"src{i % 4}"))
    rows += [(1000 + i, rows[i][1], "en", "src1") for i in range(1, 20)]
    rows += [(2000, "my password: hunter2hunter2 " + rows[3][1][::-1], "en", "src1"), (2001, None, None, None), (2002, "", "en", "src2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        seen[name] = {r.doc_id: r for r in now.collect()}
        if name != "tokens":
            assert now.columns == docs.columns
    toxic = {i for i in range(400) if i % 8 == 0}
    assert not toxic & set(seen["toxicity"]) and len(seen["toxicity"]) >= len(rows) - len(toxic) - 19
    assert not any(1000 + i in seen["near_duplicates"] for i in range(1, 20) if i % 8) and {1, 2, 3, 2000} <= set(seen["near_duplicates"])
    assert seen["secrets"][2000].text.startswith("my [assign] ") and set(seen["secrets"]) == set(seen["near_duplicates"])
    assert set(seen["mixing"]) < set(seen["secrets"]) and len(seen["mixing"]) > 0.4 * len(seen["secrets"])
    assert all(r.returns and r.n_tokens == len(r.ids) for r in seen["tokens"].values())
    whole = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == set(seen["tokens"])
