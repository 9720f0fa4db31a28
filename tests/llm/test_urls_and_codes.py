"""URL filter, sort-means and exponion against brute force."""

from hashlib import sha256
from math import floor, isfinite
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import exponion, neighbour_scan, sort_means, url_filter
from scriptorium.llm.queries import URL_RULES

RULES, LIST = "host string, path string, verdict string", "url string"
VECTOR = "vec_id long, embedding array<double>, label int"


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def same(url):
    """The canonical form, said once more."""
    host, path = cut(url)
    query = url.split("://", 1)[1].split("#")[0].partition("?")[2]
    fields = sorted(f for f in query.split("&") if f and not f.startswith(("utm_", "ref=")))
    for port in (":80", ":443"):
        host = host.removesuffix(port)
    return host.removeprefix("www.") + path.rstrip("/") + ("?" + "&".join(fields) if fields else "")


def judged(url, rules, listed):
    host, path = cut(url)
    fit = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    on_list = url is not None and "://" in url and same(url) in listed
    best = max(fit, default=None)
    return host, path, best[3] if best else None, best[2] if best else "block" if on_list else "allow", on_list


def urls(n=400):
    rnd = Random(5)
    hosts = ["a.example.net", "example.net", "xexample.net", "A.EXAMPLE.com", "b.org", "www.b.org", "b.org:80", "net", "", "c.d.e.example.com", "é.org"]
    paths = ["", "/", "/en/", "/en", "/en/1", "/de/x/", "/fr/y", "/fr//"]
    made = [rnd.choice(["http://", "https://", "x://", ""]) + rnd.choice(hosts) + rnd.choice(paths) + rnd.choice(["", "?a=1&b=2", "?b=2&a=1&utm_x=3", "#top", "?q#f?g", "?ref=1"]) for _ in range(n)]
    return [*made, None, "", "://", "a\n://h\n/p", "http://example.net/en/" + "x/" * 50_000, *["http://hot.example.net/en/1"] * 300]


@pytest.mark.parametrize(("most_bytes", "shard_blocks"), [(url_filter.MOST_BYTES, url_filter.SHARD_BLOCKS), (url_filter.MOST_BYTES, 1), (0, 1)])
def test_urls(spark, most_bytes, shard_blocks):
    made = urls()
    listed = [u for u in made[:60] if "://" in u]
    rules = [*URL_RULES, ("example.net", "/en/", "block"), ("net", "/en/1", "block"), ("example.net", "", "allow")]
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(made)], "page_id long, url string, host string, salt int")
    got = url_filter.judge(df, spark.createDataFrame(rules, RULES), spark.createDataFrame([(u,) for u in [*listed, None, "no"]], LIST), ["page_id"], most_bytes=most_bytes, shard_blocks=shard_blocks)
    forms = {same(u) for u in listed}
    found = {r.page_id: tuple(r)[1:] for r in got.collect()}
    assert got.count() == len(made)
    assert found == {i: judged(u, rules, forms) for i, u in enumerate(made)}


def test_urls_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a/b"), (1, "http://a/b"), (None, None)], "page_id long, url string")
    none, nothing = spark.createDataFrame([], RULES), spark.createDataFrame([], LIST)
    assert [r.verdict for r in url_filter.judge(pages, none, nothing, ["page_id"]).collect()] == ["allow"] * 3
    assert url_filter.judge(pages.limit(0), spark.createDataFrame(URL_RULES, RULES), pages, ["page_id"]).count() == 0
    with pytest.raises(ValueError, match="host"):
        url_filter.judge(pages.withColumn("host", F.lit(1)), none, nothing, ["host"])


def test_filter_misses_nothing_and_rules_out_most(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("hash"))
    rows, shards, blocks = url_filter.build(keys, shard_blocks=256)
    assert shards > 1 and rows.count() == shards
    words = {r.shard: np.frombuffer(r.words, "<u4").reshape(-1, url_filter.WORDS) for r in rows.collect()}

    def share(hashes):
        shard, block, bits = url_filter._place(np.array(hashes, np.int64), shards, blocks)
        return np.mean([url_filter._held(words[s], block[[i]], bits[[i]])[0] for i, s in enumerate(shard.tolist())])

    assert share([r[0] for r in keys.collect()]) == 1
    assert share([r[0] for r in spark.range(1_000_000, 1_020_000).select(F.xxhash64("id")).collect()]) < 0.01


def floors(v, scale):
    return [floor(scale * x) for x in v]


def lloyd(points, books, times):
    """Brute-force rounds over {key: integers}; books: lists of integers."""

    def near(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), i) for i, e in enumerate(books))

    for _ in range(times):
        own = {k: near(p)[1] for k, p in points.items()}
        for i in range(len(books)):
            mine = [points[k] for k in points if own[k] == i]
            if mine:
                books[i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return {k: near(p) for k, p in points.items()}


def vectors(n, dim, seed=3):
    rnd = np.random.default_rng(seed)
    middle = rnd.standard_normal((9, dim))
    made = (middle[rnd.integers(0, 9, n)] + 0.2 * rnd.standard_normal((n, dim))).round(3)
    made[n // 2 : n // 2 + n // 6] = made[0]
    made[-5:] = 0
    return made.tolist()


ODD = [None, [], [float("nan")] * 64, [float("inf")] + [0.0] * 63, [None] + [0.0] * 63, [1.0] * 63]


@pytest.mark.parametrize("n", [300, 7, 1])
def test_sort_means(spark, n):
    made = vectors(n, 64) if n > 20 else vectors(40, 64)[:n]
    rows = [(i, v, i % 3) for i, v in enumerate(made)] + [(10_000 + i, v, 1) for i, v in enumerate(ODD)]
    df = spark.createDataFrame(rows, VECTOR).withColumns({"cluster": F.lit("clash"), "entry": F.lit(1)}).repartition(3)
    points = {i: floors(v, 64) for i, v in enumerate(made)}
    first = sorted(points, key=lambda i: sha256(f"1:{i}".encode()).hexdigest())[:16]
    books = [list(points[i]) for i in first]
    want = lloyd(points, books, 3)
    got = sort_means.cluster(df).collect()
    assert {r.vec_id: (r.distance, r.cluster) for r in got} == want and len(got) == n
    for r in got:
        assert r.cluster_inertia == sum(d for d, c in want.values() if c == r.cluster)
        assert r.inertia == sum(d for d, _ in want.values())
        assert r.centroid_sha256 == sha256(",".join(map(str, books[r.cluster])).encode()).hexdigest()


def test_exponion(spark):
    made = vectors(250, 16)
    others = vectors(30, 11, 4)
    rows = [(i, v, (None, 1, 2)[i % 3]) for i, v in enumerate(made + others)] + [(900, None, 1), (901, [float("nan")], 1), (902, [], 5), (903, [None], None)]
    got = {r.vec_id: r for r in exponion.encode(spark.createDataFrame(rows, VECTOR).withColumn("label_error", F.lit("clash")).repartition(3)).collect()}
    assert sorted(got) == [*range(280), 902]
    assert (got[902].code, got[902].error, got[902].label_error) == ("00" * 8, 0, 0)
    codes, errors = {}, {}
    for base, part_of in ((0, made), (250, others)):
        said, dim = [], len(part_of[0])
        for p in range(8):
            low, high = dim * p // 8, dim * (p + 1) // 8
            points = {base + i: floors(v[low:high], 4096) for i, v in enumerate(part_of)}
            books = [list(points[base + i]) for i in range(16)]
            found = lloyd(points, books, 6)
            said += [x for e in books for x in e]
            for k, (d, c) in found.items():
                codes[k] = codes.get(k, "") + f"{c:02x}"
                errors[k] = errors.get(k, 0) + d
        assert {got[base + i].codebooks_sha256 for i in range(len(part_of))} == {sha256(",".join(map(str, said)).encode()).hexdigest()}
    assert {k: (got[k].code, got[k].error) for k in codes} == {k: (codes[k], errors[k]) for k in codes}
    label = {k: x for k, _, x in rows}
    assert all(got[k].label_error == sum(errors[j] for j in codes if label[j] == label[k]) for k in codes)


def test_repeated_and_null_keys(spark):
    rows = [(1, [0.5] * 64, 1), (1, [0.5] * 64, 1), (1, [0.25] * 64, None), (None, [0.75] * 64, None)]
    df = spark.createDataFrame(rows, VECTOR)
    assert sort_means.cluster(df).count() == exponion.encode(df).count() == 4
    assert sort_means.cluster(df.limit(0)).count() == exponion.encode(df.limit(0)).count() == 0
    assert {r.error for r in exponion.encode(df).collect()} == {0}


@pytest.mark.parametrize("x", [1e7, 1e30])
def test_too_large_for_exact_distances(spark, x):
    df = spark.createDataFrame([(1, [x] * 64, 1)], VECTOR)
    with pytest.raises(Exception, match="too large for exact"):
        sort_means.cluster(df)


@pytest.mark.parametrize("reach", [sort_means.reach, exponion.reach])
def test_scan_is_exact_from_any_start(reach):
    assert all(isfinite(x) for x in reach(np.array([0, 5]), np.array([neighbour_scan.FAR, 0])).tolist())
    rnd = np.random.default_rng(1)
    for width in (1, 2, 6):
        points, entries = rnd.integers(-4, 5, (500, width)), rnd.integers(-4, 5, (12, width))
        every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        for start in (np.zeros(500, np.int64), rnd.integers(0, 12, 500)):
            at, least = neighbour_scan.nearest(points, entries, start, reach)
            assert (at == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()
