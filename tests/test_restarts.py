"""Sinks, sources and streams that die, run again, or meet what they can't read."""

import json
from datetime import datetime

import pytest
import pandas as pd
from pyspark.sql import functions as F

from scriptorium.operators.seen import SeenTable
from scriptorium.plans.replays import lose_last_commit
from scriptorium.sources import ledger, paged, sinks
from scriptorium.streaming import flows
from scriptorium.streaming.library import CHANGE, LibraryShard, keep_library, library

HERE = "tests.test_restarts"
KEYS = [f"{i:04d}" for i in range(400)]


def refuses(chunk, key):
    if any(row["key"] == key for row in chunk):
        raise ledger.Refused("no more room")
    return [True] * len(chunk)


def fails(chunk, key):
    if any(row["key"] == key for row in chunk):
        raise OSError("the target is down")
    return [True] * len(chunk)


def choosy(chunk, key):
    return [row["key"] != key for row in chunk]


def decided(spark, keys=KEYS):
    return spark.createDataFrame([(k, "accept", "{}", ["x"]) for k in keys], "paper_id string, decision string, item string, collections array<string>").repartition(5)


def test_ledger_shows_nothing_of_a_failed_run(spark, tmp_path):
    path = str(tmp_path / "ledger")
    with pytest.raises(Exception, match="the target is down"):
        sinks.ingest(decided(spark), path, writes_enabled=True, gate=f"{HERE}:fails", argument="0399")
    assert ledger.items(spark, path).count() == ledger.audit(spark, path).count() == 0
    assert sinks.ingest(decided(spark), path, writes_enabled=True).count() == 400
    assert sinks.ingest(decided(spark, [*KEYS, "new", "new"]), path, writes_enabled=True).count() == 1
    assert sorted(r.key for r in ledger.items(spark, path).collect()) == sorted(r.key for r in ledger.audit(spark, path).collect()) == sorted([*KEYS, "new"])
    for manifest in (tmp_path / "ledger" / "manifests").iterdir():
        manifest.unlink()
    assert ledger.items(spark, path).count() == 0


def test_refused_chunk_stops_what_follows(spark, tmp_path):
    path = str(tmp_path / "ledger")
    got = sorted(r.key for r in sinks.ingest(decided(spark), path, writes_enabled=True, gate=f"{HERE}:refuses", argument="0200").collect())
    assert got == KEYS[: len(got)] and 200 - ledger.CHUNK < len(got) <= 200
    assert [(r.key, r.message.endswith("no more room")) for r in ledger.errors(spark, path).collect()] == [(None, True)]
    sinks.ingest(decided(spark), path, writes_enabled=True)
    assert sorted(r.key for r in ledger.items(spark, path).collect()) == KEYS


def test_refused_item_has_no_audit_line(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert sinks.ingest(decided(spark), path, writes_enabled=True, gate=f"{HERE}:choosy", argument="0007").count() == 399
    assert ledger.audit(spark, path).where("key = '0007'").isEmpty()
    assert [r.key for r in ledger.errors(spark, path).collect()] == ["0007"]
    with pytest.raises(Exception, match="append"):
        decided(spark).write.format("ledger").option("path", path).option("run", "r").mode("overwrite").save()


PAGE = "id string, year bigint"
FULL = f"{PAGE}, _query string, _page string, _place int, _error string"


def land(folder, query, page, results):
    (folder / query).mkdir(parents=True, exist_ok=True)
    (folder / query / f"{page:05d}.json").write_text(results if isinstance(results, str) else json.dumps({"results": results}))


def made(query, page):
    return [{"id": f"{query}{page}{j}", "year": 2020 + j} for j in range(3)]


def test_pages_as_a_table(spark, tmp_path):
    for q in "ab":
        for p in range(3):
            land(tmp_path, q, p, made(q, p))
    (tmp_path / "a" / "_half").write_text("{")
    paged.register(spark)
    df = spark.read.format("paged").option("folder", str(tmp_path)).option("schema", PAGE).load()
    assert df.count() == 18 and sorted(r.id for r in df.where("year >= 2022 and id <= 'a9'").collect()) == ["a02", "a12", "a22"]
    pages = ",".join(str(tmp_path / "a" / f"{p:05d}.json") for p in range(2))
    assert spark.read.format("paged").option("pages", pages).option("schema", PAGE).load().count() == 6
    land(tmp_path, "a", 3, '{"results": [1]}')
    with pytest.raises(Exception, match="no JSON object"):
        spark.read.format("paged").option("folder", str(tmp_path)).option("schema", PAGE).load().collect()
    told = spark.read.format("paged").option("folder", str(tmp_path)).option("schema", FULL).load()
    assert [(r._query, r._page, r.id) for r in told.where("_error is not null").collect()] == [("a", "00003.json", None)]
    assert told.where("_error is null").count() == 18


@pytest.mark.parametrize("limit", [0, 1, 4, 5, 100])
def test_limit_counts_rows_after_filters(spark, tmp_path, limit):
    for p in range(5):
        land(tmp_path, "q", p, made("q", p))
        land(tmp_path, "r", p, made("r", p)[: p % 2])
    paged.register(spark)
    df = spark.read.format("paged").option("folder", str(tmp_path)).option("schema", FULL).load()
    got = [r.id for r in paged.first_kept(df.where("year >= 2021"), limit).collect()]
    assert sorted(got) == sorted([f"q{p}{j}" for p in range(5) for j in (1, 2)][:limit])


def test_pages_as_a_stream(spark, tmp_path):
    folder, out = tmp_path / "landed", str(tmp_path / "out")
    paged.register(spark)
    for p in range(3):
        for q in "ab":
            land(folder, q, p, made(q, p))
        land(folder, "c", p, "{broken")
        stream = spark.readStream.format("paged").option("folder", str(folder)).option("schema", FULL).load()
        paged.split_batches(stream, out, f"{out}/state")
    rows = spark.read.schema(f"{PAGE}, batch long").parquet(f"{out}/rows")
    assert sorted((r.batch, r.id) for r in rows.collect()) == sorted((p, r["id"]) for p in range(3) for q in "ab" for r in made(q, p))
    assert sorted(r._page for r in spark.read.parquet(f"{out}/errors").collect()) == ["00000.json", "00001.json", "00002.json"]
    lose_last_commit(spark, f"{out}/state")
    paged.split_batches(spark.readStream.format("paged").option("folder", str(folder)).option("schema", FULL).load(), out, f"{out}/state")
    assert spark.read.parquet(f"{out}/rows").count() == 18


def keyed(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "seen_key string")


def test_seen_table_is_not_shuffled(spark, tmp_path):
    table = SeenTable(spark, str(tmp_path / "seen"), buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table.remember(keyed(spark, [f"k{i}" for i in range(1000)] + [None]), 0)
        table.remember(keyed(spark, ["late"]), 1)
        new = keyed(spark, ["k1", "k1000", "late", None])
        assert sorted((r.seen_key for r in table.unseen(new, 1).collect()), key=str) == sorted(["k1000", "late", None], key=str)
        assert table.unseen(new, 0).count() == 4
        plan = table.before(spark, 2).join(new, "seen_key", "left_semi")
        said = plan._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in said and said.count("Exchange hashpartitioning") == 1
        assert said.index("FileScan") < said.index("Exchange hashpartitioning") < said.index("ExistingRDD")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    table.remember(keyed(spark, ["other"]), 1)
    assert sorted(r.seen_key for r in table.before(spark, 2).where("seen_key not like 'k%'").collect()) == ["other"]
    table.merge(spark, 2)
    assert table.before(spark, 0).count() == 1001
    spark.sql(f"DROP TABLE {table.name}")
    assert SeenTable(spark, str(tmp_path / "seen"), buckets=4).before(spark, 0).count() == 1001


def test_forest_in_deltas_is_one_run_on_the_whole(spark, tmp_path):
    """Four deltas, one of them run twice, give the clusters of all records at once, and write members of touched trees only."""
    from random import Random

    from scriptorium.operators import dedup
    from scriptorium.operators.forest import Forest
    from scriptorium.schema import PAPER, conform

    rnd = Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8)))
    titles = [" ".join(word() for _ in range(7)) for _ in range(25)]
    rows = []
    for i in range(120):
        title = rnd.choice(titles)
        if rnd.random() < 0.3:
            at = rnd.randrange(len(title))
            title = title[:at] + rnd.choice("abcx") + title[at + 1 :]
        rows.append((i, title, f"10.5555/{rnd.randint(0, 40)}" if rnd.random() < 0.4 else None, f"{rnd.randint(1, 60)}" if rnd.random() < 0.2 else None))
    rows += [(200, "long " * 90 + "tail", None, None), (201, "long " * 90 + "tails", None, None), (202, None, None, None)]
    df = spark.createDataFrame(rows, "paper_id long, title string, doi string, pmid string")
    papers = conform(df.select("title", "doi", "pmid", F.col("paper_id").cast("string").alias("issue")), PAPER).withColumn("paper_id", F.col("issue").cast("long"))
    want = {r.paper_id: r.cluster for r in dedup.clusters(papers).select("paper_id", "cluster").collect()}
    assert 10 < len(set(want.values())) < 100
    forest = Forest(spark, str(tmp_path / "forest"), buckets=2)
    for run, (low, high) in enumerate([(0, 40), (40, 41), (41, 110), (110, 300)]):
        for _ in range(2 if run == 2 else 1):
            forest.add(papers.where(f"paper_id >= {low} and paper_id < {high}"), run)
    assert {r.paper_id: r.cluster for r in forest.clusters().collect()} == want
    assert forest.trees.numbered(spark, 9).where("batch = 1").count() <= 1 + max(list(want.values()).count(c) for c in set(want.values()))
    assert Forest(spark, str(tmp_path / "forest"), buckets=2).clusters().count() == len(rows)


def test_replayed_batch_keeps_its_rows(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "seen_key string, ts timestamp"
    for part in (["a", "b", "a"], ["b", "c"]):
        spark.createDataFrame([(k, datetime(2024, 1, 1)) for k in part], schema).coalesce(1).write.mode("append").parquet(src)
        flows.seen_batches(flows.read_stream(spark, src), out, f"{out}/state", F.col("seen_key") != "b")
    want = [(0, "a"), (0, "b"), (1, "b"), (1, "c")]
    rows = lambda: sorted((r.batch, r.seen_key) for r in spark.read.schema(f"{schema}, batch long").parquet(f"{out}/rows").collect())
    assert rows() == want
    for _ in range(2):
        lose_last_commit(spark, f"{out}/state")
        flows.seen_batches(flows.read_stream(spark, src), out, f"{out}/state", F.col("seen_key") != "b")
        assert rows() == want


def test_library_state(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    base = spark.createDataFrame([("c", "o", f"k{i}", 1, f"old{i}") for i in range(6)], "cache string, owner string, key string, version long, item string")

    def change(*rows):
        spark.createDataFrame([(r[0], s, *r[1:]) for s, r in rows], CHANGE).coalesce(1).write.mode("append").parquet(src)
        keep_library(spark.readStream.schema(CHANGE).parquet(src), f"{out}/rows", f"{out}/state", base, shards=3)

    def held():
        return {(r.cache, r.key): (r.item, r.stale) for r in library(spark, f"{out}/rows").collect()}

    change((1, ("c", "upsert", "o", "k1", 5, False, "new1")), (2, ("c", "upsert", "o", "k2", 5, True, "trashed")), (3, ("c", "delete", "o", "k3", 5, None, None)), (4, ("c", "upsert", "o", "k4", 0, False, "behind")), (5, ("c", "upsert", "x", "k5", 9, False, "not ours")), (6, ("d", "upsert", "p", "k1", 1, False, "d1")), (7, ("d", "upsert", "p", None, 1, False, "no key")))
    want = {("c", "k0"): ("old0", False), ("c", "k1"): ("new1", False), ("c", "k4"): ("old4", False), ("c", "k5"): ("old5", False), ("d", "k1"): ("d1", False)}
    assert held() == want
    change((8, ("c", "failed", "o", None, None, None, None)))
    assert held() == {k: (v[0], k[0] == "c") for k, v in want.items()}
    lose_last_commit(spark, f"{out}/state")
    change((9, ("d", "owner", "q", None, None, None, None)), (10, ("c", "owner", "o", None, None, None, None)), (11, ("d", "upsert", "p", "k1", 9, False, "too late")), (12, ("d", "upsert", "q", "k9", 1, False, "d9")))
    assert held() == {k: v for k, v in want.items() if k[0] == "c"} | {("d", "k9"): ("d9", False)}


def test_library_state_is_asked_once_for_each_item():
    """A micro-batch of many changes reads and writes each item of the state once, and an owner's change in it empties what came before."""
    asked, state = [], {"k1": (1, "old1"), "k2": (1, "old2"), "k3": (1, "old3")}

    class Items:
        def getValue(self, key):
            asked.append(("get", *key))
            return state.get(key[0])

        def containsKey(self, key):
            asked.append(("contains", *key))
            return key[0] in state

        def updateValue(self, key, value):
            asked.append(("update", *key))
            state[key[0]] = value

        def removeKey(self, key):
            asked.append(("remove", *key))
            state.pop(key[0], None)

        def keys(self):
            return iter([(k,) for k in state])

        def clear(self):
            state.clear()

    class Owner:
        value = ("o",)
        exists, get = (lambda self: True), (lambda self: self.value)

        def update(self, value):
            self.value = value

    shard = LibraryShard()
    shard.owner, shard.items = Owner(), Items()
    names = ["cache", "seq", "op", "owner", "key", "version", "deleted", "item"]
    run = lambda rows: {r.key: (r.seq, r.item) for r in pd.concat(shard.handleInputRows(("c", 0), iter([pd.DataFrame([("c", s, *r) for s, *r in rows], columns=names)]), None)).itertuples() if r.key}
    told = run([(i, "upsert", "o", f"k{i % 2}", i, False, f"i{i}") for i in range(2, 1000)] + [(1000, "delete", "o", "k2", 1000, None, None), (1001, "upsert", "o", "k1", 5, False, "behind")])
    assert told == {"k0": (998, "i998"), "k1": (999, "i999"), "k2": (1000, None)}
    assert state == {"k0": (998, "i998"), "k1": (999, "i999"), "k3": (1, "old3")}
    assert len(asked) == 6
    told = run([(2000, "upsert", "o", "k4", 1, False, "i4"), (2001, "delete", "o", "k3", 9, None, None), (2002, "owner", "p", None, None, None, None), (2003, "upsert", "p", "k0", 1, False, "new"), (2004, "upsert", "o", "k1", 9, False, "too late")])
    assert told == {"k4": (2002, None), "k3": (2001, None), "k0": (2003, "new"), "k1": (2002, None)}
    assert state == {"k0": (1, "new")} and shard.owner.value == ("p",)
