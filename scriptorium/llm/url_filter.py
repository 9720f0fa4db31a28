"""URLs judged by rules and by a list, through a blocked Bloom filter and an exact hash join.

What is listed are keys: a rule's host and path, and the canonical form of each listed URL (host in lower case, without
`www.` and a default port; path without closing slashes; query without tracking fields, in order; no scheme, no fragment).
The filter has blocks of 256 bits; a key sets one bit in each of a block's eight words, so a test reads one block. Blocks
are grouped in shards of at most SHARD_BLOCKS, which tasks build from the distinct hashes of their keys. Filters of up to
MOST_BYTES are broadcast; a larger one is joined shard by shard, each shard's row standing before the hashes that ask it.

A URL asks for one key of each shape of the rules (labels of the host, characters of the path) and for its canonical form.
Possible hits alone, with their keys as text, meet the list in a hash join that removes false positives, so results don't
depend on the filter. Each distinct URL is judged once, then rows find their URL. Keys that very many URLs share (`net/`)
and URLs that very many rows share are dealt to several tasks.

The longest rule wins (of equally long ones that with the longer host; of one rule given twice, block); where none fits,
listed URLs are blocked and others allowed. A null URL, or one without `://`, has an empty host and path, fits no rule, is
on no list and so is allowed. Repeated rows stay rows of their own; an empty table gives none; empty lists block nothing.
Only the columns asked for are carried, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.spread import spread_join
from scriptorium.session import settle

#: Words of a block, bits of the filter for each key, blocks of a shard (1 MB), bytes of a filter that is broadcast.
WORDS, BITS_PER_KEY, SHARD_BLOCKS, MOST_BYTES = 8, 16, 1 << 15, 1 << 25
#: Hashes that a task asks of one shard, where the filter isn't broadcast.
ASKED = 4_000_000
#: Odd multipliers that take a hash to its bit in each word, drawn once; multiples of one number would set bits in step.
_ODD = (2 * np.random.default_rng(11).integers(0, 1 << 31, WORDS) + 1).astype(np.uint32)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """The form that spellings of one URL share; null for what is no URL."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^www\.", "")
    fields = F.filter(F.split(F.regexp_extract(url, _PARTS, 3), "&"), lambda p: (p != "") & ~p.startswith("utm_") & ~p.startswith("ref="))
    query = F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(fields), "&"))).otherwise("")
    return F.when(F.contains(url, F.lit("://")), F.concat(host, F.rtrim(path_of(url), F.lit("/")), query))


def _rule_key(host: Column, path: Column) -> Column:
    return F.concat(F.lit("rule\n"), host, F.lit("\n"), path)


def _listed_key(url: Column) -> Column:
    return F.concat(F.lit("url\n"), canonical(url))


def known_keys(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, rule, size, verdict) of rules (host, path, verdict) and listed URLs (url), each key once; a listed URL has no rule."""
    keyed = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    size = F.struct((F.length("host") + F.length("path")).alias("all"), F.length("host").alias("host"))
    of_rules = keyed.select(_rule_key(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), size.alias("size"), "verdict")
    of_urls = listed.select(_listed_key(F.col("url")).alias("key")).where("key is not null").distinct()
    return of_rules.unionByName(of_urls.select("key", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("struct<all:int,host:int>").alias("size"), F.lit("block").alias("verdict")))


def _place(hashes: np.ndarray, shards: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, block in it, bit in each of the block's words) of hashes."""
    high = hashes.view(np.uint64) >> np.uint64(32)
    low = (hashes.view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return (high % np.uint64(shards)).astype(np.int64), (high // np.uint64(shards) % np.uint64(blocks)).astype(np.int64), np.uint32(1) << ((low[:, None] * _ODD) >> np.uint32(27))


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def build(hashes: DataFrame, shard_blocks: int = SHARD_BLOCKS) -> tuple[DataFrame, int, int]:
    """(shard, words) rows of a filter of distinct hashes (hash), with its shards and the blocks of each; written down."""
    keys, _ = settle(hashes.select("hash").distinct(), "listed")
    wanted = max(1, -(-keys.count() * BITS_PER_KEY // (32 * WORDS)))
    shards = -(-wanted // shard_blocks)
    blocks = -(-wanted // shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: dict[int, np.ndarray] = {}
        for batch in batches:
            shard, block, bits = _place(_longs(batch, "hash"), shards, blocks)
            for s in np.unique(shard).tolist():
                words = built.setdefault(s, np.zeros((blocks, WORDS), np.uint32))
                np.bitwise_or.at(words, block[shard == s], bits[shard == s])
        for s, words in built.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([words.astype("<u4").tobytes()], pa.binary())], names=["shard", "words"])

    dealt = keys.withColumn("shard", F.pmod(F.shiftrightunsigned("hash", 32), F.lit(shards))).repartition("shard")
    filter_rows, _ = settle(dealt.select("hash").mapInArrow(run, "shard int, words binary"), "filter")
    return filter_rows, shards, blocks


def _held(words: np.ndarray, block: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return ((words[block] & bits) == bits).all(axis=1)


def possible_hits(asked: DataFrame, rows: DataFrame, shards: int, blocks: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(url, key) of asked (url, keys array<string>) that the filter can't rule out: all that are listed, and few others."""
    hashed = asked.select("url", "keys", F.transform("keys", lambda k: F.xxhash64(k)).alias("hashes"))
    if shards * blocks * WORDS * 4 <= most_bytes:
        words = {r["shard"]: np.frombuffer(r["words"], "<u4").reshape(-1, WORDS) for r in rows.collect()}
        shared = asked.sparkSession.sparkContext.broadcast(words)

        def test(batches):
            known = shared.value
            for batch in batches:
                lists = batch.column("hashes")
                shard, block, bits = _place(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), shards, blocks)
                hit = np.zeros(len(shard), bool)
                for s in np.unique(shard).tolist():
                    if s in known:
                        hit[shard == s] = _held(known[s], block[shard == s], bits[shard == s])
                at = np.flatnonzero(hit)
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[at]
                yield pa.RecordBatch.from_arrays([batch.column("url").take(pa.array(row)), batch.column("keys").flatten().take(pa.array(at))], names=["url", "key"])

        return hashed.mapInArrow(test, "url string, key string")
    each = hashed.select("url", F.explode(F.arrays_zip("keys", "hashes")).alias("k")).select("url", F.col("k.keys").alias("key"), F.col("k.hashes").alias("hash"))
    salts = 1 + asked.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("n")).first()["n"] // (shards * ASKED)
    ask = each.select(F.pmod(F.shiftrightunsigned("hash", 32), F.lit(shards)).cast("int").alias("shard"), F.pmod("hash", F.lit(salts)).cast("int").alias("salt"), F.lit(None).cast("binary").alias("words"), "hash", "url", "key")
    stand = rows.select("shard", F.explode(F.sequence(F.lit(0), F.lit(int(salts) - 1))).alias("salt"), "words", F.lit(None).cast("long").alias("hash"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("key"))
    met = stand.unionByName(ask).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("words").isNull())

    def pass_on(batches):
        own, held = -1, None
        for batch in batches:
            shard = _longs(batch, "shard")
            for s in np.unique(shard).tolist():
                rows_of = batch.take(pa.array(np.flatnonzero(shard == s)))
                for data in rows_of.column("words").drop_null().to_pylist():
                    own, held = s, np.frombuffer(data, "<u4").reshape(-1, WORDS)
                asks = rows_of.filter(rows_of.column("words").is_null())
                if own == s and asks.num_rows:
                    _, block, bits = _place(_longs(asks, "hash"), shards, blocks)
                    yield asks.select(["url", "key"]).filter(pa.array(_held(held, block, bits)))

    return met.mapInArrow(pass_on, "url string, key string")


def judge(df: DataFrame, rules: DataFrame, listed: DataFrame, keep: list[str], url: str = "url", most_bytes: int = MOST_BYTES, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The columns of keep, and (host, path, rule, verdict, listed) of each row's URL.

    rules: (host, path, verdict), which fit a host and all below it, and paths that start with theirs. listed: (url).
    """
    if clash := {"host", "path", "rule", "verdict", "listed"} & set(keep):
        raise ValueError(f"columns to keep are named as those added: {sorted(clash)}")
    mine = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = df.select(*mine, F.col(url).alias("url"))
    urls, _ = settle(rows.groupBy("url").agg(F.count("*").alias("n")), "urls")
    known, _ = settle(known_keys(rules, listed), "known")
    shapes = rules.where("host is not null and path is not null").select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).distinct().collect()
    host, path, labels = host_of(F.col("url")), path_of(F.col("url")), F.size(F.split(F.col("host"), r"\."))
    of_shape = [F.when((labels >= s["labels"]) & (F.length("path") >= s["chars"]), _rule_key(F.substring_index("host", ".", -s["labels"]), F.substring("path", 1, s["chars"]))) for s in shapes]
    asked = urls.where("url is not null").select("url", host.alias("host"), path.alias("path")).select("url", F.array_compact(F.array(*of_shape, _listed_key(F.col("url")))).alias("keys"))
    hits, _ = settle(possible_hits(asked, *build(known.select(F.xxhash64("key").alias("hash")), shard_blocks), most_bytes), "hits")
    met = spread_join(hits, known, ["key"], ["url"])
    best = F.max_by(F.struct("rule", "verdict"), F.when(F.col("rule").isNotNull(), F.col("size")))
    judged = met.groupBy("url").agg(best.alias("best"), F.bool_or(F.col("rule").isNull()).alias("listed"))
    found = spread_join(rows, judged, ["url"], [f"k{i}" for i in range(len(keep))] or ["url"], "left", urls.select(F.xxhash64("url").alias("hash"), "n"))
    on_list = F.coalesce("listed", F.lit(False))
    verdict = F.coalesce("best.verdict", F.when(on_list, "block").otherwise("allow"))
    named = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    return found.select(*named, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), verdict.alias("verdict"), on_list.alias("listed"))


def oracle(rules: list[tuple[str, str, str]], hosts: str) -> str:
    """DuckDB SQL of the same verdicts on pages: every rule against every URL, and the listed ones by their canonical form."""
    given = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    return f"""WITH rules(rule_host, rule_path, said) AS (VALUES {given}),
        cut AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '{parts}', 1), ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract(url, '{parts}', 2), '') AS path,
            list_sort(list_filter(string_split(regexp_extract(url, '{parts}', 3), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND NOT starts_with(p, 'ref='))) AS fields FROM pages),
        named AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\\.', '') || rtrim(path, '/')
            || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END END AS canonical FROM cut),
        list AS (SELECT DISTINCT canonical FROM named WHERE regexp_matches(host, '{hosts}')),
        fit AS (SELECT DISTINCT ON (page_id, url) page_id, url, rule_host || rule_path AS rule, said FROM named JOIN rules
            ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            ORDER BY page_id, url, length(rule_host) + length(rule_path) DESC, length(rule_host) DESC, said DESC)
        SELECT page_id, host, path, rule, coalesce(said, CASE WHEN list.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, list.canonical IS NOT NULL AS listed
        FROM named LEFT JOIN fit USING (page_id, url) LEFT JOIN list ON named.canonical = list.canonical"""
