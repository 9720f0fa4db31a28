"""Token ids in binary files, coded by a static range asymmetric numeral system (rANS).

One frequency table, counted over all ids and scaled to 2**TABLE_BITS, is shared by all blocks. A block holds the ids of
whole texts, in ascending order of their keys, BLOCK_IDS or a little more (a longer text is a block of its own), and can be
decoded alone. Its ids are dealt to LANES interleaved coders of 64-bit state that share one stream of 32-bit words.
Every CHECKPOINT_STEPS rounds the block keeps the coders' states, the place in the stream and the CRC-32 of the ids that
follow, so pieces of one block decode in parallel, and damage is told. Many blocks are coded, and many pieces
decoded, in the same numpy steps.

Files: a folder with `table` (one row: the scaled table) and `blocks` (one row a block: part and place give the order, and the
bytes of the block describe themselves). A place is a text's number in its part, written beside its ids, so the order
holds however the session cuts its files.

Null texts are empty; every text ends with the end id, so none is without ids. Null keys come first. Rows that share a
key keep their own ids, in the order of a hash of their texts, and may be dealt to several parts. An empty table gives files
without blocks.
"""

from __future__ import annotations

import struct
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.batches import pieces
from scriptorium.llm.bpe import byte_symbols
from scriptorium.llm.pretokens import WordEncoder
from scriptorium.session import drop_path, settle, shuffle_files_dropped

TABLE_BITS, LANES, CHECKPOINT_STEPS, BLOCK_IDS, TOGETHER = 20, 128, 256, 1 << 16, 16
#: Bytes of text whose words are looked up together.
PIECE_BYTES = 2_000_000
_LOW, _MAGIC = np.uint64(1 << 31), b"rANS"
_U32, _BITS = np.uint64(32), np.uint64(TABLE_BITS)


#: A block of more ids is encoded alone; pieces decoded together.
LONG_IDS, PIECES = 4 * BLOCK_IDS, 256


class Damaged(ValueError):
    """A block whose bytes or ids don't fit its marks."""


class LibraryEncoder(WordEncoder):
    """Ids of the tokenizers library: its BPE model tokenizes each distinct pre-token, in the symbols of its bytes, once."""

    store_words = 1_500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        super().__init__({t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()})
        self.model = tokenizer.model
        self.largest = max(tokenizer.get_vocab(with_added_tokens=True).values())
        #: Byte 255, which UTF-8 never holds, parts the words.
        self.symbols = dict(enumerate(byte_symbols())) | {255: "\n"}

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        shown = b"\xff".join([w.encode() for w in words]).decode("latin-1").translate(self.symbols).split("\n")
        tokenize = self.model.tokenize
        ids = [[token.id for token in tokenize(w)] for w in shown]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum())), size


@cache
def encoder(path: str) -> LibraryEncoder:
    """One tokenizer and word store per worker."""
    return LibraryEncoder(path)


def scaled(counts: np.ndarray, bits: int = TABLE_BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 where a count is; ties go to lower ids."""
    total, size = int(counts.sum()), 1 << bits
    present = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if not total:
        return out
    if len(present) > size:
        raise ValueError(f"{len(present)} symbols don't fit a table of {size}")
    spare = size - len(present)
    exact = counts[present].astype(np.float64) * spare / total
    out[present] = 1 + np.floor(exact).astype(np.int64)
    left = size - int(out.sum())
    order = np.lexsort((present, -(exact - np.floor(exact))))
    out[present[order[:left]]] += 1
    return out


class Coder:
    """Encodes and decodes blocks by one table."""

    def __init__(self, frequencies: np.ndarray):
        self.f = frequencies.astype(np.uint64)
        self.begin = (np.cumsum(frequencies) - frequencies).astype(np.uint64)
        self.limit = self.f << np.uint64(63 - TABLE_BITS)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.int64), frequencies)
        self.filler = int(np.argmax(frequencies)) if len(frequencies) else 0

    def encode(self, blocks: list[tuple[list[int | None], list[np.ndarray]]]) -> list[bytes]:
        """The bytes of each block of (keys, ids of each key's text); blocks step together, but a long one alone, so that no
        other is padded to its length."""
        sizes = [sum(map(len, ids)) for _, ids in blocks]
        short = [b for b, n in enumerate(sizes) if n <= LONG_IDS]
        out: list[bytes] = [b""] * len(blocks)
        for group in ([short] if short else []) + [[b] for b, n in enumerate(sizes) if n > LONG_IDS]:
            for b, data in zip(group, self._together([blocks[b] for b in group]), strict=True):
                out[b] = data
        return out

    def _together(self, blocks: list[tuple[list[int | None], list[np.ndarray]]]) -> list[bytes]:
        flat = [np.concatenate(ids).astype(np.int32) for _, ids in blocks]
        steps = np.array([-(-len(x) // LANES) for x in flat])
        order = np.argsort(-steps, kind="stable")
        most = int(steps.max())
        symbols = np.full((len(blocks), most * LANES), self.filler, np.int32)
        for row, b in enumerate(order.tolist()):
            symbols[row, : len(flat[b])] = flat[b]
        if symbols.max() >= len(self.f) or not self.f[symbols].all():
            raise ValueError("an id isn't in the table")
        symbols = np.ascontiguousarray(symbols.reshape(len(blocks), most, LANES).transpose(1, 0, 2)).reshape(most, -1)
        live = np.searchsorted(-steps[order], -np.arange(most), side="left")  # blocks with over `step` steps
        state = np.full(len(blocks) * LANES, _LOW, np.uint64)
        words, owners, counts, marks = [], [], np.zeros((most, len(blocks)), np.int32), {}
        for step in range(most - 1, -1, -1):
            n = int(live[step]) * LANES
            x, s = state[:n], symbols[step, :n]
            over = x >= self.limit[s]
            words.append((x[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            owners.append(np.flatnonzero(over) // LANES)
            counts[step, : n // LANES] = over.reshape(-1, LANES).sum(axis=1)
            x = np.where(over, x >> _U32, x)
            f = self.f[s]
            high = x // f
            state[:n] = (high << _BITS) + (x - high * f) + self.begin[s]
            if step % CHECKPOINT_STEPS == 0:
                marks[step] = state[:n].copy()
        stream, owner = np.concatenate(words[::-1]), np.concatenate(owners[::-1])
        stream = stream[np.argsort(owner, kind="stable")]
        ends = np.cumsum(np.bincount(owner, minlength=len(blocks)))
        out: list[bytes] = [b""] * len(blocks)
        for row, b in enumerate(order.tolist()):
            keys, ids = blocks[b]
            places = np.concatenate([[0], np.cumsum(counts[:, row], dtype=np.int64)])
            points = range(0, int(steps[b]), CHECKPOINT_STEPS)
            own = stream[(ends[row - 1] if row else 0) : ends[row]]
            out[b] = self._packed(keys, ids, flat[b], own, [(int(places[p]), marks[p][row * LANES : (row + 1) * LANES]) for p in points])
        return out

    @staticmethod
    def _packed(keys, ids, flat, words, points) -> bytes:
        null = np.array([k is None for k in keys], np.uint8)
        head = struct.pack("<4sIIQII", _MAGIC, LANES, CHECKPOINT_STEPS, len(flat), len(keys), len(points))
        body = [np.array([k or 0 for k in keys], "<i8").tobytes(), null.tobytes(), np.array([len(x) for x in ids], "<u8").tobytes()]
        wide = LANES * CHECKPOINT_STEPS
        for i, (place, states) in enumerate(points):
            check = zlib.crc32(flat[i * wide : (i + 1) * wide].astype("<u4").tobytes())
            body += [struct.pack("<QI", place, check), states.astype("<u8").tobytes()]
        body.append(words.astype("<u4").tobytes())
        data = head + b"".join(body)
        return data + struct.pack("<I", zlib.crc32(data))

    def decode(self, blocks: list[bytes]) -> list[tuple[list[int | None], list[np.ndarray]]]:
        """(keys, ids of each key's text) of each block; all pieces between checkpoints step together."""
        read, pieces = [], []
        for b, data in enumerate(blocks):
            if len(data) < 32 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
                raise Damaged("a block's checksum doesn't fit")
            magic, lanes, every, n, n_keys, n_points = struct.unpack_from("<4sIIQII", data)
            if magic != _MAGIC:
                raise Damaged("not a block")
            at = struct.calcsize("<4sIIQII")
            keys = np.frombuffer(data, "<i8", n_keys, at)
            null = np.frombuffer(data, np.uint8, n_keys, at + 8 * n_keys)
            sizes = np.frombuffer(data, "<u8", n_keys, at + 9 * n_keys).astype(np.int64)
            at += 17 * n_keys
            found = []
            for i in range(n_points):
                place, check = struct.unpack_from("<QI", data, at)
                found.append((b, i, place, check, np.frombuffer(data, "<u8", lanes, at + 12), min(every, -(-(n - i * every * lanes) // lanes))))
                at += 12 + 8 * lanes
            words = np.frombuffer(data, "<u4", (len(data) - 4 - at) // 4, at)
            read.append(([None if z else k for k, z in zip(keys.tolist(), null.tolist(), strict=True)], sizes, n, lanes, every, words, np.empty(n_points * every * lanes, np.int64)))
            pieces += found
        for lanes in {r[3] for r in read}:
            alike = [p for p in pieces if read[p[0]][3] == lanes]
            for k in range(0, len(alike), PIECES):
                self._run(alike[k : k + PIECES], read, lanes)
        out = []
        checks: dict[int, list] = {}
        for piece in pieces:
            checks.setdefault(piece[0], []).append(piece)
        for b, (keys, sizes, n, lanes, every, _, flat) in enumerate(read):
            for _, i, _, check, _, _ in checks.get(b, ()):
                if zlib.crc32(flat[i * every * lanes : min(n, (i + 1) * every * lanes)].astype("<u4").tobytes()) != check:
                    raise Damaged("a piece's checksum doesn't fit")
            ends = np.cumsum(sizes)
            out.append((keys, [flat[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]))
        return out

    def _run(self, pieces, read, lanes: int) -> None:
        """Decode pieces into their blocks' arrays."""
        if not pieces:
            return
        pieces = sorted(pieces, key=lambda p: -p[5])
        some = sorted({p[0] for p in pieces})
        bases = dict(zip(some, np.cumsum([0, *(len(read[b][5]) for b in some)]).tolist(), strict=False))
        stream = np.concatenate([*(read[b][5] for b in some), np.zeros(1, np.uint32)])
        pointer = np.array([bases[p[0]] + p[2] for p in pieces])
        state = np.concatenate([p[4] for p in pieces]).astype(np.uint64)
        steps = np.array([p[5] for p in pieces])
        most = int(steps[0])
        live = np.searchsorted(-steps, -np.arange(most), side="left")
        got = np.empty((most, len(state)), np.int64)
        mask = np.uint64((1 << TABLE_BITS) - 1)
        for step in range(most):
            k = int(live[step])
            x = state[: k * lanes]
            slot = x & mask
            s = self.symbol[slot.astype(np.int64)]
            got[step, : k * lanes] = s
            x = self.f[s] * (x >> _BITS) + slot - self.begin[s]
            need = (x < _LOW).reshape(k, lanes)
            rank = need.cumsum(axis=1)
            place = (pointer[:k, None] + rank - 1)[need]
            need = need.ravel()
            x[need] = (x[need] << _U32) | stream[np.minimum(place, len(stream) - 1)].astype(np.uint64)
            pointer[:k] += rank[:, -1]
            state[: k * lanes] = x
        got = got.reshape(most, len(pieces), lanes)
        for j, (b, i, _, _, _, n) in enumerate(pieces):
            begin = i * read[b][4] * lanes
            read[b][6][begin : begin + n * lanes] = got[:n, j].ravel()


_TOKENS = "key long, place long, ids binary, counts binary"


def _encode_rows(df: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(key, place in the task, ids, null) of each text, and after a task's last one how often each id occurs in its texts."""

    def run(batches):
        coder = encoder(tokenizer)
        wide = "<u2" if max(end_id, coder.largest) <= 0xFFFF else "<u4"
        mark, last = wide[-1].encode(), np.array([end_id], wide).tobytes()
        total = np.zeros(max(end_id, coder.largest) + 1, np.int64)
        names, place = ["key", "place", "ids", "counts"], 0
        for rows in pieces(batches, "text", PIECE_BYTES):
            found = coder.encode(rows.column("text").to_pylist())
            total += np.bincount(np.concatenate(found), minlength=len(total))
            total[end_id] += len(found)
            data = [mark + x.astype(wide).tobytes() + last for x in found]
            places = pa.array(np.arange(place, place + len(data)))
            place += len(data)
            yield pa.RecordBatch.from_arrays([rows.column("key"), places, pa.array(data, pa.binary()), pa.nulls(len(data), pa.binary())], names=names)
        none = pa.array([None], pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array([None], pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=names)

    return df.mapInArrow(run, _TOKENS)


def _ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u" + chr(data[0]), offset=1)


def _counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over all texts, from each task's own sums."""

    def run(batches):
        for batch in batches:
            for data in batch.column("counts").to_pylist():
                total = np.frombuffer(data, "<i8")
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    return tokens.select("counts").where("counts is not null").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


_BLOCK = "part int, place long, n_ids long, block binary"


def _blocks(tokens: DataFrame, frequencies: np.ndarray) -> DataFrame:
    """Rows of blocks from rows of ids in order; a text that doesn't follow the one before it begins a new block."""
    shared = tokens.sparkSession.sparkContext.broadcast(frequencies)

    def run(batches):
        coder = Coder(shared.value)
        ready: list[tuple[int, int, list, list]] = []
        first, following, keys, ids, size = None, None, [], [], 0

        def out():
            data = coder.encode([(k, i) for *_, k, i in ready])
            columns = [[r[c] for r in ready] for c in range(2)] + [[sum(map(len, r[3])) for r in ready], data]
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "place", "n_ids", "block"])

        for batch in batches:
            for part, place, key, data in zip(*(batch.column(c).to_pylist() for c in ("part", "place", "key", "ids")), strict=True):
                if keys and (size >= BLOCK_IDS or following != (part, place)):
                    ready.append((*first, keys, ids))
                    keys, ids, size = [], [], 0
                    if len(ready) >= TOGETHER or sum(len(x) for r in ready for x in r[3]) > TOGETHER * BLOCK_IDS:
                        yield out()
                if not keys:
                    first = (part, place)
                following = (part, place + 1)
                keys.append(key)
                ids.append(_ids(data))
                size += len(ids[-1])
        if keys:
            ready.append((*first, keys, ids))
        if ready:
            yield out()

    return tokens.mapInArrow(run, _BLOCK)


def write_ids(df: DataFrame, out: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2) -> None:
    """Write the ids of every text, with the end id, to files in ascending order of the key.

    The texts are dealt by ranges of the key and encoded there, once; the ids are kept in the shared folder until the table
    that they are coded by is counted. The table, of at most the vocabulary's size, is all that reaches the driver.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    mixed = F.xxhash64("text")
    ordered = rows.repartitionByRange(parts, "key", mixed).sortWithinPartitions("key", mixed, "text")
    tokens, path = settle(_encode_rows(ordered, tokenizer, end_id).withColumn("part", F.spark_partition_id()), "ids", "snappy")
    counted = _counts(tokens).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 0, np.int64)
    counts[counted["id"].to_numpy(np.int64)] = counted["n"]
    frequencies = scaled(counts)
    symbols = np.flatnonzero(frequencies)
    spark.createDataFrame([(TABLE_BITS, symbols.tolist(), frequencies[symbols].tolist())], "bits int, symbols array<long>, frequencies array<long>").coalesce(1).write.parquet(f"{out}/table")
    placed = tokens.where("counts is null").select("part", "place", "key", "ids")
    with shuffle_files_dropped(spark):
        _blocks(placed, frequencies).write.option("compression", "none").parquet(f"{out}/blocks")
    drop_path(spark, path)


def read_table(spark: SparkSession, out: str) -> np.ndarray:
    """The shared frequency table of written files."""
    row = spark.read.parquet(f"{out}/table").first()
    found = np.zeros(max(row["symbols"], default=-1) + 1, np.int64)
    found[np.array(row["symbols"], np.int64)] = row["frequencies"]
    return found


def _decoded(spark: SparkSession, out: str, schema: str, columns):
    """columns(keys, lists of ids, block row) of every block, from files."""
    shared = spark.sparkContext.broadcast(read_table(spark, out))

    def run(batches):
        coder = Coder(shared.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, TOGETHER):
                rows = batch.slice(begin, TOGETHER)
                found = coder.decode(rows.column("block").to_pylist())
                for i, (keys, ids) in enumerate(found):
                    yield columns(keys, ids, {c: rows.column(c)[i].as_py() for c in ("part", "place")})

    return spark.read.schema(_BLOCK).parquet(f"{out}/blocks").mapInArrow(run, schema)


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """(key, ids array<long>) of every text, from files."""

    def columns(keys, ids, _):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))], names=["key", "ids"])

    return _decoded(spark, out, "key long, ids array<long>", columns)


def read_digests(spark: SparkSession, out: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every text, from files; start counts the ids of all texts before it.

    Starts come from the blocks' counts: a running sum in each part, and one over the parts' totals.
    """

    def columns(keys, ids, row):
        sizes = np.array([len(x) for x in ids], np.int64)
        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
        n = len(keys)
        place = [pa.array([row[c]] * n, t) for c, t in (("part", pa.int32()), ("place", pa.int64()))]
        values = [pa.array(keys, pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
        return pa.RecordBatch.from_arrays([*place, *values], names=["part", "place", key, "inside", "n_tokens", "ids_crc32"])

    rows = _decoded(spark, out, f"part int, place long, {key} long, inside long, n_tokens long, ids_crc32 long", columns)
    heads = spark.read.schema(_BLOCK).parquet(f"{out}/blocks").select("part", "place", "n_ids")
    earlier = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    starts = heads.withColumn("block_start", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).join(before, "part")
    starts = starts.select("part", "place", (F.col("part_start") + F.col("block_start")).alias("at"))
    return rows.join(starts, ["part", "place"]).select(key, (F.col("at") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
