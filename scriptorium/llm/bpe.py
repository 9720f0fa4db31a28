"""BPE encoding and decoding in batched numpy merge rounds.

Distinct pre-tokens of a batch are merged together: their symbols lie in one flat array, the rank of every neighbouring
pair is found by binary search over the sorted pair keys, and in each round every word merges all occurrences of its
own lowest-ranked pair, left to right. Words without a ranked pair leave the array. Ids of words are kept for later
batches of the same worker, in a store of bounded size.

Nulls are empty texts and give no ids. Texts are split whole, however long.
"""

from __future__ import annotations

import hashlib
import json
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scriptorium.llm.batches import pieces
from scriptorium.llm.pretokens import WordEncoder, gather

_NONE = np.int64(2**62)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class ByteBpe(WordEncoder):
    """A byte-level BPE vocabulary, read from a tokenizers file (vocabulary, merges, added tokens)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocabulary = model["vocab"]
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        super().__init__({t["content"]: t["id"] for t in spec["added_tokens"]})
        self.size = max([*vocabulary.values(), *self.added.values()]) + 1
        self.byte_ids = np.array([vocabulary[c] for c in symbols], np.int64)
        self.bytes_of = [b""] * self.size
        for word, i in vocabulary.items():
            self.bytes_of[i] = bytes(map(back.__getitem__, word))
        for word, i in self.added.items():
            self.bytes_of[i] = word.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made
        self.width = np.fromiter(map(len, self.bytes_of), np.int64, self.size)
        self.flat_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.byte_at = np.cumsum(self.width) - self.width

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or _NONE: by binary search over the sorted pair keys."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [w.encode() for w in words]
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [], []
        rank = np.full(len(sym), _NONE)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self._rank(sym[inner], sym[inner + 1])
        while len(sym):
            new = np.ones(len(word), bool)
            new[1:] = word[1:] != word[:-1]
            starts = np.flatnonzero(new)
            lowest = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.append(starts, len(word)))
            live = np.repeat(lowest < _NONE, counts)
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank = sym[live], word[live], rank[live]
                counts, lowest = counts[lowest < _NONE], lowest[lowest < _NONE]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, counts))
            run = np.ones(len(at), bool)
            run[1:] = at[1:] != at[:-1] + 1
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[since % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            sym, word, rank = sym[keep], word[keep], rank[keep]
            touched = np.unique(np.concatenate([moved[moved > 0] - 1, moved]))
            rank[touched] = _NONE
            touched = touched[touched + 1 < len(sym)]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched] = self._rank(sym[touched], sym[touched + 1])
        if not done_sym:
            return np.zeros(0, np.int64), size * 0
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids, malformed UTF-8 replaced as the library does."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        width = self.width[flat]
        data = gather(self.byte_at[flat], width, self.flat_bytes).tobytes()
        reached = np.concatenate([np.zeros(1, np.int64), np.cumsum(width)])
        ends = np.cumsum(sizes)
        return [data[reached[a] : reached[b]].decode("utf-8", "replace").encode() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


@cache
def vocabulary(path: str) -> ByteBpe:
    """One vocabulary and word store per worker."""
    return ByteBpe(path)


def encode_frame(df: DataFrame, path: str, text: str = "text", out: str = "ids", returns: str | None = None) -> DataFrame:
    """df with a column of ids (array<int>) for `text`; other columns stay, those named as the new ones are replaced.

    returns: a further column, whether the ids decode to the text. No shuffle: each batch of rows is encoded where it is
    read. An empty table gives an empty one.
    """
    new = [T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(returns, T.BooleanType())] if returns else [])]
    kept = [f for f in df.schema.fields if f.name not in {f.name for f in new}]
    schema = T.StructType([*kept, *new])

    def run(batches):
        bpe = vocabulary(path)
        for rows in pieces(batches, text):
            texts = rows.column(text).to_pylist()
            ids = bpe.encode(texts)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            values = pa.array(np.concatenate(ids).astype(np.int32))
            columns = [rows.column(f.name) for f in kept]
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values))
            if returns:
                columns.append(pa.array([a == (b or "").encode() for a, b in zip(bpe.decode(ids), texts, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def decode_frame(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of a column of ids; null ids decode to an empty text."""
    kept = df.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            lists = [np.array(x or [], np.int32) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.decode() for x in bpe.decode(lists)])], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, schema)


def digest_frame(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each text encoded, and decoded from those ids, where it is read."""
    field = df.schema[key]
    schema = T.StructType([field, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        bpe = vocabulary(path)
        for rows in pieces(batches, text):
            ids = bpe.encode(rows.column(text).to_pylist())
            columns = [
                rows.column(key),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in bpe.decode(ids)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)
