"""Masked pseudo-likelihood scores from a bidirectional window network over counts of the whole corpus.

Tokens are words (runs between ASCII white space, ASCII lower case). Each is masked in turn and predicted from both sides:
its probability is a mixture of four distributions over all words, and a network of the window of two words on either side
gives the shares. The four: how the word before it goes on elsewhere, how the word after it is led up to elsewhere, how often
words occur elsewhere, and a model of letters, in which any string has a probability. Elsewhere means in all other documents:
a document's own occurrences are taken out of every count, so text isn't rewarded for repeating itself, and one that occurs
twice is. The four sum to one over all words, and so does their mixture. A score is the sum of the log probabilities of all
words of a text.

Every word and every pair of neighbours of the corpus is counted, however many there are. Texts are packed into batches of
BATCH_BYTES and written once; a batch sends each distinct key (40 bits and a shard, of which there are as many as keep
SHARD_WORDS words' keys in one) with its count to the key's shard, which sums all batches' counts and answers each. No
count reaches the driver and none is broadcast; no key is sent more than once by a batch, so frequent words are no skew.

The network learns from all windows: its loss depends on them only through how often each kind of window meets each level of
the four probabilities, CELLS counts at most whatever the size of the corpus, which the driver trains on in numpy. It is
small enough to be evaluated for every kind of window at once; scoring looks shares up.

Null texts are empty: no words, a sum of 0 and no mean. An empty corpus gives an empty result. Rows that share a key are rows of
their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.batches import pieces, small_batches
from scriptorium.llm.itq import _groups
from scriptorium.session import settle

BATCH_BYTES, SHARD_WORDS, KEY_BITS = 4_000_000, 2_000_000, 40
#: Kinds of a neighbour: an edge of the text, a word that no other text has, and words by how often others have it; the
#: outer words of a window are edges, rare or frequent.
STEPS_OF_COUNT = np.array([1, 2, 4, 16, 64, 256, 4096])
KINDS, COARSE, RARE = len(STEPS_OF_COUNT) + 2, 3, 16
EDGE, UNKNOWN = 0, 1
CONTEXTS = COARSE * KINDS * KINDS * COARSE
#: Upper ends of the levels of a cost (negative log probability), and what stands for each; the last one is that of no probability.
ENDS = {"letters": (10, 14, 18, 24, 32), "word": (6, 9, 12, 15), "before": (1, 2.5, 4.5, 7), "after": (1, 2.5, 4.5, 7)}
MIDDLES = {"letters": (8, 12, 16, 21, 28, 40), "word": (4.5, 7.5, 10.5, 13.5, 16.5, np.inf), "before": (0.5, 1.7, 3.5, 5.7, 9, np.inf), "after": (0.5, 1.7, 3.5, 5.7, 9, np.inf)}
LEVELS = 6
EXPERTS = tuple(ENDS)
CELLS = CONTEXTS * LEVELS ** len(EXPERTS)
INNER, OUTER, HIDDEN, STEPS, RATE, SEED = 8, 4, 24, 300, 0.05, 11
_EDGE_HASH, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def _pressed(values: np.ndarray) -> bytes:
    """Bytes of whole numbers, the like places of all of them together."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def _unpressed(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def pack(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(batch, keys, sizes, data, n_words, letters): texts of BATCH_BYTES together, and counts of their letters and words."""
    schema = T.StructType(
        [T.StructField("batch", T.StringType()), T.StructField("keys", T.ArrayType(df.schema[key].dataType)), T.StructField("sizes", T.ArrayType(T.LongType()))]
        + [T.StructField("data", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("letters", T.ArrayType(T.LongType()))]
    )
    types = [f.type for f in _arrow(schema)]

    def run(batches):
        keys, texts, size, number = [], [], 0, 0
        task = TaskContext.get().partitionId()

        def out():
            joined = b"".join(texts)
            letters = np.bincount(np.frombuffer(joined, np.uint8), minlength=256)
            letters[[9, 10, 11, 12, 13, 32]] = 0
            n = sum(len(t.split()) for t in texts)
            row = [f"{task}-{number}", list(keys), [len(t) for t in texts], zstandard.ZstdCompressor(3).compress(joined), n, [*letters.tolist(), n]]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=schema.names)

        for rows in pieces(batches, text):
            for k, t in zip(rows.column(key).to_pylist(), rows.column(text).to_pylist(), strict=True):
                keys.append(k)
                texts.append((t or "").encode("utf-8", "surrogatepass").lower())
                size += len(texts[-1])
                if size >= BATCH_BYTES:
                    yield out()
                    keys, texts, size, number = [], [], 0, number + 1
        if keys:
            yield out()

    return df.select(key, text).mapInArrow(run, schema)


def _arrow(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class Tokens:
    """The words of a batch: every text with an edge on either side, the pairs of neighbours, and their keys.

    at: the word (or edge) at each place; text: whose place it is; pair: of each place, the pair that it begins (the last
    edge of a text begins none); keys, counts: distinct keys of words and pairs in order; of_word, of_pair: their places
    among the keys.
    """

    def __init__(self, sizes: list[int], data: bytes, shard_bits: int):
        ends = np.cumsum(sizes, dtype=np.int64)
        plain = zstandard.ZstdDecompressor().decompress(data) if len(sizes) and ends[-1] else b""
        words = [plain[e - s : e].split() for s, e in zip(sizes, ends.tolist(), strict=True)]
        self.n = np.array([len(w) for w in words], np.int64)
        flat = [w for part in words for w in part]
        place: dict[bytes, int] = {}
        ids = np.fromiter(map(place.setdefault, flat, count()), np.int64, len(flat))  # where each word stands first
        self.words = list(place)
        ids = (np.cumsum(ids == np.arange(len(ids))) - 1)[ids]
        edge = len(self.words)
        some = np.flatnonzero(self.n)
        size = self.n[some] + 2
        stop = np.cumsum(size)
        self.text = np.repeat(some, size)
        self.at = np.full(int(stop[-1]) if len(stop) else 0, edge, np.int64)
        inner = np.ones(len(self.at), bool)
        inner[stop - 1] = inner[stop - size] = False
        self.at[inner] = ids
        self.inner = np.flatnonzero(inner)
        begins = np.ones(len(self.at), bool)
        begins[stop - 1] = False
        self.begins = np.flatnonzero(begins)
        hashes = np.empty(edge + 1, np.uint64)
        hashes[:edge] = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, edge)
        hashes[edge] = _EDGE_HASH
        high = np.uint64(64 - KEY_BITS - shard_bits)
        with np.errstate(over="ignore"):
            pairs = _mixed(hashes[self.at[self.begins]] ^ _mixed(hashes[self.at[self.begins + 1]] + _PAIR)) >> high
        distinct, self.pair, n_pair = np.unique(pairs, return_inverse=True, return_counts=True)
        n_word = np.bincount(self.at, minlength=edge + 1)
        n_word[edge] = len(some)
        self.keys, where = np.unique(np.concatenate([_mixed(hashes) >> high, distinct]), return_inverse=True)
        self.of_word, self.of_pair = where[: edge + 1], where[edge + 1 :]
        self.counts = np.bincount(where, weights=np.concatenate([n_word, n_pair]), minlength=len(self.keys)).astype(np.uint64)

    def shards(self, bits: int):
        """(shard, keys within it, counts) of the shards that the keys fall into."""
        bounds = np.searchsorted(self.keys, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(KEY_BITS))
        for shard in np.flatnonzero(np.diff(bounds)).tolist():
            part = slice(bounds[shard], bounds[shard + 1])
            yield shard, self.keys[part] & np.uint64((1 << KEY_BITS) - 1), self.counts[part]


def _own(places: np.ndarray, text: np.ndarray, most: int) -> np.ndarray:
    """How often its own text has what stands at each place."""
    _, same, n = np.unique(text * max(1, most) + places, return_inverse=True, return_counts=True)
    return n[same]


_KIND = UNKNOWN + np.searchsorted(STEPS_OF_COUNT, np.arange(STEPS_OF_COUNT[-1] + 1), side="right")


def kind_of(times: np.ndarray) -> np.ndarray:
    return _KIND[np.minimum(times, STEPS_OF_COUNT[-1]).astype(np.int64)]


class Window:
    """Of each word of a batch, the kind of its window and the cost of the word by each expert.

    totals: of each key of the batch, its count in the corpus; the corpus holds the batch itself if own.
    """

    def __init__(self, tokens: Tokens, totals: np.ndarray, letter_cost: np.ndarray, n_words: int, own: bool):
        t, edge = tokens, len(tokens.words)
        times = totals[t.of_word][t.at]
        pairs = totals[t.of_pair][t.pair]
        in_text = np.zeros(int(t.n.shape[0]), np.int64)
        if own:
            mine = _own(t.at, t.text, edge + 1)
            mine[t.at == edge] = 1  # both edges of a text are one count
            times = times - mine
            pairs = pairs - _own(t.pair, t.text[t.begins], len(t.of_pair))
            in_text = t.n
        times, pairs = np.maximum(times, 0), np.maximum(pairs, 0)
        begun = np.zeros(len(t.at))
        begun[t.begins] = pairs  # by the place where a pair begins
        p = t.inner
        share = lambda of, among: np.divide(of, among, out=np.zeros(len(p)), where=among > 0)
        lower, upper = np.maximum(p - 2, 0), np.minimum(p + 2, max(0, len(t.at) - 1))
        is_edge = t.at == edge
        kinds = np.where(is_edge & (times > 0), EDGE, kind_of(times))
        outer = np.where(is_edge, 0, 1 + (times >= RARE))
        left, right = np.where(is_edge[p - 1], 0, outer[lower]), np.where(is_edge[p + 1], 0, outer[upper]) if len(p) else p
        self.context = ((left * KINDS + kinds[p - 1]) * KINDS + kinds[p + 1]) * COARSE + right
        spelled = np.zeros(edge)
        if edge:
            size = np.fromiter(map(len, t.words), np.int64, edge)
            each = letter_cost[np.frombuffer(b"".join(t.words), np.uint8)]
            spelled = np.add.reduceat(each, np.cumsum(size) - size) + letter_cost[256]
        known = np.maximum(1, n_words - in_text[t.text[p]])
        with np.errstate(divide="ignore"):
            rest = [-np.log(x) for x in (share(times[p], known), share(begun[p - 1], times[p - 1]), share(begun[p], times[p + 1]))]
        self.costs = np.stack([spelled[t.at[p]], *rest], axis=1) if len(p) else np.zeros((0, len(EXPERTS)))

    def cells(self) -> np.ndarray:
        """The cell of each word: its window's kind and the levels of its costs."""
        out = self.context
        for k, name in enumerate(EXPERTS):
            level = np.searchsorted(ENDS[name], self.costs[:, k], side="right")
            out = out * LEVELS + np.where(np.isinf(self.costs[:, k]), LEVELS - 1, level)
        return out

    def log_probabilities(self, shares: np.ndarray) -> np.ndarray:
        """Log of the mixture: letters are added as logs, since the probability of a long string is no number."""
        with np.errstate(divide="ignore"):
            mine = shares[self.context]
            others = np.log((mine[:, 1:] * np.exp(-self.costs[:, 1:])).sum(axis=1))
            return np.logaddexp(np.log(mine[:, 0]) - self.costs[:, 0], others)


class Network:
    """Embeddings of the kinds of the four words around, a hidden layer of tanh units, and a softmax over the experts."""

    SHAPES = ((COARSE, OUTER), (KINDS, INNER), (KINDS, INNER), (COARSE, OUTER))

    def __init__(self, seed: int = SEED):
        rnd = np.random.default_rng(seed)
        self.embed = [rnd.normal(0, 0.3, s) for s in self.SHAPES]
        wide = sum(s[1] for s in self.SHAPES)
        self.w1, self.b1 = rnd.normal(0, wide**-0.5, (wide, HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = rnd.normal(0, HIDDEN**-0.5, (HIDDEN, len(EXPERTS))), np.zeros(len(EXPERTS))
        context = np.arange(CONTEXTS)
        self.places = [context // (KINDS * KINDS * COARSE), context // (KINDS * COARSE) % KINDS, context // COARSE % KINDS, context % COARSE]
        #: A neighbour that no other text has tells nothing.
        self.silent = np.zeros((CONTEXTS, len(EXPERTS)), bool)
        self.silent[:, 2], self.silent[:, 3] = self.places[1] == UNKNOWN, self.places[2] == UNKNOWN

    def forward(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(embedded, hidden, shares of the experts) of every kind of window."""
        x = np.concatenate([e[p] for e, p in zip(self.embed, self.places, strict=True)], axis=1)
        h = np.tanh(x @ self.w1 + self.b1)
        z = np.where(self.silent, -np.inf, h @ self.w2 + self.b2)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return x, h, z / z.sum(axis=1, keepdims=True)

    def train(self, cell: np.ndarray, count: np.ndarray, steps: int = STEPS, rate: float = RATE) -> list[float]:
        """Adam on the mean cost of all words. Returns the costs."""
        if not len(cell):
            return []
        context, levels = cell // LEVELS ** len(EXPERTS), cell % LEVELS ** len(EXPERTS)
        cost = np.stack([np.array(MIDDLES[n])[levels // LEVELS ** (len(EXPERTS) - 1 - k) % LEVELS] for k, n in enumerate(EXPERTS)], axis=1)
        likely, weight = np.exp(-cost), count / count.sum()
        of_context = np.bincount(context, weights=weight, minlength=CONTEXTS)[:, None]
        own, moments, costs = [*self.embed, self.w1, self.b1, self.w2, self.b2], None, []
        for step in range(1, steps + 1):
            x, h, shares = self.forward()
            part = shares[context] * likely
            whole = part.sum(axis=1)
            costs.append(float(-(weight * np.log(whole)).sum()))
            blame = np.stack([np.bincount(context, weights=weight * part[:, k] / whole, minlength=CONTEXTS) for k in range(len(EXPERTS))], axis=1)
            d2 = np.where(self.silent, 0.0, of_context * shares - blame)
            d1 = (d2 @ self.w2.T) * (1 - h * h)
            dx, slopes, at = d1 @ self.w1.T, [], 0
            for e, p in zip(self.embed, self.places, strict=True):
                slope = np.zeros_like(e)
                np.add.at(slope, p, dx[:, at : at + e.shape[1]])
                slopes.append(slope)
                at += e.shape[1]
            slopes += [x.T @ d1, d1.sum(axis=0), h.T @ d2, d2.sum(axis=0)]
            moments = moments or [(np.zeros_like(p), np.zeros_like(p)) for p in own]
            now = rate * (1 - step / (steps + 1)) + 1e-4
            for p, g, (m, v) in zip(own, slopes, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        return costs


@dataclass
class Model:
    """Shares of the experts by kind of window, costs of letters, the corpus' words, its shards, and its packed texts."""

    shares: np.ndarray
    letter_cost: np.ndarray
    n_words: int
    shard_bits: int
    packed: DataFrame
    costs: list[float]


_REQUEST = "shard long, batch string, asks boolean, gives boolean, keys binary, n binary"


def _requests(packed: DataFrame, bits: int, asks: bool, gives: bool) -> DataFrame:
    """A row for each shard that a batch has keys in."""

    def run(batches):
        for rows in batches:
            for batch, sizes, data in zip(*(rows.column(c).to_pylist() for c in ("batch", "sizes", "data")), strict=True):
                found = [(s, _pressed(np.diff(k, prepend=np.uint64(0))), _pressed(n)) for s, k, n in Tokens(sizes, data, bits).shards(bits)]
                columns = [[f[0] for f in found], [batch] * len(found), [asks] * len(found), [gives] * len(found), [f[1] for f in found], [f[2] for f in found]]
                kinds = (pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "batch", "asks", "gives", "keys", "n"])

    return packed.select("batch", "sizes", "data").mapInArrow(run, _REQUEST)


def _answers(requests: DataFrame) -> DataFrame:
    """(batch, shard, totals): what all that give have of the keys that a batch asks for in a shard."""

    def run(batches):
        for table in _groups(batches, ["shard"]):
            rows = table.to_pydict()
            keys = [np.cumsum(_unpressed(k, "<u8"), dtype=np.uint64) for k in rows["keys"]]
            counts = [_unpressed(n, "<u8") * np.uint64(g) for n, g in zip(rows["n"], rows["gives"], strict=True)]
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.uint64)[place]
            ends = np.cumsum([len(k) for k in keys])
            asked = [i for i, a in enumerate(rows["asks"]) if a]
            columns = [[rows["batch"][i] for i in asked], [rows["shard"][i] for i in asked], [_pressed(total[ends[i] - len(keys[i]) : ends[i]]) for i in asked]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["batch", "shard", "totals"])

    grouped = requests.repartition("shard").sortWithinPartitions("shard")
    return grouped.mapInArrow(run, "batch string, shard long, totals binary")


def _windows(packed: DataFrame, answers: DataFrame, model: Model, own: bool, schema, told) -> DataFrame:
    """told(keys, tokens, window) of every batch, which its answers have come together with; told gives arrow batches."""
    none = lambda n, kind: F.lit(None).cast(kind).alias(n)
    texts = packed.select("batch", F.lit(-1).cast("long").alias("shard"), none("totals", "binary"), "keys", "sizes", "data")
    sums = answers.select("batch", "shard", "totals", *[none(n, packed.schema[n].dataType) for n in ("keys", "sizes", "data")])
    met = texts.unionAll(sums).repartition("batch").sortWithinPartitions("batch", "shard")
    letters, n_words, bits = model.letter_cost, model.n_words, model.shard_bits

    def run(batches):
        state: dict = {}

        def whole():
            tokens = Tokens(state["sizes"], state["data"], bits)
            totals = np.concatenate([np.zeros(0), *state["totals"]])
            return told(state["keys"], tokens, Window(tokens, totals, letters, n_words, own))

        for rows in batches:
            for batch, shard, totals, keys, sizes, data in zip(*(rows.column(c).to_pylist() for c in ("batch", "shard", "totals", "keys", "sizes", "data")), strict=True):
                if shard < 0:
                    if state:
                        yield from whole()
                    state = {"keys": keys, "sizes": sizes, "data": data, "totals": []}
                else:
                    state["totals"].append(_unpressed(totals, "<u8").astype(np.float64))
        if state:
            yield from whole()

    return met.mapInArrow(run, schema)


def _cells(keys, tokens, window):
    """(cell, n) of a batch."""
    cell, n = np.unique(window.cells(), return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])


def fit(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[Model, DataFrame]:
    """(model of a corpus, what its batches were told of their own keys). CELLS counts at most reach the driver."""
    small_batches(df.sparkSession)
    packed, _ = settle(pack(df, key, text), "packed", "none")
    letters = np.ones(257)
    for r in packed.select(F.posexplode("letters").alias("letter", "n")).groupBy("letter").agg(F.sum("n").alias("n")).collect():
        letters[r["letter"]] += r["n"]
    n_words = packed.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, n_words / SHARD_WORDS)))))
    model = Model(Network().forward()[2], -np.log(letters / letters.sum()), n_words, bits, packed, [])
    answers, _ = settle(_answers(_requests(packed, bits, True, True)), "answers", "none")
    cells = _windows(packed, answers, model, True, "cell long, n long", _cells).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    network = Network()
    order = np.argsort(cells.column("cell").to_numpy())
    model.costs = network.train(cells.column("cell").to_numpy()[order], cells.column("n").to_numpy()[order].astype(np.float64))
    model.shares = network.forward()[2]
    return model, answers


def _scored(packed: DataFrame, answers: DataFrame, model: Model, own: bool, key: str) -> DataFrame:
    """(key, n_words, pseudo_log_likelihood, per_word) of each text."""
    shares = model.shares
    kind = packed.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_words", T.LongType()), T.StructField("pseudo_log_likelihood", T.DoubleType()), T.StructField("per_word", T.DoubleType())])
    arrow = _arrow(schema)[0].type

    def told(keys, tokens, window):
        total = np.concatenate([np.zeros(1), np.cumsum(window.log_probabilities(shares))])
        ends = np.cumsum(tokens.n)
        sums = total[ends] - total[ends - tokens.n]
        mean = np.divide(sums, tokens.n, out=np.full(len(sums), np.nan), where=tokens.n > 0)
        yield pa.RecordBatch.from_arrays([pa.array(keys, arrow), pa.array(tokens.n), pa.array(sums), pa.array(mean, from_pandas=True)], names=schema.names)

    return _windows(packed, answers, model, own, schema, told)


def score_corpus(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, pseudo_log_likelihood, per_word) of each text of a corpus, by a model of all of it."""
    model, answers = fit(df, key, text)
    return _scored(model.packed, answers, model, True, key)


def score_frame(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, pseudo_log_likelihood, per_word) of texts that aren't in the corpus of a model."""
    packed, _ = settle(pack(df, key, text), "packed", "none")
    asked = packed.withColumn("batch", F.concat(F.lit("new-"), "batch"))
    requests = _requests(asked, model.shard_bits, True, False).unionAll(_requests(model.packed, model.shard_bits, False, True))
    answers, _ = settle(_answers(requests), "answers", "none")
    return _scored(asked, answers, model, False, key)
