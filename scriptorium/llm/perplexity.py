"""Quality rules, with n-gram perplexity from a modified Kneser-Ney model as the verdict.

Each language has a model of character n-grams (ORDER) over a closed alphabet of 64 folded symbols: Latin letters without
accents, letters of other scripts by their place in them, and kinds of others. Spark counts n-grams over all texts: every
task sums its own in sorted arrays, the rest is one aggregation of (lang, n-gram). From the counts the driver builds
interpolated modified Kneser-Ney probabilities (three discounts an order, continuation counts below the highest) and
keeps them in arrays sorted by 64-bit hash; scoring finds each distinct n-gram of a batch there by binary search. A model
depends on its own language alone and holds all its n-grams. A language of more than MOST_GRAMS n-grams has a table of all
n-grams of the alphabet instead (DenseKneserNey, 134 MB at any size), filled a slice of at most MOST_GRAMS at a time.
Languages, however many, are scored in shards whose models hold twice MOST_GRAMS together at most, or one such table; all but
the rarest corpora have a single one.

A text's log perplexity is its mean negative log probability a symbol, to GRAIN. In each language, texts outside a band
around the median are rejected: its lower and upper edge are as many times as WIDTHS says as far from the median as the
CENTRE quantiles are (LEAST_WIDTH at least). Text made of few repeated patterns falls below; debris of tables and symbols
rises above, and so do a few clean texts that quote other languages. Bands come from all texts that pass the base rules,
by exact quantiles, so they are the same however rows are dealt.

Rules per text: words `[^\\x20\\x09-\\x0D]+` (at least 50) and words in repeated 3-word windows (at most half).

Null texts are empty; empty texts fail the base rules. A null lang is the language without a name. A text on an edge is kept.
Rows that are repeated, or share a key, stay rows of their own and count in the model each; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.batches import pieces
from scriptorium.session import settle

ORDER, SYMBOL_BITS, MOST_GRAMS = 4, 6, 2_000_000
SYMBOLS = 1 << SYMBOL_BITS
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
CENTRE, WIDTHS, LEAST_WIDTH, GRAIN = (0.1, 0.9), (3.0, 3.0), 0.05, 4
#: Fixed values of the rule on symbols.
RULE_SYMBOLS = "#*$%&|<>"
_BLANK, _DIGIT, _STOP, _CAPITAL, _SIGN, _LINE, _OTHER = 0, 27, 28, 29, 30, 31, 32
BATCH_CHARS = 1_000_000
#: N-grams that a task holds before it passes them on.
HELD = 1_000_000
#: Marks a context, as against an n-gram of the same order, before it is hashed.
_CONTEXT = np.int64(1 << 40)


@cache
def alphabet() -> np.ndarray:
    """The symbol of each code point, capitals as their letter plus 64: Latin letters without accents, 32 classes of other letters, six kinds of others."""
    out = np.full(0x110000, _SIGN, np.uint8)
    for point in range(0x2FFF):
        char = chr(point)
        kind = unicodedata.category(char)
        if kind[0] == "L":
            plain = unicodedata.normalize("NFKD", char)[0].lower()
            number = ord(plain[0]) - 96 if "a" <= plain[0] <= "z" else ord(plain[0]) % 32 + _OTHER
            out[point] = number + (64 if kind == "Lu" else 0)
        elif kind[0] == "N":
            out[point] = _DIGIT
        elif kind[0] == "Z" or char == "\t":
            out[point] = _BLANK
        elif char in ".,;:!?'\"-()":
            out[point] = _STOP
    beyond = np.arange(0x2FFF, 0x110000)
    out[beyond] = beyond % 32 + _OTHER
    out[[10, 11, 12, 13]] = _LINE
    return out


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, each after ORDER - 1 line marks; where each text begins, and the end)."""
    lead = "\n" * (ORDER - 1)
    points = np.frombuffer((lead + lead.join(texts)).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + ORDER - 1
    found = alphabet()[points]
    capital = found >= 64
    inner = capital.copy()
    inner[0] = False
    before = found[:-1] & 63
    inner[1:] &= ((before >= 1) & (before <= 26)) | (before >= _OTHER)
    found = found & 63
    found[inner] = _CAPITAL
    return found, np.concatenate([[0], np.cumsum(sizes)])


def windows(found: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each symbol from the ORDER-th on."""
    n = len(found) - ORDER + 1
    out = np.zeros(max(0, n), np.int64)
    for k in range(ORDER):
        out = (out << SYMBOL_BITS) | found[k : k + max(0, n)]
    return out


def _summed(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-grams in order, their summed counts)."""
    gram, place = np.unique(np.concatenate(grams), return_inverse=True)
    return gram, np.bincount(place, weights=np.concatenate(counts), minlength=len(gram)).astype(np.int64)


def count_ngrams(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all texts; a task sums its own, and passes them on when it holds HELD."""

    def run(batches):
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def out():
            for name, (grams, counts) in held.items():
                gram, n = _summed(grams, counts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in pieces(batches, text):
            by: dict[str, list[str]] = {}
            for name, t in zip(batch.column(lang).to_pylist(), batch.column(text).to_pylist(), strict=True):
                if t:
                    by.setdefault(name or "", []).append(t)
            for name, texts in by.items():
                for part in _parts(texts):
                    found, begin = symbols(part)
                    # a window that crosses into the next text ends in its lead, and isn't counted
                    ends = np.ones(len(found), bool)
                    for k in range(ORDER - 1):
                        ends[begin[:-1] + k] = False
                    gram, n = np.unique(windows(found)[ends[ORDER - 1 :]], return_counts=True)
                    grams, counts = held.setdefault(name, ([], []))
                    grams.append(gram)
                    counts.append(n)
                    size += len(gram)
            if size > HELD:
                for name, (grams, counts) in held.items():
                    gram, n = _summed(grams, counts)
                    held[name] = ([gram], [n])
                size = sum(len(grams[0]) for grams, _ in held.values())
                if size > HELD // 2:
                    yield from out()
                    size = 0
        yield from out()

    return df.select(lang, text).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _parts(texts: list[str]):
    held, total = [], 0
    for t in texts:
        if held and total + len(t) > BATCH_CHARS:
            yield held
            held, total = [], 0
        held.append(t)
        total += len(t)
    if held:
        yield held


def _hash(order: int, gram: np.ndarray) -> np.ndarray:
    """A 64-bit hash of n-grams of an order: a bijection of (order, n-gram), so no two are alike."""
    with np.errstate(over="ignore"):
        x = (gram.astype(np.uint64) << np.uint64(3)) | np.uint64(order)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


class KneserNey:
    """Interpolated modified Kneser-Ney from counts of the highest order, in arrays sorted by hash.

    value: of an n-gram, its discounted probability without what lower orders add; share: of a context, the weight of
    the lower order after it.
    """

    def __init__(self, gram: np.ndarray, count: np.ndarray):
        keys, values, shares = [], [], []
        for order in range(ORDER, 0, -1):
            some = [int((count == k).sum()) for k in (1, 2, 3, 4)]
            less = np.choose(np.minimum(count, 3) - 1, self._discounts(some))
            context = gram >> SYMBOL_BITS
            into = np.bincount(context, weights=count, minlength=1)
            lost = np.bincount(context, weights=less, minlength=1)
            keys.append(_hash(order, gram))
            values.append((count - less) / into[context])
            seen = np.flatnonzero(into)
            keys.append(_hash(order - 1, seen | _CONTEXT))
            shares.append(lost[seen] / into[seen])
            if order > 1:
                gram, count = np.unique(gram & ((1 << (SYMBOL_BITS * (order - 1))) - 1), return_counts=True)
        flat = np.concatenate([x for v, s in zip(values, shares, strict=True) for x in (v, s)])
        key = np.concatenate(keys)
        place = np.argsort(key)
        self.key, self.value = key[place], flat[place].astype(np.float64)

    @staticmethod
    def _discounts(some: list[int]) -> list[float]:
        """Discounts of counts 1, 2 and more, from how many n-grams have counts 1 to 4."""
        y = some[0] / max(1, some[0] + 2 * some[1])
        return [min(k, max(0.0, k - (k + 1) * y * some[k] / some[k - 1])) if some[k - 1] else 0.0 for k in (1, 2, 3)]

    def _find(self, key: np.ndarray, missing: float) -> np.ndarray:
        if not len(self.key):
            return np.full(len(key), missing)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.value[at], missing)

    def probability(self, gram: np.ndarray) -> np.ndarray:
        """p(last symbol | the ones before it) of n-grams of the highest order."""
        p = np.full(len(gram), 1.0 / SYMBOLS)
        for order in range(1, ORDER + 1):
            part = gram & ((1 << (SYMBOL_BITS * order)) - 1)
            context = part >> SYMBOL_BITS
            p = self._find(_hash(order, part), 0.0) + self._find(_hash(order - 1, context | _CONTEXT), 1.0) * p
        return p

    def costs(self, gram: np.ndarray) -> np.ndarray:
        """Negative log probability of n-grams of the highest order; each distinct one is looked up once."""
        distinct, place = np.unique(gram, return_inverse=True)
        return -np.log(self.probability(distinct))[place]


class DenseKneserNey(KneserNey):
    """The same model as a table of the costs of all n-grams of the highest order.

    cost: counts of those n-grams, which costs replace block by block.
    """

    def __init__(self, cost: np.ndarray):
        many, step = len(cost), SYMBOLS ** (ORDER - 1)
        follows = [np.zeros(SYMBOLS**k, np.int64) for k in range(ORDER)]
        some = np.zeros(5, np.int64)
        for at in range(0, many, step):  # a block has one first symbol
            block = cost[at : at + step]
            some += np.bincount(np.minimum(block, 5).astype(np.int64), minlength=6)[:5]
            follows[ORDER - 1] += block > 0
        for order in range(ORDER - 1, 1, -1):
            follows[order - 1] = (follows[order].reshape(SYMBOLS, -1) > 0).sum(0)
        lower = np.full(1, 1.0 / SYMBOLS)
        for order in range(1, ORDER):
            count = follows[order]
            lower = self._mixed(count, self._discounts([int((count == k).sum()) for k in (1, 2, 3, 4)]), lower)
        discounts = self._discounts([int(n) for n in some[1:]])
        for at in range(0, many, step):
            cost[at : at + step] = -np.log(self._mixed(cost[at : at + step].astype(np.int64), discounts, lower))
        self.cost = cost

    @staticmethod
    def _mixed(count: np.ndarray, discount: list[float], lower: np.ndarray) -> np.ndarray:
        """Probabilities of the n-grams of an order, or of all that have one first symbol, with those of the order below."""
        less = np.concatenate([[0.0], discount])[np.minimum(count, 3)]
        context = np.arange(len(count)) >> SYMBOL_BITS
        into, lost = np.bincount(context, weights=count), np.bincount(context, weights=less)
        total = np.maximum(into, 1)
        share = np.where(into > 0, lost / total, 1.0)
        return (count - less) / total[context] + share[context] * np.resize(lower, len(count))

    def probability(self, gram: np.ndarray) -> np.ndarray:
        return np.exp(-self.cost[gram])

    def costs(self, gram: np.ndarray) -> np.ndarray:
        return self.cost[gram]


def shards(counts: DataFrame, most_grams: int = MOST_GRAMS) -> DataFrame:
    """(lang, least, shard) of counts (lang, gram, n): the least count that a language's sorted model could hold within
    most_grams, 1 where it holds all, and where it is scored. Languages with more have a table, in a shard of their own.

    Counts are compared by powers of two, so that equal ones go alike. A row for each language is all that is ordered as a
    whole.
    """
    steps = counts.groupBy("lang", F.floor(F.log2("n")).cast("int").alias("step")).agg(F.count("*").alias("grams"))
    above = F.sum("grams").over(Window.partitionBy("lang").orderBy(F.desc("step")))
    fits = F.col("above") <= most_grams
    own = steps.withColumn("above", above).groupBy("lang").agg(
        F.coalesce(F.min(F.when(fits, F.col("step"))), F.max("step") + 1).alias("step"), F.max("above").alias("grams")
    )
    own = own.select("lang", F.when(F.col("grams") <= most_grams, 0).otherwise(F.col("step")).alias("step"), "grams", (F.col("grams") > most_grams).alias("large"))
    earlier = Window.partitionBy("large").orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)
    small = F.floor(F.coalesce(F.sum("grams").over(earlier), F.lit(0)) / most_grams)
    large = -1 - F.coalesce(F.count("*").over(earlier), F.lit(0))
    return own.select("lang", F.expr("shiftleft(1L, step)").alias("least"), F.when(F.col("large"), large).otherwise(small).cast("int").alias("shard"))


def _table(counts: DataFrame) -> DenseKneserNey:
    """The model of one language's counts (gram, n), which reach the driver in slices of MOST_GRAMS at most."""
    cost = np.zeros(SYMBOLS**ORDER)
    for at in range(0, len(cost), MOST_GRAMS):
        part = counts.where((F.col("gram") >= at) & (F.col("gram") < at + MOST_GRAMS)).toArrow()
        cost[part.column("gram").to_numpy()] = part.column("n").to_numpy()
    return DenseKneserNey(cost)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", most_grams: int = MOST_GRAMS) -> Iterator[dict[str, KneserNey]]:
    """Models by language, a shard at a time; 2 * most_grams counts reach the driver at once, at most."""
    counts, _ = settle(count_ngrams(df, text, lang), "ngrams")
    dealt, _ = settle(shards(counts, most_grams), "languages")
    held = counts.join(F.broadcast(dealt), "lang")
    for shard in [r["shard"] for r in dealt.select("shard").distinct().orderBy("shard").collect()] or [0]:
        names = [r["lang"] for r in dealt.where(F.col("shard") == shard).select("lang").collect()]
        if shard < 0:
            yield {names[0]: _table(counts.where(F.col("lang") == names[0]).select("gram", "n"))}
            continue
        part = held.where(F.col("shard") == shard).select("lang", "gram", "n").toArrow()
        number, of = part.column("lang").combine_chunks().dictionary_encode(), {}
        code = number.indices.to_numpy() if part.num_rows else np.zeros(0, np.int64)
        gram, n = part.column("gram").to_numpy(), part.column("n").to_numpy()
        order = np.lexsort((gram, code))
        cuts = np.searchsorted(code[order], np.arange(len(number.dictionary) + 1))
        for i, name in enumerate(number.dictionary.to_pylist()):
            some = order[cuts[i] : cuts[i + 1]]
            of[name] = KneserNey(gram[some], n[some])
        none = np.zeros(0, np.int64)
        yield {name: of[name] if name in of else KneserNey(none, none) for name in names}


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(words, code points in words, rule symbols, repeated lines, words in 3-word windows found twice or more)."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    signs = sum(map(text.count, RULE_SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    if n > 2:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        if len(number) + 2 < n:  # else no window can occur twice
            wide = len(number)
            pair = ids[:-1] * wide + ids[1:]
            if wide >= 1 << 20:
                pair = np.unique(pair, return_inverse=True)[1]
            three = pair[:-1] * wide + ids[2:]
            order = np.argsort(three)
            same = three[order][1:] == three[order][:-1]
            twice = np.zeros(len(three), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeated = int(covered.sum())
    return n, len(text) - blanks, signs, len(lines) - len(set(lines)), repeated


def measure(df: DataFrame, models: dict[str, KneserNey], key: str = "doc_id", text: str = "text", lang: str = "lang", empty: bool = True) -> DataFrame:
    """(key, band, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_perplexity) of each text whose language has
    a model here, and of each empty text if `empty` is true."""
    schema = T.StructType(
        [df.schema[key], T.StructField("band", T.StringType())]
        + [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        + [T.StructField("log_perplexity", T.DoubleType())]
    )
    shared = df.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        known = shared.value
        for batch in pieces(batches, text):
            names = [x or "" for x in batch.column(lang).to_pylist()]
            all_texts = [t or "" for t in batch.column(text).to_pylist()]
            mine = [i for i, t in enumerate(all_texts) if (names[i] in known if t else empty)]
            texts, bands = [all_texts[i] for i in mine], [names[i] for i in mine]
            logs = np.full(len(texts), np.nan)
            by: dict[str, list[int]] = {}
            for i, name in enumerate(bands):
                if texts[i]:
                    by.setdefault(name, []).append(i)
            for name, places in by.items():
                at = 0
                for part in _parts([texts[i] for i in places]):
                    found, begin = symbols(part)
                    cost = np.concatenate([np.zeros(ORDER - 1), known[name].costs(windows(found))])
                    for k in range(ORDER - 1):
                        cost[begin[:-1] + k] = 0
                    sums = np.add.reduceat(cost, begin[:-1])
                    logs[places[at : at + len(part)]] = np.round(sums / (np.diff(begin) - ORDER + 1), GRAIN)
                    at += len(part)
            base = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
            columns = [batch.column(key).take(pa.array(mine, pa.int32())), pa.array(bands, pa.string()), *[pa.array(base[:, k]) for k in range(5)], pa.array(logs, from_pandas=True)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(key, text, lang).mapInArrow(run, schema)


def verdicts(measured: DataFrame) -> DataFrame:
    """measured with base_failed and kept: bands are learned from the texts that pass the base rules."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    marked = measured.withColumn("base_failed", failed)
    cost = F.col("log_perplexity")
    # exact quantiles of counted values: there are as many as grains in the range of a mean log probability
    counted = marked.where(~F.col("base_failed") & cost.isNotNull()).groupBy("band", "log_perplexity").agg(F.count("*").alias("n"))
    cuts = counted.groupBy("band").agg(F.percentile(cost, [CENTRE[0], 0.5, CENTRE[1]], F.col("n")).alias("q"))
    low, middle, high = (F.col("q")[i] for i in range(3))
    bands = cuts.select(
        "band",
        (middle - F.greatest(WIDTHS[0] * (middle - low), F.lit(LEAST_WIDTH))).alias("lower"),
        (middle + F.greatest(WIDTHS[1] * (high - middle), F.lit(LEAST_WIDTH))).alias("upper"),
    )
    inside = F.coalesce(cost.between(F.col("lower"), F.col("upper")), F.lit(True))
    return marked.join(F.broadcast(bands), "band", "left").withColumn("kept", ~F.col("base_failed") & inside)


def quality(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most_grams: int = MOST_GRAMS) -> DataFrame:
    """Base counts, log perplexity, its band, base_failed and kept of each text."""
    measured = None
    for i, models in enumerate(fit(df, text, lang, most_grams)):
        part, _ = settle(measure(df, models, key, text, lang, empty=i == 0), "measured")
        measured = part if measured is None else measured.unionAll(part)
    return verdicts(measured).drop("band")
