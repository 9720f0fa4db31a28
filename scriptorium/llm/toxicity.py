"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding lowers case, drops accents, maps look-alike letters of other scripts and digits or signs used as letters to plain
ones, and turns what remains of ASCII punctuation into blanks. The lexicon is learned from labelled rows: of a bounded
sample of them (LEARN_ROWS, chosen by a hash of their doc_id), every whole folded word is counted once a distinct text in
toxic and in other texts. A word found in SUPPORT toxic texts or more enters if so many would be a chance of less than
CERTAINTY for any word counted, with the log ratio of both frequencies as weight, if that is LEAST_WEIGHT or more. An
entry matches as a whole word, bare or with one of INFLECTIONS. Stems of STEM to LONGEST letters enter by the same test,
but only where toxic texts hold ENDINGS or more different words of that stem and none of them is in over DOMINANT of the
stem's toxic texts, so that a word never stands for its beginning; a longer stem takes the place of a shorter one if it is
in SAME of its toxic texts, and enters beside it if it weighs MARGIN more. A word counts with its largest weight.

Exception phrases are EXCEPTIONS, and two folded words around a match that occur in other texts at least as often as in
toxic ones; matches inside one don't count. A text's score is a logistic function of its summed weight, of that weight
per word and of its largest weight, fitted on the sample.

Null texts are empty; texts without a match score by the fitted base rate of such texts. Labels repeated for a doc_id
count as toxic if one of them does. Without any toxic label the lexicon is empty and all scores are equal. Only the text
enters a score.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from functools import cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.batches import pieces, small_batches
from scriptorium.llm.sampling import bounded_sample
from scriptorium.session import settle

LEARN_ROWS, SUPPORT, CERTAINTY, LEAST_WEIGHT, MARGIN, STEM, LONGEST, ENDINGS, DOMINANT, SAME = 20_000, 4, 0.01, 1.0, 0.7, 4, 10, 5, 0.4, 0.9
REJECT_AT = 0.3
INFLECTIONS = ("", "s", "es", "e", "en")
#: Harmless phrases that hold words used as insults.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bins", "trash collection", "take out the trash", "soap scum", "pond scum", "circus clown", "clown fish", "idiot proof", "sore loser", "stupid mistake")
#: Words counted before a task passes its counts on.
COUNTED = 200_000

#: Letters of other scripts that look like a plain one, and digits and signs written for letters.
_LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ո": "n", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ł": "l", "ø": "o", "ß": "s"}
_WRITTEN_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


@cache
def _folds() -> dict[int, str | None]:
    """What each code point becomes: built from the tables above and Unicode decompositions."""
    out: dict[int, str | None] = {p: " " for p in [*range(33), *range(127, 161), *range(0x2000, 0x2070)]}
    for point in range(33, 127):
        char = chr(point)
        out[point] = char.lower() if char.isalpha() else _WRITTEN_FOR.get(char, " ")
    for point in [*range(0xC0, 0x250), *range(0x370, 0x560), *range(0x1D00, 0x2000), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(point)).lower() if not unicodedata.combining(c))
        plain = "".join(_LOOKALIKES.get(c, c) for c in plain)
        if plain != chr(point):
            out[point] = "".join(_WRITTEN_FOR.get(c, c) for c in plain)
    out |= {p: None for p in [*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF]}
    out |= {ord(a): b for a, b in _LOOKALIKES.items()}
    return out


class _Folds(dict):
    """Code points that fold to themselves aren't stored."""

    def __missing__(self, point: int) -> int:
        return point


@cache
def _table() -> _Folds:
    return _Folds(_folds())


def fold(text: str) -> str:
    """Folded words of a text, each with a blank before it; a blank ends the text."""
    return " " + " ".join(text.translate(_table()).split()) + " "


def held_out(doc_id: object) -> bool:
    """Rows that nothing is learned from."""
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@dataclass(frozen=True)
class Model:
    """Whole words and stems with their weights, exception phrases, and the logistic function of a text's features."""

    lexicon: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = ()
    logit: tuple[float, ...] = field(default=(-3.0, 0.0, 0.0, 0.0))
    stems: tuple[tuple[str, float], ...] = ()


class Matcher:
    """The automaton of a model: words and stems count where no exception phrase covers them."""

    def __init__(self, model: Model):
        self.model = model
        forms: dict[str, tuple[int, float | None]] = {}
        entries = [(f" {word}{end} ", len(word) + len(end) + 1, weight) for word, weight in model.lexicon for end in INFLECTIONS]
        entries += [(f" {stem}", len(stem), weight) for stem, weight in model.stems]
        for form, size, weight in entries:
            forms[form] = max(forms.get(form, (size, weight)), (size, weight))
        forms |= {f" {phrase} ": (len(phrase) + 1, None) for phrase in model.exceptions}
        self.automaton = ahocorasick.Automaton()
        for form, value in forms.items():
            self.automaton.add_word(form, value)
        if forms:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """(start, weight) of each word that counts, with its largest weight."""
        if not len(self.automaton):
            return []
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            else:
                best[start] = max(weight, best.get(start, weight))
        spared.sort()
        begins, reached = [x for x, _ in spared], list(accumulate((y for _, y in spared), max))
        covered = lambda a: (k := bisect_right(begins, a)) and a < reached[k - 1]
        return [(a, w) for a, w in sorted(best.items()) if not covered(a)]

    def features(self, text: str | None) -> tuple[float, float, float]:
        """(log of the summed weight, log of the weight per thousand words, largest weight)."""
        folded = fold(text or "")
        weights = [w for _, w in self.hits(folded)]
        total, words = sum(weights), max(1, folded.count(" ") - 1)
        return float(np.log1p(total)), float(np.log1p(1000 * total / words)), max(weights, default=0.0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        rows = np.array([self.features(t) for t in texts], np.float64).reshape(-1, 3)
        z = self.model.logit[0] + rows @ np.array(self.model.logit[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sample(df: DataFrame, labels: DataFrame, rows: int, key: str, text: str, label: str) -> DataFrame:
    """Up to `rows` labelled texts that aren't held out, equal ones as one, with toxic 0/1."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    known = known.where(F.crc32(F.col(key).cast("string").cast("binary")) % 4 != 2)
    bounded = bounded_sample(known, key, rows)
    met = df.select(key, F.col(text).alias("text")).join(F.broadcast(bounded), key)
    return met.groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("_same")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).drop("_same")


def _counted(sample: DataFrame, found_in) -> DataFrame:
    """(word, bad, good): in how many toxic and other texts each of the strings that found_in(text) gives is found."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            columns = [pa.array([w for w, _ in counts], pa.string()), pa.array([t for _, t in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "toxic", "n"])

        for batch in pieces(batches, "text"):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts.update((w, int(toxic > 0)) for w in found_in(text or ""))
                if len(counts) > COUNTED:
                    yield out()
        yield out()

    of = lambda toxic: F.sum(F.when(F.col("toxic") == toxic, F.col("n")).otherwise(0))
    return sample.mapInArrow(run, "word string, toxic int, n long").groupBy("word").agg(of(1).alias("bad"), of(0).alias("good"))


def _strong(counted: DataFrame, bad: int, good: int) -> DataFrame:
    """(word, bad, weight) of what is in more toxic texts than chance, by a bound on the binomial tail, over all that is counted."""
    often = counted.where(F.col("bad") + F.col("good") >= SUPPORT)
    share, n = bad / (bad + good), F.col("bad") + F.col("good")
    part = F.col("bad") / n
    gain = F.col("bad") * F.log(part / share) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - part) / (1 - share + 1e-9))).otherwise(0.0)
    weight = F.log((F.col("bad") + 0.5) / F.lit(bad + 0.5)) - F.log((F.col("good") + 0.5) / F.lit(good + 0.5))
    least = float(np.log(max(1, often.count()) / CERTAINTY))
    strong = (F.col("bad") >= SUPPORT) & (part > share) & (gain >= least)
    return often.where(strong).select("word", "bad", F.round(weight, 6).alias("weight")).where(F.col("weight") >= LEAST_WEIGHT)


def _sizes(sample: DataFrame) -> tuple[int, int]:
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    return sizes.get(1, 0), sizes.get(0, 0)


def _lexicon(sample: DataFrame) -> tuple[tuple[tuple[str, float], ...], tuple[tuple[str, float], ...]]:
    """(whole words, stems) with their weights. What is collected stands in SUPPORT texts of a bounded sample each."""
    bad, good = _sizes(sample)
    if not bad or not good:
        return (), ()
    words, _ = settle(_counted(sample, lambda text: set(fold(text).split())), "words")
    whole = {r["word"]: r["weight"] for r in _strong(words, bad, good).collect()}
    counted = _counted(sample, lambda text: {w[:n] for w in set(fold(text).split()) for n in range(STEM, min(LONGEST, len(w)) + 1)})
    starts = F.transform(F.sequence(F.lit(STEM), F.least(F.lit(LONGEST), F.length("word"))), lambda n: F.left("word", n))
    of_stem = words.where((F.col("bad") > 0) & (F.length("word") >= STEM)).select("bad", F.explode(starts).alias("word"))
    of_stem = of_stem.groupBy("word").agg(F.count("*").alias("endings"), F.max("bad").alias("most"))
    spread = counted.join(of_stem, "word").where((F.col("endings") >= ENDINGS) & (F.col("most") <= DOMINANT * F.col("bad"))).select("word")
    stems, _ = settle(counted.join(spread, "word"), "stems")
    found = {r["word"]: (r["weight"], r["bad"]) for r in _strong(stems, bad, good).collect()}
    kept: dict[str, float] = {}
    for stem in sorted(found, key=lambda w: (len(w), w)):
        weight, n = found[stem]
        shorter = [stem[:k] for k in range(STEM, len(stem)) if stem[:k] in kept]
        if any(n >= SAME * found[k][1] for k in shorter):
            for k in shorter:
                kept.pop(k)
        if not shorter or weight >= max(found[k][0] for k in shorter) + MARGIN or not any(k in kept for k in shorter):
            kept[stem] = weight
    return tuple(sorted(whole.items())), tuple(sorted(kept.items()))


def _exceptions(sample: DataFrame, model: Model) -> tuple[str, ...]:
    """Two words around a match, found in SUPPORT / 2 other texts or more, and in no more toxic ones."""

    def phrases_in(text):
        folded, phrases = fold(text), set()
        for start, _ in matcher(model).hits(folded):
            before = folded.rfind(" ", 0, start - 1)
            stop = folded.find(" ", start)
            after = folded.find(" ", stop + 1)
            if before >= 0:
                phrases.add(folded[before + 1 : stop])
            if after > 0:
                phrases.add(folded[start:after])
        return phrases

    counts = _counted(sample, phrases_in)
    return tuple(sorted(r["word"] for r in counts.where((F.col("good") >= SUPPORT // 2) & (F.col("good") >= F.col("bad"))).collect()))


_last: list[Matcher] = []


def matcher(model: Model) -> Matcher:
    """The automaton of a model; a worker keeps its last one."""
    if not _last or (_last[0].model is not model and _last[0].model != model):
        _last[:] = [Matcher(model)]
    _last[0].model = model
    return _last[0]


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.01) -> tuple[float, ...]:
    """Weights of a ridge logistic regression by Newton steps; x has its constant first."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + ridge * w
        bend = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(round(float(v), 9) for v in w)


def learn(df: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit lexicon, exceptions and score on a bounded sample of labelled rows; at most `rows` pairs of numbers are
    brought to the driver, besides the lexicon's candidates."""
    small_batches(df.sparkSession)
    sample = _sample(df, labels, rows, key, text, label).persist()
    try:
        lexicon, stems = _lexicon(sample)
        model = Model(lexicon, (), stems=stems)
        model = Model(lexicon, tuple(sorted({*EXCEPTIONS, *_exceptions(sample, model)})) if lexicon or stems else (), stems=stems)

        def run(batches):
            match = matcher(model)
            for batch in pieces(batches, "text"):
                found = [match.features(t) for t in batch.column("text").to_pylist()]
                columns = [pa.array(np.round([f[k] for f in found], 3), pa.float64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, batch.column("toxic")], names=["a", "b", "c", "toxic"])

        told = sample.mapInArrow(run, "a double, b double, c double, toxic int").groupBy("a", "b", "c", "toxic").count().collect()
    finally:
        sample.unpersist()
    if not told:
        return model
    x = np.array([[1.0, r["a"], r["b"], r["c"]] for r in told])
    y = np.array([float(r["toxic"] > 0) for r in told])
    n = np.array([float(r["count"]) for r in told])
    order = np.lexsort((y, *x.T))
    return Model(model.lexicon, model.exceptions, _logistic(x[order], y[order], n[order]), model.stems)


def score_frame(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of each text, scored where it is read; no shuffle."""
    schema = T.StructType([df.schema[key], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        match = matcher(model)
        for batch in pieces(batches, text):
            scores = match.scores(batch.column(text).to_pylist())
            out = [held_out(k) for k in batch.column(key).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.bool_()), pa.array(scores), pa.array((scores >= REJECT_AT).astype(np.int32))], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def drop_toxic(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of df that score below REJECT_AT."""

    def run(batches):
        match = matcher(model)
        for batch in pieces(batches, text):
            yield batch.filter(pa.array(match.scores(batch.column(text).to_pylist()) < REJECT_AT))

    return df.mapInArrow(run, df.schema)
