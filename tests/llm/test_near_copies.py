"""The pipeline's near copies against brute force over all pairs."""

from random import Random

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import near_copies


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts):
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def corpus():
    rnd = Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(800)]
    common = " ".join(rnd.choice(words) for _ in range(12))
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 150))) for _ in range(120)]
    texts = [f"{common} {t}" if i % 3 == 0 else t for i, t in enumerate(texts)]
    for t in list(texts):
        for changes in (0, 1, 2, 3, 4):
            own = t.split()
            for _ in range(changes):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            texts.append(" ".join(own))
    base = [rnd.choice(words) for _ in range(60)]
    for i in range(40):  # each near the base; of two, most aren't near each other, and the base comes last
        texts.append(" ".join([*base[: i + 10], "changed", *base[i + 11 :]]))
    return [*texts, " ".join(base), "", None, " \t ", "one two", "one two three"]


@pytest.mark.parametrize(("frequent", "block"), [(near_copies.FREQUENT, near_copies.BLOCK), (10**6, near_copies.BLOCK), (3, 8)])
def test_keep_one_is_brute_force(spark, monkeypatch, frequent, block):
    monkeypatch.setattr(near_copies, "FREQUENT", frequent)
    monkeypatch.setattr(near_copies.groups, "__defaults__", (*near_copies.groups.__defaults__[:-1], block))
    texts = corpus()
    want = brute_groups(texts)
    assert len(set(want)) < len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("point", F.lit("clash")).repartition(5)
    kept = near_copies.keep_one(df)
    got = sorted(r.doc_id for r in kept.collect())
    assert kept.columns == df.columns and got == sorted({a for i, a in enumerate(want) if texts[i]} | {texts.index("")})


def test_stage_finds_near_copies_and_spares_others(spark):
    """Copies at a similarity of 0.8 to 0.95 differ in about eight of 64 bits; texts whose fingerprints meet may share little."""
    import corpus_pipeline

    rnd = Random(4)
    words = ["".join(rnd.choice("abcdefghijkl") for _ in range(6)) for _ in range(2000)]
    rows = []
    for i in range(60):
        text = [rnd.choice(words) for _ in range(150)]
        rows.append((i, " ".join(text)))
        text[40], text[90] = "changed", "altered"
        rows.append((1000 + i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == list(range(60))


def test_edges(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in near_copies.keep_one(df).collect()) == ["1", "3", "None", "None"]
    assert near_copies.keep_one(df.limit(0)).count() == 0
    assert near_copies.prefix_size(1) == 1 and near_copies.prefix_size(100) == 21
