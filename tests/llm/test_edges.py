"""Very long texts, ties at edges, repeated rows and clashing names, operator by operator."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import chat, itq, perplexity, pseudo_likelihood, simhash
from scriptorium.llm.tokenizer_files import BYTE_BPE, tokenizer_path
from tests.llm.test_near_duplicates import fingerprint
from tests.llm.test_text_operators import brute_pseudo_likelihood, brute_quality

LONG = {"words": " ".join(f"w{i % 701}x{i % 13}" for i in range(120_000)), "one": "y" * 1_500_000, "blank": " \n\t" * 300_000}


def frame(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def test_long_texts_of_chat(spark):
    path = tokenizer_path(BYTE_BPE)
    text = LONG["words"] + "<|im_end|>" * 50_000
    df = spark.createDataFrame([(1, 0, "user", LONG["one"]), (1, 1, "assistant", text), (2, 0, "assistant", "")], "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(df, path), path).collect()}
    assert got[1].loss_chars == len(text) and got[1].loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[2].loss_chars == 0


def test_long_texts_of_simhash(spark):
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, [*LONG.values(), LONG["words"].upper(), ""])).collect()}
    assert got[0].fingerprint == f"{fingerprint(LONG['words']):016x}" and got[3].component_id == 0 and got[4].component_id == got[2].component_id == 2


def test_long_texts_of_pseudo_likelihood(spark):
    texts = [LONG["words"], LONG["one"], LONG["blank"], "w1x1 w2x2 w3x3", LONG["words"][:5000]]
    df = frame(spark, texts, batch="clash", keys=1)
    model, answers = pseudo_likelihood.fit(df)
    got = {r.doc_id: r for r in pseudo_likelihood._scored(model.packed, answers, model, True, "doc_id").collect()}
    for i, logs in enumerate(brute_pseudo_likelihood(texts, model)):
        if i == 1:  # a string too long for its probability to be a number
            assert got[1].n_words == 1 and got[1].pseudo_log_likelihood < -1e5
        else:
            assert got[i].n_words == len(logs) and np.isclose(got[i].pseudo_log_likelihood, sum(logs))


def test_long_texts_of_quality(spark):
    out = {r.doc_id: r for r in perplexity.quality(frame(spark, LONG.values(), lang="en", band="clash")).collect()}
    for i, text in enumerate(LONG.values()):
        assert (out[i].n_words, out[i].word_chars, out[i].n_symbols, out[i].n_dup_lines, out[i].n_repeat_words) == brute_quality(text)


@pytest.mark.parametrize("side", ["inside", "on", "outside"])
def test_texts_on_a_band_edge_are_kept(spark, side):
    """100 texts from 1.00 to 1.99: the quantiles at a tenth and nine tenths lie 0.396 from the median of 1.495."""
    costs = [(i, "en", 100, 500, 0, 0, 0, 1 + i / 100) for i in range(100)]
    schema = "doc_id long, band string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"
    bands = perplexity.verdicts(spark.createDataFrame(costs, schema)).select("lower", "upper").first()
    assert np.isclose(bands.lower, 1.495 - 3 * 0.396) and np.isclose(bands.upper, 1.495 + 3 * 0.396)
    asked = {"inside": bands.upper - 1e-9, "on": bands.upper, "outside": bands.upper + 1e-9}[side]
    edge = spark.createDataFrame([(1, asked)], "doc_id long, log_perplexity double")
    kept = edge.where(F.col("log_perplexity").between(bands.lower, bands.upper)).count()
    assert kept == (side != "outside")


def test_cosines_around_the_threshold(spark):
    """A link at the least cosine or above it by a rounding error's width, none below."""
    rows = []
    for i, c in enumerate((0.93 + 1e-9, 0.93 - 1e-9, 0.9301, 0.9299)):
        rows += [(10 * i, [1.0, 0.0, 0.0], i), (10 * i + 1, [c, float(np.sqrt(1 - c * c)), 0.0], i)]
    rows += [(90, [1.0, 2.0, 3.0], 9), (90, [1.0, 2.0, 3.0], 9), (91, [2.0, 4.0, 6.0], 9)]  # a repeated id, equal directions
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"code": F.lit(1), "others": F.lit("clash")})
    got = {}
    for r in itq.near_duplicates(df).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id))
    assert [got[10 * i][0][0] for i in range(4)] == [1, 0, 1, 0]
    assert got[90] == [(2, 90), (2, 90)] and got[91] == [(2, 90)]
