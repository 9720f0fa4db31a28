"""The pipeline against a brute-force run of its stages, and its edge cases."""

import re
from random import Random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from scriptorium.llm import mixing, secrets, toxicity
from scriptorium.llm.tokenizer_files import BYTE_BPE, tokenizer_path
from tests.llm.test_near_copies import brute_groups
from tests.llm.test_text_operators import brute_secrets


def tables(spark, folder, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def corpus():
    rnd = Random(21)
    words = ["".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(3, 9))) for _ in range(500)]
    rows, labels = [], []
    for i in range(300):
        text = [rnd.choice(words) for _ in range(rnd.randint(40, 90))]
        if i % 6 == 0:
            text[3] = "grubling"
        if i % 10 == 1:
            text[7] = f"token = {'a1b2c3d4' * 3}"
        labels.append((i, 1, int(i % 6 == 0)))
        rows.append((i, " ".join(text), ["en", "de", "xx"][i % 3], f"src{i % 4}"))
        if i % 4 == 1:  # a near copy
            text[20] = "changed"
            rows.append((1000 + i, " ".join(text), "en", "src1"))
        if i % 9 == 2:
            rows.append((2000 + i, " ".join(text), "en", "src2"))
    return rows, labels


def test_run_is_brute_force(spark, tmp_path):
    rows, labels = corpus()
    tables(spark, tmp_path, rows, labels)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    model = toxicity.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = toxicity.matcher(model).scores([t for _, t, *_ in rows])
    kept = [r for r, s in zip(rows, scores, strict=True) if s < toxicity.REJECT_AT]
    assert not any("grubling" in t for _, t, *_ in kept) and len(kept) == sum("grubling" not in t for _, t, *_ in rows)
    heads = brute_groups([t for _, t, *_ in kept])
    kept = [kept[i] for i in sorted(set(heads))]
    masked = []
    for key, text, lang, source in kept:
        out, last = "", 0
        for rule, a, b in brute_secrets(text):
            if a >= last:
                out, last = out + text[last:a] + f"[{secrets.RULES[rule].kind}]", b
        masked.append((key, out + text[last:], lang, source))
    documents = pd.DataFrame(masked, columns=["doc_id", "text", "lang", "source"])  # noqa: F841  read by the SQL
    drawn = set(duckdb.sql(mixing.oracle(corpus_pipeline.MIX, corpus_pipeline.MIX_RATE)).df()["doc_id"])
    library = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    want = {key: library.encode(text, add_special_tokens=False).ids for key, text, *_ in masked if key in drawn}
    assert {k: r.ids for k, r in got.items()} == want and all(r.returns and r.n_tokens == len(r.ids) for r in got.values())


@pytest.mark.parametrize("shape", ["empty", "repeated", "nulls", "long"])
def test_stages_at_the_edges(spark, tmp_path, shape):
    rows = {
        "empty": [],
        "repeated": [(1, "a b c d e f g", "en", "src0")] * 3 + [(1, "other words stand here now and then", "en", "src0"), (2, "a b c d e f g", "en", "src0")],
        "nulls": [(None, None, None, None), (1, None, None, None), (2, "", "en", None), (None, "words without a key", "en", "src0")],
        "long": [(1, "word " * 300_000, "en", "src0"), (2, "x" * 900_000, "en", "src0"), (3, "token=abcdefgh12 " * 20_000, "de", "src1")],
    }[shape]
    docs = tables(spark, tmp_path, rows, [(1, 1, 0)])
    extra = docs.withColumns({"fp": F.lit("own"), "mix_topic": F.lit(7), "score": F.lit(None).cast("string"), "cluster": F.lit(1)})
    now = extra
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "tokens":
            assert now.columns == extra.columns
    kept = [r.doc_id for r in now.collect()]
    if shape == "empty":
        assert kept == []
    if shape == "repeated":
        assert set(kept) <= {1} and len(kept) <= 1
    if shape == "nulls":
        assert set(kept) <= {None, 1, 2}
    if shape == "long":
        texts = {r.doc_id: r.text for r in corpus_pipeline.secrets(spark, extra, str(tmp_path)).collect()}
        assert texts[3] == "[assign] " * 20_000 and re.fullmatch("x+", texts[2])
