"""A training corpus in stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result to the shared folder and hands
what it reads back to the next one. All stages but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.batches import small_batches
from scriptorium.llm.bpe import encode_frame
from scriptorium.llm.mixing import Targets, mix
from scriptorium.llm.near_copies import keep_one
from scriptorium.llm.secrets import redact_frame
from scriptorium.llm.tokenizer_files import BYTE_BPE, tokenizer_path
from scriptorium.llm.toxicity import drop_toxic, learn
from scriptorium.session import drop_path, settle, table

#: Shares of words that the corpus is mixed to, and the share of its words to draw (1: all that the targets allow).
MIX, MIX_RATE = Targets(), 1.0


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; what toxic means is learned from the labels, held-out rows excepted."""
    return drop_toxic(docs, learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard 0.8 of five-word shingles) stays: the one with the smallest doc_id."""
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kind; every document stays."""
    return redact_frame(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn with probabilities that bring sources, languages and topics to the target shares."""
    return mix(docs, MIX, MIX_RATE).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, ids, returns): ids of each text, and whether they decode to it."""
    encoded = encode_frame(docs.select("doc_id", "source", "lang", "text"), tokenizer_path(BYTE_BPE), returns="returns")
    return encoded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", "returns")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("tokens", tokens)]

#: Lexicons are learned, fingerprints linked and symbols merged: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over documents."""
    small_batches(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = settle(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
