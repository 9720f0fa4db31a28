"""Queries that run over whole tables and texts, against brute force."""

import hashlib
import re
from random import Random

from pyspark.sql import functions as F

from scriptorium import catalogue


def test_long_texts_are_rebuilt(spark, tmp_path):
    rnd = Random(2)
    words = [f"w{i}" for i in range(900)]
    texts = [" ".join(rnd.choice(words) for _ in range(n)) for n in (5, 700, 1500, 8000)] + [" a\t b\n\na\x0b", "", "   ", None, "one", "two"]
    rows = [(min(i, 8), t) for i, t in enumerate(texts)]  # the last two share an id
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.when(F.col("doc_id") != 1, F.length("text").cast("long")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    digest = lambda t: None if t is None else hashlib.sha256(re.sub(r"[ \t\n\r\f\v]+", " ", t).strip(" ").encode()).hexdigest()
    got = catalogue.queries()["rebuild_inverted_text"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.digest or "") for r in got) == sorted((i, digest(t) or "") for i, t in rows)
