"""Codes of vectors by product quantisation, whose books are searched by the exponion rule.

A part starts at its entry of the round before, at distance u. With s the distance from that entry to its nearest
neighbour, the nearest entry lies within 2u + s of the start (within 2u even), so only neighbours inside that ball are
read, in order of distance. Where 2u < s nothing is as near as the start, and none is read. Squared radii are rounded up,
so that the ball is never too small; distances are exact integers, and ties go to the lower index.

Vectors that are null or hold a null or non-finite component are left out; empty ones have parts without components and
so error 0. Each length of vector has books of its own; a length that the parts don't divide is cut as evenly as may be.
Rows that repeat a key stay rows of their own, and null keys start no entry while there are others. With fewer vectors than
entries each starts one; an empty table gives no rows. Null labels are a label. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.neighbour_scan import books_of, digest, finite, rounds
from scriptorium.llm.spread import spread_join

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


def reach(own: np.ndarray, near: np.ndarray) -> np.ndarray:
    """(2u + s) squared, rounded up; -1 where nothing can be as near as the start."""
    cross = np.ceil(4 * np.sqrt(own.astype(np.float64)) * np.sqrt(near.astype(np.float64)) * (1 + 1e-9)) + 1
    radius = 4.0 * own + near + cross
    return np.where(4 * own < near, -1, np.minimum(np.ceil(radius * (1 + 1e-15)), 2.0**62).astype(np.int64))


def encode(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, times: int = ROUNDS, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every vector that is kept.

    Books start as the parts of the vectors with the smallest keys, those of each length apart.
    """
    v = F.col(vector)
    kept = df.where(finite(v)).select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    lengths = [r[0] for r in kept.select(F.size("v").alias("n")).distinct().collect()]
    starts = [r["v"] for n in lengths for r in kept.where(F.size("v") == n).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    assigned, books = rounds(kept, books_of(starts, parts, scale), parts, times, reach, scale)
    named = assigned.select("id", F.coalesce("label", F.lit("")).alias("label"), F.col("label").isNull().alias("without"), "dim", "entry", "error")
    sums = named.groupBy("label", "without").agg(F.sum("error").alias("label_error"))
    found = spread_join(named, sums, ["label", "without"], ["id", "entry"])
    code = F.array_join(F.transform("entry", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    told = df.sparkSession.createDataFrame([(n, digest(b)) for n, b in books.items()], "dim int, codebooks_sha256 string")
    return found.join(F.broadcast(told), "dim").select(F.col("id").alias(key), code.alias("code"), "error", "label_error", "codebooks_sha256")


def oracle(entries: int = ENTRIES, times: int = ROUNDS, parts: int = PARTS, scale: int = SCALE) -> str:
    """DuckDB SQL of the same codes for vectors of one length, by comparing every part with every entry."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, len(embedding) // {parts} AS w, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))""",
        "flat AS MATERIALIZED (SELECT vec_id, x, j // w AS p, j % w AS i FROM (SELECT vec_id, w, unnest(v) AS x, unnest(range(len(v))) AS j FROM kept))",
        f"""c0 AS MATERIALIZED (SELECT c, x, j // w AS p, j % w AS i FROM (SELECT c, w, unnest(v) AS x, unnest(range(len(v))) AS j FROM
            (SELECT v, w, row_number() OVER (ORDER BY vec_id) - 1 AS c FROM kept) WHERE c < {entries}))""",
    ]
    for r in range(times + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, p, arg_min(c, (d, c)) AS c, min(d) AS d FROM
            (SELECT vec_id, p, c, sum((flat.x - c{r}.x) * (flat.x - c{r}.x)) AS d FROM flat JOIN c{r} USING (p, i) GROUP BY ALL) GROUP BY ALL)""")
        if r < times:
            steps.append(f"m{r} AS MATERIALIZED (SELECT p, c, i, sum(x) AS s, count(*) AS n FROM flat JOIN a{r} USING (vec_id, p) GROUP BY ALL)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT p, c, i, CAST(coalesce((s - ((s % n) + n) % n) // n, x) AS BIGINT) AS x FROM c{r} LEFT JOIN m{r} USING (p, c, i))")
    return f"""WITH {", ".join(steps)},
        h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, c, i)) AS codebooks_sha256 FROM c{times}),
        r AS (SELECT vec_id, string_agg(printf('%02x', CAST(c AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{times} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN kept USING (vec_id), h"""
