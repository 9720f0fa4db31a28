"""Centroid clustering by sort-means: exact rounds that read only centroids near the one a vector had.

Each round orders, for each centroid, the others by their distance from it. A vector starts at its centroid of the round
before and reads that order; by the triangle inequality a centroid over twice as far from it as the vector is can't be
nearer to the vector, so the scan stops strictly beyond (equally near ones are still read: ties go to the smaller number).

Vectors that are null, of another length than `dim`, or hold a null or non-finite component are left out. Rows that repeat
a key, or vectors that are equal, stay rows of their own. Null keys start no centroid while there are others. With fewer
vectors than centroids each starts one; an empty table gives no rows. Labels and other columns aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.neighbour_scan import books_of, digest, finite, rounds

DIM, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1


def reach(own: np.ndarray, _: np.ndarray) -> np.ndarray:
    """Twice the distance to the centroid, squared."""
    return 4 * own


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS, times: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept.

    Centroids start as the vectors whose `seed:key` has the smallest SHA-256.
    """
    v = F.col(vector)
    kept = df.where(finite(v) & (F.size(v) == dim)).select(F.col(key).cast("long").alias("id"), F.lit(None).cast("string").alias("label"), v.alias("v"))
    first = kept.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("hash"))
    starts = [r["v"] for r in first.orderBy(F.col("hash").asc_nulls_last(), "v").limit(centroids).collect()]
    assigned, books = rounds(kept, books_of(starts, 1, scale), 1, times, reach, scale)
    rows = assigned.select(F.col("id").alias(key), F.col("entry")[0].alias("cluster"), F.col("error").alias("distance"))
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    found = [(c, sums.get(c, 0), sum(sums.values()), digest([e[None]])) for entries in books.values() for c, e in enumerate(entries[0])]
    told = df.sparkSession.createDataFrame(found, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(told), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(centroids: int = CENTROIDS, times: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> str:
    """DuckDB SQL of the same clusters, by comparing every vector with every centroid."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"flat AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, unnest(range({dim})) AS i FROM kept)",
        f"c0 AS MATERIALIZED (SELECT c, unnest(v) AS x, unnest(range({dim})) AS i FROM (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM kept) WHERE c < {centroids})",
    ]
    for r in range(times + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM
            (SELECT vec_id, c, sum((flat.x - c{r}.x) * (flat.x - c{r}.x)) AS d FROM flat JOIN c{r} USING (i) GROUP BY ALL) GROUP BY ALL)""")
        if r < times:
            steps.append(f"""m{r} AS MATERIALIZED (SELECT c, i, sum(x) AS s, count(*) AS n FROM flat JOIN a{r} USING (vec_id) GROUP BY ALL)""")
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, i, CAST(coalesce((s - ((s % n) + n) % n) // n, x) AS BIGINT) AS x FROM c{r} LEFT JOIN m{r} USING (c, i))""")
    return f"""WITH {", ".join(steps)}, h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{times} GROUP BY c)
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
            CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{times} JOIN h USING (c)"""
