"""Samples of bounded size that no task or driver has to hold more of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPAN = 1 << 32


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows of df, chosen by a hash of their key: all of a smaller table, nearly `rows` of a larger one.

    The hash cuts the table down before the limit, so that what reaches the last task is hardly more than the sample.
    """
    total = df.count()
    if total > rows:
        share = 0.95 * rows / total
        df = df.where(F.pmod(F.xxhash64(key), F.lit(_SPAN)) < F.lit(int(share * _SPAN)))
    return df.orderBy(F.xxhash64(key), key).limit(rows)
