"""The landing zone: raw answers of sources kept by request, with an age after which they are fetched again.

What fetches is outside the engine; it reads needed() and appends to the zone. Reading is plain scans, so a source's answers are
cached, replayed and shared like any table. Requests are keyed without credentials.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import redact
from scriptorium.operators.ranks import places
from scriptorium.operators.topk import best_per_group

#: Hours that answers of a kind stay fresh.
TTL_HOURS = {"default": 24, "lookup": 24 * 7, "proceedings": 24 * 7, "fulltext": 24 * 30}

#: Seconds between requests to a host, and to any other.
HOST_SECONDS = {"arxiv": 3.1, "semantic_scholar": 1.1, "pubmed": 0.35, "pmlr": 0.3, "openreview": 0.3, "openalex": 0.12, "crossref": 0.1}
OTHER_SECONDS = 0.2
#: Longest wait before another try.
LONGEST_WAIT = 60


def request_key(method: Column, url: Column, parameters: Column) -> Column:
    """A key of a request that doesn't depend on the order of its parameters (a map) or on credentials."""
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(parameters)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
    return F.sha1(F.concat_ws(" ", F.upper(method), redact(F.concat_ws("?", url, listed))))


def latest(zone: DataFrame) -> DataFrame:
    """The last answer to each request. zone: (request_key, kind, fetched_at, status, body)."""
    return best_per_group(zone.where("status = 200"), "request_key", F.desc("fetched_at")).drop("place")


def fresh(zone: DataFrame, now: datetime) -> DataFrame:
    """Last answers that aren't too old for their kind."""
    hours = F.create_map(*[F.lit(x) for pair in TTL_HOURS.items() for x in pair])
    allowed = F.coalesce(F.try_element_at(hours, F.col("kind")), F.lit(TTL_HOURS["default"]))
    age = (F.unix_timestamp(F.lit(now)) - F.unix_timestamp(F.col("fetched_at").cast("timestamp"))) / 3600
    return latest(zone).where(age <= allowed)


def needed(requests: DataFrame, zone: DataFrame, now: datetime) -> DataFrame:
    """Requests without a fresh answer."""
    return requests.join(fresh(zone, now).select("request_key"), "request_key", "left_anti")


def failures(zone: DataFrame, retried: tuple[int, ...] = (429, 500, 502, 503, 504)) -> DataFrame:
    """(request_key, tries, again) of requests whose last answer isn't one: told, and whether another try makes sense."""
    last = best_per_group(zone, "request_key", F.desc("fetched_at")).where("status <> 200")
    tries = zone.groupBy("request_key").agg(F.count_if(F.col("status") != 200).alias("tries"))
    return last.join(tries, "request_key").select("request_key", "status", "tries", F.col("status").isin(*retried).alias("again"))


def backoff_seconds(tries: Column) -> Column:
    """How long to wait before another try: twice as long after each failure, up to LONGEST_WAIT."""
    return F.greatest(F.lit(1.0), F.least(F.lit(float(LONGEST_WAIT)), F.pow(F.lit(2.0), tries - 1)))


def schedule(requests: DataFrame, start: datetime, order: str, host: str = "host") -> DataFrame:
    """requests with at, the earliest time each may go out (T08): a host's requests follow each other by its interval.

    Places come from ranks that are counted over ranges, so a host with most requests is as many tasks as any others.
    """
    seconds = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in HOST_SECONDS.items() for x in pair]), F.col(host)), F.lit(OTHER_SECONDS))
    at = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (seconds * F.col("_place")).cast("decimal(18,6)"))
    return places(requests, host, order, "_place").withColumn("at", at).drop("_place")
