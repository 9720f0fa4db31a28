"""Incremental runs: what was seen, windows with overlap, snapshots from changes, and the state of saved searches."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.dates import next_run
from scriptorium.functions.text import seen_keys
from scriptorium.operators.ranks import numbered
from scriptorium.operators.topk import best_per_group


def with_seen_keys(df: DataFrame) -> DataFrame:
    """df with the keys that its records are remembered by (F16)."""
    return df.withColumn("seen_keys", seen_keys(F.col("doi"), F.col("arxiv_id"), F.col("pmid"), F.col("title_key")))


def unseen(df: DataFrame, seen: DataFrame, key: str, keys: str = "seen_keys") -> DataFrame:
    """Records none of whose keys was seen (P05): keys meet the seen ones, and the records they belong to leave."""
    met = df.select(key, F.explode(keys).alias("seen_key")).join(seen.select("seen_key"), "seen_key", "left_semi").select(key).distinct()
    return df.join(met, key, "left_anti")


def settled(df: DataFrame, keys: str = "seen_keys") -> DataFrame:
    """Keys of records that need no other run: rejected, written, in the library, or upgrades."""
    done = (F.col("decision") == "reject") | F.col("written") | F.col("route").isin("existing", "upgrade")
    return df.where(done).select(F.explode(keys).alias("seen_key")).distinct()


def remember(seen: DataFrame, new: DataFrame) -> DataFrame:
    """The seen-set with new keys."""
    return seen.unionByName(new).distinct()


def scan_window(last: date | None, now: date, overlap: int = 10, lookback: int = 20, first_years: int = 3) -> date:
    """Where a scheduled scan begins."""
    return now - timedelta(days=365 * first_years) if last is None else min(last - timedelta(days=overlap), now - timedelta(days=lookback))


def latest_stamp(*stamps: Column) -> Column:
    """The latest of several stamps, missing ones aside."""
    return F.greatest(*stamps)


def scan_due(last: Column, now: Column, interval: int = 10) -> Column:
    """Whether a scan is due: none yet, or the interval has passed since the last."""
    return F.coalesce(F.date_diff(now, last) >= interval, F.lit(True))


def shares_any(a: Column, b: Column) -> Column:
    """Whether two lists of keys, ids or topics have a value in common."""
    return F.arrays_overlap(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))


def with_written(library: DataFrame, written: DataFrame) -> DataFrame:
    """The library with what this run wrote, so that its later rows match it too."""
    return library.unionByName(written.select(*library.columns))


def live_items(items: DataFrame) -> DataFrame:
    """Items that stand for works: not trashed, no notes, attachments or children."""
    return items.where(~F.coalesce("deleted", F.lit(False)) & ~F.col("itemType").isin("note", "attachment", "annotation") & F.col("parentItem").isNull())


def items_of(items: DataFrame, collection: str) -> DataFrame:
    """Live items of a collection."""
    return live_items(items).where(F.array_contains("collections", collection))


def advances(writing: bool, succeeded: bool, start: date, last: date | None) -> bool:
    """Whether a run moves the watermark: it wrote, it went well, and it left no gap."""
    return writing and succeeded and (last is None or start <= last)


def snapshot(base: DataFrame, changes: DataFrame, deleted: DataFrame, key: str = "key", version: str = "version", trashed: str = "deleted", owner: str | None = None) -> DataFrame:
    """A table with changes applied: the latest version of each key, without deleted ones and those whose latest version is
    trashed, where there is such a column (S19). owner: whose changes these are; of a base with an `owner` column, rows of
    others go. streaming/library.py keeps the same as state.
    """
    own = base.where(F.col("owner") == owner) if owner is not None and "owner" in base.columns else base
    latest = best_per_group(own.unionByName(changes, allowMissingColumns=True), key, F.desc(version)).drop("place")
    live = latest.where(~F.coalesce(trashed, F.lit(False))) if trashed in latest.columns else latest
    return live.join(deleted.select(key).distinct(), key, "left_anti")


def is_due(status: Column, next_at: Column, now: Column) -> Column:
    """Active, and its next run is past or open."""
    return (status == "active") & (next_at.isNull() | (next_at <= now))


def _alert_keys() -> list[Column]:
    return [F.when(F.col("status") == "active", 0).otherwise(1).asc(), F.col("next_run_at").asc_nulls_first(), F.col("name").asc()]


def alert_order(df: DataFrame) -> DataFrame:
    """Active ones first, then by next run and name."""
    return df.orderBy(*_alert_keys())


def alert_places(df: DataFrame) -> DataFrame:
    """df with place, from 1, in the order of alert_order(), which no task holds whole."""
    return numbered(df, *_alert_keys()).withColumn("place", F.col("place") + 1)


def after_run(alerts: DataFrame, outcomes: DataFrame, now: datetime, scheduled: bool, key: str = "id") -> DataFrame:
    """The state of saved searches after a run.

    outcomes: (key, failed boolean, retrieved int, errors int, dry_run boolean). A writing run that went well moves the
    watermark and the timer; a scheduled one always moves the timer, by a day after an exception.
    """
    at = F.lit(now).cast("timestamp_ntz")
    j = alerts.join(outcomes.withColumn("_ran", F.lit(True)), key, "left")
    ran, failed = F.coalesce("_ran", F.lit(False)), F.coalesce("failed", F.lit(False))
    well = ran & ~failed & ((F.col("retrieved") > 0) | (F.col("errors") == 0))
    report, dry = F.col("action") == "report_only", F.coalesce("dry_run", F.lit(False))
    writing = ~dry & ~report
    status = F.when(failed | ~well, "error").when(report, "report-only").when(dry, "dry-run").otherwise("ok")
    moved = F.lit(scheduled) | (writing & well)
    slot = next_run(F.when(failed, "error").otherwise("ok"), at, F.col("interval_days")).cast("timestamp_ntz")
    slot = slot + (at - F.date_trunc("day", at))
    return j.withColumns(
        {
            "last_run_at": F.when(ran, at).otherwise(F.col("last_run_at")),
            "last_status": F.when(ran, status).otherwise(F.col("last_status")),
            "last_success_at": F.when(ran & writing & well, at).otherwise(F.col("last_success_at")),
            "last_dry_run_at": F.when(ran & ~failed & ~writing, at).otherwise(F.col("last_dry_run_at")),
            "next_run_at": F.when(ran & F.when(failed, F.lit(scheduled)).otherwise(moved), slot).otherwise(F.col("next_run_at")),
        }
    ).select(*alerts.columns)


def after_edit(alerts: DataFrame, edits: DataFrame, now: datetime, key: str = "id") -> DataFrame:
    """State after edits (key, interval_days, changed_search boolean): a new interval counts from the last run; a changed search
    starts its coverage anew (T05)."""
    at = F.lit(now).cast("timestamp_ntz")
    e = edits.select(key, F.col("interval_days").alias("new_interval"), "changed_search", F.lit(True).alias("_edited"))
    j = alerts.join(e, key, "left")
    interval = F.coalesce("new_interval", "interval_days")
    from_last = F.coalesce(F.col("last_run_at"), at) + F.make_dt_interval(interval)
    timed = F.when(F.col("new_interval").isNotNull() & (F.col("new_interval") != F.col("interval_days")), from_last).otherwise(F.col("next_run_at"))
    anew = F.coalesce("changed_search", F.lit(False))
    return j.withColumns(
        {"next_run_at": F.when(anew, F.least(F.coalesce(timed, at), at)).otherwise(timed), "last_success_at": F.when(anew, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("last_success_at")), "interval_days": interval}
    ).select(*alerts.columns)
