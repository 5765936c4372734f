"""Dates: effective date, age, score bands, freshness, refresh and back-off intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
# Fixed values: (most days, score), for posting dates and for stand-ins.
POSTING_BANDS = [(3, 180), (7, 165), (14, 145), (30, 120), (60, 85), (120, 45), (None, 15)]
FALLBACK_BANDS = [(3, 55), (7, 45), (14, 35), (30, 25), (60, 15), (None, 5)]


def posted_at(value: Column) -> Column:
    """A timestamp from milliseconds as a number or from a date as text; null if neither."""
    plain = value.cast("string")
    return F.when(plain.rlike(r"^-?\d+(\.\d+)?$"), F.timestamp_millis(F.expr("cast(0 as long)") + plain.cast("double").cast("long"))).otherwise(F.try_to_timestamp(plain))


def age_days(at: Column, now: Column) -> Column:
    """Whole days of 24 hours before ``now``, not below 0; null for a null date."""
    return F.when(at.isNotNull(), F.floor(F.greatest(F.lit(0), F.unix_millis(now) - F.unix_millis(at)) / DAY_MS).cast("long"))


def _band(age: Column, bands: list[tuple[int | None, int]]) -> Column:
    out = None
    for most, score in bands:
        hit = F.lit(True) if most is None else age <= most
        out = F.when(hit, score) if out is None else out.when(hit, score)
    return out


def effective(posting: Column, crawled: Column, discovered: Column, now: Column) -> Column:
    """Struct of date, source, age in days and score of the first date that is known."""
    at = F.coalesce(posting, crawled, discovered)
    source = F.when(posting.isNotNull(), "postingDate").when(crawled.isNotNull(), "crawledAt").when(discovered.isNotNull(), "discoveredAt").otherwise("none")
    age = age_days(at, now)
    score = F.when(at.isNull(), 0).when(posting.isNotNull(), _band(age, POSTING_BANDS)).otherwise(_band(age, FALLBACK_BANDS))
    return F.struct(at.alias("at"), source.alias("source"), age.alias("age_days"), score.cast("int").alias("score"))


def is_stale(at: Column, minutes: Column, now: Column) -> Column:
    """Whether a check is missing or older than ``minutes``."""
    return F.coalesce(F.unix_millis(now) - F.unix_millis(at) > minutes * 60_000, F.lit(True))


def posted_within(at: Column, window: str, now: Column) -> Column:
    """Whether a date lies in the last ``24h``, ``7d`` or ``30d``; any other window takes all."""
    hours = {"24h": 24, "7d": 24 * 7, "30d": 24 * 30}.get(window)
    return F.lit(True) if hours is None else F.coalesce(F.unix_millis(at) >= F.unix_millis(now) - hours * 3_600_000, F.lit(False))


def freshness(last_crawled: Column, next_eligible: Column, backing_off: Column, now: Column) -> Column:
    """Why a source waits or not: never crawled, due, backing off after failures, or cooling down."""
    return (
        F.when(last_crawled.isNull(), "never_crawled").when(next_eligible <= now, "eligible_due").when(backing_off, "retry_backoff").otherwise("cooling_down")
    )


def backing_off(failures: Column, health: Column) -> Column:
    return (failures > 0) | health.isin("degraded", "failing")


def refresh_ms(interval: Column, priority: Column, source_type: Column, confidence: Column, health: Column) -> Column:
    """Milliseconds to the next run after a success: a multiple of the interval, at most a day."""
    band = F.when(priority <= 100, 2).when(priority <= 10_000, 3).when(priority <= 30_000, 4).otherwise(6)
    kind = F.when(source_type.isin("ats_board", "feed"), 0).when(source_type == "career_site", 1).when(source_type == "company_page", 2).otherwise(3)
    sure = F.when(confidence == "high", 0).when(confidence == "medium", 1).otherwise(2)
    well = F.when(health == "healthy", 0).when(health == "unknown", 1).otherwise(2)
    return F.least(F.greatest(interval * (band + kind + sure + well), interval), F.lit(DAY_MS)).cast("long")


def backoff_ms(interval: Column, failures: Column, health: Column) -> Column:
    """Milliseconds to the next run after failures: doubled each time up to 32 times, longer for bad health, within two intervals and seven days."""
    doubled = F.pow(F.lit(2.0), F.least(F.lit(5), failures))
    factor = F.when(health == "failing", 2.0).when(health == "degraded", 1.5).otherwise(1.0)
    return F.least(F.greatest(F.round(interval * doubled * factor), interval * 2), F.lit(7 * DAY_MS)).cast("long")


def next_eligible(last_crawled: Column, last_seen: Column, first_seen: Column, given: Column, interval: Column, refresh: Column, backoff: Column, backs_off: Column) -> Column:
    """When a source may run again: as given, else its last sighting, else its last run and the interval that applies."""
    seen = F.coalesce(last_crawled, last_seen, first_seen)
    after = F.when(last_crawled.isNull(), F.lit(0)).when(backs_off, backoff).otherwise(refresh)
    return F.coalesce(given, F.when(seen.isNull(), F.timestamp_millis(F.lit(0))).otherwise(F.timestamp_millis(F.unix_millis(seen) + after)))
