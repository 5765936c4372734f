"""Aggregates: counts, ratios, health, quality, coverage, run states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_by(rows: DataFrame, key: Column, name: str = "key") -> DataFrame:
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sums of fetched and saved, duplicates and their ratio, by group (or over all)."""
    sums = rows.groupBy(*by).agg(F.sum("fetched").alias("fetched"), F.sum("saved").alias("saved"), F.sum("duplicates").alias("duplicates"), F.count("*").alias("runs"))
    return sums.withColumn("duplicate_ratio", F.coalesce(F.try_divide("duplicates", F.col("saved") + F.col("duplicates")), F.lit(0.0)))


def health(sources: DataFrame, now: Column) -> DataFrame:
    """Per platform: sources, eligible ones, failing ones, the last heartbeat, runs of the last day."""
    day = F.unix_millis(now) - F.unix_millis(F.col("last_crawled_at")) <= 86_400_000
    return sources.groupBy("platform").agg(
        F.count("*").alias("sources"), F.count_if(F.coalesce(F.col("next_eligible_at") <= now, F.lit(True))).alias("eligible"),
        F.count_if(F.col("health") == "failing").alias("failing"), F.max("last_crawled_at").alias("heartbeat"), F.count_if(F.coalesce(day, F.lit(False))).alias("last_day"),
    )


def result_quality(rows: DataFrame, target: int, fresh: Column, title: Column) -> DataFrame:
    """0.4 coverage + 0.3 fresh share + 0.3 (1 - share of repeated titles), in two levels of sums."""
    by_title = rows.groupBy(title.alias("t")).agg(F.count("*").alias("n"), F.count_if(fresh).alias("fresh"))
    sums = by_title.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("fresh"), F.lit(0)).alias("fresh"), F.count("*").alias("titles"))
    share = lambda a: F.coalesce(F.try_divide(a, F.col("n")), F.lit(0.0))
    repeats = share(F.col("n") - F.col("titles"))
    return sums.withColumn("duplicate_rate", repeats).withColumn("score", 0.4 * F.least(F.lit(1.0), F.col("n") / target) + 0.3 * share(F.col("fresh")) + 0.3 * (1 - repeats))


def index_age_ms(rows: DataFrame, now: Column) -> DataFrame:
    return rows.agg((F.unix_millis(now) - F.unix_millis(F.max(F.coalesce("indexed_at", "crawled_at", "discovered_at")))).alias("age_ms"))


def run_status(results: DataFrame, by: str) -> DataFrame:
    """State of a run from those of its parts: failed if nothing else, partial if mixed, completed, or unsupported."""
    failed, part, done = (F.bool_or(F.col("status").isin(*s)) for s in (("failed",), ("partial",), ("success", "completed")))
    return results.groupBy(by).agg(F.when(failed & ~done & ~part, "failed").when(failed | part, "partial").when(done, "completed").otherwise("unsupported").alias("run_status"))


def channels(rows: DataFrame, channel: str, names: list[str]) -> DataFrame:
    """One row: how many each channel found, and how many in all."""
    return rows.agg(*[F.count_if(F.col(channel) == n).alias(n) for n in names], F.count("*").alias("total"))


def samples(rows: DataFrame, by: list[str], identity: str, n: int = 12) -> DataFrame:
    """Counts of each group with its first n ids; ids past n never leave their task's partial rank."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(identity))
    return rows.withColumn("place", place).groupBy(*by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("place") <= n, F.col(identity)))).alias("samples"))


def coverage(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row: how many rows meet each test, and how many meet all."""
    every = None
    for t in tests.values():
        every = t if every is None else every & t
    return rows.agg(*[F.count_if(t).alias(k) for k, t in tests.items()], F.count_if(every).alias("combined"), F.count("*").alias("total"))
