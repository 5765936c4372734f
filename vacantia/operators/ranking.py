"""Ranking: final score with explanation, total orders, pages and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions import dates

SOURCES = {"postingDate": 3, "crawledAt": 2, "discoveredAt": 1}
LOCALE = "UNICODE"


def explain(relevance: Column, date: Column) -> Column:
    """Struct of relevance, date score, their sum and what contributed. ``date``: of ``dates.effective``."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv]), date["source"]), F.lit(0))
    fallback = date["source"].isin("crawledAt", "discoveredAt")
    said = [F.concat(F.lit("relevance="), relevance.cast("string")), F.concat(F.lit("date="), date["score"].cast("string")), F.concat(F.lit("dateSource="), date["source"]), F.when(fallback, "fallbackDateUsed=true")]
    return F.struct(
        relevance.cast("int").alias("relevance"), date["score"].alias("date_score"), (relevance + date["score"]).cast("int").alias("final_score"),
        rank.alias("source_rank"), date["source"].alias("date_source"), date["at"].alias("at"), F.array_compact(F.array(*said)).alias("contributors"),
    )


def rank_order(ranking: Column) -> list[Column]:
    """Best first: score, relevance, kind and score of the date, the date, then texts by locale, then position."""
    local = lambda c: F.collate(F.coalesce(F.col(c), F.lit("")), LOCALE)
    return [
        ranking["final_score"].desc(), ranking["relevance"].desc(), ranking["source_rank"].desc(), ranking["date_score"].desc(), ranking["at"].desc_nulls_last(),
        local("company"), local("title"), local("platform"), local("source_job_id"), local("url"), F.col("pos"),
    ]


def ranked(jobs: DataFrame, relevance: Column, now: Column) -> DataFrame:
    """Add ``ranking`` to jobs with posted_at, crawled_at and discovered_at."""
    date = dates.effective(F.col("posted_at"), F.col("crawled_at"), F.col("discovered_at"), now)
    return jobs.withColumn("__date", date).withColumn("ranking", explain(relevance, F.col("__date"))).drop("__date")


def top(jobs: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """The n best after ``offset``: a bounded heap in each task, then one merge."""
    return jobs.orderBy(*rank_order(F.col("ranking"))).offset(offset).limit(n)


def page_size(asked: int | None, default: int = 50, most: int = 100) -> int:
    return default if not asked or asked < 1 else min(asked, most)


def after(events: DataFrame, sequence: int, n: int) -> DataFrame:
    """The next n events of a log after a cursor."""
    return events.where(F.col("sequence") > sequence).orderBy("sequence").limit(n)


def persistence_order(relevance: Column) -> list[Column]:
    return [relevance.desc(), F.col("posted_at").desc_nulls_last(), F.collate(F.col("title"), LOCALE), F.collate(F.col("platform"), LOCALE)]


def inventory_score(now: Column, preferred: list[str], places: list[str]) -> Column:
    """Penalty of a source for a search; less is better."""
    c = F.col
    health = F.when(c("health") == "healthy", 0).when(c("health") == "unknown", 250).when(c("health") == "degraded", 2500).when(c("health") == "failing", 8000).otherwise(0)
    wait = F.unix_millis(c("next_eligible_at")) - F.unix_millis(now)
    cooling = F.when(wait > 0, 20_000 + F.least(F.lit(30_000), F.ceil(wait / 60_000))).otherwise(0)
    overlap = lambda tags: F.size(F.array_intersect(F.coalesce(c("tags"), F.array().cast("array<string>")), F.array(*map(F.lit, tags)))) if tags else F.lit(0)
    sure = F.when(c("confidence") == "high", -50).when(c("confidence") == "low", 150).otherwise(0)
    inactive = F.when(c("status") == "active", 0).otherwise(100_000)
    return (c("inventory_rank") + c("crawl_priority") * 0.5 + inactive + health + cooling - overlap(preferred) * 10_000 - overlap(places) * 1_500 + sure).cast("double")


def yield_rank() -> Column:
    """What a source of this kind and health is likely to give; less is better."""
    ill = F.col("health").isin("degraded", "failing")
    return (
        F.when(F.col("source_type").isin("ats_board", "feed"), F.when(ill, 1).otherwise(0)).when(F.col("source_type") == "job_detail", 2)
        .when(F.col("source_type") == "career_site", 3).when(F.col("source_type") == "company_page", F.when(F.col("health") == "unknown", 6).otherwise(4)).otherwise(5)
    )


def schedule_order(now: Column) -> list[Column]:
    """Yield, health, failures, how long overdue, priority, rank, next date, id."""
    health = F.when(F.col("health") == "healthy", 0).when(F.col("health") == "unknown", 1).when(F.col("health") == "degraded", 2).otherwise(3)
    overdue = F.greatest(F.lit(0), F.unix_millis(now) - F.unix_millis(F.col("next_eligible_at")))
    return [yield_rank(), health, F.col("consecutive_failures"), overdue.desc(), F.col("crawl_priority"), F.col("inventory_rank"), F.col("next_eligible_at"), F.col("source_id")]


def render_keys(rows: DataFrame, identity: str, *order: Column) -> DataFrame:
    """Add ``render_key``: the identity, from the second row on with its number."""
    at = F.row_number().over(Window.partitionBy(identity).orderBy(*order))
    return rows.withColumn("render_key", F.when(at == 1, F.col(identity)).otherwise(F.concat(F.col(identity), F.lit("#"), at.cast("string"))))
