"""The change feed: idempotent upserts, event logs with gap-free sequences, deltas after cursors.

Each micro-batch is merged into the stored table by key; an event is logged only for rows
that are new or whose fingerprint over the watched columns changed.  Batches carry their
number, and one that was applied before is skipped, so a replay changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vacantia.functions.canonical import stable_struct
from vacantia.operators.resolve import merge_stored
from vacantia.sources.tables import next_sequences, version_path, write_version


def fingerprint(*columns: str, json: tuple[str, ...] = ()) -> Column:
    """SHA-256 of the columns' JSON, names in order at any depth; columns in ``json`` hold JSON texts and count by their content."""
    return F.sha2(stable_struct(*columns, json=json), 256)


def changes(old: DataFrame, new: DataFrame, key: str, watched: list[str]) -> DataFrame:
    """``key, kind`` of rows of ``new`` that ``old`` lacks or holds otherwise."""
    before = old.select(key, fingerprint(*watched).alias("__before"))
    after = new.select(key, fingerprint(*watched).alias("__after"))
    met = after.join(before, key, "left")
    return met.where(~F.col("__after").eqNullSafe(F.col("__before"))).select(key, F.when(F.col("__before").isNull(), "inserted").otherwise("updated").alias("kind"))


def upsert(old: DataFrame, incoming: DataFrame, watched: list[str], key: str = "canonical_key") -> tuple[DataFrame, DataFrame]:
    """The merged table, and the changes it brings."""
    merged = merge_stored(old, incoming, key)
    return merged, changes(old, merged, key, watched)


def append_missing(log: DataFrame, events: DataFrame, on: list[str], last: int) -> DataFrame:
    """Events that the log lacks, with the next sequence numbers."""
    fresh = events.join(log.select(*on).distinct(), on, "left_anti").dropDuplicates(on)
    return next_sequences(fresh, last, *[F.col(c) for c in on])


def latest_per(events: DataFrame, key: str, sequence: str = "sequence") -> DataFrame:
    """The last event of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*events.columns), sequence).alias("e")).select("e.*")


def delta(events: DataFrame, rows: DataFrame, on: str, after: int, until: int | None = None) -> DataFrame:
    """Rows that changed after a cursor, by their last event, with its sequence."""
    window = events.where((F.col("sequence") > after) & (F.col("sequence") <= until if until is not None else F.lit(True)))
    return latest_per(window, on).select(on, "sequence").join(rows, on)


def cursor(events: DataFrame) -> DataFrame:
    """The highest sequence of a log, 0 if it is empty."""
    return events.agg(F.coalesce(F.max("sequence"), F.lit(0)).cast("long").alias("cursor"))


def two_deltas(own: DataFrame, indexed: DataFrame, rows: DataFrame, on: str, after: int, indexed_after: int) -> DataFrame:
    """Rows new in a session's own log or in the global one, each once."""
    a = delta(own, rows, on, after).withColumn("origin", F.lit("session"))
    b = delta(indexed, rows, on, indexed_after).withColumn("origin", F.lit("index"))
    both = a.unionByName(b)
    return both.groupBy(on).agg(F.min_by(F.struct(*both.columns), F.when(F.col("origin") == "session", 0).otherwise(1)).alias("r")).select("r.*")


def run_feed(spark: SparkSession, source: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a stream that hands each micro-batch to ``apply`` once; ends when what is there has been read."""
    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_counts(spark: SparkSession, source: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Counts of a stream of events by user, as a versioned table that each micro-batch moves on by one.

    A batch is merged into the version before its own, whatever is current, so one that
    comes again after a failure writes the same version again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        fresh = batch.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))
        if number:
            fresh = spark.read.parquet(version_path(folder, number - 1)).unionByName(fresh)
        write_version(fresh.groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last_event").alias("last_event")), folder, number)

    return run_feed(spark, source, apply, checkpoint)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Extension: events by type in event-time windows, with late rows up to ``late``."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def deduplicated(events: DataFrame, on: list[str], late: str = "1 hour") -> DataFrame:
    """Events without repeats that come within ``late`` of each other."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(on)
