"""A stream's last event of each job, kept as state: what moved on, and what has gone quiet.

``changes`` holds one row of state a job, so a poll reads what batches have written since
its cursor and never aggregates the log again.  A task first folds its own events to one
row a job and Arrow batch, so a job with very many events sends few rows to its state.

Each batch gives a row a job that it moved on (``kind`` "changed", with the last sequence,
the one before the batch and the number of events so far), and a row for each job without an
event for ``quiet`` of event time ("stale", with the sequence that it went quiet at; again
only after another event).

Defined results: order within the stream does not matter, the highest sequence is the last;
events without a job or a sequence count for nothing; events without a time count as changes
and start no timer; those more than ``late`` behind the newest time seen in earlier batches
are too late for the state, as in any query with a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vacantia.sources.tables import write_version

FOLDED = "job_id long, sequence long, event_type string, ts timestamp, n long"
STATE = "sequence long, event_type string, due long, n long"
OUT = "job_id long, kind string, sequence long, previous long, event_type string, n long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a job: its last event, its newest time, how many there were."""
    for rows in parts:
        rows = rows.dropna(subset=["job_id", "sequence"])
        if not len(rows):
            continue
        last = rows.sort_values("sequence").groupby("job_id", sort=False).tail(1).set_index("job_id")
        every = rows.groupby("job_id", sort=False)
        yield last.assign(ts=every["ts"].max(), n=every["n"].sum()).reset_index()[["job_id", "sequence", "event_type", "ts", "n"]]


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


class LastEvents(StatefulProcessor):
    """State: a job's last sequence and type, its number of events, and when it is due to go quiet."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get() if self.last.exists() else (None, None, None, 0)
        sequence, kind, due, n = before
        for part in rows:
            n += int(part["n"].sum())
            top = part.loc[part["sequence"].idxmax()]
            if sequence is None or top["sequence"] > sequence:
                sequence, kind = int(top["sequence"]), _text(top["event_type"])
            newest = part["ts"].max()
            if not pd.isna(newest):
                at = int(newest.value // 1_000_000) if newest.tzinfo else int(newest.tz_localize("UTC").value // 1_000_000)
                due = at + self.quiet_ms if due is None else max(due, at + self.quiet_ms)
        if due != before[2]:
            if before[2] is not None:
                self.handle.deleteTimer(before[2])
            self.handle.registerTimer(due)
        self.last.update((sequence, kind, due, n))
        if sequence != before[0]:
            yield pd.DataFrame({"job_id": [key[0]], "kind": ["changed"], "sequence": [sequence], "previous": pd.array([before[0]], dtype="Int64"), "event_type": [kind], "n": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sequence, kind, _, n = self.last.get()
        yield pd.DataFrame({"job_id": [key[0]], "kind": ["stale"], "sequence": [sequence], "previous": pd.array([sequence], dtype="Int64"), "event_type": [kind], "n": [n]})

    def close(self) -> None:
        pass


def changes(events: DataFrame, quiet_ms: int, late: str = "1 hour") -> DataFrame:
    """A stream of ``job_id, sequence, event_type, ts`` as the stream of what moved on and what went quiet."""
    known = events.select(F.col("job_id").cast("long"), F.col("sequence").cast("long"), "event_type", F.col("ts").cast("timestamp"), F.lit(1).cast("long").alias("n"))
    folded = known.where("job_id is not null and sequence is not null").mapInPandas(fold, FOLDED)
    return folded.withWatermark("ts", late).groupBy("job_id").transformWithStateInPandas(LastEvents(quiet_ms), OUT, "append", "eventTime")


def run(spark: SparkSession, events: DataFrame, folder: str, checkpoint: str, quiet_ms: int, late: str = "1 hour") -> StreamingQuery:
    """Start the feed over what has landed; each batch is a version of its own, and one that comes again after a failure writes the same version."""

    def write(batch: DataFrame, number: int) -> None:
        write_version(batch, folder, number)

    named = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(named, None)
    spark.conf.set(named, ROCKS)  # several states and timers need it; a query keeps the setting that it starts with
    try:
        return changes(events, quiet_ms, late).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(named) if before is None else spark.conf.set(named, before)


def read_changes(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of complete batches, with the batch's number."""
    paths = [r["value"] for r in spark.read.text(f"{folder}/current-*").collect()]  # a line a batch
    rows = spark.read.schema(OUT).parquet(*paths)
    return rows.withColumn("batch", F.regexp_extract(F.input_file_name(), r"/v(\d{12})/", 1).cast("long"))


def since(feed: DataFrame, cursor: int) -> DataFrame:
    """``job_id, sequence`` of the jobs that moved on after a cursor, by their last event; the cursor reaches the scan."""
    return feed.where((F.col("kind") == "changed") & (F.col("sequence") > cursor)).groupBy("job_id").agg(F.max("sequence").alias("sequence"))


def quiet_jobs(feed: DataFrame) -> DataFrame:
    """The last known state of each job, with whether it is quiet: no event has followed its last "stale"."""
    newest = feed.groupBy("job_id").agg(F.max(F.struct("sequence", F.col("kind") == "stale", "n", "event_type")).alias("e"))
    return newest.select("job_id", "e.sequence", "e.event_type", "e.n", F.col("e.col2").alias("quiet"))
