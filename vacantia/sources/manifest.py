"""Several tables that change together.

A commit writes each table as a version of its own and then one manifest that names them
all, so readers see all of a commit or nothing of it: a writer that is lost on its way
leaves versions that no manifest names, and the next try overwrites them.  A manifest once
complete is not written again, so a replayed commit changes nothing and gives back the
counts that it was made with.

``put`` stores a batch of records with its three logs in one such commit: records merged by
key, a change log with gap-free sequence numbers, and who has met which record (by run and
by session), each pair once.

Defined results: a batch without rows makes a version like the last; records that repeat a
key within a batch are merged first; a key may not be null.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.durable import drop, persist
from vacantia.sources.tables import assert_unique, next_sequences
from vacantia.streaming.feed import changes

LOGS = {"changes": "key {k}, kind string, sequence long", "runs": "run string, key {k}, sequence long", "sessions": "session string, key {k}, sequence long"}


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def manifest_path(folder: str, version: int) -> str:
    return f"{folder}/manifest-{version:012d}"


def read_manifest(spark: SparkSession, folder: str, version: int | None = None) -> dict | None:
    """The manifest of a version, or the newest complete one; none before the first."""
    files, place = _place(spark, manifest_path(folder, version) if version is not None else f"{folder}/manifest-*")
    complete = [str(f.getPath()) for f in files.globStatus(place) or [] if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return json.loads(spark.read.text(max(complete)).first()[0]) if complete else None


def read_table(spark: SparkSession, manifest: dict, name: str) -> DataFrame:
    return spark.read.parquet(manifest["tables"][name])


def commit(spark: SparkSession, folder: str, version: int, tables: dict[str, DataFrame], unique: dict[str, list[str]], facts: dict) -> dict:
    """Write the tables, check that no two rows agree in the columns of ``unique``, and make the version visible."""
    made = {"version": version, "tables": {}, "facts": facts}
    for name, table in tables.items():
        path = f"{folder}/{name}/v{version:012d}"
        table.write.mode("overwrite").parquet(path)
        if name in unique:
            assert_unique(spark.read.parquet(path), *unique[name])
        made["tables"][name] = path
    spark.createDataFrame([(json.dumps(made),)], "value string").coalesce(1).write.mode("overwrite").text(manifest_path(folder, version))
    return made


def put(folder: str, version: int, batch: DataFrame, key: str, watched: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], run: str, session: str) -> dict:
    """Merge a batch into the records of ``folder`` and log what came of it; gives the commit's manifest.

    ``merge(old, new)`` gives the records to store, a row a key.  Counts: ``inserted``,
    ``updated``, ``unchanged``, and ``linked`` for keys that the run had not met before.
    """
    spark = batch.sparkSession
    if done := read_manifest(spark, folder, version):
        return done
    last = read_manifest(spark, folder)
    kind = batch.schema[key].dataType.simpleString()
    old = read_table(spark, last, "records") if last else batch.limit(0)
    logs = {n: read_table(spark, last, n) if last else spark.createDataFrame([], ddl.format(k=kind)) for n, ddl in LOGS.items()}
    ends = last["facts"]["last"] if last else {n: 0 for n in LOGS}
    stored = persist(merge(old, batch))
    changed = persist(changes(old, stored, key, watched))
    came = batch.select(F.col(key).alias("key")).distinct()
    fresh = {
        "changes": changed.select(F.col(key).alias("key"), "kind"),
        "runs": came.select(F.lit(run).alias("run"), "key").join(logs["runs"], ["run", "key"], "left_anti"),
        "sessions": came.select(F.lit(session).alias("session"), "key").join(logs["sessions"], ["session", "key"], "left_anti"),
    }
    numbered = {n: persist(next_sequences(rows, ends[n], F.col("key"))) for n, rows in fresh.items()}
    kinds = {r["kind"]: r["n"] for r in changed.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    added = {n: rows.count() for n, rows in numbered.items()}
    facts = {
        "inserted": kinds.get("inserted", 0), "updated": kinds.get("updated", 0), "unchanged": came.count() - sum(kinds.values()), "linked": added["runs"],
        "last": {n: ends[n] + added[n] for n in LOGS},
    }
    tables = {"records": stored} | {n: logs[n].unionByName(numbered[n]) for n in LOGS}
    made = commit(spark, folder, version, tables, {"records": [key], "runs": ["run", "key"], "sessions": ["session", "key"], "changes": ["sequence"]}, facts)
    drop(stored, changed, *numbered.values())
    return made
