"""Entities that grow batch by batch.

Two tables hold the state: ``keys`` (key, entity) names the entity that a key first came
with and is only ever added to; ``roots`` (entity, root) says into which entity another has
been merged since.  A batch is joined with the keys that its records carry, so it meets
only the entities that it touches; components are found among its records and those, and
merged entities get one row, or have theirs moved, in ``roots``.  An entity is named by the
smallest id of its records, whatever batch brought it, so any split of records into batches
ends with the entities of a single run.  No join broadcasts a side: with many batches and
rounds even small sides would add up on the driver.

Defined results: a record without keys is an entity of its own and leaves no state; null
keys are ignored; a record that comes again changes nothing; a key that no batch has
brought belongs to no entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.durable import drop, persist
from vacantia.operators.components import connected_components


def nothing(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The state before the first batch."""
    return spark.createDataFrame([], "key string, entity long"), spark.createDataFrame([], "entity long, root long")


def rooted(found: DataFrame, roots: DataFrame) -> DataFrame:
    """``found`` with its ``entity`` replaced by ``root``."""
    return found.join(roots.hint("merge"), "entity", "left").withColumn("root", F.coalesce("root", "entity")).drop("entity")


def add_batch(state: tuple[DataFrame, DataFrame], records: DataFrame, identity: str = "id", keys_column: str = "keys") -> tuple[DataFrame, DataFrame]:
    """The state after the records of a batch."""
    keys, roots = state
    said = persist(records.select(F.col(identity).alias("id"), F.explode(F.array_distinct(F.array_compact(keys_column))).alias("key")))
    known = persist(rooted(said.join(keys.hint("merge"), "key"), roots).select("id", "key", "root"))
    firsts = said.groupBy("key").agg(F.min("id").alias("first"))
    edges = known.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(said.join(firsts.hint("merge"), "key").select(F.col("id").alias("a"), F.col("first").alias("b")))
    members = persist(connected_components(edges))
    component = members.select(F.col("node").alias("id"), "component")
    fresh = firsts.join(keys.hint("merge"), "key", "left_anti").select("key", F.col("first").alias("id")).join(component.hint("merge"), "id", "left").select("key", F.coalesce("component", "id").alias("entity"))
    merged = known.select("root").distinct().join(members.hint("merge"), F.col("root") == F.col("node")).where("component < root").select("root", "component")
    moved = roots.join(merged.hint("merge"), "root", "left").select("entity", F.coalesce("component", "root").alias("root"))
    after = persist(keys.unionByName(fresh)), persist(moved.unionByName(merged.select(F.col("root").alias("entity"), F.col("component").alias("root"))))
    drop(said, known, members, keys, roots)
    return after


def entities(state: tuple[DataFrame, DataFrame], records: DataFrame, identity: str = "id", keys_column: str = "keys") -> DataFrame:
    """``id, entity`` of records that have come: that of any of their keys, all being of one entity."""
    keys, roots = state
    said = records.select(F.col(identity).alias("id"), F.explode_outer(F.array_compact(keys_column)).alias("key"))
    found = rooted(said.join(keys.hint("merge"), "key", "left").withColumn("entity", F.coalesce("entity", "id")), roots)
    return found.groupBy("id").agg(F.min("root").alias("entity"))
