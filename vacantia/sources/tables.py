"""Typed access to stored tables, and writers that survive a lost executor.

Without a transactional table format an upsert writes a new version of the table beside
the old one and then moves a one-line pointer, so readers see either version whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.durable import persist

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


class Catalog:
    """DataFrames of a folder of Parquet tables by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def find(self, name: str, condition: Column, *order: Column, limit: int | None = None) -> DataFrame:
        """Rows of a table that meet a condition; the condition reaches the scan."""
        rows = self[name].where(condition)
        rows = rows.orderBy(*order) if order else rows
        return rows.limit(limit) if limit else rows


def imported_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Sponsorship profiles from a JSON array or, where a line is no JSON, from CSV with aliases between semicolons."""
    schema = "companyName string, aliases array<string>, domain string, h1bSponsorLikely boolean, confidence string, evidenceSummary string"
    whole = spark.read.text(path, wholetext=True)
    as_json = whole.select(F.from_json("value", f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>").alias("rows"))
    parsed = as_json.select(F.inline("rows"))
    if not parsed.isEmpty():
        return parsed
    rows = spark.read.csv(path, header=True, quote="")
    likely = F.lower(F.trim("h1bSponsorLikely"))
    return rows.select(
        F.trim("companyName").alias("companyName"), F.filter(F.transform(F.split("aliases", ";"), lambda a: F.trim(a)), lambda a: a != "").alias("aliases"), "domain",
        F.when(likely == "true", True).when(likely == "false", False).alias("h1bSponsorLikely"), "confidence", "evidenceSummary",
    )


def append_facts(facts: DataFrame, folder: str) -> None:
    """Add rows, such as checks of links, to a table of facts; what is there is never rewritten."""
    facts.write.mode("append").parquet(folder)


def merge_profiles(old: DataFrame, new: DataFrame, key: str = "company_key") -> DataFrame:
    """Profiles by company: aliases united and sorted, counts the larger, other fields the newer where known."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    counts = [c for c in old.columns if c.endswith("_count")]
    rest = [c for c in old.columns if c not in (key, "aliases", *counts)]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__new"))).alias(c)
    return both.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"), *[F.max(c).alias(c) for c in counts], *map(last, rest)).select(old.columns)


def version_path(folder: str, version: int) -> str:
    return f"{folder}/v{version:012d}"


def write_version(df: DataFrame, folder: str, version: int, partition_by: list[str] | None = None) -> str:
    """Write version ``version`` of a table and make it the current one; a rerun of the same version gives the same table."""
    spark, path = df.sparkSession, version_path(folder, version)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").text(f"{folder}/current-{version:012d}")
    return path


def read_current(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version whose pointer is complete."""
    pointers = spark.read.text(f"{folder}/current-*")
    return spark.read.parquet(pointers.agg(F.max("value")).first()[0])


def assert_unique(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, after a check that no two rows agree in ``columns``."""
    if not df.groupBy(*columns).count().where("count > 1").isEmpty():
        raise ValueError(f"rows repeat {columns}")
    return df


def next_sequences(rows: DataFrame, last: int, *order: Column) -> DataFrame:
    """Rows with gap-free sequence numbers after ``last``: counts per range of the order, then places within.

    Only one count a partition reaches the driver; no row passes through a single task.
    """
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    laid = persist(laid)
    counts = {r["__part"]: r["count"] for r in laid.groupBy("__part").count().collect()}
    base, at = {}, last
    for part in sorted(counts):
        base[part] = at
        at += counts[part]
    if not counts:
        return laid.drop("__part").withColumn("sequence", F.lit(0).cast("long"))
    start = F.create_map(*[F.lit(x) for kv in base.items() for x in kv])
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return laid.withColumn("sequence", (F.try_element_at(start, F.col("__part")) + place).cast("long")).drop("__part")
