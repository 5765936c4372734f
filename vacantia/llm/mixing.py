"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: the mix takes ``factor`` times the words of the input, shared among the sources
by weight; no source takes more than ``most`` times its size, and what it can't take is
shared anew among the rest, all in one water-filling over a table with a row a source.

Blocks: a hash permutes the documents of a source and cuts them into blocks of about
BLOCK_DOCS documents, at most MOST_BLOCKS a source.  A source's target is some whole
passes over its blocks and one partial pass: whole blocks in permuted order, then
documents of the block at the border, then of the next FILLERS documents those that
still fit, one after another, and one more where that comes nearer to the target.  Only sums of blocks, the documents of the border
block and those few are ever ordered, so a source with a third of all rows is summed in parts like any other.

Splitting tree: the blocks that a source gives, its exact quota, are split among the
output shards from the root down; at each node the left half draws its share of every
source from a multivariate hypergeometric distribution, so each shard gets whole blocks,
every block goes to exactly one, and the quotas add up.  The tree handles numbers of
blocks only: at most STRATA sources' counts (further sources share strata) go to the
driver.  Each shard then draws its blocks from the permuted order, disjoint by
construction, and shuffles its documents by a local hash.

All draws come from hashes and seeded generators: reruns agree.  DataFrame functions
only; tables with a row a source or block are read back from the shared folder, so their
true size decides whether Spark broadcasts them.

Defined results: a null text has size 0; sources are ordered by code point, the null
source last, and weigh ``weights`` in turn; rows that repeat an id, and rows whose ids
share a 40-bit hash, are chosen alike; an empty table gives no rows; other columns pass through ``mixed`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.durable import drop, persist
from vacantia.llm.common import WORD

BLOCK_DOCS, MOST_BLOCKS, STRATA, FILLERS = 64, 4096, 1024, 256
SPACE = 1 << 40
SHARD_WORDS, LEAST_SHARDS, MOST_SHARDS, PIECES = 4_000_000, 8, 4096, 4


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _permuted(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(SPACE))


def targets(rows: DataFrame, weights: tuple[int, ...], factor: float, most: float) -> DataFrame:
    """A row a source: ``source, at, docs, blocks, source_size, target``."""
    sums = rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")).cast("double")
    listed = sums.withColumn("at", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).cast("long")).withColumn("weight", weight)
    filled = Window.orderBy("full", "at")
    level = (
        listed.withColumn("full", most * F.col("source_size") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum(most * F.col("source_size")).over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (factor * F.sum("source_size").over(everything) - F.col("before")) / F.col("rest"))
        .withColumn("open", F.min_by("level", F.when(F.col("full") > F.col("level"), F.struct("full", "at"))).over(everything))
    )
    capped = most * F.col("source_size")
    return level.select(
        "source", "at", "docs", "source_size",
        F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_DOCS))).cast("long").alias("blocks"),
        F.coalesce(F.least(capped, F.col("open") * F.col("weight")), capped).cast("double").alias("target"),
    )


def _block(u: Column, blocks: Column) -> Column:
    return F.floor(u * blocks / F.lit(SPACE)).cast("long")


def _copies(u: Column, some: Column) -> Column:
    """How often the mix takes a document; ``some``: whether it has any word."""
    part = (u <= F.col("cut")) | F.array_contains("picked", u)
    return F.when(some, F.col("whole_passes") + part.cast("long")).otherwise(F.lit(0)).cast("long")


def _cut(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add ``cut`` and ``gap``: how far the partial pass goes in the permuted order, and the words then missing."""
    open_ = rows.join(plan, "at").where(F.col("size") > 0).select("at", "u", "size", _block(F.col("u"), F.col("blocks")).alias("block"))
    sums = open_.groupBy("at", "block").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("at").orderBy("block")
    running = sums.join(plan.select("at", "part"), "at").withColumn("upto", F.sum("words").over(order))
    border = persist(
        running.groupBy("at").agg(
            F.min(F.when(F.col("upto") > F.col("part"), F.col("block"))).alias("block"),
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("part"), F.col("upto"))), F.lit(0)).alias("whole"), F.first("part").alias("part"),
        )
    )
    inside = open_.join(border, ["at", "block"]).withColumn("upto", F.sum("size").over(Window.partitionBy("at").orderBy("u")) + F.col("whole"))
    ends = inside.where(F.col("upto") <= F.col("part")).groupBy("at").agg(F.max("u").alias("last"), F.max("upto").alias("got"))
    found = border.join(ends, "at", "left").select("at", "block", "whole", "last", "got")
    first_of_block = F.expr(f"if(block = 0, -1L, (block * {SPACE}L - 1L) div blocks)")
    return persist(
        plan.join(found, "at", "left").select(
            *plan.columns, F.when(F.col("block").isNull(), F.lit(SPACE)).otherwise(F.coalesce("last", first_of_block)).cast("long").alias("cut"),
            (F.col("part") - F.coalesce("got", "whole", F.lit(0))).cast("long").alias("gap"),
        )
    )


def _filled(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add ``picked``: of the next FILLERS documents past the cut, those that still fit one after another, and one more if that comes nearer."""
    later = rows.join(plan.select("at", "cut", "gap"), "at").where((F.col("size") > 0) & (F.col("u") > F.col("cut")) & (F.col("size") < 2 * F.col("gap")))
    next_ = later.withColumn("place", F.row_number().over(Window.partitionBy("at").orderBy("u", "size"))).where(F.col("place") <= FILLERS)  # each task keeps that many a source
    few = next_.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("u", "size"))).alias("few"))
    none = F.array().cast("array<bigint>")

    def take(done: Column, d: Column) -> Column:
        fits = d["size"] <= done["gap"]
        return F.struct(F.when(fits, done["gap"] - d["size"]).otherwise(done["gap"]).alias("gap"), F.when(fits, F.concat(done["picked"], F.array(d["u"]))).otherwise(done["picked"]).alias("picked"))

    done = plan.join(few, "at", "left").withColumn("done", F.aggregate("few", F.struct(F.col("gap").alias("gap"), none.alias("picked")), take))
    rest = F.filter("few", lambda d: ~F.array_contains("done.picked", d["u"]))
    nearest = F.array_min(F.transform(rest, lambda d: F.struct(F.abs(F.col("done.gap") - d["size"]).alias("off"), d["u"].alias("u"))))
    last = F.when(nearest["off"] < F.col("done.gap"), F.array(nearest["u"])).otherwise(none)
    return persist(done.select(*plan.columns, F.coalesce(F.concat("done.picked", last), none).alias("picked")))


def split(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Quota of every shard (rows) from every stratum (columns), by recursive halving."""
    quotas = np.zeros((shards, len(counts)), dtype=np.int64)

    def down(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            quotas[lo] = have
            return
        mid = (lo + hi) // 2
        total = int(have.sum())
        share = total * (mid - lo) // (hi - lo)
        draw = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, share, method="marginals") if total else have
        down(lo, mid, draw)
        down(mid, hi, have - draw)

    down(0, shards, np.array(counts, dtype=np.int64))
    return quotas


@dataclass
class Plan:
    """``sources``: a row a source; ``blocks``: a row a block with the shard of each of its passes."""

    sources: DataFrame
    blocks: DataFrame
    weights: tuple[int, ...]
    seed: int
    shards: int

    def apply(self, docs: DataFrame, some: Column) -> DataFrame:
        """``docs`` as a struct ``__row``, with ``source_size, target, copies, shards``; ``some``: whether a row has any word."""
        whole = docs.select(F.struct("*").alias("__row"), _permuted(self.seed).alias("__u"), F.col("source").alias("__source"))
        named = self.sources.withColumnRenamed("source", "__name")
        met = whole.join(named, F.col("__source").eqNullSafe(F.col("__name")))
        met = met.withColumn("block", _block(F.col("__u"), F.col("blocks"))).withColumn("copies", _copies(F.col("__u"), some))
        met = met.join(self.blocks.select("at", "block", "dealt"), ["at", "block"], "left")
        dealt = F.slice(F.coalesce("dealt", F.array().cast("array<int>")), F.lit(1), F.col("copies").cast("int"))
        return met.select("__row", "source_size", "target", "copies", dealt.alias("shards"))


def plan(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), factor: float = 1.5, most: float = 2.0, seed: int = 20) -> Plan:
    """From ``doc_id, source, size``: what each source, block and document gives, and to which shard."""
    rows = rows.withColumn("u", _permuted(seed))
    sources = persist(targets(rows, weights, factor, most))
    named = sources.select(F.col("source").alias("__name"), "at")
    placed = rows.join(named, rows["source"].eqNullSafe(named["__name"])).select("at", "u", "size")
    state = persist(
        sources.withColumn("whole_passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("part", F.round(F.col("target") - F.col("whole_passes") * F.col("source_size")).cast("long"))
    )
    state = _filled(placed, _cut(placed, state))
    copies = _copies(F.col("u"), F.col("size") > 0)
    units = persist(
        placed.join(state, "at").select("at", _block(F.col("u"), F.col("blocks")).alias("block"), copies.alias("copies"), "size")
        .groupBy("at", "block").agg(F.max("copies").cast("int").alias("copies"), F.sum(F.col("copies") * F.col("size")).alias("words"))
        .where("copies > 0").withColumn("stratum", F.col("at") % STRATA)
    )
    counts = {r["stratum"]: (r["n"], r["words"]) for r in units.groupBy("stratum").agg(F.sum("copies").alias("n"), F.sum("words").alias("words")).collect()}
    order = sorted(counts)
    wanted = sum(w for _, w in counts.values()) / SHARD_WORDS
    shards = max(LEAST_SHARDS, min(MOST_SHARDS, 1 << max(0, int(np.ceil(np.log2(max(1.0, wanted)))))))
    quotas = np.cumsum(split([int(counts[s][0]) for s in order], shards, seed), axis=0)
    spark = rows.sparkSession
    bounds = spark.createDataFrame([(int(s), quotas[:, k].tolist()) for k, s in enumerate(order)], "stratum long, bounds array<long>")
    drawn = (
        units.select("at", "block", "stratum", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("pass"))
        .withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy(F.xxhash64(F.lit(seed + 1), "at", "block", "pass"), "at", "block", "pass")) - 1)
        .join(F.broadcast(bounds), "stratum")  # at most STRATA rows
        .withColumn("shard", F.size(F.filter("bounds", lambda b: b <= F.col("place"))))
    )
    dealt = drawn.groupBy("at", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("dealt"))
    return Plan(state, persist(dealt), weights, seed, shards)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` of every row, written once so that the texts are read once."""
    return persist(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, shards``: what the mix takes of every row."""
    rows = measured(docs)
    size = F.col("__row")["size"]
    taken = (size * F.col("copies")).alias("taken")
    return plan(rows, **options).apply(rows, size > 0).select(F.col("__row")["doc_id"].alias("doc_id"), size.alias("size"), "source_size", "target", taken, "copies", "shards")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, dealt to its shards, in a shard's shuffled order.

    The shard of a copy is known, so copies go straight to PIECES tasks a shard, and no
    words are counted again.
    """
    sizes = measured(docs)
    made = plan(sizes, **options)
    drop(sizes)
    text = F.col("__row")["text"]
    rows = made.apply(docs, F.coalesce(text.rlike(WORD), F.lit(False))).select("__row", F.posexplode("shards").alias("pass", "shard"))
    order = F.pmod(F.xxhash64(F.lit(made.seed + 2), F.col("__row")["doc_id"], "pass"), F.lit(SPACE))
    piece = (F.col("shard") * PIECES + F.floor(F.col("order") * PIECES / F.lit(SPACE))).cast("int")
    return (
        rows.withColumn("order", order).repartitionById(made.shards * PIECES, piece)
        .sortWithinPartitions("shard", "order").select("__row.*")
    )
