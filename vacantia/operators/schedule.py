"""Choosing what to run next: shares over platforms, round robins, quotas, leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.durable import drop, persist


def first_per(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    """The first row of each group: one pass of partial minima over the order's struct."""
    key = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    return rows.groupBy(by).agg(F.min_by(F.struct(*rows.columns), key).alias("r")).select("r.*")


def interleave(rows: DataFrame, channel: str, identity: str, n: int, *order: Column) -> DataFrame:
    """Round robin over channels: first of each, then second of each; an id counts at its first place; n rows at most."""
    place = F.row_number().over(Window.partitionBy(channel).orderBy(*order))
    laid = rows.withColumn("place", place)
    once = laid.groupBy(identity).agg(F.min_by(F.struct(*laid.columns), F.struct("place", channel)).alias("r")).select("r.*")
    return once.orderBy("place", channel, identity).limit(n)


def diverse(rows: DataFrame, platform: str, n: int, pos: str) -> DataFrame:
    """At most n rows, one of each platform before a second of any; platforms in order of first sight."""
    place = F.row_number().over(Window.partitionBy(platform).orderBy(pos))
    first = F.min(pos).over(Window.partitionBy(platform))
    return rows.withColumn("place", place).withColumn("first", first).orderBy("place", "first", pos).limit(n)


def quotas(capacities: DataFrame, platform: str, capacity: str, total: int) -> DataFrame:
    """Even shares of ``total`` that no platform's capacity exceeds, one at a time in order of name."""
    some = capacities.where(F.col(capacity) > 0)  # a sequence from 1 to 0 would count down
    units = some.select(platform, F.explode(F.sequence(F.lit(1), F.least(F.col(capacity).cast("int"), F.lit(total)))).alias("unit"))
    dealt = units.orderBy("unit", platform).limit(total)
    given = dealt.groupBy(platform).agg(F.count("*").alias("quota"))
    return capacities.select(platform).join(given, platform, "left").select(platform, F.coalesce("quota", F.lit(0)).cast("long").alias("quota"))


def select_with_reserves(rows: DataFrame, n: int, reserve_new: float, cap_share: float, *order: Column, identity: str = "source_id") -> DataFrame:
    """n sources: a share is kept for those never crawled, and no platform has more than its cap until others run out.

    Passes are ranks, not loops: each row's pass is decided by whether it is among the
    first new ones and by its place in its platform, and one sort takes the first n.
    """
    reserve, cap = max(1, int(n * reserve_new)), max(1, int(n * cap_share))
    in_platform = F.row_number().over(Window.partitionBy("platform").orderBy(*order))
    fresh = rows.where(F.col("last_crawled_at").isNull()).orderBy(*order).limit(reserve).select(F.col(identity).alias("__id"), F.lit(True).alias("__fresh"))
    placed = rows.withColumn("in_platform", in_platform).join(F.broadcast(fresh), F.col(identity) == F.col("__id"), "left")  # ``reserve`` rows at most
    turn = F.when(F.col("__fresh") & (F.col("in_platform") <= cap), 0).when(F.col("in_platform") <= cap, 1).otherwise(2)
    return placed.withColumn("turn", turn).drop("__id", "__fresh").orderBy("turn", *order).limit(n)


def even_budgets(rows: DataFrame, platform: str, total: int, *order: Column) -> DataFrame:
    """``platform, budget``: one each in order of first sight, then one more in turn, up to what a platform has; those that ``total`` doesn't reach have none."""
    seen = rows.groupBy(platform).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("__first"))
    units = seen.select(platform, "__first", F.explode(F.sequence(F.lit(1), F.least(F.col("n").cast("int"), F.lit(total)))).alias("unit"))
    return units.orderBy("unit", "__first").limit(total).groupBy(platform).agg(F.count("*").alias("budget"))


def five_passes(rows: DataFrame, n: int, priority: Column, unsure: Column, *order: Column, identity: str = "source_id") -> DataFrame:
    """At most n sources with the ``turn`` (1 to 5) that took them, each turn on what the last one left.

    1. priority sources, half of n at most; 2. the first of each platform; 3. the first
    quarter of those never crawled; 4. any, within the platforms' even budgets; 5. any.
    ``unsure`` sources, all of one platform, are kept to 15 % of n beside others from turn 2
    on, budgets hold in turns 2 and 4; where n takes all rows, all are taken in turn 0.

    The greedy loop takes, of a platform, its first rows up to what its budget leaves, and of
    unsure ones the first up to their cap: each turn is a top-k within platforms and one over
    all, so no rows pass through the driver, only two counts a turn.  ``order`` are columns
    that sort ascending and end in ``identity``.
    """
    if n <= 0:
        return rows.limit(0).withColumn("turn", F.lit(0))
    size, unsure_size = rows.agg(F.count("*"), F.count_if(unsure)).first()
    if size <= n:
        return rows.withColumn("turn", F.lit(0))
    cap = 0 if not unsure_size else n if unsure_size == size else min(unsure_size, max(1, int(n * 0.15)))
    budgets = even_budgets(rows, "platform", n, *order)
    marked = rows.select(F.col(identity).alias("__id"), "platform", F.struct(*order).alias("__at"), F.coalesce(priority, F.lit(False)).alias("__priority"), F.coalesce(unsure, F.lit(False)).alias("__unsure"), F.col("last_crawled_at").isNull().alias("__new"))
    base = persist(marked.join(budgets, "platform", "left"))
    first = base.groupBy("platform").agg(F.min_by("__id", "__at").alias("__id")).select("__id")
    pool = {1: base.where("__priority").orderBy("__at").limit(-(-n // 2)), 2: base.join(first, "__id", "left_semi"), 3: base.where("__new").orderBy("__at").limit(max(1, -(-n // 4))), 4: base, 5: base}
    taken = None
    for turn, some in pool.items():
        left, unsure_left = n, cap
        if taken is not None:
            count, unsure_count = taken.agg(F.count("*"), F.count_if("__unsure")).first()
            left, unsure_left = n - count, max(0, cap - unsure_count)
            if left <= 0:
                break
            some = some.join(taken.select("__id"), "__id", "left_anti")
        if turn > 1:
            some = some.where("not __unsure").unionByName(some.where("__unsure").orderBy("__at").limit(unsure_left))
        if turn in (2, 4):
            used = taken.groupBy("platform").agg(F.count("*").alias("__used"))
            place = F.row_number().over(Window.partitionBy("platform").orderBy("__at"))
            near = some.withColumn("__place", place).where(F.col("__place") <= n)  # no budget is above n
            room = F.col("budget") - F.coalesce("__used", F.lit(0))
            some = near.join(used, "platform", "left").where(F.col("budget").isNull() | (F.col("__place") <= room)).select(base.columns)
        got = some.orderBy("__at").limit(left).withColumn("turn", F.lit(turn))
        before, taken = taken, persist(got if taken is None else taken.unionByName(got))
        if before is not None:
            drop(before)
    return rows.join(taken.select(F.col("__id").alias(identity), "turn"), identity)


def rotate(profiles: DataFrame, start: int, n: int, now: Column) -> DataFrame:
    """The next n profiles from ``start`` on, wrapping around; ties by failures, priority, how long overdue, id."""
    size = profiles.agg(F.count("*").alias("__size"))
    overdue = F.unix_millis(now) - F.unix_millis(F.col("next_eligible_at"))
    met = profiles.crossJoin(F.broadcast(size))  # one row
    return met.withColumn("distance", F.pmod(F.col("idx") - start, F.col("__size"))).drop("__size").orderBy("distance", "failures", "priority", overdue.desc(), "profile_id").limit(n)


def claim(sources: DataFrame, wanted: DataFrame, owner: str, now: Column, seconds: int) -> DataFrame:
    """Sources with a lease for ``owner`` on the wanted ones that are free, expired or its own."""
    free = F.col("lease_owner").isNull() | (F.col("lease_expires_at") <= now) | (F.col("lease_owner") == owner)
    marked = sources.join(wanted.select("source_id", F.lit(True).alias("__wanted")).distinct(), "source_id", "left")
    take = F.coalesce("__wanted", F.lit(False)) & F.coalesce(free, F.lit(True))
    until = F.timestamp_millis(F.unix_millis(now) + seconds * 1000)
    return (
        marked.withColumn("claimed", take).withColumn("lease_owner", F.when(take, F.lit(owner)).otherwise(F.col("lease_owner")))
        .withColumn("lease_expires_at", F.when(take, until).otherwise(F.col("lease_expires_at"))).drop("__wanted")
    )


def release(sources: DataFrame, owner: str) -> DataFrame:
    mine = F.coalesce(F.col("lease_owner") == owner, F.lit(False))
    return sources.withColumn("lease_expires_at", F.when(~mine, F.col("lease_expires_at"))).withColumn("lease_owner", F.when(~mine, F.col("lease_owner")))
