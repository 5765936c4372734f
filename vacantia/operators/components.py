"""Connected components by alternating large-star and small-star rounds.

Every round is two keyed minima and two equi-joins, so a node with very many neighbours
costs one partial aggregate and a join that adaptive execution can split; no
neighbourhood is ever collected, and no join broadcasts a side, as over the rounds even
small sides would add up on the driver.  The number of rounds grows with the logarithm of
the number of nodes; edges that are stars already need none.  A round's edges are deleted
as soon as the next round's are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.durable import drop, persist


def are_stars(edges: DataFrame) -> bool:
    """Whether each child has one parent and no parent is a child, for distinct edges ``u, v``."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
    )
    nodes = ends.groupBy("n").agg(F.sum("child").alias("parents"), F.max("parent").alias("parent"))
    return nodes.where((F.col("parents") > 1) | ((F.col("parents") > 0) & (F.col("parent") > 0))).isEmpty()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """``node, component`` for every node that has an edge to another one.

    ``component`` is the smallest node reachable.  Null ends and self loops are ignored;
    repeated and reversed edges count once; no edges give no rows.
    """
    a, b = F.col(left), F.col(right)
    e = persist(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    for _ in range(rounds):
        if are_stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low.hint("merge"), "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low.hint("merge"), "u").where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        last, e = e, persist(small)
        drop(last)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
