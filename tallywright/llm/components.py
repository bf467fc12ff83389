"""Connected components of an edge table by alternating large and small stars.

Each round is two grouped minima and two joins; edges shrink towards stars whose
centre is the least node of the component, in a number of rounds that grows with
the logarithm of the longest chain, and there are none where edges are such stars
already. Nothing is collected: a round is written to the shared folder in place of
the one before it, and only whether stars are left alone reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import dropped, kept


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang every neighbour of a node that is above (large) or not above it (small) on its least neighbour."""
    pairs = edges.select("a", "b")
    if large:
        pairs = pairs.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # edges have a > b: small stars see a's lesser neighbours only
    least = pairs.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("centre"), F.least("a", "least").alias("least"))
    hung = pairs.join(least, F.col("a") == F.col("centre"))
    if large:
        moved = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = hung.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select(F.col("centre").alias("a"), F.col("least").alias("b")))
    return moved.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges a > b are stars: whoever is above a node has that edge alone. One grouping in place of a round that changes nothing."""
    ends = edges.select(F.col("a").alias("end"), F.lit(1).alias("above")).unionByName(edges.select(F.col("b").alias("end"), F.lit(0).alias("above")))
    return ends.groupBy("end").agg(F.max("above").alias("above"), F.count(F.lit(1)).alias("n")).where("above = 1 and n > 1").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of `edges` (a, b); the component is its least node."""
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = kept(now, "edges")
    for _ in range(rounds):
        if _settled(now):
            break
        after = kept(_star(_star(now, True), False), "edges")
        dropped(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
