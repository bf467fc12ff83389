"""Stratified samples that rerun alike: allocation by largest remainder, draws by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def allocate(sizes: DataFrame, stratum: str, size: str, n: int) -> DataFrame:
    """stratum, size, allotted: proportional to size, remainders to the largest (ties by name); too few raise.

    Strata are few next to rows; their one-task window sees a row a stratum.
    """
    everything = Window.partitionBy(F.lit(1))
    total = F.sum(size).over(everything)
    quota = F.lit(n) * F.col(size) / total
    base = sizes.select(F.col(stratum).alias("stratum"), F.col(size).alias("size"), F.when(total < n, F.raise_error(F.lit("the frame is smaller than the sample"))).otherwise(F.floor(quota)).alias("whole"), (quota - F.floor(quota)).alias("rest"))
    left = F.lit(n) - F.sum("whole").over(everything)
    rank = F.row_number().over(Window.orderBy(F.desc("rest"), "stratum"))
    return base.select("stratum", "size", (F.col("whole") + (rank <= left).cast("long")).alias("allotted"))


SEED = 20260927


def draw(frame: DataFrame, stratum: str, key: str, n: int, seed: int = SEED) -> DataFrame:
    """About-proportional sample of `frame`, all of a stratum where its share is its size.

    A draw is the least hashes of a stratum. Hash ranges that cannot hold the draw
    are cut off first, by counts, so that no stratum is sorted whole in one task.
    """
    sizes = frame.groupBy(stratum).agg(F.count(F.lit(1)).alias("n_rows"))
    return _least(frame, stratum, key, allocate(sizes, stratum, "n_rows", n).select(F.col("stratum").alias("of_stratum"), "allotted"), seed)


def draw_each(frame: DataFrame, stratum: str, key: str, counts: dict[str, int], seed: int = SEED) -> DataFrame:
    """So many rows of each named stratum, all of one that has no more."""
    return _least(frame, stratum, key, frame.sparkSession.createDataFrame(list(counts.items()), "of_stratum string, allotted long"), seed)


def _least(frame: DataFrame, stratum: str, key: str, shares: DataFrame, seed: int) -> DataFrame:
    turn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")
    rows = frame.withColumn("turn", turn).withColumn("bin", F.shiftright("turn", 48))
    bins = rows.groupBy(stratum, "bin").agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.partitionBy(stratum).orderBy("bin")) - F.col("k")
    last = bins.withColumn("before", upto).join(F.broadcast(shares), F.col(stratum) == F.col("of_stratum")).where(F.col("before") < F.col("allotted")).groupBy("of_stratum", "allotted").agg(F.max("bin").alias("last_bin"))
    near = rows.join(F.broadcast(last), (F.col(stratum) == F.col("of_stratum")) & (F.col("bin") <= F.col("last_bin")))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("turn", key))
    return near.withColumn("rank", rank).where(F.col("rank") <= F.col("allotted")).select(*frame.columns)
