"""Order numbers, running sums and medians by ranges: rows are sorted once, a range a task, and only a total a range meets elsewhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, order: list[str], value: str | None, name: str) -> DataFrame:
    """`rows` with `name`: the sum of `value` (a whole number; None counts rows) over the rows before, in `order` (nulls first).

    Rows that are equal in `order` come in some order; give it a unique end where that matters.
    """
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    place = rows.columns.index(value) if value else None

    def local(batches):
        before = 0
        for batch in batches:
            v = np.ones(batch.num_rows, np.int64) if place is None else batch.column(place).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = before + np.cumsum(v)
            before = int(sums[-1]) if len(sums) else before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums - v), pa.array(v)], [*batch.schema.names, "_before", "_own"])

    in_order = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    summed = in_order.mapInArrow(local, f"{kind}, _before long, _own long").withColumn("_range", F.spark_partition_id()).persist()
    totals = summed.groupBy("_range").agg(F.sum("_own").alias("_total"))  # a row a range
    shift = F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(F.col("_range").alias("_of"), shift.alias("_shift"))
    return summed.join(F.broadcast(starts), F.col("_range") == F.col("_of")).select(*rows.columns, (F.col("_before") + F.col("_shift")).alias(name))


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """`rows` with their number in `order`, from 1."""
    return running(rows, order, None, name).withColumn(name, F.col(name) + 1)


def medians(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """by, n, median of the values that are not null: exact, by counts of distinct values and their running sums."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_k"))
    placed = running(counts, [*by, "_value"], "_k", "_at")
    groups = placed.groupBy(*by).agg(F.min("_at").alias("_start"), F.sum("_k").alias("n")).select(*[F.col(b).alias(f"_{b}") for b in by], "_start", "n")
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_{b}"))
    met = placed.join(groups, on) if by else placed.crossJoin(groups)  # without groups that is one row
    at = F.col("_at") - F.col("_start")
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    held = lambda p: (at <= p) & (p < at + F.col("_k"))
    middle = met.where(held(low) | held(high))
    return middle.groupBy(*by, "n").agg(((F.min("_value") + F.max("_value")) / 2).alias("median"))
