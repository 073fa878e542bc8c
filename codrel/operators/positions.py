"""Dense positions and running aggregates without moving all rows to one task."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POS = "_pos"
#: Up to so many rows one window in one task is cheaper than buckets; it is also the size of a bucket.
ONE_WINDOW = ROWS_PER_BUCKET = 500_000
#: Sampled keys for each bucket.
DRAWS = 32
RUN = 65_536


def with_positions(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``_pos``, 0 to n - 1 in ascending ``order`` (nulls first).

    Rows fall into buckets at sampled quantiles of all order columns together, are numbered within
    their bucket, and are shifted by the rows of the buckets before: one shuffle, and one row
    a bucket on the driver. Rows that tie in every order column may be numbered in any order.
    """
    n = df.count()
    by = [F.col(c).asc_nulls_first() for c in order]
    if n <= ONE_WINDOW:
        return df.withColumn(POS, (F.row_number().over(Window.orderBy(*by)) - 1).cast("long"))
    buckets = -(-n // ROWS_PER_BUCKET)
    key = F.struct(*(F.col(c) for c in order))
    kind = df.select(key.alias("k")).schema["k"].dataType
    sample = df.select(key.alias("k")).sample(min(1.0, DRAWS * buckets / n), seed=7).distinct().orderBy("k").collect()
    step = max(1, len(sample) // buckets)
    splits = [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r["k"], kind.fields, strict=True))) for r in sample[step::step]]
    # Two levels of splitters, so that a row is compared with two short lists.
    wide = max(1, math.isqrt(len(splits)))
    groups = [splits[i : i + wide] for i in range(0, len(splits), wide)]
    count = lambda of: F.size(F.filter(of, lambda s: s <= key))
    group = count(F.array(*(g[0] for g in groups)))
    within = F.when(group > 0, (group - 1) * wide + count(F.get(F.array(*(F.array(*g) for g in groups)), group - 1)))
    placed = df.withColumn("_bucket", F.coalesce(within, F.lit(0)) if splits else F.lit(0))
    sizes = sorted((r["_bucket"], r["count"]) for r in placed.groupBy("_bucket").count().collect())
    before, total = [], 0
    for b, rows in sizes:
        before.append((b, total))
        total += rows
    shifts = df.sparkSession.createDataFrame(before, "_bucket int, _before long")
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(*by))
    return placed.withColumn("_row", own).join(F.broadcast(shifts), "_bucket").withColumn(POS, F.col("_before") + F.col("_row") - 1).drop("_bucket", "_row", "_before")


_AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "and": F.bool_and, "or": F.bool_or}


def combine(op: str, a: Column, b: Column) -> Column:
    """``a`` and ``b`` under the operation; a null stands for nothing."""
    both = {"sum": a + b, "count": a + b, "min": F.least(a, b), "max": F.greatest(a, b), "and": a & b, "or": a | b}[op]
    return F.coalesce(both, a, b)


def running(df: DataFrame, op: str, value: Column, out: str, reverse: bool = False, exclusive: bool = False) -> DataFrame:
    """Adds the running aggregate of ``value`` in order of ``_pos``: within runs of positions, shifted by the totals of the runs before."""
    agg = _AGGREGATES[op]
    run = F.floor(F.col(POS) / RUN)
    rows = df.withColumns({"_run": run, "_value": value})
    totals = rows.groupBy("_run").agg(agg("_value").alias("_total"))
    direction = F.col("_run").desc() if reverse else F.col("_run").asc()
    earlier = Window.orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)  # one row a run
    again = F.sum if op == "count" else agg
    shifts = totals.select("_run", again("_total").over(earlier).alias("_shift"))
    order = F.col(POS).desc() if reverse else F.col(POS).asc()
    frame = Window.partitionBy("_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    return rows.withColumn("_own", agg("_value").over(frame)).join(shifts, "_run").withColumn(out, combine(op, F.col("_shift"), F.col("_own"))).drop("_run", "_value", "_own", "_shift")


def all_equal(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, (p.eqNullSafe(q) for p, q in zip(a, b, strict=True)), F.lit(True))
