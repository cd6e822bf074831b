"""Order statistics at scale: selection by refining histograms, rank sums by ranges with prefix offsets, quantiles from value counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.workspace import materialise

#: Buckets of a histogram; a pass over the data narrows the value down to one of them.
BUCKETS = 1_024


def value_at(df: DataFrame, column: str, share: float) -> float | None:
    """The smallest value of ``column`` that at least ``share`` of its values do not exceed (a discrete percentile), or None.

    Each pass counts the values of an interval in buckets of equal width, which aggregate before they are shuffled, and goes on in the bucket that
    holds the rank, from its least to its greatest value. Doubles are through after a few passes; no task sorts anything. Nulls and NaN do not count.
    """
    values = df.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    low, high, n = values.agg(F.min("x"), F.max("x"), F.count("x")).first()
    rank = max(1, math.ceil(share * n))
    while n and low < high:
        middle = low / 2 + high / 2
        width = high / BUCKETS - low / BUCKETS
        inside = values.where(F.col("x").between(low, high))
        # Where the interval is too narrow (or wide) to be divided, its halves are told apart by comparison.
        even = F.least(F.lit(BUCKETS - 1), F.floor((F.col("x") - low) / width)) if width > 0 and math.isfinite(high - low) else (F.col("x") > min(middle, math.nextafter(high, low))).cast("long")
        counts = inside.groupBy(even.alias("bucket")).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("bucket").collect()
        for b in counts:
            if rank <= b.n:
                low, high, n = b.low, b.high, b.n
                break
            rank -= b.n
    return low


def with_prefix(df: DataFrame, order: str, value: str, into: str) -> DataFrame:
    """Adds ``into``: the sum of ``value`` over all rows with a smaller ``order``; rows are distinct in ``order``.

    Rows are dealt to ranges of ``order``; a range's rows add up what lies before them inside it, and the sum of the ranges before, of which there are
    as many as partitions. Ranges are found by sampling, so they are written before they are read twice.
    """
    ranged = materialise(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = sorted(ranged.groupBy("_range").agg(F.sum(value).alias("n")).collect())
    offsets, before = [], 0
    for number, n in totals:
        offsets.append((number, before))
        before += n or 0
    kind = ranged.select(F.sum(value)).schema[0].dataType.simpleString()
    known = F.broadcast(df.sparkSession.createDataFrame(offsets, f"_range int, _offset {kind}"))  # one row for each partition
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.join(known, "_range").withColumn(into, F.col("_offset") + F.coalesce(inside, F.lit(0))).drop("_range", "_offset")


def group_percentiles(df: DataFrame, by: list[Column], value: str, shares: dict[str, float]) -> DataFrame:
    """``by``, n, mean and for each name of ``shares`` the group's discrete percentile of ``value``.

    Values are counted first, so what a group orders is its distinct values, not its rows.
    """
    names = [df.select(c).columns[0] for c in by]
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*names)
    upto = counts.withColumn("_upto", F.sum("_n").over(group.orderBy("_v"))).withColumn("n", F.sum("_n").over(group))
    found = [F.min(F.when(F.col("_upto") >= F.ceil(F.col("n") * share), F.col("_v"))).alias(name) for name, share in shares.items()]
    return upto.groupBy(*names).agg(F.sum("_n").alias("n"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"), *found)
