"""Running sums over an explicit ordinal, without a single task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import once

#: Ranges of ordinals with about the same number of rows each, and how many of these are looked up at a time.
RANGES, STEP = 4096, 64


def in_ranges(df: DataFrame, ordinal: str, out: str = "_part") -> DataFrame:
    """df with the number of the range that each row's ordinal is in.

    The bounds are quantiles of the ordinals, so ranges have like numbers of rows wherever the ordinals lie, and one row of
    them is broadcast. A row finds its range in two steps, among every STEP-th bound and then between two of these.
    """
    shares = F.split(F.lit(",".join(str(i / RANGES) for i in range(1, RANGES))), ",").cast("array<double>")
    bounds = df.agg(F.array_distinct(F.percentile_approx(F.col(ordinal).cast("long"), shares, F.lit(10 * RANGES))).alias("_b"))
    bounds = bounds.select("_b", F.filter("_b", lambda b, i: i % STEP == STEP - 1).alias("_top"))

    def found(o: Column) -> Column:
        under = lambda x: F.size(F.filter(x, lambda b: b < o))
        return once(under(F.col("_top")), lambda k: k * STEP + under(F.slice("_b", k * STEP + 1, F.lit(STEP))))

    return df.crossJoin(F.broadcast(bounds)).withColumn(out, F.coalesce(found(F.col(ordinal).cast("long")), F.lit(0))).drop("_b", "_top")


def prefix_sum(df: DataFrame, value: str, ordinal: str, by: tuple[str, ...] = (), end: str = "end") -> DataFrame:
    """df with the running sum of a non-negative integer column in order of a unique integer ordinal, within the groups `by`.

    Ranges of the ordinal are summed first, then the few range sums, then the rows within each range, so a group of any size is
    spread over tasks. Only ordinals and values are sorted; further columns are joined to the sums after that. Null values
    count as 0; the running sum includes the row.
    """
    keys = [*by, ordinal]
    slim = in_ranges(df.select(*dict.fromkeys([*keys, value])), ordinal)
    v = F.coalesce(F.col(value), F.lit(0)).cast("long")
    sums = slim.groupBy(*by, "_part").agg(F.sum(v).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*by, "_part").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    on = F.col("_part") == F.col("_p")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    ends = slim.withColumn("_in", F.sum(v).over(within)).join(sums, on).withColumn(end, F.col("_before") + F.col("_in"))
    if set(df.columns) <= {*keys, value}:
        return ends.select(*df.columns, end)
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], end)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(ends, same).drop(*[f"_k{i}" for i in range(len(keys))])


def rank(df: DataFrame, ordinal: str, by: tuple[str, ...] = (), out: str = "rank") -> DataFrame:
    """df with the row's number from 1 in order of the ordinal."""
    return prefix_sum(df.withColumn("_one", F.lit(1)), "_one", ordinal, by, out).drop("_one")


def hashed(seed: int, *cols):
    """A hash of columns and a seed that no partitioning changes: the draw of random operators."""
    return F.xxhash64(F.lit(seed), *cols)
