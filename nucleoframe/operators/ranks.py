"""Ranks, running sums and exact quantiles of groups of any size.

The groups that a task shouldn't sort, or hold, alone are found first: a job counts the rows of
the groups, and the keys of those with more than `at_once` reach the driver, the largest SHARES
at most, so that any other group is less than an even share. Where there is none, Spark's own
windows and percentiles do. Rows of the others are counted by value and cut into ranges of
values, between bounds that a hash picks among their values; a running sum is then that of the
range and the sums of the ranges before. So no task gets more than a range of a large group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

#: Rows of a group that one task sorts or holds.
AT_ONCE = 1 << 20
#: More groups than these aren't large beside all rows.
SHARES = 16_384
#: Ranges of a large group, about.
RANGES = 128


def large_groups(df: DataFrame, by=(), at_once: int = AT_ONCE) -> DataFrame | None:
    """The keys of the groups with more than `at_once` rows, as a local frame of at most SHARES rows,
    or None. Without `by` the frame is one group, of the key __all."""
    keys = list(by) or [F.lit(0).alias("__all")]
    counts = df.groupBy(*keys).agg(F.count("*").alias("__rows")).where(F.col("__rows") > at_once)
    found = counts.orderBy(F.desc("__rows")).limit(SHARES).drop("__rows")
    rows = found.collect()
    return df.sparkSession.createDataFrame(rows, found.schema) if rows else None


def distinct_counts(df: DataFrame, value: str, by=()) -> DataFrame:
    """(by, value, n): the values that are there, and how often."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))


def running(counts: DataFrame, value: str, by=(), n: str = "n", at_once: int = AT_ONCE) -> DataFrame:
    """The rows with `upto`, the sum of `n` of the group's values up to this one, and `whole`, that
    of all. A group has each value once."""
    large = large_groups(counts, by, at_once)
    keys = list(by) or ["__all"]
    held = counts if by else counts.withColumn("__all", F.lit(0))
    if large is None:  # no group has more than at_once rows
        group = W.partitionBy(*keys)
        return held.select(*counts.columns, F.sum(n).over(group.orderBy(value)).alias("upto"), F.sum(n).over(group).alias("whole"))
    return _in_ranges(held, large, value, keys, n).select(*counts.columns, "upto", "whole")


def _in_ranges(held: DataFrame, large: DataFrame, value: str, keys: list[str], n: str) -> DataFrame:
    """running() where groups are cut. The counted values, which several steps need, are written."""
    held = written(held, "ranks")
    sizes = held.join(F.broadcast(large), keys).groupBy(*keys).agg(F.count("*").alias("__d"))
    picked = held.join(F.broadcast(sizes), keys).where(F.pmod(F.xxhash64(value), F.ceil(F.col("__d") / RANGES)) == 0)
    bounds = picked.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("__bounds"))
    at = F.when(F.col("__bounds").isNotNull(), F.size(F.filter("__bounds", lambda b: b <= F.col(value)))).otherwise(0)
    located = held.join(F.broadcast(bounds), keys, "left").withColumns({"__cut": F.col("__bounds").isNotNull(), "__b": at}).drop("__bounds")
    ranges = located.where("__cut").groupBy(*keys, "__b").agg(F.sum(n).alias("__s"))
    group = W.partitionBy(*keys)
    earlier = group.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # as many rows as ranges
    shifts = ranges.select(*keys, "__b", F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__before"), F.sum("__s").over(group).alias("__of_all"))
    own = W.partitionBy(*keys, "__b")
    summed = located.withColumns({"__in": F.sum(n).over(own.orderBy(value)), "__sum": F.sum(n).over(own)})
    joined = summed.join(F.broadcast(shifts), [*keys, "__b"], "left")
    return joined.withColumns({"upto": F.col("__in") + F.coalesce("__before", F.lit(0)), "whole": F.coalesce("__of_all", "__sum")})


def at_rank(rank: Column, value: Column) -> Column:
    """Aggregate: the value of a rank, from 1, of rows with `upto`."""
    return F.min(F.when(F.col("upto") >= rank, value))


def interpolated(point: float, value: Column) -> Column:
    """Aggregate: the quantile between the two values next to it, linearly, of rows with upto and whole."""
    place = F.lit(point) * (F.col("whole") - 1)
    low, high = (at_rank(f(place) + 1, value) for f in (F.floor, F.ceil))
    part = F.max(place - F.floor(place))
    return F.when(part == 0, low).otherwise((1 - part) * low + part * high)


def quantiles(df: DataFrame, value: str, points: list[float], by=(), large: DataFrame | None | str = "find", at_once: int = AT_ONCE) -> DataFrame:
    """(by, q): the quantiles of each group's values, interpolated linearly, in an array of doubles;
    NULL for a group without values. Without `by` there is one row. `large` is what large_groups()
    found for these rows, or for more rows of the same groups."""
    if isinstance(large, str):
        large = large_groups(df, by, at_once)
    whole = F.percentile(F.col("__v"), points).alias("q")
    typed = df.select(*by, F.col(value).cast("double").alias("__v"))
    if large is None:
        return typed.groupBy(*by).agg(whole)
    keys = list(by) or ["__all"]
    typed = typed if by else typed.withColumn("__all", F.lit(0))
    small = typed.join(F.broadcast(large), keys, "left_anti").groupBy(*keys).agg(whole)
    counts = distinct_counts(typed.join(F.broadcast(large), keys, "left_semi"), "__v", keys)
    ranked = _in_ranges(counts, large, "__v", keys, "n").groupBy(*keys)
    cut = ranked.agg(F.array(*[interpolated(p, F.col("__v")) for p in points]).alias("q"))
    # a large group without values has no row yet
    cut = large.join(cut, keys, "left").select(*keys, "q")
    return small.unionByName(cut) if by else cut.drop("__all")
