"""Positions and running totals within a key that stay parallel when one key holds most rows.

A window over a key sorts all its rows in one task. Here a key's rows are first cut into ranges of the ordering
number; each (key, range) is numbered by itself, and a prefix sum over the ranges, one row for each, joins the parts.

Ranges have a fixed width for numbers that are dense, as offsets and arrivals are. For others, such as times and measured
values, they lie between quantiles of the key's own rows. Rows with equal numbers are always in one range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

WIDTH = 1 << 16
#: Ranges between quantiles are 2^BITS for a key.
BITS = 10
SALTS = 64


def same_keys(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join by the keys, where nulls are equal; the keys once."""
    named = other.withColumnsRenamed({k: f"__r{i}" for i, k in enumerate(keys)})
    return df.join(named, reduce(Column.__and__, [df[f"`{k}`"].eqNullSafe(named[f"__r{i}"]) for i, k in enumerate(keys)])).drop(*[f"__r{i}" for i in range(len(keys))])


def quantile_ranges(df: DataFrame, keys: list[str], order: str, bits: int = BITS) -> DataFrame:
    """The rows with `__range`, from 0 on: how many of the 2^bits - 1 quantiles of the key's numbers are at most the row's.

    The quantiles are estimates, so ranges are only about equal in size, but any cuts keep the order.
    """
    parts = 1 << bits
    cuts = df.groupBy(*keys).agg(F.array_sort(F.percentile_approx(order, [i / parts for i in range(1, parts)], 4 * parts)).alias("__cuts"))
    steps = F.lit([1 << i for i in reversed(range(bits))])
    at = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get("__cuts", n + step - 1) <= F.col(order), n + step).otherwise(n))
    return same_keys(df, cuts, keys).withColumn("__range", at.cast("long")).drop("__cuts")


def _ranges(df: DataFrame, keys: list[str], order: str, width: int | None) -> DataFrame:
    if width is None:
        return quantile_ranges(df, keys, order)
    return df.withColumn("__range", F.floor(F.col(order) / F.lit(width)).cast("long"))


def _before(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)


def running_total(df: DataFrame, keys: list[str], order: str, value: Column, name: str, ties: list[str] | None = None, width: int | None = WIDTH) -> DataFrame:
    """The sum of `value` over the rows of the key that come earlier, 0 for the first.

    order: a number column; rows with equal numbers are ordered by `ties`. width: None for numbers that aren't dense.
    """
    cut = _ranges(df.withColumn("__value", value), keys, order, width)
    sums = cut.groupBy(*keys, "__range").agg(F.sum("__value").alias("__sum"))
    starts = sums.select(*keys, "__range", F.coalesce(F.sum("__sum").over(_before(keys)), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*keys, "__range").orderBy(order, *(ties or [])).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumn("__own", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    return own.join(starts, [*keys, "__range"]).withColumn(name, (F.col("__start") + F.col("__own")).cast("long")).drop("__range", "__value", "__start", "__own")


def positions(df: DataFrame, keys: list[str], order: str, name: str = "offset", ties: list[str] | None = None, width: int | None = WIDTH) -> DataFrame:
    """Gapless positions from 0 within each key."""
    return running_total(df, keys, order, F.lit(1).cast("long"), name, ties, width)


def newest(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The n rows of each key with the largest order numbers: first of each of some parts of the key, then of these."""
    last = lambda *part: F.row_number().over(Window.partitionBy(*keys, *part).orderBy(F.col(order).desc()))
    few = df.withColumn("__part", F.pmod(F.xxhash64(order), F.lit(SALTS))).withColumn("__n", last("__part")).where(F.col("__n") <= n)
    return few.withColumn("__n", last()).where(F.col("__n") <= n).drop("__n", "__part")
