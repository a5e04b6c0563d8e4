"""Tallies, rates, nearest-rank percentiles and link traces."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranking import same_keys

PERMILLES = {"p50": 500, "p90": 900, "p99": 990, "p999": 999}


def nearest_rank(samples: DataFrame, by: list[str], value: str, permilles: dict[str, int] | None = None, accuracy: int = 10_000) -> DataFrame:
    """The sample at place floor((n - 1) * permille / 1000) of each group, with the maximum and the count.

    Equal samples are counted first. Estimated quantiles a little before and after each place cut a group's values into
    ranges; the exact counts of the ranges tell which of them hold the places, and only the values of these are ranked, each
    range by itself: some n / accuracy of them. Any estimates give exact results; bad ones leave more to rank.
    Null samples take no part; a group without others has no row.
    """
    permilles = permilles or PERMILLES
    some = samples.where(F.col(value).isNotNull())
    around = sorted({min(1.0, max(0.0, p / 1000 + side / accuracy)) for p in permilles.values() for side in (-2, 2)})
    cuts = some.groupBy(*by).agg(F.percentile_approx(value, around, accuracy).alias("__cuts"))
    counts = some.groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    beyond = reduce(Column.__add__, [(F.get("__cuts", F.lit(i)) <= F.col("__v")).cast("int") for i in range(len(around))])
    ranged = same_keys(counts, cuts, by).withColumn("__range", beyond).drop("__cuts")
    group = Window.partitionBy(*by)
    spans = ranged.groupBy(*by, "__range").agg(F.sum("__n").alias("__in"), F.max("__v").alias("__top"))
    before = F.coalesce(F.sum("__in").over(group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(*by, "__range", "__in", before.alias("__before"), F.max("__top").over(group).alias("__top"), F.sum("__in").over(group).alias("__all"))
    at = lambda p: F.floor((F.col("__all") - 1) * p / 1000)
    holds = [(F.col("__before") <= at(p)) & (at(p) < F.col("__before") + F.col("__in")) for p in permilles.values()]
    few = same_keys(ranged, spans.where(reduce(Column.__or__, holds)).drop("__in"), [*by, "__range"])
    inside = Window.partitionBy(*by, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = few.withColumn("__upto", F.col("__before") + F.sum("__n").over(inside))
    picks = [F.min(F.when(F.col("__upto") > at(p), F.col("__v"))).alias(name) for name, p in permilles.items()]
    return ranked.groupBy(*by).agg(*picks, F.max("__top").alias("max"), F.max("__all").alias("count"))


def tally(dispositions: DataFrame, by: list[str], offered: str | None = None) -> DataFrame:
    """Counts of each disposition; with the number offered, also how many were lost."""
    kinds = {"delivered": "Delivered", "duplicate": "Duplicate", "dead": "DeadLettered"}
    out = dispositions.groupBy(*by).agg(*[F.count_if(F.col("disposition") == k).alias(n) for n, k in kinds.items()], *([F.max(offered).alias("offered")] if offered else []))
    return out.withColumn("lost", F.col("offered") - F.col("delivered") - F.col("dead")) if offered else out


def rate(totals: DataFrame, count: str = "records", millis: str = "ms") -> DataFrame:
    """Whole records a second; 0 for no time."""
    return totals.withColumn("per_second", F.when(F.col(millis) > 0, F.expr(f"({count} * 1000) div {millis}")).otherwise(F.lit(0).cast("long")))


def window_trace(rtts: DataFrame, first: float = 10.0, least: float = 1.0, most: float = 4096.0, queue_ms: float = 10.0, grow: float = 1.0, shrink: float = 0.85) -> DataFrame:
    """Per link (link, ord, rtt_ms): the least round trip so far and the window of a delay-based controller.

    The window grows by a step while the delay above the least round trip is within `queue_ms`, else shrinks by a factor.
    """
    schema = rtts.select("link", "ord", "rtt_ms").schema.add("base_ms", "double").add("window", "double")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, base, size = object(), float("inf"), first
        for part in parts:
            out = []
            for link, rtt in zip(part["link"], part["rtt_ms"]):
                if link != now:
                    now, base, size = link, float("inf"), min(most, max(least, first))
                base = min(base, rtt)
                size = max(least, size * shrink) if rtt - base > queue_ms else min(most, size + grow)
                out.append((base, size))
            yield part.assign(base_ms=[o[0] for o in out], window=[o[1] for o in out])

    return rtts.select("link", "ord", "rtt_ms").repartition("link").sortWithinPartitions("link", "ord").mapInPandas(run, schema)


def bench_summary(results: DataFrame) -> DataFrame:
    """Means of benchmark result files read as JSON: rates, megabytes a second, latencies; missing fields count as 0.

    results: driver, workload, messageSize, publishRate array, consumeRate array, and latencies, as far as they are there.
    """
    kinds = dict(results.dtypes)
    mean = lambda c: F.coalesce(F.aggregate(F.filter(c, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x, lambda a: F.when(F.size(F.filter(c, lambda x: x.isNotNull())) > 0, a / F.size(F.filter(c, lambda x: x.isNotNull())))), F.lit(0.0)) if c in kinds else F.lit(0.0)
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in kinds else F.lit(0.0)
    name = F.coalesce(*[F.col(c) for c in ("driver", "workload") if c in kinds], F.lit("?"))
    out = results.select(name.alias("system"), mean("publishRate").alias("publish_rate"), number("messageSize").alias("__size"), mean("consumeRate").alias("consume_rate"), *[number(f"aggregatedEndToEndLatency{p}pct").alias(f"p{p}") for p in (50, 99, 999)])
    return out.withColumn("publish_mb", F.col("publish_rate") * F.col("__size") / 1e6).drop("__size")


def resource_summary(samples: DataFrame) -> DataFrame:
    """Memory and CPU of each system (system, phase, rss_mb, cpu_pct): idle, and under load on average and at most."""
    load = F.col("phase") == "load"
    return samples.groupBy("system").agg(
        F.avg(F.when(F.col("phase") == "idle", F.col("rss_mb"))).alias("idle_rss_mb"), F.avg(F.when(load, F.col("rss_mb"))).alias("load_rss_mb_avg"),
        F.max(F.when(load, F.col("rss_mb"))).alias("load_rss_mb_max"), F.avg(F.when(load, F.col("cpu_pct"))).alias("load_cpu_pct"),
    )


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other; empty for equal outputs."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def fan_out(records: DataFrame, subscribers: DataFrame, topic: str = "topic") -> DataFrame:
    """A copy of each record for every subscriber of its topic."""
    return records.join(subscribers, topic)


def batched(records: DataFrame, keys: list[str], at: str, count: int, micros: int) -> DataFrame:
    """Records with the batch that takes them: one closes when it has `count` records, or when a record comes `micros` after its first.

    Where a batch begins depends on the one before, so a key's records are folded in order, with a state of three numbers.
    """
    schema = records.schema.add("batch", "long")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, began, held, batch = None, 0, 0, 0
        for part in parts:
            out = []
            for key, t in zip(part[keys].itertuples(index=False, name=None), part[at]):
                if key != now:
                    now, began, held, batch = key, t, 0, 0
                elif held >= count or t - began >= micros:
                    began, held, batch = t, 0, batch + 1
                held += 1
                out.append(batch)
            yield part.assign(batch=out)

    return records.repartition(*keys).sortWithinPartitions(*keys, at).mapInPandas(run, schema)
