"""Partition logs: offsets, fetches, replay, bounds, segments, recovery and tiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .ranking import positions, running_total

LOG = ["topic", "partition"]


def assign_offsets(records: DataFrame, keys: list[str] = LOG, arrival: str = "arrival", base: DataFrame | None = None) -> DataFrame:
    """Contiguous offsets in order of arrival; base: (keys, next_offset) of logs that exist already."""
    out = positions(records, keys, arrival, "offset")
    if base is None:
        return out
    known = base.select(*keys, F.col("next_offset").alias("__base"))
    return out.join(known, keys, "left").withColumn("offset", F.col("offset") + F.coalesce("__base", F.lit(0))).drop("__base")


def fetch(log: DataFrame, start: int, cap: int, keys: list[str] = LOG, value: str = "value") -> DataFrame:
    """Records from an offset on, until the bytes reach the cap; the record that reaches it is included, one at least."""
    rest = log.where((F.col("offset") >= start) & (F.lit(start) >= 0))
    sized = running_total(rest, keys, "offset", F.octet_length(F.col(value).cast("binary")).cast("long"), "bytes_before")
    return sized.where(F.col("bytes_before") < max(cap, 1))


def bounds(log: DataFrame, keys: list[str] = LOG) -> DataFrame:
    return log.groupBy(*keys).agg(F.lit(0).cast("long").alias("earliest"), F.count("*").alias("latest"))


def list_offsets(requests: DataFrame, log_bounds: DataFrame, keys: list[str] = LOG) -> DataFrame:
    """-2 asks for the earliest offset; any other time for the latest."""
    return requests.join(log_bounds, keys, "left").withColumn("offset", F.when(F.col("time") == -2, F.coalesce("earliest", F.lit(0))).otherwise(F.coalesce("latest", F.lit(0)))).drop("earliest", "latest")


def parse_range(text: str, length: int) -> tuple[int, int]:
    """`all`, `a..b` or `a..=b` as a half-open range within 0..length; anything else is an error."""
    if text == "all":
        return 0, length
    m = re.fullmatch(r"(\d+)\.\.(=?)(\d+)", text)
    if not m:
        raise ValueError(f"not a range: {text!r}")
    a, b = int(m[1]), int(m[3]) + bool(m[2])
    if a > b or b > length:
        raise ValueError(f"range {text} does not lie within 0..{length}")
    return a, b


def replay(records: DataFrame, text: str, position: str = "pos") -> DataFrame:
    a, b = parse_range(text, records.count())
    return records.where((F.col(position) >= a) & (F.col(position) < b))


def as_of(events: DataFrame, starts: DataFrame, keys: list[str], at: str, start: str) -> DataFrame:
    """For each event the greatest start at or below its position: a backward as-of join.

    One pass over the union of both sides; a start sorts before the events at its place. For keys with very many
    rows the range of positions is part of the key, and a start is handed on to the ranges that have none before it.
    """
    width = 1 << 16
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    left = events.withColumn("__b", bucket(at)).withColumn("__s", F.lit(None).cast("long")).withColumn("__at", F.col(at).cast("long"))
    right = starts.select(*keys, F.col(start).cast("long").alias("__s"), bucket(start).alias("__b"), F.col(start).cast("long").alias("__at"))
    # the last start of each range, and from it the last start of all earlier ranges that rows need
    last = right.groupBy(*keys, "__b").agg(F.max("__s").alias("__last"))
    needed = left.select(*keys, "__b").unionByName(last.select(*keys, "__b")).distinct()
    handed = needed.join(last, [*keys, "__b"], "left").withColumn("__carry", F.max("__last").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).drop("__last")
    both = left.unionByName(right, allowMissingColumns=True).withColumn("__event", F.col(at).isNotNull().cast("int"))
    inside = Window.partitionBy(*keys, "__b").orderBy("__at", "__event").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__here", F.max("__s").over(inside)).where("__event = 1")
    return found.join(handed, [*keys, "__b"], "left").withColumn(f"{start}_of", F.coalesce("__here", "__carry")).drop("__b", "__s", "__at", "__event", "__here", "__carry")


def until_bad(frames: DataFrame, keys: list[str], order: str, bad: Column) -> DataFrame:
    """The longest good prefix of each key: what recovery keeps, and what a fetch returns before a corrupt record."""
    first = frames.where(bad).groupBy(*keys).agg(F.min(order).alias("__bad"))
    return frames.join(first, keys, "left").where(F.col("__bad").isNull() | (F.col(order) < F.col("__bad"))).drop("__bad")


def fetch_status(frames: DataFrame, keys: list[str], order: str, bad: Column) -> DataFrame:
    """Error 2 if the first requested record is corrupt, else 0 and the number of records before the first corrupt one."""
    per = frames.groupBy(*keys).agg(F.min(order).alias("first"), F.min(F.when(bad, F.col(order))).alias("bad_at"), F.count("*").alias("n"))
    good = frames.join(per, keys).groupBy(*keys).agg(F.count_if(F.col("bad_at").isNull() | (F.col(order) < F.col("bad_at"))).alias("records"))
    return per.join(good, keys).select(*keys, F.when(F.col("bad_at") == F.col("first"), 2).otherwise(0).alias("error"), "records")


def truncate(log: DataFrame, offset: int) -> DataFrame:
    return log.where(F.col("offset") < offset)


def rotate(log: DataFrame, limit: int, keys: list[str] = LOG, value: str = "value", overhead: int = 8) -> DataFrame:
    """Segments: a new one begins before the append that finds the active one at the limit or above.

    The size of a segment depends on where it began, so a log is folded in order; logs are independent. Each batch
    of a log's rows comes with the state that the rows before it left, so no log is held in memory as a whole.
    """
    fields = [f for f in log.schema.fields if f.name != "segment"]
    schema = log.select(*[f.name for f in fields]).schema.add("segment", "long").add("byte_offset", "long")
    sized = log.select(*[f.name for f in fields]).withColumn("__size", F.octet_length(F.col(value).cast("binary")).cast("long") + overhead)
    dealt = sized.repartition(*keys).sortWithinPartitions(*keys, "offset")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at, begin = None, 0, 0
        for part in parts:
            segments, bytes_at = [], []
            for key, size in zip(part[keys].itertuples(index=False, name=None), part["__size"]):
                if key != now:
                    now, at, begin = key, 0, 0
                if at > begin and at - begin >= limit:
                    begin = at
                segments.append(begin)
                bytes_at.append(at)
                at += size
            yield part.drop(columns="__size").assign(segment=segments, byte_offset=bytes_at)

    return dealt.mapInPandas(run, schema)


def tiered(hot: DataFrame, cold: DataFrame, from_offset: int) -> DataFrame:
    """Hot and cold segments as one log; a record in both tiers counts once, from the hot one."""
    only_cold = cold.join(hot.select(*LOG, "offset"), [*LOG, "offset"], "left_anti")
    return hot.unionByName(only_cold).where(F.col("offset") >= from_offset)


def segment_starts(hot: DataFrame, cold: DataFrame, start: str = "segment") -> DataFrame:
    return hot.select(*LOG, start).union(cold.select(*LOG, start)).distinct()


def frame_boundary(offsets: DataFrame, frames: DataFrame, keys: list[str], at: str, start: str) -> DataFrame:
    """Offsets at which a frame begins."""
    return offsets.join(frames.select(*keys, F.col(start).alias(at)), [*keys, at], "left_semi")


def metadata(topics: DataFrame, partitions: int, broker: int = 0) -> DataFrame:
    return topics.select("topic", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))).alias("partition"), F.lit(broker).alias("leader"))


def partition_dir(topic: Column, partition: Column) -> Column:
    return F.concat(F.lower(F.hex(F.encode(topic, "UTF-8"))), F.lit("-"), partition.cast("string"))


def end_offset(log: DataFrame, keys: list[str] = LOG, value: str = "value", overhead: int = 8) -> DataFrame:
    """Where the next frame of each log begins: the bytes of all its frames."""
    return log.groupBy(*keys).agg(F.sum(F.octet_length(F.col(value).cast("binary")).cast("long") + overhead).alias("end"))


def read_from(segments: DataFrame, cursor: int, most: int, at: str = "byte_offset") -> DataFrame:
    """The next frames of a log of segments from a cursor on, across the ends of segments; the cursor must be where a frame begins."""
    return segments.where(F.col(at) >= cursor).orderBy(at).limit(most)


def seal_and_rotate(spark: SparkSession, hot: str, cold: str, before: int) -> None:
    """Move records below an offset from the hot folder to the cold one: first the cold copy, then the new hot folder in
    the old one's place. Stopped in between, records are in both tiers, and `tiered` counts them once."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(hot).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = spark.read.parquet(hot)
    done = spark.read.parquet(cold).select(*LOG, "offset") if fs.exists(at(cold)) else None
    moved = rows.where(F.col("offset") < before)
    (moved.join(done, [*LOG, "offset"], "left_anti") if done is not None else moved).write.mode("append").parquet(cold)
    fs.delete(at(f"{hot}.new"), True)
    rows.where(F.col("offset") >= before).write.parquet(f"{hot}.new")
    fs.delete(at(f"{hot}.old"), True)
    if not (fs.rename(at(hot), at(f"{hot}.old")) and fs.rename(at(f"{hot}.new"), at(hot))):
        raise OSError(f"could not replace {hot}")
    fs.delete(at(f"{hot}.old"), True)


def link_faults(sends: DataFrame, keys: list[str], order: str, every: int) -> DataFrame:
    """A lossy link's sends, numbered; every so many-th is lost."""
    return positions(sends, keys, order, "nth").withColumn("lost", F.col("nth") % every == every - 1)


def retransmits(in_flight: DataFrame, now: Column, timeout: Column) -> DataFrame:
    """What a reliable sender sends again: blocks without an acknowledgement whose last try is a timeout old."""
    return in_flight.where(~F.col("acked") & (now - F.col("last_tx") >= timeout))


def object_names(names: DataFrame, name: str = "name") -> DataFrame:
    """Rows whose name is that of a stored envelope, stream/number.env, with both; others are skipped."""
    pattern = "^([0-9a-f]+)/([0-9]{20})[.]env$"
    return names.where(F.col(name).rlike(pattern)).withColumn("stream", F.regexp_extract(name, pattern, 1)).withColumn("seq", F.regexp_extract(name, pattern, 2).cast("long"))
