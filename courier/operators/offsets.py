"""Committed offsets: latest wins, lag, snapshots, compaction."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import le64
from ..model import struct as struct_of

GROUP = ["group", "topic", "partition"]


def latest(commits: DataFrame, keys: list[str] = GROUP, order: str = "ord") -> DataFrame:
    """The last commit of each key, even if it is lower; negative offsets count as 0."""
    return commits.groupBy(*keys).agg(F.max_by(F.greatest(F.col("offset"), F.lit(0)), order).alias("committed"))


def fetch_committed(requests: DataFrame, committed: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """-1 where nothing is committed."""
    return requests.join(committed, keys, "left").withColumn("committed", F.coalesce("committed", F.lit(-1)))


def lag(committed: DataFrame, log_bounds: DataFrame, keys: list[str]) -> DataFrame:
    """How far each group is behind the end of each partition; a group without a commit is behind by all of it."""
    return log_bounds.join(committed, keys, "left").withColumn("lag", F.col("latest") - F.coalesce("committed", F.lit(0)))


def beyond_tail(commits: DataFrame, log_bounds: DataFrame, keys: list[str]) -> Column | DataFrame:
    """Commits that the log's end refuses."""
    return commits.join(log_bounds, keys, "left").where(F.col("offset") > F.coalesce("latest", F.lit(0)))


def restore(current: DataFrame, snapshot: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """The state with the snapshot's groups put back; a null committed offset removes the key."""
    kept = current.join(snapshot.select(*keys), keys, "left_anti")
    return kept.unionByName(snapshot.where("committed is not null"))


def compaction_due(commits: DataFrame, keys: list[str] = GROUP, least: int = 1024, ratio: int = 4) -> DataFrame:
    """Whether the log of commits is worth rewriting: enough records, and more than `ratio` for each live key."""
    return commits.agg(F.count("*").alias("records"), F.countDistinct(*keys).alias("live")).withColumn("due", (F.col("records") >= least) & (F.col("records") > ratio * F.col("live")))


def compacted(commits: DataFrame, keys: list[str] = GROUP, order: str = "ord") -> DataFrame:
    """The commits that still count, one for each key, in the form of a log of commits."""
    return commits.groupBy(*keys).agg(F.max_by("offset", order).alias("offset"), F.max(order).alias(order)).select(*commits.columns)


def compact(spark: SparkSession, path: str, keys: list[str] = GROUP, order: str = "ord") -> None:
    """Rewrite a folder of commits. The new one is written whole beside it and takes its place by renames; after a stop
    between these, `opened` finds the old folder."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(at(f"{path}.new"), True)
    compacted(spark.read.parquet(path), keys, order).write.parquet(f"{path}.new")
    fs.delete(at(f"{path}.old"), True)
    if not (fs.rename(at(path), at(f"{path}.old")) and fs.rename(at(f"{path}.new"), at(path))):
        raise OSError(f"could not replace {path}")
    fs.delete(at(f"{path}.old"), True)


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The folder of commits, put back first if a compaction stopped between its renames."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at(path)) and fs.exists(at(f"{path}.old")):
        fs.rename(at(f"{path}.old"), at(path))
    return spark.read.parquet(path)


def snapshot(names: DataFrame, committed: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """The named keys with what is committed, null where nothing is: what `restore` takes."""
    return names.join(committed, keys, "left")


def record_bytes(group: Column, topic: Column, partition: Column, offset: Column) -> Column:
    """A commit as bytes: group and topic with their lengths, the partition, the offset."""
    text = lambda c: F.concat(F.substring(le64(F.octet_length(c)), 1, 4), F.encode(c, "UTF-8"))
    return F.concat(text(group), text(topic), F.substring(le64(partition), 1, 4), le64(offset))


def parse_record(data: bytes | None) -> tuple[str, str, int, int] | None:
    """(group, topic, partition, offset); None if bytes are missing or left over, or a name isn't text."""
    if data is None:
        return None
    at, names = 0, []
    try:
        for _ in range(2):
            (size,) = struct.unpack_from("<I", data, at)
            if at + 4 + size > len(data):
                return None
            names.append(data[at + 4 : at + 4 + size].decode())
            at += 4 + size
        return (*names, *struct.unpack_from("<iq", data, at)) if at + 12 == len(data) else None
    except (struct.error, UnicodeDecodeError):
        return None


@F.pandas_udf(struct_of("group string, topic string, partition int, offset long"))
def parsed(records: pd.Series) -> pd.DataFrame:
    """Commits of their bytes; all fields are null for malformed ones."""
    rows = [parse_record(None if r is None else bytes(r)) or (None,) * 4 for r in records]
    return pd.DataFrame(rows, columns=["group", "topic", "partition", "offset"]).astype({"partition": "Int32", "offset": "Int64"})
