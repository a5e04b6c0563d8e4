"""Exactly-once landing in a sink by a stored watermark for each stream."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .ranking import positions


def suffix(records: DataFrame, watermarks: DataFrame, stream: str = "stream", position: str = "pos") -> DataFrame:
    """Positional landing: the records of each stream past the stored watermark; all where none is stored."""
    known = watermarks.select(stream, F.col("watermark").alias("__wm"))
    return records.join(known, stream, "left").where(F.col(position) >= F.coalesce("__wm", F.lit(0))).drop("__wm")


def whole(batches: DataFrame, watermarks: DataFrame, stream: str = "stream", mark: str = "watermark") -> DataFrame:
    """Sequence landing: a batch lands as a whole if its watermark is above the stored one."""
    known = watermarks.select(stream, F.col("watermark").alias("__wm"))
    return batches.join(known, stream, "left").where(F.col("__wm").isNull() | (F.col(mark) > F.col("__wm"))).drop("__wm")


def upsert(watermarks: DataFrame, landed: DataFrame, stream: str = "stream") -> DataFrame:
    return watermarks.select(stream, "watermark").unionByName(landed.select(stream, "watermark")).groupBy(stream).agg(F.max("watermark").alias("watermark"))


def resume(streams: DataFrame, watermarks: DataFrame, stream: str = "stream") -> DataFrame:
    """Where each stream goes on: 0 if nothing is stored."""
    return streams.join(watermarks, stream, "left").select(stream, F.coalesce("watermark", F.lit(0)).alias("resume_at"))


def reserve(requests: DataFrame, keys: list[str], order: str, count: Column) -> DataFrame:
    """The base sequence that each request reserves in its partition."""
    from .ranking import running_total

    return running_total(requests, keys, order, count, "base")


class LandingTable:
    """Records and watermarks that become visible by one directory rename.

    A batch is written to a staging folder: its rows, with stream and watermark as columns, and beside them the highest
    watermark of each stream. Both are published by renaming the folder, so there is no second table to keep in step, and
    the stored watermarks are found without reading any rows. A store without atomic renames needs a table format in its place.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/data"))

    def _published(self, part: str) -> DataFrame | None:
        names = [f"{f.getPath().toString()}/{part}" for f in self._fs.listStatus(self._path(f"{self.path}/data"))]
        return self.spark.read.parquet(*names) if names else None

    def read(self) -> DataFrame | None:
        return self._published("rows")

    def watermarks(self) -> DataFrame:
        stored = self._published("marks")
        if stored is None:
            return self.spark.createDataFrame([], "stream string, watermark long")
        return stored.groupBy("stream").agg(F.max("watermark").alias("watermark"))

    def publish(self, rows: DataFrame) -> None:
        name = uuid.uuid4().hex
        staged = f"{self.path}/staging/{name}"
        rows.write.parquet(f"{staged}/rows")
        self.spark.read.schema(rows.schema).parquet(f"{staged}/rows").groupBy("stream").agg(F.max("watermark").alias("watermark")).coalesce(1).write.parquet(f"{staged}/marks")
        if not self._fs.rename(self._path(staged), self._path(f"{self.path}/data/{name}")):
            raise OSError(f"could not publish {name}")

    def land(self, records: DataFrame, mode: str = "position") -> None:
        """records: stream, watermark (of the batch), value, and pos or an arrival order.

        Landing the same batch again changes nothing. A batch without records keeps its watermark as a row without a value.
        """
        if mode == "sequence":
            new = whole(records, self.watermarks())
        else:
            new = suffix(records, self.watermarks())
        self.publish(new)


def numbered(values: DataFrame, stream: str = "stream", arrival: str = "arrival") -> DataFrame:
    """Positions of records in their stream, for positional landing."""
    return positions(values, [stream], arrival, "pos")
