"""Line files and inline values as record sources, line files as a sink."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import strip_cr
from ..model import RECORD


def line_file(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file or folder, split at line feeds only; empty lines are dropped, a carriage return stays."""
    return spark.read.text(path, lineSep="\n").where(F.length("value") > 0)


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path, lineSep="\n").where(F.length("value") > 0)


def inline(spark: SparkSession, values: Iterable[bytes | str], batch_id: int = 0) -> DataFrame:
    """Given values as one batch."""
    rows = [(batch_id, i, v.encode() if isinstance(v, str) else bytes(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, RECORD)


def resolve(spark: SparkSession, values: list[str], stdin: str | None = None) -> DataFrame:
    """Values if there are any, else the lines of standard input, else a pair for demonstration."""
    return inline(spark, values or (stdin.splitlines() if stdin else None) or ["evt:hello", "evt:world"])


def split_body(body: DataFrame, column: str = "body") -> DataFrame:
    """Records of a fetched body: lines without one trailing carriage return, empty ones dropped."""
    lines = body.select(F.posexplode(F.split(F.col(column).cast("string"), "\n")).alias("ord", "raw"))
    return lines.select("ord", strip_cr(F.col("raw")).alias("value")).where("value <> ''")


def append_lines(records: DataFrame, path: str, value: str = "value") -> None:
    """Append records as lines. Running twice writes twice: at-least-once."""
    records.select(F.col(value).cast("string").alias("value")).write.mode("append").text(path, lineSep="\n")


def blobs(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Blobs below a folder whose names begin with a prefix, by key."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*").load(path).select("path", "content", "length").orderBy("path")


def stream_blobs(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Objects as they appear below a folder, each once: the checkpoint is the cursor."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").load(path).select("path", "content")


def put_objects(envelopes: DataFrame, path: str) -> None:
    """Envelopes below route and stream, one folder for each; a rewrite of a stream replaces it."""
    envelopes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("route", "stream").parquet(path)
