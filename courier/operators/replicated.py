"""A replicated topic: records get offsets and are kept as erasure shards, from which any k give them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import erasure
from .log import LOG, assign_offsets


def produce(records: DataFrame, code: erasure.Code, base: DataFrame | None = None) -> DataFrame:
    """(topic, partition, arrival, value) -> shards (topic, partition, offset, idx, bytes, orig_len); base: next offsets of logs that exist."""
    placed = assign_offsets(records, base=base).withColumn("id", F.to_json(F.struct(*LOG, "offset")))
    shards = erasure.encode(placed, code)
    schema = placed.select(*LOG, "offset").schema
    return shards.withColumn("id", F.from_json("id", schema)).select("id.*", "idx", "bytes", "orig_len")


def reconstruct(shards: DataFrame, code: erasure.Code) -> DataFrame:
    """(topic, partition, offset, value) from the shards that are left; value is null where they are too few."""
    return erasure.restore(shards.withColumn("id", F.struct(*LOG, "offset")), code).select("id.*", "value")
