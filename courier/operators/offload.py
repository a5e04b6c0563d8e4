"""Offload: envelopes are opened, admitted once for each stream and sequence number, and their values landed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..model import DEAD, DELIVERED, GC_LAG, REORDER_HORIZON
from .admit import admit
from .contract import Contract
from .envelope import opened
from .landing import LandingTable


def offload(envelopes: DataFrame, contract: Contract, data_key: bytes, signing_key: bytes, route_id: bytes, arrival: str = "arrival", horizon: int = REORDER_HORIZON, gc_lag: int = GC_LAG) -> DataFrame:
    """Each envelope (header, payload, seal and its place of arrival) with its reason, disposition and, if delivered, values.

    An envelope that can't be opened is dead and takes no part in admission, so a good copy that comes later is delivered.
    """
    found = opened(envelopes, contract, data_key, signing_key, route_id)
    found = found.withColumn("stream", F.lower(F.hex("header.stream_id"))).withColumn("seq", F.col("header.seq")).withColumn("key", F.lower(F.hex("header.idempotency_key")))
    good = admit(found.where("reason is null").select("stream", F.col(arrival).alias("__arrival"), "seq", "key"), arrival="__arrival", horizon=horizon, gc_lag=gc_lag)
    told = found.join(good.select("stream", F.col("__arrival").alias(arrival), "disposition"), ["stream", arrival], "left")
    disposition = F.when(F.col("reason").isNotNull(), DEAD).otherwise(F.col("disposition"))
    return told.withColumn("disposition", disposition).withColumn("values", F.when(F.col("disposition") == DELIVERED, F.col("values")))


def commit(outcomes: DataFrame, target: LandingTable) -> int:
    """Land what was delivered and isn't landed yet; how many envelopes that is. Running again lands nothing twice, and
    an envelope that comes in a later run with a lower number than others isn't lost: what is landed is known by number."""
    fresh = outcomes.where(F.col("disposition") == DELIVERED).select("stream", (F.col("seq") + 1).alias("watermark"), "values")
    stored = target.read()
    if stored is not None:
        ends = fresh.groupBy("stream").agg(F.min("watermark").alias("__low"), F.max("watermark").alias("__high"))
        near = stored.join(F.broadcast(ends), "stream").where(F.col("watermark").between(F.col("__low"), F.col("__high"))) if ends.count() <= 100_000 else stored
        fresh = fresh.join(near.select("stream", "watermark").distinct(), ["stream", "watermark"], "left_anti")
    n = fresh.count()
    if n:
        target.publish(fresh.select("stream", "watermark", F.posexplode_outer("values").alias("pos", "value")).withColumn("value", F.col("value").cast("string")))
    return n
