"""The engine's commands: validate, keygen, run, deliver, send, recv, replay, verify, ticket."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.hashing import hmac_bytes
from .model import BATCH_COUNT, DEAD
from .operators import contract, envelope, landing, log, offload
from .operators.lineage import cut
from .sources import lines, spec


def validate(text: str) -> dict[str, str]:
    r = spec.parse(text)
    return {"route_id": r.route_id.hex(), "stream_id": r.stream_id.hex(), "cipher": r.cipher, "guarantee": r.guarantee, "contract": r.onboarding.fingerprint}


def keygen(size: int = 32) -> str:
    return secrets.token_hex(size)


def ordered_exactly_once(ordered: bool, at_least_once: bool) -> bool:
    """Whether positions can carry exactly-once: an append-ordered source that hasn't opted out."""
    return ordered and not at_least_once


def sink_kind(table: str | None, webhook: str | None, file: str | None, at_least_once: bool, ordered: bool) -> str:
    """The first sink given, in this order; a table lands exactly once where the source allows it."""
    if table:
        return "table_exactly_once" if ordered_exactly_once(ordered, at_least_once) else "table"
    return "webhook" if webhook else "file" if file else "memory"


def run(spark: SparkSession, route: spec.Route, records: DataFrame, target: landing.LandingTable, stream: str) -> dict[str, int]:
    """One batch of records (pos, value) through the contract to the landing table. Running again lands nothing twice."""
    good = route.onboarding.accepts(F.col("value"))
    n = records.agg(F.count("*").alias("boarded"), F.count_if(~good).alias("dead")).first()
    if n["dead"]:
        return {"boarded": n["boarded"], "landed": 0, "dead": n["boarded"]}
    before = target.watermarks().where(F.col("stream") == stream).agg(F.max("watermark")).first()[0] or 0
    target.land(records.select(F.lit(stream).alias("stream"), F.lit(n["boarded"]).cast("long").alias("watermark"), "pos", "value"))
    return {"boarded": n["boarded"], "landed": max(0, n["boarded"] - before), "dead": 0}


def board(route: spec.Route, records: DataFrame, data_key: bytes, signing_key: bytes, size: int = BATCH_COUNT) -> DataFrame:
    """Records (pos, value) as envelopes of up to `size` each, sealed and encoded: (arrival, wire). Sealing again gives the same bytes."""
    rows = records.withColumn("batch", F.expr(f"pos div {size}"))
    framed = envelope.framed(rows, "batch", "pos", "value")
    sealed = envelope.seal(framed, route.onboarding, data_key, signing_key, route.route_id, F.lit(route.stream_id), F.col("batch"), F.concat(F.lit(route.stream_id.hex() + "/"), F.col("batch").cast("string")), F.col("payload"))
    return sealed.select(F.col("batch").alias("arrival"), envelope.encoded().alias("wire"))


def offboard(route: spec.Route, wires: DataFrame, data_key: bytes, signing_key: bytes) -> DataFrame:
    """Encoded envelopes (arrival, wire) opened and admitted; malformed ones are dead."""
    got = envelope.decoded(wires)
    done = offload.offload(got.where("envelope is not null").select("arrival", "envelope.*"), route.offloading, data_key, signing_key, route.route_id)
    dead = got.where("envelope is null").select("arrival", F.lit("malformed").alias("reason"), F.lit(DEAD).alias("disposition"))
    return done.select("arrival", "stream", "seq", "reason", "disposition", "values").unionByName(dead, allowMissingColumns=True)


def deliver(spark: SparkSession, route: spec.Route, records: DataFrame, target: landing.LandingTable, data_key: bytes, signing_key: bytes, size: int = BATCH_COUNT) -> dict[str, int]:
    """A batch of records boarded, moved, opened, admitted and landed. Running again lands nothing twice."""
    done = cut(offboard(route, board(route, records, data_key, signing_key, size), data_key, signing_key))
    landed = offload.commit(done, target)
    told = {r["disposition"]: r["n"] for r in done.groupBy("disposition").agg(F.count("*").alias("n")).collect()}
    return {"envelopes": sum(told.values()), "landed": landed, "dead": told.get(DEAD, 0), "duplicate": told.get("Duplicate", 0)}


def send(route: spec.Route, records: DataFrame, folder: str, data_key: bytes, signing_key: bytes, size: int = BATCH_COUNT) -> None:
    """Envelopes as files of a folder, which stands for the channel."""
    board(route, records, data_key, signing_key, size).write.mode("append").parquet(folder)


def recv(spark: SparkSession, route: spec.Route, folder: str, target: landing.LandingTable, data_key: bytes, signing_key: bytes) -> int:
    """What has come into the folder is landed, each envelope once."""
    return offload.commit(offboard(route, spark.read.parquet(folder), data_key, signing_key), target)


def replay(records: DataFrame, text: str, position: str = "pos") -> DataFrame:
    return log.replay(records, text, position)


def verify(envelopes: DataFrame, route: spec.Route, data_key: bytes, signing_key: bytes) -> DataFrame:
    """Each envelope with the reason for which it would be quarantined, if any."""
    return envelope.opened(envelopes, route.offloading, data_key, signing_key, route.route_id)


def ticket(route: spec.Route, signing_key: bytes) -> str:
    """A signature over route and stream."""
    return hmac_bytes(signing_key, b"ticket" + route.route_id + route.stream_id).hex()


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """A line file as numbered records. Its lines' order is that of the file: one file, read in one part."""
    return lines.line_file(spark, path).withColumn("pos", F.monotonically_increasing_id())


def fingerprint(most: int, prefix: bytes) -> str:
    return contract.Contract(most, prefix).fingerprint
