"""The admission gate, exactly-once landing and record dispatch as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.codec import decode_batch
from ..model import DUPLICATE, GC_LAG, REORDER_HORIZON
from ..operators.admit import Gate
from ..operators.contract import Contract
from ..operators.landing import LandingTable, whole

OUT = "stream string, arrival long, seq long, key string, disposition string, low_watermark long, gc_floor long"
STATE = "watermark long, floor long, seqs array<long>, keys array<string>, parked array<long>"


def admit_stream(arrivals: DataFrame, horizon: int = REORDER_HORIZON, gc_lag: int = GC_LAG) -> DataFrame:
    """Streaming admission: (stream, arrival, seq, key) -> the same with disposition, watermark and floor.

    The state of a stream is its gate, which the horizon and the lag bound. Late arrivals are reported as duplicates,
    not dropped. Within a micro-batch a stream's arrivals are taken in order of `arrival`.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate = Gate(horizon, gc_lag)
        if state.exists:
            watermark, floor, seqs, keys, parked = state.get
            gate = Gate(horizon, gc_lag, watermark, floor, dict(zip(seqs, keys)), set(keys), set(parked))
        rows = pd.concat(list(parts)).sort_values("arrival", kind="stable")
        out = []
        for seq, k in zip(rows["seq"], rows["key"]):
            out.append((gate.offer(int(seq), k), gate.watermark, gate.floor))
        state.update((gate.watermark, gate.floor, list(gate.delivered), list(gate.delivered.values()), sorted(gate.parked)))
        yield rows.assign(stream=key[0], **dict(zip(("disposition", "low_watermark", "gc_floor"), zip(*out))))[["stream", "arrival", "seq", "key", "disposition", "low_watermark", "gc_floor"]]

    plain = arrivals.select(F.col("stream").cast("string").alias("stream"), F.col("arrival").cast("long").alias("arrival"), F.col("seq").cast("long").alias("seq"), F.col("key").cast("string").alias("key"))
    return plain.groupBy("stream").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def land_exactly_once(table: LandingTable) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: batches of (stream, watermark, value) land as a whole if they are new; a batch that Spark runs again is a no-op."""

    def land(batch: DataFrame, _: int) -> None:
        new = whole(batch, table.watermarks())
        if not new.isEmpty():
            table.publish(new)

    return land


def land_at_least_once(path: str) -> Callable[[DataFrame, int], None]:
    def land(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(path)

    return land


def delivered(admitted: DataFrame) -> DataFrame:
    return admitted.where(F.col("disposition") != DUPLICATE)


def ingest(spark: SparkSession, source: str, schema: str, contract: Contract, target: LandingTable, checkpoint: str, files_per_trigger: int = 16):
    """Dropped files of produced batches (stream, watermark, value), checked, to the landing table. A batch with a bad record
    is refused as a whole; the checkpoint moves only after the landing is published."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)

    def land(batch: DataFrame, number: int) -> None:
        good = batch.groupBy("stream", "watermark").agg(F.every(contract.accepts(F.col("value"))).alias("__ok")).where("__ok").drop("__ok")
        land_exactly_once(target)(batch.join(good, ["stream", "watermark"], "left_semi"), number)

    return rows.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_batches(spark: SparkSession, source: str, contract: Contract, target: LandingTable, checkpoint: str, files_per_trigger: int = 16, wrap: str = ""):
    """Dropped files of produced record batches (topic, partition, wire), decoded, checked and landed.

    A batch with a producer's range lands by its sequence numbers, once, however often it is produced or read: its stream is
    the producer's in that partition, its watermark the number after its last. A batch without one is landed as it comes, at
    least once. Malformed and corrupt batches, and those with a record that breaks the contract, are refused as a whole.
    """
    rows = spark.readStream.schema("topic string, partition int, wire binary").option("maxFilesPerTrigger", files_per_trigger).parquet(source)

    def land(batch: DataFrame, _: int) -> None:
        got = batch.withColumn("got", decode_batch("wire")).where((F.col("got.error") == 0) & (F.size("got.values") > 0))
        got = got.where(F.forall("got.values", lambda v: contract.accepts(v)))
        place = F.concat_ws("/", F.lit(wrap), "topic", F.col("partition").cast("string"))
        ranged = got.where("got.producer_id is not null").select(F.concat_ws("/", place, F.col("got.producer_id").cast("string"), F.col("got.epoch").cast("string")).alias("stream"), (F.col("got.base_sequence") + F.col("got.count")).cast("long").alias("watermark"), F.col("got.values").alias("values"))
        plain = got.where("got.producer_id is null").select(place.alias("stream"), F.lit(0).cast("long").alias("watermark"), F.col("got.values").alias("values"))
        new = whole(ranged.dropDuplicates(["stream", "watermark"]), target.watermarks()).unionByName(plain)
        new = new.select("stream", "watermark", F.posexplode("values").alias("pos", "value")).withColumn("value", F.col("value").cast("string")).persist()
        if not new.isEmpty():
            target.publish(new)
        new.unpersist()

    return rows.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dropped_files(spark: SparkSession, source: str, schema: str, files: int | None = None, size: int | None = None) -> DataFrame:
    """Dropped files as a stream whose micro-batches close at a number of files or of bytes, whichever is given."""
    reader = spark.readStream.schema(schema)
    for option, value in (("maxFilesPerTrigger", files), ("maxBytesPerTrigger", size)):
        if value is not None:
            reader = reader.option(option, value)
    return reader.parquet(source)


def produce_with_timer(records: DataFrame, millis: int, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Batching by time: a trigger closes a batch."""
    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{millis} milliseconds").start()


def dispatch(records: DataFrame, nodes: DataFrame, key: str = "key") -> DataFrame:
    """A stream's records with the node that each belongs to; the nodes are read when the query starts."""
    from ..operators.routing import route

    return route(records, nodes, key)
