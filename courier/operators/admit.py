"""Effectively-once admission of (stream, seq, key) arrivals, contiguous watermarks, checkpoints.

The gate is order-dependent: what an arrival does depends on what earlier arrivals of its stream were admitted. `admit`
folds each stream in arrival order and is exact. `admit_bound` is the relational form for sources whose keys and
sequence numbers belong together one to one; it needs no Python and no stream in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import hmac_sha256, le64
from ..model import DELIVERED, DUPLICATE, GC_LAG, REORDER_HORIZON
from .ranking import positions


@dataclass
class Gate:
    """One stream's admission state. Keys are remembered from gc_floor on; parked sequence numbers lie ahead of the watermark."""

    horizon: int = REORDER_HORIZON
    gc_lag: int = GC_LAG
    watermark: int = 0
    floor: int = 0
    delivered: dict[int, object] = field(default_factory=dict)
    keys: set = field(default_factory=set)
    parked: set[int] = field(default_factory=set)
    ahead: list[int] = field(default_factory=list)  # a heap of the parked numbers; those that were drained are skipped

    def __post_init__(self) -> None:
        self.ahead = sorted(self.parked)

    def offer(self, seq: int, key: object) -> str:
        if seq < self.watermark or key in self.keys or seq in self.delivered:
            return DUPLICATE
        self.keys.add(key)
        self.delivered[seq] = key
        self.parked.add(seq)
        if seq == self.watermark:
            self._drain()
        heapq.heappush(self.ahead, seq)
        while len(self.parked) > self.horizon:  # give up on the lowest gap
            while self.ahead[0] not in self.parked:
                heapq.heappop(self.ahead)
            self.watermark = self.ahead[0]
            self._drain()
        while self.ahead and self.ahead[0] < self.watermark:
            heapq.heappop(self.ahead)
        for old in range(self.floor, max(self.floor, self.watermark - self.gc_lag)):
            self.keys.discard(self.delivered.pop(old, None))
        self.floor = max(self.floor, self.watermark - self.gc_lag)
        return DELIVERED

    def _drain(self) -> None:
        while self.watermark in self.parked:
            self.parked.remove(self.watermark)
            self.watermark += 1

    def checkpoint(self) -> tuple[int, list[tuple[int, object]]]:
        """The watermark and the entries at or above it, by sequence number."""
        return self.watermark, sorted((s, k) for s, k in self.delivered.items() if s >= self.watermark)

    def restore(self, watermark: int, entries: list[tuple[int, object]] = ()) -> None:
        """Monotonic: an older checkpoint changes nothing but adds its entries."""
        if watermark > self.watermark:
            self.watermark, self.floor = watermark, max(0, watermark - self.gc_lag)
            self.parked = {s for s in self.parked if s >= watermark}
            self.ahead = sorted(self.parked)
            self.delivered = {s: k for s, k in self.delivered.items() if s >= self.floor}
            self.keys = set(self.delivered.values())
        for seq, key in entries:
            self.offer(seq, key)


def admit(arrivals: DataFrame, stream: str = "stream", arrival: str = "arrival", seq: str = "seq", key: str = "key", horizon: int = REORDER_HORIZON, gc_lag: int = GC_LAG) -> DataFrame:
    """Each arrival with its disposition and the watermark and floor of its stream after it.

    A task walks its streams in order; its memory is one stream's gate, which the horizon and the lag bound.
    """
    base = arrivals.drop("disposition", "low_watermark", "gc_floor")
    schema = base.schema.add("disposition", "string").add("low_watermark", "long").add("gc_floor", "long")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, gate = object(), Gate()
        for part in parts:
            out = []
            for s, n, k in zip(part[stream], part[seq], part[key]):
                if s != now:
                    now, gate = s, Gate(horizon, gc_lag)
                out.append((gate.offer(int(n), k), gate.watermark, gate.floor))
            yield part.assign(**dict(zip(("disposition", "low_watermark", "gc_floor"), zip(*out) if out else ([], [], []))))

    return base.repartition(stream).sortWithinPartitions(stream, arrival).mapInPandas(run, schema)


def admit_bound(arrivals: DataFrame, stream: str = "stream", arrival: str = "arrival", seq: str = "seq") -> DataFrame:
    """Exact where key and sequence number are one to one: the first arrival of each is delivered.

    The first arrivals are an aggregate, so partial results meet, not rows.
    """
    first = arrivals.groupBy(stream, seq).agg(F.min(arrival).alias("__first"))
    return arrivals.join(first, [stream, seq]).withColumn("disposition", F.when(F.col(arrival) == F.col("__first"), DELIVERED).otherwise(DUPLICATE)).drop("__first")


def contiguous_watermark(sequences: DataFrame, stream: str = "stream", seq: str = "seq") -> DataFrame:
    """How many sequence numbers from 0 on each stream has without a gap."""
    ranked = positions(sequences.select(stream, seq).distinct(), [stream], seq, "__n")
    return ranked.groupBy(stream).agg(F.coalesce(F.min(F.when(F.col(seq) != F.col("__n"), F.col("__n"))), F.count("*")).alias("low_watermark"), F.count("*").alias("present"))


def islands(sequences: DataFrame, stream: str = "stream", seq: str = "seq") -> DataFrame:
    """Runs of consecutive sequence numbers."""
    ranked = positions(sequences.select(stream, seq).distinct(), [stream], seq, "__n")
    return ranked.groupBy(stream, (F.col(seq) - F.col("__n")).alias("__run")).agg(F.min(seq).alias("first"), F.max(seq).alias("last")).drop("__run")


def resend(outbox: DataFrame, acked: DataFrame, stream: str = "stream", position: str = "pos") -> DataFrame:
    """After a disconnect: the first unacknowledged item and everything after it."""
    first = outbox.join(acked.select(stream, position), [stream, position], "left_anti").groupBy(stream).agg(F.min(position).alias("__from"))
    return outbox.join(first, stream).where(F.col(position) >= F.col("__from")).drop("__from")


def ack_floor(entries: DataFrame, keys: list[str], segment: str = "segment", acked: str = "acked") -> DataFrame:
    """The oldest segment that still has an unacknowledged entry, and how many there are."""
    return entries.groupBy(*keys).agg(F.min(F.when(~F.col(acked), F.col(segment))).alias("floor"), F.count_if(~F.col(acked)).alias("in_flight"))


def signed_watermark(key: bytes, stream: Column, watermark: Column) -> Column:
    """A token by which a stream's watermark can be shown to others."""
    return hmac_sha256(key, F.concat(F.lit(b"watermark"), le64(watermark), stream.cast("binary")))


def watermark_ok(key: bytes, stream: Column, watermark: Column, token: Column) -> Column:
    return signed_watermark(key, stream, watermark) == token
