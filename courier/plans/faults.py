"""Deterministic faults for tests and queries: what a bad link does to arrivals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def chance(percent: int, *parts: Column) -> Column:
    """True for about so many rows in a hundred, the same ones each time."""
    return F.pmod(F.xxhash64(*parts), F.lit(100)) < percent


def dropped(arrivals: DataFrame, lost: Column) -> DataFrame:
    return arrivals.where(~lost)


def storm(sent: DataFrame, rounds: int = 4, drop: int = 30, repeat: int = 20, reorder: int = 40) -> DataFrame:
    """Rounds of sending: in each some records are lost, some come twice, some late; the last round loses none."""
    tries = sent.withColumn("__round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    tries = tries.where((F.col("__round") == rounds - 1) | ~chance(drop, "stream", "seq", "__round"))
    copies = F.when(chance(repeat, F.lit("twice"), "stream", "seq", "__round"), 2).otherwise(1)
    tries = tries.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies)))
    late = F.when(chance(reorder, F.lit("late"), "stream", "seq", "__round", "__copy"), F.pmod(F.xxhash64("stream", "seq", "__copy"), F.lit(500))).otherwise(0)
    return tries.withColumn("arrival", (F.col("__round") * 1_000_000 + F.col("seq") * 10 + F.col("__copy") + late * 10).cast("long")).drop("__round", "__copy")


def forged(envelopes: DataFrame, bad: Column) -> DataFrame:
    """Envelopes of which some carry another's seal."""
    return envelopes.withColumn("seal", F.when(bad, F.unhex(F.sha2("seal", 256))).otherwise(F.col("seal")))
