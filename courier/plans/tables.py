"""Views that read the driver's tables as arrivals, logs, commits, transactions, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ranking import positions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals of the event table without their sequence numbers."""
    e = table(spark, sf_dir, "events")
    value = F.concat(F.lit("evt:"), "event_type", F.lit(":"), F.col("event_id").cast("string"))
    return e.select(F.col("user_id").alias("stream"), F.col("event_id").alias("arrival"), F.col("event_type").alias("topic"), (F.col("user_id") % 3).alias("partition"), value.alias("value"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their place in their stream."""
    return positions(records(spark, sf_dir), ["stream"], "arrival", "seq")


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals, and every seventh a second time, later."""
    a = arrivals(spark, sf_dir)
    again = a.where("arrival % 7 = 0").withColumn("arrival", F.col("arrival") + 1_000_000_000)
    return a.unionByName(again).withColumn("key", F.concat(F.col("stream").cast("string"), F.lit("/"), F.col("seq").cast("string")))


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as partition logs with offsets."""
    return positions(records(spark, sf_dir), ["topic", "partition"], "arrival", "offset")


# The same views for SQL.
RECORDS = "(select user_id as stream, event_id as arrival, event_type as topic, user_id % 3 as partition, 'evt:' || event_type || ':' || event_id as value from events)"
ARRIVALS = f"(select *, row_number() over (partition by stream order by arrival) - 1 as seq from {RECORDS})"
REDELIVERED = f"(select stream, arrival, topic, partition, value, seq, stream || '/' || seq as key from {ARRIVALS} union all select stream, arrival + 1000000000, topic, partition, value, seq, stream || '/' || seq from {ARRIVALS} where arrival % 7 = 0)"
LOG = f'(select *, row_number() over (partition by topic, "partition" order by arrival) - 1 as "offset" from {RECORDS})'
