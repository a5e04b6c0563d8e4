"""The broker's query side as a service over tables: produce, fetch, bounds, commits."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import log, offsets
from .contract import Contract, batches
from .lineage import cut

# The request kinds that are served and their versions (kind, least, most).
API_VERSIONS = [(0, 0, 7), (1, 0, 4), (2, 0, 2), (3, 0, 1), (8, 0, 2), (9, 0, 2), (10, 0, 2), (11, 1, 4), (12, 0, 2), (13, 0, 2), (14, 0, 2), (17, 0, 1), (18, 0, 3), (22, 0, 1), (24, 0, 1), (25, 0, 1), (26, 0, 1), (28, 0, 1), (36, 0, 1)]


def api_versions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(API_VERSIONS, "api int, least int, most int")


@dataclass(frozen=True)
class Broker:
    """Logs (topic, partition, offset, arrival, value) and commits (group, topic, partition, offset, ord).

    A value: each change gives a new broker; nothing is stored before the frames are written.
    """

    log: DataFrame
    commits: DataFrame
    contract: Contract

    @staticmethod
    def empty(spark: SparkSession, contract: Contract) -> "Broker":
        return Broker(
            spark.createDataFrame([], "topic string, partition long, offset long, arrival long, value string"),
            spark.createDataFrame([], "group string, topic string, partition long, offset long, ord long"), contract,
        )

    def produce(self, records: DataFrame) -> tuple["Broker", DataFrame]:
        """Records (topic, partition, arrival, value): each partition's batch is appended or refused as a whole.

        The answer has a code, a base offset (-1 if refused) and a count for each partition.
        """
        asked = batches(records.withColumn("__batch", F.struct("topic", "partition")), self.contract, "__batch").select("__batch.topic", "__batch.partition", "records", "accepted")
        ends = self.bounds().select(*log.LOG, F.col("latest").alias("next_offset"))
        good = records.join(asked.where("accepted").select(*log.LOG), log.LOG, "left_semi")
        placed = log.assign_offsets(good.select(*log.LOG, "arrival", "value"), base=ends)
        outcome = asked.join(ends, log.LOG, "left").select(*log.LOG, F.when(F.col("accepted"), 0).otherwise(87).alias("code"), F.when(F.col("accepted"), F.coalesce("next_offset", F.lit(0))).otherwise(-1).alias("base_offset"), "records")
        # the log is cut, so that its plan doesn't grow with the number of produces
        return replace(self, log=cut(self.log.unionByName(placed))), outcome

    def fetch(self, start: int, cap: int) -> DataFrame:
        return log.fetch(self.log, start, cap)

    def bounds(self) -> DataFrame:
        return log.bounds(self.log)

    def commit(self, rows: DataFrame) -> "Broker":
        """Commits past the end of their log are refused."""
        good = rows.join(self.bounds().select(*log.LOG, "latest"), log.LOG, "left").where(F.col("offset") <= F.coalesce("latest", F.lit(0)))
        return replace(self, commits=self.commits.unionByName(good.select(*rows.columns)))

    def committed(self) -> DataFrame:
        return offsets.latest(self.commits)

    def poll(self, group: str, cap: int) -> DataFrame:
        """What a group reads next: from its committed offset of each partition on."""
        own = self.committed().where(F.col("group") == group).select(*log.LOG, F.col("committed").alias("__from"))
        rest = self.log.join(own, log.LOG, "left").where(F.col("offset") >= F.coalesce("__from", F.lit(0))).drop("__from")
        return log.fetch(rest, 0, cap)
