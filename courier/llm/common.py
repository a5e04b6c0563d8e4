"""What the training-data operators share: cutting lineage, tables, distributed ranks, components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. A folder of our own only on a single machine whose session names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if conf is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(conf or os.path.join(tempfile.gettempdir(), "courier-checkpoints"))
    return sc.getCheckpointDir()


def partitions(spark: SparkSession, rows: int, most: int) -> int:
    """Partitions for a shuffle of so many rows: as many as the session asks for, and more if one would hold over `most` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most), 1)


def cut(df: DataFrame) -> DataFrame:
    """Materialise a narrow table in the shared folder and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """As cut(), as Parquet: for wide tables of which later steps read some columns only."""
    path = f"{shared_dir(df.sparkSession)}/courier-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered_rank(df: DataFrame, order: list, rank: str = "rank") -> tuple[DataFrame, int]:
    """Gapless global positions from 0 in the given order, and the number of rows.

    One range-partitioned sort; no row meets all others in one task. The driver gets a number for each partition.
    """
    names = df.columns
    placed = cut(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    part, local = F.shiftright("__id", 33).cast("int"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in range(max(counts, default=0) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    base = F.element_at(numbers(starts), part + 1)
    return placed.select(*[F.col(f"`{c}`") for c in names], (base + local).alias(rank)), total


def numbers(values: list[int]):
    """An array of long constants, folded from one string: a literal for each of many numbers takes the driver long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, root): each linked node with the smallest node that it reaches, by large-star and small-star steps.

    links: two long columns. Each round costs two aggregations and two joins of the remaining links and is cut; the
    number of rounds grows with the logarithm of a component's diameter. Joins read materialised sides, so Spark
    can split the partition of a node with very many links.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
