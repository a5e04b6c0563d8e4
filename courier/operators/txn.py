"""Transactions over event tables: fencing, claims, buffering, visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..model import CONCURRENT, INVALID_EPOCH, INVALID_RECORD, INVALID_STATE
from .contract import Contract
from .ranking import positions


def init_producers(inits: DataFrame, order: str = "ord") -> DataFrame:
    """Each init of a transactional id gets an epoch one above the last, and so fences its predecessors. After 2^15 - 1 a
    new producer id begins at epoch 0."""
    ids = positions(inits, ["transactional_id"], order, "__n")
    first = ids.where("__n = 0").select("transactional_id", F.xxhash64("transactional_id").alias("__base"))
    span = 1 << 15
    return ids.join(first, "transactional_id").select(*inits.columns, (F.col("__base") + F.floor(F.col("__n") / span)).cast("long").alias("producer_id"), (F.col("__n") % span).cast("int").alias("epoch"))


def produce_code(known_id: Column, known_epoch: Column, open_: Column, claimed: Column, producer_id: Column, epoch: Column) -> Column:
    """47 for a wrong producer or epoch, 48 without an open transaction or a claim on the partition, else 0."""
    current = F.coalesce((known_id == producer_id) & (known_epoch == epoch), F.lit(False))
    return F.when(~current, INVALID_EPOCH).when(~(F.coalesce(open_, F.lit(False)) & F.coalesce(claimed, F.lit(False))), INVALID_STATE).otherwise(0)


def claim_conflicts(requests: DataFrame, holders: DataFrame) -> DataFrame:
    """All or nothing: a request gets 51 if another transaction holds any of its partitions.

    requests: request, transactional_id, topic, partition. holders: transactional_id, topic, partition.
    """
    held = holders.select("topic", "partition", F.col("transactional_id").alias("__holder")).distinct()
    clash = requests.join(held, (requests["topic"] == held["topic"]) & (requests["partition"] == held["partition"]) & (requests["transactional_id"] != held["__holder"]), "left_semi")
    bad = clash.select("request").distinct().withColumn("__bad", F.lit(True))
    return requests.select("request", "transactional_id").distinct().join(bad, "request", "left").select("request", "transactional_id", F.when(F.col("__bad"), CONCURRENT).otherwise(0).alias("code"))


def visible(buffered: DataFrame, markers: DataFrame) -> DataFrame:
    """What committed transactions show: records of exactly the marker's producer and epoch, buffered before it.

    buffered: ord, producer_id, epoch, ... markers: ord, producer_id, epoch, commit. The first marker of an epoch counts.
    """
    ends = markers.groupBy("producer_id", "epoch").agg(F.min_by("commit", "ord").alias("__commit"), F.min("ord").alias("__end"))
    return buffered.join(ends, ["producer_id", "epoch"]).where(F.col("__commit") & (F.col("ord") < F.col("__end"))).drop("__commit", "__end")


def pending(buffered: DataFrame, markers: DataFrame) -> DataFrame:
    """Still buffered: neither ended, nor of an epoch that a marker of a later one discarded."""
    ends = markers.groupBy("producer_id").agg(F.max("epoch").alias("__max"))
    return buffered.join(ends, "producer_id", "left").where(F.col("__max").isNull() | (F.col("epoch") > F.col("__max"))).drop("__max")


def staged_offsets(staged: DataFrame, markers: DataFrame) -> DataFrame:
    """Offsets that committed transactions carry, as commits at the order of their markers."""
    ends = markers.where("commit").groupBy("producer_id", "epoch").agg(F.min("ord").alias("__end"))
    return staged.join(ends, ["producer_id", "epoch"]).select("group", "topic", "partition", "offset", F.col("__end").alias("ord"))


def served(events: DataFrame, contract: Contract) -> DataFrame:
    """A transactional service's answers to events (ord, kind, transactional_id, epoch, topic, partition, value, commit).

    `init` begins the next epoch and discards what is open. `add` claims a partition and opens the transaction, `buffer`
    stages a record, `end` commits or aborts. Codes: 47 for an epoch that isn't the id's latest, 48 without an open
    transaction or a claim, 87 for a record that breaks the contract, else 0. `shown`: a staged record whose transaction is
    committed. `provisional`: its place among the staged records of its transaction and partition.

    A transactional id's events are in one task; the events of all ids are spread.
    """
    own = Window.partitionBy("transactional_id").orderBy("ord")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("__epoch", F.sum((F.col("kind") == "init").cast("int")).over(so_far) - 1)
    rows = rows.withColumn("__current", (F.col("kind") == "init") | F.coalesce(F.col("epoch") == F.col("__epoch"), F.lit(False)))
    live = lambda kind: F.col("__current") & (F.col("kind") == kind)
    # what closes a transaction: an init, or an end of the current epoch; an end without an open one changes nothing
    rows = rows.withColumn("__closed", F.coalesce(F.max(F.when(live("init") | live("end"), F.col("ord"))).over(before), F.lit(-1)))
    rows = rows.withColumn("__opened", F.coalesce(F.max(F.when(live("add"), F.col("ord"))).over(before), F.lit(-1)))
    rows = rows.withColumn("__claimed", F.coalesce(F.max(F.when(live("add"), F.col("ord"))).over(Window.partitionBy("transactional_id", "topic", "partition").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    is_open, claimed = F.col("__opened") > F.col("__closed"), F.col("__claimed") > F.col("__closed")
    code = (
        F.when(F.col("kind") == "init", 0).when(~F.col("__current"), INVALID_EPOCH)
        .when((F.col("kind") == "end") & ~is_open, INVALID_STATE).when((F.col("kind") == "buffer") & ~(is_open & claimed), INVALID_STATE)
        .when((F.col("kind") == "buffer") & ~contract.accepts(F.col("value")), INVALID_RECORD).otherwise(0)
    )
    rows = rows.withColumn("code", code)
    # backwards: a frame that ends with the partition is computed anew for each row, one that begins with it goes on
    after = Window.partitionBy("transactional_id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    closing = F.min(F.when((F.col("kind") == "init") | ((F.col("kind") == "end") & (F.col("code") == 0)), F.struct("ord", (F.coalesce(F.col("commit"), F.lit(False)) & (F.col("kind") == "end")).alias("commit")))).over(after)
    rows = rows.withColumn("__end", closing)
    staged = (F.col("kind") == "buffer") & (F.col("code") == 0)
    nth = F.row_number().over(Window.partitionBy("transactional_id", "__closed", "topic", "partition", staged).orderBy("ord")) - 1
    shown = staged & F.coalesce(F.col("__end.commit"), F.lit(False))
    return rows.select(*events.columns, "code", F.when(staged, nth).alias("provisional"), shown.alias("shown"))
