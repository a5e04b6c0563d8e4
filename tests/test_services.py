"""Codecs, envelopes as bytes, offload, ingest, timers, maintenance: against plain versions, damage and restarts."""

import os
import random
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from courier import commands
from courier.functions import codec, hashing
from courier.model import DEAD, DUPLICATE
from courier.operators import admit, broker, contract, envelope, landing, lineage, log, offload, offsets, proof, routing
from courier.plans import services
from courier.sources import spec
from courier.streaming import gate
from courier.streaming.groups import membership_stream

CONTRACT = contract.Contract(64, b"evt:")


def slow_crc32c(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksums_of_all_lengths():
    rng = random.Random(1)
    values = [rng.randbytes(n) for n in [*range(9), 100, *range(250, 262), 508, 509, 512, 1000, 3000]] + [b"123456789", None, b"\0\0", b"\xff" * 3, "é"]
    raw = [v.encode() if isinstance(v, str) else v or b"" for v in values]
    assert hashing.crc32c_values(pd.Series(values, dtype=object)).tolist() == [slow_crc32c(v) for v in raw]
    assert hashing.crc32c_bytes(b"123456789") == 0xE3069283 and len(hashing.crc32c_values(pd.Series([], dtype=object))) == 0


def plain_fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return h


def test_fnv_of_all_lengths():
    values = [b"", b"a", "é", None, b"x" * 300, b"key-7"]
    assert hashing.fnv1a(pd.Series(values, dtype=object)).tolist() == [plain_fnv(v.encode() if isinstance(v, str) else v or b"") for v in values]


@pytest.mark.parametrize("number", range(5))
def test_codecs(number):
    values = [b"evt:%d" % i * 20 for i in range(50)] + [b"", None]
    wire = codec.write_batch(values, 5, 1, 7, codec=number)
    got = codec.decoded(wire)
    assert got["error"] == 0 and got["values"] == [v for v in values if v is not None] and (got["producer_id"], got["base_sequence"], got["count"]) == (5, 7, 52)
    assert codec.decoded(wire[:-1] + bytes([wire[-1] ^ 1]))["error"] == 2
    assert codec.decoded(wire[:-1])["error"] == 87 and codec.decoded(None)["error"] == 87
    if number:
        assert codec.decoded(codec.write_batch([b"a" * (17 << 20)], codec=number))["error"] == 87  # beyond the bound when decompressed
        with pytest.raises((ValueError, OSError)):
            codec.decompressed(b"\x07nonsense", number)


def test_framed_snappy_and_unknown_codecs():
    block = pa.Codec("snappy").compress(b"ab" * 9, asbytes=True)
    framed = codec.SNAPPY_MARK + struct.pack(">ii", 1, 1) + (struct.pack(">i", len(block)) + block) * 2
    assert codec.decompressed(framed, 2) == b"ab" * 18
    for bad in (framed[:-1], codec.SNAPPY_MARK + struct.pack(">iii", 1, 1, -5)):
        with pytest.raises((ValueError, OSError)):
            codec.decompressed(bad, 2)
    with pytest.raises(ValueError):
        codec.decompressed(framed, 2, most=20)
    with pytest.raises(ValueError):
        codec.decompressed(b"", 5)


def test_envelopes_are_decoded_strictly(spark, sf):
    wires = [bytes(r["wire"]) for r in services.sealed(spark, sf).limit(3).select(envelope.encoded().alias("wire")).collect()]
    for wire in wires:
        assert envelope.decode_envelope(wire) is not None
        assert all(envelope.decode_envelope(wire[:n]) is None for n in range(len(wire)))
        assert envelope.decode_envelope(wire + b"\0") is None and envelope.decode_envelope(wire[:-1] + b"\2") is None and envelope.decode_envelope(b"\2" + wire[1:]) is None
    assert envelope.decode_envelope(None) is None


ROUTE = """
[route]
route_id = "%s"
stream_id = "%s"
[onboarding]
max_record_len = 64
required_prefix = "evt:"
[offloading]
max_record_len = 64
required_prefix = "evt:"
""" % (b"route-0000000001".hex(), b"stream-000000001".hex())


def test_delivery_lands_once_across_restarts(spark, tmp_path):
    route, target = spec.parse(ROUTE), landing.LandingTable(spark, str(tmp_path / "t"))
    rows = spark.range(1000).select(F.col("id").alias("pos"), F.concat(F.lit("evt:"), F.col("id").cast("string")).alias("value"))
    run = lambda df: commands.deliver(spark, route, df, target, b"k" * 32, b"s" * 32, 100)
    assert run(rows.where("pos < 500")) == {"envelopes": 5, "landed": 5, "dead": 0, "duplicate": 0}
    assert run(rows)["landed"] == 5 and run(rows)["landed"] == 0
    assert sorted(int(r["value"][4:]) for r in target.read().collect()) == list(range(1000))


def test_sent_envelopes_are_received_once_though_some_are_damaged_or_late(spark, tmp_path):
    route, folder, target = spec.parse(ROUTE), str(tmp_path / "channel"), landing.LandingTable(spark, str(tmp_path / "t"))
    rows = spark.range(90).select(F.col("id").alias("pos"), F.concat(F.lit("evt:"), F.col("id").cast("string")).alias("value"))
    wires = commands.board(route, rows, b"k" * 32, b"s" * 32, 10)
    cut = F.when(F.col("arrival") == 4, F.substring("wire", F.lit(1), F.octet_length("wire") - 3)).otherwise(F.col("wire"))
    wires.where("arrival <> 2").withColumn("wire", cut).write.parquet(folder)
    assert commands.recv(spark, route, folder, target, b"k" * 32, b"s" * 32) == 7
    commands.send(route, rows, folder, b"k" * 32, b"s" * 32, 10)  # all again: the two that are missing land, though higher ones have landed
    assert commands.recv(spark, route, folder, target, b"k" * 32, b"s" * 32) == 2
    assert commands.recv(spark, route, folder, target, b"k" * 32, b"s" * 32) == 0
    assert sorted(int(r["value"][4:]) for r in target.read().collect()) == list(range(90))
    told = {r["disposition"] for r in commands.offboard(route, spark.read.parquet(folder), b"k" * 32, b"s" * 32).collect()}
    assert DEAD in told and DUPLICATE in told


def test_watermarks_are_read_without_rows(spark, tmp_path):
    target = landing.LandingTable(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([("a", 3, "x"), ("b", 5, "y"), ("a", 2, "z")], "stream string, watermark long, value string")
    target.publish(rows)
    target.publish(rows.limit(0))
    assert {r["stream"]: r["watermark"] for r in target.watermarks().collect()} == {"a": 3, "b": 5} and target.read().count() == 3
    assert all("/marks" in f for f in target.watermarks().inputFiles())


def test_produced_batches_are_ingested(spark, tmp_path):
    target, schema = landing.LandingTable(spark, str(tmp_path / "t")), "topic string, partition int, wire binary"

    def drop(rows, name="check"):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        gate.ingest_batches(spark, str(tmp_path / "in"), CONTRACT, target, str(tmp_path / name)).awaitTermination()
        return sorted(r["value"] for r in target.read().collect())

    first, second = codec.write_batch([b"evt:a", b"evt:b"], 7, 0, 0, codec=4), codec.write_batch([b"evt:c"], 7, 0, 2, codec=2)
    broken = codec.write_batch([b"evt:x", b"nope"], 8, 0, 0)
    assert drop([("t", 0, first), ("t", 0, first), ("t", 0, broken), ("t", 0, b"junk"), ("t", 1, None)]) == ["evt:a", "evt:b"]
    assert drop([("t", 0, first), ("t", 0, second)]) == ["evt:a", "evt:b", "evt:c"]
    assert drop([("t", 1, first)], "lost") == ["evt:a", "evt:a", "evt:b", "evt:b", "evt:c"]  # another partition; the checkpoint is lost
    assert drop([("t", 0, codec.write_batch([b"evt:p"]))], "lost")[-1] == "evt:p"


def test_a_silent_group_goes_on_by_timers(spark, tmp_path):
    schema = "ord long, now_ms long, kind string, group string, member string, generation int, session_ms int"
    out = str(tmp_path / "out")
    for part in ([(0, 1000, "join", "quiet", "a", -1, 9000), (1, 1000, "join", "busy", "b", -1, 99_000)], [(2, 5000, "heartbeat", "busy", "b", 1, 99_000)], [(3, 60_000, "heartbeat", "busy", "b", 1, 99_000)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = membership_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), timers=True)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    quiet = [(r["kind"], r["state"], r["members"]) for r in spark.read.parquet(out).where("group = 'quiet'").orderBy("ord").collect()]
    assert quiet[0] == ("join", "PreparingRebalance", 1)
    assert ("timer", "CompletingRebalance", 1) in quiet and quiet[-1] == ("timer", "Empty", 0)


def test_batches_by_files_bytes_and_time(spark, tmp_path):
    path, seen = str(tmp_path / "in"), []
    for i in range(4):
        spark.createDataFrame([(f"evt:{i}",)], "value string").coalesce(1).write.mode("append").parquet(path)
    for n, option in enumerate(({"files": 1}, {"size": 1}, {})):
        seen.clear()
        stream = gate.dropped_files(spark, path, "value string", **option)
        stream.writeStream.foreachBatch(lambda df, _: seen.append(df.count())).option("checkpointLocation", str(tmp_path / f"c{n}")).trigger(availableNow=True).start().awaitTermination()
        assert [x for x in seen if x] == ([1] * 4 if option else [4])
    query = gate.produce_with_timer(gate.dropped_files(spark, path, "value string"), 50, gate.land_at_least_once(str(tmp_path / "o")), str(tmp_path / "timer"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 4


def test_dispatch_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(f"key-{i}",) for i in range(20)], "key string").write.parquet(str(tmp_path / "in"))
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    gate.dispatch(gate.dropped_files(spark, str(tmp_path / "in"), "key string"), nodes).writeStream.format("memory").queryName("dispatched").trigger(availableNow=True).start().awaitTermination()
    from courier.operators.routing import route

    want = {r["key"]: r["node"] for r in route(spark.read.parquet(str(tmp_path / "in")), nodes).collect()}
    assert {r["key"]: r["node"] for r in spark.table("dispatched").collect()} == want and len(set(want.values())) > 1


class PlainGate(admit.Gate):
    """Gives up on the lowest gap by looking through all that is parked."""

    def offer(self, seq, key):
        if seq < self.watermark or key in self.keys or seq in self.delivered:
            return DUPLICATE
        self.keys.add(key)
        self.delivered[seq] = key
        self.parked.add(seq)
        if seq == self.watermark:
            self._drain()
        while len(self.parked) > self.horizon:
            self.watermark = min(self.parked)
            self._drain()
        for old in range(self.floor, max(self.floor, self.watermark - self.gc_lag)):
            self.keys.discard(self.delivered.pop(old, None))
        self.floor = max(self.floor, self.watermark - self.gc_lag)
        return "Delivered"


def test_the_gate_gives_up_the_lowest_gap():
    rng = random.Random(7)
    for _ in range(200):
        own, plain = admit.Gate(4, 3), PlainGate(4, 3)
        for n in range(80):
            seq, key = max(0, rng.randint(n - 8, n + 12)), rng.randrange(60)
            assert (own.offer(seq, key), own.watermark, own.floor, own.parked) == (plain.offer(seq, key), plain.watermark, plain.floor, plain.parked)
            if rng.random() < 0.05:
                mark = own.watermark + rng.randint(0, 3)
                own.restore(mark), plain.restore(mark)


def test_compaction_and_its_stops(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = [("g", "t", i % 3, i, i) for i in range(30)] + [("h", "t", 0, 5, 99)]
    spark.createDataFrame(rows, "group string, topic string, partition int, offset long, ord long").write.parquet(path)
    before = sorted(map(tuple, offsets.latest(offsets.opened(spark, path)).collect()))
    offsets.compact(spark, path)
    assert offsets.opened(spark, path).count() == 4 and sorted(map(tuple, offsets.latest(offsets.opened(spark, path)).collect())) == before
    os.rename(path, f"{path}.old")  # stopped between the renames
    assert sorted(map(tuple, offsets.latest(offsets.opened(spark, path)).collect())) == before


def test_sealed_segments_go_to_the_cold_tier(spark, tmp_path):
    hot, cold = str(tmp_path / "hot"), str(tmp_path / "cold")
    rows = spark.range(100).select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), F.col("id").cast("string").alias("value"))
    rows.write.parquet(hot)
    log.seal_and_rotate(spark, hot, cold, 60)
    read = lambda: log.tiered(spark.read.parquet(hot), spark.read.parquet(cold), 0).orderBy("offset")
    assert spark.read.parquet(hot).count() == 40 and [r["offset"] for r in read().collect()] == list(range(100))
    rows.where("offset >= 60 and offset < 80").write.mode("append").parquet(cold)  # stopped after the cold copy
    assert read().count() == 100
    log.seal_and_rotate(spark, hot, cold, 80)
    assert spark.read.parquet(cold).count() == 80 and [r["offset"] for r in read().collect()] == list(range(100))


def test_a_log_is_read_across_segments(spark):
    rows = log.rotate(spark.createDataFrame([("t", 0, i, "x" * 10) for i in range(20)], "topic string, partition int, offset long, value string"), 60)
    assert len({r["segment"] for r in rows.collect()}) > 3
    assert [r["offset"] for r in log.read_from(rows, 3 * 18, 7).collect()] == list(range(3, 10))


def test_a_broker_of_many_produces_has_a_small_plan(spark):
    service, sizes = broker.Broker.empty(spark, CONTRACT), []
    for n in range(4):
        service, _ = service.produce(spark.createDataFrame([("t", 0, n, f"evt:{n}")], "topic string, partition long, arrival long, value string"))
        sizes.append(len(service.log._jdf.queryExecution().optimizedPlan().toString()))
    assert max(sizes) == min(sizes) and [r["offset"] for r in service.log.orderBy("offset").collect()] == [0, 1, 2, 3]


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Frame:
        class sparkSession:  # noqa: N801
            sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.cut(Frame())


def test_key_providers_and_secrets(tmp_path):
    keys = spec.Providers().add("vault", lambda name: "11" * 32).add("vault", lambda name: "22" * 32 if name == "new" else None)
    assert keys.resolve("vault:new") == b"\x22" * 32 and keys.resolve("vault:old") == b"\x11" * 32 and keys.resolve("33" * 32) == b"\x33" * 32
    with pytest.raises(ValueError):
        keys.resolve("vault:new", 16)
    assert spec.same_secret(b"a", b"a") and not spec.same_secret(b"a", b"b")


def test_pieces_of_a_long_blob(spark):
    data = bytes(range(256)) * 4000
    blobs = spark.createDataFrame([(1, data), (2, b""), (3, None)], "id long, data binary")
    pieces = proof.chunks(blobs, "id", "data", 1000)
    assert "__b" not in pieces.columns and pieces.count() == 1025
    assert {r["id"]: bytes(r["data"]) for r in proof.reassemble(pieces, "id").collect()} == {1: data, 2: b""}


def test_proofs_of_logs_of_any_size(spark):
    """A path is that of a plain tree, through blocks of any height; paths aren't left to be broadcast by their estimated size."""
    import hashlib

    sizes = (1, 2, 3, 7, 16, 17, 33, 70)
    digest = lambda *x: hashlib.sha256(b"".join(x)).digest()
    trees, want = {}, {}
    for n in sizes:
        level, paths = [digest(b"%d %d" % (n, i)) for i in range(n)], [[] for _ in range(n)]
        trees[str(n)], height = level, 0
        while len(level) > 1:
            for i, path in enumerate(paths):
                other = i >> height ^ 1
                if other < len(level):
                    path.append((height, level[other], other % 2 == 1))
            level, height = [digest(b"\x01", *level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)], height + 1
        want |= {(str(n), i): path for i, path in enumerate(paths)}
    leaves = spark.createDataFrame([(log, i, h) for log, level in trees.items() for i, h in enumerate(level)], "log_id string, idx long, hash binary")
    for step in (1, 2, 3, 8):
        found = proof.proved(leaves, step=step)
        assert {(r["log_id"], r["idx"]): [(x["depth"], bytes(x["sibling"]), x["right"]) for x in r["path"]] for r in found.collect()} == want
    assert "BroadcastHashJoin" not in proof.proved(leaves, step=3)._jdf.queryExecution().executedPlan().toString()


def test_more_nodes_than_ten_thousand(spark):
    """Every key has the node of largest weight of all, and in the order of failover it stands first; nothing is refused."""
    members = list(range(12_000))
    keys, nodes = spark.createDataFrame([(f"k{i}",) for i in range(9)], "key string"), spark.createDataFrame([(m,) for m in members], "node long")
    mixed = hashing.mix64(np.array(members, np.uint64))
    want = {k: np.argsort(~hashing.mix64(hashing.fnv1a(pd.Series([k])) ^ mixed), kind="stable").tolist() for k, in keys.collect()}
    found = {}
    for r in routing.preference(keys, nodes).orderBy("key", "rank").collect():
        found.setdefault(r["key"], []).append(r["node"])
    assert found == want
    now, less = routing.route(keys, nodes), routing.route(keys, nodes.where("node % 10 <> 3"))
    assert {r["key"]: r["node"] for r in now.collect()} == {k: order[0] for k, order in want.items()}
    assert {r["key"]: r["new"] for r in routing.moved(now, less).collect()} == {k: next(m for m in order if m % 10 != 3) for k, order in want.items() if order[0] % 10 == 3}


def test_what_ends_a_transaction_is_found_in_one_pass(spark, sf):
    """A frame that ends with its partition is computed anew for each row, so the work would grow with the square of an id's events."""
    from courier.plans import queries

    plan = queries.QUERIES["broker_visible"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "window" in plan and "unboundedfollowing" not in plan
