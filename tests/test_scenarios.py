"""Small exact scenarios of the data model, and operators against plain Python."""

import hashlib
import hmac
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from courier import commands
from courier.functions import codec, hashing
from courier.operators import admit, broker, contract, envelope, erasure, groups, landing, log, offsets, proof, ranking, routing, stats, txn
from courier.sources import spec

D, DUP = "Delivered", "Duplicate"


def gate(arrivals, **options):
    g = admit.Gate(**options)
    return [g.offer(s, k) for s, k in arrivals], g


# Admission


@pytest.mark.parametrize(
    "arrivals,want,watermark",
    [
        ([(0, 0), (0, 0)], [D, DUP], 1),
        ([(3, 3), (3, 3)], [D, DUP], 0),
        ([(0, 0), (1, 1), (2, 2), (1, 999), (0, 0)], [D, D, D, DUP, DUP], 3),
        ([(5, 5), (5, 999)], [D, DUP], 0),
        ([(0, 0), (2, 2), (1, 1)], [D, D, D], 3),
        ([(0, 2), (0, 3), (3, 3)], [D, DUP, D], 1),
    ],
)
def test_gate(arrivals, want, watermark):
    got, g = gate(arrivals)
    assert got == want and g.watermark == watermark


def test_gate_forgets_keys_behind_the_lag():
    got, g = gate([(i, i) for i in range(10)] + [(0, 0)], gc_lag=4)
    assert got == [D] * 10 + [DUP] and (g.watermark, g.floor) == (10, 6)
    assert g.offer(10, 2) == D  # a forgotten key may come again under a new number
    assert g.offer(11, 9) == DUP


def test_gate_gives_up_on_a_gap_beyond_the_horizon():
    got, g = gate([(0, 0), *((i, i) for i in range(2, 6)), (1, 1)], horizon=3)
    assert got == [D] * 5 + [DUP] and g.watermark == 6


def test_checkpoint_restores_the_gate():
    _, g = gate([(0, 0), (1, 1), (4, 4), (7, 7)])
    h = admit.Gate()
    h.restore(*g.checkpoint())
    assert [h.offer(*x) for x in [(1, 1), (4, 9), (9, 7), (2, 2), (3, 3)]] == [DUP, DUP, DUP, D, D] and h.watermark == 5
    h.restore(2)
    assert h.watermark == 5


def test_streams_are_independent_and_ordered(spark):
    rng = random.Random(1)
    rows = [(f"s{rng.randrange(5)}", n, rng.randrange(30), f"k{rng.randrange(40)}") for n in range(400)]
    got = {(r["stream"], r["arrival"]): (r["disposition"], r["low_watermark"], r["gc_floor"]) for r in admit.admit(spark.createDataFrame(rows, "stream string, arrival long, seq long, key string"), horizon=4, gc_lag=3).collect()}
    for s in {r[0] for r in rows}:
        g = admit.Gate(4, 3)
        for _, n, seq, key in sorted(r for r in rows if r[0] == s):
            assert got[s, n] == (g.offer(seq, key), g.watermark, g.floor)


def test_relational_admission_is_exact_for_bound_keys(spark):
    rng = random.Random(2)
    rows = [("s", n, seq := rng.randrange(50), f"k{seq}") for n in range(300)]
    df = spark.createDataFrame(rows, "stream string, arrival long, seq long, key string")
    a = {r["arrival"]: r["disposition"] for r in admit.admit(df).collect()}
    assert a == {r["arrival"]: r["disposition"] for r in admit.admit_bound(df).collect()}


def test_resend_goes_back_to_the_first_unacknowledged(spark):
    out = spark.createDataFrame([("a", i) for i in range(6)] + [("b", 0)], "stream string, pos long")
    acked = spark.createDataFrame([("a", 0), ("a", 2), ("a", 4), ("b", 0)], "stream string, pos long")
    assert sorted((r[0], r[1]) for r in admit.resend(out, acked).collect()) == [("a", i) for i in range(1, 6)]


# Positions


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_positions_in_ranges(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice("aab"), n) for n in rng.sample(range(100), 60)]
    got = ranking.positions(spark.createDataFrame(rows, "k string, n long"), ["k"], "n", "pos", width=width).collect()
    for k in "ab":
        own = sorted(n for x, n in rows if x == k)
        assert sorted((r["n"], r["pos"]) for r in got if r["k"] == k) == [(n, i) for i, n in enumerate(own)]


@pytest.mark.parametrize("kind", ["sparse", "clumped", "tied"])
def test_positions_of_numbers_that_are_not_dense(spark, kind):
    rng = random.Random(kind)
    number = {"sparse": lambda: rng.randrange(1 << 60), "clumped": lambda: int(rng.lognormvariate(0, 9)), "tied": lambda: rng.randrange(3)}[kind]
    rows = [(rng.choice("aab"), number(), i) for i in range(3000)]
    got = ranking.positions(spark.createDataFrame(rows, "k string, n long, i long"), ["k"], "n", "pos", ties=["i"], width=None).collect()
    for k in "ab":
        own = sorted((n, i) for x, n, i in rows if x == k)
        assert sorted((r["n"], r["i"], r["pos"]) for r in got if r["k"] == k) == [(*x, at) for at, x in enumerate(own)]


@pytest.mark.parametrize("spread", [lambda rng: rng.randrange(1 << 60), lambda rng: int(rng.lognormvariate(0, 9))])
def test_quantile_ranges_are_even(spark, spread):
    """However the numbers of a hot key lie, no range holds much more than its share, and their number doesn't grow."""
    rng = random.Random(4)
    rows = [(1, n) for n in {spread(rng) + (i << 40) for i in range(20_000)}]
    sizes = [r["count"] for r in ranking.quantile_ranges(spark.createDataFrame(rows, "k int, n long"), ["k"], "n", 4).groupBy("__range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * len(rows) / 16


def test_newest(spark):
    df = spark.createDataFrame([("a", i * 40_000) for i in range(20)] + [("b", 1)], "k string, n long")
    assert sorted((r["k"], r["n"]) for r in ranking.newest(df, ["k"], "n", 3).collect()) == [("a", 680_000), ("a", 720_000), ("a", 760_000), ("b", 1)]


# Contracts, logs, offsets


def test_contract(spark):
    c = contract.Contract(8, b"evt:")
    rows = [(b"",), (b"abc",), (b"evt:",), (b"evt:1234",), (b"evt:12345",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "v binary").select(c.accepts(F.col("v"))).collect()] == [False, False, True, True, False, False]
    assert c.fingerprint == hashlib.sha256((8).to_bytes(8, "little") + b"evt:").hexdigest()


@pytest.mark.parametrize("text,want", [("1..3", (1, 3)), ("1..=3", (1, 4)), ("all", (0, 5)), ("2..2", (2, 2)), ("3..1", None), ("0..6", None), ("0..=5", None), ("1..", None), ("..3", None), ("x..y", None)])
def test_ranges(text, want):
    if want is None:
        with pytest.raises(ValueError):
            log.parse_range(text, 5)
    else:
        assert log.parse_range(text, 5) == want


@pytest.mark.parametrize("start,cap,want", [(0, 1, 1), (0, 150, 2), (0, 200, 2), (0, 201, 3), (1, 150, 2), (3, 100, 0), (-1, 100, 0), (0, 0, 1)])
def test_fetch_includes_the_record_that_reaches_the_cap(spark, start, cap, want):
    l = spark.createDataFrame([("t", 0, i, "x" * 100) for i in range(3)], "topic string, partition int, offset long, value string")
    assert log.fetch(l, start, cap).count() == want


def test_offsets_go_on_from_a_base(spark):
    r = spark.createDataFrame([("t", 0, i) for i in (5, 3, 9)] + [("u", 0, 1)], "topic string, partition int, arrival long")
    base = spark.createDataFrame([("t", 0, 10)], "topic string, partition int, next_offset long")
    assert {(x["topic"], x["arrival"]): x["offset"] for x in log.assign_offsets(r, base=base).collect()} == {("t", 3): 10, ("t", 5): 11, ("t", 9): 12, ("u", 1): 0}


def test_as_of_across_ranges(spark):
    rng = random.Random(4)
    starts = [(k, s) for k in "ab" for s in rng.sample(range(500_000), 5)]
    events = [(k, rng.randrange(500_000)) for k in "abc" for _ in range(50)]
    got = log.as_of(spark.createDataFrame(events, "k string, at long"), spark.createDataFrame(starts, "k string, start long"), ["k"], "at", "start").collect()
    assert sorted(map(str, ((r["k"], r["at"], r["start_of"]) for r in got))) == sorted(map(str, ((k, a, max((s for x, s in starts if x == k and s <= a), default=None)) for k, a in events)))


def test_rotation_folds_each_log(spark):
    rng = random.Random(5)
    rows = [(t, 0, i, "x" * rng.randint(0, 60)) for t in "ab" for i in range(50)]
    got = {(r["topic"], r["offset"]): (r["segment"], r["byte_offset"]) for r in log.rotate(spark.createDataFrame(rows, "topic string, partition int, offset long, value string"), 100).collect()}
    for t in "ab":
        at = begin = 0
        for _, _, i, v in (r for r in rows if r[0] == t):
            if at - begin >= 100:
                begin = at
            assert got[t, i] == (begin, at)
            at += len(v) + 8


def test_frames_end_at_the_first_bad_one():
    data = envelope.encode_frames([b"one", b"", b"three"])
    assert [(b, g) for _, b, g in envelope.decode_frames(data)] == [(b"one", True), (b"", True), (b"three", True)]
    assert [g for _, _, g in envelope.decode_frames(data[:-1])] == [True, True, False]
    broken = bytearray(data)
    broken[5] ^= 1
    assert [g for _, _, g in envelope.decode_frames(bytes(broken))] == [False]


def test_last_commit_wins(spark):
    c = spark.createDataFrame([("g", "t", 0, 7, 1), ("g", "t", 0, 3, 2), ("g", "t", 1, -5, 1)], "group string, topic string, partition int, offset long, ord long")
    assert {r["partition"]: r["committed"] for r in offsets.latest(c).collect()} == {0: 3, 1: 0}


def test_broker(spark):
    rows = spark.createDataFrame([("t", 0, i, f"evt:{i}") for i in range(5)] + [("u", 0, 9, "bad")], "topic string, partition long, arrival long, value string")
    b, answer = broker.Broker.empty(spark, contract.Contract(64, b"evt:")).produce(rows)
    assert {(r["topic"], r["code"], r["base_offset"], r["records"]) for r in answer.collect()} == {("t", 0, 0, 5), ("u", 87, -1, 1)}
    b, answer = b.produce(rows.where("topic = 't'"))
    assert answer.first()["base_offset"] == 5
    b = b.commit(spark.createDataFrame([("g", "t", 0, 8, 1), ("g", "t", 0, 99, 2)], "group string, topic string, partition long, offset long, ord long"))
    assert sorted(r["offset"] for r in b.poll("g", 1000).collect()) == [8, 9]
    assert b.fetch(9, 1000).count() == 1 and b.bounds().first()["latest"] == 10


# Landing


def land(table, spark, rows, mode):
    table.land(spark.createDataFrame(rows, "stream string, watermark long, pos long, value string"), mode)


def test_positional_landing_replays(spark, tmp_path):
    t = landing.LandingTable(spark, str(tmp_path / "t"))
    for _ in range(3):
        land(t, spark, [("s", 3, i, v) for i, v in enumerate("abc")], "position")
    for _ in range(2):
        land(t, spark, [("s", 4, i, v) for i, v in enumerate("abcd")], "position")
    assert sorted(r["value"] for r in t.read().collect()) == list("abcd")
    assert {r["stream"]: r["watermark"] for r in t.watermarks().collect()} == {"s": 4}


def test_sequence_landing_with_an_empty_range(spark, tmp_path):
    t = landing.LandingTable(spark, str(tmp_path / "t"))
    for rows in ([("s", 3, i, v) for i, v in enumerate("abc")], [("s", 5, None, None)], [("s", 6, 0, "f")]):
        for _ in range(2):
            land(t, spark, rows, "sequence")
    assert sorted(r["value"] for r in t.read().where("value is not null").collect()) == list("abcf")
    assert t.watermarks().first()["watermark"] == 6


# Transactions and groups


def test_commit_shows_the_exact_epoch(spark):
    b = spark.createDataFrame([(1, 7, 0, "p0a"), (2, 7, 0, "p1a"), (3, 7, 1, "doomed"), (4, 7, 2, "legit"), (5, 7, 1, "zombie"), (9, 7, 2, "late"), (6, 7, 3, "open")], "ord long, producer_id long, epoch int, value string")
    m = spark.createDataFrame([(2, 7, 0, True), (3, 7, 1, False), (8, 7, 2, True)], "ord long, producer_id long, epoch int, commit boolean").withColumn("ord", F.col("ord") + F.lit(0.5).cast("long") + F.when(F.col("epoch") == 0, 1).otherwise(0))
    assert sorted(r["value"] for r in txn.visible(b, m).collect()) == ["legit", "p0a", "p1a"]
    assert [r["value"] for r in txn.pending(b, m).collect()] == ["open"]


def test_claims_are_all_or_nothing(spark):
    asks = spark.createDataFrame([(1, "a", "t", 0), (1, "a", "t", 1), (2, "b", "t", 5)], "request long, transactional_id string, topic string, partition int")
    held = spark.createDataFrame([("x", "t", 1), ("b", "t", 5)], "transactional_id string, topic string, partition int")
    assert {r["request"]: r["code"] for r in txn.claim_conflicts(asks, held).collect()} == {1: 51, 2: 0}


def test_epochs_grow_and_producers_change_after_the_last(spark):
    got = txn.init_producers(spark.createDataFrame([("a", i) for i in range(3)] + [("b", 0)], "transactional_id string, ord long")).collect()
    assert sorted((r["transactional_id"], r["epoch"]) for r in got) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]


def test_protocol_choice(spark):
    m = spark.createDataFrame([(1, "a", ["x", "y"]), (1, "b", ["y", "z"]), (2, "c", ["p"]), (2, "d", ["q"])], "group int, member string, protocols array<string>")
    assert {r["group"]: r["protocol"] for r in groups.protocol(m).collect()} == {1: "y", 2: "p"}


def test_group_states():
    g = groups.Coordinator(3000)
    assert g.apply(0, "join", "b") == 0 and g.state == groups.PREPARING and g.generation == 1
    assert g.apply(100, "join", "a") == 0 and g.generation == 1
    assert g.apply(200, "sync", "a", 1) == 27
    assert g.apply(3000, "heartbeat", "b", 1) == 27 and g.leader == "a"
    assert g.apply(3100, "sync", "a", 1) == 0 and g.state == groups.STABLE
    assert g.apply(3200, "heartbeat", "b", 1) == 0 and g.apply(3200, "heartbeat", "b", 9) == 22 and g.apply(3200, "heartbeat", "z", 1) == 25
    assert g.apply(3300, "leave", "a") == 0 and g.generation == 2 and g.state == groups.PREPARING
    assert g.apply(3400, "leave", "b") == 0 and g.state == groups.EMPTY


def test_membership_runs_each_group_by_itself(spark):
    rows = [(n, n * 1000, k, f"g{n % 2}", m, -1, 50_000) for n, (k, m) in enumerate([("join", "a"), ("join", "x"), ("join", "b"), ("leave", "x"), ("heartbeat", "a"), ("heartbeat", "x")])]
    got = {r["ord"]: (r["code"], r["members"]) for r in groups.membership(spark.createDataFrame(rows, "ord long, now_ms long, kind string, group string, member string, generation int, session_ms int")).collect()}
    assert got == {0: (0, 1), 2: (0, 2), 4: (22, 2), 1: (0, 1), 3: (0, 0), 5: (25, 0)}


# Routing


def plain_route(key, nodes):
    mask = (1 << 64) - 1

    def mix(x):
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * c & mask
        return x ^ x >> 33

    h = 0xCBF29CE484222325
    for b in key.encode():
        h = (h ^ b) * 0x100000001B3 & mask
    return sorted(nodes, key=lambda n: (-mix(h ^ mix(n)), n))


def test_rendezvous(spark):
    keys, nodes = [f"key-{i}é" for i in range(60)] + [""], [1, 2, 5, 9]
    kf, nf = spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(n,) for n in [*nodes, 5]], "node long")
    assert {r["key"]: r["node"] for r in routing.route(kf, nf).collect()} == {k: plain_route(k, nodes)[0] for k in keys}
    ranked = routing.preference(kf, nf).collect()
    assert {(r["key"], r["rank"], r["node"]) for r in ranked} == {(k, i, n) for k in keys for i, n in enumerate(plain_route(k, nodes))}
    assert {r["node"] for r in routing.route(kf, nf.limit(0)).collect()} == {None}
    moved = routing.moved(routing.route(kf, nf), routing.route(kf, nf.where("node <> 9"))).collect()
    assert moved and all(r["old"] == 9 for r in moved)


# Hashes and codecs


def test_checksums(spark):
    df = spark.createDataFrame([("123456789",), ("",), (None,), ("é" * 40,)], "v string")
    got = df.select(F.crc32(F.col("v").cast("binary")), hashing.crc32c("v")).collect()
    assert got[0][0] == 3421780262 and got[0][1] == 0xE3069283 and got[1][1] == 0 and got[2][1] is None
    assert got[3][1] == hashing.crc32c_bytes(("é" * 40).encode())


def test_hmac_of_the_engine(spark):
    # RFC 4231, cases 1, 2 and 6
    for key, data, want in ((b"\x0b" * 20, "Hi There", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"), (b"Jefe", "what do ya want for nothing?", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"), (b"\xaa" * 131, "Test Using Larger Than Block-Size Key - Hash Key First", "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54")):
        assert spark.createDataFrame([(data,)], "d string").select(hashing.hmac_sha256(key, F.col("d"))).first()[0] == want == hmac.new(key, data.encode(), hashlib.sha256).hexdigest()


def test_numbers_as_bytes(spark):
    for n in (0, 1, 255, 256, 2**40 + 7, 2**63 - 1, -1):
        r = spark.createDataFrame([(n,)], "n long").select(hashing.le64(F.col("n")), hashing.be(F.col("n"), 8), hashing.be(F.col("n"), 4), hashing.zigzag(F.col("n")), hashing.unzigzag(hashing.zigzag(F.col("n")))).first()
        assert bytes(r[0]) == struct.pack("<q", n) and bytes(r[1]) == struct.pack(">q", n) and bytes(r[2]) == struct.pack(">I", n & 0xFFFFFFFF)
        assert r[4] == n


def test_text_escapes(spark):
    r = spark.createDataFrame([("a\tb\\c\nd\re",), ("x\r",), ("x\r\r",)], "t string").select(hashing.copy_escape(F.col("t")), hashing.strip_cr(F.col("t"))).collect()
    assert r[0][0] == "a\\tb\\\\c\\nd\\re" and [x[1] for x in r[1:]] == ["x", "x\r"]


@pytest.mark.parametrize("compress", [False, True])
def test_record_batches(compress):
    wire = codec.write_batch([b"a", None, b"", b"xyz" * 100], 5, 2, 40, True, compress)
    got = codec.decoded(wire)
    assert got["values"] == [b"a", b"", b"xyz" * 100] and got["error"] == 0
    assert (got["producer_id"], got["epoch"], got["base_sequence"], got["count"], got["transactional"]) == (5, 2, 40, 4, True)
    broken = bytearray(wire)
    broken[-1] ^= 1
    assert codec.decoded(bytes(broken))["error"] == 2 and codec.decoded(wire[:-3])["error"] == 87 and codec.decoded(None)["error"] == 87
    two = codec.decoded(wire + codec.write_batch([b"z"]))
    assert two["values"][-1] == b"z" and two["producer_id"] is None
    assert codec.decoded(codec.write_batch([b"z"]))["producer_id"] is None


def test_older_messages():
    body = struct.pack(">bq", 0, 0) + struct.pack(">i", -1) + struct.pack(">i", 3) + b"old"
    message = struct.pack(">Ib", 0, 1) + body
    assert codec.decoded(struct.pack(">qi", 0, len(message)) + message)["values"] == [b"old"]


def test_varints():
    for n in (0, -1, 1, 63, 64, -65, 300, 2**31, -(2**40)):
        assert codec.read_varint(codec.write_varint(n), 0) == (n, len(codec.write_varint(n)))
    with pytest.raises(ValueError):
        codec.read_varint(b"\xff" * 11, 0)


# Envelopes, proofs, shards

KEY, SIGN, ROUTE = b"k" * 32, b"s" * 32, b"r" * 16


@pytest.fixture(scope="module")
def sealed(spark):
    rows = spark.createDataFrame([(b, o, f"evt:{b}-{o}") for b in range(6) for o in range(3)], "batch_id long, ord int, value string")
    return envelope.seal(envelope.framed(rows), contract.Contract(64, b"evt:"), KEY, SIGN, ROUTE, F.lit(b"st"), F.col("batch_id"), F.col("batch_id").cast("string"), F.col("payload")).cache()


def test_envelopes_open(sealed):
    got = {r["batch_id"]: r for r in envelope.opened(sealed, contract.Contract(64, b"evt:"), KEY, SIGN, ROUTE).collect()}
    assert {b: [bytes(v) for v in r["values"]] for b, r in got.items()} == {b: [f"evt:{b}-{o}".encode() for o in range(3)] for b in range(6)}
    assert all(r["reason"] is None for r in got.values())


@pytest.mark.parametrize("change,options,want", [("payload", {}, "bad_seal"), ("seal", {}, "bad_seal"), (None, {"route": b"x" * 16}, "wrong_route"), (None, {"contract": contract.Contract(63, b"evt:")}, "contract_mismatch"), (None, {"key": b"z" * 32}, "open_failed"), (None, {"sign": b"z" * 32}, "bad_seal")])
def test_rejections(sealed, change, options, want):
    df = sealed.withColumn(change, F.concat(change, F.lit(b"!"))) if change else sealed
    got = envelope.opened(df, options.get("contract", contract.Contract(64, b"evt:")), options.get("key", KEY), options.get("sign", SIGN), options.get("route", ROUTE))
    assert {r["reason"] for r in got.collect()} == {want}


def test_sealing_again_gives_the_same_bytes(sealed, spark):
    rows = spark.createDataFrame([(2, o, f"evt:2-{o}") for o in (2, 0, 1)], "batch_id long, ord int, value string")
    again = envelope.seal(envelope.framed(rows), contract.Contract(64, b"evt:"), KEY, SIGN, ROUTE, F.lit(b"st"), F.col("batch_id"), F.col("batch_id").cast("string"), F.col("payload")).first()
    assert again["payload"] == sealed.where("batch_id = 2").first()["payload"]


def test_framing():
    assert envelope.unframe_values(envelope.frame_values([b"a", b"", b"ccc"])) == [b"a", b"", b"ccc"]
    for bad in (b"", b"\1\0\0\0", envelope.frame_values([b"a"]) + b"x", struct.pack("<II", 1, 9) + b"short"):
        assert envelope.unframe_values(bad) is None


def test_keyed_records(spark):
    df = spark.createDataFrame([("key", "payload"), ("", "x"), ("k" * 300, "")], "k string, p string").withColumn("r", envelope.keyed_record(F.col("k"), F.col("p")))
    key, payload = envelope.split_keyed("r")
    assert all((r[0], r[1]) == (bytes(r[2]).decode(), bytes(r[3]).decode()) for r in df.select("k", "p", key, payload).collect())


def plain_root(hashes):
    while len(hashes) > 1:
        hashes = [hashlib.sha256(b"\x01" + hashes[i] + hashes[i + 1]).digest() if i + 1 < len(hashes) else hashes[i] for i in range(0, len(hashes), 2)]
    return hashes[0]


def test_merkle_logs(spark):
    rows = [(f"log{n}", i, hashlib.sha256(f"{n}-{i}".encode()).digest()) for n in (1, 2, 3, 5, 8, 13) for i in range(n)]
    leaves = spark.createDataFrame(rows, "log_id string, idx long, hash binary")
    want = {f"log{n}": plain_root([h for l, _, h in rows if l == f"log{n}"]).hex() for n in (1, 2, 3, 5, 8, 13)}
    assert {r["log_id"]: r["root"] for r in proof.roots(leaves).collect()} == want
    proofs = proof.inclusion_proofs(leaves).join(leaves, ["log_id", "idx"]).join(proof.heads(leaves), "log_id")
    ok = proof.included(F.col("hash"), F.col("idx"), F.col("size"), F.col("path"), F.unhex("root"))
    assert proofs.where(ok).count() == len(rows)
    assert proofs.where(proof.included(F.unhex(F.sha2("hash", 256)), F.col("idx"), F.col("size"), F.col("path"), F.unhex("root"))).count() == 0


def test_receipt_names_the_first_failure(spark):
    df = spark.createDataFrame([(True, True, True), (True, False, False), (False, True, False)], "a boolean, b boolean, c boolean")
    t = F.lit(True)
    assert [r[0] for r in df.select(proof.receipt_failure(F.col("a"), t, F.col("b"), t, F.col("c"), t, t)).collect()] == [None, "tree_size", "content"]


def test_chunks(spark):
    blobs = spark.createDataFrame([(1, b"x" * 250), (2, b""), (3, b"y" * 200), (4, None)], "id long, data binary")
    c = proof.chunks(blobs, "id", "data", 100)
    assert sorted((r["id"], r["idx"], r["total"], len(r["bytes"])) for r in c.collect()) == [(1, 0, 3, 100), (1, 1, 3, 100), (1, 2, 3, 50), (2, 0, 1, 0), (3, 0, 2, 100), (3, 1, 2, 100)]
    part = c.where("not (id = 1 and idx = 1)")
    assert [(r["id"], r["idx"]) for r in proof.missing(part, c.select("id", "total").distinct(), "id").collect()] == [(1, 1)]
    assert {r["id"]: bytes(r["data"]) for r in proof.reassemble(part.unionAll(part), "id").collect()} == {2: b"", 3: b"y" * 200}


@pytest.mark.parametrize("k,m", [(1, 1), (4, 2), (5, 3), (10, 4)])
def test_any_k_shards_restore(k, m):
    rng, code = random.Random(k), erasure.Code(k, m)
    for size in (0, 1, k, 100, 1001):
        data = rng.randbytes(size)
        shards = code.encode(data)
        for _ in range(6):
            use = rng.sample(range(k + m), k)
            assert code.restore({i: shards[i] for i in use}, size) == data
        assert code.restore({i: shards[i] for i in range(k - 1)}, size) is None
    assert code.overhead == (k + m) / k


def test_field_tables():
    a = np.arange(1, 256)
    assert (erasure.PRODUCT[a, erasure.INVERSE[a]] == 1).all() and erasure.PRODUCT[2, 0x80] == 0x1D and not erasure.PRODUCT[0].any()


def test_shards_as_tables(spark):
    code = erasure.Code(3, 2)
    shards = erasure.encode(spark.createDataFrame([(1, b"hello world"), (2, b""), (3, None)], "id long, value binary"), code)
    assert shards.count() == 10
    left = shards.where("(id = 1 and idx in (0, 3, 4)) or (id = 2 and idx < 2)")
    assert {r["id"]: r["value"] and bytes(r["value"]) for r in erasure.restore(left, code).collect()} == {1: b"hello world", 2: None}


# Statistics, commands, route files


def test_nearest_rank(spark):
    rng = random.Random(6)
    samples = [("a", rng.randrange(50)) for _ in range(1000)] + [("b", 7)]
    got = {r["g"]: r for r in stats.nearest_rank(spark.createDataFrame(samples, "g string, v long"), ["g"], "v").collect()}
    own = sorted(v for g, v in samples if g == "a")
    assert [got["a"][n] for n in stats.PERMILLES] == [own[(len(own) - 1) * p // 1000] for p in stats.PERMILLES.values()]
    assert got["b"]["p999"] == got["b"]["max"] == 7 and got["a"]["count"] == 1000


@pytest.mark.parametrize("accuracy", [3, 100, 10_000])
def test_nearest_rank_of_heavy_tails(spark, accuracy):
    rng = random.Random(accuracy)
    samples = [(rng.choice(["a", "a", None]), rng.choice([None, rng.lognormvariate(0, 5), float(rng.randrange(4))])) for _ in range(4000)] + [("none", None), ("inf", float("inf"))]
    df = stats.nearest_rank(spark.createDataFrame(samples, "g string, v double"), ["g"], "v", accuracy=accuracy)
    got = {r["g"]: r for r in df.collect()}
    assert set(got) == {"a", None, "inf"}
    for g in got:
        own = sorted(v for x, v in samples if x == g and v is not None)
        assert [got[g][n] for n in stats.PERMILLES] == [own[(len(own) - 1) * p // 1000] for p in stats.PERMILLES.values()]
        assert got[g]["max"] == own[-1] and got[g]["count"] == len(own)


def test_nearest_rank_of_a_hot_group_ranks_ranges(spark):
    """No window over a group alone orders its values: those are ranked range by range."""
    plan = stats.nearest_rank(spark.range(1000).selectExpr("1 as g", "rand(1) as v"), ["g"], "v")._jdf.queryExecution().optimizedPlan().toString()
    assert all("__range" in line.split("windowspecdefinition")[1] for line in plan.splitlines() if "Window" in line and "__v" in line.split("windowspecdefinition")[1])


def test_window_trace(spark):
    rtts = [20.0, 25.0, 35.0, 18.0, 29.0]
    got = stats.window_trace(spark.createDataFrame([("l", i, r) for i, r in enumerate(rtts)], "link string, ord long, rtt_ms double")).orderBy("ord").collect()
    base, size, want = float("inf"), 10.0, []
    for r in rtts:
        base = min(base, r)
        size = max(1.0, size * 0.85) if r - base > 10 else size + 1
        want.append((base, size))
    assert [(r["base_ms"], r["window"]) for r in got] == want


def test_summaries(spark):
    r = spark.createDataFrame([("sys", 1000, [100.0, None, 300.0], 5.0)], "driver string, messageSize long, publishRate array<double>, aggregatedEndToEndLatency99pct double")
    got = stats.bench_summary(r).first()
    assert got["publish_rate"] == 200 and got["publish_mb"] == 0.2 and got["consume_rate"] == 0 and got["p99"] == 5 and got["p50"] == 0
    s = spark.createDataFrame([("a", "idle", 3.0, 0.0), ("a", "load", 5.0, 50.0), ("a", "load", 7.0, 70.0)], "system string, phase string, rss_mb double, cpu_pct double")
    assert tuple(stats.resource_summary(s).first()) == ("a", 3.0, 6.0, 7.0, 60.0)


ROUTE_FILE = """
[route]
route_id = "000102030405060708090a0b0c0d0e0f"
stream_id = "f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff"
guarantee = "exactly-once"
[onboarding]
max_record_len = 64
required_prefix = "evt:"
[offloading]
max_record_len = 64
required_prefix = "evt:"
"""


def test_route_files(monkeypatch, tmp_path):
    assert commands.validate(ROUTE_FILE)["contract"] == contract.Contract(64, b"evt:").fingerprint
    for bad in (ROUTE_FILE.replace("= 64", "= 63", 1), ROUTE_FILE.replace("0e0f", "0e"), ROUTE_FILE + "required_prefix = 'x'\n", ROUTE_FILE.replace("= 64", "= 0")):
        with pytest.raises(ValueError):
            spec.parse(bad)
    monkeypatch.setenv("COURIER_TEST_KEY", "ab" * 32)
    assert spec.resolve_key("env:COURIER_TEST_KEY") == b"\xab" * 32
    (tmp_path / "k").write_text("cd" * 32 + "\n")
    assert spec.resolve_key(f"file:{tmp_path}/k") == b"\xcd" * 32
    with pytest.raises(ValueError):
        spec.resolve_key(f"file:{tmp_path}/../k")
    assert len(commands.keygen()) == 64 and commands.ticket(spec.parse(ROUTE_FILE), b"k") != commands.ticket(spec.parse(ROUTE_FILE), b"j")


def test_run_and_replay(spark, tmp_path):
    (tmp_path / "in.txt").write_bytes(b"evt:a\nevt:b\n\nevt:c\r\n")
    rows = commands.read_file(spark, str(tmp_path / "in.txt"))
    assert [r["value"] for r in rows.orderBy("pos").collect()] == ["evt:a", "evt:b", "evt:c\r"]
    t = landing.LandingTable(spark, str(tmp_path / "t"))
    route = spec.parse(ROUTE_FILE)
    assert commands.run(spark, route, rows, t, "s") == {"boarded": 3, "landed": 3, "dead": 0}
    assert commands.run(spark, route, rows, t, "s") == {"boarded": 3, "landed": 0, "dead": 0}
    assert t.read().count() == 3
    assert commands.run(spark, route, rows.withColumn("value", F.lit("no")), t, "s")["dead"] == 3
    assert commands.replay(ranking.positions(rows.withColumn("k", F.lit(0)), ["k"], "pos", "at"), "1..=1", "at").count() == 1


def test_sink_choice():
    assert commands.sink_kind("t", "w", "f", False, True) == "table_exactly_once" and commands.sink_kind("t", None, None, True, True) == "table"
    assert commands.sink_kind(None, "w", "f", False, True) == "webhook" and commands.sink_kind(None, None, "f", False, True) == "file" and commands.sink_kind(None, None, None, False, True) == "memory"


def test_identifiers():
    assert [contract.identifier_ok(n) for n in ("a_1", "_x", "1a", "", "a-b", "é", "x" * 64)] == [True, True, False, False, False, False, False]


def test_frame_crc_matches_zlib():
    head = struct.pack("<I", 3) + b"abc"
    assert envelope.encode_frames([b"abc"]) == head + struct.pack("<I", zlib.crc32(head))


def test_rows_that_differ(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert sorted((r["x"], r["side"]) for r in stats.same_rows(a, b).collect()) == [(1, "a"), (3, "b")]
    assert pd.DataFrame(stats.same_rows(a, a).collect()).empty


def test_preference_rows_come_rank_by_rank(spark):
    """Within a task's block of keys the ranks are runs, so files of the whole table stay small."""
    keys = spark.createDataFrame([(f"k{i}",) for i in range(40)], "key string").coalesce(1)
    rows = routing.preference(keys, spark.range(30).withColumnRenamed("id", "node")).collect()
    assert len(rows) == len({(r["key"], r["rank"]) for r in rows}) == len({(r["key"], r["node"]) for r in rows}) == 1200
    assert sum(a["rank"] != b["rank"] for a, b in zip(rows, rows[1:])) < 600
