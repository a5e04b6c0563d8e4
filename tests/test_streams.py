"""Streams: the gate across restarts, exactly-once landing, sources and sinks."""

import http.server
import os
import threading

import pytest
from pyspark.sql import functions as F

from courier.operators import admit, contract, landing
from courier.sources import datasources, lines
from courier.streaming import gate

ARRIVAL = "stream string, arrival long, seq long, key string"


def test_the_gate_survives_restarts(spark, tmp_path, sf):
    from courier.plans.tables import redelivered

    rows = redelivered(spark, sf).select(F.col("stream").cast("string").alias("stream"), "arrival", "seq", "key").where("cast(stream as int) % 20 = 0").orderBy("arrival").collect()
    want = {(r["stream"], r["arrival"]): r["disposition"] for r in admit.admit(spark.createDataFrame(rows, ARRIVAL)).collect()}
    third = len(rows) // 3
    for n in range(3):  # each round is a query of its own over the same checkpoint
        spark.createDataFrame(rows[n * third : (n + 1) * third if n < 2 else None], ARRIVAL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = gate.admit_stream(spark.readStream.schema(ARRIVAL).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["stream"], r["arrival"]): r["disposition"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want


def test_batches_land_once(spark, tmp_path):
    schema = "stream string, watermark long, value string"
    target = landing.LandingTable(spark, str(tmp_path / "t"))

    def drop(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        gate.ingest(spark, str(tmp_path / "in"), schema, contract.Contract(64, b"evt:"), target, str(tmp_path / name)).awaitTermination()

    drop([("s", 2, "evt:a"), ("s", 2, "evt:b"), ("bad", 1, "evt:x"), ("bad", 1, "nope")], "check")
    drop([("s", 3, "evt:c")], "check")
    drop([("u", 1, "evt:d")], "lost")  # a lost checkpoint reads everything again
    got = sorted((r["stream"], r["value"]) for r in target.read().collect())
    assert got == [("s", "evt:a"), ("s", "evt:b"), ("s", "evt:c"), ("u", "evt:d")]


@pytest.fixture
def server():
    got = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = b"evt:one\r\n\nevt:two\n" if self.path.startswith("/ok") else b""
            self.send_response(200 if self.path.startswith("/ok") else 404)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):
            got.append(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200 if self.path == "/ok" else 500)
            self.end_headers()

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", got
    s.shutdown()


def test_http_source_and_webhook(spark, server):
    url, got = server
    datasources.register(spark)
    rows = spark.read.format("http_lines").option("url", f"{url}/ok?a=1 {url}/ok").load().collect()
    assert sorted(r["value"] for r in rows) == ["evt:one", "evt:one", "evt:two", "evt:two"]
    with pytest.raises(Exception, match="404"):
        spark.read.format("http_lines").option("url", f"{url}/none").load().collect()
    out = spark.createDataFrame([("evt:a",), ("evt:b",)], "value string").coalesce(1)
    out.write.format("webhook").option("url", f"{url}/ok").mode("append").save()
    assert got == [b"evt:a\nevt:b\n"]
    with pytest.raises(Exception, match="500"):
        out.write.format("webhook").option("url", f"{url}/fail").mode("append").save()


def test_urls():
    assert datasources.Target.parse("http://h") == datasources.Target("h", 80, "/")
    assert datasources.Target.parse("http://h:81/a?b=c") == datasources.Target("h", 81, "/a?b=c")
    for bad in ("https://h", "h/a", "http://"):
        with pytest.raises(ValueError):
            datasources.Target.parse(bad)


def test_framed_log(spark, tmp_path):
    datasources.register(spark)
    path = str(tmp_path / "log")
    for part in (range(5), range(5, 8)):
        spark.createDataFrame([(f"v{i}".encode(),) for i in part], "value binary").coalesce(1).write.format("framed_log").mode("append").save(path)
    rows = spark.read.format("framed_log").load(path).orderBy("byte_offset").collect()
    assert [bytes(r["value"]).decode() for r in rows] == [f"v{i}" for i in range(8)]
    names = sorted(os.listdir(path))
    assert names == ["0" * 20 + ".seg", f"{50:020d}.seg"]
    with open(os.path.join(path, names[0]), "r+b") as f:  # a corrupt frame hides the rest of its segment only
        f.seek(24)
        f.write(b"?")
    assert [bytes(r["value"]).decode() for r in spark.read.format("framed_log").load(path).orderBy("byte_offset").collect()] == ["v0", "v1", "v5", "v6", "v7"]


def test_lines(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"a\r\n\nb\nc")
    assert sorted(r["value"] for r in lines.line_file(spark, str(tmp_path / "f")).collect()) == ["a\r", "b", "c"]
    lines.append_lines(lines.line_file(spark, str(tmp_path / "f")), str(tmp_path / "out"))
    lines.append_lines(lines.line_file(spark, str(tmp_path / "f")), str(tmp_path / "out"))
    assert lines.line_file(spark, str(tmp_path / "out")).count() == 6
    body = spark.createDataFrame([("x\r\n\ny\r\r\n",)], "body string")
    assert [r["value"] for r in lines.split_body(body).collect()] == ["x", "y\r"]
    assert [bytes(r["value"]) for r in lines.resolve(spark, [], "p\r\nq\n").collect()] == [b"p", b"q"]
    assert lines.resolve(spark, []).count() == 2 and lines.inline(spark, ["a", b"b"]).count() == 2
    assert [r["length"] for r in lines.blobs(spark, str(tmp_path), "f").collect()] == [7]


def test_streamed_lines_and_objects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("one\n\ntwo\n")
    for name, source in (("l", lines.stream_lines(spark, str(tmp_path / "in"))), ("b", lines.stream_blobs(spark, str(tmp_path / "in")))):
        source.writeStream.format("memory").queryName(f"t_{name}").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("t_l").count() == 2 and spark.table("t_b").count() == 1


def test_objects_by_route_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([("r", "s", 1), ("r", "t", 2)], "route string, stream string, seq long")
    lines.put_objects(rows, str(tmp_path / "o"))
    lines.put_objects(rows.where("stream = 's'").withColumn("seq", F.lit(9).cast("long")), str(tmp_path / "o"))
    assert sorted((r["stream"], r["seq"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [("s", 9), ("t", 2)]


def test_group_membership_goes_on_after_a_restart(spark, tmp_path):
    from courier.operators import groups
    from courier.streaming.groups import membership_stream

    schema = "ord long, now_ms long, kind string, group string, member string, generation int, session_ms int"
    plan = [("join", "a", -1), ("join", "b", -1), ("heartbeat", "a", 1), ("sync", "a", 1), ("heartbeat", "b", 1), ("leave", "a", 1), ("heartbeat", "b", 1), ("heartbeat", "b", 2)]
    rows = [(n, n * 1600, k, g, m, e, 60_000) for n, (k, m, e) in enumerate(plan) for g in ("x", "y")]
    want = {(r["group"], r["ord"]): (r["code"], r["state"], r["current_generation"], r["leader"], r["members"]) for r in groups.membership(spark.createDataFrame(rows, schema)).collect()}
    for part in (rows[:6], rows[6:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = membership_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["group"], r["ord"]): (r["code"], r["state"], r["current_generation"], r["leader"], r["members"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want
