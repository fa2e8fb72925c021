"""Streams with controlled micro-batches: late rows, stateful operators, live schema changes, sources and sinks."""

import json
import urllib.error
import urllib.request

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace import sources, streaming
from millrace.operators.schema import Field, Schema, SchemaRegistry


class Feed:
    """A file stream to which batches are added one at a time."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, str(folder), schema
        self.n = 0
        folder.mkdir(exist_ok=True)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(self.folder)

    def add(self, rows):
        names = [c.split()[0] for c in self.schema.split(",")]
        with open(f"{self.folder}/{self.n:05d}.json", "w") as f:
            f.writelines(json.dumps(dict(zip([n.strip() for n in names], r, strict=True))) + "\n" for r in rows)
        self.n += 1


def run(df, name, batches, feed, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        for b in batches:
            feed.add(b)
            q.processAllAvailable()
        return sorted(tuple(r) for r in feed.spark.table(name).collect())
    finally:
        q.stop()


def test_tumbling_late_row_and_drain(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "ts long, k string, v long")
    timed = feed.stream().withColumn("at", F.timestamp_seconds("ts"))
    out = streaming.stream_tumbling(timed, "at", "100s", "count, sumi:v", "k").select(F.unix_seconds("window_start").alias("w"), "k", "count", "sumi_v")
    # A batch between the late row and what made it late: the watermark counts from the next batch on.
    got = run(out, "late", [[(10, "a", 1), (300, "a", 1)], [(300, "b", 0)], [(50, "a", 9)], [(10_000, "end", 0)], [(10_000, "end", 0)]], feed)
    assert [r for r in got if r[1] == "a"] == [(0, "a", 1, 1), (300, "a", 1, 1)]


def test_interval_join_stream(spark, tmp_path):
    l, r = Feed(spark, tmp_path / "l", "oid long, ts long, amt long"), Feed(spark, tmp_path / "r", "oid long, ts long, qty long")
    timed = lambda f: f.stream().withColumn("ts", F.timestamp_seconds("ts"))
    joined = streaming.stream_interval_join(timed(l), timed(r), "oid", "ts", "60s").select("oid", "amt", "qty")
    l.add([(1, 100, 10), (2, 200, 20)])
    got = run(joined, "ij", [[(1, 150, 5), (2, 260, 6), (1, 170, 7)]], r)
    assert got == [(1, 10, 5), (2, 20, 6)]


def test_stateful(spark, tmp_path):
    feed = Feed(spark, tmp_path / "d", "k string, t long, seq long")
    timed = feed.stream().withColumn("at", F.timestamp_seconds("t"))
    got = run(streaming.stream_deduplicate(timed, "k", "at", 10).select("t"), "dd", [[("a", 100, 0), ("a", 105, 1), ("a", 111, 2)], [("a", 115, 3), ("a", 122, 4)]], feed)
    assert got == [(100,), (111,), (122,)]
    feed = Feed(spark, tmp_path / "c", "k string, v double, seq long")
    got = run(streaming.stream_count_window(feed.stream(), "k", 2, "v", "seq"), "cw", [[("a", 1.0, 0)], [("a", 2.0, 1), ("a", 3.0, 2), ("b", 1.0, 3)]], feed)
    assert got == [("a", 0, 2, 3.0)]
    feed = Feed(spark, tmp_path / "j", "k string, side string, v long, seq long")
    got = run(streaming.stream_bounded_join(feed.stream(), "k", "side", "L", "R", 1, "seq", "v"), "bj", [[("a", "L", 1, 0), ("a", "L", 2, 1)], [("a", "R", 9, 2), ("b", "R", 8, 3)], [("a", "L", 3, 4)]], feed)
    assert got == [("a", 2, 9), ("a", 3, 9)]


def test_live_schema(spark, tmp_path):
    reg, out = SchemaRegistry(), []
    reg.register(Schema("o", 1, [Field("m", "string"), Field("amount", "int")]))
    feed = Feed(spark, tmp_path / "e", "value string")
    q = feed.stream().writeStream.foreachBatch(streaming.evolving_sink(reg, "o", lambda df, b: out.append([r.asDict() for r in df.collect()]), payload="value")).start()
    feed.add([('{"m":"a","amount":5}',)])
    q.processAllAvailable()
    reg.register(Schema("o", 2, [Field("m", "string"), Field("usd", "float", alias="amount"), Field("region", "string", default="us")]))
    feed.add([('{"m":"b","amount":7}',)])
    q.processAllAvailable()
    q.stop()
    assert [x for x in out if x] == [[{"m": "a", "amount": 5}], [{"m": "b", "usd": 7.0, "region": "us"}]]


def test_sources_and_sinks(spark, tmp_path):
    assert sources.memory(spark, [{"a": 1}, {"a": 2, "b": "x"}]).count() == 2
    with pytest.raises(ValueError):
        sources.memory(spark, [])
    assert sources.memory(spark, pd.DataFrame({"a": [1]})).count() == 1
    g = sources.generator(spark, {"i": "rand:int:3:5", "f": "rand:float:0:1", "c": "choice:x|y", "s": "a${seq}b", "n": "seq", "z": 7}, rows=200)
    rows = g.collect()
    assert {r.i for r in rows} == {3, 4, 5} and {r.c for r in rows} == {"x", "y"} and all(0 <= r.f < 1 for r in rows) and rows[9].s == "a9b" and rows[9].z == 7
    sources.write_ndjson(g, str(tmp_path / "out"))
    assert sources.read_files(spark, str(tmp_path / "out"), "json", g.schema).count() == 200
    with pytest.raises(ValueError):
        sources.read_files(spark, "x", "json")
    assert sources.kafka_options(["a", "b"], "t", partitions=[0, 2]) == {"kafka.bootstrap.servers": "a,b", "startingOffsets": "earliest", "assign": '{"t": [0, 2]}'}
    good, bad = sources.readers.parse_json(spark.createDataFrame([('{"a": 1}',), ("{oops",)], "value string"), "value", spark.createDataFrame([], "a long").schema)
    assert [r.a for r in good.collect()] == [1] and [r.raw for r in bad.collect()] == ["{oops"]
    assert json.loads(sources.to_kafka(spark.createDataFrame([(1, "x")], "a long, b string"), "a").first().value) == {"a": 1, "b": "x"}
    write = sources.idempotent_batch(str(tmp_path / "table"))
    for df in (spark.range(3), spark.range(4)):
        write(df, 0)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 4
    with pytest.raises(ValueError):
        sources.collect_rows(spark.range(5), most=4)


def test_http(spark, tmp_path):
    server = sources.http_landing(str(tmp_path / "land"))
    url = f"http://127.0.0.1:{server.port}/ingest"

    def post(body, method="POST"):
        try:
            return urllib.request.urlopen(urllib.request.Request(url, body, method=method)).status
        except urllib.error.HTTPError as e:
            return e.code

    assert [post(b'[{"a": 1}, {"a": 2}]'), post(b"{}"), post(b"oops"), post(None, "GET")] == [202, 400, 400, 405]
    sources.post_batch(url)(spark.createDataFrame([], "a long"), 0)
    q = server.stream(spark, "a long").writeStream.format("memory").queryName("landed").start()
    q.processAllAvailable()
    q.stop()
    server.close()
    assert sorted(r.a for r in spark.table("landed").collect()) == [1, 2]


def test_quarantine(spark, tmp_path):
    q = streaming.Quarantine(keep=2, path=str(tmp_path / "dlq"))
    q.sink(spark.range(5), 0)
    assert q.total == 5 and len(q.rows) == 2 and spark.read.json(str(tmp_path / "dlq")).count() == 5


def test_observe(spark):
    p = streaming.Progress()
    for ms in range(1, 101):
        p.record("q", 10, 5.0, ms, late=1)
    assert p.figures["q"]["processed"] == 1000 and p.figures["q"]["late"] == 100 and p.figures["q"]["p50_ms"] == 51 and p.figures["q"]["p99_ms"] == 100
    assert 'millrace_rows_total{stage="q"} 1000' in streaming.prometheus(p.figures)
    e = streaming.stamp(spark.range(4), ["id"])
    g = streaming.with_parents(e, [F.col("id") % 2], F.count("*").alias("n"))
    assert g.select(F.size("_parents")).distinct().collect()[0][0] == 2
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("d", "b")], "_rid string, _parent string")
    assert sorted(map(tuple, streaming.ancestors(edges, edges.where("_rid = 'c'")).collect())) == [("c", "a"), ("c", "b")]
    assert sorted(map(tuple, streaming.roots(edges, edges).select("_rid", "ancestor").distinct().collect())) == [("b", "a"), ("c", "a"), ("d", "a")]
    assert [r.id for r in streaming.tap(spark.range(9), "id", 2).collect()] == [8, 7]
