"""Streaming jobs: starts, restarts from a checkpoint, late rows, the runner and the control plane."""

import json
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F
from test_streaming import Feed, run

from millrace import plans, sources, streaming


def wait(true, seconds=60):
    end = time.time() + seconds
    while not true():
        assert time.time() < end
        time.sleep(0.2)


def job(source, *stages, sink=None, **more):
    return {"name": "s", "source": source, "stages": list(stages), "sink": sink or {"type": "memory"}, **more}


def fed(spark, feed):
    plans.register_source("feed", lambda s, **_: feed.stream())


PASS = {"label": "p", "op": "to-rows"}


def test_restart_delivers_once(spark, tmp_path):
    """Four rows; the sink writes them and fails before the batch is acknowledged. The restart writes them again in their place, the one after it nothing."""
    feed = Feed(spark, tmp_path / "in", "id long, v long")
    fed(spark, feed)
    write, calls = sources.idempotent_batch(str(tmp_path / "out")), []

    def deliver(df, batch):
        write(df, batch)
        calls.append(batch)
        if len(calls) == 1:
            raise OSError("lost before the acknowledgement")

    plans.register_sink("once", deliver)
    spec = job({"type": "ref:feed"}, PASS, sink={"type": "ref:once"})
    feed.add([(i, i * 10) for i in range(4)])
    checkpoint = str(tmp_path / "state")
    first = plans.build(spark, spec).start(checkpoint, available=True)
    with pytest.raises(Exception, match="lost before"):
        first.query.awaitTermination()
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("id", "v").collect())
    for _ in range(2):
        plans.build(spark, spec).start(checkpoint, available=True).query.awaitTermination()
        assert read() == [(i, i * 10) for i in range(4)] and calls == [0, 0]
    feed.add([(9, 90)])
    plans.build(spark, spec).start(checkpoint, available=True).query.awaitTermination()
    assert read()[-1] == (9, 90) and calls == [0, 0, 1]


def test_restart_keeps_state(spark, tmp_path):
    """Count windows, and dedup, go on over a restart as if there had been none."""
    rows = [(i, "ab"[i % 2], f"2024-01-01T00:00:{i:02d}Z", i) for i in range(20)]
    timed = {"label": "t", "op": "timestamp", "field": "at"}
    kept = [r[3] for r in rows if r[3] % 4 < 2]
    for n, (stage, want) in enumerate([
        ({"label": "d", "op": "dedup", "key": "k", "window": "4s"}, [(i,) for i in kept]),
        ({"label": "w", "op": "tumbling", "size": 4, "agg": "count, sum:v, max:v"}, [(4, float(sum(range(i, i + 4))), float(i + 3)) for i in range(0, 20, 4)]),
    ]):
        feed = Feed(spark, tmp_path / f"in{n}", "_seq long, k string, at timestamp, v long")
        fed(spark, feed)
        got = []
        for part in (rows[:7], rows[7:]):
            feed.add(part)
            running = plans.build(spark, job({"type": "ref:feed"}, timed, stage)).start(str(tmp_path / f"state{n}"), available=True)
            running.query.awaitTermination()
            got += running.rows
        assert sorted((r["v"],) if n == 0 else (r["count"], r["sum"], r["max_v"]) for r in got) == sorted(want)


def test_late_rows_of_a_job(spark, tmp_path):
    """A window by key is closed when the watermark, less the lateness, has passed it."""
    for lateness, want in ((0, [(0, "a", 1)]), (300, [(0, "a", 2)])):
        feed = Feed(spark, tmp_path / f"in{lateness}", "ts long, k string, v long")
        fed(spark, feed)
        built = plans.build(spark, job({"type": "ref:feed"}, {"label": "w", "op": "vec-tumbling", "key": "k", "ts": "ts", "size": 100, "lateness": lateness, "agg": "count"}))
        out = built.frame.select("ts", "k", "count")
        got = run(out, f"late{lateness}", [[(10, "a", 1), (300, "a", 1)], [(300, "b", 0)], [(50, "a", 9)], [(10_000, "end", 0)], [(10_000, "end", 0)]], feed)
        assert [r for r in got if r[0] == 0] == want


def test_windows_of_a_stream_by_number(spark, tmp_path):
    rows = [[(10, "a", 1), (60, "a", 2), (120, "a", 3), (0, "b", 4)], [(10_000, "end", 0)], [(10_000, "end", 0)]]
    for op, more, want in (("vec-sliding", {"size": 100, "hop": 50}, [(-50, "a", 1), (-50, "b", 1), (0, "a", 2), (0, "b", 1), (50, "a", 2), (100, "a", 1)]), ("vec-session", {"gap": 50}, [(0, "b", 1), (10, "a", 2), (120, "a", 1)])):
        feed = Feed(spark, tmp_path / op, "ts long, k string, v long")
        fed(spark, feed)
        built = plans.build(spark, job({"type": "ref:feed"}, {"label": "w", "op": op, "key": "k", "ts": "ts", "agg": "count", **more}))
        got = run(built.frame.select("ts", "k", "count"), op.replace("-", "_"), rows, feed)
        assert [r for r in got if r[1] != "end"] == want


def test_stream_join_job(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "side string, id long, ts long, v long")
    fed(spark, feed)
    side = lambda s: [{"label": s, "op": "filter", "field": "side", "cmp": "eq", "value": s, "next": [f"{s}b"]}, {"label": f"{s}b", "op": "to-batch", "id": s, "next": ["j"]}]
    spec = job({"type": "ref:feed"}, *side("L"), *side("R"), {"label": "j", "op": "vec-streamjoin", "left": "L", "right": "R", "key": "id", "ts": "ts", "window": 50, "lateness": 10, "next": []})
    out = plans.build(spark, spec).frame.select("id", "ts", "ts_r", "v_r")
    got = run(out, "sjob", [[("L", 1, 100, 1), ("R", 2, 100, 1)], [("R", 1, 140, 2), ("R", 1, 200, 3)]], feed)
    assert got == [(1, 100, 140, 2)]


def test_count_windows_with_other_aggregates(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "k string, v double, seq long")
    out = streaming.stream_count_aggregate(feed.stream(), "k", 3, "count, sumi:v, min:v, avg:v, max:v", "seq")
    got = run(out, "aggs", [[("a", 5.0, 0), ("a", None, 1)], [("a", 1.0, 2), ("a", 7.0, 3), ("b", None, 4), ("b", None, 5), ("b", None, 6)]], feed)
    assert got == [("a", 0, 3, 6, 1.0, 3.0, 5.0), ("b", 0, 3, None, None, None, None)]
    with pytest.raises(ValueError):
        streaming.stream_count_aggregate(feed.stream(), "k", 3, "median:v", "seq")


def test_idle_keys_leave(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "k string, v double, seq long")
    q = streaming.stream_count_window(feed.stream(), "k", 10, "v", "seq", idle="1s").writeStream.format("memory").queryName("idle").start()
    feed.add([("a", 1.0, 0), ("a", 2.0, 1)])
    wait(lambda: [tuple(r) for r in spark.table("idle").collect()] == [("a", 0, 2, 3.0)])  # such a stream never has nothing to do
    q.stop()


def test_http_job_with_rejects(spark):
    spec = job({"type": "http", "addr": "127.0.0.1:0", "schema": "a long"}, {"label": "f", "op": "filter", "field": "a", "value": 2}, profile="sidecar")
    built = plans.build(spark, spec)
    with pytest.raises(ValueError):
        plans.build(spark, job({"type": "memory"}, PASS), rows=[{"a": 1}]).start()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    running = built.start()
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    body = json.dumps([{"a": 1}, {"a": 2}, {"a": 3}, {"a": "three"}]).encode()
    urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{built.receiver.port}/ingest", body))
    wait(lambda: running.total >= 2 and running.quarantine.total >= 1)
    running.stop()
    assert [r["a"] for r in running.rows] == [2, 3] and "three" in running.quarantine.rows[0]["raw"] and not running.query.isActive


def test_control_plane(spark, tmp_path):
    runner = plans.Runner(spark, plans.JobStore(str(tmp_path)))
    control = plans.Control(runner, token="secret")

    def ask(method, path, body=None, token="secret"):
        request = urllib.request.Request(f"http://127.0.0.1:{control.port}{path}", None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode(), {"Authorization": f"Bearer {token}"}, method=method)
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    ticks = plans.dump(plans.load(job({"type": "generator", "fields": {"n": "seq"}, "rate": "50ms"}, {"label": "even", "op": "vec-map", "field": "n", "arith": "mul", "value": 2}))).encode()
    assert ask("GET", "/healthz", token="")[0] == 200 and ask("GET", "/api/jobs", token="wrong")[0] == 401
    assert ask("POST", "/api/jobs", ticks)[0] == 201 and json.loads(ask("GET", "/api/jobs")[1]) == ["s"] and ask("GET", "/api/jobs/s")[0] == 200
    assert ask("POST", "/api/jobs", b"name: x")[0] == 400 and ask("GET", "/api/jobs/none")[0] == 404 and ask("GET", "/nothing")[0] == 404
    assert json.loads(ask("POST", "/api/validate", ticks)[1]) == {"name": "s", "stages": 1} and "operators" in json.loads(ask("GET", "/api/palette")[1])
    assert {"from": "source", "to": "even"} in json.loads(ask("GET", "/api/graph?name=s")[1])["edges"]
    assert ask("POST", "/api/jobs/s/duplicate", {"name": "t"})[0] == 201 and ask("POST", "/api/run", {"name": "t", "rows": 9})[0] == 202
    wait(lambda: runner.states()["t"] == "finished")
    assert ask("POST", "/api/run", {"name": "s"})[0] == 202 and ask("POST", "/api/run", {"name": "s"})[0] == 409
    wait(lambda: json.loads(ask("GET", "/api/sample?name=s")[1]))
    assert [x["name"] for x in json.loads(ask("GET", "/api/status")[1])["running"]] == ["s"] and json.loads(ask("GET", "/api/dlq")[1]) == {"total": 0, "rows": []}
    wait(lambda: 'millrace_rows_total{stage="s"}' in ask("GET", "/metrics")[1])
    assert json.loads(ask("POST", "/api/stop", {})[1])["running"] == [] and runner.states()["s"] == "finished"
    assert ask("DELETE", "/api/jobs/t")[0] == 200 and runner.store.names() == ["s"]
    control.close()


def test_errors_are_counted_by_query(spark, tmp_path):
    progress = streaming.Progress()
    spark.streams.addListener(progress)
    feed = Feed(spark, tmp_path / "in", "v long")
    good = feed.stream().writeStream.foreachBatch(lambda df, b: None).queryName("good").start()

    def fail(df, batch):
        raise OSError("no")

    bad = feed.stream().writeStream.foreachBatch(fail).queryName("bad").start()
    feed.add([(1,)])
    wait(lambda: not bad.isActive)
    wait(lambda: progress.figures.get("bad", {}).get("errors") == 1)
    good.stop()
    spark.streams.removeListener(progress)
    assert progress.figures["good"]["errors"] == 0
    assert 'stage="a\\"b\\\\c"' in streaming.prometheus({'a"b\\c': progress.figures["good"]})


def test_bounded_join_of_a_hot_key(spark):
    from millrace import operators as ops

    rows = [(i, "L" if i * 7 % 5 < 2 else "R", "hot" if i % 10 else f"k{i}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, side string, k string, v long")
    l, r = (df.where(F.col("side") == s) for s in "LR")
    both = [sorted(map(tuple, ops.bounded_join(l, r, "k", "k", 3, "seq", [F.col("l.v").alias("l"), F.col("r.v").alias("r")], skewed=hot).collect())) for hot in (False, True)]
    want, last = [], {}
    for seq, side, k, v in rows:
        mine, theirs = last.setdefault((k, side), []), last.setdefault((k, "R" if side == "L" else "L"), [])
        want += [(seq, x, v if side == "L" else x, x if side == "L" else v) for x in theirs[-3:]]
        mine.append(v)
    assert both[0] == both[1] == sorted(want)
