"""Declarative jobs: parsing, validation, graphs, compilation, the store and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from millrace import plans
from millrace.cli import main
from millrace.plans.spec import JobError
from millrace.stream import Stream, run_all

METERS = """
name: meters
source: {type: generator, fields: {watts: "rand:float:0:300", meter: "rand:int:100:124", site: "choice:north|south|west", note: "row ${seq}"}, rate: 2ms}
stages:
  - {label: unit, op: vec-map, next: [peak, quiet, once], field: watts, arith: div, value: 1000}
  - {label: peak, op: vec-filter, next: [by-site], cmp: gte, field: watts, value: 0.2}
  - {label: by-site, op: vec-groupby, next: [mark], key: site, agg: "count, max:watts"}
  - {label: mark, op: map-set, next: [], field: report, value: peaks}
  - {label: quiet, op: vec-filter, next: [plain], cmp: lte, field: watts, value: 0.02}
  - {label: plain, op: map-rename, next: [], from: note, to: remark}
  - {label: once, op: dedup, next: [batches], key: meter, window: 50ms}
  - {label: batches, op: tumbling, agg: count, size: 16}
sink: {type: memory}
"""


def job(*stages, source=None):
    return {"name": "j", "source": source or {"type": "memory"}, "stages": list(stages), "sink": {"type": "memory"}}


def test_generated_job_runs(spark):
    built = plans.build(spark, METERS, bounded=200)
    at = built.stages
    assert at["unit"].count() == 200 and at["unit"].where("watts > 0.3").count() == 0
    sites = {r.site: (r["count"], r.max_watts) for r in at["by-site"].collect()}
    want = {r.site: (r.n, r.m) for r in at["unit"].where("watts >= 0.2").groupBy("site").agg(F.count("*").alias("n"), F.max("watts").alias("m")).collect()}
    assert sites == want and at["mark"].where("report = 'peaks'").count() == len(sites)
    assert at["plain"].where("watts > 0.02 or remark not like 'row %'").count() == 0 and "note" not in at["plain"].columns
    kept = at["once"].count()
    assert 25 <= kept <= 200
    out = built.run()
    assert len(out) == len(sites) + at["plain"].count() + -(-kept // 16)


def test_group_by_job(spark):
    rows = [{"m": m, "amount": float(a)} for m, a in (("a", 1), ("b", 2), ("a", 3), ("a", 4), ("b", 5))]
    built = plans.build(spark, job({"label": "b", "op": "to-batch", "size": 2}, {"label": "g", "op": "vec-groupby", "key": "m", "agg": "count, sum:amount"}, {"label": "r", "op": "to-rows"}), rows=rows)
    assert sorted((r["m"], r["count"], r["sum_amount"]) for r in built.run()) == [("a", 3, 8.0), ("b", 2, 7.0)]


def test_map_filter_job(spark):
    built = plans.build(spark, job({"label": "m", "op": "vec-map", "field": "v", "arith": "mul", "value": 10}, {"label": "f", "op": "vec-filter", "field": "v", "cmp": "gte", "value": 25}), rows=[{"v": i} for i in range(5)])
    assert sorted(r["v"] for r in built.run()) == [30, 40]


def test_windows_and_join_jobs(spark):
    rows = [{"k": "a", "ts": 10, "v": 1}, {"k": "a", "ts": 60, "v": 2}, {"k": "a", "ts": 120, "v": 3}]
    hop = plans.build(spark, job({"label": "w", "op": "vec-sliding", "key": "k", "ts": "ts", "size": 100, "hop": 50, "agg": "count"}), rows=rows).run()
    assert sorted((r["ts"], r["count"]) for r in hop) == [(-50, 1), (0, 2), (50, 2), (100, 1)]
    session = plans.build(spark, job({"label": "w", "op": "vec-session", "key": "k", "ts": "ts", "gap": 50, "agg": "sumi:v"}), rows=rows).run()
    assert sorted((r["ts"], r["sumi_v"]) for r in session) == [(10, 3), (120, 3)]
    dim = {"label": "d", "op": "vec-join", "key": "k", "bring": ["c:country"], "build": [{"k": "a", "c": "US"}, {"k": "b", "c": "DE"}, {"k": "a", "c": "FR"}]}
    assert {r["country"] for r in plans.build(spark, job(dim), rows=rows).run()} == {"FR"}
    timed = job({"label": "t", "op": "timestamp", "field": "ts"}, {"label": "w", "op": "eventwindow", "size": "100s", "agg": "count"})
    assert sorted(r["count"] for r in plans.build(spark, timed, rows=rows).run()) == [1, 2]
    sess = job({"label": "t", "op": "timestamp", "field": "ts"}, {"label": "w", "op": "session", "key": "k", "gap": "55s", "agg": "count"})
    assert sorted(r["count"] for r in plans.build(spark, sess, rows=rows).run()) == [1, 2]


def test_stream_join_job(spark):
    rows = [{"side": "L", "id": 1, "ts": 100, "v": 1}, {"side": "R", "id": 1, "ts": 140, "v": 2}, {"side": "R", "id": 1, "ts": 200, "v": 3}]
    spec = job(
        {"label": "l", "op": "filter", "field": "side", "cmp": "eq", "value": "L", "next": ["lb"]}, {"label": "lb", "op": "to-batch", "id": "L", "next": ["j"]},
        {"label": "r", "op": "filter", "field": "side", "cmp": "eq", "value": "R", "next": ["rb"]}, {"label": "rb", "op": "to-batch", "id": "R", "next": ["j"]},
        {"label": "j", "op": "vec-streamjoin", "left": "L", "right": "R", "key": "id", "ts": "ts", "window": 50, "next": ["o"]}, {"label": "o", "op": "to-rows"},
    )
    assert [(r["ts"], r["ts_r"], r["v_r"]) for r in plans.build(spark, spec, rows=rows).run()] == [(100, 140, 2)]


F1 = {"label": "f", "op": "filter", "field": "a", "value": 1}
BAD = [
    job(), job({**F1, "label": ""}), job(F1, F1), job({**F1, "next": ["x"]}), job({**F1, "next": ["g"]}, {**F1, "label": "g", "next": ["f"]}), job({**F1, "op": "nope"}), job({**F1, "cmp": "like"}),
    job({**F1, "value": "text"}), job({"label": "t", "op": "tumbling", "size": 0}), job({"label": "t", "op": "tumbling", "size": 4, "parallelism": 2}), job({"label": "m", "op": "vec-map", "field": "a", "arith": "div", "value": 0}),
    job({"label": "d", "op": "dedup", "key": "k", "window": "soon"}), job(F1, source={"type": "lake"}), job(F1, source={"type": "http"}), {**job(F1), "profile": "huge"}, {**job(F1), "extra": 1}, {**job(F1), "name": ""},
]


@pytest.mark.parametrize("bad", BAD)
def test_invalid(bad):
    with pytest.raises(JobError):
        plans.load(bad)


def test_older_filter_form_and_wiring(spark):
    assert sorted(r["a"] for r in plans.build(spark, job({"label": "f", "op": "filter", "field": "a", "gte": 2}), rows=[{"a": 1}, {"a": 2}]).run()) == [2]
    linear = plans.load(job(F1, {**F1, "label": "g"}))
    assert linear.edges() == {"f": ["g"], "g": []}
    explicit = plans.load(job({**F1, "next": ["h"]}, {**F1, "label": "g"}, {**F1, "label": "h"}))
    assert explicit.edges() == {"f": ["h"], "g": [], "h": []}


def test_graph_and_round_trip():
    spec = plans.load(METERS)
    assert "source[source] --> unit[unit]" in plans.render(spec) and "batches[batches] --> sink[sink]" in plans.render(spec)
    assert '"unit" -> "peak";' in plans.render(spec, "dot")
    assert {"from": "peak", "to": "by-site"} in json.loads(plans.render(spec, "json"))["edges"]
    assert plans.load(plans.dump(spec)) == spec
    with pytest.raises(ValueError):
        plans.render(spec, "png")


def test_catalog_matches_lowering():
    from millrace.plans.catalog import OPERATORS
    from millrace.plans.compile import LOWER

    assert set(OPERATORS) == set(LOWER) and len(LOWER) == 18
    listed = {b["type"] for b in plans.catalog()["operators"]}
    assert listed == set(OPERATORS) - {"vec-join"}


def test_store_and_runner(spark, tmp_path):
    store = plans.JobStore(str(tmp_path))
    store.save(METERS)
    with pytest.raises(JobError):
        store.save("name: x")
    with pytest.raises(ValueError):
        store.text("../x")
    assert store.names() == ["meters"]
    runner = plans.Runner(spark, store)
    assert runner.start("meters", bounded=50).result() and runner.states() == {"meters": "finished"}
    assert len(runner.sample("meters", "unit", 5)) == 5 and runner.status() == {"running": [], "errors": {}}
    assert store.duplicate("meters", "meters2").name == "meters2" and store.names() == ["meters", "meters2"]
    with pytest.raises(ValueError):
        store.duplicate("meters", "meters2")
    store.delete("meters2")
    store.delete("meters")
    assert store.names() == []


def test_profile(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert plans.use_profile(spark, "sidecar")["trigger"] == "5 milliseconds" and spark.conf.get("spark.sql.shuffle.partitions") == "8"
    spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(JobError):
        plans.use_profile(spark, "none")


def test_references(spark):
    plans.register_source("three", lambda s: s.range(3).withColumnRenamed("id", "v"))
    plans.register_operator("twice", lambda df, by: df.withColumn("v", F.col("v") * by))
    kept = []
    plans.register_sink("keep", lambda df: kept.extend(r.v for r in df.collect()))
    plans.build(spark, {"name": "r", "source": {"type": "ref:three"}, "stages": [{"label": "t", "op": "ref:twice", "by": 2}], "sink": {"type": "ref:keep"}}).run()
    assert sorted(kept) == [0, 2, 4]


def test_cli(tmp_path, capsys):
    path = tmp_path / "j.yaml"
    path.write_text(METERS)
    assert main(["validate", str(path)]) == 0 and "8 stages" in capsys.readouterr().out
    assert main(["graph", str(path)]) == 0 and capsys.readouterr().out.startswith("graph LR")
    path.write_text("name: x")
    assert main(["validate", str(path)]) == 1


def test_fluent(spark):
    df = spark.range(10).withColumnRenamed("id", "v")
    s = Stream().source(df).filter("v >= 2").map(w=F.col("v") * 10).tumbling(4, "sumi:w", ["v"])
    assert [x for x, _ in s.steps] == ["filter-1", "map-1", "tumbling-1"]
    assert sorted(r["sumi_w"] for r in s.run()) == [140, 300]
    with pytest.raises(ValueError):
        Stream().source(df).tumbling(0, "count", ["v"]).build()
    with pytest.raises(ValueError):
        Stream().filter("true").build()
    both = Stream().source(df).branch(lambda s: s.filter("v < 2"), lambda s: s)
    assert len(both.run()) == 12 and [len(x) for x in run_all(both, both)] == [12, 12]
