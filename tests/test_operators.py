"""Hand-made examples with exact answers, and random rows against plain Python models of the arrival-order semantics."""

import random

import pytest
from pyspark.sql import functions as F

from millrace import operators as ops
from millrace.functions import arithmetic, compare, seconds
from millrace.operators.schema import Field, Schema, SchemaRegistry, adapt


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def numbers(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "seq long, v long")


@pytest.mark.parametrize(("values", "size", "want"), [([1, 2, 3, 4, 5, 6], 3, [6, 15]), ([1, 2, 3, 4, 5], 3, [6, 9]), ([], 3, [])])
def test_count_tumbling(spark, values, size, want):
    assert [s for _, s in rows(ops.count_tumbling(numbers(spark, values), size, "sumi:v", ["seq"]), "window", "sumi_v")] == want


def test_count_sliding(spark):
    assert [s for _, s in rows(ops.count_sliding(numbers(spark, range(1, 7)), 4, 2, "sumi:v", ["seq"]), "window", "sumi_v")] == [3, 10, 18]
    assert rows(ops.count_sliding(numbers(spark, range(1, 5)), 4, 3, "count, sumi:v", ["seq"]), "window", "count", "sumi_v") == [(3, 3, 6), (4, 4, 10)]


@pytest.mark.parametrize(("size", "step"), [(10, 3), (7, 7), (5, 1)])
def test_count_sliding_model(spark, size, step):
    values = [random.Random(size).randrange(100) for _ in range(97)]
    want = [(n, sum(values[max(0, n - size) : n])) for n in range(1, 98) if n % step == 0 or n == 97]
    assert rows(ops.count_sliding(numbers(spark, values), size, step, "sumi:v", ["seq"]), "window", "sumi_v") == want


def test_top_n(spark):
    assert rows(ops.top_n(numbers(spark, [3, 9, 1, 7, 5]), "v", 2, 5, ["seq"]), "rank", "v") == [(1, 9), (2, 7)]
    df = spark.createDataFrame([(0, "a", 1), (1, "a", 9), (2, "b", 4), (3, "b", 2)], "seq long, k string, v long")
    assert rows(ops.top_n(df, "v", 1, 2, ["seq"], "k"), "k", "v") == [("a", 9), ("b", 4)]


def test_event_windows(spark):
    df = spark.createDataFrame([(10, "a", 1), (20, "a", 2), (110, "b", 5), (250, "a", 7)], "ts long, k string, v long")
    assert rows(ops.event_tumbling(df, "ts", 100, "count, sumi:v", "k"), "ts", "k", "count", "sumi_v") == [(0, "a", 2, 3), (100, "b", 1, 5), (200, "a", 1, 7)]
    hop = spark.createDataFrame([(10, "a", 1), (60, "a", 2), (120, "a", 3)], "ts long, k string, v long")
    assert rows(ops.event_sliding(hop, "ts", 100, 50, "count, sumi:v", "k"), "ts", "count", "sumi_v") == [(-50, 1, 1), (0, 2, 3), (50, 2, 5), (100, 1, 3)]
    assert rows(ops.event_sliding(df, "ts", 100, 100, "count", "k"), "ts", "k", "count") == rows(ops.event_tumbling(df, "ts", 100, "count", "k"), "ts", "k", "count")


def test_sessions(spark):
    df = spark.createDataFrame([(10, "a", 1), (40, "a", 2), (200, "a", 9), (10, "b", 1), (100, "b", 2), (50, "b", 3)], "ts long, k string, v long")
    assert rows(ops.event_sessions(df, "ts", 50, "count, sumi:v", "k"), "k", "ts", "count", "sumi_v") == [("a", 10, 2, 3), ("a", 200, 1, 9), ("b", 10, 3, 6)]
    timed = df.withColumn("at", F.timestamp_seconds("ts"))
    assert rows(ops.event_sessions(timed, "at", "50s", "count", "k"), "k", "count") == [("a", 1), ("a", 2), ("b", 3)]


def test_group_by(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("b", 4), ("c", 5), ("a", 6)], "k string, v long")
    want = [("a", 3, 10), ("b", 2, 6), ("c", 1, 5)]
    assert rows(ops.group_by(df, "k", "count, sumi:v"), "k", "count", "sumi_v") == want
    parts = ops.merge(*[ops.group_by(df.where(F.col("v") % 3 == i), "k", "count, sumi:v") for i in range(3)])
    assert rows(ops.merge_partials(parts, "k", "count, sumi:v"), "k", "count", "sumi_v") == want


def test_global(spark):
    empty = numbers(spark, [])
    assert ops.global_aggregate(empty, "count, sumi:v, max:v").first().asDict() == {"count": 0, "sumi_v": 0, "max_v": None}
    assert ops.max_or_none(empty, "v", "m").count() == 0
    nulls = spark.createDataFrame([(None, 1), (None, None), (0, 5)], "k long, v long")
    assert rows(ops.group_by(nulls, "k", "count, sumi:v", null_mode="zero"), "k", "count", "sumi_v") == [(0, 3, 6)]


def test_dimension_joins(spark):
    probe = spark.createDataFrame([(2, 100), (99, 200), (1, 300)], "user_id long, amt long")
    dim = spark.createDataFrame([(0, 1, "US", 10), (1, 2, "DE", 20), (2, 3, "JP", 30), (3, 1, "FR", 11)], "n long, id long, country string, tier long")
    bring = {"country": "country", "tier": "tier"}
    assert rows(ops.hash_join(probe, dim, "user_id", "id", bring, build_order=["n"]), "user_id", "country", "tier") == [(1, "FR", 11), (2, "DE", 20)]
    assert rows(ops.hash_join(probe, dim, "user_id", "id", bring, multi=True), "user_id", "country") == [(1, "FR"), (1, "US"), (2, "DE")]
    left = ops.hash_join(probe, dim, "user_id", "id", bring, "left", multi=True).collect()
    assert len(left) == 4 and [r.country for r in left if r.user_id == 99] == [None]
    with pytest.raises(ValueError):
        ops.hash_join(probe, dim, "user_id", "id", bring)


@pytest.mark.parametrize("bucket", [False, True])
def test_interval_join(spark, bucket):
    l = spark.createDataFrame([(1, 100, 10), (2, 200, 20), (3, 100, 1)], "oid long, ts long, amt long")  # noqa: E741
    r = spark.createDataFrame([(1, 150, 5), (2, 260, 6), (3, 200, 1)], "oid long, ts long, qty long")
    out = ops.interval_join(l, r, "oid", "ts", 60, bucket)
    assert out.columns == ["oid", "ts", "amt", "ts_r", "qty"]
    assert rows(out, *out.columns) == [(1, 100, 10, 150, 5), (2, 200, 20, 260, 6)]


@pytest.mark.parametrize("most", [1, 2, 4])
def test_bounded_join_model(spark, most):
    rnd = random.Random(most)
    data = [(i, rnd.choice("lr"), rnd.randrange(5)) for i in range(97)]
    seen, want = {}, []
    for i, side, k in data:
        other = seen.get(("r" if side == "l" else "l", k), [])[-most:]
        want += [(i, x) if side == "l" else (x, i) for x in other]
        seen.setdefault((side, k), []).append(i)
    df = spark.createDataFrame(data, "seq long, side string, k long")
    out = ops.bounded_join(df.where("side = 'l'"), df.where("side = 'r'"), "k", "k", most, "seq", [F.col("l.seq").alias("a"), F.col("r.seq").alias("b")])
    assert rows(out, "a", "b") == sorted(want)


def test_dedup_model(spark):
    rnd = random.Random(5)
    data = [(i, rnd.choice("abc"), rnd.randrange(300)) for i in range(97)]
    last, want = {}, []
    for i, k, ts in sorted(data, key=lambda x: (x[2], x[0])):
        if k not in last or ts - last[k] >= 10:
            last[k] = ts
            want.append(i)
    df = spark.createDataFrame(data, "id long, k string, ts long")
    assert rows(ops.deduplicate(df, "k", "ts", 10, ["id"]), "id") == sorted((i,) for i in want)
    assert ops.deduplicate(df, "k", "ts", 0, ["id"]).count() == 97


def test_keep_last_and_numbers(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(11)], "seq long, k string")
    assert rows(ops.keep_last(df, "k", 4, ["seq"]), "k", "seq") == [("a", 6), ("a", 10), ("b", 7), ("b", 9)]
    numbered = ops.number_rows(df.repartition(3), ["seq"])
    assert rows(numbered, "seq", "_rn") == [(i, i + 1) for i in range(11)]
    for skewed in (False, True):
        assert rows(ops.number_rows(df, ["seq"], key=["k"], skewed=skewed), "seq", "_rn") == [(i, i // 2 + 1) for i in range(11)]
    with pytest.raises(ValueError):
        ops.number_rows(df, [])


def test_routing(spark):
    df = spark.createDataFrame([(i,) for i in range(-1, 4)], "v long")
    assert [rows(r, "v") for r in ops.split(df, 3, F.col("v"))] == [[(-1,), (0,), (3,)], [(1,)], [(2,)]]
    doubled = ops.branch(df, [], [lambda d: d.withColumn("v", F.col("v") * 10)])
    assert rows(doubled, "v") == sorted([(i,) for i in range(-1, 4)] + [(i * 10,) for i in range(-1, 4)])
    with pytest.raises(ValueError):
        ops.branch(df, [])
    assert ops.rename(spark.createDataFrame([(1, 2)], "a long, b long"), "a", "b").collect()[0].asDict() == {"b": 1}


def test_specs(spark):
    df = spark.createDataFrame([(7, "5"), (-7, "x")], "a long, t string")
    assert [r[0] for r in df.select(arithmetic(F.col("a"), "div", 2)).collect()] == [3, -3]
    assert [r[0] for r in df.select(compare("t", "gte", 5)).collect()] == [True, None]
    assert seconds("1h30m") == 5400 and seconds("250ms") == 0.25 and seconds(3) == 3
    for bad in ("5 parsecs", "", "s"):
        with pytest.raises(ValueError):
            seconds(bad)
    with pytest.raises(ValueError):
        arithmetic(F.lit(1), "div", 0)


def test_adapt(spark):
    df = spark.createDataFrame([(3.9, 7, "42", "true")], "i double, f long, s string, b string")
    out = adapt(df, Schema("x", 1, [Field("i", "int"), Field("f", "float"), Field("s", "string"), Field("b", "bool"), Field("new", "string", default="d"), Field("n", "int", alias="s")]))
    assert out.first().asDict() == {"i": 3, "f": 7.0, "s": "42", "b": True, "new": "d", "n": 42}
    bad = adapt(spark.createDataFrame([("12.7",), ("zz",)], "v string"), Schema("x", 1, [Field("v", "int")]), rescue=True).collect()
    assert [(r.v, r._rescued) for r in bad] == [(12, {}), (None, {"v": "zz"})]


def test_registry():
    reg, heard = SchemaRegistry(), []
    reg.register(Schema("a", 1))
    reg.subscribe("a", heard.append)
    with pytest.raises(ValueError):
        reg.register(Schema("a", 3))
    reg.register(Schema("a", 2))
    assert [s.version for s in heard] == [2] and reg.latest("a").version == 2 and reg.version("a", 1).version == 1 and reg.ids() == ["a"]
    with pytest.raises(KeyError):
        reg.version("a", 9)


def test_as_of(spark):
    l = spark.createDataFrame([(1, 5), (1, 10), (2, 5)], "k long, ts long")  # noqa: E741
    r = spark.createDataFrame([(1, 6, "x"), (1, 10, "y")], "k long, ts long, v string")
    assert [tuple(x) for x in ops.as_of_join(l, r, "k", "ts", ["v"]).orderBy("k", "ts").collect()] == [(1, 5, None), (1, 10, "y"), (2, 5, None)]


def test_function_operators(spark, monkeypatch):
    from millrace import sources, streaming
    from millrace.operators import functions

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "a")], "v long, k string")
    assert sorted(r.w for r in ops.map_rows(df, lambda r: {"w": r["v"] * 2}, "w long").collect()) == [2, 4, 6, 8]
    assert ops.flat_map_rows(df, lambda r: [], "w long").count() == 0 and ops.map_batches(df, lambda b: b.select(["v"]), "v long").count() == 4
    assert [r.v for r in ops.filter_by(df, lambda r: r["k"] is None).collect()] == [2]
    monkeypatch.setattr(functions, "HELD_KEYS", 1)
    total = ops.aggregate_by(df, "k", list, lambda a, r: [*a, r["v"]], lambda a, b: a + b, lambda a: {"vs": sorted(a)}, "vs array<long>")
    assert {r.k: r.vs for r in total.collect()} == {"a": [1, 4], None: [2], "b": [3]}
    assert ops.aggregate_by(df.limit(0), "k", list, None, None, None, "vs array<long>").count() == 0
    frames = sources.to_frames(df).union(spark.createDataFrame([(bytearray(b"no frame"),), (None,)], "value binary"))
    assert sorted((r.v, r.k or "") for r in sources.read_frames(frames, "value", "v long, k string").collect()) == [(1, "a"), (2, ""), (3, "b"), (4, "a")]
    e = streaming.stamp(df, ["v"])
    g = streaming.with_parents(e, ["k"], F.count("*").alias("n"))
    assert streaming.lineage_edges(g).count() == 4


def test_lineage_export(spark, tmp_path):
    from millrace import streaming

    e = streaming.stamp(spark.range(4), ["id"])
    g = streaming.with_parents(e, [F.col("id") % 2], F.count("*").alias("n"))
    streaming.export_lineage(str(tmp_path / "x"), e, g)
    rows = spark.read.json(str(tmp_path / "x")).collect()
    assert len(rows) == 6 and sum(len(r.parents) for r in rows) == 4


def test_lookup_misses(spark):
    left, right = spark.createDataFrame([(1,), (2,), (None,)], "k long"), spark.createDataFrame([(1, "x")], "k long, name string")
    assert sorted(r["got"] for r in ops.side_lookup(left, right, "k", "k", "name", "got").collect()) == ["", "", "x"]
    for how, n in (("inner", 1), ("left", 3)):
        assert ops.hash_join(left, right, "k", "k", {"name": "got"}, how, build_order=["name"]).count() == n
