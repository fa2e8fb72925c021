"""The registered queries over the test tables, each with the SQL that gives the same rows in DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import nexmark, plans
from . import operators as ops
from .functions import arithmetic, compare
from .operators.schema import Field, Schema, adapt
from .sources import generator, memory
from .stream import Stream
from .streaming import ancestors, stamp, with_parents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            SQL[name or fn.__name__] = sql
        return fn

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events_ts(spark: SparkSession, d: str) -> DataFrame:
    """Events with the time in whole seconds."""
    return t(spark, d, "events").withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))


# Projection, filter, routing


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem WHERE l_quantity >= 30 AND l_shipdate >= TIMESTAMP '1995-01-01'")
def filter_map(spark, d):
    l = t(spark, d, "lineitem").where(compare("l_quantity", "gte", 30) & (F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")))  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@query("SELECT o_orderkey AS id, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, 'high' AS tier FROM orders WHERE o_totalprice >= 100000")
def map_rename_set(spark, d):
    return Stream().source(t(spark, d, "orders")).filter(compare("o_totalprice", "gte", 100_000)).apply(lambda x: ops.rename(x, "o_orderkey", "id")).apply(lambda x: ops.set_constant(x, "tier", "high")).build()


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word")
def flat_map_words(spark, d):
    return ops.flat_map(t(spark, d, "documents"), F.split("text", " "), "word", keep=[]).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, value, 'big' AS kind FROM events WHERE value >= 50 UNION ALL SELECT event_id, user_id, -value, 'click' FROM events WHERE event_type = 'click'")
def union_branches(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "value", "event_type")
    big = [lambda x: x.where(compare("value", "gte", 50)), lambda x: ops.set_constant(x.drop("event_type"), "kind", "big")]
    click = [lambda x: x.where(compare("event_type", "eq", "click")), lambda x: ops.set_constant(x.drop("event_type").withColumn("value", -F.col("value")), "kind", "click")]
    return ops.branch(e, big, click)


@query("SELECT event_id, CASE WHEN user_id % 4 BETWEEN 1 AND 2 THEN CAST(user_id % 4 AS BIGINT) ELSE 0 END AS route FROM events")
def split_routes(spark, d):
    routes = ops.split(t(spark, d, "events").select("event_id", "user_id"), 3, F.col("user_id") % 4)
    return ops.merge(*[r.select("event_id", F.lit(i).cast("bigint").alias("route")) for i, r in enumerate(routes)])


@query("SELECT DISTINCT o_orderstatus AS s FROM orders UNION SELECT l_linestatus FROM lineitem")
def union_distinct(spark, d):
    return ops.distinct_union(t(spark, d, "orders").select(F.col("o_orderstatus").alias("s")), t(spark, d, "lineitem").select(F.col("l_linestatus").alias("s")))


@query("SELECT c_custkey AS k FROM customer INTERSECT ALL SELECT o_custkey FROM orders")
def set_intersect(spark, d):
    return ops.intersect_all(t(spark, d, "customer").select(F.col("c_custkey").alias("k")), t(spark, d, "orders").select(F.col("o_custkey").alias("k")))


@query("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def set_except(spark, d):
    return ops.except_all(t(spark, d, "orders").select(F.col("o_custkey").alias("k")), t(spark, d, "customer").select(F.col("c_custkey").alias("k")))


@query("SELECT event_id, user_id // 7 AS a, user_id * 3 + 1 AS b, value / 4 AS c FROM events")
def column_arithmetic(spark, d):
    u = F.col("user_id")
    return t(spark, d, "events").select("event_id", arithmetic(u, "div", 7).alias("a"), arithmetic(arithmetic(u, "mul", 3), "add", 1).alias("b"), arithmetic(F.col("value"), "div", 4.0).alias("c"))


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS v, k FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_field(spark, d):
    return t(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v")).select("event_id", "v", "k")


# Aggregation


@query("SELECT count(*) AS count, round(sum(l_extendedprice), 2) AS sum_l_extendedprice, CAST(sum(l_linenumber) AS BIGINT) AS sumi_l_linenumber, max(l_quantity) AS max_l_quantity FROM lineitem")
def global_aggs(spark, d):
    return ops.global_aggregate(t(spark, d, "lineitem"), "count, sum:l_extendedprice, sumi:l_linenumber, max:l_quantity").withColumn("sum_l_extendedprice", F.round("sum_l_extendedprice", 2))


@query("SELECT l_returnflag, count(*) AS count, CAST(sum(l_linenumber) AS BIGINT) AS sumi_l_linenumber, max(l_extendedprice) AS max_l_extendedprice FROM lineitem GROUP BY l_returnflag")
def group_by_key(spark, d):
    return ops.group_by(t(spark, d, "lineitem"), "l_returnflag", "count, sumi:l_linenumber, max:l_extendedprice")


@query("SELECT l_returnflag, count(*) AS count, CAST(sum(l_linenumber) AS BIGINT) AS sumi_l_linenumber, max(l_extendedprice) AS max_l_extendedprice FROM lineitem GROUP BY l_returnflag")
def group_by_merge(spark, d):
    l, spec = t(spark, d, "lineitem"), "count, sumi:l_linenumber, max:l_extendedprice"  # noqa: E741
    parts = [ops.group_by(l.where(F.col("l_orderkey") % 2 == k), "l_returnflag", spec) for k in (0, 1)]
    return ops.merge_partials(ops.merge(*parts), "l_returnflag", spec)


@query("SELECT user_id, event_type, count(*) AS count, count(DISTINCT props) AS distinct_props, round(avg(value), 6) AS avg_value, min(value) AS min_value FROM events GROUP BY user_id, event_type")
def group_by_many(spark, d):
    return ops.group_by(t(spark, d, "events"), ["user_id", "event_type"], "count, distinct:props, avg:value, min:value").withColumn("avg_value", F.round("avg_value", 6))


@query("SELECT l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag, l_linestatus) AS BIGINT) AS _level, count(*) AS count FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_totals(spark, d):
    return ops.rollup_cube(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "count")


@query("SELECT l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag, l_linestatus) AS BIGINT) AS _level, count(*) AS count FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_totals(spark, d):
    return ops.rollup_cube(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "count", cube=True)


@query("SELECT coalesce(k, 0) AS k, count(*) AS count, CAST(sum(coalesce(v, 0)) AS DOUBLE) AS sum_v, max(coalesce(v, 0)) AS max_v FROM (SELECT CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 3 END AS k, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id END AS v FROM events) GROUP BY coalesce(k, 0)")
def zero_null_groups(spark, d):
    e = t(spark, d, "events").select(F.when(F.col("user_id") % 5 != 0, F.col("user_id") % 3).alias("k"), F.when(F.col("event_id") % 4 != 0, F.col("event_id")).alias("v"))
    return ops.group_by(e, "k", "count, sum:v, max:v", null_mode="zero")


# Count windows, ranking, dedup

_NUMBERED = "SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events"
_BY_USER = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events"


@query(f'SELECT CAST((rn - 1) // 100 AS BIGINT) AS "window", count(*) AS count, round(sum(value), 4) AS sum_value FROM ({_NUMBERED}) GROUP BY 1')
def count_tumbling(spark, d):
    return ops.count_tumbling(t(spark, d, "events"), 100, "count, sum:value", ["ts", "event_id"]).withColumn("sum_value", F.round("sum_value", 4))


@query(f"""WITH n AS ({_NUMBERED}), tot AS (SELECT max(rn) AS total FROM n),
ends AS (SELECT rn AS e FROM n, tot WHERE rn % 30 = 0 OR rn = total)
SELECT e AS "window", count(*) AS count, round(sum(value), 4) AS sum_value FROM ends JOIN n ON n.rn BETWEEN e - 99 AND e GROUP BY e""")
def count_sliding(spark, d):
    return ops.count_sliding(t(spark, d, "events"), 100, 30, "count, sum:value", ["ts", "event_id"]).withColumn("sum_value", F.round("sum_value", 4))


@query(f'SELECT user_id, CAST((rn - 1) // 20 AS BIGINT) AS "window", count(*) AS count, max(value) AS max_value FROM ({_BY_USER}) GROUP BY 1, 2')
def keyed_count_window(spark, d):
    return ops.keyed_count_window(t(spark, d, "events"), "user_id", 20, "count, max:value", ["ts", "event_id"])


@query(f'SELECT user_id, CAST((rn - 1) // 20 AS BIGINT) AS "window", count(*) AS count, max(value) AS max_value FROM ({_BY_USER}) GROUP BY 1, 2')
def keyed_count_window_skewed(spark, d):
    return ops.keyed_count_window(t(spark, d, "events"), "user_id", 20, "count, max:value", ["ts", "event_id"], skewed=True)


@query(f'SELECT user_id, CAST((rn - 1) // 20 AS BIGINT) AS "window", arg_max(event_id, rn) AS event_id, arg_max(value, rn) AS value FROM ({_BY_USER}) GROUP BY 1, 2')
def keep_last(spark, d):
    return ops.keep_last(t(spark, d, "events").select("ts", "event_id", "user_id", "value"), "user_id", 20, ["ts", "event_id"]).select("user_id", "window", "event_id", "value")


@query("SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3")
def top_n_per_key(spark, d):
    return ops.top_n(t(spark, d, "orders"), "o_totalprice", 3, None, ["o_orderkey"], "o_custkey").select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query('SELECT (rn - 1) // 500 AS "window", o_orderkey, o_totalprice, row_number() OVER (PARTITION BY (rn - 1) // 500 ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) QUALIFY rank <= 5')
def top_n_global(spark, d):
    return ops.top_n(t(spark, d, "orders"), "o_totalprice", 5, 500, ["o_orderkey"]).select("window", "o_orderkey", "o_totalprice", "rank")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, event_id, ts, rn, ts AS last, TRUE AS kept FROM e WHERE rn = 1
UNION ALL SELECT e.user_id, e.event_id, e.ts, e.rn, CASE WHEN e.ts - f.last >= INTERVAL 1 DAY THEN e.ts ELSE f.last END, e.ts - f.last >= INTERVAL 1 DAY FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT user_id, event_id FROM f WHERE kept""")
def dedup_window(spark, d):
    return ops.deduplicate(t(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "24h", ["event_id"]).select("user_id", "event_id")


# Event-time windows


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS count, round(sum(value), 4) AS sum_value FROM events WHERE value >= 5 GROUP BY ALL")
def evt_tumbling(spark, d):
    e = t(spark, d, "events").where("value >= 5")
    return ops.event_tumbling(e, "ts", "1h", "count, sum:value", "event_type").withColumn("sum_value", F.round("sum_value", 4))


@query("""SELECT w AS window_start, w + INTERVAL 6 HOUR AS window_end, user_id, count(*) AS count FROM (
SELECT user_id, unnest([b - INTERVAL 4 HOUR, b - INTERVAL 2 HOUR, b]) AS w FROM (SELECT *, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') AS b FROM events)) GROUP BY ALL""")
def evt_hop(spark, d):
    return ops.event_sliding(t(spark, d, "events"), "ts", "6h", "2h", "count", "user_id")


_SESSIONS = """SELECT user_id, {0} AS s0, {1} AS s1, count(*) AS count FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY x, event_id) AS sid FROM (
SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY user_id ORDER BY x, event_id) <= {2} THEN 0 ELSE 1 END AS new FROM (SELECT *, {3} AS x FROM events))) GROUP BY user_id, sid"""


@query("SELECT s0 AS window_start, s1 AS window_end, user_id, count FROM (" + _SESSIONS.format("min(x)", "max(x) + INTERVAL 3 HOUR", "INTERVAL 3 HOUR", "ts") + ")")
def evt_session(spark, d):
    return ops.event_sessions(t(spark, d, "events"), "ts", "3h", "count", "user_id")


@query("SELECT s0 AS sec, user_id, count FROM (" + _SESSIONS.format("min(x)", "max(x)", "10800", "CAST(floor(epoch(ts)) AS BIGINT)") + ")")
def int_session(spark, d):
    return ops.event_sessions(_events_ts(spark, d), "sec", 10_800, "count", "user_id")


@query("SELECT s // 7200 * 7200 AS sec, event_type, count(*) AS count, max(value) AS max_value FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events) GROUP BY ALL")
def int_tumbling(spark, d):
    return ops.event_tumbling(_events_ts(spark, d), "sec", 7200, "count, max:value", "event_type")


@query("""SELECT w AS sec, event_type, count(*) AS count FROM (SELECT event_type, unnest(range((s - 10000) // 3000 * 3000 + 3000, s + 1, 3000)) AS w
FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)) GROUP BY ALL""")
def int_hop(spark, d):
    return ops.event_sliding(_events_ts(spark, d), "sec", 10_000, 3_000, "count", "event_type")


@query("SELECT event_id, make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) AS _event_time FROM events")
def assign_timestamps(spark, d):
    return ops.assign_timestamp(_events_ts(spark, d), "sec").select("event_id", F.col("_event_time").cast("timestamp_ntz").alias("_event_time"))


# Joins

_CUSTOMER = "(SELECT c_custkey, c_name, c_mktsegment FROM customer)"


def _dim(spark, d, how, **more):
    c = t(spark, d, "customer")
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ops.hash_join(o, c, "o_custkey", "c_custkey", {"c_name": "name", "c_mktsegment": "segment"}, how, build_order=["c_name"], **more)


@query(f"SELECT o_orderkey, o_custkey, o_totalprice, c_name AS name, c_mktsegment AS segment FROM orders JOIN {_CUSTOMER} ON o_custkey = c_custkey")
def dim_join_inner(spark, d):
    return _dim(spark, d, "inner")


@query(f"SELECT o_orderkey, o_custkey, o_totalprice, c_name AS name, c_mktsegment AS segment FROM orders LEFT JOIN {_CUSTOMER} ON o_custkey = c_custkey")
def dim_join_left(spark, d):
    return _dim(spark, d, "left")


@query("SELECT o_orderkey, o_custkey, l_partkey AS part, l_quantity AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def dim_join_multi(spark, d):
    return ops.hash_join(t(spark, d, "orders").select("o_orderkey", "o_custkey"), t(spark, d, "lineitem"), "o_orderkey", "l_orderkey", {"l_partkey": "part", "l_quantity": "quantity"}, multi=True)


@query("SELECT o_orderkey, o_custkey, arg_max(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS part FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def dim_join_last(spark, d):
    return ops.hash_join(t(spark, d, "orders").select("o_orderkey", "o_custkey"), t(spark, d, "lineitem"), "o_orderkey", "l_orderkey", {"l_partkey": "part"}, build_order=["l_linenumber", "l_partkey"])


_URGENT = "(SELECT * FROM orders WHERE o_orderpriority = '1-URGENT')"


def _urgent(spark, d, how):
    urgent = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return ops.hash_join(t(spark, d, "customer").select("c_custkey"), urgent, "c_custkey", "o_custkey", {}, how, multi=True)


@query(f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM {_URGENT} WHERE o_custkey = c_custkey)")
def anti_join(spark, d):
    return _urgent(spark, d, "left_anti")


@query(f"SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM {_URGENT} WHERE o_custkey = c_custkey)")
def semi_join(spark, d):
    return _urgent(spark, d, "left_semi")


@query("SELECT c_custkey, c_name, s_name AS supplier FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 2")
def full_join(spark, d):
    s = t(spark, d, "supplier").select((F.col("s_suppkey") * 2).alias("k"), "s_name")
    return ops.hash_join(t(spark, d, "customer").select("c_custkey", "c_name"), s, "c_custkey", "k", {"s_name": "supplier"}, "full", multi=True)


@query("SELECT c_custkey, c_name, s_name AS supplier FROM customer RIGHT JOIN supplier ON c_custkey = s_suppkey * 2")
def right_join(spark, d):
    s = t(spark, d, "supplier").select((F.col("s_suppkey") * 2).alias("k"), "s_name")
    return ops.hash_join(t(spark, d, "customer").select("c_custkey", "c_name"), s, "c_custkey", "k", {"s_name": "supplier"}, "right", multi=True)


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS count, round(stddev_samp(o_totalprice), 3) AS deviation, round(median(o_totalprice), 4) AS middle FROM orders GROUP BY ALL ORDER BY 1, 2")
def sorted_spread(spark, d):
    values = [F.count("*").alias("count"), F.round(F.stddev("o_totalprice"), 3).alias("deviation"), F.round(F.median("o_totalprice"), 4).alias("middle")]
    return ops.group_by(t(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], values, ordered=True)


_INTERVAL = "SELECT l.user_id, l.event_id, l.ts, r.event_id AS event_id_r, r.ts AS ts_r FROM (SELECT * FROM events WHERE event_type = 'click') l JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND abs(epoch_us(l.ts) - epoch_us(r.ts)) <= 7200000000"


def _interval(spark, d, bucket):
    e = t(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    l, r = (e.where(F.col("event_type") == k).drop("event_type") for k in ("click", "purchase"))  # noqa: E741
    return ops.interval_join(l, r, "user_id", "ts", "2h", bucket)


@query(_INTERVAL)
def interval_join(spark, d):
    return _interval(spark, d, False)


@query(_INTERVAL)
def interval_join_bucketed(spark, d):
    return _interval(spark, d, True)


@query("""WITH b AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events),
c AS (SELECT *, count(*) FILTER (event_type = 'click') OVER w AS lc, count(*) FILTER (event_type = 'purchase') OVER w AS rc FROM b WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
l AS (SELECT * FROM c WHERE event_type = 'click'), r AS (SELECT * FROM c WHERE event_type = 'purchase')
SELECT l.user_id, l.event_id AS click, r.event_id AS purchase FROM l JOIN r ON l.user_id = r.user_id AND ((l.seq < r.seq AND l.lc > r.lc - 2) OR (r.seq < l.seq AND r.rc > l.rc - 2))""")
def mixed_join_bounded(spark, d):
    e = ops.number_rows(t(spark, d, "events"), ["ts", "event_id"], "seq")
    l, r = (e.where(F.col("event_type") == k) for k in ("click", "purchase"))  # noqa: E741
    return ops.bounded_join(l, r, "user_id", "user_id", 2, "seq", [F.col("l.user_id"), F.col("l.event_id").alias("click"), F.col("r.event_id").alias("purchase")]).drop("_seq", "_with")


@query("SELECT c_custkey, coalesce(n_name, '') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def side_lookup(spark, d):
    return ops.side_lookup(t(spark, d, "customer").select("c_custkey", "c_nationkey"), t(spark, d, "nation"), "c_nationkey", "n_nationkey", "n_name", "nation").select("c_custkey", "nation")


@query("SELECT p.user_id, p.event_id, c.value AS value_r FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY ALL) c ON p.user_id = c.user_id AND p.ts >= c.ts")
def as_of(spark, d):
    e = t(spark, d, "events")
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    return ops.as_of_join(e.where("event_type = 'purchase'").select("user_id", "event_id", "ts", "value"), clicks, "user_id", "ts", ["value"]).select("user_id", "event_id", "value_r")


# Python functions


@query("SELECT user_id, count(*) AS n, max(value) - min(value) AS spread FROM events GROUP BY user_id")
def user_aggregate(spark, d):
    """A user's aggregate, folded in each task before it is merged."""
    add = lambda a, r: (a[0] + 1, min(a[1], r["value"]), max(a[2], r["value"]))
    merge = lambda a, b: (a[0] + b[0], min(a[1], b[1]), max(a[2], b[2]))
    return ops.aggregate_by(t(spark, d, "events").select("user_id", "value"), "user_id", lambda: (0, float("inf"), float("-inf")), add, merge, lambda a: {"n": a[0], "spread": a[2] - a[1]}, "n bigint, spread double")


@query("SELECT event_id, k FROM (SELECT event_id, unnest(CASE WHEN event_type = 'click' THEN ['c', 'k'] WHEN event_type = 'view' THEN ['v'] ELSE [] END) AS k FROM events WHERE user_id % 2 = 0)")
def flat_map_function(spark, d):
    kinds = {"click": ("c", "k"), "view": ("v",)}
    e = ops.filter_by(t(spark, d, "events").select("event_id", "user_id", "event_type"), lambda r: r["user_id"] % 2 == 0)
    return ops.flat_map_rows(e, lambda r: ({"event_id": r["event_id"], "k": k} for k in kinds.get(r["event_type"], ())), "event_id bigint, k string")


@query("SELECT event_id, user_id, value, NULL::VARCHAR AS other FROM events")
def frames_round_trip(spark, d):
    from .sources import read_frames, to_frames

    return read_frames(to_frames(t(spark, d, "events").select("event_id", "user_id", "value")), "value", "event_id bigint, user_id bigint, value double, other string")


# Schemas, jobs, lineage


@query("SELECT CAST(event_id AS VARCHAR) AS id, CAST(trunc(value) AS BIGINT) AS score, event_type = 'click' AS clicked, '' AS tag FROM events")
def schema_adapt(spark, d):
    e = t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").cast("string").alias("value"), F.when(F.col("event_type") == "click", "true").otherwise("false").alias("clicked"), "props")
    return adapt(e, Schema("events", 2, [Field("id", "string"), Field("score", "int", alias="value"), Field("clicked", "bool"), Field("tag", "string", default="")]))


@query("SELECT user_id, count(*) AS count, max(value) AS max_value FROM events WHERE user_id >= 10 GROUP BY user_id")
def job_groupby(spark, d):
    plans.register_source("events", lambda s, **_: t(s, d, "events").withColumn("_seq", F.col("event_id")))
    job = {"name": "by-user", "source": {"type": "ref:events"}, "sink": {"type": "memory"}, "stages": [{"label": "f", "op": "vec-filter", "field": "user_id", "value": 10}, {"label": "b", "op": "to-batch"}, {"label": "g", "op": "vec-groupby", "key": "user_id", "agg": "count, max:value"}, {"label": "r", "op": "to-rows"}]}
    return plans.build(spark, job).frame


@query("SELECT event_id, user_id, value * 2 AS value, NULL AS scored, NULL AS seen FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, user_id, value, value, NULL FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, user_id, value, NULL, 'all' FROM events WHERE user_id <= 3")
def job_branches(spark, d):
    plans.register_source("events", lambda s, **_: t(s, d, "events").select("event_id", "user_id", "event_type", "value"))
    plans.register_operator("copy", lambda df, field, to: df.withColumn(to, F.col(field)))
    plans.register_operator("without", lambda df, fields: df.drop(*fields))
    stages = [
        {"label": "start", "op": "to-batch", "next": ["views", "sales", "first"]},
        {"label": "views", "op": "filter", "field": "event_type", "cmp": "eq", "value": "view", "next": ["double"]},
        {"label": "double", "op": "vec-map", "field": "value", "arith": "mul", "value": 2, "next": ["out"]},
        {"label": "sales", "op": "filter", "field": "event_type", "cmp": "eq", "value": "purchase", "next": ["score"]},
        {"label": "score", "op": "ref:copy", "field": "value", "to": "scored", "next": ["out"]},
        {"label": "first", "op": "vec-filter", "field": "user_id", "cmp": "lte", "value": 3, "next": ["seen"]},
        {"label": "seen", "op": "map-set", "field": "seen", "value": "all", "next": ["out"]},
        {"label": "out", "op": "ref:without", "fields": ["event_type"], "next": []},
    ]
    job = {"name": "fan", "source": {"type": "ref:events"}, "sink": {"type": "memory"}, "stages": stages}
    return plans.build(spark, job).frame


@query("SELECT i AS id, 'tx-' || i AS name, 'eu' AS region FROM range(1000) r(i)")
def generated_rows(spark, d):
    return generator(spark, {"id": "seq", "name": "tx-${seq}", "region": "eu"}, rows=1000).drop("_seq")


@query("SELECT user_id, count(*) AS n_parents, sum(1)::BIGINT AS n FROM events GROUP BY user_id")
def lineage_parents(spark, d):
    e = stamp(t(spark, d, "events"), ["event_id"])
    return with_parents(e, ["user_id"], F.count("*").alias("n")).select("user_id", F.size("_parents").cast("bigint").alias("n_parents"), "n")


@query("WITH RECURSIVE a AS (SELECT i AS r, i // 2 AS p FROM range(1, 200) t(i) WHERE i > 1 UNION ALL SELECT a.r, a.p // 2 FROM a WHERE a.p > 1) SELECT r AS _rid, p AS ancestor FROM a")
def lineage_ancestors(spark, d):
    edges = spark.range(2, 200).select(F.col("id").alias("_rid"), F.expr("id div 2").alias("_parent"))
    return ancestors(edges, edges)


@query("SELECT * FROM (VALUES (1::BIGINT, 'a'), (2, 'b')) v(id, name)")
def memory_rows(spark, d):
    return memory(spark, [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}])


# The generated auction workload: as many rows as ``lineitem`` has

_NUMBERS = "(SELECT row_number() OVER () - 1 AS i FROM lineitem)"

_CH = "['Google','Facebook','Baidu','Apple','Amazon']"
_B = f"(SELECT i AS _seq, i % 1000 AS auction, i % 10000 AS bidder, i * 97 % 100000 + 1 AS price, {_CH}[i % 5 + 1] AS channel, 'https://nexmark/' || {_CH}[i % 5 + 1] AS url, i + 1700000000000 AS dateTime, 'x' AS extra FROM {_NUMBERS})"
_E = f"(SELECT i AS _seq, i % 50 AS slot, i // 50 AS b FROM {_NUMBERS})"
_PERSON = f"(SELECT _seq, b % 1000 AS id, 'person-' || {_CH}[b % 5 + 1] AS name, {_CH}[b % 5 + 1] AS city, ['OR','ID','CA','WA','NY','TX','FL','OH'][b % 1000 % 8 + 1] AS state FROM {_E} WHERE slot = 0)"
_AUCTION = f"(SELECT _seq, i % 1000 AS id, i % 1000 AS seller, i % 10 AS category FROM (SELECT *, b * 3 + slot - 1 AS i FROM {_E} WHERE slot BETWEEN 1 AND 3))"
_MBID = f"(SELECT _seq, i % 1000 AS auction, i % 1000 AS bidder, i * 97 % 100000 + 1 AS price FROM (SELECT *, b * 46 + slot - 4 AS i FROM {_E} WHERE slot > 3))"


def _joined(left: str, lkey: str, right: str, rkey: str, m: int, columns: str) -> str:
    """Both sides are counted by key; a row meets those of the other side whose numbers are the last ``m`` before it."""
    return f"""(WITH u AS MATERIALIZED (SELECT *, count(l) OVER w AS lc, count(r) OVER w AS rc FROM (
SELECT {lkey} AS k, _seq, l, NULL AS r FROM {left} l UNION ALL SELECT {rkey}, _seq, NULL, r FROM {right} r) WINDOW w AS (PARTITION BY k ORDER BY _seq)),
ls AS (SELECT k, _seq AS s, l, lc AS n, unnest(range(greatest(rc - {m - 1}, 1), rc + 1)) AS o FROM u WHERE l IS NOT NULL),
rs AS (SELECT k, _seq AS s, r, rc AS n, unnest(range(greatest(lc - {m - 1}, 1), lc + 1)) AS o FROM u WHERE r IS NOT NULL),
met AS (SELECT ls.s AS _seq, u._seq AS _with, ls.l AS lc, u.r AS rc FROM ls JOIN u ON u.k = ls.k AND u.rc = ls.o AND u.r IS NOT NULL
UNION ALL SELECT rs.s, u._seq, u.l, rs.r FROM rs JOIN u ON u.k = rs.k AND u.lc = rs.o AND u.l IS NOT NULL)
SELECT _seq, _with, {columns} FROM met)"""


def _windowed(source: str, key: str, size: int, value: str, order: str = "_seq") -> str:
    return f'SELECT {key}, CAST((rn - 1) // {size} AS BIGINT) AS "window", {value} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source}) GROUP BY 1, 2'


def _rows(spark: SparkSession, d: str) -> int:
    return t(spark, d, "lineitem").count()  # from the files' footers


_BA = _joined(_MBID, "auction", _AUCTION, "id", 2, "lc.auction, lc.price, lc.bidder, rc.category, rc.seller")
_NEXMARK = {
    "q0": f"SELECT * FROM {_B}",
    "q1": f"SELECT * REPLACE (CAST(trunc(price * 0.908::DOUBLE) AS BIGINT) AS price) FROM {_B}",
    "q2": f"SELECT * FROM {_B} WHERE auction % 123 = 0",
    "q3": f"SELECT * FROM {_joined(_AUCTION, 'seller', _PERSON, 'id', 4, 'rc.name, rc.city, rc.state, lc.id AS auction')} WHERE state IN ('OR', 'ID', 'CA')",
    "q4": _windowed(_BA, "category", 1000, "avg(price::DOUBLE) AS avg", "_seq, _with"),
    "q5": f"""WITH c AS ({_windowed(_B, "auction", 5000, "count(*) AS count")}), n AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN count = 5000 THEN "window" ELSE 1152921504606846976 END, auction::VARCHAR) AS rn FROM c)
SELECT auction, count, (rn - 1) // 50 AS "window", row_number() OVER (PARTITION BY (rn - 1) // 50 ORDER BY count DESC, rn) AS rank FROM n QUALIFY rank <= 1""",
    "q6": _windowed(_BA, "seller", 500, "avg(price::DOUBLE) AS avg", "_seq, _with"),
    "q7": f'SELECT _seq // 10000 AS "window", unnest(arg_max(struct_pack(auction := auction, bidder := bidder, price := price, channel := channel, url := url, dateTime := dateTime, extra := extra), price * 100000000 - _seq)) FROM {_B} GROUP BY 1',
    "q8": f"SELECT * FROM {_joined(_PERSON, 'id', _AUCTION, 'seller', 4, 'lc.id, lc.name, rc.id AS auction')}",
    "q9": _windowed(_BA, "auction", 1000, "max(price::DOUBLE) AS max", "_seq, _with"),
    "q10": f"SELECT to_json(struct_pack(auction := auction, bidder := bidder, price := price, channel := channel, url := url, dateTime := dateTime, extra := extra))::VARCHAR AS line FROM {_B}",
    "q11": f"SELECT bidder, min(dateTime) AS dateTime, count(*) AS count FROM (SELECT *, sum(new) OVER (PARTITION BY bidder ORDER BY dateTime) AS sid FROM (SELECT *, CASE WHEN dateTime - lag(dateTime) OVER (PARTITION BY bidder ORDER BY dateTime) <= 30000 THEN 0 ELSE 1 END AS new FROM {_B})) GROUP BY bidder, sid",
    "q12": _windowed(_B, "bidder", 100, "count(*) AS count"),
    "q13": f"SELECT *, 'cat-' || (auction % 10) AS side FROM {_B}",
    "q14": f"SELECT *, price / 100.0::DOUBLE AS price_dollars FROM {_B} WHERE price > 1000",
    "q15": _windowed(f"(SELECT *, dateTime // 86400000 AS day FROM {_B})", "day", 1000, "count(*) AS count"),
    "q16": _windowed(_B, "channel", 1000, "count(*) AS count"),
    "q17": _windowed(_B, "auction", 1000, "count(*) AS count"),
    "q18": f'SELECT (rn - 1) // 50 AS "window", * EXCLUDE (rn, r2) FROM (SELECT *, row_number() OVER (PARTITION BY auction, bidder, (rn - 1) // 50 ORDER BY _seq DESC) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY auction, bidder ORDER BY _seq) AS rn FROM {_B})) WHERE r2 = 1',
    "q19": f'SELECT * EXCLUDE rn, (rn - 1) // 100 AS "window", row_number() OVER (PARTITION BY auction, (rn - 1) // 100 ORDER BY price DESC, _seq) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY auction ORDER BY _seq) AS rn FROM {_B}) QUALIFY rank <= 10',
    "q20": f"SELECT * FROM {_BA}",
    "q21": f"SELECT *, split_part(url, '/', -1) AS channel_id FROM {_B}",
    "q22": f"SELECT *, string_split(url, '/')[3] AS dir FROM {_B}",
}
for _name in [f"q{i}" for i in range(23)]:
    query(_NEXMARK.get(_name), f"nexmark_{_name}")(lambda spark, d, n=_name: nexmark.run(spark, n, _rows(spark, d)))


@query(f"SELECT dateTime // 10000 * 10000 AS dateTime, max(price) AS max_price FROM {_B} GROUP BY 1")
def nexmark_q7_time(spark, d):
    return nexmark.q7_time(nexmark.bids(spark, _rows(spark, d)))


@query(f"""WITH c AS (SELECT w AS dateTime, auction, count(*) AS count FROM (SELECT auction, unnest([b - 8000, b - 6000, b - 4000, b - 2000, b]) AS w FROM (SELECT *, dateTime // 2000 * 2000 AS b FROM {_B})) GROUP BY ALL)
SELECT * FROM c QUALIFY count = max(count) OVER (PARTITION BY dateTime)""")
def nexmark_q5_time(spark, d):
    return nexmark.q5_time(nexmark.bids(spark, _rows(spark, d)))
