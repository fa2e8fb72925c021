"""The Nexmark workload: deterministic generators and the queries q0 to q22 in their count-window form.

``_seq`` is the arrival order. The generators are projections of ``spark.range``, so any number of rows is made in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bounded_join, event_sessions, hash_join, keep_last, keyed_count_window, side_lookup, top_n

# Channels and states.
CHANNELS = ["Google", "Facebook", "Baidu", "Apple", "Amazon"]
STATES = ["OR", "ID", "CA", "WA", "NY", "TX", "FL", "OH"]
START = 1_700_000_000_000
KEYS, BIDDERS, SPAN = 1000, 10_000, 50


def _pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))


def _bid(i: Column, bidders: int) -> list[Column]:
    channel = _pick(CHANNELS, i)
    return [(i % KEYS).alias("auction"), (i % bidders).alias("bidder"), (i * 97 % 100_000 + 1).alias("price"), channel.alias("channel"), F.concat(F.lit("https://nexmark/"), channel).alias("url"), (i + START).alias("dateTime")]


def bids(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(i.alias("_seq"), *_bid(i, BIDDERS), F.lit("x").alias("extra"))


def events(spark: SparkSession, n: int) -> dict[str, DataFrame]:
    """Of every 50 events the first is a person, the next three are auctions, the others bids."""
    p, slot = F.col("id"), F.col("id") % SPAN
    block = F.floor(p / SPAN).cast("bigint")
    base = spark.range(n)
    i = F.col("i")
    person = base.where(slot == 0).select(p.alias("_seq"), block.alias("i"))
    auction = base.where(slot.between(1, 3)).select(p.alias("_seq"), (block * 3 + slot - 1).alias("i"))
    bid = base.where(slot > 3).select(p.alias("_seq"), (block * 46 + slot - 4).alias("i"))
    name = _pick(CHANNELS, i)
    return {
        "person": person.select("_seq", (i % KEYS).alias("id"), F.concat(F.lit("person-"), name).alias("name"), name.alias("city"), _pick(STATES, i % KEYS).alias("state"), (i + START).alias("dateTime")),
        "auction": auction.select("_seq", (i % KEYS).alias("id"), (i % KEYS).alias("seller"), (i % 10).alias("category"), F.concat(F.lit("item-"), name).alias("itemName"), (i + START).alias("dateTime")),
        "bid": bid.select("_seq", *_bid(i, KEYS)),
    }


def _count(df: DataFrame, key: str, size: int, skewed: bool = False) -> DataFrame:
    return keyed_count_window(df, key, size, "count", ["_seq"], skewed)


def _bid_auction(e: dict[str, DataFrame], *columns: Column) -> DataFrame:
    return bounded_join(e["bid"], e["auction"], "auction", "id", 2, "_seq", list(columns))


def _dense(df: DataFrame, size: int) -> DataFrame:
    """Windows of the bid stream, whose ``_seq`` already counts its rows."""
    return df.withColumn("window", F.floor(F.col("_seq") / size).cast("bigint"))


def q0(b: DataFrame) -> DataFrame:
    return b


def q1(b: DataFrame) -> DataFrame:
    return b.withColumn("price", (F.col("price") * F.lit(0.908)).cast("bigint"))


def q2(b: DataFrame) -> DataFrame:
    return b.where(F.col("auction") % 123 == 0)


def q3(e: dict[str, DataFrame]) -> DataFrame:
    joined = bounded_join(e["auction"], e["person"], "seller", "id", 4, "_seq", [F.col("r.name"), F.col("r.city"), F.col("r.state"), F.col("l.id").alias("auction")])
    return joined.where(F.col("state").isin("OR", "ID", "CA"))


def q4(e: dict[str, DataFrame]) -> DataFrame:
    return keyed_count_window(_bid_auction(e, F.col("r.category"), F.col("l.price")), "category", 1000, [F.avg(F.col("price").cast("double")).alias("avg")], ["_seq", "_with"])


def q5(b: DataFrame) -> DataFrame:
    counted = _count(b, "auction", 5000)
    # A full window leaves with its last row, the others at the end by key: that order fills the windows of 50.
    order = F.when(F.col("count") == 5000, F.col("window")).otherwise(F.lit(1 << 60))
    return top_n(counted.withColumn("_full", order).withColumn("_key", F.col("auction").cast("string")).drop("window"), "count", 1, 50, ["_full", "_key"], dear=True).drop("_full", "_key")


def q6(e: dict[str, DataFrame]) -> DataFrame:
    return keyed_count_window(_bid_auction(e, F.col("r.seller"), F.col("l.price")), "seller", 500, [F.avg(F.col("price").cast("double")).alias("avg")], ["_seq", "_with"])


def q7(b: DataFrame) -> DataFrame:
    best = F.max_by(F.struct(*[c for c in b.columns if c != "_seq"]), F.struct("price", -F.col("_seq"))).alias("b")
    return _dense(b, 10_000).groupBy("window").agg(best).select("window", "b.*")


def q8(e: dict[str, DataFrame]) -> DataFrame:
    return bounded_join(e["person"], e["auction"], "id", "seller", 4, "_seq", [F.col("l.id"), F.col("l.name"), F.col("r.id").alias("auction")])


def q9(e: dict[str, DataFrame]) -> DataFrame:
    return keyed_count_window(_bid_auction(e, F.col("l.auction"), F.col("l.price")), "auction", 1000, [F.max(F.col("price").cast("double")).alias("max")], ["_seq", "_with"])


def q10(b: DataFrame) -> DataFrame:
    return b.select(F.to_json(F.struct(*[c for c in b.columns if c != "_seq"])).alias("line"))


def q11(b: DataFrame) -> DataFrame:
    return event_sessions(b, "dateTime", 30_000, "count", "bidder")


def q12(b: DataFrame) -> DataFrame:
    return _count(b, "bidder", 100)


def q13(b: DataFrame) -> DataFrame:
    side = b.sparkSession.range(KEYS).select(F.col("id").alias("key"), F.concat(F.lit("cat-"), F.col("id") % 10).alias("value"))
    return side_lookup(b, side, "auction", "key", "value", "side")


def q14(b: DataFrame) -> DataFrame:
    return b.withColumn("price_dollars", F.col("price") / F.lit(100.0)).where(F.col("price") > 1000)


def q15(b: DataFrame) -> DataFrame:
    return _count(b.withColumn("day", F.expr("dateTime div 86400000")), "day", 1000, skewed=True)  # a day is one key


def q16(b: DataFrame) -> DataFrame:
    return _count(b, "channel", 1000)


def q17(b: DataFrame) -> DataFrame:
    return _count(b, "auction", 1000)


def q18(b: DataFrame) -> DataFrame:
    return keep_last(b, ["auction", "bidder"], 50, ["_seq"])


def q19(b: DataFrame) -> DataFrame:
    return top_n(b, "price", 10, 100, ["_seq"], "auction")


def q20(e: dict[str, DataFrame]) -> DataFrame:
    return _bid_auction(e, F.col("l.auction"), F.col("l.price"), F.col("l.bidder"), F.col("r.category"), F.col("r.seller"))


def q21(b: DataFrame) -> DataFrame:
    return b.withColumn("channel_id", F.when(F.contains("url", F.lit("/")), F.substring_index("url", "/", -1)))


def q22(b: DataFrame) -> DataFrame:
    parts = F.split("url", "/")
    return b.withColumn("dir", F.when(F.size(parts) > 2, F.element_at(parts, 3)))


BID = {k: globals()[k] for k in ("q0", "q1", "q2", "q5", "q7", "q10", "q11", "q12", "q13", "q14", "q15", "q16", "q17", "q18", "q19", "q21", "q22")}
MIXED = {k: globals()[k] for k in ("q3", "q4", "q6", "q8", "q9", "q20")}


def run(spark: SparkSession, name: str, n: int) -> DataFrame:
    return BID[name](bids(spark, n)) if name in BID else MIXED[name](events(spark, n))


# Forms with event-time windows, as the benchmark was first described: 10-second tumbling and hopping windows over ``dateTime``.


def q5_time(b: DataFrame) -> DataFrame:
    """Hot items: the auctions with most bids in each 10-second window, every 2 seconds."""
    from .operators import event_sliding

    counted = event_sliding(b, "dateTime", 10_000, 2_000, "count", "auction")
    most = counted.groupBy("dateTime").agg(F.max("count").alias("count"))
    return hash_join(counted.withColumn("_w", F.struct("dateTime", "count")), most.withColumn("_w", F.struct("dateTime", "count")).withColumn("hot", F.lit(True)), "_w", "_w", {"hot": "hot"}, multi=True).select("dateTime", "auction", "count")


def q7_time(b: DataFrame) -> DataFrame:
    """The highest price in each 10-second window."""
    from .operators import event_tumbling

    return event_tumbling(b, "dateTime", 10_000, "max:price")
