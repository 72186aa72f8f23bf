"""Market tables derived from the given events table; the same formulas as plans.sql.VIEWS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeweave.config import SCALE
from tapeweave.operators.running import running

STEP = SCALE // 10
RUNGS = 20


def _quantity() -> Column:
    return F.col("k") % 5 * SCALE


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("session_id"),
        F.concat(F.lit("SYM"), (F.col("user_id") % 4).cast("string")).alias("symbol"),
        (F.col("event_id") * 2).alias("seq"), "event_id", "event_type",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.floor("value").cast("bigint").alias("v"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, symbol, seq, trade_id, price, quantity, side, ts_ms, order_type."""
    e = _events(spark, sf_dir).where(F.col("event_type").isin("click", "purchase", "signup"))
    return e.select(
        "session_id", "symbol", "seq", F.col("event_id").alias("trade_id"),
        ((100_000 + F.col("v") % 20) * STEP).alias("price"), ((F.col("k") + 1) * SCALE).alias("quantity"),
        F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"), "ts_ms",
        F.when(F.col("event_id") % 97 == 0, "NA").otherwise("MARKET").alias("order_type"),
    )


def repeated_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trades in which every 7th row carries the id of an earlier one."""
    return trades(spark, sf_dir).withColumn("trade_id", F.when(F.col("trade_id") % 7 == 0, F.col("trade_id") - 14).otherwise(F.col("trade_id")))


def _updates(e: DataFrame, crossing: bool, *more: Column) -> DataFrame:
    """The book's columns of depth events, and more."""
    bid = F.col("event_id") % 2 == 0
    ask = 100_001 + F.col("v") % 20 - (F.when(F.col("event_id") % 50 == 1, 30).otherwise(0) if crossing else F.lit(0))
    return e.select(
        "session_id", "symbol", "seq", F.lit(0).alias("pos"), F.when(bid, "BID").otherwise("ASK").alias("side"),
        (F.when(bid, 100_000 - F.col("v") % 20).otherwise(ask) * STEP).alias("price"), _quantity().alias("quantity"), "ts_ms",
        (F.col("event_id") * 10).alias("first_update_id"), (F.col("event_id") * 10 + 9).alias("final_update_id"), *more,
    )


def updates(spark: SparkSession, sf_dir: str, crossing: bool = False) -> DataFrame:
    """levels without previous_final_update_id, which takes an ordering: for what reads only the book."""
    return _updates(_events(spark, sf_dir).where(F.col("event_type").isin("view", "error")), crossing)


def levels(spark: SparkSession, sf_dir: str, crossing: bool = False) -> DataFrame:
    """session_id, symbol, seq, pos, side, price, quantity, ts_ms, first_update_id, final_update_id, previous_final_update_id."""
    e = _events(spark, sf_dir).where(F.col("event_type").isin("view", "error"))
    e = running(e, "before", F.col("event_id") * 10 + 9, "last", inclusive=False)
    broken = (_quantity() == 0) & (F.col("event_id") % 7 == 0)
    return _updates(e, crossing, F.when(broken, F.lit(-1)).otherwise(F.col("before")).alias("previous_final_update_id"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After every 50th level event of a session: session_id, symbol, seq, last_update_id, ts_ms."""
    numbered = running(updates(spark, sf_dir), "n", F.lit(1).cast("bigint"), "sum")
    return numbered.where("n % 50 = 0").select("session_id", "symbol", (F.col("seq") + 1).alias("seq"), F.col("final_update_id").alias("last_update_id"), "ts_ms")


def snapshot_levels(spark: SparkSession, sf_dir: str, crossing: bool = False, heads: DataFrame | None = None) -> DataFrame:
    """The ladder of each snapshot: RUNGS levels a side, bids first; crossing lifts the bids of some above the asks. heads are snapshots made before."""
    lift = F.when(F.col("seq") % 7 == 0, 5).otherwise(0) if crossing else F.lit(0)
    rung = F.explode(F.sequence(F.lit(0), F.lit(2 * RUNGS - 1))).alias("pos")
    s = (snapshots(spark, sf_dir) if heads is None else heads).select("*", rung)
    i = (F.col("pos") % RUNGS).cast("bigint")
    bid = F.col("pos") < RUNGS
    return s.select(
        "session_id", "symbol", "seq", "pos", F.when(bid, "BID").otherwise("ASK").alias("side"),
        (F.when(bid, 100_000 - i + lift).otherwise(100_001 + i) * STEP).alias("price"), ((i + 1) * SCALE).alias("quantity"), "ts_ms", "last_update_id",
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, symbol, started_ms, ended_ms, status: a row per session; S3 claims another symbol than its rows have."""
    e = _events(spark, sf_dir).groupBy("session_id", "symbol").agg(F.min("ts_ms").alias("started_ms"), F.max("ts_ms").alias("ended_ms"))
    return e.select("session_id", F.when(F.col("session_id") == "S3", "OTHER").otherwise(F.col("symbol")).alias("symbol"), "started_ms", "ended_ms", F.lit("COMPLETED").alias("status"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, seq, symbol, stream_type, exchange_event_ms, raw_payload: trades and depth updates as the exchange's JSON."""
    text = lambda c: (F.col(c).cast("decimal(28,8)") / SCALE).cast("decimal(20,8)").cast("string")
    t = trades(spark, sf_dir).select(
        "session_id", "seq", "symbol", F.lit("trade").alias("stream_type"), F.col("ts_ms").alias("exchange_event_ms"),
        F.when(F.col("seq") % 62 == 0, F.lit("{broken")).otherwise(F.format_string('{"e":"trade","E":%d,"T":%d,"s":"%s","t":%d,"p":"%s","q":"%s","X":"%s","m":%s}', "ts_ms", "ts_ms", "symbol", "trade_id", text("price"), text("quantity"), "order_type", F.when(F.col("side") == "SELL", "true").otherwise("false"))).alias("raw_payload"),
    )
    pair = F.format_string('["%s","%s"]', text("price"), text("quantity"))
    bids, asks = F.when(F.col("side") == "BID", pair).otherwise(""), F.when(F.col("side") == "ASK", pair).otherwise("")
    d = levels(spark, sf_dir).select(
        "session_id", "seq", "symbol", F.lit("depth").alias("stream_type"), F.col("ts_ms").alias("exchange_event_ms"),
        F.format_string('{"e":"depthUpdate","E":%d,"T":%d,"s":"%s","U":%d,"u":%d,"pu":%d,"b":[%s],"a":[%s]}', "ts_ms", "ts_ms", "symbol", "first_update_id", "final_update_id", F.coalesce("previous_final_update_id", F.lit(-1)), bids, asks).alias("raw_payload"),
    )
    return t.unionByName(d)


def raw_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshots as the exchange's JSON, in raw's columns."""
    text = lambda x: (x.cast("decimal(28,8)") / SCALE).cast("decimal(20,8)").cast("string")
    side = lambda s: F.to_json(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("pos", "price", "quantity")))), lambda x: F.array(text(x["price"]), text(x["quantity"]))))
    rows = snapshot_levels(spark, sf_dir).groupBy("session_id", "symbol", "seq", "last_update_id", "ts_ms").agg(side("BID").alias("bids"), side("ASK").alias("asks"))
    payload = F.format_string('{"lastUpdateId":%d,"bids":%s,"asks":%s}', "last_update_id", "bids", "asks")
    return rows.select("session_id", "seq", "symbol", F.lit("snapshot").alias("stream_type"), F.col("ts_ms").alias("exchange_event_ms"), payload.alias("raw_payload"))
