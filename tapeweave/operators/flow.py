"""Order flow: totals, profiles, time buckets and running delta. Input: trades with session_id, symbol, seq, price, quantity, side, ts_ms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.config import DEFAULT, Config
from tapeweave.functions.ticks import bucket_start, notional, notional_float, signed
from tapeweave.operators.running import running

KEYS = ["session_id", "symbol"]


def buy() -> Column:
    return F.sum(F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(0))


def sell() -> Column:
    return F.sum(F.when(F.col("side") == "SELL", F.col("quantity")).otherwise(0))


def delta() -> Column:
    return F.sum(signed(F.col("quantity"), F.col("side")))


def measures(cfg: Config = DEFAULT) -> list[Column]:
    return [buy().alias("buy_volume"), sell().alias("sell_volume"), F.sum("quantity").alias("total_volume"), delta().alias("delta"), F.count(F.lit(1)).alias("trade_count")]


def flow_totals(trades: DataFrame) -> DataFrame:
    """Per session: the measures and cvd, which equals delta over a whole session."""
    return trades.groupBy(*KEYS).agg(*measures()).withColumn("cvd", F.col("delta"))


def volume_at_price(trades: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per session and price: the measures and the number of large trades."""
    return trades.groupBy(*KEYS, "price").agg(*measures(), F.count_if(F.col("quantity") >= cfg.large_trade).alias("large_trade_count"))


def volume_between(profile: DataFrame, low: int, high: int) -> DataFrame:
    return profile.where(F.col("price").between(low, high))


def time_buckets(trades: DataFrame, intervals: Sequence[int] = DEFAULT.intervals) -> DataFrame:
    """Tumbling buckets of several intervals in one pass.

    A bucket ends where the next one that has a trade starts, and its cvd_end includes that next
    bucket's first trade, whose arrival closes it; cvd_close is the sum at its own last trade. The
    newest bucket of an interval is open: end_ms and cvd_end are null.
    """
    each = trades.withColumn("interval_ms", F.explode(F.array(*[F.lit(i).cast("bigint") for i in intervals])))
    each = each.withColumn("start_ms", bucket_start(F.col("ts_ms"), F.col("interval_ms")))
    first = F.min_by(signed(F.col("quantity"), F.col("side")), F.col("seq")).alias("first")
    by = [*KEYS, "interval_ms"]
    b = each.groupBy(*by, "start_ms").agg(*measures(), first)
    w = Window.partitionBy(*by).orderBy("start_ms")
    b = b.withColumn("cvd_close", F.sum("delta").over(w))
    return b.withColumns({"end_ms": F.lead("start_ms").over(w), "cvd_end": F.col("cvd_close") + F.lead("first").over(w)}).drop("first")


def completed_buckets(buckets: DataFrame, interval: int) -> DataFrame:
    return buckets.where((F.col("interval_ms") == interval) & F.col("end_ms").isNotNull())


def cvd(trades: DataFrame) -> DataFrame:
    """Each trade with the running signed volume of its session."""
    rows = trades.withColumn("signed_quantity", signed(F.col("quantity"), F.col("side")))
    return running(rows, "cvd", F.col("signed_quantity"), "sum")


def flow_digest(trades: DataFrame, levels: bool = False) -> DataFrame:
    """Totals of a session, the number of its price levels, and a hash of its profile; levels adds the profile itself, as a list.

    The hash is the sum of the price levels' own hashes (60 bits of an MD5 each): equal for equal
    profiles, whatever order or partition they come in, and of a fixed size.
    """
    profile = volume_at_price(trades)
    values = ["price", "total_volume", "buy_volume", "sell_volume", "delta"]
    code = F.conv(F.substring(F.md5(F.concat_ws(",", *values)), 1, 15), 16, 10).cast("decimal(20,0)")
    made = [F.sum(code).cast("string").alias("profile_hash"), F.count(F.lit(1)).alias("level_count")]
    made += [F.sort_array(F.collect_list(F.struct(*values))).alias("levels")] if levels else []
    return flow_totals(trades).join(profile.groupBy(*KEYS).agg(*made), KEYS)


def aggressor_counts(trades: DataFrame) -> DataFrame:
    return trades.groupBy(*KEYS).agg(F.count_if(F.col("side") == "BUY").alias("buy_trades"), F.count_if(F.col("side") == "SELL").alias("sell_trades"))


def events_per_second(rows: DataFrame) -> DataFrame:
    """Rows per session and second of event time; seconds without rows have none."""
    return rows.groupBy(*KEYS, bucket_start(F.col("ts_ms"), 1_000).alias("second_ms")).agg(F.count(F.lit(1)).alias("events"))


def last_trade(trades: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("seq", "trade_id", "price", "quantity", "side", "ts_ms"), F.col("seq")).alias("t")
    return trades.groupBy(*KEYS).agg(best).select(*KEYS, "t.*")


def large_trades(trades: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    big = trades.where(F.col("quantity") >= cfg.large_trade)
    p, q = F.col("price"), F.col("quantity")
    return big.withColumns({"notional": notional(p, q), "notional_float": notional_float(p, q)})


def recent_large_trades(trades: DataFrame, n: int = 512, cfg: Config = DEFAULT) -> DataFrame:
    """The newest n large trades of each session; a group limit runs before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("seq").desc()))
    return large_trades(trades, cfg).withColumn("rank", rank).where(F.col("rank") <= n)
