"""Exchange messages as JSON text to typed rows, and back. Keys differ by case alone, so they are read by their exact names.

A payload is parsed once, by a generator: what is a plain expression is evaluated again in each filter that is pushed below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeweave.functions.ticks import aggressor_side, is_marker, to_ticks

LEVELS = "array<array<string>>"


def _fields(raw: DataFrame, **keys: str) -> DataFrame:
    """raw with the payload's values under these keys as text; all null where it isn't an object."""
    return raw.select("*", F.json_tuple("raw_payload", *keys.values()).alias(*keys))


def _number(name: str) -> Column:
    return F.col(name).try_cast("bigint")


def _sides(rows: DataFrame, bids: Column, asks: Column) -> DataFrame:
    """rows with bids and asks as text pairs; null where they aren't arrays of arrays."""
    rest = [c for c in rows.columns if c not in ("bids", "asks")]
    return rows.select(*rest, F.inline(F.array(F.struct(F.from_json(bids, LEVELS).alias("bids"), F.from_json(asks, LEVELS).alias("asks")))))


def parse_depth(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, rejects) of depth rows: event_ms, transaction_ms, first, final and previous ids, bids and asks as text pairs."""
    rows = _fields(raw, event_ms="E", transaction_ms="T", message_symbol="s", first_update_id="U", final_update_id="u", previous_final_update_id="pu", bids="b", asks="a")
    rows = rows.withColumns({c: _number(c) for c in ("event_ms", "transaction_ms", "first_update_id", "final_update_id", "previous_final_update_id")})
    rows = _sides(rows, F.col("bids"), F.col("asks"))
    good = F.col("event_ms").isNotNull() & F.col("first_update_id").isNotNull() & F.col("final_update_id").isNotNull() & F.col("bids").isNotNull() & F.col("asks").isNotNull()
    return rows.where(good), rows.where(~good).select(raw.columns)


def parse_trade(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, rejects) of trade rows: event_ms, trade_ms, trade_id, price and quantity as text, order_type, buyer_is_maker."""
    rows = _fields(raw, event_ms="E", trade_ms="T", message_symbol="s", trade_id="t", price_text="p", quantity_text="q", order_type="X", buyer_is_maker="m", trade_type="st")
    rows = rows.withColumns({c: _number(c) for c in ("event_ms", "trade_ms", "trade_id")} | {"buyer_is_maker": F.col("buyer_is_maker").try_cast("boolean"), "trade_type": F.coalesce(_number("trade_type"), F.lit(0))})
    good = F.col("trade_ms").isNotNull() & F.col("trade_id").isNotNull() & F.col("price_text").isNotNull() & F.col("quantity_text").isNotNull() & F.col("buyer_is_maker").isNotNull()
    return rows.where(good), rows.where(~good).select(raw.columns)


def parse_snapshot(raw: DataFrame) -> DataFrame:
    """Snapshot documents: last_update_id, bids and asks as text pairs; rows that aren't one are left out."""
    rows = _fields(raw, last_update_id="lastUpdateId", bids="bids", asks="asks").withColumn("last_update_id", _number("last_update_id"))
    return _sides(rows.where(F.col("last_update_id").isNotNull()), F.col("bids"), F.col("asks"))


def parse_book(raw: DataFrame) -> DataFrame:
    """Depth updates and snapshot documents alike: raw rows with bids and asks as text pairs; rows that are neither are left out."""
    rows = _fields(raw, b="b", a="a", bids="bids", asks="asks")
    return _sides(rows, F.coalesce("b", "bids"), F.coalesce("a", "asks")).drop("b", "a").where("bids is not null and asks is not null")


def explode_levels(messages: DataFrame) -> DataFrame:
    """One row per level of a message: all bids, then all asks, each in array order; levels that aren't numbers are left out."""
    tagged = lambda c, side: F.transform(F.col(c), lambda x: F.struct(F.lit(side).alias("side"), x[0].alias("price_text"), x[1].alias("quantity_text")))
    rest = [c for c in messages.columns if c not in ("bids", "asks")]
    rows = messages.select(*rest, F.posexplode(F.concat(tagged("bids", "BID"), tagged("asks", "ASK"))).alias("pos", "x"))
    rows = rows.select(*rest, "pos", "x.side", to_ticks(F.col("x.price_text")).alias("price"), to_ticks(F.col("x.quantity_text")).alias("quantity"))
    return rows.where(F.col("price").isNotNull() & F.col("quantity").isNotNull())


def encode_snapshot(levels: DataFrame, by: list[str]) -> DataFrame:
    """Snapshot level rows to one row per snapshot with bids and asks as JSON pairs of ticks, best first."""
    side = lambda s: F.collect_list(F.when(F.col("side") == s, F.struct("pos", "price", "quantity")))
    pairs = lambda s: F.to_json(F.transform(F.sort_array(side(s)), lambda x: F.array(x["price"], x["quantity"])))
    return levels.groupBy(*by).agg(pairs("BID").alias("bids"), pairs("ASK").alias("asks"))


def decode_snapshot(rows: DataFrame) -> DataFrame:
    """Snapshot rows back to level rows; pairs that aren't two numbers are left out."""
    read = lambda c, side: F.transform(F.from_json(F.col(c), "array<array<bigint>>"), lambda x: F.struct(F.lit(side).alias("side"), x.alias("pair")))
    rest = [c for c in rows.columns if c not in ("bids", "asks")]
    both = F.flatten(F.array_compact(F.array(read("bids", "BID"), read("asks", "ASK"))))
    out = rows.select(*rest, F.posexplode(both).alias("pos", "x")).select(*rest, "pos", F.col("x.side").alias("side"), F.col("x.pair").alias("pair"))
    return out.where(F.size("pair") == 2).select(*rest, "pos", "side", F.col("pair")[0].alias("price"), F.col("pair")[1].alias("quantity")).where("price is not null and quantity is not null")


def normalize_trades(messages: DataFrame) -> DataFrame:
    """Trade messages with status ok, marker or error, ticks and aggressor side."""
    price, quantity = to_ticks(F.col("price_text")), to_ticks(F.col("quantity_text"))
    status = F.when(is_marker(F.col("price_text"), F.col("quantity_text"), F.col("order_type")), "marker").when(price.isNull() | quantity.isNull(), "error").otherwise("ok")
    return messages.withColumns({"status": status, "price": price, "quantity": quantity, "side": aggressor_side(F.col("buyer_is_maker"))})


def depth_regroup(levels: DataFrame) -> DataFrame:
    """Level rows to one message per seq with bid and ask arrays of (price, quantity), in order."""
    side = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("pos", "price", "quantity"))))
    return levels.groupBy("session_id", "symbol", "seq").agg(side("BID").alias("bids"), side("ASK").alias("asks"))


def merge_session(snapshots: DataFrame, depth: DataFrame, trades: DataFrame) -> DataFrame:
    """One stream of the three kinds with event_type, in seq order within each session's partition."""
    tag = lambda df, name: df.withColumn("event_type", F.lit(name))
    both = tag(snapshots, "snapshot").unionByName(tag(depth, "depth"), allowMissingColumns=True).unionByName(tag(trades, "trade"), allowMissingColumns=True)
    return both.repartition("session_id", "symbol").sortWithinPartitions("session_id", "symbol", "seq")


def seq_slice(rows: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    if start is not None:
        rows = rows.where(F.col("seq") >= start)
    return rows if end is None else rows.where(F.col("seq") <= end)
