"""Structured Streaming forms of the order-dependent operators; the machines that hold a key's state are in state.py."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapeweave.config import DEFAULT, Config
from tapeweave.functions.ticks import bucket_start, signed
from tapeweave.operators import signals
from tapeweave.sources import tables, wire
from tapeweave.streaming.state import Accepted, Cells, Epochs, Measures, Refills, Statuses, on_time, ordered

KEYS = ["session_id", "symbol"]
Step = Callable[[Any, pd.DataFrame], tuple[Any, pd.DataFrame]]


# --- R-01 --------------------------------------------------------------------------------------


def stream_bronze(raw: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Raw messages to the raw, trades and level tables, batch by batch; a batch that is retried overwrites its own folder."""

    def store(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        depth = wire.explode_levels(wire.parse_depth(batch.where("stream_type = 'depth'"))[0]).withColumnRenamed("exchange_event_ms", "ts_ms")
        trades = wire.normalize_trades(wire.parse_trade(batch.where("stream_type = 'trade'"))[0]).where("status = 'ok'").withColumnRenamed("exchange_event_ms", "ts_ms")
        levels = [*KEYS, "seq", "pos", "side", "price", "quantity", "ts_ms", "first_update_id", "final_update_id", "previous_final_update_id"]
        made = {tables.RAW: batch, tables.UPDATES: depth.select(levels), tables.TRADES: trades.select(*KEYS, "seq", "trade_id", "price", "quantity", "side", "ts_ms", "order_type")}
        for name, rows in made.items():
            tables.write(rows, root, name, "overwrite", f"batch={number}")
        batch.unpersist()

    return raw.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- R-02 --------------------------------------------------------------------------------------


def stream_flow(trades: DataFrame, interval: int = DEFAULT.cell, late: str = "15 minutes", cfg: Config = DEFAULT) -> DataFrame:
    """Volumes per session, bucket and price; a bucket is given out once the watermark has passed it."""
    q = F.col("quantity")
    side = lambda s: F.sum(F.when(F.col("side") == s, q).otherwise(0))
    timed = trades.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    by = [*KEYS, F.window("ts", f"{interval} milliseconds"), "price"]
    out = timed.groupBy(*by).agg(side("BUY").alias("buy_volume"), side("SELL").alias("sell_volume"), F.sum(signed(q, F.col("side"))).alias("delta"), F.count(F.lit(1)).alias("trade_count"), F.sum(F.when(q >= cfg.large_trade, q).otherwise(0)).alias("large_volume"))
    return out.select(*KEYS, F.unix_millis("window.start").alias("bucket"), "price", "buy_volume", "sell_volume", "delta", "trade_count", "large_volume")


# --- R-03 --------------------------------------------------------------------------------------

CLUSTER = "cluster long, start_ms long, end_ms long, high long, low long, total_volume long, buy_volume long, sell_volume long, trade_count long, largest_trade long, first_price long, last_price long, levels_crossed long, monotonic boolean, last_seq long, delta long, dominant_side string, dominance double, closed boolean"


# How partial measures of one cluster unite: those of a batch's trades, and those of the open cluster with a batch's.
UNITE = {"start_ms": "first", "end_ms": "last", "high": "max", "low": "min", "total_volume": "sum", "buy_volume": "sum", "trade_count": "sum", "largest_trade": "max", "first_price": "first", "last_price": "last", "moves": "sum", "against": "sum", "last_seq": "last"}


def clustering(gap: int, reach: int) -> Step:
    """The partial measures of the open cluster as state; a batch's clusters are cut and measured in columns, and all but the last are closed."""

    def step(held: dict | None, t: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        before = t[["ts_ms", "price"]].shift().astype("Int64")
        if held:
            before.iloc[0] = [held["end_ms"], held["last_price"]]
        new = (before["ts_ms"].isna() | (t["ts_ms"] - before["ts_ms"] > gap) | ((t["price"] - before["price"]).abs() > reach)).fillna(True).astype(bool)
        cluster = (held["cluster"] if held else 0) + new.cumsum()
        move = (t["price"] - before["price"]).where(~new, 0)
        bought = t["quantity"].where(t["side"] == "BUY", 0)
        balance = (2 * bought - t["quantity"]).groupby(cluster).cumsum() - (2 * bought - t["quantity"])
        if held:
            balance = balance + (2 * held["buy_volume"] - held["total_volume"]) * (cluster == held["cluster"])
        parts = pd.DataFrame(
            {
                "cluster": cluster, "start_ms": t["ts_ms"], "end_ms": t["ts_ms"], "high": t["price"], "low": t["price"], "total_volume": t["quantity"], "buy_volume": bought, "trade_count": 1, "largest_trade": t["quantity"],
                "first_price": t["price"], "last_price": t["price"], "moves": (move != 0).astype("int64"), "against": ((move != 0) & ((move > 0) != (balance >= 0))).astype("int64"), "last_seq": t["seq"],
            }
        )
        measured = pd.concat([pd.DataFrame([held] if held else []), parts]).groupby("cluster", as_index=False).agg(UNITE).astype("int64")
        done = measured.iloc[:-1]
        sold = done["total_volume"] - done["buy_volume"]
        out = done.assign(
            sell_volume=sold, levels_crossed=done["moves"] + 1, monotonic=done["against"] == 0, delta=done["buy_volume"] - sold, dominant_side=np.where(done["buy_volume"] >= sold, "BUY", "SELL"),
            dominance=np.where(done["total_volume"] > 0, np.maximum(done["buy_volume"], sold) / done["total_volume"].clip(lower=1), 0.0), closed=True,
        )
        return {k: int(v) for k, v in measured.iloc[-1].items()}, out

    return step


def stream_clusters(trades: DataFrame, gap: int = DEFAULT.cluster_gap, reach: int = DEFAULT.cluster_range * DEFAULT.tick) -> DataFrame:
    return ordered(trades, KEYS, Measures, CLUSTER, clustering(gap, reach))


def stream_sweeps(trades: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Sweeps as their clusters close; the gates and the score are those of the batch form."""
    return signals.sweeps(on_time(stream_clusters(trades, cfg.cluster_gap, cfg.cluster_range * cfg.tick)), cfg)


# --- R-04 --------------------------------------------------------------------------------------


def stream_replenishment(raw: DataFrame, window: int = DEFAULT.replenishment_window, late: str = "15 minutes") -> DataFrame:
    """Refills from raw messages (session_id, symbol, seq, stream_type, exchange_event_ms, raw_payload), of which depth updates and snapshots count.

    Two states in a row: a session counts its snapshots, and a level, whose rows carry that count, matches
    refills. Messages that the watermark has left behind by more than late are dropped.
    """
    ms = F.col("exchange_event_ms")
    messages = raw.where(F.col("stream_type").isin("depth", "snapshot")).select(*KEYS, "seq", "stream_type", "exchange_event_ms", "raw_payload")
    timed = messages.withColumn("ts", F.timestamp_millis(ms)).withWatermark("ts", late)
    counted = on_time(ordered(timed, KEYS, Epochs, "seq long, stream_type string, exchange_event_ms long, raw_payload string, ts timestamp, epoch long", timed="ts", ts="ts"))
    rows = wire.explode_levels(wire.parse_book(counted)).select(*KEYS, "side", "price", "seq", "pos", "quantity", F.col("exchange_event_ms").alias("ts_ms"), "ts", "epoch", (F.col("stream_type") == "snapshot").alias("seed"))
    rows = rows.where("not seed or quantity > 0")
    return on_time(ordered(rows, [*KEYS, "side", "price"], Refills, "epoch long, seq long, pos int, ts_ms long, quantity long", window, True, timed="ts"))


# --- R-05, R-06 --------------------------------------------------------------------------------


def stream_sequence(rows: DataFrame) -> DataFrame:
    """Status of each depth update once it is known; one still buffered has none yet. rows: headers and snapshots with snapshot_id."""
    return ordered(rows, KEYS, Statuses, "seq long, status string")


def stream_dedup(trades: DataFrame, window: int = DEFAULT.dedup_window) -> DataFrame:
    """trades with status as sequence.classify_trades gives it."""
    return ordered(trades, KEYS, Accepted, "seq long, trade_id long, status string", window)


def stream_dedup_rows(rows: DataFrame, keys: list[str], ms: str = "ts_ms", late: str = "15 minutes") -> DataFrame:
    """One row per key, as batches retry: repeats within late of each other collapse, and state goes with the watermark."""
    return rows.withColumn("_ts", F.timestamp_millis(ms)).withWatermark("_ts", late).dropDuplicatesWithinWatermark(keys).drop("_ts")


# --- R-07 --------------------------------------------------------------------------------------


def stream_frame_diff(trades: DataFrame, cfg: Config = DEFAULT, retention: int | None = None, late: str = "15 minutes") -> DataFrame:
    """What each micro-batch changes in the frame: per price that it touches the newest cell's values, with change (new, changed, removed) and version.

    A batch costs what it touches: the frame is the state, one cell a price. Flow measures only. With
    retention, a cell goes that much after its bucket began.
    """
    q = F.col("quantity")
    side = lambda s: F.when(F.col("side") == s, q).otherwise(0)
    rows = trades.select(
        *KEYS, "price", "seq", F.timestamp_millis("ts_ms").alias("ts"), bucket_start(F.col("ts_ms"), cfg.cell).alias("bucket"), side("BUY").alias("buy_volume"), side("SELL").alias("sell_volume"),
        signed(q, F.col("side")).alias("delta"), F.lit(1).cast("bigint").alias("trade_count"), F.when(q >= cfg.large_trade, q).otherwise(0).alias("large_volume"),
    )
    cells = "version long, change string, bucket long, buy_volume long, sell_volume long, delta long, trade_count long, large_volume long"
    return on_time(ordered(rows.withWatermark("ts", late), [*KEYS, "price"], Cells, cells, retention, timed="ts"))


# --- Running -----------------------------------------------------------------------------------


def replayed(spark: SparkSession, rows: DataFrame, path: str, batches: int = 3, files: int = 4, most: int = 500_000) -> DataFrame:
    """A stream over rows, which are written below path in order of seq, as so many micro-batches of at least so many files.

    rows are made once, beside path, and dealt from there; a file holds about most of them, so that
    a large batch is written and read by all cores.
    """
    made = f"{path}-made"
    rows.write.parquet(made)
    rows = spark.read.schema(rows.schema).parquet(made)
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("seq"), F.max("seq")).first()
    low, high = low or 0, high or 0
    step = (high - low) // batches + 1
    files = max(files, -(-n // (batches * most)))
    for i in range(batches):
        rows.where(F.col("seq").between(low + i * step, low + (i + 1) * step - 1)).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, and read what it wrote."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
