"""The price by time heatmap: cells, digests, frames and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.config import DEFAULT, SCALE, Config
from tapeweave.functions.ticks import bucket_start, clamp01, grid_price, signed
from tapeweave.operators.running import running

KEYS = ["session_id", "symbol"]
CELL = [*KEYS, "bucket", "price"]
COUNTS = ["resting_bid", "resting_ask", "liquidity_added", "liquidity_removed", "buy_volume", "sell_volume", "delta", "trade_count", "large_volume", "replenishment_count", "absorption_count", "sweep_count", "pressure"]
SUMMED = ["buy_volume", "sell_volume", "delta", "trade_count", "liquidity_added", "liquidity_removed", "large_volume", "replenishment_count", "absorption_count", "sweep_count"]


def _cells(rows: DataFrame, ms: str, cell: int, grid: int) -> DataFrame:
    return rows.withColumns({"bucket": bucket_start(F.col(ms), cell), "price": grid_price(F.col("price"), grid)})


def heat_flow(trades: DataFrame, cfg: Config = DEFAULT, grid: int = 1) -> DataFrame:
    """Per cell: executed volumes, delta, trades, pressure (equal to delta within a cell) and large volume."""
    q = F.col("quantity")
    side = lambda s: F.sum(F.when(F.col("side") == s, q).otherwise(0))
    step = F.sum(signed(q, F.col("side")))
    return _cells(trades, "ts_ms", cfg.cell, grid).groupBy(*CELL).agg(side("BUY").alias("buy_volume"), side("SELL").alias("sell_volume"), step.alias("delta"), F.count(F.lit(1)).alias("trade_count"), step.alias("pressure"), F.sum(F.when(q >= cfg.large_trade, q).otherwise(0)).alias("large_volume"))


def heat_liquidity(changes: DataFrame, cfg: Config = DEFAULT, grid: int = 1) -> DataFrame:
    """Per cell: the last quantity of each side, and what was added and removed relative to the cell's value before, from 0."""
    rows = _cells(changes, "ts_ms", cfg.cell, grid)
    w = Window.partitionBy(*CELL, "side").orderBy("seq", "pos")
    step = F.col("quantity") - F.lag("quantity", 1, 0).over(w)
    rows = rows.withColumn("step", step)
    resting = lambda s: F.coalesce(F.max_by("quantity", F.when(F.col("side") == s, F.struct("seq", "pos"))), F.lit(0)).cast("bigint")
    return rows.groupBy(*CELL).agg(resting("BID").alias("resting_bid"), resting("ASK").alias("resting_ask"), F.sum(F.greatest("step", F.lit(0))).alias("liquidity_added"), F.sum(F.greatest(-F.col("step"), F.lit(0))).alias("liquidity_removed"))


def heat_signals(signals: DataFrame, cfg: Config = DEFAULT, grid: int = 1) -> DataFrame:
    """Per cell: counts of signals (session_id, symbol, ts_ms, price, kind): sweep, absorption or replenishment."""
    count = lambda k: F.count_if(F.col("kind") == k).alias(f"{k}_count")
    return _cells(signals, "ts_ms", cfg.cell, grid).groupBy(*CELL).agg(count("sweep"), count("absorption"), count("replenishment"))


def heat_cells(trades: DataFrame, changes: DataFrame, signals: DataFrame, cfg: Config = DEFAULT, grid: int = 1) -> DataFrame:
    """Whole cells: the three contributions stacked and summed once, without an outer join."""
    parts = [heat_flow(trades, cfg, grid), heat_liquidity(changes, cfg, grid), heat_signals(signals, cfg, grid)]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return both.groupBy(*CELL).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTS))


def cell_columns(cells: DataFrame) -> DataFrame:
    """Cells with executed total, imbalance (0 without volume) and the two flags."""
    total = F.col("buy_volume") + F.col("sell_volume")
    return cells.withColumns({"total_volume": total, "imbalance": F.when(total == 0, 0.0).otherwise(F.col("delta") / total), "has_executed": F.col("trade_count") > 0, "has_resting": (F.col("resting_bid") > 0) | (F.col("resting_ask") > 0)})


def intensities(cells: DataFrame) -> DataFrame:
    """Six intensities from 0 to 1: each measure by its session's peak, 0 where the peak is 0."""
    of = {
        "liquidity": F.col("resting_bid") + F.col("resting_ask"), "execution": F.col("buy_volume") + F.col("sell_volume"), "delta": F.abs("delta"),
        "absorption": F.col("absorption_count"), "sweep": F.col("sweep_count"), "pressure": F.abs("pressure"),
    }
    peaks = cells.groupBy(*KEYS).agg(*(F.max(v).alias(f"_{k}") for k, v in of.items()))
    share = lambda k, v: F.when(F.col(f"_{k}") == 0, 0.0).otherwise(clamp01(v / F.col(f"_{k}")))
    return cells.join(peaks, KEYS).withColumns({f"{k}_intensity": share(k, v) for k, v in of.items()}).drop(*(f"_{k}" for k in of))


def range_volume(cells: DataFrame, low: int, high: int, now_ms: int, window: int) -> DataFrame:
    rows = cells.where(F.col("price").between(low, high) & (F.col("bucket") >= now_ms - window))
    return rows.groupBy(*KEYS).agg(F.sum("buy_volume").alias("buy_volume"), F.sum("sell_volume").alias("sell_volume"), F.sum(F.col("buy_volume") + F.col("sell_volume")).alias("total_volume"), F.sum("delta").alias("delta"))


def retain(cells: DataFrame, now_ms: int, retention: int = DEFAULT.retention) -> DataFrame:
    return cells.where(F.col("bucket") >= now_ms - retention)


def heat_digest(cells: DataFrame) -> DataFrame:
    """The 15 totals of each session."""
    return cells.groupBy(*KEYS).agg(F.count_distinct("bucket").alias("total_buckets"), F.count(F.lit(1)).alias("total_price_levels"), *(F.sum(c).alias(f"total_{c}") for c in COUNTS))


def cell_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*KEYS).agg(F.count_distinct("bucket").alias("bucket_count"), F.count(F.lit(1)).alias("cell_count"))


def frame_cells(cells: DataFrame, low: int, high: int) -> DataFrame:
    return cells.where(F.col("price").between(low, high))


def frame(cells: DataFrame, low: int, high: int, at_ms: int, cfg: Config = DEFAULT) -> DataFrame:
    """Per session: the frame's effective price range, the time range over all its buckets, and the summary."""
    seen = F.col("price").between(low, high)
    inside = lambda c: F.coalesce(F.sum(F.when(seen, F.col(c))), F.lit(0)).cast("bigint").alias(f"total_{c}")
    return cells.groupBy(*KEYS).agg(
        F.lit(at_ms).cast("bigint").alias("ts_ms"),
        F.coalesce(F.min(F.when(seen, F.col("price"))), F.lit(low)).cast("bigint").alias("price_low"), F.coalesce(F.max(F.when(seen, F.col("price"))), F.lit(high)).cast("bigint").alias("price_high"),
        F.coalesce(F.min("bucket"), F.lit(at_ms - cfg.retention)).alias("time_low"), F.coalesce(F.max("bucket"), F.lit(at_ms)).alias("time_high"),
        F.count_if(seen).alias("total_price_levels"), F.count_distinct("bucket").alias("total_buckets"), *(inside(c) for c in SUMMED),
    )


def visible_range(mid: Column | None = None, ticks: int = 50, cfg: Config = DEFAULT) -> tuple[Column, Column]:
    """Ticks either side of a mid price in ticks; without one, of 77300."""
    centre = F.coalesce(mid, F.lit(77_300 * SCALE)) if mid is not None else F.lit(77_300 * SCALE)
    return (centre - ticks * cfg.tick).cast("bigint"), (centre + ticks * cfg.tick).cast("bigint")


def by_price(cells: DataFrame) -> DataFrame:
    """The newest cell of each price."""
    last = F.max_by(F.struct("bucket", *COUNTS), F.col("bucket")).alias("c")
    return cells.groupBy(*KEYS, "price").agg(last).select(*KEYS, "price", "c.*")


def frame_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """What turns one frame's cells into another's: change is new, changed or removed; removed rows keep no counts."""
    old = by_price(before).select(*KEYS, "price", F.struct(*COUNTS).alias("old"))
    new = by_price(after).select(*KEYS, "price", F.struct(*COUNTS).alias("new"))
    both = old.join(new, [*KEYS, "price"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.select(*KEYS, "price", change.alias("change"), "new.*")


def summary_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences of two summaries (of frame), floored at 0 except delta."""
    names = [f"total_{c}" for c in SUMMED]
    both = after.join(before.select(*KEYS, *(F.col(c).alias(f"_{c}") for c in names)), KEYS)
    gap = lambda c: F.col(c) - F.col(f"_{c}") if c == "total_delta" else F.greatest(F.col(c) - F.col(f"_{c}"), F.lit(0))
    return both.select(*KEYS, *(gap(c).alias(c) for c in names))


def apply_diff(cells: DataFrame, diff: DataFrame) -> DataFrame:
    """One-per-price cells after a difference: its prices leave, its new and changed cells come."""
    kept = cells.join(diff.select(*KEYS, "price"), [*KEYS, "price"], "left_anti").select(*KEYS, "price", *COUNTS)
    return kept.unionByName(diff.where("change <> 'removed'").select(*KEYS, "price", *COUNTS))


def price_ladder(cells: DataFrame, low: int, high: int, most: int = 40, chunk: int = 1_000 * DEFAULT.cell) -> DataFrame:
    """Resting shares of the visible cells by their session's peak (at least 1), in bucket and price order; every so many where there are more than most.

    Places are running counts by chunks of time, so no task orders a session's cells.
    """
    rows = frame_cells(cells, low, high)
    peak = cells.groupBy(*KEYS).agg(F.greatest(F.max(F.col("resting_bid") + F.col("resting_ask")), F.lit(1)).alias("_peak"), F.count_if(F.col("price").between(low, high)).alias("_n"))
    placed = running(rows, "place", F.lit(1).cast("bigint"), "sum", inclusive=False, then=(F.col("price"),), chunk=chunk, by="bucket").join(peak, KEYS)
    stride = F.when(F.col("_n") > most, F.ceil(F.col("_n") / F.lit(most))).otherwise(1)
    return placed.where(F.col("place") % stride == 0).select(*CELL, "place", (F.col("resting_bid") / F.col("_peak")).alias("bid_share"), (F.col("resting_ask") / F.col("_peak")).alias("ask_share"))


def nearest_cell(cells: DataFrame, probes: DataFrame, chunk: int = 100 * DEFAULT.tick) -> DataFrame:
    """probes (session_id, symbol, probe_id, target) with the nearest price, if nearer than 5 % of the session's range; of ties the lower.

    Cells and probes meet in one ordering by price, cut into chunks of so many ticks: the cell before
    and the cell after a probe are its only candidates.
    """
    prices = cells.select(*KEYS, "price").distinct()
    both = prices.unionByName(probes.select(*KEYS, F.col("target").alias("price"), "probe_id"), allowMissingColumns=True)
    cell = F.when(F.col("probe_id").isNull(), F.col("price"))
    then = (F.col("probe_id").isNotNull(),)
    both = running(both, "below", cell, "last", then=then, chunk=chunk, by="price")
    both = running(both, "above", cell, "last", then=(F.col("probe_id").isNull(),), chunk=chunk, by="price", back=True)
    low, high = F.col("price") - F.col("below"), F.col("above") - F.col("price")
    near = F.when(F.col("above").isNull() | (low <= high), F.col("below")).otherwise(F.col("above"))
    span = prices.groupBy(*KEYS).agg((F.max("price") - F.min("price")).alias("span"))
    found = both.where("probe_id is not null").withColumns({"nearest": near}).join(span, KEYS)
    return found.withColumn("distance", F.abs(F.col("nearest") - F.col("price"))).where(F.col("distance") < 0.05 * F.col("span")).select(*KEYS, "probe_id", F.col("price").alias("target"), "nearest", "distance")


def overlay_trades(cells: DataFrame) -> DataFrame:
    """Marker rows of executed cells: side of the larger volume (SELL if equal), volume, is_large."""
    return cells.where("trade_count > 0").select(*CELL, F.when(F.col("buy_volume") > F.col("sell_volume"), "BUY").otherwise("SELL").alias("side"), (F.col("buy_volume") + F.col("sell_volume")).alias("volume"), (F.col("large_volume") > 0).alias("is_large"))


def _directed(cells: DataFrame, kind: str) -> DataFrame:
    rows = cells.where(F.col(f"{kind}_count") > 0)
    return rows.select(*CELL, (F.col("buy_volume") + F.col("sell_volume")).alias("volume"), F.when(F.col("delta") > 0, "BUY").otherwise("SELL").alias("direction"), F.lit(0.7).alias("confidence"))


def overlay_absorption(cells: DataFrame) -> DataFrame:
    return _directed(cells, "absorption")


def overlay_sweep(cells: DataFrame, reach: int = SCALE // 2) -> DataFrame:
    return _directed(cells, "sweep").withColumns({"price_low": F.col("price") - reach, "price_high": F.col("price") + reach})


def overlay_replenishment(cells: DataFrame) -> DataFrame:
    rows = cells.where("replenishment_count > 0")
    return rows.select(*CELL, (F.col("resting_bid") + F.col("resting_ask")).alias("quantity"), F.when(F.col("resting_bid") > F.col("resting_ask"), "BID").otherwise("ASK").alias("side"))
