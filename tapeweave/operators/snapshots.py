"""Periodic microstructure snapshots."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.config import DEFAULT, Config
from tapeweave.functions.ticks import signed
from tapeweave.operators.book import measures_at
from tapeweave.operators.running import running
from tapeweave.operators.scan import CHUNK, scan
from tapeweave.operators.sequence import book_epochs
from tapeweave.sources.shared import kept

KEYS = ["session_id", "symbol"]


def next_after(ms: np.ndarray, gap: int) -> np.ndarray:
    """For each event the next one at least gap ms on; the number of events where there is none."""
    n = len(ms)
    if (np.diff(ms) >= 0).all():
        return np.searchsorted(ms, ms + gap)
    out = [n] * n
    later: list[int] = []  # events to the right that rise above all in between, the nearest last
    turned: list[int] = []  # their times with the sign turned, which rise
    for i, x in zip(range(n - 1, -1, -1), (-ms[::-1]).tolist(), strict=True):
        a = bisect_right(turned, x - gap)
        if a:
            out[i] = later[a - 1]
        while turned and turned[-1] >= x:
            turned.pop()
            later.pop()
        turned.append(x)
        later.append(i)
    return np.array(out, np.int64)


class Boundaries:
    """Which events fire a snapshot: the first, then each first one at least interval ms after the last that fired.

    Where a chunk is entered with the last time that fired, its first event late enough fires, and the
    chain of next ones from there doesn't depend on what came before. Pointer doubling gives each
    event's chain its end and length. Only events later than all before them can be the first.
    State: the last time that fired (none before the first), and how many did.
    """

    start = [None, 0]

    def __init__(self, interval: int):
        self.interval = max(1, interval)

    def summary(self, chunk: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(times, ends, counts): entered with a last time of at most times[i] - interval, and more than the one before, the chain ends at time ends[i] after counts[i] events."""
        ms = chunk["ts_ms"].to_numpy()
        n = len(ms)
        jump = np.append(next_after(ms, self.interval), n)
        end, count = np.arange(n + 1), np.ones(n + 1, np.int64)
        count[n] = 0
        while (jump < n).any():
            end = np.where(jump < n, end[jump], end)
            count, jump = count + count[jump], jump[jump]
        first = np.flatnonzero(ms > np.maximum.accumulate(np.concatenate([[np.iinfo(np.int64).min], ms[:-1]])))
        ends, counts = ms[end[first]], count[first]
        keep = np.append((ends[1:] != ends[:-1]) | (counts[1:] != counts[:-1]), True)
        return ms[first][keep], ends[keep], counts[keep]

    def after(self, summary: tuple[np.ndarray, np.ndarray, np.ndarray], state: list[int | None]) -> list[int | None]:
        times, ends, counts = summary
        last, fired = state
        i = 0 if last is None else int(np.searchsorted(times, last + self.interval))
        return state if i == len(times) else [int(ends[i]), fired + int(counts[i])]

    def rows(self, chunk: pa.Table, state: list[int | None]) -> pa.Table:
        ms = chunk["ts_ms"].to_numpy()
        fired = np.zeros(len(ms), bool)
        last, before = state
        late = np.ones(len(ms), bool) if last is None else ms >= last + self.interval
        i, jump = int(np.argmax(late)) if late.any() else len(ms), next_after(ms, self.interval)
        while i < len(ms):
            fired[i] = True
            i = int(jump[i])
        return pa.table({"seq": chunk["seq"], "ts_ms": chunk["ts_ms"], "fired": fired, "segment": np.cumsum(fired) - fired + before})


def snapshot_segments(events: DataFrame, interval: int = DEFAULT.snapshot_interval, chunk: int = CHUNK) -> DataFrame:
    """events (session_id, symbol, seq, ts_ms) with fired and segment; a segment ends with the event that fires. See Boundaries."""
    return scan(events.select(*KEYS, "seq", "ts_ms"), Boundaries(interval), "seq long, ts_ms long, fired boolean, segment long", chunk=chunk)


def microstructure_snapshots(trades: DataFrame, levels: DataFrame, snapshots: DataFrame, counted: DataFrame, interval: int = DEFAULT.snapshot_interval, final: bool = True, cfg: Config = DEFAULT, breaks: DataFrame | None = None, segments: DataFrame | None = None, seeded: DataFrame | None = None) -> DataFrame:
    """One row per fired boundary, which counts the event that fires; final adds the closing row of a session.

    counted holds what else a snapshot counts: session_id, symbol, seq and any of liquidity_added,
    liquidity_removed, large_trade_count, sweep_count, absorption_count, replenishment_count,
    anomalies; what isn't at a trade or update counts at the next one, or at the last. Each measure is
    a sum over the events of its segment; the book is the one that stands at the boundary, ready from a
    snapshot to the first of breaks (session_id, symbol, seq: the updates that don't follow) after it.
    segments (snapshot_segments of all events) and seeded (book.with_seeds) are taken where they are there already.
    """
    stream = trades.select(*KEYS, "seq", "ts_ms").unionByName(levels.select(*KEYS, "seq", "ts_ms").distinct())
    segments = snapshot_segments(stream, interval) if segments is None else segments
    flow = trades.select(*KEYS, "seq", "quantity", "side")
    sums = ["liquidity_added", "liquidity_removed", "large_trade_count", "sweep_count", "absorption_count", "replenishment_count", "anomalies"]
    counted = _at_events(counted, stream) if "anomalies" in counted.columns else counted
    extra = counted.groupBy(*KEYS, "seq").agg(*(F.sum(c).alias(c) for c in sums if c in counted.columns))
    rows = segments.join(flow, [*KEYS, "seq"], "left").join(extra, [*KEYS, "seq"], "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("quantity")).otherwise(0)).cast("bigint")
    step = signed(F.col("quantity"), F.col("side"))
    per = rows.groupBy(*KEYS, "segment").agg(
        F.max("seq").alias("seq"), F.max_by("ts_ms", "seq").alias("ts_ms"), F.bool_or("fired").alias("fired"),
        zero("quantity").alias("trade_volume"), side("BUY").alias("buy_volume"), side("SELL").alias("sell_volume"), zero(step).alias("delta"), *(zero(c).alias(c) for c in sums if c in counted.columns),
    )
    run = Window.partitionBy(*KEYS).orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("cvd", F.sum("delta").over(run))
    per = kept(per if final else per.where("fired"))  # read by the book, the epochs and the result
    book = measures_at(levels, snapshots, per, cfg.depth, seeded).drop("epoch")
    per = _ready(book_epochs(per, snapshots), snapshots, breaks)
    return per.join(book, [*KEYS, "seq"], "left").withColumns({"book_crossed": F.coalesce("crossed", F.lit(False)), "bid_depth": F.coalesce("bid_depth", F.lit(0)), "ask_depth": F.coalesce("ask_depth", F.lit(0))}).drop("crossed")


def _at_events(counted: DataFrame, stream: DataFrame) -> DataFrame:
    """counted, its anomalies (which a snapshot of the book may bring about) at the next event of stream, or at the last one."""
    odd = F.coalesce("anomalies", F.lit(0)) > 0
    marks = stream.select(*KEYS, "seq", F.col("seq").alias("_at"))
    both = counted.where(odd).unionByName(marks, allowMissingColumns=True)
    both = running(both, "_next", F.col("_at"), "last", then=(F.col("_at").isNotNull(),), back=True).where("_at is null")
    last = stream.groupBy(*KEYS).agg(F.max("seq").alias("_last"))
    moved = both.join(last, KEYS).withColumn("seq", F.coalesce("_next", "_last")).drop("_at", "_next", "_last")
    return counted.where(~odd).unionByName(moved)


def _ready(per: DataFrame, snapshots: DataFrame, breaks: DataFrame | None) -> DataFrame:
    """per (with epoch) with book_ready."""
    if breaks is None:
        return per.withColumn("book_ready", F.col("epoch") > 0).drop("epoch")
    first = book_epochs(breaks.select(*KEYS, "seq"), snapshots).groupBy(*KEYS, "epoch").agg(F.min("seq").alias("_break"))
    ready = (F.col("epoch") > 0) & (F.col("_break").isNull() | (F.col("seq") < F.col("_break")))
    return per.join(first, [*KEYS, "epoch"], "left").withColumn("book_ready", ready).drop("epoch", "_break")


def final_snapshot(rows: DataFrame) -> DataFrame:
    """The last row of each session."""
    newest = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("segment").desc()))
    return rows.withColumn("_n", newest).where("_n = 1").drop("_n")
