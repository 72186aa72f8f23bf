"""Liquidity analytics on level changes (session_id, symbol, epoch, seq, pos, side, price, quantity, old_quantity, ts_ms)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeweave.config import DEFAULT
from tapeweave.functions.ticks import classify_change, level_delta
from tapeweave.operators.scan import edges

KEYS = ["session_id", "symbol"]
LEVEL = [*KEYS, "epoch", "side", "price"]


def liquidity_events(changes: DataFrame) -> DataFrame:
    """Changes with kind (added, removed, increased, decreased) and the magnitude of the step."""
    kind = classify_change(F.col("old_quantity"), F.col("quantity"))
    step = level_delta(F.col("old_quantity"), F.col("quantity"))
    return changes.withColumns({"kind": kind, "magnitude": F.abs(step)}).where("kind <> 'unchanged'")


def liquidity_totals(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Added and removed sums per group; by default per session and epoch, where the running sums restart."""
    side = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("magnitude")).otherwise(0))
    return events.groupBy(*(by or [*KEYS, "epoch"])).agg(side("added", "increased").alias("liquidity_added"), side("removed", "decreased").alias("liquidity_removed"))


class Waiting:
    """Decreases of one level that wait for a refill, first in, first out.

    A decrease that expired stays known for late ms more: an update that is late by no more than that
    still finds it.
    """

    def __init__(self, window: int, late: int):
        self.window, self.late, self.latest = window, late, None
        self.live: deque[int] = deque()
        self.expired: deque[int] = deque()

    def fell(self, ms: int) -> None:
        self.live.append(ms)
        self.latest = ms if self.latest is None else max(ms, self.latest)

    def rose(self, ms: int) -> bool:
        """Whether this increase refills a decrease, which it uses up: the earliest at most window ms before it."""
        if self.latest is not None and ms < self.latest:
            for held in (self.expired, self.live):
                for i, t in enumerate(held):
                    if ms <= t + self.window:
                        del held[i]
                        return True
            return False
        self.latest = ms
        while self.live and ms > self.live[0] + self.window:
            self.expired.append(self.live.popleft())
        while self.expired and self.expired[0] + self.window + self.late < ms:
            self.expired.popleft()
        if not self.live:
            return False
        self.live.popleft()
        return True


def replenishment(events: DataFrame, window: int = DEFAULT.replenishment_window, late: int = DEFAULT.retention) -> DataFrame:
    """Increases that refill an earlier, unused decrease (not a removal) of the same level within window ms; see Waiting.

    Levels are dealt to tasks and sorted there, so a task walks through many levels in one pass and
    starts afresh at each level's edge; it holds the waiting decreases of one level.
    """
    columns = [*LEVEL, "seq", "pos", "ts_ms", "quantity"]

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waiting = None, Waiting(window, late)
        for batch in batches:
            hit = np.zeros(batch.num_rows, bool)
            at = edges(batch, LEVEL)
            falls, times = batch["falls"].to_pylist(), batch["ts_ms"].to_pylist()
            for a, b in zip(at[:-1], at[1:], strict=True):
                level = tuple(batch[k][a].as_py() for k in LEVEL)
                if level != last:
                    last, waiting = level, Waiting(window, late)
                for i in range(a, b):
                    if falls[i]:
                        waiting.fell(times[i])
                    else:
                        hit[i] = waiting.rose(times[i])
            yield batch.filter(pa.array(hit)).select(columns)

    rows = events.where("kind <> 'removed'").select(*columns, (F.col("kind") == "decreased").alias("falls"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("falls").schema.fields)
    return rows.repartition(*LEVEL).sortWithinPartitions(*LEVEL, "seq", "pos").mapInArrow(matched, schema)


def level_persistence(events: DataFrame) -> DataFrame:
    """Per level: when it was first and last seen, its peak and its current quantity."""
    last = F.max_by("quantity", F.struct("seq", "pos"))
    return events.groupBy(*LEVEL).agg(F.min_by("ts_ms", F.struct("seq", "pos")).alias("created_ms"), F.max_by("ts_ms", F.struct("seq", "pos")).alias("last_seen_ms"), F.max("quantity").alias("peak_quantity"), last.alias("current_quantity"))


def stale_levels(persistence: DataFrame, now_ms: int, retention: int = DEFAULT.retention) -> DataFrame:
    """Levels without quantity that weren't seen within retention before now_ms."""
    return persistence.where((F.col("last_seen_ms") < now_ms - retention) & (F.col("current_quantity") == 0))
