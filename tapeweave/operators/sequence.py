"""Order-dependent validation: duplicate trades, sequence continuity of depth updates, book epochs."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.config import DEFAULT
from tapeweave.operators.running import running
from tapeweave.operators.scan import CHUNK, scan

KEYS = ["session_id", "symbol"]


def classify_trades(trades: DataFrame, window: int = DEFAULT.dedup_window) -> DataFrame:
    """trades with status: processed, duplicate (id among the last window accepted ones) or stale (below the last accepted id).

    A trade is accepted if its id exceeds every earlier one. A repeat finds its accepted original by
    a join on the id and counts the acceptances in between.
    """
    rows = running(trades, "_top", F.col("trade_id"), "max", inclusive=False)
    rows = rows.withColumn("accepted", F.col("_top").isNull() | (F.col("trade_id") > F.col("_top"))).drop("_top")
    rows = running(rows, "place", F.col("accepted").cast("bigint"), "sum")
    first = rows.where("accepted").select(*KEYS, "trade_id", F.col("place").alias("original"))
    status = F.when(F.col("accepted"), "processed").when(F.col("original").isNotNull() & (F.col("place") - F.col("original") < window), "duplicate").otherwise("stale")
    return rows.join(first, [*KEYS, "trade_id"], "left").withColumn("status", status).drop("accepted", "place", "original")


def dedup_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: what a retried batch has written twice collapses."""
    return df.dropDuplicates(keys)


def book_epochs(levels: DataFrame, snapshots: DataFrame) -> DataFrame:
    """levels with epoch: how many snapshots of the session came before."""
    marks = snapshots.select(*KEYS, "seq").distinct().withColumn("_snapshot", F.lit(1))
    both = levels.withColumn("_snapshot", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    return running(both, "epoch", F.col("_snapshot").cast("bigint"), "sum", then=(F.col("_snapshot").desc(),)).where("_snapshot = 0").drop("_snapshot")


class Sequencer:
    """Continuity of one book's depth updates: buffer, bridge over a snapshot, then an unbroken chain.

    Each update gets one status: applied, bridged (the first one applied over a snapshot), stale,
    mismatch (its predecessor isn't the last one applied), dropped (buffered, older than the
    snapshot), no_bridge (buffered when a snapshot fitted none), broken (buffered behind a break) or
    buffered (still waiting at the end).
    """

    def __init__(self, last: int | None = None, buffer: Iterable[tuple] = ()):
        self.last = last  # the last applied update's final id; None while buffering
        self.buffer = list(buffer)  # (seq, first id, final id, previous final id)

    def depth(self, seq: int, first: int, final: int, previous: int | None) -> list[tuple[int, str]]:
        if self.last is None:
            self.buffer.append((seq, first, final, previous))
            return []
        if previous != self.last:
            self.last = None
            return [(seq, "mismatch")]
        if final <= self.last:
            return [(seq, "stale")]
        self.last = final
        return [(seq, "applied")]

    def snapshot(self, update_id: int) -> list[tuple[int, str]]:
        self.last = None
        held, self.buffer = self.buffer, []
        out = []
        while held and held[0][2] < update_id:
            out.append((held.pop(0)[0], "dropped"))
        bridge = next((i for i, (_, first, final, _) in enumerate(held) if first <= update_id <= final), None)
        if bridge is None:
            return out + [(x[0], "no_bridge") for x in held]
        out += [(x[0], "dropped") for x in held[:bridge]]
        for i, (seq, _, final, previous) in enumerate(held[bridge:]):
            if i > 1 and previous != self.last:
                return out + [(x[0], "broken") for x in held[bridge + i :]]
            self.last = final
            out.append((seq, "applied" if i else "bridged"))
        return out

    def rest(self) -> list[tuple[int, str]]:
        return [(x[0], "buffered") for x in self.buffer]


class NextSnapshot:
    """Read backwards: for each update the id and seq of the snapshot after it, and whether one between the two bridges it.

    A chunk without a snapshot tells which ids its updates span, as a few intervals. State: the next
    snapshot's id and seq, and whether an update so far bridges it.
    """

    start = [None, None, 0]

    def summary(self, chunk: pa.Table) -> tuple:
        """(what a later snapshot must lie in, or None where the chunk has one; the state at its first event in that case)."""
        shots = np.flatnonzero(~np.asarray(chunk["snapshot_id"].is_null()))
        if not len(shots):
            return _merged(chunk), None
        rows = chunk.slice(int(shots[-1]) + 1)  # backwards, the last one is the first in time
        at, seq = chunk["snapshot_id"][int(shots[-1])].as_py(), chunk["seq"][int(shots[-1])].as_py()
        return None, [at, seq, int(_spans(_merged(rows), at))]

    def after(self, summary: tuple, state: list[int | None]) -> list[int | None]:
        spans, known = summary
        return known or [state[0], state[1], int(bool(state[2]) or state[0] is not None and _spans(spans, state[0]))]

    def rows(self, chunk: pa.Table, state: list[int | None]) -> pa.Table:
        out = []
        at, seq, bridged = state
        columns = [chunk[c].to_pylist() for c in ("seq", "snapshot_id", "first_update_id", "final_update_id")]
        for s, snapshot, first, final in zip(*columns, strict=True):
            out.append((at, seq, bool(bridged)))
            if snapshot is not None:
                at, seq, bridged = snapshot, s, False
            elif at is not None and first <= at <= final:
                bridged = True
        ids, seqs, ahead = zip(*out, strict=True)
        return chunk.select(UPDATE).append_column("next_id", pa.array(ids, pa.int64())).append_column("next_seq", pa.array(seqs, pa.int64())).append_column("bridge_ahead", pa.array(ahead, pa.bool_()))


UPDATE = ["seq", "snapshot_id", "first_update_id", "final_update_id", "previous_final_update_id"]


def _merged(chunk: pa.Table) -> list[tuple[int, int]]:
    """The ids that a chunk's updates span, as disjoint intervals."""
    pairs = sorted(zip(chunk["first_update_id"].to_pylist(), chunk["final_update_id"].to_pylist(), strict=True))
    out: list[tuple[int, int]] = []
    for a, b in pairs:
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif a <= b:
            out.append((a, b))
    return out


def _spans(intervals: list[tuple[int, int]], x: int) -> bool:
    i = bisect_right(intervals, (x, INFINITE)) - 1
    return i >= 0 and intervals[i][0] <= x <= intervals[i][1]


INFINITE = 1 << 63
LIVE, OLDER, OPEN, BRIDGED, CHAINED, BROKEN = range(6)
STATUS = ["applied", "stale", "mismatch", "dropped", "no_bridge", "bridged", "broken", "buffered"]


class Continuity:
    """Sequencer without its buffer, as each update knows the snapshot after it (NextSnapshot).

    States: LIVE (in step at id x), OLDER (buffering, all so far end before the snapshot), OPEN (buffering, one
    didn't, none bridged), BRIDGED (the update before bridged; the next one isn't checked), CHAINED
    (in step with the buffer at x), BROKEN (x was the last one applied). What a chunk makes of an unknown
    x depends on two comparisons at most: with its first update, and with the first one after its
    first snapshot. So it is entered from every kind with x equal to either and to neither.
    """

    start = [OLDER, None]

    @staticmethod
    def step(kind: int, x: int | None, snapshot: int | None, first: int, final: int, previous: int | None, at: int | None, ahead: bool) -> tuple[str | None, int, int | None]:
        """(status, kind, x) after an event; x is a number, or stands for an unknown one that equals none."""
        if snapshot is not None:
            return (None, LIVE, x) if kind in (BRIDGED, CHAINED, BROKEN) else (None, OLDER, None)
        if kind == LIVE:
            if previous != x:
                return "mismatch", OLDER, None
            return ("stale", LIVE, x) if final <= x else ("applied", LIVE, final)
        if at is None:
            return "buffered", kind, x
        if kind in (OLDER, OPEN):
            if first <= at <= final:
                return "bridged", BRIDGED, final
            if kind == OLDER and final < at:
                return "dropped", OLDER, None
            return ("dropped" if ahead else "no_bridge"), OPEN, None
        if kind == BROKEN or kind == CHAINED and previous != x:
            return "broken", BROKEN, x
        return "applied", CHAINED, final

    @staticmethod
    def _events(chunk: pa.Table) -> Iterator[tuple]:
        return zip(*(chunk[c].to_pylist() for c in ("snapshot_id", "first_update_id", "final_update_id", "previous_final_update_id", "next_id", "bridge_ahead")), strict=True)

    def summary(self, chunk: pa.Table) -> dict:
        """(kind, x) to the state at the end, for x each of the two ids and UNKNOWN."""
        first, after, shot = None, None, False
        for snapshot, previous in zip(chunk["snapshot_id"].to_pylist(), chunk["previous_final_update_id"].to_pylist(), strict=True):
            if snapshot is not None:
                shot = True
                continue
            first = (previous,) if first is None else first
            if shot:
                after = (previous,)
                break
        ids = {x[0] for x in (first, after) if x is not None and x[0] is not None}
        now = {e: e for e in [(OLDER, None), (OPEN, None), *((k, x) for k in (LIVE, BRIDGED, CHAINED, BROKEN) for x in (*ids, UNKNOWN))]}
        for event in self._events(chunk):
            moved = {s: self.step(*s, *event)[1:] for s in set(now.values())}
            now = {e: moved[s] for e, s in now.items()}
        return now

    def after(self, summary: dict, state: list[int | None]) -> list[int | None]:
        kind, x = state
        entry = (kind, x) if (kind, x) in summary else (kind, UNKNOWN)
        kind, y = summary[entry]
        return [kind, x if y == UNKNOWN else y]

    def rows(self, chunk: pa.Table, state: list[int | None]) -> pa.Table:
        kind, x = state
        status, settled = [], []
        for seq, at, event in zip(chunk["seq"].to_pylist(), chunk["next_seq"].to_pylist(), self._events(chunk), strict=True):
            live = kind == LIVE
            said, kind, x = self.step(kind, x, *event)
            status.append(said)
            settled.append(seq if live else at)
        return pa.table({"seq": chunk["seq"], "status": pa.array(status, pa.string()), "at_seq": pa.array(settled, pa.int64())})


UNKNOWN = "unknown"


def headers(levels: DataFrame) -> DataFrame:
    """One row per depth update: its ids, without its levels."""
    return levels.groupBy(*KEYS, "seq").agg(*(F.max(c).alias(c) for c in ("first_update_id", "final_update_id", "previous_final_update_id")))


def sequence_depth(updates: DataFrame, snapshots: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """session_id, symbol, seq, status of each depth update, and at_seq, the event that settled it (a snapshot for buffered ones); see Sequencer.

    Two scans: backwards for the snapshot that each update waits for, then forwards for the state of the book.
    """
    marks = snapshots.select(*KEYS, "seq", F.col("last_update_id").alias("snapshot_id"))
    both = updates.unionByName(marks, allowMissingColumns=True).select(*KEYS, *UPDATE)
    waiting = scan(both, NextSnapshot(), "seq long, snapshot_id long, first_update_id long, final_update_id long, previous_final_update_id long, next_id long, next_seq long, bridge_ahead boolean", chunk=chunk, back=True)
    return scan(waiting, Continuity(), "seq long, status string, at_seq long", chunk=chunk).where("status is not null")


def ready_chain_breaks(updates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """First continuity break of each epoch that starts in step: session_id, symbol, epoch, seq, expected, previous.

    Stale updates (final id at most the previous one) are passed over, as in a ready book.
    """
    rows = book_epochs(updates, snapshots).where("epoch > 0")
    w = Window.partitionBy(*KEYS, "epoch").orderBy("seq")
    previous = F.col("previous_final_update_id")
    live = F.when(F.col("final_update_id") > previous, F.col("final_update_id"))
    rows = rows.withColumn("expected", F.last(live, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    broken = rows.where(F.col("expected").isNotNull() & (F.col("expected") != previous) & (F.col("final_update_id") > previous))
    first = F.min_by(F.struct("seq", "expected", previous.alias("previous")), F.col("seq")).alias("b")
    return broken.groupBy(*KEYS, "epoch").agg(first).select(*KEYS, "epoch", "b.*")


def apply_filter(levels: DataFrame, statuses: DataFrame, kept: tuple[str, ...] = ("applied", "bridged")) -> DataFrame:
    """The level rows of the updates that the book took."""
    return levels.join(statuses.where(F.col("status").isin(*kept)), [*KEYS, "seq"], "left_semi")


def sequence_report(statuses: DataFrame) -> DataFrame:
    """Per session: applied, ignored and broken updates, and resynchronisations."""
    is_ = lambda *names: F.count_if(F.col("status").isin(*names))
    return statuses.groupBy(*KEYS).agg(is_("applied", "bridged").alias("applied"), is_("stale", "dropped").alias("ignored"), is_("mismatch", "broken", "no_bridge").alias("errors"), is_("bridged").alias("resyncs"), is_("buffered").alias("waiting"))
