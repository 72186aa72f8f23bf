"""Keyed state in typed value and list states of a RocksDB store, for operators that depend on the order of rows.

A key's rows are sorted by seq and pos within a micro-batch. A row at or below the last seq of an
earlier batch is late: it comes out marked as such instead of changing the past. Lists are appended
to where they only grow, so a batch writes what is new in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeweave.operators.liquidity import Waiting
from tapeweave.operators.sequence import Sequencer

OPEN = ["cluster", "start_ms", "end_ms", "high", "low", "total_volume", "buy_volume", "trade_count", "largest_trade", "first_price", "last_price", "moves", "against", "last_seq"]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State of streams that start from now on lies in RocksDB, which writes changes alone; the session's setting for good."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class Ordered(StatefulProcessor):
    """A key's rows in order; step gives rows of the columns in names (and sees none that are late)."""

    def __init__(self, keys: list[str], names: list[str]):
        self.keys, self.names = keys, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None: ...

    def step(self, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def expired(self, ms: int) -> pd.DataFrame | None: ...

    def _out(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        got = rows.reindex(columns=[*self.names, "late", "late_seq"])
        for name, value in zip(self.keys, key, strict=True):
            got[name] = value
        return got[[*self.keys, *self.names, "late", "late_seq"]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows))
        pdf = pdf.sort_values([c for c in ("seq", "pos") if c in pdf], kind="stable", ignore_index=True)
        held = self.last.get() if self.last.exists() else None
        late = pdf["seq"] <= (held[0] if held else -1)
        if late.any():
            yield self._out(key, pd.DataFrame({"late": True, "late_seq": pdf["seq"][late]}))
        if not late.all():
            fresh = pdf[~late].reset_index(drop=True)
            self.last.update((int(fresh["seq"].iloc[-1]),))
            made = self.step(fresh)
            if len(made):
                yield self._out(key, made.assign(late=False, late_seq=None))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        made = self.expired(expiredTimerInfo.getExpiryTimeInMs())
        if made is not None and len(made):
            yield self._out(key, made.assign(late=False, late_seq=None))

    def close(self) -> None: ...


def ordered(rows: DataFrame, keys: list[str], machine: type[Ordered], schema: str, *args, timed: str | None = None, ts: str | None = None) -> DataFrame:
    """machine over rows by key: the keys, columns of schema, late and late_seq. timed: the event time column of rows, for timers; ts: that of the result."""
    use_rocksdb(rows.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    out = f"{', '.join(f'{k} {types[k]}' for k in keys)}, {schema}, late boolean, late_seq long"
    return rows.groupBy(*keys).transformWithStateInPandas(machine(keys, names, *args), out, "append", "EventTime" if timed else "None", eventTimeColumnName=ts or "")


def on_time(rows: DataFrame) -> DataFrame:
    return rows.where("not late").drop("late", "late_seq")


class Epochs(Ordered):
    """Messages of a session with epoch: how many snapshots came before or are it."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "epochs long")

    def step(self, rows: pd.DataFrame) -> pd.DataFrame:
        before = self.count.get()[0] if self.count.exists() else 0
        epoch = before + (rows["stream_type"] == "snapshot").cumsum()
        if epoch.iloc[-1] > before:
            self.count.update((int(epoch.iloc[-1]),))
        return rows.assign(epoch=epoch)


class Refills(Ordered):
    """A level's epoch and quantity, and its decreases that wait for a refill.

    A level that a snapshot doesn't have starts afresh with its next update, whose epoch is another. A
    timer removes the decreases that the window has left, and a level without quantity with them.
    """

    def __init__(self, keys: list[str], names: list[str], window: int, timers: bool):
        super().__init__(keys, names)
        self.window, self.timers = window, timers

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "epoch long, quantity long")
        self.falls = handle.getListState("falls", "ms long")

    def step(self, rows: pd.DataFrame) -> pd.DataFrame:
        epoch, quantity = self.level.get() if self.level.exists() else (-1, 0)
        was = [x[0] for x in self.falls.get()]
        waiting, hits = Waiting(self.window, 0), []
        waiting.live.extend(was)
        for i, (at, new, ms, seed) in enumerate(zip(rows["epoch"].tolist(), rows["quantity"].tolist(), rows["ts_ms"].tolist(), rows["seed"].tolist(), strict=True)):
            if at != epoch:
                epoch, quantity, waiting = at, 0, Waiting(self.window, 0)
            if not seed:
                if 0 < new < quantity:
                    waiting.fell(ms)
                elif new > quantity and waiting.rose(ms):
                    hits.append(i)
            quantity = new
        self.level.update((int(epoch), int(quantity)))
        now = [int(x) for x in waiting.live]
        if now[: len(was)] == was:
            if now[len(was) :]:
                self.falls.appendList([(x,) for x in now[len(was) :]])
        elif now:
            self.falls.put([(x,) for x in now])
        else:
            self.falls.clear()
        if self.timers and now[len(was) :]:
            self.handle.registerTimer(now[-1] + self.window + 1)
        return rows.loc[hits, self.names]

    def expired(self, ms: int) -> None:
        left = [x for x in self.falls.get() if x[0] + self.window >= ms]
        if left:
            self.falls.put(left)
            return
        self.falls.clear()
        if self.level.exists() and self.level.get()[1] == 0:
            self.level.clear()


class Measures(Ordered):
    """The measures of a key's open cluster; step(open, rows) gives those of the next and the closed ones."""

    def __init__(self, keys: list[str], names: list[str], measure: Callable):
        super().__init__(keys, names)
        self.measure = measure

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.cluster = handle.getValueState("cluster", ", ".join(f"{c} long" for c in OPEN))

    def step(self, rows: pd.DataFrame) -> pd.DataFrame:
        held = dict(zip(OPEN, self.cluster.get(), strict=True)) if self.cluster.exists() else None
        held, made = self.measure(held, rows)
        self.cluster.update(tuple(held[c] for c in OPEN))
        return made


class Statuses(Ordered):
    """Status of depth updates once it is known. The buffer is read at a snapshot, and else only appended to."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.applied = handle.getValueState("applied", "id long")
        self.buffer = handle.getListState("buffer", "seq long, first long, final long, previous long")

    def step(self, rows: pd.DataFrame) -> pd.DataFrame:
        shots = rows["snapshot_id"].notna().any()
        machine = Sequencer(self.applied.get()[0] if self.applied.exists() else None, [tuple(x) for x in self.buffer.get()] if shots else ())
        number = lambda x: None if pd.isna(x) else int(x)
        made = []
        for seq, shot, *ids in zip(*(rows[c].tolist() for c in ("seq", "snapshot_id", "first_update_id", "final_update_id", "previous_final_update_id")), strict=True):
            made += machine.snapshot(int(shot)) if not pd.isna(shot) else machine.depth(int(seq), *map(number, ids))
        if machine.last is None:
            self.applied.clear()
        else:
            self.applied.update((machine.last,))
        if shots and machine.buffer:
            self.buffer.put(machine.buffer)
        elif shots:
            self.buffer.clear()
        elif machine.buffer:
            self.buffer.appendList(machine.buffer)
        return pd.DataFrame(made, columns=["seq", "status"])


class Accepted(Ordered):
    """The last accepted trade ids, ascending; the list is cut when it has grown by window."""

    def __init__(self, keys: list[str], names: list[str], window: int):
        super().__init__(keys, names)
        self.window = window

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getListState("ids", "id long")

    def step(self, rows: pd.DataFrame) -> pd.DataFrame:
        ids = [x[0] for x in self.ids.get()]
        place, held, out = {x: i for i, x in enumerate(ids)}, len(ids), []
        top = ids[-1] if ids else None
        for number in rows["trade_id"].tolist():
            if top is None or number > top:
                top, place[number] = number, len(ids)
                ids.append(number)
                out.append("processed")
            else:
                at = place.get(number)
                out.append("duplicate" if at is not None and len(ids) - at <= self.window else "stale")
        if len(ids) > 2 * self.window:
            self.ids.put([(int(x),) for x in ids[-self.window :]])
        elif len(ids) > held:
            self.ids.appendList([(int(x),) for x in ids[held:]])
        return rows.assign(status=out)[self.names]


class Cells(Ordered):
    """The newest heat cell of one price; each batch that touches it gives its new values, and retention its removal."""

    def __init__(self, keys: list[str], names: list[str], retention: int | None):
        super().__init__(keys, names)
        self.retention = retention
        self.counts = [n for n in names if n not in ("version", "change", "bucket")]

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.cell = handle.getValueState("cell", ", ".join(f"{c} long" for c in ("version", "bucket", *self.counts)))

    def step(self, rows: pd.DataFrame) -> pd.DataFrame:
        version, bucket, *old = self.cell.get() if self.cell.exists() else (0, None, *[0] * len(self.counts))
        newest = int(rows["bucket"].max()) if bucket is None else max(bucket, int(rows["bucket"].max()))
        added = rows.loc[rows["bucket"] == newest, self.counts].sum()
        if newest == bucket and not added.any():
            return rows.iloc[:0].reindex(columns=self.names)
        values = [int(a) + (o if newest == bucket else 0) for a, o in zip(added, old, strict=True)]
        self.cell.update((version + 1, newest, *values))
        if self.retention is not None and newest != bucket:
            self.handle.registerTimer(newest + self.retention)
        return pd.DataFrame([[version + 1, "new" if bucket is None else "changed", newest, *values]], columns=["version", "change", "bucket", *self.counts])

    def expired(self, ms: int) -> pd.DataFrame | None:
        if not self.cell.exists() or self.cell.get()[1] + self.retention > ms:
            return None
        version, bucket, *values = self.cell.get()
        self.cell.clear()
        return pd.DataFrame([[version + 1, "removed", bucket, *values]], columns=["version", "change", "bucket", *self.counts])
