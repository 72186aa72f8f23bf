"""Trade clusters, sweeps, absorption and the table of analytics events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.config import DEFAULT, Config
from tapeweave.functions.ticks import clamp01, signed
from tapeweave.operators.dominance import beyond
from tapeweave.operators.flow import large_trades
from tapeweave.operators.running import running
from tapeweave.operators.scan import CHUNK, State, groups, scan
from tapeweave.operators.snapshots import next_after

KEYS = ["session_id", "symbol"]


def clusters(trades: DataFrame, gap: int = DEFAULT.cluster_gap, reach: int = DEFAULT.cluster_range * DEFAULT.tick) -> DataFrame:
    """trades with cluster: a new one starts where time or price steps further than gap or reach from the trade before."""
    rows = running(trades, "_last", F.struct("ts_ms", "price"), "last", inclusive=False)
    breaks = F.col("_last").isNull() | (F.col("ts_ms") - F.col("_last.ts_ms") > gap) | (F.abs(F.col("price") - F.col("_last.price")) > reach)
    return running(rows.withColumn("_new", breaks.cast("bigint")), "cluster", F.col("_new"), "sum").drop("_new", "_last")


def cluster_measures(clustered: DataFrame) -> DataFrame:
    """One row per cluster; closed is false for a session's last one.

    levels_crossed counts price changes, plus one. A step is judged against the side that dominated
    by volume before it; of equal volumes BUY dominates.
    """
    by = [*KEYS, "cluster"]
    w = Window.partitionBy(*by).orderBy("seq")
    running = F.sum(signed(F.col("quantity"), F.col("side"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    step = F.col("price") - F.lag("price").over(w)
    against = F.when(running >= 0, step < 0).otherwise(step > 0)
    rows = clustered.withColumns({"_changed": F.coalesce(step != 0, F.lit(False)), "_against": F.coalesce(against & (step != 0), F.lit(False))})
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("quantity")).otherwise(0))
    out = rows.groupBy(*by).agg(
        F.min_by("ts_ms", "seq").alias("start_ms"), F.max_by("ts_ms", "seq").alias("end_ms"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.sum("quantity").alias("total_volume"), side("BUY").alias("buy_volume"), side("SELL").alias("sell_volume"),
        F.count(F.lit(1)).alias("trade_count"), F.max("quantity").alias("largest_trade"), F.min_by("price", "seq").alias("first_price"), F.max_by("price", "seq").alias("last_price"),
        (F.count_if("_changed") + 1).alias("levels_crossed"), (~F.bool_or("_against")).alias("monotonic"), F.max("seq").alias("last_seq"),
    )
    buys = F.col("buy_volume") >= F.col("sell_volume")
    last = F.max("cluster").over(Window.partitionBy(*KEYS))
    return out.withColumns(
        {
            "delta": F.col("buy_volume") - F.col("sell_volume"),
            "dominant_side": F.when(buys, "BUY").otherwise("SELL"),
            "dominance": F.when(F.col("total_volume") > 0, F.greatest("buy_volume", "sell_volume") / F.col("total_volume")).otherwise(0.0),
            "closed": F.col("cluster") < last,
        }
    )


def sweeps(measures: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Closed clusters that pass the gates, with confidence and displacement."""
    took = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    gates = F.col("closed") & F.col("monotonic") & (took <= cfg.sweep_window) & (F.col("levels_crossed") >= cfg.sweep_levels) & (F.col("total_volume") >= cfg.sweep_volume) & (F.col("dominance") >= 0.5)
    quick = F.when(took == 0, 1.0).otherwise(clamp01(F.lit(float(cfg.sweep_window)) / took))
    score = 0.35 * clamp01(F.col("levels_crossed") / F.lit(float(cfg.sweep_levels))) + 0.30 * clamp01(F.col("total_volume") / F.lit(float(cfg.sweep_volume))) + 0.20 * F.col("dominance") + 0.15 * quick
    moved = F.col("last_price") - F.col("first_price")
    moved = F.greatest(F.when(F.col("dominant_side") == "BUY", moved).otherwise(-moved), F.lit(0))
    return measures.where(gates).withColumns({"duration_ms": took, "displacement": moved, "confidence": score}).where(F.col("confidence") >= cfg.confidence)


WINDOW = ["side", "open_seq", "close_seq", "open_ms", "last_ms", "reference", "trade_count", "volume", "displacement", "opposing_open"]
PART = "open_seq long, buys boolean, open_ms long, reference long, opposing long, last_seq long, last_ms long, n long, volume long, high long, low long, close_seq long"


class Absorbing:
    """Parts of the windows of one price, which a chunk of its trades has.

    A window opens, the first trade more than window ms later closes it, and the one after opens the
    next. So from where a window opens the chain of later ones is fixed, and with it the window that a
    chunk is left with. Where a chunk is entered with an open window, its first trade late enough
    closes that; only trades later than all before them can be the first.
    State: the open window's seq and time (none where none is open).
    """

    start = [None, None]

    def __init__(self, window: int):
        self.window = window

    def summary(self, chunk: pa.Table) -> tuple[State, np.ndarray, np.ndarray, np.ndarray]:
        """(state, times, seqs, opened): entered without a window it leaves state; entered with one that a trade of at most times[i], and more than the one before, closes, it leaves seqs[i] and opened[i] (seq -1: none)."""
        seq, ms = chunk["seq"].to_numpy(), chunk["ts_ms"].to_numpy()
        n, close = len(ms), next_after(ms, self.window + 1)
        left = np.full(n + 1, -1)  # the window that is left where one opens at i; -1: none
        for i in range(n - 1, -1, -1):
            left[i] = i if close[i] == n else left[close[i] + 1]
        first = np.flatnonzero(ms > np.maximum.accumulate(np.concatenate([[np.iinfo(np.int64).min], ms[:-1]])))
        then = left[first + 1]
        keep = np.append(then[1:] != then[:-1], True)
        first, then = first[keep], then[keep]
        state = [int(seq[left[0]]), int(ms[left[0]])] if left[0] >= 0 else [None, None]
        return state, ms[first], np.where(then >= 0, seq[then], -1), ms[then]

    def after(self, summary: tuple[State, np.ndarray, np.ndarray, np.ndarray], state: State) -> State:
        entered, times, seqs, opened = summary
        if state[0] is None:
            return entered
        i = int(np.searchsorted(times, state[1] + self.window, "right"))
        return state if i == len(times) else [int(seqs[i]), int(opened[i])] if seqs[i] >= 0 else [None, None]

    def rows(self, chunk: pa.Table, state: State) -> pa.Table:
        seq, ms, quantity, best, opposing = (chunk[c].to_numpy() for c in ("seq", "ts_ms", "quantity", "best", "opposing"))
        buys = np.asarray(pc.equal(chunk["side"], "BUY"))
        n, close = len(ms), next_after(ms, self.window + 1)
        begins, ends, i = [], [], 0  # a part's trades, and where the one that closes it is
        if state[0] is not None:
            late = ms > state[1] + self.window
            begins, ends = [0], [int(np.argmax(late)) if late.any() else n]
            i = ends[0] + 1
        while i < n:
            begins.append(i)
            ends.append(int(close[i]))
            i = ends[-1] + 1
        begins, ends = np.array(begins, np.int64), np.array(ends, np.int64)
        opens, shut, some = np.ones(len(begins), bool), ends < n, ends > begins
        opens[:1] = state[0] is None
        member = np.ones(n, bool)
        member[ends[shut]] = False
        sizes = ends - begins
        at = (np.cumsum(sizes) - sizes)[some]  # where a part that has trades begins among the members

        def reduced(f: np.ufunc, values: np.ndarray, empty: int) -> np.ndarray:
            out = np.full(len(begins), empty, np.int64)
            if len(at):
                out[some] = f.reduceat(values[member], at)
            return out

        least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        high, low = reduced(np.maximum, np.where(buys, best, least), least), reduced(np.minimum, np.where(buys, most, best), most)
        last = np.maximum(ends - 1, 0)
        masked = lambda values, valid: pa.array(values, mask=~valid)
        opened = np.where(opens, seq[begins], 0 if state[0] is None else state[0])
        columns = [
            pa.array(opened), masked(buys[begins], opens), masked(ms[begins], opens), masked(best[begins], opens), masked(opposing[begins], opens), masked(seq[last], some), masked(ms[last], some),
            pa.array(sizes), pa.array(reduced(np.add, quantity, 0)), masked(high, high > least), masked(low, low < most), masked(seq[np.minimum(ends, n - 1)], shut),
        ]
        return pa.table(columns, [x.split(" ")[0] for x in PART.split(", ")])


def absorption_windows(trades: DataFrame, window: int = DEFAULT.absorption_window, flush: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Closed windows of trades at one price. trades carry the book at their time: best_bid, best_ask, crossed, bid_depth, ask_depth.

    The first eligible trade opens a window; those within window ms of it count; the first later one
    closes it and belongs to none. Eligible: the book is there, not crossed, with the best price of
    the aggressor's own side. flush also returns the windows still open at the end. A price's trades
    are read in chunks (see Absorbing), each of which gives its parts of the windows.
    """
    buys = F.col("side") == "BUY"
    best, opposing = F.when(buys, F.col("best_bid")).otherwise(F.col("best_ask")), F.when(buys, F.col("ask_depth")).otherwise(F.col("bid_depth"))
    rows = trades.withColumns({"best": best, "opposing": F.coalesce(opposing, F.lit(0).cast("bigint"))}).where(~F.col("crossed") & F.col("best").isNotNull())
    by = [*KEYS, "price"]
    parts = scan(rows.select(*by, "seq", "ts_ms", "side", "quantity", "best", "opposing"), Absorbing(window), PART, by, chunk=chunk)
    of = lambda c: F.max(c).alias(c)
    out = parts.groupBy(*by, "open_seq").agg(
        of("close_seq"), of("buys"), of("open_ms"), of("reference"), F.max("opposing").alias("opposing_open"), F.max_by("last_ms", "last_seq").alias("last_ms"),
        F.sum("n").alias("trade_count"), F.sum("volume").alias("volume"), of("high"), F.min("low").alias("low"),
    )
    moved = F.greatest(F.lit(0).cast("bigint"), F.col("high") - F.col("reference"), F.col("reference") - F.col("low"))
    out = out.withColumns({"side": F.when(F.col("buys"), "BUY").otherwise("SELL"), "displacement": moved}).select(*by, *WINDOW)
    return out if flush else out.where("close_seq is not null")


ANSWER = "session_id string, symbol string, price long, open_seq long, replenished long, c_seq long, c_pos int, c_quantity long"


def _answered(window: int):
    """Sorted windows and changes of a time bin to what the bin adds to each window: the sum of its increases and its last change."""

    def of_bin(key: tuple, part: pa.Table) -> pa.Table:
        w, c = part.filter(pc.equal(part["kind"], 0)), part.filter(pc.equal(part["kind"], 1))
        seq, ms, price, quantity = (c[x].to_numpy() for x in ("seq", "ms", "c_price", "quantity"))
        rises = np.where(quantity > c["old"].to_numpy(), quantity, 0)
        buys = np.asarray(pc.equal(w["side"], "BUY"))
        reference, latest = w["reference"].to_numpy(), w["ms"].to_numpy() + window
        low = np.searchsorted(seq, w["seq"].to_numpy(), "right")
        high = np.searchsorted(seq, pc.fill_null(w["close_seq"], np.iinfo(np.int64).max).to_numpy(), "left")
        total, last = np.zeros(len(buys), np.int64), np.full(len(buys), -1)
        if (np.diff(ms) >= 0).all():
            high = np.minimum(high, np.searchsorted(ms, latest, "right"))
            for some, sign in ((buys, 1), (~buys, -1)):
                total[some], last[some] = beyond(sign * price, rises, low[some], high[some], sign * reference[some])
        else:  # times that go back: a window looks at the rows between its trades
            for i in range(len(buys)):
                at = np.arange(low[i], max(high[i], low[i]))
                at = at[(ms[at] <= latest[i]) & (price[at] > reference[i] if buys[i] else price[at] < reference[i])]
                total[i], last[i] = rises[at].sum(), at[-1] if len(at) else -1
        found = last >= 0
        pick = lambda x: pa.array(x[last[found]])
        w = w.filter(pa.array(found))
        return pa.table([*(w[k] for k in (*KEYS, "price")), w["seq"], pa.array(total[found]), pick(seq), pick(c["pos"].to_numpy()), pick(quantity)], ANSWERED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part in groups(batches, [*KEYS, "_bin"]):
            yield from of_bin(key, part).to_batches()

    return run


ANSWERED = [x.split(" ")[0] for x in ANSWER.split(", ")]


def absorption_liquidity(windows: DataFrame, changes: DataFrame, window: int = DEFAULT.absorption_window) -> DataFrame:
    """Windows with replenished (whole new quantities of increases) and closing (last new quantity) beyond the reference price.

    Beyond is above for BUY, below for SELL; changes count from the opening trade to the closing one
    and within window ms. Both sides go to bins of window ms, a window to two. A bin is sorted once, and
    its windows are answered together from sums over stretches of it (dominance.beyond), so what is
    moved and made grows with windows and changes, not with their product.
    """
    none = lambda kind: F.lit(None).cast(kind)
    w = windows.select(*KEYS, F.explode(F.sequence(_bin("open_ms", window), _bin("open_ms", window) + 1)).alias("_bin"), F.lit(0).alias("kind"), F.col("open_seq").alias("seq"), F.lit(0).alias("pos"), F.col("open_ms").alias("ms"), "price", "side", "close_seq", "reference", none("bigint").alias("c_price"), none("bigint").alias("quantity"), none("bigint").alias("old"))
    c = changes.select(*KEYS, _bin("ts_ms", window).alias("_bin"), F.lit(1).alias("kind"), "seq", F.col("pos").cast("int").alias("pos"), F.col("ts_ms").alias("ms"), none("bigint").alias("price"), none("string").alias("side"), none("bigint").alias("close_seq"), none("bigint").alias("reference"), F.col("price").alias("c_price"), "quantity", F.coalesce("old_quantity", F.lit(0)).alias("old"))
    both = w.unionByName(c).repartition(*KEYS, "_bin").sortWithinPartitions(*KEYS, "_bin", "kind", "seq", "pos")
    by = [*KEYS, "price", "open_seq"]
    found = both.mapInArrow(_answered(window), ANSWER).groupBy(*by).agg(F.sum("replenished").alias("replenished"), F.max_by("c_quantity", F.struct("c_seq", "c_pos")).alias("closing"))
    return windows.join(found, by, "left").withColumns({"replenished": F.coalesce("replenished", F.lit(0)), "closing": F.coalesce("closing", "opposing_open")})


def _bin(column: str, window: int) -> Column:
    return F.floor(F.col(column) / F.lit(window)).cast("bigint")


def absorption(windows: DataFrame, changes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Windows that pass the gates, with confidence; only those that pass the trade gates meet the level changes."""
    off = (F.col("displacement") / F.lit(cfg.tick)).cast("bigint")
    most = max(cfg.absorption_excursion, 1)
    passed = windows.where((F.col("trade_count") >= cfg.absorption_trades) & (F.col("volume") >= cfg.absorption_volume) & (off <= most))
    rows = absorption_liquidity(passed, changes, cfg.absorption_window)
    held = F.col("replenished") + F.col("volume")
    refill = F.when(held == 0, 0.0).otherwise(clamp01(F.col("replenished") / held))
    stays = F.when(F.col("opposing_open") == 0, 1.0).otherwise(clamp01(F.col("closing") / F.col("opposing_open")))
    score = 0.30 * clamp01(F.col("volume") / F.lit(float(cfg.absorption_volume))) + 0.35 * (1 - clamp01(off / F.lit(float(most)))) + 0.20 * refill + 0.15 * stays
    return rows.withColumn("confidence", score).where(F.col("confidence") >= cfg.confidence)


def connection_loss_anomalies(status_events: DataFrame) -> DataFrame:
    """An anomaly for each record of a lost connection (connected false)."""
    return status_events.where(~F.col("connected")).select(*KEYS, "seq", "ts_ms", F.lit("connection lost").alias("reason"))


EVENT = [*KEYS, "ts_ms", "kind", "side", "price", "quantity", "detail"]


def as_events(rows: DataFrame, kind: str | Column, ms: str = "ts_ms", side: str | None = "side", price: str | None = "price", quantity: str | None = "quantity", detail: tuple[str, ...] = ()) -> DataFrame:
    """Rows in the form of the events table; detail columns as one JSON document."""
    pick = lambda c, kind: F.col(c).cast(kind) if c else F.lit(None).cast(kind)
    text = F.to_json(F.struct(*detail)) if detail else F.lit("{}")
    return rows.select(*KEYS, F.col(ms).alias("ts_ms"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), pick(side, "string").alias("side"), pick(price, "bigint").alias("price"), pick(quantity, "bigint").alias("quantity"), text.alias("detail"))


def trade_delta_events(trades: DataFrame) -> DataFrame:
    return as_events(trades, "trade_delta")


def large_trade_events(trades: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return as_events(large_trades(trades, cfg), "large_trade", detail=("notional", "notional_float"))


CLUSTER_DETAIL = ("start_ms", "end_ms", "levels_crossed", "trade_count", "buy_volume", "sell_volume", "delta", "monotonic")
SWEEP_DETAIL = ("confidence", "levels_crossed", "total_volume", "duration_ms", "displacement", "trade_count", "start_ms", "end_ms", "first_price", "last_price", "buy_volume", "sell_volume", "delta")


def cluster_events(measures: DataFrame) -> DataFrame:
    return as_events(measures.where("closed"), "cluster", "end_ms", "dominant_side", "last_price", "total_volume", CLUSTER_DETAIL)


def sweep_events(found: DataFrame) -> DataFrame:
    return as_events(found, "sweep_candidate", "end_ms", "dominant_side", "last_price", "total_volume", SWEEP_DETAIL)


ABSORPTION_DETAIL = ("confidence", "trade_count", "volume", "displacement", "reference", "open_ms", "last_ms", "opposing_open", "closing", "replenished")


def absorption_events(found: DataFrame) -> DataFrame:
    return as_events(found, "absorption_candidate", "last_ms", quantity="volume", detail=ABSORPTION_DETAIL)


def liquidity_change_events(events: DataFrame) -> DataFrame:
    return as_events(events, F.concat(F.lit("liquidity_"), "kind"), quantity="magnitude")


def replenishment_events(found: DataFrame) -> DataFrame:
    return as_events(found, "liquidity_replenishment")


def anomaly_events(found: DataFrame) -> DataFrame:
    return as_events(found, "book_anomaly", side=None, price=None, quantity=None, detail=("reason",))


def sweep_closings(clustered: DataFrame, found: DataFrame) -> DataFrame:
    """session_id, symbol, seq of the trades that close the sweeps: the first of the cluster after."""
    first = clustered.groupBy(*KEYS, "cluster").agg(F.min("seq").alias("seq"))
    return found.select(*KEYS, (F.col("cluster") + 1).alias("cluster")).join(first, [*KEYS, "cluster"]).drop("cluster")


def analytics_events(*tables: DataFrame) -> DataFrame:
    """All kinds in one table."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def persistable_events(events: DataFrame) -> DataFrame:
    return events.where(~F.col("kind").isin("trade_delta", "cluster"))


def liquidity_rows(events: DataFrame) -> DataFrame:
    """The liquidity kinds of an events table, with is_replenishment."""
    names = ["added", "removed", "increased", "decreased", "replenishment"]
    kind = F.regexp_replace("kind", "^liquidity_", "")
    return events.withColumn("kind", kind).where(F.col("kind").isin(names)).select(*KEYS, "ts_ms", "kind", F.coalesce("side", F.lit("")).alias("side"), F.coalesce("price", F.lit(0)).alias("price"), F.col("quantity").alias("quantity_delta"), (F.col("kind") == "replenishment").alias("is_replenishment"))
