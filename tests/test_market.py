"""Cases with values worked out by hand."""

import random
import re
from bisect import bisect_left

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from tapeweave.config import DEFAULT, SCALE, Config
from tapeweave.functions import ticks as fn
from tapeweave.operators import audit, book, flow, heatmap, liquidity, sequence, signals, snapshots
from tapeweave.operators.dominance import beyond
from tapeweave.operators.running import running
from tapeweave.sources import tables, wire
from tests.market import levels, seed_book, ticks, trades


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_cvd_and_profile(spark):
    t = trades(spark, [(1, 68000.1, 2, "BUY", 1000), (2, 68000.0, 1, "SELL", 1001), (3, 68000.1, 4, "BUY", 1002)])
    assert [r.cvd for r in flow.cvd(t).orderBy("seq").collect()] == [2 * SCALE, SCALE, 5 * SCALE]
    p = trades(spark, [(i, *x, 1) for i, x in enumerate([(68000.1, 1, "BUY"), (68000.1, 2, "SELL"), (68000.1, 5, "BUY"), (68000.0, 3, "BUY"), (68000.0, 4, "SELL")])])
    got = rows(flow.volume_at_price(p), "price", "total_volume", "buy_volume", "sell_volume", "delta", "large_trade_count")
    assert got == [(ticks(68000.0), 7 * SCALE, 3 * SCALE, 4 * SCALE, -SCALE, 0), (ticks(68000.1), 8 * SCALE, 6 * SCALE, 2 * SCALE, 4 * SCALE, 1)]


def test_book_at_points_is_folded_in_chunks_to_what_stands(spark):
    rng, rows, shots = random.Random(4), [], []
    for seq in range(1, 160):
        if seq % 37 == 0:
            shots += [(seq, i, side, 100 + (i + 1) * (1 if side == "ASK" else -1), rng.randrange(0, 3), seq) for side in ("BID", "ASK") for i in range(4)]
        elif seq % 3:
            rows += [(seq, pos, rng.choice(["BID", "ASK"]), 100 + rng.randrange(-6, 7), rng.randrange(0, 4), seq) for pos in range(2)]
    updates, ladders = levels(spark, rows), levels(spark, shots)
    points = spark.createDataFrame([("S", "X", seq) for seq in range(0, 170)], "session_id string, symbol string, seq long")
    standing = book.book_asof(updates, ladders, points)
    want = book.best_bid_ask(standing).join(book.depth_volume(standing, 3), ["session_id", "symbol", "epoch", "seq"])
    ordered = lambda df: sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)
    for chunk in (7, 1000):
        assert ordered(book.summary_at(updates, ladders, points, 3, chunk)) == ordered(want)
        assert ordered(book.top_at(updates, ladders, points, 2, chunk)) == ordered(book.top_n(standing, 2))


def test_trades_meet_the_book_in_chunks_as_in_joins(spark):
    rng, rows, shots, tape = random.Random(7), [], [], []
    for seq in range(1, 240):
        if seq % 37 == 0 or 150 < seq < 160:  # snapshots without updates between them
            shots += [(seq, i, side, 100 + (i + 1) * (1 if side == "ASK" else -1), 0 if seq % 74 == 0 else rng.randrange(0, 3), seq) for side in ("BID", "ASK") for i in range(4)]
        elif seq > 20 and seq % 5 == 0 and not 100 < seq < 130:
            rows += [(seq, pos, rng.choice(["BID", "ASK"]), 100 + rng.randrange(-6, 7), rng.randrange(0, 4), seq) for pos in range(2)]
        else:
            tape.append((seq, seq, 100 + rng.randrange(3), 1, rng.choice(["BUY", "SELL"]), seq))
    updates, ladders, t = levels(spark, rows), levels(spark, shots), trades(spark, tape)
    line, depth = book.top_of_book_timeline(updates, ladders), book.summary_at(updates, ladders, t, 3).select("session_id", "symbol", "seq", "bid_depth", "ask_depth")
    names = ["session_id", "symbol", "seq", "price", "quantity", "side", "ts_ms", "best_bid", "best_ask", "bid_depth", "ask_depth"]
    ordered = lambda df: sorted((tuple(r) for r in df.select(*names, F.coalesce("crossed", F.lit(False))).collect()), key=repr)
    want = ordered(book.trade_with_book(t, line).join(depth, ["session_id", "symbol", "seq"], "left"))
    assert len({r[2] for r in want}) == len(tape)
    for chunk in (7, 50, 1000):
        assert ordered(book.traded_book(t, book.with_seeds(updates, ladders).localCheckpoint(), ladders, 3, chunk)) == want


def folded_windows(rows, window):
    """rows (seq, ms, side, quantity, best, opposing) of one price, one after the other."""
    out, held = [], None
    for seq, ms, side, quantity, best, opposing in rows:
        moved = 0 if held is None else (best - held["reference"]) * (1 if side == "BUY" else -1)
        if held is None:
            held = {"side": side, "open_seq": seq, "close_seq": None, "open_ms": ms, "last_ms": ms, "reference": best, "trade_count": 1, "volume": quantity, "displacement": 0, "opposing_open": opposing}
        elif ms - held["open_ms"] > window:
            out.append({**held, "close_seq": seq})
            held = None
        else:
            held |= {"last_ms": ms, "trade_count": held["trade_count"] + 1, "volume": held["volume"] + quantity, "displacement": max(held["displacement"], moved)}
    return [tuple(x.values()) for x in [*out, *([held] if held else [])]]


@pytest.mark.parametrize("back", [0, 18])
def test_absorption_windows_pass_from_chunk_to_chunk(spark, back):
    rng, ms, made = random.Random(back), 0, {1: [], 2: []}
    for seq in range(1, 300):
        ms += rng.choice([1, 2, 3, 40]) - (rng.randrange(back) if back else 0)
        made[rng.choice([1, 1, 2])].append((seq, ms, rng.choice(["BUY", "SELL"]), rng.randrange(1, 5), 100 + rng.randrange(-5, 6), rng.randrange(9)))
    both = [("S", "X", p, *r[:5], r[4], False, r[5], r[5]) for p, rows in made.items() for r in rows]
    tape = spark.createDataFrame(both, "session_id string, symbol string, price long, seq long, ts_ms long, side string, quantity long, best_bid long, best_ask long, crossed boolean, bid_depth long, ask_depth long")
    want = sorted(((p, *x) for p, rows in made.items() for x in folded_windows(rows, 20)), key=repr)
    assert sum(x[3] is not None for x in want) > 9
    for chunk in (3, 25, 1000):
        for flush in (True, False):
            got = signals.absorption_windows(tape, 20, flush, chunk).select("price", *signals.WINDOW).collect()
            assert sorted(map(tuple, got), key=repr) == [x for x in want if flush or x[3] is not None]


def test_book_measures(spark):
    at = spark.createDataFrame([("S", "X", 5)], "session_id string, symbol string, seq long")
    r = book.book_measures(book.book_asof(levels(spark, []), seed_book(spark), at)).first()
    assert r.imbalance == pytest.approx(1 / 3)
    assert float(r.microprice_num) / float(r.microprice_den) / SCALE == pytest.approx(68000.0667, abs=1e-3)
    assert (r.spread, r.crossed) == (ticks(0.1), False)


def test_crossed_book_has_no_measures(spark):
    ladder = levels(spark, [(0, 0, "BID", 68000.0, 1, 0), (0, 1, "ASK", 67999.9, 1, 0)])
    at = spark.createDataFrame([("S", "X", 5)], "session_id string, symbol string, seq long")
    r = book.book_measures(book.book_asof(levels(spark, []), ladder, at)).first()
    assert r.crossed and r.spread is None and r.imbalance is None and r.microprice_num is None
    line = book.top_of_book_timeline(levels(spark, [(6, 0, "BID", 67990.0, 1, 0), (7, 0, "BID", 68000.0, 0, 0)]), ladder)
    spoilt = levels(spark, [(6, 0, "BID", 67990.0, -1, 0), (7, 0, "BID", 68000.0, -1, 0), (7, 1, "ASK", 1.0, -2, 0)])
    got = rows(book.invariants(line, spoilt, levels(spark, [(9, 0, "ASK", 5.0, 0, 0)])), "seq", "bad_levels", "best_bid")
    assert got == [(6, 1, ticks(68000.0)), (7, 2, ticks(67990.0)), (9, 1, None)]
    assert rows(book.invariants(line, levels(spark, []), ladder), "seq") == [(6,)]


def test_crossing_is_reported_once(spark):
    updates = levels(spark, [(1, 0, "BID", 68000.2, 1, 10), (2, 0, "BID", 68000.3, 1, 11), (3, 0, "BID", 68000.2, 0, 12), (4, 0, "BID", 68000.3, 0, 13), (5, 0, "BID", 68000.2, 2, 14)])
    line = book.top_of_book_timeline(updates, seed_book(spark), chunk=2)
    assert [r.crossed for r in line.orderBy("seq").collect()] == [True, True, True, False, True]
    quiet = spark.createDataFrame([], "session_id string, symbol string, seq long, fired boolean")
    assert rows(book.crossed_anomalies(line, seed_book(spark), quiet), "seq", "reason") == [(1, "crossed book after update"), (5, "crossed book after update")]
    ends = spark.createDataFrame([("S", "X", 1, True)], quiet.schema)  # a segment that ends with update 1 forgets that the book is crossed
    assert rows(book.crossed_anomalies(line, seed_book(spark), ends), "seq") == [(1,), (2,), (5,)]


def test_a_crossed_snapshot_is_an_anomaly_once(spark):
    ladder = levels(spark, [(0, 0, "BID", 68000.2, 1, 0), (0, 1, "ASK", 68000.1, 1, 0)])
    line = book.top_of_book_timeline(levels(spark, [(1, 0, "BID", 67999.0, 1, 1), (2, 0, "BID", 68000.2, 0, 2), (3, 0, "BID", 68000.3, 1, 3)]), ladder)
    quiet = spark.createDataFrame([], "session_id string, symbol string, seq long, fired boolean")
    assert rows(book.crossed_anomalies(line, ladder, quiet), "seq", "reason") == [(0, "crossed book after snapshot"), (3, "crossed book after update")]


def test_replay_ends_with_the_sequenced_book(spark):
    ids = {1: (100, 105, 99), 2: (106, 110, 105), 4: (111, 115, 110), 5: (200, 210, 999)}
    updates = levels(spark, [(1, 0, "BID", 68000.0, 7, 1), (2, 0, "BID", 67999.9, 2, 2), (4, 0, "ASK", 68000.3, 4, 4), (5, 0, "BID", 68000.2, 9, 5)])
    headers = spark.createDataFrame([("S", "X", seq, *x) for seq, x in ids.items()], "session_id string, symbol string, seq long, first_update_id long, final_update_id long, previous_final_update_id long")
    shots = spark.createDataFrame([("S", "X", 3, 103)], "session_id string, symbol string, seq long, last_update_id long")
    ladder = levels(spark, [(3, 0, "BID", 68000.0, 1, 3), (3, 1, "ASK", 68000.1, 1, 3)])
    statuses = sequence.sequence_depth(headers, shots)
    assert rows(statuses, "seq", "status", "at_seq") == [(1, "bridged", 3), (2, "applied", 3), (4, "applied", 4), (5, "mismatch", 5)]
    found = book.sequenced_book(updates, statuses, ladder)  # updates 1 and 2 come before the snapshot and apply to it; 5 doesn't
    assert rows(found, "price", "quantity") == [(ticks(67999.9), 2 * SCALE), (ticks(68000.0), 7 * SCALE), (ticks(68000.1), SCALE), (ticks(68000.3), 4 * SCALE)]
    done = spark.createDataFrame([("S", "X", "processed"), ("S", "X", "stale")], "session_id string, symbol string, status string")
    r = audit.replay_outcome(statuses, done, headers, shots, found).first()
    assert (r.events_total, r.depth_events, r.events_applied, r.sequence_errors, r.final_update_id, r.trades_skipped) == (7, 4, 3, 1, 115, 1)
    assert (r.best_bid, r.best_ask, r.bid_levels, r.ask_levels, r.spread) == (ticks(68000.0), ticks(68000.1), 2, 2, ticks(0.1))


def test_running_values_cross_chunks(spark):
    t = trades(spark, [(i, i, 68000.0, 1 + i % 3, "BUY", i) for i in range(60)])
    for chunk in (1, 7, 1000):
        got = running(t, "s", F.col("quantity"), "sum", chunk=chunk)
        got = running(got, "m", F.when(F.col("seq") % 11 == 0, F.col("seq")), "last", inclusive=False, chunk=chunk)
        out = rows(running(got, "x", F.col("quantity"), "max", inclusive=False, chunk=chunk), "seq", "s", "m", "x")
        for seq, total, last, top in out:
            assert total == sum(1 + i % 3 for i in range(seq + 1)) * SCALE
            assert last == (max(i for i in range(0, seq, 11)) if seq else None) and top == (max(1 + i % 3 for i in range(seq)) * SCALE if seq else None)


def test_liquidity_and_refill(spark):
    bids = levels(spark, [(1, 0, "BID", 68000.0, 8, 1900), (2, 0, "BID", 68000.0, 2, 1901)])
    ev = liquidity.liquidity_events(book.level_changes(bids, seed_book(spark)))
    assert rows(liquidity.liquidity_totals(ev), "liquidity_added", "liquidity_removed") == [(0, 8 * SCALE)]
    for gap, found in ((100, 1), (1000, 0)):
        asks = levels(spark, [(1, 0, "ASK", 68000.1, 2, 3000), (2, 0, "ASK", 68000.1, 9, 3000 + gap)])
        assert liquidity.replenishment(liquidity.liquidity_events(book.level_changes(asks, seed_book(spark)))).count() == found


def test_removal_of_an_absent_level_is_a_change(spark):
    got = book.level_changes(levels(spark, [(1, 0, "BID", 67000.0, 0, 5), (2, 0, "BID", 68000.0, 10, 6)]), seed_book(spark))
    assert rows(got, "price", "old_quantity", "quantity") == [(ticks(67000.0), None, 0)]


def plain_refills(steps, window):
    """steps (kind, ms) of one level: an increase uses up the earliest decrease at most window before it."""
    waiting, out = [], []
    for kind, ms in steps:
        hit = None
        if kind == "decreased":
            waiting.append(ms)
        elif kind in ("increased", "added"):
            hit = next((i for i, t in enumerate(waiting) if ms <= t + window), None)
            if hit is not None:
                del waiting[hit]
        out.append(hit is not None)
    return out


def test_refill_takes_the_earliest_unused_decrease(spark):
    steps = [("decreased", 0), ("decreased", 100), ("increased", 240), ("increased", 300), ("increased", 301), ("removed", 310), ("added", 311)]
    assert plain_refills(steps, 250) == [False, False, True, True, False, False, False]
    event = "session_id string, symbol string, epoch long, side string, price long, seq long, pos int, ts_ms long, quantity long, kind string"
    ev = spark.createDataFrame([("S", "X", 1, "BID", 5, i, 0, ms, 1, kind) for i, (kind, ms) in enumerate(steps)], event)
    assert rows(liquidity.replenishment(ev, 250), "seq") == [(2,), (3,)]


@pytest.mark.parametrize("back", [0, 300])
def test_refills_of_many_levels_in_one_pass(spark, back):
    rng = random.Random(back)
    out, want, seq = [], [], 0
    for level in range(40):
        steps, ms = [], 0
        for _ in range(rng.choice([0, 1, 5, 60, 400])):
            ms += rng.choice([0, 20, 90, 400])
            steps.append((rng.choice(["decreased", "decreased", "increased", "added", "removed"]), ms - rng.randrange(back + 1)))
        for (kind, at), hit in zip(steps, plain_refills(steps, 250), strict=True):
            seq += 1
            out.append(("S", "X", level % 3, rng.choice(["BID"]), level, seq, 0, at, 1, kind))
            want += [(seq, level)] * hit
    event = "session_id string, symbol string, epoch long, side string, price long, seq long, pos int, ts_ms long, quantity long, kind string"
    rng.shuffle(out)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)  # levels go on from batch to batch
    assert rows(liquidity.replenishment(spark.createDataFrame(out, event), 250), "seq", "price") == sorted(want, key=repr)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def sweep_tape(spark, prices):
    return trades(spark, [(i, p, 2, "BUY", 4000 + 10 * i) for i, p in enumerate(prices)] + [(99, 69000.0, 0.1, "SELL", 5000)])


@pytest.mark.parametrize(("prices", "n"), [([68000.0, 68000.1, 68000.2, 68000.3], 1), ([68000.0] * 4, 0), ([68000.0, 68000.1, 68000.0, 68000.1], 0)])
def test_sweeps(spark, prices, n):
    found = signals.sweeps(signals.cluster_measures(signals.clusters(sweep_tape(spark, prices))))
    assert found.count() == n
    if n:
        r = found.first()
        assert (r.levels_crossed, r.displacement, r.confidence) == (4, ticks(0.3), pytest.approx(1.0))


def absorption_of(spark, tape, updates):
    changes = book.level_changes(updates, seed_book(spark))
    line = book.top_of_book_timeline(updates, seed_book(spark))
    depth = book.depth_volume(book.book_asof(updates, seed_book(spark), tape)).drop("epoch")
    with_book = book.trade_with_book(tape, line).join(depth, ["session_id", "symbol", "seq"], "left")
    return signals.absorption(signals.absorption_windows(with_book), changes)


def test_absorption(spark):
    first = levels(spark, [(1, 0, "BID", 67999.0, 1, 7999)])
    tape = trades(spark, [(10 + i, i, 68000.0, 5, "SELL", 8000 + 5 * i) for i in range(5)] + [(20, 99, 68000.0, 0.1, "SELL", 10000)])
    r = absorption_of(spark, tape, first).collect()
    assert len(r) == 1 and r[0].trade_count == 5 and r[0].volume == 25 * SCALE
    small = trades(spark, [(10, 1, 68000.0, 50, "SELL", 8000), (20, 99, 68000.0, 0.1, "SELL", 10000)])
    assert absorption_of(spark, small, first).count() == 0


def test_no_absorption_in_a_crossed_book(spark):
    updates = levels(spark, [(i, 0, "BID", 68000.0 + 0.2 * i, 5, 7000 + i) for i in (1, 2)])
    tape = trades(spark, [(10 + i, i, 68000.0, 5, "BUY", 8000 + 5 * i) for i in range(5)] + [(20, 99, 68000.0, 0.1, "BUY", 10000)])
    assert absorption_of(spark, tape, updates).count() == 0


def test_large_trade(spark):
    got = flow.large_trades(trades(spark, [(1, 68000.0, 6, "BUY", 1), (2, 68000.0, 4, "BUY", 2)])).collect()
    assert [r.trade_id for r in got] == [1] and int(got[0].notional) == ticks(68000.0) * 6 * SCALE


def test_snapshots_are_greedy(spark):
    events = spark.createDataFrame([("S", "X", i, ms) for i, ms in enumerate([1000, 1500, 2000, 2900, 3100, 500])], "session_id string, symbol string, seq long, ts_ms long")
    assert [r.fired for r in snapshots.snapshot_segments(events, 1000).orderBy("seq").collect()] == [True, False, True, False, True, False]
    tape = trades(spark, [(1, 68000.0, 1, "BUY", 1000), (2, 68000.0, 2, "SELL", 1500), (3, 68000.0, 4, "BUY", 2100), (4, 68000.0, 8, "BUY", 2200)])
    none = spark.createDataFrame([], "session_id string, symbol string, seq long, anomalies long")
    got = snapshots.microstructure_snapshots(tape, levels(spark, []), seed_book(spark), none).orderBy("segment").collect()
    assert [(r.fired, r.trade_volume, r.delta, r.cvd) for r in got] == [(True, SCALE, SCALE, SCALE), (True, 6 * SCALE, 2 * SCALE, 3 * SCALE), (False, 8 * SCALE, 8 * SCALE, 11 * SCALE)]
    assert [r.best_bid for r in got] == [ticks(68000.0)] * 3
    assert snapshots.final_snapshot(snapshots.microstructure_snapshots(tape, levels(spark, []), seed_book(spark), none)).first().cvd == 11 * SCALE


def test_heat_cells(spark):
    t = trades(spark, [(i, 100.0, 1, "BUY", ms) for i, ms in enumerate((0, 500, 999, 1001))])
    none = spark.createDataFrame([], "session_id string, symbol string, ts_ms long, price long, kind string")
    bids = levels(spark, [(11, 0, "BID", 99.0, 8, 5000), (12, 0, "BID", 99.0, 12, 5100), (13, 0, "ASK", 101.0, 500, 5200), (14, 0, "ASK", 101.0, 200, 5300)])
    cells = heatmap.heat_cells(t, book.level_changes(bids, seed_book(spark)), none)
    assert heatmap.cell_counts(cells).first().bucket_count == 3
    assert rows(cells.where("bucket = 5000"), "price", "resting_bid", "resting_ask", "liquidity_added", "liquidity_removed") == [(ticks(101.0), 0, 200 * SCALE, 500 * SCALE, 300 * SCALE), (ticks(99.0), 12 * SCALE, 0, 12 * SCALE, 0)]


def test_frame_diff(spark):
    none = spark.createDataFrame([], "session_id string, symbol string, ts_ms long, price long, kind string")
    change = book.level_changes(levels(spark, []), seed_book(spark))
    make = lambda r: heatmap.heat_cells(trades(spark, r), change, none)
    before, after = make([(1, 100, 50, "BUY", 1)]), make([(1, 100, 150, "BUY", 1), (2, 300, 10, "BUY", 2)])
    diff = heatmap.frame_diff(before, after)
    assert rows(diff, "price", "change", "buy_volume") == [(ticks(100), "changed", 150 * SCALE), (ticks(300), "new", 10 * SCALE)]
    assert rows(heatmap.apply_diff(heatmap.by_price(before), diff), "price", "buy_volume") == rows(heatmap.by_price(after), "price", "buy_volume")
    s = heatmap.summary_diff(heatmap.frame(before, 0, ticks(1000), 5), heatmap.frame(after, 0, ticks(1000), 5)).first()
    assert s.total_buy_volume == 110 * SCALE
    assert rows(heatmap.frame_diff(after, before), "price", "change") == [(ticks(100), "changed"), (ticks(300), "removed")]


def test_sequencing_bridges_a_snapshot():
    m = sequence.Sequencer()
    for seq, first, final, previous in ((1, 150, 153, 149), (2, 154, 157, 153), (3, 158, 160, 157)):
        assert m.depth(seq, first, final, previous) == []
    assert m.snapshot(160) == [(1, "dropped"), (2, "dropped"), (3, "bridged")]
    assert m.depth(5, 161, 164, 160) == [(5, "applied")] and m.depth(6, 165, 167, 164) == [(6, "applied")]
    assert m.depth(7, 1, 167, 167) == [(7, "stale")] and m.depth(8, 200, 210, 999) == [(8, "mismatch")]
    assert m.depth(9, 211, 212, 210) == [] and m.snapshot(500) == [(9, "dropped")]
    m.depth(10, 600, 610, 0)
    assert m.snapshot(550) == [(10, "no_bridge")]


def test_window_eviction_makes_a_repeat_stale(spark):
    t = trades(spark, [(n, 1.0, 1, "BUY", n) for n in (1, 2, 3, 4, 2, 1, 0)])
    got = [r.status for r in sequence.classify_trades(t, 3).orderBy("seq").collect()]
    assert got == ["processed"] * 4 + ["duplicate", "stale", "stale"]


def brute_classify(ids, window):
    accepted, out = [], []
    for n in ids:
        if not accepted or n > accepted[-1]:
            accepted.append(n)
            out.append("processed")
        else:
            out.append("duplicate" if n in accepted[-window:] else "stale")
    return out


def test_classify_against_brute_force(spark):
    rng = random.Random(3)
    ids = [rng.randrange(60) + i // 3 for i in range(400)]
    t = trades(spark, [(n, 1.0, 1, "BUY", i) for i, n in enumerate(ids)])
    for window in (1, 4, 50):
        assert [r.status for r in sequence.classify_trades(t, window).orderBy("seq").collect()] == brute_classify(ids, window)


def test_timeline_against_brute_force_and_any_chunk(spark):
    rng = random.Random(5)
    updates = [(10 + i, 0, *rng.choice([("BID", 68000 - rng.randrange(4)), ("ASK", 68001 + rng.randrange(4))]), rng.choice([0, 0, 1, 2, 3]), i) for i in range(300)]
    held, want = {"BID": {68000.0: 10}, "ASK": {68000.1: 5}}, []
    for _, _, side, price, q, _ in updates:
        held[side].pop(price, None)
        if q:
            held[side][price] = q
        want.append((ticks(max(held["BID"])) if held["BID"] else None, ticks(min(held["ASK"])) if held["ASK"] else None))
    for chunk in (1, 7, 1000):
        line = book.top_of_book_timeline(levels(spark, updates), seed_book(spark), chunk)
        assert [(r.best_bid, r.best_ask) for r in line.orderBy("seq").collect()] == want


def test_partitions_do_not_matter(spark):
    rng = random.Random(9)
    t = trades(spark, [(i, 100 + rng.randrange(5), 1 + rng.randrange(9), rng.choice(["BUY", "SELL"]), i * 37) for i in range(300)])
    seen = set()
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(repr(rows(signals.cluster_measures(signals.clusters(t.repartition(n))), "cluster", "total_volume", "monotonic", "levels_crossed")))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(seen) == 1


def test_clusters_against_brute_force(spark):
    rng = random.Random(11)
    tape, ms = [], 0
    for i in range(300):
        ms += rng.choice([5, 40, 90, 150])
        tape.append((i, 100 + 0.1 * rng.randrange(6), 1 + rng.randrange(3), rng.choice(["BUY", "SELL"]), ms))
    from tapeweave.streaming.streams import clustering

    frame = pd.DataFrame([(i + 1, ticks(price), ticks(q), side, at) for i, (_, price, q, side, at) in enumerate(tape)], columns=["seq", "price", "quantity", "side", "ts_ms"])
    keys = ["cluster", "start_ms", "end_ms", "high", "low", "total_volume", "levels_crossed", "monotonic", "dominant_side"]
    want = plain_clusters(frame.to_dict("records"), 100, 3 * DEFAULT.tick)
    got = signals.cluster_measures(signals.clusters(trades(spark, tape))).where("closed").orderBy("cluster").collect()
    assert len(want) > 20 and [[r[k] for k in keys] for r in got] == [[w[k] for k in keys] for w in want]
    for most in (1, 3, 50, 1000):  # the stream's step, fed with frames cut at random places
        step, state, made, at = clustering(100, 3 * DEFAULT.tick), None, [], 0
        while at < len(frame):
            n = rng.randrange(1, most + 1)
            state, out = step(state, frame.iloc[at : at + n].reset_index(drop=True))
            made, at = made + out.to_dict("records"), at + n
        assert [[w[k] for k in keys] for w in made] == [[w[k] for k in keys] for w in want]


def plain_clusters(tape, gap, reach):
    """All clusters but the last, trade by trade."""
    runs = []
    for t in tape:
        if runs and t["ts_ms"] - runs[-1][-1]["ts_ms"] <= gap and abs(t["price"] - runs[-1][-1]["price"]) <= reach:
            runs[-1].append(t)
        else:
            runs.append([t])
    out = []
    for n, run in enumerate(runs[:-1], 1):
        side, monotonic, changes = {"BUY": 0, "SELL": 0}, True, 0
        for before, t in zip([None, *run], run, strict=False):
            if before is not None and t["price"] != before["price"]:
                changes += 1
                monotonic &= t["price"] > before["price"] if side["BUY"] >= side["SELL"] else t["price"] < before["price"]
            side[t["side"]] += t["quantity"]
        prices = [t["price"] for t in run]
        out.append({"cluster": n, "start_ms": run[0]["ts_ms"], "end_ms": run[-1]["ts_ms"], "high": max(prices), "low": min(prices), "total_volume": sum(side.values()), "levels_crossed": changes + 1, "monotonic": monotonic, "dominant_side": "BUY" if side["BUY"] >= side["SELL"] else "SELL"})
    return out


# --- Scans and sums over chunks ------------------------------------------------------------------


def test_segments_do_not_depend_on_chunks(spark):
    rng = random.Random(21)
    for back in (0, 500):
        ms, tape = 0, []
        for i in range(1, 260):
            ms += rng.choice([0, 0, 30, 200, 999, 1000, 2500])
            tape.append((rng.choice("AB"), "X", i, ms - rng.randrange(back + 1)))
        want = []
        for session in "AB":
            last, segment = None, 0
            for _, _, seq, t in (x for x in tape if x[0] == session):
                fired = last is None or t - last >= 1000
                want.append((session, seq, fired, segment))
                if fired:
                    last, segment = t, segment + 1
        df = spark.createDataFrame(tape, "session_id string, symbol string, seq long, ts_ms long")
        for chunk in (1, 3, 40, 10_000):
            assert rows(snapshots.snapshot_segments(df, 1000, chunk), "session_id", "seq", "fired", "segment") == sorted(want, key=repr)


def random_tape(rng, n):
    """Updates with ids that mostly chain, some stale, some broken, and snapshots whose ids lie before, in and after what is buffered."""
    out, last = [], 100
    for seq in range(1, n + 1):
        if rng.random() < 0.12:
            out.append((seq, last + rng.choice([-25, -6, -2, 0, 1, 4, 30]), None, None, None))
            continue
        first, final = last + 1, last + rng.choice([1, 3, 8])
        kind = rng.random()
        previous = last if kind < 0.85 else rng.choice([None, last - 3, last + 2])
        if kind > 0.95:
            first, final, previous = last - 9, last - rng.randrange(3), last  # stale
        out.append((seq, None, first, final, previous))
        last = max(last, final)
    return out


def test_continuity_equals_the_fold_on_tapes_cut_anywhere(spark):
    rng = random.Random(4)
    updates, marks, want = [], [], []
    for session in range(25):
        machine, tape = sequence.Sequencer(), random_tape(rng, rng.choice([3, 40, 150]))
        for seq, snapshot, *ids in tape:
            (marks if snapshot is not None else updates).append((str(session), "X", seq, *([snapshot] if snapshot is not None else ids)))
            made = machine.snapshot(snapshot) if snapshot is not None else machine.depth(seq, *ids)
            want += [(str(session), *x, seq) for x in made]
        want += [(str(session), *x, None) for x in machine.rest()]
    assert {x[2] for x in want} == set(sequence.STATUS)
    u = spark.createDataFrame(updates, "session_id string, symbol string, seq long, first_update_id long, final_update_id long, previous_final_update_id long")
    m = spark.createDataFrame(marks, "session_id string, symbol string, seq long, last_update_id long")
    for chunk in (1, 2, 7, 30, 10_000):
        assert rows(sequence.sequence_depth(u, m, chunk), "session_id", "seq", "status", "at_seq") == sorted(want, key=repr)


def test_sums_beyond_a_price():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 64, 300):
        price, weight = rng.integers(0, 12, n), rng.integers(0, 100, n)
        low, high, bound = rng.integers(0, n + 1, 200), rng.integers(0, n + 1, 200), rng.integers(-1, 14, 200)
        total, last = beyond(price, weight, low, high, bound)
        for i in range(200):
            at = [j for j in range(low[i], high[i]) if price[j] > bound[i]]
            assert (total[i], last[i]) == (weight[at].sum() if at else 0, at[-1] if at else -1)


@pytest.mark.parametrize("back", [0, 400])
def test_absorption_evidence_against_all_pairs(spark, back):
    rng = random.Random(back)
    changes, ms = [], 5000
    for seq in range(2, 600, 2):
        ms += rng.choice([0, 10, 60, 300])
        changes.append(("S", "X", seq, 0, rng.randrange(90, 110), ms - rng.randrange(back + 1), rng.randrange(4), rng.choice([None, 0, 1, 2])))
    windows = []
    for n in range(40):
        seq = rng.randrange(1, 590, 2)
        windows.append(("S", "X", n, rng.choice(["BUY", "SELL"]), seq, rng.choice([None, seq + 2 * rng.randrange(1, 60)]), min((c[5] for c in changes if c[2] > seq), default=ms), rng.randrange(90, 110), 7))
    want = []
    for w in windows:
        met = [c for c in changes if c[2] > w[4] and (w[5] is None or c[2] < w[5]) and c[5] - w[6] <= 1000 and c[5] // 1000 in (w[6] // 1000, w[6] // 1000 + 1) and (c[4] > w[7] if w[3] == "BUY" else c[4] < w[7])]
        want.append((w[2], sum(c[6] for c in met if c[6] > (c[7] or 0)), met[-1][6] if met else 7))
    w = spark.createDataFrame(windows, "session_id string, symbol string, price long, side string, open_seq long, close_seq long, open_ms long, reference long, opposing_open long")
    c = spark.createDataFrame(changes, "session_id string, symbol string, seq long, pos int, price long, ts_ms long, quantity long, old_quantity long")
    assert rows(signals.absorption_liquidity(w, c, 1000), "price", "replenished", "closing") == sorted(want, key=repr)


def test_top_of_a_deep_book():
    rng = random.Random(2)
    tape, held = [], {"BID": {}, "ASK": {}}
    want = []
    for seq in range(3000):
        side, price = rng.choice(["BID", "ASK"]), rng.randrange(1000)
        if rng.random() < 0.5 and held[side]:
            price = (max if side == "BID" else min)(held[side])  # the best level goes
        quantity = 0 if rng.random() < 0.5 else rng.randrange(1, 9)
        tape.append((seq, 0, False, side, price, quantity))
        held[side].pop(price, None)
        if quantity:
            held[side][price] = quantity
        bid, ask = max(held["BID"], default=None), min(held["ASK"], default=None)
        want.append((seq, 0, bid, ask, held["BID"].get(bid), held["ASK"].get(ask)))
    assert list(book._walk(iter(tape))) == want


def test_ticks(spark):
    df = spark.createDataFrame([("64369.60",), ("0.002",), ("not_a_price",), ("-1",), (None,), ("0.000000005",)], "s string")
    assert [r[0] for r in df.select(fn.to_ticks(F.col("s"))).collect()] == [6436960000000, 200000, None, 0, None, 1]
    assert spark.range(1).select(fn.grid_price(F.lit(6_800_010_000_013), 25)).first()[0] == 6_800_010_000_013 // 25


def test_wire_messages(spark):
    depth = '{"e":"depthUpdate","E":5,"T":4,"s":"X","U":151,"u":165,"pu":150,"b":[["50000.10","1.5"],["bad","1"]],"a":[["50000.20","0"]]}'
    raw = spark.createDataFrame([("S", 1, "X", "depth", 5, depth), ("S", 2, "X", "depth", 6, "{nope")], "session_id string, seq long, symbol string, stream_type string, exchange_event_ms long, raw_payload string")
    good, bad = wire.parse_depth(raw)
    assert rows(bad, "seq") == [(2,)]
    assert rows(wire.explode_levels(good), "pos", "side", "price", "quantity", "first_update_id", "previous_final_update_id") == [(0, "BID", ticks(50000.1), ticks(1.5), 151, 150), (2, "ASK", ticks(50000.2), 0, 151, 150)]
    trade = '{"e":"trade","E":5,"T":4,"s":"X","t":7,"p":"64371.50","q":"12.500","X":"MARKET","m":true}'
    marker, wrong = trade.replace("64371.50", "0").replace("MARKET", "NA"), trade.replace("64371.50", "not_a_price")
    raw = spark.createDataFrame([("S", i, "X", "trade", 5, p) for i, p in enumerate([trade, marker, wrong, "x"])], raw.schema)
    good, bad = wire.parse_trade(raw)
    assert rows(wire.normalize_trades(good), "seq", "status", "side", "price") == [(0, "ok", "SELL", ticks(64371.5)), (1, "marker", "SELL", 0), (2, "error", "SELL", None)]
    assert rows(bad, "seq") == [(3,)]
    doc = spark.createDataFrame([('{"lastUpdateId":160,"bids":[["1","2"]],"asks":[]}',), ("{}",)], "raw_payload string")
    assert rows(wire.parse_snapshot(doc), "last_update_id") == [(160,)]


def test_odd_payloads(spark):
    depth = '{"E":5,"U":1,"u":2,"b":[["1","2"]],"a":[]}'
    odd = [depth, depth[:-1], depth.replace("5", '"5"'), depth.replace("5", "5.5"), depth.replace('"U"', '"X"'), depth.replace("[]", "null"), depth.replace("[]", "7"), depth.replace('["1","2"]', "3"), f"[{depth}]", "7", "", None]
    raw = spark.createDataFrame([("S", i, "X", "depth", 5, p) for i, p in enumerate(odd)], "session_id string, seq long, symbol string, stream_type string, exchange_event_ms long, raw_payload string")
    good, bad = wire.parse_depth(raw)
    assert rows(good, "seq", "event_ms", "previous_final_update_id") == [(0, 5, None), (2, 5, None)] and sorted(rows(bad, "seq")) == [(1,), *((i,) for i in range(3, len(odd)))]
    assert good.columns == [*raw.columns, "event_ms", "transaction_ms", "message_symbol", "first_update_id", "final_update_id", "previous_final_update_id", "bids", "asks"] and bad.columns == raw.columns
    assert sorted(rows(wire.parse_book(raw), "seq")) == [(0,), (2,), (3,), (4,)] and wire.parse_book(raw).columns == [*raw.columns, "bids", "asks"]
    trade = '{"T":4,"t":7,"p":"a\\"b\\u00e9","q":1.5,"m":false}'
    odd = [trade, trade[:-1], trade.replace("false", "0.5"), trade.replace("7", "null"), trade.replace("1.5", "null"), trade.replace('"t"', '"T"')]
    good, bad = wire.parse_trade(spark.createDataFrame([("S", i, "X", "trade", 5, p) for i, p in enumerate(odd)], raw.schema))
    assert rows(good, "seq", "trade_id", "price_text", "quantity_text", "order_type", "buyer_is_maker", "trade_type") == [(0, 7, 'a"b\u00e9', "1.5", None, False, 0)]
    assert sorted(rows(bad, "seq")) == [(i,) for i in range(1, len(odd))]


def test_a_payload_is_parsed_once(spark):
    raw = spark.createDataFrame([("S", 1, "X", "depth", 5, "{}")], "session_id string, seq long, symbol string, stream_type string, exchange_event_ms long, raw_payload string")
    made = [wire.explode_levels(wire.parse_depth(raw)[0]), wire.normalize_trades(wire.parse_trade(raw)[0]).where("status = 'ok'"), wire.explode_levels(wire.parse_book(raw)), wire.parse_snapshot(raw)]
    for df in made:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("get_json_object") + plan.count("json_tuple") == 1 and plan.count("from_json") <= 2


def test_replayed_rows_are_made_once_and_files_grow_with_them(spark, tmp_path):
    from tapeweave.streaming import streams

    made = spark.sparkContext.accumulator(0)

    def count(v):
        made.add(len(v))
        return v

    seen = F.pandas_udf(count, "long")
    source = spark.range(90, numPartitions=3).select(F.col("id").alias("seq"), seen("id").alias("v"))
    stream = streams.replayed(spark, source, f"{tmp_path}/in", files=2, most=7)
    assert made.value == 90
    got = []
    query = stream.writeStream.foreachBatch(lambda b, n: got.append((n, sorted(r.seq for r in b.collect())))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    # 30 rows a batch are dealt in 5 files of about 7
    assert got == [(i, list(range(30 * i, 30 * i + 30))) for i in range(3)] and len(list((tmp_path / "in").glob("*.parquet"))) == 15
    assert made.value == 90


def test_snapshot_text_skips_bad_pairs(spark):
    df = spark.createDataFrame([("S", "[[1,2],[3],[4,5,6]]", "[]"), ("T", None, "nope")], "session_id string, bids string, asks string")
    assert rows(wire.decode_snapshot(df), "session_id", "side", "price", "quantity") == [("S", "BID", 1, 2)]


def test_audit_finds_each_fault(spark):
    t = trades(spark, [(1, 1.0, 1, "BUY", 1), (1, 1.0, 1, "BUY", 2), (2, 0, 1, "BUY", 3)])
    lv = levels(spark, [(10, 0, "BID", 1.0, 1, 1), (11, 0, "BID", 1.0, 1, 1), (12, 0, "BID", 2.0, 1, 1)]).withColumn("final_update_id", F.when(F.col("seq") == 12, 4).otherwise(5).cast("long"))
    raw = spark.createDataFrame([("S", 1, "X", "trade", 1, "{bad")], "session_id string, seq long, symbol string, stream_type string, exchange_event_ms long, raw_payload string")
    s = spark.createDataFrame([("S", "Y")], "session_id string, symbol string")
    r = audit.verify_report(s, raw, t, lv).first()
    assert (r.raw_parse_errors, r.duplicate_trade_ids, r.markers, r.invalid_symbol_rows, r.duplicate_depth_identities, r.depth_sequence_anomalies, r.verified) == (1, 1, 1, 6, 1, 2, False)


def test_tables_round_trip(spark, tmp_path):
    t = trades(spark, [(i, 1.0, 1, "BUY", i * 40_000_000) for i in range(10)])
    tables.write(t, str(tmp_path), tables.TRADES)
    got = tables.read_range(spark, str(tmp_path), tables.TRADES, "X", 80_000_000, 200_000_000)
    assert [r.trade_id for r in got.collect()] == [2, 3, 4, 5]
    assert "PartitionFilters: [isnotnull(dt" in got._jdf.queryExecution().toString()
    assert tables.read_session(spark, str(tmp_path), tables.TRADES, "S").count() == 10
    assert tables.storage_size(spark, str(tmp_path)).first().files > 0


def test_folders_are_listed_again_only_for_digits(spark, tmp_path, monkeypatch):
    schemas = []
    monkeypatch.setattr(DataFrameReader, "schema", lambda self, s, given=DataFrameReader.schema: schemas.append(s) or given(self, s))
    made = trades(spark, [(i, 1.0, 1, "BUY", 0) for i in range(4)])
    for n, (sessions, again) in enumerate([(("S", "T"), 0), (("S", "007"), 0), (("007", "08"), 1)]):
        for s in sessions:
            tables.write(made.withColumn("session_id", F.lit(s)), f"{tmp_path}/{n}", tables.TRADES)
        schemas.clear()
        got = tables.read(spark, f"{tmp_path}/{n}", tables.TRADES)
        assert len(schemas) == again and sorted(r.session_id for r in got.collect()) == sorted([*sessions] * 4)


def test_nearest_cell_takes_the_lower_of_a_tie(spark):
    cells = spark.createDataFrame([("S", "X", p) for p in (100, 200, 10_000)], "session_id string, symbol string, price long")
    probes = spark.createDataFrame([("S", "X", 1, 150), ("S", "X", 2, 190), ("S", "X", 3, 5000), ("S", "X", 4, 9999)], "session_id string, symbol string, probe_id long, target long")
    assert rows(heatmap.nearest_cell(cells, probes), "probe_id", "nearest") == [(1, 100), (2, 200), (4, 10_000)]


def test_config_is_frozen():
    assert bisect_left(DEFAULT.intervals, 1000) == 1
    with pytest.raises(AttributeError):
        Config().tick = 1


# --- Snapshots' anomalies and readiness, digest, places, partitions ------------------------------


def test_snapshots_count_anomalies_and_know_when_the_book_is_ready(spark):
    tape = trades(spark, [(2, 1, 68000.0, 1, "BUY", 1000), (6, 2, 68000.0, 1, "BUY", 2000), (10, 3, 68000.0, 1, "BUY", 3000), (20, 4, 68000.0, 1, "BUY", 4000)])
    ladders = seed_book(spark, 4).unionByName(seed_book(spark, 15))
    seen = spark.createDataFrame([("S", "X", 4, 1), ("S", "X", 10, 1), ("S", "X", 15, 1), ("S", "X", 30, 1)], "session_id string, symbol string, seq long, anomalies long")
    breaks = spark.createDataFrame([("S", "X", 8), ("S", "X", 20)], "session_id string, symbol string, seq long")
    got = snapshots.microstructure_snapshots(tape, levels(spark, []), ladders, seen, breaks=breaks).orderBy("segment").collect()
    # at 4 and 15 stand snapshots, whose anomalies count at the next trade; that at 30 comes after the last; 8 and 20 break the chain
    assert [(r.seq, r.anomalies, r.book_ready) for r in got] == [(2, 0, False), (6, 1, True), (10, 1, False), (20, 2, False)]


def test_profile_hash_is_that_of_the_profile(spark):
    rng = random.Random(1)
    tape = [(i, 100 + 0.1 * rng.randrange(9), 1 + rng.randrange(5), rng.choice(["BUY", "SELL"]), i) for i in range(200)]
    hashes = {flow.flow_digest(trades(spark, t).repartition(n)).first().profile_hash for t, n in ((tape, 1), (tape, 5), (sorted(tape, key=lambda x: x[1]), 3))}
    other = flow.flow_digest(trades(spark, [*tape[:-1], (199, 100.0, 6, "BUY", 199)]), levels=True).first()
    assert len(hashes) == 1 and other.profile_hash not in hashes and len(other.levels) == other.level_count


def test_running_values_backwards_and_by_another_number(spark):
    df = spark.createDataFrame([("S", "X", i, 10 * (i // 3), i % 4) for i in range(40)], "session_id string, symbol string, seq long, price long, v long")
    for chunk in (1, 7, 1000):
        got = running(df, "next", F.when(F.col("v") == 0, F.col("seq")), "last", chunk=chunk, back=True)
        got = running(got, "after", F.col("v"), "sum", inclusive=False, then=(F.col("seq"),), chunk=chunk, by="price", back=True)
        for seq, following, after in rows(got, "seq", "next", "after"):
            assert following == min((i for i in range(seq, 40) if i % 4 == 0), default=None) and after == sum(i % 4 for i in range(seq + 1, 40))


def test_a_range_of_one_symbol_opens_its_own_files(spark, tmp_path):
    day = 86_400_000
    rows_ = [(f"{n:03d}", f"SYM{n % 3}", i, i, 1, 1, "BUY", i * day // 2, "MARKET") for n in range(6) for i in range(8)]
    tables.write(spark.createDataFrame(rows_, "session_id string, symbol string, seq long, trade_id long, price long, quantity long, side string, ts_ms long, order_type string"), str(tmp_path), tables.TRADES)
    got = tables.read_range(spark, str(tmp_path), tables.TRADES, "SYM1", day, 2 * day)
    plan = got._jdf.queryExecution().executedPlan()
    pruned = re.search(r"PartitionFilters: \[(.*?)\]", plan.toString())[1]
    assert got.count() == 2 * 3 and "symbol" in pruned and "dt" in pruned and {r.session_id for r in got.collect()} == {"001", "004"}
    assert len(list((tmp_path / tables.TRADES).glob("dt=*/symbol=SYM1"))) == 4


# --- Streams -------------------------------------------------------------------------------------


def test_streams_go_on_after_a_restart(spark, tmp_path):
    from tapeweave.sources import testdata
    from tapeweave.streaming import streams

    sf = "/root/testdata/sf0.001"
    raw = testdata.raw(spark, sf).unionByName(testdata.raw_snapshots(spark, sf)).where("session_id in ('S0', 'S1')")
    cuts = [-1, 300, 900, 1500, 10**9]
    run = {
        "refills": (raw, lambda r: streams.stream_replenishment(r, 24 * 3_600_000), lambda: liquidity.replenishment(liquidity.liquidity_events(book.level_changes(testdata.levels(spark, sf), testdata.snapshot_levels(spark, sf))), 24 * 3_600_000).where("session_id in ('S0', 'S1')")),
        "dedup": (testdata.repeated_trades(spark, sf), lambda r: streams.on_time(streams.stream_dedup(r, 5)), lambda: sequence.classify_trades(testdata.repeated_trades(spark, sf), 5)),
    }
    for name, (source, stream, batch) in run.items():
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # each part is a run of its own, which finds the state of the one before
            source.where((F.col("seq") > a) & (F.col("seq") <= b)).write.mode("append").parquet(f"{tmp_path}/{name}/in")
            got = streams.drained(stream(spark.readStream.schema(source.schema).parquet(f"{tmp_path}/{name}/in")), f"{tmp_path}/{name}")
        columns = [c for c in got.columns if c in batch().columns]
        assert rows(got, *columns) == rows(batch(), *columns)


def test_frame_changes_are_those_of_the_batch_and_cells_expire(spark, tmp_path):
    from tapeweave.streaming import streams

    tape = [(1, 1, 100.0, 6, "BUY", 60_000), (2, 2, 100.1, 1, "SELL", 60_500), (3, 3, 100.0, 2, "SELL", 60_900), (4, 4, 100.0, 1, "BUY", 62_000), (5, 5, 100.2, 1, "BUY", 9_000_000)]
    out = []
    for part in (tape[:2], tape[2:3], tape[3:4], tape[4:], [(6, 6, 100.2, 1, "BUY", 9_000_001)]):
        trades(spark, part).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(trades(spark, []).schema).parquet(f"{tmp_path}/in")
        seen = len(out)
        done = streams.drained(streams.stream_frame_diff(stream, retention=5000, late="1 second"), str(tmp_path))
        got = rows(done, "price", "version", "change", "bucket", "buy_volume", "sell_volume", "trade_count")
        out += [x for x in got if x not in out]
        if len(part) == 1 and part[0][0] == 3:
            assert out[seen:] == [(ticks(100.0), 2, "changed", 60_000, 6 * SCALE, 2 * SCALE, 2)]  # the price that the batch touches, alone
    assert (ticks(100.0), 3, "changed", 62_000, SCALE, 0, 1) in out and (ticks(100.2), 1, "new", 9_000_000, SCALE, 0, 1) in out
    assert {x[0] for x in out if x[2] == "removed"} == {ticks(100.0), ticks(100.1)}
