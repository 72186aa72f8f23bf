"""Data-quality audit of recorded sessions, and the outcome of a replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeweave.operators.book import best_bid_ask, mid, spread
from tapeweave.operators.flow import last_trade
from tapeweave.operators.running import running
from tapeweave.operators.sequence import sequence_report

KEYS = ["session_id", "symbol"]


def raw_parse_errors(raw: DataFrame) -> DataFrame:
    return raw.groupBy("session_id").agg(F.count(F.lit(1)).alias("raw_events"), F.count_if(F.try_parse_json(F.col("raw_payload")).isNull()).alias("raw_parse_errors"))


def duplicate_trade_ids(trades: DataFrame) -> DataFrame:
    return trades.groupBy("session_id", "trade_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def marker_as_trade(trades: DataFrame) -> DataFrame:
    """Trades whose numbers or type say that they are markers."""
    return trades.where((F.col("price") == 0) | (F.col("quantity") == 0) | (F.col("order_type") == "NA"))


def invalid_symbol_rows(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per session that is known: rows of another symbol than the session's."""
    known = sessions.select("session_id", F.col("symbol").alias("expected"))
    return rows.select("session_id", "symbol").join(known, "session_id").groupBy("session_id").agg(F.count_if(F.col("symbol") != F.col("expected")).alias("invalid_symbol_rows"))


def duplicate_depth_identities(levels: DataFrame) -> DataFrame:
    """Rows beyond the first of each (final update id, side, price)."""
    return levels.groupBy("session_id", "final_update_id", "side", "price").agg((F.count(F.lit(1)) - 1).alias("extra")).groupBy("session_id").agg(F.sum("extra").alias("duplicate_depth_identities"))


def depth_sequence_anomalies(levels: DataFrame) -> DataFrame:
    """Depth updates whose final id isn't above the one before."""
    per = levels.groupBy("session_id", "seq").agg(F.max("final_update_id").alias("final_update_id"))
    return running(per, "previous", F.col("final_update_id"), "last", inclusive=False, keys=["session_id"]).where(F.col("final_update_id") <= F.col("previous"))


def session_counts(raw: DataFrame, trades: DataFrame, levels: DataFrame) -> DataFrame:
    """Rows per session in the three tables, from one grouping."""
    tagged = lambda df, name: df.select("session_id", F.lit(name).alias("t"))
    count = lambda name: F.count_if(F.col("t") == name).alias(f"{name}_rows")
    return tagged(raw, "raw").unionByName(tagged(trades, "trade")).unionByName(tagged(levels, "level")).groupBy("session_id").agg(count("raw"), count("trade"), count("level"))


def count_depth_events(levels: DataFrame) -> DataFrame:
    return levels.groupBy("session_id").agg(F.count_distinct("seq").alias("depth_events"))


def ingest_metrics(raw: DataFrame) -> DataFrame:
    """Per session and stream: rows received, stored, rejected (payload isn't JSON) and bytes."""
    ok = F.try_parse_json(F.col("raw_payload")).isNotNull()
    return raw.groupBy("session_id", "stream_type").agg(F.count(F.lit(1)).alias("received"), F.count_if(ok).alias("stored"), F.count_if(~ok).alias("rejected"), F.sum(F.octet_length("raw_payload")).alias("bytes"))


def verify_report(sessions: DataFrame, raw: DataFrame, trades: DataFrame, levels: DataFrame) -> DataFrame:
    """One row per session: all counts, issues, verified. Each finding becomes rows of one long table that is summed once."""
    one = lambda df, name, n=F.lit(1): df.select("session_id", F.lit(name).alias("what"), n.cast("bigint").alias("n"))
    ids = trades.unionByName(levels, allowMissingColumns=True)
    found = [
        one(raw_parse_errors(raw), "raw_events", F.col("raw_events")), one(raw_parse_errors(raw), "raw_parse_errors", F.col("raw_parse_errors")),
        one(trades, "trade_rows"), one(levels, "level_rows"), one(duplicate_trade_ids(trades), "duplicate_trade_ids"), one(marker_as_trade(trades), "markers"),
        one(invalid_symbol_rows(ids, sessions), "invalid_symbol_rows", F.col("invalid_symbol_rows")),
        one(duplicate_depth_identities(levels), "duplicate_depth_identities", F.col("duplicate_depth_identities")),
        one(depth_sequence_anomalies(levels), "depth_sequence_anomalies"), one(count_depth_events(levels), "depth_events", F.col("depth_events")),
    ]
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    names = ["raw_events", "raw_parse_errors", "trade_rows", "level_rows", "duplicate_trade_ids", "markers", "invalid_symbol_rows", "duplicate_depth_identities", "depth_sequence_anomalies", "depth_events"]
    issues = ["raw_parse_errors", "duplicate_trade_ids", "markers", "invalid_symbol_rows", "duplicate_depth_identities", "depth_sequence_anomalies"]
    out = rows.groupBy("session_id").agg(*(F.coalesce(F.sum(F.when(F.col("what") == c, F.col("n"))), F.lit(0)).alias(c) for c in names))
    total = sum((F.col(c) for c in issues), F.lit(0))
    return out.withColumns({"issues": total, "verified": total == 0})


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two results has more often than the other; none if they are equal."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def _tops(book: DataFrame) -> DataFrame:
    """Per session: best prices, mid and spread (none where crossed) and level counts of a book at its end."""
    best = best_bid_ask(book, KEYS).select(*KEYS, "best_bid", "best_ask", "bid_levels", "ask_levels")
    return best.withColumns({"mid": mid(), "spread": spread()})


def replay_outcome(statuses: DataFrame, classified: DataFrame, updates: DataFrame, snapshots: DataFrame, book: DataFrame) -> DataFrame:
    """One row per session: what a replay of its events counts, and the book it ends with.

    updates: headers of depth updates; snapshots: session_id, symbol, seq, last_update_id; book: sequenced_book.
    A snapshot that no buffered update bridges is an error, as a mismatch is.
    """
    is_ = lambda *names: F.count_if(F.col("status").isin(*names))
    s = statuses.join(updates.select(*KEYS, "seq", "final_update_id"), [*KEYS, "seq"])
    taken = F.when(F.col("status").isin("applied", "bridged"), F.struct("at_seq", "seq"))
    depth = s.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("depth_events"), is_("applied", "bridged").alias("events_applied"), is_("stale").alias("events_ignored"), is_("mismatch").alias("_mismatch"), is_("bridged").alias("_bridged"), F.max(taken).alias("_at"), F.max_by("final_update_id", taken).alias("_last"))
    shots = snapshots.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("snapshots_applied"), F.max("seq").alias("_seq"), F.max_by("last_update_id", "seq").alias("_id"))
    trades = classified.groupBy(*KEYS).agg(is_("processed").alias("trades_processed"), is_("duplicate", "stale").alias("trades_skipped"))
    rows = depth.join(shots, KEYS, "full_outer").join(trades, KEYS, "full_outer").join(_tops(book), KEYS, "full_outer")
    counts = ["depth_events", "snapshots_applied", "events_applied", "events_ignored", "trades_processed", "trades_skipped"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in [*counts, "_mismatch", "_bridged"]})
    newer = F.col("_seq").isNull() | (F.col("_at.at_seq") >= F.col("_seq"))
    return rows.select(
        *KEYS, *counts, (F.col("depth_events") + F.col("snapshots_applied") + F.col("trades_processed") + F.col("trades_skipped")).alias("events_total"),
        (F.col("_mismatch") + F.col("snapshots_applied") - F.col("_bridged")).alias("sequence_errors"), F.when(newer, F.col("_last")).otherwise(F.col("_id")).alias("final_update_id"),
        "best_bid", "best_ask", "bid_levels", "ask_levels", "mid", "spread",
    )


def market_status(trades: DataFrame, book: DataFrame, cells: DataFrame, statuses: DataFrame) -> DataFrame:
    """Per session: best prices, mid, spread, last trade, number of heat cells, sequence errors. book: sequenced_book."""
    best = _tops(book).drop("bid_levels", "ask_levels")
    last = last_trade(trades).select(*KEYS, F.col("price").alias("last_price"), F.col("quantity").alias("last_quantity"), F.col("side").alias("last_side"))
    counts = cells.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("cell_count"))
    return best.join(last, KEYS, "full_outer").join(counts, KEYS, "full_outer").join(sequence_report(statuses).select(*KEYS, F.col("errors").alias("sequence_errors")), KEYS, "full_outer")
