"""Small market tables for the tests. Prices and quantities are in contract units."""

from tapeweave.config import SCALE

TRADE = "session_id string, symbol string, seq long, trade_id long, price long, quantity long, side string, ts_ms long, order_type string"
LEVEL = "session_id string, symbol string, seq long, pos int, side string, price long, quantity long, ts_ms long"


def ticks(x):
    return round(x * SCALE)


def trades(spark, rows, session="S"):
    """rows: (id, price, quantity, side, ms) or with a leading seq."""
    out = []
    for i, r in enumerate(rows):
        seq, (number, price, quantity, side, ms) = (r[0], r[1:]) if len(r) == 6 else (i + 1, r)
        out.append((session, "X", seq, number, ticks(price), ticks(quantity), side, ms, "MARKET"))
    return spark.createDataFrame(out, TRADE)


def levels(spark, rows, session="S"):
    """rows: (seq, pos, side, price, quantity, ms)."""
    return spark.createDataFrame([(session, "X", s, p, side, ticks(price), ticks(q), ms) for s, p, side, price, q, ms in rows], LEVEL)


def seed_book(spark, seq=0):
    return levels(spark, [(seq, 0, "BID", 68000.0, 10, 0), (seq, 1, "ASK", 68000.1, 5, 0)])
