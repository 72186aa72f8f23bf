"""Scalar functions on ticks, times and trades; all stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeweave.config import SCALE

GRIDS = (1, 5, 10, 25, 50)


def _div(x: Column, n: int) -> Column:
    """Integer division of a bigint column, without a detour over double."""
    return (x - x % n).cast("decimal(20,0)").__truediv__(F.lit(n)).cast("bigint")


def to_ticks(text: Column) -> Column:
    """Decimal text to ticks, half away from zero; null where it isn't a number, 0 for a negative one."""
    ticks = F.round(text.try_cast("decimal(28,10)") * SCALE, 0).try_cast("bigint")
    return F.when(ticks.isNotNull(), F.greatest(ticks, F.lit(0).cast("bigint")))


def ms_to_timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def timestamp_to_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def ns_to_ms(ns: Column) -> Column:
    return _div(ns, 1_000_000)


def ns_parts(ns: Column) -> Column:
    """Whole seconds and the nanoseconds left."""
    return F.struct(_div(ns, 1_000_000_000).alias("seconds"), (ns % 1_000_000_000).alias("nanos"))


def is_marker(price: Column, quantity: Column, order_type: Column) -> Column:
    """Text form of a marker: price or quantity is a written zero, or the order type is NA."""
    zero = ["0", "0.0", "0.00"]
    return price.isin(zero) | quantity.isin(zero) | F.coalesce(order_type == "NA", F.lit(False))


def aggressor_side(buyer_is_maker: Column) -> Column:
    return F.when(buyer_is_maker, "SELL").otherwise("BUY")


def signed(quantity: Column, side: Column) -> Column:
    return F.when(side == "BUY", quantity).otherwise(-quantity)


def notional(price: Column, quantity: Column) -> Column:
    """Exact product of ticks, at scale 1e-16."""
    return (price.cast("decimal(19,0)") * quantity.cast("decimal(19,0)")).cast("decimal(38,0)")


def notional_float(price: Column, quantity: Column) -> Column:
    return notional(price, quantity).cast("double") / float(SCALE) / float(SCALE)


def bucket_start(ms: Column, interval: Column | int) -> Column:
    return ms - ms % interval


def grid_price(price: Column, factor: int) -> Column:
    """price div factor for a known factor, else price."""
    return price if factor not in GRIDS or factor == 1 else _div(price, factor)


def classify_change(old: Column, new: Column) -> Column:
    """added, removed, increased, decreased or unchanged; an absent level has old null."""
    before = F.coalesce(old, F.lit(0))
    return (
        F.when((before == 0) & (new > 0), "added")
        .when((before > 0) & (new == 0), "removed")
        .when(new > before, "increased")
        .when(new < before, "decreased")
        .otherwise("unchanged")
    )


def level_delta(old: Column, new: Column) -> Column:
    return new - F.coalesce(old, F.lit(0))


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def mid_float(bid: Column, ask: Column) -> Column:
    return (bid + ask) / F.lit(2.0)
