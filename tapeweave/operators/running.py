"""Running values over a session without a task that orders the whole session.

A session is cut into chunks of sequence numbers. One grouping gives each chunk's total, a window over
the few totals what stands before each chunk, and a window within a chunk the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.functions.ticks import bucket_start

KEYS = ["session_id", "symbol"]
CHUNK = 1_000_000  # sequence numbers that one task orders


def running(
    rows: DataFrame, name: str, value: Column, how: str, inclusive: bool = True, then: tuple[Column, ...] = (), chunk: int = CHUNK, keys: Sequence[str] = KEYS, by: str = "seq", back: bool = False
) -> DataFrame:
    """rows with column name: the sum, max or last of value (nulls aside) over the session's rows up to each one, or before it.

    Rows are in order of by, a number that chunks cut, and of then where it ties; with back the order
    is turned, so the last is the next one. Before the first value, sums are 0, others null. Rows are
    dealt by chunk once, for the chunks' totals and for the values within them.
    """
    keys = list(keys)
    each = [*keys, "_chunk"]
    rows = rows.withColumns({"_chunk": bucket_start(F.col(by), chunk), "_value": value}).repartition(*each)
    order = [F.col(by), *then]
    turned = [x.desc() for x in order] if back else order
    within = Window.partitionBy(*each).orderBy(*turned).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = Window.partitionBy(*keys).orderBy(F.desc("_chunk") if back else F.asc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    if how == "last":
        newest = F.min_by if back else F.max_by
        total = newest("_value", F.when(F.col("_value").isNotNull(), F.struct(*order)))
        over = lambda c, w: F.last(c, ignorenulls=True).over(w)
    else:
        total = F.sum("_value") if how == "sum" else F.max("_value")
        over = lambda c, w: (F.sum(c) if how == "sum" else F.max(c)).over(w)
    heads = rows.groupBy(*each).agg(total.alias("_total")).select(*each, over("_total", before).alias("_before"))
    inner, outer = F.col("_inner"), F.col("_before")
    zero = F.lit(0).cast("bigint")
    both = F.coalesce(inner, zero) + F.coalesce(outer, zero) if how == "sum" else F.greatest(inner, outer) if how == "max" else F.coalesce(inner, outer)
    return rows.withColumn("_inner", over("_value", within)).join(heads, each).withColumn(name, both).drop("_chunk", "_value", "_inner", "_before")
