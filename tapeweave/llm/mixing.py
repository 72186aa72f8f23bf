"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A document of a source with target t and size s is to be taken t / s times: its whole part surely,
the fractional part as a copy probability. Blocks of documents of one source pair those probabilities:
words move at random from one of a pair to the other until one of them is surely in or out. The
largest document is paired first, with all smaller ones of its block together, whose probability is
one and moves as one; then the next largest, so that a small one stays open. What is left of each
block goes up a tree of fan-in FAN, paired one by one, to at most one open document per source, which
a coin decides. Expected copies stay as they were, and a source's taken words stay within that one,
small document of its target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.llm.common import cut, fresh, text_of

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3.0
FAN = 128
NEAR = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; null text: 0), copies_of (rows that agree in all three)."""
    rows = docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))
    return rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies_of"))


def targets(units: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = CAP) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources by code point, null last, weigh as in weights, repeating. They share all words; one that
    would exceed cap times its size stops there and the others share the excess by weight. Sorted by
    cap / weight, the stopped ones are a prefix, so prefix sums give the common level.
    """
    whole = Window.partitionBy()
    by_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies_of")).alias("source_size"), F.sum("copies_of").alias("rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    s = by_source.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumns({"level": (F.sum("source_size").over(whole) - before) / rest, "place": F.row_number().over(order)})
    free = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("place"))
    level = F.min_by("level", free).over(whole)
    return s.withColumn("level", level).select("source", "source_size", "rows", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def _pair(state: Column, b: Column) -> Column:
    """One step: pair the open document with b; the decided one joins out, the other stays open."""
    a = state["open"]
    mass = lambda x: x["words"].cast("double")
    up = F.least((1 - a["p"]) * mass(a), b["p"] * mass(b))  # words that a can take from b
    down = F.least(a["p"] * mass(a), (1 - b["p"]) * mass(b))
    moved = F.when(b["u"] * (up + down) < down, up).otherwise(-down)
    return _settle(state, b, a["p"] + moved / mass(a), b["p"] - moved / mass(b))


def _unit(x: Column, p: Column) -> Column:
    return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["copies_of"].alias("copies_of"), x["words"].alias("words"), p.alias("p"))


def _settle(state: Column, b: Column, pa: Column, pb: Column) -> Column:
    a = state["open"]
    done = F.filter(F.array(F.when(_integral(pa), _unit(a, F.round(pa))), F.when(_integral(pb), _unit(b, F.round(pb)))), lambda x: x.isNotNull())
    left = F.when(~_integral(pa), _unit(a, pa)).when(~_integral(pb), _unit(b, pb))
    return F.struct(left.alias("open"), F.concat(state["out"], done).alias("out"))


def _blocks(units: DataFrame, level: int, seed: int) -> DataFrame:
    """Blocks of one level with their items, large ones first; u is each one's random number."""
    u = (F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "size").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).alias("u")
    item = F.struct((-F.col("words")).alias("large_first"), u, "doc_id", "size", "copies_of", "words", "p")
    return units.groupBy("source", "blocks", "block").agg(F.sort_array(F.collect_list(item)).alias("items"))


def _pooled(units: DataFrame, seed: int) -> DataFrame:
    """The lowest level: source, block, open (null or the open document), out (the decided ones).

    All documents of a block have one probability. Each is paired with the rest of the block, whose
    probability moves as one, until it is decided or the rest is.
    """
    blocks = _blocks(units, 0, seed)
    first = F.element_at("items", 1)
    mass = F.aggregate("items", F.lit(0).cast("double"), lambda sum_, x: sum_ + x["words"].cast("double"))
    none = F.slice(F.transform("items", lambda x: _unit(x, x["p"])), 1, 0)
    start = F.struct(first["p"].alias("p"), mass.alias("rest"), F.get(none, 0).alias("open"), none.alias("out"))

    def step(state: Column, x: Column) -> Column:
        p, m = state["p"], x["words"].cast("double")
        rest = state["rest"] - m
        up, down = F.least((1 - p) * m, p * rest), F.least(p * m, (1 - p) * rest)
        gains = x["u"] * (up + down) < down
        mine = F.when(rest <= 0, p).when(gains, p + up / m).otherwise(p - down / m)
        pool = F.when(rest <= 0, p).when(gains, p - up / rest).otherwise(p + down / rest)
        settled = _integral(p) | _integral(mine)
        mine = F.when(_integral(p), F.round(p)).otherwise(mine)
        out = F.when(settled, F.concat(state["out"], F.array(_unit(x, F.round(mine))))).otherwise(state["out"])
        return F.struct(F.when(_integral(p), p).otherwise(pool).alias("p"), rest.alias("rest"), F.coalesce(state["open"], F.when(~settled, _unit(x, mine))).alias("open"), out.alias("out"))

    walked = F.aggregate("items", start, step)
    return blocks.select("source", "blocks", "block", walked.alias("r")).select("source", "blocks", "block", "r.open", "r.out")


def _integral(p: Column) -> Column:
    return (p <= NEAR) | (p >= 1 - NEAR)


def _reduce(units: DataFrame, level: int, seed: int) -> DataFrame:
    """Blocks of a higher level: source, block, open (null or the open document), out (the decided ones)."""
    blocks = _blocks(units, level, seed)
    first = F.element_at("items", 1)
    start = F.struct(_unit(first, first["p"]).alias("open"), F.slice(F.transform("items", lambda x: _unit(x, x["p"])), 1, 0).alias("out"))

    def step(state: Column, b: Column) -> Column:
        taken = F.struct(_unit(b, b["p"]).alias("open"), state["out"].alias("out"))
        return F.when(state["open"].isNull(), taken).otherwise(_pair(state, b))

    walked = F.aggregate(F.slice("items", F.lit(2), F.greatest(F.size("items") - 1, F.lit(1))), start, step)
    return blocks.select("source", "blocks", "block", walked.alias("r")).select("source", "blocks", "block", "r.open", "r.out")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = CAP, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (size times copies).

    Reruns agree: the random numbers are hashes of seed, doc_id and size. Empty documents and sources
    take nothing; a null source is a source; rows that agree in doc_id, source and size get equal
    copies, and so do rows without a doc_id of equal size. Empty input gives no rows; other columns
    of the input are ignored.
    """
    units = cut(sizes(docs))
    by_source = cut(targets(units, weights, cap))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(share + NEAR)
    plan = by_source.select(F.col("source").alias("_source"), "rows", whole.alias("whole"), F.when(share - whole > NEAR, share - whole).otherwise(0.0).alias("p"))
    planned = units.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    blocks = F.ceil(F.col("rows") / FAN)
    level = planned.where(open_).select("source", "doc_id", "size", "copies_of", (F.col("size") * F.col("copies_of")).alias("words"), "p", blocks.alias("blocks"), F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), blocks).alias("block"))
    most = by_source.agg(F.max("rows")).first()[0] or 0
    decided, depth, fan_out = planned.where(~open_).select("source", "doc_id", "size", "copies_of", F.lit(0.0).alias("p")), 0, -(-most // FAN)
    while True:
        done = cut(_reduce(level, depth, seed) if depth else _pooled(level, seed))
        decided = decided.unionByName(done.select("source", F.explode("out").alias("x")).select("source", "x.doc_id", "x.size", "x.copies_of", "x.p"))
        rest = done.where(F.col("open").isNotNull()).select("source", "open.*", F.ceil(F.col("blocks") / FAN).alias("blocks"), F.floor(F.col("block") / FAN).alias("block"))
        if fan_out <= 1:
            break
        level, depth, fan_out = rest, depth + 1, -(-fan_out // FAN)
    coin = F.xxhash64(F.lit(seed), F.lit(-1), "doc_id", "size").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    decided = decided.unionByName(rest.select("source", "doc_id", "size", "copies_of", F.when(coin < F.col("p"), 1.0).otherwise(0.0).alias("p")))
    stats = by_source.select(F.col("source").alias("_source"), "source_size", "target", whole.alias("whole"))
    copies = (F.col("whole") + F.col("p")).cast("long")
    return (
        decided.join(stats, F.col("source").eqNullSafe(F.col("_source")))
        .select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), F.explode(F.sequence(F.lit(1), F.col("copies_of"))).alias("_row"))
        .drop("_row")
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = CAP, seed: int = 17) -> DataFrame:
    """The mix itself: each document as often as mix takes it, with its columns."""
    names = fresh(docs, "_id", "_source", "_size", "_copies", "_copy")
    taken = mix(docs, weights, cap, seed).where("copies > 0").dropDuplicates(["doc_id", "source", "size"])
    number, source = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    taken = taken.select(*(c.alias(n) for c, n in zip((number, source, F.col("size"), F.col("copies")), names, strict=False)))
    keyed = docs.withColumns({names[0]: number, names[1]: source, names[2]: F.regexp_count(text_of(), F.lit(WORD)).cast("long")})
    many = keyed.join(taken, names[:3]).withColumn(names[4], F.explode(F.sequence(F.lit(1).cast("long"), names[3])))
    return many.drop(*names)
