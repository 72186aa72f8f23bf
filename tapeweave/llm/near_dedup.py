"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Equal texts are one node first. A node's k-mers are its runs of five words, labelled with their
occurrence number; each of SKETCHES sketches takes the PICK least ones under a random order and
keeps them in text order, so a sketch agrees with the probability of order-sensitive similarity.
Nodes that agree in a sketch are first compared with one centre of that bucket, the member whose
buckets are the largest: the original of a group of copies shares more of them than any copy does.
So a bucket of near copies costs as many comparisons as it has members. A bucket where a member
failed is open: all of its members that aren't in one class yet meet each other, whatever its size.
Up to BLOCK members do so in a join; of a larger bucket (a passage or a template that many texts hold)
a task holds two blocks of about SPAN members with their texts. It leaves out the pairs whose lengths or
counts of words (by BAG hash values) already differ by more edits than the similarity allows, so no
near pair, and aligns the others, unless links found before have joined them. A pair is aligned in the
bucket of the first sketch that it shares. What has more than WIDE members is joined by 2, 4 or more
sketches at once first, which makes most near ones one class cheaply; then it meets whole like the others,
so a class depends on no bucket's size. A comparison aligns
the two word sequences within a diagonal band that doubles up to what a similarity of 0.8 leaves:
1 - edits / longer length. Verified links make classes by repeated contraction to the least member.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeweave.llm.common import ROWS_A_FILE, cut, fresh, packed, small_batches, text_of
from tapeweave.llm.words import BASE, U, mix, per_slice, seeds, signed, split
from tapeweave.operators.scan import groups

K, PICK, SKETCHES, SIMILAR = 5, 2, 20, 0.8
BLOCK, SPAN, WIDE, BAG = 32, 512, 4096, 128
HELD = 64 << 20  # bytes of word codes that a task keeps while it aligns members of a large bucket
LEVELS, MISS = (2, 4, 6, 8), 1e-3
JUMPS, SPREAD = 2, 16


def order_minhash(code: np.ndarray, doc: np.ndarray, first: np.ndarray, sketches: int = SKETCHES, pick: int = PICK) -> np.ndarray:
    """(texts, sketches) of 64-bit codes; a text without k-mers gets zeros."""
    n = len(first) - 1
    out = np.zeros((n, sketches), U)
    sizes = np.diff(first)
    full = np.flatnonzero(sizes > 0)
    if not len(full):
        return out
    order = np.lexsort((code, doc))
    c, d = code[order], doc[order]
    fresh = np.ones(len(c), bool)
    fresh[1:] = (c[1:] != c[:-1]) | (d[1:] != d[:-1])
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(c)), 0))
    label = np.empty(len(c), U)
    label[order] = (np.arange(len(c)) - begin).astype(U)
    labelled = mix(code + label * U(BASE))
    starts, lengths = first[:-1][full], sizes[full]
    where = np.arange(len(code))
    top = U(np.iinfo(np.uint64).max)
    for s, seed in enumerate(seeds(sketches, 0x0DE2)):
        value = mix(labelled ^ seed)
        picked = np.full((len(full), pick), len(code))
        for p in range(pick):
            least = np.repeat(np.minimum.reduceat(value, starts), lengths)
            at = np.where((value == least) & (value != top), where, len(code))
            picked[:, p] = np.minimum.reduceat(at, starts)
            value[picked[:, p][picked[:, p] < len(code)]] = top
        picked.sort(axis=1)
        sketch = np.full(len(full), seed, U)
        for p in range(pick):
            has = picked[:, p] < len(code)
            sketch[has] = mix(sketch[has] * U(BASE) + code[picked[has, p]])
        out[full, s] = sketch
    return out


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """1 - edits / longer length of two word sequences, by alignment within a band; 0 where it is below least."""
    if len(a) < len(b):
        a, b = b, a
    n = len(a)
    if not n:
        return 1.0
    allowed = int((1 - least) * n + 1e-9)
    if n - len(b) > allowed or n - _shared(a, b) > allowed:  # words that b lacks are edits, wherever they stand
        return 0.0
    same = a[: len(b)] == b
    head = len(b) if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    if len(b):
        same = a[len(a) - len(b) :][::-1] == b[::-1]
        tail = len(b) if same.all() else int(np.argmin(same))
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(b):
        return 1 - len(a) / n if len(a) <= allowed else 0.0
    band = max(16, len(a) - len(b))
    while True:
        band = min(band, allowed, len(a))
        edits = _edits(a.tolist(), b.tolist(), band)
        if edits <= band:
            return 1 - edits / n
        if band in (allowed, len(a)):
            return 0.0
        band *= 3


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sequences as multisets."""
    code, count = np.unique(np.concatenate([a, b]), return_inverse=True)
    return int(np.minimum(np.bincount(count[: len(a)], minlength=len(code)), np.bincount(count[len(a) :], minlength=len(code))).sum())


def _edits(a: list[int], b: list[int], band: int) -> int:
    """Edits between a and b (not longer than a, at least as long as a less band); more than band if band is exceeded.

    Bit-parallel: one integer holds the vertical steps of a column inside the band, which moves down
    one row with each word of b; the count follows the band's lowest diagonal, then a's last row.
    """
    where: dict[int, int] = {}
    for i, word in enumerate(a):
        where[word] = where.get(word, 0) | 1 << i
    width = 2 * band + 2
    ones = (1 << width) - 1
    up, down, score = ones >> (width - band - 1) << (width - band - 1), 0, band
    diagonal, across, start = 1 << (width - 1), 1 << (width - 2), band + 1 - width
    limit = band + len(b) - (len(a) - band)
    for i, word in enumerate(b):
        match = where.get(word, 0)
        match = (match >> start if start >= 0 else match << -start) & ones
        zero = ((((match & up) + up) ^ up) | match | down) & ones
        right, left = down | (ones ^ (zero | up)), zero & up
        if i < len(a) - band:
            score += not zero & diagonal
        else:
            score += bool(right & across) - bool(left & across)
            across >>= 1
        if score > limit:
            return band + 1
        up, down = left | (ones ^ ((zero >> 1) | right)), (zero >> 1) & right
        start += 1
    return score


def sketched(docs: DataFrame, sketches: int = SKETCHES, pick: int = PICK) -> DataFrame:
    """node (MD5 of the text), sketch (array of long): one row per document that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, w in per_slice(batch["text"]):
                codes = signed(order_minhash(*w.shingles(K), sketches, pick))
                has = np.flatnonzero(np.diff(w.first) > 0)
                flat = pa.array(np.ascontiguousarray(codes[has]).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * sketches), flat)
                yield pa.record_batch([batch["node"].slice(row, w.n).take(pa.array(has)), lists], ["node", "sketch"])

    return docs.select(_node(), text_of().alias("text")).mapInArrow(run, "node binary, sketch array<long>")


def _node() -> Column:
    return F.unhex(F.md5(text_of())).alias("node")


def _buckets(sketches: DataFrame) -> DataFrame:
    """key, place, node, size: the buckets of two or more nodes; place is the number of the sketch."""
    keys = F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.col("sketch")[i]) for i in range(SKETCHES)])).alias("place", "key")
    each = sketches.select("node", keys)
    return each.join(each.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "key")


def _centres(members: DataFrame, weights: DataFrame) -> DataFrame:
    """key, centre: of each bucket the member of the largest weight."""
    return members.join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top")).select("key", F.col("top.node").alias("centre"))


def _in_blocks(rooted: DataFrame) -> DataFrame:
    """node, centre: members (key, node, root) of one part, each two once, that aren't in one class."""
    others = rooted.select("key", F.col("node").alias("centre"), F.col("root").alias("centre_root"))
    return rooted.select("key", "node", "root").join(others, "key").where((F.col("node") > F.col("centre")) & (F.col("root") != F.col("centre_root"))).select("node", "centre")


def _open_pairs(members: DataFrame, failed: DataFrame, centres: DataFrame, sketches: DataFrame, root: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(pairs, links), node and centre each, of the members of open buckets, those of a failed pair: pairs have to meet besides, links have and are near.

    Every two members of an open bucket that aren't in one class meet, in a pair or where links come from.
    """
    keys = members.join(centres, "key").join(failed, ["node", "centre"], "left_semi").select("key").distinct()
    opened = cut(members.join(keys, "key", "left_semi"))
    rooted = lambda rows, root=root: rows.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    pairs = _in_blocks(rooted(opened.where(F.col("size") <= BLOCK).select("key", "node")))
    wide = opened.where(F.col("size") > BLOCK).select("key", "node", "place", "size")
    if wide.isEmpty():
        return pairs.distinct(), None
    bags = cut(_bags(texts.join(wide.select("node").distinct(), "node", "left_semi")))
    full = lambda rows: _met(_dealt(rows).select("key", "node", "root", "block", "place").join(sketches, "node").join(bags, "node"))
    early = _early(rooted(wide.where(F.col("size") > WIDE).select("node").distinct()), sketches, full)
    rows = rooted(wide, root if early is None else merge_roots(root, early))
    mixed = rows.groupBy("key").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("key")
    links = full(rows.join(mixed, "key", "left_semi"))
    return pairs.distinct(), cut((links if early is None else links.union(early)).distinct())


def _early(large: DataFrame, sketches: DataFrame, full: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """Links between nodes (with root) of very large buckets that agree in several sketches at once: what these join doesn't have to meet again."""
    if large.isEmpty():
        return None
    large, links = cut(large.join(sketches, "node")), None
    for level in LEVELS:
        keyed = large.mapInArrow(_combined(level), "node binary, root binary, key long")
        parts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), (F.min("root") != F.max("root")).alias("mixed")).where("size > 1 and mixed")
        rows = cut(keyed.join(parts.select("key", "size"), "key").withColumn("place", F.lit(ANY)))
        found = full(rows.where(F.col("size") <= WIDE))
        links = found if links is None else links.union(found)
        large = cut(large.join(rows.where(F.col("size") > WIDE).select("node").distinct(), "node", "left_semi"))
        if large.isEmpty():
            break
    return cut(links.distinct())


def _bags(texts: DataFrame) -> DataFrame:
    """node, text, bag: how many words of the text have each of BAG hash values, as 16-bit integers (at most their largest value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.bincount((_codes(x.as_py()) % U(BAG)).astype(np.int64), minlength=BAG) for x in batch["text"]]
            bags = [np.minimum(x, 0xFFFF).astype("<u2").tobytes() for x in counts]
            yield pa.record_batch([batch["node"], batch["text"], pa.array(bags, pa.binary())], ["node", "text", "bag"])

    return texts.select("node", "text").mapInArrow(run, "node binary, text binary, bag binary")


def may_be_near(bags: np.ndarray, bag: np.ndarray, least: float = SIMILAR) -> np.ndarray:
    """Which rows of bags may belong to texts as similar to that of bag: an edit adds a word, takes one away, or does both, so edits are at least what either has more of."""
    diff = bags - bag
    more = np.maximum(diff, 0).sum(axis=1)
    fewer = more - diff.sum(axis=1)
    allowed = (1 - least) * np.maximum(bags.sum(axis=1), bag.sum()) + 1e-9
    full = (bags == 0xFFFF).any(axis=1) | (bag == 0xFFFF).any()  # counts that were cut say nothing about the length
    return (np.maximum(more, fewer) <= allowed) | full


ANY = -1  # the place of a part that isn't a bucket of one sketch


def _dealt(rows: DataFrame) -> DataFrame:
    """Members of parts with a block of each, once for every pair of blocks that theirs is in."""
    blocks = F.ceil(F.col("size") / SPAN).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).select("*", other)
    return rows.withColumn("key", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))


def _met(rows: DataFrame, least: float = SIMILAR) -> DataFrame:
    """node, centre: near members (key, place, node, root, block, sketch, text, bag) of one part, until they are joined; of two blocks, those of different ones."""

    def of_part(part: pa.Table) -> list[tuple[bytes, bytes]]:
        nodes, packed, place = part["node"].to_pylist(), part["text"], part["place"][0].as_py()
        root, block = part["root"].combine_chunks().dictionary_encode().indices.to_numpy().copy(), part["block"].to_numpy()
        sketch = np.array(part["sketch"].to_pylist(), np.int64)
        bags = np.frombuffer(b"".join(part["bag"].to_pylist()), "<u2").reshape(-1, BAG).astype(np.int32)
        apart = len(np.unique(block)) > 1
        held: dict[int, np.ndarray] = {}
        size, out = 0, []

        def codes(i: int) -> np.ndarray:
            nonlocal size
            if i not in held:
                if size > HELD:
                    held.clear()
                    size = 0
                held[i] = _codes(packed[i].as_py())
                size += held[i].nbytes
            return held[i]

        for i in range(len(nodes) - 1):
            meets = root[i + 1 :] != root[i]
            if apart:
                meets &= block[i + 1 :] != block[i]
            if place != ANY:
                meets &= (sketch[i] == sketch[i + 1 :]).argmax(axis=1) == place
            others = np.flatnonzero(meets) + i + 1
            for j in others[may_be_near(bags[others], bags[i], least)].tolist():
                if root[i] != root[j] and similarity(codes(i), codes(j), least) >= least:
                    out.append((max(nodes[i], nodes[j]), min(nodes[i], nodes[j])))
                    root[root == root[j]] = root[i]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in groups(batches, ["key"]):
            if part.num_rows > 1 and (two := of_part(part)):
                yield pa.record_batch([pa.array([x[k] for x in two], pa.binary()) for k in (0, 1)], ["node", "centre"])

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "node binary, centre binary")


def combinations_of(level: int) -> list[np.ndarray]:
    """So many random sets of level sketches that a pair with SIMILAR of its k-mers in common misses all with probability MISS."""
    hit = SIMILAR ** (PICK * level)  # a sketch agrees if all that it picks is common
    rng = np.random.default_rng(level)
    return [rng.choice(SKETCHES, level, replace=False) for _ in range(int(np.ceil(np.log(MISS) / np.log1p(-hit))))]


def _combined(level: int):
    """Rows (node, root, sketch) to node, root, key for each combination of sketches."""
    sets = combinations_of(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = np.array(batch["sketch"].to_pylist(), np.int64).reshape(-1, SKETCHES).view(U)
            for seed, places in zip(seeds(len(sets), level), sets, strict=True):
                code = np.full(len(sketch), seed, U)
                for p in places:
                    code = mix(code * U(BASE) + sketch[:, p])
                yield pa.record_batch([batch["node"], batch["root"], pa.array(signed(code))], ["node", "root", "key"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILAR) -> DataFrame:
    """pairs (node, centre) with a column near: whether their texts align to at least that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, U))
        for batch in batches:
            near = []
            for centre, mine, other in zip(batch["centre"].to_pylist(), batch["text"], batch["centre_text"], strict=True):
                if centre != last[0]:
                    last = (centre, _codes(other.as_py()))
                near.append(similarity(_codes(mine.as_py()), last[1], least) >= least)
            yield pa.record_batch([batch["node"], batch["centre"], pa.array(near, pa.bool_())], ["node", "centre", "near"])

    both = pairs.join(texts, "node").join(texts.select(F.col("node").alias("centre"), F.col("text").alias("centre_text")), "centre")
    return both.select("node", "centre", "text", "centre_text").mapInArrow(run, "node binary, centre binary, near boolean")


def _codes(packed: bytes) -> np.ndarray:
    data = np.frombuffer(zlib.decompress(packed), np.uint8)
    return split(data, np.array([0, len(data)], np.int64)).hash


def contract(links: DataFrame, count: int) -> DataFrame:
    """Connected components of links (node, centre): node, root (its least member).

    Each round every node points to its least neighbour, pointers are doubled JUMPS times, and the
    links between what they reach are drawn anew. Nodes are digests, so chains of descending ones
    are short and rounds are few and shrink. count bounds the number of links, and sets how many
    tasks and files a round has.
    """
    few = lambda df: df.coalesce(max(2, -(-2 * count // ROWS_A_FILE)))
    both = links.select("node", F.col("centre").alias("other")).union(links.select(F.col("centre").alias("node"), F.col("node").alias("other")))
    edges, root = cut(few(few(both.where("node <> other")).distinct())), None
    while True:
        jump = few(edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("to")))
        for _ in range(JUMPS):
            jump = few(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("up")), "to")).select("node", F.col("up").alias("to"))
        jump = cut(jump)
        if root is None:
            root = jump.withColumnRenamed("to", "root")
        else:
            root = few(root.join(jump.withColumnsRenamed({"node": "root", "to": "up"}), "root", "left")).select("node", F.coalesce("up", "root").alias("root"))
        ends = few(edges.join(jump, "node")).select("other", F.col("to").alias("node"))
        ends = few(ends.join(jump.withColumnsRenamed({"node": "other", "to": "up"}), "other")).select("node", F.col("up").alias("other"))
        edges = cut(few(ends.where("node <> other").distinct()))
        if edges.isEmpty():
            return cut(root)


def merge_roots(root: DataFrame, links: DataFrame) -> DataFrame:
    """root after further links: only the classes that these join are contracted again."""
    of = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    ends = links.join(of("node"), "node", "left").join(of("centre"), "centre", "left")
    between = cut(ends.select(F.coalesce("node_root", "node").alias("node"), F.coalesce("centre_root", "centre").alias("centre")).where("node <> centre").distinct(), 2)
    count = between.count()
    if not count:
        return root
    joined = contract(between, count)
    moved = root.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return cut(moved.union(joined.join(root, "node", "left_anti").select("node", "root")), 2 * count)


def near_classes(docs: DataFrame, least: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): node with n, least_id and root (null where it has no link) of every distinct text; and the near pairs of a text and a bucket's centre."""
    small_batches(docs.sparkSession)
    ids = cut(docs.select("doc_id", _node()).groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")))
    sketches = cut(sketched(docs).dropDuplicates(["node"]))
    members = cut(_buckets(sketches))
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    centres = cut(_centres(members, weights))
    pairs = cut(members.select("key", "node").join(centres, "key").where("node <> centre").select("node", "centre").distinct())
    count = pairs.count()
    if not count:
        nodes = ids.withColumn("root", F.lit(None).cast("binary"))
        return nodes, nodes.where("false").select("node", F.col("root").alias("centre"))
    wanted = members.select("node").distinct().join(ids, "node").select("node", F.coalesce(F.col("least_id").cast("string"), F.lit("")).alias("_id"))
    keys = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id")
    texts = cut(packed(docs.select(keys, _node(), text_of().alias("text"))).join(wanted, ["_id", "node"]).dropDuplicates(["_id", "node"]).select("node", "text"))
    done = cut(verified(pairs, texts, least))
    root = contract(done.where("near").select("node", "centre"), count)
    failed = done.where("not near").select("node", "centre")
    if not failed.isEmpty():
        more, links = _open_pairs(members, failed, centres, sketches, root, texts)
        both = done.select("node", "centre").union(done.select(F.col("centre").alias("node"), F.col("node").alias("centre")))
        more = cut(more.join(both, ["node", "centre"], "left_anti"))
        checked = cut(verified(more, texts, least)) if not more.isEmpty() else done.where("false")
        if links is not None:
            checked = checked.union(links.withColumn("near", F.lit(True)))
        root = merge_roots(root, checked.where("near").select("node", "centre"))
    return ids.join(root, "node", "left"), done.where("near").select("node", "centre")


def _named(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Linked nodes with the columns of their class, by root and a part of the nodes: one class may hold a third of them."""
    part = F.pmod(F.xxhash64("node"), F.lit(SPREAD)).alias("part")
    spread = classes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("part"))
    return nodes.where(F.col("root").isNotNull()).select("*", part).join(spread, ["root", "part"]).drop("part")


def near_dedup(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), class_size (rows), links, kept.

    links counts the verified pairs of its text and a bucket's centre; a text that only its bucket's other
    members join to the class has none. One row of each class stays: one with the least doc_id. Equal texts are in one class, empty and
    null ones too; a text without words is near only to equal ones. Where no row of a class has a
    doc_id, class_id is null and every such row of the least text stays; other columns are ignored;
    empty input gives no rows.
    """
    nodes, links = near_classes(docs, least)
    nodes = cut(nodes)
    classes = nodes.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("n").alias("class_size"))
    degree = links.select("node").union(links.select(F.col("centre").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    alone = nodes.where(F.col("root").isNull()).select("node", F.col("least_id").alias("class_id"), F.col("n").alias("class_size"), F.lit(0).cast("long").alias("links"))
    linked = _named(nodes, classes).join(degree, "node", "left").select("node", "class_id", "class_size", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    named = alone.unionByName(linked)
    return (
        docs.select("doc_id", _node())
        .join(named, "node")
        .select("doc_id", "class_id", "class_size", "links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
    )


def keep_distinct(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The documents without near copies of a kept one, with their columns: one row per class."""
    nodes = cut(near_classes(docs, least)[0])
    number, digest = fresh(docs, "_id", "_node")
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    first = F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "node")).alias("m")
    least_of = nodes.where(F.col("root").isNotNull()).groupBy("root").agg(first).select("m.node", "m.least_id")
    chosen = nodes.where(F.col("root").isNull()).select("node", "least_id").union(least_of).select(F.col("node").alias(digest), of("least_id").alias(number))
    keyed = docs.withColumns({digest: F.unhex(F.md5(text_of())), number: of("doc_id")})
    return keyed.join(chosen, [digest, number], "left_semi").dropDuplicates([digest, number]).drop(digest, number)
