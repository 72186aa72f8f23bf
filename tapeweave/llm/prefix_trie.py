"""Conversation prefix trie as a burst trie.

A turn's id is the digest of its role and text, and a conversation is the sequence of its turns'
ids, 16 bytes each, in one binary value: bytes order sequences, and a prefix is a substring. Equal
sequences are one row with a weight. All rows start in one container under the root. A container of
more than CAP distinct sequences bursts: what all of them share becomes trie heads (first and least
row tell how long that is), and the rows go on to containers by their next turn id. So a round of
bursts ends at a branching, however long the common stretch. What is left is sorted by container
and sequence and swept in one pass: a stack holds the nodes of the current path, and a node is
complete when the next sequence leaves it. Heads get the sums of what lies below them by one
grouping over the containers' tops.

A task holds the open path of one container and the finished children of its nodes; a conversation
is one row (20 bytes a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeweave.llm.common import cut, saved

CAP, LISTED, CHUNK = 256, 256, 50_000
WIDE = 16
EMPTY = hashlib.sha256(b"").hexdigest()
TURN = "array<struct<id:binary,bytes:int>>"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, path array<binary>"


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id and turns (id, bytes), in order of turn, null first, and of the id where turns tie; rows without conv_id belong to none."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").alias("turn"), digest.alias("id"), F.octet_length(text).alias("bytes")).alias("t"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["bytes"].alias("bytes"))).alias("turns"))


def sequences(lists: DataFrame) -> DataFrame:
    """Turn lists as conv_id, ids (binary) and sizes (bytes of each turn's text)."""
    ids = F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["id"])), ""))
    return lists.select("conv_id", ids.alias("ids"), F.col("turns.bytes").alias("sizes"))


def _sha(ids: Column) -> Column:
    return F.sha2(F.concat_ws(",", ids.cast("array<string>")), 256)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (key, conv_id) as key, first, text: at most CHUNK ids to a row."""
    key, ids = None, []

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["key", "first", "text"])

    for batch in batches:
        for k, i in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
            if ids and (k != key or len(ids) == CHUNK):
                yield row()
                ids = []
            key = k
            ids.append(i)
    if ids:
        yield row()


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and the SHA-256 of its texts, which come in order."""
    key, state = None, None
    done = lambda: pa.record_batch([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "sha"])
    for batch in batches:
        for k, text in zip(batch["key"].to_pylist(), batch["text"], strict=True):
            if state is not None and k == key:
                state.update(b",")
            else:
                if state is not None:
                    yield done()
                key, state = k, hashlib.sha256()
            state.update(text.as_py().encode())
    if state is not None:
        yield done()


def member_hashes(convs: DataFrame, distinct: DataFrame, listed: int = LISTED) -> DataFrame:
    """key, sha: the SHA-256 of the conv_ids of each sequence, ascending and comma-joined.

    Up to listed ids are a list. More are sorted and written out over all tasks; only the digest,
    which is sequential by definition, reads a sequence's finished chunks one after the other.
    """
    one = distinct.where("n = 1").select("key", F.sha2(F.col("least").cast("string"), 256).alias("sha"))
    few = convs.join(distinct.where(F.col("n").between(2, listed)).select("key"), "key").groupBy("key").agg(_sha(F.sort_array(F.collect_list("conv_id"))).alias("sha"))
    large = distinct.where(F.col("n") > listed).select("key")
    if large.isEmpty():
        return one.union(few)
    ordered = convs.join(large, "key").select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = ordered.mapInArrow(_packed, "key binary, first long, text string")
    many = chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_streamed, "key binary, sha string")
    return one.union(few).union(many)


def _common(a: Column, b: Column) -> Column:
    """How many ids two sequences share at their start."""
    most = F.least(F.octet_length(a), F.octet_length(b)) / F.lit(WIDE)
    unit = lambda x, i: F.substring(x, i * F.lit(WIDE) + 1, F.lit(WIDE))
    differs = F.filter(F.sequence(F.lit(0), F.greatest(most.cast("int") - 1, F.lit(0))), lambda i: unit(a, i) != unit(b, i))
    return F.when(most < 1, 0).otherwise(F.coalesce(F.try_element_at(differs, F.lit(1)), most.cast("int")))


def burst(rows: DataFrame, cap: int = CAP) -> tuple[DataFrame, DataFrame | None]:
    """(rows with their container, heads).

    rows: ids, sizes, n, least, sha. Containers add at (depth of their top), head (digest of what they
    share), path (heads above, from the root) and up (least conv_id of the head above). A head is a
    stretch of nodes with the same members, from depth at to last.
    """
    active = rows.withColumns({"at": F.lit(0), "path": F.array().cast("array<binary>"), "up": F.lit(None).cast("bigint")})
    done, heads = None, None
    while True:
        active = cut(active.withColumn("head", F.unhex(F.md5(F.substring("ids", F.lit(1), F.col("at") * WIDE)))))
        first, last = F.min(F.struct("ids", "sizes", "sha")).alias("lo"), F.max("ids").alias("hi")
        groups = active.groupBy("head").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.any_value("at").alias("at"), F.any_value("path").alias("path"), F.any_value("up").alias("up"), first, last)
        full = cut(groups.where(F.col("rows") > cap).withColumn("last", _common(F.col("lo.ids"), F.col("hi"))))
        if full.isEmpty():
            return (active if done is None else done.unionByName(active)), heads
        kept = active.join(full.select("head"), "head", "left_anti")
        done = kept if done is None else done.unionByName(kept)
        heads = full if heads is None else heads.unionByName(full)
        moving = active.drop("up").join(full.select("head", "last", F.col("conv_id").alias("up")), "head").where(F.octet_length("ids") > F.col("last") * WIDE)
        active = moving.select("ids", "sizes", "n", "least", "sha", (F.col("last") + 1).alias("at"), F.array_append("path", F.col("head")).alias("path"), "up")


class _Node:
    def __init__(self, depth: int, size: int):
        self.depth, self.size = depth, size
        self.least, self.n, self.leaves, self.saved, self.sha = None, 0, 0, 0, EMPTY
        self.children: list[tuple] = []


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of sorted containers, each when the sequences have left it; a child's row waits for its parent's least conv_id."""
    names = [x.split(" ")[0] for x in NODE.split(", ")]
    out: list[tuple] = []
    stack: list[_Node] = []
    held: tuple = ()  # head, ids, path and up of the open container

    def close() -> None:
        node = stack.pop()
        count = len(node.children)
        out.extend((c[0], c[1], node.least, *c[2:], None) for c in node.children)
        node.leaves, node.saved = node.leaves or 1, node.saved + (node.n - 1) * node.size
        row = (node.least, node.depth, node.n, count, node.leaves, node.saved, node.sha)
        if not stack:
            out.append((row[0], row[1], held[3], *row[2:], held[2]))
            return
        above = stack[-1]
        above.children.append(row)
        above.least, above.n = min(above.least, node.least) if above.least is not None else node.least, above.n + node.n
        above.leaves, above.saved = above.leaves + node.leaves, above.saved + node.saved

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.binary())]
        made = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
        out.clear()
        return made

    for part in batches:
        for head, ids, sizes, at, n, least, sha, path, up in zip(*(part[c].to_pylist() for c in ("head", "ids", "sizes", "at", "n", "least", "sha", "path", "up")), strict=True):
            if not held or held[0] != head:
                while stack:
                    close()
                shared = at - 1
            else:
                shared, before = at, held[1]
                while shared < len(sizes) and ids[shared * WIDE : (shared + 1) * WIDE] == before[shared * WIDE : (shared + 1) * WIDE]:
                    shared += 1
                while stack[-1].depth > shared:
                    close()
            held = (head, ids, path, up)
            stack.extend(_Node(d, sizes[d - 1] if d else 0) for d in range(shared + 1, len(sizes) + 1))
            top = stack[-1]
            top.n, top.sha = top.n + n, sha
            top.least = least if top.least is None else min(top.least, least)
            if len(out) >= 4096:
                yield batch()
    while stack:
        close()
    if out:
        yield batch()


def prefix_trie(convs: DataFrame, cap: int = CAP, listed: int = LISTED) -> DataFrame:
    """The trie of sequences (conv_id, ids, sizes; one row per conversation): a row per node.

    conv_id (least member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, (n_convs - 1) times the bytes of a node's last text), ends_sha256
    (of the members that end there). Conversations without turns are members of the root; no
    conversations, no rows.
    """
    convs = saved(convs.withColumn("key", F.unhex(F.md5("ids"))))
    distinct = saved(convs.groupBy("ids").agg(F.any_value("key").alias("key"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.any_value("sizes").alias("sizes")))
    rows = distinct.join(member_hashes(convs.select("key", "conv_id"), distinct.select("key", "n", "least"), listed), "key").drop("key")
    contained, heads = burst(rows, cap)
    nodes = contained.repartition("head").sortWithinPartitions("head", "ids").mapInArrow(_swept, NODE)
    if heads is None:
        return nodes.drop("path")
    nodes = saved(nodes)
    size = lambda x, to: F.aggregate(F.slice(F.col("lo.sizes"), F.greatest(x, F.lit(1)), to - F.greatest(x, F.lit(1)) + 1), F.lit(0).cast("bigint"), lambda a, b: a + b)
    own = lambda x: (F.col("n_convs") - 1) * size(x, F.col("last"))
    tops = nodes.where("path is not null").select("path", "n_leaves", "saved_tokens").union(heads.select("path", F.lit(0).cast("bigint"), own(F.col("at"))))
    above = tops.select("n_leaves", "saved_tokens", F.size("path").alias("deep"), F.posexplode("path").alias("i", "head"))
    below = above.groupBy("head").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"), F.count_if(F.col("i") == F.col("deep") - 1).alias("n_children"))
    each = heads.join(below, "head").select("*", F.explode(F.sequence("at", "last")).alias("depth"))
    ends = (F.col("depth") == F.col("last")) & (F.octet_length("lo.ids") == F.col("last") * WIDE)
    stretch = each.select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), F.when(F.col("depth") == F.col("at"), F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("depth") == F.col("last"), F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", (F.col("below") + own(F.col("depth"))).alias("saved_tokens"), F.when(ends, F.col("lo.sha")).otherwise(EMPTY).alias("ends_sha256"),
    )
    return nodes.drop("path").union(stretch)


def rebuilt(lists: DataFrame, stride: int = 5, most: int = 9) -> DataFrame:
    """Turn lists in which c starts with the first crc32(c) % most turns of conversation c - c % stride, followed by its own turns after as many."""
    donors = lists.where(F.col("conv_id") % stride == 0).select(F.col("conv_id").alias("donor"), F.slice("turns", 1, most - 1).alias("lent"))
    rows = lists.withColumns({"donor": F.col("conv_id") - F.col("conv_id") % stride, "h": (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")})
    rows = rows.join(donors, "donor", "left").withColumn("lent", F.coalesce("lent", F.array().cast(TURN)))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return rows.select("conv_id", F.concat(F.slice("lent", F.lit(1), F.col("h")), own).alias("turns"))


def conversation_trie(conversations: DataFrame, cap: int = CAP) -> DataFrame:
    """prefix_trie of the rebuilt conversations (conv_id, turn, role, text); null role and text count as empty, other columns are ignored."""
    return prefix_trie(sequences(rebuilt(turn_lists(conversations))), cap)
