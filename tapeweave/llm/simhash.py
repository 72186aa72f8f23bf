"""SimHash near-duplicates by meeting in the middle.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's shingles. Two fingerprints at
most radius bits apart both lie within half of it from some value in between: so every distinct
fingerprint sends out its ball, all values within half the radius (65 of them for radius 2), and
what meets at a value is compared. For an odd radius the outer shell of the ball is one bit wider,
and meets inner members only. All inner members of a value are within the radius of each other, so
each is linked with the least of them, which costs a row per member and loses no link between
classes. Copies of a text share their fingerprint, so a group of copies sends out one ball.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeweave.llm.common import cut, parts, saved, small_batches, text_of
from tapeweave.llm.near_dedup import contract
from tapeweave.llm.words import per_slice, places, spaced

K, RADIUS, SEED = 3, 2, 42
HASHES = 1 << 16  # hashes whose bits are counted at a time


def _majority(digests: bytes, ends: np.ndarray) -> np.ndarray:
    """The majority of the 8-byte digests of each text; ends: how many digests there are up to each text's last."""
    ones = np.zeros((len(ends), 64), np.int64)
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    for at in range(0, len(rows), HASHES):
        part = rows[at : at + HASHES]
        text = np.searchsorted(ends, np.arange(at, at + len(part)), "right")
        first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        ones[text[first]] += np.add.reduceat(np.unpackbits(part, axis=1), first, axis=0, dtype=np.int64)
    counts = np.diff(ends, prepend=0)
    return np.packbits(2 * ones > counts[:, None], axis=1).view(">u8").ravel().astype(np.int64)


def fingerprint_column(texts: pa.Array, k: int = K) -> np.ndarray:
    """The fingerprints of texts, as signed 64-bit numbers; a text without words has 0."""
    out = []
    for _, w in per_slice(texts):
        text, start = spaced(w)
        sizes = np.diff(w.first)
        runs = np.where(sizes > 0, np.maximum(sizes - k + 1, 1), 0)
        first = np.repeat(w.first[:-1], runs) + places(runs)
        last = np.minimum(first + k, np.repeat(w.first[1:], runs)) - 1
        stop = start[last] + (w.end - w.start)[last]
        hashed = xxhash.xxh64_digest
        digests = b"".join([hashed(text[a:b], SEED) for a, b in zip(start[first].tolist(), stop.tolist(), strict=True)])
        out.append(_majority(digests, np.cumsum(runs)))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def simhashes(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id and fingerprint (long) of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch["doc_id"], pa.array(fingerprint_column(batch["text"], k))], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint long")


def ball(column: str, flips: int) -> F.Column:
    """All values within so many bits of a fingerprint, as an array of (value, far): far is the number of bits flipped."""
    masks = [(bits, n) for n in range(flips + 1) for bits in combinations(range(64), n)]
    values = [(sum(1 << b for b in bits) - (1 << 64 if 63 in bits else 0), n) for bits, n in masks]
    table = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(n).alias("far")) for m, n in values])
    return F.transform(table, lambda x: F.struct(F.col(column).bitwiseXOR(x["mask"]).alias("value"), x["far"].alias("far")))


def near_pairs(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """node, centre: verified pairs of distinct fingerprints at most radius bits apart, which join all that are.

    fingerprints has one column, node, without repeats. centre is the least inner member at a common value.
    """
    inner = radius // 2
    spread = fingerprints.repartition(parts(fingerprints.sparkSession))  # each row becomes a ball
    sent = spread.select("node", F.explode(ball("node", inner + radius % 2)).alias("b")).select("b.value", "b.far", "node")
    least = F.min(F.when(F.col("far") <= inner, F.col("node")))
    met = sent.groupBy("value").agg(least.alias("centre"), F.collect_list("node").alias("nodes")).where("centre is not null and size(nodes) > 1")
    pairs = met.select("centre", F.explode("nodes").alias("node")).where("node <> centre").select("node", "centre").distinct()
    return pairs.where(F.bit_count(F.col("node").bitwiseXOR(F.col("centre"))) <= radius)


def simhash_dedup(docs: DataFrame, radius: int = RADIUS, k: int = K) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id (least doc_id reachable over links), component_size (rows).

    Links join fingerprints at most radius bits apart. Null text counts as empty; texts without words
    have fingerprint zero and link like any other; a row without doc_id takes part, and a component
    without any doc_id has none. Other columns are ignored; empty input gives no rows.
    """
    small_batches(docs.sparkSession)
    of_docs = saved(simhashes(docs, k))
    nodes = cut(of_docs.groupBy(F.col("fingerprint").alias("node")).agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")))
    pairs = cut(near_pairs(nodes.select("node"), radius))
    count = pairs.count()
    root = contract(pairs, count) if count else pairs.select("node", F.col("centre").alias("root"))
    rooted = nodes.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("n").alias("component_size"))
    named = rooted.select("node", "root").join(classes, "root").select(F.col("node").alias("fingerprint"), "component_id", "component_size")
    joined = of_docs.join(named, "fingerprint")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", "component_size")
