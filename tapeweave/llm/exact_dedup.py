"""Exact dedup over a minimal perfect hash of the digests already seen.

The historical rows are reduced to distinct digests with the locator of each one's winner. Shards of
the digest space, sized by a count, each get a minimal perfect hash (levels of collision-free bit
positions; the rank of a set bit is the slot). A slot holds the whole digest and the winner's
locator. New rows, reduced to distinct digests as well, look up their slot and compare all 32 bytes:
equal is a repeat of history, anything else is a nonmember and is grouped on its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.llm.common import fresh, parts, text_of

LEVELS, GAMMA = 40, 2.0
SHARD = 100_000  # digests at most, about


class PerfectHash:
    """A minimal perfect hash over distinct 32-byte digests, given as an (n, 4) uint64 array."""

    def __init__(self, digests: np.ndarray):
        self.bits: list[np.ndarray] = []
        left = digests
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, int(GAMMA * len(left)))
            at = self._at(left, level, size)
            hits = np.bincount(at, minlength=size)
            self.bits.append(hits == 1)
            left = left[hits[at] != 1]
        self.rest = {d.tobytes(): i for i, d in enumerate(left)}
        self.ranks = [np.concatenate([[0], np.cumsum(b)]) for b in self.bits]
        self.base = np.concatenate([[0], np.cumsum([b.sum() for b in self.bits])]).astype(np.int64)
        self.size = int(self.base[-1]) + len(self.rest)

    @staticmethod
    def _at(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        x = digests[:, level % 4] + digests[:, (level + 1) % 4] * np.uint64(2 * level + 1)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return (x % np.uint64(size)).astype(np.int64)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 or any slot for one that isn't a member."""
        out = np.full(len(digests), -1, np.int64)
        open_ = np.arange(len(digests))
        for level, bits in enumerate(self.bits):
            at = self._at(digests[open_], level, len(bits))
            found = bits[at]
            out[open_[found]] = self.base[level] + self.ranks[level][at[found]]
            open_ = open_[~found]
        for i in open_ if self.rest else ():
            out[i] = self.base[-1] + self.rest.get(digests[i].tobytes(), -1 - self.base[-1])
        return out


def _array(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in column), np.uint64).reshape(-1, 4)


def _row(digest: list[bytes], winner, n, member: bool) -> pd.DataFrame:
    return pd.DataFrame({"digest": digest, "winner": pd.array(winner, dtype="Int64"), "n": pd.array(n, dtype="int64"), "member": member})


def look_up(_key, seen: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """One shard: index the history's digests, look the new ones up, and return every distinct digest once."""
    if not len(seen):
        return _row(list(new["asked"]), new["best"].astype("Int64"), new["rows"], False)
    history = _array(seen["digest"])
    index = PerfectHash(history)
    at = index.slots(history)
    held, locator, n = np.empty_like(history), np.empty(len(at), object), np.zeros(len(at), np.int64)
    held[at] = history
    locator[at] = [None if pd.isna(w) else int(w) for w in seen["winner"]]
    n[at] = seen["n"].to_numpy()
    outside = np.zeros(len(new), bool)
    if len(new):
        asked = _array(new["asked"])
        slot = index.slots(asked)
        member = (slot >= 0) & (held[slot] == asked).all(axis=1)
        for s, w, k in zip(slot[member], new["best"][member], new["rows"][member], strict=True):
            n[s] += k
            if not pd.isna(w) and (locator[s] is None or w > locator[s]):
                locator[s] = int(w)
        outside = ~member
    out = _row([x.tobytes() for x in held], list(locator), n, True)
    if outside.any():
        apart = new[outside]
        out = pd.concat([out, _row(list(apart["asked"]), apart["best"].astype("Int64"), apart["rows"], False)])
    return out


def digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.unhex(F.sha2(text_of(), 256)).alias("digest"))


def winners(history: DataFrame, batch: DataFrame) -> DataFrame:
    """Distinct digests of both inputs (doc_id, digest): digest, winner (largest doc_id), n (rows), member (was in history)."""
    reduce = lambda df: df.groupBy("digest").agg(F.max("doc_id").cast("long").alias("winner"), F.count(F.lit(1)).alias("n"))
    rows = history.count() + batch.count()
    shards = max(2 * parts(history.sparkSession), -(-rows // SHARD))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")
    seen = reduce(history).select(shard, "digest", "winner", "n").groupBy("shard")
    new = reduce(batch).select(shard, F.col("digest").alias("asked"), F.col("winner").alias("best"), F.col("n").alias("rows")).groupBy("shard")
    return seen.cogroup(new).applyInPandas(look_up, "digest binary, winner long, n long, member boolean")


def exact_dedup(docs: DataFrame, history_below: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, seen_before.

    Rows with doc_id below history_below (default: the middle of the id range) are the history that
    is indexed; the rest, and rows without a doc_id, are looked up. The largest doc_id of equal texts
    stays; of rows that also share the doc_id one stays. Null texts are empty; where no row of a
    group has a doc_id, keep_id is null and one row stays. Empty input gives no rows; other columns
    of the input are ignored.
    """
    rows = digests(docs)
    if history_below is None:
        low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
        history_below = 0 if low is None else (low + high) // 2
    old = F.coalesce(F.col("doc_id") < F.lit(history_below), F.lit(False))
    found = winners(rows.where(old), rows.where(~old))
    same = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy(F.lit(1)))
    return (
        rows.withColumn("copy", same)
        .join(found, "digest")
        .select(
            "doc_id",
            F.col("winner").alias("keep_id"),
            F.col("n").alias("group_size"),
            (F.col("doc_id").eqNullSafe(F.col("winner")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            F.col("member").alias("seen_before"),
        )
    )


def keep_distinct(docs: DataFrame) -> DataFrame:
    """The documents that exact_dedup keeps, whole and with their columns; text goes through one shuffle."""
    number, digest = fresh(docs, "_id", "_digest")
    of = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    kept = exact_dedup(docs).where("kept").select(of.alias(number), F.unhex("text_sha256").alias(digest))
    keyed = docs.withColumns({number: of, digest: F.unhex(F.sha2(text_of(), 256))})
    return keyed.join(kept, [number, digest], "left_semi").dropDuplicates([number, digest]).drop(number, digest)
