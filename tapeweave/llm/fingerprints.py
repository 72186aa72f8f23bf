"""Document fingerprints: a digest of the quartile buckets of byte-triplet counts.

Every window of WINDOW bytes gives the six triplets that hold its first byte and two later ones; each
is hashed into one of BUCKETS buckets. A bucket's code says which quarter of the sorted counts its
count lies in. The fingerprint is, in hexadecimal: a checksum byte, the length on a logarithmic
scale, the two quartile ratios, then two bits per bucket. The difference of two fingerprints sums the
distances of codes (a whole half counts double), of lengths, of ratios and of checksums, each
bounded; likeness is 1 - difference / the largest difference.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.llm.common import cut, parts, small_batches, text_of

BUCKETS, WINDOW = 256, 5
MOST_LENGTH, MOST_RATIO = 48, 8  # bounds of the length and ratio differences
STEP = np.array([0, 1, 2, 6])  # distance of codes 0 to 3 apart
LARGEST = BUCKETS * 6 + MOST_LENGTH + 2 * MOST_RATIO + 1
PIECE = 1 << 18  # bytes counted at a time
HEAD = 4


def counts(data: np.ndarray) -> np.ndarray:
    """How many triplets of a text fall into each bucket."""
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(0, len(data) - 2), PIECE):
        x = data[at : at + PIECE + WINDOW - 1].astype(np.uint32)
        for salt, (i, j) in enumerate(combinations(range(1, WINDOW), 2)):
            n = min(PIECE, len(x) - j)
            if n > 0:
                h = (x[:n] * np.uint32(0x9E3779B1)) ^ (x[i : i + n] * np.uint32(0x85EBCA77)) ^ (x[j : j + n] * np.uint32(0xC2B2AE3D)) ^ np.uint32(salt * 0x27D4EB2F)
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                out += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return out


def fingerprint(text: bytes) -> str:
    """The digest of a text of any length; equal texts have equal ones."""
    data = np.frombuffer(text, np.uint8)
    c = counts(data)
    q1, q2, q3 = (int(x) for x in np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]])
    code = (c > q1).astype(np.uint8) + (c > q2) + (c > q3)
    length = min(255, int(round(16 * np.log2(len(data) + 1) / 2))) if len(data) else 0
    ratio = (min(15, q1 * 16 // (q3 + 1)), min(15, q2 * 16 // (q3 + 1)))
    check = hashlib.blake2b(text, digest_size=1).digest()[0]
    packed = np.packbits(np.unpackbits(code[:, None], axis=1)[:, 6:].ravel())
    return bytes([check, length, ratio[0], ratio[1]]).hex() + packed.tobytes().hex()


def _codes(packed: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(packed, axis=-1)
    return bits[..., 0::2] * 2 + bits[..., 1::2]


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """1 for equal fingerprints, down to 0, elementwise."""
    if not a:
        return np.zeros(0)
    x, y = (np.frombuffer(bytes.fromhex("".join(f)), np.uint8).reshape(len(f), -1).astype(np.int16) for f in (a, b))
    far = STEP[np.abs(_codes(x[:, HEAD:].astype(np.uint8)).astype(int) - _codes(y[:, HEAD:].astype(np.uint8)))].sum(1)
    head = np.abs(x[:, :HEAD] - y[:, :HEAD])
    far = far + np.minimum(head[:, 1], MOST_LENGTH) + np.minimum(head[:, 2], MOST_RATIO) + np.minimum(head[:, 3], MOST_RATIO) + (head[:, 0] > 0)
    return 1 - far / LARGEST


def edited(text: str, following: str) -> str:
    """The last third of text, in code points, replaced by as many first ones of following, or by all it has."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


SCHEMA = "edge string, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"


def _row(doc_id, text: str, mine: str, following: str | None, theirs: str | None) -> tuple:
    other = edited(text, following if following is not None else "")
    again = fingerprint(other.encode())
    near = likeness([mine, mine], [again, theirs if theirs is not None else mine])
    return (None, None, doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), mine, again, float(near[0]), float(near[1]), None)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range of doc_id, largest first: each with the one after it; the first and last texts go on for their neighbours."""
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(n, types[x.split(" ")[1]]) for n, x in zip(names, SCHEMA.split(", "), strict=True)])
    held: tuple | None = None
    part, out = 0, []
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
    edge = lambda kind, x: (kind, part, x[0], None, None, x[2], None, None, None, x[1])
    for batch in batches:
        for number, doc_id, value in zip(batch["part"], batch["doc_id"], batch["text"], strict=True):
            text = value.as_py()
            now = (doc_id.as_py(), text, fingerprint(text.encode()))
            if held is None:
                part = number.as_py()
                out.append(edge("first", now))
            else:
                out.append(_row(*held, now[1], now[2]))
            held = now
            if len(out) >= 1000:
                yield flush()
                out = []
    if held is not None:
        out.append(edge("last", held))
    if out:
        yield flush()


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_row(*x)[2:9] for x in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")), strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], OUT)


OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: OUT, for the whole text and for the text edited with the next document's.

    The next document is the one after it by descending doc_id, then by a hash of the text; after the
    last comes the first, so a lone document is its own next one. Rows without a doc_id come last.
    Null text counts as empty. One shuffle ranges the rows by doc_id; a range hands only its first
    and last text on.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(2 * parts(docs.sparkSession), *order).sortWithinPartitions(*order, "text")
    walked = cut(ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(_walk, SCHEMA))
    inner = walked.where("edge is null").select(OUT)
    first = walked.where("edge = 'first'").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    around = Window.orderBy("part")  # two small numbers for each range
    ends = walked.where("edge = 'last'").select("part", "doc_id", "text", "fingerprint")
    chain = first.select("part").withColumn("after", F.coalesce(F.lead("part").over(around), F.min("part").over(Window.partitionBy())))
    last = ends.join(chain, "part").join(first.withColumnRenamed("part", "after"), "after")
    return inner.unionByName(last.mapInArrow(_stitch, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"))
