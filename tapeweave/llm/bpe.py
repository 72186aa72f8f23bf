"""Byte-level BPE encoding and decoding by a segment tree over the ranks of adjacent pairs.

A leaf holds (rank, position) of the pair that starts at a symbol; an inner node holds the least of
its two children, so the root is the leftmost pair of lowest rank. A merge changes three leaves at
most, each in as many steps as the tree is deep, until the root holds no pair. Words of up to WIDE
bytes are merged many at a time: row i of a matrix is the tree of word i. Longer ones get a tree of
their own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapeweave.llm.common import small_batches
from tapeweave.llm.words import slices

# Fixed values of this kind of vocabulary: white space as Unicode defines it, and the pattern of a pretoken.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
WIDE = 64
BLOCK = 4096  # words merged at a time
MEMO = 400_000  # words remembered per worker; only speed depends on it
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Vocabulary:
    """Ranks and ids of a tokenizer file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        back = {c: b for b, c in enumerate(byte_letters())}
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (max(*ids.values(), *added.values(), 0) + 1)
        for token, i in ids.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in added.items():
            self.bytes[i] = token.encode()
        self.size = len(self.bytes)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pair = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pairs, self.ranks = pair[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        self.byte_id = np.array([ids[c] for c in byte_letters()], np.int64)
        self.rank_of = dict(zip(pair.tolist(), range(len(merges)), strict=True))
        self.added = added
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pretoken = regex.compile(PATTERN)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; NONE for no merge or no symbol (-1)."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)


def merge_many(v: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Ids of words of at most WIDE bytes, as little-endian unsigned 32-bit integers."""
    n, width = len(words), max(2, 1 << (max(map(len, words)) - 1).bit_length())
    lengths = np.fromiter(map(len, words), np.int64, n)
    at = np.arange(width)
    inside = at < lengths[:, None]
    symbol = np.full((n, width + 1), -1, np.int64)  # the last column stands for "no symbol"
    symbol[:, :width][inside] = v.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    after = np.where(at + 1 < lengths[:, None], at + 1, width)
    after = np.concatenate([after, np.full((n, 1), width)], 1)
    before = np.concatenate([np.broadcast_to(np.where(at > 0, at - 1, width), (n, width)), np.full((n, 1), width)], 1).copy()
    tree = np.full((n, 2 * width), NONE)
    rows = np.arange(n)

    def leaf(row: np.ndarray, left: np.ndarray) -> np.ndarray:
        rank = v.rank(symbol[row, left], symbol[row, after[row, left]])
        return np.where(rank == NONE, NONE, rank * width + left)

    flat = np.repeat(rows, width)
    tree[:, width:] = leaf(flat, np.tile(at, n)).reshape(n, width)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2

    def update(row: np.ndarray, position: np.ndarray, value: np.ndarray) -> None:
        node = position + width
        tree[row, node] = value
        while node[0] > 1:
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    active = rows[tree[:, 1] != NONE]
    while len(active):
        root = tree[active, 1]
        rank, left = root // width, root % width
        right = after[active, left]
        beyond = after[active, right]
        symbol[active, left], symbol[active, right] = v.made[rank], -1
        after[active, left], before[active, beyond] = beyond, left
        update(active, right, np.full(len(active), NONE))
        update(active, left, leaf(active, left))
        ahead = before[active, left]
        has = ahead < width
        if has.any():
            update(active[has], ahead[has], leaf(active[has], ahead[has]))
        active = active[tree[active, 1] != NONE]
    kept = symbol[:, :width] >= 0
    ids = symbol[:, :width][kept].astype("<u4").tobytes()
    ends = np.cumsum(kept.sum(1)) * 4
    return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def merge_long(v: Vocabulary, word: bytes) -> bytes:
    """Ids of one word of any length, by the same tree in plain lists."""
    n = len(word)
    width = 1 << max(1, (n - 1).bit_length())
    symbol = v.byte_id[np.frombuffer(word, np.uint8)].tolist()
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    rank_of, size, made = v.rank_of, v.size, v.made.tolist()
    none = len(made) * width
    tree = [none] * (2 * width)

    def leaf(i: int) -> int:
        j = after[i]
        rank = rank_of.get(symbol[i] * size + symbol[j]) if j >= 0 else None
        return none if rank is None else rank * width + i

    def update(i: int, value: int) -> None:
        i += width
        tree[i] = value
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                break
            tree[i] = least

    tree[width : width + n] = map(leaf, range(n))
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    while (root := tree[1]) != none:
        rank, i = divmod(root, width)
        j = after[i]
        k = after[j]
        symbol[i], symbol[j], after[i] = made[rank], -1, k
        if k >= 0:
            before[k] = i
        update(j, none)
        update(i, leaf(i))
        if before[i] >= 0:
            update(before[i], leaf(before[i]))
    return np.array([s for s in symbol if s >= 0], "<u4").tobytes()


class Encoder:
    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.memo: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.memo) + len(words) > MEMO:
            self.memo.clear()
        by_width: dict[int, list[str]] = {}
        for w in words:
            size = len(w.encode())
            if size > WIDE:
                self.memo[w] = merge_long(self.v, w.encode())
            else:
                by_width.setdefault((size - 1).bit_length(), []).append(w)
        for group in by_width.values():
            for i in range(0, len(group), BLOCK):
                part = group[i : i + BLOCK]
                self.memo.update(zip(part, merge_many(self.v, [w.encode() for w in part]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; the strings of added tokens in a text become those tokens."""
        v = self.v
        pieces = [v.split.split(t) if v.split else [t] for t in texts]
        tokens = [[p if k % 2 else v.pretoken.findall(p) for k, p in enumerate(ps)] for ps in pieces]
        new = {w for ts in tokens for k, t in enumerate(ts) if k % 2 == 0 for w in t}
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
        self._learn(new - self.memo.keys())
        get = self.memo.__getitem__
        return [b"".join(v.added[t].to_bytes(4, "little") if k % 2 else b"".join(map(get, t)) for k, t in enumerate(ts)) for ts in tokens]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The encoder of a tokenizer file, one per worker process; by default the public byte_bpe_50k.json."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for row, n, data, offsets in slices(batch["text"], 1 << 21):
            raw = data.tobytes()
            yield batch.slice(row, n), [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _encoded(tool: Encoder, texts: list[str]) -> tuple[pa.Array, pa.Array, list[bytes]]:
    packed = tool.encode(texts)
    sizes = np.array([len(p) // 4 for p in packed], np.int64)
    flat = pa.array(np.frombuffer(b"".join(packed), "<i4"))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat), pa.array(sizes), packed


def encode(docs: DataFrame, path: str | None = None, names: tuple[str, ...] = ("ids", "n_tokens")) -> DataFrame:
    """docs with ids (array of int) and n_tokens. Null text counts as empty, which has no ids."""
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.ArrayType(T.IntegerType())), T.StructField(names[1], T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for part, texts in _texts(batches):
            ids, sizes, _ = _encoded(tool, texts)
            yield pa.record_batch([*part.columns, ids, sizes], [*part.schema.names, *names])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs without text, with ids, n_tokens and decoded (the text of the ids), in one pass through Python."""
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*rest, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for part, texts in _texts(batches):
            ids, sizes, packed = _encoded(tool, texts)
            decoded = pa.array([tool.decode(p) for p in packed], pa.string())
            yield pa.record_batch([*(part[f.name] for f in rest), ids, sizes, decoded], schema.names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str | None = None, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """tokens with the text of its ids; bytes that aren't UTF-8 become U+FFFD, null ids an empty text."""
    schema = T.StructType([*tokens.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            out = [tool.decode(b"" if x is None else np.asarray(x, "<u4").tobytes()) for x in (s.values.to_numpy() if s.is_valid else None for s in batch[ids])]
            yield pa.record_batch([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, name])

    return tokens.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256 (the ids decoded again, in UTF-8).

    Null text counts as empty; rows are neither joined nor dropped, so repeated rows repeat; other
    columns are ignored; empty input gives no rows.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        for part, texts in _texts(batches):
            packed = tool.encode(texts)
            columns = [part["doc_id"], pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([digest(p) for p in packed], pa.string()), pa.array([digest(tool.decode(p).encode()) for p in packed], pa.string())]
            yield pa.record_batch(columns, schema.names)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)
