"""Phrase collocations: frequent phrases of 2 to 4 words, found by Misra-Gries summaries and counted exactly.

First pass: every run of 1 to 4 words within a piece is hashed with its language, and the hash's top
bits choose one of a fixed number of hash partitions. A task counts what it reads and writes one
summary per partition: sorted codes and counts, and its mass (the occurrences in it). Summaries of a
partition merge by adding counts; where more than capacity counters are left, the next largest
count is subtracted from all. With a capacity above mass / threshold all subtractions together stay
below the threshold, so every phrase of that frequency survives, and what is left plus what was
subtracted bounds a count from above: the rest is dropped. The mass is known first, as the masses of
all tasks sort before their counters; a task holds capacity counters and one buffer.

Second pass: a Bloom filter of the survivors, at most FILTER bits whatever the input, lets the texts'
runs through that can be frequent. A task counts them and writes one row per hash partition and
language, and they are summed by their text, exactly. A full filter only lets more through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.llm.common import cut, parts, saved, small_batches, text_of
from tapeweave.llm.words import BASE, U, Words, mix, per_slice, seeds, spaced

LONGEST, LEAST, TOP, SHARE = 4, 30, 2000, 80
HELD = 2_000_000  # run occurrences, or merged counters, that a task of the first pass holds before it counts or writes them
BUFFER = 1_000_000  # counters that a merge takes in at a time
PHRASES = 300_000  # phrases that a task of the second pass holds
FILTER, BITS, PROBES = 1 << 30, 16, 2
SPREAD = 32

PIECE = np.zeros(256, bool)
PIECE[[10, 11, 12, 13, *b".,;:!?"]] = True
APART = PIECE.copy()
APART[[9, 32]] = True


def runs(w: Words, lang: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, first words, codes) of all runs of n words within a piece, n = 1 to LONGEST; lang: a number for each text."""
    size = len(w.hash)
    piece = np.cumsum(PIECE[w.data])[w.start] if size else np.zeros(0, np.int64)
    joined = np.zeros(size, bool)
    joined[:-1] = (piece[1:] == piece[:-1]) & (w.doc[1:] == w.doc[:-1])
    at, code, salt = np.arange(size), w.hash, seeds(LONGEST + 1)
    for n in range(1, LONGEST + 1):
        yield n, at, mix(code ^ (lang[w.doc[at]] + salt[n]))
        goes_on = joined[at + n - 1]
        at = at[goes_on]
        code = mix(code[goes_on] * U(BASE) + w.hash[at + n])


def _langs(column: pa.Array) -> np.ndarray:
    """A number for each row's language."""
    coded = column.dictionary_encode()
    numbers = np.array([xxhash.xxh64_intdigest(x, 7) for x in coded.dictionary.to_pylist()], U)
    return numbers[coded.indices.to_numpy(zero_copy_only=False)] if len(column) else numbers


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts[order], first) if len(codes) else counts


def _planes(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending 32-bit codes as steps, and counts, byte by byte of all of them: most upper bytes are zero and compress to nothing."""
    steps = np.diff(codes, prepend=codes.dtype.type(0))
    return np.stack([steps, counts.astype(np.uint32)]).view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1).tobytes()


def _entries(planes: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(2, 4, -1).transpose(0, 2, 1)).view(np.uint32)[..., 0]
    return np.cumsum(both[0], dtype=np.uint32), both[1].astype(np.int64)


def _summaries(bits: int):
    """Texts to rows part, kind, mass, cells: kind 1 has a summary's counters, kind 0, at the end, a part's mass in this task."""

    def rows(codes: np.ndarray, counts: np.ndarray, mass: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = (codes >> U(64 - bits)).astype(np.int64)
        low = (codes >> U(32 - bits)).astype(np.uint32)
        edges = np.searchsorted(part, np.arange((1 << bits) + 1))
        np.add.at(mass, part, counts)
        for at in range(0, 1 << bits, 256):
            some = [p for p in range(at, min(at + 256, 1 << bits)) if edges[p] < edges[p + 1]]
            cells = [_planes(low[edges[p] : edges[p + 1]], counts[edges[p] : edges[p + 1]]) for p in some]
            if some:
                yield pa.record_batch([pa.array(some, pa.int32()), pa.array([1] * len(some), pa.int32()), pa.array([0] * len(some), pa.int64()), pa.array(cells, pa.binary())], ["part", "kind", "mass", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(1 << bits, np.int64)
        raw, waiting, merged, kept = [], 0, [], 0
        for batch in batches:
            lang = _langs(batch["lang"])
            for row, w in per_slice(batch["text"], apart=APART):
                for _, _, codes in runs(w, lang[row:]):
                    raw.append(codes)
                    waiting += len(codes)
                if waiting >= HELD:
                    merged.append(np.unique(np.concatenate(raw), return_counts=True))
                    raw, waiting, kept = [], 0, kept + len(merged[-1][0])
                if kept >= HELD:
                    yield from rows(*summed(*map(np.concatenate, zip(*merged, strict=True))), mass)
                    merged, kept = [], 0
        if raw:
            merged.append(np.unique(np.concatenate(raw), return_counts=True))
        if merged:
            yield from rows(*summed(*map(np.concatenate, zip(*merged, strict=True))), mass)
        some = np.flatnonzero(mass)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(np.zeros(len(some)), pa.int32()), pa.array(mass[some]), pa.array([None] * len(some), pa.binary())], ["part", "kind", "mass", "cells"])

    return run


class Summary:
    """A Misra-Gries summary of 32-bit codes: counters and what was subtracted from all of them."""

    def __init__(self, mass: int, threshold: int):
        self.capacity, self.threshold, self.taken = mass // threshold + 1, threshold, 0
        self.codes, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting, self.size = [], 0

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((codes, counts))
        self.size += len(codes)
        if self.size >= max(BUFFER, self.capacity):
            self.merge()

    def merge(self) -> None:
        codes, counts = zip((self.codes, self.counts), *self.waiting, strict=True)
        self.codes, self.counts = summed(np.concatenate(codes), np.concatenate(counts))
        self.waiting, self.size = [], 0
        if len(self.codes) > self.capacity:
            less = np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1]
            left = self.counts > less
            self.codes, self.counts, self.taken = self.codes[left], self.counts[left] - less, self.taken + int(less)

    def survivors(self) -> np.ndarray:
        """All codes of at least threshold occurrences, and few others."""
        self.merge()
        return self.codes[self.counts + self.taken >= self.threshold]


def _survivors(threshold: int):
    """Sorted summaries to one row per part: part, n and its surviving codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary = None, 0, None

        def done() -> pa.RecordBatch:
            codes = summary.survivors()
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([len(codes)], pa.int64()), pa.array([codes.tobytes()], pa.binary())], ["part", "n", "codes"])

        for batch in batches:
            for p, kind, m, cells in zip(batch["part"].to_pylist(), batch["kind"].to_pylist(), batch["mass"].to_pylist(), batch["cells"], strict=True):
                if p != part:
                    if summary is not None:
                        yield done()
                    part, mass, summary = p, 0, None
                if kind == 0:
                    mass += m
                else:
                    summary = summary or Summary(mass, threshold)
                    summary.add(*_entries(cells.as_py()))
        if summary is not None:
            yield done()

    return run


def surviving(docs: DataFrame, threshold: int = LEAST) -> tuple[DataFrame, int]:
    """(part, n, codes: what may occur threshold times or more, one row per hash partition; bits of part). docs: lang, text, without nulls."""
    bits = min(16, max(6, (2 * parts(docs.sparkSession)).bit_length()))
    made = docs.select("lang", "text").mapInArrow(_summaries(bits), "part int, kind int, mass long, cells binary")
    return cut(made.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_survivors(threshold), "part int, n long, codes binary")), bits


def _slots(low: np.ndarray, width: int) -> list[np.ndarray]:
    """PROBES bit positions below width for each 32-bit code."""
    seed = mix(low.astype(U) * U(BASE))
    return [((mix(seed + U(i)) >> U(32)) * U(width) >> U(32)).astype(np.int64) for i in range(PROBES)]


def bloom(survivors: DataFrame, bits: int) -> np.ndarray:
    """A row of bits for each hash partition, together at most FILTER bits: what the driver gets and sends is bounded."""
    most = survivors.agg(F.max("n")).first()[0] or 0
    width = min(FILTER >> bits, 1 << max(10, int(most * BITS - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for codes in batch["codes"]:
                row = np.zeros(width, np.uint8)
                for slot in _slots(np.frombuffer(codes.as_py(), np.uint32), width):
                    row[slot] = 1
                rows.append(np.packbits(row).tobytes())
            yield pa.record_batch([batch["part"], pa.array(rows, pa.binary())], ["part", "bits"])

    table = np.zeros((1 << bits, width // 8), np.uint8)
    for r in survivors.select("part", "codes").mapInArrow(run, "part int, bits binary").toLocalIterator():
        table[r.part] = np.frombuffer(r.bits, np.uint8)
    return table


def _counted(shared, bits: int):
    """Texts to part, lang, phrases, counts: the runs that pass the filter, counted within the task, a row per part and language; the phrase '' has all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        width = table.shape[1] * 8
        number: dict[int, int] = {}  # the place of each code, ascending
        names: list[tuple[str, bytes]] = []
        counts = np.zeros(0, np.int64)
        words: dict[str, int] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            part = (np.fromiter(number, U, len(number)) >> U(64 - bits)).astype(np.int32)
            langs = [x[0] for x in names]
            coded = pa.array(langs, pa.string()).dictionary_encode().indices.to_numpy()
            order = np.lexsort((part, coded))
            edges = np.flatnonzero((np.diff(part[order], prepend=-1) != 0) | (np.diff(coded[order], prepend=-1) != 0)).tolist()
            for at in range(0, len(edges), 256):
                some = [order[a:b] for a, b in zip(edges[at : at + 256], [*edges[at + 1 : at + 256], *(edges[at + 256 : at + 257] or [len(order)])], strict=True)]
                yield packed([int(part[x[0]]) for x in some], [langs[x[0]] for x in some], [b"\n".join([names[i][1] for i in x.tolist()]) for x in some], [counts[x].tobytes() for x in some])

        for batch in batches:
            langs = batch["lang"].to_pylist()
            lang = _langs(batch["lang"])
            for row, w in per_slice(batch["text"], apart=APART):
                for d, size in enumerate(np.diff(w.first).tolist()):
                    words[langs[row + d]] = words.get(langs[row + d], 0) + size
                text, start = spaced(w)
                stop = start + w.end - w.start
                for n, first, codes in runs(w, lang[row:]):
                    part = (codes >> U(64 - bits)).astype(np.int64)
                    passes = np.ones(len(codes), bool)
                    for slot in _slots((codes >> U(32 - bits)).astype(np.uint32), width):
                        passes &= (table[part, slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)
                    distinct, at, times = np.unique(codes[passes], return_index=True, return_counts=True)
                    at = first[passes][at]
                    where = np.array([number.get(c, -1) for c in distinct.tolist()], np.int64)
                    for i in np.flatnonzero(where < 0).tolist():
                        where[i] = number[int(distinct[i])] = len(names)
                        names.append((langs[row + w.doc[at[i]]], text[start[at[i]] : stop[at[i] + n - 1]]))
                    if len(names) > len(counts):
                        counts = np.concatenate([counts, np.zeros(max(len(names), 1024), np.int64)])
                    counts[where] += times
                if len(names) >= PHRASES:
                    yield from rows()
                    number, names, counts = {}, [], np.zeros(0, np.int64)
        if names:
            yield from rows()
        if words:
            yield packed([-1] * len(words), list(words), [b""] * len(words), [np.int64(n).tobytes() for n in words.values()])

    def packed(part: list[int], langs: list[str], phrases: list[bytes], counts: list[bytes]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(part, pa.int32()), pa.array(langs, pa.string()), pa.array(phrases, pa.binary()), pa.array(counts, pa.binary())], ["part", "lang", "phrases", "counts"])

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed counts, sorted by language, to lang, phrase, count: a phrase has one row, or a few where more than PHRASES pass the filter."""
    last, held = None, {}

    def rows() -> Iterator[pa.RecordBatch]:
        names = list(held)
        for at in range(0, len(names), 50_000):
            some = names[at : at + 50_000]
            yield pa.record_batch([pa.array([last] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([held[x] for x in some], pa.int64())], ["lang", "phrase", "count"])

    for batch in batches:
        for lang, phrases, counts in zip(batch["lang"].to_pylist(), batch["phrases"], batch["counts"], strict=True):
            if held and (lang != last or len(held) >= PHRASES):
                yield from rows()
                held = {}
            last = lang
            for phrase, n in zip(phrases.as_py().split(b"\n"), np.frombuffer(counts.as_py(), np.int64).tolist(), strict=True):
                held[phrase] = held.get(phrase, 0) + n
    if held:
        yield from rows()


def frequent(docs: DataFrame, threshold: int = LEAST) -> DataFrame:
    """lang, phrase (words joined by a space), f: every run of 1 to LONGEST words with at least threshold occurrences; phrase '' has all words."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    survivors, bits = surviving(docs, threshold)
    shared = docs.sparkSession.sparkContext.broadcast(bloom(survivors, bits))
    counted = docs.mapInArrow(_counted(shared, bits), "part int, lang string, phrases binary, counts binary")
    united = counted.repartition("part", "lang").sortWithinPartitions("lang").mapInArrow(_united, "lang string, phrase string, count long")
    return saved(united.groupBy("lang", "phrase").agg(F.sum("count").alias("f")).where((F.col("f") >= threshold) | (F.col("phrase") == "")))


def _part(first: Column, size: Column) -> Column:
    return F.array_join(F.slice("words", first, size), " ")


def collocations(docs: DataFrame, threshold: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """Each language's first top phrases by score: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to 4 words with a >= threshold occurrences is scored at the cut that scores lowest,
    2000000 a / (l + r) rounded down, for l and r occurrences of what is before and after it; of equal
    cuts the first counts. A phrase goes if a longer one contains it and has at least share percent of
    its occurrences. n: all words of the language; null lang is und, null text is empty. Other columns
    are ignored; empty input gives no rows.
    """
    counts = frequent(docs, threshold)
    wide = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  products may pass 64 bits
    words = counts.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words")).where(F.size("words") > 1)
    cuts = words.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("before"), _part(F.col("k") + 1, F.size("words")).alias("after"))
    of = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(of("before", "l"), ["lang", "before"]).join(of("after", "r"), ["lang", "after"])
    cuts = cuts.withColumns({"_a": wide("a") * 2_000_000, "_sum": wide("l") + wide("r")}).withColumn("score", F.expr("_a div _sum"))
    lowest = F.min(F.struct("score", "k", "a", "l", "r")).alias("m")
    scored = cuts.groupBy("lang", "phrase").agg(lowest).select("lang", "phrase", "m.a", "m.l", "m.r", "m.score")
    inside = words.where(F.size("words") > 2).select("lang", "words", "a", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("size"))
    inside = inside.select("lang", "words", "a", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
    longer = inside.select("lang", _part(F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * share))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    some = best(left.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))), "lang", "_part")  # a language may hold most phrases
    ranked = best(some, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "score")
    total = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
