"""Quality scores from preference pairs: Bradley-Terry with a linear score of text features.

A document labelled 1 is preferred to one labelled 0. The probability of a preference is the logistic
function of the difference of two scores; weights minimise the logistic loss over sampled pairs. A
quantile of the training scores becomes the zero point, so that the published score, the logistic
function of what is left, is at least 0.5 exactly above it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeweave.llm.common import fresh, small_batches, text_of
from tapeweave.llm.words import slices, split

FIT_ROWS = 20_000  # labelled rows that a fit uses at most; the only bound here
PAIRS = 200_000
SIDES = 12  # byte classes
_CLASS = np.full(256, 10, np.uint8)  # other punctuation
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"'\"()-", b"#$%&*+=@^~\\/_", b"<>[]{}|")):
    _CLASS[list(_set)] = _i
_CLASS[128:] = 11
N_FEATURES = SIDES * SIDES + 12


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, N_FEATURES): shares of adjacent byte classes, and word, line and repetition measures. An empty text gives zeros."""
    w = split(data, offsets)
    n, size = w.n, len(data)
    out = np.zeros((n, N_FEATURES))
    if not size:
        return out
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(n), lengths)
    kind = _CLASS[data].astype(np.int64)
    inside = doc[1:] == doc[:-1]
    pairs = np.bincount((doc[1:] * SIDES * SIDES + kind[:-1] * SIDES + kind[1:])[inside], minlength=n * SIDES * SIDES)
    per = lambda top, under: np.divide(top, under, out=np.zeros(n), where=under > 0)
    out[:, : SIDES * SIDES] = pairs.reshape(n, -1) / np.maximum(lengths - 1, 1)[:, None]
    words = np.diff(w.first).astype(float)
    length = (w.end - w.start).astype(float)
    count = lambda mask: np.bincount(w.doc[mask], minlength=n).astype(float)
    last, head = kind[w.end - 1], kind[w.start]
    lines = np.bincount(doc[data == 10], minlength=n).astype(float) + (lengths > 0)
    new_word = lambda code: _distinct(code, w.doc, n)
    code, owner, first = w.shingles(5)
    more = (
        np.log1p(words), per(np.bincount(w.doc, weights=length, minlength=n), words), per(np.bincount(w.doc, weights=length**2, minlength=n), words) / 100,
        per(count(np.isin(last, (6, 8, 9, 10))), words), per(count(head == 1), words), per(count(length <= 3), words), per(count(length >= 15), words),
        per(new_word(w.hash), words), per(_distinct(code, owner, n), np.diff(first).astype(float)), per(lines, words), per(count((length == 1) & (last > 2) & (last < 11)), words), (words > 0).astype(float),
    )
    out[:, SIDES * SIDES :] = np.stack(more, 1)
    return out


def _distinct(code: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((code, doc))
    c, d = code[order], doc[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=n).astype(float)


@dataclass
class Model:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    zero: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights - self.zero
        return 1 / (1 + np.exp(-z.clip(-30, 30)))


def fit(x: np.ndarray, good: np.ndarray, seed: int = 17, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Weights by logistic loss on feature differences of sampled pairs; the zero point by score quantile."""
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    x = ((x - mean) / scale).clip(-8, 8)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    w = np.zeros(x.shape[1])
    if not len(up) or not len(down):
        return Model(w, mean, scale, -1.0 if len(up) or not len(down) else 1.0)
    rng = np.random.default_rng(seed)
    better, worse = rng.choice(up, PAIRS), rng.choice(down, PAIRS)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        at = rng.integers(0, PAIRS, 2048)
        diff = x[better[at]] - x[worse[at]]
        lost = 1 / (1 + np.exp((diff @ w).clip(-30, 30)))
        g = decay * w - diff.T @ lost / len(at)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    s = x @ w
    quantiles = np.quantile(s, np.linspace(0, 1, 1001))
    right = [(s[up] >= q).sum() + (s[down] < q).sum() for q in quantiles]
    best = np.flatnonzero(np.equal(right, max(right)))
    return Model(w, mean, scale, float((quantiles[best[0]] + quantiles[best[-1]]) / 2))


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3 is 1; false for a row without a doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, n, data, offsets in slices(batch["text"]):
            x = features(data, offsets)
            yield pa.record_batch([batch["quality"].slice(row, n), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))], ["quality", "x"])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most fit_rows labelled rows that aren't held out, chosen by a hash of doc_id.

    Rows without a label or a doc_id are not used; of several labels of one doc_id each counts.
    """
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    chosen = chosen.orderBy(F.xxhash64(F.lit(17), "doc_id"), "quality").limit(fit_rows)  # bounded, so the broadcast is too
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "quality")
    got = rows.mapInArrow(_features_of, "quality int, x array<double>").toArrow()
    x = np.asarray(got["x"].combine_chunks().flatten()).reshape(-1, N_FEATURES) if got.num_rows else np.zeros((0, N_FEATURES))
    y = got["quality"].to_numpy() == 1
    order = np.lexsort((*x.T[:3], y)) if len(x) else []  # the same model whatever order the rows came in
    return fit(x[order], y[order])


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column name, 0 to 1; null and empty texts are scored as well."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(features(data, offsets)) for _, _, data, offsets in slices(batch["text"])]
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], [*columns, name])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    The score depends on the text alone; equal texts, null and empty alike, score the same. Repeated
    rows are repeated; other columns are ignored. Without labels of both kinds the score is constant.
    """
    out = scored(docs.select("doc_id", "text"), train(docs, labels, fit_rows))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents with a score of at least 0.5, with their columns."""
    (name,) = fresh(docs, "score")
    return scored(docs, train(docs, labels, fit_rows), name).where(F.col(name) >= 0.5).drop(name)
