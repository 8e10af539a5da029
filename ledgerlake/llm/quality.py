"""Document quality by regularised quadratic discriminant analysis (operator 5).

Every document becomes a short vector of transformed statistics (lengths, byte
classes, repetition, vocabulary); labels, language, source and ids are no
inputs.  Each class has a mean and a covariance, shrunk towards the pooled
covariance and then towards its scaled identity; the score is the logistic of
the difference of the two Gaussian log densities (Mahalanobis distances by
cached Cholesky factors) and log priors.

Scale: every text is read once, into a vector that is kept; labels meet the
vectors, and scores are made from the same vectors.  Fitting needs only counts,
sums and products of the labelled vectors, added up per partition and then over
partitions, so all labelled rows take part and a few hundred numbers per class
reach the driver.  Only vectors are shuffled to meet their labels, never texts.

Defined results: a null text is empty and scored like one; rows without a
label, or with a null one, are not learned from; repeated label rows count
once; without both classes every score is the labelled share of class 1 (0.5
without labels); an empty table gives an empty table; other columns are
carried, and those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .frames import carried, restored, settle
from .words import slices, words_of
from .workers import lean

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "upper", "digits", "stops", "symbols", "bangs", "lines",
    "distinct_words", "top_word", "same_as_last", "distinct_pairs", "ends_odd", "entropy", "wide",
)
_CLASS = np.full(256, 8, np.uint8)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:?'\"-()", "!", "\n\r", " \t\v\f")):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[0x80:] = 7


def features(array: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    w = words_of(array)
    n, at, m = len(w.first) - 1, w.first, len(w.hashes)
    offsets = np.diff(_ends(array))
    owner_byte = np.repeat(np.arange(n, dtype=np.int32) * 9, offsets)
    kinds = np.bincount(owner_byte + _CLASS[w.raw], minlength=9 * n).reshape(n, 9).astype(float)
    size, words = offsets.astype(float), w.counts.astype(float)
    one, some = np.maximum(size, 1), np.maximum(words, 1)
    owner, long_ = w.owner(), (w.ends - w.starts).astype(float)
    mean = np.bincount(owner, long_, n) / some
    var = np.maximum(np.bincount(owner, long_ * long_, n) / some - mean * mean, 0)
    order = np.lexsort((w.hashes, owner))
    h, o = w.hashes[order], owner[order]
    new = np.ones(m, bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    run = np.diff(np.append(np.flatnonzero(new), m))
    top = np.zeros(n)
    np.maximum.at(top, o[new], run)
    distinct = np.bincount(o[new], minlength=n)
    same = np.zeros(m)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (owner[1:] == owner[:-1])
    pairs = w.grams(2)[w.whole(2)]
    po = owner[w.whole(2)]
    porder = np.lexsort((pairs, po))
    ph, po = pairs[porder], po[porder]
    pnew = np.ones(len(ph), bool)
    pnew[1:] = (ph[1:] != ph[:-1]) | (po[1:] != po[:-1])
    last = _CLASS[w.raw[w.ends - 1]] if m else np.zeros(0, np.uint8)
    odd = np.bincount(owner, (last == 8) | (last == 4), n)
    letters = kinds[:, 0] + kinds[:, 1]
    share = kinds / one[:, None]
    entropy = -np.sum(np.where(share > 0, share * np.log(np.maximum(share, 1e-12)), 0), 1)
    root = np.sqrt
    return np.stack([
        np.log1p(size), np.log1p(words), np.log1p(mean), root(var) / np.maximum(mean, 1), root(kinds[:, 0] / np.maximum(letters, 1)), root(share[:, 2]), root(share[:, 3]), root(share[:, 8]), root(share[:, 4]), root(kinds[:, 5] / some),
        distinct / some, root(top / some), root(np.bincount(owner, same, n) / some), np.bincount(po[pnew], minlength=n) / np.maximum(words - 1, 1), root(odd / some), entropy, root(share[:, 7]),
    ], 1)


def _ends(array: pa.Array) -> np.ndarray:
    from .words import text_bytes

    return text_bytes(array)[1]


@dataclass
class Model:
    """Standardisation, class means, inverse Cholesky factors, log determinants and log priors."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    logdet: np.ndarray
    logprior: np.ndarray
    flat: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        z = (x - self.centre) / self.scale
        logs = [self.logprior[k] - 0.5 * (((z - self.means[k]) @ self.whiten[k].T) ** 2).sum(1) - 0.5 * self.logdet[k] for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def discriminant(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, pooled: float = 0.8, identity: float = 0.02) -> Model:
    """The model from each class's count, sum and sum of outer products."""
    p = sums.shape[1]
    blank = np.zeros((2, p, p))
    if (counts < 2).any():
        total = counts.sum()
        return Model(np.zeros(p), np.ones(p), sums * 0, blank, np.zeros(2), np.zeros(2), float(counts[1] / total) if total else 0.5)
    n = counts.sum()
    centre = sums.sum(0) / n
    whole = products.sum(0) / n - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(whole), 1e-9))
    means = (sums / counts[:, None] - centre) / scale
    own = np.stack([(products[k] / counts[k] - np.outer(sums[k], sums[k]) / counts[k] ** 2) / np.outer(scale, scale) for k in (0, 1)])
    shared = (own * (counts / n)[:, None, None]).sum(0)
    covariance = (1 - pooled) * own + pooled * shared
    covariance = (1 - identity) * covariance + identity * np.stack([np.eye(p) * max(np.trace(c) / p, 1e-6) for c in covariance])
    factor = np.linalg.cholesky(covariance)
    return Model(centre, scale, means, np.linalg.inv(factor), 2 * np.log(np.diagonal(factor, axis1=1, axis2=2)).sum(1), np.log(counts / n))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batch with one more column: the texts' vectors."""
    for whole in batches:
        for batch in slices(whole, 0):
            x = features(batch.column(0))
            x = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, x], [*batch.schema.names, "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p = len(FEATURES)
    total = np.zeros((2, 1 + p + p * p))
    for batch in batches:
        x = _matrix(batch.column(0))
        y = batch.column(1).to_numpy(zero_copy_only=False)
        for k in (0, 1):
            own = x[y == k]
            total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    k, i = np.divmod(np.arange(total.size), total.shape[1])
    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(i), pa.array(total.ravel())], ["k", "i", "v"])


def _learned(vectors: DataFrame, labels: DataFrame, label_id: str, label_col: str, held_out: int | None) -> Model:
    """From rows (d, x) and their labels."""
    ship(labels.sparkSession)
    known = labels.select(F.col(f"`{label_id}`").alias("d"), F.col(f"`{label_col}`").cast("int").alias("y")).where("d is not null and y in (0, 1)").distinct()
    if held_out:
        known, vectors = (df.where(F.crc32(F.col("d").cast("string")) % held_out != 0) for df in (known, vectors))
    parts = vectors.join(known, "d").select("x", "y").mapInArrow(lean(_moments), "k long, i long, v double")
    p = len(FEATURES)
    total = np.zeros((2, 1 + p + p * p))
    for r in parts.groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
        total[r["k"], r["i"]] = r["v"]
    return discriminant(total[:, 0], total[:, 1 : 1 + p], total[:, 1 + p :].reshape(2, p, p))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int | None = 5) -> Model:
    """Learn from labelled rows; with ``held_out``, not from ids whose crc32 (as text) it divides."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{text_col}`").alias("t"), F.col(f"`{id_col}`").alias("d")).where("d is not null")
    vectors = rows.mapInArrow(lean(_vectors), f"t string, d {rows.schema['d'].dataType.simpleString()}, x array<double>").select("d", "x")
    return _learned(vectors, labels, id_col, label_col, held_out)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(_matrix(batch.column(batch.num_columns - 1))), pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def _with_scores(vectors: DataFrame, model: Model, columns: list[str], made: dict, threshold: float) -> DataFrame:
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name != "x")
    scored = vectors.mapInArrow(lean(_scored(model)), f"{kept}, score double")
    return restored(scored, columns, made | {"score": F.col("score"), "predicted": (F.col("score") >= threshold).cast("int")})


def _with_vectors(docs: DataFrame, text_col: str) -> DataFrame:
    base = docs.select(F.col(f"`{text_col}`").alias("text"), carried(docs, text_col).alias("rest"))
    return base.mapInArrow(lean(_vectors), f"text string, rest {base.schema['rest'].dataType.simpleString()}, x array<double>")


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1, higher: better) and predicted (1 from ``threshold`` on)."""
    return _with_scores(_with_vectors(docs, text_col), model, docs.columns, {text_col: F.col("text")}, threshold)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int | None = 5, threshold: float = 0.3, with_text: bool = True) -> DataFrame:
    """``fit_quality`` and ``score_quality`` of the same documents, whose texts are read once; the
    text itself is left out on request."""
    vectors = _with_vectors(docs, text_col)
    vectors = settle(vectors if with_text else vectors.drop("text"))
    model = _learned(vectors.select(F.col(f"rest.`{id_col}`").alias("d"), "x"), labels, id_col, label_col, held_out)
    made = {text_col: F.col("text")} if with_text else {}
    return _with_scores(vectors, model, [c for c in docs.columns if with_text or c != text_col], made, threshold)
