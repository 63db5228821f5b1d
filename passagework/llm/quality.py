"""Quality classifier: regularised quadratic discriminant over document statistics.

Each document gives a vector of transformed statistics of its whole text. Per class, count, mean
and scatter are summed over all labelled rows in one grouped aggregation; the class covariance is
shrunk towards the pooled one and towards a sphere, factored once by Cholesky and the factor
inverted by substitution once, and a document's score is the calibrated difference of its two
Gaussian log densities (a Mahalanobis distance is one product with the cached factor). The shrinkage is chosen by log loss on a fold of the labelled rows.

Labels come only from rows whose crc32(doc_id as text) modulo 4 is not 2. Labels, language,
source and doc_id never enter a vector.

Defined cases: a null text counts as empty and is scored like any other vector; repeated rows
each give their row, and repeated or conflicting labels each count; rows with a null label are
left out; without labels of both classes every score is the share of label 1 (0.5 without any);
a very long text gives one vector of its whole; ties of shrinkage go to the first tried; an empty
table gives an empty result; other columns pass through ``keep`` and are ignored by
``scored``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blobs, per_batch, written
from .words import word_hashes

THRESHOLD = 0.7
HELD_OUT = 2
_VALID = 1
#: (towards the pooled covariance, towards a sphere), tried in this order.
SHRINKAGE = ((0.0, 0.01), (0.02, 0.02), (0.1, 0.02), (0.3, 0.05), (0.6, 0.1), (1.0, 0.05))
_GROUPS = [b"*#$%&@~^<>{}[]=+\\_", b"!", b"|", b".", b",", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n"]
_TABLE = np.zeros((256, len(_GROUPS) + 1))
for _j, _g in enumerate(_GROUPS):
    _TABLE[list(_g), _j] = 1
_TABLE[128:192, -1] = 1  # continuation bytes: letters outside ASCII, about
WIDTH = 8 + len(_GROUPS)
_BINS, _REACH = 4000, 400.0


def _most(h: np.ndarray) -> tuple[int, int]:
    """(distinct values, occurrences of the most common one)"""
    if not len(h):
        return 0, 0
    s = np.sort(h)
    edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
    return len(edge) - 1, int(np.diff(edge).max())


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of transformed statistics per text; every value is finite, also for empty texts."""
    h, bounds = word_hashes(texts)
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] if len(h) > 1 else np.zeros(0, np.uint64)
    out = np.zeros((len(texts), WIDTH))
    for i, t in enumerate(texts):
        a, b = int(bounds[i]), int(bounds[i + 1])
        words, size = b - a, len(t)
        counts = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        groups = counts @ _TABLE
        ink = size - int(counts[0x20] + counts[0x09:0x0E].sum())
        distinct, most = _most(h[a:b])
        pairs, top = _most(pair[a : b - 1]) if words > 1 else (0, 0)
        lines = t.split(b"\n")
        logit = lambda k, n: np.log((k + 0.5) / (n - k + 0.5))
        out[i] = [
            np.log1p(words),
            np.log((ink + 1) / (words + 1)),
            *np.log((groups[:5] + 0.5) / (words + 1.0)),
            logit(groups[5], size), logit(groups[6], size),
            np.log((groups[7] + 0.5) / (words + 1.0)),
            logit(groups[8], size),
            logit(distinct, words), logit(most, words), logit(pairs, max(words - 1, 0)), logit(top, max(words - 1, 0)),
            logit(len(set(lines)), len(lines)),
        ]
    return out


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


@dataclass
class Model:
    """Two Gaussians, given by mean, inverse Cholesky factor and log determinant, and a calibration."""

    means: np.ndarray | None = None
    #: Inverses of the covariances' lower Cholesky factors, found once by forward substitution.
    inverses: np.ndarray | None = None
    logdets: np.ndarray | None = None
    slope: float = 1.0
    shift: float = 0.0
    constant: float = 0.5

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density under class 1 less that under class 0."""
        d = []
        for k in (0, 1):
            z = self.inverses[k] @ (x - self.means[k]).T
            d.append(-0.5 * ((z * z).sum(axis=0) + self.logdets[k]))
        return np.clip(d[1] - d[0], -_REACH, _REACH)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -500, 500)))


def _gaussians(sums: dict[int, np.ndarray], pooled: float, sphere: float) -> Model | None:
    """sums: per class count, sums and sums of products."""
    if any(k not in sums or sums[k][0] < 2 for k in (0, 1)):
        return None
    n = [sums[k][0] for k in (0, 1)]
    means = np.array([sums[k][1 : 1 + WIDTH] / n[k] for k in (0, 1)])
    spread = [sums[k][1 + WIDTH :].reshape(WIDTH, WIDTH) - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    both = (spread[0] + spread[1]) / (n[0] + n[1])
    factors = []
    for k in (0, 1):
        c = (1 - pooled) * spread[k] / n[k] + pooled * both
        c = (1 - sphere) * c + sphere * max(np.trace(c) / WIDTH, 1e-6) * np.eye(WIDTH)
        factors.append(np.linalg.cholesky((c + c.T) / 2))
    logdets = np.array([2 * np.log(np.diag(f)).sum() for f in factors])
    return Model(means, np.array([_lower_inverse(f) for f in factors]), logdets)


def _lower_inverse(f: np.ndarray) -> np.ndarray:
    """The inverse of a lower triangular matrix, row by row."""
    out = np.eye(len(f))
    for i in range(len(f)):
        out[i] = (out[i] - f[i, :i] @ out[:i]) / f[i, i]
    return out


def _calibrated(hist: np.ndarray) -> tuple[float, float, float]:
    """(slope, shift, log loss) of a logistic curve through counts by margin bin and class."""
    z = (np.arange(_BINS) + 0.5) / _BINS * 2 * _REACH - _REACH
    n1, n = hist[1], hist.sum(axis=0)
    total = max(1.0, n.sum())
    w = np.array([0.1, np.log((n1.sum() + 1) / (hist[0].sum() + 1))])

    def loss(w: np.ndarray) -> float:
        v = w[0] * z + w[1]
        return float((n1 * np.logaddexp(0, -v) + hist[0] * np.logaddexp(0, v)).sum() / total + 1e-4 * w[0] ** 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w[0] * z + w[1], -500, 500)))
        r = (n * p - n1) / total
        g = np.array([(r * z).sum() + 2e-4 * w[0], r.sum()])
        v = n * p * (1 - p) / total
        hess = np.array([[(v * z * z).sum() + 2e-4, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        step, size = np.linalg.solve(hess, g), 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), loss(w)


def _histograms(labelled: DataFrame, models: list[Model]) -> dict[tuple[int, int], np.ndarray]:
    """Per (model, fold == _VALID) the counts by class and margin bin: a bounded table."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = np.zeros((len(models), 2, 2, _BINS), np.int64)
        for b in batches:
            x, y, f = _matrix(b), np.array(b.column("quality").to_pylist()), np.array(b.column("fold").to_pylist())
            for m, model in enumerate(models):
                at = np.minimum(((model.margin(x) + _REACH) / (2 * _REACH) * _BINS).astype(np.int64), _BINS - 1)
                np.add.at(h, (m, (f == _VALID).astype(int), y, at), 1)
        where = np.flatnonzero(h)
        yield pa.record_batch([pa.array(where), pa.array(h.reshape(-1)[where])], names=["slot", "n"])

    rows = labelled.mapInArrow(go, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(len(models) * 2 * 2 * _BINS)
    for r in rows:
        flat[r["slot"]] = r["n"]
    full = flat.reshape(len(models), 2, 2, _BINS)
    return {(m, v): full[m, v] for m in range(len(models)) for v in (0, 1)}


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy().reshape(-1, WIDTH)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row's whole text."""

    def go(b: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(blobs(b))
        flat = pa.array(x.reshape(-1))
        return pa.record_batch(
            [b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * WIDTH), flat)],
            names=["doc_id", "x"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_batch(rows, go, "doc_id long, x array<double>")


def fit(x: DataFrame, labels: DataFrame) -> Model:
    """A model from ``features`` rows and (doc_id, quality), held-out rows left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT))
    labelled = written(x.join(known, "doc_id").select("x", "quality", fold(F.col("doc_id")).cast("int").alias("fold")))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, 1 + WIDTH + WIDTH * WIDTH))
        for b in batches:
            v, y, f = _matrix(b), np.array(b.column("quality").to_pylist()), np.array(b.column("fold").to_pylist())
            for k in (0, 1):
                for valid in (0, 1):
                    own = v[(y == k) & ((f == _VALID) == bool(valid))]
                    total[k, valid] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).reshape(-1)])
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["slot", "v"])

    rows = labelled.mapInArrow(moments, "slot long, v double").groupBy("slot").agg(F.sum("v").alias("v")).collect()
    if not rows:
        return Model()
    flat = np.zeros(4 * (1 + WIDTH + WIDTH * WIDTH))
    for r in rows:
        flat[r["slot"]] = r["v"]
    part = flat.reshape(2, 2, -1)
    whole = {k: part[k].sum(axis=0) for k in (0, 1)}
    n = whole[0][0] + whole[1][0]
    constant = float(whole[1][0] / n) if n else 0.5
    if min(whole[k][0] for k in (0, 1)) < 2:
        return Model(constant=constant)
    trial = {k: part[k, 0] for k in (0, 1)}
    tried = [_gaussians(trial, *s) for s in SHRINKAGE]
    if all(t is not None for t in tried) and part[:, 1, 0].min() > 0:
        h = _histograms(labelled, tried)
        losses = [_calibrated(h[m, 1])[2] for m in range(len(tried))]
        best = SHRINKAGE[int(np.argmin(losses))]
    else:
        best = SHRINKAGE[3]
    model = _gaussians(whole, *best)
    h = _histograms(labelled, [model])
    model.slope, model.shift, _ = _calibrated(h[0, 0] + h[0, 1])
    model.constant = constant
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's row of every document."""
    x = written(features(docs))
    model = fit(x, labels)

    def go(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([b.column("doc_id"), pa.array(model.score(_matrix(b)))], names=["doc_id", "score"])

    return per_batch(x, go, "doc_id long, score double").select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` that score at least the threshold."""
    model = fit(written(features(docs)), labels)

    def go(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(model.score(statistics(blobs(b))) >= THRESHOLD))

    return per_batch(docs, go, docs.schema)
