"""Linear classifiers on sets of hashed n-grams: naive Bayes scaling, dual coordinate descent, a fitted sigmoid.

Small helpers for the operators that learn from labels; the rows to learn from are a bounded, documented sample.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from . import common


class Hashes(dict):
    """Word -> hash; emptied when it has grown to ``most`` words, so that its memory is bounded."""

    def __init__(self, make: Callable[[bytes], int], most: int = 1 << 19):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = self.make(word)
        return out


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def mix(*parts: np.ndarray, seed: int = 0) -> np.ndarray:
    """One 64-bit hash of aligned arrays of hashes."""
    h = np.full(len(parts[0]), 0x9E3779B97F4A7C15 + seed, np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
    return h


def labelled_sample(docs: DataFrame, labels: DataFrame, want: Column, targets: list[str], rows: int, most_bytes: int, id_col: str = "doc_id", text: str = "text") -> list[tuple]:
    """At most ``rows`` labelled documents and ``most_bytes`` of text, in the order of a hash of the id: (text bytes, targets...).

    A text that would pass the bytes is left out and the next ones go on; if no labelled text fits, that is an error.
    The sample of labels is bounded, so it may be broadcast; what the driver collects is bounded in rows and bytes.
    """
    picked = labels.filter(want).dropna(subset=[id_col, *targets]).select(F.col(id_col).alias("__id"), *targets).orderBy(F.xxhash64("__id"), "__id", *targets).limit(rows)
    own = docs.select(F.col(id_col).alias("__id"), F.col(text).cast("string").alias("__text"))
    met = common.written(own.join(F.broadcast(picked), "__id").select(F.xxhash64("__id").alias("h"), "__id", "__text", *targets))
    met = met.withColumn("n", F.coalesce(F.octet_length("__text"), F.lit(0)))
    # documents may repeat an id; the running total keeps rows and bytes bounded even then
    sizes = met.select("h", "__id", "n").orderBy("h", "__id", "n").limit(rows).collect()
    total, fit = 0, []
    for row in sizes:  # a text that doesn't fit is passed over
        if total + row.n <= most_bytes:
            total += row.n
            fit.append(row)
    if not fit:
        if sizes:
            raise ValueError(f"none of {len(sizes)} labelled texts fits into {most_bytes} bytes")
        return []
    counts = Counter((row.h, row["__id"], row.n) for row in fit)
    # rows that tie in all three have one size, so any so many of them are within the bound
    spark = docs.sparkSession
    places = spark.createDataFrame([(*k, c) for k, c in counts.items()], T.StructType([met.schema["h"], met.schema["__id"], met.schema["n"], T.StructField("most", T.IntegerType())]))
    ties = Window.partitionBy("h", "__id", "n").orderBy("__text", *targets)
    chosen = met.join(F.broadcast(places), ["h", "__id", "n"]).withColumn("at", F.row_number().over(ties)).filter("at <= most")
    out = chosen.orderBy("h", "__id", "n", "__text", *targets).collect()
    return [((r["__text"] or "").encode(), *[r[t] for t in targets]) for r in out]


def coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: np.ndarray, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """The weights of the linear hinge-loss model, by dual coordinate descent; y is +1 or -1."""
    w, a, rng = np.zeros(size), np.zeros(len(rows)), np.random.default_rng(seed)
    norms = np.array([max(float(v @ v), 1e-12) for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * float(w[rows[i]] @ values[i]) - 1
            new = min(max(a[i] - g / norms[i], 0.0), cost[i])
            if new != a[i]:
                w[rows[i]] += (new - a[i]) * y[i] * values[i]
                moved = max(moved, abs(new - a[i]) * norms[i] ** 0.5)
                a[i] = new
        if moved < 1e-3:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_sigmoid(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(a, b) of P(1) = sigmoid(a * margin + b) by Newton steps on smoothed targets."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    p = np.array([1.0, np.log((pos + 1) / (neg + 1))])
    x = np.column_stack([margin, np.ones_like(margin)])
    loss = lambda p: float(np.sum(np.logaddexp(0, x @ p) - t * (x @ p))) + 1e-6 * float(p @ p)
    for _ in range(steps):
        q = sigmoid(x @ p)
        g = x.T @ (q - t) + 2e-6 * p
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2)
        step, scale = np.linalg.solve(h, g), 1.0
        while scale > 1e-6 and loss(p - scale * step) > loss(p):
            scale /= 2
        p = p - scale * step
        if np.abs(scale * step).max() < 1e-7:
            break
    return float(max(p[0], 1e-6)), float(p[1])


@dataclass
class Model:
    """weights of hashed indicators, of extra inputs, and the sigmoid of the margin."""

    weights: np.ndarray
    extra: np.ndarray = field(default_factory=lambda: np.zeros(0))
    a: float = 1.0
    b: float = 0.0
    unit: bool = True

    def margin(self, features: np.ndarray, extra: np.ndarray | None = None) -> float:
        m = float(self.weights[features].sum(dtype=np.float64)) if len(features) else 0.0
        return m + (float(self.extra @ extra) if len(self.extra) else 0.0)

    def probability(self, margin: float) -> float:
        return float(sigmoid(np.float64(self.a * margin + self.b)))


def fit(sets: list[np.ndarray], y: np.ndarray, size: int, extra: np.ndarray | None = None, folds: int = 4, cost: float = 1.0, alpha: float = 1.0, least: int = 2) -> tuple[Model, np.ndarray]:
    """Naive Bayes support vectors: (model, out-of-fold probabilities).  y is 1 or 0, sets are distinct hashed indicators.

    least: an indicator counts if so many documents have it.
    """
    extra = np.zeros((len(sets), 0)) if extra is None else extra
    k = extra.shape[1]
    if not len(sets) or len(set(y.tolist())) < 2:
        rate = (float(y.sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(size, np.float32), np.zeros(k), 0.0, float(np.log(rate / (1 - rate)))), np.full(len(y), rate)

    def once(own: np.ndarray) -> Model:
        counts = [np.full(size, alpha), np.full(size, alpha)]
        for i in own:
            counts[int(y[i])][sets[i]] += 1
        seen = counts[0] + counts[1] >= 2 * alpha + least  # an n-gram of so few documents says nothing about others
        ratio = np.where(seen, np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum()), 0.0)
        place = np.arange(size, size + k)
        rows = [np.r_[sets[i], place] for i in own]
        values = [np.r_[ratio[sets[i]], extra[i]] for i in own]
        sign = np.where(y[own] > 0, 1.0, -1.0)
        rate = np.array([(sign < 0).mean(), (sign > 0).mean()])
        w = coordinate_descent(rows, values, sign, size + k, cost * 0.5 / rate[(sign > 0).astype(int)])
        return Model((w[:size] * ratio).astype(np.float32), w[size:])

    fold = np.arange(len(sets)) % folds
    margins = np.zeros(len(sets))
    for f in range(folds):
        own = np.flatnonzero(fold != f)
        if len(set(y[own].tolist())) < 2:
            continue
        part = once(own)
        for i in np.flatnonzero(fold == f):
            margins[i] = part.margin(sets[i], extra[i])
    model = once(np.arange(len(sets)))
    model.a, model.b = fit_sigmoid(margins, y)
    return model, sigmoid(model.a * margins + model.b)
