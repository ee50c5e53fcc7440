"""Toxicity categories by a chain of linear classifiers.

The categories come in an order; each one's model sees the document's words and the probabilities of the categories before
it.  In training those are out-of-fold predictions, so that a later model learns how far to trust them.  The models are
linear on indicators of the whole text's words and their beginnings (4 to 6 bytes), with naive Bayes scaling, hinge loss and a fitted sigmoid.

The labels name no kinds of toxicity, so the categories are found in the labelled sample: a mixture of two kinds is fitted to
the toxic documents' telling words (those whose rates differ most between the classes), and what differs most from clean
documents by those words is severe.  The default chain is ``kind_a``, ``kind_b``, ``severe``, ``toxic``: the last is the label.
Documents whose crc32 modulo ``HOLDOUT`` is 0 are held out.  The fit uses at most ``SAMPLE_ROWS`` labelled rows and
``SAMPLE_BYTES`` of their text, the first in the order of a hash of the id.

Null and empty texts have no words and get each sigmoid's constant.  A text may have any length: its distinct words are in
one task's memory.  Null labels are left out; a label that repeats counts again.  A probability equal to the threshold counts
as toxic.  Without labels of both classes a category's probability is their smoothed rate.  Rows are independent, so repeated
rows give equal rows; columns besides the id and the text aren't read, so their names can't clash.  An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import common, linear
from .decontam import words_of

BITS = 18
HOLDOUT = 5
SAMPLE_ROWS = 8000
SAMPLE_BYTES = 48 << 20
THRESHOLD = 0.3
#: Indicators that tell the classes apart best, of which kinds and severity are made.
TELLING = 256
#: Documents that must have an indicator for it to count.
LEAST = 4
CHAIN = ("kind_a", "kind_b", "severe", "toxic")


def word_codes(word: bytes) -> bytes:
    """Hashes of the word and of its beginnings of 4, 5 and 6 bytes, as raw numbers."""
    return np.array([linear.word_hash(x) for x in (word, *[b"^" + word[:n] for n in (4, 5, 6) if len(word) > n])], np.uint64).tobytes()


def features(text: bytes | None, codes: linear.Hashes, bits: int = BITS) -> np.ndarray:
    """Sorted distinct hashed indicators of a whole text."""
    words = set(words_of(text))
    found = np.frombuffer(b"".join([codes[w] for w in words]), np.uint64) >> np.uint64(64 - bits)
    return np.unique(found.astype(np.int64))


def categories(sets: list[np.ndarray], toxic: np.ndarray, size: int, telling: int = TELLING) -> np.ndarray:
    """A row for each document: is it of the first kind, of the second, severe, toxic.

    Kinds are the likelier part of a mixture of two Bernoulli products, fitted from the halves on either side of the toxic
    documents' first principal axis.  Severe are the toxic documents above the median of the summed log-odds of their telling indicators.
    """
    out = np.zeros((len(sets), len(CHAIN)), np.int64)
    out[:, 3] = toxic
    own = np.flatnonzero(toxic)
    if len(own) < 4 or len(own) == len(sets):
        out[own, 0] = 1
        return out
    counts = np.stack([np.bincount(np.concatenate([sets[i] for i in np.flatnonzero(toxic == c)]), minlength=size) for c in (0, 1)])
    rates = (counts + 0.5) / (np.array([[(toxic == 0).sum()], [len(own)]]) + 1)
    odds = np.log(rates[1] / (1 - rates[1])) - np.log(rates[0] / (1 - rates[0]))
    best = np.argsort(-odds * rates[1], kind="stable")[:telling]
    place = np.full(size, -1)
    place[best] = np.arange(len(best))
    x = np.zeros((len(own), len(best)))
    for r, i in enumerate(own):
        found = place[sets[i]]
        x[r, found[found >= 0]] = 1
    weight = x @ odds[best]
    out[own, 2] = weight > np.median(weight)
    centred = x - x.mean(axis=0)
    axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    part = (centred @ (axis * np.sign(axis[np.abs(axis).argmax()])) > 0).astype(float)
    for _ in range(50):
        share, logs = np.clip([1 - part.mean(), part.mean()], 1e-6, None), []
        for r in (1 - part, part):
            rate = (r @ x + 0.5) / (r.sum() + 1)
            logs.append(x @ np.log(rate) + (1 - x) @ np.log(1 - rate))
        now = linear.sigmoid(logs[1] - logs[0] + np.log(share[1] / share[0]))
        moved, part = np.abs(now - part).max(), now
        if moved < 1e-6:
            break
    out[own, 0], out[own, 1] = part < 0.5, part >= 0.5
    return out


def fit_chain(sets: list[np.ndarray], targets: np.ndarray, bits: int = BITS) -> list[linear.Model]:
    """One model for each column of targets, in order."""
    models, earlier = [], np.zeros((len(sets), 0))
    for k in range(targets.shape[1]):
        model, out_of_fold = linear.fit(sets, targets[:, k], 1 << bits, earlier, least=LEAST)
        models.append(model)
        earlier = np.column_stack([earlier, out_of_fold])
    return models


def predict_chain(models: list[linear.Model], found: np.ndarray) -> list[float]:
    got: list[float] = []
    for m in models:
        got.append(m.probability(m.margin(found, np.array(got))))
    return got


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", target: str = "toxic", holdout: int = HOLDOUT, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> list[linear.Model]:
    rows = linear.labelled_sample(docs, labels, common.with_crc_bucket(id_col, holdout) != 0, [target], sample_rows, sample_bytes, id_col, text)
    codes = linear.Hashes(word_codes)
    sets = [features(t, codes) for t, _ in rows]
    return fit_chain(sets, categories(sets, np.array([int(y > 0) for _, y in rows], np.int64), 1 << BITS))


def predict(docs: DataFrame, models: list[linear.Model], names: tuple[str, ...] = CHAIN, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and p_<category> of each category of the chain."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def make():
        codes = linear.Hashes(word_codes)

        def run(texts: list) -> dict:
            seen: dict = {}
            for t in texts:
                if t not in seen:
                    seen[t] = predict_chain(shared.value, features(t, codes))
            return {f"p_{n}": [seen[t][k] for t in texts] for k, n in enumerate(names)}

        return run

    return common.map_text(docs, make, [(f"p_{n}", "double") for n in names], text, keep)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **how) -> DataFrame:
    """One row for each document: id, held_out, the categories' probabilities, score (the last one's) and predicted."""
    got = predict(docs, train(docs, labels, id_col, text, **how), text=text, keep=[id_col])
    last = F.col(f"p_{CHAIN[-1]}")
    return got.select(id_col, (common.with_crc_bucket(id_col, how.get("holdout", HOLDOUT)) == 0).alias("held_out"), *[f"p_{n}" for n in CHAIN], last.alias("score"), (last >= threshold).cast("int").alias("predicted"))
