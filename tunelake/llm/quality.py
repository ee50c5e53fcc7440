"""Quality classification by naive Bayes support vectors.

A document's features are indicators of hashed n-grams of its whole text: words and word pairs, and runs of one to three
word shapes (letters, digits, the marks themselves; a word equal to the one before has the shape "=").  They are scaled
by the log-count ratio of the classes, a linear hinge-loss model is fitted by dual coordinate descent, and a sigmoid fitted
to out-of-fold margins turns its margin into a score.

The fit uses at most ``SAMPLE_ROWS`` labelled rows and ``SAMPLE_BYTES`` of their text, the first in the order of a hash
of the id, from those that aren't held out.  Every document is scored whole; a text may have any length, its n-grams are in
one task's memory.  Null and empty texts have no n-grams and get the score of the sigmoid's constant.  A score equal to the
threshold is good.  Labels that are null are left out; a label that repeats counts again.  Repeated rows are scored alike.
Columns besides the id and the text aren't read, so their names can't clash.  Without labels of both classes the score is
their smoothed rate (0.5 without any).  An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import common, linear

BITS = 18
SAMPLE_ROWS = 6000
SAMPLE_BYTES = 48 << 20
THRESHOLD = 0.3
SHAPES = bytes(0x39 if 48 <= b <= 57 else 0x61 if 97 <= b <= 122 or 65 <= b <= 90 or b >= 128 else b for b in range(256))
RUNS = re.compile(rb"(.)\1+", re.DOTALL)


def word_code(word: bytes) -> int:
    """48 bits of the word's hash over 16 of its shape's."""
    return linear.word_hash(word) & ~0xFFFF | linear.word_hash(RUNS.sub(rb"\1", word.translate(SHAPES))) & 0xFFFF


class Featurizer:
    """Whole text -> sorted distinct hashed indicators."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self.codes = linear.Hashes(word_code)
        self.same = np.uint64(linear.word_hash(b"=") & 0xFFFF)

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").translate(common.LOWER).split()
        if not words:
            return np.zeros(0, np.int32)
        code = np.fromiter(map(self.codes.__getitem__, words), np.uint64, len(words))
        s, w = code & np.uint64(0xFFFF), code >> np.uint64(16)
        s[1:][w[1:] == w[:-1]] = self.same
        kinds = [linear.mix(w, seed=1), linear.mix(w[:-1], w[1:], seed=2)]
        kinds += [linear.mix(*[s[k : len(s) - n + 1 + k] for k in range(n)], seed=2 + n) for n in (1, 2, 3) if len(s) >= n]
        found = (np.concatenate(kinds) >> self.shift).astype(np.int32)
        found.sort()
        return found[np.concatenate([[True], found[1:] != found[:-1]])]


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", id_col: str = "doc_id", text: str = "text", holdout: int = 5, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, bits: int = BITS) -> linear.Model:
    got = linear.labelled_sample(docs, labels, common.with_crc_bucket(id_col, holdout) != 0, [target], sample_rows, sample_bytes, id_col, text)
    features = Featurizer(bits)
    return linear.fit([features(t) for t, _ in got], np.array([int(y > 0) for _, y in got], np.int64), 1 << bits)[0]


def score(docs: DataFrame, model: linear.Model, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD, bits: int = BITS, only_kept: bool = False) -> DataFrame:
    """The kept columns, ``score`` and ``predicted``; with only_kept just the kept columns of the documents predicted 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        features, m = Featurizer(bits), shared.value

        def run(texts: list) -> dict:
            seen: dict = {}
            for t in texts:
                if t not in seen:
                    seen[t] = m.probability(m.margin(features(t)))
            got = [seen[t] for t in texts]
            return {"score": got, "predicted": [int(s >= threshold) for s in got], "__good": [s >= threshold for s in got]}

        return run

    if only_kept:
        return common.map_text(docs, make, [("__good", "boolean")], text, keep, where="__good")
    return common.map_text(docs, make, [("score", "double"), ("predicted", "int")], text, keep)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", holdout: int = 5, threshold: float = THRESHOLD, **how) -> DataFrame:
    """One row for each document: id, held_out, score and predicted."""
    scored = score(docs, train(docs, labels, id_col=id_col, text=text, holdout=holdout, **how), text, [id_col], threshold)
    return scored.select(id_col, (common.with_crc_bucket(id_col, holdout) == 0).alias("held_out"), "score", "predicted")


def good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", holdout: int = 5, **how) -> DataFrame:
    """The documents that the classifier doesn't reject, with the columns they came with."""
    return score(docs, train(docs, labels, id_col=id_col, text=text, holdout=holdout, **how), text, only_kept=True).select(*[F.col(f"`{c}`") for c in docs.columns])
