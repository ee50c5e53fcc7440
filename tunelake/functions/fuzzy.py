"""Candidates for the weighted ratio: an index of each text's rarest parts, from which no pair that scores the threshold is lost.

A ratio counts the letters that have to go from either text, so a score bounds them, and each of them touches two pairs of
neighbouring letters of a word at most.  Pairs are taken within words (with a blank in front), so that words in another order
have the same; a text with n of them that lacks k at most shares n - k with any partner.  In one order of all pairs, rarest
first, the first k + s of two such texts have s in common.  One pair of letters is in too many texts, so sets of up to three
(``SETS``, by the length of the shorter text) are the keys that are joined: parts that nearly all texts have come last and stay
out.  The ratio of shared words to all words of one side is over the threshold only if nearly all of that side's words are
shared: its rarest words, as many as can't all be missing, are joined with all words of the other side.

Rarity is counted in ``BUCKETS`` buckets of a hash, a table of fixed size; any order would be complete, the rare ones first make
it short.  Texts of equal words are one spelling, with repeated words a second without them.  All this holds for thresholds
of ``LEAST`` and more.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .text import fuzz_process, weighted_ratio_udf

LEAST = 90
BUCKETS = 1 << 16


#: Up to this length of the shorter text, so many pairs of letters make a key.
SETS = ((8, 1), (16, 3), (48, 2), (1 << 30, 1))


def letter_pairs(words: list[str]) -> list[str]:
    """The letters of each word with what precedes them; the second of a kind and further ones are numbered."""
    seen: Counter = Counter()
    out = []
    for w in words:
        for g in map("".join, zip(" " + w, w)):
            seen[g] += 1
            out.append(g if seen[g] == 1 else f"{g}{seen[g]}")
    return out


def length(words: list[str]) -> int:
    return sum(map(len, words)) + len(words) - 1


def most_lost(words: list[str], threshold: int) -> int:
    """The most letter pairs of the text that one which scores the threshold can lack.

    A letter that goes takes those that it is in, a blank the next word's first; a letter or blank that comes in between breaks one.
    Letters that go from this text and from the other weigh against both lengths.
    """
    far, size = 1 - (threshold - 0.5) / 100, length(words)
    gone = sorted([min(2, len(w) - j) for w in words for j in range(len(w))] + [1] * (len(words) - 1), reverse=True)
    gone, letters, most = np.r_[0, np.cumsum(gone)], sum(map(len, words)), 0
    for k in range(int(2 * far * size / (1 + far) + 1e-9) + 1):
        more = int((2 * far * size - (1 + far) * k) / (1 - far) + 1e-9)
        most = max(most, int(gone[min(k, len(gone) - 1)]) + min(more, letters))
    return most


def spellings(text: str | None) -> list[list[str]]:
    """The words of a text as ratios see them, and without repetitions if it has any."""
    words = fuzz_process(text).split()
    once = list(dict.fromkeys(words))
    return [] if not words else [words] if len(once) == len(words) else [words, once]


def parts(text: str | None) -> list[str]:
    """All that rarity is counted of."""
    return [p for words in spellings(text) for p in (*letter_pairs(words), *("=" + w for w in words))]


def bucket(part: str) -> int:
    return zlib.crc32(part.encode()) % BUCKETS


def rarest(found: list[str], counts: np.ndarray) -> list[str]:
    return sorted(found, key=lambda p: (counts[bucket(p)], p))


def prefix_keys(words: list[str], threshold: int, counts: np.ndarray) -> list[str]:
    """Sets of the rarest letter pairs, of which every partner has one too."""
    found, lost, size = rarest(letter_pairs(words), counts), most_lost(words, threshold), length(words)
    far = 1 - (threshold - 0.5) / 100
    shortest = size * (1 - far) / (1 + far)  # of a partner
    out, low = [], 0
    for high, many in SETS:
        if shortest <= high and low < size:  # the shorter of the two may have such a length
            out += [f"{many}" + "|".join(x) for x in itertools.combinations(found[: lost + many], min(many, len(found) - lost))]
        low = high
    return out


def index_keys(text: str | None, threshold: int, counts: np.ndarray, left: bool) -> dict[str, int]:
    """Keys to join on and the text's length; words that are looked for meet all words of the other side."""
    near = np.ceil((threshold - 0.5) / 0.95 - 1e-9)
    far = 1 - (near - 0.5) / 100
    size, out = len(fuzz_process(text)), {}
    for words in spellings(text):
        out.update(dict.fromkeys(prefix_keys(words, threshold, counts), size))
        once = rarest(["=" + w for w in dict.fromkeys(words)], counts)
        spare = 2 * far / (1 + far) * (sum(map(len, once)) - 1) - 1  # the letters of words that the other side may lack
        sought, total = [], -1
        for w in once:
            sought.append(w)
            total += len(w)
            if total > spare:
                break
        out.update(dict.fromkeys(("<>"[left] + w for w in sought), size))
        out.update(dict.fromkeys(("><"[left] + w for w in once), size))
    return out


def counted(*texts: DataFrame) -> np.ndarray:
    """How often the parts of each bucket occur in the texts (frames of one column); at most ``BUCKETS`` rows reach the driver."""

    @F.pandas_udf("array<int>")
    def buckets(c: pd.Series) -> pd.Series:
        return pd.Series([[bucket(p) for p in parts(t)] for t in c], dtype=object)

    return totals(*[t.select(buckets(F.col(t.columns[0])).alias("b")) for t in texts])


def totals(*buckets: DataFrame) -> np.ndarray:
    """The number of each bucket in frames of one column of arrays."""
    rows = buckets[0]
    for more in buckets[1:]:
        rows = rows.union(more)
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.select(F.explode(rows.columns[0]).alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect():
        out[r.b] = r.n
    return out


def lengths_fit(a: Column, b: Column) -> Column:
    """Lengths of which neither is half as much again as the other, beyond which no ratio reaches the threshold."""
    return 2 * F.greatest(a, b) < 3 * F.least(a, b)


def candidates(left: DataFrame, right: DataFrame, by: tuple[str, ...] = (), threshold: int = LEAST) -> DataFrame:
    """(by, left, right, score): all pairs of texts, of equal ``by`` columns, that score the threshold, each once.

    left: by and ``left``, a text; right: by and ``right``.  Null texts have no partner, nor have null by columns.
    """
    if threshold < LEAST:
        raise ValueError(f"the index is complete from {LEAST} on")
    sides = {n: df.select(*by, n).dropna().distinct() for n, df in (("left", left), ("right", right))}
    counts = left.sparkSession.sparkContext.broadcast(counted(*[df.select(n) for n, df in sides.items()]))

    def keyed(n: str) -> DataFrame:
        @F.pandas_udf("array<struct<k:string,n:int>>")
        def keys(c: pd.Series) -> pd.Series:
            return pd.Series([[{"k": k, "n": size} for k, size in index_keys(t, threshold, counts.value, n == "left").items()] for t in c], dtype=object)

        texts = sides[n].select(n).distinct().withColumn("x", F.explode(keys(n))).select(n, F.col("x.k").alias("__k"), F.col("x.n").alias(f"__{n}"))
        return texts.join(sides[n], n) if by else texts

    met = keyed("left").join(keyed("right"), ["__k", *by]).filter(lengths_fit(F.col("__left"), F.col("__right")))
    pairs = met.select("left", "right", *by).distinct()
    scored = pairs.select("left", "right").distinct().withColumn("score", weighted_ratio_udf("left", "right")).filter(F.col("score") >= threshold)
    return pairs.join(scored, ["left", "right"]).select(*by, "left", "right", "score")
