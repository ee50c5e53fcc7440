"""Words against a dictionary learned from texts: the nearest entry by a deletion neighbourhood, and how English a text is."""

from __future__ import annotations

import functools
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tunelake.sources.catalog import checkpointed

#: Edits that are looked for, and letters of a word that are indexed: with fewer, long words of one beginning all meet.
MOST, PREFIX = 2, 24
#: Keys that are made at once.
KEYS = 1 << 20
#: The key of a word of which nothing is left.
NOTHING = np.uint64(0x9E3779B97F4A7C15)


def words(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, word, times): the lower-case words of each row's text, between blanks; a row's own are counted where it is."""
    rows = texts.select(key, F.lower(text).cast("binary").alias("t"))
    schema = T.StructType([rows.schema[key], T.StructField("word", T.StringType()), T.StructField("times", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                counts = [Counter((t or b"").split()) for t in batch.column(1).to_pylist()]
                own = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts])))
                said = pa.array([w for c in counts for w in c], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([own, said, pa.array([n for c in counts for n in c.values()], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def dictionary(texts: DataFrame, text: str = "text", least: int = 5) -> DataFrame:
    """(word, n): runs of letters and digits that occur so often at least, counted over all texts."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return texts.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


@functools.cache
def _rests(length: int, most: int) -> list[np.ndarray]:
    """The places that stay when up to so many of a word's letters go: a matrix for each number of them."""
    stay = [list(itertools.combinations(range(length), length - k)) for k in range(min(most, length) + 1)]
    return [np.array(x, np.intp).reshape(len(x), length - k) for k, x in enumerate(stay)]


def _keys(letters: np.ndarray, most: int) -> np.ndarray:
    """Hashes of what is left of words of one length (letters: words, places) with up to so many letters gone."""
    out = []
    for rest in _rests(letters.shape[1], most):
        h = np.full((len(letters), len(rest)), NOTHING)
        for k in range(rest.shape[1]):
            h = (h ^ letters[:, rest[:, k]]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        out.append(h)
    return np.concatenate(out, axis=1)


def neighbourhoods(rows: DataFrame, most: int = MOST, prefix: int = PREFIX, letters: frozenset[str] | None = None) -> DataFrame:
    """The rows (the first column a word) with ``k``, once for each hash of the word's beginning with up to so many letters gone.

    Of two words within a distance of ``most``, the beginnings of equal length have a common rest: the letters that the edits leave
    in both, of which neither lacks more than ``most``.  letters: those that the other words have; any other letter is among those
    that go, and a word with too many of them has no keys.
    """
    schema = T.StructType([*rows.schema, T.StructField("k", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict = {}
            for i, word in enumerate(batch.column(0).to_pylist()):
                gone = 0 if letters is None else sum(x not in letters for x in word)
                if gone <= most:
                    start = word[:prefix]
                    kept = [x for x in start if x in letters] if gone else start
                    groups.setdefault((len(kept), most - len(start) + len(kept)), []).append((i, "".join(kept)))
            for (size, left), some in groups.items():
                step = max(1, KEYS // sum(map(len, _rests(size, left))))
                for at in range(0, len(some), step):
                    places, kept = zip(*some[at : at + step], strict=True)
                    code = np.frombuffer("".join(kept).encode("utf-32-le"), np.uint32).reshape(len(kept), size).astype(np.uint64)
                    k = np.sort(_keys(code, left), axis=1)
                    new = np.ones(k.shape, bool)
                    new[:, 1:] = k[:, 1:] != k[:, :-1]
                    own = batch.take(pa.array(np.repeat(places, new.sum(axis=1))))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(k[new].view(np.int64))], names=schema.names)

    return rows.mapInArrow(run, schema)


def nearest(found: DataFrame, known: DataFrame, most: int = MOST, prefix: int = PREFIX) -> DataFrame:
    """(word, entry, distance): for each distinct word its nearest entry within ``most`` edits, the commonest of equals; others have none.

    found: word; known: word, n.  Entries that a word equals need no search; the rest meet by an equi-join of their neighbourhoods, where
    lengths rule most pairs out before distances are counted.  Keys hold nearly all of a word's letters, so what meets is near: pairs
    grow with what is found, not with words times entries.  The letters of all entries go to every task: an alphabet, whatever their number.
    Entries that share no letter with a word are as far as the longer of both is long, so of each length only the commonest comes.
    """
    own = found.select("word").dropna().distinct()
    entry = checkpointed(known.select(F.col("word").alias("entry"), "n").dropna(subset=["entry"]))
    exact = checkpointed(own.join(entry, F.col("word") == F.col("entry"), "left"))
    letters = frozenset(r.c for r in entry.select(F.explode(F.split("entry", "")).alias("c")).distinct().collect())
    nothing = int(NOTHING.view(np.int64))
    right = neighbourhoods(entry, most, prefix).filter(F.col("k") != nothing)
    short = entry.filter(F.length("entry") <= most).groupBy(F.length("entry")).agg(F.min(F.struct((-F.col("n")).alias("n"), "entry")).alias("b"))
    right = right.unionByName(short.select("b.entry", (-F.col("b.n")).alias("n"), F.lit(nothing).alias("k")))
    left = neighbourhoods(exact.filter("entry IS NULL").select("word"), most, prefix, letters)
    near = left.join(right.hint("merge"), "k").filter(F.abs(F.length("word") - F.length("entry")) <= most)
    scored = near.withColumn("distance", F.levenshtein("word", "entry", most)).filter("distance >= 0")
    best = scored.groupBy("word").agg(F.min(F.struct("distance", (-F.col("n")).alias("n"), "entry")).alias("b")).select("word", "b.entry", "b.distance")
    met = exact.select("word", "entry", F.when(F.col("entry").isNotNull(), 0).alias("distance"))
    return met.filter("entry IS NOT NULL").unionByName(met.filter("entry IS NULL").select("word").join(best, "word", "left"))


def english_share(texts: DataFrame, known: DataFrame, key: str, text: str = "text", most: int = MOST) -> DataFrame:
    """(key, share): the letters of a text's words that needn't change to make each an entry, over all; 0 for a text without words.

    Words are counted for each text first and distances looked up once for each distinct word.
    """
    counts = checkpointed(words(texts, key, text))
    far = nearest(counts, known, most).select("word", F.coalesce("distance", F.length("word")).alias("d"))
    size = F.length("word").cast("long")
    summed = counts.join(far, "word").groupBy(key).agg(F.sum(F.col("times") * (size - F.least("d", size))).alias("kept"), F.sum(F.col("times") * size).alias("all"))
    out = texts.select(F.col(key).alias("__k")).distinct().join(summed, F.col("__k").eqNullSafe(F.col(key)), "left")
    return out.select(F.col("__k").alias(key), F.coalesce(F.col("kept") / F.col("all"), F.lit(0.0)).alias("share"))
