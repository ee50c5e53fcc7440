"""Quality rules: exact counts over whole texts, then an n-gram log-likelihood ratio against trusted documents.

Everything is DataFrame expressions.  A document fails the base rules if it has fewer than 50 words, or if more than half of
its words lie in three-word windows that occur twice or more in it.  Otherwise the verdict is the mean log-likelihood ratio
of its hashed words and word pairs between two multinomials over ``BUCKETS`` buckets with add-one smoothing: the trusted
target (documents labelled good) and the raw corpus (all documents).  Counts are over all documents; only their sums, one
pair for each bucket, reach the driver.  ``kept`` is a mean of ``THRESHOLD`` or more, the same for every document.

Null texts have no words, lines or symbols, so they fail.  A text may have any length; its words are in one row's memory.
A ratio equal to the threshold is kept.  Repeated windows are found by 64-bit hashes of their words.  Repeated rows are
counted as often as they occur; a document labelled more than once counts as trusted if any label says so, one with a null id
never does.  Columns besides the id and the text aren't read, so their names can't clash.
Without trusted documents every ratio is zero and the verdict is to keep.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, let

BUCKETS = 10_000
#: Bits of the bitmap of trusted ids, as a power of two; it has this size whatever their number.
ID_BITS = 22
THRESHOLD = -0.05
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES, -1), lambda w: w != "")


def _without(text: Column, marks: str) -> Column:
    for m in marks:
        text = F.replace(text, F.lit(m))
    return text


def repeated_words(w: Column) -> Column:
    """Words within three-word windows that occur twice or more, each word once."""
    hashes = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        places = F.sort_array(F.transform(let(ordered, twice), lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def buckets(w: Column, n: int = BUCKETS) -> Column:
    """The buckets of the words and of the word pairs."""
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(n)).cast("int"))
    two = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(x, F.get(w, i + 1)), F.lit(n)).cast("int"))
    return F.concat(one, two)


def maybe_in(column: Column, ids: DataFrame, bits: int = ID_BITS) -> Column:
    """False only for values that aren't among the ids (one column): a bitmap of their hashes, of bounded size, tested in place."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    words = ids.select(place(F.col(ids.columns[0])).alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("b"))
    found = {r.w: r.b for r in words.collect()}
    table = F.from_json(F.lit(json.dumps([found.get(w, 0) for w in range(1 << bits - 6)])), "array<bigint>")
    p = place(column)
    return F.getbit(F.get(table, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1


def ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = BUCKETS) -> list[float]:
    """Each bucket's log ratio of target to raw probability, from counts over all documents."""
    own = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))

    def counts(of: DataFrame) -> dict[int, int]:
        grams = of.select(F.explode(let(words(F.col("__text")), lambda w: buckets(w, n))).alias("b"))
        return {r.b: r.n for r in grams.groupBy("b").agg(F.count("*").alias("n")).collect()}

    raw = counts(own)
    ids = trusted.select(F.col(id_col).cast(dict(own.dtypes)["__id"]).alias("__id")).dropna().distinct()
    # texts that can't be trusted by the bitmap stay where they are; the others meet the ids in a shuffle, whatever their size
    good = counts(own.filter(maybe_in(F.col("__id"), ids)).join(ids.hint("shuffle_hash"), "__id", "left_semi"))
    if not good:
        return [0.0] * n
    all_raw, all_good = sum(raw.values()) + n, sum(good.values()) + n
    return [math.log((good.get(b, 0) + 1) / all_good) - math.log((raw.get(b, 0) + 1) / all_raw) for b in range(n)]


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: id, the base counts, base_failed, llr (null without words) and kept.

    trusted: a frame with the ids of the target documents.
    """
    table = F.from_json(F.lit(json.dumps(ratios(docs, trusted, id_col, text, n))), "array<double>")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        total = lambda b: F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(table, x)) / F.size(b)
        llr = F.when(F.size(w) > 0, let(buckets(w, n), total))
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"), llr.alias("llr"))

    counted = docs.select(
        F.col(id_col),
        let(words(t), of_words).alias("__w"),
        F.length(_without(t, BLANKS)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select(id_col, "__w.n_words", "word_chars", "n_symbols", "n_dup_lines", "__w.n_repeat_words", "__w.llr")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "llr", (~failed & (F.coalesce("llr", F.lit(0.0)) >= threshold)).alias("kept"))
