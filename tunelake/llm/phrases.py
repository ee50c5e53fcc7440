"""Collocations: phrases of two words or more that stand out in their language, mined from FM-indexes of word ids.

A task cuts its texts into pieces at punctuation and line ends and gathers the words of each language into shards of about
``SHARD_WORDS`` words.  Each shard gets a bidirectional FM-index: the Burrows-Wheeler transforms of its word numbers and of
their reverse, each in a wavelet matrix with ranks.  Rows are ordered by as many words as the longest phrase has, which is
all that intervals of such phrases depend on.  An index is a row of a written table, so no later pass reads a text.

Phrases are enumerated a length at a time.  Every interval is extended by all words that follow (to even lengths) or precede
(to odd lengths) at once, by one descent of a wavelet matrix, with the interval in the other direction kept in step.  Counts
are summed across shards, phrases with fewer than ``min_count`` occurrences go, and only what is frequent is extended: both
parts of a phrase that are one word shorter must be.  Tasks test that with a bitmap of 2**``bits`` places for each length, of
fixed size whatever the corpus: a place that is shared lets a phrase through to the exact sums, none is ever lost.

Words are known across shards by XXH64 of language and word; two frequent words of one id raise an error.
A phrase that lies in a longer candidate with at least ``share`` percent of its count is dropped; as counts fall with length,
the candidates one word longer decide.  Products are decimals of 38 digits, exact for counts below 10**16.

Null texts are empty, a null language is ``und``; texts without words add nothing, an empty table gives an empty result.
Repeated rows count as often as they occur.  A text may have any length: more words than a shard holds are cut, with an
overlap that a shard of weight -1 takes back.  Ties go by count, then phrase.  Other columns aren't read.
"""

from __future__ import annotations

import copy
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from . import common
from .ranks import Ranks

MIN_COUNT = 10
MAX_WORDS = 3
SHARE = 50
TOP = 2000
SHARD_WORDS = 1 << 18
CHUNK_BYTES = 1 << 20
PART = 1 << 17
#: Row groups of a few shards, so that a task that reads them needn't hold many.
GROUPS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "2"}
BITS = 26
MARK = b"\xff"
#: A-Z become a-z, a tab a blank, and every byte that ends a piece one that no UTF-8 text holds.
PIECES = bytes(b + 32 if 65 <= b <= 90 else 255 if b in b".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b for b in range(256))


def tokens(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, with a mark at each piece's end, in lists of about a megabyte of text that end with a piece where they can."""
    text, at = (text or b"").translate(PIECES), 0
    while at < len(text):
        end = len(text)
        if end - at > CHUNK_BYTES:
            end = text.rfind(MARK, at, at + CHUNK_BYTES) + 1 or end
        # split() would also cut at white space that isn't a blank, but all of that is a mark by now
        yield text[at:end].replace(MARK, b" \xff ").split()
        at = end


class Wavelet:
    """A sequence of symbols that tells the distinct symbols of any range and their ranks."""

    def __init__(self, n: int, n_symbols: int, levels: list[Ranks]):
        self.n, self.levels = n, levels
        self.zeros = [n - int(r(np.array([n]))[0]) for r in levels]
        at, depth = np.zeros(n_symbols, np.int64), len(levels)
        for k, (ranks, zeros) in enumerate(zip(levels, self.zeros, strict=True)):
            ones = ranks(at)
            at = np.where((np.arange(n_symbols) >> depth - 1 - k & 1).astype(bool), zeros + ones, at - ones)
        self.first = at

    @staticmethod
    def bits(symbols: np.ndarray, n_symbols: int) -> np.ndarray:
        """The levels' bits as 64-bit words, one row a level."""
        out, now = [], symbols
        for level in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            out.append(Ranks(bit).words)
            now = np.concatenate([now[~bit], now[bit]])
        return np.stack(out)

    @classmethod
    def load(cls, n: int, n_symbols: int, words: np.ndarray) -> Wavelet:
        return cls(n, n_symbols, [Ranks.of_words(w) for w in words.reshape(-1, n // 64 + 1)])

    def extensions(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each distinct symbol of each range: (range, symbol, rank at low, rank at high, smaller symbols in the range)."""
        which, symbol, below = np.arange(len(low)), np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for ranks, zeros in zip(self.levels, self.zeros, strict=True):
            a, b = ranks(low), ranks(high)
            off = high - low - (b - a)
            left, right = np.flatnonzero(off > 0), np.flatnonzero(b > a)
            which = np.concatenate([which[left], which[right]])
            symbol = np.concatenate([symbol[left] << 1, symbol[right] << 1 | 1])
            below = np.concatenate([below[left], below[right] + off[right]])
            low, high = np.concatenate([low[left] - a[left], zeros + a[right]]), np.concatenate([high[left] - b[left], zeros + b[right]])
        return which, symbol, low - self.first[symbol], high - self.first[symbol], below


def order_by(symbols: np.ndarray, n_symbols: int, depth: int) -> np.ndarray:
    """Positions in the order of the next ``depth`` symbols."""
    bits, n = max(1, int(n_symbols - 1).bit_length()), len(symbols)
    key, width, done = np.zeros(n, np.int64), 0, 0
    while done < depth:
        if width + bits > 62:  # numbers of the distinct keys so far make room
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            width = int(key.max()).bit_length()
        key <<= bits
        key[: max(n - done, 0)] |= symbols[done:]
        width, done = width + bits, done + 1
    return np.argsort(key)


def index(symbols: np.ndarray, n_symbols: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The bits of both transforms of a text whose pieces end with symbol 0: of what precedes, and of what follows."""
    back = np.concatenate([symbols[:-1][::-1], symbols[-1:]])
    return tuple(Wavelet.bits(t[order_by(t, n_symbols, depth) - 1], n_symbols) for t in (symbols, back))


class Phrases:
    """Intervals of phrases in both transforms, extended a word at a time."""

    def __init__(self, counts: np.ndarray, left: np.ndarray, right: np.ndarray):
        """counts: of the symbols from 0; left, right: the bits of both transforms."""
        self.start, n = np.r_[0, np.cumsum(counts)].astype(np.int64), int(counts.sum())
        self.sides = [Wavelet.load(n, len(counts), w) for w in (left, right)]
        self.words = np.arange(1, len(counts))[:, None]
        self.at = [self.start[1:-1], self.start[1:-1]]
        self.size = np.diff(self.start)[1:]

    def parts(self, limit: int = PART) -> Iterator[Phrases]:
        """The phrases in parts that occur about so often together: each can be extended by itself, in bounded memory."""
        nth = np.cumsum(self.size) // limit
        for own in np.split(np.arange(len(nth)), np.flatnonzero(np.diff(nth)) + 1):
            part = copy.copy(self)
            part.at = list(self.at)
            part.keep(own)
            yield part

    def keep(self, which: np.ndarray) -> None:
        self.words, self.at, self.size = self.words[which], [a[which] for a in self.at], self.size[which]

    def extend(self, side: int) -> None:
        """All phrases one word longer; side 0: by the words that precede, 1: by those that follow."""
        which, symbol, low, high, below = self.sides[side].extensions(self.at[side], self.at[side] + self.size)
        own = np.flatnonzero(symbol > 0)
        which, symbol, low, high, below = which[own], symbol[own], low[own], high[own], below[own]
        other = self.at[1 - side][which] + below
        self.at[side], self.at[1 - side], self.size = self.start[symbol] + low, other, high - low
        both = (self.words[which], symbol[:, None])
        self.words = np.hstack(both if side else both[::-1])


def place(ids: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap's place of each phrase, a row of unsigned word ids."""
    out = ids[:, 0].copy()
    for k in range(1, ids.shape[1]):
        turn = np.uint64(21 * k % 63 + 1)
        out ^= ids[:, k] << turn | ids[:, k] >> np.uint64(64) - turn
    return out & np.uint64((1 << bits) - 1)


def place_column(columns: list[str], bits: int) -> Column:
    out = F.col(columns[0])
    for k in range(1, len(columns)):
        turn = 21 * k % 63 + 1
        out = out.bitwiseXOR(F.shiftleft(columns[k], turn).bitwiseOR(F.shiftrightunsigned(columns[k], 64 - turn)))
    return out.bitwiseAND(F.lit((1 << bits) - 1))


def known(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = place(ids, int(len(bitmap) * 64 - 1).bit_length())
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap(grams: DataFrame, bits: int) -> np.ndarray:
    """The places of the frequent phrases of one length; at most 2**bits / 64 rows reach the driver."""
    p = place_column([c for c in grams.columns if c[0] == "w"], bits)
    words = grams.select(p.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("b")).toArrow()
    out = np.zeros((1 << bits) // 64, np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


SHARD = "lang string, weight int, n bigint, vocabulary binary, ids binary, counts binary, left binary, right binary"


def _shard(lang: str, weight: int, numbers: dict, parts: list[np.ndarray], depth: int) -> dict:
    import xxhash

    symbols = np.concatenate(parts).astype(np.int64)
    symbols = symbols[(symbols > 0) | (np.r_[0, symbols[:-1]] > 0)]
    vocabulary = [w for w in numbers if w != MARK]
    counts = np.bincount(symbols, minlength=len(numbers))
    prefix = lang.encode() + b"\t"
    ids = np.fromiter((xxhash.xxh64_intdigest(prefix + w) for w in vocabulary), np.uint64, len(vocabulary))
    left, right = index(symbols, len(numbers), depth)
    return {"lang": lang, "weight": weight, "n": int(counts[1:].sum()), "vocabulary": b" ".join(vocabulary), "ids": ids.tobytes(), "counts": counts.astype(np.int64).tobytes(), "left": left.tobytes(), "right": right.tobytes()}


def shards(docs: DataFrame, text: str = "text", lang: str = "lang", depth: int = MAX_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The FM-indexes of all texts, one row a shard, as a written table."""
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("l"), F.col(text).cast("string").alias("t"))
    schema = T._parse_datatype_string(SHARD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(schema)
        fresh = lambda: (defaultdict(itertools.count(1).__next__, {MARK: 0}), [], [0])
        open_ = defaultdict(fresh)

        def done(key: tuple[str, int]) -> Iterator[pa.RecordBatch]:
            numbers, parts, _ = open_.pop(key)
            if len(numbers) > 1:
                yield pa.RecordBatch.from_pylist([_shard(*key, numbers, parts, depth)], schema=wanted)

        def add(key: tuple[str, int], words: list[bytes]) -> Iterator[pa.RecordBatch]:
            numbers, parts, size = open_[key]
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            parts.append(np.zeros(1, np.int32))
            size[0] += len(words) + 1
            if size[0] >= shard_words:
                yield from done(key)
            elif sum(s[0] for _, _, s in open_.values()) >= 4 * shard_words:  # many languages
                yield from done(max(open_, key=lambda k: open_[k][2][0]))

        for batch in batches:
            langs, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            for l, t in zip(langs, texts, strict=True):  # noqa: E741
                for words in tokens(t.as_py()):
                    for at in range(0, len(words), shard_words):
                        end = at + shard_words
                        yield from add((l.as_py(), 1), words[at : end + depth - 1])
                        if words[end:]:
                            yield from add((l.as_py(), -1), words[end : end + depth - 1])
        for key in list(open_):
            yield from done(key)

    return common.written(source.mapInArrow(run, schema), **GROUPS)


def words(own: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """The frequent words of all shards: w0 (the id), f, lang, say (its text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                vocabulary = r["vocabulary"].split(b" ")
                n = np.frombuffer(r["counts"], np.int64)[1:] * r["weight"]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["ids"], np.int64)), pa.array(n), pa.array([r["lang"]] * len(n), pa.string()), pa.array(vocabulary, pa.binary()).cast(pa.string())], ["w0", "n", "lang", "say"])

    rows = own.select("lang", "weight", "vocabulary", "ids", "counts").mapInArrow(run, "w0 bigint, n bigint, lang string, say string")
    found = common.written(rows.groupBy("w0", "lang", "say").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count))
    if found.groupBy("w0").count().filter("count > 1").head(1):
        raise ValueError("two frequent words share an id")
    return found


def grams(own: DataFrame, k: int, maps: list, min_count: int = MIN_COUNT) -> DataFrame:
    """The frequent phrases of k words: w0.. (the ids), f; maps: broadcast bitmaps of the shorter ones, by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                ids = np.r_[np.zeros(1, np.uint64), np.frombuffer(r["ids"], np.uint64)]
                for found in Phrases(*(np.frombuffer(r[c], t) for c, t in (("counts", np.int64), ("left", np.uint64), ("right", np.uint64)))).parts():
                    for j in range(1, k):
                        found.keep(known(maps[j - 1].value, ids[found.words]))
                        found.extend(j % 2)
                    own = ids[found.words]
                    # what it was extended from is frequent; so must the part at its other end be
                    kept = known(maps[k - 2].value, own[:, 1:] if k % 2 == 0 else own[:, :-1])
                    columns = [pa.array(np.ascontiguousarray(own[kept, j]).view(np.int64)) for j in range(k)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array((found.size[kept] * r["weight"]).astype(np.int32))], [*[f"w{j}" for j in range(k)], "n"])

    names = [f"w{j}" for j in range(k)]
    rows = own.select("weight", "ids", "counts", "left", "right").mapInArrow(run, ", ".join(f"{c} bigint" for c in names) + ", n int")
    return common.written(rows.groupBy(*names).agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count))


def best(rows: DataFrame, by: list[str], order: list[Column], top: int, salt: Column) -> DataFrame:
    """The first rows of each group: of ever fewer parts of it, so that no task holds a group of any size."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("__salt", salt)
    while True:
        parts = max(1, parts)
        rows = rows.withColumn("__part", F.pmod("__salt", F.lit(parts)))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
        if parts == 1:
            return rows.drop("__salt", "__part")
        parts //= 64


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, share: int = SHARE, top: int = TOP, bits: int = BITS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a (its count), l and r (of the parts at its weakest cut), n (all words),
    score, and what follows and precedes it: the counts of the most frequent candidates one word longer to the right and left."""
    spark = docs.sparkSession
    own = shards(docs, text, lang, max_words, shard_words)
    levels, maps = [words(own, min_count)], []
    for k in range(2, max_words + 1):
        maps.append(spark.sparkContext.broadcast(bitmap(levels[-1], bits)))
        levels.append(grams(own, k, maps, min_count))
    for m in maps:
        m.unpersist()
    flat = [w.select(*[c for c in w.columns if c[0] == "w"], "f") for w in levels]

    def part(df: DataFrame, at: int, size: int, name: str) -> DataFrame:
        """df with the count of its words at..at+size, of which the frequent words also have their text."""
        keys = [f"w{at + j}" for j in range(size)]
        other = levels[0].select("w0", "f", "lang", "say").toDF(keys[0], name, f"lang{at}", f"t{at}") if size == 1 else flat[size - 1].toDF(*keys, name)
        return df.join(other, keys)

    out = None
    for k in range(2, max_words + 1):
        df = flat[k - 1].withColumnRenamed("f", "a")
        for at in range(k):  # word by word first: the texts come with the counts
            df = part(df, at, 1, f"f{at}_1")
        for size in range(2, k):
            for at in range(k - size + 1):
                if at in (0, k - size):
                    df = part(df, at, size, f"f{at}_{size}")
        wide = F.col("a").cast("decimal(19,0)")
        product = lambda x, y: F.col(x).cast("decimal(19,0)") * F.col(y).cast("decimal(19,0)")
        cut = [F.struct(F.call_function("div", (wide * wide * 1_000_000).cast("decimal(38,0)"), product(f"f0_{j}", f"f{j}_{k - j}")).cast("long").alias("score"), F.lit(j).alias("k"), F.col(f"f0_{j}").alias("l"), F.col(f"f{j}_{k - j}").alias("r")) for j in range(1, k)]
        weakest = F.least(*cut) if len(cut) > 1 else cut[0]
        keys = [f"w{j}" for j in range(k)]
        if k < max_words:
            longer = flat[k]
            ends = [longer.select(*[F.col(f"w{j + s}").alias(f"w{j}") for j in range(k)], *[(F.col("f") if s == side else F.lit(0)).alias(side_name) for side, side_name in ((0, "next"), (1, "previous"))]) for s in (0, 1)]
            df = df.join(ends[0].union(ends[1]).groupBy(*keys).agg(F.max("next").alias("next"), F.max("previous").alias("previous")), keys, "left").fillna(0, ["next", "previous"])
        else:
            df = df.withColumns({"next": F.lit(0), "previous": F.lit(0)})
        df = df.filter(100 * F.greatest("next", "previous") < share * F.col("a"))
        df = df.select(F.col("lang0").alias("lang"), F.concat_ws(" ", *[f"t{j}" for j in range(k)]).alias("phrase"), "a", weakest.alias("c"), F.col("next").cast("long"), F.col("previous").cast("long"))
        out = df if out is None else out.union(df)
    rows = out.select("lang", "phrase", "a", "c.l", "c.r", "c.score", "next", "previous")
    rows = best(rows, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, F.xxhash64("phrase"))
    total = own.groupBy("lang").agg(F.sum(F.col("n") * F.col("weight")).alias("n"))
    return rows.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "next", "previous")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT d, lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
words AS (SELECT lang, list_value(x) AS g, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (SELECT * FROM words UNION ALL SELECT lang, g, count(*) AS f FROM (SELECT lang, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (2), (3)) v(k))) GROUP BY ALL),
often AS (SELECT * FROM grams WHERE f >= 10),
cuts AS (SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM often WHERE len(g) > 1) c JOIN often x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN often y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
weakest AS (SELECT lang, g, a, arg_min(struct_pack(l := l, r := r, score := score), (score, k)) AS c FROM cuts GROUP BY ALL),
longer AS (SELECT lang, g, max(nxt) AS nxt, max(previous) AS previous FROM (SELECT lang, g[1:len(g) - 1] AS g, f AS nxt, 0 AS previous FROM often WHERE len(g) > 2 UNION ALL SELECT lang, g[2:], 0, f FROM often WHERE len(g) > 2) GROUP BY ALL),
kept AS (SELECT w.lang, array_to_string(w.g, ' ') AS phrase, a, c.l AS l, c.r AS r, c.score AS score, coalesce(nxt, 0) AS "next", coalesce(previous, 0) AS previous
  FROM weakest w LEFT JOIN longer USING (lang, g) WHERE 100 * greatest(coalesce(nxt, 0), coalesce(previous, 0)) < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score, CAST("next" AS BIGINT) AS "next", CAST(previous AS BIGINT) AS previous
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= 2000"""
