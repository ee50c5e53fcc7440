"""Benchmark decontamination by FM-indexes over training shards.

A task cuts its documents into shards of about ``shard_words`` words.  Each shard gets an FM-index at word level: a
suffix array by prefix doubling, its Burrows-Wheeler transform in a wavelet matrix with block ranks, and suffix
positions sampled every ``SAMPLE`` words.  All test phrases are searched backwards at once; occurrences are located by
walking to the next sampled position; the spans found are merged for each document.  Documents enter the index in
blocks that overlap by one word less than the longest phrase, each with a terminator of its own, so every phrase lies
whole within some block and suffixes are told apart after a block's length at most.  A very long document simply
spans several shards' worth of blocks, its words counted once.

Test phrases go to the tasks in blocks of about ``PHRASE_BYTES``, so that what is broadcast stays bounded whatever the
benchmark's size; an item that is longer is cut between its windows.  With more than one block the shards' indexes are
written as a table, once, and every block is searched in them.

Null and empty texts have no words and no hits; null or wordless benchmark items have no phrases.  Repeated items count
by their id, repeated documents are separate rows.  Occurrences that overlap or tie are merged.  New columns replace input
columns of the same name.  An empty table of documents gives an empty result, an empty benchmark gives zero hits.
"""

from __future__ import annotations

import functools
import itertools
import pickle
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import common
from .ranks import Ranks

WINDOW = 13
SAMPLE = 16
BLOCK = 256
SHARD_WORDS = 400_000
PHRASE_BYTES = 2 << 20
#: Every byte that isn't part of a word becomes a space; A-Z become a-z.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


def suffix_order(symbols: np.ndarray, n_symbols: int) -> np.ndarray:
    """The suffix array; symbol 0 ends a block, and each such end sorts by its place, before all other symbols."""
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    first = symbols.astype(np.int64) + len(ends) - 1
    first[ends] = np.arange(len(ends))
    bits = int(len(ends) + n_symbols).bit_length()
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[: max(n - k, 0)] |= first[k:]
    order = np.argsort(key, kind="stable" if n < 16 else None)
    rank, fresh = np.empty(n, np.int64), np.empty(n, bool)
    fresh[0], fresh[1:] = True, key[order[1:]] != key[order[:-1]]
    group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = group
    open_ = np.flatnonzero(~fresh | ~np.r_[fresh[1:], True])
    depth = width
    while len(open_):
        at = order[open_]
        key = group[open_] * np.int64(n + 1) + rank[np.minimum(at + depth, n - 1)]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[open_] = at
        fresh = np.r_[True, key[1:] != key[:-1]]
        now = np.maximum.accumulate(np.where(fresh, open_, 0))
        group[open_] = now
        rank[at] = now
        open_ = open_[~fresh | ~np.r_[fresh[1:], True]]
        depth *= 2
    return order


class FMIndex:
    """Backward search and sampled location over blocks of symbols 1.., each ended by 0."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        """offsets: each position's place within its block; places divisible by sample are kept."""
        self.n = len(symbols)
        order = suffix_order(symbols, n_symbols)
        self.last = symbols[order - 1]
        self.start = np.r_[0, np.cumsum(np.bincount(symbols, minlength=n_symbols))].astype(np.int64)
        self.sampled = offsets[order] % sample == 0
        self.place = Ranks(self.sampled)
        self.kept = order[self.sampled]
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.levels, self.zeros, now = [], [], self.last
        for level in range(self.depth - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            self.levels.append(Ranks(bit))
            self.zeros.append(self.n - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each of its positions; at: (k, symbols)."""
        now = np.concatenate([np.zeros((1, len(symbol)), np.int64), at])
        for level, ranks, zeros in zip(range(self.depth - 1, -1, -1), self.levels, self.zeros, strict=True):
            ones = ranks(now)
            now = np.where((symbol >> level & 1).astype(bool), zeros + ones, now - ones)
        return now[1:] - now[0]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows [low, high) of the phrases (one a row) that occur: (phrase, low, high)."""
        live = np.flatnonzero((phrases > 0).all(axis=1))
        span = np.stack([np.zeros(len(live), np.int64), np.full(len(live), self.n)])
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, k]
            span = self.start[symbol] + self.rank(symbol, span)
            some = span[0] < span[1]
            live, span = live[some], span[:, some]
            if not len(live):
                break
        return live, span[0], span[1]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of rows, by steps back to a sampled one."""
        out, steps = np.empty(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            known = self.sampled[rows]
            out[left[known]] = self.kept[self.place(rows[known])] + steps
            left, rows = left[~known], rows[~known]
            symbol = self.last[rows]
            rows = self.start[symbol] + self.rank(symbol, rows[None])[0]
            steps += 1
        return out


class Phrases:
    """Windows of the test items: word numbers by length, and the items of each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
        windows: dict[tuple, set] = defaultdict(set)
        for item, text in items:
            ids = [numbers[w] for w in words_of(text)]
            for at in range(max(1, len(ids) - window + 1)) if ids else ():
                windows[tuple(ids[at : at + window])].add(item)
        self.vocabulary = list(numbers)
        self.by_length = {}
        for n in sorted({len(w) for w in windows}):
            own = [w for w in windows if len(w) == n]
            self.by_length[n] = (np.array(own, np.int64), [windows[w] for w in own])
        self.longest = max(self.by_length, default=1)


class Shard:
    """The FM-index of a shard's documents, and where its positions lie in them."""

    def __init__(self, docs: list[list[bytes]], longest: int):
        """longest: the words of the longest phrase that may be searched."""
        numbers: dict[bytes, int] = defaultdict(itertools.count(1).__next__)
        lengths = np.array([len(d) for d in docs])
        flat = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(docs)), np.int32, int(lengths.sum()))
        first = np.r_[0, np.cumsum(lengths)]
        # blocks: [begin, end) in flat, every one within a document and overlapping the next
        step = BLOCK
        counts = np.where(lengths > 0, np.maximum(1, -(-(lengths - (longest - 1)) // step)), 0)
        doc = np.repeat(np.arange(len(docs)), counts)
        nth = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)
        begin = first[doc] + nth * step
        end = np.minimum(begin + step + longest - 1, first[doc + 1])
        size = end - begin + 1
        top = np.r_[0, np.cumsum(size)]
        inside = np.arange(top[-1]) - np.repeat(top[:-1], size)
        source = np.repeat(begin, size) + inside
        text = np.where(inside == np.repeat(size, size) - 1, 0, np.r_[flat, 0][source]).astype(np.int32)
        self.index, self.words, self.first, self.source = FMIndex(text, inside, len(numbers) + 1), list(numbers), first, source.astype(np.int32)

    def find(self, phrases: Phrases) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
        """(document, merged spans of words, items) for the documents in which any phrase occurs."""
        first, total, numbers = self.first, int(self.first[-1]), {w: k for k, w in enumerate(self.words, 1)}
        own = np.array([numbers.get(w, 0) for w in phrases.vocabulary], np.int64)
        hit, items = np.zeros(total + 1, np.int32), defaultdict(set)
        for n, (rows, of) in phrases.by_length.items():
            live, low, high = self.index.search(own[rows])
            many = high - low
            if not len(live):
                continue
            at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            place = self.source[self.index.locate(at)]
            where, phrase = np.searchsorted(first, place, "right") - 1, np.repeat(live, many)
            fresh = np.unique(np.stack([place, phrase]), axis=1)[0]  # overlaps of blocks show some twice
            np.add.at(hit, fresh, 1)
            np.add.at(hit, fresh + n, -1)
            for d, p in np.unique(np.stack([where, phrase]), axis=1).T:
                items[int(d)] |= of[int(p)]
        covered = np.cumsum(hit[:-1]) > 0
        for d, found in sorted(items.items()):
            edge = np.flatnonzero(np.diff(np.r_[False, covered[first[d] : first[d + 1]], False]))
            yield d, [(int(a), int(b)) for a, b in edge.reshape(-1, 2)], found


def find(shard: list[list[bytes]], phrases: Phrases) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
    """:meth:`Shard.find` of the documents of a shard, without an index if there is nothing to find."""
    if phrases.by_length and any(shard):
        yield from Shard(shard, phrases.longest).find(phrases)


def cut(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Rows of about so many words together, and their words; the text is the last column."""
    for batch in batches:
        shard, n, since = [], 0, 0
        texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
        for k in range(batch.num_rows):
            shard.append(words_of(texts[k].as_py()))
            n += len(shard[-1])
            if n >= shard_words:
                yield batch.slice(since, k + 1 - since), shard
                shard, n, since = [], 0, k + 1
        if shard:
            yield batch.slice(since), shard


#: Row groups of a shard or two, so that a task that reads indexes needn't hold many.
GROUPS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "2"}


def indexed(own: DataFrame, longest: int, shard_words: int) -> DataFrame:
    """A written table of the shards of own (row, t): ``rows``, their ``lengths`` in words, and the ``shard``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, shard in cut(batches, shard_words):
            made = pickle.dumps(Shard(shard, longest)) if any(shard) else None
            yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([[len(d) for d in shard]], pa.list_(pa.int64())), pa.array([made], pa.binary())], ["rows", "lengths", "shard"])

    return common.written(own.select("row", "t").mapInArrow(run, "rows array<bigint>, lengths array<bigint>, shard binary"), **GROUPS)


def _searched(shards: DataFrame, phrases) -> DataFrame:
    """(row, spans, items) of the documents in which any of the phrases occurs, from the indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = batch.column(0)[k].as_py()
                found = [(rows[d], [{"start": a, "end": b} for a, b in merged], sorted(items)) for d, merged, items in pickle.loads(batch.column(1)[k].as_py()).find(phrases.value)]
                if found:
                    row, spans, items = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))], ["row", "spans", "items"])

    return shards.select("rows", "shard").filter("shard IS NOT NULL").mapInArrow(run, "row bigint, spans array<struct<start:int, end:int>>, items array<string>")


OUT = "n_words bigint, spans array<struct<start:int, end:int>>, items array<string>"


def _pass(docs: DataFrame, keep: list[str], text: str, phrases, shard_words: int) -> DataFrame:
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], *T._parse_datatype_string(OUT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(schema)
        named = pa.schema([pa.field(f.name, f.type) for f in wanted])

        def done(part: pa.RecordBatch, shard: list) -> pa.RecordBatch:
            spans, items = [[] for _ in shard], [[] for _ in shard]
            for d, merged, found in find(shard, phrases.value):
                spans[d] = [{"start": a, "end": b} for a, b in merged]
                items[d] = sorted(found)
            columns = [*part.columns[:-1], [len(d) for d in shard], spans, items]
            return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, named, strict=True)], schema=named)

        for part, shard in cut(batches, shard_words):
            yield done(part, shard)

    return source.mapInArrow(run, schema)


def overlapping(text: bytes, window: int, limit: int) -> Iterator[bytes]:
    """The text in pieces of about limit bytes that together hold each of its windows of words."""
    words, since, size = words_of(text), 0, 0
    for k, w in enumerate(words):
        size += len(w) + 1
        if size > limit and k - since >= window:
            yield b" ".join(words[since:k])
            since = k - window + 1
            size = sum(len(x) + 1 for x in words[since : k + 1])
    yield b" ".join(words[since:])


def phrase_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", limit: int = PHRASE_BYTES, window: int = WINDOW) -> Iterator[list[tuple[str, bytes]]]:
    """The items with words, longer ones cut, in blocks of about limit bytes of text, streamed a partition at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).filter("t is not null").toLocalIterator():
        for piece in overlapping(row.t.encode(), window, limit):
            if block and size + len(piece) > limit:
                yield block
                block, size = [], 0
            block.append(("" if row.i is None else row.i, piece))
            size += len(piece)
    yield block


def occurrences(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, keep: list[str] | None = None, phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """For each document: the kept columns, n_words, the merged ``spans`` of words [start, end) and the ``items`` that occur."""
    keep = [c for c in (keep or [id_col]) if c.lower() not in ("n_words", "spans", "items")]
    share = lambda block: docs.sparkSession.sparkContext.broadcast(Phrases(block, window))
    blocks = phrase_blocks(benchmark, limit=phrase_bytes, window=window)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _pass(docs, keep, text, share(first), shard_words)
    # more phrases than one block: each shard is indexed once, for phrases of any length, and every block is searched in the
    # indexes; its hits are written before the next block is sent out, then they are joined by row
    inner = {f"c{i}": c for i, c in enumerate(keep)}
    own = common.written(docs.select(*[F.col(f"`{c}`").alias(i) for i, c in inner.items()], F.col(f"`{text}`").alias("t"), F.monotonically_increasing_id().alias("row")))
    shards = indexed(own.withColumn("t", F.col("t").cast("string")), window, shard_words)
    words, hits = shards.select(F.explode(F.arrays_zip("rows", "lengths")).alias("x")).select(F.col("x.rows").alias("row"), F.col("x.lengths").alias("n_words")), []
    for block in itertools.chain([first, second], blocks):
        phrases = share(block)
        hits.append(common.written(_searched(shards, phrases)))
        phrases.unpersist()
    met = functools.reduce(DataFrame.union, hits).groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.expr("""aggregate(spans, cast(array() as array<struct<start:int, end:int>>), (done, s) ->
        CASE WHEN size(done) > 0 AND s.start <= element_at(done, -1).end
             THEN concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end))))
             ELSE concat(done, array(s)) END)""")
    out = own.drop("t").join(words, "row").join(met.select("row", merged.alias("spans"), "items"), "row", "left")
    none = lambda c, kind: F.coalesce(F.col(c), F.expr(f"cast(array() as {kind})")).alias(c)
    return out.select(*[F.col(i).alias(c) for i, c in inner.items()], "n_words", none("spans", "array<struct<start:int,end:int>>"), none("items", "array<string>"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, **how) -> DataFrame:
    """The kept columns, n_words, n_hit, n_items, items_sha256 and contaminated: five words in a hundred are hit, one at least."""
    found = occurrences(docs, benchmark, id_col, text, keep=keep, **how)
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    own = [c for c in (keep or [id_col]) if c in found.columns and c not in ("n_words", "spans", "items")]
    return found.select(*[F.col(f"`{c}`") for c in own], "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The documents, whole, that aren't contaminated, with the columns they came with."""
    inner = [f"__{k}" for k in range(len(docs.columns))]
    named = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(docs.columns, inner, strict=True)])
    found = contamination(named, benchmark, inner[0], inner[docs.columns.index(text)], keep=inner, **how)
    return found.filter("NOT contaminated").select(*[F.col(i).alias(c) for c, i in zip(docs.columns, inner, strict=True)])


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the merged word spans, from each span's first word to its last."""
    if not text or not spans:
        return text
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def excised(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The documents with every merged span cut out of its text, for those who keep contaminated documents."""
    inner = [f"__{k}" for k in range(len(docs.columns))]
    own, at = docs.toDF(*inner), inner[docs.columns.index(text)]
    found = occurrences(own, benchmark, inner[0], at, keep=inner, **how)

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without_spans(t, [(s["start"], s["end"]) for s in of]) for t, of in zip(texts, spans, strict=True)], dtype=object)

    clean = F.when(F.size("spans") > 0, cut(F.col(at), F.col("spans"))).otherwise(F.col(at))
    return found.select(*[(clean if i == at else F.col(i)).alias(c) for i, c in zip(inner, docs.columns, strict=True)])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bw),
sizes AS (SELECT DISTINCT n FROM windows),
dw AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT DISTINCT r, item_id, i, n FROM (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM dw) JOIN windows USING (n, s)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)"""
