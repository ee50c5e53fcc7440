"""Near-duplicates by SimHash and deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32.  Of two fingerprints at distance three or less, one segment
differs in at most one bit, so the two share that segment with one bit masked out.  Every distinct fingerprint is
therefore indexed under its 64 one-wildcard segments; equal keys are brought together and each candidate is verified
by its full distance.  Within a key only a spanning forest of the verified links goes on, never all pairs.  A key held
by more than ``run_limit`` fingerprints is cut again, by one-wildcard variants of the two halves of its other segment;
what then shares a key agrees in 46 bits, so no group can exceed 2**18 fingerprints.  Connected components come from
alternating large-star and small-star steps on the links, checkpointed after each round, until all are stars.

Null and empty texts have the fingerprint zero and are linked like any other.  A text may have any length: its shingles are
in one task's memory.  A bit that is set in exactly half of the hashes is zero.  Repeated rows have one fingerprint and fall
into one component; of rows with equal ids any one is kept by :func:`keep_one`.  A component whose ids are all null has a null
id.  Input columns of any names may be there.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common

DISTANCE = 3
RUN_LIMIT = 1024
#: Rows of one fingerprint that may meet in a task, and how many fingerprints may have more.
HOT_ROWS, MOST_HOT = 1000, 10_000


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of the word shingles, repeats included, as an unsigned number."""
    words = (text or b"").translate(common.LOWER).split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*[words[k:] for k in range(width)])) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return voted(np.fromiter((digest(g, seed) for g in grams), np.uint64, max(1, len(words) - width + 1)))


def voted(hashes: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is set if it is in over half of them."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 16384):
        part = hashes[at : at + 16384]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and ``fp``, the fingerprint as a signed long."""

    def make():
        def run(texts: list) -> dict:
            seen: dict = {}
            for t in texts:
                if t not in seen:
                    fp = fingerprint(t)
                    seen[t] = fp - (fp >> 63 << 64)
            return {"fp": [seen[t] for t in texts]}

        return run

    return common.map_text(docs, make, [("fp", "bigint")], text, keep)


def _forest(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smaller-index representative) that span each verified component within runs of equal keys."""
    n = len(keys)
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if n else np.zeros(0, np.int64)
    left = np.repeat(np.r_[starts[1:], n] - starts, np.r_[starts[1:], n] - starts) - (np.arange(n) - np.repeat(starts, np.r_[starts[1:], n] - starts))
    label = np.arange(n)
    froms, tos, d = [], [], 1
    live = np.flatnonzero(left > 1)
    while len(live):
        near = np.bitwise_count(fps[live] ^ fps[live + d]) <= DISTANCE
        if near.any():
            froms.append(live[near])
            tos.append(live[near] + d)
        d += 1
        live = live[left[live] > d]
        if sum(map(len, froms)) > 2_000_000:  # fold what is known so far, so memory stays bounded
            label = spread(label, np.concatenate(froms), np.concatenate(tos))
            froms, tos = [np.flatnonzero(label != np.arange(n))], [label[label != np.arange(n)]]
    if froms:
        label = spread(label, np.concatenate(froms), np.concatenate(tos))
    linked = np.flatnonzero(label != np.arange(n))
    return fps[linked], fps[label[linked]]


def spread(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(keyed: DataFrame, n_keys: int, limit: int | None) -> DataFrame:
    """keyed: long columns k0.. and fp, clustered and sorted by key.  Rows (a, b, k) : a link, or with k set a deferred member."""
    names = [f"k{i}" for i in range(n_keys)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, k=None):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(k, pa.int64()) if k is not None else pa.nulls(len(a), pa.int64())], names=["a", "b", "k"])

        held_k, held_f, hot = np.zeros((0, n_keys), np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            keys = np.concatenate([held_k, np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])])
            fps = np.concatenate([held_f, batch.column("fp").to_numpy(zero_copy_only=False)])
            if hot is not None:
                same = (keys == hot).all(axis=1)
                if same.any():
                    yield out(fps[same], fps[same], keys[same][:, 0])
                    keys, fps = keys[~same], fps[~same]
                    if not len(keys):
                        held_k, held_f = keys, fps
                        continue
                hot = None
            last = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys != keys[-1]).any() else 0
            held_k, held_f = keys[last:], fps[last:]
            keys, fps = keys[:last], fps[:last]
            if limit is not None:
                if len(held_f) > limit:
                    hot = held_k[0].copy()
                    yield out(held_f, held_f, held_k[:, 0])
                    held_k, held_f = held_k[:0], held_f[:0]
                if len(keys):
                    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
                    sizes = np.diff(np.r_[starts, len(keys)])
                    big = np.repeat(sizes > limit, sizes)
                    if big.any():
                        yield out(fps[big], fps[big], keys[big][:, 0])
                        keys, fps = keys[~big], fps[~big]
            if len(keys):
                yield out(*_forest(keys, fps))
        if len(held_f):
            yield out(*_forest(held_k, held_f))

    return keyed.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "a long, b long, k long")


def links(fps: DataFrame, run_limit: int = RUN_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join exactly the components of distance three or less."""
    mask = F.lit(0xFFFFFFFF)
    # tag 0-31: the upper half with that bit masked out; 32-63: the lower half
    tags = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("tag"))
    half = F.when(F.col("tag") < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(mask))
    masked = half.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, tag % 32)")))
    keyed = tags.select("fp", (masked * 64 + F.col("tag")).alias("k0"))
    first = common.checkpoint(_links(keyed, 1, run_limit).distinct())
    crowded = first.filter("k is not null").select(F.col("a").alias("fp"), F.col("k").alias("k0"))
    again = crowded.select("fp", "k0", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("tag"))
    other = F.when(F.col("k0") % 64 < 32, F.col("fp").bitwiseAND(mask)).otherwise(F.shiftrightunsigned("fp", 32))
    quarter = F.when(F.col("tag") < 16, F.shiftrightunsigned(other, 16)).otherwise(other.bitwiseAND(F.lit(0xFFFF)))
    masked = quarter.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, tag % 16)")))
    deep = _links(again.select("fp", "k0", (masked * 32 + F.col("tag")).alias("k1")), 2, None)
    return first.filter("k is null").select("a", "b").union(deep.select("a", "b"))


def _stars(e: DataFrame) -> bool:
    """Whether each u of the distinct edges (u, v) has one v, and no v is a u."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(e.select("v", F.lit(0)))
    met = ends.groupBy("x").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return not met.agg(F.max((F.col("up") > 1) | (F.col("up") > 0) & (F.col("n") > F.col("up")))).first()[0]


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = common.checkpoint(e)
    for _ in range(rounds):
        if _stars(e):
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(low, both.u == low.w).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        met = large.join(low, large.u == low.w)
        small = met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        e = common.checkpoint(small)
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def components(keyed: DataFrame, id_col: str = "doc_id", run_limit: int = RUN_LIMIT) -> DataFrame:
    """For each distinct fingerprint in keyed (fp, id_col): (fp, component_id), the smallest id reachable."""
    distinct = common.checkpoint(keyed.groupBy("fp").agg(F.min(id_col).alias("low")))
    roots = connected_components(links(distinct.select("fp"), run_limit))
    named = roots.join(distinct, roots.node == distinct.fp).select("node", "root", "low")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = named.join(lowest, "root").select(F.col("node").alias("fp"), "component_id")
    return distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", run_limit: int = RUN_LIMIT) -> DataFrame:
    """One row for each document: its id, ``fingerprint`` in 16 hex digits and ``component_id``."""
    keyed = common.checkpoint(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")), "t", ["id"]))
    found = common.checkpoint(components(keyed, "id", run_limit))
    # a fingerprint with more rows than this is looked up where its rows are; there are at most MOST_HOT of them
    rows = keyed.groupBy("fp").agg(F.count("*").alias("n"))
    most = max(HOT_ROWS, -(-keyed.count() // MOST_HOT))
    hot = found.join(rows.filter(F.col("n") > most).select("fp"), "fp", "left_semi").withColumn("hot", F.lit(True))
    marked = keyed.join(F.broadcast(hot), "fp", "left")
    cool = marked.filter("hot is null").select("id", "fp").join(found, "fp", "left")
    out = marked.filter("hot").select("id", "fp", "component_id").unionByName(cool.select("id", "fp", "component_id"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", run_limit: int = RUN_LIMIT) -> DataFrame:
    """The documents without their near-copies: of each component the row with the smallest id (null last), one row only."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*inner)
    table = common.written(fingerprints(own, inner[docs.columns.index(text)]).withColumn("__row", F.monotonically_increasing_id()))
    keyed = table.select("fp", F.col(inner[docs.columns.index(id_col)]).alias("id"), "__row")
    found = components(keyed, "id", run_limit).withColumnRenamed("fp", "__fp")
    # exact groups first: each fingerprint's best row, by partial aggregation; then the best of each component
    best = keyed.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "__row")).alias("best"))
    place = F.xxhash64("component_id", F.when(F.col("component_id").isNull(), F.col("fp")))
    first = best.join(found, best.fp == found.__fp).groupBy("component_id", place).agg(F.min("best").alias("best"))
    return table.join(first.select(F.col("best.__row").alias("__row")), "__row", "left_semi").select(*[F.col(i).alias(c) for i, c in zip(inner, docs.columns, strict=True)])
