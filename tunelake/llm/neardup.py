"""Near-copies by word shingles: SimHash fingerprints and then MinHash bands propose pairs, the exact Jaccard similarity decides.

A text is the set of its five-word shingles (all its words where it has fewer).  Pairs come first from the fingerprints of the
sets, by the method of :mod:`.simhash`: deletion-variant signatures, equality of keys, links at three bits or less, and the sets
of one fingerprint in a chain.  Two sets at similarity 0.8 differ in more bits as a rule, so bands bring what is still apart: of two sets at similarity s, a band of four
minima is equal with probability s**4, so one of sixteen bands at least is with 0.9998 at 0.8.  Every pair with an equal band
is decided exactly.  A shingle that only one set has is in no intersection, so what a set holds besides bounds it: sets with
too many shingles of their own, and pairs that can't reach the similarity, go without a comparison.  With the pairs of the
fingerprints each band's members are compared with one of them that has few shingles of its own.  Bands whose members are
still apart then go to tasks in blocks of bounded weight, each block with each other, where products of incidence matrices
give all intersections; only a spanning forest of the links leaves a task.  So components are found twice: each time takes
the driver many jobs, whose plans it keeps.

Null texts count as empty.  Texts of one set, repeated rows and empty texts among them, are one node; of equal ids any one row
stays.  A text may have any length: its shingles are in one task's memory.  Columns of any names pass through.  An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common
from .simhash import connected_components, links as fingerprint_links, spread, voted

WIDTH = 5
#: A similarity as numerator and denominator, so that it is tested on whole numbers.
SIMILARITY = (4, 5)
BANDS, ROWS = 16, 4
#: Members of a band that all its others are compared with.
ROUNDS = 1
#: Shingles of a block, each set counting ``LEAST`` more; two blocks at most meet in a task.
BLOCK, LEAST = 1 << 20, 512


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of the word shingles, sorted."""
    words = (text or b"").translate(common.LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*[words[k:] for k in range(width)])) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of minima; none for an empty set."""
    if not len(hashes):
        return []
    rng = np.random.default_rng(7)
    salt, odd = rng.integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(low, ((hashes[at : at + 4096, None] ^ salt) * (odd | np.uint64(1))).min(axis=0), out=low)
    return [xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(low.reshape(BANDS, ROWS))]


def signatures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, ``fp`` (a hash of the shingle set), ``size``, ``bands`` and ``sim`` (its SimHash)."""

    def make():
        def run(texts: list) -> dict:
            seen: dict = {}
            for t in texts:
                if t not in seen:
                    s = shingles(t)
                    sim = voted(s)
                    seen[t] = xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63), len(s), bands(s), sim - (sim >> 63 << 64)
            fp, size, keys, sims = zip(*[seen[t] for t in texts]) if texts else ((), (), (), ())
            return {"fp": list(fp), "size": list(size), "bands": list(keys), "sim": list(sims)}

        return run

    return common.map_text(docs, make, [("fp", "bigint"), ("size", "int"), ("bands", "array<bigint>"), ("sim", "bigint")], text, keep)


def proposed(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints are linked, as far as their sizes (nodes: fp, size, sim) allow the similarity."""
    chain = Window.partitionBy("sim").orderBy("fp")
    same = nodes.select(F.lag(F.struct("fp", "size")).over(chain).alias("a"), F.struct("fp", "size").alias("b")).filter("a IS NOT NULL")
    first = nodes.groupBy("sim").agg(F.min(F.struct("fp", "size")).alias("first"))
    found = fingerprint_links(first.select(F.col("sim").alias("fp"))).filter("a <> b").select(F.col("a").alias("sim_a"), F.col("b").alias("sim_b")).distinct()
    for c in "ab":
        found = found.join(first.select(F.col("sim").alias(f"sim_{c}"), F.col("first").alias(c)), f"sim_{c}")
    high, low = SIMILARITY
    alike = same.union(found.select("a", "b")).filter(low * F.least("a.size", "b.size") >= high * F.greatest("a.size", "b.size"))
    return common.checkpoint(alike.select(F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b")).distinct())


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    for c in "ab":
        pairs = pairs.join(sets.select(F.col("fp").alias(c), F.col("set").alias(f"set_{c}")), c)
    both = F.size(F.array_intersect("set_a", "set_b"))
    high, low = SIMILARITY
    return common.checkpoint(pairs.filter(low * both >= high * (F.size("set_a") + F.size("set_b") - both)).select("a", "b"))


def linked(table: pa.Table) -> pa.Table:
    """Links (a, b) that span what is similar among rows (fp, root, block, set) of different roots, and blocks if there are two."""
    fp, root, block = (table.column(c).to_numpy() for c in ("fp", "root", "block"))
    lists = table.column("set").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size, m = np.diff(lists.offsets.to_numpy()), len(fp)
    _, number, often = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = often > 1
    kept = shared[number]
    number, owner = (np.cumsum(shared) - 1)[number[kept]], np.repeat(np.arange(m), size)[kept]
    order = np.argsort(number, kind="stable")
    number, owner, both = number[order], owner[order], np.zeros((m, m), np.float32)
    for at in range(0, int(shared.sum()), 4096):
        own = slice(*np.searchsorted(number, (at, at + 4096)))
        x = np.zeros((m, 4096), np.float32)
        x[owner[own], number[own] - at] = 1
        both += x @ x.T
    high, low = SIMILARITY
    near = (high + low) * both >= high * (size[:, None] + size)
    near &= root[:, None] != root
    if block.min(initial=0) < block.max(initial=0):
        near &= block[:, None] != block
    label = spread(np.arange(m), *np.nonzero(np.triu(near, 1)))
    moved = np.flatnonzero(label != np.arange(m))
    return pa.table({"a": pa.array(fp[moved], pa.int64()), "b": pa.array(fp[label[moved]], pa.int64())})


def _compared(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among the members (k, fp, size, root) of each key, block by block."""
    weight = F.col("size") + LEAST
    blocks = members.groupBy("k").agg(F.ceil(F.sum(weight) / BLOCK).cast("int").alias("n"))
    dealt = members.join(blocks, "k").withColumn("block", F.pmod(F.xxhash64("k", "fp"), F.col("n")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = met.select("k", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "root", "block")
    found = met.join(sets, "fp").select("k", "i", "j", "fp", "root", "block", "set").groupBy("k", "i", "j").applyInArrow(lambda t: linked(t), "a long, b long")
    return common.checkpoint(found.distinct())


def _can_reach(held: Column, sizes: Column) -> Column:
    """Sets of together so many shingles can be similar if the intersection is held at most."""
    return (SIMILARITY[0] + SIMILARITY[1]) * held >= SIMILARITY[0] * sizes


def components(table: DataFrame, text: str) -> DataFrame:
    """(node, root) for the sets with a near-copy; table: the text, __row, fp, size, bands, sim."""
    nodes = common.written(table.groupBy("fp").agg(F.min("__row").alias("__row"), *[F.first(c).alias(c) for c in ("size", "bands", "sim")]))
    pairs = proposed(nodes)
    keyed = common.written(nodes.select("fp", "size", "__row", F.explode("bands").alias("k")))
    shared = keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")
    keyed = common.written(keyed.join(shared, "k", "left_semi"))
    linked_too = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("fp")), "fp", "left_semi")
    own = table.join(keyed.select("__row").union(linked_too.select("__row")).distinct(), "__row", "left_semi").select("fp", text)

    def make():
        return lambda texts: {"set": [shingles(t).view(np.int64) for t in texts]}

    sets = common.written(common.map_text(own, make, [("set", "array<bigint>")], text, ["fp"]))
    alone = sets.select("fp", F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("fp").alias("fp")).filter("n = 1").groupBy("fp").agg(F.count("*").alias("alone"))
    keyed = keyed.join(alone, "fp", "left").select("k", "fp", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("held"))
    keyed = common.written(keyed.filter(_can_reach(F.col("held"), F.col("size") + F.col("held"))))
    a, b = (keyed.select("k", *[F.col(c).alias(f"{c}_{side}") for c in ("fp", "size", "held")]) for side in "ab")
    for turn in range(ROUNDS):
        first = F.lit(0) if turn else F.col("size_a") - F.col("held_a")
        pivot = a.groupBy("k").agg(F.min(F.struct(first, F.xxhash64("fp_a", F.lit(turn)).alias("h"), "fp_a", "size_a", "held_a")).alias("p"))
        met = b.join(pivot.select("k", "p.fp_a", "p.size_a", "p.held_a"), "k")
        met = met.filter((F.col("fp_a") != F.col("fp_b")) & _can_reach(F.least("held_a", "held_b"), F.col("size_a") + F.col("size_b")))
        pairs = pairs.union(met.select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b")))
    links = _near(pairs.distinct(), sets)
    roots = connected_components(links)
    at = common.written(keyed.join(roots, keyed.fp == roots.node, "left").select("k", "fp", "size", F.coalesce("root", "fp").alias("root")))
    apart = at.groupBy("k").agg((F.min("root") < F.max("root")).alias("more")).filter("more").select("k")
    # further links join components, so their roots stand for them
    further = _compared(at.join(apart, "k", "left_semi"), sets)
    return connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(further))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without their near-copies: of each component the row with the smallest id (null last), one row only."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    own, ids, body = docs.toDF(*inner), inner[docs.columns.index(id_col)], inner[docs.columns.index(text)]
    table = common.written(signatures(own, body).withColumn("__row", F.monotonically_increasing_id()))
    roots = components(table, body)
    # exact groups first: each set's best row, by partial aggregation; then the best of each component
    best = table.groupBy("fp").agg(F.min(F.struct(F.col(ids).isNull().alias("n"), F.col(ids).alias("id"), "__row")).alias("best"))
    first = best.join(roots, best.fp == roots.node, "left").groupBy(F.coalesce("root", "fp")).agg(F.min("best").alias("best"))
    return table.join(first.select(F.col("best.__row").alias("__row")), "__row", "left_semi").select(*[F.col(i).alias(c) for i, c in zip(inner, docs.columns, strict=True)])
