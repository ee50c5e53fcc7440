"""Shards of near-equal bytes by histogram sort.

Everything is DataFrame expressions.  Rows are ordered by a hash of the text, then by a hash of the id and the row's place,
so equal texts lie together and a group larger than a shard can still be cut.  The driver keeps a bracket for each of the
shards' boundaries; each round counts the exact bytes of ``PROBES`` cells of every bracket in one aggregation over all
partitions and narrows the bracket to the cell in which the boundary lies, until the bytes below it are within
``TOLERANCE`` of a shard's share, or the cell is one row.  At most shards x probes sums reach the driver in a round.
Then rows are exchanged once, by shard and a cell of about ``CELL_ROWS`` rows, and numbered: a cell's offset within its
shard plus the row's place in the cell.  Texts with more rows than a cell holds are cut by the second hash.

Null texts have no bytes and the checksum of an empty one.  A text may have any length; one that is longer than a shard's
share makes its shard larger.  Repeated rows are separate rows.  The second hash holds the row's place in its partition, so
where one text's rows are cut between shards depends on how the rows were dealt; so do slots of rows that tie.  Every row gets
a shard and a slot; shards may be empty if there are few rows.  Columns besides the id and the text aren't read, so their
names can't clash.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

SHARDS = 16
PROBES = 256
TOLERANCE = 0.0002
CELL_ROWS = 100_000
TOP = (1 << 62) - 1


@dataclass
class Bracket:
    """Where a boundary lies: low..high of the first hash, or of the second among rows of the first hash ``at``."""

    target: float
    at: int | None = None
    low: int = 0
    high: int = TOP
    below: int = 0
    splitter: tuple[int, int] | None = None

    def place(self) -> tuple:
        return self.at, self.low, self.high, self.below


def keyed(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, size, checksum and the two hashes of each row, as a written table: later passes read no text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    half = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 2)
    return common.written(docs.select(F.col(id_col).alias("id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("crc"), half(t).alias("h"), half(F.lit(1), F.col(id_col), F.monotonically_increasing_id()).alias("g")))


def splitters(rows: DataFrame, shards: int = SHARDS, probes: int = PROBES, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """The keys (h, g) at which shards 1.. begin."""
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return []
    brackets = [Bracket(total * k / shards) for k in range(1, shards)]
    slack = tolerance * total / shards
    while left := [b for b in brackets if b.splitter is None]:
        places = sorted({b.place() for b in left}, key=str)
        which, value = F.lit(None).cast("int"), F.lit(None).cast("long")
        cell = F.lit(None).cast("int")
        for i, (at, low, high, _) in enumerate(places):
            x = F.col("h") if at is None else F.col("g")
            inside = x.between(low, high) & (F.lit(True) if at is None else F.col("h") == at)
            width = max(1, -(-(high - low + 1) // probes))
            which, value, cell = F.when(inside, i).otherwise(which), F.when(inside, x).otherwise(value), F.when(inside, F.expr(f"int(({'h' if at is None else 'g'} - {low}L) div {width}L)")).otherwise(cell)
        sums = rows.select(which.alias("i"), cell.alias("c"), value.alias("x"), "size").filter("i is not null").groupBy("i", "c").agg(F.sum("size").alias("bytes"), F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("rows")).collect()
        for b in left:
            at, below = b.at, b.below
            for s in sorted((s for s in sums if s.i == places.index(b.place())), key=lambda s: s.c):
                key = (s.low, 0) if at is None else (at, s.low)
                if below + slack >= b.target:
                    b.splitter = key
                    break
                if below + s.bytes > b.target:
                    if s.rows == 1 or at is not None and s.low == s.high:  # the boundary goes to the row's nearer side
                        after = (s.low + 1, 0) if at is None else (at, s.low + 1)
                        b.splitter = key if b.target - below <= below + s.bytes - b.target else after
                    elif s.low == s.high:
                        b.at, b.low, b.high, b.below = s.low, 0, TOP, below
                    else:
                        b.low, b.high, b.below = s.low, s.high, below
                    break
                below += s.bytes
            else:  # all of the bracket lies below
                b.splitter = (b.high + 1, 0) if at is None else (at, b.high + 1)
    return [b.splitter for b in brackets]


def shard_of(splits: list[tuple[int, int]]) -> Column:
    return sum(((F.col("h") > h) | (F.col("h") == h) & (F.col("g") >= g)).cast("int") for h, g in splits) if splits else F.lit(0)


def assign(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS, cell_rows: int = CELL_ROWS, probes: int = PROBES, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each document: id, size, text_crc32, law, shard, slot and grown_shard (null)."""
    rows = keyed(docs, id_col, text)
    splits = splitters(rows, shards, probes, tolerance)
    n = rows.count()
    bins = max(1, -(-n // cell_rows))
    placed = rows.withColumn("shard", shard_of(splits).cast("int")).withColumn("bin", F.expr(f"h div {TOP // bins + 1}L"))
    # texts with more rows than a cell: at most n / cell_rows of them, so they may be broadcast
    crowded = rows.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > cell_rows)
    hot = crowded.select(F.col("h").alias("hot"), F.ceil(F.col("n") / cell_rows).alias("parts"))
    placed = placed.join(F.broadcast(hot), placed.h == hot.hot, "left").withColumn("part", F.when(F.col("hot").isNotNull(), F.floor(F.col("g") / (F.lit(float(TOP)) + 1) * F.col("parts"))).otherwise(F.lit(0)))
    cell = ["shard", "bin", F.coalesce("hot", F.lit(-1)).alias("hot"), "part"]
    placed = placed.select("id", "size", "crc", "h", "g", *cell)
    cells = placed.groupBy("shard", "bin", "hot", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bin", "hot", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("shard", "bin", "hot", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = placed.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "bin", "hot", "part").orderBy("h", "g")))
    out = numbered.join(offsets, ["shard", "bin", "hot", "part"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
