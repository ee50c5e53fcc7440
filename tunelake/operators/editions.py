"""Track lists of editions: what continues an earlier edition, and which file is which track."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def _lists(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(edition, num, title, source, by) of rows (album, pos, edition, side, num, title) in this order, an album after the other.

    Of editions with the same last number only the latest can be continued, so an album holds one list for each last number.
    """
    for _, album in itertools.groupby(rows, lambda r: r[0]):
        ends: dict = {}  # the last number so far: the list that ends there
        waiting: list[tuple] = []  # lists of the same place don't continue each other
        before = at = None
        for (pos, edition, side), tracks in itertools.groupby(album, lambda r: r[1:4]):
            if pos != at:
                ends.update(waiting)
                waiting, at = [], pos
            own: dict = {}
            for *_, num, title in tracks:
                if num not in own or own[num][0] is not None and (title is None or title < own[num][0]):
                    own[num] = title, edition
            nums = [n for n in own if n is not None]
            first, top = min(nums, default=None), max(nums, default=None)
            by = "own"
            if first is not None and first > 1 and not side and before is not None:
                by = "continued" if first - 1 in ends else "overlaid"
                parent = ends[first - 1] if by == "continued" else before[1]
                own = parent | own
                if by == "overlaid" and before[0] is not None:
                    top = max(top, before[0])
            before = top, own
            if top is not None:
                waiting.append(before)
            for num, (title, source) in own.items():
                yield edition, num, title, source, by


def continuation(editions: DataFrame, tracks: DataFrame) -> DataFrame:
    """(edition, num, title, source, by): each edition's whole track list.

    An edition whose first number is over 1 continues the latest earlier edition of its album that ends right before it
    (``continued``), or is laid over the edition before it by number (``overlaid``); sides of a record and first editions stand
    alone (``own``).  What an edition ends with is known once what it is laid over is, so an album's editions are read in order,
    as a sorted stream: one exchange by album, whatever the length of its chains.  Each number is taken from the nearest edition
    of the chain that has it.  An edition without tracks takes no part.

    editions: edition, album, pos, side (null: no); tracks: edition, num, title.
    """
    rows = editions.select("album", "pos", "edition", "side").join(tracks.select("edition", "num", "title"), "edition").select("album", "pos", "edition", "side", "num", "title")
    schema = T.StructType([rows.schema[c] for c in ("edition", "num", "title")] + [T.StructField("source", rows.schema["edition"].dataType), T.StructField("by", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict = {}

        def read():
            for batch in batches:
                kinds.update(zip(batch.schema.names, batch.schema.types))
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

        lists = _lists(read())
        while some := list(itertools.islice(lists, 20_000)):
            types = kinds["edition"], kinds["num"], kinds["title"], kinds["edition"], pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types, strict=True)], ["edition", "num", "title", "source", "by"])

    return rows.repartition("album").sortWithinPartitions("album", "pos", "edition", "num").mapInArrow(run, schema)


def zip_files(albums: DataFrame, files: DataFrame, tracks: DataFrame) -> DataFrame:
    """(album, path, part, nth, by): which track each file is, by the first way that fits the album's own counts and numbers.

    As many files as the part has tracks: ``position``.  More files than the first of several parts has: over all disks by
    ``disks`` (as many files as tracks), ``disk and number of available``, ``disk and number``, else ``disks``.  Else ``number of
    available`` and ``number``, if every file has a number of its own in range, else ``position``.  Files without a partner are left
    out.  Files go by disk and number, then path, missing numbers first.

    albums: album, edition, part; files: album, path, disk, num; tracks: edition, part, num, available.
    """
    c, file = F.col, F.col("file")
    within, edition, album = Window.partitionBy("edition", "part"), Window.partitionBy("edition"), Window.partitionBy("album")
    t = tracks.select("edition", "part", "available", F.row_number().over(within.orderBy("num")).alias("nth"), F.dense_rank().over(edition.orderBy("part")).alias("disk"))
    t = t.withColumn("nth_available", F.count_if("available").over(within.orderBy("nth"))).withColumn("nth_all", F.row_number().over(edition.orderBy("part", "nth")))
    by_num = album.orderBy("num", "path")
    first = c("num").isNotNull() & ~F.coalesce(F.lag("num").over(by_num) == c("num"), F.lit(False))
    f = files.select("album", "path", "disk", "num", F.row_number().over(by_num).alias("at"), F.row_number().over(album.orderBy("disk", "num", "path")).alias("at_all"), first.alias("new_num"))

    # an album's files and tracks in one place: one exchange, and windows instead of joins
    own = albums.select("album", "edition", c("part").alias("own"))
    here = f.join(own, "album").withColumn("file", F.lit(True))
    there = t.filter("part IS NOT NULL").join(own, "edition").withColumn("file", F.lit(False))
    rows = here.unionByName(there, allowMissingColumns=True)
    whole = "album", "edition", "own"
    over = Window.partitionBy(*whole)
    mine = ~file & (c("part") == c("own"))
    counts = {"n_files": file, "n_nums": c("new_num"), "n_tracks": mine, "n_available": mine & c("available"), "n_all": ~file, "n_all_available": ~file & c("available"), "n_parts": ~file & (c("nth") == 1)}
    rows = rows.select("*", *[F.count_if(x).over(over).alias(k) for k, x in counts.items()], *[g(x).over(over).alias(k) for k, g, x in (("low", F.min, "num"), ("high", F.max, "num"), ("first", F.min, "part"))])
    same = Window.partitionBy(*whole, "disk", F.when(file, c("num")).otherwise(c("nth")))
    known = file & c("disk").isNotNull() & c("num").isNotNull()
    rows = rows.select("*", (known & (F.count_if(~file).over(same) > 0)).alias("meets"), (known & (F.count_if(~file & c("available")).over(same) > 0)).alias("meets_available"))
    rows = rows.select("*", F.count_if("meets").over(over).alias("n_met"), F.count_if("meets_available").over(over).alias("n_met_available")).filter("n_tracks > 0")

    n = F.col("n_files")
    numbered = lambda most: (c("n_nums") == n) & (c("low") >= 1) & (c("high") <= most)
    disks = (n > c("n_tracks")) & (c("n_parts") > 1) & (c("own") == c("first"))
    way = F.when(n == c("n_tracks"), "position")
    way = way.when(disks & (c("n_all") == n), "disks").when(disks & (c("n_all_available") == n) & (c("n_met_available") == n), "disk and number of available")
    way = way.when(disks & (c("n_met") == n), "disk and number").when(disks, "disks")
    way = way.when((c("n_available") == n) & numbered(c("n_available")), "number of available").when(numbered(c("n_tracks")), "number").otherwise("position")
    rows = rows.withColumn("by", way)

    def key(ways: dict[str, tuple]) -> Column:
        out = F.lit(None).cast("struct<disk:int,n:int>")
        for by, (disk, place) in ways.items():
            out = F.when(c("by") == by, F.struct(disk.cast("int").alias("disk"), place.cast("int").alias("n"))).otherwise(out)
        return out

    none = F.lit(0)
    left = {"position": (none, c("at")), "disks": (none, c("at_all")), "number": (none, c("num")), "number of available": (none, c("num"))}
    right = {"position": (none, c("nth")), "disks": (none, c("nth_all")), "number": (none, c("nth")), "number of available": (none, F.when(c("available"), c("nth_available")))}
    for by in ("disk and number", "disk and number of available"):
        left[by] = (c("disk"), c("num"))
        right[by] = (c("disk"), c("nth") if by == "disk and number" else F.when(c("available"), c("nth")))
    taken = file | (c("part") == c("own")) | c("by").startswith("disk")
    rows = rows.filter(taken).select(*whole, "path", "part", "nth", "by", "file", F.when(file, key(left)).otherwise(key(right)).alias("k")).filter("k.disk IS NOT NULL AND k.n IS NOT NULL")
    partner = F.max(F.when(~file, F.struct("part", "nth"))).over(Window.partitionBy(*whole, "k.disk", "k.n"))
    return rows.select("album", "path", "by", "file", partner.alias("t")).filter(file & c("t").isNotNull()).select("album", "path", "t.part", "t.nth", "by")
