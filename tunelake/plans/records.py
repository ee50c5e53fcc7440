"""Album records: built from a folder's files, as JSON, merged, and matched with a library."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

FIELDS = ("title", "artist", "type", "number", "disks", "genres", "tracks")
TRACK = "array<struct<disk:int,num:int,title:string>>"
RECORD = f"struct<title:string,artist:string,type:string,number:int,disks:int,genres:array<string>,tracks:{TRACK}>"


def from_files(files: DataFrame, by: str = "folder") -> DataFrame:
    """One record for each folder: the first file's tags, genres that all files have, the tracks in order.

    files: folder, path, disk, num, title, album, artist, genres.
    """
    first = F.min_by(F.struct("album", "artist"), F.struct("disk", "num", "path"))
    every = F.reduce(F.collect_list("genres"), F.min_by("genres", F.struct("disk", "num", "path")), lambda a, g: F.array_intersect(a, g))
    out = files.groupBy(by).agg(first.alias("first"), every.alias("genres"), F.max("disk").alias("disks"), F.sort_array(F.collect_list(F.struct("disk", "num", "title"))).alias("tracks"))
    return out.select(by, F.col("first.album").alias("title"), F.col("first.artist").alias("artist"), "disks", F.sort_array("genres").alias("genres"), "tracks")


def to_json(records: DataFrame, by: str = "folder") -> DataFrame:
    """(folder, json): fields in order of their names."""
    names = sorted(c for c in records.columns if c != by)
    return records.select(by, F.to_json(F.struct(*names)).alias("json"))


def from_json(rows: DataFrame, by: str = "folder") -> DataFrame:
    return rows.select(by, F.from_json("json", RECORD).alias("r")).select(by, "r.*")


def in_library(albums: DataFrame, folders: DataFrame, full: Column, short: Column) -> DataFrame:
    """The albums with the library folder they are in: by the full artist name, else by the English one."""
    there = folders.select(F.col("path").alias("__p")).distinct()
    own = albums.withColumns({"__full": full, "__short": short})
    met = own.join(there, F.col("__full") == F.col("__p"), "left").withColumnRenamed("__p", "__a")
    met = met.join(there, F.col("__short") == F.col("__p"), "left")
    return met.select(*albums.columns, F.coalesce("__a", "__p").alias("found"))


def inner_maps(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of the keys that all frames have."""
    return reduce(lambda a, b: a.join(b, key), frames)


def coalesced_maps(frames: list[DataFrame], key: str, value: str) -> DataFrame:
    """(key, value): the value of the first frame that has the key."""
    ranked = reduce(DataFrame.unionByName, [f.select(key, value, F.lit(i).alias("__i")) for i, f in enumerate(frames)])
    return ranked.groupBy(key).agg(F.min_by(value, "__i").alias(value))
