"""Playlists and album records as files: JSON lines and XML, plain or compressed, written and read by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ITEM = "array<struct<pos:bigint,track_key:bigint>>"
ROW = f"struct<name:string,items:{ITEM}>"


def as_rows(items: DataFrame) -> DataFrame:
    """(name, items): a list's items in order."""
    return items.groupBy("name").agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("bigint").alias("pos"), F.col("track_key").cast("bigint").alias("track_key")))).alias("items"))


def as_items(rows: DataFrame) -> DataFrame:
    return rows.select("name", F.explode("items").alias("i")).select("name", "i.pos", "i.track_key")


def write_json(items: DataFrame, path: str, compression: str = "gzip", by_name: bool = False) -> None:
    """A line for each list; with by_name a folder for each."""
    writer = as_rows(items).write.option("compression", compression)
    (writer.partitionBy("name") if by_name else writer).json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return as_items(spark.read.schema(f"name string, items {ITEM}").json(path))


def write_xml(items: DataFrame, path: str, compression: str = "gzip") -> None:
    as_rows(items).write.format("xml").option("rootTag", "playlists").option("rowTag", "playlist").option("compression", compression).save(path)


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    return as_items(spark.read.format("xml").option("rowTag", "playlist").schema(f"name string, items {ITEM}").load(path))


def to_json(items: DataFrame) -> DataFrame:
    """(name, json) of each list."""
    return as_rows(items).select("name", F.to_json("items").alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    return as_items(rows.select("name", F.from_json("json", ITEM).alias("items")))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modified, size, sha256): every file below a folder, its content hashed by Spark."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return raw.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def itunes_tracks(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, artist, rating) from the key/value pairs of a plist's track dicts; ratings of 0-100 become 0-10."""
    value = lambda k, t: F.nullif(F.regexp_extract(column, rf"<key>{k}</key>\s*<{t}>(.*?)</{t}>", 1), F.lit(""))
    return lines.select(value("Name", "string").alias("name"), value("Artist", "string").alias("artist"), (value("Rating", "integer").cast("int") / 10).cast("int").alias("rating")).filter("name IS NOT NULL")


def kind_of(spark: SparkSession, path: str) -> str:
    """``xml`` or ``json``, by the first character that the file or folder holds."""
    first = spark.read.text(path).filter(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    if first is None or first.c not in "<{[":
        raise ValueError(f"neither XML nor JSON: {path}")
    return "xml" if first.c == "<" else "json"


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """The items of playlists in either format, plain or compressed."""
    return (read_xml if kind_of(spark, path) == "xml" else read_json)(spark, path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The items of playlists in tar archives of JSON files; an archive is read in one task, archives in parallel."""
    import pyarrow as pa

    def run(batches):
        import io
        import tarfile

        for batch in batches:
            for k in range(batch.num_rows):
                with tarfile.open(fileobj=io.BytesIO(batch.column(0)[k].as_py())) as tar:
                    for member in tar:
                        if member.isfile():
                            lines = [x for x in tar.extractfile(member).read().decode().splitlines() if x.strip()]
                            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])

    lines = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "line string")
    return as_items(lines.select(F.from_json("line", ROW).alias("r")).select("r.name", "r.items"))
