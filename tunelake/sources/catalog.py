"""The library's objects as typed frames.

A :class:`Catalog` maps an object type to a frame.  ``from_star`` builds one over the star-schema tables that stand in for
a library: customers are artists, orders albums, line items tracks, events playlist items.  Plain selects and equi-joins, so
filters and column pruning reach the Parquet scans.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

PLURALS = {"artists": "artist", "albums": "album", "tracks": "track", "playlists": "playlist", "playlist_items": "playlist_item", "shows": "show", "seasons": "season", "episodes": "episode", "movies": "movie"}
#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The section that holds each type.
SECTIONS = {"artist": "music", "album": "music", "track": "music", "show": "tv", "season": "tv", "episode": "tv", "movie": "movies"}


def type_name(name: str) -> str:
    name = PLURALS.get(name.lower(), name.lower())
    if name not in SECTIONS and name not in ("playlist", "playlist_item"):
        raise ValueError(f"unknown object type: {name}")
    return name


@dataclass
class Catalog:
    frames: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)

    def frame(self, name: str) -> DataFrame:
        return self.frames[type_name(name)]()

    def section(self, name: str) -> str:
        return SECTIONS[type_name(name)]

    def find(self, name: str, **filters) -> DataFrame:
        """The rows of a type that fit the filters."""
        from tunelake.operators.predicates import where

        return where(self.frame(name), filters)

    def views(self) -> list[str]:
        """Register every type as a temporary view for SQL; their names."""
        for name in self.frames:
            self.frame(name).createOrReplaceTempView(name)
        return sorted(self.frames)

    def sql(self, spark: SparkSession, text: str, **args) -> DataFrame:
        """A statement over the views, its parameters bound by name."""
        self.views()
        return spark.sql(text, args=args)


def star(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("country"), F.array(F.lower("c_mktsegment")).alias("genres"), F.round("c_acctbal", 2).alias("balance"))


def albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = star(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("parent_key"), F.concat(F.lit("Album "), "o_orderkey").alias("title"), F.year("o_orderdate").alias("year"), F.array("o_orderpriority").alias("genres"), F.col("o_orderstatus").alias("studio"))


#: What the columns of a track are made of.
READS = {
    "key": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
    "parent_key": ("l_orderkey",),
    "grandparent_key": ("o_custkey",),
    "title": ("p_name",),
    "original_title": ("l_returnflag", "p_brand"),
    "index": ("l_linenumber",),
    "parent_year": ("o_orderdate",),
    "duration": ("l_extendedprice",),
    "user_rating": ("l_quantity",),
    "moods": ("l_returnflag",),
    "media": ("l_linestatus", "o_custkey", "l_orderkey", "l_linenumber", "p_name"),
    "added_at": ("l_shipdate",),
}


def tracks(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Tracks with their album's and artist's keys; rating 0 is unrated (null); original_title only on returned items.

    columns: these only, and the rows of each join are written as a table, so that disk holds the shuffled rows of one join at a time.
    """
    line, part, o = star(spark, sf_dir, "lineitem"), star(spark, sf_dir, "part"), star(spark, sf_dir, "orders")

    def kept(df: DataFrame, last: DataFrame | None = None) -> DataFrame:
        if columns is None:
            return df
        read = {"l_orderkey", *(r for n in columns for r in READS[n])}
        return checkpointed(df.select([c for c in df.columns if c in read]), large=True, last=last)

    named = kept(line.join(part.select("p_partkey", "p_name", "p_type", "p_brand"), line.l_partkey == F.col("p_partkey")))
    t = kept(named.join(o.select("o_orderkey", "o_custkey", "o_orderdate"), named.l_orderkey == F.col("o_orderkey")), named)
    codec = F.when(F.col("l_linestatus") == "O", "flac").otherwise("mp3")
    file = F.concat_ws("/", F.lit("/music"), F.col("o_custkey"), F.col("l_orderkey"), F.concat(F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit(". "), F.col("p_name"), F.lit("."), codec))
    made = {
        "key": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        "parent_key": F.col("l_orderkey"),
        "grandparent_key": F.col("o_custkey"),
        "title": F.col("p_name"),
        "original_title": F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Guest "), "p_brand")),
        "index": F.col("l_linenumber"),
        "parent_year": F.year("o_orderdate"),
        "duration": F.round(F.col("l_extendedprice") * 100).cast("bigint"),
        "user_rating": F.expr("nullif(cast(floor(l_quantity / 5) as int), 0)"),
        "moods": F.array("l_returnflag"),
        "media": F.array(F.struct(codec.alias("codec"), F.array(F.struct(file.alias("file"))).alias("part"))),
        "added_at": F.col("l_shipdate"),
    }
    return t.select(*[made[n].alias(n) for n in columns or made])


def playlist_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ordered playlists: one for each user, the item is the whole part of the value."""
    from pyspark.sql import Window

    e = star(spark, sf_dir, "events")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.concat(F.lit("list "), "user_id").alias("name"), (F.row_number().over(by) - 1).cast("bigint").alias("pos"), F.floor("value").cast("bigint").alias("track_key"), F.col("event_type").alias("kind"))


def from_star(spark: SparkSession, sf_dir: str) -> Catalog:
    made = {"artist": artists, "album": albums, "track": tracks, "playlist_item": playlist_items}
    return Catalog({k: (lambda f=f: f(spark, sf_dir)) for k, f in made.items()})


def scratch(spark: SparkSession) -> str:
    """A new path in the checkpoint folder, which driver and executors share; on one machine a temporary folder will do."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tunelake-"))
        folder = sc.getCheckpointDir()
    return f"{folder.rstrip('/')}/tables/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, large: bool = False, last: DataFrame | None = None) -> DataFrame:
    """The rows as a table in the checkpoint folder, without their lineage.

    A table, as what Spark keeps of a checkpoint's plan grows from round to round of a loop.  large: it takes less disk, and the files
    that its making shuffled go as soon as it is written.  last: a table of this function that nothing else reads; its rows go then.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    if not large:
        df.write.parquet(path)
    else:
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    if last is not None:
        for folder in {f.rpartition("/")[0] for f in last.inputFiles()}:
            spark.createDataFrame([], last.schema).write.mode("overwrite").parquet(folder)
    return spark.read.schema(df.schema).parquet(path)
