"""Update plans: target tags, names and places of files, merges of album records, and what a move would run into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tunelake.functions.scalar import sanitize_path


def file_name(num: Column, disk: Column, n_disks: Column, title: Column, suffix: Column) -> Column:
    """``NN. title.ext``, or ``DD-NN. title.ext`` if there is more than one disk."""
    place = F.lpad(num.cast("string"), 2, "0")
    place = F.when(n_disks > 1, F.concat(F.lpad(disk.cast("string"), 2, "0"), F.lit("-"), place)).otherwise(place)
    return sanitize_path(F.concat(place, F.lit(". "), title, F.lit("."), suffix))


def album_folder(artist: Column, kind: Column, date: Column, title: Column, number: Column | None = None) -> Column:
    """``artist/kinds/[date] title [number kind]``; without a date or number those parts go."""
    name = F.concat_ws(" ", F.concat(F.lit("["), F.date_format(date, "yyyy.MM.dd"), F.lit("]")), title, F.concat(F.lit("["), number, F.lit(" "), kind, F.lit("]")) if number is not None else F.lit(None).cast("string"))
    return F.concat_ws("/", sanitize_path(artist), F.concat(kind, F.lit("s")), sanitize_path(name))


def merge_overlay(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of a with each field of b that is set."""
    other = b.select(F.col(key).alias("__key"), *[F.col(f).alias(f"__{f}") for f in fields])
    met = a.join(other, a[key] == F.col("__key"), "left")
    return met.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else c for c in a.columns])


def target_tags(albums: DataFrame, names: list[str]) -> DataFrame:
    """(path, tag, value): the tags that each row's fields ask for, unset ones left out."""
    pairs = F.array(*[F.struct(F.lit(n).alias("tag"), F.col(n).cast("string").alias("value")) for n in names])
    return albums.select("path", F.explode(pairs).alias("p")).select("path", "p.tag", "p.value").filter("value IS NOT NULL")


def move_plan(files: DataFrame) -> DataFrame:
    """(path, target, status): unchanged paths left out; ``exists`` if the target is a file that stays, ``collides`` if two files ask for it."""
    moves = files.filter("NOT (path <=> target)").select("path", "target")
    stay = files.filter("path <=> target").select(F.col("path").alias("__p")).distinct()
    asked = moves.withColumn("__n", F.count("*").over(Window.partitionBy("target")))
    met = asked.join(stay, asked["target"] == F.col("__p"), "left")
    return met.select("path", "target", F.when(F.col("__p").isNotNull(), "exists").when(F.col("__n") > 1, "collides").otherwise("move").alias("status"))


def edit_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old, new) of fields that differ between records, null-safe."""
    a = old.select(F.col(key), *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    b = new.select(F.col(key), *[F.col(f).cast("string").alias(f"b_{f}") for f in fields])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("old"), F.col(f"b_{f}").alias("new")) for f in fields])
    return a.join(b, key).select(key, F.explode(rows).alias("d")).select(key, "d.field", "d.old", "d.new").filter("NOT (old <=> new)")


def zip_files(files: DataFrame, tracks: DataFrame, by: str) -> DataFrame:
    """(by, path, track): by disk and number where a group has several disks, else by number; only unique numbers pair."""
    many = files.groupBy(by).agg((F.count_distinct("disk") > 1).alias("__many"))
    place = lambda df: df.join(many, by).withColumn("__d", F.when(F.col("__many"), F.col("disk")).otherwise(F.lit(0)))
    w = Window.partitionBy(by, "__d", "num")
    x = place(files).withColumn("__n", F.count("*").over(w)).filter("__n = 1").select(by, "__d", "num", "path")
    y = place(tracks).withColumn("__n", F.count("*").over(w)).filter("__n = 1").select(by, "__d", "num", "track")
    return x.join(y, [by, "__d", "num"]).select(by, "path", "track")


#: Languages whose albums have a genre of their own; fixed values.
POP = ("Chinese", "Japanese", "Korean", "Mandarin")


def album_info(matched: DataFrame, titles: str = "both", keep_genre: bool = True) -> DataFrame:
    """(path, title, album, artist, genre, disk, num) of matched files: what their tags should say.

    matched: path, name, album, artist, collaborators (array), language, disk, num.  titles: where collaborators go, ``title``,
    ``artist`` or ``both``.
    """
    from tunelake.operators.pages import artist_name

    some = F.size("collaborators") > 0
    others = F.concat(F.lit(" (feat. "), F.array_join("collaborators", ", "), F.lit(")"))
    title = F.concat("name", F.when(some, others).otherwise("")) if titles in ("title", "both") else F.col("name")
    artist = artist_name(F.col("artist"), F.col("collaborators")) if titles in ("artist", "both") else F.col("artist")
    genre = F.when(F.col("language").isin(*POP), F.concat(F.substring("language", 1, 1), F.lit("-Pop"))) if keep_genre else F.lit(None).cast("string")
    return matched.select("path", title.alias("title"), F.trim("album").alias("album"), artist.alias("artist"), genre.alias("genre"), "disk", "num")


def overridden(info: DataFrame, overrides: DataFrame, key: str = "path") -> DataFrame:
    """The records with what a table of overrides (key, field, value) says instead."""
    named = overrides.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("__o"))
    met = info.join(named, key, "left")
    return met.select(*[c if c == key else F.coalesce(F.try_element_at("__o", F.lit(c)).cast(t), F.col(c)).alias(c) for c, t in info.dtypes])
