"""The tag store: rows (path, tag, value), profiles of them, consensus over albums, and diffs as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Logical tags and their ids in the formats mp4, id3 and vorbis.
TAG_IDS = (
    ("title", "©nam", "TIT2", "TITLE"),
    ("date", "©day", "TDRC", "DATE"),
    ("genre", "©gen", "TCON", "GENRE"),
    ("album", "©alb", "TALB", "ALBUM"),
    ("album_title", None, None, "ALBUMTITLE"),
    ("artist", "©ART", "TPE1", "ARTIST"),
    ("album_artist", "aART", "TPE2", "ALBUMARTIST"),
    ("track", "trkn", "TRCK", "TRACKNUMBER"),
    ("disk", "disk", "TPOS", "DISCNUMBER"),
    ("grouping", "©grp", "TIT1", "GROUPING"),
    ("album_sort_order", "soal", "TSOA", "ALBUMSORT"),
    ("track_sort_order", "sonm", "TSOT", "TITLESORT"),
    ("album_artist_sort_order", "soaa", "TSO2", "ALBUMARTISTSORT"),
    ("track_artist_sort_order", "soar", "TSOP", "ARTISTSORT"),
    ("isrc", "----:com.apple.iTunes:ISRC", "TSRC", "ISRC"),
    ("compilation", "cpil", "TCMP", "COMPILATION"),
    ("podcast", "pcst", "PCST", None),
    ("bpm", "tmpo", "TBPM", "BPM"),
    ("language", "----:com.apple.iTunes:LANGUAGE", "TLAN", "LANGUAGE"),
    ("lyrics", "©lyr", "USLT", "LYRICS"),
    ("cover", "covr", "APIC", "metadata_block_picture"),
    ("wiki:album", "----:WIKI:ALBUM", "WXXX:WIKI:ALBUM", "WIKI:ALBUM"),
    ("wiki:artist", "----:WIKI:ARTIST", "WXXX:WIKI:ARTIST", "WIKI:ARTIST"),
    ("kpop:gen", "KPOP:GEN", "TXXX:KPOP:GEN", "KPOP:GEN"),
    ("rating", "POPM", "POPM", "POPM"),
)


def dimension(spark) -> DataFrame:
    """(tag_type, tag_id, name): a small fixed table."""
    rows = [(kind, row[k + 1], row[0]) for row in TAG_IDS for k, kind in enumerate(("mp4", "id3", "vorbis")) if row[k + 1]]
    return spark.createDataFrame(rows, "tag_type string, tag_id string, name string")


def explode_tags(files: DataFrame) -> DataFrame:
    """(path, tag_id, name, value) of files with a map of tags; id3 ids are cut to four characters, unknown names are null."""
    rows = files.select("path", "tag_type", F.explode("tags").alias("id", "values")).select("path", "tag_type", F.when((F.col("tag_type") == "id3") & ~F.col("id").rlike("^(?:WXXX|TXXX):"), F.substring("id", 1, 4)).otherwise(F.col("id")).alias("tag_id"), F.explode("values").alias("value"))
    return rows.join(F.broadcast(dimension(files.sparkSession)), ["tag_type", "tag_id"], "left").select("path", "tag_id", "name", "value")


def text_of(values: Column) -> Column:
    return F.array_join(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""), ";")


def unique_values(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag", "value").agg(F.count("*").alias("n"))


def profile(tags: DataFrame) -> DataFrame:
    """For each tag: values, files, distinct values, its share of all files, and values for each file that has it."""
    by = tags.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("path").alias("n_files"), F.count_distinct("value").alias("n_values"))
    share = F.round(F.col("n_files") / tags.select(F.count_distinct("path")).scalar(), 6)
    return by.select("tag", "n", "n_files", "n_values", share.alias("share"), F.round(F.col("n") / F.col("n_files"), 6).alias("per_file"))


def pivot(tags: DataFrame, names: list[str]) -> DataFrame:
    """One row for each file, one column for each of the named tags (the smallest value)."""
    return tags.groupBy("path").pivot("tag", names).agg(F.min("value"))


def consensus(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Each group's value of a column if all of its rows agree, else null."""
    return rows.groupBy(by).agg(*[F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count("*")), F.min(c)).alias(c) for c in columns])


def mode(rows: DataFrame, by: str, column: str) -> DataFrame:
    """Each group's most frequent value, the smallest of those."""
    counted = rows.groupBy(by, column).agg(F.count("*").alias("n"))
    return counted.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("m"), column)).alias("b")).select(by, F.col(f"b.{column}").alias(column), (-F.col("b.m")).alias("n"))


def common_values(rows: DataFrame, by: str, member: str, value: str) -> DataFrame:
    """(group, value) for values that all of a group's members have."""
    sizes = rows.groupBy(by).agg(F.count_distinct(member).alias("size"))
    have = rows.groupBy(by, value).agg(F.count_distinct(member).alias("n"))
    return have.join(sizes, by).filter("n = size").select(by, value)


def tag_diff(old: DataFrame, new: DataFrame, sets: tuple[str, ...] = ("genre",), add: bool = False) -> DataFrame:
    """(path, tag, old, new) of tags that change; a tag in sets is compared as a set of values, added to or replaced.

    Values are sorted and joined by a semicolon; files that only one side has are left out.
    """

    def joined(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("path", "tag").agg(F.sort_array(F.collect_set("value")).alias(name))

    paths = old.select("path").distinct().join(new.select("path").distinct(), "path")
    both = joined(old, "a").join(joined(new, "b"), ["path", "tag"], "full").join(paths, "path", "left_semi")
    keep = F.col("tag").isin(*sets) & F.lit(add)
    b = F.when(keep, F.sort_array(F.array_union(F.coalesce("a", F.array().cast("array<string>")), F.coalesce("b", F.array().cast("array<string>"))))).otherwise(F.col("b"))
    text = lambda c: F.array_join(c, ";")
    return both.select("path", "tag", text(F.col("a")).alias("old"), text(b).alias("new")).filter("new IS NOT NULL AND NOT (old <=> new)")


def change_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("tag", "old", "new").agg(F.count("*").alias("n"))


def common_changes(diff: DataFrame, files: DataFrame) -> DataFrame:
    """(tag, old, new) of tags that change in the same way in every file; files has a path column."""
    total = files.select("path").distinct().agg(F.count("*").alias("total"))
    by = diff.groupBy("tag").agg(F.count("*").alias("n"), F.min("old").alias("old"), F.max("old").alias("o"), F.min("new").alias("new"), F.max("new").alias("w"), F.count("old").alias("some_old"), F.count("new").alias("some_new"))
    same = by.filter("old <=> o AND new <=> w AND some_old IN (0, n) AND some_new IN (0, n)")
    return same.join(F.broadcast(total), same["n"] == F.col("total")).select("tag", "old", "new")


def set_plan(tags: DataFrame, tag: str, value: str, where: str | None = None, partial: bool = False) -> DataFrame:
    """(path, old, new): a tag's new value, only where a pattern matches, or only the matching part of it."""
    own = tags.filter(F.col("tag") == tag)
    new = F.regexp_replace("value", where, value) if where and partial else F.lit(value)
    hit = F.col("value").rlike(where) if where else F.lit(True)
    return own.filter(hit).select("path", F.col("value").alias("old"), new.alias("new")).filter("NOT (old <=> new)")


def bad_tags(tags: DataFrame, deny: str, allow: str) -> DataFrame:
    """Rows whose tag fits the deny pattern and not the allow pattern."""
    return tags.filter(F.col("tag").rlike(deny) & ~F.col("tag").rlike(allow))


def neighbours(albums: DataFrame, by: str, name: str = "title") -> DataFrame:
    """Each album's previous and next one in the order of the lower-case name."""
    w = Window.partitionBy(by).orderBy(F.lower(name), "key")
    return albums.select(by, "key", F.lag("key").over(w).alias("previous"), F.lead("key").over(w).alias("next"))


def truncated(c: Column, head: int = 125, tail: int = 25) -> Column:
    """A long value with its middle left out."""
    return F.when(F.length(c) > head + tail + 3, F.concat(F.substring(c, 1, head), F.lit("..."), F.substring(c, -tail, tail))).otherwise(c)


def transcode_plan(files: DataFrame, bitrate: int = 256) -> DataFrame:
    """(path, action): lossless files and better lossy ones are transcoded, the rest is copied, so nothing gains bits."""
    return files.select("path", F.when(F.col("lossless") | (F.col("bitrate") > bitrate), "transcode").otherwise("copy").alias("action"))


def leaf_folders(files: DataFrame, path: str = "path") -> DataFrame:
    """(folder, n): folders that hold files and no folder that does."""
    own = files.select(F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("folder")).groupBy("folder").agg(F.count("*").alias("n"))
    steps = F.split("folder", "/")
    above = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k - 1), "/"))).alias("folder")).distinct()
    return own.join(above, "folder", "left_anti")


def length_text(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.format_string("%02d", (F.floor(seconds) % 60).cast("bigint")))


def technical(files: DataFrame) -> DataFrame:
    """(path, codec, length, bitrate, sample_rate, lossless, size) as texts, for reading."""
    from .reports import readable_bytes

    kbps, khz = F.format_string("%d Kbps", F.col("bitrate").cast("bigint")), F.format_string("%.1f kHz", F.col("sample_rate") / F.lit(1000.0))
    return files.select("path", "codec", length_text(F.col("length")).alias("length"), kbps.alias("bitrate"), khz.alias("sample_rate"), F.when(F.col("lossless"), "yes").otherwise("no").alias("lossless"), readable_bytes(F.col("size")).alias("size"))


COMMON = ("title", "artist", "album", "album_artist", "date", "genre", "track", "disk", "rating", "language")


def common_row(tags: DataFrame, names: tuple[str, ...] = COMMON) -> DataFrame:
    """One row for each file, a column for each of the common tags: its values, sorted and joined."""
    return tags.groupBy("path").pivot("tag", list(names)).agg(F.when(F.count("value") > 0, F.array_join(F.array_sort(F.collect_list(F.trim("value"))), ";")))


def metadata(tags: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each file: its technical columns, then its common tags; a file without tags has none."""
    wide = common_row(tags)
    own = [F.col(c).alias(f"tag_{c}" if c in files.columns else c) for c in wide.columns if c != "path"]
    return technical(files).join(wide.select("path", *own), "path", "left")


def merged_artists(wide: DataFrame) -> DataFrame:
    """The pivoted table with artist and album artist in one column where all files agree in both."""
    one = wide.select(F.count_if(~F.col("artist").eqNullSafe(F.col("album_artist")))).scalar() == 0
    return wide.select(*[c for c in wide.columns if c != "album_artist"], F.when(~one, F.col("album_artist")).alias("album_artist"), one.alias("artists_agree"))


def listing(tags: DataFrame, ids: DataFrame, tag_type: str) -> DataFrame:
    """(path, tag_id, tag, value): each file's tags with their ids in a format, long values shortened."""
    named = ids.filter(F.col("tag_type") == tag_type).select(F.col("name").alias("tag"), "tag_id")
    return tags.join(F.broadcast(named), "tag", "left").select("path", "tag_id", "tag", truncated(F.col("value")).alias("value"))


def physical_id(tags: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (path, tag_type, tag, value) with the tag's id in the file's own format; null where it has none."""
    return tags.join(F.broadcast(ids.withColumnRenamed("name", "tag")), ["tag_type", "tag"], "left")


def version_counts(files: DataFrame) -> DataFrame:
    """(version, n, share) of the files with a tag version."""
    own = files.filter("version IS NOT NULL").groupBy("version").agg(F.count("*").alias("n"))
    return own.select("version", "n", F.round(F.col("n") / own.agg(F.sum("n")).scalar(), 6).alias("share"))


def processed(files: DataFrame) -> DataFrame:
    """(kind, value) of what a scan met: its albums, artists, and the files with an error."""
    pair = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value"))
    failed = F.struct(F.lit("error").alias("kind"), F.when(F.col("error").isNotNull(), F.concat_ws(": ", "path", "error")).alias("value"))
    return files.select(F.explode(F.array(pair("album", "album"), pair("artist", "artist"), failed)).alias("x")).select("x.*").filter("value IS NOT NULL").distinct()


def album_length(tracks: DataFrame, by: str, seconds: str = "length") -> DataFrame:
    return tracks.groupBy(by).agg(F.sum(seconds).alias("seconds"))


def remove_plan(tags: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(path, tag, removed): what goes from each file, all tags by default, with the number of its values."""
    own = tags if names is None else tags.filter(F.col("tag").isin(names))
    return own.groupBy("path", "tag").agg(F.count("*").alias("removed"))


def copy_plan(source: DataFrame, target: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(disk, num, tag, old, new): tags to take over from another album's track of the same disk and number."""
    own = source if names is None else source.filter(F.col("tag").isin(names))
    at = ["disk", "num", "tag"]
    joined = lambda df, c: df.groupBy(*at).agg(F.array_join(F.array_sort(F.collect_set("value")), ";").alias(c))
    there = target.select("disk", "num").distinct()
    both = joined(own, "new").join(joined(target, "old"), at, "left").join(there, ["disk", "num"], "left_semi")
    return both.filter("NOT (old <=> new)").select(*at, "old", "new")
