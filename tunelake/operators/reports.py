"""Reports over the server's relational tables: join chains, stream data from URL-coded maps, grouped counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def extra(c: Column) -> Column:
    """A URL-coded map: keys and values are decoded after the split, pairs without a value go."""
    pairs = F.filter(F.split(c, "&"), lambda p: p.rlike("=.+$"))
    entry = lambda p: F.struct(F.url_decode(F.substring_index(p, "=", 1)).alias("key"), F.url_decode(F.regexp_extract(p, "=(.*)$", 1)).alias("value"))
    entries = F.transform(pairs, entry)
    # the first of a repeated key wins
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda f: f["key"] == e["key"])))


def num_loudness_keys(m: Column) -> Column:
    return F.size(F.filter(F.map_keys(m), lambda k: k.startswith("ld:")))


def height_lte_720(m: Column) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit("ma:height")).try_cast("int") <= 720, F.lit(False))


def resolution(m: Column) -> Column:
    """``WxH``, or null if either is missing."""
    return F.concat(F.try_element_at(m, F.lit("ma:width")), F.lit("x"), F.try_element_at(m, F.lit("ma:height")))


def join_chain(base: DataFrame, levels: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Inner joins in a row: (frame, prefix, column of the chain so far, column of the frame); columns get the prefix."""
    out = base
    for frame, prefix, here, there in levels:
        named = frame.select(*[F.col(c).alias(f"{prefix}_{c}") for c in frame.columns])
        out = out.join(named, out[here] == named[f"{prefix}_{there}"])
    return out


def stream_report(streams: DataFrame, items: DataFrame, metadata: DataFrame, sections: DataFrame, depth: int = 1) -> DataFrame:
    """Streams with their media item, metadata row, its parents up to a depth, and the section."""
    levels = [(items, "item", "media_item_id", "id"), (metadata, "m0", "item_metadata_item_id", "id")]
    levels += [(metadata, f"m{k}", f"m{k - 1}_parent_id", "id") for k in range(1, depth + 1)]
    return join_chain(streams, [*levels, (sections, "section", "item_library_section_id", "id")])


def low_res_counts(rows: DataFrame, show: str, res: str, height: str, limit: int = 720) -> DataFrame:
    """(show, resolution, n) for shows none of whose episodes is higher than the limit."""
    by = rows.groupBy(show, res).agg(F.count("*").alias("n"), F.max(height).alias("__h"))
    return by.withColumn("__top", F.max("__h").over(Window.partitionBy(show))).filter(F.col("__top") <= limit).select(show, res, "n")


def nested(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """One row for each combination of keys, with the sorted list of a value."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias(name))


#: The server's numbers of stream and metadata types.
STREAM_TYPES = {"video": 1, "audio": 2, "subtitle": 3}
META_TYPES = {"movie": 1, "show": 2, "season": 3, "episode": 4, "artist": 8, "album": 9, "track": 10}


def coerced(value: str | int, members: dict[str, int]) -> int:
    """A type's number, given by name in any case or by number."""
    number = members.get(value.lower(), int(value) if value.isdecimal() else None) if isinstance(value, str) else value
    if number not in members.values():
        raise ValueError(f"{value!r} is none of {', '.join(members)}")
    return number


def coerced_column(c: Column, members: dict[str, int]) -> Column:
    """:func:`coerced` of a column; null where it is none of the members."""
    named = F.create_map(*[F.lit(x) for pair in members.items() for x in pair])
    number = F.coalesce(F.try_element_at(named, F.lower(F.trim(c.cast("string")))), c.cast("string").try_cast("int"))
    return F.when(number.isin(*members.values()), number)


def readable_bytes(c: Column) -> Column:
    """``1.5 KB``: in the largest unit of 1024 that leaves one or more, two decimals from KB on."""
    units, out = ("B", "KB", "MB", "GB", "TB", "PB"), F.format_string("%d B", c.cast("bigint"))
    for k, unit in enumerate(units[1:], 1):
        out = F.when(c >= 1024**k, F.format_string(f"%,.2f {unit}", c / F.lit(float(1024**k)))).otherwise(out)
    return F.when(c.isNotNull(), out)


def readable_duration(seconds: Column) -> Column:
    """``1:02:03``, or ``2:03`` under an hour."""
    s = F.floor(seconds).cast("bigint")
    tail = F.format_string("%02d", s % 60)
    hour = F.concat_ws(":", F.floor(s / 3600).cast("string"), F.format_string("%02d", (F.floor(s / 60) % 60).cast("bigint")), tail)
    return F.when(s.isNotNull(), F.when(s >= 3600, hour).otherwise(F.concat_ws(":", F.floor(s / 60).cast("string"), tail)))


def media_streams(streams: DataFrame, kind: str | int) -> DataFrame:
    """The streams of a type."""
    return streams.filter(F.col("stream_type_id") == coerced(kind, STREAM_TYPES)).select("id", "media_item_id", "extra_data")


def _of_types(streams: DataFrame, items: DataFrame, metadata: DataFrame, kind: str | int, meta: str | int) -> DataFrame:
    """Streams (s), items (i) and metadata rows (m) that belong together, of these types."""
    s = streams.filter(F.col("stream_type_id") == coerced(kind, STREAM_TYPES)).alias("s")
    m = metadata.filter(F.col("metadata_type") == coerced(meta, META_TYPES)).alias("m")
    return s.join(items.alias("i"), F.expr("i.id = s.media_item_id")).join(m, F.expr("m.id = i.metadata_item_id"))


def stream_data(streams: DataFrame, items: DataFrame, metadata: DataFrame, kind: str | int, meta: str | int, metadata_id: int | None = None) -> DataFrame:
    """The streams of a type whose item belongs to metadata of a type, or to one row of it."""
    own = metadata if metadata_id is None else metadata.filter(F.col("id") == metadata_id)
    return _of_types(streams, items, own, kind, meta).select("s.*")


def item_data(streams: DataFrame, items: DataFrame, metadata: DataFrame, sections: DataFrame, kind: str | int, meta: str | int) -> DataFrame:
    """The media items with streams and metadata of these types, one row for each stream, with the section's name."""
    return _of_types(streams, items, metadata, kind, meta).join(sections.alias("l"), F.expr("l.id = i.library_section_id")).select(F.col("l.name").alias("lib_section"), "i.*")


def meta_data(streams: DataFrame, items: DataFrame, metadata: DataFrame, sections: DataFrame, kind: str | int, meta: str | int) -> DataFrame:
    """The metadata rows with items and streams of these types, one row for each stream, with the section's name."""
    return _of_types(streams, items, metadata, kind, meta).join(sections.alias("l"), F.expr("l.id = i.library_section_id")).select(F.col("l.name").alias("lib_section"), "m.*")


def chain(streams: DataFrame, items: DataFrame, metadata: DataFrame, sections: DataFrame, kind: str | int, *levels: str) -> DataFrame:
    """Streams with their item, the metadata rows of the levels from child to ancestor, and the section.

    Columns: resolution, extra, codec, size, duration, section; and <level>_id, <level>_title, <level>_index.
    """
    s = streams.filter(F.col("stream_type_id") == coerced(kind, STREAM_TYPES)).select("media_item_id", "codec", extra(F.col("extra_data")).alias("extra"))
    i = items.select(F.col("id").alias("__item"), "metadata_item_id", "library_section_id", "size", "duration")
    out = s.join(i, F.col("media_item_id") == F.col("__item"))
    link = "metadata_item_id"
    for level in levels:
        own = metadata.filter(F.col("metadata_type") == META_TYPES[level]).select(F.col("id").alias(f"{level}_id"), F.col("title").alias(f"{level}_title"), F.col("index").alias(f"{level}_index"), F.col("parent_id").alias(f"__{level}"))
        out, link = out.join(own, F.col(link) == F.col(f"{level}_id")), f"__{level}"
    out = out.join(sections.select(F.col("id").alias("__section"), F.col("name").alias("section")), F.col("library_section_id") == F.col("__section"))
    return out.withColumn("resolution", resolution(F.col("extra"))).select("resolution", "extra", "codec", "size", "duration", "section", *[f"{x}_{c}" for x in levels for c in ("id", "title", "index")])


def movies(server: tuple[DataFrame, ...], low_res: bool = False) -> DataFrame:
    """(movie_id, movie, resolution, size, section); server: streams, items, metadata, sections."""
    rows = chain(*server, "video", "movie")
    rows = rows.filter(height_lte_720(F.col("extra"))) if low_res else rows
    return rows.select("movie_id", F.col("movie_title").alias("movie"), "resolution", "size", "section")


def movies_by_codec(server: tuple[DataFrame, ...], codec: str | None = None) -> DataFrame:
    """(movie_id, movie, codec, resolution, size_b, size, duration, section), of one codec if given."""
    rows = chain(*server, "video", "movie")
    rows = rows.filter(F.col("codec") == codec) if codec else rows
    return rows.select("movie_id", F.col("movie_title").alias("movie"), "codec", "resolution", F.col("size").alias("size_b"), readable_bytes(F.col("size")).alias("size"), readable_duration(F.col("duration") / 1000).alias("duration"), "section")


def low_res_movies(server: tuple[DataFrame, ...]) -> DataFrame:
    """(movie, sizes): a map from each low resolution of the movie to its size, the largest of several."""
    best = movies(server, low_res=True).filter("resolution IS NOT NULL").groupBy("movie", "resolution").agg(F.max("size").alias("size"))
    return best.groupBy("movie").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("resolution", "size")))).alias("sizes"))


def shows(server: tuple[DataFrame, ...], low_res: bool = False) -> DataFrame:
    """Episodes with their season, show, resolution and section."""
    rows = chain(*server, "video", "episode", "season", "show")
    rows = rows.filter(height_lte_720(F.col("extra"))) if low_res else rows
    return rows.select("episode_id", F.col("episode_index").alias("episode_num"), "episode_title", F.col("season_index").alias("season_num"), F.col("show_title").alias("show"), "resolution", "section")


def show_map(server: tuple[DataFrame, ...]) -> DataFrame:
    """(show, seasons): the low resolution episodes of each show, season by season, as ``[number] title`` with resolution."""
    rows = shows(server, low_res=True)
    episode = F.struct("episode_num", F.concat(F.lit("["), "episode_num", F.lit("] "), "episode_title").alias("episode"), "resolution")
    season = rows.groupBy("show", "season_num").agg(F.array_sort(F.collect_list(episode)).alias("e"))
    season = season.withColumn("e", F.transform("e", lambda x: F.struct(x["episode"].alias("episode"), x["resolution"].alias("resolution"))))
    return season.groupBy("show").agg(F.array_sort(F.collect_list(F.struct("season_num", F.col("e").alias("episodes")))).alias("seasons"))


def missing_analysis(server: tuple[DataFrame, ...]) -> DataFrame:
    """Tracks without loudness keys, with album, artist and section; for the nested shapes see :func:`nested`."""
    rows = chain(*server, "audio", "track", "album", "artist").filter(num_loudness_keys(F.col("extra")) == 0)
    return rows.select("track_id", F.col("track_index").alias("track_num"), F.col("track_title").alias("track"), F.col("album_title").alias("album"), F.col("artist_title").alias("artist"), "section")


def subtotals(rows: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """(by, level, sums): the sums of each group, of ever fewer columns from the right, and of all; level has a bit for each column summed over."""
    return rows.rollup(*by).agg(F.grouping_id(*by).cast("int").alias("level"), *[c.alias(n) for n, c in sums.items()]).select(*by, "level", *sums)
