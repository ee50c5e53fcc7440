"""The library queries over the star-schema tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tunelake.functions import albums as titles, scalar, text
from tunelake.operators import matching, pages, playlists, reports, tags
from tunelake.operators.predicates import where
from tunelake.operators.results import ResultSet
from tunelake.plans import records, update
from tunelake.plans.text_query import merge_in
from tunelake.sources import catalog, playlist_files
from tunelake.sources.catalog import from_star, star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TRACK = """track AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS key, l_orderkey AS parent_key, o_custkey AS grandparent_key, p_name AS title,
  CASE WHEN l_returnflag = 'R' THEN 'Guest ' || p_brand END AS original_title, l_linenumber AS index, CAST(year(o_orderdate) AS INTEGER) AS parent_year,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS duration, nullif(CAST(floor(l_quantity / 5) AS INTEGER), 0) AS user_rating, l_returnflag AS mood,
  CASE WHEN l_linestatus = 'O' THEN 'flac' ELSE 'mp3' END AS codec, l_shipdate AS added_at, o_orderpriority AS genre,
  '/music/' || o_custkey || '/' || l_orderkey || '/' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '. ' || p_name || '.' || CASE WHEN l_linestatus = 'O' THEN 'flac' ELSE 'mp3' END AS file
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""
ITEMS = """items AS (SELECT 'list ' || user_id AS name, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, CAST(floor(value) AS BIGINT) AS track_key, event_type AS kind FROM events)"""


def query(sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


def on_tracks(name: str, condition: str, **filters) -> None:
    """A query of one predicate operator: the tracks' keys and what it looks at."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return where(catalog.tracks(spark, d), filters).select("key", "title", "user_rating")

    QUERIES[name], SQL[name] = run, f"WITH {TRACK} SELECT key, title, user_rating FROM track WHERE {condition}"


on_tracks("op_exact_missing_matches", "user_rating IS NULL OR user_rating = 0", user_rating=0)
on_tracks("op_exact", "user_rating = 7", user_rating=7)
on_tracks("op_iexact", "lower(title) = 'red widget'", title__iexact="Red WIDGET")
on_tracks("op_ne_null_safe", "original_title IS NULL OR original_title <> 'Guest Brand#11'", original_title__ne="Guest Brand#11")
on_tracks("op_contains", "contains(title, 'co')", title__contains="co")
on_tracks("op_icontains", "contains(lower(title), 'cold')", title__icontains="COLD")
on_tracks("op_startswith", "starts_with(title, 'c')", title__startswith="c")
on_tracks("op_iendswith", "ends_with(lower(title), 't')", title__iendswith="T")
on_tracks("op_in", "user_rating IN (1, 10)", user_rating__in=[1, 10])
on_tracks("op_not_in", "user_rating IS NULL OR user_rating NOT IN (2, 3, 4, 5, 6, 7, 8, 9)", user_rating__not_in=list(range(2, 10)))
on_tracks("op_not_contains", "NOT contains(title, 'o')", title__not_contains="o")
on_tracks("op_inot_contains_any", "NOT contains(lower(title), 'red') AND NOT contains(lower(title), 'cold')", title__inot_contains_any=["Red", "cold"])
on_tracks("op_inot_in", "NOT contains('guest brand#11 guest brand#12', lower(coalesce(original_title, '?')))", original_title__inot_in="Guest Brand#11 Guest Brand#12")
on_tracks("op_range", "user_rating > 3 AND user_rating <= 5 AND duration >= 5000000", user_rating__gt=3, user_rating__lte=5, duration__gte=5_000_000)
on_tracks("op_exists", "original_title IS NOT NULL", original_title__exists=True)
on_tracks("op_notset", "user_rating IS NULL", user_rating__notset=True)
on_tracks("op_regex", "regexp_matches(title, '^[a-m].*t$')", title__regex="^[a-m].*t$")
on_tracks("op_like_words", "regexp_matches(title, '(?i)c.*?t')", title__like="C T")
on_tracks("op_not_like_null", "original_title IS NULL OR NOT regexp_matches(original_title, '(?i)brand#[1-4]')", original_title__not_like="brand#[1-4]")
on_tracks("op_odd", "user_rating % 2 <> 0", user_rating__is_odd=True)
on_tracks("op_even", "user_rating % 2 = 0", user_rating__is_even=True)
on_tracks("op_generic_negation", "NOT starts_with(coalesce(original_title, ''), 'Guest Brand#1')", original_title__not__startswith="Guest Brand#1")
on_tracks("op_path_exists_array", "contains(lower(file), '/02. ')", media__part__file__icontains="/02. ")
on_tracks("op_path_all_negative", "NOT ends_with(file, 'flac')", media__codec__ne="flac")
on_tracks("op_eq", "user_rating = 3", user_rating__eq=3)
on_tracks("op_is", "user_rating IS NULL", user_rating__is=None)
on_tracks("op_endswith", "ends_with(title, 'bolt')", title__endswith="bolt")
on_tracks("op_istartswith", "starts_with(lower(title), 'red')", title__istartswith="RED")
on_tracks("op_inot_contains", "NOT contains(lower(title), 'ring')", title__inot_contains="RING")
on_tracks("op_inot_in_any", "original_title IS NULL OR NOT contains('guest brand#11', lower(original_title)) AND NOT contains('guest brand#12', lower(original_title))", original_title__inot_in_any=["guest brand#11", "guest brand#12"])
on_tracks("op_iregex", "regexp_matches(title, '(?i)^RED|BOLT$')", title__iregex="^RED|BOLT$")
on_tracks("op_sregex", "regexp_matches(title, 'o.t')", title__sregex="o.t")
on_tracks("op_nsregex", "original_title IS NULL OR NOT regexp_matches(original_title, '[135]$')", original_title__nsregex="[135]$")
on_tracks("op_like_exact", "regexp_matches(title, '(?i)d b')", title__like_exact="D B")
on_tracks("op_lt_missing", "user_rating < 3", user_rating__lt=3)
on_tracks("op_custom", "parent_key % 7 = index", any__custom=lambda df: df["parent_key"] % 7 == df["index"])
on_tracks("op_merged_in", "user_rating IN (2, 3)", **merge_in({"user_rating__in": [1, 2, 3]}, {"user_rating__in": [2, 3, 4]}))
on_tracks("op_missing_attribute", "user_rating >= 9", nothing__not_contains="x", user_rating__gte=9)


@query("SELECT DISTINCT t.key, t.title, t.duration FROM (SELECT *, row_number() OVER (PARTITION BY grandparent_key, lower(title) ORDER BY added_at DESC, key) AS n FROM track WHERE user_rating IS NULL AND grandparent_key IN (SELECT grandparent_key FROM track WHERE user_rating >= 10) AND (contains(lower(genre), 'high') OR contains(lower(genre), 'urgent')) AND contains(lower(title), 'cold') AND duration >= 100000) t WHERE n = 1", TRACK)
def flagship_known_artist_unrated(spark: SparkSession, d: str) -> DataFrame:
    """Unrated tracks by artists who have tracks with the highest rating: two semi-joins, filters, dedup."""
    rs = ResultSet.new(from_star(spark, d), "track", user_rating__gte=10).artists().tracks(user_rating__notset=True, title__icontains="cold", duration__gte=100_000)
    return rs.with_genre(genres__iregex="high|urgent").unique().df.select("key", "title", "duration")


@query("SELECT key, title, user_rating FROM track WHERE user_rating >= 6 AND parent_year = 1995 AND regexp_matches(title, '(?i)co') AND NOT regexp_matches(title, '(?i)inst(?:\\.?|rumental)')", TRACK)
def text_query_basic(spark: SparkSession, d: str) -> DataFrame:
    return ResultSet.query(from_star(spark, d), "track", "title~co rating>=6 year=1995").df.select("key", "title", "user_rating")


@query("SELECT key, title, user_rating FROM track WHERE contains(title, 'd b') AND user_rating <= 2", TRACK)
def text_query_quoted(spark: SparkSession, d: str) -> DataFrame:
    return ResultSet.query(from_star(spark, d), "track", 'title contains "d b" rating<=2', allow_inst=True).df.select("key", "title", "user_rating")


@query("SELECT key, title FROM track WHERE parent_key IN (SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1996)", TRACK)
def semi_from_album(spark: SparkSession, d: str) -> DataFrame:
    return ResultSet.new(from_star(spark, d), "track").from_album(year=1996).df.select("key", "title")


@query("SELECT key, title FROM track WHERE grandparent_key IN (SELECT c_custkey FROM customer WHERE contains(c_name, '01')) OR contains(coalesce(original_title, ''), '01')", TRACK)
def semi_from_artist_union(spark: SparkSession, d: str) -> DataFrame:
    return ResultSet.new(from_star(spark, d), "track").from_artist(title__contains="01").df.select("key", "title")


@query("SELECT key, title FROM track WHERE contains(genre, 'URGENT')", TRACK)
def semi_with_genre(spark: SparkSession, d: str) -> DataFrame:
    return ResultSet.new(from_star(spark, d), "track", genre__contains="URGENT").df.select("key", "title")


@query("SELECT key, title FROM track WHERE mood <> 'N'", TRACK)
def mood_negated(spark: SparkSession, d: str) -> DataFrame:
    return ResultSet.new(from_star(spark, d), "track", mood__ne="N").df.select("key", "title")


@query("SELECT c_custkey AS key, c_name AS title FROM customer WHERE c_custkey IN (SELECT grandparent_key FROM track WHERE user_rating = 10)", TRACK)
def nav_tracks_to_artists(spark: SparkSession, d: str) -> DataFrame:
    return ResultSet.new(from_star(spark, d), "track", user_rating=10).artists().df.select("key", "title")


@query("SELECT o_orderkey AS key, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AND year(o_orderdate) >= 1997")
def nav_artists_to_albums(spark: SparkSession, d: str) -> DataFrame:
    return ResultSet.new(from_star(spark, d), "artist", balance__gt=5000).albums(year__gte=1997).df.select("key", "year")


@query("SELECT DISTINCT key FROM track WHERE user_rating = 10 OR index = 1", TRACK)
def set_union(spark: SparkSession, d: str) -> DataFrame:
    c = from_star(spark, d)
    return (ResultSet.new(c, "track", user_rating=10) + ResultSet.new(c, "track", index=1)).df.select("key")


@query("SELECT key FROM track WHERE user_rating = 10 AND index <> 1", TRACK)
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    c = from_star(spark, d)
    return (ResultSet.new(c, "track", user_rating=10) - ResultSet.new(c, "track", index=1)).df.select("key")


@query("SELECT key FROM track WHERE user_rating = 10 AND index = 1", TRACK)
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    c = from_star(spark, d)
    return (ResultSet.new(c, "track", user_rating=10) & ResultSet.new(c, "track", index=1)).df.select("key")


@query("SELECT key, title FROM (SELECT *, row_number() OVER (PARTITION BY grandparent_key, lower(title) ORDER BY (coalesce(user_rating, 0) > 0) DESC, added_at DESC, key) AS n FROM track) WHERE n = 1", TRACK)
def dedup_unique_exact(spark: SparkSession, d: str) -> DataFrame:
    return ResultSet.new(from_star(spark, d), "track").unique().df.select("key", "title")


@query()
def dedup_unique_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    looked_at = catalog.tracks(spark, d, ("key", "title", "grandparent_key", "user_rating", "added_at"))
    return ResultSet(from_star(spark, d), "track", looked_at).unique_fuzzy().df.select("key", "title")


@query("SELECT key, title, duration FROM track ORDER BY duration DESC, key LIMIT 50 OFFSET 100", TRACK)
def topk_page(spark: SparkSession, d: str) -> DataFrame:
    return ResultSet.new(from_star(spark, d), "track").page(3, 50, F.desc("duration"), "key").select("key", "title", "duration")


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = catalog.playlist_items(spark, d)
    return items.filter("kind <> 'view' OR pos % 2 = 0"), items.filter("pos % 5 <> 4")


HALVES = "a AS (SELECT * FROM items WHERE kind <> 'view' OR pos % 2 = 0), b AS (SELECT * FROM items WHERE pos % 5 <> 4)"


@query("SELECT name, track_key, 'add' AS action FROM (SELECT DISTINCT name, track_key FROM b EXCEPT SELECT name, track_key FROM a) UNION ALL SELECT name, track_key, 'remove' FROM (SELECT DISTINCT name, track_key FROM a EXCEPT SELECT name, track_key FROM b)", ITEMS, HALVES)
def playlist_sync_plan(spark: SparkSession, d: str) -> DataFrame:
    return playlists.sync_plan(*_lists(spark, d))


@query("SELECT name, min(pos) AS pos FROM (SELECT coalesce(a.name, b.name) AS name, coalesce(a.pos, b.pos) AS pos FROM a FULL JOIN b ON a.name = b.name AND a.pos = b.pos WHERE a.track_key IS DISTINCT FROM b.track_key) GROUP BY name", ITEMS, HALVES)
def playlist_ordered_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return playlists.first_mismatch(*_lists(spark, d))


@query("SELECT name, 'remove' AS action, pos, track_key FROM a JOIN m USING (name) WHERE pos >= since UNION ALL SELECT name, 'append', pos, track_key FROM b JOIN m USING (name) WHERE pos >= since", ITEMS, HALVES, "m AS (SELECT name, min(pos) AS since FROM (SELECT coalesce(a.name, b.name) AS name, coalesce(a.pos, b.pos) AS pos FROM a FULL JOIN b ON a.name = b.name AND a.pos = b.pos WHERE a.track_key IS DISTINCT FROM b.track_key) GROUP BY name)")
def playlist_ordered_plan(spark: SparkSession, d: str) -> DataFrame:
    return playlists.ordered_plan(*_lists(spark, d))


@query("SELECT p_partkey AS key, p_name AS title, p_brand AS artist FROM part p WHERE p_size > 25 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size <= 25 AND lower(replace(q.p_name, ' ', '')) = lower(replace(p.p_name, ' ', '')) AND lower(replace(q.p_brand, ' ', '')) = lower(replace(p.p_brand, ' ', '')))")
def playlist_compare_loose(spark: SparkSession, d: str) -> DataFrame:
    p = star(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), "p_size")
    return playlists.compare_loose(p.filter("p_size > 25").drop("p_size"), p.filter("p_size <= 25").drop("p_size"), ["title", "artist"])


@query("SELECT name, count(*) AS n FROM items WHERE name LIKE 'list 1%' GROUP BY name HAVING count(*) <= 100", ITEMS)
def playlist_glob_size(spark: SparkSession, d: str) -> DataFrame:
    return playlists.matching(catalog.playlist_items(spark, d), "list 1*", 100)


@query("SELECT name, count(*) AS n, count(*) FILTER (p_partkey IS NULL) AS n_missing, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS duration FROM items LEFT JOIN part ON track_key = p_partkey GROUP BY name", ITEMS)
def playlist_info(spark: SparkSession, d: str) -> DataFrame:
    p = star(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("bigint").alias("duration"))
    return playlists.info(catalog.playlist_items(spark, d), p)


@query()
def playlist_restore(spark: SparkSession, d: str) -> DataFrame:
    """Every item of every list; a third of the tracks is gone, and what replaces them is searched among the others."""
    p = star(spark, d, "part").selectExpr("p_partkey AS key", "p_brand AS artist_key", "p_type AS album_key", "p_brand AS artist", "p_type AS album", "p_name AS title")
    here, gone = p.filter("key % 3 <> 0"), p.filter("key % 3 = 0").withColumnRenamed("key", "track_key")
    return playlists.restore(catalog.playlist_items(spark, d), here, matching.best_replacements(gone, here))


@query("SELECT key, name FROM track, (VALUES ('unrated'), ('3 stars and up'), ('4 stars and up'), ('5 stars'), ('singles of the nineties')) r(name) WHERE CASE name WHEN 'unrated' THEN user_rating IS NULL WHEN '3 stars and up' THEN user_rating >= 6 WHEN '4 stars and up' THEN user_rating >= 8 WHEN '5 stars' THEN user_rating = 10 ELSE parent_year BETWEEN 1990 AND 1999 AND index = 1 END", TRACK)
def playlist_rules(spark: SparkSession, d: str) -> DataFrame:
    return playlists.apply_rules(catalog.tracks(spark, d)).select("key", "name")


@query("SELECT user_rating, grandparent_key, title, count(*) AS n FROM track WHERE user_rating >= 1 AND mood <> 'N' GROUP BY ALL HAVING count(*) > 1", TRACK)
def ratings_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return playlists.ratings_duplicates(catalog.tracks(spark, d), mood="N")


@query("SELECT key, user_rating AS old, 10 AS new FROM track WHERE title = 'red widget' AND user_rating IS DISTINCT FROM 10 OR index = 7 AND user_rating IS DISTINCT FROM 10", TRACK)
def ratings_plan(spark: SparkSession, d: str) -> DataFrame:
    return playlists.rating_plan(catalog.tracks(spark, d).filter("title = 'red widget' OR index = 7"), 10)


@query("SELECT key, user_rating AS old, user_rating + 2 AS new FROM track WHERE user_rating BETWEEN 3 AND 8", TRACK)
def ratings_offset_plan(spark: SparkSession, d: str) -> DataFrame:
    return playlists.rating_offset(catalog.tracks(spark, d), 3, 8, 2)


@query("SELECT p_name || p_partkey AS path, nullif(p_size % 11, 0) AS file_stars, nullif(p_partkey % 7, 0)::INTEGER AS rating, 'write file' AS action FROM part WHERE nullif(p_size % 11, 0) IS DISTINCT FROM nullif(p_partkey % 7, 0) AND p_partkey % 7 >= 1")
def ratings_sync_plan(spark: SparkSession, d: str) -> DataFrame:
    p = star(spark, d, "part").withColumn("path", F.concat("p_name", "p_partkey"))
    files = p.select("path", F.expr("nullif(p_size % 11, 0) AS file_stars"))
    return playlists.rating_sync(files, p.select("path", F.expr("nullif(cast(p_partkey % 7 as int), 0) AS user_rating")), True)


@query("SELECT p_name || '-' || p_partkey AS file, p_size % 2 = 0 AS played FROM part WHERE (p_size % 2 = 0) <> (p_partkey % 3 = 0)")
def played_diff(spark: SparkSession, d: str) -> DataFrame:
    p = star(spark, d, "part").withColumn("file", F.concat_ws("-", "p_name", "p_partkey"))
    return playlists.played_diff(p.select("file", (F.col("p_partkey") % 3 == 0).alias("played")), p.select("file", (F.col("p_size") % 2 == 0).alias("played")))


def of_parts(columns: Callable[[], list[Column]], *names: str) -> Query:
    return lambda spark, d: star(spark, d, "part").select("p_partkey", *[c.alias(n) for c, n in zip(columns(), names, strict=True)])


def part_query(name: str, sql: str, columns: Callable[[], list[Column]], *names: str) -> None:
    QUERIES[name], SQL[name] = of_parts(columns, *names), f"SELECT p_partkey, {sql} FROM part"


part_query(
    "stars_from_256",
    "CASE WHEN x BETWEEN 1 AND 31 THEN 1 WHEN x BETWEEN 32 AND 95 THEN 2 WHEN x BETWEEN 96 AND 159 THEN 3 WHEN x BETWEEN 160 AND 223 THEN 4 WHEN x BETWEEN 224 AND 255 THEN 5 END AS five, CASE WHEN x BETWEEN 1 AND 14 THEN 1 WHEN x = 15 THEN 2 WHEN x BETWEEN 16 AND 31 THEN 3 WHEN x BETWEEN 32 AND 64 THEN 4 WHEN x BETWEEN 65 AND 95 THEN 5 WHEN x BETWEEN 96 AND 128 THEN 6 WHEN x BETWEEN 129 AND 159 THEN 7 WHEN x BETWEEN 160 AND 196 THEN 8 WHEN x BETWEEN 197 AND 223 THEN 9 WHEN x BETWEEN 224 AND 255 THEN 10 END AS ten FROM (SELECT p_partkey, p_partkey % 300 AS x FROM part) AS part --",
    lambda: [scalar.stars_from_256(F.col("p_partkey") % 300, 5), scalar.stars_from_256(F.col("p_partkey") % 300, 10)],
    "five",
    "ten",
)
part_query("stars_to_256", "[NULL, 1, 15, 16, 64, 65, 128, 129, 196, 197, 255, NULL][p_partkey % 12 + 1] AS rating, [NULL, 15, 64, 128, 196, 255, NULL][p_partkey % 7 + 1] AS five", lambda: [scalar.stars_to_256(F.col("p_partkey") % 12), scalar.stars_to_256(F.col("p_partkey") % 7, 5)], "rating", "five")
part_query("stars_text", "repeat('★', CAST((p_size % 11) // 2 AS INTEGER)) || repeat('½', p_size % 11 % 2) || repeat('✰', 5 - (p_size % 11) // 2 - p_size % 11 % 2) AS stars", lambda: [scalar.stars(F.col("p_size") % 11)], "stars")
part_query("duration_format", "CASE WHEN s >= 86400 THEN '(' || s // 86400 || ')d ' ELSE '' END || printf('%02d:%02d:%02d', s % 86400 // 3600, s % 3600 // 60, s % 60) AS clock FROM (SELECT p_partkey, CAST(floor(p_partkey * 73313 / 1000) AS BIGINT) AS s FROM part) AS part --", lambda: [scalar.duration(F.col("p_partkey") * 73313)], "clock")
part_query("path_sanitize", "replace(replace(translate('a/b:' || p_name || '|' || chr(92) || p_brand || '?*', '/:' || chr(92) || '|', '_-_-'), '?', ''), '*', '') AS path", lambda: [scalar.sanitize_path(F.concat(F.lit("a/b:"), "p_name", F.lit("|\\"), "p_brand", F.lit("?*")))], "path")
part_query("title_case", "list_aggregate(list_transform(string_split('the ' || p_name || ' OF a', ' '), lambda w, i: CASE WHEN i > 1 AND lower(w) IN ('an', 'to', 'in', 'a', 'by', 'the', 'and', 'but', 'for', 'at', 'of') THEN lower(w) ELSE upper(w[1]) || lower(w[2:]) END), 'string_agg', ' ') AS title", lambda: [scalar.title_case(F.concat(F.lit("the "), "p_name", F.lit(" OF a")))], "title")
part_query("ordinal_find", "CASE p_partkey % 3 WHEN 0 THEN CAST(p_partkey % 10 + 1 AS INTEGER) WHEN 1 THEN 2 END AS n", lambda: [scalar.find_ordinal(F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('The ', p_partkey % 10 + 1, CASE p_partkey % 10 + 1 WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END, ' Album') WHEN 1 THEN concat(p_name, ' Second single') ELSE p_name END"))], "n")
part_query("ordinal_format", "p_partkey || CASE WHEN p_partkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_partkey % 10 = 1 THEN 'st' WHEN p_partkey % 10 = 2 THEN 'nd' WHEN p_partkey % 10 = 3 THEN 'rd' ELSE 'th' END AS n", lambda: [scalar.ordinal(F.col("p_partkey"))], "n")
part_query("title_cleanup_regex", "CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '(96 kHz)' END AS title", lambda: [scalar.clean_title(F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" (96 kHz)"))).otherwise("(96 kHz)"))], "title")
part_query("album_part_split", "CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' x' END AS title, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS part", lambda: [scalar.album_part(_numbered())["title"], scalar.album_part(_numbered())["part"]], "title", "part")
part_query("file_title", "p_name AS title", lambda: [scalar.file_title(F.concat(F.lit("/x/y/"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(". "), "p_name", F.lit(".mp3")))], "title")
part_query("first_number", "CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 0 END AS n", lambda: [scalar.first_number(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("("), "p_size", F.lit(", 9)"))).otherwise("x"))], "n")
part_query("value_truncate", "CASE WHEN length(x) > 13 THEN x[1:5] || '...' || right(x, 5) ELSE x END AS short".replace("x", "(p_name || p_type)"), lambda: [tags.truncated(F.concat("p_name", "p_type"), 5, 5)], "short")
part_query("date_multi_format", "CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_partkey % 5 = 3 THEN make_date(2000 + p_size, 1, 1) ELSE make_date(2000 + p_size, 3, 7) END AS day", lambda: [scalar.parse_date(F.expr("CASE p_partkey % 5 WHEN 0 THEN concat(2000 + p_size, '-03-07') WHEN 1 THEN concat(2000 + p_size, '0307') WHEN 2 THEN concat('March 7, ', 2000 + p_size) WHEN 3 THEN string(2000 + p_size) ELSE 'soon' END"))], "day")
part_query("number_words", "CASE p_partkey % 3 WHEN 0 THEN 342::BIGINT WHEN 1 THEN 2000015::BIGINT END AS n", lambda: [scalar.int_words(F.expr("CASE p_partkey % 3 WHEN 0 THEN 'three hundred and forty-two' WHEN 1 THEN 'two million fifteen' ELSE p_name END"))], "n")
part_query("script_category", "CASE p_partkey % 4 WHEN 0 THEN 'hangul' WHEN 1 THEN 'mixed' WHEN 2 THEN 'japanese' ELSE 'latin' END AS script", lambda: [scalar.script(F.expr("CASE p_partkey % 4 WHEN 0 THEN '한글' WHEN 1 THEN concat(p_name, ' 한') WHEN 2 THEN 'かな' ELSE p_name END"))], "script")
part_query("target_path", "replace(p_mfgr, '#', '#') || '/Albums/[2001.02.' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') || '] ' || p_name || ' [3rd Album]' AS path".replace("p_mfgr", "p_brand"), lambda: [update.album_folder(F.col("p_brand"), F.lit("Album"), F.make_date(F.lit(2001), F.lit(2), F.col("p_size") % 28 + 1), F.col("p_name"), F.lit("3rd"))], "path")
part_query("target_file_name", "CASE WHEN p_partkey % 2 = 0 THEN '02-' ELSE '' END || lpad(CAST(p_size AS VARCHAR), 2, '0') || '. ' || p_name || '.flac' AS file", lambda: [update.file_name(F.col("p_size"), F.lit(2), F.when(F.col("p_partkey") % 2 == 0, 2).otherwise(1), F.col("p_name"), F.lit("flac"))], "file")


def _numbered() -> Column:
    return F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" Part."), "p_size")).otherwise(F.concat("p_name", F.lit(" x")))


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def report_join_chain(spark: SparkSession, d: str) -> DataFrame:
    chain = reports.join_chain(star(spark, d, "supplier"), [(star(spark, d, "nation"), "n", "s_nationkey", "n_nationkey"), (star(spark, d, "region"), "r", "n_n_regionkey", "r_regionkey")])
    return chain.select("s_suppkey", "s_name", F.col("n_n_name").alias("n_name"), F.col("r_r_name").alias("r_name")).filter("r_name <> 'ASIA'")


def _extra() -> Column:
    return F.expr("concat('ma%3Aheight=', p_size * 30, CASE WHEN p_partkey % 4 <> 0 THEN concat('&ma%3Awidth=', p_size * 40) ELSE '' END, '&ld%3Apeak=', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '1' END, CASE WHEN p_partkey % 5 = 0 THEN '&ld%3Again=x' ELSE '' END)")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_size * 40 || 'x' || p_size * 30 END AS resolution, p_size * 30 <= 720 AS low FROM part")
def report_resolution_map(spark: SparkSession, d: str) -> DataFrame:
    m = star(spark, d, "part").select("p_partkey", reports.extra(_extra()).alias("m"))
    return m.select("p_partkey", reports.resolution(F.col("m")).alias("resolution"), reports.height_lte_720(F.col("m")).alias("low"))


@query("SELECT p_partkey, CAST((p_partkey % 3 <> 0)::INT + (p_partkey % 5 = 0)::INT AS INTEGER) AS n FROM part")
def report_loudness_keys(spark: SparkSession, d: str) -> DataFrame:
    return star(spark, d, "part").select("p_partkey", reports.num_loudness_keys(reports.extra(_extra())).alias("n"))


@query("SELECT p_name, list_sort(list(p_partkey)) AS keys FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0 GROUP BY p_name")
def report_missing_keys(spark: SparkSession, d: str) -> DataFrame:
    p = star(spark, d, "part").withColumn("n", reports.num_loudness_keys(reports.extra(_extra())))
    return reports.nested(p.filter("n = 0"), ["p_name"], F.col("p_partkey"), "keys")


@query("SELECT p_name, p_size * 40 || 'x' || p_size * 30 AS resolution, count(*) AS n FROM part WHERE p_name || p_brand IN (SELECT p_name || p_brand FROM part GROUP BY 1 HAVING max(p_size * 30) <= 1200) GROUP BY p_name, p_brand, 2")
def report_low_res_shows(spark: SparkSession, d: str) -> DataFrame:
    p = star(spark, d, "part").select(F.concat_ws("|", "p_name", "p_brand").alias("show"), F.expr("concat(p_size * 40, 'x', p_size * 30) AS resolution"), (F.col("p_size") * 30).alias("height"))
    return reports.low_res_counts(p, "show", "resolution", "height", 1200).select(F.substring_index("show", "|", 1).alias("p_name"), "resolution", "n")


def _tags(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files: three tags each, the brand missing for some."""
    rows = F.array(F.struct(F.lit("title").alias("tag"), F.col("p_name").alias("value")), F.struct(F.lit("genre").alias("tag"), F.col("p_type").alias("value")), F.struct(F.lit("artist").alias("tag"), F.expr("CASE WHEN p_partkey % 4 <> 0 THEN p_brand END").alias("value")))
    return star(spark, d, "part").select(F.col("p_partkey").alias("path"), F.explode(rows).alias("t")).select("path", "t.tag", "t.value").filter("value IS NOT NULL")


TAGS = "tags AS (SELECT p_partkey AS path, 'title' AS tag, p_name AS value FROM part UNION ALL SELECT p_partkey, 'genre', p_type FROM part UNION ALL SELECT p_partkey, 'artist', p_brand FROM part WHERE p_partkey % 4 <> 0)"


@query("SELECT tag, count(*) AS n, count(DISTINCT path) AS n_files, count(DISTINCT value) AS n_values, round(count(DISTINCT path) / (SELECT count(*) FROM part), 6) AS share, round(count(*) / count(DISTINCT path), 6) AS per_file FROM tags GROUP BY tag", TAGS)
def tags_profile(spark: SparkSession, d: str) -> DataFrame:
    return tags.profile(_tags(spark, d))


@query("SELECT tag, value, count(*) AS n FROM tags GROUP BY ALL", TAGS)
def tags_unique_values(spark: SparkSession, d: str) -> DataFrame:
    return tags.unique_values(_tags(spark, d))


@query("SELECT p_partkey AS path, p_name AS title, p_type AS genre, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS artist FROM part")
def tags_pivot(spark: SparkSession, d: str) -> DataFrame:
    return tags.pivot(_tags(spark, d), ["title", "genre", "artist"])


@query("SELECT path, tag, value AS old, value || ' x' AS new FROM tags WHERE tag = 'artist' AND path % 3 = 0 UNION ALL SELECT path, tag, value, CASE WHEN value < 'pop' THEN value || ';pop' ELSE 'pop;' || value END FROM tags WHERE tag = 'genre' AND path % 2 = 0", TAGS)
def tags_diff_genre_sets(spark: SparkSession, d: str) -> DataFrame:
    old = _tags(spark, d)
    new = old.withColumn("value", F.expr("CASE WHEN tag = 'artist' AND path % 3 = 0 THEN concat(value, ' x') WHEN tag = 'genre' AND path % 2 = 0 THEN 'pop' ELSE value END"))
    return tags.tag_diff(old, new, add=True)


#: What a retagging would change: a constant, a tag of each file, one that only some have, one whose new values differ, one that is added.
CHANGES = """diff AS (SELECT p_partkey AS path, unnest([{'tag': 'genre', 'old': 'a', 'new': 'b'}, {'tag': 'title', 'old': p_name, 'new': 'x'}, {'tag': 'comment', 'old': 'c', 'new': CASE WHEN p_partkey % 2 = 0 THEN 'd' ELSE 'e' END}, {'tag': 'source', 'old': NULL, 'new': 'rip'},
  {'tag': 'artist', 'old': CASE WHEN p_partkey % 4 <> 0 THEN 'f' END, 'new': 'g'}]) AS c FROM part)"""


@query("SELECT c.tag AS tag, min(c.old) AS old, min(c.new) AS new FROM diff GROUP BY c.tag HAVING count(DISTINCT path) = (SELECT count(*) FROM part) AND count(DISTINCT coalesce('=' || c.old, '')) = 1 AND count(DISTINCT coalesce('=' || c.new, '')) = 1", CHANGES)
def tags_common_changes(spark: SparkSession, d: str) -> DataFrame:
    p = star(spark, d, "part")
    some = "named_struct('tag', 'comment', 'old', 'c', 'new', IF(p_partkey % 2 = 0, 'd', 'e')), named_struct('tag', 'source', 'old', string(null), 'new', 'rip'), named_struct('tag', 'artist', 'old', IF(p_partkey % 4 <> 0, 'f', null), 'new', 'g')"
    diff = p.select(F.col("p_partkey").alias("path"), F.explode(F.expr(f"array(named_struct('tag', 'genre', 'old', 'a', 'new', 'b'), named_struct('tag', 'title', 'old', p_name, 'new', 'x'), {some})")).alias("c")).select("path", "c.*")
    return tags.common_changes(diff, p.select(F.col("p_partkey").alias("path")))


@query("SELECT path, value AS old, replace(value, 'co', 'ko') AS new FROM tags WHERE tag = 'title' AND contains(value, 'co')", TAGS)
def tags_set_partial(spark: SparkSession, d: str) -> DataFrame:
    return tags.set_plan(_tags(spark, d), "title", "ko", "co", partial=True)


@query("SELECT l_orderkey, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS l_returnflag, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) END AS l_linestatus FROM lineitem GROUP BY l_orderkey")
def album_consensus(spark: SparkSession, d: str) -> DataFrame:
    return tags.consensus(star(spark, d, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])


@query("SELECT l_orderkey, l_suppkey, n FROM (SELECT l_orderkey, l_suppkey, count(*) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, l_suppkey) AS r FROM lineitem GROUP BY l_orderkey, l_suppkey) WHERE r = 1")
def album_mode_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    return tags.mode(star(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("SELECT l_orderkey, l_returnflag FROM lineitem GROUP BY l_orderkey, l_returnflag HAVING count(DISTINCT l_linenumber) = (SELECT count(DISTINCT l_linenumber) FROM lineitem i WHERE i.l_orderkey = lineitem.l_orderkey)")
def album_common_genres(spark: SparkSession, d: str) -> DataFrame:
    return tags.common_values(star(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT o_custkey, o_orderkey AS key, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY 'album ' || o_orderkey, o_orderkey)")
def album_neighbours(spark: SparkSession, d: str) -> DataFrame:
    a = catalog.albums(spark, d).withColumnRenamed("parent_key", "o_custkey")
    return tags.neighbours(a, "o_custkey")


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS site FROM pages")
def page_site(spark: SparkSession, d: str) -> DataFrame:
    return star(spark, d, "pages").select("page_id", pages.site(F.col("url")).alias("site"))


CATEGORIES = "CASE p_size % 5 WHEN 0 THEN array('Test albums', 'Singles of 2001') WHEN 1 THEN array('Music groups', 'Test artists', 'Test group members') WHEN 2 THEN array('Drama OSTs') WHEN 3 THEN array('Album discography', p_name) ELSE array('Artists discographies', 'Singers') END"


@query("SELECT p_partkey AS url, CASE p_size % 5 WHEN 0 THEN 'Single' WHEN 1 THEN 'Group' WHEN 2 THEN 'TVSeries' WHEN 3 THEN 'Discography' ELSE 'Singer' END AS class, CASE p_size % 5 WHEN 1 THEN 2 ELSE 1 END AS score FROM part")
def classifier_scores(spark: SparkSession, d: str) -> DataFrame:
    p = star(spark, d, "part").select(F.col("p_partkey").alias("url"), F.expr(CATEGORIES).alias("categories"))
    return pages.classify(p).select("url", "class", F.col("score").cast("int").alias("score"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Single' WHEN 2 THEN 'Soundtrack' WHEN 3 THEN 'Album' ELSE 'UNKNOWN' END AS kind FROM part")
def album_type_order(spark: SparkSession, d: str) -> DataFrame:
    return star(spark, d, "part").select("p_partkey", pages.album_type(F.expr(CATEGORIES)).alias("kind"))


@query("SELECT p_brand AS artist, 1990 + p_size AS year, upper(p_name) || ' OST' AS name, 'Album' AS type, list_sort(list_distinct(list('site' || p_partkey % 2))) AS sites, list_sort(list_distinct(list('l' || p_partkey))) AS links FROM part GROUP BY p_brand, p_size, p_name")
def disco_merge(spark: SparkSession, d: str) -> DataFrame:
    p = star(spark, d, "part").select(F.col("p_brand").alias("artist"), (F.col("p_size") + 1990).alias("year"), F.expr("concat(p_name, CASE WHEN p_partkey % 2 = 0 THEN ' OST Part 1' ELSE ' Ost' END) AS title"), F.lit("Album").alias("type"), F.expr("concat('site', p_partkey % 2) AS site"), F.expr("concat('l', p_partkey) AS link"))
    return pages.merge_discographies(p)


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '2001' WHEN 1 THEN '2000' ELSE '1999' END AS day FROM part")
def edition_date_fallback(spark: SparkSession, d: str) -> DataFrame:
    dates = F.expr("CASE p_partkey % 3 WHEN 0 THEN map('limited', '2001', '', '2000') WHEN 1 THEN map('other', '1998', '', '2000') ELSE map('other', '1999', 'another', '2005') END")
    return star(spark, d, "part").select("p_partkey", pages.edition_date(dates, F.lit("Limited")).alias("day"))


@query("SELECT conv_id, turn AS num, role AS eng, last_value(CASE WHEN turn % 3 = 0 THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS UNBOUNDED PRECEDING) AS non_eng FROM conversations")
def track_title_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    c = star(spark, d, "conversations").select("conv_id", F.col("turn").alias("num"), F.col("role").alias("eng"), F.when(F.col("turn") % 3 == 0, F.md5(F.col("text").cast("binary"))).alias("non_eng"))
    return pages.fill_titles(c, ["conv_id"])


@query("SELECT s_nationkey, count(*) FILTER (s_suppkey % 3 = 0) AS n_full, count(*) FILTER (s_suppkey % 3 = 1) AS n_parts, count(*) FILTER (s_suppkey % 3 = 2) AS n_extras FROM supplier GROUP BY s_nationkey")
def soundtrack_split(spark: SparkSession, d: str) -> DataFrame:
    s = star(spark, d, "supplier").select("s_nationkey", F.expr("CASE WHEN s_suppkey % 3 = 1 THEN 1 END AS part"), (F.col("s_suppkey") % 3 == 2).alias("extra"))
    return pages.soundtrack_split(s, "s_nationkey")


@query("SELECT conv_id, turn, CAST(a.n AS INTEGER) AS n, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) a JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) b ON conv_id = l_orderkey AND a.n = b.n")
def zip_positional(spark: SparkSession, d: str) -> DataFrame:
    line = star(spark, d, "lineitem").withColumnRenamed("l_orderkey", "conv_id")
    return pages.zip_positional(star(spark, d, "conversations"), line, "conv_id", ["turn"], ["l_linenumber", "l_partkey", "l_suppkey"], "turn", "l_partkey")


@query("SELECT p_brand, a.p_partkey AS path, b.p_partkey AS track FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, p_size % 2, p_size) AS n FROM part WHERE p_partkey % 3 = 0) a JOIN (SELECT *, count(*) OVER (PARTITION BY p_brand, p_size % 2, p_size) AS n FROM part WHERE p_partkey % 3 <> 0) b USING (p_brand, p_size) WHERE a.n = 1 AND b.n = 1")
def zip_disk_number(spark: SparkSession, d: str) -> DataFrame:
    p = star(spark, d, "part").withColumn("disk", F.col("p_size") % 2).withColumn("num", F.col("p_size"))
    files = p.filter("p_partkey % 3 = 0").withColumn("path", F.col("p_partkey"))
    return update.zip_files(files.select("p_brand", "disk", "num", "path"), p.filter("p_partkey % 3 <> 0").select("p_brand", "disk", "num", F.col("p_partkey").alias("track")), "p_brand")


@query("SELECT p_name, p_partkey FROM part p WHERE p_size > 45 OR NOT EXISTS (SELECT 1 FROM part q WHERE q.p_name = p.p_name AND q.p_brand = p.p_brand AND q.p_size > 45)")
def candidate_filter_keep_if_any(spark: SparkSession, d: str) -> DataFrame:
    p = star(spark, d, "part").select("p_name", "p_partkey", F.concat("p_name", "p_brand").alias("g"), (F.col("p_size") > 45).alias("good"))
    return pages.keep_if_any(p, "g", "good").select("p_name", "p_partkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_partkey % 3 = 0 AND p_size > 20 THEN 'new' ELSE p_brand END AS p_brand FROM part")
def merge_overlay(spark: SparkSession, d: str) -> DataFrame:
    p = star(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    other = p.filter("p_partkey % 3 = 0").select("p_partkey", F.upper("p_name").alias("p_name"), F.when(F.col("p_size") > 20, "new").alias("p_brand"))
    return update.merge_overlay(p.drop("p_size"), other, "p_partkey", ["p_name", "p_brand"])


@query("SELECT p_partkey, 'p_name' AS field, p_name AS old, 'x' AS new FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR), NULL FROM part WHERE p_size < 5")
def edit_diff(spark: SparkSession, d: str) -> DataFrame:
    p = star(spark, d, "part")
    new = p.select("p_partkey", F.expr("CASE WHEN p_size > 40 THEN 'x' ELSE p_name END AS p_name"), F.expr("CASE WHEN p_size >= 5 THEN p_size END AS p_size"))
    return update.edit_diff(p, new, "p_partkey", ["p_name", "p_size"])


@query("SELECT path, target, CASE WHEN target IN (SELECT path FROM f WHERE path = target) THEN 'exists' WHEN n > 1 THEN 'collides' ELSE 'move' END AS status FROM (SELECT *, count(*) OVER (PARTITION BY target) AS n FROM f WHERE path <> target)", "f AS (SELECT 'p' || p_partkey AS path, CASE WHEN p_partkey % 4 = 0 THEN 'p' || p_partkey WHEN p_partkey % 4 = 1 THEN 'p' || (p_partkey - 1) WHEN p_partkey % 4 = 2 THEN 'q' || p_size ELSE 'r' || p_partkey END AS target FROM part)")
def move_collisions(spark: SparkSession, d: str) -> DataFrame:
    p = star(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('p', p_partkey) WHEN 1 THEN concat('p', p_partkey - 1) WHEN 2 THEN concat('q', p_size) ELSE concat('r', p_partkey) END AS target"))
    return update.move_plan(p)


@query("SELECT p_partkey AS path, 'title' AS tag, p_name AS value FROM part UNION ALL SELECT p_partkey, 'track', CAST(p_size AS VARCHAR) FROM part WHERE p_size > 10")
def target_tags(spark: SparkSession, d: str) -> DataFrame:
    p = star(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("track"))
    return update.target_tags(p, ["title", "track"])


@query("SELECT name, pos, track_key FROM items", ITEMS)
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return playlist_files.from_json(playlist_files.to_json(catalog.playlist_items(spark, d)))


@query("SELECT p_name AS name, p_brand AS artist, CAST(p_size // 10 AS INTEGER) AS rating FROM part")
def itunes_tracks(spark: SparkSession, d: str) -> DataFrame:
    p = star(spark, d, "part").select(F.expr("concat('<dict><key>Name</key><string>', p_name, '</string><key>Artist</key><string>', p_brand, '</string><key>Rating</key><integer>', p_size, '</integer></dict>') AS value"))
    return playlist_files.itunes_tracks(p)


@query("SELECT p_partkey, lower(p_brand) AS x FROM part WHERE false UNION ALL SELECT p_partkey, trim(replace(lower(p_brand), '#', ' ')) || ' ' || p_name AS x FROM part")
def fuzz_process(spark: SparkSession, d: str) -> DataFrame:
    return star(spark, d, "part").select("p_partkey", text.fuzz_process_udf(F.concat_ws("  ", "p_brand", "p_name")).alias("x"))


@query("SELECT p_partkey, [p_name, p_brand, p_type] AS parts FROM part")
def enclosed_split(spark: SparkSession, d: str) -> DataFrame:
    return star(spark, d, "part").select("p_partkey", text.split_enclosed_udf(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") "), "p_type")).alias("parts"))


@query()
def weighted_ratio(spark: SparkSession, d: str) -> DataFrame:
    return star(spark, d, "part").select("p_partkey", text.weighted_ratio_udf("p_name", "p_type").alias("score"))


@query("SELECT p_partkey, [p_name, p_brand || ' (a, b)', p_type] AS artists FROM part")
def artist_split(spark: SparkSession, d: str) -> DataFrame:
    return star(spark, d, "part").select("p_partkey", text.split_balanced_udf(F.concat("p_name", F.lit(", "), "p_brand", F.lit(" (a, b) & "), "p_type")).alias("artists"))



@query("SELECT grandparent_key, CAST(sum(n) AS BIGINT) AS n, list_sort(list_distinct(list(title))) AS titles FROM (SELECT user_rating, grandparent_key, title, count(*) AS n FROM track WHERE user_rating >= 1 GROUP BY ALL HAVING count(*) > 1) GROUP BY grandparent_key", TRACK)
def ratings_duplicates_by_artist(spark: SparkSession, d: str) -> DataFrame:
    return playlists.duplicates_by_artist(playlists.ratings_duplicates(catalog.tracks(spark, d)))


@query("SELECT DISTINCT parent_key FROM track WHERE title = 'red bolt'", TRACK)
def blank_title_albums(spark: SparkSession, d: str) -> DataFrame:
    t = catalog.tracks(spark, d).withColumn("title", F.when(F.col("title") == "red bolt", "").otherwise(F.col("title")))
    return playlists.blank_titles(t)


@query("SELECT grandparent_key, parent_key, list_sort(list_distinct(list(title))) AS titles FROM track GROUP BY ALL", TRACK)
def title_tree(spark: SparkSession, d: str) -> DataFrame:
    tree = playlists.title_tree(catalog.tracks(spark, d))
    return tree.select("grandparent_key", F.explode("albums").alias("parent_key", "titles"))


@query("SELECT grandparent_key, count(*) AS n FROM track WHERE user_rating > 8 GROUP BY 1", TRACK)
def sql_over_views(spark: SparkSession, d: str) -> DataFrame:
    return from_star(spark, d).sql(spark, "SELECT grandparent_key, count(*) AS n FROM track WHERE user_rating > :least GROUP BY 1", least=8)


part_query("album_name_parse", "p_name AS name, CASE WHEN p_size % 3 = 0 THEN '2nd Mini Album' END AS num, CASE p_size % 3 WHEN 0 THEN 'Mini Album' WHEN 1 THEN 'Soundtrack' END AS type, CASE WHEN p_size % 3 = 1 THEN p_size END AS part, CASE WHEN p_size % 3 = 2 THEN ['A', 'B'] ELSE [] END AS feat", lambda: [titles.parse_album(_album())[c] for c in ("name", "num", "type", "part", "feat")], "name", "num", "type", "part", "feat")
part_query("track_extras", "CASE p_size % 5 WHEN 0 THEN 'instrumental' WHEN 1 THEN 'version' WHEN 2 THEN 'remix' WHEN 3 THEN 'other' END AS kind", lambda: [titles.track_extras(F.concat("p_name", F.expr("element_at(array(' (Inst.)', ' (Japanese ver.)', ' [EDM Remix]', ' (x)', ''), p_size % 5 + 1)")))], "kind")
part_query("full_title", "p_name || CASE WHEN p_size > 20 THEN ' (' || p_brand || ')' ELSE '' END || ' (x)' AS title", lambda: [titles.full_title(F.col("p_name"), F.when(F.col("p_size") > 20, F.col("p_brand")), F.lit("x"))], "title")
part_query("page_language", "CASE p_size % 3 WHEN 0 THEN 'Japanese' WHEN 1 THEN 'English' ELSE 'Korean' END AS language", lambda: [pages.page_language(F.expr("CASE p_size % 3 WHEN 0 THEN array('Japanese singles', 'x') WHEN 1 THEN array('Korean-Japanese songs') ELSE array() END"), F.when(F.col("p_size") % 3 == 2, "노래").otherwise(F.col("p_name")))], "language")
part_query("numbered_type", "p_size || CASE WHEN p_size % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END || ' Japanese Album' || CASE WHEN p_partkey % 2 = 0 THEN ' Repackage' ELSE '' END AS kind", lambda: [pages.numbered_type(F.col("p_size"), F.lit("Japanese"), F.lit("Album"), F.col("p_partkey") % 2 == 0)], "kind")
part_query("intro_names", "[p_name, 'x' || p_size, 'Other ' || p_brand] AS names", lambda: [titles.intro_names(F.concat("p_name", F.lit(" (x"), "p_size", F.lit("), also known as Other "), "p_brand", F.lit(" is a song. It was out.")))], "names")


def _album() -> Column:
    return F.expr("CASE p_size % 3 WHEN 0 THEN concat(p_name, ' [2nd Mini Album]') WHEN 1 THEN concat(p_name, ' OST Part.', p_size) ELSE concat(p_name, ' (feat. A & B)') END")


def _entries(spark: SparkSession, d: str, side: str) -> DataFrame:
    p = star(spark, d, "part").filter(f"p_partkey % 2 = {0 if side == 'album' else 1}")
    return p.select(F.col("p_partkey").alias(side), F.concat("p_brand", F.lit("/"), "p_size").alias("artist"), F.col("p_name").alias("name"), F.expr("CASE WHEN p_size % 2 = 0 THEN 'EP' ELSE 'Album' END AS type"), (F.col("p_partkey") % 3).alias("num"), F.lit(False).alias("repackage"))


def _narrowed(spark: SparkSession, d: str) -> DataFrame:
    line = star(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("num"), F.concat_ws("-", "l_orderkey", "l_partkey").alias("title"))
    files = line.withColumnRenamed("l_orderkey", "album")
    pairs = files.select("album").distinct().select("album", F.explode(F.array(F.col("album") + 1, F.col("album") + 2)).alias("entry"))
    tracks = line.withColumnRenamed("l_orderkey", "entry")
    pairs = pairs.join(tracks.select("entry").distinct(), "entry", "left_semi")
    return matching.narrowed(matching.track_overlap(pairs, files, tracks))


@query()
def album_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the same artist and type by fuzzy name, or by number."""
    return matching.album_candidates(_entries(spark, d, "album"), _entries(spark, d, "entry")).select("album", "entry", "by")


@query("SELECT a.l_orderkey AS album, b.l_orderkey AS entry FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) a JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) b ON b.l_orderkey IN (a.l_orderkey + 1, a.l_orderkey + 2) WHERE a.n = b.n OR NOT EXISTS (SELECT 1 FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) c WHERE c.l_orderkey IN (a.l_orderkey + 1, a.l_orderkey + 2) AND c.n = a.n)")
def candidates_narrowed(spark: SparkSession, d: str) -> DataFrame:
    """All orders as files against the next two as entries."""
    return _narrowed(spark, d)


@query("SELECT c_nationkey AS title, c_mktsegment AS site, min(c_custkey) AS page FROM customer GROUP BY ALL")
def pages_by_title(spark: SparkSession, d: str) -> DataFrame:
    c = star(spark, d, "customer").select(F.col("c_nationkey").alias("title"), F.col("c_mktsegment").alias("site"), F.col("c_custkey").alias("page_id"))
    return matching.pages_by_title(c).select("title", F.explode("pages").alias("site", "page"))


@query("SELECT n_name, CASE WHEN n_name = upper(n_name) THEN array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE n_name END AS retry FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def unresolved_titles(spark: SparkSession, d: str) -> DataFrame:
    n = star(spark, d, "nation")
    found = n.join(star(spark, d, "supplier").filter("s_acctbal < 0"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi")
    return matching.unresolved(n, found, "n_name", F.col("n_name")).select("n_name", "retry")


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 3")
def top_per_group(spark: SparkSession, d: str) -> DataFrame:
    return matching.top_per_group(star(spark, d, "customer"), "c_nationkey", [F.desc("c_acctbal"), "c_custkey"], 3).select("c_nationkey", "c_custkey")


@query("SELECT l_orderkey AS folder, max(l_linenumber % 2)::INTEGER AS disks, list_sort(CASE WHEN count(DISTINCT l_returnflag) = 1 THEN ['all', min(l_returnflag)] ELSE ['all'] END) AS genres, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY l_orderkey")
def album_records(spark: SparkSession, d: str) -> DataFrame:
    files = star(spark, d, "lineitem").select(F.col("l_orderkey").alias("folder"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("path"), (F.col("l_linenumber") % 2).alias("disk"), F.col("l_linenumber").alias("num"), F.col("l_partkey").cast("string").alias("title"), F.lit("a").alias("album"), F.lit("b").alias("artist"), F.array(F.lit("all"), "l_returnflag").alias("genres"))
    back = records.from_json(records.to_json(records.from_files(files)))
    return back.select("folder", "disks", "genres", F.size("tracks").alias("n"))


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 3 = 0 THEN '/m/' || n_name WHEN n_nationkey % 3 = 1 THEN '/m/' || lower(n_name) END AS found FROM nation")
def found_in_library(spark: SparkSession, d: str) -> DataFrame:
    n = star(spark, d, "nation").select("n_nationkey", "n_name")
    folders = n.filter("n_nationkey % 3 < 2").select(F.expr("concat('/m/', CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE lower(n_name) END) AS path"))
    return records.in_library(n, folders, F.concat(F.lit("/m/"), "n_name"), F.concat(F.lit("/m/"), F.lower("n_name")))


@query("SELECT c_nationkey AS k, CASE WHEN max(c_acctbal) > 9900 THEN 'high' ELSE 'any' END AS v FROM customer GROUP BY 1")
def maps_coalesced(spark: SparkSession, d: str) -> DataFrame:
    c = star(spark, d, "customer")
    high, some = (f.select(F.col("c_nationkey").alias("k"), F.lit(v).alias("v")).distinct() for f, v in ((c.filter("c_acctbal > 9900"), "high"), (c, "any")))
    return records.coalesced_maps([high, some], "k", "v")


@query("SELECT c_nationkey AS k, count(DISTINCT c_custkey) AS a, count(DISTINCT s_suppkey) AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1")
def maps_inner(spark: SparkSession, d: str) -> DataFrame:
    a = star(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("a"))
    b = star(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("b"))
    return records.inner_maps([a, b], "k")


@query("SELECT s_suppkey AS entry, 1 AS num, s_name AS title FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, unnest([1, 2]), s_name || unnest(['', ' (Inst.)']) FROM supplier WHERE s_suppkey % 2 = 1")
def singles_filled_in(spark: SparkSession, d: str) -> DataFrame:
    s = star(spark, d, "supplier").select(F.col("s_suppkey").alias("entry"), F.col("s_name").alias("title"))
    return pages.with_singles(s.filter("entry % 2 = 0").withColumn("num", F.lit(1)), s)
