"""Playlists as rows (name, pos, track_key): syncs and comparisons as plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tunelake.functions.scalar import glob_to_regex
from tunelake.sources.catalog import checkpointed


def sync_plan(items: DataFrame, expected: DataFrame, name: str = "name", key: str = "track_key") -> DataFrame:
    """(name, key, action): what to add to and remove from each list so that it holds the expected set."""
    a = items.select(name, key).distinct().withColumn("has", F.lit(True))
    b = expected.select(name, key).distinct().withColumn("wants", F.lit(True))
    both = a.join(b, [name, key], "full")
    return both.filter("has IS NULL OR wants IS NULL").select(name, key, F.when(F.col("has").isNull(), "add").otherwise("remove").alias("action"))


def first_mismatch(items: DataFrame, expected: DataFrame, name: str = "name", pos: str = "pos", key: str = "track_key") -> DataFrame:
    """(name, pos): the first place at which a list differs from the expected one, a missing item included."""
    a = items.select(name, pos, F.col(key).alias("a"))
    b = expected.select(name, pos, F.col(key).alias("b"))
    return a.join(b, [name, pos], "full").filter(~F.col("a").eqNullSafe(F.col("b"))).groupBy(name).agg(F.min(pos).alias(pos))


def ordered_plan(items: DataFrame, expected: DataFrame, name: str = "name", pos: str = "pos", key: str = "track_key") -> DataFrame:
    """(name, action, pos, key): items from the first mismatch on go, the expected ones from there are appended in order."""
    at = first_mismatch(items, expected, name, pos, key).withColumnRenamed(pos, "__at")
    drop = items.join(at, name).filter(F.col(pos) >= F.col("__at")).select(name, F.lit("remove").alias("action"), pos, key)
    add = expected.join(at, name).filter(F.col(pos) >= F.col("__at")).select(name, F.lit("append").alias("action"), pos, key)
    return drop.union(add)


def compare_loose(a: DataFrame, b: DataFrame, titles: list[str], key: str = "key") -> DataFrame:
    """Rows of a that b has neither by folded titles nor by key."""
    fold = lambda df, t: F.lower(F.regexp_replace(df[t], r"(?U)\s+", ""))
    left = a.join(b.select(*[fold(b, t).alias(f"__{t}") for t in titles]).distinct(), [fold(a, t) == F.col(f"__{t}") for t in titles], "left_anti")
    return left.join(b.select(F.col(key).alias("__key")).distinct(), left[key] == F.col("__key"), "left_anti")


def matching(items: DataFrame, pattern: str, most: int | None = None, name: str = "name") -> DataFrame:
    """(name, n): lists whose name fits a shell pattern, with at most so many items."""
    got = items.filter(F.col(name).rlike(glob_to_regex(pattern))).groupBy(name).agg(F.count("*").alias("n"))
    return got.filter(F.col("n") <= most) if most is not None else got


def info(items: DataFrame, tracks: DataFrame, name: str = "name", key: str = "track_key") -> DataFrame:
    """(name, n, n_missing, duration): items, those without a track, and the tracks' total duration."""
    t = tracks.select(F.col("key").alias("__key"), "duration")
    return items.join(t, items[key] == F.col("__key"), "left").groupBy(name).agg(F.count("*").alias("n"), F.count_if(F.col("__key").isNull()).alias("n_missing"), F.coalesce(F.sum("duration"), F.lit(0)).alias("duration"))


def restore(items: DataFrame, tracks: DataFrame, candidates: DataFrame, name: str = "name", key: str = "track_key", threshold: int = 90) -> DataFrame:
    """(name, pos, key, kept, replacement): an item whose track is gone gets the best-scored candidate, or none.

    candidates: (track_key, replacement, score, priority); the lowest priority wins, then the highest score.
    """
    here = tracks.select(F.col("key").alias("__key")).distinct()
    w = Window.partitionBy(key).orderBy("priority", F.desc("score"), "replacement")
    best = candidates.filter(F.col("score") >= threshold).withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(key, "replacement")
    out = items.join(here, items[key] == F.col("__key"), "left").join(best, key, "left")
    return out.select(name, "pos", key, F.col("__key").isNotNull().alias("kept"), F.when(F.col("__key").isNull(), F.col("replacement")).alias("replacement"))


def ratings_duplicates(tracks: DataFrame, artist: str = "grandparent_key", mood: str = "Duplicate Rating") -> DataFrame:
    """(user_rating, artist, title, n): rated tracks of the same artist and title, but those with the mood."""
    own = tracks.filter((F.col("user_rating") >= 1) & ~F.coalesce(F.array_contains("moods", mood), F.lit(False)))
    return own.groupBy("user_rating", artist, "title").agg(F.count("*").alias("n")).filter("n > 1")


def rating_plan(tracks: DataFrame, rating: int) -> DataFrame:
    """(key, old, new) for tracks with another rating."""
    if not 0 <= rating <= 10:
        raise ValueError("ratings are 0 to 10")
    return tracks.filter(~F.col("user_rating").eqNullSafe(F.lit(rating))).select("key", F.col("user_rating").alias("old"), F.lit(rating).alias("new"))


def rating_offset(tracks: DataFrame, low: int, high: int, offset: int) -> DataFrame:
    return tracks.filter(F.col("user_rating").between(low, high)).select("key", F.col("user_rating").alias("old"), (F.col("user_rating") + offset).alias("new"))


def create(tracks: DataFrame, name: str, order: list, key: str = "key") -> DataFrame:
    """(name, pos, track_key): a list of the tracks in order: sorted by ranges, then numbered by each range's own offset."""
    ranged = checkpointed(tracks.orderBy(*order, key).select(F.col(key).alias("track_key"), F.monotonically_increasing_id().alias("__m")))
    part, nth = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("__p")).agg(F.count("*").alias("n"))
    # one row for each range of the sort
    before = Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return ranged.join(F.broadcast(offsets), part == F.col("__p")).select(F.lit(name).alias("name"), (F.col("__before") + nth).alias("pos"), "track_key")


def rating_sync(files: DataFrame, tracks: DataFrame, to_files: bool, below: str | None = None, since=None, until=None) -> DataFrame:
    """(path, file_stars, rating, action): files and library rows whose ratings differ, joined by path.

    below: only paths with this beginning; since, until: only files modified in between (column modified).
    """
    if below:
        files = files.filter(F.col("path").startswith(below))
    for limit, test in ((since, lambda m: m >= F.lit(since)), (until, lambda m: m < F.lit(until))):
        files = files.filter(test(F.col("modified"))) if limit is not None else files
    both = files.select("path", "file_stars").join(tracks.select("path", "user_rating"), "path").filter(~F.col("file_stars").eqNullSafe(F.col("user_rating")))
    both = both.filter("user_rating >= 1") if to_files else both.filter("file_stars IS NOT NULL")
    return both.select("path", "file_stars", F.col("user_rating").alias("rating"), F.lit("write file" if to_files else "rate track").alias("action"))


def played_diff(mine: DataFrame, theirs: DataFrame, only_played: bool = False) -> DataFrame:
    """(file, played): names whose played state differs, with the state to take over."""
    both = mine.select("file", F.col("played").alias("mine")).join(theirs.select("file", F.col("played").alias("theirs")), "file").filter("mine <> theirs")
    return (both.filter("theirs") if only_played else both).select("file", F.col("theirs").alias("played"))


#: Rule-based lists: a name and the filters on the rated tracks that it holds.
RULES = {
    "unrated": {"user_rating__notset": True},
    "3 stars and up": {"user_rating__gte": 6},
    "4 stars and up": {"user_rating__gte": 8},
    "5 stars": {"user_rating": 10},
    "singles of the nineties": {"parent_year__gte": 1990, "parent_year__lt": 2000, "index": 1},
}


def apply_rules(tracks: DataFrame, rules: dict[str, dict] | None = None) -> DataFrame:
    """(name, key): the tracks of every rule's list, by one pass over the tracks."""
    from .predicates import predicate

    made = []
    for name, filters in (RULES if rules is None else rules).items():
        ok = F.lit(True)
        for k, q in filters.items():
            ok = ok & predicate(tracks, k, q)
        made.append(F.when(ok, F.lit(name)))
    return tracks.select("key", F.explode(F.array_compact(F.array(*made))).alias("name")).select("name", "key")


def duplicates_by_artist(duplicates: DataFrame, artist: str = "grandparent_key") -> DataFrame:
    """(artist, n, titles) of duplicate ratings, titles sorted."""
    return duplicates.groupBy(artist).agg(F.sum("n").alias("n"), F.sort_array(F.collect_set("title")).alias("titles"))


def blank_titles(tracks: DataFrame) -> DataFrame:
    """The albums that have a track with an empty title."""
    return tracks.filter(F.col("title") == "").select("parent_key").distinct()


def title_tree(tracks: DataFrame) -> DataFrame:
    """(grandparent_key, albums): an artist's albums, each with its sorted titles."""
    album = tracks.groupBy("grandparent_key", "parent_key").agg(F.sort_array(F.collect_set("title")).alias("titles"))
    return album.groupBy("grandparent_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("parent_key", "titles")))).alias("albums"))


def kinds(lists: DataFrame) -> DataFrame:
    """The lists with ``ordered``: neither smart nor synced from outside."""
    return lists.withColumn("ordered", ~F.col("smart") & ~F.col("externally_synced"))


#: Titles and genres that the unrated lists leave out; fixed values.
NOT_SONGS = r"(?:^|\()(?:intro|outro)(?:$|\s|:|\))|\(inst(?:\.?|rumental)|(?:japanese|jp|karaoke|mandarin|chinese) ver(?:\.|sion)|christmas|santa|remix|snow"
FESTIVE = "christmas|santa"


def star_rules(prefix: str, artists: str | None = None) -> dict[str, dict]:
    """The curated lists by stars: all tracks, each step of stars alone and from it on, and those of some artists."""
    rules: dict[str, dict] = {f"{prefix} ALL": {}, f"{prefix} 1 Star": {"user_rating": 2}, f"{prefix} 2 Stars": {"user_rating": 4}}
    for rating, text in ((6, "3"), (7, "3½"), (8, "4")):
        rules[f"{prefix} {text} Stars"] = {"user_rating": rating}
        rules[f"{prefix} {text}+ Stars"] = {"user_rating__gte": rating}
    rules[f"{prefix} 4~4½ Stars"] = {"user_rating__gte": 8, "user_rating__lte": 9}
    rules[f"{prefix} 4½ Stars"] = {"user_rating": 9}
    rules[f"{prefix} 5 Stars"] = {"user_rating__gte": 10}
    if artists:
        rules[f"{prefix} Artists 3+ Stars"] = {"user_rating__gte": 6, "grandparent_title__iregex": artists}
    return rules


def songs(tracks: DataFrame, genre: str, least: int = 60_000) -> DataFrame:
    """Unrated tracks of a genre that are songs: no interludes, instrumentals or festive ones, a minute long at least."""
    like = lambda c, pattern: F.coalesce(F.lower(F.col(c)).rlike(pattern), F.lit(False))
    of_genre = F.exists("genres", lambda g: F.lower(g).rlike(f"^(?:{genre})$")) & ~F.exists("genres", lambda g: F.lower(g).rlike("christmas"))
    keep = F.coalesce(F.col("user_rating"), F.lit(0)) == 0
    return tracks.filter(keep & F.coalesce(of_genre, F.lit(False)) & ~like("title", NOT_SONGS) & ~like("parent_title", FESTIVE) & (F.col("duration") >= least))


def songs_of_known_artists(tracks: DataFrame, genre: str, rating: int = 6) -> DataFrame:
    """As songs, of artists with a track that has the rating or more."""
    known = tracks.filter(F.col("user_rating") >= rating).select("grandparent_key").distinct()
    return songs(tracks, genre).join(known, "grandparent_key", "left_semi")


def compare_strict(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """Rows of a whose key b doesn't have."""
    return a.join(b.select(F.col(key).alias("__key")).distinct(), a[key] == F.col("__key"), "left_anti")


def content(tracks: DataFrame, what) -> DataFrame:
    """(track_key): the distinct tracks of a result set, a frame with a key, or filters."""
    from .predicates import where

    df = where(tracks, what) if isinstance(what, dict) else getattr(what, "df", what)
    return df.select(F.col("key").alias("track_key")).distinct()


def listed(lists: DataFrame, items: DataFrame, pattern: str = "*", ordered_only: bool = False, most: int | None = None) -> DataFrame:
    """(name, n): lists by a shell pattern, only those in an order of their own if asked, with at most so many items."""
    own = kinds(lists).filter(F.col("ordered") if ordered_only else F.lit(True)).select("name")
    return matching(items.join(own, "name", "left_semi"), pattern, most)


def details(lists: DataFrame, items: DataFrame, tracks: DataFrame) -> DataFrame:
    """info with the list's flags and times, and how many items each codec has."""
    t = tracks.select(F.col("key").alias("track_key"), "codec")
    codecs = items.join(t, "track_key").groupBy("name", "codec").agg(F.count("*").alias("n"))
    codecs = codecs.groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("codec", "n")))).alias("codecs"))
    return info(items, tracks).join(kinds(lists), "name").join(codecs, "name", "left")


def tunes_plan(library: DataFrame, files: DataFrame) -> DataFrame:
    """(path, old, new, action): ratings of another player's library (rating out of 100) to set from the files' stars out of 10."""
    both = library.select("path", F.col("rating").alias("old")).join(files.select("path", (F.col("stars") * 10).cast("int").alias("new")), "path")
    return both.filter("new IS NOT NULL AND NOT (old <=> new)").select("path", "old", "new", F.when(F.col("old").isNull(), "insert").otherwise("update").alias("action"))
