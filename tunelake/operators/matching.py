"""Matching files' albums with wiki entries: candidates by equi-joins, fuzzy tests on those only, filters that keep if any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tunelake.functions import fuzzy, names
from tunelake.functions.text import weighted_ratio_udf

from tunelake.sources.catalog import checkpointed

from .pages import keep_if_any

COMPATIBLE = (("EP", "Mini Album"), ("EP", "Single"))


def compatible(a: Column, b: Column) -> Column:
    """Equal types, or an EP with a mini album or a single."""
    out = a.eqNullSafe(b)
    for x, y in COMPATIBLE:
        out = out | F.coalesce((a == x) & (b == y) | (a == y) & (b == x), F.lit(False))
    return out


ALBUM = ("artist", "name", "type", "num", "repackage")


def _same(columns: tuple[str, ...], left: str = "", right: str = "e_") -> Column:
    """Equal in all columns, nulls too."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}{c}").eqNullSafe(F.col(f"{right}{c}"))
    return out


def _candidate_classes(files: DataFrame, entries: DataFrame, threshold: int) -> DataFrame:
    """(artist, ..., e_artist, ..., score, by): album_candidates between albums and entries that differ in what they go by."""
    own, e = files.select(*ALBUM).distinct(), entries.select(*[F.col(c).alias(f"e_{c}") for c in ALBUM]).distinct()
    both = F.col("artist") == F.col("e_artist")
    counted = own.join(e, both & (F.col("type") == F.col("e_type")) & (F.col("num") == F.col("e_num")))
    # of all pairs that score the threshold, none is lost
    near = fuzzy.candidates(own.select("artist", F.col("name").alias("left")), e.select(F.col("e_artist").alias("artist"), F.col("e_name").alias("right")), ("artist",), threshold).drop("score")
    near = own.join(near.withColumnRenamed("artist", "__artist"), (F.col("artist") == F.col("__artist")) & (F.col("name") == F.col("left"))).join(e, both & (F.col("right") == F.col("e_name")) & F.col("repackage").eqNullSafe(F.col("e_repackage")) & compatible(F.col("type"), F.col("e_type")))
    every = checkpointed(near.select(*counted.columns).unionByName(counted).distinct())
    scored = every.select(F.col("name").alias("__n"), F.col("e_name").alias("__e")).distinct().withColumn("score", weighted_ratio_udf("__n", "__e"))
    every = every.join(scored, F.col("name").eqNullSafe(F.col("__n")) & F.col("e_name").eqNullSafe(F.col("__e"))).drop("__n", "__e")
    named = (F.col("score") >= threshold) & F.col("repackage").eqNullSafe(F.col("e_repackage"))
    numbered = F.coalesce((F.col("type") == F.col("e_type")) & (F.col("num") == F.col("e_num")), F.lit(False))
    return every.filter(named | numbered).withColumn("by", F.when(named, "name").otherwise("number"))


def album_candidates(files: DataFrame, entries: DataFrame, threshold: int = 90) -> DataFrame:
    """(album, entry, score, by): entries of the same artist and a compatible type, by name or by type and number.

    Albums that agree in all of this are one class, entries too; classes are paired, and their pairs expanded last.

    files: album, artist, name, type, num, repackage; entries: entry, artist, name, type, num, repackage.
    """
    pairs = checkpointed(_candidate_classes(files, entries, threshold).toDF(*[f"c_{c}" for c in ALBUM], *[f"d_{c}" for c in ALBUM], "score", "by"))
    met = files.select("album", *ALBUM).distinct().join(pairs, _same(ALBUM, right="c_")).select("album", *[f"d_{c}" for c in ALBUM], "score", "by")
    return met.join(entries.select("entry", *ALBUM).distinct(), _same(ALBUM, right="d_")).select("album", "entry", "score", "by")


def track_overlap(candidates: DataFrame, files: DataFrame, tracks: DataFrame) -> DataFrame:
    """(album, entry, n_files, n_tracks, share): positions whose lower-case titles agree, over the album's files.

    files: album, num, title; tracks: entry, num, title.
    """
    f = files.groupBy("album").agg(F.count("*").alias("n_files"))
    t = tracks.groupBy("entry").agg(F.count("*").alias("n_tracks"))
    same = candidates.select("album", "entry").join(files.select("album", "num", F.lower("title").alias("a")), "album").join(tracks.select("entry", "num", F.lower("title").alias("b")), ["entry", "num"]).filter("a = b").groupBy("album", "entry").agg(F.count("*").alias("same"))
    out = candidates.select("album", "entry").join(f, "album").join(t, "entry", "left").join(same, ["album", "entry"], "left")
    return out.select("album", "entry", "n_files", F.coalesce("n_tracks", F.lit(0)).alias("n_tracks"), (F.coalesce("same", F.lit(0)) / F.col("n_files")).alias("share"))


def narrowed(overlap: DataFrame, share: float = 0.7) -> DataFrame:
    """(album, entry): candidates with as many tracks if there are any, then those that agree on most titles if any."""
    even = keep_if_any(overlap.withColumn("__even", F.col("n_files") == F.col("n_tracks")), "album", "__even").drop("__even")
    return keep_if_any(even.withColumn("__most", F.col("share") > share), "album", "__most").select("album", "entry")


def unresolved(wanted: DataFrame, found: DataFrame, key: str, other: Column) -> DataFrame:
    """Titles that no page was found for, with the spelling to try next (title case for upper-case ones)."""
    left = wanted.join(found.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")
    return left.select("*", F.when(F.col(key) == F.upper(key), F.initcap(F.lower(key))).otherwise(other).alias("retry"))


def pages_by_title(pages: DataFrame, title: str = "title", site: str = "site", page: str = "page_id") -> DataFrame:
    """(title, pages): each title's pages by site."""
    first = pages.groupBy(title, site).agg(F.min(page).alias("p"))
    return first.groupBy(title).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(site, "p")))).alias("pages"))


def members(edges: DataFrame, groups: DataFrame, people: DataFrame, threshold: int = 90) -> DataFrame:
    """(group, member): people linked to a group, found by name among its links.

    edges: group, name; groups: group; people: member, name.  All pairs of names that score the threshold are found.
    """
    e = edges.join(groups.select("group").distinct(), "group", "left_semi").select("group", F.col("name").alias("left"))
    p = people.select("member", F.col("name").alias("right"))
    near = fuzzy.candidates(e.select("left"), p.select("right"), threshold=threshold)
    return near.join(e, "left").join(p, "right").select("group", "member").distinct()


def top_per_group(rows: DataFrame, by: str, order: list, most: int) -> DataFrame:
    """At most so many rows of each group, in order: the limit is the report's own."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def artist_lookup(files: DataFrame, artists: DataFrame, threshold: int = 90) -> DataFrame:
    """(path, artist, by): by the url tag, else by the best name; what no artist fits stays without one; various artists are left out.

    files: path, url, name (struct); artists: artist, url, name (struct).
    """
    own = files.filter(~F.coalesce(F.lower("name.eng") == "various artists", F.lit(False)))
    direct = own.join(artists.select("url", "artist").dropna(), "url").groupBy("path").agg(F.min("artist").alias("artist"))
    rest = own.join(direct.select("path"), "path", "left_anti")
    spelled = rest.select("name").distinct().withColumn("__id", F.to_json("name"))
    best = names.best_match(spelled, artists, "__id", "artist", threshold=threshold)
    met = rest.select("path", F.to_json("name").alias("__id")).join(best.select("__id", F.col("artist_match").alias("artist")), "__id", "left")
    by_name = met.select("path", "artist", F.when(F.col("artist").isNotNull(), "name").otherwise("none").alias("by"))
    return direct.select("path", "artist", F.lit("url").alias("by")).unionByName(by_name)


def script_parts(c: Column) -> Column:
    """What a name in two scripts says in either, if it does in both; else nothing."""
    latin = F.trim(F.regexp_replace(F.regexp_replace(c, r"[\p{L}&&[^\p{IsLatin}]]+", " "), r"\s+", " "))
    other = F.trim(F.regexp_replace(F.regexp_replace(c, r"\p{IsLatin}+", " "), r"\s+", " "))
    return F.when(latin.rlike(r"\p{L}") & other.rlike(r"\p{L}"), F.array(latin, other)).otherwise(F.array().cast("array<string>"))


def album_lookup(files: DataFrame, entries: DataFrame, threshold: int = 90) -> DataFrame:
    """(album, entry, by): by the url tag, else the best of the candidates by name, else one of the artist's type and number; what
    still has none and a name in two scripts is tried again with what it says in either (``part``).

    files: album, url and what album_candidates takes; entries: entry, url and likewise.
    """
    direct = files.select("album", "url").join(entries.select("url", "entry").dropna(), "url").groupBy("album").agg(F.min("entry").alias("entry"))
    rest = files.join(direct.select("album"), "album", "left_anti").drop("url")

    def found(df: DataFrame) -> DataFrame:
        # of entries that agree in what they go by only the first can be chosen, and such albums choose the same
        e = entries.groupBy(*[F.col(c).alias(f"d_{c}") for c in ALBUM]).agg(F.min("entry").alias("entry"))
        order = F.struct(F.when(F.col("by") == "name", 0).otherwise(1).alias("o"), (-F.col("score")).alias("s"), "entry", "by")
        pairs = _candidate_classes(df, entries, threshold).join(e, _same(ALBUM, "e_", "d_"))
        best = pairs.groupBy(*[F.col(c).alias(f"c_{c}") for c in ALBUM]).agg(F.min(order).alias("b"))
        return df.join(best, _same(ALBUM, right="c_")).groupBy("album").agg(F.min("b").alias("b")).select("album", "b.entry", "b.by")

    first = checkpointed(found(rest))
    split = rest.join(first.select("album"), "album", "left_anti").withColumn("name", F.explode(script_parts(F.col("name"))))
    again = found(split).withColumn("by", F.lit("part"))
    return direct.select("album", "entry", F.lit("url").alias("by")).unionByName(first).unionByName(again)


def match_scores(wanted: DataFrame, targets: DataFrame, least: int = 90) -> DataFrame:
    """(id, kind, target, score): entries, editions and parts whose names score against the wanted ones, best first within a kind.

    wanted: id, name (struct); targets: kind, target, name (struct).
    """
    keyed = targets.withColumn("__t", F.struct("kind", "target"))
    return names.best_matches(wanted, keyed, "id", "__t", threshold=least).select("id", F.col("__t_match.kind").alias("kind"), F.col("__t_match.target").alias("target"), "score")


ITEM = ("artist_key", "album_key", "artist", "album", "title")


def _tiers(gone: DataFrame, tracks: DataFrame, threshold: int) -> DataFrame:
    """(gone, track, score, priority): replacement_tiers between items that differ, each named by all that it goes by."""

    def near(a: DataFrame, b: DataFrame, c: str) -> DataFrame:
        x, y = (df.select(F.col(c).alias("t")).dropna().distinct().select(F.col("t").alias(c), names.from_enclosed(F.col("t")).alias("name")) for df in (a, b))
        return names.best_matches(x, y, c, c, threshold=threshold)

    gone = gone.select(*ITEM).distinct().withColumn("gone", F.to_json(F.struct(*ITEM)))
    tracks = tracks.select(*ITEM).distinct()
    t = tracks.select(F.to_json(F.struct(*ITEM)).alias("track"), *[F.col(c).alias(f"{c}_match") for c in ITEM])
    keyed = gone.join(t, (F.col("artist_key") == F.col("artist_key_match")) & (F.col("album_key") == F.col("album_key_match"))).withColumn("priority", F.lit(1))
    named = gone.join(t, (F.col("artist") == F.col("artist_match")) & (F.col("album") == F.col("album_match"))).withColumn("priority", F.lit(2))
    alike = gone.join(near(gone, tracks, "artist").drop("score"), "artist").join(near(gone, tracks, "album").drop("score"), "album").join(t, ["artist_match", "album_match"]).withColumn("priority", F.lit(3))
    titles = checkpointed(near(gone, tracks, "title"))
    cells = [df.select("gone", "title", "track", "title_match", "priority").join(titles, ["title", "title_match"]) for df in (keyed, named, alike)]
    return cells[0].union(cells[1]).union(cells[2]).groupBy("gone", "track").agg(F.min("priority").alias("priority"), F.max("score").alias("score"))


def replacement_tiers(gone: DataFrame, tracks: DataFrame, threshold: int = 90) -> DataFrame:
    """(track_key, replacement, score, priority): tracks whose title scores against that of an item that is gone.

    Priorities: 1 the same artist and album by id, 2 by title, 3 an artist and album whose names score the threshold.
    gone: track_key, artist_key, album_key, artist, album, title; tracks: key and likewise.
    Albums are paired first, by their keys or names, so that tracks meet within albums only; of titles and names each pair is scored
    once, and items that agree in all of this are paired once.
    """
    pairs = _tiers(gone, tracks, threshold)
    own, t = gone.select("track_key", F.to_json(F.struct(*ITEM)).alias("gone")).distinct(), tracks.select(F.col("key").alias("replacement"), F.to_json(F.struct(*ITEM)).alias("track")).distinct()
    return pairs.join(own, "gone").join(t, "track").select("track_key", "replacement", "score", "priority")


def best_replacements(gone: DataFrame, tracks: DataFrame, threshold: int = 90) -> DataFrame:
    """The best row of replacement_tiers for each item: the lowest priority, then the highest score, then the first key.

    Of tracks that agree only the first can be chosen, and items that agree choose the same, so no copies are paired.
    """
    t = tracks.groupBy(F.to_json(F.struct(*ITEM)).alias("track")).agg(F.min("key").alias("replacement"))
    order = F.struct("priority", (-F.col("score")).alias("s"), "replacement")
    best = _tiers(gone, tracks, threshold).join(t, "track").groupBy("gone").agg(F.min(order).alias("b"))
    own = gone.select("track_key", F.to_json(F.struct(*ITEM)).alias("gone")).join(best, "gone").groupBy("track_key").agg(F.min("b").alias("b"))
    return own.select("track_key", "b.replacement", (-F.col("b.s")).alias("score"), "b.priority")
