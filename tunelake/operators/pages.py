"""Semi-structured pages to rows: classification by category, discographies across sites, editions, track lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# A class, the class it is a kind of, category parts that speak for it, and parts that speak against it.
CLASSES = (
    ("WikiEntity", None, (), ()),
    ("PersonOrGroup", "WikiEntity", (), ()),
    ("Artist", "PersonOrGroup", (), ()),
    ("Singer", "Artist", ("singer", "actor", "actress", "member", "rapper", "lyricist", "pianist", "songwriter", "births", "male", "kcomposer"), ("groups", "record labels")),
    ("Group", "Artist", ("group", "subunits", "duos"), ("group processes", "belief", "single")),
    ("Agency", "PersonOrGroup", ("agency", "agencies", "record label"), ()),
    ("SpecialEvent", "WikiEntity", ("competition",), ()),
    ("TVSeries", "WikiEntity", ("television program", "television series", "drama", "survival show", "music shows"), ()),
    ("Discography", "WikiEntity", ("discography", "discographies"), ()),
    ("DiscographyEntry", "WikiEntity", (), ()),
    ("Album", "DiscographyEntry", ("album", "extended play", " eps", "-language eps", "mixtape"), ()),
    ("Single", "DiscographyEntry", ("single", "song", "collaboration", "feature"), ("songwriter",)),
    ("Soundtrack", "DiscographyEntry", ("ost", "soundtrack"), ()),
)
# Album types in their order, category parts that name them, folder, whether they are numbered.
ALBUM_TYPES = (
    ("Mini Album", ("mini album",), "Mini Albums", True),
    ("EP", ("extended play", "digital eps"), "EPs", False),
    ("Single Album", ("single album",), "Single Albums", True),
    ("Special Album", ("special album",), "Special Albums", True),
    ("Compilation", ("compilation", "best album"), "Compilations", False),
    ("Feature", ("feature",), "Collaborations", False),
    ("Live Album", ("live album",), "Live", False),
    ("Competition", ("participation release",), "Other", False),
    ("MixTape", ("mixtape",), "Other", False),
    ("Cover Album", ("cover album", "remake album"), "Other", False),
    ("Soundtrack", ("soundtrack", "ost"), "Soundtracks", False),
    ("Single", ("single", "song", "digital single", "promotional single", "special single", "other release", "digital download"), "Singles", False),
    ("Album", ("studio album", "repackage album", "full-length album", "album"), "Albums", True),
    ("Collaboration", ("collaboration",), "Collaborations", False),
    ("Christmas", ("christmas",), "Christmas", False),
    ("Holiday", ("holiday",), "Holiday", False),
    ("UNKNOWN", ("others",), "Other", False),
)


def kinds_of(name: str) -> set[str]:
    """A class and the classes it is a kind of."""
    above = {c: up for c, up, _, _ in CLASSES}
    out = set()
    while name:
        out.add(name)
        name = above[name]
    return out


def class_scores(pages: DataFrame, key: str = "url", categories: str = "categories") -> DataFrame:
    """(key, class, score): a point for each category and part of the class in it; a category with a part against the
    class costs a point for each of the class's parts."""
    one = lambda c, parts: sum((F.when(c.contains(p), 1).otherwise(0) for p in parts), F.lit(0))

    def of_category(c: Column) -> Column:
        """What a category gives each class that it touches."""
        rules = [(name, one(c, good), one(c, bad), len(good)) for name, _, good, bad in CLASSES if good or bad]
        return F.filter(F.array(*[F.when((plus > 0) | (minus > 0), F.struct(F.lit(name).alias("class"), (plus - F.when(minus > 0, size).otherwise(0)).alias("w"))) for name, plus, minus, size in rules]), lambda x: x.isNotNull())

    rows = pages.select(key, F.explode(categories).alias("__c")).select(key, F.explode(of_category(F.lower("__c"))).alias("__s"))
    return rows.groupBy(key, F.col("__s.class").alias("class")).agg(F.sum("__s.w").alias("score"))


def classify(pages: DataFrame, requested: str = "WikiEntity", key: str = "url", categories: str = "categories") -> DataFrame:
    """(key, class, score, error): the best class with a positive score that is a kind of the requested one, the last name
    of equal scores.  A page of no class is a plain WikiEntity, and an error if another class was requested."""
    fits = [c for c, *_ in CLASSES if requested in kinds_of(c)]
    fit = (F.col("score") > 0) & F.col("class").isin(*fits)
    best = class_scores(pages, key, categories).groupBy(key).agg(F.max(F.when(fit, F.struct("score", "class"))).alias("b")).select(F.col(key).alias("__k"), "b.class", "b.score")
    out = pages.select(key).join(best, F.col(key) == F.col("__k"), "left")
    plain = F.lit(requested == "WikiEntity") & F.col("__k").isNull()
    name = F.coalesce("class", F.when(plain, "WikiEntity"))
    return out.select(key, name.alias("class"), "score", name.isNull().alias("error"))


def album_type(categories: Column) -> Column:
    """The first type in order that any category names, UNKNOWN without one; ``ep`` alone is an EP."""
    # a category counts for its own first type only; of all categories' types the first in order wins.  Each category is folded
    # once and the rank used once: expressions over arrays are not shared, so each further use would count it again
    folded = F.transform(categories, lambda c: F.translate(F.lower(F.trim(c)), "-_", "  "))
    rank = F.array_min(F.transform(folded, _rank))
    return F.coalesce(F.get(F.array(*[F.lit(name) for name, *_ in ALBUM_TYPES]), rank), F.lit("UNKNOWN"))


def _rank(c: Column) -> Column:
    """The place of the first type that a folded category names."""
    out = F.when(c.isin("ep", "eps"), 1)
    for i, (_, parts, *_) in reversed(list(enumerate(ALBUM_TYPES))):
        hit = F.lit(False)
        for p in parts:
            hit = hit | c.contains(p)
        out = F.when(hit, i).otherwise(out)
    return out


def type_from_folder(path: Column) -> Column:
    """struct(type, num) of an album folder ``.../Mini Albums/[date] title [2nd Mini Album]``; null for unknown folders.

    A type that isn't numbered is the first of its kind; of types with the same folder the first counts.
    """
    folder, kind = F.regexp_extract(path, r"([^/]+)/[^/]+/?$", 1), F.regexp_extract(path, r"\[[0-9]+(?:st|nd|rd|th) ([^\]]+)\]/?$", 1)
    num = F.regexp_extract(path, r"\[([0-9]+)(?:st|nd|rd|th) [^\]]+\]/?$", 1).try_cast("int")
    out, seen = F.lit(None).cast("struct<type:string,num:int>"), set()
    for name, _, place, numbered in ALBUM_TYPES:
        if place in seen:
            continue
        seen.add(place)
        found = F.when(kind == name, F.struct(F.lit(name).alias("type"), num.alias("num")))
        out = F.when(folder == place, found if numbered else found.otherwise(F.struct(F.lit(name).alias("type"), F.lit(1).alias("num")))).otherwise(out)
    return out


def merge_discographies(entries: DataFrame) -> DataFrame:
    """(artist, year, name, type, sites, links): entries of the same year, upper-case name without its part, and type."""
    name = F.trim(F.regexp_replace(F.upper("title"), r"\s+OST(\s+PART.*)?$", " OST"))
    return entries.groupBy("artist", "year", name.alias("name"), "type").agg(F.sort_array(F.collect_set("site")).alias("sites"), F.sort_array(F.collect_set("link")).alias("links"))


def edition_date(dates: Column, edition: Column) -> Column:
    """An edition's date from a map: its own, the default's, the earliest."""
    return F.coalesce(F.try_element_at(dates, F.lower(edition)), F.try_element_at(dates, F.lit("")), F.array_min(F.map_values(dates)))


def numbered_type(number: Column, language: Column, kind: Column, repackage: Column) -> Column:
    from tunelake.functions.scalar import ordinal

    return F.concat_ws(" ", ordinal(number), language, kind, F.when(repackage, "Repackage"))


def fill_titles(tracks: DataFrame, by: list[str], order: str = "num") -> DataFrame:
    """A track without a native title takes that of the last earlier one with the same English title."""
    w = Window.partitionBy(*by, "eng").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return tracks.withColumn("non_eng", F.last("non_eng", ignorenulls=True).over(w))


def soundtrack_split(parts: DataFrame, by: str) -> DataFrame:
    """For each soundtrack: full editions, numbered parts, extras."""
    full, part = F.col("part").isNull() & ~F.col("extra"), F.col("part").isNotNull()
    return parts.groupBy(by).agg(F.count_if(full).alias("n_full"), F.count_if(part).alias("n_parts"), F.count_if(F.col("extra") & ~part).alias("n_extras"))


def keep_if_any(rows: DataFrame, by: str, flag: str) -> DataFrame:
    """A group's flagged rows if it has any, else all of them."""
    w = Window.partitionBy(by)
    return rows.withColumn("__any", F.max(F.col(flag).cast("int")).over(w)).filter(F.col(flag) | (F.col("__any") == 0)).drop("__any")


def site(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1))


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, link, text) of a page's anchors; the text without markup."""
    anchor = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(anchor), F.lit(1)).alias("link"), F.regexp_extract_all(html, F.lit(anchor), F.lit(2)).alias("text"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("a.text", r"<[^>]*>", ""), r"\s+", " "))
    return pages.select(key, F.explode(pairs).alias("a")).select(key, F.col("a.link").alias("link"), plain.alias("text"))


def list_tracks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, num, title, length): the items of a page's lists, ``"Title" - 3:18`` taken apart."""
    items = F.regexp_extract_all(html, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))
    rows = pages.select(key, F.posexplode(items).alias("i", "item"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("item", r"<[^>]*>", " "), r"\s+", " "))
    mark = r'^"?(.*?)"?\s*(?:[-–]\s*([0-9]+:[0-9]{2}))?$'
    return rows.select(key, (F.col("i") + 1).alias("num"), F.regexp_extract(plain, mark, 1).alias("title"), F.nullif(F.regexp_extract(plain, mark, 2), F.lit("")).alias("length"))


def zip_positional(a: DataFrame, b: DataFrame, by: str, order_a: list[str], order_b: list[str], left: str, right: str) -> DataFrame:
    """(by, n, left, right): rows of equal rank within a group."""
    x = a.select(by, F.row_number().over(Window.partitionBy(by).orderBy(*order_a)).alias("n"), left)
    y = b.select(by, F.row_number().over(Window.partitionBy(by).orderBy(*order_b)).alias("n"), right)
    return x.join(y, [by, "n"]).select(by, "n", left, right)


def disambiguate(links: DataFrame, known: DataFrame, by: str = "query") -> DataFrame:
    """(by, link, ambiguous): candidates but disambiguation pages; those of known entities go first; more than one is ambiguous."""
    own = links.filter(~F.lower("link").contains("disambiguation")).join(known.select(F.col("link").alias("__l")).distinct(), F.col("link") == F.col("__l"), "left")
    some = keep_if_any(own.withColumn("__known", F.col("__l").isNotNull()), by, "__known")
    return some.select(by, "link", (F.count("*").over(Window.partitionBy(by)) > 1).alias("ambiguous"))


def languages(categories: Column) -> Column:
    """The languages that categories name, sorted."""
    words = F.flatten(F.transform(categories, lambda c: F.split(F.lower(c), r"[^a-z]+")))
    names = {"korean": "Korean", "k": "Korean", "japanese": "Japanese", "j": "Japanese", "chinese": "Chinese", "mandarin": "Chinese", "english": "English"}
    table = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return F.sort_array(F.array_distinct(F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda x: x.isNotNull())))


def page_language(categories: Column, text: Column) -> Column:
    """The categories' language if there is one, else that of the text's script."""
    from tunelake.functions.scalar import script

    found = languages(categories)
    of_script = F.when(script(text) == "hangul", "Korean").when(script(text) == "japanese", "Japanese").when(script(text) == "chinese", "Chinese").when(script(text) == "latin", "English")
    return F.when(F.size(found) == 1, found[0]).otherwise(of_script)


def with_singles(tracks: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry, num, title): the track lists; an entry without one is a single: its title and the instrumental."""
    bare = entries.join(tracks.select(F.col("entry").alias("__e")).distinct(), F.col("entry") == F.col("__e"), "left_anti")
    made = bare.select("entry", F.posexplode(F.array(F.col("title"), F.concat("title", F.lit(" (Inst.)")))).alias("i", "title"))
    return tracks.select("entry", "num", "title").unionByName(made.select("entry", (F.col("i") + 1).alias("num"), "title"))


def lookup(wanted: DataFrame, pages: DataFrame, by: str) -> DataFrame:
    """(wanted columns, page_id): pages by ``url``, ``title`` (any case, blanks for underscores) or ``link`` (the url's last part)."""
    fold = lambda c: F.lower(F.trim(F.translate(c, "_", " ")))
    ends = lambda c: fold(F.url_decode(F.regexp_extract(c, "([^/?#]+)/?(?:[?#].*)?$", 1)))
    here, there = {"url": (F.col(by), F.col("url")), "title": (fold(F.col(by)), fold(F.col("title"))), "link": (ends(F.col(by)), ends(F.col("url")))}[by]
    first = pages.select(there.alias("__k"), "page_id").groupBy("__k").agg(F.min("page_id").alias("page_id"))
    return wanted.withColumn("__w", here).join(first, F.col("__w") == F.col("__k"), "left").drop("__w", "__k")


def entry_pages(entries: DataFrame, links: DataFrame, pages: DataFrame) -> DataFrame:
    """(entry, page_id): for each entry the page of its first link that has one; entries without a page have none.

    entries: entry; links: entry, pos, url; pages: page_id, url.
    """
    met = links.join(pages.select("url", "page_id"), "url").groupBy("entry").agg(F.min(F.struct("pos", "page_id")).alias("b"))
    return entries.select("entry").join(met.select("entry", "b.page_id"), "entry", "left")


def entry_type(kind: Column, title: Column, source: Column) -> Column:
    """The entry's type; a soundtrack if its title or the album that it is from says so."""
    ost = lambda c: F.coalesce(F.concat(F.lit(" "), F.upper(c), F.lit(" ")).contains(" OST "), F.lit(False))
    return F.when(ost(title) | ost(source), "Soundtrack").otherwise(kind)


def edition_language(*languages: Column) -> Column:
    """The first that is known: the edition's own, the template's, the artist's, the site's default."""
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in languages])


def full_name(base: Column, edition: Column, part: Column) -> Column:
    """``base (edition) (part)``, of what there is; an edition that repeats the base is left out."""
    own = F.when(F.lower(F.trim(edition)) != F.lower(F.trim(base)), F.nullif(F.trim(edition), F.lit("")))
    wrap = lambda c: F.concat(F.lit("("), c, F.lit(")"))
    return F.concat_ws(" ", F.trim(base), wrap(own), wrap(F.nullif(F.trim(part), F.lit(""))))


def artist_name(artist: Column, collaborators: Column) -> Column:
    """``artist (with a, b and c)``."""
    n, others = F.size(collaborators), F.array_join(F.slice(collaborators, F.lit(1), F.greatest(F.size(collaborators) - 1, F.lit(0))), ", ")
    listed = F.when(n == 1, collaborators[0]).otherwise(F.concat(others, F.lit(" and "), F.element_at(collaborators, -1)))
    return F.when(F.coalesce(n, F.lit(0)) > 0, F.concat(artist, F.lit(" (with "), listed, F.lit(")"))).otherwise(artist)


def merged_names(rows: DataFrame, by: str = "artist", name: str = "name", order: str = "page_id") -> DataFrame:
    """(artist, names): each artist's names from all pages; names of one English spelling, or of one in another script, are one.

    Each missing field is filled from the first page that has it.
    """
    rows = rows.select(by, order, *[F.col(f"{name}.{f}").alias(f) for f in ("eng", "non_eng", "romanized", "lit")])
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    # names that have only one of the two scripts take the other from those of the same spelling
    both = rows.filter("eng IS NOT NULL AND non_eng IS NOT NULL")
    pair = both.groupBy(by, F.lower("eng").alias("__e")).agg(F.min("non_eng").alias("__n"))
    back = both.groupBy(by, F.col("non_eng").alias("__o")).agg(F.min("eng").alias("__g"))
    filled = rows.join(pair.withColumnRenamed(by, "__b"), (F.col(by) == F.col("__b")) & (F.lower("eng") == F.col("__e")), "left").drop("__b")
    filled = filled.join(back.withColumnRenamed(by, "__b"), (F.col(by) == F.col("__b")) & (F.col("non_eng") == F.col("__o")), "left")
    filled = filled.select(by, order, F.coalesce("eng", "__g").alias("eng"), F.coalesce("non_eng", "__n").alias("non_eng"), "romanized", "lit")
    one = filled.groupBy(by, F.lower("eng").alias("__e"), F.col("non_eng").alias("__n")).agg(first("eng"), first("non_eng"), first("romanized"), first("lit"))
    return one.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("eng", "non_eng", "romanized", "lit"))).alias("names"))


def group_edges(people: DataFrame) -> DataFrame:
    """(group, member, sub_unit): edges of persons to their groups, from rows member, groups (array), units (array of group/unit)."""
    own = people.select("member", F.explode("groups").alias("group"), F.lit(None).cast("string").alias("sub_unit"))
    unit = people.select("member", F.explode("units").alias("u")).select("member", F.substring_index("u", "/", 1).alias("group"), F.substring_index("u", "/", -1).alias("sub_unit"))
    return own.unionByName(unit).select("group", "member", "sub_unit").distinct()


def soloist(name: Column, group: Column, override: Column | None = None) -> Column:
    """A member's name as an album artist: an override, else ``name (group)``."""
    plain = F.when(group.isNotNull(), F.concat(name, F.lit(" ("), group, F.lit(")"))).otherwise(name)
    return plain if override is None else F.coalesce(override, plain)


def entity_report(entries: DataFrame, editions: DataFrame, tracks: DataFrame, types: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(artist, entry, type, n_editions, n_tracks), of some types, at most so many entries of an artist by year if asked."""
    own = entries if types is None else entries.filter(F.col("type").isin(types))
    if most is not None:
        own = own.withColumn("__n", F.row_number().over(Window.partitionBy("artist").orderBy("year", "entry"))).filter(F.col("__n") <= most).drop("__n")
    e = editions.groupBy("entry").agg(F.count("*").alias("n_editions"))
    t = tracks.groupBy("entry").agg(F.count("*").alias("n_tracks"))
    return own.select("artist", "entry", "type").join(e, "entry", "left").join(t, "entry", "left").select("artist", "entry", "type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_editions", "n_tracks")])
