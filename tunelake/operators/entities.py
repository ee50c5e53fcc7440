"""Entities behind page titles: staged disambiguation, names folded in order, repeated searches, members of groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tunelake.functions import names
from tunelake.sources.catalog import checkpointed

NAME = f"struct<eng:string,non_eng:string,romanized:string,lit:string,versions:{names.VERSIONS}>"


def matches(a: Column, b: Column, threshold: int = 90) -> Column:
    """Whether two names score the threshold."""
    some = lambda x: F.when(x.isNull(), F.lit(None).cast(NAME)).otherwise(x)
    return names.reaches(some(a), some(b), threshold)


def native(name: Column) -> Column:
    """The name's spelling in its other script alone."""
    return F.struct(*[(name[f] if f == "non_eng" else F.lit(None).cast("string")).alias(f) for f in names.FIELDS], F.array().cast(names.VERSIONS).alias("versions"))


def groups_match(a: Column, b: Column, threshold: int = 90) -> Column:
    """Whether a group of one list has a name that scores the threshold with one of the other; each goes by its spellings."""
    own = lambda g: F.transform(g, names.from_enclosed)
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False)) | names.any_reaches(own(a), own(b), threshold)


def disambiguation(queries: DataFrame, candidates: DataFrame, same: Callable[[Column, Column], Column] = matches, same_groups: Callable[[Column, Column], Column] = groups_match) -> DataFrame:
    """(query, link, stage, ambiguous): what each query's candidates narrow down to, and the stage that decided.

    One candidate is taken as it is (``only``).  If the entity is known elsewhere, those stay whose name matches it and which, where
    both have groups, have one whose name matches (``entity``); a category page's groups don't count.  Then those stay that match the
    name searched for (``name``).  Where that has two scripts and more than one is left, those stay of all that the entity left that
    match its other script alone (``native``), be their English names others.
    The first stage that leaves one decides; a stage that leaves none, or the last if it leaves more, makes the query ambiguous:
    then what was left before or after it is listed, and a query without candidates gets a row without a link.

    Each candidate is tested once against everything and the stages are read off each query's counts.

    queries: query, name, entity (both names or null), groups (array or null); candidates: query, link, name, groups.
    """
    c = F.col
    fold = lambda a: F.transform(a, lambda g: F.lower(F.trim(g)))
    q = queries.select("query", "name", "entity", fold(c("groups")).alias("groups"))
    own = candidates.select("query", "link", c("name").alias("c_name"), fold(c("groups")).alias("c_groups")).join(q, "query")
    apart = (F.size("groups") > 0) & (F.size("c_groups") > 0) & ~same_groups(c("groups"), c("c_groups")) & ~F.lower("link").startswith("category:")
    fits = c("entity").isNull() | same(c("entity"), c("c_name")) & ~F.coalesce(apart, F.lit(False))
    two = F.coalesce("name.eng", "name.lit").isNotNull() & c("name.non_eng").isNotNull()
    tested = own.select("query", "link", c("entity").isNotNull().alias("known"), c("name").isNotNull().alias("named"), F.coalesce(two, F.lit(False)).alias("two"), fits.alias("fits"), same(c("name"), c("c_name")).alias("by_name"), same(native(c("name")), c("c_name")).alias("by_native"))
    tested = checkpointed(tested)
    level = lambda *flags: F.array(F.lit(True), *flags)  # noqa: E731  what a candidate passes, stage by stage
    passed = tested.select("query", "link", "known", "named", "two", level(c("fits"), c("fits") & c("by_name"), c("fits") & c("by_native")).alias("passed"))
    count = lambda k: F.count_if(c("passed")[k])
    n = passed.groupBy("query").agg(F.first("known").alias("known"), F.first("named").alias("named"), F.first("two").alias("two"), *[count(k).alias(f"n{k}") for k in range(4)])
    #: where the cascade stops: the stage, how far a listed candidate must have passed, and whether that decides
    stop = lambda stage, k, decided: F.struct(F.lit(stage).alias("stage"), F.lit(k).alias("k"), F.lit(decided).alias("decided"))
    after = F.when(~c("named"), F.when(c("known"), stop("entity", 1, False)).otherwise(stop("only", 0, False)))
    after = after.when(c("n2") == 1, stop("name", 2, True)).when(c("n2") == 0, stop("name", 1, False)).when(~c("two"), stop("name", 2, False))
    after = after.when(c("n3") == 1, stop("native", 3, True)).when(c("n3") == 0, stop("native", 2, False)).otherwise(stop("native", 3, False))
    end = F.when(c("n0") == 1, stop("only", 0, True)).when(c("known") & (c("n1") == 1), stop("entity", 1, True)).when(c("known") & (c("n1") == 0), stop("entity", 0, False)).otherwise(after)
    ends = n.select("query", end.alias("end"))
    kept = passed.join(ends, "query").filter(c("passed")[c("end.k")]).select("query", "link", c("end.stage").alias("stage"), (~c("end.decided")).alias("ambiguous"))
    none = queries.select("query").join(ends, "query", "left_anti").select("query", F.lit(None).cast("string").alias("link"), F.lit("none").alias("stage"), F.lit(True).alias("ambiguous"))
    return kept.unionByName(none)


def folded_names(rows: DataFrame, by: str, name: str = "name", order: tuple[str, ...] = ("page_id",), versions: bool = False) -> DataFrame:
    """(by, names): each artist's names, in order, each merged into the first of those before it that it completes.

    A name completes one that it shares a field with and contradicts in none; missing fields are filled in, and later names are
    held against the filled name, so the order decides.  versions: a name that shares a field but contradicts another becomes a
    version of the first such name instead of a name of its own.  Equal names count once, at their first place.
    """
    c = F.col
    wide = F.struct(*[c(f"{name}.{f}").alias(f) for f in names.FIELDS], F.coalesce(c(f"{name}.versions"), F.array().cast(names.VERSIONS)).alias("versions"))
    own = rows.select(by, F.struct(*order).alias("__o"), wide.cast(NAME).alias("__n")).groupBy(by, "__n").agg(F.min("__o").alias("__o"))
    listed = own.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("__o", "__n"))).alias("__l"))
    test = (lambda a, b: names.is_version_of(a, b, partial=True)) if versions else names.is_version_of

    def step(done: Column, x: Column) -> Column:
        at = F.array_position(F.transform(done, lambda e: test(e, x["__n"])), F.lit(True))
        put = F.transform(done, lambda e, i: F.when(i + 1 == at, names.merge(e, x["__n"]).cast(NAME)).otherwise(e))
        return F.when(at > 0, put).otherwise(F.concat(done, F.array(x["__n"])))

    return listed.select(by, F.aggregate("__l", F.array().cast(f"array<{NAME}>"), step).alias("names"))


def chosen_name(own: Column, title: Column) -> Column:
    """Of an artist's names the one that goes by the title, in two scripts if there is one; else the first."""
    fits = F.filter(own, lambda n: F.coalesce(F.lower(n["eng"]) == F.lower(title), F.lit(False)) | F.coalesce(n["non_eng"] == F.lower(title), F.lit(False)))
    full = F.filter(fits, lambda n: n["eng"].isNotNull() & n["non_eng"].isNotNull())
    return F.coalesce(F.get(full, F.lit(0)), F.get(fits, F.size(fits) - 1), F.get(own, F.lit(0)))


def searched(wanted: DataFrame, pages: DataFrame, strict: int = 1) -> DataFrame:
    """(title, site, page_id, tried, round): the pages of each title, searched again until nothing new turns up.

    A title is looked up on every site.  Where it was found on some sites only, its English title there is tried on the others; a
    title in capitals that was found nowhere is tried in title case.  What is found leads on in the same way, so only what the
    last round brought is joined again, until a round brings nothing.  A site's first page of the first title that it has counts.
    Pages of another type than asked for don't; with strict 2 titles that met such a page are left out altogether.

    wanted: title, type; pages: site, title, page_id, english, type.
    """
    p = pages.select(F.col("site"), F.col("title").alias("tried"), "page_id", "english", F.col("type").alias("p_type"))
    tries = wanted.select("title", "type", F.col("title").alias("tried")).distinct()
    found, seen, clashes, n = None, tries.select("title", "tried"), None, 0
    while True:
        hits = tries.join(p, "tried")
        wrong = hits.filter("NOT (type <=> p_type)").select("title").distinct()
        clashes = wrong if clashes is None else clashes.union(wrong)
        new = hits.filter("type <=> p_type")
        if found is not None:
            new = new.join(found.select("title", "site"), ["title", "site"], "left_anti")
        new = new.groupBy("title", "type", "site").agg(F.min(F.struct("page_id", "tried", "english")).alias("b")).select("title", "type", "site", "b.page_id", "b.tried", "b.english")
        new = checkpointed(new.withColumn("round", F.lit(n)))
        again = new.select("title", "type", F.col("english").alias("tried")).dropna(subset=["tried"])
        if not n:
            loud = tries.join(new.select("title"), "title", "left_anti").filter((F.upper("title") == F.col("title")) & (F.lower("title") != F.col("title")))
            again = again.unionByName(loud.select("title", "type", F.initcap(F.lower("title")).alias("tried")))
        found = new if found is None else found.unionByName(new)
        tries = checkpointed(again.distinct().join(seen, ["title", "tried"], "left_anti"))
        if tries.isEmpty():
            break
        seen, n = seen.union(tries.select("title", "tried")), n + 1
    out = found.select("title", "site", "page_id", "tried", "round")
    return out.join(clashes.distinct(), "title", "left_anti") if strict > 1 else out


def closure(edges: DataFrame) -> DataFrame:
    """(group, member, depth): who belongs to a group, in it or in any unit below it, at the least depth.

    edges: group, member (which may be a group).  Only what the last round reached is followed; rings end, as a pair counts once.
    """
    e = checkpointed(edges.select("group", "member").dropna().distinct())
    step = e.select(F.col("group").alias("member"), F.col("member").alias("__next"))
    reached, new, depth = e.withColumn("depth", F.lit(1)), e, 1
    while True:
        depth += 1
        further = new.join(step, "member").select("group", F.col("__next").alias("member")).distinct()
        new = checkpointed(further.join(reached.select("group", "member"), ["group", "member"], "left_anti"))
        if new.isEmpty():
            return reached
        reached = reached.unionByName(new.withColumn("depth", F.lit(depth)))


def member_lookup(wanted: DataFrame, edges: DataFrame, artists: DataFrame, threshold: int = 90) -> DataFrame:
    """(id, artist, by): the artist of each name, among the members of the group that it comes with first (``member``), the nearest
    and best; else the best of all (``name``), else none.

    wanted: id, name, group (or null); edges: group, member; artists: artist, name.
    """
    c, far = F.col, 1 << 30
    spelled = lambda df, key: df.filter("name IS NOT NULL").groupBy(F.to_json("name").alias(key)).agg(F.first("name").alias("name"))
    pairs = names.best_matches(spelled(wanted, "own"), spelled(artists, "other"), "own", "other", threshold=threshold).withColumnRenamed("other_match", "other")
    # of all artists of one name only the first can be chosen, and of those within a group the nearest
    called = artists.select("artist", F.to_json("name").alias("other"))
    inside = closure(edges).select("group", c("member").alias("artist"), "depth").join(called, "artist").groupBy(c("group").alias("__g"), "other").agg(F.min(F.struct("depth", "artist")).alias("m"))
    first = called.groupBy("other").agg(F.min("artist").alias("artist"))
    asked = wanted.select("group", F.to_json("name").alias("own"))
    met = asked.distinct().join(pairs, "own").join(first, "other").join(inside.withColumnRenamed("other", "__o"), (c("group") == c("__g")) & (c("other") == c("__o")), "left")
    order = F.struct(F.coalesce("m.depth", F.lit(far)).alias("d"), (-c("score")).alias("s"), F.coalesce("m.artist", "artist").alias("artist"))
    best = met.groupBy(c("group").alias("__g"), c("own").alias("__n")).agg(F.min(order).alias("b"))
    each = wanted.select("id", "group", F.to_json("name").alias("own")).join(best, c("group").eqNullSafe(c("__g")) & (c("own") == c("__n")), "left").groupBy("id").agg(F.min("b").alias("b"))
    by = F.when(c("b").isNull(), "none").when(c("b.d") < far, "member").otherwise("name")
    return wanted.select("id").join(each, "id", "left").select("id", "b.artist", by.alias("by"))
