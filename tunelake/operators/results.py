"""Result sets: a lazy frame with an object type, chainable filters, navigation, set operations and dedup."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tunelake.plans.text_query import parse, resolve
from tunelake.sources.catalog import Catalog, checkpointed, type_name

from . import predicates

#: How a type's rows reach the rows of another: column here, column there.
LINKS = {
    ("track", "album"): ("parent_key", "key"),
    ("track", "artist"): ("grandparent_key", "key"),
    ("album", "artist"): ("parent_key", "key"),
    ("album", "track"): ("key", "parent_key"),
    ("artist", "track"): ("key", "grandparent_key"),
    ("artist", "album"): ("key", "parent_key"),
    ("season", "show"): ("parent_key", "key"),
    ("episode", "show"): ("grandparent_key", "key"),
    ("episode", "season"): ("parent_key", "key"),
}
#: The columns of a listing by type.
SHOWN = {
    "track": ("key", "grandparent_title", "parent_title", "parent_year", "index", "title", "duration", "user_rating", "view_count"),
    "album": ("key", "parent_title", "title", "year", "originally_available_at", "leaf_count", "genres"),
    "artist": ("key", "title", "genres", "countries", "user_rating"),
    "playlist": ("name", "smart", "added_at", "updated_at"),
    "episode": ("key", "grandparent_title", "parent_title", "index", "title"),
}
SORTS = {"track": ("grandparent_key", "parent_key", "index", "key"), "album": ("parent_key", "year", "title", "key"), "artist": ("title", "key")}


def _sub(prefix: str, filters: dict) -> dict:
    """The filters of a sub-query: the prefix goes, the default operator is contains."""
    out = {}
    for key, q in filters.items():
        rest = key[len(prefix) :].removeprefix("__")
        if not rest or rest in predicates.POSITIVE or rest in predicates.NEGATIVE or rest.startswith("not__"):
            rest = "title" + ("__" + rest if rest else "__contains")
        out[rest] = q
    return out


def _greedy(edges: DataFrame) -> DataFrame:
    """(__artist, __n): what goes if each place in order stays unless an earlier one that stays is linked to it.

    edges: artist, n_a, n_b with n_a before n_b.  A place that no open link reaches stays, what it is linked to goes; a round
    settles all such places at once, so there are as many rounds as the longest chain of links is deep.
    """
    edges, gone = checkpointed(edges), []

    def of(df: DataFrame, c: str) -> DataFrame:
        return df.select(F.col("artist").alias("__artist"), F.col(c).alias("__n")).distinct()

    def met(df: DataFrame, c: str, places: DataFrame, how: str) -> DataFrame:
        return df.join(places, df["artist"].eqNullSafe(places["__artist"]) & (df[c] == places["__n"]), how)

    while not gone or not edges.isEmpty():
        stays = met(edges, "n_a", of(edges, "n_b"), "left_anti")
        gone.append(checkpointed(of(stays, "n_b")))
        edges = checkpointed(met(met(edges, "n_a", gone[-1], "left_anti"), "n_b", gone[-1], "left_anti"))
    return reduce(DataFrame.union, gone)


@dataclass
class ResultSet:
    catalog: Catalog
    kind: str
    df: DataFrame

    @classmethod
    def new(cls, catalog: Catalog, kind: str, **filters) -> ResultSet:
        kind = type_name(kind)
        return cls(catalog, kind, catalog.frame(kind)).filter(**filters)

    @classmethod
    def query(cls, catalog: Catalog, kind: str, text: str, title: str | None = None, allow_inst: bool = False) -> ResultSet:
        return cls.new(catalog, kind, **parse(text, title=title, allow_inst=allow_inst))

    def _with(self, df: DataFrame) -> ResultSet:
        return ResultSet(self.catalog, self.kind, df)

    def filter(self, **filters) -> ResultSet:
        """Predicates on the rows; genre, artist, album, playlist and year filters go to their own operators."""
        filters = {resolve(k): q for k, q in filters.items()}
        out, own = self, {}
        group: dict[str, dict] = {}
        for key, q in filters.items():
            name = key.split("__")[0]
            if name == "in_playlist":
                out = out.in_playlist(q)
            elif name == "mood":
                out = out.with_mood(q, not key.endswith(("not", "ne", "!")))
            elif name == "year" and self.kind == "track":
                own["parent_year" + key[4:]] = q
            elif name in ("genre", "artist", "album", "show") and name != self.kind and name not in self.df.columns:
                group.setdefault(name, {})[key] = q
            else:
                own[key] = q
        out = out._with(predicates.where(out.df, own))
        for name, some in group.items():
            out = {"genre": out.with_genre, "artist": out.from_artist, "album": out.from_album, "show": out.of_show}[name](**_sub(name, some))
        return out

    def in_playlist(self, name: str, column: str = "key") -> ResultSet:
        items = self.catalog.frame("playlist_item").filter(F.col("name") == name).select(F.col("track_key").alias("__k")).distinct()
        return self._with(self.df.join(items, self.df[column] == F.col("__k"), "left_semi"))

    def with_mood(self, mood: str, has: bool = True) -> ResultSet:
        """Rows with a mood, or without it; a mood that no row has is an error when asked for."""
        held = F.coalesce(F.array_contains("moods", mood), F.lit(False))
        if not has:
            return self._with(self.df.filter(~held))
        # looked up when the rows are read, not when the plan is made
        known = self.catalog.frame(self.kind).select(F.bool_or(held)).scalar()
        return self._with(self.df.filter(F.when(known, held).otherwise(F.raise_error(F.lit(f"unknown mood: {mood}")).cast("boolean"))))

    def with_genre(self, **filters) -> ResultSet:
        """Tracks by their album's genres; other types by their own."""
        filters = {("genres" + k.removeprefix("title")) if k.startswith("title") else k: q for k, q in filters.items()}
        if self.kind != "track":
            return self._with(predicates.where(self.df, filters))
        return self._semi("album", predicates.where(self.catalog.frame("album"), filters))

    def _semi(self, other: str, df: DataFrame) -> ResultSet:
        here, there = LINKS[self.kind, other]
        keys = df.select(F.col(there).alias("__k")).distinct()
        return self._with(self.df.join(keys, self.df[here] == F.col("__k"), "left_semi"))

    def from_album(self, **filters) -> ResultSet:
        return self._semi("album", predicates.where(self.catalog.frame("album"), filters))

    def from_artist(self, **filters) -> ResultSet:
        """Albums by artist; tracks by artist, or by their own original title under the same predicate."""
        artists = predicates.where(self.catalog.frame("artist"), filters)
        if self.kind != "track":
            return self._semi("artist", artists)
        own = F.lit(True)
        for key, q in filters.items():
            own = own & predicates.predicate(self.df, "original_title" + key.removeprefix("title"), q) if key.startswith("title") else own & F.lit(False)
        keys = artists.select(F.col("key").alias("__k")).distinct().withColumn("__hit", F.lit(True))
        met = self.df.join(keys, self.df["grandparent_key"] == F.col("__k"), "left")
        return self._with(met.filter(F.col("__hit").isNotNull() | F.coalesce(own & F.col("original_title").isNotNull(), F.lit(False))).drop("__k", "__hit"))

    def of_show(self, **filters) -> ResultSet:
        """Seasons or episodes of the shows that fit."""
        return self._semi("show", predicates.where(self.catalog.frame("show"), filters))

    def _go(self, kind: str, filters: dict) -> ResultSet:
        if kind == self.kind:
            return self.filter(**filters)
        here, there = LINKS[self.kind, kind]
        target = ResultSet.new(self.catalog, kind, **filters)
        keys = self.df.select(F.col(here).alias("__k")).distinct()
        return target._with(target.df.join(keys, target.df[there] == F.col("__k"), "left_semi"))

    def artists(self, **filters) -> ResultSet:
        return self._go("artist", filters)

    def albums(self, **filters) -> ResultSet:
        return self._go("album", filters)

    def tracks(self, **filters) -> ResultSet:
        return self._go("track", filters)

    def with_rating(self, rating: float, op: str = "eq") -> ResultSet:
        r = F.coalesce(F.col("user_rating").cast("double"), F.lit(0.0))
        return self._with(self.df.filter({"eq": r == rating, "ne": r != rating, "gt": r > rating, "gte": r >= rating, "lt": r < rating, "lte": r <= rating}[op]))

    def _artist(self) -> Column:
        """What stands for a track's artist: of various artists' albums, the original title."""
        if "grandparent_title" not in self.df.columns:
            return F.col("grandparent_key")
        own = F.when(F.col("grandparent_title") == "Various Artists", F.col("original_title"))
        return F.coalesce(own, F.col("grandparent_key").cast("string"))

    def _best_first(self, rated: bool = True, latest: bool = True, singles: bool = False) -> list:
        order = []
        if rated:
            order.append((F.coalesce("user_rating", F.lit(0)) > 0).desc())
        if latest:
            if singles and "file" in self.df.columns:
                order.append(F.col("file").contains("/singles/").asc())
            order.append(F.col("added_at").desc_nulls_last())
        return [*order, "key"]

    def unique(self, rated: bool = True, latest: bool = True, singles: bool = False) -> ResultSet:
        """One track for each artist and lower-case title: rated first, then albums before singles, newest, lowest key."""
        w = Window.partitionBy(self._artist(), F.lower("title")).orderBy(*self._best_first(rated, latest, singles))
        return self._with(self.df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n"))

    def unique_fuzzy(self, threshold: float = 0.9) -> ResultSet:
        """As unique, and an artist's track goes if its title matches, as a name, that of a better one that stays.

        Better is unique's order.  The reference takes tracks as they come and swaps in the better of two that match; in
        this order the earlier is always the better, so nothing is swapped.  Titles that match are found among the distinct
        ones of all artists, so keys and scores grow with these, not with the tracks.  What unique leaves is written once, with all
        columns of the frame, so a frame of few columns takes less disk.
        """
        from tunelake.functions import fuzzy, names

        least = round(100 * threshold)
        first = self._with(checkpointed(self.unique().df, large=True))
        t = F.lower("title")
        spelled = first.df.select(t.alias("t")).filter("t IS NOT NULL").distinct().select("t", names.from_enclosed(F.col("t")).alias("name"))
        spelled = checkpointed(spelled.select("t", F.struct(*[F.col(f"name.{f}").alias(f) for f in names.FIELDS]).alias("name")))
        at = names.keyed(spelled, least, counts=names.counted(spelled) if least >= fuzzy.LEAST else None)
        x, y = (at.select("__k", *[F.col(c).alias(f"{c}_{side}") for c in ("t", "name", "__len")]) for side in "xy")
        met = x.join(y, "__k").filter(F.expr("t_x < t_y") & names.lengths_fit(F.col("__len_x"), F.col("__len_y"), least)).groupBy("t_x", "t_y").agg(F.first("name_x").alias("name_x"), F.first("name_y").alias("name_y"))
        tasks = self.df.sparkSession.sparkContext.defaultParallelism * 4
        near = checkpointed(met.repartition(tasks, "t_x", "t_y").filter(names.score_udf("name_x", "name_y") >= least).select("t_x", "t_y"))
        # only tracks of such titles go on; an artist has a title once, so two rows of an artist's pair of titles are a link
        linked = near.select(F.explode(F.array("t_x", "t_y")).alias("__t")).distinct()
        w = Window.partitionBy("artist").orderBy(*first._best_first())
        nodes = first.df.join(linked, t == F.col("__t"), "left_semi").withColumn("artist", first._artist()).withColumn("n", F.row_number().over(w)).select("artist", "key", "n", t.alias("t"))
        ends = nodes.join(near.select("*", F.explode(F.array("t_x", "t_y")).alias("t")), "t")
        place = F.struct("n", "key")
        pairs = ends.groupBy("artist", "t_x", "t_y").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a.n < b.n")
        pairs = checkpointed(pairs.select("artist", F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"), F.col("b.key").alias("__k")), large=True)
        gone = _greedy(pairs.select("artist", "n_a", "n_b"))
        dropped = pairs.join(gone, pairs["artist"].eqNullSafe(gone["__artist"]) & (pairs["n_b"] == gone["__n"]), "left_semi").select("__k").distinct()
        alone, others = (first.df.join(linked, t == F.col("__t"), how) for how in ("left_anti", "left_semi"))
        return first._with(alone.union(others.join(dropped, F.col("key") == F.col("__k"), "left_anti")))

    def _same(self, other: ResultSet) -> None:
        if not isinstance(other, ResultSet):
            raise TypeError("not a result set")
        if other.kind != self.kind:
            raise ValueError(f"{self.kind} and {other.kind} don't mix")

    def __add__(self, other: ResultSet) -> ResultSet:
        self._same(other)
        return self._with(self.df.unionByName(other.df).dropDuplicates(["key"]))

    def __sub__(self, other: ResultSet) -> ResultSet:
        self._same(other)
        keys = other.df.select(F.col("key").alias("__k")).distinct()
        return self._with(self.df.join(keys, self.df["key"] == F.col("__k"), "left_anti"))

    def __and__(self, other: ResultSet) -> ResultSet:
        self._same(other)
        keys = other.df.select(F.col("key").alias("__k")).distinct()
        return self._with(self.df.join(keys, self.df["key"] == F.col("__k"), "left_semi"))

    def keys(self, column: str = "key") -> DataFrame:
        return self.df.select(column).distinct()

    def items(self) -> DataFrame:
        return self.df.select("key", F.struct("*").alias("item"))

    def page(self, number: int, size: int = 50, *sort) -> DataFrame:
        """A page of the sorted rows; the first is 1."""
        if number < 1 or size < 1:
            raise ValueError("pages and sizes start at 1")
        return self.df.orderBy(*(sort or SORTS[self.kind])).offset(size * (number - 1)).limit(size)

    def result(self):
        return self.df.orderBy("key").first()

    def count(self) -> int:
        return self.df.count()

    def __len__(self) -> int:
        return self.count()

    def __bool__(self) -> bool:
        return not self.df.isEmpty()

    def __iter__(self):
        """The rows, streamed a partition at a time."""
        return self.df.toLocalIterator()

    def table(self) -> DataFrame:
        """The columns that a listing of this type shows, those of them that the frame has."""
        return self.df.select(*[c for c in SHOWN.get(self.kind, ("key", "title")) if c in self.df.columns])
