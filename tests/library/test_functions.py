import itertools

import pytest
from pyspark.sql import functions as F

from tunelake.functions import names, scalar, text
from tunelake.functions.albums import parse_album
from tunelake.operators import playlists
from tunelake.operators.pages import ALBUM_TYPES, CLASSES, album_type, classify, kinds_of, type_from_folder
from tunelake.plans.text_query import InvalidQuery, parse


@pytest.mark.parametrize(
    "args, want",
    [(("a (b) c",), ("a", "b", "c")), (('"a (b) "c"', False), ("", "a (b)", 'c"')), (("a - (b) - c", False, True), ("a -", "b", "- c")), (("abc",), None), ((')a (b) "c"', True), (")a (b)", "c", ""))],
)
def test_partition_enclosed(args, want):
    assert text.partition_enclosed(*args) == want


def test_split_enclosed_and_unpaired():
    assert text.split_enclosed("((a) b)") == ["(a) b"]
    assert text.split_enclosed("((a) b)", 1) == ["a", "b"]
    assert text.split_enclosed("((a (b)) c)", 1) == ["a (b)", "c"]
    assert (text.unpaired("())"), text.unpaired("(()"), text.unpaired("(a)b [(c)d-e]")) == (2, 0, None)
    assert text.strip_enclosed("(a b)") == "a b" and text.strip_enclosed("(a) (b)") == "a) (b" and text.strip_enclosed("a (b)") == "a (b)"


def test_fuzzy_text():
    assert text.fuzz_process("foo$") == "foo" and text.fuzz_process("foo$", False) == "foo$" and text.fuzz_process("$$  $") == "$$ $"
    assert text.fuzz_process("Café OST") == "cafe"
    assert text.weighted_ratio("", "") == 0 and text.weighted_ratio("a", "abcdefg") == 25
    assert text.combine_with_parens(["a", "b"]) == "a (b)" and text.combine_with_parens({"c", "a", "b"}) == "a (b) (c)"


def test_common_subsequence_against_brute_force():
    for a, b in itertools.product(["", "abcab", "bca", "aaa", "cabcb"], repeat=2):
        subs = {"".join(x) for n in range(len(a) + 1) for x in itertools.combinations(a, n)}
        other = {"".join(x) for n in range(len(b) + 1) for x in itertools.combinations(b, n)}
        assert text._common(a, b) == max(map(len, subs & other))


def test_list_split():
    assert text.split_balanced("88rising, Rich Brian, 청하 (CHUNG, HA)") == ["88rising", "Rich Brian", "청하 (CHUNG, HA)"]


def test_parse():
    assert parse("artist~iu rating>=6") == {"artist__like": "iu", "user_rating__gte": 6, "title__not_like": r"inst(?:\.?|rumental)"}
    assert parse("year NOT contains 5", allow_inst=True) == {"year__not_contains": "5"}
    assert parse("title CONTAINS two words year=2000", allow_inst=True) == {"title__contains": "two words", "year__exact": 2000}
    assert parse("", title="a.*b", allow_inst=True) == {"title__like": "a.*b"}
    assert parse("title~(x)", allow_inst=True) == {"title__like": r"\(x\)"}
    for bad in ("what", "a>>", "a=1 a=2"):
        with pytest.raises(InvalidQuery):
            parse(bad)


def test_album_type_takes_the_first_in_order(spark):
    categories = ["2020 mini albums", "Albums", "Singles", "x"]
    rows = [(list(p),) for p in itertools.permutations(categories)]
    got = {r[0] for r in spark.createDataFrame(rows, "c array<string>").select(album_type(F.col("c"))).collect()}
    assert got == {"Mini Album"} and ALBUM_TYPES[0][0] == "Mini Album"


def test_album_type_of_categories(spark):
    cases = {("mini albums", "albums", "2020 mini albums", "2020 releases"): "Mini Album", ("Singles", "As featured artist"): "Feature", ("Studio albums",): "Album", ("EPs",): "EP", ("others",): "UNKNOWN", ("x",): "UNKNOWN", (): "UNKNOWN"}
    rows = spark.createDataFrame([(list(c), want) for c, want in cases.items()], "c array<string>, want string").select("want", album_type(F.col("c")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_classes(spark):
    expected = {"singer": "Singer", "group": "Group", "discography": "Discography", "album": "Album", "single": "Single", "soundtrack": "Soundtrack", "agency": "Agency", "competition": "SpecialEvent", "television program": "TVSeries"}
    many = ["emi group artists", "japanese-language singers of south korea", "k-pop music groups", "musical groups established in 2011", "musical groups from seoul", "south korean girl groups"]
    rows = [(c, [c]) for c in expected] + [("many", many), ("none", ["test test test"])]
    df = spark.createDataFrame(rows, "url string, categories array<string>")
    got = {r.url: r["class"] for r in classify(df).collect()}
    assert got == expected | {"many": "Group", "none": "WikiEntity"}
    every = [c for c, *_ in CLASSES]
    for requested in every:
        found = {r.url: (r["class"], r.error) for r in classify(df, requested).collect()}
        for url, cls in [*expected.items(), ("none", "WikiEntity")]:
            ok = requested in kinds_of(cls)
            assert found[url] == ((cls, False) if ok else (None, True)), (requested, url)
    tricky = spark.createDataFrame([("t", ["test artists", "test group members"])], "url string, categories array<string>")
    assert classify(tricky, "Artist").first()["class"] == "Singer"


@pytest.mark.parametrize("title, want", [
    ("The Red [1st Album]", ("The Red", "1st Album", "Album", [], False, None)),
    ("#Cookie Jar [1st Japanese Mini Album]", ("#Cookie Jar", "1st Japanese Mini Album", "Mini Album", [], False, None)),
    ("화랑 OST Part.2", ("화랑", None, "Soundtrack", [], True, 2)),
    ("슬기로운 감빵생활 O.S.T Part.5", ("슬기로운 감빵생활", None, "Soundtrack", [], True, 5)),
    ("Make It Right (feat. Lauv) (EDM Remix)", ("Make It Right", None, None, ["Lauv"], False, None)),
    ("Wannabe (Feat. San E)", ("Wannabe", None, None, ["San E"], False, None)),
    ("어린왕자 OST", ("어린왕자", None, "Soundtrack", [], True, None)),
    ("SAPPY - Single", ("SAPPY", None, "Single", [], False, None)),
    ("OBSESSION - The 6th Album", ("OBSESSION", "6th Album", "Album", [], False, None)),
    ("&TWICE (Repackage)", ("&TWICE", None, None, [], False, None)),
    ("OST Best - Flash Back", ("OST Best - Flash Back", None, None, [], False, None)),
])
def test_album_titles(spark, title, want):
    r = spark.range(1).select(parse_album(F.lit(title)).alias("a")).first().a
    assert (r.name, r.num, r.type, r.feat, r.ost, r.part) == want


def test_ordinals_and_titles(spark):
    row = spark.range(1).select(*[scalar.find_ordinal(F.lit(x)).alias(f"o{i}") for i, x in enumerate(["My Debut album", "the Twentieth", "12th x", "no"])], scalar.title_case(F.lit("THE (wind-up) bird OF a day")).alias("t")).first()
    assert tuple(row) == (1, 20, 12, None, "The (Wind-Up) Bird of a Day")


def test_names(spark):
    df = spark.createDataFrame([(1, "IU (아이유)"), (2, "아이유"), (3, "Somebody"), (4, None)], "id long, t string").select("id", names.from_enclosed(F.col("t")).alias("name"))
    first = df.orderBy("id").first().name
    assert (first.eng, first.non_eng) == ("IU", "아이유")
    best = {r.id: r.id_match for r in names.best_match(df.filter("id = 1"), df.filter("id <> 1"), "id", "id").collect()}
    assert best == {1: 2}
    pair = df.alias("a").join(df.alias("b"), F.expr("a.id = 1 AND b.id = 2")).select(names.merge(F.col("a.name"), F.col("b.name")).alias("m"), names.compatible(F.col("a.name"), F.col("b.name")).alias("c")).first()
    assert pair.c and (pair.m.eng, pair.m.non_eng, pair.m.versions) == ("IU", "아이유", [])
    other = df.alias("a").join(df.alias("b"), F.expr("a.id = 1 AND b.id = 3")).select(names.merge(F.col("a.name"), F.col("b.name")).alias("m")).first()
    assert [v.eng for v in other.m.versions] == ["Somebody"]


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.normalize_case(F.lit("HELLO  you")).alias("caps"),
        scalar.normalize_case(F.lit("ost")).alias("ost"),
        scalar.clean_title(F.lit("A (96 kHz)"), F.lit(48000)).alias("other_rate"),
        scalar.strip_url(F.lit("la la\nhttps://x.y/z ")).alias("lyrics"),
        scalar.expand_language(F.lit("JP. Ver")).alias("language"),
        scalar.readable_size(F.lit(1536)).alias("size"),
        scalar.stars_from_256(F.lit(0)).alias("none"),
        scalar.parse_date(F.lit("2021.01.02")).alias("day"),
    ).first()
    assert tuple(row)[:7] == ("Hello You", "ost", "A (96 kHz)", "la la", "Japanese Ver", "1.50 KB", None) and str(row.day) == "2021-01-02"


def test_more_enclosed(spark):
    assert text.extract_enclosed("a ('b (c)') (d)") == "b (c)" and text.extract_enclosed("a (b") == "a (b"
    assert text.ends_with_enclosed("a (b)") == "()" and text.ends_with_enclosed("(b) a") is None and text.ends_with_enclosed("a") is None
    assert text.strip_unpaired("a)") == "a" and text.strip_unpaired("a) b") == "a) b" and text.strip_enclosed('"a b c', True) == "a b c"
    assert text.partition_enclosed("a - (b) - c", inner=True) == ("a -", "b", "- c") and text.partition_enclosed(')a (b) "c"', reverse=True) == (")a (b)", "c", "")
    assert text.partition_enclosed("it's a (b's) c") == ("it's a", "b's", "c") and text.partition_enclosed("「a」 b") == ("", "a", "b")
    assert text.split_enclosed("a (b) c", maxsplit=1) == ["a", "(b) c"] and text.split_enclosed("a (b) c", maxsplit=1, reverse=True) == ["a (b)", "c"]
    assert text.split_enclosed("a (b) c [d] e", maxsplit=2) == ["a", "b", "c [d] e"] and text.split_enclosed("a (b) c [d] e") == list("abcde")
    assert text.split_enclosed("((a (b)) c)", 2) == ["a", "b", "c"] and text.split_enclosed("a", maxsplit=1) == ["a"]
    assert text.combine_with_parens(["a (x)", "b (x)"]) == "a (b) (x)" and text.combine_with_parens(["a"]) == "a"
    assert len(text.OPENERS) == len(text.CLOSERS) == 42
    df = spark.createDataFrame([("a (b) c",), ("(a)",), ("a)",), (None,)], "t string").select(text.is_enclosed(F.col("t")).alias("e"), text.partition_enclosed_column(F.col("t")).alias("p"), text.split_enclosed_column(F.col("t"), maxsplit=1).alias("s"), text.strip_unpaired_udf("t").alias("u"), text.extract_enclosed_udf("t").alias("x"), text.ends_with_enclosed_udf("t").alias("m"))
    got = df.collect()
    assert [r.e for r in got] == [False, True, False, False] and [r.p and tuple(r.p) for r in got] == [("a", "b", "c"), ("", "a", ""), None, None]
    assert [r.s for r in got] == [["a", "(b) c"], ["a"], ["a)"], None] and [r.u for r in got] == ["a (b) c", "(a)", "a", None]
    assert [r.x for r in got] == ["b", "a", "a)", None] and [r.m for r in got] == [None, "()", None, None]


def test_paths_and_folders(spark):
    row = spark.range(1).select(
        scalar.map_path(F.lit("/media/a/b.mp3"), "/media", "/home/x/").alias("p"),
        scalar.map_path(F.lit("/other"), "/media", "/home").alias("q"),
        scalar.repair_date(F.lit(" "), F.lit("2001")).alias("d"),
        scalar.single(F.array(F.lit("a"))).alias("s"),
        type_from_folder(F.lit("X/Mini Albums/[2001.01.01] T [2nd Mini Album]")).alias("f"),
        type_from_folder(F.lit("X/Soundtracks/T")).alias("g"),
        type_from_folder(F.lit("X/Albums/T")).alias("h"),
        scalar.escape_space(F.lit("a\nb")).alias("e"),
    ).first()
    assert (row.p, row.q, row.d, row.s, tuple(row.f), tuple(row.g), row.h, row.e) == ("/home/x/a/b.mp3", None, "2001", "a", ("Mini Album", 2), ("Soundtrack", 1), None, "a\\nb")


def test_playlist_create_and_sync_limits(spark):
    t = spark.createDataFrame([(1, "b"), (2, "a")], "key long, title string")
    assert [tuple(r) for r in playlists.create(t, "x", ["title"]).orderBy("pos").collect()] == [("x", 0, 2), ("x", 1, 1)]
    files = spark.createDataFrame([("/m/a", 1, 5), ("/n/b", 2, 9)], "path string, file_stars int, modified int")
    lib = spark.createDataFrame([("/m/a", 3), ("/n/b", 3)], "path string, user_rating int")
    assert [r.path for r in playlists.rating_sync(files, lib, False, below="/n").collect()] == ["/n/b"]
    assert [r.path for r in playlists.rating_sync(files, lib, False, since=1, until=6).collect()] == ["/m/a"]


def test_best_match_and_members_against_all_pairs(spark):
    from tunelake.operators.matching import members

    left = ["The Winding Mountain Road", "Xrange Caramel", "IU (아이유)", "Boyz", "ab", "ring cold", "nothing like it", "Old One"]
    right = ["Winding Mountain Road", "Orange Caramel", "아이유", "The Boyz", "a b", "cold ring", "old ring", "Boyz OST", "Something"]
    name = names.from_enclosed(F.col("t")).alias("name")
    a, b = (spark.createDataFrame(list(enumerate(t)), "id long, t string").select("id", "t", name) for t in (left, right))
    a = a.withColumn("name", F.when(F.col("t") == "Old One", names.merge(F.col("name"), F.expr("named_struct('eng', 'Something', 'non_eng', NULL, 'romanized', NULL, 'lit', NULL, 'versions', name.versions)"))).otherwise(F.col("name")))
    plain = lambda n: [{f: x[f] for f in names.FIELDS} for x in (n, *n["versions"])]
    want = {}
    for x in a.collect():
        scores = [(-max(names.score(p, q) for p in plain(x.name) for q in plain(y.name)), y.id) for y in b.collect()]
        if min(scores)[0] <= -90:
            want[x.id] = (min(scores)[1], -min(scores)[0])
    for threshold in (90, 60):
        got = {r.id: (r.id_match, r.score) for r in names.best_match(a, b, "id", "id", threshold=threshold).collect()}
        assert {k: v for k, v in got.items() if v[1] >= 90} == want
    assert want[1][0] == 1 and want[7][0] == 8
    edges, people = a.selectExpr("id AS group", "t AS name"), b.selectExpr("id AS member", "t AS name")
    near = {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if text.weighted_ratio(x, y) >= 90}
    assert {tuple(r) for r in members(edges, edges.select("group"), people).collect()} == near and (1, 1) in near
