"""Names: scores against fixed cases, joins against all pairs."""

import itertools

from pyspark.sql import functions as F

from tunelake.functions import names
from tunelake.operators import matching, pages, playlists, tags

PLAIN = dict.fromkeys(names.FIELDS) | {"versions": ()}


def name(eng=None, non_eng=None, romanized=None, versions=()):
    return PLAIN | {"eng": eng, "non_eng": non_eng, "romanized": romanized, "versions": versions}


def matches(a, b, threshold=90):
    return names.score(a, b) >= threshold


def test_names_match_by_any_version():
    girls = name("Girls' Generation", "소녀시대", "So Nyeo Si Dae", (name("SNSD", "소녀시대", "So Nyeo Si Dae"), name("Girls' Generation", "少女時代", "Shoujo Jidai")))
    for eng in ("girls generation", "Girls' Generation", "Girls’ Generation", "snsd", "SNSD", "So Nyeo Si Dae", "Shoujo Jidai"):
        assert matches(girls, name(eng)), eng
    for non in ("소녀시대", "少女時代"):
        assert matches(girls, name(None, non)) and matches(name(None, non), girls)
        assert matches(girls, name("Girls' Generation", non))
    for other in (name("Girls’ Generation-Oh!GG"), name("sns"), name(None, "소녀시대-Oh!GG")):
        assert not matches(girls, other), other
    assert matches(name("Some Song OST"), name("Some Song")) and matches(name("Some Song"), name("Some Song OST"))


def test_spellings_of_hangul():
    for non, eng in (("소녀시대", "So Nyeo Si Dae"), ("소녀시대", "sonyeo sidae"), ("방탄소년단", "Bangtan Sonyeondan"), ("에이핑크", "eipingkeu"), ("태연", "Taeyeon"), ("지민", "Jimin"), ("박", "bak")):
        assert names.romanizes(non, eng), eng
        assert names.sounds(non) == names.sounds(eng), (names.sounds(non), names.sounds(eng))
    assert not names.romanizes("소녀시대", "Girls Generation") and not names.romanizes("少女", "shoujo")
    assert names.name_of(["Girls", "소녀시대", "So Nyeo Si Dae"]) == ("Girls", "소녀시대", "So Nyeo Si Dae", None)
    assert names.name_of(["So Nyeo Si Dae", "소녀시대", "Girls"]) == ("Girls", "소녀시대", "So Nyeo Si Dae", None)
    assert names.name_of([None, ""]) == (None,) * 4


def test_every_spelling_has_the_sounds_of_its_letters():
    for table, at in ((names.INITIAL, 0), (names.VOWEL, 1), (names.FINAL, 2)):
        for k, some in enumerate(table):
            code = [0xAC00 + k * 588, 0xAC00 + 11 * 588 + k * 28, 0xAC00 + 11 * 588 + k][at]
            vowel = ("", "a", "a")[at] if at != 1 else ""
            for x in some.split("|"):
                spelled = x + "a" if at == 0 else x if at == 1 else vowel + x
                assert names.romanizes(chr(code), spelled) and names.sounds(chr(code)) == names.sounds(spelled), (chr(code), spelled)


def test_joined_matches_are_all_pairs(spark):
    eng = ["The Boyz", "Boyz", "Red Velvet", "Red Velvets", "Velvet Red", "Taeyeon", "Cold ring", "Old ring", "IU", "Sonyeo Sidae", "Girls Generation OST", None]
    non = [None, "더보이즈", None, None, None, "태연", None, None, "아이유", None, "소녀시대", "소녀시대"]
    rows = [(k, (e, n, None, None, [])) for k, (e, n) in enumerate(zip(eng, non))]
    rows += [(20, (None, "소녀시대", None, None, [])), (21, ("Tae Yeon", None, None, None, [])), (22, ("girls generation", None, None, None, [("SNSD", "소녀시대", None, None)])), (23, (None, None, None, None, []))]
    df = spark.createDataFrame(rows, f"id int, name struct<eng:string,non_eng:string,romanized:string,lit:string,versions:{names.VERSIONS}>")
    got = {(r.id, r.id_match): r.score for r in names.best_matches(df, df, "id", "id").collect()}
    flat = lambda n: [dict(zip(names.FIELDS, n[:4])) | {"versions": ()}] + [dict(zip(names.FIELDS, v)) | {"versions": ()} for v in n[4]]
    want = {}
    for (i, a), (j, b) in itertools.product(rows, rows):
        best = max(names.score(x, y) for x in flat(a) for y in flat(b))
        if best >= 90:
            want[i, j] = best
    assert got == want and (5, 21) in got and (9, 20) in got
    best = {r.id: r.id_match for r in names.best_match(df.filter("id < 20"), df.filter("id >= 20"), "id", "id").collect()}
    assert best[5] == 21 and best[9] == 20


def test_replacements_by_tier(spark):
    kind = "artist_key long, album_key long, artist string, album string, title string"
    gone = spark.createDataFrame([(1, 1, 1, "A", "X", "Cold Ring"), (2, 9, 9, "Bea", "Why", "Bolt"), (3, 8, 8, "Seal Band", "Zed Album", "Nut")], f"track_key long, {kind}")
    tracks = spark.createDataFrame([(10, 1, 1, "A", "X", "cold ring"), (11, 7, 7, "Bea", "Why", "Bolt"), (12, 6, 6, "Seal Bands", "Zed Album!", "Nut"), (13, 5, 5, "Other", "Else", "Nut")], f"key long, {kind}")
    assert sorted((r.track_key, r.replacement, r.priority) for r in matching.replacement_tiers(gone, tracks).collect()) == [(1, 10, 1), (2, 11, 2), (3, 12, 3)]


def test_albums_and_scores(spark):
    columns = "artist string, name string, type string, num int, repackage boolean, url string"
    files = spark.createDataFrame([(1, "a", "The Red", "Album", 1, False, "u1"), (2, "a", "The Blue", "Album", 2, False, None), (3, "a", "Green", "EP", 4, False, None), (4, "b", "None", "Album", 9, False, None)], f"album int, {columns}")
    entries = spark.createDataFrame([(1, "a", "Other", "Album", 7, False, "u1"), (2, "a", "the blue", "Album", 5, False, None), (3, "a", "Leaf", "EP", 4, False, None)], f"entry int, {columns}")
    assert sorted(map(tuple, matching.album_lookup(files, entries).collect())) == [(1, 1, "url"), (2, 2, "name"), (3, 3, "number")]
    wanted = spark.createDataFrame([(1, "The Blue")], "id int, n string").select("id", names.from_enclosed(F.col("n")).alias("name"))
    targets = spark.createDataFrame([("entry", "e1", "the blue"), ("edition", "e2", "The Blue (Limited)"), ("part", "p", "Green")], "kind string, target string, n string").select("kind", "target", names.from_enclosed(F.col("n")).alias("name"))
    assert {(r.kind, r.target) for r in matching.match_scores(wanted, targets).collect()} >= {("entry", "e1")}


def test_playlist_positions_over_many_ranges(spark):
    tracks = spark.range(5000).select(F.col("id").alias("key"), F.expr("pmod(hash(id), 50)").alias("o")).repartition(7)
    got = [(r.pos, r.track_key) for r in playlists.create(tracks, "p", ["o"]).collect()]
    order = sorted((r.o, r.key) for r in tracks.collect())
    assert sorted(got) == [(k, key) for k, (_, key) in enumerate(order)]


def test_leaf_folders_and_empty_frames(spark):
    paths = spark.createDataFrame([("/m/a/1.mp3",), ("/m/a/b/2.mp3",), ("/m/c/3.mp3",)], "path string")
    assert sorted(map(tuple, tags.leaf_folders(paths).collect())) == [("/m/a/b", 1), ("/m/c", 1)]
    assert tags.leaf_folders(paths.filter("false")).count() == 0
    assert pages.group_edges(spark.createDataFrame([], "member int, groups array<string>, units array<string>")).count() == 0
