"""Editions and entities on small cases: every branch, nulls, ties, rings, empty tables."""

import pytest
from pyspark.sql import functions as F

from tunelake import entity_queries  # noqa: F401
from tunelake.functions import names
from tunelake.operators import editions, entities
from tunelake.queries import QUERIES

DATA = "/root/testdata/sf0.001"
NAME = entities.NAME


def name(eng=None, non_eng=None, romanized=None, lit=None, versions=()):
    return (eng, non_eng, romanized, lit, list(versions))


@pytest.mark.parametrize(
    ("query", "column", "want"),
    [
        ("track_continuation", "by", {"own", "continued", "overlaid"}),
        ("zip_by_evidence", "by", {"position", "disks", "disk and number", "disk and number of available", "number", "number of available"}),
        ("disambiguation_staged", "stage", {"only", "entity", "name", "native", "none"}),
        ("search_repeated", "round", {0, 1, 2}),
        ("group_closure", "depth", {1, 2, 3, 4}),
        ("member_lookup", "by", {"member", "name", "none"}),
        ("report_with_subtotals", "level", {0, 1, 3, 7}),
    ],
)
def test_every_branch_is_taken(spark, query, column, want):
    assert want <= {r[0] for r in QUERIES[query](spark, "/root/testdata/sf0.01").select(column).distinct().collect()}


def test_continued_editions(spark):
    e = spark.createDataFrame([(1, "x", 1, None), (2, "x", 2, False), (3, "x", 3, None), (4, "x", 4, None), (5, "x", 5, True), (6, "y", 1, None), (7, "x", 6, None), (8, "x", 7, None)], "edition int, album string, pos int, side boolean")
    t = [(1, n, f"a{n}") for n in (1, 2, 3)] + [(2, 1, "b1")] + [(3, n, f"c{n}") for n in (4, 5)] + [(4, n, f"d{n}") for n in (3, 7)] + [(5, 9, "e9"), (6, 4, "f4"), (7, 8, "g8")]
    got = {(r.edition, r.num): (r.title, r.source, r.by) for r in editions.continuation(e, spark.createDataFrame(t, "edition int, num int, title string")).collect()}
    of = lambda k: {n: v[0] for (ed, n), v in got.items() if ed == k}
    assert of(1) == {1: "a1", 2: "a2", 3: "a3"} and of(2) == {1: "b1"}
    assert of(3) == {1: "a1", 2: "a2", 3: "a3", 4: "c4", 5: "c5"} and got[3, 4][2] == "continued"
    # nothing ends at 2: laid over the third edition, with all that it continues
    assert of(4) == {1: "a1", 2: "a2", 3: "d3", 4: "c4", 5: "c5", 7: "d7"} and got[4, 3] == ("d3", 4, "overlaid")
    assert of(5) == {9: "e9"} and got[5, 9][2] == "own" and of(6) == {4: "f4"} and got[6, 4][2] == "own"
    # the fourth ends at 7 only as it was settled
    assert of(7) == of(4) | {8: "g8"} and got[7, 8][2] == "continued" and of(8) == {}
    assert editions.continuation(e.limit(0), spark.createDataFrame(t, "edition int, num int, title string")).count() == 0


def test_zips_of_odd_albums(spark):
    albums = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 3, 1)], "album string, edition int, part int")
    files = spark.createDataFrame([("a", "p1", 1, None), ("a", "p2", 1, 2), ("b", "q1", 1, 5), ("b", "q2", 1, 5), ("b", "q3", None, 1)], "album string, path string, disk int, num int")
    tracks = spark.createDataFrame([(1, 1, 10, True), (1, 1, 20, True), (2, 1, 1, True), (2, 2, 1, False), (3, 1, 1, True)], "edition int, part int, num int, available boolean")
    got = {(r.album, r.path): (r.part, r.nth, r.by) for r in editions.zip_files(albums, files, tracks).collect()}
    assert got == {("a", "p1"): (1, 1, "position"), ("a", "p2"): (1, 2, "position"), ("b", "q3"): (1, 1, "disks"), ("b", "q1"): (2, 1, "disks")}
    assert editions.zip_files(albums, files.limit(0), tracks).count() == 0


def test_disambiguation_by_stages(spark):
    q = [(1, name("Cold Ring", "차가운 반지"), None, None), (2, name("Cold Ring"), name("Old Ring"), ["Ga "]), (3, None, None, None), (4, name("Cold Ring"), None, None), (5, name("Nothing like it"), None, None), (6, name("Cold Ring"), name("Cold Ring"), ["ga"])]
    c = [(1, "l1", name("Ring Cold"), None), (1, "l2", name("cold ring", "다른 반지"), None), (1, "l3", name(None, "차가운반지"), None), (2, "l4", name("old ring"), ["other"]), (2, "l5", name("Old Ring"), ["GA", "x"]), (2, "Category:l6", name("hot bolt"), None)]
    c += [(3, "l7", None, None), (3, "l8", name("x"), []), (4, "l9", None, None), (5, "l10", name("a"), None), (5, "l11", name("b"), None), (6, "Category:l12", name("Cold ring"), ["no"]), (6, "l13", name("Cold ring"), ["no"])]
    queries = spark.createDataFrame([*q, (7, None, None, None)], f"query int, name {NAME}, entity {NAME}, groups array<string>")
    got = entities.disambiguation(queries, spark.createDataFrame(c, f"query int, link string, name {NAME}, groups array<string>")).collect()
    rows = {}
    for r in got:
        rows.setdefault(r.query, []).append((r.link, r.stage, r.ambiguous))
    assert rows[1] == [("l3", "native", False)]
    assert rows[2] == [("l5", "entity", False)] and sorted(rows[3]) == [("l7", "only", True), ("l8", "only", True)]
    assert rows[4] == [("l9", "only", False)] and sorted(rows[5]) == [("l10", "name", True), ("l11", "name", True)]
    assert rows[6] == [("Category:l12", "entity", False)] and rows[7] == [(None, "none", True)]


def test_disambiguation_by_groups_and_native_names(spark):
    # groups go by names that come near, with their spelling in parentheses; empty lists and nulls tell nothing
    q = [(k, name("Cold Ring"), name("Cold Ring"), groups) for k, groups in ((1, ["Velvet Harbor"]), (2, ["벨벳 하버 (Velvet Harbor)"]), (3, []), (4, [None, "Iron Meadow"]))]
    c = [(k, link, name("cold ring"), groups) for k in (1, 2, 3, 4) for link, groups in (("near", ["velvet harbors", None]), ("far", ["iron meadow"]))]
    # the other script alone finds what the English name kept out, among all that the entity left
    q += [(5, name("Cold Ring", "차가운 반지"), None, None), (6, name("Cold Ring", "차가운 반지"), name("Other Title"), None), (7, name(None, "차가운 반지", None, "Cold Ring"), None, None)]
    c += [(k, link, n, None) for k in (5, 6) for link, n in (("a", name("Cold ring")), ("b", name("cold Ring", "다른 말")), ("c", name("Other Title", "차가운 반지")), ("d", name("x", "다른 말")))]
    c += [(7, "e", name(None, "차가운 반지", None, "x"), None), (7, "f", name(None, "차가운반지"), None), (7, "g", name("y"), None)]
    schema = f"name {NAME}, groups array<string>"
    got = entities.disambiguation(spark.createDataFrame(q, f"query int, name {NAME}, entity {NAME}, groups array<string>"), spark.createDataFrame(c, f"query int, link string, {schema}")).collect()
    rows = {}
    for r in sorted(got):
        rows.setdefault(r.query, []).append((r.link, r.stage, r.ambiguous))
    assert rows[1] == rows[2] == [("near", "entity", False)] and rows[4] == [("far", "entity", False)]
    assert rows[3] == [("far", "name", True), ("near", "name", True)]
    assert rows[5] == [("c", "native", False)] and rows[6] == [("c", "entity", False)]
    assert rows[7] == [("e", "native", True), ("f", "native", True)]


def test_disambiguation_fuzzy_by_brute_force(spark):
    from functools import cache

    from tunelake.entity_queries import _searched_parts

    plain = lambda n: n and tuple(n[f] for f in names.FIELDS)
    match = cache(lambda a, b: bool(a and b) and names.score(*[dict(zip(names.FIELDS, n)) for n in (a, b)]) >= 90)
    near = cache(lambda a, b: names.score(*[dict.fromkeys(names.FIELDS) | {"eng": n} for n in (a, b)]) >= 90)

    def one(q, c):
        """What is left, the stage that decided, whether more than one is left or none was."""
        groups, ways = q.groups or (), []
        if len(c) > 1 and q.entity:
            ways.append(("entity", lambda x: match(plain(q.entity), plain(x.name)) and (x.link.startswith("Category:") or not groups or not x.groups or any(near(g, h) for g in groups for h in x.groups))))
        if len(c) == 1:
            return c, "only", False
        left, stage = c, "only"
        for stage, test in ways:
            found = [x for x in left if test(x)]
            if len(found) < 2:
                return found or left, stage, not found
            left = found
        if q.name:
            found = [x for x in left if match(plain(q.name), plain(x.name))]
            stage = "name"
            if len(found) > 1 and q.name.eng and q.name.non_eng:
                stage, before = "native", found
                found = [x for x in left if match((None, q.name.non_eng, None, None), plain(x.name))]
                left = before
            return found or left, stage, len(found) != 1
        return left, stage, True

    queries, candidates = (df.collect() for df in _searched_parts(spark, DATA))
    links = {}
    for x in candidates:
        if "disambiguation" not in x.link:
            links.setdefault(x.query, []).append(x)
    want = []
    for q in queries:
        left, stage, ambiguous = one(q, links[q.query]) if q.query in links else ([None], "none", True)
        want += [(q.query, x and x.link, stage, ambiguous) for x in left]
    got = [tuple(r) for r in QUERIES["disambiguation_fuzzy"](spark, DATA).select("query", "link", "stage", "ambiguous").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {(r[2], r[3]) for r in got} >= {("only", False), ("entity", False), ("entity", True), ("name", False), ("name", True), ("native", False), ("native", True), ("none", True)}


def test_names_fold_in_order(spark):
    rows = [(1, 3, name("Abc", None, "r")), (1, 1, name("abc", "가")), (1, 2, name(None, "가", None, "l")), (1, 4, name("Abc", "나")), (1, 5, name("xyz")), (1, 6, name("xyz")), (2, 1, name(None, "가")), (2, 2, name("d")), (2, 3, name("d", "가")), (3, 1, name())]
    df = spark.createDataFrame(rows, f"artist int, page_id int, name {NAME}")
    got = {r.artist: [tuple(n)[:4] for n in r.names] for r in entities.folded_names(df, "artist").collect()}
    assert got == {1: [("abc", "가", "r", "l"), ("Abc", "나", None, None), ("xyz", None, None, None)], 2: [("d", "가", None, None), ("d", None, None, None)], 3: [(None, None, None, None)]}
    with_versions = {r.artist: r.names for r in entities.folded_names(df, "artist", versions=True).collect()}
    assert [tuple(v)[:2] for v in with_versions[1][0].versions] == [("Abc", "나")] and len(with_versions[1]) == 2
    chosen = entities.folded_names(df, "artist").select("artist", entities.chosen_name(F.col("names"), F.lit("D")).alias("n")).collect()
    assert {r.artist: r.n.eng for r in chosen} == {1: "abc", 2: "d", 3: None}


def test_searches_end_and_rings_close(spark):
    w = spark.createDataFrame([("A", "x"), ("A", "x"), ("LOUD ONE", "x"), ("none", "x"), ("b", None)], "title string, type string")
    p = [("s1", "A", 1, "B", "x"), ("s2", "B", 2, "A", "x"), ("s3", "B", 3, None, "y"), ("s1", "Loud One", 4, "Loud One", "x"), ("s1", "b", 5, None, None), ("s1", "A", 0, "C", "y")]
    pages = spark.createDataFrame(p, "site string, title string, page_id int, english string, type string")
    got = sorted(map(tuple, entities.searched(w, pages).collect()))
    assert got == [("A", "s1", 1, "A", 0), ("A", "s2", 2, "B", 1), ("LOUD ONE", "s1", 4, "Loud One", 1), ("b", "s1", 5, "b", 0)]
    assert sorted(r.title for r in entities.searched(w, pages, strict=2).collect()) == ["LOUD ONE", "b"]
    edges = spark.createDataFrame([("g", "u"), ("u", "m"), ("m", "g"), ("g", "u"), (None, "x"), ("g", None)], "group string, member string")
    assert sorted(map(tuple, entities.closure(edges).collect())) == [("g", "g", 3), ("g", "m", 2), ("g", "u", 1), ("m", "g", 1), ("m", "m", 3), ("m", "u", 2), ("u", "g", 2), ("u", "m", 1), ("u", "u", 3)]
    artists = spark.createDataFrame([("m", name("Cold ring")), ("z", name("cold ring"))], f"artist string, name {NAME}")
    wanted = spark.createDataFrame([(1, name("Cold Ring"), "g"), (2, name("Cold Ring"), None), (3, name("nobody"), "g"), (4, None, "g")], f"id int, name {NAME}, group string")
    got = {r.id: (r.artist, r.by) for r in entities.member_lookup(wanted, edges, artists).collect()}
    assert got == {1: ("m", "member"), 2: ("m", "name"), 3: (None, "none"), 4: (None, "none")}
    assert names.score({"eng": "a", "non_eng": None, "romanized": None}, {"eng": "a", "non_eng": None, "romanized": None}) == 100


def test_album_lookup_by_brute_force(spark):
    from tunelake.functions.text import weighted_ratio

    parts = [tuple(r) for r in spark.read.parquet(f"{DATA}/part.parquet").selectExpr("p_partkey", "concat('a', p_size % 3)", "p_name").collect()]
    entries = [p for p in parts if p[0] % 2]
    want = {}
    for key, artist, title in parts:
        if key % 2:
            continue
        here = [e for e in entries if e[1] == artist]
        near = lambda t: sorted((-s, e[0]) for e in here if (s := weighted_ratio(t, e[2])) >= 90)
        if key % 10 == 0 and any(e[0] == key + 1 for e in entries):
            want[key] = (key + 1, "url")
        elif found := near(f"{title} 사랑" if key % 4 == 0 else title):
            want[key] = (found[0][1], "name")
        elif key % 4 == 0 and (found := near(title)):
            want[key] = (found[0][1], "part")
    got = {r.album: (r.entry, r.by) for r in QUERIES["album_lookup"](spark, DATA).collect()}
    assert got == want and {b for _, b in want.values()} == {"url", "name", "part"}


def test_match_scores_by_brute_force(spark):
    parts = [tuple(r) for r in spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey", "p_brand", "p_name").collect()]
    plain = lambda t: {"eng": t, "non_eng": None, "romanized": None, "versions": ()}
    known, want = {}, {}
    for key, _, title in parts:
        if key % 3 == 0:
            own = title if key % 2 == 0 else title + "s"
            for other, brand, name_ in parts:
                if (own, name_) not in known:
                    known[own, name_] = names.score(plain(own), plain(name_))
                if known[own, name_] >= 90:
                    k = (key, "edition" if other % 2 == 0 else "part", brand)
                    want[k] = max(want.get(k, 0), known[own, name_])
    got = {(r.id, r.kind, r.target): r.score for r in QUERIES["match_scores"](spark, DATA).collect()}
    assert got == want
