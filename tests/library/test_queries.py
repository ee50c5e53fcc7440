import duckdb
import pytest

from tunelake import entity_queries, media_queries  # noqa: F401
from tunelake.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, tables, name):
    got, want = QUERIES[name](spark, DATA), tables.sql(SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    assert rows == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def best_titles(rows):
    """Brute force: rows (artist, title, rated, added, key) best first; each stays unless its name matches one that stays."""
    from tunelake.functions import names

    seen, scores = {}, {}

    def near(a, b):
        if (a, b) not in scores:
            scores[a, b] = names.score(*[{"eng": x, "non_eng": None, "romanized": None} for x in (a, b)]) >= 90
        return scores[a, b]

    for artist, title, rated, added, key in sorted(rows, key=lambda r: (not r[2], -r[3].toordinal(), r[4])):
        kept = seen.setdefault(artist, {})
        if not any(near(title.lower(), t) for t in kept.values()):
            kept[key] = title.lower()
    return sorted(k for kept in seen.values() for k in kept)


def test_fuzzy_titles_of_all_tracks(spark):
    from tunelake.sources.catalog import tracks

    rows = tracks(spark, DATA).selectExpr("grandparent_key", "title", "coalesce(user_rating, 0) > 0", "to_date(added_at)", "key").collect()
    assert sorted(r.key for r in QUERIES["dedup_unique_fuzzy"](spark, DATA).collect()) == best_titles(rows)


def test_fuzzy_titles_of_other_first_letters(spark):
    import datetime

    from tunelake.operators.results import ResultSet
    from tunelake.sources.catalog import Catalog

    titles = ["cold ring", "old ring", "Ring Cold", "hot bolt", "the winding mountain road", "winding mountain road", "abcde", "abcdf", "", "$$", "$$ ", "ab", "a b", "xabcdefghij", "abcdefghij", "abcdefghijx", "bcdefghijx", None]
    rows = [(f"{i:02d}{a}", a, t, None if (i + (a or 0)) % 3 else 5, datetime.date(2020, 1, 1 + (7 * i) % 11)) for a in (1, 2, None) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "key string, grandparent_key long, title string, user_rating int, added_at date")
    got = sorted(r.key for r in ResultSet(Catalog(), "track", df).unique_fuzzy().df.collect())
    want = best_titles([(r[1], r[2], bool(r[3]), r[4], r[0]) for r in rows if r[2] is not None])
    assert got == sorted([*want, *(r[0] for r in rows if r[2] is None)])


def test_fuzzy_titles_take_the_joined_tracks_once(spark):
    from tunelake.sources import catalog

    got = QUERIES["dedup_unique_fuzzy"](spark, DATA)
    assert got.inputFiles() and not any(f"{DATA}/" in f for f in got.inputFiles())
    # tracks of some columns are the same rows, and of the tables between the joins the last alone keeps its rows
    before = spark.conf.get(catalog.CLEANUP, None)
    for columns in (("key", "title", "grandparent_key", "user_rating", "added_at"), ("media", "index"), tuple(catalog.READS)):
        some = catalog.tracks(spark, DATA, columns)
        assert tuple(some.columns) == columns and some.schema == catalog.tracks(spark, DATA).select(*columns).schema
        assert some.exceptAll(catalog.tracks(spark, DATA).select(*columns)).isEmpty() and some.count() == catalog.tracks(spark, DATA).count() > 0
    assert spark.conf.get(catalog.CLEANUP, None) == before
    old = catalog.checkpointed(spark.range(100), large=True)
    new = catalog.checkpointed(old.filter("id < 50"), large=True, last=old)
    assert new.count() == 50 and spark.read.parquet(old.inputFiles()[0].rpartition("/")[0]).count() == 0


def test_restore_of_whole_lists(spark, tables):
    from tunelake.functions import names

    parts = tables.sql("SELECT p_partkey, p_brand, p_type, p_name FROM part").fetchall()
    known = {}

    def score(a, b):
        if (a, b) not in known:
            known[a, b] = names.score(*[dict.fromkeys(names.FIELDS) | {"eng": x, "versions": ()} for x in (a, b)])
        return known[a, b]

    best = {}
    for key, artist, album, title in parts:
        if key % 3 == 0:
            found = [(1 if (artist, album) == c[1:3] else 3, -score(title, c[3]), c[0]) for c in parts if c[0] % 3 and score(artist, c[1]) >= 90 and score(album, c[2]) >= 90]
            best[key] = min((x for x in found if x[1] <= -90), default=(0, 0, None))[2]
    here = {p[0] for p in parts if p[0] % 3}
    items = tables.sql("SELECT 'list ' || user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1, CAST(floor(value) AS BIGINT) FROM events").fetchall()
    want = sorted(repr((n, p, k, k in here, None if k in here else best.get(k))) for n, p, k in items)
    got = QUERIES["playlist_restore"](spark, DATA).select("name", "pos", "track_key", "kept", "replacement").collect()
    assert sorted(repr(tuple(r)) for r in got) == want and max(p for _, p, _ in items) >= 20 and any(best.values())


def test_fuzzy_album_candidates(spark, tables):
    from tunelake.functions.text import weighted_ratio

    parts = tables.sql("SELECT p_partkey, p_brand || '/' || p_size, p_name, p_size % 2, p_partkey % 3 FROM part").fetchall()
    # all parts of an artist have one size, so one type
    pairs = [(a, b) for a in parts if a[0] % 2 == 0 for b in parts if b[0] % 2 and a[1] == b[1]]
    near = {(a[0], b[0]): weighted_ratio(a[2], b[2]) >= 90 for a, b in pairs}
    want = {(a[0], b[0], "name" if near[a[0], b[0]] else "number") for a, b in pairs if near[a[0], b[0]] or a[4] == b[4]}
    assert {tuple(r) for r in QUERIES["album_candidates"](spark, DATA).collect()} == want


def test_album_candidates_whose_names_differ(spark):
    from tunelake.operators.matching import album_candidates

    df = spark.createDataFrame([(1, "x", "cold ring"), (2, "x", "old ring"), (3, "x", "hot bolt"), (4, "y", "old ring")], "album long, artist string, name string").selectExpr("*", "'EP' AS type", "CAST(NULL AS INT) AS num", "false AS repackage")
    got = album_candidates(df.filter("album = 1"), df.filter("album > 1").withColumnRenamed("album", "entry"))
    assert [(r.entry, r.by) for r in got.collect()] == [(2, "name")]
