"""Queries on tables as larger scales have them: artists without files, and many copies of few names."""

import duckdb
import pytest

from tunelake import entity_queries, media_queries  # noqa: F401
from tunelake.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def test_folders_of_artists_without_files(spark, tmp_path):
    """Where none of an artist's orders has lines, its own folder is no album's."""
    con = duckdb.connect()
    con.sql(f"COPY (FROM '{DATA}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    con.sql(f"COPY (FROM '{DATA}/lineitem.parquet' WHERE l_orderkey NOT IN (SELECT o_orderkey FROM '{DATA}/orders.parquet' WHERE o_custkey % 9 = 1)) TO '{tmp_path}/lineitem.parquet'")
    for t in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    want = sorted(con.sql(f"SELECT folder, n FROM ({SQL['album_folders']})").fetchall())
    assert sorted(tuple(r) for r in QUERIES["album_folders"](spark, str(tmp_path)).select("folder", "n").collect()) == want


def _copies(spark, key, odd, n=300):
    columns = [f"id * 2 + {odd} AS {key}", "'a' AS artist", "'cold ring' AS name", "'EP' AS type", "1 AS num", "false AS repackage", "string(null) AS url"]
    return spark.range(n).selectExpr(*columns)


def test_copies_of_albums_are_paired_once(spark):
    from tunelake.operators import matching

    files, entries = _copies(spark, "album", 0), _copies(spark, "entry", 1)
    assert matching._candidate_classes(files, entries, 90).count() == 1
    assert {(r.entry, r.by) for r in matching.album_lookup(files, entries).collect()} == {(1, "name")}
    got = matching.album_candidates(files.limit(20), entries.limit(30)).collect()
    assert len(got) == 600 and {(r.score, r.by) for r in got} == {(100, "name")}


def test_copies_of_tracks_are_paired_once(spark):
    from tunelake.operators import matching

    t = spark.range(600).selectExpr("id AS key", "1 AS artist_key", "int(null) AS album_key", "'Seal' AS artist", "'Zed' AS album", "IF(id % 50 = 49, 'Cold Rings', 'Cold Ring') AS title")
    gone, here = t.filter("key % 2 = 1").withColumnRenamed("key", "track_key"), t.filter("key % 2 = 0")
    assert matching._tiers(gone, here, 90).count() == 2
    assert {(r.replacement, r.score == 100, r.priority) for r in matching.best_replacements(gone, here).collect()} == {(0, True, 2), (0, False, 2)}
    assert matching.replacement_tiers(gone, here).count() == 300 * 300


@pytest.mark.parametrize("query", ["artist_lookup", "member_lookup", "album_type_order", "artist_lists"])
def test_shared_names_match_their_sql(spark, tmp_path, query):
    """Three copies of all tables with keys of their own: names occur three times as often."""
    con = duckdb.connect()
    keys = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}
    for t in ("region", "nation", *keys):
        own = f"FROM '{DATA}/{t}.parquet'"
        if t in keys:
            own = f"SELECT * EXCLUDE (i) REPLACE ({keys[t]} + i * 1000000 AS {keys[t]}) {own}, range(3) r(i)"
        con.sql(f"COPY ({own}) TO '{tmp_path}/{t}.parquet'")
        con.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    got, want = QUERIES[query](spark, str(tmp_path)), con.sql(SQL[query])
    columns = sorted(got.columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))


def test_long_chains_of_editions_take_no_rounds(spark):
    """Each edition is laid over the one before: their lists are found by one exchange, without jobs before the result's."""
    from tunelake.operators import editions

    e = spark.range(1, 301).selectExpr("id AS edition", "1 AS album", "id AS pos", "boolean(null) AS side")
    t = spark.range(1, 301).selectExpr("id AS edition", "int(2 + id % 3 * 2) AS num", "concat('t', id) AS title")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chains", "chains")
    found = editions.continuation(e, t)
    assert not tracker.getJobIdsForGroup("chains")
    spark.sparkContext.setJobGroup("other", "other")
    got = {(r.edition, r.num): (r.source, r.by) for r in found.collect()}
    assert len(got) == 897 and got[1, 4] == (1, "own") and {got[300, n][0] for n in (2, 4, 6)} == {298, 299, 300}


def test_files_and_tracks_meet_in_one_exchange(spark):
    """However an album's way is chosen, its files are exchanged by album, its tracks by edition, and both once together."""
    plan = QUERIES["zip_by_evidence"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 5
