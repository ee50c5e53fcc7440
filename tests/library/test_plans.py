import pytest
from pyspark.sql import functions as F

from tunelake.operators.predicates import where
from tunelake.operators.results import ResultSet
from tunelake import media_queries  # noqa: F401
from tunelake.queries import QUERIES
from tunelake.sources.catalog import Catalog, star

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    got = plan(where(star(spark, DATA, "part"), {"p_name__startswith": "red", "p_type__exists": True}).select("p_partkey"))
    assert "StringStartsWith(p_name,red)" in got and "p_retailprice" not in got.split("== Physical Plan ==")[1]


@pytest.mark.parametrize("name", ["semi_from_album", "nav_tracks_to_artists", "set_difference", "semi_with_genre"])
def test_key_sets_are_semi_joins(spark, name):
    got = plan(QUERIES[name](spark, DATA))
    assert "LeftSemi" in got or "LeftAnti" in got
    assert "CartesianProduct" not in got and "BroadcastNestedLoopJoin" not in got.split("== Physical Plan ==")[1]


def test_pages_keep_the_top_only(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["topk_page"](spark, DATA))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_multiplies_its_sides(spark, name):
    got = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in got and "BroadcastNestedLoopJoin" not in got


def test_playlists_and_shows(spark):
    frames = {
        "track": spark.createDataFrame([(1, "a", ["x"]), (2, "b", []), (3, "c", None)], "key long, title string, moods array<string>"),
        "playlist_item": spark.createDataFrame([("p", 0, 2), ("p", 1, 2), ("q", 0, 3)], "name string, pos long, track_key long"),
        "show": spark.createDataFrame([(1, "Drama"), (2, "News")], "key long, title string"),
        "episode": spark.createDataFrame([(10, 5, 1), (11, 6, 2)], "key long, parent_key long, grandparent_key long"),
    }
    c = Catalog({k: (lambda f=f: f) for k, f in frames.items()})
    keys = lambda rs: [r.key for r in rs.df.orderBy("key").collect()]
    assert keys(ResultSet.new(c, "track", in_playlist="p")) == [2]
    assert keys(ResultSet.new(c, "track", mood="x")) == [1] and keys(ResultSet.new(c, "track", mood__ne="x")) == [2, 3]
    assert keys(ResultSet.new(c, "episode", show__icontains="DRA")) == [10]
    assert c.section("episode") == "tv" and c.find("shows", title="News").count() == 1
    assert [r.n for r in c.sql(spark, "SELECT count(*) AS n FROM track WHERE key > :k", k=1).collect()] == [2]
    assert ResultSet.new(c, "track").items().select(F.col("item.title")).count() == 3
