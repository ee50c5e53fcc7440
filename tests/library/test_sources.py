import pytest
from pyspark.sql import functions as F

from tunelake.operators.predicates import where
from tunelake.operators.results import ResultSet
from tunelake.operators import pages, tags
from tunelake.sources import playlist_files
from tunelake.sources.catalog import from_star
from tunelake.streaming import ratings

DATA = "/root/testdata/sf0.001"


def test_files_round_trip(spark, tmp_path):
    items = from_star(spark, DATA).frame("playlist_items").select("name", "pos", "track_key")
    want = sorted(map(tuple, items.collect()))
    playlist_files.write_json(items, f"{tmp_path}/json")
    playlist_files.write_xml(items, f"{tmp_path}/xml")
    assert sorted(map(tuple, playlist_files.read_json(spark, f"{tmp_path}/json").collect())) == want
    assert sorted(map(tuple, playlist_files.read_xml(spark, f"{tmp_path}/xml").collect())) == want
    found = playlist_files.files(spark, f"{tmp_path}/json", "*.gz")
    assert found.count() > 0 and found.filter("length(sha256) <> 64").count() == 0


def test_missing_attributes(spark):
    df = spark.createDataFrame([(1, None, []), (2, "", ["a"]), (3, "x", ["a", "b"]), (4, "7", None)], "key int, t string, g array<string>")
    keys = lambda **f: [r.key for r in where(df, f).orderBy("key").collect()]
    assert keys(t="") == [1, 2] and keys(t__ne="x") == [1, 2, 4] and keys(t__gt=3) == [4] and keys(t__exists=False) == [1]
    assert keys(g__ne="a") == [1, 4] and keys(g="b") == [3] and keys(G__not__contains="b") == [1, 2, 4] and keys(g__notset=True) == [1, 4]
    assert keys(nothing__ne=1) == [1, 2, 3, 4] and keys(nothing="x") == [] and keys(t__inot_in_any=["x1", "y"]) == [1, 4]


def test_result_sets_dont_mix(spark):
    c = from_star(spark, DATA)
    with pytest.raises(ValueError):
        ResultSet.new(c, "track") + ResultSet.new(c, "album")
    with pytest.raises(TypeError):
        ResultSet.new(c, "track") - 3
    with pytest.raises(ValueError):
        ResultSet.new(c, "tracks").page(0)
    with pytest.raises(Exception, match="unknown mood: nowhere"):
        ResultSet.new(c, "track", mood="nowhere").df.collect()  # known when the rows are read


def test_tags_of_files(spark):
    files = spark.createDataFrame([("a", "id3", {"TIT2:x": ["t"], "WXYZ": ["u"]}), ("b", "vorbis", {"TITLE": ["v"]})], "path string, tag_type string, tags map<string,array<string>>")
    assert sorted(map(tuple, tags.explode_tags(files).collect()), key=str) == [("a", "TIT2", "title", "t"), ("a", "WXYZ", None, "u"), ("b", "TITLE", "title", "v")]
    plan = tags.transcode_plan(spark.createDataFrame([("a", True, 900), ("b", False, 320), ("c", False, 128)], "path string, lossless boolean, bitrate int"))
    assert dict(map(tuple, plan.collect())) == {"a": "transcode", "b": "transcode", "c": "copy"}


def test_page_rows(spark):
    html = '<p><a href="/x"> A <b>b</b></a></p><ul><li>"Jump (Japanese ver.)" - 3:57</li><li>Other</li></ul>'
    df = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    assert [tuple(r) for r in pages.links(df).collect()] == [(1, "/x", "A b")]
    assert [tuple(r) for r in pages.list_tracks(df).orderBy("num").collect()] == [(1, 1, "Jump (Japanese ver.)", "3:57"), (1, 2, "Other", None)]
    found = spark.createDataFrame([("q", "A"), ("q", "A (disambiguation)"), ("q", "B"), ("r", "C"), ("r", "D")], "query string, link string")
    got = pages.disambiguate(found, spark.createDataFrame([("B",)], "link string"))
    assert sorted(map(tuple, got.collect())) == [("q", "B", False), ("r", "C", True), ("r", "D", True)]


def test_rating_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 4), ("b", 5), ("b", 5), ("c", None)], "path string, file_stars int").withColumn("at", F.current_timestamp())
    rows.write.parquet(f"{tmp_path}/in")
    tracks = spark.createDataFrame([("a", 4), ("b", 6), ("c", 1)], "path string, user_rating int")
    plan = ratings.run_plan(ratings.changes(spark, f"{tmp_path}/in"), tracks, f"{tmp_path}/out", f"{tmp_path}/ck")
    plan.awaitTermination(120)
    assert [tuple(r)[:3] for r in spark.read.parquet(f"{tmp_path}/out").select("path", "file_stars", "rating").collect()] == [("b", 5, 6)]


def test_playlists_by_content_and_in_archives(spark, tmp_path):
    import io
    import tarfile

    import pytest

    items = spark.createDataFrame([("p", 0, 3), ("p", 1, 2), ("q", 0, 3)], "name string, pos long, track_key long")
    playlist_files.write_json(items, f"{tmp_path}/j")
    playlist_files.write_xml(items, f"{tmp_path}/x", "none")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(items)
    assert playlist_files.kind_of(spark, f"{tmp_path}/j") == "json" and playlist_files.kind_of(spark, f"{tmp_path}/x") == "xml"
    assert rows(playlist_files.read_any(spark, f"{tmp_path}/j")) == want == rows(playlist_files.read_any(spark, f"{tmp_path}/x"))
    with tarfile.open(f"{tmp_path}/lists.tgz", "w:gz") as tar:
        for r in playlist_files.as_rows(items).toJSON().collect():
            data = r.encode()
            info = tarfile.TarInfo(f"{len(data)}.json")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    assert rows(playlist_files.read_archives(spark, f"{tmp_path}/lists.tgz")) == want
    spark.createDataFrame([("plain",)], "value string").write.text(f"{tmp_path}/t")
    with pytest.raises(ValueError):
        playlist_files.kind_of(spark, f"{tmp_path}/t")
