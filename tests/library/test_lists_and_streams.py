"""Artist lists, the dictionary against brute force, keyed state with timers."""

import datetime
import itertools

from pyspark.sql import functions as F

from tunelake.functions import lists, spelling
from tunelake.streaming import ratings


def rows(text):
    return {(e, o, g, h) for _, e, o, g, h, _ in lists.entries(text)}


def test_artist_lists():
    assert rows("88rising, Rich Brian, 청하 (CHUNG HA)") == {("88rising", None, None, None), ("Rich Brian", None, None, None), ("CHUNG HA", "청하", None, None)}
    assert rows("기희현, 전소미, 최유정, 김청하 (Heehyun (DIA), Somi, Yoo Jung, Chungha)") == {("Heehyun", "기희현", "DIA", None), ("Somi", "전소미", None, None), ("Yoo Jung", "최유정", None, None), ("Chungha", "김청하", None, None)}
    assert rows("예성 (YESUNG), 청하 (CHUNG HA)") == {("YESUNG", "예성", None, None), ("CHUNG HA", "청하", None, None)}
    assert rows("지민 [Jimin (AOA)]") == rows("Jimin (지민) (AOA)") == {("Jimin", "지민", "AOA", None)}
    assert rows("딘딘 & 민아 (DinDin & Minah)") == {("DinDin", "딘딘", None, None), ("Minah", "민아", None, None)}
    assert rows("손동운 (하이라이트) X 서령 (공원소녀) [Son Dongwoon (Highlight) X Seoryoung (GWSN)]") == {("Son Dongwoon", "손동운", "Highlight", "하이라이트"), ("Seoryoung", "서령", "GWSN", "공원소녀")}
    assert rows("주헌 (몬스타엑스) (JooHeon (MONSTA X))") == {("JooHeon", "주헌", "MONSTA X", "몬스타엑스")}
    assert rows("JooHeon (MONSTA X)") == {("JooHeon", None, "MONSTA X", None)}
    assert lists.entries("Girls (A, B & C)") == [(1, "Girls", None, None, None, ["A", "B", "C"])]
    assert lists.entries(None) == lists.entries("") == lists.entries("  ") == []
    assert [r[1] for r in lists.entries("a (b, c) (((, d")] and lists.entries("()")


def test_lists_in_a_lateral_join(spark):
    df = spark.createDataFrame([(1, "a, b"), (2, None), (3, "c")], "id int, text string")
    name = lists.register(spark)
    got = spark.sql(f"SELECT id, pos, eng FROM {{df}} r, LATERAL {name}(r.text)", df=df).collect()
    assert sorted(map(tuple, got)) == [(1, 1, "a"), (1, 2, "b"), (3, 1, "c")]


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def test_all_entries_within_two_edits(spark):
    """Every word against every entry: short ones, long ones that differ before and behind the indexed letters."""
    entries = ["a", "ab", "abc", "cold", "colder", "ring", "abcdefghij", "abcdefghik", "mountainside", "mountainsides", "éclair", "the"]
    some = ["".join(p) for n in (1, 2, 3) for p in itertools.product("abc", repeat=n)] + ["xcold", "clod", "colde", "abcdefgh", "xxabcdefghij", "abcdefghijxx", "mountanside", "ountainsid", "eclair", "zzzzzzzz", "th", "", "abxcdefgyhij"]
    known = spark.createDataFrame([(w, 10 + k) for k, w in enumerate(entries)], "word string, n long")
    got = {r.word: (r.entry, r.distance) for r in spelling.nearest(spark.createDataFrame([(w,) for w in [*some, *some[:3]]], "word string"), known).collect()}
    for w in some:
        best = min(((d, -(10 + k), e) for k, e in enumerate(entries) if (d := edits(w, e)) <= 2), default=None)
        assert got[w] == ((best[2], best[0]) if best else (None, None)), w
    texts = spark.createDataFrame([(1, "The cold ring"), (2, "cald rong zzzzzzzz"), (3, None), (4, "  "), (None, "the")], "doc_id long, text string")
    share = {r.doc_id: r.share for r in spelling.english_share(texts, known, "doc_id").collect()}
    assert share == {1: 1.0, 2: 6 / 16, 3: 0.0, 4: 0.0, None: 1.0}
    learned = spelling.dictionary(spark.createDataFrame([("Go, go; stop-go",), (None,)], "text string"), least=2).collect()
    assert [(r.word, r.n) for r in learned] == [("go", 3)]


def test_words_of_one_beginning_do_not_all_meet(spark):
    """Few pairs share a key where all words begin alike, and none that is near is lost: marks, long words, letters of any script."""
    ends = ["".join(p) for p in itertools.product(("ka", "lo", "mi", "nu", "re"), repeat=3)]
    entries = [f"thingtion{e}" for e in ends[::2]] + [f"{'abcdefghijklm' * 2}{e}" for e in ends[:9]] + ["한국어", "x", "yz", "wv"]
    some = [f"thingtion{e}" for e in ends[1::2]] + [f"thingtion{e}##" for e in ends[:20]] + [f"#{'abcdefghijklm' * 2}{e}" for e in ends[:12]] + ["한국", "日本", "a", "zy", "$$$", "#y#", "yz###"]
    known = spark.createDataFrame([(w, 10 + k % 3) for k, w in enumerate(entries)], "word string, n long")
    found = spark.createDataFrame([(w,) for w in some], "word string")
    got = {r.word: (r.entry, r.distance) for r in spelling.nearest(found, known).collect()}
    for w in some:
        best = min(((d, -(10 + k % 3), e) for k, e in enumerate(entries) if (d := edits(w, e)) <= 2), default=None)
        assert got[w] == ((best[2], best[0]) if best else (None, None)), w
    left, right = (spelling.neighbourhoods(x.filter("word LIKE 'thingtion%'").select("word")) for x in (found, known))
    assert left.join(right.withColumnRenamed("word", "entry"), "k").select("word", "entry").distinct().count() < left.select("word").distinct().count() * right.select("word").distinct().count() / 4


def test_last_ratings_expire_and_late_rows_are_dropped(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h, minutes=m)
    schema = "path string, file_stars int, at timestamp"
    folder, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        ratings.last_ratings(spark.readStream.schema(schema).parquet(folder), sink, state, "6 hours", "1 hour").awaitTermination()
        return {r.path: (r.file_stars, r.at, r.live) for r in ratings.settled(spark.read.schema(ratings.LAST).parquet(sink)).collect()}

    assert run([("a", 3, at(1)), ("a", 4, at(2)), ("b", 5, at(4)), ("a", 1, at(0))]) == {"a": (4, at(2), True), "b": (5, at(4), True)}
    # an older row within the lateness changes nothing, one beyond it is dropped, a newer one counts and lets a expire
    got = run([("b", 1, at(3, 30)), ("c", 2, at(0, 30)), ("b", 2, at(10))])
    assert got == {"a": (4, at(2), False), "b": (2, at(10), True)}
    assert run([("a", 9, at(11))]) == {"a": (9, at(11), True), "b": (2, at(10), True)}
    assert spark.read.schema(ratings.LAST).parquet(sink).filter(F.col("path") == "c").count() == 0
