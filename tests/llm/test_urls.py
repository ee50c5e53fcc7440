import collections
import itertools
import re

import duckdb
import pytest

from tunelake.llm import urls

SCHEMA = "page_id long, url string, html string, key string, at string, part int, host string, path string"
RULES = "host string, path string, verdict string"


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def plain(rows, rules, default="allow"):
    """Brute force: every url against every rule."""
    out = collections.Counter()
    for page, url in rows:
        host, path = parts(url)
        fit = [(len(h) + len(p), len(h), v, h.lower() + p) for h, p, v in rules if h is not None and p is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        best = max(fit, default=(0, 0, default, None))
        out[page, host, path, best[3], best[2]] += 1
    return out


HOSTS = ["com", "example.com", "www.example.com", "WWW.Example.com", "xexample.com", "a.b.c.example.com", "net", "b.net", "example.net", "co", "com.net", "", ".com", "example.com.", "a..com", "example.com:80", "u@example.com", "com.example", "é.com", "example-x.com", "m.example.com", "example!.com", "exa\x01mple.com"]
PATHS = ["", "/", "/en/", "/en", "/en/x", "/EN/x", "/es/1", "/fr/", "/fr/a/b?q=/en/", "/x#/en/", "?/en/", "/en/http://net/es/", "/de//"]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [f"http://{h}{p}" for h, p in itertools.product(HOSTS, PATHS)]
    rows += [None, "", "no scheme", "example.com/en/", "://", "http://", "a\nb://example.com/en/\nx", "://x.net/es/", "mailto:a@b.net", "http://example.com/en/" + "x" * 100_000, "y" * 100_000, "http://" + "a." * 2000 + "com/"]
    return [(i % 300, u) for i, u in enumerate(rows * 2)]


def frame(spark, rows):
    return spark.createDataFrame([(i, u, "h", "k", "a", 1, "x", "y") for i, u in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("ranges", [1, 2, 7, 64, None])
def test_urls_by_brute_force(spark, pages, ranges):
    got = urls.filter_urls(frame(spark, pages), urls.rule_table(spark), ranges=ranges)
    assert collections.Counter(map(tuple, got.collect())) == plain(pages, urls.RULES)


def test_nested_rules(spark, pages):
    rules = [(h, p, v) for (h, p), v in zip(itertools.product(HOSTS, ["", "/", "/e", "/en/", "/fr/a"]), itertools.cycle(["allow", "block", "review"]))]
    rules += [("example.com", "/en/", "zap"), ("com", "/", "allow"), (None, "/", "no"), ("net", None, "no"), ("c.example.com", "/en/x", "deep"), ("b.c.example.com", "", "deeper")]
    table = spark.createDataFrame(rules, RULES)
    for ranges in (1, 13):
        got = urls.filter_urls(frame(spark, pages), table, default="block", ranges=ranges)
        assert collections.Counter(map(tuple, got.collect())) == plain(pages, rules, "block")


def test_no_rules_or_no_urls(spark, pages):
    none = spark.createDataFrame([], RULES)
    assert collections.Counter(map(tuple, urls.filter_urls(frame(spark, pages), none).collect())) == plain(pages, [])
    assert urls.filter_urls(frame(spark, []), urls.rule_table(spark)).count() == 0


def test_one_host_in_many_ranges(spark):
    """A host that most rows share, and one url that many rows have, are spread over ranges."""
    rows = [(i, "http://www.example.com/en/" + ("same" if i % 2 else str(i))) for i in range(4000)] + [(-i, f"http://h{i}.net/es/") for i in range(1, 100)]
    got = urls.filter_urls(frame(spark, rows), urls.rule_table(spark), ranges=16)
    assert collections.Counter(map(tuple, got.collect())) == plain(rows, urls.RULES)
    keyed = frame(spark, rows).selectExpr("concat(page_id, url) AS at")
    starts = urls.cuts(keyed, 16)
    sizes = [r["count"] for r in keyed.groupBy(urls.range_of(keyed.at, starts)).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * len(rows) / 16


def test_urls_by_sql(spark, pages):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", pages)
    rel = con.sql(urls.ORACLE)
    got = urls.filter_urls(frame(spark, pages), urls.rule_table(spark)).select(*rel.columns)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(rel.fetchall())
