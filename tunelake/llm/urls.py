"""URL filters: host and path rules found by a sort-merge range join.

Everything is DataFrame expressions.  A host's canonical key is its labels in reverse order, each followed by a dot, so that a
rule's host and all its subdomains are one interval of keys, and intervals are nested or apart.  Urls and the rules' hosts meet
in ranges of keys, sorted once; in each range a sweep keeps the stack of hosts whose intervals are open, one register for
each number of labels: a host is pushed over the last one of its depth, and one whose key isn't a prefix any more is popped.
A range begins with the hosts that are open at its first key.  Of the rules on a url's stack whose path the url's path begins
with, the longest wins: by the length of host and path together, then of the host, then in order of verdict.

Ranges, four for each shuffle partition and ``MOST_RANGES`` at most, are cut at keys of rows drawn by hash, ``DRAWN`` for each.
A key ends with a hash of the row, so a host of any share of all rows is spread over as many ranges as it needs.  Rules may
be any number; those of one host travel as one array.

The host is what lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the path goes from
there to the next ``?``, ``#`` or the end.  A url that is null or has no ``://`` has an empty host and path, and like any other that no
rule fits gets the default verdict.  Repeated urls are judged alike; a repeated rule counts once.  A rule with a null host or
path fits nothing.  A url may have any length.  Other columns aren't read, so their names can't clash.  An empty table of
urls gives an empty result, an empty table of rules the default for all.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common

DRAWN = 8
MOST_RANGES = 4096
#: The rules of the query: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url.cast("string"), F.lit(""))
    part = lambda k: F.regexp_extract(u, r"(?s)\A.*?://([^/?#]*)([^?#]*)", k)
    return lowered(part(1)), part(2)


def key(host: Column) -> Column:
    """The labels in reverse order, each with a dot behind it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def hosts(rules: DataFrame) -> DataFrame:
    """The rules (host, path, verdict) by host: key, depth and an array of rules."""
    own = rules.select(lowered(F.col("host").cast("string")).alias("host"), F.col("path").cast("string").alias("path"), F.col("verdict").cast("string").alias("verdict")).dropna(subset=["host", "path"])
    rule = F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("m"), "verdict", "path", F.concat("host", "path").alias("rule"))
    return own.groupBy("host").agg(F.array_distinct(F.collect_list(rule)).alias("rules")).select(key(F.col("host")).alias("key"), F.size(F.split("host", r"\.", -1)).alias("depth"), "rules")


def cuts(rows: DataFrame, ranges: int) -> list[str]:
    """The keys at which all ranges but the first begin: the row of the least hash of each of ``DRAWN`` x ranges groups, thinned out."""
    h = F.xxhash64("at")
    drawn = rows.groupBy(F.pmod(h, F.lit(DRAWN * ranges)).alias("g")).agg(F.min_by("at", h).alias("at")).select("at").collect()
    at = sorted((r.at for r in drawn), key=str.encode)
    return sorted({at[len(at) * k // ranges] for k in range(1, ranges)} if at else (), key=str.encode)


def range_of(at: Column, starts: list[str]) -> Column:
    """How many of the sorted keys are at or below, by bisection."""
    if not starts:
        return F.lit(0)
    table = F.array(*map(F.lit, starts))

    def step(low: Column, width: int) -> Column:
        return common.let(low, lambda x: F.when(F.coalesce(F.get(table, x + (width - 1)) <= at, F.lit(False)), x + width).otherwise(x))

    return functools.reduce(step, (1 << k for k in range(len(starts).bit_length() - 1, -1, -1)), F.lit(0))


def filter_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """Each url's id, host, path, the rule that decides (null if none fits) and the verdict."""
    spark = urls.sparkSession
    ranges = ranges or min(MOST_RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    host, path = host_and_path(F.col(url))
    rows = urls.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("at", F.concat(key(F.col("host")), F.lit("\0"), F.hex(F.xxhash64("path", F.col("id").cast("string")))))
    own = hosts(rules)
    if not own.head(1):
        return rows.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    own = common.written(own)
    depths = sorted(r.depth for r in own.select("depth").distinct().collect())
    starts = cuts(rows, ranges)
    # a range's own hosts, and before all else those that are open where it begins
    openers = [(k, prefix) for k, s in enumerate(starts, 1) for prefix in _prefixes(s)]
    opened = spark.createDataFrame(openers, "part int, key string").join(own, "key").select("part", F.lit("").alias("at"), "key", "depth", "rules")
    events = own.select(range_of(F.col("key"), starts).alias("part"), F.col("key").alias("at"), "key", "depth", "rules").union(opened)
    names = ["part", "at", "id", "host", "path", "key", "depth", "rules"]
    merged = rows.withColumn("part", range_of(F.col("at"), starts)).unionByName(events, allowMissingColumns=True).select(*names)
    sweep = Window.partitionBy("part").orderBy("at", F.col("depth").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    register = lambda d: F.last(F.when(F.col("depth") == d, F.struct("key", "rules")), ignorenulls=True).over(sweep)
    swept = merged.select("id", "host", "path", F.col("depth").isNull().alias("url"), F.array(*map(register, depths)).alias("stack")).filter("url")
    open_ = F.filter("stack", lambda s: F.coalesce(F.startswith(key(F.col("host")), s["key"]), F.lit(False)))
    fitting = F.flatten(F.transform(open_, lambda s: F.filter(s["rules"], lambda r: F.startswith(F.col("path"), r["path"]))))
    best = swept.select("id", "host", "path", F.array_max(fitting).alias("best"))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _prefixes(at: str) -> list[str]:
    """The keys of the hosts that a sort key's host lies in, itself included."""
    labels = at[: at.rindex("\0") - 1].split(".")
    return [".".join(labels[:k]) + "." for k in range(1, len(labels) + 1)]


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules of the query."""
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


ORACLE = r"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT row_number() OVER () AS n, page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['h', 'p']) AS u FROM pages),
p AS (SELECT n, page_id, translate(u.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, u.p AS path FROM u),
best AS (SELECT n, arg_max(struct_pack(rule := r.host || r.path, verdict := verdict), length(r.host) + length(r.path)) AS b
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY n)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (n)"""
