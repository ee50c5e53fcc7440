"""Queries of editions and entities: continued track lists, file zips, disambiguation, folded names, repeated searches, members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tunelake.functions import lists, names, scalar, spelling
from tunelake.operators import editions, entities, matching, tags
from tunelake.operators.results import ResultSet
from tunelake.queries import TRACK, query
from tunelake.sources import catalog
from tunelake.sources.catalog import star
from tunelake.streaming import ratings

#: Orders as editions of a customer's album, each with some of the numbers 1 to 27; every eleventh is a record's side.
EDITIONS = """e AS (SELECT o_custkey AS album, o_orderkey AS edition, o_orderkey AS pos, o_orderkey % 11 = 0 AS side FROM orders),
  t AS (SELECT l_orderkey AS edition, CASE l_orderkey % 5 WHEN 1 THEN 7 WHEN 2 THEN 3 WHEN 3 THEN 20 ELSE 0 END + l_linenumber AS num, min(l_partkey) AS title FROM lineitem GROUP BY ALL),
  ed AS (SELECT *, row_number() OVER (PARTITION BY album ORDER BY pos) AS i FROM e JOIN (SELECT edition, min(num) AS f, max(num) AS l FROM t GROUP BY 1) USING (edition))"""


def _editions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = star(spark, d, "orders").selectExpr("o_custkey AS album", "o_orderkey AS edition", "o_orderkey AS pos", "o_orderkey % 11 = 0 AS side")
    t = star(spark, d, "lineitem").selectExpr("l_orderkey AS edition", "CASE l_orderkey % 5 WHEN 1 THEN 7 WHEN 2 THEN 3 WHEN 3 THEN 20 ELSE 0 END + l_linenumber AS num", "l_partkey")
    return e, t.groupBy("edition", "num").agg(F.min("l_partkey").alias("title"))


@query(
    """SELECT edition, num, arg_min(title, d) AS title, arg_min(source, d) AS source, any_value("by") AS "by" FROM chain JOIN t ON t.edition = source JOIN way w ON w.e = edition
  GROUP BY edition, num""".replace("JOIN t ON t.edition = source", "JOIN (SELECT edition AS te, num, title FROM t) ON te = source"),
    "RECURSIVE " + EDITIONS,
    """walk AS (SELECT album, i, edition, [l] AS tops, [edition] AS eds, NULL::BIGINT AS parent, 'own' AS "by" FROM ed WHERE i = 1
  UNION ALL SELECT album, i, edition, list_append(tops, CASE WHEN "by" = 'overlaid' THEN greatest(l, tops[-1]) ELSE l END), list_append(eds, edition), parent, "by" FROM (
    SELECT w.album, ed.i, ed.edition, tops, eds, ed.l, CASE WHEN f <= 1 OR side THEN NULL WHEN list_contains(tops, f - 1) THEN eds[len(tops) + 1 - list_position(list_reverse(tops), f - 1)] ELSE eds[-1] END AS parent,
      CASE WHEN f <= 1 OR side THEN 'own' WHEN list_contains(tops, f - 1) THEN 'continued' ELSE 'overlaid' END AS "by" FROM walk w JOIN ed ON ed.album = w.album AND ed.i = w.i + 1))""",
    'way AS (SELECT edition AS e, parent, "by" FROM walk)',
    "chain AS (SELECT e AS edition, e AS source, 0 AS d FROM way UNION ALL SELECT c.edition, w.parent, d + 1 FROM chain c JOIN way w ON w.e = c.source WHERE w.parent IS NOT NULL)",
)
def track_continuation(spark: SparkSession, d: str) -> DataFrame:
    """Whole track lists of all editions: continued, laid over the one before, or on their own."""
    return editions.continuation(*_editions(spark, d)).select("edition", F.col("num").cast("int"), "title", "source", "by")


#: Orders as albums of files (some numbers repeat) and as editions of one or two parts, whose counts depend on the order's number.
ZIP = """f AS (SELECT l_orderkey AS album, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS path, 1 + l_suppkey % 2 * CAST(l_orderkey % 4 = 1 AS INTEGER) AS disk,
    CASE WHEN l_orderkey % 3 = 0 THEN CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) ELSE l_linenumber END AS num FROM lineitem),
  c AS (SELECT album, count(*) AS n, CASE album % 7 WHEN 0 THEN count(*) WHEN 1 THEN greatest(count(*) - 1, 1) WHEN 2 THEN count(*) + 3 WHEN 3 THEN count(*) + 1 WHEN 4 THEN 7 WHEN 5 THEN 2 ELSE 1 END AS n1,
    CASE WHEN album % 2 = 1 THEN CASE album % 7 WHEN 5 THEN greatest(count(*) - 2, 1) WHEN 1 THEN 7 ELSE 4 END ELSE 0 END AS n2 FROM f GROUP BY album),
  t AS (SELECT album AS edition, 1 AS part, unnest(range(1, n1 + 1)) AS num FROM c UNION ALL SELECT album, 2, unnest(range(1, n2 + 1)) FROM c),
  ta AS (SELECT edition, part, CAST(num AS INTEGER) AS num, (num + edition) % 4 <> 3 AS available FROM t)"""


def _zip(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    line = star(spark, d, "lineitem").selectExpr("l_orderkey AS album", "l_partkey", "l_suppkey", "l_linenumber")
    # numbered first, so that keys and not paths are exchanged
    line = line.withColumn("nth", F.row_number().over(Window.partitionBy("album").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    f = line.selectExpr("album", "concat_ws('-', l_partkey, l_suppkey, l_linenumber) AS path", "1 + int(l_suppkey % 2) * int(album % 4 = 1) AS disk", "IF(album % 3 = 0, nth, l_linenumber) AS num")
    c = f.groupBy("album").agg(F.count("*").cast("int").alias("n"))
    n1 = "CASE album % 7 WHEN 0 THEN n WHEN 1 THEN greatest(n - 1, 1) WHEN 2 THEN n + 3 WHEN 3 THEN n + 1 WHEN 4 THEN 7 WHEN 5 THEN 2 ELSE 1 END"
    n2 = "CASE WHEN album % 2 = 1 THEN CASE album % 7 WHEN 5 THEN greatest(n - 2, 1) WHEN 1 THEN 7 ELSE 4 END ELSE 0 END"
    t = c.selectExpr("album AS edition", f"explode(array(named_struct('part', 1, 'n', {n1}), named_struct('part', 2, 'n', {n2}))) AS p").filter("p.n > 0").selectExpr("edition", "p.part", "explode(sequence(1, p.n)) AS num")
    return c.selectExpr("album", "album AS edition", "1 AS part"), f, t.selectExpr("*", "(num + edition) % 4 <> 3 AS available")


@query(
    """SELECT album, path, part, nth, "by" FROM (
  SELECT x.album, path, "by", CASE "by" WHEN 'position' THEN (0, at_own) WHEN 'disks' THEN (0, at_all) WHEN 'number' THEN (0, num) WHEN 'number of available' THEN (0, num) ELSE (disk, num) END AS k FROM ff x JOIN way USING (album)) x
  JOIN (SELECT edition AS album, part, nth, unnest([('position', (0, CASE WHEN part = 1 THEN nth END)), ('number', (0, CASE WHEN part = 1 THEN nth END)), ('number of available', (0, CASE WHEN part = 1 AND available THEN nav END)), ('disks', (0, nall)),
    ('disk and number', (part, nth)), ('disk and number of available', (part, CASE WHEN available THEN nth END))]) AS w FROM tt) y ON y.album = x.album AND y.w[1] = x."by" AND y.w[2] = x.k""".replace("SELECT album, path", "SELECT x.album, path"),
    ZIP,
    """tt AS (SELECT *, CAST(row_number() OVER (PARTITION BY edition, part ORDER BY num) AS INTEGER) AS nth, CAST(count(*) FILTER (available) OVER (PARTITION BY edition, part ORDER BY num) AS INTEGER) AS nav, CAST(row_number() OVER (PARTITION BY edition ORDER BY part, num) AS INTEGER) AS nall FROM ta)""",
    """ff AS (SELECT *, CAST(row_number() OVER (PARTITION BY album ORDER BY num, path) AS INTEGER) AS at_own, CAST(row_number() OVER (PARTITION BY album ORDER BY disk, num, path) AS INTEGER) AS at_all FROM f)""",
    """met AS (SELECT album, count(*) AS m, count(*) FILTER (available) AS ma FROM ff JOIN tt ON tt.edition = album AND tt.part = disk AND tt.nth = ff.num GROUP BY album)""",
    """facts AS (SELECT c.album, c.n, n1, n2, (SELECT count(*) FILTER (available) FROM ta WHERE edition = c.album AND part = 1) AS a1, (SELECT count(*) FILTER (available) FROM ta WHERE edition = c.album) AS aa,
    coalesce(m, 0) AS m, coalesce(ma, 0) AS ma, d, lo, hi FROM c LEFT JOIN met USING (album) JOIN (SELECT album, count(DISTINCT num) AS d, min(num) AS lo, max(num) AS hi FROM f GROUP BY album) USING (album))""",
    """way AS (SELECT album, CASE WHEN n = n1 THEN 'position' WHEN n > n1 AND n2 > 0 THEN CASE WHEN n1 + n2 = n THEN 'disks' WHEN aa = n AND ma = n THEN 'disk and number of available' WHEN m = n THEN 'disk and number' ELSE 'disks' END
    WHEN a1 = n AND d = n AND lo >= 1 AND hi <= a1 THEN 'number of available' WHEN d = n AND lo >= 1 AND hi <= n1 THEN 'number' ELSE 'position' END AS "by" FROM facts)""",
)
def zip_by_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Which track each file is, with the way that each album's counts and numbers chose."""
    return editions.zip_files(*_zip(spark, d))


#: Parts as pages that were searched for, line items as the links of their disambiguation pages.
AMBIGUOUS = """q AS (SELECT p_partkey AS query, CASE WHEN p_partkey % 6 <> 5 THEN 'name ' || p_partkey END AS eng, CASE WHEN p_partkey % 4 IN (1, 3) THEN '가나' || p_partkey END AS non, p_partkey % 3 = 0 AS known, CASE WHEN p_partkey % 2 = 0 THEN ['g' || p_partkey % 5] ELSE NULL END AS groups FROM part),
  n AS (SELECT *, eng IS NOT NULL OR non IS NOT NULL AS named FROM q),
  c AS (SELECT DISTINCT l_partkey AS query, CASE WHEN l_suppkey % 9 = 0 THEN 'Category:' ELSE '' END || l_suppkey AS link, CASE WHEN l_suppkey % 5 < 3 THEN 'NAME ' || l_partkey ELSE 'quite another ' || l_suppkey END AS c_eng,
    CASE l_suppkey % 3 WHEN 0 THEN '가나' || l_partkey WHEN 1 THEN '다른말' || l_suppkey END AS c_non, CASE WHEN l_suppkey % 4 > 0 THEN ['G' || l_suppkey % 5, 'x'] END AS c_groups FROM lineitem WHERE l_partkey % 7 > 0 OR l_suppkey % 10 = 0)"""
#: Names of equal English spelling, or of one in another script where both have it, match; the rest don't come near.
SAME = "coalesce(lower({e}) = lower({f}) OR {n} = {m}, false)"


@query(
    """SELECT query, CASE WHEN stage = 'none' THEN NULL ELSE link END AS link, stage, ambiguous FROM (
  SELECT query, link, stage, NOT decided AS ambiguous FROM p JOIN ends USING (query) WHERE p.passed[k + 1]
  UNION ALL SELECT query, NULL, 'none', true FROM q WHERE query NOT IN (SELECT query FROM c))""",
    AMBIGUOUS,
    f"""t AS (SELECT c.query, link, known AND named AS known, named, eng IS NOT NULL AND non IS NOT NULL AS two,
    NOT (known AND named) OR {SAME.format(e="eng", f="c_eng", n="non", m="c_non")} AND NOT coalesce(len(groups) > 0 AND len(c_groups) > 0 AND NOT list_has_any(list_transform(c_groups, lambda g: lower(g)), groups) AND NOT starts_with(lower(link), 'category:'), false) AS fits,
    {SAME.format(e="eng", f="c_eng", n="non", m="c_non")} AS by_name, coalesce(non = c_non, false) AS by_native FROM c JOIN n USING (query))""",
    "p AS (SELECT query, link, known, named, two, [true, fits, fits AND by_name, fits AND by_name AND by_native] AS passed FROM t)",
    "k AS (SELECT query, any_value(known) AS known, any_value(named) AS named, any_value(two) AS two, count(*) AS n0, count(*) FILTER (passed[2]) AS n1, count(*) FILTER (passed[3]) AS n2, count(*) FILTER (passed[4]) AS n3 FROM p GROUP BY query)",
    """ends AS (SELECT query, e[1] AS stage, e[2] AS k, e[3] AS decided FROM (SELECT query, CASE WHEN n0 = 1 THEN ('only', 0, true) WHEN known AND n1 = 1 THEN ('entity', 1, true) WHEN known AND n1 = 0 THEN ('entity', 0, false)
    WHEN NOT named THEN CASE WHEN known THEN ('entity', 1, false) ELSE ('only', 0, false) END WHEN n2 = 1 THEN ('name', 2, true) WHEN n2 = 0 THEN ('name', 1, false) WHEN NOT two THEN ('name', 2, false)
    WHEN n3 = 1 THEN ('native', 3, true) WHEN n3 = 0 THEN ('native', 2, false) ELSE ('native', 3, false) END AS e FROM k))""",
)
def disambiguation_staged(spark: SparkSession, d: str) -> DataFrame:
    """All links of all disambiguation pages, narrowed stage by stage."""
    both = lambda eng, non: f"IF({eng} IS NULL AND {non} IS NULL, NULL, named_struct('eng', {eng}, 'non_eng', {non}, 'romanized', string(null), 'lit', string(null), 'versions', cast(array() AS {names.VERSIONS})))"
    name = both("IF(p_partkey % 6 <> 5, concat('name ', p_partkey), NULL)", "IF(p_partkey % 4 IN (1, 3), concat('가나', p_partkey), NULL)")
    q = star(spark, d, "part").selectExpr("p_partkey AS query", f"{name} AS name", f"IF(p_partkey % 3 = 0, {name}, NULL) AS entity", "IF(p_partkey % 2 = 0, array(concat('g', p_partkey % 5)), NULL) AS groups")
    other = both("IF(l_suppkey % 5 < 3, concat('NAME ', l_partkey), concat('quite another ', l_suppkey))", "CASE l_suppkey % 3 WHEN 0 THEN concat('가나', l_partkey) WHEN 1 THEN concat('다른말', l_suppkey) END")
    c = star(spark, d, "lineitem").filter("l_partkey % 7 > 0 OR l_suppkey % 10 = 0").selectExpr("l_partkey AS query", "concat(IF(l_suppkey % 9 = 0, 'Category:', ''), l_suppkey) AS link", f"{other} AS name", "IF(l_suppkey % 4 > 0, array(concat('G', l_suppkey % 5), 'x'), NULL) AS groups")

    def same(a, b):  # the SQL's rule for names; the operator's own is the fuzzy score
        return F.coalesce((F.lower(a["eng"]) == F.lower(b["eng"])) | (a["non_eng"] == b["non_eng"]), F.coalesce(F.lower(a["eng"]) == F.lower(b["eng"]), F.lit(False)) | F.coalesce(a["non_eng"] == b["non_eng"], F.lit(False)))

    return entities.disambiguation(q, c.distinct(), same, F.arrays_overlap)


#: Groups, which candidates spell in another way.
UNITS = "array('Velvet Harbor', 'Iron Meadow', 'Silent Comet', 'Paper Lantern', 'Glass Orchard')"


def _searched_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as pages searched for, by title, native title or both, a third of them known elsewhere; line items as the links of their
    disambiguation pages: suppliers, all under a part's brand for each thirteenth, other disambiguation pages for each seventeenth."""
    name = lambda eng, non: f"named_struct('eng', {eng}, 'non_eng', {non}, 'romanized', string(null), 'lit', string(null), 'versions', cast(array() AS {names.VERSIONS}))"
    p = star(spark, d, "part")
    eng, non = "IF(p_partkey % 6 <> 5, p_name, NULL)", "IF(p_partkey % 4 IN (1, 3), concat('가나다라 ', p_partkey), NULL)"
    known = name("concat(upper(p_name), IF(p_partkey % 9 = 0, '!', ''))", non)
    q = p.selectExpr("p_partkey AS query", f"IF({eng} IS NULL AND {non} IS NULL, NULL, {name(eng, non)}) AS name", f"IF(p_partkey % 3 = 0, {known}, NULL) AS entity", f"IF(p_partkey % 2 = 0, array({UNITS}[p_partkey % 5]), NULL) AS groups")
    words = """CASE pmod(xxhash64(l_partkey, l_suppkey), 16) WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '  ') WHEN 2 THEN concat(p_name, 'x') WHEN 3 THEN concat(element_at(split(p_name, ' '), -1), ' ', element_at(split(p_name, ' '), 1))
      WHEN 4 THEN concat(p_name, repeat('x', int(l_suppkey % 5))) WHEN 5 THEN NULL ELSE concat('quite another ', l_suppkey) END"""
    native = "CASE pmod(xxhash64(l_suppkey, l_partkey), 8) WHEN 0 THEN concat('가나다라', l_partkey) WHEN 1 THEN concat('다른말 ', l_suppkey) END"
    link = "CASE WHEN l_partkey % 17 = 0 THEN concat(p_name, ' (disambiguation)') WHEN l_partkey % 13 = 0 THEN p_brand WHEN l_suppkey % 9 = 0 THEN concat('Category:', l_suppkey) ELSE string(l_suppkey) END"
    single = lambda x: f"IF(l_partkey % 13 = 0, NULL, {x})"
    # all links go by these two keys; dealt by the first, they meet the parts and the pages where they are
    lines = star(spark, d, "lineitem").selectExpr("l_partkey", "IF(l_partkey % 13 = 0, 0, l_suppkey) AS l_suppkey").repartition("l_partkey").distinct()
    c = lines.join(p, F.expr("l_partkey = p_partkey")).selectExpr("l_partkey AS query", f"{link} AS link", f"{name(single(words), single(native))} AS name", single(f"IF(l_suppkey % 4 > 0, array(concat(lower({UNITS}[l_suppkey % 5]), 's'), 'nobody'), NULL)") + " AS groups")
    return q, c


@query()
def disambiguation_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """The same with names and groups that match by their fuzzy score; links of other disambiguation pages are no candidates."""
    q, c = _searched_parts(spark, d)
    return entities.disambiguation(q, c.filter(~F.lower("link").contains("disambiguation")))


#: Line items as pages with a name of their order's artist: spellings and fields depend on the item, so names meet in chains.
NAMES = """p AS (SELECT DISTINCT l_suppkey AS artist, l_orderkey AS page_id, CASE WHEN l_linenumber <> 3 THEN CASE WHEN l_linenumber > 4 THEN upper(s) ELSE s END END AS eng, CASE WHEN l_linenumber IN (1, 3, 5) THEN '가' || l_partkey % 3 END AS non_eng,
    CASE WHEN l_linenumber IN (3, 4, 6) THEN 'r' || l_partkey % 2 END AS romanized FROM (SELECT *, 'n' || l_partkey % 4 AS s FROM lineitem)),
  d AS (SELECT artist, {'eng': eng, 'non_eng': non_eng, 'romanized': romanized} AS n, min(page_id) AS page_id FROM p GROUP BY artist, n),
  o AS (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY page_id, n.eng NULLS FIRST, n.non_eng NULLS FIRST, n.romanized NULLS FIRST) AS i FROM d)"""
_SAME = "(coalesce(lower(e.eng) = lower(o.n.eng), false) OR coalesce(lower(e.non_eng) = lower(o.n.non_eng), false) OR coalesce(lower(e.romanized) = lower(o.n.romanized), false))"
_DIFFER = "(coalesce(lower(e.eng) <> lower(o.n.eng), false) OR coalesce(lower(e.non_eng) <> lower(o.n.non_eng), false) OR coalesce(lower(e.romanized) <> lower(o.n.romanized), false))"
_FILLED = "{'eng': coalesce(e.eng, o.n.eng), 'non_eng': coalesce(e.non_eng, o.n.non_eng), 'romanized': coalesce(e.romanized, o.n.romanized)}"


def _names(spark: SparkSession, d: str) -> DataFrame:
    name = f"named_struct('eng', CASE WHEN l_linenumber <> 3 THEN IF(l_linenumber > 4, upper(s), s) END, 'non_eng', IF(l_linenumber IN (1, 3, 5), concat('가', l_partkey % 3), NULL), 'romanized', IF(l_linenumber IN (3, 4, 6), concat('r', l_partkey % 2), NULL), 'lit', string(null), 'versions', cast(array() AS {names.VERSIONS}))"
    return star(spark, d, "lineitem").selectExpr("*", "concat('n', l_partkey % 4) AS s").selectExpr("l_suppkey AS artist", "l_orderkey AS page_id", f"{name} AS name")


@query(
    """SELECT artist, i, e.eng, e.non_eng, e.romanized FROM (SELECT artist, generate_subscripts(acc, 1) AS i, unnest(acc) AS e FROM (SELECT artist, arg_max(acc, i) AS acc FROM fold GROUP BY artist))""",
    "RECURSIVE " + NAMES,
    f"""fold AS (SELECT artist, i, [n] AS acc FROM o WHERE i = 1 UNION ALL SELECT artist, i, CASE WHEN hit > 0 THEN list_transform(acc, lambda e, k: CASE WHEN k = hit THEN {_FILLED.replace("o.n.", "n.")} ELSE e END) ELSE list_append(acc, n) END
    FROM (SELECT f.artist, o.i, acc, o.n, coalesce(list_position(list_transform(acc, lambda e: {_SAME} AND NOT {_DIFFER}), true), 0) AS hit FROM fold f JOIN o ON o.artist = f.artist AND o.i = f.i + 1))""",
)
def artist_names_folded(spark: SparkSession, d: str) -> DataFrame:
    """All names of all artists, folded in the order of their pages."""
    rows = entities.folded_names(_names(spark, d), "artist")
    return rows.select("artist", F.posexplode("names").alias("i", "e")).select("artist", (F.col("i") + 1).cast("long").alias("i"), "e.eng", "e.non_eng", "e.romanized")


@query(
    """SELECT artist, i, e.eng, e.non_eng, e.romanized, CAST(len(e.v) AS INTEGER) AS n_versions, list_aggregate(list_sort(list_transform(e.v, lambda x: coalesce(x.eng, '') || '/' || coalesce(x.non_eng, '') || '/' || coalesce(x.romanized, ''))), 'string_agg', ';') AS versions
  FROM (SELECT artist, generate_subscripts(acc, 1) AS i, unnest(acc) AS e FROM (SELECT artist, arg_max(acc, i) AS acc FROM fold GROUP BY artist))""",
    "RECURSIVE " + NAMES,
    f"""fold AS (SELECT artist, i, [{{'eng': n.eng, 'non_eng': n.non_eng, 'romanized': n.romanized, 'v': CAST([] AS STRUCT(eng VARCHAR, non_eng VARCHAR, romanized VARCHAR)[])}}] AS acc FROM o WHERE i = 1
    UNION ALL SELECT artist, i, CASE WHEN hit > 0 THEN list_transform(acc, lambda e, k: CASE WHEN k <> hit THEN e WHEN {_DIFFER.replace("o.n.", "n.")} THEN {{'eng': e.eng, 'non_eng': e.non_eng, 'romanized': e.romanized, 'v': CASE WHEN list_contains(e.v, n) THEN e.v ELSE list_append(e.v, n) END}}
      ELSE {_FILLED.replace("o.n.", "n.")[:-1]}, 'v': e.v}} END) ELSE list_append(acc, {{'eng': n.eng, 'non_eng': n.non_eng, 'romanized': n.romanized, 'v': []}}) END
    FROM (SELECT f.artist, o.i, acc, o.n, coalesce(list_position(list_transform(acc, lambda e: {_SAME}), true), 0) AS hit FROM fold f JOIN o ON o.artist = f.artist AND o.i = f.i + 1))""",
)
def artist_names_with_versions(spark: SparkSession, d: str) -> DataFrame:
    """The same, where a name that contradicts one it shares a field with becomes its version."""
    rows = entities.folded_names(_names(spark, d), "artist", versions=True)
    e = rows.select("artist", F.posexplode("names").alias("i", "e")).select("artist", (F.col("i") + 1).cast("long").alias("i"), "e.*")
    spelled = F.transform("versions", lambda x: F.concat_ws("/", *[F.coalesce(x[f], F.lit("")) for f in ("eng", "non_eng", "romanized")]))
    return e.select("artist", "i", "eng", "non_eng", "romanized", F.size("versions").alias("n_versions"), F.nullif(F.array_join(F.array_sort(spelled), ";"), F.lit("")).alias("versions"))


#: Customers as wanted titles; site a has most under their title, b and c some under the English titles found before.
SEARCH = """w AS (SELECT DISTINCT CASE WHEN c_custkey % 5 = 0 THEN 'LOUD ' || c_custkey ELSE 't' || c_custkey END AS title, CASE WHEN c_custkey % 3 = 0 THEN 'ep' ELSE 'album' END AS type, c_custkey AS k FROM customer),
  pages AS (SELECT 'a' AS site, CASE WHEN k % 5 = 0 THEN 'Loud ' || k ELSE 't' || k END AS tried, k AS page_id, 'e' || k // 2 AS english, CASE WHEN k % 7 = 0 THEN 'single' ELSE type END AS ptype FROM w WHERE k % 4 > 0
    UNION ALL SELECT 'b', 'e' || k, 1000000 + k, 'f' || k, CASE WHEN k % 2 = 0 THEN 'ep' ELSE 'album' END FROM w UNION ALL SELECT 'c', 'f' || k, 2000000 + k, 't' || k, 'album' FROM w WHERE k % 3 > 0
    UNION ALL SELECT 'd', 't' || k, 3000000 + k, NULL, 'album' FROM w WHERE k % 10 = 1)"""


def _search(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w = star(spark, d, "customer").selectExpr("IF(c_custkey % 5 = 0, concat('LOUD ', c_custkey), concat('t', c_custkey)) AS title", "IF(c_custkey % 3 = 0, 'ep', 'album') AS type", "c_custkey AS k")
    a = w.filter("k % 4 > 0").selectExpr("'a' AS site", "IF(k % 5 = 0, concat('Loud ', k), concat('t', k)) AS title", "k AS page_id", "concat('e', k div 2) AS english", "IF(k % 7 = 0, 'single', type) AS type")
    b = w.selectExpr("'b'", "concat('e', k)", "1000000 + k", "concat('f', k)", "IF(k % 2 = 0, 'ep', 'album')")
    c = w.filter("k % 3 > 0").selectExpr("'c'", "concat('f', k)", "2000000 + k", "concat('t', k)", "'album'")
    e = w.filter("k % 10 = 1").selectExpr("'d'", "concat('t', k)", "3000000 + k", "string(null)", "'album'")
    return w.select("title", "type"), a.union(b).union(c).union(e)


@query(
    """SELECT title, h.site, h.page_id, h.tried, CAST(h.round AS INTEGER) AS round FROM (SELECT title, unnest(hits) AS h FROM walk)""",
    "RECURSIVE " + SEARCH,
    """walk AS (SELECT title, type, [title] AS tries, [title] AS seen, CAST([] AS STRUCT(site VARCHAR, page_id BIGINT, tried VARCHAR, english VARCHAR, round INTEGER)[]) AS hits, CAST([] AS VARCHAR[]) AS sites, 0 AS round FROM w
    UNION ALL SELECT title, type, next, list_concat(seen, next), new, list_concat(sites, list_transform(new, lambda x: x.site)), round + 1 FROM (
      SELECT title, type, seen, new, sites, round, list_filter(list_distinct(list_concat(list_filter(list_transform(new, lambda x: x.english), lambda x: x IS NOT NULL), CASE WHEN round = 0 AND len(new) = 0 AND starts_with(title, 'LOUD') THEN ['Loud ' || substr(title, 6)] ELSE [] END)), lambda x: NOT list_contains(seen, x)) AS next
      FROM (SELECT k.title, k.type, k.seen, k.sites, k.round, coalesce(n.new, []) AS new FROM walk k LEFT JOIN LATERAL (SELECT list({'site': site, 'page_id': b.page_id, 'tried': b.tried, 'english': b.english, 'round': k.round}) AS new FROM (
        SELECT p.site, min({'page_id': p.page_id, 'tried': p.tried, 'english': p.english}) AS b FROM pages p WHERE list_contains(k.tries, p.tried) AND p.ptype = k.type AND NOT list_contains(k.sites, p.site) GROUP BY p.site)) n ON true WHERE len(k.tries) > 0)))""",
)
def search_repeated(spark: SparkSession, d: str) -> DataFrame:
    """All titles searched on all sites, and again under what was found, until nothing is new."""
    return entities.searched(*_search(spark, d))


#: Regions as groups, nations as their units, customers as members of a nation; every third customer leads a unit of its own.
GROUPS = """edges AS (SELECT 'r' || n_regionkey AS grp, 'n' || n_nationkey AS member FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'c' || c_custkey, 'u' || c_custkey % 50 FROM customer WHERE c_custkey % 3 = 0 UNION SELECT 'u' || c_custkey % 50, 'c' || c_custkey % 50 FROM customer)"""


def _groups(spark: SparkSession, d: str) -> DataFrame:
    c = star(spark, d, "customer")
    out = star(spark, d, "nation").selectExpr("concat('r', n_regionkey) AS group", "concat('n', n_nationkey) AS member").union(c.selectExpr("concat('n', c_nationkey)", "concat('c', c_custkey)"))
    return out.union(c.filter("c_custkey % 3 = 0").selectExpr("concat('c', c_custkey)", "concat('u', c_custkey % 50)")).union(c.selectExpr("concat('u', c_custkey % 50)", "concat('c', c_custkey % 50)")).distinct()


@query(
    'SELECT grp AS "group", member, min(depth) AS depth FROM c GROUP BY ALL',
    "RECURSIVE " + GROUPS,
    "c AS (SELECT grp, member, 1 AS depth FROM edges UNION SELECT c.grp, e.member, depth + 1 FROM c JOIN edges e ON e.grp = c.member WHERE depth < 8)",
)
def group_closure(spark: SparkSession, d: str) -> DataFrame:
    """Who belongs to each group, directly or through units, rings included."""
    return entities.closure(_groups(spark, d))


@query(
    """SELECT id, artist, "by" FROM (SELECT w.id, a.artist, CASE WHEN m.depth IS NULL THEN 'name' ELSE 'member' END AS "by", row_number() OVER (PARTITION BY w.id ORDER BY coalesce(m.depth, 99), a.artist) AS n
    FROM w JOIN a ON lower(a.eng) = lower(w.eng) LEFT JOIN m ON m.grp = w.grp AND m.member = a.artist) WHERE n = 1
  UNION ALL SELECT id, NULL, 'none' FROM w WHERE lower(eng) NOT IN (SELECT lower(eng) FROM a)""",
    "RECURSIVE " + GROUPS,
    "c AS (SELECT grp, member, 1 AS depth FROM edges UNION SELECT c.grp, e.member, depth + 1 FROM c JOIN edges e ON e.grp = c.member WHERE depth < 8)",
    "m AS (SELECT grp, member, min(depth) AS depth FROM c GROUP BY ALL)",
    "a AS (SELECT 'c' || c_custkey AS artist, c_mktsegment || c_mktsegment || repeat(chr(97 + CAST(c_custkey % 7 AS INTEGER)), 9) AS eng FROM customer)",
    "w AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 > 0 THEN 'r' || s_suppkey % 5 END AS grp, CASE WHEN s_suppkey % 6 = 0 THEN 'nobody at all' ELSE lower(g) || g || repeat(chr(97 + CAST(s_suppkey % 7 AS INTEGER)), 9) END AS eng FROM (SELECT *, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD'][1 + s_suppkey % 5] AS g FROM supplier))",
)
def member_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Artists of given names, among the members of their group first."""
    name = lambda c: F.expr(f"named_struct('eng', {c}, 'non_eng', string(null), 'romanized', string(null), 'lit', string(null), 'versions', cast(array() AS {names.VERSIONS}))")
    a = star(spark, d, "customer").select(F.expr("concat('c', c_custkey) AS artist"), name("concat(c_mktsegment, c_mktsegment, repeat(chr(97 + c_custkey % 7), 9))").alias("name"))
    w = star(spark, d, "supplier").withColumn("g", F.expr("element_at(array('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD'), int(1 + s_suppkey % 5))"))
    w = w.select(F.col("s_suppkey").alias("id"), F.expr("IF(s_suppkey % 4 > 0, concat('r', s_suppkey % 5), NULL) AS group"), name("IF(s_suppkey % 6 = 0, 'nobody at all', concat(lower(g), g, repeat(chr(97 + s_suppkey % 7), 9)))").alias("name"))
    return entities.member_lookup(w, _groups(spark, d), a)


@query(
    """SELECT CASE WHEN g = 7 THEN NULL ELSE section END AS section, artist, album, CAST(g AS INTEGER) AS level, n_tracks, seconds FROM (
  SELECT s AS section, a AS artist, o AS album, grouping(s, a, o) AS g, count(*) AS n_tracks, sum(q) AS seconds FROM (SELECT l_returnflag AS s, l_suppkey AS a, l_orderkey AS o, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY ROLLUP (s, a, o))"""
)
def report_with_subtotals(spark: SparkSession, d: str) -> DataFrame:
    """Tracks and seconds by section, artist and album with all subtotals in one pass; level says which columns are summed over."""
    from tunelake.operators import reports

    rows = star(spark, d, "lineitem").selectExpr("l_returnflag AS section", "l_suppkey AS artist", "l_orderkey AS album", "bigint(l_quantity) AS seconds")
    return reports.subtotals(rows, ["section", "artist", "album"], n_tracks=F.count("*"), seconds=F.sum("seconds"))


#: Parts as artist lists of eight kinds, by name and brand.
LISTS = """l AS (SELECT p_partkey AS id, p_name AS n, p_brand AS b FROM part)"""
_ROWS = {
    0: [("b", None, None, None, []), ("n", None, None, None, []), ("n", "청하", None, None, [])],
    1: [("n", "기희현", "b", None, []), ("b", "전소미", None, None, [])],
    2: [("n", "지민", "b", None, [])],
    3: [("n", "지민", "b", None, [])],
    4: [("n", "딘딘", None, None, []), ("b", "민아", None, None, [])],
    5: [("n", "손동운", "'Highlight'", "하이라이트", []), ("b", "서령", "'GWSN'", "공원소녀", [])],
    6: [("n", "주헌", "'MONSTA X'", "몬스타엑스", [])],
    7: [("b", None, None, None, ["n", "'x'"])],
}


def _listed(rows: list) -> str:
    text = lambda x: f"'{x}'" if x else "NULL"
    return "[" + ", ".join(f"{{'pos': {k}, 'eng': {e}, 'non_eng': CAST({text(o)} AS VARCHAR), 'group_eng': CAST({g or 'NULL'} AS VARCHAR), 'group_non_eng': CAST({text(h)} AS VARCHAR), 'members': CAST([{', '.join(m)}] AS VARCHAR[])}}" for k, (e, o, g, h, m) in enumerate(rows, 1)) + "]"


@query("SELECT id, CAST(r.pos AS INTEGER) AS pos, r.eng, r.non_eng, r.group_eng, r.group_non_eng, array_to_string(r.members, '|') AS members FROM (SELECT id, unnest(CASE id % 8 " + " ".join(f"WHEN {k} THEN {_listed(v)}" for k, v in _ROWS.items()) + " END) AS r FROM l)", LISTS)
def artist_lists(spark: SparkSession, d: str) -> DataFrame:
    """The artists of all lists as rows, by the table function in SQL."""
    text = """CASE p_partkey % 8 WHEN 0 THEN concat(p_brand, ', ', p_name, ', 청하 (', p_name, ')') WHEN 1 THEN concat('기희현, 전소미 (', p_name, ' (', p_brand, '), ', p_brand, ')')
      WHEN 2 THEN concat('지민 [', p_name, ' (', p_brand, ')]') WHEN 3 THEN concat(p_name, ' (지민) (', p_brand, ')') WHEN 4 THEN concat('딘딘 & 민아 (', p_name, ' & ', p_brand, ')')
      WHEN 5 THEN concat('손동운 (하이라이트) X 서령 (공원소녀) [', p_name, ' (Highlight) X ', p_brand, ' (GWSN)]') WHEN 6 THEN concat('주헌 (몬스타엑스) (', p_name, ' (MONSTA X))') ELSE concat(p_brand, ' (', p_name, ', x)') END"""
    rows = star(spark, d, "part").selectExpr("p_partkey AS id", f"{text} AS text")
    name = lists.register(spark)
    # each text once, in a given number of tasks: a small file is one, however many lists it holds
    texts = rows.select("text").distinct().repartition(spark.sparkContext.defaultParallelism * 4, "text")
    listed = spark.sql(f"SELECT text, pos, eng, non_eng, group_eng, group_non_eng, array_join(members, '|') AS members FROM {{texts}} t, LATERAL {name}(t.text)", texts=texts)
    return rows.join(listed, "text").drop("text")


@query()
def english_shares(spark: SparkSession, d: str) -> DataFrame:
    """How English all documents are, by a dictionary learned from those marked so."""
    docs = star(spark, d, "documents")
    return spelling.english_share(docs, spelling.dictionary(docs.filter("lang = 'en'")), "doc_id")


@query(
    "SELECT path, file_stars, rated_at, epoch_us(rated_at) + 12 * 3600000000 > (SELECT epoch_us(max(ts)) - 3600000000 FROM events) AS live FROM (SELECT CAST(user_id AS VARCHAR) AS path, arg_max(CAST(floor(value) AS INTEGER), ts) AS file_stars, max(ts) AS rated_at FROM events GROUP BY user_id)"
)
def rating_stream_last(spark: SparkSession, d: str) -> DataFrame:
    """Events as rating files, streamed into the last rating of each user and whether it has expired."""
    files, sink, state = (catalog.scratch(spark) for _ in range(3))
    star(spark, d, "events").selectExpr("string(user_id) AS path", "int(floor(value)) AS file_stars", "ts AS at").write.parquet(files)
    stream = spark.readStream.schema("path string, file_stars int, at timestamp").parquet(files)
    ratings.last_ratings(stream, sink, state).awaitTermination()
    return ratings.settled(spark.read.schema(ratings.LAST).parquet(sink)).withColumnRenamed("at", "rated_at")


@query("SELECT date_trunc('hour', ts) AS begin, count(*) AS n, round(avg(CAST(floor(value) AS INTEGER)), 6) AS stars FROM events GROUP BY 1 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def rating_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts and means of the streamed ratings, as far as the watermark has closed them."""
    files, sink, state = (catalog.scratch(spark) for _ in range(3))
    star(spark, d, "events").selectExpr("string(user_id) AS path", "int(floor(value)) AS file_stars", "ts AS at").write.parquet(files)
    stream = spark.readStream.schema("path string, file_stars int, at timestamp").parquet(files)
    rows = ratings.rate_windows(stream).select("window.start", "n", "stars")
    rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("start timestamp, n bigint, stars double").parquet(sink)
    return out.select(F.col("start").alias("begin"), "n", F.round("stars", 6).alias("stars"))


@query(
    """SELECT artist, page_id, k, same AND NOT differ AS version, same AS partial, same AND NOT differ AND NOT equal AS merges FROM (SELECT artist, page_id, k, coalesce(lower(e1) = lower(e2), false) OR coalesce(lower(n1) = lower(n2), false) OR coalesce(lower(r1) = lower(r2), false) AS same,
  coalesce(lower(e1) <> lower(e2), false) OR coalesce(lower(n1) <> lower(n2), false) OR coalesce(lower(r1) <> lower(r2), false) AS differ, e1 IS NOT DISTINCT FROM e2 AND n1 IS NOT DISTINCT FROM n2 AND r1 IS NOT DISTINCT FROM r2 AS equal
  FROM (SELECT artist, page_id, row_number() OVER w AS k, eng AS e1, non_eng AS n1, romanized AS r1, lag(eng) OVER w AS e2, lag(non_eng) OVER w AS n2, lag(romanized) OVER w AS r2 FROM p WINDOW w AS (PARTITION BY artist ORDER BY page_id, eng NULLS FIRST, non_eng NULLS FIRST, romanized NULLS FIRST)) WHERE k > 1)""",
    NAMES,
)
def name_versions_of_pages(spark: SparkSession, d: str) -> DataFrame:
    """Each name of an artist against the one before it: a version of it, at least in part, and whether they would merge."""
    w = Window.partitionBy("artist").orderBy("page_id", *[F.col(f"name.{f}").asc_nulls_first() for f in ("eng", "non_eng", "romanized")])
    rows = _names(spark, d).distinct().select("artist", "page_id", "name", F.row_number().over(w).cast("long").alias("k"), F.lag("name").over(w).alias("last")).filter("k > 1")
    a, b = F.col("name"), F.col("last")
    return rows.select("artist", "page_id", "k", names.is_version_of(a, b).alias("version"), names.is_version_of(a, b, partial=True).alias("partial"), names.should_merge(a, b).alias("merges"))


@query("SELECT key, user_rating FROM track WHERE coalesce(user_rating, 0) >= 8", TRACK)
def op_with_rating(spark: SparkSession, d: str) -> DataFrame:
    return ResultSet.new(catalog.from_star(spark, d), "track").with_rating(8, "gte").df.select("key", "user_rating")


@query("SELECT path, array_to_string(list_filter([trim(p_name), trim(p_type), 'x', ''], lambda v: v <> ''), ';') AS text FROM (SELECT *, p_partkey AS path FROM part)")
def tags_text(spark: SparkSession, d: str) -> DataFrame:
    return star(spark, d, "part").select(F.col("p_partkey").alias("path"), tags.text_of(F.array(F.concat(F.lit(" "), "p_name"), "p_type", F.lit(" x "), F.lit(" "))).alias("text"))


@query("SELECT p_partkey AS path, p_brand || '/' || p_name || '-' || p_size || '/' || p_type AS safe FROM part")
def path_safe(spark: SparkSession, d: str) -> DataFrame:
    return star(spark, d, "part").select(F.col("p_partkey").alias("path"), scalar.safe_path(F.col("p_brand"), F.concat_ws("-", "p_name", "p_size"), F.col("p_type")).alias("safe"))


@query(
    "SELECT path, codec, length_text, title, artist, genre FROM (SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_size % 2 = 0 THEN 'flac' ELSE 'mp3' END AS codec, CAST(p_size * 11 // 60 AS BIGINT) || ':' || lpad(CAST(p_size * 11 % 60 AS VARCHAR), 2, '0') AS length_text, CASE WHEN p_partkey % 5 > 0 THEN p_name END AS title, CASE WHEN p_partkey % 5 > 0 AND p_partkey % 4 <> 0 THEN p_brand END AS artist, CASE WHEN p_partkey % 5 > 0 THEN p_type END AS genre FROM part)"
)
def metadata_table(spark: SparkSession, d: str) -> DataFrame:
    """Technical columns and common tags of every file in one row; every fifth file has no tags."""
    p = star(spark, d, "part")
    files = p.selectExpr("string(p_partkey) AS path", "IF(p_size % 2 = 0, 'flac', 'mp3') AS codec", "double(p_size * 11) AS length", "192000L AS bitrate", "44100 AS sample_rate", "p_size % 2 = 0 AS lossless", "bigint(p_size) AS size")
    own = p.filter("p_partkey % 5 > 0").selectExpr("string(p_partkey) AS path", "explode(array(named_struct('tag', 'title', 'value', p_name), named_struct('tag', 'genre', 'value', p_type), named_struct('tag', 'artist', 'value', IF(p_partkey % 4 <> 0, p_brand, NULL)))) AS t").select("path", "t.tag", "t.value")
    return tags.metadata(own, files).select("path", "codec", F.col("length").alias("length_text"), "title", "artist", "genre")


@query()
def album_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every other part as an album of files, the rest as entries: by url, name, number, or a part of a name in two scripts."""
    p = star(spark, d, "part")
    shared = "concat('a', p_size % 3) AS artist", "'EP' AS type", "false AS repackage"
    files = p.filter("p_partkey % 2 = 0").selectExpr("p_partkey AS album", "IF(p_partkey % 10 = 0, concat('u', p_partkey + 1), NULL) AS url", "IF(p_partkey % 4 = 0, concat(p_name, ' 사랑'), p_name) AS name", "p_partkey % 7 AS num", *shared)
    entries = p.filter("p_partkey % 2 = 1").selectExpr("p_partkey AS entry", "concat('u', p_partkey) AS url", "p_name AS name", "100 + p_partkey % 7 AS num", *shared)
    return matching.album_lookup(files, entries)


@query()
def match_scores(spark: SparkSession, d: str) -> DataFrame:
    """Names of a third of the parts, as they are and turned round, against those of all brands' and sizes' parts."""
    name = lambda c: f"named_struct('eng', {c}, 'non_eng', string(null), 'romanized', string(null), 'lit', string(null), 'versions', cast(array() AS {names.VERSIONS})) AS name"
    p = star(spark, d, "part")
    wanted = p.filter("p_partkey % 3 = 0").selectExpr("p_partkey AS id", name("IF(p_partkey % 2 = 0, p_name, concat(p_name, 's'))"))
    targets = p.selectExpr("IF(p_partkey % 2 = 0, 'edition', 'part') AS kind", "p_brand AS target", name("p_name")).distinct()
    return matching.match_scores(wanted, targets).select("id", "kind", "target", "score").distinct()
