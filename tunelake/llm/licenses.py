"""Licence scans: normalised text against licence templates, by Dice over word bigrams.

Everything is DataFrame expressions.  Texts are lower-cased (A-Z) and cut into words across line ends and punctuation, so
wrapping, comment marks and indentation don't matter.  A unit is a window of the text with as many words as a template, laid so
that one of the template's key bigrams falls in its place; it matches if the Dice coefficient of the two sets of word bigrams
is ``DICE`` or more.  Keys are chosen so that no window can match a template without one of them: without the bigrams of its
key words a template has under ``DICE`` / (2 - ``DICE``) of its bigrams left, the size bound of the coefficient.  So a text
without any key word is passed over, a window is made only where a key occurs, and one whose number of bigrams rules the
coefficient out isn't compared.

Matches are taken best first, by the higher coefficient, then the longer template, the one listed first, the first place; one
that overlaps one taken before is left out.  Those taken are kept by regions of the text, so each is held against its
neighbours only.  A notice that grants later versions must say so in its window, whatever its coefficient.  Bare ``All rights
reserved`` counts where it ends a line that is nothing else, or a copyright line, and only if no other licence is found.

Null, empty and one-word texts match nothing.  A text may have any length and hold any number of notices.  Rows are
independent, so repeated rows give equal rows; columns besides the id and the text aren't read, so their names can't clash.
An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame, functions as F

from .common import let
from .license_texts import TEMPLATES

#: The template that only counts by itself, the line that it takes, and the bigram that makes a grant one for later versions.
BARE, LINE, LATER = "LicenseRef-Proprietary", r"(?im)^[^0-9a-z\n]*((copyright|\(c\)|©)[^\n]*)?all rights reserved[^0-9a-z\n]*$", "later version"

DICE = 0.75
#: A window may begin so many words before the text; with the template's number it makes one integer, of which repetitions go in linear time.
LEAD = 1 << 16
#: Words are letters, digits and all that isn't ASCII.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words too frequent in any text to be keys.
COMMON = frozenset("the of and to in or a any is for this that by with at on be it as its you can from an all if not was in are will 0 1 2 3 4 may use work under free form copy version without no if source their anyone".split())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return re.sub(BREAKS, " ", text.lower()).split()


def pairs(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def key_words(templates: tuple, dice: float = DICE) -> list[str]:
    """Words such that every template loses more of its bigrams than the size bound allows if none of them is there."""
    sets = [set(pairs(template_words(t))) for _, t in templates]
    left, chosen, most = [set(s) for s in sets], [], dice / (2 - dice)
    while True:
        gain: Counter = Counter()
        for s, rest in zip(sets, left, strict=True):
            if rest and len(rest) >= most * len(s):
                for pair in sorted(rest):  # a frequent word only where there is no other
                    gain.update({w: 1 / len(s) - (w in COMMON) for w in set(pair.split())})
        if not gain:
            return sorted(chosen)
        best = max(sorted(gain), key=gain.__getitem__)
        chosen.append(best)
        left = [{p for p in rest if best not in p.split()} for rest in left]


def keys(templates: tuple, dice: float = DICE) -> dict[str, list[tuple[int, int]]]:
    """Key bigram -> (template, place in it)."""
    words, out = set(key_words(templates, dice)), defaultdict(list)
    for n, (_, t) in enumerate(templates):
        for at, pair in enumerate(pairs(template_words(t))):
            if words & set(pair.split()):
                out[pair].append((n, at))
    return dict(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: tuple = TEMPLATES, dice: float = DICE) -> DataFrame:
    """One row for each document: id, n_lines, matches (template, licence, start and size in words, dice), none overlapped by a better one."""
    made = [(n, name, template_words(t)) for n, (name, t) in enumerate(templates)]
    bound = dice / (2 - dice)  # sizes a and b allow the coefficient only if min / max is at least this
    fixed = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)  # noqa: E731  a literal, without a call for each entry
    known = fixed([{"n": n, "license": name, "size": len(w), "later": name.endswith("-or-later") and LATER in pairs(w), "b": sorted(set(pairs(w)))} for n, name, w in made], "array<struct<n:int,license:string,size:int,later:boolean,b:array<string>>>")
    region = max(len(w) for _, _, w in made)
    stems = key_words(templates, dice)
    starts = sorted({w[0] for w in stems})
    #: a superset of the texts with a key word, cheap: only where a word begins
    hint = "(?i)(?<![0-9A-Za-z])(?:" + "|".join(f"{c}(?:{'|'.join(w[1:] for w in stems if w[0] == c)})" for c in starts) + ")"
    stem_set = fixed(stems, "array<string>")
    places = fixed({pair: [{"n": n, "at": at} for n, at in of] for pair, of in sorted(keys(templates, dice).items())}, "map<string,array<struct<n:int,at:int>>>")
    kind = "array<struct<template:int,license:string,start:int,size:int,dice:double>>"

    def matches(w: Column) -> Column:
        pair = lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1))
        own = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(stem_set, x), i)), lambda i: i.isNotNull())
        near = F.filter(F.array_distinct(F.flatten(F.transform(own, lambda i: F.array(i - 1, i)))), lambda i: (i >= 0) & (i < F.size(w) - 1))
        found = F.flatten(F.transform(near, lambda i: F.coalesce(F.transform(F.try_element_at(places, pair(i)), lambda k: F.shiftleft(k["n"].cast("long"), 32) + (i - k["at"] + LEAD)), F.expr("cast(array() as array<bigint>)"))))

        def window(c: Column) -> Column:
            n, at = F.shiftright(c, 32).cast("int"), c.bitwiseAND(F.lit((1 << 32) - 1)).cast("int") - LEAD
            t = F.get(known, n)
            start = F.greatest(at, F.lit(0))
            size = F.least(t["size"] + at, F.size(w)) - start

            def compared(b: Column) -> Column:
                a, z = F.size(b), F.size(t["b"])
                fits = (F.least(a, z) >= F.lit(bound) * F.greatest(a, z)) & (~t["later"] | F.array_contains(b, LATER))
                value = F.when(fits, F.lit(2.0) * F.size(F.array_intersect(b, t["b"])) / (a + z)).otherwise(F.lit(0.0))
                return F.struct(n.alias("template"), t["license"].alias("license"), start.alias("start"), size.alias("size"), value.alias("dice"))

            # by places: a slice would copy the whole text for each window
            own = F.when(size > 1, F.transform(F.sequence(start, start + size - 2), pair)).otherwise(F.expr("cast(array() as array<string>)"))
            return let(F.array_distinct(own), compared)

        good = F.filter(F.transform(F.array_distinct(found), window), lambda m: m["dice"] >= dice)
        ranked = F.sort_array(F.transform(good, lambda m: F.struct((-m["dice"]).alias("d"), (-F.get(known, m["template"])["size"]).alias("s"), m["template"].alias("t"), m["start"].alias("p"), m.alias("m"))))
        none = F.expr(f"cast(array() as {kind})")

        def take(taken: Column, r: Column) -> Column:
            m, at = r["m"], F.floor(r["m"]["start"] / region).cast("int")
            near = F.flatten(F.transform(F.array(at - 1, at, at + 1), lambda k: F.coalesce(F.get(taken, k), none)))
            meets = F.exists(near, lambda o: (o["start"] < m["start"] + m["size"]) & (m["start"] < o["start"] + o["size"]))
            return F.when(meets, taken).otherwise(F.transform(taken, lambda x, k: F.when(k == at, F.concat(x, F.array(m))).otherwise(x)))

        empty = F.transform(F.sequence(F.lit(0), F.floor(F.size(w) / region).cast("int")), lambda _: none)
        return let(ranked, lambda g: F.when(F.size(g) == 0, none).otherwise(F.flatten(F.aggregate(g, empty, take))))

    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(F.translate(t, UPPER, LOWER), BREAKS), lambda x: x != "")
    got = F.when(t.rlike(hint), let(words, matches).cast(kind)).otherwise(F.expr(f"cast(array() as {kind})"))
    got = let(got, lambda g: F.when(F.exists(g, lambda m: m["license"] == BARE), F.filter(g, lambda m: (m["license"] != BARE) | t.rlike(LINE) & ~F.exists(g, lambda o: o["license"] != BARE))).otherwise(g))
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"))) + 1
    return docs.select(F.col(id_col), lines.cast("long").alias("n_lines"), got.alias("matches"))


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row for each document: id, n_lines, n_license_units, licenses, best_license, best_dice (null without a match)."""
    found = scan(docs, id_col, text, **how)
    best = F.sort_array(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("d"), m["template"], m["start"], m["license"])))
    return found.select(
        id_col,
        "n_lines",
        F.size("matches").cast("long").alias("n_license_units"),
        F.array_join(F.sort_array(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.get(best, F.lit(0))["license"].alias("best_license"),
        (-F.get(best, F.lit(0))["d"]).alias("best_dice"),
    )


def _oracle() -> str:
    made = [(n, name, template_words(t)) for n, (name, t) in enumerate(TEMPLATES)]
    rows = ", ".join(f"({n}, '{name}', {len(w)}, {str(name.endswith('-or-later') and LATER in pairs(w)).lower()}, {sorted(set(pairs(w)))!r})" for n, name, w in made)
    places = ", ".join(f"('{pair}', {n}, {at})" for pair, of in sorted(keys(TEMPLATES).items()) for n, at in of)
    bound = DICE / (2 - DICE)
    return rf"""
WITH RECURSIVE t(n, license, size, later, b) AS (VALUES {rows}),
k(pair, n, place) AS (VALUES {places}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(string_split_regex(translate(t, '{UPPER}', '{LOWER}'), '{BREAKS}'), lambda x: x <> '') AS w FROM d),
p AS (SELECT r, unnest(range(0, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM w WHERE len(w) > 1),
s AS (SELECT DISTINCT r, n, i - place AS lead FROM p JOIN k USING (pair)),
c AS (SELECT r, s.n, license, size AS full_size, later, b, w, greatest(lead, 0) AS a, least(lead + size, len(w)) AS z FROM s JOIN t ON s.n = t.n JOIN w USING (r)),
g AS (SELECT r, n, license, full_size, later, b, a, z, list_distinct(list_transform(range(a + 1, z), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM c),
m AS (SELECT r, n, license, full_size, a, z, 2.0::DOUBLE * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice FROM g WHERE least(len(g), len(b)) >= {bound!r}::DOUBLE * greatest(len(g), len(b)) AND (NOT later OR list_contains(g, '{LATER}'))),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY dice DESC, full_size DESC, n, a) AS i FROM m WHERE dice >= {DICE}),
walk AS (SELECT r, i, [{{'a': a, 'z': z, 'n': n, 'license': license, 'dice': dice}}] AS taken FROM o WHERE i = 1
  UNION ALL SELECT k.r, o.i, CASE WHEN len(list_filter(k.taken, lambda x: x.a < o.z AND o.a < x.z)) > 0 THEN k.taken ELSE list_append(k.taken, {{'a': o.a, 'z': o.z, 'n': o.n, 'license': o.license, 'dice': o.dice}}) END FROM walk k JOIN o ON o.r = k.r AND o.i = k.i + 1),
u AS (SELECT r, x.a AS a, x.n AS n, x.license AS license, x.dice AS dice, bool_or(x.license <> '{BARE}') OVER (PARTITION BY r) AS others FROM (SELECT r, unnest(taken) AS x FROM (SELECT r, arg_max(taken, i) AS taken FROM walk GROUP BY r))),
f AS (SELECT u.* FROM u JOIN d USING (r) WHERE license <> '{BARE}' OR NOT others AND regexp_matches(d.t, '{LINE}')),
e AS (SELECT r, count(*) AS units, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, arg_min(license, (-dice, n, a)) AS best, max(dice) AS dice FROM f GROUP BY r)
SELECT doc_id, CAST(length(t) - length(replace(t, chr(10), '')) + 1 AS BIGINT) AS n_lines, coalesce(units, 0) AS n_license_units, coalesce(licenses, '') AS licenses, best AS best_license, dice AS best_dice
FROM d LEFT JOIN e USING (r)"""


ORACLE = _oracle()
