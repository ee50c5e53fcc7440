"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

Everything is DataFrame expressions.  Kinds, in order: email, ip, card, phone (the base kinds: a match that passes its
check is a span whatever its score), then iban (mod-97) and ssn, which are reported when their score reaches ``ACCEPT``.
A score is the kind's prior, raised by a checksum and by a context word, whole, within ``NEAR`` characters before or after
the span.

Matches are leftmost and don't overlap within a kind; spans of different kinds may.  Offsets are code points, the end is
exclusive.  The patterns are written so that they match what the plain forms match, in linear time on any text: runs are
possessive, and an email may only start where its run of characters starts or where the match before it ended.

Null and empty texts have no spans.  A text may have any length and any number of spans: places come from sums by blocks and
context from pieces of ``CHUNK`` characters, so the work doesn't grow with the square of either.  Rows are independent, so repeated rows give equal rows; an empty table gives an empty
result.  Result columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import let

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
NEAR = 40
CHUNK = 1024
ACCEPT = 0.5
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: What a text must hold for the kind's pattern to be tried.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"-[0-9]{2}-"}
#: Prior, what the checksum adds, what context adds, context words.
SCORES = {
    "email": (0.9, 0.0, 0.05, "mail|contact|write to"),
    "ip": (0.6, 0.0, 0.2, "ip|address|host|server"),
    "card": (0.4, 0.4, 0.15, "card|visa|mastercard|amex|credit|payment"),
    "phone": (0.6, 0.0, 0.3, "phone|call|tel|mobile|fax"),
    "iban": (0.3, 0.5, 0.2, "iban|bank|account|konto"),
    "ssn": (0.3, 0.0, 0.5, "ssn|social security"),
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def located(text: Column, pattern: str) -> Column:
    """Matches with their places, (match, start), from the lengths of what lies between them; sums go by blocks of 256."""

    def places(matches: Column, gaps: Column) -> Column:
        lengths = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))
        block = lambda n, k: F.slice(n, k * 256 + 1, 256)

        def tops(n: Column) -> Column:
            return let(F.transform(F.sequence(F.lit(0), ((F.size(n) - 1) / 256).cast("int")), lambda k: _sum(block(n, k))), lambda sums: F.transform(sums, lambda _, k: _sum(F.slice(sums, F.lit(1), k))))

        def start(n: Column, before: Column, m: Column, i: Column) -> Column:
            k = (i / 256).cast("int")
            return F.struct(m.alias("match"), (F.get(before, k) + _sum(F.slice(n, k * 256 + 1, i - k * 256 + 1)) - F.length(m)).alias("start"))

        return let(lengths, lambda n: let(tops(n), lambda before: F.transform(matches, lambda m, i: start(n, before, m, i))))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr("cast(array() as array<struct<match:string,start:int>>)")
    return let(found, lambda m: F.when(F.size(m) > 0, places(m, F.split(text, pattern, -1))).otherwise(none))


def luhn(digits: Column) -> Column:
    """The Luhn check of a string of digits."""

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return _sum(F.transform(F.split(F.reverse(digits), ""), part)) % 10 == 0


def mod97(iban: Column) -> Column:
    """The mod-97 check of an account number without blanks: the first four characters go last, letters are 10 to 35."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))

    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(m, "[ -]", "")
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)
    if kind == "iban":
        return mod97(F.replace(m, F.lit(" ")))
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def found(text: Column, kind: str) -> Column:
    """The kind's spans in a text."""
    prior, check, near, words = SCORES[kind]

    def part(chunks: Column, at: Column, n: int) -> Column:
        """n characters from a place on, read from the pieces that hold them."""
        k = (at / CHUNK).cast("int")
        return F.substring(F.concat(F.coalesce(F.get(chunks, k), F.lit("")), F.coalesce(F.get(chunks, k + 1), F.lit(""))), at - k * CHUNK + 1, F.lit(n))

    def span(chunks: Column, x: Column) -> Column:
        start, end = x["start"], x["start"] + F.length(x["match"])
        # one character more on the far side tells whether a word is whole
        before = F.when(start > NEAR, part(chunks, start - NEAR - 1, NEAR + 1)).otherwise(F.concat(F.lit(" "), F.substring(part(chunks, F.lit(0), NEAR), F.lit(1), start)))
        after = F.concat(part(chunks, end, NEAR + 1), F.lit(" "))
        context = F.lower(before).rlike(f"[^a-z](?:{words})(?:[^a-z]|$)") | F.lower(after).rlike(f"(?:^|[^a-z])(?:{words})[^a-z]")
        score = F.lit(prior + check) + F.when(context, F.lit(near)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"))

    def alone(chunks: Column, x: Column) -> Column:
        """Neither the character before nor the one after is a letter or digit."""
        before = F.when(x["start"] > 0, part(chunks, x["start"] - 1, 1)).otherwise("")
        return ~before.rlike("[A-Za-z0-9]") & ~part(chunks, x["start"] + F.length(x["match"]), 1).rlike("[A-Za-z0-9]")

    def spans(matches: Column) -> Column:
        def of(chunks: Column) -> Column:
            if kind in BASE:
                return F.transform(matches, lambda x: span(chunks, x))
            return F.filter(F.transform(F.filter(matches, lambda x: alone(chunks, x)), lambda x: span(chunks, x)), lambda s: s["score"] >= ACCEPT)

        return F.when(F.size(matches) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), of)).otherwise(none)

    none = F.expr(f"cast(array() as {SPANS})")
    good = F.filter(located(text, PATTERNS[kind]), lambda x: valid(kind, x["match"]))
    return F.when(text.rlike(NEEDS[kind]), let(good, spans)).otherwise(none)


def detect(docs: DataFrame, text: str = "text", keep: list[str] | None = None, name: str = "spans") -> DataFrame:
    """The kept columns and, under a name, every span: kind, start, end, score; by kind, then start."""
    keep = [c for c in (keep or docs.columns) if c.lower() != name.lower()]
    own = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__pii_text"))
    return own.select(*[F.col(f"`{c}`") for c in keep], F.concat(*[found(F.col("__pii_text"), k) for k in KINDS]).alias(name))


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: id, counts of the base kinds, the digest of the base spans, all spans as text, and their scores."""
    every = detect(docs, text, [id_col], "__spans")
    mark = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("__spans", lambda s: s["kind"].isin(*BASE))
    of = lambda kind: lambda s: s["kind"] == kind
    count = [F.size(F.filter("__spans", of(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return every.select(id_col, *count, F.sha2(F.array_join(F.transform(base, mark), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("__spans", mark), ",").alias("spans"), F.array_join(F.transform("__spans", lambda s: F.concat_ws(":", s["kind"], s["start"], F.format_string("%.2f", s["score"]))), ",").alias("scores"))


def redacted(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with each span, overlapping ones merged, replaced by its kind in brackets; texts without spans stay.

    length: a column to hold the new length in characters, if the documents have it.
    """
    every = detect(docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), text, ["__row"], "__spans")
    body = F.col(f"__row.`{text}`")
    ordered = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def step(a: Column, s: Column) -> Column:
        fresh = F.array(F.substring(body, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        apart = s["start"] >= a["at"]
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(apart, F.concat(a["out"], fresh)).otherwise(a["out"]).alias("out"))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")), step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(body, a["at"] + 1, F.length(body))))
    clean = every.select("__row", F.when(F.size("__spans") > 0, done).otherwise(body).alias("__clean"))
    kind = dict(docs.dtypes)
    columns = [F.col("__clean").alias(c) if c == text else F.length("__clean").cast(kind[c]).alias(c) if c == length else F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
    return clean.select(*columns)


def _oracle() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": PATTERNS["phone"],
        "iban": PATTERNS["iban"],
        "ssn": PATTERNS["ssn"],
    }
    kinds = "\n  UNION ALL ".join(f"SELECT r, {o} AS o, '{k}' AS kind, t, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d" for o, (k, p) in enumerate(plain.items()))
    near = " OR ".join(f"kind = '{k}' AND (regexp_matches(before, '[^a-z](?:{words})(?:[^a-z]|$)') OR regexp_matches(after, '(?:^|[^a-z])(?:{words})[^a-z]'))" for k, (_, _, _, words) in SCORES.items())
    score = " ".join(f"WHEN '{k}' THEN {prior + check!r}::DOUBLE + CASE WHEN near THEN {bonus!r}::DOUBLE ELSE 0 END" for k, (prior, check, bonus, _) in SCORES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k AS (
  {kinds}),
e AS (SELECT r, o, kind, t, unnest(m) AS s, unnest(g[1:len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS i FROM k WHERE len(m) > 0),
p AS (SELECT *, CAST(sum(length(gap)) OVER w + sum(length(s)) OVER w - length(s) AS BIGINT) AS a FROM e WINDOW w AS (PARTITION BY r, o ORDER BY i)),
q AS (SELECT *, a + length(s) AS z, lower(CASE WHEN a > {NEAR} THEN substr(t, a - {NEAR}, {NEAR + 1}) ELSE ' ' || substr(t, 1, a) END) AS before, lower(substr(t, a + length(s) + 1, {NEAR + 1}) || ' ') AS after,
        regexp_replace(s, '[^0-9]', '', 'g') AS digits, replace(s, ' ', '') AS tight,
        CASE WHEN a > 0 THEN substr(t, a, 1) ELSE '' END || substr(t, a + length(s) + 1, 1) AS around FROM p),
ok AS (SELECT *, ({near}) AS near FROM q WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(s, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INTEGER), 0) > 255)) = 0
  WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN (length(digits) - i) % 2 = 0 THEN CAST(digits[i] AS INTEGER)
       ELSE CAST(digits[i] AS INTEGER) * 2 - CASE WHEN CAST(digits[i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
  WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
  WHEN 'iban' THEN NOT regexp_matches(around, '[A-Za-z0-9]') AND list_reduce(list_concat([0], list_transform(string_split(tight[5:] || tight[:4], ''),
       lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda x, y: CASE WHEN y > 9 THEN (x * 100 + y) % 97 ELSE (x * 10 + y) % 97 END) = 1
  ELSE NOT regexp_matches(around, '[A-Za-z0-9]') AND NOT regexp_matches(s, '^(?:000|666|9)|-00-|-0000$') END),
f AS (SELECT r, count(*) FILTER (kind = 'email') AS e, count(*) FILTER (kind = 'ip') AS i, count(*) FILTER (kind = 'card') AS c, count(*) FILTER (kind = 'phone') AS p,
        string_agg(kind || ':' || a || ':' || z, ',' ORDER BY o, a) FILTER (o < 4) AS b, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY o, a) AS s,
        string_agg(kind || ':' || a || ':' || printf('%.2f', score), ',' ORDER BY o, a) AS c2
      FROM (SELECT *, CASE kind {score} END AS score FROM ok) WHERE o < 4 OR score >= {ACCEPT} GROUP BY r)
SELECT doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans, coalesce(c2, '') AS scores
FROM d LEFT JOIN f USING (r)"""


ORACLE = _oracle()
