"""Album and track titles taken apart by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

KINDS = "Mini Album|Digital Single|Single Album|Special Album|Studio Album|Live Album|Album|Single|EP"
NUMBERED = rf"(?i)(?:[\[(]|-\s*The)\s*((?:[0-9]+(?:st|nd|rd|th)|First|Second|Third|Fourth|Fifth)\s+(?:Japanese\s+|Repackage\s+)*({KINDS}))\s*(?:[\])]|$)"
SUFFIX = rf"(?i)\s+-\s+({KINDS})$"
OST = r"(?i)(?<=\S\s)\bO\.?S\.?T\b\.?"
FEATURING = r"(?i)[\[(]\s*(?:feat|ft|featuring|with)\.?\s+([^\])]+)[\])]"
VERSION = r"(?i)[\[(]\s*([^\[\]()]*\bver(?:sion|\.)?)\s*[\])]"
REMIX = r"(?i)[\[(]\s*([^\[\]()]*\bre-?mix)\s*[\])]"
EDITION = r"(?i)[\[(]\s*([^\[\]()]*\bedition)\s*[\])]"
PART = r"(?i)\bpart\.?\s*([0-9]+)\s*$"


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, pattern, group)), F.lit(""))


def parse_album(c: Column) -> Column:
    """struct(name, num, type, edition, version, remix, feat, ost, part, repackage) of a title."""
    bare = c
    for pattern in (NUMBERED, SUFFIX, FEATURING, VERSION, REMIX, EDITION, r"(?i)[\[(]\s*repackage(?:d)?(?:\s+album)?\s*[\])]"):
        bare = F.regexp_replace(bare, pattern, "")
    bare = F.trim(bare)
    # a title that ends in a soundtrack's mark, its part, or other text in parentheses is a soundtrack's
    ost = bare.rlike(OST + r"(?:\s*-?\s*part\.?\s*[0-9]+)?(?:\s*\(.*\))?$")
    part = F.regexp_extract(bare, PART, 1).try_cast("int")
    name = F.when(ost, F.regexp_replace(bare, r"\s*-?\s*" + OST + ".*$", "")).otherwise(F.when(part.isNotNull(), F.regexp_replace(bare, PART, "")).otherwise(bare))
    singers = F.filter(F.split(F.coalesce(_first(c, FEATURING), F.lit("")), r"\s*(?:,|&)\s*"), lambda x: x != "")
    return F.struct(
        F.trim(F.regexp_replace(name, r"\s+", " ")).alias("name"),
        _first(c, NUMBERED).alias("num"),
        F.when(ost, "Soundtrack").otherwise(F.coalesce(_first(c, NUMBERED, 2), _first(c, SUFFIX))).alias("type"),
        _first(c, EDITION).alias("edition"),
        _first(c, VERSION).alias("version"),
        _first(c, REMIX).alias("remix"),
        singers.alias("feat"),
        ost.alias("ost"),
        part.alias("part"),
        c.rlike(r"(?i)\brepackage").alias("repackage"),
    )


def track_extras(c: Column) -> Column:
    """The kind of a title's last enclosed part: instrumental, acoustic, version, feature, remix, only, other, or null."""
    last = F.lower(F.regexp_extract(c, r"[\[(]([^\[\]()]*)[\])]\s*$", 1))
    kinds = (("instrumental", r"\binst(?:\.|rumental)?\b"), ("acoustic", "acoustic"), ("remix", r"re-?mix"), ("feature", r"^(?:feat|ft|with)\b"), ("version", r"\bver(?:\.|sion)?\b"), ("only", r"\bonly$"))
    out = F.when(last != "", "other")
    for name, pattern in reversed(kinds):
        out = F.when(last.rlike(pattern), name).otherwise(out)
    return out


def full_title(name: Column, *extras: Column) -> Column:
    """A name with its set extras in parentheses, in order."""
    return F.concat_ws(" ", name, *[F.concat(F.lit("("), x, F.lit(")")) for x in extras])


def intro_names(c: Column) -> Column:
    """The names in a page's first sentence: its beginning up to the verb, and what is given as another name."""
    first = F.regexp_extract(c, r"^(.*?[^.A-Z])(?:\.\s|$)", 1)
    subject = F.trim(F.regexp_extract(first, r"^(.+?)\s*(?:\(|,?\s+(?:is|are|was|were)\s)", 1))
    inside = F.split(F.regexp_replace(F.regexp_extract(first, r"\(([^()]*)\)", 1), r"(?i)\b(?:korean|japanese|chinese|lit|stylized as [^;,]*)\b\.?:?", ""), r"\s*[;,]\s*")
    known = F.split(F.regexp_extract(first, r"(?i)(?:also|better) known as\s+(.+?)(?:\)|,|\s+(?:is|are|was|were)\s|$)", 1), r"\s+or\s+")
    names = F.transform(F.concat(F.array(subject), inside, known), lambda x: F.trim(F.translate(x, "'\"()", "")))
    return F.array_distinct(F.filter(names, lambda x: (x != "") & ~x.rlike("(?i)^(?:also|better) known as")))


STATION = r"(?i)\s*(?:-|\bX)\s*SM STATION\s*$"
NETWORK = r"(?i)[\[(]\s*((?:KBS|MBC|SBS|tvN|JTBC|OCN|MBN|ENA|EBS)[0-9]?\b[^\[\]()]*)[\])]"
TOGETHER = r"(?i)[\[(]\s*with\.?\s+([^\])]+)[\])]"
REMASTER = r"(?i)[\[(]?\s*\bremaster(?:ed)?\b[^\[\]()]*[\])]?"


def album_name(c: Column) -> Column:
    """All that a title says, a struct of 16 fields: those of :func:`parse_album` and sm_station, remastered, network_info,
    part_name, collabs, song_name; name is the English or only part, and other_name what is enclosed beside it."""
    station, network = c.rlike(STATION), _first(c, NETWORK)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, STATION, ""), NETWORK, ""), TOGETHER, ""), REMASTER, "")
    bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    part_name = _first(bare, r"(?i)\bpart\.?\s*[0-9]+\s*(?:[-:]\s*|[\[(])\s*([^\[\]()]+?)\s*[\])]?\s*$")
    bare = F.trim(F.when(part_name.isNotNull(), F.regexp_replace(bare, r"(?i)(\bpart\.?\s*[0-9]+)\s*(?:[-:]\s*|[\[(]).*$", "$1")).otherwise(bare))
    p = parse_album(bare)
    both = r"^(.*?)\s*[\[(]([^\[\]()]+)[\])]\s*$"
    outer, inner = _first(p["name"], both, 1), _first(p["name"], both, 2)
    together = F.filter(F.split(F.coalesce(_first(c, TOGETHER), F.lit("")), r"\s*(?:,|&)\s*"), lambda x: x != "")
    song = F.when(p["ost"], _first(bare, OST + r"(?:\s*-?\s*part\.?\s*[0-9]+)?\s*[\[(]([^\[\]()]+)[\])]\s*$"))
    kept = ("num", "type", "edition", "version", "remix", "feat", "ost", "part", "repackage")
    return F.struct(
        F.coalesce(outer, p["name"]).alias("name"), inner.alias("other_name"), *[p[f].alias(f) for f in kept], station.alias("sm_station"),
        c.rlike(r"(?i)\bremaster").alias("remastered"), network.alias("network_info"), part_name.alias("part_name"), together.alias("collabs"), song.alias("song_name"),
    )


def ordered_parts(parts: Column) -> Column:
    """A name's parts: the English ones first, then those in other scripts, mixed ones last, each in their order."""
    latin, other = (lambda x: x.rlike(r"\p{IsLatin}")), (lambda x: x.rlike(r"[\p{L}&&[^\p{IsLatin}]]"))
    rank = lambda x: F.when(latin(x) & other(x), 2).when(other(x), 1).otherwise(0)
    ranked = F.array_sort(F.transform(parts, lambda x, i: F.struct(rank(x).alias("r"), i.alias("i"), x.alias("x"))))
    return F.transform(ranked, lambda s: s["x"])
