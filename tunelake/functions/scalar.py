"""Scalar functions that the built-in expressions can say: dates, ratings, paths, titles, durations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DATE_FORMATS = ("yyyy-MM-dd", "yyyy.MM.dd", "yyyyMMdd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "yyyy-MM", "yyyy")
# Words that a title has in lower case, and ordinals from 1 on.
SMALL_WORDS = ("an", "to", "in", "a", "by", "the", "and", "but", "for", "at", "of")
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth")
LANGUAGES = {"chn": "Chinese", "jp": "Japanese", "jap": "Japanese", "kor": "Korean", "eng": "English"}


def parse_date(c: Column) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)).cast("date") for f in DATE_FORMATS])


# Of each whole star the first and last file rating, and the one that is written for it.
RATINGS = ((1, 31, 15), (32, 95, 64), (96, 159, 128), (160, 223, 196), (224, 255, 255))


def stars_from_256(c: Column, out_of: int = 5) -> Column:
    """A file's rating of 0-255 as 1-5 stars, or 1-10 half stars; 0 is unrated; null beyond the range.

    A half star is added above the rating that is written for a whole one, and 1 is left below that of the first star.
    """
    out = F.lit(None).cast("int")
    for k, (low, high, written) in enumerate(RATINGS, 1):
        ten = 2 * k + (c > written).cast("int")
        value = F.lit(k) if out_of == 5 else F.when(c < written, 1).otherwise(ten) if k == 1 else ten
        out = F.when(c.between(low, high), value).otherwise(out)
    return out


def stars_to_256(c: Column, out_of: int = 10) -> Column:
    """1-10 half stars (or 1-5 stars) as a file's rating: a half star is one more than the whole one below; 0 gives null."""
    out = F.lit(None).cast("int")
    for k, (_, _, written) in enumerate(RATINGS, 1):
        if out_of == 5:
            out = F.when(c == k, written).otherwise(out)
        else:
            out = F.when(c == 2 * k, written).when((c == 2 * k + 1) & F.lit(k < 5), written + 1).otherwise(out)
    return out if out_of == 5 else F.when(c == 1, 1).otherwise(out)


def stars(c: Column) -> Column:
    """Ten half stars as text: full, half, empty."""
    full = F.floor(c / 2).cast("int")
    half = (c % 2).cast("int")
    return F.concat(F.repeat(F.lit("★"), full), F.repeat(F.lit("½"), half), F.repeat(F.lit("✰"), F.lit(5) - full - half))


def duration(ms: Column) -> Column:
    """Milliseconds as [D]d HH:MM:SS, days only if there are any."""
    s = F.floor(ms / 1000)
    clock = F.format_string("%02d:%02d:%02d", F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.when(s >= 86400, F.concat(F.lit("("), F.floor(s / 86400).cast("string"), F.lit(")d "), clock)).otherwise(clock)


def readable_size(n: Column) -> Column:
    """Bytes with a binary unit and two decimals."""
    out = F.concat(F.format_string("%d", n.cast("bigint")), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.format_string("%.2f", n / 1024**k), F.lit(f" {unit}"))).otherwise(out)
    return out


def sanitize_path(c: Column) -> Column:
    """Marks that paths can't have go or are replaced."""
    return F.translate(F.translate(c, "/:\\|", "_-_-"), '*;?<>"', "")


def safe_path(*parts: Column) -> Column:
    return F.concat_ws("/", *[sanitize_path(p) for p in parts])


def ordinal(n: Column) -> Column:
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def find_ordinal(c: Column) -> Column:
    """The first ordinal in a text, by word up to twentieth (debut is the first) or by number up to 20; null without one."""
    numbers = [f"{n}{'th' if 11 <= n <= 13 else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}" for n in range(1, 21)]
    found = F.regexp_extract(F.lower(c), f"(debut|{'|'.join(ORDINALS)}|{'|'.join(numbers)})", 1)
    out = F.when(found == "debut", 1)
    for n, pair in enumerate(zip(ORDINALS, numbers, strict=True), 1):
        out = out.when(found.isin(*pair), n)
    return out


def title_case(c: Column) -> Column:
    """Words capitalised, small words only at the beginning; what is between words stays."""
    parts = F.split(c, r"(?U)(?<=\w)(?=\W)|(?<=\W)(?=\w)", -1)
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10**6)))

    def cased(p: Column) -> Column:
        first = F.when(F.get(p, F.lit(0)).rlike(r"(?U)^\w"), 0).otherwise(1)
        return F.transform(p, lambda w, i: F.when((i > first) & F.lower(w).isin(*SMALL_WORDS), F.lower(w)).otherwise(capital(w)))

    return F.array_join(F.transform(F.array(parts), cased)[0], "")


def normalize_case(c: Column) -> Column:
    """Capital words if the text has a run of capitals or no capital at all, unless it is ``ost``."""
    plain = F.trim(F.regexp_replace(c, r"\s+", " "))
    caps = F.array_join(F.transform(F.split(plain, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))), " ")
    return F.when((F.lower(c) != "ost") & (c.rlike("[A-Z]{2,}") | (F.lower(c) == c)), caps).otherwise(c)


def clean_title(c: Column, rate: Column | None = None) -> Column:
    """A title without its ``(NN kHz)``, unless that is all of it or names another rate."""
    mark = r"\s*\(([0-9]+(?:\.[0-9]+)?)\s*[kK][hH][zZ]\)"
    short = F.trim(F.regexp_replace(c, mark, ""))
    ok = short != ""
    if rate is not None:
        ok = ok & (F.regexp_extract(c, mark, 1).try_cast("double") * 1000 == rate)
    return F.when(c.rlike(mark) & F.coalesce(ok, F.lit(False)), short).otherwise(c)


def strip_url(c: Column) -> Column:
    """Lyrics without the address at their end."""
    return F.regexp_replace(c, r"(?s)\s*https?://[^\s]+\s*$", "")


def album_part(c: Column) -> Column:
    """(title, part) of a name that ends in ``Part N`` or ``Code No N``."""
    mark = r"(?i)^(.*?)[\s,:-]*(?:part|code no)\.?\s*([0-9]+)$"
    return F.when(c.rlike(mark), F.struct(F.trim(F.regexp_extract(c, mark, 1)).alias("title"), F.regexp_extract(c, mark, 2).cast("int").alias("part"))).otherwise(F.struct(c.alias("title"), F.lit(None).cast("int").alias("part")))


def file_title(path: Column) -> Column:
    """A file's name without its folder, number and suffix."""
    return F.regexp_extract(path, r"(?:^|/)(?:[0-9]+(?:-[0-9]+)?\.?\s+)?([^/]*?)(?:\.[A-Za-z0-9]+)?$", 1)


def first_number(c: Column) -> Column:
    """The first whole number of ``n/m``, ``n,m`` or ``(n, m)``; 0 without one."""
    return F.coalesce(F.regexp_extract(c, r"^\s*\(?\s*([0-9]+)", 1).try_cast("int"), F.lit(0))


def glob_to_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression."""
    import fnmatch

    return fnmatch.translate(pattern).replace("\\Z", "$").replace("\\z", "$").replace("(?s:", "(?s:")


def script(c: Column) -> Column:
    """The script category of a text: hangul, japanese, chinese, latin, mixed or null."""
    has = {k: c.rlike(v) for k, v in (("hangul", r"\p{IsHangul}"), ("japanese", r"[\p{IsHiragana}\p{IsKatakana}]"), ("chinese", r"\p{IsHan}"), ("latin", r"\p{IsLatin}"))}
    n = sum(h.cast("int") for h in has.values())
    out = F.when(has["japanese"] & ~has["latin"] & ~has["hangul"], "japanese").when(n > 1, "mixed")
    for k, h in has.items():
        out = out.when(h, k)
    return out


def expand_language(c: Column) -> Column:
    """Abbreviations of languages in full."""
    for short, full in LANGUAGES.items():
        c = F.regexp_replace(c, rf"(?i)\b{short}\b\.?", full)
    return c


def int_words(c: Column) -> Column:
    """English number words as a number; null for other words."""
    ones = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    tens = "twenty thirty forty fifty sixty seventy eighty ninety".split()
    small = {w: i for i, w in enumerate(ones)} | {w: 10 * i for i, w in enumerate(tens, 2)}
    large = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}
    value = F.create_map(*[x for w, n in {**small, "hundred": 100, **large}.items() for x in (F.lit(w), F.lit(n).cast("bigint"))])
    words = F.filter(F.split(F.lower(c), r"[\s,-]+"), lambda w: (w != "") & (w != "and"))
    zero = F.struct(F.lit(0).cast("bigint").alias("done"), F.lit(0).cast("bigint").alias("now"), F.lit(True).alias("ok"))

    def step(a: Column, w: Column) -> Column:
        v = F.try_element_at(value, w)
        now = F.when(v >= 1000, F.lit(0)).when(v == 100, F.greatest(a["now"], F.lit(1)) * 100).otherwise(a["now"] + F.coalesce(v, F.lit(0)))
        done = F.when(v >= 1000, a["done"] + F.greatest(a["now"], F.lit(1)) * v).otherwise(a["done"])
        return F.struct(done.cast("bigint").alias("done"), now.cast("bigint").alias("now"), (a["ok"] & v.isNotNull()).alias("ok"))

    return F.coalesce(F.trim(c).try_cast("bigint"), F.when(F.size(words) > 0, F.aggregate(words, zero, step, lambda a: F.when(a["ok"], a["done"] + a["now"]))))


def map_path(c: Column, strip: str, root: str) -> Column:
    """A server's path below another root; null if it isn't below the server's."""
    below = strip.rstrip("/")
    rest = F.substr(c, F.lit(len(below) + 1))
    return F.when(c.startswith(below) & ((rest == "") | rest.startswith("/")), F.concat(F.lit(root.rstrip("/") + "/"), F.ltrim(rest, F.lit("/"))))


def repair_date(date: Column, user_defined: Column) -> Column:
    """The date, or a user-defined one where it is missing or blank."""
    return F.coalesce(F.nullif(F.trim(date), F.lit("")), F.nullif(F.trim(user_defined), F.lit("")))


def single(values: Column) -> Column:
    """The value of a tag that has exactly one, else null."""
    return F.when(F.size(values) == 1, values[0])


def escape_space(c: Column) -> Column:
    """Escaped white space for display."""
    return F.replace(F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
