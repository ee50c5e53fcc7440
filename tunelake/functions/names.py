"""Names in several languages: struct(eng, non_eng, romanized, lit, versions), their merging and matching."""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tunelake.sources.catalog import checkpointed

from . import fuzzy
from .scalar import script
from .text import fuzz_process, weighted_ratio

FIELDS = ("eng", "non_eng", "romanized", "lit")
VERSIONS = "array<struct<eng:string,non_eng:string,romanized:string,lit:string>>"


def from_enclosed(c: Column) -> Column:
    """A name and its other spelling in parentheses, each put by its script: ``a (b)``."""
    outer, inner = F.trim(F.regexp_extract(c, r"^(.*?)\s*\(([^()]*)\)\s*$", 1)), F.trim(F.regexp_extract(c, r"^(.*?)\s*\(([^()]*)\)\s*$", 2))
    both = (inner != "") & (outer != "")
    latin = lambda x: F.coalesce(script(x) == "latin", F.lit(False))
    differ = both & (latin(outer) != latin(inner))
    eng = F.when(differ, F.when(latin(outer), outer).otherwise(inner)).otherwise(F.when(latin(c), c))
    non = F.when(differ, F.when(latin(outer), inner).otherwise(outer)).otherwise(F.when(~latin(c), c))
    none = F.lit(None).cast("string")
    return F.struct(eng.alias("eng"), non.alias("non_eng"), none.alias("romanized"), none.alias("lit"), F.array().cast(VERSIONS).alias("versions"))


def compatible(a: Column, b: Column) -> Column:
    """No field that both have differs, and one at least is shared."""
    differ, same = F.lit(False), F.lit(False)
    for f in FIELDS:
        x, y = F.lower(a[f]), F.lower(b[f])
        differ, same = differ | F.coalesce(x != y, F.lit(False)), same | F.coalesce(x == y, F.lit(False))
    return same & ~differ


def merge(a: Column, b: Column) -> Column:
    """Fields of a, else of b, if none conflicts; otherwise a with b among its versions."""
    conflict = F.lit(False)
    for f in FIELDS:
        conflict = conflict | F.coalesce(F.lower(a[f]) != F.lower(b[f]), F.lit(False))
    own = F.struct(*[b[f].alias(f) for f in FIELDS])
    versions = F.array_union(F.coalesce(a["versions"], F.array().cast(VERSIONS)), F.coalesce(b["versions"], F.array().cast(VERSIONS)))
    return F.struct(*[F.when(conflict, a[f]).otherwise(F.coalesce(a[f], b[f])).alias(f) for f in FIELDS], F.when(conflict, F.array_union(versions, F.array(own))).otherwise(versions).alias("versions"))


def from_parts(parts: Column) -> Column:
    """A name from its parts, each put by its script: the first in another script, the first English one, and a further English
    one as romanization where it spells the other script; ``versions`` stay empty and what has no place is left out."""

    @F.pandas_udf("struct<eng:string,non_eng:string,romanized:string,lit:string>")
    def make(c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([name_of(p) for p in c], columns=list(FIELDS))

    name = make(parts)
    return F.struct(*[name[f].alias(f) for f in FIELDS], F.array().cast(VERSIONS).alias("versions"))


def name_of(parts) -> tuple[str | None, str | None, str | None, str | None]:
    """(eng, non_eng, romanized, lit) of a name's parts."""
    eng = non = romanized = None
    for part in () if parts is None else parts:
        if not part:
            continue
        latin = not any(ord(c) > 0x2FF and c.isalpha() for c in part)
        if not latin and non is None:
            non = part
        elif latin and eng is None:
            eng = part
        elif latin and non and romanized is None and romanizes(non, part):
            romanized = part
        elif latin and non and romanized is None and romanizes(non, eng):
            eng, romanized = part, eng
    return eng, non, romanized, None


#: How the letters of a Hangul syllable may be spelled, in the order of their codes; fixed values.
INITIAL = "g|k,kk|gg|k,n,d|t,tt|dd|t,r|l,m,b|p,pp|bb|p,s|sh,ss|s,,j|ch,jj|j,ch|j,k,t,p,h".split(",")
VOWEL = "a|ah,ae|e,ya|yah,yae|ye,eo|u|o|uh,e|eh,yeo|yu|yo|you,ye,o|oh,wa,wae|oae,oe|we|wae,yo,u|oo|woo|wu,wo|weo,we,wi|ui|we,yu|yoo|you,eu|u,ui|eui|ee|i,i|ee|y|yi".split(",")
FINAL = ",g|k,g|k,g|k,n,n,n,d|t,l|r,g|k,m,l,l,l,p,l,m,b|p,b|p,d|t,d|t,ng,d|t,d|t,k|g,d|t,p|b,|h".split(",")
#: The consonants of a spelling, where letters that may stand for each other are one; all others go.
SOUNDS = dict(zip("gkqdtbpsjrlmn", "KKKTTPPSJLLMN", strict=True))


def spelled(text: str) -> str:
    """Lower-case letters and digits only."""
    return "".join(c for c in text.lower() if c.isalnum())


@functools.lru_cache(1 << 16)
def squeezed(text: str) -> str:
    """A spelling to compare: folded, without blanks."""
    return fuzz_process(text).replace(" ", "")


def romanizes(non_eng: str, eng: str) -> bool:
    """Whether the English text spells the Hangul one, letter by letter."""
    own = spelled(non_eng)
    if not any("가" <= c <= "힣" for c in own):
        return False
    if sounds(own) != sounds(eng):
        return False
    rule = ""
    for c in own:
        if "가" <= c <= "힣":
            code = ord(c) - 0xAC00
            rule += "".join(f"(?:{x})" for x in (INITIAL[code // 588], VOWEL[code % 588 // 28], FINAL[code % 28]))
        else:
            rule += re.escape(c)
    return re.fullmatch(rule, spelled(eng)) is not None


def sounds(text: str) -> str:
    """The consonants of a text in classes: equal for a Hangul text and every spelling of it."""
    out = ""
    for c in text.lower():
        if "가" <= c <= "힣":
            code = ord(c) - 0xAC00
            out += "".join(x.split("|")[0] for x in (INITIAL[code // 588], FINAL[code % 28])).replace("ch", "j")
        else:
            out += c
    out = "".join(SOUNDS.get(c, "") for c in out.replace("ch", "j"))
    return "".join(c for k, c in enumerate(out) if not k or out[k - 1] != c)


def _rated(x: str, y: str, least: int) -> int:
    """The weighted ratio of two squeezed texts; 0 where their lengths or letters alone keep it below the least, of ``fuzzy.LEAST`` or more."""
    if least >= fuzzy.LEAST and x and y:
        if 2 * max(len(x), len(y)) >= 3 * min(len(x), len(y)):
            return 0
        shared = sum(min(x.count(c), y.count(c)) for c in set(x))
        if 200 * shared < (least - 1) * (len(x) + len(y)):
            return 0
    return weighted_ratio(x, y)


def scores(a: dict, b: dict, romanized: int = 95, ost: bool = True, least: int = 0) -> list[int]:
    """Every score of two names and of their versions, 0 to 100.

    Spellings in the same script by the weighted ratio (averaged with the English parts' where they are equal), English ones
    likewise, ``romanized`` where one spells the other, and all that again without a soundtrack suffix.  least: lower scores may be
    told as 0.
    """
    out, english = [], None
    if a["non_eng"] and b["non_eng"] and _script(a["non_eng"]) == _script(b["non_eng"]):
        found = _rated(squeezed(a["non_eng"]), squeezed(b["non_eng"]), least)
        if found == 100 and a["eng"] and b["eng"]:
            english = weighted_ratio(squeezed(a["eng"]), squeezed(b["eng"]))
            found = (found + english) // 2
        out.append(found)
    if a["eng"] and b["eng"]:
        out.append(_rated(squeezed(a["eng"]), squeezed(b["eng"]), least))
    for x, y in ((a, b), (b, a)):
        other = y["eng"] or y["romanized"]
        if other and (x["romanized"] and spelled(x["romanized"]) == spelled(other) or x["non_eng"] and romanizes(x["non_eng"], other)):
            out.append(romanized if english is None else (romanized + english) // 2)
    for x, y in ((a, b), (b, a)):
        for version in (x.get("versions") if x.get("versions") is not None else ()):
            out += scores({**version, "versions": ()}, {**y, "versions": () if x is b else y.get("versions")}, romanized, ost, least)
    if ost:
        for x, y in ((a, b), (b, a)):
            if any(v and v.lower().endswith(" ost") for v in map(x.get, FIELDS)):
                bare = {f: x[f][:-4].strip() if x[f] and x[f].lower().endswith(" ost") else x[f] for f in FIELDS}
                return out + scores({**bare, "versions": x.get("versions")}, y, romanized, False, least)
    return out


def _script(text: str) -> str:
    return "hangul" if any("가" <= c <= "힣" for c in text) else "kana" if any("\u3040" <= c <= "\u30ff" for c in text) else "other"


def score(a: dict, b: dict) -> int:
    """The best score, or 0."""
    return max(scores(a, b), default=0)


def equal_fields(a: Column, b: Column) -> list[Column]:
    """For each field whether both names have the same; null where one lacks it."""
    return [F.lower(a[f]) == F.lower(b[f]) for f in FIELDS]


def is_version_of(a: Column, b: Column, partial: bool = False) -> Column:
    """One field at least is the same, and unless partial none that both have differs."""
    same, differ = F.lit(False), F.lit(False)
    for e in equal_fields(a, b):
        same, differ = same | F.coalesce(e, F.lit(False)), differ | F.coalesce(~e, F.lit(False))
    return same if partial else same & ~differ


def should_merge(a: Column, b: Column) -> Column:
    """A version of the other, and not the same name."""
    equal = F.lit(True)
    for f in FIELDS:
        equal = equal & a[f].eqNullSafe(b[f])
    return is_version_of(a, b) & ~equal


def squeezings(name: dict) -> list[str]:
    """Each spelling of a name without blanks, and without a soundtrack suffix."""
    out: dict[str, None] = {}
    for f in ("eng", "non_eng", "romanized"):
        if name[f]:
            bare = name[f][:-4].strip() if name[f].lower().endswith(" ost") else name[f]
            out |= dict.fromkeys(x for x in (squeezed(name[f]), squeezed(bare)) if x)
    return list(out)


def match_keys(name: dict, threshold: int, counts: np.ndarray | None = None) -> set[tuple[str, int]]:
    """(key, length of its spelling): names that score the threshold share a key.

    Spellings are compared without blanks, as one word.  From ``fuzzy.LEAST`` on the keys are sets of the rarest letter pairs by the counts, so
    many that no pair is lost; lower thresholds take single letters, which any ratio over 0 shares.  A Hangul text meets what
    spells it by its consonants, at any length: its key is marked as such, since two others needn't meet by them.
    """
    out = set()
    for text in squeezings(name):
        keys = fuzzy.prefix_keys([text], threshold, counts) if threshold >= fuzzy.LEAST else set(text)
        out.update((k, len(text)) for k in keys)
    for f in ("eng", "non_eng", "romanized"):
        if name[f]:
            bare = name[f][:-4].strip() if name[f].lower().endswith(" ost") else name[f]
            for x in (name[f], bare):
                out.add(("~" + sounds(x), -1 if _script(x) == "hangul" else 0))
                out.add(("=" + spelled(x), 0))
    return out


def counted(*frames: DataFrame, name: str = "name") -> np.ndarray:
    """How often the letter pairs of the names' spellings occur, by bucket."""

    @F.pandas_udf("array<int>")
    def buckets(c: pd.DataFrame) -> pd.Series:
        return pd.Series([[fuzzy.bucket(g) for text in squeezings(x) for g in fuzzy.letter_pairs([text])] for x in c.to_dict("records")], dtype=object)

    return fuzzy.totals(*[df.select(buckets(_plain(name)).alias("b")) for df in frames])


def _plain(name: str) -> Column:
    return F.struct(*[F.col(f"{name}.{f}").alias(f) for f in FIELDS])


def keyed(df: DataFrame, threshold: int, name: str = "name", counts: np.ndarray | None = None) -> DataFrame:
    """A row for each match key of each name: the columns, ``__k`` and ``__len``."""
    shared = None if counts is None else df.sparkSession.sparkContext.broadcast(counts)

    @F.pandas_udf("array<struct<k:string,n:int>>")
    def make(c: pd.DataFrame) -> pd.Series:
        return pd.Series([[{"k": k, "n": n} for k, n in sorted(match_keys(x, threshold, shared and shared.value))] for x in c.to_dict("records")], dtype=object)

    return df.withColumn("__x", F.explode(make(_plain(name)))).select(*df.columns, F.col("__x.k").alias("__k"), F.col("__x.n").alias("__len"))


def lengths_fit(a: Column, b: Column, threshold: int) -> Column:
    """Lengths of spellings that can score the threshold; of two with the same consonants one must be Hangul."""
    near = 2 * F.greatest(a, b) <= 3 * F.least(a, b) if threshold >= fuzzy.LEAST else F.lit(True)
    return F.when((a > 0) & (b > 0), near).otherwise((a < 0) | (b < 0) | F.col("__k").startswith("="))


def _hashable(df: pd.DataFrame) -> list[tuple]:
    """The fields of each name and its versions."""
    versions = [None if v is None or not len(v) else tuple(tuple(x.get(f) for f in FIELDS) for x in v) for v in df["versions"]] if "versions" in df else [None] * len(df)
    return list(zip(*[df[f].tolist() for f in FIELDS], versions, strict=True))


@functools.lru_cache(1 << 16)
def _score(a: tuple, b: tuple, least: int = 0) -> int:
    x, y = (dict(zip(FIELDS, n)) | {"versions": [dict(zip(FIELDS, v)) for v in n[4] or ()]} for n in (a, b))
    return max(scores(x, y, least=least), default=0)


@F.pandas_udf(T.IntegerType())
def score_udf(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
    """Pairs that occur again are remembered, up to a number; a name without spellings scores 0."""
    none = (None,) * 5
    return pd.Series([0 if x == none or y == none else _score(x, y) for x, y in zip(_hashable(a), _hashable(b), strict=True)], dtype="int32")


def reaches(a: Column, b: Column, threshold: int) -> Column:
    """Whether the names score the threshold; a name without spellings doesn't."""

    @F.pandas_udf(T.BooleanType())
    def test(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        none = (None,) * 5
        return pd.Series([x != none and y != none and _score(x, y, threshold) >= threshold for x, y in zip(_hashable(a), _hashable(b), strict=True)], dtype=bool)

    return test(a, b)


def any_reaches(a: Column, b: Column, threshold: int) -> Column:
    """Whether a name of one list scores the threshold with one of the other."""
    own = lambda xs: [] if xs is None else [n for x in xs if x is not None for n in [(*(x[f] for f in FIELDS), None)] if any(n)]

    @F.pandas_udf(T.BooleanType())
    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([any(_score(x, y, threshold) >= threshold for x in own(p) for y in own(q)) for p, q in zip(a, b, strict=True)], dtype=bool)

    return test(a, b)


def best_match(left: DataFrame, right: DataFrame, id_left: str, id_right: str, name: str = "name", threshold: int = 90) -> DataFrame:
    """For each left row its best right row by the score of the names or of any of their versions."""
    best = lambda pairs: pairs.groupBy(id_left).agg(F.min(F.struct((-F.col("score")).alias("s"), f"{id_right}_match")).alias("b")).select(id_left, f"b.{id_right}_match", (-F.col("b.s")).alias("score"))
    if threshold >= 100:
        return best(best_matches(left, right, id_left, id_right, name, threshold))
    # nothing is over 100, and few pairs come near it: what scores that needs no other candidates
    top = checkpointed(best(best_matches(left, right, id_left, id_right, name, 100)))
    rest = left.join(top.select(F.col(id_left).alias("__top")), F.col(id_left) == F.col("__top"), "left_anti")
    return top.unionByName(best(best_matches(rest, right, id_left, id_right, name, threshold)))


def best_matches(left: DataFrame, right: DataFrame, id_left: str, id_right: str, name: str = "name", threshold: int = 90) -> DataFrame:
    """(left id, right id, score) of all pairs whose names, or any of their versions, score the threshold.

    Names that are equal are one; candidates come from an equi-join on the match keys, which no pair that scores the threshold
    escapes, and each pair of names is scored once.  Left rows of equal names and versions are one class, which meets the right
    rows once; its result is joined with its rows last.
    """

    def named(df: DataFrame, key: Column, side: str) -> DataFrame:
        every = F.concat(F.array(_plain(name)).cast(VERSIONS), F.coalesce(F.col(f"{name}.versions"), F.array().cast(VERSIONS)))
        return df.select(key.alias(side), F.explode(every).alias(f"{side}_name")).withColumn(f"{side}_json", F.to_json(f"{side}_name"))

    spelled = F.to_json(name)
    classes = left.filter(F.col(name).isNotNull()).groupBy(spelled.alias("__c")).agg(F.first(name).alias(name))
    sides = {"l": named(classes, F.col("__c"), "l"), "r": named(right, F.col(id_right), "r")}
    # few bytes make many keys and scores: their number of tasks is given, not found by size
    tasks = left.sparkSession.sparkContext.defaultParallelism * 4
    own = {s: df.groupBy(f"{s}_json").agg(F.first(f"{s}_name").alias("name")).repartition(tasks, f"{s}_json") for s, df in sides.items()}
    counts = counted(*own.values()) if threshold >= fuzzy.LEAST else None
    keys = {s: keyed(df, threshold, counts=counts).select(F.col(f"{s}_json"), F.col("name").alias(f"{s}_name"), "__k", F.col("__len").alias(f"{s}_len")) for s, df in own.items()}

    def meeting(side: str) -> DataFrame:
        """Keys by consonants only for pairs of which one is Hangul at least: other texts have few of them, and many share one."""
        mixed = {"l": ("hangul first", "hangul last"), "r": ("hangul last", "hangul first")}[side]
        way = F.when(~F.col("__k").startswith("~"), F.array(F.lit(""))).when(F.col(f"{side}_len") < 0, F.array(F.lit("hangul"), F.lit(mixed[0]))).otherwise(F.array(F.lit(mixed[1])))
        return keys[side].withColumn("__way", F.explode(way))

    pairs = meeting("l").join(meeting("r"), ["__k", "__way"]).filter(lengths_fit(F.col("l_len"), F.col("r_len"), threshold)).groupBy("l_json", "r_json").agg(F.first("l_name").alias("l_name"), F.first("r_name").alias("r_name"))
    scored = pairs.repartition(tasks, "l_json", "r_json").withColumn("score", score_udf("l_name", "r_name")).filter(F.col("score") >= threshold).select("l_json", "r_json", "score")
    met = scored.join(sides["l"].select("l", "l_json"), "l_json").join(sides["r"].select("r", "r_json").distinct(), "r_json").groupBy("l", "r").agg(F.max("score").alias("score"))
    rows = left.select(F.col(id_left).alias("__id"), spelled.alias("l")).distinct().join(met, "l")
    return rows.groupBy("__id", "r").agg(F.max("score").alias("score")).select(F.col("__id").alias(id_left), F.col("r").alias(f"{id_right}_match"), "score")
