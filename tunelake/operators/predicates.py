"""Predicate operators: ``{field__op: value}`` to one Column.

The rules for missing and multi-valued attributes are in one place.  Positive operators hold if any value matches; negative
ones hold if all values match, and so for a missing attribute.  ``exact`` with None, 0 or '' also matches a missing one.
A field is looked up exactly, then without regard to case; ``a__b__c`` walks nested structs and arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

Test = Callable[[Column, object], Column]


def _text(v: Column) -> Column:
    return v.cast("string")


def _like(v: Column, q: object, flags: str = "(?iu)") -> Column:
    return _text(v).rlike(flags + str(q))


def _order(op: str) -> Test:
    def test(v: Column, q: object) -> Column:
        number = isinstance(q, (int, float)) and not isinstance(q, bool)
        left, right = (v.try_cast("double"), F.lit(float(q))) if number else (_text(v), F.lit(str(q)))
        return {"gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[op]

    return test


def _equal(v: Column, q: object) -> Column:
    if isinstance(q, bool):
        return v.try_cast("boolean") == F.lit(q)
    return v.try_cast("double") == F.lit(float(q)) if isinstance(q, (int, float)) else _text(v) == F.lit(str(q))


def _in(v: Column, q: object) -> Column:
    if isinstance(q, str):
        return F.lit(q).contains(_text(v))
    q = list(q)
    if q and all(isinstance(x, (int, float)) for x in q):
        return v.try_cast("double").isin(*[float(x) for x in q])
    return _text(v).isin(*[str(x) for x in q])


def _odd(v: Column, q: object) -> Column:
    odd = v.try_cast("double").cast("bigint") % 2 != 0
    return odd if q else ~odd


def _each(test: Callable[[Column, str], Column], q: object) -> Callable[[Column], Column]:
    def every(v: Column) -> Column:
        out = F.lit(True)
        for x in q:
            out = out & ~test(v, str(x).lower())
        return out

    return every


#: Operators that hold if any value matches.
POSITIVE: dict[str, Test] = {
    "exact": _equal,
    "eq": _equal,
    "is": lambda v, q: v.eqNullSafe(F.lit(q)),
    "iexact": lambda v, q: F.lower(_text(v)) == str(q).lower(),
    "ieq": lambda v, q: F.lower(_text(v)) == str(q).lower(),
    "lc": lambda v, q: F.lower(_text(v)) == str(q).lower(),
    "contains": lambda v, q: _text(v).contains(str(q)),
    "icontains": lambda v, q: F.lower(_text(v)).contains(str(q).lower()),
    "startswith": lambda v, q: _text(v).startswith(str(q)),
    "istartswith": lambda v, q: F.lower(_text(v)).startswith(str(q).lower()),
    "endswith": lambda v, q: _text(v).endswith(str(q)),
    "iendswith": lambda v, q: F.lower(_text(v)).endswith(str(q).lower()),
    "in": _in,
    "gt": _order("gt"),
    "gte": _order("gte"),
    "lt": _order("lt"),
    "lte": _order("lte"),
    "regex": lambda v, q: _like(v, q, ""),
    "sregex": lambda v, q: _like(v, q, ""),
    "iregex": _like,
    "like": lambda v, q: _like(v, str(q).replace(" ", ".*?")),
    "like_exact": _like,
    "is_odd": lambda v, q: _odd(v, q),
    "is_even": lambda v, q: _odd(v, not q),
}
#: Operators that hold if all values match.
NEGATIVE: dict[str, Test] = {
    "ne": lambda v, q: ~_equal(v, q),
    "not_in": lambda v, q: ~_in(v, q),
    "not_contains": lambda v, q: ~_text(v).contains(str(q)),
    "inot_contains": lambda v, q: ~F.lower(_text(v)).contains(str(q).lower()),
    "inot_contains_any": lambda v, q: _each(lambda v, x: F.lower(_text(v)).contains(x), q)(v),
    "inot_in": lambda v, q: ~F.lit(str(q).lower()).contains(F.lower(_text(v))),
    "inot_in_any": lambda v, q: (_text(v) != "") & _each(lambda v, x: F.lit(x).contains(F.lower(_text(v))), q)(v),
    "nsregex": lambda v, q: ~_like(v, q, ""),
    "not_like": _like,
}
NEGATIVE["not_like"] = lambda v, q: ~_like(v, q)
PRESENCE = ("exists", "notset")


def values(df: DataFrame, path: list[str]) -> Column | None:
    """All values of a path as an array without nulls, or None if there is no such attribute."""
    names = {c.lower(): c for c in reversed(df.columns)} | {c: c for c in df.columns}
    name = names.get(path[0]) or names.get(path[0].lower())
    if name is None:
        return None
    at, kind = F.col(f"`{name}`"), df.schema[name].dataType
    many = isinstance(kind, T.ArrayType)
    out = at if many else F.array(at)
    kind = kind.elementType if many else kind
    for step in path[1:]:
        if not isinstance(kind, T.StructType):
            return None
        inner = {f.name.lower(): f for f in kind.fields}.get(step.lower())
        if inner is None:
            return None
        take = lambda x, n=inner.name: x[n]
        nested = isinstance(inner.dataType, T.ArrayType)
        out = F.transform(out, _one(take))
        out = F.flatten(F.filter(out, _one(lambda x: x.isNotNull()))) if nested else out
        kind = inner.dataType.elementType if nested else inner.dataType
    return F.coalesce(F.filter(out, _one(lambda x: x.isNotNull())), F.array().cast(T.ArrayType(kind)))


def _one(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: f(x)


def split_key(key: str) -> tuple[list[str], str, bool]:
    """(path, operator, negated) of ``field__sub__not__op``; the operator is exact if none is named."""
    parts = key.split("__")
    op = "exact"
    known = {*POSITIVE, *NEGATIVE, *PRESENCE, "custom"}
    if len(parts) > 1 and (parts[-1] in known or parts[-1].startswith("not_") and parts[-1][4:] in known):
        op = parts.pop()
    negated = len(parts) > 1 and parts[-1] == "not"
    if negated:
        parts.pop()
    if op not in known:  # not_<op> without a rule of its own is the negation of <op>
        op, negated = op[4:], not negated
    return parts, op, negated


def predicate(df: DataFrame, key: str, q: object) -> Column:
    """The Column of one ``field__op`` and its value."""
    path, op, negated = split_key(key)
    if op == "custom":
        out = q(df)
        return F.coalesce(~out, F.lit(True)) if negated else out
    got = values(df, path)
    if got is None:
        got = F.array().cast("array<string>")
    simple = len(path) == 1 and not isinstance(df.select(got.alias("x")).schema["x"].dataType, T.NullType) and _plain(df, path[0])
    if op == "exists":
        out = F.size(got) > 0 if q else F.size(got) == 0
    elif op == "notset":
        out = F.size(got) == 0 if q else F.size(got) > 0
    elif simple is not None and simple is not False:
        v = simple
        if op in NEGATIVE:
            out = F.coalesce(NEGATIVE[op](v, q), F.lit(True))
        elif op in ("exact", "eq") and (q is None or q == 0 or q == ""):
            out = v.isNull() | (F.coalesce(POSITIVE[op](v, q), F.lit(False)) if q is not None else F.lit(False))
        else:
            out = POSITIVE[op](v, q)
    elif op in NEGATIVE:
        out = F.forall(got, _one(lambda v: F.coalesce(NEGATIVE[op](v, q), F.lit(True))))
    elif op in ("exact", "eq") and (q is None or q == 0 or q == ""):
        out = (F.size(got) == 0) | (F.exists(got, _one(lambda v: POSITIVE[op](v, q))) if q is not None else F.lit(False))
    else:
        out = F.exists(got, _one(lambda v: POSITIVE[op](v, q)))
    return F.coalesce(~out, F.lit(True)) if negated else out


def _plain(df: DataFrame, name: str) -> Column | bool:
    """The column itself where it isn't an array, so that the filter can be pushed into the scan."""
    names = {c.lower(): c for c in reversed(df.columns)} | {c: c for c in df.columns}
    found = names.get(name) or names.get(name.lower())
    if found is None or isinstance(df.schema[found].dataType, (T.ArrayType, T.StructType, T.MapType)):
        return False
    return F.col(f"`{found}`")


def where(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Rows for which all of the predicates hold."""
    for key, q in filters.items():
        df = df.filter(predicate(df, key, q))
    return df
