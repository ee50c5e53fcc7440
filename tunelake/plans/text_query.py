"""A line of text to predicates: ``title words artist~iu rating>=6 year!=2000``."""

from __future__ import annotations

import re

from tunelake.operators.predicates import NEGATIVE, POSITIVE, PRESENCE

ALIASES = {"rating": "user_rating", "userrating": "user_rating", "key": "key"}
COMPARE = {">=": "gte", "<=": "lte", "==": "exact", "!=": "not_exact", ">": "gt", "<": "lt", "=": "exact", "~": "like", "!~": "not_like"}
INSTRUMENTAL = r"inst(?:\.?|rumental)"
WORDS = "|".join(sorted({*POSITIVE, *NEGATIVE, *PRESENCE}, key=len, reverse=True))
PAIR = re.compile(
    rf"""(?P<key>[A-Za-z]+)\s*(?:(?P<sign>!~|>=|<=|==|!=|>|<|=|~)\s*|\s(?P<no>NOT\s+|!)?(?P<op>{WORDS})\s+)
        (?P<value>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^\s!=~<>"']+(?:\s+(?![A-Za-z]+\s*(?:!~|[!=~<>])|[A-Za-z]+\s+(?:NOT\s+|!)?(?:{WORDS})\s)[^\s!=~<>"']+)*)""",
    re.VERBOSE | re.IGNORECASE,
)


class InvalidQuery(ValueError):
    """The text isn't a query."""


def _value(raw: str) -> object:
    if raw[0] in "\"'":
        return re.sub(r"\\(.)", r"\1", raw[1:-1])
    raw = " ".join(raw.split())
    for kind in (int, float):
        try:
            return kind(raw)
        except ValueError:
            pass
    return raw


def resolve(key: str) -> str:
    """The column that a name stands for, its operator kept."""
    name, sep, op = key.partition("__")
    return ALIASES.get(name.lower(), name) + sep + op


def parse(text: str, escape: str = "()", allow_inst: bool = False, title: str | None = None) -> dict[str, object]:
    """{field__op: value}; a title goes to ``title__icontains``, or to ``title__like`` if it has unescaped regex marks."""
    out: dict[str, object] = {}
    at, text = 0, text.strip()
    while at < len(text):
        m = PAIR.match(text, at)
        if not m:
            raise InvalidQuery(f"unexpected text at {at}: {text[at : at + 20]!r}")
        value = _value(m["value"])
        op = COMPARE[m["sign"]] if m["sign"] else ("not_" if m["no"] else "") + m["op"].lower()
        if "like" in op or "regex" in op:
            value = "".join("\\" + c if c in escape else c for c in str(value))
        elif op.removeprefix("not_") in ("contains", "icontains", "startswith", "endswith", "istartswith", "iendswith"):
            value = str(value)
        key = resolve(f"{m['key']}__{op}")
        if key in out and out[key] != value:
            raise InvalidQuery(f"{key} is given twice")
        out[key] = value
        at = m.end() + len(text[m.end() :]) - len(text[m.end() :].lstrip())
    if title and title != ".*":
        plain = title if not escape else re.sub(f"[{re.escape(escape)}]", "", title)
        op = "title__like" if re.search(r"[\[\]{}()^$.+*?|\\]", plain) else "title__icontains"
        out[op] = "".join("\\" + c if c in escape else c for c in title) if op == "title__like" else title
    if not allow_inst:
        out.setdefault("title__not_like", INSTRUMENTAL)
    return out


def merge_in(a: dict[str, object], b: dict[str, object], union: bool = False) -> dict[str, object]:
    """Filters of both; two ``__in`` sets of the same field are intersected, or united."""
    out = dict(a)
    for key, q in b.items():
        if key in out and key.endswith("__in"):
            out[key] = sorted(set(out[key]) | set(q) if union else set(out[key]) & set(q), key=str)
        elif key in out and out[key] != q:
            raise InvalidQuery(f"{key} is given twice")
        else:
            out[key] = q
    return out
