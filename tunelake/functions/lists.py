"""Artist lists as rows: a table function for SQL and lateral joins."""

from __future__ import annotations

import functools
import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .text import CLOSED_BY, partition_enclosed, split_balanced

COLUMNS = "pos: int, eng: string, non_eng: string, group_eng: string, group_non_eng: string, members: array<string>"
#: What separates artists; an ``x`` only where both sides are more than that.
BETWEEN = r"\s*[;,]\s*|\s+&\s+|\s+and\s+(?=[A-Z])|\s+[xX]\s+(?=\S)"


def latin(text: str) -> bool:
    return not any(ord(c) > 0x2FF and c.isalpha() for c in text)


def enclosed(text: str) -> tuple[str, list[str]]:
    """What stands before the enclosed parts that end the text, and these."""
    head, parts = text.strip(), []
    while head and head[-1] in CLOSED_BY_END and (p := partition_enclosed(head, reverse=True)) and not p[2] and p[0]:
        parts.insert(0, p[1])
        head = p[0]
    return head, parts


CLOSED_BY_END = {c for closers in CLOSED_BY.values() for c in closers}


class Entry:
    """A name by script, its group by script, and members."""

    def __init__(self, text: str):
        head, parts = enclosed(text)
        self.name, self.group, self.members = {latin(head): head}, {}, []
        for part in parts:
            items = split_balanced(part, BETWEEN)
            if len(items) > 1:
                self.members += [Entry(i).shown() for i in items]
                continue
            self.add(Entry(part), latin(head))

    def add(self, other: Entry, script: bool) -> None:
        """An enclosed name: the other spelling, which may bring the group's, or else the group."""
        own = next(iter(other.name))
        if own != script and own not in self.name:
            self.name |= other.name
            for s, g in other.group.items():
                self.group.setdefault(s, g)
        else:
            for s, g in (other.name | {s: n for s, n in other.group.items() if s not in other.name}).items():
                self.group.setdefault(s, g)
        self.members += other.members

    def zipped(self, other: Entry) -> None:
        """The same artist in another script."""
        for s, n in other.name.items():
            self.name.setdefault(s, n)
        for s, g in other.group.items():
            self.group.setdefault(s, g)
        self.members += other.members

    def shown(self) -> str:
        return self.name.get(True) or self.name.get(False)

    def row(self, pos: int) -> tuple:
        return pos, self.name.get(True), self.name.get(False), self.group.get(True), self.group.get(False), self.members


@functools.lru_cache(1 << 14)
def entries(text: str | None) -> list[tuple]:
    """The rows of a list; a last enclosed part with as many names as stand before it spells them in another script."""
    items = split_balanced((text or "").strip(), BETWEEN)
    if not items:
        return []
    head, parts = enclosed(items[-1])
    second = split_balanced(parts[-1], BETWEEN) if parts else []
    if len(items) > 1 and len(second) == len(items):
        last = re.sub(r"\s+$", "", items[-1][: items[-1].rindex(parts[-1]) - 1])
        found = [Entry(i) for i in [*items[:-1], last]]
        for entry, other in zip(found, second, strict=True):
            entry.zipped(Entry(other))
    else:
        found = [Entry(i) for i in items]
    return [e.row(k) for k, e in enumerate(found, 1)]


@udtf(returnType=COLUMNS, useArrow=True)
class ArtistList:
    """``artist_list(text)``: a row for each artist of a list: its place, spellings, group and members; none for null or empty."""

    def eval(self, text: str):
        yield from entries(text)


def register(spark: SparkSession, name: str = "artist_list") -> str:
    """Makes the table function known to SQL: ``SELECT t.id, a.* FROM t, LATERAL artist_list(t.text) a``."""
    spark.udtf.register(name, ArtistList)
    return name
