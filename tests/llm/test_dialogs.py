import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from tunelake.llm import dialogs

SCHEMA = "conv_id long, turn long, role string, text string, conv string, seg int, n long, copies long"


def naive(rows):
    text = lambda x: " " if x is None else str(x)
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, say in (r for r in rows if r[0] == conv):
            k = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
            role, say = text(role), text(say)
            say = "" if k == 1 else re.sub("[.!?]", "", say) if k == 2 else say
            own += [(turn, "user" if k == 4 else role, say)] * (0 if k == 0 else 2 if k == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, say in own:
            bare = say.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, say) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, say))
        turns = {t for t, _, _ in own if t is not None}
        cost, edits, lines = least([(r, s, f) for (_, r, s), f in zip(own, faults)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def least(rows):
    """Least (cost, initials, lines): dynamic programming over (cost, initials) with the states spelled out."""
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    full = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(4):
            for q, to in follow.items():
                for letter, r in to.items():
                    if letter in full and r in best:
                        c, e, t = best[r]
                        best[q] = min(best.get(q, (c + 2, "I" + e, (full[letter] + ":", *t))), (c + 2, "I" + e, (full[letter] + ":", *t)))
        return best

    best = inserted({"": (0, "", ()), "a": (0, "", ())})
    for role, text, fault in reversed(rows):
        now, extra = {}, int(fault == "truncated")
        for q in follow:
            found = [(best[q][0] + 3, "D" + best[q][1], best[q][2])]
            if fault not in ("blank", "duplicate"):
                for letter, r in follow[q].items():
                    c, e, t = best[r]
                    if role[:1] == letter:
                        found.append((c + extra, "K" + e, (f"{role}:{text}", *t)))
                    if letter in full:
                        found.append((c + 2 + extra, "R" + e, (f"{full[letter]}:{text}", *t)))
            now[q] = min(found)
        best = inserted(now)
    return best[""]


def conversations(n=120, seed=1):
    rnd = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rnd.randrange(12)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ux"])
            text = rnd.choice(["Yes.", "No", "What?", " \t", "", None, "Go on! ", "a\nb.\x0b", "é", "x. y", "Ok.\x00"]) if rnd.random() < 0.7 else f"say {rnd.randrange(9**9)}."
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 3, None]), role, text))
    return [*rows, *rows[:20], (5000, 3, None, None), (5001, None, "user", "A."), (5001, None, "assistant", "B.")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(3)


def figures(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1:] for r in rows}


def test_conversations_by_brute_force(spark):
    rows = conversations()
    assert figures(dialogs.report(frame(spark, rows))) == naive(rows)


def test_one_conversation_over_many_segments(spark):
    rnd = random.Random(4)
    rows = [(7, t // 3, rnd.choice(["user", "assistant", "system"]), rnd.choice(["Yes.", "No", f"{t}."])) for t in range(3000)]
    rows += [(8, 1, "user", "Same.")] * 500 + [(9, None, "assistant", "Hm")] * 3
    parts = dialogs.segments(dialogs.faults(dialogs.damaged(frame(spark, rows))), 100)
    assert parts.filter("conv = 7").count() > 9
    assert figures(dialogs.report(frame(spark, rows), segment_rows=100)) == naive(rows)


def test_conversations_by_sql(spark):
    rows = conversations(40, 3)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    rel = con.sql(dialogs.ORACLE)
    assert figures(dialogs.report(frame(spark, rows)).select(*rel.columns)) == {r[0]: r[1:] for r in rel.fetchall()}


def test_audits_of_all_short_rows():
    """Every sequence of up to four kinds, and random long ones, against the search."""
    role = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "d": "user"}
    for kinds in [*itertools.chain.from_iterable(itertools.product(dialogs.KINDS, repeat=n) for n in range(4)), *(random.Random(k).choices(dialogs.KINDS, k=k % 40) for k in range(400))]:
        rows = [(role[k.lower()], "t", "blank" if k == "d" else "truncated" if k.isupper() else None) for k in kinds]
        assert dialogs.audit("".join(kinds)) == least(rows)[:2], kinds


def test_no_conversations_and_long_texts(spark):
    assert dialogs.report(frame(spark, [])).count() == 0
    rows = [(1, t, "user" if t % 2 else "assistant", f"{t} " + "word " * 200_000 + ".") for t in range(6)]
    assert figures(dialogs.report(frame(spark, rows))) == naive(rows)
