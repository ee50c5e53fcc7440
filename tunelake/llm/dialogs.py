"""Conversation structure repair: the cheapest edits that make a conversation alternate, by Four-Russians block tables.

A conversation is legal if its roles' first letters spell nothing, or an optional ``s`` and then pairs ``ua``.  Rows are kept (0),
given another role (2) or deleted (3), empty rows of the user or the assistant are inserted (2); blank rows and duplicates must
be deleted, a truncated row that stays costs 1.  Among the cheapest edits those whose initials (D, I, K, R) sort first are taken.

The costs to go from the four states that a legal prefix can be in form a vector.  Less its least entry, there are only a few
such vectors, and what ``BLOCK`` rows of nine kinds do to each is computed once: a table from vector and block to vector and
added cost.  A conversation is read backward a block at a time by lookup; then its blocks are expanded again, first to last,
into a vector for each row, which tells at each step the first letter that still ends at the least cost.

Repeated rows are counted before anything is sorted.  Rows are then dealt by ranges of conversation, turn, role and text, so a
conversation of any share of all rows lies over many tasks, as segments of at most ``SEGMENT_ROWS`` rows; its texts stay there.
Only one letter a row, no more than the audit that is returned, meets in one row.  Repaired segments are hashed in order, one
at a time.

Nulls in role and text count as one blank, as they do in the hash that chooses the damage; null turns sort first and don't count
for gaps; rows without a conversation form one of their own.  Rows of a turn go by role, then text.  A role that is empty or
begins with another letter than s, u or a can't be kept.  Texts may have any length.  Other columns aren't read, so their
names can't clash.  A conversation all of whose rows are dropped has zeros, an empty audit and the hash of an empty string.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import common

BLOCK = 4
SEGMENT_ROWS = 50_000
SEGMENT_BYTES = 16 << 20
#: Kinds of rows: by role, truncated or not, and those that must go.
KINDS = "suaxSUAXd"
LEGAL_PAIRS = ("su", "ua", "au")
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user's or assistant's row is added to each state, the letter of that row, and the costs at the end.
ADDED, DUE, END = (USER, USER, ASSISTANT, USER), "uuau", (0, 4, 2, 0)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
MANY = 1 << 20


def kept(state: int, kind: str) -> int | None:
    """The state after a row of the kind is kept."""
    role = kind.lower()
    return SYSTEM if role == "s" and state == START else ADDED[state] if role == DUE[state] else None


def before(kind: str, after: tuple) -> tuple:
    """The costs to go before a row, from those after it."""
    out = [cost + DELETE for cost in after]
    if kind != "d":
        extra = TRUNCATED * kind.isupper()
        for q in range(4):
            to = kept(q, kind)
            out[q] = min(out[q], after[ADDED[q]] + REROLE + extra, MANY if to is None else after[to] + KEEP + extra)
    for _ in range(3):  # an insertion leads to a state from which another may follow
        out = [min(out[q], out[ADDED[q]] + INSERT) for q in range(4)]
    return tuple(out)


@functools.cache
def tables() -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The vectors, and for each and a row, or a block of rows, the vector before it and the added cost."""
    vectors, number = [END], {END: 0}
    to, cost = [], []
    for v in vectors:  # grows while it is read
        for kind in KINDS:
            w = before(kind, v)
            least = min(w)
            w = tuple(x - least for x in w)
            if w not in number:
                number[w] = len(vectors)
                vectors.append(w)
            to.append(number[w])
            cost.append(least)
    one, paid = np.array(to).reshape(-1, len(KINDS)), np.array(cost).reshape(-1, len(KINDS))
    block, total = one, paid
    for _ in range(BLOCK - 1):  # a row more in front
        total = (total[:, None, :] + paid[block].transpose(0, 2, 1)).reshape(len(vectors), -1)
        block = one[block].transpose(0, 2, 1).reshape(len(vectors), -1)
    return vectors, one, paid, block, total


def audit(rows: str) -> tuple[int, str]:
    """The least cost and the initials of the edits, from the rows' kinds."""
    vectors, one, paid, block, total = tables()
    codes = np.frombuffer(rows.translate(CODES).encode("latin-1"), np.uint8).astype(np.int64)
    loose = len(codes) % BLOCK
    keys = codes[loose:].reshape(-1, BLOCK) @ len(KINDS) ** np.arange(BLOCK - 1, -1, -1) if len(codes) >= BLOCK else np.zeros(0, np.int64)
    at, spent = 0, 0
    ends = [(0, 0)]  # the vector and the cost behind each block, last to first
    for key in keys[::-1].tolist():
        spent += int(total[at, key])
        at = int(block[at, key])
        ends.append((at, spent))
    out, state = [], START
    edges = [0, *range(loose, len(codes) + 1, BLOCK)] if loose else list(range(0, len(codes) + 1, BLOCK))
    cost = None
    for (begin, end), behind in zip(itertools.pairwise(edges), ends[: len(edges) - 1][::-1] if loose or len(edges) > 1 else [], strict=True):
        go = _expand(codes[begin:end].tolist(), behind, vectors, one, paid)
        if cost is None:
            cost = go[0][START]
        for k in range(begin, end):
            state = _row(rows[k], state, go[k - begin], go[k - begin + 1], out)
    if cost is None:
        cost = END[START]
    while END[state]:
        out.append("I")
        state = ADDED[state]
    return cost, "".join(out)


def _expand(codes: list[int], behind: tuple[int, int], vectors: list, one: np.ndarray, paid: np.ndarray) -> list[list[int]]:
    """The costs to go before each row of a block, and behind the last."""
    (at, spent), out = behind, []
    for code in [*codes, None][::-1]:
        if code is not None:
            spent += int(paid[at, code])
            at = int(one[at, code])
        out.append([x + spent for x in vectors[at]])
    return out[::-1]


def _row(kind: str, state: int, here: list[int], after: list[int], out: list[str]) -> int:
    """The first letters that end at the least cost, up to the one that takes the row; the state behind it."""
    extra = TRUNCATED * kind.isupper()
    while True:
        left = here[state]
        if after[state] + DELETE == left:
            out.append("D")
            return state
        if here[ADDED[state]] + INSERT == left:
            out.append("I")
            state = ADDED[state]
            continue
        to = kept(state, kind)
        if to is not None and after[to] + KEEP + extra == left:
            out.append("K")
            return to
        out.append("R")
        return ADDED[state]


CODES = {ord(kind): k for k, kind in enumerate(KINDS)}
DAMAGE = 20


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text and copies, damaged by a hash of conversation and turn; repeated rows are counted."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), (F.crc32(F.concat(blank(conv_id), F.lit(":"), blank(turn)).cast("binary")) % DAMAGE).alias("k"))
    changed = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.filter("k <> 0").select("conv", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.when(F.col("k") == 3, 2).otherwise(1).alias("n"))
    return rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """The rows with their first fault: blank, duplicate (of an earlier turn), truncated, or null."""
    keyed = rows.withColumn("h", F.unhex(F.sha2("text", 256)))
    turn = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    first = keyed.groupBy("conv", "role", "h").agg(F.min(turn).alias("first"), F.count("*").alias("turns")).filter("turns > 1").select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("h").alias("g"), "first")
    both = keyed.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("g")), "left")
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.coalesce(turn > F.col("first"), F.lit(False)), "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    return both.select("conv", "turn", "role", "text", "copies", fault.alias("fault"))


SEGMENT = "seg bigint, n bigint, kinds string, first_turn bigint, last_turn bigint, turns bigint, first_role string, last_role string, blank bigint, duplicate bigint, truncated bigint, illegal bigint"


class Segment:
    """Rows of one conversation in order."""

    def __init__(self):
        self.kinds, self.roles, self.texts, self.size = [], [], [], 0
        self.stats = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)
        self.first_turn = self.last_turn = self.first_role = self.last_role = None

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: str | None) -> None:
        s, letter = self.stats, role[:1]
        if turn is not None:
            s["turns"] += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if self.last_role is None:
            self.first_role = letter
        else:
            s["illegal"] += self.last_role + letter not in LEGAL_PAIRS
        s["illegal"] += copies - 1
        self.last_role = letter
        if fault == "blank":
            s["blank"] += copies
        else:
            s["duplicate"] += copies - (fault != "duplicate")
            s["truncated"] += fault == "truncated"
        if fault in ("blank", "duplicate"):
            self.kinds.append("d" * copies)
        else:
            kind = letter if letter in ("s", "u", "a") else "x"
            self.kinds.append((kind.upper() if fault else kind) + "d" * (copies - 1))
            self.roles.append(role)
            self.texts.append(text)
            self.size += len(text)

    def row(self, seg: int) -> list:
        kinds = "".join(self.kinds)
        return [seg, len(kinds), kinds, self.first_turn, self.last_turn, self.stats["turns"], self.first_role, self.last_role, *(self.stats[c] for c in ("blank", "duplicate", "truncated", "illegal")), self.roles, self.texts]


def segments(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The rows in order, as a written table of segments: conv, statistics, kinds, and role and text of each row that may stay."""
    schema = T._parse_datatype_string(f"conv {rows.schema['conv'].dataType.simpleString()}, {SEGMENT}, roles array<string>, texts array<string>")
    ordered = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text").select("turn", "role", "text", "copies", "fault", "conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in schema.fields]
        number = itertools.count(TaskContext.get().partitionId() << 32)
        ready, weight = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if ready:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready), types, strict=True)], schema.names)
                ready.clear()

        now, conv = None, None
        for batch in batches:
            for *row, own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or own != conv or len(now.kinds) >= segment_rows or now.size >= SEGMENT_BYTES:
                    if now:
                        ready.append([conv, *now.row(next(number))])
                        weight += now.size + len(now.kinds)
                        if weight >= SEGMENT_BYTES or len(ready) >= 5000:
                            yield from flush()
                            weight = 0
                    now, conv = Segment(), own
                now.add(*row)
        if now:
            ready.append([conv, *now.row(next(number))])
        yield from flush()

    return common.written(ordered.mapInArrow(run, schema))


CHECKED = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, pieces array<struct<seg:bigint, due:string, edits:string>>"


def checked(parts: list[dict]) -> tuple:
    """The figures of a conversation from its segments, in order, and the edits of each segment with the letter that is due first."""
    cost, edits = audit("".join(p["kinds"] for p in parts))
    count = {c: sum(p[c] for p in parts) for c in ("turns", "blank", "duplicate", "truncated", "illegal")}
    some = [p for p in parts if p["first_turn"] is not None]
    count["turns"] -= sum(a["last_turn"] == b["first_turn"] for a, b in itertools.pairwise(some))
    count["illegal"] += sum(a["last_role"] + b["first_role"] not in LEGAL_PAIRS for a, b in itertools.pairwise(parts))
    gaps = some[-1]["last_turn"] - some[0]["first_turn"] + 1 - count["turns"] if some else 0
    pieces, kinds, at, state = [], iter("".join(p["kinds"] for p in parts)), 0, START
    for p in parts:
        begin, due, left = at, DUE[state], p["n"]
        while left or p is parts[-1] and at < len(edits):
            e = edits[at]
            at += 1
            if e != "I":
                left -= 1
                kind = next(kinds)
            if e != "D":
                state = kept(state, kind) if e == "K" else ADDED[state]
        pieces.append({"seg": p["seg"], "due": due, "edits": edits[begin:at]})
    return gaps, count["blank"], count["duplicate"], count["truncated"], count["illegal"], cost, edits, pieces


def lines(kinds: str, roles: list[str], texts: list[str], due: str, edits: str) -> str | None:
    """A segment's rows after the edits as role:text, one a line; None if there are none."""
    out, rows, stay = [], iter(kinds), iter(zip(roles, texts, strict=True))
    for e in edits:
        role, text = "user" if due == "u" else "assistant", ""
        if e != "I":
            row = next(stay) if next(rows) != "d" else None
            if e == "D":
                continue
            role, text = row if e == "K" else (role, row[1])
        due = "a" if role[:1] == "u" else "u"
        out.append(f"{role}:{text}")
    return "\n".join(out) if out else None


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Of rows (conv, turn, role, text, copies): the figures of each conversation, and its repaired segments (conv, seg, lines)."""
    own = segments(faults(rows), segment_rows)
    schema = T._parse_datatype_string(f"conv {rows.schema['conv'].dataType.simpleString()}, {CHECKED}")
    small = own.select("conv", F.struct(*[f.split()[0] for f in SEGMENT.split(", ")]).alias("p")).groupBy("conv").agg(F.sort_array(F.collect_list("p")).alias("parts"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = list(zip(*map(checked, part.column(1).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(found, schema.fields[1:], strict=True)]], schema.names)

    figures = common.written(small.mapInArrow(check, schema))
    pieces = figures.select(F.explode("pieces").alias("x")).select("x.*")

    @F.pandas_udf("string")
    def repaired(kinds, roles, texts, due, edits):
        import pandas as pd

        return pd.Series([lines(*x) for x in zip(kinds, roles, texts, due, edits)], dtype=object)

    text = own.select("conv", "seg", "kinds", "roles", "texts").join(pieces, "seg").select("conv", "seg", repaired("kinds", "roles", "texts", "due", "edits").alias("lines"))
    return figures.drop("pieces"), text


def digests(text: DataFrame) -> DataFrame:
    """conv and the hash of its repaired lines, read in order, a segment at a time."""
    kind = text.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = digest = None
        some = False
        done = []
        for batch in batches:
            for own, part in zip(*[batch.column(k).to_pylist() for k in (0, 1)], strict=True):
                if digest is None or own != conv:
                    if digest:
                        done.append((conv, digest.hexdigest()))
                    conv, digest, some = own, hashlib.sha256(), False
                if part is not None:
                    digest.update(("\n" * some + part).encode())
                    some = True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], batch.schema.field(0).type), pa.array([h for _, h in done])], ["conv", "h"])
                done = []
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([conv], batch.schema.field(0).type), pa.array([digest.hexdigest()])], ["conv", "h"])

    return text.repartition("conv").sortWithinPartitions("conv", "seg").select("conv", "lines").mapInArrow(run, f"conv {kind}, h string")


def report(conversations: DataFrame, conv_id: str = "conv_id", segment_rows: int = SEGMENT_ROWS, **columns: str) -> DataFrame:
    """Each conversation after the damage: gaps, faults, the cost and audit of its repair, and the hash of what it becomes."""
    figures, text = repair(damaged(conversations, conv_id, **columns), segment_rows)
    hashed = digests(text).select(F.col("conv").alias("c"), "h")
    all_ = conversations.select(F.col(conv_id).alias("id")).distinct()
    none = hashlib.sha256().hexdigest()
    same: Column = F.col("id").eqNullSafe(F.col("conv"))
    out = all_.join(figures, same, "left").join(hashed, F.col("id").eqNullSafe(F.col("c")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias(conv_id), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("h", F.lit(none)).alias("repaired_sha256"))


def _oracle() -> str:
    """A value is the cost, the edits and the repaired lines, joined so that the least value is the best."""
    add = lambda v, cost, letter, line: f"(lpad(CAST(CAST(left({v}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || '{letter}' || substr({v}, 10, strpos({v}, chr(1)) - 9) || {line} || substr({v}, strpos({v}, chr(1)) + 1))"
    role = lambda q: "'user'" if DUE[q] == "u" else "'assistant'"
    inserted = lambda v, q: add(v, 2, "I", f"{role(q)} || ':' || chr(10)")
    text, t = "e.text || chr(10)", "CAST(e.fault IS NOT DISTINCT FROM 'truncated' AS INTEGER)"
    base = []
    for q in range(4):
        keep = f"CASE WHEN e.gone THEN NULL WHEN left(e.role, 1) = '{DUE[q]}' THEN {add(f'r.v{ADDED[q]}', t, 'K', f'e.role || chr(58) || {text}')}"
        keep += f" WHEN left(e.role, 1) = 's' THEN {add(f'r.v{SYSTEM}', t, 'K', f'e.role || chr(58) || {text}')} END" if q == START else " END"
        rerole = f"CASE WHEN NOT e.gone THEN {add(f'r.v{ADDED[q]}', f'2 + {t}', 'R', f'{role(q)} || chr(58) || {text}')} END"
        base.append(f"least({add(f'r.v{q}', 3, 'D', chr(39) * 2)}, {keep}, {rerole}) AS b{q}")
    closed = lambda names, out: ", ".join(f"least({names[q]}, {inserted(names[ADDED[q]], q)}) AS {out}{q}" for q in range(4))
    ends = [f"'{END[q]:09d}{'I' * (END[q] // 2)}' || chr(1) || '{ {0: '', 2: 'assistant:' + chr(10), 4: 'user:' + chr(10) + 'assistant:' + chr(10)}[END[q]] }' AS v{q}" for q in range(4)]
    return rf"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, crc32 FROM (SELECT *, 0 AS crc32 FROM conversations)),
hashed AS (SELECT conv_id, turn, role, text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS h FROM src),
bits AS (SELECT h, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h) + 1), lambda i: ascii(h[i])::BIGINT)), lambda c, b: {_crc_step()}) AS crc FROM (SELECT DISTINCT h FROM hashed)),
d AS (SELECT conv_id, turn, role, text, xor(crc, 4294967295) % 20 AS k FROM hashed JOIN bits USING (h)),
e0 AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE k <> 0),
e1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM e0),
e2 AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS last FROM e1),
e AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone FROM e2),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (last IS NOT NULL AND left(last, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM e GROUP BY conv_id),
r AS (SELECT conv_id, n AS i, {', '.join(ends)} FROM facts
  UNION ALL SELECT conv_id, i, {closed([f'c{q}' for q in range(4)], 'v')} FROM (SELECT conv_id, i, {closed([f'b{q}' for q in range(4)], 'c')} FROM (SELECT r.conv_id, r.i - 1 AS i, {', '.join(base)} FROM r JOIN e ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.i = r.i))),
best AS (SELECT conv_id, v0 AS v FROM r WHERE i = 0)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(v, 9) AS BIGINT), 0) AS cost,
  coalesce(substr(v, 10, strpos(v, chr(1)) - 10), '') AS audit, sha256(coalesce(substr(v, strpos(v, chr(1)) + 1, greatest(length(v) - strpos(v, chr(1)) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id"""


def _crc_step() -> str:
    """A byte more of the checksum, bit by bit."""
    out = "xor(c, b)"
    for _ in range(8):
        out = f"list_transform([{out}], lambda x: xor(x >> 1, 3988292384 * (x & 1)))[1]"
    return out


ORACLE = _oracle()
