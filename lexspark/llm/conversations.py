"""Repair of conversation structure: turns aligned to the alternating grammar by Wagner and Fischer's table."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are aligned in one table; longer conversations are cut into such parts, whose best alignments are put together exactly.
PART = 512
#: Bytes of a conversation's texts that a task holds; beyond them they go to a temporary file of the task.
HELD = 8 << 20
#: Rows of results that are sent together.
TOGETHER = 500

_NEVER = 1 << 29
_OTHER = {"u": "a", "a": "u"}
_ROLE = {"u": "user", "a": "assistant"}
_WHITE = " \t\n\x0b\x0c\r"


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): turns with faults by crc32 of `conv_id:turn` modulo 20, nulls as one space: 0 drops a row (it stays with `gone`, so that its conversation isn't lost), 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 sets the role user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fault.alias("_fault"))
    at = F.col("_fault")
    text = F.when(at.isin(0, 1), "").when(at == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(at == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    return rows.select("conv_id", "turn", F.when(at == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (at == 0).alias("gone"), copies).drop("_copy")


def sentence_open(text: Column) -> Column:
    """Whether the last character that is no white space is no sentence end."""
    return ~F.substring(F.rtrim(text, F.lit(_WHITE)), -1, 1).isin(".", "!", "?")


# --- alignment of one conversation -------------------------------------------------------------

#: Best repairs of what follows, by what is expected next: "u" and "a" of the pairs, "X" a first pair after a system turn, "S" a system turn. Each is (cost, audit).
Ahead = dict[str, tuple[int, str]]


def greedy(rows: list[tuple[str, bool, bool]], expected: str) -> tuple[int, str]:
    """The incumbent: what a repair costs beyond keeping all rows that may stay, if a turn is inserted wherever the other one is expected; and what is expected after it."""
    cost = 0
    for letter, forced, _ in rows:
        if not forced:
            if letter == expected:
                expected = _OTHER[expected]
            else:  # after an insertion the row fits, and the same is expected again
                cost += 2
                if letter not in _OTHER:
                    expected = _OTHER[expected]
    return cost, expected


class Table:
    """Wagner and Fischer's table of some rows against the alternating string that ends before `after`.

    cost(i, r): the least cost, beyond the fixed one, of turning the rows from i on into the last r letters. The last r letters are the same whatever the whole length is, so one table serves all feasible lengths. Ukkonen's band: an optimal repair inserts and deletes at most half as many turns as the incumbent costs, so r is at most `width` away from the number of rows that may stay.
    """

    def __init__(self, rows: list[tuple[str, bool, bool]], after: str):
        self.rows, self.after = rows, after
        most = max(cost + 2 * (end != after) for cost, end in (greedy(rows, "u"), greedy(rows, "a")))
        self.width = w = most // 2 + 3  # 3: for alignments that begin after a system turn, with the other phase, or need a pair
        self.free = [0] * (len(rows) + 1)
        for i in range(len(rows) - 1, -1, -1):
            self.free[i] = self.free[i + 1] + (not rows[i][1])
        steps = 2 * np.arange(2 * w + 1, dtype=np.int32)
        r = np.arange(-w, w + 1)
        lines = [np.where(r >= 0, 2 * r, _NEVER).astype(np.int32)]
        even = {s: np.where((r + s) % 2 == 0, 0, 2).astype(np.int32) for s in (0, 1)}
        for i in range(len(rows) - 1, -1, -1):
            letter, forced, cut = rows[i]
            last = lines[-1]
            if not forced:
                if letter in _OTHER:  # fits where the letter with r to go is the row's: `after` stands at even r
                    last = last + even[(self.free[i] + (letter != after)) % 2]
                else:
                    last = last + np.int32(2)
                np.minimum(last[:-1], lines[-1][1:] + np.int32(3 - cut), out=last[:-1])
                last = np.minimum.accumulate(last - steps) + steps
                last[: max(0, w - self.free[i])] = _NEVER
            lines.append(last)
        self.lines = lines[::-1]

    def letter(self, r: int) -> str:
        return self.after if r % 2 == 0 else _OTHER[self.after]

    def cost(self, i: int, r: int) -> int:
        at = r - self.free[i] + self.width
        return int(self.lines[i][at]) if 0 <= at <= 2 * self.width and r >= 0 else _NEVER

    def best(self, i: int, expected: str, least: int) -> tuple[int, list[int]]:
        """The least cost of the rows from i on, over all lengths of at least `least` letters whose first is the expected one (or, of none, with it as the next), and the lengths that have it."""
        low = max(least, self.free[i] - self.width)
        low += (low % 2 == 0) != (expected == self.after)
        line = self.lines[i][low - self.free[i] + self.width :: 2]
        if not len(line) or (cost := int(line.min())) >= _NEVER:
            return _NEVER, []
        return cost, (low + 2 * np.flatnonzero(line == cost)).tolist()

    def audit(self, i: int, r: int) -> str:
        """The ASCII-least audit of the rows from i on for r letters."""
        out = []
        while i < len(self.rows) or r:
            here = self.cost(i, r)
            if i < len(self.rows):
                letter, forced, cut = self.rows[i]
                if forced or self.cost(i + 1, r) + 3 - cut == here:
                    out.append("D")
                    i += 1
                    continue
            if r and self.cost(i, r - 1) + 2 == here:
                out.append("I")
            else:
                out.append("K" if letter == self.letter(r) else "R")
                i += 1
            r -= 1
        return "".join(out)


def aligned(rows: list[tuple[str, bool, bool]], ahead: Ahead) -> Ahead:
    """Best repairs from the first of some rows on, given those of what follows them."""
    tables = {e: Table(rows, e) for e in "ua" if e in ahead}
    fixed = [0]  # of the rows from i on: deletions that are required, and truncated rows that stay
    removed = [0]  # of the rows from i on, if all go
    for _, forced, cut in reversed(rows):
        fixed.append(fixed[-1] + (3 if forced else cut))
        removed.append(removed[-1] + 3)
    fixed.reverse()
    removed.reverse()

    def repairs(i: int, expected: str, least: int) -> list[tuple[int, str]]:
        """Over all feasible lengths and both phases at the end: the cheapest, their audits compared."""
        found = []
        for e, table in tables.items():
            cost, lengths = table.best(i, expected, least)
            if lengths:
                found.append((cost + fixed[i] + ahead[e][0], e, lengths))
        low = min((f[0] for f in found), default=0)
        audits = [tables[e].audit(i, r) + ahead[e][1] for cost, e, lengths in found if cost == low for r in lengths]
        return [(low, min(audits))] if audits else []

    def after_system(i: int) -> list[tuple[int, str]]:
        return repairs(i, "u", 1) + [(removed[i] + ahead["X"][0], "D" * (len(rows) - i) + ahead["X"][1]) for _ in "X" if "X" in ahead]

    system = [(removed[0] + ahead["S"][0], "D" * len(rows) + ahead["S"][1])] if "S" in ahead else []
    for i, (letter, forced, cut) in enumerate(rows):
        if letter == "s" and not forced:
            system += [(removed[0] - removed[i] + cut + cost, "D" * i + "K" + audit) for cost, audit in after_system(i + 1)]
    found = {"u": repairs(0, "u", 0), "a": repairs(0, "a", 0), "X": after_system(0), "S": system}
    return {k: min(v) for k, v in found.items() if v}


@lru_cache(maxsize=1 << 14)
def _aligned_short(codes: str) -> tuple[int, str]:
    return _repair(codes)


def _repair(codes: str) -> tuple[int, str]:
    rows = [(c.lower(), c in "DB", c.isupper() and c not in "DB") for c in codes]
    ahead: Ahead = {"u": (0, "")}
    for at in range((max(len(rows), 1) - 1) // PART * PART, -1, -PART):
        ahead = aligned(rows[at : at + PART], ahead)
    return min(ahead[k] for k in "uS" if k in ahead)


def repair(codes: str) -> tuple[int, str]:
    """(cost, audit) of a conversation. Codes of its rows: B blank, D duplicate; else s, u, a by the role's initial and o for other roles, as capitals if truncated."""
    return _aligned_short(codes) if len(codes) <= 32 else _repair(codes)


# --- conversations as streams of sorted rows ---------------------------------------------------


class Conversation:
    """What a task keeps of the conversation that passes: a code and a digest for each row, and the rows themselves up to HELD bytes, beyond that in a temporary file that goes with it."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.seen = conv_id, [], set()
        self.turns, self.first, self.last = 0, None, None
        self.illegal, self.initial = 0, None
        self.faults = dict.fromkeys(("B", "D", "T"), 0)
        self.held, self.size, self.file = [], 0, None

    def add(self, turn, role: str, text: str, blank: bool, cut: bool) -> None:
        if turn is not None:
            if turn != self.last:
                self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        key = hashlib.blake2b(f"{role}\0{text}".encode(), digest_size=16).digest()
        fault = "B" if blank else "D" if key in self.seen else "T" if cut else ""
        self.seen.add(key)
        if fault:
            self.faults[fault] += 1
        code = initial if initial in ("s", "u", "a") else "o"
        self.codes.append(fault if fault in ("B", "D") else code.upper() if fault else code)
        self.held.append((turn, role, text))
        self.size += len(text) + len(role)
        if self.size > HELD:
            self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115  closed by rows()
            pickle.dump(self.held, self.file)
            self.held, self.size = [], 0

    def rows(self) -> Iterator[tuple]:
        """The rows in order, once."""
        if self.file:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield from pickle.load(self.file)
            self.file.close()
        yield from self.held

    def repaired(self, audit: str) -> Iterator[tuple[str, int | None, str, str]]:
        """(edit, turn, role, text) of the turns that the audit leaves, in order; inserted ones have neither turn nor text."""
        rows, expected = self.rows(), "u"
        for edit in audit:
            if edit == "I":
                yield edit, None, _ROLE[expected], ""
            else:
                turn, role, text = next(rows)
                if edit == "D":
                    continue
                if edit == "K" and role[:1] == "s":
                    yield edit, turn, role, text
                    continue
                yield edit, turn, role if edit == "K" else _ROLE[expected], text
            expected = _OTHER[expected]
        for _ in rows:
            pass  # closes the file

    @property
    def gaps(self) -> int:
        return min((1 << 63) - 1, int(self.last) - int(self.first) + 1 - self.turns) if self.turns else 0


def _streamed(turns: DataFrame, gone: str | None, tell: Callable[[Conversation, int, str], Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """tell(conversation, cost, audit) of each conversation, its rows being dealt by conv_id and sorted by turn (null first), role and text."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), (F.col(gone) if gone else F.lit(False)).alias("gone"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = rows.select("*", (F.rtrim(F.col("text"), F.lit(_WHITE)) == "").alias("blank"), sentence_open(F.col("text")).alias("cut"))

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[Conversation]:
        now = None
        for batch in batches:
            for conv_id, turn, role, text, gone, blank, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        yield now
                    now = Conversation(conv_id)
                if not gone:
                    now.add(turn, role, text, blank, cut)
        if now is not None:
            yield now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for c in conversations(batches):
            for row in tell(c, *repair("".join(c.codes))):
                out.append(row)
                size += sum(len(x) for x in row if isinstance(x, str))
                if len(out) >= TOGETHER or size > HELD:
                    yield pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
                    out, size = [], 0
        yield pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return rows.mapInArrow(run, ddl)


def repaired_turns(turns: DataFrame, gone: str | None = None) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the turns of each repaired conversation by place from 0, with the edit that left them: K kept, R another role, I inserted. Rows where the column `gone` is true only name their conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def tell(c: Conversation, cost: int, audit: str) -> Iterator[tuple]:
        for place, row in enumerate(c.repaired(audit)):
            yield (c.conv_id, place, *row)

    return _streamed(turns, gone, tell, schema, "conv_id long, place long, edit string, turn long, role string, text string")


def audits(turns: DataFrame, gone: str | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row a conversation.

    Roles and texts that are null are one space. All rows with null conv_id are one conversation. Rows that share a turn go by role and text, repeated rows beside each other. Each row's first fault counts. Repairs are the cheapest, among those the ASCII-least audit. A conversation whose rows are all gone has zeros, an empty audit and the hash of nothing. gaps beyond a long are the largest long.

    A digest of a whole conversation is made row by row in order, so its rows pass one task, as a stream: a task holds a code and 16 bytes for each row of one conversation, and tables of PART rows.
    """
    schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def tell(c: Conversation, cost: int, audit: str) -> Iterator[tuple]:
        digest = hashlib.sha256()
        for place, (_, _, role, text) in enumerate(c.repaired(audit)):
            digest.update(f"{'' if place == 0 else chr(10)}{role}:{text}".encode())
        yield (c.conv_id, c.gaps, c.faults["B"], c.faults["D"], c.faults["T"], c.illegal, cost, audit, digest.hexdigest())

    return _streamed(turns, gone, tell, schema, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return audits(damaged(table(spark, sf_dir, "conversations")), "gone")


#: The same by the cheapest way through the grammar's four states (nothing yet, after a system turn, after a user's, after an assistant's), in DuckDB SQL.
ORACLE = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
b AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * length(k)), lambda i: ((ascii(k[i // 8 + 1]) >> (i % 8)::INTEGER) & 1)::BIGINT)), lambda x, y: xor(x >> 1, 3988292384 * (xor(x, y) & 1)))) % 20 AS f FROM c),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM b, (SELECT unnest([1, 2]) AS copy) WHERE f <> 0 AND (copy = 1 OR f = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
g AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'B' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'D' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'T' ELSE '' END AS fault, CASE WHEN i > 1 THEN (lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1]) NOT IN ('su', 'ua', 'au') ELSE false END AS bad FROM n),
e(a, pre, z, cost) AS (VALUES (0, '', 0, 0), (0, 'I', 2, 2), (0, 'II', 3, 4), (1, '', 1, 0), (1, 'I', 2, 2), (1, 'II', 3, 4), (2, '', 2, 0), (2, 'I', 3, 2), (3, '', 3, 0), (3, 'I', 2, 2)),
o(a, edit, initial, z, cost) AS (VALUES (0, 'D', '', 0, 3), (1, 'D', '', 1, 3), (2, 'D', '', 2, 3), (3, 'D', '', 3, 3), (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (3, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (0, 'R', '', 2, 2), (1, 'R', '', 2, 2), (3, 'R', '', 2, 2), (2, 'R', '', 3, 2)),
w AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, {'cost': 0::BIGINT, 'audit': ''} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT w.conv_id, g.i, o.z, min({'cost': (w.best.cost + e.cost + o.cost + CASE WHEN g.fault = 'T' AND o.edit <> 'D' THEN 1 ELSE 0 END)::BIGINT, 'audit': w.best.audit || e.pre || o.edit}) AS best
  FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1 JOIN e ON e.a = w.state JOIN o ON o.a = e.z AND (o.initial = '' OR o.initial = g.role[1]) AND (g.fault NOT IN ('B', 'D') OR o.edit = 'D')
  GROUP BY w.conv_id, g.i, o.z
),
s AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'B') AS blank, count(*) FILTER (fault = 'D') AS duplicate, count(*) FILTER (fault = 'T') AS truncated, count(*) FILTER (bad) AS illegal FROM g GROUP BY conv_id),
t AS (SELECT w.conv_id, min({'cost': w.best.cost + e.cost, 'audit': w.best.audit || e.pre}) AS best FROM w LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id JOIN e ON e.a = w.state WHERE w.i = coalesce(s.rows, 0) AND e.z IN (0, 3) GROUP BY w.conv_id),
u AS (SELECT conv_id, p, best.audit[p] AS edit, p - length(replace(best.audit[1:p], 'I', '')) AS ins, length(replace(best.audit[1:p], 'I', '')) AS row_no, length(replace(best.audit[1:p], 'D', '')) AS place FROM (SELECT conv_id, best, unnest(range(1, length(best.audit) + 1)) AS p FROM t)),
v AS (SELECT u.*, g.role, g.text, max(CASE WHEN u.place = 1 AND u.edit = 'K' AND g.role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY u.conv_id) AS sys FROM u LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM u.conv_id AND g.i = u.row_no AND u.edit <> 'I' WHERE u.edit <> 'D'),
r AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY place) AS body FROM v GROUP BY conv_id)
SELECT t.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, t.best.cost::BIGINT AS cost, t.best.audit AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM t LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id
"""
