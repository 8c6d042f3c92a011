"""Conversation structure repair by scalar big-integer weights.

Rows of a conversation, in the order of their turn, are to give role initials
``(s?(ua)+)?`` by the cheapest edits: Keep (0), Rerole to user or assistant
(3), Delete (4, required for blank and duplicate rows) and Insert of an empty
user or assistant turn (3); a truncated row that is not deleted adds 3. Ties
take the ASCII-least string of edit initials.

A way's weight is one integer: its high digits are the cost, its low digits a
fixed width of letters (D, I, K, R as 1 to 4) with zeros after the end. A
dynamic program over the acyclic graph of (row, state of the pattern) runs from
the last row to the first; putting an edit before a way adds to the cost,
shifts the letters by one digit and sets the first. The ordinary minimum of
integers is then the cheapest way and, among those, the least string. The
weight itself holds the edits, so no way is traced back.

Faults are found by Spark: the repeats of a row by a window per conversation
and content hash, the rest by expressions. A conversation's marks (a byte a
row) lie in one partition; its texts are streamed there in order behind the
row of its edits and never held. The weights of a conversation of n rows have
about 6 n bits, so very long ones cost n * n bit operations.

Defined cases: a null role or text is one space (so blank); null turns come
first; rows of one turn are ordered by role, then content hash; null conv_ids
are one conversation; roles are known by their first character, an empty role
has none; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
BLANK_CHARS, ENDS = " \t\n\v\f\r", ".!?"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States of the pattern: nothing yet, after s, after u, after a. Where a kept initial leads, and where a user or assistant turn does.
START, S, U, A = range(4)
_KEPT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
_NEXT = {START: U, S: U, U: A, A: U}
_DIGIT = 3  # bits of a letter
_ORDER = ("conv_id", "turn", "role", "content", "copy")  # nulls first


def marked(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copy, content, fault) with ``copy`` 0 if absent; each conversation in one partition."""
    copy = F.col("copy").cast("int") if "copy" in rows.columns else F.lit(0)
    filled = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), copy.alias("copy"))
    content = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    end = F.substring(F.rtrim(F.col("text"), F.lit(BLANK_CHARS)), -1, 1)
    once = Window.partitionBy("conv_id", "content").orderBy("turn", "copy")
    seen = filled.withColumn("content", content).repartition("conv_id").withColumn("nth", F.row_number().over(once))
    fault = F.when(end == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~end.isin(*ENDS), TRUNCATED).otherwise(SOUND)
    return seen.withColumn("fault", fault.cast("int")).drop("nth")


def cheapest(rows: Sequence[tuple[str, int]]) -> tuple[int, str]:
    """(cost, edit initials) for rows of (role initial, fault)."""
    digits = 2 * len(rows) + 4  # a row is edited once and has at most one insertion before it; two may end the conversation
    width, head = digits * _DIGIT, (digits - 1) * _DIGIT
    low = (1 << width) - 1
    code = {e: i << head for i, e in enumerate(sorted(COST), 1)}

    def put(edit: str, way: int, more: int = 0) -> int:
        """``way`` with an edit before it."""
        return (((way >> width) + COST[edit] + more) << width) + code[edit] + ((way & low) >> _DIGIT)

    never = (4 * digits + 1) << width  # dearer than deleting all

    def inserted(ways: list[int], times: int) -> list[int]:
        best = ways
        for _ in range(times):
            best = [min(ways[q], put(INSERT, best[_NEXT[q]])) for q in range(4)]
        return best

    ways = inserted([0, never, never, 0], 2)
    for initial, fault in reversed(rows):
        here = []
        for q in range(4):
            way = put(DELETE, ways[q])
            if fault in (SOUND, TRUNCATED):
                more = TRUNCATED_COST * (fault == TRUNCATED)
                way = min(way, put(REROLE, ways[_NEXT[q]], more))
                if (q, initial) in _KEPT:
                    way = min(way, put(KEEP, ways[_KEPT[q, initial]], more))
            here.append(way)
        ways = inserted(here, 2)
    best, letters = ways[START], "".join(sorted(COST))
    text = "".join(letters[d - 1] for at in range(head, -1, -_DIGIT) if (d := (best >> at) & ((1 << _DIGIT) - 1)))
    return best >> width, text


VERDICT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Conversation:
    def __init__(self, conv: int | None):
        self.conv, self.rows, self.illegal, self.turns, self.first, self.last = conv, [], 0, 0, None, None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if self.rows and self.rows[-1][0] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.rows.append((initial, fault))
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1

    def verdict(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        faults = [f for _, f in self.rows]
        return (self.conv, gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), self.illegal, *cheapest(self.rows))


def verdicts(marks: DataFrame) -> DataFrame:
    """A row per conversation of ``marked`` rows: its gaps, counts of faults, cost and edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = None
        for batch in batches:
            done = []
            for this, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if conv is None or conv.conv != this:
                    done += [conv.verdict()] if conv else []
                    conv = _Conversation(this)
                conv.add(*row)
            yield _packed(done, VERDICT)
        if conv:
            yield _packed([conv.verdict()], VERDICT)

    return marks.sortWithinPartitions(*_ORDER).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault").mapInArrow(run, VERDICT)


_ARROW = {"long": pa.int64(), "string": pa.string()}


def _packed(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


TURNS = "conv_id long, seq long, role string, text string"


class _Repaired:
    """The repaired turns of one conversation, row by row."""

    def __init__(self, conv: int | None, audit: str):
        self.conv, self.audit, self.at, self.seq, self.state = conv, audit, 0, 0, START

    def _turn(self, state: int, role: str | None, text: str) -> tuple:
        role = role if role is not None else "user" if state == U else "assistant"
        self.state, self.seq = state, self.seq + 1
        return self.conv, self.seq - 1, role, text

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == INSERT:
            self.at += 1
            yield self._turn(_NEXT[self.state], None, "")

    def edited(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == KEEP:
            yield self._turn(_KEPT[self.state, role[:1]], role, text)
        elif edit == REROLE:
            yield self._turn(_NEXT[self.state], None, text)


def repaired(marks: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired turns (conv_id, seq from 0, role, text), in order within a conversation and partition.

    The edits of a conversation lead its rows, so texts are streamed once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = None
        for batch in batches:
            done = []
            for this, role, text, audit in zip(*(c.to_pylist() for c in batch.columns)):
                if audit is not None:
                    done += conv.inserted() if conv else ()
                    conv = _Repaired(this, audit)
                else:
                    done += conv.edited(role, text)
            yield _packed(done, TURNS)
        if conv:
            yield _packed(list(conv.inserted()), TURNS)

    none = F.lit(None)
    leads = found.select("conv_id", none.cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("content"), F.lit(-1).alias("copy"), none.cast("string").alias("text"), "audit")
    both = leads.unionByName(marks.select("conv_id", "turn", "role", "content", "copy", "text", none.cast("string").alias("audit")))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_ORDER[1:])
    return ordered.select("conv_id", "role", "text", "audit").mapInArrow(run, TURNS)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the turns that ``repaired`` returns (in its order): lines ``role:text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, some = None, None, False
        for batch in batches:
            done = []
            for this, seq, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if seq == 0:
                    done += [(conv, sha.hexdigest())] if some else []
                    conv, sha, some = this, hashlib.sha256(), True
                sha.update(f"{chr(10) if seq else ''}{role}:{text}".encode())
            yield _packed(done, "conv_id long, repaired_sha256 string")
        if some:
            yield _packed([(conv, sha.hexdigest())], "conv_id long, repaired_sha256 string")

    return turns.mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows (conv_id, turn, role, text) with planted faults, by the CRC of conv_id and turn; ``copy`` tells repeats apart."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(name("text"), ENDS, "")).otherwise(name("text"))
    copies = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(name("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """A row per conv_id of ``ids``: the verdict on its ``rows`` and the digest of its repaired turns; zeros and the empty text's if it has none."""
    marks = marked(rows)
    found = materialize(verdicts(marks))
    shas = digests(repaired(marks, found)).select(F.col("conv_id").alias("other"), "repaired_sha256")
    same: Column = F.col("conv_id").eqNullSafe(F.col("other"))
    out = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().join(found.withColumnRenamed("conv_id", "other"), same, "left").drop("other").join(shas, same, "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return report(damaged(rows), rows)


def _sql() -> str:
    half = []
    for i in range(16):  # the CRC-32 of each half byte
        for _ in range(4):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        half.append(i)
    nibble = f"xor(a >> 4, [{', '.join(map(str, half))}][(a & 15) + 1])"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0], lambda a, i: {nibble})), 4294967295)"
    put = lambda edit, cost, way: f"lpad((substr({way}, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || '{edit}' || substr({way}, 13)"
    never = "'900000000000'"

    def inserted(b: Sequence[str]) -> list[str]:
        """States start, s, u, a: at most two insertions, as more never pay."""
        one = [f"least({b[q]}, {put('I', 3, b[_NEXT[q]])})" for q in range(4)]
        return [f"least({b[q]}, {put('I', 3, one[_NEXT[q]])})" for q in range(4)]

    def edited(q: int) -> str:
        name = "wsua"
        to = f"w.{name[_NEXT[q]]}"
        kept = " ".join(f"WHEN initial = '{i}' THEN {put('K', 'more', 'w.' + name[t])}" for (p, i), t in _KEPT.items() if p == q)
        return f"least({put('D', 4, 'w.' + name[q])}, CASE WHEN gone THEN {never} ELSE {put('R', '3 + more', to)} END, CASE WHEN gone THEN {never} {kept} ELSE {never} END)"

    last = inserted(["'000000000000'", never, never, "'000000000000'"])
    return f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), kinds AS (
  SELECT *, {crc} % 20 AS kind FROM named
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged
), faults AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous
  FROM numbered
), steps AS MATERIALIZED (
  SELECT conv_id, i, initial, fault IN (1, 2) AS gone, CASE fault WHEN 3 THEN 3 ELSE 0 END AS more FROM faults
), ways AS (
  SELECT conv_id, max(i) AS i, {", ".join(f"{e} AS {n}" for e, n in zip(last, "wsua"))} FROM steps GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, {", ".join(f"{e} AS {n}" for e, n in zip(inserted(["e.w", "e.s", "e.u", "e.a"]), "wsua"))}
  FROM (SELECT w.conv_id, w.i - 1 AS i, {", ".join(f"{edited(q)} AS {'wsua'[q]}" for q in range(4))} FROM ways w JOIN steps r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i) e
), best AS (
  SELECT conv_id, substr(w, 1, 12)::BIGINT AS cost, substr(w, 13) AS audit FROM ways WHERE i = 0
), letters AS (
  SELECT conv_id, n, substr(audit, n, 1) AS edit FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS n FROM best)
), placed AS (
  SELECT *, CASE WHEN edit <> 'I' THEN count(*) FILTER (WHERE edit <> 'I') OVER till END AS i, count(*) FILTER (WHERE edit <> 'D') OVER till AS k FROM letters WINDOW till AS (PARTITION BY conv_id ORDER BY n)
), turns AS (
  SELECT p.conv_id, p.k, p.edit, f.role, coalesce(CASE WHEN edit <> 'I' THEN f.text END, '') AS text, max(CASE WHEN p.k = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS shift
  FROM placed p LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i WHERE edit <> 'D'
), shas AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k)) AS sha FROM turns GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
    count(*) FILTER (WHERE i > 1 AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT c.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal,
  coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, coalesce(s.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN shas s ON s.conv_id IS NOT DISTINCT FROM c.conv_id"""


QUERIES = {"op13_turn_repair": op13_turn_repair}
SQL = {"op13_turn_repair": _sql()}
