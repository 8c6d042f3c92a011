"""Chat formatting by schema fingerprints.

A record's layout is the set of its nested field paths; a hash of that set
selects a declarative mapping which turns the record into canonical turns
(role, text). Turns are written in a template that marks each turn, escapes
control strings inside texts reversibly and masks what is trained on.

A conversation's records lie in one partition in the order of their turn and
are streamed: a task holds one Arrow batch and a few numbers of state, never a
whole conversation, so a conversation of any length passes.

Defined cases: a null text or role is empty; a mapped field that is no string
is written as the JSON it came as; names that hold a dot, a bracket or a
backslash are escaped in paths, so a flat record never passes for a nested one;
a record whose layout no mapping knows, that is no JSON, bears a name twice, is
nested too deep to parse or whose texts hold half a surrogate pair is one turn
of role ``unmapped`` with the raw record as its text, so nothing is lost; null turns come first, ties are ordered by the record;
repeated rows are turns of their own; a null conv_id is a conversation; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_ROLES = {"human": "user", "gpt": "assistant"}
#: Layouts: their field paths, where the turns are, and each turn's role and text ("=" marks a constant role).
LAYOUTS = (
    {"paths": ("messages[].role", "messages[].content"), "each": "messages", "turns": (("role", ("content",)),), "roles": {}},
    {"paths": ("conversations[].from", "conversations[].value"), "each": "conversations", "turns": (("from", ("value",)),), "roles": _ROLES},
    {"paths": ("role", "content"), "each": None, "turns": (("role", ("content",)),), "roles": {}},
    {"paths": ("turn.speaker", "turn.utterance.text"), "each": None, "turns": (("turn.speaker", ("turn.utterance.text",)),), "roles": {}},
    {"paths": ("system",), "each": None, "turns": (("=system", ("system",)),), "roles": {}},
    {"paths": ("prompt",), "each": None, "turns": (("=user", ("prompt",)),), "roles": {}},
    {"paths": ("response",), "each": None, "turns": (("=assistant", ("response",)),), "roles": {}},
    {"paths": ("prompt", "response"), "each": None, "turns": (("=user", ("prompt",)), ("=assistant", ("response",))), "roles": {}},
    {"paths": ("instruction", "input"), "each": None, "turns": (("=user", ("instruction", "input")),), "roles": {}},
    {"paths": ("output",), "each": None, "turns": (("=assistant", ("output",)),), "roles": {}},
    {"paths": ("instruction", "input", "output"), "each": None, "turns": (("=user", ("instruction", "input")), ("=assistant", ("output",))), "roles": {}},
)
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Strings that open or close something in this template or in common ones; "<|" opens all of ours.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]")
_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_SPECIAL, _STEP = re.compile(r"([\\.\[\]])"), re.compile(r"(?:^|\.)((?:[^\\.]|\\.)*)", re.DOTALL)
_SEGMENT = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)


def paths(value: object, at: str | None = None) -> set[str]:
    """The field paths of a record's leaves; ``[]`` stands for any list element, names are escaped by backslashes."""
    if isinstance(value, dict) and value:
        names = ((_SPECIAL.sub(r"\\\1", k), v) for k, v in value.items())
        return set().union(*(paths(v, k if at is None else f"{at}.{k}") for k, v in names))
    if isinstance(value, list) and value:
        return set().union(*(paths(v, f"{at or ''}[]") for v in value))
    return {at or ""}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def registry(layouts=LAYOUTS) -> dict[str, dict]:
    return {fingerprint(set(x["paths"])): x for x in layouts}


def _at(record: object, path: str) -> object:
    """What stands at a path without list elements."""
    for key in _STEP.findall(path):
        record = record.get(_UNESCAPE.sub(r"\1", key)) if isinstance(record, dict) else None
    return record


class _Number(str):
    """A number as it was written."""


def _once(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a name stands twice in a record")
    return found


def _constant(name: str) -> object:
    raise ValueError(f"{name} is no JSON")


def _parsed(raw: str) -> object:
    return json.loads(raw, object_pairs_hook=_once, parse_int=_Number, parse_float=_Number, parse_constant=_constant)


def _text(value: object) -> str:
    if value is None:
        return ""
    return str(value) if isinstance(value, str) else json.dumps(value)  # true, false, [] or {}


def turns(raw: str, known: dict[str, dict]) -> tuple[str, list[tuple[str, str]]]:
    """(fingerprint, canonical turns) of a JSON record."""
    try:
        record = _parsed(raw)
        mark = fingerprint(paths(record))
    except (ValueError, RecursionError):  # no JSON, nested too deep, or half a surrogate pair in a name
        record, mark = None, fingerprint({""})
    layout = known.get(mark)
    if layout is None:
        return mark, [("unmapped", raw)]
    out = []
    for item in _at(record, layout["each"]) if layout["each"] else [record]:
        for role, fields in layout["turns"]:
            name = role[1:] if role[0] == "=" else _text(_at(item, role))
            parts = [_text(_at(item, f)) for f in fields]
            out.append((layout["roles"].get(name, name), "\n".join([parts[0], *(p for p in parts[1:] if p)])))
    try:
        "".join(x for turn in out for x in turn).encode()
    except UnicodeEncodeError:  # an escaped half of a surrogate pair: no text that can be written
        return mark, [("unmapped", raw)]
    return mark, out


def escape(text: str) -> str:
    """A backslash before each backslash, and after the first character of each control string."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


FORMATTED = "conv_id long, seq long, fingerprint string, segment string, start long, loss_start long, loss_end long"


def format_records(records: DataFrame, layouts=LAYOUTS, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn of records (conv_id, turn, record as JSON), in order within each conversation.

    ``segment`` is the formatted turn, ``start`` its offset in the formatted
    conversation, ``loss_start`` and ``loss_end`` what of it is trained on.
    """
    known = registry(layouts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seq, offset = object(), 0, 0
        for batch in batches:
            rows = []
            for this, raw in zip(batch.column("conv_id").to_pylist(), batch.column("record").to_pylist()):
                if this != conv:
                    conv, seq, offset = this, 0, 0
                mark, found = turns(raw or "", known)
                for role, text in found:
                    head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
                    begin = offset + len(head)
                    end = begin + len(body) if role in trained else begin
                    rows.append((conv, seq, mark, f"{head}{body}{END}", offset, begin, end))
                    seq, offset = seq + 1, offset + len(head) + len(body) + len(END)
            columns = list(zip(*rows)) if rows else [()] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "seq", "fingerprint", "segment", "start", "loss_start", "loss_end"])

    ordered = records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "record").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "record")
    return ordered.select("conv_id", "record").mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """A row per conversation, read from the segments that ``format_records`` returns (in its order).

    Rows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    """

    class State:
        def __init__(self, conv):
            self.conv, self.turns, self.loss, self.n, self.loss_chars, self.chars = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0

        def add(self, segment: str, start: int, loss_start: int, loss_end: int) -> None:
            for role, text in _SEGMENT.findall(segment):
                self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                self.n += 1
            trained = unescape(segment[loss_start - start : loss_end - start])
            self.loss.update(trained.encode())
            self.loss_chars, self.chars = self.loss_chars + len(trained), self.chars + len(segment)

        def row(self):
            return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 6
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            for conv, *rest in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "start", "loss_start", "loss_end"))):
                if state is None or state.conv != conv:
                    done += [state.row()] if state else []
                    state = State(conv)
                state.add(*rest)
            yield pack(done)
        if state:
            yield pack([state.row()])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_records(rows: DataFrame) -> DataFrame:
    """Conversation rows as JSON records in the layouts that sources deliver; the layout goes by conv_id and role."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    plain = F.to_json(F.struct(F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages")))
    named = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    shared = F.to_json(F.struct(F.array(F.struct(named.alias("from"), text.alias("value"))).alias("conversations")))
    one = {"system": "system", "user": "prompt", "assistant": "response"}
    single, instructed = plain, plain
    for r, field in one.items():
        single = F.when(role == r, F.to_json(F.struct(text.alias(field)))).otherwise(single)
    instructed = F.when(role == "user", F.to_json(F.struct(text.alias("instruction"), F.lit("").alias("input")))).when(role == "assistant", F.to_json(F.struct(text.alias("output")))).otherwise(plain)
    kind = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(4))
    record = F.when(~role.isin(*one), plain).when(kind == 1, shared).when(kind == 2, single).when(kind == 3, instructed).otherwise(plain)
    return rows.select("conv_id", "turn", record.alias("record"))


def op6_schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return read_back(format_records(as_records(rows)))


def _sql() -> str:
    escaped = "replace(coalesce(text, ''), '\\', '\\\\')"
    for c in CONTROL:
        escaped = f"replace({escaped}, '{c}', '{c[0]}\\{c[1:]}')"
    frame = len(TURN) + len(TEXT) + len(END)
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, {escaped} AS escaped FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]', '<\\/s>[\\INST] ok [\\/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({frame} + length(role) + length(escaped))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id"""


QUERIES = {"op6_schema_fingerprint": op6_schema_fingerprint}
SQL = {"op6_schema_fingerprint": _sql()}
