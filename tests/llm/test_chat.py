import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionflow.llm import chat


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "|", "turn", "|>", "\\", "</s>", "<s>", "[INST]", "[/INST]", "<|end|>\n", "a", "\n", "é", "<|text|>"]), max_size=20))
def test_escape_is_reversible_and_hides_control_strings(parts):
    text = "".join(parts)
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)


@pytest.mark.parametrize(
    "record, want",
    [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, [("user", "a"), ("assistant", "b")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
        ({"prompt": "a", "response": "b"}, [("user", "a"), ("assistant", "b")]),
        ({"instruction": "a", "input": "i", "output": "b"}, [("user", "a\ni"), ("assistant", "b")]),
        ({"instruction": "a", "input": "", "output": "b"}, [("user", "a"), ("assistant", "b")]),
        ({"turn": {"speaker": "x", "utterance": {"text": None}}}, [("x", "")]),
        ({"role": None, "content": "c"}, [("", "c")]),
    ],
)
def test_layouts(record, want):
    assert chat.turns(json.dumps(record), chat.registry())[1] == want


def test_fields_that_are_no_strings_stand_as_json():
    for value in ("true", "false", "[]", "{}", "1e400", "0.10", "-0", "12345678901234567890123"):
        assert chat.turns(f'{{"prompt": {value}}}', chat.registry())[1] == [("user", value)]
    assert chat.turns('{"role": 7, "content": false}', chat.registry())[1] == [("7", "false")]


LEAF = st.one_of(st.text(max_size=6), st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False))
NAMES = st.sampled_from(["messages", "role", "content", "turn", "speaker", "turn.speaker", "turn.utterance.text", "utterance", "text", "messages[].role", "messages[]", "messages\\", "a\\.b", "prompt", "response", "system", "", "."])
RECORD = st.recursive(LEAF, lambda inner: st.one_of(st.lists(inner, max_size=3), st.dictionaries(NAMES, inner, max_size=3)), max_leaves=8)


def strings(value):
    if isinstance(value, dict):
        return [s for v in value.values() for s in strings(v)]
    return [s for v in value for s in strings(v)] if isinstance(value, list) else [value] if isinstance(value, str) else []


@settings(max_examples=500, deadline=None)
@given(RECORD)
def test_no_text_of_any_record_is_lost(record):
    raw = json.dumps(record)
    found = chat.turns(raw, chat.registry())[1]
    back = {"user": "human", "assistant": "gpt"}
    said = [x for role, text in found for x in (role, back.get(role, role), text)]
    assert found == [("unmapped", raw)] or all(any(s in x for x in said) for s in strings(record))


def test_escaped_names_can_be_mapped():
    layout = {"paths": (r"a\.b.c\[\]",), "each": None, "turns": (("=user", (r"a\.b.c\[\]",)),), "roles": {}}
    assert chat.turns('{"a.b": {"c[]": "x"}}', chat.registry((layout,)))[1] == [("user", "x")]
    assert chat.turns('{"a": {"b": {"c": ["x"]}}}', chat.registry((layout,)))[1][0][0] == "unmapped"


def test_unknown_layouts_are_kept():
    flat = ('{"": {"prompt": "x"}}', '{"turn.speaker":"user","turn.utterance.text":"hello"}', '{"messages[].role":"user","messages[].content":"hi"}', '{"prompt":"a","prompt":"b"}', '{"prompt": NaN}')
    for raw in ('{"q": 1, "zz": []}', "not json", "null", "[]", *flat):
        assert chat.turns(raw, chat.registry())[1] == [("unmapped", raw)]


ROWS = [
    (1, 0, "system", "s"), (1, 1, "user", "u </s>"), (1, 2, "assistant", "a <|end|>\n"), (2, 0, "user", None), (2, 1, "assistant", ""), (3, None, "assistant", "first"), (3, 5, "user", "later"), (4, 0, None, "no role"), (5, 0, "human", "raw role"),
    (None, 0, "assistant", "null id"), (6, 0, "assistant", "dup"), (6, 0, "assistant", "dup"), (7, 0, "assistant", "long " * 20_000),
] + [(8, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(2000)]


def digest(turns):
    h, loss, n = hashlib.sha256(), "", 0
    for role, text in turns:
        h.update(f"{role or ''}\n{text or ''}\n".encode())
        loss += (text or "") if role == "assistant" else ""
        n += 1
    return n, h.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, 0) for r in ROWS], "conv_id long, turn long, role string, text string, seq int")
    formatted = chat.format_records(chat.as_records(df))
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(formatted).collect()}
    convs = {}
    for c, t, role, text in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role, text))
    assert got == {c: digest(t) for c, t in convs.items()}
    rows = formatted.where("conv_id = 1").orderBy("seq").collect()
    whole = "".join(r["segment"] for r in rows)
    assert [whole[r["start"] : r["start"] + len(r["segment"])] for r in rows] == [r["segment"] for r in rows]
    assert [chat.unescape(whole[r["loss_start"] : r["loss_end"]]) for r in rows] == ["", "", "a <|end|>\n"]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_records(chat.as_records(df))).collect() == []


@pytest.mark.parametrize("raw", ["[" * 100_000, '{"prompt":"\\ud800"}', '{"a\\udfff":1}', '{"prompt":' * 3000 + "1" + "}" * 3000, "\x00", "nul"])
def test_records_that_cannot_be_parsed_or_written_are_kept(raw):
    assert chat.turns(raw, chat.registry())[1] == [("unmapped", raw)]
