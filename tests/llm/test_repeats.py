import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionflow.llm import repeats
from sessionflow.llm.common import mix


def brute(rows, width=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - width + 1) if i is not None else ():
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1) if i is not None else ():
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int")
    return [tuple(r) for r in repeats.remove_repeats(df, digest=True, **options).collect()]


SHARED = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, f"intro words {SHARED} outro"), (2, f"another {SHARED}\tend of it"), (3, SHARED[:40]), (4, None), (5, ""), (6, " \n "), (None, SHARED), (7, "a " * 40), (8, "a " * 14), (9, "a " * 12),
    (10, "a b " * 20), (11, "b a " * 10), (12, f"É ü x {SHARED} {SHARED}"), (2, f"same id {SHARED}"), (13, " ".join(f"u{i}" for i in range(30_000))), (14, " ".join(f"u{i}" for i in range(29_000, 29_020))), (15, "x" * 5000 + " y"),
]


@pytest.mark.parametrize("options", [{}, {"blocks": 3}, {"blocks": 64}])
def test_matches_brute_force(spark, options):
    assert sorted(run(spark, ROWS, **options), key=str) == sorted(brute(ROWS), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_small_alphabets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("abc") if seed else rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(40)]
    for width in (5, 13):
        assert sorted(run(spark, rows, width=width)) == sorted(brute(rows, width))


def test_text_and_empty_table(spark):
    df = spark.createDataFrame(ROWS[:2], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in repeats.remove_repeats(df).collect()}
    assert texts == {1: f"intro words {SHARED} outro", 2: "another end of it"}
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=13, max_size=13), st.lists(st.integers(0, 3), max_size=20), st.lists(st.integers(0, 3), max_size=20), st.lists(st.integers(0, 3), max_size=20))
def test_a_window_has_one_signature_everywhere(window, a, b, c):
    """Whatever stands around a window, its signature is the same."""
    names = mix(np.arange(1, 5, dtype=np.uint64))
    found = set()
    for before, after in ((a, b), (c, a), ([], [])):
        sym = names[np.array([*before, *window, *after])]
        doc = np.zeros(len(sym), np.int64)
        starts = repeats.window_starts(doc, 13)
        found.add(int(repeats.signatures(sym, doc, starts, 13)[len(before)]))
    assert len(found) == 1


def thue_morse(n, flip=False):
    """Words over two letters on which every polynomial hash modulo a power of two collides with the complement."""
    return "".join("ab"[(i.bit_count() & 1) ^ flip] for i in range(n))


OTHERS = " ".join(f"o{i}" for i in range(12))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_made_to_collide_stay(spark, n):
    rows = [(1, f"{thue_morse(n)} {OTHERS}"), (2, f"{thue_morse(n, True)} {OTHERS}"), (3, f"{thue_morse(n)} {OTHERS} end")]
    assert [r[2] for r in sorted(run(spark, rows, blocks=1))] == [0, 0, 13]
    assert sorted(run(spark, rows)) == sorted(brute(rows))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.booleans(), st.integers(8, 11)), min_size=2, max_size=6))
def test_adversarial_long_words(parts):
    """Documents of one long word, built of Thue-Morse blocks, and twelve others: names agree only where words do."""
    import pyarrow as pa

    words = ["x" * k + thue_morse(1 << e, flip) + "y" * k for k, flip, e in parts]
    docs = pa.table({"doc_id": pa.array(range(len(words)), pa.int64()), "text": [f"{w} {OTHERS}" for w in words], "block": pa.array([0] * len(words), pa.int32())})
    shared = repeats._shared(repeats._signed(docs, 13, 1))
    later = repeats._later(repeats._named(docs, shared, 13, 1))
    removed = repeats._cut(docs, later, 13).column("n_removed").to_pylist()
    assert removed == [13 if w in words[:i] else 0 for i, w in enumerate(words)]


def test_sequences_decide_where_names_agree(spark, monkeypatch):
    """Even if every window had one name, the SHA-256 of its words would tell windows apart."""
    import pyarrow as pa

    rows = [(1, f"a {OTHERS}"), (2, f"b {OTHERS}"), (3, f"a {OTHERS}")]
    docs = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows], "block": pa.array([0] * 3, pa.int32())})
    monkeypatch.setattr(repeats.Words, "names", lambda self: np.ones(len(self.starts), np.uint64))
    later = repeats._later(repeats._named(docs, repeats._shared(repeats._signed(docs, 13, 1)), 13, 1))
    assert repeats._cut(docs, later, 13).column("n_removed").to_pylist() == [0, 0, 13]


def test_null_ids_take_no_part_however_many(spark):
    rows = [(None, SHARED)] * 300 + [(1, SHARED), (2, SHARED)]
    got = run(spark, rows)
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
