import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionflow.llm import simhash
from sessionflow.llm.common import components

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW))
    if not words:
        return 0
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((rows[i][0], f"{fps[i]:016x}", min(ids, default=None)))
    return out


LONG = " ".join(f"w{i % 37}x{i}" for i in range(3000))
ROWS = [
    (5, "The quick brown fox jumps over the lazy dog again and again"), (3, "the QUICK brown fox jumps over the lazy dog again and again"), (9, "The quick brown fox jumps over the lazy dog again and again\n"),
    (7, None), (8, ""), (2, " \t\n"), (None, "lone text of a null id here"), (11, "one"), (12, "one two three"), (4, LONG), (6, LONG + " tail"), (6, LONG + " tail"), (None, None), (13, "É É É é"),
]


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).select("doc_id", "fp", "component_id").collect()
    found = [(r[0], f"{r[1] % (1 << 64):016x}", r[2]) for r in got]
    assert sorted(found, key=str) == sorted(brute_components(ROWS), key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []
    assert simhash.keep_first(df).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 63), max_size=4))
def test_masks_cover_every_difference(bits):
    d = sum(1 << b for b in bits)
    assert any(m & d == 0 for m in simhash.masks(4))


@pytest.mark.parametrize("block", [3, 1000])
def test_links_connect_what_all_pairs_do(spark, block):
    """A dense ball of fingerprints: large buckets are cut into blocks and nothing is lost."""
    base = 0x123456789ABCDEF0
    fps = [base ^ (1 << i) ^ (1 << (i * 7 % 64)) for i in range(40)] + [base ^ 0xFFFF << 8, base ^ 0xFFFF << 8 ^ 0b1011]
    signed = [x - (1 << 64) if x >> 63 else x for x in set(fps)]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, block)
    roots = {r["v"]: r["root"] for r in components(edges).collect()}
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in signed:
        for b in signed:
            if ((a ^ b) % (1 << 64)).bit_count() <= 4:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {x: roots.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 300)], "a long, b long")
    roots = {r["v"]: r["root"] for r in components(edges).collect()}
    assert all(roots[i] == 0 for i in range(61)) and roots[300] == 200


def test_keep_first_keeps_one_of_each_group(spark):
    df = spark.createDataFrame([(i, t, "src") for i, t in ROWS], "doc_id long, text string, _id string")
    kept = simhash.keep_first(df).collect()
    groups = {}
    for (i, t), (_, _, c) in zip(ROWS, brute_components(ROWS)):
        groups.setdefault((c, brute_fingerprint(t) if c is None else None), []).append(i)
    assert len(kept) == len(groups)
    assert {r["doc_id"] for r in kept} == {min((x for x in g if x is not None), default=None) for g in groups.values()}
    assert kept[0].asDict().keys() == {"doc_id", "text", "_id"} and {r["_id"] for r in kept} == {"src"}
