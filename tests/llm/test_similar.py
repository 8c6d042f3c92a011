import random
import re

import pytest

from sessionflow.llm import simhash


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    k = min(k, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def brute_firsts(rows, similarity=0.8):
    """The smallest id of each group of texts that links of the similarity connect."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    return {min(r[0] for r, x in zip(rows, label) if x == y) for y in set(label)}


BASE = [f"w{i}" for i in range(120)]
SWAPPED = [*BASE[:40], "x", *BASE[41:80], "y", *BASE[81:]]  # Jaccard 106 / 126
FAR = [*SWAPPED[:20], "z", *SWAPPED[21:100], "q", *SWAPPED[101:]]  # linked to SWAPPED alone
ROWS = [(1, BASE), (2, SWAPPED), (3, FAR), (4, [*BASE[:60], *(f"v{i}" for i in range(60))]), (5, ["a", "b"]), (6, ["A", "b"]), (7, []), (8, [])]


@pytest.mark.parametrize("block", [2, 256])
def test_links_are_of_the_similarity(spark, block):
    """Texts many bits apart are linked from a Jaccard of 0.8 on, and none below."""
    rows = [(i, " ".join(w)) for i, w in ROWS] + [(9, None)]
    fps = [int.from_bytes(simhash.fingerprint(t.encode(), 4, 42), "big") for _, t in rows[:2]]
    assert (fps[0] ^ fps[1]).bit_count() > 4
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {}
    for r in simhash.similar_texts(df, block=block).collect():
        groups.setdefault(r["root"], []).append(r["doc_id"])
    assert {min(g) for g in groups.values()} == brute_firsts(rows) == {1, 4, 5, 7}


def test_texts_below_the_similarity_stay(spark):
    """Few bits apart, yet less alike than 0.8."""
    a = " ".join(["same"] * 400 + [f"a{i}" for i in range(4)])
    b = " ".join(["same"] * 400 + [f"b{i}" for i in range(4)])
    x, y = (int.from_bytes(simhash.fingerprint(t.encode(), 4, 42), "big") for t in (a, b))
    assert (x ^ y).bit_count() <= 4
    assert simhash.keep_first(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).count() == 2


def test_large_group_and_test_table(spark, sf):
    many = [(i, " ".join([*BASE[: i % 100], f"n{i}", *BASE[i % 100 + 1 :]])) for i in range(60)]
    rows = many + [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in kept} == brute_firsts(rows) and len(kept) == len(brute_firsts(rows))


def test_slices_of_a_batch_have_the_same_shingles():
    texts = simhash.pa.array([" ".join([f"{i}w{j}" for j in range(9)]) for i in range(50)])
    whole, part = simhash._shingles(texts, 5), simhash._shingles(texts.slice(20, 30), 5)
    assert [s.tolist() for s in part] == [s.tolist() for s in whole[20:]] and all(len(s) == 5 for s in whole)


def test_a_chain_of_candidates_sends_few_sets(spark):
    """Texts 0.65 alike to the next hang together by their bands; each is compared with few others and all stay."""
    n, long, step = 1500, 104, 21  # 79 of 121 shingles in common with the next
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i * step, i * step + long))) for i in range(n)], "doc_id long, text string")
    marks = simhash._marks(df.selectExpr("doc_id", "xxhash64(text) AS text_hash", "text"), 5)
    buckets = simhash.band_buckets(marks.select("v", "keys")).cache()
    assert buckets.select("v").distinct().count() > 0.9 * n
    sets = marks.selectExpr("v", "X'00' AS set")
    none = spark.createDataFrame([], "v long, root long")
    assert simhash.first_pairs(buckets, sets).count() <= 2 * n and simhash.open_blocks(buckets, none, sets).count() < 6 * n
    groups = simhash.components(buckets.selectExpr("v AS a", "least AS b")).groupBy("root").count()
    assert groups.agg({"count": "max"}).first()[0] > simhash.PARTY / 4  # candidates do form long chains
    assert simhash.keep_first(df).count() == n


@pytest.mark.parametrize("block", [2, 7])
def test_groups_that_the_first_text_does_not_link(spark, block):
    """Members of a large group are linked through each other where the first of their bucket is too far."""
    rng = random.Random(3)
    rows, words = [], list(BASE)
    for i in range(80):  # a drift: neighbours are alike, the ends are not
        at = rng.randrange(len(words))
        words[at] = f"d{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(words[: 118 - i % 3])) for i in range(12)]
    rng.shuffle(rows)
    groups = {}
    for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect():
        groups.setdefault(r["root"], []).append(r["doc_id"])
    assert {min(g) for g in groups.values()} == brute_firsts(rows)
