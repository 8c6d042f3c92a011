"""Large groups of near copies in the pipeline's near-duplicate stage."""

import random

import pytest

from sessionflow.llm import simhash

from .test_similar import brute_firsts


def near_copies(n):
    rng, base = random.Random(5), [f"w{i}" for i in range(150)]
    out = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(2, 9)):
            words[at] = f"x{i}y{at}"
        out.append((i, " ".join(words)))
    return out


def test_near_copies_send_few_rows(spark):
    """Each of n near copies meets the others in most of its bands; their buckets hold a few rows a text, not one for every band."""
    rows = near_copies(160)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = simhash._marks(df.selectExpr("doc_id", "xxhash64(text) AS text_hash", "text"), 5, *simhash.bands_of(len(rows)))
    buckets = simhash.near_buckets(marks.select("v", "fp", "fq", "keys")).cache()
    assert buckets.select("v").distinct().count() == len(rows) and buckets.count() <= 3 * len(rows)
    none = spark.createDataFrame([], "v long, root long")
    assert simhash.open_blocks(buckets, none, marks.selectExpr("v", "X'00' AS set")).count() <= 3 * len(rows)


@pytest.mark.parametrize("block", [16, 256])
def test_near_copies_lose_no_link(spark, block):
    """Some of the copies are 0.8 alike and some are not; the groups are those of all pairs."""
    rows = near_copies(160)
    groups = {}
    for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect():
        groups.setdefault(r["root"], []).append(r["doc_id"])
    want = brute_firsts(rows)
    assert {min(g) for g in groups.values()} == want and 1 < len(want) < len(rows)


def test_joins_make_few_rows_a_near_copy(spark, monkeypatch):
    """The joins on texts and on the parts' smallest texts make a few rows a text, though near copies meet in most of their bands."""
    rows = near_copies(160)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = simhash.materialize(simhash._marks(df.selectExpr("doc_id", "xxhash64(text) AS text_hash", "text"), 5, *simhash.bands_of(len(rows))))
    join, made = type(df).join, []

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if isinstance(on, str) and on in ("v", "least"):
            made.append(out.count())
        return out

    monkeypatch.setattr(type(df), "join", counted)
    buckets = simhash.near_buckets(marks.select("v", "fp", "fq", "keys"), wide=marks.select("v", "wide"))
    assert buckets.select("v").distinct().count() == len(rows)
    assert made and max(made) <= 8 * len(rows)


@pytest.mark.parametrize("block", [16, 1024])
def test_texts_that_meet_in_a_band_stay_together(spark, block):
    """Every two texts that share a band and are near by both kinds of bits are in one bucket, however crowds are gathered and cut."""
    rows = near_copies(90) + [(1000 + i, f"a{i // 3} " * 3 + " ".join(f"{i // 3}p{j}" for j in range(80 + i % 3))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = simhash.materialize(simhash._marks(df.selectExpr("doc_id", "xxhash64(text) AS text_hash", "text"), 5, *simhash.bands_of(len(rows))))
    held = {}
    for r in simhash.near_buckets(marks.select("v", "fp", "fq", "keys"), block=block, wide=marks.select("v", "wide")).collect():
        held.setdefault(r["v"], set()).add(r["key"])

    def apart(x, y):
        return sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(x, y))

    texts, met = marks.collect(), 0
    for i, x in enumerate(texts):
        for y in texts[:i]:
            if x["v"] != y["v"] and set(x["keys"]) & set(y["keys"]) and apart((x["fp"], x["fq"]), (y["fp"], y["fq"])) <= simhash.NEAR and apart(x["wide"], y["wide"]) <= simhash.CLOSE:
                met += 1
                assert held.get(x["v"], set()) & held.get(y["v"], set())
    assert met > 1000
