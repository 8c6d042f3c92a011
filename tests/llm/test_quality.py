import random
import zlib

import numpy as np
import pytest

from sessionflow.llm import quality


def corpus(n=400):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        good = i % 4 != 0
        if not good:
            body = [body[0]] * len(body) if i % 8 else [w.upper() + "!!" for w in body]
        docs.append((i, " ".join(body).capitalize() + ".", "x"))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_rows_are_ranked(spark):
    docs, labels = corpus()
    extra = [(9001, None, "x"), (9002, "", "x"), (None, "some text", "x"), (3, docs[3][1], "x"), (9003, "w " * 50_000, "x")]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, y string")
    lab = spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0), (6, 7, 0), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(df, lab)
    scores = quality.score(df, model).collect()
    assert len(scores) == len(docs) + len(extra) and all(0 <= r["score"] <= 1 for r in scores)
    truth = {i: q for i, q, _ in labels}
    held = [(r["score"], truth[r["doc_id"]]) for r in scores if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum((s >= quality.THRESHOLD) == (q == 1) for s, q in held) >= 0.97 * len(held)
    same = [r["score"] for r in scores if r["doc_id"] == 3]
    assert len(same) == 2 and same[0] == same[1]
    kept = quality.accepted(df, model)
    assert kept.columns == ["doc_id", "text", "y"]
    assert kept.count() == sum(r["score"] >= quality.THRESHOLD for r in scores)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, y string")
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    a, b = (quality.train(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert np.array_equal(a["w"], b["w"]) and a["edge"] == b["edge"]


def test_without_both_labels(spark):
    df = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.train(df, lab) is None and quality.train(df, lab.limit(0)) is None
    assert [tuple(r) for r in quality.score(df, None).collect()] == [(1, 0.5)]
    assert quality.accepted(df, None).count() == 1 and quality.score(df.limit(0), None).collect() == []


def test_pairs_are_bradley_terry():
    """On one feature the fit reaches the optimum of the pairwise logistic loss."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(1, 1, 300), rng.normal(0, 1, 300)])[:, None]
    y = np.array([1] * 300 + [0] * 300)
    m = quality.fit(x, y, pairs=20_000, ridge=1e-9)
    z = (x - m["mean"]) / m["std"]
    rng = np.random.default_rng(7)
    d = z[rng.choice(np.flatnonzero(y == 1), 20_000)] - z[rng.choice(np.flatnonzero(y == 0), 20_000)]
    gradient = (d[:, 0] / (1 + np.exp(d[:, 0] * m["w"][0]))).mean()
    assert gradient == pytest.approx(0, abs=1e-9)


def test_quality_on_the_table(spark, sf):
    rows = quality.op9_bradley_terry(spark, "/root/testdata/sf0.01" if "0.001" in sf else sf).collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(("/root/testdata/sf0.01" if "0.001" in sf else sf) + "/labels.parquet").collect()}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)


def plain_features(text):
    """Hashed features by a loop over words and trigrams."""
    import xxhash

    words, out = (text or b"").split(), [0.0] * (quality.WORDS + quality.GRAMS)
    if not words:
        return out
    for w in words:
        out[xxhash.xxh3_64_intdigest(w) % quality.WORDS] += 1 / len(words)
    for k in range(len(text) - 2):
        code = int.from_bytes(text[k : k + 3], "big") * 0x9E3779B1
        out[quality.WORDS + (code >> 12) % quality.GRAMS] += 1 / (len(text) - 2)
    return [v**0.5 for v in out]


TEXTS = ["", None, " \n", "a", "ab", "a b", "one two two\nThree, four!", "É ü ñ " * 50, "x" * 3000, "word " * 4000]


def test_scores_match_plain_python(spark):
    docs, labels = corpus(120)
    df = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(1000 + k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    m = quality.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["score"] for r in quality.score(df, m).collect()}
    for r in df.collect():
        raw = None if r["text"] is None else r["text"].encode()
        x, worth = [*quality.shape(raw), *plain_features(raw)], 0.0
        for v, mean, std, w in zip(x, m["mean"], m["std"], m["w"]):
            worth += w * min(8.0, max(-8.0, (v - mean) / std))
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-((worth - m["edge"]) / m["scale"] + m["at"]))), abs=1e-9)


def test_threshold_is_a_quantile():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1000, 3))
    y = (x[:, 0] + rng.normal(size=1000) > -0.5).astype(int)
    for quantile in (None, 0.1, 0.5):
        m = quality.fit(x, y, quantile=quantile)
        assert (quality.score_rows(m, x) < quality.THRESHOLD).mean() == pytest.approx(1 - y.mean() if quantile is None else quantile, abs=0.002)


def test_features_do_not_hang_on_neighbours():
    import pyarrow as pa

    both = quality.features(pa.array(TEXTS))
    for k, t in enumerate(TEXTS):
        assert np.allclose(both[k], quality.features(pa.array([t], pa.string()))[0])
