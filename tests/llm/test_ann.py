import numpy as np
import pytest

from sessionflow.llm import ann


def brute(rows, queries, k):
    clean = [(i, np.array(v, float)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v))]
    out = {}
    for q, x in clean:
        if q in queries:
            near = [(-float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), i) for i, y in clean if i != q and len(y) == len(x)]
            out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in near)[:k]]
    return out


def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    base = [(i, (centres[i % 8] + 0.3 * rng.normal(size=16)).tolist()) for i in range(400)]
    same = [(1000 + i, [1.0] * 16) for i in range(60)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (None, [1.0] * 16), (2005, [float("inf")] * 16), (2006, [1.0, 2.0, 3.0]), (2007, [1.0, 2.0, 3.1]), (5, base[5][1])]
    return base + same + odd


@pytest.mark.parametrize("part", [16, 8192])
def test_recall_and_scores(spark, part):
    data = rows()
    df = spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id long, embedding array<double>, n int")
    queries = {i for i, _ in data if i is not None and i % 10 == 0} | {2006}
    found = {}
    got = ann.nearest(df, df.where("vec_id % 10 = 0 or vec_id = 2006"), part=part).orderBy("query_id", "rank").collect()
    for r in got:
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    want = brute(data, queries, 5)
    assert set(found) == {q for q in want if want[q]}
    hit = sum(len({i for i, _ in want[q]} & {i for i, _ in found.get(q, [])}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    by = {q: dict(v) for q, v in want.items()}
    for q, v in found.items():
        for i, s in v:
            assert i not in by[q] or s == pytest.approx(by[q][i], abs=1e-12)
    assert [i for i, _ in found[1000]] == [1001, 1002, 1003, 1004, 1005]
    assert [i for i, _ in found[1050]] == [1000, 1001, 1002, 1003, 1004]
    assert [i for i, _ in found[2006]] == [2007]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(df, df).collect() == []


def test_rotation_keeps_length():
    x = np.random.default_rng(1).normal(size=(5, 10))
    assert np.allclose(np.linalg.norm(ann.rotation(x, 3), axis=1), np.linalg.norm(x, axis=1))


def test_recall_on_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    data = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = {}
    for r in ann.nearest(df, df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(data, {i for i, _ in data}, 5)
    assert sum(len({i for i, _ in v} & got.get(q, set())) for q, v in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_repeated_ids_are_queries_and_candidates_of_their_own(spark):
    data = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, df.where("vec_id = 1"), k=3).collect())
    # Each vector of id 1 has its own list; the other vector of that id is a candidate.
    assert got == [(1, 1, 2), (1, 1, 3), (1, 2, 2), (1, 2, 3), (1, 3, 1), (1, 3, 1)]


def test_magnitudes_do_not_matter(spark):
    data = [(0, [1e200, 1e200]), (1, [1e200, 2e200]), (2, [1.0, 1.0]), (3, [1e-200, 1.5e-200]), (4, [-1.0, 5e-324])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["score"] for r in ann.nearest(df, df.where("vec_id = 0")).collect()}
    assert got == pytest.approx({1: 3 / np.sqrt(10), 2: 1.0, 3: 2.5 / np.sqrt(6.5), 4: -1 / np.sqrt(2)})


def test_probed_are_the_best_sums():
    x, axes = np.random.default_rng(2).normal(size=(7, 16)), [16, 4, 2]
    scores = ann.nearness(x, 1, axes)
    whole = (scores[0][:, :, None, None] + scores[1][:, None, :, None] + scores[2][:, None, None, :]).reshape(7, -1)
    found = ann.probed(x, 1, axes, 20)
    assert np.allclose(np.take_along_axis(whole, found, 1), -np.sort(-whole, axis=1)[:, :20])
    assert (ann.probed(x, 1, axes, 1)[:, 0] == ann.buckets(x, 1, axes)).all()


@pytest.mark.parametrize("chunk", [7, 4096])
def test_recall_and_share_as_the_table_grows(spark, chunk):
    """Recall stays over 0.9 on vectors without clusters while the share of vectors that a query meets falls."""
    shares = []
    for n in (2000, 20_000) if chunk == 4096 else (2000,):
        x = np.random.default_rng(4).normal(size=(n, 32)).astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8).cache()
        got = {}
        for r in ann.nearest(df, df.where(f"vec_id % {n // 100} = 0"), part=512, chunk=chunk).collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        hit = 0
        for q, ids in got.items():
            near = u @ u[q]
            near[q] = -2
            hit += len(set(np.argsort(-near)[:5].tolist()) & set(ids))
        assert len(got) == 100 and hit >= 450
        classes = df.selectExpr("32 AS dim", "vec_id AS class_id", "cast(embedding AS array<double>) AS v")
        tables, axes, probes, _ = ann.fit(classes)[32]
        shares.append(tables * probes / np.prod([2 * a for a in axes]))
    assert shares == sorted(shares, reverse=True)
