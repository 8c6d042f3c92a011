import math

import numpy as np
import pytest

from sessionflow.llm import whitening


def plain(vectors, components=4):
    """By numpy's full decomposition: {vec_id: ...} rows as the contract has them."""
    width = max((len(v) for _, v in vectors if v is not None), default=0)
    kept = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(256 * c) for c in v] + [0] * (width - len(v)) for _, v in kept], dtype=object).reshape(len(kept), width)
    fit = np.unique(x.astype(float), axis=0)
    n, s = len(fit), [sum(int(r[j]) for r in fit) for j in range(width)]
    values, u = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(width, width))
    order = np.argsort(values)[::-1][:components]
    w = (x.astype(float) - fit.mean(0)) @ u[:, order] / np.sqrt(values[order])
    return [(kept[r][0], k + 1, n, sum((n * int(a) - b) ** 2 for a, b in zip(x[r], s)), w[r, k], values[order[k]] / values.sum()) for r in range(len(kept)) for k in range(len(order)) if values[order[k]] > 1e-9]


def check(got, want):
    got, want = (sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1], r[3])) for rows in (got, want))
    assert [tuple(r[:4]) for r in got] == [r[:4] for r in want]
    for k in {r[1] for r in want}:
        a, b = (np.array([r[4] for r in rows if r[1] == k]) for rows in (got, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8  # either sign, the same for all rows
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert all(r[6] < 1e-9 for r in got)


def test_query_matches_full_decomposition(spark, sf):
    rows = [tuple(r) for r in whitening.op11_chebyshev_whitening(spark, sf).collect()]
    check(rows, plain([(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]))


def test_nulls_lengths_repeats_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    base = [(i, [float(c) for c in rng.normal(size=6)]) for i in range(40)]
    odd = [(100, None), (101, [1.0, None] + [0.0] * 4), (102, [math.nan] * 6), (103, [math.inf] + [0.0] * 5), (None, base[3][1]), (7, base[7][1]), (104, [0.5, -0.25]), (105, [])]
    df = spark.createDataFrame([(i, v, 0, 0.0) for i, v in base + odd], "vec_id long, embedding array<double>, x int, deviation double")
    model = whitening.fit(df)
    assert model.n == 42 and model.passes == 1  # the block spans six dimensions
    check([tuple(r) for r in whitening.transform(df, model).collect()], plain(base + odd))


def test_few_distinct_vectors_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = spark.createDataFrame(rows, schema)
        assert whitening.transform(df, whitening.fit(df)).count() == 0
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0])], schema)  # one direction only
    out = whitening.transform(df, whitening.fit(df)).collect()
    assert [(r["vec_id"], r["component"], r["n"]) for r in sorted(out)] == [(1, 1, 2), (2, 1, 2), (3, 1, 2)] and all(abs(abs(r["whitened"]) - 1) < 1e-12 and r["explained"] == pytest.approx(1) for r in out)


def test_large_entries_stay_exact(spark):
    rows = [(i, [float((-1) ** i * 10**e) for e in (3, 6, 9)]) for i in range(4)] + [(9, [1e300, 0.0, -1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["deviation"] for r in whitening.transform(df, whitening.fit(df)).collect()}
    assert got[9] is None and set(got) == {0, 1, 2, 3, 9}  # beyond a long


class Counted:
    def __init__(self, v):
        self.v, self.n = v, 0

    def __matmul__(self, q):
        self.n += 1
        return self.v @ q


@pytest.mark.parametrize("spectrum", ["close", "low rank", "equal", "far"])
def test_iteration_is_certified_without_the_matrix(spectrum):
    d, rng = 90, np.random.default_rng(3)
    values = {
        "close": np.concatenate([[3.0, 2.0, 1.001, 1.0005], 1 - np.arange(d - 4) * 1e-4]),
        "low rank": np.concatenate([[9.0, 4.0, 3.0], np.zeros(d - 3)]),
        "equal": np.full(d, 2.0),
        "far": 10.0 ** -np.linspace(0, 12, d),
    }[spectrum]
    axes = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = Counted((axes * values) @ axes.T)
    found, u = whitening.top_pairs(v, d, 4)
    assert np.allclose(found, values[:4], rtol=1e-10, atol=1e-12) and v.n < 200
    assert np.allclose(u.T @ u, np.eye(4), atol=1e-12)
    if spectrum in ("close", "far"):
        assert np.abs(np.abs(np.sum(axes[:, :4] * u, axis=0)) - 1).max() < 1e-10


def test_a_missed_direction_is_found_by_the_fresh_block(monkeypatch):
    """A start exactly orthogonal to the largest eigenvector never meets it; the fresh block brings it in."""
    d, real = 80, np.random.default_rng
    values = np.concatenate([np.linspace(10, 1, d - 1), [50.0]])

    class Blind:
        def __init__(self, seed):
            self.rng, self.draws = real(seed), 0

        def standard_normal(self, shape):
            out, self.draws = self.rng.standard_normal(shape), self.draws + 1
            out[-1] *= self.draws > 2  # the block and the column of the lower end
            return out

    monkeypatch.setattr(np.random, "default_rng", Blind)
    found, u = whitening.top_pairs(Counted(np.diag(values)), d, 4)
    assert found == pytest.approx([50, 10, values[1], values[2]]) and abs(u[-1, 0]) == pytest.approx(1)
