"""Session features against plain NumPy, and their edge cases."""

import math

import numpy as np
import pytest

from sessionflow.functions import arrays as A
from sessionflow.operators import regime as r
from pyspark.sql import functions as F


def make(n, drift, seed=None):
    if seed is None:
        base = [100 + i * drift for i in range(n)]
        o = [b + 0.03 * math.sin(i / 5) for i, b in enumerate(base)]
        c = [b + drift + 0.03 * math.cos(i / 5) for i, b in enumerate(base)]
    else:
        rng = np.random.default_rng(seed)
        walk = 100 + np.cumsum(rng.normal(drift, 0.3, n + 1))
        o, c = walk[:-1].tolist(), walk[1:].tolist()
    h, l = [max(a, b) + 0.15 for a, b in zip(o, c)], [min(a, b) - 0.15 for a, b in zip(o, c)]
    return np.array([o, h, l, c])


SESSIONS = {"up": make(60, 0.05), "flat": make(60, 0.0), "walk": make(80, 0.0, 1), "fall": make(45, -0.1, 2), "short": make(6, 0.1), "one": make(1, 0.0)}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, i, *map(float, x[:, i]), 100.0 + i) for k, x in SESSIONS.items() for i in range(x.shape[1])]
    df = spark.createDataFrame(rows, "k string, at int, Open double, High double, Low double, Close double, Volume double").repartition(5)
    return r.sessions(df, ["k"], "at").cache()


def by(df):
    return {x["k"]: x for x in df.collect()}


def close(a, b):
    return (a is None and (b is None or np.isnan(b))) or a == pytest.approx(b, abs=1e-9)


def wilder(x, n, average=False):
    out = np.full(len(x), np.nan)
    ok = np.flatnonzero(~np.isnan(x))
    first = ok[0] if len(ok) else len(x)
    if first + n <= len(x):
        seed = x[first : first + n]
        out[first + n - 1] = np.nanmean(seed) if average else np.nansum(seed)
        for i in range(first + n, len(x)):
            out[i] = out[i - 1] * (1 - 1 / n) + x[i] / n if average else out[i - 1] - out[i - 1] / n + x[i]
    return out


def directional(x, n):
    o, h, l, c = x
    tr = h - l
    tr[1:] = np.maximum(tr[1:], np.maximum(abs(h[1:] - c[:-1]), abs(l[1:] - c[:-1])))
    up, down = np.diff(h), -np.diff(l)
    plus, minus = np.concatenate([[0], np.where((up > down) & (up > 0), up, 0)]), np.concatenate([[0], np.where((down > up) & (down > 0), down, 0)])
    a = wilder(tr, n)
    p, m = 100 * wilder(plus, n) / a, 100 * wilder(minus, n) / a
    with np.errstate(all="ignore"):
        dx = 100 * abs(p - m) / (p + m)
    return p, m, dx, wilder(dx, n, True)


def test_directional_indicators(table):
    got = by(r.with_directional(table, 7))
    for k, x in SESSIONS.items():
        for name, want in zip(("plus_di", "minus_di", "dx", "adx"), directional(x.copy(), 7)):
            assert len(got[k][name]) == x.shape[1] and all(close(a, b) for a, b in zip(got[k][name], want)), (k, name)


def test_missing_value_is_sticky(spark):
    df = spark.createDataFrame([([None, 1.0, 2.0, 3.0, None, 5.0],)], "x array<double>")
    assert df.select(A.smooth(F.col("x"), 2, "mean")).first()[0] == [None, None, 1.5, 2.25, None, None]
    assert df.select(A.smooth(F.col("x"), 2, "ema")).first()[0][2] == 3.0
    assert df.select(A.smooth(F.col("x"), 9, "sum")).first()[0] == [None] * 6


def persistence(p, m, alpha=0.35):
    signs, n = np.zeros(len(p)), len(p)
    for i in range(n):
        signs[i] = np.sign(p[i] - m[i]) or (signs[i - 1] if i else 1)
    margin = np.clip(abs(p - m) / (p + m + 1e-12), 0, 1)
    if n < 2:
        return 0, 0, 0, 0
    edges = [0, *(np.flatnonzero(np.diff(signs)) + 1), n]
    runs = [(a, b) for a, b in zip(edges, edges[1:])]
    e = signs[0] * margin[0]
    for x in (signs * margin)[1:]:
        e = alpha * x + (1 - alpha) * e
    return np.mean([b - a for a, b in runs]) / n, sum(((b - a) / n) ** 2 * margin[a:b].mean() for a, b in runs), abs((signs * margin).mean()), abs(e)


@pytest.mark.parametrize("p, m", [([3, 3, 1, 1, 2, 2, 5], [1, 2, 1, 4, 4, 2, 2]), ([1, 1, 1], [1, 1, 1]), ([1], [2]), ([1, 5, 1, 5], [5, 1, 5, 1])])
def test_persistence_and_crossovers(spark, p, m):
    df = spark.createDataFrame([(list(map(float, p)), list(map(float, m)))], "plus_di array<double>, minus_di array<double>")
    x = r.with_crossovers(r.with_persistence(df)).first()
    want = persistence(np.array(p, float), np.array(m, float))
    for c, w in zip(("persistence_avg", "persistence_margin_weighted", "persistence_time_in_control", "persistence_recency_weighted"), want):
        assert x[c] == pytest.approx(w), c
    d = np.array(p) - np.array(m)
    crossed = int(((d[1:] * d[:-1]) < 0).sum())
    assert x["crossovers"] == crossed and x["crossover_score"] == pytest.approx(max(0, min(1, 1 - crossed / (len(p) / 2))))


def test_quality_gate(table):
    got = by(r.trend_quality(table, 7, False, (0.5, 0.3, 0.2), 20))
    assert got["short"]["trend_quality"] is None and got["short"]["quality_error"] == "Insufficient data"
    assert got["up"]["trend_quality"] > 0.9 > got["walk"]["trend_quality"] and got["up"]["dominant_di"] == "plus" and got["fall"]["dominant_di"] == "minus"
    p, m, _, adx = directional(SESSIONS["walk"].copy(), 7)
    ok = ~np.isnan(adx)
    assert got["walk"]["strength_raw"] == pytest.approx(adx[-1]) and got["walk"]["valid_bars"] == ok.sum()
    want = 0.5 * adx[-1] / 100 + 0.3 * persistence(p[ok], m[ok])[1] + 0.2 * got["walk"]["crossover_score"]
    assert got["walk"]["trend_quality"] == pytest.approx(want)


def hurst_simple(x):
    n = len(x)
    pairs = [(k, np.var(x[k:] - x[:-k], ddof=1)) for k in range(2, min(n // 4, 20) + 1)] if n >= 20 and min(n // 4, 20) >= 3 else []
    return np.clip(np.polyfit(np.log([k for k, _ in pairs]), np.log([v for _, v in pairs]), 1)[0] / 2, 0, 1) if len(pairs) >= 3 else None


def hurst_rs(x):
    n = len(x)
    w, sizes = max(10, n // 10), []
    if n < 30 or n // 2 < 2 * w:
        return None
    while w <= n // 2 and len(sizes) < 5:
        sizes.append(w)
        w = int(w * 1.5)
    values = []
    for w in sizes:
        parts = [x[i * w : (i + 1) * w] for i in range(n // w)]
        z = [np.cumsum(c - c.mean()) for c in parts]
        values.append(np.mean([(a.max() - a.min()) / c.std(ddof=1) for a, c in zip(z, parts)]))
    return np.clip(np.polyfit(np.log(sizes), np.log(values), 1)[0], 0, 1) if len(sizes) > 1 else None


def test_memory_features(table):
    got = by(r.with_hurst(r.with_autocorrelation(r.with_variance_ratio(table, 4))))
    for k, x in SESSIONS.items():
        ret = np.diff(np.log(x[3]))
        assert close(got[k]["hurst_simple"], hurst_simple(ret)), k
        assert close(got[k]["hurst_rs"], hurst_rs(ret)), k
        if len(ret) > 10:
            d = ret - ret.mean()
            assert close(got[k]["acf_2"], (d[2:] @ d[:-2]) / (d @ d))
        else:
            assert got[k]["acf_1"] is None
        if len(ret) > 4 and ret.var(ddof=1) > 1e-8:
            many = np.convolve(ret, np.ones(4), "valid")
            assert close(got[k]["variance_ratio"], many.var(ddof=1) / (4 * ret.var(ddof=1)))
    assert got["one"]["variance_ratio"] is None


def slope(p, a, b):
    if b <= a or b >= len(p):
        return 0.0
    w = p[a : b + 1]
    raw = (w[-1] / w[0] - 1) / (b - a)
    ret = np.diff(np.log(w))
    return raw if len(ret) < 2 else raw / max(np.std(ret, ddof=1), 1e-10)


def slope_score(x, k=4, look=3):
    o, h, l, c = x
    n = len(c)
    if n < 2 * k:
        return None
    main, size = slope(c, 0, n - 1), n // k
    subs = np.array([slope(c, i * size, n - 1 if i == k - 1 else (i + 1) * size - 1) for i in range(k)])
    tr = h - l
    tr[1:] = np.maximum(tr[1:], np.maximum(abs(h[1:] - c[:-1]), abs(l[1:] - c[:-1])))
    atr = tr[-14:].mean()

    def best(a, b):
        found = []
        for i in range(look, n - look):
            if all(a[i] > a[j] for j in range(i - look, i + look + 1) if j != i):
                rise = a[i] - max(b[i - look : i].min(), b[i + 1 : i + look + 1].min())
                if rise >= 0.5 * atr:
                    found.append((rise, -i))
        return -max(found)[1] if found else None

    hi, lo = best(h, l), best(-l, -h)
    fit = lambda s: 0.5 * (1 + np.tanh(s * (1 if main > 0 else -1)))
    first, last = (hi, lo) if main > 0 else (lo, hi)
    if hi is None and lo is None:
        co = 0.5
    elif hi is not None and lo is not None:
        co = (fit(slope(c, 0, min(hi, lo))) + fit(slope(c, max(hi, lo), n - 1))) / 2
    elif first is not None:
        co = fit(slope(c, 0, first)) * 0.75 + 0.125
    else:
        co = fit(slope(c, last, n - 1)) * 0.75 + 0.125
    dc = np.mean(abs(subs) < 1e-6) if abs(main) < 1e-6 else np.mean(np.sign(subs) == np.sign(main))
    sd = subs.std(ddof=1)
    al = np.exp(-sd / (abs(main) * 2)) if abs(main) > 1e-6 else 1 / (1 + sd / abs(subs).mean())
    return round(0.35 * dc + 0.2 * max(0.1, al) + 0.2 * max(0.2, co) + 0.25 * np.tanh(abs(main) * 5), 4)


def test_slope_score(table):
    got = by(r.with_slope_score(table))
    for k, x in SESSIONS.items():
        want = slope_score(x.copy())
        assert (got[k]["slope_score"] is None) == (want is None) and (want is None or got[k]["slope_score"] == pytest.approx(want, abs=1.1e-4)), k
    assert got["up"]["slope_interpretation"] == "STRONG_TREND"


def test_windows_and_last_window(table):
    w = r.windows(table, ["k"], 20, 15).where("k = 'up'").orderBy("window_start").collect()
    assert [x["window_start"] for x in w] == [0, 15, 30] and all(len(x["c"]) == 20 for x in w)
    last = by(r.with_irr(r.last_window(table, 10)))
    assert last["up"]["enough"] and not last["short"]["enough"] and last["up"]["c"] == pytest.approx(SESSIONS["up"][3][-10:].tolist())
    o, h, l, c = SESSIONS["up"][:, -10:]
    assert last["up"]["full_irr"] == pytest.approx(1 - abs(c[-1] - o[0]) / (h.max() - l.min())) and last["one"]["irr_interpretation"] == "INSUFFICIENT_DATA"


def test_targets_blocks_and_expansion(table):
    got = by(r.with_expansion(r.with_targets(table), 15))
    for k, (o, h, l, c) in SESSIONS.items():
        span = h.max() - l.min()
        blocks = [(h[i].max() - l[i].min()) / (span + 1e-12) for i in np.array_split(np.arange(len(c)), min(4, len(c)))]
        assert got[k]["chop_instability"] == pytest.approx(min(1, np.std(blocks)))
        side = np.sign(c - (h.max() + l.min()) / 2)
        side = side[side != 0]
        assert got[k]["containment_mid_cross_count"] == pytest.approx((side[1:] != side[:-1]).sum() / max(len(side) - 1, 1))
        v = 100 + np.arange(len(c))
        vw = np.cumsum((h + l + c) / 3 * v) / (np.cumsum(v) + 1e-12)
        assert got[k]["containment_vwap_acceptance"] == pytest.approx(1 - min(1, (abs(c - vw) / (span + 1e-12)).mean()))
        top, low = h[:15].max(), l[:15].min()
        assert got[k]["containment_ib_extension_ratio"] == pytest.approx((max(0, h.max() - top) + max(0, low - l.min())) / (top - low + 1e-12))
        n = min(10, len(c))
        w = [4 * c[i : i + n].std() / (abs(c[i : i + n].mean()) + 1e-12) for i in range(len(c) - n + 1)]
        assert got[k]["containment_bandwidth_squeeze"] == pytest.approx(1 / (1 + np.mean(w)))


def test_state_gate_and_labels(spark):
    cols = {"trend_quality": 0.9, "atr_ratio": 0.1, "dra_inside": 0.1, "directional_strength": 0.9, "hurst_rs": 0.8, "hurst_simple": None, "slope_score": 0.9, "swing_class": "trending", "n": 3, "c": [100.0, 101.0, 102.0]}
    schema = ", ".join(f"{k} {'string' if k == 'swing_class' else 'int' if k == 'n' else 'array<double>' if k == 'c' else 'double'}" for k in cols)
    rows = [tuple(cols.values()), tuple({**cols, "slope_score": None, "trend_quality": None}.values()), tuple({**cols, **{k: 0.5 for k in ("trend_quality", "slope_score", "hurst_rs", "directional_strength")}, "atr_ratio": 0.5, "dra_inside": 0.5, "swing_class": "mixed", "c": [100.0, 100.0, 99.0]}.values()), tuple({**cols, **dict.fromkeys(("trend_quality", "atr_ratio", "dra_inside", "directional_strength", "hurst_rs", "slope_score", "swing_class"))}.values())]
    got = r.with_state(spark.createDataFrame(rows, schema)).collect()
    assert [x["state"] for x in got] == ["STRONG_TREND", "STRONG_TREND", "UNCERTAIN", "UNCERTAIN"] and [x["trend_direction"] for x in got] == ["UP", "UP", "DOWN", "UP"]
    df = spark.createDataFrame([(0.8, 0.2, 0.2), (0.2, 0.8, 0.5), (0.2, 0.2, 0.8), (0.5, 0.5, 0.5), (0.2, 0.7, 0.7)], "descriptive_target double, containment_target double, chop_score double")
    assert [x["label"] for x in r.with_labels(df).collect()] == ["trend", "containment", "chop", "uncertain", "uncertain"]
    assert r.with_labels(df, drop_uncertain=True).count() == 3


def test_modeling_table_reports_what_is_missing(spark):
    rows = [(k, i, *map(float, x[:, i]), 100.0) for k, x in SESSIONS.items() for i in range(x.shape[1])]
    df = spark.createDataFrame(rows, "k string, at int, Open double, High double, Low double, Close double, Volume double")
    got = by(r.modeling_table(df, ["k"], "at", quality=(1, 7, False, (0.5, 0.3, 0.2), 20), reference=5))
    assert got["up"]["feature_status"] == "ok" and got["short"]["feature_status"].startswith("missing:") and len(got) == len(SESSIONS)
