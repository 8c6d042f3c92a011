"""Registered queries that SQL doesn't state, against plain Python on the same tables."""

import math
import os

import numpy as np
import pandas as pd
import pytest

from sessionflow.operators import forecast as f
from sessionflow.queries import forecast, patterns, regime

from . import test_models as models
from . import test_regime as plain

#: What this file checks; ``test_oracle`` asks that every query has SQL or stands here (permutation_test: ``test_whole_queries``).
CHECKED = {
    "regression_bakeoff", "classification_bakeoff",
    "boosted_quantile_forecast", "three_way_probe", "registry_ridge_sweep", "registry_elastic_sweep", "permutation_test",
    "registry_representation_sweep", "registry_post_adx_ablation", "registry_persistence_rewrites", "registry_containment_v2",
}


@pytest.fixture(scope="module")
def days(spark):
    rows = regime.days(spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")).collect()
    return {r["date"]: np.array([r["o"], r["h"], r["l"], r["c"]]) for r in rows}


def near(a, b, places=2e-6):
    return (a is None and (b is None or np.isnan(b))) or a == pytest.approx(b, abs=places)


def quality(x):
    """(score, last strength, valid bars) with the queries' settings."""
    p, m, _, adx = plain.directional(x.copy(), 4)
    ok = ~(np.isnan(adx) | np.isnan(p) | np.isnan(m))
    if x.shape[1] < 8 or not ok.any():
        return None, None, int(ok.sum())
    d = (p - m)[ok]
    crossed = 1 - (d[1:] * d[:-1] < 0).sum() / (len(d) / 2)
    return 0.5 * adx[ok][-1] / 100 + 0.3 * plain.persistence(p[ok], m[ok])[1] + 0.2 * max(0, min(1, crossed)), adx[ok][-1], int(ok.sum())


def test_trend_quality(spark, sf, days):
    for r in regime.quality(spark, sf).collect():
        score, strength, valid = quality(days[r["date"]])
        assert near(r["trend_quality"], score) and near(r["strength_raw"], strength) and r["valid_bars"] == valid


def test_slope_windows(spark, sf, days):
    rows = regime.slope_windows(spark, sf).collect()
    assert len(rows) == sum(len(range(0, x.shape[1] - 11, 6)) for x in days.values())
    for r in rows:
        x = days[r["date"]][:, r["window_start"] : r["window_start"] + 12]
        assert near(r["slope_score"], plain.slope_score(x.copy()), 1.1e-4) and near(r["main_slope"], plain.slope(x[3], 0, 11))


def test_last_windows(spark, sf, days):
    for r in regime.last_windows(spark, sf).collect():
        o, h, l, c = x = days[r["date"]][:, -10:]
        assert r["enough"] == (days[r["date"]].shape[1] >= 10) and near(r["slope_score"], plain.slope_score(x.copy()), 1.1e-4)
        span = h.max() - l.min()
        assert near(r["full_irr"], 1 - abs(c[-1] - o[0]) / span if x.shape[1] >= 5 and span >= 1e-4 else None)


def test_memory(spark, sf, days):
    for r in regime.memory(spark, sf).collect():
        ret = np.diff(np.log(days[r["date"]][3]))
        rs, simple = plain.hurst_rs(ret), plain.hurst_simple(ret)
        assert near(r["day_hurst"], simple if rs is None else rs)
        d = ret - ret.mean() if len(ret) else ret
        for k in (1, 2, 5):
            assert near(r[f"day_acf_{k}"], (d[k:] @ d[:-k]) / (d @ d) if len(ret) >= 10 and len(ret) - k >= 5 and d @ d else None)


def test_modeling_table(spark, sf, days):
    """Features of other modules by plain Python, the ensemble from the row's own signals."""
    from sessionflow.operators.regime import LEANING, WEIGHTS

    rows = regime.table(spark, sf).collect()
    assert {r["date"] for r in rows} == set(days) and len(rows) == len(days)
    for r in rows:
        x = days[r["date"]]
        assert near(r["trend_quality"], quality(x)[0]) and near(r["slope_score"], plain.slope_score(x.copy()), 1.1e-4) and r["n"] == x.shape[1]
        clip = lambda v: None if v is None else max(0.0, min(1.0, v))
        lag = r["hurst_rs"] if r["hurst_rs"] is not None else r["hurst_simple"]
        found = {"adx": r["trend_quality"], "atr_range": None if r["atr_ratio"] is None else clip(1 - r["atr_ratio"]), "dra": clip(1 - r["dra_inside"]), "irr": clip(r["directional_strength"]), "lag": lag, "mss": r["slope_score"], "spd": {"trending": 1.0, "mixed": 0.5, "chop": 0.0}.get(r["swing_class"])}
        tilt = 0.5 * math.tanh(4 * ((0.5 if lag is None else lag) - 0.5))
        w = {k: v * max(0.5, min(1.5, 1 + LEANING[k] * tilt)) for k, v in WEIGHTS.items() if found[k] is not None}
        s = sum(found[k] * w[k] for k in w) / sum(w.values())
        assert near(r["composite_signal"], s, 1e-5) and near(r["confidence"], abs(s - 0.5) * 2, 1e-5)
        state = "UNCERTAIN" if r["confidence"] < 0.3 else "STRONG_TREND" if s >= 0.7 else "WEAK_TREND" if s >= 0.55 else "CHOPPY" if s <= 0.3 else "CONSOLIDATION" if s <= 0.45 else "WEAK_TREND"
        assert r["state"] == state
        t, k, ch = r["descriptive_target"], r["containment_target"], r["chop_score"]
        label = "chop" if ch >= 0.6 and t <= 0.45 and k <= 0.45 else "containment" if k >= 0.6 and t <= 0.45 and ch <= 0.55 else "trend" if t >= 0.6 and k <= 0.45 and ch <= 0.45 else "uncertain"
        assert r["label"] == label


def test_liquidity(spark, sf):
    sessions = {r["date"]: [np.array(r[c]) for c in ("h", "l", "c")] for r in patterns.days(spark, sf).collect()}
    got = {}
    rows = patterns.patterns(spark, sf).collect()
    for x in rows:
        got.setdefault(x["date"], set()).add((x["type"], x["strength"], x["is_buyside"], x["start_index"], x["end_index"], x["n_points"]))
    for d, (h, l, c) in sessions.items():
        assert got.get(d, set()) == models.brute_patterns(h, l, c, 2, 0.2, 3, 7, 0.3, 0.9), d
    kept = {tuple(x)[:6] for x in patterns.strong(spark, sf).select("date", "type", "strength", "is_buyside", "start_index", "end_index").collect()}
    assert kept == {(x["date"], x["type"], x["strength"], x["is_buyside"], x["start_index"], x["end_index"]) for x in rows if x["type"] == "TRENDLINE" or (x["type"], x["strength"]) == ("EQUAL_HIGHS", "SWING_TICK_EQUAL")}


def split(p, day, fraction):
    p = p.sort_values(day)
    held = set(sorted(p[day].unique())[-max(1, math.ceil(p[day].nunique() * fraction)) :])
    return p[~p[day].isin(held)], p[p[day].isin(held)]


def test_registries(spark, sf):
    """The holdout of every spec by a fit on the rows themselves."""
    table = forecast.table(spark, sf).toPandas()
    core = list(f.feature_sets()["core5"])
    for run, session, fit in ((forecast.alpha_sweep, "even", lambda x, y, r: models.ridge(x, y, r["alpha"])), (forecast.elastic_sweep, "odd", lambda x, y, r: models.elastic(x, y, r["alpha"], r["l1_ratio"]))):
        rows = run(spark, sf).collect()
        assert len(rows) == 12 and {r["status"] for r in rows} == {"ok"}
        for r in rows[::3]:
            p = table[table["session_name"] == session].dropna(subset=[*core, "goal"])
            if r["era_name"] == "post_covid":
                p = p[p["trade_date"] >= np.datetime64("1998-01-01").astype(object)]
            dev, held = split(p, "trade_date", 0.15)
            mean, scale, w, b = fit(dev[core].to_numpy(float), dev["goal"].to_numpy(float), r)
            mae = np.abs(held["goal"] - (b + ((held[core].to_numpy(float) - mean) / scale) @ w)).mean()
            assert r["holdout_mae"] == pytest.approx(mae, abs=2e-6) and r["n_rows"] == len(p)


def folds_by_hand(days):
    """(train, valid) day sets of a walk-forward run of 24 and 3 months in steps of 3."""
    days = pd.Series(sorted(pd.to_datetime(days).unique()))
    start, k = days.min(), 0
    while (begin := start + pd.DateOffset(months=24 + 3 * k)) <= days.max():
        train, valid = days[(days >= begin - pd.DateOffset(months=24)) & (days < begin)], days[(days >= begin) & (days < begin + pd.DateOffset(months=3))]
        if len(train) and len(valid):
            yield set(train), set(valid)
        k += 1


@pytest.mark.parametrize("group, n", [("representation_sweep", 9), ("post_adx_ablation", 6), ("persistence_rewrites", 4), ("containment_v2", 2)])
def test_feature_registries(spark, sf, group, n):
    """Out-of-sample and holdout errors of every spec by fits on the rows themselves."""
    p = forecast.table(spark, sf).where("session_name = 'even'").toPandas()
    p["trade_date"] = pd.to_datetime(p["trade_date"])
    rows = {r["experiment_id"]: r for r in forecast.feature_sweep(group)(spark, sf).collect()}
    specs = f.registry(group, "even")
    assert len(rows) == len(specs) == n and {r["status"] for r in rows.values()} == {"ok"}
    for x in specs:
        names, (first, last) = list(x["features"]), forecast.HALVES[x["era_name"]]
        q = p[(p["trade_date"] >= (first or "1900-01-01")) & (p["trade_date"] <= (last or "2100-01-01"))].dropna(subset=[*names, "goal"])
        dev, held = split(q, "trade_date", 0.15)

        def errors(train, test, names=names, x=x):
            mean, scale, w, b = models.ridge(train[names].to_numpy(float), train["goal"].to_numpy(float), x["alpha"])
            return np.abs(test["goal"] - (b + ((test[names].to_numpy(float) - mean) / scale) @ w))

        r = rows[x["experiment_id"]]
        oos = [errors(dev[dev["trade_date"].isin(a)], dev[dev["trade_date"].isin(b)]) for a, b in folds_by_hand(dev["trade_date"])]
        assert oos and r["n_rows"] == len(q) and r["n_dates"] == q["trade_date"].nunique()
        assert r["out_of_sample_mae"] == pytest.approx(np.concatenate(oos).mean(), abs=2e-6)
        assert r["holdout_mae"] == pytest.approx(errors(dev, held).mean(), abs=2e-6)


def test_bakeoffs(spark, sf):
    h = forecast.history(spark, sf).toPandas()
    features = [*forecast.FEATURES, "y_std_20"]
    dev, held = split(h.dropna(subset=[*features, "y"]), "trade_date", 0.2)
    rows = {r["model_name"]: r for r in forecast.bakeoff(spark, sf).collect()}
    assert set(rows) == {"ridge", "boosted_trees", "random_forest", "wide_forest"} and {r["holdout_n_rows"] for r in rows.values()} == {len(held)}
    mean, scale, w, b = models.ridge(dev[features].to_numpy(float), dev["y"].to_numpy(float), 1.0)
    want = np.abs(held["y"] - (b + ((held[features].to_numpy(float) - mean) / scale) @ w)).mean()
    assert rows["ridge"]["holdout_mae"] == pytest.approx(want, rel=1e-3)
    naive = np.abs(held["y"] - dev["y"].mean()).mean()
    assert all(r["holdout_mae"] < 1.2 * naive and r["oos_mae"] < 1.2 * naive for r in rows.values())
    walk = {r["sample"]: r for r in f.walkforward_experiment(forecast.history(spark, sf), features, "y", fraction=0.2)["metrics"].collect()}["out_of_sample"]
    assert {(r["oos_n_rows"], r["oos_n_dates"]) for r in rows.values()} == {(walk["n_rows"], walk["n_dates"])} and rows["ridge"]["oos_mae"] == pytest.approx(walk["mae"], rel=1e-6)
    cut = np.quantile(dev["y"], 0.75)
    for r in forecast.classifiers(spark, sf).collect():
        assert r["n_rows"] == len(held) and r["n_positive"] == (held["y"] >= cut).sum() and 0 <= r["roc_auc"] <= 1


def test_boosted_query(spark, sf):
    got, h = forecast.boosted(spark, sf).toPandas(), forecast.history(spark, sf).toPandas()
    for name, p in (("full_history", h), ("post_covid", h[h["trade_date"] >= np.datetime64("1998-01-01").astype(object)])):
        _, held = split(p.dropna(subset=[*forecast.FEATURES, "y"]), "trade_date", 0.15)
        own = got[got["experiment"] == name]
        assert len(own) == 3 * len(held) and set(own["trade_date"]) == set(held["trade_date"])
        share = {q: (g["target"] <= g["prediction"]).mean() for q, g in own.groupby("quantile")}
        assert share[0.25] < share[0.5] < share[0.75] and all(abs(v - q) < 0.15 for q, v in share.items())


def test_probe_query(spark, sf):
    table, core = forecast.table(spark, sf).toPandas(), list(f.feature_sets()["core5"])
    rows = forecast.probe(spark, sf).collect()
    for session in ("even", "odd"):
        _, held = split(table[table["session_name"] == session].dropna(subset=core), "trade_date", 0.15)
        for model in ("multinomial_logit", "boosted_trees", "random_forest"):
            own = [r for r in rows if r["session"] == session and r["model_name"] == model]
            assert {r["class"]: r["support"] for r in own} == held["label"].value_counts().to_dict()
            f1 = {r["class"]: 2 * r["precision"] * r["recall"] / (r["precision"] + r["recall"]) if r["precision"] + r["recall"] else 0 for r in own}
            total = sum(r["support"] for r in own)
            assert all(near(r["f1"], f1[r["class"]], 1e-5) and near(r["macro_f1"], np.mean(list(f1.values())), 1e-5) and near(r["weighted_f1"], sum(f1[x["class"]] * x["support"] for x in own) / total, 1e-5) for r in own)


def test_no_query_is_left_out():
    from sessionflow import queries

    assert set(queries.queries()) - set(queries.oracle_sql()) == CHECKED
