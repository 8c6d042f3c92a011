"""Forecasting, patterns and streams."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionflow.operators import calendar, cohort, forecast as f, trees
from sessionflow.operators import liquidity as lq
from sessionflow.sources.ticks import minute_bars, normalize
from sessionflow.streaming import ticks as stream

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def daily(spark):
    rng = np.random.default_rng(0)
    y = 1 + 0.1 * np.sin(np.arange(900) / 20) + 0.05 * rng.normal(size=900)
    return f.history_features(spark.createDataFrame([(DAY + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)], "trade_date date, y double"), "y").cache()


FEATURES = ["y_lag_1", "y_mean_5", "y_mean_20"]


def ridge(x, y, alpha):
    mean, scale = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / scale
    return mean, scale, np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())), y.mean()


def test_history_uses_only_the_past(daily):
    p = daily.orderBy("trade_date").toPandas()
    assert p["y_lag_1"][1] == p["y"][0] and p["y_mean_20"].isna().sum() == 20
    assert p["y_mean_5"][30] == pytest.approx(p["y"][25:30].mean()) and p["y_q50_20"][40] == sorted(p["y"][20:40])[10]


def test_ridge_from_gram_sums(daily):
    p = daily.dropna().toPandas()
    (fit,) = f.ridge(f.gram(daily, [], FEATURES, "y").withColumn("g", F.lit(1)), ["g"], 2.0).collect()
    mean, scale, coef, b = ridge(p[FEATURES].to_numpy(), p["y"].to_numpy(), 2.0)
    assert fit["coef"] == pytest.approx(coef, rel=1e-6) and fit["mean"] == pytest.approx(mean) and fit["scale"] == pytest.approx(scale, rel=1e-6) and fit["intercept"] == pytest.approx(b)


def test_har_refits_each_day(daily):
    got = f.har_forecast(daily, "y", fraction=0.02, years=1).orderBy("trade_date").toPandas()
    p = daily.orderBy("trade_date").toPandas()
    assert len(got) == math.ceil(900 * 0.02)
    for _, g in got.iterrows():
        d = g["trade_date"]
        start = d.replace(year=d.year - 1)
        t = p[(p["trade_date"] < d) & (p["trade_date"] >= start)].dropna()
        mean, scale, coef, b = ridge(t[FEATURES].to_numpy(), t["y"].to_numpy(), 1.0)
        row = p[p["trade_date"] == d][FEATURES].to_numpy()[0]
        assert g["prediction"] == pytest.approx(b + ((row - mean) / scale) @ coef, rel=1e-6)


def test_walkforward_never_trains_on_what_it_predicts(daily):
    folds = f.walkforward_folds(daily, "trade_date", 12, 3, 3).collect()
    assert all(x["train_start"] < x["validation_start"] < x["validation_end"] for x in folds) and [x["fold_id"] for x in folds] == list(range(1, len(folds) + 1))
    run = f.walkforward_experiment(daily, FEATURES, "y", train_months=12)
    pred = run["predictions"].toPandas()
    held = set(pred[pred["fold_id"] == 0]["trade_date"])
    assert len(held) == math.ceil(880 * 0.15) and not held & set(pred[pred["fold_id"] > 0]["trade_date"])
    m = {x["sample"]: x for x in run["metrics"].collect()}
    h = pred[pred["fold_id"] == 0]
    assert m["holdout"]["mae"] == pytest.approx((h["target"] - h["prediction"]).abs().mean())
    assert m["holdout"]["r2"] == pytest.approx(1 - ((h["target"] - h["prediction"]) ** 2).sum() / ((h["target"] - h["target"].mean()) ** 2).sum())
    assert m["holdout"]["spearman"] == pytest.approx(h["target"].rank().corr(h["prediction"].rank()))
    s = run["stability"].collect()
    assert {x["feature"] for x in s} == set(FEATURES) and all(0 <= x["sign_consistency"] <= 1 for x in s)


def test_registries_and_columns(daily):
    assert len(f.feature_sets()) == 13 and all(x["features"] for g in ("representation_sweep", "ridge_alpha_sweep", "post_adx_ablation", "persistence_rewrites", "containment_v2") for x in f.registry(g, "s"))
    assert [x["experiment_id"] for x in f.registry("representation_sweep", "s")][::4] == ["EXP03_full_core5", "EXP07_post_core5_dra", "EXP11_pre_adx_parts"]
    assert len(f.registry("ridge_alpha_sweep", "s")) == 12
    with pytest.raises(ValueError):
        f.registry("x", "s")
    assert f.feature_columns(daily.withColumn("macro_open", F.lit(1.0)), "y") == [c for c in daily.columns if c not in ("trade_date", "y")]
    assert f.usable_columns(daily.withColumn("none", F.lit(None).cast("double")), ["y", "none"]) == ["y"]


def test_classification_metrics(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 200), rng.random(200).round(1)
    (m,) = f.classification_metrics(spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(y, s)], "model string, label double, score double"), ["model"]).collect()
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap, before = 0.0, 0
    for t in sorted(set(s), reverse=True):
        tp, k = (y[s >= t] == 1).sum(), (s >= t).sum()
        ap, before = ap + (tp - before) / len(pos) * tp / k, tp
    assert m["roc_auc"] == pytest.approx(auc) and m["pr_auc"] == pytest.approx(ap)
    hit = s >= 0.5
    tp, fp, fn, tn = (hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum(), (~hit & (y == 0)).sum()
    assert m["mcc"] == pytest.approx((tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))) and m["precision"] == pytest.approx(tp / (tp + fp))


def test_permutation_and_effect(spark):
    rows = [("a", 1.0 + i / 50) for i in range(20)] + [("b", i / 50) for i in range(25)]
    df = spark.createDataFrame(rows, "cohort string, x double")
    p = calendar.permutation_test(df, "x", "a", "b", 199).first()
    assert p["p_value"] == pytest.approx(1 / 200) and p == calendar.permutation_test(df.repartition(5), "x", "a", "b", 199).first()
    same = calendar.permutation_test(df.withColumn("x", F.lit(1.0)), "x", "a", "b", 49).first()
    assert same["p_value"] == 1.0
    x, y = (np.array([v for c, v in rows if c == k]) for k in "ab")
    want = (x.mean() - y.mean()) / math.sqrt((19 * x.var(ddof=1) + 24 * y.var(ddof=1)) / 43)
    assert calendar.cohens_d(df, "x", "a", "b").first()["cohens_d"] == pytest.approx(want)


def test_news_beside_days(spark):
    news = spark.createDataFrame([(1, dt.datetime(2025, 1, 2, 13, 30), "CPI"), (2, dt.datetime(2025, 1, 3, 13, 30), "NFP"), (3, dt.datetime(2025, 1, 3, 15, 0), "GDP")], "id long, dt_utc timestamp, event_type string").withColumn("title", F.col("event_type")).withColumn("impact", F.lit("high"))
    news = news.withColumn("dt_et", F.from_utc_timestamp("dt_utc", "America/New_York")).withColumn("date_et", F.to_date("dt_et"))
    days = spark.createDataFrame([(dt.date(2025, 1, 2),), (dt.date(2025, 1, 6),)], "date date")
    got = {str(x["date"]): x for x in calendar.merge_news(days, news).collect()}
    a, b = got["2025-01-02"], got["2025-01-06"]
    assert (a["num_total"], a["has_CPI_today"], a["has_NFP_next_premarket"], a["has_GDP_total"], a["types_next_premarket"]) == (2, True, True, False, ["NFP"])
    assert (b["num_total"], b["events_today"], b["has_event_total"]) == (0, [], False)
    assert {x["num_next_premarket"] for x in calendar.merge_news(days, news, nextday=False).collect()} == {0}
    link = calendar.event_links(days, news).where("relation = 'today'").first()
    assert link["minutes_from_close"] == pytest.approx(-440)


def test_normality_names_its_test(spark):
    rng = np.random.default_rng(2)
    rows = [(0, float(x)) for x in rng.normal(size=200)] + [(1, float(x)) for x in rng.exponential(size=200)] + [(2, 1.0), (2, 2.0), (3, 5.0), (3, 5.0), (3, 5.0)]
    t = cohort.jarque_bera(spark.createDataFrame(rows, "i int, x double"), ["i"], "x")
    got = {x["i"]: x for x in t.collect()}
    assert got[0]["normal"] and got[1]["normal"] is False and got[2]["normal"] is None and got[3]["normal"] is None and got[0]["test"] == "jarque_bera"
    assert cohort.normality_rollup(t.withColumn("g", F.lit(1)), ["g"]).first()["classification"] == "mixed"


def trendline(points, a, c, up, tol=0.01, var=0.3, dev=3.0):
    s = 1 if up else -1
    (i0, p0), (i1, p1) = points[0], points[-1]
    k = (p1 - p0) / (i1 - i0)
    line = lambda i: p0 + k * (i - i0)
    off = [abs(a[i] - line(i)) for i in range(i0, i1 + 1)]
    steps = [(q[1] - p[1]) / (q[0] - p[0]) for p, q in zip(points, points[1:])]
    return (
        k * s < 0 and all(p * s <= p0 * s for _, p in points) and (len(points) == 2 or all(abs((x - k) / k) <= var for x in steps)) and all(o <= np.mean(off) + dev * np.std(off) for o in off)
        and not any((c[i] - line(i) * (1 + s * tol)) * s > 0 for i in range(i0, i1 + 1)) and all(abs(p - line(i)) / line(i) <= tol for i, p in points)
    )


def brute_patterns(h, l, c, lookback, spacing, least, most, tolerance, variance):
    """All patterns of a session, by loops: (type, strength, is_buyside, start, end, points)."""
    want = set()
    for up in (True, False):
        a, s = (h, 1) if up else (l, -1)
        b, n, kind = a * s, len(a), "EQUAL_HIGHS" if up else "EQUAL_LOWS"
        swings, ticks = [], set()
        for i in range(lookback, n - lookback):
            if all(b[i] > b[j] for j in range(i - lookback, i + lookback + 1) if j != i):
                swings.append((i, a[i], False))
            elif b[i] == b[i + 1] and b[i - 1] < b[i] and b[i + 2 : i + 3].max(initial=-np.inf) < b[i] and all(b[j] < b[i] for j in range(max(0, i - lookback), min(n, i + lookback + 3)) if j < i - 1 or j > i + 2):
                swings.append((i, a[i], True))
                ticks.add(i)
                want.add((kind, "TICK_SWING", up, i, i + 1, 2))
        regular = [(i, p) for i, p, t in swings if not t]
        for i in range(n):
            for j in range(i + 1, n):
                if b[i] == b[j] and not any(b[x] > b[i] for x in range(i + 1, j)) and not (i in ticks and j == i + 1):
                    both = {i, j} <= {x for x, _ in regular}
                    want.add((kind, "SWING_TICK_EQUAL" if both else "TICK_EQUAL", up, i, j, 2))
        for x, (i, p) in enumerate(regular):
            for j, q in regular[x + 1 :]:
                if p != q and abs(p - q) / ((p + q) / 2) <= spacing and p * s >= q * s and all(b[y] <= p * s for y in range(i + 1, j)):
                    want.add((kind, "OLDER_HIGHER", up, i, j, 2))
        used, pts = set(), [(i, p) for i, p, _ in swings]
        for size in range(most, least - 1, -1):
            for st in range(len(pts) - size + 1):
                if not used & set(range(st, st + size)) and trendline(pts[st : st + size], a, c, up, tolerance, variance):
                    used |= set(range(st, st + size))
                    want.add(("TRENDLINE", None, up, pts[st][0], pts[st + size - 1][0], size))
    return want


def test_liquidity_patterns(spark):
    rng = np.random.default_rng(5)
    data = {}
    for k in range(6):
        h = np.round(100 - 0.05 * np.arange(60) * (k % 2) + rng.integers(0, 8, 60) * 0.25 * (1 + np.sin(np.arange(60) / 2)), 2)
        l = h - np.round(rng.integers(1, 5, 60) * 0.25, 2)
        data[f"s{k}"] = (h, l, (h + l) / 2)
    df = spark.createDataFrame([(k, len(h), h.tolist(), l.tolist(), c.tolist()) for k, (h, l, c) in data.items()], "k string, n int, h array<double>, l array<double>, c array<double>")
    got = {}
    for x in lq.detect(df, ["k"], 2, 0.01, least=3, most=5, tolerance=0.01, variance=0.3).collect():
        got.setdefault(x["k"], set()).add((x["type"], x["strength"], x["is_buyside"], x["start_index"], x["end_index"], x["n_points"]))
    total = 0
    for k, (h, l, c) in data.items():
        want = brute_patterns(h, l, c, 2, 0.01, 3, 5, 0.01, 0.3)
        assert got.get(k, set()) == want, k
        total += sum(x[0] == "TRENDLINE" for x in want)
    assert total > 0


def test_weights(spark):
    df = spark.createDataFrame([("TRENDLINE", None, 90), ("EQUAL_HIGHS", "TICK_EQUAL", 100), ("EQUAL_LOWS", "OLDER_HIGHER", 200)], "type string, strength string, end_index int")
    w = [x["weight"] for x in lq.with_weight(df, 100, 5).collect()]
    assert w == pytest.approx([0.9 * math.exp(-0.07), 0.75 * (1 + math.log(5) / 3), 0.7])
    assert lq.of_kinds(df, [("TRENDLINE", None), ("EQUAL_LOWS", "TICK_EQUAL")]).count() == 1


def test_streams_equal_batch(spark, tmp_path):
    base = int(dt.datetime(2025, 1, 2, 20, 50, tzinfo=dt.timezone.utc).timestamp())
    rows = [((base + i * 7) * 10**9, i % 3, i % 3, 84000 + i * 5 % 11, i + 1) for i in range(300)]
    df = normalize(spark.createDataFrame(rows, "ts_event long, intra_ts_rank long, side int, price_ticks long, size long"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    read = lambda: stream.read_stream(spark, str(tmp_path / "in"), df.schema)
    stream.run_available(stream.streaming_bars(read(), "1 minute", "1 minute"), "bars", str(tmp_path / "c1"))
    got, want = ({x["datetime_utc"]: tuple(x)[1:] for x in d.collect()} for d in (spark.table("bars"), minute_bars(df)))
    assert len(got) >= len(want) - 3 and all(want[k] == v for k, v in got.items())
    stream.run_available(stream.streaming_vwap(read(), 0, 86400), "vwap", str(tmp_path / "c2"), "complete")
    (v,) = spark.table("vwap").collect()
    want = df.agg((F.sum(F.col("price_ticks") / 4 * F.col("size")) / F.sum("size")).alias("v"), F.sum("size").alias("n")).first()
    assert v["vwap"] == pytest.approx(want["v"]) and v["volume"] == want["n"]


def test_streams_write_files(spark, tmp_path):
    """Appended windows and the latest update of each key come back from files; a window's state has a watermark."""
    base = int(dt.datetime(2025, 1, 2, 14, 0, tzinfo=dt.timezone.utc).timestamp())
    rows = [((base + i * 3600) * 10**9, i % 3, i % 3, 84000 + i * 5 % 11, i + 1) for i in range(100)]
    df = normalize(spark.createDataFrame(rows, "ts_event long, intra_ts_rank long, side int, price_ticks long, size long"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    read = lambda: stream.read_stream(spark, str(tmp_path / "in"), df.schema, 1)
    bars = stream.write_available(stream.streaming_bars(read(), "1 day", "9 days"), str(tmp_path / "bars"), str(tmp_path / "c1"))
    assert bars.collect() == []  # nothing is closed yet, and the files say so with a schema
    flow_ = stream.streaming_vwap(read(), 0, 86400, late="9 days")
    assert "EventTimeWatermark" in flow_._jdf.queryExecution().analyzed().toString()
    got = {r["date"]: r for r in stream.write_available(flow_, str(tmp_path / "vwap"), str(tmp_path / "c2"), ["date"]).collect()}
    p = df.withColumn("date", F.to_date(F.from_utc_timestamp("ts", "America/New_York"))).groupBy("date").agg((F.sum(F.col("price_ticks") / 4 * F.col("size")) / F.sum("size")).alias("v"), F.sum("size").alias("n")).collect()
    assert {r["date"]: (pytest.approx(r["v"]), r["n"]) for r in p} == {d: (r["vwap"], r["volume"]) for d, r in got.items()}


def elastic(x, y, alpha, l1):
    """Elastic net by coordinate descent on the rows."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    z, r, w = (x - mean) / scale, y - y.mean(), np.zeros(x.shape[1])
    for _ in range(3000):
        for j in range(len(w)):
            rho = z[:, j] @ (r - z @ w + z[:, j] * w[j]) / len(y)
            w[j] = np.sign(rho) * max(0, abs(rho) - alpha * l1) / ((z[:, j] ** 2).mean() + alpha * (1 - l1))
    return mean, scale, w, y.mean()


@pytest.mark.parametrize("alpha, l1", [(0.001, 0.5), (0.01, 0.25), (1.0, 0.9)])
def test_elastic_net_from_gram_sums(daily, alpha, l1):
    p = daily.dropna().toPandas()
    grams = f.gram(daily, [], FEATURES, "y").withColumn("g", F.lit(1))
    (fit,) = f.ridge(grams, ["g"], alpha, l1).collect()
    _, _, w, b = elastic(p[FEATURES].to_numpy(), p["y"].to_numpy(), alpha, l1)
    assert fit["coef"] == pytest.approx(w, abs=1e-8) and fit["intercept"] == pytest.approx(b)
    assert (alpha < 1) == any(fit["coef"])
    run = f.walkforward_experiment(daily, FEATURES, "y", alpha=alpha, l1_ratio=l1)
    days = sorted(p["trade_date"])[-math.ceil(len(p) * 0.15) :]
    dev, held = p[~p["trade_date"].isin(days)], p[p["trade_date"].isin(days)]
    mean, scale, w, b = elastic(dev[FEATURES].to_numpy(), dev["y"].to_numpy(), alpha, l1)
    mae = np.abs(held["y"] - (b + ((held[FEATURES].to_numpy() - mean) / scale) @ w)).mean()
    assert {r["sample"]: r["mae"] for r in run["metrics"].collect()}["holdout"] == pytest.approx(mae)


def brute_boosted(x, y, asked, q, trees, depth, rate, least=5):
    """The same trees by trying every split."""
    fitted, out = np.full(len(y), np.quantile(y, q)), np.full(len(asked), np.quantile(y, q))
    for _ in range(trees):
        rest = y - fitted
        pull = np.where(rest > 0, q, q - 1.0)
        todo, steps, new = [(np.ones(len(y), bool), np.ones(len(asked), bool), depth)], np.zeros(len(y)), np.zeros(len(asked))
        while todo:
            rows, there, left = todo.pop()
            best = None
            for j in range(x.shape[1]) if left and rows.sum() >= 2 * least else ():
                for cut in sorted(set(x[rows, j]))[:-1]:
                    a, b = rows & (x[:, j] <= cut), rows & (x[:, j] > cut)
                    gain = pull[a].sum() ** 2 / a.sum() + pull[b].sum() ** 2 / b.sum() - pull[rows].sum() ** 2 / rows.sum()
                    if a.sum() >= least and b.sum() >= least and gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                        above = x[b, j].min()
                        best = (gain, j, (cut + above) / 2)
            if best is None:
                steps[rows], new[there] = rate * np.quantile(rest[rows], q), rate * np.quantile(rest[rows], q)
            else:
                _, j, cut = best
                todo += [(rows & (x[:, j] <= cut), there & (asked[:, j] <= cut), left - 1), (rows & (x[:, j] > cut), there & (asked[:, j] > cut), left - 1)]
        fitted, out = fitted + steps, out + new
    return out


def dated(spark, x, y):
    """Rows a day apart, in many partitions."""
    names = [f"f{j}" for j in range(x.shape[1])]
    rows = [(DAY + dt.timedelta(days=i), *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ", ".join(["trade_date date", *(f"{n} double" for n in names), "y double"])).repartition(5), names


def windows(trained, asked, **more):
    start = trees.day_number(DAY, 0)
    return trees.Job(start, start + trained, start + trained, start + asked, **more)


@pytest.mark.parametrize("q", [0.25, 0.5, 0.75])
def test_boosted_quantiles(spark, q):
    """Histogram trees of two windows side by side, against every split tried on the rows."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 3)).round(1)
    y = x[:, 0] + np.abs(x[:, 1]) * rng.normal(size=80)
    df, names = dated(spark, x, y)
    data = trees.TreeData(df, "trade_date", names, "y")
    got = trees.answers(data, trees.boosted(data, [windows(60, 80, quantile=q), windows(40, 50, quantile=q)], 6, 2, 0.3)).collect()
    for model, (a, b) in enumerate(((60, 80), (40, 50))):
        own = [r["prediction"] for r in sorted(got, key=lambda r: r["day"]) if r["model"] == model]
        assert own == pytest.approx(brute_boosted(x[:a], y[:a], x[a:b], q, 6, 2, 0.3))


def test_quantiles_of_leaves_are_exact(spark):
    """Ties, a heavy outlier and more rows than steps: the search is narrowed until both order statistics are known."""
    rng = np.random.default_rng(2)
    y = np.concatenate([rng.normal(size=3000), np.full(500, 0.25), [1e9, -1e9]])
    df, names = dated(spark, rng.normal(size=(len(y), 1)), y)
    data = trees.TreeData(df, "trade_date", names, "y")
    jobs = [windows(len(y), len(y), quantile=q) for q in (0.0, 0.1, 0.5, 0.5731, 0.99, 1.0)]
    got = trees._quantiles(data, {i: trees._Unit(j) for i, j in enumerate(jobs)}, None, steps=16)
    assert [got[i, 0] for i in range(len(jobs))] == pytest.approx([np.quantile(y, j.quantile) for j in jobs], rel=1e-12)


def test_boosted_quantiles_cover(spark):
    rng = np.random.default_rng(8)
    wide = rng.normal(size=(4000, 2))
    target = wide[:, 0] * 2 + np.exp(wide[:, 1]) * rng.normal(size=4000)
    df, names = dated(spark, wide, target)
    data = trees.TreeData(df, "trade_date", names, "y", bins=64)
    got = trees.answers(data, trees.boosted(data, [windows(3000, 4000, quantile=q) for q in (0.25, 0.75)], 12, 3, 0.3)).toPandas()
    assert [(g["target"] <= g["prediction"]).mean() for _, g in got.groupby("model")] == pytest.approx([0.25, 0.75], abs=0.06)
    assert got["prediction"][got["model"] == 1].std() > 1  # it hangs on the features


def test_boosted_means_and_forests(spark):
    """Boosting by the mean equals plain residual trees; a forest of all rows and features is one tree; drawn rows and features still learn."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3)).round(1)
    y = 3 * x[:, 0] + x[:, 1] ** 2 + 0.1 * rng.normal(size=200)
    df, names = dated(spark, x, y)
    data = trees.TreeData(df, "trade_date", names, "y")
    job = windows(150, 200)
    got = [r["prediction"] for r in trees.answers(data, trees.boosted(data, [job], 4, 2, 0.5)).orderBy("day").collect()]
    out, fitted = np.full(50, y[:150].mean()), np.full(150, y[:150].mean())
    for _ in range(4):
        both = plain_tree(x[:150], y[:150] - fitted, np.concatenate([x[:150], x[150:]]), 2, 5)
        fitted, out = fitted + 0.5 * both[:150], out + 0.5 * both[150:]
    assert got == pytest.approx(out)
    same = [r["prediction"] for r in trees.answers(data, trees.forest(data, [job], 3, 3, share=1.0, rows=1.0)).orderBy("day").collect()]
    assert same == pytest.approx(plain_tree(x[:150], y[:150], x[150:], 3, 1))
    drawn = np.array([r["prediction"] for r in trees.answers(data, trees.forest(data, [job], 30, 5)).orderBy("day").collect()])
    assert np.abs(drawn - y[150:]).mean() < 0.7 * np.abs(y[150:] - y[:150].mean()).mean() and np.corrcoef(drawn, y[150:])[0, 1] > 0.8


def plain_tree(x, y, asked, depth, least):
    """A least-squares tree by trying every split."""
    best, out = None, np.full(len(asked), y.mean())
    for j in range(x.shape[1]) if depth else ():
        for cut in sorted(set(x[:, j]))[:-1]:
            a = x[:, j] <= cut
            gain = y[a].sum() ** 2 / a.sum() + y[~a].sum() ** 2 / (~a).sum() - y.sum() ** 2 / len(y)
            if a.sum() >= least and (~a).sum() >= least and gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-12)):
                best = (gain, j, (cut + x[~a, j].min()) / 2)
    if best:
        _, j, cut = best
        for here, there in ((x[:, j] <= cut, asked[:, j] <= cut), (x[:, j] > cut, asked[:, j] > cut)):
            out[there] = plain_tree(x[here], y[here], asked[there], depth - 1, least)
    return out


def test_boosted_forecast_refits_each_month(spark, daily):
    """Months, quantiles, series and experiments side by side; every row in a histogram of its own value."""
    p = daily.dropna().orderBy("trade_date").toPandas()
    since = p["trade_date"].iloc[100]
    both = daily.withColumn("s", F.lit("a")).unionByName(daily.withColumn("s", F.lit("b")).withColumn("y", -F.col("y")))
    got = f.boosted_quantile_forecast(both, "y", FEATURES, fraction=0.1, years=1, trees=2, by="s", experiments={"all": None, "late": since}, bins=4096).toPandas()
    for name, known in (("all", p), ("late", p[p["trade_date"] >= since])):
        days = known["trade_date"][-math.ceil(len(known) * 0.1) :]
        rows = got[got["experiment"] == name]
        assert sorted(rows["trade_date"].unique()) == sorted(days) and len(rows) == 6 * len(days)
        for month in {d.replace(day=1) for d in days}:
            own = [d for d in days if d.replace(day=1) == month]
            start = min(own)
            t = known[(known["trade_date"] < start) & (known["trade_date"] >= start.replace(year=start.year - 1))]
            a = known[known["trade_date"].isin(own)]
            for series, side in (("a", 1), ("b", -1)):
                want = brute_boosted(t[FEATURES].to_numpy(), side * t["y"].to_numpy(), a[FEATURES].to_numpy(), 0.5, 2, 3, 0.1)
                mine = rows[(rows["quantile"] == 0.5) & rows["trade_date"].isin(own) & (rows["s"] == series)].sort_values("trade_date")
                assert mine["prediction"].to_numpy() == pytest.approx(want)
    assert f.boosted_quantile_forecast(daily.limit(0), "y", FEATURES).count() == 0


def test_no_group_holds_raw_rows(spark, daily):
    """What is exchanged while trees grow is blocks of histograms, whatever the number of rows."""
    data = trees.TreeData(daily, "trade_date", FEATURES, "y", bins=16)
    plan = trees.answers(data, trees.boosted(data, [windows(200, 300, quantile=0.5)], 1, 1))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "Exchange" not in plan


def test_probe_skips_sessions_without_a_label(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(240):
        kind = f.LABELS[i % 3]
        rows.append((DAY + dt.timedelta(days=i), "full", float(i % 3 + rng.normal() * 0.1), kind))
        rows.append((DAY + dt.timedelta(days=i), "poor", float(rng.normal()), f.LABELS[i % 2]))
    df = spark.createDataFrame([*rows, (DAY, "full", 0.0, "uncertain")], "trade_date date, session_name string, x double, label string")
    report, confusion = f.three_way_probe(df, {"full": ["x"], "poor": ["x"]}, trees=8)
    got = report.collect()
    assert {r["session"] for r in got} == {"full"} and {r["model_name"] for r in got} == {"multinomial_logit", "boosted_trees", "random_forest"}
    assert all(r["f1"] > 0.9 and r["macro_f1"] > 0.9 for r in got) and sum(r["n"] for r in confusion.collect()) == 3 * 36
    assert f.three_way_probe(df, {"poor": ["x"]})[0].collect() == []


def test_predictor_deciles(spark):
    rng = np.random.default_rng(9)
    x, y = rng.integers(-50, 51, 60).astype(float), rng.integers(-9, 10, 60).astype(float)
    rows = [(DAY + dt.timedelta(days=i), "p", float(a), float(a) / 100, "k359", float(b)) for i, (a, b) in enumerate(zip(x, y))]
    rows += [(DAY + dt.timedelta(days=i), "few", float(i % 9), 0.0, "k359", 1.0) for i in range(60)]
    got = {r["predictor_decile"]: r for r in cohort.predictor_deciles(spark.createDataFrame(rows, "d date, predictor string, x double, imb double, target string, y double"), "d").collect()}
    order = np.lexsort([np.arange(60), x])
    for k in range(10):
        i = order[k * 6 : k * 6 + 6]
        signal = (x[i] != 0) & (y[i] != 0)
        assert (got[k + 1]["n_days"], got[k + 1]["n_signal_days"], got[k + 1]["opposite_count"]) == (6, signal.sum(), (x[i] * y[i] < 0).sum()) and got[k + 1]["mean_k359_delta"] == pytest.approx(y[i].mean())
    assert len(got) == 10  # a predictor with nine values has none
