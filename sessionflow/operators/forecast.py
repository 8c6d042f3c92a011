"""Range forecasting and walk-forward evaluation.

Linear fits come from grouped Gram sums (one aggregate for all folds or
dates); only the small equations are solved per group, inside tasks. Trees are
MLlib's where one fit is asked for; fits over many windows (months, folds) and
those under the quantile loss grow side by side from histograms (``trees``).
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import average_ranks, guarded_corr, quantile_linear, ratio, share
from ..functions.tables import materialize
from . import trees as trees_
from .extremes import _when

QUANTILES = (0.25, 0.5, 0.75)
LEAKY = ("macro_open", "macro_close", "macro_high", "macro_low", "macro_bar_count", "macro_range_points", "macro_dir_points")


def range_table(bars: DataFrame, day: str, minute: str, macro: tuple[int, int], open_minute: int, close_minute: int, news: DataFrame | None = None) -> DataFrame:
    """One row per day whose macro bars are complete: its range and what was known before, as shares of the last price before it; news columns beside."""
    m = F.col(minute)
    inside, before = m.between(*macro), m.between(open_minute, close_minute)
    first = lambda c, at: F.max(_when(m == at, c))  # noqa: E731  one bar per minute
    df = bars.groupBy(F.col(day).alias("trade_date")).agg(
        first("Open", open_minute).alias("day_open"), first("Close", close_minute).alias("close_before"), F.max(_when(before, "High")).alias("rth_high"), F.min(_when(before, "Low")).alias("rth_low"),
        F.countDistinct(_when(inside, minute)).alias("macro_bar_count"), F.max(_when(inside, "High")).alias("macro_high"), F.min(_when(inside, "Low")).alias("macro_low"),
        F.min_by(_when(inside, "Open"), _when(inside, minute)).alias("macro_open"), F.max_by(_when(inside, "Close"), _when(inside, minute)).alias("macro_close"),
    )
    df = df.where((F.col("macro_bar_count") == macro[1] - macro[0] + 1) & F.col("day_open").isNotNull() & F.col("close_before").isNotNull())
    c = "close_before"
    df = df.withColumn("macro_range_pct", ratio(F.col("macro_high") - F.col("macro_low"), c)).withColumn("rth_range_pct", ratio(F.col("rth_high") - F.col("rth_low"), c))
    df = df.withColumn("open_to_close_return_pct", ratio(F.col(c) - F.col("day_open"), "day_open")).withColumn("close_at_day_high_pct", ratio(F.col("rth_high") - F.col(c), c)).withColumn("close_at_day_low_pct", ratio(F.col(c) - F.col("rth_low"), c))
    return df if news is None else df.join(news.withColumnRenamed("date", "trade_date"), "trade_date", "left")


def history_features(daily: DataFrame, target: str, day: str = "trade_date", by: Sequence[str] = ()) -> DataFrame:
    """Lag, rolling means, deviation and nearest quantiles of the days before; null until a window is full. ``by`` keeps series apart."""
    w = Window.partitionBy(*by).orderBy(day)
    x = F.col(target)
    out = daily.withColumn(f"{target}_lag_1", F.lag(target).over(w))
    for k in (5, 20):
        f = w.rowsBetween(-k, -1)
        out = out.withColumn(f"{target}_mean_{k}", F.when(F.count(x).over(f) == k, F.avg(x).over(f)))
    f = w.rowsBetween(-20, -1)
    full = F.count(x).over(f) == 20
    out = out.withColumn(f"{target}_std_20", F.when(full, F.stddev_samp(x).over(f))).withColumn("_w", F.when(full, F.sort_array(F.collect_list(x).over(f))))
    for q in QUANTILES:
        out = out.withColumn(f"{target}_q{round(q * 100)}_20", F.try_element_at("_w", F.lit(int(q * 19 + 0.5) + 1)))
    return out.drop("_w")


def feature_columns(df: DataFrame, target: str, leaky: Sequence[str] = LEAKY, day: str = "trade_date") -> list[str]:
    """Numeric and boolean columns that may be used before the target is known."""
    usable = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    return [c for c, kind in df.dtypes if kind in usable and c not in (day, target, *leaky)]


def usable_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those that have a value in some row (one aggregate)."""
    row = df.agg(*(F.count(c).alias(f"c{i}") for i, c in enumerate(columns))).first()
    return [c for i, c in enumerate(columns) if row[f"c{i}"]]


def holdout_days(df: DataFrame, day: str, fraction: float) -> DataFrame:
    """Distinct days with ``holdout``: whether they are among the last ceil(fraction n)."""
    days = df.select(day).distinct()
    w = Window.orderBy(F.desc(day))  # days of one history: thousands of rows
    n = F.count("*").over(Window.partitionBy())
    return days.withColumn("holdout", F.row_number().over(w) <= F.greatest(F.lit(1), F.ceil(n * fraction))).select(day, "holdout")


def walkforward_folds(df: DataFrame, day: str, train_months: int = 24, valid_months: int = 3, step_months: int = 3) -> DataFrame:
    """(fold_id, train_start, validation_start, validation_end): half-open calendar intervals that hold days of both kinds."""
    span = df.agg(F.min(day).cast("date").alias("a"), F.max(day).cast("date").alias("b"))
    steps = F.expr(f"sequence(0, CAST(greatest(0, months_between(b, a)) AS INT) div {step_months} + 1)")
    starts = span.select("a", "b", F.explode(steps).alias("k")).withColumn("validation_start", F.add_months("a", train_months + F.col("k") * step_months)).where("validation_start <= b")
    starts = starts.select("validation_start", F.add_months("validation_start", -train_months).alias("train_start"), F.add_months("validation_start", valid_months).alias("validation_end"))
    d = F.col(day).cast("date")
    days = df.select(d.alias("d")).distinct()
    near = (F.col("d") >= F.col("train_start")) & (F.col("d") < F.col("validation_end"))
    trained = F.col("d") < F.col("validation_start")
    held = days.join(F.broadcast(starts), near).groupBy("train_start", "validation_start", "validation_end").agg(F.count_if(trained).alias("n_train"), F.count_if(~trained).alias("n_valid")).where("n_train > 0 and n_valid > 0")
    return held.withColumn("fold_id", F.row_number().over(Window.orderBy("validation_start")))


def in_folds(df: DataFrame, folds: DataFrame, day: str) -> DataFrame:
    """Rows once per fold they belong to, with ``part`` train or valid (folds are a handful, so broadcast)."""
    d = F.col(day).cast("date")
    near = (d >= F.col("train_start")) & (d < F.col("validation_end"))
    return df.join(F.broadcast(folds.select("fold_id", "train_start", "validation_start", "validation_end")), near).withColumn("part", F.when(d < F.col("validation_start"), "train").otherwise("valid")).drop("train_start", "validation_start", "validation_end")


def gram(df: DataFrame, by: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """Per group the sums that a least-squares fit needs; rows with a null are left out."""
    names = [*features, target]
    kept = df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in names))).select(*by, *(F.col(c).cast("double").alias(c) for c in names))
    k = len(features)
    sums = [F.sum(c) for c in features]
    products = [F.sum(F.col(features[i]) * F.col(features[j])) for i in range(k) for j in range(i, k)]
    return kept.groupBy(*by).agg(F.count("*").alias("n"), F.array(*sums).alias("sx"), F.array(*products).alias("sxx"), F.array(*(F.sum(F.col(c) * F.col(target)) for c in features)).alias("sxy"), F.sum(target).alias("sy"))


def _elastic(z: np.ndarray, c: np.ndarray, alpha: float, l1_ratio: float) -> np.ndarray:
    """Elastic-net coefficients by coordinate descent on a correlation matrix and the features' covariances with the target."""
    soft, flat = alpha * l1_ratio, alpha * (1 - l1_ratio)
    w = np.zeros(len(c))
    for _ in range(10_000):
        moved = 0.0
        for j in range(len(w)):
            rest = c[j] - z[j] @ w + z[j, j] * w[j]
            new = np.sign(rest) * max(0.0, abs(rest) - soft) / (z[j, j] + flat) if z[j, j] + flat > 0 else 0.0
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved <= 1e-12 * max(1.0, np.abs(w).max()):
            break
    return w


def ridge(grams: DataFrame, by: Sequence[str], alpha: float | str = 1.0, l1_ratio: float | str | None = None) -> DataFrame:
    """Rows (by, n, mean, scale, coef, intercept): ridge on population-standardised features, exact from Gram sums.

    ``alpha`` is a number or a column of ``grams``, and so is ``l1_ratio``; where
    that is not null the fit is an elastic net, mean squared error / 2 + alpha
    (l1_ratio |w| + (1 - l1_ratio) w^2 / 2), from the same sums.
    """
    given = lambda x: F.col(x).cast("double") if isinstance(x, str) else F.lit(None if x is None else float(x)).cast("double")
    grams = grams.withColumn("_alpha", given(alpha)).withColumn("_l1", given(l1_ratio))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for n, sx, sxx, sxy, sy, a, l1 in zip(f["n"], f["sx"], f["sxx"], f["sxy"], f["sy"], f["_alpha"], f["_l1"]):
                k = len(sx)
                full = np.zeros((k, k))
                full[np.triu_indices(k)] = sxx
                full = np.triu(full) + np.triu(full, 1).T
                mean = np.asarray(sx) / n
                cov = full - n * np.outer(mean, mean)
                scale = np.sqrt(np.maximum(np.diag(cov) / n, 0))
                scale[scale <= 1e-12 * np.maximum(1, np.abs(mean))] = 1.0
                z = cov / np.outer(scale, scale)
                c = (np.asarray(sxy) - mean * sy) / scale
                coef = np.linalg.solve(z + a * np.eye(k), c) if pd.isna(l1) else _elastic(z / n, c / n, a, l1)
                rows.append((mean.tolist(), scale.tolist(), coef.tolist(), sy / n))
            out = f[[*by, "n"]].copy()
            for i, c in enumerate(("mean", "scale", "coef", "intercept")):
                out[c] = [r[i] for r in rows]
            yield out

    kinds = {f.name: f.dataType.simpleString() for f in grams.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", n long, mean array<double>, scale array<double>, coef array<double>, intercept double"
    return grams.mapInPandas(solve, schema)


def predict(df: DataFrame, fits: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Adds prediction, null where a feature is; a row once for each fit of its ``by``, with the fits' other keys."""
    x = F.array(*(F.col(c).cast("double") for c in features))
    z = F.zip_with(F.zip_with(x, "mean", lambda a, b: a - b), F.zip_with("coef", "scale", lambda a, b: a / b), lambda a, b: a * b)
    value = F.col("intercept") + F.aggregate(z, F.lit(0.0), lambda s, v: s + v)
    return df.join(fits.drop("n"), list(by)).withColumn("prediction", value).drop("mean", "scale", "coef", "intercept")


def rolling_quantile_forecast(daily: DataFrame, target: str, day: str = "trade_date", fraction: float = 0.15, years: int = 2, quantiles: Sequence[float] = QUANTILES, by: Sequence[str] = ()) -> DataFrame:
    """Forecast rows: linear quantiles of the target over the years before each holdout day.

    A frame of days slides over each series (``by``), one row a day; no day is sent to the days that look back on it.
    """
    known = daily.where(F.col(target).isNotNull())
    hold = holdout_days(known, day, fraction)
    number = F.datediff(F.col(day).cast("date"), F.lit("1970-01-01").cast("date"))
    behind = Window.partitionBy(*by).orderBy("_n").rangeBetween(-366 * years, -1)
    seen = known.select(*by, F.col(day), F.col(target).cast("double").alias("_y"), F.col(target).alias("target"), number.alias("_n")).withColumn("_behind", F.collect_list(F.struct("_n", "_y")).over(behind))
    start = F.datediff(F.add_months(F.col(day).cast("date"), -12 * years), F.lit("1970-01-01").cast("date"))
    held = seen.join(F.broadcast(hold.where("holdout").select(day)), day).withColumn("_start", start)  # days
    held = held.withColumn("_x", F.array_sort(F.transform(F.filter("_behind", lambda s: s["_n"] >= F.col("_start")), lambda s: s["_y"]))).where(F.size("_x") > 0)

    def at(q: float) -> Column:
        place = F.lit(q) * (F.size("_x") - 1)
        low, high = F.get("_x", F.floor(place).cast("int")), F.get("_x", F.ceil(place).cast("int"))
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    each = F.explode(F.array(*(F.struct(F.lit(float(q)).alias("quantile"), at(q).alias("prediction")) for q in quantiles)))
    return held.select(*by, day, each.alias("f"), "target").select(*by, day, "f.quantile", "f.prediction", "target", F.lit("rolling_quantiles").alias("model_name"))


def trailing_gram(rows: DataFrame, tests: DataFrame, features: Sequence[str], target: str, day: str, years: int, by: Sequence[str] = ()) -> DataFrame:
    """``gram`` over the years before each day of ``tests`` (by, day), as differences of prefix sums.

    Each test asks for two prefixes, that of its own day and that of the day its
    window starts; asking rows and data lie in one order, so a running sum answers all.
    """
    names, k = [*features, target], len(features)
    kept = rows.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in names))).select(*by, F.col(day).cast("date").alias("_at"), *(F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(names)))
    v, pairs = [F.col(f"_v{i}") for i in range(k + 1)], [(i, j) for i in range(k) for j in range(i, k)]
    cells = {"n": F.lit(1.0), "sy": v[k]} | {f"sx{i}": v[i] for i in range(k)} | {f"sxy{i}": v[i] * v[k] for i in range(k)} | {f"sxx{i}_{j}": v[i] * v[j] for i, j in pairs}
    data = kept.select(*by, "_at", F.lit(None).cast("date").alias("_test"), F.lit(0).alias("_sign"), *(c.alias(f"_{n}") for n, c in cells.items()))
    own = F.col(day).cast("date")
    ends = F.explode(F.array(F.struct(own.alias("at"), F.lit(1).alias("sign")), F.struct(F.add_months(own, -12 * years).alias("at"), F.lit(-1).alias("sign"))))
    asked = tests.select(*by, own.alias("_test"), ends.alias("_e")).select(*by, F.col("_e.at").alias("_at"), "_test", F.col("_e.sign").alias("_sign"), *(F.lit(0.0).alias(f"_{n}") for n in cells))
    before = Window.partitionBy(*by).orderBy("_at", F.col("_test").isNull()).rowsBetween(Window.unboundedPreceding, 0)  # a day's asking rows come before its data
    summed = data.unionByName(asked).select(*by, "_test", "_sign", *(F.sum(f"_{n}").over(before).alias(n) for n in cells)).where("_test is not null")
    window = summed.groupBy(*by, "_test").agg(*(F.sum(F.col(n) * F.col("_sign")).alias(n) for n in cells)).where("n > 0")
    return window.select(*by, F.col("_test").alias(day), F.col("n").cast("long").alias("n"), F.array(*(f"sx{i}" for i in range(k))).alias("sx"), F.array(*(f"sxx{i}_{j}" for i, j in pairs)).alias("sxx"), F.array(*(f"sxy{i}" for i in range(k))).alias("sxy"), "sy")


def har_forecast(daily: DataFrame, target: str, day: str = "trade_date", fraction: float = 0.15, years: int = 2, alpha: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Forecast rows of a ridge on lag 1 and means of 5 and 20 days, refitted for each holdout day (and series ``by``)."""
    features = [f"{target}_lag_1", f"{target}_mean_5", f"{target}_mean_20"]
    known = daily.where(F.col(target).isNotNull())
    tests = known.join(F.broadcast(holdout_days(known, day, fraction).where("holdout").select(day)), day).select(*by, day).distinct()
    fits = ridge(trailing_gram(known, tests, features, target, day, years, by), [*by, day], alpha)
    out = predict(known, fits, [*by, day], features).where("prediction is not null")
    return out.select(*by, day, F.lit(0.5).alias("quantile"), "prediction", F.col(target).alias("target"), F.lit("har_rv").alias("model_name"))


def boosted_quantile_forecast(
    daily: DataFrame, target: str, features: Sequence[str], day: str = "trade_date", fraction: float = 0.15, years: int = 2, quantiles: Sequence[float] = QUANTILES, trees: int = 20, depth: int = 3, rate: float = 0.1,
    by: str | None = None, experiments: Mapping[str, datetime.date | None] | None = None, bins: int = trees_.BINS,
) -> DataFrame:
    """Forecast rows of boosted quantile trees, refitted for each calendar month of the holdout on the years before it.

    Trees of ``depth`` are grown on the sign of the quantile loss (its negative
    gradient) and each leaf takes the quantile of its residuals, so the spread
    hangs on the features. All months, quantiles, series (``by``) and
    experiments (name to first day, None for all; each with a holdout of its
    own) grow side by side from histograms; the driver holds a month's start per
    series and experiment, and the trees. Up to ``bins`` rows every value can be a cut.
    """
    data = trees_.TreeData(daily, day, features, target, by, bins)
    number = lambda d: trees_.day_number(d, 0)
    jobs, names = [], []
    for name, since in (experiments or {"": None}).items():
        rows = data.rows if since is None else data.rows.where(F.col("day") >= number(since))
        hold = holdout_days(rows, "day", fraction).where("holdout").select("day")
        month = F.trunc(F.date_from_unix_date("day"), "month")
        for r in rows.join(hold, "day").groupBy("group", month.alias("month")).agg(F.min(F.date_from_unix_date("day")).alias("start")).orderBy("group", "month").collect():
            first = max(number(_months_before(r["start"], 12 * years)), -(1 << 31) if since is None else number(since))
            for q in quantiles:
                jobs.append(trees_.Job(first, number(r["start"]), number(r["start"]), number(_months_before(r["month"], -1)), q, r["group"]))
                names.append((name, q))
    models = trees_.boosted(data, jobs, trees, depth, rate) if jobs else []
    trained = {u for u, m in enumerate(models) if m.trees and m.trained}
    found = trees_.answers(data, models)
    of = lambda k, kind: F.element_at(F.lit([n[k] for n in names] or [None]).cast(f"array<{kind}>"), F.col("model") + 1)
    out = found.where(F.col("model").isin(*trained)) if len(trained) < len(models) else found
    columns = [F.col("day").alias(day), *([F.col("group").alias(by)] if by else []), "target", of(1, "double").alias("quantile"), "prediction", F.lit("boosted_quantiles").alias("model_name")]
    return out.select(*columns, *([of(0, "string").alias("experiment")] if experiments else []))


def _months_before(day: datetime.date, months: int) -> datetime.date:
    """The same day of the month so many months earlier, or that month's last."""
    at = day.year * 12 + day.month - 1 - months
    last = (datetime.date(at // 12 + (at % 12 == 11), (at + 1) % 12 + 1, 1) - datetime.timedelta(days=1)).day
    return datetime.date(at // 12, at % 12 + 1, min(day.day, last))


def forecast_summary(forecasts: DataFrame, by: Sequence[str] = ("experiment", "model_name", "quantile")) -> DataFrame:
    """Pinball loss, coverage, absolute error of medians, and HAR errors."""
    e = F.col("target") - F.col("prediction")
    har = F.col("model_name") == "har_rv"
    return forecasts.groupBy(*by).agg(
        F.count("*").alias("n_test_dates"), F.avg(F.greatest(F.col("quantile") * e, (F.col("quantile") - 1) * e)).alias("pinball_loss"), share(e <= 0).alias("coverage"), F.avg(F.when(F.col("quantile") == 0.5, F.abs(e))).alias("mae"),
        F.avg(F.when(har, F.abs(e))).alias("har_mae"), F.sqrt(F.avg(F.when(har, e * e))).alias("har_rmse"),
    )


def slices(daily: DataFrame, day: str, post_start: str) -> DataFrame:
    """Rows once per experiment: ``full_history`` and, from ``post_start`` on, ``post_covid``."""
    names = F.array(F.lit("full_history"), F.when(F.col(day) >= F.lit(post_start).cast("date"), F.lit("post_covid")))
    return daily.withColumn("experiment", F.explode(F.filter(names, lambda x: x.isNotNull())))


def regression_metrics(predictions: DataFrame, by: Sequence[str], day: str = "trade_date") -> DataFrame:
    """Rows, days, absolute error, R squared, Pearson and Spearman per group."""
    by = list(by)
    p = predictions.where("prediction is not null and target is not null")
    p = average_ranks(materialize(p.select(*by, day, "target", "prediction")), by, {"target": "_a", "prediction": "_b"})
    e = F.col("target") - F.col("prediction")
    out = p.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.countDistinct(day).alias("n_dates"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("_s"), (F.var_pop("target") * F.count("*")).alias("_t"),
        guarded_corr("target", "prediction").alias("pearson"), guarded_corr("_a", "_b").alias("spearman"),
    )
    return out.withColumn("r2", F.when(F.col("_t") > 0, 1 - F.col("_s") / F.col("_t"))).drop("_s", "_t")


def coefficients(fits: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    return fits.select(*by, F.explode(F.arrays_zip(F.array(*map(F.lit, features)).alias("feature"), F.col("coef").alias("coefficient"))).alias("x")).select(*by, "x.*")


def coefficient_stability(coefs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    c = F.col("coefficient")
    return coefs.groupBy(*by, "feature").agg(F.avg(c).alias("mean_coefficient"), F.median(c).alias("median_coefficient"), F.stddev_pop(c).alias("std_coefficient"), F.greatest(share(c > 0), share(c < 0), share(c == 0)).alias("sign_consistency"))


#: Feature sets (fixed values).
_CORE = ("mss", "adx_quality", "irr", "er", "log_vr")
_PARTS = ("mss", "adx_strength", "adx_persistence", "adx_crossover", "irr", "er", "log_vr")
_V2 = ("containment_overshoot_ratio", "containment_range_stability", "containment_mid_cross_count", "containment_swing_symmetry")


def feature_sets() -> dict[str, tuple[str, ...]]:
    """Named feature sets: the core, its parts, and variations of the parts."""
    without = lambda *gone: tuple(c for c in _PARTS if c not in gone)
    other = lambda c: tuple(c if x == "adx_persistence" else x for x in _PARTS)
    core_dra = (*_CORE, "dra")
    sets = {"core5": _CORE, "core5_dra": core_dra, "core5_dra_containment_v2": core_dra + _V2, "adx_parts": _PARTS, "adx_parts_containment_v2": _PARTS + _V2}
    drops = {"persistence": ("adx_persistence",), "crossover": ("adx_crossover",), "log_vr": ("log_vr",), "irr": ("irr",), "persistence_log_vr": ("adx_persistence", "log_vr")}
    return sets | {f"adx_parts_minus_{k}": without(*v) for k, v in drops.items()} | {f"adx_parts_persistence_{k}": other(f"adx_persistence_{k}") for k in ("margin", "control", "recency")}


RIDGE_ALPHAS = (0.03, 0.1, 0.3, 1.0, 3.0, 10.0)


def registry(group: str, session: str, alpha: float = 1.0) -> list[dict]:
    """Experiment specs of a group: representation_sweep, ridge_alpha_sweep, elastic_net_sweep, post_adx_ablation, persistence_rewrites, containment_v2."""
    spec = lambda i, era, name, a=alpha: {"experiment_id": i, "experiment_group": group, "session_name": session, "era_name": era, "feature_set": name, "features": feature_sets()[name], "model_name": "ridge", "alpha": a}
    if group == "representation_sweep":
        eras = (("full", "full_dev"), ("post", "post_covid"), ("pre", "pre_covid"))
        return [spec(f"EXP{3 + 3 * i + j:02d}_{p}_{s}", e, s) for i, (p, e) in enumerate(eras) for j, s in enumerate(("core5", "core5_dra", "adx_parts"))]
    if group == "ridge_alpha_sweep":
        return [spec(f"{x}_{p}_core5_alpha_{str(a).replace('.', 'p')}", e, "core5", a) for p, e, x in (("full", "full_dev", "EXP01"), ("post", "post_covid", "EXP02")) for a in RIDGE_ALPHAS]
    if group == "elastic_net_sweep":
        grid = [(a, r) for a in ELASTIC_ALPHAS for r in ELASTIC_L1_RATIOS]
        return [spec(f"EN{i:02d}_full_core5", "full_dev", "core5", a) | {"model_name": "elastic_net", "l1_ratio": r} for i, (a, r) in enumerate(grid, 1)]
    if group == "post_adx_ablation":
        return [spec(f"EXP{20 + i}_post_{s}", "post_covid", s) for i, s in enumerate(["adx_parts", *(x for x in feature_sets() if "minus" in x)])]
    if group == "persistence_rewrites":
        return [spec(f"EXP{30 + i}_post_adx_persistence_{n}", "post_covid", "adx_parts" if n == "base" else f"adx_parts_persistence_{n}") for i, n in enumerate(("base", "margin", "control", "recency"))]
    if group == "containment_v2":
        return [spec(f"EXP{40 + i}_post_{s}", "post_covid", s) for i, s in enumerate(("core5_dra_containment_v2", "adx_parts_containment_v2"))]
    raise ValueError(f"unknown experiment group: {group}")


def _walk(rows: DataFrame, features: Sequence[str], target: str, day: str, specs: DataFrame | None, fraction: float = 0.15, train_months: int = 24, valid_months: int = 3, step_months: int = 3, alpha: float | str = 1.0, l1_ratio: float | str | None = None) -> tuple[DataFrame, DataFrame]:
    """(fits, predictions with sample) of every fold, 0 for the holdout, once for each row of ``specs``; Gram sums are taken once for all."""
    marked = rows.join(F.broadcast(holdout_days(rows, day, fraction)), day)
    dev = marked.where("not holdout").drop("holdout")
    folded = in_folds(dev, walkforward_folds(dev, day, train_months, valid_months, step_months), day)
    final = marked.withColumn("fold_id", F.lit(0)).withColumn("part", F.when(F.col("holdout"), "valid").otherwise("train")).drop("holdout")
    both = folded.unionByName(final.select(*folded.columns))
    grams, by = gram(both.where("part = 'train'"), ["fold_id"], features, target), ["fold_id"]
    if specs is not None:
        grams, by = grams.join(F.broadcast(specs), how="cross"), ["fold_id", "experiment_id"]  # specs are a handful
    fits = ridge(grams, by, alpha, l1_ratio)
    predictions = predict(both.where("part = 'valid'"), fits, ["fold_id"], features).withColumn("target", F.col(target)).withColumn("residual", F.col("target") - F.col("prediction"))
    return fits, predictions.withColumn("sample", F.when(F.col("fold_id") == 0, "holdout").otherwise("out_of_sample"))


class Tables(Mapping):
    """Named tables, each built when it is first asked for: ranks are laid out by jobs of their own, which an unread table need not run."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers, self._made = dict(makers), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def walkforward_experiment(table: DataFrame, features: Sequence[str], target: str, day: str = "trade_date", alpha: float = 1.0, fraction: float = 0.15, train_months: int = 24, valid_months: int = 3, step_months: int = 3, l1_ratio: float | None = None) -> Mapping[str, DataFrame]:
    """Folds over the development days, then a refit on all of them for the holdout; an elastic net with ``l1_ratio``.

    Returns predictions (fold 0 is the holdout), coefs, metrics per fold,
    metrics out of sample and on the holdout, and stability. Rows with a null
    feature or target are left out; without folds the tables have holdout rows only.
    """
    rows = table.dropna(subset=[*features, target])
    fits, predictions = _walk(rows, features, target, day, None, fraction, train_months, valid_months, step_months, alpha, l1_ratio)
    coefs = coefficients(fits, ["fold_id"], features)
    return Tables({
        "predictions": lambda: predictions.drop("sample"), "coefs": lambda: coefs, "fold_metrics": lambda: regression_metrics(predictions, ["fold_id"], day), "metrics": lambda: regression_metrics(predictions, ["sample"], day),
        "stability": lambda: coefficient_stability(coefs.where("fold_id > 0")),
    })


def leaderboard(results: Mapping[str, Mapping[str, DataFrame]]) -> DataFrame:
    """One row per experiment: out-of-sample and holdout metrics and mean sign consistency, best first."""
    rows = []
    for name, r in results.items():
        m = r["metrics"].groupBy().pivot("sample", ["out_of_sample", "holdout"]).agg(F.max("mae").alias("mae"), F.max("r2").alias("r2"), F.max("spearman").alias("spearman"))
        rows.append(m.join(r["stability"].agg(F.avg("sign_consistency").alias("mean_sign_consistency")), how="cross").withColumn("experiment_id", F.lit(name)))
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc_nulls_last("out_of_sample_r2"))


ELASTIC_ALPHAS, ELASTIC_L1_RATIOS = (0.03, 0.1, 0.3, 1.0), (0.1, 0.25, 0.5)
#: First and last day of an era, both inside; null for none (fixed values).
ERAS = {"full_dev": (None, None), "pre_covid": (None, "2020-02-28"), "post_covid": ("2020-07-01", None)}


def run_registry(table: DataFrame, specs: Sequence[Mapping], target: str, day: str = "trade_date", session: str = "session_name", eras: Mapping[str, tuple[str | None, str | None]] = ERAS, **options) -> DataFrame:
    """Leaderboard of a registry's specs over a modelling table: their era's rows of their session, folds, then the holdout.

    A row per spec: what it is, rows and days after the filter, out-of-sample and holdout
    metrics and mean sign consistency; a spec without rows is skipped with that status. Specs of
    the same session, era and features share their Gram sums; the predictions of all specs are
    ranked and measured together.
    """
    table = materialize(table)
    groups: dict[tuple, list] = {}
    for x in specs:
        groups.setdefault((x["session_name"], x["era_name"], tuple(x["features"])), []).append(x)
    keys = ("experiment_id", "experiment_group", "session_name", "era_name", "feature_set", "model_name")
    sizes, measured, weights = [], [], []
    for (name, era, features), members in groups.items():
        first, last = eras[era]
        rows = table.where(F.col(session) == name)
        rows = rows.where(F.col(day) >= F.lit(first).cast("date")) if first else rows
        rows = rows.where(F.col(day) <= F.lit(last).cast("date")) if last else rows
        rows = rows.select(day, *features, target).dropna()
        held = [(*(x[k] for k in keys), float(x["alpha"]), x.get("l1_ratio")) for x in members]
        what = table.sparkSession.createDataFrame(held, ", ".join(f"{k} string" for k in keys) + ", alpha double, l1_ratio double")
        fits, predictions = _walk(rows, features, target, day, what.select("experiment_id", "alpha", "l1_ratio"), alpha="alpha", l1_ratio="l1_ratio", **options)
        measured.append(predictions.select("experiment_id", "sample", day, "target", "prediction", "residual"))
        weights.append(coefficients(fits, ["fold_id", "experiment_id"], features).where("fold_id > 0"))
        size = rows.agg(F.count("*").alias("n_rows"), F.countDistinct(day).alias("n_dates"))
        sizes.append(what.join(F.broadcast(size), how="cross"))  # one row
    whole = lambda parts: reduce(DataFrame.unionByName, parts)
    found = regression_metrics(whole(measured), ["experiment_id", "sample"], day).groupBy("experiment_id").pivot("sample", ["out_of_sample", "holdout"]).agg(F.max("mae").alias("mae"), F.max("r2").alias("r2"), F.max("spearman").alias("spearman"))
    signs = coefficient_stability(whole(weights), ["experiment_id"]).groupBy("experiment_id").agg(F.avg("sign_consistency").alias("mean_sign_consistency"))
    board = whole(sizes).join(found, "experiment_id", "left").join(signs, "experiment_id", "left").withColumn("status", F.when(F.col("n_rows") > 0, "ok").otherwise("skipped: no rows"))
    return board.orderBy(F.desc_nulls_last("out_of_sample_r2"), "experiment_id")


def regression_bakeoff(
    table: DataFrame, features: Sequence[str], target: str, day: str = "trade_date", fraction: float = 0.2, trees: int = 20, seed: int = 7, train_months: int = 24, valid_months: int = 3, step_months: int = 3, bins: int = 32,
) -> DataFrame:
    """Metrics of ridge, boosted trees, a forest and a wide forest (many features per split): oos_* over walk-forward folds, holdout_* of a fit on all days before.

    The folds lie in the days before the holdout. Ridge comes from Gram sums;
    of each kind of trees those of all folds and of the holdout grow side by side.
    """
    rows = table.dropna(subset=[*features, target])
    held = rows.join(F.broadcast(holdout_days(rows, day, fraction)), day)
    dev = held.where("not holdout").drop("holdout")
    ends = held.agg(F.min(F.when(~F.col("holdout"), F.col(day))).cast("date").alias("first"), F.min(F.when(F.col("holdout"), F.col(day))).cast("date").alias("start")).first()
    number, far = (lambda d: trees_.day_number(d, 0)), 1 << 31
    jobs = [trees_.Job(number(r["train_start"]), number(r["validation_start"]), number(r["validation_start"]), min(number(r["validation_end"]), number(ends["start"]))) for r in walkforward_folds(dev, day, train_months, valid_months, step_months).collect()]  # a handful
    jobs.append(trees_.Job(-far, number(ends["start"]), number(ends["start"]), far))
    data = trees_.TreeData(rows, day, features, target, bins=bins)
    grown = {
        "boosted_trees": lambda: trees_.boosted(data, jobs, trees, 3, 0.1), "random_forest": lambda: trees_.forest(data, jobs, trees, 5, seed=seed),
        "wide_forest": lambda: trees_.forest(data, jobs, trees, 8, share=1.0, rows=0.7, seed=seed),
    }
    sample = F.when(F.col("model") == len(jobs) - 1, "holdout").otherwise("oos")
    scored = [trees_.answers(data, fit()).select(F.col("day").alias(day), "target", "prediction", sample.alias("sample"), F.lit(n).alias("model_name")) for n, fit in grown.items()]
    _, linear = _walk(rows, features, target, day, None, fraction, train_months, valid_months, step_months)
    scored.append(linear.select(F.col(day).cast("date").alias(day), F.col("target").cast("double").alias("target"), "prediction", F.when(F.col("fold_id") == 0, "holdout").otherwise("oos").alias("sample"), F.lit("ridge").alias("model_name")))
    found = regression_metrics(reduce(DataFrame.unionByName, scored), ["model_name", "sample"], day)
    metrics = ("n_rows", "n_dates", "mae", "r2", "pearson", "spearman")
    return found.groupBy("model_name").pivot("sample", ["oos", "holdout"]).agg(*(F.max(m).alias(m) for m in metrics))


def classification_metrics(scored: DataFrame, by: Sequence[str], top: float = 0.1) -> DataFrame:
    """PR and ROC areas, precision and lift in the top share, precision, recall, balanced accuracy and Matthews correlation at 0.5.

    ``scored`` has label (0 or 1) and score. Areas come from ranks, ties sharing theirs.
    """
    by = list(by)
    down = Window.partitionBy(*by).orderBy(F.desc("score"))
    block = Window.partitionBy(*by, "score")
    n = F.count("*").over(Window.partitionBy(*by))
    s = average_ranks(materialize(scored), by, {"score": "_rank"}).withColumn("_tp", F.sum("label").over(down.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_k", F.count("*").over(down.rangeBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_pos", F.sum("label").over(block)).withColumn("_size", F.count("*").over(block)).withColumn("_n", n).withColumn("_place", F.row_number().over(down.orderBy(F.desc("score"), *([F.col(c) for c in ("trade_date",) if c in scored.columns]))))
    hit = F.col("score") >= 0.5
    c = lambda cond: F.count_if(cond).cast("double")
    inside = F.col("_place") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * top))
    out = s.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.sum("label").alias("n_positive"), F.sum(F.when(F.col("label") == 1, F.col("_rank"))).alias("_r"), F.sum(F.col("_tp") / F.col("_k") * F.col("_pos") / F.col("_size")).alias("_ap"), F.avg(F.when(inside, F.col("label"))).alias("precision_top"),
        c(hit & (F.col("label") == 1)).alias("_tp"), c(hit & (F.col("label") == 0)).alias("_fp"), c(~hit & (F.col("label") == 1)).alias("_fn"), c(~hit & (F.col("label") == 0)).alias("_tn"),
    )
    p, m = F.col("n_positive").cast("double"), (F.col("n_rows") - F.col("n_positive")).cast("double")
    tp, fp, fn, tn = (F.col(x) for x in ("_tp", "_fp", "_fn", "_tn"))
    out = out.withColumn("roc_auc", F.try_divide(F.col("_r") - p * (p + 1) / 2, p * m)).withColumn("pr_auc", F.try_divide(F.col("_ap"), p)).withColumn("lift_top", F.try_divide(F.col("precision_top"), p / F.col("n_rows")))
    out = out.withColumn("precision", F.try_divide(tp, tp + fp)).withColumn("recall", F.try_divide(tp, tp + fn)).withColumn("balanced_accuracy", (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2)
    return out.withColumn("mcc", F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))).drop("_r", "_ap", "_tp", "_fp", "_fn", "_tn")


def classification_bakeoff(table: DataFrame, features: Sequence[str], target: str, day: str = "trade_date", fraction: float = 0.2, quantile: float = 0.75, trees: int = 20, seed: int = 7) -> DataFrame:
    """Holdout metrics of classifiers of the target's top part (cut on the training days), classes weighted evenly."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    rows = table.dropna(subset=[*features, target])
    marked = rows.join(F.broadcast(holdout_days(rows, day, fraction)), day)
    cut = marked.where("not holdout").agg(quantile_linear(target, quantile).alias("_cut"))
    marked = VectorAssembler(inputCols=list(features), outputCol="_x").transform(marked.join(F.broadcast(cut), how="cross").withColumn("label", (F.col(target) >= F.col("_cut")).cast("double")))
    weight = F.when(F.col("label") == 1, quantile).otherwise(1 - quantile)
    train, test = marked.where("not holdout").withColumn("_w", weight), marked.where("holdout")
    models = {
        "logistic": LogisticRegression(featuresCol="_x", labelCol="label", weightCol="_w", regParam=0.01), "boosted_trees": GBTClassifier(featuresCol="_x", labelCol="label", weightCol="_w", maxIter=trees, maxDepth=3, seed=seed),
        "random_forest": RandomForestClassifier(featuresCol="_x", labelCol="label", weightCol="_w", numTrees=trees, maxDepth=5, seed=seed),
    }
    scored = [m.fit(train).transform(test).select(day, "label", vector_to_array("probability")[1].alias("score"), F.lit(n).alias("model_name")) for n, m in models.items()]
    return classification_metrics(reduce(DataFrame.unionByName, scored).withColumnRenamed(day, "trade_date"), ["model_name"])


#: Labels of the probe (fixed values).
LABELS = ("trend", "containment", "chop")


def three_way_probe(labeled: DataFrame, features: Mapping[str, Sequence[str]], labels: Sequence[str] = LABELS, session: str = "session_name", day: str = "trade_date", fraction: float = 0.15, trees: int = 20, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(per-class report, confusion counts) on the holdout of each session (name to features) for three models.

    A balanced multinomial logit, boosted trees (one against the rest) and a
    balanced forest. Rows of other labels take no part; a session in which the
    days before the holdout or those in it lack a label is left out. The report
    has macro and weighted F1 and balanced accuracy in every row of a model.
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler

    parts, labels = [], list(labels)
    code = reduce(lambda c, i: F.when(F.col("label") == labels[i], float(i)).otherwise(c), range(len(labels)), F.lit(None).cast("double"))
    for name, columns in features.items():
        rows = labeled.where(F.col(session) == name).dropna(subset=list(columns))
        marked = materialize(rows.join(F.broadcast(holdout_days(rows, day, fraction)), day).withColumn("_y", code).where("_y is not null").select(day, "_y", "holdout", *columns))
        counts = {(r["holdout"], r["_y"]): r["count"] for r in marked.groupBy("holdout", "_y").count().collect()}  # two times the labels
        if len(counts) < 2 * len(labels):
            continue
        weight = F.element_at(F.create_map(*(F.lit(x) for i in range(len(labels)) for x in (float(i), 1.0 / counts[False, float(i)]))), F.col("_y"))
        assembled = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(marked.withColumn("_w", weight))
        scaler = StandardScaler(inputCol="_v", outputCol="_x", withMean=True).fit(assembled.where("not holdout"))
        train, test = (scaler.transform(assembled).where(c) for c in ("not holdout", "holdout"))
        models = {
            "multinomial_logit": LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=0.01, family="multinomial"), "boosted_trees": OneVsRest(featuresCol="_x", labelCol="_y", classifier=GBTClassifier(maxIter=trees, maxDepth=3, stepSize=0.05, seed=seed)),
            "random_forest": RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=trees, maxDepth=6, minInstancesPerNode=5, seed=seed),
        }
        parts += [m.fit(train).transform(test).select(F.lit(name).alias("session"), F.lit(n).alias("model_name"), F.col("_y").cast("int").alias("_y"), F.col("prediction").cast("int").alias("_p")) for n, m in models.items()]
    if not parts:
        parts = [labeled.sparkSession.createDataFrame([], "session string, model_name string, _y int, _p int")]
    scored = reduce(DataFrame.unionByName, parts)
    named = lambda c: F.element_at(F.array(*map(F.lit, labels)), F.col(c) + 1)
    by = ["session", "model_name"]
    confusion = materialize(scored.groupBy(*by, named("_y").alias("label"), named("_p").alias("predicted")).agg(F.count("*").alias("n")))
    total = lambda c: confusion.groupBy(*by, F.col(c).alias("class")).agg(F.sum("n").alias(f"_{c}"))
    right = confusion.where("label = predicted").select(*by, F.col("label").alias("class"), F.col("n").alias("_right"))
    report = total("label").join(total("predicted"), [*by, "class"], "left").join(right, [*by, "class"], "left").na.fill(0)
    report = report.withColumn("precision", F.coalesce(F.try_divide("_right", "_predicted"), F.lit(0.0))).withColumn("recall", F.try_divide("_right", "_label"))
    report = report.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))).withColumnRenamed("_label", "support")
    whole = Window.partitionBy(*by)  # a few classes
    report = report.withColumn("macro_f1", F.avg("f1").over(whole)).withColumn("weighted_f1", F.sum(F.col("f1") * F.col("support")).over(whole) / F.sum("support").over(whole)).withColumn("balanced_accuracy", F.avg("recall").over(whole))
    return report.drop("_predicted", "_right"), confusion
