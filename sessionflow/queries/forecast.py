"""Forecasting on the daily totals of orders, and walk-forward runs."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import forecast as f
from .base import BARS, bars, rounded, rounded_sql

FEATURES = ["y_lag_1", "y_mean_5", "y_mean_20"]


def series(spark, sf_dir):
    """(trade_date, y): daily order value."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(F.to_date("o_orderdate").alias("trade_date")).agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")).alias("y"))


def history(spark, sf_dir):
    return f.history_features(series(spark, sf_dir), "y")


_SERIES = "series AS (SELECT o_orderdate::DATE AS trade_date, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS y FROM orders GROUP BY 1)"
_HISTORY = f"""{_SERIES}, h0 AS (SELECT *, lag(y) OVER w AS y_lag_1, CASE WHEN count(y) OVER w5 = 5 THEN avg(y) OVER w5 END AS y_mean_5, CASE WHEN count(y) OVER w20 = 20 THEN avg(y) OVER w20 END AS y_mean_20, CASE WHEN count(y) OVER w20 = 20 THEN stddev_samp(y) OVER w20 END AS y_std_20, CASE WHEN count(y) OVER w20 = 20 THEN list_sort(list(y) OVER w20) END AS l
  FROM series WINDOW w AS (ORDER BY trade_date), w5 AS (ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w20 AS (ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
hist AS (SELECT *, l[6] AS y_q25_20, l[11] AS y_q50_20, l[15] AS y_q75_20 FROM h0)"""
_H = ["y", *FEATURES, "y_std_20", "y_q25_20", "y_q50_20", "y_q75_20"]


def folds(spark, sf_dir):
    return f.walkforward_folds(series(spark, sf_dir), "trade_date").select("fold_id", "train_start", "validation_start", "validation_end", "n_train", "n_valid")


_FOLDS = f"""WITH {_SERIES}, sp AS (SELECT min(trade_date) AS a, max(trade_date) AS b FROM series), st AS (SELECT (a + INTERVAL 1 MONTH * (24 + 3 * k))::DATE AS validation_start, b FROM sp, range(200) r(k)),
w AS (SELECT validation_start, (validation_start - INTERVAL 24 MONTH)::DATE AS train_start, (validation_start + INTERVAL 3 MONTH)::DATE AS validation_end FROM st WHERE validation_start <= b),
c AS (SELECT w.*, count(*) FILTER (WHERE trade_date < validation_start)::BIGINT AS n_train, count(*) FILTER (WHERE trade_date >= validation_start)::BIGINT AS n_valid FROM w JOIN series ON trade_date >= train_start AND trade_date < validation_end GROUP BY ALL)
SELECT row_number() OVER (ORDER BY validation_start)::INT AS fold_id, train_start, validation_start, validation_end, n_train, n_valid FROM c WHERE n_train > 0 AND n_valid > 0"""


def holdout(spark, sf_dir):
    return f.holdout_days(series(spark, sf_dir), "trade_date", 0.15)


def rolling(spark, sf_dir):
    return f.rolling_quantile_forecast(series(spark, sf_dir), "y", fraction=0.1)


_ROLLING = f"""{_SERIES}, ho AS (SELECT trade_date FROM series ORDER BY trade_date DESC LIMIT (SELECT ceil(count(*) * 0.1)::BIGINT FROM series)),
rq AS (SELECT ho.trade_date, q AS quantile, quantile_cont(s.y, [0.25, 0.5, 0.75])[i] AS prediction FROM ho JOIN series s ON s.trade_date < ho.trade_date AND s.trade_date >= (ho.trade_date - INTERVAL 24 MONTH)::DATE, (VALUES (1, 0.25::DOUBLE), (2, 0.5::DOUBLE), (3, 0.75::DOUBLE)) v(i, q) GROUP BY ho.trade_date, q, i),
fc AS (SELECT rq.*, s.y AS target, 'rolling_quantiles' AS model_name FROM rq JOIN series s ON s.trade_date = rq.trade_date)"""


def millions(spark, sf_dir):
    """The history in millions, so that fits keep their digits."""
    h = history(spark, sf_dir)
    return h.withColumns({c: F.col(c) / 1e6 for c in h.columns if c != "trade_date"})


def har(spark, sf_dir):
    return f.har_forecast(millions(spark, sf_dir), "y", fraction=0.1)


def _ridge_sql(alpha: float) -> str:
    """CTEs that fit tr (key, x1, x2, x3, y): fit (key, n, means m, scales s, coefficients w, intercept b), by Cramer's rule."""
    pairs = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3) if i <= j]
    z = lambda i, j: f"z{min(i, j)}{max(i, j)}"
    det = lambda a: f"({a[0][0]} * ({a[1][1]} * {a[2][2]} - {a[1][2]} * {a[2][1]}) - {a[0][1]} * ({a[1][0]} * {a[2][2]} - {a[1][2]} * {a[2][0]}) + {a[0][2]} * ({a[1][0]} * {a[2][1]} - {a[1][1]} * {a[2][0]}))"
    a = [[z(i, j) for j in (1, 2, 3)] for i in (1, 2, 3)]
    swapped = lambda k: [[f"v{i + 1}" if j == k else a[i][j] for j in range(3)] for i in range(3)]
    return f"""gs AS (SELECT key, count(*) AS n, sum(y) AS sy, {', '.join(f'sum(x{i}) / count(*) AS m{i}, sum(x{i} * y) AS y{i}' for i in (1, 2, 3))}, {', '.join(f'sum(x{i} * x{j}) AS p{i}{j}' for i, j in pairs)} FROM tr WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL AND y IS NOT NULL GROUP BY key),
gc AS (SELECT *, {', '.join(f'p{i}{j} - n * m{i} * m{j} AS c{i}{j}' for i, j in pairs)} FROM gs), gd AS (SELECT *, {', '.join(f'CASE WHEN sqrt(greatest(c{i}{i} / n, 0)) <= 1e-12 * greatest(1, abs(m{i})) THEN 1 ELSE sqrt(greatest(c{i}{i} / n, 0)) END AS s{i}' for i in (1, 2, 3))} FROM gc),
gz AS (SELECT *, {', '.join(f'c{i}{j} / (s{i} * s{j}) + {alpha if i == j else 0.0} AS z{i}{j}' for i, j in pairs)}, {', '.join(f'(y{i} - m{i} * sy) / s{i} AS v{i}' for i in (1, 2, 3))} FROM gd),
fit AS (SELECT *, sy / n AS b, {', '.join(f'{det(swapped(k))} / {det(a)} AS w{k + 1}' for k in range(3))} FROM gz)"""


_X = "y / 1e6 AS y, y_lag_1 / 1e6 AS x1, y_mean_5 / 1e6 AS x2, y_mean_20 / 1e6 AS x3"
_PREDICTION = "b + (x1 - m1) / s1 * w1 + (x2 - m2) / s2 * w2 + (x3 - m3) / s3 * w3"


def summary(spark, sf_dir):
    both = rolling(spark, sf_dir).withColumn("experiment", F.lit("full_history"))
    return rounded(f.forecast_summary(both))


_SUMMARY = rounded_sql(
    f"WITH {_ROLLING}, final AS (SELECT 'full_history' AS experiment, model_name, quantile, count(*)::BIGINT AS n_test_dates, avg(greatest(quantile * (target - prediction), (quantile - 1) * (target - prediction))) AS pinball_loss, avg((target <= prediction)::INT) AS coverage, avg(abs(target - prediction)) FILTER (WHERE quantile = 0.5) AS mae, NULL::DOUBLE AS har_mae, NULL::DOUBLE AS har_rmse FROM fc GROUP BY 1, 2, 3)",
    ["quantile", "pinball_loss", "coverage", "mae", "har_mae", "har_rmse"], ["experiment", "model_name", "n_test_dates"],
)


def ranges(spark, sf_dir):
    return rounded(f.range_table(bars(spark, sf_dir), "date", "h", (15, 17), 9, 14))


_RANGES = rounded_sql(
    f"""WITH {BARS}, t AS (SELECT date AS trade_date, max(o) FILTER (WHERE h = 9) AS day_open, max(c) FILTER (WHERE h = 14) AS close_before, max(hi) FILTER (WHERE h BETWEEN 9 AND 14) AS rth_high, min(lo) FILTER (WHERE h BETWEEN 9 AND 14) AS rth_low, count(DISTINCT h) FILTER (WHERE h BETWEEN 15 AND 17)::BIGINT AS macro_bar_count, max(hi) FILTER (WHERE h BETWEEN 15 AND 17) AS macro_high, min(lo) FILTER (WHERE h BETWEEN 15 AND 17) AS macro_low, max(o) FILTER (WHERE h = 15) AS macro_open, max(c) FILTER (WHERE h = 17) AS macro_close FROM bars GROUP BY date),
final AS (SELECT *, (macro_high - macro_low) / nullif(close_before, 0) AS macro_range_pct, (rth_high - rth_low) / nullif(close_before, 0) AS rth_range_pct, (close_before - day_open) / nullif(day_open, 0) AS open_to_close_return_pct, (rth_high - close_before) / nullif(close_before, 0) AS close_at_day_high_pct, (close_before - rth_low) / nullif(close_before, 0) AS close_at_day_low_pct FROM t WHERE macro_bar_count = 3 AND day_open IS NOT NULL AND close_before IS NOT NULL)""",
    ["day_open", "close_before", "rth_high", "rth_low", "macro_high", "macro_low", "macro_open", "macro_close", "macro_range_pct", "rth_range_pct", "open_to_close_return_pct", "close_at_day_high_pct", "close_at_day_low_pct"], ["trade_date", "macro_bar_count"],
)


def grams(spark, sf_dir):
    """Gram sums of the folds' training rows, in thousands so that products keep their digits."""
    h = history(spark, sf_dir).withColumns({c: F.col(c) / 1e3 for c in ("y", "y_lag_1", "y_mean_5")})
    folded = f.in_folds(h, f.walkforward_folds(h, "trade_date"), "trade_date").where("part = 'train'")
    g = f.gram(folded, ["fold_id"], ["y_lag_1", "y_mean_5"], "y")
    return g.select("fold_id", "n", F.round(F.col("sx")[0], 5).alias("sx0"), F.round(F.col("sxx")[1], 2).alias("sxx01"), F.round(F.col("sxy")[1], 2).alias("sxy1"), F.round("sy", 5).alias("sy"))


_STEPS = _FOLDS[_FOLDS.index("sp AS") : _FOLDS.index("\nSELECT row_number")]
_GRAMS = f"""WITH {_HISTORY}, {_STEPS}, fo AS ({_FOLDS[_FOLDS.index("SELECT row_number"):]}), th AS (SELECT trade_date, y / 1e3 AS y, y_lag_1 / 1e3 AS a, y_mean_5 / 1e3 AS b FROM hist)
SELECT fold_id, count(*)::BIGINT AS n, round(sum(a), 5) AS sx0, round(sum(a * b), 2) AS sxx01, round(sum(b * y), 2) AS sxy1, round(sum(y), 5) AS sy FROM th JOIN fo ON trade_date >= train_start AND trade_date < validation_start WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1"""


_HAR = rounded_sql(
    f"""WITH {_HISTORY}, xs AS (SELECT trade_date, {_X} FROM hist), ho AS (SELECT trade_date FROM series ORDER BY trade_date DESC LIMIT (SELECT ceil(count(*) * 0.1)::BIGINT FROM series)), tr AS (SELECT ho.trade_date AS key, x.* EXCLUDE (trade_date) FROM ho JOIN xs x ON x.trade_date < ho.trade_date AND x.trade_date >= (ho.trade_date - INTERVAL 24 MONTH)::DATE), {_ridge_sql(1.0)},
final AS (SELECT xs.trade_date, 0.5 AS quantile, {_PREDICTION} AS prediction, xs.y AS target, 'har_rv' AS model_name FROM xs JOIN fit ON fit.key = xs.trade_date WHERE {_PREDICTION} IS NOT NULL)""".replace("0.5 AS quantile", "0.5::DOUBLE AS quantile").replace("xs.y AS target", "xs.y AS target"),
    ["quantile", "prediction", "target"], ["trade_date", "model_name"],
)


def experiment(spark, sf_dir):
    return rounded(f.walkforward_experiment(millions(spark, sf_dir), FEATURES, "y")["metrics"])


def _walk_cte(alpha: float = 1.0) -> str:
    """CTEs of the walk-forward run: fit and predictions pr (fold, trade_date, target, prediction); fold 0 is the holdout."""
    steps = _STEPS.replace("FROM series", "FROM dev").replace("JOIN series", "JOIN dev")
    return f"""{_HISTORY}, rw AS (SELECT trade_date, {_X} FROM hist WHERE y_lag_1 IS NOT NULL AND y_mean_5 IS NOT NULL AND y_mean_20 IS NOT NULL), hd AS (SELECT *, row_number() OVER (ORDER BY trade_date DESC) <= greatest(1, ceil(count(*) OVER () * 0.15::DOUBLE)) AS held FROM rw), dev AS (SELECT * EXCLUDE (held) FROM hd WHERE NOT held),
{steps}, fo AS (SELECT row_number() OVER (ORDER BY validation_start)::INT AS fold_id, * FROM c WHERE n_train > 0 AND n_valid > 0), tr AS (SELECT fold_id AS key, dev.* FROM dev JOIN fo ON trade_date >= train_start AND trade_date < validation_start UNION ALL SELECT 0, * FROM dev), {_ridge_sql(alpha)},
va AS (SELECT fold_id AS key, dev.* FROM dev JOIN fo ON trade_date >= validation_start AND trade_date < validation_end UNION ALL SELECT 0, * EXCLUDE (held) FROM hd WHERE held), pr AS (SELECT va.key AS fold, trade_date, va.y AS target, {_PREDICTION} AS prediction FROM va JOIN fit ON fit.key = va.key),
sp_ AS (SELECT *, CASE WHEN fold = 0 THEN 'holdout' ELSE 'out_of_sample' END AS sample FROM pr), rk AS (SELECT *, {', '.join(f'rank() OVER (PARTITION BY sample ORDER BY {c}) + (count(*) OVER (PARTITION BY sample, {c}) - 1) / 2.0 AS r_{c}' for c in ('target', 'prediction'))} FROM sp_),
me AS (SELECT sample, count(*)::BIGINT AS n_rows, count(DISTINCT trade_date)::BIGINT AS n_dates, avg(abs(target - prediction)) AS mae, corr(target, prediction) AS pearson, corr(r_target, r_prediction) AS spearman, 1 - sum((target - prediction) ** 2) / (var_pop(target) * count(*)) AS r2 FROM rk GROUP BY 1),
co AS ({' UNION ALL '.join(f"SELECT '{x}' AS feature, w{i} AS coefficient FROM fit WHERE key > 0" for i, x in enumerate(FEATURES, 1))}),
st_ AS (SELECT feature, avg(coefficient) AS mean_coefficient, median(coefficient) AS median_coefficient, stddev_pop(coefficient) AS std_coefficient, greatest(avg((coefficient > 0)::INT), avg((coefficient < 0)::INT), avg((coefficient = 0)::INT)) AS sign_consistency FROM co GROUP BY 1)"""


_METRICS = rounded_sql(f"WITH {_walk_cte()}, final AS (SELECT * FROM me)", ["mae", "pearson", "spearman", "r2"], ["sample", "n_rows", "n_dates"])
_STABILITY = rounded_sql(f"WITH {_walk_cte()}, final AS (SELECT * FROM st_)", ["mean_coefficient", "median_coefficient", "std_coefficient", "sign_consistency"], ["feature"])


def _sweep_sql() -> str:
    names = [f"{x}_{m}" for x in ("out_of_sample", "holdout") for m in ("mae", "r2", "spearman")]
    cells = ", ".join(f"max({m}) FILTER (WHERE sample = '{x}') AS {x}_{m}" for x in ("out_of_sample", "holdout") for m in ("mae", "r2", "spearman"))
    one = lambda a: rounded_sql(f"WITH {_walk_cte(a)}, final AS (SELECT 'alpha_{a}' AS experiment_id, {cells}, (SELECT avg(sign_consistency) FROM st_) AS mean_sign_consistency FROM me)", [*names, "mean_sign_consistency"], ["experiment_id"])
    return " UNION ALL ".join(f"SELECT * FROM ({one(a)})" for a in (0.1, 10.0))


def stability(spark, sf_dir):
    return rounded(f.walkforward_experiment(millions(spark, sf_dir), FEATURES, "y")["stability"])


def sweep(spark, sf_dir):
    """Leaderboard of ridge strengths."""
    h = millions(spark, sf_dir)
    return rounded(f.leaderboard({f"alpha_{a}": f.walkforward_experiment(h, FEATURES, "y", alpha=a) for a in (0.1, 10.0)}))


def bakeoff(spark, sf_dir):
    return rounded(f.regression_bakeoff(history(spark, sf_dir), [*FEATURES, "y_std_20"], "y"))


def classifiers(spark, sf_dir):
    return rounded(f.classification_bakeoff(history(spark, sf_dir), [*FEATURES, "y_std_20"], "y"))


def boosted(spark, sf_dir):
    """Both slices of the whole series."""
    return rounded(f.boosted_quantile_forecast(history(spark, sf_dir), "y", FEATURES, experiments={"full_history": None, "post_covid": datetime.date(1998, 1, 1)}))


def table(spark, sf_dir):
    """The daily series as a modelling table: two sessions of alternating days, features under the registry's names, labels."""
    h = history(spark, sf_dir)
    names = {"mss": "y_lag_1", "adx_quality": "y_mean_5", "irr": "y_mean_20", "er": "y_std_20", "dra": "y_q50_20"}
    out = h.withColumns({n: F.col(c) / 1e6 for n, c in names.items()}).withColumn("log_vr", F.log(F.col("y_mean_5") / F.col("y_mean_20"))).withColumn("adx_strength", F.col("adx_quality"))
    low, mid, high = (F.col(f"y_q{q}_20") for q in (25, 50, 75))
    lag, mean5 = F.col("y_lag_1"), F.col("y_mean_5")
    out = out.withColumns({
        "adx_persistence": high / 1e6, "adx_crossover": low / 1e6, "adx_persistence_margin": (high - low) / 1e6, "adx_persistence_control": mean5 / high, "adx_persistence_recency": lag / mean5,
        "containment_overshoot_ratio": lag / high, "containment_range_stability": F.col("y_std_20") / F.col("y_mean_20"), "containment_mid_cross_count": (lag > mid).cast("double"), "containment_swing_symmetry": (high - mid) / (high - low + 1.0),
    })
    label = F.when(F.col("y") > F.col("y_q75_20"), "trend").when(F.col("y") < F.col("y_q25_20"), "chop").otherwise("containment")
    session = F.when(F.dayofmonth("trade_date") % 2 == 0, "even").otherwise("odd")
    return out.withColumns({"goal": F.col("y") / 1e6, "session_name": session, "label": label})


def alpha_sweep(spark, sf_dir):
    """The ridge registry over the even days' session, eras at the middle of the series."""
    eras = {"full_dev": (None, None), "post_covid": ("1998-01-01", None)}
    return rounded(f.run_registry(table(spark, sf_dir), f.registry("ridge_alpha_sweep", "even"), "goal", eras=eras))


def elastic_sweep(spark, sf_dir):
    return rounded(f.run_registry(table(spark, sf_dir), f.registry("elastic_net_sweep", "odd"), "goal"))


#: Eras of the feature registries: the series cut in two, each long enough for folds.
HALVES = {"full_dev": (None, None), "pre_covid": (None, "1998-04-30"), "post_covid": ("1998-05-01", None)}


def feature_sweep(group):
    """The query that runs a registry group whose specs differ in features or era, over the even days' session."""
    return lambda spark, sf_dir: rounded(f.run_registry(table(spark, sf_dir), f.registry(group, "even"), "goal", eras=HALVES))


def slice_counts(spark, sf_dir):
    return f.slices(history(spark, sf_dir), "trade_date", "1998-01-01").groupBy("experiment").agg(F.count("*").alias("n"), F.min("trade_date").alias("first_day"), F.round(F.avg("y"), 4).alias("mean_y"))


_SLICES = f"WITH {_HISTORY}, s AS (SELECT 'full_history' AS experiment, * FROM hist UNION ALL SELECT 'post_covid', * FROM hist WHERE trade_date >= DATE '1998-01-01') SELECT experiment, count(*)::BIGINT AS n, min(trade_date) AS first_day, round(avg(y), 4) AS mean_y FROM s GROUP BY 1"


def probe(spark, sf_dir):
    core = ["mss", "adx_quality", "irr", "er", "log_vr"]
    report, _ = f.three_way_probe(table(spark, sf_dir), {"even": core, "odd": core})
    return rounded(report)


QUERIES = {
    "forecast_history_features": lambda s, d: rounded(history(s, d)), "walkforward_folds": folds, "holdout_days": holdout, "rolling_quantile_forecast": lambda s, d: rounded(rolling(s, d)), "har_forecast": lambda s, d: rounded(har(s, d)), "forecast_summary": summary,
    "forecast_range_table": ranges, "fold_gram_sums": grams, "walkforward_metrics": experiment, "coefficient_stability": stability, "experiment_leaderboard": sweep, "regression_bakeoff": bakeoff, "classification_bakeoff": classifiers, "boosted_quantile_forecast": boosted, "three_way_probe": probe, "forecast_slices": slice_counts, "registry_ridge_sweep": alpha_sweep, "registry_elastic_sweep": elastic_sweep,
    **{f"registry_{g}": feature_sweep(g) for g in ("representation_sweep", "post_adx_ablation", "persistence_rewrites", "containment_v2")},
}
SQL = {
    "forecast_history_features": rounded_sql(f"WITH {_HISTORY}, final AS (SELECT * FROM hist)", _H, ["trade_date"]), "walkforward_folds": _FOLDS,
    "holdout_days": f"WITH {_SERIES} SELECT trade_date, row_number() OVER (ORDER BY trade_date DESC) <= ceil(count(*) OVER () * 0.15::DOUBLE) AS holdout FROM series",
    "rolling_quantile_forecast": rounded_sql(f"WITH {_ROLLING}, final AS (SELECT * FROM fc)", ["quantile", "prediction", "target"], ["trade_date", "model_name"]), "forecast_summary": _SUMMARY, "forecast_range_table": _RANGES, "fold_gram_sums": _GRAMS, "forecast_slices": _SLICES,
    "har_forecast": _HAR, "walkforward_metrics": _METRICS, "coefficient_stability": _STABILITY, "experiment_leaderboard": _sweep_sql(),
}
