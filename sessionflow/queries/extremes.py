"""Day outcomes, sessions, extremes, ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timecols import with_session_window
from ..operators import extremes as x
from ..sources.bars import hourly_bars, resample
from .base import BARS, TICKS, bars, rounded, rounded_sql, ticks

SPANS = {"pm": (9, 12), "hr3": (12, 15)}
MACRO = (15, 19)
KEYS = (0, 2, 5)


def sessions(spark, sf_dir):
    """Bars per session and window of the New York clock."""
    tagged = with_session_window(bars(spark, sf_dir))
    return rounded(tagged.groupBy("date", "session", "window").agg(F.count("*").alias("n"), F.avg("Close").alias("mean_close")))


_SESSIONS = f"""WITH {BARS}, t AS (SELECT *, CASE WHEN h >= 19 THEN 'ASIA' WHEN h BETWEEN 2 AND 4 THEN 'LONDON' WHEN h = 10 THEN 'NYAM' WHEN h = 12 THEN 'LUNCH' WHEN h IN (13, 14) THEN 'PM' ELSE 'OTHER' END AS session,
  CASE WHEN h = 15 THEN 'H3PM' WHEN h = 16 THEN 'POST' ELSE 'NONE' END AS "window" FROM bars)
SELECT date, session, "window", count(*)::BIGINT AS n, round(avg(c), 6) + 0.0 AS mean_close FROM t GROUP BY ALL"""


def outcomes(spark, sf_dir):
    return rounded(daily(spark, sf_dir))


def daily(spark, sf_dir):
    return x.daily_outcomes(bars(spark, sf_dir), "date", "h", MACRO, (20, 21))


_DAILY = """outcomes AS (SELECT date, arg_min(o, h) FILTER (WHERE h BETWEEN 15 AND 19) AS macro_open, arg_max(c, h) FILTER (WHERE h BETWEEN 15 AND 19) AS macro_close, max(hi) FILTER (WHERE h BETWEEN 15 AND 19) AS macro_high, min(lo) FILTER (WHERE h BETWEEN 15 AND 19) AS macro_low,
  min(h) FILTER (WHERE h BETWEEN 15 AND 19) AS h0, arg_min(h, (-hi, h)) FILTER (WHERE h BETWEEN 15 AND 19) AS hh, arg_min(h, (lo, h)) FILTER (WHERE h BETWEEN 15 AND 19) AS lh, max(hi) FILTER (WHERE h IN (20, 21)) - min(lo) FILTER (WHERE h IN (20, 21)) AS postclose_range_points
  FROM bars GROUP BY date HAVING h0 IS NOT NULL),
daily AS (SELECT *, macro_high - macro_low AS macro_range_points, macro_close - macro_open AS macro_dir_points, (hh - h0)::INT AS macro_high_time, (lh - h0)::INT AS macro_low_time, 'UNLABELED' AS macro_type FROM outcomes)"""
_OUTCOMES = rounded_sql(
    f"""WITH {BARS}, {_DAILY}, final AS (SELECT *, macro_range_points / nullif(macro_open, 0) * 100 AS macro_range_pct, macro_dir_points / nullif(macro_open, 0) * 100 AS macro_dir_pct, (macro_high - macro_open - (macro_open - macro_low)) / nullif(macro_range_points, 0) AS skew_ratio,
  (macro_close - macro_low) / nullif(macro_range_points, 0) AS close_in_range, postclose_range_points / nullif(macro_open, 0) * 100 AS postclose_range_pct FROM daily)""",
    ["macro_open", "macro_close", "macro_high", "macro_low", "macro_range_points", "macro_range_pct", "macro_dir_points", "macro_dir_pct", "skew_ratio", "close_in_range", "postclose_range_points", "postclose_range_pct"],
    ["date", "macro_high_time", "macro_low_time", "macro_type"],
)


def features(spark, sf_dir):
    return rounded(x.session_features(bars(spark, sf_dir), "date", "h", SPANS))


def _features_cte() -> str:
    parts, more = [], []
    for n, (a, b) in SPANS.items():
        f = f"FILTER (WHERE h >= {a} AND h < {b})"
        parts += [f"count(*) {f}::BIGINT AS bars_{n}", f"arg_min(o, h) {f} AS {n}_open", f"max(hi) {f} AS {n}_high", f"min(lo) {f} AS {n}_low", f"arg_max(c, h) {f} AS {n}_close", f"sum(v) {f}::BIGINT AS {n}_volume",
                  f"(arg_min(h, (-hi, h)) {f} - {a})::INT AS {n}_high_time", f"(arg_min(h, (lo, h)) {f} - {a})::INT AS {n}_low_time"]
        more += [f"{n}_high - {n}_low AS {n}_range", f"{n}_close - {n}_open AS {n}_dir", f"({n}_close - {n}_low) / nullif({n}_high - {n}_low, 0) AS {n}_close_pos", f"abs({n}_close - {n}_open) / nullif({n}_high - {n}_low, 0) AS {n}_dir_ratio", f"{n}_high_time <= {n}_low_time AS {n}_high_first"]
    state = ", ".join(f"CASE WHEN {n}_dir > 0 AND {n}_close_pos > 0.7 THEN 'bullish' WHEN {n}_dir < 0 AND {n}_close_pos < 0.3 THEN 'bearish' ELSE 'neutral' END AS {n}_trend_state" for n in SPANS)
    return f"f0 AS (SELECT date, {', '.join(parts)} FROM bars GROUP BY date), f1 AS (SELECT *, {', '.join(more)} FROM f0), feats AS (SELECT *, {state} FROM f1)"


_F_DOUBLES = [f"{n}_{c}" for n in SPANS for c in ("open", "high", "low", "close", "range", "dir", "close_pos", "dir_ratio")]
_FEATURES = rounded_sql(f"WITH {BARS}, {_features_cte()}, final AS (SELECT * FROM feats)", _F_DOUBLES, ["date", *(f"{p}" for n in SPANS for p in (f"bars_{n}", f"{n}_volume", f"{n}_high_time", f"{n}_low_time", f"{n}_high_first", f"{n}_trend_state"))])


def joined(spark, sf_dir):
    b = bars(spark, sf_dir)
    return x.interaction(x.session_features(b, "date", "h", SPANS), x.daily_outcomes(b, "date", "h", MACRO, (20, 21)), offset=3, bucket=2)


_INTER_COLUMNS = ["date", "combined_range_points", "span_range_share_pct", "macro_range_share_pct", "pm_dir_sign", "span_dir_sign", "macro_dir_sign", "took_high", "took_low", "took_both", "high_bucket", "low_bucket", "inclusive_high_time", "inclusive_high_bucket", "inclusive_low_time", "inclusive_low_bucket"]


def interactions(spark, sf_dir):
    return rounded(joined(spark, sf_dir).select(*_INTER_COLUMNS))


_INTER_CTE = f"""{BARS}, {_DAILY}, {_features_cte()}, j0 AS (SELECT *, macro_high > hr3_high AS took_high, macro_low < hr3_low AS took_low, CASE WHEN hr3_high IS NOT NULL AND macro_high IS NOT NULL THEN greatest(hr3_high, macro_high) - least(hr3_low, macro_low) END AS combined_range_points,
  coalesce(sign(pm_dir), 0)::INT AS pm_dir_sign, coalesce(sign(hr3_dir), 0)::INT AS span_dir_sign, coalesce(sign(macro_dir_points), 0)::INT AS macro_dir_sign FROM feats JOIN daily USING (date)),
j AS (SELECT *, took_high AND took_low AS took_both, hr3_range / nullif(combined_range_points, 0) * 100 AS span_range_share_pct, macro_range_points / nullif(combined_range_points, 0) * 100 AS macro_range_share_pct, hr3_high_time // 2 * 2 AS high_bucket, hr3_low_time // 2 * 2 AS low_bucket,
  CASE WHEN took_high THEN macro_high_time + 3 ELSE hr3_high_time END AS inclusive_high_time, CASE WHEN took_low THEN macro_low_time + 3 ELSE hr3_low_time END AS inclusive_low_time FROM j0)"""
_INTER = rounded_sql(f"WITH {_INTER_CTE}, final AS (SELECT *, inclusive_high_time // 2 * 2 AS inclusive_high_bucket, inclusive_low_time // 2 * 2 AS inclusive_low_bucket FROM j)", _INTER_COLUMNS[1:4], [c for c in _INTER_COLUMNS if c not in _INTER_COLUMNS[1:4]])


def interaction_rates(spark, sf_dir):
    return rounded(x.breakout_rates(joined(spark, sf_dir)))


_RATES = rounded_sql(
    f"""WITH {_INTER_CTE}, final AS (SELECT count(*)::BIGINT AS days, 100 * avg((took_high OR took_low)::INT) AS took_any_pct, 100 * avg(((took_high OR took_low) AND NOT took_both)::INT) AS took_one_pct, 100 * avg(took_both::INT) AS took_both_pct, 100 * avg((NOT (took_high OR took_low))::INT) AS took_none_pct,
  count(*) FILTER (WHERE pm_dir_sign <> 0 AND macro_dir_sign <> 0)::BIGINT AS signed_days, 100 * avg((pm_dir_sign = macro_dir_sign)::INT) FILTER (WHERE pm_dir_sign <> 0 AND macro_dir_sign <> 0) AS continued_pct, 100 * avg((pm_dir_sign <> macro_dir_sign)::INT) FILTER (WHERE pm_dir_sign <> 0 AND macro_dir_sign <> 0) AS against_pct FROM j)""",
    ["took_any_pct", "took_one_pct", "took_both_pct", "took_none_pct", "continued_pct", "against_pct"], ["days", "signed_days"],
)


def bucket_shares(spark, sf_dir):
    return rounded(x.bucket_share(joined(spark, sf_dir), "inclusive_high_bucket", ["macro_dir_sign"]))


_SHARES = f"WITH {_INTER_CTE}, s AS (SELECT macro_dir_sign, inclusive_high_time // 2 * 2 AS bucket, count(*)::BIGINT AS days FROM j WHERE inclusive_high_time IS NOT NULL GROUP BY 1, 2) SELECT *, round(days * 100.0::DOUBLE / sum(days) OVER (PARTITION BY macro_dir_sign), 6) + 0.0 AS pct_of_days FROM s"


def timed(spark, sf_dir):
    return x.extreme_timing(ticks(spark, sf_dir), KEYS, 3600, (12 * 3600, 18 * 3600))


_TIMING_CTE = f"""{TICKS}, k AS (SELECT *, epoch_ns(ts) AS ns, ((sec - 43200) // 3600)::INT AS key FROM et_ticks WHERE sec >= 43200 AND sec < 64800),
dd AS (SELECT date, arg_min(price, (ts, rk)) AS macro_open, arg_max(price, (ts, rk)) AS macro_close, max(price) AS h_, min(price) AS l_ FROM k GROUP BY date),
dy AS (SELECT date, macro_open, macro_close, macro_close - macro_open AS macro_dir_points, CASE WHEN macro_close > macro_open AND (macro_close - l_) / nullif(h_ - l_, 0) > 0.7 THEN 'bullish' WHEN macro_close < macro_open AND (macro_close - l_) / nullif(h_ - l_, 0) < 0.3 THEN 'bearish' ELSE 'neutral' END AS macro_trend_state FROM dd),
kk AS (SELECT * FROM k WHERE key IN (0, 2, 5) AND date IN (SELECT date FROM k WHERE key IN (0, 2, 5) GROUP BY date HAVING count(DISTINCT key) = 3)),
ca AS (SELECT date, key, arg_min(price, (ts, rk)) AS candle_open, max(price) AS candle_high, min(price) AS candle_low, arg_max(price, (ts, rk)) AS candle_close, sum(size)::BIGINT AS candle_volume, arg_min(ns, (-price, ts, rk)) AS candle_high_ns, arg_min(ns, (price, ts, rk)) AS candle_low_ns FROM kk GROUP BY date, key),
cb AS (SELECT *, (candle_high_ns // 1000000000 % 3600)::INT AS candle_high_time, (candle_low_ns // 1000000000 % 3600)::INT AS candle_low_time, candle_high_ns <= candle_low_ns AS candle_high_first, abs(candle_high_ns - candle_low_ns) // 1000000000 AS candle_extreme_gap_seconds, candle_close - candle_open AS candle_dir_points FROM ca),
timing AS (SELECT *, CASE WHEN candle_dir_points > 0 AND (candle_close - candle_low) / nullif(candle_high - candle_low, 0) > 0.7 THEN 'bullish' WHEN candle_dir_points < 0 AND (candle_close - candle_low) / nullif(candle_high - candle_low, 0) < 0.3 THEN 'bearish' ELSE 'neutral' END AS candle_trend_state FROM cb JOIN dy USING (date))"""
_T_DOUBLES = ["candle_open", "candle_high", "candle_low", "candle_close", "candle_dir_points", "macro_open", "macro_close", "macro_dir_points"]
_T_OTHERS = ["date", "key", "candle_volume", "candle_high_ns", "candle_low_ns", "candle_high_time", "candle_low_time", "candle_high_first", "candle_extreme_gap_seconds", "candle_trend_state", "macro_trend_state"]
_LONG = "long AS (SELECT macro_trend_state, key, candle_extreme_gap_seconds AS gap, candle_high_first AS hf, 'high' AS extreme, candle_high_time AS time FROM timing UNION ALL SELECT macro_trend_state, key, candle_extreme_gap_seconds, candle_high_first, 'low', candle_low_time FROM timing)"
_NEAR = lambda q: f"list_sort(list(time))[floor({q} * (count(time) - 1) + 0.5)::INT + 1]::DOUBLE"


def timing_summary(spark, sf_dir):
    return rounded(x.extreme_timing_summary(timed(spark, sf_dir)))


def second_counts(spark, sf_dir):
    t = timed(spark, sf_dir)
    by_minute = t.withColumn("candle_high_time", F.expr("candle_high_time div 60").cast("int")).withColumn("candle_low_time", F.expr("candle_low_time div 60").cast("int"))
    return x.extreme_second_counts(by_minute)


def trend_extremes(spark, sf_dir):
    return rounded(x.with_trend_extremes(timed(spark, sf_dir), 2700))


def barrier(spark, sf_dir):
    return rounded(x.barrier_study(timed(spark, sf_dir), 0, 600))


def barrier_rates(spark, sf_dir):
    return rounded(x.barrier_summary(x.barrier_study(timed(spark, sf_dir), 0, 600)))


def barrier_edges(spark, sf_dir):
    return rounded(x.edge_cases(x.barrier_study(timed(spark, sf_dir), 0, 600)))


_BARRIER_CTE = f"""{_TIMING_CTE}, b0 AS (SELECT date, macro_trend_state, max(macro_open) AS macro_open, max(macro_close) AS macro_close, max(candle_low) FILTER (WHERE key = 0) AS first_low, max(candle_low_time) FILTER (WHERE key = 0) AS first_low_time, max(candle_high) FILTER (WHERE key = 0) AS first_high, max(candle_high_time) FILTER (WHERE key = 0) AS first_high_time,
  min(candle_low) AS macro_low, max(candle_high) AS macro_high, arg_min(key, (candle_low, key, candle_low_time)) AS lk, arg_min(candle_low_time, (candle_low, key, candle_low_time)) AS lt, arg_min(key, (-candle_high, key, candle_high_time)) AS hk, arg_min(candle_high_time, (-candle_high, key, candle_high_time)) AS ht FROM timing WHERE macro_trend_state <> 'neutral' GROUP BY 1, 2),
b1 AS (SELECT *, CASE WHEN macro_trend_state = 'bullish' THEN 'low' ELSE 'high' END AS barrier_extreme, CASE WHEN macro_trend_state = 'bullish' THEN first_low ELSE first_high END AS barrier_price, CASE WHEN macro_trend_state = 'bullish' THEN first_low_time ELSE first_high_time END AS barrier_time, CASE WHEN macro_trend_state = 'bullish' THEN macro_low ELSE macro_high END AS macro_extreme,
  CASE WHEN macro_trend_state = 'bullish' THEN lk ELSE hk END AS macro_extreme_key, CASE WHEN macro_trend_state = 'bullish' THEN lt ELSE ht END AS macro_extreme_time FROM b0),
barrier AS (SELECT *, barrier_time < 600 AS barrier_first10, barrier_price = macro_extreme AS barrier_is_macro_extreme, barrier_time < 600 AND barrier_price = macro_extreme AS barrier_holds, barrier_price <> macro_extreme AS edge_case, abs(barrier_price - macro_extreme) AS extreme_after_points, CASE WHEN barrier_price <> macro_extreme THEN macro_extreme_key END AS extreme_after_keys FROM b1)"""
_B_DOUBLES = ["macro_open", "macro_close", "first_low", "first_high", "macro_low", "macro_high", "barrier_price", "macro_extreme", "extreme_after_points"]
_B_OTHERS = ["date", "macro_trend_state", "first_low_time", "first_high_time", "barrier_extreme", "barrier_time", "macro_extreme_key", "macro_extreme_time", "barrier_first10", "barrier_is_macro_extreme", "barrier_holds", "edge_case", "extreme_after_keys"]
_PARTS = "scoped AS (SELECT *, 'all' AS part FROM barrier UNION ALL SELECT *, CASE WHEN barrier_first10 THEN 'first10' ELSE 'after10' END FROM barrier)"

CONTEXT = ({"first": 12 * 3600, "last": 16 * 3600}, {"q1": (0, 14), "h1": (0, 29), "h2": (30, 59), "full": (0, 59)})


def ranged(spark, sf_dir):
    return x.range_context(ticks(spark, sf_dir), *CONTEXT, candle_seconds=2 * 3600, macro=(12 * 3600, 18 * 3600))


def range_context(spark, sf_dir):
    return rounded(ranged(spark, sf_dir))


def range_summary(spark, sf_dir):
    return rounded(x.range_context_summary(ranged(spark, sf_dir)))


def _range_cte() -> str:
    stats = lambda p: f"count(*)::BIGINT AS {p}_tick_count, arg_min(price, (ts, rk)) AS {p}_open, max(price) AS {p}_high, min(price) AS {p}_low, arg_max(price, (ts, rk)) AS {p}_close"
    spans = " UNION ALL ".join(f"SELECT '{w}' AS w, {a} AS a, {b} AS b" for w, (a, b) in CONTEXT[1].items())
    grow = lambda p: f"CASE WHEN window_high IS NOT NULL THEN greatest(0, {p}_high - window_high) + greatest(0, window_low - {p}_low) END AS {p}_extension_points"
    return f"""{TICKS}, k AS (SELECT *, CASE WHEN sec < 50400 THEN 'first' WHEN sec >= 57600 THEN 'last' END AS candle, ((CASE WHEN sec < 50400 THEN sec - 43200 ELSE sec - 57600 END) * 60 // 7200)::INT AS unit FROM et_ticks WHERE sec >= 43200 AND sec < 64800),
sp AS ({spans}), da AS (SELECT date, {stats('macro')} FROM k GROUP BY 1), be AS (SELECT date, max(price) AS bh, min(price) AS bl FROM k WHERE sec < 57600 GROUP BY 1), wh AS (SELECT date, candle, {stats('candle')} FROM k WHERE candle IS NOT NULL GROUP BY 1, 2),
pa AS (SELECT date, candle, w, {stats('window')} FROM k JOIN sp ON unit BETWEEN a AND b WHERE candle IS NOT NULL GROUP BY 1, 2, 3),
g AS (SELECT wh.*, sp.w AS "window", sp.a::INT AS window_start, sp.b::INT AS window_end, coalesce(window_tick_count, 0) AS window_tick_count, window_open, window_high, window_low, window_close, da.* EXCLUDE (date), bh, bl FROM wh CROSS JOIN sp LEFT JOIN pa ON pa.date = wh.date AND pa.candle = wh.candle AND pa.w = sp.w JOIN da ON da.date = wh.date LEFT JOIN be ON be.date = wh.date
  WHERE wh.date IN (SELECT date FROM wh GROUP BY date HAVING count(*) = 2)),
g1 AS (SELECT *, window_high - window_low AS window_range_points, candle_high - candle_low AS candle_range_points, macro_high - macro_low AS macro_range_points, {grow('candle')}, {grow('macro')}, CASE WHEN candle = 'last' AND bh IS NOT NULL THEN greatest(0, candle_high - bh) + greatest(0, bl - candle_low) END AS added_by_last_points FROM g),
study AS (SELECT * EXCLUDE (bh, bl), window_range_points / nullif(candle_open, 0) * 100 AS range_raw_pct_of_open, window_range_points / nullif(candle_range_points, 0) * 100 AS range_pct_of_candle, window_range_points / nullif(macro_range_points, 0) * 100 AS range_pct_of_macro,
  candle_extension_points / nullif(candle_range_points, 0) * 100 AS candle_extension_pct, macro_extension_points / nullif(macro_range_points, 0) * 100 AS macro_extension_pct, added_by_last_points / nullif(macro_range_points, 0) * 100 AS added_by_last_pct_of_macro FROM g1)"""


def _range_summary_sql() -> str:
    figures = ["window_range_points", "range_raw_pct_of_open", "range_pct_of_candle", "range_pct_of_macro", "candle_extension_points", "macro_extension_points"]
    base = ", ".join([f"median({c}) AS median_{c}" for c in figures] + [f"avg({c}) AS mean_{c}" for c in figures[:4]])
    long = " UNION ALL ".join(f"SELECT date, candle, \"window\", '{m}' AS metric, {m} AS value, window_range_points FROM study WHERE {m} IS NOT NULL" for m in x.RANGE_METRICS)
    sql = f"""WITH {_range_cte()}, lg AS ({long}), ba AS (SELECT 'window_baseline' AS summary_type, candle, "window", count(*)::BIGINT AS n_days, {base} FROM study WHERE window_range_points IS NOT NULL GROUP BY candle, "window"),
th AS (SELECT 'threshold' AS summary_type, candle, "window", metric, threshold, count(*)::BIGINT AS n_days, count(*) FILTER (WHERE value >= threshold)::BIGINT AS hit_count, median(value) AS median_metric, count(*) FILTER (WHERE value >= threshold) / count(*)::DOUBLE AS hit_rate FROM lg, (SELECT unnest([25.0, 50.0, 75.0, 90.0])::DOUBLE AS threshold) GROUP BY ALL),
dc AS (SELECT *, count(*) OVER p AS n, count(DISTINCT value) OVER (PARTITION BY candle, "window", metric) AS nd, row_number() OVER (PARTITION BY candle, "window", metric ORDER BY value, date) AS r FROM lg WINDOW p AS (PARTITION BY candle, "window", metric)),
de AS (SELECT 'decile' AS summary_type, candle, "window", metric, floor((r - 1) * 10 / n)::INT + 1 AS decile, count(*)::BIGINT AS n_days, median(value) AS median_metric, median(window_range_points) AS median_window_range_points FROM dc WHERE n >= 10 AND nd >= 10 GROUP BY candle, "window", metric, floor((r - 1) * 10 / n)::INT + 1),
final AS (SELECT * FROM ba UNION ALL BY NAME SELECT * FROM th UNION ALL BY NAME SELECT * FROM de)"""
    return rounded_sql(sql, [*(f"median_{c}" for c in figures), *(f"mean_{c}" for c in figures[:4]), "threshold", "median_metric", "hit_rate"], ["summary_type", "candle", '"window"', "n_days", "metric", "hit_count", "decile"])


_CONTRIBUTIONS = ["stage1_range_pct", "stage2_added_pct", "k0_range_pct", "k1_added_pct", "k2_added_pct", "last_push_past_points", "last_retrace_depth_points"]
_R_DOUBLES = [*(f"{p}_{c}" for p in ("window", "candle", "macro") for c in ("open", "high", "low", "close", "range_points")), *(f"{p}_extension_{u}" for p in ("candle", "macro") for u in ("points", "pct")), "range_raw_pct_of_open", "range_pct_of_candle", "range_pct_of_macro", "added_by_last_points", "added_by_last_pct_of_macro"]
_R_OTHERS = ["date", "candle", '"window"', "window_start", "window_end", "window_tick_count", "candle_tick_count", "macro_tick_count"]


def staged(spark, sf_dir):
    return x.stage_stats(bars(spark, sf_dir), "date", "h", (12, 17), 15, (12, 15, 17))


_STAGE_DOUBLES = [*(f"{n}_{c}" for n in ("macro", "stage1", "stage2", "before", "k0", "k1", "k2") for c in ("range_pct", "skew")), "stage2_added_pct", "k1_added_pct", "k2_added_pct", "last_push_past_points", "last_retrace_depth_points"]
_STAGE_OTHERS = ["date", "macro_dir", "stage1_dir", "stage2_dir", "last_expanded", "last_retraced_inside", "last_behaviour"]


def stages(spark, sf_dir):
    return rounded(staged(spark, sf_dir).select(*_STAGE_OTHERS, *_STAGE_DOUBLES))


def stage_quantiles(spark, sf_dir):
    return rounded(x.stage_percentiles(staged(spark, sf_dir), ["macro_range_pct", "stage1_range_pct", "stage2_range_pct"]))


def behaviours(spark, sf_dir):
    return rounded(x.stage_behaviours(staged(spark, sf_dir)))


def stage_correlations(spark, sf_dir):
    return rounded(x.correlation_pairs(staged(spark, sf_dir), ["stage1_skew", "stage2_skew", "macro_skew"]))


def _stage_cte() -> str:
    spans = {"macro": "h BETWEEN 12 AND 17", "stage1": "h BETWEEN 12 AND 14", "stage2": "h BETWEEN 15 AND 17", "before": "h BETWEEN 12 AND 16", "k0": "h = 12", "k1": "h = 15", "k2": "h = 17"}
    a = ", ".join(f"arg_min(o, h) FILTER (WHERE {c}) AS {n}_open, max(hi) FILTER (WHERE {c}) AS {n}_high, min(lo) FILTER (WHERE {c}) AS {n}_low, arg_max(c, h) FILTER (WHERE {c}) AS {n}_close" for n, c in spans.items())
    b = ", ".join(f"({n}_high - {n}_low) / nullif(macro_open, 0) * 100 AS {n}_range_pct, ({n}_high - {n}_open - ({n}_open - {n}_low)) / nullif({n}_high - {n}_low, 0) AS {n}_skew, coalesce(sign({n}_close - {n}_open), 0)::INT AS {n}_dir" for n in spans)
    add = lambda p, q: f"(greatest(0, {p}_low - {q}_low) + greatest(0, {q}_high - {p}_high)) / nullif(macro_open, 0) * 100"
    return f"""{BARS}, s0 AS (SELECT date, count(*) FILTER (WHERE h BETWEEN 12 AND 17) AS n_, {a} FROM bars GROUP BY date HAVING n_ >= 5), s1 AS (SELECT *, {b}, {add('stage1', 'stage2')} AS stage2_added_pct, {add('k0', 'k1')} AS k1_added_pct,
  (greatest(0, least(k0_low, k1_low) - k2_low) + greatest(0, k2_high - greatest(k0_high, k1_high))) / nullif(macro_open, 0) * 100 AS k2_added_pct, before_high IS NOT NULL AND k2_high IS NOT NULL AS known FROM s0),
s2 AS (SELECT *, CASE WHEN NOT known THEN 'none' WHEN macro_dir >= 0 AND k2_close > before_high THEN 'up' WHEN macro_dir <= 0 AND k2_close < before_low THEN 'down' ELSE 'none' END AS last_expanded, CASE WHEN known THEN least(k2_high, before_high) > greatest(k2_low, before_low) ELSE FALSE END AS last_retraced_inside FROM s1),
stages AS (SELECT *, CASE WHEN NOT known THEN 'unknown' WHEN last_expanded <> 'none' AND last_retraced_inside THEN 'expand_and_retrace' WHEN last_expanded <> 'none' THEN 'expand_only' WHEN last_retraced_inside THEN 'band_only' ELSE 'none' END AS last_behaviour,
  CASE last_expanded WHEN 'up' THEN greatest(0, k2_high - before_high) WHEN 'down' THEN greatest(0, before_low - k2_low) ELSE 0 END AS last_push_past_points, CASE last_expanded WHEN 'up' THEN greatest(0, before_high - k2_low) WHEN 'down' THEN greatest(0, k2_high - before_low) ELSE 0 END AS last_retrace_depth_points FROM s2)"""


def hourly(spark, sf_dir):
    """Complete hours of the day: all bars of an hour present (here one)."""
    return rounded(hourly_bars(bars(spark, sf_dir), (12, 13, 14), 1))


def three_hourly(spark, sf_dir):
    b = resample(bars(spark, sf_dir), 180)
    return rounded(b.withColumn("datetime_utc", F.date_format("datetime_utc", "yyyy-MM-dd HH:mm:ss")))


def regime_context(spark, sf_dir):
    """Two sessions' close positions of the day before the macro, beside its outcome."""
    f = x.session_features(bars(spark, sf_dir), "date", "h", SPANS)
    regimes = f.select(F.col("date").alias("trade_date"), F.expr("stack(2, 'morning', pm_close_pos, pm_dir_ratio, 'noon', hr3_close_pos, hr3_dir_ratio) AS (session_name, score, strength)"))
    out = x.join_regime_context(daily(spark, sf_dir).select("date", "macro_dir_points"), regimes, {"morning": "am", "noon": "nn"}, ["score", "strength"])
    return rounded(out)


QUERIES = {
    "session_tags": sessions, "daily_outcomes": outcomes, "session_features": features, "pm_macro_interaction": interactions, "breakout_rates": interaction_rates, "extreme_bucket_shares": bucket_shares,
    "extreme_timing": lambda s, d: rounded(timed(s, d)), "extreme_timing_summary": timing_summary, "extreme_second_counts": second_counts, "with_trend_extremes": trend_extremes,
    "barrier_study": barrier, "barrier_summary": barrier_rates, "barrier_edge_cases": barrier_edges, "range_context": range_context, "range_context_summary": range_summary,
    "stage_stats": stages, "stage_behaviours": behaviours, "stage_percentiles": stage_quantiles, "stage_correlations": stage_correlations, "hourly_complete_bars": hourly, "resampled_bars": three_hourly, "regime_context": regime_context,
}
_OHLC = ["open", "high", "low", "close"]
SQL = {
    "session_tags": _SESSIONS, "daily_outcomes": _OUTCOMES, "session_features": _FEATURES, "pm_macro_interaction": _INTER, "breakout_rates": _RATES, "extreme_bucket_shares": _SHARES,
    "extreme_timing": rounded_sql(f"WITH {_TIMING_CTE}, final AS (SELECT * FROM timing)", _T_DOUBLES, _T_OTHERS),
    "extreme_timing_summary": rounded_sql(
        f"WITH {_TIMING_CTE}, {_LONG}, final AS (SELECT macro_trend_state, key, extreme, count(*)::BIGINT AS sample_size, avg(time) AS mean_time, median(time) AS median_time, stddev_samp(time) AS std_time, {_NEAR(0.1)} AS p10_time, {_NEAR(0.25)} AS p25_time, {_NEAR(0.75)} AS p75_time, {_NEAR(0.9)} AS p90_time, avg(gap) AS mean_gap_seconds, median(gap) AS median_gap_seconds, 100 * avg(hf::INT) AS high_first_pct FROM long GROUP BY 1, 2, 3)",
        ["mean_time", "median_time", "std_time", "p10_time", "p25_time", "p75_time", "p90_time", "mean_gap_seconds", "median_gap_seconds", "high_first_pct"], ["macro_trend_state", "key", "extreme", "sample_size"]),
    "extreme_second_counts": f"WITH {_TIMING_CTE}, {_LONG}, c AS (SELECT macro_trend_state, key, extreme, time // 60 AS unit, count(*) AS days FROM long GROUP BY ALL) SELECT k.*, u::INT AS unit, coalesce(days, 0)::BIGINT AS days FROM (SELECT DISTINCT macro_trend_state, key, extreme FROM long) k CROSS JOIN range(60) r(u) LEFT JOIN c ON c.macro_trend_state = k.macro_trend_state AND c.key = k.key AND c.extreme = k.extreme AND c.unit = u",
    "with_trend_extremes": rounded_sql(
        f"WITH {_TIMING_CTE}, t AS (SELECT *, CASE WHEN macro_trend_state = 'bullish' THEN candle_high_time ELSE candle_low_time END AS w FROM timing WHERE macro_trend_state <> 'neutral'), final AS (SELECT macro_trend_state, key, count(*)::BIGINT AS sample_size, avg(w) AS mean_time, median(w) AS median_time, 100 * avg((w >= 2700)::INT) AS late_pct, 100 * avg((candle_high_time < candle_low_time)::INT) AS high_first_pct, 100 * avg((candle_low_time < candle_high_time)::INT) AS low_first_pct, 100 * avg((candle_high_time = candle_low_time)::INT) AS same_second_pct FROM t GROUP BY 1, 2)",
        ["mean_time", "median_time", "late_pct", "high_first_pct", "low_first_pct", "same_second_pct"], ["macro_trend_state", "key", "sample_size"]),
    "barrier_study": rounded_sql(f"WITH {_BARRIER_CTE}, final AS (SELECT * FROM barrier)", _B_DOUBLES, _B_OTHERS),
    "barrier_edge_cases": rounded_sql(f"WITH {_BARRIER_CTE}, final AS (SELECT * FROM barrier WHERE edge_case)", _B_DOUBLES, _B_OTHERS),
    "barrier_summary": rounded_sql(
        f"WITH {_BARRIER_CTE}, {_PARTS}, final AS (SELECT macro_trend_state, part, count(*)::BIGINT AS sample_size, 100 * avg(barrier_first10::INT) AS barrier_first10_pct, 100 * avg(barrier_is_macro_extreme::INT) AS barrier_is_macro_extreme_pct, 100 * avg(barrier_holds::INT) AS barrier_holds_pct, 100 * avg(edge_case::INT) AS edge_case_pct, avg(extreme_after_points) FILTER (WHERE edge_case) AS avg_extreme_after_points, median(extreme_after_points) FILTER (WHERE edge_case) AS median_extreme_after_points FROM scoped GROUP BY 1, 2)",
        ["barrier_first10_pct", "barrier_is_macro_extreme_pct", "barrier_holds_pct", "edge_case_pct", "avg_extreme_after_points", "median_extreme_after_points"], ["macro_trend_state", "part", "sample_size"]),
    "range_context": rounded_sql(f"WITH {_range_cte()}, final AS (SELECT * FROM study)", _R_DOUBLES, _R_OTHERS),
    "stage_stats": rounded_sql(f"WITH {_stage_cte()}, final AS (SELECT * FROM stages)", _STAGE_DOUBLES, _STAGE_OTHERS),
    "stage_percentiles": rounded_sql(
        f"WITH {_stage_cte()}, l AS (SELECT unnest(['macro_range_pct', 'stage1_range_pct', 'stage2_range_pct']) AS metric, unnest([macro_range_pct, stage1_range_pct, stage2_range_pct]) AS value FROM stages), final AS (SELECT metric, count(value)::BIGINT AS n, " + ", ".join(f"quantile_cont(value, {q}) AS p{round(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM l WHERE value IS NOT NULL GROUP BY 1)",
        ["p10", "p25", "p50", "p75", "p90", "p95", "p99"], ["metric", "n"]),
    "stage_correlations": rounded_sql(f"WITH {_stage_cte()}, final AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS correlation FROM stages" for a, b in (("stage1_skew", "stage2_skew"), ("stage1_skew", "macro_skew"), ("stage2_skew", "macro_skew"))) + ")", ["correlation"], ["a", "b"]),
    "stage_behaviours": rounded_sql(
        f"WITH {_stage_cte()}, final AS (SELECT last_behaviour, count(*)::BIGINT AS days, " + ", ".join(f"avg({c}) AS mean_{c}" for c in _CONTRIBUTIONS) + ", 100.0::DOUBLE * count(*) / (SELECT count(*) FROM stages) AS pct_of_days FROM stages GROUP BY 1)",
        [*(f"mean_{c}" for c in _CONTRIBUTIONS), "pct_of_days"], ["last_behaviour", "days"]),
    "range_context_summary": _range_summary_sql(),
    "hourly_complete_bars": rounded_sql(f"WITH {BARS}, final AS (SELECT date, h AS hour, o AS open, hi AS high, lo AS low, c AS close, 1::BIGINT AS n_minutes FROM bars WHERE h IN (12, 13, 14))", _OHLC, ["date", "hour", "n_minutes"]),
    "resampled_bars": f"""WITH {BARS}, b AS (SELECT strftime(time_bucket(INTERVAL 3 HOUR, datetime_utc, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS datetime_utc, datetime_utc AS t, * EXCLUDE (datetime_utc) FROM bars)
SELECT datetime_utc, round(arg_min(o, t), 6) + 0.0 AS "Open", round(max(hi), 6) + 0.0 AS "High", round(min(lo), 6) + 0.0 AS "Low", round(arg_max(c, t), 6) + 0.0 AS "Close", sum(v)::BIGINT AS "Volume" FROM b GROUP BY 1""",
    "regime_context": rounded_sql(f"WITH {BARS}, {_DAILY}, {_features_cte()}, final AS (SELECT d.date, macro_dir_points, pm_close_pos AS am_score, pm_dir_ratio AS am_strength, hr3_close_pos AS nn_score, hr3_dir_ratio AS nn_strength FROM daily d LEFT JOIN feats f ON f.date = d.date)", ["macro_dir_points", "am_score", "am_strength", "nn_score", "nn_strength"], ["date"]),
}
