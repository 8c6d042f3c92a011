"""Anchored VWAP queries; the study window starts at 12:00 and the first range is its first hour."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vwap as v
from .base import TICKS, rounded, rounded_sql, ticks
from .extremes import _BARRIER_CTE, timed
from ..operators.extremes import barrier_study

H = 3600
SPECS = {"am": (9 * H, 12 * H), "noon": (11 * H, 12 * H)}
INTRA = {"early": (12 * H, 13 * H), "late": (12 * H, 16 * H)}
TARGETS = {"t1": (12 * H, 15 * H), "t2": (15 * H, 18 * H)}
HORIZONS = {"h14": 14 * H, "h16": 16 * H}


def premacro(spark, sf_dir):
    return rounded(v.vwap_features(ticks(spark, sf_dir), SPECS, TARGETS, "pre"))


def merged(spark, sf_dir):
    """The same from partials of odd and even months of a day's slices."""
    t = ticks(spark, sf_dir)
    halves = [v.partials(t.where(F.pmod("intra_ts_rank", F.lit(2)) == i), SPECS, TARGETS) for i in (0, 1)]
    return rounded(v.finish(v.merge_partials(halves), SPECS, TARGETS, "pre"))


def _features_cte(specs: dict, label: str) -> str:
    a, b, c = [], [], []
    for s, (x, y) in specs.items():
        f = f"FILTER (WHERE sec >= {x} AND sec < {y})"
        a += [f"sum(price * size) {f} / nullif(sum(size) {f}, 0) AS {s}_vwap", f"arg_max(price, (ts, rk)) {f} AS {s}_price"]
        b += [f"{s}_price - {s}_vwap AS {s}_vwap_dist_points", f"({s}_price / nullif({s}_vwap, 0) - 1) * 10000 AS {s}_vwap_dist_bps", f"CASE WHEN abs({s}_price - {s}_vwap) <= 0.25 THEN 'touch' WHEN {s}_price > {s}_vwap THEN 'above' WHEN {s}_price < {s}_vwap THEN 'below' END AS {s}_vwap_side"]
    for t, (x, y) in TARGETS.items():
        f = f"FILTER (WHERE sec >= {x} AND sec < {y})"
        a.append(f"arg_max(price, (ts, rk)) {f} - arg_min(price, (ts, rk)) {f} AS {t}_points")
        b += [f"sign({t}_points)::INT AS {t}_sign", f"CASE WHEN {t}_points > 0 THEN 'bullish' WHEN {t}_points < 0 THEN 'bearish' WHEN {t}_points = 0 THEN 'neutral' END AS {t}_state"]
    for side in ("above", "below", "touch"):
        c.append(" + ".join(f"coalesce(({s}_vwap_side = '{side}')::INT, 0)" for s in specs) + f" AS {label}_{side}_count")
    return f"v0 AS (SELECT date, {', '.join(a)} FROM et_ticks GROUP BY date), v1 AS (SELECT *, {', '.join(b)} FROM v0), v2 AS (SELECT *, {', '.join(c)} FROM v1), vf AS (SELECT *, {label}_above_count - {label}_below_count AS {label}_net_side_score FROM v2)"


_DOUBLES = lambda specs: [f"{s}_{c}" for s in specs for c in ("vwap", "price", "vwap_dist_points", "vwap_dist_bps")] + [f"{t}_points" for t in TARGETS]
_OTHERS = lambda specs, label: ["date", *(f"{s}_vwap_side" for s in specs), *(f"{label}_{c}" for c in ("above_count", "below_count", "touch_count", "net_side_score")), *(f"{t}_{c}" for t in TARGETS for c in ("sign", "state"))]
_PRE = rounded_sql(f"WITH {TICKS}, {_features_cte(SPECS, 'pre')}, final AS (SELECT * FROM vf)", _DOUBLES(SPECS), _OTHERS(SPECS, "pre"))


def barriers(spark, sf_dir):
    return barrier_study(timed(spark, sf_dir), 0, 600).select("date", "macro_trend_state", "barrier_extreme", "barrier_price", "barrier_time", "barrier_first10", "barrier_holds", "edge_case")


def intramacro(spark, sf_dir):
    return rounded(v.vwap_features(ticks(spark, sf_dir), INTRA, TARGETS, "intra", barriers(spark, sf_dir)))


_B = ["barrier_macro_trend_state", "barrier_extreme", "barrier_time", "barrier_first10", "barrier_holds", "barrier_edge_case"]
_INTRA_CTE = f"{_BARRIER_CTE}, {_features_cte(INTRA, 'intra')}, vi AS (SELECT vf.*, b.macro_trend_state AS barrier_macro_trend_state, barrier_extreme, barrier_price, barrier_time, barrier_first10, barrier_holds, edge_case AS barrier_edge_case FROM vf LEFT JOIN barrier b ON b.date = vf.date)"
_INTRA = rounded_sql(f"WITH {_INTRA_CTE}, final AS (SELECT * FROM vi)", [*_DOUBLES(INTRA), "barrier_price"], [*_OTHERS(INTRA, "intra"), *_B])


def summary(spark, sf_dir):
    f = v.vwap_features(ticks(spark, sf_dir), INTRA, TARGETS, "intra", barriers(spark, sf_dir))
    return rounded(v.vwap_summary(f, list(INTRA), list(TARGETS), "intra"))


def _summary_sql() -> str:
    band = lambda s: f"CASE WHEN {s}_vwap_dist_bps IS NULL THEN NULL WHEN {s}_vwap_side = 'touch' THEN 'touch' ELSE (CASE WHEN {s}_vwap_dist_bps < 0 THEN 'below' ELSE 'above' END) || CASE WHEN abs({s}_vwap_dist_bps) <= 2 THEN '_0_2' WHEN abs({s}_vwap_dist_bps) <= 5 THEN '_2_5' WHEN abs({s}_vwap_dist_bps) <= 10 THEN '_5_10' WHEN abs({s}_vwap_dist_bps) <= 20 THEN '_10_20' ELSE '_gt_20' END END"
    dec = lambda s: f"CASE WHEN {s}_vwap_dist_bps IS NOT NULL AND count({s}_vwap_dist_bps) OVER () >= 10 AND (SELECT count(DISTINCT {s}_vwap_dist_bps) FROM vi) >= 10 THEN (floor((row_number() OVER (PARTITION BY {s}_vwap_dist_bps IS NULL ORDER BY {s}_vwap_dist_bps, date) - 1) * 10 / count({s}_vwap_dist_bps) OVER ())::INT + 1)::VARCHAR END"
    rows = []
    for s in INTRA:
        for scope, bucket in (("side", f"{s}_vwap_side"), ("fixed_bps_band", band(s)), ("decile", dec(s)), ("barrier_first10_by_side", f"concat_ws('_', {s}_vwap_side, barrier_first10::VARCHAR)"), ("barrier_holds_by_side", f"concat_ws('_', {s}_vwap_side, barrier_holds::VARCHAR)")):
            rows.append(f"SELECT date, '{s}' AS feature_name, '{scope}' AS scope, {bucket} AS bucket, t1_points, t2_points FROM vi")
    rows.append("SELECT date, 'intra_net_side_score', 'confluence', intra_net_side_score::VARCHAR, t1_points, t2_points FROM vi")
    bands = [f"{x}_{y}" for x in ("below", "above") for y in ("0_2", "2_5", "5_10", "10_20", "gt_20")] + ["touch"]
    grid = " UNION ALL ".join(f"SELECT '{s}' AS feature_name, '{t}' AS target_name, '{scope}' AS scope, unnest({bs!r}) AS bucket" for s in INTRA for t in TARGETS for scope, bs in (("side", ["above", "below", "touch"]), ("fixed_bps_band", bands)))
    sql = f"""WITH {_INTRA_CTE}, sc AS ({' UNION ALL '.join(rows)}), lg AS (SELECT feature_name, scope, bucket, 't1' AS target_name, t1_points AS points FROM sc WHERE bucket IS NOT NULL UNION ALL SELECT feature_name, scope, bucket, 't2', t2_points FROM sc WHERE bucket IS NOT NULL),
ag AS (SELECT feature_name, target_name, scope, bucket, count(*)::BIGINT AS sample_size, count(*) FILTER (WHERE points > 0)::BIGINT AS bullish_count, count(*) FILTER (WHERE points < 0)::BIGINT AS bearish_count, count(*) FILTER (WHERE points = 0)::BIGINT AS neutral_count, avg(points) AS avg_target_points, median(points) AS median_target_points FROM lg GROUP BY ALL),
gr AS ({grid}), final AS (SELECT 'intra' AS feature_set, feature_name, target_name, scope, bucket, coalesce(sample_size, 0) AS sample_size, coalesce(bullish_count, 0) AS bullish_count, coalesce(bearish_count, 0) AS bearish_count, coalesce(neutral_count, 0) AS neutral_count, avg_target_points, median_target_points,
  100.0 * bullish_count / sample_size AS bullish_pct, 100.0 * bearish_count / sample_size AS bearish_pct, 100.0 * neutral_count / sample_size AS neutral_pct FROM ag FULL JOIN gr USING (feature_name, target_name, scope, bucket))"""
    return rounded_sql(sql, ["avg_target_points", "median_target_points", "bullish_pct", "bearish_pct", "neutral_pct"], ["feature_set", "feature_name", "target_name", "scope", "bucket", "sample_size", "bullish_count", "bearish_count", "neutral_count"])


def contexts(spark, sf_dir):
    t = ticks(spark, sf_dir)
    return v.barrier_context(barriers(spark, sf_dir), v.vwap_features(t, INTRA, TARGETS, "intra"), t, "early", "late", 12 * H, H, {"after": (13 * H, 18 * H)})


_CTX = ["post_barrier_tick_count", "vwap_side_at_barrier", "vwap_side_at_close", "closed_wrong_side", "closed_wrong_side_more_than_1tick", "closed_wrong_side_more_than_2pts", "closed_wrong_side_more_than_5pts", "after_sign", "after_state", "early_constructive", "late_constructive", "context_transition", "first10_and_early_constructive", "holds_and_late_constructive", "first10_and_late_constructive"]
_CTX_DOUBLES = ["vwap_dist_at_barrier_points", "vwap_dist_at_close_points", "worst_wrong_side_dist_points", "worst_wrong_side_dist_bps", "seconds_wrong_side", "wrong_side_share", "after_points"]


def context(spark, sf_dir):
    return rounded(contexts(spark, sf_dir).select("date", *_CTX, *_CTX_DOUBLES))


_CTX_CTE = f"""{_BARRIER_CTE}, {_features_cte(INTRA, 'intra')}, rt AS (SELECT e.*, epoch_ns(ts) AS ns, b.macro_trend_state AS mts, b.barrier_time AS bt, sum(CASE WHEN sec < 46800 THEN price * size END) OVER o / nullif(sum(CASE WHEN sec < 46800 THEN size END) OVER o, 0) AS vwap, sec >= 43200 + b.barrier_time AND sec < 46800 AS aft
  FROM et_ticks e JOIN barrier b ON b.date = e.date WHERE sec >= 43200 AND sec < 64800 WINDOW o AS (PARTITION BY e.date ORDER BY ts, rk ROWS UNBOUNDED PRECEDING)),
ru AS (SELECT *, price - vwap AS raw, (price - vwap) * CASE mts WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 END AS signed, greatest(0, (coalesce(lead(ns) OVER (PARTITION BY date, aft ORDER BY ts, rk), epoch_ns(timezone('UTC', timezone('America/New_York', date + INTERVAL 13 HOUR)))) - ns) / 1e9) AS secs FROM rt),
rm AS (SELECT date, bt, count(*) FILTER (WHERE aft)::BIGINT AS post_barrier_tick_count, arg_min(raw, (ts, rk)) FILTER (WHERE aft) AS ra, arg_min(signed, (ts, rk)) FILTER (WHERE aft) AS vwap_dist_at_barrier_points, arg_max(raw, (ts, rk)) FILTER (WHERE aft) AS rb, arg_max(signed, (ts, rk)) FILTER (WHERE aft) AS vwap_dist_at_close_points, arg_max(vwap, (ts, rk)) FILTER (WHERE aft) AS wb,
  max(greatest(0, -signed)) FILTER (WHERE aft AND signed IS NOT NULL) AS worst_wrong_side_dist_points, sum(secs) FILTER (WHERE aft AND signed < 0) AS s_, arg_max(price, (ts, rk)) FILTER (WHERE sec >= 46800) - arg_min(price, (ts, rk)) FILTER (WHERE sec >= 46800) AS after_points FROM ru GROUP BY 1, 2),
rn AS (SELECT *, CASE WHEN abs(ra) <= 0.25 THEN 'touch' WHEN ra > 0 THEN 'above' WHEN ra < 0 THEN 'below' END AS vwap_side_at_barrier, CASE WHEN abs(rb) <= 0.25 THEN 'touch' WHEN rb > 0 THEN 'above' WHEN rb < 0 THEN 'below' END AS vwap_side_at_close, greatest(0, -vwap_dist_at_close_points) AS cw, worst_wrong_side_dist_points / nullif(wb, 0) * 10000 AS worst_wrong_side_dist_bps,
  CASE WHEN post_barrier_tick_count > 0 THEN coalesce(s_, 0) END AS seconds_wrong_side, sign(after_points)::INT AS after_sign, CASE WHEN after_points > 0 THEN 'bullish' WHEN after_points < 0 THEN 'bearish' WHEN after_points = 0 THEN 'neutral' END AS after_state FROM rm),
cx AS (SELECT b.date, b.macro_trend_state, barrier_first10, barrier_holds, t1_points, t2_points, rn.* EXCLUDE (date), CASE WHEN vwap_dist_at_close_points IS NOT NULL THEN cw > 0 END AS closed_wrong_side, CASE WHEN vwap_dist_at_close_points IS NOT NULL THEN cw > 0.25 END AS closed_wrong_side_more_than_1tick, CASE WHEN vwap_dist_at_close_points IS NOT NULL THEN cw > 2 END AS closed_wrong_side_more_than_2pts, CASE WHEN vwap_dist_at_close_points IS NOT NULL THEN cw > 5 END AS closed_wrong_side_more_than_5pts,
  seconds_wrong_side / nullif(3600 - b.barrier_time, 0) AS wrong_side_share, {', '.join(f"CASE WHEN {s}_vwap_side IS NULL THEN 'unknown' WHEN {s}_vwap_side = 'touch' THEN 'touch' WHEN (b.macro_trend_state = 'bullish') = ({s}_vwap_side = 'above') THEN 'constructive' ELSE 'wrong' END AS {s}_constructive" for s in INTRA)}
  FROM barrier b JOIN vf ON vf.date = b.date LEFT JOIN rn ON rn.date = b.date),
cy AS (SELECT *, CASE WHEN early_constructive = 'unknown' OR late_constructive = 'unknown' THEN 'unknown' WHEN early_constructive = 'touch' OR late_constructive = 'touch' THEN 'touch_mixed' ELSE early_constructive || '_to_' || late_constructive END AS context_transition, barrier_first10 AND early_constructive IN ('constructive', 'touch') AS first10_and_early_constructive,
  barrier_holds AND late_constructive IN ('constructive', 'touch') AS holds_and_late_constructive, barrier_first10 AND late_constructive IN ('constructive', 'touch') AS first10_and_late_constructive FROM cx)"""


def context_summary(spark, sf_dir):
    return rounded(v.barrier_context_summary(contexts(spark, sf_dir), ["t1", "t2", "after"]))


def context_quantiles(spark, sf_dir):
    return rounded(v.wrong_side_quantiles(contexts(spark, sf_dir)))


def decisions(spark, sf_dir):
    return rounded(v.decision_table(contexts(spark, sf_dir), "t2"))


def retouches(spark, sf_dir):
    return v.retouch_study(ticks(spark, sf_dir), 12 * H, H // 2, 13 * H, 18 * H, HORIZONS)


def retouch(spark, sf_dir):
    return rounded(retouches(spark, sf_dir))


def _retouch_sql() -> str:
    fwd, exc, doubles = [], [], []
    for name, a in (("break", "k"), ("retouch_frozen", "f"), ("retouch_rolling", "r")):
        for h, x in HORIZONS.items():
            fwd.append(f"CASE WHEN {a}.sec < {x} THEN (p_{h} - {a}.p) * bias_ END AS fwd_{name}_{h}_points")
            doubles.append(f"fwd_{name}_{h}_points")
        exc += [f"max(CASE WHEN at_ >= {a}.at_ THEN (price - {a}.p) * bias_ END) AS mfe_{name}_points", f"min(CASE WHEN at_ >= {a}.at_ THEN (price - {a}.p) * bias_ END) AS mae_{name}_points"]
        doubles += [f"mfe_{name}_points", f"mae_{name}_points"]
    hs = ", ".join(f"arg_max(price, at_) FILTER (WHERE sec < {x}) AS p_{h}" for h, x in HORIZONS.items())
    sql = f"""WITH {TICKS}, w AS (SELECT *, (ts, rk) AS at_, sum(price * size) OVER o / nullif(sum(size) OVER o, 0) AS vwap FROM et_ticks WHERE sec >= 43200 AND sec < 64800 WINDOW o AS (PARTITION BY date ORDER BY ts, rk ROWS UNBOUNDED PRECEDING)),
d AS (SELECT date, count(*)::BIGINT AS tick_count_macro, count(*) FILTER (WHERE sec < 45000) > 0 AS has_first, arg_min(price, at_) FILTER (WHERE sec < 45000) AS open_first, max(price) FILTER (WHERE sec < 45000) AS high_first, min(price) FILTER (WHERE sec < 45000) AS low_first, sum(price * size) FILTER (WHERE sec < 45000) / nullif(sum(size) FILTER (WHERE sec < 45000), 0) AS vwap_frozen,
  sum(size) FILTER (WHERE sec < 45000)::DOUBLE / nullif(sum(size) FILTER (WHERE sec < 46800), 0) AS vol_share_first, arg_max(price, at_) FILTER (WHERE sec < 46800) - arg_min(price, at_) FILTER (WHERE sec < 46800) AS candle_dir_points, arg_max(price, at_) - arg_min(price, at_) AS macro_dir_points, {hs} FROM w GROUP BY date),
k AS (SELECT w.date, min(at_) AS at_, arg_min(price, at_) AS p, arg_min(sec, at_) AS sec, arg_min(CASE WHEN price > high_first THEN 1.0 ELSE -1.0 END, at_) AS bias_ FROM w JOIN d ON d.date = w.date WHERE sec >= 45000 AND (price > high_first OR price < low_first) GROUP BY w.date),
f AS (SELECT w.date, min(w.at_) AS at_, arg_min(price, w.at_) AS p, arg_min(w.sec, w.at_) AS sec FROM w JOIN k ON k.date = w.date JOIN d ON d.date = w.date WHERE w.at_ > k.at_ AND (price - vwap_frozen) * bias_ <= 0.25 GROUP BY w.date),
r AS (SELECT w.date, min(w.at_) AS at_, arg_min(price, w.at_) AS p, arg_min(w.sec, w.at_) AS sec, arg_min(vwap, w.at_) AS vw FROM w JOIN k ON k.date = w.date WHERE w.at_ > k.at_ AND (price - vwap) * bias_ <= 0.25 GROUP BY w.date),
e AS (SELECT w.date, {', '.join(exc).replace('at_ >=', 'w.at_ >=')} FROM w JOIN k ON k.date = w.date LEFT JOIN f ON f.date = w.date LEFT JOIN r ON r.date = w.date GROUP BY w.date),
fin AS (SELECT d.* , high_first - low_first AS range_first_points, {', '.join(fwd)}, e.* EXCLUDE (date), CASE WHEN NOT has_first THEN 'no_first_range' WHEN k.date IS NOT NULL THEN 'triggered' ELSE 'no_trigger' END AS trigger_state, CASE WHEN bias_ > 0 THEN 'high' WHEN bias_ < 0 THEN 'low' END AS break_side, CASE WHEN bias_ > 0 THEN 'bullish' WHEN bias_ < 0 THEN 'bearish' END AS bias,
  k.sec - 43200 AS break_time_s, k.p AS break_price, epoch_ns(k.at_[1]) AS break_ns, CASE WHEN k.date IS NOT NULL THEN f.date IS NOT NULL END AS retouch_frozen_occurred, f.sec - 43200 AS retouch_frozen_time_s, f.p AS retouch_frozen_price, f.sec - k.sec AS retouch_frozen_lag_s, CASE WHEN k.date IS NOT NULL THEN r.date IS NOT NULL END AS retouch_rolling_occurred, r.sec - 43200 AS retouch_rolling_time_s, r.p AS retouch_rolling_price, r.sec - k.sec AS retouch_rolling_lag_s, r.vw AS vwap_rolling_at_retouch,
  {', '.join(f"sign({c}_dir_points)::INT AS {c}_dir_sign, CASE WHEN {c}_dir_points > 0 THEN 'bullish' WHEN {c}_dir_points < 0 THEN 'bearish' WHEN {c}_dir_points = 0 THEN 'neutral' END AS {c}_state" for c in ('candle', 'macro'))}
  FROM d LEFT JOIN k ON k.date = d.date LEFT JOIN f ON f.date = d.date LEFT JOIN r ON r.date = d.date LEFT JOIN e ON e.date = d.date),
final AS (SELECT *, CASE WHEN candle_state <> 'neutral' THEN bias = candle_state END AS bias_matches_candle, CASE WHEN macro_state <> 'neutral' THEN bias = macro_state END AS bias_matches_macro FROM fin)"""
    doubles += ["open_first", "high_first", "low_first", "vwap_frozen", "vol_share_first", "candle_dir_points", "macro_dir_points", "range_first_points", "break_price", "retouch_frozen_price", "retouch_rolling_price", "vwap_rolling_at_retouch"]
    others = ["date", "tick_count_macro", "has_first", "trigger_state", "break_side", "bias", "break_time_s", "break_ns", *(f"{c}_{x}" for c in ("candle", "macro") for x in ("dir_sign", "state")), "bias_matches_candle", "bias_matches_macro", *(f"retouch_{r}_{x}" for r in ("frozen", "rolling") for x in ("occurred", "time_s", "lag_s"))]
    return rounded_sql(sql, doubles, others)


def retouch_rates(spark, sf_dir):
    return rounded(v.retouch_summary(retouches(spark, sf_dir), list(_RATED)))


_near = lambda v, q: f"list_sort(list({v}) FILTER (WHERE {v} IS NOT NULL))[floor({q} * (count({v}) - 1) + 0.5)::INT + 1]"


def _context_summary_sql() -> str:
    tenth = lambda v: f"CASE WHEN {v} IS NOT NULL AND count({v}) OVER () >= 10 THEN (floor((row_number() OVER (PARTITION BY {v} IS NULL ORDER BY {v}, date) - 1) * 10 / count({v}) OVER ())::INT + 1)::VARCHAR END"
    first, holds = "concat_ws('_', 'first10', barrier_first10::VARCHAR)", "concat_ws('_', 'holds', barrier_holds::VARCHAR)"
    close = "CASE WHEN coalesce(greatest(0, -vwap_dist_at_close_points), 0) <= 0 THEN 'no_wrong_side_close' WHEN cw <= 0.25 THEN 'wrong_le_1tick' WHEN cw <= 2 THEN 'wrong_1tick_to_2pts' WHEN cw <= 5 THEN 'wrong_2_to_5pts' ELSE 'wrong_gt_5pts' END"
    scopes = [
        ("barrier_only", first), ("barrier_only", holds), ("vwap_early_only", "early_constructive"), ("barrier_vwap_early", f"concat_ws('_', {first}, early_constructive)"), ("barrier_vwap_early", f"concat_ws('_', {holds}, early_constructive)"), ("barrier_late_context", f"concat_ws('_', {holds}, late_constructive)"),
        ("wrong_side_close_bucket", close), ("wrong_side_share_decile", tenth("wrong_side_share")), ("worst_wrong_side_decile", tenth("worst_wrong_side_dist_points")), ("late_decision", "context_transition"),
    ]
    rows = " UNION ALL ".join(f"SELECT '{n}' AS scope, {e} AS bucket, t1_points, t2_points, after_points FROM cy" for n, e in scopes)
    long = " UNION ALL ".join(f"SELECT scope, bucket, '{t}' AS target_name, {t}_points AS points FROM sc WHERE bucket IS NOT NULL" for t in ("t1", "t2", "after"))
    qs = {f"p{round(q * 100)}_target_points": _near("points", q) for q in (0.1, 0.25, 0.75, 0.9)}
    kinds = {"bullish": ">", "bearish": "<", "neutral": "="}
    sql = f"""WITH {_CTX_CTE}, sc AS ({rows}), lg AS ({long}), final AS (SELECT scope, bucket, target_name, count(*)::BIGINT AS sample_size, avg(points) AS avg_target_points, median(points) AS median_target_points, {', '.join(f'{e} AS {n}' for n, e in qs.items())},
  {', '.join(f'count(*) FILTER (WHERE points {o} 0)::BIGINT AS {k}_count, 100.0 * count(*) FILTER (WHERE points {o} 0) / count(*) AS {k}_pct' for k, o in kinds.items())} FROM lg GROUP BY 1, 2, 3)"""
    return rounded_sql(sql, ["avg_target_points", "median_target_points", *qs, *(f"{k}_pct" for k in kinds)], ["scope", "bucket", "target_name", "sample_size", *(f"{k}_count" for k in kinds)])


_RATED = ("retouch_frozen_lag_s", "retouch_rolling_lag_s", "mfe_break_points", "mae_break_points", "fwd_break_h16_points")


def _retouch_rates_sql() -> str:
    whole = _retouch_sql()
    cte = whole[: whole.rindex(" SELECT ")].replace("final AS (SELECT *, CASE WHEN candle_state", "st AS (SELECT *, CASE WHEN candle_state")
    flags = ("retouch_frozen_occurred", "retouch_rolling_occurred", "bias_matches_candle", "bias_matches_macro")
    rate = lambda scope, source: " UNION ALL ".join(f"SELECT '{scope}' AS scope, bucket, '{f}' AS metric, avg({f}::INT) * 100 AS value, count({f})::BIGINT AS sample_size FROM {source} WHERE {f} IS NOT NULL GROUP BY bucket" for f in flags)
    figures = {"mean": "avg({m})", "median": "median({m}::DOUBLE)"} | {f"p{round(q * 100)}": None for q in (0.1, 0.25, 0.75, 0.9)}
    dist = " UNION ALL ".join(f"SELECT 'distribution', bucket, '{m}_{k}', {e.format(m=m) if e else _near(m, int(k[1:]) / 100)}, count({m})::BIGINT FROM sd WHERE {m} IS NOT NULL GROUP BY bucket" for m in _RATED for k, e in figures.items())
    tenth = lambda v: f"SELECT *, '{v}_' || (floor((row_number() OVER (ORDER BY {v}, date) - 1) * 10 / count(*) OVER ())::INT + 1) AS bucket FROM ht WHERE {v} IS NOT NULL AND (SELECT count(DISTINCT {v}) FROM ht) >= 10"
    deciles = ("range_first_points", "vol_share_first")
    sql = f"""{cte}, ht AS (SELECT * FROM st WHERE trigger_state = 'triggered'), sd AS (SELECT 'all' AS bucket, * FROM ht UNION ALL SELECT bias, * FROM ht), {', '.join(f'd{i} AS ({tenth(v)})' for i, v in enumerate(deciles))},
final AS (SELECT 'coverage' AS scope, trigger_state AS bucket, 'days' AS metric, count(*)::DOUBLE AS value, count(*)::BIGINT AS sample_size FROM st GROUP BY 2 UNION ALL {rate('frequency', 'sd')} UNION ALL {dist} UNION ALL {' UNION ALL '.join(rate('decile', f'd{i}') for i in range(len(deciles)))})"""
    return rounded_sql(sql, ["value"], ["scope", "bucket", "metric", "sample_size"])


QUERIES = {
    "vwap_premacro": premacro, "vwap_merged_partials": merged, "vwap_intramacro": intramacro, "vwap_summary": summary, "vwap_barrier_context": context, "vwap_barrier_context_summary": context_summary,
    "vwap_wrong_side_quantiles": context_quantiles, "vwap_decision_table": decisions, "vwap_retouch": retouch, "vwap_retouch_summary": retouch_rates,
}
_Q = ", ".join(f"quantile_cont(value, {q}) AS p{round(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9))
SQL = {
    "vwap_barrier_context_summary": _context_summary_sql(), "vwap_retouch_summary": _retouch_rates_sql(), "vwap_premacro": _PRE, "vwap_merged_partials": _PRE, "vwap_intramacro": _INTRA, "vwap_summary": _summary_sql(), "vwap_retouch": _retouch_sql(),
    "vwap_barrier_context": rounded_sql(f"WITH {_CTX_CTE}, final AS (SELECT * FROM cy)", _CTX_DOUBLES, ["date", *_CTX]),
    "vwap_wrong_side_quantiles": rounded_sql(f"WITH {_CTX_CTE}, l AS (SELECT unnest(['seconds_wrong_side', 'wrong_side_share', 'worst_wrong_side_dist_points']) AS metric, unnest([seconds_wrong_side, wrong_side_share, worst_wrong_side_dist_points]) AS value FROM cy), final AS (SELECT metric, count(value)::BIGINT AS n, {_Q} FROM l WHERE value IS NOT NULL GROUP BY 1)", ["p10", "p25", "p50", "p75", "p90"], ["metric", "n"]),
    "vwap_decision_table": rounded_sql(f"WITH {_CTX_CTE}, final AS (SELECT context_transition, macro_trend_state, count(*)::BIGINT AS n, avg(t2_points) AS mean_points, median(t2_points) AS median_points FROM cy GROUP BY 1, 2)", ["mean_points", "median_points"], ["context_transition", "macro_trend_state", "n"]),
}
