"""Gap queries: daily bars per user, the month as the window."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timecols import wall
from ..operators import flow, gaps
from ..operators.extremes import daily_outcomes
from ..sources.bars import hourly_bars
from ..sources.ticks import order_key, price
from .base import BARS, TICKS, bars, rounded, rounded_sql, ticks
from .extremes import _DAILY

FIRST, LAST, STAGE2, BLOCKS = 3, 28, 15, {"early": 9, "mid": 19, "late": 27}
BY = ["user_id"]


def daily(spark, sf_dir):
    """(user_id, d, OHLCV): a bar per user and day of the month."""
    t = ticks(spark, sf_dir)
    p, at = price(), order_key()
    return t.groupBy("user_id", F.dayofmonth(wall("ts")).alias("d")).agg(F.min_by(p, at).alias("Open"), F.max(p).alias("High"), F.min(p).alias("Low"), F.max_by(p, at).alias("Close"), F.sum("size").alias("Volume"))


def found(spark, sf_dir):
    return gaps.detect_gaps(daily(spark, sf_dir), BY, "d", FIRST, LAST, STAGE2, BLOCKS, 10.0)


_DETECT_COLUMNS = ["user_id", "assigned_at", "bar3_at", "confirmed_at", "fvg_side", "bar2_volume", "is_confirmable", "bar1_direction", "bar2_direction", "bar3_direction", "aligned_count", "neutral_count", "opposite_count", "alignment_bucket", "assigned_stage", "position_block", "gap_size_bucket", "stacked_continuation", "stack_predecessor"]
_DETECT_DOUBLES = ["bar3_high", "bar3_low", "gap_bottom", "gap_top", "gap_size", "entry_price"]


def detect(spark, sf_dir):
    return rounded(found(spark, sf_dir).select(*_DETECT_COLUMNS, *_DETECT_DOUBLES))


_dir = lambda o, c: f"CASE WHEN {c} > {o} THEN 'bullish' WHEN {c} < {o} THEN 'bearish' ELSE 'neutral' END"
_EVENTS = f"""{TICKS}, dd AS (SELECT user_id, day(et)::INT AS d, arg_min(price, (ts, rk)) AS o, max(price) AS hi, min(price) AS lo, arg_max(price, (ts, rk)) AS c, sum(size)::BIGINT AS v FROM et_ticks GROUP BY ALL),
tri AS (SELECT user_id, d AS assigned_at, o, hi, lo, c, v AS bar2_volume, lead(d) OVER w AS bar3_at, lag(o) OVER w AS o1, lag(hi) OVER w AS h1, lag(lo) OVER w AS l1, lag(c) OVER w AS c1, lead(o) OVER w AS o3, lead(hi) OVER w AS bar3_high, lead(lo) OVER w AS bar3_low, lead(c) OVER w AS c3 FROM dd WINDOW w AS (PARTITION BY user_id ORDER BY d)),
g0 AS (SELECT *, CASE WHEN bar3_low > h1 THEN 'bullish' ELSE 'bearish' END AS fvg_side, bar3_at + 1 AS confirmed_at, {_dir('o1', 'c1')} AS bar1_direction, {_dir('o', 'c')} AS bar2_direction, {_dir('o3', 'c3')} AS bar3_direction FROM tri WHERE assigned_at >= {FIRST} AND assigned_at < {LAST} AND (bar3_low > h1 OR bar3_high < l1)),
g1 AS (SELECT *, CASE WHEN fvg_side = 'bullish' THEN h1 ELSE bar3_high END AS gap_bottom, CASE WHEN fvg_side = 'bullish' THEN bar3_low ELSE l1 END AS gap_top, confirmed_at <= {LAST} AS is_confirmable, (bar1_direction = fvg_side)::INT + (bar2_direction = fvg_side)::INT + (bar3_direction = fvg_side)::INT AS aligned_count,
  (bar1_direction = 'neutral')::INT + (bar2_direction = 'neutral')::INT + (bar3_direction = 'neutral')::INT AS neutral_count, CASE WHEN assigned_at < {STAGE2} THEN 'stage_1' ELSE 'stage_2' END AS assigned_stage, CASE WHEN assigned_at <= 9 THEN 'early' WHEN assigned_at <= 19 THEN 'mid' WHEN assigned_at <= 27 THEN 'late' END AS position_block,
  CASE WHEN fvg_side = 'bullish' THEN bar3_high ELSE bar3_low END AS entry_price, coalesce(lag(fvg_side) OVER e = fvg_side AND lag(bar3_at) OVER e = assigned_at, FALSE) AS stacked_continuation, lag(assigned_at) OVER e AS pa FROM g0 WINDOW e AS (PARTITION BY user_id ORDER BY assigned_at)),
events_ AS (SELECT *, gap_top - gap_bottom AS gap_size, 3 - aligned_count - neutral_count AS opposite_count, CASE WHEN neutral_count > 0 THEN 'contains_neutral' WHEN aligned_count = 3 THEN '3_aligned' WHEN aligned_count = 2 THEN '2_aligned_1_opposite' WHEN aligned_count = 1 THEN '1_aligned_2_opposite' ELSE '0_aligned_3_opposite' END AS alignment_bucket,
  CASE WHEN gap_top - gap_bottom < 10 THEN '<10' ELSE '>=10' END AS gap_size_bucket, CASE WHEN stacked_continuation THEN pa END AS stack_predecessor FROM g1)"""


def scanned(spark, sf_dir):
    b = daily(spark, sf_dir)
    return gaps.scan_outcomes(gaps.detect_gaps(b, BY, "d", FIRST, LAST, STAGE2, BLOCKS, 10.0), b, BY, "d", FIRST, LAST, STAGE2)


_SCAN_COLUMNS = ["user_id", "assigned_at", "fvg_side", "first_entry_at", "first_retrace_at", "first_invalidation_at", "success_break_at", "entry_triggered", "retraced", "invalidated", "successful", "retraced_in_stage_2", "invalidated_in_stage_2", "held", "untouched", "held_through_stage_2", "untouched_through_stage_2", "outcome_bucket"]
_SCAN_DOUBLES = ["success_reference_price", "mfe_pct", "mae_pct", "retrace_open", "retrace_high", "retrace_low", "retrace_close"]


def scan(spark, sf_dir):
    return rounded(scanned(spark, sf_dir).select(*_SCAN_COLUMNS, *_SCAN_DOUBLES))


_SCANNED = f"""{_EVENTS}, ww AS (SELECT e.user_id, e.assigned_at, fvg_side, gap_bottom, gap_top, entry_price, d.d AS t, d.o, d.hi, d.lo, d.c, CASE WHEN fvg_side = 'bullish' THEN d.hi >= entry_price ELSE d.lo <= entry_price END AS en, d.hi >= gap_bottom AND d.lo <= gap_top AS re, CASE WHEN fvg_side = 'bullish' THEN d.c < gap_bottom ELSE d.c > gap_top END AS inv
  FROM events_ e JOIN dd d ON d.user_id = e.user_id AND d.d BETWEEN e.confirmed_at AND {LAST} WHERE is_confirmable),
f0 AS (SELECT user_id, assigned_at, min(t) FILTER (WHERE en) AS e0, min(t) FILTER (WHERE re) AS first_retrace_at, min(t) FILTER (WHERE inv) AS first_invalidation_at, bool_or(re AND t >= {STAGE2}) AS r2, bool_or(inv AND t >= {STAGE2}) AS i2, arg_min(o, t) FILTER (WHERE re) AS retrace_open, arg_min(hi, t) FILTER (WHERE re) AS retrace_high, arg_min(lo, t) FILTER (WHERE re) AS retrace_low, arg_min(c, t) FILTER (WHERE re) AS retrace_close,
  any_value(fvg_side) AS side FROM ww GROUP BY 1, 2),
f1 AS (SELECT *, CASE WHEN first_retrace_at IS NULL OR first_invalidation_at IS NULL OR e0 <= greatest(first_retrace_at, first_invalidation_at) THEN e0 END AS first_entry_at, CASE WHEN side = 'bullish' THEN retrace_high ELSE retrace_low END AS success_reference_price FROM f0),
f2 AS (SELECT ww.user_id, ww.assigned_at, min(t) FILTER (WHERE t > first_retrace_at AND CASE WHEN side = 'bullish' THEN hi > success_reference_price ELSE lo < success_reference_price END) AS success_break_at, max((hi - entry_price) / entry_price) FILTER (WHERE t > first_entry_at) AS up, max((entry_price - lo) / entry_price) FILTER (WHERE t > first_entry_at) AS dn FROM ww JOIN f1 ON f1.user_id = ww.user_id AND f1.assigned_at = ww.assigned_at GROUP BY 1, 2),
scanned AS (SELECT e.*, first_entry_at, first_retrace_at, first_invalidation_at, success_break_at, success_reference_price, retrace_open, retrace_high, retrace_low, retrace_close, first_entry_at IS NOT NULL AS entry_triggered, first_retrace_at IS NOT NULL AS retraced, first_invalidation_at IS NOT NULL AS invalidated, success_break_at IS NOT NULL AS successful, coalesce(r2, FALSE) AS retraced_in_stage_2, coalesce(i2, FALSE) AS invalidated_in_stage_2,
  is_confirmable AND first_invalidation_at IS NULL AS held, is_confirmable AND first_retrace_at IS NULL AS untouched, is_confirmable AND NOT coalesce(i2, FALSE) AS held_through_stage_2, is_confirmable AND NOT coalesce(r2, FALSE) AS untouched_through_stage_2, CASE WHEN e.fvg_side = 'bullish' THEN up ELSE dn END AS mfe_pct, CASE WHEN e.fvg_side = 'bullish' THEN dn ELSE up END AS mae_pct,
  CASE WHEN NOT is_confirmable THEN 'unconfirmable' WHEN first_invalidation_at IS NOT NULL THEN 'invalidated' WHEN first_retrace_at IS NOT NULL THEN 'retraced_held' ELSE 'untouched_held' END AS outcome_bucket FROM events_ e LEFT JOIN f1 ON f1.user_id = e.user_id AND f1.assigned_at = e.assigned_at LEFT JOIN f2 ON f2.user_id = e.user_id AND f2.assigned_at = e.assigned_at)"""


def enriched(spark, sf_dir):
    t = ticks(spark, sf_dir)
    d = flow.delta(t, ["user_id", F.dayofmonth(wall("ts")).alias("bucket_index")])
    return gaps.enrich_with_delta(scanned(spark, sf_dir), d, BY, "bar3_at")


def delta_enriched(spark, sf_dir):
    return rounded(enriched(spark, sf_dir).select("user_id", "assigned_at", "volume_delta", "aligned_volume_delta", "abs_volume_delta", "aligned_delta_imbalance", "aligned_delta_imbalance_quantile", "abs_delta_imbalance_quantile"))


_quant = lambda v: f"CASE WHEN {v} IS NOT NULL THEN floor((row_number() OVER (PARTITION BY {v} IS NULL ORDER BY {v}, user_id, assigned_at) - 1) * 5 / count({v}) OVER ())::INT + 1 END"
_qlabel = lambda q: f"CASE {q} WHEN 1 THEN 'q1_lowest' WHEN 5 THEN 'q5_highest' ELSE 'q' || {q} END"
_ENRICHED = f"""{_SCANNED}, fl AS (SELECT user_id, day(et)::INT AS i, sum(CASE side WHEN 2 THEN size WHEN 1 THEN -size ELSE 0 END)::BIGINT AS volume_delta, sum(CASE side WHEN 2 THEN size WHEN 1 THEN -size ELSE 0 END) / nullif(sum(CASE WHEN side > 0 THEN size ELSE 0 END), 0)::DOUBLE AS imb FROM et_ticks GROUP BY ALL),
en0 AS (SELECT s.*, volume_delta, CASE WHEN fvg_side = 'bullish' THEN volume_delta ELSE -volume_delta END AS aligned_volume_delta, abs(volume_delta) AS abs_volume_delta, CASE WHEN fvg_side = 'bullish' THEN imb ELSE -imb END AS aligned_delta_imbalance, abs(imb) AS abs_delta_imbalance FROM scanned s LEFT JOIN fl ON fl.user_id = s.user_id AND fl.i = s.bar3_at),
en1 AS (SELECT *, {_quant('aligned_delta_imbalance')} AS qa, {_quant('abs_delta_imbalance')} AS qb FROM en0), enriched AS (SELECT *, CASE WHEN qa IS NOT NULL THEN {_qlabel('qa')} END AS aligned_delta_imbalance_quantile, CASE WHEN qb IS NOT NULL THEN {_qlabel('qb')} END AS abs_delta_imbalance_quantile FROM en1)"""


def scopes(spark, sf_dir):
    return rounded(gaps.scope_summary(scanned(spark, sf_dir)))


def _scopes_sql() -> str:
    part = lambda name, cols, where: f"SELECT '{name}' AS summary_scope, fvg_side, count(*)::BIGINT AS n_total, count(*) FILTER (WHERE is_confirmable)::BIGINT AS n_confirmable, " + ", ".join(f"count(*) FILTER (WHERE {c}) / nullif(count(*) FILTER (WHERE is_confirmable), 0)::DOUBLE AS {n}_rate" for n, c in zip(("retrace", "invalidation", "hold", "untouched"), cols)) + f" FROM scanned {where} GROUP BY fvg_side"
    whole, late = ("retraced", "invalidated", "held", "untouched"), ("retraced_in_stage_2", "invalidated_in_stage_2", "held_through_stage_2", "untouched_through_stage_2")
    sql = f"WITH {_SCANNED}, final AS ({part('whole_window', whole, '')} UNION ALL {part('stage_2', late, '')} UNION ALL {part('stage_1_created', whole, chr(87) + 'HERE assigned_stage = ' + chr(39) + 'stage_1' + chr(39))})"
    return rounded_sql(sql, ["retrace_rate", "invalidation_rate", "hold_rate", "untouched_rate"], ["summary_scope", "fvg_side", "n_total", "n_confirmable"])


def outcome_rates(spark, sf_dir):
    return rounded(gaps.grouped_summary(gaps.with_volume_bucket(scanned(spark, sf_dir), ["user_id", "assigned_at"]), gaps.OUTCOME_SCOPES, "outcome"))


def entry_excursions(spark, sf_dir):
    return rounded(gaps.grouped_summary(enriched(spark, sf_dir), gaps.ENTRY_SCOPES, "entry"))


def success_context(spark, sf_dir):
    return rounded(gaps.grouped_summary(enriched(spark, sf_dir), gaps.SUCCESS_SCOPES, "success"))


def _grouped_sql(scopes_: dict, kind: str) -> str:
    columns = list(dict.fromkeys(c for cs in scopes_.values() for c in cs))
    source = "src"
    conf = "count(*) FILTER (WHERE is_confirmable)"
    if kind == "outcome":
        figures = [f"count(*) FILTER (WHERE {c}) / nullif({conf}, 0)::DOUBLE AS {n}_rate" for n, c in (("hold", "held"), ("retrace", "retraced"), ("untouched", "untouched"), ("invalidation", "invalidated"))]
        doubles, ints = ["hold_rate", "retrace_rate", "untouched_rate", "invalidation_rate"], []
    else:
        flag = "entry_triggered" if kind == "entry" else "successful"
        qs = ((0.75, "p75"), (0.9, "p90")) if kind == "entry" else ((0.75, "p75"),)
        figures, doubles = [], []
        for m in ("mfe", "mae"):
            f = f"FILTER (WHERE {flag})"
            figures += [f"avg({m}_pct) {f} AS {m}_pct_mean", f"median({m}_pct) {f} AS {m}_pct_median", *(f"quantile_cont({m}_pct, {q}) {f} AS {m}_pct_{n}" for q, n in qs)]
            doubles += [f"{m}_pct_mean", f"{m}_pct_median", *(f"{m}_pct_{n}" for _, n in qs)]
        n, r = f"count(*) FILTER (WHERE {flag})", "count(*) FILTER (WHERE retraced)"
        if kind == "entry":
            figures += [f"{n}::BIGINT AS n_triggered", f"{n} / nullif({conf}, 0)::DOUBLE AS entry_trigger_rate"]
            doubles, ints = [*doubles, "entry_trigger_rate"], ["n_triggered"]
        else:
            figures += [f"{n}::BIGINT AS n_successful", f"{r}::BIGINT AS n_retraced", f"{r} / nullif({conf}, 0)::DOUBLE AS retrace_rate", f"{n} / nullif({r}, 0)::DOUBLE AS success_after_retrace_rate", f"{n} / nullif({conf}, 0)::DOUBLE AS successful_share_of_confirmable"]
            doubles, ints = [*doubles, "retrace_rate", "success_after_retrace_rate", "successful_share_of_confirmable"], ["n_successful", "n_retraced"]
    parts = []
    for name, cs in scopes_.items():
        where = " AND ".join(f"{c} IS NOT NULL" for c in cs if c.endswith("_quantile"))
        kinds = {"assigned_at": "INT", "stacked_continuation": "BOOLEAN"}
        keys = ", ".join(c if c in cs else f"NULL::{kinds.get(c, 'VARCHAR')} AS {c}" for c in columns)
        parts.append(f"SELECT '{name}' AS summary_scope, {keys + ', ' if keys else ''}count(*)::BIGINT AS n_total, {conf}::BIGINT AS n_confirmable, {', '.join(figures)} FROM {source} {'WHERE ' + where if where else ''} {'GROUP BY ' + ', '.join(cs) if cs else ''}")
    volume = "'q' || (floor((row_number() OVER (ORDER BY bar2_volume, user_id, assigned_at) - 1) * 4 / count(*) OVER ())::INT + 1) AS bar2_volume_bucket"
    cte = f"{_SCANNED}, src AS (SELECT *, {volume} FROM scanned)" if kind == "outcome" else f"{_ENRICHED}, src AS (SELECT * FROM enriched)"
    return rounded_sql(f"WITH {cte}, final AS ({' UNION ALL '.join(parts)})", doubles, ["summary_scope", *columns, "n_total", "n_confirmable", *ints])


def everything(spark, sf_dir):
    return rounded(gaps.all_summaries(enriched(spark, sf_dir), ["user_id", "assigned_at"]))


def profiles(spark, sf_dir):
    entry = gaps.grouped_summary(enriched(spark, sf_dir), gaps.ENTRY_SCOPES, "entry")
    return rounded(gaps.profile_rows(entry, {"entry_abs_quantile": "overall", "entry_block_abs_quantile": "by_block"}))


def counts(spark, sf_dir):
    return gaps.outcome_counts(scanned(spark, sf_dir), ["fvg_side", "assigned_stage"])


def positions(spark, sf_dir):
    return rounded(gaps.position_tables(scanned(spark, sf_dir), ["user_id", "assigned_at"]))


def contexts(spark, sf_dir):
    return gaps.hourly_context(hourly_bars(bars(spark, sf_dir), (12, 13, 14), 1))


def hourly(spark, sf_dir):
    return rounded(contexts(spark, sf_dir))


def cohorts(spark, sf_dir):
    macro = daily_outcomes(bars(spark, sf_dir), "date", "h", (15, 19), (20, 21)).select("date", "macro_dir_points", "macro_range_points")
    return rounded(gaps.context_cohorts(gaps.join_outcomes(contexts(spark, sf_dir), macro)))


_HOURLY = f"""{BARS}, hw AS (SELECT date, max(o) FILTER (WHERE h = 13) AS pm_open, max(c) FILTER (WHERE h = 14) AS pm_close, max(hi) FILTER (WHERE h IN (13, 14)) AS pm_high, min(lo) FILTER (WHERE h IN (13, 14)) AS pm_low, max(hi) FILTER (WHERE h = 12) AS ah, min(lo) FILTER (WHERE h = 12) AS al, max(hi) FILTER (WHERE h = 14) AS ch, min(lo) FILTER (WHERE h = 14) AS cl FROM bars WHERE h IN (12, 13, 14) GROUP BY date HAVING count(*) = 3),
hx AS (SELECT *, pm_high - pm_low AS pm_range, pm_close - pm_open AS pm_dir_points, coalesce(sign(pm_close - pm_open), 0)::INT AS pm_dir_sign, (pm_close - pm_low) / nullif(pm_high - pm_low, 0) AS pm_close_pos, CASE WHEN ah < cl THEN 'bullish' WHEN al > ch THEN 'bearish' ELSE 'none' END AS fvg_direction, CASE WHEN ah < cl THEN cl - ah WHEN al > ch THEN al - ch ELSE 0 END AS fvg_size_points FROM hw),
hc AS (SELECT *, abs(pm_dir_points) / nullif(pm_range, 0) AS pm_body_to_range, (pm_high - greatest(pm_open, pm_close)) / nullif(pm_range, 0) AS pm_upper_wick_share, (least(pm_open, pm_close) - pm_low) / nullif(pm_range, 0) AS pm_lower_wick_share, fvg_direction <> 'none' AS has_fvg, fvg_size_points / nullif(pm_range, 0) AS fvg_size_pct_of_pm_range,
  CASE WHEN pm_dir_points > 0 AND pm_close_pos >= 0.6 THEN 'bullish' WHEN pm_dir_points < 0 AND pm_close_pos <= 0.4 THEN 'bearish' ELSE 'neutral' END AS imbalance_direction FROM hx)"""

def _cohorts_sql() -> str:
    cohorts_ = {"fvg_direction": "fvg_direction", "imbalance_direction": "imbalance_direction", "fvg_x_imbalance": "fvg_direction || '|' || imbalance_direction", "fvg_size_bucket": "size_bucket"}
    rows = " UNION ALL ".join(f"SELECT '{n}' AS cohort, {e} AS bucket, md, mr FROM sb" for n, e in cohorts_.items())
    near = lambda q: f"list_sort(list(fvg_size_points) FILTER (WHERE fvg_size_points > 0))[floor({q} * (count(*) FILTER (WHERE fvg_size_points > 0) - 1) + 0.5)::INT + 1]"
    sql = f"""WITH {_HOURLY}, {_DAILY}, jo AS (SELECT hc.*, macro_dir_points AS md, macro_range_points AS mr FROM hc JOIN daily ON daily.date = hc.date WHERE coalesce(macro_dir_points, 0) <> 0),
cu AS (SELECT count(*) FILTER (WHERE fvg_size_points > 0) AS m, {near('1 / 3.0::DOUBLE')} AS a, {near('2 / 3.0::DOUBLE')} AS b FROM jo),
sb AS (SELECT jo.*, CASE WHEN fvg_size_points <= 0 THEN 'none' WHEN m < 3 THEN 'has_fvg' WHEN fvg_size_points <= a THEN 'small' WHEN fvg_size_points <= b THEN 'medium' ELSE 'large' END AS size_bucket FROM jo, cu), un AS ({rows}),
final AS (SELECT cohort, bucket, count(*)::BIGINT AS n, count(*) FILTER (WHERE md > 0)::BIGINT AS macro_bull_n, count(*) FILTER (WHERE md < 0)::BIGINT AS macro_bear_n, avg(md) AS avg_macro_dir_points, median(md) AS median_macro_dir_points, avg(mr) AS avg_macro_range_points, median(mr) AS median_macro_range_points, avg((md > 0)::INT) AS macro_bull_rate, avg((md < 0)::INT) AS macro_bear_rate FROM un GROUP BY 1, 2)"""
    return rounded_sql(sql, ["avg_macro_dir_points", "median_macro_dir_points", "avg_macro_range_points", "median_macro_range_points", "macro_bull_rate", "macro_bear_rate"], ["cohort", "bucket", "n", "macro_bull_n", "macro_bear_n"])


def _profiles_sql() -> str:
    inner = _grouped_sql({k: gaps.ENTRY_SCOPES[k] for k in ("entry_abs_quantile", "entry_block_abs_quantile")}, "entry")
    figures = [f"{m}_pct_{n}" for m in ("mfe", "mae") for n in ("mean", "median", "p75", "p90")]
    label = "CASE summary_scope WHEN 'entry_abs_quantile' THEN 'overall' ELSE 'by_block' END AS profile_type"
    return rounded_sql(inner[: inner.rindex(" SELECT ")], figures, [label, "summary_scope", "n_total", "n_triggered", "position_block", "abs_delta_imbalance_quantile", "NULL::INT AS assigned_at"])


def _everything_sql() -> str:
    parts = [_scopes_sql(), _grouped_sql(gaps.OUTCOME_SCOPES, "outcome"), _grouped_sql(gaps.ENTRY_SCOPES, "entry"), _grouped_sql(gaps.SUCCESS_SCOPES, "success")]
    return " UNION ALL BY NAME ".join(f"SELECT * FROM ({q})" for q in parts)


QUERIES = {
    "gap_events": detect, "gap_outcomes": scan, "gap_delta_dominance": delta_enriched, "gap_scope_summary": scopes, "gap_outcome_rates": outcome_rates, "gap_entry_excursions": entry_excursions, "gap_success_context": success_context,
    "gap_all_summaries": everything, "gap_excursion_profiles": profiles, "gap_outcome_counts": counts, "gap_position_tables": positions, "hourly_gap_context": hourly, "hourly_gap_cohorts": cohorts,
}
SQL = {
    "gap_events": rounded_sql(f"WITH {_EVENTS}, final AS (SELECT * FROM events_)", _DETECT_DOUBLES, _DETECT_COLUMNS),
    "gap_outcomes": rounded_sql(f"WITH {_SCANNED}, final AS (SELECT * FROM scanned)", _SCAN_DOUBLES, _SCAN_COLUMNS),
    "gap_delta_dominance": rounded_sql(f"WITH {_ENRICHED}, final AS (SELECT * FROM enriched)", ["aligned_delta_imbalance"], ["user_id", "assigned_at", "volume_delta", "aligned_volume_delta", "abs_volume_delta", "aligned_delta_imbalance_quantile", "abs_delta_imbalance_quantile"]),
    "gap_all_summaries": _everything_sql(), "gap_scope_summary": _scopes_sql(), "hourly_gap_cohorts": _cohorts_sql(), "gap_excursion_profiles": _profiles_sql(),
    "gap_outcome_rates": _grouped_sql(gaps.OUTCOME_SCOPES, "outcome"), "gap_entry_excursions": _grouped_sql(gaps.ENTRY_SCOPES, "entry"), "gap_success_context": _grouped_sql(gaps.SUCCESS_SCOPES, "success"),
    "gap_outcome_counts": f"WITH {_SCANNED} SELECT fvg_side, assigned_stage, outcome_bucket, count(*)::BIGINT AS n FROM scanned GROUP BY ALL",
    "gap_position_tables": f"WITH {_SCANNED}, p AS (SELECT *, floor((row_number() OVER (ORDER BY bar2_volume, user_id, assigned_at) - 1) * 4 / count(*) OVER ())::INT + 1 AS q FROM scanned) SELECT assigned_at, round(avg(bar2_volume), 6) + 0.0 AS mean_bar2_volume, {', '.join(f'count(*) FILTER (WHERE q = {i})::BIGINT AS n_q{i}' for i in (1, 2, 3, 4))} FROM p GROUP BY 1",
    "hourly_gap_context": rounded_sql(f"WITH {_HOURLY}, final AS (SELECT * FROM hc)", ["pm_open", "pm_close", "pm_high", "pm_low", "pm_range", "pm_dir_points", "pm_close_pos", "pm_body_to_range", "pm_upper_wick_share", "pm_lower_wick_share", "fvg_size_points", "fvg_size_pct_of_pm_range"], ["date", "pm_dir_sign", "fvg_direction", "has_fvg", "imbalance_direction"]),
}
