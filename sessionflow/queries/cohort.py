"""Delta studies, cohort statistics and economic events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar, cohort, extremes, flow
from ..plans import studies
from ..sources.news import normalize_news
from .base import BARS, DELTA, END, START, TICKS, bars, rounded, rounded_sql, ticks
from .extremes import _DAILY, SPANS, _features_cte, daily
from .flow import _paths_sql

SESSIONS = {"eth_pre_rth": (0, 14), "rth_pre_macro": (15, 17), "day_pre_macro": (0, 17)}
FINE = {"k359_00_59": (10, 11), "k359_00_39": (10, 10), "k359_40_49": (11, 11)}
PREDICTORS = ["eth_pre_rth", "rth_pre_macro", "macro_pre59"]


def _inputs(spark, sf_dir):
    t = ticks(spark, sf_dir)
    globex = flow.globex_delta(t, 60)
    macro = flow.window_delta(t, START, END, 3600).withColumnRenamed("bucket_index", "macro_minute_index")
    buckets = flow.window_delta(t, START, END, 1800).withColumnRenamed("bucket_index", "macro_bucket_index")
    return globex, macro, buckets


def reversal_study(spark, sf_dir):
    g, m, b = _inputs(spark, sf_dir)
    return studies.delta_reversal(g, m, b, SESSIONS, last=5, first=0, targets=FINE, singles=(10, 11))


def reversal(spark, sf_dir):
    s = reversal_study(spark, sf_dir)
    return rounded(s.select(*_REVERSAL, "k359_delta_imbalance", "eth_rth_pre_35950_delta_imbalance"))


_NAMES = ["k359", "macro_pre59", "eth_pre_rth", "rth_pre_macro", "day_pre_macro", "rth_plus_macro_pre59", "day_plus_macro_pre59", "k359_00_39", "k359_bucket_11", "eth_rth_pre_35940", "rth_pre_35940", "eth_rth_pre_35950"]
_REVERSAL = ["trade_date_et", *(f"{n}_volume_delta" for n in _NAMES), "k359_sign", "rth_pre_macro_sign", "rth_pre_macro_vs_k359_has_signal", "rth_pre_macro_opposes_k359", "macro_pre59_same_as_k359_00_39"]


def _study_cte() -> str:
    w = lambda n, i, a, b: ", ".join(f"sum({m}) FILTER (WHERE {i} BETWEEN {a} AND {b})::BIGINT AS {n}_{c}" for m, c in (("volume_delta", "volume_delta"), ("classified_size", "classified_size")))
    add = lambda x, y, z: ", ".join(f"coalesce({x}_{c}, 0) + coalesce({y}_{c}, 0) AS {z}_{c}" for c in ("volume_delta", "classified_size"))
    return f"""{TICKS}, gx AS (SELECT CASE WHEN sec >= 64800 THEN (date + 1)::DATE ELSE date END AS day, (CASE WHEN sec >= 64800 THEN sec - 64800 ELSE sec + 21600 END // 3600)::INT AS i, side, size FROM et_ticks WHERE sec < 61200 OR sec >= 64800),
gd AS (SELECT day, i, {DELTA} FROM gx GROUP BY ALL), md AS (SELECT date AS day, h - 12 AS i, {DELTA} FROM et_ticks WHERE sec >= {START} AND sec < {END} GROUP BY ALL), bd AS (SELECT date AS day, ((sec - {START}) // 1800)::INT AS i, {DELTA} FROM et_ticks WHERE sec >= {START} AND sec < {END} GROUP BY ALL),
sa AS (SELECT day, {w('k359', 'i', 5, 5)}, {w('macro_pre59', 'i', 0, 4)} FROM md GROUP BY day HAVING count(*) FILTER (WHERE i = 5) > 0),
sg AS (SELECT day, {w('eth_pre_rth', 'i', 0, 14)}, {w('rth_pre_macro', 'i', 15, 17)}, {w('day_pre_macro', 'i', 0, 17)} FROM gd GROUP BY day),
sb AS (SELECT day, {w('k359_00_39', 'i', 10, 10)}, {w('k359_40_49', 'i', 11, 11)}, {w('k359_bucket_11', 'i', 11, 11)} FROM bd GROUP BY day),
s0 AS (SELECT sa.day AS trade_date_et, sa.* EXCLUDE (day), sg.* EXCLUDE (day), sb.* EXCLUDE (day) FROM sa LEFT JOIN sg ON sg.day = sa.day LEFT JOIN sb ON sb.day = sa.day),
s1 AS (SELECT *, {add('rth_pre_macro', 'macro_pre59', 'rth_plus_macro_pre59')}, {add('day_pre_macro', 'macro_pre59', 'day_plus_macro_pre59')} FROM s0),
s2 AS (SELECT *, {add('day_plus_macro_pre59', 'k359_00_39', 'eth_rth_pre_35940')}, {add('rth_plus_macro_pre59', 'k359_00_39', 'rth_pre_35940')} FROM s1),
study AS (SELECT *, {add('eth_rth_pre_35940', 'k359_40_49', 'eth_rth_pre_35950')} FROM s2)"""


_s = lambda c: f"coalesce(sign({c}_volume_delta), 0)::INT"
_REVERSAL_SQL = rounded_sql(
    f"""WITH {_study_cte()}, final AS (SELECT *, {_s('k359')} AS k359_sign, {_s('rth_pre_macro')} AS rth_pre_macro_sign, {_s('k359')} <> 0 AND {_s('rth_pre_macro')} <> 0 AS rth_pre_macro_vs_k359_has_signal, {_s('k359')} * {_s('rth_pre_macro')} < 0 AS rth_pre_macro_opposes_k359, {_s('macro_pre59')} * {_s('k359_00_39')} > 0 AS macro_pre59_same_as_k359_00_39,
  k359_volume_delta / nullif(k359_classified_size, 0)::DOUBLE AS k359_delta_imbalance, eth_rth_pre_35950_volume_delta / nullif(eth_rth_pre_35950_classified_size, 0)::DOUBLE AS eth_rth_pre_35950_delta_imbalance FROM study)""",
    ["k359_delta_imbalance", "eth_rth_pre_35950_delta_imbalance"], _REVERSAL,
)


def impulse(spark, sf_dir):
    g, _, b = _inputs(spark, sf_dir)
    s = studies.delta_impulse(g, b, {"eth_only_pre350": (0, 14), "rth_only_pre350": (15, 17), "eth_rth_pre350": (0, 17)}, {"k350_00_09": (0, 1), "k350_00_29": (0, 5)}, 2)
    return rounded(s)


def _impulse_sql() -> str:
    targets = {"k350_00_09": (0, 1), "k350_00_29": (0, 5), "k350_bucket_0": (0, 0), "k350_bucket_1": (1, 1)}
    sessions = {"eth_only_pre350": (0, 14), "rth_only_pre350": (15, 17), "eth_rth_pre350": (0, 17)}
    measures = ("volume_delta", "classified_size", "total_size")
    cells = lambda ws: ", ".join(f"sum({m}) FILTER (WHERE i BETWEEN {a} AND {b})::BIGINT AS {w}_{m}" for w, (a, b) in ws.items() for m in measures)
    both = [*targets, *sessions]
    imbalance = ", ".join(f"{w}_volume_delta / nullif({w}_classified_size, 0)::DOUBLE AS {w}_delta_imbalance" for w in both)
    signs = ", ".join(f"coalesce(sign({w}_volume_delta), 0)::INT AS {w}_sign" for w in both)
    flags = ", ".join(f"{p}_sign <> 0 AND {t}_sign <> 0 AS {p}_vs_{t}_has_signal, {p}_sign * {t}_sign < 0 AS {p}_opposes_{t}, {p}_sign * {t}_sign > 0 AS {p}_same_as_{t}" for p in sessions for t in targets)
    sql = f"""WITH {_study_cte()}, ta AS (SELECT day, {cells(targets)} FROM bd WHERE i BETWEEN 0 AND 5 GROUP BY day), se AS (SELECT day, {cells(sessions)} FROM gd GROUP BY day),
j AS (SELECT ta.day AS trade_date_et, ta.* EXCLUDE (day), se.* EXCLUDE (day) FROM ta LEFT JOIN se ON se.day = ta.day), k AS (SELECT *, {imbalance}, {signs} FROM j), final AS (SELECT *, {flags} FROM k)"""
    others = ["trade_date_et", *(f"{w}_{m}" for w in both for m in (*measures, "sign")), *(n for p in sessions for t in targets for n in (f"{p}_vs_{t}_has_signal", f"{p}_opposes_{t}", f"{p}_same_as_{t}"))]
    return rounded_sql(sql, [f"{w}_delta_imbalance" for w in both], others)


def long(spark, sf_dir):
    return cohort.pair_long(reversal_study(spark, sf_dir), "trade_date_et", PREDICTORS, ["k359", "k359_00_39"])


def pair_signs(spark, sf_dir):
    return rounded(cohort.sign_rows(long(spark, sf_dir)))


def pair_deciles(spark, sf_dir):
    return rounded(cohort.decile_rows(long(spark, sf_dir), "trade_date_et"))


def pair_tails(spark, sf_dir):
    return rounded(cohort.tail_rows(long(spark, sf_dir)))


def pair_contexts(spark, sf_dir):
    return rounded(cohort.condition_rows(reversal_study(spark, sf_dir), "trade_date_et", "rth_pre_macro", "macro_pre59", "rth_plus_macro_pre59", ["k359"]))


def reversal_summary(spark, sf_dir):
    return rounded(cohort.summaries(reversal_study(spark, sf_dir), "trade_date_et", PREDICTORS, ["k359", "k359_00_39"], [("rth_pre_macro", "macro_pre59", "rth_plus_macro_pre59")], against="k359"))


def _pairs(source: str = "study", predictors=PREDICTORS, targets=("k359", "k359_00_39"), keep: str = "") -> str:
    return " UNION ALL ".join(f"SELECT trade_date_et{keep}, '{p}' AS predictor, {p}_volume_delta::DOUBLE AS x, '{t}' AS target, {t}_volume_delta::DOUBLE AS y FROM {source}" for p in predictors for t in targets)


_near = lambda v, q: f"list_sort(list({v}) FILTER (WHERE {v} IS NOT NULL))[floor({q} * (count({v}) - 1) + 0.5)::INT + 1]"
_PAIR = f"""count(*)::BIGINT AS n_days, count(*) FILTER (WHERE coalesce(sign(x), 0) <> 0 AND coalesce(sign(y), 0) <> 0)::BIGINT AS n_signal_days, count(*) FILTER (WHERE x * y < 0)::BIGINT AS opposite_count, count(*) FILTER (WHERE x * y > 0)::BIGINT AS same_count, count(*) FILTER (WHERE coalesce(x, 0) = 0)::BIGINT AS zero_predictor_count, count(*) FILTER (WHERE coalesce(y, 0) = 0)::BIGINT AS zero_target_count,
  avg(x) AS mean_predictor_delta, median(x) AS median_predictor_delta, avg(y) AS mean_target_delta, median(y) AS median_target_delta, {_near('y', 0.25)} AS target_p25, {_near('y', 0.75)} AS target_p75, CASE WHEN count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) > 1 AND min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS pearson,
  count(*) FILTER (WHERE x * y < 0) / nullif(count(*) FILTER (WHERE coalesce(sign(x), 0) <> 0 AND coalesce(sign(y), 0) <> 0), 0)::DOUBLE AS opposite_rate, count(*) FILTER (WHERE x * y > 0) / nullif(count(*) FILTER (WHERE coalesce(sign(x), 0) <> 0 AND coalesce(sign(y), 0) <> 0), 0)::DOUBLE AS same_rate"""
_PAIR_INTS = ["n_days", "n_signal_days", "opposite_count", "same_count", "zero_predictor_count", "zero_target_count"]
_PAIR_DOUBLES = ["mean_predictor_delta", "median_predictor_delta", "mean_target_delta", "median_target_delta", "target_p25", "target_p75", "pearson", "opposite_rate", "same_rate"]


def _signed_sql(cte: str | None = None, pairs: str | None = None) -> str:
    more, doubles = [], []
    for n, c in (("positive", "x > 0"), ("negative", "x < 0")):
        more += [f"avg(y) FILTER (WHERE {c}) AS mean_target_when_{n}", f"median(y) FILTER (WHERE {c}) AS median_target_when_{n}", *(f"list_sort(list(y) FILTER (WHERE {c} AND y IS NOT NULL))[floor({q} * (count(y) FILTER (WHERE {c}) - 1) + 0.5)::INT + 1] AS target_{k}_when_{n}" for q, k in ((0.25, "p25"), (0.75, "p75")))]
        doubles += [f"mean_target_when_{n}", f"median_target_when_{n}", f"target_p25_when_{n}", f"target_p75_when_{n}"]
    return rounded_sql(f"WITH {cte or _study_cte()}, lg AS ({pairs or _pairs()}), final AS (SELECT predictor, target, {_PAIR}, {', '.join(more)} FROM lg GROUP BY 1, 2)", [*_PAIR_DOUBLES, *doubles], ["predictor", "target", *_PAIR_INTS])


def _deciles_sql(cte: str | None = None, pairs: str | None = None, by: str = "x", distinct: int = 0) -> str:
    enough = f"count(*) OVER p >= 10 AND (SELECT count(DISTINCT {by}) FROM lg z WHERE z.predictor = lg.predictor AND z.target = lg.target) >= {distinct}"
    return rounded_sql(
        f"WITH {cte or _study_cte()}, lg AS ({pairs or _pairs()}), dc AS (SELECT *, CASE WHEN {enough} THEN floor((row_number() OVER (PARTITION BY predictor, target ORDER BY {by}, trade_date_et) - 1) * 10 / count(*) OVER p)::INT + 1 END AS predictor_decile FROM lg WHERE {by} IS NOT NULL WINDOW p AS (PARTITION BY predictor, target)), final AS (SELECT predictor, target, predictor_decile, {_PAIR} FROM dc WHERE predictor_decile IS NOT NULL GROUP BY 1, 2, 3)",
        _PAIR_DOUBLES, ["predictor", "target", "predictor_decile", *_PAIR_INTS],
    )


_DECILES = _deciles_sql()


def _tails_sql(cte: str | None = None, pairs: str | None = None) -> str:
    tails = {"positive_top_20": (1, 0.8), "positive_top_10": (1, 0.9), "negative_bottom_20": (-1, 0.2), "negative_bottom_10": (-1, 0.1)}
    cuts = ", ".join(f"list_sort(list(x) FILTER (WHERE x * {s} > 0))[floor({q} * (count(*) FILTER (WHERE x * {s} > 0) - 1) + 0.5)::INT + 1] AS c_{n}" for n, (s, q) in tails.items())
    rows = " UNION ALL ".join(f"SELECT lg.*, '{n}' AS tail FROM lg JOIN cu ON cu.predictor = lg.predictor AND cu.target = lg.target WHERE x * {s} > 0 AND (x - c_{n}) * {s} >= 0" for n, (s, _) in tails.items())
    return rounded_sql(f"WITH {cte or _study_cte()}, lg AS ({pairs or _pairs()}), cu AS (SELECT predictor, target, {cuts} FROM lg GROUP BY 1, 2), tl AS ({rows}), final AS (SELECT predictor, target, tail, {_PAIR} FROM tl GROUP BY 1, 2, 3)", _PAIR_DOUBLES, ["predictor", "target", "tail", *_PAIR_INTS])


_context_sql = lambda targets: rounded_sql(f"WITH {_study_cte()}, ma AS (SELECT *, CASE WHEN rth_pre_macro_volume_delta * macro_pre59_volume_delta > 0 THEN 'macro_pre59_same_as_rth_pre_macro' WHEN rth_pre_macro_volume_delta * macro_pre59_volume_delta < 0 THEN 'macro_pre59_opposes_rth_pre_macro' END AS condition FROM study), lg AS ({_pairs('ma', ['rth_plus_macro_pre59'], targets, ', condition')}), final AS (SELECT condition, predictor, target, {_PAIR} FROM lg WHERE condition IS NOT NULL GROUP BY 1, 2, 3)", _PAIR_DOUBLES, ["condition", "predictor", "target", *_PAIR_INTS])
_CONTEXT = _context_sql(['k359'])


def _summaries_sql(cte: str, predictors: list[str], targets: list[str], imbalance: str, context: str = "", against: str = "") -> str:
    """The ragged union of the tables above over a study; ``imbalance`` is the SQL of a predictor's, with {p} for its name."""
    row = lambda p, t: f"SELECT trade_date_et, '{p}' AS predictor, {p}_volume_delta::DOUBLE AS x, {imbalance.format(p=p)} AS imb, '{t}' AS target, {t}_volume_delta::DOUBLE AS y FROM study"
    pairs = " UNION ALL ".join(row(p, t) for p in predictors for t in targets)
    parts = {"target_sign": _signed_sql(cte, pairs), "target_raw_decile": _deciles_sql(cte, pairs), "target_imbalance_decile": _deciles_sql(cte, pairs, "imb"), "target_tail": _tails_sql(cte, pairs)}
    out = [f"SELECT '{n}' AS summary_type, * FROM ({q})" for n, q in (parts | ({"context": context} if context else {})).items()]
    if against:
        alone = " UNION ALL ".join(row(p, against) for p in predictors)
        out.append(f"SELECT 'decile' AS summary_type, predictor, predictor_decile, n_days, n_signal_days, opposite_count, opposite_rate, mean_predictor_delta, mean_target_delta AS mean_{against}_delta FROM ({_deciles_sql(cte, alone, 'x', 10)})")
    return " UNION ALL BY NAME ".join(out)


def impulse_summary(spark, sf_dir):
    g, _, b = _inputs(spark, sf_dir)
    s = studies.delta_impulse(g, b, {"eth_only_pre350": (0, 14), "rth_only_pre350": (15, 17), "eth_rth_pre350": (0, 17)}, {"k350_00_09": (0, 1), "k350_00_29": (0, 5)}, 2)
    return rounded(cohort.summaries(s, "trade_date_et", ["eth_only_pre350", "rth_only_pre350", "eth_rth_pre350"], ["k350_00_09", "k350_00_29"]))


def _impulse_summary_sql() -> str:
    whole = _impulse_sql()
    cte = whole[whole.index("WITH ") + 5 : whole.index(", final AS (")].replace("study AS (", "study_ AS (").replace("k AS (SELECT *,", "study AS (SELECT *,")
    return _summaries_sql(cte, ["eth_only_pre350", "rth_only_pre350", "eth_rth_pre350"], ["k350_00_09", "k350_00_29"], "{p}_delta_imbalance")


def path_rates(spark, sf_dir):
    d = flow.window_delta(ticks(spark, sf_dir), START, 24 * 3600, 1800)
    return rounded(cohort.path_summary(flow.bucket_paths(d, "trade_date_et", "bucket_index", {"first": (0, 11), "last": (12, 23)})))


def _path_rates_sql() -> str:
    inner = _paths_sql()
    inner = inner[inner.index("WITH ") + 5 : inner.rindex(" SELECT ")].replace("final AS (", "paths AS (")
    later = {"30s": "early_30s", "post10_30s": "post_10s_to_30s", "post10": "post_10s", "late30": "late_30s", "full": "full"}
    labels = {"early_sign": "early_10s_sign::VARCHAR", "category": "early_10s_category", "abs_category": "early_10s_abs_category", "raw_decile": "early_10s_raw_decile::VARCHAR", "imbalance_decile": "early_10s_imbalance_decile::VARCHAR"}
    rows = " UNION ALL ".join(f"SELECT *, '{n}' AS summary_type, {e} AS bucket FROM paths WHERE is_complete" for n, e in labels.items())
    parts, ints, doubles = [], [], []
    for k, w in later.items():
        signal = f"count(*) FILTER (WHERE early_10s_sign <> 0 AND coalesce(sign({w}_vd), 0) <> 0)"
        parts.append(f"{signal}::BIGINT AS signal_{k}")
        ints.append(f"signal_{k}")
        for v in ("continue", "fade"):
            n = f"count(*) FILTER (WHERE early_10s_{v}s_to_{k})"
            parts += [f"{n}::BIGINT AS {v}_{k}", f"{n} / nullif({signal}, 0)::DOUBLE AS {v}_rate_{k}"]
            ints.append(f"{v}_{k}")
            doubles.append(f"{v}_rate_{k}")
    sql = f"WITH {inner}, sc AS ({rows}), final AS (SELECT candle, summary_type, bucket, count(*)::BIGINT AS n, avg(path_efficiency) AS mean_path_efficiency, avg(cum_sign_flip_count) AS mean_sign_flips, median(full_vd) AS median_full_delta, {', '.join(parts)} FROM sc WHERE bucket IS NOT NULL GROUP BY 1, 2, 3)"
    return rounded_sql(sql, ["mean_path_efficiency", "mean_sign_flips", "median_full_delta", *doubles], ["candle", "summary_type", "bucket", "n", *ints])


def regime_study(spark, sf_dir):
    b = bars(spark, sf_dir)
    f = extremes.session_features(b, "date", "h", SPANS)
    regimes = f.select(F.col("date").alias("trade_date"), F.expr("stack(2, 'pm', pm_close_pos, pm_dir_ratio, 'hr3', hr3_close_pos, hr3_dir_ratio) AS (session_name, trend_score, chop_score)"))
    d = flow.window_delta(ticks(spark, sf_dir), 0, 86400, 3600).withColumn("second", F.col("bucket_index") * 3600)
    macro = daily(spark, sf_dir).select("date", "macro_dir_points", "macro_range_pct")
    return studies.regime_direction(regimes, macro, d, {"pm": "am", "hr3": "noon"}, ("trend_score", "chop_score"), {"noon": (12 * 3600, 15 * 3600)})


_REGIME_COLUMNS = ["date", "macro_direction", "delta_available", "trend_score_am_bucket", "chop_score_noon_bucket", "delta_noon_volume_delta", "delta_noon_delta_sign", "delta_noon_magnitude_bucket"]


def regimes(spark, sf_dir):
    return rounded(regime_study(spark, sf_dir).select(*_REGIME_COLUMNS, "trend_score_am", "chop_score_noon", "macro_dir_points"))


_third = lambda c: f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} <= quantile_cont({c}, 1 / 3.0::DOUBLE) OVER () THEN 'low' WHEN {c} <= quantile_cont({c}, 2 / 3.0::DOUBLE) OVER () THEN 'mid' ELSE 'high' END"
_REGIME_CTE = f"""{BARS}, {_DAILY}, {_features_cte()}, dl AS (SELECT date, sum(CASE side WHEN 2 THEN size WHEN 1 THEN -size ELSE 0 END)::BIGINT AS vd, sum(CASE WHEN sec >= 43200 AND sec < 54000 THEN CASE side WHEN 2 THEN size WHEN 1 THEN -size ELSE 0 END END)::BIGINT AS nd FROM et_ticks GROUP BY date),
rg AS (SELECT f.date, macro_dir_points, macro_range_points / nullif(macro_open, 0) * 100 AS macro_range_pct, CASE WHEN macro_dir_points > 0 THEN 'bullish' WHEN macro_dir_points < 0 THEN 'bearish' ELSE 'flat' END AS macro_direction, TRUE AS delta_available, pm_close_pos AS trend_score_am, hr3_close_pos AS trend_score_noon, pm_dir_ratio AS chop_score_am, hr3_dir_ratio AS chop_score_noon, nd AS delta_noon_volume_delta, abs(nd) AS an,
  CASE WHEN nd > 0 THEN 'positive' WHEN nd < 0 THEN 'negative' WHEN nd = 0 THEN 'zero' ELSE 'missing' END AS delta_noon_delta_sign FROM feats f JOIN daily d ON d.date = f.date LEFT JOIN dl ON dl.date = f.date),
rb AS (SELECT *, {_third('trend_score_am')} AS trend_score_am_bucket, {_third('trend_score_noon')} AS trend_score_noon_bucket, {_third('chop_score_noon')} AS chop_score_noon_bucket, {_third('an')} AS delta_noon_magnitude_bucket FROM rg)"""


def lifts(spark, sf_dir):
    return rounded(cohort.lift_by_bucket(regime_study(spark, sf_dir), ["trend_score_am_bucket", "delta_noon_magnitude_bucket"], "macro_dir_points", ["macro_range_pct"]))


_RATES = "count(*)::BIGINT AS sample_size, avg((macro_dir_points > 0)::INT) AS bullish_rate, avg((macro_dir_points < 0)::INT) AS bearish_rate, avg((macro_dir_points = 0)::INT) AS flat_rate, avg(macro_dir_points) AS avg_macro_dir_points"
_LIFTS = rounded_sql(
    f"WITH {_REGIME_CTE}, sc AS (" + " UNION ALL ".join(f"SELECT '{c}' AS cohort, {e} AS bucket, macro_dir_points, macro_range_pct FROM rb" for c, e in (("all", "'all'"), ("trend_score_am_bucket", "trend_score_am_bucket"), ("delta_noon_magnitude_bucket", "delta_noon_magnitude_bucket"))) + f"), ag AS (SELECT cohort, bucket, {_RATES}, avg(macro_range_pct) AS avg_macro_range_pct FROM sc WHERE bucket IS NOT NULL GROUP BY 1, 2), final AS (SELECT ag.*, bullish_rate - (SELECT bullish_rate FROM ag WHERE cohort = 'all') AS bullish_lift, bearish_rate - (SELECT bearish_rate FROM ag WHERE cohort = 'all') AS bearish_lift FROM ag)",
    ["bullish_rate", "bearish_rate", "flat_rate", "avg_macro_dir_points", "avg_macro_range_pct", "bullish_lift", "bearish_lift"], ["cohort", "bucket", "sample_size"],
)


def combos(spark, sf_dir):
    return rounded(cohort.combo_lift(regime_study(spark, sf_dir), "trend_score_am_bucket", "trend_score_noon_bucket", "macro_dir_points"))


_COMBOS = rounded_sql(f"WITH {_REGIME_CTE}, final AS (SELECT trend_score_am_bucket AS left_bucket, trend_score_noon_bucket AS right_bucket, {_RATES}, avg((macro_dir_points > 0)::INT) - (SELECT avg((macro_dir_points > 0)::INT) FROM rb) AS bullish_lift, avg((macro_dir_points < 0)::INT) - (SELECT avg((macro_dir_points < 0)::INT) FROM rb) AS bearish_lift FROM rb WHERE trend_score_am_bucket IS NOT NULL AND trend_score_noon_bucket IS NOT NULL GROUP BY 1, 2)", ["bullish_rate", "bearish_rate", "flat_rate", "avg_macro_dir_points", "bullish_lift", "bearish_lift"], ["left_bucket", "right_bucket", "sample_size"])


def combo_pivot(spark, sf_dir):
    return rounded(cohort.combo_table(cohort.combo_lift(regime_study(spark, sf_dir), "trend_score_am_bucket", "trend_score_noon_bucket", "macro_dir_points")))


def correlations(spark, sf_dir):
    return rounded(cohort.correlations(regime_study(spark, sf_dir), "date", ["trend_score_am", "chop_score_noon", "delta_noon_volume_delta"], ["macro_dir_points", "macro_range_pct"]))


_CORR = rounded_sql(
    f"WITH {_REGIME_CTE}, pr AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, '{o}' AS outcome, {f}::DOUBLE AS x, {o}::DOUBLE AS y FROM rb WHERE {f} IS NOT NULL AND {o} IS NOT NULL" for f in ("trend_score_am", "chop_score_noon", "delta_noon_volume_delta") for o in ("macro_dir_points", "macro_range_pct")) + "), rk AS (SELECT *, rank() OVER (PARTITION BY feature, outcome ORDER BY x) + (count(*) OVER (PARTITION BY feature, outcome, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature, outcome ORDER BY y) + (count(*) OVER (PARTITION BY feature, outcome, y) - 1) / 2.0 AS ry FROM pr), final AS (SELECT feature, outcome, corr(x, y) AS pearson, corr(rx, ry) AS spearman, count(*)::BIGINT AS sample_size FROM rk GROUP BY 1, 2)",
    ["pearson", "spearman"], ["feature", "outcome", "sample_size"],
)


def bands(spark, sf_dir):
    d = flow.tick_density(ticks(spark, sf_dir), 3600, START, END)
    return rounded(cohort.metric_bands(d, "bucket_of_day", "tick_count", range(11, 19)))


_DENSITY = f"dn AS (SELECT ts::DATE AS d, h AS i, count(*) AS n FROM et_ticks WHERE sec >= {START} AND sec < {END} GROUP BY 1, 2)"
_BANDS = rounded_sql(f"WITH {TICKS}, {_DENSITY}, final AS (SELECT g.i::INT AS bucket_of_day, avg(n) AS mean, quantile_cont(n, 0.25) AS p25, median(n) AS median, quantile_cont(n, 0.75) AS p75, stddev_samp(n) AS std, count(n)::BIGINT AS n FROM range(11, 19) g(i) LEFT JOIN dn ON dn.i = g.i GROUP BY 1)", ["mean", "p25", "median", "p75", "std"], ["bucket_of_day", "n"])


def normality(spark, sf_dir):
    d = flow.tick_density(ticks(spark, sf_dir), 3600, START, END)
    return rounded(cohort.jarque_bera(d, ["bucket_of_day"], "tick_count"))


_JB_CTE = f"{TICKS}, {_DENSITY}, mo AS (SELECT i AS bucket_of_day, count(*)::BIGINT AS n, avg(n) AS mu, avg(n::DOUBLE ** 2) AS m2, avg(n::DOUBLE ** 3) AS m3, avg(n::DOUBLE ** 4) AS m4 FROM dn GROUP BY 1), ce AS (SELECT *, m2 - mu ** 2 AS c2, m3 - 3 * mu * m2 + 2 * mu ** 3 AS c3, m4 - 4 * mu * m3 + 6 * mu ** 2 * m2 - 3 * mu ** 4 AS c4 FROM mo), jb AS (SELECT *, c3 / c2 ** 1.5 AS skewness, c4 / c2 ** 2 - 3 AS excess_kurtosis FROM ce), jc AS (SELECT *, n / 6.0 * (skewness ** 2 + excess_kurtosis ** 2 / 4) AS jarque_bera FROM jb)"
_JB = rounded_sql(f"WITH {_JB_CTE}, final AS (SELECT *, exp(-jarque_bera / 2) AS p_value, exp(-jarque_bera / 2) > 0.05 AS normal, 'jarque_bera' AS test FROM jc)", ["skewness", "excess_kurtosis", "jarque_bera", "p_value"], ["bucket_of_day", "n", "normal", "test"])


def normality_rollup(spark, sf_dir):
    d = flow.tick_density(ticks(spark, sf_dir), 3600, START, END)
    tested = cohort.jarque_bera(d, ["bucket_of_day"], "tick_count").withColumn("metric", F.lit("tick_count"))
    return cohort.normality_rollup(tested, ["metric"])


def hist(spark, sf_dir):
    return cohort.histogram(ticks(spark, sf_dir), ["side"], "price_ticks", 0, 800, 16)


def cumulative(spark, sf_dir):
    return rounded(cohort.ecdf(ticks(spark, sf_dir), ["side"], "size"))


TITLES = ("CPI release", "FOMC minutes", "Fed Chair Powell speaks", "Nonfarm Payrolls", "ISM Manufacturing", "ISM Services", "Core PCE", "GDP q/q", "Retail Sales", "PPI m/m", "Bank Holiday", "Housing starts", "press conference", "fed funds rate")
_TITLE_SQL = "[" + ", ".join(f"'{t}'" for t in TITLES) + "][(o_orderkey % 14 + 1)::INT]"


def news_rows(spark, sf_dir):
    """Orders seen as economic events: the key gives title and minute, urgent and high ones have high impact."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    raw = o.select(
        F.col("o_orderkey").alias("id"), F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 1440 * 60).alias("datetime_utc"),
        F.element_at(F.array(*map(F.lit, TITLES)), (F.col("o_orderkey") % 14 + 1).cast("int")).alias("title"), F.when(F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2"), "high").otherwise("low").alias("impact"),
    )
    return normalize_news(raw)


_PATTERNS = "CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{p}') THEN '{n}'" for n, p in calendar.EVENT_PATTERNS) + " ELSE 'OTHER' END"
_NEWS = f"""raw AS (SELECT o_orderkey AS id, o_orderdate + INTERVAL 1 MINUTE * (o_orderkey % 1440) AS dt_utc, {_TITLE_SQL} AS title, o_orderpriority[1] IN ('1', '2') AS hi FROM orders),
news AS (SELECT *, timezone('America/New_York', timezone('UTC', dt_utc)) AS dt_et, {_PATTERNS} AS event_type FROM raw WHERE hi AND NOT contains(title, 'speaks')), days AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders),
links AS (SELECT d.date, relation, id AS event_id, dt_utc, event_type, title, (epoch_us(dt_utc) - epoch_us(timezone('UTC', timezone('America/New_York', d.date + INTERVAL 950 MINUTE)))) / 60000000.0 AS minutes_from_close FROM days d JOIN (SELECT *, dt_et::DATE AS date, 'today' AS relation FROM news UNION ALL SELECT *, (dt_et::DATE - 1)::DATE, 'next_premarket' FROM news WHERE dt_et::TIME < TIME '09:30:00') n ON n.date = d.date)"""


def trading_days(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("date")).distinct()


def links(spark, sf_dir):
    return rounded(calendar.event_links(trading_days(spark, sf_dir), news_rows(spark, sf_dir)).select("date", "relation", "event_id", "event_type", "title", "minutes_from_close"))


def news_daily(spark, sf_dir):
    m = calendar.merge_news(trading_days(spark, sf_dir), news_rows(spark, sf_dir))
    return m.select("date", "num_today", "num_next_premarket", "num_total", "has_event_total", "has_CPI_today", "has_NFP_next_premarket", "has_GDP_total", F.concat_ws(",", F.transform("events_today", lambda x: x.cast("string"))).alias("ids_today"), F.concat_ws(",", "types_next_premarket").alias("types_next"))


_MERGED = f"""WITH {_NEWS}, ag AS (SELECT date, count(*) FILTER (WHERE relation = 'today')::BIGINT AS num_today, count(*) FILTER (WHERE relation <> 'today')::BIGINT AS num_next_premarket, bool_or(relation = 'today' AND event_type = 'CPI') AS has_CPI_today, bool_or(relation <> 'today' AND event_type = 'NFP') AS has_NFP_next_premarket, bool_or(event_type = 'GDP') AS has_GDP_total,
  string_agg(event_id::VARCHAR, ',' ORDER BY dt_utc, event_id) FILTER (WHERE relation = 'today') AS ids_today, string_agg(event_type, ',' ORDER BY dt_utc, event_id) FILTER (WHERE relation <> 'today') AS types_next FROM links GROUP BY date)
SELECT d.date, coalesce(num_today, 0) AS num_today, coalesce(num_next_premarket, 0) AS num_next_premarket, coalesce(num_today, 0) + coalesce(num_next_premarket, 0) AS num_total, coalesce(num_today, 0) + coalesce(num_next_premarket, 0) > 0 AS has_event_total, coalesce(has_CPI_today, FALSE) AS "has_CPI_today", coalesce(has_NFP_next_premarket, FALSE) AS "has_NFP_next_premarket", coalesce(has_GDP_total, FALSE) AS "has_GDP_total", coalesce(ids_today, '') AS ids_today, coalesce(types_next, '') AS types_next FROM days d LEFT JOIN ag ON ag.date = d.date"""


def cohort_days(spark, sf_dir):
    price = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("metric"))
    return calendar.event_cohorts(price, calendar.event_links(trading_days(spark, sf_dir), news_rows(spark, sf_dir)))


def cohorts(spark, sf_dir):
    return rounded(calendar.cohort_summary(cohort_days(spark, sf_dir), "metric"), 4)


def effect(spark, sf_dir):
    return rounded(calendar.cohens_d(cohort_days(spark, sf_dir), "metric", "CPI_today", "Control"))


def permutation(spark, sf_dir):
    return calendar.permutation_test(cohort_days(spark, sf_dir), "metric", "CPI_today", "Control")


_COHORT_CTE = f"{_NEWS}, pr AS (SELECT o_orderdate::DATE AS date, avg(o_totalprice) AS metric FROM orders GROUP BY 1), co AS (SELECT pr.date, metric, CASE WHEN count(*) FILTER (WHERE relation = 'today' AND event_type = 'CPI') > 0 THEN 'CPI_today' WHEN count(*) FILTER (WHERE relation <> 'today' AND event_type = 'CPI') > 0 THEN 'CPI_next_premarket' ELSE 'Control' END AS cohort FROM pr LEFT JOIN links ON links.date = pr.date GROUP BY 1, 2)"

QUERIES = {
    "delta_impulse_summary": impulse_summary, "delta_reversal": reversal, "delta_impulse": impulse, "pair_sign_rows": pair_signs, "pair_decile_rows": pair_deciles, "pair_tail_rows": pair_tails, "pair_context_rows": pair_contexts, "delta_reversal_summary": reversal_summary,
    "bucket_path_summary": path_rates, "regime_direction": regimes, "bucket_lift": lifts, "combo_lift": combos, "combo_table": combo_pivot, "feature_correlations": correlations, "metric_bands": bands, "normality": normality,
    "normality_rollup": normality_rollup, "histogram": hist, "ecdf": cumulative, "event_links": links, "news_daily": news_daily, "event_cohorts": cohorts, "cohort_effect": effect, "permutation_test": permutation,
}
_C = _COMBOS[: _COMBOS.rindex(" SELECT ")]
SQL = {
    "delta_reversal_summary": _summaries_sql(_study_cte(), PREDICTORS, ["k359", "k359_00_39"], "{p}_volume_delta / nullif({p}_classified_size, 0)::DOUBLE", _context_sql(["k359", "k359_00_39"]), "k359"), "delta_impulse_summary": _impulse_summary_sql(),
    "delta_impulse": _impulse_sql(), "bucket_path_summary": _path_rates_sql(),
    "combo_table": _C + " SELECT left_bucket, " + ", ".join(f"round(max(bullish_rate) FILTER (WHERE right_bucket = '{b}'), 6) + 0.0 AS {b}" for b in ("low", "mid", "high")) + " FROM final GROUP BY 1",
    "delta_reversal": _REVERSAL_SQL, "pair_sign_rows": _signed_sql(), "pair_decile_rows": _DECILES, "pair_tail_rows": _tails_sql(), "pair_context_rows": _CONTEXT,
    "regime_direction": rounded_sql(f"WITH {_REGIME_CTE}, final AS (SELECT * FROM rb)", ["trend_score_am", "chop_score_noon", "macro_dir_points"], _REGIME_COLUMNS), "bucket_lift": _LIFTS, "combo_lift": _COMBOS, "feature_correlations": _CORR, "metric_bands": _BANDS, "normality": _JB,
    "normality_rollup": f"WITH {_JB_CTE} SELECT 'tick_count' AS metric, CASE WHEN count(*) = 0 THEN 'insufficient' WHEN count(*) FILTER (WHERE exp(-jarque_bera / 2) <= 0.05) = 0 THEN 'all_normal' WHEN count(*) FILTER (WHERE exp(-jarque_bera / 2) > 0.05) = 0 THEN 'all_non_normal' ELSE 'mixed' END AS classification, count(*)::BIGINT AS n_tested, count(*) FILTER (WHERE exp(-jarque_bera / 2) > 0.05)::BIGINT AS n_normal FROM jc",
    "histogram": f"WITH {TICKS} SELECT side, CASE WHEN price_ticks < 0 THEN 0 WHEN price_ticks >= 800 THEN 17 ELSE price_ticks // 50 + 1 END::BIGINT AS bin, count(*)::BIGINT AS n FROM ticks WHERE price_ticks IS NOT NULL GROUP BY 1, 2",
    "ecdf": f"WITH {TICKS} SELECT DISTINCT side, size AS value, round(cume_dist() OVER (PARTITION BY side ORDER BY size), 6) + 0.0 AS share FROM ticks WHERE size IS NOT NULL",
    "event_links": f"WITH {_NEWS} SELECT date, relation, event_id, event_type, title, round(minutes_from_close, 6) + 0.0 AS minutes_from_close FROM links",
    "news_daily": _MERGED,
    "event_cohorts": rounded_sql(f"WITH {_COHORT_CTE}, final AS (SELECT cohort, count(*)::BIGINT AS n, avg(metric) AS mean, median(metric) AS median, stddev_samp(metric) AS std FROM co GROUP BY 1)", ["mean", "median", "std"], ["cohort", "n"], 4),
    "cohort_effect": f"WITH {_COHORT_CTE}, m AS (SELECT count(*) FILTER (WHERE cohort = 'CPI_today') AS na, count(*) FILTER (WHERE cohort = 'Control') AS nb, avg(metric) FILTER (WHERE cohort = 'CPI_today') AS ma, avg(metric) FILTER (WHERE cohort = 'Control') AS mb, var_samp(metric) FILTER (WHERE cohort = 'CPI_today') AS va, var_samp(metric) FILTER (WHERE cohort = 'Control') AS vb FROM co) SELECT 'CPI_today' AS a, 'Control' AS b, na::BIGINT AS na, nb::BIGINT AS nb, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) + 0.0 AS cohens_d FROM m",
}
