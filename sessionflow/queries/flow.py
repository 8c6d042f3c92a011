"""Order-flow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timecols
from ..operators import flow
from ..sources import ticks as source
from .base import DELTA, END, START, TICKS, rounded, rounded_sql, ticks

_DELTA_INTS = ["buy_size", "sell_size", "none_size", "total_size", "buy_ticks", "sell_ticks", "none_ticks", "classified_size", "volume_delta", "tick_delta"]
_SHARES = "volume_delta / nullif(classified_size, 0)::DOUBLE AS delta_imbalance, classified_size / nullif(total_size, 0)::DOUBLE AS classified_share"
WINDOWS = {"early": (0, 1), "late": (2, 5), "whole": (0, 5), "h3": (3, 3)}


def dense_hourly(spark, sf_dir):
    """Delta per New York day and hour, all 24 hours of each day."""
    return rounded(flow.window_delta(ticks(spark, sf_dir), 0, 86400, 3600, dense=True))


_DENSE = f"""WITH {TICKS}, cells AS (SELECT date AS trade_date_et, h AS bucket_index, {DELTA} FROM et_ticks GROUP BY ALL),
grid AS (SELECT trade_date_et, i::INT AS bucket_index FROM (SELECT DISTINCT trade_date_et FROM cells), range(24) r(i)),
filled AS (SELECT g.trade_date_et, g.bucket_index, {', '.join(f'coalesce(c.{x}, 0) AS {x}' for x in _DELTA_INTS)}, c.buy_size IS NULL AS is_empty,
  c.volume_delta / nullif(c.classified_size, 0)::DOUBLE AS delta_imbalance, c.classified_size / nullif(c.total_size, 0)::DOUBLE AS classified_share
  FROM grid g LEFT JOIN cells c ON g.trade_date_et = c.trade_date_et AND g.bucket_index = c.bucket_index), final AS (SELECT * FROM filled)"""


def density(spark, sf_dir):
    return flow.tick_density(ticks(spark, sf_dir), 3600, START, END)


def density_5s(spark, sf_dir):
    """The minute 14:30 of each day in buckets of five seconds, empty ones kept."""
    return flow.minute_density(ticks(spark, sf_dir), 14 * 60 + 30)


_COUNTS = "count(*)::BIGINT AS tick_count, sum(size)::BIGINT AS total_size, count(*) FILTER (WHERE side = 2)::BIGINT AS buy_ticks, count(*) FILTER (WHERE side = 1)::BIGINT AS sell_ticks, count(*) FILTER (WHERE side = 0)::BIGINT AS none_ticks"


def macro_delta(spark, sf_dir):
    return rounded(flow.window_delta(ticks(spark, sf_dir), START, END, 3600))


def globex(spark, sf_dir):
    return rounded(flow.globex_delta(ticks(spark, sf_dir), 60))


_GLOBEX = f"""WITH {TICKS}, placed AS (SELECT *, CASE WHEN sec >= 64800 THEN (date + 1)::DATE ELSE date END AS trade_date_et,
  (CASE WHEN sec >= 64800 THEN sec - 64800 ELSE sec + 21600 END // 3600)::INT AS session_minute_index FROM et_ticks WHERE sec < 61200 OR sec >= 64800),
final AS (SELECT *, {_SHARES} FROM (SELECT trade_date_et, session_minute_index, {DELTA} FROM placed GROUP BY ALL))"""
_MACRO = f"WITH {TICKS}, final AS (SELECT *, {_SHARES} FROM (SELECT date AS trade_date_et, h - 12 AS bucket_index, {DELTA} FROM et_ticks WHERE sec >= {START} AND sec < {END} GROUP BY ALL))"


def windows(spark, sf_dir):
    """Delta of index windows, their sum with another window, and sign relations."""
    d = flow.window_delta(ticks(spark, sf_dir), START, END, 3600)
    wide = flow.index_windows(d, "trade_date_et", "bucket_index", WINDOWS)
    wide = flow.alias_windows(flow.combine_windows(wide, "early", "h3", "mixed"), {"again": "whole"})
    return rounded(flow.sign_relations(wide, ["early", "mixed"], ["late"]))


def _windows_sql() -> str:
    parts = [f"sum({m}) FILTER (WHERE bucket_index BETWEEN {a} AND {b})::BIGINT AS {w}_{m}" for w, (a, b) in WINDOWS.items() for m in flow.MEASURES]
    mixed = [f"coalesce(early_{m}, 0) + coalesce(h3_{m}, 0) AS mixed_{m}" for m in flow.MEASURES]
    again = [f"whole_{m} AS again_{m}" for m in flow.MEASURES]
    names = [*WINDOWS, "mixed", "again"]
    imbalance = [f"{w}_volume_delta / nullif({w}_classified_size, 0)::DOUBLE AS {w}_delta_imbalance" for w in names]
    signs = [f"coalesce(sign({w}_volume_delta), 0)::INT AS {w}_sign" for w in ("early", "mixed", "late")]
    flags = [f"{p}_sign <> 0 AND late_sign <> 0 AS {p}_vs_late_has_signal, {p}_sign * late_sign < 0 AS {p}_opposes_late, {p}_sign * late_sign > 0 AS {p}_same_as_late" for p in ("early", "mixed")]
    others = ["trade_date_et", *(f"{w}_{m}" for w in names for m in flow.MEASURES), "early_sign", "mixed_sign", "late_sign", *(f"{p}_{s}" for p in ("early", "mixed") for s in ("vs_late_has_signal", "opposes_late", "same_as_late"))]
    sql = f"""{_MACRO.replace('final AS', 'd AS')}, a AS (SELECT trade_date_et, {', '.join(parts)} FROM d GROUP BY 1), b AS (SELECT *, {', '.join(mixed + again)} FROM a),
c AS (SELECT *, {', '.join(imbalance + signs)} FROM b), final AS (SELECT *, {', '.join(flags)} FROM c)"""
    return rounded_sql(sql, [f"{w}_delta_imbalance" for w in names], others)


CLOCK = {"noon": (12 * 3600, 13 * 3600), "afternoon": (13 * 3600, 16 * 3600), "night": (2 * 3600, 3 * 3600)}


def clock(spark, sf_dir):
    d = flow.window_delta(ticks(spark, sf_dir), 0, 86400, 3600)
    return rounded(flow.clock_windows(d.withColumn("second", F.col("bucket_index") * 3600), "trade_date_et", "second", CLOCK))


def _clock_sql() -> str:
    parts, ends, ints, doubles = [], [], [], []
    for w, (a, b) in CLOCK.items():
        inside = f"FILTER (WHERE bucket_index * 3600 >= {a} AND bucket_index * 3600 < {b})"
        parts += [f"sum({m}) {inside}::BIGINT AS {w}_{m}" for m in (*flow.MEASURES, "tick_delta")] + [f"avg(classified_share) {inside} AS {w}_classified_share"]
        ends += [f"{w}_volume_delta / nullif({w}_classified_size, 0)::DOUBLE AS {w}_delta_imbalance", f"CASE WHEN {w}_volume_delta > 0 THEN 'positive' WHEN {w}_volume_delta < 0 THEN 'negative' WHEN {w}_volume_delta = 0 THEN 'zero' ELSE 'missing' END AS {w}_delta_sign"]
        ints += [f"{w}_{m}" for m in (*flow.MEASURES, "tick_delta")] + [f"{w}_delta_sign"]
        doubles += [f"{w}_classified_share", f"{w}_delta_imbalance"]
    sql = f"""WITH {TICKS}, d AS (SELECT *, {_SHARES} FROM (SELECT date AS trade_date_et, h AS bucket_index, {DELTA} FROM et_ticks GROUP BY ALL)),
a AS (SELECT trade_date_et, {', '.join(parts)} FROM d GROUP BY 1), final AS (SELECT *, {', '.join(ends)} FROM a)"""
    return rounded_sql(sql, doubles, ["trade_date_et", *ints])


CANDLES = {"first": (0, 11), "last": (12, 23)}


def paths(spark, sf_dir):
    """Bucket paths of two candles of twelve half hours."""
    d = flow.window_delta(ticks(spark, sf_dir), START, 24 * 3600, 1800)
    wide = flow.bucket_paths(d, "trade_date_et", "bucket_index", CANDLES)
    keep = ["trade_date_et", "candle", "bucket_count", "is_complete", "b0_volume_delta", "b11_total_size", "cum_00_29_volume_delta", "full_volume_delta", "full_delta_imbalance", "early_10s_sign", *PATH_FIGURES, *PATH_FLAGS, *PATH_LABELS]
    return rounded(wide.select(*keep))


PATH_FIGURES = ["sum_abs_bucket_delta", "max_abs_bucket_delta", "peak_abs_cum_delta", "path_efficiency", "early_10s_abs_flow_share", "max_abs_bucket_index", "peak_abs_cum_bucket_index", "max_favorable_cum_delta", "max_adverse_cum_delta", "cum_sign_flip_count"]
PATH_FLAGS = [f"early_10s_{k}_to_{w}" for w in ("30s", "post10_30s", "post10", "late30", "full") for k in ("continues", "fades")]
PATH_LABELS = ["early_10s_raw_decile", "early_10s_imbalance_decile", "early_10s_abs_decile", "early_10s_category", "early_10s_abs_category"]


def _paths_sql() -> str:
    cells = ", ".join(f"sum(volume_delta) FILTER (WHERE rel = {i})::BIGINT AS b{i}" for i in range(12))
    steps = "[" + ", ".join(f"coalesce(abs(b{i}), 0)" for i in range(12)) + "]"
    runs = "[" + ", ".join(" + ".join(f"coalesce(b{k}, 0)" for k in range(i + 1)) for i in range(12)) + "]"
    total = {w: "CASE WHEN coalesce(" + ", ".join(f"b{i}" for i in range(a, b + 1)) + ") IS NOT NULL THEN " + " + ".join(f"coalesce(b{i}, 0)" for i in range(a, b + 1)) + " END" for w, (a, b) in flow.PATH_WINDOWS.items()}
    other = {"30s": "early_30s", "post10_30s": "post_10s_to_30s", "post10": "post_10s", "late30": "late_30s", "full": "full"}
    flags = ", ".join(f"early_10s_sign * coalesce(sign({w}_vd), 0) > 0 AS early_10s_continues_to_{k}, early_10s_sign * coalesce(sign({w}_vd), 0) < 0 AS early_10s_fades_to_{k}" for k, w in other.items())
    dec = lambda v: f"CASE WHEN {v} IS NOT NULL AND count({v}) OVER p >= 10 AND count(DISTINCT {v}) OVER (PARTITION BY candle) >= 10 THEN floor((row_number() OVER (PARTITION BY candle, {v} IS NULL ORDER BY {v}, trade_date_et) - 1) * 10 / count({v}) OVER p)::INT + 1 END"
    sql = f"""WITH {TICKS}, d AS (SELECT date AS trade_date_et, ((sec - {START}) // 1800)::INT AS i, {DELTA} FROM et_ticks WHERE sec >= {START} GROUP BY ALL),
w AS (SELECT trade_date_et, CASE WHEN i < 12 THEN 'first' ELSE 'last' END AS candle, count(*)::BIGINT AS bucket_count, sum(total_size) FILTER (WHERE i % 12 = 11)::BIGINT AS b11_total_size,
  sum(classified_size)::BIGINT AS full_cs, sum(classified_size) FILTER (WHERE i % 12 < 2)::BIGINT AS early_cs, {cells} FROM (SELECT *, i % 12 AS rel FROM d) GROUP BY 1, 2),
x AS (SELECT *, {steps} AS steps, {runs} AS runs, {', '.join(f'{e} AS {k}_vd' for k, e in total.items())} FROM w),
y AS (SELECT *, bucket_count = 12 AS is_complete, b0 AS b0_volume_delta, CASE WHEN coalesce(b0, b1, b2, b3, b4, b5) IS NOT NULL THEN runs[6] END AS cum_00_29_volume_delta, full_vd AS full_volume_delta, full_vd / nullif(full_cs, 0)::DOUBLE AS full_delta_imbalance,
  coalesce(sign(early_10s_vd), 0)::INT AS early_10s_sign, list_sum(steps)::BIGINT AS sum_abs_bucket_delta, list_max(steps) AS max_abs_bucket_delta, list_transform(runs, lambda r: abs(r)) AS peaks, early_10s_vd / nullif(early_cs, 0)::DOUBLE AS early_imb, abs(early_10s_vd) AS early_abs FROM x),
z AS (SELECT *, list_max(peaks) AS peak_abs_cum_delta, full_vd / nullif(sum_abs_bucket_delta, 0)::DOUBLE AS path_efficiency, early_abs / nullif(sum_abs_bucket_delta, 0)::DOUBLE AS early_10s_abs_flow_share, (list_position(steps, max_abs_bucket_delta) - 1)::INT AS max_abs_bucket_index,
  (list_position(peaks, list_max(peaks)) - 1)::INT AS peak_abs_cum_bucket_index, CASE WHEN early_10s_sign <> 0 THEN list_max(list_transform(runs, lambda r: r * early_10s_sign)) END AS max_favorable_cum_delta, CASE WHEN early_10s_sign <> 0 THEN list_min(list_transform(runs, lambda r: r * early_10s_sign)) END AS max_adverse_cum_delta,
  list_filter(list_transform(runs, lambda r: sign(r)::INT), lambda s: s <> 0) AS signs, {flags},
  {dec('early_10s_vd')} AS early_10s_raw_decile, {dec('early_imb')} AS early_10s_imbalance_decile, {dec('early_abs')} AS early_10s_abs_decile FROM y WINDOW p AS (PARTITION BY candle)),
final AS (SELECT *, coalesce(len(list_filter(range(1, len(signs)), lambda k: signs[k] <> signs[k + 1])), 0)::INT AS cum_sign_flip_count,
  CASE WHEN early_10s_sign = 0 THEN 'neutral' WHEN early_10s_sign < 0 THEN CASE WHEN early_10s_raw_decile <= 2 THEN 'strong_negative' ELSE 'weak_negative' END WHEN early_10s_raw_decile >= 9 THEN 'strong_positive' ELSE 'weak_positive' END AS early_10s_category,
  CASE WHEN early_10s_abs_decile >= 9 THEN 'high_abs_conviction' WHEN early_10s_abs_decile >= 4 THEN 'mid_abs_conviction' WHEN early_10s_abs_decile >= 1 THEN 'low_abs_conviction' END AS early_10s_abs_category FROM z)"""
    doubles = ["full_delta_imbalance", "path_efficiency", "early_10s_abs_flow_share"]
    others = ["trade_date_et", "candle", "bucket_count", "is_complete", "b0_volume_delta", "b11_total_size", "cum_00_29_volume_delta", "full_volume_delta", "early_10s_sign", *(f for f in PATH_FIGURES if f not in doubles), *PATH_FLAGS, *PATH_LABELS]
    return rounded_sql(sql, doubles, others)


def bars_from_ticks(spark, sf_dir):
    """Hourly bars of a bounded interval of ticks."""
    inside = source.tick_window(ticks(spark, sf_dir), "2024-01-05 00:00:00", "2024-01-20 00:00:00")
    return rounded(source.minute_bars(inside, 3600).withColumn("datetime_utc", F.date_format("datetime_utc", "yyyy-MM-dd HH:mm:ss")))


QUERIES = {
    "flow_dense_hourly": dense_hourly, "tick_density_hourly": density, "tick_density_5s": density_5s, "flow_macro_delta": macro_delta, "flow_globex_delta": globex,
    "flow_index_windows": windows, "flow_clock_windows": clock, "flow_bucket_paths": paths, "ticks_to_bars": bars_from_ticks,
}
SQL = {
    "flow_dense_hourly": rounded_sql(_DENSE, ["delta_imbalance", "classified_share"], ["trade_date_et", "bucket_index", *_DELTA_INTS, "is_empty"]),
    "tick_density_hourly": f"WITH {TICKS} SELECT ts::DATE AS date_utc, date_trunc('hour', ts) AS datetime_utc, h AS bucket_of_day, {_COUNTS} FROM et_ticks WHERE sec >= {START} AND sec < {END} GROUP BY ALL",
    "tick_density_5s": f"""WITH {TICKS}, c AS (SELECT date AS date_et, ((sec - 52200) // 5)::INT AS bucket_index, {_COUNTS} FROM et_ticks WHERE sec >= 52200 AND sec < 52260 GROUP BY ALL)
SELECT d.date_et, i::INT AS bucket_index, {', '.join(f'coalesce({x}, 0) AS {x}' for x in ('tick_count', 'total_size', 'buy_ticks', 'sell_ticks', 'none_ticks'))}, tick_count IS NULL AS is_empty
FROM (SELECT DISTINCT date_et FROM c) d CROSS JOIN range(12) r(i) LEFT JOIN c ON c.date_et = d.date_et AND c.bucket_index = i""",
    "flow_macro_delta": rounded_sql(_MACRO, ["delta_imbalance", "classified_share"], ["trade_date_et", "bucket_index", *_DELTA_INTS]),
    "flow_globex_delta": rounded_sql(_GLOBEX, ["delta_imbalance", "classified_share"], ["trade_date_et", "session_minute_index", *_DELTA_INTS]),
    "flow_index_windows": _windows_sql(),
    "flow_clock_windows": _clock_sql(),
    "flow_bucket_paths": _paths_sql(),
    "ticks_to_bars": f"""WITH {TICKS}, final AS (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS datetime_utc, arg_min(price, (ts, rk)) AS "Open", max(price) AS "High", min(price) AS "Low", arg_max(price, (ts, rk)) AS "Close", sum(size)::BIGINT AS "Volume"
FROM et_ticks WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1) SELECT datetime_utc, round("Open", 6) + 0.0 AS "Open", round("High", 6) + 0.0 AS "High", round("Low", 6) + 0.0 AS "Low", round("Close", 6) + 0.0 AS "Close", "Volume" FROM final""",
}


#: Spans in minutes of the New York day; the first that holds a visitor's whole day names it.
_SPANS = {"night": (0, 479), "morning": (480, 779), "afternoon": (720, 1079), "evening": (1020, 1439)}
_ERAS = {"pre_end": "1996-12-31", "transition": ("1997-01-01", "1997-12-31"), "post_start": "1998-01-01"}


def visits(spark, sf_dir):
    """The session that holds all events of a user's New York day."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", F.to_date(timecols.wall("ts")).alias("date"))
    return timecols.detect_session(events, ["user_id", "date"], "ts", _SPANS)


def era_totals(spark, sf_dir):
    """Orders and their value before, after and around a transition year."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    total = lambda name: timecols.era(orders, "o_orderdate", name, **_ERAS).groupBy(F.lit(name).alias("era")).agg(F.count("*").alias("n"), F.sum("price").cast("double").alias("value"))
    return total("pre_covid").unionByName(total("post_covid")).unionByName(total("full_dev"))


QUERIES |= {"detected_sessions": visits, "era_totals": era_totals}
SQL |= {
    "detected_sessions": f"""WITH {TICKS}, seen AS (SELECT user_id, date, min(sec // 60) AS a, max(sec // 60) AS b FROM et_ticks GROUP BY 1, 2)
SELECT user_id, date, CASE {" ".join(f"WHEN a >= {a} AND b <= {b} THEN '{k}'" for k, (a, b) in _SPANS.items())} ELSE 'unknown' END AS session_name FROM seen""",
    "era_totals": """WITH o AS (SELECT o_orderdate::DATE AS d, o_totalprice::DECIMAL(18, 2) AS price FROM orders), e AS (SELECT 'pre_covid' AS era, price FROM o WHERE d <= DATE '1996-12-31'
UNION ALL SELECT 'post_covid', price FROM o WHERE d >= DATE '1998-01-01' UNION ALL SELECT 'full_dev', price FROM o WHERE year(d) <> 1997) SELECT era, count(*)::BIGINT AS n, sum(price)::DOUBLE AS value FROM e GROUP BY 1""",
}
