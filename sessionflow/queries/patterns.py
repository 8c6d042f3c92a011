"""Liquidity patterns on hourly bars rounded to whole points, and the streaming forms over the events file."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.tables import shared_dir
from ..operators import liquidity as lq
from ..operators import regime
from ..sources.ticks import ticks_from_events
from ..streaming import ticks as stream
from .base import BARS, TICKS, bars, rounded, rounded_sql


def days(spark, sf_dir):
    b = bars(spark, sf_dir).withColumns({c: F.round(F.col(c) / 10) + 1 for c in ("Open", "High", "Low", "Close")})
    return regime.sessions(b, ["date"], "h")


def swings(spark, sf_dir):
    return lq.swings(lq.with_swings(days(spark, sf_dir), 2), ["date"])


_ROUND = f"{BARS}, rb AS (SELECT date, row_number() OVER (PARTITION BY date ORDER BY h) - 1 AS i, count(*) OVER (PARTITION BY date) AS n, round(hi / 10) + 1 AS hh, -(round(lo / 10) + 1) AS ll FROM bars), lv AS (SELECT date, i, n, TRUE AS is_high, hh AS a FROM rb UNION ALL SELECT date, i, n, FALSE, ll FROM rb)"
_SWINGS = f"""WITH {_ROUND}, sw AS (SELECT *, max(a) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b2, max(a) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS f2, lead(a) OVER w AS n1, lag(a) OVER w AS p1, lead(a, 2) OVER w AS n2, max(a) OVER (w ROWS BETWEEN 2 FOLLOWING AND 4 FOLLOWING) AS f4 FROM lv WINDOW w AS (PARTITION BY date, is_high ORDER BY i))
SELECT date, is_high, i::INT AS "index", abs(a) AS price, NOT (a > b2 AND a > f2) AS is_tick_swing FROM sw WHERE i >= 2 AND i < n - 2 AND ((a > b2 AND a > f2) OR (n1 = a AND p1 < a AND n2 < a AND b2 < a AND f4 < a))"""


def tick_equals(spark, sf_dir):
    d = lq.with_swings(days(spark, sf_dir), 2)
    both = lq.tick_equal_patterns(d, ["date"], True).unionByName(lq.tick_equal_patterns(d, ["date"], False))
    return both.select("date", "type", "strength", "start_index", "end_index", "start_price")


_TICK_EQUALS = f"""WITH {_ROUND}, s AS ({_SWINGS[_SWINGS.index('sw AS') + 7:_SWINGS.index(')' + chr(10) + 'SELECT date')]}), sp AS (SELECT date, is_high, i, NOT (a > b2 AND a > f2) AS tick FROM s WHERE i >= 2 AND i < n - 2 AND ((a > b2 AND a > f2) OR (n1 = a AND p1 < a AND n2 < a AND b2 < a AND f4 < a)))
SELECT x.date, CASE WHEN x.is_high THEN 'EQUAL_HIGHS' ELSE 'EQUAL_LOWS' END AS type, CASE WHEN coalesce(NOT p.tick, FALSE) AND coalesce(NOT q.tick, FALSE) THEN 'SWING_TICK_EQUAL' ELSE 'TICK_EQUAL' END AS strength, x.i::INT AS start_index, y.i::INT AS end_index, abs(x.a) AS start_price
FROM lv x JOIN lv y ON y.date = x.date AND y.is_high = x.is_high AND y.a = x.a AND y.i > x.i LEFT JOIN sp p ON p.date = x.date AND p.is_high = x.is_high AND p.i = x.i LEFT JOIN sp q ON q.date = y.date AND q.is_high = y.is_high AND q.i = y.i
WHERE NOT EXISTS (SELECT 1 FROM lv z WHERE z.date = x.date AND z.is_high = x.is_high AND z.i > x.i AND z.i < y.i AND z.a > x.a) AND NOT (coalesce(p.tick, FALSE) AND y.i = x.i + 1)"""


def patterns(spark, sf_dir):
    found = lq.detect(days(spark, sf_dir), ["date"], 2, 0.2, least=3, tolerance=0.3, variance=0.9)
    return rounded(lq.with_weight(found, 24, 60))


def strong(spark, sf_dir):
    found = lq.detect(days(spark, sf_dir), ["date"], 2, 0.2, least=3, tolerance=0.3, variance=0.9)
    return rounded(lq.of_kinds(found, [("TRENDLINE", None), ("EQUAL_HIGHS", "SWING_TICK_EQUAL")]))


def _patterns_sql() -> str:
    """Tick swings, tick-equal and relative-equal pairs, and trendlines chosen greedily (longest, then leftmost) by a recursion over the valid runs."""
    swing = _SWINGS[_SWINGS.index("sw AS (") + 7 : _SWINGS.index(")" + chr(10) + "SELECT date")]
    level = "CASE WHEN is_high THEN 'EQUAL_HIGHS' ELSE 'EQUAL_LOWS' END AS type"
    none = "NULL::DOUBLE AS slope, 2 AS n_points"
    base = "CASE " + " ".join(f"WHEN {'type' if k == 'TRENDLINE' else 'strength'} = '{k}' THEN {v}" for k, v in reversed(lq.STRENGTH.items())) + " ELSE 0.5 END"
    return f"""WITH RECURSIVE {_ROUND}, s AS ({swing}), sp AS (SELECT date, is_high, i, a, NOT (a > b2 AND a > f2) AS tick FROM s WHERE i >= 2 AND i < n - 2 AND ((a > b2 AND a > f2) OR (n1 = a AND p1 < a AND n2 < a AND b2 < a AND f4 < a))),
cl AS (SELECT date, row_number() OVER (PARTITION BY date ORDER BY h) - 1 AS i, round(c / 10) + 1 AS c FROM bars), lc AS (SELECT lv.*, cl.c, CASE WHEN is_high THEN 1 ELSE -1 END AS sgn FROM lv JOIN cl ON cl.date = lv.date AND cl.i = lv.i),
te AS ({_TICK_EQUALS[_TICK_EQUALS.rindex("SELECT x.date") :]}),
oh AS (SELECT x.date, x.is_high, x.i AS i0, y.i AS i1, abs(x.a) AS p, abs(y.a) AS q FROM sp x JOIN sp y ON y.date = x.date AND y.is_high = x.is_high AND y.i > x.i AND NOT x.tick AND NOT y.tick WHERE x.a > y.a AND abs(abs(x.a) - abs(y.a)) / ((abs(x.a) + abs(y.a)) / 2) <= 0.2 AND NOT EXISTS (SELECT 1 FROM lv z WHERE z.date = x.date AND z.is_high = x.is_high AND z.i > x.i AND z.i < y.i AND z.a > x.a)),
pt AS (SELECT *, row_number() OVER w AS k0, (a - lag(a) OVER w) / (i - lag(i) OVER w) AS step FROM sp WINDOW w AS (PARTITION BY date, is_high ORDER BY i)),
sa AS (SELECT x.date, x.is_high, x.k0 AS st, k, x.i AS i0, y.i AS i1, x.a AS a0, y.a AS a1, (y.a - x.a) / (y.i - x.i) AS g FROM pt x, range(3, 8) r(k), pt y WHERE y.date = x.date AND y.is_high = x.is_high AND y.k0 = x.k0 + k - 1 AND y.a < x.a),
sb AS (SELECT sa.date, sa.is_high, st, k FROM sa JOIN pt ON pt.date = sa.date AND pt.is_high = sa.is_high AND pt.k0 BETWEEN st AND st + k - 1 GROUP BY ALL HAVING bool_and(pt.a <= a0 AND abs(pt.a - (a0 + g * (pt.i - i0))) / abs(a0 + g * (pt.i - i0)) <= 0.3 AND (pt.k0 = st OR abs((step - g) / g) <= 0.9))),
sc AS (SELECT sa.date, sa.is_high, st, k FROM sa JOIN lc ON lc.date = sa.date AND lc.is_high = sa.is_high AND lc.i BETWEEN i0 AND i1 GROUP BY ALL HAVING max(abs(lc.a - (a0 + g * (lc.i - i0)))) <= avg(abs(lc.a - (a0 + g * (lc.i - i0)))) + 3 * stddev_pop(abs(lc.a - (a0 + g * (lc.i - i0)))) AND bool_and(c * sgn - (a0 + g * (lc.i - i0)) * (1 + sgn * 0.3) <= 0)),
go AS (SELECT sa.*, row_number() OVER (PARTITION BY sa.date, sa.is_high ORDER BY sa.k DESC, sa.st) AS r FROM sa SEMI JOIN sb ON sb.date = sa.date AND sb.is_high = sa.is_high AND sb.st = sa.st AND sb.k = sa.k SEMI JOIN sc ON sc.date = sa.date AND sc.is_high = sa.is_high AND sc.st = sa.st AND sc.k = sa.k),
ch AS (SELECT DISTINCT date, is_high, 0::BIGINT AS r, []::STRUCT(st BIGINT, k BIGINT)[] AS taken FROM go UNION ALL SELECT go.date, go.is_high, go.r, CASE WHEN len(list_filter(taken, lambda t: go.st < t.st + t.k AND t.st < go.st + go.k)) = 0 THEN list_append(taken, {{'st': go.st, 'k': go.k}}) ELSE taken END FROM ch JOIN go ON go.date = ch.date AND go.is_high = ch.is_high AND go.r = ch.r + 1),
tl AS (SELECT go.* FROM go JOIN (SELECT date, is_high, unnest(arg_max(taken, r)) AS t FROM ch GROUP BY 1, 2) u ON u.date = go.date AND u.is_high = go.is_high AND u.t.st = go.st AND u.t.k = go.k),
al AS (SELECT date, {level}, 'TICK_SWING' AS strength, is_high AS is_buyside, i AS start_index, i + 1 AS end_index, abs(a) AS start_price, abs(a) AS end_price, {none} FROM sp WHERE tick
  UNION ALL SELECT date, type, strength, type = 'EQUAL_HIGHS', start_index, end_index, start_price, start_price, {none} FROM te
  UNION ALL SELECT date, {level}, 'OLDER_HIGHER', is_high, i0, i1, p, q, {none} FROM oh
  UNION ALL SELECT date, 'TRENDLINE', NULL, is_high, i0, i1, abs(a0), abs(a1), g * CASE WHEN is_high THEN 1 ELSE -1 END, k FROM tl),
final AS (SELECT *, {base} * exp(-0.007 * greatest(0, 24 - end_index)) * CASE WHEN strength IN ('SWING_TICK_EQUAL', 'TICK_SWING', 'TICK_EQUAL') THEN 1 + ln(60.0::DOUBLE) / 3 ELSE 1 END AS weight FROM al)"""


_PATTERN_COLUMNS = ["date", "type", "strength", "is_buyside", "start_index::INT AS start_index", "end_index::INT AS end_index", "n_points::INT AS n_points"]
_PATTERN_DOUBLES = ["start_price", "end_price", "slope"]


def _streamed(spark, sf_dir, build, keys=()):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    # the file source lists a folder, so the one file is named by a glob
    raw = stream.read_stream(spark, f"{sf_dir}/events.parquet*", batch.schema)
    folder = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    return stream.write_available(build(ticks_from_events(raw)), f"{folder}/out", f"{folder}/checkpoint", keys)


def stream_bars(spark, sf_dir):
    """Hourly bars that the watermark has closed (the last two hours are still open)."""
    out = _streamed(spark, sf_dir, lambda t: stream.streaming_bars(t, "1 hour", "1 hour"))
    return rounded(out.withColumn("datetime_utc", F.date_format("datetime_utc", "yyyy-MM-dd HH:mm:ss")))


def stream_delta(spark, sf_dir):
    out = _streamed(spark, sf_dir, lambda t: stream.streaming_delta(t, "1 hour", "1 hour"))
    return rounded(out.withColumn("datetime_utc", F.date_format("datetime_utc", "yyyy-MM-dd HH:mm:ss")).select("datetime_utc", "buy_size", "sell_size", "volume_delta", "total_size", "delta_imbalance"))


def stream_vwap(spark, sf_dir):
    """The last update of each day's VWAP from 12:00 to 18:00."""
    return rounded(_streamed(spark, sf_dir, lambda t: stream.streaming_vwap(t, 12 * 3600, 18 * 3600), ["date"]))


_OPEN = "(SELECT max(ts) - INTERVAL 1 HOUR FROM ticks)"
QUERIES = {"liquidity_swings": swings, "liquidity_tick_equals": tick_equals, "liquidity_patterns": patterns, "liquidity_selected": strong, "stream_bars": stream_bars, "stream_delta": stream_delta, "stream_vwap": stream_vwap}
SQL = {
    "liquidity_swings": _SWINGS, "liquidity_tick_equals": _TICK_EQUALS,
    "liquidity_patterns": rounded_sql(_patterns_sql(), [*_PATTERN_DOUBLES, "weight"], _PATTERN_COLUMNS),
    "liquidity_selected": rounded_sql(_patterns_sql(), _PATTERN_DOUBLES, _PATTERN_COLUMNS) + " WHERE type = 'TRENDLINE' OR (type = 'EQUAL_HIGHS' AND strength = 'SWING_TICK_EQUAL')",
    "stream_bars": f"""WITH {TICKS}, b AS (SELECT date_trunc('hour', ts) AS t, arg_min(price, (ts, rk)) AS o, max(price) AS h, min(price) AS l, arg_max(price, (ts, rk)) AS c, sum(size)::BIGINT AS v FROM ticks GROUP BY 1)
SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS datetime_utc, round(o, 6) + 0.0 AS "Open", round(h, 6) + 0.0 AS "High", round(l, 6) + 0.0 AS "Low", round(c, 6) + 0.0 AS "Close", v AS "Volume" FROM b WHERE t + INTERVAL 1 HOUR <= {_OPEN}""",
    "stream_delta": f"""WITH {TICKS}, b AS (SELECT date_trunc('hour', ts) AS t, sum(CASE WHEN side = 2 THEN size ELSE 0 END)::BIGINT AS buy_size, sum(CASE WHEN side = 1 THEN size ELSE 0 END)::BIGINT AS sell_size, sum(size)::BIGINT AS total_size FROM ticks GROUP BY 1)
SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS datetime_utc, buy_size, sell_size, buy_size - sell_size AS volume_delta, total_size, round((buy_size - sell_size) / nullif(buy_size + sell_size, 0)::DOUBLE, 6) + 0.0 AS delta_imbalance FROM b WHERE t + INTERVAL 1 HOUR <= {_OPEN}""",
    "stream_vwap": rounded_sql(f"WITH {TICKS}, final AS (SELECT date, sum(size)::BIGINT AS volume, arg_max(price, (ts, rk)) AS last_price, sum(price * size) / sum(size) AS vwap FROM et_ticks WHERE sec >= 43200 AND sec < 64800 GROUP BY 1)", ["last_price", "vwap"], ["date", "volume"]),
}
