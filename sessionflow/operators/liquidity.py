"""Liquidity patterns per session: swings, equal levels, trendlines and their weights.

Sessions are rows with arrays o, h, l, c (see ``regime.sessions``). Swings and
trendlines are array expressions; pairs of equal price are an equi join on
session and price with the trade-through test as an index bound.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A

POINT = "struct<index:int,price:double,is_tick_swing:boolean>"
#: Base strength of a pattern (fixed values); trendlines have that of ``TRENDLINE``.
STRENGTH = {"TRENDLINE": 0.9, "SWING_TICK_EQUAL": 1.0, "TICK_SWING": 0.9, "TICK_EQUAL": 0.75, "OLDER_HIGHER": 0.7}
_FIELDS = ("type", "strength", "is_buyside", "start_index", "end_index", "start_price", "end_price", "slope", "n_points")


def swing_points(prices: Column, up: bool, lookback: int = 3) -> Column:
    """Array of swings (``POINT``) in order: strict extremes over ``lookback`` bars on both sides, and tick swings.

    A tick swing is two equal bars with worse ones on both sides that beat the
    ``lookback`` bars beyond those; it stands at the first of the two.
    """
    a = prices if up else F.transform(prices, lambda x: -x)
    n = F.size(a)
    inner = F.when(n >= 2 * lookback + 1, F.sequence(F.lit(lookback), F.greatest(n - lookback - 1, F.lit(lookback)))).otherwise(F.array().cast("array<int>"))

    def below(start: Column, length: Column | int, level: Column) -> Column:
        return F.forall(A.part(a, start, length), lambda x: x < level)

    def point(i: Column) -> Column:
        level = A.at(a, i)
        regular = below(i - lookback, lookback, level) & below(i + 1, lookback, level)
        before = F.greatest(i - lookback, F.lit(0))
        # the bars beyond the four of the pattern, on the right as far as there are any
        tick = (A.at(a, i + 1) == level) & (A.at(a, i - 1) < level) & (A.at(a, i + 2) < level) & below(before, i - before, level) & below(i + 2, F.least(F.lit(lookback + 1), n - i - 2), level)
        tick = F.coalesce(tick, F.lit(False))
        return F.when(regular | tick, F.struct(i.alias("index"), A.at(prices, i).alias("price"), (~regular).alias("is_tick_swing")))

    return F.filter(F.transform(inner, point), lambda p: p.isNotNull()).cast(f"array<{POINT}>")


def with_swings(df: DataFrame, lookback: int = 3) -> DataFrame:
    """Adds arrays highs and lows of swing points."""
    return df.withColumn("highs", swing_points(F.col("h"), True, lookback)).withColumn("lows", swing_points(F.col("l"), False, lookback))


def swings(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """A row per swing."""
    parts = [df.select(*by, F.lit(up).alias("is_high"), F.explode(c).alias("p")).select(*by, "is_high", "p.*") for c, up in (("highs", True), ("lows", False))]
    return reduce(DataFrame.unionByName, parts)


def _pattern(kind: str | Column, strength: str | Column | None, up: bool, i: Column, j: Column, p: Column, q: Column, slope: Column | None = None, n: Column | int = 2) -> list[Column]:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = (as_col(kind), as_col(strength).cast("string"), F.lit(up), i, j, p.cast("double"), q.cast("double"), (slope if slope is not None else F.lit(None)).cast("double"), as_col(n).cast("int"))
    return [v.alias(c) for v, c in zip(values, _FIELDS)]


def _level(up: bool) -> str:
    return "EQUAL_HIGHS" if up else "EQUAL_LOWS"


def tick_swing_patterns(df: DataFrame, by: Sequence[str], up: bool) -> DataFrame:
    s = df.select(*by, F.explode("highs" if up else "lows").alias("_s")).where("_s.is_tick_swing")
    return s.select(*by, *_pattern(_level(up), "TICK_SWING", up, F.col("_s.index"), F.col("_s.index") + 1, F.col("_s.price"), F.col("_s.price")))


def tick_equal_patterns(df: DataFrame, by: Sequence[str], up: bool) -> DataFrame:
    """All pairs of bars of one price that no bar between trades through; two regular swings are the stronger kind.

    The pair of a tick swing is left to ``tick_swing_patterns``.
    """
    c, s = ("h", "highs") if up else ("l", "lows")
    a = F.col(c) if up else F.transform(c, lambda x: -x)
    held = df.where("n > 0").withColumn("_a", a)
    through = A.next_greater(F.col("_a"), F.col("_max"))
    regular = F.transform(F.filter(s, lambda p: ~p["is_tick_swing"]), lambda p: p["index"])
    tick = F.transform(F.filter(s, lambda p: p["is_tick_swing"]), lambda p: p["index"])
    bars = held.withColumn("_max", A.range_maxima(F.col("_a"))).select(*by, F.posexplode(F.arrays_zip(F.col(c).alias("price"), through.alias("through"))).alias("_i", "_b"), regular.alias("_r"), tick.alias("_k"))
    bars = bars.select(
        *by, "_i", F.col("_b.price").alias("_price"), F.col("_b.through").alias("_end"),
        F.array_contains("_r", F.col("_i")).alias("_swing"), F.array_contains("_k", F.col("_i")).alias("_tick"),
    )
    later = bars.select(*by, "_price", F.col("_i").alias("_j"), F.col("_swing").alias("_swing2"))
    # a bar that trades through can't be of the price itself, so the second bar is before it
    pairs = bars.join(later, [*by, "_price"]).where((F.col("_j") > F.col("_i")) & (F.col("_end").isNull() | (F.col("_j") < F.col("_end"))))
    pairs = pairs.where(~(F.col("_tick") & (F.col("_j") == F.col("_i") + 1)))
    strength = F.when(F.col("_swing") & F.col("_swing2"), "SWING_TICK_EQUAL").otherwise("TICK_EQUAL")
    return pairs.select(*by, *_pattern(_level(up), strength, up, F.col("_i"), F.col("_j"), F.col("_price"), F.col("_price")))


def relative_equal_patterns(df: DataFrame, by: Sequence[str], up: bool, tolerance: float = 0.001) -> DataFrame:
    """Pairs of regular swings within the tolerance, the older one further out, with no bar between beyond it."""
    c, s = ("h", "highs") if up else ("l", "lows")
    sign = 1 if up else -1
    regular = F.filter(s, lambda p: ~p["is_tick_swing"])
    pts = df.select(*by, F.col(c).alias("_a"), F.explode(regular).alias("_p"), regular.alias("_all"))
    pts = pts.withColumn("_q", F.explode("_all")).where("_q.index > _p.index")
    p, q, i, j = F.col("_p.price"), F.col("_q.price"), F.col("_p.index"), F.col("_q.index")
    near = (p != q) & (F.abs(p - q) / ((p + q) / 2) <= tolerance) & (p * sign >= q * sign)
    clear = F.forall(A.part(F.col("_a"), i + 1, j - i - 1), lambda x: x * sign <= p * sign)
    return pts.where(near & clear).select(*by, *_pattern(_level(up), "OLDER_HIGHER", up, i, j, p, q))


def trendline_valid(points: Column, extreme: Column, close: Column, up: bool, tolerance: float = 0.0005, variance: float = 0.2, deviations: float = 3.0) -> Column:
    """Whether consecutive swings form an unbroken line towards the trade: slope, oldest furthest, even segments, bars and closes near it."""
    sign = 1 if up else -1
    a, b = F.element_at(points, 1), F.element_at(points, -1)
    slope = (b["price"] - a["price"]) / (b["index"] - a["index"])
    line = lambda i: a["price"] + slope * (i - a["index"])
    steps = A.lagged(points, 1, lambda x, y: (x["price"] - y["price"]) / (x["index"] - y["index"]))
    even = (F.size(points) <= 2) | F.forall(steps, lambda s: F.abs((s - slope) / slope) <= variance)
    bars = F.sequence(a["index"], b["index"])
    off = F.transform(bars, lambda i: F.abs(A.at(extreme, i) - line(i)))
    near = F.forall(off, lambda d: d <= A.mean(off) + deviations * A.std(off, 0))
    closes = F.forall(bars, lambda i: (A.at(close, i) - line(i) * (1 + sign * tolerance)) * sign <= 0)
    touching = F.forall(points, lambda p: F.abs(p["price"] - line(p["index"])) / line(p["index"]) <= tolerance)
    oldest = F.forall(points, lambda p: p["price"] * sign <= a["price"] * sign)
    return F.coalesce((slope * sign < 0) & oldest & even & near & closes & touching, F.lit(False))


def trendline_patterns(df: DataFrame, by: Sequence[str], up: bool, least: int = 3, most: int = 7, tolerance: float = 0.0005, variance: float = 0.2, deviations: float = 3.0) -> DataFrame:
    """Valid runs of consecutive swings, longest first, then leftmost; a swing belongs to one line."""
    c, s = ("h", "highs") if up else ("l", "lows")
    m = F.size(s)
    spans = F.flatten(F.transform(F.sequence(F.lit(most), F.lit(least), F.lit(-1)), lambda k: F.when(m >= k, F.transform(F.sequence(F.lit(0), F.greatest(m - k, F.lit(0))), lambda i: F.struct(i.alias("i"), k.alias("k")))).otherwise(F.array().cast("array<struct<i:int,k:int>>"))))
    df = df.select(*by, F.col(s).alias("_s"), F.col(c).alias("_a"), F.col("c").alias("_c"), spans.alias("_spans"))
    good = F.filter("_spans", lambda x: trendline_valid(A.part(F.col("_s"), x["i"], x["k"]), F.col("_a"), F.col("_c"), up, tolerance, variance, deviations))
    empty = F.array().cast("array<struct<i:int,k:int>>")
    free = lambda taken, x: ~F.exists(taken, lambda t: (x["i"] < t["i"] + t["k"]) & (t["i"] < x["i"] + x["k"]))
    chosen = F.aggregate("_good", empty, lambda taken, x: F.when(free(taken, x), F.array_append(taken, x)).otherwise(taken))
    lines = df.withColumn("_good", good).select(*by, "_s", F.explode(chosen).alias("_x"))
    first, size = F.col("_x.i"), F.col("_x.k")
    lines = lines.select(*by, A.at(F.col("_s"), first).alias("_p"), A.at(F.col("_s"), first + size - 1).alias("_q"), size.alias("_n"))
    p, q = F.col("_p"), F.col("_q")
    slope = (q["price"] - p["price"]) / (q["index"] - p["index"])
    return lines.select(*by, *_pattern("TRENDLINE", None, up, p["index"], q["index"], p["price"], q["price"], slope, F.col("_n")))


def detect(df: DataFrame, by: Sequence[str], lookback: int = 3, equal_tolerance: float = 0.001, **trendline) -> DataFrame:
    """All patterns of both sides of sessions with arrays h, l, c."""
    df = with_swings(df, lookback)
    parts = []
    for up in (True, False):
        parts += [trendline_patterns(df, by, up, **trendline), tick_swing_patterns(df, by, up), tick_equal_patterns(df, by, up), relative_equal_patterns(df, by, up, equal_tolerance)]
    return reduce(DataFrame.unionByName, parts)


def with_weight(patterns: DataFrame, current: Column | int, minutes: int = 5, decay: float = 0.007) -> DataFrame:
    """Adds weight: base strength, decayed by age in bars, more for ticks on longer bars."""
    base = F.lit(0.5)
    for k, v in STRENGTH.items():
        base = F.when((F.col("type") if k == "TRENDLINE" else F.col("strength")) == k, v).otherwise(base)
    now = F.lit(current) if isinstance(current, int) else current
    age = F.greatest(F.lit(0), now - F.col("end_index"))
    longer = F.when(F.col("strength").isin("SWING_TICK_EQUAL", "TICK_SWING", "TICK_EQUAL"), 1 + F.log(F.lit(float(minutes))) / 3).otherwise(1.0)
    return patterns.withColumn("weight", base * F.exp(-decay * age) * longer)


def of_kinds(patterns: DataFrame, kinds: Sequence[tuple[str, str | None]]) -> DataFrame:
    """Patterns whose (type, strength) is asked for; a null strength stands for any."""
    wanted = [(F.col("type") == t) & (F.lit(True) if s is None else F.col("strength") == s) for t, s in kinds]
    return patterns.where(reduce(lambda a, b: a | b, wanted, F.lit(False)))
