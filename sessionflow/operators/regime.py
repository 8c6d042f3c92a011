"""Regime features of a session: trend strength, path shape, memory, containment, ensemble state.

``sessions`` gathers a session's bars (a few hundred at most) into arrays o,
h, l, c, v in the order of time; each feature function adds columns. What
can't be computed is null, with the reason in a status column where the
feature belongs to the modelling table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.stats import ratio
from ..functions.tables import materialize

EPS = 1e-12
#: Per session: minutes per bar, smoothing period, DX instead of ADX, weights of strength, persistence, crossover, least bars (fixed values).
QUALITY = {
    "1pm-3pm": (5, 12, False, (0.5, 0.3, 0.2), 20),
    "3pm-3:50pm": (2, 12, False, (0.5, 0.3, 0.2), 20),
    "3:50pm-4pm": (1, 5, True, (0.4, 0.3, 0.3), 7),
}
INITIAL_BALANCE = {"1pm-3pm": 15, "3pm-3:50pm": 10, "3:50pm-4pm": 10}
#: Weights and leaning (towards trend 1, towards range -1) of the seven signals (fixed values).
WEIGHTS = {"adx": 0.18, "atr_range": 0.10, "dra": 0.12, "irr": 0.12, "lag": 0.12, "mss": 0.24, "spd": 0.12}
LEANING = {"adx": 1, "mss": 1, "dra": -1, "atr_range": -1, "irr": -1, "spd": 0, "lag": 0}


def sessions(bars: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """One row per group with its bars as arrays o, h, l, c, v (and n, their number)."""
    bar = F.struct(F.col(at).alias("t"), *(F.col(c).cast("double").alias(n) for n, c in (("o", "Open"), ("h", "High"), ("l", "Low"), ("c", "Close"), ("v", "Volume"))))
    out = bars.groupBy(*by).agg(F.array_sort(F.collect_list(bar)).alias("_b"))
    return out.select(*by, F.size("_b").alias("n"), *(F.col(f"_b.{c}").alias(c) for c in ("t", "o", "h", "l", "c", "v")))


def coarser(df: DataFrame, k: int) -> DataFrame:
    """Arrays of bars k times as long (the last may be shorter)."""
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(k))
    group = lambda c, f: F.when(F.col("n") > 0, F.transform(starts, lambda i: f(A.part(F.col(c), i, F.lit(k))))).otherwise(F.array().cast("array<double>"))
    new = {"o": group("o", lambda x: F.element_at(x, 1)), "h": group("h", F.array_max), "l": group("l", F.array_min), "c": group("c", lambda x: F.element_at(x, -1)), "v": group("v", A.total)}
    return df.withColumns(new).withColumn("n", F.size("c"))


def true_range() -> Column:
    h, l, c = F.col("h"), F.col("l"), F.col("c")
    before = F.concat(F.array(A.null()), A.part(c, 0, F.size(c) - 1))
    return F.zip_with(F.arrays_zip(h, l), before, lambda b, p: F.greatest(b["h"] - b["l"], F.abs(b["h"] - p), F.abs(b["l"] - p)))


def directional_movement() -> tuple[Column, Column]:
    up, down = A.diff(F.col("h")), F.transform(A.diff(F.col("l")), lambda x: -x)
    plus = F.zip_with(up, down, lambda u, d: F.when((u > d) & (u > 0), u).otherwise(0.0))
    minus = F.zip_with(up, down, lambda u, d: F.when((d > u) & (d > 0), d).otherwise(0.0))
    return F.concat(F.array(F.lit(0.0)), plus), F.concat(F.array(F.lit(0.0)), minus)


def with_directional(df: DataFrame, period: int = 14, smoothing: str = "sum", fixed_start: bool = False) -> DataFrame:
    """Adds arrays tr, plus_di, minus_di, dx and adx.

    ADX starts from the mean of ``period`` values of DX, the first of which is the first that exists; with ``fixed_start``
    it is that of bar ``period``, and values missing in between (no movement either way so far) are left out of the mean.
    """
    plus, minus = directional_movement()
    df = df.withColumn("tr", true_range()).withColumn("_p", plus).withColumn("_m", minus)
    df = df.withColumn("_tr", A.smooth(F.col("tr"), period, smoothing)).withColumn("_p", A.smooth(F.col("_p"), period, smoothing)).withColumn("_m", A.smooth(F.col("_m"), period, smoothing))
    di = lambda a: F.zip_with(F.col(a), F.col("_tr"), lambda x, y: F.try_divide(x * 100, y))
    df = df.withColumn("plus_di", di("_p")).withColumn("minus_di", di("_m")).drop("_p", "_m", "_tr")
    df = df.withColumn("dx", F.zip_with("plus_di", "minus_di", lambda p, m: F.try_divide(F.abs(p - m) * 100, p + m)))
    return df.withColumn("adx", A.smooth(F.col("dx"), period, "mean", period - 1 if fixed_start else None))


def directional_bars(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """A row per bar with its directional indicators."""
    return df.select(*by, F.posexplode(F.arrays_zip("tr", "plus_di", "minus_di", "dx", "adx")).alias("bar", "x")).select(*by, "bar", "x.*")


def with_crossovers(df: DataFrame, p: str = "plus_di", m: str = "minus_di", expected: float | None = None) -> DataFrame:
    """Adds crossovers (strict changes of the leading indicator between bars) and the penalty score."""
    d = F.zip_with(p, m, lambda x, y: x - y)
    crossed = A.count(A.lagged(d, 1, lambda x, y: x * y), lambda x: x < 0)
    most = F.lit(float(expected)) if expected is not None else F.size(p) / 2.0
    return df.withColumn("crossovers", crossed).withColumn("crossover_score", F.when(most == 0, 1.0).otherwise(A.clip(1 - F.col("crossovers") / most, 0.0, 1.0)))


def with_persistence(df: DataFrame, p: str = "plus_di", m: str = "minus_di", alpha: float = 0.35) -> DataFrame:
    """Adds four measures of how long one side leads; on a tie the last leader stays."""
    lead = F.zip_with(p, m, lambda x, y: A.sign(x - y))
    first = F.transform(lead, lambda x, i: F.when((i == 0) & (x == 0), 1.0).otherwise(x))
    carried = F.aggregate(first, F.array().cast("array<double>"), lambda s, x: F.array_append(s, F.when(x != 0, x).otherwise(F.element_at(s, -1))))
    df = df.withColumn("_s", carried).withColumn("_g", F.zip_with(p, m, lambda x, y: A.clip(F.abs(x - y) / (x + y + EPS), 0.0, 1.0)))
    df = df.withColumn("_x", F.zip_with("_s", "_g", lambda s, g: s * g))
    n = F.size("_s")
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("len"), F.lit(0.0).alias("m"), F.lit(0.0).alias("score"), F.lit(0.0).alias("runs"))
    close = lambda a: a["score"] + F.when(a["len"] > 0, (a["len"] / n) * (a["len"] / n) * (a["m"] / a["len"])).otherwise(0.0)

    def step(a: Column, x: Column) -> Column:
        same = x["_s"] == a["s"]
        return F.struct(
            x["_s"].alias("s"), F.when(same, a["len"] + 1).otherwise(1.0).alias("len"), F.when(same, a["m"] + x["_g"]).otherwise(x["_g"]).alias("m"),
            F.when(same, a["score"]).otherwise(close(a)).alias("score"), (a["runs"] + F.when(same, 0.0).otherwise(1.0)).alias("runs"),
        )

    df = df.withColumn("_r", F.aggregate(F.arrays_zip("_s", "_g"), zero, step))
    enough = lambda c: F.when(n < 2, 0.0).otherwise(c)
    recent = F.aggregate(A.part(F.col("_x"), 1, n - 1), A.at(F.col("_x"), 0), lambda e, x: x * alpha + e * (1 - alpha))
    df = df.withColumn("persistence_avg", enough(F.try_divide(F.lit(1.0), F.col("_r.runs")))).withColumn("persistence_margin_weighted", enough(A.clip(close(F.col("_r")), 0.0, 1.0)))
    df = df.withColumn("persistence_time_in_control", enough(A.clip(F.abs(A.mean(F.col("_x"))), 0.0, 1.0))).withColumn("persistence_recency_weighted", enough(A.clip(F.abs(recent), 0.0, 1.0)))
    return df.drop("_s", "_g", "_x", "_r")


def trend_quality(df: DataFrame, period: int, use_dx: bool, weights: tuple[float, float, float], least: int, fixed_start: bool = False) -> DataFrame:
    """Adds the quality score and its parts from arrays of bars; null with a reason below ``least`` bars or without a valid value."""
    strength = "dx" if use_dx else "adx"
    d = with_directional(df, period, fixed_start=fixed_start)
    valid = F.filter(F.arrays_zip(strength, "plus_di", "minus_di"), lambda x: x[strength].isNotNull() & x["plus_di"].isNotNull() & x["minus_di"].isNotNull())
    d = d.withColumn("_v", valid).withColumn("_vp", F.col("_v.plus_di")).withColumn("_vm", F.col("_v.minus_di")).withColumn("_vs", F.col(f"_v.{strength}"))
    d = with_persistence(with_crossovers(d, "_vp", "_vm"), "_vp", "_vm")
    error = F.when(F.col("n") < least, "Insufficient data").when(F.size("_v") == 0, "No valid data after warm-up")
    d = d.withColumn("quality_error", error).withColumn("strength_raw", F.when(error.isNull(), F.element_at("_vs", -1)))
    a, b, c = weights
    d = d.withColumn("strength", F.col("strength_raw") / 100.0)
    score = A.clip(a * F.col("strength") + b * F.col("persistence_margin_weighted") + c * F.col("crossover_score"), 0.0, 1.0)
    d = d.withColumn("trend_quality", F.when(error.isNull(), score)).withColumn("dominant_di", F.when(error.isNull(), F.when(F.element_at("_vp", -1) > F.element_at("_vm", -1), "plus").otherwise("minus")))
    parts = ["persistence_avg", "persistence_margin_weighted", "persistence_time_in_control", "persistence_recency_weighted", "crossovers", "crossover_score"]
    d = d.withColumns({x: F.when(error.isNull(), F.col(x)) for x in parts}).withColumn("valid_bars", F.size("_v"))
    return d.drop("_v", "_vp", "_vm", "_vs", "tr", "plus_di", "minus_di", "dx", "adx")


def rolling_atr(period: int) -> Column:
    """Mean true range of up to ``period`` bars, per bar."""
    tr = true_range()
    return F.transform(F.sequence(F.lit(0), F.size(tr) - 1), lambda i: A.mean(A.part(tr, F.greatest(i - period + 1, F.lit(0)), F.least(i + 1, F.lit(period)))))


def with_atr_ratio(df: DataFrame, period: int) -> DataFrame:
    """Adds atr_ratio (median ATR over the whole range) and its signal."""
    span = F.array_max("h") - F.array_min("l")
    df = df.withColumn("atr_ratio", F.when((F.col("n") > 0) & (span != 0), A.median(rolling_atr(period)) / span))
    r = F.col("atr_ratio")
    return df.withColumn("atr_signal", F.when(r.isNull(), "NO_RANGE").when(r < 0.5, "TRENDING").when(r > 0.8, "CONSOLIDATING").otherwise("NEUTRAL"))


def with_range_overlap(df: DataFrame, reference: int = 15, window: int = 10) -> DataFrame:
    """Adds dra_last (rolling mean overlap of later bars with the first bars' range) and dra_inside (share of later bars that overlap it)."""
    top, bottom = F.array_max(A.part(F.col("h"), 0, reference)), F.array_min(A.part(F.col("l"), 0, reference))
    later = F.arrays_zip(A.part(F.col("h"), reference, F.col("n") - reference).alias("h"), A.part(F.col("l"), reference, F.col("n") - reference).alias("l"))
    df = df.withColumn("_top", top).withColumn("_low", bottom).withColumn("_later", later)
    overlap = F.transform("_later", lambda b: F.greatest(F.lit(0.0), F.try_divide(F.least(b["h"], F.col("_top")) - F.greatest(b["l"], F.col("_low")), F.col("_top") - F.col("_low"))))
    df = df.withColumn("_ov", F.when(F.col("_top") > F.col("_low"), overlap).otherwise(F.array().cast("array<double>")))
    k = F.least(F.size("_ov"), F.lit(window))
    df = df.withColumn("dra_last", A.mean(A.part(F.col("_ov"), F.size("_ov") - k, k))).withColumn("dra_inside", F.coalesce(A.share(F.col("_ov"), lambda x: x > 0), F.lit(0.5)))
    return df.drop("_top", "_low", "_later", "_ov")


def _irr(o: Column, h: Column, l: Column, c: Column, least: float = 1e-4) -> Column:
    return F.when(h - l >= least, 1 - F.abs(c - o) / (h - l))


def irr_regime(x: Column) -> Column:
    return F.when(x.isNull(), "unknown").when(x > 0.65, "high_reversion").when(x < 0.35, "directional").otherwise("mixed")


def with_irr(df: DataFrame, k: int = 5) -> DataFrame:
    """Adds reversion ratios of the whole and of k parts (the last takes the rest), regime, extremes' parts, interpretation."""
    size = F.floor(F.col("n") / k).cast("int")
    length = lambda i: F.when(i == k - 1, F.col("n") - size * (k - 1)).otherwise(size)
    cut = lambda c, i: A.part(F.col(c), i * size, length(i))
    parts = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(F.element_at(cut("o", i), 1).alias("o"), F.array_max(cut("h", i)).alias("h"), F.array_min(cut("l", i)).alias("l"), F.element_at(cut("c", i), -1).alias("c")))
    fine = F.col("n") >= k
    df = df.withColumn("_p", F.when(fine, parts)).withColumn("sub_irr", F.transform("_p", lambda p: _irr(p["o"], p["h"], p["l"], p["c"])))
    df = df.withColumn("full_irr", F.when(fine, _irr(F.element_at("o", 1), F.array_max("h"), F.array_min("l"), F.element_at("c", -1))))
    some = A.present(F.col("sub_irr"))
    df = df.withColumn("median_sub_irr", A.median(some)).withColumn("mean_sub_irr", A.mean(some)).withColumn("irr_regime", irr_regime(F.col("median_sub_irr"))).withColumn("directional_strength", 1 - F.col("mean_sub_irr"))
    df = df.withColumn("high_part", (F.array_position("_p.h", F.array_max("_p.h")) - 1).cast("int")).withColumn("low_part", (F.array_position("_p.l", F.array_min("_p.l")) - 1).cast("int"))
    whole, sub = irr_regime(F.col("full_irr")), F.col("irr_regime")
    same = F.when(sub == "directional", "STRONG_TREND").when(sub == "high_reversion", "CONSOLIDATION").otherwise("MIXED_TRANSITIONAL")
    text = F.when(F.col("full_irr").isNull() | F.col("median_sub_irr").isNull(), "INSUFFICIENT_DATA").when(whole == sub, same)
    text = text.when((whole == "directional") & (sub == "high_reversion"), "TREND_EXHAUSTION").when((whole == "high_reversion") & (sub == "directional"), "BREAKOUT_DEVELOPING").otherwise("MIXED_SIGNALS")
    return df.withColumn("irr_interpretation", text).drop("_p")


def windows(df: DataFrame, by: Sequence[str], width: int, step: int) -> DataFrame:
    """A row per window of ``width`` bars every ``step`` bars of each session (arrays cut), with its start."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(step)), lambda s: s + width <= F.col("n"))
    cut = df.withColumn("window_start", F.explode(starts))
    return cut.select(*by, "window_start", F.lit(width).alias("n"), *(A.part(F.col(c), F.col("window_start"), F.lit(width)).alias(c) for c in ("o", "h", "l", "c", "v")))


def last_window(df: DataFrame, width: int) -> DataFrame:
    """The final ``width`` bars of each session; ``enough`` says whether there are that many."""
    k = F.least(F.col("n"), F.lit(width))
    cut = {c: A.part(F.col(c), F.col("n") - k, k) for c in ("o", "h", "l", "c", "v")}
    return df.withColumn("enough", F.col("n") >= width).withColumns(cut).withColumn("n", k)


def _slope(c: Column, start: Column, end: Column) -> Column:
    """Return per bar from start to end (zero-based), over the deviation of log returns if there are two."""
    w = A.part(c, start, end - start + 1)
    raw = (F.element_at(w, -1) / F.element_at(w, 1) - 1) / (end - start)
    d = A.std(A.diff(A.log(w)))
    usable = (end > start) & (A.at(c, start) > 0)
    return F.when(~F.coalesce(usable, F.lit(False)), 0.0).when(end - start < 2, raw).otherwise(raw / F.greatest(d, F.lit(1e-10)))


def with_slope_score(df: DataFrame, k: int = 4, lookback: int = 3, amplitude: float = 0.5, atr_period: int = 14) -> DataFrame:
    """Adds the multi-scale slope score: main slope, k part slopes, prominent extremes, coherence of the path between them, weighted score.

    Sessions with fewer than 2 k bars have nulls.
    """
    n, c = F.col("n"), F.col("c")
    fine = n >= 2 * k
    df = df.withColumn("main_slope", F.when(fine, _slope(c, F.lit(0), n - 1)))
    size = F.floor(n / k).cast("int")
    sub = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: _slope(c, i * size, F.when(i == k - 1, n - 1).otherwise((i + 1) * size - 1)))
    df = df.withColumn("sub_slopes", F.when(fine, sub)).withColumn("atr_value", F.greatest(F.element_at(rolling_atr(atr_period), -1), F.lit(0.0)))
    atr = F.when(F.col("atr_value") == 0, 1e-6).otherwise(F.col("atr_value"))

    def prominent(main: str, other: str, up: bool) -> Column:
        """The first of the most prominent local extremes, as struct(index, prominence)."""
        sgn = 1.0 if up else -1.0
        a, b = F.transform(main, lambda x: x * sgn), F.transform(other, lambda x: x * sgn)
        inner = F.when(n >= 2 * lookback + 1, F.sequence(F.lit(lookback), F.greatest(n - lookback - 1, F.lit(lookback)))).otherwise(F.array().cast("array<int>"))

        def candidate(i: Column) -> Column:
            left, right = (lambda s: A.part(s, i - lookback, F.lit(lookback))), (lambda s: A.part(s, i + 1, F.lit(lookback)))
            high = A.at(a, i)
            rise = high - F.greatest(F.array_min(left(b)), F.array_min(right(b)))
            top = (high > F.array_max(left(a))) & (high > F.array_max(right(a))) & (rise >= amplitude * atr)
            return F.when(top, F.struct(rise.alias("p"), (-i).alias("i")))

        best = F.array_max(F.filter(F.transform(inner, candidate), lambda x: x.isNotNull()))
        return F.when(fine & best.isNotNull(), -best["i"])

    df = df.withColumn("prominent_high", prominent("h", "l", True)).withColumn("prominent_low", prominent("l", "h", False))
    hi, lo, end = F.col("prominent_high"), F.col("prominent_low"), n - 1
    dirn = F.when(F.col("main_slope") > 0, 1.0).otherwise(-1.0)
    fit = lambda s: 0.5 * (1 + F.tanh(s * dirn))
    one, two = F.least(hi, lo), F.greatest(hi, lo)
    # With the trend the leg into its first extreme counts, against it the leg out of the last.
    entry = F.when(F.col("main_slope") > 0, hi).otherwise(lo)
    exit_ = F.when(F.col("main_slope") > 0, lo).otherwise(hi)
    coherence = (
        F.when(hi.isNull() & lo.isNull(), 0.5)
        .when(hi.isNotNull() & lo.isNotNull(), (fit(_slope(c, F.lit(0), one)) + fit(_slope(c, two, end))) / 2)
        .when(entry.isNotNull(), fit(_slope(c, F.lit(0), entry)) * 0.75 + 0.125)
        .otherwise(fit(_slope(c, exit_, end)) * 0.75 + 0.125)
    )
    df = df.withColumn("extrema_coherence_raw", F.when(fine, coherence))
    main, subs = F.col("main_slope"), F.col("sub_slopes")
    flat = F.abs(main) < 1e-6
    consistent = F.when(flat, A.share(subs, lambda s: F.abs(s) < 1e-6)).otherwise(A.share(subs, lambda s: A.sign(s) == A.sign(main)))
    spread, size_ = A.std(subs), A.mean(F.transform(subs, lambda s: F.abs(s)))
    aligned = F.when(F.abs(main) > 1e-6, F.exp(-spread / (F.abs(main) * k**0.5))).when(size_ > 1e-6, 1 / (1 + spread / size_)).otherwise(1.0)
    df = df.withColumn("directional_consistency", consistent).withColumn("slope_alignment", F.when(fine, F.greatest(F.lit(0.1), aligned)))
    df = df.withColumn("extrema_coherence", F.when(fine, F.greatest(F.lit(0.2), F.col("extrema_coherence_raw")))).withColumn("magnitude_score", F.tanh(F.abs(main) * 5))
    score = 0.35 * F.col("directional_consistency") + 0.20 * F.col("slope_alignment") + 0.20 * F.col("extrema_coherence") + 0.25 * F.col("magnitude_score")
    df = df.withColumn("slope_score", F.when(fine, F.round(score, 4)))
    s = F.col("slope_score")
    label = F.when(s >= 0.8, "STRONG_TREND").when(s >= 0.6, "TRENDING_WITH_NOISE").when(s >= 0.4, "MIXED_TRANSITIONAL").when(s >= 0.2, "CHOPPY_CONSOLIDATING").when(s.isNotNull(), "HIGHLY_CHOPPY")
    return df.withColumn("slope_interpretation", label)


def with_efficiency(df: DataFrame) -> DataFrame:
    """Adds net change, path length, efficiency ratio (0 without a path) and direction."""
    c = F.col("c")
    net, path = F.element_at(c, -1) - F.element_at(c, 1), A.total(F.transform(A.diff(c), lambda x: F.abs(x)))
    df = df.withColumn("net_change", net).withColumn("path_length", path).withColumn("efficiency_ratio", F.when(path == 0, 0.0).otherwise(A.clip(F.abs(net) / path, 0.0, 1.0)))
    return df.withColumn("direction", F.when(net > 0, "UP").when(net < 0, "DOWN").otherwise("NEUTRAL"))


def with_variance_ratio(df: DataFrame, lag: int = 4, tolerance: float = 0.05) -> DataFrame:
    """Adds the overlapping variance ratio of log returns, its log and class; null below lag + 1 returns."""
    df = df.withColumn("_r", A.diff(A.log(F.col("c"))))
    one, many = A.variance(F.col("_r")), A.variance(A.frames(F.col("_r"), lag, A.total))
    value = F.when(F.abs(one) <= 1e-8 + 0.0, 1.0).otherwise(F.greatest(many / (lag * one), F.lit(0.0)))
    df = df.withColumn("variance_ratio", F.when(F.size("_r") > lag, value)).drop("_r")
    v = F.col("variance_ratio")
    return df.withColumn("log_variance_ratio", F.when(v.isNotNull(), F.log(F.greatest(v, F.lit(EPS))))).withColumn("variance_class", F.when(v > 1 + tolerance, "persistent").when(v < 1 - tolerance, "mean_reverting").when(v.isNotNull(), "neutral"))


def with_autocorrelation(df: DataFrame, lags: Sequence[int] = (1, 2, 5)) -> DataFrame:
    """Adds biased autocorrelations of log returns; null below ten returns, below five pairs or without variation."""
    df = df.withColumn("_r", A.diff(A.log(F.col("c"))))
    df = df.withColumn("_x", F.transform("_r", lambda x: x - A.mean(F.col("_r"))))
    n, c0 = F.size("_x"), A.total(F.transform("_x", lambda x: x * x))
    for k in lags:
        df = df.withColumn(f"acf_{k}", F.when((n >= 10) & (n - k >= 5) & (c0 != 0), A.total(A.lagged(F.col("_x"), k, lambda a, b: a * b)) / c0))
    return df.drop("_r", "_x")


def with_hurst(df: DataFrame) -> DataFrame:
    """Adds Hurst exponents of log returns: hurst_simple (variance of lagged differences) and hurst_rs (rescaled range)."""
    df = df.withColumn("_r", A.diff(A.log(F.col("c"))))
    n = F.size("_r")
    most = F.least(F.floor(n / 4), F.lit(20)).cast("int")
    lags = F.when(most >= 3, F.sequence(F.lit(2), F.greatest(most, F.lit(2)))).otherwise(F.array().cast("array<int>"))
    pairs = F.filter(F.transform(lags, lambda k: F.struct(F.log(k.cast("double")).alias("x"), A.variance(A.diff(F.col("_r"), k)).alias("v"))), lambda p: p["v"] > 0)
    df = df.withColumn("_p", pairs)
    simple = A.slope(F.col("_p.x"), A.log(F.col("_p.v"))) / 2
    df = df.withColumn("hurst_simple", F.when((n >= 20) & (F.size("_p") >= 3), A.clip(simple, 0.0, 1.0)))
    least, half = F.greatest(F.lit(10), F.floor(n / 10)).cast("int"), F.floor(n / 2).cast("int")
    grow = F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.array(least), lambda w, _: F.array_append(w, F.floor(F.element_at(w, -1) * 1.5).cast("int")))
    sizes = F.when((n >= 30) & (half >= 2 * least), F.filter(grow, lambda w: w <= half)).otherwise(F.array().cast("array<int>"))

    def rescaled(chunk: Column) -> Column:
        m = A.mean(chunk)
        path = F.aggregate(chunk, F.array().cast("array<double>"), lambda z, x: F.array_append(z, F.coalesce(F.try_element_at(z, F.lit(-1)), F.lit(0.0)) + x - m))
        spread, dev = F.array_max(path) - F.array_min(path), A.std(chunk)
        return F.when((dev > 0) & (spread > 0), spread / dev)

    def size_mean(w: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor(n / w).cast("int") - 1), lambda i: rescaled(A.part(F.col("_r"), i * w, w)))
        return A.mean(A.present(chunks))

    found = F.filter(F.transform(sizes, lambda w: F.struct(F.log(w.cast("double")).alias("x"), size_mean(w).alias("v"))), lambda p: p["v"].isNotNull())
    df = df.withColumn("_p", found).withColumn("hurst_rs", F.when((F.size(sizes) >= 2) & (F.size("_p") >= 2), A.clip(A.slope(F.col("_p.x"), A.log(F.col("_p.v"))), 0.0, 1.0)))
    return df.drop("_r", "_p")


def temporal_signal(acf1: Column, hurst: Column) -> Column:
    a, h = acf1, hurst
    return (
        F.when(a.isNull() | h.isNull(), "insufficient_data").when((h > 0.6) & (a > 0.2), "trending").when((h < 0.4) & (a < -0.1), "mean_reverting")
        .when((F.abs(a) < 0.1) & h.between(0.45, 0.55), "random_walk").when(h > 0.5, "weak_trend").otherwise("weak_reversion")
    )


def with_swing_density(df: DataFrame, low: int = 5, high: int = 8) -> DataFrame:
    """Adds the number of strict three-bar swings and its class."""

    def swings(c: str, up: bool) -> Column:
        a = F.col(c)
        inner = F.when(F.col("n") >= 3, F.sequence(F.lit(1), F.greatest(F.col("n") - 2, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        test = (lambda x, y: x > y) if up else (lambda x, y: x < y)
        return F.size(F.filter(inner, lambda i: test(A.at(a, i), A.at(a, i - 1)) & test(A.at(a, i), A.at(a, i + 1))))

    df = df.withColumn("swing_highs", swings("h", True)).withColumn("swing_lows", swings("l", False)).withColumn("swing_count", F.col("swing_highs") + F.col("swing_lows"))
    k = F.col("swing_count")
    return df.withColumn("swing_class", F.when(F.col("n") < 3, "insufficient_data").when(k < low, "trending").when(k > high, "chop").otherwise("mixed"))


def _blocks(count: int = 4) -> Column:
    """Range of each of up to ``count`` near-equal blocks over the whole range."""
    n = F.col("n")
    k = F.least(n, F.lit(count))
    small, extra = F.floor(n / k).cast("int"), n % k
    start = lambda i: i * small + F.least(i, extra)
    length = lambda i: small + F.when(i < extra, 1).otherwise(0)
    span = F.array_max("h") - F.array_min("l")
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: (F.array_max(A.part(F.col("h"), start(i), length(i))) - F.array_min(A.part(F.col("l"), start(i), length(i)))) / (span + EPS))


def with_targets(df: DataFrame) -> DataFrame:
    """Adds descriptive (trend), containment and chop targets and containment features, each in parts and whole."""
    c = F.col("c")
    df = df.withColumn("_r", A.diff(A.log(c))).withColumn("_nz", F.filter("_r", lambda x: x != 0)).withColumn("_span", F.array_max("h") - F.array_min("l"))
    df = df.withColumn("_pos", F.transform("c", lambda x: (x - F.array_min("l")) / (F.col("_span") + EPS))).withColumn("_path", A.total(F.transform(A.diff(c), lambda x: F.abs(x)))).withColumn("_blocks", _blocks())
    m, nz = F.size("_r"), F.size("_nz")
    dev = F.when(m > 1, A.std(F.col("_r"))).otherwise(0.0)
    strength = F.when(m > 0, 1 - F.exp(-F.abs(A.total(F.col("_r"))) / (dev * F.sqrt(m.cast("double")) + EPS))).otherwise(0.0)
    consistency = F.when(nz > 0, 2 * F.greatest(A.share(F.col("_nz"), lambda x: x > 0), A.share(F.col("_nz"), lambda x: x < 0)) - 1).otherwise(0.0)
    flip = F.when(nz > 1, A.flips(F.col("_nz")) / (nz - 1)).otherwise(0.0)
    move = A.clip(F.abs(F.element_at(c, -1) - F.element_at("o", 1)) / (F.col("_span") + EPS), 0.0, 1.0)
    waste = A.clip(F.col("_path") / (F.col("_span") + EPS), 0.0, 4.0) / 4
    p = F.col("_pos")
    edge = A.clip(2 * F.least(A.share(p, lambda x: x >= 2 / 3), A.share(p, lambda x: x <= 1 / 3)), 0.0, 1.0)
    inside = A.share(p, lambda x: (x >= 0.05) & (x <= 0.95))
    unstable = A.clip(A.std(F.col("_blocks"), 0), 0.0, 1.0)
    df = df.withColumns({"target_strength": strength, "target_consistency": consistency, "target_smoothness": 1 - flip, "target_retention": move})
    df = df.withColumn("descriptive_target", A.clip(0.35 * F.col("target_strength") + 0.25 * F.col("target_consistency") + 0.2 * F.col("target_smoothness") + 0.2 * F.col("target_retention"), 0.0, 1.0))
    df = df.withColumns({"containment_displacement": 1 - move, "containment_edge_balance": edge, "containment_inside_share": inside, "containment_path_efficiency": 1 - waste})
    df = df.withColumn("containment_target", A.clip(0.3 * F.col("containment_displacement") + 0.3 * F.col("containment_edge_balance") + 0.25 * F.col("containment_inside_share") + 0.15 * F.col("containment_path_efficiency"), 0.0, 1.0))
    df = df.withColumns({"chop_path_waste": waste, "chop_flip_rate": flip, "chop_outside_share": A.share(p, lambda x: (x < 0.05) | (x > 0.95)), "chop_instability": unstable})
    df = df.withColumn("chop_score", A.clip(0.35 * F.col("chop_path_waste") + 0.3 * F.col("chop_flip_rate") + 0.2 * F.col("chop_outside_share") + 0.15 * F.col("chop_instability"), 0.0, 1.0))
    over = A.mean(F.transform("_pos", lambda x: F.greatest(F.lit(0.0), 0.05 - x) + F.greatest(F.lit(0.0), x - 0.95)))
    sides = F.filter(F.transform("c", lambda x: A.sign(x - (F.array_max("h") + F.array_min("l")) / 2)), lambda x: x != 0)
    d = A.diff(c)
    up, down = A.total(F.filter(d, lambda x: x > 0)), -A.total(F.filter(d, lambda x: x < 0))
    symmetry = F.when((up <= 0) | (down <= 0), 0.0).otherwise(1 - F.abs(up - down) / (up + down + EPS))
    df = df.withColumns({"containment_overshoot_ratio": over, "containment_range_stability": 1 - unstable, "containment_mid_cross_count": F.when(F.size(sides) > 1, A.flips(sides) / (F.size(sides) - 1)).otherwise(0.0), "containment_swing_symmetry": symmetry})
    return df.drop("_r", "_nz", "_span", "_pos", "_path", "_blocks")


def with_expansion(df: DataFrame, balance: int | None = None, band: int = 10) -> DataFrame:
    """Adds initial-balance extension and asymmetry, bandwidth squeeze, VWAP acceptance and tail rejection."""
    n, k = F.col("n"), (F.least(F.lit(balance), F.col("n")) if balance else F.col("n"))
    top, low = F.array_max(A.part(F.col("h"), 0, k)), F.array_min(A.part(F.col("l"), 0, k))
    df = df.withColumn("_up", F.greatest(F.lit(0.0), F.array_max("h") - top) / (top - low + EPS)).withColumn("_dn", F.greatest(F.lit(0.0), low - F.array_min("l")) / (top - low + EPS))
    df = df.withColumn("containment_ib_extension_ratio", F.col("_up") + F.col("_dn")).withColumn("containment_ib_asymmetry", F.abs(F.col("_up") - F.col("_dn")) / (F.col("_up") + F.col("_dn") + EPS))
    widths = A.frames(F.col("c"), F.least(n, F.lit(band)), lambda w: 4 * A.std(w, 0) / (F.abs(A.mean(w)) + EPS))
    df = df.withColumn("containment_bandwidth_squeeze", F.coalesce(1 / (1 + A.mean(widths)), F.lit(1.0)))
    bars = F.arrays_zip("o", "h", "l", "c", "v")
    zero = F.struct(F.lit(0.0).alias("pv"), F.lit(0.0).alias("v"), F.lit(0.0).alias("d"))

    def step(a: Column, b: Column) -> Column:
        pv, v = a["pv"] + (b["h"] + b["l"] + b["c"]) / 3 * b["v"], a["v"] + b["v"]
        return F.struct(pv.alias("pv"), v.alias("v"), (a["d"] + F.abs(b["c"] - pv / (v + EPS))).alias("d"))

    span = F.array_max("h") - F.array_min("l")
    df = df.withColumn("containment_vwap_acceptance", 1 - A.clip(F.aggregate(bars, zero, step)["d"] / n / (span + EPS), 0.0, 1.0))
    tail = lambda f: A.share(bars, lambda b: f(b) / (b["h"] - b["l"] + EPS) >= 0.4)
    reject = 2 * F.least(tail(lambda b: b["h"] - F.greatest(b["o"], b["c"])), tail(lambda b: F.least(b["o"], b["c"]) - b["l"]))
    return df.withColumn("containment_excess_rejection", reject).drop("_up", "_dn")


def signals(df: DataFrame) -> dict[str, Column]:
    """The ensemble's inputs (0 range to 1 trend) out of feature columns; null where a feature is."""
    spd = F.when(F.col("swing_class") == "trending", 1.0).when(F.col("swing_class") == "mixed", 0.5).when(F.col("swing_class") == "chop", 0.0)
    return {
        "adx": F.col("trend_quality"), "atr_range": A.clip(1 - F.col("atr_ratio"), 0.0, 1.0), "dra": A.clip(1 - F.col("dra_inside"), 0.0, 1.0), "irr": A.clip(F.col("directional_strength"), 0.0, 1.0),
        "lag": F.coalesce("hurst_rs", "hurst_simple"), "mss": F.col("slope_score"), "spd": spd,
    }


def with_state(df: DataFrame, weights: Mapping[str, float] = WEIGHTS, dynamic: bool = True, kappa: float = 4.0, shift: float = 0.5, gate: float = 0.3) -> DataFrame:
    """Adds the composite signal, confidence, state and direction of the ensemble.

    Weights tilt with the Hurst exponent; signals that failed (null) drop out
    and the others are reweighted.
    """
    found = signals(df)
    tilt = shift * F.tanh(kappa * (F.coalesce(found["lag"], F.lit(0.5)) - 0.5)) if dynamic else F.lit(0.0)
    w = {k: x * A.clip(1 + LEANING[k] * tilt, 0.5, 1.5) for k, x in weights.items()}
    zero = F.lit(0.0)
    top = sum((F.coalesce(found[k] * w[k], zero) for k in w), zero)
    bottom = sum((F.when(found[k].isNotNull(), w[k]).otherwise(zero) for k in w), zero)
    df = df.withColumn("composite_signal", ratio(top, bottom)).withColumn("confidence", F.coalesce(F.abs(F.col("composite_signal") - 0.5) * 2, zero))
    s = F.col("composite_signal")
    state = F.when(s.isNull() | (F.col("confidence") < gate), "UNCERTAIN").when(s >= 0.7, "STRONG_TREND").when(s >= 0.55, "WEAK_TREND").when(s <= 0.3, "CHOPPY").when(s <= 0.45, "CONSOLIDATION").otherwise("WEAK_TREND")
    change = F.element_at("c", -1) / F.element_at("c", 1) - 1
    return df.withColumn("state", state).withColumn("trend_direction", F.when(F.col("n") < 2, "NEUTRAL").when(change > 0.001, "UP").when(change < -0.001, "DOWN").otherwise("NEUTRAL"))


def features(df: DataFrame, quality: tuple = QUALITY["1pm-3pm"], balance: int | None = 15, atr_period: int = 10, reference: int = 15, fixed_start: bool = False) -> DataFrame:
    """All features of sessions of one kind; trend quality, ATR ratio and swings are taken on coarser bars.

    The first half is written before the second is built on it: one plan of all features takes the driver longer to
    analyse, step by step, than a cluster to read the sessions' arrays once more.
    """
    minutes, period, use_dx, weights, least = quality
    bars = ("n", "t", "o", "h", "l", "c", "v")
    aside = df.withColumns({f"_fine_{c}": F.col(c) for c in bars})
    coarse = with_swing_density(with_atr_ratio(trend_quality(coarser(aside, minutes), period, use_dx, weights, least, fixed_start), atr_period))
    fine = coarse.withColumns({c: F.col(f"_fine_{c}") for c in bars}).drop(*(f"_fine_{c}" for c in bars))
    half = materialize(with_slope_score(with_irr(with_range_overlap(fine, reference))))
    return with_expansion(with_targets(with_hurst(with_autocorrelation(with_variance_ratio(with_efficiency(half))))), balance)


def modeling_table(bars: DataFrame, by: Sequence[str], at: str, **options) -> DataFrame:
    """One row per session with all features, the ensemble state and ``feature_status`` (``ok`` or what is missing)."""
    out = with_state(features(materialize(sessions(bars, by, at)), **options))
    needed = {"adx_quality": "trend_quality", "mss": "slope_score", "irr": "mean_sub_irr", "er": "efficiency_ratio", "log_vr": "log_variance_ratio", "dra": "dra_last", "atr": "atr_ratio", "hurst": "hurst_simple"}
    missing = F.concat_ws(";", *(F.when(F.col(c).isNull(), F.lit(k)) for k, c in needed.items()))
    return out.withColumn("feature_status", F.when(missing == "", "ok").otherwise(F.concat(F.lit("missing:"), missing))).drop("t", "o", "h", "l", "c", "v")


def with_labels(df: DataFrame, trend: str = "descriptive_target", containment: str = "containment_target", chop: str = "chop_score", trend_high: float = 0.6, containment_high: float = 0.6, chop_high: float = 0.6, low: float = 0.45, chop_cap: float = 0.55, uncertain: str = "uncertain", drop_uncertain: bool = False) -> DataFrame:
    """Adds label: trend, containment or chop (a later rule wins), else ``uncertain``."""
    t, k, x = F.col(trend), F.col(containment), F.col(chop)
    label = (
        F.when((x >= chop_high) & (t <= low) & (k <= low), "chop").when((k >= containment_high) & (t <= low) & (x <= chop_cap), "containment")
        .when((t >= trend_high) & (k <= low) & (x <= low), "trend").otherwise(uncertain)
    )
    df = df.withColumn("label", label)
    return df.where(F.col("label") != uncertain) if drop_uncertain else df


def daily_temporal(df: DataFrame, day: str, session: str, kinds: Mapping[str, str]) -> DataFrame:
    """One row per day with the memory features of its sessions side by side (session name to prefix)."""
    signal = temporal_signal(F.col("acf_1"), F.col("hurst_simple"))
    columns = {"acf_1": F.col("acf_1"), "acf_2": F.col("acf_2"), "acf_5": F.col("acf_5"), "hurst": F.coalesce("hurst_rs", "hurst_simple"), "signal": signal}
    return df.groupBy(day).agg(*(F.max(F.when(F.col(session) == s, c)).alias(f"{p}_{k}") for s, p in kinds.items() for k, c in columns.items()))

