"""Day outcomes, extremes and their timing, ranges of nested windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import decile, guarded_corr, pct, quantile_linear, quantile_nearest, ratio, share, sign_or_zero, unpivot
from ..functions.timecols import ZONE, complete_days, second_of_day, wall
from ..sources.ticks import order_key, price

POSITIVE = lambda c: F.greatest(F.lit(0.0), c)


def _when(inside: Column, c: Column | str) -> Column:
    return F.when(inside, F.col(c) if isinstance(c, str) else c)


def window_ohlc(inside: Column, at: Column | str, prefix: str, o="Open", h="High", l="Low", c="Close") -> list[Column]:
    """Open, high, low, close of the rows inside, as aggregates of one pass."""
    at = F.col(at) if isinstance(at, str) else at
    return [
        F.min_by(_when(inside, o), _when(inside, at)).alias(f"{prefix}_open"), F.max(_when(inside, h)).alias(f"{prefix}_high"),
        F.min(_when(inside, l)).alias(f"{prefix}_low"), F.max_by(_when(inside, c), _when(inside, at)).alias(f"{prefix}_close"),
    ]


def first_at(inside: Column, value: Column | str, at: Column | str, largest: bool) -> Column:
    """The earliest ``at`` of the rows inside whose value is the extreme (an aggregate)."""
    value, at = (F.col(x) if isinstance(x, str) else x for x in (value, at))
    return F.min_by(_when(inside, at), F.when(inside, F.struct((-value if largest else value).alias("v"), at.alias("t"))))


def direction_state(direction: Column | str, close_pos: Column | str, up: float = 0.7, down: float = 0.3) -> Column:
    d, p = (F.col(x) if isinstance(x, str) else x for x in (direction, close_pos))
    return F.when((d > 0) & (p > up), "bullish").when((d < 0) & (p < down), "bearish").otherwise("neutral")


def daily_outcomes(bars: DataFrame, day: str, minute: str, window: tuple[int, int], post: tuple[int, int], label: str = "UNLABELED") -> DataFrame:
    """One row per day with bars in ``window`` (inclusive minutes): OHLC, range, direction, skew, first times of the extremes, range after."""
    inside, after = F.col(minute).between(*window), F.col(minute).between(*post)
    out = bars.groupBy(day).agg(
        *window_ohlc(inside, minute, "macro"), F.min(_when(inside, minute)).alias("_first"),
        first_at(inside, "High", minute, True).alias("_high_at"), first_at(inside, "Low", minute, False).alias("_low_at"),
        (F.max(_when(after, "High")) - F.min(_when(after, "Low"))).alias("postclose_range_points"),
    ).where("_first is not null")
    out = out.withColumn("macro_range_points", F.col("macro_high") - F.col("macro_low")).withColumn("macro_dir_points", F.col("macro_close") - F.col("macro_open"))
    up, down = F.col("macro_high") - F.col("macro_open"), F.col("macro_open") - F.col("macro_low")
    return out.select(
        F.col(day).alias("date"), "macro_open", "macro_close", "macro_high", "macro_low", "macro_range_points", pct("macro_range_points", "macro_open").alias("macro_range_pct"),
        "macro_dir_points", pct("macro_dir_points", "macro_open").alias("macro_dir_pct"), ratio(up - down, "macro_range_points").alias("skew_ratio"),
        ratio(F.col("macro_close") - F.col("macro_low"), "macro_range_points").alias("close_in_range"), (F.col("_high_at") - F.col("_first")).alias("macro_high_time"),
        (F.col("_low_at") - F.col("_first")).alias("macro_low_time"), "postclose_range_points", pct("postclose_range_points", "macro_open").alias("postclose_range_pct"), F.lit(label).alias("macro_type"),
    )


def join_regime_context(macro: DataFrame, regimes: DataFrame, sessions: Mapping[str, str], columns: Sequence[str]) -> DataFrame:
    """Each session's regime columns, prefixed, beside the day (one pass over the regimes, one left join)."""
    cells = [F.max(_when(F.col("session_name") == s, c)).alias(f"{prefix}_{c}") for s, prefix in sessions.items() for c in columns]
    wide = regimes.groupBy(F.col("trade_date").cast("date").alias("date")).agg(*cells)
    return macro.join(wide, "date", "left")


def session_features(bars: DataFrame, day: str, minute: str, spans: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Per day, for each half-open span: OHLC, range, direction, close position, volume, first offsets of the extremes, state."""
    aggregates = []
    for name, (a, b) in spans.items():
        inside = (F.col(minute) >= a) & (F.col(minute) < b)
        aggregates += [F.count_if(inside).alias(f"bars_{name}"), *window_ohlc(inside, minute, name), F.sum(_when(inside, "Volume")).alias(f"{name}_volume")]
        aggregates += [(first_at(inside, "High", minute, True) - a).alias(f"{name}_high_time"), (first_at(inside, "Low", minute, False) - a).alias(f"{name}_low_time")]
    out = bars.groupBy(F.col(day).alias("date")).agg(*aggregates)
    for name in spans:
        out = out.withColumn(f"{name}_range", F.col(f"{name}_high") - F.col(f"{name}_low")).withColumn(f"{name}_dir", F.col(f"{name}_close") - F.col(f"{name}_open"))
        out = out.withColumn(f"{name}_close_pos", ratio(F.col(f"{name}_close") - F.col(f"{name}_low"), f"{name}_range")).withColumn(f"{name}_dir_ratio", ratio(F.abs(f"{name}_dir"), f"{name}_range"))
        out = out.withColumn(f"{name}_high_first", F.col(f"{name}_high_time") <= F.col(f"{name}_low_time")).withColumn(f"{name}_trend_state", direction_state(f"{name}_dir", f"{name}_close_pos"))
    return out


def interaction(before: DataFrame, macro: DataFrame, span: str = "hr3", outer: str = "pm", offset: int = 50, bucket: int = 5) -> DataFrame:
    """Days of both: combined range and shares, signs, which side of the earlier range was taken, buckets of the extremes' times."""
    df = before.join(macro, "date")
    high, low = F.greatest(f"{span}_high", "macro_high"), F.least(f"{span}_low", "macro_low")
    both = F.when(F.col(f"{span}_high").isNotNull() & F.col("macro_high").isNotNull(), high - low)
    df = df.withColumn("combined_range_points", both)
    df = df.withColumn("span_range_share_pct", pct(f"{span}_range", "combined_range_points")).withColumn("macro_range_share_pct", pct("macro_range_points", "combined_range_points"))
    for name, c in (("pm", f"{outer}_dir"), ("span", f"{span}_dir"), ("macro", "macro_dir_points")):
        df = df.withColumn(f"{name}_dir_sign", sign_or_zero(c))
    df = df.withColumn("took_high", F.col("macro_high") > F.col(f"{span}_high")).withColumn("took_low", F.col("macro_low") < F.col(f"{span}_low"))
    df = df.withColumn("took_both", F.col("took_high") & F.col("took_low"))
    for side, cmp in (("high", F.col("macro_high") > F.col(f"{span}_high")), ("low", F.col("macro_low") < F.col(f"{span}_low"))):
        df = df.withColumn(f"{side}_bucket", (F.floor(F.col(f"{span}_{side}_time") / bucket) * bucket).cast("int"))
        inclusive = F.when(cmp, F.col(f"macro_{side}_time") + offset).otherwise(F.col(f"{span}_{side}_time"))  # a tie belongs to the earlier
        df = df.withColumn(f"inclusive_{side}_time", inclusive).withColumn(f"inclusive_{side}_bucket", (F.floor(inclusive / bucket) * bucket).cast("int"))
    return df


def bucket_share(df: DataFrame, bucket: str, by: Sequence[str]) -> DataFrame:
    """Count and percent of days per bucket within groups."""
    counted = df.where(F.col(bucket).isNotNull()).groupBy(*by, F.col(bucket).alias("bucket")).agg(F.count("*").alias("days"))
    total = counted.groupBy(*by).agg(F.sum("days").alias("_all"))
    return counted.join(total, list(by)).withColumn("pct_of_days", pct("days", "_all")).drop("_all")


def breakout_rates(df: DataFrame) -> DataFrame:
    """Percent of days that took any, one, both or no side, and that went with or against the earlier direction."""
    any_ = F.col("took_high") | F.col("took_low")
    signed = (F.col("pm_dir_sign") != 0) & (F.col("macro_dir_sign") != 0)
    same = F.col("pm_dir_sign") == F.col("macro_dir_sign")
    return df.agg(
        F.count("*").alias("days"), (share(any_) * 100).alias("took_any_pct"), (share(any_ & ~F.col("took_both")) * 100).alias("took_one_pct"), (share(F.col("took_both")) * 100).alias("took_both_pct"),
        (share(~any_) * 100).alias("took_none_pct"), F.count_if(signed).alias("signed_days"), (share(F.when(signed, same)) * 100).alias("continued_pct"), (share(F.when(signed, ~same)) * 100).alias("against_pct"),
    )


def extreme_timing(ticks: DataFrame, keys: Sequence[int], seconds: int = 60, window: tuple[int, int] = (15 * 3600 + 50 * 60, 16 * 3600), complete: bool = True, zone: str = ZONE) -> DataFrame:
    """Per day and key bucket (index of ``seconds`` in the window): OHLCV from ordered ticks and when each extreme was first touched.

    With ``complete`` only days with ticks in all key buckets stay. The day's
    open, close and state are over the whole window.
    """
    local = wall("ts", zone)
    sec = second_of_day(local)
    kept = ticks.where((sec >= window[0]) & (sec < window[1])).select(F.to_date(local).alias("date"), F.floor((sec - window[0]) / seconds).cast("int").alias("key"), "ts_ns", "intra_ts_rank", price().alias("p"), "size")
    at = order_key()
    day = kept.groupBy("date").agg(F.min_by("p", at).alias("macro_open"), F.max_by("p", at).alias("macro_close"), F.max("p").alias("_h"), F.min("p").alias("_l"))
    day = day.withColumn("macro_dir_points", F.col("macro_close") - F.col("macro_open"))
    day = day.withColumn("macro_trend_state", direction_state("macro_dir_points", ratio(F.col("macro_close") - F.col("_l"), F.col("_h") - F.col("_l")))).drop("_h", "_l")
    kept = kept.where(F.col("key").isin(*keys))
    if complete:
        kept = complete_days(kept, "date", "key", keys)
    touch = lambda v: F.min_by("ts_ns", F.struct(v.alias("v"), "ts_ns", "intra_ts_rank"))
    candles = kept.groupBy("date", "key").agg(
        F.min_by("p", at).alias("candle_open"), F.max("p").alias("candle_high"), F.min("p").alias("candle_low"), F.max_by("p", at).alias("candle_close"), F.sum("size").alias("candle_volume"),
        touch(-F.col("p")).alias("candle_high_ns"), touch(F.col("p")).alias("candle_low_ns"),
    )
    within = lambda ns: (F.floor(F.col(ns) / 1_000_000_000) % seconds).cast("int")
    candles = candles.withColumn("candle_high_time", within("candle_high_ns")).withColumn("candle_low_time", within("candle_low_ns"))
    candles = candles.withColumn("candle_high_first", F.col("candle_high_ns") <= F.col("candle_low_ns"))
    candles = candles.withColumn("candle_extreme_gap_seconds", F.floor(F.abs(F.col("candle_high_ns") - F.col("candle_low_ns")) / 1_000_000_000))
    candles = candles.withColumn("candle_dir_points", F.col("candle_close") - F.col("candle_open"))
    candles = candles.withColumn("candle_trend_state", direction_state("candle_dir_points", ratio(F.col("candle_close") - F.col("candle_low"), F.col("candle_high") - F.col("candle_low"))))
    return candles.join(day, "date")


def extreme_timing_summary(timing: DataFrame) -> DataFrame:
    """Per state, key and extreme: location and spread of its time, gap, share of days with the high first."""
    long = timing.select("macro_trend_state", "key", "candle_extreme_gap_seconds", "candle_high_first", F.expr("stack(2, 'high', candle_high_time, 'low', candle_low_time) AS (extreme, time)"))
    qs = [quantile_nearest("time", q).alias(f"p{round(q * 100)}_time") for q in (0.1, 0.25, 0.75, 0.9)]
    return long.groupBy("macro_trend_state", "key", "extreme").agg(
        F.count("*").alias("sample_size"), F.avg("time").alias("mean_time"), F.median("time").alias("median_time"), F.stddev_samp("time").alias("std_time"), *qs,
        F.avg("candle_extreme_gap_seconds").alias("mean_gap_seconds"), F.median("candle_extreme_gap_seconds").alias("median_gap_seconds"), (share(F.col("candle_high_first")) * 100).alias("high_first_pct"),
    )


def extreme_second_counts(timing: DataFrame, n: int = 60) -> DataFrame:
    """Per state, key and extreme how often it fell on each of ``n`` units, zeros kept."""
    long = timing.select("macro_trend_state", "key", F.expr("stack(2, 'high', candle_high_time, 'low', candle_low_time) AS (extreme, unit)"))
    keys = long.select("macro_trend_state", "key", "extreme").distinct().withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    counted = long.groupBy("macro_trend_state", "key", "extreme", "unit").agg(F.count("*").alias("days"))
    return keys.join(counted, ["macro_trend_state", "key", "extreme", "unit"], "left").withColumn("days", F.coalesce("days", F.lit(0)))


def with_trend_extremes(timing: DataFrame, late: int = 45) -> DataFrame:
    """Per state and key: time of the extreme that ends the trend, share of late ones, which extreme came first."""
    up = F.col("macro_trend_state") == "bullish"
    df = timing.where(F.col("macro_trend_state").isin("bullish", "bearish")).withColumn("with_trend_time", F.when(up, F.col("candle_high_time")).otherwise(F.col("candle_low_time")))
    h, l = F.col("candle_high_time"), F.col("candle_low_time")
    return df.groupBy("macro_trend_state", "key").agg(
        F.count("*").alias("sample_size"), F.avg("with_trend_time").alias("mean_time"), F.median("with_trend_time").alias("median_time"), (share(F.col("with_trend_time") >= late) * 100).alias("late_pct"),
        (share(h < l) * 100).alias("high_first_pct"), (share(l < h) * 100).alias("low_first_pct"), (share(h == l) * 100).alias("same_second_pct"),
    )


def barrier_study(timing: DataFrame, first_key: int, barrier: int = 10) -> DataFrame:
    """Per directional day whether the first candle's extreme against the trend stayed the day's extreme.

    The day's extreme is over the key candles; ties go to the earlier candle,
    then the earlier second.
    """
    days = timing.where(F.col("macro_trend_state").isin("bullish", "bearish"))
    up = F.col("macro_trend_state") == "bullish"
    here = F.col("key") == first_key
    pick = lambda c: F.max(F.when(here, F.col(c)))
    low, high = F.struct("candle_low", "key", "candle_low_time"), F.struct((-F.col("candle_high")).alias("v"), "key", "candle_high_time")
    day = days.groupBy("date", "macro_trend_state").agg(
        F.max("macro_open").alias("macro_open"), F.max("macro_close").alias("macro_close"), F.count_if(here).alias("_n"), pick("candle_low").alias("first_low"), pick("candle_low_time").alias("first_low_time"),
        pick("candle_high").alias("first_high"), pick("candle_high_time").alias("first_high_time"), F.min(low).alias("_low"), F.min(high).alias("_high"),
    ).where("_n > 0")
    by = lambda a, b: F.when(up, a).otherwise(b)
    day = day.withColumn("macro_low", F.col("_low.candle_low")).withColumn("macro_high", -F.col("_high.v"))
    day = day.withColumn("barrier_extreme", by(F.lit("low"), F.lit("high"))).withColumn("barrier_price", by(F.col("first_low"), F.col("first_high")))
    day = day.withColumn("barrier_time", by(F.col("first_low_time"), F.col("first_high_time"))).withColumn("macro_extreme", by(F.col("macro_low"), F.col("macro_high")))
    day = day.withColumn("macro_extreme_key", by(F.col("_low.key"), F.col("_high.key"))).withColumn("macro_extreme_time", by(F.col("_low.candle_low_time"), F.col("_high.candle_high_time")))
    day = day.withColumn("barrier_first10", F.col("barrier_time") < barrier).withColumn("barrier_is_macro_extreme", F.col("barrier_price") == F.col("macro_extreme"))
    day = day.withColumn("barrier_holds", F.col("barrier_first10") & F.col("barrier_is_macro_extreme")).withColumn("edge_case", ~F.col("barrier_is_macro_extreme"))
    day = day.withColumn("extreme_after_points", F.abs(F.col("barrier_price") - F.col("macro_extreme"))).withColumn("extreme_after_keys", F.when(F.col("edge_case"), F.col("macro_extreme_key") - first_key))
    return day.drop("_low", "_high", "_n")


def barrier_summary(study: DataFrame) -> DataFrame:
    """Rates per direction, over all its days, those with an early barrier and the others."""
    scoped = study.withColumn("part", F.explode(F.array(F.lit("all"), F.when(F.col("barrier_first10"), "first10").otherwise("after10"))))
    edge = F.when(F.col("edge_case"), F.col("extreme_after_points"))
    return scoped.groupBy("macro_trend_state", "part").agg(
        F.count("*").alias("sample_size"), *((share(F.col(c)) * 100).alias(f"{c}_pct") for c in ("barrier_first10", "barrier_is_macro_extreme", "barrier_holds", "edge_case")),
        F.avg(edge).alias("avg_extreme_after_points"), F.median(edge).alias("median_extreme_after_points"),
    )


def edge_cases(study: DataFrame) -> DataFrame:
    return study.where("edge_case").orderBy("date")


def range_context(ticks: DataFrame, candles: Mapping[str, int], windows: Mapping[str, tuple[int, int]], candle_seconds: int = 60, macro: tuple[int, int] = (15 * 3600 + 50 * 60, 16 * 3600), zone: str = ZONE) -> DataFrame:
    """Per day, candle and window (inclusive units of the candle): range, its shares of candle and macro, how far both extend it.

    ``candles`` gives the start of each in seconds of the day. Ticks fan out
    to the windows they lie in (a fixed few) and meet in one grouped pass;
    days need a tick in every candle.
    """
    local = wall("ts", zone)
    sec = second_of_day(local)
    kept = ticks.select(F.to_date(local).alias("date"), sec.alias("sec"), F.struct("ts_ns", "intra_ts_rank").alias("at"), price().alias("p")).where((F.col("sec") >= macro[0]) & (F.col("sec") < macro[1]))
    stats = lambda prefix: [F.count("*").alias(f"{prefix}_tick_count"), F.min_by("p", "at").alias(f"{prefix}_open"), F.max("p").alias(f"{prefix}_high"), F.min("p").alias(f"{prefix}_low"), F.max_by("p", "at").alias(f"{prefix}_close")]
    name, start = F.lit(None).cast("string"), F.lit(None).cast("int")
    for c, s in candles.items():
        inside = (F.col("sec") >= s) & (F.col("sec") < s + candle_seconds)
        name, start = F.when(inside, c).otherwise(name), F.when(inside, F.lit(s)).otherwise(start)
    placed = kept.withColumn("candle", name).withColumn("unit", F.floor((F.col("sec") - start) * 60 / candle_seconds).cast("int"))
    day = kept.groupBy("date").agg(*stats("macro"))
    last = max(candles.values())
    before = kept.where(F.col("sec") < last).groupBy("date").agg(F.max("p").alias("before_high"), F.min("p").alias("before_low"))
    whole = placed.where("candle is not null").groupBy("date", "candle").agg(*stats("candle"))
    full = whole.groupBy("date").agg(F.count("*").alias("_n")).where(F.col("_n") == len(candles)).select("date")
    spans = [F.struct(F.lit(w).alias("window"), F.lit(a).alias("window_start"), F.lit(b).alias("window_end")) for w, (a, b) in windows.items()]
    spread = placed.where("candle is not null").withColumn("s", F.explode(F.filter(F.array(*spans), lambda s: F.col("unit").between(s["window_start"], s["window_end"]))))
    parts = spread.groupBy("date", "candle", F.col("s.window").alias("window")).agg(*stats("window"))
    grid = whole.join(full, "date", "left_semi").withColumn("s", F.explode(F.array(*spans))).select("*", "s.window", "s.window_start", "s.window_end").drop("s")
    df = grid.join(parts, ["date", "candle", "window"], "left").join(day, "date").join(before, "date", "left")
    df = df.withColumn("window_tick_count", F.coalesce("window_tick_count", F.lit(0)))
    for x in ("window", "candle", "macro"):
        df = df.withColumn(f"{x}_range_points", F.col(f"{x}_high") - F.col(f"{x}_low"))
    df = df.withColumn("range_raw_pct_of_open", pct("window_range_points", "candle_open")).withColumn("range_pct_of_candle", pct("window_range_points", "candle_range_points")).withColumn("range_pct_of_macro", pct("window_range_points", "macro_range_points"))
    for x in ("candle", "macro"):
        df = df.withColumn(f"{x}_extension_points", POSITIVE(F.col(f"{x}_high") - F.col("window_high")) + POSITIVE(F.col("window_low") - F.col(f"{x}_low")))
        df = df.withColumn(f"{x}_extension_points", F.when(F.col("window_high").isNotNull(), F.col(f"{x}_extension_points"))).withColumn(f"{x}_extension_pct", pct(f"{x}_extension_points", f"{x}_range_points"))
    final = (F.col("candle") == max(candles, key=candles.get)) & F.col("before_high").isNotNull()
    added = POSITIVE(F.col("candle_high") - F.col("before_high")) + POSITIVE(F.col("before_low") - F.col("candle_low"))
    return df.withColumn("added_by_last_points", F.when(final, added)).withColumn("added_by_last_pct_of_macro", pct("added_by_last_points", "macro_range_points")).drop("before_high", "before_low")


RANGE_METRICS = ("range_pct_of_candle", "range_pct_of_macro", "candle_extension_pct")


def range_context_summary(study: DataFrame, thresholds: Sequence[float] = (25.0, 50.0, 75.0, 90.0), metrics: Sequence[str] = RANGE_METRICS) -> DataFrame:
    """Baselines, threshold hit rates and deciles per candle and window, as one long table."""
    some = study.where("window_range_points is not null")
    figures = ["window_range_points", "range_raw_pct_of_open", "range_pct_of_candle", "range_pct_of_macro", "candle_extension_points", "macro_extension_points"]
    base = some.groupBy("candle", "window").agg(F.count("*").alias("n_days"), *(F.median(c).alias(f"median_{c}") for c in figures), *(F.avg(c).alias(f"mean_{c}") for c in figures[:4]))
    long = unpivot(study, ["date", "candle", "window", "window_range_points"], list(metrics)).where("value is not null")
    hits = long.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).groupBy("candle", "window", "metric", "threshold")
    hits = hits.agg(F.count("*").alias("n_days"), F.count_if(F.col("value") >= F.col("threshold")).alias("hit_count"), F.median("value").alias("median_metric")).withColumn("hit_rate", ratio("hit_count", "n_days"))
    tenths = decile(long, ["candle", "window", "metric"], "value", "decile", ["date"], 10, 10).where("decile is not null")
    tenths = tenths.groupBy("candle", "window", "metric", "decile").agg(F.count("*").alias("n_days"), F.median("value").alias("median_metric"), F.median("window_range_points").alias("median_window_range_points"))
    parts = [df.withColumn("summary_type", F.lit(n)) for n, df in (("window_baseline", base), ("threshold", hits), ("decile", tenths))]
    return parts[0].unionByName(parts[1], True).unionByName(parts[2], True)


def stage_stats(bars: DataFrame, day: str, minute: str, macro: tuple[int, int], split: int, keys: Sequence[int], min_bars: int = 5) -> DataFrame:
    """Per day the two stages and key candles of the macro: range, skew, what each adds to the range, how the last candle behaves.

    ``split`` is the first minute of the second stage; ``keys`` are three
    candles, the last of which closes the macro.
    """
    m = F.col(minute)
    spans = {"macro": m.between(*macro), "stage1": m.between(macro[0], split - 1), "stage2": m.between(split, macro[1]), "before": m.between(macro[0], keys[-1] - 1)}
    spans |= {f"k{i}": m == k for i, k in enumerate(keys)}
    aggregates = [F.count_if(spans["macro"]).alias("_n")]
    for name, inside in spans.items():
        aggregates += window_ohlc(inside, minute, name)
    df = bars.groupBy(F.col(day).alias("date")).agg(*aggregates).where(F.col("_n") >= min_bars).drop("_n")
    for name in spans:
        o, h, l, c = (F.col(f"{name}_{x}") for x in ("open", "high", "low", "close"))
        df = df.withColumn(f"{name}_range_pct", pct(h - l, "macro_open")).withColumn(f"{name}_skew", ratio((h - o) - (o - l), h - l)).withColumn(f"{name}_dir", sign_or_zero(c - o))
    added = lambda a, b: POSITIVE(F.col(f"{a}_low") - F.col(f"{b}_low")) + POSITIVE(F.col(f"{b}_high") - F.col(f"{a}_high"))
    df = df.withColumn("stage2_added_pct", pct(added("stage1", "stage2"), "macro_open")).withColumn("k1_added_pct", pct(added("k0", "k1"), "macro_open"))
    low, high = F.least("k0_low", "k1_low"), F.greatest("k0_high", "k1_high")
    df = df.withColumn("k2_added_pct", pct(POSITIVE(low - F.col("k2_low")) + POSITIVE(F.col("k2_high") - high), "macro_open"))
    known = F.col("before_high").isNotNull() & F.col("k2_high").isNotNull()
    out = F.when((F.col("macro_dir") >= 0) & (F.col("k2_close") > F.col("before_high")), "up").when((F.col("macro_dir") <= 0) & (F.col("k2_close") < F.col("before_low")), "down").otherwise("none")
    inside = F.least("k2_high", "before_high") > F.greatest("k2_low", "before_low")
    df = df.withColumn("last_expanded", F.when(known, out).otherwise("none")).withColumn("last_retraced_inside", F.when(known, inside).otherwise(F.lit(False)))
    grew, back = F.col("last_expanded") != "none", F.col("last_retraced_inside")
    behaviour = F.when(~known, "unknown").when(grew & back, "expand_and_retrace").when(grew, "expand_only").when(back, "band_only").otherwise("none")
    up, down = F.col("last_expanded") == "up", F.col("last_expanded") == "down"
    df = df.withColumn("last_behaviour", behaviour)
    df = df.withColumn("last_push_past_points", F.when(up, POSITIVE(F.col("k2_high") - F.col("before_high"))).when(down, POSITIVE(F.col("before_low") - F.col("k2_low"))).otherwise(0.0))
    return df.withColumn("last_retrace_depth_points", F.when(up, POSITIVE(F.col("before_high") - F.col("k2_low"))).when(down, POSITIVE(F.col("k2_high") - F.col("before_low"))).otherwise(0.0))


def stage_behaviours(stats: DataFrame) -> DataFrame:
    """Days, share and mean contributions to the range by how the last candle behaved."""
    out = stats.groupBy("last_behaviour").agg(F.count("*").alias("days"), *(F.avg(c).alias(f"mean_{c}") for c in ("stage1_range_pct", "stage2_added_pct", "k0_range_pct", "k1_added_pct", "k2_added_pct", "last_push_past_points", "last_retrace_depth_points")))
    total = out.agg(F.sum("days").alias("_all"))
    return out.join(F.broadcast(total), how="cross").withColumn("pct_of_days", pct("days", "_all")).drop("_all")  # one row


def stage_percentiles(stats: DataFrame, columns: Sequence[str], qs: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Percentiles of stage figures, one row per figure."""
    long = unpivot(stats, [], list(columns)).where("value is not null")
    return long.groupBy("metric").agg(F.count("*").alias("n"), *(quantile_linear("value", q).alias(f"p{round(q * 100)}") for q in qs))


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns (long form), in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(guarded_corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    cells = ", ".join(f"'{a}', '{b}', c{i}" for i, (a, b) in enumerate(pairs))
    return row.select(F.expr(f"stack({len(pairs)}, {cells}) AS (a, b, correlation)"))
