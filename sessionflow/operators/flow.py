"""Order flow: density and delta per bucket, index windows, bucket paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import decile, ratio, sign_or_zero
from ..functions.timecols import ZONE, bucket_index, densify, second_of_day, wall, with_trade_date, within
from ..sources.ticks import BUY, NONE, SELL

MEASURES = ("volume_delta", "classified_size", "total_size")
#: Named spans of a candle's twelve five-second buckets (fixed values, both ends inside).
PATH_WINDOWS = {"early_5s": (0, 0), "early_10s": (0, 1), "post_10s_to_30s": (2, 5), "early_30s": (0, 5), "post_10s": (2, 11), "late_30s": (6, 11), "full": (0, 11)}
PREDICTORS = ("eth_pre_rth", "rth_pre_macro", "day_pre_macro", "macro_pre59", "rth_plus_macro_pre59", "day_plus_macro_pre59")


def _size(side: int) -> Column:
    return F.coalesce(F.sum(F.when(F.col("side") == side, F.col("size"))), F.lit(0))


def density_aggregates() -> list[Column]:
    return [
        F.count("*").alias("tick_count"), F.sum("size").alias("total_size"), F.count_if(F.col("side") == BUY).alias("buy_ticks"),
        F.count_if(F.col("side") == SELL).alias("sell_ticks"), F.count_if(F.col("side") == NONE).alias("none_ticks"),
    ]


def tick_density(ticks: DataFrame, seconds: int = 60, start: int = 15 * 3600 + 40 * 60, end: int = 16 * 3600 + 11 * 60, zone: str = ZONE) -> DataFrame:
    """Ticks per bucket of the wall-clock interval [start, end): date_utc, bucket start and counts by side."""
    local = wall("ts", zone)
    kept = ticks.where(within(second_of_day(local), start, end))
    return kept.groupBy(F.to_date("ts").alias("date_utc"), F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / seconds) * seconds).alias("datetime_utc"), F.floor(second_of_day(local) / seconds).cast("int").alias("bucket_of_day")).agg(*density_aggregates())


def minute_density(ticks: DataFrame, minute: int, seconds: int = 5, zone: str = ZONE) -> DataFrame:
    """One wall-clock minute of each day in buckets of ``seconds``, empty ones kept."""
    local = wall("ts", zone)
    kept = ticks.where(within(second_of_day(local), minute * 60, minute * 60 + 60))
    counted = kept.groupBy(F.to_date(local).alias("date_et"), bucket_index(local, minute * 60, seconds).alias("bucket_index")).agg(*density_aggregates())
    zero = ["tick_count", "total_size", "buy_ticks", "sell_ticks", "none_ticks"]
    return densify(counted, "date_et", 60 // seconds, zero)


def delta(df: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    """Twelve order-flow measures per group of ticks."""
    out = df.groupBy(*by).agg(
        _size(BUY).alias("buy_size"), _size(SELL).alias("sell_size"), _size(NONE).alias("none_size"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
        F.count_if(F.col("side") == BUY).alias("buy_ticks"), F.count_if(F.col("side") == SELL).alias("sell_ticks"), F.count_if(F.col("side") == NONE).alias("none_ticks"),
    )
    out = out.withColumn("classified_size", F.col("buy_size") + F.col("sell_size")).withColumn("volume_delta", F.col("buy_size") - F.col("sell_size"))
    out = out.withColumn("delta_imbalance", ratio("volume_delta", "classified_size")).withColumn("tick_delta", F.col("buy_ticks") - F.col("sell_ticks"))
    return out.withColumn("classified_share", ratio("classified_size", "total_size"))


def window_delta(ticks: DataFrame, start: int, end: int, seconds: int, zone: str = ZONE, dense: bool = False) -> DataFrame:
    """Order flow per day and bucket of a wall-clock interval; ``dense`` keeps empty buckets of days with a tick."""
    local = wall("ts", zone)
    kept = ticks.where(within(second_of_day(local), start, end))
    out = delta(kept, [F.to_date(local).alias("trade_date_et"), bucket_index(local, start, seconds).alias("bucket_index")])
    if not dense:
        return out
    zero = ["buy_size", "sell_size", "none_size", "total_size", "buy_ticks", "sell_ticks", "none_ticks", "classified_size", "volume_delta", "tick_delta"]
    return densify(out, "trade_date_et", (end - start) // seconds, zero)


def globex_delta(ticks: DataFrame, minutes: int = 1, roll_hour: int = 18, close_hour: int = 17, zone: str = ZONE) -> DataFrame:
    """Order flow per trade date and session minute (or group of minutes); the day starts at ``roll_hour``."""
    placed = with_trade_date(ticks, "ts", roll_hour, close_hour, zone)
    return delta(placed, ["trade_date_et", F.floor(F.col("session_minute_index") / minutes).cast("int").alias("session_minute_index")])


def index_windows(df: DataFrame, day: str, index: str, windows: Mapping[str, tuple[int, int]], how: str = "all") -> DataFrame:
    """Sums of the three measures over inclusive index ranges, all windows in one pass.

    A day without a row in a window has nulls there; ``how="any"`` leaves out
    days without a row in any window.
    """
    aggregates = []
    for name, (a, b) in windows.items():
        inside = F.col(index).between(a, b)
        aggregates += [F.sum(F.when(inside, F.col(m))).alias(f"{name}_{m}") for m in MEASURES]
    if how == "any":
        low, high = min(a for a, _ in windows.values()), max(b for _, b in windows.values())
        df = df.where(F.col(index).between(low, high))
    out = df.groupBy(day).agg(*aggregates)
    return out.withColumns({f"{w}_delta_imbalance": ratio(f"{w}_volume_delta", f"{w}_classified_size") for w in windows})


def combine_windows(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Sum of two windows, null as zero."""
    df = df.withColumns({f"{out}_{m}": F.coalesce(F.col(f"{a}_{m}"), F.lit(0)) + F.coalesce(F.col(f"{b}_{m}"), F.lit(0)) for m in MEASURES})
    return df.withColumn(f"{out}_delta_imbalance", ratio(f"{out}_volume_delta", f"{out}_classified_size"))


def alias_windows(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Copies of window column groups under other names (new name: old name)."""
    return df.withColumns({f"{new}_{m}": F.col(f"{old}_{m}") for new, old in aliases.items() for m in (*MEASURES, "delta_imbalance")})


def sign_relations(df: DataFrame, predictors: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Sign of each window's delta; per pair whether there is a signal, opposition or agreement."""
    df = df.withColumns({f"{w}_sign": sign_or_zero(f"{w}_volume_delta") for w in dict.fromkeys([*predictors, *targets])})
    flags = {}
    for p in predictors:
        for t in targets:
            a, b = F.col(f"{p}_sign"), F.col(f"{t}_sign")
            flags[f"{p}_vs_{t}_has_signal"] = (a != 0) & (b != 0)
            flags[f"{p}_opposes_{t}"] = (a * b) < 0
            flags[f"{p}_same_as_{t}"] = (a * b) > 0
    return df.withColumns(flags)


def clock_windows(df: DataFrame, day: str, second: str, windows: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Sums, mean classified share and a sign label of delta rows over half-open wall-clock windows."""
    aggregates = []
    for name, (a, b) in windows.items():
        inside = within(second, a, b)
        aggregates += [F.sum(F.when(inside, F.col(m))).alias(f"{name}_{m}") for m in (*MEASURES, "tick_delta")]
        aggregates.append(F.avg(F.when(inside, F.col("classified_share"))).alias(f"{name}_classified_share"))
    out = df.groupBy(day).agg(*aggregates)
    for name in windows:
        d = F.col(f"{name}_volume_delta")
        out = out.withColumn(f"{name}_delta_imbalance", ratio(d, f"{name}_classified_size")).withColumn(f"{name}_delta_sign", F.when(d > 0, "positive").when(d < 0, "negative").when(d == 0, "zero").otherwise("missing"))
    return out


def merge_duplicates(df: DataFrame, day: str, index: str) -> DataFrame:
    """Rows of one day and bucket summed; a measure that is null in all stays null."""
    return df.groupBy(day, index).agg(*(F.sum(m).alias(m) for m in MEASURES))


def bucket_paths(df: DataFrame, day: str, index: str, candles: Mapping[str, tuple[int, int]], n: int = 12, seconds: int = 5, named: Mapping[str, tuple[int, int]] = PATH_WINDOWS) -> DataFrame:
    """One row per day and candle: its n buckets side by side, running sums, path figures, categories.

    ``candles`` gives the inclusive index range of each; a sum over buckets is
    null only if all of them are.
    """
    candle, rel = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, (a, b) in candles.items():
        inside = F.col(index).between(a, b)
        candle, rel = F.when(inside, name).otherwise(candle), F.when(inside, F.col(index) - a).otherwise(rel)
    placed = merge_duplicates(df, day, index).withColumn("candle", candle).withColumn("rel", rel).where("candle is not null")
    aggregates = [F.sum(F.when(F.col("rel") == i, F.col(m))).alias(f"b{i}_{m}") for i in range(n) for m in MEASURES]
    wide = placed.groupBy(day, "candle").agg(F.count("*").alias("bucket_count"), *aggregates)
    wide = wide.withColumn("is_complete", F.col("bucket_count") == n)
    cumulative = [f"cum_00_{(i + 1) * seconds - 1:02d}" for i in range(n)]
    spans = {w: (0, i) for i, w in enumerate(cumulative)} | dict(named)
    columns = {}
    for name, (a, b) in spans.items():
        for m in MEASURES:
            cells = [F.col(f"b{i}_{m}") for i in range(a, b + 1)]
            total = sum((F.coalesce(c, F.lit(0)) for c in cells[1:]), F.coalesce(cells[0], F.lit(0)))
            columns[f"{name}_{m}"] = F.when(F.coalesce(*cells).isNotNull(), total)
    wide = wide.withColumns(columns)
    wide = wide.withColumns({f"{w}_delta_imbalance": ratio(f"{w}_volume_delta", f"{w}_classified_size") for w in spans} | {f"{w}_sign": sign_or_zero(f"{w}_volume_delta") for w in spans})
    return conviction(path_figures(wide, cumulative), day)


def path_figures(wide: DataFrame, cumulative: Sequence[str]) -> DataFrame:
    """Efficiency, peaks, early share, sign flips, extremes of the running sum in the early direction, continuation."""
    zero, n = F.lit(0), len(cumulative)
    steps = F.array(*(F.coalesce(F.abs(f"b{i}_volume_delta"), zero) for i in range(n)))
    runs = F.array(*(F.coalesce(F.col(f"{w}_volume_delta"), zero) for w in cumulative))
    wide = wide.withColumn("_steps", steps).withColumn("_runs", runs).withColumn("_peaks", F.transform(runs, lambda x: F.abs(x)))
    wide = wide.withColumn("sum_abs_bucket_delta", F.aggregate("_steps", F.lit(0).cast("long"), lambda a, x: a + x)).withColumn("max_abs_bucket_delta", F.array_max("_steps"))
    wide = wide.withColumn("peak_abs_cum_delta", F.array_max("_peaks"))
    wide = wide.withColumn("path_efficiency", ratio("full_volume_delta", "sum_abs_bucket_delta")).withColumn("early_10s_abs_flow_share", ratio(F.abs("early_10s_volume_delta"), "sum_abs_bucket_delta"))
    for out, of, top in (("max_abs_bucket_index", "_steps", "max_abs_bucket_delta"), ("peak_abs_cum_bucket_index", "_peaks", "peak_abs_cum_delta")):
        wide = wide.withColumn(out, (F.array_position(of, F.col(top)) - 1).cast("int"))  # the first of equal ones
    early = F.col("early_10s_sign")
    signed = F.transform("_runs", lambda x: x * early)
    wide = wide.withColumn("max_favorable_cum_delta", F.when(early != 0, F.array_max(signed))).withColumn("max_adverse_cum_delta", F.when(early != 0, F.array_min(signed)))
    signs = F.filter(F.transform("_runs", lambda x: F.signum(x.cast("double")).cast("int")), lambda x: x != 0)
    start = F.struct(F.lit(0).alias("last"), F.lit(0).alias("flips"))
    step = lambda a, x: F.struct(x.alias("last"), (a["flips"] + F.when((a["last"] != 0) & (a["last"] != x), 1).otherwise(0)).alias("flips"))
    wide = wide.withColumn("cum_sign_flip_count", F.aggregate(signs, start, step)["flips"])
    for label, w in (("30s", "early_30s"), ("post10_30s", "post_10s_to_30s"), ("post10", "post_10s"), ("late30", "late_30s"), ("full", "full")):
        both = early * F.col(f"{w}_sign")
        wide = wide.withColumn(f"early_10s_continues_to_{label}", both > 0).withColumn(f"early_10s_fades_to_{label}", both < 0)
    return wide.drop("_steps", "_runs", "_peaks")


def conviction(df: DataFrame, day: str, k: int = 10) -> DataFrame:
    """Deciles per candle of the early delta, its imbalance and its size, and categories guarded by the sign."""
    df = df.withColumn("early_10s_abs_delta", F.abs("early_10s_volume_delta"))
    for value, out in (("early_10s_volume_delta", "early_10s_raw_decile"), ("early_10s_delta_imbalance", "early_10s_imbalance_decile"), ("early_10s_abs_delta", "early_10s_abs_decile")):
        df = decile(df, ["candle"], value, out, [day], k, k)
    sign, raw, size = F.col("early_10s_sign"), F.col("early_10s_raw_decile"), F.col("early_10s_abs_decile")
    label = (
        F.when(sign == 0, "neutral")
        .when((sign < 0) & (raw <= 2), "strong_negative").when(sign < 0, "weak_negative")
        .when((sign > 0) & (raw >= k - 1), "strong_positive").when(sign > 0, "weak_positive")
    )
    by_size = F.when(size >= k - 1, "high_abs_conviction").when(size >= 4, "mid_abs_conviction").when(size >= 1, "low_abs_conviction")
    return df.withColumn("early_10s_category", label).withColumn("early_10s_abs_category", by_size)


def running_delta(df: DataFrame, by: Sequence[str], index: str) -> DataFrame:
    """Running volume delta per group."""
    ordered = Window.partitionBy(*by).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cum_volume_delta", F.sum("volume_delta").over(ordered))
