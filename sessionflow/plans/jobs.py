"""Jobs: read, build a study, write it. Paths are any that Spark reads; every window is an argument with its usual value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import materialize
from ..functions.timecols import with_market_time
from ..operators import cohort, extremes, flow, forecast, gaps, regime, vwap
from ..sources.bars import load_bars
from ..sources.sinks import write_fan_out, write_study, write_table
from ..sources.ticks import normalize, scan_source
from . import studies

H = 3600
MACRO = (15 * H + 50 * 60, 16 * H)
#: Sessions of the regime job: first and last minute of the day, quality settings, initial balance, ATR period.
SESSIONS = {
    "1pm-3pm": (780, 899, regime.QUALITY["1pm-3pm"], 15, 10),
    "3pm-3:50pm": (900, 949, regime.QUALITY["3pm-3:50pm"], 10, 8),
}
VWAP_SPECS = {"rth_0930": (9 * H + 1800, MACRO[0]), "pm_1300": (13 * H, MACRO[0]), "h3pm_1500": (15 * H, MACRO[0])}
INTRA_SPECS = {"macro_1550_at_1550_10s": (MACRO[0], MACRO[0] + 10), "macro_1550_at_1555": (MACRO[0], MACRO[0] + 300), "macro_1550_at_1600": MACRO, "eoii_1555_at_1600": (MACRO[0] + 300, MACRO[1])}
TARGETS = {"target_1550_1554": (MACRO[0], MACRO[0] + 300), "target_1555_1559": (MACRO[0] + 300, MACRO[1]), "target_1550_1559": MACRO}


def ticks(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return normalize(scan_source(spark, paths))


def flow_tables(spark: SparkSession, source: str, out: str, density_minutes: Sequence[int] = (940, 950, 959)) -> None:
    """Minute density, five-second density of chosen minutes (a folder each), macro delta by minute and five seconds, Globex delta."""
    t = ticks(spark, source)
    write_table(flow.tick_density(t), f"{out}/tick_density_1m")
    fine = reduce(DataFrame.unionByName, (flow.minute_density(t, m).withColumn("macro_minute", F.lit(m)) for m in density_minutes))
    write_fan_out(fine, f"{out}/tick_density_5s", "macro_minute", density_minutes)
    minute = flow.window_delta(t, *MACRO, 60).withColumn("macro_minute_index", F.col("bucket_index") + 50).drop("bucket_index")
    write_table(minute, f"{out}/macro_delta_1m")
    write_table(flow.window_delta(t, *MACRO, 5, dense=True).withColumnRenamed("bucket_index", "macro_bucket_index"), f"{out}/macro_delta_5s")
    write_table(flow.globex_delta(t), f"{out}/globex_delta_1m")


def delta_studies(spark: SparkSession, tables: str, out: str) -> None:
    """Reversal, impulse and bucket-path studies with their summaries, from the tables of ``flow_tables``."""
    g, m, b = (spark.read.parquet(f"{tables}/{n}") for n in ("globex_delta_1m", "macro_delta_1m", "macro_delta_5s"))
    day = "trade_date_et"
    reversal = studies.delta_reversal(g, m, b).cache()
    predictors = ["eth_rth_pre59", "eth_rth_macro_pre59", "rth_macro_pre59", "eth_rth_pre_35940", "rth_pre_35940", "eth_rth_pre_35950"]
    contexts = [("eth_rth_pre59", "macro_pre59", "eth_rth_macro_pre59"), ("rth_pre_macro", "macro_pre59", "rth_macro_pre59")]
    write_study(reversal, f"{out}/delta_reversal", cohort.summaries(reversal, day, predictors, ["k359", *studies.TARGETS_359], contexts), f"{out}/delta_reversal_summary")
    impulse = studies.delta_impulse(g, b).cache()
    write_study(impulse, f"{out}/delta_impulse", cohort.summaries(impulse, day, ["eth_only_pre350", "rth_only_pre350", "eth_rth_pre350"], list(studies.TARGETS_350), distinct=10), f"{out}/delta_impulse_summary")
    paths = flow.bucket_paths(b, day, "macro_bucket_index", {"k350": (0, 11), "k359": (108, 119)}).cache()
    write_study(paths, f"{out}/bucket_path", cohort.path_summary(paths), f"{out}/bucket_path_summary")


def macro_studies(spark: SparkSession, source: str, out: str, keys: Sequence[int] = (0, 4, 5, 9)) -> None:
    """Extreme timing, barrier, range context, VWAP features and context, and retouch studies from ticks."""
    t = ticks(spark, source)
    timing = extremes.extreme_timing(t, keys, 60, MACRO).cache()
    write_study(timing, f"{out}/extreme_timing", extremes.extreme_timing_summary(timing), f"{out}/extreme_timing_summary")
    barrier = extremes.barrier_study(timing, 0).cache()
    write_study(barrier, f"{out}/barrier", extremes.barrier_summary(barrier), f"{out}/barrier_summary")
    spans = {f"00_{i * 5 + 4:02d}": (0, i * 5 + 4) for i in range(12)} | {"first_5s": (0, 4), "first_10s": (0, 9), "first_30s": (0, 29), "last_30s": (30, 59), "full_candle": (0, 59)}
    context = extremes.range_context(t, {"k350": MACRO[0], "k359": MACRO[0] + 540}, spans).cache()
    write_study(context, f"{out}/range_context", extremes.range_context_summary(context), f"{out}/range_context_summary")
    for label, specs, beside in (("premacro", VWAP_SPECS, None), ("intramacro", INTRA_SPECS, barrier.select("date", "macro_trend_state", "barrier_extreme", "barrier_price", "barrier_time", "barrier_first10", "barrier_is_macro_extreme", "barrier_holds", "edge_case"))):
        f = vwap.vwap_features(t, specs, TARGETS, label, beside).cache()
        write_study(f, f"{out}/vwap_{label}", vwap.vwap_summary(f, list(specs), list(TARGETS), label), f"{out}/vwap_{label}_summary")
    late = {"target_1550_10s_1554": (MACRO[0] + 10, MACRO[0] + 300), "target_1550_10s_1559": (MACRO[0] + 10, MACRO[1]), "target_1551_1559": (MACRO[0] + 60, MACRO[1])}
    vc = vwap.barrier_context(barrier, vwap.vwap_features(t, INTRA_SPECS, TARGETS, "intramacro"), t, "macro_1550_at_1550_10s", "macro_1550_at_1555", MACRO[0], 60, late).cache()
    write_study(vc, f"{out}/vwap_barrier_context", vwap.barrier_context_summary(vc, ["target_1550_1559", *late]), f"{out}/vwap_barrier_context_summary")
    r = vwap.retouch_study(t, MACRO[0], 10, MACRO[0] + 60, MACRO[1], {"1554": MACRO[0] + 300, "1559": MACRO[1], "1600": MACRO[1] + 60}).cache()
    metrics = ["retouch_frozen_lag_s", "retouch_rolling_lag_s", *(f"{k}_{a}_points" for k in ("mfe", "mae") for a in ("break", "retouch_frozen", "retouch_rolling")), "fwd_break_1559_points"]
    write_study(r, f"{out}/vwap_retouch", vwap.retouch_summary(r, metrics), f"{out}/vwap_retouch_summary")


def gap_study(spark: SparkSession, source: str, out: str, flow_5s: str | None = None) -> None:
    """Gap events of the macro minutes with outcomes, delta dominance if there is a table of it, summaries and profiles."""
    bars = with_market_time(load_bars(spark, source)).withColumn("date", F.col("date_et")).withColumn("at", F.col("minute_of_day_et") - 950)
    events = gaps.detect_gaps(bars, ["date"], "at", 0, 9, 5, {"15:50-15:52": 2, "15:53-15:57": 7, "15:58": 8})
    scanned = gaps.scan_outcomes(events, bars, ["date"], "at", 0, 9, 5)
    d = spark.read.parquet(flow_5s).withColumnRenamed("trade_date_et", "date").withColumnRenamed("macro_bucket_index", "bucket_index") if flow_5s else None
    full = gaps.enrich_with_delta(scanned, d, ["date"], F.when(F.col("confirmed_at") < 10, F.col("confirmed_at") * 12)).cache()
    summary = gaps.all_summaries(full, ["date", "assigned_at"]).cache()
    write_study(full, f"{out}/gap_events", summary, f"{out}/gap_summary")
    write_table(gaps.profile_rows(summary, {"entry_abs_quantile": "overall", "entry_block_abs_quantile": "by_block", "entry_position_abs_quantile": "by_minute"}), f"{out}/gap_profiles", kind="csv")


def daily_tables(spark: SparkSession, source: str, out: str) -> None:
    """Macro outcomes, afternoon features and their interaction from minute bars."""
    bars = with_market_time(load_bars(spark, source)).withColumn("date", F.col("date_et"))
    macro = extremes.daily_outcomes(bars, "date", "minute_of_day_et", (950, 959), (960, 970)).cache()
    before = extremes.session_features(bars, "date", "minute_of_day_et", {"pm": (780, 900), "hr3": (900, 950)}).cache()
    write_table(macro, f"{out}/macro_outcomes")
    write_table(before, f"{out}/pm_features")
    write_table(extremes.interaction(before, macro), f"{out}/pm_macro_interaction")


def regime_table(bars: DataFrame, sessions: Mapping[str, tuple] = SESSIONS, by: Sequence[str] = ("instrument", "trade_date")) -> DataFrame:
    """One row per instrument, day and session: features, ensemble state, labels. ``bars`` has datetime_utc, OHLCV and maybe instrument."""
    bars = with_market_time(bars).withColumn("trade_date", F.col("date_et"))
    if "instrument" not in bars.columns:
        bars = bars.withColumn("instrument", F.lit("default"))
    parts = []
    for name, (first, last, quality, balance, atr) in sessions.items():
        inside = bars.where(F.col("minute_of_day_et").between(first, last))
        parts.append(regime.modeling_table(inside, list(by), "datetime_utc", quality=quality, balance=balance, atr_period=atr).withColumn("session_name", F.lit(name)))
    return regime.with_labels(reduce(DataFrame.unionByName, parts))


def historical_regimes(spark: SparkSession, source: str, out: str) -> None:
    write_table(regime_table(load_bars(spark, source)), out, ["session_name"])


def containment_research(table: DataFrame, features: Mapping[str, Sequence[str]], target: str = "containment_target", out: str | None = None, label: str = "default") -> dict[str, DataFrame]:
    """Regression and classification bake-offs for each session (name to features), and a manifest of what ran.

    The manifest has a row per bake-off and session: its label, target, features, rows, days and models. All three are written if ``out`` is given.
    """
    kinds = {"regression": forecast.regression_bakeoff, "classification": forecast.classification_bakeoff}
    found = {}
    for kind, run in kinds.items():
        parts = (run(table.where(F.col("session_name") == s), list(fs), target).withColumn("session_name", F.lit(s)) for s, fs in features.items())
        found[kind] = materialize(reduce(DataFrame.unionByName, parts))
    names = F.element_at(F.create_map(*(x for s, fs in features.items() for x in (F.lit(s), F.concat_ws(",", *map(F.lit, fs))))), F.col("session_name"))
    sizes = table.where(F.col("session_name").isin(*features)).groupBy("session_name").agg(F.count("*").alias("n_rows"), F.countDistinct("trade_date").alias("n_dates")).withColumn("features", names)
    ran = reduce(DataFrame.unionByName, (d.groupBy("session_name").agg(F.concat_ws(",", F.sort_array(F.collect_set("model_name"))).alias("models")).withColumn("kind", F.lit(k)) for k, d in found.items()))
    found["manifest"] = ran.join(sizes, "session_name").withColumns({"table_label": F.lit(label), "target": F.lit(target)})
    for name, d in found.items() if out else ():
        write_table(d, f"{out}/{name}", kind="csv")
    return found


def range_forecasts(spark: SparkSession, bars: DataFrame, news: DataFrame | None, out: str, post_start: str = "2020-07-01") -> None:
    """Rolling quantile, HAR and boosted forecasts of the macro range over both slices of history, with their summary."""
    daily = forecast.range_table(with_market_time(bars), "date_et", "minute_of_day_et", (950, 959), 570, 949, news)
    target = "macro_range_pct"
    parts = []
    for name, since in (("full_history", None), ("post_covid", post_start)):
        d = forecast.history_features(daily if since is None else daily.where(F.col("trade_date") >= F.lit(since).cast("date")), target).cache()
        features = [f"{target}_lag_1", f"{target}_mean_5", f"{target}_mean_20", "rth_range_pct", "open_to_close_return_pct"]
        runs = [forecast.rolling_quantile_forecast(d, target), forecast.har_forecast(d, target), forecast.boosted_quantile_forecast(d, target, features)]
        parts += [r.select("trade_date", "quantile", "prediction", "target", "model_name").withColumn("experiment", F.lit(name)) for r in runs]
    both = reduce(DataFrame.unionByName, parts).cache()
    write_study(both, f"{out}/forecasts", forecast.forecast_summary(both), f"{out}/forecast_summary")
