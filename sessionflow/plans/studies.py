"""Delta studies and the regime-direction study."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cohort, flow

#: Session-minute and bucket ranges (fixed values; both ends inside).
ETH, RTH, DAY = (0, 929), (930, 1309), (0, 1309)
TARGETS_359 = {
    "k359_00_59": (108, 119), "k359_00_29": (108, 113), "k359_00_39": (108, 115), "k359_00_49": (108, 117), "k359_30_59": (114, 119),
    "k359_40_49": (116, 117), "k359_40_59": (116, 119), "k359_45_59": (117, 119), "k359_50_59": (118, 119),
}
TARGETS_350 = {"k350_00_09": (0, 1), "k350_00_04": (0, 0), "k350_05_09": (1, 1), "k350_00_29": (0, 5), "k350_00_59": (0, 11)}


def delta_reversal(globex: DataFrame, macro: DataFrame, buckets: DataFrame | None = None, sessions: Mapping[str, tuple[int, int]] | None = None, last: int = 59, first: int = 50, targets: Mapping[str, tuple[int, int]] = TARGETS_359, singles: tuple[int, int] = (108, 119), day: str = "trade_date_et") -> DataFrame:
    """One row per day with a last macro minute: its delta, what came before it, and finer targets inside it.

    One conditional aggregate per input and left joins on the day. Predictors:
    overnight, day session, both, the macro before its last minute and sums of
    these; with ``buckets`` also up to the target's last 20 and 10 seconds.
    """
    sessions = sessions or {"eth_pre_rth": ETH, "rth_pre_macro": RTH, "day_pre_macro": DAY}
    df = flow.index_windows(macro, day, "macro_minute_index", {"k359": (last, last), "macro_pre59": (first, last - 1)}, how="any")
    df = df.where("k359_total_size is not null").join(flow.index_windows(globex, day, "session_minute_index", sessions), day, "left")
    names = list(sessions)
    df = flow.combine_windows(flow.combine_windows(df, names[1], "macro_pre59", "rth_plus_macro_pre59"), names[2], "macro_pre59", "day_plus_macro_pre59")
    df = flow.alias_windows(df, {"eth_rth_pre59": names[2], "eth_rth_macro_pre59": "day_plus_macro_pre59", "rth_macro_pre59": "rth_plus_macro_pre59"})
    predictors = [*names, "macro_pre59", "rth_plus_macro_pre59", "day_plus_macro_pre59", "eth_rth_pre59", "eth_rth_macro_pre59", "rth_macro_pre59"]
    found = ["k359"]
    if buckets is not None:
        wanted = dict(targets) | {f"k359_bucket_{i}": (i, i) for i in range(singles[0], singles[1] + 1)}
        df = df.join(flow.index_windows(buckets, day, "macro_bucket_index", wanted), day, "left")
        found += list(wanted)
        if "k359_00_39" in targets:
            df = flow.combine_windows(flow.combine_windows(df, "day_plus_macro_pre59", "k359_00_39", "eth_rth_pre_35940"), "rth_plus_macro_pre59", "k359_00_39", "rth_pre_35940")
            predictors += ["eth_rth_pre_35940", "rth_pre_35940"]
            if "k359_40_49" in targets:
                df = flow.combine_windows(df, "eth_rth_pre_35940", "k359_40_49", "eth_rth_pre_35950")
                predictors.append("eth_rth_pre_35950")
    return flow.sign_relations(df, predictors, found)


def delta_impulse(globex: DataFrame, buckets: DataFrame, sessions: Mapping[str, tuple[int, int]] | None = None, targets: Mapping[str, tuple[int, int]] = TARGETS_350, singles: int = 12, day: str = "trade_date_et") -> DataFrame:
    """One row per day with any target bucket: target windows of the first macro minute against the sessions before."""
    sessions = sessions or {"eth_only_pre350": ETH, "rth_only_pre350": RTH, "eth_rth_pre350": DAY}
    wanted = dict(targets) | {f"k350_bucket_{i}": (i, i) for i in range(singles)}
    df = flow.index_windows(buckets, day, "macro_bucket_index", wanted, how="any")
    df = df.join(flow.index_windows(globex, day, "session_minute_index", sessions), day, "left")
    return flow.sign_relations(df, list(sessions), list(wanted))


def regime_direction(regimes: DataFrame, macro: DataFrame, delta: DataFrame | None, windows: Mapping[str, str], scores: Sequence[str] = ("trend_score", "containment_score", "chop_score"), clocks: Mapping[str, tuple[int, int]] | None = None) -> DataFrame:
    """Macro days with regime scores of earlier sessions side by side, delta windows, tertile buckets and whether delta was there.

    ``windows`` maps session names to column suffixes; ``delta`` is keyed by
    trade_date_et and second.
    """
    usable = regimes.where("feature_status = 'ok'") if "feature_status" in regimes.columns else regimes
    wide = usable.groupBy(F.col("trade_date").cast("date").alias("date")).agg(*(F.max(F.when(F.col("session_name") == s, F.col(c))).alias(f"{c}_{x}") for s, x in windows.items() for c in scores))
    df = wide.join(macro, "date")
    p = F.col("macro_dir_points")
    df = df.withColumn("macro_direction", F.when(p > 0, "bullish").when(p < 0, "bearish").when(p == 0, "flat"))
    buckets = {f"{c}_{x}": f"{c}_{x}_bucket" for x in windows.values() for c in scores}
    if delta is not None and clocks:
        d = flow.clock_windows(delta, "trade_date_et", "second", clocks).withColumnRenamed("trade_date_et", "date")
        d = d.select("date", *(F.col(c).alias(f"delta_{c}") for c in d.columns if c != "date")).withColumn("delta_available", F.lit(True))
        df = df.join(d, "date", "left").withColumn("delta_available", F.coalesce("delta_available", F.lit(False)))
        for w in clocks:
            df = df.withColumn(f"delta_{w}_abs_volume_delta", F.abs(f"delta_{w}_volume_delta"))
            buckets[f"delta_{w}_abs_volume_delta"] = f"delta_{w}_magnitude_bucket"
    else:
        df = df.withColumn("delta_available", F.lit(False))
    return cohort.tertiles(df, buckets)
