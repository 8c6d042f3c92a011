"""Anchored VWAP: windows, distances, barrier context, first breaks and retouches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import decile, pct, quantile_linear, quantile_nearest, ratio, sign_or_null, unpivot
from ..functions.timecols import ZONE, second_of_day, wall, within
from ..sources.ticks import order_key, price

TOUCH = 0.25
#: Distance bands in basis points (fixed values): upper bounds of each side from the VWAP outwards.
BAND_EDGES = (2, 5, 10, 20)


def state(points: Column | str) -> Column:
    p = F.col(points) if isinstance(points, str) else points
    return F.when(p > 0, "bullish").when(p < 0, "bearish").when(p == 0, "neutral")


#: Seconds of a slice in which running sums are taken.
SLICE = 10


def timed_ticks(ticks: DataFrame, zone: str = ZONE, by: Sequence[str] = ()) -> DataFrame:
    """(by, date, sec, ts_ns, intra_ts_rank, at, p, size): New York day and second, order key, price."""
    local = wall("ts", zone)
    return ticks.select(*by, F.to_date(local).alias("date"), second_of_day(local).alias("sec"), "ts_ns", "intra_ts_rank", order_key().alias("at"), price().alias("p"), "size")


def partials(ticks: DataFrame, specs: Mapping[str, tuple[int, int]], targets: Mapping[str, tuple[int, int]], zone: str = ZONE) -> DataFrame:
    """Mergeable sums and edges per day: ``specs`` give [anchor, checkpoint) in seconds, ``targets`` [start, end).

    Slices of a source can be reduced one by one and merged with
    ``merge_partials``; over one source Spark's own partial aggregation does it.
    """
    t = timed_ticks(ticks, zone)
    aggregates = []
    for name, (a, b) in {**specs, **targets}.items():
        inside = within("sec", a, b)
        if name in specs:
            aggregates += [F.sum(F.when(inside, F.col("p") * F.col("size"))).alias(f"{name}_pv"), F.sum(F.when(inside, F.col("size"))).alias(f"{name}_v")]
        edge = F.when(inside, F.struct("at", "p"))
        aggregates += [F.min(edge).alias(f"{name}_first"), F.max(edge).alias(f"{name}_last")]
    return t.groupBy("date").agg(*aggregates)


def merge_partials(parts: Sequence[DataFrame]) -> DataFrame:
    """One row per day out of partials of disjoint slices."""
    both = reduce(lambda a, b: a.unionByName(b), parts)
    how = {"_pv": F.sum, "_v": F.sum, "_first": F.min, "_last": F.max}
    return both.groupBy("date").agg(*(next(f for s, f in how.items() if c.endswith(s))(c).alias(c) for c in both.columns if c != "date"))


def finish(merged: DataFrame, specs: Mapping[str, tuple[int, int]], targets: Mapping[str, tuple[int, int]], label: str, touch: float = TOUCH) -> DataFrame:
    """VWAPs, last prices, distances, sides, confluence and target moves from merged partials."""
    columns = [F.col("date")]
    for s in specs:
        columns += [F.when(F.col(f"{s}_v") > 0, F.col(f"{s}_pv") / F.col(f"{s}_v")).alias(f"{s}_vwap"), F.col(f"{s}_last.p").alias(f"{s}_price")]
    for t in targets:
        columns.append((F.col(f"{t}_last.p") - F.col(f"{t}_first.p")).alias(f"{t}_points"))
    df = merged.select(*columns)
    for s in specs:
        d = F.col(f"{s}_price") - F.col(f"{s}_vwap")
        df = df.withColumn(f"{s}_vwap_dist_points", d).withColumn(f"{s}_vwap_dist_bps", (ratio(f"{s}_price", f"{s}_vwap") - 1.0) * 10000.0)
        df = df.withColumn(f"{s}_vwap_side", F.when(F.abs(d) <= touch, "touch").when(d > touch, "above").when(d.isNotNull(), "below"))
    count = lambda side: sum((F.coalesce((F.col(f"{s}_vwap_side") == side).cast("int"), F.lit(0)) for s in specs), F.lit(0))
    for side in ("above", "below", "touch"):
        df = df.withColumn(f"{label}_{side}_count", count(side))
    df = df.withColumn(f"{label}_net_side_score", F.col(f"{label}_above_count") - F.col(f"{label}_below_count"))
    for t in targets:
        df = df.withColumn(f"{t}_sign", sign_or_null(f"{t}_points")).withColumn(f"{t}_state", state(f"{t}_points"))
    return df


def vwap_features(ticks: DataFrame, specs: Mapping[str, tuple[int, int]], targets: Mapping[str, tuple[int, int]], label: str, barrier: DataFrame | None = None, touch: float = TOUCH, zone: str = ZONE) -> DataFrame:
    """One row per day; with ``barrier`` (by date) its columns beside, prefixed."""
    df = finish(partials(ticks, specs, targets, zone), specs, targets, label, touch)
    if barrier is None:
        return df
    prefixed = barrier.select("date", *(F.col(c).alias(c if c.startswith("barrier_") else f"barrier_{c}") for c in barrier.columns if c != "date"))
    return df.join(prefixed, "date", "left")


def bps_band(prefix: str, edges: Sequence[int] = BAND_EDGES) -> Column:
    """Touch, or side and range of the distance in basis points, e.g. ``below_5_10``."""
    bps, label = F.col(f"{prefix}_vwap_dist_bps"), F.lit(None).cast("string")
    names = list(zip((0, *edges), (*edges, None)))
    for side, mine in (("below", bps < 0), ("above", bps >= 0)):
        for a, b in reversed(names):
            far = F.abs(bps) <= b if b is not None else F.lit(True)
            label = F.when(mine & far, f"{side}_gt_{a}" if b is None else f"{side}_{a}_{b}").otherwise(label)
    # the loops above nest from the far band inwards, so the nearest band that fits wins
    return F.when(bps.isNull(), F.lit(None).cast("string")).when(F.col(f"{prefix}_vwap_side") == "touch", "touch").otherwise(label)


def target_rates(long: DataFrame, by: Sequence[str], quantiles: bool = False) -> DataFrame:
    """Counts, percents and location of target moves per group of rows (target_name, points)."""
    s = state("points")
    out = long.groupBy(*by).agg(
        F.count("*").alias("sample_size"), *(F.count_if(s == k).alias(f"{k}_count") for k in ("bullish", "bearish", "neutral")), F.avg("points").alias("avg_target_points"), F.median("points").alias("median_target_points"),
        *((quantile_nearest("points", q).alias(f"p{round(q * 100)}_target_points") for q in (0.1, 0.25, 0.75, 0.9)) if quantiles else ()),
    )
    return out.withColumns({f"{k}_pct": pct(f"{k}_count", "sample_size") for k in ("bullish", "bearish", "neutral")})


def vwap_summary(features: DataFrame, prefixes: Sequence[str], targets: Sequence[str], label: str) -> DataFrame:
    """Target moves by feature and scope: side, distance band, decile, confluence and, where there are barriers, side by barrier flag.

    Rows of sides and bands appear with zero days too.
    """
    flags = [f for f in ("barrier_first10", "barrier_holds") if f in features.columns]
    scoped = []
    for p in prefixes:
        df = decile(features, [], f"{p}_vwap_dist_bps", "_decile", ["date"], 10, 10)
        side = F.col(f"{p}_vwap_side")
        scopes = [F.struct(F.lit("side").alias("scope"), side.alias("bucket")), F.struct(F.lit("fixed_bps_band").alias("scope"), bps_band(p).alias("bucket")), F.struct(F.lit("decile").alias("scope"), F.col("_decile").cast("string").alias("bucket"))]
        scopes += [F.struct(F.lit(f"{f}_by_side").alias("scope"), F.concat_ws("_", side, F.col(f).cast("string")).alias("bucket")) for f in flags]
        if p == prefixes[0]:
            scopes.append(F.struct(F.lit("confluence").alias("scope"), F.col(f"{label}_net_side_score").cast("string").alias("bucket")))
        name = F.when(F.col("s.scope") == "confluence", f"{label}_net_side_score").otherwise(p)
        scoped.append(df.withColumn("s", F.explode(F.array(*scopes))).select("date", name.alias("feature_name"), "s.*", *(f"{t}_points" for t in targets)).where("bucket is not null"))
    long = unpivot(reduce(DataFrame.unionByName, scoped), ["date", "feature_name", "scope", "bucket"], [f"{t}_points" for t in targets], "target_name", "points")
    found = target_rates(long.withColumn("target_name", F.regexp_replace("target_name", "_points$", "")), ["feature_name", "target_name", "scope", "bucket"])
    bands = [f"{s}_{a}_{b}" for s in ("below", "above") for a, b in zip((0, *BAND_EDGES), BAND_EDGES)] + [f"{s}_gt_{BAND_EDGES[-1]}" for s in ("below", "above")] + ["touch"]
    fixed = [(p, t, scope, b) for p in prefixes for t in targets for scope, bs in (("side", ("above", "below", "touch")), ("fixed_bps_band", bands)) for b in bs]
    grid = features.sparkSession.createDataFrame(fixed, "feature_name string, target_name string, scope string, bucket string")
    out = found.join(grid, ["feature_name", "target_name", "scope", "bucket"], "full")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("sample_size", "bullish_count", "bearish_count", "neutral_count")}).withColumn("feature_set", F.lit(label))


def running_vwap(ticks: DataFrame, start: int, freeze: int, end: int, zone: str = ZONE, by: Sequence[str] = ()) -> DataFrame:
    """Ticks of [start, end) with the VWAP since ``start`` of their day (and ``by``), which stops moving at ``freeze``.

    Sums run within slices of ``SLICE`` seconds and are offset by those of the
    slices before, so a task never holds a day.
    """
    key = [*by, "date"]
    t = timed_ticks(ticks, zone, by).where(within("sec", start, end)).withColumn("slice", F.floor(F.col("sec") / SLICE).cast("int"))
    moving = F.col("sec") < freeze
    t = t.withColumn("_pv", F.when(moving, F.col("p") * F.col("size"))).withColumn("_v", F.when(moving, F.col("size")))
    behind = Window.partitionBy(*key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # slices of a day
    before = t.groupBy(*key, "slice").agg(F.sum("_pv").alias("_pv"), F.sum("_v").alias("_v"))
    before = before.select(*key, "slice", *(F.coalesce(F.sum(c).over(behind), F.lit(0)).alias(f"{c}0") for c in ("_pv", "_v")))
    inside = Window.partitionBy(*key, "slice").orderBy("ts_ns", "intra_ts_rank").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.col(f"{c}0") + F.coalesce(F.sum(c).over(inside), F.lit(0))
    t = t.join(before, [*key, "slice"]).withColumns({"_pvs": run("_pv"), "_vs": run("_v")})
    return t.withColumn("vwap", F.when(F.col("_vs") > 0, F.col("_pvs") / F.col("_vs"))).drop("_pv", "_v", "_pv0", "_v0", "_pvs", "_vs")


def barrier_ts(day: Column | str, second: Column | str, start: int, zone: str = ZONE) -> Column:
    """The UTC instant of a wall-clock second after ``start`` on a day."""
    day, second = (F.col(c) if isinstance(c, str) else c for c in (day, second))
    return F.to_utc_timestamp(F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + start + second), zone)


def barrier_tick_metrics(ticks: DataFrame, barrier: DataFrame, start: int, length: int = 60, targets: Mapping[str, tuple[int, int]] | None = None, touch: float = TOUCH, zone: str = ZONE, by: Sequence[str] = ()) -> DataFrame:
    """Per barrier day how the candle after the barrier lay to its running VWAP: at the barrier, at its close, worst, and for how long on the wrong side.

    ``barrier`` has date, macro_trend_state, barrier_time (seconds into the
    candle), and ``by`` where instruments share days. Only its days are scanned
    (a join that Spark broadcasts if small).
    """
    targets = targets or {}
    end = max([start + length, *(b for _, b in targets.values())])
    key = [*by, "date"]
    days = barrier.select(*key, "macro_trend_state", "barrier_time")
    t = running_vwap(ticks, start, start + length, end, zone, by).join(days, key)
    after = (F.col("sec") >= start + F.col("barrier_time")) & (F.col("sec") < start + length)
    t = t.withColumn("after", after)
    order = Window.partitionBy(*key, "slice", "after").orderBy("ts_ns", "intra_ts_rank")
    firsts = t.groupBy(*key, "after", "slice").agg(F.min("ts_ns").alias("_first"))  # the tick that follows a slice is the first of the next
    firsts = firsts.select(*key, "after", "slice", F.lead("_first").over(Window.partitionBy(*key, "after").orderBy("slice")).alias("_next"))
    t = t.join(firsts, [*key, "after", "slice"])
    close_ns = F.unix_micros(barrier_ts("date", F.lit(length), start, zone)) * 1000
    t = t.withColumn("secs", F.greatest(F.lit(0.0), (F.coalesce(F.lead("ts_ns").over(order), F.col("_next"), close_ns) - F.col("ts_ns")) / 1e9))
    up = F.when(F.col("macro_trend_state") == "bullish", 1.0).when(F.col("macro_trend_state") == "bearish", -1.0)
    t = t.withColumn("raw", F.col("p") - F.col("vwap")).withColumn("signed", F.col("raw") * up)
    here = F.col("after")
    edge = F.when(here, F.struct("at", "raw", "signed", "vwap"))
    wrong = F.greatest(F.lit(0.0), -F.col("signed"))
    aggregates = [
        F.count_if(here).alias("post_barrier_tick_count"), F.min(edge).alias("_a"), F.max(edge).alias("_b"), F.max(F.when(here & F.col("signed").isNotNull(), wrong)).alias("worst_wrong_side_dist_points"),
        F.sum(F.when(here & (F.col("signed") < 0), F.col("secs"))).alias("_s"),
    ]
    for name, (a, b) in targets.items():
        inside = F.when(within("sec", a, b), F.struct("at", "p"))
        aggregates.append((F.max(inside)["p"] - F.min(inside)["p"]).alias(f"{name}_points"))
    m = t.groupBy(*key, "barrier_time").agg(*aggregates)
    side = lambda d: F.when(F.abs(d) <= touch, "touch").when(d > touch, "above").when(d.isNotNull(), "below")
    some = F.col("post_barrier_tick_count") > 0
    m = m.withColumn("vwap_side_at_barrier", side(F.col("_a.raw"))).withColumn("vwap_dist_at_barrier_points", F.col("_a.signed")).withColumn("vwap_side_at_close", side(F.col("_b.raw"))).withColumn("vwap_dist_at_close_points", F.col("_b.signed"))
    close_wrong = F.greatest(F.lit(0.0), -F.col("_b.signed"))
    known = F.col("_b.signed").isNotNull()
    for name, edge_ in (("closed_wrong_side", 0.0), ("closed_wrong_side_more_than_1tick", 0.25), ("closed_wrong_side_more_than_2pts", 2.0), ("closed_wrong_side_more_than_5pts", 5.0)):
        m = m.withColumn(name, F.when(known, close_wrong > edge_))
    m = m.withColumn("worst_wrong_side_dist_bps", ratio("worst_wrong_side_dist_points", "_b.vwap") * 10000.0).withColumn("seconds_wrong_side", F.when(some, F.coalesce("_s", F.lit(0.0))))
    m = m.withColumn("wrong_side_share", ratio("seconds_wrong_side", F.greatest(F.lit(0.0), F.lit(float(length)) - F.col("barrier_time"))))
    for name in targets:
        m = m.withColumn(f"{name}_sign", sign_or_null(f"{name}_points")).withColumn(f"{name}_state", state(f"{name}_points"))
    return m.withColumn("barrier_ts_utc", barrier_ts("date", "barrier_time", start, zone)).drop("_a", "_b", "_s", "barrier_time")


def constructive(trend: Column | str, side: Column | str) -> Column:
    t, s = (F.col(c) if isinstance(c, str) else c for c in (trend, side))
    known = t.isin("bullish", "bearish") & s.isNotNull()
    good = F.when(t == "bullish", s == "above").otherwise(s == "below")
    return F.when(~F.coalesce(known, F.lit(False)), "unknown").when(s == "touch", "touch").when(good, "constructive").otherwise("wrong")


def transition(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.when((a == "unknown") | (b == "unknown"), "unknown").when((a == "touch") | (b == "touch"), "touch_mixed").otherwise(F.concat_ws("_to_", a, b))


def barrier_context(barrier: DataFrame, vwap: DataFrame, ticks: DataFrame, early: str, late: str, start: int, length: int = 60, targets: Mapping[str, tuple[int, int]] | None = None, zone: str = ZONE, by: Sequence[str] = ()) -> DataFrame:
    """Barrier days with VWAP features ``early`` and ``late`` (prefixes), tick metrics and what they say together."""
    key = [*by, "date"]
    metrics = barrier_tick_metrics(ticks, barrier, start, length, targets, zone=zone, by=by).drop("macro_trend_state")
    df = barrier.join(vwap, key).join(metrics, key, "left")
    good = lambda c: F.col(c).isin("constructive", "touch")
    df = df.withColumn("early_constructive", constructive("macro_trend_state", f"{early}_vwap_side")).withColumn("late_constructive", constructive("macro_trend_state", f"{late}_vwap_side"))
    df = df.withColumn("context_transition", transition("early_constructive", "late_constructive"))
    return df.withColumn("first10_and_early_constructive", F.col("barrier_first10") & good("early_constructive")).withColumn("holds_and_late_constructive", F.col("barrier_holds") & good("late_constructive")).withColumn("first10_and_late_constructive", F.col("barrier_first10") & good("late_constructive"))


def barrier_context_summary(context: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Target moves by barrier, VWAP side, both, wrong-side close and its deciles, and transition."""
    df = decile(context, [], "wrong_side_share", "_share_decile", ["date"])
    df = decile(df, [], "worst_wrong_side_dist_points", "_worst_decile", ["date"])
    wrong = F.greatest(F.lit(0.0), -F.col("vwap_dist_at_close_points"))
    close = F.when(wrong.isNull() | (wrong <= 0) | F.col("vwap_dist_at_close_points").isNull(), "no_wrong_side_close").when(wrong <= 0.25, "wrong_le_1tick").when(wrong <= 2, "wrong_1tick_to_2pts").when(wrong <= 5, "wrong_2_to_5pts").otherwise("wrong_gt_5pts")
    scope = lambda name, bucket: F.struct(F.lit(name).alias("scope"), bucket.alias("bucket"))
    flag = lambda label, c: F.concat_ws("_", F.lit(label), F.col(c).cast("string"))
    first, holds = flag("first10", "barrier_first10"), flag("holds", "barrier_holds")
    scopes = [
        scope("barrier_only", first), scope("barrier_only", holds), scope("vwap_early_only", F.col("early_constructive")), scope("barrier_vwap_early", F.concat_ws("_", first, "early_constructive")),
        scope("barrier_vwap_early", F.concat_ws("_", holds, "early_constructive")), scope("barrier_late_context", F.concat_ws("_", holds, "late_constructive")), scope("wrong_side_close_bucket", close),
        scope("wrong_side_share_decile", F.col("_share_decile").cast("string")), scope("worst_wrong_side_decile", F.col("_worst_decile").cast("string")), scope("late_decision", F.col("context_transition")),
    ]
    scoped = df.withColumn("s", F.explode(F.array(*scopes))).select("date", "s.*", *(f"{t}_points" for t in targets)).where("bucket is not null")
    long = unpivot(scoped, ["date", "scope", "bucket"], [f"{t}_points" for t in targets], "target_name", "points").withColumn("target_name", F.regexp_replace("target_name", "_points$", ""))
    return target_rates(long, ["scope", "bucket", "target_name"], quantiles=True)


def wrong_side_quantiles(context: DataFrame, columns: Sequence[str] = ("seconds_wrong_side", "wrong_side_share", "worst_wrong_side_dist_points"), qs: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    long = unpivot(context, [], list(columns)).where("value is not null")
    return long.groupBy("metric").agg(F.count("*").alias("n"), *(quantile_linear("value", q).alias(f"p{round(q * 100)}") for q in qs))


def decision_table(context: DataFrame, target: str) -> DataFrame:
    """Mean and median target move by transition and trend."""
    return context.groupBy("context_transition", "macro_trend_state").agg(F.count("*").alias("n"), F.avg(f"{target}_points").alias("mean_points"), F.median(f"{target}_points").alias("median_points"))


def retouch_study(ticks: DataFrame, start: int, first: int, candle: int, end: int, horizons: Mapping[str, int], touch: float = TOUCH, zone: str = ZONE, by: Sequence[str] = ()) -> DataFrame:
    """One row per day (and ``by``): the first break of the range of the first seconds, then the first return to the frozen and the running VWAP.

    ``start`` is the anchor, ``start + first`` the end of the first range,
    ``candle`` of the first candle and ``end`` of the window, in seconds of the
    day. From break and retouch on: signed points at each horizon (null once
    passed), best and worst signed excursion before ``end``.
    """
    last = max([end, *horizons.values()])
    key = [*by, "date"]
    t = running_vwap(ticks, start, last, last, zone, by)
    opening = F.col("sec") < start + first
    edge = lambda cond: F.when(cond, F.struct("at", "p"))
    move = lambda cond: (F.max(edge(cond))["p"] - F.min(edge(cond))["p"])
    pv, v = F.sum(F.when(opening, F.col("p") * F.col("size"))), F.sum(F.when(opening, F.col("size")))
    day = t.groupBy(*key).agg(
        F.count_if(F.col("sec") < end).alias("tick_count_macro"), F.count_if(opening).alias("_n"), F.min(edge(opening))["p"].alias("open_first"), F.max(F.when(opening, F.col("p"))).alias("high_first"), F.min(F.when(opening, F.col("p"))).alias("low_first"),
        F.when(v > 0, pv / v).alias("vwap_frozen"), ratio(v, F.sum(F.when(F.col("sec") < candle, F.col("size")))).alias("vol_share_first"), move(F.col("sec") < candle).alias("candle_dir_points"), move(F.col("sec") < end).alias("macro_dir_points"),
        *(F.max(edge(F.col("sec") < h))["p"].alias(f"_p_{k}") for k, h in horizons.items()),
    )
    day = day.withColumn("has_first", F.col("_n") > 0).drop("_n").withColumn("range_first_points", F.col("high_first") - F.col("low_first"))
    t = t.join(day.select(*key, "high_first", "low_first", "vwap_frozen"), key).where(F.col("sec") < end)
    outside = (F.col("sec") >= start + first) & ((F.col("p") > F.col("high_first")) | (F.col("p") < F.col("low_first")))
    breaks = t.groupBy(*key).agg(F.min(F.when(outside, F.struct("at", "p", "sec"))).alias("brk"))
    t = t.join(breaks.where("brk is not null"), key).withColumn("bias_", F.when(F.col("brk.p") > F.col("high_first"), 1.0).otherwise(-1.0))
    later = F.col("at") > F.col("brk.at")
    reached = lambda v: later & v.isNotNull() & ((F.col("p") - v) * F.col("bias_") <= touch)
    found = t.groupBy(*key, "brk", "bias_").agg(F.min(F.when(reached(F.col("vwap_frozen")), F.struct("at", "p", "sec", "vwap"))).alias("frozen"), F.min(F.when(reached(F.col("vwap")), F.struct("at", "p", "sec", "vwap"))).alias("rolling"))
    anchors = {"break": "brk", "retouch_frozen": "frozen", "retouch_rolling": "rolling"}
    w = t.select(*key, "at", "p").join(found, key)
    excursions = []
    for name, a in anchors.items():
        signed = F.when(F.col("at") >= F.col(f"{a}.at"), (F.col("p") - F.col(f"{a}.p")) * F.col("bias_"))
        excursions += [F.max(signed).alias(f"mfe_{name}_points"), F.min(signed).alias(f"mae_{name}_points")]
    moves = w.groupBy(*key).agg(*excursions)
    out = day.join(found, key, "left").join(moves, key, "left")
    for name, a in anchors.items():
        for k, h in horizons.items():
            ahead = F.when(F.col(f"{a}.sec") < h, (F.col(f"_p_{k}") - F.col(f"{a}.p")) * F.col("bias_"))
            out = out.withColumn(f"fwd_{name}_{k}_points", ahead)
    hit = F.col("brk").isNotNull()
    bias = F.when(F.col("bias_") > 0, "bullish").when(F.col("bias_") < 0, "bearish")
    out = out.withColumn("trigger_state", F.when(~F.col("has_first"), "no_first_range").when(hit, "triggered").otherwise("no_trigger"))
    out = out.withColumn("break_side", F.when(F.col("bias_") > 0, "high").when(F.col("bias_") < 0, "low")).withColumn("bias", bias).withColumn("break_time_s", F.col("brk.sec") - start).withColumn("break_price", F.col("brk.p")).withColumn("break_ns", F.col("brk.at.ts_ns"))
    for c in ("candle", "macro"):
        out = out.withColumn(f"{c}_dir_sign", sign_or_null(f"{c}_dir_points")).withColumn(f"{c}_state", state(f"{c}_dir_points"))
        out = out.withColumn(f"bias_matches_{c}", F.when(F.col(f"{c}_state").isin("bullish", "bearish"), F.col("bias") == F.col(f"{c}_state")))
    for r in ("frozen", "rolling"):
        out = out.withColumn(f"retouch_{r}_occurred", F.when(hit, F.col(r).isNotNull())).withColumn(f"retouch_{r}_time_s", F.col(f"{r}.sec") - start).withColumn(f"retouch_{r}_price", F.col(f"{r}.p")).withColumn(f"retouch_{r}_lag_s", F.col(f"{r}.sec") - F.col("brk.sec"))
    out = out.withColumn("vwap_rolling_at_retouch", F.col("rolling.vwap"))
    return out.drop("brk", "frozen", "rolling", "bias_", *(f"_p_{k}" for k in horizons))


def retouch_summary(study: DataFrame, metrics: Sequence[str], deciles: Sequence[str] = ("range_first_points", "vol_share_first")) -> DataFrame:
    """Long form (scope, bucket, metric, value, sample_size): coverage, validation, frequency, distributions, decile cross-tabs."""
    flags = ["retouch_frozen_occurred", "retouch_rolling_occurred", "bias_matches_candle", "bias_matches_macro"]
    coverage = study.groupBy("trigger_state").agg(F.count("*").alias("sample_size")).select(F.lit("coverage").alias("scope"), F.col("trigger_state").alias("bucket"), F.lit("days").alias("metric"), F.col("sample_size").cast("double").alias("value"), "sample_size")
    hit = study.where("trigger_state = 'triggered'").withColumns({f: F.col(f).cast("double") for f in flags})
    sided = hit.withColumn("bucket", F.explode(F.array(F.lit("all"), F.col("bias"))))
    rate = unpivot(sided, ["bucket"], flags).where("value is not null").groupBy("bucket", "metric").agg((F.avg("value") * 100).alias("value"), F.count("*").alias("sample_size")).withColumn("scope", F.lit("frequency"))
    long = unpivot(sided, ["bucket"], list(metrics)).where("value is not null")
    q = {"mean": F.avg("value"), "median": F.median("value")} | {f"p{round(x * 100)}": quantile_nearest("value", x) for x in (0.1, 0.25, 0.75, 0.9)}
    dist = long.groupBy("bucket", "metric").agg(F.count("*").alias("sample_size"), *(e.alias(k) for k, e in q.items()))
    dist = dist.select(F.lit("distribution").alias("scope"), "bucket", "sample_size", F.explode(F.map_from_arrays(F.array(*(F.concat_ws("_", "metric", F.lit(k)) for k in q)), F.array(*(F.col(k) for k in q)))).alias("metric", "value"))
    parts = [coverage, rate, dist]
    for d in deciles:
        cut = decile(hit, [], d, "_d", ["date"], 10, 10).where("_d is not null").withColumn("bucket", F.concat_ws("_", F.lit(d), F.col("_d").cast("string")))
        parts.append(unpivot(cut, ["bucket"], flags).where("value is not null").groupBy("bucket", "metric").agg((F.avg("value") * 100).alias("value"), F.count("*").alias("sample_size")).withColumn("scope", F.lit("decile")))
    return reduce(DataFrame.unionByName, parts)
