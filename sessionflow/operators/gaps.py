"""Three-bar gaps (fair-value gaps): detection, forward outcomes, cohorts.

Bars have group columns (a day, or an instrument and a month) and an integer
position ``at`` in the group's window. A gap is assigned to its middle bar,
confirmed one position after the third, and followed to the last position.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import float_ratio, nearest_quantiles, quantile_linear, rank_quantile, ratio, sign_or_zero
from ..functions.tables import materialize


def candle_direction(o: Column | str, c: Column | str) -> Column:
    o, c = (F.col(x) if isinstance(x, str) else x for x in (o, c))
    return F.when(c > o, "bullish").when(c < o, "bearish").otherwise("neutral")


def detect_gaps(bars: DataFrame, by: Sequence[str], at: str, first: int, last: int, stage2: int, blocks: Mapping[str, int], size_split: float = 2.25) -> DataFrame:
    """One row per gap assigned at positions [first, last): sides, bounds, directions of its bars, stage, block, size bucket.

    ``bars`` holds neighbours outside the window too (they can be a gap's first
    or third bar). Later bars are the next ones that exist. ``blocks`` maps a
    label to the last position it holds. A gap right after one of the same
    side whose third bar is its middle one is a stacked continuation.
    """
    ordered = Window.partitionBy(*by).orderBy(at)
    prev, nxt = (lambda c: F.lag(c).over(ordered)), (lambda c: F.lead(c).over(ordered))
    df = bars.select(
        *by, F.col(at).alias("assigned_at"), "Open", "High", "Low", "Close", F.col("Volume").alias("bar2_volume"), nxt(at).alias("bar3_at"),
        *(f(c).alias(f"{n}_{c.lower()}") for n, f in (("bar1", prev), ("bar3", nxt)) for c in ("Open", "High", "Low", "Close")),
    )
    up, down = F.col("bar3_low") > F.col("bar1_high"), F.col("bar3_high") < F.col("bar1_low")
    df = df.where((F.col("assigned_at") >= first) & (F.col("assigned_at") < last) & (up | down))
    bull = F.col("fvg_side") == "bullish"
    df = df.withColumn("fvg_side", F.when(up, "bullish").otherwise("bearish")).withColumn("confirmed_at", F.col("bar3_at") + 1)
    df = df.withColumn("gap_bottom", F.when(bull, F.col("bar1_high")).otherwise(F.col("bar3_high"))).withColumn("gap_top", F.when(bull, F.col("bar3_low")).otherwise(F.col("bar1_low")))
    df = df.withColumn("gap_size", F.col("gap_top") - F.col("gap_bottom")).withColumn("is_confirmable", F.col("confirmed_at") <= last)
    for n, o, c in (("bar1", "bar1_open", "bar1_close"), ("bar2", "Open", "Close"), ("bar3", "bar3_open", "bar3_close")):
        df = df.withColumn(f"{n}_direction", candle_direction(o, c))
    directions = [F.col(f"bar{i}_direction") for i in (1, 2, 3)]
    total = lambda test: sum((test(d).cast("int") for d in directions), F.lit(0))
    df = df.withColumn("aligned_count", total(lambda d: d == F.col("fvg_side"))).withColumn("neutral_count", total(lambda d: d == "neutral"))
    df = df.withColumn("opposite_count", 3 - F.col("aligned_count") - F.col("neutral_count"))
    label = F.when(F.col("neutral_count") > 0, "contains_neutral")
    for k, name in ((3, "3_aligned"), (2, "2_aligned_1_opposite"), (1, "1_aligned_2_opposite"), (0, "0_aligned_3_opposite")):
        label = label.when(F.col("aligned_count") == k, name)
    df = df.withColumn("alignment_bucket", label).withColumn("assigned_stage", F.when(F.col("assigned_at") < stage2, "stage_1").otherwise("stage_2"))
    block = F.lit(None).cast("string")
    for name, end in sorted(blocks.items(), key=lambda x: -x[1]):
        block = F.when(F.col("assigned_at") <= end, name).otherwise(block)
    df = df.withColumn("position_block", block).withColumn("gap_size_bucket", F.when(F.col("gap_size") < size_split, f"<{size_split:g}").otherwise(f">={size_split:g}"))
    events = Window.partitionBy(*by).orderBy("assigned_at")
    stacked = (F.lag("fvg_side").over(events) == F.col("fvg_side")) & (F.lag("bar3_at").over(events) == F.col("assigned_at"))
    df = df.withColumn("stacked_continuation", F.coalesce(stacked, F.lit(False))).withColumn("stack_predecessor", F.when(F.col("stacked_continuation"), F.lag("assigned_at").over(events)))
    return df.drop("Open", "High", "Low", "Close", "bar1_open", "bar1_close", "bar1_high", "bar1_low", "bar3_open", "bar3_close").withColumn("entry_price", F.when(bull, F.col("bar3_high")).otherwise(F.col("bar3_low")))


def scan_outcomes(events: DataFrame, bars: DataFrame, by: Sequence[str], at: str, first: int, last: int, stage2: int) -> DataFrame:
    """``events`` with what the bars of the window from confirmation on did: entry, retrace, invalidation, success, excursions.

    The scan of a gap ends with the bar by which it was both retraced and
    invalidated, so a later entry does not count. Excursions are over bars
    after the entry, as shares of the entry price (of a price of zero infinite,
    or not a number without a move). Unconfirmable gaps have no outcome:
    nothing held, nothing touched.
    """
    window = bars.where(F.col(at).between(first, last)).select(*by, F.col(at).alias("t"), F.col("Open").alias("o"), F.col("High").alias("h"), F.col("Low").alias("l"), F.col("Close").alias("c"))
    slim = events.where("is_confirmable").select(*by, "assigned_at", "fvg_side", "confirmed_at", "gap_bottom", "gap_top", "entry_price")
    key = [*by, "assigned_at", "fvg_side"]
    w = slim.join(window, list(by)).where("t >= confirmed_at")
    bull = F.col("fvg_side") == "bullish"
    entry = F.when(bull, F.col("h") >= F.col("entry_price")).otherwise(F.col("l") <= F.col("entry_price"))
    touch = (F.col("h") >= F.col("gap_bottom")) & (F.col("l") <= F.col("gap_top"))
    broken = F.when(bull, F.col("c") < F.col("gap_bottom")).otherwise(F.col("c") > F.col("gap_top"))
    when = lambda cond, c="t": F.min(F.when(cond, F.col(c)))
    late = F.col("t") >= stage2
    found = w.groupBy(*key).agg(
        when(entry).alias("_entry"), F.min(F.when(touch, F.struct("t", "o", "h", "l", "c"))).alias("r"), when(broken).alias("first_invalidation_at"),
        F.coalesce(F.bool_or(touch & late), F.lit(False)).alias("retraced_in_stage_2"), F.coalesce(F.bool_or(broken & late), F.lit(False)).alias("invalidated_in_stage_2"),
    )
    found = found.withColumn("first_retrace_at", F.col("r.t"))
    end = F.when(F.col("first_retrace_at").isNotNull() & F.col("first_invalidation_at").isNotNull(), F.greatest("first_retrace_at", "first_invalidation_at"))
    found = found.withColumn("first_entry_at", F.when(end.isNull() | (F.col("_entry") <= end), F.col("_entry"))).drop("_entry")
    found = found.withColumn("success_reference_price", F.when(bull, F.col("r.h")).otherwise(F.col("r.l")))
    more = w.join(found.select(*key, "first_entry_at", "first_retrace_at", "success_reference_price"), key)
    beyond = F.when(bull, F.col("h") > F.col("success_reference_price")).otherwise(F.col("l") < F.col("success_reference_price"))
    after = F.col("t") > F.col("first_entry_at")
    high, low = F.max(F.when(after, float_ratio(F.col("h") - F.col("entry_price"), "entry_price"))), F.max(F.when(after, float_ratio(F.col("entry_price") - F.col("l"), "entry_price")))
    moves = more.groupBy(*key).agg(when((F.col("t") > F.col("first_retrace_at")) & beyond).alias("success_break_at"), high.alias("_up"), low.alias("_down"))
    out = events.join(found.join(moves, key), key, "left")
    ok = F.col("is_confirmable")
    out = out.withColumn("mfe_pct", F.when(bull, F.col("_up")).otherwise(F.col("_down"))).withColumn("mae_pct", F.when(bull, F.col("_down")).otherwise(F.col("_up"))).drop("_up", "_down")
    for n in ("o", "h", "l", "c"):
        out = out.withColumn({"o": "retrace_open", "h": "retrace_high", "l": "retrace_low", "c": "retrace_close"}[n], F.col(f"r.{n}"))
    flags = {"entry_triggered": F.col("first_entry_at").isNotNull(), "retraced": F.col("first_retrace_at").isNotNull(), "invalidated": F.col("first_invalidation_at").isNotNull(), "successful": F.col("success_break_at").isNotNull()}
    out = out.withColumns(flags)
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("retraced_in_stage_2", "invalidated_in_stage_2")})
    out = out.withColumn("held", ok & ~F.col("invalidated")).withColumn("untouched", ok & ~F.col("retraced"))
    out = out.withColumn("held_through_stage_2", ok & ~F.col("invalidated_in_stage_2")).withColumn("untouched_through_stage_2", ok & ~F.col("retraced_in_stage_2"))
    bucket = F.when(~ok, "unconfirmable").when(F.col("invalidated"), "invalidated").when(F.col("retraced"), "retraced_held").otherwise("untouched_held")
    return out.withColumn("outcome_bucket", bucket).drop("r")


def enrich_with_delta(events: DataFrame, flow: DataFrame | None, by: Sequence[str], bucket: Column | str, k: int = 5) -> DataFrame:
    """Order flow of the bucket in which a gap is confirmed, signed along the gap, and quantile labels; nulls without ``flow``.

    ``flow`` has the group columns, bucket_index, volume_delta, delta_imbalance
    and tick_delta; ``bucket`` is the bucket of a gap's confirmation.
    """
    names = {"volume_delta": "long", "delta_imbalance": "double", "tick_delta": "long"}
    if flow is None:
        for c, kind in names.items():
            events = events.withColumns({c: F.lit(None).cast(kind), f"aligned_{c}": F.lit(None).cast(kind), f"abs_{c}": F.lit(None).cast(kind)})
        return events.withColumns({f"{p}_delta_imbalance_quantile": F.lit(None).cast("string") for p in ("aligned", "abs")})
    bucket = F.col(bucket) if isinstance(bucket, str) else bucket
    out = events.withColumn("bucket_index", bucket).join(flow.select(*by, "bucket_index", *names), [*by, "bucket_index"], "left")
    for c in names:
        out = out.withColumn(f"aligned_{c}", F.when(F.col("fvg_side") == "bullish", F.col(c)).otherwise(-F.col(c))).withColumn(f"abs_{c}", F.abs(c))
    for p in ("aligned", "abs"):
        out = rank_quantile(out, [], f"{p}_delta_imbalance", f"{p}_delta_imbalance_quantile", [*by, "assigned_at"], k)
    return out


def with_volume_bucket(events: DataFrame, ties: Sequence[str], k: int = 4) -> DataFrame:
    return rank_quantile(events, [], "bar2_volume", "bar2_volume_bucket", ties, k, plain=True)


def _n(flag: str) -> Column:
    return F.count_if(F.col(flag))


def scope_summary(events: DataFrame) -> DataFrame:
    """Hold, retrace, untouched and invalidation rates per side, over the whole window and its second stage."""
    sets = {"whole_window": ("retraced", "invalidated", "held", "untouched"), "stage_2": ("retraced_in_stage_2", "invalidated_in_stage_2", "held_through_stage_2", "untouched_through_stage_2")}
    aggregates = [F.count("*").alias("n_total"), _n("is_confirmable").alias("n_confirmable")]
    aggregates += [_n(c).alias(c) for cs in sets.values() for c in cs]
    wide = events.groupBy("fvg_side").agg(*aggregates)
    parts = [wide.select(F.lit(s).alias("summary_scope"), "fvg_side", "n_total", "n_confirmable", *(ratio(c, "n_confirmable").alias(f"{n}_rate") for n, c in zip(("retrace", "invalidation", "hold", "untouched"), cs))) for s, cs in sets.items()]
    stage = events.where("assigned_stage = 'stage_1'").groupBy("fvg_side").agg(*aggregates)
    parts.append(stage.select(F.lit("stage_1_created").alias("summary_scope"), "fvg_side", "n_total", "n_confirmable", *(ratio(c, "n_confirmable").alias(f"{n}_rate") for n, c in zip(("retrace", "invalidation", "hold", "untouched"), sets["whole_window"]))))
    return reduce(DataFrame.unionByName, parts)


def grouped_summary(events: DataFrame, scopes: Mapping[str, Sequence[str]], kind: str) -> DataFrame:
    """One table over several groupings (name to columns) in one pass of grouping sets; unused group columns are null.

    ``kind``: ``outcome`` rates, ``entry`` excursions of triggered gaps, or
    ``success`` after a retrace. Rows in which a quantile column of a grouping
    is null are left out of it.
    """
    columns = list(dict.fromkeys(c for cs in scopes.values() for c in cs))
    base = [F.count("*").alias("n_total"), _n("is_confirmable").alias("n_confirmable")]
    if kind == "outcome":
        aggregates = [*base, *(_n(c).alias(f"n_{c}") for c in ("held", "retraced", "untouched", "invalidated"))]
    else:
        flag = "entry_triggered" if kind == "entry" else "successful"
        aggregates = [*base, _n("retraced").alias("n_retraced"), _n(flag).alias("n_flag")]
        for m in ("mfe", "mae"):
            x = F.when(F.col(flag), F.col(f"{m}_pct"))
            aggregates += [F.avg(x).alias(f"{m}_pct_mean"), F.median(x).alias(f"{m}_pct_median"), quantile_linear(x, 0.75).alias(f"{m}_pct_p75"), quantile_linear(x, 0.9).alias(f"{m}_pct_p90")]
    ids = {n: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in cs) for n, cs in scopes.items()}
    if columns:
        out = events.groupingSets([[F.col(c) for c in cs] for cs in scopes.values()], *columns).agg(F.grouping_id().alias("_g"), *aggregates)
    else:
        out = events.agg(F.lit(0).alias("_g"), *aggregates)
    name = F.lit(None).cast("string")
    for n, i in ids.items():
        whole = [F.col(c).isNotNull() for c in scopes[n] if c.endswith("_quantile")]
        name = F.when((F.col("_g") == i) & reduce(lambda a, b: a & b, whole, F.lit(True)), n).otherwise(name)
    out = out.withColumn("summary_scope", name).where("summary_scope is not null").drop("_g")
    if kind == "outcome":
        return out.withColumns({f"{n}_rate": ratio(f"n_{c}", "n_confirmable") for n, c in (("hold", "held"), ("retrace", "retraced"), ("untouched", "untouched"), ("invalidation", "invalidated"))}).drop("n_held", "n_retraced", "n_untouched", "n_invalidated")
    if kind == "entry":
        return out.withColumnRenamed("n_flag", "n_triggered").withColumn("entry_trigger_rate", ratio("n_triggered", "n_confirmable")).drop("n_retraced")
    out = out.withColumnRenamed("n_flag", "n_successful").withColumn("retrace_rate", ratio("n_retraced", "n_confirmable"))
    return out.withColumn("success_after_retrace_rate", ratio("n_successful", "n_retraced")).withColumn("successful_share_of_confirmable", ratio("n_successful", "n_confirmable")).drop("mfe_pct_p90", "mae_pct_p90")


_ABS, _ALIGNED = "abs_delta_imbalance_quantile", "aligned_delta_imbalance_quantile"
OUTCOME_SCOPES = {"creation_position": ["assigned_at"], "bar2_volume": ["bar2_volume_bucket"], "alignment_bucket": ["alignment_bucket"], "alignment_bucket_block": ["alignment_bucket", "position_block"], "alignment_bucket_gap": ["alignment_bucket", "gap_size_bucket"]}
ENTRY_SCOPES = {"entry_overall": [], "entry_alignment": ["alignment_bucket"], "entry_block": ["position_block"], "entry_gap": ["gap_size_bucket"], "entry_alignment_block": ["alignment_bucket", "position_block"], "entry_abs_quantile": [_ABS], "entry_block_abs_quantile": ["position_block", _ABS], "entry_position_abs_quantile": ["assigned_at", _ABS]}
SUCCESS_SCOPES = {"success_overall": [], "success_alignment": ["alignment_bucket"], "success_stacked": ["stacked_continuation"], "success_alignment_stacked": ["alignment_bucket", "stacked_continuation"]} | {
    f"success_{n}{q}": [*cs, c] for q, c in (("aligned_quantile", _ALIGNED), ("abs_quantile", _ABS)) for n, cs in (("", []), ("side_", ["fvg_side"]), ("position_", ["assigned_at"]), ("block_", ["position_block"]))
}


def all_summaries(events: DataFrame, ties: Sequence[str]) -> DataFrame:
    """Every summary as one ragged table."""
    bucketed = with_volume_bucket(events, ties)
    parts = [scope_summary(events), grouped_summary(bucketed, OUTCOME_SCOPES, "outcome"), grouped_summary(events, ENTRY_SCOPES, "entry"), grouped_summary(events, SUCCESS_SCOPES, "success")]
    return reduce(lambda a, b: a.unionByName(b, True), parts)


def profile_rows(summary: DataFrame, profiles: Mapping[str, str]) -> DataFrame:
    """Excursion rows of chosen scopes (scope to profile label), for a csv."""
    label = F.element_at(F.create_map(*(F.lit(x) for kv in profiles.items() for x in kv)), F.col("summary_scope"))
    keep = [c for c in summary.columns if c in ("summary_scope", "n_total", "n_triggered", "assigned_at", "position_block", _ABS, _ALIGNED) or c.startswith(("mfe_", "mae_"))]
    return summary.where(F.col("summary_scope").isin(*profiles)).select(label.alias("profile_type"), *keep)


def outcome_counts(events: DataFrame, by: Sequence[str]) -> DataFrame:
    return events.groupBy(*by, "outcome_bucket").agg(F.count("*").alias("n"))


def position_tables(events: DataFrame, ties: Sequence[str]) -> DataFrame:
    """Per creation position the mean volume of the middle bar and counts by volume bucket."""
    return with_volume_bucket(events, ties).groupBy("assigned_at").agg(F.avg("bar2_volume").alias("mean_bar2_volume"), *(F.count_if(F.col("bar2_volume_bucket") == f"q{i}").alias(f"n_q{i}") for i in (1, 2, 3, 4)))


def hourly_context(hourly: DataFrame, hours: tuple[int, int, int] = (12, 13, 14), strong: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """Days with three complete hours: range, wicks and imbalance of the later two, gap between the first and the third."""
    cell = lambda h, c: F.max(F.when(F.col("hour") == h, F.col(c)))
    a, b, c = hours
    df = hourly.groupBy("date").agg(F.countDistinct(F.when(F.col("hour").isin(*hours), F.col("hour"))).alias("_n"), *(cell(h, x).alias(f"{n}_{x}") for n, h in (("a", a), ("b", b), ("c", c)) for x in ("open", "high", "low", "close"))).where("_n = 3")
    df = df.select("date", F.col("b_open").alias("pm_open"), F.col("c_close").alias("pm_close"), F.greatest("b_high", "c_high").alias("pm_high"), F.least("b_low", "c_low").alias("pm_low"), "a_high", "a_low", "c_high", "c_low")
    df = df.withColumn("pm_range", F.col("pm_high") - F.col("pm_low")).withColumn("pm_dir_points", F.col("pm_close") - F.col("pm_open")).withColumn("pm_dir_sign", sign_or_zero("pm_dir_points"))
    df = df.withColumn("pm_close_pos", ratio(F.col("pm_close") - F.col("pm_low"), "pm_range")).withColumn("pm_body_to_range", ratio(F.abs("pm_dir_points"), "pm_range"))
    df = df.withColumn("pm_upper_wick_share", ratio(F.col("pm_high") - F.greatest("pm_open", "pm_close"), "pm_range")).withColumn("pm_lower_wick_share", ratio(F.least("pm_open", "pm_close") - F.col("pm_low"), "pm_range"))
    up, down = F.col("a_high") < F.col("c_low"), F.col("a_low") > F.col("c_high")
    df = df.withColumn("fvg_direction", F.when(up, "bullish").when(down, "bearish").otherwise("none")).withColumn("fvg_size_points", F.when(up, F.col("c_low") - F.col("a_high")).when(down, F.col("a_low") - F.col("c_high")).otherwise(0.0))
    df = df.withColumn("has_fvg", F.col("fvg_direction") != "none").withColumn("fvg_size_pct_of_pm_range", ratio("fvg_size_points", "pm_range"))
    imbalance = F.when((F.col("pm_dir_points") > 0) & (F.col("pm_close_pos") >= strong[0]), "bullish").when((F.col("pm_dir_points") < 0) & (F.col("pm_close_pos") <= strong[1]), "bearish").otherwise("neutral")
    return df.withColumn("imbalance_direction", imbalance).drop("a_high", "a_low", "c_high", "c_low")


def join_outcomes(context: DataFrame, macro: DataFrame, include_flat: bool = False) -> DataFrame:
    df = context.join(macro, "date").withColumn("macro_dir_sign", sign_or_zero("macro_dir_points"))
    df = df.withColumn("macro_direction", F.when(F.col("macro_dir_sign") > 0, "bullish").when(F.col("macro_dir_sign") < 0, "bearish").otherwise("flat"))
    return df if include_flat else df.where("macro_dir_sign <> 0")


def context_cohorts(joined: DataFrame) -> DataFrame:
    """Direction rates and moves by gap, imbalance, both, and gap-size tercile (by nearest quantiles of the gaps that exist)."""
    some = F.when(F.col("fvg_size_points") > 0, F.col("fvg_size_points"))
    joined = materialize(joined)  # read for the cut points and for the rows
    cuts = nearest_quantiles(joined.select(some.alias("_size")), "_size", {"_a": 1 / 3, "_b": 2 / 3})
    df = joined.join(F.broadcast(cuts), how="cross")  # one row
    size = F.when(F.col("fvg_size_points") <= 0, "none").when(F.col("_m") < 3, "has_fvg").when(F.col("fvg_size_points") <= F.col("_a"), "small").when(F.col("fvg_size_points") <= F.col("_b"), "medium").otherwise("large")
    cohort = lambda n, c: F.struct(F.lit(n).alias("cohort"), c.alias("bucket"))
    df = df.withColumn("s", F.explode(F.array(cohort("fvg_direction", F.col("fvg_direction")), cohort("imbalance_direction", F.col("imbalance_direction")), cohort("fvg_x_imbalance", F.concat_ws("|", "fvg_direction", "imbalance_direction")), cohort("fvg_size_bucket", size))))
    out = df.groupBy("s.cohort", "s.bucket").agg(
        F.count("*").alias("n"), F.count_if(F.col("macro_dir_sign") > 0).alias("macro_bull_n"), F.count_if(F.col("macro_dir_sign") < 0).alias("macro_bear_n"), F.avg("macro_dir_points").alias("avg_macro_dir_points"), F.median("macro_dir_points").alias("median_macro_dir_points"),
        F.avg("macro_range_points").alias("avg_macro_range_points"), F.median("macro_range_points").alias("median_macro_range_points"),
    )
    return out.withColumn("macro_bull_rate", ratio("macro_bull_n", "n")).withColumn("macro_bear_rate", ratio("macro_bear_n", "n"))
