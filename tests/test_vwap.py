import datetime as dt

import pytest

from sessionflow.operators import extremes, gaps, vwap
from sessionflow.sources.ticks import normalize

OPEN = int(dt.datetime(2024, 3, 7, 20, 50, tzinfo=dt.timezone.utc).timestamp())  # 15:50 in New York
S = 15 * 3600 + 50 * 60
HORIZONS = {"1554": S + 300, "1559": S + 600, "1600": S + 660}


def day(spark, rows):
    """(seconds from 15:50, price, size[, rank])."""
    full = [(int((OPEN + r[0]) * 10**9), r[3] if len(r) > 3 else i, 2, int(r[1] * 4), r[2]) for i, r in enumerate(rows)]
    return normalize(spark.createDataFrame(full, "ts_event long, intra_ts_rank long, side int, price_ticks long, size long"))


def study(spark, rows):
    return vwap.retouch_study(day(spark, rows), S, 10, S + 60, S + 600, HORIZONS).first()


FIRST = [(0, 100, 1), (1, 101, 1), (2, 99, 1)]


def test_break_retouch_and_excursions(spark):
    r = study(spark, FIRST + [(20, 102, 1), (30, 104, 1), (40, 100.25, 1), (50, 103, 1), (400, 106, 1), (601, 90, 1)])
    assert (r["high_first"], r["low_first"], r["vwap_frozen"], r["trigger_state"], r["bias"], r["break_time_s"], r["break_price"]) == (101, 99, 100, "triggered", "bullish", 20, 102)
    assert (r["retouch_frozen_occurred"], r["retouch_frozen_time_s"], r["retouch_frozen_lag_s"], r["retouch_frozen_price"]) == (True, 40, 20, 100.25)
    assert (r["mfe_break_points"], r["mae_break_points"], r["fwd_break_1554_points"], r["fwd_break_1559_points"], r["fwd_break_1600_points"]) == (4, -1.75, 1, 4, -12)
    assert r["retouch_rolling_occurred"] and r["retouch_rolling_time_s"] == 40 and r["bias_matches_macro"] is True


def test_no_trigger_no_first_range_and_passed_horizons(spark):
    r = study(spark, FIRST + [(30, 100.5, 1)])
    assert r["trigger_state"] == "no_trigger" and r["bias"] is None and r["retouch_frozen_occurred"] is None
    assert study(spark, [(30, 100, 1)])["trigger_state"] == "no_first_range"
    r = study(spark, FIRST + [(400, 98, 1), (500, 97, 1)])
    assert r["bias"] == "bearish" and r["fwd_break_1554_points"] is None and r["fwd_break_1559_points"] == 1 and r["retouch_frozen_occurred"] is False


def test_equal_times_are_ordered_by_rank(spark):
    r = study(spark, FIRST + [(20, 98, 1, 7), (20, 102, 1, 3)])
    assert r["bias"] == "bullish" and r["retouch_frozen_time_s"] == 20


def test_checkpoint_is_strict_and_partials_merge(spark):
    t = day(spark, [(0, 100, 1), (5, 104, 3), (10, 999, 50), (30, 90, 1)])
    specs, targets = {"a": (S, S + 10)}, {"t": (S, S + 60)}
    f = vwap.vwap_features(t, specs, targets, "x").first()
    assert (f["a_vwap"], f["a_price"], f["a_vwap_dist_points"], f["a_vwap_side"], f["t_points"], f["t_state"]) == (103, 104, 1, "above", -10, "bearish")
    parts = [vwap.partials(t.where(c), specs, targets) for c in ("size = 1", "size > 1")]
    assert vwap.finish(vwap.merge_partials(parts), specs, targets, "x").first() == f


@pytest.mark.parametrize("bps, side, band", [(-25, "below", "below_gt_20"), (-20, "below", "below_10_20"), (-2, "below", "below_0_2"), (1.9, "above", "above_0_2"), (2, "above", "above_0_2"), (5.1, "above", "above_5_10"), (21, "above", "above_gt_20"), (0.1, "touch", "touch"), (None, None, None)])
def test_bands(spark, bps, side, band):
    df = spark.createDataFrame([(None if bps is None else float(bps), side)], "a_vwap_dist_bps double, a_vwap_side string")
    assert df.select(vwap.bps_band("a")).first()[0] == band


def test_time_on_the_wrong_side(spark):
    t = day(spark, [(0, 100, 1), (10, 98, 1), (20, 103, 1), (50, 97, 1), (70, 95, 9)])
    barrier = spark.createDataFrame([(dt.date(2024, 3, 7), "bullish", 10)], "date date, macro_trend_state string, barrier_time int")
    m = vwap.barrier_tick_metrics(t, barrier, S, 60, {"after": (S + 60, S + 600)}).first()
    assert (m["post_barrier_tick_count"], m["vwap_dist_at_barrier_points"], m["vwap_side_at_barrier"]) == (3, -1, "below")
    assert m["seconds_wrong_side"] == pytest.approx(20) and m["wrong_side_share"] == pytest.approx(0.4)
    assert m["closed_wrong_side_more_than_2pts"] and not m["closed_wrong_side_more_than_5pts"] and m["after_points"] == 0


def test_extreme_timing_ties_and_barrier(spark):
    t = day(spark, [(0, 100, 1), (3, 99, 1), (9, 99, 1), (59, 101, 1), (240, 101, 1), (300, 98, 1), (310, 105, 1), (540, 110, 1)])
    rows = {r["key"]: r for r in extremes.extreme_timing(t, [0, 4, 5, 9]).collect()}
    assert rows[0]["candle_low_time"] == 3 and rows[0]["candle_high_time"] == 59 and rows[0]["candle_high_first"] is False and rows[0]["candle_extreme_gap_seconds"] == 56
    b = extremes.barrier_study(extremes.extreme_timing(t, [0, 4, 5, 9]), 0).first()
    assert (b["barrier_extreme"], b["barrier_price"], b["macro_extreme"], b["edge_case"], b["extreme_after_points"], b["extreme_after_keys"]) == ("low", 99, 98, True, 1, 5)
    assert extremes.extreme_timing(t, [0, 1]).count() == 0


def test_gap_scan(spark):
    def scan(*bars, last=9):
        df = spark.createDataFrame([("d", i, *map(float, b), 10) for i, b in bars], "day string, at int, Open double, High double, Low double, Close double, Volume long")
        e = gaps.detect_gaps(df, ["day"], "at", 0, last, 5, {"a": 2, "b": 9})
        return gaps.scan_outcomes(e, df, ["day"], "at", 0, last, 5).orderBy("assigned_at").collect()

    base = [(0, (10, 11, 9, 10.5)), (1, (11, 13, 11, 13)), (2, (13, 15, 12, 14))]
    (e,) = scan(*base, (3, (14, 16, 13, 15)))
    assert (e["fvg_side"], e["gap_bottom"], e["gap_top"], e["entry_price"], e["confirmed_at"], e["alignment_bucket"]) == ("bullish", 11, 12, 15, 3, "3_aligned")
    assert e["entry_triggered"] and e["held"] and e["untouched"] and e["mfe_pct"] is None and e["outcome_bucket"] == "untouched_held"
    # retraced and invalidated by one bar: a later entry is not seen
    (e,) = scan(*base, (3, (12, 12, 10, 10)), (4, (15, 20, 15, 19)))
    assert (e["first_retrace_at"], e["first_invalidation_at"], e["first_entry_at"], e["outcome_bucket"]) == (3, 3, None, "invalidated") and e["success_break_at"] == 4
    # retrace first, success later, excursions after the entry
    (e,) = scan(*base, (3, (13, 14, 11.5, 13)), (4, (13, 15, 13, 15)), (5, (15, 18, 12, 16)))
    assert (e["first_retrace_at"], e["first_entry_at"], e["success_break_at"], e["mfe_pct"], e["mae_pct"]) == (3, 4, 4, 0.2, 0.2) and e["retraced_in_stage_2"]
    # the third bar at the end: not confirmable
    (e,) = scan(*base, last=2)
    assert not e["is_confirmable"] and e["outcome_bucket"] == "unconfirmable" and not e["held"] and not e["untouched"]
    assert gaps.enrich_with_delta(gaps.detect_gaps(spark.createDataFrame([], "day string, at int, Open double, High double, Low double, Close double, Volume long"), ["day"], "at", 0, 9, 5, {"a": 2}), None, ["day"], "bar3_at").count() == 0
