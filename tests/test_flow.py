import datetime as dt

import pytest
from pyspark.sql import functions as F

from sessionflow.functions import stats
from sessionflow.operators import flow
from sessionflow.plans import studies
from sessionflow.sources.ticks import normalize


def ticks(spark, rows):
    """(UTC time, side, size[, price ticks])."""
    full = [(int(dt.datetime.fromisoformat(r[0] + "+00:00").timestamp()) * 10**9, i, r[1], r[3] if len(r) > 3 else 84000, r[2]) for i, r in enumerate(rows)]
    return normalize(spark.createDataFrame(full, "ts_event long, intra_ts_rank long, side int, price_ticks long, size long"))


def test_density_edges_and_daylight_saving(spark):
    times = ["2025-01-02 20:39:59", "2025-01-02 20:40:00", "2025-01-02 20:50:00", "2025-01-02 20:59:59", "2025-01-02 21:00:00", "2025-01-02 21:10:59", "2025-01-02 21:11:00", "2025-07-02 19:40:00"]
    rows = flow.tick_density(ticks(spark, [(x, 2, i + 1) for i, x in enumerate(times)])).orderBy("datetime_utc").collect()
    assert [(r["bucket_of_day"] % 60, r["total_size"]) for r in rows] == [(40, 2), (50, 3), (59, 4), (0, 5), (10, 6), (40, 8)]
    assert str(rows[0]["date_utc"]) == "2025-01-02"


def test_delta_measures(spark):
    d = flow.window_delta(ticks(spark, [("2025-01-02 20:50:00", 2, 1), ("2025-01-02 20:50:01", 1, 3), ("2025-01-02 20:50:02", 1, 2)]), 57000, 57600, 60).first()
    assert (d["buy_size"], d["sell_size"], d["volume_delta"], d["delta_imbalance"], d["tick_delta"], d["classified_share"]) == (1, 5, -4, -4 / 6, -1, 1.0)
    n = flow.window_delta(ticks(spark, [("2025-01-02 20:50:00", 0, 7)]), 57000, 57600, 60).first()
    assert (n["volume_delta"], n["delta_imbalance"], n["classified_share"]) == (0, None, 0.0)


def test_dense_five_second_grid(spark):
    d = flow.window_delta(ticks(spark, [("2025-01-02 20:50:07", 2, 4)]), 57000, 57600, 5, dense=True).orderBy("bucket_index").collect()
    assert len(d) == 120 and [r["bucket_index"] for r in d if not r["is_empty"]] == [1] and sum(r["total_size"] for r in d) == 4
    m = flow.minute_density(ticks(spark, [("2025-01-02 20:50:59", 2, 4)]), 950).orderBy("bucket_index").collect()
    assert len(m) == 12 and m[11]["tick_count"] == 1 and m[0]["is_empty"]


def test_globex_day(spark):
    d = flow.globex_delta(ticks(spark, [("2025-01-02 23:00:30", 2, 1), ("2025-01-02 22:30:00", 2, 9), ("2025-01-03 21:59:00", 1, 2)])).orderBy("session_minute_index").collect()
    assert [(str(r["trade_date_et"]), r["session_minute_index"], r["volume_delta"]) for r in d] == [("2025-01-03", 0, 1), ("2025-01-03", 1379, -2)]


def buckets(spark, values, name="macro_bucket_index", day="2025-01-02"):
    return spark.createDataFrame([(dt.date.fromisoformat(day), i, v, abs(v), abs(v)) for i, v in values.items()], f"trade_date_et date, {name} int, volume_delta long, classified_size long, total_size long")


def test_windows_keep_missing_apart_from_zero(spark):
    w = flow.index_windows(buckets(spark, {0: 5, 1: -5}), "trade_date_et", "macro_bucket_index", {"a": (0, 1), "b": (2, 3)}).first()
    assert (w["a_volume_delta"], w["a_delta_imbalance"], w["b_volume_delta"]) == (0, 0.0, None)
    df = flow.combine_windows(flow.index_windows(buckets(spark, {0: 5}), "trade_date_et", "macro_bucket_index", {"a": (0, 0), "b": (2, 3)}), "a", "b", "c")
    assert df.first()["c_volume_delta"] == 5


def test_reversal_study(spark):
    globex = buckets(spark, {0: 10, 929: 5, 930: -3, 1309: 1, 1310: 99}, "session_minute_index")
    macro = buckets(spark, {50: 2, 58: 2, 59: -7}, "macro_minute_index")
    five = buckets(spark, {108: -1, 115: -2, 116: 4, 119: -8})
    r = studies.delta_reversal(globex, macro, five).first()
    want = {"k359": -7, "eth_pre_rth": 15, "rth_pre_macro": -2, "day_pre_macro": 13, "macro_pre59": 4, "rth_plus_macro_pre59": 2, "day_plus_macro_pre59": 17, "eth_rth_pre59": 13, "k359_00_39": -3, "eth_rth_pre_35940": 14, "rth_pre_35940": -1, "eth_rth_pre_35950": 18, "k359_bucket_119": -8, "k359_bucket_109": None}
    assert {k: r[f"{k}_volume_delta"] for k in want} == want
    assert r["eth_rth_pre59_opposes_k359"] and r["rth_pre_macro_same_as_k359"] and not r["macro_pre59_vs_k359_bucket_109_has_signal"]
    assert studies.delta_reversal(globex, buckets(spark, {50: 2}, "macro_minute_index")).count() == 0
    i = studies.delta_impulse(globex, buckets(spark, {0: 3, 1: -1, 11: 2})).first()
    assert (i["k350_00_09_volume_delta"], i["k350_00_59_volume_delta"], i["eth_rth_pre350_volume_delta"]) == (2, 4, 13)


def test_bucket_path_figures(spark):
    v = {0: 5, 1: -2, 2: -6, 3: 4, 5: 0, 11: -3}
    r = flow.bucket_paths(buckets(spark, v), "trade_date_et", "macro_bucket_index", {"k350": (0, 11)}).first()
    assert (r["bucket_count"], r["is_complete"], r["full_volume_delta"], r["early_10s_volume_delta"], r["post_10s_to_30s_volume_delta"]) == (6, False, -2, 3, -2)
    assert (r["sum_abs_bucket_delta"], r["max_abs_bucket_delta"], r["max_abs_bucket_index"], r["cum_sign_flip_count"]) == (20, 6, 2, 3)
    assert (r["path_efficiency"], r["max_favorable_cum_delta"], r["max_adverse_cum_delta"]) == (-0.1, 5, -3)
    assert r["early_10s_fades_to_full"] and r["early_10s_continues_to_30s"] and r["early_10s_fades_to_post10_30s"] and r["early_10s_category"] == "weak_positive" and r["early_10s_raw_decile"] is None


@pytest.mark.parametrize("n, want", [(9, None), (10, list(range(1, 11))), (25, [1, 1, 1, 2, 2, 3, 3, 3, 4, 4, 5, 5, 5, 6, 6, 7, 7, 7, 8, 8, 9, 9, 9, 10, 10])])
def test_decile_rule(spark, n, want):
    df = spark.createDataFrame([(i, float(i)) for i in range(n)] + [(99, None)], "d int, x double")
    rows = stats.decile(df, [], "x", "q", ["d"], 10, 10).orderBy("d").collect()
    assert rows[-1]["q"] is None and [r["q"] for r in rows[:-1]] == (want or [None] * n)
    same = stats.decile(df.withColumn("x", F.lit(1.0)), [], "x", "q", ["d"], 10, 10)
    assert {r["q"] for r in same.collect()} == {None}


def test_small_expressions(spark):
    df = spark.createDataFrame([(1.0, 2.0), (-1.0, 0.0), (None, None), (0.0, 4.0)], "a double, b double")
    rows = df.select(stats.sign_or_zero("a").alias("z"), stats.sign_or_null("a").alias("n"), stats.ratio("a", "b").alias("r")).collect()
    assert [tuple(r) for r in rows] == [(1, 1, 0.5), (-1, -1, None), (0, None, None), (0, 0, 0.0)]
    q = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    assert q.agg(stats.quantile_nearest("x", 0.5).alias("a"), stats.quantile_linear("x", 0.5).alias("b")).first()["b"] == 2.5
    assert q.limit(0).agg(stats.quantile_nearest("x", 0.5).alias("a")).first()["a"] is None
    labels = stats.rank_quantile(q, [], "x", "l", k=3).orderBy("x").collect()
    assert [r["l"] for r in labels] == ["q1_lowest", "q1_lowest", "q2", "q3_highest"]
    assert {r["l"] for r in stats.rank_quantile(q.withColumn("x", F.lit(2)), [], "x", "l", plain=True).collect()} == {"all"}


def test_order_of_rows_does_not_matter(spark):
    t = ticks(spark, [(f"2025-01-02 20:{50 + i % 10}:{i % 60:02d}", i % 3, i + 1, 84000 + i * 7 % 13) for i in range(200)])
    d = lambda x: sorted(map(str, flow.window_delta(x, 57000, 57600, 5, dense=True).collect()))
    assert d(t) == d(t.orderBy(F.rand(3)).repartition(7))
