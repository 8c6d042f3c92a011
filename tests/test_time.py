import datetime as dt

import pytest
from pyspark.sql import functions as F

from sessionflow.functions import timecols as t
from sessionflow.sources.bars import load_bars, map_ohlc, normalize_bars, resample
from sessionflow.sources.news import normalize_news
from sessionflow.sources.sinks import write_canonical_bars, write_fan_out, write_study
from sessionflow.sources.ticks import check_schema, minute_bars, normalize, scan_source, scan_tick_data, tick_window


def ts(text):
    return dt.datetime.fromisoformat(text)


def test_market_time_follows_daylight_saving(spark):
    df = spark.createDataFrame([(ts("2025-01-02 20:50:00"),), (ts("2025-07-02 19:50:00"),)], "datetime_utc timestamp")
    rows = t.with_session_window(df).collect()
    assert [r["minute_of_day_et"] for r in rows] == [950, 950] and {r["window"] for r in rows} == {"MACRO"}


@pytest.mark.parametrize("minute, session, window", [(0, "OTHER", "NONE"), (119, "OTHER", "NONE"), (120, "LONDON", "NONE"), (300, "OTHER", "NONE"), (570, "NYAM", "NONE"), (720, "LUNCH", "NONE"), (780, "PM", "NONE"), (900, "OTHER", "H3PM"), (949, "OTHER", "H3PM"), (950, "OTHER", "MACRO"), (960, "OTHER", "POST"), (970, "OTHER", "POST"), (971, "OTHER", "NONE"), (1140, "ASIA", "NONE"), (1439, "ASIA", "NONE")])
def test_sessions_and_windows(spark, minute, session, window):
    (r,) = t.with_session_window(spark.createDataFrame([(minute,)], "minute_of_day_et int")).collect()
    assert (r["session"], r["window"]) == (session, window)


def test_trade_date_rolls_at_18(spark):
    df = spark.createDataFrame([(ts("2025-01-02 21:59:00"),), (ts("2025-01-02 22:30:00"),), (ts("2025-01-02 23:00:00"),), (ts("2025-01-03 04:59:00"),)], "datetime_utc timestamp")
    rows = sorted((r["session_minute_index"], str(r["trade_date_et"])) for r in t.with_trade_date(df).collect())
    assert rows == [(0, "2025-01-03"), (359, "2025-01-03"), (1379, "2025-01-02")]


def test_ambiguous_and_missing_wall_times(spark):
    df = spark.createDataFrame([(ts("2024-11-03 01:30:00"),), (ts("2024-03-10 02:30:00"),), (ts("2024-11-03 00:59:00"),), (ts("2024-06-01 12:00:00"),)], "w timestamp")
    _, bad = t.wall_to_utc_checked("w")
    assert [r[0] for r in df.select(bad).collect()] == [True, True, False, False]


def test_grid_instants(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, 2),), (dt.date(2025, 7, 2),)], "d date").select(t.grid_utc("d", 15 * 3600 + 50 * 60, F.lit(2), 5).alias("x"))
    assert [str(r["x"]) for r in df.collect()] == ["2025-01-02 20:50:10", "2025-07-02 19:50:10"]


def test_dense_grid_and_complete_days(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 2, 7), ("b", 1, 1)], "d string, bucket_index int, x int")
    rows = sorted((r["d"], r["bucket_index"], r["x"], r["is_empty"]) for r in t.densify(df, "d", 3, ["x"]).collect())
    assert rows == [("a", 0, 5, False), ("a", 1, 0, True), ("a", 2, 7, False), ("b", 0, 0, True), ("b", 1, 1, False), ("b", 2, 0, True)]
    assert {r["d"] for r in t.complete_days(df, "d", "bucket_index", [0, 2]).collect()} == {"a"}


@pytest.mark.parametrize("title, label", [("FOMC minutes", "FOMC_RATE"), ("Core CPI m/m", "CPI"), ("Non-Farm Payrolls", "NFP"), ("ISM Manufacturing PMI", "ISM_MANUF"), ("ISM Services PMI", "ISM_SERVICES"), ("Bank Holiday", "HOLIDAY"), ("cpix", "OTHER"), (None, "OTHER")])
def test_event_labels(spark, title, label):
    assert spark.createDataFrame([(title,)], "t string").select(t.classify_event("t")).first()[0] == label


def test_eras_and_session_detection(spark):
    df = spark.createDataFrame([(x,) for x in ("2020-02-28", "2020-02-29", "2020-03-01", "2020-06-30", "2020-07-01")], "d string")
    assert [t.era(df, "d", n).count() for n in ("pre_covid", "post_covid", "full_dev")] == [1, 1, 3]
    with pytest.raises(ValueError):
        t.era(df, "d", "other")
    spans = {"1pm-3pm": (780, 899), "3pm-3:50pm": (900, 949), "3:50pm-4pm": (950, 960)}
    bars = spark.createDataFrame([("x", ts("2025-01-02 18:00:00")), ("x", ts("2025-01-02 19:59:00")), ("y", ts("2025-01-02 20:50:00")), ("z", ts("2025-01-02 19:00:00")), ("z", ts("2025-01-02 20:55:00"))], "k string, ts timestamp")
    assert {r["k"]: r["session_name"] for r in t.detect_session(bars, ["k"], "ts", spans).collect()} == {"x": "1pm-3pm", "y": "3:50pm-4pm", "z": "unknown"}


def bars(spark, rows, name="datetime_utc"):
    return spark.createDataFrame([(x, 1.0, 2.0, 0.5, 1.5, 10) for x in rows], f"{name} string, Open double, High double, Low double, Close double, Volume long")


def test_bar_layouts_and_rejections(spark):
    assert normalize_bars(bars(spark, ["2025-01-02 20:50:00"])).first()["datetime_utc"] == ts("2025-01-02 20:50:00")
    assert normalize_bars(bars(spark, ["2025-01-02 15:50:00"], "DateTime_ET")).first()["datetime_utc"] == ts("2025-01-02 20:50:00")
    for rows, name in ((["nonsense"], "datetime_utc"), ([None], "DateTime_UTC"), (["2024-11-03 01:30:00"], "datetime_et"), (["2025-01-02 20:50:00"] * 2, "datetime_utc"), (["x"], "other")):
        with pytest.raises(ValueError):
            normalize_bars(bars(spark, rows, name))
    with pytest.raises(ValueError):
        normalize_bars(bars(spark, ["2025-01-02 20:50:00"]).drop("Volume"))


def test_files_round_trip(spark, tmp_path):
    df = bars(spark, ["2025-01-02 20:50:00", "2025-01-02 20:51:00"])
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "b.csv"))
    assert load_bars(spark, str(tmp_path / "b.csv")).count() == 2
    write_canonical_bars(spark, str(tmp_path / "b.csv"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    write_fan_out(spark.range(5).withColumn("m", F.col("id") % 3), str(tmp_path / "f"), "m", [0, 2])
    assert {p.name for p in (tmp_path / "f").iterdir() if p.is_dir()} == {"m=0", "m=2"}
    write_study(df, str(tmp_path / "s"), df.limit(1), str(tmp_path / "t"), str(tmp_path / "t.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t.csv")).count() == 1
    assert map_ohlc(df.toDF("Timestamp", "OPEN", "High", "l", "Last", "v")).columns == ["dt", "open", "high", "low", "close"]
    with pytest.raises(ValueError):
        map_ohlc(df.select("Open"))


def ticks(spark, rows):
    return spark.createDataFrame(rows, "ts_event long, intra_ts_rank long, side int, price_ticks long, size long")


def test_tick_source(spark, tmp_path):
    ns = 1_735_851_000_000_000_000
    df = ticks(spark, [(ns + 1, 0, 2, 84000, 1), (ns + 999, 0, 1, 84002, 2), (ns, 1, 0, 84001, 3)])
    df.drop("price_ticks").withColumn("price", F.lit(21000.26)).write.parquet(str(tmp_path / "t"))
    assert {r["price_ticks"] for r in scan_source(spark, str(tmp_path / "t")).collect()} == {84001}
    assert scan_tick_data(spark, str(tmp_path / "t")).columns == ["ts_event", "intra_ts_rank", "side", "price_ticks", "size"]
    with pytest.raises(ValueError, match="size"):
        check_schema(df.drop("size"))
    (bar,) = minute_bars(normalize(df)).collect()
    assert (bar["Open"], bar["Close"], bar["High"], bar["Low"], bar["Volume"]) == (84001 / 4, 84002 / 4, 84002 / 4, 21000.0, 6)
    assert tick_window(df, "2025-01-02 20:50:00", "2025-01-02 20:51:00", "ts_event").count() == 3
    with pytest.raises(ValueError):
        tick_window(df, "", "2025-01-02")


def test_news_layouts(spark):
    rows = [("2025-01-02 13:30:00", "high", "CPI release"), ("2025-01-02 15:00:00", "high", "Powell speaks"), ("2025-01-02 15:00:00", "low", "GDP")]
    df = spark.createDataFrame(rows, "datetime_utc string, impact string, title string")
    out = normalize_news(df).collect()
    assert [(r["event_type"], str(r["date_et"])) for r in out] == [("CPI", "2025-01-02")] and out[0]["id"]
    assert normalize_news(df.withColumnRenamed("datetime_utc", "dt_utc"), None, ()).count() == 3
    assert normalize_news(df.select(F.lit("2025-01-02").alias("date"), F.lit("13:30:00").alias("time_utc"), "impact", "title")).count() == 1
    for bad in (df.drop("impact"), df.drop("datetime_utc")):
        with pytest.raises(ValueError):
            normalize_news(bad)


def test_resample(spark):
    df = normalize_bars(bars(spark, [f"2025-01-02 20:{m}:00" for m in (50, 51, 54, 55)]))
    assert sorted(str(r["datetime_utc"]) for r in resample(df, 5).collect()) == ["2025-01-02 20:50:00", "2025-01-02 20:55:00"]
