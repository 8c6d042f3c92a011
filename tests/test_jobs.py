"""Jobs end to end on a few generated days."""

import datetime as dt

import numpy as np
import pytest

from sessionflow.plans import jobs


@pytest.fixture(scope="module")
def market(spark, tmp_path_factory):
    """Ticks (every 5 s from 09:30 to 16:11 New York) and minute bars of a few winter days."""
    path = tmp_path_factory.mktemp("market")
    rng = np.random.default_rng(3)
    ticks, bars = [], []
    for d in range(12):
        start = int(dt.datetime(2025, 1, 6 + d, 14, 30, tzinfo=dt.timezone.utc).timestamp())
        price = 84000 + rng.integers(-6, 7, 401 * 12).cumsum()
        for i, p in enumerate(price.tolist()):
            ticks.append(((start + i * 5) * 10**9, i % 2, int(rng.integers(0, 3)), p, int(rng.integers(1, 9))))
        for m in range(401):
            x = price[m * 12 : m * 12 + 12] / 4.0
            bars.append((dt.datetime.fromtimestamp(start + m * 60, dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S"), x[0], x.max(), x.min(), x[-1], 100))
    spark.createDataFrame(ticks, "ts_event long, intra_ts_rank long, side int, price_ticks long, size long").write.parquet(str(path / "ticks"))
    spark.createDataFrame([tuple(map(lambda v: v.item() if hasattr(v, "item") else v, b)) for b in bars], "datetime_utc string, Open double, High double, Low double, Close double, Volume long").write.parquet(str(path / "bars"))
    return path


def read(spark, *parts):
    return spark.read.parquet("/".join(map(str, parts)))


def test_flow_and_delta_jobs(spark, market):
    jobs.flow_tables(spark, str(market / "ticks"), str(market / "flow"))
    assert read(spark, market, "flow/macro_delta_5s").count() == 12 * 120 and read(spark, market, "flow/macro_delta_1m").count() == 12 * 10
    assert read(spark, market, "flow/tick_density_1m").count() == 12 * 31 and read(spark, market, "flow/tick_density_5s").count() == 12 * 36
    jobs.delta_studies(spark, str(market / "flow"), str(market / "delta"))
    for n, rows in (("delta_reversal", 12), ("delta_impulse", 12), ("bucket_path", 24)):
        assert read(spark, market, "delta", n).count() == rows and read(spark, market, "delta", f"{n}_summary").count() > 0
    assert {r["early_10s_raw_decile"] for r in read(spark, market, "delta/bucket_path").collect()} <= {None, *range(1, 11)}


def test_macro_jobs(spark, market):
    jobs.macro_studies(spark, str(market / "ticks"), str(market / "macro"))
    assert read(spark, market, "macro/extreme_timing").count() == 48 and read(spark, market, "macro/range_context").count() == 12 * 2 * 17
    assert read(spark, market, "macro/vwap_premacro").count() == 12 and read(spark, market, "macro/vwap_retouch").count() == 12
    assert read(spark, market, "macro/vwap_barrier_context").count() == read(spark, market, "macro/barrier").count()
    assert read(spark, market, "macro/vwap_intramacro_summary").where("scope = 'fixed_bps_band'").count() == 4 * 3 * 11


def test_bar_jobs(spark, market):
    jobs.daily_tables(spark, str(market / "bars"), str(market / "daily"))
    assert read(spark, market, "daily/pm_macro_interaction").count() == 12
    jobs.gap_study(spark, str(market / "bars"), str(market / "gaps"))
    events = read(spark, market, "gaps/gap_events")
    assert events.where("assigned_at < 0 or assigned_at > 8").count() == 0 and read(spark, market, "gaps/gap_summary").count() > 0
    jobs.historical_regimes(spark, str(market / "bars"), str(market / "regimes"))
    rows = read(spark, market, "regimes").collect()
    assert len(rows) == 24 and {r["session_name"] for r in rows} == {"1pm-3pm", "3pm-3:50pm"} and all(r["feature_status"] == "ok" and r["n"] in (50, 120) for r in rows)
