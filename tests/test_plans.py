"""What the optimiser makes of the main queries: pruned scans, no Python, few shuffles."""

import re

import pytest

from sessionflow import queries
from sessionflow.sources.ticks import ticks_from_events, tick_window

NATIVE = ["flow_dense_hourly", "tick_density_hourly", "flow_index_windows", "flow_bucket_paths", "daily_outcomes", "extreme_timing", "range_context", "vwap_premacro", "vwap_retouch", "gap_outcomes", "gap_success_context", "pair_sign_rows", "bucket_lift", "regime_targets", "regime_modeling_table", "liquidity_tick_equals"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_and_no_row_products(spark, sf, name):
    text = plan(queries.queries()[name](spark, sf))
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", text)
    for scan in re.findall(r"ReadSchema: struct<([^>]*)>", text):
        assert not {c.split(":")[0] for c in scan.split(",")} & {"event_id_", "o_custkey", "o_orderstatus"}


@pytest.mark.parametrize("name, most", [("tick_density_hourly", 1), ("flow_macro_delta", 1), ("daily_outcomes", 2), ("vwap_premacro", 1), ("ticks_to_bars", 1), ("session_features", 2), ("flow_index_windows", 2)])
def test_shuffles(spark, sf, name, most):
    assert len(re.findall(r"Exchange hashpartitioning", plan(queries.queries()[name](spark, sf)))) <= most


def test_scan_reads_only_what_is_asked(spark, sf):
    t = ticks_from_events(spark.read.parquet(f"{sf}/events.parquet")).select("ts", "size")
    text = plan(t)
    assert "user_id" not in text.split("ReadSchema")[1] and "value" not in text.split("ReadSchema")[1]
    raw = spark.read.parquet(f"{sf}/events.parquet")
    assert "GreaterThanOrEqual(ts" in plan(tick_window(raw, "2024-01-05 00:00:00", "2024-01-06 00:00:00"))


@pytest.mark.parametrize("name", ["rolling_quantile_forecast", "har_forecast"])
def test_trailing_windows_join_no_ranges(spark, sf, name):
    text = plan(queries.queries()[name](spark, sf))
    assert "NestedLoop" not in text and "CartesianProduct" not in text
