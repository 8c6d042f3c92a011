"""Days whose first hours move neither up nor down, so that DX begins late: the queries with ADX against their SQL."""

import datetime as dt

import pytest

from sessionflow import queries

from .test_zero_price import compare

#: Low and high of each hour: quiet for the first hours and then moving, moving throughout, quiet throughout.
DAYS = {
    8: [(5, 10)] * 4 + [(6, 12), (7, 15), (4, 9), (8, 20), (3, 11), (9, 21), (2, 14), (7, 16)], 9: [(5 + i % 3, 12 + i % 5) for i in range(11)],
    10: [(5, 10)] * 9, 11: [(5, 10)] * 6 + [(7, 12), (6, 13), (8, 11), (5, 15)],
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("quiet"))
    ticks = [(dt.datetime(2024, 1, d, 8 + h, m), p) for d, hours in DAYS.items() for h, (low, high) in enumerate(hours) for m, p in enumerate((low + 1, high, low, high - 2))]
    rows = [(i, ts, i % 3, ("purchase", "error", "view")[i % 3], float(p), f'{{"k": {i % 9 + 1}}}') for i, (ts, p) in enumerate(ticks)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["regime_directional_bars", "regime_trend_quality", "regime_modeling_table"])
def test_quiet_start(spark, folder, name):
    got, want = compare(spark, folder, name)
    assert got == want


def test_average_starts_at_its_bar(spark, folder):
    rows = queries.queries()["regime_directional_bars"](spark, folder).where("date = '2024-01-08'").orderBy("bar").collect()
    assert [r["dx"] is None for r in rows[:5]] == [True] * 4 + [False] and [r["adx"] is None for r in rows[:7]] == [True] * 6 + [False]
