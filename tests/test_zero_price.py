"""Gaps entered at a price of zero: every gap query that reads excursions against its SQL."""

import datetime as dt
import math

import duckdb
import pytest

from sessionflow import queries

#: Prices of each user's days: gaps down to zero, entered there and followed by a rise, by zero alone or by nothing; a gap of positive prices.
DAYS = {
    0: {3: [20], 4: [10], 5: [5, 0], 6: [0], 7: [3], 8: [4]}, 1: {3: [20], 4: [10], 5: [5, 0], 6: [0], 7: [0, 2]}, 2: {3: [20], 4: [10], 5: [5, 0], 6: [0]},
    3: {3: [10], 4: [15], 5: [20, 21], 6: [22], 7: [15, 19], 8: [40]}, 4: {3: [40], 4: [30], 5: [20, 21], 6: [19, 20], 7: [12], 8: [25, 33]},
}


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def compare(spark, folder, name):
    got = queries.queries()[name](spark, folder)
    columns = sorted(got.columns)
    rel = duckdb.connect().execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'").execute(queries.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = [[norm(r[names.index(c)]) for c in columns] for r in rel.fetchall()]
    return sorted(([norm(r[c]) for c in columns] for r in got.collect()), key=str), sorted(want, key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("zero"))
    ticks = [(u, dt.datetime(2024, 1, d, 17, i), p) for u, days in DAYS.items() for d, prices in days.items() for i, p in enumerate(prices)]
    rows = [(i, ts, u, ("purchase", "error", "view")[(i + u) % 3], float(p), f'{{"k": {i % 9 + 1}}}') for i, (u, ts, p) in enumerate(ticks)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["gap_outcomes", "gap_delta_dominance", "gap_outcome_rates", "gap_entry_excursions", "gap_success_context", "gap_all_summaries", "gap_excursion_profiles", "gap_position_tables"])
def test_entry_at_zero(spark, folder, name):
    got, want = compare(spark, folder, name)
    assert got == want


def test_excursions_from_zero(spark, folder):
    rows = {r["user_id"]: (r["mfe_pct"], norm(r["mae_pct"])) for r in queries.queries()["gap_outcomes"](spark, folder).where("assigned_at = 4").collect()}
    assert rows[0] == (-math.inf, math.inf) and norm(rows[1][0]) == "nan" and rows[1][1] == math.inf and rows[2] == (None, None) and all(math.isfinite(x) for x in rows[4])
