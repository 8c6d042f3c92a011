"""Registered queries of the library and their DuckDB SQL.

The driver's tables hold no ticks, so ``events`` stands for them (see
``sources.ticks.ticks_from_events``); bars are hourly and the window that
studies look at is 12:00 to 18:00 New York time.
"""

from __future__ import annotations

from . import cohort, extremes, flow, forecast, gaps, patterns, regime, vwap

_MODULES = (flow, extremes, vwap, gaps, cohort, regime, forecast, patterns)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
