"""What the query modules share: the adapted inputs and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecols import wall
from ..sources.ticks import minute_bars, ticks_from_events

#: The study window in seconds of the day and its hours.
START, END, HOURS = 12 * 3600, 18 * 3600, (12, 13, 14, 15, 16, 17)

TICKS = """ticks AS (
  SELECT event_id AS rk, ts, timezone('America/New_York', timezone('UTC', ts)) AS et, user_id, round(value * 4)::BIGINT AS price_ticks, round(value * 4) / 4.0 AS price,
    (props->>'$.k')::BIGINT AS size, CASE WHEN event_type IN ('purchase', 'signup') THEN 2 WHEN event_type = 'error' THEN 1 ELSE 0 END AS side
  FROM events
), et_ticks AS (
  SELECT *, et::DATE AS date, hour(et)::INT AS h, (hour(et) * 3600 + minute(et) * 60 + floor(second(et)))::INT AS sec FROM ticks
)"""
BARS = (
    TICKS
    + """, bars AS (
  SELECT date, h, min(date_trunc('hour', ts)) AS datetime_utc, arg_min(price, (ts, rk)) AS o, max(price) AS hi, min(price) AS lo, arg_max(price, (ts, rk)) AS c, sum(size)::BIGINT AS v
  FROM et_ticks GROUP BY date, h
)"""
)
DELTA = """sum(CASE WHEN side = 2 THEN size ELSE 0 END)::BIGINT AS buy_size, sum(CASE WHEN side = 1 THEN size ELSE 0 END)::BIGINT AS sell_size,
    sum(CASE WHEN side = 0 THEN size ELSE 0 END)::BIGINT AS none_size, sum(size)::BIGINT AS total_size, count(*) FILTER (WHERE side = 2)::BIGINT AS buy_ticks,
    count(*) FILTER (WHERE side = 1)::BIGINT AS sell_ticks, count(*) FILTER (WHERE side = 0)::BIGINT AS none_ticks,
    sum(CASE WHEN side > 0 THEN size ELSE 0 END)::BIGINT AS classified_size, sum(CASE side WHEN 2 THEN size WHEN 1 THEN -size ELSE 0 END)::BIGINT AS volume_delta,
    (count(*) FILTER (WHERE side = 2) - count(*) FILTER (WHERE side = 1))::BIGINT AS tick_delta"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with date and hour (h) of the New York clock."""
    b = minute_bars(ticks(spark, sf_dir), 3600)
    local = wall("datetime_utc")
    return b.withColumn("date", F.to_date(local)).withColumn("h", F.hour(local))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, zero without a sign."""
    return df.select(*(((F.round(c, places) + 0.0).alias(c)) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def rounded_sql(sql: str, doubles: list[str], others: list[str], places: int = 6) -> str:
    """The same in SQL for a query that ends in ``final``."""
    columns = [*others, *(f"round({c}::DOUBLE, {places}) + 0.0 AS {c}" for c in doubles)]
    return f"{sql} SELECT {', '.join(columns)} FROM final"
