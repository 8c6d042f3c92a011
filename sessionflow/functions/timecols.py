"""Market time: New York wall clock, sessions, windows, buckets and dense grids.

Timestamps are UTC instants in a session whose time zone is UTC; wall-clock
columns are timestamps that read as New York time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import ColumnLike, col

ZONE = "America/New_York"
#: Half-open sessions and closed windows in minutes of the day (fixed values).
SESSIONS = (("ASIA", 19 * 60, 24 * 60), ("LONDON", 2 * 60, 5 * 60), ("NYAM", 9 * 60 + 30, 11 * 60), ("LUNCH", 12 * 60, 13 * 60), ("PM", 13 * 60, 15 * 60))
WINDOWS = (("H3PM", 15 * 60, 15 * 60 + 49), ("MACRO", 15 * 60 + 50, 15 * 60 + 59), ("POST", 16 * 60, 16 * 60 + 10))
#: Event titles by the first pattern that matches (fixed values; the order counts).
EVENT_PATTERNS = (
    ("FOMC_RATE", r"\b(fomc|fed funds|rate decision|interest rate decision)\b"),
    ("FOMC_MINUTES", r"\b(fomc minutes)\b"),
    ("FOMC_PRESSER", r"\b(press conference|powell speaks|fed chair .*press)\b"),
    ("CPI", r"\b(cpi|consumer price)\b"),
    ("PCE", r"\b(pce|personal consumption expenditures)\b"),
    ("NFP", r"\b(nonfarm|non-farm|payroll)\b"),
    ("PPI", r"\b(ppi|producer price)\b"),
    ("ISM_MANUF", r"\b(ism).*manufacturing\b"),
    ("ISM_SERVICES", r"\b(ism).*services\b"),
    ("RETAIL_SALES", r"\b(retail sales)\b"),
    ("GDP", r"\b(gdp)\b"),
    ("HOLIDAY", r"\b(holiday|market holiday|bank holiday)\b"),
)


def wall(ts: ColumnLike, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(col(ts), zone)


def second_of_day(local: ColumnLike) -> Column:
    c = col(local)
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def minute_of_day(local: ColumnLike) -> Column:
    c = col(local)
    return F.hour(c) * 60 + F.minute(c)


def with_market_time(df: DataFrame, ts: str = "datetime_utc", zone: str = ZONE) -> DataFrame:
    """Adds datetime_et, date_et and minute_of_day_et."""
    df = df.withColumn("datetime_et", wall(ts, zone))
    return df.withColumn("date_et", F.to_date("datetime_et")).withColumn("minute_of_day_et", minute_of_day("datetime_et"))


def with_session_window(df: DataFrame, sessions: Sequence = SESSIONS, windows: Sequence = WINDOWS) -> DataFrame:
    """Adds session (half-open minutes) and window (closed minutes)."""
    if "minute_of_day_et" not in df.columns:
        df = with_market_time(df)
    m = F.col("minute_of_day_et")
    session, window = F.lit("OTHER"), F.lit("NONE")
    for name, a, b in reversed(sessions):
        session = F.when((m >= a) & (m < b), name).otherwise(session)
    for name, a, b in reversed(windows):
        window = F.when(m.between(a, b), name).otherwise(window)
    return df.withColumn("session", session).withColumn("window", window)


def with_trade_date(df: DataFrame, ts: str = "datetime_utc", roll_hour: int = 18, close_hour: int = 17, zone: str = ZONE) -> DataFrame:
    """Adds trade_date_et and session_minute_index: the day rolls at ``roll_hour``; the break before it is dropped."""
    local = wall(ts, zone)
    minute = minute_of_day(local)
    df = df.where((minute < close_hour * 60) | (minute >= roll_hour * 60))
    after = minute >= roll_hour * 60
    return df.withColumn("trade_date_et", F.when(after, F.date_add(F.to_date(local), 1)).otherwise(F.to_date(local))).withColumn(
        "session_minute_index", F.when(after, minute - roll_hour * 60).otherwise(minute + (24 - roll_hour) * 60)
    )


def bucket_index(local: ColumnLike, start_second: int, seconds: int) -> Column:
    """Index of the fixed-width bucket of a wall-clock time from ``start_second`` on."""
    return F.floor((second_of_day(local) - start_second) / seconds).cast("int")


def within(second: ColumnLike, start: int, end: int) -> Column:
    """Half-open interval of seconds (or minutes)."""
    return (col(second) >= start) & (col(second) < end)


def dense_grid(days: DataFrame, day: str, n: int, index: str = "bucket_index") -> DataFrame:
    """Every day of ``days`` (distinct) with indexes 0 to n - 1."""
    return days.select(day).distinct().withColumn(index, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def densify(buckets: DataFrame, day: str, n: int, zero: Sequence[str], index: str = "bucket_index") -> DataFrame:
    """``buckets`` on a dense grid of its days: missing rows get zeros in ``zero`` and ``is_empty``."""
    filled = dense_grid(buckets, day, n, index).join(buckets.withColumn("_here", F.lit(True)), [day, index], "left")
    out = filled.withColumn("is_empty", F.col("_here").isNull()).drop("_here")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})


def grid_utc(day: ColumnLike, start_second: int, index: ColumnLike, seconds: int, zone: str = ZONE) -> Column:
    """The UTC instant at which a bucket of a wall-clock grid starts."""
    local = F.timestamp_seconds(F.unix_timestamp(col(day).cast("timestamp")) + start_second + col(index) * seconds)
    return F.to_utc_timestamp(local, zone)


def complete_days(df: DataFrame, day: str, key: str, required: Sequence[int]) -> DataFrame:
    """Rows of the days that have all ``required`` values of ``key``."""
    whole = df.where(F.col(key).isin(*required)).groupBy(day).agg(F.countDistinct(key).alias("_n")).where(F.col("_n") == len(set(required)))
    return df.join(whole.select(day), day, "left_semi")


def detect_session(df: DataFrame, by: Sequence[str], ts: str, spans: Mapping[str, tuple[int, int]], zone: str = ZONE) -> DataFrame:
    """Per group the first session whose minutes [start, end] hold all its times, else ``unknown``."""
    m = minute_of_day(wall(ts, zone))
    seen = df.groupBy(*by).agg(F.min(m).alias("_a"), F.max(m).alias("_b"))
    name = F.lit("unknown")
    for key, (a, b) in reversed(list(spans.items())):
        name = F.when((F.col("_a") >= a) & (F.col("_b") <= b), key).otherwise(name)
    return seen.select(*by, name.alias("session_name"))


def era(df: DataFrame, day: str, name: str, pre_end: str = "2020-02-28", transition: tuple[str, str] = ("2020-03-01", "2020-06-30"), post_start: str = "2020-07-01") -> DataFrame:
    """Rows of an era: ``pre_covid``, ``post_covid`` or ``full_dev`` (all but the transition)."""
    d = F.col(day).cast("date")
    eras = {
        "pre_covid": d <= F.lit(pre_end).cast("date"),
        "post_covid": d >= F.lit(post_start).cast("date"),
        "full_dev": ~d.between(F.lit(transition[0]).cast("date"), F.lit(transition[1]).cast("date")),
    }
    if name not in eras:
        raise ValueError(f"unknown era: {name}")
    return df.where(eras[name])


def classify_event(title: ColumnLike) -> Column:
    low, label = F.lower(col(title)), F.lit("OTHER")
    for name, pattern in reversed(EVENT_PATTERNS):
        label = F.when(low.rlike(pattern), name).otherwise(label)
    return label


def wall_to_utc_checked(local: ColumnLike, zone: str = ZONE) -> tuple[Column, Column]:
    """(UTC instant, whether the wall time is ambiguous or does not exist)."""
    c = col(local)
    utc = F.to_utc_timestamp(c, zone)
    hour = F.expr("INTERVAL 1 HOUR")
    missing = F.from_utc_timestamp(utc, zone) != c
    twice = (F.from_utc_timestamp(utc + hour, zone) == c) | (F.from_utc_timestamp(utc - hour, zone) == c)
    return utc, missing | twice
