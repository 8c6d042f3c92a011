"""Minute bars: reading, normalising, resampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecols import ZONE, minute_of_day, wall, wall_to_utc_checked

OHLCV = ("Open", "High", "Low", "Close", "Volume")
UTC_NAMES, WALL_NAMES = ("datetime_utc", "DateTime_UTC"), ("DateTime_ET", "datetime_et")
CANDIDATES = {"dt": ("datetime_et", "datetime", "timestamp", "date", "time"), "open": ("open", "o"), "high": ("high", "h"), "low": ("low", "l"), "close": ("close", "c", "last")}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or csv with a header and inferred types."""
    if path.lower().endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    return spark.read.parquet(path)


def normalize_bars(df: DataFrame, check: bool = True, zone: str = ZONE) -> DataFrame:
    """(datetime_utc, OHLCV[, instrument]) from one of four timestamp columns, UTC or New York.

    With ``check`` a job counts bad rows and raises: timestamps that can't be
    parsed, wall times that are ambiguous or skipped by a clock change,
    duplicates. Order is a matter of the reader, so rows are not sorted.
    """
    name = next((c for c in (*UTC_NAMES, *WALL_NAMES) if c in df.columns), None)
    if name is None:
        raise ValueError(f"expected one of: {', '.join((*UTC_NAMES, *WALL_NAMES))}")
    if missing := [c for c in OHLCV if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    parsed = F.try_to_timestamp(F.col(name).cast("string"))
    if name in WALL_NAMES:
        utc, unclear = wall_to_utc_checked(parsed, zone)
    else:
        utc, unclear = parsed, F.lit(False)
    extra = ["instrument"] if "instrument" in df.columns else []
    out = df.select(utc.alias("datetime_utc"), *OHLCV, *extra, unclear.alias("_unclear"))
    if check:
        bad = out.agg(F.count_if(F.col("datetime_utc").isNull()).alias("null"), F.count_if("_unclear").alias("unclear")).first()
        if bad["null"]:
            raise ValueError("timestamp column has values that can't be parsed")
        if bad["unclear"]:
            raise ValueError("wall times are ambiguous or skipped at a clock change; provide datetime_utc")
        if out.groupBy("datetime_utc", *extra).count().where("count > 1").limit(1).count():
            raise ValueError("duplicate datetime_utc values")
    return out.drop("_unclear")


def load_bars(spark: SparkSession, path: str) -> DataFrame:
    return normalize_bars(read_any(spark, path))


def map_ohlc(df: DataFrame, candidates: Mapping[str, Sequence[str]] = CANDIDATES) -> DataFrame:
    """Columns renamed to dt, open, high, low, close by the first candidate name present, whatever its case."""
    have = {c.lower(): c for c in df.columns}
    chosen = {}
    for target, names in candidates.items():
        found = next((have[n.lower()] for n in names if n.lower() in have), None)
        if found is None:
            raise ValueError(f"no column for {target}; looked for {list(names)}")
        chosen[target] = found
    return df.select(*(F.col(f"`{c}`").alias(t) for t, c in chosen.items()))


def resample(bars: DataFrame, minutes: int, by: Sequence[str] = (), ts: str = "datetime_utc") -> DataFrame:
    """Bars of ``minutes`` minutes; empty ones don't appear."""
    start = F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / (60 * minutes)) * (60 * minutes))
    return bars.groupBy(*by, start.alias("bar_start")).agg(
        F.min_by("Open", ts).alias("Open"), F.max("High").alias("High"), F.min("Low").alias("Low"), F.max_by("Close", ts).alias("Close"), F.sum("Volume").alias("Volume")
    ).withColumnRenamed("bar_start", ts)


def hourly_bars(bars: DataFrame, hours: Sequence[int] = (12, 13, 14), minutes: int = 60, ts: str = "datetime_utc", zone: str = ZONE) -> DataFrame:
    """OHLC per New York date and hour, only hours with at least ``minutes`` bars."""
    local = wall(ts, zone)
    hour = bars.where(F.hour(local).isin(*hours)).groupBy(F.to_date(local).alias("date"), F.hour(local).alias("hour"))
    out = hour.agg(
        F.min_by("Open", ts).alias("open"), F.max("High").alias("high"), F.min("Low").alias("low"), F.max_by("Close", ts).alias("close"), F.countDistinct(minute_of_day(local)).alias("n_minutes")
    )
    return out.where(F.col("n_minutes") >= minutes)
