"""Economic events: normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import ZONE, classify_event, wall


def normalize_news(df: DataFrame, impacts: Sequence[str] | None = ("high",), exclude: Sequence[str] = ("speaks",), zone: str = ZONE) -> DataFrame:
    """(id, dt_utc, dt_et, date_et, impact, title, event_type, ...) from one of three timestamp layouts.

    Titles that hold a string of ``exclude`` go (case counts). A missing id is
    a hash of time and title, the same on every run.
    """
    if "datetime_utc" in df.columns:
        raw = F.col("datetime_utc").cast("string")
    elif "dt_utc" in df.columns:
        raw = F.col("dt_utc").cast("string")
    elif {"date", "time_utc"} <= set(df.columns):
        raw = F.concat_ws(" ", F.col("date").cast("string"), F.col("time_utc").cast("string"))
    else:
        raise ValueError("news needs datetime_utc, dt_utc, or date and time_utc")
    if missing := [c for c in ("impact", "title") if c not in df.columns]:
        raise ValueError(f"news lacks columns: {missing}")
    df = df.withColumn("dt_utc", F.try_to_timestamp(raw))
    if impacts is not None:
        df = df.where(F.col("impact").isin(*impacts))
    for part in exclude:
        df = df.where(~F.coalesce(F.col("title").contains(part), F.lit(False)))
    if "id" not in df.columns:
        df = df.withColumn("id", F.hex(F.xxhash64("dt_utc", "title")))
    return df.withColumn("event_type", classify_event("title")).withColumn("dt_et", wall("dt_utc", zone)).withColumn("date_et", F.to_date("dt_et"))
