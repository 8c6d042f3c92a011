"""Trade ticks: (ts_ns, ts, intra_ts_rank, side, price_ticks, size), ordered by (ts_ns, intra_ts_rank).

``ts_ns`` is the nanosecond epoch and the ordering key; ``ts`` is the instant
in microseconds. Files with nanosecond timestamps need the session setting
``spark.sql.legacy.parquet.nanosAsLong=true``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TICK_COLUMNS = ("ts_event", "intra_ts_rank", "side", "price_ticks", "size")
SCALE = 4
BUY, SELL, NONE = 2, 1, 0


def scan_source(spark: SparkSession, paths: str | Sequence[str], scale: int = SCALE, with_file: bool = False) -> DataFrame:
    """Parquet files (paths or globs); ``price_ticks`` is made from ``price`` where it is absent."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else sorted(paths)))
    if "price_ticks" not in df.columns and "price" in df.columns:
        df = df.withColumn("price_ticks", F.round(F.col("price") * scale).cast("long"))
    return df.withColumn("__srcfile", F.col("_metadata.file_name")) if with_file else df


def missing_columns(schema: T.StructType, required: Sequence[str] = TICK_COLUMNS) -> list[str]:
    return sorted(set(required) - set(schema.names))


def check_schema(df: DataFrame, required: Sequence[str] = TICK_COLUMNS) -> DataFrame:
    """``df``, or ValueError naming the columns it lacks; reads no rows."""
    if missing := missing_columns(df.schema, required):
        raise ValueError(f"missing tick columns: {missing}")
    return df


def normalize(df: DataFrame) -> DataFrame:
    """Ticks with ``ts_ns`` and ``ts`` from a long (nanoseconds) or timestamp ``ts_event``, the five columns checked."""
    check_schema(df)
    kind = df.schema["ts_event"].dataType
    event = F.col("ts_event")
    if isinstance(kind, T.LongType):
        ns, ts = event, F.timestamp_micros(F.expr("ts_event div 1000"))
    else:
        ts = event.cast("timestamp")
        ns = F.unix_micros(ts) * 1000
    return df.select(ns.alias("ts_ns"), ts.alias("ts"), F.col("intra_ts_rank").cast("long"), F.col("side").cast("int"), F.col("price_ticks").cast("long"), F.col("size").cast("long"))


def scan_tick_data(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The five tick columns of a source; other columns are pruned from the scan."""
    return check_schema(scan_source(spark, paths)).select(*TICK_COLUMNS)


def tick_window(ticks: DataFrame, start_utc: str, end_utc: str, column: str = "ts") -> DataFrame:
    """Ticks of the half-open interval [start, end); the literals are pushed down to the scan of a stored column."""
    if not start_utc or not end_utc:
        raise ValueError("start_utc and end_utc are required")
    kind = ticks.schema[column].dataType
    if isinstance(kind, T.LongType):
        bound = lambda x: F.unix_micros(F.lit(x).cast("timestamp")) * 1000
    else:
        bound = lambda x: F.lit(x).cast(kind)
    return ticks.where((F.col(column) >= bound(start_utc)) & (F.col(column) < bound(end_utc)))


def order_key() -> Column:
    return F.struct("ts_ns", "intra_ts_rank")


def price(scale: int = SCALE) -> Column:
    return F.col("price_ticks") / float(scale)


def minute_bars(ticks: DataFrame, seconds: int = 60, by: Sequence[str] = (), scale: int = SCALE) -> DataFrame:
    """OHLCV bars per UTC bucket of ticks; first and last are by (ts_ns, intra_ts_rank), not by row order."""
    p, at = price(scale), order_key()
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / seconds) * seconds)
    return ticks.groupBy(*by, start.alias("datetime_utc")).agg(
        F.min_by(p, at).alias("Open"), F.max(p).alias("High"), F.min(p).alias("Low"), F.max_by(p, at).alias("Close"), F.sum("size").alias("Volume")
    )


def ticks_from_events(events: DataFrame) -> DataFrame:
    """The ``events`` table seen as ticks: value is the price, props.k the size, the event type the side."""
    side = F.when(F.col("event_type").isin("purchase", "signup"), BUY).when(F.col("event_type") == "error", SELL).otherwise(NONE)
    ts = F.col("ts").cast("timestamp")
    return events.select(
        (F.unix_micros(ts) * 1000).alias("ts_ns"), ts.alias("ts"), F.col("event_id").alias("intra_ts_rank"), side.alias("side"),
        F.round(F.col("value") * SCALE).cast("long").alias("price_ticks"), F.get_json_object("props", "$.k").cast("long").alias("size"), F.col("user_id"),
    )
