"""Bars, order flow and anchored VWAP from a stream of ticks (columns as ``sources.ticks.normalize`` returns)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timecols import ZONE, second_of_day, wall, within
from ..operators.flow import delta
from ..sources.ticks import order_key, price


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def streaming_bars(ticks: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """OHLCV per tumbling window; a window comes out once the watermark passes it, later ticks are dropped."""
    p, at = price(), order_key()
    w = F.window("ts", width)
    out = ticks.withWatermark("ts", late).groupBy(w).agg(F.min_by(p, at).alias("Open"), F.max(p).alias("High"), F.min(p).alias("Low"), F.max_by(p, at).alias("Close"), F.sum("size").alias("Volume"))
    return out.select(F.col("window.start").alias("datetime_utc"), "Open", "High", "Low", "Close", "Volume")


def streaming_delta(ticks: DataFrame, width: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """Order-flow measures per tumbling window, as in the batch form."""
    out = delta(ticks.withWatermark("ts", late), [F.window("ts", width).alias("w")])
    return out.withColumn("datetime_utc", F.col("w.start")).drop("w")


def streaming_vwap(ticks: DataFrame, start: int, end: int, zone: str = ZONE, late: str = "2 hours") -> DataFrame:
    """Running VWAP and last price of each day's window: one row of state per day, dropped once the watermark of local time passes the day."""
    local = ticks.withColumn("_local", wall("ts", zone))
    inside = local.where(within(second_of_day(F.col("_local")), start, end)).withWatermark("_local", late)
    out = inside.groupBy(F.window("_local", "1 day")).agg(F.sum(price() * F.col("size")).alias("_pv"), F.sum("size").alias("volume"), F.max_by(price(), order_key()).alias("last_price"))
    vwap = F.when(F.col("volume") > 0, F.col("_pv") / F.col("volume"))
    return out.select(F.to_date("window.start").alias("date"), "volume", "last_price", vwap.alias("vwap"))


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is and stop; results go to the in-memory table ``name`` (for tests and small runs)."""
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Batches of updates after which a keyed table is merged into one folder.
COMPACT = 16


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers of the folders ``kind=<number>`` under ``path`` that were written in full; none where there is no such path."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    found = [int(x.split("=")[1]) for x in names if x.startswith(f"{kind}=")]
    return sorted(n for n in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}={n}/_SUCCESS")))


def keyed_table(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The latest row of each key of a table of updates at ``path``; an empty table where no batch has been written."""
    merged = _numbers(spark, path, "merged")[-1:]
    after = [n for n in _numbers(spark, path, "batch") if not merged or n > merged[0]]
    parts = [spark.read.schema(schema).parquet(f"{path}/{k}={n}").withColumn("_batch", F.lit(n).cast("long")) for k, ns in (("merged", merged), ("batch", after)) for n in ns]
    if not parts:
        return spark.createDataFrame([], schema)
    rest = [c for c in schema.names if c not in keys]
    return reduce(DataFrame.union, parts).groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_last")).select(*(F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in schema.names))


def write_available(df: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ()) -> DataFrame:
    """Process what there is into Parquet files at ``path`` and return them; nothing passes through the driver.

    Without ``keys`` closed windows are appended. With ``keys`` each batch's
    updates are written to a folder of its own, which a repeated batch
    overwrites; every ``COMPACT`` batches the latest rows are merged into one
    folder, from which reading begins. The latest row of each key is returned.
    An empty source gives an empty table.
    """
    spark, schema = df.sparkSession, df.schema
    out = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if not keys:
        out.format("parquet").outputMode("append").option("path", path).start().awaitTermination()
        return spark.read.schema(schema).parquet(path)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number % COMPACT == COMPACT - 1:
            keyed_table(batch.sparkSession, path, schema, keys).write.mode("overwrite").parquet(f"{path}/merged={number}")

    out.outputMode("update").foreachBatch(save).start().awaitTermination()
    return keyed_table(spark, path, schema, keys)
