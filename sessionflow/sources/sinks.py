"""Writers. Every sink is one Spark job per table; partition columns make later day and instrument filters prune files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .bars import normalize_bars, read_any


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), kind: str = "parquet") -> None:
    if kind not in ("parquet", "csv"):
        raise ValueError(f"unknown format: {kind}")
    writer = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def write_study(study: DataFrame, path: str, summary: DataFrame | None = None, summary_path: str | None = None, csv_path: str | None = None) -> None:
    """A study, its summary and, if asked for, the summary as csv."""
    write_table(study, path)
    if summary is not None and summary_path:
        write_table(summary, summary_path)
    if summary is not None and csv_path:
        write_table(summary, csv_path, kind="csv")


def write_fan_out(df: DataFrame, path: str, key: str, values: Sequence[int]) -> None:
    """One folder per selected value of ``key``, in one job."""
    write_table(df.where(df[key].isin(*values)), path, [key])


def write_canonical_bars(spark: SparkSession, source: str, path: str) -> None:
    """A csv or Parquet bar file, normalised and partitioned by instrument if it names one."""
    bars = normalize_bars(read_any(spark, source))
    write_table(bars, path, ["instrument"] if "instrument" in bars.columns else [])
