"""Tables written on the way: lineage cut in the shared folder, ranks without a single-task window."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session does not name one (tests) a temporary folder is
    taken and set, so that later calls agree; on a cluster that is an error,
    as executors would write to disks of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir() or path
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts the lineage and survives lost executors; columnar and compressed,
    so smaller than an RDD checkpoint of the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """``df`` with ``out``: its row number (from 0) in the order of ``order``, nulls last.

    A range partitioning, a sort in each partition and an offset per
    partition: no single-task window. Only one count per partition reaches the
    driver. ``order`` should be unique, else ties are numbered arbitrarily.
    """
    spark, keys = df.sparkSession, [F.col(c).asc_nulls_last() for c in order]
    placed = materialize(
        df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
        .sortWithinPartitions(*keys)
        .select("*", F.monotonically_increasing_id().alias("_at"))
        .select("*", F.shiftright("_at", 33).cast("int").alias("_part"))
    )
    counts = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "_part int, _start long")  # one row per partition
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_at", "_start")
    )
