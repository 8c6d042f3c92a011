"""Small expressions whose exact flavour matters: signs, ratios, quantiles, ranks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import global_rank, materialize

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sign_or_zero(c: ColumnLike) -> Column:
    """1, -1 or 0; null counts as 0."""
    c = col(c)
    return F.when(c > 0, 1).when(c < 0, -1).otherwise(0)


def sign_or_null(c: ColumnLike) -> Column:
    """1, -1 or 0; null stays null."""
    c = col(c)
    return F.when(c.isNull(), F.lit(None).cast("int")).otherwise(sign_or_zero(c))


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def float_ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b as floating point has it: over zero a signed infinity, zero over zero not a number; null where either is null."""
    a, b = col(a).cast("double"), col(b).cast("double")
    over_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(float("nan"))
    return F.when(a.isNotNull() & (b == 0), over_zero).otherwise(F.try_divide(a, b))


def pct(a: ColumnLike, b: ColumnLike) -> Column:
    return ratio(a, b) * 100.0


def share(condition: Column) -> Column:
    """Mean of a condition over the rows where it is known."""
    return F.avg(condition.cast("double"))


def quantile_linear(c: ColumnLike, q: float) -> Column:
    """Exact quantile with linear interpolation (an aggregate)."""
    return F.percentile(col(c).cast("double"), q)


def quantile_nearest(c: ColumnLike, q: float) -> Column:
    """The value whose index is nearest to q (n - 1) (an aggregate); null for no values.

    The values of a group are gathered, so it is for groups of days or events.
    """
    kept = F.sort_array(F.collect_list(col(c).cast("double")))
    index = F.floor(F.lit(q) * (F.size(kept) - 1) + 0.5).cast("int") + 1
    return F.when(F.size(kept) > 0, F.element_at(kept, F.greatest(index, F.lit(1))))


def nearest_quantiles(df: DataFrame, value: str, qs: Mapping[str, float]) -> DataFrame:
    """One row: ``_m``, the count of values, and per name of ``qs`` the value whose index is nearest to q (m - 1).

    Selected by rank over a range partitioning; no values are gathered.
    """
    ranked = global_rank(df.where(col(value).isNotNull()).select(col(value).cast("double").alias("_v")), ["_v"], "_r")
    m = ranked.agg(F.count("*").alias("_m"))
    at = lambda q: F.floor(F.lit(q) * (F.col("_m") - 1) + 0.5)
    picked = ranked.join(F.broadcast(m), how="cross")  # one row
    return picked.agg(F.count("*").alias("_m"), *(F.max(F.when(F.col("_r") == at(q), F.col("_v"))).alias(n) for n, q in qs.items()))


def decile(df: DataFrame, by: Sequence[str], value: str, out: str, ties: Sequence[str] = (), k: int = 10, min_distinct: int = 0) -> DataFrame:
    """``out``: floor((rank - 1) k / n) + 1 over the non-null values of a group, by ordinal rank.

    Null where the group has fewer than ``k`` values or, with ``min_distinct``,
    fewer different ones. Ties rank in the order of ``ties``.
    """
    here = col(value).isNotNull()
    part = Window.partitionBy(*by, here)
    rank = F.row_number().over(part.orderBy(value, *ties))
    n = F.count("*").over(part)
    fine = here & (n >= k)
    if min_distinct:
        new = F.dense_rank().over(part.orderBy(value))
        df = df.withColumn("_dense", new)
        fine = fine & (F.max("_dense").over(part) >= min_distinct)
    bucket = F.floor((rank - 1) * k / n).cast("int") + 1
    return df.withColumn(out, F.when(fine, F.least(bucket, F.lit(k)))).drop("_dense")


def rank_quantile(df: DataFrame, by: Sequence[str], value: str, out: str, ties: Sequence[str] = (), k: int = 5, plain: bool = False) -> DataFrame:
    """``out``: label of a value's part of K by ordinal rank, K the least of k, the count and the number of different values.

    Labels are ``q1_lowest``, ``q2``, ..., ``qK_highest``; with ``plain`` they
    are ``q1`` to ``qK``, and ``all`` for a single value. Without groups the
    rank is taken by a range partitioning, not in one task.
    """
    here = col(value).isNotNull()
    if by:
        part = Window.partitionBy(*by, here)
        df = df.withColumn("_rank", F.row_number().over(part.orderBy(value, *ties))).withColumn("_dense", F.dense_rank().over(part.orderBy(value)))
        df = df.withColumn("_n", F.count("*").over(part)).withColumn("_distinct", F.max("_dense").over(part)).drop("_dense")
    else:
        df = global_rank(df, [value, *ties], "_rank").withColumn("_rank", F.col("_rank") + 1)
        whole = df.agg(F.count(value).alias("_n"), F.countDistinct(value).alias("_distinct"))
        df = df.join(F.broadcast(whole), how="cross")  # one row
    df = df.withColumn("_k", F.least(F.lit(k).cast("long"), F.col("_n"), F.col("_distinct").cast("long")))
    bucket = F.least(F.floor(F.try_divide((F.col("_rank") - 1) * F.col("_k"), F.col("_n"))) + 1, F.col("_k")).cast("int")
    name = F.concat(F.lit("q"), bucket.cast("string"))
    if plain:
        label = F.when(F.col("_k") == 1, "all").otherwise(name)
    else:
        label = F.when(bucket == 1, "q1_lowest").when(bucket == F.col("_k"), F.concat(name, F.lit("_highest"))).otherwise(name)
    return df.withColumn(out, F.when(here, label)).drop("_rank", "_distinct", "_n", "_k")


def average_ranks(df: DataFrame, by: Sequence[str], names: Mapping[str, str]) -> DataFrame:
    """``df`` with, per column of ``names``, its rank within the group under the given name, ties sharing their mean; null for a null.

    Values are counted first and the counts laid out by range over all groups
    and columns, so a large group is ranked by several tasks. Only one sum per
    partition reaches the driver.
    """
    spark, keys = df.sparkSession, [f"_k{i}" for i in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys)]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(names))))
    counted = df.select(*named, each.alias("_e")).select(*keys, "_e.c", "_e.v").where("v is not null").groupBy(*keys, "c", "v").agg(F.count("*").alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = materialize(counted.repartitionByRange(parts, *keys, "c", "v").withColumn("part", F.spark_partition_id()))
    run = Window.partitionBy("part").orderBy(*keys, "c", "v")
    sums = laid.groupBy("part").agg(F.sum("n").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per partition
    placed = laid.withColumn("upto", F.sum("n").over(run)).join(F.broadcast(sums.select("part", before.alias("before"))), "part").select(*keys, "c", "v", "n", (F.col("upto") + F.col("before")).alias("upto"))
    placed = materialize(placed)
    starts = placed.groupBy(*keys, "c").agg(F.min(F.col("upto") - F.col("n")).alias("start"))
    same = [F.col(k).eqNullSafe(F.col(f"s{k}")) for k in keys]
    ranks = placed.join(starts.select(*(F.col(k).alias(f"s{k}") for k in keys), F.col("c").alias("s_c"), "start"), [*same, F.col("c") == F.col("s_c")])
    ranks = ranks.select(*keys, "c", "v", (F.col("upto") - F.col("n") - F.col("start") + (F.col("n") + 1) / 2).alias("rank"))
    for i, (c, out) in enumerate(names.items()):
        own = ranks.where(F.col("c") == i).select(*(F.col(k).alias(f"{k}_{i}") for k in keys), F.col("v").alias(f"_v_{i}"), F.col("rank").alias(out))
        on = [F.col(g).eqNullSafe(F.col(f"{k}_{i}")) for g, k in zip(by, keys)] + [F.col(c).cast("double") == F.col(f"_v_{i}")]
        df = df.join(own, on, "left").drop(*(f"{k}_{i}" for k in keys), f"_v_{i}")
    return df


def guarded_corr(a: ColumnLike, b: ColumnLike) -> Column:
    """Pearson correlation of pairs without nulls; null for one pair or a constant side (an aggregate)."""
    a, b = col(a).cast("double"), col(b).cast("double")
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    fine = (F.count(x) > 1) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    # corr() itself divides by zero for a constant side, whatever guards its result
    return F.when(fine, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Long form of numeric columns: one row per (row, column)."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in values)
    return df.select(*ids, F.expr(f"stack({len(values)}, {pairs}) AS (`{name}`, `{value}`)"))
