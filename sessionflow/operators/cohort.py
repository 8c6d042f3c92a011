"""Cohort statistics shared by the studies: predictor against target, deciles, tails, lifts, correlations, bands.

Wide studies (one row per day) are turned to long form once; every table is
then one grouped aggregate instead of a query per row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import average_ranks, decile, guarded_corr, pct, quantile_linear, quantile_nearest, ratio, share, sign_or_zero, unpivot
from ..functions.tables import materialize


def pair_long(study: DataFrame, day: str, predictors: Sequence[str], targets: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """A row per day, predictor and target: x, y (volume deltas), imb (the predictor's imbalance)."""
    p = F.array(*(F.struct(F.lit(n).alias("predictor"), F.col(f"{n}_volume_delta").cast("double").alias("x"), F.col(f"{n}_delta_imbalance").alias("imb")) for n in predictors))
    t = F.array(*(F.struct(F.lit(n).alias("target"), F.col(f"{n}_volume_delta").cast("double").alias("y")) for n in targets))
    return study.select(day, *keep, F.explode(p).alias("p"), t.alias("t")).select(day, *keep, "p.*", F.explode("t").alias("t")).select(day, *keep, "predictor", "x", "imb", "t.*")


def _pair_aggregates() -> list[Column]:
    a, b = sign_or_zero("x"), sign_or_zero("y")
    return [
        F.count("*").alias("n_days"), F.count_if((a != 0) & (b != 0)).alias("n_signal_days"), F.count_if(a * b < 0).alias("opposite_count"), F.count_if(a * b > 0).alias("same_count"),
        F.count_if(a == 0).alias("zero_predictor_count"), F.count_if(b == 0).alias("zero_target_count"), F.avg("x").alias("mean_predictor_delta"), F.median("x").alias("median_predictor_delta"),
        F.avg("y").alias("mean_target_delta"), F.median("y").alias("median_target_delta"), quantile_nearest("y", 0.25).alias("target_p25"), quantile_nearest("y", 0.75).alias("target_p75"), guarded_corr("x", "y").alias("pearson"),
    ]


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumn("opposite_rate", ratio("opposite_count", "n_signal_days")).withColumn("same_rate", ratio("same_count", "n_signal_days"))


def sign_rows(long: DataFrame) -> DataFrame:
    """Per predictor and target: agreement, zeros, location, and the target's location by the predictor's sign."""
    more = []
    for name, cond in (("positive", F.col("x") > 0), ("negative", F.col("x") < 0)):
        y = F.when(cond, F.col("y"))
        more += [F.avg(y).alias(f"mean_target_when_{name}"), F.median(y).alias(f"median_target_when_{name}"), quantile_nearest(y, 0.25).alias(f"target_p25_when_{name}"), quantile_nearest(y, 0.75).alias(f"target_p75_when_{name}")]
    return _rates(long.groupBy("predictor", "target").agg(*_pair_aggregates(), *more))


def decile_rows(long: DataFrame, day: str, value: str = "x", distinct: int = 0) -> DataFrame:
    """The same per decile of the predictor (or its imbalance); all ten deciles appear where there are ten values."""
    cut = decile(long, ["predictor", "target"], value, "predictor_decile", [day], 10, distinct).where("predictor_decile is not null")
    return _rates(cut.groupBy("predictor", "target", "predictor_decile").agg(*_pair_aggregates()))


def tail_rows(long: DataFrame, tails: Mapping[str, tuple[int, float]] | None = None) -> DataFrame:
    """The same for the strongest days of each sign: tail name to (sign, quantile among the days of that sign)."""
    tails = tails or {"positive_top_20": (1, 0.8), "positive_top_10": (1, 0.9), "negative_bottom_20": (-1, 0.2), "negative_bottom_10": (-1, 0.1)}
    cuts = long.groupBy("predictor", "target").agg(*(quantile_nearest(F.when(F.col("x") * s > 0, F.col("x")), q).alias(f"c_{n}") for n, (s, q) in tails.items()))
    inside = [F.when((F.col("x") * s > 0) & ((F.col("x") - F.col(f"c_{n}")) * s >= 0), F.lit(n)) for n, (s, _) in tails.items()]
    spread = long.join(cuts, ["predictor", "target"]).withColumn("tail", F.explode(F.filter(F.array(*inside), lambda x: x.isNotNull())))
    return _rates(spread.groupBy("predictor", "target", "tail").agg(*_pair_aggregates()))


def condition_rows(study: DataFrame, day: str, base: str, other: str, predictor: str, targets: Sequence[str]) -> DataFrame:
    """The same over the days on which two windows agree and on which they oppose each other."""
    both = sign_or_zero(f"{base}_volume_delta") * sign_or_zero(f"{other}_volume_delta")
    marked = study.withColumn("condition", F.when(both > 0, f"{other}_same_as_{base}").when(both < 0, f"{other}_opposes_{base}")).where("condition is not null")
    return _rates(pair_long(marked, day, [predictor], targets, ["condition"]).groupBy("condition", "predictor", "target").agg(*_pair_aggregates()))


def predictor_deciles(long: DataFrame, day: str, target: str = "k359") -> DataFrame:
    """Per decile of a predictor with ten different values or more: how often the target opposes it, and both means."""
    cut = decile_rows(long.where(F.col("target") == target), day, "x", 10)
    return cut.select("predictor", "predictor_decile", "n_days", "n_signal_days", "opposite_count", "opposite_rate", "mean_predictor_delta", F.col("mean_target_delta").alias(f"mean_{target}_delta"))


def summaries(study: DataFrame, day: str, predictors: Sequence[str], targets: Sequence[str], contexts: Sequence[tuple[str, str, str]] = (), distinct: int = 0, against: str | None = None) -> DataFrame:
    """Sign, decile (raw and imbalance), tail and context tables as one ragged table; with ``against`` also predictor deciles against that target.

    The study is written first, as every table reads it.
    """
    study = materialize(study)
    long = pair_long(study, day, predictors, targets)
    parts = [sign_rows(long).withColumn("summary_type", F.lit("target_sign")), decile_rows(long, day, "x", distinct).withColumn("summary_type", F.lit("target_raw_decile")), decile_rows(long, day, "imb", distinct).withColumn("summary_type", F.lit("target_imbalance_decile")), tail_rows(long).withColumn("summary_type", F.lit("target_tail"))]
    parts += [condition_rows(study, day, a, b, p, targets).withColumn("summary_type", F.lit("context")) for a, b, p in contexts]
    parts += [predictor_deciles(long, day, against).withColumn("summary_type", F.lit("decile"))] if against else []
    return reduce(lambda a, b: a.unionByName(b, True), parts)


def path_summary(paths: DataFrame) -> DataFrame:
    """Complete candles by early sign, category, size category and deciles: how often each later window continues or fades."""
    labels = {"early_sign": F.col("early_10s_sign").cast("string"), "category": F.col("early_10s_category"), "abs_category": F.col("early_10s_abs_category"), "raw_decile": F.col("early_10s_raw_decile").cast("string"), "imbalance_decile": F.col("early_10s_imbalance_decile").cast("string")}
    scopes = F.array(*(F.struct(F.lit(n).alias("summary_type"), c.alias("bucket")) for n, c in labels.items()))
    scoped = paths.where("is_complete").withColumn("s", F.explode(scopes)).where("s.bucket is not null")
    later = {"30s": "early_30s", "post10_30s": "post_10s_to_30s", "post10": "post_10s", "late30": "late_30s", "full": "full"}
    aggregates = [F.count("*").alias("n"), F.avg("path_efficiency").alias("mean_path_efficiency"), F.avg("cum_sign_flip_count").alias("mean_sign_flips"), F.median("full_volume_delta").alias("median_full_delta")]
    for k, w in later.items():
        signal = (F.col("early_10s_sign") != 0) & (F.col(f"{w}_sign") != 0)
        aggregates += [F.count_if(signal).alias(f"signal_{k}"), F.count_if(F.col(f"early_10s_continues_to_{k}")).alias(f"continue_{k}"), F.count_if(F.col(f"early_10s_fades_to_{k}")).alias(f"fade_{k}")]
    out = scoped.groupBy("candle", "s.summary_type", "s.bucket").agg(*aggregates)
    return out.withColumns({f"{v}_rate_{k}": ratio(f"{v}_{k}", f"signal_{k}") for k in later for v in ("continue", "fade")})


def tertiles(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """low / mid / high buckets by linear thirds of each column (column to bucket name)."""
    df = materialize(df)  # read for the cut points and for the rows
    cuts = df.agg(*(quantile_linear(c, q).alias(f"_{i}_{k}") for i, c in enumerate(columns) for k, q in (("a", 1 / 3), ("b", 2 / 3))))
    df = df.join(F.broadcast(cuts), how="cross")  # one row
    for i, (c, out) in enumerate(columns.items()):
        x = F.col(c)
        df = df.withColumn(out, F.when(x <= F.col(f"_{i}_a"), "low").when(x <= F.col(f"_{i}_b"), "mid").when(x.isNotNull(), "high"))
    return df.drop(*cuts.columns)


def _direction_rates(points: str, outcomes: Sequence[str]) -> list[Column]:
    p = F.col(points)
    return [F.count("*").alias("sample_size"), share(p > 0).alias("bullish_rate"), share(p < 0).alias("bearish_rate"), share(p == 0).alias("flat_rate"), *(F.avg(c).alias(f"avg_{c}") for c in (points, *outcomes))]


def lift_by_bucket(df: DataFrame, buckets: Sequence[str], points: str, outcomes: Sequence[str] = ()) -> DataFrame:
    """Direction rates and mean outcomes per bucket of each cohort column, with the lift over all rows (cohort ``all``)."""
    scopes = F.array(F.struct(F.lit("all").alias("cohort"), F.lit("all").alias("bucket")), *(F.struct(F.lit(c).alias("cohort"), F.col(c).cast("string").alias("bucket")) for c in buckets))
    out = df.withColumn("s", F.explode(scopes)).where("s.bucket is not null").groupBy("s.cohort", "s.bucket").agg(*_direction_rates(points, outcomes))
    base = out.where("cohort = 'all'").select(F.col("bullish_rate").alias("_bull"), F.col("bearish_rate").alias("_bear"))
    out = out.join(F.broadcast(base), how="left")  # one row
    return out.withColumn("bullish_lift", F.col("bullish_rate") - F.col("_bull")).withColumn("bearish_lift", F.col("bearish_rate") - F.col("_bear")).drop("_bull", "_bear")


def combo_lift(df: DataFrame, left: str, right: str, points: str) -> DataFrame:
    """Direction rates and lift for pairs of buckets."""
    base = df.agg(share(F.col(points) > 0).alias("_bull"), share(F.col(points) < 0).alias("_bear"))
    out = df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(F.col(left).alias("left_bucket"), F.col(right).alias("right_bucket")).agg(*_direction_rates(points, ()))
    out = out.join(F.broadcast(base), how="left")
    return out.withColumn("bullish_lift", F.col("bullish_rate") - F.col("_bull")).withColumn("bearish_lift", F.col("bearish_rate") - F.col("_bear")).drop("_bull", "_bear")


def combo_table(combo: DataFrame, value: str = "bullish_rate", order: Sequence[str] = ("low", "mid", "high")) -> DataFrame:
    return combo.groupBy("left_bucket").pivot("right_bucket", list(order)).agg(F.max(value))


def correlations(df: DataFrame, day: str, features: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """Pearson and Spearman (average ranks) per feature and outcome over pairs without nulls."""
    f = unpivot(df, [day], list(features), "feature", "x")
    o = unpivot(df, [day], list(outcomes), "outcome", "y")
    pairs = f.join(o, day).where("x is not null and y is not null")
    key = ["feature", "outcome"]
    ranked = average_ranks(materialize(pairs), key, {"x": "rx", "y": "ry"})
    return ranked.groupBy(*key).agg(guarded_corr("x", "y").alias("pearson"), guarded_corr("rx", "ry").alias("spearman"), F.count("*").alias("sample_size"))


def metric_bands(df: DataFrame, index: str, metric: str, expected: Sequence[int]) -> DataFrame:
    """Mean, quartiles, median, deviation and count per index; every expected index appears."""
    grid = df.sparkSession.createDataFrame([(int(i),) for i in expected], f"`{index}` int")
    found = df.where(F.col(metric).isNotNull()).groupBy(F.col(index).cast("int").alias(index)).agg(F.avg(metric).alias("mean"), quantile_linear(metric, 0.25).alias("p25"), F.median(metric).alias("median"), quantile_linear(metric, 0.75).alias("p75"), F.stddev_samp(metric).alias("std"), F.count("*").alias("n"))
    return grid.join(found, index, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def jarque_bera(df: DataFrame, by: Sequence[str], metric: str, alpha: float = 0.05, least: int = 3) -> DataFrame:
    """Normality per group by the Jarque-Bera test (p = exp(-JB / 2)); ``normal`` is null below ``least`` values or without variation."""
    x = F.col(metric).cast("double")
    out = df.where(x.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("excess_kurtosis"))
    jb = F.col("n") / 6.0 * (F.col("skewness") * F.col("skewness") + F.col("excess_kurtosis") * F.col("excess_kurtosis") / 4.0)
    fine = (F.col("n") >= least) & F.col("skewness").isNotNull() & ~F.isnan("skewness")
    out = out.withColumn("jarque_bera", F.when(fine, jb)).withColumn("p_value", F.exp(-F.col("jarque_bera") / 2))
    clean = [F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)).alias(c) for c in ("skewness", "excess_kurtosis")]
    return out.select(*by, "n", *clean, "jarque_bera", "p_value", (F.col("p_value") > alpha).alias("normal"), F.lit("jarque_bera").alias("test"))


def normality_rollup(tested: DataFrame, by: Sequence[str]) -> DataFrame:
    """all_normal, all_non_normal, mixed or insufficient over a group's indexes."""
    n, yes, no = F.count("normal"), F.count_if(F.col("normal")), F.count_if(~F.col("normal"))
    label = F.when(n == 0, "insufficient").when(no == 0, "all_normal").when(yes == 0, "all_non_normal").otherwise("mixed")
    return tested.groupBy(*by).agg(label.alias("classification"), n.alias("n_tested"), yes.alias("n_normal"))


def histogram(df: DataFrame, by: Sequence[str], metric: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per fixed-width bin of [low, high); bin 0 is below, bins + 1 at or above."""
    x = F.col(metric).cast("double")
    kept = df.where(x.isNotNull() & ~F.isnan(x)).withColumn("bin", F.width_bucket(x, F.lit(float(low)), F.lit(float(high)), F.lit(bins)))
    return kept.groupBy(*by, "bin").agg(F.count("*").alias("n"))


def ecdf(df: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Distinct values of a group with the share of rows at or below."""
    counted = df.where(F.col(metric).isNotNull()).groupBy(*by, F.col(metric).alias("value")).agg(F.count("*").alias("_n"))
    up = Window.partitionBy(*by).orderBy("value")
    whole = Window.partitionBy(*by)
    return counted.withColumn("share", F.sum("_n").over(up) / F.sum("_n").over(whole)).drop("_n")


def percent_by(df: DataFrame, by: Sequence[str], bucket: str) -> DataFrame:
    counted = df.groupBy(*by, bucket).agg(F.count("*").alias("n"))
    return counted.withColumn("pct", pct("n", F.sum("n").over(Window.partitionBy(*by))))
