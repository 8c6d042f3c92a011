"""Economic events beside trading days: links, daily merges, cohorts, tests."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..functions.tables import materialize
from ..functions.timecols import EVENT_PATTERNS, ZONE, second_of_day

#: Labels that ``classify_event`` can give.
EVENT_TYPES = (*(n for n, _ in EVENT_PATTERNS), "OTHER")


def event_links(days: DataFrame, news: DataFrame, premarket_end: int = 9 * 3600 + 1800, close_second: int = 15 * 3600 + 50 * 60, nextday: bool = True, zone: str = ZONE) -> DataFrame:
    """A row per (day, event): events of the day and those of the next calendar day's pre-market, with minutes from the day's close.

    ``days`` has a date column, ``news`` is normalised. One equi join: an event
    says itself which days it belongs to.
    """
    own = F.struct(F.col("date_et").alias("date"), F.lit("today").alias("relation"))
    before = F.when(F.lit(nextday) & (second_of_day("dt_et") < premarket_end), F.struct(F.date_sub("date_et", 1).alias("date"), F.lit("next_premarket").alias("relation")))
    spread = news.withColumn("_to", F.explode(F.filter(F.array(own, before), lambda x: x.isNotNull()))).select("_to.*", F.col("id").alias("event_id"), "dt_utc", "dt_et", "impact", "title", "event_type")
    out = days.select(F.col("date").cast("date").alias("date")).distinct().join(spread, "date")
    close = F.to_utc_timestamp(F.timestamp_seconds(F.unix_timestamp(F.col("date").cast("timestamp")) + close_second), zone)
    return out.withColumn("close_utc", close).withColumn("minutes_from_close", (F.unix_micros("dt_utc") - F.unix_micros("close_utc")) / 60_000_000.0)


def merge_news(days: DataFrame, news: DataFrame, types: Sequence[str] = EVENT_TYPES, **options) -> DataFrame:
    """``days`` with lists, counts and flags of the day's and the next pre-market's events.

    Without the next day its columns are empty lists and zeros. Lists are in
    order of time; flag columns exist for all ``types``, so the schema is fixed.
    """
    links = event_links(days, news, **options)
    aggregates = []
    for rel, name in (("today", "today"), ("next_premarket", "next_premarket")):
        here = F.col("relation") == rel
        item = F.when(here, F.struct("dt_utc", "event_id", "title", "event_type"))
        aggregates += [F.sort_array(F.collect_list(item)).alias(f"_{name}"), F.count_if(here).alias(f"num_{name}")]
        aggregates += [F.coalesce(F.bool_or(here & (F.col("event_type") == t)), F.lit(False)).alias(f"has_{t}_{name}") for t in types]
    merged = days.withColumn("date", F.col("date").cast("date")).join(links.groupBy("date").agg(*aggregates), "date", "left")
    for name in ("today", "next_premarket"):
        for out, field in (("events", "event_id"), ("titles", "title"), ("types", "event_type")):
            values = F.col(f"_{name}.{field}")
            merged = merged.withColumn(f"{out}_{name}", F.coalesce(values, F.array()))
        merged = merged.drop(f"_{name}").withColumn(f"num_{name}", F.coalesce(f"num_{name}", F.lit(0)))
    merged = merged.withColumn("num_total", F.col("num_today") + F.col("num_next_premarket"))
    merged = merged.withColumns({"has_event_today": F.col("num_today") > 0, "has_event_next_premarket": F.col("num_next_premarket") > 0, "has_event_total": F.col("num_total") > 0})
    flags = {f"has_{t}_{n}": F.coalesce(f"has_{t}_{n}", F.lit(False)) for t in types for n in ("today", "next_premarket")}
    merged = merged.withColumns(flags)
    return merged.withColumns({f"has_{t}_total": F.col(f"has_{t}_today") | F.col(f"has_{t}_next_premarket") for t in types})


def event_cohorts(days: DataFrame, links: DataFrame, event_type: str = "CPI") -> DataFrame:
    """``days`` with counts of one event type and the cohort they put the day in."""
    here = F.col("event_type") == event_type
    counted = links.groupBy("date").agg(*(F.count_if(here & (F.col("relation") == r)).alias(f"num_{event_type}_{r}") for r in ("today", "next_premarket")))
    out = days.join(counted, "date", "left")
    today, nxt = (F.coalesce(f"num_{event_type}_{r}", F.lit(0)) for r in ("today", "next_premarket"))
    out = out.withColumns({f"num_{event_type}_today": today, f"num_{event_type}_next_premarket": nxt})
    cohort = F.when(F.col(f"num_{event_type}_today") > 0, f"{event_type}_today").when(F.col(f"num_{event_type}_next_premarket") > 0, f"{event_type}_next_premarket").otherwise("Control")
    return out.withColumn("cohort", cohort)


def cohort_summary(df: DataFrame, metric: str, cohort: str = "cohort") -> DataFrame:
    return df.where(F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double"))).groupBy(cohort).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"), F.median(metric).alias("median"), F.stddev_samp(metric).alias("std"))


def cohens_d(df: DataFrame, metric: str, a: str, b: str, cohort: str = "cohort") -> DataFrame:
    """Effect size of cohort a against b with pooled deviation, one row; null if either has fewer than two values or nothing varies."""
    x, y = (F.when(F.col(cohort) == c, F.col(metric).cast("double")) for c in (a, b))
    m = df.agg(F.count(x).alias("na"), F.count(y).alias("nb"), F.avg(x).alias("ma"), F.avg(y).alias("mb"), F.var_samp(x).alias("va"), F.var_samp(y).alias("vb"))
    pooled = F.sqrt(ratio((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb"), F.col("na") + F.col("nb") - 2))
    return m.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "na", "nb", F.when((F.col("na") > 1) & (F.col("nb") > 1), ratio(F.col("ma") - F.col("mb"), pooled)).alias("cohens_d"))


def permutation_test(df: DataFrame, metric: str, a: str, b: str, iterations: int = 1000, seed: int = 7, cohort: str = "cohort", bucket_rows: int = 1 << 15) -> DataFrame:
    """Two-sided permutation test of a mean difference: (hits + 1) / (iterations + 1).

    Rows are dealt to buckets by a hash. For every iteration the driver draws
    how many of the first cohort's places fall to each bucket (multivariate
    hypergeometric), and the bucket's task draws which rows take them: together
    a uniform draw of that many rows. A task returns one array of sums, one per
    iteration, so the rows exchanged don't grow with the iterations. A row is
    known by its cohort, value and place among equals, so the result doesn't
    hang on partitions.
    """
    x, in_a = F.col(metric).cast("double"), F.col(cohort) == a
    rows = df.where(F.col(cohort).isin(a, b) & F.col(metric).isNotNull()).groupBy(x.alias("x"), in_a.alias("in_a")).agg(F.count("*").alias("copies"))
    rows = materialize(rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies"))
    n = rows.agg(F.count("*").alias("n"), F.count_if("in_a").alias("na"), F.sum("x").alias("total"), F.avg(F.when(F.col("in_a"), F.col("x"))).alias("ma"), F.avg(F.when(~F.col("in_a"), F.col("x"))).alias("mb")).first()
    spark, schema = df.sparkSession, "difference double, p_value double"
    if not n["na"] or n["na"] == n["n"]:
        return spark.createDataFrame([(None, None)], schema)
    bucket = F.pmod(F.xxhash64("in_a", "x", "copy"), F.lit(-(-n["n"] // bucket_rows))).cast("int")
    placed = materialize(rows.select(bucket.alias("bucket"), "in_a", "x", "copy"))
    sizes = {r["bucket"]: r["count"] for r in placed.groupBy("bucket").count().collect()}
    order = sorted(sizes)
    drawn = np.random.default_rng(seed).multivariate_hypergeometric([sizes[k] for k in order], n["na"], size=iterations, method="marginals")
    places = {k: drawn[:, i] for i, k in enumerate(order)}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, values, now = np.zeros(iterations), [], None

        def close() -> None:
            if values:
                v, rng = np.concatenate(values), np.random.default_rng((seed, now))
                for i, k in enumerate(places[now].tolist()):
                    total[i] += v[rng.permutation(len(v))[:k]].sum()
                values.clear()

        for batch in batches:
            which, v = batch.column("bucket").to_numpy(), batch.column("x").to_numpy()
            for k in np.unique(which).tolist():  # sorted, as the rows are
                if k != now:
                    close()
                    now = k
                values.append(v[which == k])
        close()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    ordered = placed.repartition("bucket").sortWithinPartitions("bucket", "in_a", "x", "copy")
    total = np.sum([r["sums"] for r in ordered.select("bucket", "x").mapInArrow(sums, "sums array<double>").collect()], axis=0)  # an array per task
    observed = n["ma"] - n["mb"]
    means = total / n["na"] - (n["total"] - total) / (n["n"] - n["na"])
    hits = int((np.abs(means) >= abs(observed) * (1 - 1e-12)).sum())
    return spark.createDataFrame([(float(observed), (hits + 1) / (iterations + 1))], schema)
