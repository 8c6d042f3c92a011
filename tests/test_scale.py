"""Forms that hold at scale: ranks and quantiles by range, permutation sums, running sums in slices, keyed streams."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionflow.functions import arrays, stats
from sessionflow.operators import calendar, vwap
from sessionflow.streaming import ticks as stream


def plain_ranks(values):
    return [None if v is None else sum(w < v for w in values if w is not None) + (sum(w == v for w in values if w is not None) + 1) / 2 for v in values]


def test_average_ranks_of_groups_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, None if rng.random() < 0.1 else float(rng.integers(-5, 6)), float(rng.normal())) for g, n in (("a", 60), (None, 25), ("c", 1)) for i in range(n)]
    got = {(r["g"], r["i"]): (r["rx"], r["ry"]) for r in stats.average_ranks(spark.createDataFrame(rows, "g string, i int, x double, y double"), ["g"], {"x": "rx", "y": "ry"}).collect()}
    for g in ("a", None, "c"):
        own = [r for r in rows if r[0] == g]
        want = list(zip(plain_ranks([r[2] for r in own]), plain_ranks([r[3] for r in own])))
        assert [got[g, r[1]] for r in own] == want
    assert stats.average_ranks(spark.createDataFrame([], "x double"), [], {"x": "r"}).count() == 0


def test_one_large_group_is_ranked_by_several_tasks(spark, monkeypatch):
    laid, real = [], stats.materialize
    monkeypatch.setattr(stats, "materialize", lambda df: laid.append(real(df)) or laid[-1])
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("x"))
    ranks = stats.average_ranks(df, [], {"x": "r"})
    assert ranks.where("r <> 0").count() == 20_000 and ranks.agg(F.max("r")).first()[0] == 20_000
    sizes = [r["count"] for r in laid[0].groupBy("part").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 10_000


def test_nearest_quantiles_gather_nothing(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    out = stats.nearest_quantiles(df, "v", {"a": 1 / 3, "b": 2 / 3, "c": 1.0})
    want = sorted(values)
    assert tuple(out.first()) == (8, want[int(7 / 3 + 0.5)], want[int(14 / 3 + 0.5)], 9.0)
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    assert tuple(stats.nearest_quantiles(df.where("v is null"), "v", {"a": 0.5}).first()) == (0, None)


@pytest.mark.parametrize("bucket_rows", [8, 1 << 15])
def test_permutation_is_a_uniform_draw_of_the_first_cohort(spark, bucket_rows):
    """Against all 252 draws of five of ten values, whatever the buckets and partitions."""
    from itertools import combinations

    x = [1.0, 2.0, 2.0, 7.0, 9.0, 3.0, 4.0, 4.0, 11.0, 15.0]
    df = spark.createDataFrame([(v, "a" if i < 5 else "b") for i, v in enumerate(x)], "x double, cohort string")
    observed = np.mean(x[:5]) - np.mean(x[5:])
    exact = np.mean([abs(sum(c) / 5 - (sum(x) - sum(c)) / 5) >= abs(observed) - 1e-12 for c in combinations(x, 5)])
    got = calendar.permutation_test(df, "x", "a", "b", 4000, bucket_rows=bucket_rows).first()
    assert got["difference"] == pytest.approx(observed) and got["p_value"] == pytest.approx(exact, abs=0.03)
    again = calendar.permutation_test(df.repartition(7), "x", "a", "b", 4000, bucket_rows=bucket_rows).first()
    assert again == got
    assert calendar.permutation_test(df, "x", "a", "none").first()["p_value"] is None


def test_running_vwap_in_slices_and_by_instrument(spark):
    """Each instrument's running VWAP is that of its own ticks; no window holds a day."""
    rng, start = np.random.default_rng(3), 15 * 3600
    rows = []
    for k in ("x", "y"):
        for i, s in enumerate(np.sort(rng.integers(0, 300, 400))):
            at = dt.datetime(2024, 1, 5, 20, 0) + dt.timedelta(seconds=int(s))  # 15:00 in New York
            rows.append((k, at, int(at.replace(tzinfo=dt.timezone.utc).timestamp()) * 10**9 + i, i, float(100 + rng.normal()), int(rng.integers(1, 9))))
    df = spark.createDataFrame(rows, "k string, ts timestamp, ts_ns long, intra_ts_rank int, price double, size long")
    df = df.withColumn("price_ticks", (F.col("price") * 4).cast("long"))
    t = vwap.running_vwap(df, start, start + 200, start + 300, by=["k"])
    got = {(r["k"], r["intra_ts_rank"]): (r["vwap"], r["p"]) for r in t.collect()}
    for k in ("x", "y"):
        own = [(r, got[k, r[3]]) for r in rows if r[0] == k]
        pv = v = 0.0
        for r, (found, p) in own:
            if (r[1] - dt.datetime(2024, 1, 5, 20, 0)).seconds < 200:
                pv, v = pv + p * r[5], v + r[5]
            assert found == pytest.approx(pv / v)
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert all("slice" in w for w in re.findall(r"Window \[.*?\].*", plan) if "_pvs" in w or "intra_ts_rank" in w)


SCHEMA = "k string, n long, ts timestamp"


def keyed(spark, source, path, checkpoint):
    df = stream.read_stream(spark, source, spark.createDataFrame([], SCHEMA).schema, 1)
    return stream.write_available(df.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("rows")), path, checkpoint, keys=("k",))


def test_keyed_stream_of_an_empty_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = keyed(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert out.collect() == [] and out.columns == ["k", "n", "rows"]


def test_keyed_stream_is_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream, "COMPACT", 3)
    for i in range(8):
        spark.createDataFrame([("a", i, dt.datetime(2024, 1, 1)), (f"k{i % 4}", 1, dt.datetime(2024, 1, 1))], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = keyed(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert {tuple(r) for r in out.collect()} == {("a", 28, 8), *((f"k{i}", 2, 2) for i in range(4))}
    read = {re.search(r"/(\w+=\d+)/", f).group(1) for f in out.inputFiles()}
    assert "merged=5" in read and not any(f.startswith("batch=") and int(f[6:]) <= 5 for f in read)
    last = max(int(p.name[6:]) for p in (tmp_path / "out").glob("batch=*"))
    (tmp_path / "out" / f"merged={last + 1}").mkdir()  # begun and lost: not read
    assert {tuple(r) for r in stream.keyed_table(spark, str(tmp_path / "out"), out.schema, ("k",)).collect()} == {tuple(r) for r in out.collect()}


def test_next_greater(spark):
    rng = np.random.default_rng(6)
    rows = [[], [1.0], [2.0, 2.0], list(range(40, 0, -1)), list(range(33)), *(rng.integers(0, 9, n).tolist() for n in (2, 3, 7, 8, 9, 31, 64, 100))]
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(rows)], "i int, a array<double>")
    got = {r["i"]: r["g"] for r in df.withColumn("m", arrays.range_maxima(F.col("a"))).withColumn("g", arrays.next_greater(F.col("a"), F.col("m"))).collect()}
    for i, r in enumerate(rows):
        assert got[i] == [next((j for j in range(k + 1, len(r)) if r[j] > r[k]), None) for k in range(len(r))]
