"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates unit vectors by rounds of random signs and a fast Hadamard
transform and hashes each to its nearest signed axis; several such polytopes,
the last of fewer axes, are concatenated, so that a bucket holds about
``OCCUPANCY`` vectors: the number of polytopes grows with the logarithm of the
number of vectors. A query probes the buckets whose axes it is closest to in
sum; what it meets there is reranked by the exact cosine on the original
vectors. How many buckets it probes is fitted: the exact neighbours of
``SAMPLE`` vectors among all (one pass) must be met with ``RECALL``.

Equal vectors are one class, searched once and expanded to its smallest ids at
the end, so copies cost nothing. Buckets are dealt to groups by a hash, with
each query once per group. Groups are counted (at most ``GROUPS``) and cut on
both sides, vectors into parts and queries into chunks, so neither a dense
bucket nor one that many queries probe is a single task's. Groups return their
best few. Vectors of a length with at most ``WHOLE`` of them share one bucket.

Defined cases: vectors that are null, empty, zero or hold a null or a
non-finite component, and null ids, take no part; vectors meet only those of
their length; rows of equal id and vector are one, rows of equal id and other
vectors are queries and candidates of their own; with fewer candidates than
``k`` all found are returned; ties go to the smaller id; magnitudes don't
matter, as vectors are scaled by a power of two; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, mix, table

TABLES, PART, CHUNK, GROUPS, WHOLE, OCCUPANCY, K = 6, 8192, 4096, 1 << 16, 256, 16, 5
#: Vectors of a length whose neighbours fit the number of probes, and the share of them that must be met.
SAMPLE, RECALL = 128, 0.95


def rotation(x: np.ndarray, number: int) -> np.ndarray:
    """Rows of ``x`` padded to a power of two and pseudo-rotated, in a way of its own for each number."""
    n, d = len(x), 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((n, d))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng(1000 + number).choice([-1.0, 1.0], (3, d))
    for s in signs:
        y *= s
        half = 1
        while half < d:
            y = y.reshape(n, d // (2 * half), 2, half)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2)
            half *= 2
        y = y.reshape(n, d) / np.sqrt(d)
    return y


def polytopes(n: int, length: int) -> list[int]:
    """Axes of the polytopes of a table so that a bucket holds about OCCUPANCY of ``n`` vectors."""
    most, left, out = 1 << max(0, (length - 1).bit_length()), n / OCCUPANCY, []
    while left >= 2:
        out.append(min(most, 1 << (int(left) // 2).bit_length() - 1))
        left /= 2 * out[-1]
    return out


def nearness(x: np.ndarray, table_: int, axes: list[int]) -> list[np.ndarray]:
    """For each polytope of a table the nearness of each row to its signed axes: i is +i, axes + i is -i."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    turned = (rotation(x, 64 * table_ + m)[:, :n] for m, n in enumerate(axes))
    return [np.concatenate([y, -y], axis=1) for y in turned]


def buckets(x: np.ndarray, table_: int, axes: list[int]) -> np.ndarray:
    code = np.zeros(len(x), np.int64)
    for near in nearness(x, table_, axes):
        code = code * near.shape[1] + near.argmax(axis=1)
    return code


def probed(x: np.ndarray, table_: int, axes: list[int], probes: int) -> np.ndarray:
    """The ``probes`` buckets of a table with the largest sums of nearness, for each row, nearest first."""
    total, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for near in nearness(x, table_, axes):
        # The best sums extend the best sums of the polytopes before.
        total = (total[:, :, None] + near[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * near.shape[1] + np.arange(near.shape[1])).reshape(len(x), -1)
        if total.shape[1] > probes:
            best = np.argpartition(-total, probes - 1, axis=1)[:, :probes]
            total, code = np.take_along_axis(total, best, 1), np.take_along_axis(code, best, 1)
    order = np.argsort(-total, axis=1, kind="stable")
    return np.take_along_axis(code, order, 1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, their largest component between a half and one: no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def _matrix(column: pa.Array) -> np.ndarray:
    return _scaled(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1))


def _lengths(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim))


def _group(code: np.ndarray, table_: int, groups: int) -> np.ndarray:
    return (mix(code.astype(np.uint64) * np.uint64(TABLES) + np.uint64(table_)) % np.uint64(groups)).astype(np.int32)


def _placed(vectors: DataFrame, models: dict[int, tuple]) -> DataFrame:
    """Rows (dim, g, key, class_id, rep, v): the bucket of each vector in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _lengths(batch):
                tables, axes, _, groups = models.get(dim, (1, [], 1, 1))
                x = _matrix(part.column("v"))
                for t in range(tables):
                    code = buckets(x, t, axes)
                    columns = [part.column("dim"), pa.array(_group(code, t, groups)), pa.array(code * tables + t), part.column("class_id"), part.column("rep"), part.column("v")]
                    yield pa.RecordBatch.from_arrays(columns, ["dim", "g", "key", "class_id", "rep", "v"])

    return vectors.select("dim", "class_id", "rep", "v").mapInArrow(run, "dim int, g int, key long, class_id long, rep long, v array<double>")


def _probing(queries: DataFrame, models: dict[int, tuple]) -> DataFrame:
    """Rows (dim, g, keys, class_id, v): each query once per group, with the buckets it probes there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _lengths(batch):
                tables, axes, probes, groups = models.get(dim, (1, [], 1, 1))
                step = max(1, (1 << 22) // (probes * 2 * max([1, *axes])))
                for at in range(0, part.num_rows, step):
                    some = part.slice(at, step)
                    x = _matrix(some.column("v"))
                    codes = [probed(x, t, axes, probes) for t in range(tables)]
                    g = np.concatenate([_group(c.ravel(), t, groups).reshape(c.shape) for t, c in enumerate(codes)], axis=1)
                    key = np.concatenate([c * tables + t for t, c in enumerate(codes)], axis=1)
                    row = np.repeat(np.arange(len(x)), key.shape[1])
                    order = np.lexsort([g.ravel(), row])
                    row, g, key = row[order], g.ravel()[order], key.ravel()[order]
                    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (g[1:] != g[:-1])))
                    taken = some.take(pa.array(row[new]))
                    keys = pa.ListArray.from_arrays(pa.array(np.append(new, len(key)), pa.int32()), pa.array(key))
                    yield pa.RecordBatch.from_arrays([taken.column("dim"), pa.array(g[new]), keys, taken.column("class_id"), taken.column("v")], ["dim", "g", "keys", "class_id", "v"])

    return queries.select("dim", "class_id", "v").mapInArrow(run, "dim int, g int, keys array<long>, class_id long, v array<double>")


_FOUND = pa.schema([("query_class", pa.int64()), ("class_id", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])


def _first(query: np.ndarray, class_id: np.ndarray, rep: np.ndarray, score: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    """The ``keep`` best different classes of each query; ties at the edge go by the smallest id, as a later tie can't be among the best."""
    order = np.lexsort([class_id, rep, -score, query])
    query, class_id, rep, score = query[order], class_id[order], rep[order], score[order]
    new = np.append(True, (query[1:] != query[:-1]) | (class_id[1:] != class_id[:-1]))[: len(query)]
    query, class_id, rep, score = query[new], class_id[new], rep[new], score[new]
    use = np.arange(len(query)) - np.searchsorted(query, query) < keep
    return query[use], class_id[use], rep[use], score[use]


def _scored(x: np.ndarray, q: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, cosine) of what can be among the ``keep`` best of each query."""
    norm_x, norm_q = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    near = (q @ x.T) / norm_q[:, None] / norm_x
    if near.shape[1] > keep:
        least = np.partition(near, near.shape[1] - keep, axis=1)[:, near.shape[1] - keep]
        i, j = np.nonzero(near >= least[:, None] - 1e-9)
    else:
        i, j = np.indices(near.shape).reshape(2, -1)
    return i, j, (q[i] * x[j]).sum(axis=1) / (norm_q[i] * norm_x[j])


def _best(found: pa.Table, asked: pa.Table, keep: int) -> pa.Table:
    """For each query of a group the classes that can be among its ``keep`` best, with exact cosines."""
    if not found.num_rows or not asked.num_rows:
        return _FOUND.empty_table()
    x, q = _matrix(found.column("v").combine_chunks()), _matrix(asked.column("v").combine_chunks())
    ids, reps, of = (t.column(c).to_numpy() for t, c in ((found, "class_id"), (found, "rep"), (asked, "class_id")))
    lists = asked.column("keys").combine_chunks()
    probe, by = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
    order, place = np.argsort(probe, kind="stable"), np.argsort(found.column("key").to_numpy(), kind="stable")
    probe, by, key = probe[order], by[order], found.column("key").to_numpy()[place]
    kinds, begin = np.unique(key, return_index=True)
    end, s, e = np.append(begin[1:], len(key)), np.searchsorted(probe, kinds), np.searchsorted(probe, kinds, side="right")
    out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
    for b in np.flatnonzero(e > s):
        rows = place[begin[b] : end[b]]
        for at in range(s[b], e[b], 256):
            mine = by[at : min(at + 256, e[b])]
            i, j, score = _scored(x[rows], q[mine], keep)
            out.append((mine[i], rows[j], score))
    i, j, score = (np.concatenate(c) for c in zip(*out))
    i, class_id, rep, score = _first(i, ids[j], reps[j], score, keep)
    return pa.table({"query_class": of[i], "class_id": class_id, "rep": rep, "score": score}, schema=_FOUND)


def _neighbours(classes: DataFrame, samples: dict[int, np.ndarray], k: int) -> dict[int, np.ndarray]:
    """Of each sampled vector (scaled, by length) the exact ``k`` nearest others among all classes: samples x k x length, NaN where there are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for dim, part in _lengths(batch):
                if dim in samples:
                    x, q = _matrix(part.column("v")), samples[dim]
                    i, j, score = _scored(x, q, k + 1)
                    if dim in held:
                        i, x, score = np.append(held[dim][0], i), np.concatenate([held[dim][1], x[j]]), np.append(held[dim][2], score)
                    else:
                        x = x[j]
                    order = np.lexsort([-score, i])
                    order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order]) < k + 1]
                    held[dim] = (i[order], x[order], score[order])
        for dim, (i, x, score) in held.items():
            columns = [pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(score), pa.array(list(x), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "sample", "score", "v"])

    best = Window.partitionBy("dim", "sample").orderBy(F.desc("score"), "v")
    found = classes.select("dim", "v").mapInArrow(run, "dim int, sample int, score double, v array<double>")
    rows = found.withColumn("n", F.row_number().over(best)).where(f"n between 2 and {k + 1}").collect()  # a sample is nearest to itself
    out = {dim: np.full((len(q), k, dim), np.nan) for dim, q in samples.items()}
    for r in rows:
        out[r["dim"]][r["sample"], r["n"] - 2] = r["v"]
    return out


def fit(classes: DataFrame, k: int = K, tables: int = TABLES, recall: float = RECALL, sample: int = SAMPLE, part: int = PART) -> dict[int, tuple[int, list[int], int, int]]:
    """(tables, axes of the polytopes, probes, groups) for each length of more than ``WHOLE`` vectors.

    ``sample`` vectors a length, by hash order, reach the driver with their neighbours; probes are doubled, and then
    halved into, until the sample's ``recall`` is met, if need be up to all buckets.
    """
    counts = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE).collect()}
    if not counts:
        return {}
    some = classes.where(F.col("dim").isin(list(counts))).withColumn("n", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("v"), "class_id"))).where(F.col("n") <= sample)
    rows = some.select("dim", "v").orderBy("dim", "n").collect()
    samples = {dim: _scaled(np.array([r["v"] for r in rows if r["dim"] == dim])) for dim in counts}
    models = {}
    for dim, near in _neighbours(classes, samples, k).items():
        axes = polytopes(counts[dim], dim)
        n, size = int(np.prod([2 * a for a in axes], dtype=object)), near.shape
        there = ~np.isnan(near[:, :, 0])
        target = [buckets(np.where(there[:, :, None], near, 1.0).reshape(-1, dim), t, axes).reshape(size[:2]) for t in range(tables)]

        def met(probes: int) -> float:
            hit = np.zeros(size[:2], bool)
            for t in range(tables):
                own = probed(samples[dim], t, axes, probes)
                hit |= np.array([np.isin(a, b) for a, b in zip(target[t], own)])
            return hit[there].mean() if there.any() else 1.0

        high = 1
        while high < n and met(high) < recall:
            high = min(n, 2 * high)
        low = high // 2
        while high - low > max(1, low // 16):
            low, high = (low, mid) if met(mid := (low + high) // 2) >= recall else (mid, high)
        models[dim] = (tables, axes, high, min(GROUPS, max(1, -(-tables * counts[dim] // part))))
    return models


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, tables: int = TABLES, recall: float = RECALL, part: int = PART, chunk: int = CHUNK) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest found of each row of ``queries``, itself excluded."""

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        infinite = F.lit(float("inf"))
        fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < infinite)) & F.exists(v, lambda c: c != 0)
        return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & fine)

    keep = k + 1  # a query may be one of its class
    # Copies beyond the first few of a class can't be among the nearest; the limit works before the shuffle.
    numbered = clean(vectors).distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= keep)
    numbered = materialize(numbered)
    classes = materialize(numbered.where("n = 1").select(F.size("v").alias("dim"), F.monotonically_increasing_id().alias("class_id"), F.col("vec_id").alias("rep"), "v"))
    members = numbered.join(classes.select("class_id", "v"), "v").select("class_id", "vec_id")
    asked = materialize(clean(queries).distinct().join(classes.select("class_id", "v"), "v").select(F.col("vec_id").alias("query_id"), "class_id"))
    models = fit(classes, k, tables, recall, part=part)
    index, probing = _placed(classes, models), _probing(classes.join(asked.select("class_id").distinct(), "class_id"), models)
    key = ["dim", "g"]
    cut = lambda df, out, size: df.groupBy(*key).agg(F.ceil(F.count("*") / size).cast("int").alias(out))
    sizes = F.broadcast(materialize(cut(index, "parts", part).join(cut(probing, "chunks", chunk), key)))  # GROUPS rows a length at most
    own = lambda n: F.pmod(F.xxhash64("class_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(sizes, key).withColumn("i", own("parts")).withColumn("j", every("chunks")).drop("parts", "chunks")
    right = probing.join(sizes, key).withColumn("j", own("chunks")).withColumn("i", every("parts")).drop("parts", "chunks")
    key = [*key, "i", "j"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda a, b: _best(a, b, keep), "query_class long, class_id long, rep long, score double")
    best = found.groupBy("query_class", "class_id", "rep").agg(F.max("score").alias("score"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("query_class").orderBy(F.desc("score"), "rep", "class_id"))).where(F.col("n") <= keep).drop("n", "rep")
    ids = best.join(members, "class_id").withColumn("n", F.row_number().over(Window.partitionBy("query_class").orderBy(F.desc("score"), "vec_id", "class_id"))).where(F.col("n") <= keep)
    ids = ids.select(F.col("query_class").alias("own"), "class_id", "vec_id", "score")
    each = asked.withColumnRenamed("class_id", "own").join(ids, "own").where("vec_id <> query_id or class_id <> own")  # all but the query's own row
    rank = F.row_number().over(Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id", "class_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


QUERIES = {"op7_cross_polytope": op7_cross_polytope}
SQL: dict[str, str] = {}
