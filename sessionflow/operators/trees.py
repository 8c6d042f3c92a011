"""Regression trees for many training windows at once, grown from histograms.

A ``Job`` is a model: which rows train it (a group and a range of days), which
rows ask it, and its loss. All jobs (folds, months, quantiles, trees of a
forest) grow side by side: the rows stay in Spark, binned where they are read;
a pass goes down one level and adds up, per (unit, node, feature, bin), counts,
gradient sums and the least and largest value. The histograms of a node meet in
one task, which answers with its best split; only splits reach the driver and
only trees go back. No task holds rows beyond an Arrow batch.

Quantile leaves are exact: the two order statistics around a quantile are
looked for in a histogram of the residuals, which is narrowed to one of its
bins until they are known.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import materialize

#: Bins of a feature (all values, if there are no more rows) and of a search for an order statistic.
BINS, STEPS = 256, 512
#: Rows a task takes; fewer tasks send fewer blocks.
TASK_ROWS = 1 << 14
EPOCH = datetime.date(1970, 1, 1)
_GAIN = 1e-12


def day_number(day: datetime.date | None, none: int) -> int:
    return none if day is None else (day - EPOCH).days


@dataclass(frozen=True)
class Job:
    """A model: trained by rows of ``group`` with first <= day < last, asked by those with ask_first <= day < ask_last (numbers of days)."""

    first: int
    last: int
    ask_first: int
    ask_last: int
    quantile: float | None = None  # None: squared error
    group: str = ""


@dataclass
class _Unit:
    """The trees of a job, or one tree of its forest, as heaps: children of node k are 2 k + 1 and 2 k + 2; feature -1 is a leaf."""

    job: Job
    tree: int = 0
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    trained: bool = False  # whether any row trained it

    def value(self, x: np.ndarray, trees: Sequence | None = None) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees if trees is None else trees:
            out += value[descend(x, feature, cut)]
        return out

    def bounds(self) -> tuple[float, float]:
        """What ``value`` lies between."""
        low = high = self.base
        for feature, _, value in self.trees:
            leaves = value[feature < 0]
            low, high = low + min(0.0, leaves.min()), high + max(0.0, leaves.max())
        return low, high


def descend(x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node in which each row of ``x`` ends."""
    node = np.zeros(len(x), np.int64)
    while True:
        f = feature[node]
        inner = np.flatnonzero(f >= 0)
        if not len(inner):
            return node
        node[inner] = 2 * node[inner] + 1 + (x[inner, f[inner]] > cut[node[inner]])


def _empty(depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = (2 << depth) - 1
    return np.full(n, -1, np.int16), np.zeros(n), np.zeros(n)


def _scramble(x: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) by row hash and salt."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64))
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (x ^ (x >> np.uint64(33))) / 2.0**64


class TreeData:
    """Rows prepared for training: written once, with bin edges per feature and the range of the target."""

    def __init__(self, df: DataFrame, day: str, features: Sequence[str], target: str, group: str | None = None, bins: int = BINS):
        kept = df.dropna(subset=[*features, target])
        x = [F.col(c).cast("double") for c in features]
        name: Column = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
        self.features, self.bins = list(features), bins
        self.rows = materialize(kept.select(F.datediff(F.col(day).cast("date"), F.lit("1970-01-01").cast("date")).alias("day"), name.alias("group"), F.col(target).cast("double").alias("y"), *(c.alias(f"x{i}") for i, c in enumerate(x)), F.xxhash64(day, name, target, *features).alias("h")))
        at = [i / bins for i in range(bins + 1)]
        row = self.rows.agg(F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high"), *(F.percentile_approx(f"x{i}", at, 100 * bins).alias(f"e{i}") for i in range(len(x)))).first()
        self.n, self.low, self.high = row["n"], row["low"], row["high"]
        self.edges = [np.unique(row[f"e{i}"] or [0.0]) for i in range(len(x))]
        self.tasks = max(1, -(-self.n // TASK_ROWS))
        self.rows = self.rows.coalesce(self.tasks)  # never more than there are

    def batches(self, given: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for b in given:
            get = lambda c: b.column(c).to_numpy(zero_copy_only=False)
            yield get("day"), np.asarray(b.column("group").to_pylist(), object), get("y"), np.stack([get(f"x{i}") for i in range(len(self.features))], axis=1), get("h")

    def light(self) -> TreeData:
        """What tasks need: all but the DataFrame."""
        out = object.__new__(TreeData)
        out.features, out.bins, out.edges, out.rows = self.features, self.bins, self.edges, None
        return out


def _own(job: Job, day: np.ndarray, group: np.ndarray, ask: bool = False) -> np.ndarray:
    first, last = (job.ask_first, job.ask_last) if ask else (job.first, job.last)
    return np.flatnonzero((day >= first) & (day < last) & (group == job.group))


def _pass(data: TreeData, keys: Sequence[int], shape: tuple[int, ...], fill: Sequence[float], part, answer, schema: str) -> list[tuple]:
    """One pass: ``part(batch, add)`` adds to blocks of ``shape`` per (unit, node); a key's blocks meet in one task, which answers.

    The first axis of a block are its kinds: sums (fill 0), minima (inf) and maxima (-inf).
    """
    light, sums = data.light(), np.array(fill)

    def merge(a: np.ndarray, b: np.ndarray) -> None:
        for k, f in enumerate(fill):
            (np.add if f == 0 else np.minimum if f > 0 else np.maximum)(a[k], b[k], out=a[k])

    def gather(found: Iterator[tuple[int, int, np.ndarray]]) -> dict:
        blocks: dict[tuple[int, int], np.ndarray] = {}
        for unit, node, block in found:
            if (unit, node) in blocks:
                merge(blocks[unit, node], block)
            else:
                blocks[unit, node] = block.copy()
        return blocks

    def partial(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = gather(f for batch in light.batches(given) for f in part(light, batch))
        at = list(blocks)
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in at], pa.int32()), pa.array([n for _, n in at], pa.int32()), pa.array([blocks[k].tobytes() for k in at], pa.binary())], ["unit", "node", "block"])

    names = [f.split()[0] for f in schema.split(", ")]

    def reduced(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = ((u, n, np.frombuffer(b, float).reshape(len(sums), *shape)) for batch in given for u, n, b in zip(*(c.to_pylist() for c in batch.columns)))
        rows = [(u, n, *answer(u, n, block)) for (u, n), block in gather(read).items()]
        columns = list(zip(*rows)) if rows else [()] * (len(names) + 2)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i < 2 else pa.float64()) for i, c in enumerate(columns)], ["unit", "node", *names])

    if not keys:
        return []
    answering = min(data.tasks, len(keys), int(data.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = data.rows.mapInArrow(partial, "unit int, node int, block binary").repartition(answering, "unit").mapInArrow(reduced, f"unit int, node int, {schema}")
    return [tuple(r) for r in found.collect()]  # a row per unit and node


def _histograms(units: dict[int, _Unit], grown: dict[int, tuple], level: int, pull, weight):
    """The part of ``_pass`` that adds up a level's nodes."""
    begin = (1 << level) - 1

    def part(data: TreeData, batch):
        day, group, y, x, h = batch
        bins = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(data.edges)], axis=1)
        for i, unit in units.items():
            rows = _own(unit.job, day, group)
            w = weight(unit, h[rows])
            rows, w = rows[w > 0], w[w > 0]
            if not len(rows):
                continue
            own = x[rows]
            node = descend(own, *grown[i][:2])
            here = node >= begin
            rows, own, node, w = rows[here], own[here], node[here] - begin, w[here]
            g = pull(unit, y[rows], own) * w
            wide = max(map(len, data.edges))
            nodes, at = np.unique(node, return_inverse=True)
            blocks = np.zeros((4, len(nodes), len(data.edges), wide))
            for j in range(len(data.edges)):
                cell, size = at * wide + bins[rows, j], len(nodes) * wide
                low, high = np.full(size, np.inf), np.full(size, -np.inf)
                np.minimum.at(low, cell, own[:, j])
                np.maximum.at(high, cell, own[:, j])
                for k, found in enumerate((np.bincount(cell, w, size), np.bincount(cell, g, size), low, high)):
                    blocks[k, :, j] = found.reshape(len(nodes), wide)
            for t, n in enumerate(nodes.tolist()):
                yield i, n + begin, blocks[:, t]

    return part


def _best_split(least: int, allowed):
    """The answer of ``_pass`` for a node: gain, feature, cut and the counts and sums on either side."""

    def answer(unit: int, node: int, block: np.ndarray) -> tuple[float, ...]:
        n, g = block[0, 0].sum(), block[1, 0].sum()
        best = (_GAIN, -1.0, 0.0, 0.0, 0.0)
        for j in allowed(unit, node, block.shape[1]):
            full = np.flatnonzero(block[0, j])
            left, gl = np.cumsum(block[0, j, full])[:-1], np.cumsum(block[1, j, full])[:-1]
            if not len(left):
                continue
            gain = gl**2 / left + (g - gl) ** 2 / (n - left) - g**2 / n
            gain[(left < least) | (n - left < least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0] * (1 + 1e-12):
                best = (gain[k], j, (block[3, j, full[k]] + block[2, j, full[k + 1]]) / 2, left[k], gl[k])
        return (*best, n, g)

    return answer


_SPLIT = "gain double, feature double, cut double, n_left double, g_left double, n double, g double"


def _grow(data: TreeData, units: dict[int, _Unit], depth: int, least: int, pull, weight=lambda unit, h: np.ones(len(h)), allowed=lambda unit, node, k: range(k)) -> dict[int, tuple]:
    """A new tree for each unit; leaf values are the mean pulls."""
    grown = {i: _empty(depth) for i in units}
    open_units = dict(units)
    wide = max(map(len, data.edges))
    for level in range(depth):
        splits = _pass(data, list(open_units), (len(data.edges), wide), (0.0, 0.0, np.inf, -np.inf), _histograms(open_units, {i: grown[i] for i in open_units}, level, pull, weight), _best_split(least, allowed), _SPLIT)
        more = set()
        for i, node, _, feature, cut, n_left, g_left, n, g in splits:
            f, c, v = grown[i]
            if level == 0:
                v[0] = g / n
            if feature >= 0:
                f[node], c[node] = int(feature), cut
                v[2 * node + 1], v[2 * node + 2] = g_left / n_left, (g - g_left) / (n - n_left)
                more.add(i)
        open_units = {i: u for i, u in open_units.items() if i in more}
    return grown


def _quantiles(data: TreeData, units: dict[int, _Unit], grown: dict[int, tuple] | None, steps: int = STEPS) -> dict[tuple[int, int], float]:
    """The linear quantile of each unit's residuals in each leaf of its grown tree (in all rows without one), exact."""
    windows: dict[tuple[int, int], tuple[float, float, float]] = {}  # (unit, leaf): low, high, rows below; absent: the unit's bounds
    begin = {i: (data.low - hi, data.high - lo) for i, u in units.items() for lo, hi in [u.bounds()]}
    done: dict[tuple[int, int], float] = {}
    total: dict[tuple[int, int], float] = {}
    open_units = dict(units)
    while open_units:
        asked, known, all_rows = dict(windows), set(done), {i: grown[i] for i in open_units} if grown else None

        def part(light: TreeData, batch, asked=asked, known=known, held=open_units, all_rows=all_rows):
            day, group, y, x, _ = batch
            for i, unit in held.items():
                rows = _own(unit.job, day, group)
                if not len(rows):
                    continue
                rest = y[rows] - unit.value(x[rows])
                node = descend(x[rows], *all_rows[i][:2]) if all_rows else np.zeros(len(rows), np.int64)
                for n in np.unique(node):
                    if (i, int(n)) in known:
                        continue
                    low, high, _ = asked.get((i, int(n)), (*begin[i], 0.0))
                    r = rest[node == n]
                    r = r[(r >= low) & (r <= high)]
                    b = np.clip(((r - low) / (high - low) * steps).astype(np.int64), 0, steps - 1) if high > low else np.zeros(len(r), np.int64)
                    block = np.zeros((3, steps))
                    block[1], block[2] = np.inf, -np.inf
                    block[0] = np.bincount(b, minlength=steps)
                    np.minimum.at(block[1], b, r)
                    np.maximum.at(block[2], b, r)
                    yield i, int(n), block

        sizes, quantile = dict(total), {i: u.job.quantile for i, u in open_units.items()}

        def answer(i: int, n: int, block: np.ndarray, asked=asked, sizes=sizes, quantile=quantile) -> tuple[float, ...]:
            below = asked.get((i, n), (0.0, 0.0, 0.0))[2]
            size = sizes.get((i, n), block[0].sum())
            place = (size - 1) * quantile[i]
            full, count = np.flatnonzero(block[0]), below + np.cumsum(block[0][block[0] > 0])
            a, b = (int(np.searchsorted(count, r, side="right")) for r in (math.floor(place), min(math.floor(place) + 1, size - 1)))
            low, high = block[2 if a < b else 1, full[a]], block[1 if a < b else 2, full[b]]  # of two bins the facing ends
            known = a < b or low == high
            return float(known), low + (high - low) * (place - math.floor(place)) if known else 0.0, low, high, float(count[a] - block[0, full[a]]), size

        for i, n, found, value, low, high, below, size in _pass(data, list(open_units), (steps,), (0.0, np.inf, -np.inf), part, answer, "known double, value double, low double, high double, below double, size double"):
            total[i, n] = size
            if found:
                done[i, n] = value
                windows.pop((i, n), None)
            else:
                windows[i, n] = (low, high, below)
        left = {i for i, _ in windows}
        open_units = {i: u for i, u in open_units.items() if i in left}
    return done


def boosted(data: TreeData, jobs: Sequence[Job], trees: int = 20, depth: int = 3, rate: float = 0.1, least: int = 5) -> list[_Unit]:
    """Boosted trees of each job: on the sign of the quantile loss with quantile leaves, or on residuals with mean leaves."""
    units = {i: _Unit(j) for i, j in enumerate(jobs)}
    by_quantile = {i: u for i, u in units.items() if u.job.quantile is not None}
    by_mean = {i: u for i, u in units.items() if u.job.quantile is None}

    def pull(unit: _Unit, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        rest, q = y - unit.value(x), unit.job.quantile
        return rest if q is None else np.where(rest > 0, q, q - 1.0)

    for (i, _), value in _quantiles(data, by_quantile, None).items():
        units[i].base, units[i].trained = value, True
    for i, tree in _grow(data, by_mean, 1, data.n + 1, pull).items():  # no split: the mean
        units[i].base = float(tree[2][0])
    for _ in range(trees):
        grown = _grow(data, units, depth, least, pull)
        leaves = _quantiles(data, by_quantile, grown)
        for i, (feature, cut, value) in grown.items():
            if units[i].job.quantile is not None:
                value = np.zeros(len(value))
                for (u, n), v in leaves.items():
                    if u == i:
                        value[n] = v
            units[i].trees.append((feature, cut, np.where(feature < 0, value * rate, 0.0)))
    return list(units.values())


def forest(data: TreeData, jobs: Sequence[Job], trees: int = 20, depth: int = 5, share: float = 1 / 3, rows: float | None = None, least: int = 1, seed: int = 7) -> list[list[_Unit]]:
    """A forest per job: all trees grow at once.

    Nodes see a ``share`` of the features. Rows are drawn by their hash: each
    with chance ``rows``, or (None) as often as a Poisson number of mean one says.
    """
    units = {i * trees + t: _Unit(j, t) for i, j in enumerate(jobs) for t in range(trees)}
    ladder = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])

    def weight(unit: _Unit, h: np.ndarray) -> np.ndarray:
        u = _scramble(h, seed * 1_000_003 + unit.tree)
        return np.searchsorted(ladder, u, side="right").astype(float) if rows is None else (u < rows).astype(float)

    def allowed(unit: int, node: int, k: int) -> list[int]:
        drawn = _scramble(np.arange(k), (seed * 31 + unit) * 4099 + node)
        return sorted(np.argsort(drawn)[: max(1, math.ceil(share * k))].tolist())

    for i, tree in _grow(data, units, depth, least, lambda unit, y, x: y, weight, allowed).items():
        feature, cut, value = tree
        units[i].trees.append((feature, cut, np.where(feature < 0, value, 0.0) / trees))
    return [[units[i * trees + t] for t in range(trees)] for i in range(len(jobs))]


def answers(data: TreeData, models: Sequence[_Unit | Sequence[_Unit]]) -> DataFrame:
    """Rows (model, day, group, target, prediction): each row once for every model that it asks."""
    held = [[m] if isinstance(m, _Unit) else list(m) for m in models]
    light = data.light()

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for day, group, y, x, _ in light.batches(given):
            parts = []
            for i, units in enumerate(held):
                rows = _own(units[0].job, day, group, ask=True)
                if len(rows):
                    parts.append((np.full(len(rows), i), day[rows], group[rows], y[rows], sum(u.value(x[rows]) for u in units)))
            if parts:
                m, d, g, t, p = (np.concatenate(c) for c in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(m, pa.int32()), pa.array(d, pa.int32()).cast(pa.date32()), pa.array(g, pa.string()), pa.array(t, pa.float64()), pa.array(p, pa.float64())], ["model", "day", "group", "target", "prediction"])

    return data.rows.mapInArrow(run, "model int, day date, group string, target double, prediction double")
