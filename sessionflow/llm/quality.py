"""Quality classifier: Bradley-Terry pairwise ranking of documents.

A document's worth is linear in features of its text: hashed words, hashed
byte trigrams (square roots of their shares) and a few counts of its shape.
What they are worth is learned from preference pairs (one row of label 1, one
of label 0) by logistic loss on the pair's feature difference, with a ridge.
Scores are a monotone map of the worth. The threshold lies at a quantile of
the training worths, by default the share of label 0.

The fit uses a bounded sample of the labelled rows (``SAMPLE`` rows by hash
order, ``PAIRS`` pairs); features and scores cover every whole text.

Defined cases: null and empty texts are scored like any text, with zero
features; labels other than 0 and 1, null doc_ids and labels without a
document are no training rows; a document with several labels is one training
row for each; without rows of both labels every score is 0.5; repeated rows
come back repeated; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, slices, table

SAMPLE, PAIRS, THRESHOLD = 8_000, 60_000, 0.7
#: Hash buckets of words and of byte trigrams; ridge on shape and on hashed features.
WORDS, GRAMS, RIDGE, HASHED_RIDGE = 512, 512, 10.0, 160.0
#: Bytes of text whose features are made together.
SLICE = 2 << 20
_KIND = np.zeros(256, np.uint8)  # 1 lower case and other letters, 2 upper case, 3 digit, 4 sentence mark, 5 other mark, 6 space, 7 line end
for _c in range(128):
    _s = chr(_c)
    _KIND[_c] = 1 if _s.islower() else 2 if _s.isupper() else 3 if _s.isdigit() else 4 if _s in ".,;:'\"()-" else 7 if _s == "\n" else 6 if _s.isspace() else 5
_KIND[128:] = 1
N_SHAPE = 17
N_FEATURES = N_SHAPE + WORDS + GRAMS


def shape(text: bytes | None) -> list[float]:
    """Counts of a UTF-8 text: none of them names a word, a language or a source."""
    text = text or b""
    words = text.split()
    if not words:
        return [0.0] * N_SHAPE
    data = np.frombuffer(text, np.uint8)
    kinds = np.bincount(_KIND[data], minlength=8) / len(data)
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines)
    repeated = sum(a == b for a, b in zip(words, words[1:])) / n
    upper = sum(map(bytes.isupper, words)) / n
    title = sum(map(bytes.istitle, words)) / n
    return [
        np.log1p(n), kinds[2], kinds[3], kinds[4], kinds[5], sizes.mean() / 10, sizes.std() / 10, len(seen) / n, seen.most_common(1)[0][1] / n,
        np.log1p(len(seen)), ends, len(lines) / n, len(set(lines)) / len(lines), repeated, upper, title, sizes.max() / 100,
    ]


def hashed(texts: pa.Array) -> np.ndarray:
    """A row for each text: square roots of the shares of its words, then of its byte trigrams, by hash bucket."""
    words, n = Words(texts), len(texts)
    kind = (words.names() % np.uint64(WORDS)).astype(np.int64)
    count = np.diff(words.first)
    out = np.zeros((n, WORDS + GRAMS))
    out[:, :WORDS] = np.bincount(words.doc * WORDS + kind, minlength=n * WORDS).reshape(n, WORDS) / np.maximum(count, 1)[:, None]
    data, size = words.data.astype(np.int64), np.diff(words.offsets)
    doc = np.repeat(np.arange(n), size)
    whole = doc[:-2] == doc[2:]
    gram = ((((data[:-2] << 16) | (data[1:-1] << 8) | data[2:]) * 0x9E3779B1) >> 12) % GRAMS
    out[:, WORDS:] = np.bincount(doc[:-2][whole] * GRAMS + gram[whole], minlength=n * GRAMS).reshape(n, GRAMS) / np.maximum(size - 2, 1)[:, None]
    out[count == 0] = 0
    return np.sqrt(out)


def features(texts: pa.Array) -> np.ndarray:
    """The features of each text, N_FEATURES a row."""
    shapes = np.array([shape(t) for t in texts.cast(pa.binary()).to_pylist()], float).reshape(-1, N_SHAPE)
    return np.concatenate([shapes, hashed(texts)], axis=1)


def _standard(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / std, -8, 8)


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float | np.ndarray = 1.0, threshold: float = THRESHOLD, quantile: float | None = None) -> dict | None:
    """Weights by logistic loss on feature differences, and the calibration of scores.

    A score of ``threshold`` lies at ``quantile`` of the training worths, by
    default the share of label 0.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, std = x.mean(axis=0), x.std(axis=0)
    std[std < 1e-9] = 1.0
    z = _standard(x, mean, std)
    rng = np.random.default_rng(7)
    n = min(pairs, len(good) * len(bad))
    better, worse = rng.choice(good, n), rng.choice(bad, n)
    ridge = np.broadcast_to(np.asarray(ridge, float), (x.shape[1],))

    def gathered(weight: np.ndarray) -> np.ndarray:
        """The sum of the pairs' feature differences by weight."""
        return z.T @ (np.bincount(better, weight, len(z)) - np.bincount(worse, weight, len(z)))

    w = np.zeros(x.shape[1])
    for _ in range(40):  # Newton steps on a convex loss, each by conjugate gradients
        worth = z @ w
        p = 1 / (1 + np.exp(np.clip(worth[better] - worth[worse], -30, 30)))
        step, rest = np.zeros_like(w), gathered(p) - ridge * w
        along, left = rest.copy(), rest @ rest
        least = left * 1e-8
        for _ in range(100):
            if left <= least or not left:
                break
            moved = z @ along
            bent = gathered(p * (1 - p) * (moved[better] - moved[worse])) + ridge * along
            size = left / (along @ bent)
            step, rest = step + size * along, rest - size * bent
            before, left = left, rest @ rest
            along = rest + left / before * along
        w += step
        if np.abs(step).max() < 1e-8:
            break
    worth = np.sort(z @ w)
    quantile = len(bad) / len(y) if quantile is None else quantile
    cut = min(max(1, round(quantile * len(worth))), len(worth) - 1)  # so many worths are rejected
    edge = (worth[cut - 1] + worth[cut]) / 2
    scale = max(1e-6, float(np.median(np.abs(worth - edge)))) / 2
    return {"mean": mean, "std": std, "w": w, "edge": float(edge), "scale": scale, "quantile": cut / len(worth), "at": float(np.log(threshold / (1 - threshold)))}


def score_rows(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    worth = _standard(x, model["mean"], model["std"]) @ model["w"]
    return 1 / (1 + np.exp(-np.clip((worth - model["edge"]) / model["scale"] + model["at"], -700, 700)))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``sample`` labelled rows outside the held-out quarter."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2))
    labels = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)  # at most ``sample`` pairs of numbers, so they can be broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                x = features(part.column("text")).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "x"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(labels), "doc_id").select("y", "text").mapInArrow(run, "y int, x binary").collect()
    rows = sorted((r["y"], bytes(r["x"])) for r in rows)  # the fit must not hang on the order of tasks
    x = np.frombuffer(b"".join(r for _, r in rows), np.float32).reshape(-1, N_FEATURES).astype(float)
    return x, np.array([y for y, _ in rows], int)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, pairs: int = PAIRS) -> dict | None:
    """The fitted model, None if the sample lacks a label."""
    ridge = np.repeat([RIDGE, HASHED_RIDGE], [N_SHAPE, WORDS + GRAMS])
    return fit(*training_rows(docs, labels, id_col, text_col, label_col, sample), pairs=pairs, ridge=ridge)


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score) for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score_rows(model, features(part.column("text"))))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: dict | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text scores ``threshold`` or more; all rows without a model."""
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                yield part.filter(pa.array(score_rows(model, features(part.column(text_col))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op9_bradley_terry": op9_bradley_terry}
SQL: dict[str, str] = {}
