"""Benchmark decontamination: a BM25 index of test items, searched by every training passage.

Documents are cut into overlapping passages long enough that any span of the
longest item's length lies whole in one. A passage is the query, an item the
document of the index; scores are divided by the item's own, so 1 means that
the passage holds all its terms. Retrieval above the threshold is exact, by
block-max WAND: cursors stand in the posting lists of the passage's terms, the
pivot is the first item that the lists' maxima can lift to the threshold, and
where the maxima of the pivot's block can't, all cursors leap over it; what
remains is scored in full. Most passages hold no block that can reach the
threshold at all; that is seen for many passages at once from the block maxima
and no cursor is set there. Retrieved pairs count if the passage also holds
enough of the item's question and of its answer, as shares of five-word
shingles.

Items are indexed in shards of at most ``SHARD_BYTES`` of text, each collected
and broadcast by itself, and a pass over the documents searches up to
``SHARDS`` of them, so memory is bounded whatever the number of items.
Frequencies, mean length and the passage length are those of all items, so
findings don't depend on the shards.

Defined cases: texts are compared lower-cased, with marks as blanks; null or
empty texts and items without a word never match; an item shorter than five
words has one shingle of all its words; equal items match each for itself;
repeated rows and rows with a null id come back like any other; an empty index
or table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, SHINGLE = 0.6, 0.8, 5
#: Bytes of item text in a shard, shards that one pass over the documents searches, items in a block.
SHARD_BYTES, SHARDS, ITEM_BLOCK = 16 << 20, 8, 4
#: The most frequent terms count by their list's maximum while these sum to at most this share of the threshold.
FREQUENT = 1 / 3
#: Bytes of document text that are searched together.
SLICE = 1 << 20
_MARKS = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_MARKS).split()


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of an item up to its last sentence or line, and those of that; a single sentence is cut at two thirds."""
    parts = [w for p in _SENTENCE.split(text) if (w := tokens(p))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = tokens(text)
    cut = max(1, 2 * len(words) // 3)
    return words[:cut], words[cut:]


def shingles(words: list[bytes], k: int = SHINGLE) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


class Index:
    """An inverted index of items with impacts relative to each item's own score."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[bytes, int], n_items: int, mean_length: float, threshold: float, longest: int):
        self.threshold, self.longest = threshold, longest
        rows = sorted(((len(w), i, t, w) for i, t in items if (w := tokens(t))), key=lambda r: (r[0], r[1], r[2]))  # of like length, so block maxima are tight
        self.ids, self.texts, self.vocabulary = [r[1] for r in rows], [r[2] for r in rows], {}
        terms, owners, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for item, (length, _, _, words) in enumerate(rows):
            counts = Counter(words)
            tf, df = np.array(list(counts.values()), float), np.array([frequency[w] for w in counts], float)
            impact = np.log1p((n_items - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
            terms.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in counts]))
            owners.append(np.full(len(counts), item)), values.append(impact / impact.sum())
        term, item, value = (np.concatenate(x) for x in (terms, owners, values))
        order = np.lexsort([item, term])
        term, item, value = term[order], item[order], value[order]
        n = len(self.vocabulary)
        first = np.searchsorted(term, np.arange(n + 1))
        self.most = np.maximum.reduceat(value, first[:-1]) if n else np.zeros(0)
        self.items = [item[s:e].tolist() for s, e in zip(first, first[1:])]
        self.values = [value[s:e].tolist() for s, e in zip(first, first[1:])]
        self.n_blocks = max(1, math.ceil(len(rows) / ITEM_BLOCK))
        key, at = np.unique(term * self.n_blocks + item // ITEM_BLOCK, return_index=True)
        self.blocks, self.block_most = key % self.n_blocks, np.maximum.reduceat(value, at) if n else value
        self.block_first = np.searchsorted(key // self.n_blocks, np.arange(n + 1))
        self.block_of = [dict(zip(self.blocks[s:e].tolist(), self.block_most[s:e].tolist())) for s, e in zip(self.block_first, self.block_first[1:])]
        self.frequent = np.zeros(n, bool)
        widest = np.argsort(-np.diff(self.block_first), kind="stable")
        self.frequent[widest[np.cumsum(self.most[widest]) <= FREQUENT * threshold]] = True

    def reachable(self, passage: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Which of ``n`` passages hold terms whose maxima in some block reach the threshold; pairs (passage, term) are distinct."""
        often = self.frequent[term]
        base = np.bincount(passage[often], self.most[term[often]], n)
        passage, term = passage[~often], term[~often]
        out, step = np.zeros(n, bool), max(1, (1 << 22) // self.n_blocks)
        order = np.argsort(passage, kind="stable")
        passage, term = passage[order], term[order]
        for at in range(0, n, step):
            s, e = np.searchsorted(passage, [at, at + step])
            first = self.block_first[term[s:e]]
            size = self.block_first[term[s:e] + 1] - first
            post = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            here = min(step, n - at)
            sums = np.bincount(np.repeat(passage[s:e] - at, size) * self.n_blocks + self.blocks[post], self.block_most[post], here * self.n_blocks)
            out[at : at + here] = sums.reshape(here, -1).max(axis=1) + base[at : at + here] >= self.threshold - 1e-9
        return out

    def wand(self, terms: list[int], seen: Counter | None = None) -> list[tuple[int, float]]:
        """(item, score) of the items that ``terms`` lift to the threshold; ``seen`` counts postings scored and skipped."""
        theta, most, found = self.threshold - 1e-9, self.most.tolist() if len(terms) > 64 else self.most, []
        lists = [[self.items[t][0], t, 0] for t in terms]  # current item, term, place in the list
        while lists:
            lists.sort()
            total, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(lists):
                total += most[t]
                if total >= theta:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            block = item // ITEM_BLOCK
            if sum(self.block_of[t].get(block, 0.0) for _, t, _ in lists[: pivot + 1]) < theta:
                to = (block + 1) * ITEM_BLOCK  # nothing before that, or before the next list's item, can reach the threshold
                if pivot + 1 < len(lists):
                    to = min(to, lists[pivot + 1][0])
                moved, kind = lists[: pivot + 1], "skipped"
            elif lists[0][0] == item:
                score = sum(self.values[t][at] for _, t, at in lists[: pivot + 1])
                if score >= self.threshold:
                    found.append((item, score))
                to, moved, kind = item + 1, lists[: pivot + 1], "scored"
            else:
                to, moved, kind = item, [x for x in lists[:pivot] if x[0] < item], "skipped"
            for x in moved:
                own = self.items[x[1]]
                at = bisect_left(own, to, x[2])
                if seen is not None:
                    seen[kind] += at - x[2]
                x[0], x[2] = own[at] if at < len(own) else -1, at
            lists = [x for x in lists if x[0] >= 0]
        if seen is not None:
            seen["skipped"] += sum(len(self.items[t]) - at for _, t, at in lists)
        return found

    def search(self, texts: list[list[bytes]], seen: Counter | None = None) -> list[tuple[int, int, int, float]]:
        """(text, first word, item, score) of all passages of tokenised texts that reach the threshold."""
        passage = max(64, 2 * self.longest)
        stride = passage // 2
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ids = np.fromiter((i for words in texts for i in map(self.vocabulary.get, words, repeat(-1))), np.int64, size.sum())
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return []
        first, base = np.cumsum(size) - size, np.cumsum(-(-size // stride)) - -(-size // stride)
        text = np.searchsorted(first, at, side="right") - 1
        # A word lies in the passage that starts in its stride and in the one before.
        number = (at - first[text]) // stride
        own = base[text] + number
        key = np.unique(np.concatenate([own, own[number > 0] - 1]) * len(self.vocabulary) + np.concatenate([ids[at], ids[at[number > 0]]]))
        place, term = key // len(self.vocabulary), key % len(self.vocabulary)
        n = int(place[-1]) + 1
        good = np.flatnonzero(self.reachable(place, term, n))
        if seen is not None:
            seen["skipped"] += sum(len(self.items[t]) for t in term[~np.isin(place, good)])
        out = []
        for p, s, e in zip(good.tolist(), np.searchsorted(place, good).tolist(), np.searchsorted(place, good, side="right").tolist()):
            hits = self.wand(term[s:e].tolist(), seen)
            if hits:
                t = int(np.searchsorted(base, p, side="right")) - 1
                while not size[t]:  # texts without a word begin no passage
                    t -= 1
                out += [(t, (p - int(base[t])) * stride, item, score) for item, score in hits]
        return out

    def overlap(self, words: list[bytes], item: int) -> tuple[float, float]:
        """Shares of the question's and the answer's shingles that the passage holds; an item without an answer has 1."""
        have: dict[int, set] = {}
        shares = []
        for part in map(shingles, question_answer(self.texts[item])):
            k = len(next(iter(part))) if part else 0
            if k and k not in have:
                have[k] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
            shares.append(len(part & have[k]) / len(part) if part else 1.0)
        return shares[0], shares[1]


RESULT = "doc_id long, item_id long, score double, passage_start long, question_overlap double, answer_overlap double"


def _terms(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [tokens(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([list({w for w in x}) for x in words], pa.list_(pa.binary())), pa.array([len(x) for x in words], pa.int64())], ["words", "n"]
            )

    return items.mapInArrow(run, "words array<binary>, n long")


def _indexes(spark: SparkSession, items: DataFrame, threshold: float, shard_bytes: int) -> list[list]:
    """Broadcast indexes of the items' shards, ``SHARDS`` to a pass; frequencies and lengths are those of all items."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    counted = materialize(_terms(items))
    stats = counted.where("n > 0").agg(F.count("*").alias("n"), F.avg("n").alias("mean"), F.max("n").alias("longest")).first()
    if not stats["n"]:
        return []
    size = items.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"]
    shards = max(1, math.ceil(size / shard_bytes))
    frequency = counted.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    frequency = materialize(frequency) if shards > 1 else frequency
    out = []
    for shard in range(shards):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
        own = frequency if shards == 1 else frequency.join(_terms(rows).select(F.explode("words").alias("w")).distinct(), "w")
        index = Index(
            [(r["item_id"], r["text"]) for r in rows.collect()],  # a shard: its bytes are bounded
            {bytes(r["w"]): r["df"] for r in own.collect()},
            stats["n"], stats["mean"], threshold, stats["longest"],
        )
        out.append(spark.sparkContext.broadcast(index))
    return [out[at : at + SHARDS] for at in range(0, shards, SHARDS)]


def found_in(index: Index, texts: list[list[bytes]], overlap: float) -> list[tuple[int, int, float, int, float, float]]:
    """(text, item_id, score, first word, question overlap, answer overlap) of the verified items of tokenised texts, each by its best passage."""
    passage = max(64, 2 * index.longest)
    best: dict[tuple[int, int], tuple] = {}
    for text, first, item, score in index.search(texts):
        q, a = index.overlap(texts[text][first : first + passage], item)
        if q >= overlap and a >= overlap and ((text, item) not in best or (q + a, score) > best[text, item][0]):
            best[text, item] = ((q + a, score), first, q, a)
    return [(t, index.ids[i], s[1], first, q, a) for (t, i), (s, first, q, a) in sorted(best.items())]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per (doc_id, item_id) retrieved and verified, with the best passage.

    Rows: doc_id, item_id, score, passage_start (word), question_overlap, answer_overlap.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]
    names = ["doc_id", "item_id", "score", "passage_start", "question_overlap", "answer_overlap"]

    def search(shards):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    ids, texts = part.column("doc_id").to_pylist(), [tokens(t) for t in part.column("text").to_pylist()]
                    rows = [(ids[t], *f) for s in shards for t, *f in found_in(s.value, texts, overlap)]
                    columns = list(zip(*rows)) if rows else [()] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        return run

    passes = _indexes(docs.sparkSession, items, threshold, shard_bytes)
    return reduce(DataFrame.union, [docs.mapInArrow(search(s), RESULT) for s in passes or [[]]])


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text holds no item. Rows are judged where they are read; nothing moves."""

    def keep(shards):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text_col, SLICE):
                    texts = [tokens(t) for t in part.column(text_col).to_pylist()]
                    held = {t for s in shards for t, *_ in found_in(s.value, texts, overlap)}
                    yield part.filter(pa.array([t not in held for t in range(len(texts))], pa.bool_()))

        return run

    for shards in _indexes(docs.sparkSession, items, threshold, shard_bytes):
        docs = docs.mapInArrow(keep(shards), docs.schema)
    return docs


def op4_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_bm25_wand": op4_bm25_wand}
SQL: dict[str, str] = {}
