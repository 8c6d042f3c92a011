"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import global_rank, materialize, shared_dir

__all__ = ["BLANK", "WORD", "Words", "components", "fresh", "global_rank", "materialize", "mix", "phrases", "shared_dir", "slices", "table"]

#: What separates words and fills blank lines: space and \t \n \v \f \r.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name with as many underscores before it as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (long columns a, b): rows (v, root), root the smallest vertex.

    Alternating large-star and small-star steps: every step is a grouped
    minimum (combined before the shuffle), written, and a join of it on the
    vertex. Written, it has a plain exchange like the links, so the skew join
    can split a hub with very many links. Each round is written to the shared
    folder. Roots map to themselves.
    """

    def star(both: DataFrame, keep: Column) -> DataFrame:
        least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        return both.join(least, "u").where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))

    def mark(df: DataFrame) -> tuple[int, int]:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    # (a, b) with a > b from here on
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(cur)
    while before[0]:
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = materialize(star(both, F.col("v") > F.col("u")).where("a <> b").distinct())
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = materialize(down.groupBy("u").agg(F.min("v").alias("m")))
        small = down.join(least, "u").select(F.explode(F.array("v", "u")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        cur = materialize(small)
        now = mark(cur)
        if now == before:
            break
        before = now
    return cur.select(F.col("a").alias("v"), F.col("b").alias("root")).union(cur.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


# ---------------------------------------------------------------- words in numpy

_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_JOIN = np.uint64(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def phrases(symbols: np.ndarray, length: int) -> np.ndarray:
    """A name for the ``length`` symbols from each on, as far as there are so many.

    Phrases of 1, 2, 4, ... symbols are joined, each time by a mixing that is
    not linear, so no arithmetic relation between symbols makes names collide.
    """
    out, done, block, size = None, 0, symbols, 1
    while True:
        if length & size:
            out = block if out is None else mix(out[: max(0, len(symbols) - done - size + 1)] * _JOIN + block[done:])
            done += size
        size *= 2
        if size > length:
            return out
        half = size // 2
        block = mix(block[: max(0, len(symbols) - size + 1)] * _JOIN + block[half:])


class Words:
    """The words of a slice of texts: byte offsets, document index and names.

    ``doc`` is the index of a word's text in the slice, ``first`` the index of
    each text's first word and ``offsets`` that of its first byte in ``data``
    (one more entry than texts).
    """

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()) if texts.offset == 0 else pa.concat_arrays([texts]).cast(pa.large_binary())
        texts = texts.fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        buf = texts.buffers()[2]
        data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]] if buf is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        self.data, self.offsets = data, offsets
        solid = ~_SEP[data]
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        begin[inner] = solid[inner]
        end[inner - 1] = solid[inner - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def names(self) -> np.ndarray:
        """XXH3 of each word, computed once for each distinct word."""
        sizes = self.ends - self.starts
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[~_SEP[self.data]])])
        coded = packed.dictionary_encode()
        distinct = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        return distinct[coded.indices.to_numpy()] if len(sizes) else np.zeros(0, np.uint64)

    def sequences(self) -> tuple[bytes, np.ndarray]:
        """All words, each followed by a space, and where each begins (one more entry than words)."""
        sizes = self.ends - self.starts
        at = np.concatenate([[0], np.cumsum(sizes + 1)])
        solid = self.data[~_SEP[self.data]]
        out = np.full(at[-1], 0x20, np.uint8)
        out[np.arange(len(solid)) + np.repeat(np.arange(len(sizes)), sizes)] = solid
        return out.tobytes(), at


def slices(table_: pa.Table | pa.RecordBatch, text: str, most_bytes: int = 2 << 20):
    """Parts of an Arrow table with about ``most_bytes`` of text each, at least a row."""
    batches = table_.to_batches() if isinstance(table_, pa.Table) else [table_]
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to
