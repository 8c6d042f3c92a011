"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints within ``radius`` bits of each other are linked and the connected
components of the links are the near-duplicate groups. Candidates come from
``2**(radius+1) - 1`` bit masks built from a linear code: any ``radius`` bit
positions are orthogonal to some code word, so every pair within the radius
agrees on all bits of at least one mask. There are no false negatives.

Defined cases: a null or empty text has fingerprint zero and links like any
other; equal fingerprints form one vertex, so copies cost nothing; a row with
a null ``doc_id`` gets the component of its fingerprint but never names one
(a component of null ids only is null); repeated rows come back repeated; an
empty table gives an empty result; other columns are carried by the caller.

The pipeline's stage (``keep_first``) has a rule of its own: texts of a
five-word Jaccard similarity of 0.8 or more. Such texts differ in about 10 of
64 bits, too many for masks, so its fingerprints are longer: texts that agree on
all bits of one of many bands, and in most of 128 bits beside them, are
candidates, and every link is verified (``similar_texts``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, components, fresh, materialize, mix, phrases, slices, table

BITS = 64
#: Members of a bucket that are compared in one block; larger buckets are cut into block pairs.
BLOCK = 1024
#: Jaccard similarity of five-word shingles from which the pipeline's stage takes texts for near-duplicates.
SIMILARITY = 0.8
#: Share of equal bits of two texts at that similarity: their cosine is 1.6 / 1.8 at least, an angle of 27 degrees; rounded down.
AGREE = 0.84
#: Texts that share a band are compared if at most so many of 128 other bits differ (19.5 are expected, five deviations more).
NEAR, BESIDE = 40, 128
#: Those that are near are compared further if at most so many of 512 more bits differ (77.6 are expected, seven deviations more).
CLOSE, WIDE = 138, 512
#: Columns in which a text's shingles are summed, each with a sign, before they are projected on the fingerprint's bits.
FOLD = 1024
#: Crowds are found by one in so many of the bands, before the texts meet in all.
FEW = 8
#: Texts of a band's bucket, or of a first text's followers, that are compared in one block.
PARTY = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, width: int, seed: int) -> bytes:
    """The fingerprint (8 bytes, highest bit first) of a UTF-8 text."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return bytes(8)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 16):
        hashes = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist())])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(starts)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """Rows (doc_id, text_hash, fp): fp is the 64-bit SimHash of each text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                out = b"".join(fingerprint(t, width, seed) for t in part.column("text").cast(pa.binary()).to_pylist())
                fp = np.frombuffer(out, ">i8").astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, text_hash long, fp long")


def masks(radius: int) -> list[int]:
    """Covering masks for 64 bits: bit i takes code column i, a non-zero (radius+1)-bit vector.

    Mask v keeps the bits whose column has an odd product with v. The columns
    of ``radius`` differing bits span at most ``radius`` dimensions, so some
    v is orthogonal to all and its mask drops exactly those differences.
    """
    n = (1 << (radius + 1)) - 1
    column = [1 + i % n for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (column[i] & v).bit_count() & 1) for v in range(1, n + 1)]


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (member, smallest member) of the components that links within the radius form in a block."""
    fps = np.unique(fps)
    n, u = len(fps), fps.view(np.uint64)
    label = np.arange(n)
    if n == 2:
        near = int(u[0] ^ u[1]).bit_count() <= radius
        return (fps[1:], fps[:1]) if near else (fps[:0], fps[:0])
    rows, cols = [], []
    for at in range(0, n, 256):
        i, j = np.nonzero(np.bitwise_count(u[at : at + 256, None] ^ u[None, :]) <= radius)
        rows.append(i + at), cols.append(j)
    i, j = np.concatenate(rows), np.concatenate(cols)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(n)
    return fps[far], fps[label[far]]


def links(distinct: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Rows (a, b) that connect the same fingerprints as all pairs of ``distinct`` (fp) within the radius do.

    Buckets are counted before anything is gathered. A bucket of at most
    ``block`` members is compared in one place; a larger one is cut into blocks
    whose pairs go to different tasks, so n different fingerprints that agree
    under one mask send n * n / ``block`` rows. A block pair returns a forest,
    not its pairs.
    """
    spread = distinct.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for i, m in enumerate(masks(radius))])).alias("s"),
    ).select("fp", "s.t", "s.key")
    # Written, so that the join has a plain exchange on either side and splits a crowded bucket's rows.
    full = materialize(spread.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    members = (
        spread.join(full, ["t", "key"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    packed = members.groupBy("t", "key", "i", "j").agg(F.collect_list("fp").alias("fps"))  # two blocks at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("fps")
            values, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            found = [_forest(values[s:e], radius) for s, e in zip(at[:-1], at[1:])]
            a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
            b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return packed.select("fps").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """Rows (doc_id, text_hash, fp, root, component_id), one per row of ``docs``.

    component_id is the smallest doc_id of the near-duplicate group, root its smallest fingerprint (as a long).
    """
    fps = materialize(fingerprints(docs, id_col, text_col, width, seed))
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = materialize(components(links(distinct.select("fp"), radius)))
    placed = distinct.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed)
    named = materialize(placed.groupBy("root").agg(F.min("rep").alias("component_id"))).join(placed, "root").select("fp", "root", "component_id")
    return fps.join(named, "fp")


def _shingles(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The distinct word shingles of each text, as sorted names; a text of fewer words has one shingle of them all, an empty one none."""
    # Copied first: lower-casing a slice in place of a whole array loses the slice's offset.
    words = Words(pc.ascii_lower(pa.array(texts.to_pylist(), pa.large_string())))
    names, first = words.names(), words.first
    n = np.diff(first)
    wide, out = phrases(names, width), []
    for s, m in zip(first[:-1].tolist(), n.tolist()):
        # A text of fewer words has one shingle of them all; its length keeps it apart from those of full width.
        out.append(np.unique(wide[s : s + m - width + 1]) if m >= width else mix(phrases(names[s : s + m], m) + np.uint64(m)) if m else wide[:0])
    return out


def bands_of(rows: int) -> tuple[int, int]:
    """Bands and bits a band for a table of so many rows: about 32 unrelated texts meet in a band, and a pair at the similarity shares none with probability 0.001 at most."""
    bits = min(40, max(12, (rows - 1).bit_length() - 5))
    return math.ceil(7 / AGREE**bits), bits


@lru_cache(maxsize=2)
def _signs(n: int) -> np.ndarray:
    return np.random.default_rng(5).integers(0, 2, (FOLD, n), dtype=np.int8).astype(np.float32) * 2 - 1


def long_fingerprints(sets: list[np.ndarray], n: int) -> np.ndarray:
    """A row of n SimHash bits for each set: whether the sum of its shingles' signs is above zero.

    A shingle's hash picks one of FOLD rows of signs and whether they are reversed.
    The sums are whole numbers, so they are the same in whatever order they are formed.
    """
    out = []
    for at in range(0, len(sets), 256):
        part = sets[at : at + 256]
        hashes = mix(np.concatenate(part) ^ _ODD)
        cell = np.repeat(np.arange(len(part)), [len(s) for s in part]) * FOLD + (hashes % np.uint64(FOLD)).astype(np.int64)
        sums = np.bincount(cell, np.where(hashes >> np.uint64(63), 1.0, -1.0), len(part) * FOLD).reshape(len(part), FOLD)
        out.append(sums.astype(np.float32) @ _signs(n) > 0)
    return np.concatenate(out) if out else np.zeros((0, n), bool)


def _vertex(shingles: np.ndarray) -> int:
    """A name of the set; zero for the empty one."""
    return int.from_bytes(xxhash.xxh64_digest(shingles.tobytes()), "big", signed=True) if len(shingles) else 0


def _marks(docs: DataFrame, width: int, bands: int = 237, bits: int = 20) -> DataFrame:
    """Rows (doc_id, text_hash, v, fp, fq, wide, keys): the name of each text's shingle set, twice 64 bits of its fingerprint, WIDE more of them and the keys of its bands of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                sets = _shingles(part.column("text"), width)
                found = long_fingerprints([s for s in sets if len(s)], BESIDE + bands * bits + WIDE)
                parted = found[:, BESIDE:-WIDE].reshape(-1, bands, bits)
                keys = np.zeros(parted.shape[:2], np.uint64)
                for i in range(bits):
                    keys |= parted[:, :, i].astype(np.uint64) << np.uint64(i)
                keys = mix(keys ^ np.arange(1, bands + 1, dtype=np.uint64) * _ODD)
                some = [i for i, s in enumerate(sets) if len(s)]
                beside, wide = np.zeros((2, len(sets)), np.int64), np.zeros((len(sets), WIDE // 64), np.int64)
                beside[:, some] = np.packbits(found[:, :BESIDE], axis=1).view(np.int64).T
                wide[some] = np.packbits(found[:, -WIDE:], axis=1).view(np.int64)
                words = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * wide.shape[1], pa.int32()), pa.array(wide.ravel()))
                at = np.cumsum([0, *(bands if len(s) else 0 for s in sets)])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array([_vertex(s) for s in sets], pa.int64()), *map(pa.array, beside), words, lists], ["doc_id", "text_hash", "v", "fp", "fq", "wide", "keys"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, v long, fp long, fq long, wide array<long>, keys array<long>")


def _shared(sets: list[np.ndarray], own: np.ndarray) -> np.ndarray:
    """How many members each of the sets (none empty) has in common with the set ``own``."""
    values, at = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    return np.add.reduceat(own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values, at, dtype=np.int64)


def _alike(v: np.ndarray, sets: list[np.ndarray], similarity: float, group: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all pairs of the given sets with that Jaccard similarity do, texts of one ``group`` being connected.

    A pair that is connected already isn't compared. In larger groups WIDE
    fingerprint bits go first: CLOSE different ones are seven deviations more than
    a pair at the similarity has.
    """
    label, out = np.unique(group, return_inverse=True)[1], []
    size = np.array([len(s) for s in sets])
    bits = np.packbits(long_fingerprints(sets, WIDE), axis=1).view(np.uint64) if len(sets) > 8 else None
    for i in range(len(v)):
        near = (np.arange(len(v)) > i) & (label != label[i]) & (np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]) - 1e-6)
        if bits is not None and near.any():
            near &= np.bitwise_count(bits ^ bits[i]).sum(axis=1) <= CLOSE
        if not near.any():
            continue
        some = np.flatnonzero(near)
        both = _shared([sets[j] for j in some], sets[i])
        for j in some[both >= similarity * (size[i] + size[some] - both) - 1e-6]:
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((int(v[i]), int(v[j])))
    return out


def _links_table(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _sets(table_: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in table_.column("set").to_pylist()]


def _near_groups(v: np.ndarray, bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For the buckets (v: one bucket a row, bits: 64 to a word) which two texts are within the radius, and for each text the smallest of those that this connects it with."""
    far = np.zeros((*v.shape, v.shape[1]), np.uint16)
    for word in np.moveaxis(bits, 2, 0):
        far += np.bitwise_count(word[:, :, None] ^ word[:, None, :])
    near, label = far <= radius, v
    while True:
        new = np.where(near, label[:, None, :], np.iinfo(np.int64).max).min(axis=2)
        if (new == label).all():
            return near, label
        label = new


def near_parts(packed: DataFrame, radius: int) -> DataFrame:
    """Rows (key, v, least, n): the buckets ``packed`` (key, m: structs of v, crowd and words of bits) parted into the texts that bits within the radius connect; least is a part's smallest, n the number of its rows.

    Texts without a near one of another crowd leave their bucket; a text without a crowd (null) is one of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("m")
            size, (members, crowds, *words) = lists.value_lengths().to_numpy(), lists.flatten().flatten()
            v, crowd, bits = members.to_numpy(), pc.coalesce(crowds, members).to_numpy(), np.stack([w.to_numpy().view(np.uint64) for w in words], axis=-1)
            key, begin = batch.column("key").to_numpy(), np.cumsum(size) - size
            for n in np.unique(size[size > 1]).tolist():
                of = np.flatnonzero(size == n)
                for at in range(0, len(of), step := max(1, (1 << 20) // (n * n))):
                    some = of[at : at + step]
                    rows = begin[some][:, None] + np.arange(n)
                    near, label = _near_groups(v[rows], bits[rows], radius)
                    kept = (near & (crowd[rows][:, :, None] != crowd[rows][:, None, :])).any(axis=2)
                    many = ((label[:, :, None] == label[:, None, :]) & kept[:, None, :]).sum(axis=2)
                    yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(key[some][:, None], rows.shape)[kept]), pa.array(v[rows][kept]), pa.array(label[kept]), pa.array(many[kept])], ["key", "v", "least", "n"])

    return packed.select("key", "m").mapInArrow(run, "key long, v long, least long, n long")


def in_blocks(members: DataFrame, block: int) -> DataFrame:
    """``members`` (key, v, ...) with i and j: a bucket above ``block`` is cut into blocks, of which each pair (i, j) holds two at most."""
    crowded = materialize(members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    return (
        members.join(crowded, "key", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *members.columns)
    )


def near_buckets(vertices: DataFrame, radius: int = NEAR, block: int = BLOCK, wide: DataFrame | None = None, close: int = CLOSE) -> DataFrame:
    """Rows (v, key, least) like those of ``band_buckets`` for ``vertices`` (v, fp, fq, keys), each bucket parted into the texts that near fingerprints connect.

    Texts without a near one leave it, so those that meet by chance send no
    sets. Near copies meet in most of their bands: crowds that a few bands show
    become one bucket each, and in a band's bucket a text then stays only beside
    a near one that is not of its crowd. With ``wide`` (v, wide: words of more
    bits) all are parted once more, by those bits and ``close``, as many texts that
    have a passage in common are near. A bucket above ``block`` is cut into blocks
    whose pairs go to different tasks, as in ``links``; every two of its texts meet.
    """

    def parts(members: DataFrame, radius: int, *words: str) -> DataFrame:
        packed = in_blocks(members, block).groupBy("key", "i", "j").agg(F.collect_list(F.struct("v", "crowd", *words)).alias("m"))
        return materialize(near_parts(packed.select(F.xxhash64("key", "i", "j").alias("key"), "m"), radius))

    alone, some = F.lit(None).cast("long").alias("crowd"), F.slice("keys", F.lit(1), F.ceil(F.size("keys") / FEW).cast("int"))
    crowds = crowds_of(parts(vertices.select("v", "fp", "fq", alone, F.explode(some).alias("key")), radius, "fp", "fq"), block)
    spread = vertices.join(crowds, "v", "left").select("v", "crowd", "fp", "fq", F.explode("keys").alias("key"))
    parted = parts(spread, radius, "fp", "fq").select(F.xxhash64("key", "least").alias("key"), "v").union(crowds.select(F.xxhash64("crowd").alias("key"), "v"))
    if wide is not None:
        words = {f"w{i}": F.get("wide", F.lit(i)) for i in range(WIDE // 64)}
        met = parted.join(wide, "v").select("key", "v", alone, *(c.alias(k) for k, c in words.items()))
        parted = gathered(parts(met, close, *words))
    return band_buckets(parted.select("v", F.array("key").alias("keys")))


def crowds_of(seen: DataFrame, block: int) -> DataFrame:
    """Rows (v, crowd): the texts of the parts ``seen`` (key, v, least, n) of one band in FEW that are better compared all at once.

    A crowd is what hangs together by these parts. One of n texts is kept if it
    sends fewer rows as a bucket, n * n / ``block``, than the parts of all bands would.
    """
    roots = materialize(components(seen.select(F.col("v").alias("a"), F.col("least").alias("b"))))
    sent = seen.groupBy("v").agg(F.sum(F.ceil(F.col("n") / block) * FEW).alias("sent"))
    named = materialize(sent.join(roots, "v").select("v", F.xxhash64("root", F.lit(1)).alias("crowd"), "sent"))
    size = named.groupBy("crowd").agg(F.count("*").alias("size"), F.sum("sent").alias("sent"))
    dense = materialize(size.where(F.col("sent") > F.col("size") * F.ceil(F.col("size") / block)).select("crowd"))
    return materialize(named.join(dense, "crowd").select("v", "crowd"))


def gathered(parted: DataFrame, block: int = PARTY) -> DataFrame:
    """Rows (key, v): the buckets of the parts (key, v, least, n), those of a crowd replaced by the crowd itself.

    The blocks of a large bucket have their parts in common. A part's crowd is
    named by its smallest text, which takes its own smallest neighbour's smallest
    neighbour, and holds all texts of its parts; where these send more rows than
    the n * n / ``block`` of its n texts, it becomes one bucket. So a crowd sends
    the lesser of the two, and every two texts that met in a part still meet.
    """
    met = materialize(parted.groupBy("least", "v").agg(F.sum(F.ceil(F.col("n") / block)).alias("sent")))
    hooks = met.groupBy("v").agg(F.min("least").alias("b"))
    leads = materialize(met.where("least = v").select("v").join(hooks, "v"))  # a part's smallest text is one of its own
    crowds = materialize(leads.select(F.col("v").alias("least"), "b").join(leads.select(F.col("v").alias("b"), F.col("b").alias("crowd")), "b").select("least", "crowd"))
    members = materialize(met.join(crowds, "least").groupBy("crowd", "v").agg(F.sum("sent").alias("sent")))
    size = members.groupBy("crowd").agg(F.count("*").alias("size"), F.sum("sent").alias("sent"))
    dense = materialize(size.where(F.col("sent") > F.col("size") * F.ceil(F.col("size") / block)).select("crowd"))
    rest = parted.join(crowds.join(dense, "crowd").select("least"), "least", "left_anti").select(F.xxhash64("key", "least").alias("key"), "v")
    return rest.union(members.join(dense, "crowd").select(F.xxhash64("crowd", F.lit(1)).alias("key"), "v"))


def band_buckets(vertices: DataFrame) -> DataFrame:
    """Rows (v, key, least): the bands that more than one of ``vertices`` (v, keys) share; of bands with the same members one."""
    spread = vertices.select("v", F.explode("keys").alias("key"))
    full = spread.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.sum(F.xxhash64("v").cast("decimal(38,0)")).alias("members")).where("n > 1")
    one = materialize(full.groupBy("n", "least", "members").agg(F.min("key").alias("key")).select("key", "least"))
    return spread.join(one, "key").select("v", "key", "least")


def first_pairs(buckets: DataFrame, sets: DataFrame, block: int = PARTY) -> DataFrame:
    """Rows (b, chunk, v, set): each text beside the first (b) of its buckets' first texts, which stands in every chunk of its followers."""
    pairs = materialize(buckets.where("v <> least").groupBy("v").agg(F.min("least").alias("b")))
    chunks = materialize(pairs.groupBy("b").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks")))
    followers = pairs.join(chunks, "b").select("b", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int").alias("chunk"), "v")
    leads = chunks.select("b", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("b").alias("v"))
    return followers.union(leads).join(sets, "v").select("b", "chunk", "v", "set")


def open_blocks(buckets: DataFrame, roots: DataFrame, sets: DataFrame, block: int = PARTY) -> DataFrame:
    """Rows (key, i, j, v, group, set): the buckets whose texts ``roots`` (v, root) leaves in several groups, cut into pairs of blocks."""
    grouped = buckets.join(roots, "v", "left").select("v", "key", F.coalesce("root", "v").alias("group"))
    cut = materialize(grouped.groupBy("key").agg(F.count("*").alias("n"), F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    dealt = (
        grouped.join(cut, "key")
        .withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "v", "group")
    )
    return dealt.join(sets, "v").select("key", "i", "j", "v", "group", "set")


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = 5, block: int = PARTY) -> DataFrame:
    """Rows (doc_id, text_hash, root), one per row of ``docs``; root names the group of texts that links of the similarity connect.

    The similarity is the Jaccard coefficient of the sets of ``width``-word
    shingles; every link is verified on the sets themselves. Texts that share
    a band of SimHash bits and are near in 128 others are candidates. Each is first compared with one text, the
    first of its buckets' first texts, which links most copies; then the
    buckets that still hold several groups are compared, each for itself, a
    large one in blocks whose pairs go to different tasks. Components are formed
    of verified links alone, so candidates that merely hang together never meet.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    marks = materialize(_marks(plain, width, *bands_of(docs.count())))
    vertices = materialize(marks.groupBy("v").agg(F.min("text_hash").alias("text_hash"), F.first("fp").alias("fp"), F.first("fq").alias("fq"), F.first("wide").alias("wide"), F.first("keys").alias("keys")))  # texts of the same shingles have the same bits
    buckets = materialize(near_buckets(vertices.select("v", "fp", "fq", "keys"), wide=vertices.select("v", "wide")))
    chosen = vertices.select("v", "text_hash").join(buckets.select("v").distinct(), "v")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                found = [s.tobytes() for s in _shingles(part.column("text"), width)]
                yield pa.RecordBatch.from_arrays([part.column("v"), pa.array(found, pa.binary())], ["v", "set"])

    sets = materialize(plain.join(chosen, "text_hash").select("v", "text").mapInArrow(shingled, "v long, set binary").dropDuplicates(["v"]))

    def against_first(key: tuple, table_: pa.Table) -> pa.Table:
        v, found = table_.column("v").to_numpy(), _sets(table_)
        lead, rest = int(np.flatnonzero(v == key[0].as_py())[0]), np.flatnonzero(v != key[0].as_py())
        if not len(rest):
            return _links_table([])
        size, both = np.array([len(found[i]) for i in rest]), _shared([found[i] for i in rest], found[lead])
        near = both >= similarity * (size + len(found[lead]) - both) - 1e-6
        return _links_table([(int(v[i]), key[0].as_py()) for i in rest[near]])

    def in_block(table_: pa.Table) -> pa.Table:
        return _links_table(_alike(table_.column("v").to_numpy(), _sets(table_), similarity, table_.column("group").to_numpy()))

    first = materialize(first_pairs(buckets, sets, block).groupBy("b", "chunk").applyInArrow(against_first, "a long, b long"))
    roots = materialize(components(first).distinct())
    rest = open_blocks(buckets, roots, sets, block).groupBy("key", "i", "j").applyInArrow(in_block, "a long, b long")
    joined = components(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).union(materialize(rest)))
    named = materialize(joined.withColumnRenamed("v", "own").distinct())
    return marks.join(named, F.col("v") == F.col("own"), "left").select("doc_id", "text_hash", F.coalesce("root", "v").alias("root"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group of ``similar_texts`` one row stays.

    It is the row of the smallest id (null ids last), then of the smallest text
    hash; of rows equal in both one. The decision is made on (id, hash, group)
    alone; the texts move once, to meet it.
    """
    groups = similar_texts(docs, id_col, text_col, similarity)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("s"))
    # Plain keys (a null id is 0 and a flag), so that the join's partitioning serves the last step too.
    key = fresh(docs, "_id", "_none", "_text_hash")
    first = first.select(*(c.alias(k) for c, k in zip((F.coalesce("s.doc_id", F.lit(0)), F.col("s.none"), F.col("s.text_hash")), key)))
    own = F.col(id_col).cast("long")
    keyed = docs.withColumns(dict(zip(key, (F.coalesce(own, F.lit(0)), own.isNull(), F.xxhash64(text_col)))))
    return keyed.join(first, key, "left_semi").dropDuplicates(key).drop(*key)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash": op3_simhash}
SQL: dict[str, str] = {}
