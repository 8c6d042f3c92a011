"""Substring deduplication by recompression.

A document's word names are compressed in rounds: runs of one symbol become a
run symbol, then pairs become pair symbols, where a symbol-keyed coin says who
may stand left and who right. A new symbol's name is a hash of what it
replaces, so every executor names equal content alike without a shared
dictionary. Who is merged depends on the symbols alone, so in equal word
sequences all symbols but a few at either edge are equal. For each window the
edges are cut away as narrowly as any context allows, while enough symbols are
left to choose from; a phrase of them is the window's signature.

Spark then shuffles: (1) signatures, combined per block of documents, show
which occur in several documents; (2) only windows behind shared signatures
send their name, which yields the smallest document with that very window;
(3) each block marks the words its later windows cover. Each exchange carries
packed arrays by (block, bucket) and a document's text is moved once.

A window's name is a 64-bit hash of its words' XXH3 and, to verify it, 63 bits
of the SHA-256 of the words themselves; both must agree. Words of any length
and form are told apart, also those made to collide in a polynomial hash.

Defined cases: a null or empty text has no words; repeated doc_ids compare as
equal (neither is smaller); a row with a null ``doc_id`` takes no part and
keeps all words, and is answered where it is read; an empty table gives an
empty result. A group of tasks' memory holds one block of documents, of about
``BLOCK_CHARS`` characters or one document if that is longer.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, mix, phrases, slices, table

WIDTH = 13
#: Symbols of a signature's phrase, symbols that a window must determine to use a level, words of a phrase below all levels.
PHRASE, CHOICE, WORDS = 3, 5, 6
#: Characters of text behind the signatures of one row of an exchange.
BLOB_CHARS = 2400
#: Characters of text that a block of documents holds at most, on average.
BLOCK_CHARS = 64 << 20
_LEFT, _PAIR, _RUN = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_U = np.uint64


def window_starts(doc: np.ndarray, width: int) -> np.ndarray:
    n = len(doc) - width + 1
    return np.flatnonzero(doc[width - 1 :] == doc[:n]) if n > 0 else np.zeros(0, np.int64)


def compress_runs(sym: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal symbols become one: (symbols, documents, new index of each old symbol)."""
    new = np.ones(len(sym), bool)
    new[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    out, size = sym[at], np.diff(np.append(at, len(sym)))
    long = size > 1
    out[long] = mix(out[long] * _RUN + size[long].astype(_U))
    return out, doc[at], np.cumsum(new) - 1


def compress_pairs(sym: np.ndarray, doc: np.ndarray, round_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a left and a right symbol become one: (symbols, documents, new index, who is left)."""
    left = (mix(sym + _U(int(_LEFT) * (round_ + 1) % (1 << 64))) & _U(1)).astype(bool)
    keep = np.ones(len(sym), bool)
    keep[1:] = ~(left[:-1] & ~left[1:] & (doc[1:] == doc[:-1]))
    out = sym.copy()
    second = np.flatnonzero(~keep)
    out[second - 1] = mix(mix(sym[second - 1] * _PAIR) + sym[second])
    return out[keep], doc[keep], np.cumsum(keep) - 1, left


def _least(sym: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """The smallest name of a phrase of ``length`` symbols in each span."""
    names = phrases(mix(sym), length)
    best = names[lo]
    for k in range(1, int((hi - lo).max(initial=1)) - length + 1):
        inside = np.flatnonzero(lo + k + length <= hi)
        best[inside] = np.minimum(best[inside], names[lo[inside] + k])
    return best


def signatures(sym: np.ndarray, doc: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For each window a phrase of symbols of the highest level that leaves a choice of phrases.

    A window keeps, level by level, the span of symbols that it determines by
    itself, so equal windows get equal signatures wherever they stand. A
    phrase says more than a symbol and the smallest of several stays the same
    over neighbouring windows. Windows that never reach a level (few runs of
    one word) take a phrase of their words.
    """
    out = np.empty(len(starts), _U)
    active, lo, hi, level = np.arange(len(starts)), starts, starts + width, 0
    while len(active):
        below, lo0, hi0 = sym, lo, hi
        # A window's first and last run may go on outside it.
        sym, doc, to = compress_runs(sym, doc)
        a, b = to[lo] + 1, to[hi - 1]
        up = b > a
        a, b = np.where(up, a, 0), np.where(up, b, 1)
        # A right symbol at the start may join the one before, a left symbol at the end the one after.
        sym, doc, to, left = compress_pairs(sym, doc, level)
        a, b = to[a] + ~left[a], to[b - 1] + ~left[b - 1]
        up &= b - a >= CHOICE
        out[active[~up]] = _least(below, lo0[~up], hi0[~up], PHRASE if level else min(WORDS, width))
        active, lo, hi, level = active[up], a[up], b[up], level + 1
    return out


def _by_key(keys: list[np.ndarray], least: np.ndarray, most: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sort by the keys; of each distinct key the smallest ``least`` and the largest ``most``."""
    if not len(least):
        return keys, least, most
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    at = np.flatnonzero(_changes(keys))
    return [k[at] for k in keys], np.minimum.reduceat(least[order], at), np.maximum.reduceat(most[order], at)


def _changes(keys: list[np.ndarray]) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _packs(block: int, buckets: int, columns: dict[str, np.ndarray]) -> pa.Table:
    """One row per bucket (the first column's upper bits; it is sorted) with the arrays as bytes.

    ``ids`` are kept as differences to their smallest in as few bytes as hold them.
    """
    key = next(iter(columns.values()))
    edges = np.searchsorted(key, (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(_U))
    spans = [(i, s, e) for i, (s, e) in enumerate(zip([0, *edges], [*edges, len(key)])) if e > s]
    out = {"bucket": pa.array([i for i, _, _ in spans], pa.int32()), "block": pa.array([block] * len(spans), pa.int32())}
    for name, x in columns.items():
        if name == "ids":
            base = x.min(initial=0) if not len(x) else x.min()
            x = (x.astype(_U) - _U(int(base) % (1 << 64))) if len(x) else x.astype(_U)
            size = next(d for d in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(x) or x.max() <= np.iinfo(d).max)
            x = x.astype(size)
            out["base"] = pa.array([int(base)] * len(spans), pa.int64())
        out[name] = pa.array([x[s:e].tobytes() for _, s, e in spans], pa.binary())
    return pa.table(out)


def _read(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _parts(docs: pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a block: (rows, doc_ids, whether a row takes part)."""
    for part in slices(docs, "text"):
        ids = part.column("doc_id")
        yield part, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)


def _collect(found: list[tuple[list[np.ndarray], np.ndarray]], types: list) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    keys = [np.concatenate([np.zeros(0, t), *(k[j] for k, _ in found)]) for j, t in enumerate(types)]
    ids = np.concatenate([np.zeros(0, np.int64), *(i for _, i in found)])
    return _by_key(keys, ids, ids)


SIGNED = "bucket int, block int, sig binary"
SHARED = "block int, sig binary"
NAMED = "bucket int, block int, k0 binary, k1 binary, base long, ids binary"
LATER = "block int, k0 binary, k1 binary, own0 binary, own1 binary, least binary"


def _signed(docs: pa.Table, width: int, buckets: int) -> pa.Table:
    """The distinct signatures of a block; the lowest bit says that the block has them in several documents."""
    found, block = [], docs.column("block")[0].as_py()
    for part, ids, valid in _parts(docs):
        words = Words(part.column("text"))
        starts = window_starts(words.doc, width)
        sig = signatures(words.names(), words.doc, starts, width) >> _U(1)
        use = valid[words.doc[starts]]
        keys, least, most = _by_key([sig[use]], ids[words.doc[starts[use]]], ids[words.doc[starts[use]]])
        found += [(keys, least), (keys, most)]
    (sig,), least, most = _collect(found, [_U])
    return _packs(block, buckets, {"sig": (sig << _U(1)) | (least < most).astype(_U)})


def _shared(packs: pa.Table) -> pa.Table:
    """Of a bucket's signatures those of several documents, returned to each block that has them."""
    sig = _read(packs.column("sig"), _U)
    keys, times = np.unique(sig >> _U(1), return_counts=True)
    keys = np.union1d(keys[times > 1], sig[(sig & _U(1)).astype(bool)] >> _U(1))
    own = [np.frombuffer(k, _U) >> _U(1) for k in packs.column("sig").to_pylist()]
    kept = [k[np.isin(k, keys, assume_unique=True)].tobytes() for k in own]
    return pa.table({"block": packs.column("block"), "sig": pa.array(kept, pa.binary())})


def _verified(words: Words, starts: np.ndarray, width: int) -> np.ndarray:
    """63 bits of the SHA-256 of each window's words, above a free bit."""
    if not len(starts):
        return np.zeros(0, _U)
    data, at = words.sequences()
    text, sha = memoryview(data), hashlib.sha256
    digests = b"".join([sha(text[s:e]).digest()[:8] for s, e in zip(at[starts].tolist(), (at[starts + width] - 1).tolist())])
    return np.frombuffer(digests, ">u8").astype(_U) << _U(1)


def _named(docs: pa.Table, shared: pa.Table, width: int, buckets: int) -> pa.Table:
    """The names of a block's windows behind shared signatures, each with its smallest document.

    The free bit says that the block has the window in several documents.
    """
    known, found = np.sort(_read(shared.column("sig"), _U)), []
    for part, ids, valid in _parts(docs) if docs.num_rows and len(known) else ():
        words = Words(part.column("text"))
        starts = window_starts(words.doc, width)
        names = words.names()
        sig = signatures(names, words.doc, starts, width) >> _U(1)
        at = np.minimum(np.searchsorted(known, sig), len(known) - 1)
        starts = starts[(known[at] == sig) & valid[words.doc[starts]]]
        keys, least, most = _by_key([phrases(names, width)[starts], _verified(words, starts, width)], ids[words.doc[starts]], ids[words.doc[starts]])
        found += [(keys, least), (keys, most)]
    (k0, k1), least, most = _collect(found, [_U, _U])
    return _packs(docs.column("block")[0].as_py() if docs.num_rows else 0, buckets, {"k0": k0, "k1": k1 | (least < most).astype(_U), "ids": least})


def _later(packs: pa.Table) -> pa.Table:
    """Returned to each block: windows that a smaller document elsewhere has, and those that its own smallest document began."""
    k0, flagged = _read(packs.column("k0"), _U), _read(packs.column("k1"), _U)
    sizes = [len(x) // 8 for x in packs.column("k0").to_pylist()]
    least = np.concatenate([np.zeros(0, np.int64)] + [(np.frombuffer(x, f"u{len(x) // n}").astype(_U) + _U(b % (1 << 64))).astype(np.int64) for x, b, n in zip(packs.column("ids").to_pylist(), packs.column("base").to_pylist(), sizes) if n])
    k1, several = flagged & ~_U(1), (flagged & _U(1)).astype(bool)
    order = np.lexsort([k1, k0])
    first = np.empty(len(order), np.int64)
    if len(order):
        at = np.flatnonzero(_changes([k0[order], k1[order]]))
        first[order] = np.repeat(np.minimum.reduceat(least[order], at), np.diff(np.append(at, len(order))))
    ends, rows = np.cumsum(sizes), []
    for s, e in zip(ends - sizes, ends):
        late = np.flatnonzero(first[s:e] < least[s:e]) + s
        own = np.flatnonzero((first[s:e] == least[s:e]) & several[s:e]) + s
        rows.append((k0[late].tobytes(), k1[late].tobytes(), k0[own].tobytes(), k1[own].tobytes(), least[own].tobytes()))
    return pa.table({"block": packs.column("block")} | {n: pa.array([r[j] for r in rows], pa.binary()) for j, n in enumerate(("k0", "k1", "own0", "own1", "least"))})


_NONE = pa.schema([(n, pa.binary()) for n in ("k0", "k1", "own0", "own1", "least")]).empty_table()


def _cut(docs: pa.Table, known: pa.Table, width: int) -> pa.Table:
    """Each row with its number of words, how many are removed and the words kept."""
    lowest = np.iinfo(np.int64).min  # a smaller document is elsewhere: every window here is later
    own = _read(known.column("least"), np.int64)
    a = np.concatenate([_read(known.column("k0"), _U), _read(known.column("own0"), _U)])
    b = np.concatenate([_read(known.column("k1"), _U), _read(known.column("own1"), _U)])
    low = np.concatenate([np.full(len(a) - len(own), lowest), own])
    order = np.argsort(a, kind="stable")
    a, b, low = a[order], b[order], low[order]
    most_same = int(np.diff(np.append(np.flatnonzero(_changes([a])), len(a))).max()) if len(a) else 0
    out = []
    for part, ids, valid in _parts(docs) if docs.num_rows else ():
        words = Words(part.column("text"))
        cover = np.zeros(len(words.doc) + 1, np.int32)
        if len(a):
            starts = window_starts(words.doc, width)
            k0 = phrases(words.names(), width)[starts]
            at = np.searchsorted(a, k0)
            hit = (a[np.minimum(at, len(a) - 1)] == k0) & valid[words.doc[starts]]
            starts, k0, at = starts[hit], k0[hit], at[hit]
            k1 = _verified(words, starts, width)
            late = np.zeros(len(at), bool)
            for k in range(most_same):  # names that agree in the first 64 bits only
                i = np.minimum(at + k, len(a) - 1)
                late |= (a[i] == k0) & (b[i] == k1) & (low[i] < ids[words.doc[starts]])
            np.add.at(cover, starts[late], 1)
            np.add.at(cover, starts[late] + width, -1)
        gone = np.cumsum(cover[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[words.first[1:]] - total[words.first[:-1]]
        kept = []
        for i, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
            mine = (text or b"").split()
            if removed[i]:
                mine = [mine[k] for k in np.flatnonzero(~gone[words.first[i] : words.first[i + 1]])]
            kept.append(b" ".join(mine))
        columns = (part.column("doc_id"), pa.array(np.diff(words.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()))
        out.append(pa.Table.from_arrays(list(columns), names=["doc_id", "n_words", "n_removed", "kept"]))
    return pa.concat_tables(out) if out else pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())]).empty_table()


def _digest(kept: pa.Table) -> pa.Table:
    return kept.drop_columns("kept").append_column("kept_sha256", pa.array([hashlib.sha256(k).hexdigest() for k in kept.column("kept").to_pylist()], pa.string()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, blocks: int | None = None, digest: bool = False) -> DataFrame:
    """Remove each word covered by a window of ``width`` words that also starts in a document with a smaller id.

    Rows (doc_id, n_words, n_removed, text); with ``digest`` the hex SHA-256 of
    the text as ``kept_sha256`` instead. ``blocks`` is the number of document
    groups and of key buckets. An exchange has up to ``blocks`` squared rows, so
    by default it grows with the root of the text: a row holds a hundred
    signatures or so up to 2 TB of text. Beyond, blocks stay at ``BLOCK_CHARS``
    and rows get shorter, as a block's memory matters more than a row's head.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    unnamed = docs.where("doc_id is null")
    if blocks is None:
        chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
        blocks = max(1, math.ceil(math.sqrt(chars / BLOB_CHARS)), math.ceil(chars / BLOCK_CHARS))
    buckets = blocks
    docs = docs.where("doc_id is not null").withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)).cast("int"))
    signed = docs.groupBy("block").applyInArrow(lambda t: _signed(t, width, buckets), SIGNED)
    shared = signed.groupBy("bucket").applyInArrow(_shared, SHARED)
    named = docs.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(lambda d, s: _named(d, s, width, buckets), NAMED)
    later = named.groupBy("bucket").applyInArrow(_later, LATER)
    out, kind = (_digest, "kept_sha256 string") if digest else (lambda t: t, "kept binary")
    cut = docs.groupBy("block").cogroup(later.groupBy("block")).applyInArrow(lambda d, k: out(_cut(d, k, width)), f"doc_id long, n_words long, n_removed long, {kind}")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from out(_cut(pa.Table.from_batches([batch]), _NONE, width)).to_batches()

    cut = cut.union(unnamed.mapInArrow(whole, cut.schema))
    return cut if digest else cut.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("text"))


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def sql(docs: str = "documents", width: int = WIDTH) -> str:
    """DuckDB SQL for the digests of a table (doc_id, text) with one row per doc_id."""
    return f"""
WITH split AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM {docs}),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM split),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM split WHERE len(w) >= {width}),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {width - 1}], ' ')) AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS d FROM windows GROUP BY k HAVING min(doc_id) < max(doc_id)),
covered AS (SELECT DISTINCT v.doc_id, v.i + j AS p FROM windows v JOIN firsts f ON f.k = v.k AND f.d < v.doc_id, range({width}) r(j)),
kept AS (SELECT a.doc_id, count(*) AS n, count(c.p) AS gone, coalesce(string_agg(a.word, ' ' ORDER BY a.p) FILTER (WHERE c.p IS NULL), '') AS t FROM words a LEFT JOIN covered c ON c.doc_id = a.doc_id AND c.p = a.p GROUP BY a.doc_id)
SELECT s.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id"""


QUERIES = {"op10_recompression": op10_recompression}
SQL = {"op10_recompression": sql()}
