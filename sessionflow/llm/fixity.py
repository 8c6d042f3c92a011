"""WARC fixity audit with Merkle trees.

Records lie at offsets in numbered files. A leaf covers a fixed range of
offsets and hashes the digests of its records in order; a node hashes its
children in order. Two replicas are compared from the root: only where node
hashes differ are the children looked at, so the records of intact ranges are
never compared.

Defined cases: a null url or html is an empty field; a null page_id goes to one
of 16**5 files of its own, with negative numbers, by a digest of its content; repeated records take
offsets of their own; a replica may lack records or hold others at further
offsets; with an empty replica every record of the other differs; two empty
ones give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Pages per WARC file, bytes per leaf range, children per node.
FILE_RECORDS, RANGE_BYTES, FANOUT = 1024, 1 << 16, 32


def record(url: Column, html: Column) -> Column:
    """The bytes (as text) of a response record."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))


def digests(pages: DataFrame, *more: Column, file_records: int = FILE_RECORDS) -> DataFrame:
    """Rows (file_no, page_id, length, digest, *more) of the pages' records; ``more`` may use the column ``record``.

    Records are hashed where they are read; only digests move from here on.
    """
    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), record(F.col("url"), F.col("html")).alias("record"))
    none = -1 - F.conv(F.substring(F.md5("record"), 1, 5), 16, 10).cast("long")
    number = F.coalesce(F.floor(F.col("page_id") / file_records).cast("long"), none)
    return kept.select(number.alias("file_no"), "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), *more)


def placed(digested: DataFrame) -> DataFrame:
    """``digested`` with record_offset: its records laid out in each file in the order of page_id, then digest."""
    before = Window.partitionBy("file_no").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return digested.withColumn("record_offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def _node(order: str) -> Column:
    """The hash over (position, hash) of the children in order."""
    children = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("digest").alias("d"))))
    return F.sha2(F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["at"].cast("string"), c["d"])), ","), 256)


def _up(level: DataFrame, fanout: int) -> DataFrame:
    up = level.select("replica", "file_no", F.floor(F.col("node") / fanout).cast("long").alias("up"), "node", "digest")
    return materialize(up.groupBy("replica", "file_no", F.col("up").alias("node")).agg(_node("node").alias("digest")))


def trees(records: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels, leaves first, of the trees within files and of the tree over files, for all replicas in ``records``.

    Rows of a level: replica, file_no (zero over files), node, digest. Over
    files the first level's nodes are the file numbers, folded to be positive.
    """
    at = F.floor(F.col("record_offset") / range_bytes).cast("long").alias("node")
    leaves = records.select("replica", "file_no", at, "record_offset", "digest").groupBy("replica", "file_no", "node").agg(_node("record_offset").alias("digest"))
    files = [materialize(leaves)]
    while (files[-1].agg(F.max("node").alias("m")).first()["m"] or 0) > 0:
        files.append(_up(files[-1], fanout))
    n = F.col("file_no")
    over = [files[-1].select("replica", F.lit(0).cast("long").alias("file_no"), F.when(n >= 0, n * 2).otherwise(n * -2 - 1).alias("node"), "digest")]
    while (over[-1].agg(F.max("node").alias("m")).first()["m"] or 0) > 0:
        over.append(_up(over[-1], fanout))
    return files, over


def _differing(level: DataFrame, inside: DataFrame | None) -> DataFrame:
    """(file_no, node) whose digests differ between replicas a and b, only below the parents ``inside`` (file_no, up)."""
    if inside is not None:
        level = level.join(inside, ["file_no", "up"], "left_semi")
    found = level.groupBy("file_no", "node").agg((F.count("*") == 2).alias("both"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    return found.where("not both or low <> high").select("file_no", "node")


def audit(ours: DataFrame, theirs: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Rows (file_no, record_offset, length, state, expected, found) of records that differ between two replicas.

    ``state`` is ``changed``, ``missing`` (only in ours) or ``extra``; the inputs have file_no, record_offset, length, digest.
    """
    columns = ("file_no", "record_offset", "length", "digest")
    both = materialize(ours.select(*columns).withColumn("replica", F.lit("a")).union(theirs.select(*columns).withColumn("replica", F.lit("b"))))
    files, over = trees(both, range_bytes, fanout)
    up = F.floor(F.col("node") / fanout).cast("long")
    inside = None
    for level in reversed(over):
        inside = materialize(_differing(level.withColumn("up", up), inside).select("file_no", F.col("node").alias("up")))
    n = F.col("up")  # the differing file numbers, unfolded
    inside = inside.select(F.when(n % 2 == 0, F.floor(n / 2)).otherwise(-F.floor((n + 1) / 2)).cast("long").alias("file_no"), F.lit(0).cast("long").alias("up"))
    for level in reversed(files):
        inside = materialize(_differing(level.withColumn("up", up), inside).select("file_no", F.col("node").alias("up")))
    suspects = both.withColumn("up", F.floor(F.col("record_offset") / range_bytes).cast("long")).join(inside, ["file_no", "up"], "left_semi")
    side = lambda r, names: suspects.where(F.col("replica") == r).select("file_no", "record_offset", *(F.col(c).alias(n) for c, n in names.items()))
    compared = side("a", {"length": "length_a", "digest": "expected"}).join(side("b", {"length": "length_b", "digest": "found"}), ["file_no", "record_offset"], "full").where(~F.col("expected").eqNullSafe(F.col("found")))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("changed")
    return compared.select("file_no", "record_offset", F.coalesce("length_a", "length_b").alias("length"), state.alias("state"), "expected", "found")


def damaged_replica_audit(pages: DataFrame) -> DataFrame:
    """Audit a replica of all pages in which some records were altered and some lost."""
    altered = F.when(F.col("page_id") % 97 == 5, F.translate("record", "e", "3")).otherwise(F.col("record"))
    records = materialize(placed(digests(pages, F.sha2(altered, 256).alias("other"))))
    replica = records.where(F.coalesce(F.col("page_id") % 211 != 7, F.lit(True))).select("file_no", "record_offset", "length", F.col("other").alias("digest"))
    return audit(records, replica)


def op8_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_replica_audit(table(spark, sf_dir, "pages"))


def _sql() -> str:
    number = f"coalesce(floor(page_id / {FILE_RECORDS}.0)::BIGINT, -1 - ('0x' || substr(md5(record), 1, 5))::BIGINT)"
    return f"""
WITH records AS (
  SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, ''))::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages
), placed AS (
  SELECT page_id, {number} AS file_no, record, strlen(record)::BIGINT AS length,
    coalesce(sum(strlen(record)) OVER (PARTITION BY {number} ORDER BY page_id NULLS FIRST, sha256(record) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS record_offset
  FROM records
), compared AS (
  SELECT *, CASE WHEN page_id % 211 = 7 THEN NULL WHEN page_id % 97 = 5 THEN replace(record, 'e', '3') ELSE record END AS other FROM placed
)
SELECT file_no, record_offset, length, CASE WHEN other IS NULL THEN 'missing' ELSE 'changed' END AS state, sha256(record) AS expected, sha256(other) AS found
FROM compared WHERE other IS DISTINCT FROM record"""


QUERIES = {"op8_merkle_audit": op8_merkle_audit}
SQL = {"op8_merkle_audit": _sql()}
