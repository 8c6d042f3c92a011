"""Sharding by fixed virtual slots.

A record's key is hashed into one of ``SLOTS`` slots, once and for all; bytes
are added up per slot, and a versioned map, written in the shared folder, says
which shard holds each slot. Packing puts the heaviest slots first into the
emptiest shard, so the law that holds is ``bytes``: shard sizes near equal.
Rebalancing makes a new version of the map by moving single slots; records of
all others stay where they are.

The key is the document's id and its copy number: rows of one id are counted
up within an input partition, so an id that a third of all rows bear (or that
is null) is dealt over many slots instead of one. Only per-slot totals (at
most ``SLOTS`` rows) are ever gathered or broadcast; positions within a shard
come from the slots' offsets and a window per slot. All of it is DataFrame
functions.

Defined cases: a null text has no bytes and the CRC of no bytes; the size is
never below ``OVERHEAD``; repeated rows are records of their own, told apart by
their count only; a null id has keys of its own; a document larger than a
shard's share fills a shard as far as it must; with fewer slots in use than
shards some shards are empty; an empty table gives an empty result and an
empty map.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table

SHARDS, SLOTS, OVERHEAD = 40, 8192, 16


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, copy, virtual_slot); texts are read once and not moved."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.spark_partition_id().alias("part"))
    own = Window.partitionBy("part", "doc_id").orderBy("text_crc32", "size")
    counted = read.withColumn("copy", F.row_number().over(own) - 1)
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string"))
    slot = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % slots
    return counted.select("doc_id", "size", "text_crc32", "copy", slot.cast("int").alias("virtual_slot"))


def slot_totals(placed: DataFrame) -> DataFrame:
    """Rows (virtual_slot, bytes, records), one per slot in use."""
    return placed.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))


def _emptiest(loads: Column) -> Column:
    """The first shard (from 0) of the least load."""
    return (F.array_position(loads, F.array_min(loads)) - 1).cast("int")


def _plus(loads: Column, shard: Column, size: Column) -> Column:
    return F.transform(loads, lambda v, i: F.when(i == shard, v + size).otherwise(v))


def _folded(slots: DataFrame, start: Column, step) -> DataFrame:
    """Slots (virtual_slot, bytes, records, shard), heaviest first, through ``step(loads, slot) -> shard``; loads begin with ``start``."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("weight"), "virtual_slot", "records", "shard")))

    def add(state: Column, slot: Column) -> Column:
        to = step(state["loads"], slot)
        loads = _plus(_plus(state["loads"], slot["shard"], slot["weight"]), to, -slot["weight"])  # out of its shard (-1: none) and into the other
        return F.struct(loads.alias("loads"), F.concat(state["to"], F.array(to)).alias("to"))

    gathered = slots.agg(order.alias("slots"), start.alias("start"))  # at most as many entries as there are slots
    folded = gathered.select("slots", F.aggregate("slots", F.struct(F.col("start").alias("loads"), F.array().cast("array<int>").alias("to")), add)["to"].alias("to"))
    each = folded.select(F.explode(F.arrays_zip("slots", "to")).alias("s"))
    return each.select("s.slots.virtual_slot", (-F.col("s.slots.weight")).alias("bytes"), "s.slots.records", F.col("s.to").alias("shard"))


def packed(totals: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A first map: (virtual_slot, bytes, records, shard)."""
    none = totals.withColumn("shard", F.lit(-1))
    return _folded(none, F.array_repeat(F.lit(0).cast("long"), F.lit(shards)), lambda loads, slot: _emptiest(loads))


def rebalanced(current: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """The map edited for new totals or another number of shards.

    A slot moves, to the emptiest shard, only from a shard that is taken away or
    that keeps its fair share without it; new slots go to the emptiest shard.
    All others keep their shard, so one more shard takes slots only into itself.
    """
    known = totals.join(F.broadcast(current.select("virtual_slot", "shard")), "virtual_slot", "left")
    slots = known.withColumn("shard", F.when(F.col("shard") < shards, F.col("shard")).otherwise(F.lit(-1)))
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.aggregate(F.filter(F.collect_list(F.struct("shard", "bytes")), lambda s: s["shard"] == i), F.lit(0).cast("long"), lambda a, s: a + s["bytes"]))

    def step(held: Column, slot: Column) -> Column:
        fair, size = F.aggregate(held, F.lit(0).cast("long"), lambda a, v: a + v) / shards, -slot["weight"]
        own = F.element_at(held, F.greatest(slot["shard"], F.lit(0)) + 1)
        stays = (slot["shard"] >= 0) & (own - size < fair)
        return F.when(stays, slot["shard"]).otherwise(_emptiest(held))

    return _folded(slots, loads, step)


def publish(slot_map: DataFrame, path: str, version: int) -> DataFrame:
    """Write ``slot_map`` as a version of the map stored under ``path``, and read it back."""
    slot_map.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")
    return stored(slot_map.sparkSession, path, version)


def stored(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map under ``path``, the latest if none is named: (virtual_slot, bytes, records, shard, version)."""
    every = spark.read.parquet(path)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == version)


def assigned(placed: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``placed`` with shard and slot: the record's position in its shard, gapless from 0, by virtual slot, id and copy."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("records").over(before), F.lit(0)).cast("long").alias("first"))
    inside = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_first(), "copy", "text_crc32", "size")
    return placed.withColumn("at", F.row_number().over(inside)).join(F.broadcast(offsets), "virtual_slot").withColumn("slot", (F.col("first") + F.col("at") - 1).cast("long")).drop("at", "first")


def op12_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = materialize(records(table(spark, sf_dir, "documents")))
    slot_map = publish(packed(slot_totals(placed)), f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}", 0)
    out = assigned(placed, slot_map)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def _sql() -> str:
    poly, half = 0xEDB88320, []
    for i in range(16):  # the CRC-32 of each half byte
        for _ in range(4):
            i = (i >> 1) ^ (poly if i & 1 else 0)
        half.append(i)
    nibble = lambda a: f"xor({a} >> 4, [{', '.join(map(str, half))}][({a} & 15) + 1])"
    return f"""
WITH RECURSIVE sized AS MATERIALIZED (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + {OVERHEAD} AS size, (('0x' || substr(md5(doc_id::VARCHAR || ':0'), 1, 8))::BIGINT % {SLOTS})::INT AS virtual_slot,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0], lambda a, i: {nibble("a")})) AS crc
  FROM documents
), slots AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS turn FROM (SELECT virtual_slot, sum(size)::BIGINT AS bytes, count(*) AS records FROM sized GROUP BY 1)
), packing AS (
  SELECT 0::BIGINT AS turn, list_transform(range({SHARDS}), lambda i: 0::BIGINT) AS loads, NULL::INT AS shard
  UNION ALL
  SELECT s.turn, list_transform(p.loads, lambda v, i: CASE WHEN i = list_position(p.loads, list_min(p.loads)) THEN v + s.bytes ELSE v END), list_position(p.loads, list_min(p.loads))::INT - 1
  FROM packing p JOIN slots s ON s.turn = p.turn + 1
), slot_map AS (
  SELECT s.virtual_slot, p.shard FROM packing p JOIN slots s USING (turn)
)
SELECT doc_id, size, xor(crc, 4294967295)::BIGINT AS text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id) - 1)::BIGINT AS slot, NULL::INT AS grown_shard, virtual_slot
FROM sized JOIN slot_map USING (virtual_slot)"""


QUERIES = {"op12_virtual_slots": op12_virtual_slots}
SQL = {"op12_virtual_slots": _sql()}
