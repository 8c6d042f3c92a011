import random

import duckdb

from pyspark.sql import functions as F

from sessionflow.llm import fixity


def rows(n=300):
    rng = random.Random(2)
    return [(i, f"http://h/{i}", "x" * rng.randrange(400) + str(i)) for i in range(n)]


def frame(spark, pages):
    return spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, node int")


def found(spark, ours, theirs, **options):
    return {(r["file_no"], r["record_offset"]): r["state"] for r in fixity.audit(ours, theirs, **options).collect()}


def test_locates_changed_missing_and_extra(spark):
    records = fixity.placed(fixity.digests(frame(spark, rows()), F.sha2(F.upper("record"), 256).alias("other"), file_records=64))
    ours = records.drop("other")
    place = {r["page_id"]: (r["file_no"], r["record_offset"]) for r in records.collect()}
    changed = {3, 64, 299}
    gone = {7, 200}
    digest = F.when(F.col("page_id").isin(*changed), F.col("other")).otherwise(F.col("digest"))
    other = records.where(~F.col("page_id").isin(*gone)).select("file_no", "record_offset", "length", digest.alias("digest"))
    extra = spark.createDataFrame([(1, 999_999, 3, "d")], "file_no long, record_offset long, length long, digest string")
    want = {place[i]: "changed" for i in changed} | {place[i]: "missing" for i in gone} | {(1, 999_999): "extra"}
    for options in ({}, {"range_bytes": 512, "fanout": 2}, {"range_bytes": 1 << 30}):
        assert found(spark, ours, other.union(extra), **options) == want


def test_equal_replicas_and_empty_ones(spark):
    ours = fixity.placed(fixity.digests(frame(spark, rows(50))))
    assert found(spark, ours, ours) == {}
    none = ours.limit(0)
    assert found(spark, none, none) == {}
    assert set(found(spark, ours, none).values()) == {"missing"} and len(found(spark, ours, none)) == 50
    assert set(found(spark, none, ours).values()) == {"extra"}


def test_nulls_and_repeats(spark):
    pages = [(None, None, None), (None, "u", "h"), (1, None, "h"), (1, None, "h"), (2, "u", None), (3, "u", ""), (-5, "u", "negative"), (4, "u", "é" * 3000)]
    records = fixity.placed(fixity.digests(frame(spark, pages)))
    assert records.count() == len(pages) and records.select("file_no", "record_offset").distinct().count() == len(pages)
    ours = records
    assert found(spark, ours, ours) == {}
    assert len(found(spark, ours, ours.where("length > 6000 is not true"))) == len(found(spark, ours, ours.where("length <= 6000")))
    assert len(found(spark, ours, ours.limit(0))) == len(pages)


def test_sql_says_the_same_of_null_and_negative_ids(spark):
    pages = [*rows(120), *((None, f"n{i}", "h" * i) for i in range(40)), (None, "n1", "h"), (-5, "u", "a"), (-2000, "u", "b"), (-92, None, "eee"), (102, "again", "e")]
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    rel = c.execute(fixity.SQL["op8_merkle_audit"])
    names = [d[0] for d in rel.description]
    got = fixity.damaged_replica_audit(spark.createDataFrame(pages, "page_id long, url string, html string")).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rel.fetchall(), key=str)
    placed = fixity.placed(fixity.digests(spark.createDataFrame(pages, "page_id long, url string, html string")).where("page_id is null"))
    assert placed.select("file_no").distinct().count() == 40  # equal records share a file
