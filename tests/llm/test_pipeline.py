import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline as pipeline
from sessionflow.llm import decontaminate, lines, mixing, quality, queries, simhash

from .test_decontaminate import brute as leaks
from .test_similar import brute_firsts


def test_stages_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    out = {}
    for (name, stage), check in zip(pipeline.STAGES, (rejects, line_runs, one_of_each, no_leaks, mixed)):
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, sf).cache()
        check(spark, sf, before, out.setdefault(name, docs.collect()))
        assert name == pipeline.STAGES[-1][0] or docs.columns == columns
    final = pipeline.run(spark, sf)
    assert sorted(map(str, final.collect())) == sorted(map(str, out[pipeline.STAGES[-1][0]]))


def rejects(spark, sf, before, after):
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    ok = {i for i, r in before.items() if quality.score_rows(model, quality.features(pa.array([r["text"]])))[0] >= 0.7}
    assert {r["doc_id"] for r in after} == ok and 0 < len(ok) < len(before)


def line_runs(spark, sf, before, after):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [(i, r["text"]) for i, r in before.items()])
    want = dict(c.execute(lines.sql(min_words=lines.MIN_WORDS, select="SELECT doc_id, text FROM kept")).fetchall())
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] != before[r["doc_id"]]["text"])


def one_of_each(spark, sf, before, after):
    want = brute_firsts([(i, r["text"]) for i, r in before.items()])
    assert {r["doc_id"] for r in after} == want and len(after) == len(want)


def no_leaks(spark, sf, before, after):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    gone = {d for d, _ in leaks([(i, r["text"]) for i, r in before.items()], items)}
    assert {r["doc_id"] for r in after} == set(before) - gone


def mixed(spark, sf, before, after):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, r["text"], r["source"]) for i, r in before.items()])
    want = {r[0]: r[4:] for r in c.execute(mixing.sql()).fetchall() if r[4]}
    drawn = {}
    for r in after:  # in the order of training
        drawn.setdefault(r["doc_id"], []).append(r)
    assert {i: sum(r["taken"] for r in own) for i, own in drawn.items()} == {i: r[0] for i, r in want.items()}
    assert all([r["position"] for r in own] == pytest.approx([p for p in want[i][1:] if p is not None]) for i, own in drawn.items()) and max(map(len, drawn.values())) == 2
    assert [r["position"] for r in after] == sorted(r["position"] for r in after)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {q for q in queries.queries()} <= names and "pipeline" in names
    assert sorted(int(q[2:].split("_")[0]) for q in names if q.startswith("op")) == list(range(1, 14))
    assert set(entry.oracle_sql()) <= names
    assert simhash.BITS == 64 and decontaminate.SHINGLE == 5
