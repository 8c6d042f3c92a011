import random

import duckdb
import pytest

from sessionflow.llm import lines


def brute(rows, k):
    """Texts after deleting later copies; rows equal in id and text are one document."""
    docs = sorted({(i is None, i or 0, t) for i, t in rows if t is not None}, key=lambda d: d[:2])
    seqs = [[(n, x) for n, x in enumerate(t.split("\n")) if x.strip(" \t\n\v\f\r")] for _, _, t in docs]
    seen, out = set(), {}
    for d, s in zip(docs, seqs):
        gone = set()
        for j in range(len(s) - k + 1):
            key = tuple(x for _, x in s[j : j + k])
            if key in seen:
                gone |= {n for n, _ in s[j : j + k]}
            seen.add(key)
        out[d] = "\n".join(x for n, x in enumerate(d[2].split("\n")) if n not in gone)
    return [(i, t if t is None else out[i is None, i or 0, t]) for i, t in rows]


RUN = "first line\nsecond line\nthird line\nfourth line"
ROWS = [
    (1, f"head\n{RUN}\ntail"), (2, f"{RUN}\nother"), (3, "second line\n\n \nthird line\nnew"), (4, None), (5, ""), (6, "\n\n"), (7, "same\nsame\nsame\nsame"), (8, "alone"), (9, "alone"),
    (2, f"{RUN}\nother"), (None, f"x\n{RUN}"), (10, "\n".join(f"l{i}" for i in range(2000))), (11, "\n".join(f"l{i}" for i in range(1500, 1600))), (12, "É\r\nü\r\n"), (13, "É\r\nü\r\n"),
]


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
def test_matches_brute_force(spark, k):
    df = spark.createDataFrame([(i, t, 0, "line") for i, t in ROWS], "doc_id long, text string, seq int, line string")
    done = lines.dedup_lines(df, min_lines=k)
    assert done.columns == ["doc_id", "text", "seq", "line", "_n_lines", "_n_removed"]
    assert sorted(((r["doc_id"], r["text"]) for r in done.collect()), key=str) == sorted(brute(ROWS, k), key=str)


def test_columns_of_the_operators_own_names_stay(spark):
    df = spark.createDataFrame([(1, "a\nb", 7, 8, "x"), (2, "a\nb", 9, 10, "y")], "doc_id long, text string, _id int, _n_lines int, _lines string")
    rows = lines.dedup_lines(df).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(1, "a\nb", 7, 8, "x", 2, 0), (2, "", 9, 10, "y", 2, 2)]


def test_empty(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("k", [1, 2, 3])
def test_sql_says_the_same(spark, sf, k):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = dict(c.execute(lines.sql(min_lines=k, select="SELECT doc_id, text FROM kept")).fetchall())
    got = lines.dedup_lines(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), min_lines=k).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want


def brute_runs(rows, k):
    """(id, line, length, original id, original line) of maximal repeated runs of k lines or more."""
    docs = sorted({(i is None, i or 0, t) for i, t in rows if t is not None}, key=lambda d: d[:2])
    seqs = [[(n, x) for n, x in enumerate(t.split("\n")) if x.strip(" \t\n\v\f\r")] for _, _, t in docs]
    places = [(d, j) for d, s in enumerate(seqs) for j in range(len(s))]

    def common(a, b):
        (d, i), (e, j), n = a, b, 0
        while i + n < len(seqs[d]) and j + n < len(seqs[e]) and seqs[d][i + n][1] == seqs[e][j + n][1]:
            n += 1
        return n

    out, last = set(), (None, 0, 0)
    for at, p in enumerate(places):
        found = [(common(p, q), -b) for b, q in enumerate(places[:at])]
        length, b = max(found, default=(0, 0))
        if length >= k and not (last[0] == p[0] and last[1] == p[1] - 1 and last[2] > length):
            (d, i), (e, j) = p, places[-b]
            ident = lambda x: None if docs[x][0] else docs[x][1]
            out.add((ident(d), seqs[d][i][0], length, ident(e), seqs[e][j][0]))
        last = (*p, length)
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_maximal_runs_match_brute_force(spark, k):
    rng = random.Random(k)
    rows = [(1, f"head\n{RUN}\ntail"), (2, f"{RUN}\nother\n{RUN}"), (7, "same\n" * 9), (12, "\n".join(f"l{i}" for i in range(70))), (13, "x\n" + "\n\n".join(f"l{i}" for i in range(5, 64)) + "\ny"), (None, f"x\n{RUN}"), (14, None), (15, "")]
    rows += [(20 + i, "\n".join(rng.choice("abc") for _ in range(rng.randrange(25)))) for i in range(12)]
    got = lines.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), min_lines=k).collect()
    assert {(r["doc_id"], r["line"], r["length"], r["original_id"], r["original_line"]) for r in got} == brute_runs(rows, k) and len(got) == len(brute_runs(rows, k))


def test_ranks_are_the_order_of_suffixes(spark):
    rows = [(1, "b\na\nb\na\nb\nc"), (2, "a\nb\na\nb"), (3, "c\nb\na")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = lines.line_ids(df).collect()
    name = {(r["doc_id"], r["seq"]): bytes(r["name"]) for r in ids}
    for k, level in enumerate(lines.suffix_ranks(lines.line_ids(df))):
        got = level.collect()
        keys = {(r["doc_id"], r["seq"]): tuple(name[r["doc_id"], r["seq"] + j] for j in range(1 << k)) for r in got}
        order = sorted(set(keys.values()))
        assert all(r["rank"] == order.index(keys[r["doc_id"], r["seq"]]) for r in got)
