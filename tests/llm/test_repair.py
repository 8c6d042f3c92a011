import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from sessionflow.llm import repair

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def brute(rows):
    """(cost, audit, turns) for rows (role, text, fault): ways by falling preference from a heap, the pattern asked at the end only."""
    heap, most = [(0, "", 0, ())], 2 * len(rows) + 3
    while True:
        cost, audit, i, turns = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)):
            return cost, audit, turns
        if len(audit) < most:
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 3, audit + "I", i, turns + ((role, ""),)))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, turns))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, turns + ((role, text),)))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, turns + ((new, text),)))


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range(0 if kind == 0 else 2 if kind == 3 else 1):
            yield conv, turn, "user" if kind == 4 else role, text


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    """The report on conversation rows, by brute force."""
    convs = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in damage(rows):
        convs[conv].append((turn, role, text))
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0], r[1], sha(f"{len(r[1].encode())}:{r[1]}{r[2]}")))
        seen, marked = set(), []
        for _, role, text in own:
            body = text.strip(" \t\n\v\f\r")
            marked.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit, out = brute(marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        yield (conv, gaps, *(sum(f == k for *_, f in marked) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out)))


def reported(spark, rows):
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, content string, fault int")
    return [tuple(r[c] for c in COLUMNS) for r in repair.report(repair.damaged(df), df).collect()]


def test_integer_weights_match_brute_force():
    rng, faults = random.Random(4), {"": repair.SOUND, "blank": repair.BLANK, "duplicate": repair.DUPLICATE, "truncated": repair.TRUNCATED}
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), "t.", rng.choice(["", "", "", *faults])) for _ in range(rng.randrange(6))]
        cost, audit, _ = brute(rows)
        assert repair.cheapest([(r[:1], faults[f]) for r, _, f in rows]) == (cost, audit), rows


def test_long_conversations():
    rows = [("ua"[i % 2], repair.SOUND) for i in range(3000)]
    assert repair.cheapest(rows) == (0, "K" * 3000)
    assert repair.cheapest([("u", repair.SOUND)] * 400) == (600, "KR" * 200)
    assert repair.cheapest([("x", repair.BLANK)] * 500) == (2000, "D" * 500)
    assert repair.cheapest([]) == (0, "")


def test_report_matches_brute_force(spark):
    rng = random.Random(8)
    texts = ["Well.", "Why?", "cut", "", "  \n", "a. b", None, "Well. \x0b", "tail ", "é!"]
    rows = [(c, None if rng.random() < 0.1 else t + (t > 2), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for c in [*range(60), None] for t in range(rng.randrange(1, 6))]
    rows += [(900, 1, "user", "Same."), (900, 1, "user", "Same."), (900, 1, "assistant", "Same."), (901, None, "user", "x"), (901, None, "user", "y")]
    assert sorted(reported(spark, rows), key=str) == sorted(plain(rows), key=str)


def test_everything_dropped_and_empty_tables(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert reported(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", sha(""))]
    assert reported(spark, []) == []


def test_repaired_turns_keep_their_texts(spark):
    df = spark.createDataFrame([(1, 0, "system", "Be."), (1, 1, "assistant", "A."), (1, 2, "assistant", "B."), (2, 0, "user", "")], "conv_id long, turn long, role string, text string")
    marks = repair.marked(df)
    found = repair.verdicts(marks)
    assert {(r["conv_id"], r["cost"], r["audit"]) for r in found.collect()} == {(1, 3, "KRK"), (2, 4, "D")}
    assert [tuple(r) for r in repair.repaired(marks, found).collect()] == [(1, 0, "system", "Be."), (1, 1, "user", "A."), (1, 2, "assistant", "B.")]


@pytest.mark.parametrize("partitions", [1, 4])
def test_query_matches_sql(spark, sf, partitions):
    c = duckdb.connect()
    rows = spark.read.parquet(f"{sf}/conversations.parquet").repartition(partitions)
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    rel = c.execute(repair.SQL["op13_turn_repair"])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(COLUMNS)
    want = sorted(str(tuple(r[names.index(n)] for n in COLUMNS)) for r in rel.fetchall())
    assert sorted(str(tuple(r[n] for n in COLUMNS)) for r in repair.report(repair.damaged(rows), rows).collect()) == want
