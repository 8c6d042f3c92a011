from collections import defaultdict

import pytest

from sessionflow.llm import mixing


def water(sizes):
    """Targets of sources in code point order, null last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * level > 2 * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in free}
        out |= {s: 2.0 * sizes[s] for s in full}
        left, free = left - sum(2 * sizes[s] for s in full), free - full
    return out


ROWS = [(i, "w " * (i % 17), f"src{i % 5}") for i in range(200)] + [(None, "a b c", "src1"), (7, "x y", "src1"), (7, "x y", "src1"), (300, None, "src2"), (301, "", None), (302, "one two", None), (303, "big " * 3000, "z")]


def test_targets_and_takings(spark):
    df = spark.createDataFrame([(*r, 0) for r in ROWS], "doc_id long, text string, source string, taken int")
    rows = mixing.mix(df).collect()
    assert len(rows) == len(ROWS)
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and 0 <= r["position"] <= 1
    want = water(sizes)
    for s in sizes:
        assert targets[s] == pytest.approx(want[s])
        assert taken[s] == int(want[s] + 0.5)


def test_same_on_rerun_and_other_partitioning(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    a = sorted(map(str, mixing.mix(df).collect()))
    assert a == sorted(map(str, mixing.mix(df.repartition(7)).collect()))


def test_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    (row,) = mixing.mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()
    assert (row["size"], row["taken"], row["target"]) == (0, 0, 0.0)


def test_positions_follow_the_schedule(spark):
    """A source whose weight falls comes early, one whose weight rises comes late."""
    rows = [(i, "w " * 10, s) for s in ("a", "b", "c") for i in range(s == "a" and 100 or 100)]
    placed = mixing.mix(spark.createDataFrame([(k, t, s) for k, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")).where("taken > 0").collect()
    mean = {s: sum(r["position"] for r in placed if r["source"] == s) / sum(1 for r in placed if r["source"] == s) for s in ("a", "c")}
    assert mean["a"] < 0.5 < mean["c"]


def test_every_draw_has_a_position(spark):
    """Words per tenth of training and source meet the integrated schedule within one document."""
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 4}") for i in range(4000)], "doc_id long, text string, source string")
    mixed = mixing.mix(df)
    by_doc = defaultdict(list)
    for r in mixing.draws(mixed).collect():
        by_doc[r["doc_id"]].append(r)
    rows = mixed.collect()
    for r in rows:
        own = sorted(by_doc[r["doc_id"]], key=lambda d: d["pass"])
        assert sum(d["taken"] for d in own) == r["taken"] and all(0 < d["taken"] <= r["size"] for d in own)
        assert [d["position"] for d in own] == sorted(d["position"] for d in own) and (not own or own[0]["position"] == r["position"])
    assert max(map(len, by_doc.values())) == 2
    targets = {r["source"]: r["target"] for r in rows}
    for n, s in enumerate(sorted(targets)):
        start, end = mixing.SCHEDULE[n % 3]
        for tenth in range(1, 11):
            t = tenth / 10
            want = targets[s] * (start * t + (end - start) * t * t / 2) / ((start + end) / 2)
            assert sum(d["taken"] for own in by_doc.values() for d in own if d["source"] == s and d["position"] <= t) == pytest.approx(want, abs=8)


def test_null_ids_are_placed_by_their_texts(spark):
    df = spark.createDataFrame([(None, f"w{i} x", "a") for i in range(50)], "doc_id long, text string, source string")
    assert len({r["position"] for r in mixing.mix(df).collect()}) == 50


def test_offsets_of_many_buckets(spark):
    """Two levels of prefix sums equal one running sum, also for a null source and a single digit."""
    for digits in (1, 3, 4):
        names = [f"{i * 7919 % 16**digits:0{digits}x}" for i in range(min(16**digits, 700))]
        rows = [(s, b, 1 + (i * 31) % 17) for s in ("a", "b", None) for i, b in enumerate(names) if i % 3 or s]
        got = {(r["s"], r["b"]): r["offset"] for r in mixing._offsets(spark.createDataFrame(rows, "source string, bucket string, bucket_size long"), digits).collect()}
        want, run = {}, {}
        for s, b, size in sorted(rows, key=lambda r: (r[0] or "", r[1])):
            want[s, b] = run.get(s, 0)
            run[s] = want[s, b] + size
        assert got == want
