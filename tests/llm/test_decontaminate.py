import random
from collections import Counter

import numpy as np

from sessionflow.llm import decontaminate as d

RNG = random.Random(5)
VOCAB = ["the", "of", "and", "to", "in"] * 40 + ["".join(RNG.choices("abcdefgh", k=5)) for _ in range(400)]


def prose(n, rng):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def brute(docs, items):
    """(doc, item) pairs by full scoring of every passage and the same verification."""
    words = {i: d.tokens(t) for i, t in items}
    words = {i: w for i, w in words.items() if w}
    frequency = {}
    for w in words.values():
        for t in set(w):
            frequency[t] = frequency.get(t, 0) + 1
    n, mean = len(words), sum(map(len, words.values())) / max(1, len(words))
    longest = max(map(len, words.values()), default=1)
    passage = max(64, 2 * longest)
    out = set()
    for doc, text in docs:
        body = d.tokens(text)
        for first in range(0, max(1, len(body)), passage // 2):
            have = body[first : first + passage]
            for i, w in words.items():
                weight = {}
                for t in set(w):
                    import math

                    tf, df = w.count(t), frequency[t]
                    weight[t] = math.log1p((n - df + 0.5) / (df + 0.5)) * tf * (d.K1 + 1) / (tf + d.K1 * (1 - d.B + d.B * len(w) / mean))
                score = sum(x for t, x in weight.items() if t in have) / sum(weight.values())
                if score < d.THRESHOLD:
                    continue
                ok = True
                for part in map(d.shingles, d.question_answer(dict(items)[i])):
                    k = len(next(iter(part))) if part else 0
                    there = {tuple(have[j : j + k]) for j in range(len(have) - k + 1)}
                    ok &= not part or len(part & there) / len(part) >= d.OVERLAP
                if ok:
                    out.add((doc, i))
    return out


def cases():
    rng = random.Random(9)
    items = [(i, ". ".join([prose(rng.randrange(8, 25), rng), prose(rng.randrange(3, 12), rng)])) for i in range(60)] + [(100, None), (101, ""), (102, "!!!"), (103, "tiny item"), (104, "tiny item")]
    docs = [(i, prose(rng.randrange(0, 400), rng)) for i in range(40)] + [(50, None), (51, ""), (None, prose(90, rng) + " " + items[3][1])]
    for k in range(20):
        it = items[k][1]
        docs.append((60 + k, prose(rng.randrange(200), rng) + " " + (it.upper() if k % 3 == 0 else it if k % 3 == 1 else it.replace(" ", "\n", 3)) + ", " + prose(rng.randrange(200), rng)))
    for k in range(20, 26):  # two thirds of the words replaced: not a copy
        w = items[k][1].split()
        docs.append((90 + k, " ".join(x if j % 3 == 0 else "other" for j, x in enumerate(w))))
    docs.append((200, "so a tiny item here"))
    docs.append((200, "so a tiny item here"))
    docs.append((201, prose(5000, rng) + " " + items[30][1] + " " + prose(5000, rng)))
    return docs, items


def test_matches_brute_force(spark):
    docs, items = cases()
    a = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    found = d.contaminated(a, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    assert {(60 + k, k) for k in range(20)} | {(200, 103), (200, 104), (201, 30), (None, 3)} <= want
    assert sum((r["doc_id"], r["item_id"]) == (200, 103) for r in found) == 2
    sharded = d.contaminated(a, b, shard_bytes=400).collect()
    assert {(r["doc_id"], r["item_id"]) for r in sharded} == want


def test_findings_do_not_hang_on_shards(spark):
    """A question and answer a hundred words apart lie in one passage because of a long item in another shard."""
    rng = random.Random(3)
    words = [f"q{i}" for i in range(8)], [f"a{i}" for i in range(8)]
    items = [(1, f"{' '.join(words[0])}. {' '.join(words[1])}."), (2, " ".join(f"long{i}" for i in range(200)))]
    docs = [(1, f"{' '.join(words[0])} {prose(100, rng)} {' '.join(words[1])}"), (2, prose(300, rng))]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (d.SHARD_BYTES, 100, 20):
        assert {(r["doc_id"], r["item_id"]) for r in d.contaminated(a, b, shard_bytes=size).collect()} == {(1, 1)} == brute(docs, items)
        assert [r["doc_id"] for r in d.clean(a, b, shard_bytes=size).collect()] == [2]


def index(items, threshold=d.THRESHOLD):
    words = [w for _, t in items if (w := d.tokens(t))]
    return d.Index(items, Counter(w for x in words for w in set(x)), len(words), sum(map(len, words)) / len(words), threshold, max(map(len, words)))


def test_wand_is_exact_and_skips():
    """All items that reach the threshold, with their scores; postings are leapt over without being scored."""
    rng = random.Random(1)
    items = [(i, prose(rng.randrange(5, 40), rng)) for i in range(400)]
    ix, seen = index(items, 0.5), Counter()
    for _ in range(200):
        terms = sorted({ix.vocabulary[w] for w in d.tokens(f"{prose(60, rng)} {items[rng.randrange(400)][1]}") if w in ix.vocabulary})
        score = [0.0] * len(ix.ids)
        for t in terms:
            for i, v in zip(ix.items[t], ix.values[t]):
                score[i] += v
        found = ix.wand(terms, seen)
        assert [i for i, _ in found] == [i for i, s in enumerate(score) if s >= 0.5]
        assert all(abs(s - score[i]) < 1e-12 for i, s in found)
        passage, hit = np.zeros(len(terms), int), [i for i, _ in found]
        assert ix.reachable(passage, np.array(terms), 1)[0] or not hit
    assert seen["skipped"] > seen["scored"] > 0


def test_pivots_skip_postings_of_a_corpus(spark, sf):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    seen = Counter()
    index(items).search([d.tokens(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], seen)
    assert seen["skipped"] > 0 and seen["scored"] > 0


def test_block_bounds_of_frequent_terms(spark):
    """A term in every block counts by its list's maximum, which never hides an item."""
    items = [(i, f"common words here {' '.join(f'w{i}x{j}' for j in range(9))}") for i in range(60)]
    ix = index(items)
    assert ix.frequent.any()
    texts = [d.tokens(t) for _, t in items]
    assert {(t, ix.ids[i]) for t, _, i, _ in ix.search(texts)} >= {(i, i) for i in range(60)}


def test_clean_keeps_whole_rows(spark):
    docs, items = cases()
    a = spark.createDataFrame([(*r, k) for k, r in enumerate(docs)], "doc_id long, text string, item_id int")
    want = [k for k, (i, t) in enumerate(docs) if not brute([(0, t)], items)]
    for size in (d.SHARD_BYTES, 2000):
        kept = d.clean(a, spark.createDataFrame(items, "item_id long, text string"), shard_bytes=size)
        assert sorted(r["item_id"] for r in kept.collect()) == want and kept.columns == a.columns


def test_empty(spark):
    docs = spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(docs, none).collect() == []
    assert d.contaminated(docs.limit(0), spark.createDataFrame([(1, "some text here")], "item_id long, text string")).collect() == []
