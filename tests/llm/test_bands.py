"""The candidates of the pipeline's near-duplicate stage."""

import numpy as np

from sessionflow.llm import simhash


def test_pipeline_candidates_come_from_simhash_bits(spark):
    """The stage's bands are bits of SimHash fingerprints: a pair differs in the share of bits that its angle says, and pairs of 0.8 all meet."""
    rng = np.random.default_rng(2)
    bands, bits = simhash.bands_of(600)
    sets = [np.unique(rng.integers(0, 1 << 63, 360).astype(np.uint64)) for _ in range(300)]
    near = [np.unique(np.concatenate([s[:320], rng.integers(0, 1 << 63, 40).astype(np.uint64)])) for s in sets]  # 320 of 400 in common
    a, b = (simhash.long_fingerprints(x, simhash.BESIDE + bands * bits) for x in (sets, near))
    assert abs((a != b).mean() - np.arccos(320 / 360) / np.pi) < 0.005 and abs((a[1:] != a[:-1]).mean() - 0.5) < 0.005
    plain = (a[:, simhash.BESIDE:] == b[:, simhash.BESIDE:]).reshape(300, bands, bits).all(axis=2)
    assert plain.any(axis=1).all()
    rows = [(i, h, " ".join(f"{i}w{j}{'x' if h and j == 9 else ''}" for j in range(80))) for i in range(20) for h in (0, 1)]
    marks = simhash._marks(spark.createDataFrame(rows, "doc_id long, text_hash long, text string"), 5, bands, bits)
    met = simhash.near_buckets(marks.select("v", "fp", "fq", "keys")).join(marks.select("v", "doc_id"), "v").groupBy("key").agg({"doc_id": "min", "*": "count"}).collect()
    assert sorted(r["min(doc_id)"] for r in met) == list(range(20)) and all(r["count(1)"] == 2 for r in met)
