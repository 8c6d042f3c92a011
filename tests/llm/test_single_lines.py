import corpus_pipeline as pipeline
from sessionflow.llm import lines

from .test_lines import brute

PASSAGE = " ".join(f"p{i}" for i in range(30))
SHORT = " ".join(f"s{i}" for i in range(19))
ROWS = [(1, PASSAGE), (2, PASSAGE), (3, f"a b\n{PASSAGE}\nc d"), (4, f"e f\n{SHORT}\ng h"), (5, f"i j\n{SHORT}\nk l"), (6, f"{SHORT}\t t"), (7, f"m\n{SHORT}\t t"), (8, f"\n {PASSAGE}\n"), (9, f"{PASSAGE}\nm\n{PASSAGE}"), (9, f"{PASSAGE}\nm\n{PASSAGE}"), (None, PASSAGE), (10, None)]


def test_copies_of_a_single_long_line_go(spark):
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in ROWS], "doc_id long, text string, n_chars long")
    kept = sorted(((r["doc_id"], r["text"]) for r in pipeline.line_dedup(spark, df, "").collect()), key=str)
    want = [(1, PASSAGE), (2, ""), (3, "a b\nc d"), (4, f"e f\n{SHORT}\ng h"), (5, f"i j\n{SHORT}\nk l"), (6, f"{SHORT}\t t"), (7, "m"), (8, f"\n {PASSAGE}\n"), (9, "m"), (9, "m"), (None, ""), (10, None)]
    assert kept == sorted(want, key=str)


def test_runs_and_single_lines_together(spark, sf):
    """What goes is what runs of two lines cover and later copies of lines of 20 words."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    runs, seen, want = dict(brute(rows, 2)), set(), {}
    for i, t in sorted(rows):
        left = iter(runs[i].split("\n"))
        ahead, out = next(left, None), []
        for x in t.split("\n"):
            stays = x == ahead
            ahead = next(left, None) if stays else ahead
            long = len(x.split()) >= 20
            if stays and not (long and x in seen):
                out.append(x)
            seen |= {x} if long else set()
        want[i] = "\n".join(out)
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=20).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and want != runs
