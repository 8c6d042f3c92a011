"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0 to 1 (linear between a
start and an end). Its integral, scaled to the source's target, is the
source's cumulative token demand. A source's documents lie in a hash order;
the demand is met by whole passes over that order and a last partial pass, the
document at the cut being taken in part. Each time that a document is taken is
a draw with a training position of its own: the time at which its source's
demand reaches the middle of the draw. ``mix`` returns the documents, ``draws``
the draws; the mix is range-sorted by position.

Targets: weights 5, 2, 1 repeat over the sources by code point (null last) and
share 150 % of all sizes. No source gets more than twice its size; what is
over is shared again by weight among the others until none is above.

Defined cases: a null or empty text has size 0 and nothing is taken of it (its
position is that of its place and it has no draws); rows that repeat a document
are documents of their own, ordered by a hash of the text; a null doc_id is
placed by its text; an empty table gives an empty result. Sums per source are built from bucket sums
by hash prefix, so no source meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, global_rank, materialize, table

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Weight at the start and the end of training for each entry of ``WEIGHTS``.
SCHEDULE = ((3.0, 1.0), (1.0, 1.0), (1.0, 4.0))
#: Rows that a bucket of a source's hash order holds on average.
BUCKET_ROWS = 4096


def pick(rank: Column, values: tuple[float, ...]) -> Column:
    """values[rank % len(values)]."""
    return F.element_at(F.array(*map(F.lit, values)), (rank % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with rank, weight and target; only sums reach the driver."""
    ranked = global_rank(sizes, ["source"], "rank").withColumn("weight", pick(F.col("rank"), weights))
    ranked = materialize(ranked.withColumn("cap", F.col("source_size") * F.lit(most)))
    total = ranked.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    budget, level = share * total, None
    while True:  # a source that is at its cap stays there as the level only rises, so this ends
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("cap")
        row = ranked.agg(F.sum(F.when(above, F.col("cap"))).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        new = (budget - (row["full"] or 0.0)) / row["open"]
        if new == level:
            break
        level = new
    target = F.lit(0.0) if level is None else F.when(F.col("weight") * F.lit(level) > F.col("cap"), F.col("cap")).otherwise(F.col("weight") * F.lit(level))
    return ranked.withColumn("target", target).drop("cap")


def arrival(part: Column, start: Column, end: Column) -> Column:
    """The time at which the integral of a linear weight reaches ``part`` of its whole."""
    area = part * (start + end) / 2
    root = F.sqrt(start * start + (end - start) * 2 * area)
    return F.when(start + root > 0, area * 2 / (start + root)).otherwise(F.lit(0.0))


def _offsets(buckets: DataFrame, digits: int) -> DataFrame:
    """Rows (s, b, offset): what a source's buckets (source, bucket, bucket_size) before each bucket hold.

    Buckets are first added up by the first half of their digits, so that a
    window holds about the root of a source's buckets.
    """
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    behind = lambda c, by, order: F.coalesce(F.sum(c).over(before(by, order)), F.lit(0))
    halved = buckets.withColumn("half", F.substring("bucket", 1, digits // 2))
    halves = halved.groupBy("source", "half").agg(F.sum("bucket_size").alias("half_size"))
    halves = halves.select(F.col("source").alias("s"), F.col("half").alias("h"), behind("half_size", ["source"], "half").alias("first"))
    inside = halved.withColumn("inside", behind("bucket_size", ["source", "half"], "bucket"))
    joined = inside.join(halves, F.col("source").eqNullSafe(F.col("s")) & (F.col("half") == F.col("h")))
    return joined.select("s", F.col("bucket").alias("b"), (F.col("first") + F.col("inside")).alias("offset"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, schedule=SCHEDULE, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken, position, draws), one per input row.

    draws are structs (pass from 0, words, position) in order of position, which is that of the first.
    """
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit(""))).alias("place"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
    )
    sized = materialize(sized)
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = materialize(targets(sizes, weights, share, most)).select(F.col("source").alias("to"), "rank", "source_size", "target")
    n, digits = sized.count(), 1
    while 16**digits * BUCKET_ROWS < n and digits < 8:
        digits += 1
    sized = sized.withColumn("bucket", F.substring("place", 1, digits))
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    starts = _offsets(buckets, digits)
    inside = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .join(plan, F.col("source").eqNullSafe(F.col("to")))
        .withColumn("at", F.col("own") + F.col("offset"))
    )
    goal = F.floor(F.col("target") + 0.5).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    cut = goal - passes * F.col("source_size")
    last = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), cut - F.col("at")))
    start, end = (pick(F.col("rank"), tuple(s[i] for s in schedule)) for i in (0, 1))

    def time(before: Column, words: Column) -> Column:
        return arrival(F.when(goal > 0, F.least(F.lit(1.0), (before + words / 2) / goal)).otherwise(F.lit(0.0)), start, end)

    def draw(number: Column, words: Column) -> Column:
        return F.struct(number.cast("int").alias("pass"), words.alias("words"), time(number * F.col("source_size") + F.col("at"), words).alias("position"))

    some = F.col("size") > 0
    whole = F.when(some & (passes > 0), F.transform(F.sequence(F.lit(0).cast("long"), passes - 1), lambda p: draw(p, F.col("size"))))
    rest = F.when(last > 0, F.array(draw(passes, last)))
    none = F.array().cast("array<struct<pass:int,words:bigint,position:double>>")
    first = time(F.col("at"), F.when(passes > 0, F.col("size")).otherwise(last))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", (passes * F.col("size") + last).alias("taken"), first.alias("position"), F.concat(F.coalesce(whole, none), F.coalesce(rest, none)).alias("draws")
    )


def draws(mixed: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken, position, pass), one per draw of ``mix``; taken are the draw's words."""
    each = mixed.select("doc_id", "source", "size", "source_size", "target", F.explode("draws").alias("draw"))
    return each.select("doc_id", "source", "size", "source_size", "target", F.col("draw.words").alias("taken"), "draw.position", "draw.pass")


def op2_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in the order of their first draw; next_position is that of the second, null if there is none."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position", F.get("draws", F.lit(1))["position"].alias("next_position")).orderBy("position", "doc_id")


def sql(docs: str = "documents") -> str:
    """DuckDB SQL for the mix of a table (doc_id, text, source)."""
    return f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, text, '')) AS place
  FROM {docs}
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2.0::DOUBLE AS cap FROM sources
), ordered AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS full_cap, sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
    1.5::DOUBLE * (SELECT sum(source_size) FROM sources)::DOUBLE AS budget
  FROM weighed WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT (budget - full_cap) / open_weight AS x FROM ordered WHERE weight * ((budget - full_cap) / open_weight) <= cap ORDER BY cap / weight, rank LIMIT 1
), plan AS (
  SELECT source, rank, source_size, CASE WHEN weight * x > cap THEN cap ELSE weight * x END AS target FROM weighed, level
), placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.rank, floor(p.target + 0.5)::BIGINT AS goal,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
), cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes FROM placed
), taken AS (
  SELECT *, least(size, greatest(0, goal - passes * source_size - ahead)) AS last FROM cut
), drawn AS (
  SELECT *, (ahead + (CASE WHEN passes > 0 THEN size ELSE last END)::DOUBLE / 2) AS middle,
    CASE WHEN size > 0 AND passes > 1 THEN source_size + ahead + size::DOUBLE / 2 WHEN passes = 1 AND last > 0 THEN source_size + ahead + last::DOUBLE / 2 END AS next_middle,
    CASE rank % 3 WHEN 0 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS w0, CASE rank % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 4.0::DOUBLE END AS w1
  FROM taken
), area AS (
  SELECT *, CASE WHEN goal > 0 THEN least(1.0::DOUBLE, middle / goal) ELSE 0 END * (w0 + w1) / 2 AS a,
    CASE WHEN next_middle IS NOT NULL THEN least(1.0::DOUBLE, next_middle / goal) END * (w0 + w1) / 2 AS b
  FROM drawn
)
SELECT doc_id, size, source_size, target, (passes * size + last)::BIGINT AS taken,
  (a * 2) / (w0 + sqrt(w0 * w0 + (w1 - w0) * 2 * a)) AS position, (b * 2) / (w0 + sqrt(w0 * w0 + (w1 - w0) * 2 * b)) AS next_position
FROM area"""


QUERIES = {"op2_curriculum": op2_curriculum}
SQL = {"op2_curriculum": sql()}
