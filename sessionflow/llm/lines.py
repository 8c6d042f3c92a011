"""Line deduplication with a suffix array over line-ID sequences.

The corpus is one sequence of line IDs, documents in the order of doc_id, each
ended by a terminator of its own. Suffixes are ranked by distributed prefix
doubling: the rank at depth 2h is that of the pair (rank at depth h, rank of
the suffix h further on), given by a range sort of the distinct pairs, so ranks
keep the order of the suffix array. A suffix whose rank nobody shares, or whose
prefix meets the terminator, has no common prefix of that depth with any other;
it leaves, and doubling ends when none is left.

Suffixes of equal rank at depth d are an interval of the suffix array with a
longest common prefix of d lines or more. From the deepest interval in which a
suffix has an earlier one, its longest earlier match is found by halving: an
interval of depth L is divided by the ranks of the suffixes L further on, of
depth 1/2, 1/4, ... of its own power of two, into intervals of greater depth,
and it stays itself for the first of each of these and for members that none of
them takes along. So each suffix learns the length of its longest match with an earlier suffix and the
first place where that stands. Matches that no match one line further up holds
are the maximal repeated runs; the lines of a run's later copy are deleted.
With ``min_words`` a later copy of a single line that has so many words is a
repeated run too, wherever it stands.

Defined cases: lines are what ``\\n`` separates, told apart by 128 bits of their
SHA-256; blank lines (only space and \\t \\n \\v \\f \\r) take no part and stay; a
null text has no lines and stays null; an empty text stays empty; null doc_ids
come after all others; rows equal in doc_id and text are one document; rows
equal in doc_id alone are ordered by a hash of the text; an empty table gives
an empty result; all other columns are kept as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK, WORD, fresh, global_rank, materialize, table

#: Lines that a run needs to count as repeated.
MIN_LINES = 2
#: Words that make a run of a single line count: above the sentences that recur in prose, below a licence line or passage.
MIN_WORDS = 20


#: Rows up to which a level is ranked in one sorted partition and joined without tables written in between (some 30 MB).
FEW = 1 << 18
#: A suffix's place: a null doc_id is last.
PLACE = ("none", "doc_id", "text_hash", "seq")


def _identity(id_col: str, text_col: str) -> list[Column]:
    own = F.col(id_col).cast("long")
    return [own.isNull().alias("none"), F.coalesce(own, F.lit(0).cast("long")).alias("doc_id"), F.xxhash64(text_col).alias("text_hash")]


def line_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int | None = None) -> DataFrame:
    """Rows (none, doc_id, text_hash, seq, line, name): the lines that are not blank; name is a digest of the line.

    ``none`` marks a null doc_id. With ``min_words`` also ``wordy``: whether the line has so many words.
    """
    wordy = (lambda x: [x.rlike(f"^{BLANK}*+(?:{WORD}+{BLANK}++){{{min_words - 1}}}{WORD}").alias("wordy")]) if min_words else lambda x: []
    more = ["wordy"] if min_words else []
    lines = F.transform(F.split(text_col, "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("x")))
    solid = F.filter(lines, lambda s: ~s["x"].rlike(f"^{BLANK}*$"))
    named = F.transform(solid, lambda s: F.struct(s["line"].alias("line"), F.unhex(F.substring(F.sha2(s["x"], 256), 1, 32)).alias("name"), *wordy(s["x"])))
    keyed = docs.select(*_identity(id_col, text_col), named.alias("lines"))
    return keyed.select(*PLACE[:3], F.posexplode("lines").alias("seq", "s")).select(*PLACE, "s.line", "s.name", *(f"s.{c}" for c in more))


def _rank(suffixes: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``suffixes`` (place and keys, ``most`` rows at most) with their ``rank``, the interval's ``n`` and ``first`` place; those that share their keys with none leave."""
    shared = suffixes.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first")).where("n > 1")
    # Row numbers of one sorted partition are those that the range sort gives.
    ranked = shared.repartition(1).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()) if most <= FEW else global_rank(shared, keys, "rank")
    return materialize(suffixes.join(ranked, keys).drop(*keys))


def suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """Rows (place, rank, n, first) of the suffixes that share their first 1, 2, 4, ... lines with another, until there are none."""
    more = [c for c in lines.columns if c == "wordy"]
    levels = [_rank(lines.select(*PLACE, "name", *more), ["name"], lines.count())]
    while n := levels[-1].count():
        step = 1 << (len(levels) - 1)
        ahead = Window.partitionBy(*PLACE[:3]).orderBy("seq").rangeBetween(step, step)
        pairs = levels[-1].select(*PLACE, F.col("rank").alias("rank1"), F.first("rank").over(ahead).alias("rank2")).where("rank2 is not null")
        levels.append(_rank(pairs, ["rank1", "rank2"], n))
    return levels[:-1]


def _open(level: DataFrame, above: DataFrame | None) -> DataFrame:
    """The members of the level's intervals but those that the next depth gives an earlier match.

    Whatever such a suffix shares with others at this depth it shares with the first of its deeper interval too, and that one is still here.
    """
    if above is None:
        return level
    return level.join(above.where(F.struct(*PLACE) != F.col("first")).select(*PLACE), list(PLACE), "left_anti")


def longest_matches(levels: list[DataFrame], min_lines: int) -> DataFrame | None:
    """Rows (place, length, first): of each suffix the longest match with an earlier one, of ``min_lines`` or more, and where it first stands.

    None if no level is that deep.

    State: members (place) of intervals (depth ``length``, ``first``). An
    interval is known by its depth and first place. A suffix that finds an
    earlier one at a greater depth leaves the lesser: the earlier one stands for it there.
    """
    lowest = min_lines.bit_length() - 1
    columns = [*PLACE, "length", "first"]
    state = None
    if len(levels) <= lowest:
        return None
    for k in range(len(levels) - 1, -1, -1):
        if k >= lowest:
            own = _open(levels[k], levels[k + 1] if k + 1 < len(levels) else None).select(*PLACE, F.lit(1 << k).cast("long").alias("length"), "first")
            state = own if state is None else state.union(own)
        if k == 0:
            break
        step = 1 << (k - 1)
        there = levels[k - 1].select(*PLACE[:3], F.col("seq").cast("long").alias("there"), F.col("rank").alias("next"))
        state = state.withColumn("there", F.col("seq") + F.col("length"))
        state = materialize(state.join(there, [*PLACE[:3], "there"], "left").select(*columns, "next"))
        parts = state.where("next is not null").groupBy("length", "first", "next").agg(F.count("*").alias("n_part"), F.min(F.struct(*PLACE)).alias("first_part")).where("n_part > 1")
        # Many rows are written first, so that the join has a plain exchange on either side and splits a large interval's rows.
        found = state.join(parts if state.count() <= FEW else materialize(parts), ["length", "first", "next"], "left")
        leaves = F.coalesce(F.struct(*PLACE) != F.col("first_part"), F.lit(False))
        stay = F.when(~leaves, F.struct("length", "first"))
        on = F.when(F.col("n_part").isNotNull(), F.struct((F.col("length") + step).alias("length"), F.col("first_part").alias("first")))
        state = found.select(*PLACE, F.explode(F.filter(F.array(stay, on), lambda s: s.isNotNull())).alias("s")).select(*PLACE, "s.length", "s.first")
    later = state.where((F.struct(*PLACE) != F.col("first")) & (F.col("length") >= min_lines))
    return later.groupBy(*PLACE).agg(F.max("length").alias("length"), F.max_by("first", "length").alias("first"))


def maximal_runs(levels: list[DataFrame], min_lines: int) -> DataFrame | None:
    """The longest matches that no match beginning one line before holds; None if there are none."""
    matches = longest_matches(levels, min_lines)
    if matches is None:
        return None
    before = Window.partitionBy(*PLACE[:3]).orderBy("seq").rangeBetween(-1, -1)
    held = F.coalesce(F.first("length").over(before) > F.col("length"), F.lit(False))
    return matches.withColumn("held", held).where("not held").drop("held")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """Rows (doc_id, text_hash, line, length, original_id, original_hash, original_line): the maximal repeated runs.

    A run of ``length`` lines that are not blank begins at ``line`` of the
    document and stands earlier at ``original_line`` of the original.
    """
    lines = materialize(line_ids(docs, id_col, text_col).distinct())  # rows equal in doc_id and text are one document
    runs = maximal_runs(suffix_ranks(lines), min_lines)
    at = lines.select(*PLACE, "line")
    if runs is None:
        runs = at.select(*PLACE, F.lit(0).cast("long").alias("length"), F.struct(*PLACE).alias("first")).limit(0)
    begun = runs.join(at, list(PLACE)).select(*(F.col(c).alias(f"own_{c}") for c in PLACE), "length", F.col("line").alias("own_line"), "first.*")
    named = lambda none, doc: F.when(~F.col(none), F.col(doc))
    return begun.join(at, list(PLACE)).select(
        named("own_none", "own_doc_id").alias("doc_id"), F.col("own_text_hash").alias("text_hash"), F.col("own_line").alias("line"), "length",
        named("none", "doc_id").alias("original_id"), F.col("text_hash").alias("original_hash"), F.col("line").alias("original_line"),
    )


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """Rows (none, doc_id, text_hash, lines): the line numbers that later copies cover."""
    lines = materialize(line_ids(docs, id_col, text_col, min_words).distinct())
    levels = suffix_ranks(lines)
    runs = maximal_runs(levels, min_lines)
    parts = []
    if runs is not None:
        parts.append(runs.select(*PLACE[:3], F.explode(F.sequence(F.col("seq"), (F.col("seq") + F.col("length") - 1).cast("int"))).alias("seq")))
    if min_words and levels:
        parts.append(levels[0].where(F.col("wordy") & (F.struct(*PLACE) != F.col("first"))).select(*PLACE))
    if not parts:
        return lines.limit(0).groupBy(*PLACE[:3]).agg(F.collect_list("line").alias("lines"))
    covered = reduce(DataFrame.union, parts).distinct()
    return covered.join(lines.select(*PLACE, "line"), list(PLACE)).groupBy(*PLACE[:3]).agg(F.collect_list("line").alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """``docs`` with the lines of later copies deleted from ``text_col``; all rows and columns stay.

    Two columns are added, ``_n_lines`` and ``_n_removed`` (with a further
    underscore where ``docs`` has such a column).
    """
    *key, gone, rows, n_lines, n_removed = fresh(docs, "_none", "_id", "_hash", "_lines", "_rows", "_n_lines", "_n_removed")
    removed = covered_lines(docs, id_col, text_col, min_lines, min_words)
    removed = removed.select(*(F.col(c).alias(k) for c, k in zip(PLACE, key)), F.col("lines").alias(gone))
    keyed = docs.withColumns(dict(zip(key, _identity(id_col, text_col)))).join(removed, key, "left").withColumn(rows, F.split(text_col, "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size(rows) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col(rows), i)), "\n"))
    count = lambda x: F.when(F.col(x).isNull(), 0).otherwise(F.size(x)).cast("long")
    return keyed.withColumns({text_col: text, n_lines: count(rows), n_removed: count(gone)}).select(*docs.columns, n_lines, n_removed)


def op1_suffix_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=MIN_WORDS)
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def sql(docs: str = "documents", min_lines: int = MIN_LINES, min_words: int | None = None, select: str = "") -> str:
    """DuckDB SQL: every document with the lines kept, null doc_ids last."""
    single = f"UNION SELECT doc_id, seq FROM (SELECT doc_id, seq, row_number() OVER (PARTITION BY l ORDER BY doc_id, seq) AS n FROM named WHERE words >= {min_words}) WHERE n > 1" if min_words else ""
    names = "l" if min_lines == 1 else "concat_ws('|', " + ", ".join(f"lead(l, {i}) OVER w" if i else "l" for i in range(min_lines)) + ")"
    whole = "TRUE" if min_lines == 1 else f"lead(seq, {min_lines - 1}) OVER w IS NOT NULL"
    return f"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM {docs}
), named AS (
  SELECT doc_id, line, md5(x) AS l, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS seq FROM split WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')
), windows AS (
  SELECT doc_id, seq, {names} AS k, {whole} AS whole FROM named WINDOW w AS (PARTITION BY doc_id ORDER BY seq)
), ranked AS (
  SELECT doc_id, seq, row_number() OVER (PARTITION BY k ORDER BY doc_id, seq) AS n FROM windows WHERE whole
), covered AS (
  SELECT DISTINCT doc_id, seq + i AS seq FROM ranked, (SELECT unnest(range({min_lines})) AS i) WHERE n > 1
  {single}
), gone AS (
  SELECT n.doc_id, n.line FROM named n JOIN covered c ON n.doc_id = c.doc_id AND n.seq = c.seq
), kept AS (
  SELECT s.doc_id, count(*) AS n_lines, count(g.line) AS n_removed, coalesce(string_agg(s.x, chr(10) ORDER BY s.line) FILTER (WHERE g.line IS NULL), '') AS text
  FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.line = g.line GROUP BY s.doc_id
)
{select or "SELECT doc_id, n_lines, n_removed, sha256(text) AS kept_sha256 FROM kept"}"""


QUERIES = {"op1_suffix_lines": op1_suffix_lines}
SQL = {"op1_suffix_lines": sql(min_words=MIN_WORDS)}
