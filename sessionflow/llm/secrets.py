"""Secret scans with an incremental blob ledger.

Each version of each path is addressed by the SHA-256 of its text. Only
(blob, rule version) pairs that the ledger has not seen are scanned, each blob
once however many paths hold it, and the findings are joined back to all paths.
The query delivers the documents in ``DELIVERIES`` parts to one ledger, so what
a later delivery repeats is not scanned again.

The ledger is append-only. A retry or a second writer may append a pair twice;
readers take each (blob, rule version) once. The added kinds are bounded as
their patterns say: URL passwords of up to 64 characters, key headers of up to
20 letters before PRIVATE.

Defined cases: a null text is the empty blob; an empty text has no findings;
rows that repeat a path are versions of it and come back as such; an empty
table gives an empty result. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, slices, table

#: Name of the rule set; a new one makes every blob unseen again.
RULE_VERSION = "2024-06"
#: Parts in which the query delivers the documents to its ledger.
DELIVERIES = 2
#: Spans of one text: kind, start, end.
SPANS = "array<struct<kind:string,start:int,end:int>>"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A maximal run of 16 or more is what [0-9a-f]+ matches there.
_HEX = re.compile(r"[0-9a-f]{16,}")
BASE = ("assign", "access", "hex")
#: Further kinds: name, a plain string each match contains, pattern.
EXTRA = (
    ("private_key", "PRIVATE KEY-----", re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")),
    ("jwt", "eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("vcs_token", "gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("chat_token", "xox", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("url_password", "://", re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@")),
)
KINDS = (*BASE, *(name for name, _, _ in EXTRA))
_KEYWORDS = ("passw", "secret", "token", "api")


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind as listed in ``KINDS``."""
    spans, low = [], text.lower()
    if any(k in low for k in _KEYWORDS):  # lowering only widens what passes
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    for name, part, pattern in EXTRA:
        if part in text:
            spans += [(name, *m.span()) for m in pattern.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(blobs: DataFrame) -> DataFrame:
    """Rows (blob, spans) of blobs (blob, text), those without a finding included."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("blob"), pa.array(found, kind)], ["blob", "spans"])

    return blobs.select("blob", "text").mapInArrow(run, f"blob string, spans {SPANS}")


def addressed(versions: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Rows (path, blob, text) with the content address of each version."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return versions.select(F.col(path_col).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """New ledger rows (blob, rule_version, spans) for blobs of ``versions`` (path, blob, text) that ``ledger`` lacks.

    Copies of a blob are dropped in each map task before the shuffle.
    """
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    return scan(blobs).select("blob", F.lit(rule_version).alias("rule_version"), "spans")


def findings_by_path(versions: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """Rows (path, blob, spans): the ledger's findings at every path that holds the blob, repeated versions included.

    The findings are written first, so that the join has a plain exchange on either side and splits a blob of many paths.
    """
    known = materialize(ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).dropDuplicates(["blob"]).select("blob", "spans"))
    none = F.array().cast(SPANS)
    return versions.select("path", "blob").join(known, "blob", "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))


def read_ledger(spark: SparkSession, ledger_path: str) -> DataFrame | None:
    """The ledger at a path, None where there is none yet."""
    try:
        return spark.read.parquet(ledger_path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def extend_ledger(versions: DataFrame, ledger_path: str, rule_version: str = RULE_VERSION) -> None:
    """Scan what the ledger at ``ledger_path`` has not seen and append it."""
    ledger = read_ledger(versions.sparkSession, ledger_path)
    scan_unseen(versions, ledger, rule_version).write.mode("append").parquet(ledger_path)


def update_ledger(versions: DataFrame, ledger_path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """``extend_ledger``, and the findings by path."""
    extend_ledger(versions, ledger_path, rule_version)
    return findings_by_path(versions, read_ledger(versions.sparkSession, ledger_path), rule_version)


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = addressed(table(spark, sf_dir, "documents"), "doc_id")
    ledger_path = f"{shared_dir(spark)}/ledger/{uuid.uuid4().hex}"
    for delivery in range(DELIVERIES):
        extend_ledger(versions.where(F.pmod(F.xxhash64("path"), F.lit(DELIVERIES)) == delivery), ledger_path)
    found = findings_by_path(versions, read_ledger(spark, ledger_path))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(F.col("path").alias("doc_id"), *count, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


QUERIES = {"op5_blob_ledger": op5_blob_ledger}
SQL: dict[str, str] = {}
