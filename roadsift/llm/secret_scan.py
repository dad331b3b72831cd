"""Secret scans with a ledger of content-addressed texts.

Every version of a text is known by its sha256.  A scan looks only at (sha256, rule version) pairs that the ledger doesn't hold, adds
what it finds to the ledger, and joins findings back to every row with that text.  Rules with a new ``RULES_VERSION`` look at all texts again.

Defined results: a null text counts as empty; a text without a secret has an empty list of spans; repeated ids and rows each give
one row; a null id stays null; an empty table gives an empty one; columns other than the two named are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from roadsift.functions.durable import shared_path, stored
from roadsift.llm.text import squeeze, unsqueeze, unused

RULES_VERSION = 1
FEW = 50_000  # hashes with an id, some 100 bytes each, that may be broadcast
SHARE = 20  # and only where this many times as many texts are known

# fixed values: kind, pattern, group that is measured, least length of it
BASE_RULES = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
# fixed values: further published credential formats
MORE_RULES = [
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 20),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
]
ALL_RULES = BASE_RULES + MORE_RULES
KINDS = [kind for kind, *_ in ALL_RULES]
# what a text must hold for a rule to match; only speed depends on it.  The hex rule's failing matches can be left out, as they don't overlap others.
NEEDED = {"assign": ("=", ":"), "access": ("AKIA",), "github": ("gh",), "google": ("AIza",), "jwt": ("eyJ",), "pem": ("PRIVATE KEY",), "slack": ("xox",)}
COMPILED = [(k, kind, re.compile(r"[0-9a-f]{24,}" if kind == "hex" else pattern, re.ASCII), group, least)
            for k, (kind, pattern, group, least) in enumerate(ALL_RULES)]

SPANS = "array<struct<kind: string, start: long, end: long>>"
LEDGER = f"sha256 string, spans {SPANS}, rules int"


def scan_text(text: str) -> list[dict]:
    """Spans of a text in code points, by start and then by the order of the rules."""
    found = []
    for k, kind, pattern, group, least in COMPILED:
        if kind in NEEDED and not any(s in text for s in NEEDED[kind]):
            continue
        for hit in pattern.finditer(text):
            if hit.end(group) - hit.start(group) >= least:
                found.append((hit.start(), k, hit.end()))
    return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(found)]


class Ledger:
    """Findings by text and rule version, as Parquet files that are only added to, partitioned by rule version.

    A scan that is repeated, or runs beside another, may add a text's findings again; they are equal, and a reader sees one of them."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules: int = RULES_VERSION):
        self.spark, self.path, self.rules = spark, path or shared_path(spark, "ledger"), rules

    def rows(self) -> DataFrame:
        """Every entry of every rule version, repeated ones too."""
        try:
            return self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException:  # nothing was added yet
            return self.spark.createDataFrame([], LEDGER)

    def read(self) -> DataFrame:
        """One row for each text that was looked at under these rules."""
        return self.rows().where(F.col("rules") == self.rules).dropDuplicates(["sha256"])

    def add(self, findings: DataFrame):
        added = findings.select("sha256", "spans", F.lit(self.rules).alias("rules"))
        added.write.mode("append").partitionBy("rules").option("compression", "zstd").parquet(self.path)


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column("id"), batch.column("sha256"), squeeze(batch.column("text"))], ["id", "sha256", "text"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        text = batch.column("text")
        spans = [scan_text(t) for t in (unsqueeze(text) if pa.types.is_binary(text.type) else text).to_pylist()]
        yield pa.record_batch([batch.column("sha256"), pa.array(spans, kind)], ["sha256", "spans"])


def scan(versions: DataFrame, ledger: Ledger, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of every row of ``versions``; texts that the ledger holds under its rules aren't read again.

    What is unseen is decided on hashes.  Texts move only if something is unseen: few unseen ones (``FEW``, ``SHARE``) are sent to the texts,
    else both are shuffled by hash, as in every first scan."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = versions.select(F.col(id).alias("id"), F.sha2(content, 256).alias("sha256"))
    blobs = named.groupBy("sha256").agg(F.min("id").alias("at"))
    unseen = stored(blobs.join(ledger.read().select("sha256"), "sha256", "left_anti").withColumnRenamed("sha256", "blob"), "unseen")
    n = unseen.count()
    few = n <= FEW and SHARE * n <= ledger.read().count()
    if n:
        texts = versions.select(F.col(id).alias("id"), F.sha2(content, 256).alias("sha256"), content.alias("text"))
        here = (F.col("sha256") == F.col("blob")) & F.col("id").eqNullSafe(F.col("at"))
        if few:  # nothing is shuffled, so nothing is compressed
            texts = texts.join(F.broadcast(unseen), here, "left_semi")
        else:
            texts = texts.mapInArrow(_squeezed, f"id {texts.schema['id'].dataType.simpleString()}, sha256 string, text binary").join(unseen, here, "left_semi")
        ledger.add(texts.select("sha256", "text").mapInArrow(_scan, f"sha256 string, spans {SPANS}").dropDuplicates(["sha256"]))
    known = ledger.read().select("sha256", "spans")
    return named.join(known, "sha256").select(F.col("id").alias(id), "sha256", "spans")


def redact(docs: DataFrame, ledger: Ledger, id: str = "doc_id", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by ``mark``; overlapping spans are replaced together."""
    scan(docs, ledger, id, text)
    sha, found = unused(docs, "sha", "spans")
    hot = ledger.read().where(F.size("spans") > 0).select(F.col("sha256").alias(sha), F.col("spans").alias(found))
    keyed = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)).join(hot, sha, "left").drop(sha)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, spans in zip(batch.column(text).to_pylist(), batch.column(found).to_pylist()):
                out, at = [], 0
                for s in spans:
                    if s["start"] >= at:
                        out += [t[at:s["start"]], mark]
                    at = max(at, s["end"])
                texts.append("".join([*out, t[at:]]))
            yield pa.record_batch([pa.array(texts, batch.column(c).type) if c == text else batch.column(c) for c in names], names)

    clean = keyed.where(F.col(found).isNull()).drop(found)
    return clean.unionByName(keyed.where(F.col(found).isNotNull()).mapInArrow(run, docs.schema))
