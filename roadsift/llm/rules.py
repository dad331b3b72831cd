"""Quality rules: measures of each text, and lines that too many documents of a host share.

A line counts by its words in lower case.  A line that more than ``max_docs`` documents of one host contain is removed from all
of them but the one with the smallest id, so that one copy of every passage stays; a document that keeps less than
``min_percent_left`` of its words is rejected, as is one that fails the base rules.

Lower case is that of A to Z; other letters stay as they are.

Defined results: a null or empty text has no words and fails the base rules; every row gives one row, and rows with the same id count as one
document of a line; all null hosts are one host; rows with a null id count as one document, which never is the first with a line;
an empty table gives an empty one; columns other than the three named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadsift.functions.durable import stored
from roadsift.llm.text import UNITS, Words, mixed, slices, unit_hashes, unused, window_hashes

# fixed values: what counts as a symbol, and the base rules
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def line_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First byte of each line; every document begins with one."""
    first = np.zeros(len(data) + 1, bool)
    first[1:] = data == 10
    first[offsets] = True
    return np.flatnonzero(first[:len(data)])


def line_words(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines with a word: their starts' numbers, the first word of each, and a hash of their words in lower case."""
    starts = line_starts(words.data, words.offsets)
    line = np.searchsorted(starts, words.starts, "right") - 1
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
    return line[first], first, unit_hashes(words.hashed(lower=True), first)


def measure(words: Words) -> dict[str, np.ndarray]:
    data, doc = words.data, words.doc
    lines, first, _ = line_words(words)
    values = UNITS[data.astype(np.int64) + 256]
    values[data == 10] = 0
    exact = unit_hashes(values, line_starts(data, words.offsets))[lines] if len(lines) else np.zeros(0, np.uint64)
    line_doc = doc[first]
    bounds = np.searchsorted(line_doc, np.arange(words.n_docs + 1))
    kept = np.unique(exact ^ mixed(line_doc + 1), return_index=True)[1]
    once = np.zeros(len(exact), bool)
    once[kept] = True
    hashes, whole = window_hashes(words.hashes, doc, 3)
    at = np.flatnonzero(whole)
    _, back, n = np.unique(hashes[at] ^ mixed(doc[at] + 1), return_inverse=True, return_counts=True)
    again = at[n[back] > 1] if len(at) else at
    repeated = np.zeros(len(doc) + 2, bool)
    for k in range(3):
        repeated[again + k] = True
    return {"n_words": np.diff(words.bounds), "word_chars": words.per_doc(words.inside & ((data & 0xC0) != 0x80), words.offsets),
            "n_symbols": words.per_doc(IS_SYMBOL[data], words.offsets), "n_dup_lines": words.per_doc(~once, bounds),
            "n_repeat_words": words.per_doc(repeated[:len(doc)], words.bounds)}


def measured(docs: DataFrame, id: str, host: str, text: str) -> DataFrame:
    """Measures of each document, a key of its id and text, and its distinct lines with the words they hold."""
    slim = docs.select(F.col(id).alias("id"), F.col(host).alias("host"), F.col(text).cast("string").alias("text"),
                       F.xxhash64(id, text).alias("k1"), F.hash(id, text).alias("k2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):  # measuring takes many bytes for one of text
                words = Words(part.column("text"))
                out = measure(words)
                _, first, hashes = line_words(words)
                size = np.diff(np.append(first, len(words.starts)))
                # distinct lines of each document
                order = np.lexsort((hashes, words.doc[first]))
                h, d, n = hashes[order], words.doc[first][order], size[order]
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.zeros(0, np.int64)
                total = np.add.reduceat(n, new) if len(new) else np.zeros(0, np.int64)
                bounds = pa.array(np.searchsorted(d[new], np.arange(words.n_docs + 1)).astype(np.int32))
                out["line"] = pa.ListArray.from_arrays(bounds, pa.array(h[new].view(np.int64)))
                out["line_words"] = pa.ListArray.from_arrays(bounds, pa.array(total.astype(np.int64)))
                keys = {c: part.column(c) for c in ("id", "host", "k1", "k2")}
                yield pa.record_batch(keys | {k: v if isinstance(v, pa.Array) else pa.array(v.astype(np.int64)) for k, v in out.items()})

    kinds = {c: slim.schema[c].dataType.simpleString() for c in ("id", "host")}
    return slim.mapInArrow(run, f"id {kinds['id']}, host {kinds['host']}, k1 long, k2 int, {MEASURES}, line array<long>, line_words array<long>")


def removed_lines(base: DataFrame, max_docs: int) -> DataFrame:
    """For each document key: hashes of the lines it loses and the words in them."""
    lines = base.select("id", "host", "k1", "k2", F.explode(F.arrays_zip("line", "line_words")).alias("l"))
    lines = lines.select("id", F.xxhash64("host").alias("at"), "k1", "k2", F.col("l.line").alias("line"), F.col("l.line_words").alias("words"))
    key = ["at", "line"]
    # rows decide what may be common; among those lines, repeated rows of an id count as one document
    often = lines.groupBy(key).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > max_docs).select(*key)
    shared = stored(lines.join(often, key), "shared-lines")
    common = shared.select("id", *key).distinct().groupBy(key).agg(F.count("*").alias("n_docs"), F.min("id").alias("first")).where(F.col("n_docs") > max_docs)
    lost = shared.join(common, key).where(~F.col("id").eqNullSafe(F.col("first")))
    lost = lost.select("k1", "k2", "line", "words").distinct()  # repeated rows share a key
    return lost.groupBy("k1", "k2").agg(F.sum("words").alias("n_removed_words"), F.collect_list("line").alias("removed"))


def quality_rules(docs: DataFrame, id: str = "doc_id", host: str = "source", text: str = "text", max_docs: int = 100,
                  min_percent_left: int = 30, measured_rows: DataFrame | None = None) -> DataFrame:
    """Measures and verdict of each document: ``base_failed``, ``n_removed_words``, ``kept``, and the hashes of its removed lines."""
    base = stored(measured(docs, id, host, text), "measures") if measured_rows is None else measured_rows
    out = base.drop("line", "line_words").join(removed_lines(base, max_docs), ["k1", "k2"], "left")
    out = out.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = 100 * (F.col("n_words") - F.col("n_removed_words")) >= min_percent_left * F.col("n_words")
    return (out.withColumn("base_failed", failed).withColumn("kept", ~failed & left).withColumnRenamed("id", id).withColumnRenamed("host", host))


def apply_rules(docs: DataFrame, id: str = "doc_id", host: str = "source", text: str = "text", **limits) -> DataFrame:
    """The documents that are kept, without the lines that are removed; all columns of ``docs`` stay."""
    k1, k2, lost = unused(docs, "k1", "k2", "removed")
    verdict = quality_rules(docs, id, host, text, **limits).where("kept").select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("removed").alias(lost))
    verdict = verdict.dropDuplicates([k1, k2])
    keyed = docs.withColumn(k1, F.xxhash64(id, text)).withColumn(k2, F.hash(id, text))
    joined = keyed.join(verdict, [k1, k2]).drop(k1, k2)
    changed = F.col(lost).isNotNull()
    whole = joined.where(~changed).drop(lost)
    names = docs.columns

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in slices(batch, text):
                words = Words(part.column(at))
                lines, first, hashes = line_words(words)
                starts = np.append(line_starts(words.data, words.offsets), len(words.data))
                removed = part.column(part.schema.get_field_index(lost)).to_pylist()
                raw, texts = words.data.tobytes(), []
                bounds = np.searchsorted(words.doc[first], np.arange(words.n_docs + 1))
                for d in range(words.n_docs):
                    gone = np.array(removed[d], np.int64).view(np.uint64)
                    mine = slice(bounds[d], bounds[d + 1])
                    drop = set(lines[mine][np.isin(hashes[mine], gone)].tolist())
                    begin, end = np.searchsorted(starts, words.offsets[d:d + 2])
                    texts.append(b"".join(raw[starts[k]:starts[k + 1]] for k in range(begin, end) if k not in drop).decode())
                columns = [pa.array(texts, part.column(at).type) if c == text else part.column(c) for c in names]
                yield pa.record_batch(columns, names)

    return whole.unionByName(joined.where(changed).mapInArrow(strip, docs.schema))
