"""Toxicity scores by logistic regression over hashed word n-grams and skip-grams, trained with FTRL-proximal.

Beside whole words their beginnings of ``STEMS`` bytes are features, as languages with many endings repeat a stem more than a form.

Every coordinate has its own learning rate, and the L1 term leaves most weights at zero, so what is broadcast is a short list of weights
(at most ``2 ** BITS`` of 8 bytes).  The model is fitted on at most ``sample`` labelled rows, those with the smallest hash of their id;
``SHARDS`` learners see a part each and their weights are averaged.  Scores cover every whole text.

Defined results: a null or empty text is scored by the intercept; a null id is held in and scored; labels without a document, and
documents without a label, don't train; several labels of an id count as toxic if one is; repeated rows each give one row;
without any label every score is one half; an empty table gives an empty one; columns other than the named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadsift.llm.text import LOWER, Words, mixed, slices

BITS = 18
SAMPLE = 20_000
SHARDS = 4
EPOCHS = 3
STEMS = (4, 5, 6)
ALPHA, BETA, L1, L2 = 0.2, 1.0, 1.0, 0.5

# a word is a run of ASCII letters, digits, and bytes of other letters
BLANK = np.ones(256, bool)
BLANK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(column: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Hashed words, stems, pairs of neighbours and pairs with a word between, each with their documents; and the number of documents."""
    words = Words(column, lower=True, blank=BLANK)
    h, doc = words.hashes, words.doc
    mask = np.uint64((1 << BITS) - 1)
    out = [((h & mask).astype(np.int64), doc)]
    size, low = words.ends - words.starts, LOWER[words.data].astype(np.uint64)
    for stem in STEMS:
        at = np.flatnonzero(size >= stem)
        packed = np.full(len(at), stem, np.uint64)
        for k in range(stem):
            packed = packed << np.uint64(8) | low[words.starts[at] + k]
        out.append(((mixed(packed) & mask).astype(np.int64), doc[at]))
    for gap in (1, 2):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            joint = mixed(h[:-gap][same] * np.uint64(2 * gap + 1) + h[gap:][same] + np.uint64(gap))
            out.append(((joint & mask).astype(np.int64), doc[:-gap][same]))
    return out, words.n_docs


def held_out(id: str) -> Column:
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the intercept last, after passing the rows in order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for idx, y in zip(rows, labels):
            at, x = idx
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at], n[at] = zi + g - sigma * w, ni + g * g
    return weights(z, n)


def _counted(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    grams, n_docs = features(part.column("text"))
    idx, doc = (np.concatenate(c) for c in zip(*grams))
    key, count = np.unique((doc << BITS) | idx, return_counts=True)
    bounds = np.searchsorted(key, np.arange(n_docs + 1) << BITS)
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield np.append(key[a:b] & ((1 << BITS) - 1), 1 << BITS), np.append(np.minimum(count[a:b], 4), 1).astype(float)


def train(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the weights that aren't zero."""
    chosen = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max(label).cast("double").alias("y"))
    chosen = chosen.where(~held_out("id")).orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most ``sample`` rows of 16 bytes
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                at, x = [], []
                for a, b in _counted(part):
                    at.append(a.astype(np.int32).tobytes())
                    x.append(b.astype(np.float32).tobytes())
                yield pa.record_batch([part.column("id"), part.column("y"), pa.array(at, pa.binary()), pa.array(x, pa.binary())], ["id", "y", "at", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"id {kind}, y double, at binary, x binary").withColumn("shard", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(SHARDS)))

    def learn(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["id", "at"]).sample(frac=1, random_state=1)
        w = ftrl([(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32).astype(float)) for a, x in zip(shard["at"], shard["x"])], shard["y"].to_numpy())
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": [at.astype(np.int64).tobytes()], "w": [w[at].tobytes()]})

    total = np.zeros((1 << BITS) + 1)
    learnt = counted.groupBy("shard").applyInPandas(learn, "at binary, w binary").collect()  # SHARDS rows of sparse weights
    for row in learnt:
        total[np.frombuffer(row["at"], np.int64)] += np.frombuffer(row["w"], np.float64) / len(learnt)
    at = np.flatnonzero(total)
    return at, total[at]


def toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """``id``, ``held_out``, ``score`` and ``predicted`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id, text, label, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values = shared.value
        weights = np.zeros((1 << BITS) + 1)
        weights[at] = values
        for batch in batches:
            for part in slices(batch, "text"):
                total = np.full(part.num_rows, weights[-1])
                grams, _ = features(part.column("text"))
                # a gram counts four times at most, as in training; only grams with a weight are looked at
                found = [(idx[hit], doc[hit]) for idx, doc in grams if len(hit := np.flatnonzero(weights[idx]))]
                if found:
                    idx, doc = (np.concatenate(c) for c in zip(*found))
                    key, count = np.unique((doc << BITS) | idx, return_counts=True)
                    np.add.at(total, key >> BITS, weights[key & ((1 << BITS) - 1)] * np.minimum(count, 4))
                score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.record_batch([part.column("id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    slim = docs.select(F.col(id).alias("id"), held_out(id).alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id)
