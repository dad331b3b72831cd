"""Token counts by a two-tier map-side lookup of pre-token lengths; pre-tokens are never shuffled.

Defined results: a null or empty text has 0 bytes and 0 tokens; every row gives one row, repeated ids and rows included; a null id
stays null; an empty table gives an empty one; columns other than the two named are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadsift.llm.lexicon import Cache, Pieces, as_letters, load, special_strings
from roadsift.llm.text import slices, utf8

COUNTED = "id {id}, n_bytes long, n_tokens long, over_limit boolean"


class Lengths:
    """Token numbers of a worker's pre-tokens."""

    def __init__(self, source: str):
        self.model = load(source).model
        self.cache = Cache(self._make, self._clear)

    def _clear(self):
        self.lengths = np.zeros(0, np.int32)

    def _make(self, pieces: list[str]):
        tokenize = self.model.tokenize
        new = np.fromiter((len(tokenize(as_letters(p))) for p in pieces), np.int32, len(pieces))
        self.lengths = np.concatenate([self.lengths, new])

    def of(self, hashes, text) -> np.ndarray:
        numbers = self.cache.find(hashes, text)
        return self.lengths[numbers]


_WORKER: dict[int, Lengths] = {}


def worker_lengths(source: str) -> Lengths:
    key = hash(source)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Lengths(source)
    return _WORKER[key]


def frequent_table(docs: DataFrame, source: str, words: bool, text: str, bits: int, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Tier one: hash and length of the most frequent pre-tokens of ``sample_rows`` documents, ``2 ** bits`` slots whatever the input.

    The sample decides only what is found fast.  It is read by one task, so the pre-tokens in it aren't shuffled either."""
    special = special_strings(source)
    most = 1 << (bits - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        lengths: dict[int, int] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                pieces = Pieces(part.column("text"), words, special)
                new, first, n = np.unique(pieces.hashes, return_index=True, return_counts=True)
                sizes = worker_lengths(source).of(new, lambda i, first=first, pieces=pieces: pieces.text(int(first[i])))
                for h, size, c in zip(new.tolist(), sizes.tolist(), n.tolist()):
                    seen[h] += c
                    lengths[h] = size
                if len(seen) > 8 * most:  # what is rare so far may go: only speed depends on it
                    seen = Counter(dict(seen.most_common(most)))
                    lengths = {h: lengths[h] for h in seen}
        top = [h for h, _ in seen.most_common(most)]
        yield pa.record_batch({"hashes": pa.array([np.array(top, np.uint64).tobytes()], pa.binary()),
                               "lengths": pa.array([np.array([lengths[h] for h in top], np.int32).tobytes()], pa.binary())})

    rows = (docs.select(F.col(text).cast("string").alias("text")).limit(sample_rows).coalesce(1)
            .mapInArrow(count, "hashes binary, lengths binary").collect())
    tags, found = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
    for row in rows:
        hashes, lengths = np.frombuffer(row["hashes"], np.uint64)[::-1], np.frombuffer(row["lengths"], np.int32)[::-1]
        at = hashes & np.uint64((1 << bits) - 1)
        tags[at], found[at] = hashes, lengths  # the most frequent comes last and stays
    return tags, found


def token_counts(docs: DataFrame, tokenizer_file: str, words: bool = True, limit: int = 2048, id: str = "doc_id", text: str = "text",
                 bits: int = 17, sample_rows: int = 2000) -> DataFrame:
    """Bytes and tokens of each text, as the tokenizers library counts without added special tokens, and whether they exceed ``limit``.

    ``tokenizer_file`` is the library's JSON; ``words`` says that its pre-tokens leave blanks out.  Tier one holds at most
    ``2 ** bits`` lengths (12 bytes each) and is broadcast, as is the tokenizer itself; both sizes are fixed."""
    with open(tokenizer_file, encoding="utf-8") as f:
        source = f.read()
    special = special_strings(source)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((source, *frequent_table(docs, source, words, text, bits, sample_rows)))
    mask = np.uint64((1 << bits) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, tags, frequent = shared.value
        rare = worker_lengths(source)
        for batch in batches:
            for part in slices(batch, "text"):
                pieces = Pieces(part.column("text"), words, special)
                at = pieces.hashes & mask
                lengths = frequent[at]
                missed = np.flatnonzero(tags[at] != pieces.hashes)
                if len(missed):
                    lengths[missed] = rare.of(pieces.hashes[missed], lambda i, missed=missed, pieces=pieces: pieces.text(int(missed[i])))
                total = np.zeros(len(lengths) + 1, np.int64)
                np.cumsum(lengths, out=total[1:])
                n = np.diff(total[pieces.bounds])
                for d in np.flatnonzero(pieces.odd).tolist():
                    n[d] = len(load(source).encode(pieces.document(d), add_special_tokens=False).ids)
                yield pa.record_batch({"id": part.column("id"), "n_bytes": np.diff(utf8(part.column("text"))[1]), "n_tokens": n,
                                       "over_limit": n > limit})

    slim = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(count, COUNTED.format(id=kind)).withColumnRenamed("id", id)
