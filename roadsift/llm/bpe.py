"""Byte-pair encoding with a queue of merge ranks over a linked symbol list, and decoding from vocabulary strings.

Defined results: a null or empty text has no ids and decodes to the empty string; every row gives one row, repeated ids and rows
included; a null id stays null; an empty table gives an empty one; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadsift.llm.lexicon import Cache, Pieces, as_letters, load
from roadsift.llm.text import slices


class BytePairs:
    """A vocabulary and its merges, from the JSON text of a tokenizer file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")

    def encode(self, piece: str) -> list[int]:
        """Ids of one pre-token, written in the vocabulary's byte letters."""
        last = len(piece) - 1
        symbols = [self.vocab[c + self.suffix if k == last else c] for k, c in enumerate(piece)]
        if last < 1:
            return symbols
        ranks = self.ranks
        after = list(range(1, last + 2))
        before = list(range(-1, last))
        queue = []
        for k in range(last):
            a, b = symbols[k], symbols[k + 1]
            found = ranks.get((a, b))
            if found is not None:
                queue.append((found[0], k, a, b, found[1]))
        heapq.heapify(queue)
        while queue:
            _, k, a, b, joint = heapq.heappop(queue)
            if symbols[k] != a:
                continue
            right = after[k]
            if right > last or symbols[right] != b:
                continue
            symbols[k], symbols[right] = joint, -1
            follow = after[k] = after[right]
            if follow <= last:
                before[follow] = k
                found = ranks.get((joint, symbols[follow]))
                if found is not None:
                    heapq.heappush(queue, (found[0], k, joint, symbols[follow], found[1]))
            left = before[k]
            if left >= 0:
                found = ranks.get((symbols[left], joint))
                if found is not None:
                    heapq.heappush(queue, (found[0], left, symbols[left], joint, found[1]))
        return [s for s in symbols if s >= 0]

    def encode_text(self, tokenizer, text: str) -> list[int]:
        """Ids of a whole text; only the normaliser and the pre-tokeniser are the library's."""
        out, at = [], 0
        for hit in [*self.cut.finditer(text), None]:
            part = text[at:hit.start() if hit else len(text)]
            if part:
                if tokenizer.normalizer is not None:
                    part = tokenizer.normalizer.normalize_str(part)
                for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(part):
                    out.extend(self.encode(piece))
            if hit:
                out.append(self.special[hit[0]])
                at = hit.end()
        return out

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by one space, which is the library's rule for a file without a decoder."""
        return " ".join(self.strings[i] for i in ids)


class Encoded:
    """Ids of a worker's pre-tokens, as text and decoded."""

    def __init__(self, source: str):
        self.pairs = BytePairs(source)
        self.tokenizer = load(source)
        self.cache = Cache(self._make, self._clear)

    def _clear(self):
        self.sizes, self.ids, self.strings = np.zeros(0, np.int32), [], []

    def _make(self, pieces: list[str]):
        sizes = []
        for piece in pieces:
            ids = self.pairs.encode(as_letters(piece))
            sizes.append(len(ids))
            self.ids.append(" ".join(map(str, ids)))
            self.strings.append(self.pairs.decode(ids))
        self.sizes = np.concatenate([self.sizes, np.array(sizes, np.int32)])


_WORKER: dict[int, Encoded] = {}


def worker(source: str) -> Encoded:
    key = hash(source)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoded(source)
    return _WORKER[key]


def encode_decode(docs: DataFrame, tokenizer_file: str, id: str = "doc_id", text: str = "text", words: bool = True) -> DataFrame:
    """Token ids of each text (decimal, joined by a space), their number, and the text decoded from them."""
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, ids, decoded, part in encoded(batches, worker(shared.value), words):
            yield pa.record_batch({"id": part.column("id"), "n_tokens": n, "ids": pa.array(ids), "decoded": pa.array(decoded)})

    slim, kind = _slim(docs, id, text)
    return slim.mapInArrow(run, f"id {kind}, n_tokens long, ids string, decoded string").withColumnRenamed("id", id)


def encode_digests(docs: DataFrame, tokenizer_file: str, id: str = "doc_id", text: str = "text", words: bool = True) -> DataFrame:
    """As ``encode_decode``, with sha256 digests in place of the two texts, so that long texts needn't leave the worker."""
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, ids, decoded, part in encoded(batches, worker(shared.value), words):
            yield pa.record_batch({"id": part.column("id"), "n_tokens": n,
                                   "ids_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids], pa.string()),
                                   "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())})

    slim, kind = _slim(docs, id, text)
    return slim.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id)


def _slim(docs: DataFrame, id: str, text: str):
    slim = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return slim, slim.schema["id"].dataType.simpleString()


def encoded(batches, w: Encoded, words: bool):
    for batch in batches:
        for part in slices(batch, "text"):
            pieces = Pieces(part.column("text"), words, list(w.pairs.special))
            numbers = w.cache.find(pieces.hashes, pieces.text)
            total = np.zeros(len(numbers) + 1, np.int64)
            np.cumsum(w.sizes[numbers], out=total[1:])
            n = np.diff(total[pieces.bounds])
            ids, decoded, listed, bounds = [], [], numbers.tolist(), pieces.bounds.tolist()
            for d in range(pieces.n_docs):
                if pieces.odd[d]:
                    own = w.pairs.encode_text(w.tokenizer, pieces.document(d))
                    n[d] = len(own)
                    ids.append(" ".join(map(str, own)))
                    decoded.append(w.pairs.decode(own))
                else:
                    own = listed[bounds[d]:bounds[d + 1]]
                    ids.append(" ".join([w.ids[k] for k in own]))
                    decoded.append(" ".join([w.strings[k] for k in own]))
            yield n, ids, decoded, part
