"""Harmonic packing of tokenised documents into sequences.

Class k holds pieces of about 1/k of the capacity, and each of its sequences takes exactly k of them, so a task fills its sequences
by counting, without seeing other lengths and without a shuffle.  Documents are cut where a piece would leave too much of its share
empty.  What a task's unfinished sequences hold at its end (one per class at most) is laid end to end instead; the last
sequence of a task is cut at powers of two, which need no padding.

Defined results: a null or empty text is a document of the closing id alone; repeated ids and rows are documents of their own; a
null id stays null; an empty table gives an empty one; columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadsift.llm.lexicon import Cache, Pieces, as_letters, load, special_strings
from roadsift.llm.text import slices

PACKED = "id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
TASK_BITS = 36


@lru_cache(maxsize=8192)
def cuts(length: int, capacity: int, waste: int) -> tuple[int, ...]:
    """Lengths of the pieces of a run of ``length`` tokens: the reciprocal classes that leave at most ``waste`` of a sequence empty."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        piece = rest if capacity - k * rest <= waste else capacity // (k + 1)
        out.append(piece)
        rest -= piece
    return tuple(out)


class Sequences:
    """The open sequences of one task."""

    def __init__(self, capacity: int, waste: int, first: int):
        self.capacity, self.waste, self.next = capacity, waste, first
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]):
        at = 0
        for id, start, ids, total in pieces:
            self.rows.append((id, start, len(ids), ids.tobytes(), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, id, ids: np.ndarray):
        total, start = len(ids), 0
        long = total // self.capacity * self.capacity
        for start in range(0, long, self.capacity):
            self._emit([(id, start, ids[start:start + self.capacity], total)])
        start = long
        for size in cuts(total - long, self.capacity, self.waste):
            k = self.capacity // size
            row = self.open.setdefault(k, [])
            row.append((id, start, ids[start:start + size].copy(), total))
            if len(row) == k:
                self._emit(self.open.pop(k))
            start += size

    def close(self):
        """Lay the unfinished sequences end to end; at most ``capacity`` tokens a class are left."""
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p[2]) for p in rest)
        row, room = [], self._room(left)
        for id, start, ids, total in rest:
            while len(ids):
                take = min(room, len(ids))
                row.append((id, start, ids[:take], total))
                start, ids, room, left = start + take, ids[take:], room - take, left - take
                if not room:
                    self._emit(row)
                    row, room = [], self._room(left)

    def _room(self, left: int) -> int:
        return min(self.capacity, 1 << (left.bit_length() - 1)) if left else 0


class Ids:
    """Token ids of a worker's pre-tokens, as the tokenizers library gives them."""

    def __init__(self, source: str):
        self.tokenizer = load(source)
        self.special = special_strings(source)
        self.cache = Cache(self._make, self._clear)

    def _clear(self):
        self.flat = np.zeros(0, np.uint32)
        self.begin = np.zeros(1, np.int64)

    def _make(self, pieces: list[str]):
        tokenize = self.tokenizer.model.tokenize
        new = [[t.id for t in tokenize(as_letters(p))] for p in pieces]
        self.flat = np.concatenate([self.flat, np.array([i for ids in new for i in ids], np.uint32)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(ids) for ids in new])])

    def of(self, column: pa.Array, words: bool) -> Iterator[np.ndarray]:
        pieces = Pieces(column, words, self.special)
        numbers = self.cache.find(pieces.hashes, pieces.text)
        sizes = self.begin[numbers + 1] - self.begin[numbers]
        ahead = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=ahead[1:])
        flat = self.flat[np.arange(ahead[-1]) + np.repeat(self.begin[numbers] - ahead[:-1], sizes)]
        at = ahead[pieces.bounds]
        for d in range(pieces.n_docs):
            if pieces.odd[d]:
                yield np.array(self.tokenizer.encode(pieces.document(d), add_special_tokens=False).ids, np.uint32)
            else:
                yield flat[at[d]:at[d + 1]]


_WORKER: dict[int, Ids] = {}


def worker(source: str) -> Ids:
    key = hash(source)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Ids(source)
    return _WORKER[key]


def pack(docs: DataFrame, tokenizer_file: str, closing_id: int, capacity: int = 2048, waste: int = 32, id: str = "doc_id", text: str = "text",
         words: bool = False) -> DataFrame:
    """One row per piece: its document, first id, ids (little-endian unsigned 32-bit), the document's ids, its sequence and place there.

    ``closing_id`` ends each document.  ``waste`` bounds the tokens that a full sequence of one class may leave empty."""
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file
    slim = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = worker(shared.value)
        packed = Sequences(capacity, waste, TaskContext.get().partitionId() << TASK_BITS)
        end = np.array([closing_id], "<u4")
        ids_type = None
        for batch in batches:
            ids_type = batch.schema.field("id").type
            for part in slices(batch, "text"):
                for name, ids in zip(part.column("id").to_pylist(), ids_of.of(part.column("text"), words)):
                    packed.add(name, np.concatenate([ids.astype("<u4", copy=False), end]))
                    if len(packed.rows) >= 4096:
                        yield _batch(packed, ids_type)
                yield _batch(packed, ids_type)
        if ids_type is not None:
            packed.close()
            yield _batch(packed, ids_type)

    return slim.mapInArrow(run, PACKED.format(id=kind)).withColumnRenamed("id", id)


def _batch(packed: Sequences, ids_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*packed.rows)) or [[]] * 7
    packed.rows = []
    kinds = [ids_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)
