"""Vectorised text helpers for Arrow batches: word borders, word hashes, windows.

Everything works on flat numpy arrays of a slice of at most ``SLICE`` bytes of text (a longer document is a slice of its own),
so the memory of a task follows its longest document and not its partition.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
LOW = 1 << 16

# fixed values: the white space between words, code points 9 to 13 and 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


POWERS = _powers(BASE, LOW)
HIGH_BASE = np.uint64(pow(int(BASE), LOW, 1 << 64))
UNITS = mixed(np.arange(1, 1025, dtype=np.uint64) * BASE)


def unit_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each segment that begins at ``starts``; ``values`` holds a scrambled value per unit, 0 where it doesn't count."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    begin = int(starts[0])
    lengths = np.diff(np.append(starts, len(values)))
    position = np.arange(begin, len(values)) - np.repeat(starts, lengths)
    if int(lengths.max()) <= LOW:
        weights = POWERS[position]
    else:
        high = position >> 16
        weights = POWERS[position & (LOW - 1)] * _powers(HIGH_BASE, int(high.max()) + 1)[high]
    return mixed(np.add.reduceat(values[begin:] * weights, starts - begin))


def unused(df, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` is called so, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = "_" + name
        taken.add(name)
        out.append(name)
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[int(offsets[0]):int(offsets[-1])], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most`` bytes of text; one row is never cut."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    begin, n = 0, batch.num_rows
    while begin < n:
        before = int(total[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


ZSTD = pa.Codec("zstd", 3)


def squeeze(column: pa.Array) -> pa.Array:
    """Texts as compressed binary, null as empty: a shuffle's own compression saves little on text."""
    texts = [t.as_buffer() if t.is_valid else b"" for t in column.cast(pa.binary())]
    return pa.array([struct.pack("<q", len(t)) + ZSTD.compress(t, asbytes=True) for t in texts], pa.binary())


def unsqueeze(column: pa.Array) -> pa.Array:
    sizes = [(t, struct.unpack_from("<q", t)[0]) for t in column.to_pylist()]
    return pa.array([ZSTD.decompress(t[8:], decompressed_size=n, asbytes=True) if n else b"" for t, n in sizes], pa.binary()).cast(pa.string())


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice: byte borders, the document of each, and their hashes."""

    def __init__(self, column: pa.Array, lower: bool = False, blank: np.ndarray = IS_SPACE):
        self.data, self.offsets = utf8(column)
        self.n_docs = len(self.offsets) - 1
        self.inside = inside = ~blank[self.data]
        before = np.empty(len(inside), bool)
        if len(inside):
            before[0] = False
            before[1:] = inside[:-1]
            before[self.offsets[:-1][self.offsets[:-1] < len(inside)]] = False  # a document starts a word of its own
        self.starts = np.flatnonzero(inside & ~before)
        self.bounds = np.searchsorted(self.starts, self.offsets)  # words of document d: bounds[d] to bounds[d + 1]
        self.hashes = self.hashed(lower)
        lengths = np.add.reduceat(inside.astype(np.int64), self.starts) if len(self.starts) else np.zeros(0, np.int64)
        self.ends = self.starts + lengths
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.bounds))

    def hashed(self, lower: bool) -> np.ndarray:
        values = UNITS[LOWER[self.data] if lower else self.data]
        values[~self.inside] = 0
        return unit_hashes(values, self.starts)

    def per_doc(self, marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Sums of ``marks`` between neighbouring ``bounds``."""
        total = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=total[1:])
        return np.diff(total[bounds])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``size`` words from each word on, and whether they lie in one document."""
        return window_hashes(self.hashes, self.doc, size)


def window_hashes(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes)
    whole = np.zeros(n, bool)
    if n < size:
        return np.zeros(n, np.uint64), whole
    whole[:n - size + 1] = doc[:n - size + 1] == doc[size - 1:]
    out = np.zeros(n, np.uint64)
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total = total * HIGH_BASE + hashes[k:n - size + 1 + k]
    out[:n - size + 1] = mixed(total)
    return out, whole
