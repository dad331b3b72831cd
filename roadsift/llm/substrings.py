"""Removal of repeated word windows by super-k-mer partitioning.

A window is ``size`` words of one document.  The minimiser of a window is the smallest hash of the ``inner`` consecutive words in
it; neighbouring windows with the same minimiser travel as one packed string of words to the bucket of that minimiser.  A bucket
holds every copy of its windows, sorts them, and finds for each the smallest id.  Before they travel, equal strings of a batch are
reduced to those of the smallest id, so a passage that a third of all documents share stays small everywhere.

Defined results: a null or empty text has no words; ids are integers, and rows with a null id neither lose words nor take any; rows
with the same id don't take words from each other; repeated rows each give one row; an empty table gives an empty one; columns
other than the two named are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadsift.llm.text import Words, mixed, slices, squeeze, unsqueeze, window_hashes

BATCH = 12 << 20  # bytes of text whose strings are reduced and packed together
PIECE = 1 << 20  # bytes of text hashed at once; hashing takes many bytes for one of text
BUCKET = 4 << 20  # bytes of text to a bucket at most, on average
PART = 1 << 19  # windows of a bucket that are sorted at once
TASK = 64 << 20  # bytes of text to a task, where the session's shuffle partitions would make it more
ZSTD = pa.Codec("zstd", 6)
KEY = struct.Struct("<qi")
HIDDEN = np.uint64(2**64 - 1)
FLAGS = "id long, content int, ranges binary"


def plain_bytes(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a slice joined by one space: bytes, and first and last border of each word."""
    keep = words.inside.copy()
    follows = np.flatnonzero(words.doc[1:] == words.doc[:-1]) if len(words.doc) else np.zeros(0, np.int64)
    between = words.ends[follows]
    keep[between] = True
    data = words.data.copy()
    data[between] = 32
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return data[keep], place[words.starts], place[words.ends]


def minimisers(words: Words, size: int, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """The least inner hash of the window from each word on, and whether that window lies in one document."""
    parts, _ = window_hashes(words.hashes, words.doc, inner)
    _, whole = window_hashes(words.hashes, words.doc, size)
    n = len(parts)
    least = np.full(n, HIDDEN)
    if n >= size:
        span = n - size + 1
        least[:span] = parts[:span]
        for k in range(1, size - inner + 1):
            np.minimum(least[:span], parts[k:span + k], out=least[:span])
    return least, whole


class Strings:
    """Super-k-mers of some slices: owner, first word, number of windows, bucket and bytes."""

    def __init__(self, size: int, inner: int):
        self.size, self.inner, self.bytes = size, inner, 0
        self.parts: list[tuple] = []
        self.data: list[np.ndarray] = []

    def add(self, part: pa.RecordBatch):
        words = Words(part.column("text"))
        ids = part.column("id")
        valid = ~np.asarray(ids.is_null())
        number = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        content = part.column("content").to_numpy(zero_copy_only=False).astype(np.int64)
        data, starts, ends = plain_bytes(words)
        least, whole = minimisers(words, self.size, self.inner)
        at = np.flatnonzero(whole & valid[words.doc])
        if len(at):
            new = np.append(True, (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]]) | (words.doc[at[1:]] != words.doc[at[:-1]]))
            run = np.flatnonzero(new)
            # longer runs are cut, so that the first and the last window hold every word of a string
            length = np.diff(np.append(run, len(at)))
            pieces = -(-length // (self.size + 1))
            inside = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = at[np.repeat(run, pieces)] + inside * (self.size + 1)
            n = np.minimum(np.repeat(length, pieces) - inside * (self.size + 1), self.size + 1)
            last = first + n + self.size - 2
            doc = words.doc[first]
            windows, _ = window_hashes(words.hashes, words.doc, self.size)
            same = mixed(windows[first] * np.uint64(3) + windows[first + n - 1] + n.astype(np.uint64))
            self.parts.append((number[doc], content[doc], first - words.bounds[doc], n, least[first], same, starts[first] + self.bytes, ends[last] - starts[first]))
        self.data.append(data)
        self.bytes += len(data)

    def rows(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """One compressed block for each bucket with strings, and local findings under the bucket of the smallest one."""
        if not self.parts:
            return
        ids, content, first, n, least, same, start, size = (np.concatenate(c) for c in zip(*self.parts))
        data = np.concatenate(self.data)
        raw = data.tobytes()
        order = np.lexsort((ids, same))
        same_sorted = same[order]
        group = np.cumsum(np.append(False, same_sorted[1:] != same_sorted[:-1]))
        lead = order[np.searchsorted(group, group)]  # of each sorted string, the one with the smallest id
        later = ids[order] > ids[lead]
        for k in np.flatnonzero(later).tolist():  # equal hashes must be equal bytes
            a, b = order[k], lead[k]
            if raw[start[a]:start[a] + size[a]] != raw[start[b]:start[b] + size[b]]:
                later[k] = False
        local, send = order[later], order[~later]
        if len(local):
            for row in flag_rows(ids[local], content[local], first[local], n[local]):
                yield -1, row
        bucket = (mixed(least[send]) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((first[send], ids[send], bucket))
        send, bucket = send[order], bucket[order]
        borders = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
        for a, b in zip(borders, [*borders[1:], len(bucket)]):
            mine = send[a:b]
            sizes = size[mine]
            flat = np.arange(sizes.sum()) + np.repeat(start[mine] - (np.cumsum(sizes) - sizes), sizes)
            columns = (np.diff(ids[mine], prepend=0), content[mine].astype(np.int32), first[mine].astype(np.int32), n[mine].astype(np.int8), sizes.astype(np.int32))
            body = b"".join([*[in_planes(c) for c in columns], data[flat].tobytes()])
            yield int(bucket[a]), struct.pack("<qq", len(mine), len(body)) + ZSTD.compress(body, asbytes=True)


def in_planes(values: np.ndarray) -> bytes:
    """First all lowest bytes, then all next ones: numbers of one size then compress well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(body: bytes, kind, count: int, at: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(body, np.uint8, count * width, at).reshape(width, count)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def unpack(block: bytes) -> tuple[np.ndarray, ...]:
    count, size = struct.unpack_from("<qq", block)
    body = ZSTD.decompress(block[16:], decompressed_size=size, asbytes=True)
    out, at = [], 0
    for kind in (np.int64, np.int32, np.int32, np.int8, np.int32):
        out.append(from_planes(body, kind, count, at))
        at += out[-1].nbytes
    out[0] = np.cumsum(out[0])
    return (*out, np.frombuffer(body, np.uint8, offset=at))


def flag_rows(ids, content, first, n) -> Iterator[bytes]:
    """Findings of one document as (id, content, pairs of first word and number of windows)."""
    order = np.lexsort((first, content, ids))
    ids, content, first, n = ids[order], content[order], first[order], n[order]
    borders = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (content[1:] != content[:-1])))
    for a, b in zip(borders, [*borders[1:], len(ids)]):
        yield KEY.pack(ids[a], content[a]) + np.stack([first[a:b], n[a:b]], 1).astype("<i4").tobytes()


def repeated_in(blocks: list[bytes], size: int) -> Iterator[bytes]:
    """Windows of a bucket that a smaller id holds too."""
    ids, content, first, n, sizes, data = (np.concatenate(c) for c in zip(*map(unpack, blocks)))
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    parts, a = [], 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE, "right")) - 1)
        here, shift = offsets[a:b + 1] - offsets[a], offsets[a]
        words = Words(pa.Array.from_buffers(pa.large_string(), b - a, [None, pa.py_buffer(here.tobytes()), pa.py_buffer(data[shift:offsets[b]].tobytes())]))
        hashes, whole = window_hashes(words.hashes, words.doc, size)
        at = np.flatnonzero(whole)
        parts.append((hashes[at], (words.doc[at] + a).astype(np.int32), (at - words.bounds[words.doc[at]]).astype(np.int32),
                      words.starts[at] + shift, (words.ends[at + size - 1] - words.starts[at]).astype(np.int32)))
        a = b
    raw = data.tobytes()
    columns = [np.concatenate(c) for c in zip(*parts)]
    del parts, data
    # windows of a bucket are dealt by their hash, so that sorting takes little beside the windows themselves
    rounds = max(1, len(columns[0]) // PART)
    for k in range(rounds):
        mine = np.flatnonzero(columns[0] % np.uint64(rounds) == k) if rounds > 1 else slice(None)
        yield from _repeated_windows(ids, content, first, raw, *(c[mine] for c in columns))


def _repeated_windows(ids, content, first, raw: bytes, hashes, owner, place, begin, length) -> Iterator[bytes]:
    order = np.argsort(hashes, kind="stable")
    sorted_hashes = hashes[order]
    borders = np.flatnonzero(np.append(True, sorted_hashes[1:] != sorted_hashes[:-1]))
    counts = np.diff(np.append(borders, len(order)))
    order, counts = order[np.repeat(counts > 1, counts)], counts[counts > 1]
    if not len(order):
        return
    borders = np.cumsum(counts) - counts
    owner, place = owner[order], place[order]
    begin, end = begin[order].tolist(), (begin[order] + length[order]).tolist()
    lead = np.repeat(borders, counts).tolist()
    if all(raw[x:y] == raw[begin[k]:end[k]] for x, y, k in zip(begin, end, lead)):
        least = np.repeat(np.minimum.reduceat(ids[owner], borders), counts)
    else:  # different words with one hash: tell them apart by their bytes
        smallest: dict[bytes, int] = {}
        texts = [raw[x:y] for x, y in zip(begin, end)]
        for t, i in zip(texts, ids[owner].tolist()):
            smallest[t] = min(i, smallest.get(t, i))
        least = np.array([smallest[t] for t in texts])
    late = ids[owner] > least
    if late.any():
        who = owner[late]
        yield from flag_rows(ids[who], content[who], first[who] + place[late], np.ones(len(who), np.int64))


def covered(ranges: list[bytes], n_words: int, size: int) -> np.ndarray:
    """Which words lie in a flagged window."""
    edge = np.zeros(n_words + 1, np.int64)
    for r in ranges:
        pairs = np.frombuffer(r, "<i4").reshape(-1, 2)
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, pairs[:, 0] + pairs[:, 1] + size - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_windows(docs: DataFrame, id: str, text: str, size: int = 13, inner: int = 3) -> DataFrame:
    """For each id and text content, the windows whose words also start in a document with a smaller id."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    buckets, tasks = max(2 * partitions, -(-total // BUCKET)), -(-total // TASK)
    slim = docs.where(F.col(text).isNotNull() & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.hash(text).alias("content"), F.col(text).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = Strings(size, inner)
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                strings.add(part)
                if strings.bytes >= BATCH:
                    yield from _blocks(strings, buckets)
                    strings = Strings(size, inner)
        yield from _blocks(strings, buckets)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for batch in batches:
            for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist()):
                if bucket != now:
                    if blocks:
                        yield _flags(repeated_in(blocks, size))
                    now, blocks = bucket, []
                if bucket < 0:
                    yield _flags([block])
                else:
                    blocks.append(block)
        if blocks:
            yield _flags(repeated_in(blocks, size))

    packed = slim.mapInArrow(cut, "bucket long, spread long, block binary")
    # local findings go everywhere, strings to the task of their bucket
    dealt = (packed.repartition("spread") if tasks <= partitions else packed.repartition(tasks, "spread")).sortWithinPartitions("bucket")
    return dealt.select("bucket", "block").mapInArrow(match, FLAGS)


def _blocks(strings: Strings, buckets: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    total = 0
    for k, (bucket, block) in enumerate(strings.rows(buckets)):
        rows.append((bucket, bucket if bucket >= 0 else k % buckets, block))
        total += len(block)
        if total > 8 << 20:
            yield _block_batch(rows)
            rows, total = [], 0
    if rows:
        yield _block_batch(rows)


def _block_batch(rows):
    a, b, c = zip(*rows)
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], ["bucket", "spread", "block"])


def _flags(rows) -> pa.RecordBatch:
    rows = list(rows)
    keys = [KEY.unpack_from(r) for r in rows]
    return pa.record_batch([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array([r[KEY.size:] for r in rows], pa.binary())],
                           ["id", "content", "ranges"])


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 13, inner: int = 3, as_it_was: bool = False) -> DataFrame:
    """``row`` (all columns of ``docs`` but the text), ``n_words``, ``n_removed`` and ``kept``: the words left, joined by one space.

    With ``as_it_was`` a text that loses nothing is kept with its white space, and a null one stays null."""
    flags = repeated_windows(docs, id, text, size, inner).groupBy("id", "content").agg(F.collect_list("ranges").alias("ranges"))
    slim = docs.select(F.struct(*[c for c in docs.columns if c != text]).alias("row"), F.col(text).cast("string").alias("text"),
                       F.col(id).cast("long").alias("owner"), F.hash(text).alias("held"))

    def smaller(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = batch.column("text").is_valid()
            yield pa.record_batch([batch.column("row"), squeeze(batch.column("text")), there, batch.column("owner"), batch.column("held")], ["row", "text", "there", "owner", "held"])

    kinds = T.StructType().add("row", slim.schema["row"].dataType).add("text", "binary").add("there", "boolean").add("owner", "long").add("held", "integer")
    slim = slim.mapInArrow(smaller, kinds)
    joined = slim.join(flags, (F.col("owner") == F.col("id")) & (F.col("held") == F.col("content")), "left").select("row", "text", "there", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = pa.record_batch([batch.column("row"), unsqueeze(batch.column("text")), batch.column("there"), batch.column("ranges")], ["row", "text", "there", "ranges"])
            for part in slices(batch, "text", PIECE):
                own = zip(part.column("text").to_pylist(), part.column("there").to_pylist()) if as_it_was else None
                words = Words(part.column("text"))
                data, starts, ends = plain_bytes(words)
                bounds = words.bounds
                removed = np.zeros(words.n_docs, np.int64)
                whole, texts = data.tobytes(), []
                for d, ranges in enumerate(part.column("ranges").to_pylist()):
                    a, b = int(bounds[d]), int(bounds[d + 1])
                    if own is not None:
                        before, there = next(own)
                    if own is not None and not ranges:
                        texts.append(before if there else None)
                    elif ranges:
                        gone = covered(ranges, b - a, size)
                        removed[d] = int(gone.sum())
                        texts.append(b" ".join([whole[starts[a + k]:ends[a + k]] for k in np.flatnonzero(~gone).tolist()]).decode())
                    else:
                        texts.append(whole[starts[a]:ends[b - 1]].decode() if b > a else "")
                yield pa.record_batch([part.column("row"), pa.array(np.diff(bounds)), pa.array(removed), pa.array(texts, pa.string())],
                                      ["row", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, T.StructType().add("row", slim.schema["row"].dataType).add("n_words", "long").add("n_removed", "long").add("kept", "string"))
