"""Removal of repeated byte strings with suffix arrays of content-defined shards.

A window is ``size`` bytes of one text.  Its anchor is the least hash of the ``inner`` bytes long grams in it, so equal windows have equal
anchors wherever they stand; neighbouring windows with one anchor travel as one string.  Equal strings are reduced to one that knows
it occurs more than once, first in each batch and then by hash (128 bits).  Strings that share their anchor with a different one, or that
hold it twice, meet in a shard, whose suffix array with common prefixes (``suffixes``) finds the windows that start more than once.

Shards are sized by bytes.  An anchor with very many different strings (a line that stands in many contexts) is split: its strings are cut
again where the greatest and another least hash of the window change, and go to the shard of all three.

Defined results: a null or empty text has no bytes; texts shorter than a window lose nothing; every row is a document, so repeated ids and
rows take windows from each other; what is kept is bytes, as a cut may fall into a character; an empty table gives an empty one; columns
other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadsift.functions.durable import shared_path, stored
from roadsift.llm.suffixes import Scratch, suffix_array
from roadsift.llm.text import BASE, UNITS, mixed, slices, squeeze, unsqueeze, utf8

BATCH = 12 << 20  # bytes of text whose strings are reduced together
LONGEST = 512  # windows of a string
MEMORY = 64 << 20  # bytes of suffix tuples that a task holds before they go to the scratch folder
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
OTHER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
LARGEST = np.uint64(2**64 - 1)
STRINGS = "local boolean, h1 long, h2 long, anchor long, key long, size long, first int, n int, many boolean, again boolean"
FOUND = "flag boolean, anchor long, key long, size long, first int, n int, many boolean, again boolean"
FLAGS = ["key", "size", "first", "n"]


class Hashes:
    """Hashes of any stretch of a slice's bytes, from sums of prefixes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers, inverse = np.full(n + 1, BASE, np.uint64), np.full(n + 1, INVERSE, np.uint64)
        powers[0] = inverse[0] = 1
        powers, self.inverse = np.cumprod(powers, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
        self.sums = []
        for units in (UNITS[:256], OTHER):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(units[data] * powers[:n], dtype=np.uint64, out=total[1:])
            self.sums.append(total)

    def of(self, start, end, which: int = 0) -> np.ndarray:
        return mixed((self.sums[which][end] - self.sums[which][start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        total = self.sums[0]
        return mixed((total[size:] - total[:-size]) * self.inverse[:len(total) - size]) if len(total) > size else np.zeros(0, np.uint64)


def least_of(values: np.ndarray, span: int) -> np.ndarray:
    """The least of the ``span`` values from each place on."""
    n, width, out = len(values) - span + 1, 1, values
    if n <= 0:
        return values[:0]
    while 2 * width <= span:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[:n], out[span - width:span - width + n])


def whole_windows(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text, and that text's number."""
    lengths = np.maximum(np.diff(offsets) - size + 1, 0)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return offsets[:-1][doc] + inside, doc


def runs_of(at: np.ndarray, doc: np.ndarray, *labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and length of the runs of neighbouring windows with equal labels, cut at ``LONGEST``."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = doc[1:] != doc[:-1]
    for label in labels:
        new |= label[1:] != label[:-1]
    run = np.flatnonzero(np.append(True, new))
    length = np.diff(np.append(run, len(at)))
    pieces = -(-length // LONGEST)
    inside = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(run, pieces) + inside * LONGEST
    return first, np.minimum(np.repeat(length, pieces) - inside * LONGEST, LONGEST)


def strings_of(part: pa.RecordBatch, size: int, inner: int) -> dict[str, np.ndarray]:
    """The strings of a slice of texts."""
    data, offsets = utf8(part.column("text"))
    hashes = Hashes(data)
    grams = hashes.grams(inner)
    span = size - inner + 1
    at, doc = whole_windows(offsets, size)
    least = least_of(grams, span)[at]
    run, n = runs_of(at, doc, least)
    first = at[run]
    # how often a string's grams have the anchor's hash
    lengths = n + span - 1
    places = np.arange(lengths.sum()) + np.repeat(first - (np.cumsum(lengths) - lengths), lengths)
    hits = np.add.reduceat((grams[places] == np.repeat(least[run], lengths)).astype(np.int64), np.cumsum(lengths) - lengths) if len(run) else n
    end = first + n + size - 1
    keys = [part.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[doc[run]] for c in ("key", "size")]
    return {"h1": hashes.of(first, end), "h2": hashes.of(first, end, 1), "anchor": least[run], "key": keys[0], "size": keys[1], "first": first - offsets[:-1][doc[run]],
            "n": n, "again": hits > 1}


def reduced(parts: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
    """All strings of a batch: the first of equal ones, and the others as local repeats."""
    s = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    order = np.lexsort((s["first"], s["key"], s["h2"], s["h1"]))
    s = {c: v[order] for c, v in s.items()}
    local = np.append(False, (s["h1"][1:] == s["h1"][:-1]) & (s["h2"][1:] == s["h2"][:-1]))[:len(order)]
    many = np.append(local[1:], False)[:len(order)]
    signed = lambda v: pa.array(v.view(np.int64))
    return pa.record_batch({"local": pa.array(local), "h1": signed(s["h1"]), "h2": signed(s["h2"]), "anchor": signed(s["anchor"]), "key": pa.array(s["key"]),
                            "size": pa.array(s["size"]), "first": pa.array(s["first"].astype(np.int32)), "n": pa.array(s["n"].astype(np.int32)),
                            "many": pa.array(many), "again": pa.array(s["again"])})


def cut_strings(slim: DataFrame, size: int, inner: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                parts.append(strings_of(part, size, inner))
                held += part.column("text").nbytes
                if held >= BATCH:
                    yield reduced(parts)
                    parts, held = [], 0
        if parts:
            yield reduced(parts)

    return slim.mapInArrow(cut, STRINGS)


def equal_strings(strings: DataFrame) -> DataFrame:
    """Of each group of equal strings one, with ``many`` where there are more, and a flag for every string that has equals."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_equal = None, False  # the last string, whose equals may be in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch])
            h1, h2 = (rows[c].to_numpy() for c in ("h1", "h2"))
            before = np.append(held_equal, (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1]))  # equals the string before
            last = rows.num_rows - 1
            yield from settled(rows.slice(0, last), before[:last], before[1:])
            held, held_equal = rows.slice(last).combine_chunks().to_batches()[0], bool(before[last])
        if held is not None:
            yield from settled(pa.Table.from_batches([held]), np.array([held_equal]), np.array([False]))

    def settled(rows: pa.Table, before: np.ndarray, after: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        many = before | after | rows["many"].to_numpy()
        one = ~before
        columns = {c: rows[c].combine_chunks() for c in ("anchor", "key", "size", "first", "n")}
        for mask, flag in ((many, True), (one, False)):
            where = pa.array(np.flatnonzero(mask))
            if len(where):
                out = {"flag": pa.array(np.full(len(where), flag))} | {c: v.take(where) for c, v in columns.items()}
                yield pa.record_batch(out | {"many": pa.array(many[mask]), "again": rows["again"].combine_chunks().take(where)})

    sent = strings.where("NOT local").drop("local").repartition("h1", "h2").sortWithinPartitions("h1", "h2", "key", "first")
    return sent.mapInArrow(match, FOUND)


def compared(found: DataFrame, slim: DataFrame, size: int, inner: int, shard_bytes: int) -> DataFrame:
    """Flags of the windows that start more than once in their shard."""
    spark = found.sparkSession
    one = found.where("NOT flag")
    anchors = one.groupBy("anchor").agg(F.count("*").alias("n_strings")).where("n_strings > 1")
    wanted = one.join(anchors, "anchor", "left").where("n_strings > 1 OR again")
    hot = F.coalesce(F.col("n_strings"), F.lit(1)) * (2 * size) > shard_bytes // 2
    wanted = stored(wanted.select("key", "size", "first", "n", "anchor", "many", hot.alias("hot")), "wanted-strings")
    total = wanted.agg(F.sum(F.col("n") + size - 1)).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    lists = wanted.groupBy("key", "size").agg(F.collect_list(F.struct("first", "n", "anchor", "many", "hot")).alias("wanted"))
    texts = squeezed(slim).join(lists, ["key", "size"])
    span = size - inner + 1

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = unsqueeze(batch.column("text"))
            rows: list[tuple] = []
            held = 0
            for key, length, text, wanted in zip(batch.column("key").to_pylist(), batch.column("size").to_pylist(), texts, batch.column("wanted").to_pylist()):
                raw = text.as_buffer().to_pybytes()
                for w in wanted:
                    a, n = w["first"], w["n"]
                    for first, count, shard in _recut(raw, a, n, w["anchor"]) if w["hot"] else [(a, n, w["anchor"])]:
                        rows.append((shard % shards, key, length, first, count, w["many"], raw[first:first + count + size - 1]))
                        held += count + size
                if held > 8 << 20:
                    yield _string_batch(rows)
                    rows, held = [], 0
            if rows:
                yield _string_batch(rows)

    def _recut(raw: bytes, first: int, n: int, anchor: int) -> Iterator[tuple[int, int, int]]:
        grams = Hashes(np.frombuffer(raw, np.uint8, n + size - 1, first)).grams(inner)
        second, third = LARGEST - least_of(LARGEST - grams, span), least_of(mixed(grams), span)
        run, length = runs_of(np.arange(n), np.zeros(n, np.int64), second, third)
        shard = mixed(second[run] * np.uint64(3) + third[run] + np.array([anchor], np.int64).view(np.uint64))
        return zip((first + run).tolist(), length.tolist(), shard.view(np.int64).tolist())

    scratch = shared_path(spark, "suffixes")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            borders = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist() if len(shard) else []
            for a, b in zip(borders, [*borders[1:], len(shard)]):
                if shard[a] != now:
                    if held:
                        yield repeated_in(held, size, scratch)
                    now, held = shard[a], []
                held.append(batch.slice(a, b - a))
        if held:
            yield repeated_in(held, size, scratch)

    picked = texts.mapInArrow(pick, "shard long, key long, size long, first int, n int, many boolean, data binary")
    dealt = picked.repartition("shard").sortWithinPartitions("shard", "key", "size", "first")
    return dealt.mapInArrow(meet, "key long, size long, first int, n int")


def _string_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["shard", "key", "size", "first", "n", "many", "data"])


def repeated_in(batches: list[pa.RecordBatch], size: int, folder: str, memory: int = MEMORY) -> pa.RecordBatch:
    """Runs of windows of a shard's single strings that start more than once in it."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    key, length, first, n = (rows[c].to_numpy().astype(np.int64) for c in ("key", "size", "first", "n"))
    many = rows["many"].to_numpy()
    data = rows["data"].combine_chunks()
    _, offsets, body = data.buffers()
    offsets = np.frombuffer(offsets, np.int32 if data.type == pa.binary() else np.int64)[data.offset:data.offset + len(data) + 1].astype(np.int64)
    body = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    # every string ends in symbol 1, the shard in symbol 0; repeated rows of one document count once here, as they have been counted as equals
    text = np.zeros(len(body) + len(n) + 1, np.uint16)
    starts = offsets[:-1] + np.arange(len(n))
    inside = np.ones(len(text), bool)
    inside[offsets[1:] + np.arange(len(n))] = inside[-1] = False
    text[inside] = body
    text[inside] += 2
    text[offsets[1:] + np.arange(len(n))] = 1
    scratch = Scratch(folder, memory)
    again = np.zeros(len(text), bool)
    try:
        last = -1
        for positions, shared in suffix_array(text, size, scratch).read():
            equal = shared >= size
            again[positions[equal]] = True
            again[np.append(last, positions[:-1])[equal]] = True
            last = positions[-1]
    finally:
        scratch.close()
    again[:-1] &= inside[:-1]
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    hit = again[starts[owner] + place] & ~many[owner]
    owner, place = owner[hit], place[hit]
    new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1))) if len(owner) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(owner)))
    who = owner[new]
    return pa.record_batch({"key": pa.array(key[who]), "size": pa.array(length[who]), "first": pa.array((first[who] + place[new]).astype(np.int32)),
                            "n": pa.array(count.astype(np.int32))})


def squeezed(slim: DataFrame) -> DataFrame:
    """With compressed texts, as they are to be shuffled."""
    names = slim.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([squeeze(batch.column(c)) if c == "text" else batch.column(c) for c in names], names)

    return slim.mapInArrow(run, T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "text" else f.dataType) for f in slim.schema]))


def remove_repeated_bytes(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 400, inner: int = 64, shard_bytes: int = 4 << 20) -> DataFrame:
    """``row`` (all columns of ``docs`` but the text), ``n_bytes``, ``n_removed``, ``spans`` (removed bytes, end exclusive) and ``kept`` (binary)."""
    content = F.col(text).cast("string")
    keys = [F.xxhash64(F.col(id), content).alias("key"), F.octet_length(content).cast("long").alias("size")]
    slim = docs.where(F.octet_length(content) >= size).select(*keys, content.alias("text"))
    strings = stored(cut_strings(slim, size, inner), "strings")
    found = stored(equal_strings(strings), "equal-strings")
    flags = (strings.where("local").select(*FLAGS).unionByName(found.where("flag").select(*FLAGS))
             .unionByName(compared(found, slim, size, inner, shard_bytes)))
    flags = flags.groupBy("key", "size").agg(F.collect_set(F.struct("first", "n")).alias("flags"))
    whole = squeezed(docs.select(F.struct(*[c for c in docs.columns if c != text]).alias("row"), *keys, content.alias("text")))
    joined = whole.join(flags, ["key", "size"], "left").select("row", "text", "flags")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for t, flagged in zip(unsqueeze(batch.column("text")), batch.column("flags")):
                raw = np.frombuffer(t.as_buffer(), np.uint8)
                starts, ends = removed_spans(flagged, len(raw), size)
                gone = np.zeros(len(raw) + 1, np.int8)
                gone[starts], gone[ends] = 1, -1
                left = raw[np.cumsum(gone[:-1]) == 0] if len(starts) else raw
                sizes.append(len(raw))
                removed.append(len(raw) - len(left))
                spans.append([{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist())])
                kept.append(left.tobytes())
            yield pa.record_batch([batch.column("row"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                                  ["row", "n_bytes", "n_removed", "spans", "kept"])

    span = T.StructType().add("start", "long").add("end", "long")
    out = T.StructType().add("row", whole.schema["row"].dataType).add("n_bytes", "long").add("n_removed", "long").add("spans", T.ArrayType(span)).add("kept", "binary")
    return joined.mapInArrow(run, out)


def removed_spans(flags: pa.Scalar, n_bytes: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that flagged windows cover."""
    if not flags.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, n = (flags.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
    edge = np.zeros(n_bytes + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + n + size - 1, -1)
    inside = np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8)
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
