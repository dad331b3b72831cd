"""Alignment of two tokenizers over the same text.

Both encode the text with one blank before it; each token then covers a range of bytes.  The cumulative ends of either side are the keys of
a dictionary from end to token index; the intersection of the two key sets, sorted, cuts both id lists into groups, and in each
group the tokens that end at its key are linked.  A pair's count is the number of its links in the whole corpus.

In a link the bytes of one token are a suffix of the other's, so the number of different pairs is bounded by the lengths of the
vocabularies' entries added up (a few hundred thousand), whatever the corpus; only this table of counts is broadcast.

Long texts are encoded in parts, cut before a blank that follows a character other than white space: there neither side has a token across.

Defined results: texts that are null or empty, or whose tokens don't give back their bytes on either side, have no tokens, no groups and
zeros; special tokens' strings in a text are plain text; every row gives one row, repeated ids and rows included, and counts as often as it
occurs; a null id stays null; an empty table gives an empty one; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadsift.functions.durable import stored
from roadsift.llm.lexicon import Cache
from roadsift.llm.packing import Ids
from roadsift.llm.text import UNITS, slices, unit_hashes, utf8

PART = 1 << 20
HELD = 1 << 22  # links that are counted at once, 8 bytes each
CUT = re.compile(r"(?<=\S) ")
ZSTD = pa.Codec("zstd", 1)
BLANK = "▁"  # fixed value: stands for a blank in the second vocabulary
ALIGNED = "id {id}, n_a long, n_b long, n_groups long, links binary, groups string"
COUNTED = "id {id}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
SPREAD = np.uint64(32)


def parts(text: str) -> Iterator[str]:
    """The text with a blank before it, in parts that each begin with a blank."""
    text, at = " " + text, 0
    while len(text) - at > PART:
        hit = CUT.search(text, at + PART)
        if hit is None:
            break
        yield text[at:hit.start()]
        at = hit.start()
    yield text[at:]


class First(Ids):
    """Byte-level pairs: ids of a worker's pre-tokens, without special tokens."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        super().__init__(source)
        self.special = []
        self.tokenizer = Tokenizer.from_str(source)  # of its own, as the setting below would hold for every user of a shared one
        self.tokenizer.encode_special_tokens = True
        vocabulary = json.loads(source)["model"]["vocab"]
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = [len(letters) for letters in vocabulary]  # one letter a byte


class Second:
    """Pieces of a model whose entries hold blanks only at their start, so that no merge reaches over a blank after another character."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(BLANK in name.lstrip(BLANK) for name in names):
            raise ValueError("a piece of this model has a blank inside")
        self.bytes = [bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace(BLANK, " ").encode() for i, name in enumerate(names)]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.blank = names.index(BLANK)
        self.cache = Cache(self._make, self._clear)

    def _clear(self):
        self.flat, self.begin, self.exact = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, bool)

    def _make(self, pieces: list[str]):
        # the model adds a blank itself, but not before an empty text
        new = [ids or [self.blank] for ids in self.model.encode([p[1:] for p in pieces], num_threads=1)]
        same = [b"".join([self.bytes[i] for i in ids]) == p.encode() for p, ids in zip(pieces, new)]
        self.exact = np.concatenate([self.exact, np.array(same, bool)])
        self.flat = np.concatenate([self.flat, np.array([i for ids in new for i in ids], np.uint32)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(ids) for ids in new])])

    def of(self, column: pa.Array) -> Iterator[np.ndarray | None]:
        """Ids of each text, None where they don't give back its bytes; every text begins with a blank."""
        data, offsets = utf8(column)
        blank = data == 32
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start[offsets[:-1]] = True
        starts = np.flatnonzero(start)
        ends, raw = np.append(starts[1:], len(data)), data.tobytes()
        numbers = self.cache.find(unit_hashes(UNITS[data], starts), lambda i: raw[starts[i]:ends[i]].decode())
        sizes = self.begin[numbers + 1] - self.begin[numbers]
        ahead = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=ahead[1:])
        flat = self.flat[np.arange(ahead[-1]) + np.repeat(self.begin[numbers] - ahead[:-1], sizes)]
        bounds = np.searchsorted(starts, offsets)
        wrong = np.zeros(len(numbers) + 1, np.int64)
        np.cumsum(~self.exact[numbers], out=wrong[1:])
        for d in range(len(offsets) - 1):
            ids = flat[ahead[bounds[d]]:ahead[bounds[d + 1]]]
            same = wrong[bounds[d]] == wrong[bounds[d + 1]] or b"".join([self.bytes[i] for i in ids.tolist()]) == raw[offsets[d]:offsets[d + 1]]
            yield ids if same else None


_WORKER: dict[tuple[int, int], tuple[First, Second]] = {}


def worker(first: str, second: bytes) -> tuple[First, Second]:
    key = hash(first), hash(second)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = First(first), Second(second)
    return _WORKER[key]


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices after the last token of each group, on both sides."""
    index_a, index_b = dict(zip(a.tolist(), range(1, len(a) + 1))), dict(zip(b.tolist(), range(1, len(b) + 1)))
    common = sorted(index_a.keys() & index_b.keys())
    return np.fromiter(map(index_a.__getitem__, common), np.int64, len(common)), np.fromiter(map(index_b.__getitem__, common), np.int64, len(common))


def written(a: np.ndarray, b: np.ndarray, until_a: np.ndarray, until_b: np.ndarray, names: list[list[str]]) -> str:
    """``a1,a2|b1;a3|b2,b3``: the groups' ids in order.  ``names`` holds every id before ``,``, before ``|`` and before ``;``."""
    group_a = np.searchsorted(until_a, np.arange(len(a)), "right")
    group_b = np.searchsorted(until_b, np.arange(len(b)), "right")
    at_a = np.arange(len(a)) + np.append(0, until_b)[group_a]
    at_b = np.arange(len(b)) + until_a[group_b]
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[until_a - 1], mark_b[until_b - 1] = 1, 2
    ids, marks = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.int64)
    ids[at_a], ids[at_b], marks[at_a], marks[at_b] = a, b, mark_a, mark_b
    flat = ids + marks * (len(names) // 3)
    return "".join([names[k] for k in flat.tolist()])[:-1]


def packed_links(a: np.ndarray, b: np.ndarray) -> bytes:
    """Linked ids, all of one side and then all of the other, by byte planes."""
    both = np.concatenate([a, b]).astype("<u4")
    planes = np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(both).to_bytes(8, "little") + ZSTD.compress(planes, asbytes=True)


def unpacked_links(links: bytes) -> np.ndarray:
    """One number for each linked pair."""
    if not links:
        return np.zeros(0, np.uint64)
    n = int.from_bytes(links[:8], "little")
    planes = np.frombuffer(ZSTD.decompress(links[8:], decompressed_size=4 * n, asbytes=True), np.uint8).reshape(4, n)
    both = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.uint64)
    return both[:n // 2] << SPREAD | both[n // 2:]


class Document:
    """What the parts of one text add up to."""

    def __init__(self, digest: bool):
        self.digest = hashlib.sha256() if digest else None
        self.n = [0, 0, 0]
        self.links: list[tuple] = []
        self.texts: list[str] = []
        self.whole = True

    def add(self, a: np.ndarray, b: np.ndarray | None, n_bytes: int, first: First, second: Second, names: list[str]):
        ends_a = np.cumsum(first.sizes[a])
        if b is None or not len(a) or ends_a[-1] != n_bytes or not self.whole:  # byte-level entries give back every byte if the number is right
            self.whole = False
            return
        until_a, until_b = common_ends(ends_a, np.cumsum(second.sizes[b]))
        text = written(a, b, until_a, until_b, names)
        if self.digest is None:
            self.texts.append(text)
        else:
            self.digest.update((";" + text if self.links else text).encode())
        self.links.append((a[until_a - 1], b[until_b - 1]))
        self.n = [x + y for x, y in zip(self.n, (len(a), len(b), len(until_a)))]

    def row(self) -> tuple:
        if not self.whole or not self.links:
            return 0, 0, 0, b"", ""
        links = packed_links(*(np.concatenate(side) for side in zip(*self.links)))
        return *self.n, links, ";".join(self.texts) if self.digest is None else self.digest.hexdigest()


def aligned(docs: DataFrame, byte_file: str, piece_file: str, id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Tokens on both sides, groups (their text, or its sha256 where ``digests``) and packed links of each text."""
    with open(byte_file, encoding="utf-8") as f, open(piece_file, "rb") as g:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))  # two vocabulary files
    slim = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = worker(*shared.value)
        most = max(len(first.sizes), len(second.sizes))
        names = [f"{k}{mark}" for mark in ",|;" for k in range(most)]
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                texts = part.column("text").to_pylist()
                pieces = [(d, p) for d, t in enumerate(texts) if t for p in parts(t)]
                found = [Document(digests) for _ in texts]
                column = pa.array([p for _, p in pieces], pa.string())
                sizes = np.diff(utf8(column)[1]).tolist() if pieces else []
                if pieces:
                    for (d, _), n, a, b in zip(pieces, sizes, first.of(column, False), second.of(column)):
                        found[d].add(a, b, n, first, second, names)
                rows = list(zip(*[x.row() for x in found])) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
                yield pa.record_batch([part.column("id"), *[pa.array(c, k) for c, k in zip(rows, kinds)]], ["id", "n_a", "n_b", "n_groups", "links", "groups"])

    return slim.mapInArrow(run, ALIGNED.format(id=slim.schema["id"].dataType.simpleString()))


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair`` (both ids in one number), its links ``n`` and whether no pair with the same second id has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = counted(unpacked_links(links.as_py()) for batch in batches for links in batch.column("links"))
        yield pa.record_batch({"pair": pa.array(pairs.view(np.int64)), "n": pa.array(n)})

    counts = rows.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "pair-counts")
    best = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(best, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def counted(links: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs and their links.  Texts wait until there are ``HELD`` links, so that what is counted isn't copied again for each text."""
    pairs, n, waiting, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
    for new in chain(links, [None]):
        if new is not None:
            waiting.append(new)
            held += len(new)
        if held and (new is None or held >= HELD):
            times = pc.value_counts(pa.array(np.concatenate(waiting)))
            pairs, n = _added(np.append(pairs, times.field("values").to_numpy()), np.append(n, times.field("counts").to_numpy()))
            waiting, held = [], 0
    return pairs, n


def _added(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new, back = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(new), np.int64)
    np.add.at(total, back, n)
    return new, total


def alignment(docs: DataFrame, byte_file: str, piece_file: str, id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Tokens ``n_a`` and ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups`` of each text.

    The texts are read and encoded once; links are kept compressed in the shared folder, counted, and read again."""
    rows = stored(aligned(docs, byte_file, piece_file, id, text, digests), "aligned")
    counts = pair_counts(rows).toArrow().sort_by("pair")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(counts[c].to_numpy() for c in ("pair", "n", "best")))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            out = []
            for links in batch.column("links"):
                at = np.searchsorted(pairs, unpacked_links(links.as_py()).view(np.int64))
                out.append((len(at), int(best[at].sum()), int(n[at].sum())))
            numbers = [pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 3
            yield pa.record_batch([*[batch.column(c) for c in ("id", "n_a", "n_b", "n_groups")], *numbers, batch.column("groups")],
                                  ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return rows.mapInArrow(look, COUNTED.format(id=rows.schema["id"].dataType.simpleString())).withColumnRenamed("id", id)
