"""Token counts, byte pairs and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from roadsift.llm import bpe, packing, tokens  # noqa: E402
from roadsift.llm.lexicon import Pieces, as_letters  # noqa: E402

from .cases import SCHEMA, documents  # noqa: E402

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


@pytest.mark.parametrize("path,words", [(WORDS, True), (BYTES, False)])
def test_pieces_are_the_librarys(path, words):
    r, t = random.Random(1), library(path)
    odd = ["'", "'s", "'RE", " ", "\n", "  ", " ", "\x85", "\x1c", "a", "É", "1", "²", "!", "ß", "ª"] + [chr(c) for c in range(1, 768)]
    texts = [None, ""] + ["".join(r.choice(odd[:16] if r.random() < 0.9 else odd) for _ in range(r.randint(1, 40))) for _ in range(1500)]
    pieces = Pieces(pa.array(texts), words, ["<|endoftext|>"])
    for d, text in enumerate(texts):
        if not pieces.odd[d]:
            text = t.normalizer.normalize_str(text or "") if t.normalizer else text or ""
            assert [as_letters(pieces.text(i)) for i in range(pieces.bounds[d], pieces.bounds[d + 1])] == [p for p, _ in t.pre_tokenizer.pre_tokenize_str(text)], repr(text)


@pytest.mark.parametrize("bits", [4, 17])
def test_counts_whatever_the_frequent_table_holds(spark, bits):
    rows, t = documents(), library(WORDS)
    got = tokens.token_counts(spark.createDataFrame(rows, SCHEMA).repartition(3), WORDS, limit=100, bits=bits, sample_rows=5).collect()
    want = sorted(((r[0] is not None, r[0] or 0, len((r[1] or "").encode()), n := len(t.encode(r[1] or "", add_special_tokens=False).ids), n > 100) for r in rows))
    assert sorted((r[0] is not None, r[0] or 0, r[1], r[2], r[3]) for r in got) == want


def test_bpe_round_trip(spark):
    rows, t = documents(), library(WORDS)
    got = {(r["doc_id"], r["ids"], r["decoded"], r["n_tokens"]) for r in bpe.encode_decode(spark.createDataFrame(rows, SCHEMA), WORDS).collect()}
    want = set()
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want.add((r[0], " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False), len(ids)))
    assert got == want


def test_packing_keeps_every_id_once_and_pads_little(spark):
    rows, t = documents(), library(BYTES)
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(2), BYTES, closing_id=1, capacity=256, waste=4).collect()
    of, sequences = {}, {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [1]
        pieces = sorted(of[r[0]], key=lambda p: p["start"])
        assert np.concatenate([np.frombuffer(p["ids"], "<u4") for p in pieces]).tolist() == ids
        assert [p["start"] for p in pieces] == np.cumsum([0, *[p["length"] for p in pieces[:-1]]]).tolist()
        assert all(p["doc_tokens"] == len(ids) and len(p["ids"]) == 4 * p["length"] > 0 for p in pieces)
    total = padding = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
        total, padding = total + at, padding + (256 - at if at & (at - 1) else 0)
    assert padding < 0.02 * total


def test_harmonic_cuts():
    for n in range(1, 5000):
        out = packing.cuts(n, 2048, 32)
        assert sum(out) == n and min(out) > 0 and max(out) <= 2048


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tokens.token_counts(empty, WORDS).collect() == bpe.encode_digests(empty, WORDS).collect() == packing.pack(empty, BYTES, 1).collect() == []
    assert zlib.crc32(b"") == 0
