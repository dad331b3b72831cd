"""Tokenizer alignment against the two libraries over whole texts."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from roadsift.llm import alignment

from .cases import SCHEMA, documents

FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
MORE = ["▁ is the mark of a blank", "don't stop  <s> <0x41> <|endoftext|>  end ", "tabs\tand\nlines \n  of\r\n text", "ﬁ Å ① ​x ÿ", "\n  \n x", " lead", "x ", "emoji 👩‍👩‍👧 ok"]


def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(FILES[0]), SentencePieceProcessor(model_file=FILES[1])
    first.encode_special_tokens = True
    letters = {c: b for b, c in __import__("roadsift.llm.lexicon", fromlist=["LETTERS"]).LETTERS.items()}

    def tokens(text):
        a = [(i, bytes(letters[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i in second.encode(text) for p in [second.id_to_piece(i)]]
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    return tokens


def brute(texts):
    tokens, rows, counts = libraries(), [], Counter()
    for text in texts:
        a, b = tokens(text) if text else ([], [])
        groups, links, i, j, end_a, end_b, start = [], [], 0, 0, 0, 0, (0, 0)
        while i < len(a) or j < len(b):
            if end_a <= end_b:
                end_a, i = end_a + len(a[i][1]), i + 1
            else:
                end_b, j = end_b + len(b[j][1]), j + 1
            if end_a == end_b:
                groups.append(",".join(str(x) for x, _ in a[start[0]:i]) + "|" + ",".join(str(x) for x, _ in b[start[1]:j]))
                links.append((a[i - 1][0], b[j - 1][0]))
                start = i, j
        counts.update(links)
        rows.append((len(a), len(b), len(groups), links, ";".join(groups)))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(a, b, g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), text) for a, b, g, links, text in rows]


@pytest.mark.parametrize("part", [1 << 20, 50])
def test_alignment(spark, monkeypatch, part):
    monkeypatch.setattr(alignment, "PART", part)
    rows = [r for r in documents() if len(r[1] or "") < 20000] + [(1000 + k, t, "en", None, None, None, None, None) for k, t in enumerate(MORE)]
    want = sorted((repr(r[0]), *w) for r, w in zip(rows, brute([r[1] for r in rows])))
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = alignment.alignment(table, *FILES)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    found = got.collect()
    assert sorted((repr(r[0]), *r[1:]) for r in found) == want and any(not r["n_a"] for r in found) and any(r["n_best"] < r["n_links"] for r in found)
    digests = alignment.alignment(table.select(F.col("doc_id").alias("k"), F.col("text").alias("t")), *FILES, id="k", text="t", digests=True).collect()
    assert sorted((repr(r[0]), r["groups"]) for r in digests) == sorted((w[0], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in want)


def test_parts_are_encoded_as_the_whole(monkeypatch):
    tokens = libraries()
    text = "".join(r[1][:4000] + " " for r in documents() if r[1] and "▁" not in r[1]) + "".join(MORE[1:])
    whole = [[i for i, _ in side] for side in tokens(text)]
    monkeypatch.setattr(alignment, "PART", 40)
    pieces = [[[i for i, _ in side] for side in tokens(p[1:])] for p in alignment.parts(text)]
    assert len(pieces) > 100 and [[i for p in pieces for i in p[k]] for k in (0, 1)] == whole


def test_empty_table(spark):
    assert alignment.alignment(spark.createDataFrame([], SCHEMA), *FILES).count() == 0


def test_counting_copies_no_counted_pair_for_each_text(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 4000, 300).astype(np.uint64) for _ in range(500)] + [np.zeros(0, np.uint64)]
    copied, join = [], np.concatenate
    monkeypatch.setattr(alignment.np, "concatenate", lambda parts, *a, **b: copied.append(sum(map(len, parts))) or join(parts, *a, **b))
    monkeypatch.setattr(alignment, "HELD", 1 << 14)
    pairs, n = alignment.counted(iter(texts))
    want = Counter(x for t in texts for x in t.tolist())
    assert dict(zip(pairs.tolist(), n.tolist())) == want and len(pairs) == len(want)
    assert sum(copied) < 2 * 500 * 300  # an append for each text copied over 4000 for each
    assert [len(x) for x in alignment.counted(iter([]))] == [0, 0]
