"""Suffix arrays and repeated byte strings against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from roadsift.llm import repeats, suffixes

from .cases import SCHEMA, documents


def plain(text, cap):
    n = len(text) - 1
    order = sorted(range(n), key=lambda i: text[i:], reverse=True)
    shared = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < cap and text[a + k] == text[b + k]:
            k += 1
        shared.append(k)
    return order, shared


@pytest.mark.parametrize("small,memory", [(0, 64), (0, 1 << 20), (1 << 20, 64)])
def test_suffix_arrays(tmp_path, monkeypatch, small, memory):
    """Recursion and queues on disk, over periodic and random texts; order counts up to the cap."""
    monkeypatch.setattr(suffixes, "SMALL", small)
    r, spilled = random.Random(small + memory), 0
    for _ in range(150):
        monkeypatch.setattr(suffixes, "BUCKETS", r.choice([2, 512]))
        monkeypatch.setattr(suffixes, "BLOCK", r.choice([2, 64]))
        k, cap = r.choice([1, 2, 3, 5, 30]), r.choice([4, 100])
        text = [r.randint(1, k) for _ in range(r.randint(1, 150))]
        text = (text * 4)[:200] if r.random() < 0.5 else text
        if r.random() < 0.3:  # rising stretches, so that named substrings are long and some begin like others
            text = [c for _ in range(12) for c in range(1, r.randint(2, 20))][:200]
        scratch = suffixes.Scratch(str(tmp_path), memory)
        blocks = list(suffixes.suffix_array(np.array([*text, 0], np.uint16), cap, scratch).read())
        spilled += scratch.spilled
        scratch.close()
        order, shared = (np.concatenate(c).tolist() for c in zip(*blocks))
        want, common = plain([*text, 0], cap)
        assert sorted(order) == sorted(want) and [text[i:i + cap] for i in order] == [text[i:i + cap] for i in want] and shared == common
    assert bool(spilled) == (memory == 64) and not list(tmp_path.iterdir())


def brute(texts, size):
    counts = {}
    raws = [(t or "").encode() for t in texts]
    for raw in raws:
        for k in range(len(raw) - size + 1):
            counts[raw[k:k + size]] = counts.get(raw[k:k + size], 0) + 1
    out = []
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - size + 1):
            if counts[raw[k:k + size]] > 1:
                gone[k:k + size] = True
        turn = np.diff(np.concatenate([[0], gone, [0]]))
        out.append((len(raw), int(gone.sum()), list(zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist())), raw if not gone.any() else bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return out


def texts():
    r = random.Random(5)
    rows = [r for r in documents() if len(r[1] or "") < 30000]
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    line = "common line " * 3
    more = ["y" * 400, "y" * 399, "ab" * 450, "xyz" * 300 + "q" + "xyz" * 300, passage * 2, passage[:200] + "é" + passage[200:]]
    more += [" ".join(word() for _ in range(r.randint(1, 80))) + line + " ".join(word() for _ in range(r.randint(1, 80))) for _ in range(40)]
    more += [" ".join(word() for _ in range(r.randint(0, 90))) + passage[r.randint(0, 30):r.randint(250, 400)] + word() for _ in range(30)]
    return rows + [(1000 + k, t, "en", None, None, None, None, k) for k, t in enumerate(more)]


@pytest.mark.parametrize("size,inner,shard_bytes", [(400, 64, 4 << 20), (40, 8, 4 << 20), (40, 8, 3000)])
def test_repeated_bytes(spark, monkeypatch, size, inner, shard_bytes):
    rows = texts()
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = repeats.remove_repeated_bytes(table, size=size, inner=inner, shard_bytes=shard_bytes).collect()
    found = sorted(((r["row"]["doc_id"], r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in got), key=repr)
    want = sorted(((row[0], *w) for row, w in zip(rows, brute([r[1] for r in rows], size))), key=repr)
    assert found == want and sum(w[2] > 0 for w in want) > 5
    assert got[0]["row"].__fields__ == [c for c in table.columns if c != "text"]


def test_equal_strings_across_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        rows = [(k, "same text " * 60) for k in range(5)] + [(9, "".join(chr(97 + (k * k) % 23) for k in range(700)))]
        got = repeats.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
        assert {r["row"]["doc_id"]: len(r["kept"]) for r in got} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 9: brute([r[1] for r in rows], 400)[5][0] - brute([r[1] for r in rows], 400)[5][1]}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shards_beyond_memory(tmp_path, monkeypatch):
    """A shard whose tuples are many times what may be held."""
    monkeypatch.setattr(suffixes, "SMALL", 0)
    r = random.Random(3)
    base = bytes(r.randrange(256) for _ in range(3000))
    strings = [base[k:k + 700] for k in (0, 500, 900, 2000)] + [bytes(r.randrange(256) for _ in range(700)) for _ in range(20)]
    n = len(strings)
    batch = pa.record_batch({"key": pa.array(range(n), pa.int64()), "size": pa.array([700] * n, pa.int64()), "first": pa.array([0] * n, pa.int32()),
                             "n": pa.array([521] * n, pa.int32()), "many": pa.array([False] * n), "data": pa.array(strings, pa.binary())})
    got = repeats.repeated_in([batch], 180, str(tmp_path), memory=1 << 12)
    assert sorted(zip(*(c.to_pylist() for c in got.columns))) == [(0, 700, 500, 21), (1, 700, 0, 21), (1, 700, 400, 121), (2, 700, 0, 121)]


def test_empty_and_short(spark):
    assert repeats.remove_repeated_bytes(spark.createDataFrame([], SCHEMA)).count() == 0
    got = repeats.remove_repeated_bytes(spark.createDataFrame([(1, None), (None, ""), (2, "é")], "doc_id long, text string")).collect()
    assert {(r["row"]["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in got} == {(1, 0, b""), (None, 0, b""), (2, 2, "é".encode())}
