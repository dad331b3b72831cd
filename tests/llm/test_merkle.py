"""Merkle manifests against plain hashing."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from roadsift.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, key string, rank long, above string, item int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][k:k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def path_of(levels, k):
    out = []
    for level in levels[:-1]:
        other = k ^ 1
        out.append((level[other] if other < len(level) else None, bool(k & 1)))
        k >>= 1
    return out


def brute(rows):
    """Rows of (doc_id, source, lang, n_chars, text) -> doc_id, leaf, subroot, root, siblings, folded root, verified."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((leaf_of(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[g] = levels_of([h for h, _ in groups[g]])
    top = levels_of([trees[g][-1][0] for g in order])
    out = []
    for n, g in enumerate(order):
        for k, (h, r) in enumerate(groups[g]):
            path = path_of(trees[g], k) + path_of(top, n)
            bent = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf_of((*r[:3], r[3] + 1, r[4])) if bent else h
            for sibling, left in path:
                now = digest(sibling, now) if left and sibling else digest(now, sibling or "")
            out.append((r[0], h, trees[g][-1][0], top[-1][0], tuple(s for s, _ in path if s), now, now == top[-1][0]))
    return sorted(out, key=repr)


def compared(spark, rows, digits):
    table = spark.createDataFrame([(i, t, lang, s, n, "x", "y", 1, "z", 2) for i, s, lang, n, t in rows], SCHEMA).repartition(3)
    got = merkle.manifest(table, FIELDS, tampered={"n_chars": F.col("n_chars") + 1}, when=F.crc32(F.col("doc_id").cast("string")) % 7 == 0, digits=digits).collect()
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(s["sibling"] for s in r["path"] if s["sibling"]), r["folded_root"], r["verified"]) for r in got), key=repr)


@pytest.mark.parametrize("digits", [1, 2])
def test_manifest(spark, digits):
    r = random.Random(1)
    sizes = {None: 3, "": 1, "a": 17, "b": 256, "é": 33, "z": 300, "aa": 16, "y": 2}
    rows = [(k * 8 + n, r.choice([None, "", "web"]), lang, r.choice([None, 5]), r.choice([None, "", "text é"])) for n, (lang, size) in enumerate(sizes.items()) for k in range(size)]
    rows += [rows[30], rows[30], (None, None, "z", 3, "x"), (None, None, None, None, None), (rows[40][0], "other", "b", 1, "same id")]
    got = compared(spark, rows, digits)
    want = brute(rows)
    assert got == want and len({x[-1] for x in got}) == 2


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 31, 257])
def test_one_group(spark, n):
    rows = [(k, "s", "en", k, "t") for k in range(n)]
    assert compared(spark, rows, 1) == brute(rows)


def test_many_groups_and_none(spark):
    rows = [(k, "s", f"lang{k % 40}", k, "t") for k in range(80)]
    assert compared(spark, rows, 1) == brute(rows)
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), FIELDS).count() == 0
