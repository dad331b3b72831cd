"""Nearest neighbours against brute force, and call linking."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadsift.llm import chat, neighbours, queries

NAN = float("nan")


def vectors(n=1500, size=12, seed=6):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, size))
    x = (centres[r.integers(0, 8, n)] + 0.5 * r.normal(size=(n, size))).astype(np.float32)
    x[10:14] = x[10]  # ties
    rows = [(k, x[k].tolist(), "clash") for k in range(n)]
    return rows + [(n, None, None), (n + 1, [0.0] * size, None), (n + 2, [NAN] * size, None), (n + 3, [1.0, None], None), (None, [1.0] * size, None), (n + 5, [], None)]


def brute(rows, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    ids, x = np.array([g[0] for g in good]), np.stack([g[1] for g in good])
    out = {}
    for i, v in good:
        if i % 20 == 0:
            s = x @ v
            order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:k]
            out[i] = ([int(ids[j]) for j in order], s[order])
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 12, 4 << 20])
def test_factor_one_is_exact(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(neighbours, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 16)
    rows = vectors()
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string"), F.col("id") % 20 == 0, relax=1.0).collect()
    want = brute(rows, 20)
    of = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        of.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(of) == set(want)
    for q, (ids, scores) in want.items():
        assert [i for i, _ in of[q]] == ids and np.allclose([s for _, s in of[q]], scores, atol=1e-12)


def test_relaxed_recall(spark):
    rows = vectors(4000)
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string"), F.col("id") % 20 == 0, relax=1.5).collect()
    want = brute(rows, 20)
    hits = sum(r["vec_id"] in want[r["query_id"]][0] for r in got)
    assert len(got) == 20 * len(want) and hits >= 0.9 * len(got)


def lengths(kind, n=4000):
    r = np.random.default_rng(11)
    centres = r.normal(size=(40, 16))
    x = centres[r.integers(0, 40, n)] + 0.3 * r.normal(size=(n, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "log-normal":
        x *= r.lognormal(0, 0.7, (n, 1))
    elif kind != "equal":
        x[77] *= float(kind)
    return [(k, x[k].astype(np.float32).tolist(), None) for k in range(n)]


@pytest.mark.parametrize("kind", ["equal", "3", "10", "1e8", "log-normal"])
def test_query_finds_all_neighbours_whatever_the_lengths(spark, tmp_path, kind):
    rows = lengths(kind)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.QUERIES["op8_vantage_point_neighbours"](spark, str(tmp_path)).collect()
    want = brute(rows, 20)
    found = {q: set() for q in want}
    for r in got:
        found[r["query_id"]].add(r["vec_id"])
    recall = sum(len(found[q] & set(ids)) for q, (ids, _) in want.items()) / (20 * len(want))
    assert len(got) == 20 * len(want) and recall == 1.0, recall


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(few, F.col("id") % 20 == 0).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 20, 0.5), (20, 1, 0, 0.5)]
    assert neighbours.nearest(few.limit(0), F.col("id") % 20 == 0).count() == 0


CALLS = "call_id string, name string, arguments string, after string, level string"
SCHEMAS = {"add": {"a": ("BIGINT", True), "note": ("STRING", False)}}


def test_calls(spark):
    calls = [("c1", "add", '{"note": "x", "a": 1}', None, "clash"), ("c2", "add", '{"a": "1"}', "c1", None), ("c3", "add", '{"a": 1, "b": 2}', "c2", None),
             ("c4", "sub", '{"a": 1}', "c9", None), ("c5", "add", "no json", "c6", None), ("c6", "add", None, "c5", None), (None, "add", '{"a": 2}', "c1", None),
             ("c7", "add", "[1]", "c5", None), ("c1", "add", '{"note": "x", "a": 1}', None, "clash"), ("c8", "add", '{"note": 3, "a": 1}', "c3", None), ("cA", "add", "{}", "c8", None)]
    results = [("c1", "three"), ("c1", "four"), ("c2", None), ("zz", "lost"), (None, "nothing")]
    got = chat.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, "call_id string, content string"), SCHEMAS).collect()
    of = {r["call_id"]: r for r in got}
    assert len(got) == len(calls) + 1
    assert {c: of[c]["level"] for c in of} == {"c1": 0, "c2": 1, "c3": 2, "c4": 0, "c5": None, "c6": None, "c7": None, None: 0, "c8": 3, "cA": 4, "zz": None}
    assert {c for c in of if of[c]["valid"]} == {"c1", None}
    assert of["c1"]["json"] == '{"arguments":{"a":1,"note":"x"},"id":"c1","name":"add","result":"four"}' and of["c1"]["n_results"] == 2
    assert json.loads(of["zz"]["json"]) == {"arguments": None, "id": "zz", "name": None, "result": "lost"}
    assert json.loads(of["c5"]["json"])["arguments"] is None and of["c2"]["n_results"] == 1


def test_a_long_chain_takes_few_rounds(spark):
    chain = [(f"k{i}", "add", '{"a": 1}', f"k{i - 1}", None) for i in range(200)]
    got = chat.levels(spark.createDataFrame(chain, CALLS))
    assert {r["call_id"]: r["level"] for r in got.collect()} == {f"k{i}": i for i in range(200)}


def test_no_calls(spark):
    none = chat.link_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], "call_id string, content string"), SCHEMAS)
    assert none.count() == 0
    plan = none._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
