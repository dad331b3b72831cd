import itertools

import numpy as np
import pytest

from roadsift.operators import temporal as T


def brute(p, pi, on=0.85, off=0.95):
    """Posterior and best path by trying every path."""
    A = np.array([[off, 1 - off], [1 - on, on]])
    e = np.stack([1 - p, p], axis=1)
    total, post, best, path = 0.0, np.zeros(len(p)), -1.0, None
    for s in itertools.product((0, 1), repeat=len(p)):
        w = (pi if s[0] else 1 - pi) * e[0, s[0]]
        for t in range(1, len(p)):
            w *= A[s[t - 1], s[t]] * e[t, s[t]]
        total += w
        post += w * np.array(s)
        if w > best + 1e-15:
            best, path = w, s
    return post / total, path


def frame(spark, logs):
    return spark.createDataFrame([(k, i, float(i), i + 1.0, float(v)) for k, vs in logs.items() for i, v in enumerate(vs)],
                                 "log_id string, i bigint, t_start double, t_end double, p double")


@pytest.mark.parametrize("size", [2, 3, 1024])
def test_scans_equal_enumeration_for_any_chunk_size(spark, size):
    rng = np.random.default_rng(7)
    logs = {"a": rng.uniform(0.02, 0.98, 9), "b": rng.uniform(0.3, 0.99, 6), "c": np.array([0.9])}
    got = T.smooth(frame(spark, logs), "p", pi=0.3, size=size).orderBy("log_id", "i").toPandas()
    for k, p in logs.items():
        g = got[got["log_id"] == k]
        post, path = brute(p, 0.3)
        assert np.allclose(g["post_hmm"], post)
        assert tuple(g["viterbi"]) == path
        y = [p[0]]
        for v in p[1:]:
            y.append(0.4 * v + 0.6 * y[-1])
        assert np.allclose(g["score_ema"], y)


def test_long_log_does_not_depend_on_the_chunks(spark):
    p = np.random.default_rng(1).uniform(0.001, 0.999, 400)
    a = T.smooth(frame(spark, {"hot": p}), "p", pi=0.2, size=16).orderBy("i").toPandas()
    b = T.smooth(frame(spark, {"hot": p}), "p", pi=0.2, size=1024).orderBy("i").toPandas()
    assert np.allclose(a["post_hmm"], b["post_hmm"]) and np.allclose(a["score_ema"], b["score_ema"])
    assert (a["viterbi"] == b["viterbi"]).all() and a["post_hmm"].between(0, 1).all()
