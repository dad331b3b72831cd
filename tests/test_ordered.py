"""Chunked operators against plain pandas, with one log that holds most rows and chunks of a few rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadsift.functions.ordered import chunk_window, fill_edges, own_rows, row_index, running_sum, with_halo
from roadsift.functions.quantiles import column_quantiles, group_quantiles


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    rows = [("hot", i, float(v)) for i, v in enumerate(rng.normal(size=120).round(2))]
    rows += [(f"log{k}", i, float(v)) for k in range(5) for i, v in enumerate(rng.normal(size=k + 1).round(2))]
    return pd.DataFrame(rows, columns=["log_id", "i", "v"])


def test_row_index_splits_hot_keys(spark, frame):
    df = spark.createDataFrame(frame.sample(frac=1, random_state=1))
    got = row_index(df, ["log_id"], ["v", "i"], out="k").toPandas().sort_values(["log_id", "k"])
    want = frame.sort_values(["log_id", "v", "i"])
    want["k"] = want.groupby("log_id").cumcount()
    assert got[["log_id", "i", "k"]].values.tolist() == want[["log_id", "i", "k"]].values.tolist()


def test_row_index_without_keys(spark, frame):
    got = row_index(spark.createDataFrame(frame), [], ["v", "log_id", "i"], out="k", start=1).toPandas()
    assert sorted(got["k"]) == list(range(1, len(frame) + 1))
    assert got.sort_values("k")["v"].is_monotonic_increasing


def test_running_sum_and_fill(spark, frame):
    df = spark.createDataFrame(frame)
    got = running_sum(df, ["log_id"], "v", "s", size=7).toPandas().sort_values(["log_id", "i"])
    assert np.allclose(got["s"], frame.sort_values(["log_id", "i"]).groupby("log_id")["v"].cumsum())
    sparse = F.when(F.col("i") % 23 == 5, F.col("v"))
    near = fill_edges(df, ["log_id"], sparse, "prev", "next", size=7).toPandas().sort_values(["log_id", "i"])
    p = frame.sort_values(["log_id", "i"]).assign(x=lambda d: d["v"].where(d["i"] % 23 == 5))
    assert np.allclose(near["prev"].astype(float), p.groupby("log_id")["x"].ffill(), equal_nan=True)
    assert np.allclose(near["next"].astype(float), p.groupby("log_id")["x"].bfill(), equal_nan=True)


def test_three_levels_of_carries(spark, frame):
    """Chunks of 3 rows, chunks of 3 chunks, and 14 of those in the hot log; without keys no task gets all rows of a level."""
    df = spark.createDataFrame(frame)
    got = running_sum(df, ["log_id"], "v", "s", size=3).toPandas().sort_values(["log_id", "i"])
    assert np.allclose(got["s"], frame.sort_values(["log_id", "i"]).groupby("log_id")["v"].cumsum())
    sparse = F.when(F.col("i") % 41 == 5, F.col("v"))
    near = fill_edges(df, ["log_id"], sparse, "prev", "next", size=3).toPandas().sort_values(["log_id", "i"])
    p = frame.sort_values(["log_id", "i"]).assign(x=lambda d: d["v"].where(d["i"] % 41 == 5))
    assert np.allclose(near["prev"].astype(float), p.groupby("log_id")["x"].ffill(), equal_nan=True)
    assert np.allclose(near["next"].astype(float), p.groupby("log_id")["x"].bfill(), equal_nan=True)
    whole = row_index(df.drop("i"), [], ["log_id", "v"], out="i")
    summed = running_sum(whole, [], "v", "s", size=3)
    assert "SinglePartition" not in summed._jdf.queryExecution().executedPlan().toString().split("Scan ExistingRDD")[0]
    flat = summed.toPandas().sort_values("i")
    assert np.allclose(flat["s"], flat["v"].cumsum())


def test_halo_reaches_over_chunk_borders(spark, frame):
    halo = with_halo(spark.createDataFrame(frame), before=2, after=3, size=5)
    w = chunk_window(["log_id"])
    got = own_rows(halo.select("*", F.lag("v", 2).over(w).alias("b"), F.lead("v", 3).over(w).alias("a"))).toPandas().sort_values(["log_id", "i"])
    g = frame.sort_values(["log_id", "i"]).groupby("log_id")["v"]
    assert np.allclose(got["b"].astype(float), g.shift(2), equal_nan=True)
    assert np.allclose(got["a"].astype(float), g.shift(-3), equal_nan=True)


@pytest.mark.parametrize("nearest", [False, True])
def test_group_quantiles_are_exact(spark, nearest):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=9000), "b": np.repeat(2.0, 50), "c": rng.integers(0, 4, 37).astype(float), "d": np.array([1.0]), "e": np.array([3.0, 1.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "g string, v double")
    ps = [0.0, 0.01, 0.1, 0.33, 0.5, 0.9, 1.0]
    got = {(r["g"], r["p"]): r["q"] for r in group_quantiles(df, ["g"], "v", ps, nearest=nearest).collect()}
    for k, vs in groups.items():
        for p in ps:
            assert got[(k, p)] == pytest.approx(np.quantile(vs, p, method="nearest" if nearest else "linear"), abs=1e-12)


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_quantiles_of_many_columns(spark, p):
    rng = np.random.default_rng(11)
    x = {"normal": rng.normal(size=30000), "ties": rng.integers(0, 3, 30000).astype(float), "same": np.full(30000, 2.5), "gaps": np.where(rng.random(30000) < 0.3, np.nan, rng.normal(size=30000))}
    df = spark.createDataFrame(pd.DataFrame(x)).repartition(4)
    columns = {c: F.when(~F.isnan(c), F.col(c)) for c in x} | {"none": F.lit(None).cast("double"), "negative": -F.col("normal")}
    got = column_quantiles(df, columns, p)
    assert got.pop("none") is None
    for c, v in got.items():
        values = -x["normal"] if c == "negative" else x[c][~np.isnan(x[c])]
        assert v == pytest.approx(np.quantile(values, p), abs=1e-12), c
