"""What the findings of round 3 named."""

import duckdb
import numpy as np

import __spark_entry__ as entry
from pyspark.sql import functions as F

from roadsift.operators import evidence as D
from roadsift.functions.quantiles import group_quantiles
from roadsift.operators import features as A
from roadsift.operators import geometry as G
from roadsift.operators import graph as R
from roadsift.operators import inverted as I
from roadsift.operators import signal as S


def test_a_summary_rounds_like_its_sql(spark):
    rows = [(9.45, -9.0, "~13.1 m"), (1.35, -6.0, "~6.1 m"), (4.55, -3.0, "~5.4 m"), (61.05, -7.0, "~61.5 m"), (0.25, 0.0, "~0.3 m")]
    df = spark.createDataFrame(rows, "x_rel_m double, y_rel_m double, want string").withColumns(
        {"dmin_m": F.lit(4.0), "bearing_rad": F.lit(0.0), "rel_speed_closing_mps": F.lit(1.0), "lat_speed_mps": F.lit(0.0)})
    df = A.flags(df).withColumns({"category": F.lit("BUS"), "ttc_s": F.lit(None).cast("double"), **{c: F.lit("x") for c in ("side_bucket", "distance_bucket", "trajectory_bucket", "role_hint")}})
    assert [r["want"] in r["s"] for r in df.select("want", D.actor_summary().alias("s")).collect()] == [True] * len(rows)


def test_coverage_counts_every_vector(spark, tmp_path):
    spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 1)], "l_orderkey bigint, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1,), (2,), (7,)], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["backend_id"]: r["embedded"] for r in entry.queries()["kb_17_backend_coverage"](spark, str(tmp_path)).collect()}
    assert got == {1: 3, 2: 1}  # of order 7 only the vector of its own backend, of order 2 also one of a backend without lines


def test_quantiles_have_the_bits_of_sql(spark):
    """Neighbours that differ in their last bits only, as derivatives of a series with flat stretches do."""
    rng = np.random.default_rng(3)
    rows = [(k, float(v + d)) for k, v in enumerate(rng.uniform(-5000, 5000, 400)) for d in [0.0, 0.0, rng.choice([1e-12, 1e-9, 1.0]) * rng.random(), *range(1, 2 + k % 29)]]
    got = {r["k"]: r["q"] for r in group_quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", [0.1]).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE r (k INT, v DOUBLE)")
    con.executemany("INSERT INTO r VALUES (?, ?)", rows)
    assert got == dict(con.execute("SELECT k, quantile_cont(v, 0.1) FROM r GROUP BY k").fetchall())


def test_cells_of_a_map_stay_off_the_driver(spark):
    """A table of exploded cells is planned as small as the map it comes from; it must not be broadcast all the same."""
    points = spark.createDataFrame([("a", 1, 1.0, 1.0)], "log_id string, point_id int, x double, y double")
    lines = spark.createDataFrame([("a", 1, 0, [(0.0, 0.0), (9.0, 0.0)])], "log_id string, feature_id int, line int, pts array<struct<x: double, y: double>>")
    for df in (G.cell_hits(points, G.line_segments(lines), 8.0), G.cell_hits(points, G.line_segments(lines), None), G.point_in_polygon(points, lines)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [log_id" in plan and not any("Generate" in part for part in plan.split("BroadcastExchange")[1:])


def test_queries_are_sent_to_groups_of_cells(spark, monkeypatch):
    """No broadcast of exploded queries, each sent once to a group; groups and slices of any size give what all pairs give."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(500, 12))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id int, embedding array<double>")
    q = df.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    lists = I.Lists.build(df, cells=20)
    plan = lists.search(q, 5, probes=20)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [place" in plan and "BroadcastExchange" not in plan
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = np.argsort(-(u[::10] @ u.T), axis=1)[:, :5]
    for group in (1, 60, 1000):
        monkeypatch.setattr(I, "GROUP", group)
        monkeypatch.setattr(I, "SLICE", 7)
        got = lists.search(q, 5, probes=20).orderBy("query_id", "rank").collect()
        assert np.array_equal(np.array([r["id"] for r in got]).reshape(50, 5), want)
    sizes = np.array([10, 0, 30, 70, 1, 1])
    places, subs = lists._groups(sizes)
    assert len(places) == 6 and (np.diff(places) >= 0).all() and places.max() < 4 and len(subs) == places.max() + 1


def test_edges_of_crowded_phases(spark):
    """Arrays and the grid find the same edges, also on the borders of cells; actors of small windows are shuffled no more than once."""
    rng = np.random.default_rng(5)
    points = [("w", k % 2, f"t{k}", 0, float(x), float(y)) for k, (x, y) in enumerate(np.round(rng.uniform(-300, 300, (400, 2)) / 10) * 10)]
    points += [("w", 0, "EGO", 1, 0.0, 0.0), ("w", 0, "lost", 0, None, 1.0), ("s", 0, "a", 0, 0.1, 0.0), ("s", 0, "b", 0, -29.9, 0.0), ("s", 1, "c", 0, 0.1, 0.0)]
    nodes = spark.createDataFrame(points, "window_key string, phase_idx int, track_uuid string, is_ego int, x_rel_m double, y_rel_m double")
    actors = [p for p in points if not p[3] and p[4] is not None]
    want = sorted((a[0], a[1], a[2], b[2]) for a in actors for b in actors if a[:2] == b[:2] and a[2] != b[2] and np.hypot(a[4] - b[4], a[5] - b[5]) <= 30)
    for few in (1, 64, 1000):
        got = R.proximity_edges(nodes, few=few).select("window_key", "src_phase", "src_id", "dst_id").collect()
        assert sorted(map(tuple, got)) == want
    plan = R.proximity_edges(R.expand_phases(R.nearest_actors(A.flags(spark.createDataFrame([("w", "t", 1.0, 2.0)], "window_key string, track_uuid string, x_rel_m double, y_rel_m double").withColumns(
        {c: F.lit(0.5) for c in ("dmin_m", "p_overlap", "bearing_rad", "rel_speed_closing_mps", "lat_speed_mps", "ttc_s", "heading_align_cos")})), 3)))
    near = plan._jdf.queryExecution().executedPlan().toString().split("Union")[1]
    assert near.split("SortMergeJoin")[0].count("Exchange hashpartitioning") == 1


def test_no_task_gets_all_rows_of_a_column(spark):
    """Quantiles of a fixed number of columns: the brackets go to the rows."""
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") / 2).alias("dmin_m"))
    for out in (A.fill_missing(df, [{"name": "dmin_m", "fill": "median"}]), A.feature_qc(df, ["dmin_m", "id"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [field" in plan and "SortMergeJoin [field" not in plan.replace("LeftOuter", "").split("Window")[0]
    filled = A.fill_missing(df, [{"name": "dmin_m", "fill": "median"}]).where("id % 3 = 0").select("dmin_m").distinct().collect()
    assert [r[0] for r in filled] == [float(np.median([k / 2 for k in range(1000) if k % 3]))]


def test_windows_compute_their_series_once(spark):
    """Percentiles, segments and samples read a stored series; nothing of it is planned again behind the windows."""
    rng = np.random.default_rng(6)
    rows = [("a", k, k * 0.05, float(v)) for k, v in enumerate(10 + np.cumsum(rng.normal(size=300)))]
    found = S.detect_windows(spark.createDataFrame(rows, "log_id string, i bigint, t_s double, speed double"), "pct:10", "pct:10")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in plan and found.count() > 0


def test_a_graph_is_built_in_one_pass(spark):
    """Actors and egos come from one pass, and the checks read sums of each window that are stored once."""
    cols = "log_id string, window_key string, track_uuid string, category string, r_rel_m double, x_rel_m double, y_rel_m double, approach_like double"
    rows = [("l", f"w{w}", f"t{k}", "BUS", float(5 * k + w), float(5 * k + w), 0.0, float(k % 2)) for w in range(3) for k in range(w + 1)]
    near = spark.createDataFrame(rows, cols).withColumns({c: F.lit(0.5) for c in ("ttc_s", "dmin_m", "p_overlap", "rel_speed_closing_mps", "heading_align_cos")})
    nodes = R.graph_nodes(near)
    apart = R.expand_phases(near).unionByName(R.ego_nodes(near), allowMissingColumns=True)
    assert sorted(map(repr, nodes.select(*sorted(apart.columns)).collect())) == sorted(map(repr, apart.select(*sorted(apart.columns)).collect()))
    kept, edges = R.cap_graph(nodes, 14, 12)
    qc = R.graph_qc(kept, edges)
    assert "row_number" not in qc._jdf.queryExecution().optimizedPlan().toString()
    got = {r["metric"]: r["value"] for r in qc.collect()}
    assert (got["windows"], got["nodes_min"], got["nodes_max"], got["nodes_median"], got["dangling_endpoints"], got["edges"]) == (3, 10, 14, 14, 0, edges.count())
    # one end without a node, one without a name, one node without an edge, a self link
    n = spark.createDataFrame([("w", "a", 0, "pre", 0, 1.0), ("w", "b", 0, "pre", 0, 3.0), ("w", "c", 3, "peak", 0, 1.0), ("v", "a", 0, "pre", 0, 1.0)], "window_key string, track_uuid string, phase_idx int, phase string, is_ego int, r_rel_m double")
    e = spark.createDataFrame([("w", "a", 0, "b", 0, 1.0), ("w", "a", 0, "z", 0, -1.0), ("w", None, 0, "a", 0, 1.0), ("w", "a", 0, "a", 0, 1.0), ("u", "a", 0, "a", 1, 1.0)],
                              "window_key string, src_id string, src_phase int, dst_id string, dst_phase int, dist_m double").withColumn("is_temporal", F.lit(0))
    got = {r["metric"]: r["value"] for r in R.graph_qc(n, e).collect()}
    assert got == {"windows": 2, "windows_missing_phase": 2, "nodes_min": 1, "nodes_max": 3, "nodes_median": 2, "r_pre_above_peak_pct": 100, "dangling_endpoints": 4,
                   "edges": 5, "negative_distance": 1, "self_links": 1, "isolated_nodes": 2}
