"""What the findings of round 4 named."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from roadsift.operators import geometry as G
from roadsift.operators import graph as R

FEATURES = "log_id string, feature_id int, kind string, is_intersection boolean, pts array<struct<x: double, y: double>>"
POINTS = "log_id string, point_id string, x double, y double, heading double"


def some_maps():
    """Logs with a map or without, points near and far, ids that come twice, and what isn't known."""
    rng = np.random.default_rng(4)
    features, points = [], []
    for log in range(4):
        for k in range(20):
            kind = ["lane", "lane", "crosswalk", "drivable"][k % 4]
            at, step = rng.uniform(-300, 300, 2), rng.uniform(-60, 60, (rng.integers(3, 6), 2))
            if log < 3 and (log != 1 or kind != "crosswalk"):
                features.append((f"l{log}", k, kind, k % 8 == 0, [tuple(map(float, p)) for p in at + np.cumsum(step, axis=0)]))
        for k in range(30):
            x, y = rng.uniform(-350, 350, 2) * (1 if k % 5 else 8)
            points += [(f"l{log}", f"p{k}", float(x), float(y), float(rng.uniform(-3, 3)))] * (1 + k % 2)
    points += [(None, "n", 1.0, 1.0, 0.0), ("l0", None, 1.0, 1.0, 0.0), ("l0", "x", None, 1.0, 0.0), ("l0", "h", 1.0, 1.0, None)]
    return features, points


def test_map_cues_pass_points_once(spark, tmp_path):
    """points meet their map in one pass; neither they nor their pairs with segments are joined back by id or checkpointed."""
    features, points = some_maps()
    spark.createDataFrame(points, POINTS).write.parquet(f"{tmp_path}/p")
    spark.createDataFrame(features, FEATURES).withColumn("pts2", F.transform("pts", lambda p: F.struct((p["x"] + 3).alias("x"), (p["y"] + 1).alias("y")))).write.parquet(f"{tmp_path}/f")
    cues = G.map_cues(spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/f"))
    plan = cues._jdf.queryExecution().optimizedPlan().toString()
    assert "ExistingRDD" not in plan and plan.count("MapInArrow") == 1
    assert not [line for line in plan.splitlines() if "Join" in line and "point" in line]


def test_maps_searched_whole_or_by_tile_agree(spark, monkeypatch):
    """a small map is searched whole, a large one by tiles; crowded tiles are split."""
    features, points = some_maps()
    frame, maps = spark.createDataFrame(points, POINTS), spark.createDataFrame(features, FEATURES)
    lines = G.numbered_lines(G.map_lines(maps))
    lane, cross = F.col("kind") == "lane", F.col("kind") == "crosswalk"

    def found(whole):
        df = G.nearest_lines(frame, lines, {"lane": lane, "cross": cross, "ahead": cross}, "point_id", "log_id", ["feature_id"], ["ahead"],
                             polygons=maps.where("kind = 'drivable'"), mapped=maps, whole=whole)
        return sorted(map(repr, df.drop("_ways").collect()))
    whole = found(1 << 20)
    assert len(whole) == len(points) and found(0) == whole
    monkeypatch.setattr(G, "CROWD", 5)
    assert found(1 << 20) == whole and found(0) == whole


def graph_rows(spark):
    cols = "log_id string, window_key string, track_uuid string, category string, r_rel_m double, x_rel_m double, y_rel_m double, approach_like double"
    rows = [("l", f"w{w}", f"t{k}", "BUS", float(5 * k + w), float(5 * k + w), 0.0, float(k % 2)) for w in range(3) for k in range(w + 1)]
    return spark.createDataFrame(rows, cols).withColumns({c: F.lit(0.5) for c in ("ttc_s", "dmin_m", "p_overlap", "rel_speed_closing_mps", "heading_align_cos")})


def test_edges_read_only_what_they_need(spark):
    """a node's other columns stay out of the sorts and arrays that its edges come from."""
    nodes = R.graph_nodes(graph_rows(spark)).withColumn("other", F.concat("category", F.lit("wide")))
    kept, edges = R.cap_graph(nodes, 14, 12)
    assert "wide" not in edges._jdf.queryExecution().optimizedPlan().toString()
    assert {*nodes.columns, "node"} == {*kept.columns} and kept.where("is_ego = 0").select("other").distinct().collect() == [("BUSwide",)]
    # an actor's phases follow each other: only where none of them was cut off between
    want = {(r["window_key"], r["src_id"], r["src_phase"], r["dst_phase"]) for r in edges.where("is_temporal = 1").collect()}
    have = {(r["window_key"], r["track_uuid"], r["phase_idx"]) for r in kept.where("is_ego = 0").collect()}
    assert want == {(w, t, p, p + 1) for w, t, p in have if (w, t, p + 1) in have}
    at = {(r["window_key"], r["node"]): (r["track_uuid"], r["phase_idx"]) for r in kept.collect()}
    assert all(at[r["window_key"], r["src"]] == (r["src_id"], r["src_phase"]) and at[r["window_key"], r["dst"]] == (r["dst_id"], r["dst_phase"]) for r in edges.collect())


def star_tables(spark, path):
    """Forty orders of one to five line items, thirty parts."""
    items = [(k // 5, (7 * k) % 30, k % 9, k % 5, float(k % 17), 900.0 + 37 * (k % 23), k % 11 / 100, k % 9 / 100, "RAN"[k % 3], "OF"[k % 2]) for k in range(200) if k % 5 <= k // 5 % 5]
    spark.createDataFrame(items, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                          "l_returnflag string, l_linestatus string").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(k, k % 7) for k in range(40)], "o_orderkey bigint, o_custkey bigint").withColumn("o_orderdate", F.lit("2020-01-01").cast("timestamp")).write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(k, f"Brand#{k % 4}", k % 50) for k in range(30)], "p_partkey bigint, p_brand string, p_size int").write.parquet(f"{path}/part.parquet")
    return str(path)


def test_actors_lie_by_window_after_their_joins(spark, tmp_path):
    """where tables are too large for a broadcast, line items move for each join and not once more for their windows."""
    path = star_tables(spark, tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = entry.queries()["grf_12_manifest"](spark, path)
        plan = made._jdf.queryExecution().executedPlan().toString()
        got = made.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 * 4  # nodes and edges: line items and parts, line items and orders
    assert len(got) == 40 and all(r["n_nodes"] == min(14, 5 * (1 + min(3, 1 + int(r["window_key"]) % 5))) and r["n_edges"] == r["n_spatial"] + r["n_temporal"] for r in got)


def test_actors_are_tagged_without_a_join_to_themselves(spark):
    """an actor's columns come back out of its grid; rows of one actor, equal or not, share its nearest approach."""
    rows = [("w", "a", 9.0, 4.0, "BUS"), ("w", "a", 30.0, 2.0, "BUS"), ("w", "b", 15.0, -3.0, "TRUCK"), ("w", "b", 15.0, -3.0, "TRUCK"), ("w", None, 5.0, 0.0, "BUS")]
    states = spark.createDataFrame(rows, "window_key string, track_uuid string, x0 double, y0 double, category string").withColumns(
        {c: F.lit(v) for c, v in {"length_m": 4.0, "width_m": 2.0, "yaw": 0.0, "vx": 1.0, "vy": 0.0, "ax": 0.1, "ay": 0.0, "a_norm": 0.1}.items()})
    ego = spark.createDataFrame([("w", 0.0, 0.0, 0.0, 8.0)], "window_key string, ex double, ey double, eyaw double, ev double")
    tags = G.tag_actors(states, ego)
    assert not [line for line in tags._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "track_uuid" in line]
    got = tags.collect()
    alone = {t: G.tag_actors(states.where(F.col("track_uuid") == t).where("x0 < 20").limit(1), ego).collect()[0]["dmin_m"] for t in "ab"}
    assert sorted((r["track_uuid"], r["x0"]) for r in got) == [("a", 9.0), ("a", 30.0), ("b", 15.0), ("b", 15.0)]
    assert all(r["dmin_m"] == alone[r["track_uuid"]] for r in got)


def test_the_teacher_is_computed_once(spark):
    """a window's totals stand beside its actors, and the checks of sums and categories share one pass."""
    nodes = R.graph_nodes(graph_rows(spark).withColumn("map_lane_alignment_cos", F.lit(0.5)))
    sl = R.slices(graph_rows(spark).withColumns({"window_t_start": F.lit(0.0), "window_t_end": F.lit(2.0)}))
    t = R.teacher(nodes, sl)
    assert t._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    sums = [sum(r["q"] for r in t.collect() if r["window_key"] == w) for w in ("w0", "w1", "w2")]
    assert np.allclose(sums, 1)
    qc = R.teacher_qc(t, nodes)
    assert qc._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # actors without a score, and the teacher's own
    got = {r["metric"]: r["value"] for r in qc.collect()}
    assert (got["missing_actors"], got["windows"], got["top1:BUS"]) == (0, 3, 3) and abs(got["mean_abs_dev"]) < 1e-12
    none = {r["metric"]: r["value"] for r in R.teacher_qc(t.where("q < 0"), nodes).collect()}
    assert none == {"missing_actors": 6, "mean_abs_dev": None, "windows": 0}
