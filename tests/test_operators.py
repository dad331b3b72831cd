import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadsift.functions import keys as K
from roadsift.functions.intervals import interval_iou, near_join, overlap_join
from roadsift.operators import geometry as G
from roadsift.operators import pu as P
from roadsift.operators import similarity as N
from roadsift.operators.index import nn_recall
from roadsift.sources import io as S


def test_window_keys(spark):
    df = spark.createDataFrame([("log-a", 1.23456789, 2.34567891), ("x|y", 0.0, 315968692.3874254)], "l string, a double, b double")
    got = [r[0] for r in df.select(K.window_key(F.col("l"), F.col("a"), F.col("b"))).collect()]
    assert got == ["log-a|1.234568|2.345679", "x|y|0.000000|315968692.387425"]
    stems = [r[0] for r in spark.createDataFrame([("a/b c|1.0|2.0",), ("a/b c|1.0|2.1",)], "k string").select(K.file_stem(F.col("k"))).collect()]
    assert stems[0] != stems[1] and all(s.startswith("a-b-c-") and "/" not in s for s in stems)


def test_interval_joins_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    a = [("h", k, float(s), float(s + d)) for k, (s, d) in enumerate(zip(rng.uniform(0, 200, 60), rng.uniform(0, 70, 60)))]
    b = [("h", k, float(s), float(s + d)) for k, (s, d) in enumerate(zip(rng.uniform(0, 200, 60), rng.uniform(0, 5, 60)))]
    l = spark.createDataFrame(a, "log_id string, i int, a0 double, a1 double")
    r = spark.createDataFrame(b, "log_id string, j int, b0 double, b1 double")
    got = sorted((x["i"], x["j"]) for x in overlap_join(l, r, ["log_id"], ("a0", "a1"), ("b0", "b1"), pad=1.5, width=10.0).collect())
    assert got == sorted((p[1], q[1]) for p in a for q in b if q[2] <= p[3] + 1.5 and q[3] >= p[2] - 1.5)
    near = sorted((x["i"], x["j"]) for x in near_join(l, r, ["log_id"], "a0", "b0", 2.0).collect())
    assert near == sorted((p[1], q[1]) for p in a for q in b if abs(p[2] - q[2]) <= 2.0)


def test_iou_is_symmetric_and_bounded(spark):
    df = spark.createDataFrame([(0.0, 2.0, 1.0, 4.0), (0.0, 1.0, 3.0, 4.0), (0.0, 1.0, 0.0, 1.0)], "a double, b double, c double, d double")
    rows = df.select(interval_iou(*map(F.col, "abcd")).alias("x"), interval_iou(*map(F.col, "cdab")).alias("y")).collect()
    assert [r["x"] for r in rows] == [r["y"] for r in rows] == [0.25, 0.0, 1.0]


def _edge_points(x, y, length, width, yaw, n=400):
    c = np.array([[length, width], [-length, width], [-length, -width], [length, -width]]) / 2
    r = np.array([[math.cos(yaw), -math.sin(yaw)], [math.sin(yaw), math.cos(yaw)]])
    c = c @ r.T + [x, y]
    t = np.linspace(0, 1, n)[:, None]
    return np.concatenate([c[i] + t * (c[(i + 1) % 4] - c[i]) for i in range(4)])


def test_box_distance_equals_dense_sampling(spark):
    rng = np.random.default_rng(4)
    rows = [tuple(float(v) for v in (*rng.uniform(-8, 8, 2), *rng.uniform(1, 5, 2), rng.uniform(-4, 4), rng.uniform(-4, 4))) for _ in range(60)]
    df = spark.createDataFrame(rows, "x double, y double, len double, wid double, yaw double, ego double")
    b = {c: F.col(c) for c in ("x", "y", "len", "wid", "yaw")}
    a = {"x": F.lit(0.0), "y": F.lit(0.0), "len": F.lit(4.8), "wid": F.lit(2.0), "yaw": F.col("ego")}
    for r in G.box_distance(df, "d", a, b).collect():
        p, q = _edge_points(0, 0, 4.8, 2.0, r["ego"]), _edge_points(r["x"], r["y"], r["len"], r["wid"], r["yaw"])
        dense = np.sqrt(((p[:, None] - q[None]) ** 2).sum(-1)).min()
        assert r["d"] == 0 and dense < 2.5 or abs(r["d"] - dense) < 2e-2


def test_similarity_paths_agree(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vs = rng.normal(size=(90, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v], f"w{i % 7}") for i, v in enumerate(vs)], "id int, embedding array<double>, window_key string")
    q = df.where("id < 12").withColumnRenamed("id", "query_id")
    u = vs / np.linalg.norm(vs, axis=1, keepdims=True)
    want = {i: list(np.argsort(-(u @ u[i]), kind="stable")[:5]) for i in range(12)}
    shipped = N.cosine_topk(df, q, 5).orderBy("query_id", "rank").collect()  # one block
    monkeypatch.setattr(N, "BLOCK", 16)
    blocked = N.cosine_topk(df, q, 5).orderBy("query_id", "rank").collect()
    for i in range(12):
        assert [r["id"] for r in shipped if r["query_id"] == i] == want[i] == [r["id"] for r in blocked if r["query_id"] == i]
    near = (u @ u.T - 10 * np.eye(90)).argmax(1)
    assert nn_recall(df)[0].first()["recall"] == pytest.approx(np.mean([i % 7 == near[i] % 7 for i in range(90)]))


def clustered(spark, n=900, dim=12, groups=30, spread=0.05):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(groups, dim))
    vs = centres[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, dim))
    vs[:3] = 0.0
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vs)], "id int, embedding array<double>"), vs


def nearest_by_all_pairs(vs, asked, k, not_self=False):
    length = np.linalg.norm(vs, axis=1, keepdims=True)
    u = vs / np.where(length > 0, length, 1)
    out = {}
    for i in asked:
        s = u @ u[i]
        out[i] = [j for j in np.lexsort((np.arange(len(s)), -np.round(s, 12))).tolist() if j != i or not not_self][:k]
    return out, u


def test_a_query_visits_few_cells_and_loses_nothing(spark, monkeypatch):
    """Vectors in groups, zero vectors among rows and queries; in data without groups every cell may have to be visited."""
    monkeypatch.setattr(N, "BLOCK", 20)
    df, vs = clustered(spark)
    found, visits = N.topk_with_visits(df, df.where("id % 9 = 0").withColumnRenamed("id", "query_id"), 7, not_self=True)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["similarity"]))
    want, u = nearest_by_all_pairs(vs, range(0, 900, 9), 7, not_self=True)
    for i, ids in want.items():
        assert np.allclose([s for _, s in got[i]], u[ids] @ u[i], atol=1e-9) and len({j for j, _ in got[i]}) == 7 and i not in [j for j, _ in got[i]]
    n = {r["query_id"]: r["cells"] for r in visits.collect()}
    assert len(n) == 100 and n[0] >= 40 and sorted(n.values())[len(n) // 2] <= 12  # 45 cells; the zero query has to see them all


def test_inverted_lists(spark, monkeypatch):
    """All cells: exact.  Half of them: recall of 0.9 at least.  Cells with too few rows are made up for."""
    from roadsift.operators import inverted as I

    monkeypatch.setattr(I, "BLOCK", 50)
    rng = np.random.default_rng(4)
    df, vs = clustered(spark)
    rough = rng.normal(size=(600, 24))
    loose = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rough)], "id int, embedding array<double>")
    for frame, m, least in ((df, vs, 0.99), (loose, rough, 0.9)):
        lists = I.Lists.build(frame)
        assert lists.read().count() == len(m) and lists.read().select("cell").distinct().count() > 10
        asked = list(range(5, len(m), 20))
        q = frame.where("id % 20 = 5").withColumnRenamed("id", "query_id")
        want, u = nearest_by_all_pairs(m, asked, 10)
        exact = lists.search(q, 10, probes=10_000).orderBy("query_id", "rank").collect()
        for k, i in enumerate(asked):
            assert np.allclose([r["similarity"] for r in exact[10 * k:10 * k + 10]], u[want[i]] @ u[i], atol=1e-9)
        some = lists.search(q, 10, probes=-(-len(lists.centres) // 2)).collect()
        found = {(r["query_id"], r["id"]) for r in some}
        recall = sum((i, j) in found for i in asked for j in want[i]) / (10 * len(asked))
        assert len(some) == 10 * len(asked) and recall >= least, recall
        assert lists.search(q, 300, probes=1).groupBy("query_id").count().where("count < 300").count() == 0
    plan = lists.read().where("cell IN (1, 2)")._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan


def test_a_grid_of_a_hundred_steps(spark):
    rows = [("a", k, 0.1 if k in (98, 99) else 1.0 + k) for k in range(100)] + [("b", k, 0.1 if k in (10, 12, 75) else 5.0) for k in range(100)]
    df = spark.createDataFrame(rows, "w string, k int, m double").withColumn("dt", F.col("k") * 0.1)
    got = {r["w"]: r for r in G.min_approach(df, ["w"]).join(G.sustained(df, ["w"], steps=100), "w").collect()}
    assert got["a"]["sustained_tight"] and not got["b"]["sustained_tight"]
    assert got["a"]["t_at_dmin_s"] == pytest.approx(9.8) and got["b"]["t_at_dmin_s"] == pytest.approx(1.0)
    with pytest.raises(Exception, match="outside the grid"):
        G.sustained(df, ["w"]).collect()


def test_a_map_of_seventy_thousand_lines(spark):
    lines = spark.range(70_000).select(F.lit("l").alias("log_id"), F.col("id").alias("feature_id"), F.array(*[F.struct(F.lit(x).alias("x"), (F.col("id") * 2.0).alias("y")) for x in (0.0, 1.0)]).alias("pts"))
    points = spark.createDataFrame([("l", "p", 0.5, 139_998.4), ("l", "q", 0.5, 0.9)], "log_id string, point_id string, x double, y double")
    got = {r["point_id"]: (r["feature_id"], round(r["d"], 6)) for r in G.nearest_on_polyline(points, lines).collect()}
    assert got == {"p": (69_999, 0.4), "q": (0, 0.9)}


def brute_cues(x, y, heading, lines, polygons):
    """Cues of one point by looking at every segment: lane, cos, stop line, crosswalk, inside."""
    found = []
    for kind, inter, pts in lines:
        best = None
        for (ax, ay), (bx, by) in zip(pts, pts[1:]):
            s = min(max(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2 + 1e-12), 0), 1)
            d = math.hypot(x - ax - s * (bx - ax), y - ay - s * (by - ay))
            if best is None or round(d * 1e9) < round(best[0] * 1e9):  # equal distances, as at a corner, go to the first segment
                best = d, math.atan2(by - ay, bx - ax)
        found.append((kind, inter, *best))
    lane = min((f for f in found if f[0] == "lane"), key=lambda f: round(f[2] * 1e9), default=None)
    cross = min((f[2] for f in found if f[0] == "crosswalk"), default=None)
    turned = lambda a: abs((a - heading + math.pi) % (2 * math.pi) - math.pi)
    ahead = min((f[2] for f in found if f[0] == "crosswalk" and turned(f[3]) < math.pi / 2), default=None)
    inter = min((f[2] for f in found if f[0] == "lane" and f[1]), default=None)
    inside = False
    for pts in polygons:
        odd = False
        for (x0, y0), (x1, y1) in zip([pts[-1], *pts[:-1]], pts):
            odd ^= (y1 > y) != (y0 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0 + 1e-12) + x0
        inside |= odd
    return lane and lane[2], lane and math.cos(heading - lane[3]), ahead if ahead is not None else inter, cross, inside if polygons else bool(lane and lane[2] < 3.5)


FEATURES = "log_id string, feature_id int, kind string, is_intersection boolean, pts array<struct<x: double, y: double>>"


def test_map_cues_through_cells(spark):
    """Points near and hundreds of metres away from lines of all lengths and directions, in logs with and without crosswalks ahead."""
    rng = np.random.default_rng(8)
    features, points = [], []
    for log in range(6):
        for k in range(25):
            kind = ["lane", "lane", "crosswalk", "drivable"][k % 4]
            if kind == "crosswalk" and log == 1 or kind == "lane" and log == 2:
                continue
            at, step = rng.uniform(-300, 300, 2), rng.uniform(-60, 60, (rng.integers(3, 6), 2)) * (1 if k % 3 else 0.05)
            if log == 3 and kind == "crosswalk":
                step = np.abs(step) * [1, 0.1]  # all to the east
            features.append((f"l{log}", k, kind, k % 8 == 0, [tuple(map(float, p)) for p in at + np.cumsum(step, axis=0)]))
        for k in range(40):
            x, y = rng.uniform(-350, 350, 2) * (1 if k % 5 else 8)
            points.append((f"l{log}", f"p{k}", float(x), float(y), float(rng.uniform(-3, 3))))
    frame = spark.createDataFrame(points, "log_id string, point_id string, x double, y double, heading double")
    got = {(r["log_id"], r["point_id"]): tuple(r)[2:] for r in G.map_cues(frame, spark.createDataFrame(features, FEATURES)).collect()}
    assert len(got) == len(points)
    for log, point, x, y, heading in points:
        mine = [f for f in features if f[0] == log]
        want = brute_cues(x, y, heading, [(f[2], f[3], f[4]) for f in mine if f[2] != "drivable"], [f[4] for f in mine if f[2] == "drivable"])
        for a, b in zip(got[log, point], want):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(float(b), abs=1e-6)), (log, point, got[log, point], want)


def test_a_log_of_a_hundred_thousand_segments(spark):
    """Pairs that are looked at grow with the points, not with points times segments."""
    lines = spark.range(20_000).select(F.lit("l").alias("log_id"), F.col("id").cast("int").alias("feature_id"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.struct(
        (F.col("id") % 100 * 60.0 + k * 9.0).alias("x"), (F.floor(F.col("id") / 100) * 7.0 + k * 0.5).alias("y"))).alias("pts"))
    points = spark.range(3000).select(F.lit("l").alias("log_id"), F.col("id").alias("point_id"), (F.col("id") * 7919 % 5900 + 0.3).alias("x"), (F.col("id") * 104729 % 1390 + 0.7).alias("y"))
    got = {r["point_id"]: r["d"] for r in G.nearest_on_polyline(points, lines).collect()}
    segs = G.line_segments(G.numbered_lines(lines).select("log_id", "line", "pts"))
    assert segs.count() == 100_000 and G.cell_hits(points, segs, G.CELL).count() < 40 * 3000
    for r in points.where("point_id % 500 = 0").collect():
        near = [[(k % 100 * 60.0 + j * 9.0, k // 100 * 7.0 + j * 0.5) for j in range(6)] for k in range(20_000)]
        near = [p for p in near if abs(p[0][0] - r["x"]) < 120 and abs(p[0][1] - r["y"]) < 60]
        assert got[r["point_id"]] == pytest.approx(brute_cues(r["x"], r["y"], 0.0, [("lane", False, p) for p in near], [])[0], abs=1e-6)


def test_two_sided_features(spark):
    """A lane is measured to the line between its boundaries, a crosswalk to both edges."""
    side = [(0.0, 0.0), (10.0, 0.0)], [(0.0, 4.0), (10.0, 4.0)]
    rows = [("a", 1, "lane", False, *side), ("a", 2, "crosswalk", False, [(20.0, 0.0), (20.0, 4.0)], [(23.0, 0.0), (23.0, 4.0)]), ("b", 1, "lane", False, side[0], None)]
    features = spark.createDataFrame(rows, FEATURES + ", pts2 array<struct<x: double, y: double>>")
    points = spark.createDataFrame([("a", "p", 5.0, 2.5, 0.1), ("a", "q", 24.0, 1.0, 1.0), ("b", "p", 5.0, 1.0, 0.0)], "log_id string, point_id string, x double, y double, heading double")
    got = {(r["log_id"], r["point_id"]): (round(r["map_lane_offset_m"], 6), r["dist_to_crosswalk_m"]) for r in G.map_cues(points, features).collect()}
    assert got == {("a", "p"): (0.5, 15.0), ("a", "q"): (round(math.hypot(14, 1), 6), 1.0), ("b", "p"): (1.0, None)}


def test_values_at_other_times(spark):
    """Against numpy: gaps longer than a bucket, times before, between, on and after the samples, a log without samples."""
    from roadsift.functions.trajectory import at_times

    rng = np.random.default_rng(3)
    series, queries, want = [], [], {}
    for log in range(4):
        ts = np.sort(np.concatenate([rng.uniform(0, 9, 30), rng.uniform(40, 44, 5), [100.0]]))
        vs = rng.normal(size=(2, len(ts)))
        series += [(f"l{log}", float(a), float(b), float(c)) for a, b, c in zip(ts, *vs)]
        for k, q in enumerate([*rng.uniform(-5, 110, 60), *ts[:5], ts[-1]]):
            queries.append((f"l{log}", k, float(q)))
            want[f"l{log}", k] = [np.interp(q, ts, v) for v in vs]
    queries.append(("none", 0, 1.0))
    got = at_times(spark.createDataFrame(series, "log_id string, t_s double, u double, v double").repartition(3),
                   spark.createDataFrame(queries, "log_id string, n int, q_t double"), ["u", "v"]).collect()
    assert len(got) == len(queries)
    for r in got:
        assert (r["u"], r["v"]) == (None, None) if r["log_id"] == "none" else np.allclose((r["u"], r["v"]), want[r["log_id"], r["n"]], atol=1e-9)


def test_fits_of_repeated_timestamps(spark):
    """Two different times give a line, one time a standing actor at the mean; three give a parabola."""
    rows = [("two", t, x) for t, x in ((0.0, 1.0), (0.0, 1.0), (0.5, 2.0), (0.5, 2.0))] + [("one", 0.1, x) for x in (1.0, 2.0, 6.0)] + [("three", t, 1 + t + 3 * t * t) for t in (-0.5, 0.0, 0.5)]
    df = spark.createDataFrame([("w", a, t, x, -x, 0.0) for a, t, x in rows], "window_key string, track_uuid string, t_s double, x double, y double, t0 double")
    got = {r["track_uuid"]: tuple(round(r[c], 6) for c in ("x0", "vx", "ax", "y0")) for r in G.fit_state(df).collect()}
    assert got == {"two": (1.0, 2.0, 0.0, -1.0), "one": (3.0, 0.0, 0.0, -3.0), "three": (1.0, 1.0, 6.0, -1.0)}


def test_changed_and_missing_files(spark, tmp_path):
    import hashlib

    from roadsift.operators.knowledge import check_files

    for name in ("a.json", "b.json"):
        (tmp_path / name).write_text(name)
    expected = spark.createDataFrame([("a.json", hashlib.sha256(b"a.json").hexdigest()), ("b.json", "0" * 64), ("c.json", "0" * 64)], "name string, sha256 string")
    assert {tuple(r) for r in check_files(spark, str(tmp_path), expected).collect()} == {("b.json", "checksum_mismatch"), ("c.json", "missing")}


def test_a_point_id_in_two_logs(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    features = spark.createDataFrame([("a", 1, "drivable", False, square), ("b", 1, "lane", True, [(0.0, 9.0), (9.0, 9.0)])],
                                     "log_id string, feature_id int, kind string, is_intersection boolean, pts array<struct<x: double, y: double>>")
    points = spark.createDataFrame([("a", "p", 1.0, 1.0, 0.0), ("b", "p", 1.0, 1.0, 0.0), ("c", "p", 1.0, 1.0, 0.0)], "log_id string, point_id string, x double, y double, heading double")
    got = {r["log_id"]: (r["map_lane_offset_m"], r["in_drivable_area"]) for r in G.map_cues(points, features).collect()}
    assert got == {"a": (None, 1.0), "b": (8.0, 0.0), "c": (None, None)}


def test_pu_risk_falls_and_separates(spark):
    rng = np.random.default_rng(2)
    rows = [(1, float(v)) for v in rng.normal(2, 1, 60)] + [(0, float(v)) for v in np.concatenate([rng.normal(2, 1, 60), rng.normal(-2, 1, 140)])]
    df = spark.createDataFrame(rows, "y int, x double")
    first = P.fit_nnpu_linear(df, ["x"], 0.3, epochs=1)[2]
    w, b, last = P.fit_nnpu_linear(df, ["x"], 0.3, epochs=15)
    assert last < first and w[0] > 0


def test_pu_fit_reaches_the_least_risk(spark):
    """Against many small plain steps over the same rows."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal([1.5, 0.5, 0], 1, (150, 3)), rng.normal([1.5, 0.5, 0], 1, (120, 3)), rng.normal([-1, 0, 0], 1, (280, 3))])
    y = np.array([1] * 150 + [0] * 400)
    df = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(y, x)], "y int, a double, b double, c double")
    w, b, risk = P.fit_nnpu_linear(df, ["a", "b", "c"], 0.3)
    full, v, plain = np.column_stack([x, np.ones(len(x))]), np.zeros(4), None
    for _ in range(20000):
        z = full @ v
        p = 1 / (1 + np.exp(-z))
        neg = np.logaddexp(0, z)[y == 0].mean() - 0.3 * np.logaddexp(0, z)[y == 1].mean()
        plain = 0.3 * np.logaddexp(0, -z)[y == 1].mean() + max(0, neg)
        g = 0.3 * ((p - 1)[y == 1] @ full[y == 1]) / 150 + ((p[y == 0] @ full[y == 0]) / 400 - 0.3 * (p[y == 1] @ full[y == 1]) / 150 if neg > 0 else 0)
        v = v - 0.1 * g
    assert risk <= plain + 1e-5 and (neg <= 1e-3 or np.allclose([*w, b], v, atol=1e-2))


def test_principal_axes(spark):
    """Against numpy: axes, variances, kept inner products with all components, and a column without variance."""
    from roadsift.operators.index import embed_actors, principal_axes

    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 5)) @ np.diag([5, 3, 2, 0.5, 0]) @ np.linalg.qr(rng.normal(size=(5, 5)))[0] + 1.0
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, " + ", ".join(f"c{k} double" for k in range(5))).repartition(3)
    axes, spread = principal_axes(df, [f"c{k}" for k in range(5)], 3)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(spread, values[::-1][:3], rtol=1e-6) and np.allclose(np.abs((axes * vectors[:, ::-1][:, :3]).sum(axis=0)), 1, atol=1e-6)
    rows = sorted(embed_actors(df, [f"c{k}" for k in range(5)]).select("id", "norm", "embedding").collect())
    y = np.array([r["embedding"] for r in rows]) * np.array([[r["norm"]] for r in rows])
    assert np.allclose(y @ y.T, x @ x.T) and np.allclose([r["norm"] for r in rows], np.linalg.norm(x, axis=1))


def test_a_keyed_table_touches_only_its_buckets(spark, tmp_path):
    from roadsift.sources.keyed import KeyedTable

    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], "k int, v string, load_seq int", buckets=16)
    assert table.upsert(spark.createDataFrame([(k, "a", 1) for k in range(200)], "k int, v string, load_seq int"), "one") == 16
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "rows").rglob("part-*.parquet")}
    before = files()
    change = spark.createDataFrame([(3, "b", 2), (3, "c", 3), (4, "old", 0), (900, "new", 1)], "k int, v string, load_seq int")
    n = table.upsert(change, "two")
    kept = {p for p, at in files().items() if before.get(p) == at}
    assert 1 <= n <= 3 and len(kept) == 16 - n
    rows = {r["k"]: (r["v"], r["load_seq"]) for r in table.read().collect()}
    assert len(rows) == 201 and (rows[3], rows[4], rows[900], rows[5]) == (("c", 3), ("a", 1), ("new", 1), ("a", 1))
    assert table.upsert(change.withColumn("load_seq", F.lit(9)), "two") == 0 and table.insert(spark.createDataFrame([(3, "z", 99), (901, "n", 1)], "k int, v string, load_seq int"), "three") >= 1
    again = {r["k"]: r["v"] for r in table.read().collect()}
    assert len(again) == 202 and again[3] == "c" and again[901] == "n" and table.attempts().count() == 3


def test_upsert_is_idempotent_and_last_write_wins(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, load_seq int")
    n = spark.createDataFrame([(2, "c", 2), (3, "d", 2), (3, "e", 3)], "k int, v string, load_seq int")
    once = S.upsert(t, n, ["k"])
    assert sorted(map(tuple, S.upsert(once, n, ["k"]).collect())) == sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "c", 2), (3, "e", 3)]


def test_contract_violations_raise(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id int, v array<double>")
    with pytest.raises(ValueError):
        S.require({"t": df}, {"t": ["id", "gone"]})
    with pytest.raises(ValueError):
        S.require({"t": df}, {"t": ["id"]}, ("t", "v"))
    with pytest.raises(KeyError):
        S.normalise_keys(df)
