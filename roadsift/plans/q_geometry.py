"""GEO-*: actor geometry over line items, tracks over events, maps over parts."""

import math

from pyspark.sql import functions as F

from roadsift.operators import geometry as G
from roadsift.plans.fixtures import ACTORS, WINDOWS, actors, braking_windows, ego_signal
from roadsift.plans.registry import query

ACTOR = "window_key:s track_uuid:s"

BOX = """boxes AS (SELECT CAST(l_orderkey AS VARCHAR) AS window_key,
    printf('%d-%d-%d-%d', l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT)) AS track_uuid,
    l_quantity - 20e0 AS x0, (l_suppkey % 20) - 10e0 AS y0, p_size / 10e0 + 1e0 AS length_m, 2e0 AS width_m, l_tax * 10e0 AS yaw,
    l_tax * 100e0 - 4e0 AS vx, (l_partkey % 5) - 2e0 AS vy, l_discount * 10e0 - 0.5e0 AS ax, (l_partkey % 3) - 1e0 AS ay,
    p_brand AS category, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def boxes(t):
    c = F.col
    return t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).select(
        c("l_orderkey").cast("string").alias("window_key"),
        F.format_string("%d-%d-%d-%d", "l_partkey", "l_suppkey", "l_linenumber",
                        F.round(c("l_extendedprice") * 100).cast("bigint")).alias("track_uuid"),
        (c("l_quantity") - 20.0).alias("x0"), (c("l_suppkey") % 20 - F.lit(10.0)).alias("y0"),
        (c("p_size") / F.lit(10.0) + 1.0).alias("length_m"), F.lit(2.0).alias("width_m"), (c("l_tax") * 10.0).alias("yaw"),
        (c("l_tax") * 100.0 - 4.0).alias("vx"), (c("l_partkey") % 5 - F.lit(2.0)).alias("vy"),
        (c("l_discount") * 10.0 - 0.5).alias("ax"), (c("l_partkey") % 3 - F.lit(1.0)).alias("ay"),
        c("p_brand").alias("category"), "l_returnflag")


@query("geo_01_transforms", ACTOR + " cx:d cy:d ex:d ey:d",
       f"WITH {BOX} SELECT window_key, track_uuid, 3.0 + cos(yaw)*x0 - sin(yaw)*y0 AS cx, -2.0 + sin(yaw)*x0 + cos(yaw)*y0 AS cy, "
       "cos(yaw)*(x0-3.0) + sin(yaw)*(y0+2.0) AS ex, cos(yaw)*(y0+2.0) - sin(yaw)*(x0-3.0) AS ey FROM boxes")
def geo_01(t):
    args = (F.col("x0"), F.col("y0"), F.col("yaw"), F.lit(3.0), F.lit(-2.0))
    cx, cy = G.ego_to_city(*args)
    ex, ey = G.city_to_ego(*args)
    return boxes(t).select("window_key", "track_uuid", cx.alias("cx"), cy.alias("cy"), ex.alias("ex"), ey.alias("ey"))


# tracks: the events of a log by type, windows: its braking windows, some of them far from any sample
TRACKS = WINDOWS + """, ann AS (SELECT log_id, event_type AS track_uuid, i, t_s, speed AS x, (i % 13) * 1e0 AS y, event_type AS category FROM ego),
cw AS (SELECT window_key, log_id, (t_start + t_end) / 2 + CASE WHEN i_start % 5 = 0 THEN 100e0 ELSE 0e0 END AS t0 FROM windows),
nearp AS (SELECT cw.window_key, t0, ann.* FROM cw JOIN ann USING (log_id) WHERE abs(t0 - t_s) <= 1.5),
pairs AS (SELECT * FROM nearp UNION ALL SELECT cw.window_key, t0, ann.* FROM cw JOIN ann USING (log_id)
  WHERE window_key NOT IN (SELECT window_key FROM nearp))"""


def pairs(t):
    ego = ego_signal(t)
    ann = ego.select("log_id", F.col("event_type").alias("track_uuid"), "i", "t_s", F.col("speed").alias("x"),
                     (F.col("i") % 13).cast("double").alias("y"), F.col("event_type").alias("category"))
    wins = braking_windows(t).select("window_key", "log_id", ((F.col("t_start") + F.col("t_end")) / 2 + F.when(
        F.col("i_start") % 5 == 0, 100.0).otherwise(0.0)).alias("t0"))
    return G.near_event(ann, wins, 1.5)


def _fit_sql():
    def reg(v):
        # regr_* for the linear case, normal equations for the quadratic one
        det = ("(n*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2))")
        return (f"(q{v}0*(s2*s4-s3*s3) - s1*(q{v}1*s4-s3*q{v}2) + s2*(q{v}1*s3-s2*q{v}2)) / {det} AS {v}q0, "
                f"(n*(q{v}1*s4-q{v}2*s3) - q{v}0*(s1*s4-s3*s2) + s2*(s1*q{v}2-s2*q{v}1)) / {det} AS {v}q1, "
                f"2*(n*(s2*q{v}2-s3*q{v}1) - s1*(s1*q{v}2-q{v}1*s2) + q{v}0*(s1*s3-s2*s2)) / {det} AS {v}q2")
    return f"""WITH {TRACKS}, c AS (SELECT *, t_s - t0 AS dt, count(*) OVER g AS n_all,
        sum(CASE WHEN abs(t_s - t0) <= 0.8 THEN 1 ELSE 0 END) OVER g AS na, sum(CASE WHEN abs(t_s - t0) <= 1.2 THEN 1 ELSE 0 END) OVER g AS nb,
        row_number() OVER (PARTITION BY window_key, track_uuid ORDER BY abs(t_s - t0), t_s) AS rk FROM pairs
        WINDOW g AS (PARTITION BY window_key, track_uuid)),
      s AS (SELECT *, CASE WHEN na >= 3 THEN na WHEN nb >= 2 THEN nb ELSE 2 END AS n_samples FROM c WHERE n_all >= 2 AND
        CASE WHEN na >= 3 THEN abs(dt) <= 0.8 WHEN nb >= 2 THEN abs(dt) <= 1.2 ELSE rk <= 2 END),
      m AS (SELECT window_key, track_uuid, n_samples, count(*) * 1e0 AS n, sum(dt) AS s1, sum(dt*dt) AS s2, sum(dt*dt*dt) AS s3,
        sum(dt*dt*dt*dt) AS s4, sum(x) AS qx0, sum(x*dt) AS qx1, sum(x*dt*dt) AS qx2, sum(y) AS qy0, sum(y*dt) AS qy1,
        sum(y*dt*dt) AS qy2 FROM s GROUP BY ALL),
      f AS (SELECT *, CASE WHEN n >= 3 THEN n END AS q, (n*qx1 - s1*qx0) / (n*s2 - s1*s1) AS lx, (n*qy1 - s1*qy0) / (n*s2 - s1*s1) AS ly,
        {reg('x')}, {reg('y')} FROM m)
      SELECT window_key, track_uuid, n_samples, floor(97.31e0 * CASE WHEN n >= 3 THEN xq0 ELSE (qx0 - lx*s1) / n END + 0.5) AS x0,
        floor(97.31e0 * CASE WHEN n >= 3 THEN xq1 ELSE lx END + 0.5) AS vx, floor(97.31e0 * CASE WHEN n >= 3 THEN yq0 ELSE (qy0 - ly*s1) / n END + 0.5) AS y0,
        floor(97.31e0 * CASE WHEN n >= 3 THEN yq1 ELSE ly END + 0.5) AS vy FROM f"""


@query("geo_02_fit_state", ACTOR + " n_samples:n x0:n vx:n y0:n vy:n", _fit_sql())
def geo_02(t):
    """In steps of about a hundredth: three close samples extrapolate far, which magnifies rounding."""
    fit = G.fit_state(pairs(t))
    return fit.withColumns({c: F.floor(F.col(c) * 97.31 + 0.5) for c in ("x0", "vx", "y0", "vy")})


@query("geo_03_near_event", ACTOR + " i:n t0:d", f"WITH {TRACKS} SELECT * FROM pairs")
def geo_03(t):
    return pairs(t)


@query("geo_04_filter_tracks", ACTOR + " n_samples:n track_len_s:d category:s first_dist_m:d",
       f"WITH {TRACKS} SELECT * FROM (SELECT window_key, track_uuid, count(*) AS n_samples, max(t_s) - min(t_s) AS track_len_s, "
       "arg_min(category, t_s) AS category, arg_min(sqrt(x*x + y*y), t_s) AS first_dist_m FROM pairs GROUP BY window_key, track_uuid) "
       "WHERE n_samples >= 2 AND track_len_s >= 0.5 AND first_dist_m <= 200 AND category IN ('view', 'click', 'purchase')")
def geo_04(t):
    return G.filter_tracks(pairs(t), ["view", "click", "purchase"])


@query("geo_05_time_grid", "window_key:s k:n t:d",
       f"WITH {WINDOWS} SELECT window_key, k, (t_start + t_end) / 2 - 2.0 + k * 0.2e0 AS t FROM windows, range(0, 21) AS r(k)")
def geo_05(t):
    return G.time_grid(braking_windows(t).withColumn("t0", (F.col("t_start") + F.col("t_end")) / 2))


@query("geo_06_clamp_state", ACTOR + " vx:d vy:d ax:d ay:d",
       f"WITH {BOX} SELECT window_key, track_uuid, least(greatest(vx*40, -100.0), 100.0) AS vx, least(greatest(vy*40, -100.0), 100.0) AS vy, "
       "least(greatest(ax*40, -20.0), 20.0) AS ax, least(greatest(ay*40, -20.0), 20.0) AS ay FROM boxes")
def geo_06(t):
    return G.clamp_state(boxes(t).withColumns({c: F.col(c) * 40 for c in ("vx", "vy", "ax", "ay")}))


ROLL = BOX + """, roll AS (SELECT *, (l_returnflag = 'R')::INT * 0.7e0 + 0.5e0 AS dt FROM boxes), rolled AS (SELECT *,
    x0 + vx*dt AS cv_x, y0 + vy*dt AS cv_y, CASE WHEN abs(vx) + abs(vy) > 1e-4 THEN atan2(vy, vx) ELSE 0 END AS cv_yaw,
    x0 + vx*dt + 0.5*ax*dt*dt AS ca_x, y0 + vy*dt + 0.5*ay*dt*dt AS ca_y,
    CASE WHEN sqrt((vx+ax*dt)*(vx+ax*dt) + (vy+ay*dt)*(vy+ay*dt)) > 1e-3 THEN atan2(vy+ay*dt, vx+ax*dt)
      WHEN abs(vx) + abs(vy) > 1e-4 THEN atan2(vy, vx) ELSE 0 END AS ca_yaw FROM roll)"""


@query("geo_07_rollout", ACTOR + " cv_x:d cv_y:d cv_yaw:d ca_x:d ca_y:d ca_yaw:d", f"WITH {ROLL} SELECT * FROM rolled")
def geo_07(t):
    return G.rollout(boxes(t).withColumn("dt", F.when(F.col("l_returnflag") == "R", 0.7).otherwise(0.0) + 0.5))


def _box_sql(src, x, y, yaw, out="d", ln="length_m", wd="width_m", ex="0e0", ey="0e0", eyaw="0.3e0", el="4.8e0", ew="2e0"):
    """Distance of a box column set to the ego box: 32 corner-to-edge distances and a separating-axis test."""
    def corners(cx, cy, h, length, width):
        return [f"struct_pack(x := {cx} + cos({h})*{length}/2*{a} - sin({h})*{width}/2*{b}, y := {cy} + sin({h})*{length}/2*{a} + cos({h})*{width}/2*{b})"
                for a, b in ((1, 1), (1, -1), (-1, -1), (-1, 1))]
    a = "[" + ", ".join(corners(ex, ey, eyaw, el, ew)) + "]"
    b = "[" + ", ".join(corners(x, y, yaw, ln, wd)) + "]"
    dists = []
    for p, q in (("pa", "pb"), ("pb", "pa")):
        for i in range(1, 5):
            for j in range(1, 5):
                k = j % 4 + 1
                ax, ay = f"{q}[{j}].x", f"{q}[{j}].y"
                dx, dy = f"({q}[{k}].x-{ax})", f"({q}[{k}].y-{ay})"
                px, py = f"({p}[{i}].x-{ax})", f"({p}[{i}].y-{ay})"
                s = f"least(greatest(({px}*{dx}+{py}*{dy})/({dx}*{dx}+{dy}*{dy}),0.0),1.0)"
                dists.append(f"sqrt(pow({px}-{s}*{dx},2)+pow({py}-{s}*{dy},2))")
    seps = []
    for h in ("ha", "hb"):
        for ux, uy in ((f"cos({h})", f"sin({h})"), (f"-sin({h})", f"cos({h})")):
            pr = {p: [f"({p}[{i}].x*{ux}+{p}[{i}].y*{uy})" for i in range(1, 5)] for p in ("pa", "pb")}
            seps += [f"least({', '.join(pr['pa'])}) > greatest({', '.join(pr['pb'])})", f"least({', '.join(pr['pb'])}) > greatest({', '.join(pr['pa'])})"]
    return (f"(SELECT * EXCLUDE (pa, pb, ha, hb), CASE WHEN {' OR '.join(seps)} THEN least({', '.join(dists)}) ELSE 0.0 END AS {out} "
            f"FROM (SELECT *, {a} AS pa, {b} AS pb, {eyaw} AS ha, {yaw} AS hb FROM {src}))")


def _ego_box():
    return {"x": F.lit(0.0), "y": F.lit(0.0), "len": F.lit(4.8), "wid": F.lit(2.0), "yaw": F.lit(0.3)}


def _box(x, y, yaw):
    return {"x": F.col(x), "y": F.col(y), "len": F.col("length_m"), "wid": F.col("width_m"), "yaw": F.col(yaw)}


@query("geo_08_box_distance", ACTOR + " d:d", f"WITH {BOX} SELECT window_key, track_uuid, d FROM {_box_sql('boxes', 'x0', 'y0', 'yaw')}")
def geo_08(t):
    return G.box_distance(boxes(t), "d", _ego_box(), _box("x0", "y0", "yaw"))


@query("geo_09_softmin", ACTOR + " m:d",
       f"WITH {BOX} SELECT window_key, track_uuid, -0.3*ln((1-w)*exp(-abs(x0)/10/0.3) + w*exp(-abs(y0)/10/0.3) + 1e-12) AS m "
       "FROM (SELECT *, sqrt(ax*ax+ay*ay) / (sqrt(ax*ax+ay*ay) + 0.8) AS w FROM boxes)")
def geo_09(t):
    return boxes(t).withColumn("m", G.softmin(F.abs("x0") / 10, F.abs("y0") / 10, F.hypot("ax", "ay")))


# per order a grid of its line items: step = line number, m = how far the quantity is from 10
STEPS = ("steps AS (SELECT CAST(l_orderkey AS VARCHAR) AS window_key, l_linenumber AS k, min(l_quantity) / 10e0 - 1e0 AS m, "
         "(l_linenumber - 3) * 0.2e0 AS dt FROM lineitem GROUP BY l_orderkey, l_linenumber)")


def steps(t):
    df = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("window_key"), F.col("l_linenumber").alias("k")).agg(
        (F.min("l_quantity") / 10.0 - 1.0).alias("m"))
    return df.withColumn("dt", (F.col("k") - 3) * F.lit(0.2))


@query("geo_10_min_approach", "window_key:s dmin_m:d penetration_m:d t_at_dmin_s:d",
       f"WITH {STEPS} SELECT window_key, greatest(min(m), 0.0) AS dmin_m, greatest(-min(m), 0.0) AS penetration_m, "
       "arg_min(dt, m * 1000 + k) AS t_at_dmin_s FROM steps GROUP BY window_key")
def geo_10(t):
    return G.min_approach(steps(t), ["window_key"])


@query("geo_11_sustained", "window_key:s sustained_tight:b",
       f"WITH {STEPS}, r AS (SELECT window_key, m < 0.6 AND coalesce(lag(m) OVER w < 0.6 AND lag(k) OVER w = k - 1, FALSE) AS two FROM steps WINDOW w AS (PARTITION BY window_key ORDER BY k)) "
       "SELECT window_key, bool_or(two) AS sustained_tight FROM r GROUP BY window_key")
def geo_11(t):
    return G.sustained(steps(t), ["window_key"])


@query("geo_12_p_overlap", ACTOR + " p:d",
       f"WITH {ACTORS} SELECT window_key, track_uuid, exp(-pow(greatest(dmin_m / 10, 0.0) / 1.5, 2)) * "
       "CASE WHEN sustained_tight = 1 THEN 1.0 ELSE 0.6 END AS p FROM actors")
def geo_12(t):
    return actors(t).withColumn("p", G.p_overlap(F.col("dmin_m") / 10, F.col("sustained_tight") == 1))


FR = repr(math.radians(70.0))


@query("geo_13_bearing_sector", ACTOR + " bearing:d sector:n",
       f"WITH {BOX} SELECT window_key, track_uuid, b AS bearing, CASE WHEN abs(b) > {math.pi!r} - {FR} THEN 3 WHEN abs(b) <= {FR} THEN 0 "
       "WHEN b > 0 THEN 1 ELSE 2 END AS sector FROM (SELECT *, atan2(y0, x0) AS b FROM boxes)")
def geo_13(t):
    b, s = G.bearing_sector(F.col("x0"), F.col("y0"))
    return boxes(t).withColumn("bearing", b).withColumn("sector", s)


@query("geo_14_closing_on_path", ACTOR + " closing:d on_path:n",
       f"WITH {BOX} SELECT window_key, track_uuid, greatest(0.0, 2.0 - (vx*cos(yaw) + vy*sin(yaw))) AS closing, "
       "CASE WHEN abs(y0) <= 3 AND x0 >= -5 THEN 1 ELSE 0 END AS on_path FROM boxes")
def geo_14(t):
    c, p = G.closing_on_path(F.col("vx"), F.col("vy"), F.lit(2.0), F.col("yaw"), F.col("x0"), F.col("y0"))
    return boxes(t).withColumn("closing", c).withColumn("on_path", p)


@query("geo_15_static_gate", ACTOR + " p_overlap:d",
       f"WITH {ACTORS} SELECT window_key, track_uuid, p_overlap FROM actors WHERE NOT (is_static = 1 AND sqrt(x_rel_m*x_rel_m + y_rel_m*y_rel_m) > 40) "
       "OR on_path_like = 1 OR p_overlap >= 0.05")
def geo_15(t):
    return G.static_gate(actors(t))


@query("geo_16_order_candidates", ACTOR + " cand_rank:n",
       f"WITH {ACTORS} SELECT * FROM (SELECT window_key, track_uuid, row_number() OVER (PARTITION BY window_key ORDER BY p_overlap DESC, dmin_m, "
       "penetration_m DESC, track_uuid) AS cand_rank FROM (SELECT *, greatest(10 - dmin_m, 0.0) AS penetration_m FROM actors)) WHERE cand_rank <= 3")
def geo_16(t):
    return G.order_candidates(actors(t).withColumn("penetration_m", F.greatest(10 - F.col("dmin_m"), F.lit(0.0))), 3)


FUSED = ACTORS + f""", fused AS (SELECT *, 0.50*p_overlap + 0.25/(1.0 + greatest(dmin_m, 0.0)) + 0.20*sustained_tight
    + 0.05*least(1.0, greatest(a_norm, 0.0)/2.0) + CASE WHEN abs(bearing_rad) <= {FR} THEN 0.03 ELSE 0.0 END
    + CASE WHEN category IN ('BUS','BOX_TRUCK','TRUCK','TRAILER','LARGE_VEHICLE') THEN 0.02 ELSE 0.0 END AS fused,
    p_overlap >= 0.08 OR dmin_m <= 12 OR (abs(bearing_rad) <= {FR} AND rel_speed_closing_mps >= 0.5)
    OR (is_static = 1 AND (on_path_like = 1 OR p_overlap >= 0.05)) AS hard FROM actors),
filled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_key ORDER BY hard DESC, fused DESC, track_uuid) AS tag_rank
    FROM fused) WHERE tag_rank <= 3)"""


@query("geo_17_fused_score", ACTOR + " fused:d", f"WITH {FUSED} SELECT window_key, track_uuid, fused FROM fused")
def geo_17(t):
    return actors(t).withColumn("fused", G.fused_score())


@query("geo_18_union_then_fill", ACTOR + " tag_rank:n hard:b", f"WITH {FUSED} SELECT * FROM filled")
def geo_18(t):
    return G.union_then_fill(actors(t), 3)


@query("geo_19_nest_actors", "window_key:s n:n first:s tracks:s",
       f"WITH {FUSED} SELECT CAST(o.o_orderkey AS VARCHAR) AS window_key, count(f.track_uuid) AS n, arg_min(track_uuid, tag_rank) AS first, "
       "coalesce(string_agg(track_uuid, ',' ORDER BY tag_rank), '') AS tracks FROM orders AS o LEFT JOIN filled AS f ON f.window_key = CAST(o.o_orderkey AS VARCHAR) GROUP BY o.o_orderkey")
def geo_19(t):
    wins = t.orders.select(F.col("o_orderkey").cast("string").alias("window_key"))
    df = G.nest_actors(wins, G.union_then_fill(actors(t), 3), ["track_uuid", "category", "p_overlap", "dmin_m"])
    return df.select("window_key", F.size("top_actors").alias("n"), F.get("top_actors", F.lit(0))["track_uuid"].alias("first"),
                     F.array_join(F.transform("top_actors", lambda a: a["track_uuid"]), ",").alias("tracks"))


# --- map: ten parts make the map of one log ------------------------------------------------------------------

MAPS = """mapf AS (SELECT p_partkey // 10 AS log_id, p_partkey AS feature_id, CASE WHEN p_partkey % 10 < 6 THEN 'lane'
    WHEN p_partkey % 10 < 8 THEN 'crosswalk' ELSE 'drivable' END AS kind, p_partkey % 10 = 5 AS is_intersection,
    [struct_pack(x := k * 10e0, y := (p_partkey % 10) * 4e0 + k * (p_size % 5)) for k in range(0, 5)] AS pts,
    [struct_pack(x := k * 10e0 + 1e0, y := (p_partkey % 10) * 4e0 + 3.5e0 + k * (p_size % 4)) for k in range(0, 5)] AS right_pts FROM part WHERE (p_partkey // 10) % 11 <> 3),
mpts AS (SELECT l_partkey // 10 AS log_id, printf('%d-%d-%d-%d-%d', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT)) AS point_id,
    l_quantity AS x, (l_suppkey % 20) * 2e0 AS y, l_tax * 10 AS heading FROM lineitem),
segs AS (SELECT log_id, feature_id, kind, is_intersection, s AS seg, pts[s+1].x AS ax, pts[s+1].y AS ay, pts[s+2].x - pts[s+1].x AS bx,
    pts[s+2].y - pts[s+1].y AS bdy FROM mapf, range(0, 4) AS r(s) WHERE kind <> 'drivable'),
segd AS (SELECT p.point_id, p.heading, s.*, sqrt(pow(x - ax - u*bx, 2) + pow(y - ay - u*bdy, 2)) AS d, atan2(bdy, bx) AS theta FROM mpts AS p
  JOIN segs AS s USING (log_id), LATERAL (SELECT least(greatest(((x-ax)*bx + (y-ay)*bdy) / (bx*bx + bdy*bdy + 1e-12), 0.0), 1.0) AS u)),
ring AS (SELECT log_id, feature_id, pts[s+1].x AS x1, pts[s+1].y AS y1, pts[CASE WHEN s = 0 THEN 5 ELSE s END].x AS x0,
    pts[CASE WHEN s = 0 THEN 5 ELSE s END].y AS y0 FROM mapf, range(0, 5) AS r(s) WHERE kind = 'drivable'),
poly AS (SELECT point_id, bool_or(hits % 2 = 1) AS inside FROM (SELECT p.point_id, feature_id, count(*) FILTER (
    (y1 > y) <> (y0 > y) AND x < (x1 - x0) * (y - y0) / (y1 - y0 + 1e-12) + x0) AS hits FROM mpts AS p JOIN ring USING (log_id)
    GROUP BY p.point_id, feature_id) GROUP BY point_id)"""


def map_features(t):
    key = F.col("p_partkey")

    def pts(shift_x, shift_y, mod):
        return F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct(
            (k * F.lit(10.0) + shift_x).alias("x"),
            ((key % 10) * F.lit(4.0) + shift_y + k * (F.col("p_size") % mod)).cast("double").alias("y")))
    # some logs have no map
    return t.part.where(F.floor(key / 10) % 11 != 3).select(
        F.floor(key / 10).alias("log_id"), key.alias("feature_id"),
        F.when(key % 10 < 6, "lane").when(key % 10 < 8, "crosswalk").otherwise("drivable").alias("kind"),
        (key % 10 == 5).alias("is_intersection"), pts(0.0, 0.0, 5).alias("pts"), pts(1.0, 3.5, 4).alias("right_pts"))


def map_points(t):
    c = F.col
    return t.lineitem.select(
        F.floor(c("l_partkey") / 10).alias("log_id"),
        F.format_string("%d-%d-%d-%d-%d", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                        F.round(c("l_extendedprice") * 100).cast("bigint")).alias("point_id"),
        c("l_quantity").alias("x"), (c("l_suppkey") % 20 * F.lit(2.0)).alias("y"), (c("l_tax") * 10).alias("heading"))


def _arc_sql(col):
    return (f"(SELECT feature_id, q, CASE WHEN q = 49 THEN px[5] ELSE px[h] + (arc - c[h]) / greatest(l[h], 1e-9) * (px[h+1] - px[h]) END AS x, "
            f"CASE WHEN q = 49 THEN py[5] ELSE py[h] + (arc - c[h]) / greatest(l[h], 1e-9) * (py[h+1] - py[h]) END AS y FROM (SELECT *, "
            f"CASE WHEN c[2] >= arc THEN 1 WHEN c[3] >= arc THEN 2 WHEN c[4] >= arc THEN 3 ELSE 4 END AS h FROM (SELECT *, c[5] * q / 49 AS arc FROM (SELECT *, "
            f"[0e0, l[1], l[1]+l[2], l[1]+l[2]+l[3], l[1]+l[2]+l[3]+l[4]] AS c FROM (SELECT feature_id, [p.x for p in {col}] AS px, [p.y for p in {col}] AS py, "
            f"[sqrt(pow({col}[k+1].x-{col}[k].x,2)+pow({col}[k+1].y-{col}[k].y,2)) for k in range(1,5)] AS l FROM mapf WHERE kind = 'lane')), range(0, 50) AS r(q))))")


@query("geo_20_centerlines", "feature_id:n k:n x:d y:d",
       f"WITH {MAPS} SELECT a.feature_id, a.q AS k, (a.x + b.x) * 0.5 AS x, (a.y + b.y) * 0.5 AS y FROM {_arc_sql('pts')} AS a "
       f"JOIN {_arc_sql('right_pts')} AS b ON a.feature_id = b.feature_id AND a.q = b.q")
def geo_20(t):
    lanes = map_features(t).where("kind = 'lane'").withColumnRenamed("pts", "left_pts")
    return G.centerlines(lanes)


@query("geo_21_nearest_on_polyline", "point_id:s d:d feature_id:n seg:n theta:d",
       f"WITH {MAPS} SELECT point_id, d, feature_id, seg, theta FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY floor(d * 1e9 + 0.5), feature_id, seg) AS rn "
       "FROM segd WHERE kind = 'lane') WHERE rn = 1")
def geo_21(t):
    return G.nearest_on_polyline(map_points(t), map_features(t).where("kind = 'lane'"))


@query("geo_22_point_in_polygon", "point_id:s inside:b", f"WITH {MAPS} SELECT * FROM poly")
def geo_22(t):
    return G.point_in_polygon(map_points(t), map_features(t).where("kind = 'drivable'"))


@query("geo_23_map_cues", "point_id:s map_lane_offset_m:d map_lane_alignment_cos:d dist_to_stopline_m:d dist_to_crosswalk_m:d in_drivable_area:d",
       f"WITH {MAPS}, lane AS (SELECT point_id, d, cos(heading - theta) AS al FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY floor(d * 1e9 + 0.5), feature_id, seg) AS rn "
       f"FROM segd WHERE kind = 'lane') WHERE rn = 1), c AS (SELECT point_id, min(d) FILTER (kind = 'crosswalk') AS cw, min(d) FILTER (is_intersection) AS it FROM segd GROUP BY point_id), "
       f"cf AS (SELECT point_id, min(d) AS ah FROM (SELECT *, row_number() OVER (PARTITION BY point_id, feature_id ORDER BY floor(d * 1e9 + 0.5), seg) AS rn FROM segd WHERE kind = 'crosswalk') "
       f"WHERE rn = 1 AND abs((((theta - heading + {math.pi!r}) % {2 * math.pi!r}) + {2 * math.pi!r}) % {2 * math.pi!r} - {math.pi!r}) < {math.pi / 2!r} GROUP BY point_id) "
       "SELECT m.point_id, lane.d AS map_lane_offset_m, lane.al AS map_lane_alignment_cos, coalesce(cf.ah, c.it) AS dist_to_stopline_m, c.cw AS dist_to_crosswalk_m, "
       "CASE WHEN m.log_id IN (SELECT log_id FROM mapf) THEN CASE WHEN coalesce(poly.inside, lane.d < 3.5, FALSE) THEN 1.0 ELSE 0.0 END END AS in_drivable_area FROM mpts AS m LEFT JOIN lane USING (point_id) LEFT JOIN c USING (point_id) "
       "LEFT JOIN cf USING (point_id) LEFT JOIN poly USING (point_id)")
def geo_23(t):
    return G.map_cues(map_points(t), map_features(t))


PI2 = f"{2 * math.pi!r}"
TWO_SIDED = f"""{MAPS}, cl AS (SELECT a.feature_id, a.q, (a.x + b.x) * 0.5 AS x, (a.y + b.y) * 0.5 AS y FROM {_arc_sql('pts')} AS a JOIN {_arc_sql('right_pts')} AS b ON a.feature_id = b.feature_id AND a.q = b.q),
s2 AS (SELECT log_id, feature_id, kind, is_intersection, 0 AS edge, p.q AS seg, p.x AS ax, p.y AS ay, n.x - p.x AS bx, n.y - p.y AS bdy FROM mapf JOIN cl AS p USING (feature_id) JOIN cl AS n ON n.feature_id = p.feature_id AND n.q = p.q + 1
  UNION ALL SELECT log_id, feature_id, kind, is_intersection, 0, s, pts[s+1].x, pts[s+1].y, pts[s+2].x - pts[s+1].x, pts[s+2].y - pts[s+1].y FROM mapf, range(0, 4) AS r(s) WHERE kind = 'crosswalk'
  UNION ALL SELECT log_id, feature_id, kind, is_intersection, 1, s, right_pts[s+1].x, right_pts[s+1].y, right_pts[s+2].x - right_pts[s+1].x, right_pts[s+2].y - right_pts[s+1].y FROM mapf, range(0, 4) AS r(s) WHERE kind = 'crosswalk'),
d2 AS (SELECT p.point_id, p.heading, s.*, sqrt(pow(x - ax - u*bx, 2) + pow(y - ay - u*bdy, 2)) AS d, atan2(bdy, bx) AS theta FROM mpts AS p
  JOIN s2 AS s USING (log_id), LATERAL (SELECT least(greatest(((x-ax)*bx + (y-ay)*bdy) / (bx*bx + bdy*bdy + 1e-12), 0.0), 1.0) AS u)),
per AS MATERIALIZED (SELECT point_id, kind, feature_id, edge, any_value(is_intersection) AS it, any_value(heading) AS heading, min(d) AS d, arg_min(theta, floor(d * 1e9 + 0.5) * 64 + seg) AS theta FROM d2 GROUP BY point_id, kind, feature_id, edge),
cues AS (SELECT point_id, min(d) FILTER (kind = 'lane') AS lane, arg_min(cos(heading - theta), floor(d * 1e9 + 0.5) * 1e5 + feature_id) FILTER (kind = 'lane') AS al, min(d) FILTER (kind = 'crosswalk') AS cw, min(d) FILTER (kind = 'lane' AND it) AS inter,
  min(d) FILTER (kind = 'crosswalk' AND abs((((theta - heading + {math.pi!r}) % {PI2}) + {PI2}) % {PI2} - {math.pi!r}) < {math.pi / 2!r}) AS ahead FROM per GROUP BY point_id)"""


@query("geo_26_two_sided_map_cues", "point_id:s map_lane_offset_m:d map_lane_alignment_cos:d dist_to_stopline_m:d dist_to_crosswalk_m:d in_drivable_area:d",
       f"WITH {TWO_SIDED} SELECT m.point_id, lane AS map_lane_offset_m, al AS map_lane_alignment_cos, coalesce(ahead, inter) AS dist_to_stopline_m, cw AS dist_to_crosswalk_m, "
       "CASE WHEN m.log_id IN (SELECT log_id FROM mapf) THEN CASE WHEN coalesce(poly.inside, lane < 3.5, FALSE) THEN 1.0 ELSE 0.0 END END AS in_drivable_area "
       "FROM mpts AS m LEFT JOIN cues USING (point_id) LEFT JOIN poly USING (point_id)")
def geo_26(t):
    """Cues from features as a map file gives them: both boundaries of a lane, both edges of a crosswalk."""
    return G.map_cues(map_points(t), map_features(t).withColumnRenamed("right_pts", "pts2"))


@query("geo_24_angle_diff", ACTOR + " diff:d",
       f"WITH {BOX} SELECT window_key, track_uuid, (((yaw*7 - atan2(y0, x0) + {math.pi!r}) % {2 * math.pi!r}) + {2 * math.pi!r}) % {2 * math.pi!r} - {math.pi!r} AS diff FROM boxes")
def geo_24(t):
    return boxes(t).withColumn("diff", G.angle_diff(F.col("yaw") * 7, F.atan2("y0", "x0")))


@query("geo_25_tag_actors", ACTOR + " tag_rank:n dmin_m:d p_overlap:d sustained_tight:b")
def geo_25(t):
    """The whole tagger; its parts have oracles of their own."""
    states = boxes(t).withColumn("a_norm", F.hypot("ax", "ay"))
    ego = t.orders.select(F.col("o_orderkey").cast("string").alias("window_key"), F.lit(0.0).alias("ex"), F.lit(0.0).alias("ey"),
                          (F.col("o_orderkey") % 6 / 10.0).alias("eyaw"), F.lit(8.0).alias("ev"))
    return G.tag_actors(states, ego, k=3)


# --- the tagger on recorded paths: poses every 0.05 s, annotations 0.02 s after them, a track per event type -----------------------------

def ego_path(t):
    i = F.col("i")
    return ego_signal(t).select("log_id", "t_s", (i * F.lit(0.4)).alias("px"), (i % 50 * F.lit(0.1)).alias("py"), (i % 60 / F.lit(100.0) - 0.3).alias("pyaw"), F.col("speed").alias("pv"))


def annotated(t):
    i, kind = F.col("i"), F.length("event_type") % 5
    return ego_signal(t).select("log_id", F.col("event_type").alias("track_uuid"), (F.col("t_s") + F.lit(0.02)).alias("t_s"),
                                F.when(kind == 0, "BUS").when(kind == 1, "PEDESTRIAN").when(kind == 2, "SIGN").otherwise("TRUCK").alias("category"),
                                (F.length("event_type") / F.lit(2.0)).alias("length_m"), F.lit(1.8).alias("width_m"),
                                (i % 13 * F.lit(0.5) + 3.0).alias("x"), (i % 7 - F.lit(3.0)).alias("y"))


def _lerp(c, j, f):
    return f"(a{j}.{c} + (b{j}.{c} - a{j}.{c}) * {f})"


RECORDED = WINDOWS + f""", path AS (SELECT log_id, i, t_s, i * 0.4e0 AS px, (i % 50) * 0.1e0 AS py, (i % 60) / 100e0 - 0.3e0 AS pyaw, speed AS pv, event_type FROM ego),
ends AS (SELECT log_id, max(i) AS n FROM path GROUP BY log_id),
ann AS (SELECT a.log_id, a.event_type AS track_uuid, a.t_s + 0.02e0 AS t_s, length(a.event_type) AS ln, (a.i % 13) * 0.5e0 + 3e0 AS x, (a.i % 7) - 3e0 AS y,
    a.px + (coalesce(b.px, a.px) - a.px) * 0.4e0 AS ox, a.py + (coalesce(b.py, a.py) - a.py) * 0.4e0 AS oy, a.pyaw + (coalesce(b.pyaw, a.pyaw) - a.pyaw) * 0.4e0 AS oyaw
  FROM path AS a LEFT JOIN path AS b ON b.log_id = a.log_id AND b.i = a.i + 1),
city AS (SELECT log_id, track_uuid, t_s, ln, ox + cos(oyaw)*x - sin(oyaw)*y AS x, oy + sin(oyaw)*x + cos(oyaw)*y AS y FROM ann),
cw AS (SELECT window_key, log_id, (t_start + t_end) / 2 AS t0 FROM windows),
pairs AS (SELECT cw.window_key, t0, city.* FROM cw JOIN city USING (log_id) WHERE abs(t0 - t_s) <= 6.0),
facts AS (SELECT window_key, track_uuid, any_value(ln) AS ln FROM pairs GROUP BY ALL HAVING max(t_s) - min(t_s) >= 0.5 AND any_value(ln) % 5 <> 1),
grid AS (SELECT g.window_key, k, t - t0 AS dt, {', '.join(_lerp(c, 1, 'f') + ' AS ' + o for c, o in (('px', 'gx'), ('py', 'gy'), ('pyaw', 'gyaw')))} FROM (
    SELECT *, least(greatest(t / 5e-2 - j, 0.0), 1.0) AS f FROM (SELECT *, least(greatest(floor(t / 5e-2), 0), n) AS j FROM (SELECT cw.*, n, k, t0 - 2e0 + k * 0.2e0 AS t FROM cw JOIN ends USING (log_id), range(0, 21) AS r(k)))) AS g
  JOIN path AS a1 ON a1.log_id = g.log_id AND a1.i = j JOIN path AS b1 ON b1.log_id = g.log_id AND b1.i = least(j + 1, n)),
speed AS (SELECT window_key, {_lerp('pv', 1, 'f')} AS ev FROM (SELECT *, least(greatest(t0 / 5e-2 - j, 0.0), 1.0) AS f FROM (SELECT cw.*, n, least(greatest(floor(t0 / 5e-2), 0), n) AS j FROM cw JOIN ends USING (log_id))) AS g
  JOIN path AS a1 ON a1.log_id = g.log_id AND a1.i = j JOIN path AS b1 ON b1.log_id = g.log_id AND b1.i = least(j + 1, n)),
egoc AS (SELECT window_key, gx AS ex, gy AS ey, gyaw AS eyaw, ev FROM grid JOIN speed USING (window_key) WHERE k = 10)"""


def _state_sql():
    """The fit of ``geo_02`` with slope and curvature kept."""
    inner = _fit_sql().split(", ann AS", 1)[1].split("c AS (SELECT *, t_s - t0 AS dt", 1)[1]
    inner = "c AS (SELECT *, t_s - t0 AS dt" + inner.rsplit("SELECT window_key, track_uuid, n_samples, floor", 1)[0]
    q = {v: f"CASE WHEN n >= 3 THEN {v}q0 ELSE (q{v}0 - l{v}*s1) / n END" for v in "xy"}
    return inner.rstrip() + f""", st AS (SELECT window_key, track_uuid, {q['x']} AS x0, {q['y']} AS y0, CASE WHEN n >= 3 THEN xq1 ELSE lx END AS rvx, CASE WHEN n >= 3 THEN yq1 ELSE ly END AS rvy,
    CASE WHEN n >= 3 THEN xq2 ELSE 0 END AS rax, CASE WHEN n >= 3 THEN yq2 ELSE 0 END AS ray FROM f)"""


TAGGED = "WITH " + RECORDED + ", " + _state_sql() + f""", base AS (SELECT st.window_key, st.track_uuid, x0, y0, least(greatest(rvx, -100.0), 100.0) AS vx, least(greatest(rvy, -100.0), 100.0) AS vy, least(greatest(rax, -20.0), 20.0) AS ax,
    least(greatest(ray, -20.0), 20.0) AS ay, sqrt(rax*rax + ray*ray) AS a_norm, ln, ln / 2e0 AS length_m, 1.8e0 AS width_m, ex, ey, eyaw, ev FROM st JOIN facts USING (window_key, track_uuid) JOIN egoc USING (window_key)
  WHERE sqrt(pow(x0 - ex, 2) + pow(y0 - ey, 2)) <= 200),
roll AS (SELECT base.*, k, dt, gx, gy, gyaw, x0 + vx*dt AS cx, y0 + vy*dt AS cy, CASE WHEN abs(vx) + abs(vy) > 1e-4 THEN atan2(vy, vx) ELSE 0 END AS cyaw, x0 + vx*dt + 0.5*ax*dt*dt AS qx, y0 + vy*dt + 0.5*ay*dt*dt AS qy,
    CASE WHEN sqrt(pow(vx+ax*dt, 2) + pow(vy+ay*dt, 2)) > 1e-3 THEN atan2(vy+ay*dt, vx+ax*dt) WHEN abs(vx) + abs(vy) > 1e-4 THEN atan2(vy, vx) ELSE 0 END AS qyaw FROM base JOIN grid USING (window_key)),
d1 AS (SELECT * FROM {_box_sql('roll', 'cx', 'cy', 'cyaw', 'dcv', ex='gx', ey='gy', eyaw='gyaw')}),
d2 AS (SELECT * FROM {_box_sql('d1', 'qx', 'qy', 'qyaw', 'dca', ex='gx', ey='gy', eyaw='gyaw')}),
sm AS (SELECT window_key, track_uuid, k, dt, -0.3*ln((1-w)*exp(-dcv/0.3) + w*exp(-dca/0.3) + 1e-12) AS m FROM (SELECT *, a_norm / (a_norm + 0.8) AS w FROM d2)),
low AS (SELECT window_key, track_uuid, greatest(min(m), 0.0) AS dmin_m, greatest(-min(m), 0.0) AS penetration_m, bool_or(two) AS sustained_tight FROM (SELECT *, m < 0.6 AND coalesce(lag(m) OVER (PARTITION BY window_key, track_uuid ORDER BY k) < 0.6, FALSE) AS two FROM sm) GROUP BY ALL),
sc AS (SELECT *, abs(bearing) <= {FR} AS front, CASE WHEN sustained_tight THEN 1.0 ELSE 0.6 END * exp(-pow(dmin_m / 1.5, 2)) AS p_overlap, CASE WHEN abs(y_rel) <= 3 AND x_rel >= -5 THEN 1 ELSE 0 END AS on_path,
    greatest(0.0, ev - (vx*cos(eyaw) + vy*sin(eyaw))) AS closing, ln % 5 = 2 AS still, ln % 5 NOT IN (1, 2) AS large FROM (SELECT *, atan2(y_rel, x_rel) AS bearing FROM (
    SELECT base.*, dmin_m, penetration_m, sustained_tight, cos(eyaw)*(x0-ex) + sin(eyaw)*(y0-ey) AS x_rel, cos(eyaw)*(y0-ey) - sin(eyaw)*(x0-ex) AS y_rel FROM base JOIN low USING (window_key, track_uuid)))),
gated AS (SELECT *, 0.50*p_overlap + 0.25/(1.0 + dmin_m) + 0.20*sustained_tight::INT + 0.05*least(1.0, a_norm/2.0) + CASE WHEN front THEN 0.03 ELSE 0 END + CASE WHEN large THEN 0.02 ELSE 0 END AS fused,
    p_overlap >= 0.08 OR dmin_m <= 12 OR (front AND closing >= 0.5) OR (still AND (on_path = 1 OR p_overlap >= 0.05)) OR (front AND large) AS hard FROM sc
  WHERE NOT (still AND sqrt(x_rel*x_rel + y_rel*y_rel) > 40) OR on_path = 1 OR p_overlap >= 0.05)"""


@query("geo_27_tag_recorded", ACTOR + " dmin_m:d p_overlap:d sustained_tight:b x_rel_m:d y_rel_m:d closing:d on_path:n hard:b",
       TAGGED + " SELECT window_key, track_uuid, dmin_m, p_overlap, sustained_tight, x_rel AS x_rel_m, y_rel AS y_rel_m, closing, on_path, hard FROM gated")
def geo_27(t):
    """Poses and annotations to tagged actors; all of a window's tracks, as there are fewer than the 24 that would be kept."""
    wins = braking_windows(t).select("log_id", "window_key", ((F.col("t_start") + F.col("t_end")) / 2).alias("t0"))
    tags = G.tag_recorded(ego_path(t), annotated(t), wins, ["BUS", "TRUCK", "SIGN"])
    return tags.withColumnsRenamed({"rel_speed_closing_mps": "closing", "on_path_like": "on_path"})
