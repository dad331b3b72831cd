"""SIG-*: signal preparation and event detection over the events table."""

from pyspark.sql import functions as F

from roadsift.functions.keys import window_key
from roadsift.operators import signal as S
from roadsift.plans.fixtures import (EGO, KIN, MASK, MERGED, POSE, SEGS, WINDOWS, braking_windows, ego_pose,
                                     ego_signal)
from roadsift.plans.registry import query

HOUR_HZ = 1.0 / 3600.0
STEP = 1.0 / HOUR_HZ


@query("sig_01_sort_unique", "log_id:s t_s:d seq:n x:d y:d",
       f"WITH {POSE} SELECT log_id, floor(t_s / 86400) * 86400.0 AS t_s, min(seq) AS seq, arg_min(x, seq) AS x, "
       "arg_min(y, seq) AS y FROM pose GROUP BY log_id, floor(t_s / 86400)")
def sig_01(t):
    """Timestamps are cut to whole days first, so that equal ones exist."""
    return S.sort_unique(ego_pose(t).withColumn("t_s", F.floor(F.col("t_s") / 86400) * F.lit(86400.0)))


UNIFORM = POSE + f""", span AS (SELECT log_id, min(t_s) AS t0, max(t_s) AS t1 FROM pose GROUP BY log_id HAVING count(*) >= 3),
grid AS (SELECT log_id, t0, CAST(i AS BIGINT) AS i, t0 + i * CAST({STEP!r} AS DOUBLE) AS t_s
  FROM span, unnest(range(0, CAST(floor((t1 - t0) / {STEP!r}) AS BIGINT) + 1)) AS u(i)),
nxt AS (SELECT *, lead(t_s) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM pose
  WINDOW w AS (PARTITION BY log_id ORDER BY t_s)),
uniform AS (SELECT g.log_id, g.i, g.t_s,
    CASE WHEN nt IS NULL THEN x ELSE x + (nx - x) * ((g.t_s - n.t_s) / (nt - n.t_s)) END AS x,
    CASE WHEN nt IS NULL THEN y ELSE y + (ny - y) * ((g.t_s - n.t_s) / (nt - n.t_s)) END AS y
  FROM grid AS g ASOF JOIN nxt AS n ON g.log_id = n.log_id AND g.t_s >= n.t_s)"""


@query("sig_02_resample", "log_id:s i:n t_s:d x:d y:d", f"WITH {UNIFORM} SELECT * FROM uniform")
def sig_02(t):
    return S.resample(ego_pose(t), HOUR_HZ)


def _cd(c, dt):
    return (f"CASE WHEN lead({c}) OVER w IS NOT NULL AND lag({c}) OVER w IS NOT NULL "
            f"THEN (lead({c}) OVER w - lag({c}) OVER w) / (2 * {dt}) WHEN lead({c}) OVER w IS NOT NULL "
            f"THEN (lead({c}) OVER w - {c}) / {dt} WHEN lag({c}) OVER w IS NOT NULL "
            f"THEN ({c} - lag({c}) OVER w) / {dt} ELSE 0.0 END")


@query("sig_03_central_diff", "log_id:s i:n d_speed:d",
       f"WITH {EGO} SELECT log_id, i, {_cd('speed', 0.05)} AS d_speed FROM ego WINDOW w AS (PARTITION BY log_id ORDER BY i)")
def sig_03(t):
    return S.central_diff(ego_signal(t), ["speed"])


@query("sig_04_speed", "log_id:s i:n speed:d",
       f"WITH {UNIFORM} SELECT log_id, i, sqrt(vx * vx + vy * vy) AS speed FROM (SELECT log_id, i, "
       f"{_cd('x', STEP)} AS vx, {_cd('y', STEP)} AS vy FROM uniform WINDOW w AS (PARTITION BY log_id ORDER BY i))")
def sig_04(t):
    return S.speed(S.resample(ego_pose(t), HOUR_HZ), STEP)


def _savgol_sql():
    inner = " + ".join(f"{S.savgol_weights(9, 2, 4)[k]!r} * v{k - 4 + 8}" for k in range(9))
    cases = []
    for at in range(4):
        first = " + ".join(f"{S.savgol_weights(9, 2, at)[k]!r} * v{k - at + 8}" for k in range(9))
        last = " + ".join(f"{S.savgol_weights(9, 2, 8 - at)[k]!r} * v{k - (8 - at) + 8}" for k in range(9))
        cases += [f"WHEN i = {at} THEN {first}", f"WHEN i = n - 1 - {at} THEN {last}"]
    shifts = ", ".join(f"{'lead' if s >= 0 else 'lag'}(speed, {abs(s)}) OVER w AS v{s + 8}" for s in range(-8, 9))
    return (f"WITH {EGO}, nb AS (SELECT log_id, i, speed, count(*) OVER (PARTITION BY log_id) AS n, {shifts} FROM ego "
            f"WINDOW w AS (PARTITION BY log_id ORDER BY i)) SELECT log_id, i, CASE WHEN n < 5 THEN speed "
            f"{' '.join(cases)} ELSE {inner} END AS smooth FROM nb")


@query("sig_05_savgol", "log_id:s i:n smooth:d", _savgol_sql())
def sig_05(t):
    return S.savgol(ego_signal(t), "speed")


@query("sig_06_gradient", "log_id:s i:n a:d j:d", f"WITH {KIN} SELECT log_id, i, a, j FROM kin")
def sig_06(t):
    return S.kinematics(ego_signal(t))


@query("sig_07_resolve_threshold", "log_id:s a_thr:d", f"WITH {MASK} SELECT log_id, a_thr FROM thr")
def sig_07(t):
    return S.resolve_threshold(S.kinematics(ego_signal(t)), "a", "pct:10", out="a_thr")


@query("sig_08_global_percentiles", "metric:s pct:d n:n value:d",
       f"WITH {WINDOWS}, long AS (SELECT 'a_min' AS metric, a_min_ms2 AS v FROM windows UNION ALL "
       "SELECT 'j_min', j_min_ms3 FROM windows), q AS (SELECT metric, count(*) AS n, quantile_cont(v, "
       "[0.01, 0.05, 0.1, 0.125, 0.15, 0.2, 0.25, 0.5]) AS qs FROM long GROUP BY metric) SELECT metric, n, "
       "unnest([1, 5, 10, 12.5, 15, 20, 25, 50]) AS pct, unnest(qs) AS value FROM q")
def sig_08(t):
    w = braking_windows(t)
    return S.global_percentiles(w.unionByName(w))


@query("sig_09_brake_mask", "log_id:s i:n mask:b mask_and:b",
       f"WITH {MASK} SELECT log_id, i, mask, mask_and FROM masked")
def sig_09(t):
    return S.brake_mask(S.kinematics(ego_signal(t)), "pct:10", "pct:10")


def _masked(t):
    return S.brake_mask(S.kinematics(ego_signal(t)), "pct:10", "pct:10")


@query("sig_10_segments", "log_id:s s:n e:n t_s0:d t_s1:d", f"WITH {SEGS} SELECT * FROM segs")
def sig_10(t):
    return S.segments(_masked(t))


@query("sig_11_merge_segments", "log_id:s s:n e:n t_s0:d t_s1:d", f"WITH {MERGED} SELECT * FROM merged")
def sig_11(t):
    return S.merge_segments(S.segments(_masked(t)))


@query("sig_12_filter_segments", "log_id:s s:n e:n dv:d frac:d",
       f"WITH {WINDOWS} SELECT log_id, s, e, dv, frac FROM wstat WHERE dv >= 0.8 AND frac >= 0.1")
def sig_12(t):
    masked = _masked(t)
    return S.filter_segments(S.merge_segments(S.segments(masked)), masked, mode="SOFT_AND", frac=0.1)


WINDOW_SPEC = "window_key:s log_id:s i_start:n i_end:n t_start:d t_end:d dur_s:d a_min_ms2:d j_min_ms3:d"


@query("sig_13_window_records", WINDOW_SPEC, f"WITH {WINDOWS} SELECT * FROM windows")
def sig_13(t):
    return braking_windows(t)


def _fixed_windows(name, a, j, gap, dv):
    """The detection chain of the fixtures with fixed thresholds."""
    return (WINDOWS.replace("thr AS (SELECT log_id, quantile_cont(a, 0.1) AS a_thr, quantile_cont(j, 0.1) AS j_thr\n"
                            "    FROM kin GROUP BY log_id)",
                            f"thr AS (SELECT DISTINCT log_id, {a} AS a_thr, {j} AS j_thr FROM kin)")
            .replace("gap > 0.2", f"gap > {gap}").replace("dv >= 0.8", f"dv >= {dv}"))


@query("sig_14_rescue_windows", "window_key:s log_id:s t_start:d t_end:d rescued:b",
       f"WITH p AS (WITH {_fixed_windows('p', -2000.0, -60000.0, 0.2, 0.8)} SELECT * FROM windows), "
       f"r AS (WITH {_fixed_windows('r', -1500.0, -45000.0, 0.25, 0.6)} SELECT * FROM windows) "
       "SELECT window_key, log_id, t_start, t_end, FALSE AS rescued FROM p UNION ALL SELECT window_key, log_id, "
       "t_start, t_end, TRUE FROM r WHERE window_key NOT IN (SELECT window_key FROM p)")
def sig_14(t):
    """Presets scaled to the value range of the events."""
    ego = ego_signal(t)
    primary = S.detect_windows(ego, -2000.0, -60000.0, 0.25, 0.2, min_delta_v=0.8)
    softer = S.detect_windows(ego, -1500.0, -45000.0, 0.25, 0.25, min_delta_v=0.6)
    return S.rescue_windows(primary, softer)


@query("sig_15_interp_at", "log_id:s o_orderkey:n q_t:d x:d y:d",
       f"WITH {POSE}, span AS (SELECT log_id, min(t_s) AS t0, max(t_s) AS t1 FROM pose GROUP BY log_id), "
       "asks AS (SELECT s.log_id, o_orderkey, t0 - 100.0 + (t1 - t0 + 200.0) * ((o_orderkey % 1009) / 1009.0) AS q_t "
       "FROM orders JOIN span AS s ON s.log_id = CAST(o_custkey AS VARCHAR)), "
       "a AS (SELECT q.*, p.t_s AS pt, p.x AS px, p.y AS py FROM asks AS q ASOF LEFT JOIN pose AS p "
       "ON q.log_id = p.log_id AND q.q_t >= p.t_s), b AS (SELECT a.*, n.t_s AS nt, n.x AS nx, n.y AS ny FROM a "
       "ASOF LEFT JOIN pose AS n ON a.log_id = n.log_id AND a.q_t <= n.t_s) SELECT log_id, o_orderkey, q_t, "
       "CASE WHEN pt IS NULL THEN nx WHEN nt IS NULL OR pt = q_t THEN px ELSE px + (nx - px) * ((q_t - pt) / (nt - pt)) END AS x, "
       "CASE WHEN pt IS NULL THEN ny WHEN nt IS NULL OR pt = q_t THEN py ELSE py + (ny - py) * ((q_t - pt) / (nt - pt)) END AS y FROM b")
def sig_15(t):
    """Order keys give query times before, inside and after the series of the log with the same id."""
    pose = ego_pose(t)
    span = pose.groupBy("log_id").agg(F.min("t_s").alias("t0"), F.max("t_s").alias("t1"))
    asks = t.orders.select(F.col("o_custkey").cast("string").alias("log_id"), "o_orderkey").join(span, "log_id").select(
        "log_id", "o_orderkey",
        (F.col("t0") - 100.0 + (F.col("t1") - F.col("t0") + 200.0) * (F.col("o_orderkey") % 1009 / 1009.0)).alias("q_t"))
    return S.interp_at(pose, asks, ["x", "y"])


@query("sig_16_quat_to_yaw", "event_id:n yaw:d",
       "SELECT event_id, atan2(2.0 * (cos(h) * sin(h)), 1.0 - 2.0 * (sin(h) * sin(h))) AS yaw "
       "FROM (SELECT event_id, value / 100.0 AS h FROM events)")
def sig_16(t):
    h = F.col("value") / 100.0
    return t.events.select("event_id", S.quat_to_yaw(F.cos(h), F.lit(0.0), F.lit(0.0), F.sin(h)).alias("yaw"))


@query("sig_17_union_windows", "window_key:s source:s",
       f"WITH p AS (WITH {WINDOWS} SELECT * FROM windows), r AS (WITH "
       f"{_fixed_windows('r', -1500.0, -45000.0, 0.2, 0.8)} SELECT * FROM windows) "
       "SELECT window_key, 'own' AS source FROM p UNION ALL SELECT window_key, 'fixed' FROM r")
def sig_17(t):
    ego = ego_signal(t)
    own = S.detect_windows(ego, "pct:10", "pct:10").withColumn("source", F.lit("own"))
    fixed = S.detect_windows(ego, -1500.0, -45000.0).withColumn("source", F.lit("fixed"))
    return S.union_windows(own, fixed)

