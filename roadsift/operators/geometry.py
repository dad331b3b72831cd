"""Actor geometry, overlap tagging and map cues (GEO-*).  Everything is a column expression, join or aggregate."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from roadsift.functions import mapscan
from roadsift.functions.durable import stored
from roadsift.functions.intervals import near_join

# Published tagging configuration.
CATEGORIES = ["REGULAR_VEHICLE", "LARGE_VEHICLE", "BUS", "BOX_TRUCK", "TRUCK", "TRAILER", "MOTORCYCLE", "BICYCLE",
              "PEDESTRIAN", "STOP_SIGN", "TRAFFIC_SIGN", "SIGN", "BOLLARD", "CONE", "BARRIER", "POLE"]
STATIC = ["STOP_SIGN", "TRAFFIC_SIGN", "SIGN", "BOLLARD", "CONE", "BARRIER", "POLE", "UNKNOWN_STATIC"]
LARGE = ["BUS", "BOX_TRUCK", "TRUCK", "TRAILER", "LARGE_VEHICLE"]
EGO_LENGTH, EGO_WIDTH = 4.8, 2.0
FRONT = math.radians(70.0)


def ego_to_city(x: Column, y: Column, yaw: Column, tx: Column, ty: Column) -> tuple[Column, Column]:
    """GEO-01: vehicle frame to city frame."""
    return tx + F.cos(yaw) * x - F.sin(yaw) * y, ty + F.sin(yaw) * x + F.cos(yaw) * y


def city_to_ego(x: Column, y: Column, yaw: Column, tx: Column, ty: Column) -> tuple[Column, Column]:
    """GEO-01: city frame to vehicle frame."""
    dx, dy = x - tx, y - ty
    return F.cos(yaw) * dx + F.sin(yaw) * dy, F.cos(yaw) * dy - F.sin(yaw) * dx


def near_event(annotations: DataFrame, windows: DataFrame, pad: float = 6.0, t: str = "t_s", centre: str = "t0",
               log: str = "log_id", win: str = "window_key") -> DataFrame:
    """GEO-03: annotations within ``pad`` seconds of a window centre; the whole log for windows that have none."""
    near = near_join(windows, annotations, [log], centre, t, pad)
    alone = windows.join(near.select(win).distinct(), win, "left_anti")
    return near.unionByName(alone.join(annotations, log))


def _moments(pre: str, keep: Column, dt: Column) -> list[Column]:
    u = 0.5 * dt * dt
    terms = {"n": F.lit(1.0), "t": dt, "u": u, "tt": dt * dt, "tu": dt * u, "uu": u * u, "x": F.col("x"), "tx": dt * F.col("x"),
             "ux": u * F.col("x"), "y": F.col("y"), "ty": dt * F.col("y"), "uy": u * F.col("y")}
    return [F.coalesce(F.sum(F.when(keep, v)), F.lit(0.0)).alias(f"{pre}{k}") for k, v in terms.items()]


def _solve(pre: str, v: str, quad: Column) -> list[Column]:
    """Value, slope and curvature at the centre from the normal equations (Cramer's rule)."""
    n, t, u, tt, tu, uu = (F.col(f"{pre}{k}") for k in ("n", "t", "u", "tt", "tu", "uu"))
    a, b, c = F.col(f"{pre}{v}"), F.col(f"{pre}t{v}"), F.col(f"{pre}u{v}")

    def det(r):
        return (r[0][0] * (r[1][1] * r[2][2] - r[1][2] * r[2][1]) - r[0][1] * (r[1][0] * r[2][2] - r[1][2] * r[2][0])
                + r[0][2] * (r[1][0] * r[2][1] - r[1][1] * r[2][0]))
    # what rounding leaves of a determinant that is zero counts as zero
    d3, d2 = det([[n, t, u], [t, tt, tu], [u, tu, uu]]), n * tt - t * t
    d3, d2 = F.when(d3 > 1e-14 * n * tt * uu, d3), F.when(d2 > 1e-14 * n * tt, d2)
    q0 = F.try_divide(det([[a, t, u], [b, tt, tu], [c, tu, uu]]), d3)
    q1 = F.try_divide(det([[n, a, u], [t, b, tu], [u, c, uu]]), d3)
    q2 = F.try_divide(det([[n, t, a], [t, tt, b], [u, tu, c]]), d3)
    # samples of fewer than three different times have no parabola, those of one time no slope
    l1 = F.coalesce(F.try_divide(n * b - t * a, d2), F.lit(0.0))
    l0 = F.try_divide(a - l1 * t, n)
    quad = quad & q0.isNotNull()
    return [F.when(quad, q0).otherwise(l0), F.when(quad, q1).otherwise(l1), F.when(quad, q2).otherwise(F.lit(0.0))]


def fit_state(tracks: DataFrame, keys: Sequence[str] = ("window_key", "track_uuid"), t: str = "t_s", t0: str = "t0",
              win: float = 0.8, widen: float = 1.2) -> DataFrame:
    """GEO-02: least-squares position, velocity and acceleration of each track at ``t0``.

    Samples within ``win``; within ``widen`` when fewer than three; the nearest two when still fewer than two.
    Quadratic for three or more samples, linear otherwise; also linear where they have fewer than three different times.
    """
    keys = list(keys)
    dt = F.col(t) - F.col(t0)
    sums = tracks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"), *_moments("a_", F.abs(dt) <= win, dt),
                                     *_moments("b_", F.abs(dt) <= widen, dt)).where("_all >= 2")
    closest = Window.partitionBy(*keys).orderBy(F.abs(dt), t)
    two = tracks.withColumn("_k", F.row_number().over(closest)).where("_k <= 2").groupBy(*keys).agg(
        *_moments("c_", F.lit(True), dt))
    df = sums.join(two, keys)
    use_a, use_b = F.col("a_n") >= 3, F.col("b_n") >= 2
    out = {}
    for v, names in (("x", ("x0", "vx", "ax")), ("y", ("y0", "vy", "ay"))):
        for k, name in enumerate(names):
            out[name] = F.when(use_a, _solve("a_", v, F.lit(True))[k]) \
                .when(use_b, _solve("b_", v, F.col("b_n") >= 3)[k]).otherwise(_solve("c_", v, F.lit(False))[k])
    n = F.when(use_a, F.col("a_n")).when(use_b, F.col("b_n")).otherwise(F.col("c_n")).cast("bigint")
    return df.select(*keys, *[c.alias(k) for k, c in out.items()], n.alias("n_samples")) \
             .withColumn("a_norm", F.hypot("ax", "ay"))


def filter_tracks(pairs: DataFrame, cats: Sequence[str] | None = None, min_len: float = 0.5, max_dist: float = 200.0,
                  keys: Sequence[str] = ("window_key", "track_uuid"), t: str = "t_s") -> DataFrame:
    """GEO-04: tracks with at least two samples, an allowed category, a minimum length and a bounded first distance."""
    stats = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"), (F.max(t) - F.min(t)).alias("track_len_s"),
        F.min_by("category", t).alias("category"), F.min_by(F.hypot("x", "y"), t).alias("first_dist_m"))
    keep = (F.col("n_samples") >= 2) & (F.col("track_len_s") >= min_len) & (F.col("first_dist_m") <= max_dist)
    return stats.where(keep & F.col("category").isin(*cats) if cats else keep)


def time_grid(windows: DataFrame, horizon: float = 4.0, step: float = 0.2, centre: str = "t0") -> DataFrame:
    """GEO-05: inclusive grid centred on each window."""
    n = grid_steps(horizon, step)
    return windows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "t", F.col(centre) - 0.5 * horizon + F.col("k") * F.lit(step))


def clamp_state(state: DataFrame, vmax: float = 100.0, amax: float = 20.0) -> DataFrame:
    """GEO-06: clamp velocity and acceleration components."""
    lim = {"vx": vmax, "vy": vmax, "ax": amax, "ay": amax}
    return state.withColumns({c: F.least(F.greatest(F.col(c), F.lit(-m)), F.lit(m)) for c, m in lim.items()})


def rollout(state: DataFrame, dt: str = "dt") -> DataFrame:
    """GEO-07: constant-velocity and constant-acceleration poses at each grid offset."""
    d = F.col(dt)
    ux, uy = F.col("vx") + F.col("ax") * d, F.col("vy") + F.col("ay") * d
    yaw_cv = F.when(F.abs("vx") + F.abs("vy") > 1e-4, F.atan2("vy", "vx")).otherwise(0.0)
    return state.withColumns({
        "cv_x": F.col("x0") + F.col("vx") * d, "cv_y": F.col("y0") + F.col("vy") * d, "cv_yaw": yaw_cv,
        "ca_x": F.col("x0") + F.col("vx") * d + 0.5 * F.col("ax") * d * d,
        "ca_y": F.col("y0") + F.col("vy") * d + 0.5 * F.col("ay") * d * d,
        "ca_yaw": F.when(F.hypot(ux, uy) > 1e-3, F.atan2(uy, ux)).otherwise(yaw_cv)})


def box_distance(df: DataFrame, out: str, a: dict, b: dict) -> DataFrame:
    """GEO-08: distance of two oriented boxes (dicts of columns x, y, len, wid, yaw); 0 when they touch.

    In the frame of one box the distance to a corner of the other is a clamped coordinate difference, and
    disjoint convex shapes are nearest at a corner of one of them; overlap is the separating-axis test.
    The terms are built up in small steps: one projection with all of them would compile to a method too
    large for the JVM to optimise, and runs many times slower.
    """
    names = df.columns
    ax, ay = city_to_ego(b["x"], b["y"], a["yaw"], a["x"], a["y"])
    bx, by = city_to_ego(a["x"], a["y"], b["yaw"], b["x"], b["y"])
    df = df.withColumns({"_c": F.cos(b["yaw"] - a["yaw"]), "_s": F.sin(b["yaw"] - a["yaw"]),
                         "_0x": ax, "_0y": ay, "_1x": bx, "_1y": by})
    c, sides = F.col("_c"), ((a, b, F.col("_s")), (b, a, -F.col("_s")))
    # half diagonals of the other box in each frame: corners are centre +- (px, py) and centre +- (qx, qy)
    half = {}
    for k, (_, box, s) in enumerate(sides):
        half.update({f"_{k}px": (c * box["len"] - s * box["wid"]) / 2, f"_{k}py": (s * box["len"] + c * box["wid"]) / 2,
                     f"_{k}qx": (c * box["len"] + s * box["wid"]) / 2, f"_{k}qy": (s * box["len"] - c * box["wid"]) / 2})
    df = df.withColumns(half)
    for k, (frame, _, _) in enumerate(sides):
        df = df.withColumns({
            f"_{k}{d}{sign}{x}": F.greatest(F.abs(F.col(f"_{k}{x}") + F.col(f"_{k}{d}{x}") * m) - frame[size] / 2, F.lit(0.0))
            for d in "pq" for sign, m in (("a", 1.0), ("b", -1.0)) for x, size in (("x", "len"), ("y", "wid"))})
    squares = [F.col(f"_{k}{d}{sign}x") * F.col(f"_{k}{d}{sign}x") + F.col(f"_{k}{d}{sign}y") * F.col(f"_{k}{d}{sign}y")
               for k in (0, 1) for d in "pq" for sign in "ab"]
    df = df.withColumn("_best", F.least(*squares))
    apart = F.lit(False)
    for k, (frame, _, _) in enumerate(sides):
        for x, size in (("x", "len"), ("y", "wid")):
            reach = F.greatest(F.abs(F.col(f"_{k}p{x}")), F.abs(F.col(f"_{k}q{x}")))
            apart = apart | (F.abs(F.col(f"_{k}{x}")) > frame[size] / 2 + reach)
    return df.select(*names, F.when(apart, F.sqrt("_best")).otherwise(0.0).alias(out))


def softmin(d_cv: Column, d_ca: Column, a_norm: Column, tau: float = 0.3, a0: float = 0.8) -> Column:
    """GEO-09: soft minimum of both rollout distances, the acceleration model weighted by a / (a + a0)."""
    w = a_norm / (a_norm + a0)
    return -tau * F.ln((1 - w) * F.exp(-d_cv / tau) + w * F.exp(-d_ca / tau) + 1e-12)


STEPS = 1 << 16   # grid steps of one window that fit the packed order


def _packed_order(first: Column, then: Column, size: int) -> Column:
    """One integer that orders by ``first`` and then by ``then``; an error where ``then`` isn't below ``size`` or the sum would overflow."""
    fits = (then >= 0) & (then < size) & (F.abs(first) < (1 << 62) // size)
    return F.when(fits, first * size + then).when(first.isNotNull() & then.isNotNull(), F.raise_error(F.lit(f"an order of up to {size} places doesn't fit")).cast("bigint"))


def approach_aggs(m: str = "m", dt: str = "dt", k: str = "k") -> list[Column]:
    """Aggregates of the nearest approach.

    Distance in nanometres and step share one integer, so that equal distances go to the earliest step and
    all buffers are plain numbers, which keeps the aggregate hash-based.  A step that doesn't fit raises.
    """
    key = _packed_order(_nano(F.col(m)), F.col(k), STEPS)
    return [F.greatest(F.min(m), F.lit(0.0)).alias("dmin_m"), F.greatest(-F.min(m), F.lit(0.0)).alias("penetration_m"),
            F.min_by(dt, key).alias("t_at_dmin_s")]


def min_approach(rows: DataFrame, keys: Sequence[str], m: str = "m", dt: str = "dt", k: str = "k") -> DataFrame:
    """GEO-10: smallest distance, its time offset (earliest on ties) and the penetration depth."""
    return rows.groupBy(*keys).agg(*approach_aggs(m, dt, k))


MASK = 62   # steps of one bit mask


def run_masks(below: Column, k: Column, n: int, steps: int = MASK) -> list[Column]:
    """Aggregates: the steps ``k`` (0 to ``steps`` - 1) that are true, as bits; a step outside raises.

    Bit masks of 62 steps overlap by ``n`` - 1, so that every run lies in one of them whole.
    """
    if not 1 <= n <= MASK:
        raise ValueError(f"a run has 1 to {MASK} steps")
    inside = F.when((k >= 0) & (k < steps), below).otherwise(F.raise_error(F.lit(f"a step outside the grid of {steps}")).cast("boolean"))
    masks = []
    for begin in range(0, max(1, steps - n + 1), MASK - n + 1):
        here = inside & (k >= begin) & (k < begin + MASK)
        bit = F.pow(F.lit(2.0), F.when(here, k - begin).otherwise(0)).cast("bigint")
        masks.append(F.bit_or(F.when(here, bit).otherwise(F.lit(0).cast("bigint"))))
    return masks


def has_run(masks: Sequence[Column], n: int) -> Column:
    """Whether ``n`` consecutive bits of any of the masks are set."""
    found = F.lit(False)
    for mask in masks:
        hit = mask
        for j in range(1, n):
            hit = hit.bitwiseAND(F.shiftright(mask, j))
        found = found | (hit != 0)
    return found


def run_of(below: Column, k: Column, n: int, steps: int = MASK) -> Column:
    """Aggregate: whether ``n`` consecutive steps ``k`` (0 to ``steps`` - 1) are true; a step outside raises."""
    return has_run(run_masks(below, k, n, steps), n)


def grid_steps(horizon: float, step: float) -> int:
    return int(math.floor(horizon / step)) + 1


def sustained(rows: DataFrame, keys: Sequence[str], m: str = "m", k: str = "k", margin: float = 0.6, n: int = 2, steps: int = MASK) -> DataFrame:
    """GEO-11: whether ``n`` consecutive steps of a grid of ``steps`` are below the margin; no sort is needed."""
    return rows.groupBy(*keys).agg(run_of(F.col(m) < margin, F.col(k), n, steps).alias("sustained_tight"))


def p_overlap(dmin: Column, tight: Column, sigma: float = 1.5, decay: float = 0.6) -> Column:
    """GEO-12: overlap probability, decayed when the approach is not sustained."""
    raw = F.exp(-F.pow(F.greatest(dmin, F.lit(0.0)) / sigma, F.lit(2.0)))
    return F.when(tight, raw).otherwise(decay * raw)


def bearing_sector(x: Column, y: Column, front: float = FRONT) -> tuple[Column, Column]:
    """GEO-13: bearing and sector 0 front, 1 left, 2 right, 3 back."""
    b = F.atan2(y, x)
    sector = F.when(F.abs(b) > math.pi - front, 3).when(F.abs(b) <= front, 0).when(b > 0, 1).otherwise(2)
    return b, sector


def closing_on_path(vx: Column, vy: Column, ego_v: Column, ego_yaw: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """GEO-14: closing speed along the ego heading and the on-path flag."""
    forward = vx * F.cos(ego_yaw) + vy * F.sin(ego_yaw)
    return F.greatest(F.lit(0.0), ego_v - forward), F.when((F.abs(y) <= 3.0) & (x >= -5.0), 1).otherwise(0)


def static_gate(rows: DataFrame, dist: float = 40.0, p: float = 0.05) -> DataFrame:
    """GEO-15: drop far static objects unless on path or likely to overlap."""
    far = (F.col("is_static") == 1) & (F.hypot("x_rel_m", "y_rel_m") > dist)
    return rows.where(~far | (F.col("on_path_like") == 1) | (F.col("p_overlap") >= p))


def order_candidates(rows: DataFrame, k: int, win: str = "window_key") -> DataFrame:
    """GEO-16: the ``k`` best candidates: overlap, smaller distance, penetration, track."""
    w = Window.partitionBy(win).orderBy(F.col("p_overlap").desc(), "dmin_m", F.col("penetration_m").desc(), "track_uuid")
    return rows.withColumn("cand_rank", F.row_number().over(w)).where(F.col("cand_rank") <= k)


def fused_score() -> Column:
    """GEO-17: fused selection score of an actor row."""
    return (0.50 * F.col("p_overlap") + 0.25 / (1.0 + F.greatest(F.col("dmin_m"), F.lit(0.0)))
            + 0.20 * F.col("sustained_tight").cast("double")
            + 0.05 * F.least(F.lit(1.0), F.greatest(F.col("a_norm"), F.lit(0.0)) / 2.0)
            + F.when(F.abs("bearing_rad") <= FRONT, 0.03).otherwise(0.0)
            + F.when(F.col("category").isin(*LARGE), 0.02).otherwise(0.0))


def hard_rule() -> Column:
    """GEO-18: actors that are always preferred."""
    front = F.abs("bearing_rad") <= FRONT
    return ((F.col("p_overlap") >= 0.08) | (F.col("dmin_m") <= 12.0) | (front & (F.col("rel_speed_closing_mps") >= 0.5))
            | ((F.col("is_static") == 1) & ((F.col("on_path_like") == 1) | (F.col("p_overlap") >= 0.05)))
            | (front & F.col("category").isin(*LARGE)))


def union_then_fill(rows: DataFrame, k: int = 24, win: str = "window_key") -> DataFrame:
    """GEO-18: hard-rule actors first, filled up to ``k`` with the rest, each by fused score."""
    scored = rows.withColumn("fused", fused_score()).withColumn("hard", hard_rule())
    w = Window.partitionBy(win).orderBy(F.col("hard").desc(), F.col("fused").desc(), "track_uuid")
    return scored.withColumn("tag_rank", F.row_number().over(w)).where(F.col("tag_rank") <= k)


def nest_actors(windows: DataFrame, kept: DataFrame, fields: Sequence[str], win: str = "window_key") -> DataFrame:
    """GEO-19: kept actors (at most the K of GEO-18) as an ordered array per window; empty windows stay."""
    nested = kept.groupBy(win).agg(F.array_sort(F.collect_list(F.struct("tag_rank", *fields))).alias("top_actors"))
    empty = F.array().cast(nested.schema["top_actors"].dataType)
    return windows.join(nested, win, "left").withColumn("top_actors", F.coalesce("top_actors", empty))


# --- map ----------------------------------------------------------------------------------------------------


def centerlines(lanes: DataFrame, k: int = 50, left: str = "left_pts", right: str = "right_pts",
                log: str = "log_id") -> DataFrame:
    """GEO-20: points ``k`` of the centreline of each lane: mean of both boundaries at equal arc lengths.

    A boundary is a short point list, so its arc lengths are an ordered sum within the lane.
    """
    key = [log, "feature_id"]
    both = lanes.where((F.size(left) >= 2) & (F.size(right) >= 2)).select(*key, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col(left).alias("p")), F.struct(F.lit(1).alias("side"), F.col(right).alias("p"))))
        .alias("b")).select(*key, "b.side", F.col("b.p").alias("pts"))
    segs = line_segments(both).withColumn("len", F.hypot("ux", "uy"))
    w = Window.partitionBy(*key, "side").orderBy("seg")
    whole = Window.partitionBy(*key, "side")
    segs = segs.withColumns({"end": F.sum("len").over(w), "total": F.sum("len").over(whole), "last": F.max("seg").over(whole)})
    grid = segs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(
        "at", F.col("total") * F.col("k") / (k - 1))
    # the first segment that reaches the wanted arc length; the last point closes the line
    holds = (F.col("at") <= F.col("end")) | (F.col("seg") == F.col("last"))
    hit = grid.where(holds).groupBy(*key, "side", "k").agg(
        F.min_by(F.struct("sx", "sy", "ux", "uy", "len", "end", "at"), "seg").alias("h"))
    share = F.when(F.col("k") == k - 1, 1.0).otherwise(
        (F.col("h.at") - (F.col("h.end") - F.col("h.len"))) / F.greatest(F.col("h.len"), F.lit(1e-9)))
    points = hit.select(*key, "k", (F.col("h.sx") + share * F.col("h.ux")).alias("x"),
                        (F.col("h.sy") + share * F.col("h.uy")).alias("y"))
    return points.groupBy(*key, "k").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def _nano(d: Column) -> Column:
    """Distance in whole nanometres: equal distances tie whatever the order of their roundings."""
    return F.floor(d * 1e9 + 0.5)


def line_segments(lines: DataFrame, pts: str = "pts") -> DataFrame:
    """One row per polyline segment: ``seg``, its start (sx, sy), extent (ux, uy) and heading ``theta``."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(pts) - 2), lambda i: F.struct(
        i.alias("seg"), F.col(pts)[i]["x"].alias("sx"), F.col(pts)[i]["y"].alias("sy"),
        (F.col(pts)[i + 1]["x"] - F.col(pts)[i]["x"]).alias("ux"), (F.col(pts)[i + 1]["y"] - F.col(pts)[i]["y"]).alias("uy")))
    segs = lines.where(F.size(pts) >= 2).withColumn("_p", F.explode(pairs)).select(*lines.columns, "_p.*").drop(pts)
    return segs.withColumn("theta", F.atan2("uy", "ux"))


def segment_distance(df: DataFrame, out: str = "d") -> DataFrame:
    """Distance of point (x, y) to segment (sx, sy) + s (ux, uy)."""
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    along = (dx * F.col("ux") + dy * F.col("uy")) / (F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") + 1e-12)
    df = df.withColumn("_along", F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0)))
    return df.withColumn(out, F.hypot(dx - F.col("_along") * F.col("ux"), dy - F.col("_along") * F.col("uy"))).drop("_along")


SEGMENTS = 1 << 14   # segments of one line that fit the packed order, with distances up to 281 km; beyond that it raises
CELL = 8.0   # metres of the finest cells
LEVELS = ((128.0, 32.0), (2048.0, 512.0))   # metres of the tiles of a large map, and how far their lines may be away, before a search takes in the whole map
FAR = 512.0   # a line of unknown place counts, as a null does, where no other is within this distance
WHOLE, CROWD = 2048, 1 << 18   # segments of a map that is searched whole, points of a tile before it is split
RINGS, MAPPED = 1 << 40, 1 << 41   # bits of logs that have polygons, or anything
SECTORS = 32


def numbered_lines(lines: DataFrame, log: str = "log_id") -> DataFrame:
    """Number the lines of each log's map by feature id; a map is bounded by its city."""
    return lines.where(F.size("pts") >= 2).withColumn("line", F.row_number().over(Window.partitionBy(log).orderBy(
        *[c for c in ("kind", "feature_id", "edge") if c in lines.columns])) - 1)


def grown(rows: DataFrame) -> DataFrame:
    """A table made by exploding, joined by shuffles only: it is planned at the size of what it was made from, small enough to pass whole
    through the driver where its rows are not."""
    return rows.hint("merge")


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size)


def segment_cells(segs: DataFrame, size: float, reach: float | None = None) -> DataFrame:
    """Each segment once per cell (cx, cy) from which a point may lie within ``reach`` (``size`` if not given) of it.

    Column by column: the stretch of the segment that is at most ``reach`` away, and the rows up to ``reach`` above and below it."""
    reach = size if reach is None else reach

    def y_at(x: Column) -> Column:
        share = F.when(F.abs("ux") > 1e-12, (x - F.col("sx")) / F.col("ux"))
        return F.col("sy") + F.col("uy") * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))

    def rows(c: Column) -> Column:
        a, b = y_at(c * size - reach), y_at((c + 1) * size + reach)
        steep = F.abs("ux") <= 1e-12
        lo = F.when(steep, F.least("sy", F.col("sy") + F.col("uy"))).otherwise(F.least(a, b))
        hi = F.when(steep, F.greatest("sy", F.col("sy") + F.col("uy"))).otherwise(F.greatest(a, b))
        return F.transform(F.sequence(_cell(lo - reach, size), _cell(hi + reach, size)), lambda r: F.struct(c.alias("cx"), r.alias("cy")))
    ends = F.least("sx", F.col("sx") + F.col("ux")), F.greatest("sx", F.col("sx") + F.col("ux"))
    cells = F.flatten(F.transform(F.sequence(_cell(ends[0] - reach, size), _cell(ends[1] + reach, size)), rows))
    return segs.withColumn("_c", F.explode(cells)).select(*segs.columns, "_c.*")


def cell_hits(points: DataFrame, segs: DataFrame, size: float | None, log: str = "log_id") -> DataFrame:
    """Point and segment pairs of neighbouring cells (of the whole log without ``size``), with their distance and, with a size, the point's cell."""
    if size is None:
        return segment_distance(points.join(grown(segs), log))
    at = points.withColumns({"cx": _cell(F.col("x"), size), "cy": _cell(F.col("y"), size)})
    return segment_distance(at.join(grown(segment_cells(segs, size)), [log, "cx", "cy"]))


def heading_sectors(lines: DataFrame, log: str = "log_id") -> DataFrame:
    """Per log the sectors of headings that its segments have, as bits of ``ways``."""
    sector = F.floor((F.col("theta") + math.pi) / (2 * math.pi / SECTORS)).cast("int")
    return line_segments(lines.select(log, "pts")).select(log, sector.alias("_s")).groupBy(log).agg(F.bit_or(F.expr("shiftleft(1L, _s)")).alias("ways"))


def some_ahead(ways: Column, heading: Column) -> Column:
    """Whether a heading is within a right angle of any of a log's sectors, with a margin of one sector."""
    width = 2 * math.pi / SECTORS
    near = F.exists(F.sequence(F.lit(0), F.lit(SECTORS)), lambda s: (F.call_function("getbit", ways, s) == 1) & (
        F.abs(angle_diff(s * width + width / 2 - math.pi, heading)) < math.pi / 2 + width))
    return F.coalesce(near, F.lit(False))


def nearest_lines(points: DataFrame, lines: DataFrame, targets: dict[str, Column], point: str, log: str, cols: Sequence[str] = (), directed: Sequence[str] = (),
                  instead: dict[str, str] | None = None, polygons: DataFrame | None = None, mapped: DataFrame | None = None, whole: int = WHOLE) -> DataFrame:
    """For each point and target the nearest line of its log that meets the target: a struct of ``q`` (nanometres), ``line``, ``seg``,
    ``theta`` and ``cols``; null where the log has none.

    A target is a condition on a line.  For a ``directed`` one the line's segment nearest to the point must also head within a right angle of the
    point's ``heading``.  A log whose map has at most ``whole`` segments is searched whole: its lines and then its points pass a task once, so
    that no pair of them becomes a row.  In a larger log segments are registered in the tiles they reach, and a point is done once its
    lines are no farther than that; what is left goes on with larger tiles and then with the whole map.  What a log can't give at all is not looked for
    there, nor is a target of ``instead`` while the one that it stands in for may be found.  A crowded tile is split.

    Besides, ``_bits`` has what the log has (``MAPPED`` for any row of ``mapped``, ``RINGS`` for polygons), ``_ways`` its sectors of headings towards directed
    targets, ``_inside`` whether a polygon contains the point, and ``_n`` how often a point's id comes where the point is."""
    bit = {t: 1 << i for i, t in enumerate(targets)}
    mask = F.lit(0)
    for t, cond in targets.items():
        mask = mask.bitwiseOR(F.when(cond, bit[t]).otherwise(0))
    known = F.col(log).isNotNull()
    named = [F.struct(*cols).alias("cols")] if cols else []
    lines = stored(lines.where(known).select(log, F.col("line").cast("bigint").alias("line"), "pts", mask.cast("bigint").alias("bits"), *named), "map-lines")
    facts = lines.select(log, "bits", (F.size("pts") - 1).alias("n"))
    rings = None
    if polygons is not None:
        shape = polygons.where(known & (F.size("pts") >= 3)).select(log, "feature_id", "pts")
        rings = stored(shape.withColumn("line", F.dense_rank().over(Window.partitionBy(log).orderBy("feature_id")).cast("bigint")), "map-rings")
        facts = facts.unionByName(rings.select(log, F.lit(RINGS).alias("bits"), F.size("pts").alias("n")))
    if mapped is not None:
        facts = facts.unionByName(mapped.where(known).select(log, F.lit(MAPPED).alias("bits"), F.lit(0).alias("n")))
    facts = facts.groupBy(log).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    ahead = sum(bit[t] for t in directed)
    ways = heading_sectors(lines.where(F.col("bits").bitwiseAND(F.lit(ahead)) != 0), log) if directed else lines.select(log, F.lit(0).cast("bigint").alias("ways")).limit(0)
    facts = stored(facts.join(grown(ways), log, "left").na.fill(0, ["ways"]), "map-logs")
    large = facts.where(F.col("n") > whole)
    some_large = not large.isEmpty()

    kept, own = points.columns, [c for c in points.columns if c not in (log, point, "x", "y")]
    heading = F.col("heading") if "heading" in own else F.lit(None)
    best = T.StructType([T.StructField("q", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("seg", T.LongType()), T.StructField("theta", T.DoubleType()),
                         *([T.StructField("cols", lines.schema["cols"].dataType)] if cols else [])])
    plain = points.where(known).select(F.col(log).alias("log"), F.col(point).alias("point"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"),
                                       heading.cast("double").alias("heading"), F.struct(*own, F.lit(0).alias("_")).alias("own"))
    start = {"bits": F.lit(0).cast("bigint"), "ways": F.lit(0).cast("bigint"), "inside": F.lit(None).cast("boolean")}
    row_type = T.StructType([f for f in plain.schema if f.name != "heading"] + [T.StructField("n", T.LongType())] + [
        T.StructField("bits", T.LongType()), T.StructField("ways", T.LongType()), T.StructField("inside", T.BooleanType())])
    for t in targets:
        row_type = row_type.add(t, best)

    def passed(rows: DataFrame, pieces: DataFrame, reach: float | None) -> DataFrame:
        """The points ``rows`` after the pieces of their keys."""
        key = ["log", "cx", "cy"]
        many = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("_parts")).where("_parts > 1")
        spread = F.coalesce("_parts", F.lit(1))
        rows = rows.join(F.broadcast(many), key, "left").withColumn("part", F.pmod(F.xxhash64("point"), spread).cast("int")).drop("_parts").withColumn("kind", F.lit(mapscan.POINT))
        pieces = pieces.join(F.broadcast(many), key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), spread - 1))).drop("_parts")
        stream = rows.unionByName(pieces, allowMissingColumns=True)
        order = [*mapscan.KEY, "kind", "point", "line", "seg"]
        # ids that repeat where the point is; the rows are sorted once, for this count and for the scan
        stream = stream.repartition(*mapscan.KEY).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*order))).sortWithinPartitions(*order)
        work = mapscan.scanner([(t, bit[t], t in directed) for t in targets], None if reach is None else int(reach * 1e9 * (1 - 1e-9)), int(FAR * 1e9 * (1 - 1e-9)), SEGMENTS,
                               ["log", "point", "x", "y", "own", "n"], to_arrow_schema(row_type), RINGS)
        return stream.mapInArrow(work, row_type)

    def pieces_of(size: float | None, reach: float | None, few: DataFrame, how: str, first: bool) -> DataFrame:
        """Lines, polygons and facts of the logs in ``few`` (or not in it) as rows; by tile with a ``size``."""
        def some(df):
            return df.join(F.broadcast(few.select(log)), log, how) if some_large else df
        shown = ["kind", "log", "cx", "cy", "line", "seg", "pts", "bits"]
        at = {"log": F.col(log), "seg": F.lit(0).cast("bigint")} | ({} if size is not None else {"cx": F.lit(0).cast("bigint"), "cy": F.lit(0).cast("bigint")})

        def pair(*names):
            return F.array(*[F.struct(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in names])
        if size is None:
            both = some(lines).withColumns(at | {"kind": F.lit(mapscan.LINE)}).withColumn("pts", F.transform("pts", _xy)).select(*shown, *[c for c in ("cols",) if cols])
            info = some(facts).withColumns(at | {"kind": F.lit(mapscan.INFO)}).select("kind", "log", "cx", "cy", "bits", "ways")
            both = both.unionByName(info, allowMissingColumns=True)
            if rings is not None and first:
                closed = F.concat(F.slice("pts", -1, 1), "pts")
                both = both.unionByName(some(rings).withColumns(at | {"kind": F.lit(mapscan.RING), "bits": F.lit(0).cast("bigint"), "pts": F.transform(closed, _xy)}).select(*shown), allowMissingColumns=True)
            return both
        segs = segment_cells(line_segments(some(lines)).withColumns({"x1": F.col("sx") + F.col("ux"), "y1": F.col("sy") + F.col("uy")}), size, reach)
        both = segs.withColumns({"log": F.col(log), "kind": F.lit(mapscan.LINE), "pts": pair(("sx", "sy"), ("x1", "y1")), "seg": F.col("seg").cast("bigint")}).select(*shown, *[c for c in ("cols",) if cols])
        if rings is not None and first:
            edges = polygon_cells(some(rings).withColumn("feature_id", F.col("line")), size, log).withColumnRenamed("feature_id", "line")
            edges = edges.withColumns(at | {"kind": F.lit(mapscan.RING), "bits": F.lit(0).cast("bigint"), "pts": pair(("x0", "y0"), ("x1", "y1"))}).select(*shown)
            both = both.unionByName(edges, allowMissingColumns=True)
        return both

    here = {"cx": F.lit(0).cast("bigint"), "cy": F.lit(0).cast("bigint")}
    names = {"log": log, "point": point}

    def given(rows: DataFrame) -> DataFrame:
        facts_of = {"_bits": F.col("bits"), "_ways": F.col("ways"), "_inside": F.col("inside"), "_n": F.col("n")}
        return rows.select(*[F.col(a).alias(b) for a, b in names.items()], "x", "y", *[F.col(f"own.{c}") for c in own], *targets, *[v.alias(k) for k, v in facts_of.items()]).select(
            *kept, *targets, *facts_of)
    few = F.broadcast(large.select(F.col(log).alias("log"), F.col("bits").alias("bits"), F.col("ways").alias("ways")))
    small = plain.join(few, "log", "left_anti") if some_large else plain
    out = given(passed(small.withColumns(start | here), pieces_of(None, None, large, "left_anti", True), None))
    # points without a log
    nothing = {t: F.lit(None).cast(best) for t in targets} | {"_bits": F.lit(0).cast("bigint"), "_ways": F.lit(0).cast("bigint"), "_inside": F.lit(None).cast("boolean"), "_n": F.lit(1).cast("bigint")}
    out = out.unionByName(points.where(~known).withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")} | nothing).select(*out.columns))
    if not some_large:
        return out
    left = plain.join(few, "log").withColumn("inside", F.lit(None).cast("boolean"))
    wanted = F.col("bits").bitwiseAND(F.lit(sum(bit.values())))
    if directed:
        may = some_ahead(F.col("ways"), F.col("heading"))
        blind = F.when(may, sum(bit[t] for t, main in (instead or {}).items() if main in directed)).otherwise(ahead)
        wanted = wanted.bitwiseAND(F.bitwise_not(blind.cast("bigint")))
    left = left.withColumns({"open": wanted} | {f"_best_{t}": F.lit(None).cast(best) for t in targets})
    for i, (size, reach) in enumerate([*LEVELS, (None, None)]):
        cell = here if size is None else {c: F.coalesce(_cell(F.col(v), size), F.lit(0)) for c, v in (("cx", "x"), ("cy", "y"))}
        carried = F.struct("own", "heading", "open", *[f"_best_{t}" for t in targets]).alias("own")
        rows = left.withColumns(cell).select("log", "point", "x", "y", "heading", "bits", "ways", "inside", "cx", "cy", carried)
        outer, row_type = row_type, T.StructType([T.StructField(f.name, rows.schema["own"].dataType if f.name == "own" else f.dataType) for f in row_type])
        rows = passed(rows, pieces_of(size, reach, large, "left_semi", i == 0), reach)
        row_type = outer
        got = F.col("own.open")
        for t in targets:
            got = got.bitwiseAND(F.bitwise_not(F.when(F.col(t).isNotNull(), bit[t]).otherwise(0).cast("bigint")))
        state = rows.select("log", "point", "x", "y", "n", "bits", "ways", "inside", F.col("own.own").alias("own"), F.col("own.heading").alias("heading"), got.alias("open"),
                            *[F.coalesce(F.col(t), F.col(f"own._best_{t}")).alias(t) for t in targets])
        if size is None:
            return out.unionByName(given(state))
        state = stored(state, "map-points")
        out = out.unionByName(given(state.where("open = 0")))
        left = state.where("open <> 0").drop("n").withColumnsRenamed({t: f"_best_{t}" for t in targets})
        if left.isEmpty():
            return out


def _xy(p: Column) -> Column:
    return F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))


def nearest_on_polyline(points: DataFrame, lines: DataFrame, point: str = "point_id", log: str = "log_id") -> DataFrame:
    """GEO-21: per point the nearest polyline of its log with distance, segment index and segment heading; equal distances go to the
    smaller feature id.  Points of logs without lines have no row."""
    mapped = points.join(lines.where(F.size("pts") >= 2).select(log).distinct(), log, "left_semi")
    best = nearest_lines(mapped.select(log, point, "x", "y"), numbered_lines(lines, log), {"b": F.lit(True)}, point, log, ["feature_id"])
    return best.select(log, point, (F.col("b.q") / 1e9).alias("d"), "b.cols.feature_id", "b.seg", "b.theta")


def ring_edges(polygons: DataFrame, pts: str = "pts") -> DataFrame:
    """One row per polygon edge (x0, y0) -> (x1, y1), the last point closing the ring."""
    n = F.size(pts)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.col(pts)[i]["x"].alias("x1"), F.col(pts)[i]["y"].alias("y1"),
        F.col(pts)[F.pmod(i - 1 + n, n)]["x"].alias("x0"), F.col(pts)[F.pmod(i - 1 + n, n)]["y"].alias("y0")))
    return polygons.where(n >= 3).withColumn("_e", F.explode(edges)).select(*polygons.columns, "_e.*").drop(pts)


def crossing() -> Column:
    """Whether the edge crosses the ray from (x, y) to the right."""
    x, y, x0, y0, x1, y1 = (F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1"))
    return ((y1 > y) != (y0 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0 + 1e-12) + x0)


def polygon_cells(polygons: DataFrame, size: float, log: str = "log_id") -> DataFrame:
    """Edges by cell: an edge is in each row of cells it passes, from the column where its polygon begins to the one where the edge ends,
    as a point's ray to the right meets no other edge."""
    left = F.array_min(F.transform("pts", lambda p: p["x"]))
    edges = ring_edges(polygons.select(log, "feature_id", left.alias("_left"), "pts"))
    rows = F.sequence(_cell(F.least("y0", "y1"), size), _cell(F.greatest("y0", "y1"), size))
    columns = F.sequence(_cell(F.col("_left"), size), _cell(F.greatest("x0", "x1"), size))
    return edges.withColumn("cy", F.explode(rows)).withColumn("cx", F.explode(columns)).drop("_left")


def point_in_polygon(points: DataFrame, polygons: DataFrame, point: str = "point_id", log: str = "log_id", cell: float = 4 * CELL) -> DataFrame:
    """GEO-22: per point whether any polygon of its log contains it (even-odd rule); a point tests the edges of its cell's row only.
    Points of logs without polygons have no row."""
    at = points.select(log, point, _cell(F.col("x"), cell).alias("cx"), _cell(F.col("y"), cell).alias("cy"), "x", "y")
    hits = at.join(grown(polygon_cells(polygons, cell, log)), [log, "cx", "cy"]).groupBy(log, "cx", "cy", point, "feature_id").agg(F.count_if(crossing()).alias("n"))
    found = hits.groupBy(log, "cx", "cy", point).agg(F.bool_or(F.col("n") % 2 == 1).alias("inside")).drop("cx", "cy")
    mapped = points.select(log, point).join(polygons.where(F.size("pts") >= 3).select(log).distinct(), log, "left_semi")
    return mapped.join(found, [log, point], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def angle_diff(a: Column, b: Column) -> Column:
    """GEO-24: difference wrapped to [-pi, pi)."""
    return F.pmod(a - b + math.pi, F.lit(2 * math.pi)) - math.pi


def map_lines(features: DataFrame, log: str = "log_id") -> DataFrame:
    """The lines that cues are measured to: a lane's centre line where it has two boundaries (``pts`` and ``pts2``), else its one line; both
    edges of a crosswalk."""
    keys = [log, "kind", "feature_id", "is_intersection"]
    if "pts2" not in features.columns:
        return features.where("kind IN ('lane', 'crosswalk')").select(*keys, F.lit(0).alias("edge"), "pts")
    two = (F.col("kind") == "lane") & (F.size("pts2") > 0)
    one = features.where(F.col("kind").isin("lane", "crosswalk") & ~F.coalesce(two, F.lit(False)))
    plain = one.select(*keys, F.lit(0).alias("edge"), "pts").unionByName(
        one.where((F.col("kind") == "crosswalk") & F.col("pts2").isNotNull()).select(*keys, F.lit(1).alias("edge"), F.col("pts2").alias("pts")))
    lanes = features.where(two)
    centre = centerlines(lanes, left="pts", right="pts2", log=log).groupBy(log, "feature_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("pts"))
    return plain.unionByName(lanes.select(*keys).join(grown(centre), [log, "feature_id"]).select(*keys, F.lit(0).alias("edge"), "pts"))


def map_cues(points: DataFrame, features: DataFrame, point: str = "point_id", log: str = "log_id") -> DataFrame:
    """GEO-23: five map cues per point from the lanes, crosswalk edges and drivable areas of its log.

    ``features`` has kind (lane / crosswalk / drivable), is_intersection, pts and, where a feature has two sides, pts2.  Lines and
    areas are found through ``nearest_lines``, in one pass over the points.
    """
    lines = numbered_lines(map_lines(features, log), log)
    lane, cross = F.col("kind") == "lane", F.col("kind") == "crosswalk"
    targets = {"lane": lane, "cross": cross, "ahead": cross, "inter": lane & F.col("is_intersection")}
    best = nearest_lines(points.select(log, point, "x", "y", "heading"), lines, targets, point, log, directed=["ahead"], instead={"inter": "ahead"},
                         polygons=features.where("kind = 'drivable'"), mapped=features.select(log))
    has = lambda bit: F.col("_bits").bitwiseAND(F.lit(bit)) != 0
    # an id that repeats meets itself once more for its polygons, and once more where no crosswalk is ahead after all
    twice = has(RINGS).cast("int") + (has(1 << 3) & F.col("ahead").isNull() & some_ahead(F.col("_ways"), F.col("heading"))).cast("int")
    times = F.when(F.col(point).isNotNull() & (F.col("_n") > 1), F.pow("_n", twice).cast("int")).otherwise(1)
    out = best.withColumn("_t", F.explode(F.array_repeat(F.lit(0), times)))
    # without any map nothing is known
    drivable = F.when(has(MAPPED), F.coalesce(F.col("_inside"), F.col("lane.q") / 1e9 < 3.5, F.lit(False)))
    return out.select(log, point, (F.col("lane.q") / 1e9).alias("map_lane_offset_m"), F.cos(F.col("heading") - F.col("lane.theta")).alias("map_lane_alignment_cos"),
                      (F.coalesce("ahead.q", "inter.q") / 1e9).alias("dist_to_stopline_m"), (F.col("cross.q") / 1e9).alias("dist_to_crosswalk_m"),
                      drivable.cast("double").alias("in_drivable_area"))


# --- the whole tagger ---------------------------------------------------------------------------------------


def tag_actors(states: DataFrame, ego: DataFrame, horizon: float = 4.0, step: float = 0.2, k: int = 24) -> DataFrame:
    """Actor states at window centres to ranked, scored actors of each window.

    ``ego`` holds, per window, the ego state at the centre (ex, ey, eyaw, ev); over the short horizon it is
    rolled forward at constant velocity.  ``tag_recorded`` reads the recorded path instead.
    """
    keys = ["window_key", "track_uuid"]
    # spread by actor before the grid multiplies the rows; the aggregates and the join below reuse it
    base = clamp_state(states).join(ego, "window_key").where(" AND ".join(f"{c} IS NOT NULL" for c in keys)).repartition(*keys)
    grid = time_grid(base.withColumns({"t0": F.lit(0.0), "_row": F.monotonically_increasing_id()}), horizon, step).withColumnRenamed("t", "dt")
    path = {"gx": F.col("ex") + F.col("ev") * F.cos("eyaw") * F.col("dt"), "gy": F.col("ey") + F.col("ev") * F.sin("eyaw") * F.col("dt"), "gyaw": F.col("eyaw")}
    return _scored_tags(base, grid.withColumns(path), horizon, step, k)


def _scored_tags(base: DataFrame, grid: DataFrame, horizon: float, step: float, k: int) -> DataFrame:
    """Scores, static gate and ranks of the actors in ``base``; ``grid`` has each actor once per step, with the ego pose (gx, gy, gyaw).

    Where the grid numbers the rows that it was made from (``_row``, unique within a task), an actor's columns come back out of it, so that
    actors are neither moved nor read a second time for a join; else ``base`` is joined."""
    keys = ["window_key", "track_uuid"]
    rolled = rollout(grid)
    ego_box = {"x": F.col("gx"), "y": F.col("gy"), "len": F.lit(EGO_LENGTH), "wid": F.lit(EGO_WIDTH), "yaw": F.col("gyaw")}

    def box(p):
        return {"x": F.col(f"{p}_x"), "y": F.col(f"{p}_y"), "len": F.col("length_m"), "wid": F.col("width_m"), "yaw": F.col(f"{p}_yaw")}
    both = box_distance(box_distance(rolled, "_d_cv", ego_box, box("cv")), "_d_ca", ego_box, box("ca"))
    soft, steps = softmin(F.col("_d_cv"), F.col("_d_ca"), F.col("a_norm")).alias("m"), grid_steps(horizon, step)
    if "_row" in grid.columns:
        m = both.select(*base.columns, "_row", "k", "dt", soft)
        plain = [f.name for f in base.schema if isinstance(f.dataType, T.NumericType | T.BooleanType)]  # the others would make the aggregate sort its rows
        order, masks = _packed_order(_nano(F.col("m")), F.col("k"), STEPS), run_masks(F.col("m") < 0.6, F.col("k"), 2, steps)
        each = m.groupBy("_row", *[c for c in base.columns if c not in plain]).agg(
            *[F.first(c).alias(c) for c in plain], F.min("m").alias("_m"), F.min(order).alias("_at"), F.min_by("dt", order).alias("_dt"), *[v.alias(f"_run{i}") for i, v in enumerate(masks)])
        # rows of one actor share its nearest approach
        same = Window.partitionBy(*keys)
        low = {"_m": F.min("_m").over(same), "_dt": F.min_by("_dt", "_at").over(same)} | {f"_run{i}": F.bit_or(f"_run{i}").over(same) for i in range(len(masks))}
        scored = each.withColumns(low).select(*base.columns, F.greatest("_m", F.lit(0.0)).alias("dmin_m"), F.greatest(-F.col("_m"), F.lit(0.0)).alias("penetration_m"),
                                              F.col("_dt").alias("t_at_dmin_s"), has_run([F.col(f"_run{i}") for i in range(len(masks))], 2).alias("sustained_tight"))
    else:
        m = both.select(*keys, "k", "dt", soft)
        # both per-actor results in one pass over the grid
        low = m.groupBy(*keys).agg(*approach_aggs(), run_of(F.col("m") < 0.6, F.col("k"), 2, steps).alias("sustained_tight"))
        scored = base.join(low, keys)
    x, y = city_to_ego(F.col("x0"), F.col("y0"), F.col("eyaw"), F.col("ex"), F.col("ey"))
    scored = scored.withColumn("x_rel_m", x).withColumn("y_rel_m", y)
    bearing, sector = bearing_sector(F.col("x_rel_m"), F.col("y_rel_m"))
    closing, path = closing_on_path(F.col("vx"), F.col("vy"), F.col("ev"), F.col("eyaw"), F.col("x_rel_m"), F.col("y_rel_m"))
    scored = scored.withColumns({"bearing_rad": bearing, "sector_id": sector, "rel_speed_closing_mps": closing,
                                 "on_path_like": path, "is_static": F.col("category").isin(*STATIC).cast("int"),
                                 "lat_speed_mps": F.col("vy") * F.cos("eyaw") - F.col("vx") * F.sin("eyaw"),
                                 "p_overlap": p_overlap(F.col("dmin_m"), F.col("sustained_tight"))})
    return union_then_fill(static_gate(scored), k)


def tag_recorded(pose: DataFrame, annotations: DataFrame, windows: DataFrame, cats: Sequence[str] | None = None, horizon: float = 4.0, step: float = 0.2,
                 min_len: float = 0.5, max_dist: float = 200.0, k: int = 24) -> DataFrame:
    """The whole tagger: recorded poses and annotations to the ranked, scored actors of each window.

    ``pose`` has log_id, t_s, px, py, pyaw and the speed pv; ``annotations`` log_id, track_uuid, t_s, category, length_m, width_m and the
    position x, y in the vehicle's frame; ``windows`` log_id, window_key and the centre t0.  Annotations are moved to the city frame by the pose
    at their time, a window's grid reads the recorded path, and tracks are gated at their fitted position.  An actor's category and size are
    those of its first sample near the window.
    """
    from roadsift.functions.trajectory import at_times

    keys = ["window_key", "track_uuid"]
    placed = at_times(pose, annotations, ["px", "py", "pyaw"], qt="t_s")
    cx, cy = ego_to_city(F.col("x"), F.col("y"), F.col("pyaw"), F.col("px"), F.col("py"))
    city = placed.select("log_id", "track_uuid", "t_s", "category", "length_m", "width_m", cx.alias("x"), cy.alias("y"))
    wins = windows.select("log_id", "window_key", "t0")
    near = near_event(city, wins, 4.0 + 0.5 * horizon, centre="t0")
    facts = near.groupBy(*keys).agg(*[F.min_by(c, "t_s").alias(c) for c in ("category", "length_m", "width_m")], (F.max("t_s") - F.min("t_s")).alias("_len"))
    facts = facts.where(F.col("_len") >= min_len)
    if cats:
        facts = facts.where(F.col("category").isin(*cats))
    path = at_times(pose.select("log_id", "t_s", *[F.col(c).alias(g) for c, g in (("px", "gx"), ("py", "gy"), ("pyaw", "gyaw"))]),
                    time_grid(wins, horizon, step).withColumnRenamed("t", "q_t"), ["gx", "gy", "gyaw"]).withColumn("dt", F.col("q_t") - F.col("t0"))
    middle = path.where(F.col("k") == grid_steps(horizon, step) // 2).select("log_id", "window_key", "t0", F.col("gx").alias("ex"), F.col("gy").alias("ey"), F.col("gyaw").alias("eyaw"))
    ego = at_times(pose.select("log_id", "t_s", F.col("pv").alias("ev")), middle, ["ev"], qt="t0").drop("log_id", "t0")
    states = clamp_state(fit_state(near, keys)).join(facts, keys).join(ego, "window_key")
    base = states.where(F.hypot(F.col("x0") - F.col("ex"), F.col("y0") - F.col("ey")) <= max_dist).repartition(*keys)
    grid = base.join(path.select("window_key", "k", "dt", "gx", "gy", "gyaw"), "window_key")
    return _scored_tags(base, grid, horizon, step, k)
