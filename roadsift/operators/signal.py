"""Ego signal preparation and braking-event detection (SIG-*)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadsift.functions.durable import stored
from roadsift.functions.intervals import overlap_join  # noqa: F401  (re-exported for callers)
from roadsift.functions.keys import window_key
from roadsift.functions.ordered import chunk_window, fill_edges, own_rows, row_index, running_sum, with_halo
from roadsift.functions.quantiles import group_quantiles, wide_quantiles

# Published threshold presets (global 10th / 15th percentiles of the training logs).
PRIMARY = {"a_min": -1.3355918960530604, "j_min": -6.227569436108014, "min_dur_s": 0.25, "max_gap_s": 0.20,
           "mode": "OR", "min_delta_v": 0.8}
RESCUE = {"a_min": -0.9818563009980742, "j_min": -4.759393574637533, "min_dur_s": 0.25, "max_gap_s": 0.25,
          "mode": "OR", "min_delta_v": 0.6}
# Percentile levels reported over per-window minima.
GLOBAL_LEVELS = (1, 5, 10, 12.5, 15, 20, 25, 50)


def sort_unique(pose: DataFrame, key: str = "log_id", t: str = "t_s", seq: str = "seq") -> DataFrame:
    """SIG-01: keep the first row (by ``seq``) of equal timestamps; a combinable aggregate, no window."""
    rest = [c for c in pose.columns if c not in (key, t)]
    first = pose.groupBy(key, t).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("_row"))
    return first.select(key, t, "_row.*").select(*pose.columns)


def resample(pose: DataFrame, hz: float = 20.0, key: str = "log_id", t: str = "t_s",
             values: Sequence[str] = ("x", "y")) -> DataFrame:
    """SIG-02: uniform grid from the first sample with linear interpolation.

    Every sample owns the grid points from itself up to the next sample, so the grid is exploded where the
    data lies and no log is gathered.  Logs with fewer than three samples come back unchanged.
    """
    dt = 1.0 / hz
    idx = row_index(pose, [key], [t], out="_i")
    bounds = pose.groupBy(key).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"), F.count(F.lit(1)).alias("_n"))
    halo = with_halo(idx, "_i", after=1)
    w = chunk_window([key], "_i")
    cols = [F.lead(c).over(w).alias(f"_next_{c}") for c in (t, *values)]
    pairs = own_rows(halo.select("*", *cols)).join(bounds, key)
    last = F.floor((F.col("_t1") - F.col("_t0")) / dt)
    # floating-point safe ownership: the grid time itself decides, the index range is one wider on both sides
    lo = F.greatest(F.lit(0), F.floor((F.col(t) - F.col("_t0")) / dt) - 1)
    hi = F.least(last, F.ceil((F.coalesce(F.col(f"_next_{t}"), F.col(t)) - F.col("_t0")) / dt) + 1)
    grid = (pairs.where("_n >= 3").withColumn("i", F.explode(F.sequence(lo, F.greatest(lo, hi))))
            .withColumn("_g", F.col("_t0") + F.col("i") * dt)
            .where((F.col("_g") >= F.col(t)) & (F.col(f"_next_{t}").isNull() | (F.col("_g") < F.col(f"_next_{t}")))
                   & (F.col("i") <= last)))
    share = (F.col("_g") - F.col(t)) / (F.col(f"_next_{t}") - F.col(t))
    lerped = grid.select(key, "i", F.col("_g").alias(t), *[
        F.when(F.col(f"_next_{c}").isNull(), F.col(c))
        .otherwise(F.col(c) + (F.col(f"_next_{c}") - F.col(c)) * share).alias(c) for c in values])
    short = pairs.where("_n < 3").select(key, F.col("_i").alias("i"), t, *values)
    return lerped.unionByName(short)


def _central(c: str, w: Window, dt: float) -> Column:
    nxt, prv, cur = F.lead(c).over(w), F.lag(c).over(w), F.col(c)
    return (F.when(nxt.isNotNull() & prv.isNotNull(), (nxt - prv) / (2.0 * dt))
            .when(nxt.isNotNull(), (nxt - cur) / dt)
            .when(prv.isNotNull(), (cur - prv) / dt).otherwise(F.lit(0.0)))


def central_diff(series: DataFrame, cols: Sequence[str], dt: float = 0.05, key: str = "log_id",
                 prefix: str = "d_") -> DataFrame:
    """SIG-03: central difference on a uniform grid, one-sided at both ends, 0 for a single sample."""
    w = chunk_window([key])
    halo = with_halo(series, before=1, after=1)
    return own_rows(halo.select("*", *[_central(c, w, dt).alias(prefix + c) for c in cols]))


def speed(series: DataFrame, dt: float = 0.05, key: str = "log_id") -> DataFrame:
    """SIG-04: speed from the positions of a uniform series."""
    return central_diff(series, ["x", "y"], dt, key).withColumn("speed", F.hypot("d_x", "d_y")).drop("d_x", "d_y")


def savgol_weights(window: int, poly: int, at: int) -> list[float]:
    """Weights that evaluate, at position ``at``, the least-squares polynomial through ``window`` samples."""
    x = np.arange(window, dtype=float) - at
    design = np.vander(x, poly + 1, increasing=True)
    return [float(v) for v in np.linalg.pinv(design)[0]]


def _fit_window(n: Column, window: int) -> Column:
    w = window if window % 2 else window + 1
    return F.least(F.lit(w), F.when(n % 2 == 1, n).otherwise(n - 1))


def savgol(series: DataFrame, col: str, out: str = "smooth", window: int = 9, poly: int = 2,
           key: str = "log_id") -> DataFrame:
    """SIG-05: Savitzky-Golay smoothing with polynomial ends.

    The window is made odd and clipped to the length of the log; below five samples the value is kept.
    """
    full = window if window % 2 else window + 1
    n_rows = series.groupBy(key).agg((F.max("i") + 1).alias("_n"))
    halo = with_halo(series.join(n_rows, key), before=full - 1, after=full - 1)
    w = chunk_window([key])
    size = _fit_window(F.col("_n"), window)
    value = F.col(col)
    for odd in range(5, full + 1, 2):
        half = odd // 2
        # position of the row inside the window that is fitted for it: the middle, or nearer to an end
        place = F.when(F.col("i") < half, F.col("i")) \
                 .when(F.col("i") >= F.col("_n") - half, F.col("i") - F.col("_n") + odd).otherwise(half)
        smoothed = F.lit(None).cast("double")
        for at in range(odd):
            terms = None
            for k, weight in enumerate(savgol_weights(odd, min(poly, odd - 1), at)):
                shift = k - at
                neighbour = F.col(col) if shift == 0 else (
                    F.lead(col, shift).over(w) if shift > 0 else F.lag(col, -shift).over(w))
                term = neighbour * F.lit(weight)
                terms = term if terms is None else terms + term
            smoothed = F.when(place == at, terms).otherwise(smoothed)
        value = F.when(size == odd, smoothed).otherwise(value)
    return own_rows(halo.withColumn(out, value)).drop("_n")


def _gradient(c: str, t: str, w: Window) -> Column:
    hd, hs = F.lead(t).over(w) - F.col(t), F.col(t) - F.lag(t).over(w)
    nxt, prv, cur = F.lead(c).over(w), F.lag(c).over(w), F.col(c)
    inner = (hs * hs * nxt + (hd * hd - hs * hs) * cur - hd * hd * prv) / (hs * hd * (hd + hs))
    return (F.when(nxt.isNotNull() & prv.isNotNull(), inner)
            .when(nxt.isNotNull(), (nxt - cur) / hd)
            .when(prv.isNotNull(), (cur - prv) / hs).otherwise(F.lit(0.0)))


def gradient(series: DataFrame, col: str, out: str, t: str = "t_s", key: str = "log_id") -> DataFrame:
    """SIG-06: derivative on a possibly non-uniform grid, second order inside and first order at the ends."""
    halo = with_halo(series, before=1, after=1)
    return own_rows(halo.withColumn(out, _gradient(col, t, chunk_window([key]))))


def kinematics(series: DataFrame, v: str = "speed", t: str = "t_s", key: str = "log_id") -> DataFrame:
    """Acceleration ``a`` and jerk ``j`` of a speed column in one pass over the chunks."""
    w = chunk_window([key])
    halo = with_halo(series, before=2, after=2)
    return own_rows(halo.withColumn("a", _gradient(v, t, w)).withColumn("j", _gradient("a", t, w)))


def resolve_threshold(series: DataFrame, col: str, spec: float | str, key: str = "log_id",
                      out: str = "thr") -> DataFrame:
    """SIG-07: one threshold per log, a number or ``"pct:p"`` of the log's own series."""
    if isinstance(spec, str) and spec.startswith("pct:"):
        return group_quantiles(series, [key], col, [float(spec[4:]) / 100.0], out).select(key, out)
    return series.select(key).distinct().withColumn(out, F.lit(float(spec)))


def global_percentiles(windows: DataFrame, levels: Sequence[float] = GLOBAL_LEVELS) -> DataFrame:
    """SIG-08: percentiles of the per-window minima, one window counted once."""
    once = windows.dropDuplicates(["log_id", "i_start", "i_end"])
    long = once.select(F.explode(F.create_map(F.lit("a_min"), F.col("a_min_ms2"), F.lit("j_min"), F.col("j_min_ms3")))
                       .alias("metric", "value"))
    q = group_quantiles(long, ["metric"], "value", [x / 100.0 for x in levels], "value", fixed=True)
    return q.select("metric", (F.col("p") * 100).alias("pct"), "n", "value")


def brake_mask(series: DataFrame, a_min: float | str = PRIMARY["a_min"], j_min: float | str = PRIMARY["j_min"],
               mode: str = "OR", key: str = "log_id") -> DataFrame:
    """SIG-09: sample masks; ``mask`` follows the mode, ``mask_and`` is kept for SOFT_AND."""
    df, thr = series, {}
    for name, spec in (("a", a_min), ("j", j_min)):
        if isinstance(spec, str):
            df = df.join(resolve_threshold(series, name, spec, key, f"_{name}_thr"), key)
            thr[name] = F.col(f"_{name}_thr")
        else:
            thr[name] = F.lit(float(spec))
    low_a, low_j = F.col("a") <= thr["a"], F.col("j") <= thr["j"]
    return df.withColumn("mask_and", low_a & low_j) \
             .withColumn("mask", low_a & low_j if mode == "AND" else low_a | low_j).drop("_a_thr", "_j_thr")


def segments(series: DataFrame, mask: str = "mask", t: str = "t_s", key: str = "log_id") -> DataFrame:
    """SIG-10: runs of true samples as ``s``..``e``; ``e`` is the first false sample after the run, or the last one."""
    halo = with_halo(series.select(key, "i", t, mask), before=1, after=1)
    w = chunk_window([key])
    flagged = own_rows(halo.select(
        "*", F.coalesce(F.lag(mask).over(w), F.lit(False)).alias("_was"),
        F.lead("i").over(w).alias("_next_i"), F.lead(t).over(w).alias("_next_t")))
    on = flagged.withColumn("_starts", (F.col(mask) & ~F.col("_was")).cast("bigint"))
    runs = running_sum(on, [key], "_starts", "_run").where(mask)
    return runs.groupBy(key, "_run").agg(
        F.min("i").alias("s"), F.max(F.coalesce("_next_i", F.col("i"))).alias("e"),
        F.min(t).alias("t_s0"), F.max(F.coalesce("_next_t", F.col(t))).alias("t_s1")).drop("_run")


def merge_segments(segs: DataFrame, max_gap: float = 0.2, min_dur: float = 0.25, key: str = "log_id") -> DataFrame:
    """SIG-11: join neighbours at most ``max_gap`` seconds apart, then keep those lasting ``min_dur``.

    Segments of a log do not overlap, so the gap to the previous one needs only its neighbour.
    """
    idx = row_index(segs, [key], ["s"], out="i")
    halo = with_halo(idx, before=1)
    w = chunk_window([key])
    apart = own_rows(halo.withColumn("_gap", F.col("t_s0") - F.lag("t_s1").over(w)))
    fresh = apart.withColumn("_fresh", F.coalesce(F.col("_gap") > max_gap, F.lit(True)).cast("bigint"))
    grouped = running_sum(fresh, [key], "_fresh", "_g").groupBy(key, "_g").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.min("t_s0").alias("t_s0"), F.max("t_s1").alias("t_s1"))
    return grouped.where(F.col("t_s1") - F.col("t_s0") >= min_dur).drop("_g")


def samples_in(segs: DataFrame, series: DataFrame, cols: Sequence[str], key: str = "log_id",
               block: int = 256) -> DataFrame:
    """Segment rows with the samples they cover (both ends included), joined on blocks of sample indexes."""
    spread = segs.withColumn("_block", F.explode(F.sequence(F.floor(F.col("s") / block), F.floor(F.col("e") / block))))
    points = series.select(key, "i", *cols, F.floor(F.col("i") / block).alias("_block"))
    return spread.join(points, [key, "_block"]).where("i BETWEEN s AND e").drop("_block")


def filter_segments(segs: DataFrame, series: DataFrame, mode: str = "OR", frac: float = 0.3, min_dv: float = 0.8,
                    v: str = "speed", key: str = "log_id") -> DataFrame:
    """SIG-12: speed drop from first to last sample, and for SOFT_AND the share of samples below both thresholds."""
    seen = samples_in(segs, series, [v, "mask_and"], key)
    stats = seen.groupBy(key, "s", "e", "t_s0", "t_s1").agg(
        (F.min_by(v, "i") - F.max_by(v, "i")).alias("dv"),
        (F.count_if("mask_and") / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("frac"))
    keep = F.col("dv") >= min_dv
    if mode == "SOFT_AND":
        keep = keep & (F.col("frac") >= frac)
    return stats.where(keep)


def window_records(segs: DataFrame, series: DataFrame, key: str = "log_id") -> DataFrame:
    """SIG-13: one record per segment with its bounds, duration, minimum acceleration and minimum jerk."""
    seen = samples_in(segs.select(key, "s", "e", "t_s0", "t_s1"), series, ["a", "j"], key)
    return seen.groupBy(key, "s", "e", "t_s0", "t_s1").agg(F.min("a").alias("a_min_ms2"), F.min("j").alias("j_min_ms3")) \
        .select(key, F.col("s").alias("i_start"), F.col("e").alias("i_end"), F.col("t_s0").alias("t_start"),
                F.col("t_s1").alias("t_end"), (F.col("t_s1") - F.col("t_s0")).alias("dur_s"), "a_min_ms2", "j_min_ms3")


def detect_windows(series: DataFrame, a_min: float | str = PRIMARY["a_min"], j_min: float | str = PRIMARY["j_min"],
                   min_dur_s: float = 0.25, max_gap_s: float = 0.2, mode: str = "OR", frac: float = 0.3,
                   min_delta_v: float = 0.8, v: str = "speed", key: str = "log_id") -> DataFrame:
    """SIG-06...13 and KB-01 in one chain: a uniform speed series to keyed braking windows.

    Filtering and recording share one pass over the samples of each segment.
    """
    # percentiles, segments and their samples read the series several times
    series = stored(brake_mask(stored(kinematics(series, v, key=key), "kinematics"), a_min, j_min, mode, key), "brake-mask")
    segs = merge_segments(segments(series, key=key), max_gap_s, min_dur_s, key)
    seen = samples_in(segs, series, [v, "mask_and", "a", "j"], key)
    stats = seen.groupBy(key, "s", "e", "t_s0", "t_s1").agg(
        F.min("a").alias("a_min_ms2"), F.min("j").alias("j_min_ms3"),
        (F.min_by(v, "i") - F.max_by(v, "i")).alias("dv"),
        (F.count_if("mask_and") / F.count(F.lit(1))).alias("frac"))
    keep = F.col("dv") >= min_delta_v
    if mode == "SOFT_AND":
        keep = keep & (F.col("frac") >= frac)
    return stats.where(keep).select(
        window_key(F.col(key), F.col("t_s0"), F.col("t_s1")).alias("window_key"), key,
        F.col("s").alias("i_start"), F.col("e").alias("i_end"), F.col("t_s0").alias("t_start"),
        F.col("t_s1").alias("t_end"), (F.col("t_s1") - F.col("t_s0")).alias("dur_s"), "a_min_ms2", "j_min_ms3")


def rescue_windows(primary: DataFrame, softer: DataFrame, key: str = "window_key") -> DataFrame:
    """SIG-14: primary windows plus those only the softer preset finds, flagged ``rescued``."""
    extra = softer.join(primary.select(key), key, "left_anti").withColumn("rescued", F.lit(True))
    return primary.withColumn("rescued", F.lit(False)).unionByName(extra)


def interp_at(series: DataFrame, queries: DataFrame, cols: Sequence[str], t: str = "t_s", qt: str = "q_t",
              key: str = "log_id") -> DataFrame:
    """SIG-15: clamped linear interpolation of series columns at arbitrary query times."""
    marks = series.select(key, F.col(t).alias("_t"), F.struct(F.col(t).alias("t"), *cols).alias("_s"),
                          F.lit(None).cast(queries.select(F.struct("*")).schema[0].dataType).alias("_q"))
    asks = queries.select(key, F.col(qt).alias("_t"), F.lit(None).cast(marks.schema["_s"].dataType).alias("_s"),
                          F.struct(*[F.col(c) for c in queries.columns]).alias("_q"))
    both = row_index(marks.unionByName(asks), [key], ["_t", F.col("_q").isNotNull(), F.col("_q")], out="i")
    filled = fill_edges(both, [key], F.col("_s"), "_prev", "_next").where("_q IS NOT NULL")
    a, b = F.col("_prev"), F.col("_next")
    share = (F.col("_t") - a["t"]) / (b["t"] - a["t"])
    return filled.select("_q.*", *[
        F.when(a.isNull(), b[c]).when(b.isNull() | (a["t"] == F.col("_t")) | (b["t"] == a["t"]), a[c])
        .otherwise(a[c] + (b[c] - a[c]) * share).alias(c) for c in cols])


def quat_to_yaw(qw: Column, qx: Column, qy: Column, qz: Column) -> Column:
    """SIG-16: heading about the vertical axis."""
    return F.atan2(2.0 * (qw * qz + qx * qy), 1.0 - 2.0 * (qy * qy + qz * qz))


def union_windows(*windows: DataFrame) -> DataFrame:
    """SIG-17: detections of several runs as one relation."""
    out = windows[0]
    for w in windows[1:]:
        out = out.unionByName(w)
    return out


def quantile_table(series: DataFrame, keys: Sequence[str], value: str, names: dict[str, float]) -> DataFrame:
    return wide_quantiles(series, keys, value, names)
