"""Score fusion and temporal smoothing per log (TMP-*).

EMA, two-state posterior and Viterbi path are sequential along a log.  Each is written as a scan over
chunks of at most ``SCAN`` windows: rows become one array per (log, chunk), built-in array functions run
inside the chunk, and a chunk's whole effect is a small fixed-size summary (an affine map, a 2x2 matrix).
Only those summaries - ``SCAN`` times fewer than the rows, and none for logs that fit one chunk - are
carried along a log.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadsift.functions.ordered import own_rows, chunk_window, row_index, running_sum, with_halo

SCAN = 1024
RUN = 32
EPS_SCORE = 1e-5
EPS_EMISSION = 1e-6


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def merge_scores(windows: DataFrame, first: DataFrame, second: DataFrame, key: list[str],
                 eps: float = EPS_SCORE) -> DataFrame:
    """TMP-01: both scores next to every window; a missing one becomes ``eps``, all are clipped."""
    out = windows.join(first, key, "left").join(second, key, "left")
    return out.withColumns({c: clip(F.coalesce(F.col(c).cast("double"), F.lit(eps)), eps, 1 - eps)
                            for c in ("score_pu_xgb", "score_nnpu")})


def fuse_logit(p: Column, q: Column, wp: float = 0.5, wq: float = 0.5, eps: float = EPS_EMISSION) -> Column:
    """TMP-02: sigmoid of the weighted logit sum."""
    def logit(c):
        c = clip(c, eps, 1 - eps)
        return F.ln(c) - F.ln(1 - c)
    return 1.0 / (1.0 + F.exp(-(wp * logit(p) + wq * logit(q))))


def prior(df: DataFrame, p: str, pi: float | None = None) -> Column:
    """TMP-03: the given prior, or the clipped mean of the fused scores, as a scalar subquery."""
    if pi is not None:
        return F.lit(min(max(pi, 1e-3), 0.999))
    return df.agg(clip(F.avg(p), 1e-3, 0.999).alias("pi")).scalar()


def _chunk_rows(df: DataFrame, key: str, p: str, i: str, pi: Column, size: int) -> DataFrame:
    """One row per (log, chunk): the ordered rows with their emission ratio, never more than ``size``."""
    ratio = clip(F.col(p), EPS_EMISSION, 1 - EPS_EMISSION) / clip(1.0 - F.col(p), EPS_EMISSION, 1 - EPS_EMISSION)
    payload = F.struct(*[F.col(c) for c in df.columns if c != key])
    return (df.withColumn("_pi", pi)
            .select(key, F.floor(F.col(i) / size).alias("_c"), "_pi",
                    F.struct(F.col(i).alias("i"), F.col(p).alias("p"), ratio.alias("rho"), payload.alias("row")).alias("_r"))
            .groupBy(key, "_c").agg(F.first("_pi").alias("_pi"), F.array_sort(F.collect_list("_r")).alias("_rows")))


def _last(a) -> Column:
    return F.element_at(a, -1)


def _scan(rows, start: Column, step, back: bool = False) -> Column:
    """Array of ``len(rows) + 1`` states; the first one is ``start`` (forwards) or the last one (backwards).

    Appending copies an array, so states grow in runs of ``RUN`` and only the finished runs are appended to each other."""
    seq = F.reverse(rows) if back else rows
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(seq) - 1) / RUN).cast("int")), lambda k: F.slice(seq, k * RUN + 1, RUN))

    def run(part, state: Column) -> Column:
        return F.slice(F.aggregate(part, F.array(state), lambda acc, x: F.concat(acc, F.array(step(_last(acc), x)))), 2, RUN)

    states = F.flatten(F.aggregate(runs, F.array(F.array(start)), lambda acc, part: F.concat(acc, F.array(run(part, _last(_last(acc)))))))
    return F.reverse(states) if back else states


def _compose(rows, start: list[float], step) -> Column:
    """Fold small fixed-size arrays over the rows of a chunk."""
    return F.aggregate(rows, F.array(*[F.lit(float(v)) for v in start]), step)


def _rescaled(m: list[Column]) -> Column:
    """A 2x2 matrix divided by its largest entry, so that long products stay in range."""
    return F.transform(F.array(F.array(*m)), lambda a: F.transform(a, lambda v: v / F.array_max(a)))[0]


def _shifted(m: list[Column]) -> Column:
    return F.transform(F.array(F.array(*m)), lambda a: F.transform(a, lambda v: v - F.array_max(a)))[0]


def smooth(df: DataFrame, p: str, key: str = "log_id", i: str = "i", want: Iterable[str] = ("ema", "post", "state"),
           alpha: float = 0.4, on: float = 0.85, off: float = 0.95, pi: float | None = None,
           size: int = SCAN) -> DataFrame:
    """EMA (``score_ema``), posterior (``post_hmm``) and Viterbi state (``viterbi``) of ``p`` along each log."""
    want = set(want)
    p11, p00 = min(max(on, 1e-3), 0.999), min(max(off, 1e-3), 0.999)
    l11, l10, l01, l00 = math.log(p11), math.log(1 - p11), math.log(1 - p00), math.log(p00)
    need_prior = want & {"post", "state"}
    chunks = _chunk_rows(df, key, p, i, prior(df, p, pi) if need_prior else F.lit(0.5), size)
    odds0 = F.col("_pi") / (1 - F.col("_pi"))

    def ema_step(y, x):
        return F.when(x["i"] == 0, x["p"]).otherwise(alpha * x["p"] + (1 - alpha) * y)

    def fwd_step(o, x):
        moved = (o * p11 + (1 - p00)) / (o * (1 - p11) + p00)
        return x["rho"] * F.when(x["i"] == 0, odds0).otherwise(moved)

    def bwd_step(w, x):
        return ((1 - p11) + p11 * x["rho"] * w) / (p00 + (1 - p00) * x["rho"] * w)

    def vit_step(d, x):
        moved = F.greatest(d + l11, F.lit(l01)) - F.greatest(d + l10, F.lit(l00))
        return F.ln(x["rho"]) + F.when(x["i"] == 0, F.ln(odds0)).otherwise(moved)

    def came_from(state, d_prev):
        return F.when(state == 1, (d_prev + l11 > l01).cast("int")).otherwise((d_prev + l10 > l00).cast("int"))

    # carry over chunks, only for logs with more than one
    rows = F.col("_rows")
    totals = chunks.withColumn("_far", F.col("_c") > 0).select(
        key, "_c",
        F.when(~F.col("_far"), _last(_scan(rows, F.lit(0.0), ema_step))).alias("y0"),
        F.when(~F.col("_far"), _last(_scan(rows, F.lit(1.0), fwd_step))).alias("o0"),
        F.when(~F.col("_far"), _last(_scan(rows, F.lit(0.0), vit_step))).alias("d0"),
        F.when(F.col("_far"), _compose(rows, [1, 0], lambda m, x: F.array(
            m[0] * (1 - alpha), m[1] * (1 - alpha) + alpha * x["p"]))).alias("ema"),
        F.when(F.col("_far"), _compose(rows, [1, 0, 0, 1], lambda m, x: _rescaled([
            x["rho"] * (p11 * m[0] + (1 - p00) * m[2]), x["rho"] * (p11 * m[1] + (1 - p00) * m[3]),
            (1 - p11) * m[0] + p00 * m[2], (1 - p11) * m[1] + p00 * m[3]]))).alias("hmm"),
        F.when(F.col("_far"), _compose(rows, [0, -1e18, -1e18, 0], lambda m, x: _shifted([
            F.ln(x["rho"]) + F.greatest(l11 + m[0], l01 + m[2]), F.ln(x["rho"]) + F.greatest(l11 + m[1], l01 + m[3]),
            F.greatest(l10 + m[0], l00 + m[2]), F.greatest(l10 + m[1], l00 + m[3])]))).alias("vit"))
    long_logs = chunks.where("_c > 0").select(key).distinct()

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_c")
        y = o = d = w = None
        ins = []
        for r in pdf.itertuples(index=False):
            ins.append((y, o, d))
            if r[1] == 0:
                y, o, d = r.y0, r.o0, r.d0
            else:
                y = r.ema[0] * y + r.ema[1]
                o = (r.hmm[0] * o + r.hmm[1]) / (r.hmm[2] * o + r.hmm[3])
                d = max(r.vit[0] + d, r.vit[1]) - max(r.vit[2] + d, r.vit[3])
        w, outs = 1.0, []
        for r in reversed(list(pdf.itertuples(index=False))):
            outs.append(w)
            if r[1] > 0:
                w = (r.hmm[0] * w + r.hmm[2]) / (r.hmm[1] * w + r.hmm[3])
        out = pdf[[key, "_c"]].copy()
        out["_y"], out["_o"], out["_d"] = zip(*ins)
        out["_w"] = outs[::-1]
        return out.astype({"_y": float, "_o": float, "_d": float})

    key_type = df.schema[key].dataType.simpleString()
    carried = totals.join(long_logs, key, "left_semi").groupBy(key).applyInPandas(
        carry, f"`{key}` {key_type}, _c bigint, _y double, _o double, _d double, _w double")
    state = chunks.join(carried, [key, "_c"], "left")
    if "ema" in want:
        state = state.withColumn("_ema", _scan(rows, F.coalesce("_y", F.lit(0.0)), ema_step))
    if "post" in want:
        state = state.withColumn("_fwd", _scan(rows, F.coalesce("_o", F.lit(1.0)), fwd_step)) \
                     .withColumn("_bwd", _scan(rows, F.coalesce("_w", F.lit(1.0)), bwd_step, back=True))
    if "state" in want:
        state = state.withColumn("_dv", _scan(rows, F.coalesce("_d", F.lit(0.0)), vit_step))
        end = (_last("_dv") > 0).cast("int")
        before = F.slice("_dv", 1, F.size(rows))

        def trace(start):
            return _scan(before, start, came_from, back=True)
        maps = state.select(key, "_c", end.alias("end"), trace(F.lit(0))[0].alias("m0"), trace(F.lit(1))[0].alias("m1")) \
                    .join(long_logs, key, "left_semi")

        def ends(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_c", ascending=False)
            s, outs = None, []
            for r in pdf.itertuples(index=False):
                s = int(r.end) if s is None else s
                outs.append(s)
                s = int(r.m1 if s else r.m0)
            return pdf[[key, "_c"]].assign(_s=outs)

        last_states = maps.groupBy(key).applyInPandas(ends, f"`{key}` {key_type}, _c bigint, _s int")
        state = state.join(last_states, [key, "_c"], "left").withColumn("_path", trace(F.coalesce("_s", end)))
    # position k of the row arrays sits at k+1 in forward arrays, which start with the carried state
    out = state.select(key, F.posexplode("_rows").alias("_k", "_r"), *[c for c in ("_ema", "_fwd", "_bwd", "_path")
                                                                     if c in state.columns])
    at = F.col("_k") + 1
    odds = F.get("_fwd", at) * F.get("_bwd", at) if "post" in want else None
    cols = []
    if "ema" in want:
        cols.append(F.get("_ema", at).alias("score_ema"))
    if "post" in want:
        cols.append((odds / (1 + odds)).alias("post_hmm"))
    if "state" in want:
        cols.append(F.get("_path", at).alias("viterbi"))
    return out.select(key, "_r.row.*", *cols)


def ema(df: DataFrame, p: str, alpha: float = 0.4, key: str = "log_id", i: str = "i", size: int = SCAN) -> DataFrame:
    """TMP-04: exponential moving average, seeded with the first value."""
    return smooth(df, p, key, i, ("ema",), alpha=alpha, size=size)


def hmm_posterior(df: DataFrame, p: str, pi: float | None = None, on: float = 0.85, off: float = 0.95,
                  key: str = "log_id", i: str = "i", size: int = SCAN) -> DataFrame:
    """TMP-05: forward-backward posterior of the sticky two-state chain."""
    return smooth(df, p, key, i, ("post",), on=on, off=off, pi=pi, size=size)


def viterbi(df: DataFrame, p: str, pi: float | None = None, on: float = 0.85, off: float = 0.95,
            key: str = "log_id", i: str = "i", size: int = SCAN) -> DataFrame:
    """TMP-06: most likely state path; ties go to state 0."""
    return smooth(df, p, key, i, ("state",), on=on, off=off, pi=pi, size=size)


def state_segments(df: DataFrame, state: str = "viterbi", extra: dict[str, Column] | None = None,
                   key: str = "log_id") -> DataFrame:
    """TMP-07: run-length segments of a state path: start, end, duration and number of windows."""
    halo = with_halo(df, before=1)
    turned = own_rows(halo.withColumn("_was", F.lag(state).over(chunk_window([key]))))
    marked = turned.withColumn("_new", F.coalesce(F.col("_was") != F.col(state), F.lit(True)).cast("bigint"))
    runs = running_sum(marked, [key], "_new", "_run")
    return runs.groupBy(key, "_run", F.col(state).alias("state")).agg(
        F.min_by("t_start", "i").alias("t_start"), F.max_by("t_end", "i").alias("t_end"),
        F.count(F.lit(1)).alias("n_windows"),
        *[c.alias(name) for name, c in (extra or {}).items()]) \
        .withColumn("duration_s", F.col("t_end") - F.col("t_start")).drop("_run")


def final_score(df: DataFrame, mode: str = "hmm") -> DataFrame:
    """TMP-08: choose the exported score."""
    source = {"hmm": "post_hmm", "ema": "score_ema", "fused": "score_fused"}[mode]
    return df.withColumn("score_final", F.col(source).cast("double"))


def episodes(df: DataFrame) -> DataFrame:
    """TMP-09: positive runs with their highest and mean posterior."""
    runs = state_segments(df, extra={"post_max": F.max("post_hmm"), "post_mean": F.avg("post_hmm")})
    return runs.where("state = 1").select("log_id", F.col("t_start").alias("t0"), F.col("t_end").alias("t1"),
                                          "duration_s", "post_max", "post_mean", "n_windows")


def index_windows(df: DataFrame, key: str = "log_id") -> DataFrame:
    """Number the windows of each log by start and end, the order every scan above uses."""
    return row_index(df, [key], ["t_start", "t_end"], out="i")
