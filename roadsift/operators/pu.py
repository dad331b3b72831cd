"""Weak labels, positive-unlabelled learning and threshold calibration (PU-*)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadsift.functions.durable import pinned
from roadsift.functions.keys import seeded_hash
from roadsift.functions.ordered import row_index, running_sum
from roadsift.functions.quantiles import group_quantiles


def normalise_tags(tags: DataFrame, features: DataFrame) -> DataFrame:
    """PU-01: plain tag columns, restricted to logs that have features."""
    out = tags.select("log_id", F.coalesce("has_guest", F.lit(False)).alias("has_guest"), "guest_id", "tag")
    return out.join(features.select("log_id"), "log_id", "left_semi")


def label_windows(features: DataFrame, tags: DataFrame) -> DataFrame:
    """PU-02: per (log, guest) the best window: sustained, highest overlap, smallest distance, earliest."""
    guests = tags.where("has_guest AND guest_id IS NOT NULL").select(
        "log_id", F.col("guest_id").alias("track_uuid"), F.col("tag").alias("scenario_label"))
    order = F.struct((-F.col("sustained_tight")).alias("a"), (-F.col("p_overlap")).alias("b"),
                     F.col("dmin_m").alias("c"), F.col("window_center").alias("d"))
    best = features.join(guests, ["log_id", "track_uuid"]).groupBy("log_id", "track_uuid", "scenario_label").agg(
        F.min_by(F.struct("window_t_start", "window_t_end"), order).alias("w"))
    return best.select("log_id", "track_uuid", F.col("w.window_t_start").alias("t_start"),
                       F.col("w.window_t_end").alias("t_end"), F.lit(1).alias("label"), "scenario_label")


def attach_rescued(labels: DataFrame, windows: DataFrame, key: str = "window_key") -> DataFrame:
    """PU-03: rescued flag by window key, false when the window is unknown."""
    flags = windows.groupBy(key).agg(F.bool_or("rescued").alias("rescued"))
    return labels.join(flags, key, "left").withColumn("rescued", F.coalesce("rescued", F.lit(False)))


def pu_targets(windows: DataFrame, labels: DataFrame, key: Sequence[str]) -> DataFrame:
    """PU-04: 1 for labelled windows, 0 for everything unlabelled."""
    y = labels.groupBy(*key).agg(F.max("label").alias("y"))
    return windows.join(y, list(key), "left").withColumn("y", F.coalesce("y", F.lit(0)))


def _column_stats(df: DataFrame, cols: Sequence[str], value: str) -> Column:
    """Medians of several columns as one struct-valued scalar subquery."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value"))
                                         for c in cols])).alias("r")).select("r.*")
    q = group_quantiles(long, ["field"], "value", [0.5], value, fixed=True)
    return q.agg(F.struct(*[F.max(F.when(F.col("field") == c, F.col(value))).alias(c) for c in cols]).alias("s")).scalar()


def impute_median(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PU-06: fill missing values with the medians of ``train``."""
    out = df.withColumn("_med", _column_stats(train, cols, "m"))
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col("_med")[c]) for c in cols}).drop("_med")


def ordered_split(keys: DataFrame, key: str, frac: float, seed: int, out: str = "split") -> DataFrame:
    """Distinct keys in seeded hash order, the first ``ceil(frac * n)`` of them 'val', the others 'train'."""
    distinct = keys.select(key).distinct().withColumn("_h", seeded_hash(seed, F.col(key)))
    ranked = row_index(distinct, [], ["_h", key], out="_k", start=1)
    n = keys.agg(F.count_distinct(key)).scalar()
    return ranked.withColumn(out, F.when(F.col("_k") <= F.ceil(n * F.lit(frac)), "val").otherwise("train")).select(key, out)


def group_split(df: DataFrame, key: str = "log_id", frac: float = 0.2, seed: int = 1337) -> DataFrame:
    """PU-07: hold out whole logs."""
    return df.join(ordered_split(df, key, frac, seed), key)


def fit_boosted(train: DataFrame, cols: Sequence[str], label: str = "y", trees: int = 600, depth: int = 6,
                step: float = 0.05, subsample: float = 0.9, seed: int = 1337):
    """PU-08: gradient-boosted trees over window features; returns a fitted ``pyspark.ml`` pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    stages = [VectorAssembler(inputCols=list(cols), outputCol="_x"),
              GBTClassifier(featuresCol="_x", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step,
                            subsamplingRate=subsample, seed=seed)]
    return Pipeline(stages=stages).fit(train)


def score_boosted(df: DataFrame, model, out: str = "score") -> DataFrame:
    """PU-15: batch scoring with a fitted tree model; probability of the positive class."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def elkan_noto(scores: DataFrame, score: str = "score", y: str = "y", held_out: str | None = None) -> DataFrame:
    """PU-09: c = mean score of the (held-out) positives, calibrated = score / c clipped to [0, 1]."""
    held = F.col(held_out) if held_out else F.lit(True)
    c = scores.agg(F.least(F.greatest(F.coalesce(
        F.avg(F.when((F.col(y) == 1) & held, F.col(score))), F.avg(F.when(F.col(y) == 1, F.col(score))), F.lit(1.0)),
        F.lit(1e-3)), F.lit(1.0)).alias("c")).scalar()
    return scores.withColumn("c", c).withColumn(
        "calibrated", F.least(F.greatest(F.col(score) / F.col("c"), F.lit(0.0)), F.lit(1.0)))


def ap_auc(scores: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """PU-10: average precision and ROC AUC with tied scores treated as one threshold."""
    ties = scores.groupBy(F.col(score).alias("s")).agg(
        F.sum(F.col(y).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("rows"))
    ranked = row_index(ties, [], [F.col("s").desc()], out="i")
    cum = running_sum(running_sum(ranked, [], "pos", "tp"), [], "rows", "seen")
    # dividing by the totals afterwards keeps this a plain aggregate
    sums = cum.agg(F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("ap"), F.sum("pos").alias("p"),
                   F.sum(F.col("rows") - F.col("pos")).alias("n"),
                   F.sum((F.col("rows") - F.col("pos")) * (F.col("tp") - F.col("pos") / 2.0)).alias("area"))
    return sums.select(F.try_divide(F.col("ap"), F.col("p")).alias("ap"),
                       F.try_divide(F.col("area"), F.col("p") * F.col("n").cast("double")).alias("auc"))


def class_prior(scores: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """PU-11: c = mean score of positives, pi = mean score / c, both clipped."""
    c = F.least(F.greatest(F.avg(F.when(F.col(y) == 1, F.col(score))), F.lit(1e-3)), F.lit(0.999))
    return scores.agg(c.alias("c"), F.avg(score).alias("m")).select(
        "c", F.least(F.greatest(F.col("m") / F.col("c"), F.lit(1e-3)), F.lit(0.999)).alias("pi"))


def dedup_scores(scores: DataFrame, key: Sequence[str], how: str = "mean", score: str = "score") -> DataFrame:
    """PU-12: one row per window: "mean" score, "best" row by score, or "max" of every other column."""
    others = [c for c in scores.columns if c not in key]
    if how == "mean":
        return scores.groupBy(*key).agg(F.avg(score).alias(score))
    if how == "max":
        return scores.groupBy(*key).agg(*[F.max(c).alias(c) for c in others])
    rest = [c for c in others if c != score]
    best = scores.groupBy(*key).agg(F.max(F.struct(score, *rest)).alias("_b"))
    return best.select(*key, "_b.*").select(*scores.columns)


def standardise(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PU-13: fill with the train mean, then centre and scale with the train statistics (sigma 0 becomes 1)."""
    stats = train.agg(F.struct(*[F.struct(
        F.avg(c).alias("mu"), F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0).alias("sd")).alias(c)
        for c in cols]).alias("s")).scalar()
    out = df.withColumn("_st", stats)
    return out.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.col("_st")[c]["mu"]) - F.col("_st")[c]["mu"])
                            / F.col("_st")[c]["sd"] for c in cols}).drop("_st")


def linear_score(cols: Sequence[str], weights: Sequence[float], bias: float) -> Column:
    """PU-15: probability of a linear model as one column expression."""
    z = F.lit(float(bias))
    for c, w in zip(cols, weights):
        z = z + F.col(c) * F.lit(float(w))
    return 1.0 / (1.0 + F.exp(-z))


def nnpu_risk(df: DataFrame, cols: Sequence[str], pi: float, weights: Sequence[float], y: str = "y") -> tuple[float, np.ndarray]:
    """PU-14: non-negative risk of a linear model (its bias last) and the gradient of that risk, in one pass.

    Every task adds up losses and slopes of its batches; the sums meet place by place, so the driver gets one row for each."""
    w = np.asarray(weights, float)
    names, d = list(cols), len(cols) + 1

    def part(batches):
        total = np.zeros(5 + 3 * d)
        for batch in batches:
            x = np.column_stack([*[batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], np.ones(batch.num_rows)])
            label = batch.column(y).to_numpy(zero_copy_only=False)
            z = x @ w
            p = np.exp(-np.logaddexp(0.0, -z))
            pos, unl = label == 1, label == 0
            as_pos, as_neg = np.logaddexp(0.0, -z), np.logaddexp(0.0, z)
            total += np.concatenate([[pos.sum(), unl.sum(), as_pos[pos].sum(), as_neg[pos].sum(), as_neg[unl].sum()],
                                     (p - 1)[pos] @ x[pos], p[pos] @ x[pos], p[unl] @ x[unl]])
        yield pa.record_batch({"at": pa.array(np.arange(len(total)), pa.int32()), "v": pa.array(total)})

    rows = df.select(F.col(y).cast("int").alias(y), *names).mapInArrow(part, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(5 + 3 * d)
    for r in rows:
        v[r["at"]] = r["v"]
    n_pos, n_unl = max(v[0], 1.0), max(v[1], 1.0)
    slope_pos, slope_neg, slope_unl = v[5:5 + d] / n_pos, v[5 + d:5 + 2 * d] / n_pos, v[5 + 2 * d:] / n_unl
    negative = v[4] / n_unl - pi * v[3] / n_pos
    return float(pi * v[2] / n_pos + max(0.0, negative)), pi * slope_pos + ((slope_unl - pi * slope_neg) if negative > 0 else 0.0)


def fit_nnpu_linear(df: DataFrame, cols: Sequence[str], pi: float, y: str = "y", epochs: int = 100, tol: float = 1e-6, memory: int = 8):
    """PU-14: linear classifier under the non-negative PU risk; returns (weights, bias, risk).

    Limited-memory quasi-Newton steps with a backtracking line search, until no slope exceeds ``tol`` or no step lowers the risk; the driver
    holds the weights and the last ``memory`` steps only.
    """
    df = pinned(df.select(y, *cols))  # read at every step
    w = np.zeros(len(cols) + 1)
    risk, grad = nnpu_risk(df, cols, pi, w, y)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(epochs):
        if np.abs(grad).max() <= tol:
            break
        way, used = -grad, []
        for s, g in reversed(steps):
            used.append((s @ way) / (g @ s))
            way = way - used[-1] * g
        if steps:
            s, g = steps[-1]
            way = way * (s @ g) / (g @ g)
        for (s, g), a in zip(steps, reversed(used)):
            way = way + (a - (g @ way) / (g @ s)) * s
        length, fall = 1.0, float(grad @ way)
        while length > 1e-6:
            there = nnpu_risk(df, cols, pi, w + length * way, y)
            if there[0] <= risk + 1e-4 * length * fall:
                break
            length /= 2
        else:
            break
        s, g = length * way, there[1] - grad
        if s @ g > 1e-12:
            steps = [*steps, (s, g)][-memory:]
        w, (risk, grad) = w + s, there
    return [float(v) for v in w[:-1]], float(w[-1]), risk


def fold_of(key: Column, k: int = 5, seed: int = 1337) -> Column:
    """Deterministic fold number of a log."""
    return F.conv(F.substring(seeded_hash(seed, key), 1, 8), 16, 10).cast("bigint") % k


def calibrate_tau(positives: DataFrame, score: str = "score", recall: float = 0.9, k: int = 5, seed: int = 1337) -> DataFrame:
    """PU-16: per fold of logs the nearest-rank (1 - recall) quantile of the positive scores and its recall."""
    folds = positives.withColumn("fold", fold_of(F.col("log_id"), k, seed))
    tau = group_quantiles(folds, ["fold"], score, [1.0 - recall], "tau", nearest=True, fixed=True).select("fold", "tau")
    mid = group_quantiles(folds, ["fold"], score, [0.5], "pos_median", fixed=True).select("fold", "pos_median")
    stats = folds.join(F.broadcast(tau), "fold").groupBy("fold", "tau").agg(  # one row per fold
        F.count(F.lit(1)).alias("n_pos"), F.avg((F.col(score) >= F.col("tau")).cast("double")).alias("recall_at_tau"),
        F.min(score).alias("pos_min"), F.max(score).alias("pos_max"))
    return stats.join(mid, "fold")


def tau_summary(folds: DataFrame, positives: DataFrame, score: str = "score") -> DataFrame:
    """PU-16: the median fold threshold and the share of all positives that reach it."""
    tau = folds.agg(F.percentile("tau", 0.5)).scalar()
    return positives.withColumn("tau", tau).groupBy("tau").agg(
        F.avg((F.col(score) >= F.col("tau")).cast("double")).alias("achieved_recall"), F.count(F.lit(1)).alias("n_pos"))


def tau_tiers(folds: DataFrame, q_lo: float = 0.25, q_hi: float = 0.5) -> DataFrame:
    """PU-17: lower and upper thresholds as quantiles of the fold thresholds (one row per fold, so a small input)."""
    return folds.agg(F.percentile("tau", q_lo).alias("tau_lo"), F.percentile("tau", q_hi).alias("tau_hi"))


def tiers(scores: DataFrame, lo: Column, hi: Column, score: str = "score", exclude: DataFrame | None = None) -> DataFrame:
    """Tier hi / lo / none of every window, without the excluded logs."""
    df = scores.join(exclude.select("log_id").distinct(), "log_id", "left_anti") if exclude is not None else scores
    return df.withColumn("conf_level", F.when(F.col(score) >= hi, "hi").when(F.col(score) >= lo, "lo").otherwise("none"))


def pseudo_labels(scores: DataFrame, lo: Column, hi: Column, w_hi: float = 1.0, w_lo: float = 0.6,
                  exclude: DataFrame | None = None) -> DataFrame:
    """PU-18: windows of the tiers hi and lo as weighted positives."""
    kept = tiers(scores, lo, hi, exclude=exclude).where("conf_level <> 'none'")
    return kept.withColumn("label", F.lit(1)).withColumn(
        "weight", F.when(F.col("conf_level") == "hi", w_hi).otherwise(w_lo)).withColumn("source", F.lit("pu_xgb"))


def tier_summary(tiered: DataFrame, score: str = "score") -> DataFrame:
    """PU-19: count, minimum, median and maximum score of each tier."""
    base = tiered.groupBy("conf_level").agg(F.count(F.lit(1)).alias("n_windows"), F.min(score).alias("score_min"),
                                           F.max(score).alias("score_max"))
    return base.join(group_quantiles(tiered, ["conf_level"], score, [0.5], "score_median", fixed=True)
                     .select("conf_level", "score_median"), "conf_level")


def train_targets(windows: DataFrame, gt: DataFrame, pseudo: DataFrame, key: Sequence[str]) -> DataFrame:
    """PU-20: ground truth and pseudo positives joined to the windows; ground truth wins duplicates."""
    both = gt.select(*key, F.lit(1.0).alias("weight"), F.lit("gt").alias("source"), F.lit(0).alias("prio")).unionByName(
        pseudo.select(*key, "weight", F.lit("pseudo").alias("source"), F.lit(1).alias("prio")))
    one = both.groupBy(*key).agg(F.min_by(F.struct("weight", "source"), F.struct("prio", -F.col("weight"))).alias("t"))
    return windows.join(one, list(key), "left").select(
        *windows.columns, F.when(F.col("t").isNotNull(), 1).otherwise(0).alias("target"),
        F.coalesce("t.weight", F.lit(0.0)).alias("target_weight"), F.coalesce("t.source", F.lit("unlabeled")).alias("target_source"))


def sample_pu(df: DataFrame, key: str, y: str = "y", ratio: int = 2, seed: int = 1337) -> DataFrame:
    """PU-21: all positives and ``ratio`` times as many unlabelled rows, in seeded hash order."""
    n_pos = df.agg(F.count_if(F.col(y) == 1)).scalar()
    rest = row_index(df.where(F.col(y) == 0).withColumn("_h", seeded_hash(seed, F.col(key))), [], ["_h", key],
                     out="_k", start=1)
    return df.where(F.col(y) == 1).unionByName(rest.where(F.col("_k") <= n_pos * ratio).drop("_h", "_k"))
