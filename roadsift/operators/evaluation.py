"""Detection and ranking evaluation (EVL-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadsift.functions.intervals import interval_iou, near_join, overlap_join
from roadsift.functions.ordered import fill_edges, row_index
from roadsift.functions.quantiles import group_medians
from roadsift.operators.graph import tall

MISS = 999
GT = ["log_id", "g_start", "g_end"]


def ndcg(rows: DataFrame, k: int = 3, gain: str = "linear", win: str = "window_key", score: str = "score", g: str = "gain") -> DataFrame:
    """EVL-02: NDCG@k per window, with linear or exponential (2^g - 1) gain."""
    value = F.col(g) if gain == "linear" else F.pow(F.lit(2.0), F.col(g)) - 1
    by_score = Window.partitionBy(win).orderBy(F.col(score).desc(), F.col(g).desc())
    by_gain = Window.partitionBy(win).orderBy(F.col(g).desc())
    # only the first k rows of either order count
    got = rows.withColumn("_r", F.row_number().over(by_score)).where(F.col("_r") <= k).groupBy(win).agg(F.sum(value / F.log2(F.col("_r") + 1)).alias("_dcg"))
    best = rows.withColumn("_r", F.row_number().over(by_gain)).where(F.col("_r") <= k).groupBy(win).agg(F.sum(value / F.log2(F.col("_r") + 1)).alias("_idcg"))
    return got.join(best, win).select(win, F.when(F.col("_idcg") > 0, F.col("_dcg") / F.col("_idcg")).otherwise(0.0).alias("ndcg"))


def match_gt(gt: DataFrame, windows: DataFrame, preds: DataFrame, tags: DataFrame, near: float = 3.0, k: int = 3) -> DataFrame:
    """EVL-03: the evaluated window of each ground-truth row.

    Nearby window with a tagged actor in its top k (by rank, score, nearness), else such a window anywhere in
    the log, else the one with the largest IoU, else the earliest.  Each step is a bucketed join or a
    per-log aggregate; ground truth and windows of a log are never paired in full.
    """
    c = windows.select("log_id", "window_key", "t_start", "t_end", (0.5 * (F.col("t_start") + F.col("t_end"))).alias("centre"))
    hits = preds.where(F.col("rank") <= k).join(c, "window_key").join(tags.select("log_id", "track_uuid").distinct(), ["log_id", "track_uuid"], "left_semi") \
        .groupBy("log_id", "window_key", "centre").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    g = gt.select(*GT, "scenario_label", (0.5 * (F.col("g_start") + F.col("g_end"))).alias("gc"))
    dt = F.abs(F.col("centre") - F.col("gc"))
    order = F.struct("rank", -F.col("score"), dt, "window_key")
    pick = F.min_by(F.struct("window_key", "rank"), order)
    close = near_join(g, hits, ["log_id"], "gc", "centre", near).groupBy(*GT).agg(pick.alias("near"))
    top = hits.groupBy("log_id").agg(F.min(F.struct("rank", (-F.col("score")).alias("neg"))).alias("b"))
    cls = hits.join(top, "log_id").where((F.col("rank") == F.col("b.rank")) & (-F.col("score") == F.col("b.neg"))).drop("b")
    anywhere = nearest_in_time(g, cls, "gc", "centre", ["window_key", "rank"]).where("window_key IS NOT NULL") \
        .select(*GT, F.struct("window_key", "rank").alias("any"))
    ov = overlap_join(g, c, ["log_id"], ("g_start", "g_end"), ("t_start", "t_end"))
    iou = interval_iou(F.col("g_start"), F.col("g_end"), F.col("t_start"), F.col("t_end"))
    best = ov.groupBy(*GT).agg(F.min_by("window_key", F.when(iou > 0, F.struct(-iou, "centre", "window_key"))).alias("iou"))
    first = c.groupBy("log_id").agg(F.min_by("window_key", F.struct("centre", "window_key")).alias("first"))
    out = g.join(close, GT, "left").join(anywhere, GT, "left").join(best, GT, "left").join(first, "log_id", "left")
    return out.select(
        *GT, "scenario_label",
        F.coalesce("near.window_key", "any.window_key", "iou", "first").alias("used_window"),
        F.coalesce("near.rank", "any.rank", F.lit(MISS)).alias("best_rank"),
        F.when(F.col("near").isNotNull(), "chose_near_with_gt").when(F.col("any").isNotNull(), "chose_any_with_gt")
        .when(F.col("first").isNotNull(), "fallback_max_iou_no_gt").otherwise("no_candidates").alias("status"))


def considered(matched: DataFrame, preds: DataFrame, tags: DataFrame) -> DataFrame:
    """Matched rows whose window has predictions, with top-1, recall, reciprocal rank and pairwise accuracy."""
    used = matched.join(preds.select(F.col("window_key").alias("used_window")).distinct(), "used_window", "left_semi")
    good = tags.select("log_id", "track_uuid").distinct().withColumn("_gt", F.lit(1))
    rows = used.select(*GT, "used_window", "best_rank").join(preds.withColumnRenamed("window_key", "used_window"), "used_window") \
        .join(good, ["log_id", "track_uuid"], "left")
    first = rows.where("_gt = 1 AND rank = best_rank").groupBy(*GT).agg(F.max("score").alias("_s"))
    pair = rows.where("_gt IS NULL").join(first, GT).groupBy(*GT).agg(F.avg((F.col("_s") > F.col("score")).cast("double")).alias("pairwise"))
    return used.join(pair, GT, "left").withColumns({
        "top1": (F.col("best_rank") == 1).cast("double"), "recall": (F.col("best_rank") <= 3).cast("double"),
        "mrr": F.when(F.col("best_rank") < MISS, 1.0 / F.col("best_rank")).otherwise(0.0), "pairwise": F.coalesce("pairwise", F.lit(0.0))})


def _rank_aggs() -> list[Column]:
    return [F.count(F.lit(1)).alias("considered"), F.avg("top1").alias("hit_at_1"), F.avg("recall").alias("recall_at_k"),
            F.coalesce(F.avg(F.when(F.col("best_rank") < MISS, F.col("best_rank"))), F.lit(0.0)).alias("mean_best_rank"),
            F.avg("mrr").alias("mrr"), F.avg("pairwise").alias("pairwise_acc")]


def rank_metrics(matched: DataFrame, preds: DataFrame, tags: DataFrame) -> DataFrame:
    """EVL-04: ranking metrics over the considered rows, with the number of all rows."""
    total = matched.agg(F.count(F.lit(1))).scalar()
    return considered(matched, preds, tags).agg(*_rank_aggs()).withColumn("total", total)


def rank_metrics_by(matched: DataFrame, preds: DataFrame, tags: DataFrame) -> DataFrame:
    """EVL-05: the same per scenario, and overall as 'ALL'; grouping sets share one pass."""
    rows = considered(matched, preds, tags)
    return rows.groupingSets([[F.col("scenario_label")], []], F.col("scenario_label")).agg(
        *_rank_aggs(), F.grouping("scenario_label").alias("_all")).withColumn(
        "scenario_label", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("scenario_label"))).drop("_all")


def teacher_ndcg(preds: DataFrame, teacher: DataFrame, matched: DataFrame, k: int = 3, gain: str = "linear") -> DataFrame:
    """EVL-06: mean NDCG against the teacher over all windows, those used for ground truth, and the others."""
    rows = preds.join(teacher.select("window_key", "track_uuid", "q"), ["window_key", "track_uuid"], "left").withColumn("gain", F.coalesce("q", F.lit(0.0)))
    with_mass = rows.groupBy("window_key").agg(F.max("gain").alias("m")).where("m > 0").select("window_key")
    per = ndcg(rows, k, gain).join(with_mass, "window_key", "left_semi")
    used = matched.select(F.col("used_window").alias("window_key")).distinct().withColumn("_u", F.lit(True))
    per = per.join(used, "window_key", "left")
    return per.agg(F.avg("ndcg").alias("ndcg_all"), F.avg(F.when(F.col("_u"), F.col("ndcg"))).alias("ndcg_gt"),
                   F.avg(F.when(F.col("_u").isNull(), F.col("ndcg"))).alias("ndcg_discovery"))


def overlapping(windows: DataFrame, gt: DataFrame) -> DataFrame:
    """Pairs of windows and ground truth of the same log that share positive time."""
    pairs = overlap_join(gt.select(*GT, "scenario_label"), windows.select("log_id", "window_key", "t_start", "t_end"), ["log_id"],
                         ("g_start", "g_end"), ("t_start", "t_end"))
    return pairs.withColumn("iou", interval_iou(F.col("g_start"), F.col("g_end"), F.col("t_start"), F.col("t_end"))).where("iou > 0")


def label_overlap(windows: DataFrame, gt: DataFrame) -> DataFrame:
    """EVL-07: whether a detection overlaps ground truth or is a new discovery."""
    hit = overlapping(windows, gt).select("window_key").distinct().withColumn("is_gt", F.lit(True))
    return windows.join(hit, "window_key", "left").withColumn("is_gt", F.coalesce("is_gt", F.lit(False)))


def discovery_stats(labelled: DataFrame, score: str = "score") -> DataFrame:
    """EVL-08: count, mean and median score of detections with and without ground truth."""
    base = labelled.groupBy("is_gt").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"))
    return base.join(group_medians(labelled, ["is_gt"], score, fixed=True), "is_gt", "left")


def nearest_in_time(queries: DataFrame, points: DataFrame, q: str, p: str, cols: list[str], log: str = "log_id") -> DataFrame:
    """The point of the same log nearest in time to each query (the earlier one on ties), without pairing them."""
    qt = queries.select(F.struct("*")).schema[0].dataType
    marks = points.select(log, F.col(p).alias("_t"), F.struct(F.col(p).alias("_at"), *cols).alias("_s"), F.lit(None).cast(qt).alias("_q"))
    asks = queries.select(log, F.col(q).alias("_t"), F.lit(None).cast(marks.schema["_s"].dataType).alias("_s"), F.struct(*queries.columns).alias("_q"))
    both = row_index(marks.unionByName(asks), [log], ["_t", F.col("_q").isNotNull(), F.col("_s"), F.col("_q")], out="i")
    near = fill_edges(both, [log], F.col("_s"), "_prev", "_next").where("_q IS NOT NULL")
    later = F.col("_prev").isNull() | (F.col("_next._at") - F.col("_t") < F.col("_t") - F.col("_prev._at"))
    return near.withColumn("_n", F.when(F.coalesce(later, F.lit(False)), F.col("_next")).otherwise(F.col("_prev"))).select("_q.*", *[F.col("_n")[c].alias(c) for c in cols])


def temporal_quality(gt: DataFrame, windows: DataFrame) -> DataFrame:
    """EVL-09: per ground-truth row the centre latency and IoU of the nearest overlapping window (else the nearest one) and the number of overlaps."""
    gc = 0.5 * (F.col("g_start") + F.col("g_end"))
    pairs = overlapping(windows, gt).withColumn("lat", 0.5 * (F.col("t_start") + F.col("t_end")) - gc)
    best = pairs.groupBy(*GT).agg(F.min_by(F.struct("lat", "iou"), F.struct(F.abs("lat"), "t_start")).alias("b"), F.count(F.lit(1)).alias("frag"))
    points = windows.select("log_id", (0.5 * (F.col("t_start") + F.col("t_end"))).alias("centre"))
    lone = gt.join(best.select(*GT), GT, "left_anti").withColumn("gc", gc)
    rest = nearest_in_time(lone.select(*GT, "scenario_label", "gc"), points.withColumn("c", F.col("centre")), "gc", "centre", ["c"]).where("c IS NOT NULL")
    a = gt.select(*GT, "scenario_label").join(best, GT).select(*GT, "scenario_label", F.col("b.lat").alias("latency_s"), F.col("b.iou").alias("iou"), "frag")
    return a.unionByName(rest.select(*GT, "scenario_label", (F.col("c") - F.col("gc")).alias("latency_s"), F.lit(0.0).alias("iou"), F.lit(0).cast("bigint").alias("frag")))


def temporal_summary(quality: DataFrame) -> DataFrame:
    """EVL-09: medians of latency and IoU and the mean fragmentation, one row."""
    long = quality.select(F.explode(F.create_map(F.lit("latency"), F.col("latency_s"), F.lit("iou"), F.col("iou"))).alias("metric", "v"))
    med = group_medians(long, ["metric"], "v", "value", fixed=True).select(F.concat(F.lit("median_"), "metric").alias("metric"), "value")
    return med.unionByName(tall(quality.agg(F.avg("frag").alias("mean_fragmentation"))))


def detection_recall(gt: DataFrame, windows: DataFrame) -> DataFrame:
    """EVL-10: share of ground truth covered by any detection, per scenario and as 'ALL'."""
    hit = overlapping(windows, gt).select(*GT).distinct().withColumn("_h", F.lit(1))
    rows = gt.select(*GT, "scenario_label").join(hit, GT, "left").withColumn("covered", F.coalesce("_h", F.lit(0)))
    return rows.withColumn("scenario", F.explode(F.array(F.lit("ALL"), "scenario_label"))).groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_gt"), F.sum("covered").alias("covered"), F.avg("covered").alias("recall"))


def operational_counts(windows: DataFrame, kept: DataFrame) -> DataFrame:
    """EVL-11: total, kept and discarded windows."""
    k = kept.select("window_key").distinct().withColumn("_k", F.lit(1))
    return windows.join(k, "window_key", "left").agg(F.count(F.lit(1)).alias("total"), F.count("_k").alias("kept")).withColumn("discarded", F.col("total") - F.col("kept"))


def catalogs(labelled: DataFrame, kept: DataFrame) -> DataFrame:
    """EVL-12: windows per log: total, with ground truth, newly discovered, discarded."""
    k = kept.select("window_key").distinct().withColumn("_k", F.lit(1))
    return labelled.join(k, "window_key", "left").groupBy("log_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_gt").alias("gt"), F.count_if(~F.col("is_gt")).alias("new_discovery"),
        F.count_if(F.col("_k").isNull()).alias("discarded"))


def pr_curve(scored: DataFrame, n: int = 201, score: str = "score", y: str = "y") -> DataFrame:
    """EVL-13: precision and recall at ``n`` thresholds.

    Rows are counted by the highest threshold they reach; the sums over at most ``n`` bins follow.
    """
    step, p = 1.0 / (n - 1), F.col(score)
    guess = F.floor(p / step)
    level = F.when((guess + 1) * F.lit(step) <= p, guess + 1).when(guess * F.lit(step) > p, guess - 1).otherwise(guess)
    bins = scored.where(p.isNotNull()).groupBy(F.least(level, F.lit(n - 1)).alias("level")).agg(
        F.sum(F.col(y).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("rows"))
    grid = scored.sparkSession.range(n).select(F.col("id").alias("level"))
    w = Window.orderBy(F.col("level").desc())
    cum = grid.join(bins, "level", "left").na.fill(0).select("level", F.sum("pos").over(w).alias("tp"), F.sum("rows").over(w).alias("pred"),
                                                             F.sum("pos").over(Window.partitionBy()).alias("p"))
    return cum.select((F.col("level") * F.lit(step)).alias("threshold"), F.coalesce(F.try_divide("tp", "pred"), F.lit(0.0)).alias("precision"),
                      F.coalesce(F.try_divide("tp", "p"), F.lit(0.0)).alias("recall"))


def pr_auc(curve: DataFrame) -> DataFrame:
    """EVL-13: trapezoid area under the precision-recall points of ``pr_curve`` (one row per threshold)."""
    w = Window.orderBy("recall", "precision", "threshold")
    area = (F.col("recall") - F.lag("recall").over(w)) * (F.col("precision") + F.lag("precision").over(w)) / 2
    return curve.withColumn("_a", area).agg(F.sum("_a").alias("pr_auc"))


def operating_point(scored: DataFrame, op: float = 0.5, score: str = "score", y: str = "y") -> DataFrame:
    """EVL-13: precision, recall and F1 at one threshold."""
    pred, pos = F.col(score) >= op, F.col(y) == 1
    c = scored.agg(F.count_if(pred & pos).alias("tp"), F.count_if(pred & ~pos).alias("fp"), F.count_if(~pred & pos).alias("fn"))
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return c.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def calibration(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """EVL-14: reliability bins; a probability of exactly one falls outside the half-open bins."""
    b = F.floor(F.col(p) * bins)
    return df.where((F.col(p) >= 0) & (F.col(p) < 1)).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("accuracy"), F.avg(p).alias("confidence"))


def calibration_summary(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """EVL-14: expected calibration error and Brier score."""
    rel = calibration(df, y, p, bins)
    ece = rel.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))
    return df.agg(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier")).withColumn("ece", ece.scalar())


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """EVL-15: Wilson interval of a proportion."""
    denom = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / denom
    half = z / denom * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(0.0))


def best_ranks(matched: DataFrame) -> DataFrame:
    """EVL-16: histogram of best ranks per scenario; misses are 999."""
    return matched.groupBy("scenario_label", "best_rank").agg(F.count(F.lit(1)).alias("n"))


def scenario_of(windows: DataFrame, gt: DataFrame) -> DataFrame:
    """EVL-17: scenario of each window by largest IoU, 'unknown' without overlap."""
    best = overlapping(windows, gt).groupBy("window_key").agg(F.max_by("scenario_label", F.struct("iou", -F.col("g_start"))).alias("scenario"))
    return windows.select("log_id", "window_key").join(best, "window_key", "left").withColumn("scenario", F.coalesce("scenario", F.lit("unknown")))


def coverage(matched: DataFrame, preds: DataFrame) -> DataFrame:
    """EVL-17: considered and total ground-truth rows per scenario."""
    has = preds.select(F.col("window_key").alias("used_window")).distinct().withColumn("_p", F.lit(1))
    return matched.join(has, "used_window", "left").groupBy("scenario_label").agg(F.count(F.lit(1)).alias("total"), F.count("_p").alias("considered"))


def micro_at_k(ranked: DataFrame, gt: DataFrame, k: int = 3) -> DataFrame:
    """EVL-18: micro precision and recall at k over windows that rank at least one true actor."""
    rows = ranked.join(gt.select("window_key", "track_uuid").distinct().withColumn("_g", F.lit(1)), ["window_key", "track_uuid"], "left")
    per = rows.groupBy("window_key").agg(F.count("_g").alias("present"), F.count_if((F.col("rank") <= k) & (F.col("_g") == 1)).alias("hits")).where("present > 0")
    return per.agg(F.count(F.lit(1)).alias("windows"), (F.sum("hits") / (k * F.count(F.lit(1)))).alias("precision"), (F.sum("hits") / F.sum("present")).alias("recall"))


def metric_tables(**parts: DataFrame) -> DataFrame:
    """EVL-19: one (section, metric, value) table from one-row metric frames."""
    out = None
    for section, df in parts.items():
        t = tall(df).select(F.lit(section).alias("section"), "metric", "value")
        out = t if out is None else out.unionByName(t)
    return out
