"""EVL-*: evaluation of the braking windows of the events against shifted ground truth."""

from pyspark.sql import functions as F

from roadsift.functions.intervals import interval_iou
from roadsift.operators import evaluation as V
from roadsift.plans.fixtures import GT, braking_windows, gt_windows
from roadsift.plans.q_pu import PU, pu
from roadsift.plans.registry import query

# ground truth of every second log is moved far away, so that all matching rules occur
BASE = GT + """, gg AS (SELECT log_id, g_start + s AS g_start, g_end + s AS g_end, scenario_label FROM (SELECT *, CASE WHEN CAST(log_id AS INT) % 2 = 0 THEN 10e0 ELSE 0e0 END AS s FROM gt)),
wn AS (SELECT log_id, window_key, t_start, t_end, 0.5 * (t_start + t_end) AS centre, i_start, least(-a_min_ms2 / 5000, 1.0) AS score FROM windows),
preds AS (SELECT window_key, r AS rank, 't' || ((i_start + r) % 5) AS track_uuid, 1e0 / r + (i_start % 7) / 100e0 AS score FROM wn, range(1, 4) AS x(r) WHERE i_start % 11 <> 0),
tg AS (SELECT CAST(c_custkey AS VARCHAR) AS log_id, 't' || (c_custkey % 5) AS track_uuid FROM customer WHERE c_custkey % 6 <> 0),
teach AS (SELECT window_key, 't' || ((i_start + r * 2) % 5) AS track_uuid, 1e0 / (1 + r) AS q FROM wn, range(0, 5) AS x(r)),
hits AS (SELECT log_id, window_key, centre, min(rank) AS rank, max(p.score) AS score FROM preds AS p JOIN wn USING (window_key) JOIN tg USING (log_id, track_uuid) GROUP BY ALL),
gi AS (SELECT *, 0.5 * (g_start + g_end) AS gc FROM gg),
cn AS (SELECT gi.*, w.window_key, w.centre, h.rank, h.score AS hs, greatest(0, least(g_end, t_end) - greatest(g_start, t_start)) AS inter, t_start, t_end FROM gi JOIN wn AS w USING (log_id) LEFT JOIN hits AS h ON h.window_key = w.window_key),
cr AS (SELECT *, abs(centre - gc) AS dt, inter / ((g_end - g_start) + (t_end - t_start) - inter) AS iou, CASE WHEN rank IS NOT NULL AND abs(centre - gc) <= 3 THEN 0 WHEN rank IS NOT NULL THEN 1 ELSE 2 END AS cls FROM cn),
pk AS (SELECT *, row_number() OVER (PARTITION BY log_id, g_start, g_end ORDER BY cls, CASE WHEN cls < 2 THEN rank END, CASE WHEN cls < 2 THEN -hs END, CASE WHEN cls < 2 THEN dt END, -iou, centre, window_key) AS k FROM cr),
matched AS (SELECT log_id, g_start, g_end, scenario_label, window_key AS used_window, CASE WHEN cls < 2 THEN rank ELSE 999 END AS best_rank,
  CASE cls WHEN 0 THEN 'chose_near_with_gt' WHEN 1 THEN 'chose_any_with_gt' ELSE 'fallback_max_iou_no_gt' END AS status FROM pk WHERE k = 1),
ov AS (SELECT * FROM cr WHERE iou > 0)"""
EVAL = BASE + """, us AS (SELECT * FROM matched WHERE used_window IN (SELECT window_key FROM preds)),
pr AS (SELECT u.log_id, u.g_start, u.g_end, avg(CASE WHEN f.score > p.score THEN 1.0 ELSE 0.0 END) AS pairwise FROM us AS u JOIN preds AS f ON f.window_key = u.used_window AND f.rank = u.best_rank
  JOIN preds AS p ON p.window_key = u.used_window LEFT JOIN tg ON tg.log_id = u.log_id AND tg.track_uuid = p.track_uuid WHERE tg.log_id IS NULL GROUP BY ALL),
cons AS (SELECT u.*, CASE WHEN best_rank = 1 THEN 1.0 ELSE 0.0 END AS top1, CASE WHEN best_rank <= 3 THEN 1.0 ELSE 0.0 END AS recall, CASE WHEN best_rank < 999 THEN 1.0 / best_rank ELSE 0.0 END AS mrr, coalesce(pairwise, 0.0) AS pairwise
  FROM us AS u LEFT JOIN pr USING (log_id, g_start, g_end))"""
RANK_SQL = ("count(*) AS considered, avg(top1) AS hit_at_1, avg(recall) AS recall_at_k, coalesce(avg(CASE WHEN best_rank < 999 THEN best_rank END), 0) AS mean_best_rank, avg(mrr) AS mrr, avg(pairwise) AS pairwise_acc")
RANK_SPEC = "considered:n hit_at_1:d recall_at_k:d mean_best_rank:d mrr:d pairwise_acc:d"


def wins(t):
    return braking_windows(t).withColumn("score", F.least(-F.col("a_min_ms2") / 5000, F.lit(1.0)))


def gt(t):
    s = F.when(F.col("log_id").cast("int") % 2 == 0, 10.0).otherwise(0.0)
    return gt_windows(t).select("log_id", (F.col("g_start") + s).alias("g_start"), (F.col("g_end") + s).alias("g_end"), "scenario_label")


def preds(t):
    r = wins(t).where("i_start % 11 <> 0").select("window_key", "i_start", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rank"))
    return r.select("window_key", "rank", F.concat(F.lit("t"), ((F.col("i_start") + F.col("rank")) % 5).cast("string")).alias("track_uuid"),
                    (F.lit(1.0) / F.col("rank") + F.col("i_start") % 7 / 100.0).alias("score"))


def tags(t):
    c = F.col("c_custkey")
    return t.customer.where("c_custkey % 6 <> 0").select(c.cast("string").alias("log_id"), F.concat(F.lit("t"), (c % 5).cast("string")).alias("track_uuid"))


def teach(t):
    r = wins(t).select("window_key", "i_start", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r"))
    return r.select("window_key", F.concat(F.lit("t"), ((F.col("i_start") + F.col("r") * 2) % 5).cast("string")).alias("track_uuid"), (1.0 / (1 + F.col("r"))).alias("q"))


def matched(t):
    return V.match_gt(gt(t), wins(t), preds(t), tags(t))


G = "log_id:s g_start:d g_end:d"


@query("evl_01_interval_iou", G + " window_key:s iou:d hull:d", f"WITH {BASE} SELECT *, inter / (greatest(g_end, t_end) - least(g_start, t_start)) AS hull FROM ov")
def evl_01(t):
    return V.overlapping(wins(t), gt(t)).withColumn("hull", interval_iou(F.col("g_start"), F.col("g_end"), F.col("t_start"), F.col("t_end"), "hull"))


def _ndcg_sql(value):
    return (f"WITH {BASE}, r AS (SELECT p.window_key, score, coalesce(q, 0) AS g FROM preds AS p LEFT JOIN teach USING (window_key, track_uuid)), o AS (SELECT *, row_number() OVER (PARTITION BY window_key ORDER BY score DESC) AS a, "
            f"row_number() OVER (PARTITION BY window_key ORDER BY g DESC) AS b FROM r) SELECT window_key, CASE WHEN sum(CASE WHEN b <= 2 THEN {value} / log2(b + 1) END) > 0 THEN "
            f"sum(CASE WHEN a <= 2 THEN {value} / log2(a + 1) END) / sum(CASE WHEN b <= 2 THEN {value} / log2(b + 1) END) ELSE 0 END AS ndcg FROM o GROUP BY window_key")


def _gains(t):
    return preds(t).join(teach(t), ["window_key", "track_uuid"], "left").withColumn("gain", F.coalesce("q", F.lit(0.0)))


@query("evl_02_ndcg", "window_key:s ndcg:d", _ndcg_sql("g"))
def evl_02(t):
    return V.ndcg(_gains(t), 2)


@query("evl_02_ndcg_exponential", "window_key:s ndcg:d", _ndcg_sql("(pow(2, g) - 1)"))
def evl_02_exp(t):
    return V.ndcg(_gains(t), 2, "exponential")


@query("evl_03_match_gt", G + " used_window:s best_rank:n status:s", f"WITH {BASE} SELECT * FROM matched")
def evl_03(t):
    return matched(t)


@query("evl_04_rank_metrics", RANK_SPEC + " total:n", f"WITH {EVAL} SELECT {RANK_SQL}, (SELECT count(*) FROM matched) AS total FROM cons")
def evl_04(t):
    return V.rank_metrics(matched(t), preds(t), tags(t))


@query("evl_05_rank_metrics_by", "scenario_label:s " + RANK_SPEC, f"WITH {EVAL} SELECT scenario_label, {RANK_SQL} FROM cons GROUP BY scenario_label UNION ALL SELECT 'ALL', {RANK_SQL} FROM cons")
def evl_05(t):
    return V.rank_metrics_by(matched(t), preds(t), tags(t))


@query("evl_06_teacher_ndcg", "ndcg_all:d ndcg_gt:d ndcg_discovery:d", f"WITH nd AS ({_ndcg_sql('g').replace('<= 2', '<= 3')}), mt AS (WITH {BASE} SELECT DISTINCT used_window FROM matched), ok AS (WITH {BASE} SELECT DISTINCT p.window_key FROM preds AS p JOIN teach USING (window_key, track_uuid)) "
       "SELECT avg(ndcg) AS ndcg_all, avg(ndcg) FILTER (window_key IN (SELECT used_window FROM mt)) AS ndcg_gt, avg(ndcg) FILTER (window_key NOT IN (SELECT used_window FROM mt)) AS ndcg_discovery FROM nd WHERE window_key IN (SELECT window_key FROM ok)")
def evl_06(t):
    return V.teacher_ndcg(preds(t), teach(t), matched(t))


@query("evl_07_label_overlap", "window_key:s is_gt:b", f"WITH {BASE} SELECT window_key, window_key IN (SELECT window_key FROM ov) AS is_gt FROM wn")
def evl_07(t):
    return V.label_overlap(wins(t), gt(t))


@query("evl_08_discovery_stats", "is_gt:b n:n mean:d median:d", f"WITH {BASE}, l AS (SELECT *, window_key IN (SELECT window_key FROM ov) AS is_gt FROM wn) SELECT is_gt, count(*) AS n, avg(score) AS mean, quantile_cont(score, 0.5) AS median FROM l GROUP BY is_gt")
def evl_08(t):
    return V.discovery_stats(V.label_overlap(wins(t), gt(t)))


QUAL = BASE + """, q1 AS (SELECT *, row_number() OVER (PARTITION BY log_id, g_start, g_end ORDER BY iou > 0 DESC, dt, t_start) AS k2, count(*) FILTER (iou > 0) OVER (PARTITION BY log_id, g_start, g_end) AS frag FROM cr),
qual AS (SELECT log_id, g_start, g_end, scenario_label, centre - gc AS latency_s, iou, frag FROM q1 WHERE k2 = 1)"""


@query("evl_09_temporal_quality", G + " latency_s:d iou:d frag:n", f"WITH {QUAL} SELECT * FROM qual")
def evl_09(t):
    return V.temporal_quality(gt(t), wins(t))


@query("evl_09_temporal_summary", "metric:s value:d", f"WITH {QUAL} SELECT 'median_latency' AS metric, quantile_cont(latency_s, 0.5) AS value FROM qual UNION ALL SELECT 'median_iou', quantile_cont(iou, 0.5) FROM qual UNION ALL SELECT 'mean_fragmentation', avg(frag) FROM qual")
def evl_09_summary(t):
    return V.temporal_summary(V.temporal_quality(gt(t), wins(t)))


@query("evl_10_detection_recall", "scenario:s n_gt:n covered:n recall:d", f"WITH {BASE}, c AS (SELECT g.*, CASE WHEN EXISTS (SELECT 1 FROM ov WHERE ov.log_id = g.log_id AND ov.g_start = g.g_start AND ov.g_end = g.g_end) THEN 1 ELSE 0 END AS h FROM gg AS g) "
       "SELECT scenario_label AS scenario, count(*) AS n_gt, sum(h) AS covered, avg(h) AS recall FROM c GROUP BY 1 UNION ALL SELECT 'ALL', count(*), sum(h), avg(h) FROM c")
def evl_10(t):
    return V.detection_recall(gt(t), wins(t))


@query("evl_11_operational_counts", "total:n kept:n discarded:n", f"WITH {BASE} SELECT count(*) AS total, count(*) FILTER (score >= 0.5) AS kept, count(*) FILTER (score < 0.5) AS discarded FROM wn")
def evl_11(t):
    return V.operational_counts(wins(t), wins(t).where("score >= 0.5"))


@query("evl_12_catalogs", "log_id:s total:n gt:n new_discovery:n discarded:n", f"WITH {BASE}, l AS (SELECT *, window_key IN (SELECT window_key FROM ov) AS is_gt FROM wn) SELECT log_id, count(*) AS total, count(*) FILTER (is_gt) AS gt, "
       "count(*) FILTER (NOT is_gt) AS new_discovery, count(*) FILTER (score < 0.5) AS discarded FROM l GROUP BY log_id")
def evl_12(t):
    return V.catalogs(V.label_overlap(wins(t), gt(t)), wins(t).where("score >= 0.5"))


CURVE = PU + """, th AS (SELECT i, i * 5e-3 AS th FROM range(0, 201) AS r(i)), cv AS (SELECT th, count(*) FILTER (score >= th AND y = 1) AS tp, count(*) FILTER (score >= th) AS pd, count(*) FILTER (y = 1) AS p FROM pu, th GROUP BY th),
curve AS (SELECT th AS threshold, CASE WHEN pd > 0 THEN tp / pd ELSE 0 END AS precision, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS recall FROM cv)"""


@query("evl_13_pr_curve", "threshold:d precision:d recall:d", f"WITH {CURVE} SELECT * FROM curve")
def evl_13(t):
    return V.pr_curve(pu(t))


@query("evl_13_pr_auc", "pr_auc:d", f"WITH {CURVE} SELECT sum((recall - pr) * (precision + pp) / 2) AS pr_auc FROM (SELECT *, lag(recall) OVER w AS pr, lag(precision) OVER w AS pp FROM curve WINDOW w AS (ORDER BY recall, precision, threshold))")
def evl_13_auc(t):
    return V.pr_auc(V.pr_curve(pu(t)))


OP = "count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp, count(*) FILTER (score < 0.5 AND y = 1) AS fn"


@query("evl_13_operating_point", "tp:n fp:n fn:n precision:d recall:d f1:d", f"WITH {PU}, c AS (SELECT {OP} FROM pu) SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c")
def evl_13_op(t):
    return V.operating_point(pu(t))


BINS = PU + ", bins AS (SELECT floor(other * 10) AS bin, count(*) AS n, avg(y) AS accuracy, avg(other) AS confidence FROM pu WHERE other < 1 GROUP BY 1)"


@query("evl_14_calibration", "bin:n n:n accuracy:d confidence:d", f"WITH {BINS} SELECT * FROM bins")
def evl_14(t):
    return V.calibration(pu(t), "y", "other")


@query("evl_14_calibration_summary", "ece:d brier:d", f"WITH {BINS} SELECT sum(n * abs(accuracy - confidence)) / sum(n) AS ece, (SELECT avg(pow(other - y, 2)) FROM pu) AS brier FROM bins")
def evl_14_summary(t):
    return V.calibration_summary(pu(t), "y", "other")


@query("evl_15_wilson", "log_id:s lo:d hi:d", f"WITH {PU}, s AS (SELECT log_id, avg(y) AS p, count(*) * 1e0 AS n FROM pu GROUP BY log_id), c AS (SELECT *, 1 + 3.8416e0 / n AS dn FROM s) SELECT log_id, "
       "greatest(0.0, (p + 3.8416e0 / (2 * n)) / dn - 1.96e0 / dn * sqrt(p * (1 - p) / n + 3.8416e0 / (4 * n * n))) AS lo, least(1.0, (p + 3.8416e0 / (2 * n)) / dn + 1.96e0 / dn * sqrt(p * (1 - p) / n + 3.8416e0 / (4 * n * n))) AS hi FROM c")
def evl_15(t):
    s = pu(t).groupBy("log_id").agg(F.avg("y").alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    lo, hi = V.wilson(F.col("p"), F.col("n"))
    return s.select("log_id", lo.alias("lo"), hi.alias("hi"))


@query("evl_16_best_ranks", "scenario_label:s best_rank:n n:n", f"WITH {BASE} SELECT scenario_label, best_rank, count(*) AS n FROM matched GROUP BY ALL")
def evl_16(t):
    return V.best_ranks(matched(t))


@query("evl_17_scenario_of", "window_key:s scenario:s", f"WITH {BASE}, b AS (SELECT window_key, scenario_label, row_number() OVER (PARTITION BY window_key ORDER BY iou DESC, g_start) AS k FROM ov) SELECT wn.window_key, coalesce(b.scenario_label, 'unknown') AS scenario FROM wn LEFT JOIN b ON b.window_key = wn.window_key AND k = 1")
def evl_17(t):
    return V.scenario_of(wins(t), gt(t))


@query("evl_17_coverage", "scenario_label:s total:n considered:n", f"WITH {BASE} SELECT scenario_label, count(*) AS total, count(*) FILTER (used_window IN (SELECT window_key FROM preds)) AS considered FROM matched GROUP BY 1")
def evl_17_cov(t):
    return V.coverage(matched(t), preds(t))


@query("evl_18_micro_at_k", "windows:n precision:d recall:d", f"WITH {BASE}, m AS (SELECT p.window_key, count(tg.log_id) AS present, count(*) FILTER (rank <= 2 AND tg.log_id IS NOT NULL) AS hits FROM preds AS p JOIN wn USING (window_key) LEFT JOIN tg ON tg.log_id = wn.log_id AND tg.track_uuid = p.track_uuid GROUP BY 1 HAVING count(tg.log_id) > 0) "
       "SELECT count(*) AS windows, sum(hits) / (2 * count(*)) AS precision, sum(hits) / sum(present) AS recall FROM m")
def evl_18(t):
    truth = wins(t).select("log_id", "window_key").join(tags(t), "log_id")
    return V.micro_at_k(preds(t), truth, 2)


@query("evl_19_metric_tables", "section:s metric:s value:d", f"WITH {EVAL}, c AS (SELECT count(*) AS total, count(*) FILTER (score >= 0.5) AS kept, count(*) FILTER (score < 0.5) AS discarded FROM wn), r AS (SELECT avg(top1) AS hit_at_1, avg(mrr) AS mrr FROM cons) "
       "SELECT 'operational' AS section, 'total' AS metric, total::DOUBLE AS value FROM c UNION ALL SELECT 'operational', 'kept', kept FROM c UNION ALL SELECT 'operational', 'discarded', discarded FROM c UNION ALL SELECT 'ranking', 'hit_at_1', hit_at_1 FROM r UNION ALL SELECT 'ranking', 'mrr', mrr FROM r")
def evl_19(t):
    return V.metric_tables(operational=V.operational_counts(wins(t), wins(t).where("score >= 0.5")),
                           ranking=V.rank_metrics(matched(t), preds(t), tags(t)).select("hit_at_1", "mrr"))
