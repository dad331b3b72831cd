"""RET-*: retrieval over the embeddings table."""

from pyspark.sql import functions as F

from roadsift.operators import retrieval as Q
from roadsift.operators.inverted import approx_topk
from roadsift.operators.similarity import cosine_topk
from roadsift.plans.registry import query

TRACE = """tr AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, 'w' || vec_id AS window_key, 'log' || (vec_id % 25) AS log_id, vec_id % 4 AS backend_id,
    CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS split_name, 'p' || (vec_id % 2) AS prompt_type, 'd' || (vec_id % 4) AS backend_dir, CASE WHEN vec_id % 3 <> 0 THEN 'l' || label END AS gt_label_canonical,
    CASE WHEN vec_id % 13 <> 0 THEN 'l' || (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) END AS llm_label_canonical, (vec_id % 50) / 50e0 AS llm_confidence,
    (vec_id % 11) / 10e0 AS score_final, vec_id % 2 = 0 AS near_crosswalk, vec_id % 5 = 0 AS has_close_actor, vec_id % 4 AS num_ped_near_crosswalk, (vec_id % 9) / 9e0 AS gat_top1_score FROM embeddings),
qs AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qe, 'l' || label AS q_label FROM embeddings WHERE vec_id % 50 = 0),
sim AS (SELECT query_id, q_label, tr.* EXCLUDE (e), list_cosine_similarity(qe, e) AS similarity FROM qs, tr),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sim) WHERE rank <= 30),
ded AS (SELECT * EXCLUDE (rank, k2), row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, log_id ORDER BY similarity DESC, id) AS k2 FROM ranked) WHERE k2 = 1),
over10 AS (SELECT * FROM ded WHERE rank <= 10),
sup AS (SELECT l.label, count(DISTINCT tr.window_key) AS n_gt FROM (SELECT DISTINCT q_label AS label FROM qs) AS l LEFT JOIN tr ON tr.gt_label_canonical = l.label GROUP BY l.label)"""


def trace(t):
    v, lab = F.col("vec_id"), F.col("label")
    return t.embeddings.select(
        v.alias("id"), "embedding", F.concat(F.lit("w"), v.cast("string")).alias("window_key"), F.concat(F.lit("log"), (v % 25).cast("string")).alias("log_id"),
        (v % 4).alias("backend_id"), F.when(v % 2 == 0, "a").otherwise("b").alias("split_name"), F.concat(F.lit("p"), (v % 2).cast("string")).alias("prompt_type"),
        F.concat(F.lit("d"), (v % 4).cast("string")).alias("backend_dir"), F.when(v % 3 != 0, F.concat(F.lit("l"), lab.cast("string"))).alias("gt_label_canonical"),
        F.when(v % 13 != 0, F.concat(F.lit("l"), F.when(v % 7 == 0, (lab + 1) % 10).otherwise(lab).cast("string"))).alias("llm_label_canonical"),
        (v % 50 / 50.0).alias("llm_confidence"), (v % 11 / 10.0).alias("score_final"), (v % 2 == 0).alias("near_crosswalk"), (v % 5 == 0).alias("has_close_actor"),
        (v % 4).alias("num_ped_near_crosswalk"), (v % 9 / 9.0).alias("gat_top1_score"))


def queries_of(t):
    return t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.concat(F.lit("l"), F.col("label").cast("string")).alias("q_label"))


def ranked(t, k=30):
    q = queries_of(t)
    return Q.with_trace(cosine_topk(trace(t), q, k), trace(t)).join(q.select("query_id", "q_label"), "query_id")


def over10(t):
    q = queries_of(t)
    return Q.oversample_topk(trace(t), q, 10, 3).join(q.select("query_id", "q_label"), "query_id")


R = "query_id:n id:n rank:n"


@query("ret_01_query_vectors", "query_id:n first:d dim:n", "SELECT vec_id AS query_id, embedding[1] AS first, len(embedding) AS dim FROM embeddings WHERE vec_id % 50 = 0")
def ret_01(t):
    q = Q.query_vectors(trace(t), t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id")), 64)
    return q.select("query_id", F.get("embedding", F.lit(0)).alias("first"), F.size("embedding").alias("dim"))


@query("ret_01_text_vectors", "query_id:n a:d b:d", "SELECT item_id AS query_id, length(text) AS a, length(replace(text, ' ', '')) AS b FROM benchmark")
def ret_01_text(t):
    q = Q.text_vectors(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), lambda xs: [[float(len(x)), float(len(x.replace(" ", "")))] for x in xs], 2)
    return q.select("query_id", F.get("embedding", F.lit(0)).alias("a"), F.get("embedding", F.lit(1)).alias("b"))


@query("ret_02_scope", "id:n backend_id:n", f"WITH {TRACE} SELECT id, backend_id FROM tr WHERE prompt_type = 'p1' AND backend_dir = 'd3'")
def ret_02(t):
    return Q.scope(trace(t), prompt="p1", backend_dir="d3")


@query("ret_03_apply_filters", "id:n", f"WITH {TRACE} SELECT id FROM tr WHERE llm_confidence >= 0.4 AND score_final <= 0.8 AND near_crosswalk AND gt_label_canonical IS NOT NULL")
def ret_03(t):
    return Q.apply_filters(trace(t), {"llm_conf_min": 0.4, "s1_score_max": 0.8, "near_crosswalk": True, "gt_present": True, "primary_side": "left"})


@query("ret_04_cosine_topk", R + " similarity:d", f"WITH {TRACE} SELECT * FROM ranked WHERE rank <= 10")
def ret_04(t):
    return cosine_topk(trace(t), queries_of(t), 10)


@query("ret_05_approx_topk", R + " similarity:d")
def ret_05(t):
    return approx_topk(trace(t), queries_of(t), 10)


@query("ret_05_all_cells", R + " similarity:d", f"WITH {TRACE} SELECT * FROM ranked WHERE rank <= 10")
def ret_05_all(t):
    """With every cell probed the search is exact."""
    return approx_topk(trace(t), queries_of(t), 10, probes=1 << 20)


@query("ret_06_rerank_linear", R + " final_score:d part_sim:d part_conf:d part_s1:d",
       f"WITH {TRACE}, r AS (SELECT query_id, id, similarity AS part_sim, 0.1 * llm_confidence AS part_conf, 0.1 * score_final AS part_s1, similarity + 0.1 * llm_confidence + 0.1 * score_final AS final_score FROM ranked) "
       "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, id) AS rank FROM r")
def ret_06(t):
    return Q.rerank_linear(ranked(t))


def _unit(c):
    lo, hi = f"quantile_cont({c}::DOUBLE, 0.05) OVER q", f"quantile_cont({c}::DOUBLE, 0.95) OVER q"
    return f"CASE WHEN {hi} > {lo} THEN least(greatest(({c} - {lo}) / ({hi} - {lo}), 0), 1) ELSE 0 END"


@query("ret_07_rerank_evidence", R + " evidence_score:d final_score:d",
       f"WITH {TRACE}, e AS (SELECT query_id, id, similarity, 0.7 * near_crosswalk::INT + 0.4 * has_close_actor::INT + 0.6 * {_unit('num_ped_near_crosswalk')} + 0.5 * {_unit('gat_top1_score')} AS evidence_score FROM ranked WINDOW q AS (PARTITION BY query_id)) "
       "SELECT *, similarity + 0.25 * evidence_score AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY similarity + 0.25 * evidence_score DESC, id) AS rank FROM e")
def ret_07(t):
    return Q.rerank_evidence(ranked(t))


@query("ret_08_dedup", R + " log_id:s", f"WITH {TRACE} SELECT * FROM ded")
def ret_08(t):
    return Q.dedup(ranked(t).withColumn("final_score", F.col("similarity")), "log_id")


@query("ret_09_oversample_topk", R + " similarity:d", f"WITH {TRACE} SELECT * FROM over10")
def ret_09(t):
    return over10(t)


@query("ret_10_candidate_pool", "id:n", f"WITH {TRACE} SELECT id FROM tr WHERE gt_label_canonical IS NOT NULL AND log_id NOT IN (SELECT log_id FROM tr WHERE gt_label_canonical = 'l3' AND id % 10 = 1)")
def ret_10(t):
    tr = trace(t)
    return Q.candidate_pool(tr, True, tr.where("gt_label_canonical = 'l3' AND id % 10 = 1"))


@query("ret_11_corpus_by_map", "id:n", f"WITH {TRACE} SELECT id FROM tr WHERE (split_name = 'a' AND backend_id = 2) OR (split_name = 'b' AND backend_id = 1)")
def ret_11(t):
    return Q.corpus_by_map(trace(t), {"a": 2, "b": 1})


@query("ret_12_gt_support", "label:s n_gt:n", f"WITH {TRACE}, l AS (SELECT DISTINCT q_label AS label FROM qs UNION SELECT 'none') SELECT l.label, coalesce(n_gt, 0) AS n_gt FROM l LEFT JOIN sup USING (label)")
def ret_12(t):
    labels = queries_of(t).select(F.col("q_label").alias("label")).unionAll(t.spark.range(1).select(F.lit("none")))
    return Q.gt_support(trace(t), labels)


PC = TRACE + """, ks(k) AS (VALUES (5), (10)), pc0 AS (SELECT query_id, q_label, n_gt, k, count(*) FILTER (gt_label_canonical = q_label AND rank <= least(k, n_gt)) AS he, count(*) FILTER (rank <= least(k, n_gt)) AS ne,
    count(*) FILTER (gt_label_canonical = q_label AND rank <= k) AS hits FROM over10 JOIN sup ON label = q_label, ks GROUP BY ALL),
pc AS (SELECT *, CASE WHEN ne > 0 THEN he / ne ELSE 0 END AS precision, CASE WHEN n_gt > 0 THEN hits / n_gt END AS coverage FROM pc0),
bl AS (SELECT q_label AS label, k, n_gt, max(precision) AS precision_best, avg(precision) AS precision_mean, min(precision) AS precision_worst, max(coverage) AS coverage_best, avg(coverage) AS coverage_mean, min(coverage) AS coverage_worst FROM pc GROUP BY ALL)"""
PC_SPEC = "query_id:n q_label:s n_gt:n k:n hits:n precision:d coverage:d f1:d"
F1 = "CASE WHEN precision + coverage > 0 THEN 2 * precision * coverage / (precision + coverage) ELSE 0 END AS f1"


def metrics(t):
    return Q.precision_coverage(over10(t), Q.gt_support(trace(t), queries_of(t).select(F.col("q_label").alias("label"))))


@query("ret_13_precision_coverage", PC_SPEC, f"WITH {PC} SELECT *, {F1} FROM pc")
def ret_13(t):
    return metrics(t)


@query("ret_14_best_mean_worst", "label:s k:n n_gt:n precision_best:d precision_mean:d precision_worst:d coverage_best:d coverage_mean:d coverage_worst:d", f"WITH {PC} SELECT * FROM bl")
def ret_14(t):
    return Q.best_mean_worst(metrics(t))


@query("ret_15_macro_micro", "k:n macro_precision:d macro_coverage:d micro_precision:d micro_coverage:d labels:n",
       f"WITH {PC} SELECT k, avg(precision_mean) AS macro_precision, avg(coverage_mean) AS macro_coverage, sum(precision_mean * n_gt) / sum(n_gt) AS micro_precision, sum(coverage_mean * n_gt) / sum(n_gt) AS micro_coverage, count(*) AS labels FROM bl WHERE n_gt >= 2 GROUP BY k")
def ret_15(t):
    return Q.macro_micro(Q.best_mean_worst(metrics(t)))


@query("ret_16_rrf", "q_label:s id:n rank:n final_score:d", f"WITH {TRACE}, f AS (SELECT q_label, id, sum(1e0 / (60 + rank)) AS final_score FROM over10 GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_label ORDER BY final_score DESC, id) AS rank FROM f) WHERE rank <= 10")
def ret_16(t):
    return Q.rrf(over10(t))


@query("ret_17_discovery", "query_id:n dominant_label:s consistency:d new_windows:n high_conf_new:n",
       f"WITH {TRACE}, l AS (SELECT *, coalesce(llm_label_canonical, 'unlabeled') AS l FROM over10), c AS (SELECT query_id, l, count(*) AS n FROM l GROUP BY ALL), d AS (SELECT query_id, l, n, sum(n) OVER (PARTITION BY query_id) AS a, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, l) AS k FROM c), "
       "x AS (SELECT query_id, count(*) FILTER (gt_label_canonical IS NULL) AS new_windows, count(*) FILTER (gt_label_canonical IS NULL AND llm_confidence >= 0.5 AND score_final >= 0.3 AND gat_top1_score >= 0.1) AS high_conf_new FROM over10 GROUP BY query_id) "
       "SELECT d.query_id, l AS dominant_label, n / a AS consistency, new_windows, high_conf_new FROM d JOIN x USING (query_id) WHERE k = 1")
def ret_17(t):
    return Q.discovery(over10(t), 0.5, 0.3, 0.1)


@query("ret_18_confused_with", "label:s confused_with:s n:n", f"WITH {TRACE}, c AS (SELECT q_label AS label, gt_label_canonical AS confused_with, count(*) AS n FROM ded WHERE gt_label_canonical <> q_label GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, confused_with) AS k FROM c) WHERE k <= 2")
def ret_18(t):
    return Q.confused_with(Q.dedup(ranked(t).withColumn("final_score", F.col("similarity")), "log_id"), 2)


@query("ret_19_hit_rates", "query_id:n k:n gt_rate:d llm_rate:d consensus_rate:d new_windows:n",
       f"WITH {TRACE}, ks(k) AS (VALUES (5), (10)) SELECT query_id, k, count(*) FILTER (gt_label_canonical = q_label) / k AS gt_rate, count(*) FILTER (llm_label_canonical = q_label) / k AS llm_rate, "
       "count(*) FILTER (llm_label_canonical = q_label AND llm_confidence >= 0.3 AND score_final >= 0.2 AND gat_top1_score >= 0.1) / k AS consensus_rate, count(*) FILTER (gt_label_canonical IS NULL) AS new_windows FROM over10, ks WHERE rank <= k GROUP BY query_id, k")
def ret_19(t):
    return Q.hit_rates(over10(t), (5, 10), 0.3, 0.2, 0.1)


@query("ret_20_gt_constrained", PC_SPEC, "WITH " + PC.replace("list_cosine_similarity(qe, e) AS similarity FROM qs, tr)", "list_cosine_similarity(qe, e) AS similarity FROM qs, tr WHERE gt_label_canonical IS NOT NULL)") + f" SELECT *, {F1} FROM pc")
def ret_20(t):
    return Q.gt_constrained(trace(t), queries_of(t))


@query("ret_21_rank_backends", "split_name:s backend_id:n accuracy:d macro_precision:d macro_recall:d macro_f1:d weighted_f1:d n_gt_rows:n coverage:d winner:b", f"""WITH {TRACE}, g AS (SELECT * FROM tr WHERE gt_label_canonical IS NOT NULL),
  l AS (SELECT DISTINCT split_name, backend_id, gt_label_canonical AS label FROM g), c AS (SELECT l.*, (SELECT count(*) FROM g WHERE g.split_name = l.split_name AND g.backend_id = l.backend_id AND gt_label_canonical = label AND llm_label_canonical = label) AS tp,
    (SELECT count(*) FROM g WHERE g.split_name = l.split_name AND g.backend_id = l.backend_id AND gt_label_canonical <> label AND llm_label_canonical = label) AS fp,
    (SELECT count(*) FROM g WHERE g.split_name = l.split_name AND g.backend_id = l.backend_id AND gt_label_canonical = label) AS support FROM l),
  p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS pr, tp / support AS rc, CASE WHEN tp > 0 THEN 2 * tp / (tp + fp + support) END AS f1 FROM c),
  a AS (SELECT split_name, backend_id, sum(tp) / sum(support) AS accuracy, avg(pr) AS macro_precision, avg(rc) AS macro_recall, avg(f1) AS macro_f1, sum(f1 * support) / sum(CASE WHEN f1 IS NOT NULL THEN support END) AS weighted_f1 FROM p GROUP BY ALL),
  v AS (SELECT split_name, backend_id, count(gt_label_canonical) AS n_gt_rows, avg(CASE WHEN llm_label_canonical IS NULL THEN 0.0 ELSE 1.0 END) AS coverage FROM tr GROUP BY ALL)
  SELECT a.*, n_gt_rows, coverage, row_number() OVER (PARTITION BY a.split_name ORDER BY macro_f1 DESC, accuracy DESC, a.backend_id) = 1 AS winner FROM a JOIN v USING (split_name, backend_id)""")
def ret_21(t):
    return Q.rank_backends(trace(t))


@query("ret_22_label_points", "id:n label:s provenance:s", f"WITH {TRACE} SELECT id, coalesce(gt_label_canonical, llm_label_canonical, 'unlabeled') AS label, CASE WHEN gt_label_canonical IS NOT NULL THEN 'gt' WHEN llm_label_canonical IS NOT NULL THEN 'llm' ELSE 'unlabeled' END AS provenance FROM tr")
def ret_22(t):
    return Q.label_points(trace(t))


@query("ret_23_evaluate_queries", PC_SPEC, f"WITH {PC}, u AS (SELECT query_id, q_label, n_gt, k, hits, hits / k AS precision, coverage FROM pc) SELECT *, {F1} FROM u")
def ret_23(t):
    return Q.evaluate_queries(trace(t), queries_of(t), fair=False)


@query("ret_24_scope_ids", "backend_id:n", f"WITH {TRACE} SELECT DISTINCT backend_id FROM tr WHERE prompt_type = 'p0'")
def ret_24(t):
    return Q.scope_ids(Q.scope(trace(t), prompt="p0"))
