"""Constrained top-k retrieval over the scenario trace and its evaluation (RET-*).

The trace has one row per (split, backend, window) with ``id``, ``embedding``, labels and scores.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadsift.operators.inverted import approx_topk  # noqa: F401
from roadsift.operators.similarity import cosine_topk

# Filter names of the query specification with the trace column and comparison they stand for.
FILTERS = {"llm_label": ("llm_label_canonical", "eq"), "llm_label_raw": ("llm_label_raw", "eq"), "llm_conf_min": ("llm_confidence", "ge"),
           "llm_conf_max": ("llm_confidence", "le"), "gt_label": ("gt_label_canonical", "eq"), "gt_label_raw": ("gt_label_raw", "eq"),
           "road_type_hint": ("road_type_hint", "eq"), "near_crosswalk": ("near_crosswalk", "eq"), "near_stopline": ("near_stopline", "eq"),
           "has_close_actor": ("has_close_actor", "eq"), "primary_side": ("primary_side", "eq"), "s1_score_min": ("score_final", "ge"),
           "s1_score_max": ("score_final", "le")}
# Published evidence weights.
EVIDENCE_FLAGS = {"near_crosswalk": 0.7, "near_stopline": 0.7, "has_close_actor": 0.4}
EVIDENCE_NUMBERS = {"num_ped_near_crosswalk": 0.6, "num_vru_near_crosswalk": 0.5, "episode_score_final": 0.4, "peak_decel_mps2": 0.2,
                    "gat_top1_score": 0.5}


def query_vectors(trace: DataFrame, ids: DataFrame, dim: int) -> DataFrame:
    """RET-01: stored vectors of example rows as queries; another dimension is an error."""
    q = ids.select("id").join(trace.select("id", "embedding"), "id").select(F.col("id").alias("query_id"), "embedding")
    bad = F.size("embedding") != dim
    return q.withColumn("embedding", F.when(bad, F.raise_error(F.format_string("vector of %d instead of %d values", F.size("embedding"), F.lit(dim)))
                                            .cast(q.schema["embedding"].dataType)).otherwise(F.col("embedding")))


def text_vectors(texts: DataFrame, fn: Callable[[list[str]], list[list[float]]], dim: int) -> DataFrame:
    """RET-01: query vectors of texts through a pluggable batch embedder."""
    kind = texts.schema["query_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            vectors = fn(pdf["text"].tolist())
            if any(len(v) != dim for v in vectors):
                raise ValueError(f"embedder returned vectors of another size than {dim}")
            yield pd.DataFrame({"query_id": pdf["query_id"], "embedding": vectors})
    return texts.select("query_id", "text").mapInPandas(run, f"query_id {kind}, embedding array<double>")


def scope(trace: DataFrame, backend_id: int | None = None, prompt: str | None = None, backend_dir: str | None = None, everything: bool = False) -> DataFrame:
    """RET-02: backend scope: everything, or the given id / prompt / directory, backend 1 by default."""
    if everything:
        return trace
    keep = F.lit(True)
    if prompt is not None:
        keep = keep & (F.col("prompt_type") == prompt)
    if backend_dir is not None:
        keep = keep & (F.col("backend_dir") == backend_dir)
    if backend_id is not None or (prompt is None and backend_dir is None):
        keep = keep & (F.col("backend_id") == (1 if backend_id is None else backend_id))
    return trace.where(keep)


def scope_ids(trace: DataFrame) -> DataFrame:
    """RET-24: backend ids of a scope."""
    return trace.select("backend_id").distinct()


def apply_filters(trace: DataFrame, spec: dict) -> DataFrame:
    """RET-03: constraint filters, each only where its column exists."""
    ops = {"eq": lambda c, v: c == v, "ge": lambda c, v: c >= v, "le": lambda c, v: c <= v}
    out = trace
    for name, value in spec.items():
        if name == "gt_present" and "gt_label_canonical" in trace.columns and value is not None:
            out = out.where(F.col("gt_label_canonical").isNotNull() == bool(value))
        elif name in FILTERS and FILTERS[name][0] in trace.columns and value is not None:
            out = out.where(ops[FILTERS[name][1]](F.col(FILTERS[name][0]), value))
    return out


def with_trace(ranked: DataFrame, trace: DataFrame) -> DataFrame:
    """Ranked ids with their trace columns; the ranked side is k rows per query."""
    return ranked.join(trace.drop("embedding"), "id")


def _rerank(df: DataFrame, score: Column) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("final_score").desc(), "id")
    return df.withColumn("final_score", score).withColumn("rank", F.row_number().over(w))


def rerank_linear(ranked: DataFrame, alpha: float = 1.0, beta: float = 0.1, gamma: float = 0.1) -> DataFrame:
    """RET-06: alpha * similarity + beta * confidence + gamma * verifier score, with the three parts."""
    parts = {"part_sim": alpha * F.col("similarity"), "part_conf": beta * F.coalesce("llm_confidence", F.lit(0.0)),
             "part_s1": gamma * F.coalesce("score_final", F.lit(0.0))}
    df = ranked.withColumns(parts)
    return _rerank(df, F.col("part_sim") + F.col("part_conf") + F.col("part_s1"))


def rerank_evidence(ranked: DataFrame, w_evidence: float = 0.25, flags: dict = EVIDENCE_FLAGS, numbers: dict = EVIDENCE_NUMBERS) -> DataFrame:
    """RET-07: similarity plus weighted evidence; numbers are scaled between the 5th and 95th percentile of a query's candidates.

    The candidates of a query are an oversampled top-k, so their percentiles come from a bounded list.
    """
    have_n = {c: w for c, w in numbers.items() if c in ranked.columns}
    bounds = ranked.groupBy("query_id").agg(*[F.percentile(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.array(F.lit(0.05), F.lit(0.95))).alias(f"_b_{c}") for c in have_n])
    df, score = ranked.join(bounds, "query_id"), F.lit(0.0)
    for c, w in flags.items():
        if c in ranked.columns:
            score = score + w * F.coalesce(F.col(c), F.lit(False)).cast("double")
    for c, w in have_n.items():
        lo, hi = F.col(f"_b_{c}")[0], F.col(f"_b_{c}")[1]
        unit = F.when(hi > lo, F.least(F.greatest((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        score = score + w * unit
    df = df.withColumn("evidence_score", score).drop(*[f"_b_{c}" for c in have_n])
    return _rerank(df, F.col("similarity") + w_evidence * F.col("evidence_score"))


def top1_score(rankings: str = "gat_top3") -> Column:
    """RET-07: score of rank 1 in a nested ranking array, else of its first entry, else 0."""
    a = F.col(rankings)
    return F.coalesce(F.get(F.filter(a, lambda x: x["rank"] == 1), F.lit(0))["score"], F.get(a, F.lit(0))["score"], F.lit(0.0))


def dedup(ranked: DataFrame, by: str | None = "log_id", score: str = "final_score") -> DataFrame:
    """RET-08: best row per query and key, ranked again; ``None`` keeps all."""
    out = ranked
    if by is not None:
        w = Window.partitionBy("query_id", by).orderBy(F.col(score).desc(), "id")
        out = out.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    w = Window.partitionBy("query_id").orderBy(F.col(score).desc(), "id")
    return out.withColumn("rank", F.row_number().over(w))


def oversample_topk(corpus: DataFrame, queries: DataFrame, k: int = 10, factor: int = 3, by: str | None = "log_id", **kw) -> DataFrame:
    """RET-09: ``k * factor`` candidates, deduplicated, then the best ``k``."""
    wide = with_trace(cosine_topk(corpus, queries, k * factor, **kw), corpus).withColumn("final_score", F.col("similarity"))
    return dedup(wide, by).where(F.col("rank") <= k)


def candidate_pool(trace: DataFrame, gt_only: bool = False, exclude_logs: DataFrame | None = None) -> DataFrame:
    """RET-10: only rows with ground truth and / or without the given logs."""
    out = trace.where("gt_label_canonical IS NOT NULL") if gt_only else trace
    return out.join(exclude_logs.select("log_id").distinct(), "log_id", "left_anti") if exclude_logs is not None else out


def corpus_by_map(trace: DataFrame, mapping: dict[str, int]) -> DataFrame:
    """RET-11: for each split the rows of its chosen backend."""
    m = trace.sparkSession.createDataFrame(list(mapping.items()), "split_name string, backend_id bigint")
    return trace.join(F.broadcast(m), ["split_name", "backend_id"], "left_semi")  # one row per split


def gt_support(trace: DataFrame, labels: DataFrame) -> DataFrame:
    """RET-12: windows with each ground-truth label, zero included."""
    n = trace.where("gt_label_canonical IS NOT NULL").groupBy(F.col("gt_label_canonical").alias("label")).agg(F.count_distinct("window_key").alias("n_gt"))
    return labels.select("label").distinct().join(n, "label", "left").na.fill({"n_gt": 0})


def precision_coverage(ranked: DataFrame, support: DataFrame, ks: Sequence[int] = (5, 10), fair: bool = True) -> DataFrame:
    """RET-13: per query and k precision, coverage, recall and F1 of the ground-truth label ``q_label``.

    ``fair`` divides by the rows within min(k, n_gt); otherwise by k, missing rows counting as wrong.
    """
    df = ranked.join(support.withColumnRenamed("label", "q_label"), "q_label")
    hit = F.col("gt_label_canonical") == F.col("q_label")
    kx = df.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    eff = F.when((F.col("n_gt") > 0) & F.lit(fair), F.least("k", "n_gt")).otherwise(F.col("k"))
    m = kx.withColumn("_eff", eff).groupBy("query_id", "q_label", "n_gt", "k").agg(
        F.count_if(hit & (F.col("rank") <= F.col("_eff"))).alias("_he"), F.count_if(F.col("rank") <= F.col("_eff")).alias("_ne"),
        F.count_if(hit & (F.col("rank") <= F.col("k"))).alias("hits"))
    p = F.coalesce(F.try_divide("_he", "_ne"), F.lit(0.0)) if fair else F.col("hits") / F.col("k")
    out = m.withColumn("precision", p).withColumn("coverage", F.try_divide("hits", "n_gt"))
    r = F.coalesce("coverage", F.lit(0.0))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * r, F.col("precision") + r), F.lit(0.0))).drop("_he", "_ne")


def best_mean_worst(metrics: DataFrame) -> DataFrame:
    """RET-14: best, mean and worst over the queries of a label."""
    aggs = [fn(c).alias(f"{c}_{name}") for c in ("precision", "coverage") for name, fn in (("best", F.max), ("mean", F.avg), ("worst", F.min))]
    return metrics.groupBy(F.col("q_label").alias("label"), "k", "n_gt").agg(*aggs)


def macro_micro(per_label: DataFrame, least: int = 2) -> DataFrame:
    """RET-15: macro and support-weighted means over labels with enough ground truth."""
    w = F.greatest(F.col("n_gt"), F.lit(1))
    return per_label.where(F.col("n_gt") >= least).groupBy("k").agg(
        F.avg("precision_mean").alias("macro_precision"), F.avg("coverage_mean").alias("macro_coverage"),
        (F.sum(F.col("precision_mean") * w) / F.sum(w)).alias("micro_precision"),
        (F.sum(F.col("coverage_mean") * w) / F.sum(w)).alias("micro_coverage"), F.count(F.lit(1)).alias("labels"))


def rrf(ranked: DataFrame, k: int = 10, constant: int = 60) -> DataFrame:
    """RET-16: reciprocal-rank fusion over the queries of a label; the fused list is one query per label."""
    fused = ranked.groupBy("q_label", "id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("final_score"))
    w = Window.partitionBy("q_label").orderBy(F.col("final_score").desc(), "id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("query_id", F.col("q_label"))


def _consensus(conf: float, s1: float, gat: float) -> Column:
    return (F.col("llm_confidence") >= conf) & (F.col("score_final") >= s1) & (F.col("gat_top1_score") >= gat)


def discovery(ranked: DataFrame, conf: float = 0.85, s1: float = 0.5, gat: float = 0.0) -> DataFrame:
    """RET-17: dominant predicted label (alphabetical on ties), its share, new and confident new windows per query."""
    lab = ranked.withColumn("_l", F.coalesce("llm_label_canonical", F.lit("unlabeled")))
    dom = lab.groupBy("query_id", "_l").agg(F.count(F.lit(1)).alias("n")).groupBy("query_id").agg(
        F.min_by(F.struct("_l", "n"), F.struct(-F.col("n"), "_l")).alias("d"), F.sum("n").alias("_all"))
    new = F.col("gt_label_canonical").isNull()
    counts = lab.groupBy("query_id").agg(F.count_if(new).alias("new_windows"), F.count_if(new & _consensus(conf, s1, gat)).alias("high_conf_new"))
    return dom.join(counts, "query_id").select("query_id", F.col("d._l").alias("dominant_label"), (F.col("d.n") / F.col("_all")).alias("consistency"), "new_windows", "high_conf_new")


def confused_with(ranked: DataFrame, n: int = 5) -> DataFrame:
    """RET-18: the other ground-truth labels most often retrieved for a query label."""
    c = ranked.where("gt_label_canonical IS NOT NULL AND gt_label_canonical <> q_label").groupBy(
        F.col("q_label").alias("label"), F.col("gt_label_canonical").alias("confused_with")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label").orderBy(F.col("n").desc(), "confused_with")
    return c.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def hit_rates(ranked: DataFrame, ks: Sequence[int] = (5, 10), conf: float = 0.85, s1: float = 0.5, gat: float = 0.0) -> DataFrame:
    """RET-19: ground-truth, predicted-label and consensus hit rates per query and k."""
    kx = ranked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank <= k")
    llm = F.col("llm_label_canonical") == F.col("q_label")
    return kx.groupBy("query_id", "q_label", "k").agg(
        (F.count_if(F.col("gt_label_canonical") == F.col("q_label")) / F.first("k")).alias("gt_rate"), (F.count_if(llm) / F.first("k")).alias("llm_rate"),
        (F.count_if(llm & _consensus(conf, s1, gat)) / F.first("k")).alias("consensus_rate"), F.count_if(F.col("gt_label_canonical").isNull()).alias("new_windows"))


def gt_constrained(trace: DataFrame, queries: DataFrame, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """RET-20: metrics when only windows with ground truth can be retrieved: an upper bound."""
    return evaluate_queries(candidate_pool(trace, gt_only=True), queries, ks)


def evaluate_queries(trace: DataFrame, queries: DataFrame, ks: Sequence[int] = (5, 10), factor: int = 3, by: str | None = "log_id", fair: bool = True) -> DataFrame:
    """RET-23: metrics of many queries at once: one similarity scan of the corpus serves all of them.

    ``queries`` has query_id, q_label and the vector.
    """
    ranked = oversample_topk(trace, queries, max(ks), factor, by).join(queries.select("query_id", "q_label"), "query_id")
    support = gt_support(trace, queries.select(F.col("q_label").alias("label")))
    return precision_coverage(ranked, support, ks, fair)


def class_counts(df: DataFrame, by: Sequence[str], truth: str, pred: str) -> DataFrame:
    """tp / fp / fn / support per label seen in the truth, from one aggregate over (truth, prediction) cells."""
    cells = df.where(F.col(truth).isNotNull()).groupBy(*by, F.col(truth).alias("_t"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    # a cell says something about its true label and, when different, about its predicted one
    same = F.coalesce(F.col("_t") == F.col("_p"), F.lit(False))
    sides = F.array(F.struct(F.col("_t").alias("label"), F.when(same, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("fp"),
                             F.when(same, 0).otherwise(F.col("n")).alias("fn"), F.col("n").alias("support")),
                    F.struct(F.when(~same, F.col("_p")).alias("label"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("fp"), F.lit(0).cast("bigint").alias("fn"), F.lit(0).cast("bigint").alias("support")))
    return cells.select(*by, F.inline(sides)).where("label IS NOT NULL").groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")])


def with_prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 per label; undefined values are null."""
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    df = counts.withColumns({"precision": p, "recall": r})
    return df.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def rank_backends(trace: DataFrame) -> DataFrame:
    """RET-21: accuracy, macro precision / recall / F1, weighted F1 and coverage per split and backend, the best of each split flagged."""
    by = ["split_name", "backend_id"]
    lab = with_prf(class_counts(trace, by, "gt_label_canonical", "llm_label_canonical")).where("support > 0")
    w = F.when(F.col("f1").isNotNull(), F.col("support"))
    agg = lab.groupBy(*by).agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
                               F.avg("f1").alias("macro_f1"), F.try_divide(F.sum(F.col("f1") * w), F.sum(w)).alias("weighted_f1"))
    cov = trace.groupBy(*by).agg(F.count("gt_label_canonical").alias("n_gt_rows"), F.avg(F.col("llm_label_canonical").isNotNull().cast("double")).alias("coverage"))
    out = agg.join(cov, by)
    win = out.groupBy("split_name").agg(F.max_by("backend_id", F.struct("macro_f1", "accuracy", -F.col("backend_id"))).alias("_best"))
    return out.join(win, "split_name").withColumn("winner", F.col("backend_id") == F.col("_best")).drop("_best")


def label_points(trace: DataFrame) -> DataFrame:
    """RET-22: final label of each embedded window with its provenance: ground truth, prediction or none."""
    gt, llm = F.col("gt_label_canonical"), F.col("llm_label_canonical")
    return trace.select("id", "window_key", F.coalesce(gt, llm, F.lit("unlabeled")).alias("label"),
                        F.when(gt.isNotNull(), "gt").when(llm.isNotNull(), "llm").otherwise("unlabeled").alias("provenance"))
