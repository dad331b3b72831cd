"""Multi-backend evaluation of predicted scenario labels (S6-*).

``trace`` has backend_id, model_name, prompt_type, window_key, gt_label, llm_label, llm_confidence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadsift.operators.retrieval import class_counts

# Labels and aliases of the published configuration, and words that mean "no label".
CANONICAL = ["approach_stop", "cut_in", "lead_brake", "obj_crossing", "ped_crossing"]
ALIASES = {"right_ped": "ped_crossing", "traffic_sign": "approach_stop"}
NULL_WORDS = ["", "none", "null", "nan"]
CONF_EDGES = (0.0, 0.5, 0.7, 0.8, 0.9, 1.01)
CONF_THRESHOLDS = (0.7, 0.8, 0.9)


def norm_label(c: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """S6-01: lower case, underscores, null words and aliases."""
    s = F.lower(F.trim(c))
    s = F.when(~s.isin(NULL_WORDS), F.translate(s, " -", "__"))
    if not aliases:
        return s
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, s), s)


def entropy(counts: Column) -> Column:
    """S6-11: entropy in nats of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return -F.aggregate(counts, F.lit(0.0), lambda a, x: a + (x / total) * F.ln(x / total + 1e-12))


def folded(c: Column, labels: Sequence[str]) -> Column:
    return F.when(c.isin(*labels), c).otherwise("other")


def _label_stats(df: DataFrame, labels: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Counts of every label, "other" included, for each group; labels outside the list are "other"."""
    rows = df.select(*by, folded(F.coalesce("_t", F.lit("other")), labels).alias("_ft"), folded(F.coalesce("_p", F.lit("other")), labels).alias("_fp"))
    counts = class_counts(rows, by, "_ft", "_fp")
    grid = rows.select(*by).distinct().withColumn("label", F.explode(F.array(*[F.lit(x) for x in [*labels, "other"]])))
    out = grid.join(counts, [*by, "label"], "left").na.fill(0, ["tp", "fp", "fn", "support"])
    zero = F.lit(0.0)
    return out.withColumns({"precision": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), zero),
                            "recall": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), zero),
                            "f1": F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero)})


def agreement_vs_gt(trace: DataFrame, labels: Sequence[str], field: str = "llm_label", normalise: bool = True, aliases: dict = ALIASES) -> DataFrame:
    """S6-02: rows, coverage, accuracy and macro F1 per backend against ground truth; undefined F1 counts as 0."""
    pred = norm_label(F.col(field), aliases) if normalise else F.col(field)
    df = trace.where("gt_label IS NOT NULL").select("backend_id", F.col("gt_label").alias("_t"), pred.alias("_p"))
    base = df.groupBy("backend_id").agg(F.count(F.lit(1)).alias("n_gt"), F.avg(F.coalesce(F.trim("_p") != "", F.lit(False)).cast("double")).alias("coverage"),
                                        F.avg((F.col("_t") == F.coalesce("_p", F.lit("other"))).cast("double")).alias("accuracy"))
    f1 = _label_stats(df, labels, ["backend_id"]).where("label <> 'other'").groupBy("backend_id").agg(F.avg("f1").alias("macro_f1"))
    return base.join(f1, "backend_id")


def confusion(trace: DataFrame, labels: Sequence[str], aliases: dict = ALIASES) -> DataFrame:
    """S6-03: counts of (ground truth, prediction), both folded to the labels and "other"."""
    pred = folded(F.coalesce(norm_label(F.col("llm_label"), aliases), F.lit("other")), labels)
    rows = trace.where("gt_label IS NOT NULL").select("backend_id", folded(F.col("gt_label"), labels).alias("gt"), pred.alias("pred"))
    return rows.groupBy("backend_id", "gt").pivot("pred", [*labels, "other"]).count().na.fill(0)


def prf(trace: DataFrame, labels: Sequence[str], aliases: dict = ALIASES) -> DataFrame:
    """S6-03: precision, recall, F1 and support per backend and label."""
    df = trace.where("gt_label IS NOT NULL").select("backend_id", F.col("gt_label").alias("_t"), norm_label(F.col("llm_label"), aliases).alias("_p"))
    return _label_stats(df, labels, ["backend_id"])


def prf_summary(per_label: DataFrame) -> DataFrame:
    """S6-03: macro, support-weighted and micro values over the canonical labels."""
    w = F.col("support")
    return per_label.where("label <> 'other'").groupBy("backend_id").agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * w), F.sum(w)).alias("weighted_f1"), F.try_divide(F.sum("tp"), F.sum(w)).alias("micro_acc"))


def high_conf(trace: DataFrame, labels: Sequence[str], thr: Sequence[float] = CONF_THRESHOLDS, aliases: dict = ALIASES) -> DataFrame:
    """S6-04: precision and coverage per backend above confidence thresholds."""
    df = trace.where("gt_label IS NOT NULL").select(
        "backend_id", F.coalesce("llm_confidence", F.lit(0.0)).alias("c"),
        (folded(F.coalesce(norm_label(F.col("llm_label"), aliases), F.lit("other")), labels) == F.lower("gt_label")).cast("double").alias("ok"))
    t = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thr])))
    hit = F.col("c") >= F.col("threshold")
    return t.groupBy("backend_id", "threshold").agg(F.avg(F.when(hit, F.col("ok"))).alias("precision"), F.avg(hit.cast("double")).alias("coverage"), F.count_if(hit).alias("n"))


def _votes(trace: DataFrame, by: Sequence[str], aliases: dict) -> DataFrame:
    """Modal label (alphabetical on ties), votes, agreement, entropy and mean confidence of the modal label."""
    cells = trace.withColumn("_l", norm_label(F.col("llm_label"), aliases)).where("_l IS NOT NULL").groupBy(*by, "_l").agg(
        F.count(F.lit(1)).alias("n"), F.avg("llm_confidence").alias("c"))
    # one entry per distinct label of a window, so the array is short
    g = cells.groupBy(*by).agg(F.sum("n").alias("votes"), F.max("n").alias("top"), F.min_by(F.struct("_l", "c"), F.struct(-F.col("n"), "_l")).alias("m"), F.collect_list("n").alias("ns"))
    return g.select(*by, "votes", "top", F.col("m._l").alias("modal_label"), (F.col("top") / F.col("votes")).alias("agreement"), entropy(F.col("ns")).alias("entropy"), F.col("m.c").alias("consensus_confidence"))


def prompt_consensus(trace: DataFrame, aliases: dict = ALIASES) -> DataFrame:
    """S6-05: agreement of the prompts of one model on a window."""
    return _votes(trace, ["model_name", "window_key"], aliases)


def prompt_stability(consensus: DataFrame) -> DataFrame:
    """S6-05: mean agreement, share of low-entropy windows and mean consensus confidence per model."""
    return consensus.groupBy("model_name").agg(F.avg("agreement").alias("mean_agreement"), F.avg((F.col("entropy") <= F.ln(F.lit(2.0))).cast("double")).alias("low_entropy_frac"),
                                               F.avg("consensus_confidence").alias("mean_consensus_conf"), F.count(F.lit(1)).alias("n_windows"))


def model_consensus(trace: DataFrame, aliases: dict = ALIASES) -> DataFrame:
    """S6-06: agreement of the models of one prompt: all three, at least two, mean entropy."""
    v = _votes(trace, ["prompt_type", "window_key"], aliases)
    return v.groupBy("prompt_type").agg(F.avg(((F.col("votes") >= 3) & (F.col("top") == 3)).cast("double")).alias("agreement_at_1"), F.avg((F.col("top") >= 2).cast("double")).alias("agreement_at_2"),
                                        F.avg("entropy").alias("mean_entropy"), F.count(F.lit(1)).alias("n_windows"))


def new_discoveries(trace: DataFrame, consensus: DataFrame, conf: float = 0.9, cons: float = 0.75, exclude: Sequence[str] = ("other",), aliases: dict = ALIASES) -> DataFrame:
    """S6-07: windows without ground truth that a backend labels confidently and in line with its model's consensus."""
    d = trace.where("gt_label IS NULL").withColumn("_l", norm_label(F.col("llm_label"), aliases))
    j = d.join(consensus.select("model_name", "window_key", "agreement", "modal_label"), ["model_name", "window_key"], "left")
    ok = (F.col("llm_confidence") >= conf) & (F.col("agreement") >= cons) & (F.col("_l") == F.col("modal_label")) & ~F.col("_l").isin(*exclude)
    g = j.groupBy("backend_id").agg(F.count_distinct("window_key").alias("n_no_gt"), F.count_distinct(F.when(ok, F.col("window_key"))).alias("new_disc_count"))
    return g.withColumn("new_disc_rate", F.try_divide("new_disc_count", "n_no_gt"))


def reliability(df: DataFrame, conf: str = "conf", ok: str = "ok", edges: Sequence[float] = CONF_EDGES) -> DataFrame:
    """S6-08: reliability bins for given edges, the last one closed; empty bins stay."""
    c, last = F.col(conf), len(edges) - 2
    spans = F.array(*[F.struct(F.lit(k).alias("bin"), F.lit(float(edges[k])).alias("lo"), F.lit(float(edges[k + 1])).alias("hi")) for k in range(last + 1)])
    which = F.when((c >= edges[last]) & (c <= edges[last + 1]), last)
    for k in range(last):
        which = which.when((c >= edges[k]) & (c < edges[k + 1]), k)
    agg = df.groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(ok).cast("double")).alias("accuracy"), F.avg(conf).alias("mean_conf"))
    grid = df.sparkSession.range(1).select(F.inline(spans))
    total = df.agg(F.count(F.lit(1))).scalar()
    return grid.join(agg, "bin", "left").na.fill(0, ["n"]).withColumn("frac", F.col("n") / total)


def ece(df: DataFrame, conf: str = "conf", ok: str = "ok", n: int = 10) -> DataFrame:
    """S6-08: expected calibration error over equal bins, the last one closed."""
    c = F.least(F.greatest(F.col(conf), F.lit(0.0)), F.lit(1.0))
    b = df.groupBy(F.least(F.floor(c * n), F.lit(n - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(ok).cast("double")).alias("a"), F.avg(c).alias("m"))
    return b.agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("m"))) / F.sum("n")).alias("ece"))


def parse_reviews(raw: DataFrame, aliases: dict = ALIASES) -> DataFrame:
    """S6-09: nested review records to one row per window with the label and the reviewed actor."""
    schema = "log_id string, window_key string, scenario struct<scenario_label:string, fields:struct<primary_trigger:string>>, actors array<struct<label:string, uuid:string>>"
    r = raw.select("seq", F.from_json("line", schema).alias("r")).where("r.window_key IS NOT NULL AND trim(r.window_key) <> ''")
    uuid = F.get(F.filter("r.actors", lambda a: F.trim(a["label"]) == F.trim("r.scenario.fields.primary_trigger")), F.lit(0))["uuid"]
    rows = r.select("seq", F.col("r.window_key").alias("window_key"), norm_label(F.col("r.scenario.scenario_label"), aliases).alias("human_label"), F.trim(uuid).alias("human_track"))
    return rows.groupBy("window_key").agg(F.min_by(F.struct("human_label", "human_track"), "seq").alias("h")).select("window_key", "h.*")


def human_alignment(trace: DataFrame, human: DataFrame, labels: Sequence[str], aliases: dict = ALIASES) -> DataFrame:
    """S6-09: agreement of each backend with reviewed windows: scenario, first actor, any of three, both."""
    backends = trace.agg(F.collect_set("backend_id")).scalar()  # a handful of configured backends
    grid = human.withColumn("backend_id", F.explode(backends))
    j = grid.join(trace, ["backend_id", "window_key"], "left").withColumn("_p", norm_label(F.col("llm_label"), aliases)).withColumn("_t", F.col("human_label"))
    same = (F.coalesce("_t", F.lit("other")) == F.coalesce("_p", F.lit("other"))).cast("double")
    has = F.coalesce(F.col("human_track") != "", F.lit(False))
    a1 = F.when(has, F.coalesce((F.col("primary_track") == F.col("human_track")).cast("double"), F.lit(0.0)))
    a3 = F.when(has, F.coalesce(F.array_contains("top_tracks", F.col("human_track")).cast("double"), F.lit(0.0)))
    base = j.groupBy("backend_id").agg(F.count(F.lit(1)).alias("n_human"), F.avg(F.col("_p").isNotNull().cast("double")).alias("coverage"), F.avg(same).alias("scenario_acc"),
                                       F.avg(a1).alias("actor1_acc"), F.avg(a3).alias("actor3_hit"), F.avg(F.when(has, same * a1)).alias("joint_correct"))
    f1 = _label_stats(j, labels, ["backend_id"]).where("label <> 'other'").groupBy("backend_id").agg(F.avg("f1").alias("scenario_macro_f1"))
    return base.join(f1, "backend_id")


def scoreboard(agreement: DataFrame, summary: DataFrame) -> DataFrame:
    """S6-10: backends with their metrics, the best and the worst one flagged (one row per backend)."""
    df = agreement.join(summary.drop("macro_f1"), "backend_id")
    key = F.struct("macro_f1", "accuracy", "coverage", -F.col("backend_id"))
    best = df.agg(F.max_by("backend_id", key)).scalar()
    worst = df.where("coverage > 0").agg(F.min_by("backend_id", F.struct("macro_f1", "accuracy", "coverage", "backend_id"))).scalar()
    return df.withColumns({"best": F.col("backend_id") == best, "worst": F.col("backend_id") == worst})
