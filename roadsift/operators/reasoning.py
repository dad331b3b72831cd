"""Batch reasoning over evidence documents and its evaluation (LLM-*)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadsift.operators.retrieval import class_counts, with_prf

# Labels and actor names of the output contract, and its JSON shape.
SCENARIOS = ["cut_in", "ped_crossing", "obj_crossing", "lead_brake", "approach_stop", "left_oppo", "right_ped", "other"]
ACTORS = ["ACTOR1", "ACTOR2", "ACTOR3"]
OUTPUT = ("ego_window_key string, actor_matrix array<struct<actor_id:string, risk_score:double, reasoning:string>>, primary_responsible_actor string, "
          "scenario_classification string, final_rationale string, confidence_score double")


def render_prompt(docs: DataFrame, template: str, marker: str = "{scenario}", col: str = "llm_input") -> DataFrame:
    """LLM-01: the template with its placeholder replaced by the serialised document; missing input is reported."""
    body = F.to_json(F.col(col))
    return docs.select("window_key", F.replace(F.lit(template), F.lit(marker), body).alias("prompt"), F.when(F.col(col).isNull(), "missing_input").alias("error"))


def infer(prompts: DataFrame, fn: Callable[[list[str]], list[str]], batch: int = 64) -> DataFrame:
    """LLM-02: answers of a pluggable batch function; a failing batch is retried row by row and its errors kept."""
    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at:at + batch]
                texts = part["prompt"].tolist()
                raw, err = [None] * len(texts), [None] * len(texts)
                try:
                    raw = list(fn(texts))
                except Exception:  # noqa: BLE001 - the error of every row is reported
                    for k, text in enumerate(texts):
                        try:
                            raw[k] = fn([text])[0]
                        except Exception as e:  # noqa: BLE001
                            err[k] = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"window_key": part["window_key"], "raw": raw, "error": err})
    return prompts.select("window_key", "prompt").mapInPandas(run, "window_key string, raw string, error string")


def extract_json(raw: Column) -> Column:
    """LLM-03: text of the last fenced JSON block, else from the first brace to the last one."""
    fenced = F.regexp_extract_all(raw, F.lit(r"(?s)```json\s*(\{.*?\})\s*```"), F.lit(1))
    first, last = F.instr(raw, "{"), F.length(raw) - F.instr(F.reverse(raw), "}") + 1
    span = F.when((first > 0) & (F.instr(raw, "}") > 0) & (last > first), F.substring(raw, first, last - first + 1))
    return F.coalesce(F.try_element_at(fenced, F.lit(-1)), span)


def parse_output(df: DataFrame, raw: str = "raw") -> DataFrame:
    """LLM-03: candidate text and parsed struct; null when it is no JSON object."""
    cand = df.withColumn("candidate", extract_json(F.col(raw)))
    keys = F.json_object_keys("candidate")
    return cand.withColumn("parsed", F.when(keys.isNotNull(), F.from_json("candidate", OUTPUT))).withColumn("keys", keys)


def validate_output(parsed: DataFrame, labels: Sequence[str] = SCENARIOS) -> DataFrame:
    """LLM-04: contract errors of each output as an array, and whether it passes."""
    p, keys = F.col("parsed"), F.coalesce("keys", F.array().cast("array<string>"))

    def has(k):
        return F.array_contains(keys, k)

    def blank(c):
        return c.isNull() | (F.trim(c) == "")
    m = p["actor_matrix"]
    checks = [F.when(p.isNull(), "parsed_result_not_dict"), F.when(p.isNotNull() & blank(p["ego_window_key"]), "missing_or_empty_ego_window_key"),
              F.when(p.isNotNull() & ~has("actor_matrix"), "missing_actor_matrix"), F.when(has("actor_matrix") & m.isNull(), "actor_matrix_not_list"), F.when(F.size(m) == 0, "actor_matrix_empty"),
              F.when(F.exists(m, lambda a: a["actor_id"].isNull()), "actor_missing_actor_id"), F.when(F.exists(m, lambda a: a["risk_score"].isNull()), "actor_missing_risk_score"),
              F.when(F.exists(m, lambda a: blank(a["reasoning"])), "actor_empty_reasoning"),
              F.when(p.isNotNull() & ~has("primary_responsible_actor"), "missing_primary_responsible_actor_key"),
              F.when(~p["primary_responsible_actor"].isin(ACTORS), "invalid_primary_responsible_actor_value"),
              F.when(p.isNotNull() & p["scenario_classification"].isNull(), "missing_scenario_classification"), F.when(~p["scenario_classification"].isin(*labels), "invalid_scenario_classification"),
              F.when(p.isNotNull() & ~has("final_rationale"), "missing_final_rationale"), F.when(has("final_rationale") & blank(p["final_rationale"]), "empty_final_rationale"),
              F.when(p.isNotNull() & ~has("confidence_score"), "missing_confidence_score"), F.when(has("confidence_score") & p["confidence_score"].isNull(), "confidence_score_not_numeric")]
    return parsed.withColumn("errors", F.array_compact(F.array(*checks))).withColumn("ok", F.size("errors") == 0)


def pass_rate(validated: DataFrame) -> DataFrame:
    """LLM-04: outputs, passing outputs and pass rate."""
    return validated.agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("passed"), F.avg(F.col("ok").cast("double")).alias("pass_rate"))


def actor_alias(docs: DataFrame) -> DataFrame:
    """LLM-05: (window, alias, rank, track) from the ranked actors of the documents."""
    a = docs.select("window_key", F.explode("actors").alias("a"))
    return a.select("window_key", F.concat(F.lit("ACTOR"), F.col("a.rank_s3").cast("string")).alias("alias"), F.col("a.rank_s3").alias("rank"), F.col("a.track_uuid").alias("track_uuid"))


def gt_tags(tags: DataFrame, docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """LLM-06: one tag per log: tagged logs with evidence (and labels, if given), the first by ``seq``."""
    t = tags.where("tag IS NOT NULL AND NOT coalesce(is_host, false)").join(docs.select("log_id"), "log_id", "left_semi")
    t = t.join(labels.select("log_id"), "log_id", "left_semi") if labels is not None else t
    return t.groupBy("log_id").agg(F.min_by(F.struct("tag", "guest_id"), "seq").alias("t")).select("log_id", "t.tag", "t.guest_id")


def representative(preds: DataFrame, tags: DataFrame, alias: DataFrame) -> DataFrame:
    """LLM-07: the window that speaks for a tagged log: label match, then actor match, then the first key.

    This looks at the truth and so is an oracle selection, kept as such.  ``preds`` has log_id, window_key, label, primary.
    """
    named = preds.join(alias.select("window_key", F.col("alias").alias("primary"), "rank", "track_uuid"), ["window_key", "primary"], "left")
    j = named.join(tags, "log_id")
    hit, actor = F.col("label") == F.col("tag"), F.coalesce(F.col("track_uuid") == F.col("guest_id"), F.lit(False))
    order = F.struct((~hit).alias("a"), (~(hit & actor)).alias("b"), "window_key")
    best = j.groupBy("log_id", "tag", "guest_id").agg(F.min_by(F.struct("window_key", "label", "rank", "track_uuid"), order).alias("r"), F.bool_or(hit).alias("any_hit"))
    return best.select("log_id", "tag", "guest_id", "any_hit", "r.*").withColumn("actor_match", F.col("track_uuid") == F.col("guest_id"))


def confusion(df: DataFrame, labels: Sequence[str], y: str = "tag", p: str = "label") -> DataFrame:
    """LLM-08: confusion matrix, one row per true label."""
    return df.groupBy(F.col(y).alias("truth")).pivot(p, list(labels)).count().na.fill(0)


def class_metrics(df: DataFrame, y: str = "tag", p: str = "label") -> DataFrame:
    """LLM-08: tp, fp, fn, tn, precision, recall, F1 and support per class; undefined values are null."""
    n = df.where(F.col(y).isNotNull()).agg(F.count(F.lit(1))).scalar()
    return with_prf(class_counts(df, [], y, p)).withColumn("tn", n - F.col("tp") - F.col("fp") - F.col("fn"))


def macro_metrics(classes: DataFrame) -> DataFrame:
    """LLM-08: accuracy and macro values over the classes for which they are defined."""
    return classes.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))


def hit_accuracy(preds: DataFrame, tags: DataFrame) -> DataFrame:
    """LLM-09: share of tagged logs with any window of the right label."""
    per = preds.join(tags, "log_id").groupBy("log_id").agg(F.max((F.col("label") == F.col("tag")).cast("double")).alias("hit"))
    return per.agg(F.count(F.lit(1)).alias("logs"), F.avg("hit").alias("hit_accuracy"))


def alignment(preds: DataFrame, alias: DataFrame) -> DataFrame:
    """LLM-10: how often the chosen actor is ranked first, or among the first two."""
    j = preds.where("primary IS NOT NULL").join(alias.select("window_key", F.col("alias").alias("primary"), "rank"), ["window_key", "primary"], "left")
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg((F.coalesce("rank", F.lit(99)) == 1).cast("double")).alias("rank1"), F.avg((F.coalesce("rank", F.lit(99)) <= 2).cast("double")).alias("top2"))


def gt_actor_match(rep: DataFrame) -> DataFrame:
    """LLM-11: share of representative windows whose chosen actor is the tagged one."""
    r = rep.where("guest_id IS NOT NULL AND track_uuid IS NOT NULL")
    return r.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("actor_match").cast("double")).alias("rate"))


def new_logs(preds: DataFrame, tags: DataFrame) -> DataFrame:
    """LLM-12: untagged logs with a label other than "other": most frequent such label and counts."""
    c = preds.join(tags.select("log_id"), "log_id", "left_anti").groupBy("log_id", "label").agg(F.count(F.lit(1)).alias("n"))
    some = c.where("label <> 'other'").groupBy("log_id").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("modal_label"), F.sum("n").alias("n_labelled"))
    return some.join(c.groupBy("log_id").agg(F.sum("n").alias("n_windows")), "log_id")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """LLM-13: windows side by side for two backends; ``agreement_rate`` sums them up."""
    return a.select("window_key", F.col("label").alias("label_a")).join(b.select("window_key", F.col("label").alias("label_b")), "window_key", "full") \
        .withColumn("agree", F.col("label_a") == F.col("label_b"))


def agreement_rate(pairs: DataFrame) -> DataFrame:
    """LLM-13: shared windows and share of equal labels."""
    return pairs.agg(F.count("agree").alias("shared"), F.avg(F.col("agree").cast("double")).alias("rate"), F.count(F.lit(1)).alias("windows"))


def summary(**parts: DataFrame) -> DataFrame:
    """LLM-14: (section, metric, value) table of one-row metric frames."""
    from roadsift.operators.evaluation import metric_tables

    return metric_tables(**parts)
