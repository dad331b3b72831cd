"""Scenario tables: ingest rules, integrity and lineage checks, and the trace view (KB-*).

Ingest functions return the accepted rows and, where rows can be refused, one row of counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadsift.functions.keys import canonical_key, row_hash, window_key
from roadsift.operators.graph import tall
from roadsift.operators.reason_eval import NULL_WORDS

# Label remapping of ground truth, and the form of a track id.
REMAP = {"right_ped": "ped_crossing", "traffic_sign": "approach_stop"}
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def finite(c: Column) -> Column:
    """Null instead of NaN and infinities."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(math.inf)), d)


def _counts(df: DataFrame, bad: Column, key: str = "window_key") -> DataFrame:
    ok = ~bad
    c = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("invalid"), F.count_if(ok).alias("built"))
    unique = df.where(ok).select(key).distinct().agg(F.count(F.lit(1))).scalar()
    return c.withColumn("unique_keys", unique).withColumn("duplicates", F.col("built") - F.col("unique_keys"))


def ingest_windows(raw: DataFrame, split: Column, detector: str) -> tuple[DataFrame, DataFrame]:
    """KB-03: valid windows, the first of equal keys by ``seq``, with total / invalid / duplicate counts."""
    bad = F.coalesce(F.col("log_id").isNull() | F.col("t_start").isNull() | F.col("t_end").isNull() | (F.col("t_end") <= F.col("t_start")), F.lit(True))
    df = raw.withColumn("window_key", window_key(F.col("log_id"), F.col("t_start"), F.col("t_end")))
    rest = [c for c in raw.columns if c != "seq"]
    rows = df.where(~bad).groupBy("window_key").agg(F.min_by(F.struct(*rest), "seq").alias("r")).select("window_key", "r.*") \
        .withColumns({"split_name": split, "detector_name": F.lit(detector), "dur_s": F.col("t_end") - F.col("t_start")})
    return rows, _counts(df, bad)


def ingest_actors(tagged: DataFrame, split: Column) -> DataFrame:
    """KB-04: one row per nested actor with its position as ``tag_rank`` and its JSON."""
    return tagged.select("window_key", split.alias("split_name"), F.posexplode("top_actors").alias("_p", "a")).select(
        "split_name", "window_key", (F.col("_p") + 1).alias("tag_rank"), "a.*", F.to_json("a").alias("raw_json"))


def ingest_features(features: DataFrame, split: Column, payload: Sequence[str]) -> DataFrame:
    """KB-05: key built if absent, NaN and infinities to null, and a JSON payload."""
    df = features if "window_key" in features.columns else features.withColumn(
        "window_key", window_key(F.col("log_id"), F.col("window_t_start"), F.col("window_t_end")))
    doubles = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    clean = df.withColumns({c: finite(F.col(c)) for c in doubles})
    return clean.withColumn("split_name", split).withColumn("features_json", F.to_json(F.struct(*sorted(payload))))


def ingest_scores(scores: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """KB-06: per window the row of the highest ``score_final``; duplicates and those with different content are counted."""
    bad = F.coalesce(F.col("log_id").isNull() | (F.col("t_end") <= F.col("t_start")), F.lit(True))
    df = scores.withColumns({c: finite(F.col(c)) for c in cols}).withColumn("window_key", window_key(F.col("log_id"), F.col("t_start"), F.col("t_end"))) \
        .withColumn("row_hash", row_hash("window_key", *cols))
    rest = ["log_id", "t_start", "t_end", *[c for c in cols if c != "score_final"], "row_hash"]
    per = df.where(~bad).groupBy("window_key").agg(F.max(F.struct("score_final", *rest)).alias("r"), F.count(F.lit(1)).alias("_n"), F.count_distinct("row_hash").alias("_d"))
    conflicts = per.agg(F.sum((F.col("_d") - 1).cast("bigint"))).scalar()
    return per.select("window_key", "r.*"), _counts(df, bad).withColumn("conflicting", conflicts)


def score_ranges(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """KB-06: minimum, maximum and mean of each score."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).alias("v")) for c in cols])).alias("r")).select("r.*")
    return long.groupBy("score").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"))


def ingest_embeddings(emb: DataFrame, dim: int, nan: str = "error", vec: str = "embedding") -> DataFrame:
    """KB-07: vectors of the right size; missing values raise, drop the row, or become zero."""
    arr = F.col(vec).cast("array<double>")
    hole = F.exists(arr, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    df = emb.withColumn(vec, arr)
    size_ok = F.assert_true(F.size(vec) == dim, F.lit(f"embedding dimension is not {dim}")).isNull()
    df = df.where(size_ok)
    if nan == "drop":
        return df.where(~hole)
    if nan == "zero":
        return df.withColumn(vec, F.transform(vec, lambda x: F.coalesce(finite(x), F.lit(0.0))))
    return df.where(F.assert_true(~hole, F.lit("embedding has missing values")).isNull())


def ingest_rankings(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """KB-08: canonical keys, positive ranks; rows whose key does not parse or without rank are counted."""
    df = ranked.withColumn("_k", canonical_key(F.col("window_key")))
    parse_fail, bad_rank = F.col("_k").isNull(), F.coalesce(F.col("rank") <= 0, F.lit(True))
    counts = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(parse_fail).alias("parse_fail"), F.count_if(~parse_fail & bad_rank).alias("invalid"))
    return df.where(~parse_fail & ~bad_rank).withColumn("window_key", F.col("_k")).drop("_k"), counts


def canonical_label(c: Column, remap: dict[str, str] = REMAP) -> Column:
    s = F.trim(c)
    s = F.when(~F.lower(s).isin(NULL_WORDS), s)
    table = F.create_map(*[F.lit(x) for kv in remap.items() for x in kv])
    return F.coalesce(F.try_element_at(table, s), s)


def ingest_gt(labels: DataFrame, tags: DataFrame, windows: DataFrame | None = None, remap: dict[str, str] = REMAP) -> DataFrame:
    """KB-09: ground truth per window with its tag; guests, then positive labels, then the last row win duplicates."""
    tag = tags.where("log_id IS NOT NULL").withColumn("label_canonical", canonical_label(F.col("tag"), remap)).where("label_canonical IS NOT NULL")
    best = tag.groupBy("log_id", "label_canonical").agg(F.min_by(
        F.struct(F.coalesce("has_guest", F.lit(False)).alias("has_guest"), "guest_id", F.col("tag").alias("gt_tag_raw")), F.struct(~F.coalesce("has_guest", F.lit(False)), "seq")).alias("g"))
    df = labels.withColumn("window_key", window_key(F.col("log_id"), F.col("t_start"), F.col("t_end"))).withColumn("label_canonical", canonical_label(F.col("scenario_label"), remap))
    j = df.join(best, ["log_id", "label_canonical"], "left")
    has = F.coalesce("g.has_guest", F.lit(False))
    one = j.groupBy("window_key").agg(F.max_by(F.struct("log_id", "label", F.col("scenario_label").alias("label_raw"), "label_canonical", has.alias("has_guest"), F.col("g.guest_id").alias("guest_id")),
                                               F.struct(has, F.coalesce(F.col("label") == 1, F.lit(False)), "seq")).alias("r")).select("window_key", "r.*")
    return one.join(windows.select("window_key"), "window_key", "left_semi") if windows is not None else one


def flatten_evidence(docs: DataFrame) -> DataFrame:
    """KB-10: one flat row per document with the columns of its first three actors."""
    def actor(k, f):
        return F.get(F.filter("actors", lambda a: a["rank_s3"] == k), F.lit(0))[f].alias(f"actor{k}_{f}")
    return docs.select("window_key", "log_id", "episode.*", *[F.col(f"map.{c}").alias(c) for c in ("road_type_hint", "min_dist_to_crosswalk_m", "min_dist_to_stopline_m")],
                       F.col("hints.primary_side").alias("primary_side"), F.col("hints.has_close_actor").alias("has_close_actor"), *[actor(k, f) for k in (1, 2, 3) for f in ("track_uuid", "s3_score", "category")])


def ingest_predictions(outputs: DataFrame, evidence: DataFrame, windows: DataFrame, remap: dict[str, str] = REMAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """KB-11: predictions with canonical label and resolved actor, the backends with ids, and the counts of what is missing.

    ``outputs``: prompt_type, backend_dir, window_key, label, confidence, primary; ``evidence``: window_key, actor1..3_track_uuid.
    The existence check of the windows is one join for all rows.
    """
    dirs = outputs.select("prompt_type", "backend_dir").distinct()
    # the id is a hash of the natural key, so it does not depend on what else is ingested
    backends = dirs.withColumn("backend_id", F.conv(F.substring(F.md5(F.concat_ws("|", "prompt_type", "backend_dir")), 1, 12), 16, 10).cast("bigint")) \
        .withColumn("model_name", F.regexp_replace("backend_dir", "^llm_", ""))
    j = outputs.join(backends.select("prompt_type", "backend_dir", "backend_id"), ["prompt_type", "backend_dir"]) \
        .join(windows.select("window_key").distinct().withColumn("_w", F.lit(True)), "window_key", "left").join(evidence.withColumn("_e", F.lit(True)), "window_key", "left")
    p = F.upper(F.trim("primary"))
    track = F.when(F.trim("primary").rlike(UUID), F.trim("primary")).when(p == "ACTOR1", F.col("actor1_track_uuid")).when(p == "ACTOR2", F.col("actor2_track_uuid")).when(p == "ACTOR3", F.col("actor3_track_uuid"))
    j = j.withColumn("primary_track_uuid", track)
    known = F.col("_w").isNotNull()
    counts = j.agg(F.count(F.lit(1)).alias("total"), F.count_if(~known).alias("missing_window"), F.count_if(known & F.col("_e").isNull()).alias("missing_evidence"),
                   F.count_if(known & (F.trim("primary") != "") & F.col("primary_track_uuid").isNull()).alias("unresolved_primary"))
    preds = j.where(known).withColumn("label_canonical", canonical_label(F.col("label"), remap)).drop("_w", "_e")
    return preds, backends, counts


def embedding_text(preds: DataFrame, parsed: str | None = None, matrix: str | None = None) -> DataFrame:
    """KB-12: deterministic text of a prediction for embedding."""
    def line(name, c):
        return F.concat(F.lit(f"{name}="), F.coalesce(c, F.lit("")))
    parts = [line("scenario_label", F.trim(F.coalesce(F.nullif("label_canonical", F.lit("")), F.col("label")))),
             line("confidence_score", F.when(F.col("confidence").isNotNull(), F.format_string("%.6f", "confidence"))),
             line("primary_actor_raw", F.col("primary")), line("primary_track_uuid", F.col("primary_track_uuid"))]
    parts += [line("actor_matrix_json", F.col(matrix))] if matrix else []
    parts += [line("parsed_result_json", F.col(parsed))] if parsed else []
    parts.append(line("final_rationale", F.trim("rationale")))
    return preds.withColumn("text", F.concat(F.trim(F.concat_ws("\n", *parts)), F.lit("\n")))


def embed_missing(texts: DataFrame, existing: DataFrame, fn: Callable[[list[str]], list], dim: int, key: Sequence[str] = ("backend_id", "window_key")) -> DataFrame:
    """KB-13: vectors of the rows that have none yet; failures and wrong sizes are reported in ``status``."""
    todo = texts.join(existing.select(*key), list(key), "left_anti").select(*key, "text")

    def run(batches):
        for pdf in batches:
            out, status = [], []
            try:
                got = list(fn(pdf["text"].tolist()))
            except Exception:  # noqa: BLE001 - one bad text must not lose the batch
                got = []
                for x in pdf["text"]:
                    try:
                        got.append(fn([x])[0])
                    except Exception:  # noqa: BLE001
                        got.append(None)
            for v in got:
                ok = v is not None and len(v) == dim
                out.append([float(x) for x in v] if ok else None)
                status.append("ok" if ok else "failed" if v is None else "dim_mismatch")
            yield pdf[list(key)].assign(embedding=out, status=status)
    types = ", ".join(f"{c} {todo.schema[c].dataType.simpleString()}" for c in key)
    return todo.mapInPandas(run, f"{types}, embedding array<double>, status string")


def embed_counts(embedded: DataFrame) -> DataFrame:
    """KB-13: rows per status."""
    return embedded.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def table_counts(tables: dict[str, DataFrame], split: str | None = None) -> DataFrame:
    """KB-14: rows and distinct windows per table."""
    out = None
    for name, df in tables.items():
        d = df.where(F.col("split_name") == split) if split is not None and "split_name" in df.columns else df
        row = d.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("window_key").alias("windows")).select(F.lit(name).alias("table_name"), "rows", "windows")
        out = row if out is None else out.unionByName(row)
    return out


def stage_coverage(windows: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """KB-15: share of windows each stage covers, in percent."""
    df = windows.select("window_key")
    for name, s in stages.items():
        df = df.join(s.select("window_key").distinct().withColumn(f"_{name}", F.lit(1)), "window_key", "left")
    return tall(df.agg(*[(100.0 * F.count(f"_{name}") / F.count(F.lit(1))).alias(name) for name in stages]))


def orphans(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """KB-16: rows of ``left`` without a partner."""
    return left.join(right.select(*keys), list(keys), "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


def integrity(relations: dict[str, tuple[DataFrame, DataFrame, Sequence[str]]]) -> DataFrame:
    """KB-16: orphan counts of several relations."""
    out = None
    for name, (l, r, keys) in relations.items():
        row = orphans(l, r, keys).select(F.lit(name).alias("relation"), "orphans")
        out = row if out is None else out.unionByName(row)
    return out


def duplicate_ranks(rankings: DataFrame) -> DataFrame:
    """KB-16: windows in which a rank or a track occurs twice."""
    g = rankings.groupBy("window_key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rank").alias("ranks"), F.count_distinct("track_uuid").alias("tracks"))
    return g.where((F.col("ranks") < F.col("n")) | (F.col("tracks") < F.col("n")))


def backend_coverage(preds: DataFrame, backends: DataFrame, emb: DataFrame) -> DataFrame:
    """KB-17: per backend rows, windows and embedded windows."""
    p = preds.groupBy("backend_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("window_key").alias("windows"))
    e = emb.groupBy("backend_id").agg(F.count_distinct("window_key").alias("embedded"))
    return backends.select("backend_id", "prompt_type", "backend_dir").join(p, "backend_id", "left").join(e, "backend_id", "left").na.fill(0)


def embedding_coverage(emb: DataFrame, preds: DataFrame) -> DataFrame:
    """KB-17: embeddings per dimension and those without a prediction."""
    lone = emb.join(preds.select("backend_id", "window_key"), ["backend_id", "window_key"], "left_anti").agg(F.count(F.lit(1)).cast("double").alias("value")) \
        .select(F.lit("without_prediction").alias("metric"), "value")
    return emb.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.concat(F.lit("dim:"), F.col("d").cast("string")).alias("metric"), "value").unionByName(lone)


def top_json(rankings: DataFrame, k: int = 3, key: Sequence[str] = ("split_name", "window_key")) -> DataFrame:
    """KB-19: ordered array of the first ``k`` ranked actors per window."""
    top = rankings.where(F.col("rank") <= k).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "track_uuid", "score"))).alias("gat_top3"))
    return top.withColumn("gat_top3_json", F.to_json("gat_top3"))


def scenario_trace(preds: DataFrame, backends: DataFrame, windows: DataFrame, scores: DataFrame, evidence: DataFrame, rankings: DataFrame, gt: DataFrame, emb: DataFrame) -> DataFrame:
    """KB-18: one row per (split, backend, window): predictions with backend, window, score, evidence, top actors, truth and vector."""
    sw = ["split_name", "window_key"]
    return preds.join(backends, "backend_id").join(windows, sw).join(scores, sw, "left").join(evidence, sw, "left") \
        .join(top_json(rankings), sw, "left").join(gt, sw, "left").join(emb, ["split_name", "backend_id", "window_key"], "left")


def check_lineage(stages: dict[str, DataFrame], ranking: DataFrame, chosen: DataFrame, retrieval: DataFrame, weights: tuple[float, float, float] = (1.0, 0.1, 0.1), k: int = 3) -> DataFrame:
    """KB-20: lineage errors per window across stages, as a sorted array; windows without errors have an empty one.

    ``stages`` are window-keyed tables that must all know a window of ``chosen`` (window_key, track_uuid);
    ``retrieval`` has window_key, rank, top_k, similarity, confidence, s1, hybrid.
    """
    df = chosen.select("window_key", F.col("track_uuid").alias("_track"))
    errors = []
    for name, s in stages.items():
        df = df.join(s.select("window_key").distinct().withColumn(f"_in_{name}", F.lit(True)), "window_key", "left")
        errors.append(F.when(F.col(f"_in_{name}").isNull(), f"missing_in_{name}"))
    top = ranking.where(F.col("rank") <= k).groupBy("window_key").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("track_uuid").alias("_u"), F.collect_set("track_uuid").alias("_tracks"))
    df = df.join(top, "window_key", "left").join(retrieval.select("window_key", "rank", "top_k", "similarity", "confidence", "s1", "hybrid"), "window_key", "left")
    a, b, c = weights
    again = a * F.col("similarity") + b * F.col("confidence") + c * F.col("s1")
    errors += [F.when(F.coalesce("_n", F.lit(0)) != k, "not_k_ranked_actors"), F.when(F.col("_u") != F.col("_n"), "actors_not_unique"),
               F.when(~F.coalesce(F.array_contains("_tracks", F.col("_track")), F.lit(False)), "chosen_actor_not_ranked"),
               F.when((F.col("rank") < 1) | (F.col("rank") > F.col("top_k")), "rank_outside_budget"), F.when(F.abs(again - F.col("hybrid")) >= 1e-10, "hybrid_score_differs")]
    return df.select("window_key", F.array_sort(F.array_compact(F.array(*errors))).alias("errors"))


def check_files(spark, path: str, expected: DataFrame) -> DataFrame:
    """KB-20: files whose sha256 differs from the expected one, or that are missing."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("actual"))
    return expected.join(files, "name", "left").where(F.col("actual").isNull() | (F.col("actual") != F.col("sha256"))).select(
        "name", F.when(F.col("actual").isNull(), "missing").otherwise("checksum_mismatch").alias("problem"))

