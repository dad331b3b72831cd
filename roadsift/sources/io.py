"""Scans, sinks and table maintenance (SRC-*) and dataset splits (SPL-*)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadsift.functions.durable import ensure_checkpoint_dir, pinned
from roadsift.functions.keys import seeded_hash

POINT = "array<struct<x:double,y:double>>"
POSE = "timestamp_ns bigint, qw double, qx double, qy double, qz double, tx_m double, ty_m double, log_id string"
ANNOTATIONS = "timestamp_ns bigint, track_uuid string, category string, length_m double, width_m double, tx_m double, ty_m double, log_id string"
# Accepted names of the key and score columns, by the name used here.
KEY_ALIASES = {"t_start": ["t_start", "window_t_start", "start", "t0"], "t_end": ["t_end", "window_t_end", "end", "t1"],
               "score": ["score", "score_pu_xgb", "score_nnpu", "score_nn"]}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/roadsift-{name}-{uuid.uuid4().hex}"


def _of_logs(df: DataFrame, logs: Sequence[str] | DataFrame | None) -> DataFrame:
    if logs is None:
        return df
    return df.join(logs.select("log_id").distinct(), "log_id", "left_semi") if isinstance(logs, DataFrame) else df.where(F.col("log_id").isin(*logs))


def no_nan(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column."""
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def read_pose(spark: SparkSession, path: str, logs: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """SRC-01: ego pose of many logs (partitioned by log_id), seconds from nanoseconds."""
    df = _of_logs(spark.read.schema(POSE).parquet(path), logs)
    return no_nan(df.select("log_id", (F.col("timestamp_ns") * 1e-9).alias("t_s"), "qw", "qx", "qy", "qz", F.col("tx_m").alias("x"), F.col("ty_m").alias("y")))


def read_annotations(spark: SparkSession, path: str, logs: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """SRC-02: actor annotations of many logs."""
    df = _of_logs(spark.read.schema(ANNOTATIONS).parquet(path), logs)
    return no_nan(df.select("log_id", "track_uuid", (F.col("timestamp_ns") * 1e-9).alias("t_s"), "category", "length_m", "width_m", F.col("tx_m").alias("x"), F.col("ty_m").alias("y")))


def read_map(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """SRC-03: vector maps, one JSON document per file (or per line), as one row per feature with its point lists.

    Points may be ``{x, y}`` or ``[x, y]``; ``lanes`` and ``drivable_area`` are accepted as older names.
    """
    lane = "struct<left_lane_boundary:string,right_lane_boundary:string,is_intersection:boolean>"
    schema = (f"log_id string, lane_segments map<string,{lane}>, lanes map<string,{lane}>, pedestrian_crossings map<string,struct<edge1:string,edge2:string>>, "
              "drivable_areas map<string,struct<area_boundary:string>>, drivable_area map<string,struct<area_boundary:string>>")
    doc = spark.read.schema(schema).option("multiLine", whole_files).json(path)

    def points(c):
        as_pairs = F.transform(F.from_json(c, "array<array<double>>"), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
        return F.when(c.rlike(r"^\s*\[\s*\["), as_pairs).otherwise(F.from_json(c, POINT))

    def rows(kind, source, first, second=None, inter=None):
        e = doc.select("log_id", F.explode(source).alias("feature_id", "v"))
        return e.select("log_id", F.lit(kind).alias("kind"), "feature_id", (F.col("v")[inter] if inter else F.lit(False)).alias("is_intersection"),
                        points(F.col("v")[first]).alias("pts"), (points(F.col("v")[second]) if second else F.lit(None).cast(POINT)).alias("pts2"))
    return rows("lane", F.coalesce("lane_segments", "lanes"), "left_lane_boundary", "right_lane_boundary", "is_intersection").unionByName(
        rows("crosswalk", F.col("pedestrian_crossings"), "edge1", "edge2")).unionByName(rows("drivable", F.coalesce("drivable_areas", "drivable_area"), "area_boundary"))


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """SRC-04: good rows and malformed lines of JSON line files; blank lines are skipped."""
    lines = spark.read.text(path if isinstance(path, str) else list(path)).where(F.trim("value") != "")
    # a line is good when it is a JSON object and nothing in it had to be dropped
    parsed = lines.select("value", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r._bad").isNotNull() | F.col("r").isNull()
    return parsed.where(~bad).select("r.*").drop("_bad"), parsed.where(bad).select("value")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_many(spark: SparkSession, paths: str | Sequence[str], schema: str, fmt: str = "json") -> DataFrame:
    """SRC-05: many files or globs as one relation; order is set at the sink only."""
    return spark.read.schema(schema).format(fmt).load([paths] if isinstance(paths, str) else list(paths))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06."""
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """SRC-06: replace a stage table."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def read_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-07: the reader is chosen by the file extension."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    formats = {"parquet": ("parquet", {}), "csv": ("csv", {"header": True}), "tsv": ("csv", {"header": True, "sep": "\t"}), "jsonl": ("json", {}), "json": ("json", {})}
    if kind not in formats:
        raise ValueError(f"no reader for {path}")
    fmt, options = formats[kind]
    return spark.read.schema(schema).options(**options).format(fmt).load(path)


def write_report(df: DataFrame, path: str, sep: str = ",") -> None:
    """SRC-08: CSV with header; nested columns become JSON."""
    nested = {f.name: F.to_json(f.name) for f in df.schema if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))}
    df.withColumns(nested).write.mode("overwrite").csv(path, header=True, sep=sep) if nested else df.write.mode("overwrite").csv(path, header=True, sep=sep)


def write_docs(df: DataFrame, path: str, split: str = "split_name") -> None:
    """SRC-09: one document per row, partitioned by split."""
    df.write.mode("overwrite").partitionBy(split).json(path)


def read_docs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-09: document corpus with its split."""
    return spark.read.schema(schema).json(path)


def read_outputs(spark: SparkSession, root: str, schema: str, prompts: Sequence[str] | None = None, backends: Sequence[str] | None = None) -> DataFrame:
    """SRC-10: ``root/<prompt>/<backend>/*.json`` with the two folder names as columns and optional allowlists."""
    def any_of(names):
        return "{" + ",".join(names) + "}" if names else "*"

    # the allowlists are part of the path, so folders outside them aren't listed
    df = spark.read.schema(schema).json(f"{root.rstrip('/')}/{any_of(prompts)}/{any_of(backends)}/*.json").select("*", F.col("_metadata.file_path").alias("_path"))
    part = r"/([^/]+)/([^/]+)/[^/]+$"
    return df.withColumns({"prompt_type": F.regexp_extract("_path", part, 1), "backend_dir": F.regexp_extract("_path", part, 2)}).drop("_path")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: distinct log ids of a text file, a JSON list or JSON lines with ``log_id``."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "json":
        ids = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("log_id"))
    elif kind == "jsonl":
        ids = read_jsonl(spark, path, "log_id string")[0]
    else:
        ids = spark.read.text(path).select(F.trim("value").alias("log_id"))
    return ids.where("log_id IS NOT NULL AND log_id <> ''").distinct()


def insert_absent(target: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """SRC-12: target plus the new rows whose key it lacks (one per key); running it twice changes nothing."""
    rest = [c for c in new.columns if c not in key]
    once = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*") if rest else new.distinct()
    return target.unionByName(once.join(target.select(*key), list(key), "left_anti"))


def upsert(target: DataFrame, new: DataFrame, key: Sequence[str], seq: str = "load_seq") -> DataFrame:
    """SRC-13: last write per key wins; a combinable aggregate, so a key with many versions is never gathered."""
    both = target.unionByName(new)
    rest = [c for c in both.columns if c not in (*key, seq)]
    return both.groupBy(*key).agg(F.max(F.struct(seq, *rest)).alias("_r")).select(*key, "_r.*").select(*both.columns)


def log_run(spark: SparkSession, spec: dict, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-14: run record and its results; the run id is a hash of the query specification."""
    pairs = [(str(k), str(v)) for k, v in sorted(spec.items())]
    runs = spark.createDataFrame([(pairs,)], "spec array<struct<k:string,v:string>>").select(
        F.sha1(F.to_json("spec")).alias("run_id"), F.to_json(F.map_from_entries("spec")).alias("spec_json"))
    return runs, results.withColumn("run_id", runs.select("run_id").scalar())


def require(tables: dict[str, DataFrame], columns: dict[str, Sequence[str]], dim: tuple[str, str] | None = None) -> None:
    """SRC-15: raise unless tables and columns exist, and the vectors of ``dim`` = (table, column) exist with one size."""
    missing = [t for t in columns if t not in tables]
    missing += [f"{t}.{c}" for t, cs in columns.items() if t in tables for c in cs if c not in tables[t].columns]
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    if dim:
        lo, hi, n = tables[dim[0]].where(F.col(dim[1]).isNotNull()).agg(F.min(F.size(dim[1])), F.max(F.size(dim[1])), F.count(F.lit(1))).first()
        if not n or lo != hi:
            raise ValueError(f"{dim[0]}.{dim[1]}: {n} vectors of {lo} to {hi} values")


def with_summary(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """SRC-16: metrics of a stage gathered while it runs; ``Observation.get`` holds them afterwards."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()]), obs


def normalise_keys(df: DataFrame, aliases: dict[str, Sequence[str]] = KEY_ALIASES, required: Sequence[str] = ("t_start", "t_end")) -> DataFrame:
    """SRC-17: rename accepted aliases to one schema; an absent required column is an error."""
    rename = {}
    for name, options in aliases.items():
        found = next((c for c in options if c in df.columns), None)
        if found is None and name in required:
            raise KeyError(f"none of {list(options)} in {df.columns}")
        if found is not None and found != name:
            rename[found] = name
    return df.withColumnsRenamed(rename)


def make_splits(logs: DataFrame, dev_n: int = 100, val_n: int = 50, seed: int = 1337) -> DataFrame:
    """SPL-01: the first ``dev_n`` logs by id are dev, a seeded draw of ``val_n`` others is val, the remainder train."""
    ids = logs.select("log_id").distinct()
    if ids.count() < dev_n + val_n:
        raise ValueError("not enough logs")
    dev = ids.orderBy("log_id").limit(dev_n).withColumn("_d", F.lit(True))
    dev = pinned(dev)
    rest = ids.join(dev, "log_id", "left_anti").withColumn("_h", seeded_hash(seed, F.col("log_id")))
    val = pinned(rest.orderBy("_h", "log_id").limit(val_n).select("log_id", F.lit(True).alias("_v")))
    # both lists are bounded by the two sizes given
    out = ids.join(F.broadcast(dev), "log_id", "left").join(F.broadcast(val), "log_id", "left")
    return out.select("log_id", F.when(F.col("_d"), "dev").when(F.col("_v"), "val").otherwise("train").alias("split_name"))


def check_splits(splits: DataFrame, logs: DataFrame) -> DataFrame:
    """SPL-02: violations: logs in two splits, split logs without data, logs in no split."""
    many = splits.groupBy("log_id").agg(F.count_distinct("split_name").alias("n")).where("n > 1")
    have, data = splits.select("log_id"), logs.select("log_id")
    parts = {"overlap": many.select("log_id"), "missing_data": have.distinct().exceptAll(data.distinct()), "unassigned": data.distinct().exceptAll(have.distinct())}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = row if out is None else out.unionByName(row)
    return out
