"""SRC-* and SPL-*: the tables written to the shared folder in a source format and read back."""

from pyspark.sql import functions as F

from roadsift.plans.registry import query
from roadsift.sources import io as S
from roadsift.sources.keyed import KeyedTable

NS = "CAST(event_id * 1000003 + 7 AS BIGINT)"


def _ns():
    return F.col("event_id") * 1000003 + 7


@query("src_01_read_pose", "log_id:s t_s:d x:d y:d", f"SELECT CAST(user_id AS VARCHAR) AS log_id, {NS} * 1e-9 AS t_s, value AS x, CASE WHEN event_id % 6 <> 0 THEN event_id * 1e0 END AS y FROM events WHERE user_id % 2 = 0")
def src_01(t):
    path = S.scratch(t.spark, "pose")
    e = t.events.select(_ns().alias("timestamp_ns"), *[F.lit(v).alias(c) for c, v in (("qw", 1.0), ("qx", 0.0), ("qy", 0.0), ("qz", 0.0))], F.col("value").alias("tx_m"),
                        F.when(F.col("event_id") % 6 == 0, F.lit(float("nan"))).otherwise(F.col("event_id").cast("double")).alias("ty_m"), F.col("user_id").cast("string").alias("log_id"))
    S.write_table(e, path)
    return S.read_pose(t.spark, path, t.events.where("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("log_id")))


@query("src_02_read_annotations", "log_id:s track_uuid:s t_s:d category:s length_m:d x:d", f"SELECT CAST(user_id AS VARCHAR) AS log_id, CAST(event_id % 9 AS VARCHAR) AS track_uuid, {NS} * 1e-9 AS t_s, event_type AS category, 4.5 AS length_m, value AS x FROM events WHERE user_id IN (3, 5)")
def src_02(t):
    path = S.scratch(t.spark, "annotations")
    e = t.events.select(_ns().alias("timestamp_ns"), (F.col("event_id") % 9).cast("string").alias("track_uuid"), F.col("event_type").alias("category"), F.lit(4.5).alias("length_m"), F.lit(1.9).alias("width_m"), F.col("value").alias("tx_m"), F.lit(0.0).alias("ty_m"), F.col("user_id").cast("string").alias("log_id"))
    S.write_table(e, path)
    return S.read_annotations(t.spark, path, ["3", "5"])


@query("src_03_read_map", "log_id:s kind:s feature_id:s is_intersection:b n:n n2:n x0:d y1:d", """WITH p AS (SELECT p_partkey // 10 AS log_id, CAST(p_partkey AS VARCHAR) AS feature_id, CASE WHEN p_partkey % 10 < 6 THEN 'lane' WHEN p_partkey % 10 < 8 THEN 'crosswalk' ELSE 'drivable' END AS kind, p_partkey % 10 = 5 AS is_intersection, p_size FROM part)
  SELECT *, 3 AS n, CASE WHEN kind = 'drivable' THEN NULL ELSE 3 END AS n2, p_size AS x0, p_size + 1 AS y1 FROM p""")
def src_03(t):
    path, k = S.scratch(t.spark, "map"), F.col("p_partkey")
    s = F.col("p_size").cast("double")
    objs = F.array(*[F.struct((s + i).alias("x"), (s + i).alias("y")) for i in range(3)])
    pairs = F.array(*[F.array(s + i, s + i) for i in range(3)])
    g = t.part.withColumn("log_id", F.floor(k / 10).cast("string"))
    lane = F.when(k % 10 < 6, F.struct(k.cast("string").alias("key"), F.struct(pairs.alias("left_lane_boundary"), objs.alias("right_lane_boundary"), (k % 10 == 5).alias("is_intersection")).alias("value")))
    walk = F.when((k % 10 >= 6) & (k % 10 < 8), F.struct(k.cast("string").alias("key"), F.struct(objs.alias("edge1"), pairs.alias("edge2")).alias("value")))
    area = F.when(k % 10 >= 8, F.struct(k.cast("string").alias("key"), F.struct(objs.alias("area_boundary")).alias("value")))
    # ten features make one document
    doc = g.groupBy("log_id").agg(*[F.map_from_entries(F.collect_list(c)).alias(n) for c, n in ((lane, "lanes"), (walk, "pedestrian_crossings"), (area, "drivable_areas"))])
    S.write_jsonl(doc, path)
    m = S.read_map(t.spark, path, whole_files=False)
    return m.select("log_id", "kind", "feature_id", "is_intersection", F.size("pts").alias("n"), F.when(F.col("pts2").isNotNull(), F.size("pts2")).alias("n2"), F.col("pts")[0]["x"].alias("x0"), F.col("pts")[1]["y"].alias("y1"))


def _lines(t):
    e = F.col("event_id")
    js = F.to_json(F.struct("event_id", "event_type", "value"))
    return t.events.select(F.when(e % 10 == 0, F.lit("  ")).when(e % 10 == 1, F.concat(js, F.lit("}}x{"))).when(e % 10 == 2, F.lit("{broken")).otherwise(js).alias("value"))


def _jsonl(t):
    path = S.scratch(t.spark, "lines")
    _lines(t).write.text(path)
    return S.read_jsonl(t.spark, path, "event_id bigint, event_type string, value double")


@query("src_04_read_jsonl", "event_id:n event_type:s value:d", "SELECT event_id, event_type, value FROM events WHERE event_id % 10 > 2 OR event_id % 10 = 1")
def src_04(t):
    return _jsonl(t)[0]


@query("src_04_bad_rows", "n:n", "SELECT count(*) AS n FROM events WHERE event_id % 10 = 2")
def src_04_bad(t):
    return _jsonl(t)[1].agg(F.count(F.lit(1)).alias("n"))


@query("src_05_read_many", "event_id:n value:d", "SELECT event_id, value FROM events WHERE event_type IN ('click', 'view')")
def src_05(t):
    path = S.scratch(t.spark, "many")
    t.events.select("event_id", "value", "event_type").write.partitionBy("event_type").json(path)
    return S.read_many(t.spark, [f"{path}/event_type=click/*.json", f"{path}/event_type=view/*.json"], "event_id bigint, value double")


@query("src_06_write_table", "o_orderkey:n o_totalprice:d o_orderstatus:s", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def src_06(t):
    path = S.scratch(t.spark, "table")
    S.write_table(t.orders, path)
    S.write_table(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), path, ["o_orderstatus"])
    return S.read_table(t.spark, path)


@query("src_07_read_any", "kind:s c_custkey:n c_acctbal:d", "SELECT k AS kind, c_custkey, c_acctbal FROM customer, (VALUES ('csv'), ('tsv'), ('jsonl'), ('parquet')) AS v(k)")
def src_07(t):
    df, out = t.customer.select("c_custkey", "c_acctbal"), None
    for kind in ("csv", "tsv", "jsonl", "parquet"):
        path = f"{S.scratch(t.spark, 'any')}.{kind}"
        if kind in ("csv", "tsv"):
            S.write_report(df, path, "\t" if kind == "tsv" else ",")
        elif kind == "jsonl":
            S.write_jsonl(df, path)
        else:
            S.write_table(df, path)
        part = S.read_any(t.spark, path, "c_custkey bigint, c_acctbal double").withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("src_08_write_report", "c_custkey:n js:s", """SELECT c_custkey, printf('{"seg":"%s","nation":%d}', c_mktsegment, c_nationkey) AS js FROM customer""")
def src_08(t):
    path = f"{S.scratch(t.spark, 'report')}.csv"
    S.write_report(t.customer.select("c_custkey", F.struct(F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nation")).alias("js")), path)
    return t.spark.read.schema("c_custkey bigint, js string").option("escape", "\\").csv(path, header=True)


@query("src_09_read_docs", "doc_id:n text:s split_name:s", "SELECT doc_id, text, lang AS split_name FROM documents")
def src_09(t):
    path = S.scratch(t.spark, "docs")
    S.write_docs(t.documents.select("doc_id", "text", F.col("lang").alias("split_name")), path)
    return S.read_docs(t.spark, path, "doc_id bigint, text string, split_name string")


@query("src_10_read_outputs", "prompt_type:s backend_dir:s event_id:n", "SELECT 'p' || (event_id % 3) AS prompt_type, 'llm_' || event_type AS backend_dir, event_id FROM events WHERE event_id % 3 < 2 AND event_type = 'click'")
def src_10(t):
    root = S.scratch(t.spark, "outputs")
    folders = t.events.select("event_id", (F.col("event_id") % 3).cast("int").alias("p"), F.concat(F.lit("llm_"), "event_type").alias("b"))
    for p in range(3):
        kinds = [r["b"] for r in folders.select("b").distinct().collect()]  # the few event types
        for kind in kinds:
            folders.where((F.col("p") == p) & (F.col("b") == kind)).select("event_id").write.json(f"{root}/p{p}/{kind}")
    return S.read_outputs(t.spark, root, "event_id bigint", ["p0", "p1"], ["llm_click"])


@query("src_11_read_ids", "kind:s log_id:s", "SELECT k AS kind, CAST(user_id AS VARCHAR) AS log_id FROM (SELECT DISTINCT user_id FROM events), (VALUES ('txt'), ('jsonl')) AS v(k)")
def src_11(t):
    ids, out = t.events.select(F.col("user_id").cast("string").alias("log_id")), None
    for kind in ("txt", "jsonl"):
        path = f"{S.scratch(t.spark, 'ids')}.{kind}"
        ids.write.text(path) if kind == "txt" else S.write_jsonl(ids, path)
        part = S.read_ids(t.spark, path).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def _versions(t):
    k = F.col("o_orderkey")
    old = t.orders.where("o_orderkey % 3 <> 0").select((k % 1000).alias("key"), F.col("o_totalprice").alias("v"), k.alias("load_seq"))
    return old, t.orders.where("o_orderkey % 3 = 0").select((k % 1500).alias("key"), (-F.col("o_totalprice")).alias("v"), (k + 1000000).alias("load_seq"))


@query("src_12_insert_absent", "key:n n:n", "WITH a AS (SELECT o_orderkey % 1000 AS key, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1) SELECT * FROM a UNION ALL SELECT DISTINCT o_orderkey % 1500, 1 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 1500 NOT IN (SELECT key FROM a)")
def src_12(t):
    old, new = _versions(t)
    once = S.insert_absent(old, new, ["key"])
    return S.insert_absent(once, new, ["key"]).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("src_13_upsert", "key:n v:d load_seq:n", "WITH u AS (SELECT o_orderkey % 1000 AS key, o_totalprice AS v, o_orderkey AS load_seq FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey % 1500, -o_totalprice, o_orderkey + 1000000 FROM orders WHERE o_orderkey % 3 = 0) SELECT key, arg_max(v, load_seq) AS v, max(load_seq) AS load_seq FROM u GROUP BY key")
def src_13(t):
    return S.upsert(*_versions(t), ["key"])


@query("src_13_keyed_table", "key:n v:d load_seq:n", "WITH u AS (SELECT o_orderkey % 1000 AS key, o_totalprice AS v, o_orderkey AS load_seq FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey % 1500, -o_totalprice, o_orderkey + 1000000 FROM orders WHERE o_orderkey % 3 = 0) SELECT key, arg_max(v, load_seq) AS v, max(load_seq) AS load_seq FROM u GROUP BY key")
def src_13_keyed(t):
    """The same writes as ``src_13_upsert`` into a bucketed table, the second one twice."""
    old, new = _versions(t)
    table = KeyedTable(t.spark, S.scratch(t.spark, "keyed"), ["key"], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in old.schema))
    table.upsert(old, "first")
    table.upsert(new, "second")
    table.upsert(new, "second")
    return table.read()


@query("src_14_log_run", "run_id:s spec_json:s rank:n vec_id:n", """SELECT sha1('[{"k":"prompt","v":"base"},{"k":"top_k","v":"10"}]') AS run_id, '{"prompt":"base","top_k":"10"}' AS spec_json, vec_id + 1 AS rank, vec_id FROM embeddings""")
def src_14(t):
    runs, rows = S.log_run(t.spark, {"top_k": 10, "prompt": "base"}, t.embeddings.select((F.col("vec_id") + 1).alias("rank"), "vec_id"))
    return rows.join(runs, "run_id")


@query("src_15_require", "tables:n dim:n", "SELECT 2 AS tables, max(len(embedding)) AS dim FROM embeddings")
def src_15(t):
    S.require({"embeddings": t.embeddings, "labels": t.labels}, {"embeddings": ["vec_id", "label"], "labels": ["doc_id"]}, ("embeddings", "embedding"))
    return t.embeddings.agg(F.lit(2).alias("tables"), F.max(F.size("embedding")).alias("dim"))


@query("src_16_with_summary", "rows:n positives:n top:d", "SELECT count(*) AS rows, count(*) FILTER (value > 100) AS positives, max(value) AS top FROM events")
def src_16(t):
    df, obs = S.with_summary(t.events, "events", positives=F.count_if(F.col("value") > 100), top=F.max("value"))
    S.write_table(df.select("event_id", "value"), S.scratch(t.spark, "summary"))
    m = obs.get
    return t.spark.createDataFrame([(m["rows"], m["positives"], m["top"])], "rows bigint, positives bigint, top double")


@query("src_17_normalise_keys", "t_start:d t_end:d score:d", "SELECT event_id * 1e0 AS t_start, event_id + 1e0 AS t_end, value AS score FROM events")
def src_17(t):
    e = F.col("event_id")
    return S.normalise_keys(t.events.select((e * F.lit(1.0)).alias("window_t_start"), (e + F.lit(1.0)).alias("t1"), F.col("value").alias("score_nnpu")))


LOGS = "lg AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS log_id FROM events), dv AS (SELECT log_id FROM lg ORDER BY log_id LIMIT 5), vl AS (SELECT log_id FROM lg WHERE log_id NOT IN (SELECT log_id FROM dv) ORDER BY md5('1337|' || log_id), log_id LIMIT 4)"


def _logs(t):
    return t.events.select(F.col("user_id").cast("string").alias("log_id"))


@query("spl_01_make_splits", "log_id:s split_name:s", f"WITH {LOGS} SELECT log_id, CASE WHEN log_id IN (SELECT log_id FROM dv) THEN 'dev' WHEN log_id IN (SELECT log_id FROM vl) THEN 'val' ELSE 'train' END AS split_name FROM lg")
def spl_01(t):
    return S.make_splits(_logs(t), 5, 4)


@query("spl_02_check_splits", "rule:s violations:n", "WITH u AS (SELECT DISTINCT user_id FROM events) SELECT 'overlap' AS rule, count(*) FILTER (user_id % 10 = 1) AS violations FROM u UNION ALL SELECT 'missing_data', count(*) FILTER (user_id % 10 = 2) FROM u UNION ALL SELECT 'unassigned', count(*) FILTER (user_id % 10 = 0) FROM u")
def spl_02(t):
    """Some logs are put in two splits, left out, or renamed."""
    u = t.events.select("user_id").distinct()
    logs = u.select(F.col("user_id").cast("string").alias("log_id"))
    splits = u.where("user_id % 10 <> 0").select(F.col("user_id").cast("string").alias("log_id"), F.lit("train").alias("split_name")) \
        .unionByName(u.where("user_id % 10 = 1").select(F.col("user_id").cast("string").alias("log_id"), F.lit("val").alias("split_name"))) \
        .unionByName(u.where("user_id % 10 = 2").select(F.concat(F.lit("x"), F.col("user_id").cast("string")).alias("log_id"), F.lit("dev").alias("split_name")))
    return S.check_splits(splits, logs)
