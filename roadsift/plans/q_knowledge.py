"""KB-*: scenario tables over orders and line items."""

from pyspark.sql import functions as F

from roadsift.functions import keys as K
from roadsift.operators import knowledge as B
from roadsift.operators.geometry import nest_actors, union_then_fill
from roadsift.plans.fixtures import actors
from roadsift.plans.q_evidence import TAGGED, docs
from roadsift.plans.q_geometry import FUSED
from roadsift.plans.registry import query

KEY = "printf('%d|%.6f|%.6f', o_custkey, o_orderkey * 1e0, o_orderkey + 2e0)"
O = f"o AS (SELECT *, CAST(o_custkey AS VARCHAR) AS log_id, o_orderkey * 1e0 AS t_start, o_orderkey + 2e0 AS t_end, {KEY} AS window_key, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS split_name FROM orders)"


def orders(t):
    k = F.col("o_orderkey")
    df = t.orders.withColumns({"log_id": F.col("o_custkey").cast("string"), "t_start": k * F.lit(1.0), "t_end": k + F.lit(2.0), "split_name": F.when(k % 2 == 0, "a").otherwise("b")})
    return df.withColumn("window_key", K.window_key(F.col("log_id"), F.col("t_start"), F.col("t_end")))


@query("kb_01_window_key", "o_orderkey:n window_key:s log:s t0:d again:s broken:s stem:s", f"WITH {O} SELECT o_orderkey, window_key, log_id AS log, t_start AS t0, window_key AS again, NULL AS broken, log_id || '-' || substr(sha256(window_key), 1, 16) AS stem FROM o")
def kb_01(t):
    o, key = orders(t), F.col("window_key")
    loose = F.concat_ws("|", "log_id", F.col("o_orderkey").cast("string"), F.col("t_end").cast("string"))
    return o.select("o_orderkey", key, K.key_log(key).alias("log"), K.key_start(key).alias("t0"), K.canonical_key(loose).alias("again"), K.canonical_key(F.concat("log_id", F.lit("|x|y"))).alias("broken"), K.file_stem(key).alias("stem"))


@query("kb_02_row_hash", "o_orderkey:n h:s", """SELECT o_orderkey, sha1(printf('{"o_custkey":%d,"o_orderkey":%d,"o_orderstatus":"%s"}', o_custkey, o_orderkey, o_orderstatus)) AS h FROM orders""")
def kb_02(t):
    return t.orders.select("o_orderkey", K.row_hash("o_orderstatus", "o_orderkey", "o_custkey").alias("h"))




def _raw_windows(t):
    k = F.col("o_orderkey")
    w = F.floor(k / 2)
    return t.orders.select((F.floor(F.col("o_custkey") / 100)).cast("string").alias("log_id"), F.when(k % 11 != 0, w * F.lit(1.0)).alias("t_start"),
                           (w + F.when(k % 13 == 0, -1.0).otherwise(2.0)).alias("t_end"), k.alias("seq"))


RW = "rw AS (SELECT CAST(o_custkey // 100 AS VARCHAR) AS log_id, o_orderkey AS seq, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey // 2) * 1e0 END AS t_start, (o_orderkey // 2) + CASE WHEN o_orderkey % 13 = 0 THEN -1e0 ELSE 2e0 END AS t_end FROM orders), ok AS (SELECT *, printf('%s|%.6f|%.6f', log_id, t_start, t_end) AS window_key FROM rw WHERE t_start IS NOT NULL AND t_end > t_start)"


@query("kb_03_ingest_windows", "window_key:s log_id:s dur_s:d detector_name:s", f"WITH {RW} SELECT DISTINCT window_key, log_id, t_end - t_start AS dur_s, 'brake' AS detector_name FROM ok")
def kb_03(t):
    return B.ingest_windows(_raw_windows(t), F.lit("a"), "brake")[0]


@query("kb_03_counts", "total:n invalid:n built:n unique_keys:n duplicates:n", f"WITH {RW} SELECT (SELECT count(*) FROM rw) AS total, (SELECT count(*) FROM rw) - count(*) AS invalid, count(*) AS built, count(DISTINCT window_key) AS unique_keys, count(*) - count(DISTINCT window_key) AS duplicates FROM ok")
def kb_03_counts(t):
    return B.ingest_windows(_raw_windows(t), F.lit("a"), "brake")[1]


@query("kb_04_ingest_actors", "window_key:s tag_rank:n track_uuid:s sector_id:n raw_json:s", f"WITH {FUSED} SELECT window_key, tag_rank, track_uuid, sector_id, printf('{{\"tag_rank\":%d,\"track_uuid\":\"%s\",\"sector_id\":%d}}', tag_rank, track_uuid, sector_id) AS raw_json FROM filled")
def kb_04(t):
    wins = t.orders.select(F.col("o_orderkey").cast("string").alias("window_key"))
    nested = nest_actors(wins, union_then_fill(actors(t), 3), ["track_uuid", "sector_id"])
    return B.ingest_actors(nested.withColumn("top_actors", F.col("top_actors")), F.lit("a")).select("window_key", "raw_json", "track_uuid", "sector_id", F.col("split_name"), F.get_json_object("raw_json", "$.tag_rank").cast("int").alias("tag_rank"))


@query("kb_05_ingest_features", "window_key:s value:d features_json:s", "SELECT printf('%d|%.6f|%.6f', user_id, event_id * 1e0, event_id + 1e0) AS window_key, CASE WHEN event_id % 5 > 1 THEN value END AS value, printf('{\"event_id\":%d,\"event_type\":\"%s\"}', event_id, event_type) AS features_json FROM events")
def kb_05(t):
    e = F.col("event_id")
    bad = F.when(e % 5 == 0, F.lit(float("nan"))).when(e % 5 == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    f = t.events.select(F.col("user_id").cast("string").alias("log_id"), (e * F.lit(1.0)).alias("window_t_start"), (e + F.lit(1.0)).alias("window_t_end"), bad.alias("value"), "event_id", "event_type")
    return B.ingest_features(f, F.lit("a"), ["event_type", "event_id"])


SC = "s0 AS (SELECT CAST(l_suppkey AS VARCHAR) AS log_id, l_orderkey // 40 * 1e0 AS t_start, l_orderkey // 40 + CASE WHEN l_orderkey % 17 = 0 THEN 0e0 ELSE 1e0 END AS t_end, l_discount AS score_final, l_tax AS post_hmm FROM lineitem), s1 AS (SELECT *, printf('%s|%.6f|%.6f', log_id, t_start, t_end) AS window_key FROM s0 WHERE t_end > t_start)"


def _scores(t):
    w = F.floor(F.col("l_orderkey") / 40)
    s = t.lineitem.select(F.col("l_suppkey").cast("string").alias("log_id"), (w * F.lit(1.0)).alias("t_start"), (w + F.when(F.col("l_orderkey") % 17 == 0, 0.0).otherwise(1.0)).alias("t_end"), F.col("l_discount").alias("score_final"), F.col("l_tax").alias("post_hmm"))
    return B.ingest_scores(s, ["score_final", "post_hmm"])


@query("kb_06_ingest_scores", "window_key:s score_final:d post_hmm:d", f"WITH {SC} SELECT window_key, max(score_final) AS score_final, max(post_hmm) FILTER (score_final = m) AS post_hmm FROM (SELECT *, max(score_final) OVER (PARTITION BY window_key) AS m FROM s1) GROUP BY window_key")
def kb_06(t):
    return _scores(t)[0]


@query("kb_06_counts", "total:n invalid:n unique_keys:n duplicates:n conflicting:n", f"WITH {SC} SELECT (SELECT count(*) FROM s0) AS total, (SELECT count(*) FROM s0 WHERE t_end <= t_start) AS invalid, count(*) AS unique_keys, sum(n) - count(*) AS duplicates, sum(d) - count(*) AS conflicting FROM (SELECT window_key, count(*) AS n, count(DISTINCT (score_final, post_hmm)) AS d FROM s1 GROUP BY window_key)")
def kb_06_counts(t):
    return _scores(t)[1]


@query("kb_06_score_ranges", "score:s min:d max:d mean:d", "SELECT 'l_discount' AS score, min(l_discount) AS min, max(l_discount) AS max, avg(l_discount) AS mean FROM lineitem UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax), avg(l_tax) FROM lineitem")
def kb_06_ranges(t):
    return B.score_ranges(t.lineitem, ["l_discount", "l_tax"])


@query("kb_07_ingest_embeddings", "vec_id:n first:d total:d", "SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 0 ELSE embedding[1] END AS first, list_sum(CAST(embedding AS DOUBLE[])) - CASE WHEN vec_id % 4 = 0 THEN CAST(embedding[1] AS DOUBLE) ELSE 0 END AS total FROM embeddings")
def kb_07(t):
    holed = F.when(F.col("vec_id") % 4 == 0, F.concat(F.array(F.lit(float("nan"))), F.slice("embedding", 2, 63).cast("array<double>"))).otherwise(F.col("embedding").cast("array<double>"))
    e = B.ingest_embeddings(t.embeddings.withColumn("embedding", holed), 64, "zero")
    return e.select("vec_id", F.get("embedding", F.lit(0)).alias("first"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total"))


def _rankings(t):
    k = F.col("l_orderkey")
    key = F.when(k % 19 == 0, F.lit("no key")).otherwise(F.concat_ws("|", k.cast("string"), k.cast("string"), (k + 2).cast("string")))
    return B.ingest_rankings(t.lineitem.select(key.alias("window_key"), (F.col("l_linenumber") - 1).alias("rank"), F.col("l_partkey").cast("string").alias("track_uuid"), F.col("l_quantity").alias("score")))


@query("kb_08_ingest_rankings", "window_key:s rank:n track_uuid:s score:d", "SELECT printf('%d|%.6f|%.6f', l_orderkey, l_orderkey * 1e0, l_orderkey + 2e0) AS window_key, l_linenumber - 1 AS rank, l_partkey AS track_uuid, l_quantity AS score FROM lineitem WHERE l_orderkey % 19 <> 0 AND l_linenumber > 1")
def kb_08(t):
    return _rankings(t)[0]


@query("kb_08_counts", "total:n parse_fail:n invalid:n", "SELECT count(*) AS total, count(*) FILTER (l_orderkey % 19 = 0) AS parse_fail, count(*) FILTER (l_orderkey % 19 <> 0 AND l_linenumber = 1) AS invalid FROM lineitem")
def kb_08_counts(t):
    return _rankings(t)[1]


GTS = """lb AS (SELECT CAST(o_custkey AS VARCHAR) AS log_id, o_orderkey // 4 * 1e0 AS t_start, o_orderkey // 4 + 1e0 AS t_end, o_orderkey % 2 AS label, CASE WHEN o_orderkey % 23 = 0 THEN 'none' ELSE o_orderstatus END AS scenario_label, o_orderkey AS seq FROM orders),
tgs AS (SELECT CAST(c_custkey AS VARCHAR) AS log_id, s AS tag, (c_custkey + seq) % 3 = 0 AS has_guest, 'g' || c_custkey || '-' || seq AS guest_id, seq FROM customer, (VALUES ('F', 1), ('F', 2), ('right', 3), ('O', 4)) AS v(s, seq)),
tb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id, lc ORDER BY NOT has_guest, seq) AS k FROM (SELECT *, CASE tag WHEN 'right' THEN 'P' ELSE tag END AS lc FROM tgs)) WHERE k = 1),
lj AS (SELECT lb.*, printf('%s|%.6f|%.6f', lb.log_id, t_start, t_end) AS window_key, CASE WHEN scenario_label = 'none' THEN NULL ELSE scenario_label END AS label_canonical, coalesce(tb.has_guest, FALSE) AS has_guest, tb.guest_id FROM lb LEFT JOIN tb ON tb.log_id = lb.log_id AND tb.lc = CASE WHEN scenario_label = 'none' THEN NULL ELSE scenario_label END)"""


@query("kb_09_ingest_gt", "window_key:s label:n label_canonical:s has_guest:b guest_id:s", f"WITH {GTS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_key ORDER BY has_guest DESC, label DESC, seq DESC) AS k FROM lj) WHERE k = 1")
def kb_09(t):
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    w = F.floor(k / 4)
    labels = t.orders.select(F.col("o_custkey").cast("string").alias("log_id"), (w * F.lit(1.0)).alias("t_start"), (w + F.lit(1.0)).alias("t_end"), (k % 2).alias("label"), F.when(k % 23 == 0, "none").otherwise(F.col("o_orderstatus")).alias("scenario_label"), k.alias("seq"))
    four = F.array(*[F.struct(F.lit(s).alias("tag"), F.lit(i).alias("seq")) for s, i in (("F", 1), ("F", 2), ("right", 3), ("O", 4))])
    tags = t.customer.select(c, F.inline(four)).select(c.cast("string").alias("log_id"), "tag", ((c + F.col("seq")) % 3 == 0).alias("has_guest"), F.concat(F.lit("g"), c.cast("string"), F.lit("-"), F.col("seq").cast("string")).alias("guest_id"), "seq")
    return B.ingest_gt(labels, tags, None, {"right": "P"})


@query("kb_10_flatten_evidence", "window_key:s actor1_track_uuid:s actor2_track_uuid:s actor3_category:s road_type_hint:s score_final:d", f"WITH {TAGGED}, a AS (SELECT window_key, max(track_uuid) FILTER (rank_s3 = 1) AS actor1_track_uuid, max(track_uuid) FILTER (rank_s3 = 2) AS actor2_track_uuid, max(category) FILTER (rank_s3 = 3) AS actor3_category FROM e2 GROUP BY window_key) SELECT * FROM ep JOIN a USING (window_key) JOIN ms USING (window_key)")
def kb_10(t):
    return B.flatten_evidence(docs(t))


OUT = """ou AS (SELECT 'p' || (l_linenumber % 2) AS prompt_type, 'llm_m' || (l_suppkey % 3) AS backend_dir, CAST(l_orderkey AS VARCHAR) AS window_key, l_returnflag AS label, 1 - l_discount AS confidence, CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 5 = 1 THEN 'someone' ELSE 'actor' || (l_partkey % 3 + 1) END AS prim, l_comment AS rationale FROM (SELECT *, 'r' || l_partkey AS l_comment FROM lineitem)),
ev AS (SELECT CAST(o_orderkey AS VARCHAR) AS window_key, 'u' || o_custkey AS a1, 'v' || o_custkey AS a2, CASE WHEN o_orderkey % 4 <> 0 THEN 'w' || o_custkey END AS a3 FROM orders WHERE o_orderkey % 7 <> 0),
oj AS (SELECT ou.*, w.o_orderkey IS NOT NULL AS known, ev.window_key IS NOT NULL AS has_ev, CASE prim WHEN 'actor1' THEN a1 WHEN 'actor2' THEN a2 WHEN 'actor3' THEN a3 END AS track FROM ou LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 11 <> 0) AS w ON CAST(w.o_orderkey AS VARCHAR) = ou.window_key LEFT JOIN ev ON ev.window_key = ou.window_key)"""


def _preds(t):
    l, o = F.col, F.col("o_orderkey")
    outputs = t.lineitem.select(F.concat(F.lit("p"), (l("l_linenumber") % 2).cast("string")).alias("prompt_type"), F.concat(F.lit("llm_m"), (l("l_suppkey") % 3).cast("string")).alias("backend_dir"), l("l_orderkey").cast("string").alias("window_key"),
                                l("l_returnflag").alias("label"), (1 - l("l_discount")).alias("confidence"), F.when(l("l_partkey") % 5 == 0, None).when(l("l_partkey") % 5 == 1, "someone").otherwise(F.concat(F.lit("actor"), (l("l_partkey") % 3 + 1).cast("string"))).alias("primary"),
                                F.concat(F.lit("r"), l("l_partkey").cast("string")).alias("rationale"))
    c = F.col("o_custkey").cast("string")
    ev = t.orders.where("o_orderkey % 7 <> 0").select(o.cast("string").alias("window_key"), F.concat(F.lit("u"), c).alias("actor1_track_uuid"), F.concat(F.lit("v"), c).alias("actor2_track_uuid"), F.when(o % 4 != 0, F.concat(F.lit("w"), c)).alias("actor3_track_uuid"))
    wins = t.orders.where("o_orderkey % 11 <> 0").select(o.cast("string").alias("window_key"))
    return B.ingest_predictions(outputs, ev, wins, {"A": "F"})


BID = "CAST('0x' || substr(md5(prompt_type || '|' || backend_dir), 1, 12) AS BIGINT) AS backend_id"


@query("kb_11_ingest_predictions", "backend_id:n window_key:s label_canonical:s confidence:d primary_track_uuid:s", f"WITH {OUT} SELECT {BID}, window_key, CASE label WHEN 'A' THEN 'F' ELSE label END AS label_canonical, confidence, track AS primary_track_uuid FROM oj WHERE known")
def kb_11(t):
    return _preds(t)[0]


@query("kb_11_backends", "backend_id:n prompt_type:s model_name:s", f"WITH {OUT} SELECT DISTINCT {BID}, prompt_type, replace(backend_dir, 'llm_', '') AS model_name FROM ou")
def kb_11_backends(t):
    return _preds(t)[1]


@query("kb_11_counts", "total:n missing_window:n missing_evidence:n unresolved_primary:n", f"WITH {OUT} SELECT count(*) AS total, count(*) FILTER (NOT known) AS missing_window, count(*) FILTER (known AND NOT has_ev) AS missing_evidence, count(*) FILTER (known AND prim IS NOT NULL AND track IS NULL) AS unresolved_primary FROM oj")
def kb_11_counts(t):
    return _preds(t)[2]


@query("kb_12_embedding_text", "text:s n:n", f"WITH {OUT}, x AS (SELECT 'scenario_label=' || CASE label WHEN 'A' THEN 'F' ELSE label END || chr(10) || 'confidence_score=' || printf('%.6f', confidence) || chr(10) || 'primary_actor_raw=' || coalesce(prim, '') || chr(10) || 'primary_track_uuid=' || coalesce(track, '') || chr(10) || 'final_rationale=' || rationale || chr(10) AS text FROM oj WHERE known) SELECT text, count(*) AS n FROM x GROUP BY text")
def kb_12(t):
    return B.embedding_text(_preds(t)[0]).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def _embedder(texts):
    return [[float(len(x)), float(x.count(" "))] if len(x) % 5 else [1.0] for x in texts]


@query("kb_13_embed_missing", "status:s n:n", "SELECT CASE WHEN text IS NULL THEN 'failed' WHEN length(text) % 5 = 0 THEN 'dim_mismatch' ELSE 'ok' END AS status, count(*) AS n FROM conversations WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM conversations WHERE conv_id % 2 = 0) GROUP BY 1")
def kb_13(t):
    d = t.conversations.select(F.col("conv_id").alias("backend_id"), F.col("turn").cast("string").alias("window_key"), "text")
    return B.embed_counts(B.embed_missing(d, d.where("conv_id % 2 = 0"), _embedder, 2))


def _tables(t):
    o = orders(t)
    return {"windows": o.select("split_name", "window_key"), "gt": o.where("o_orderkey % 3 = 0").select("split_name", "window_key"), "scores": o.where("o_orderkey % 5 <> 0").select("split_name", "window_key")}


@query("kb_13_vectors", "backend_id:n window_key:s length:d blanks:d status:s", "SELECT conv_id AS backend_id, turn AS window_key, CASE WHEN length(text) % 5 <> 0 THEN length(text) END AS length, CASE WHEN length(text) % 5 <> 0 THEN length(text) - length(replace(text, ' ', '')) END AS blanks, "
       "CASE WHEN text IS NULL THEN 'failed' WHEN length(text) % 5 = 0 THEN 'dim_mismatch' ELSE 'ok' END AS status FROM conversations WHERE conv_id % 2 = 1")
def kb_13_vectors(t):
    d = t.conversations.select(F.col("conv_id").alias("backend_id"), F.col("turn").cast("string").alias("window_key"), "text")
    v = B.embed_missing(d, d.where("conv_id % 2 = 0"), _embedder, 2)
    return v.withColumns({"length": F.get("embedding", F.lit(0)), "blanks": F.get("embedding", F.lit(1))})


@query("kb_14_table_counts", "table_name:s rows:n windows:n", f"WITH {O}, a AS (SELECT * FROM o WHERE split_name = 'a') SELECT 'windows' AS table_name, count(*) AS rows, count(DISTINCT window_key) AS windows FROM a UNION ALL SELECT 'gt', count(*), count(DISTINCT window_key) FROM a WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'scores', count(*), count(DISTINCT window_key) FROM a WHERE o_orderkey % 5 <> 0")
def kb_14(t):
    return B.table_counts(_tables(t), "a")


@query("kb_15_stage_coverage", "metric:s value:d", f"WITH {O} SELECT 'gt' AS metric, 100.0 * count(*) FILTER (o_orderkey % 3 = 0) / count(*) AS value FROM o UNION ALL SELECT 'scores', 100.0 * count(*) FILTER (o_orderkey % 5 <> 0) / count(*) FROM o")
def kb_15(t):
    x = _tables(t)
    return B.stage_coverage(x["windows"], {"gt": x["gt"], "scores": x["scores"]})


@query("kb_16_integrity", "relation:s orphans:n", f"WITH {O} SELECT 'gt_without_scores' AS relation, count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 5 = 0) AS orphans FROM o UNION ALL SELECT 'scores_without_window', 0")
def kb_16(t):
    x = _tables(t)
    key = ["split_name", "window_key"]
    return B.integrity({"gt_without_scores": (x["gt"], x["scores"], key), "scores_without_window": (x["scores"], x["windows"], key)})


@query("kb_16_duplicate_ranks", "window_key:n n:n ranks:n tracks:n", "SELECT l_orderkey AS window_key, count(*) AS n, count(DISTINCT l_linenumber) AS ranks, count(DISTINCT l_partkey) AS tracks FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) < count(*) OR count(DISTINCT l_partkey) < count(*)")
def kb_16_dup(t):
    return B.duplicate_ranks(t.lineitem.select(F.col("l_orderkey").alias("window_key"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("track_uuid")))


def _emb(t):
    """A vector for one backend of every order; not every order has a line, and so a prediction, of that number."""
    k = F.col("o_orderkey")
    return t.orders.select((k % 7 + 1).alias("backend_id"), k.alias("window_key"), F.when(k % 2 == 0, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).alias("embedding"))


def _pr(t):
    return t.lineitem.select(F.col("l_linenumber").cast("bigint").alias("backend_id"), F.col("l_orderkey").alias("window_key"))


def _whole_emb(t):
    """Every line's backend and order has a vector, and so has one backend of every order, whether a line has its number or not."""
    k = F.col("window_key")
    lines = t.lineitem.select(F.col("l_linenumber").cast("bigint").alias("backend_id"), F.col("l_orderkey").alias("window_key"))
    return lines.unionByName(_emb(t).select("backend_id", "window_key")).distinct().withColumn("embedding", F.when(k % 2 == 0, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))))


EMB = "em AS (SELECT o_orderkey % 7 + 1 AS backend_id, o_orderkey AS window_key FROM orders), pr AS (SELECT l_linenumber AS backend_id, l_orderkey AS window_key FROM lineitem)"
WHOLE_EMB = EMB.replace("FROM orders)", "FROM orders UNION SELECT l_linenumber, l_orderkey FROM lineitem)")


@query("kb_17_backend_coverage", "backend_id:n prompt_type:s n_rows:n windows:n embedded:n", f"WITH {WHOLE_EMB}, b AS (SELECT DISTINCT l_linenumber AS backend_id FROM lineitem), p AS (SELECT backend_id, count(*) AS n_rows, count(DISTINCT window_key) AS windows FROM pr GROUP BY 1), e AS (SELECT backend_id, count(*) AS embedded FROM em GROUP BY 1) SELECT b.backend_id, 'p' || b.backend_id AS prompt_type, coalesce(n_rows, 0) AS n_rows, coalesce(windows, 0) AS windows, coalesce(embedded, 0) AS embedded FROM b LEFT JOIN p USING (backend_id) LEFT JOIN e USING (backend_id)")
def kb_17(t):
    b = t.lineitem.select(F.col("l_linenumber").cast("bigint").alias("backend_id")).distinct().withColumns({"prompt_type": F.concat(F.lit("p"), F.col("backend_id").cast("string")), "backend_dir": F.lit("d")})
    return B.backend_coverage(_pr(t), b, _whole_emb(t))


@query("kb_17_embedding_coverage", "metric:s value:d", f"WITH {EMB} SELECT 'dim:' || (1 + window_key % 2) AS metric, count(*)::DOUBLE AS value FROM em GROUP BY 1 UNION ALL SELECT 'without_prediction', count(*) FROM em ANTI JOIN pr USING (backend_id, window_key)")
def kb_17_emb(t):
    return B.embedding_coverage(_emb(t), _pr(t))


@query("kb_18_scenario_trace", "window_key:s backend_id:n split_name:s model:s score_final:d side:s n_top:n gt:s dim:n", f"""WITH {O}, p AS (SELECT l_linenumber AS backend_id, o.window_key, o.split_name, o_orderkey FROM lineitem JOIN o ON o_orderkey = l_orderkey GROUP BY ALL), t3 AS (SELECT l_orderkey, count(*) AS n_top FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE l_linenumber <= 3 GROUP BY 1)
  SELECT p.window_key, backend_id, split_name, 'm' || backend_id AS model, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS score_final, CASE WHEN o_orderkey % 2 = 0 THEN 'left' END AS side, n_top, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS gt, CASE WHEN backend_id % 2 = 1 THEN 2 END AS dim FROM p JOIN orders USING (o_orderkey) LEFT JOIN t3 ON l_orderkey = o_orderkey""")
def kb_18(t):
    o = orders(t)
    li = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("bigint").alias("backend_id")).distinct().join(o.select("o_orderkey", "window_key", "split_name"), "o_orderkey")
    backends = li.select("backend_id").distinct().withColumn("model", F.concat(F.lit("m"), F.col("backend_id").cast("string")))
    sw = ["split_name", "window_key"]
    tr = B.scenario_trace(li.select(*sw, "backend_id"), backends, o.select(*sw), o.where("o_orderkey % 5 <> 0").select(*sw, F.col("o_totalprice").alias("score_final")), o.where("o_orderkey % 2 = 0").select(*sw, F.lit("left").alias("side")),
                          li.select(*sw, F.col("backend_id").alias("rank"), F.lit("x").alias("track_uuid"), F.lit(1.0).alias("score")), o.where("o_orderkey % 3 = 0").select(*sw, F.col("o_orderstatus").alias("gt")),
                          li.where("backend_id % 2 = 1").select(*sw, "backend_id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding")))
    return tr.withColumn("n_top", F.when(F.col("gat_top3").isNotNull(), F.size("gat_top3"))).withColumn("dim", F.when(F.col("embedding").isNotNull(), F.size("embedding")))


@query("kb_19_top_json", "window_key:n js:s", "WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 3) SELECT l_orderkey AS window_key, '[' || string_agg(printf('{\"rank\":%d,\"track_uuid\":\"t%d\",\"score\":%d}', l_linenumber, l_linenumber, 10 - l_linenumber), ',' ORDER BY l_linenumber) || ']' AS js FROM d GROUP BY l_orderkey")
def kb_19(t):
    r = t.lineitem.select(F.col("l_orderkey").alias("window_key"), F.col("l_linenumber").alias("rank")).distinct().withColumns({"track_uuid": F.concat(F.lit("t"), F.col("rank").cast("string")), "score": 10 - F.col("rank")})
    return B.top_json(r, 3, ["window_key"]).select("window_key", F.col("gat_top3_json").alias("js"))


@query("kb_20_check_lineage", "window_key:n errors:s", """WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber, 't' || l_partkey % 40 AS track FROM lineitem WHERE l_linenumber <= 3), g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT track) AS u, list(track) AS ts FROM r GROUP BY 1)
  SELECT o_orderkey AS window_key, concat_ws(',', CASE WHEN u <> n THEN 'actors_not_unique' END, CASE WHEN NOT coalesce(list_contains(ts, 't' || o_custkey % 40), FALSE) THEN 'chosen_actor_not_ranked' END, CASE WHEN o_orderkey % 6 = 0 THEN 'hybrid_score_differs' END, CASE WHEN o_orderkey % 5 = 0 THEN 'missing_in_scores' END,
    CASE WHEN coalesce(n, 0) <> 3 THEN 'not_k_ranked_actors' END, CASE WHEN o_orderkey % 9 = 0 THEN 'rank_outside_budget' END) AS errors FROM orders LEFT JOIN g ON l_orderkey = o_orderkey""")
def kb_20(t):
    k = F.col("o_orderkey")
    r = t.lineitem.select(F.col("l_orderkey").alias("window_key"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("t"), (F.col("l_partkey") % 40).cast("string")).alias("track_uuid")).distinct()
    w = t.orders.select(k.alias("window_key"))
    chosen = t.orders.select(k.alias("window_key"), F.concat(F.lit("t"), (F.col("o_custkey") % 40).cast("string")).alias("track_uuid"))
    ret = t.orders.select(k.alias("window_key"), F.when(k % 9 == 0, 11).otherwise(3).alias("rank"), F.lit(10).alias("top_k"), F.lit(0.5).alias("similarity"), F.lit(0.8).alias("confidence"), F.lit(0.9).alias("s1"), F.when(k % 6 == 0, 0.5).otherwise(0.67).alias("hybrid"))
    q = B.check_lineage({"windows": w, "scores": w.where("window_key % 5 <> 0")}, r, chosen, ret)
    return q.select("window_key", F.array_join("errors", ",").alias("errors"))

