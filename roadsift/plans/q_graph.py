"""EMB-* and GRF-*: actor index, window graphs and ranking over line items."""

from pyspark.sql import functions as F

from roadsift.operators import graph as R
from roadsift.operators import index as X
from roadsift.plans.fixtures import EGO, SCORES, window_scores
from roadsift.plans.q_features import FLAGGED, plain
from roadsift.plans.registry import query

IDX = FLAGGED + ", idx AS (SELECT *, 1 - p_overlap / 2 AS post_hmm, p_overlap AS score_final, CASE WHEN p_overlap > 0.8 THEN 1 ELSE 0 END AS viterbi FROM flagged)"
A = "window_key:s track_uuid:s"


def index(t):
    return plain(t).withColumns({"post_hmm": 1 - F.col("p_overlap") / 2, "score_final": F.col("p_overlap"),
                                 "viterbi": F.when(F.col("p_overlap") > 0.8, 1).otherwise(0)})


@query("emb_01_resolve_scores", "log_id:s i:n post_hmm:d score_final:d viterbi:n",
       f"WITH {SCORES} SELECT log_id, i, s_b AS post_hmm, s_a AS score_final, CASE WHEN i % 2 = 0 AND s_b >= 0.5 THEN 1 ELSE 0 END AS viterbi FROM scores")
def emb_01(t):
    s = window_scores(t)
    final = s.select("log_id", "i", F.col("s_b").alias("post_hmm"), F.col("s_a").alias("score_final"))
    hmm = s.where("i % 2 = 0").select("log_id", "i", (F.col("s_b") >= 0.5).cast("int").alias("viterbi"), F.col("s_b").alias("post_hmm"))
    return X.resolve_scores(final.unionByName(final), hmm, ["log_id", "i"])


@query("emb_02_attach_episode", "log_id:s i:n episode_id:n",
       f"WITH {SCORES}, ep AS (SELECT log_id, i // 10 AS episode_id, min(t_start) AS t0, max(t_end) AS t1 FROM scores WHERE (i // 10) % 2 = 0 GROUP BY log_id, i // 10) "
       "SELECT s.log_id, s.i, coalesce(min(e.episode_id), -1) AS episode_id FROM scores AS s LEFT JOIN ep AS e ON s.log_id = e.log_id AND s.t_start >= e.t0 AND s.t_end <= e.t1 GROUP BY s.log_id, s.i")
def emb_02(t):
    s = window_scores(t)
    ep = s.withColumn("episode_id", F.floor(F.col("i") / 10)).where("episode_id % 2 = 0").groupBy("log_id", "episode_id").agg(
        F.min("t_start").alias("t0"), F.max("t_end").alias("t1"))
    return X.attach_episode(s, ep)


@query("emb_03_keep_mask", A, f"WITH {IDX} SELECT * FROM idx WHERE post_hmm >= 0.7 OR viterbi = 1")
def emb_03(t):
    return X.keep_mask(index(t), 0.7)


@query("emb_04_join_n1", A + " o_totalprice:d duplicates:n",
       f"WITH {IDX} SELECT window_key, track_uuid, o_totalprice, 0 AS duplicates FROM idx JOIN orders AS o ON o.o_orderkey = idx.o_orderkey WHERE o_orderstatus <> 'P'")
def emb_04(t):
    scores = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("window_key"), "o_totalprice")
    joined, dup = X.join_n1(index(t), scores, ["window_key"])
    return joined.withColumn("duplicates", dup.agg(F.count(F.lit(1))).scalar())


@query("emb_05_prune_actors", A + " actor_rank:n",
       f"WITH {IDX} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_key ORDER BY r_rel_m, ttc_s NULLS LAST, p_overlap, track_uuid) AS actor_rank FROM idx WHERE r_rel_m <= 60) WHERE actor_rank <= 2")
def emb_05(t):
    return X.prune_actors(index(t), 60.0, 2)


@query("emb_06_index_qc", "metric:s value:d", f"""WITH {IDX}, per AS (SELECT window_key, count(DISTINCT track_uuid) AS n FROM idx GROUP BY window_key)
  SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM idx UNION ALL SELECT 'over_radius', count(*) FILTER (r_rel_m > 60) FROM idx
  UNION ALL SELECT 'ttc_null_rate', avg(CASE WHEN ttc_s IS NULL THEN 1.0 ELSE 0.0 END) FROM idx
  UNION ALL SELECT 'post_out_of_bounds', count(*) FILTER (post_hmm < 0 OR post_hmm > 1) FROM idx UNION ALL SELECT 'r_min', min(r_rel_m) FROM idx
  UNION ALL SELECT 'r_max', max(r_rel_m) FROM idx UNION ALL SELECT 'windows', count(*) FROM per UNION ALL SELECT 'too_few', count(*) FILTER (n < 2) FROM per
  UNION ALL SELECT 'too_many', count(*) FILTER (n > 8) FROM per UNION ALL SELECT 'windows_missing_scores', count(*) FROM per WHERE window_key NOT IN
    (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus <> 'P') UNION ALL SELECT 'actors_p05', quantile_cont(n, 0.05) FROM per
  UNION ALL SELECT 'actors_p50', quantile_cont(n, 0.5) FROM per UNION ALL SELECT 'actors_p95', quantile_cont(n, 0.95) FROM per
  UNION ALL SELECT 'category:' || category, count(*) FROM idx GROUP BY category""")
def emb_06(t):
    return X.index_qc(index(t), t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("window_key")), lo=2, hi=8)


@query("emb_06_index_offenders", A + " r_rel_m:d", f"WITH {IDX} SELECT * FROM idx WHERE r_rel_m > 60")
def emb_06_off(t):
    return X.index_offenders(index(t))


COLS = [c for c in X.VITAL if c not in ("rank_p_overlap", "margin_to_top_p", "rank_inv_dmin", "margin_to_top_inv_d")]  # all that the fixture has


@query("emb_07_select_features", "name:s n:n", f"WITH {IDX} " + " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n FROM idx" for c in X.VITAL if c not in (
    "rank_p_overlap", "margin_to_top_p", "rank_inv_dmin", "margin_to_top_inv_d")))
def emb_07(t):
    df = index(t)
    cols = X.select_features(df)
    return df.agg(F.array(*[F.struct(F.lit(c).alias("name"), F.count(c).alias("n")) for c in cols]).alias("a")).select(F.inline("a"))


SCALED = f"{IDX}, med AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in COLS) + " FROM idx), mad AS (SELECT " + ", ".join(
    f"quantile_cont(abs({c} - m_{c}), 0.5) AS d_{c}" for c in COLS) + " FROM idx, med), scaled AS (SELECT window_key, track_uuid, " + ", ".join(
    f"least(greatest((coalesce({c}, m_{c}) - m_{c}) / CASE WHEN d_{c} > 0 THEN d_{c} ELSE 1 END, -8.0), 8.0) AS {c}" for c in COLS) + " FROM idx, med, mad)"
EMB08 = f"WITH {SCALED} SELECT window_key, track_uuid, @ FROM scaled"


@query("emb_08_robust_scale", A + " " + " ".join(f"{c}:d" for c in COLS), EMB08.replace("@", ", ".join(COLS)))
def emb_08(t):
    df = index(t)
    return X.robust_scale(df, df, COLS)


@query("emb_09_window_holdout", A + " split:s", f"WITH {IDX}, k AS (SELECT window_key, row_number() OVER (ORDER BY md5('1337|' || window_key), window_key) AS k FROM (SELECT DISTINCT window_key FROM idx)) "
       "SELECT window_key, track_uuid, CASE WHEN k <= ceil(0.15 * (SELECT count(*) FROM k)) THEN 'val' ELSE 'train' END AS split FROM idx JOIN k USING (window_key)")
def emb_09(t):
    return X.window_holdout(index(t))


@query("emb_10_sample_pairs", "i:n j:n from_pool:b", f"""WITH {EGO}, h AS (SELECT event_id, log_id, event_type, md5('1337|' || event_id) AS hx FROM ego),
  r AS (SELECT *, row_number() OVER p AS k, count(*) OVER (PARTITION BY log_id, event_type) AS n, row_number() OVER g AS gk, count(*) OVER () AS gn FROM h
    WINDOW p AS (PARTITION BY log_id, event_type ORDER BY hx, event_id), g AS (ORDER BY hx, event_id))
  SELECT r.event_id AS i, CASE WHEN r.n >= 2 THEN b.event_id ELSE c.event_id END AS j, r.n >= 2 AS from_pool FROM r JOIN r AS b ON b.log_id = r.log_id AND b.event_type = r.event_type
    AND b.k = r.k % r.n + 1 JOIN r AS c ON c.gk = r.gk % r.gn + 1""")
def emb_10(t):
    ev = t.events.select(F.col("user_id").cast("string").alias("log_id"), "event_type", "event_id")
    return X.sample_pairs(ev, ["log_id", "event_type"], "event_id")


@query("emb_11_embed_actors", A + " norm:d dim:n length:d", EMB08.replace("@", f"sqrt({' + '.join(f'{c} * {c}' for c in COLS)}) AS norm, {len(COLS)} AS dim, CASE WHEN {' OR '.join(f'{c} <> 0' for c in COLS)} THEN 1 ELSE 0 END AS length"))
def emb_11(t):
    """All components of the feature list, which keep lengths whatever the axes."""
    df = index(t)
    out = X.embed_actors(X.robust_scale(df, df, COLS), COLS)
    return out.withColumns({"dim": F.size("embedding"), "length": F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))})


NN = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, CAST(label AS VARCHAR) AS window_key FROM embeddings),
  nn AS (SELECT a.id, a.window_key, arg_max(b.window_key, list_cosine_similarity(a.e, b.e)) AS nw FROM v AS a JOIN v AS b ON a.id <> b.id GROUP BY a.id, a.window_key)"""


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("window_key"))


@query("emb_12_nn_recall", "recall:d rows:n", f"WITH {NN} SELECT avg(CASE WHEN window_key = nw THEN 1.0 ELSE 0.0 END) AS recall, count(*) AS rows FROM nn")
def emb_12(t):
    return X.nn_recall(vectors(t))[0]


@query("emb_12_nn_recall_by_window", "window_key:s recall:d n:n", f"WITH {NN} SELECT window_key, avg(CASE WHEN window_key = nw THEN 1.0 ELSE 0.0 END) AS recall, count(*) AS n FROM nn GROUP BY window_key HAVING count(*) >= 2")
def emb_12_by(t):
    return X.nn_recall(vectors(t))[1]


# --- graphs --------------------------------------------------------------------------------------------------

SLICE_SPEC = "log_id:s window_key:s t0:d t1:d t_on:d t_peak:d w_pre:d w_peak:d w_post:d"
SL = IDX + """, sl AS (SELECT DISTINCT log_id, window_key, window_t_start AS t0, window_t_end AS t1, window_t_start AS t_on, (window_t_start + window_t_end) * 0.5 AS t_peak,
    0.2 AS w_pre, 0.6 AS w_peak, 0.2 AS w_post FROM idx),
sc AS (SELECT CAST(o_custkey AS VARCHAR) AS log_id, o_orderkey * 1e0 + CASE WHEN o_orderkey % 3 = 0 THEN 0.2e0 WHEN o_orderkey % 3 = 1 THEN 0.6e0 ELSE 1.7e0 END AS t_start, o_orderkey + 2e0 AS t_end,
    (o_orderkey % 10) / 10e0 AS post_hmm FROM orders WHERE o_custkey % 4 <> 0),
cand AS (SELECT window_key, (t_start + t_end) * 0.5 AS peak, greatest(0, least(t1, t_end) - greatest(t0, t_start)) / greatest(greatest(t1, t_end) - least(t0, t_start), 1e-9) AS iou, post_hmm, t_start, t0, t1, t_end
  FROM sl JOIN sc USING (log_id)),
bestp AS (SELECT window_key, peak FROM (SELECT *, row_number() OVER (PARTITION BY window_key ORDER BY iou DESC, post_hmm DESC, t_start) AS rn FROM cand
    WHERE (abs(t0 - t_start) <= 0.25 AND abs(t1 - t_end) <= 0.25) OR iou >= 0.5) WHERE rn = 1),
refined AS (SELECT sl.* EXCLUDE (t_peak), coalesce(b.peak, sl.t_peak) AS t_peak, CASE WHEN b.peak IS NULL THEN 'fallback_center' ELSE 'hmm_max_post' END AS peak_source,
    CASE WHEN log_id NOT IN (SELECT log_id FROM sc) THEN 'no_log_in_hmm' WHEN b.peak IS NULL THEN 'no_overlap_match' END AS unmatched_reason FROM sl LEFT JOIN bestp AS b USING (window_key))"""


def scored(t):
    k = F.col("o_orderkey")
    return t.orders.where("o_custkey % 4 <> 0").select(
        F.col("o_custkey").cast("string").alias("log_id"), (k * F.lit(1.0) + F.when(k % 3 == 0, 0.2).when(k % 3 == 1, 0.6).otherwise(1.7)).alias("t_start"),
        (k + F.lit(2.0)).alias("t_end"), (k % 10 / 10.0).alias("post_hmm"))


@query("grf_01_slices", SLICE_SPEC, f"WITH {SL} SELECT * FROM sl")
def grf_01(t):
    return R.slices(index(t))


@query("grf_02_refine_peaks", "window_key:s t_peak:d peak_source:s unmatched_reason:s", f"WITH {SL} SELECT * FROM refined")
def grf_02(t):
    return R.refine_peaks(R.slices(index(t)), scored(t))


@query("grf_03_slice_qc", "metric:s value:d", f"""WITH {SL} SELECT 'windows' AS metric, count(*)::DOUBLE AS value FROM refined UNION ALL SELECT 'bad_order', count(*) FILTER (t1 <= t0) FROM refined
  UNION ALL SELECT 'onset_mismatch', count(*) FILTER (abs(t_on - t0) > 1e-6) FROM refined UNION ALL SELECT 'peak_outside', count(*) FILTER (t_peak < t0 - 1e-6 OR t_peak > t1 + 1e-6) FROM refined
  UNION ALL SELECT 'negative_weight', 0 UNION ALL SELECT 'weights_not_one', 0 UNION ALL SELECT 'peak_needed', count(*) FILTER (peak_source = 'hmm_max_post') FROM refined
  UNION ALL SELECT 'duplicate_keys', count(*) - count(DISTINCT window_key) FROM refined UNION ALL SELECT 'peak_verified', count(DISTINCT window_key) FROM refined JOIN sc USING (log_id)
    WHERE peak_source = 'hmm_max_post' AND (t_start + t_end) * 0.5 BETWEEN t0 - 1e-6 AND t1 + 1e-6
  UNION ALL SELECT 'missing_in_index', count(*) FROM refined WHERE window_key NOT IN (SELECT window_key FROM idx WHERE p_overlap > 0.2)""")
def grf_03(t):
    idx = index(t)
    return R.slice_qc(R.refine_peaks(R.slices(idx), scored(t)), scored(t), idx.where("p_overlap > 0.2"))


NEAR = SL + """, near AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_key ORDER BY r_rel_m, track_uuid) AS rank_by_r FROM idx) WHERE rank_by_r <= 3),
ph(phase_idx, phase, c) AS (VALUES (0, 'pre', 0.2e0), (1, 'onset', 0.4e0), (2, 'mid', 0.7e0), (3, 'peak', 1e0), (4, 'post', 0.4e0)),
act AS MATERIALIZED (SELECT log_id, window_key, track_uuid, category, phase_idx, phase, 0 AS is_ego, greatest(0, r_rel_m * (1 - 0.15*c)) AS r_rel_m, greatest(1e-3, greatest(coalesce(ttc_s, 999.0), 1e-3) * (1 - 0.2*c)) AS ttc_s,
    greatest(0, dmin_m * (1 - 0.2*c)) AS dmin_m, least(greatest(p_overlap + 0.15*c, 0.0), 1.0) AS p_overlap, rel_speed_closing_mps + 0.25*c AS rel_speed_closing_mps,
    least(greatest((1 - 0.1*c) * heading_align_cos + 0.1*c, -1.0), 1.0) AS heading_align_cos, CASE WHEN approach_like >= 0.5 THEN x_rel_m * (1 - 0.05*c) ELSE x_rel_m END AS x_rel_m,
    CASE WHEN approach_like >= 0.5 THEN y_rel_m * (1 - 0.025*c) ELSE y_rel_m END AS y_rel_m, map_lane_alignment_cos, approach_like FROM near, ph),
nodes AS MATERIALIZED (SELECT window_key, track_uuid, phase_idx, phase, is_ego, r_rel_m, x_rel_m, y_rel_m FROM act UNION ALL
  SELECT DISTINCT near.window_key, 'EGO', ph.phase_idx, ph.phase, 1, 0.0, 0.0, 0.0 FROM near, ph),
edges AS MATERIALIZED (SELECT window_key, phase_idx AS src_phase, phase_idx AS dst_phase, 'EGO' AS src_id, track_uuid AS dst_id, 'ego_to_actor' AS edge_type, sqrt(x_rel_m*x_rel_m + y_rel_m*y_rel_m) AS dist_m, 0 AS is_temporal FROM act
  UNION ALL SELECT window_key, phase_idx, phase_idx, track_uuid, 'EGO', 'actor_to_ego', sqrt(x_rel_m*x_rel_m + y_rel_m*y_rel_m), 0 FROM act
  UNION ALL SELECT a.window_key, a.phase_idx, a.phase_idx, a.track_uuid, b.track_uuid, 'actor_to_actor_spatial', sqrt(pow(a.x_rel_m - b.x_rel_m, 2) + pow(a.y_rel_m - b.y_rel_m, 2)), 0
    FROM act AS a JOIN act AS b ON a.window_key = b.window_key AND a.phase_idx = b.phase_idx AND a.track_uuid <> b.track_uuid WHERE sqrt(pow(a.x_rel_m - b.x_rel_m, 2) + pow(a.y_rel_m - b.y_rel_m, 2)) <= 30
  UNION ALL SELECT window_key, phase_idx, phase_idx + 1, track_uuid, track_uuid, 'actor_temporal', 0, 1 FROM act WHERE phase_idx < 4)"""
EDGE_SPEC = "window_key:s src_phase:n dst_phase:n src_id:s dst_id:s edge_type:s dist_m:d is_temporal:n"


def near(t):
    return R.nearest_actors(index(t), 3)


def nodes(t):
    return R.graph_nodes(near(t))


@query("grf_04_nearest_actors", A + " rank_by_r:n", f"WITH {NEAR} SELECT * FROM near")
def grf_04(t):
    return near(t)


@query("grf_05_attach_embeddings", A + " first:d embedding_missing:b",
       f"WITH {NEAR}, e AS (SELECT window_key, track_uuid, CASE WHEN o_orderkey % 3 = 0 THEN 1e0 WHEN o_orderkey % 3 = 1 THEN 2e0 END AS first FROM near) SELECT *, first IS NULL AS embedding_missing FROM e")
def grf_05(t):
    n = near(t)
    train = n.where("o_orderkey % 3 = 0").select("window_key", "track_uuid", F.array(F.lit(1.0)).alias("embedding"))
    val = n.where("o_orderkey % 3 <> 2").select("window_key", "track_uuid", F.array(F.lit(2.0)).alias("embedding"))
    return R.attach_embeddings(n, train, val).withColumn("first", F.get("embedding", F.lit(0)))


@query("grf_06_expand_phases", A + " phase:s r_rel_m:d ttc_s:d dmin_m:d p_overlap:d rel_speed_closing_mps:d heading_align_cos:d x_rel_m:d y_rel_m:d", f"WITH {NEAR} SELECT * FROM act")
def grf_06(t):
    return R.expand_phases(near(t))


@query("grf_07_ego_nodes", "window_key:s phase_idx:n track_uuid:s is_ego:n", f"WITH {NEAR} SELECT * FROM nodes WHERE is_ego = 1")
def grf_07(t):
    return R.ego_nodes(near(t))


@query("grf_08_ego_edges", EDGE_SPEC, f"WITH {NEAR} SELECT * FROM edges WHERE edge_type IN ('ego_to_actor', 'actor_to_ego')")
def grf_08(t):
    return R.ego_edges(nodes(t))


@query("grf_09_proximity_edges", EDGE_SPEC, f"WITH {NEAR} SELECT * FROM edges WHERE edge_type = 'actor_to_actor_spatial'")
def grf_09(t):
    return R.proximity_edges(nodes(t))


@query("grf_10_temporal_edges", EDGE_SPEC, f"WITH {NEAR} SELECT * FROM edges WHERE is_temporal = 1")
def grf_10(t):
    return R.temporal_edges(nodes(t))


CAP = NEAR + """, kn AS MATERIALIZED (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY window_key ORDER BY track_uuid, phase_idx) - 1 AS node FROM (
  SELECT *, row_number() OVER (PARTITION BY window_key ORDER BY is_ego DESC, r_rel_m, track_uuid, phase_idx) AS k FROM nodes) WHERE k <= 14),
pr AS (SELECT a.window_key, a.node AS src, b.node AS dst, a.phase_idx AS src_phase, b.phase_idx AS dst_phase, a.track_uuid AS src_id, b.track_uuid AS dst_id, a.is_ego AS a_ego, b.is_ego AS b_ego,
    sqrt(pow(a.x_rel_m - b.x_rel_m, 2) + pow(a.y_rel_m - b.y_rel_m, 2)) AS d, a.track_uuid = b.track_uuid AS own
  FROM kn AS a JOIN kn AS b ON a.window_key = b.window_key AND (a.phase_idx = b.phase_idx AND a.track_uuid <> b.track_uuid OR b.phase_idx = a.phase_idx + 1 AND a.track_uuid = b.track_uuid AND a.is_ego = 0)),
ce AS (SELECT window_key, src, dst, src_phase, dst_phase, src_id, dst_id, CASE WHEN own THEN 'actor_temporal' WHEN a_ego = 1 THEN 'ego_to_actor' WHEN b_ego = 1 THEN 'actor_to_ego' ELSE 'actor_to_actor_spatial' END AS edge_type,
    CASE WHEN own THEN 0.0 ELSE d END AS dist_m, CASE WHEN own THEN 1 ELSE 0 END AS is_temporal FROM pr WHERE own OR a_ego = 1 OR b_ego = 1 OR d <= 30),
ke AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY window_key, is_temporal ORDER BY dist_m, src_phase, src_id, dst_id, edge_type) AS k FROM ce) WHERE is_temporal = 1 OR k <= 12)"""


def capped(t):
    return R.cap_graph(nodes(t), 14, 12)


@query("grf_11_cap_graph", EDGE_SPEC, f"WITH {CAP} SELECT * EXCLUDE (src, dst) FROM ke")
def grf_11(t):
    return capped(t)[1]


@query("grf_11_capped_windows", "window_key:s n:n metres:d edges:s", f"WITH {CAP} SELECT window_key, count(*) AS n, sum(dist_m) AS metres, string_agg(e, ',' ORDER BY e) AS edges FROM (SELECT *, src || '>' || dst || ':' || edge_type AS e FROM ke) GROUP BY window_key")
def grf_11_windows(t):
    """The same edges, one row a window."""
    e = capped(t)[1].withColumn("e", F.concat(F.col("src").cast("string"), F.lit(">"), F.col("dst").cast("string"), F.lit(":"), "edge_type"))
    return e.groupBy("window_key").agg(F.count("*").alias("n"), F.sum("dist_m").alias("metres"), F.array_join(F.sort_array(F.collect_list("e")), ",").alias("edges"))


@query("grf_12_adjacency", "window_key:s src:n dst:n edge_type_id:n dist_m:d", f"""WITH {CAP} SELECT window_key, src, dst,
  list_position(['ego_to_actor', 'actor_to_ego', 'actor_to_actor_spatial', 'actor_temporal'], edge_type) - 1 AS edge_type_id, dist_m FROM ke""")
def grf_12(t):
    return R.adjacency(*capped(t))[0]


@query("grf_12_manifest", "window_key:s n_nodes:n n_edges:n n_spatial:n n_temporal:n", f"""WITH {CAP}, m AS (SELECT window_key, count(*) AS n_nodes FROM kn GROUP BY window_key),
  d AS (SELECT window_key, count(*) AS n_edges, count(*) FILTER (is_temporal = 0) AS n_spatial, count(*) FILTER (is_temporal = 1) AS n_temporal FROM ke GROUP BY window_key)
  SELECT m.window_key, n_nodes, coalesce(n_edges, 0) AS n_edges, coalesce(n_spatial, 0) AS n_spatial, coalesce(n_temporal, 0) AS n_temporal FROM m LEFT JOIN d USING (window_key)""")
def grf_12_manifest(t):
    return R.adjacency(*capped(t))[1]


@query("grf_13_graph_qc", "metric:s value:d", f"""WITH {CAP}, per AS (SELECT window_key, count(DISTINCT phase) AS p, count(*) AS n FROM kn GROUP BY window_key),
  med AS (SELECT window_key, quantile_cont(r_rel_m, 0.5) FILTER (phase = 'pre') AS pre, quantile_cont(r_rel_m, 0.5) FILTER (phase = 'peak') AS peak FROM kn WHERE is_ego = 0 AND phase IN ('pre', 'peak') GROUP BY window_key)
  SELECT 'windows' AS metric, count(*)::DOUBLE AS value FROM per UNION ALL SELECT 'windows_missing_phase', count(*) FILTER (p < 5) FROM per UNION ALL SELECT 'nodes_min', min(n) FROM per
  UNION ALL SELECT 'nodes_max', max(n) FROM per UNION ALL SELECT 'nodes_median', quantile_cont(n, 0.5) FROM per UNION ALL SELECT 'r_pre_above_peak_pct', 100 * avg(CASE WHEN pre > peak THEN 1.0 WHEN pre <= peak THEN 0.0 END) FROM med
  UNION ALL SELECT 'dangling_endpoints', 0 UNION ALL SELECT 'edges', count(*) FROM ke UNION ALL SELECT 'negative_distance', 0 UNION ALL SELECT 'self_links', 0
  UNION ALL SELECT 'isolated_nodes', count(*) FROM kn AS k WHERE NOT EXISTS (SELECT 1 FROM ke AS e WHERE e.window_key = k.window_key AND (e.src_id = k.track_uuid AND e.src_phase = k.phase_idx
    OR e.dst_id = k.track_uuid AND e.dst_phase = k.phase_idx))""")
def grf_13(t):
    return R.graph_qc(*capped(t))


PHYS = ("exp(-least(greatest(r_rel_m, 0), 80) / 20.0) * exp(-least(greatest(ttc_s, 0), 30) / 2.0) * exp(0.6 * greatest(0, rel_speed_closing_mps)) * (1 + 0.2 * greatest(0, coalesce(map_lane_alignment_cos, 0))) "
        "* (1 + 0.2 * CASE WHEN approach_like > 0.5 THEN 1 ELSE 0 END) * 0.8")
TEACH = NEAR + f""", raw AS (SELECT window_key, track_uuid, category, sum({PHYS} * CASE phase WHEN 'pre' THEN 0.2 WHEN 'onset' THEN 0.4 WHEN 'post' THEN 0.2 ELSE 0.6 END) AS s FROM act GROUP BY ALL),
z AS (SELECT *, exp((s - max(s) OVER w) / 0.8) AS e, count(*) OVER w AS n FROM raw WINDOW w AS (PARTITION BY window_key)),
teach AS (SELECT window_key, track_uuid, category, s AS score_window_raw, 0.98 * e / sum(e) OVER (PARTITION BY window_key) + 0.02 / n AS q FROM z)"""


def teach(t):
    return R.teacher(nodes(t), R.slices(index(t)))


@query("grf_14_phase_score", A + " phase:s score:d", f"WITH {NEAR} SELECT *, {PHYS} AS score FROM act")
def grf_14(t):
    return R.expand_phases(near(t)).withColumn("score", R.phase_score())


@query("grf_15_teacher", A + " q:d score_window_raw:d", f"WITH {TEACH} SELECT * FROM teach")
def grf_15(t):
    return teach(t)


@query("grf_16_teacher_qc", "metric:s value:d", f"""WITH {TEACH} SELECT 'missing_actors' AS metric, 0::DOUBLE AS value UNION ALL SELECT 'mean_abs_dev', 0 UNION ALL SELECT 'windows', count(DISTINCT window_key) FROM teach
  UNION ALL SELECT 'top1:' || category, count(*) FROM (SELECT *, row_number() OVER (PARTITION BY window_key ORDER BY q DESC, track_uuid) AS k FROM teach) WHERE k = 1 GROUP BY category""")
def grf_16(t):
    return R.teacher_qc(teach(t), nodes(t))


POOL = NEAR + f", pool AS (SELECT window_key, track_uuid, max({PHYS}) AS score FROM act GROUP BY ALL), top3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_key ORDER BY score DESC, track_uuid) AS rank FROM pool) WHERE rank <= 2)"


def pooled(t):
    return R.pool_scores(nodes(t).withColumn("score", R.phase_score()))


@query("grf_17_pool_scores", A + " score:d", f"WITH {POOL} SELECT * FROM pool")
def grf_17(t):
    return pooled(t)


@query("grf_18_top_actors", A + " rank:n score:d", f"WITH {POOL} SELECT * FROM top3")
def grf_18(t):
    return R.top_actors(pooled(t), 2)


GTL = SL + """, lab AS (SELECT CAST(o_custkey AS VARCHAR) AS log_id, o_orderkey + CASE WHEN o_orderkey % 2 = 0 THEN 0.04e0 ELSE 0.3e0 END AS l0, o_orderkey + 2.02e0 AS l1 FROM orders WHERE o_orderkey % 5 = 0),
tg AS (SELECT CAST(c_custkey AS VARCHAR) AS log_id, 'trk' || (c_custkey % 3) AS track_uuid FROM customer WHERE c_custkey % 3 <> 0 AND c_mktsegment <> 'BUILDING'),
gtl AS (SELECT DISTINCT window_key, track_uuid FROM sl JOIN lab USING (log_id) JOIN tg USING (log_id) WHERE abs(t0 - l0) <= 0.05 AND abs(t1 - l1) <= 0.05)"""


@query("grf_19_gt_lookup", A, f"WITH {GTL} SELECT * FROM gtl")
def grf_19(t):
    k = F.col("o_orderkey")
    labels = t.orders.where("o_orderkey % 5 = 0").select(F.col("o_custkey").cast("string").alias("log_id"), (k + F.when(k % 2 == 0, 0.04).otherwise(0.3)).alias("t_start"),
                                                       (k + F.lit(2.02)).alias("t_end"), F.lit(1).alias("label"))
    c = F.col("c_custkey")
    tags = t.customer.select(c.cast("string").alias("log_id"), (c % 3 != 0).alias("has_guest"), F.concat(F.lit("trk"), (c % 3).cast("string")).alias("guest_id"),
                             F.when(F.col("c_mktsegment") == "BUILDING", "not_relevant").otherwise(F.col("c_mktsegment")).alias("tag"))
    wins = R.slices(index(t)).select("log_id", "window_key", F.col("t0").alias("t_start"), F.col("t1").alias("t_end"))
    return R.gt_lookup(wins, labels, tags)


@query("grf_20_md5_split", "window_key:s split:s", f"WITH {SL}, k AS (SELECT window_key, row_number() OVER (ORDER BY md5('1337|' || window_key), window_key) AS k FROM sl) "
       "SELECT window_key, CASE WHEN k <= ceil(0.2 * (SELECT count(*) FROM k)) THEN 'val' ELSE 'train' END AS split FROM k")
def grf_20(t):
    return R.md5_split(R.slices(index(t)))


GRID = [0.5, 1.0, 2.0, 4.0]


@query("grf_21_fit_temperature", "temperature:d nll:d windows:n best:b", f"""WITH {POOL}, g AS (SELECT *, rank_by_r = 1 AS y FROM pool JOIN (SELECT window_key, track_uuid, rank_by_r FROM near) USING (window_key, track_uuid)),
  tt(temperature) AS (VALUES (0.5), (1.0), (2.0), (4.0)), p AS (SELECT window_key, temperature, sum(CASE WHEN y THEN e ELSE 0 END) / sum(e) AS p FROM (SELECT *, exp((score - max(score) OVER (PARTITION BY window_key, temperature)) / temperature) AS e FROM g, tt) GROUP BY ALL),
  n AS (SELECT temperature, avg(-ln(greatest(p, 1e-12))) AS nll, count(*) AS windows FROM p GROUP BY temperature) SELECT *, nll = min(nll) OVER () AS best FROM n""")
def grf_21(t):
    gt = near(t).where("rank_by_r = 1").select("window_key", "track_uuid")
    return R.fit_temperature(pooled(t), gt, GRID)


@query("grf_22_topk_qc", "metric:s value:d", f"""WITH {POOL}, raw AS (SELECT window_key, track_uuid, category, sum({PHYS} * CASE phase WHEN 'pre' THEN 0.2 WHEN 'onset' THEN 0.4 WHEN 'post' THEN 0.2 ELSE 0.6 END) AS s FROM act GROUP BY ALL),
  z AS (SELECT *, exp((s - max(s) OVER w) / 0.8) AS e, count(*) OVER w AS n FROM raw WINDOW w AS (PARTITION BY window_key)), teach AS (SELECT window_key, track_uuid, 0.98 * e / sum(e) OVER (PARTITION BY window_key) + 0.02 / n AS q FROM z),
  m AS (SELECT t.window_key, sum(coalesce(q, 0)) AS at_k, max(CASE WHEN rank = 1 THEN track_uuid END) AS first FROM top3 AS t LEFT JOIN teach USING (window_key, track_uuid) GROUP BY t.window_key),
  a AS (SELECT window_key, sum(q) AS all_q, arg_min(track_uuid, k) AS best FROM (SELECT *, row_number() OVER (PARTITION BY window_key ORDER BY q DESC, track_uuid) AS k FROM teach) GROUP BY window_key)
  SELECT 'windows' AS metric, count(DISTINCT window_key)::DOUBLE AS value FROM top3 UNION ALL SELECT 'bad_windows', 0 UNION ALL SELECT 'nonfinite_rows', 0
  UNION ALL SELECT 'missing_windows', (SELECT count(*) FROM orders) - (SELECT count(DISTINCT window_key) FROM top3) UNION ALL SELECT 'extra_windows', 0
  UNION ALL SELECT 'teacher_mass_at_k', avg(at_k / all_q) FROM m JOIN a USING (window_key) UNION ALL SELECT 'teacher_top1_hit', avg(CASE WHEN first = best THEN 1.0 ELSE 0.0 END) FROM m JOIN a USING (window_key)""")
def grf_22(t):
    man = t.orders.select(F.col("o_orderkey").cast("string").alias("window_key"))
    return R.topk_qc(R.top_actors(pooled(t), 2), man, teach(t), 2)
