"""EVD-* and LLM-*: evidence documents over line items, reasoning output over events and conversations."""

from pyspark.sql import functions as F

from roadsift.operators import evidence as D
from roadsift.operators import reasoning as L
from roadsift.plans.q_graph import NEAR, near
from roadsift.plans.registry import query

A = "window_key:s track_uuid:s"
TAGGED = NEAR + """, e0 AS (SELECT * EXCLUDE (ttc_s), CASE WHEN ttc_s < 0 THEN 0.01 WHEN ttc_s < 0.1 THEN 0.1 ELSE ttc_s END AS ttc_s, rank_by_r AS rank_s3, 1e0 / rank_by_r AS s3_score FROM near),
e1 AS (SELECT *, CASE WHEN dist_lt3 = 1 OR r_rel_m <= 6 THEN 'very_close' WHEN dist_lt5 = 1 OR r_rel_m <= 12 THEN 'close' WHEN dist_lt8 = 1 OR r_rel_m <= 18 THEN 'far' ELSE 'very_far' END AS distance_bucket,
  CASE WHEN y_rel_m > 0.5 THEN 'front_left' WHEN y_rel_m < -0.5 THEN 'front_right' ELSE 'front' END AS side_bucket, CASE WHEN ttc_s IS NULL THEN 'unknown' WHEN ttc_s <= 1 THEN 'critical' WHEN ttc_s <= 2.5 THEN 'low' WHEN ttc_s <= 5 THEN 'medium' ELSE 'high' END AS ttc_bucket,
  CASE WHEN heading_align_cos >= 0.5 THEN 'same' WHEN heading_align_cos <= -0.5 THEN 'opposite' ELSE 'crossing' END AS relative_heading_bucket, CASE WHEN rel_speed_closing_mps > 0.5 THEN 'closing' WHEN rel_speed_closing_mps < -0.5 THEN 'diverging' ELSE 'constant' END AS distance_trend_bucket,
  CASE WHEN abs(lat_speed_mps) > abs(rel_speed_closing_mps) THEN 'lateral_crossing' ELSE 'longitudinal' END AS cross_direction,
  CASE WHEN crossing_like >= 0.5 THEN 'crossing_like' WHEN approach_like >= 0.5 AND abs(lat_offset_m) >= 1.5 AND r_rel_m <= 25 THEN 'cut_in_like' WHEN on_path_like >= 0.5 AND approach_like >= 0.5 AND abs(lat_offset_m) < 1.5 THEN 'lead_brake_like' ELSE 'other' END AS trajectory_bucket FROM e0),
e2 AS (SELECT *, CASE WHEN is_vru = 1 AND crossing_like <> 0 THEN 'crossing_pedestrian' WHEN is_vru = 1 THEN CASE WHEN abs(lat_offset_m) >= 3 THEN 'side_pedestrian' ELSE 'other' END WHEN trajectory_bucket = 'crossing_like' THEN 'crossing_vehicle'
    WHEN trajectory_bucket IN ('lead_brake_like', 'cut_in_like') THEN 'lead_vehicle' ELSE 'other' END AS role_hint,
  coalesce(dist_lt3 = 1, FALSE) OR coalesce(on_path_like >= 0.5 AND ttc_s <= 1.5 AND r_rel_m <= 30, FALSE) OR coalesce(crossing_like >= 0.5 AND ttc_s <= 2 AND dist_to_crosswalk_m <= 10, FALSE) OR coalesce(distance_bucket IN ('very_close', 'close') AND ttc_s <= 3, FALSE) AS is_close,
  is_static = 1 OR (abs(rel_speed_closing_mps) < 0.3 AND abs(lat_speed_mps) < 0.3) AS is_stationary_actor FROM e1),
ms AS (SELECT window_key, min(dist_to_stopline_m) AS min_dist_to_stopline_m, min(dist_to_crosswalk_m) AS min_dist_to_crosswalk_m, arg_min(map_lane_offset_m, rank_s3) AS primary_lane_offset_m, count(*) FILTER (in_drivable_area = 1) AS num_actors_in_drivable_area, count(*) FILTER (in_drivable_area <> 1) AS num_actors_off_drivable_area,
  count(*) FILTER (dist_to_crosswalk_m <= 10 AND is_vru = 1) AS num_vru_near_crosswalk, 0 AS num_ped_near_crosswalk, CASE WHEN min(dist_to_crosswalk_m) <= 15 OR min(dist_to_stopline_m) <= 20 THEN 'urban' ELSE 'highway_like' END AS road_type_hint FROM e2 GROUP BY window_key),
hi AS (SELECT window_key, CASE WHEN arg_min(side_bucket, rank_s3) LIKE '%left%' THEN 'left' WHEN arg_min(side_bucket, rank_s3) LIKE '%right%' THEN 'right' ELSE 'center' END AS primary_side, min(dist_to_crosswalk_m) <= 10 AS near_crosswalk, min(dist_to_stopline_m) <= 12 AS near_stopline, bool_or(is_close) AS has_close_actor FROM e2 GROUP BY window_key),
sm AS (SELECT *, printf('%.1f', floor(r_rel_m * 10 + 0.5) / 10) AS rt, printf('%.1f', floor(ttc_s * 10 + 0.5) / 10) AS tt FROM e2),
ep AS (SELECT DISTINCT window_key, log_id, o_orderkey * 1e0 AS t_on, o_orderkey + 1e0 AS t_peak, o_orderkey + 2.3e0 AS t_off, (o_orderkey % 97) / 97e0 AS score_final, (o_orderkey % 31) / 7e0 AS peak FROM e2)"""


def tagged(t):
    df = near(t).withColumn("rank_s3", F.col("rank_by_r")).withColumn("s3_score", 1.0 / F.col("rank_by_r"))
    return D.tag_semantics(df)


def slices(t):
    k = F.col("o_orderkey")
    return near(t).select("window_key", "log_id", (k * F.lit(1.0)).alias("t_on"), (k + F.lit(1.0)).alias("t_peak"), (k + F.lit(2.3)).alias("t_off"), (k % 97 / 97.0).alias("score_final"), (k % 31 / 7.0).alias("peak_decel_mps2")).distinct()


def docs(t):
    keep = ["window_key", "log_id", "rank_s3", "track_uuid", "s3_score", "category", "is_vehicle", "is_vru", "is_static", "is_stationary_actor", "x_rel_m", "y_rel_m", "r_rel_m", "lat_offset_m", "dmin_m", "t_at_dmin_s", "rel_speed_closing_mps", "lat_speed_mps",
            "a_norm", "ttc_s", "dist_lt3", "dist_to_crosswalk_m", "dist_to_stopline_m", "in_drivable_area", "map_lane_offset_m", "map_lane_alignment_cos", "heading_align_cos", "length_m", "width_m", "on_path_like", "distance_bucket", "side_bucket", "ttc_bucket",
            "trajectory_bucket", "role_hint", "relative_heading_bucket", "distance_trend_bucket", "cross_direction", "is_close", "summary"]
    return D.evidence(slices(t), tagged(t).select(*keep))


@query("evd_01_tolerant_join", "window_key:s score:d", """WITH l AS (SELECT CAST(o_orderkey AS VARCHAR) AS window_key, o_custkey, o_orderkey * 1e0 AS t0, o_orderkey + 2e0 AS t1 FROM orders),
  r AS (SELECT o_custkey, o_orderkey + (o_orderkey % 9) / 20e0 AS r0, o_orderkey + 2e0 + (o_orderkey % 7) / 20e0 AS r1, o_totalprice AS score FROM orders UNION ALL SELECT o_custkey, o_orderkey + 0.11e0, o_orderkey + 2.07e0, -o_totalprice FROM orders WHERE o_orderkey % 3 = 0),
  b AS (SELECT window_key, arg_min(score, abs(t0 - r0) + abs(t1 - r1)) AS score FROM l JOIN r USING (o_custkey) WHERE abs(t0 - r0) <= 0.25 AND abs(t1 - r1) <= 0.25 GROUP BY window_key) SELECT l.window_key, score FROM l LEFT JOIN b USING (window_key)""")
def evd_01(t):
    k, log = F.col("o_orderkey"), F.col("o_custkey").cast("string").alias("log_id")
    left = t.orders.select(k.cast("string").alias("window_key"), log, (k * F.lit(1.0)).alias("t_start"), (k + F.lit(2.0)).alias("t_end"))
    right = t.orders.select(log, (k + k % 9 / 20.0).alias("r_start"), (k + F.lit(2.0) + k % 7 / 20.0).alias("r_end"), F.col("o_totalprice").alias("score")).unionByName(
        t.orders.where("o_orderkey % 3 = 0").select(log, (k + F.lit(0.11)).alias("r_start"), (k + F.lit(2.07)).alias("r_end"), (-F.col("o_totalprice")).alias("score")))
    return D.tolerant_join(left, right, ["score"])


PEAK = NEAR + """, s AS (SELECT window_key, log_id, track_uuid, rank_by_r AS rank, window_center + (o_orderkey % 6) / 10e0 AS t_peak FROM near), pk AS (SELECT s.window_key, s.rank, s.track_uuid, arg_min(f.dmin_m, abs(t_peak - f.window_center)) AS dmin_m FROM s JOIN idx AS f ON f.log_id = s.log_id AND f.track_uuid = s.track_uuid WHERE abs(t_peak - f.window_center) <= 0.25 GROUP BY ALL)"""


def _peak(t):
    n = near(t)
    sl = n.select("window_key", "log_id", (F.col("window_center") + F.col("o_orderkey") % 6 / 10.0).alias("t_peak")).distinct()
    return D.actor_at_peak(n.select("window_key", F.col("rank_by_r").alias("rank"), "track_uuid", F.lit(1.0).alias("score")), sl, n.select("log_id", "track_uuid", "window_center", "dmin_m"))


@query("evd_02_actor_at_peak", A + " rank_s3:n dmin_m:d", f"WITH {PEAK} SELECT *, rank AS rank_s3 FROM pk")
def evd_02(t):
    return _peak(t)[0]


@query("evd_02_unresolved", A + " rank:n", f"WITH {PEAK} SELECT window_key, track_uuid, rank FROM s WHERE (window_key, rank) NOT IN (SELECT window_key, rank FROM pk)")
def evd_02_unresolved(t):
    return _peak(t)[1]


def _col(name, spec, cols):
    @query(name, f"{A} {spec}", f"WITH {TAGGED} SELECT window_key, track_uuid, {cols} FROM e2")
    def fn(t):
        return tagged(t)
    return fn


_col("evd_03_normalise_ttc", "ttc_s:d", "ttc_s")
_col("evd_04_buckets", "distance_bucket:s side_bucket:s ttc_bucket:s relative_heading_bucket:s distance_trend_bucket:s", "distance_bucket, side_bucket, ttc_bucket, relative_heading_bucket, distance_trend_bucket")
_col("evd_05_cross_direction", "cross_direction:s", "cross_direction")
_col("evd_06_trajectory", "trajectory_bucket:s", "trajectory_bucket")
_col("evd_07_role_hint", "role_hint:s", "role_hint")
_col("evd_08_is_close", "is_close:b is_stationary_actor:b", "is_close, is_stationary_actor")


@query("evd_09_actor_summary", A + " summary:s", f"WITH {TAGGED} SELECT window_key, track_uuid, 'A ' || lower(category) || ', ~' || rt || ' m away, on the ' || replace(side_bucket, '_', ' ') || ', (' || replace(distance_bucket, '_', ' ') || '), ' || CASE WHEN ttc_s IS NULL THEN 'with unknown TTC' ELSE 'with TTC≈' || tt || ' s' END || ', showing ' || replace(trajectory_bucket, '_', ' ') || ' behaviour' || CASE WHEN role_hint <> 'other' THEN ', (role: ' || replace(role_hint, '_', ' ') || ')' ELSE '' END || '.' AS summary FROM sm")
def evd_09(t):
    return tagged(t)


@query("evd_10_map_summary", "window_key:s min_dist_to_stopline_m:d min_dist_to_crosswalk_m:d primary_lane_offset_m:d num_actors_in_drivable_area:n num_actors_off_drivable_area:n num_vru_near_crosswalk:n num_ped_near_crosswalk:n road_type_hint:s", f"WITH {TAGGED} SELECT * FROM ms")
def evd_10(t):
    return D.map_summary(tagged(t))


@query("evd_11_window_hints", "window_key:s primary_side:s near_crosswalk:b near_stopline:b has_close_actor:b", f"WITH {TAGGED} SELECT * FROM hi")
def evd_11(t):
    return D.window_hints(tagged(t))


FLAT = f"WITH {TAGGED}, ac AS (SELECT window_key, count(*) AS n_actors, string_agg(track_uuid, ',' ORDER BY rank_s3) AS tracks FROM e2 GROUP BY window_key) SELECT * FROM ep JOIN ac USING (window_key) JOIN ms USING (window_key) JOIN hi USING (window_key)"


@query("evd_12_evidence", "window_key:s log_id:s t_on:d score_final:d n_actors:n tracks:s road_type_hint:s primary_side:s min_dist_to_crosswalk_m:d has_close_actor:b", FLAT)
def evd_12(t):
    return docs(t).select("window_key", "log_id", "episode.t_on", "episode.score_final", F.size("actors").alias("n_actors"), F.array_join(F.transform("actors", lambda a: a["track_uuid"]), ",").alias("tracks"),
                          "map.road_type_hint", "hints.primary_side", "map.min_dist_to_crosswalk_m", "hints.has_close_actor")


@query("evd_12_manifest", "window_key:s n_actors:n primary_side:s has_close_actor:b road_type_hint:s", FLAT)
def evd_12_manifest(t):
    return D.manifest(docs(t))


@query("evd_13_attach_media", "window_key:s c_mktsegment:s", f"WITH {TAGGED} SELECT window_key, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS c_mktsegment FROM ep JOIN customer ON CAST(c_custkey AS VARCHAR) = log_id")
def evd_13(t):
    media = t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("log_id"), "c_mktsegment")
    return D.attach_media(docs(t), media)


def _b(c):
    return f"CASE WHEN {c} THEN 'True' ELSE 'False' END"


CTX = ("'The ego experiences a braking episode of about 2.3 s with peak deceleration of ' || printf('%.3f', floor(peak * 1000 + 0.5) / 1000) || ' m/s2 and final brake_confidence_score is ' || printf('%.3f', floor(score_final * 1000 + 0.5) / 1000) || '. The environment is classified as ' || road_type_hint || "
       "'. min_distance_to_crosswalk_m is ' || CAST(min_dist_to_crosswalk_m AS VARCHAR) || ', min_distance_to_stopline_m is ' || CAST(min_dist_to_stopline_m AS VARCHAR) || '. primary_interaction_side is ' || primary_side || '. ego_near_crosswalk=' || " + _b("near_crosswalk") +
       " || ', ego_near_stopline=' || " + _b("near_stopline") + " || ', has_close_actor=' || " + _b("has_close_actor") + " || '.'")


@query("evd_14_llm_input", "window_key:s context_brief:s actor_ids:s first_role:s", f"WITH {TAGGED}, ac AS (SELECT window_key, string_agg('ACTOR' || rank_s3, ',' ORDER BY rank_s3) AS actor_ids, arg_min(role_hint, rank_s3) AS first_role FROM e2 GROUP BY window_key) SELECT window_key, {CTX} AS context_brief, actor_ids, first_role FROM ep JOIN ac USING (window_key) JOIN ms USING (window_key) JOIN hi USING (window_key)")
def evd_14(t):
    d = D.llm_input(docs(t))
    return d.select("window_key", F.col("llm_input.context_brief").alias("context_brief"), F.array_join(F.transform("llm_input.actors", lambda a: a["actor_id"]), ",").alias("actor_ids"), F.col("llm_input.actors")[0]["heuristic_role_hint"].alias("first_role"))


@query("evd_15_evidence_qc", "window_key:s errors:s warnings:s", f"WITH {TAGGED} SELECT window_key, CASE WHEN CAST(log_id AS INT) % 5 = 0 THEN 'window_key_differs' ELSE '' END AS errors, CASE WHEN CAST(log_id AS INT) % 7 = 0 THEN 'primary_side_differs' ELSE '' END AS warnings FROM ep")
def evd_15(t):
    """Documents of some logs are damaged on purpose."""
    d = D.llm_input(docs(t))
    log = F.col("log_id").cast("int")
    broken = d.withColumn("window_key", F.when(log % 5 == 0, F.concat(F.lit("x"), "window_key")).otherwise(F.col("window_key"))) \
              .withColumn("hints", F.when(log % 7 == 0, F.col("hints").withField("primary_side", F.lit("none"))).otherwise(F.col("hints")))
    q = D.evidence_qc(broken)
    return q.select(F.regexp_replace("window_key", "^x", "").alias("window_key"), F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


# --- reasoning ------------------------------------------------------------------------------------------------

JS = """'{"ego_window_key": "w' || event_id || '", "actor_matrix": [{"actor_id": "ACTOR1", "risk_score": 0.5, "reasoning": "' || CASE WHEN event_id % 9 = 0 THEN ' ' ELSE 'near' END || '"}], "primary_responsible_actor": "ACTOR' || (event_id % 4) || '", "scenario_classification": "' || lb || '", ' || CASE WHEN event_id % 8 = 0 THEN '' ELSE '"final_rationale": "text", ' END || '"confidence_score": ' || CASE WHEN event_id % 10 = 0 THEN '"high"' ELSE '0.75' END || '}'"""
RAW = f"""rw AS (SELECT event_id, user_id, js, CASE event_id % 4 WHEN 0 THEN 'Answer: ```json' || chr(10) || js || chr(10) || '``` done' WHEN 1 THEN 'so ' || js || ' ok' WHEN 2 THEN '```json {{"a": 1}} ``` then ```json ' || js || ' ```' ELSE 'no answer' END AS raw
  FROM (SELECT *, {JS} AS js FROM (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 'cut_in' WHEN event_type = 'purchase' THEN 'other' ELSE event_type END AS lb FROM events)))"""


def raw(t):
    e = F.col("event_id")
    lb = F.when(F.col("event_type").isin("click", "view"), "cut_in").when(F.col("event_type") == "purchase", "other").otherwise(F.col("event_type"))
    js = F.concat(F.lit('{"ego_window_key": "w'), e.cast("string"), F.lit('", "actor_matrix": [{"actor_id": "ACTOR1", "risk_score": 0.5, "reasoning": "'), F.when(e % 9 == 0, " ").otherwise("near"), F.lit('"}], "primary_responsible_actor": "ACTOR'), (e % 4).cast("string"),
                  F.lit('", "scenario_classification": "'), lb, F.lit('", '), F.when(e % 8 == 0, "").otherwise('"final_rationale": "text", '), F.lit('"confidence_score": '), F.when(e % 10 == 0, '"high"').otherwise("0.75"), F.lit("}"))
    text = F.when(e % 4 == 0, F.concat(F.lit("Answer: ```json\n"), js, F.lit("\n``` done"))).when(e % 4 == 1, F.concat(F.lit("so "), js, F.lit(" ok"))).when(
        e % 4 == 2, F.concat(F.lit('```json {"a": 1} ``` then ```json '), js, F.lit(" ```"))).otherwise("no answer")
    return t.events.select("event_id", "user_id", js.alias("js"), text.alias("raw"))


@query("llm_01_render_prompt", "window_key:s prompt:s error:s", "SELECT conv_id || '-' || turn AS window_key, CASE WHEN role <> 'system' THEN 'Say: {\"role\":\"' || role || '\",\"n\":' || length(text) || '} end' END AS prompt, CASE WHEN role = 'system' THEN 'missing_input' END AS error FROM conversations")
def llm_01(t):
    d = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("window_key"), F.when(F.col("role") != "system", F.struct("role", F.length("text").alias("n"))).alias("llm_input"))
    return L.render_prompt(d, "Say: {scenario} end")


def _shout(texts):
    if any("error" in x.lower() for x in texts):
        raise ValueError("refused")
    return [x + "!" for x in texts]


@query("llm_02_infer", "window_key:s n:n failed:b", "SELECT conv_id || '-' || turn AS window_key, CASE WHEN NOT contains(lower(text), 'error') THEN length(text) + 1 END AS n, contains(lower(text), 'error') AS failed FROM conversations")
def llm_02(t):
    d = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("window_key"), F.col("text").alias("prompt"))
    return L.infer(d, _shout).select("window_key", F.length("raw").alias("n"), F.col("error").isNotNull().alias("failed"))


@query("llm_03_extract_json", "event_id:n candidate:s label:s", f"WITH {RAW} SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN js END AS candidate, CASE WHEN event_id % 4 <> 3 THEN json_extract_string(js, '$.scenario_classification') END AS label FROM rw")
def llm_03(t):
    return L.parse_output(raw(t)).select("event_id", "candidate", F.col("parsed.scenario_classification").alias("label"))


VALID = RAW + """, vd AS (SELECT event_id, concat_ws(',', CASE WHEN event_id % 4 = 3 THEN 'parsed_result_not_dict' END, CASE WHEN event_id % 4 <> 3 AND event_id % 9 = 0 THEN 'actor_empty_reasoning' END, CASE WHEN event_id % 4 = 0 THEN 'invalid_primary_responsible_actor_value' END,
  CASE WHEN event_id % 4 <> 3 AND json_extract_string(js, '$.scenario_classification') NOT IN ('cut_in', 'other') THEN 'invalid_scenario_classification' END, CASE WHEN event_id % 4 <> 3 AND event_id % 8 = 0 THEN 'missing_final_rationale' END, CASE WHEN event_id % 4 <> 3 AND event_id % 10 = 0 THEN 'confidence_score_not_numeric' END) AS errors FROM rw)"""


@query("llm_04_validate_output", "event_id:n errors:s ok:b", f"WITH {VALID} SELECT *, errors = '' AS ok FROM vd")
def llm_04(t):
    return L.validate_output(L.parse_output(raw(t))).select("event_id", F.array_join("errors", ",").alias("errors"), "ok")


@query("llm_04_pass_rate", "n:n passed:n pass_rate:d", f"WITH {VALID} SELECT count(*) AS n, count(*) FILTER (errors = '') AS passed, avg(CASE WHEN errors = '' THEN 1.0 ELSE 0.0 END) AS pass_rate FROM vd")
def llm_04_rate(t):
    return L.pass_rate(L.validate_output(L.parse_output(raw(t))))


@query("llm_05_actor_alias", "window_key:s alias:s rank:n track_uuid:s", f"WITH {TAGGED} SELECT window_key, 'ACTOR' || rank_s3 AS alias, rank_s3 AS rank, track_uuid FROM e2")
def llm_05(t):
    return L.actor_alias(docs(t))


# predictions: return flag of the nearest actor of each order as label, its rank as chosen actor; tags: status of a customer's first order
PRED = TAGGED + """, pd AS (SELECT window_key, log_id, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o.o_orderkey % 3 = 0 THEN 'other' ELSE 'cut_in' END WHEN 'O' THEN 'lead_brake' ELSE 'other' END AS label, 'ACTOR' || (1 + o.o_orderkey % 3) AS primary FROM ep JOIN orders AS o ON CAST(o.o_orderkey AS VARCHAR) = window_key),
al AS (SELECT window_key, 'ACTOR' || rank_s3 AS primary, rank_s3 AS rank, track_uuid FROM e2),
tg AS (SELECT CAST(c_custkey AS VARCHAR) AS log_id, CASE c_custkey % 3 WHEN 0 THEN 'cut_in' WHEN 1 THEN 'lead_brake' ELSE 'other' END AS tag, fa.track_uuid AS guest_id FROM customer LEFT JOIN (SELECT log_id, arg_min(track_uuid, o_orderkey * 10 + rank_s3) AS track_uuid FROM e2 GROUP BY log_id) AS fa ON fa.log_id = CAST(c_custkey AS VARCHAR)
  WHERE c_custkey % 4 <> 0 AND CAST(c_custkey AS VARCHAR) IN (SELECT log_id FROM ep)),
rj AS (SELECT pd.log_id, tag, guest_id, pd.window_key, label, rank, al.track_uuid, label = tag AS hit, coalesce(al.track_uuid = guest_id, FALSE) AS am FROM pd JOIN tg USING (log_id) LEFT JOIN al ON al.window_key = pd.window_key AND al.primary = pd.primary),
rep AS (SELECT *, track_uuid = guest_id AS actor_match FROM (SELECT *, bool_or(hit) OVER (PARTITION BY log_id) AS any_hit, row_number() OVER (PARTITION BY log_id ORDER BY NOT hit, NOT (hit AND am), window_key) AS k FROM rj) WHERE k = 1),
cl AS (SELECT label, count(*) FILTER (tag = label AND p = label) AS tp, count(*) FILTER (tag <> label AND p = label) AS fp, count(*) FILTER (tag = label AND p <> label) AS fn, count(*) FILTER (tag <> label AND p <> label) AS tn, count(*) FILTER (tag = label) AS support FROM (SELECT tag, label AS p FROM rep), (VALUES ('cut_in'), ('lead_brake'), ('other')) AS v(label) GROUP BY label),
cm AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM cl), cf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1 FROM cm)"""


def preds(t):
    k = F.col("o_orderkey")
    o = t.orders.select(k.cast("string").alias("window_key"), F.when(F.col("o_orderstatus") == "F", F.when(k % 3 == 0, "other").otherwise("cut_in")).when(F.col("o_orderstatus") == "O", "lead_brake").otherwise("other").alias("label"),
                        F.concat(F.lit("ACTOR"), (1 + k % 3).cast("string")).alias("primary"))
    return slices(t).select("window_key", "log_id").join(o, "window_key")


def alias(t):
    return near(t).select("window_key", F.concat(F.lit("ACTOR"), F.col("rank_by_r").cast("string")).alias("alias"), F.col("rank_by_r").alias("rank"), "track_uuid")


def tags(t):
    c = F.col("c_custkey")
    first = near(t).groupBy("log_id").agg(F.min_by("track_uuid", F.col("o_orderkey") * 10 + F.col("rank_by_r")).alias("guest_id"))
    raw_tags = t.customer.where("c_custkey % 4 <> 0").select(c.cast("string").alias("log_id"), F.when(c % 3 == 0, "cut_in").when(c % 3 == 1, "lead_brake").otherwise("other").alias("tag"), c.alias("seq"), F.lit(False).alias("is_host")).join(first, "log_id", "left")
    return L.gt_tags(raw_tags, slices(t))


@query("llm_06_gt_tags", "log_id:s tag:s guest_id:s", f"WITH {PRED} SELECT * FROM tg")
def llm_06(t):
    return tags(t)


def rep(t):
    return L.representative(preds(t), tags(t), alias(t))


@query("llm_07_representative", "log_id:s window_key:s label:s any_hit:b rank:n actor_match:b", f"WITH {PRED} SELECT * FROM rep")
def llm_07(t):
    return rep(t)


@query("llm_08_confusion", "truth:s cut_in:n lead_brake:n other:n", f"WITH {PRED} SELECT tag AS truth, count(*) FILTER (label = 'cut_in') AS cut_in, count(*) FILTER (label = 'lead_brake') AS lead_brake, count(*) FILTER (label = 'other') AS other FROM rep GROUP BY tag")
def llm_08(t):
    return L.confusion(rep(t), ["cut_in", "lead_brake", "other"])


@query("llm_08_class_metrics", "label:s tp:n fp:n fn:n tn:n support:n precision:d recall:d f1:d", f"WITH {PRED} SELECT * FROM cf")
def llm_08_classes(t):
    return L.class_metrics(rep(t))


@query("llm_08_macro", "accuracy:d macro_precision:d macro_recall:d macro_f1:d", f"WITH {PRED} SELECT sum(tp) / sum(support) AS accuracy, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM cf")
def llm_08_macro(t):
    return L.macro_metrics(L.class_metrics(rep(t)))


@query("llm_09_hit_accuracy", "logs:n hit_accuracy:d", f"WITH {PRED} SELECT count(*) AS logs, avg(CASE WHEN any_hit THEN 1.0 ELSE 0.0 END) AS hit_accuracy FROM rep")
def llm_09(t):
    return L.hit_accuracy(preds(t), tags(t))


ALIGN = "SELECT count(*) AS n, avg(CASE WHEN coalesce(rank, 99) = 1 THEN 1.0 ELSE 0.0 END) AS rank1, avg(CASE WHEN coalesce(rank, 99) <= 2 THEN 1.0 ELSE 0.0 END) AS top2 FROM pd LEFT JOIN al ON al.window_key = pd.window_key AND al.primary = pd.primary"


@query("llm_10_alignment", "n:n rank1:d top2:d", f"WITH {PRED} {ALIGN}")
def llm_10(t):
    return L.alignment(preds(t), alias(t))


@query("llm_11_gt_actor_match", "n:n rate:d", f"WITH {PRED} SELECT count(*) AS n, avg(CASE WHEN actor_match THEN 1.0 ELSE 0.0 END) AS rate FROM rep WHERE guest_id IS NOT NULL AND track_uuid IS NOT NULL")
def llm_11(t):
    return L.gt_actor_match(rep(t))


@query("llm_12_new_logs", "log_id:s modal_label:s n_labelled:n n_windows:n", f"WITH {PRED}, c AS (SELECT log_id, label, count(*) AS n FROM pd WHERE log_id NOT IN (SELECT log_id FROM tg) GROUP BY ALL), w AS (SELECT log_id, sum(n) AS n_windows FROM c GROUP BY log_id) SELECT c.log_id, arg_min(label, -n * 1000 + ascii(label)) AS modal_label, sum(n) AS n_labelled, any_value(n_windows) AS n_windows FROM c JOIN w USING (log_id) WHERE label <> 'other' GROUP BY c.log_id")
def llm_12(t):
    return L.new_logs(preds(t), tags(t))


def _two(t):
    k = F.col("window_key").cast("bigint")
    return L.agreement(preds(t).where(k % 4 != 0), preds(t).where(k % 5 != 0).withColumn("label", F.when(k % 7 == 0, "other").otherwise(F.col("label"))))


PAIRS = PRED + """, a AS (SELECT window_key, label AS label_a FROM pd WHERE CAST(window_key AS BIGINT) % 4 <> 0), b AS (SELECT window_key, CASE WHEN CAST(window_key AS BIGINT) % 7 = 0 THEN 'other' ELSE label END AS label_b FROM pd WHERE CAST(window_key AS BIGINT) % 5 <> 0), ab AS (SELECT *, label_a = label_b AS agree FROM a FULL JOIN b USING (window_key))"""


@query("llm_13_agreement", "window_key:s label_a:s label_b:s agree:b", f"WITH {PAIRS} SELECT * FROM ab")
def llm_13(t):
    return _two(t)


@query("llm_13_agreement_rate", "shared:n rate:d windows:n", f"WITH {PAIRS} SELECT count(agree) AS shared, avg(CASE WHEN agree THEN 1.0 WHEN NOT agree THEN 0.0 END) AS rate, count(*) AS windows FROM ab")
def llm_13_rate(t):
    return L.agreement_rate(_two(t))


@query("llm_14_summary", "section:s metric:s value:d", f"WITH {PRED}, x AS ({ALIGN}) SELECT 'alignment' AS section, 'n' AS metric, n::DOUBLE AS value FROM x UNION ALL SELECT 'alignment', 'rank1', rank1 FROM x UNION ALL SELECT 'alignment', 'top2', top2 FROM x UNION ALL SELECT 'logs', 'logs', count(*) FROM rep UNION ALL SELECT 'logs', 'hit_accuracy', avg(CASE WHEN any_hit THEN 1.0 ELSE 0.0 END) FROM rep")
def llm_14(t):
    return L.summary(alignment=L.alignment(preds(t), alias(t)), logs=L.hit_accuracy(preds(t), tags(t)))
