"""Nested evidence documents per window (EVD-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadsift.functions.intervals import near_join

# Scenario words that must not show up in the context of a document.
LEAK_TOKENS = ["cut_in", "ped_cross", "obj_cross", "lead_brake", "approach_stop"]
# Names of actor fields in the reasoning input and the evidence fields they come from.
RENAMED = {"category": "category", "is_vehicle": "is_vehicle", "is_vulnerable_road_user": "is_vru", "is_static": "is_static",
           "is_stationary_actor": "is_stationary_actor", "ego_forward_offset_m": "x_rel_m", "ego_lateral_offset_m": "y_rel_m",
           "lane_center_offset_m": "lat_offset_m", "closest_distance_during_episode_m": "dmin_m", "time_when_closest_s": "t_at_dmin_s",
           "relative_closing_speed_mps": "rel_speed_closing_mps", "relative_lateral_speed_mps": "lat_speed_mps",
           "relative_motion_norm_mps2": "a_norm", "time_to_collision_s": "ttc_s", "distance_to_crosswalk_m": "dist_to_crosswalk_m",
           "distance_to_stopline_m": "dist_to_stopline_m", "in_drivable_area": "in_drivable_area", "lane_alignment_cosine": "map_lane_alignment_cos",
           "heading_alignment_cosine": "heading_align_cos", "length_m": "length_m", "width_m": "width_m", "gat_rank": "rank_s3", "gat_score": "s3_score",
           "heuristic_distance_bucket": "distance_bucket", "heuristic_side_bucket": "side_bucket", "heuristic_ttc_bucket": "ttc_bucket",
           "heuristic_trajectory_type": "trajectory_bucket", "heuristic_role_hint": "role_hint",
           "heuristic_relative_heading_bucket": "relative_heading_bucket", "heuristic_distance_trend_bucket": "distance_trend_bucket",
           "heuristic_cross_direction": "cross_direction"}


def tolerant_join(left: DataFrame, right: DataFrame, cols: Sequence[str], tol: float = 0.25, key: str = "window_key",
                  l: tuple[str, str] = ("t_start", "t_end"), r: tuple[str, str] = ("r_start", "r_end")) -> DataFrame:
    """EVD-01: columns of the right row of the same log whose start and end are within ``tol``, smallest sum first."""
    near = near_join(left.select("log_id", key, *l), right.select("log_id", *r, *cols), ["log_id"], l[0], r[0], tol)
    gap = F.abs(F.col(l[0]) - F.col(r[0])) + F.abs(F.col(l[1]) - F.col(r[1]))
    best = near.where(F.abs(F.col(l[1]) - F.col(r[1])) <= tol).groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(gap, *r)).alias("_b"))
    return left.join(best, key, "left").select(*left.columns, *[F.col("_b")[c].alias(c) for c in cols])


def actor_at_peak(topk: DataFrame, slices: DataFrame, features: DataFrame, tol: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """EVD-02: feature row of each ranked actor nearest to the peak, and the actors that have none."""
    want = topk.select("window_key", "rank", "track_uuid", F.col("score").alias("s3_score")).join(slices.select("window_key", "log_id", "t_peak"), "window_key")
    feats = features.select("log_id", "track_uuid", "window_center", F.struct(*[c for c in features.columns if c not in ("log_id", "track_uuid", "window_key")]).alias("_f"))
    near = near_join(want, feats, ["log_id", "track_uuid"], "t_peak", "window_center", tol)
    best = near.groupBy("window_key", "log_id", "t_peak", "rank", "track_uuid", "s3_score").agg(
        F.min_by("_f", F.struct(F.abs(F.col("t_peak") - F.col("window_center")), "window_center")).alias("_f"))
    return best.select("window_key", "log_id", "t_peak", F.col("rank").alias("rank_s3"), "track_uuid", "s3_score", "_f.*"), \
        want.join(best.select("window_key", "rank"), ["window_key", "rank"], "left_anti")


def normalise_ttc(ttc: Column) -> Column:
    """EVD-03: passed events become very urgent, tiny values at least 0.1 s."""
    return F.when(ttc < 0, 0.01).when(ttc < 0.1, 0.1).otherwise(ttc)


def bucket_distance() -> Column:
    r = F.col("r_rel_m")
    return F.when(r.isNull(), "unknown").when((F.col("dist_lt3") == 1) | (r <= 6), "very_close") \
            .when((F.col("dist_lt5") == 1) | (r <= 12), "close").when((F.col("dist_lt8") == 1) | (r <= 18), "far").otherwise("very_far")


def bucket_side() -> Column:
    y = F.coalesce("y_rel_m", "lat_offset_m")
    return F.when(y > 0.5, "front_left").when(y < -0.5, "front_right").otherwise("front")


def bucket_ttc() -> Column:
    t = F.col("ttc_s")
    return F.when(t.isNull(), "unknown").when(t <= 1, "critical").when(t <= 2.5, "low").when(t <= 5, "medium").otherwise("high")


def bucket_heading() -> Column:
    c = F.col("heading_align_cos")
    return F.when(c.isNull(), "unknown").when(c >= 0.5, "same").when(c <= -0.5, "opposite").otherwise("crossing")


def bucket_trend() -> Column:
    v = F.col("rel_speed_closing_mps")
    return F.when(v.isNull(), "unknown").when(v > 0.5, "closing").when(v < -0.5, "diverging").otherwise("constant")


def cross_direction() -> Column:
    """EVD-05: whether lateral motion dominates."""
    lon, lat = F.abs("rel_speed_closing_mps"), F.abs("lat_speed_mps")
    zero = F.lit(0.0)
    return F.when(lon.isNull() & lat.isNull(), "unknown").when(F.coalesce(lat, zero) > F.coalesce(lon, zero), "lateral_crossing").otherwise("longitudinal")


def trajectory() -> Column:
    """EVD-06: crossing, cut-in, lead-brake or other."""
    zero = F.lit(0.0)
    near, lat = F.coalesce("approach_like", zero) >= 0.5, F.coalesce(F.abs("lat_offset_m"), zero)
    return F.when(F.coalesce("crossing_like", zero) >= 0.5, "crossing_like") \
            .when(near & (lat >= 1.5) & (F.coalesce("r_rel_m", F.lit(999.0)) <= 25), "cut_in_like") \
            .when((F.coalesce(F.col("on_path_like").cast("double"), zero) >= 0.5) & near & (lat < 1.5), "lead_brake_like").otherwise("other")


def role_hint() -> Column:
    """EVD-07: coarse role, crossing vulnerable road users refined; needs trajectory_bucket and side_bucket."""
    vru = F.col("is_vru") == 1
    base = F.when(vru | F.upper("category").contains("PEDESTRIAN"), F.when(F.abs("lat_offset_m") >= 3, "side_pedestrian").otherwise("other")) \
            .when(F.col("trajectory_bucket") == "crossing_like", "crossing_vehicle") \
            .when(F.col("trajectory_bucket").isin("lead_brake_like", "cut_in_like") & F.col("side_bucket").startswith("front"), "lead_vehicle").otherwise("other")
    return F.when(vru & (F.coalesce("crossing_like", F.lit(0.0)) != 0), "crossing_pedestrian").otherwise(base)


def is_close() -> Column:
    """EVD-08: four alternative rules for a close actor; needs distance_bucket."""
    def ok(c):
        return F.coalesce(c, F.lit(False))
    t = F.col("ttc_s")
    return (ok(F.col("dist_lt3") == 1) | ok((F.col("on_path_like") >= 0.5) & (t <= 1.5) & (F.col("r_rel_m") <= 30))
            | ok((F.col("crossing_like") >= 0.5) & (t <= 2) & (F.col("dist_to_crosswalk_m") <= 10))
            | ok(F.col("distance_bucket").isin("very_close", "close") & (t <= 3)))


def is_stationary(eps: float = 0.3) -> Column:
    """EVD-08: a static object, or hardly any closing and lateral speed; an unknown speed does not count as low."""
    slow = (F.abs("rel_speed_closing_mps") < eps) & (F.abs("lat_speed_mps") < eps)
    return (F.coalesce(F.col("is_static"), F.lit(0)) == 1) | F.coalesce(slow, F.lit(False))


def actor_summary() -> Column:
    """EVD-09: one sentence about an actor; tenths are rounded as numbers, half up, not by the digits that a format would print."""
    def tenths(c):
        return F.floor(F.col(c) * 10 + 0.5) / F.lit(10.0)

    def words(c):
        return F.replace(F.col(c), F.lit("_"), F.lit(" "))
    dist = F.when(F.col("r_rel_m").isNull(), "at unknown distance").otherwise(F.format_string("~%.1f m away", tenths("r_rel_m")))
    when = F.when(F.col("ttc_s").isNull(), "with unknown TTC").otherwise(F.format_string("with TTC≈%.1f s", tenths("ttc_s")))
    role = F.when(F.col("role_hint") != "other", F.concat(F.lit(", (role: "), words("role_hint"), F.lit(")"))).otherwise("")
    return F.concat(F.lit("A "), F.lower(F.replace("category", F.lit("_"), F.lit(" "))), F.lit(", "), dist, F.lit(", on the "), words("side_bucket"),
                    F.lit(", ("), words("distance_bucket"), F.lit("), "), when, F.lit(", showing "), words("trajectory_bucket"), F.lit(" behaviour"), role, F.lit("."))


def tag_semantics(actors: DataFrame) -> DataFrame:
    """EVD-03...09 as columns of actor rows."""
    df = actors.withColumn("ttc_s", normalise_ttc(F.col("ttc_s"))).withColumns({
        "distance_bucket": bucket_distance(), "side_bucket": bucket_side(), "ttc_bucket": bucket_ttc(), "relative_heading_bucket": bucket_heading(),
        "distance_trend_bucket": bucket_trend(), "cross_direction": cross_direction(), "trajectory_bucket": trajectory()})
    df = df.withColumns({"role_hint": role_hint(), "is_close": is_close(), "is_stationary_actor": is_stationary().cast("int")})
    return df.withColumn("summary", actor_summary())


def map_summary(actors: DataFrame) -> DataFrame:
    """EVD-10: map facts per window from its ranked actors."""
    cross = F.col("dist_to_crosswalk_m") <= 10
    first = F.min(F.struct("rank_s3", "map_lane_offset_m", "map_lane_alignment_cos"))
    df = actors.groupBy("window_key").agg(
        F.min("dist_to_stopline_m").alias("min_dist_to_stopline_m"), F.min("dist_to_crosswalk_m").alias("min_dist_to_crosswalk_m"), first.alias("_f"),
        F.count_if(F.coalesce("in_drivable_area", F.lit(1.0)) == 1).alias("num_actors_in_drivable_area"), F.count_if(F.coalesce("in_drivable_area", F.lit(1.0)) != 1).alias("num_actors_off_drivable_area"),
        F.count_if(cross & (F.col("is_vru") == 1)).alias("num_vru_near_crosswalk"), F.count_if(cross & F.upper("category").contains("PEDESTRIAN")).alias("num_ped_near_crosswalk"))
    urban = F.coalesce(F.col("min_dist_to_crosswalk_m") <= 15, F.lit(False)) | F.coalesce(F.col("min_dist_to_stopline_m") <= 20, F.lit(False))
    return df.withColumns({"primary_lane_offset_m": F.col("_f.map_lane_offset_m"), "primary_lane_alignment_cos": F.col("_f.map_lane_alignment_cos"),
                           "road_type_hint": F.when(urban, "urban").otherwise("highway_like")}).drop("_f")


def window_hints(actors: DataFrame) -> DataFrame:
    """EVD-11: side of the first actor, nearness to crosswalk and stop line, any close actor."""
    side = F.min_by("side_bucket", "rank_s3")
    return actors.groupBy("window_key").agg(
        F.when(side.contains("left"), "left").when(side.contains("right"), "right").otherwise("center").alias("primary_side"),
        F.coalesce(F.min("dist_to_crosswalk_m") <= 10, F.lit(False)).alias("near_crosswalk"), F.coalesce(F.min("dist_to_stopline_m") <= 12, F.lit(False)).alias("near_stopline"),
        F.bool_or("is_close").alias("has_close_actor"))


def evidence(slices: DataFrame, actors: DataFrame) -> DataFrame:
    """EVD-12: one nested document per window: episode, ranked actors, map and hints.

    ``slices`` holds window_key, t_on, t_peak, t_off, score_final, peak_decel_mps2; ``actors`` are the at most three ranked,
    tagged actors of each window, so the nested array is short.
    """
    fields = [c for c in actors.columns if c not in ("window_key", "log_id", "t_peak", "rank_s3")]
    nested = actors.groupBy("window_key").agg(F.array_sort(F.collect_list(F.struct("rank_s3", *fields))).alias("actors"))
    m, h = map_summary(actors), window_hints(actors)
    episode = F.struct("t_on", "t_peak", "t_off", "score_final", "peak_decel_mps2")
    return slices.select("window_key", "log_id", episode.alias("episode")).join(nested, "window_key") \
        .join(m.select("window_key", F.struct(*[c for c in m.columns if c != "window_key"]).alias("map")), "window_key") \
        .join(h.select("window_key", F.struct(*[c for c in h.columns if c != "window_key"]).alias("hints")), "window_key")


def manifest(docs: DataFrame) -> DataFrame:
    """EVD-12: flat list of the documents."""
    return docs.select("window_key", "log_id", F.size("actors").alias("n_actors"), F.col("hints.primary_side").alias("primary_side"),
                       F.col("hints.has_close_actor").alias("has_close_actor"), F.col("map.road_type_hint").alias("road_type_hint"))


def attach_media(docs: DataFrame, media: DataFrame) -> DataFrame:
    """EVD-13: optional media columns by log."""
    return docs.join(media.groupBy("log_id").agg(*[F.min(c).alias(c) for c in media.columns if c != "log_id"]), "log_id", "left")


def _py(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def _flag(c: Column) -> Column:
    return F.when(c, "True").when(~c, "False").otherwise("None")


def llm_input(docs: DataFrame) -> DataFrame:
    """EVD-14: the renamed projection a reasoning model reads, with a context sentence."""
    def actor(a):
        return F.struct(F.concat(F.lit("ACTOR"), a["rank_s3"].cast("string")).alias("actor_id"), *[a[src].alias(name) for name, src in RENAMED.items()],
                        (a["dist_lt3"] == 1).cast("int").alias("ever_within_3m"), a["is_close"].cast("int").alias("heuristic_is_close"),
                        F.coalesce((a["on_path_like"] >= 0.5).cast("int"), F.lit(0)).alias("on_ego_path"))
    e, m, h = (lambda c: F.col(f"episode.{c}")), (lambda c: F.col(f"map.{c}")), (lambda c: F.col(f"hints.{c}"))
    dur = e("t_off") - e("t_on")
    text = F.concat_ws(
        " ",
        F.coalesce(F.format_string("The ego experiences a braking episode of about %.1f s", F.when(dur.isNotNull(), dur)), F.lit("The ego experiences a braking episode of unknown duration")),
        F.when(e("peak_decel_mps2").isNotNull(), F.format_string("with peak deceleration of %.3f m/s2", e("peak_decel_mps2"))).otherwise("with unknown peak deceleration"),
        F.when(e("score_final").isNotNull(), F.format_string("and final brake_confidence_score is %.3f.", e("score_final"))).otherwise("and brake confidence score is unknown."),
        F.concat(F.lit("The environment is classified as "), m("road_type_hint"), F.lit(".")),
        F.concat(F.lit("min_distance_to_crosswalk_m is "), _py(m("min_dist_to_crosswalk_m")), F.lit(", min_distance_to_stopline_m is "), _py(m("min_dist_to_stopline_m")), F.lit(".")),
        F.concat(F.lit("primary_interaction_side is "), _py(h("primary_side")), F.lit(".")),
        F.concat(F.lit("ego_near_crosswalk="), _flag(h("near_crosswalk")), F.lit(", ego_near_stopline="), _flag(h("near_stopline")), F.lit(", has_close_actor="), _flag(h("has_close_actor")), F.lit(".")))
    body = F.struct(
        F.col("window_key").alias("ego_window_key"),
        F.struct(e("t_on").alias("t_start_s"), e("t_peak").alias("t_peak_brake_s"), e("t_off").alias("t_end_s"), e("score_final").alias("brake_confidence_score"), e("peak_decel_mps2").alias("peak_deceleration_mps2")).alias("ego_brake_episode"),
        text.alias("context_brief"), F.transform("actors", actor).alias("actors"),
        F.struct(m("min_dist_to_crosswalk_m").alias("min_distance_to_crosswalk_m"), m("min_dist_to_stopline_m").alias("min_distance_to_stopline_m"), *[m(c) for c in (
            "num_actors_in_drivable_area", "num_actors_off_drivable_area", "num_vru_near_crosswalk", "num_ped_near_crosswalk", "road_type_hint")]).alias("ego_map_summary"),
        F.struct(h("primary_side").alias("primary_interaction_side"), h("near_crosswalk").alias("ego_near_crosswalk"), h("near_stopline").alias("ego_near_stopline"), h("has_close_actor")).alias("scenario_hints"))
    return docs.withColumn("llm_input", body)


def evidence_qc(docs: DataFrame) -> DataFrame:
    """EVD-15: errors and warnings of each document as sorted arrays."""
    i = F.col("llm_input")

    def when(cond, name):
        return F.when(F.coalesce(cond, F.lit(True)), F.lit(name))
    by_rank = F.map_from_entries(F.transform("actors", lambda a: F.struct(a["rank_s3"].cast("int"), F.struct(a["category"].alias("category"), a["is_vehicle"].alias("is_vehicle"), a["is_vru"].alias("is_vru")))))

    def any_actor(test):
        return F.exists(i["actors"], test)
    full = lambda a, f: F.try_element_at(by_rank, a["gat_rank"].cast("int"))[f]
    errors = [when(~F.col("window_key").eqNullSafe(i["ego_window_key"]), "window_key_differs"), when(F.size(i["actors"]) <= 0, "no_actors"),
              when(any_actor(lambda a: a["actor_id"] != F.concat(F.lit("ACTOR"), a["gat_rank"].cast("string"))), "actor_id_differs"),
              when(any_actor(lambda a: ~a["category"].eqNullSafe(full(a, "category")) & full(a, "category").isNotNull()), "category_differs"),
              when(any_actor(lambda a: a["is_vehicle"] != full(a, "is_vehicle")), "is_vehicle_differs"),
              when(any_actor(lambda a: a["is_vulnerable_road_user"] != full(a, "is_vru")), "is_vru_differs"), when(any_actor(lambda a: ~a["on_ego_path"].isin(0, 1)), "on_ego_path_not_flag")]

    def differ(a, b):
        return F.abs(a - b) > 1e-6
    m, h = i["ego_map_summary"], i["scenario_hints"]
    warns = [F.when(F.size(i["actors"]) != F.size("actors"), "actor_count_differs"), F.when(differ(m["min_distance_to_crosswalk_m"], F.col("map.min_dist_to_crosswalk_m")), "crosswalk_distance_differs"),
             F.when(differ(m["min_distance_to_stopline_m"], F.col("map.min_dist_to_stopline_m")), "stopline_distance_differs"),
             F.when(~h["primary_interaction_side"].eqNullSafe(F.col("hints.primary_side")), "primary_side_differs"), F.when(h["has_close_actor"] != F.col("hints.has_close_actor"), "has_close_actor_differs"),
             *[F.when(F.lower(i["context_brief"]).contains(t), f"context_leaks:{t}") for t in LEAK_TOKENS]]
    return docs.select("window_key", F.array_compact(F.array(*errors)).alias("errors"), F.array_compact(F.array(*warns)).alias("warnings"))
