"""Window graphs, physics teacher and actor ranking (GRF-*)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadsift.functions.durable import stored
from roadsift.functions.intervals import interval_iou, overlap_join
from roadsift.functions.quantiles import group_quantiles
from roadsift.operators.pu import ordered_split

# Phases with their coefficients, trend strengths and edge types of the published configuration.
PHASES = (("pre", 0.2), ("onset", 0.4), ("mid", 0.7), ("peak", 1.0), ("post", 0.4))
TREND = {"r": 0.15, "ttc": 0.20, "dmin": 0.20, "overlap": 0.15, "closing": 0.25, "align": 0.10, "pull": 0.05}
EDGE_TYPES = ("ego_to_actor", "actor_to_ego", "actor_to_actor_spatial", "actor_temporal")
VEHICLES = ["REGULAR_VEHICLE", "TRUCK", "BUS", "LARGE_VEHICLE", "BOX_TRUCK"]
VULNERABLE = ["PEDESTRIAN", "BICYCLE", "MOTORCYCLE"]
SIGNS = ["BOLLARD", "STOP_SIGN", "SIGN"]
WIN = "window_key"


def slices(index: DataFrame, w: tuple[float, float, float] = (0.2, 0.6, 0.2)) -> DataFrame:
    """GRF-01: one slice per window: onset at its start, peak at its centre, three phase weights."""
    t0, t1 = F.col("window_t_start"), F.col("window_t_end")
    return index.select("log_id", WIN, t0.alias("t0"), t1.alias("t1")).distinct().withColumns({
        "t_on": F.col("t0"), "t_peak": 0.5 * (F.col("t0") + F.col("t1")), "w_pre": F.lit(w[0]), "w_peak": F.lit(w[1]),
        "w_post": F.lit(w[2]), "peak_source": F.lit("fallback_center")})


def refine_peaks(sl: DataFrame, scored: DataFrame, eps: float = 0.25, iou: float = 0.5) -> DataFrame:
    """GRF-02: peak at the centre of the best matching scored window, with the reason when none matches."""
    cand = overlap_join(sl.select("log_id", WIN, "t0", "t1"), scored.select("log_id", "t_start", "t_end", "post_hmm"), ["log_id"],
                        ("t0", "t1"), ("t_start", "t_end"), pad=eps)
    cand = cand.withColumn("iou", interval_iou(F.col("t0"), F.col("t1"), F.col("t_start"), F.col("t_end"), "hull", 1e-9))
    near = (F.abs(F.col("t0") - F.col("t_start")) <= eps) & (F.abs(F.col("t1") - F.col("t_end")) <= eps)
    best = cand.where(near | (F.col("iou") >= iou)).groupBy(WIN).agg(
        F.max_by(0.5 * (F.col("t_start") + F.col("t_end")), F.struct("iou", "post_hmm", -F.col("t_start"))).alias("_peak"))
    known = scored.select("log_id").distinct().withColumn("_known", F.lit(True))
    out = sl.join(best, WIN, "left").join(known, "log_id", "left")
    return out.withColumns({
        "t_peak": F.coalesce("_peak", "t_peak"),
        "peak_source": F.when(F.col("_peak").isNotNull(), "hmm_max_post").otherwise(F.col("peak_source")),
        "unmatched_reason": F.when(F.col("_known").isNull(), "no_log_in_hmm").when(F.col("_peak").isNull(), "no_overlap_match")}).drop("_peak", "_known")


def tall(df: DataFrame) -> DataFrame:
    """A one-row frame as (metric, value) rows."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                         for c in df.columns])).alias("r")).select("r.*")


def slice_qc(sl: DataFrame, scored: DataFrame, index: DataFrame, tol: float = 1e-6) -> DataFrame:
    """GRF-03: (metric, value) checks of the slices."""
    dup = sl.groupBy(WIN).count().agg(F.sum(F.col("count") - 1).alias("duplicate_keys"))
    w = F.col("w_pre") + F.col("w_peak") + F.col("w_post")
    checks = sl.agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("t1") <= F.col("t0")).alias("bad_order"),
                    F.count_if(F.abs(F.col("t_on") - F.col("t0")) > tol).alias("onset_mismatch"),
                    F.count_if((F.col("t_peak") < F.col("t0") - tol) | (F.col("t_peak") > F.col("t1") + tol)).alias("peak_outside"),
                    F.count_if(F.least("w_pre", "w_peak", "w_post") < 0).alias("negative_weight"),
                    F.count_if(F.abs(w - 1.0) > 1e-6).alias("weights_not_one"),
                    F.count_if(F.col("peak_source") == "hmm_max_post").alias("peak_needed"))
    need = sl.where("peak_source = 'hmm_max_post'").select("log_id", WIN, "t0", "t1")
    mid = scored.select("log_id", (0.5 * (F.col("t_start") + F.col("t_end"))).alias("m0")).withColumn("m1", F.col("m0"))
    ok = overlap_join(need, mid, ["log_id"], ("t0", "t1"), ("m0", "m1"), pad=tol).select(WIN).distinct().agg(F.count(F.lit(1)).alias("peak_verified"))
    missing = sl.join(index.select(WIN).distinct(), WIN, "left_anti").agg(F.count(F.lit(1)).alias("missing_in_index"))
    return tall(checks).unionByName(tall(dup)).unionByName(tall(ok)).unionByName(tall(missing))


def nearest_actors(index: DataFrame, n: int = 15) -> DataFrame:
    """GRF-04: the nearest ``n`` actors of each window."""
    w = Window.partitionBy(WIN).orderBy("r_rel_m", "track_uuid")
    return index.withColumn("rank_by_r", F.row_number().over(w)).where(F.col("rank_by_r") <= n)


def attach_embeddings(rows: DataFrame, train: DataFrame, val: DataFrame) -> DataFrame:
    """GRF-05: embeddings of both splits, one per (window, track), left-attached with a missing flag."""
    key = [WIN, "track_uuid"]
    emb = train.withColumn("_o", F.lit(0)).unionByName(val.withColumn("_o", F.lit(1))).groupBy(*key).agg(
        F.min_by("embedding", "_o").alias("embedding"))
    return rows.join(emb, key, "left").withColumn("embedding_missing", F.col("embedding").isNull())


def expand_phases(rows: DataFrame, phases: Sequence[tuple[str, float]] = PHASES) -> DataFrame:
    """GRF-06: every actor in each phase with monotone trends: distances shrink, overlap and closing speed grow."""
    table = F.array(*[F.struct(F.lit(k).alias("phase_idx"), F.lit(name).alias("phase"), F.lit(c).alias("c")) for k, (name, c) in enumerate(phases)])
    df = rows.withColumn("_p", F.explode(table)).withColumns({"phase_idx": F.col("_p.phase_idx"), "phase": F.col("_p.phase"), "_c": F.col("_p.c")})
    c = F.col("_c")

    def num(name, default=0.0, lo=None):
        v = F.coalesce(F.col(name), F.lit(default) if isinstance(default, float) else default)
        return F.greatest(v, F.lit(lo)) if lo is not None else v
    r = num("r_rel_m", 0.0, 0.0)
    align = (1 - TREND["align"] * c) * num("heading_align_cos") + TREND["align"] * c
    pull = num("approach_like") >= 0.5
    return df.withColumns({
        "r_rel_m": F.greatest(F.lit(0.0), r * (1 - TREND["r"] * c)),
        "ttc_s": F.greatest(F.lit(1e-3), num("ttc_s", 999.0, 1e-3) * (1 - TREND["ttc"] * c)),
        "dmin_m": F.greatest(F.lit(0.0), F.greatest(F.coalesce(F.col("dmin_m"), r), F.lit(0.0)) * (1 - TREND["dmin"] * c)),
        "p_overlap": F.least(F.greatest(num("p_overlap") + TREND["overlap"] * c, F.lit(0.0)), F.lit(1.0)),
        "rel_speed_closing_mps": num("rel_speed_closing_mps") + TREND["closing"] * c,
        "heading_align_cos": F.least(F.greatest(align, F.lit(-1.0)), F.lit(1.0)),
        "x_rel_m": F.when(pull, F.col("x_rel_m") * (1 - TREND["pull"] * c)).otherwise(F.col("x_rel_m")),
        "y_rel_m": F.when(pull, F.col("y_rel_m") * (1 - 0.5 * TREND["pull"] * c)).otherwise(F.col("y_rel_m")),
        "is_ego": F.lit(0)}).drop("_p", "_c")


def ego_nodes(windows: DataFrame, phases: Sequence[tuple[str, float]] = PHASES) -> DataFrame:
    """GRF-07: one ego node per window and phase."""
    table = F.array(*[F.struct(F.lit(k).alias("phase_idx"), F.lit(name).alias("phase")) for k, (name, _) in enumerate(phases)])
    return windows.select("log_id", WIN).distinct().withColumn("_p", F.explode(table)).select(
        "log_id", WIN, "_p.phase_idx", "_p.phase", F.lit("EGO").alias("track_uuid"), F.lit("EGO").alias("category"), F.lit(1).alias("is_ego"),
        *[F.lit(0.0).alias(c) for c in ("x_rel_m", "y_rel_m", "r_rel_m")])


def _edge(src: Column, dst: Column, kind: str, dist: Column) -> Column:
    return F.struct(src.alias("src_id"), dst.alias("dst_id"), F.lit(kind).alias("edge_type"), dist.alias("dist_m"), F.lit(0).alias("is_temporal"))


def ego_edges(nodes: DataFrame) -> DataFrame:
    """GRF-08: edges between ego and every actor, both ways."""
    ego, d = F.lit("EGO"), F.hypot("x_rel_m", "y_rel_m")
    both = F.array(_edge(ego, F.col("track_uuid"), "ego_to_actor", d), _edge(F.col("track_uuid"), ego, "actor_to_ego", d))
    return nodes.where("is_ego = 0").select(WIN, "phase_idx", F.explode(both).alias("e")).select(
        WIN, F.col("phase_idx").alias("src_phase"), F.col("phase_idx").alias("dst_phase"), "e.*")


def proximity_edges(nodes: DataFrame, m: float = 30.0, few: int = 64) -> DataFrame:
    """GRF-09: edges between actors at most ``m`` metres apart, both ways.

    Up to ``few`` actors of a window's phase are one array, so that they are shuffled once at most, and not at all where nodes lie by window
    already.  In a more crowded phase pairs are found through a grid of cells 4 ``m`` wide: each actor lies in its own cell, and copies of
    it in those that it reaches, 2.25 cells on average."""
    x, y = F.col("x_rel_m").alias("x"), F.col("y_rel_m").alias("y")
    pts = nodes.where(F.col("is_ego") == 0).select(WIN, "phase_idx", "track_uuid", x, y).where(F.col(WIN).isNotNull() & F.col("phase_idx").isNotNull())
    pts = pts.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(WIN, "phase_idx")))
    arrays = pts.where(F.col("_n") <= few).groupBy(WIN, "phase_idx").agg(F.collect_list(F.struct("track_uuid", "x", "y")).alias("nodes"))
    pairs = arrays.withColumn("a", F.explode("nodes")).withColumn("b", F.explode("nodes")).select(
        WIN, "phase_idx", F.col("a.track_uuid").alias("track_uuid"), F.col("a.x").alias("x"), F.col("a.y").alias("y"),
        F.col("b.track_uuid").alias("dst_id"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))
    crowded, width = pts.where(F.col("_n") > few).drop("_n"), 4 * m

    def reach(c: Column) -> Column:
        room = m + 1e-9 * (m + F.abs(c))  # an edge may be longer than m by rounding
        return F.sequence(F.floor((c - room) / width), F.floor((c + room) / width))
    own = crowded.withColumns({"_gx": F.floor(F.col("x") / width), "_gy": F.floor(F.col("y") / width)})
    copies = crowded.select(WIN, "phase_idx", F.col("track_uuid").alias("dst_id"), F.col("x").alias("x2"), F.col("y").alias("y2")) \
        .withColumn("_gx", F.explode(reach(F.col("x2")))).withColumn("_gy", F.explode(reach(F.col("y2"))))
    pairs = pairs.unionByName(own.join(copies, [WIN, "phase_idx", "_gx", "_gy"]).drop("_gx", "_gy"))
    d = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    return pairs.where((F.col("track_uuid") != F.col("dst_id")) & (d <= m)).select(
        WIN, F.col("phase_idx").alias("src_phase"), F.col("phase_idx").alias("dst_phase"), F.col("track_uuid").alias("src_id"), "dst_id",
        F.lit("actor_to_actor_spatial").alias("edge_type"), d.alias("dist_m"), F.lit(0).alias("is_temporal"))


def temporal_edges(nodes: DataFrame) -> DataFrame:
    """GRF-10: edges from each phase of an actor to its next one."""
    w = Window.partitionBy(WIN, "track_uuid").orderBy("phase_idx")
    nxt = nodes.where("is_ego = 0").withColumn("dst_phase", F.lead("phase_idx").over(w)).where("dst_phase IS NOT NULL")
    return nxt.select(WIN, F.col("phase_idx").alias("src_phase"), "dst_phase", F.col("track_uuid").alias("src_id"),
                      F.col("track_uuid").alias("dst_id"), F.lit("actor_temporal").alias("edge_type"), F.lit(0.0).alias("dist_m"),
                      F.lit(1).alias("is_temporal"))


def graph_nodes(rows: DataFrame, phases: Sequence[tuple[str, float]] = PHASES) -> DataFrame:
    """GRF-06 and GRF-07 together: actors in every phase and each window's ego nodes, in one pass over the actors.

    The first actor of a window brings its ego along, so rows that lie by window are neither read twice nor shuffled again."""
    first = F.row_number().over(Window.partitionBy(WIN, "log_id").orderBy("r_rel_m", "track_uuid")) == 1
    both = F.when(first, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = expand_phases(rows.withColumn("_both", both).withColumn("_ego", F.explode("_both")).drop("_both"), phases)
    ego, fixed = F.col("_ego") == 1, {"track_uuid": "EGO", "category": "EGO", "is_ego": 1, "x_rel_m": 0.0, "y_rel_m": 0.0, "r_rel_m": 0.0}
    keys = ("log_id", WIN, "phase_idx", "phase")
    return out.select(*[F.when(ego, F.lit(fixed[c])).otherwise(F.col(c)).alias(c) if c in fixed else F.col(c) if c in keys else F.when(~ego, F.col(c)).alias(c)
                        for c in out.columns if c != "_ego"])


def cap_graph(nodes: DataFrame, n: int = 40, e: int = 120, m: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """GRF-11: ego nodes plus the nearest others up to ``n`` nodes, and the edges between them, spatial ones capped to the shortest ``e``.

    The node cap doesn't depend on edges, so it comes first and edges arise only between kept nodes.  All stays where the nodes lie by window, which
    takes one shuffle (none, where they lie so already).  Edges read the columns that they need only: a window's kept nodes, at most ``n``, become
    one array in the order that tells which node follows, without another sort.
    Spatial edges arise within a phase; a node, one for each track and phase, knows the kept node that follows it (``node``, ``src``, ``dst``)."""
    near = Window.partitionBy(WIN).orderBy(F.col("is_ego").desc(), "r_rel_m", "track_uuid", "phase_idx")
    placed = Window.partitionBy(WIN).orderBy("track_uuid", "phase_idx")

    def best(df: DataFrame) -> DataFrame:
        return df.withColumn("_k", F.row_number().over(near)).where(F.col("_k") <= n)
    lying = nodes.repartition(WIN)
    slim = lying.select(WIN, "track_uuid", "phase_idx", "is_ego", "r_rel_m", F.col("x_rel_m").alias("x"), F.col("y_rel_m").alias("y"))
    kept = best(slim.withColumn("_next", F.lead("phase_idx").over(Window.partitionBy(WIN, "track_uuid").orderBy("phase_idx"))))
    whole = F.collect_list(F.struct("track_uuid", "phase_idx", "is_ego", "x", "y", "_next")).over(placed.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # one row a window: its first node has them all
    windows = kept.withColumn("nodes", whole).where("_k = 1").select(WIN, "nodes")
    follower = F.get(F.col("nodes"), F.col("src") + 1)
    ends = windows.select(WIN, "nodes", F.posexplode("nodes").alias("src", "a"))
    ends = ends.withColumn("_to", F.when((follower["phase_idx"] == F.col("a._next")) & follower["track_uuid"].eqNullSafe(F.col("a.track_uuid")), F.col("src") + 1))
    pairs = ends.where("a.phase_idx IS NOT NULL").select(WIN, "src", "a", "_to", F.posexplode("nodes").alias("dst", "b")).where(F.col("a.phase_idx") == F.col("b.phase_idx"))
    next_one = (F.col("src") == F.col("dst")) & (F.col("a.is_ego") == 0) & F.col("_to").isNotNull() & F.col("a.track_uuid").isNotNull()
    d = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    kind = F.when(next_one, EDGE_TYPES[3]).when(F.col("a.track_uuid") != F.col("b.track_uuid"), F.when(F.col("a.is_ego") == 1, EDGE_TYPES[0])
                                                .when(F.col("b.is_ego") == 1, EDGE_TYPES[1]).when(d <= m, EDGE_TYPES[2]))
    edges = pairs.select(WIN, F.col("a.phase_idx").alias("src_phase"), F.when(next_one, F.col("a._next")).otherwise(F.col("b.phase_idx")).alias("dst_phase"),
                         F.col("a.track_uuid").alias("src_id"), F.col("b.track_uuid").alias("dst_id"), kind.alias("edge_type"), F.when(next_one, 0.0).otherwise(d).alias("dist_m"),
                         F.coalesce(next_one, F.lit(False)).cast("int").alias("is_temporal"), "src",
                         F.when(next_one, F.col("_to")).otherwise(F.col("dst")).alias("dst")).where("edge_type IS NOT NULL")
    short = Window.partitionBy(WIN, "is_temporal").orderBy("dist_m", "src_phase", "src_id", "dst_id", "edge_type")
    edges = edges.withColumn("_k", F.row_number().over(short))
    return best(lying).drop("_k").withColumn("node", F.row_number().over(placed) - 1), edges.where((F.col("is_temporal") == 1) | (F.col("_k") <= e)).drop("_k")


def adjacency(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRF-12: edges of a capped graph with dense node positions per window and edge-type id, and a node/edge manifest."""
    kind = F.array_position(F.array(*[F.lit(t) for t in EDGE_TYPES]), F.col("edge_type")) - 1
    adj = edges.select(WIN, "src", "dst", kind.alias("edge_type_id"), "dist_m")
    sizes = nodes.groupBy(WIN).agg(F.count(F.lit(1)).alias("n_nodes"))
    degrees = adj.groupBy(WIN).agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("edge_type_id") != 3).alias("n_spatial"),
                                   F.count_if(F.col("edge_type_id") == 3).alias("n_temporal"))
    return adj, sizes.join(degrees, WIN, "left").na.fill(0)


def graph_qc(nodes: DataFrame, edges: DataFrame, phases: Sequence[tuple[str, float]] = PHASES) -> DataFrame:
    """GRF-13: (metric, value) checks of the nodes and edges of a capped graph.

    Both tables are summed up by window, a window's nodes and ends being bounded by its caps, and meet there; the sums are stored once."""
    names = [p for p, _ in phases]
    at = lambda phase, track: F.concat(F.col(phase).cast("string"), F.lit(":"), track)
    middle = lambda phase: F.percentile(F.when((F.col("is_ego") == 0) & (F.col("phase") == phase), F.col("r_rel_m")), 0.5)
    per = nodes.groupBy(WIN).agg(
        F.size(F.collect_set(F.when(F.col("phase").isin(names), F.col("phase")))).alias("p"), F.count(F.lit(1)).alias("n"), middle("pre").alias("pre"), middle("peak").alias("peak"),
        F.collect_list(at("phase_idx", "track_uuid")).alias("ids"))
    links = edges.groupBy(WIN).agg(
        F.count(F.lit(1)).alias("edges"), F.count_if((F.col("is_temporal") == 0) & (F.col("dist_m") < -1e-6)).alias("negative_distance"),
        F.count_if((F.col("src_id") == F.col("dst_id")) & (F.col("src_phase") == F.col("dst_phase"))).alias("self_links"),
        F.concat(F.collect_list(at("src_phase", "src_id")), F.collect_list(at("dst_phase", "dst_id"))).alias("ends"))

    def apart(some: str, others: str) -> Column:
        """How many items of a list are not in another."""
        lone = F.array_except(some, others)
        return F.when(F.size(lone) > 0, F.size(F.filter(some, lambda x: F.array_contains(lone, x)))).otherwise(0)
    nothing = F.array().cast("array<string>")
    both = per.join(links, WIN, "full").withColumns({"ids": F.coalesce("ids", nothing), "ends": F.coalesce("ends", nothing)})
    # ends and nodes without a name are linked with nothing
    sums = stored(both.select(
        "p", "n", "pre", "peak", "edges", "negative_distance", "self_links", (2 * F.coalesce("edges", F.lit(0)) - F.size("ends") + apart("ends", "ids")).alias("dangling"),
        (F.coalesce("n", F.lit(0)) - F.size("ids") + apart("ids", "ends")).alias("isolated")), "graph-sums")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    whole = sums.agg(F.count("n").alias("windows"), F.count_if(F.col("p") < len(names)).alias("windows_missing_phase"), F.min("n").alias("nodes_min"), F.max("n").alias("nodes_max"),
                     (100.0 * F.avg((F.col("pre") > F.col("peak")).cast("double"))).alias("r_pre_above_peak_pct"), total("dangling").alias("dangling_endpoints"), total("edges").alias("edges"),
                     total("negative_distance").alias("negative_distance"), total("self_links").alias("self_links"), total("isolated").alias("isolated_nodes"))
    mid = group_quantiles(sums, [], "n", [0.5], "nodes_median").select("nodes_median")
    return tall(whole).unionByName(tall(mid))


def phase_score(tau: float = 2.0, rho: float = 20.0, closing: float = 0.6, align: float = 0.2, approach: float = 0.2) -> Column:
    """GRF-14: physics score of a node; positive closing speed means closing in."""
    def num(name, default, lo=None, hi=None):
        v = F.coalesce(F.col(name), F.lit(default))
        v = F.greatest(v, F.lit(lo)) if lo is not None else v
        return F.least(v, F.lit(hi)) if hi is not None else v
    prior = F.when(F.upper("category").isin(VEHICLES), 1.0).when(F.upper("category").isin(VULNERABLE), 0.9) \
             .when(F.upper("category").isin(SIGNS), 0.6).otherwise(0.8)
    return (F.exp(-num("r_rel_m", 80.0, 0.0, 80.0) / rho) * F.exp(-num("ttc_s", 30.0, 0.0, 30.0) / tau)
            * F.exp(closing * F.greatest(F.lit(0.0), num("rel_speed_closing_mps", 0.0)))
            * (1 + align * F.greatest(F.lit(0.0), num("map_lane_alignment_cos", 0.0)))
            * (1 + approach * F.when(F.coalesce("approach_like", F.lit(0.0)) > 0.5, 1.0).otherwise(0.0)) * prior)


def teacher(nodes: DataFrame, sl: DataFrame, tau: float = 0.8, eps: float = 0.02) -> DataFrame:
    """GRF-15: phase-weighted score per actor, softmax per window with uniform smoothing.

    Nodes lie by window, so that a window's totals are read beside its actors and these are not computed again for a join.
    """
    phase = F.lower("phase")
    weight = F.when(phase == "pre", F.col("w_pre")).when(phase.isin("onset", "rise"), 0.5 * (F.col("w_pre") + F.col("w_peak"))) \
              .when(phase == "post", F.col("w_post")).otherwise(F.col("w_peak"))
    raw = nodes.where("track_uuid <> 'EGO'").join(sl.select(WIN, "w_pre", "w_peak", "w_post").distinct(), WIN) \
        .groupBy(WIN, "track_uuid", "category").agg(F.sum(phase_score() * weight).alias("score_window_raw"))
    whole = Window.partitionBy(WIN)
    z = raw.withColumns({"_top": F.max("score_window_raw").over(whole), "_n": F.count(F.lit(1)).over(whole)}) \
        .withColumn("_z", F.exp((F.col("score_window_raw") - F.col("_top")) / tau)).withColumn("_sum", F.sum("_z").over(whole))
    return z.withColumn("q", (1 - eps) * F.col("_z") / F.col("_sum") + eps / F.col("_n")) \
        .select(WIN, "track_uuid", "category", "q", "score_window_raw")


def teacher_qc(t: DataFrame, nodes: DataFrame) -> DataFrame:
    """GRF-16: (metric, value): coverage of actors, deviation of the sums from one, categories on top."""
    key = [WIN, "track_uuid"]
    miss = nodes.where("track_uuid <> 'EGO'").select(*key).distinct().join(t.select(*key), key, "left_anti").agg(F.count(F.lit(1)).alias("missing_actors"))
    # one pass over the windows for the deviation and the categories, whose few sums are stored
    per = t.groupBy(WIN).agg(F.abs(F.sum("q") - 1).alias("d"), F.min_by("category", F.struct(-F.col("q"), "track_uuid")).alias("category"))
    sums = stored(per.groupBy("category").agg(F.sum("d").alias("d"), F.count("d").alias("known"), F.count(F.lit(1)).alias("windows")), "teacher-sums")
    dev = sums.agg((F.sum("d") / F.nullif(F.sum("known"), F.lit(0))).alias("mean_abs_dev"), F.coalesce(F.sum("windows"), F.lit(0)).alias("windows"))
    top = sums.select(F.concat(F.lit("top1:"), "category").alias("metric"), F.col("windows").cast("double").alias("value"))
    return tall(miss).unionByName(tall(dev)).unionByName(top)


def pool_scores(nodes: DataFrame, how: str = "max", score: str = "score") -> DataFrame:
    """GRF-17: node scores pooled to actors, without ego and unknown nodes."""
    keep = nodes.where(~F.upper("track_uuid").isin("EGO", "UNKNOWN", ""))
    return keep.groupBy(WIN, "track_uuid").agg((F.max if how == "max" else F.avg)(score).alias(score))


def top_actors(scores: DataFrame, k: int = 3, score: str = "score") -> DataFrame:
    """GRF-18: the ``k`` best actors of each window."""
    w = Window.partitionBy(WIN).orderBy(F.col(score).desc(), "track_uuid")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def gt_lookup(windows: DataFrame, labels: DataFrame, tags: DataFrame, tol: float = 0.05, fallback: bool = False) -> DataFrame:
    """GRF-19: (window, track) positives: tagged actors of the log for windows within ``tol`` of a labelled one.

    Rows instead of sets; ``fallback`` adds every other window of a labelled log.
    """
    from roadsift.functions.intervals import near_join
    lab = labels.where("label = 1").select("log_id", F.col("t_start").alias("_l0"), F.col("t_end").alias("_l1"))
    hit = near_join(windows.select("log_id", WIN, "t_start", "t_end"), lab, ["log_id"], "t_start", "_l0", tol) \
        .where(F.abs(F.col("t_end") - F.col("_l1")) <= tol).select("log_id", WIN).distinct()
    if fallback:
        hit = hit.unionByName(windows.select("log_id", WIN).join(lab, "log_id", "left_semi")).distinct()
    good = tags.where("has_guest AND tag <> 'not_relevant' AND length(guest_id) > 0").select("log_id", F.col("guest_id").alias("track_uuid")).distinct()
    return hit.join(good, "log_id").select(WIN, "track_uuid")


def md5_split(keys: DataFrame, key: str = WIN, frac: float = 0.2, seed: int = 1337) -> DataFrame:
    """GRF-20: deterministic split of window keys by hash order."""
    return ordered_split(keys, key, frac, seed)


def fit_temperature(scores: DataFrame, gt: DataFrame, grid: Sequence[float]) -> DataFrame:
    """GRF-21: mean negative log likelihood of the true actors for each temperature of a grid; the best one is flagged."""
    s = scores.join(gt.withColumn("_y", F.lit(1)), [WIN, "track_uuid"], "left")
    top = s.groupBy(WIN).agg(F.max("score").alias("_top"), F.max("_y").alias("_any")).where("_any = 1")
    t = s.join(top, WIN).withColumn("temperature", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    z = F.exp((F.col("score") - F.col("_top")) / F.col("temperature"))
    per = t.groupBy(WIN, "temperature").agg((F.sum(F.when(F.col("_y") == 1, z)) / F.sum(z)).alias("p"))
    nll = per.groupBy("temperature").agg(F.avg(-F.ln(F.greatest("p", F.lit(1e-12)))).alias("nll"), F.count(F.lit(1)).alias("windows"))
    best = nll.agg(F.min_by("temperature", F.struct("nll", "temperature"))).scalar()
    return nll.withColumn("best", F.col("temperature") == best)


def topk_qc(topk: DataFrame, manifest: DataFrame, t: DataFrame, k: int = 3) -> DataFrame:
    """GRF-22: (metric, value): rank contiguity, duplicates, non-finite scores, window sets, teacher mass and top-1 hit."""
    per = topk.groupBy(WIN).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("track_uuid").alias("u"), F.min("rank").alias("lo"),
                                F.max("rank").alias("hi"), F.count_distinct("rank").alias("r"))
    bad = (F.col("lo") != 1) | (F.col("hi") != F.least(F.lit(k), F.col("n"))) | (F.col("r") != F.col("n")) | (F.col("u") != F.col("n"))
    checks = per.agg(F.count(F.lit(1)).alias("windows"), F.count_if(bad).alias("bad_windows"))
    fin = topk.agg(F.count_if(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == F.lit(math.inf))).alias("nonfinite_rows"))
    missing = manifest.select(WIN).distinct().join(topk, WIN, "left_anti").agg(F.count(F.lit(1)).alias("missing_windows"))
    extra = topk.select(WIN).distinct().join(manifest, WIN, "left_anti").agg(F.count(F.lit(1)).alias("extra_windows"))
    total = t.groupBy(WIN).agg(F.sum("q").alias("_all"), F.min_by("track_uuid", F.struct(-F.col("q"), "track_uuid")).alias("_best"))
    got = topk.join(t.select(WIN, "track_uuid", "q"), [WIN, "track_uuid"], "left").groupBy(WIN).agg(
        F.sum(F.coalesce("q", F.lit(0.0))).alias("_at"), F.max(F.when(F.col("rank") == 1, F.col("track_uuid"))).alias("_first"))
    m = total.join(got, WIN).agg(F.avg(F.try_divide("_at", "_all")).alias("teacher_mass_at_k"),
                                 F.avg((F.col("_first") == F.col("_best")).cast("double")).alias("teacher_top1_hit"))
    out = tall(checks)
    for part in (fin, missing, extra, m):
        out = out.unionByName(tall(part))
    return out

