"""FEA-*: actor features and the window table over line items."""

from pyspark.sql import functions as F

from roadsift.operators import features as A
from roadsift.plans.fixtures import ACTORS, actors
from roadsift.plans.registry import query

TTC = ("CASE WHEN rel_speed_closing_mps > 1e-6 THEN dmin_m / rel_speed_closing_mps "
       "WHEN rel_speed_closing_mps <= -1e-6 THEN -dmin_m / rel_speed_closing_mps END")
FLAGGED = ACTORS + f""", flagged AS (SELECT *, {TTC} AS ttc_s, CASE WHEN dmin_m <= 3 THEN 1.0 ELSE 0.0 END AS dist_lt3,
    CASE WHEN dmin_m <= 5 THEN 1.0 ELSE 0.0 END AS dist_lt5, CASE WHEN dmin_m <= 8 THEN 1.0 ELSE 0.0 END AS dist_lt8,
    sqrt(x_rel_m * x_rel_m + y_rel_m * y_rel_m) AS r_rel_m, x_rel_m AS long_gap_m, y_rel_m AS lat_offset_m,
    cos(bearing_rad) AS heading_align_cos,
    CASE WHEN rel_speed_closing_mps > 0.5 AND x_rel_m > -2 THEN 1.0 ELSE 0.0 END AS approach_like,
    CASE WHEN abs(lat_speed_mps) > 0.4 AND abs(y_rel_m) < 8.5 THEN 1.0 ELSE 0.0 END AS crossing_like,
    1.0 / (1.0 + greatest(dmin_m, 0.0)) AS inv FROM actors)"""
FEATS = FLAGGED + """, feats AS (SELECT *, row_number() OVER (PARTITION BY window_key ORDER BY p_overlap DESC, track_uuid) AS rank_p_overlap,
    max(p_overlap) OVER (PARTITION BY window_key) - p_overlap AS margin_to_top_p,
    row_number() OVER (PARTITION BY window_key ORDER BY inv DESC, track_uuid) AS rank_inv_dmin,
    max(inv) OVER (PARTITION BY window_key) - inv AS margin_to_top_inv_d FROM flagged)"""


def feats(t):
    return A.actor_features(actors(t))


def plain(t):
    """Flags and time-to-contact without ranks, which most window aggregates do not need."""
    return A.flags(actors(t)).withColumn("ttc_s", A.ttc(F.col("dmin_m"), F.col("rel_speed_closing_mps")))


@query("fea_01_ttc", "window_key:s track_uuid:s ttc_s:d", f"WITH {ACTORS} SELECT window_key, track_uuid, {TTC} AS ttc_s FROM actors")
def fea_01(t):
    return actors(t).withColumn("ttc_s", A.ttc(F.col("dmin_m"), F.col("rel_speed_closing_mps")))


@query("fea_02_flags", "window_key:s track_uuid:s dist_lt3:d dist_lt5:d dist_lt8:d r_rel_m:d heading_align_cos:d "
       "approach_like:d crossing_like:d", f"WITH {FLAGGED} SELECT * FROM flagged")
def fea_02(t):
    return A.flags(actors(t))


@query("fea_03_rank_margin", "window_key:s track_uuid:s rank_p_overlap:n margin_to_top_p:d",
       f"WITH {FEATS} SELECT * FROM feats")
def fea_03(t):
    return A.rank_margin(actors(t), "p_overlap", "rank_p_overlap", "margin_to_top_p")


FEATURE_SPEC = "window_key:s " + " ".join(
    f"{c}:{'s' if c in ('log_id', 'track_uuid', 'category') else 'd'}" for c in A.FEATURES)


@query("fea_04_actor_features", FEATURE_SPEC, f"WITH {FEATS} SELECT * FROM feats")
def fea_04(t):
    return feats(t)


QC_COLS = ["dmin_m", "p_overlap", "ttc_s", "in_drivable_area", "map_lane_alignment_cos", "r_rel_m"]
QC_LONG = " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS DOUBLE) AS v FROM flagged" for c in QC_COLS)


@query("fea_05_feature_qc", "field:s n:n null_rate:d min:d p01:d p05:d p50:d p95:d p99:d max:d out_of_bounds:n",
       f"""WITH {FLAGGED}, long AS ({QC_LONG}) SELECT field, count(*) AS n,
       avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS null_rate, min(v) AS min, max(v) AS max,
       quantile_cont(v, 0.01) AS p01, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.5) AS p50,
       quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99,
       count(*) FILTER (field = 'in_drivable_area' AND v <> floor(v) OR field = 'map_lane_alignment_cos' AND abs(v) > 1.0001)
       AS out_of_bounds FROM long GROUP BY field """)
def fea_05(t):
    return A.feature_qc(plain(t), QC_COLS)


CONTRACT = [
    {"name": "p_overlap", "dtype": "double", "lo": 0.0, "hi": 0.9, "nullable": False},
    {"name": "category", "dtype": "string", "enum": ["Brand#11", "Brand#12", "Brand#13"], "nullable": False},
    {"name": "ttc_s", "dtype": "double", "lo": 0.0, "hi": 50.0, "nullable": False},
    {"name": "sector_id", "dtype": "bigint", "enum": [0, 1, 2]},
    {"name": "absent_column", "dtype": "double"},
]


@query("fea_06_check_schema", "field:s rule:s violations:n", f"""WITH {FLAGGED}, c AS (SELECT
    count(*) FILTER (p_overlap IS NULL) AS a, count(*) FILTER (p_overlap < 0 OR p_overlap > 0.9) AS b,
    count(*) FILTER (category IS NULL) AS d, count(*) FILTER (category NOT IN ('Brand#11', 'Brand#12', 'Brand#13')) AS e,
    count(*) FILTER (ttc_s IS NULL) AS f, count(*) FILTER (ttc_s < 0 OR ttc_s > 50) AS g,
    count(*) FILTER (sector_id NOT IN (0, 1, 2)) AS h FROM flagged)
    SELECT 'p_overlap' AS field, 'null' AS rule, a AS violations FROM c UNION ALL SELECT 'p_overlap', 'range', b FROM c
    UNION ALL SELECT 'category', 'null', d FROM c UNION ALL SELECT 'category', 'enum', e FROM c
    UNION ALL SELECT 'ttc_s', 'null', f FROM c UNION ALL SELECT 'ttc_s', 'range', g FROM c
    UNION ALL SELECT 'sector_id', 'enum', h FROM c UNION ALL SELECT 'p_overlap', 'dtype', 0
    UNION ALL SELECT 'category', 'dtype', 0 UNION ALL SELECT 'ttc_s', 'dtype', 0 UNION ALL SELECT 'sector_id', 'dtype', 1
    UNION ALL SELECT 'absent_column', 'missing', 1""")
def fea_06(t):
    return A.check_schema(plain(t), CONTRACT)


@query("fea_06_fill_missing", "window_key:s track_uuid:s ttc_s:d margin:d", f"""WITH {FLAGGED}, f AS (SELECT *,
    CASE WHEN dmin_m > 40 THEN NULL ELSE dmin_m END AS margin FROM flagged), m AS (SELECT quantile_cont(margin, 0.5) AS med FROM f)
    SELECT window_key, track_uuid, coalesce(ttc_s, 300.0) AS ttc_s, coalesce(margin, med) AS margin FROM f, m""")
def fea_06_fill(t):
    df = plain(t).withColumn("margin", F.when(F.col("dmin_m") <= 40, F.col("dmin_m")))
    return A.fill_missing(df, [{"name": "ttc_s", "fill": 300.0}, {"name": "margin", "fill": "median"}])


K = ", ".join(A.KEYS)
KEY_SPEC = "log_id:s window_t_start:d window_t_end:d window_center:d"


@query("fea_07_window_counts", KEY_SPEC + " n_actors:n n_vehicle:n n_vru:n n_sector_0:n n_sector_1:n n_sector_2:n "
       "n_sector_3:n sustained_any:d sustained_frac:d", f"""WITH {ACTORS} SELECT {K}, count(*) AS n_actors,
       sum(is_vehicle) AS n_vehicle, sum(is_vru) AS n_vru, count(*) FILTER (sector_id = 0) AS n_sector_0,
       count(*) FILTER (sector_id = 1) AS n_sector_1, count(*) FILTER (sector_id = 2) AS n_sector_2,
       count(*) FILTER (sector_id = 3) AS n_sector_3, max(sustained_tight) AS sustained_any,
       avg(sustained_tight) AS sustained_frac FROM actors GROUP BY {K}""")
def fea_07(t):
    return A.window_counts(actors(t))


MAP_SQL = ", ".join(f"min({c}) AS {c}_min, avg({c}) AS {c}_mean" for c in A.MAP) + (
    ", max(CASE WHEN dist_to_stopline_m < 8 THEN 1.0 ELSE 0.0 END) AS near_stopline, "
    "max(CASE WHEN dist_to_crosswalk_m < 8 THEN 1.0 ELSE 0.0 END) AS near_crosswalk")


@query("fea_08_window_map", KEY_SPEC + " " + " ".join(f"{c}_min:d {c}_mean:d" for c in A.MAP) + " near_stopline:d near_crosswalk:d",
       f"WITH {ACTORS} SELECT {K}, {MAP_SQL} FROM actors GROUP BY {K}")
def fea_08(t):
    return A.window_map(actors(t))


def _top_sql(k):
    c = f"FILTER (rn <= {k})"
    return (f"max(p_overlap) {c} AS top{k}_p_max, avg(p_overlap) {c} AS top{k}_p_mean, max(inv) {c} AS top{k}_inv_d_max, "
            f"avg(inv) {c} AS top{k}_inv_d_mean, avg(rel_speed_closing_mps) {c} AS top{k}_rel_close_mean, "
            f"avg(a_norm) {c} AS top{k}_a_norm_mean, avg(lat_speed_mps) {c} AS top{k}_lat_speed_mean, "
            f"min(ttc_s) {c} AS top{k}_ttc_min, max(dist_lt3) {c} AS top{k}_dist3_any, max(dist_lt5) {c} AS top{k}_dist5_any, "
            f"max(dist_lt8) {c} AS top{k}_dist8_any, max(crossing_like) {c} AS top{k}_crossing_any, "
            f"max(approach_like) {c} AS top{k}_approach_any")


TOP_SQL = ", ".join(_top_sql(k) for k in A.TOP_KS)
TOP_NAMES = ("p_max", "p_mean", "inv_d_max", "inv_d_mean", "rel_close_mean", "a_norm_mean", "lat_speed_mean", "ttc_min",
             "dist3_any", "dist5_any", "dist8_any", "crossing_any", "approach_any")
TOP_SPEC = " ".join(f"top{k}_{n}:d" for k in A.TOP_KS for n in TOP_NAMES)
RANKED = FLAGGED + f", ranked AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY p_overlap DESC, track_uuid) AS rn FROM flagged)"


@query("fea_09_window_topk", f"{KEY_SPEC} {TOP_SPEC}", f"WITH {RANKED} SELECT {K}, {TOP_SQL} FROM ranked GROUP BY {K}")
def fea_09(t):
    return A.window_topk(plain(t))


A1_SPEC = " ".join(f"a1_{c}:{'s' if c == 'category' else 'd'}" for c in A.SNAPSHOT)
A1_SQL = ", ".join(f"arg_min({c}, rn) FILTER (rn = 1) AS a1_{c}" for c in A.SNAPSHOT)


@query("fea_10_window_best", f"{KEY_SPEC} {A1_SPEC}", f"WITH {RANKED} SELECT {K}, {A1_SQL} FROM ranked GROUP BY {K}")
def fea_10(t):
    return A.window_best(plain(t))


MARGIN_SQL = ("arg_min(margin_to_top_p, rank_p_overlap) AS best_margin_to_top_p, "
              "arg_min(margin_to_top_inv_d, rank_inv_dmin) AS best_margin_to_top_invd")


@query("fea_11_window_margins", f"{KEY_SPEC} best_margin_to_top_p:d best_margin_to_top_invd:d",
       f"WITH {FEATS} SELECT {K}, {MARGIN_SQL} FROM feats GROUP BY {K}")
def fea_11(t):
    return A.window_margins(feats(t))


@query("fea_12_window_table", f"{KEY_SPEC} n_actors:n sustained_frac:d {' '.join(f'{c}_mean:d' for c in A.MAP)} {TOP_SPEC} {A1_SPEC} "
       "best_margin_to_top_p:d best_margin_to_top_invd:d",
       f"WITH {FEATS}, ranked AS (SELECT *, rank_p_overlap AS rn FROM feats) SELECT {K}, count(*) AS n_actors, "
       f"avg(sustained_tight) AS sustained_frac, {MAP_SQL}, {TOP_SQL}, {A1_SQL}, {MARGIN_SQL} FROM ranked GROUP BY {K}")
def fea_12(t):
    return A.window_table(feats(t))
