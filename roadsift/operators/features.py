"""Per-actor features, schema contract and the per-window table (FEA-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadsift.functions.quantiles import group_quantiles

# The published feature schema in its order, the columns that identify a window, the map cues among the features, the
# sizes of the top-k tables, and the columns of one actor's snapshot.
FEATURES = ["log_id", "window_t_start", "window_t_end", "window_center", "track_uuid", "category", "is_vehicle", "is_vru", "is_static",
            "sector_id", "on_path_like", "x_rel_m", "y_rel_m", "r_rel_m", "dmin_m", "p_overlap", "t_at_dmin_s", "sustained_tight",
            "rel_speed_closing_mps", "lat_speed_mps", "a_norm", "length_m", "width_m", "bearing_rad", "ttc_s", "dist_lt3", "dist_lt5",
            "dist_lt8", "approach_like", "crossing_like", "heading_align_cos", "long_gap_m", "lat_offset_m", "map_lane_offset_m",
            "map_lane_alignment_cos", "dist_to_stopline_m", "dist_to_crosswalk_m", "in_drivable_area", "rank_p_overlap",
            "margin_to_top_p", "rank_inv_dmin", "margin_to_top_inv_d"]
KEYS = ["log_id", "window_t_start", "window_t_end", "window_center"]
MAP = ["map_lane_offset_m", "map_lane_alignment_cos", "dist_to_stopline_m", "dist_to_crosswalk_m", "in_drivable_area"]
TOP_KS = (1, 3, 5, 10, 24)
SNAPSHOT = ["category", "is_vehicle", "is_vru", "is_static", "sector_id", "on_path_like", "x_rel_m", "y_rel_m", "r_rel_m",
            "dmin_m", "p_overlap", "t_at_dmin_s", "sustained_tight", "rel_speed_closing_mps", "lat_speed_mps", "a_norm",
            "length_m", "width_m", "bearing_rad", "ttc_s", "heading_align_cos", "long_gap_m", "lat_offset_m",
            "map_lane_offset_m", "map_lane_alignment_cos", "dist_to_stopline_m", "dist_to_crosswalk_m", "in_drivable_area"]


def ttc(dmin: Column, closing: Column) -> Column:
    """FEA-01: time-to-contact proxy; null when the closing speed is about zero."""
    return F.when(closing > 1e-6, F.try_divide(dmin, closing)).when(closing <= -1e-6, F.try_divide(-dmin, closing))


def flags(df: DataFrame) -> DataFrame:
    """FEA-02: proximity flags, range, heading cosine, approach and crossing flags."""
    dmin, flag = F.col("dmin_m"), lambda c: F.when(c, 1.0).otherwise(0.0)
    return df.withColumns({
        "dist_lt3": flag(dmin <= 3.0), "dist_lt5": flag(dmin <= 5.0), "dist_lt8": flag(dmin <= 8.0),
        "r_rel_m": F.sqrt(F.col("x_rel_m") * F.col("x_rel_m") + F.col("y_rel_m") * F.col("y_rel_m")), "long_gap_m": F.col("x_rel_m"), "lat_offset_m": F.col("y_rel_m"),
        "heading_align_cos": F.cos("bearing_rad"),
        "approach_like": flag((F.col("rel_speed_closing_mps") > 0.5) & (F.col("x_rel_m") > -2.0)),
        "crossing_like": flag((F.abs("lat_speed_mps") > 0.4) & (F.abs("y_rel_m") < 8.5))})


def inverse_distance(dmin: Column) -> Column:
    return 1.0 / (1.0 + F.greatest(dmin, F.lit(0.0)))


def rank_margin(rows: DataFrame, value: str, rank: str, margin: str, keys: Sequence[str] = ("window_key",),
                tie: str = "track_uuid", desc: bool = True) -> DataFrame:
    """FEA-03: rank within the window and distance to its best value.

    A window holds the few actors that the tagger keeps, so both come from one sort of its rows.
    """
    keys = list(keys)
    order = F.col(value).desc_nulls_last() if desc else F.col(value).asc_nulls_last()
    window = Window.partitionBy(*keys)
    ranked = rows.withColumn(rank, F.row_number().over(window.orderBy(order, tie)).cast("bigint")).withColumn("_best", (F.max if desc else F.min)(value).over(window))
    gap = F.col("_best") - F.col(value) if desc else F.col(value) - F.col("_best")
    return ranked.withColumn(rank, F.when(F.col(value).isNotNull(), F.col(rank))).withColumn(margin, gap).drop("_best")


def actor_features(tagged: DataFrame, keys: Sequence[str] = ("window_key",)) -> DataFrame:
    """FEA-04: the 42-column feature projection of tagged actors that carry their map cues."""
    df = flags(tagged).withColumn("ttc_s", ttc(F.col("dmin_m"), F.col("rel_speed_closing_mps")))
    df = df.withColumn("_inv", inverse_distance(F.col("dmin_m")))
    df = rank_margin(df, "p_overlap", "rank_p_overlap", "margin_to_top_p", keys)
    df = rank_margin(df, "_inv", "rank_inv_dmin", "margin_to_top_inv_d", keys)
    return df.select(*[k for k in keys if k not in FEATURES], *FEATURES)


def feature_qc(features: DataFrame, cols: Sequence[str]) -> DataFrame:
    """FEA-05: per column null rate, minimum, 1/5/50/95/99 % quantiles, maximum and the bound violations."""
    long = features.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in cols])).alias("r")).select("r.*")
    base = long.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("value").isNull().cast("double")).alias("null_rate"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.count_if((F.col("field") == "in_drivable_area") & (F.col("value") % 1.0 != 0)
                   | (F.col("field") == "map_lane_alignment_cos") & (F.abs("value") > 1.0001)).alias("out_of_bounds"))
    names = {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    q = group_quantiles(long, ["field"], "value", list(names.values()), fixed=True)
    wide = q.groupBy("field").agg(*[F.max(F.when(F.col("p") == v, F.col("q"))).alias(k) for k, v in names.items()])
    return base.join(wide, "field", "left")


def check_schema(df: DataFrame, contract: Sequence[dict]) -> DataFrame:
    """FEA-06: violations per (column, check) of a contract with dtype, nullable, enum, lo and hi entries.

    Type checks are read off the schema; the value checks of all columns share one aggregate.
    """
    spark, static, counts = df.sparkSession, [], []
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    for c in contract:
        name = c["name"]
        if name not in types:
            static.append((name, "missing", 1))
            continue
        static.append((name, "dtype", int("dtype" in c and types[name] != c["dtype"])))
        col = F.col(name)
        if not c.get("nullable", True):
            counts.append((name, "null", F.count_if(col.isNull())))
        if "enum" in c:
            counts.append((name, "enum", F.count_if(col.isNotNull() & ~col.isin(*c["enum"]))))
        if "lo" in c or "hi" in c:
            low = col < F.lit(c["lo"]) if "lo" in c else F.lit(False)
            high = col > F.lit(c["hi"]) if "hi" in c else F.lit(False)
            counts.append((name, "range", F.count_if(low | high)))
    rows = df.agg(*[e.alias(f"c{k}") for k, (_, _, e) in enumerate(counts)]).select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("field"), F.lit(k).alias("rule"), F.col(f"c{j}").alias("violations"))
        for j, (n, k, _) in enumerate(counts)])).alias("r")).select("r.*")
    return rows.unionByName(spark.createDataFrame(static, "field string, rule string, violations bigint"))


def fill_missing(df: DataFrame, contract: Sequence[dict]) -> DataFrame:
    """FEA-06: apply the fill strategies of a contract: none, median or a constant."""
    medians = [c["name"] for c in contract if c.get("fill") == "median"]
    if medians:
        long = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in medians])).alias("r")) \
            .select("r.*")
        q = group_quantiles(long, ["field"], "value", [0.5], fixed=True)
        row = q.agg(*[F.max(F.when(F.col("field") == c, F.col("q"))).alias(c) for c in medians])
        med = row.select(F.struct(*medians)).scalar()
        df = df.withColumn("_med", med)
        df = df.withColumns({c: F.coalesce(F.col(c), F.col("_med")[c]) for c in medians}).drop("_med")
    constants = {c["name"]: F.coalesce(F.col(c["name"]), F.lit(c["fill"])) for c in contract
                 if isinstance(c.get("fill"), (int, float))}
    return df.withColumns(constants) if constants else df


def _any(c: Column) -> Column:
    return F.max(F.when(c, 1.0).otherwise(0.0))


def count_aggs() -> dict[str, Column]:
    """FEA-07 aggregates."""
    tight = F.coalesce(F.col("sustained_tight") == 1, F.lit(False))
    return {"n_actors": F.count(F.lit(1)), "n_vehicle": F.count_if(F.col("is_vehicle") == 1),
            "n_vru": F.count_if(F.col("is_vru") == 1),
            **{f"n_sector_{s}": F.count_if(F.col("sector_id") == s) for s in range(4)},
            "sustained_any": _any(tight), "sustained_frac": F.avg(tight.cast("double"))}


def map_aggs(near: float = 8.0) -> dict[str, Column]:
    """FEA-08 aggregates."""
    out = {}
    for c in MAP:
        out[f"{c}_min"], out[f"{c}_mean"] = F.min(c), F.avg(c)
    out["near_stopline"] = _any(F.col("dist_to_stopline_m") < near)
    out["near_crosswalk"] = _any(F.col("dist_to_crosswalk_m") < near)
    return out


def top_aggs(k: int, rank: str = "_rn") -> dict[str, Column]:
    """FEA-09 aggregates over the first ``k`` actors by overlap."""
    def top(c):
        return F.when(F.col(rank) <= k, F.col(c) if isinstance(c, str) else c)
    inv = inverse_distance(F.col("dmin_m"))
    out = {"p_max": F.max(top("p_overlap")), "p_mean": F.avg(top("p_overlap")), "inv_d_max": F.max(top(inv)),
           "inv_d_mean": F.avg(top(inv)), "rel_close_mean": F.avg(top("rel_speed_closing_mps")),
           "a_norm_mean": F.avg(top("a_norm")), "lat_speed_mean": F.avg(top("lat_speed_mps")),
           "ttc_min": F.min(top("ttc_s")), "dist3_any": F.max(top("dist_lt3")), "dist5_any": F.max(top("dist_lt5")),
           "dist8_any": F.max(top("dist_lt8")), "crossing_any": F.max(top("crossing_like")),
           "approach_any": F.max(top("approach_like"))}
    return {f"top{k}_{name}": c for name, c in out.items()}


def _best(col_or_struct, keys: Sequence[str], df: DataFrame, value: str, out: str) -> DataFrame:
    """Row of the largest ``value`` per key, ties to the smallest track id; two combinable aggregates in one."""
    ordered = F.struct((-F.col(value)).alias("v"), F.col("track_uuid").alias("t"))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(col_or_struct, ordered).alias(out))


def window_counts(features: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """FEA-07: counts of actors, vehicles, vulnerable road users, sectors and sustained ones."""
    return features.groupBy(*keys).agg(*[c.alias(n) for n, c in count_aggs().items()])


def window_map(features: DataFrame, keys: Sequence[str] = KEYS, near: float = 8.0) -> DataFrame:
    """FEA-08: minimum and mean map cues and the near-stop-line / near-crosswalk flags."""
    return features.groupBy(*keys).agg(*[c.alias(n) for n, c in map_aggs(near).items()])


def top_ranked(features: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """First ``k`` actors of each window by overlap; the limit is applied before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.col("p_overlap").desc_nulls_last(), "track_uuid")
    return features.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)


def window_topk(features: DataFrame, keys: Sequence[str] = KEYS, ks: Sequence[int] = TOP_KS) -> DataFrame:
    """FEA-09: thirteen aggregates for each top-K, one shuffle for all K."""
    aggs = {}
    for k in ks:
        aggs.update(top_aggs(k))
    return top_ranked(features, keys, max(ks)).groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def window_best(features: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """FEA-10: snapshot ``a1_*`` of the best actor by overlap."""
    best = _best(F.struct(*SNAPSHOT), keys, features, "p_overlap", "_b")
    return best.select(*keys, *[F.col("_b")[c].alias(f"a1_{c}") for c in SNAPSHOT])


def window_margins(features: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """FEA-11: margins of the best actor by overlap and by inverse distance."""
    df = features.withColumn("_inv", inverse_distance(F.col("dmin_m")))
    p = _best(F.col("margin_to_top_p"), keys, df, "p_overlap", "best_margin_to_top_p")
    d = _best(F.col("margin_to_top_inv_d"), keys, df, "_inv", "best_margin_to_top_invd")
    return p.join(d, list(keys), "full")


def window_table(features: DataFrame, keys: Sequence[str] = KEYS, ks: Sequence[int] = TOP_KS) -> DataFrame:
    """FEA-12: one row per window, keys first and the other columns sorted by name.

    Everything that is an aggregate over all actors shares one pass; top-K and best-actor values use the limited rows.
    """
    keys = list(keys)
    margin_d = F.max(F.when(F.col("rank_inv_dmin") == 1, F.col("margin_to_top_inv_d")))
    aggs = {**count_aggs(), **map_aggs(), "best_margin_to_top_invd": margin_d}
    whole = features.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    first = F.col("_rn") == 1
    top = {f"a1_{c}": F.max(F.when(first, F.col(c))) for c in SNAPSHOT}
    top["best_margin_to_top_p"] = F.max(F.when(first, F.col("margin_to_top_p")))
    for k in ks:
        top.update(top_aggs(k))
    # the ranked rows are sorted by window already, so the text columns of the snapshot need no sort of their own
    best = top_ranked(features, keys, max(ks)).groupBy(*keys).agg(*[c.alias(n) for n, c in top.items()])
    out = whole.join(best, keys)
    return out.select(*keys, *sorted(c for c in out.columns if c not in keys))


def numeric_columns(df: DataFrame, drop: Sequence[str]) -> list[str]:
    """PU-05: numeric columns other than keys and labels."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in set(drop)]
