"""Actor index and embeddings (EMB-*)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadsift.functions.durable import stored
from roadsift.functions.intervals import overlap_join
from roadsift.functions.keys import seeded_hash
from roadsift.functions.ordered import row_index
from roadsift.functions.quantiles import column_quantiles, wide_quantiles
from roadsift.operators.pu import ordered_split
from roadsift.operators.similarity import cosine_topk

# Numeric columns the embedding uses when at least 24 of them exist.
VITAL = ["x_rel_m", "y_rel_m", "r_rel_m", "dmin_m", "p_overlap", "t_at_dmin_s", "sustained_tight", "rel_speed_closing_mps",
         "lat_speed_mps", "a_norm", "length_m", "width_m", "bearing_rad", "ttc_s", "dist_lt3", "dist_lt5", "dist_lt8",
         "approach_like", "crossing_like", "heading_align_cos", "long_gap_m", "lat_offset_m", "map_lane_offset_m",
         "map_lane_alignment_cos", "dist_to_stopline_m", "dist_to_crosswalk_m", "in_drivable_area", "rank_p_overlap",
         "margin_to_top_p", "rank_inv_dmin", "margin_to_top_inv_d", "post_hmm", "score_final"]


def resolve_scores(final: DataFrame | None, hmm: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """EMB-01: final scores with the state of the smoothed table, or the smoothed table alone; state defaults to 0."""
    def once(df, cols):
        return df.groupBy(*key).agg(*[F.max(c).alias(c) for c in cols])
    if final is None:
        out = once(hmm.withColumn("score_final", F.col("post_hmm")), ["post_hmm", "score_final", "viterbi"])
    else:
        out = once(final, ["post_hmm", "score_final"])
        out = out.join(once(hmm, ["viterbi"]), list(key), "left") if hmm is not None else out.withColumn("viterbi", F.lit(None))
    return out.withColumn("viterbi", F.coalesce(F.col("viterbi").cast("int"), F.lit(0)))


def attach_episode(rows: DataFrame, episodes: DataFrame, log: str = "log_id", row_key: Sequence[str] = ("log_id", "t_start", "t_end")) -> DataFrame:
    """EMB-02: id of the episode that contains the window, -1 if none."""
    inside = overlap_join(rows.select(*row_key).distinct(), episodes.select(log, "episode_id", "t0", "t1"), [log],
                          ("t_start", "t_end"), ("t0", "t1")).where("t_start >= t0 AND t_end <= t1")
    ids = inside.groupBy(*row_key).agg(F.min("episode_id").alias("episode_id"))
    return rows.join(ids, list(row_key), "left").withColumn("episode_id", F.coalesce("episode_id", F.lit(-1)))


def keep_mask(scores: DataFrame, thr: float = 0.5, use_mask: bool = True) -> DataFrame:
    """EMB-03: windows with a high posterior or a positive state."""
    return scores.where((F.col("post_hmm") >= thr) | (F.col("viterbi") == 1)) if use_mask else scores


def join_n1(features: DataFrame, scores: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """EMB-04: inner join and the keys that break its n:1 contract."""
    dup = scores.groupBy(*key).count().where("count > 1")
    return features.join(scores, list(key)), dup


def prune_actors(df: DataFrame, r_max: float = 60.0, cap: int | None = None, win: str = "window_key") -> DataFrame:
    """EMB-05: actors within the radius, optionally the nearest ``cap`` of each window."""
    near = df.where(F.col("r_rel_m") <= r_max)
    if cap is None:
        return near
    w = Window.partitionBy(win).orderBy("r_rel_m", F.col("ttc_s").asc_nulls_last(), "p_overlap", "track_uuid")
    return near.withColumn("actor_rank", F.row_number().over(w)).where(F.col("actor_rank") <= cap)


def index_qc(index: DataFrame, scores: DataFrame, r_max: float = 60.0, lo: int = 1, hi: int = 40, win: str = "window_key") -> DataFrame:
    """EMB-06: (metric, value) report of the index; the offenders are ``index_offenders``."""
    base = index.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("r_rel_m") > r_max).alias("over_radius"),
                     F.avg(F.col("ttc_s").isNull().cast("double")).alias("ttc_null_rate"),
                     F.count_if((F.col("post_hmm") < 0) | (F.col("post_hmm") > 1)).alias("post_out_of_bounds"),
                     F.min("r_rel_m").alias("r_min"), F.max("r_rel_m").alias("r_max"))
    per = index.groupBy(win).agg(F.count_distinct("track_uuid").alias("n"))
    counts = per.agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("n") < lo).alias("too_few"), F.count_if(F.col("n") > hi).alias("too_many"))
    missing = per.join(scores.select(win).distinct(), win, "left_anti").agg(F.count(F.lit(1)).alias("windows_missing_scores"))
    q = wide_quantiles(per, [], "n", {"actors_p05": 0.05, "actors_p50": 0.5, "actors_p95": 0.95})

    def tall(df):
        return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])).alias("r")).select("r.*")
    cats = index.groupBy("category").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.concat(F.lit("category:"), "category").alias("metric"), "value")
    return tall(base).unionByName(tall(counts)).unionByName(tall(missing)).unionByName(tall(q)).unionByName(cats)


def index_offenders(index: DataFrame, r_max: float = 60.0) -> DataFrame:
    """EMB-06: rows beyond the radius."""
    return index.where(F.col("r_rel_m") > r_max)


def select_features(df: DataFrame, whitelist: Sequence[str] = VITAL, drop: Sequence[str] = (), least: int = 24) -> list[str]:
    """EMB-07: whitelisted columns when enough exist, else all numeric ones by name."""
    have = [c for c in whitelist if c in df.columns]
    return have if len(have) >= least else sorted(f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in drop)


def robust_stats(fit: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Median and median absolute deviation (0 becomes 1) of each column; nothing for columns without values."""
    kept = stored(fit.select(*cols), "robust-columns")  # read in every pass
    med = column_quantiles(kept, {c: F.col(c) for c in cols}, 0.5)
    known = {c: m for c, m in med.items() if m is not None}
    mad = column_quantiles(kept, {c: F.abs(F.col(c) - F.lit(m)) for c, m in known.items()}, 0.5) if known else {}
    return {c: (m, mad[c] if mad[c] > 0 else 1.0) for c, m in known.items()}


def robust_scale(fit: DataFrame, df: DataFrame, cols: Sequence[str], clip: float = 8.0) -> DataFrame:
    """EMB-08: (x - median) / MAD with missing values at the median, clipped; null where a column has no value at all."""
    stats = robust_stats(fit, cols)

    def scaled(c: str) -> Column:
        if c not in stats:
            return F.lit(None).cast("double")
        med, mad = map(F.lit, stats[c])
        return F.least(F.greatest((F.coalesce(F.col(c).cast("double"), med) - med) / mad, F.lit(-clip)), F.lit(clip))
    return df.withColumns({c: scaled(c) for c in cols})


def window_holdout(df: DataFrame, key: str = "window_key", frac: float = 0.15, seed: int = 1337) -> DataFrame:
    """EMB-09: hold out whole windows."""
    return df.join(ordered_split(df, key, frac, seed), key)


def sample_pairs(df: DataFrame, pool: Sequence[str], item: str = "item_id", seed: int = 1337) -> DataFrame:
    """EMB-10: one positive partner per row: the next one of its pool in seeded order, as a ring.

    A row alone in its pool takes the next row of the seeded order of all rows.  Partners come from numbered
    positions and an equi join, so no pool is paired with itself.
    """
    h = df.select(item, *pool).withColumn("_h", seeded_hash(seed, F.col(item)))
    def ring(keys, out):
        idx = row_index(h, keys, ["_h", item], out="_k")
        n = idx.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if keys else None
        if keys:
            sized = idx.join(n, list(keys))
        else:
            sized = idx.withColumn("_n", idx.agg(F.count(F.lit(1))).scalar())
        nxt = idx.select(*keys, F.col("_k").alias("_to"), F.col(item).alias(out))
        return sized.withColumn("_to", (F.col("_k") + 1) % F.col("_n")).join(nxt, [*keys, "_to"]).select(item, F.col("_n").alias(f"{out}_n"), out)
    mine, any_ = ring(list(pool), "pool_partner"), ring([], "any_partner")
    return mine.join(any_, item).select(F.col(item).alias("i"), F.when(F.col("pool_partner_n") >= 2, F.col("pool_partner"))
                                        .otherwise(F.col("any_partner")).alias("j"), (F.col("pool_partner_n") >= 2).alias("from_pool"))


def _matrix(batch, cols: Sequence[str]) -> np.ndarray:
    return np.nan_to_num(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cols]))


def principal_axes(df: DataFrame, cols: Sequence[str], dim: int, rounds: int = 200, tol: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """EMB-11: the ``dim`` axes of greatest variance as columns, and their variances.

    One pass adds up the Gram matrix in blocks; it has as many rows as there are columns, so its decomposition by block power iteration
    (multiply, orthonormalise, until the axes stand still) needs no data.  An axis's largest entry is positive."""
    names, d = list(cols), len(cols)

    def part(batches):
        total = np.zeros((d + 1, d + 1))
        for batch in batches:
            x = np.column_stack([_matrix(batch, names), np.ones(batch.num_rows)])
            total += x.T @ x
        yield pa.record_batch({"at": pa.array(np.arange(total.size), pa.int32()), "v": pa.array(total.ravel())})

    gram = np.zeros((d + 1) ** 2)
    for r in df.select(*names).mapInArrow(part, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        gram[r["at"]] = r["v"]
    gram = gram.reshape(d + 1, d + 1)
    n = max(gram[-1, -1], 1.0)
    covariance = gram[:d, :d] / n - np.outer(gram[:d, -1], gram[-1, :d]) / n ** 2
    axes = np.linalg.qr(np.random.default_rng(0).normal(size=(d, d)))[0]
    shift = np.trace(covariance) * 1e-9 + 1e-12  # keeps directions without variance apart
    for _ in range(rounds):
        new, _ = np.linalg.qr((covariance + shift * np.eye(d)) @ axes)
        moved = np.abs(np.abs((new * axes).sum(axis=0)) - 1).max()
        axes = new
        if moved < tol:
            break
    spread = ((covariance @ axes) * axes).sum(axis=0)
    axes = axes[:, np.argsort(-spread, kind="stable")][:, :dim]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return axes, np.sort(spread)[::-1][:dim]


def embed_actors(df: DataFrame, cols: Sequence[str], dim: int = 128, out: str = "embedding") -> DataFrame:
    """EMB-11: principal components of robust features as a unit vector, with its norm before scaling; at most as many as columns."""
    names = list(cols)
    axes, _ = principal_axes(df, names, min(dim, len(names)))

    def project(batches):
        for batch in batches:
            y = _matrix(batch, names) @ axes
            norm = np.linalg.norm(y, axis=1)
            unit_rows = y / np.where(norm > 0, norm, 1)[:, None]
            offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
            yield pa.record_batch([*batch.columns, pa.array(norm), pa.ListArray.from_arrays(offsets, pa.array(unit_rows.ravel()))], [*batch.schema.names, "norm", out])

    kinds = T.StructType([*df.schema.fields, T.StructField("norm", T.DoubleType()), T.StructField(out, T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(project, kinds)


def nn_recall(emb: DataFrame, vec: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """EMB-12: share of rows whose nearest other row is of the same window: overall, and per window with two rows or more."""
    top = cosine_topk(emb, emb.withColumnRenamed("id", "query_id"), 1, vec, not_self=True)
    who = emb.select(F.col("id").alias("query_id"), F.col("window_key").alias("_w"))
    hit = top.join(who, "query_id").join(emb.select("id", F.col("window_key").alias("_nw")), "id")
    hit = hit.withColumn("same", (F.col("_w") == F.col("_nw")).cast("double"))
    per = hit.groupBy(F.col("_w").alias("window_key")).agg(F.avg("same").alias("recall"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return hit.agg(F.avg("same").alias("recall"), F.count(F.lit(1)).alias("rows")), per

