"""PU-*: weak labels and calibration over actors and labelled documents."""

from pyspark.sql import functions as F

from roadsift.functions.keys import window_key
from roadsift.operators import features as A
from roadsift.operators import pu as P
from roadsift.plans.fixtures import ACTORS, actors
from roadsift.plans.registry import query

TAGS = ACTORS + """, tags AS (SELECT CAST(c_custkey AS VARCHAR) AS log_id, c_custkey % 3 <> 0 AS has_guest,
    CASE WHEN c_custkey % 3 <> 0 THEN 't' || (c_custkey % 4) END AS guest_id, c_mktsegment AS tag FROM customer),
tagged AS (SELECT log_id, 't' || sector_id AS track_uuid, window_t_start, window_t_end, window_center, p_overlap, dmin_m,
    sustained_tight FROM actors),
lab AS (SELECT log_id, track_uuid, window_t_start AS t_start, window_t_end AS t_end, 1 AS label, tag AS scenario_label
  FROM (SELECT a.*, tag, row_number() OVER (PARTITION BY a.log_id, track_uuid, tag
      ORDER BY sustained_tight DESC, p_overlap DESC, dmin_m, window_center) AS rn
    FROM tagged AS a JOIN tags AS t ON a.log_id = t.log_id AND a.track_uuid = t.guest_id WHERE has_guest) WHERE rn = 1)"""

PU = """pu AS (SELECT d.doc_id, source AS log_id, d.doc_id * 1e0 AS t_start, d.doc_id + 1e0 AS t_end,
    least(n_chars / 5000e0, 1e0) AS score, (d.doc_id % 97) / 97e0 AS other, n_chars * 1e0 AS x1,
    CASE WHEN d.doc_id % 5 <> 0 THEN (d.doc_id % 31) * 1e0 END AS x2, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS y
  FROM documents AS d LEFT JOIN labels AS l ON l.doc_id = d.doc_id)"""


def tags(t):
    key = F.col("c_custkey")
    return t.customer.select(key.cast("string").alias("log_id"), (key % 3 != 0).alias("has_guest"),
                             F.when(key % 3 != 0, F.concat(F.lit("t"), (key % 4).cast("string"))).alias("guest_id"),
                             F.col("c_mktsegment").alias("tag"))


def sector_tracks(t):
    """Actors whose track is the sector, so that one track shows up in several windows of a log."""
    return actors(t).withColumn("track_uuid", F.concat(F.lit("t"), F.col("sector_id").cast("string")))


def pu(t):
    d = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    key = F.col("doc_id")
    return d.select("doc_id", F.col("source").alias("log_id"), key.cast("double").alias("t_start"),
                    (key + F.lit(1.0)).alias("t_end"), F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("score"),
                    (key % 97 / 97.0).alias("other"), F.col("n_chars").cast("double").alias("x1"),
                    F.when(key % 5 != 0, (key % 31).cast("double")).alias("x2"),
                    F.when(F.col("quality") == 0, 1).otherwise(0).alias("y"))


@query("pu_01_normalise_tags", "log_id:s has_guest:b guest_id:s tag:s",
       f"WITH {TAGS} SELECT * FROM tags WHERE log_id IN (SELECT log_id FROM actors)")
def pu_01(t):
    return P.normalise_tags(tags(t), actors(t))


LABEL_SPEC = "log_id:s track_uuid:s t_start:d t_end:d label:n scenario_label:s"


@query("pu_02_label_windows", LABEL_SPEC, f"WITH {TAGS} SELECT * FROM lab")
def pu_02(t):
    return P.label_windows(sector_tracks(t), tags(t))


@query("pu_03_attach_rescued", LABEL_SPEC + " rescued:b",
       f"WITH {TAGS} SELECT l.*, coalesce(r.rescued, FALSE) AS rescued FROM lab AS l LEFT JOIN (SELECT DISTINCT log_id, "
       "window_t_start, window_t_end, o_orderkey % 2 = 0 AS rescued FROM actors WHERE o_orderkey % 3 <> 0) AS r "
       "ON l.log_id = r.log_id AND l.t_start = r.window_t_start AND l.t_end = r.window_t_end")
def pu_03(t):
    labels = P.label_windows(sector_tracks(t), tags(t)).withColumn(
        "window_key", window_key(F.col("log_id"), F.col("t_start"), F.col("t_end")))
    wins = t.orders.where("o_orderkey % 3 <> 0").select(
        window_key(F.col("o_custkey").cast("string"), F.col("o_orderkey"), F.col("o_orderkey") + 2).alias("window_key"),
        (F.col("o_orderkey") % 2 == 0).alias("rescued"))
    return P.attach_rescued(labels, wins)


@query("pu_04_pu_targets", "log_id:s window_t_start:d y:n",
       f"WITH {TAGS} SELECT w.log_id, w.window_t_start, CASE WHEN l.log_id IS NULL THEN 0 ELSE 1 END AS y FROM (SELECT DISTINCT "
       "log_id, window_t_start FROM actors) AS w LEFT JOIN (SELECT DISTINCT log_id, t_start FROM lab) AS l "
       "ON w.log_id = l.log_id AND w.window_t_start = l.t_start")
def pu_04(t):
    wins = actors(t).select("log_id", "window_t_start").distinct()
    labels = P.label_windows(sector_tracks(t), tags(t)).withColumnRenamed("t_start", "window_t_start")
    return P.pu_targets(wins, labels, ["log_id", "window_t_start"])


@query("pu_05_numeric_features", "name:s n:n mean:d",
       f"WITH {PU} SELECT 'x1' AS name, count(x1) AS n, avg(x1) AS mean FROM pu UNION ALL SELECT 'x2', count(x2), avg(x2) FROM pu "
       "UNION ALL SELECT 'score', count(score), avg(score) FROM pu UNION ALL SELECT 'other', count(other), avg(other) FROM pu")
def pu_05(t):
    df = pu(t)
    cols = A.numeric_columns(df, ["doc_id", "log_id", "t_start", "t_end", "y"])
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in cols])).alias("r")) \
        .select("r.*").groupBy("name").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))


@query("pu_06_impute_median", "doc_id:n x1:d x2:d",
       f"WITH {PU}, m AS (SELECT quantile_cont(x2, 0.5) AS m2 FROM pu WHERE y = 0) SELECT doc_id, x1, coalesce(x2, m2) AS x2 FROM pu, m")
def pu_06(t):
    df = pu(t)
    return P.impute_median(df.where("y = 0"), df, ["x1", "x2"])


SPLIT = ("sp AS (SELECT log_id, CASE WHEN row_number() OVER (ORDER BY md5('1337|' || log_id), log_id) <= "
         "ceil(0.2 * (SELECT count(DISTINCT log_id) FROM pu)) THEN 'val' ELSE 'train' END AS split "
         "FROM (SELECT DISTINCT log_id FROM pu))")


@query("pu_07_group_split", "doc_id:n log_id:s split:s", f"WITH {PU}, {SPLIT} SELECT doc_id, log_id, split FROM pu JOIN sp USING (log_id)")
def pu_07(t):
    return P.group_split(pu(t))


@query("pu_08_fit_boosted", "doc_id:n y:n score:d")
def pu_08(t):
    """A short ensemble; the published 600 trees are the operator's default."""
    df = P.impute_median(pu(t).drop("score"), pu(t).drop("score"), ["x1", "x2"])
    model = P.fit_boosted(df, ["x1", "x2", "other"], trees=5, depth=3)
    return P.score_boosted(df, model)


@query("pu_09_elkan_noto", "doc_id:n c:d calibrated:d",
       f"WITH {PU}, {SPLIT}, c AS (SELECT least(greatest(coalesce(avg(score) FILTER (y = 1 AND split = 'val'), "
       "avg(score) FILTER (y = 1), 1.0), 1e-3), 1.0) AS c FROM pu JOIN sp USING (log_id)) "
       "SELECT doc_id, c, least(greatest(score / c, 0.0), 1.0) AS calibrated FROM pu, c")
def pu_09(t):
    df = P.group_split(pu(t)).withColumn("held", F.col("split") == "val")
    return P.elkan_noto(df, held_out="held")


@query("pu_10_ap_auc", "ap:d auc:d",
       f"WITH {PU}, s AS (SELECT score, sum(y) AS pos, count(*) AS rows_ FROM pu GROUP BY score), "
       "c AS (SELECT *, sum(pos) OVER w AS tp, sum(rows_) OVER w AS seen FROM s WINDOW w AS (ORDER BY score DESC)) "
       "SELECT sum(pos * tp / seen) / sum(pos) AS ap, sum((rows_ - pos) * (tp - pos / 2.0)) / "
       "(sum(pos) * CAST(sum(rows_ - pos) AS DOUBLE)) AS auc FROM c")
def pu_10(t):
    return P.ap_auc(pu(t))


@query("pu_11_class_prior", "c:d pi:d",
       f"WITH {PU}, c AS (SELECT least(greatest(avg(score) FILTER (y = 1), 1e-3), 0.999) AS c, avg(score) AS m FROM pu) "
       "SELECT c, least(greatest(m / c, 1e-3), 0.999) AS pi FROM c")
def pu_11(t):
    return P.class_prior(pu(t))


DUP = PU + ", dup AS (SELECT log_id, doc_id // 2 AS win, score, other FROM pu)"


@query("pu_12_dedup_scores", "how:s log_id:s win:n score:d other:d",
       f"WITH {DUP} SELECT 'mean' AS how, log_id, win, avg(score) AS score, NULL AS other FROM dup GROUP BY log_id, win "
       "UNION ALL SELECT 'max', log_id, win, max(score), max(other) FROM dup GROUP BY log_id, win "
       "UNION ALL SELECT 'best', log_id, win, score, other FROM (SELECT *, row_number() OVER (PARTITION BY log_id, win "
       "ORDER BY score DESC, other DESC) AS rn FROM dup) WHERE rn = 1")
def pu_12(t):
    df = pu(t).select("log_id", F.floor(F.col("doc_id") / 2).alias("win"), "score", "other")
    key = ["log_id", "win"]
    mean = P.dedup_scores(df, key, "mean").withColumn("other", F.lit(None).cast("double")).withColumn("how", F.lit("mean"))
    return mean.unionByName(P.dedup_scores(df, key, "max").withColumn("how", F.lit("max"))) \
               .unionByName(P.dedup_scores(df, key, "best").withColumn("how", F.lit("best")))


@query("pu_13_standardise", "doc_id:n x1:d x2:d",
       f"WITH {PU}, s AS (SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM pu WHERE y = 0) "
       "SELECT doc_id, (x1 - m1) / s1 AS x1, (coalesce(x2, m2) - m2) / s2 AS x2 FROM pu, s")
def pu_13(t):
    df = pu(t)
    return P.standardise(df.where("y = 0"), df, ["x1", "x2"])


COLUMNS = ["x1", "x2", "score", "other"]
STD = ", ".join(f"(coalesce({c}, avg({c}) OVER ()) - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in COLUMNS)


@query("pu_14_fit_nnpu_linear", "doc_id:n score:d")
def pu_14(t):
    """All numeric columns, until no step lowers the risk."""
    df = P.standardise(pu(t), pu(t), COLUMNS)
    w, b, _ = P.fit_nnpu_linear(df, COLUMNS, pi=0.3)
    return df.withColumn("score", P.linear_score(COLUMNS, w, b))


@query("pu_14_first_step", "weight:n slope:d risk:d", f"WITH {PU}, s AS (SELECT y, 1e0 AS one, {STD} FROM pu) " + " UNION ALL ".join(
    f"SELECT {k} AS weight, -0.15 * avg({c}) FILTER (y = 1) + 0.5 * avg({c}) FILTER (y = 0) - 0.15 * avg({c}) FILTER (y = 1) AS slope, ln(2.0) AS risk FROM s" for k, c in enumerate([*COLUMNS, "one"])))
def pu_14_first(t):
    """Slopes and risk at weights of zero, where every probability is a half."""
    df = P.standardise(pu(t), pu(t), COLUMNS)
    risk, slopes = P.nnpu_risk(df, COLUMNS, 0.3, [0.0] * 5)
    return t.spark.createDataFrame([(k, float(v), risk) for k, v in enumerate(slopes)], "weight int, slope double, risk double")


@query("pu_15_score", "doc_id:n score:d",
       f"WITH {PU} SELECT doc_id, 1.0 / (1.0 + exp(-(0.25 + 0.8 * other - 0.5 * score))) AS score FROM pu")
def pu_15(t):
    return pu(t).withColumn("score", P.linear_score(["other", "score"], [0.8, -0.5], 0.25))


FOLDS = PU + """, f AS (SELECT *, CAST('0x' || substr(md5('1337|' || log_id), 1, 8) AS BIGINT) % 5 AS fold FROM pu WHERE y = 1),
fr AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score) - 1 AS r, count(*) OVER (PARTITION BY fold) AS n FROM f),
tau AS (SELECT fold, max(score) FILTER (r = round_even((n - 1) * (1e0 - 0.9e0), 0)) AS tau FROM fr GROUP BY fold),
folds AS (SELECT fold, tau, count(*) AS n_pos, avg(CASE WHEN score >= tau THEN 1.0 ELSE 0.0 END) AS recall_at_tau,
    min(score) AS pos_min, quantile_cont(score, 0.5) AS pos_median, max(score) AS pos_max FROM f JOIN tau USING (fold) GROUP BY fold, tau),
t AS (SELECT quantile_cont(tau, 0.25) AS lo, quantile_cont(tau, 0.5) AS hi FROM folds)"""


def folds(t):
    return P.calibrate_tau(pu(t).where("y = 1"))


@query("pu_16_calibrate_tau", "fold:n tau:d n_pos:n recall_at_tau:d pos_min:d pos_median:d pos_max:d", f"WITH {FOLDS} SELECT * FROM folds")
def pu_16(t):
    return folds(t)


@query("pu_16_tau_summary", "tau:d achieved_recall:d n_pos:n",
       f"WITH {FOLDS} SELECT hi AS tau, avg(CASE WHEN score >= hi THEN 1.0 ELSE 0.0 END) AS achieved_recall, count(*) AS n_pos FROM f, t GROUP BY hi")
def pu_16_summary(t):
    return P.tau_summary(folds(t), pu(t).where("y = 1"))


@query("pu_17_tau_tiers", "tau_lo:d tau_hi:d", f"WITH {FOLDS} SELECT lo AS tau_lo, hi AS tau_hi FROM t")
def pu_17(t):
    return P.tau_tiers(folds(t))


TIERED = FOLDS + """, tiered AS (SELECT pu.*, CASE WHEN score >= hi THEN 'hi' WHEN score >= lo THEN 'lo' ELSE 'none' END AS conf_level
    FROM pu, t WHERE log_id NOT IN (SELECT min(source) FROM documents)),
pseudo AS (SELECT *, CASE WHEN conf_level = 'hi' THEN 1.0 ELSE 0.6 END AS weight FROM tiered WHERE conf_level <> 'none')"""


def _bounds(t):
    b = P.tau_tiers(folds(t))
    return b.select("tau_lo").scalar(), b.select("tau_hi").scalar()


def _excluded(t):
    return t.documents.agg(F.min("source").alias("log_id"))


def pseudo(t):
    lo, hi = _bounds(t)
    return P.pseudo_labels(pu(t), lo, hi, exclude=_excluded(t))


@query("pu_18_pseudo_labels", "doc_id:n conf_level:s weight:d", f"WITH {TIERED} SELECT * FROM pseudo")
def pu_18(t):
    return pseudo(t)


@query("pu_19_tier_summary", "conf_level:s n_windows:n score_min:d score_median:d score_max:d",
       f"WITH {TIERED} SELECT conf_level, count(*) AS n_windows, min(score) AS score_min, quantile_cont(score, 0.5) AS score_median, "
       "max(score) AS score_max FROM tiered GROUP BY conf_level")
def pu_19(t):
    lo, hi = _bounds(t)
    return P.tier_summary(P.tiers(pu(t), lo, hi, exclude=_excluded(t)))


@query("pu_20_train_targets", "doc_id:n target:n target_weight:d target_source:s",
       f"WITH {TIERED} SELECT p.doc_id, CASE WHEN p.y = 1 OR s.doc_id IS NOT NULL THEN 1 ELSE 0 END AS target, "
       "CASE WHEN p.y = 1 THEN 1.0 ELSE coalesce(s.weight, 0.0) END AS target_weight, CASE WHEN p.y = 1 THEN 'gt' "
       "WHEN s.doc_id IS NOT NULL THEN 'pseudo' ELSE 'unlabeled' END AS target_source FROM pu AS p LEFT JOIN pseudo AS s USING (doc_id)")
def pu_20(t):
    df = pu(t)
    return P.train_targets(df, df.where("y = 1"), pseudo(t), ["doc_id"])


@query("pu_21_sample_pu", "doc_id:n y:n",
       f"WITH {PU}, u AS (SELECT doc_id, y, row_number() OVER (ORDER BY md5('1337|' || doc_id), doc_id) AS k FROM pu WHERE y = 0) "
       "SELECT doc_id, y FROM pu WHERE y = 1 UNION ALL SELECT doc_id, y FROM u WHERE k <= 2 * (SELECT count(*) FROM pu WHERE y = 1)")
def pu_21(t):
    return P.sample_pu(pu(t), "doc_id")
