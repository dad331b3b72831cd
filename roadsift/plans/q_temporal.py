"""TMP-*: score fusion and smoothing over consecutive event windows."""

from pyspark.sql import functions as F

from roadsift.operators import temporal as T
from roadsift.plans.fixtures import SCORES, window_scores
from roadsift.plans.registry import query

MERGE = SCORES + """, merged AS (SELECT log_id, i, t_start, t_end,
    least(greatest(coalesce(CASE WHEN event_id % 7 <> 0 THEN s_a END, 1e-5), 1e-5), 1 - 1e-5) AS score_pu_xgb,
    least(greatest(coalesce(CASE WHEN event_id % 11 <> 0 THEN s_b END, 1e-5), 1e-5), 1 - 1e-5) AS score_nnpu FROM scores)"""

FUSED = MERGE + """, fused AS (SELECT *, 1.0 / (1.0 + exp(-(0.5 * (ln(score_pu_xgb) - ln(1 - score_pu_xgb))
    + 0.5 * (ln(score_nnpu) - ln(1 - score_nnpu))))) AS score_fused FROM merged),
em AS (SELECT *, least(greatest(score_fused, 1e-6), 1 - 1e-6) / least(greatest(1 - score_fused, 1e-6), 1 - 1e-6) AS rho,
    max(i) OVER (PARTITION BY log_id) AS last_i FROM fused),
pr AS (SELECT least(greatest(avg(score_fused), 1e-3), 0.999) AS pi FROM fused)"""

A11, A10, A01, A00 = "CAST(0.85 AS DOUBLE)", "CAST(0.15 AS DOUBLE)", "CAST(0.05 AS DOUBLE)", "CAST(0.95 AS DOUBLE)"

# one recursion per direction: probabilities are kept as odds of state 1
ALL = f"""RECURSIVE {FUSED},
ema(log_id, i, y) AS (SELECT log_id, i, score_fused FROM fused WHERE i = 0
  UNION ALL SELECT f.log_id, f.i, 0.4 * f.score_fused + 0.6 * e.y FROM ema AS e
  JOIN fused AS f ON f.log_id = e.log_id AND f.i = e.i + 1),
fwd(log_id, i, o, d) AS (SELECT log_id, i, rho * pi / (1 - pi), ln(rho) + ln(pi / (1 - pi)) FROM em, pr WHERE i = 0
  UNION ALL SELECT e.log_id, e.i, e.rho * (f.o * {A11} + {A01}) / (f.o * {A10} + {A00}),
    ln(e.rho) + greatest(f.d + ln({A11}), ln({A01})) - greatest(f.d + ln({A10}), ln({A00}))
  FROM fwd AS f JOIN em AS e ON e.log_id = f.log_id AND e.i = f.i + 1),
bwd(log_id, i, w, rho) AS (SELECT log_id, i, 1.0::DOUBLE, rho FROM em WHERE i = last_i
  UNION ALL SELECT e.log_id, e.i, ({A10} + {A11} * b.rho * b.w) / ({A00} + {A01} * b.rho * b.w), e.rho
  FROM bwd AS b JOIN em AS e ON e.log_id = b.log_id AND e.i = b.i - 1),
psi AS (SELECT log_id, i, d, CAST(lag(d) OVER w + ln({A10}) > ln({A00}) AS INT) AS p0,
    CAST(lag(d) OVER w + ln({A11}) > ln({A01}) AS INT) AS p1, max(i) OVER (PARTITION BY log_id) AS last_i
  FROM fwd WINDOW w AS (PARTITION BY log_id ORDER BY i)),
path(log_id, i, st) AS (SELECT log_id, i, CAST(d > 0 AS INT) FROM psi WHERE i = last_i
  UNION ALL SELECT p.log_id, p.i - 1, CASE WHEN q.st = 1 THEN p.p1 ELSE p.p0 END
  FROM path AS q JOIN psi AS p ON p.log_id = q.log_id AND p.i = q.i WHERE p.i > 0),
smooth AS (SELECT f.log_id, f.i, f.t_start, f.t_end, f.score_pu_xgb, f.score_nnpu, f.score_fused, ema.y AS score_ema,
    o * w / (1 + o * w) AS post_hmm, st AS viterbi FROM fused AS f JOIN ema USING (log_id, i) JOIN fwd USING (log_id, i)
  JOIN bwd USING (log_id, i) JOIN path USING (log_id, i)),
r1 AS (SELECT *, CASE WHEN lag(viterbi) OVER w IS NOT DISTINCT FROM viterbi THEN 0 ELSE 1 END AS fresh FROM smooth
  WINDOW w AS (PARTITION BY log_id ORDER BY i)),
r2 AS (SELECT *, sum(fresh) OVER (PARTITION BY log_id ORDER BY i) AS run FROM r1),
runs AS (SELECT log_id, viterbi AS state, arg_min(t_start, i) AS t_start, arg_max(t_end, i) AS t_end,
    count(*) AS n_windows, max(post_hmm) AS post_max, avg(post_hmm) AS post_mean FROM r2 GROUP BY log_id, run, viterbi)"""


def merged(t):
    scores = window_scores(t)
    key = ["log_id", "i"]
    first = scores.where("event_id % 7 <> 0").select(*key, F.col("s_a").alias("score_pu_xgb"))
    second = scores.where("event_id % 11 <> 0").select(*key, F.col("s_b").alias("score_nnpu"))
    return T.merge_scores(scores.select(*key, "t_start", "t_end"), first, second, key)


def fused(t):
    return merged(t).withColumn("score_fused", T.fuse_logit(F.col("score_pu_xgb"), F.col("score_nnpu")))


@query("tmp_01_merge_scores", "log_id:s i:n score_pu_xgb:d score_nnpu:d", f"WITH {MERGE} SELECT * FROM merged")
def tmp_01(t):
    return merged(t)


@query("tmp_02_fuse_logit", "log_id:s i:n score_fused:d", f"WITH {FUSED} SELECT * FROM fused")
def tmp_02(t):
    return fused(t)


@query("tmp_03_prior", "pi:d", f"WITH {FUSED} SELECT * FROM pr")
def tmp_03(t):
    f = fused(t)
    return t.spark.range(1).select(T.prior(f, "score_fused").alias("pi"))


@query("tmp_04_ema", "log_id:s i:n score_ema:d", f"WITH {ALL} SELECT log_id, i, score_ema FROM smooth")
def tmp_04(t):
    return T.ema(fused(t), "score_fused")


@query("tmp_05_hmm_posterior", "log_id:s i:n post_hmm:d", f"WITH {ALL} SELECT log_id, i, post_hmm FROM smooth")
def tmp_05(t):
    return T.hmm_posterior(fused(t), "score_fused")


@query("tmp_06_viterbi", "log_id:s i:n viterbi:n", f"WITH {ALL} SELECT log_id, i, viterbi FROM smooth")
def tmp_06(t):
    return T.viterbi(fused(t), "score_fused")


@query("tmp_07_state_segments", "log_id:s state:n t_start:d t_end:d duration_s:d n_windows:n",
       f"WITH {ALL} SELECT *, t_end - t_start AS duration_s FROM runs")
def tmp_07(t):
    return T.state_segments(T.viterbi(fused(t), "score_fused"))


@query("tmp_08_final_score", "log_id:s i:n score_final:d",
       f"WITH {ALL} SELECT log_id, i, post_hmm AS score_final FROM smooth")
def tmp_08(t):
    return T.final_score(T.hmm_posterior(fused(t), "score_fused"), "hmm")


@query("tmp_09_episodes", "log_id:s t0:d t1:d duration_s:d post_max:d post_mean:d n_windows:n",
       f"WITH {ALL} SELECT log_id, t_start AS t0, t_end AS t1, t_end - t_start AS duration_s, post_max, post_mean, "
       "n_windows FROM runs WHERE state = 1")
def tmp_09(t):
    return T.episodes(T.smooth(fused(t), "score_fused", want=("post", "state")))
