"""S6-*: backends are line numbers, windows orders, labels return flags."""

from pyspark.sql import functions as F

from roadsift.operators import reason_eval as E
from roadsift.plans.registry import query

LABELS, ALIAS = ["f", "o"], {"a": "f", "n": "o", "r": "p"}
TRACE = """pd AS (SELECT l_linenumber AS backend_id, CAST(l_orderkey AS VARCHAR) AS window_key, l_returnflag AS raw, 1 - l_discount AS conf, 'm' || (l_linenumber % 3) AS model_name, 'p' || (l_linenumber % 2) AS prompt_type, l_suppkey % 4 AS sk
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY 1 - l_discount DESC, l_partkey, l_suppkey, l_returnflag) AS k FROM lineitem) WHERE k = 1),
tc AS (SELECT pd.*, CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderstatus) END AS gt, CASE raw WHEN 'A' THEN 'f' WHEN 'N' THEN 'o' ELSE 'p' END AS lab, sk FROM pd JOIN orders ON CAST(o_orderkey AS VARCHAR) = window_key),
tx AS (SELECT *, CASE WHEN gt IN ('f', 'o') THEN gt ELSE 'other' END AS ft, CASE WHEN lab IN ('f', 'o') THEN lab ELSE 'other' END AS fp FROM tc WHERE gt IS NOT NULL),
lb AS (SELECT backend_id, label, count(*) FILTER (ft = label AND fp = label) AS tp, count(*) FILTER (ft <> label AND fp = label) AS fpos, count(*) FILTER (ft = label AND fp <> label) AS fn, count(*) FILTER (ft = label) AS support FROM tx, (VALUES ('f'), ('o'), ('other')) AS v(label) GROUP BY ALL),
pf AS (SELECT *, CASE WHEN tp + fpos > 0 THEN tp / (tp + fpos) ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN 2 * tp + fpos + fn > 0 THEN 2 * tp / (2 * tp + fpos + fn) ELSE 0 END AS f1 FROM lb),
ag AS (SELECT backend_id, count(*) AS n_gt, 1.0 AS coverage, avg(CASE WHEN gt = lab THEN 1.0 ELSE 0.0 END) AS accuracy FROM tx GROUP BY backend_id),
mf AS (SELECT backend_id, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1, sum(tp) / sum(support) AS micro_acc FROM pf WHERE label <> 'other' GROUP BY backend_id)"""


def trace(t):
    c = F.col
    best = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min_by(
        F.struct("l_returnflag", "l_discount", "l_suppkey"), F.struct(-(1 - c("l_discount")), "l_partkey", "l_suppkey", "l_returnflag")).alias("b"))
    o = t.orders.select(c("o_orderkey").alias("l_orderkey"), F.when(c("o_orderkey") % 2 == 0, F.lower("o_orderstatus")).alias("gt_label"))
    return best.join(o, "l_orderkey").select(
        c("l_linenumber").alias("backend_id"), c("l_orderkey").cast("string").alias("window_key"), c("b.l_returnflag").alias("llm_label"), (1 - c("b.l_discount")).alias("llm_confidence"),
        F.concat(F.lit("m"), (c("l_linenumber") % 3).cast("string")).alias("model_name"), F.concat(F.lit("p"), (c("l_linenumber") % 2).cast("string")).alias("prompt_type"), "gt_label",
        F.concat(F.lit("t"), (c("b.l_suppkey") % 4).cast("string")).alias("primary_track"),
        F.array(F.lit("t0"), F.concat(F.lit("t"), (c("b.l_suppkey") % 4).cast("string"))).alias("top_tracks"))


@query("s6_01_norm_label", "o_orderkey:n label:s", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'top' WHEN o_orderpriority LIKE '4%' THEN NULL ELSE replace(replace(lower(trim(o_orderpriority)), ' ', '_'), '-', '_') END AS label FROM orders")
def s6_01(t):
    raw = F.when(F.col("o_orderpriority").startswith("4"), F.lit(" None ")).otherwise(F.concat(F.lit(" "), F.col("o_orderpriority")))
    return t.orders.select("o_orderkey", E.norm_label(raw, {"1_urgent": "top"}).alias("label"))


@query("s6_02_agreement_vs_gt", "backend_id:n n_gt:n coverage:d accuracy:d macro_f1:d", f"WITH {TRACE} SELECT ag.*, macro_f1 FROM ag JOIN mf USING (backend_id)")
def s6_02(t):
    return E.agreement_vs_gt(trace(t), LABELS, aliases=ALIAS)


@query("s6_03_confusion", "backend_id:n gt:s f:n o:n other:n", f"WITH {TRACE} SELECT backend_id, ft AS gt, count(*) FILTER (fp = 'f') AS f, count(*) FILTER (fp = 'o') AS o, count(*) FILTER (fp = 'other') AS other FROM tx GROUP BY ALL")
def s6_03(t):
    return E.confusion(trace(t), LABELS, ALIAS)


@query("s6_03_prf", "backend_id:n label:s precision:d recall:d f1:d support:n", f"WITH {TRACE} SELECT * FROM pf")
def s6_03_prf(t):
    return E.prf(trace(t), LABELS, ALIAS)


@query("s6_03_summary", "backend_id:n macro_precision:d macro_recall:d macro_f1:d weighted_f1:d micro_acc:d", f"WITH {TRACE} SELECT * FROM mf")
def s6_03_summary(t):
    return E.prf_summary(E.prf(trace(t), LABELS, ALIAS))


@query("s6_04_high_conf", "backend_id:n threshold:d precision:d coverage:d n:n", f"WITH {TRACE}, th(threshold) AS (VALUES (0.93e0), (0.955e0), (0.985e0)) SELECT backend_id, threshold, avg(CASE WHEN fp = gt THEN 1.0 ELSE 0.0 END) FILTER (conf >= threshold) AS precision, avg(CASE WHEN conf >= threshold THEN 1.0 ELSE 0.0 END) AS coverage, count(*) FILTER (conf >= threshold) AS n FROM tx, th GROUP BY ALL")
def s6_04(t):
    return E.high_conf(trace(t), LABELS, (0.93, 0.955, 0.985), ALIAS)


VOTE = """, c{n} AS (SELECT {by}, window_key, lab, count(*) AS n, avg(conf) AS c FROM tc GROUP BY ALL), v{n} AS (SELECT {by}, window_key, sum(n) AS votes, max(n) AS top, arg_min(lab, -n * 1000 + ascii(lab)) AS modal_label,
  max(n) / sum(n) AS agreement, arg_min(c, -n * 1000 + ascii(lab)) AS consensus_confidence, list(n) AS ns FROM c{n} GROUP BY ALL), e{n} AS (SELECT * EXCLUDE (ns), -list_sum([x / votes * ln(x / votes + 1e-12) for x in ns]) AS entropy FROM v{n})"""
PV, MV = TRACE + VOTE.format(n="p", by="model_name"), TRACE + VOTE.format(n="m", by="prompt_type")


@query("s6_05_prompt_consensus", "model_name:s window_key:s votes:n modal_label:s agreement:d entropy:d consensus_confidence:d", f"WITH {PV} SELECT * FROM ep")
def s6_05(t):
    return E.prompt_consensus(trace(t), ALIAS)


@query("s6_05_prompt_stability", "model_name:s mean_agreement:d low_entropy_frac:d mean_consensus_conf:d n_windows:n", f"WITH {PV} SELECT model_name, avg(agreement) AS mean_agreement, avg(CASE WHEN entropy <= ln(2) THEN 1.0 ELSE 0.0 END) AS low_entropy_frac, avg(consensus_confidence) AS mean_consensus_conf, count(*) AS n_windows FROM ep GROUP BY model_name")
def s6_05_stability(t):
    return E.prompt_stability(E.prompt_consensus(trace(t), ALIAS))


@query("s6_06_model_consensus", "prompt_type:s agreement_at_1:d agreement_at_2:d mean_entropy:d n_windows:n", f"WITH {MV} SELECT prompt_type, avg(CASE WHEN votes >= 3 AND top = 3 THEN 1.0 ELSE 0.0 END) AS agreement_at_1, avg(CASE WHEN top >= 2 THEN 1.0 ELSE 0.0 END) AS agreement_at_2, avg(entropy) AS mean_entropy, count(*) AS n_windows FROM em GROUP BY prompt_type")
def s6_06(t):
    return E.model_consensus(trace(t), ALIAS)


@query("s6_07_new_discoveries", "backend_id:n n_no_gt:n new_disc_count:n new_disc_rate:d", f"WITH {PV}, d AS (SELECT tc.backend_id, tc.window_key, conf >= 0.945 AND agreement >= 0.75 AND lab = modal_label AND lab <> 'p' AS ok FROM tc JOIN ep USING (model_name, window_key) WHERE gt IS NULL) "
       "SELECT backend_id, count(DISTINCT window_key) AS n_no_gt, count(DISTINCT CASE WHEN ok THEN window_key END) AS new_disc_count, count(DISTINCT CASE WHEN ok THEN window_key END) / count(DISTINCT window_key) AS new_disc_rate FROM d GROUP BY backend_id")
def s6_07(t):
    tr = trace(t)
    return E.new_discoveries(tr, E.prompt_consensus(tr, ALIAS), 0.945, 0.75, ("p",), ALIAS)


def _conf(t):
    tr = trace(t).where("gt_label IS NOT NULL")
    return tr.select((1 - (F.lit(1.0) - F.col("llm_confidence")) * 9.7).alias("conf"), (E.norm_label(F.col("llm_label"), ALIAS) == F.col("gt_label")).alias("ok"))


CONF = TRACE + ", cf AS (SELECT 1 - (1e0 - conf) * 9.7e0 AS conf, CASE WHEN lab = gt THEN 1.0 ELSE 0.0 END AS ok FROM tx)"


@query("s6_08_reliability", "bin:n lo:d hi:d n:n accuracy:d mean_conf:d frac:d", f"WITH {CONF}, e(bin, lo, hi) AS (VALUES (0, 0.0, 0.5), (1, 0.5, 0.7), (2, 0.7, 0.8), (3, 0.8, 0.9), (4, 0.9, 1.01)) SELECT bin, lo, hi, count(conf) AS n, avg(ok) AS accuracy, avg(conf) AS mean_conf, count(conf) / (SELECT count(*) FROM cf) AS frac "
       "FROM e LEFT JOIN cf ON conf >= lo AND conf < hi GROUP BY bin, lo, hi")
def s6_08(t):
    return E.reliability(_conf(t))


@query("s6_08_ece", "ece:d", f"WITH {CONF}, b AS (SELECT least(floor(conf * 10), 9) AS bin, count(*) AS n, avg(ok) AS a, avg(conf) AS m FROM cf GROUP BY 1) SELECT sum(n * abs(a - m)) / sum(n) AS ece FROM b")
def s6_08_ece(t):
    return E.ece(_conf(t))


HUMAN = TRACE + """, hm AS (SELECT CAST(o_orderkey AS VARCHAR) AS window_key, lower(o_orderstatus) AS hl, CASE WHEN o_orderkey % 7 <> 0 THEN 't' || (o_custkey % 4) END AS ht FROM orders),
hj AS (SELECT b.backend_id, hm.*, tc.lab, tc.sk FROM hm, (SELECT DISTINCT backend_id FROM pd) AS b LEFT JOIN tc ON tc.backend_id = b.backend_id AND tc.window_key = hm.window_key),
hf AS (SELECT backend_id, label, count(*) FILTER (ft = label AND fp = label) AS tp, count(*) FILTER (ft <> label AND fp = label) AS fpos, count(*) FILTER (ft = label AND fp <> label) AS fn FROM (SELECT backend_id, CASE WHEN hl IN ('f', 'o') THEN hl ELSE 'other' END AS ft, CASE WHEN lab IN ('f', 'o') THEN lab ELSE 'other' END AS fp FROM hj),
  (VALUES ('f'), ('o')) AS v(label) GROUP BY ALL)"""


@query("s6_09_human_alignment", "backend_id:n n_human:n coverage:d scenario_acc:d actor1_acc:d actor3_hit:d joint_correct:d scenario_macro_f1:d", f"""WITH {HUMAN}, m AS (SELECT backend_id, avg(CASE WHEN 2 * tp + fpos + fn > 0 THEN 2 * tp / (2 * tp + fpos + fn) ELSE 0 END) AS scenario_macro_f1 FROM hf GROUP BY 1),
  s AS (SELECT *, CASE WHEN hl = coalesce(lab, 'other') THEN 1.0 ELSE 0.0 END AS same, CASE WHEN 't' || sk = ht THEN 1.0 ELSE 0.0 END AS a1, CASE WHEN lab IS NOT NULL AND ('t' || sk = ht OR ht = 't0') THEN 1.0 ELSE 0.0 END AS a3 FROM hj)
  SELECT s.backend_id, count(*) AS n_human, avg(CASE WHEN lab IS NULL THEN 0.0 ELSE 1.0 END) AS coverage, avg(same) AS scenario_acc, avg(a1) FILTER (ht IS NOT NULL) AS actor1_acc, avg(a3) FILTER (ht IS NOT NULL) AS actor3_hit, avg(same * a1) FILTER (ht IS NOT NULL) AS joint_correct, any_value(scenario_macro_f1) AS scenario_macro_f1
  FROM s JOIN m USING (backend_id) GROUP BY s.backend_id""")
def s6_09(t):
    k = F.col("o_orderkey")
    actors = F.array(*[F.struct(F.lit(f"A{i}").alias("label"), F.lit(f"t{i}").alias("uuid")) for i in range(4)])
    rec = F.struct(F.col("o_custkey").cast("string").alias("log_id"), k.cast("string").alias("window_key"), F.struct(
        F.col("o_orderstatus").alias("scenario_label"), F.struct(F.when(k % 7 != 0, F.concat(F.lit("A"), (F.col("o_custkey") % 4).cast("string"))).alias("primary_trigger")).alias("fields")).alias("scenario"), actors.alias("actors"))
    raw = t.orders.select(k.alias("seq"), F.to_json(rec).alias("line"))
    return E.human_alignment(trace(t), E.parse_reviews(raw, {}), LABELS, ALIAS)


@query("s6_10_scoreboard", "backend_id:n macro_f1:d accuracy:d weighted_f1:d best:b worst:b", f"WITH {TRACE}, s AS (SELECT backend_id, macro_f1, accuracy, weighted_f1 FROM ag JOIN mf USING (backend_id)) SELECT *, row_number() OVER (ORDER BY macro_f1 DESC, accuracy DESC, backend_id) = 1 AS best, row_number() OVER (ORDER BY macro_f1, accuracy, backend_id) = 1 AS worst FROM s")
def s6_10(t):
    tr = trace(t)
    return E.scoreboard(E.agreement_vs_gt(tr, LABELS, aliases=ALIAS), E.prf_summary(E.prf(tr, LABELS, ALIAS)))


@query("s6_11_entropy", "user_id:n h:d", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS a FROM c) SELECT user_id, -sum(n / a * ln(n / a + 1e-12)) AS h FROM s GROUP BY user_id")
def s6_11(t):
    c = t.events.groupBy("user_id", "event_type").count()
    return c.groupBy("user_id").agg(F.collect_list("count").alias("n")).select("user_id", E.entropy(F.col("n")).alias("h"))
