"""Queries of folds, scores, paired statistics and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import digits
from ..operators import experiments as ex
from ..operators import features as ft
from ..operators import learning as ml
from ..operators import stats as st
from ..views import BANDS, labelled, observations, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


FOLDS = "f AS (SELECT c_custkey, c_mktsegment, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('13|' || c_custkey), c_custkey) - 1) % 5 AS fold FROM customer)"


def _folds(spark, d):
    return st.stratified_folds(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 5, 13)


@query(f"WITH {FOLDS} SELECT * FROM f")
def fold_assign(spark, d):
    return _folds(spark, d)


@query("""SELECT c_custkey, c_mktsegment, repeat, (row_number() OVER (PARTITION BY repeat, c_mktsegment ORDER BY md5('13|' || repeat || '|' || c_custkey), c_custkey) - 1) % 5 AS fold FROM customer CROSS JOIN (SELECT unnest(range(10)) AS repeat)""")
def repeated_folds(spark, d):
    return st.repeated_folds(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 5, 10, 13)


PRED = f"{FOLDS}, p AS (SELECT fold, c_mktsegment AS label, CASE WHEN c_custkey % 3 = 0 THEN 'BUILDING' WHEN c_custkey % 7 = 0 THEN 'OTHER' ELSE c_mktsegment END AS predicted FROM f)"
SCORES = f"""{PRED}, t AS (SELECT fold, label AS c, count(*) AS n_true, count(*) FILTER (label = predicted) AS hit FROM p GROUP BY 1, 2), g AS (SELECT fold, predicted AS c, count(*) AS n_pred FROM p GROUP BY 1, 2),
    s AS (SELECT coalesce(t.fold, g.fold) AS fold, avg(CASE WHEN n_true > 0 THEN hit / CAST(n_true AS DOUBLE) END) AS balanced_accuracy, avg(2e0 * coalesce(hit, 0) / (coalesce(n_true, 0) + coalesce(n_pred, 0))) AS macro_f1 FROM t FULL JOIN g ON t.fold = g.fold AND t.c = g.c GROUP BY 1)"""


def _scores(spark, d):
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    p = _folds(spark, d).select("fold", s.alias("label"), F.when(k % 3 == 0, "BUILDING").when(k % 7 == 0, "OTHER").otherwise(s).alias("predicted"))
    return st.class_scores(p, ["fold"])


@query(f"WITH {SCORES} SELECT fold, round(balanced_accuracy, 6) AS balanced_accuracy, round(macro_f1, 6) AS macro_f1 FROM s")
def balanced_accuracy(spark, d):
    return _scores(spark, d).select("fold", F.round("balanced_accuracy", 6).alias("balanced_accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query(f"WITH {SCORES} SELECT 'x' AS block, round(avg(balanced_accuracy), 4) AS mean, round(stddev_pop(balanced_accuracy), 4) AS std, count(*) AS n_folds FROM s")
def fold_summary(spark, d):
    s = _scores(spark, d).withColumn("block", F.lit("x"))
    return st.fold_summary(s, ["block"], "balanced_accuracy")


PAIRED = """sc AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'b' END AS block, o_orderkey % 10 AS repeat, o_orderkey // 10 % 5 AS fold, avg(o_totalprice) / 5e5 AS score FROM orders GROUP BY 1, 2, 3),
    df AS (SELECT x.repeat, x.fold, y.score - x.score AS diff FROM sc x JOIN sc y ON x.repeat = y.repeat AND x.fold = y.fold AND x.block = 'a' AND y.block = 'b')"""


def _diffs(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    block = F.when(F.col("o_orderstatus") == "F", "a").otherwise("b")
    s = o.groupBy(block.alias("block"), (k % 10).alias("repeat"), F.expr("o_orderkey div 10 % 5").alias("fold")).agg((F.avg("o_totalprice") / 500000.0).alias("score"))
    return st.paired_differences(s, "a", "b")


@query(f"WITH {PAIRED} SELECT repeat, fold, round(diff, 6) + 0e0 AS diff FROM df")
def paired_diff(spark, d):
    return _diffs(spark, d).select("repeat", "fold", digits(F.col("diff"), 6).alias("diff"))


@query(f"""WITH {PAIRED}, r AS (SELECT diff, rank() OVER (ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY abs(diff)) - 1) / 2e0 AS r FROM df WHERE diff <> 0), w AS (SELECT count(*) AS n, sum(r) FILTER (diff > 0) AS p, sum(r) FILTER (diff < 0) AS m, sum(r * r) AS q FROM r)
    SELECT n, p AS w_plus, m AS w_minus, least(p, m) AS statistic, round((least(p, m) - (p + m) / 2) / sqrt(q / 4), 5) AS z FROM w""")
def wilcoxon_stat(spark, d):
    return st.wilcoxon_statistic(_diffs(spark, d)).select("n", "w_plus", "w_minus", "statistic", F.round("z", 5).alias("z"))


@query(f"""WITH RECURSIVE {PAIRED}, r AS (SELECT 2 * rank() OVER (ORDER BY abs(diff)) + count(*) OVER (PARTITION BY abs(diff)) - 1 AS d, diff FROM df WHERE diff <> 0), k AS (SELECT d, row_number() OVER (ORDER BY d, diff) AS k FROM r),
    c(k, s, n) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), 1e0 UNION ALL SELECT k, s, sum(n) FROM (SELECT k.k, c.s + CASE WHEN u.u = 1 THEN k.d ELSE 0 END AS s, c.n FROM c JOIN k ON k.k = c.k + 1 CROSS JOIN (SELECT unnest(range(2)) AS u) u) GROUP BY k, s),
    w AS (SELECT count(*) AS n, least(sum(d) FILTER (diff > 0), sum(d) FILTER (diff < 0)) AS w FROM r)
    SELECT any_value(w.n) AS n, any_value(w.w) / 2e0 AS statistic, round(least(1e0, 2 * sum(c.n) / power(2e0, any_value(w.n))), 9) AS p, true AS exact FROM c JOIN w ON c.k = w.n AND c.s <= w.w""")
def wilcoxon_p(spark, d):
    """Exact two-sided p of the paired scores' signed ranks."""
    return st.wilcoxon_test(_diffs(spark, d)).select("n", "statistic", F.round("p", 9).alias("p"), "exact")


SEGMENTS = """sg AS (SELECT c_nationkey, (c_custkey // 2) AS pair, c_custkey % 2 AS side, CAST(floor(c_acctbal / 5e2) AS DOUBLE) AS v FROM customer), pd AS (SELECT x.c_nationkey, y.v - x.v AS diff FROM sg x JOIN sg y ON x.pair = y.pair AND x.side = 0 AND y.side = 1)"""


@query(f"""WITH {SEGMENTS}, r AS (SELECT c_nationkey, diff, rank() OVER (PARTITION BY c_nationkey ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY c_nationkey, abs(diff)) - 1) / 2e0 AS r FROM pd WHERE diff <> 0),
    w AS (SELECT c_nationkey, count(*) AS n, coalesce(sum(r) FILTER (diff > 0), 0) AS p, coalesce(sum(r) FILTER (diff < 0), 0) AS m, sum(r * r) AS q FROM r GROUP BY 1)
    SELECT c_nationkey, n, p AS w_plus, m AS w_minus, least(p, m) AS statistic, round((least(p, m) - (p + m) / 2) / sqrt(q / 4), 5) + 0e0 AS z FROM w""")
def wilcoxon_by_nation(spark, d):
    """Signed ranks of neighbouring customers' balances, rounded so that many tie, by the first one's nation."""
    c = table(spark, d, "customer").select("c_nationkey", F.expr("c_custkey div 2").alias("pair"), (F.col("c_custkey") % 2).alias("side"), F.floor(F.col("c_acctbal") / 500.0).cast("double").alias("v"))
    x, y = c.where("side = 0").drop("side"), c.where("side = 1").select("pair", F.col("v").alias("w"))
    pairs = x.join(y, "pair").select("c_nationkey", (F.col("w") - F.col("v")).alias("diff"))
    return st.wilcoxon_statistic(pairs, ["c_nationkey"]).withColumn("z", digits(F.col("z")))


@query(f"WITH {PAIRED} SELECT count(*) AS n, round(avg(diff), 6) AS mean_diff, round(avg(diff) * sqrt(count(*)) / stddev_samp(diff), 4) AS t FROM df")
def paired_t(spark, d):
    return st.paired_t(_diffs(spark, d)).select("n", F.round("mean_diff", 6).alias("mean_diff"), F.round("t", 4).alias("t"))


@query("""WITH s AS (SELECT c_acctbal AS v, c_nationkey < 10 AS g FROM customer), a AS (SELECT count(v) FILTER (g) AS n1, avg(v) FILTER (g) AS m1, var_samp(v) FILTER (g) AS v1, count(v) FILTER (NOT g) AS n0, avg(v) FILTER (NOT g) AS m0, var_samp(v) FILTER (NOT g) AS v0 FROM s)
    SELECT round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 5) + 0e0 AS t, round(power(v1 / n1 + v0 / n0, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v0 / n0, 2) / (n0 - 1)), 3) AS df FROM a""")
def welch_t(spark, d):
    c = table(spark, d, "customer").select("c_acctbal", (F.col("c_nationkey") < 10).alias("g"))
    return st.welch_t(c, "c_acctbal", "g").select(digits(F.col("t")).alias("t"), F.round("df", 3).alias("df"))


@query("""WITH s AS (SELECT c_acctbal AS v, count(*) FILTER (c_nationkey < 10) AS x, count(*) FILTER (c_nationkey >= 10) AS y FROM customer GROUP BY 1), c AS (SELECT abs(sum(x) OVER (ORDER BY v) / CAST(sum(x) OVER () AS DOUBLE) - sum(y) OVER (ORDER BY v) / CAST(sum(y) OVER () AS DOUBLE)) AS g FROM s)
    SELECT round(max(g), 6) AS ks FROM c""")
def ks_statistic(spark, d):
    c = table(spark, d, "customer").select("c_acctbal", (F.col("c_nationkey") < 10).alias("g"))
    return st.ks_statistic(c, "c_acctbal", "g").select(F.round("ks", 6).alias("ks"))


@query(f"""WITH {PAIRED}, n AS (SELECT diff, row_number() OVER (ORDER BY repeat * 5 + fold) - 1 AS i FROM df), m AS (SELECT r, avg(n.diff) AS mean FROM (SELECT unnest(range(10000)) AS r) CROSS JOIN (SELECT unnest(range(50)) AS k)
    JOIN n ON n.i = CAST('0x' || substr(md5('21|' || r || '|' || k), 1, 8) AS BIGINT) % 50 GROUP BY r) SELECT round(quantile_cont(mean, 25e-3), 6) AS low, round(quantile_cont(mean, 975e-3), 6) AS high FROM m""")
def bootstrap_ci(spark, d):
    x = _diffs(spark, d).withColumn("key", F.col("repeat") * 5 + F.col("fold"))
    return st.bootstrap_interval(x, 10_000, 0.05, 21, "key").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


#: Margins with intervals, as a comparison of blocks yields them; invented.
MARGINS = [("value_of_lead_lag", 0.021, 0.012, 0.030), ("lead_lag_over_matched_width", 0.018, 0.009, 0.026), ("dimension_alone", -0.003, -0.009, 0.004), ("value_of_duration", 0.069, 0.05, 0.09), ("gap_baseline", 0.01, -0.001, 0.02)]
IDENTITY = [("d2_identity_gap", 0.001, -0.004, 0.006), ("d2_q_over_plain", 0.02, 0.01, 0.03), ("d2_noise_over_plain", -0.002, -0.006, 0.003), ("d4_q_over_plain", 0.015, 0.006, 0.024), ("d4_leadlag_over_plain", 0.02, 0.01, 0.031)]
_VALUES = lambda rows: "m(name, mean, low, high) AS (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for n, a, b, c in rows) + ")"


@query(f"""WITH {_VALUES(MARGINS)}, a AS (SELECT count(*) FILTER (low > 0 OR high < 0) AS reportable, count(*) FILTER (NOT (low > 0 OR high < 0)) AS retracted, bool_or(low > 0) FILTER (name = 'lead_lag_over_matched_width') AS information, max(mean) FILTER (name = 'dimension_alone') AS d FROM m)
    SELECT reportable, retracted, information, round(d / 25e-3, 3) AS fraction, d > 0 AND d / 25e-3 > 5e-1 AS triggered FROM a""")
def margin_verdicts(spark, d):
    return st.verdicts(spark.createDataFrame(MARGINS, "name string, mean double, low double, high double"), 0.025)


@query(f"""WITH {_VALUES(IDENTITY)} SELECT bool_or(low <= 0 AND high >= 0) FILTER (name = 'd2_identity_gap') AS identity_holds, max(low) FILTER (name = 'd2_q_over_plain') > 0 AND max(mean) FILTER (name = 'd2_q_over_plain') > max(mean) FILTER (name = 'd2_noise_over_plain') AS sensitive,
    round(max(mean) FILTER (name = 'd4_q_over_plain') / max(mean) FILTER (name = 'd4_leadlag_over_plain'), 3) AS fraction_recovered, count(*) FILTER (NOT (low > 0 OR high < 0)) AS spanning_zero FROM m""")
def identity_verdicts(spark, d):
    return st.identity_verdicts(spark.createDataFrame(IDENTITY, "name string, mean double, low double, high double"))


VARIANTS = """v AS (SELECT p_type AS mode, p_brand AS variant, round(avg(p_retailprice), 6) AS score FROM part GROUP BY 1, 2)"""


@query(f"WITH {VARIANTS} SELECT mode, arg_min(variant, (-score, variant)) AS variant, max(score) AS score FROM v GROUP BY mode")
def best_variant(spark, d):
    v = table(spark, d, "part").groupBy(F.col("p_type").alias("mode"), F.col("p_brand").alias("variant")).agg(F.round(F.avg("p_retailprice"), 6).alias("score"))
    return st.best_variant(v)


@query("""WITH r AS (SELECT l_returnflag AS mode, l_linenumber AS depth, CASE WHEN l_orderkey % 2 = 0 THEN 'raw_time' ELSE 'unit_time' END AS norm, l_linestatus AS augment, avg(l_discount) AS score FROM lineitem GROUP BY 1, 2, 3, 4)
    SELECT x.mode, x.depth, x.augment, round(x.score - y.score, 4) + 0e0 AS delta FROM r x JOIN r y ON x.mode = y.mode AND x.depth = y.depth AND x.augment = y.augment AND x.norm = 'raw_time' AND y.norm = 'unit_time'""")
def variant_deltas(spark, d):
    norm = F.when(F.col("l_orderkey") % 2 == 0, "raw_time").otherwise("unit_time")
    r = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("mode"), F.col("l_linenumber").alias("depth"), norm.alias("norm"), F.col("l_linestatus").alias("augment")).agg(F.avg("l_discount").alias("score"))
    return st.variant_deltas(r).withColumn("delta", F.col("delta") + 0.0)


def _frame(spark, d):
    f = ft.object_features(observations(spark, d), BANDS)
    labels = labelled(spark, d).groupBy("oid").agg(F.min("label").alias("label"))
    return st.stratified_folds(f.join(labels, "oid"), "label", "oid", 3, 4)


@query()
def noise_block(spark, d):
    f = ft.object_features(observations(spark, d), BANDS).select("oid", "colour", "amp_ratio")
    return st.noise_block(f, ["colour", "amp_ratio"], 3)


@query()
def random_projection(spark, d):
    f = ft.object_features(observations(spark, d), BANDS)
    return st.random_projection(f, [c for c in f.columns if c != "oid"], 6, 3)


COLUMNS = [*[f"{b}_{f}" for b in BANDS for f in ft.FEATURES], "colour", "amp_ratio", "peak_offset"]


@query()
def logreg_cv(spark, d):
    return st.class_scores(ml.cross_validate(_frame(spark, d), COLUMNS, 3, "logistic"), ["fold"])


@query()
def trees_cv(spark, d):
    return st.class_scores(ml.cross_validate(_frame(spark, d), COLUMNS, 3, "boosting"), ["fold"])


# --- p-values -----------------------------------------------------------------------------------------

#: The density of t integrated from 0 to |t| by Simpson's rule.
_T_TAIL = """k AS (SELECT unnest(range(0, 4001)) AS k), p AS (SELECT 1 - 2 * abs(any_value(t)) / 4000 / 3 * sum(CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
    * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * power(1 + power(t * k / 4e3, 2) / df, -(df + 1) / 2)) AS p FROM s CROSS JOIN k)"""


@query(f"WITH {PAIRED}, s AS (SELECT avg(diff) * sqrt(count(*)) / stddev_samp(diff) AS t, CAST(count(*) - 1 AS DOUBLE) AS df FROM df), {_T_TAIL} SELECT round(p, 5) + 0e0 AS p FROM p")
def paired_t_p(spark, d):
    return st.paired_t(_diffs(spark, d)).select(digits(st.t_tail(F.col("t"), (F.col("n") - 1).cast("double"))).alias("p"))


@query(f"""WITH c AS (SELECT c_acctbal AS v, c_nationkey < 10 AS g FROM customer), a AS (SELECT count(v) FILTER (g) AS n1, avg(v) FILTER (g) AS m1, var_samp(v) FILTER (g) AS v1, count(v) FILTER (NOT g) AS n0, avg(v) FILTER (NOT g) AS m0, var_samp(v) FILTER (NOT g) AS v0 FROM c),
    s AS (SELECT (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t, power(v1 / n1 + v0 / n0, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v0 / n0, 2) / (n0 - 1)) AS df FROM a), {_T_TAIL} SELECT round(p, 5) + 0e0 AS p FROM p""")
def welch_p(spark, d):
    c = table(spark, d, "customer").select("c_acctbal", (F.col("c_nationkey") < 10).alias("g"))
    return st.welch_t(c, "c_acctbal", "g").select(digits(st.t_tail(F.col("t"), F.col("df"))).alias("p"))


@query("""WITH s AS (SELECT c_acctbal AS v, count(*) FILTER (c_nationkey < 10) AS x, count(*) FILTER (c_nationkey >= 10) AS y FROM customer GROUP BY 1), c AS (SELECT abs(sum(x) OVER (ORDER BY v) / CAST(sum(x) OVER () AS DOUBLE) - sum(y) OVER (ORDER BY v) / CAST(sum(y) OVER () AS DOUBLE)) AS g FROM s),
    l AS (SELECT (SELECT max(g) FROM c) * sqrt(CAST(sum(x) AS DOUBLE) * sum(y) / (sum(x) + sum(y))) AS z FROM s)
    SELECT round(CASE WHEN z < 2e-1 THEN 1e0 ELSE least(1e0, greatest(0e0, (SELECT sum(CASE WHEN k % 2 = 1 THEN 2e0 ELSE -2e0 END * exp(-2e0 * k * k * z * z)) FROM (SELECT unnest(range(1, 101)) AS k)))) END, 5) + 0e0 AS p FROM l""")
def ks_p(spark, d):
    c = table(spark, d, "customer").select("c_acctbal", (F.col("c_nationkey") < 10).alias("g"))
    return st.ks_statistic(c, "c_acctbal", "g").select(digits(st.ks_tail(F.col("ks"), F.col("n1"), F.col("n0"))).alias("p"))


# --- variants and ablations ---------------------------------------------------------------------------


@query()
def variant_grid(spark, d):
    """Score of each signature variant (depth, time scaling, transform) on identical folds, and the difference to the best summary."""
    return ex.variant_grid(labelled(spark, d), BANDS, depths=(1, 2), folds=3, seed=4)


@query()
def ablation_sweep(spark, d):
    """Scores of representations on observations thinned at random and in blocks."""
    return ex.ablation_sweep(labelled(spark, d), BANDS, fractions=(1.0, 0.5, 0.2), folds=3, seed=4)


SWEEP = "SELECT l_returnflag AS block, l_linenumber AS depth, avg(l_quantity) / 50 AS score FROM lineitem GROUP BY 1, 2"


@query(f"WITH s AS ({SWEEP}) SELECT block, min(depth) FILTER (score > 51e-2) AS first_depth FROM s GROUP BY block")
def first_depth(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("block"), F.col("l_linenumber").alias("depth")).agg((F.avg("l_quantity") / 50.0).alias("score"))
    return st.first_depth(s, ["block"], 0.51)
