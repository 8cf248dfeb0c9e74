"""Folds, scores, paired comparisons and verdict rules."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .relational import hash_order, hash_ranks


def stratified_folds(df: DataFrame, label: str, key: str, folds: int, seed: int) -> DataFrame:
    """Adds fold: within each class rows are dealt in hash order, so fold sizes of a class differ by one at most."""
    ranked = hash_ranks(df, hash_order(seed, key), [label], "_place", [key])
    return ranked.withColumn("fold", (F.col("_place") % folds).cast("bigint")).drop("_place")


def repeated_folds(df: DataFrame, label: str, key: str, folds: int, repeats: int, seed: int) -> DataFrame:
    """A row for each repeat, each with folds of its own."""
    many = df.withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(repeats - 1).cast("bigint"))))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("repeat").cast("string"), F.col(key).cast("string")))
    ranked = hash_ranks(many, order, ["repeat", label], "_place", [key])
    return ranked.withColumn("fold", (F.col("_place") % folds).cast("bigint")).drop("_place")


def class_scores(predictions: DataFrame, by: Sequence[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(by, balanced_accuracy, macro_f1): balanced accuracy is the mean recall of classes present in label."""
    keys = list(by)
    cells = predictions.groupBy(*keys, label, predicted).agg(F.count("*").alias("n"))
    truth = cells.groupBy(*keys, F.col(label).alias("c")).agg(F.sum("n").alias("n_true"), F.sum(F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    guess = cells.groupBy(*keys, F.col(predicted).alias("c")).agg(F.sum("n").alias("n_pred"))
    both = truth.join(guess, [*keys, "c"], "full").na.fill(0, ["n_true", "n_pred", "hit"])
    recall = F.when(F.col("n_true") > 0, F.col("hit") / F.col("n_true"))
    return both.groupBy(*keys).agg(F.avg(recall).alias("balanced_accuracy"), F.avg(2.0 * F.col("hit") / (F.col("n_true") + F.col("n_pred"))).alias("macro_f1"))


def fold_summary(scores: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """(by, mean, std, n_folds): population deviation over folds, rounded to 4 places."""
    return scores.groupBy(*by).agg(F.round(F.avg(score), 4).alias("mean"), F.round(F.stddev_pop(score), 4).alias("std"), F.count("*").alias("n_folds"))


def paired_differences(scores: DataFrame, a: str, b: str, keys: Sequence[str] = ("repeat", "fold")) -> DataFrame:
    """(keys, diff): block b's score less block a's on the same folds. scores: block, keys, score."""
    x = scores.where(F.col("block") == a).select(*keys, F.col("score").alias("_a"))
    y = scores.where(F.col("block") == b).select(*keys, F.col("score").alias("_b"))
    return x.join(y, list(keys)).select(*keys, (F.col("_b") - F.col("_a")).alias("diff"))


def tied_ranks(diffs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, size, n, n_plus, rank) of each size of the nonzero differences: how many have it, how many of them are positive, their mean rank.

    Sizes are sorted by range over all tasks; counts within a task meet those of the tasks before it. Null and NaN differences are left out.
    """
    keys, size = list(by), F.abs("diff")
    sizes = diffs.where((F.col("diff") != 0) & ~F.isnan("diff")).groupBy(*keys, size.alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col("diff") > 0).alias("n_plus"))
    ranged = stage(sizes.repartitionByRange(*keys, "size").withColumn("_task", F.spark_partition_id()), "ranks")
    parts = ranged.groupBy(*keys, "_task").agg(F.sum("n").alias("_t"))  # a row for each key and task that holds it
    parts = parts.select(*keys, "_task", (F.sum("_t").over(Window.partitionBy(*keys).orderBy("_task")) - F.col("_t")).alias("_base"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "_task").orderBy("size"))
    ranked = ranged.withColumn("_upto", upto).join(parts, [*keys, "_task"])
    return ranked.select(*keys, "size", "n", "n_plus", (F.col("_base") + F.col("_upto") - (F.col("n") - 1) / 2.0).alias("rank"))


def wilcoxon_statistic(diffs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, w_plus, w_minus, statistic, z): zeros dropped; z is the normal approximation without continuity correction."""
    return _signed_ranks(tied_ranks(diffs, by), by)


def _signed_ranks(ranked: DataFrame, by: Sequence[str]) -> DataFrame:
    r, n, plus = F.col("rank"), F.col("n"), F.col("n_plus")
    a = ranked.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(r * plus).alias("w_plus"), F.sum(r * (n - plus)).alias("w_minus"), F.sum(n * r * r).alias("sq"))
    a = a.where("n > 0")
    w = F.least("w_plus", "w_minus")
    # the variance of the signed-rank sum under ties is the sum of squared ranks / 4
    z = (w - (F.col("w_plus") + F.col("w_minus")) / 2.0) / F.sqrt(F.col("sq") / 4.0)
    return a.select(*by, "n", "w_plus", "w_minus", w.alias("statistic"), z.alias("z"))


#: Up to this many differences sign patterns are counted, in doubles that hold the counts exactly; beyond it p is the normal tail's.
EXACT_SIGNS = 50


def wilcoxon_test(diffs: DataFrame, by: Sequence[str] = (), most: int = EXACT_SIGNS) -> DataFrame:
    """(by, n, statistic, z, p, exact): two-sided p of the signed-rank sum, exact in groups of most nonzero differences or fewer.

    Exact p counts the sign patterns of each rank sum, over doubled ranks so that ties count right. Groups without nonzero differences are left out.
    """
    if not 0 < most <= EXACT_SIGNS:
        raise ValueError(f"most must be from 1 to {EXACT_SIGNS}")
    keys = list(by)
    ranked = stage(tied_ranks(diffs, keys), "tied")
    told = _signed_ranks(ranked, keys)
    small = told.where(F.col("n") <= most).select(*keys, F.lit(True).alias("exact"))
    # a group's ranks are collected only where there are few of them
    few = _with_keys(ranked, small, keys).groupBy(*keys).agg(F.collect_list(F.array_repeat((2 * F.col("rank")).cast("int"), F.col("n").cast("int"))).alias("_r"))
    out = _with_keys(told, few.withColumn("_r", F.flatten("_r")), keys, "left")
    total = (2 * (F.col("w_plus") + F.col("w_minus"))).cast("int")
    start = F.transform(F.sequence(F.lit(0), total), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    counts = F.aggregate("_r", start, lambda acc, r: F.transform(acc, lambda v, s: v + F.when(s >= r, F.get(acc, s - r)).otherwise(0.0)))
    below = F.aggregate(F.slice(counts, 1, (2 * F.col("statistic")).cast("int") + 1), F.lit(0.0), lambda acc, v: acc + v)
    p = F.when(F.col("_r").isNotNull(), F.least(F.lit(1.0), 2.0 * below / F.pow(F.lit(2.0), F.col("n")))).otherwise(normal_tail(F.col("z")))
    return out.select(*keys, "n", "statistic", "z", p.alias("p"), F.col("_r").isNotNull().alias("exact"))


def _with_keys(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys; without keys, other is a row at most."""
    if keys:
        return df.join(other, list(keys), how)
    return df.withColumn("_one", F.lit(1)).join(other.withColumn("_one", F.lit(1)), "_one", how).drop("_one")


def paired_t(diffs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean_diff, t): Student's t of the mean difference."""
    a = diffs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("diff").alias("mean_diff"), F.stddev_samp("diff").alias("_s"))
    return a.select(*by, "n", "mean_diff", F.when(F.col("_s") > 0, F.col("mean_diff") * F.sqrt("n") / F.when(F.col("_s") > 0, F.col("_s"))).alias("t"))


def welch_t(df: DataFrame, value: str, side: str) -> DataFrame:
    """One row: t and degrees of freedom of Welch's test between the rows where side is true and where it is false."""
    m = lambda f, s: f(F.when(F.col(side) == s, F.col(value)))
    a = df.agg(*[m(f, s).alias(f"{n}{int(s)}") for s in (True, False) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    x, y = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    return a.select(((F.col("m1") - F.col("m0")) / F.sqrt(x + y)).alias("t"), ((x + y) * (x + y) / (x * x / (F.col("n1") - 1) + y * y / (F.col("n0") - 1))).alias("df"))


def ks_statistic(df: DataFrame, value: str, side: str) -> DataFrame:
    """One row (ks, n1, n0): the largest gap between the two sides' distribution functions, and the sides' sizes.

    Counts by distinct value are sorted by range; running sums within a task meet the totals of the tasks before it.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(side)).alias("x"), F.count_if(~F.col(side)).alias("y"))
    ranged = stage(counts.repartitionByRange(value).withColumn("task", F.spark_partition_id()), "ks")
    whole = Window.orderBy("task")  # a row for each task of the sort
    tasks = ranged.groupBy("task").agg(F.sum("x").alias("tx"), F.sum("y").alias("ty"))
    tasks = tasks.select("task", *[(F.sum(t).over(whole) - F.col(t)).alias(f"b{t}") for t in ("tx", "ty")], *[F.sum(t).over(Window.partitionBy()).alias(f"n{t}") for t in ("tx", "ty")])
    w = Window.partitionBy("task").orderBy(value)
    both = ranged.withColumns({"cx": F.sum("x").over(w), "cy": F.sum("y").over(w)}).join(F.broadcast(tasks), "task")
    gap = F.abs((F.col("btx") + F.col("cx")) / F.col("ntx") - (F.col("bty") + F.col("cy")) / F.col("nty"))
    return both.agg(F.max(gap).alias("ks"), F.max("ntx").alias("n1"), F.max("nty").alias("n0"))


# --- tail probabilities, as columns -------------------------------------------------------------------


def incomplete_beta(a: Column, b: Column, x: Column, terms: int = 200) -> Column:
    """The regularised incomplete beta function, by the continued fraction (Lentz) on the side where it converges fast."""
    tiny = 1e-300
    guard = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)
    flip = x > (a + 1.0) / (a + b + 2.0)
    p, q, z = F.when(flip, b).otherwise(a), F.when(flip, a).otherwise(b), F.when(flip, 1.0 - x).otherwise(x)
    start = F.struct(p.alias("p"), q.alias("q"), z.alias("z"), F.lit(1.0).alias("c"), (1.0 / guard(1.0 - (p + q) * z / (p + 1.0))).alias("d"))
    state = lambda s, c, d, h: F.struct(s["p"].alias("p"), s["q"].alias("q"), s["z"].alias("z"), c.alias("c"), d.alias("d"), h.alias("h"))
    first = F.struct(*[start[n].alias(n) for n in "pqzcd"], start["d"].alias("h"))

    def half(s, coefficient):
        c, d = guard(1.0 + coefficient / s["c"]), 1.0 / guard(1.0 + coefficient * s["d"])
        return state(s, c, d, s["h"] * c * d)

    def step(s, m):
        even = half(s, m * (s["q"] - m) * s["z"] / ((s["p"] + 2.0 * m - 1.0) * (s["p"] + 2.0 * m)))
        # bound in a one-element array, or each term would hold the one before it several times
        return F.element_at(F.transform(F.array(even), lambda e: half(e, -(e["p"] + m) * (e["p"] + e["q"] + m) * e["z"] / ((e["p"] + 2.0 * m) * (e["p"] + 2.0 * m + 1.0)))), 1)

    fraction = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda k: k.cast("double")), first, step, lambda s: s["h"])
    front = F.exp(p * F.ln(z) + q * F.ln(1.0 - z) - log_beta(p, q)) / p
    part = F.when(z <= 0.0, 0.0).otherwise(front * fraction)
    return F.when(flip, 1.0 - part).otherwise(part)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for positive x: Stirling's series after a shift by 10."""
    shift = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.ln(x + k)), F.lit(0.0), lambda s, v: s + v)
    y = x + 10.0
    series = 1.0 / (12.0 * y) - 1.0 / (360.0 * y * y * y) + 1.0 / (1260.0 * F.pow(y, F.lit(5.0))) - 1.0 / (1680.0 * F.pow(y, F.lit(7.0)))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2.0 * math.pi) + series - shift


def log_beta(a: Column, b: Column) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with df degrees of freedom."""
    return incomplete_beta(df / 2.0, F.lit(0.5), df / (df + t * t))


def normal_tail(z: Column) -> Column:
    """Two-sided p of a standard normal: that of t with very many degrees of freedom."""
    return t_tail(z, F.lit(1e9))


def ks_tail(ks: Column, n1: Column, n0: Column, terms: int = 100) -> Column:
    """Two-sided p of the two-sample statistic by Kolmogorov's limit law."""
    x = ks * F.sqrt(n1 * n0 / (n1 + n0))
    series = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x)), F.lit(0.0), lambda s, v: s + v)
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def bootstrap_means(diffs: DataFrame, resamples: int, seed: int, key: str = "fold") -> DataFrame:
    """(resample, mean): means of resamples with replacement, picks by hash. For score vectors of bounded size."""
    n = diffs.count()
    numbered = diffs.withColumn("_i", F.row_number().over(Window.orderBy(key)) - 1).select("_i", "diff")
    draws = diffs.sparkSession.range(resamples).select(F.col("id").alias("resample"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    pick = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("resample").cast("string"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")
    return draws.withColumn("_i", pick).join(F.broadcast(numbered), "_i").groupBy("resample").agg(F.avg("diff").alias("mean"))


def bootstrap_interval(diffs: DataFrame, resamples: int = 10_000, alpha: float = 0.05, seed: int = 0, key: str = "fold") -> DataFrame:
    """One row (low, high): percentiles of the resampled means."""
    means = bootstrap_means(diffs, resamples, seed, key)
    return means.agg(F.percentile("mean", F.lit(alpha / 2)).alias("low"), F.percentile("mean", F.lit(1 - alpha / 2)).alias("high"))


def excludes_zero(low: Column, high: Column) -> Column:
    return (low > 0) | (high < 0)


def verdicts(margins: DataFrame, published: float) -> DataFrame:
    """One row of rules over margins (name, mean, low, high).

    reportable: margins whose interval excludes 0. information: lead-lag beats noise of equal width. fraction: what width alone
    recovers of the published margin; triggered where it helps and recovers more than half.
    """
    at = lambda n, c: F.max(F.when(F.col("name") == n, F.col(c)))
    clear = excludes_zero(F.col("low"), F.col("high"))
    a = margins.agg(F.count_if(clear).alias("reportable"), F.count_if(~clear).alias("retracted"), (at("lead_lag_over_matched_width", "low") > 0).alias("information"), at("dimension_alone", "mean").alias("d"))
    part = F.col("d") / F.lit(published)
    return a.select("reportable", "retracted", "information", F.round(part, 3).alias("fraction"), ((F.col("d") > 0) & (part > 0.5)).alias("triggered"))


def identity_verdicts(margins: DataFrame) -> DataFrame:
    """One row: do intervals span 0 where the depth-2 identity says so, is the arm sensitive, what share is recovered at depth 4."""
    at = lambda n, c: F.max(F.when(F.col("name") == n, F.col(c)))
    gap = "d2_identity_gap"
    a = margins.agg(
        ((at(gap, "low") <= 0) & (at(gap, "high") >= 0)).alias("identity_holds"), ((at("d2_q_over_plain", "low") > 0) & (at("d2_q_over_plain", "mean") > at("d2_noise_over_plain", "mean"))).alias("sensitive"),
        at("d4_q_over_plain", "mean").alias("q"), at("d4_leadlag_over_plain", "mean").alias("l"), F.count_if(~excludes_zero(F.col("low"), F.col("high"))).alias("spanning_zero"),
    )
    return a.select("identity_holds", "sensitive", F.round(F.when(F.col("l") != 0, F.col("q") / F.when(F.col("l") != 0, F.col("l"))), 3).alias("fraction_recovered"), "spanning_zero")


def first_depth(scores: DataFrame, by: Sequence[str], above: float = 0.75) -> DataFrame:
    """(by, first_depth): the least depth whose score exceeds a bar, null if none does."""
    return scores.groupBy(*by).agg(F.min(F.when(F.col("score") > above, F.col("depth"))).alias("first_depth"))


def best_variant(results: DataFrame) -> DataFrame:
    """(mode, variant, score): the best of each mode; ties by name. results: mode, variant, score."""
    return results.groupBy("mode").agg(F.min(F.struct((-F.col("score")).alias("s"), "variant")).alias("b")).select("mode", F.col("b.variant").alias("variant"), (-F.col("b.s")).alias("score"))


def variant_deltas(results: DataFrame) -> DataFrame:
    """(mode, depth, augment, delta): score with durations kept less score with time scaled, for pairs present. results: mode, depth, norm, augment, score."""
    keys = ["mode", "depth", "augment"]
    raw = results.where("norm = 'raw_time'").select(*keys, F.col("score").alias("a"))
    unit = results.where("norm = 'unit_time'").select(*keys, F.col("score").alias("b"))
    return raw.join(unit, keys).select(*keys, F.round(F.col("a") - F.col("b"), 4).alias("delta"))


def noise_block(df: DataFrame, columns: Sequence[str], seed: int, prefix: str = "noise_") -> DataFrame:
    """Adds a column of Gaussian noise of each column's mean and spread, a function of key and seed."""
    stats = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)])
    u = lambda i, p: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "oid", F.lit(i), F.lit(p)), 11).cast("double") + 0.5) / 9007199254740992.0
    normal = lambda i: F.sqrt(-2.0 * F.log(u(i, 0))) * F.cos(2 * math.pi * u(i, 1))
    out = df.crossJoin(F.broadcast(stats))
    return out.select(*df.columns, *[(F.col(f"m{i}") + F.col(f"s{i}") * normal(i)).alias(f"{prefix}{c}") for i, c in enumerate(columns)])


def random_projection(df: DataFrame, columns: Sequence[str], width: int, seed: int) -> DataFrame:
    """(oid, p_0 ...): the columns times a fixed Gaussian matrix of entries of variance 1 / width."""
    import numpy as np

    matrix = np.random.default_rng(seed).normal(size=(len(columns), width)) / math.sqrt(width)
    return df.select("oid", *[sum((F.col(c) * float(matrix[i, j]) for i, c in enumerate(columns)), F.lit(0.0)).alias(f"p_{j}") for j in range(width)])
