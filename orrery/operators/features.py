"""Hand-crafted variability features per object and band. Magnitudes: the smallest is the peak."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, ratio
from .paths import ORDER

FEATURES = (
    "n_obs t_span mean median std mad amplitude beyond1std skew kurtosis stetson_k percent_amplitude flux_mid20 flux_mid50 flux_mid80 "
    "linear_trend max_slope median_abs_slope rise_frac fade_frac peak_mag cadence_median cadence_iqr"
).split()
#: Features that don't depend on the order of observations, and those that a constant added to magnitudes leaves alone.
ORDER_BLIND = "n_obs mean median std mad amplitude beyond1std skew kurtosis stetson_k percent_amplitude flux_mid20 flux_mid50 flux_mid80 peak_mag".split()
OFFSET_DEPENDENT = "mean median peak_mag percent_amplitude".split()
OFFSET_INVARIANT = [f for f in FEATURES if f not in OFFSET_DEPENDENT]


def corrected_skewness(x: Column | str) -> Column:
    """Bias-corrected sample skewness, 0 for fewer than three values."""
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)).otherwise(0.0)


def corrected_kurtosis(x: Column | str) -> Column:
    """Bias-corrected excess kurtosis, 0 for fewer than four values."""
    n = F.count(x).cast("double")
    return F.when(n >= 4, (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)).otherwise(0.0)


def band_features(obs: DataFrame, keys: Sequence[str] = ("oid", "band")) -> DataFrame:
    """One row per key with the 23 features; all are 0 where there are fewer than two observations.

    One exchange: the key's median, mean and spread are window values next to each row, so the second pass over the data
    that the median-based features need is in the same partitions.
    """
    whole, ordered = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(*ORDER)
    m, t = F.col("mag"), F.col("t")
    dt, dm = t - F.lag("t").over(ordered), m - F.lag("mag").over(ordered)
    df = obs.withColumns({
        "_med": F.percentile("mag", F.lit(0.5)).over(whole), "_mean": F.avg("mag").over(whole), "_std": F.stddev_samp("mag").over(whole),
        "_n": F.count("*").over(whole).cast("double"), "_t0": F.min("t").over(whole), "_dt": dt, "_dm": dm,
    })
    gap = F.when(F.col("_dt") > 0, F.col("_dt"))
    slope = F.abs(F.col("_dm") / gap)
    delta = F.sqrt(F.col("_n") / F.when(F.col("_n") > 1, F.col("_n") - 1)) * (m - F.col("_mean")) / F.when(F.col("magerr") > 0, F.col("magerr"))
    df = df.withColumns({"_dev": F.abs(m - F.col("_med")), "_delta": delta, "_slope": slope, "_gap": gap, "_x": t - F.col("_t0")})
    q = F.percentile("mag", F.array(*[F.lit(p) for p in (0.05, 0.95, 0.4, 0.6, 0.25, 0.75, 0.1, 0.9)]))
    peak = F.min(F.struct("mag", "t", "tie"))
    a = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.avg("mag").alias("mean"), F.max("_med").alias("median"), F.stddev_samp("mag").alias("std"),
        F.percentile("_dev", F.lit(0.5)).alias("mad"), q.alias("q"), F.avg((F.abs(m - F.col("_mean")) > F.col("_std")).cast("double")).alias("beyond"),
        corrected_skewness("mag").alias("skew"), corrected_kurtosis("mag").alias("kurtosis"), F.count_if(F.col("magerr") > 0).alias("good"),
        F.avg(F.abs("_delta")).alias("k1"), F.sqrt(F.avg(F.col("_delta") * F.col("_delta"))).alias("k2"), F.max("_dev").alias("maxdev"), F.regr_slope("mag", "_x").alias("trend"),
        F.max("_slope").alias("max_slope"), F.percentile("_slope", F.lit(0.5)).alias("mid_slope"), peak.alias("peak"), F.percentile("_gap", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("gaps"),
    )
    c, q, g = F.col, F.col("q"), F.col("gaps")
    span, amplitude = c("t1") - c("t0"), q[1] - q[0]
    out = {
        "n_obs": c("n").cast("double"), "t_span": span, "mean": c("mean"), "median": c("median"), "std": c("std"), "mad": c("mad"), "amplitude": amplitude,
        "beyond1std": F.when(c("std") > 0, c("beyond")), "skew": c("skew"), "kurtosis": c("kurtosis"), "stetson_k": F.when((c("good") == c("n")) & (c("k2") > 0), c("k1") / F.when(c("k2") > 0, c("k2"))),
        "percent_amplitude": ratio(c("maxdev"), c("median")), "flux_mid20": ratio(q[3] - q[2], amplitude), "flux_mid50": ratio(q[5] - q[4], amplitude), "flux_mid80": ratio(q[7] - q[6], amplitude),
        "linear_trend": F.when(span > 0, c("trend")), "max_slope": c("max_slope"), "median_abs_slope": c("mid_slope"), "rise_frac": ratio(c("peak.t") - c("t0"), span), "fade_frac": ratio(c("t1") - c("peak.t"), span),
        "peak_mag": c("peak.mag"), "cadence_median": g[1], "cadence_iqr": g[2] - g[0],
    }
    return a.select(*keys, *[F.when(F.col("n") < 2, 0.0).otherwise(finite(out[f])).alias(f) for f in FEATURES])


def object_features(obs: DataFrame, bands: Sequence[str], features: Sequence[str] = FEATURES) -> DataFrame:
    """One row per object: each band's features as <band>_<feature> (0 without the band), and cross-band terms of the first two bands only."""
    per = band_features(obs.where(F.col("band").isin(*bands)))
    need = list(dict.fromkeys([*features, "median", "amplitude", "rise_frac", "t_span", "n_obs"]))
    wide = per.groupBy("oid").pivot("band", list(bands)).agg(*[F.first(f).alias(f) for f in need])
    wide = wide.na.fill(0.0)
    a, b = bands[0], bands[1]
    cross = {
        "colour": F.col(f"{a}_median") - F.col(f"{b}_median"),
        "amp_ratio": F.when(F.col(f"{b}_amplitude") > 0, ratio(F.col(f"{a}_amplitude"), F.col(f"{b}_amplitude"))).otherwise(0.0),
        "peak_offset": F.col(f"{a}_rise_frac") - F.col(f"{b}_rise_frac"),
    }
    return wide.select("oid", *[f"{x}_{f}" for x in bands for f in features], *[v.alias(k) for k, v in cross.items()])


def quadratic_variation(obs: DataFrame, bands: Sequence[str]) -> DataFrame:
    """(oid, band, qtt, qmm, qtm): sums of products of successive differences of raw-time paths."""
    from .paths import normalise
    from .signature import steps

    stepped = steps(normalise(obs.where(F.col("band").isin(*bands)), ["oid", "band"], "raw_time"), ["oid", "band"], ORDER, ["ct", "cm"])
    return stepped.groupBy("oid", "band").agg(
        F.sum(F.col("d_0") * F.col("d_0")).alias("qtt"), F.sum(F.col("d_1") * F.col("d_1")).alias("qmm"), F.sum(F.col("d_0") * F.col("d_1")).alias("qtm")
    )
