"""Feature vectors of named path variants, grids of variants and ablation sweeps.

A run of a grid is a loop over a handful of configurations on the driver; every score is distributed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import log_modulus
from ..staging import stage
from . import features as ft
from . import learning as ml
from . import paths as pt
from . import signature as sg
from .relational import thin_blocked, thin_random
from .stats import class_scores, stratified_folds
from .synthetic import FAMILIES, convergence_verdict, reflection_pair

ORDER = list(pt.ORDER)

#: Channel augmentations by name: channels of the path, whether it starts at the origin, whether it is doubled. Fixed values.
AUGMENTATIONS = {
    "A0_mag_only": (("mag",), False, False),
    "A1_time_aug": (("t", "mag"), False, False),
    "A2_basepoint_time": (("t", "mag"), True, False),
    "A3_leadlag_time": (("t", "mag"), False, True),
    "A4_leadlag_basepoint": (("t", "mag"), True, True),
    "A5_leadlag_mag": (("mag",), False, True),
    "A6_delay_tau0.05": (("t", "mag", "delayed"), False, False),
    "A7_cum_integral": (("t", "mag", "integral"), False, False),
    "A8_running_max": (("t", "mag", "running"), False, False),
    "A9_ewma_tau0.05": (("t", "mag", "ewma"), False, False),
}
TAU = 0.05


def augmentation_width(name: str) -> int:
    """Channels of the path of an augmentation."""
    channels, _, doubled = AUGMENTATIONS[name]
    return len(channels) * (2 if doubled else 1)


def augmented(points: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """points (keys, t, tie, mag) with the channel that the augmentation adds."""
    channels = AUGMENTATIONS[name][0]
    if "integral" in channels:
        return pt.cumulative_integral(points, keys)
    if "running" in channels:
        return pt.running_max(points, keys)
    if "ewma" in channels:
        return points.join(pt.ewma(points, TAU, keys), [*keys, "tie"])
    if "delayed" in channels:
        return points.join(pt.delayed(points, TAU, keys).drop("t"), [*keys, "tie"])
    return points


def augmented_signature(points: DataFrame, name: str, keys: Sequence[str], depth: int) -> DataFrame:
    """(keys, n_points, s_...): the signature of the augmented path."""
    channels, base, doubled = AUGMENTATIONS[name]
    stepped = sg.steps(augmented(points, name, keys), list(keys), ORDER, list(channels), base)
    order = ORDER
    if doubled:
        stepped, order = sg.lead_lag_steps(stepped, ORDER, len(channels))
    return sg.signature(stepped, list(keys), order, augmentation_width(name), depth)


MODES = ("per_band", "interleaved", "joint")


def expected_width(depth: int, mode: str, bands: Sequence[str], doubled: bool = False) -> int:
    """Length of the feature vector of a variant."""
    twice = 2 if doubled else 1
    if mode == "per_band":
        return len(bands) * sg.signature_dim(2 * twice, depth)
    if mode == "interleaved":
        return sg.signature_dim(3 * twice, depth)
    if mode == "joint":
        return sg.signature_dim((1 + len(bands)) * twice, depth)
    raise ValueError(f"mode must be one of {MODES}")


def _words(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("s_")]


def feature_vector(obs: DataFrame, bands: Sequence[str], depth: int = 2, mode: str = "per_band", norm: str = "unit_time", doubled: bool = False, base: bool = False) -> DataFrame:
    """(oid, f_0 ... ): the log-modulus of an object's signature words, band after band; 0 for a band of fewer than two points.

    Raises where the vector hasn't the width that the variant must have.
    """
    kept = obs.where(F.col("band").isin(*bands))
    if mode == "per_band":
        keys, channels = ["oid", "band"], ["ct", "cm"]
        path, order = pt.normalise(kept, keys, norm), ORDER
    elif mode == "interleaved":
        keys, channels = ["oid"], ["ct", "cm", "cb"]
        path, order = pt.interleaved(kept, bands), ORDER
    else:
        keys, channels = ["oid"], ["ct", *[f"c_{b}" for b in bands]]
        path, order = pt.joint_ffill(kept, bands), ["t"]
    stepped = sg.steps(path, keys, order, channels, base)
    if doubled:
        stepped, order = sg.lead_lag_steps(stepped, order, len(channels))
    words = sg.signature(stepped, keys, order, len(channels) * (2 if doubled else 1), depth)
    names = _words(words)
    if mode == "per_band":
        # one aggregation puts the bands side by side: each word of the one row of a band
        at = lambda b, w: F.max(F.when(F.col("band") == b, F.col(w)))
        wide = words.groupBy("oid").agg(*[F.coalesce(at(b, w), F.lit(0.0)).alias(f"{b}_{w}") for b in bands for w in names])
        names = [f"{b}_{w}" for b in bands for w in names]
    else:
        wide = words
    if len(names) != expected_width(depth, mode, bands, doubled):
        raise ValueError(f"the variant has {len(names)} words, not {expected_width(depth, mode, bands, doubled)}")
    return wide.select("oid", *[log_modulus(F.col(w)).alias(f"f_{i}") for i, w in enumerate(names)])


def order_blind(features: DataFrame, bands: Sequence[str]) -> DataFrame:
    """The columns of object_features that the order of a light curve's points doesn't change."""
    return features.select("oid", *[f"{b}_{f}" for b in bands for f in ft.FEATURES if f in ORDER_BLIND])


#: Features of magnitudes alone. Fixed values.
ORDER_BLIND = ("n_obs", "mean", "median", "std", "mad", "amplitude", "beyond1std", "skew", "kurtosis", "stetson_k", "percent_amplitude", "flux_mid20", "flux_mid50", "flux_mid80", "peak_mag")


def _columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("oid", "label", "fold")]


def _score(features: DataFrame, labels: DataFrame, folds: int, seed: int, learner: str) -> DataFrame:
    # labels are a row for each object: shuffled, as a broadcast would pass them all through the driver, once for each run
    data = stratified_folds(features.join(labels.hint("merge"), "oid"), "label", "oid", folds, seed)
    scores = class_scores(ml.cross_validate(data, _columns(features), folds, learner, seed), ["fold"])
    return scores.agg(F.avg("balanced_accuracy").alias("score"), F.stddev_pop("balanced_accuracy").alias("spread"), F.count("*").alias("n_folds"))


def _scored(runs: list[tuple[tuple, DataFrame]], labels: DataFrame, folds: int, seed: int, learner: str) -> list[tuple[tuple, DataFrame]]:
    """The runs (name, features) as (name, scores)."""
    scores = ml.side_by_side(lambda run: _score(run[1], labels, folds, seed, learner), runs)
    return [(name, score) for (name, _), score in zip(runs, scores, strict=True)]


def _table(named: list[tuple[tuple, DataFrame]], schema: dict[str, str]) -> DataFrame:
    parts = [df.select(*[F.lit(v).cast(kind).alias(k) for v, (k, kind) in zip(values, schema.items(), strict=True)], "*") for values, df in named]
    return reduce(DataFrame.unionByName, parts)


def variant_grid(obs: DataFrame, bands: Sequence[str], depths: Sequence[int], folds: int, seed: int, learner: str = "logistic", modes: Sequence[str] = ("per_band", "joint"), norms: Sequence[str] = ("unit_time", "raw_time")) -> DataFrame:
    """(mode, norm, augment, depth, width, score, spread, n_folds, over_summary): each variant's mean score on identical folds.

    The variant 'summary' is the hand-made features; over_summary is a variant's score less its. obs: oid, band, t, mag, magerr,
    tie, label.
    """
    obs = stage(obs, "observations")
    labels = stage(obs.groupBy("oid").agg(F.min("label").alias("label")), "labels")
    schema = {"mode": "string", "norm": "string", "augment": "string", "depth": "int", "width": "int"}
    summary = ft.object_features(obs, bands)
    runs = [(("summary", "", "", 0, len(_columns(summary))), summary)]
    for mode in modes:
        for norm in norms if mode == "per_band" else ("unit_time",):
            for doubled in (False, True):
                for depth in depths:
                    vector = feature_vector(obs, bands, depth, mode, norm, doubled)
                    runs.append(((mode, norm, "lead_lag" if doubled else "none", depth, expected_width(depth, mode, bands, doubled)), vector))
    told = _table(_scored(runs, labels, folds, seed, learner), schema)
    base = told.where("mode = 'summary'").select(F.col("score").alias("_base"))
    return told.join(base).select(*schema, "score", "spread", "n_folds", (F.col("score") - F.col("_base")).alias("over_summary"))


def ablation_sweep(obs: DataFrame, bands: Sequence[str], fractions: Sequence[float], folds: int, seed: int, learner: str = "logistic", depth: int = 2) -> DataFrame:
    """(regime, fraction, representation, score, spread, n_folds): observations thinned at random or in blocks, all on the same folds."""
    obs = stage(obs, "observations")
    labels = stage(obs.groupBy("oid").agg(F.min("label").alias("label")), "labels")
    thin = {"random": thin_random, "blocked": thin_blocked}
    schema = {"regime": "string", "fraction": "double", "representation": "string"}
    runs = []
    for regime, cut in thin.items():
        for fraction in fractions:
            left = obs if fraction >= 1.0 else cut(obs, fraction, seed)
            for name, frame in (("summary", ft.object_features(left, bands)), ("signature", feature_vector(left, bands, depth))):
                runs.append(((regime, fraction, name), frame))
    return _table(_scored(runs, labels, folds, seed, learner), schema).select(*schema, "score", "spread", "n_folds")


# --- convergence ----------------------------------------------------------------------------------------


def class_gap(words: DataFrame, level: int) -> Column:
    """Largest difference of two classes' terms of a level over the largest term, as an aggregate over one row a class."""
    names = [w for w in _words(words) if len(w) == 2 + level]
    scale = F.greatest(*[F.max(F.abs(w)) for w in names], F.lit(0.0))
    gap = F.greatest(*[F.max(w) - F.min(w) for w in names], F.lit(0.0))
    return F.when(scale < 1e-14, 0.0).otherwise(gap / scale)


def convergence_table(spark: SparkSession, grids: Sequence[int], names: Sequence[str] = tuple(AUGMENTATIONS)) -> DataFrame:
    """(augmentation, steps, level1, level2, verdict): gaps of the two classes of the exact reflection by grid; the verdict is of the finest.

    A gap that vanishes as the grid is refined is residue of sampling; only one that stays tells the classes apart.
    """
    parts = []
    for name in names:
        for steps in grids:
            words = augmented_signature(reflection_pair(spark, steps), name, ["oid"], 2)
            row = words.agg(class_gap(words, 1).alias("level1"), class_gap(words, 2).alias("level2"))
            parts.append(row.select(F.lit(name).alias("augmentation"), F.lit(steps).cast("bigint").alias("steps"), "level1", "level2"))
    told = reduce(DataFrame.unionByName, parts)
    ends = told.groupBy("augmentation").agg(F.max_by("level1", "steps").alias("_l1"), F.max_by("level2", "steps").alias("_l2"), F.min_by("level2", "steps").alias("_first"))
    verdict = convergence_verdict(F.col("_l1"), F.col("_l2"), F.col("_first"))
    return told.join(ends, "augmentation").select("augmentation", "steps", "level1", "level2", verdict.alias("verdict"))


def family_scores(spark: SparkSession, objects: int, folds: int, seed: int, depth: int = 2, learner: str = "logistic") -> DataFrame:
    """(family, augmentation, score, spread, n_folds): does a path of depth 2 tell the classes of each synthetic family apart?"""
    runs = []
    for family, make in FAMILIES.items():
        points = stage(make(spark, objects, seed), "family")
        if family == "orientation_loop":
            # a plane curve: its order is that of tie, and its first coordinate is no time
            points = points.withColumns({"_x": F.col("t"), "t": F.col("tie").cast("double")})
            stepped = sg.steps(points, ["oid"], ORDER, ["_x", "mag"])
            words = {"A1_time_aug": sg.signature(stepped, ["oid"], ORDER, 2, depth)}
        else:
            words = {name: augmented_signature(points, name, ["oid"], depth) for name in ("A1_time_aug", "A3_leadlag_time")}
        labels = points.groupBy("oid").agg(F.min("label").alias("label"))
        for name, w in words.items():
            runs.append(((family, name), _score(w.select("oid", *_words(w)), labels, folds, seed, learner)))
    return _table(runs, {"family": "string", "augmentation": "string"}).select("family", "augmentation", "score", "spread", "n_folds")
