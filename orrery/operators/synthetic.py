"""Synthetic families with known answers, as distributed frames; their randomness is a hash of object and point."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PEAKS = (0.3, 0.7)
AMPLITUDES = (1.0, 0.5)


def _uniform(*parts) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), 11).cast("double") + 0.5) / 9007199254740992.0


def normal(*parts) -> Column:
    return F.sqrt(-2.0 * F.log(_uniform(*parts, "r"))) * F.cos(2 * math.pi * _uniform(*parts, "a"))


def peak_swap(spark: SparkSession, objects: int, seed: int, least: int = 20, most: int = 60, width: float = 0.07, noise: float = 0.05) -> DataFrame:
    """(oid, label, t, mag, tie): two Gaussian peaks; class B has their heights swapped."""
    o = spark.range(objects).select(F.col("id").alias("oid"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("label"))
    n = least + F.floor(_uniform(seed, F.col("oid"), "n") * (most - least)).cast("int")
    p = o.withColumn("tie", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("t", _uniform(seed, F.col("oid"), F.col("tie"), "t"))
    bump = lambda c: F.exp(-0.5 * F.pow((F.col("t") - c) / width, F.lit(2.0)))
    first = F.when(F.col("label") == "A", AMPLITUDES[0]).otherwise(AMPLITUDES[1])
    shape = first * bump(PEAKS[0]) + (sum(AMPLITUDES) - first) * bump(PEAKS[1])
    return p.select("oid", "label", "t", (shape + noise * normal(seed, F.col("oid"), F.col("tie"), "e")).alias("mag"), F.col("tie").cast("bigint").alias("tie"))


def reflection_pair(spark: SparkSession, steps: int = 64, width: float = 0.15) -> DataFrame:
    """(oid, label, t, mag, tie): raised cosines of compact support on an even grid; class B is A reversed. steps is a power of two."""
    if steps < 1 or steps & (steps - 1):
        raise ValueError("an even grid needs a power of two of steps")
    g = spark.range(steps + 1).select(F.col("id").alias("j"))

    def shape(j: Column) -> Column:
        t = j.cast("double") / steps
        bump = lambda c, a: F.when(F.abs((t - c) / width) < 1.0, a * 0.5 * (1.0 + F.cos(math.pi * ((t - c) / width)))).otherwise(0.0)
        return bump(PEAKS[0], AMPLITUDES[0]) + bump(PEAKS[1], AMPLITUDES[1])

    both = g.select("j", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("label"))
    place = F.when(F.col("label") == "A", F.col("j")).otherwise(steps - F.col("j"))
    return both.select(F.when(F.col("label") == "A", 0).otherwise(1).cast("bigint").alias("oid"), "label", (F.col("j").cast("double") / steps).alias("t"), shape(place).alias("mag"), F.col("j").alias("tie"))


def _peaks(t: Column, swapped: Column, seed: int, oid: Column, width: float) -> Column:
    """Two Gaussian peaks with heights jittered by object, swapped where told."""
    high, low = (a * (1.0 + 0.08 * normal(seed, oid, f"a{i}")) for i, a in enumerate(AMPLITUDES))
    bump = lambda c: F.exp(-((t - c) / width) * ((t - c) / width))
    return F.when(swapped, low).otherwise(high) * bump(PEAKS[0]) + F.when(swapped, high).otherwise(low) * bump(PEAKS[1])


def _objects(spark: SparkSession, objects: int, seed: int, least: int, most: int) -> DataFrame:
    """(oid, label, n, tie): a row for each point; every second object is of class B."""
    o = spark.range(objects).select(F.col("id").alias("oid"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("label"))
    n = (least + F.floor(_uniform(seed, F.col("oid"), "n") * (most - least))).cast("int") if most > least else F.lit(least)
    return o.withColumn("n", n).withColumn("tie", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1)))


def peak_swap_uniform(spark: SparkSession, objects: int, seed: int, points: int = 40, width: float = 0.07, noise: float = 0.05) -> DataFrame:
    """(oid, label, t, mag, tie): swapped peaks on one even grid, where cross variation of time and magnitude vanishes."""
    p = _objects(spark, objects, seed, points, points).withColumn("t", F.col("tie").cast("double") / (points - 1))
    mag = _peaks(F.col("t"), F.col("label") == "B", seed, F.col("oid"), width) + noise * normal(seed, F.col("oid"), F.col("tie"), "e")
    return p.select("oid", "label", "t", mag.alias("mag"), "tie")


def _irregular(spark: SparkSession, objects: int, seed: int) -> DataFrame:
    return _objects(spark, objects, seed, 20, 60).withColumn("t", _uniform(seed, F.col("oid"), F.col("tie"), "t"))


def area_differing(spark: SparkSession, objects: int, seed: int, scale: float = 2.0, width: float = 0.07, noise: float = 0.05) -> DataFrame:
    """(oid, label, t, mag, tie): swapped peaks; class B is higher by a factor too, so the area under it differs."""
    mag = _peaks(F.col("t"), F.col("label") == "B", seed, F.col("oid"), width) + noise * normal(seed, F.col("oid"), F.col("tie"), "e")
    return _irregular(spark, objects, seed).select("oid", "label", "t", (mag * F.when(F.col("label") == "B", scale).otherwise(1.0)).alias("mag"), "tie")


def orientation_loop(spark: SparkSession, objects: int, seed: int, noise: float = 0.02) -> DataFrame:
    """(oid, label, t, mag, tie): loops in a plane of two magnitudes (t is the first), counterclockwise for A, clockwise for B. In order of tie."""
    oid = F.col("oid")
    p = _objects(spark, objects, seed, 20, 60)
    angle = 2 * math.pi * F.col("tie") / F.greatest(F.col("n") - 1, F.lit(1)) * F.when(F.col("label") == "A", 1.0).otherwise(-1.0) + 2 * math.pi * _uniform(seed, oid, "phase")
    radius = 0.8 + 0.4 * _uniform(seed, oid, "radius")
    shake = lambda c: noise * normal(seed, oid, F.col("tie"), c)
    return p.select("oid", "label", (radius * F.cos(angle) + shake("x")).alias("t"), (radius * F.sin(angle) + shake("y")).alias("mag"), "tie")


def rough_interior(spark: SparkSession, objects: int, seed: int, jitter: float = 0.10, width: float = 0.07, noise: float = 0.05) -> DataFrame:
    """(oid, label, t, mag, tie): one profile and order for all; class B has extra noise on all points but the first and last in time."""
    oid = F.col("oid")
    w = Window.partitionBy("oid").orderBy("t", "tie")
    p = _irregular(spark, objects, seed).withColumns({"_a": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy("oid"))})
    inner = (F.col("label") == "B") & (F.col("_a") > 1) & (F.col("_a") < F.col("_n"))
    mag = _peaks(F.col("t"), F.lit(False), seed, oid, width) + noise * normal(seed, oid, F.col("tie"), "e") + F.when(inner, jitter * normal(seed, oid, F.col("tie"), "j")).otherwise(0.0)
    return p.select("oid", "label", "t", mag.alias("mag"), "tie")


FAMILIES = {"peak_swap": peak_swap, "peak_swap_uniform": peak_swap_uniform, "area_differing": area_differing, "orientation_loop": orientation_loop, "rough_interior": rough_interior}


def circle(spark: SparkSession, steps: int = 2000) -> DataFrame:
    """(oid, t, mag, tie): once round the unit circle, counterclockwise for oid 0, clockwise for 1."""
    p = spark.range(steps + 1).select(F.col("id").alias("tie"), F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("oid"))
    angle = 2 * math.pi * F.col("tie") / steps * F.when(F.col("oid") == 0, 1.0).otherwise(-1.0)
    return p.select("oid", F.cos(angle).alias("t"), F.sin(angle).alias("mag"), "tie")


def convergence_verdict(level1: Column, level2: Column, first2: Column) -> Column:
    """What a class difference at levels 1 and 2 says, given level 2's at the coarsest grid."""
    return (
        F.when(level2 < 1e-10, "blind").when((level2 < 1e-3) & (level2 < 0.1 * first2), "residue").when(level1 > 1e-6, "visible_at_level_1").otherwise("order_sensitive")
    )
