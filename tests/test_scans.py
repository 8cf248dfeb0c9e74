"""Scans in two levels: keys that reach over many tasks, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import paths as pt
from orrery.operators import signature as sg
from orrery.operators.runs import affine_scan


@pytest.fixture(scope="module")
def points(spark):
    """A key of 40,000 points among keys of one to some points, a null key too; gaps from none to many times any tau."""
    hot = spark.range(40_000).select(F.lit("hot").alias("k"), (F.col("id") / 100 + F.pmod("id", F.lit(7)) / 700).alias("t"), F.col("id").alias("tie"))
    few = spark.range(300).select(F.concat(F.lit("k"), F.pmod("id", F.lit(40))).alias("k"), F.when(F.col("id") % 5 == 0, 1e6).otherwise(F.col("id") * 3.0).alias("t"), (F.col("id") + 10**6).alias("tie"))
    none = spark.range(9).select(F.lit(None).cast("string").alias("k"), F.col("id").cast("double").alias("t"), (F.col("id") + 2 * 10**6).alias("tie"))
    one = spark.range(1).select(F.lit("alone").alias("k"), F.lit(3.0).alias("t"), F.lit(-1).cast("bigint").alias("tie"))
    every = hot.unionByName(few).unionByName(none).unionByName(one)
    return every.withColumn("mag", F.sin(F.col("tie") * 12.9) + F.pmod("tie", F.lit(11)) / 5).repartition(6).cache()


def by_key(points):
    out = {}
    for r in sorted(points.collect(), key=lambda r: (r.t, r.tie)):
        out.setdefault(r.k, []).append(r)
    return out


@pytest.mark.parametrize("tau", [0.003, 2.0, 1e7])
@pytest.mark.parametrize("parts", [None, 1, 7])
def test_ewma_equals_the_recursion(spark, points, tau, parts):
    got = {(r.k, r.tie): r.ewma for r in pt.ewma(points, tau, ["k"], parts=parts).collect()}
    assert len(got) == points.count()
    for k, rows in by_key(points).items():
        y = last = None
        for r in rows:
            a = math.exp(-(r.t - last) / tau) if last is not None else 0.0
            y = r.mag if y is None else a * y + (1 - a) * r.mag
            last = r.t
            assert math.isclose(got[k, r.tie], y, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("doubled", [False, True])
@pytest.mark.parametrize("parts", [None, 1, 9])
def test_signature_of_a_key_over_many_tasks(spark, points, doubled, parts):
    out = {r.k: r for r in sg.wide_signature(points, ["k"], ["t", "tie"], ["t", "mag"], 3, doubled, parts).collect()}
    every = by_key(points)
    assert out.keys() == every.keys()
    for k, rows in every.items():
        p = np.array([(r.t, r.mag) for r in rows])
        want = np.concatenate(sg.path_levels(sg.lead_lag(p) if doubled else p, 3))
        assert out[k].n_points == len(rows) and np.allclose(out[k].sig, want, rtol=1e-8, atol=1e-6 * max(1.0, np.abs(want).max()))


def test_hot_key_is_many_tasks(spark, points):
    from orrery.operators.runs import in_order

    sizes = in_order(points, ["k"], ["t", "tie"], 9).groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(F.col("k") == "hot").alias("n")).where("n > 0").collect()
    assert len(sizes) >= 6 and max(r.n for r in sizes) < 12_000


def test_affine_scan():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 1000):
        a, b = rng.random(n), rng.normal(size=n)
        scale, shift = affine_scan(a, b)
        y, x = 0.7, 0.7
        for i in range(n):
            y = a[i] * y + b[i]
            assert math.isclose(scale[i] * x + shift[i], y, rel_tol=1e-9, abs_tol=1e-12)


def test_empty(spark, points):
    none = points.where("false")
    assert pt.ewma(none, 1.0, ["k"]).count() == 0 and sg.wide_signature(none, "k", ["t", "tie"], ["t", "mag"], 2).count() == 0
