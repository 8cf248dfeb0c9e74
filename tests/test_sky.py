"""Catalogue matches by cells of the sky against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.functions.scalars import separation
from orrery.operators import streams as st

RADIANTS = "traj_id bigint, ra double, dec double, vg double, sol_lon double"
ENTRIES = "code string, list string, ra double, dec double, vg double, lo_s_max double"


def places(r, n):
    """Places all over the sky, many at the poles and at right ascension 0."""
    out = [(0.0, 90.0), (0.0, -90.0), (359.999, 0.0), (0.0, 0.0), (180.0, 89.9), (360.0, 10.0), (8.0, 8.0), (16.0, -8.0)]
    while len(out) < n:
        kind = r.random()
        dec = r.uniform(-90, 90) if kind < 0.5 else r.choice((1, -1)) * r.uniform(78, 90) if kind < 0.8 else r.uniform(-3, 3)
        out.append((r.uniform(0, 360) if r.random() < 0.7 else r.uniform(-2, 2) % 360, dec))
    return out[:n]


@pytest.mark.parametrize("far", [8.0, 0.7, 50.0])
def test_matches_equal_all_pairs(spark, far):
    r = random.Random(7)
    radiants = [(i, *p, 30.0, 10.0) for i, p in enumerate(places(r, 400))] + [(1000, None, 1.0, 30.0, 10.0), (1001, 1.0, None, 30.0, 10.0)]
    entries = [(f"C{i:03}", r.choice(("a", "b")), *p, 30.0 + i % 3, None) for i, p in enumerate(places(r, 150))] + [("N", "a", 1.0, 1.0, None, None), ("M", "a", None, 1.0, 30.0, None)]
    x, y = spark.createDataFrame(radiants, RADIANTS), spark.createDataFrame(entries, ENTRIES)
    e = y.where("vg is not null").select("code", "list", *[F.col(c).alias(f"c{c}") for c in ("ra", "dec")])
    every = x.crossJoin(e).withColumn("sep", separation(F.col("ra"), F.col("dec"), F.col("cra"), F.col("cdec"))).where(F.col("sep") <= far)
    want = {}
    for m in every.collect():
        key = m.traj_id, m.list
        want[key] = min(want.get(key, (999.0, "")), (m.sep, m.code))
    got = {(m.traj_id, m.list): (m.sep, m.code) for m in st.match_catalogue(x, y, far).collect()}
    assert got == want and len(want) > 20


def test_no_broadcast_is_forced(spark):
    x = spark.createDataFrame([(1, 1.0, 1.0, 30.0, 10.0)], RADIANTS)
    y = spark.createDataFrame([("A", "a", 1.5, 1.0, 30.0, 12.0)], ENTRIES)
    plan = st.match_catalogue(x, y)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower() and "_cell" in plan
