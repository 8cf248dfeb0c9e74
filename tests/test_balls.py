"""Rows in balls by cells against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from orrery.functions.orbits import CRITERIA, ELEMENTS, orbit
from orrery.operators import streams as st

ROWS = "k int, traj_id bigint, q double, e double, i double, node double, peri double"
BALLS = "k int, name string, r double, q double, e double, i double, node double, peri double"


def orbits(r, n):
    """Orbits in a few tight streams and all over."""
    out = []
    for j in range(n):
        tight = j % 2
        s = j % 5
        near = lambda mid, wide: r.gauss(mid, wide * 0.05) if tight else r.uniform(mid - wide, mid + wide)  # noqa: B023, E731
        out.append((abs(near(0.3 + 0.1 * s, 0.3)), abs(near(0.5 + 0.08 * s, 0.4)), min(180.0, abs(near(20.0 * s, 30.0))), near(100.0, 90.0) % 360, near(200.0, 90.0) % 360))
    return out


def expected(rows, balls, criterion, radius=None):
    whole = lambda f: f.dropna(subset=list(ELEMENTS)).where(~F.isnan("e"))
    rows, balls = whole(rows), whole(balls)
    c = balls.select("k", "name", "r", *[F.col(x).alias(f"{x}_c") for x in ELEMENTS])
    d = CRITERIA[criterion](orbit(), orbit(suffix="_c"))
    return {tuple(m) for m in rows.join(c, "k").where(d <= (F.col("r") if radius is None else radius)).select("k", "traj_id", "name").collect()}


@pytest.mark.parametrize("criterion", sorted(CRITERIA))
def test_balls_equal_all_pairs(spark, criterion):
    r = random.Random(3)
    rows = [(j % 3, j, *o) for j, o in enumerate(orbits(r, 300))] + [(0, 900, None, 0.5, 1.0, 2.0, 3.0), (1, 901, 0.5, math.nan, 1.0, 2.0, 3.0), (7, 902, 0.5, 0.5, 1.0, 2.0, 3.0)]
    sizes = (0.0, 1e-4, 0.02, 0.0625, 0.1, 0.25, 0.3, 1.0, 1.7, None, -1.0)
    balls = [(j % 3, f"b{j}", sizes[j % len(sizes)], *rows[j * 4][2:]) for j in range(66)] + [(0, "null", 0.5, None, 0.5, 1.0, 2.0, 3.0), (8, "alone", 0.5, 0.5, 0.5, 1.0, 2.0, 3.0)]
    x, y = spark.createDataFrame(rows, ROWS), spark.createDataFrame(balls, BALLS)
    got = st.in_balls(x, y, "r", ["k"], criterion).select("k", "traj_id", "name").collect()
    want = expected(x, y, criterion)
    assert len(got) == len(set(got)) and set(map(tuple, got)) == want and len(want) > 500
    got = st.in_balls(x, y, 0.25, ["k"], criterion).select("k", "traj_id", "name").collect()
    assert set(map(tuple, got)) == expected(x, y, criterion, 0.25)


def test_counts(spark):
    o = (0.5, 0.5, 10.0, 20.0, 30.0)
    x = spark.createDataFrame([(0, 1, *o), (0, 2, 0.9, *o[1:]), (1, 3, *o)], ROWS)
    y = spark.createDataFrame([(0, "a", 0.1, *o), (0, "b", 0.1, 5.0, *o[1:]), (2, "c", 0.1, *o)], BALLS)
    count = lambda f, by: sorted(tuple(c) for c in st.ball_counts(f, y, 0.1, ["name"], by, "n", "total").collect())
    assert count(x, ["k"]) == [("a", 0, 1, 2), ("b", 0, 0, 2)]
    assert count(x, []) == [("a", 2, 3), ("b", 0, 3), ("c", 2, 3)]
    assert count(x.limit(0), []) == [] and count(x.limit(0), ["k"]) == []
    with pytest.raises(ValueError):
        st.in_balls(x, y, "r")


def test_rows_meet_only_near_balls(spark):
    """The plan has no join without keys, and a ball far away is met by no row before the distance is taken."""
    o = (0.5, 0.5, 10.0, 20.0, 30.0)
    x = spark.createDataFrame([(0, j, *o) for j in range(5)], ROWS)
    y = spark.createDataFrame([(0, "a", 0.1, *o)], BALLS)
    plan = st.in_balls(x, y, 0.1, ["k"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
