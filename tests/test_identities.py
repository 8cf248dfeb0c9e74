"""Facts of mathematics that the operators must obey, each with a mutation that the check must catch."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import orbits as ob
from orrery.functions import scalars as sc
from orrery.operators import paths as pt
from orrery.operators import signature as sg
from orrery.operators import streams as st
from orrery.operators import synthetic as sy
from orrery.operators import topology as tp
from orrery.operators.bottleneck import bottleneck
from orrery.operators.relational import thin_blocked, thin_random
from orrery.streaming.signatures import running_signatures, update


def fold(points, depth):
    """Chen's product step by step, written apart from the library."""
    d = points.shape[1]
    total = None
    for step in np.diff(points, axis=0):
        seg, power = [], np.ones(1)
        for k in range(1, depth + 1):
            power = np.multiply.outer(power, step).ravel() / k
            seg.append(power)
        total = seg if total is None else [sum((np.multiply.outer(([np.ones(1)] + total)[i], ([np.ones(1)] + seg)[k - i]).ravel() for i in range(k + 1)), np.zeros(d**k)) for k in range(1, depth + 1)]
    return total


@pytest.mark.parametrize("d,n,depth", [(2, 5, 3), (2, 40, 4), (3, 25, 3), (4, 15, 3)])
def test_levels_equal_stepwise_product(d, n, depth):
    p = np.random.default_rng(d * n).normal(size=(n, d)).cumsum(0)
    for a, b in zip(sg.path_levels(p, depth), fold(p, depth), strict=True):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9)


def test_signature_identities():
    rng = np.random.default_rng(0)
    p = rng.normal(size=(30, 2)).cumsum(0)
    a = sg.path_levels(p, 3)
    finer = np.vstack([p[:1], *[np.vstack([(x + y) / 2, y]) for x, y in itertools.pairwise(p)]])
    assert all(np.allclose(x, y) for x, y in zip(a, sg.path_levels(finer, 3), strict=True))
    assert np.allclose(a[0], p[-1] - p[0]) and np.isclose(a[1][1] + a[1][2], a[0][0] * a[0][1])
    there_and_back = sg.path_levels(np.vstack([p, p[::-1][1:]]), 3)
    assert max(np.abs(x).max() for x in there_and_back) < 1e-9
    assert all(np.allclose(x, y) for x, y in zip(a, sg.chen(sg.path_levels(p[:11], 3), sg.path_levels(p[10:], 3)), strict=True))
    broken = p.copy()
    broken[7] += 0.5
    assert not np.allclose(a[1], sg.path_levels(broken, 3)[1], atol=1e-6)
    assert sg.signature_dim(4, 4) == 340 and all((x == 0).all() for x in sg.path_levels(p[:1], 2))
    for bad in ((p[0], 2), (p, 0)):
        with pytest.raises(ValueError):
            sg.path_levels(*bad)


def test_window_signature_equals_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(o, i, float(x), float(y)) for o in range(5) for i, (x, y) in enumerate(rng.normal(size=(o * 6 + 1, 2)).cumsum(0))]
    df = spark.createDataFrame(rows, "oid bigint, tie bigint, t double, mag double")
    for doubled in (False, True):
        stepped, order = sg.steps(df, ["oid"], ["tie"], ["t", "mag"]), ["tie"]
        width = 2
        if doubled:
            stepped, order = sg.lead_lag_steps(stepped, ["tie"], 2)
            width = 4
        got = {r.oid: r for r in sg.signature(stepped, ["oid"], order, width, 3).collect()}
        wide = {r.oid: r.sig for r in sg.wide_signature(df, "oid", ["tie"], ["t", "mag"], 3, doubled).collect()}
        for o in range(5):
            p = np.array([r[2:] for r in rows if r[0] == o])
            want = np.concatenate(sg.path_levels(sg.lead_lag(p) if doubled else p, 3))
            assert np.allclose([got[o][sg.name(w)] for k in (1, 2, 3) for w in sg.words(width, k)], want, atol=1e-8) and np.allclose(wide[o], want, atol=1e-8)


def orbit_frame(spark, *rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "traj_id bigint, q double, e double, i double, node double, peri double")


def distance(spark, criterion, a, b):
    df = orbit_frame(spark, a, b)
    x, y = df.where("traj_id = 0").alias("x"), df.where("traj_id = 1").alias("y")
    return x.crossJoin(y).select(ob.CRITERIA[criterion](ob.orbit("x"), ob.orbit("y")).alias("d")).first().d


def test_criteria_special_cases(spark):
    base = (0.9, 0.5, 30, 100, 200)
    e = (0.9, 0.7, 30, 100, 200)
    assert math.isclose(distance(spark, "d_sh", base, e), 0.2, abs_tol=1e-9) and math.isclose(distance(spark, "d_h", base, e), 0.2, abs_tol=1e-9)
    assert math.isclose(distance(spark, "d_d", base, e), 0.2 / 1.2, abs_tol=1e-9)
    tilt = ((0.9, 0.6, 10, 100, 0), (0.9, 0.6, 30, 100, 0))
    assert math.isclose(distance(spark, "d_sh", *tilt), 2 * math.sin(math.radians(10)), abs_tol=1e-9) and math.isclose(distance(spark, "d_d", *tilt), 20 / 180, abs_tol=1e-9)
    turn = ((0.9, 0.6, 0, 0, 100), (0.9, 0.6, 0, 0, 130))
    assert math.isclose(distance(spark, "d_sh", *turn), 0.6 * 2 * math.sin(math.radians(15)), abs_tol=1e-9)
    g1, g2, p = (0.140, 0.896, 23.3, 261.3, 324.4), (0.145, 0.890, 23.8, 261.8, 324.9), (0.949, 0.905, 113.1, 139.4, 150.5)
    for c in ob.CRITERIA:
        assert distance(spark, c, g1, g2) < 0.1 < distance(spark, c, g1, p)
        assert math.isclose(distance(spark, c, g1, p), distance(spark, c, p, g1), abs_tol=1e-9) and distance(spark, c, p, p) < 1e-6


def test_earth_crossing_cases(spark):
    cases = {(0.14, 0.90): True, (0.95, 0.92): True, (0.10, 0.05): False, (1.5, 0.30): False, (1.0, 0.50): True, (0.50, 0.99): True, (0.9, 1.1): True}
    df = spark.createDataFrame([(*k, v) for k, v in cases.items()], "q double, e double, want boolean")
    assert df.where(ob.crosses_earth(F.col("q"), F.col("e")) != F.col("want")).count() == 0


def test_merge_known_structures(spark):
    def sizes(sets):
        groups = spark.createDataFrame([(i, float(i), 0.0, 1.0) for i in range(len(sets))], "group bigint, z double, window_start double, window_end double")
        members = spark.createDataFrame([(i, m) for i, s in enumerate(sets) for m in s], "group bigint, traj_id string")
        return sorted(r.n_members for r in st.merge_overlapping(groups, members).collect())

    assert sizes(["ab", "bc", "xy"]) == [2, 3] and sizes(["ab", "bc", "cd"]) == [4] and sizes(["a", "b", "c"]) == [1, 1, 1]


def test_angles(spark):
    df = spark.createDataFrame([(350.0, 10.0), (10.0, 350.0), (0.0, 180.0)], "a double, b double")
    rows = df.select(sc.circular_difference(F.col("a"), F.col("b")).alias("d"), sc.wrap(F.col("a") - 20).alias("w"), sc.in_arc(F.col("a"), F.lit(340.0), F.lit(20.0)).alias("i")).collect()
    assert [r.d for r in rows] == [-20, 20, -180] and [r.w for r in rows] == [330, 350, 340] and all(r.i for r in rows)
    assert df.select(sc.nearest_source(F.lit(200.0), F.lit(1.0)).alias("s")).first().s.source == "antihelion"


def test_persistence():
    ring = np.array([[1, 1, 1, 1], [1, 5, 5, 1], [1, 5, 5, 1], [1, 1, 1, 1]], float)
    assert tp.persistence(ring, 1).tolist() == [[1, 5]] and len(tp.persistence(ring, 0)) == 0
    two = np.array([[0, 9, 1], [9, 9, 9], [9, 9, 9]], float)
    assert tp.persistence(two, 0).tolist() == [[1, 9]]
    assert tp.persistence(np.array([[0, 9], [9, 1]], float), 0).tolist() == []  # corners touch
    assert len(tp.persistence(np.zeros((5, 5)), 0)) == 0


def test_bottleneck_distance():
    a, b = np.array([[0, 4.0], [1, 2]]), np.array([[0, 5.0]])
    assert bottleneck(a, b) == 1.0 and bottleneck(a, a) == 0 and bottleneck(a, np.zeros((0, 2))) == 2.0 and bottleneck([], []) == 0
    rng = np.random.default_rng(2)
    for _ in range(20):
        x, y = (np.sort(rng.integers(0, 9, (n, 2)), axis=1) + [0, 1.0] for n in (3, 3))
        best = math.inf
        for perm in itertools.permutations(range(6)):
            cost = 0.0
            for i, j in enumerate(perm):
                cost = max(cost, np.abs(x[i] - y[j]).max() if i < 3 and j < 3 else (x[i][1] - x[i][0]) / 2 if i < 3 else (y[j][1] - y[j][0]) / 2 if j < 3 else 0)
            best = min(best, cost)
        assert math.isclose(bottleneck(x, y), best)


def test_thinning_keeps_counts(spark):
    obs = spark.createDataFrame([(o, "g", float(i), 1.0, i + 1000 * o) for o in range(3) for i in range(5 + 20 * o)], "oid bigint, band string, t double, mag double, tie bigint")
    for thin in (thin_random, thin_blocked):
        assert {r.oid: r["count"] for r in thin(obs, 0.5, 3).groupBy("oid").count().collect()} == {0: 5, 1: 12, 2: 22}


def test_reflection_pair_is_exact(spark):
    with pytest.raises(ValueError):
        sy.reflection_pair(spark, 10)
    rows = sy.reflection_pair(spark, 16).collect()
    a, b = ({r.tie: r.mag for r in rows if r.label == x} for x in "AB")
    assert all(a[i] == b[16 - i] for i in a)


def test_normalisation_names(spark):
    with pytest.raises(ValueError):
        pt.normalise(spark.createDataFrame([(1, 0.0, 1.0)], "oid int, t double, mag double"), ["oid"], "other")


def test_running_state_equals_batch():
    p = np.random.default_rng(5).normal(size=(40, 2))
    p[:, 0] = np.arange(40)
    state = None
    for part in np.split(p, [1, 3, 20]):
        state, _ = update(state, part, 3)
    assert np.allclose(state[1], np.concatenate(sg.path_levels(p, 3))) and state[2:] == (40, 0)
    assert update(state, p[-2:], 3)[0][3] == 2


def test_streaming_query(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(o, float(i), float(i * o % 7)) for o in (1, 2) for i in range(12)]
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 4 == k], "oid bigint, t double, mag double").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("oid bigint, t double, mag double").option("maxFilesPerTrigger", 10).parquet(src)
    q = running_signatures(stream).writeStream.outputMode("update").format("memory").queryName("sigs").start()
    q.processAllAvailable()
    q.stop()
    for r in spark.sql("select oid, max_by(sig, n_points) sig from sigs group by oid").collect():
        p = np.array([x[1:] for x in rows if x[0] == r.oid])
        assert np.allclose(r.sig, np.concatenate(sg.path_levels(p, 2)))
