"""Exact null quantiles and radii by window, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import streams as st
from orrery.plans.streams import _circle

CRITERIA = ("d_sh", "d_d", "d_h")


def triangle(spark, rows, criterion):
    """All pair distances of each window."""
    x, y = rows.alias("x"), rows.alias("y")
    d = st.CRITERIA[criterion](st.orbit("x"), st.orbit("y"))
    out = {}
    for r in x.join(y, (F.col("x.w") == F.col("y.w")) & (F.col("x.traj_id") < F.col("y.traj_id"))).select("x.w", d.alias("d")).collect():
        out.setdefault(r.w, []).append(r.d)
    return out


@pytest.fixture(scope="module")
def rows(spark, smoke):
    o = _circle(spark, smoke).where("window_start in (0, 10, 120)").withColumnRenamed("window_start", "w")
    # a tight window, whose first guess is far from that of the wide ones, and one too small
    tight = o.where("w = 0").limit(90).withColumns({"w": F.lit(900.0), "q": 0.5 + F.col("q") / 1e4, "e": F.lit(0.5), "i": F.lit(3.0), "node": F.lit(10.0), "peri": F.lit(10.0)})
    bad = o.where("w = 10").limit(3).withColumns({"traj_id": -F.col("traj_id"), "e": F.lit(float("nan"))})
    return o.unionByName(tight).unionByName(bad).unionByName(o.where("w = 120").limit(20).withColumn("w", F.lit(901.0)))


@pytest.mark.parametrize("criterion, rate", [*((c, r) for c in CRITERIA for r in (0.001, 0.03)), ("d_sh", 0.0), ("d_sh", 0.7), ("d_sh", 1.0)])
def test_threshold_is_the_quantile_of_all_pairs(spark, rows, criterion, rate):
    got = {r.w: r.eps for r in st.threshold(rows, rate, criterion, ["w"]).collect()}
    every = triangle(spark, rows.where("not isnan(e)"), criterion)
    assert got.keys() == every.keys() and got[901.0] is None
    for w, d in every.items():
        if w != 901.0:
            assert got[w] == pytest.approx(np.quantile(d, rate), rel=1e-9, abs=1e-12)


def test_a_null_of_repeated_orbits_has_threshold_zero(spark):
    df = spark.range(80).selectExpr("id as traj_id", "1 as w", "0.5D as q", "0.5D as e", "10D as i", "1D as node", "2D as peri")
    assert st.threshold(df, 0.01, "d_sh", ["w"]).first().eps == pytest.approx(0.0, abs=1e-7)
    assert st.threshold(df.where("false"), 0.01, "d_sh", ["w"]).count() == 0


def test_radii_by_window_equal_runs_of_their_own(spark, rows):
    radii = {0.0: 0.2, 10.0: 0.05, 120.0: 0.1}
    some = rows.where("w < 900 and not isnan(e)")
    eps = F.coalesce(*[F.when(F.col("w") == w, F.lit(e)) for w, e in radii.items() if w != 120.0], F.when(F.col("w") == 120.0, F.lit(0.1)))
    both = some.withColumn("eps", eps)
    pairs = {(r.w, r.a, r.b) for r in st.close_pairs(both, "eps", "d_h", ["w"]).collect()}
    noise = {(r.w, r.traj_id, r.core, r.cluster) for r in st.dbscan(both, "eps", 4, "d_h", ["w"]).collect()}
    for w, e in radii.items():
        own = some.where(F.col("w") == w)
        assert {p for p in pairs if p[0] == w} == {(r.w, r.a, r.b) for r in st.close_pairs(own, e, "d_h", ["w"]).collect()}
        assert {p for p in noise if p[0] == w} == {(r.w, r.traj_id, r.core, r.cluster) for r in st.dbscan(own, e, 4, "d_h", ["w"]).collect()}
    assert st.close_pairs(both.withColumn("eps", F.lit(None).cast("double")), "eps", "d_sh", ["w"]).count() == 0


def _copies(spark, smoke, times):
    o = _circle(spark, smoke).where("window_start in (0, 10)").withColumnRenamed("window_start", "w")
    return o.withColumn("traj_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda k: F.col("traj_id") + k * 100_000)))


@pytest.mark.parametrize("criterion", CRITERIA)
def test_copies_of_orbits_count_as_orbits(spark, smoke, criterion):
    """Orbits of equal elements are one in the grid, and still each its own in what comes out."""
    few = _copies(spark, smoke, 3)
    x, y = few.alias("x"), few.alias("y")
    d = st.CRITERIA[criterion](st.orbit("x"), st.orbit("y"))
    every = x.join(y, (F.col("x.w") == F.col("y.w")) & (F.col("x.traj_id") < F.col("y.traj_id"))).select("x.w", F.col("x.traj_id").alias("a"), F.col("y.traj_id").alias("b"), d.alias("d"))
    want = sorted((r.w, r.a, r.b) for r in every.where("d <= 0.06").collect())
    assert sorted((r.w, r.a, r.b) for r in st.close_pairs(few, 0.06, criterion, ["w"]).collect()) == want
    near = {}
    for w, a, b in want:
        near.setdefault((w, a), set()).add((w, b))
        near.setdefault((w, b), set()).add((w, a))
    core = {k for k, v in near.items() if len(v) + 1 >= 7}
    label = {}
    for k in sorted(core):  # the smallest core that isn't reached yet names its cluster
        todo = [] if k in label else [k]
        while todo:
            n = todo.pop()
            if n not in label:
                label[n] = k[1]
                todo += near[n] & core
    got = {(r.w, r.traj_id): (r.core, r.cluster) for r in st.dbscan(few, 0.06, 7, criterion, ["w"]).collect()}
    assert got == {(r.w, r.traj_id): ((k := (r.w, r.traj_id)) in core, label[k] if k in core else min((label[n] for n in near.get(k, set()) & core), default=None)) for r in few.collect()}
    told = {r.w: r.eps for r in st.threshold(few, 0.01, criterion, ["w"]).collect()}
    for w, v in triangle(spark, few, criterion).items():
        assert told[w] == pytest.approx(np.quantile(v, 0.01), rel=1e-9)


def test_many_copies_make_no_pairs_in_clusters(spark):
    # 200,000 equal orbits would be twenty billion pairs
    df = spark.range(200_000).selectExpr("id as traj_id", "1 as w", "0.5D as q", "0.5D as e", "10D as i", "1D as node", "2D as peri")
    assert st.dbscan(df, 0.05, 8, "d_sh", ["w"]).where("core and cluster = 0").count() == 200_000
    assert st.threshold(df, 0.01, "d_sh", ["w"]).first().eps == pytest.approx(0.0, abs=1e-7)


def test_components_of_a_chain(spark):
    chain = spark.range(300).selectExpr("id as a", "id + 1 as b")
    rows = st.connected(chain, spark.range(303).selectExpr("id as node")).collect()
    assert {r.node: r.component for r in rows} == {k: 0 if k <= 300 else k for k in range(303)}
