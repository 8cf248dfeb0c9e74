"""Orbits that recur in many windows meet once; the code that Spark makes of pairs is short enough for the JVM to compile."""

import pytest
from pyspark.sql import functions as F

from orrery.operators import streams as st
from orrery.plans.streams import _circle

CRITERIA = ("d_sh", "d_d", "d_h")


@pytest.fixture(scope="module")
def recurring(spark, smoke):
    """The same 150 orbits in eight windows, under ids of each window's own, with radii in two steps; and a window of other orbits."""
    o = _circle(spark, smoke)
    few = o.where("window_start = 0").limit(150)
    again = few.crossJoin(spark.range(8).toDF("w")).withColumn("traj_id", F.col("traj_id") * 10 + F.col("w")).withColumn("eps", F.when(F.col("w") < 4, 0.2 + F.col("w") / 200).otherwise(0.1))
    return st.stage(again.unionByName(o.where("window_start = 120").limit(100).withColumns({"w": F.lit(8).cast("bigint"), "eps": F.lit(0.3)})).select("w", "eps", "traj_id", *st.ELEMENTS))


def largest_method(df) -> int:
    spark = df.sparkSession
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan()
        made = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.execution.debug.package$").getField("MODULE$").get(None).codegenStringSeq(plan)
        return max(made.apply(k)._3().maxMethodCodeSize() for k in range(made.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)


@pytest.mark.parametrize("criterion", CRITERIA)
def test_pairs_are_compiled(spark, recurring, criterion):
    # HotSpot leaves methods of more than 8,000 bytes to its interpreter
    assert largest_method(st.close_pairs(recurring, "eps", criterion, ["w"])) < 8000


@pytest.mark.parametrize("criterion", CRITERIA)
def test_pairs_of_recurring_orbits_are_those_of_every_window(spark, recurring, criterion):
    x, y = recurring.alias("x"), recurring.alias("y")
    every = x.join(y, (F.col("x.w") == F.col("y.w")) & (F.col("x.traj_id") < F.col("y.traj_id"))).where(st.CRITERIA[criterion](st.orbit("x"), st.orbit("y")) <= F.col("x.eps"))
    want = sorted(tuple(r) for r in every.select("x.w", F.col("x.traj_id").alias("a"), F.col("y.traj_id").alias("b")).collect())
    assert want and sorted((r.w, r.a, r.b) for r in st.close_pairs(recurring, "eps", criterion, ["w"]).collect()) == want


def test_clusters_write_no_pairs(spark, monkeypatch):
    """400 orbits in two windows that are all near each other make 39,800 pairs, which were written twice."""
    df = spark.range(400).selectExpr("id as traj_id", "id % 2 as w", "0.5D + id / 1e7 as q", "0.5D as e", "10D as i", "1D as node", "2D as peri")
    real, written = st.stage, []

    def counted(*args):
        out = real(*args)
        written.append(out.count())
        return out

    monkeypatch.setattr(st, "stage", counted)
    assert st.dbscan(df, 0.05, 8, "d_sh", ["w"]).where("core and cluster = w").count() == 400
    assert max(written) <= 400


def test_pairs_of_thresholds_are_compiled(spark, recurring):
    once = recurring.drop("eps", "traj_id").distinct().withColumn("_w", F.lit(1).cast("bigint"))
    todo = recurring.select("w", F.col("eps").alias("_eps"), F.lit(0.05).alias("_floor")).distinct()
    assert largest_method(st._weighed(once, todo, "d_sh", ["w"])) < 8000


@pytest.mark.parametrize("most", [0, 10**9])
def test_thresholds_by_bins_are_those_of_sorting(spark, recurring, monkeypatch, most):
    monkeypatch.setattr(st, "SORTED", most)
    x, y = recurring.alias("x"), recurring.alias("y")
    d = st.CRITERIA["d_h"](st.orbit("x"), st.orbit("y"))
    want = {r.w: r.q for r in x.join(y, (F.col("x.w") == F.col("y.w")) & (F.col("x.traj_id") < F.col("y.traj_id"))).groupBy("x.w").agg(F.percentile(d, F.lit(0.02)).alias("q")).collect()}
    got = {r.w: r.eps for r in st.threshold(recurring, 0.02, "d_h", ["w"]).collect()}
    assert len(got) == 9 and got == pytest.approx(want, rel=1e-9)
