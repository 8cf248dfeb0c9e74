"""What grows with the input is neither evaluated again for each use nor passed through the driver."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from orrery.operators import experiments as ex
from orrery.operators import relational as rel
from orrery.operators import streams as st


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("experiment", ["grid", "sweep"])
def test_runs_read_staged_observations_and_shuffle_labels(spark, monkeypatch, experiment):
    rows = [(o, b, float(t), float((o * 7 + t * t) % 11), 0.1, o * 100 + 10 * k + t, "ab"[o % 2]) for o in range(12) for k, b in enumerate("xy") for t in range(8)]
    obs = spark.createDataFrame(rows, "oid bigint, band string, t double, mag double, magerr double, tie bigint, label string").where("crc32(label) > 0")
    plans = []

    def seen(data, columns, folds, learner, seed):
        plans.append(_plan(data))
        return data.select("oid", "fold", "label", F.col("label").alias("predicted"))

    monkeypatch.setattr(ex.ml, "cross_validate", seen)
    if experiment == "grid":
        out = ex.variant_grid(obs, ("x", "y"), (1,), 2, 1, modes=("per_band",), norms=("unit_time",))
    else:
        out = ex.ablation_sweep(obs, ("x", "y"), (1.0, 0.5), 2, 1, depth=1)
    assert len(plans) == out.count() and all(r.score == 1.0 and r.n_folds == 2 for r in out.collect())
    for plan in plans:
        assert "crc32" not in plan and "SortMergeJoin [oid" in plan


def test_nulls_and_orbits_of_a_comparison_are_evaluated_once(spark):
    rows = [(0.0, k, "..." if k % 3 else "S", 0.5 + 0.001 * k, 0.6, 10.0 + 0.1 * k, 20.0, 30.0) for k in range(120)]
    window = spark.createDataFrame(rows, "w double, traj_id bigint, iau_code string, q double, e double, i double, node double, peri double")
    centres = st.window_centres(window, ["w"], 5, 30, 1)
    out = st.compare_nulls(window, {"n": window.where("crc32(iau_code) > 0")}, centres, 0.1, ["w"])
    assert "crc32" not in _plan(out)
    # a null that is the window itself expects what is there
    (r,) = out.collect()
    assert math.isclose(r.stream_ratio, 1.0) and math.isclose(r.sporadic_ratio, 1.0) and r.n_regions == 5


def test_sideband_takes_the_first_of_each_pool_without_shuffling_orbits_to_centres(spark):
    orbits = spark.range(6000).select(F.col("id").alias("traj_id"), (F.col("id") % 3600 / 10.0).alias("sol_lon"), *[F.lit(1.0).alias(c) for c in ("q", "e", "i", "node", "peri")])
    centres = spark.createDataFrame([(5.0,), (200.0,)], "centre double")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pool = st.sideband_pool(orbits, centres)
        assert "BroadcastHashJoin" in _plan(pool)
        by = {}
        for r in pool.collect():
            by.setdefault(r.centre, []).append(r.traj_id)
        for size in (1, 40, 10_000):
            got = {}
            for r in st.sideband_null(orbits, centres, size, 3).collect():
                got.setdefault(r.centre, set()).add(r.traj_id)
            first = lambda ids: sorted(ids, key=lambda k: hashlib.md5(f"3|{k}".encode()).hexdigest())[:size]  # noqa: B023, E731
            assert got == {c: set(first(ids)) for c, ids in by.items()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_ranks_shuffle_rows_once_without_their_hashes(spark):
    keys = [0.0, -0.0, 1.5, math.nan, None]
    frame = spark.createDataFrame([(keys[k % 5], k) for k in range(500)], "w double, id bigint")
    ranked = rel.hash_ranks(frame, rel.hash_order(5, "id"), ["w"], "r", ["id"])
    lines = _plan(ranked).splitlines()
    below = lines[next(i for i, line in enumerate(lines) if "row_number" in line) :]
    shuffle = next(line for line in below if "Exchange" in line)
    assert "REPARTITION_BY_COL" in shuffle and "_h" not in shuffle
    groups = {}
    for k in range(500):
        w = keys[k % 5]
        groups.setdefault("nan" if w is not None and math.isnan(w) else w, []).append(k)
    want = {k: r for ids in groups.values() for r, k in enumerate(sorted(ids, key=lambda k: hashlib.md5(f"5|{k}".encode()).hexdigest()))}
    assert {r.id: r.r for r in ranked.collect()} == want and ranked.columns == ["w", "id", "r"]
