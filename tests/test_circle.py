"""Consensus groups and nulls come from the windows of the whole circle."""

from orrery.functions.orbits import ELEMENTS
from orrery.operators import streams as st
from orrery.plans import streams as plan
from orrery.views import orbits


def test_consensus_finds_groups_anywhere(spark, monkeypatch):
    rows = [(i, 0.5 + i * 1e-4, 0.6, 10.0, 3.0, 40.0, 3.0 + i / 20) for i in range(9)]
    rows += [(20 + i, 0.9 + i * 1e-4, 0.8, 70.0, 215.0, 200.0, 215.0) for i in range(8)]
    rows += [(40 + i, 0.1 + 0.1 * i, 0.1 + 0.1 * i, 20.0 * i, 40.0 * i, 300.0 - 35 * i, 45.0 * i) for i in range(8)]
    df = spark.createDataFrame(rows, "traj_id bigint, q double, e double, i double, node double, peri double, sol_lon double")
    monkeypatch.setattr(plan, "orbits", lambda spark, d: df)
    got = {(r.window_start, r.traj_id, r.group) for r in plan.consensus(spark, "").collect()}
    assert got == {(w, i, 0) for w in (350.0, 0.0) for i in range(9)} | {(w, 20 + i, 0) for w in (200.0, 210.0) for i in range(8)}


def test_nulls_of_all_windows(spark, smoke):
    held = {}
    for r in st.hop_windows(orbits(spark, smoke), 20.0, 10.0).collect():
        held.setdefault(r.window_start, []).append(r)
    assert len(held) == 36
    null = {}
    for r in plan.permutation_null(spark, smoke).collect():
        null.setdefault(r.window_start, []).append(r)
    assert null.keys() == held.keys()
    for w, rows in null.items():
        assert all(sorted({r[c] for r in rows} - {r[c] for r in held[w]}) == [] for c in ELEMENTS)
    kde = plan.kde_null(spark, smoke).collect()
    assert {r.window_start for r in kde} == held.keys() and len({(r.window_start, r.traj_id) for r in kde}) == len(kde) <= 36 * 2000
    assert len({r.q for r in kde}) > 0.99 * len(kde)
