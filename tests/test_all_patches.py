"""Diagram distances and the gate take every patch, not some of each field."""

from itertools import combinations

from orrery.plans import topology as plan
from orrery.views import patches


def test_every_pair(spark, smoke, monkeypatch):
    rows = patches(spark, smoke).where("patch_id < 60").orderBy("field", "patch_id").limit(11).collect()
    few = spark.createDataFrame(rows, patches(spark, smoke).schema)
    monkeypatch.setattr(plan, "patches", lambda spark, d: few)
    field = {r.patch_id: r.field for r in rows}
    assert max(list(field.values()).count(f) for f in field.values()) > 3
    want = {(a, b): field[a] == field[b] for a, b in combinations(sorted(field), 2)}
    assert {(r.a, r.b): r.within for r in plan.bottleneck_pairs(spark, "").collect()} == want
    for r in plan.normalisation_gate(spark, "").collect():
        assert (r.n_within, r.n_between) == (sum(want.values()), len(want) - sum(want.values()))
