"""Signed ranks and their exact p against all sign patterns."""

import itertools
import math
import random

import pytest

from orrery.operators import stats as st


def plain_ranks(values):
    sizes = sorted(abs(v) for v in values)
    return [sizes.index(abs(v)) + (sizes.count(abs(v)) + 1) / 2 for v in values]


def plain_p(values):
    """Two-sided p by going through every pattern of signs."""
    values = [v for v in values if v]
    ranks = plain_ranks(values)
    w = min(sum(r for r, v in zip(ranks, values) if v > 0), sum(r for r, v in zip(ranks, values) if v < 0))
    sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=len(ranks))]
    return len(values), w, min(1.0, 2 * sum(s <= w for s in sums) / len(sums))


def frame(spark, groups):
    rows = [(k, None if v is None else float(v)) for k, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "k string, diff double").repartition(5)


def test_p_equals_all_sign_patterns(spark):
    r = random.Random(4)
    groups = {"one": [2.0], "up": [1, 2, 3, 4, 5], "ties": [1, 1, -1, 2, 2, -2], "zeros": [0, 0, 3, -1], "pair": [1, -2]}
    groups |= {f"r{i}": [r.choice((-3, -2, -1, 0, 1, 2, 3, 5)) for _ in range(12)] for i in range(6)}
    empty = {"none": [0, 0], "nulls": [None, math.nan]}
    got = {x.k: (x.n, x.statistic, x.p, x.exact) for x in st.wilcoxon_test(frame(spark, groups | empty), ["k"]).collect()}
    assert got == {k: (*plain_p(v), True) for k, v in groups.items()}
    assert got["up"][2] == 0.0625 and got["pair"][2] == 1.0
    alone = st.wilcoxon_test(frame(spark, {"x": groups["ties"]})).collect()
    assert [(x.n, x.statistic, x.p) for x in alone] == [plain_p(groups["ties"])]
    assert st.wilcoxon_test(frame(spark, empty)).collect() == [] and st.wilcoxon_test(frame(spark, {}), ["k"]).count() == 0


def test_large_groups_take_the_normal_tail(spark):
    r = random.Random(5)
    values = [r.gauss(0.2, 1) for _ in range(400)]
    large = st.wilcoxon_test(frame(spark, {"x": values, "y": values[:50], "z": values[:51]}), ["k"])
    got = {x.k: x for x in large.collect()}
    assert [got[k].exact for k in "xyz"] == [False, True, False]
    assert math.isclose(got["x"].p, math.erfc(abs(got["x"].z) / math.sqrt(2)), rel_tol=1e-5)
    # at 50 the two agree to a percent or so
    assert abs(got["y"].p - math.erfc(abs(got["y"].z) / math.sqrt(2))) < 0.01
    with pytest.raises(ValueError):
        st.wilcoxon_test(large, most=51)


def test_ranks_over_many_tasks(spark):
    """One key over many tasks: ranks across their borders are those of the whole."""
    values = [((i * 7919) % 1000) - 400 for i in range(5000)]
    many = spark.createDataFrame([(float(v),) for v in values], "diff double").repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = st.tied_ranks(many).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    kept = [v for v in values if v]
    want = dict(zip((abs(v) for v in kept), plain_ranks(kept)))
    assert {x["size"]: x["rank"] for x in ranked} == want
