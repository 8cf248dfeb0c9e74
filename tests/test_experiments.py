"""Feature vectors, augmentations, kernels, p-values, close pairs and fetching, against plain computations."""

import base64
import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions import orbits as ob
from orrery.operators import convolution as cv
from orrery.operators import experiments as ex
from orrery.operators import relational as rel
from orrery.operators import signature as sg
from orrery.operators import stats as st
from orrery.operators import streams as sm
from orrery.operators import synthetic as sy
from orrery.plans import series
from orrery.plans import stats as stat_plans
from orrery.plans import streams as stream_plans
from orrery.sources import fetch as ft
from orrery.staging import discard, shared_dir, stage


def test_vector_widths(spark, smoke):
    obs = series.observations(spark, smoke)
    for mode, doubled, depth in (("per_band", False, 3), ("per_band", True, 1), ("interleaved", False, 2), ("joint", True, 2)):
        vector = ex.feature_vector(obs, series.BANDS, depth, mode, doubled=doubled)
        assert len(vector.columns) - 1 == ex.expected_width(depth, mode, series.BANDS, doubled)
    with pytest.raises(ValueError):
        ex.expected_width(2, "other", series.BANDS)


def test_vector_of_a_missing_band(spark):
    rows = [(1, "a", 0.0, 1.0, 0), (1, "a", 1.0, 3.0, 1), (2, "b", 0.0, 5.0, 2)]
    df = spark.createDataFrame(rows, "oid bigint, band string, t double, mag double, tie bigint")
    out = {r.oid: r for r in ex.feature_vector(df, ("a", "b"), 1, norm="raw_time").collect()}
    assert np.allclose(out[1][1:], (math.log(2), math.log(3), 0.0, 0.0)) and out[2][1:] == (0.0,) * 4


def channel(name, t, m):
    if name == "integral":
        return np.concatenate([[0], np.cumsum((m[1:] + m[:-1]) / 2 * np.diff(t))])
    if name == "running":
        return np.maximum.accumulate(m)
    if name == "delayed":
        return np.interp(t - ex.TAU, t, m)
    y = [m[0]]
    for k in range(1, len(m)):
        a = math.exp((t[k - 1] - t[k]) / ex.TAU)
        y.append(a * y[-1] + (1 - a) * m[k])
    return np.array(y)


@pytest.mark.parametrize("name", list(ex.AUGMENTATIONS))
def test_augmentations_equal_numpy(spark, name):
    rng = np.random.default_rng(5)
    t, m = np.sort(rng.random(12)), rng.normal(size=12)
    df = spark.createDataFrame([(0, float(x), float(y), k) for k, (x, y) in enumerate(zip(t, m, strict=True))], "oid bigint, t double, mag double, tie bigint")
    channels, base, doubled = ex.AUGMENTATIONS[name]
    path = np.column_stack([{"t": t, "mag": m}.get(c) if c in ("t", "mag") else channel(c, t, m) for c in channels])
    if base:
        path = np.vstack([np.zeros(path.shape[1]), path])
    if doubled:
        path = sg.lead_lag(path)
    want = np.concatenate(sg.path_levels(path, 2))
    row = ex.augmented_signature(df, name, ["oid"], 2).first()
    assert path.shape[1] == ex.augmentation_width(name)
    assert np.allclose([row[sg.name(w)] for k in (1, 2) for w in sg.words(path.shape[1], k)], want, atol=1e-9)


def test_convergence_verdicts(spark):
    told = {r.augmentation: r.verdict for r in ex.convergence_table(spark, (16, 64)).where("steps = 64").collect()}
    assert told["A0_mag_only"] == told["A1_time_aug"] == "blind" and told["A7_cum_integral"] == "order_sensitive"


def test_mutations_of_the_reflection_are_seen(spark):
    """Of the identities behind the table, each fails when the path is changed: the checks can fail."""
    pair = sy.reflection_pair(spark, 16)
    gap = lambda df: sg.signature(sg.steps(df, ["oid"], ["t", "tie"], ["t", "mag"]), ["oid"], ["t", "tie"], 2, 2).agg((F.max("s_12") - F.min("s_12")).alias("g")).first().g
    assert gap(pair) < 1e-12
    late = (F.col("oid") == 1) & (F.col("tie") == 5)
    assert gap(pair.withColumn("mag", F.when(late, F.col("mag") + 0.1).otherwise(F.col("mag")))) > 1e-3
    assert gap(pair.where(~late)) > 1e-4
    assert gap(pair.withColumn("t", F.when(F.col("oid") == 1, F.col("t") * F.col("t")).otherwise(F.col("t")))) > 1e-3


def test_families(spark):
    for name, make in sy.FAMILIES.items():
        rows = make(spark, 8, 3).collect()
        assert {r.label for r in rows} == {"A", "B"} and len({r.oid for r in rows}) == 8, name
        assert rows == make(spark, 8, 3).collect()
    loop = sy.orientation_loop(spark, 20, 1)
    area = sg.signature(sg.steps(loop, ["oid", "label"], ["tie"], ["t", "mag"]), ["oid", "label"], ["tie"], 2, 2).select("label", (F.col("s_12") - F.col("s_21")).alias("a")).collect()
    assert all((r.a > 0) == (r.label == "A") for r in area)


def plain_kernels(series, features, biases):
    out = []
    for i, ((k, d, _, channels), bias) in enumerate(zip(cv.plan(series.shape[1], len(series), features), biases, strict=True)):
        n = series.shape[1]
        weights = [2 if j in cv.KERNELS[k] else -1 for j in range(9)]
        conv = [sum(weights[j] * sum(series[c][p + (j - 4) * d] for c in channels) for j in range(9) if 0 <= p + (j - 4) * d < n) for p in range(n)]
        if i % 2 and n > 8 * d:
            conv = conv[4 * d : n - 4 * d]
        out += [sum(v > b for v in conv) / len(conv) for b in bias]
    return out


def test_kernels_equal_plain_loops():
    rng = np.random.default_rng(0)
    series = rng.normal(size=(3, 2, 30))
    biases = cv.fit(series, 200)
    got = cv.transform(series, 200, biases)
    assert len(cv.KERNELS) == 84 and got.shape[1] == sum(len(b) for b in biases) == 168
    for x, row in zip(series, got, strict=True):
        assert np.allclose(plain_kernels(x, 200, biases), row, atol=2e-2)
    assert sum(n for _, _, n, _ in cv.plan(64, 2, 9_996)) == 9_996


def test_kernel_features(spark, smoke):
    rows = series.QUERIES["convolution_features"](spark, smoke).collect()
    assert len(rows) == len({r.oid for r in rows}) > 0 and all(len(r.features) == len(rows[0].features) and 0 <= min(r.features) <= max(r.features) <= 1 for r in rows)


@pytest.mark.parametrize(("t", "df", "p"), [(2.0, 10.0, 0.07338803), (0.0, 5.0, 1.0), (-3.5, 49.0, 0.0009999), (1.96, 1e6, 0.0499960), (12.0, 3.0, 0.0012446)])
def test_t_tail(spark, t, df, p):
    got = spark.range(1).select(st.t_tail(F.lit(t), F.lit(df)).alias("p")).first().p
    assert math.isclose(got, p, rel_tol=2e-3, abs_tol=1e-9)


def test_other_tails(spark):
    row = spark.range(1).select(st.normal_tail(F.lit(1.959964)).alias("n"), st.ks_tail(F.lit(0.1358 * math.sqrt(2)), F.lit(100), F.lit(100)).alias("k"), st.log_gamma(F.lit(0.5)).alias("g")).first()
    assert math.isclose(row.n, 0.05, rel_tol=1e-4) and math.isclose(row.k, 0.05, rel_tol=2e-2) and math.isclose(row.g, math.lgamma(0.5), rel_tol=1e-9)


def test_close_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(9)
    rows = [(k, int(w), float(q), float(e), float(i), float(n), float(p)) for k, (w, q, e, i, n, p) in enumerate(zip(rng.integers(0, 2, 160), rng.uniform(0.05, 3.5, 160), rng.uniform(0, 1.1, 160), rng.uniform(0, 180, 160), rng.uniform(0, 360, 160), rng.uniform(0, 360, 160), strict=True))]
    rows += [(k + 200, w, q * (1 + 1e-3 * k), max(0.0, e - 1e-3 * k), i, n, p) for k, w, q, e, i, n, p in rows[:80]]
    rows += [(900, 0, None, 0.5, 1.0, 1.0, 1.0), (901, 0, float("nan"), 0.5, 1.0, 1.0, 1.0), (902, 0, 0.5, 0.0, 3.0, 4.0, 5.0), (903, 0, 0.5, 0.0, 3.0, 4.0, 5.0)]
    df = spark.createDataFrame(rows, "traj_id bigint, w bigint, q double, e double, i double, node double, peri double")
    fine = df.where("q is not null and not isnan(q)")
    x, y = fine.alias("x"), fine.alias("y")
    for criterion in ob.CRITERIA:
        for eps in (0.08, 0.3):
            every = x.join(y, (F.col("x.w") == F.col("y.w")) & (F.col("x.traj_id") < F.col("y.traj_id"))).select(F.col("x.w"), F.col("x.traj_id").alias("a"), F.col("y.traj_id").alias("b"), ob.CRITERIA[criterion](ob.orbit("x"), ob.orbit("y")).alias("d"))
            want = {tuple(r)[:3] for r in every.where(F.col("d") <= eps).collect()}
            found = [tuple(r)[:3] for r in sm.close_pairs(df, eps, criterion, ["w"]).collect()]
            assert len(found) == len(set(found)) and set(found) == want and want
            assert sm.neighbour_pairs(df, eps, criterion, ["w"]).count() == 2 * len(want)


def test_two_level_ranks(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), F.when(F.col("id") % 50 > 0, F.col("id") % 4).alias("n"))
    ranked = rel.hash_ranks(df, rel.hash_order(4, "id"), ["n"], "r", ["id"]).collect()
    by = {}
    for r in sorted(ranked, key=lambda r: r.r):
        by.setdefault(r.n, []).append(r)
    assert all([r.r for r in rows] == list(range(len(rows))) for rows in by.values()) and len(ranked) == 500
    placed = rel.places(df, F.desc("g"), "id").collect()
    assert [r.place for r in sorted(placed, key=lambda r: (-r.g, r.id))] == list(range(1, 501))


def test_learners(spark, smoke):
    for name in ("logreg_cv", "trees_cv"):
        rows = stat_plans.QUERIES[name](spark, smoke).collect()
        assert sorted(r.fold for r in rows) == [0, 1, 2] and all(0 <= r.balanced_accuracy <= 1 for r in rows)
    df = spark.createDataFrame([(i, i % 3, "xyz"[i // 3 % 3], float(i // 3 % 3), float(i % 7)) for i in range(90)], "oid bigint, fold bigint, label string, a double, b double")
    from orrery.operators import learning as ml

    for learner in ml.LEARNERS:
        told = ml.cross_validate(df, ["a", "b"], 3, learner, rounds=3)
        assert told.where("label = predicted").count() == told.count() == 90, learner
    with pytest.raises(ValueError):
        ml.cross_validate(df, ["a"], 3, "other")


def test_null_of_few_orbits_has_no_threshold(spark):
    df = spark.range(300).select(F.col("id").alias("traj_id"), F.lit(1).alias("w"), (0.5 + F.col("id") / 1000).alias("q"), F.lit(0.5).alias("e"), F.lit(10.0).alias("i"), F.lit(1.0).alias("node"), F.lit(2.0).alias("peri"))
    few = sm.threshold(df, 0.5, "d_sh", ["w"], most=60).first().eps
    assert few is not None and sm.threshold(df, 0.5, "d_sh", ["w"], most=40).first().eps is None
    assert abs(sm.threshold(df, 0.5, "d_sh", ["w"]).first().eps - few) < 0.02


# --- fetching -------------------------------------------------------------------------------------------


def test_halving_loses_only_the_bad_key():
    calls = []

    def fetch(keys):
        calls.append(len(keys))
        if 13 in keys:
            raise OSError("bad")
        return [{"k": k, "v": k * 2.0} for k in keys if k != 7]

    rows, failed = ft.fetch_halving(list(range(25)), fetch, retries=2)
    assert failed == [13] and sorted(r["k"] for r in rows) == [k for k in range(25) if k not in (7, 13)] and max(calls) == 25
    assert ft.fetch_halving([], fetch) == ([], [])
    with pytest.raises(ValueError):
        ft.fetch_halving(list(range(ft.MOST_KEYS + 1)), fetch)


def test_fetched_table_tells_what_failed(spark):
    def fetch(keys):
        if 13 in keys:
            raise OSError("bad")
        return [{"k": k, "v": k * 2.0} for k in keys if k != 7]

    keys = spark.createDataFrame([(k,) for k in [*range(30), 3, None]], "k bigint")
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.DoubleType())])
    rows = {r.k: (r.v, r.status) for r in ft.fetch_table(keys, "k", fetch, schema, batch=8, retries=1).collect()}
    assert len(rows) == 30 and rows[13] == (None, "failed") and rows[7] == (None, "empty") and rows[4] == (8.0, "ok")


def test_landing(tmp_path):
    asked = []

    def fetch(name):
        asked.append(name)
        if name == "b" and asked.count("b") == 1:
            raise OSError
        return None if name == "none" else name.encode()

    for _ in range(2):
        paths = ft.land_text(["a", "b", "none"], str(tmp_path), fetch)
        assert [p[-1] for p in paths] == ["a", "b"] and sorted(x.name for x in tmp_path.iterdir()) == ["a", "b"]
    assert asked.count("a") == 1 and asked.count("b") == 2


def image(pixels, bits=-32, extra=()):
    cards = ["SIMPLE  =                    T", f"BITPIX  = {bits:20d}", "NAXIS   =                    2", f"NAXIS1  = {pixels.shape[1]:20d}", f"NAXIS2  = {pixels.shape[0]:20d}", *extra, "END"]
    head = "".join(c.ljust(80) for c in cards).encode()
    body = pixels.astype(ft.PIXELS[bits]).tobytes()
    pad = lambda x, fill: x + fill * (-len(x) % ft.BLOCK)
    return pad(head, b" ") + pad(body, b"\0")


def test_images(spark):
    px = np.arange(6.0).reshape(2, 3)
    code = lambda b: base64.b64encode(b).decode()
    rows = [("a", code(gzip.compress(image(px)))), ("b", code(image(px, 16, ["BSCALE  =                  2.0", "BZERO   =                  1.0", "BLANK   =                    5"]))), ("c", "no image"), ("d", None), ("e", code(gzip.compress(b"short")))]
    out = {r.plate_id: r for r in ft.decode_images(spark.createDataFrame(rows, "plate_id string, body string")).collect()}
    assert (out["a"].height, out["a"].width, out["a"].px) == (2, 3, px.ravel().tolist())
    assert out["b"].px[:5] == [1.0, 3.0, 5.0, 7.0, 9.0] and math.isnan(out["b"].px[5])
    assert all(out[k].px is None for k in "cde")


def test_search(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (3.0, 4.0)], "ra double, dec double")
    assert sorted(map(tuple, ft.search_plates(df, lambda ra, dec: ["p", "q", "p"] if ra < 2 else []).collect())) == [(1.0, 2.0, "p"), (1.0, 2.0, "q")]


def test_working_tables(spark, monkeypatch):
    df = stage(spark.range(5), "t")
    assert df.count() == 5 and shared_dir(spark)
    discard(df)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(df._staged_at).count()

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: None)})
        sparkContext = type("S", (), {"master": "spark://host", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError):
        shared_dir(Elsewhere)
