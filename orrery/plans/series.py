"""Queries of the time series operators: signatures, features, resampling, channels."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import functions as F

from ..functions.scalars import digits, log_modulus
from ..operators import convolution as cv
from ..operators import experiments as ex
from ..operators import features as ft
from ..operators import paths as pt
from ..operators import signature as sg
from ..operators import synthetic as sy
from ..views import BANDS, labelled, obs_sql, observations

QUERIES: dict = {}
ORACLES: dict = {}
OBS = obs_sql(BANDS)
ORDER = list(pt.ORDER)
PLACES = 4
#: Where exact halves of the fourth place occur.
FINE = 6


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return keep


# --- signatures ---------------------------------------------------------------------------------------


def signature_sql(source: str, channels: int, depth: int, keys: str = "oid, band", order: str = "t, tie", places: int = PLACES, wrap: str = "{}") -> str:
    """DuckDB SQL: CTEs after `source` (which ends with a CTE st of keys, order and d_0 ...) and a select of rounded terms by key."""
    words = lambda k: list(itertools.product(range(channels), repeat=k))
    n = lambda w: "".join(str(c + 1) for c in w)
    ctes, last = [], "st"
    for level in range(1, depth + 1):
        terms = []
        for w in words(level):
            parts = []
            for j in range(1, level + 1):
                head, tail = w[: level - j], w[level - j :]
                parts.append(" * ".join([f"{1.0 / math.factorial(j)!r}::DOUBLE", *[f"d_{c}" for c in tail], *([f"p_{n(head)}"] if head else [])]))
            terms.append(f"{' + '.join(parts)} AS i_{n(w)}")
        ctes.append(f"i{level} AS (SELECT *, {', '.join(terms)} FROM {last})")
        last = f"i{level}"
        if level < depth:
            sums = ", ".join(f"coalesce(sum(i_{n(w)}) OVER w, 0e0) AS p_{n(w)}" for w in words(level))
            ctes.append(f"p{level} AS (SELECT *, {sums} FROM {last} WINDOW w AS (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
            last = f"p{level}"
    every = [w for k in range(1, depth + 1) for w in words(k)]
    out = ", ".join(f"round({wrap.format(f'sum(i_{n(w)})')}, {places}) + 0e0 AS s_{n(w)}" for w in every)
    return f"{source}, {', '.join(ctes)} SELECT {keys}, count(*) AS n_points, {out} FROM {last} GROUP BY {keys}"


def norm_sql(how: str, keys: str = "oid, band", extra: str = "") -> str:
    since, span = f"t - min(t) OVER (PARTITION BY {keys})", f"(max(t) OVER (PARTITION BY {keys}) - min(t) OVER (PARTITION BY {keys}))"
    time = f"CASE WHEN {span} > 0 THEN ({since}) / {span} ELSE 0e0 END" if how == "unit_time" else since
    mag = "mag" if how == "raw" else f"mag - median(mag) OVER (PARTITION BY {keys})"
    return f"nm AS (SELECT *, {time} AS ct, {mag} AS cm{extra} FROM obs)"


def steps_sql(channels: list[str], keys: str = "oid, band", order: str = "t, tie", base: bool = False, source: str = "nm") -> str:
    w = f"(PARTITION BY {keys} ORDER BY {order})"
    return "st AS (SELECT *, " + ", ".join(f"{c} - coalesce(lag({c}) OVER {w}, {'0e0' if base else c}) AS d_{i}" for i, c in enumerate(channels)) + f" FROM {source})"


def _rounded(df, keys, wrap=lambda c: c, places=PLACES):
    return df.select(*keys, "n_points", *[digits(wrap(F.col(c)), places).alias(c) for c in df.columns if c.startswith("s_")])


def _per_band(spark, d, how, depth, base=False, wrap=lambda c: c, places=PLACES):
    keys = ["oid", "band"]
    stepped = sg.steps(pt.normalise(observations(spark, d), keys, how), keys, ORDER, ["ct", "cm"], base)
    return _rounded(sg.signature(stepped, keys, ORDER, 2, depth), keys, wrap, places)


def _band_sql(how, depth, base=False, wrap="{}", places=PLACES):
    return signature_sql(f"WITH {OBS}, {norm_sql(how)}, {steps_sql(['ct', 'cm'], base=base)}", 2, depth, wrap=wrap, places=places)


@query(_band_sql("raw_time", 2))
def sig_depth2_per_band(spark, d):
    return _per_band(spark, d, "raw_time", 2)


@query(_band_sql("unit_time", 3))
def sig_depth3_per_band(spark, d):
    return _per_band(spark, d, "unit_time", 3)


@query(_band_sql("unit_time", 4))
def sig_depth4_per_band(spark, d):
    return _per_band(spark, d, "unit_time", 4)


@query(_band_sql("raw", 2, places=FINE))
def sig_raw(spark, d):
    return _per_band(spark, d, "raw", 2, places=FINE)


@query(_band_sql("unit_time", 2, base=True, places=FINE))
def sig_basepoint(spark, d):
    return _per_band(spark, d, "unit_time", 2, base=True, places=FINE)


@query(_band_sql("raw_time", 3, wrap="(CASE WHEN {0} >= 0 THEN 1e0 ELSE -1e0 END * ln(1e0 + abs({0})))"))
def sig_logmod(spark, d):
    return _per_band(spark, d, "raw_time", 3, wrap=log_modulus)


@query(signature_sql(f"WITH {OBS}, {norm_sql('unit_time', 'oid', extra=chr(44) + ' CASE band WHEN ' + repr('view') + ' THEN 0e0 ELSE 1e0 END AS cb')}, {steps_sql(['ct', 'cm', 'cb'], 'oid')}", 3, 2, "oid", places=FINE))
def sig_interleaved(spark, d):
    stepped = sg.steps(pt.interleaved(observations(spark, d), BANDS), ["oid"], ORDER, ["ct", "cm", "cb"])
    return _rounded(sg.signature(stepped, ["oid"], ORDER, 3, 2), ["oid"], places=FINE)


JOINT = f"""WITH {OBS}, c AS (SELECT *, mag - median(mag) OVER (PARTITION BY oid, band) AS v FROM obs),
    ts AS (SELECT DISTINCT oid, t FROM c), bd AS (SELECT unnest(['view', 'click']) AS band), g AS (SELECT oid, t, band FROM ts, bd),
    a AS (SELECT g.oid, g.t, g.band, c.v FROM g ASOF LEFT JOIN c ON g.oid = c.oid AND g.band = c.band AND g.t >= c.t),
    f AS (SELECT oid, band, arg_min(v, t) AS v0 FROM c GROUP BY oid, band),
    l AS (SELECT a.oid, a.t, a.band, coalesce(a.v, f.v0, 0e0) AS v FROM a LEFT JOIN f ON a.oid = f.oid AND a.band = f.band),
    j AS (SELECT oid, t, max(v) FILTER (band = 'view') AS c_view, max(v) FILTER (band = 'click') AS c_click FROM l GROUP BY oid, t),
    nm AS (SELECT *, CASE WHEN max(t) OVER (PARTITION BY oid) > min(t) OVER (PARTITION BY oid) THEN (t - min(t) OVER (PARTITION BY oid)) / (max(t) OVER (PARTITION BY oid) - min(t) OVER (PARTITION BY oid)) ELSE 0e0 END AS ct FROM j)"""


@query(f"{JOINT} SELECT oid, round(t, 6) AS t, round(ct, 6) AS ct, round(c_view, 4) + 0e0 AS c_view, round(c_click, 4) + 0e0 AS c_click FROM nm")
def asof_ffill(spark, d):
    j = pt.joint_ffill(observations(spark, d), BANDS)
    return j.select("oid", F.round("t", 6).alias("t"), F.round("ct", 6).alias("ct"), digits(F.col("c_view"), 4).alias("c_view"), digits(F.col("c_click"), 4).alias("c_click"))


@query(signature_sql(f"{JOINT}, {steps_sql(['ct', 'c_view', 'c_click'], 'oid', 't')}", 3, 2, "oid", "t", places=FINE))
def sig_joint(spark, d):
    stepped = sg.steps(pt.joint_ffill(observations(spark, d), BANDS), ["oid"], ["t"], ["ct", "c_view", "c_click"])
    return _rounded(sg.signature(stepped, ["oid"], ["t"], 3, 2), ["oid"], places=FINE)


LEADLAG = f"""WITH {OBS}, {norm_sql('unit_time')}, {steps_sql(['ct', 'cm']).replace('st AS', 's0 AS')},
    st AS (SELECT oid, band, t, tie, 0 AS half, d_0, d_1, 0e0 AS d_2, 0e0 AS d_3 FROM s0 UNION ALL SELECT oid, band, t, tie, 1, 0e0, 0e0, d_0, d_1 FROM s0)"""


def _lead_lag(spark, d, depth):
    keys = ["oid", "band"]
    stepped = sg.steps(pt.normalise(observations(spark, d), keys), keys, ORDER, ["ct", "cm"])
    doubled, order = sg.lead_lag_steps(stepped, ORDER, 2)
    return sg.signature(doubled, keys, order, 4, depth)


@query(signature_sql(LEADLAG, 4, 2, order="t, tie, half", places=FINE))
def sig_leadlag_d2(spark, d):
    return _rounded(_lead_lag(spark, d, 2), ["oid", "band"], places=FINE)


@query()
def sig_leadlag_d4(spark, d):
    """340 words of the four-channel lead-lag path of each object and band, in one array."""
    keys = ["oid", "band"]
    return sg.wide_signature(pt.normalise(observations(spark, d), keys), keys, ORDER, ["ct", "cm"], 4, doubled=True)


@query(f"WITH {OBS}, {norm_sql('raw_time')}, {steps_sql(['ct', 'cm'])} SELECT oid, band, round(sum(d_0 * d_0), 4) AS qtt, round(sum(d_1 * d_1), 4) AS qmm, round(sum(d_0 * d_1), 4) + 0e0 AS qtm FROM st GROUP BY oid, band")
def quad_variation(spark, d):
    q = ft.quadratic_variation(observations(spark, d), BANDS)
    return q.select("oid", "band", F.round("qtt", 4).alias("qtt"), F.round("qmm", 4).alias("qmm"), digits(F.col("qtm"), 4).alias("qtm"))


@query(f"""WITH {OBS}, {norm_sql('unit_time')}, {steps_sql(['ct', 'cm'])}, w AS (SELECT *, ct - d_0 AS t0, cm - d_1 AS m0, first_value(cm) OVER (PARTITION BY oid, band ORDER BY t, tie) AS f FROM st)
    SELECT oid, band, round(sum(t0 * d_1 - (m0 - f) * d_0), {PLACES}) + 0e0 AS area FROM w GROUP BY oid, band""")
def levy_area(spark, d):
    """S12 - S21: twice the signed area between the path and its chord."""
    keys = ["oid", "band"]
    s = sg.signature(sg.steps(pt.normalise(observations(spark, d), keys), keys, ORDER, ["ct", "cm"]), keys, ORDER, 2, 2)
    return s.select(*keys, digits(F.col("s_12") - F.col("s_21"), PLACES).alias("area"))


_PLAIN = _band_sql("unit_time", 2, places=12)
_DOUBLED = signature_sql(LEADLAG, 4, 2, order="t, tie, half", places=12)
_GAPS = ", ".join(f"abs(l.s_{x} - ({y}))" for i, j in itertools.product((1, 2), repeat=2) for x, y in ((f"{i}{j}", f"p.s_{i}{j}"), (f"{i + 2}{j + 2}", f"p.s_{i}{j}"), (f"{i}{j + 2}", f"p.s_{i}{j} + q_{i}{j} / 2"), (f"{i + 2}{j}", f"p.s_{i}{j} - q_{i}{j} / 2")))


@query(f"""WITH l AS ({_DOUBLED}), p AS ({_PLAIN}), q AS (WITH {OBS}, {norm_sql('unit_time')}, {steps_sql(['ct', 'cm'])} SELECT oid, band, sum(d_0 * d_0) AS q_11, sum(d_0 * d_1) AS q_12, sum(d_1 * d_0) AS q_21, sum(d_1 * d_1) AS q_22 FROM st GROUP BY oid, band)
    SELECT l.oid, l.band, round(greatest({_GAPS}), 6) + 0e0 AS residual FROM l JOIN p ON l.oid = p.oid AND l.band = p.band JOIN q ON l.oid = q.oid AND l.band = q.band""")
def leadlag_identity_residual(spark, d):
    """Level 2 of the lead-lag path against its closed form in the path's own terms and quadratic variation: 0 to 6 places."""
    keys = ["oid", "band"]
    stepped = sg.steps(pt.normalise(observations(spark, d), keys), keys, ORDER, ["ct", "cm"])
    plain = sg.signature(stepped, keys, ORDER, 2, 2).withColumnsRenamed({c: "a" + c for c in ("s_1", "s_2", "s_11", "s_12", "s_21", "s_22")})
    q = stepped.groupBy(*keys).agg(*[F.sum(F.col(f"d_{i}") * F.col(f"d_{j}")).alias(f"q_{i + 1}{j + 1}") for i in (0, 1) for j in (0, 1)])
    wide = _lead_lag(spark, d, 2).join(plain.drop("n_points"), keys).join(q, keys)
    gap = F.lit(0.0)
    for i, j in itertools.product((1, 2), repeat=2):
        base, half = F.col(f"as_{i}{j}"), 0.5 * F.col(f"q_{i}{j}")
        for found, want in ((f"s_{i}{j}", base), (f"s_{i + 2}{j + 2}", base), (f"s_{i}{j + 2}", base + half), (f"s_{i + 2}{j}", base - half)):
            gap = F.greatest(gap, F.abs(F.col(found) - want))
    return wide.select(*keys, digits(gap, 6).alias("residual"))


def _bump(c: float, a: float) -> str:
    return f"CASE WHEN abs((x - {c!r}::DOUBLE) / 15e-2) < 1 THEN {a!r}::DOUBLE * 5e-1 * (1 + cos(pi() * ((x - {c!r}::DOUBLE) / 15e-2))) ELSE 0e0 END"


#: Both classes of the reflected pair on three grids, with the running trapezoid integral.
REFLECTED = f"""g AS (SELECT unnest([16, 64, 256]) AS steps), j AS (SELECT steps, unnest(range(0, steps + 1)) AS tie FROM g), k AS (SELECT steps, tie, unnest([0, 1]) AS side FROM j),
    x AS (SELECT steps, side, tie, tie / CAST(steps AS DOUBLE) AS t, CASE WHEN side = 0 THEN tie ELSE steps - tie END / CAST(steps AS DOUBLE) AS x FROM k), m AS (SELECT *, {_bump(0.3, 1.0)} + {_bump(0.7, 0.5)} AS mag FROM x),
    ar AS (SELECT *, coalesce(5e-1 * (mag + lag(mag) OVER w) * (t - lag(t) OVER w), 0e0) AS area FROM m WINDOW w AS (PARTITION BY steps, side ORDER BY tie)),
    nm AS (SELECT *, sum(area) OVER (PARTITION BY steps, side ORDER BY tie ROWS UNBOUNDED PRECEDING) AS integral FROM ar)"""


def _reflected(channels: list[str]) -> str:
    return signature_sql(f"WITH {REFLECTED}, {steps_sql(channels, 'steps, side', 'tie')}", len(channels), 2, "steps, side", "tie", places=15)


_RANGE = lambda *names: "greatest(" + ", ".join(f"max(s_{n}) - min(s_{n})" for n in names) + ")"


@query(f"""WITH p AS ({_reflected(['t', 'mag'])}), i AS ({_reflected(['t', 'mag', 'integral'])}), a AS (SELECT steps, round({_RANGE('1', '2')}, 9) AS level1, round({_RANGE('11', '12', '21', '22')}, 9) AS plain_level2 FROM p GROUP BY steps),
    b AS (SELECT steps, {_RANGE('13', '31', '23', '32')} > 1e-3 AS integral_differs FROM i GROUP BY steps) SELECT CAST(a.steps AS BIGINT) AS steps, level1, plain_level2, integral_differs FROM a JOIN b ON a.steps = b.steps""")
def reflection_blindness(spark, d):
    """Two classes, one the other reversed on an even grid: levels 1 and 2 of (t, m) don't tell them apart, an integral channel does."""
    out = None
    gap = lambda *names: F.greatest(*[F.max(f"s_{n}") - F.min(f"s_{n}") for n in names])
    for steps in (16, 64, 256):
        p = pt.cumulative_integral(sy.reflection_pair(spark, steps), ["oid"])
        s = sg.signature(sg.steps(p, ["oid"], ORDER, ["t", "mag"]), ["oid"], ORDER, 2, 2)
        i = sg.signature(sg.steps(p, ["oid"], ORDER, ["t", "mag", "integral"]), ["oid"], ORDER, 3, 2)
        a = s.agg(F.round(gap("1", "2"), 9).alias("level1"), F.round(gap("11", "12", "21", "22"), 9).alias("plain_level2"))
        one = a.join(i.agg((gap("13", "31", "23", "32") > 1e-3).alias("integral_differs"))).withColumn("steps", F.lit(steps).cast("bigint"))
        out = one if out is None else out.unionByName(one)
    return out.select("steps", "level1", "plain_level2", "integral_differs")


def _gap_sql(names: list[str], level: int) -> str:
    names = [n for n in names if len(n) == level]
    scale = f"greatest({', '.join(f'max(abs(s_{n}))' for n in names)}, 0e0)"
    return f"CASE WHEN {scale} < 1e-14 THEN 0e0 ELSE greatest({', '.join(f'max(s_{n}) - min(s_{n})' for n in names)}, 0e0) / {scale} END"


def _converged_sql(name: str) -> str:
    """Rows (augmentation, steps, level1, level2) of one augmentation of the reflected pair."""
    channels, base, doubled = ex.AUGMENTATIONS[name]
    columns = ["running" if c == "running" else c for c in channels]
    source = f"WITH {REFLECTED}, rn AS (SELECT *, max(mag) OVER (PARTITION BY steps, side ORDER BY tie ROWS UNBOUNDED PRECEDING) AS running FROM nm), {steps_sql(columns, 'steps, side', 'tie', base, 'rn')}"
    n, order = len(columns), "tie"
    if doubled:
        move = lambda lead: ", ".join([*[f"{f'd_{i}' if lead else '0e0'} AS d_{i}" for i in range(n)], *[f"{'0e0' if lead else f'd_{i}'} AS d_{n + i}" for i in range(n)]])
        source = source.replace("st AS (", "s0 AS (") + f", st AS (SELECT steps, side, tie, 0 AS half, {move(True)} FROM s0 UNION ALL SELECT steps, side, tie, 1, {move(False)} FROM s0)"
        n, order = 2 * n, "tie, half"
    words = ["".join(map(str, w)) for k in (1, 2) for w in itertools.product(range(1, n + 1), repeat=k)]
    return f"SELECT '{name}' AS augmentation, steps, {_gap_sql(words, 1)} AS level1, {_gap_sql(words, 2)} AS level2 FROM ({signature_sql(source, n, 2, 'steps, side', order, places=15)}) GROUP BY steps"


CONVERGING = [n for n, (c, _, _) in ex.AUGMENTATIONS.items() if not {"ewma", "delayed"} & set(c)]


@query(f"""WITH c AS ({' UNION ALL '.join(_converged_sql(n) for n in CONVERGING)}), e AS (SELECT augmentation, arg_max(level1, steps) AS l1, arg_max(level2, steps) AS l2, arg_min(level2, steps) AS f FROM c GROUP BY 1)
    SELECT c.augmentation, CAST(steps AS BIGINT) AS steps, round(level1, 6) + 0e0 AS level1, round(level2, 6) + 0e0 AS level2, CASE WHEN l2 < 1e-10 THEN 'blind' WHEN l2 < 1e-3 AND l2 < f / 10 THEN 'residue' WHEN l1 > 1e-6 THEN 'visible_at_level_1' ELSE 'order_sensitive' END AS verdict
    FROM c JOIN e ON c.augmentation = e.augmentation""")
def convergence_table(spark, d):
    """Class gaps by grid of every augmentation that SQL can follow, and what the finest says."""
    t = ex.convergence_table(spark, (16, 64, 256), CONVERGING)
    return t.select("augmentation", "steps", digits(F.col("level1"), 6).alias("level1"), digits(F.col("level2"), 6).alias("level2"), "verdict")


@query()
def convergence_of_memory(spark, d):
    """The same for the delayed and the smoothed channel."""
    return ex.convergence_table(spark, (16, 64, 256), [n for n in ex.AUGMENTATIONS if n not in CONVERGING])


@query()
def family_scores(spark, d):
    return ex.family_scores(spark, 200, 3, 7)


@query(f"""WITH a AS ({_band_sql('raw_time', 2, places=12)}), b AS ({_band_sql('unit_time', 2, places=12)}) SELECT a.oid, a.band, {', '.join(
    f"round(CASE WHEN greatest({s}) < 1e-14 THEN 0e0 ELSE greatest({g}) / greatest({s}) END, 5) + 0e0 AS level{k}" for k, words in ((1, ('1', '2')), (2, ('11', '12', '21', '22')))
    for s, g in ((', '.join(f'abs({t}.s_{w})' for t in 'ab' for w in words), ', '.join(f'abs(a.s_{w} - b.s_{w})' for w in words)),))} FROM a JOIN b ON a.oid = b.oid AND a.band = b.band""")
def relative_difference(spark, d):
    """Of each level, how far the signatures of raw and of scaled time are apart."""
    keys, words = ["oid", "band"], {1: ["s_1", "s_2"], 2: ["s_11", "s_12", "s_21", "s_22"]}
    arrays = lambda how, tag: sg.signature(sg.steps(pt.normalise(observations(spark, d), keys, how), keys, ORDER, ["ct", "cm"]), keys, ORDER, 2, 2).select(*keys, *[F.array(*w).alias(f"{tag}{k}") for k, w in words.items()])
    both = arrays("raw_time", "a").join(arrays("unit_time", "b"), keys)
    return both.select(*keys, *[digits(sg.relative_difference(F.col(f"a{k}"), F.col(f"b{k}"))).alias(f"level{k}") for k in words])


@query()
def convolution_features(spark, d):
    """Shares of positive responses of random-free convolution kernels over the interpolated panel of each object."""
    panel = pt.interpolated_panel(observations(spark, d), BANDS)
    return cv.kernel_features(panel, BANDS, 64, features=2_000)


# --- feature vectors and augmentations ------------------------------------------------------------------

_LM = "(CASE WHEN {0} >= 0 THEN 1e0 ELSE -1e0 END * ln(1e0 + abs({0})))"


def _vector_sql(signature: str, channels: int, depth: int, bands=BANDS) -> str:
    """One row of log-moduli for each object, from the words of its bands or of its one path."""
    words = ["s_" + "".join(map(str, w)) for k in range(1, depth + 1) for w in itertools.product(range(1, channels + 1), repeat=k)]
    cells = [f"coalesce(max({w}) FILTER (band = '{b}'), 0e0)" for b in bands for w in words] if bands else [f"max({w})" for w in words]
    return f"WITH sig AS ({signature}) SELECT oid, {', '.join(f'round({_LM.format(c)}, 5) + 0e0 AS f_{i}' for i, c in enumerate(cells))} FROM sig GROUP BY oid"


def _vector(df):
    return df.select("oid", *[digits(F.col(c)).alias(c) for c in df.columns if c != "oid"])


@query(_vector_sql(_band_sql("raw_time", 2, places=12), 2, 2))
def vector_per_band(spark, d):
    """The feature vector of an object: its bands' signatures side by side, by log-modulus."""
    return _vector(ex.feature_vector(observations(spark, d), BANDS, 2, "per_band", "raw_time"))


@query(_vector_sql(signature_sql(LEADLAG, 4, 2, order="t, tie, half", places=12), 4, 2))
def vector_lead_lag(spark, d):
    return _vector(ex.feature_vector(observations(spark, d), BANDS, 2, "per_band", "unit_time", doubled=True))


@query(_vector_sql(signature_sql(f"{JOINT}, {steps_sql(['ct', 'c_view', 'c_click'], 'oid', 't')}", 3, 2, "oid", "t", places=12), 3, 2, ()))
def vector_joint(spark, d):
    return _vector(ex.feature_vector(observations(spark, d), BANDS, 2, "joint"))


_POINTS = f"WITH {OBS}, {norm_sql('unit_time')}"
_CHANNEL = {
    "integral": "ar AS (SELECT *, coalesce(5e-1 * (cm + lag(cm) OVER w) * (ct - lag(ct) OVER w), 0e0) AS area FROM nm WINDOW w AS (PARTITION BY oid, band ORDER BY ct, tie)), ch AS (SELECT *, sum(area) OVER (PARTITION BY oid, band ORDER BY ct, tie ROWS UNBOUNDED PRECEDING) AS cx FROM ar)",
    "running": "ch AS (SELECT *, max(cm) OVER (PARTITION BY oid, band ORDER BY ct, tie ROWS UNBOUNDED PRECEDING) AS cx FROM nm)",
    "delayed": """q AS (SELECT *, ct - 5e-2 AS x FROM nm), q0 AS (SELECT q.*, o.ct AS t0, o.cm AS m0 FROM q ASOF LEFT JOIN nm o ON q.oid = o.oid AND q.band = o.band AND q.x >= o.ct),
        q1 AS (SELECT q0.*, o.ct AS t1, o.cm AS m1 FROM q0 ASOF LEFT JOIN nm o ON q0.oid = o.oid AND q0.band = o.band AND q0.x <= o.ct),
        ch AS (SELECT *, CASE WHEN t0 IS NULL THEN m1 WHEN t1 IS NULL OR t1 = t0 THEN m0 ELSE m0 + (m1 - m0) * (x - t0) / (t1 - t0) END AS cx FROM q1)""",
    "ewma": """n AS (SELECT *, row_number() OVER (PARTITION BY oid, band ORDER BY ct, tie) AS i FROM nm), r AS (SELECT oid, band, tie, ct, i, cm AS y FROM n WHERE i = 1 UNION ALL
        SELECT n.oid, n.band, n.tie, n.ct, n.i, exp((r.ct - n.ct) / 5e-2) * r.y + (1 - exp((r.ct - n.ct) / 5e-2)) * n.cm FROM r JOIN n ON n.oid = r.oid AND n.band = r.band AND n.i = r.i + 1), ch AS (SELECT nm.*, r.y AS cx FROM nm JOIN r ON nm.oid = r.oid AND nm.band = r.band AND nm.tie = r.tie)""",
}


def _augmented_sql(name: str) -> str:
    channels, base, doubled = ex.AUGMENTATIONS[name]
    extra = next((c for c in channels if c in _CHANNEL), None)
    columns = [{"t": "ct", "mag": "cm"}.get(c, "cx") for c in channels]
    n = len(columns)
    with_ = _POINTS.replace("WITH ", "WITH RECURSIVE ", 1) if extra == "ewma" else _POINTS
    source = f"{with_}, {_CHANNEL[extra]}, {steps_sql(columns, source='ch', order='ct, tie', base=base)}" if extra else f"{with_}, {steps_sql(columns, order='ct, tie', base=base)}"
    if not doubled:
        return signature_sql(source, n, 2, order="ct, tie", places=FINE)
    move = lambda lead: ", ".join([*[f"{f'd_{i}' if lead else '0e0'} AS d_{i}" for i in range(n)], *[f"{'0e0' if lead else f'd_{i}'} AS d_{n + i}" for i in range(n)]])
    source = source.replace("st AS (", "s0 AS (") + f", st AS (SELECT oid, band, ct, tie, 0 AS half, {move(True)} FROM s0 UNION ALL SELECT oid, band, ct, tie, 1, {move(False)} FROM s0)"
    return signature_sql(source, 2 * n, 2, order="ct, tie, half", places=FINE)


def _augmentation(name: str):
    def run(spark, d):
        points = pt.normalise(observations(spark, d), KEYS, "unit_time").select(*KEYS, F.col("ct").alias("t"), F.col("cm").alias("mag"), "tie")
        return _rounded(ex.augmented_signature(points, name, KEYS, 2), KEYS, places=FINE)

    run.__doc__ = f"Depth-2 signature of the {name} path of each object and band."
    return run


KEYS = ["oid", "band"]
for _name in ex.AUGMENTATIONS:
    query(_augmented_sql(_name), "augment_" + _name.split("_")[0].lower() + "_" + "_".join(_name.replace(".", "").split("_")[1:]))(_augmentation(_name))


# --- features -----------------------------------------------------------------------------------------

_B = f"""WITH {OBS}, w AS (SELECT *, median(mag) OVER p AS med, avg(mag) OVER p AS mu, stddev_samp(mag) OVER p AS sd, CAST(count(*) OVER p AS DOUBLE) AS n, min(t) OVER p AS t0, t - lag(t) OVER o AS dt, mag - lag(mag) OVER o AS dm
        FROM obs WINDOW p AS (PARTITION BY oid, band), o AS (PARTITION BY oid, band ORDER BY t, tie)),
    x AS (SELECT *, abs(mag - med) AS dev, CASE WHEN n > 1 THEN sqrt(n / (n - 1)) * (mag - mu) / magerr END AS delta, CASE WHEN dt > 0 THEN abs(dm / dt) END AS slope, CASE WHEN dt > 0 THEN dt END AS gap FROM w)"""


def _features_sql(columns: dict[str, str]) -> str:
    out = ", ".join(f"CASE WHEN count(*) < 2 THEN 0e0 ELSE round(coalesce({e}, 0e0), 4) + 0e0 END AS {n}" for n, e in columns.items())
    return f"{_B} SELECT oid, band, {out} FROM x GROUP BY oid, band"


_AMP = "(quantile_cont(mag, 95e-2) - quantile_cont(mag, 5e-2))"
CORE = {"n_obs": "CAST(count(*) AS DOUBLE)", "t_span": "max(t) - min(t)", "mean": "avg(mag)", "median": "median(mag)", "std": "stddev_samp(mag)", "mad": "median(dev)", "amplitude": _AMP, "beyond1std": "CASE WHEN stddev_samp(mag) > 0 THEN avg(CASE WHEN abs(mag - mu) > sd THEN 1e0 ELSE 0e0 END) END"}
SHAPE = {
    "skew": "CASE WHEN count(*) >= 3 AND stddev_samp(mag) > 0 THEN skewness(mag) END", "kurtosis": "CASE WHEN count(*) >= 4 AND stddev_samp(mag) > 0 THEN kurtosis(mag) END", "stetson_k": "CASE WHEN avg(delta * delta) > 0 THEN avg(abs(delta)) / sqrt(avg(delta * delta)) END",
    "percent_amplitude": "CASE WHEN median(mag) <> 0 THEN max(dev) / median(mag) END", "flux_mid20": f"CASE WHEN {_AMP} <> 0 THEN (quantile_cont(mag, 6e-1) - quantile_cont(mag, 4e-1)) / {_AMP} END",
    "flux_mid50": f"CASE WHEN {_AMP} <> 0 THEN (quantile_cont(mag, 75e-2) - quantile_cont(mag, 25e-2)) / {_AMP} END", "flux_mid80": f"CASE WHEN {_AMP} <> 0 THEN (quantile_cont(mag, 9e-1) - quantile_cont(mag, 1e-1)) / {_AMP} END",
}
_PEAK = "arg_min(t, (mag, t, tie))"
ORDERED = {
    "linear_trend": "CASE WHEN max(t) > min(t) THEN regr_slope(mag, t - t0) END", "max_slope": "max(slope)", "median_abs_slope": "median(slope)", "rise_frac": f"CASE WHEN max(t) > min(t) THEN ({_PEAK} - min(t)) / (max(t) - min(t)) END",
    "fade_frac": f"CASE WHEN max(t) > min(t) THEN (max(t) - {_PEAK}) / (max(t) - min(t)) END", "peak_mag": "min(mag)", "cadence_median": "median(gap)", "cadence_iqr": "quantile_cont(gap, 75e-2) - quantile_cont(gap, 25e-2)",
}


def _features(spark, d, names):
    f = ft.band_features(observations(spark, d))
    return f.select("oid", "band", *[digits(F.col(c), 4).alias(c) for c in names])


@query(_features_sql(CORE))
def band_features_core(spark, d):
    return _features(spark, d, CORE)


@query(_features_sql(SHAPE))
def band_features_shape(spark, d):
    return _features(spark, d, SHAPE)


@query(_features_sql(ORDERED))
def band_features_order(spark, d):
    return _features(spark, d, ORDERED)


@query(f"""{_B}, f AS (SELECT oid, band, count(*) AS n, median(mag) AS med, {_AMP} AS amp, {ORDERED['rise_frac']} AS rise FROM x GROUP BY oid, band),
    b AS (SELECT oid, band, CASE WHEN n < 2 THEN 0e0 ELSE med END AS med, CASE WHEN n < 2 THEN 0e0 ELSE amp END AS amp, CASE WHEN n < 2 THEN 0e0 ELSE coalesce(rise, 0e0) END AS rise FROM f),
    o AS (SELECT oid, coalesce(max(med) FILTER (band = 'view'), 0e0) AS m1, coalesce(max(med) FILTER (band = 'click'), 0e0) AS m2, coalesce(max(amp) FILTER (band = 'view'), 0e0) AS a1, coalesce(max(amp) FILTER (band = 'click'), 0e0) AS a2,
          coalesce(max(rise) FILTER (band = 'view'), 0e0) AS r1, coalesce(max(rise) FILTER (band = 'click'), 0e0) AS r2 FROM b GROUP BY oid)
    SELECT oid, round(m1 - m2, 4) + 0e0 AS colour, round(CASE WHEN a2 > 0 THEN a1 / a2 ELSE 0e0 END, 4) + 0e0 AS amp_ratio, round(r1 - r2, 4) + 0e0 AS peak_offset FROM o""")
def cross_band(spark, d):
    f = ft.object_features(observations(spark, d), BANDS)
    return f.select("oid", *[digits(F.col(c), 4).alias(c) for c in ("colour", "amp_ratio", "peak_offset")])


_EVERY = CORE | SHAPE | ORDERED


def features_sql() -> str:
    """All features by object and band."""
    return _features_sql(_EVERY)


_PLAIN_FEATURES = f"{_B}, f AS (SELECT oid, band, " + ", ".join(f"CASE WHEN count(*) < 2 THEN 0e0 ELSE coalesce({e}, 0e0) END AS {n}" for n, e in _EVERY.items()) + " FROM x GROUP BY oid, band)"
_WIDE = f"{_PLAIN_FEATURES}, o AS (SELECT oid, " + ", ".join(f"coalesce(max({n}) FILTER (band = '{b}'), 0e0) AS {b}_{n}" for b in BANDS for n in _EVERY) + " FROM f GROUP BY oid)"
_BLIND = [f"{b}_{n}" for b in BANDS for n in _EVERY if n in ex.ORDER_BLIND]


@query(f"""{_WIDE} SELECT oid, {', '.join(f'round({b}_{n}, 4) + 0e0 AS {b}_{n}' for b in BANDS for n in _EVERY)}, round(view_median - click_median, 4) + 0e0 AS colour,
    round(CASE WHEN click_amplitude > 0 THEN view_amplitude / click_amplitude ELSE 0e0 END, 4) + 0e0 AS amp_ratio, round(view_rise_frac - click_rise_frac, 4) + 0e0 AS peak_offset FROM o""")
def object_feature_frame(spark, d):
    """All features of both bands and the cross-band terms, a row for each object; the invariant subset is a projection of it."""
    f = ft.object_features(observations(spark, d), BANDS)
    return f.select("oid", *[digits(F.col(c), 4).alias(c) for c in f.columns if c != "oid"])


@query(f"{_WIDE} SELECT oid, {', '.join(f'round({c}, 4) + 0e0 AS {c}' for c in _BLIND)} FROM o")
def order_blind_features(spark, d):
    """Those features that the order of a light curve's points doesn't change."""
    f = ex.order_blind(ft.object_features(observations(spark, d), BANDS), BANDS)
    return f.select("oid", *[digits(F.col(c), 4).alias(c) for c in f.columns if c != "oid"])


@query(f"""{_B} SELECT oid, band, {', '.join(f'CASE WHEN count(*) < 2 THEN 0e0 ELSE round(coalesce({({**CORE, **SHAPE, **ORDERED})[c]}, 0e0), 4) + 0e0 END AS {c}' for c in ('std', 'amplitude', 'skew', 'linear_trend', 'rise_frac'))} FROM x GROUP BY oid, band""")
def offset_invariant_features(spark, d):
    """A constant added to all magnitudes leaves these alone: computed here with 7 added."""
    f = ft.band_features(observations(spark, d).withColumn("mag", F.col("mag") + 7.0)).select("oid", "band", *ft.OFFSET_INVARIANT)
    return f.select("oid", "band", *[digits(F.col(c), 4).alias(c) for c in ("std", "amplitude", "skew", "linear_trend", "rise_frac")])


# --- ordered operators --------------------------------------------------------------------------------

_W = "WINDOW o AS (PARTITION BY oid, band ORDER BY t, tie)"


@query(f"WITH {OBS} SELECT oid, band, tie, round(t - lag(t) OVER o, 6) AS dt, round(mag - lag(mag) OVER o, 4) + 0e0 AS dm FROM obs {_W}")
def successive_differences(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy(*KEYS).orderBy(*ORDER)
    return observations(spark, d).select(*KEYS, "tie", F.round(F.col("t") - F.lag("t").over(w), 6).alias("dt"), digits(F.col("mag") - F.lag("mag").over(w), 4).alias("dm"))


@query(f"WITH {OBS} SELECT oid, band, tie, round(sum(mag) OVER (PARTITION BY oid, band ORDER BY t, tie ROWS UNBOUNDED PRECEDING), 4) AS cum FROM obs")
def cumulative_sum(spark, d):
    return pt.cumulative_sum(observations(spark, d), "mag", KEYS).select(*KEYS, "tie", F.round("cum", 4).alias("cum"))


@query(f"""WITH {OBS}, a AS (SELECT *, coalesce(5e-1 * (mag + lag(mag) OVER o) * (t - lag(t) OVER o), 0e0) AS area FROM obs {_W})
    SELECT oid, band, tie, round(sum(area) OVER (PARTITION BY oid, band ORDER BY t, tie ROWS UNBOUNDED PRECEDING), 4) + 0e0 AS integral FROM a""")
def cum_integral(spark, d):
    return pt.cumulative_integral(observations(spark, d), KEYS).select(*KEYS, "tie", digits(F.col("integral"), 4).alias("integral"))


@query(f"WITH {OBS} SELECT oid, band, tie, max(mag) OVER (PARTITION BY oid, band ORDER BY t, tie ROWS UNBOUNDED PRECEDING) AS running FROM obs")
def running_max(spark, d):
    return pt.running_max(observations(spark, d), KEYS).select(*KEYS, "tie", "running")


@query(f"""WITH RECURSIVE {OBS}, n AS (SELECT *, row_number() OVER (PARTITION BY oid, band ORDER BY t, tie) AS i FROM obs),
    r AS (SELECT oid, band, tie, t, i, mag AS y FROM n WHERE i = 1 UNION ALL SELECT n.oid, n.band, n.tie, n.t, n.i, exp((r.t - n.t) / 5e-1) * r.y + (1 - exp((r.t - n.t) / 5e-1)) * n.mag FROM r JOIN n ON n.oid = r.oid AND n.band = r.band AND n.i = r.i + 1)
    SELECT oid, band, tie, round(y, 4) + 0e0 AS ewma FROM r""")
def ewma(spark, d):
    return pt.ewma(observations(spark, d), 0.5, KEYS).select(*KEYS, "tie", digits(F.col("ewma"), 4).alias("ewma"))


@query(f"""WITH {OBS}, q AS (SELECT oid, band, tie, t, t - 25e-2 AS x FROM obs),
    a AS (SELECT q.*, o.t AS t0, o.mag AS m0 FROM q ASOF LEFT JOIN obs o ON q.oid = o.oid AND q.band = o.band AND q.x >= o.t),
    b AS (SELECT a.*, o.t AS t1, o.mag AS m1 FROM a ASOF LEFT JOIN obs o ON a.oid = o.oid AND a.band = o.band AND a.x <= o.t)
    SELECT oid, band, tie, round(CASE WHEN t0 IS NULL THEN m1 WHEN t1 IS NULL OR t1 = t0 THEN m0 ELSE m0 + (m1 - m0) * (x - t0) / (t1 - t0) END, 4) + 0e0 AS delayed FROM b""")
def delay(spark, d):
    return pt.delayed(observations(spark, d), 0.25, KEYS).select(*KEYS, "tie", digits(F.col("delayed"), 4).alias("delayed"))


@query(f"WITH {OBS} SELECT oid, band, tie, round(coalesce((row_number() OVER o - 1) / nullif(CAST(count(*) OVER (PARTITION BY oid, band) - 1 AS DOUBLE), 0), 0e0), 6) AS u FROM obs {_W}")
def unit_index(spark, d):
    return pt.unit_index(observations(spark, d), KEYS).select(*KEYS, "tie", F.round("u", 6).alias("u"))


@query(f"""WITH {OBS}, c AS (SELECT *, mag - median(mag) OVER (PARTITION BY oid, band) AS v, count(*) OVER (PARTITION BY oid, band) AS n FROM obs), s AS (SELECT * FROM c WHERE n >= 2),
    e AS (SELECT oid, band, min(t) AS lo, max(t) AS hi FROM s GROUP BY oid, band), o AS (SELECT DISTINCT oid FROM obs), bd AS (SELECT unnest(['view', 'click']) AS band), gi AS (SELECT unnest(range(64)) AS grid_i),
    g AS (SELECT o.oid, bd.band, grid_i, lo + (hi - lo) * grid_i / 63 AS x FROM o CROSS JOIN bd CROSS JOIN gi LEFT JOIN e ON e.oid = o.oid AND e.band = bd.band),
    a AS (SELECT g.*, s.t AS t0, s.v AS v0 FROM g ASOF LEFT JOIN s ON g.oid = s.oid AND g.band = s.band AND g.x >= s.t),
    b AS (SELECT a.*, s.t AS t1, s.v AS v1 FROM a ASOF LEFT JOIN s ON a.oid = s.oid AND a.band = s.band AND a.x <= s.t)
    SELECT oid, band, grid_i, round(coalesce(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (x - t0) / (t1 - t0) END, 0e0), 4) + 0e0 AS value FROM b""")
def interp_panel(spark, d):
    p = pt.interpolated_panel(observations(spark, d), BANDS)
    return p.select("oid", "band", "grid_i", digits(F.col("value"), 4).alias("value"))


@query()
def peak_swap_family(spark, d):
    """Class means of depth-3 terms over the synthetic family of swapped peaks."""
    obs = sy.peak_swap(spark, 200, 7)
    s = sg.signature(sg.steps(pt.normalise(obs.withColumn("band", F.lit("m")), ["oid", "label"]), ["oid", "label"], ORDER, ["ct", "cm"]), ["oid", "label"], ORDER, 2, 3)
    return s.groupBy("label").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("s_12", "s_21", "s_112", "s_121", "s_211")])


@query(f"""WITH p AS (SELECT oid, tie, cos(2 * pi() * tie / 2000 * CASE WHEN oid = 0 THEN 1 ELSE -1 END) AS t, sin(2 * pi() * tie / 2000 * CASE WHEN oid = 0 THEN 1 ELSE -1 END) AS mag FROM (SELECT unnest(range(0, 2001)) AS tie) CROSS JOIN (SELECT unnest([0, 1]) AS oid)),
    nm AS (SELECT CAST(oid AS BIGINT) AS oid, tie, t, mag FROM p), x AS ({signature_sql(f"WITH {steps_sql(['t', 'mag'], 'oid', 'tie')}", 2, 2, 'oid', 'tie', places=12)}) SELECT oid, round((s_12 - s_21) / 2, 4) AS area FROM x""")
def circle_area(spark, d):
    """Half of S12 - S21 over the unit circle, both ways round: pi and -pi."""
    s = sg.signature(sg.steps(sy.circle(spark), ["oid"], ["tie"], ["t", "mag"]), ["oid"], ["tie"], 2, 2)
    return s.select("oid", F.round((F.col("s_12") - F.col("s_21")) / 2, 4).alias("area"))


@query(f"WITH {OBS} SELECT oid, band, round(t, 6) AS t, mag, round(magerr, 4) AS magerr, tie, c_mktsegment AS label FROM obs JOIN customer ON c_custkey = oid")
def labelled_observations(spark, d):
    return labelled(spark, d).select("oid", "band", F.round("t", 6).alias("t"), "mag", F.round("magerr", 4).alias("magerr"), "tie", "label")


@query(f"""WITH {OBS}, c AS (SELECT oid, count(*) AS n FROM obs GROUP BY oid), e AS (SELECT n, min(n) OVER () AS lo, max(n) OVER () AS hi FROM c)
    SELECT least(CAST(floor((n - lo) * 50 / CAST(greatest(hi - lo, 1) AS DOUBLE)) AS BIGINT), 49) AS bin, count(*) AS n FROM e GROUP BY 1""")
def count_histogram(spark, d):
    """Objects by their number of observations, in 50 bins."""
    from ..operators.relational import count_histogram as histogram

    return histogram(observations(spark, d), ["oid"])
