"""Queries of the orbit and stream operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import orbits as ob
from ..functions import scalars as sc
from ..operators import streams as st
from ..staging import stage
from ..views import CAT_SQL, ORB_SQL, RAD_SQL, catalogue, orbits, radiants, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


R = "radians({})"


def _planes(a: str, b: str) -> str:
    return (
        f"(power(2e0 * sin((radians({b}.i) - radians({a}.i)) / 2e0), 2) + sin(radians({a}.i)) * sin(radians({b}.i)) * power(2e0 * sin((radians({b}.node) - radians({a}.node)) / 2e0), 2))"
    )


def _perihelia(a: str, b: str) -> str:
    half = f"sqrt(least(1e0, greatest(0e0, 1e0 - 25e-2 * {_planes(a, b)})))"
    arg = f"least(1e0, greatest(-1e0, CASE WHEN {half} = 0 THEN 0e0 ELSE cos((radians({a}.i) + radians({b}.i)) / 2e0) * sin((radians({b}.node) - radians({a}.node)) / 2e0) / {half} END))"
    turn = f"CASE WHEN abs(radians({b}.node) - radians({a}.node)) > pi() THEN -1e0 ELSE 1e0 END"
    return f"power(2e0 * sin((radians({b}.peri) - radians({a}.peri) + {turn} * 2e0 * asin({arg})) / 2e0), 2)"


def dsh_sql(a: str, b: str) -> str:
    return f"sqrt(greatest(0e0, power({b}.e - {a}.e, 2) + power({b}.q - {a}.q, 2) + {_planes(a, b)} + power(({a}.e + {b}.e) / 2e0, 2) * {_perihelia(a, b)}))"


def dh_sql(a: str, b: str) -> str:
    return f"sqrt(greatest(0e0, power({b}.e - {a}.e, 2) + power(({b}.q - {a}.q) / ({a}.q + {b}.q), 2) + {_planes(a, b)} + power(({a}.e + {b}.e) / 2e0, 2) * {_perihelia(a, b)}))"


def dd_sql(a: str, b: str) -> str:
    beta = lambda o: f"asin(least(1e0, greatest(-1e0, sin(radians({o}.i)) * sin(radians({o}.peri)))))"
    lam = lambda o: f"(radians({o}.node) + atan2(cos(radians({o}.i)) * sin(radians({o}.peri)), cos(radians({o}.peri))))"
    theta = f"acos(least(1e0, greatest(-1e0, sin({beta(a)}) * sin({beta(b)}) + cos({beta(a)}) * cos({beta(b)}) * cos({lam(a)} - {lam(b)}))))"
    tilt = f"(2e0 * asin(least(1e0, sqrt(greatest(0e0, {_planes(a, b)})) / 2e0)))"
    return f"sqrt(greatest(0e0, power(({b}.e - {a}.e) / ({a}.e + {b}.e), 2) + power(({b}.q - {a}.q) / ({a}.q + {b}.q), 2) + power({tilt} / pi(), 2) + power(({a}.e + {b}.e) / 2e0, 2) * power({theta} / pi(), 2)))"


DISTANCES = {"d_sh": dsh_sql, "d_h": dh_sql, "d_d": dd_sql}
#: Each orbit once for each window of 20 degrees, every 10 degrees around the circle, that holds it.
HOP = f"""{ORB_SQL}, s AS (SELECT CAST(unnest(range(0, 360, 10)) AS DOUBLE) AS window_start), w AS (SELECT window_start, orb.* FROM orb JOIN s ON (window_start + 20 <= 360 AND sol_lon >= window_start AND sol_lon < window_start + 20)
    OR (window_start + 20 > 360 AND (sol_lon >= window_start OR sol_lon < window_start + 20 - 360)))"""


def _circle(spark, d):
    return st.hop_windows(orbits(spark, d), 20.0, 10.0)


def near_sql(criterion: str, eps: str) -> str:
    """What the criterion implies of x and y within eps, without trigonometry, and a little wider against rounding."""
    gap = lambda c, ratio: f"abs(x.{c} - y.{c}) <= {eps} * {f'(x.{c} + y.{c})' if ratio else '1e0'} * 1.000000001e0 + 1e-12"
    return f"{gap('q', criterion != 'd_sh')} AND {gap('e', criterion == 'd_d')}"


def _pairs_sql(criterion: str, eps: float) -> str:
    d = DISTANCES[criterion]("x", "y")
    near = near_sql(criterion, f"{eps!r}::DOUBLE")
    return f"WITH {HOP}, n AS MATERIALIZED (SELECT x.window_start, x.traj_id AS a, y.traj_id AS b, {d} AS d FROM w x JOIN w y ON x.window_start = y.window_start AND x.traj_id < y.traj_id AND {near}) SELECT window_start, a, b, round(d, 5) + 0e0 AS d FROM n WHERE d <= {eps!r}::DOUBLE"


def _pairs(spark, d, criterion, eps):
    near = st.close_pairs(_circle(spark, d), eps, criterion, ["window_start"])
    return near.select("window_start", "a", "b", sc.digits(F.col("d")).alias("d"))


@query(_pairs_sql("d_sh", 0.08))
def dsh_pairs(spark, d):
    """Close pairs in every window of the circle."""
    return _pairs(spark, d, "d_sh", 0.08)


@query(_pairs_sql("d_d", 0.03))
def dd_pairs(spark, d):
    return _pairs(spark, d, "d_d", 0.03)


@query(_pairs_sql("d_h", 0.08))
def dh_pairs(spark, d):
    return _pairs(spark, d, "d_h", 0.08)


GEO = f"""{ORB_SQL}, {RAD_SQL}, geo AS (SELECT traj_id, vg / 29.784e0 AS u, -least(1e0, greatest(-1e0, cos(radians(bet)) * cos(radians(lam) - (radians(sol_lon) - pi() / 2)))) AS cos_theta,
    ((degrees(atan2(sin(radians(bet)), cos(radians(bet)) * sin(radians(lam) - (radians(sol_lon) - pi() / 2)))) % 36e1) + 36e1) % 36e1 AS phi, lam FROM rad)"""


def _geo(spark, d):
    r = radiants(spark, d)
    g = ob.geocentric_invariants(F.col("vg"), F.col("lam"), F.col("bet"), F.col("sol_lon"))
    return r.select("traj_id", *[v.alias(k) for k, v in g.items()])


@query(f"WITH {GEO} SELECT traj_id, round(u, 5) AS u, round(cos_theta, 5) + 0e0 AS cos_theta, round(phi, 4) AS phi, round(lam, 4) AS lam FROM geo")
def geo_invariants(spark, d):
    return _geo(spark, d).select("traj_id", F.round("u", 5).alias("u"), sc.digits(F.col("cos_theta")).alias("cos_theta"), F.round("phi", 4).alias("phi"), F.round("lam", 4).alias("lam"))


@query(f"""WITH {GEO}, p AS (SELECT x.traj_id AS a, y.traj_id AS b, radians(y.phi - x.phi) AS dp, radians(y.lam - x.lam) AS dl, y.u - x.u AS du, y.cos_theta - x.cos_theta AS dc FROM geo x JOIN geo y ON x.traj_id < y.traj_id AND abs(x.u - y.u) <= 1e-2 AND abs(x.cos_theta - y.cos_theta) <= 1e-2)
    SELECT a, b, round(d, 5) + 0e0 AS d FROM (SELECT a, b, sqrt(du * du + dc * dc + least(power(2e0 * sin(dp / 2e0), 2) + power(2e0 * sin(dl / 2e0), 2), power(2e0 * sin((dp + pi()) / 2e0), 2) + power(2e0 * sin((dl + pi()) / 2e0), 2))) AS d FROM p) WHERE d <= 1e-2""")
def dn_pairs(spark, d):
    """Close pairs of all radiants by the geocentric criterion."""
    return st.close_invariants(_geo(spark, d), 0.01).select("a", "b", sc.digits(F.col("d")).alias("d"))


@query(f"""WITH {ORB_SQL} SELECT traj_id, q <= 1.0167e0 AND q * (1 + e) / (1 - e) >= 983.3e-3 AS crosses, q <= 1.0167e0 AND q * (1 + e) / (1 - e) >= 983.3e-3 AND q > 0 AND i <= 180 AS valid, round(q * (1 + e) / (1 - e), 4) AS aphelion FROM orb""")
def earth_crossing(spark, d):
    o = ob.orbit()
    return orbits(spark, d).select("traj_id", ob.crosses_earth(o["q"], o["e"]).alias("crosses"), ob.is_valid(o).alias("valid"), F.round(ob.aphelion(o["q"], o["e"]), 4).alias("aphelion"))


@query(f"WITH {ORB_SQL} SELECT traj_id, round(q, 6) AS q, round(e, 6) AS e, round(i, 5) AS i, round(node, 5) AS node, round(peri, 5) AS peri FROM orb WHERE i <= 180")
def whiten_round_trip(spark, d):
    o = orbits(spark, d).where("i <= 180")
    w = o.select("traj_id", *[v.alias(k) for k, v in ob.whiten(ob.orbit()).items()])
    back = ob.unwhiten({c: F.col(c) for c in w.columns[1:]})
    return w.select("traj_id", *[F.round(back[c], p).alias(c) for c, p in (("q", 6), ("e", 6), ("i", 5), ("node", 5), ("peri", 5))])


def threshold_sql(source: str, criterion: str, rate: float) -> str:
    """Rows (window_start, eps) from a CTE of null orbits: the quantile over all pairs of a window of 50 orbits or more."""
    return f"""SELECT k.window_start, CASE WHEN n >= 50 THEN eps END AS eps FROM (SELECT window_start, count(*) AS n FROM {source} GROUP BY 1) k LEFT JOIN
        (SELECT x.window_start, quantile_cont({DISTANCES[criterion]('x', 'y')}, {rate!r}::DOUBLE) AS eps FROM {source} x JOIN {source} y ON x.window_start = y.window_start AND x.traj_id < y.traj_id GROUP BY 1) q ON k.window_start = q.window_start"""


@query(f"WITH {HOP}, n AS (SELECT * FROM w WHERE iau_code = '...') SELECT window_start, round(eps, 5) AS eps FROM ({threshold_sql('n', 'd_sh', 0.005)})")
def threshold_quantile(spark, d):
    """Over all pairs of each window's sporadic orbits."""
    null = _circle(spark, d).where("iau_code = '...'")
    return st.threshold(null, 0.005, "d_sh", ["window_start"]).select("window_start", F.round("eps", 5).alias("eps"))


@query(f"""WITH {ORB_SQL}, s AS (SELECT CAST(unnest(range(0, 360, 10)) AS DOUBLE) AS s), h AS (SELECT s, traj_id FROM orb JOIN s ON (s + 20 <= 360 AND sol_lon >= s AND sol_lon < s + 20) OR (s + 20 > 360 AND (sol_lon >= s OR sol_lon < s + 20 - 360)))
    SELECT s AS window_start, count(*) AS n, min(traj_id) AS first_id FROM h GROUP BY s""")
def hop_windows(spark, d):
    h = st.hop_windows(orbits(spark, d), 20.0, 10.0)
    return h.groupBy("window_start").agg(F.count("*").alias("n"), F.min("traj_id").alias("first_id"))


CENTRES = [5.0, 110.0, 200.0, 355.0]


def _centres(spark):
    return spark.createDataFrame([(c,) for c in CENTRES], "centre double")


_BAND = lambda lo: f"(((sol_lon - centre - ({lo})) % 36e1) + 36e1) % 36e1 < 10"
SIDE = f"""{ORB_SQL}, c AS (SELECT unnest([5e0, 11e1, 2e2, 355e0]) AS centre), side AS (SELECT centre, traj_id, q, e, i, (node + (((centre - sol_lon) % 36e1) + 36e1) % 36e1) % 36e1 AS node, peri, sol_lon FROM orb CROSS JOIN c WHERE {_BAND(-18)} OR {_BAND(8)})"""


@query(f"WITH {SIDE} SELECT centre, traj_id, round(node, 4) AS node FROM side")
def sideband_pool(spark, d):
    return st.sideband_pool(orbits(spark, d), _centres(spark)).select("centre", "traj_id", F.round("node", 4).alias("node"))


@query(f"WITH {SIDE}, r AS (SELECT centre, traj_id, row_number() OVER (PARTITION BY centre ORDER BY md5('3|' || traj_id), traj_id) AS r FROM side) SELECT centre, traj_id FROM r WHERE r <= 200")
def sideband_null(spark, d):
    return st.sideband_null(orbits(spark, d), _centres(spark), 200, 3).select("centre", "traj_id")


def _mixed_sql(source: str, seed: int, by: str) -> str:
    """CTE mix: the elements of source, each in a hash order of its own within a window, where they make a valid orbit."""
    rank = lambda salt, v: f"(SELECT {by}, {v}, row_number() OVER (PARTITION BY {by} ORDER BY md5('{seed}-{salt}|' || traj_id), traj_id) AS rk FROM {source})"
    joins = " ".join(f"JOIN {rank(c, c)} {c}_ ON {c}_.{by} = r.{by} AND {c}_.rk = r.rk" for c in ob.ELEMENTS)
    valid = "q <= 1.0167e0 AND CASE WHEN e < 1 THEN q * (1 + e) / greatest(1 - e, 1e-12) ELSE 1e300 END >= 983.3e-3 AND q > 0 AND e >= 0 AND e < 12e-1 AND i >= 0 AND i <= 180"
    return f"mix AS (SELECT * FROM (SELECT r.{by}, r.traj_id, {', '.join(f'{c}_.{c} AS {c}' for c in ob.ELEMENTS)} FROM {rank('rows', 'traj_id')} r {joins}) WHERE {valid})"


@query(f"WITH {HOP}, {_mixed_sql('w', 5, 'window_start')} SELECT * FROM mix")
def permutation_null(spark, d):
    return st.permutation_null(_circle(spark, d), 5, ["window_start"]).select("window_start", "traj_id", *ob.ELEMENTS)


@query()
def kde_null(spark, d):
    return st.kde_null(_circle(spark, d), 2000, 5, by=["window_start"])


STREAM_CENTRE = "ctr AS (SELECT iau_code AS centre_id, median(q) AS q, median(e) AS e, median(i) AS i, median(node) AS node, median(peri) AS peri FROM orb WHERE iau_code <> '...' GROUP BY 1)"


def _stream_centres(spark, d):
    o = orbits(spark, d).where("iau_code <> '...'")
    return st.centroids(o, ["iau_code"]).withColumnRenamed("iau_code", "centre_id")


@query(f"""WITH {ORB_SQL}, {STREAM_CENTRE}, nul AS (SELECT * FROM orb WHERE iau_code = '...'), a AS (SELECT centre_id, count(*) FILTER (d <= 1e-1) AS n, count(*) AS t FROM (SELECT centre_id, {dsh_sql('w', 'c')} AS d FROM orb w CROSS JOIN ctr c) GROUP BY 1),
    b AS (SELECT centre_id, count(*) FILTER (d <= 1e-1) AS m, count(*) AS t FROM (SELECT centre_id, {dsh_sql('w', 'c')} AS d FROM nul w CROSS JOIN ctr c) GROUP BY 1)
    SELECT a.centre_id, n AS n_obs, round(m / CAST(b.t AS DOUBLE) * a.t, 4) AS n_exp, round(m / CAST(b.t AS DOUBLE) * a.t / greatest(n, 1), 5) AS ratio FROM a JOIN b ON a.centre_id = b.centre_id""")
def null_ratio(spark, d):
    o = orbits(spark, d)
    r = st.null_ratio(o, o.where("iau_code = '...'"), _stream_centres(spark, d), 0.10)
    return r.select("centre_id", "n_obs", F.round("n_exp", 4).alias("n_exp"), F.round("ratio", 5).alias("ratio"))


YEARS = f"""{ORB_SQL}, {STREAM_CENTRE}, sh AS (SELECT centre_id, count(*) FILTER (d <= 12e-2) / CAST(count(*) AS DOUBLE) AS share FROM (SELECT centre_id, {dsh_sql('w', 'c')} AS d FROM orb w CROSS JOIN ctr c WHERE w.iau_code = '...') GROUP BY 1),
    yr AS (SELECT centre_id, year, count(*) AS n_year, count(*) FILTER (d <= 12e-2) AS n_obs FROM (SELECT centre_id, w.year, {dsh_sql('w', 'c')} AS d FROM orb w CROSS JOIN ctr c) GROUP BY 1, 2),
    py AS (SELECT centre_id, year, n_year, n_obs, share * n_year AS n_exp, (n_obs - share * n_year) / sqrt(greatest(share * n_year, 1e0)) AS z FROM yr JOIN sh USING (centre_id))"""


def _per_year(spark, d):
    o = orbits(spark, d)
    return st.year_excess(o, o.where("iau_code = '...'"), _stream_centres(spark, d), 0.12)


@query(f"WITH {YEARS} SELECT centre_id, year, n_year, n_obs, round(n_exp, 4) AS n_exp, round(z, 4) + 0e0 AS z FROM py")
def year_excess(spark, d):
    return _per_year(spark, d).select("centre_id", "year", "n_year", "n_obs", F.round("n_exp", 4).alias("n_exp"), sc.digits(F.col("z"), 4).alias("z"))


@query(f"""WITH {YEARS} SELECT centre_id, count(*) FILTER (z >= 2) AS years_z, count(*) FILTER (n_obs >= 2) AS years_present, round(max(n_obs) / CAST(greatest(sum(n_obs), 1) AS DOUBLE), 5) AS top_share, round(median(z), 4) + 0e0 AS median_z, coalesce(string_agg(year, ',' ORDER BY year) FILTER (z >= 2), '') AS years FROM py GROUP BY 1""")
def recurrence(spark, d):
    r = st.recurrence(_per_year(spark, d))
    return r.select("centre_id", "years_z", "years_present", F.round("top_share", 5).alias("top_share"), sc.digits(F.col("median_z"), 4).alias("median_z"), "years")


_SEP = "degrees(acos(least(1e0, greatest(-1e0, sin(radians(r.dec)) * sin(radians(c.dec)) + cos(radians(r.dec)) * cos(radians(c.dec)) * cos(radians(r.ra - c.ra))))))"
MATCH = f"""{ORB_SQL}, {RAD_SQL}, {CAT_SQL}, m AS (SELECT r.traj_id, r.iau_code, c.list, c.code, {_SEP} AS sep FROM rad r JOIN cat c ON abs(r.vg - c.vg) <= 15e-2 * greatest(r.vg, 1e-6)
    AND (c.lo_s_max IS NULL OR abs((((r.sol_lon - c.lo_s_max + 180) % 36e1) + 36e1) % 36e1 - 180) <= 12)), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY traj_id, list ORDER BY sep, code) AS k FROM m WHERE sep <= 8) WHERE k = 1)"""


@query(f"WITH {MATCH} SELECT traj_id, list, code, round(sep, 4) AS sep FROM best")
def catalogue_match(spark, d):
    return st.match_catalogue(radiants(spark, d), catalogue(spark, d)).select("traj_id", "list", "code", F.round("sep", 4).alias("sep"))


@query(f"WITH {MATCH} SELECT iau_code, count(*) AS n FROM rad WHERE traj_id NOT IN (SELECT traj_id FROM best) GROUP BY 1")
def catalogue_recheck(spark, d):
    r = radiants(spark, d)
    return st.unmatched(r, st.match_catalogue(r, catalogue(spark, d))).groupBy("iau_code").agg(F.count("*").alias("n"))


@query(f"""WITH {MATCH}, k AS (SELECT rad.traj_id, iau_code <> '...' AS known, traj_id IN (SELECT traj_id FROM best) AS hit FROM rad)
    SELECT known, count(*) AS n, round(avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END), 5) AS rate, avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END) < 15e-2 AS warn FROM k GROUP BY known""")
def control_rates(spark, d):
    r = radiants(spark, d)
    hit = st.match_catalogue(r, catalogue(spark, d)).select("traj_id").distinct().withColumn("hit", F.lit(1.0))
    told = r.join(hit, "traj_id", "left").groupBy((F.col("iau_code") != "...").alias("known"))
    rate = F.avg(F.coalesce("hit", F.lit(0.0)))
    return told.agg(F.count("*").alias("n"), F.round(rate, 5).alias("rate"), (rate < 0.15).alias("warn"))


_SOURCES = " UNION ALL ".join(f"SELECT {i} AS place, '{n}' AS source, {lon}::DOUBLE AS sl, {lat}::DOUBLE AS sb" for i, (n, (lon, lat)) in enumerate(sc.SPORADIC_SOURCES.items()))


@query(f"""WITH {ORB_SQL}, {RAD_SQL}, src AS ({_SOURCES}), x AS (SELECT traj_id, source, place, sqrt(power(abs((((lam - sol_lon - sl + 180) % 36e1) + 36e1) % 36e1 - 180) * cos(radians((bet + sb) / 2)), 2) + power(bet - sb, 2)) AS dist FROM rad CROSS JOIN src)
    SELECT traj_id, source, round(dist, 4) AS distance, dist <= 25 AS on_source FROM (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY dist, place) AS k FROM x) WHERE k = 1""")
def source_distance(spark, d):
    r = radiants(spark, d).withColumn("s", sc.nearest_source(F.col("lam") - F.col("sol_lon"), F.col("bet")))
    return r.select("traj_id", F.col("s.source").alias("source"), F.round("s.distance", 4).alias("distance"), (F.col("s.distance") <= 25).alias("on_source"))


EPS = {"d_sh": 0.06, "d_d": 0.025, "d_h": 0.06}
LEAST = 8


def dbscan_sql(criterion: str, tag: str, eps: str | None = None) -> str:
    """Clusters l{tag} of w. eps: SQL of the threshold, by columns of x; a constant where none is given."""
    eps = eps or f"{EPS[criterion]!r}::DOUBLE"
    return f"""p{tag} AS MATERIALIZED (SELECT x.window_start AS ws, x.traj_id AS a, y.traj_id AS b FROM w x JOIN w y ON x.window_start = y.window_start AND x.traj_id <> y.traj_id AND {near_sql(criterion, eps)} AND {DISTANCES[criterion]('x', 'y')} <= {eps}),
    k{tag} AS (SELECT ws, a AS id FROM p{tag} GROUP BY ws, a HAVING count(*) + 1 >= {LEAST}), e{tag} AS (SELECT ws, a, b FROM p{tag} WHERE (ws, a) IN (SELECT (ws, id) FROM k{tag}) AND (ws, b) IN (SELECT (ws, id) FROM k{tag})),
    r{tag}(ws, x, y) AS (SELECT ws, id, id FROM k{tag} UNION SELECT r.ws, r.x, e.b FROM r{tag} r JOIN e{tag} e ON r.ws = e.ws AND r.y = e.a), c{tag} AS (SELECT ws, x AS id, min(y) AS cluster FROM r{tag} GROUP BY ws, x),
    b{tag} AS (SELECT p.ws, p.a AS id, min(cluster) AS cluster FROM p{tag} p JOIN c{tag} c ON p.ws = c.ws AND p.b = c.id GROUP BY p.ws, p.a),
    l{tag} AS (SELECT w.window_start, traj_id, c.id IS NOT NULL AS core, coalesce(c.cluster, b.cluster) AS cluster FROM w LEFT JOIN c{tag} c ON c.ws = w.window_start AND c.id = traj_id LEFT JOIN b{tag} b ON b.ws = w.window_start AND b.id = traj_id)"""


@query(f"""WITH RECURSIVE {HOP}, {dbscan_sql('d_sh', '1')} SELECT * FROM l1""")
def dbscan(spark, d):
    return st.dbscan(_circle(spark, d), EPS["d_sh"], LEAST, by=["window_start"])


CONSENSUS_SQL = f"""t AS (SELECT l0.window_start, l0.traj_id, l0.cluster AS a, l1.cluster AS b, l2.cluster AS c FROM l0 JOIN l1 ON l0.window_start = l1.window_start AND l0.traj_id = l1.traj_id JOIN l2 ON l0.window_start = l2.window_start AND l0.traj_id = l2.traj_id
        WHERE l0.cluster IS NOT NULL AND l1.cluster IS NOT NULL AND l2.cluster IS NOT NULL),
    g AS (SELECT window_start, a, b, c, row_number() OVER (PARTITION BY window_start ORDER BY a, b, c) - 1 AS "group" FROM t GROUP BY window_start, a, b, c HAVING count(*) >= {LEAST})"""


@query(f"""WITH RECURSIVE {HOP}, {', '.join(dbscan_sql(c, str(i)) for i, c in enumerate(EPS))},
    {CONSENSUS_SQL}
    SELECT t.window_start, traj_id, "group" FROM t JOIN g ON t.window_start = g.window_start AND t.a = g.a AND t.b = g.b AND t.c = g.c""")
def consensus(spark, d):
    return st.consensus(_circle(spark, d), EPS, LEAST, ["window_start"])


DENSITY = f"""WITH {HOP}, wn AS (SELECT window_start AS win, iau_code, q, e, i, node, peri FROM w), g AS (SELECT iau_code AS grp, win, q, e, i, node, peri FROM wn WHERE iau_code <> '...'), nl AS (SELECT * FROM wn WHERE iau_code = '...'),
    c AS (SELECT grp, win, median(q) AS q, median(e) AS e, median(i) AS i, median(node) AS node, median(peri) AS peri FROM g GROUP BY 1, 2),
    r AS (SELECT c.grp, c.win, quantile_cont({dsh_sql('g', 'c')}, 8e-1) AS r FROM g JOIN c ON g.grp = c.grp AND g.win = c.win GROUP BY 1, 2),
    o AS (SELECT c.grp, c.win, count(*) FILTER ({dsh_sql('w', 'c')} <= r.r) AS n_obs, count(*) AS n_window FROM wn w JOIN c ON w.win = c.win JOIN r ON r.grp = c.grp AND r.win = c.win GROUP BY 1, 2),
    l AS (SELECT c.grp, c.win, count(*) FILTER ({dsh_sql('w', 'c')} <= r.r) / CAST(count(*) AS DOUBLE) AS f FROM nl w JOIN c ON w.win = c.win JOIN r ON r.grp = c.grp AND r.win = c.win GROUP BY 1, 2)
    SELECT grp, win, round(r, 5) AS radius, n_obs, round(f * n_window, 2) AS n_exp, round((n_obs - f * n_window) / sqrt(greatest(f * n_window, 1e0)), 2) + 0e0 AS z FROM r JOIN o USING (grp, win) JOIN l USING (grp, win)"""


def _excess(spark, d):
    o = _circle(spark, d).withColumnRenamed("window_start", "win")
    x = st.density_excess(o.where("iau_code <> '...'").withColumnRenamed("iau_code", "grp"), o, o.where("iau_code = '...'"), "grp", "win")
    return x.select("grp", "win", "radius", "n_obs", "n_exp", (F.col("z") + 0.0).alias("z"))


@query(DENSITY)
def density_excess(spark, d):
    """Excess of each code's orbits in every window of the circle."""
    return _excess(spark, d)


@query(f"SELECT * FROM ({DENSITY}) WHERE z >= 2 AND radius <= 15e-2 AND radius > 0")
def significant_groups(spark, d):
    """Groups of a clear excess in a ball that isn't large."""
    return st.significant(_excess(spark, d), 2.0, 0.15)


# --- comparison of nulls --------------------------------------------------------------------------------

#: Windows that tile the circle; centres of their sidebands.
TILES = [20.0 * k for k in range(18)]
_HIT = lambda frame, n, t: f"SELECT x.window_start, x.centre_id, count(*) FILTER ({dsh_sql('w', 'x')} <= 1e-1) AS {n}, count(*) AS {t} FROM {frame} w JOIN cen x ON w.window_start = x.window_start GROUP BY 1, 2"
COMPARED = f"""{ORB_SQL}, w AS (SELECT floor(sol_lon / 2e1) * 2e1 AS window_start, * FROM orb),
    cd AS (SELECT window_start, iau_code, count(*) AS n FROM w WHERE iau_code <> '...' GROUP BY 1, 2 HAVING count(*) >= 30), tp AS (SELECT window_start, arg_min(iau_code, (-n, iau_code)) AS code FROM cd GROUP BY 1),
    sp AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY md5('6|' || traj_id), traj_id) AS r FROM w WHERE iau_code = '...'),
    cen AS (SELECT w.window_start, 'stream' AS centre_id, median(q) AS q, median(e) AS e, median(i) AS i, median(node) AS node, median(peri) AS peri FROM w JOIN tp ON w.window_start = tp.window_start AND iau_code = code GROUP BY 1
        UNION ALL SELECT window_start, CAST(traj_id AS VARCHAR), q, e, i, node, peri FROM sp WHERE r <= 25),
    {_mixed_sql('w', 5, 'window_start')}, c AS (SELECT CAST(unnest(range(10, 370, 20)) AS DOUBLE) AS centre), side AS (SELECT centre - 10 AS window_start, traj_id, q, e, i, (node + (((centre - sol_lon) % 36e1) + 36e1) % 36e1) % 36e1 AS node, peri FROM orb CROSS JOIN c WHERE {_BAND(-18)} OR {_BAND(8)}),
    sn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY md5('5|' || traj_id), traj_id) AS r FROM side) WHERE r <= 2500),
    ob AS ({_HIT('w', 'n_obs', 't_obs')}), n1 AS ({_HIT('mix', 'm', 't')}), n2 AS ({_HIT('sn', 'm', 't')}), nn AS (SELECT 'permutation' AS "null", * FROM n1 UNION ALL SELECT 'sideband', * FROM n2),
    ra AS (SELECT nn."null", ob.window_start, ob.centre_id, n_obs, m / CAST(t AS DOUBLE) * t_obs / greatest(n_obs, 1) AS ratio FROM ob JOIN nn ON ob.window_start = nn.window_start AND ob.centre_id = nn.centre_id),
    cmp AS (SELECT window_start, "null", median(ratio) FILTER (centre_id <> 'stream' AND n_obs >= 5) AS sporadic_ratio, count(*) FILTER (centre_id <> 'stream' AND n_obs >= 5) AS n_regions, max(ratio) FILTER (centre_id = 'stream') AS stream_ratio FROM ra GROUP BY 1, 2)"""


def _compared(spark, d, kde=False):
    # every part of the comparison reads the orbits
    o = stage(orbits(spark, d).select("traj_id", "iau_code", "sol_lon", *ob.ELEMENTS), "orbits")
    w = o.withColumn("window_start", F.floor(F.col("sol_lon") / 20) * 20.0)
    middles = spark.createDataFrame([(c + 10,) for c in TILES], "centre double")
    side = st.sideband_null(o, middles, 2500, 5).withColumn("window_start", F.col("centre") - 10.0)
    nulls = {"kde": st.kde_null(w, 2500, 5, by=["window_start"])} if kde else {"permutation": st.permutation_null(w, 5, ["window_start"]), "sideband": side}
    return st.compare_nulls(w, nulls, st.window_centres(w, ["window_start"], seed=6), 0.10, ["window_start"])


@query(f'WITH {COMPARED} SELECT window_start, "null", round(sporadic_ratio, 3) AS sporadic_ratio, n_regions, round(stream_ratio, 3) AS stream_ratio FROM cmp')
def null_comparison(spark, d):
    """What permuted and sideband nulls expect over what is there, at streams and at sporadic places of each window."""
    c = _compared(spark, d)
    return c.select("window_start", "null", F.round("sporadic_ratio", 3).alias("sporadic_ratio"), "n_regions", F.round("stream_ratio", 3).alias("stream_ratio"))


@query(f'WITH {COMPARED}, md AS (SELECT "null", median(sporadic_ratio) AS a, median(stream_ratio) AS b FROM cmp GROUP BY 1) SELECT "null", round(a, 3) AS sporadic_ratio, round(b, 3) AS stream_ratio, round(CASE WHEN b > 0 THEN a / b END, 2) AS separation FROM md')
def null_separation(spark, d):
    s = st.null_separation(_compared(spark, d))
    return s.select("null", F.round("sporadic_ratio", 3).alias("sporadic_ratio"), F.round("stream_ratio", 3).alias("stream_ratio"), F.round("separation", 2).alias("separation"))


@query()
def null_comparison_kde(spark, d):
    return _compared(spark, d, kde=True)


@query("SELECT o_orderkey, CAST(floor((CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) + 2440587.5e0 - 2451545e0) / 365.25e0 + 2e3) AS BIGINT) AS year FROM orders")
def calendar_year(spark, d):
    """Year of a Julian date."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("double") + 2440587.5
    return table(spark, d, "orders").select("o_orderkey", sc.calendar_year(day).alias("year"))


#: Orders as groups, with the (part, supplier) pairs of their lines as members.
MERGE = """grp AS (SELECT l_orderkey AS g, CAST(count(*) AS DOUBLE) AS z, min(l_linenumber) AS ws, max(l_linenumber) AS we FROM lineitem GROUP BY 1), mem AS (SELECT DISTINCT l_orderkey AS g, l_partkey * 100000 + l_suppkey AS t FROM lineitem)"""


@query(f"""WITH RECURSIVE {MERGE}, e AS (SELECT DISTINCT x.g AS a, y.g AS b FROM mem x JOIN mem y ON x.t = y.t), r(x, y) AS (SELECT g, g FROM grp UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a), c AS (SELECT x AS g, min(y) AS structure FROM r GROUP BY x)
    , n AS (SELECT structure, count(DISTINCT t) AS n_members FROM mem JOIN c ON mem.g = c.g GROUP BY 1)
    SELECT structure, arg_min(grp.g, (-z, grp.g)) AS best, max(z) AS z, count(*) AS n_windows, any_value(n_members) AS n_members, min(ws) AS first_start, max(we) AS last_end FROM grp JOIN c ON grp.g = c.g JOIN n USING (structure) GROUP BY structure""")
def merge_groups(spark, d):
    lines = table(spark, d, "lineitem")
    groups = lines.groupBy(F.col("l_orderkey").alias("group")).agg(F.count("*").cast("double").alias("z"), F.min("l_linenumber").alias("window_start"), F.max("l_linenumber").alias("window_end"))
    members = lines.select(F.col("l_orderkey").alias("group"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("traj_id")).distinct()
    return st.merge_overlapping(groups, members)
