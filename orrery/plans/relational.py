"""Queries of the relational operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import orbits as ob
from ..functions import scalars as sc
from ..operators import relational as rel
from ..operators.quantiles import exact_quantiles
from ..sources import text as src
from ..views import BANDS, BANDS3, CAT_SQL, ORB_SQL, catalogue, labelled, obs_sql, observations, orbits, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


OBS, OBS3 = obs_sql(BANDS), obs_sql(BANDS3)
LAB = f"{OBS}, lab AS (SELECT obs.*, c_mktsegment AS label FROM obs JOIN customer ON oid = c_custkey)"


@query(f"WITH {LAB} SELECT oid, min(label) AS label, count(*) AS n_obs, round(max(t) - min(t), 3) AS t_span FROM lab GROUP BY oid")
def manifest(spark, d):
    return rel.manifest(labelled(spark, d))


@query(f"""WITH {OBS}, k AS (SELECT oid FROM obs GROUP BY oid HAVING count(*) >= 10 AND count(*) FILTER (band = 'view') >= 3 AND count(*) FILTER (band = 'click') >= 3)
    SELECT oid, band, tie FROM obs WHERE oid IN (SELECT oid FROM k)""")
def quality_cut_band(spark, d):
    return rel.quality_cut(observations(spark, d), BANDS, 10, 3).select("oid", "band", "tie")


@query(f"""WITH {OBS3}, k AS (SELECT oid, count(*) AS n, count(*) FILTER (band = 'view') AS n_view, count(*) FILTER (band = 'click') AS n_click, count(*) FILTER (band = 'error') AS n_error FROM obs GROUP BY oid)
    SELECT * FROM k WHERE n >= 30 AND n_view >= 5 AND n_click >= 5 AND n_error >= 5""")
def quality_cut_three_bands(spark, d):
    kept = rel.quality_cut(observations(spark, d, BANDS3), BANDS3, 30, 5)
    return rel.band_counts(kept, BANDS3)


@query("""WITH c AS (SELECT coalesce(l_quantity >= 5, false) AS a, coalesce(sqrt(l_discount * l_discount + l_tax * l_tax) <= 95e-3, false) AS b, coalesce(l_extendedprice <= 6e4, false) AS c, coalesce(l_linenumber <= 5, false) AS d FROM lineitem)
    SELECT CAST(1 AS BIGINT) AS step, 'quantity' AS cut, count(*) FILTER (NOT a) AS removed, count(*) FILTER (a) AS remaining FROM c UNION ALL
    SELECT 2, 'spread', count(*) FILTER (a AND NOT b), count(*) FILTER (a AND b) FROM c UNION ALL
    SELECT 3, 'price', count(*) FILTER (a AND b AND NOT c), count(*) FILTER (a AND b AND c) FROM c UNION ALL
    SELECT 4, 'line', count(*) FILTER (a AND b AND c AND NOT d), count(*) FILTER (a AND b AND c AND d) FROM c""")
def cut_waterfall(spark, d):
    c = F.col
    cuts = [("quantity", c("l_quantity") >= 5), ("spread", F.sqrt(c("l_discount") * c("l_discount") + c("l_tax") * c("l_tax")) <= 0.095), ("price", c("l_extendedprice") <= 60000), ("line", c("l_linenumber") <= 5)]
    return rel.cut_waterfall(table(spark, d, "lineitem"), cuts)


def _wide(spark, d):
    reject = F.when(F.col("l_returnflag") == "R", " True ").when(F.col("l_linestatus") == "F", "0")
    return table(spark, d, "lineitem").withColumn("reject", reject)


WIDE_BANDS = {"G": {"t": "l_quantity", "mag": "l_extendedprice", "flux": "l_tax", "snr": "l_quantity", "reject": "reject"}, "BP": {"t": "l_quantity", "mag": "l_discount", "flux": "l_extendedprice", "snr": "l_discount", "reject": "reject"}, "RP": {"t": "l_tax", "mag": "l_quantity", "flux": "l_discount", "snr": "l_tax"}}


@query("""WITH w AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'true' ELSE 'x' END AS rj FROM lineitem),
    l AS (SELECT l_suppkey, 'G' AS band, l_quantity AS t, l_quantity AS snr, rj FROM w UNION ALL SELECT l_suppkey, 'BP', l_quantity, l_discount, rj FROM w UNION ALL SELECT l_suppkey, 'RP', l_tax, l_tax, 'x' FROM w)
    SELECT l_suppkey, band, count(*) AS n, round(avg(t + 55197), 5) + 0e0 AS mjd, round(avg(1.0857362e0 / snr), 5) + 0e0 AS magerr FROM l WHERE rj <> 'true' AND snr > 0 GROUP BY l_suppkey, band""")
def unpivot_bands(spark, d):
    long = rel.to_photometry(rel.unpivot_bands(_wide(spark, d), "l_suppkey", WIDE_BANDS), "l_suppkey")
    return long.groupBy("l_suppkey", "band").agg(F.count("*").alias("n"), sc.digits(F.avg("mjd")).alias("mjd"), sc.digits(F.avg("magerr")).alias("magerr"))


@query(f"WITH {OBS} SELECT round(min(t), 5) AS lowest, round(max(t), 5) AS highest, min(t) > 0 AND max(t) < 31 AS inside FROM obs")
def range_check(spark, d):
    out = rel.within_range(observations(spark, d), "t", 0.0, 31.0)
    return out.select(F.round("lowest", 5).alias("lowest"), F.round("highest", 5).alias("highest"), "inside")


@query("""WITH e AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'),
    r AS (SELECT c_mktsegment AS label, count(*) AS n, round(avg(CASE WHEN user_id IS NULL THEN 0e0 ELSE 1e0 END), 3) AS rate FROM customer LEFT JOIN e ON c_custkey = user_id GROUP BY c_mktsegment)
    SELECT label, n, rate, round(max(rate) OVER () - min(rate) OVER (), 3) AS spread, max(rate) OVER () - min(rate) OVER () > 15e-2 AS warn FROM r""")
def attrition_rate(spark, d):
    got = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey")).distinct().withColumn("ok", F.lit(1.0))
    rate = table(spark, d, "customer").join(got, "c_custkey", "left").groupBy(F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("ok", F.lit(0.0))), 3).alias("rate"))
    spread = rate.agg((F.max("rate") - F.min("rate")).alias("s"))
    return rate.crossJoin(F.broadcast(spread)).select("label", "n", "rate", F.round("s", 3).alias("spread"), (F.col("s") > 0.15).alias("warn"))


@query(f"""WITH {LAB}, n AS (SELECT oid, label, count(*) AS n FROM lab GROUP BY oid, label)
    SELECT label, count(*) AS n_objects, median(n) AS median_n, round(quantile_cont(n, 1e-1), 5) AS p10, round(quantile_cont(n, 9e-1), 5) AS p90, round(stddev_samp(n) / avg(n), 5) AS cv, round(quantile_cont(n, 9e-1) / quantile_cont(n, 1e-1), 5) AS p90_over_p10 FROM n GROUP BY label""")
def describe_sample(spark, d):
    n = labelled(spark, d).groupBy("oid", "label").agg(F.count("*").alias("n"))
    q = lambda p: F.percentile("n", F.lit(p))
    return n.groupBy("label").agg(F.count("*").alias("n_objects"), q(0.5).alias("median_n"), F.round(q(0.1), 5).alias("p10"), F.round(q(0.9), 5).alias("p90"), F.round(F.stddev_samp("n") / F.avg("n"), 5).alias("cv"), F.round(q(0.9) / q(0.1), 5).alias("p90_over_p10"))


@query("""SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 5e-3), 6) AS q005, round(quantile_cont(l_extendedprice, 5e-1), 6) AS q500, round(quantile_cont(l_extendedprice, 995e-3), 6) AS q995
    FROM lineitem GROUP BY l_returnflag""")
def large_group_quantiles(spark, d):
    """Exact quantiles of few groups of many rows."""
    q = exact_quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.005, 0.5, 0.995])
    return q.select("l_returnflag", "n", *[F.round(f"q_{i}", 6).alias(name) for i, name in enumerate(("q005", "q500", "q995"))])


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7|' || c_custkey), c_custkey) AS rank FROM customer)
    SELECT c_custkey, c_mktsegment, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 40""")
def stratified_cap(spark, d):
    return rel.stratified_cap(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 40, 7)


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5('5|' || c_custkey), c_custkey LIMIT 100")
def sample_rows(spark, d):
    return rel.sample_rows(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 100, 5)


@query()
def sample_with_replacement(spark, d):
    return rel.sample_with_replacement(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", 500, 3)


@query(f"""WITH {OBS}, r AS (SELECT oid, band, tie, row_number() OVER (PARTITION BY oid, band ORDER BY md5('11|' || tie), tie) AS r, count(*) OVER (PARTITION BY oid, band) AS n FROM obs)
    SELECT oid, band, tie FROM r WHERE r <= greatest(6e0, round_even(n * 6e-1, 0))""")
def thin_random(spark, d):
    return rel.thin_random(observations(spark, d), 0.6, 11).select("oid", "band", "tie")


@query()
def thin_blocked(spark, d):
    return rel.thin_blocked(observations(spark, d), 0.5, 11).select("oid", "band", "tie")


@query("""WITH a AS (SELECT l_orderkey AS k, count(*) AS n_lines FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, o_orderstatus AS status FROM orders), c AS (SELECT l_orderkey AS k, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
    SELECT k, n_lines, status, quantity FROM a JOIN b USING (k) JOIN c USING (k)""")
def align_inner(spark, d):
    lines, o = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k"), table(spark, d, "orders")
    a = lines.groupBy("k").agg(F.count("*").alias("n_lines"))
    c = lines.where("l_returnflag = 'N'").groupBy("k").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return rel.align(a, o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status")), c, key="k")


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 4e5")
def inner_equi(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return table(spark, d, "orders").where("o_totalprice > 400000").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")


@query("SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON s_nationkey = n_nationkey")
def label_lookup(spark, d):
    n = table(spark, d, "nation").where("n_nationkey < 20").select("n_nationkey", "n_name")
    return table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", "n_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 45e4)")
def semi_keep(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(big, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def anti_todo(spark, d):
    seen = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(seen, "c_custkey", "left_anti")


PERIODS = """p AS (SELECT s_suppkey AS source_id, CASE WHEN s_acctbal > 5000 THEN 1e0 / (s_acctbal / 1e3) END AS period_d FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal / 1e3 END FROM supplier WHERE s_suppkey % 3 = 0),
    k AS (SELECT source_id, min(period_d) AS period_d FROM p WHERE period_d IS NOT NULL GROUP BY source_id)"""


def _periods(spark, d):
    s = table(spark, d, "supplier")
    a = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("source_id"), F.when(F.col("s_acctbal") > 5000, F.col("s_acctbal") / 1000.0).alias("freq"))
    b = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("source_id"), (F.col("s_acctbal") / 1000.0).alias("period"))
    keys = s.select(F.col("s_suppkey").alias("source_id"))
    return src.period_lookup(keys, {"frequencies": (a, "freq", True), "periods": (b, "period", False)})


@query(f"WITH {PERIODS} SELECT source_id, round(period_d, 8) AS period_d, round(log10(period_d), 6) + 0e0 AS log_period FROM k")
def period_lookup(spark, d):
    p = _periods(spark, d)
    return p.select("source_id", F.round("period_d", 8).alias("period_d"), sc.digits(F.log10("period_d"), 6).alias("log_period"))


@query(f"""WITH {PERIODS} SELECT s_nationkey AS label, count(*) AS n, round(avg(CASE WHEN period_d IS NULL THEN 0e0 ELSE 1e0 END), 5) AS rate, round(median(period_d), 6) AS median_period FROM supplier LEFT JOIN k ON s_suppkey = source_id GROUP BY s_nationkey""")
def left_period(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").alias("label")).join(_periods(spark, d), "source_id", "left")
    return s.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.col("period_d").isNotNull().cast("double")), 5).alias("rate"), F.round(F.percentile("period_d", F.lit(0.5)), 6).alias("median_period"))


@query("SELECT o_orderpriority AS label, round(count(*) FILTER (o_orderstatus = 'F') / CAST(count(*) AS DOUBLE), 6) AS share FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'F') > 0")
def retention(spark, d):
    o = table(spark, d, "orders").withColumn("label", F.col("o_orderpriority"))
    return rel.retention(o.where("o_orderstatus = 'F'"), o, "label").select("label", F.round("share", 6).alias("share"))


@query(f"WITH {ORB_SQL} SELECT iau_code, count(*) AS n FROM orb WHERE iau_code <> '...' GROUP BY 1 ORDER BY n DESC, iau_code LIMIT 15")
def topk_codes(spark, d):
    return orbits(spark, d).where("iau_code <> '...'").groupBy("iau_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "iau_code").limit(15)


@query("""WITH r AS (SELECT p_partkey, p_brand, p_type, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) SELECT p_type, p_partkey, p_brand, p_retailprice FROM r WHERE r = 1""")
def family_best(spark, d):
    return rel.first_of_each(table(spark, d, "part").select("p_type", "p_partkey", "p_brand", "p_retailprice"), "p_type", "p_retailprice", "p_partkey")


@query(f"""WITH {OBS}, g AS (SELECT log10(gap) AS x FROM (SELECT t - lag(t) OVER (PARTITION BY oid, band ORDER BY t, tie) AS gap FROM obs) WHERE gap > 0)
    SELECT CAST(CASE WHEN x < -5 THEN 0 WHEN x >= 2 THEN 61 ELSE floor((x + 5) / 7e0 * 60) + 1 END AS BIGINT) AS bin, count(*) AS n FROM g GROUP BY 1""")
def gap_histogram(spark, d):
    return rel.gap_histogram(observations(spark, d))


@query(f"WITH {OBS3} SELECT oid, count(*) FILTER (band = 'view') AS view, count(*) FILTER (band = 'click') AS click, count(*) FILTER (band = 'error') AS error FROM obs GROUP BY oid")
def pivot_counts(spark, d):
    return rel.pivot_counts(observations(spark, d, BANDS3), "oid", "band", BANDS3)


@query("SELECT c_nationkey, round(avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING'), 4) AS BUILDING, round(avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY'), 4) AS MACHINERY FROM customer GROUP BY c_nationkey")
def pivot_mean(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.round(F.avg("c_acctbal"), 4))


@query("SELECT event_type, count(DISTINCT user_id) AS n_users, count(*) AS n FROM events GROUP BY event_type")
def distinct_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"), F.count("*").alias("n"))


@query(f"""WITH {ORB_SQL}, c AS (SELECT year, iau_code, count(*) AS n FROM orb GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY year) AS total FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, iau_code) AS r FROM t WHERE iau_code <> '...')
    SELECT year, iau_code, n AS n_value, round(n / CAST(total AS DOUBLE), 6) AS share FROM r WHERE r = 1""")
def modal_code(spark, d):
    return rel.top_share(orbits(spark, d), ["year"], "iau_code", "...").select("year", "iau_code", "n_value", F.round("share", 6).alias("share"))


@query(f"""WITH {CAT_SQL} SELECT count(*) FILTER (list = 'established' AND lo_s_max IS NOT NULL) AS established, count(*) FILTER (list = 'working' AND lo_s_max IS NOT NULL) AS working, count(*) FILTER (lo_s_max IS NULL) AS undated FROM cat""")
def category_counts(spark, d):
    c, dated = catalogue(spark, d), F.col("lo_s_max").isNotNull()
    return c.agg(F.count_if((F.col("list") == "established") & dated).alias("established"), F.count_if((F.col("list") == "working") & dated).alias("working"), F.count_if(~dated).alias("undated"))


@query(f"""WITH {LAB}, n AS (SELECT label, oid, count(*) AS n FROM lab GROUP BY 1, 2), m AS (SELECT *, abs(n - median(n) OVER (PARTITION BY label)) AS gap FROM n)
    SELECT label, oid FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY gap, oid) AS r FROM m) WHERE r = 1""")
def exemplar(spark, d):
    return rel.exemplar(labelled(spark, d).groupBy("label", "oid").agg(F.count("*").alias("n")), "label", "oid", "n")


@query("SELECT l_returnflag, l_linestatus, round(sum(r), 4) AS ratio, max(hot) AS hot FROM (SELECT l_returnflag, l_linestatus, CASE WHEN l_tax <> 0 THEN l_discount / l_tax ELSE 0e0 END AS r, l_quantity > 40 AS hot FROM lineitem) GROUP BY 1, 2")
def finite_replacement(spark, d):
    r = sc.finite(F.try_divide(F.col("l_discount"), F.col("l_tax")))
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(r), 4).alias("ratio"), F.max(F.col("l_quantity") > 40).alias("hot"))


@query(f"WITH {CAT_SQL} SELECT code, round(lo_s_max, 5) AS lo_s_max FROM cat WHERE lo_s_max IS NOT NULL AND lo_s_max > 0")
def null_drop(spark, d):
    return catalogue(spark, d).dropna(subset=["lo_s_max"]).where("lo_s_max > 0").select("code", F.round("lo_s_max", 5).alias("lo_s_max"))


@query("SELECT c_custkey AS k, c_acctbal AS v, 'c' AS side FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 's' FROM supplier")
def union_all(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return c.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit("c").alias("side")).unionByName(s.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"), F.lit("s").alias("side")))


@query("SELECT user_id AS k FROM events WHERE event_type = 'purchase' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def key_intersection(spark, d):
    a = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("k"))
    return a.intersect(table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")))


@query("SELECT l_partkey AS k FROM lineitem EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25")
def key_difference(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag", "l_quantity")
    return lines.select("k").subtract(lines.where("l_returnflag = 'R' and l_quantity > 25").select("k"))


@query("""WITH g AS (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) >= 100)
    SELECT l_returnflag, l_linestatus, l_linenumber, n, row_number() OVER (ORDER BY l_returnflag, l_linestatus, l_linenumber) - 1 AS number FROM g""")
def distinct_groups(spark, d):
    from pyspark.sql import Window

    keys = ["l_returnflag", "l_linestatus", "l_linenumber"]
    g = table(spark, d, "lineitem").groupBy(*keys).agg(F.count("*").alias("n")).where("n >= 100")
    return g.withColumn("number", (F.dense_rank().over(Window.orderBy(*keys)) - 1).cast("bigint"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders")
def multi_key_sort(spark, d):
    """All orders with their place in a sort by several keys of both directions."""
    return rel.places(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", F.desc("o_totalprice"), "o_orderkey")


def _ranks(salt: str, value: str) -> str:
    return f"SELECT c_nationkey, {value}, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('9-{salt}|' || c_custkey), c_custkey) AS i FROM customer"


@query(f"""WITH r AS ({_ranks('rows', 'c_custkey')}), a AS ({_ranks('c_acctbal', 'c_acctbal')}), b AS ({_ranks('c_mktsegment', 'c_mktsegment')})
    SELECT r.c_nationkey, r.c_custkey, a.c_acctbal, b.c_mktsegment FROM r JOIN a ON r.c_nationkey = a.c_nationkey AND r.i = a.i JOIN b ON r.c_nationkey = b.c_nationkey AND r.i = b.i""")
def permute_columns(spark, d):
    return rel.permute_columns(table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal", "c_mktsegment"), "c_custkey", ["c_acctbal", "c_mktsegment"], 9, ["c_nationkey"])


@query("""SELECT o_custkey, upper(trim(o_orderpriority)) AS priority, length(o_orderpriority) AS n, CASE WHEN o_orderpriority LIKE '1-%' THEN 'urgent' WHEN o_orderpriority LIKE '2-%' THEN 'high' ELSE 'other' END AS family, o_orderstatus || '/' || lower(o_orderpriority) AS variant
    FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority <> '5-LOW'""")
def string_predicates(spark, d):
    p = F.col("o_orderpriority")
    o = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "P") & (p != "5-LOW"))
    family = F.when(p.startswith("1-"), "urgent").when(p.startswith("2-"), "high").otherwise("other")
    return o.select("o_custkey", F.upper(F.trim(p)).alias("priority"), F.length(p).cast("bigint").alias("n"), family.alias("family"), F.concat_ws("/", "o_orderstatus", F.lower(p)).alias("variant"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 4 = 1 THEN 'g' WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 4 = 2 THEN 'r' WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 4 = 3 THEN 'i' END AS band FROM events")
def json_fields(spark, d):
    e = table(spark, d, "events").withColumn("j", F.from_json("props", "k bigint"))
    return e.select("event_id", F.col("j.k").alias("k"), src.filter_band(F.col("j.k") % 4).alias("band"))


@query("SELECT DISTINCT event_type AS band FROM events WHERE event_type NOT IN ('view', 'click')")
def unknown_bands(spark, d):
    return src.require(table(spark, d, "events"), ["event_type"]).where(~F.col("event_type").isin(*BANDS)).select(F.col("event_type").alias("band")).distinct()


@query("SELECT CAST(m AS VARCHAR) AS month FROM (SELECT CAST(unnest(generate_series(DATE '2018-12-01', DATE '2020-03-01', INTERVAL 1 MONTH)) AS DATE) AS m)")
def month_range(spark, d):
    return src.months(spark, "2018-12-01", "2020-03-01").select(F.col("month").cast("string").alias("month"))


@query(f"WITH {ORB_SQL} SELECT year, string_agg(DISTINCT iau_code, ',' ORDER BY iau_code) AS codes FROM orb WHERE iau_code <> '...' GROUP BY year")
def joined_strings(spark, d):
    return orbits(spark, d).where("iau_code <> '...'").groupBy("year").agg(F.concat_ws(",", F.array_sort(F.collect_set("iau_code"))).alias("codes"))


@query(f"WITH {ORB_SQL} SELECT iau_code, round(median(q), 6) AS q, round(median(e), 6) AS e, round(median(i), 6) AS i, round(median(node), 6) AS node, round(median(peri), 6) AS peri FROM orb GROUP BY iau_code")
def median_centroids(spark, d):
    from ..operators.streams import centroids

    c = centroids(orbits(spark, d), ["iau_code"])
    return c.select("iau_code", *[F.round(x, 6).alias(x) for x in ob.ELEMENTS])
