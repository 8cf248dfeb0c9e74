"""Views of the test tables as the library's inputs: observations, orbits, catalogue, patches.

Each has a DuckDB twin in SQL, from which the oracles are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS = ("view", "click")
BANDS3 = ("view", "click", "error")
MICROS = "unix_date(cast(ts as date)) * 86400000000L + hour(ts) * 3600000000L + minute(ts) * 60000000L + cast(date_part('SECOND', ts) * 1000000 as bigint)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_observations(events: DataFrame, bands: tuple[str, ...] | None = BANDS) -> DataFrame:
    """oid, band, t (days from 2024-01-01), mag, magerr, tie: a row for each observation. events may be a stream."""
    e = events.where(F.col("event_type").isin(*bands)) if bands else events
    k = F.regexp_extract("props", "[0-9]+", 0).cast("double")
    return e.select(
        F.col("user_id").alias("oid"), F.col("event_type").alias("band"), (F.expr(MICROS).cast("double") / 8.64e10 - 19723).alias("t"),
        F.col("value").alias("mag"), (0.05 + 0.01 * k).alias("magerr"), F.col("event_id").alias("tie"),
    )


def observations(spark: SparkSession, sf_dir: str, bands: tuple[str, ...] | None = BANDS) -> DataFrame:
    return as_observations(table(spark, sf_dir, "events"), bands)


def labelled(spark: SparkSession, sf_dir: str, bands: tuple[str, ...] | None = BANDS) -> DataFrame:
    """Observations with label, the market segment of the customer of the same key."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("oid"), F.col("c_mktsegment").alias("label"))
    return observations(spark, sf_dir, bands).join(c, "oid")


def orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """traj_id, iau_code, year, sol_lon and elements: nations whose key divides by 5 are tight streams, the rest are diffuse."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).withColumn("k", F.col("c_nationkey").cast("double"))
    w = F.when(F.col("c_nationkey") % 5 == 0, 1.0).otherwise(12.0)
    jitter = lambda p: (F.col("o_orderkey") * p % 1009).cast("double") / 1009.0 - 0.5
    k, day = F.col("k"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double")
    return joined.select(
        F.col("o_orderkey").alias("traj_id"),
        F.when((F.col("c_nationkey") % 5 == 0) & (F.col("c_nationkey") != 20), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).otherwise("...").alias("iau_code"),
        F.year("o_orderdate").cast("bigint").alias("year"),
        F.pmod(day * 360.0 / 365.25, F.lit(360.0)).alias("sol_lon"),
        (0.25 + 0.02 * k + 0.03 * w * jitter(7919)).alias("q"),
        F.least(F.lit(0.95), 0.5 + 0.012 * k + 0.02 * w * jitter(104729)).alias("e"),
        F.abs(5.0 + 3.0 * k + 2.0 * w * jitter(1299709)).alias("i"),
        F.pmod(53.0 * k + 2.0 * w * jitter(15485863) + 720.0, F.lit(360.0)).alias("node"),
        F.pmod(47.0 * k + 2.0 * w * jitter(32452843) + 720.0, F.lit(360.0)).alias("peri"),
    )


def radiants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """traj_id, ra, dec, vg, lam, bet, sol_lon: invented radiants of the orbits."""
    o = orbits(spark, sf_dir)
    return o.select(
        "traj_id", "iau_code", "sol_lon", F.pmod(F.col("node") + 30.0, F.lit(360.0)).alias("ra"), (F.col("i") - 40.0).alias("dec"),
        (20.0 + 40.0 * F.col("e")).alias("vg"), F.col("peri").alias("lam"), (F.col("i") * 0.5 - 20.0).alias("bet"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, list (established or working), ra, dec, vg, lo_s_max (null for some): one row for each nation."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("double")
    return n.select(
        F.col("n_name").alias("code"), F.when(F.col("n_nationkey") % 2 == 0, "established").otherwise("working").alias("list"),
        F.pmod(53.0 * k + 30.0, F.lit(360.0)).alias("ra"), (3.0 * k - 35.0).alias("dec"), (20.0 + 40.0 * (0.5 + 0.012 * k)).alias("vg"),
        F.when(F.col("n_nationkey") % 3 != 0, F.pmod(40.0 * k, F.lit(360.0))).alias("lo_s_max"),
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patch_id, field, px: the 64 components of each embedding as an image of 8 by 8 pixels."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("patch_id"), F.col("label").alias("field"), F.col("embedding").cast("array<double>").alias("px"))


# --- the same views in DuckDB ----------------------------------------------------------------------

OBS_SQL = """obs AS (
    SELECT user_id AS oid, event_type AS band, CAST(epoch_us(ts) AS DOUBLE) / 8.64e10 - 19723 AS t, value AS mag,
           5e-2 + 1e-2 * CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS magerr, event_id AS tie
    FROM events WHERE event_type IN ({bands}))"""


def obs_sql(bands: tuple[str, ...] = BANDS) -> str:
    return OBS_SQL.format(bands=", ".join(f"'{b}'" for b in bands))


def _j(p: int) -> str:
    return f"(CAST((o_orderkey * {p}) % 1009 AS DOUBLE) / 1009e0 - 5e-1)"


_W = "(CASE WHEN c_nationkey % 5 = 0 THEN 1e0 ELSE 12e0 END)"
_K = "CAST(c_nationkey AS DOUBLE)"
ORB_SQL = f"""orb AS (
    SELECT o_orderkey AS traj_id, CASE WHEN c_nationkey % 5 = 0 AND c_nationkey <> 20 THEN 'NATION_' || c_nationkey ELSE '...' END AS iau_code,
           year(o_orderdate) AS year, ((CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) * 36e1 / 365.25e0) % 36e1 + 36e1) % 36e1 AS sol_lon,
           25e-2 + 2e-2 * {_K} + 3e-2 * {_W} * {_j(7919)} AS q,
           least(95e-2, 5e-1 + 12e-3 * {_K} + 2e-2 * {_W} * {_j(104729)}) AS e,
           abs(5e0 + 3e0 * {_K} + 2e0 * {_W} * {_j(1299709)}) AS i,
           (53e0 * {_K} + 2e0 * {_W} * {_j(15485863)} + 720e0) % 36e1 AS node,
           (47e0 * {_K} + 2e0 * {_W} * {_j(32452843)} + 720e0) % 36e1 AS peri
    FROM orders JOIN customer ON o_custkey = c_custkey)"""
RAD_SQL = "rad AS (SELECT traj_id, iau_code, sol_lon, (node + 3e1) % 36e1 AS ra, i - 4e1 AS dec, 2e1 + 4e1 * e AS vg, peri AS lam, i * 5e-1 - 2e1 AS bet FROM orb)"
CAT_SQL = """cat AS (
    SELECT n_name AS code, CASE WHEN n_nationkey % 2 = 0 THEN 'established' ELSE 'working' END AS list, (53e0 * n_nationkey + 3e1) % 36e1 AS ra, 3e0 * n_nationkey - 35e0 AS dec,
           2e1 + 4e1 * (5e-1 + 12e-3 * n_nationkey) AS vg, CASE WHEN n_nationkey % 3 <> 0 THEN (4e1 * n_nationkey) % 36e1 END AS lo_s_max
    FROM nation)"""
PATCH_SQL = "patch AS (SELECT vec_id AS patch_id, label AS field, embedding::DOUBLE[] AS px FROM embeddings)"
