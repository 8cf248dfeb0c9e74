"""Readers of the text formats: semicolon tables with comments, pipe tables, landed JSON, CSV; and validation on load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Band of each filter number in landed detections. Fixed values.
FILTER_BANDS = {1: "g", 2: "r", 3: "i"}


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header and a given schema; nothing is inferred."""
    return spark.read.csv(path, header=True, schema=schema)


def read_semicolon(spark: SparkSession, path: str | list[str], names: Sequence[str], keep: Sequence[str], text: Sequence[str] = ()) -> DataFrame:
    """Semicolon text without header, comment lines by '#'. Columns of keep; those not in text are numbers, null where they don't parse.

    path may be a glob or a list: files are read in parallel.
    """
    raw = spark.read.csv(path, sep=";", comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, schema=T.StructType([T.StructField(n, T.StringType()) for n in names]))
    number = lambda c: F.expr(f"try_cast(trim(`{c}`) as double)").alias(c)
    return raw.select(*[F.trim(F.col(c)).alias(c) if c in text else number(c) for c in keep])


def read_pipe(spark: SparkSession, path: str, names: Sequence[str], numbers: Sequence[str], key: str = "code", length: int = 3) -> DataFrame:
    """Pipe text; lines that start with ':' or '+' and blank ones are skipped, quotes stripped, short lines dropped, key of the length kept."""
    lines = spark.read.text(path).where(~F.col("value").startswith(":") & ~F.col("value").startswith("+") & (F.trim("value") != ""))
    parts = F.transform(F.split("value", r"\|"), lambda p: F.trim(F.regexp_replace(F.trim(p), '^"+|"+$', "")))
    rows = lines.select(parts.alias("p")).where(F.size("p") >= len(names))
    at = lambda i: F.element_at("p", i + 1)
    out = rows.select(*[(F.expr(f"try_cast(element_at(p, {i + 1}) as double)") if n in numbers else at(i)).alias(n) for i, n in enumerate(names)])
    return out.where(F.length(key) == length)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """(oid, mjd, band, mag, magerr) from landed JSON, a file for each object named by it, with an array detections of fid, mjd, magpsf, sigmapsf."""
    schema = "detections array<struct<fid:int,mjd:double,magpsf:double,sigmapsf:double>>"
    rows = spark.read.json(path, schema=schema, multiLine=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("oid"), F.explode("detections").alias("d"))
    return rows.select("oid", F.col("d.mjd").alias("mjd"), filter_band(F.col("d.fid")).alias("band"), F.col("d.magpsf").alias("mag"), F.col("d.sigmapsf").alias("magerr")).dropna()


def filter_band(fid: Column) -> Column:
    out = F.lit(None).cast("string")
    for number, band in FILTER_BANDS.items():
        out = F.when(fid == number, band).otherwise(out)
    return out


def decode_cutouts(files: DataFrame) -> DataFrame:
    """(plate_id, data): binary content of base64 text columns (plate_id, body); decompression is left to the image reader."""
    return files.select("plate_id", F.unbase64("body").alias("data"))


def plate_epochs(plates: DataFrame) -> DataFrame:
    """(plate_id, epoch, has_mosaic) from JSON metadata (plate_id, meta): the first catalogued exposure's time."""
    epoch = F.get_json_object("meta", "$.catalog_exposures[0].datetime")
    return plates.select("plate_id", F.try_to_timestamp(epoch).alias("epoch"), F.get_json_object("meta", "$.mosaic").isNotNull().alias("has_mosaic"))


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(month): first day of each month from first to last, dates as text."""
    return spark.sql("select explode(sequence(cast(:a as date), cast(:b as date), interval 1 month)) as month", args={"a": first, "b": last})


def require(df: DataFrame, columns: Sequence[str], band: str | None = None, bands: Sequence[str] = ()) -> DataFrame:
    """df, if it has the columns and no other bands; else a ValueError. The band check is one aggregate."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if band:
        odd = df.where(~F.col(band).isin(*bands)).select(band).distinct().limit(10).collect()
        if odd:
            raise ValueError(f"unknown bands: {sorted(str(r[0]) for r in odd)}")
    return df


def period_lookup(keys: DataFrame, tables: dict[str, tuple[DataFrame, str, bool]]) -> DataFrame:
    """(source_id, period_d): keys found in class tables {name: (frame, column, is_frequency)}; frequencies are inverted, others must be positive."""
    out = None
    for frame, column, inverse in tables.values():
        value = F.when(F.col(column) > 0, 1.0 / F.col(column) if inverse else F.col(column))
        one = frame.select("source_id", value.alias("period_d"))
        out = one if out is None else out.unionByName(one)
    return out.where("period_d is not null").groupBy("source_id").agg(F.min("period_d").alias("period_d")).join(keys.select("source_id").distinct(), "source_id", "left_semi")
