"""Writers, and a result cache keyed by a fingerprint of its inputs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import is_finite


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def json_rows(df: DataFrame) -> DataFrame:
    """(value): each row as JSON, with NaN and infinities as null."""
    safe = [F.when(is_finite(F.col(c)), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    json_rows(df).write.mode(mode).text(path)


def fingerprint(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:24]


def cached(spark: SparkSession, folder: str, settings: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of these settings under folder, built where it isn't there. A settings change is another table."""
    path = f"{folder.rstrip('/')}/{fingerprint(settings)}"
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def todo(keys: DataFrame, landed: DataFrame, key: str) -> DataFrame:
    """Keys not landed yet."""
    return keys.join(landed.select(key).distinct(), key, "left_anti")
