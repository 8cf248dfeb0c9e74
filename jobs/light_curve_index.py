"""Light-curve features kept up to date from files of events as they arrive.

    python jobs/light_curve_index.py --input DIR --output DIR --checkpoint DIR [--config jobs/light_curve_index.json]

A file stream with a checkpoint takes the event files that are new, all that are there (availableNow), and ends. Each batch

1. makes observations of the events, leaves out those that aren't finite or lack a positive error, and writes the rest to
   observations, partitioned by bucket (a hash of the object) and batch;
2. reads the observations of the buckets that the batch touched, no others, computes the features of their objects anew
   and replaces these buckets of features, partitioned by bucket.

A batch replaces its own partitions only, so a batch that is repeated after a failure gives the same tables, and a run without new files
changes nothing. An observation that comes again in a later file, equal in all columns, counts once. Objects with fewer than
least_each observations in a band have no row for it.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.scalars import is_finite
from orrery.operators.features import FEATURES, band_features
from orrery.operators.relational import apply_cuts, cut_waterfall
from orrery.staging import shared_dir
from orrery.views import as_observations

log = logging.getLogger("light_curve_index")
HERE = os.path.dirname(os.path.abspath(__file__))
DEFAULTS = {"bands": ["view", "click"], "buckets": 16, "files_per_batch": 64, "least_each": 2}


def cuts() -> list:
    return [("key", F.col("oid").isNotNull()), ("finite", is_finite(F.col("t")) & is_finite(F.col("mag"))), ("error", F.col("magerr") > 0)]


def run(spark: SparkSession, source: str, output: str, checkpoint: str, settings: dict | None = None) -> dict[str, str]:
    """Bring output up to date with the event files under source; the paths of its tables."""
    s = DEFAULTS | (settings or {})
    paths = {name: f"{output.rstrip('/')}/{name}" for name in ("observations", "features")}

    def replace(df: DataFrame, name: str, by: list[str]) -> None:
        df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(paths[name])

    read = []

    def batch(events: DataFrame, number: int) -> None:
        seen = as_observations(events, tuple(s["bands"]))
        steps = sorted(cut_waterfall(seen, cuts()).collect(), key=lambda r: r.step)
        read.append(steps[0].removed + steps[0].remaining)
        for r in steps:
            log.info("batch %d: cut %s removed %d, left %d", number, r.cut, r.removed, r.remaining)
        kept = apply_cuts(seen, cuts()).withColumns({"bucket": F.pmod(F.xxhash64("oid"), F.lit(s["buckets"])).cast("int"), "batch": F.lit(number)})
        replace(kept, "observations", ["bucket", "batch"])
        own = events.sparkSession.read.parquet(paths["observations"]).where(F.col("batch") <= number)
        touched = [r.bucket for r in own.where(F.col("batch") == number).select("bucket").distinct().collect()]  # settings bound their number
        if not touched:
            return
        known = own.where(F.col("bucket").isin(touched)).drop("batch").distinct()
        features = band_features(known, ["bucket", "oid", "band"]).where(F.col("n_obs") >= s["least_each"])
        replace(features, "features", ["bucket"])
        log.info("batch %d: wrote observations and features of %d of %d buckets", number, len(touched), s["buckets"])

    schema = spark.read.parquet(source).schema
    # as a pattern that matches the path alone, so that a single file is taken as a folder is
    only = source.rstrip("/")
    only = f"{only[:-1]}[{only[-1]}]"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", s["files_per_batch"]).parquet(only)
    job = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()
    log.info("read %d new observations in %d batches of %s", sum(read), len(read), source)
    return paths


# --- the registered query ---------------------------------------------------------------------------


def job2_light_curve_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all events, brought up to date twice in one new folder; its features as they stand."""
    import uuid

    from orrery.functions.scalars import digits

    folder = f"{shared_dir(spark)}/light-curve-index-{uuid.uuid4().hex}"
    for _ in range(2):
        paths = run(spark, f"{sf_dir}/events.parquet", f"{folder}/tables", f"{folder}/checkpoint")
    return spark.read.parquet(paths["features"]).select("oid", "band", *[digits(F.col(f), 4).alias(f) for f in FEATURES])


def sql() -> str:
    from orrery.plans.series import features_sql

    return f"SELECT * FROM ({features_sql()}) WHERE n_obs >= {DEFAULTS['least_each']}"


QUERIES = {"job2_light_curve_index": job2_light_curve_index}
ORACLES = {"job2_light_curve_index": sql()}


def main() -> None:
    a = argparse.ArgumentParser(description="light-curve features kept up to date from files of events")
    a.add_argument("--input", required=True, help="folder of event files")
    a.add_argument("--output", required=True)
    a.add_argument("--checkpoint", required=True)
    a.add_argument("--config", default=os.path.join(HERE, "light_curve_index.json"))
    args = a.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(args.config, encoding="utf-8") as f:
        settings = json.load(f)
    from orrery.session import session

    spark = session()
    try:
        run(spark, args.input, args.output, args.checkpoint, settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
