"""The jobs: against their SQL, over growing input, and run again."""

import glob
import json
import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import light_curve_index, stream_survey
from orrery.operators.features import band_features
from orrery.views import as_observations

from .test_plans import plain

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("job", [stream_survey, light_curve_index])
def test_query_equals_sql(spark, smoke, job):
    con = duckdb.connect()
    for t in ("orders", "customer", "nation", "events"):
        con.execute(f"create view {t} as select * from read_parquet('{smoke}/{t}.parquet')")
    ((name, query),) = job.QUERIES.items()
    result = con.execute(job.ORACLES[name])
    columns = [c[0] for c in result.description]
    df = query(spark, smoke)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert got and got == sorted(tuple(map(plain, r)) for r in result.fetchall())


def tables(spark, path):
    return sorted(map(str, spark.read.parquet(path).collect()))


def expected(spark, files):
    seen = as_observations(spark.read.parquet(*files)).where("oid is not null and not isnan(mag) and mag is not null and magerr > 0").distinct()
    return {(r.oid, r.band): (r.n_obs, r.t_span, r.cadence_median) for r in band_features(seen).where("n_obs >= 2").collect()}


def test_index_takes_only_what_is_new(spark, smoke, tmp_path, caplog):
    source, output, checkpoint = (str(tmp_path / x) for x in ("in", "out", "mark"))
    os.mkdir(source)
    events = spark.read.parquet(f"{smoke}/events.parquet")
    middle = events.agg(F.percentile("event_id", F.lit(0.6))).first()[0]
    parts = [events.where(F.col("event_id") <= middle), events.where(F.col("event_id") > middle), events.where(F.col("event_id") % 50 == 3)]
    odd = parts[1].where("event_type = 'view'").limit(2).withColumns({"value": F.lit(float("nan")), "event_id": F.lit(-1).cast("bigint")})
    files = []
    for k, part in enumerate([parts[0], parts[1].unionByName(odd), parts[2]]):
        part.coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        files.append(f"{source}/{k}.parquet")
    move = lambda k: shutil.copy(glob.glob(str(tmp_path / f"part{k}/*.parquet"))[0], files[k])

    got = lambda: {(r.oid, r.band): (r.n_obs, r.t_span, r.cadence_median) for r in spark.read.parquet(f"{output}/features").collect()}
    stamps = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{output}/**/*.parquet", recursive=True)}
    caplog.set_level("INFO")
    move(0)
    light_curve_index.run(spark, source, output, checkpoint)
    assert got() == expected(spark, files[:1])
    first = stamps()
    move(1)
    light_curve_index.run(spark, source, output, checkpoint)
    assert got() == expected(spark, files[:2])
    # the first batch's observations were not written again
    assert all(stamps().get(f) == t for f, t in first.items() if "/observations/" in f)
    n = parts[1].where("event_type in ('view', 'click')").count()
    assert f"read {n + 2} new observations in 1 batches" in caplog.text and f"cut finite removed 2, left {n}" in caplog.text
    move(2)  # rows that are there already
    light_curve_index.run(spark, source, output, checkpoint)
    assert got() == expected(spark, files[:2])
    before = stamps()
    light_curve_index.run(spark, source, output, checkpoint)
    assert stamps() == before


def test_a_repeated_batch_changes_nothing(spark, smoke, tmp_path):
    """As after a failure between a batch's writing and its commit: the last commit is taken back."""
    output, checkpoint = str(tmp_path / "out"), str(tmp_path / "mark")
    source = f"{smoke}/events.parquet"
    light_curve_index.run(spark, source, output, checkpoint)
    held = tables(spark, f"{output}/features"), tables(spark, f"{output}/observations")
    for f in glob.glob(f"{checkpoint}/commits/*") + glob.glob(f"{checkpoint}/commits/.*"):
        os.remove(f)
    light_curve_index.run(spark, source, output, checkpoint)
    assert (tables(spark, f"{output}/features"), tables(spark, f"{output}/observations")) == held


def test_only_touched_buckets_are_written(spark, smoke, tmp_path):
    source, output, checkpoint = (str(tmp_path / x) for x in ("in", "out", "mark"))
    os.mkdir(source)
    events = spark.read.parquet(f"{smoke}/events.parquet")
    one = events.agg(F.min("user_id")).first()[0]
    for k, part in enumerate([events, events.where(F.col("user_id") == one).withColumn("event_id", F.col("event_id") + 10**9)]):
        part.coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        shutil.copy(glob.glob(str(tmp_path / f"part{k}/*.parquet"))[0], f"{source}/{k}.parquet")
        light_curve_index.run(spark, source, output, checkpoint)
        if k == 0:
            stamps = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{output}/features/*/*.parquet")}
    kept = {f for f, t in stamps.items() if os.path.exists(f) and os.stat(f).st_mtime_ns == t}
    assert 0 < len({os.path.dirname(f) for f in stamps} - {os.path.dirname(f) for f in kept}) == 1


def test_survey_writes_windows_and_members(spark, smoke, tmp_path):
    paths = stream_survey.run(spark, smoke, str(tmp_path / "s"))
    groups, members = (spark.read.parquet(paths[k]).collect() for k in ("groups", "members"))
    size = {}
    for m in members:
        size[m.window_start, m.group] = size.get((m.window_start, m.group), 0) + 1
    assert groups and size == {(g.window_start, g.group): g.n_members for g in groups}
    assert os.path.isdir(f"{paths['groups']}/window_start={groups[0].window_start}")


def test_config_files_name_known_settings():
    for job in (stream_survey, light_curve_index):
        name = job.__name__.split(".")[-1]
        with open(f"{HERE}/jobs/{name}.json", encoding="utf-8") as f:
            assert json.load(f).keys() == job.DEFAULTS.keys()
        out = subprocess.run([sys.executable, f"{HERE}/jobs/{name}.py", "--help"], capture_output=True, text=True, cwd="/", timeout=60)
        assert out.returncode == 0 and "--config" in out.stdout
