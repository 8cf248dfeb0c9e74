import json

import pytest

from orrery.sources import sinks, text


def test_semicolon_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# comment\n x1;  1.5 ; ...;7\n x2;bad;GEM; 8\n")
    (tmp_path / "b.txt").write_text("x3;;PER;9\n")
    df = text.read_semicolon(spark, str(tmp_path / "*.txt"), ["id", "v", "code", "n"], ["id", "v", "code"], ["id", "code"])
    assert sorted(map(tuple, df.collect())) == [("x1", 1.5, "..."), ("x2", None, "GEM"), ("x3", None, "PER")]


def test_pipe_text(spark, tmp_path):
    (tmp_path / "p.txt").write_text(':head\n+ x\n\n"1"| "GEM" |"262.1"\n2|LONG|3\n3|ABC|\n4|XY\n')
    df = text.read_pipe(spark, str(tmp_path / "p.txt"), ["n", "code", "lon"], ["lon"])
    assert sorted(map(tuple, df.collect())) == [("1", "GEM", 262.1), ("3", "ABC", None)]


def test_landed_json(spark, tmp_path):
    rows = [{"fid": 1, "mjd": 5.0, "magpsf": 18.5, "sigmapsf": 0.1}, {"fid": 3, "mjd": 6.0, "magpsf": 17.0, "sigmapsf": 0.2}, {"fid": 2, "mjd": None, "magpsf": 1.0, "sigmapsf": 0.1}]
    (tmp_path / "obj7.json").write_text(json.dumps({"detections": rows}))
    assert sorted(map(tuple, text.read_detections(spark, str(tmp_path)).collect())) == [("obj7", 5.0, "g", 18.5, 0.1), ("obj7", 6.0, "i", 17.0, 0.2)]


def test_plates_and_cutouts(spark):
    meta = json.dumps({"catalog_exposures": [{"datetime": "1950-03-01T02:03:04Z"}], "mosaic": {}})
    rows = text.plate_epochs(spark.createDataFrame([("p", meta), ("q", "{}")], "plate_id string, meta string")).collect()
    assert rows[0].epoch.year == 1950 and rows[0].has_mosaic and rows[1].epoch is None and not rows[1].has_mosaic
    assert text.decode_cutouts(spark.createDataFrame([("p", "aGk=")], "plate_id string, body string")).first().data == b"hi"


def test_validation(spark):
    df = spark.createDataFrame([("g",), ("x",)], "band string")
    assert text.require(df, ["band"]) is df
    for columns, bands in ((["mag"], ()), (["band"], ("g",))):
        with pytest.raises(ValueError):
            text.require(df, columns, "band" if bands else None, bands)


def test_sinks_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "k int, v double")
    sinks.write_json(df, f"{tmp_path}/j")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/j").collect()) == ['{"k":1,"v":null}', '{"k":2,"v":0.5}']
    sinks.write_csv(df, f"{tmp_path}/c")
    assert text.read_csv(spark, f"{tmp_path}/c", "k int, v double").count() == 2
    sinks.write_parquet(df, f"{tmp_path}/p")
    assert text.read_parquet(spark, f"{tmp_path}/p", ["k"]).columns == ["k"]
    calls = []
    for depth in (2, 2, 3):
        sinks.cached(spark, f"{tmp_path}/cache", {"depth": depth}, lambda: calls.append(1) or df)
    assert len(calls) == 2 and sinks.todo(df, df.where("k = 1"), "k").count() == 1
