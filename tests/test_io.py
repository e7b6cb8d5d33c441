import json

import pytest
from pyspark.sql import functions as F

from lakewright.sinks import writers
from lakewright.sources import readers


def put(path, text):
    path.write_text(text)
    return str(path)


def test_history_skips_bad_rows(spark, tmp_path):
    p = put(tmp_path / "a.csv", "year,phase,catch_mt,index,notes\n1995,history,10.5,0.2,x\n1996,history,,0.3,\n1997,projection,1,1,\nbad,history,1,1,\n1998,history,inf,1,\n1999,history\n2000, history ,3,4,z\n")
    assert sorted(map(tuple, readers.read_history(spark, p).collect())) == [(1995, 10.5, 0.2), (2000, 3.0, 4.0)]
    with pytest.raises(ValueError):
        readers.read_history(spark, put(tmp_path / "b.csv", "year,phase,catch_mt,index\n1,projection,1,1\n"))


def test_observations(spark, tmp_path):
    p = put(tmp_path / "a.csv", "year,index,catch_mt,age1,age2\n2000,2,1,1,3\n2001,2,1,0,0\n")
    rows = readers.read_observations(spark, p, 2).orderBy("year").collect()
    assert rows[0].catch_mt == 1 and rows[0].ages == [0.25, 0.75] and rows[1].ages == [0, 0]
    with pytest.raises(ValueError):
        readers.read_observations(spark, p, 3)
    with pytest.raises(Exception, match="(?i)malformed|cannot|fail"):
        readers.read_observations(spark, put(tmp_path / "b.csv", "year,catch_mt,index,age1,age2\n2000,x,1,1,3\n"), 2).collect()


SCENARIOS = "scenario,name,target,value,reference_first_year,reference_last_year\n"


def test_scenarios(spark, tmp_path):
    good = "".join(f"{k},n{k},spr,0.{k},2000,2005\n" for k in range(1, 6))
    assert readers.read_scenarios(spark, put(tmp_path / "a.csv", SCENARIOS + good)).count() == 5
    for name, bad in {"b": good.replace("n2", "n1"), "c": good.replace("0.3", "1.3"), "d": good.replace("2005", "2030"), "e": good + "6,n6,spr,0.2,2000,2001\n", "f": good.replace("0.1", "0x1")}.items():
        with pytest.raises(ValueError):
            readers.read_scenarios(spark, put(tmp_path / f"{name}.csv", SCENARIOS + bad))
    with pytest.raises(ValueError):
        readers.read_scenarios(spark, put(tmp_path / "g.csv", "x,y\n" + good))


def test_parameters(spark, tmp_path):
    known = spark.createDataFrame([("a",), ("b",)], "parameter string")
    assert readers.read_parameters(spark, put(tmp_path / "a.csv", "parameter,value\na,1\nb,2e-3\n"), known).count() == 2
    for k, body in enumerate(("a,1\n", "a,1\nb,1\na,2\n", "a,1\nb,1\nc,1\n", "a,1\nb,nan\n")):
        with pytest.raises(ValueError):
            readers.read_parameters(spark, put(tmp_path / f"b{k}.csv", "parameter,value\n" + body), known)


def test_closed_json():
    schema = {"x": float, "n": int}
    assert readers.load_closed_json('{"x": 1.5, "n": 2}', schema) == {"x": 1.5, "n": 2}
    for bad in ('{"x": 1.5}', '{"x": 1.5, "n": 2, "z": 0}', '{"x": 1.5, "x": 2.5, "n": 2}', '{"x": NaN, "n": 2}', '{"x": 1.5, "n": true}', '{"x": "1", "n": 2}'):
        with pytest.raises(ValueError):
            readers.load_closed_json(bad, schema)


def test_layout():
    doc = {"seasons": 4, "ages": 16, "fleets": [{"fleet": k, "type": 1} for k in range(1, 28)], "length_bins": list(range(51)), "catches": [{"year": 2000, "season": 1, "fleet": 3, "value": 2.0}]}
    readers.check_layout(doc)
    for key, value in (("seasons", 3), ("fleets", doc["fleets"][::-1]), ("length_bins", [1] * 51), ("catches", doc["catches"] * 2)):
        with pytest.raises(ValueError):
            readers.check_layout(doc | {key: value})


def test_sections(spark, tmp_path):
    text = "# head\nCATCH 3\r\n2000 1 5.5\n\n2001 1 6.5 # note\n-9999 0 0\nOTHER\nDERIVED_QUANTITIES\nLabel Value StdDev\nSSB 1.5 0.2\nF 2.5\n\nX 1 1\n"
    lines = readers.numbered_lines(spark, put(tmp_path / "a.txt", text))
    rows = readers.table_section(lines, F.col("value").startswith("CATCH"), fields=3).orderBy("n").collect()
    assert [r.fields for r in rows] == [["2000", "1", "5.5"], ["2001", "1", "6.5"]]
    got = readers.report_section(lines, "DERIVED_QUANTITIES").orderBy("n").collect()
    assert [dict(r.row) for r in got] == [{"Label": "SSB", "Value": "1.5", "StdDev": "0.2"}, {"Label": "F", "Value": "2.5", "StdDev": ""}]
    with pytest.raises(ValueError):
        readers.report_section(lines, "DERIVED_QUANTITIES", pad=False).collect()
    with pytest.raises(Exception, match="short row"):
        readers.table_section(lines, F.col("value").startswith("CATCH"), fields=9).collect()
    par = readers.numbered_lines(spark, put(tmp_path / "b.par", "# a\n1.5 2.5\n# b\n-3e0\n"))
    layout = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "position int, name string")
    assert {r.name: r.value for r in readers.positional_parameters(par, layout).collect()} == {"x": 1.5, "y": 2.5, "z": -3.0}


def test_small_readers(spark, tmp_path):
    assert readers.read_csv_or_empty(spark, str(tmp_path / "none.csv"), "a int, b double").count() == 0
    p = put(tmp_path / "a.csv", "a,b\n1,\nx,2\n")
    assert sorted(str(tuple(r)) for r in readers.read_csv_or_empty(spark, p, "a int, b double").collect()) == ["(1, None)", "(None, 2.0)"]
    log = spark.createDataFrame([("\tMaximum resident set size (kbytes): 1234",), ("other: 5",)], "value string")
    assert readers.resident_kb(log).collect() == [(1234,)]
    report = spark.createDataFrame([(1, "s", "k", "x", "v4"), (2, "k", "v2", "x", "y"), (3, "k", "v3", "x", "y")], "n int, c1 string, c2 string, c3 string, c4 string")
    assert readers.report_value(report, "k").first().value == "v4"
    spec = spark.createDataFrame([("spectral", "eig", "1", 2.0, "cumulative_share=0.25"), ("other", "x", "1", 1.0, "")], "section string, metric string, target string, value double, extra string")
    assert readers.spectral_rows(spec).first().cumulative_share == 0.25
    flags = readers.catch_flags(spark.createDataFrame([(-999,), (-2001,), (2002,)], "year int")).collect()
    assert [(r.initial, r.excluded) for r in flags] == [(True, False), (False, True), (False, False)]
    rows = spark.createDataFrame([("m", "p", 1, -1, 2.0)], "model_form string, phase string, n_obs int, n_random int, elapsed_ms double")
    from lakewright.operators.validation import rule_violations

    rules = readers.benchmark_rules(["n_obs"], ["m"], ["p"], )
    assert [r.rule for r in rule_violations(rows, rules, ["phase"]).collect()] == ["sizes are not negative"]
    line = spark.createDataFrame([("1,2\r",)], "v string").select(*readers.split_fields(F.col("v"), ["a", "b"])).first()
    assert tuple(line) == ("1", "2")
    with pytest.raises(Exception, match="malformed"):
        spark.createDataFrame([('1,"2"',)], "v string").select(*readers.split_fields(F.col("v"), ["a", "b"])).collect()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 150.25, float("nan")), ('q"x', 2.5, 0.5)], "s string, x double, y double")
    writers.write_csv(df, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, quote='"', escape='"').orderBy("x").collect()
    assert [r.s for r in back] == ["a,b", 'q"x']
    assert json.loads(writers.json_rows(df).first()[0]) == {"s": "a,b", "x": 150.25, "y": None}
    md = writers.markdown(df.select("s", "x"))
    assert "| s | x |" in md and "150.3" in md and "2.500" in md
    with pytest.raises(ValueError):
        writers.markdown(df, most=1)
    digest = writers.publish(spark, "hello", str(tmp_path / "f.txt"))
    assert (tmp_path / "f.txt").read_text() == "hello" and not (tmp_path / "f.txt.tmp").exists()
    assert writers.content_hashes(spark, str(tmp_path / "f.txt")).first().sha256 == digest
    with pytest.raises(ValueError):
        writers.derived_report(df, False)
    assert writers.sampler_summary(df.select("x", "y").limit(1)).count() == 2
