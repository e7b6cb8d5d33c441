import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lakewright.sources import streams
from lakewright.sources.streams import ControlFile, Malformed, TokenStream


def put(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.txt").write_text(text)
    return str(tmp_path)


def test_numbers_over_splits_and_files(spark, tmp_path):
    """A file of many splits and small files behind it are numbered as one."""
    lines = ["", "a b", "  ", '"x  y" c # d'] * 2000
    path = put(tmp_path, a="\n".join(lines), b="only\r\n", c="", d="\n\nlast one")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        got = streams.numbered(spark, path, comment="#").orderBy("row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    text, want, first = [*lines, "only", "", "", "last one"], [], 0
    for n, line in enumerate(text, 1):
        tokens = {"a b": ["a", "b"], '"x  y" c # d': ['"x  y"', "c"], "only": ["only"], "last one": ["last", "one"]}.get(line, [])
        if tokens:
            want.append((n, len(want), first, tokens))
            first += len(tokens)
    assert [(r.line, r.row, r.first, r.tokens) for r in got] == want


def test_token_stream(spark, tmp_path):
    path = put(tmp_path, a='V1 3\n4 2 1 "a b"\n\t2.5', b='2 "c\\"d" -1e3 0 7')
    s = TokenStream(spark, path, "V1")
    assert s.numbers(2) == [3.0, 4.0]
    assert [tuple(r) for r in s.collection("id int, name string, x double").orderBy("n").collect()] == [(0, 1, "a b", 2.5), (1, 2, 'c"d', -1000.0)]
    assert s.collection("id int").collect() == []
    with pytest.raises(Malformed, match="1 tokens are left"):
        s.finish()
    assert s.numbers(1) == [7.0]
    s.finish()


@pytest.mark.parametrize("text", ["V2 1", "", "V1 inf", "V1 x", "V1 -1", "V1 1.5", "V1 9"])
def test_bad_streams(spark, tmp_path, text):
    with pytest.raises(Malformed):
        s = TokenStream(spark, put(tmp_path, a=text), "V1")
        s.collection("a int, b int", most=8)
    if text == "V1 9":
        with pytest.raises(Malformed, match="ends in a collection"):
            TokenStream(spark, str(tmp_path), "V1").collection("a int, b int")


def test_errors_in_records_name_the_line(spark, tmp_path):
    s = TokenStream(spark, put(tmp_path, a="V1 2\n1 2.0\n\n3 nan"), "V1")
    with pytest.raises(PySparkException, match="line 4"):
        s.collection("a int, b double").collect()


def test_control_file(spark, tmp_path):
    path = put(tmp_path, a="#V3\n0 1 # flags\n\n2\n5 6 # one\n7 8\n1 2 3\n4 5 6\n-9999 0 0\n-9999 1 1\n999 # end\n")
    c = ControlFile(spark, path)
    c.expect(0, 1)
    assert [tuple(r) for r in c.counted("a int, b double").orderBy("n").collect()] == [(0, 5, 5, 6.0), (1, 6, 7, 8.0)]
    assert [tuple(r)[1:] for r in c.table("a int, b int, c int").orderBy("n").collect()] == [(7, 1, 2, 3), (8, 4, 5, 6)]
    assert c.table("a int").collect() == []
    c.finish()


@pytest.mark.parametrize(("text", "told"), [("0 2\n999", "line 1"), ("\n0 x", "line 2"), ("0 1\n3\n1 2", "block of 3"), ("0 1\n1\n1 2\n5 5\n", "no end"), ("0 1\n1\n1 2\n-9999\n998", "must end"), ("0 1\n1\n1 2\n-9999\n999\n1", "must end"), ("0 1\n-1", "line 2"), ("", "ends too early")])
def test_bad_control_files(spark, tmp_path, text, told):
    with pytest.raises(Malformed, match=told):
        c = ControlFile(spark, put(tmp_path, a=text))
        c.expect(0, 1)
        c.counted("a int, b int")
        c.table("a int")
        c.finish()


def test_bad_rows_name_the_line(spark, tmp_path):
    c = ControlFile(spark, put(tmp_path, a="2\n1 2\n# no\n3"))
    with pytest.raises(PySparkException, match="1 fields where 2 are due at line 4"):
        c.counted("a int, b int").collect()


def test_many_single_rows_and_parameters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "PEEK", 3)
    c = ControlFile(spark, put(tmp_path, a="\n".join(str(k) for k in range(10)) + "\n2\n-1 1 0.5 0 1 6 2 2\n0 1 5 0 0 0 -1 0\n999"))
    assert [c.numbers(1)[0] for _ in range(10)] == list(range(10))
    p = c.counted(streams.PARAMETER).withColumn("name", F.concat(F.lit("p"), "n"))
    c.finish()
    assert [r.name for r in streams.estimated(p).collect()] == ["p0"]
    blocks = spark.createDataFrame([(1, 1, 1, 2), (2, 1, 1990, 1994), (2, 2, 1995, 1999)], "block int, part int, first int, last int")
    assert sorted(tuple(r) for r in streams.block_parameters(p, blocks).collect()) == [("p0_block_2_1", 2, 1, 1990, 1994), ("p0_block_2_2", 2, 2, 1995, 1999)]
    with pytest.raises(PySparkException, match="no block pattern 2"):
        streams.block_parameters(p, blocks.filter("block = 1")).collect()
    out = p.select(streams.prior_nll(F.col("initial"), F.col("prior_mean"), F.col("prior_sd"), F.col("prior_type")).alias("x")).collect()
    assert [r.x for r in out] == [0.125, 0.0]
    with pytest.raises(PySparkException, match="bounds at line 12"):
        streams.estimated(p.withColumn("initial", F.lit(3.0))).collect()
