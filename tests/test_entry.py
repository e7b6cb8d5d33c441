import pathlib
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from lakewright.plans import catalog

SMALL = pathlib.Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not SMALL.exists():
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-6 * max(1.0, abs(a), abs(b))
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_like_duckdb(spark, con, name):
    df = entry.queries()[name](spark, str(SMALL))
    got = df.toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(t):
        t = t[sorted(t.columns)].astype(object)
        t = t.where(t.notna(), None)
        return sorted(map(tuple, t.values.tolist()), key=lambda r: [(x is None, round(x, 2) if isinstance(x, float) else x if x is not None else 0) for x in r])

    a, b = rows(got), rows(want)
    assert len(a) == len(b) and all(all(map(same, x, y)) for x, y in zip(a, b, strict=True))


def test_entry(spark):
    if not SMALL.exists():
        pytest.skip("no test data")
    assert entry.entry(spark).count() == 1


def test_imports_without_the_language_model_package(tmp_path):
    root = pathlib.Path(entry.__file__).parent
    for p in ("__spark_entry__.py", "lakewright"):
        subprocess.run(["cp", "-r", str(root / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "lakewright/llm")], check=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') and k[2].isdigit() for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert said.stdout.split()[1] == "False" and int(said.stdout.split()[0]) > 50


def test_streaming(spark, tmp_path):
    if not SMALL.exists():
        pytest.skip("no test data")
    from lakewright.streaming.summaries import windowed_summary

    (tmp_path / "in").mkdir()
    subprocess.run(["cp", str(SMALL / "events.parquet"), str(tmp_path / "in")], check=True)
    schema = spark.read.parquet(str(SMALL / "events.parquet")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = windowed_summary(stream, time="ts", by=["event_type"], value="value").writeStream.outputMode("complete").format("memory").queryName("summary").start()
    q.processAllAvailable()
    q.stop()
    batch = windowed_summary(spark.read.parquet(str(SMALL / "events.parquet")), time="ts", by=["event_type"], value="value")
    assert spark.table("summary").count() == batch.count()
