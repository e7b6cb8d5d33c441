import pathlib
import random

import duckdb
import pytest

import corpus_pipeline
from lakewright.llm.queries import ORACLE_SQL, QUERIES

SMALL = pathlib.Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def small():
    if not SMALL.exists():
        pytest.skip("no test data")
    return str(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_like_duckdb(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got, want = QUERIES[name](spark, small), con.sql(ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    # values as they are, without pandas between: whole numbers with nulls stay whole
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want.select(*[f'"{c}"' for c in cols]).fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_run(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_pipeline_decisions(spark, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(70)
    rows = [(i, say(rng.randint(20, 120)), "xx", f"s{i % 2}", 1) for i in range(80)]
    near = rows[3][1].split(" ")
    near[7] = "changed"
    rows += [(200, rows[3][1], "xx", "s0", 1), (201, rows[3][1], "xx", "s0", 1)]
    rows += [(210, say(30) + " " + passage, "xx", "s1", 1), (211, passage + " " + say(30), "xx", "s1", 1)]
    rows += [(220, None, None, None, None), (221, "123 456", "xx", "s0", 7), (222, "", "xx", "s0", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    folder = str(tmp_path)
    one = corpus_pipeline.language_id(spark, docs, folder)
    assert one.columns == list(corpus_pipeline.COLUMNS)
    assert {r.doc_id for r in one.collect()} == {r[0] for r in rows} - {220, 221, 222}
    two = corpus_pipeline.near_duplicates(spark, one, folder)
    assert {r.doc_id for r in two.collect()} == {r[0] for r in rows} - {200, 201, 220, 221, 222}
    three = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, two, folder).collect()}
    assert passage in three[210].text and passage not in three[211].text and len(three[211].text.split()) == 30
    assert all(three[i].text == t for i, t, *_ in rows[:80])
    kept = spark.createDataFrame(list(three.values()), DOCS)
    four = corpus_pipeline.mix_sources(spark, kept, folder)
    assert four.columns == list(corpus_pipeline.COLUMNS) and 0 < four.count() <= 3 * len(three)
    assert {r.doc_id for r in four.collect()} <= set(three)
    final = corpus_pipeline.run(spark, folder)
    assert final.count() == four.count() and final.filter("n_tokens > 0").count() == final.count()


def test_null_and_repeated_ids_keep_their_rows(spark, tmp_path):
    rng = random.Random(6)
    say = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40))
    rows = [(i, say(), "xx", "s0", 1) for i in range(20)]
    rows += [(3, say(), "xx", "s0", 1), (3, rows[3][1], "xx", "s0", 1), (None, say(), "xx", "s0", 1), (None, say(), "xx", "s0", 1), (None, rows[5][1], "xx", "s0", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    want = sorted(map(str, rows[:21] + rows[22:24]))
    assert sorted(str(tuple(r)) for r in kept.collect()) == want
    # one source of equal sizes is taken once
    assert sorted(str(tuple(r)) for r in corpus_pipeline.mix_sources(spark, kept, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("k", range(5))
def test_stages_on_an_empty_table(spark, tmp_path, k):
    docs = spark.createDataFrame([], DOCS)
    out = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
    assert out.count() == 0
    assert k == 4 or out.columns == list(corpus_pipeline.COLUMNS)


def test_stages_with_nulls_in_other_columns(spark, tmp_path):
    """Null languages, sources and sizes: every stage keeps the rows, with their nulls."""
    rng = random.Random(7)
    say = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40))
    rows = [(i, say(), "xx" if i % 2 else None, None, None) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want = sorted(map(str, rows))
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert sorted(str(tuple(r)) for r in docs.collect()) == want
    assert corpus_pipeline.tokenize(spark, docs, str(tmp_path)).filter("n_tokens > 0").count() == 20


def test_pipeline_over_small_documents(spark, small):
    assert len(corpus_pipeline.STAGES) == 5
    out = corpus_pipeline.run(spark, small)
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None
