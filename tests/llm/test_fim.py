import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakewright.llm import fim, text

SCHEMA = "doc_id long, text string, n int, form string, x long, output string"


def frame(spark, rows):
    """Documents with other columns that have the result's names."""
    return spark.createDataFrame([(*r, 1, "f", 2, "o") for r in rows], SCHEMA)


def units_of(t: str, unit: str) -> list[int]:
    """Starts of units as places in the text."""
    if unit == "char":
        return list(range(len(t)))
    return [m.start() for m in re.finditer(r"[^ \t-\r]+" if unit == "word" else r"[^\n]*\n|[^\n]+$", t)]


def expected(doc_id, t, unit="char"):
    t = t or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    at = [*units_of(t, unit), len(t)]
    n = len(at) - 1
    at[0] = 0
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if t == "" or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, t
    p, m, s = t[: at[lo]], t[at[lo] : at[hi]], t[at[hi] :]
    if lo == n == 0:
        p, m, s = "", "", t
    if h4 % 100 < 20:
        return doc_id, n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}"


def texts(seed=0):
    rng = random.Random(seed)
    fixed = [None, "", " ", "\n", "a", "é", "😀", "<P>", "a<S>b", "x<M", "<P", "<", "<S<", "𝒳" * 50, "a b\nc " * 3000, "日本語テキスト\n" * 700, "\r\n\r\n", "no break" + "x" * 9000]
    return fixed + ["".join(rng.choice("ab é😀\n<PSM>日") for _ in range(rng.randint(1, 60))) for _ in range(300)]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_forms_by_definition_and_back(spark, unit, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "null id, twice"), (None, "null id, twice"), (3, "an id that stands twice")]
    df = fim.fill_in_middle(frame(spark, rows), unit=unit).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    got = df.collect()
    want = [expected(i, t, unit) for i, t in rows]
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, want))
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", ["char", "word", "line"])
@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_chunks_of_any_size_give_the_same_cuts(unit, size, monkeypatch):
    monkeypatch.setattr(fim, "BLOCK_BYTES", 3 * size)
    some = [t or "" for t in texts(1)[:80] if len(t or "") < 3000]
    buf, at, _ = text.texts_of(pa.array(some))
    rng = np.random.default_rng(size)
    draws = [rng.integers(0, 1 << 32, len(some)) for _ in range(2)]
    n, offsets = fim.cut_offsets(buf, at, draws, unit, size)
    for k, t in enumerate(some):
        starts = [len(t[:u].encode()) for u in units_of(t, unit)]
        assert n[k] == len(starts)
        for draw, off in zip(draws, offsets, strict=True):
            r = int(draw[k]) % (len(starts) + 1)
            assert off[k] == (0 if r == 0 else len(t.encode()) if r == len(starts) else starts[r])


def test_only_owning_chunks_are_looked_at_again(monkeypatch):
    seen = []
    plain = fim.unit_starts
    monkeypatch.setattr(fim, "unit_starts", lambda buf, lo, hi, heads, unit: seen.append(hi - lo) or plain(buf, lo, hi, heads, unit))
    buf, at, _ = text.texts_of(pa.array(["ab é " * 40_000]))
    fim.cut_offsets(buf, at, [np.array([70_001]), np.array([12_345])], "char", 1 << 12)
    assert sum(seen) <= len(buf) + 2 * (1 << 12)


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_chunks_as_rows_give_the_same(spark, unit, monkeypatch):
    monkeypatch.setattr(fim, "SPREAD_BYTES", 20)
    monkeypatch.setattr(fim, "PIECE_BYTES", 7)
    rows = [(i, t) for i, t in enumerate(texts(2)) if len(t or "") < 200] + [(None, "null id, twice, long enough"), (None, "null id, twice, long enough"), (900, " " * 40)]
    got = fim.fill_in_middle(frame(spark, rows), unit=unit).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(expected(i, t, unit)) for i, t in rows)


def test_empty_table_and_unknown_unit(spark):
    assert fim.fill_in_middle(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        fim.fill_in_middle(frame(spark, []), unit="page")
