import random

import pytest

from lakewright.llm.substring import COVERS, cover_for, remove_repeats


def brute(docs, window):
    words = {i: (t or "").encode().split() for i, t in docs}
    least = {}
    for i in sorted(words, reverse=True):
        w = words[i]
        for a in range(len(w) - window + 1):
            least[tuple(w[a : a + window])] = i
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if least[tuple(w[a : a + window])] < i:
                gone[a : a + window] = [True] * window
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


@pytest.mark.parametrize("period", COVERS)
def test_covers_hold_every_difference(period):
    assert {(a - b) % period for a in COVERS[period] for b in COVERS[period]} == set(range(period))


@pytest.mark.parametrize("window", [1, 2, 5, 12, 50])
def test_like_brute_force(spark, window):
    rng = random.Random(window)
    passages = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(window, 2 * window + 3))] for _ in range(6)]
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "one")]
    for i in range(4, 90):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages)[rng.randint(0, 3) :] if rng.random() < 0.5 else [str(rng.randint(0, 10**6)) for _ in range(rng.randint(1, window + 9))]
        docs.append((i * 7, rng.choice([" ", "\n", " \t"]).join(w)))
    docs += [(1000 + k, docs[40][1]) for k in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(df, window=window).collect()}
    assert got == brute(docs, window)


def test_edges(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text), (5, text), (5, text), (9, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS kept_text", "doc_id AS spans")
    got = sorted((str(r.doc_id), r.n_removed) for r in remove_repeats(df).collect())
    assert got == [("5", 0), ("5", 0), ("9", 60), ("None", 60)]
    assert remove_repeats(df.limit(0)).count() == 0
    assert remove_repeats(df, keep_columns=("kept_text",)).columns[-1] == "kept_text"


def test_cover_grows_with_window():
    assert cover_for(50) == (31, COVERS[31]) and cover_for(2)[0] == 1
