import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakewright.llm import spelling


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def groups(counts: dict[str, int], times=2):
    out = {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= times * n else None
        out[w] = (form, n, len(others), counts[form] if form else None)
    for w, (form, *rest) in list(out.items()):
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w] = (form, root, *rest)
    return out


def slipped(doc_id, text):
    for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
        if h % 97 == 0:
            low = low[: h % len(low)] + low[h % len(low) + 1 :]
        if len(low) >= 5:
            yield low


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def words_of(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n int").select(F.explode(F.array_repeat("word", F.col("n"))).alias("word"), F.lit(1).alias("n"), F.lit("x").alias("form"))


def test_whole_query_by_brute_force(spark):
    rng = random.Random(0)
    stems = ["colour", "Éternel", "aaaaaa", "abababab", "straße", "ÿÀ×÷ab", "word" * 16, "w" * 64, "xyzzy"]

    def variant(w):
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice("abéÿZ") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abéÀ") + w[i + 1 :]])
        return w

    rows = [(k, rng.choice([" ", "-", "1", "日", "\n"]).join(variant(rng.choice(stems)) for _ in range(rng.randint(0, 120))), 1, "n") for k in range(400)]
    rows += [(None, "colour COLOUR coloUr", 1, "n"), (7, None, 1, "n"), (8, "", 1, "n"), (9, "12 34", 1, "n"), (9, "colour colour", 1, "n"), (9, "colour colour", 1, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word int, n string")
    got = found(spelling.spelling_groups(spelling.occurrences(df, slip_one_in=97)))
    counts = Counter(w for r in rows for w in slipped(r[0], r[1]))
    assert got == groups({w: n for w, n in counts.items() if n >= 3})
    assert any(r[0] for r in got.values()) and any(len(w) > 64 for w in got)


def test_long_words_and_the_border_between_both_ways(spark, monkeypatch):
    rng = random.Random(1)
    for limit in (5, 8):
        monkeypatch.setattr(spelling, "LONG_WORD", limit)
        counts = {"".join(rng.choices("aab", k=rng.randint(1, 11))): rng.choice([3, 4, 6, 13, 40]) for _ in range(250)}
        assert found(spelling.spelling_groups(words_of(spark, counts))) == groups(counts)
    monkeypatch.setattr(spelling, "LONG_WORD", 64)
    long = "".join(rng.choices("abcdefgh", k=20_000))
    counts = {long: 3, long[:777] + long[778:]: 7, long[:9] + "z" + long[10:]: 6, long[::-1]: 3}
    assert found(spelling.spelling_groups(words_of(spark, counts))) == groups(counts)


def test_a_pair_shares_one_key(spark):
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randint(1, 7))) for _ in range(2))
        if near(a, b):
            keys = [{w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for w in (a, b)]
            assert len(keys[0] & keys[1]) == 1
            assert len(set(spelling.deletion_hashes(a)) & set(spelling.deletion_hashes(b))) == 1


def test_chains_ties_and_words_alone(spark):
    # a chain whose roots need several rounds, two near words of the same n, and a word that nothing is near
    counts = {"a" * k: 3 * 2 ** (k - 5) for k in range(5, 17)} | {"bbbbb": 3, "bbbbc": 10, "bbbbd": 10, "zzzzz": 4}
    got = found(spelling.spelling_groups(words_of(spark, counts)))
    assert got == groups(counts)
    assert got["aaaaa"][1] == "a" * 16 and got["bbbbb"][:2] == ("bbbbc", "bbbbc") and got["zzzzz"] == (None, "zzzzz", 4, 0, None)


def test_null_empty_and_no_words(spark):
    df = spark.createDataFrame([(None,), ("",), ("",), ("",), ("a",)] + [("a",)] * 6, "word string")
    assert found(spelling.spelling_groups(df)) == groups({"": 3, "a": 7})
    assert found(spelling.spelling_groups(df.filter("false"))) == {}
    assert spelling.occurrences(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_hub_of_very_many_words(spark):
    hub = {"hubhubhub": 5000} | {"hubhubhub"[:i] + chr(c) + "hubhubhub"[i + 1 :]: 3 for i in range(9) for c in [*range(97, 123), *range(0xC0, 0x100)]}
    hub["hubhubhub"] = 5000
    got = found(spelling.spelling_groups(words_of(spark, hub)))
    assert all(r[1] == "hubhubhub" for r in got.values()) and got["hubhubhub"][3] == len(hub) - 1


@pytest.mark.parametrize("every", [None, 3])
def test_occurrences(spark, every):
    df = spark.createDataFrame([(1, "Words WORDS wörds-Éléonore abcd efgh1ijklm", "w")], "doc_id long, text string, word string")
    got = sorted(r.word for r in spelling.occurrences(df, slip_one_in=every).collect())
    if every is None:
        assert got == sorted(["words", "words", "wörds", "Éléonore", "ijklm"])
    else:
        assert len(got) <= 5 and all(len(w) >= 5 for w in got)
