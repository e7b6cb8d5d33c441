"""Spelling variants by a symmetric-delete join.

Every word emits itself and its distinct single deletions as keys. Two words at distance one share
exactly one key (their common longest subsequence, or the shorter word itself), so an equi-join of keys
gives each near pair once; the exact distance is verified in the join. A key holds no more words than
there are ways to put one letter in it, whatever the corpus. Near words are aggregated to a word's form,
and roots come from forms by pointer doubling: a form occurs at least twice as often as its word, so
chains are short and have no loops.

A word of L characters has L deletions of L - 1 characters. Words above ``LONG_WORD`` characters emit
64-bit hashes of theirs instead, all from one running sum; found pairs are verified by their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.session import cut, join_counted, release
from lakewright.llm.text import mix64, powers

#: Characters up to which deletions are emitted as strings.
LONG_WORD = 64
#: Letters of words.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = 0x9E3779B97F4A7C15


def lowered(run: Column) -> Column:
    """A to Z in lower case, other letters unchanged."""
    return F.when(run.rlike("[A-Z]"), F.translate(run, UPPER, LOWER)).otherwise(run)


def without(word: Column, at: Column) -> Column:
    """``word`` without its character at a place from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def occurrences(docs: DataFrame, *, slip_one_in: int | None = None, least_length: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word): a row for each run of letters of at least ``least_length``, A to Z in lower case.

    With ``slip_one_in`` a run whose crc32 together with its document's id is divisible by it loses one
    character, as a slip of the pen would have it.
    """
    text = F.col(text_col).cast("string")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    low = runs.select("id", lowered(F.col("run")).alias("run"))
    if slip_one_in is None:
        return low.select(F.col("run").alias("word"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    slipped = low.withColumn("h", h).select(F.when(F.col("h") % slip_one_in == 0, without(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run")).alias("word"))
    return slipped.filter(F.length("word") >= least_length)


def word_counts(words: DataFrame, least: int = 3) -> DataFrame:
    """(word, n) of words that occur at least ``least`` times; null words are none."""
    return words.filter("word is not null").groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _keys(words: DataFrame) -> DataFrame:
    """(key, word, n): each word under itself and under its distinct single deletions."""
    w = F.col("word")
    deletions = F.transform(F.sequence(F.lit(0), F.length(w) - 1), lambda i: without(w, i))
    keys = F.when(F.length(w) > 0, F.array_distinct(F.concat(F.array(w), deletions))).otherwise(F.array(w))
    return words.select(F.explode(keys).alias("key"), "word", "n")


def _near(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def deletion_hashes(word: str) -> np.ndarray:
    """Distinct 64-bit hashes of a word and its single deletions; the length is part of a hash."""
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(codes + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
    back = np.uint64(pow(_BASE, -1, 1 << 64))
    deleted = sums[:-1] + (sums[-1] - sums[1:]) * back
    return np.unique(mix64(np.append(deleted + np.uint64(n - 1), sums[-1] + np.uint64(n))))


def _long_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, m), both directions, of near words of which one has over LONG_WORD characters."""
    long = cut(words.filter(F.length("word") >= LONG_WORD).withColumn("id", F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, word in enumerate(batch.column(1).to_pylist()):
                keys = deletion_hashes(word)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), batch.column(0)[k].as_py()), pa.int64())], names=["key", "id"])

    keys = long.select("id", "word").mapInArrow(run, "key long, id long")
    pairs = keys.alias("a").join(keys.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("i"), F.col("b.id").alias("j")).distinct()
    one, two = (long.select(F.col("id").alias(i), F.col("word").alias(w), F.col("n").alias(n)) for i, w, n in (("i", "word", "n"), ("j", "other", "m")))
    found = pairs.join(one, "i").join(two, "j").filter(_near(F.col("word"), F.col("other")) & (F.greatest(F.length("word"), F.length("other")) > LONG_WORD))
    return found.select("word", "n", "other", "m").unionByName(found.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, m): words at a distance of exactly one inserted, deleted or replaced character, in both
    directions, each pair once. ``words``: distinct words with n; should be materialised."""
    short = words.filter(F.length("word") <= LONG_WORD)
    a, b = _keys(short).alias("a"), _keys(short).select("key", F.col("word").alias("other"), F.col("n").alias("m")).alias("b")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("word") != F.col("other"))
    pairs = a.join(b, same & _near(F.col("word"), F.col("other"))).select("word", "n", "other", "m")
    if not words.filter(F.length("word") > LONG_WORD).isEmpty():
        pairs = pairs.unionByName(_long_pairs(words))
    return pairs


def forms(words: DataFrame, times: float = 2) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word: its near word of largest n (ties: the least in code-point
    order), where that n is at least ``times`` the word's."""
    own = words.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("m"))
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("m")).alias("m"), "other")))
    per = near_pairs(words).unionByName(own).groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), best.alias("best"))
    takes = -F.col("best.m") >= F.lit(times) * F.col("n")
    return per.select("word", "n", "n_near", F.when(takes, F.col("best.other")).alias("form"), F.when(takes, -F.col("best.m")).alias("form_n"))


def with_roots(formed: DataFrame) -> DataFrame:
    """``formed`` (word, form, ..) and root: where following forms ends. Rounds double the way that a row has
    gone; forms must have no loops."""
    now, rounds = cut(formed.withColumn("root", F.coalesce("form", "word"))), 0
    while True:
        held = now.groupBy("root").agg(F.count("*").alias("held"))
        onward = now.filter("form is not null").select(F.col("word").alias("at"), F.col("root").alias("to"))
        table = cut(onward.join(held, onward["at"] == held["root"]).select("root", "to", "held"))
        if table.isEmpty():
            return now
        moved = join_counted(now, table, "root", "held", "word", "to")
        now = cut(moved.select(*formed.columns, F.coalesce("to", "root").alias("root")))
        rounds += 1
        if rounds % 4 == 0:
            release(formed.sparkSession)


def spelling_groups(words: DataFrame, *, least: int = 3, times: float = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words that occur at least ``least`` times.

    ``words``: (word), a row for each occurrence, such as ``occurrences`` gives. Null words are none, an
    empty word is a word, repeated rows count; without words there are no rows. A word that nothing is
    near is its own root and has null form and form_n. Other columns are not read.
    """
    counted = cut(word_counts(words.select("word"), least))
    return with_roots(forms(counted, times)).select("word", "form", "root", "n", "n_near", "form_n")
