"""Mixing sources to target weights by pivotal dependent rounding.

Every source's words share the mix by weight, a source giving at most ``cap`` times its own words; what
a capped source can't give is shared again among the others. A source's documents are then copied
``rate = target / size of the source`` times each: floor(rate) times for sure and once more with the
fractional probability. Pivotal rounding fixes those: two undecided documents exchange words at random
until one is decided, so the expected words stay the target's and all but the last document's are
taken exactly. Documents meet, larger ones first, in bounded chunks of a source; the one document that
each chunk leaves undecided goes up a reduction tree of fixed fan-in to a single one per source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.session import cut
from lakewright.llm.text import count_words, slices, texts_of

#: Documents that meet in one chunk on average, and chunks that one node of the tree combines.
CHUNK, FAN_IN = 2_000, 64
#: Documents of a chunk, the largest, that meet all others of it at once.
MANY = 200

ROWS = "doc_id long, source string, size long, whole long, p double, chunk long, copies long"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size): size is the number of words of the whole text, 0 for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at, _ = texts_of(batch.column(2))
            out = [count_words(buf[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in slices(at)]
            n = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "size"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, size long")


#: Rows that repeat another that one row stands for on the way to being told apart.
REPEATS = 1000


def _told_apart(sized: DataFrame) -> DataFrame:
    """``sized`` with a number ``copy`` of each row among those equal to it, counted before they are dealt."""
    counted = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / REPEATS))))
    blocks = blocks.repartition(F.xxhash64("doc_id", "source", "size", "block"))
    last = F.least(F.col("n"), (F.col("block") + 1) * REPEATS) - 1
    return blocks.select("doc_id", "source", "size", F.explode(F.sequence(F.col("block") * REPEATS, last)).alias("copy"))


def targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size, n_docs, target) per source.

    Sources by code point, null last, weigh ``weights`` in turn; any number of sources is sorted in ranges.
    The level of words per weight rises until no source is above its cap; only a few sums per step, and
    one count per range, come to the driver.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # places over all sources: sorted by ranges, a row's place is that in its partition and what partitions before hold
    per = cut(per.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).cast("int")
    held = dict(per.groupBy(part.alias("part")).count().collect())
    before = {p: sum(n for q, n in held.items() if q < p) for p in held}
    start = F.element_at(F.create_map(*[F.lit(v) for kv in before.items() for v in kv]), part) if before else F.lit(0)
    order = start + F.col("at") - F.shiftleft(part.cast("long"), 33)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (order % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", w).drop("at")
    most = F.col("source_size") * F.lit(float(cap))
    total, weight = per.agg(F.sum("source_size"), F.sum("weight")).first()
    level = float(total or 0) / weight if weight else 0.0
    while True:
        full = most < F.col("weight") * F.lit(level)
        given, left = per.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        after = (float(total or 0) - (given or 0.0)) / left if left else level
        if not left or after <= level:
            break
        level = after
    full = most < F.col("weight") * F.lit(level)
    return per.withColumn("target", F.when(full, most).otherwise(F.col("weight") * F.lit(level))).select("source", "source_size", "n_docs", "target")


def pivot_round(p: np.ndarray, size: np.ndarray, uniform: np.ndarray) -> tuple[np.ndarray, int]:
    """Sequential pivotal rounding in the given order; changes ``p`` in place.

    Returns 0/1 decisions (-1: undecided) and the index of the one document left undecided, or -1. In
    each meeting words move from one document to the other, in a direction drawn so that both
    probabilities keep their expectation, until one of the two is decided; the sum of p * size stays.
    Documents without words are rounded on their own. The first ``MANY`` documents meet all that come
    after them at once where those can hold the words, so that a very long document isn't left over.
    """
    out, eps, held = np.full(len(p), -1, np.int64), 1e-9, -1
    for i in range(len(p)):
        if size[i] <= 0:
            out[i] = int(uniform[i] < p[i])
            continue
        if i < MANY and held < 0 and eps < p[i] < 1 - eps:
            rest, words = p[i + 1 :], size[i + 1 :]
            room = np.minimum(rest * words / (1 - p[i]), (1 - rest) * words / p[i])
            if room.sum() >= size[i]:
                part = room * (size[i] / room.sum())
                rise = uniform[i] < p[i]
                change = part * (-(1 - p[i]) if rise else p[i])
                rest += np.divide(change, words, out=np.zeros_like(words), where=words > 0)
                np.clip(rest, 0, 1, out=rest)
                out[i] = int(rise)
                continue
        if held >= 0 and eps < p[i] < 1 - eps:
            up = min((1 - p[held]) * size[held], p[i] * size[i])
            down = min(p[held] * size[held], (1 - p[i]) * size[i])
            move = up if uniform[i] * (up + down) < down else -down
            p[held] += move / size[held]
            p[i] -= move / size[i]
        for k in (held, i):
            if k >= 0 and not eps < p[k] < 1 - eps:
                out[k] = int(p[k] > 0.5)
        if held < 0 or out[held] >= 0:
            held = i if out[i] < 0 else -1
    return out, held


def _round_group(seed: int, level: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id"], ascending=False, kind="stable").reset_index(drop=True)
        name = f"{seed}|{level}|{rows.source[0]!r}|{rows.chunk[0]}"
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big"))
        p = rows.p.to_numpy(dtype=float, copy=True)
        decided, held = pivot_round(p, rows["size"].to_numpy(dtype=float), rng.random(len(rows)))
        rows["p"] = p
        rows["copies"] = pd.array(np.where(decided < 0, 0, decided) + rows.whole.to_numpy(), dtype="Int64")
        if held >= 0:
            rows.loc[held, "copies"] = pd.NA
        return rows

    return run


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row in: doc_id, source, size, source_size, target, copies, taken = copies * size.

    Null or empty texts have size 0 and take 0 words; a null source is a source of its own, last in
    order; null ids and repeated rows are rows like others, dealt over chunks however many repeat; an
    empty table gives an empty one; columns other than the three named are not read. Reruns agree:
    random numbers come from ``seed``, the source and the chunk, and the order in a chunk is by falling
    (size, doc_id). In every chunk the ``MANY`` largest documents meet all that come after them at once,
    the others meet one by one; at any input size a chunk has about ``CHUNK`` documents.
    """
    sized = cut(_told_apart(sizes(docs, id_col, text_col, source_col)))
    per = cut(targets(sized, weights, cap))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = per.select(F.col("source").alias("s"), "source_size", "target", rate.alias("rate"), F.ceil(F.col("n_docs") / F.lit(CHUNK)).alias("chunks"))
    rows = sized.join(plan.select("s", "rate", "chunks"), F.col("source").eqNullSafe(F.col("s")))
    whole = F.floor(F.col("rate") + F.lit(1e-12))
    p = F.greatest(F.lit(0.0), F.col("rate") - whole)
    rows = rows.select("doc_id", "source", "size", whole.alias("whole"), p.alias("p"), F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "copy"), F.greatest(F.col("chunks"), F.lit(1))).alias("chunk"), F.lit(None).cast("long").alias("copies"))
    chunks, level, done = per.agg(F.max(F.ceil(F.col("n_docs") / F.lit(CHUNK)))).first()[0] or 1, 0, []
    while True:
        rows = cut(rows.groupBy("source", "chunk").applyInPandas(_round_group(seed, level), ROWS))
        done.append(rows.filter("copies is not null"))
        rows = rows.filter("copies is null")
        if chunks <= 1:
            break
        rows = rows.withColumn("chunk", F.floor(F.col("chunk") / F.lit(FAN_IN)))
        chunks, level = -(-chunks // FAN_IN), level + 1
    done.append(rows.withColumn("copies", F.col("whole") + (_uniform(seed) < F.col("p")).cast("long")))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    out = out.select("doc_id", "source", "size", "copies").join(plan.select("s", "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _uniform(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed + 1), "source", "doc_id", "size", "chunk"), F.lit(1 << 30)) / F.lit(float(1 << 30))
