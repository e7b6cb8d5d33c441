"""Fill-in-the-middle rows by overlapping chunks.

A text is cut at two of its units (characters, words or lines). Where a unit starts is told by a predicate
on two adjacent characters, so a chunk needs one byte of the chunk before it and no more. All chunks
count their unit starts independently of each other; a running sum over a text's counts says which chunk
owns a cut's rank, and only owning chunks are looked at again for the byte offset. Offsets then cut the
text's bytes by Spark's own functions, so output and restored text are Columns.

Texts up to ``SPREAD_BYTES`` are counted where they are, chunk by chunk, in one pass without a shuffle.
Chunks of longer ones are rows of their own that are dealt over the cluster: their counts, running sums
and owners are DataFrame operations, and only owners' rows are read twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.llm.session import cut
from lakewright.llm.text import SPACE, slices, texts_of

#: Whether a unit starts at a byte, from the byte before it and itself; before a text stands a line feed.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "char": lambda before, here: (here & 0xC0) != 0x80,
    "word": lambda before, here: SPACE[before] & ~SPACE[here],
    "line": lambda before, here: before == 0x0A,
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk.
CHUNK_BYTES = 1 << 12
#: Bytes whose predicates are evaluated at once.
BLOCK_BYTES = 1 << 20
#: A longer text's chunks are dealt over the cluster, in rows of PIECE_BYTES.
SPREAD_BYTES = 64 << 20
PIECE_BYTES = 1 << 20


def unit_starts(buf: np.ndarray, lo: int, hi: int, heads: np.ndarray, unit: str) -> np.ndarray:
    """Whether a unit starts at each byte of buf[lo:hi]; ``heads`` are the sorted starts of texts."""
    before = np.empty(hi - lo, np.uint8)
    before[1:] = buf[lo : hi - 1]
    before[0] = buf[lo - 1] if lo else 0x0A
    before[heads[np.searchsorted(heads, lo) : np.searchsorted(heads, hi)] - lo] = 0x0A
    return UNITS[unit](before, buf[lo:hi])


def chunks(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, offsets by text) of the chunks of texts with byte offsets ``at``; they tile the bytes."""
    per = -(-np.diff(at) // size)
    by_text = np.concatenate([[0], np.cumsum(per)])
    text = np.repeat(np.arange(len(per)), per)
    return at[text] + (np.arange(by_text[-1]) - by_text[text]) * size, by_text


def chunk_counts(buf: np.ndarray, starts: np.ndarray, heads: np.ndarray, unit: str) -> np.ndarray:
    """Unit starts in each chunk."""
    out, ends = np.zeros(len(starts), np.int64), np.append(starts[1:], len(buf))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK_BYTES)))
        lo = int(starts[i])
        hit = unit_starts(buf, lo, int(ends[j - 1]), heads, unit)
        out[i:j] = np.add.reduceat(hit.view(np.int8), starts[i:j] - lo, dtype=np.int64)
        i = j
    return out


def cut_offsets(buf: np.ndarray, at: np.ndarray, draws: list[np.ndarray], unit: str, size: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """(units n of each text, the byte offset after rank draw % (n + 1) units for each draw)."""
    starts, by_text = chunks(at, size or CHUNK_BYTES)
    heads = at[:-1][np.diff(at) > 0]
    counts = chunk_counts(buf, starts, heads, unit)
    upto = np.concatenate([[0], np.cumsum(counts)])
    base = upto[by_text[:-1]]
    n, length = upto[by_text[1:]] - base, np.diff(at)
    ends = np.append(starts[1:], len(buf))
    out = []
    for draw in draws:
        rank = draw % (n + 1)
        offset = np.where(rank == n, length, 0)
        inner = np.flatnonzero((rank > 0) & (rank < n))
        owner = np.searchsorted(upto, base[inner] + rank[inner], "right") - 1
        for d, c in zip(inner.tolist(), owner.tolist(), strict=True):
            lo = int(starts[c])
            hit = np.flatnonzero(unit_starts(buf, lo, int(ends[c]), heads, unit))
            offset[d] = lo + hit[base[d] + rank[d] - upto[c]] - at[d]
        # no unit before the cut: the cut is the text's start, even where the text has no unit at all
        out.append(np.where(rank == 0, 0, offset))
    return n, out


def _draws(id_col: Column, seed: str) -> list[Column]:
    """The first four 32-bit numbers of the SHA-256 of ``seed`` and the id."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _in_place(rows: DataFrame, unit: str) -> DataFrame:
    """``rows`` (doc_id, text, d1, d2, ..) with n and the two byte offsets, counted within the task."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    a, b, t = rows.columns.index("d1"), rows.columns.index("d2"), rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at, _ = texts_of(batch.column(t))
            for i, j in slices(at, 8 * BLOCK_BYTES):
                part = batch.slice(i, j - i)
                draws = [np.asarray(part.column(k)) for k in (a, b)]
                n, (x, y) = cut_offsets(buf[at[i] : at[j]], at[i : j + 1] - at[i], draws, unit)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=[*part.schema.names, "n", "x", "y"])

    return rows.mapInArrow(run, schema + ", n long, x long, y long")


PIECES = "key long, piece int, lead binary, data binary"


def _spread(rows: DataFrame, unit: str) -> DataFrame:
    """The same with chunks as rows: counts, running sums and the routing of ranks are DataFrame operations."""
    kept = cut(rows.withColumn("key", F.monotonically_increasing_id()))
    whole = kept.select("key", F.col("text").cast("binary").alias("data"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = memoryview(batch.column(1)[k].as_buffer())
                for p, lo in enumerate(range(0, len(data), PIECE_BYTES)):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(k, 1), pa.array([p], pa.int32()), pa.array([bytes(data[lo - 1 : lo]) if lo else b"\n"], pa.binary()), pa.array([bytes(data[lo : lo + PIECE_BYTES])], pa.binary())],
                        names=["key", "piece", "lead", "data"],
                    )

    dealt = cut(whole.mapInArrow(pieces, PIECES).repartition("key", "piece"))

    def starts_of(batch: pa.RecordBatch, k: int) -> np.ndarray:
        data = np.frombuffer(batch.column(2)[k].as_py() + batch.column(3)[k].as_py(), np.uint8)
        return unit_starts(data, 1, len(data), np.zeros(0, np.int64), unit)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [int(starts_of(batch, k).sum()) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.int64())], names=["key", "piece", "held"])

    # pieces of one text, of which there are at most 2**31 / PIECE_BYTES
    upto = Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.mapInArrow(counted, "key long, piece int, held long").withColumns({"base": F.coalesce(F.sum("held").over(upto), F.lit(0)), "n": F.sum("held").over(Window.partitionBy("key"))})
    ranks = kept.select("key", F.explode(F.array(*[F.struct(F.lit(w).alias("which"), F.col(d).alias("d")) for w, d in (("x", "d1"), ("y", "d2"))])).alias("c"))
    routed = cut(counts.join(ranks, "key").withColumn("rank", F.pmod(F.col("c.d"), F.col("n") + 1)).select("key", "piece", "n", "rank", "base", "held", "c.which"))
    owners = routed.filter("rank > 0 and rank < n and rank >= base and rank < base + held").select("key", "piece", "which", (F.col("rank") - F.col("base")).alias("nth"))

    def rescanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [int(p) * PIECE_BYTES + int(np.flatnonzero(starts_of(batch, k))[nth]) for k, (p, nth) in enumerate(zip(batch.column(1).to_pylist(), batch.column(5).to_pylist(), strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(found, pa.int64())], names=["key", "which", "offset"])

    inner = dealt.join(owners, ["key", "piece"]).select("key", "piece", "lead", "data", "which", "nth").mapInArrow(rescanned, "key long, which string, offset long")
    offsets = inner.groupBy("key").pivot("which", ["x", "y"]).agg(F.min("offset"))
    ends = routed.groupBy("key").agg(F.max("n").alias("n"), *[F.max(F.when((F.col("which") == w) & (F.col("rank") == F.col("n")) & (F.col("n") > 0), F.lit(1))).alias(f"{w}_end") for w in ("x", "y")])
    found = ends.join(offsets, "key", "left")
    length = F.octet_length("text").cast("long")
    out = kept.join(found, "key")
    return out.select(*rows.columns, "n", *[F.coalesce(F.col(w), F.when(F.col(f"{w}_end") == 1, length), F.lit(0).cast("long")).alias(w) for w in ("x", "y")])


def arrange(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column) -> Column:
    """The training text of a form from a text's three parts."""
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from; its parts hold no control string, so each stands once."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, last = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, last, second)).when(form == "spm", F.concat(second, last, first)).otherwise(output)


def fill_in_middle(docs: DataFrame, *, unit: str = "char", plain_percent: int = 10, spm_percent: int = 20, seed: str = "1:", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output) of every whole text, a row for each row.

    The first four 32-bit numbers of the SHA-256 of ``seed`` and the id decide: two cuts, each after
    number % (n + 1) of a text's n units; whether the text stays plain (the last ``plain_percent`` of a
    hundred); and whether the suffix comes first (``spm_percent`` of the rest). Empty texts and texts that
    hold a control string are plain, with null unit counts. A null text is empty; a null id draws as an
    empty id; repeated rows are each cut, alike; an empty table gives none; other columns are not read. A
    cut after no unit is the text's start. Output and text must fit a value of 2**31 bytes.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {tuple(UNITS)}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d1, d2, d3, d4 = _draws(F.col(id_col), seed)
    control = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | control | (d3 % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(d4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), d1.alias("d1"), d2.alias("d2"), form.alias("form"))
    far = F.octet_length("text") > SPREAD_BYTES
    out = _in_place(rows.filter(~far), unit)
    long = rows.filter(far)
    if not long.isEmpty():
        out = out.unionByName(_spread(long, unit))
    data, a, b = F.col("text").cast("binary"), F.least("x", "y").cast("int"), F.greatest("x", "y").cast("int")
    prefix, middle = (F.substring(data, lo + 1, n).cast("string") for lo, n in ((F.lit(0), a), (a, b - a)))
    suffix = F.substring(data, b + 1, F.octet_length("text") - b).cast("string")
    lo, hi = (f(F.pmod(F.col("d1"), F.col("n") + 1), F.pmod(F.col("d2"), F.col("n") + 1)) for f in (F.least, F.greatest))
    cuts = F.col("form") != "plain"
    return out.select(
        "doc_id", "n", "form", F.when(cuts, lo).alias("prefix_units"), F.when(cuts, hi - lo).alias("middle_units"), arrange(F.col("form"), prefix, middle, suffix, F.col("text")).alias("output")
    )
