"""Inputs whose meaning lies in their order, read by many tasks: token streams and control files.

Such files say in place how long their next part is, so a reader must know the number of every token or
row. Splits of files are numbered on their own first, in parallel; a table of one row per split gives what
comes before each; after that any part is a range of numbers. Only counts and single rows come to the
driver. Several files are one input, in the order of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakewright.functions.text import strict_integer, strict_number
from lakewright.session import cut

#: Rows or tokens that come to the driver at once, to be looked at one by one.
PEEK = 256
TOKEN = r'"(?:[^"\\]|\\.)*"|\S+'


def numbered(spark: SparkSession, path: str, *, comment: str | None = None) -> DataFrame:
    """(line, row, first, tokens): for every line that has tokens, its number from 1, how many such lines and how
    many tokens are before it, and its tokens. Text from ``comment`` on is not read. A token in double quotes may
    hold spaces; it ends on its line."""
    value = F.regexp_replace("value", "^﻿", "")
    text = F.regexp_replace(value, f"{comment}.*$", "") if comment else value
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("tokens"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, before = None, np.zeros(3, np.int64)
        for batch in batches:
            file, block = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            counts = np.asarray(batch.column(2).value_lengths())
            step = np.column_stack([np.ones(len(counts), np.int64), counts > 0, counts])
            out = np.empty_like(step)
            edge = [0, *[k for k in range(1, len(file)) if (file[k], block[k]) != (file[k - 1], block[k - 1])], len(file)]
            for lo, hi in zip(edge, edge[1:], strict=False):
                if hi > lo and (file[lo], block[lo]) != here:
                    here, before = (file[lo], block[lo]), np.zeros(3, np.int64)
                upto = before + np.cumsum(step[lo:hi], axis=0)
                out[lo:hi], before = upto - step[lo:hi], upto[-1] if hi > lo else before
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x) for x in out.T]], names=["file", "block", "tokens", "line", "row", "first"])

    kept = cut(lines.mapInArrow(local, "file string, block long, tokens array<string>, line long, row long, first long"))
    splits = kept.groupBy("file", "block").agg(F.count("*").alias("line"), F.count_if(F.size("tokens") > 0).alias("row"), F.sum(F.size("tokens")).alias("first"))
    # one row per split, and what its lines add to
    ahead = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("file", "block", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"__{c}") for c in ("line", "row", "first")])
    met = kept.join(F.broadcast(base), ["file", "block"]).filter(F.size("tokens") > 0)
    return met.select((F.col("line") + F.col("__line") + 1).alias("line"), (F.col("row") + F.col("__row")).alias("row"), (F.col("first") + F.col("__first")).alias("first"), "tokens")


class Malformed(ValueError):
    pass


def _typed(token: Column, kind: str, where: Column) -> Column:
    """A token as int, double or string; what doesn't parse is an error that names its line."""
    if kind == "string":
        quoted = F.regexp_replace(F.regexp_extract(token, r'^"(.*)"$', 1), r"\\(.)", "$1")
        return F.when(token.rlike(r'^".*"$'), quoted).otherwise(token)
    value = strict_integer(token) if kind == "int" else strict_number(token) if kind == "double" else strict_number(token).cast(kind)
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"not a finite {kind} at line "), where, F.lit(": "), F.coalesce(token, F.lit("nothing")))).cast(kind))


@dataclass
class TokenStream:
    """Whitespace-separated tokens, read from the front: single values, and collections that begin with their count."""

    spark: SparkSession
    path: str
    magic: str | None = None
    at: int = field(default=0, init=False)

    def __post_init__(self):
        lines = numbered(self.spark, self.path)
        self.tokens = lines.select("line", "first", F.posexplode("tokens").alias("k", "token")).select("line", (F.col("first") + F.col("k")).alias("place"), "token")
        self.total = self.tokens.count()
        if self.magic is not None and (not self.total or self._take(1)[0] != self.magic):
            raise Malformed(f"{self.path} does not begin with {self.magic}")

    def _take(self, n: int) -> list[str]:
        if n > PEEK:
            raise ValueError(f"more than {PEEK} single values at once")
        got = self.tokens.filter(F.col("place").between(self.at, self.at + n - 1)).orderBy("place").collect()
        if len(got) < n:
            raise Malformed(f"{self.path} ends in the middle of single values")
        self.at += n
        return [r.token for r in got]

    def numbers(self, n: int) -> list[float]:
        """The next n tokens, which must be finite numbers."""
        out = []
        for token in self._take(n):
            try:
                out.append(float(token))
            except ValueError:
                raise Malformed(f"{token} is not a number") from None
            if not np.isfinite(out[-1]):
                raise Malformed(f"{token} is not finite")
        return out

    def collection(self, schema: str, *, most: int | None = None) -> DataFrame:
        """(n from 0, fields): a count and as many records of the schema's fields (int, double, string)."""
        (count,) = self.numbers(1)
        if count < 0 or count != int(count) or (most is not None and count > most):
            raise Malformed(f"a collection of {count}")
        fields = StructType.fromDDL(schema).fields
        start, width = self.at, len(fields)
        if start + int(count) * width > self.total:
            raise Malformed(f"{self.path} ends in a collection of {int(count)}")
        self.at += int(count) * width
        inside = self.tokens.filter(F.col("place").between(start, self.at - 1)).withColumn("o", F.col("place") - start)
        rows = inside.groupBy(F.floor(F.col("o") / width).cast("long").alias("n")).agg(*[F.max(F.when(F.col("o") % width == k, F.struct("token", "line"))).alias(f"c{k}") for k in range(width)])
        return rows.select("n", *[_typed(F.col(f"c{k}.token"), f.dataType.simpleString(), F.col(f"c{k}.line")).alias(f.name) for k, f in enumerate(fields)])

    def finish(self) -> None:
        if self.at != self.total:
            raise Malformed(f"{self.total - self.at} tokens are left in {self.path}")


@dataclass
class ControlFile:
    """Rows of numbers, with comments: read from the front as single rows, counted blocks and tables that end with a
    sentinel. Errors name the line."""

    spark: SparkSession
    path: str
    comment: str = "#"
    at: int = field(default=0, init=False)

    def __post_init__(self):
        self.rows = numbered(self.spark, self.path, comment=self.comment).select("line", "row", "tokens")
        self.total = self.rows.count()
        self._seen: dict[int, tuple[int, list[str]]] = {}

    def _row(self) -> tuple[int, list[str]]:
        """(line, tokens) of the next row; rows come to the driver some at a time."""
        if self.at >= self.total:
            raise Malformed(f"{self.path} ends too early")
        if self.at not in self._seen:
            self._seen = {r.row: (r.line, r.tokens) for r in self.rows.filter(F.col("row").between(self.at, self.at + PEEK - 1)).collect()}
        self.at += 1
        return self._seen[self.at - 1]

    def numbers(self, n: int | None = None) -> list[float]:
        """The next row, which must hold n finite numbers."""
        line, tokens = self._row()
        try:
            out = [float(t) for t in tokens]
        except ValueError:
            raise Malformed(f"not a number at line {line}") from None
        if not np.isfinite(out).all() or (n is not None and len(out) != n):
            raise Malformed(f"{len(out)} numbers where {n} finite ones are due at line {line}")
        return out

    def expect(self, *values: float) -> None:
        """Flags that must have these values: other settings aren't supported."""
        if self.numbers(len(values)) != list(values):
            raise Malformed(f"line {self._seen[self.at - 1][0]} must hold {values}")

    def _table(self, lo: int, hi: int, schema: str) -> DataFrame:
        fields = StructType.fromDDL(schema).fields
        part = self.rows.filter(F.col("row").between(lo, hi - 1))
        tokens = F.when(F.size("tokens") == len(fields), F.col("tokens")).otherwise(F.raise_error(F.concat(F.size("tokens"), F.lit(f" fields where {len(fields)} are due at line "), F.col("line"))).cast("array<string>"))
        checked = part.select((F.col("row") - lo).alias("n"), "line", tokens.alias("tokens"))
        return checked.select("n", "line", *[_typed(F.get("tokens", F.lit(k)), f.dataType.simpleString(), F.col("line")).alias(f.name) for k, f in enumerate(fields)])

    def block(self, n: int, schema: str) -> DataFrame:
        """(n from 0, line, fields) of the next n rows."""
        if self.at + n > self.total:
            raise Malformed(f"{self.path} ends in a block of {n} rows")
        self.at += n
        return self._table(self.at - n, self.at, schema)

    def counted(self, schema: str) -> DataFrame:
        """A row that holds a count, and a block of as many rows."""
        (n,) = self.numbers(1)
        if n < 0 or n != int(n):
            raise Malformed(f"a count of {n} at line {self._seen[self.at - 1][0]}")
        return self.block(int(n), schema)

    def table(self, schema: str, *, sentinel: float = -9999) -> DataFrame:
        """Rows up to the one that begins with the sentinel, which is read too."""
        first = F.get("tokens", F.lit(0)).try_cast("double")
        end = self.rows.filter((F.col("row") >= self.at) & (first == sentinel)).agg(F.min("row")).first()[0]
        if end is None:
            raise Malformed(f"a table of {self.path} has no end")
        lo, self.at = self.at, end + 1
        return self._table(lo, end, schema)

    def finish(self, sentinel: float = 999) -> None:
        if self.numbers(1) != [sentinel] or self.at != self.total:
            raise Malformed(f"{self.path} must end with {sentinel}")


#: A parameter's row: bounds, start, prior, phase, a block pattern and how it acts.
PARAMETER = "lower double, upper double, initial double, prior_mean double, prior_sd double, prior_type int, phase int, block int"


def block_parameters(parameters: DataFrame, blocks: DataFrame) -> DataFrame:
    """(name, block, part, first, last): a parameter of its own for each range of years of a parameter's block pattern.

    ``parameters`` (name, block; 0 is none), ``blocks`` (block, part, first, last). A pattern that is not
    there is an error.
    """
    used = parameters.filter("block <> 0")
    met = used.join(blocks.withColumn("__known", F.lit(True)), "block", "left")
    known = F.when(F.col("__known"), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("no block pattern "), F.col("block"))).cast("int"))
    return met.select(F.concat_ws("_", "name", F.lit("block"), F.col("block").cast("string"), F.col("part").cast("string")).alias("name"), known.alias("block"), "part", "first", "last")


def prior_nll(value: Column, mean: Column, sd: Column, kind: Column) -> Column:
    """Half the squared distance of a normal prior (type 6) or none (type 0); other types are errors."""
    return F.when(kind == 0, 0.0).when(kind == 6, 0.5 * ((value - mean) / sd) ** 2).otherwise(F.raise_error(F.concat(F.lit("unsupported prior type "), kind)).cast("double"))


def estimated(parameters: DataFrame) -> DataFrame:
    """Parameters with a positive phase, whose start must lie inside their bounds."""
    inside = (F.col("lower") <= F.col("initial")) & (F.col("initial") <= F.col("upper"))
    checked = F.when(inside, F.col("initial")).otherwise(F.raise_error(F.concat(F.lit("start outside its bounds at line "), F.col("line"))).cast("double"))
    return parameters.filter("phase > 0").withColumn("initial", checked)


def write_stream(lines: DataFrame, path: str, *order: str, parts: int | None = None) -> None:
    """``lines`` (line and order columns) as text files whose names follow the order, by many tasks."""
    n = parts or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(n, *order).sortWithinPartitions(*order).select("line").write.option("compression", "none").text(path)
