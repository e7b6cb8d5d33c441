"""Result tables in their report shapes, and files."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions.special import finite
from lakewright.functions.text import csv_field, report_number
from lakewright.operators.sets import metrics


def posterior_draws(draws: DataFrame) -> DataFrame:
    """chain, iteration, parameter, value, log_density with chains and iterations from 1."""
    return draws.select((F.col("chain") + 1).alias("chain"), (F.col("iteration") + 1).alias("iteration"), "parameter", "value", "log_density")


def wide_draws_to_long(draws: DataFrame, parameters: list[str]) -> DataFrame:
    long = draws.unpivot(["chain", "iteration", "log_density"], parameters, "parameter", "value")
    return posterior_draws(long)


def sampler_summary(row: DataFrame) -> DataFrame:
    """A one-row summary as (metric, value)."""
    return metrics(row, row.columns)


def structure_report(one: DataFrame, sparsity: DataFrame, bandwidth: DataFrame) -> DataFrame:
    """(metric, target, value, extra) rows of structure, effective sparsity and effective bandwidth."""
    basics = metrics(one, ["nnz", "diagonal_nnz", "bandwidth", "max_row_nnz", "fill_ratio"]).select("metric", F.lit(None).cast("double").alias("target"), "value", F.lit("").alias("extra"))
    s = sparsity.select(F.lit("effective_sparsity").alias("metric"), "target", F.col("entries_required").cast("double").alias("value"), F.concat(F.lit("compression="), F.round("compression", 6).cast("string")).alias("extra"))
    b = bandwidth.select(F.lit("effective_bandwidth").alias("metric"), "target", F.col("bandwidth").cast("double").alias("value"), F.concat(F.lit("entries="), F.col("entries_if_banded").cast("string")).alias("extra"))
    return basics.unionByName(s).unionByName(b)


def analysis_report(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, metric, target, value, extra) of several section tables with any of these columns."""
    out = None
    for name, t in sections.items():
        have = set(t.columns)
        part = t.select(F.lit(name).alias("section"), F.col("metric"), *[(F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in (("target", "string"), ("value", "double"), ("extra", "string"))])
        out = part if out is None else out.unionByName(part)
    return out


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """CSV with fields quoted only where needed and inner quotes doubled."""
    df.write.mode("overwrite").csv(path, header=header, quote='"', escape='"', emptyValue="")


def csv_lines(df: DataFrame) -> DataFrame:
    """One column of CSV lines, quoted by the same rule."""
    return df.select(F.concat_ws(",", *[csv_field(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]).alias("line"))


def derived_report(df: DataFrame, ok: bool) -> DataFrame:
    """quantity, estimate, std_error, cv; refuses an unsuccessful report."""
    if not ok:
        raise ValueError("the report was not successful")
    return df.select("quantity", "estimate", "std_error", F.try_divide("std_error", F.abs("estimate")).alias("cv"))


def json_number(x: Column) -> Column:
    """Null where not finite."""
    return F.when(finite(x), x)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row, numbers that are not finite as null."""
    cols = [json_number(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A Markdown table of a small report: one decimal from 100 on, three from 1 on, else six."""
    cols = [report_number(F.col(c)) if t in ("double", "float") else F.col(c).cast("string") for c, t in df.dtypes]
    rows = df.select(*[F.coalesce(x, F.lit("")).alias(c) for x, c in zip(cols, df.columns, strict=True)]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("the table is too long for Markdown")
    lines = [" | ".join(df.columns), " | ".join("---" for _ in df.columns), *[" | ".join(r) for r in rows]]
    return "\n".join(f"| {x} |" for x in lines) + "\n"


def publish(spark: SparkSession, text: str, path: str) -> str:
    """Write a file under a temporary name, then rename it over the target; returns its SHA-256."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    data, tmp, to = text.encode(), fs_path(path + ".tmp"), fs_path(path)
    fs = to.getFileSystem(conf)
    stream = fs.create(tmp, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    # one rename that replaces: readers see the old file or the new one, and a crash loses neither
    rename = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf).rename(tmp, to, options)
    return hashlib.sha256(data).hexdigest()


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def spatial_animation(regions: DataFrame, movements: DataFrame) -> DataFrame:
    """Region and movement rows in one table, each with the other's columns blank."""
    return regions.withColumn("record", F.lit("region")).unionByName(movements.withColumn("record", F.lit("movement")), allowMissingColumns=True)


def management_summary(runs: DataFrame, ssb: str = "ssb", ssb0: str = "ssb0", first_year: int = 1) -> DataFrame:
    """One row per run and year with depletion against unfished spawners (null where they are not positive)."""
    out = runs.select("run", ssb0, F.posexplode(ssb).alias("k", "ssb_year"))
    return out.select("run", (F.col("k") + first_year).alias("year"), F.col("ssb_year").alias("ssb"), F.when(F.col(ssb0) > 0, F.col("ssb_year") / F.col(ssb0)).alias("depletion"))
