"""Readers of observation, scenario, report and benchmark files.

Schemas are explicit. ``skip`` readers drop rows they can't parse, ``strict`` ones raise.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.functions.special import finite
from lakewright.functions.text import finite_double, strict_integer, strict_number
from lakewright.operators.validation import duplicate_keys, key_sets_differ, require_empty, rule_violations


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """year, catch_mt, index of ``phase = 'history'`` rows; rows that don't parse are skipped, none left is an error."""
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE")
    out = raw.filter(F.trim("phase") == "history").select(F.trim("year").try_cast("int").alias("year"), finite_double(F.col("catch_mt")).alias("catch_mt"), finite_double(F.col("index")).alias("index")).dropna()
    if out.isEmpty():
        raise ValueError(f"no history rows in {path}")
    return out


def read_observations(spark: SparkSession, path: str, ages: int, *, renormalise: bool = True) -> DataFrame:
    """year, catch_mt, index, ages array of exactly ``3 + ages`` columns by header name; anything else raises."""
    names = ["year", "catch_mt", "index", *[f"age{k}" for k in range(1, ages + 1)]]
    header = spark.read.text(path).limit(1).first()
    found = [] if header is None else [x.strip() for x in header[0].rstrip("\r").split(",")]
    if sorted(found) != sorted(names):
        raise ValueError(f"{path} must have the columns {names}")
    schema = ", ".join(f"`{c}` {'int' if c == 'year' else 'double'}" for c in found)
    raw = spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", enforceSchema=False)
    a = F.array(*names[3:])
    total = F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    shares = F.when(total > 0, F.transform(a, lambda v: v / total)).otherwise(a) if renormalise else a
    return raw.select("year", "catch_mt", "index", shares.alias("ages"))


def split_fields(line: Column, fields: list[str]) -> list[Column]:
    """Comma-separated fields of a line without quotes; a trailing CR goes, a quote or a wrong count is an error."""
    clean = F.regexp_replace(line, "\r$", "")
    parts = F.split(clean, ",", -1)
    ok = ~F.contains(clean, F.lit('"')) & (F.size(parts) == len(fields))
    checked = F.when(ok, parts).otherwise(F.raise_error(F.lit("quoted or malformed line")).cast("array<string>"))
    return [checked[k].alias(f) for k, f in enumerate(fields)]


SCENARIO_FIELDS = ["scenario", "name", "target", "value", "reference_first_year", "reference_last_year"]


def read_scenarios(spark: SparkSession, path: str, *, expected: int = 5, years: tuple[int, int] = (1975, 2021)) -> DataFrame:
    """Projection scenarios with their rules: exact header, row count, unique names, fractions in (0, 1), years in range."""
    lines = spark.read.text(path)
    if (lines.first() or [""])[0].rstrip("\r").split(",") != SCENARIO_FIELDS:
        raise ValueError("wrong scenario header")
    raw = spark.read.csv(path, header=True)
    out = raw.select(strict_integer(F.col("scenario")).alias("scenario"), "name", "target", strict_number(F.col("value")).alias("value"), strict_integer(F.col("reference_first_year")).alias("reference_first_year"), strict_integer(F.col("reference_last_year")).alias("reference_last_year"))
    a, b = F.col("reference_first_year"), F.col("reference_last_year")
    rules = {
        "numbers": F.col("scenario").isNotNull() & finite(F.col("value")),
        "name": F.length("name") > 0,
        "fraction": ~F.lower("target").rlike("ratio|spr|fraction") | ((F.col("value") > 0) & (F.col("value") < 1)),
        "years": (a >= years[0]) & (b <= years[1]) & (a <= b),
    }
    require_empty(rule_violations(out, rules, ["scenario"]), "invalid scenario")
    require_empty(duplicate_keys(out, ["name"]), "duplicate scenario name")
    if out.count() != expected:
        raise ValueError(f"{path} must have {expected} rows")
    return out


def read_parameters(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """(parameter, value) with duplicates, unknown and missing names rejected against ``known``."""
    raw = spark.read.csv(path, header=True)
    out = raw.select("parameter", strict_number(F.col("value")).alias("value"))
    require_empty(out.filter("value is null"), "a value is not a number")
    require_empty(duplicate_keys(out, ["parameter"]), "duplicate parameter")
    require_empty(key_sets_differ(out, known, ["parameter"]), "unknown or missing parameter")
    return out


def check_unique_keys(pairs: list[tuple[str, object]]) -> dict:
    out: dict[str, object] = {}
    for k, v in pairs:
        if k in out:
            raise ValueError(f"duplicate key {k!r}")
        out[k] = v
    return out


def load_closed_json(text: str, schema: dict[str, type | tuple[type, ...]]) -> dict:
    """A JSON object with exactly the schema's keys, unique keys and finite numbers."""

    def constant(name: str):
        raise ValueError(f"{name} is not allowed")

    doc = json.loads(text, object_pairs_hook=check_unique_keys, parse_constant=constant)
    if set(doc) != set(schema):
        raise ValueError(f"keys differ: {sorted(set(doc) ^ set(schema))}")
    for k, kind in schema.items():
        if not isinstance(doc[k], kind) or isinstance(doc[k], bool) and kind is not bool:
            raise ValueError(f"{k} has the wrong type")
    return doc


def check_layout(doc: dict, *, seasons: int = 4, ages: int = 16, fleets: int = 27, bins: int = 51) -> None:
    """Layout and foreign keys of a native assessment document: seasons, ages, ordered fleets, increasing bins, catches."""
    if doc["seasons"] != seasons or doc["ages"] != ages:
        raise ValueError("wrong seasons or ages")
    if [f["fleet"] for f in doc["fleets"]] != list(range(1, fleets + 1)):
        raise ValueError("fleets must be numbered in order")
    edges = doc["length_bins"]
    if len(edges) != bins or any(b <= a for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError("length bins must increase")
    fishing = {f["fleet"] for f in doc["fleets"] if f["type"] == 1}
    seen = set()
    for c in doc["catches"]:
        key = (c["year"], c["season"], c["fleet"])
        if c["fleet"] not in fishing or key in seen or not 1 <= c["season"] <= seasons or c["value"] < 0:
            raise ValueError(f"invalid catch {key}")
        seen.add(key)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, value): lines with their place, numbered inside each file.

    A file is read whole by one task because line order is only known there; these are small control files.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "value"))
    return whole.withColumn("n", F.col("n") + 1).withColumn("value", F.regexp_replace("value", "\r$", ""))


def table_section(lines: DataFrame, marker: Column, *, fields: int, sentinel: str = "-9999") -> DataFrame:
    """Whitespace-separated rows after the marker line up to the row that begins with the sentinel, per file.

    Comments (#) and blank lines go; rows of fewer fields are errors.
    """
    up = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    clean = F.trim(F.regexp_replace("value", "#.*$", ""))
    out = lines.withColumn("on", F.max(marker.cast("int")).over(up)).withColumn("here", marker).filter("on = 1").withColumn("v", clean).filter((F.col("v") != "") & ~F.col("here"))
    parts = F.split("v", r"\s+")
    out = out.withColumn("ended", F.max((parts[0] == sentinel).cast("int")).over(up)).filter("ended = 0")
    checked = F.when(F.size(parts) >= fields, parts).otherwise(F.raise_error(F.concat(F.lit("short row at line "), F.col("n"))).cast("array<string>"))
    return out.select("file", "n", checked.alias("fields"))


def report_section(lines: DataFrame, name: str, pattern: str = r"^\S", *, pad: bool = True) -> DataFrame:
    """Rows of a named report section as maps by header: header after the section line, rows until a blank,
    comment or non-matching line; short rows are padded with blanks or rejected."""
    w = Window.partitionBy("file").orderBy("n")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("s", F.sum((F.trim("value") == name).cast("int")).over(up)).filter("s = 1").withColumn("k", F.row_number().over(w) - 1)
    header = out.filter("k = 1").select("file", F.split(F.trim("value"), r"\s+").alias("header"))
    require_empty(header.filter(F.size("header") != F.size(F.array_distinct("header"))), "a header name repeats")
    body = out.filter("k > 1").withColumn("bad", (~F.col("value").rlike(pattern) | F.trim("value").startswith("#")).cast("int")).withColumn("bad", F.max("bad").over(up)).filter("bad = 0")
    met = body.join(header, "file").withColumn("parts", F.split(F.trim("value"), r"\s+"))
    if not pad:
        require_empty(met.filter(F.size("parts") < F.size("header")), "a short row")
    full = F.slice(F.concat("parts", F.array_repeat(F.lit(""), F.size("header"))), 1, F.size("header"))
    return met.select("file", "n", F.map_from_arrays("header", full).alias("row"))


def positional_parameters(lines: DataFrame, layout: DataFrame) -> DataFrame:
    """Named parameters from a file of bare numbers: k-th number of the file to the layout's name of position k."""
    numbers = lines.filter(~F.trim("value").startswith("#")).select("file", "n", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("p", "token")).filter("token <> ''")
    k = F.row_number().over(Window.partitionBy("file").orderBy("n", "p"))
    placed = numbers.select("file", k.alias("position"), strict_number(F.col("token")).alias("value"))
    return placed.join(layout, "position").select("file", "name", "value")


def catch_flags(rows: DataFrame, year: str = "year") -> DataFrame:
    """Year -999 marks initial catches; a negative source year an excluded row."""
    return rows.withColumn("initial", F.col(year) == -999).withColumn("excluded", (F.col(year) < 0) & (F.col(year) != -999)).withColumn("abs_year", F.abs(year))


def read_csv_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with blanks as nulls; an empty table where the file is missing."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(path, header=True, nullValue="", mode="PERMISSIVE")


def resident_kb(lines: DataFrame) -> DataFrame:
    """Peak resident size from timing logs: the number after 'Maximum resident set size'."""
    n = F.regexp_extract("value", r"Maximum resident set size.*?:\s*([0-9]+)", 1).try_cast("long")
    return lines.select(n.alias("rss_kb")).filter("rss_kb is not null")


BENCHMARK_FORMS = ("state_space", "random_intercept", "catch_at_age", "surplus_production", "selectivity_random_walk")


def benchmark_rules(required: list[str], forms: list[str], phases: list[str]) -> dict[str, Column]:
    """Rules of benchmark result rows: required fields, known forms and phases, non-negative counts, finite times."""
    rules = {f"{c} is present": F.col(c).isNotNull() for c in required}
    rules["model form is known"] = F.col("model_form").isin(*forms)
    rules["phase is known"] = F.col("phase").isin(*phases)
    rules["sizes are not negative"] = (F.col("n_obs") >= 0) & (F.col("n_random") >= 0)
    rules["time is finite"] = finite(F.col("elapsed_ms")) & (F.col("elapsed_ms") >= 0)
    return rules


def report_value(lines: DataFrame, key: str) -> DataFrame:
    """First match in file order in a four-column report: column 2 where column 1 is the key, else column 4 where column 2 is."""
    c1, c2, c4 = F.col("c1"), F.col("c2"), F.col("c4")
    hit = lines.withColumn("v", F.when(c1 == key, c2).when(c2 == key, c4)).filter(((c1 == key) | (c2 == key)))
    return hit.agg(F.min_by("v", "n").alias("value"))


def spectral_rows(report: DataFrame) -> DataFrame:
    """Spectral rows with the cumulative share taken out of the extra field."""
    return report.filter("section = 'spectral'").select("metric", "target", "value", F.regexp_replace("extra", "^cumulative_share=", "").try_cast("double").alias("cumulative_share"))
