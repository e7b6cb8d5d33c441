"""Reports put together from tables: text, Markdown pages, JSON lines of several runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewright.sinks.writers import markdown


def append_json_lines(runs: dict[str, DataFrame], path: str) -> None:
    """The JSON lines (column json) of all runs in one folder; a run that fails leaves those before it."""
    for rows in runs.values():
        rows.select("json").write.mode("append").text(path)


def text_lines(report: DataFrame, width: int = 40) -> DataFrame:
    """(section, n, line) of a long report (section, metric, target, value, extra): a heading per section, then a
    line per row with its name padded to ``width`` and its value to six decimals."""
    label = F.concat(F.col("metric"), F.when(F.coalesce(F.col("target"), F.lit("")) != "", F.concat(F.lit(" "), F.col("target"))).otherwise(""))
    note = F.when(F.coalesce(F.col("extra"), F.lit("")) != "", F.concat(F.lit("  "), F.col("extra"))).otherwise("")
    padded = F.concat(label, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(label))))
    shown = F.when(F.col("value").isNull(), "-").otherwise(F.format_string("%.6f", F.col("value")))
    n = F.row_number().over(Window.partitionBy("section").orderBy("metric", "target"))
    rows = report.select("section", n.alias("n"), F.concat(padded, F.lit(" "), shown, note).alias("line"))
    heads = report.select("section").distinct().select("section", F.lit(0).alias("n"), F.concat(F.lit("["), F.col("section"), F.lit("]")).alias("line"))
    return heads.unionByName(rows)


def markdown_page(title: str, sections: dict[str, DataFrame | str], notes: dict[str, str] | None = None) -> str:
    """One Markdown page: a heading, then each section's table, or its text, with a note under it."""
    out = [f"# {title}", ""]
    for name, body in sections.items():
        out += [f"## {name}", "", body if isinstance(body, str) else markdown(body).rstrip("\n"), ""]
        if notes and notes.get(name):
            out += [notes[name], ""]
    return "\n".join(out)
