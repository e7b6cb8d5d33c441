"""Registered queries that write a table in an input format, in the shared folder, and read it back.

They run readers and writers over whole tables; what is read must be what SQL says of the table itself.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions import text, transforms
from lakewright.operators import aggregates, matrix, sets, validation
from lakewright.plans.catalog import query, rounded, table
from lakewright.session import checkpoint_dir
from lakewright.sinks import reports, writers
from lakewright.sources import readers


def folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_file(df: DataFrame, name: str, *order: str) -> str:
    """One file of a small table's lines in order: line formats of control files are read by one task too."""
    path = folder(df.sparkSession, name)
    df.orderBy(*order).select("line").coalesce(1).write.text(path)
    return path


@query("history_scan", "SELECT year(o_orderdate)::INTEGER AS year, o_totalprice AS catch_mt, o_custkey::DOUBLE AS index FROM orders WHERE o_orderstatus = 'F'")
def history_scan(spark, sf):
    """Orders as a phased CSV; finished ones are history, others projections or rows that don't parse."""
    phase = F.when(F.col("o_orderstatus") == "F", "history").when(F.col("o_orderstatus") == "O", "projection").otherwise(" history")
    catch = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.col("o_totalprice").cast("string"))
    path = folder(spark, "history")
    writers.write_csv(table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), phase.alias("phase"), catch.alias("catch_mt"), F.col("o_custkey").alias("index")), path)
    return readers.read_history(spark, path)


_AGES = ", ".join(f"count(*) FILTER (l_linenumber = {k}) AS a{k}" for k in range(1, 8))


@query(
    "observation_scan",
    f"WITH y AS (SELECT year(l_shipdate)::INTEGER AS year, round(sum(l_quantity), 1) AS catch_mt, max(l_tax) AS index, count(*)::DOUBLE AS n, {_AGES} FROM lineitem GROUP BY 1) SELECT year, catch_mt, index, " + ", ".join(f"round(a{k} / n, 6) AS share{k}" for k in range(1, 8)) + " FROM y",
)
def observation_scan(spark, sf):
    """Yearly catches, an index and a composition of seven classes, made shares; columns stand in another order in the file."""
    li = table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.max("l_tax").alias("index"), F.round(F.sum("l_quantity"), 1).alias("catch_mt"), *[F.count_if(F.col("l_linenumber") == k).alias(f"age{k}") for k in range(1, 8)])
    path = folder(spark, "observations")
    writers.write_csv(li, path)
    out = readers.read_observations(spark, path, 7)
    return rounded(out.select("year", "catch_mt", "index", *[F.element_at("ages", k).alias(f"share{k}") for k in range(1, 8)]))


@query("strict_lines", "SELECT c_custkey::INTEGER AS id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS balance, c_mktsegment AS segment FROM customer")
def strict_lines(spark, sf):
    """Lines split strictly by commas, their numbers read strictly: hexadecimal is no number."""
    balance = F.when(F.col("c_custkey") % 9 == 0, "0x10").otherwise(F.col("c_acctbal").cast("string"))
    lines = writers.csv_lines(table(spark, sf, "customer").select("c_custkey", balance.alias("b"), "c_mktsegment"))
    path = folder(spark, "lines")
    lines.select(F.concat("line", F.lit("\r")).alias("line")).write.text(path)
    fields = spark.read.text(path).select(*readers.split_fields(F.col("value"), ["id", "balance", "segment"]))
    return fields.select(text.strict_integer(F.col("id")).alias("id"), text.strict_number(F.col("balance")).alias("balance"), "segment")


@query("scenario_scan", "SELECT r_regionkey + 1 AS scenario, r_name AS name, 'spr' AS target, (r_regionkey + 1) / 10.0::DOUBLE AS value, 1992 AS reference_first_year, 1993 + r_regionkey AS reference_last_year FROM region")
def scenario_scan(spark, sf):
    k = F.col("r_regionkey")
    path = folder(spark, "scenarios")
    rows = table(spark, sf, "region").select((k + 1).alias("scenario"), F.col("r_name").alias("name"), F.lit("spr").alias("target"), ((k + 1) / 10.0).alias("value"), F.lit(1992).alias("reference_first_year"), (k + 1993).alias("reference_last_year"))
    writers.write_csv(rows.coalesce(1), path)
    return readers.read_scenarios(spark, path, years=(1992, 1998))


@query("parameter_scan", "SELECT p_name || ' ' || p_partkey AS parameter, p_retailprice AS value FROM part")
def parameter_scan(spark, sf):
    """Parameters by name, which must be the known ones, each once."""
    rows = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("parameter"), F.col("p_retailprice").alias("value"))
    path = folder(spark, "parameters")
    writers.write_csv(rows, path)
    return readers.read_parameters(spark, path, rows.select("parameter"))


@query("control_table", "SELECT n_nationkey::VARCHAR AS key, n_regionkey::VARCHAR AS region FROM nation")
def control_table(spark, sf):
    """Rows of a control file's table up to its sentinel, with comments and blanks around them."""
    n = table(spark, sf, "nation").select((F.col("n_nationkey") + 10).alias("at"), F.concat_ws(" ", F.lit(" "), F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string"), F.lit("# note")).alias("line"))
    other = spark.createDataFrame([(0, "# file"), (1, "1 2"), (2, "CATCH"), (3, ""), (1 << 30, "-9999 0"), ((1 << 30) + 1, "7 7")], "at int, line string")
    lines = readers.numbered_lines(spark, text_file(n.unionByName(other), "control", "at"))
    rows = readers.table_section(lines, F.trim("value") == "CATCH", fields=2)
    return rows.select(F.col("fields")[0].alias("key"), F.col("fields")[1].alias("region"))


@query("report_rows", "SELECT s_suppkey::VARCHAR AS id, s_name AS name, '' AS note FROM supplier")
def report_rows(spark, sf):
    """A named section of a report as rows by header, the missing last column blank."""
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") + 10).alias("at"), F.concat_ws(" ", F.col("s_suppkey").cast("string"), "s_name").alias("line"))
    other = spark.createDataFrame([(0, "OTHER"), (1, "a b"), (2, "1 2"), (3, ""), (4, "SUPPLIERS"), (5, "id name note"), (1 << 40, ""), ((1 << 40) + 1, "9 9")], "at long, line string")
    rows = readers.report_section(readers.numbered_lines(spark, text_file(s.unionByName(other), "report", "at")), "SUPPLIERS")
    return rows.select(F.col("row")["id"].alias("id"), F.col("row")["name"].alias("name"), F.col("row")["note"].alias("note"))


@query("positional_numbers", "SELECT n_name AS name, n_nationkey * 0.5::DOUBLE AS value FROM nation")
def positional_numbers(spark, sf):
    """Bare numbers, two to a line, named by their places."""
    n = table(spark, sf, "nation")
    line = n.groupBy(F.floor(F.col("n_nationkey") / 2).alias("at")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", (F.col("n_nationkey") * 0.5).cast("string").alias("t")))).alias("v"))
    lines = line.select("at", F.concat_ws("  ", F.transform("v", lambda x: x["t"])).alias("line")).unionByName(spark.createDataFrame([(-1, "# values")], "at long, line string"))
    layout = n.select((F.col("n_nationkey") + 1).alias("position"), F.col("n_name").alias("name"))
    return readers.positional_parameters(readers.numbered_lines(spark, text_file(lines, "par", "at")), layout).select("name", "value")


@query("optional_csv", "SELECT r_regionkey AS k, CASE WHEN r_regionkey = 2 THEN NULL ELSE r_name END AS name FROM region")
def optional_csv(spark, sf):
    """A CSV with blanks as nulls, and one that is missing as no rows."""
    path = folder(spark, "regions")
    writers.write_csv(table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.when(F.col("r_regionkey") != 2, F.col("r_name")).alias("name")), path)
    return readers.read_csv_or_empty(spark, path, "k int, name string").unionByName(readers.read_csv_or_empty(spark, path + "-none", "k int, name string"))


@query("resident_sizes", "SELECT s_suppkey * 64 AS rss_kb FROM supplier")
def resident_sizes(spark, sf):
    path = folder(spark, "logs")
    k = F.col("s_suppkey")
    lines = table(spark, sf, "supplier").select(F.explode(F.array(F.concat(F.lit("\tMaximum resident set size (kbytes): "), (k * 64).cast("string")), F.concat(F.lit("\tExit status: "), k.cast("string")))).alias("line"))
    lines.write.text(path)
    return readers.resident_kb(spark.read.text(path))


@query(
    "benchmark_records",
    """WITH r AS (SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN 'unknown' ELSE 'state_space' END AS model_form, CASE WHEN p_size % 7 = 0 THEN 'other' ELSE 'warm' END AS phase, p_size - 2 AS n_obs, p_size AS n_random, CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_retailprice END AS elapsed_ms FROM part)
SELECT id, 'model form is known' AS rule FROM r WHERE model_form = 'unknown' UNION ALL SELECT id, 'phase is known' FROM r WHERE phase = 'other' UNION ALL SELECT id, 'sizes are not negative' FROM r WHERE n_obs < 0
UNION ALL SELECT id, 'elapsed_ms is present' FROM r WHERE elapsed_ms IS NULL UNION ALL SELECT id, 'time is finite' FROM r WHERE elapsed_ms IS NULL""",
)
def benchmark_records(spark, sf):
    """Benchmark results as JSON lines, several runs appended to one table, and the rules that rows break."""
    size = F.col("p_size")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(size % 10 == 0, "unknown").otherwise("state_space").alias("model_form"), F.when(size % 7 == 0, "other").otherwise("warm").alias("phase"), (size - 2).alias("n_obs"), size.alias("n_random"), F.when(size % 11 != 0, F.col("p_retailprice")).alias("elapsed_ms"))
    path = folder(spark, "results")
    forms = {f: writers.json_rows(rows.filter(F.col("model_form") == f)) for f in ("state_space", "unknown")}
    reports.append_json_lines(forms, path)
    back = spark.read.schema("id long, model_form string, phase string, n_obs int, n_random int, elapsed_ms double").json(path)
    rules = readers.benchmark_rules(["elapsed_ms"], list(readers.BENCHMARK_FORMS), ["cold", "warm"])
    return validation.rule_violations(back, rules, ["id"])


@query("report_lookup", "SELECT 'left' AS side, r_name AS value FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'right', 'x' || r_regionkey FROM region WHERE r_regionkey = 3")
def report_lookup(spark, sf):
    """A four-column report looked up by its first and by its second column."""
    r = table(spark, sf, "region")
    lines = r.select(F.col("r_regionkey").alias("n"), F.concat(F.lit("k"), F.col("r_regionkey").cast("string")).alias("c1"), F.col("r_name").alias("c2"), F.lit("").alias("c3"), F.concat(F.lit("x"), F.col("r_regionkey").cast("string")).alias("c4"))
    key = r.filter("r_regionkey = 3").first().r_name
    return readers.report_value(lines, "k0").select(F.lit("left").alias("side"), "value").unionByName(readers.report_value(lines, key).select(F.lit("right").alias("side"), "value"))


@query("spectral_report", "SELECT 'eigenvalue' AS metric, p_partkey::VARCHAR AS target, p_retailprice AS value, p_size / 64.0::DOUBLE AS cumulative_share FROM part")
def spectral_report(spark, sf):
    p = table(spark, sf, "part").select(F.lit("eigenvalue").alias("metric"), F.col("p_partkey").cast("string").alias("target"), F.col("p_retailprice").alias("value"), F.concat(F.lit("cumulative_share="), (F.col("p_size") / 64.0).cast("string")).alias("extra"))
    other = p.select("metric", "target", "value")
    return readers.spectral_rows(writers.analysis_report({"spectral": p, "geometry": other}))


# ---- reports


@query("wide_lines", "WITH c AS (SELECT c_nationkey AS i, s.n AS j, count(*) FILTER (o_orderkey % 5 = s.n) AS v FROM orders JOIN customer ON o_custkey = c_custkey, range(5) s(n) GROUP BY 1, 2) SELECT string_agg(v::VARCHAR, ',' ORDER BY j) AS line FROM c GROUP BY i")
def wide_lines(spark, sf):
    """A matrix of counts as lines without a header."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("i"))
    met = table(spark, sf, "orders").join(c, "o_custkey").select("i", (F.col("o_orderkey") % 5).alias("k"))
    coo = met.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4)))).groupBy("i", "j").agg(F.count_if(F.col("k") == F.col("j")).alias("value"))
    return writers.csv_lines(matrix.pivot_wide(coo, 5).drop("i"))


@query("derived_quantities", "SELECT p_brand AS quantity, round(avg(p_retailprice), 6) AS estimate, round(stddev_samp(p_retailprice), 6) AS std_error, round(stddev_samp(p_retailprice) / avg(p_retailprice), 6) AS cv FROM part GROUP BY 1")
def derived_quantities(spark, sf):
    d = table(spark, sf, "part").groupBy(F.col("p_brand").alias("quantity")).agg(F.avg("p_retailprice").alias("estimate"), F.stddev_samp("p_retailprice").alias("std_error"))
    return rounded(writers.derived_report(d, True))


_MARKDOWN = """SELECT '| region | mean | nations |' AS line, 0 AS n UNION ALL SELECT '| --- | --- | --- |', 1 UNION ALL
SELECT '| ' || r_name || ' | ' || CASE WHEN m >= 100 THEN printf('%.1f', m) WHEN m >= 1 THEN printf('%.3f', m) ELSE printf('%.6f', m) END || ' | ' || k || ' |', 2 + r_regionkey FROM (SELECT r_regionkey, r_name, avg(n_nationkey * n_nationkey) / 4.0::DOUBLE AS m, count(*) AS k FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL)"""


def _markdown(spark, sf) -> str:
    n = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg((F.avg(F.col("n_nationkey") * F.col("n_nationkey")) / 4.0).alias("mean"), F.count("*").alias("nations"))
    rows = table(spark, sf, "region").join(n, "r_regionkey").orderBy("r_regionkey")
    return writers.markdown(rows.select(F.col("r_name").alias("region"), "mean", "nations"))


@query("markdown_lines", _MARKDOWN)
def markdown_lines(spark, sf):
    lines = _markdown(spark, sf).splitlines()
    return spark.createDataFrame([(x, k) for k, x in enumerate(lines)], "line string, n int")


@query("published_hash", f"SELECT sha256(string_agg(line, chr(10) ORDER BY n) || chr(10)) AS sha256 FROM ({_MARKDOWN})")
def published_hash(spark, sf):
    """A report published under its name; the hash is of the file's bytes as they are read back."""
    where = folder(spark, "published")
    writers.publish(spark, "old", f"{where}/report.md")
    writers.publish(spark, _markdown(spark, sf), f"{where}/report.md")
    return writers.content_hashes(spark, f"{where}/report.md").select("sha256")


_SECTIONS = """r AS (SELECT 'structure' AS section, 0 AS s, 'nations' AS metric, '' AS target, count(*)::DOUBLE AS value FROM nation UNION ALL SELECT 'geometry', 1, 'regionkey', n_name, n_regionkey::DOUBLE FROM nation)"""


@query("report_text", f"WITH {_SECTIONS} SELECT DISTINCT '[' || section || ']' AS line FROM r UNION ALL SELECT rpad(metric || CASE WHEN target <> '' THEN ' ' || target ELSE '' END, 40, ' ') || ' ' || printf('%.6f', value) FROM r")
def report_text(spark, sf):
    """A long report as text, section by section."""
    n = table(spark, sf, "nation")
    parts = {"structure": n.agg(F.lit("nations").alias("metric"), F.count("*").cast("double").alias("value")), "geometry": n.select(F.lit("regionkey").alias("metric"), F.col("n_name").alias("target"), F.col("n_regionkey").cast("double").alias("value"))}
    return reports.text_lines(writers.analysis_report(parts)).select("line")


@query("start_agreement", "WITH s AS (SELECT o_orderpriority AS model, count(*) FILTER (o_orderstatus <> 'P') AS good, count(*) AS n, max(abs(o_totalprice - 200000)) AS worst FROM orders GROUP BY 1) SELECT model, n AS starts, good = n AS converged, round(worst, 4) AS worst_difference, (n = 3 AND good = n AND worst < 1e-6) AS robust FROM s")
def start_agreement(spark, sf):
    """Whether fits from three starts agree; orders stand for fits here, and there are more than three."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("model"), (F.col("o_orderstatus") != "P").alias("converged"), F.lit(0.0).alias("gradient_norm"), F.col("o_totalprice").alias("objective"))
    return rounded(validation.start_agreement(o, ["model"], baseline=F.lit(200000.0)), 4)


@query("relative_thresholds", """WITH c AS (SELECT c_nationkey AS i, year(o_orderdate)::INTEGER AS j, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), m AS (SELECT max(abs(value)) AS top FROM c)
SELECT t AS threshold, count(*) FILTER (abs(value) >= t * top) AS kept, round(coalesce(sum(abs(value)) FILTER (abs(value) >= t * top), 0) / sum(abs(value)), 6) AS share, round(sqrt(coalesce(sum(value ** 2) FILTER (abs(value) < t * top), 0) / sum(value ** 2)), 6) AS frobenius_error FROM c, m, (SELECT unnest([0.5, 0.1, 0.01])::DOUBLE AS t) GROUP BY t""")
def relative_thresholds(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("i"))
    coo = table(spark, sf, "orders").join(c, "o_custkey").groupBy("i", F.year("o_orderdate").alias("j")).agg(F.sum("o_totalprice").alias("value"))
    return rounded(matrix.relative_threshold_limits(coo, (0.5, 0.1, 0.01)))


# ---- small operators


@query("bounded_transforms", "SELECT p_partkey, round(exp(x), 8) AS positive, round(2 / (1 + exp(-x)) - 1, 8) AS correlation FROM (SELECT p_partkey, (p_size - 25.5) / 10.0::DOUBLE AS x FROM part)")
def bounded_transforms(spark, sf):
    x = (F.col("p_size") - 25.5) / 10.0
    return rounded(table(spark, sf, "part").select("p_partkey", transforms.positive_from_unconstrained(x).alias("positive"), transforms.correlation_from_unconstrained(x).alias("correlation")), 8)


@query("gather_by_index", "SELECT vec_id, round(embedding[4]::DOUBLE, 6) AS a, round(embedding[64]::DOUBLE, 6) AS b, round(embedding[1]::DOUBLE, 6) AS c FROM embeddings")
def gather_by_index(spark, sf):
    """Elements of arrays by position, out of range being an error."""
    got = sets.gather(F.col("embedding"), [3, 63, 0])
    return rounded(table(spark, sf, "embeddings").select("vec_id", *[x.cast("double").alias(n) for x, n in zip(got, "abc", strict=True)]))


@query("pattern_entries", "WITH s AS (SELECT l_linenumber AS direction, l_suppkey % 6 AS i, l_partkey % 6 AS j, sum(CASE WHEN l_returnflag = 'R' THEN l_tax ELSE 0 END) AS value FROM lineitem GROUP BY 1, 2, 3), k AS (SELECT * FROM s WHERE abs(value) > 1e-12) SELECT direction, round(sqrt(sum(value ** 2)), 6) AS norm, count(*) AS entries, (SELECT count(DISTINCT j) FROM k) AS columns FROM k GROUP BY 1")
def pattern_entries(spark, sf):
    """Kept entries, active directions and needed columns of a stack of matrices."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("direction"), (F.col("l_suppkey") % 6).alias("i"), (F.col("l_partkey") % 6).alias("j")).agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_tax")).otherwise(0.0)).alias("value"))
    kept = matrix.drop_small(li)
    sizes = kept.groupBy("direction").agg(F.count("*").alias("entries"))
    return rounded(matrix.active_directions(li).join(sizes, "direction").crossJoin(matrix.needed_columns(kept).agg(F.count("*").alias("columns"))))


@query("band_arrays", "WITH c AS (SELECT c_nationkey AS i, s_nationkey AS j, count(*)::DOUBLE AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) SELECT i - j AS band, string_agg(value::BIGINT::VARCHAR, ',' ORDER BY j) AS entries FROM c WHERE i >= j AND i - j <= 3 GROUP BY 1")
def band_arrays(spark, sf):
    from lakewright.plans.catalog import nation_counts

    out = matrix.to_bands(nation_counts(spark, sf), 3)
    return out.select("band", F.concat_ws(",", F.transform("values", lambda v: v.cast("long").cast("string"))).alias("entries"))


@query("walk_traces", "SELECT event_type, round(sum(1 / (1 + value) * (0.5 * 0.3 + 0.2 * exp(value / 1000) * (0.1 + value / 500))), 6) AS trace FROM events GROUP BY 1")
def walk_traces(spark, sf):
    e = table(spark, sf, "events").select("event_type", (1 / (1 + F.col("value"))).alias("inverse"), (F.col("value") / 1000).alias("u"), (F.col("value") / 500).alias("du"))
    return rounded(matrix.random_walk_traces(e, "event_type", "inverse", "u", "du", weight=0.5, weight_slope=0.3, rate=0.2, rate_slope=0.1))


@query("age_biomass", "SELECT vec_id, round(list_sum([x * x for x in embedding::DOUBLE[]]), 5) AS biomass, round(list_sum([x * x * 0.5 for x in embedding::DOUBLE[]]), 5) AS spawners FROM embeddings")
def age_biomass(spark, sf):
    x = F.transform("embedding", lambda v: v.cast("double"))
    half = F.transform("embedding", lambda v: F.lit(0.5))
    return rounded(table(spark, sf, "embeddings").select("vec_id", aggregates.biomass(x, x).alias("biomass"), aggregates.biomass(x, x, half).alias("spawners")), 5)


@query("labels_of_numbers", "SELECT s_suppkey, CASE WHEN g IS NULL THEN 'UNKNOWN' WHEN g < 0.01 THEN 'PASS' WHEN g < 0.1 THEN 'CAUTION' ELSE 'CHECK' END AS gradient, CASE WHEN c IS NULL THEN 'UNKNOWN' WHEN c < 100 THEN 'EXCELLENT' WHEN c < 1000 THEN 'GOOD' WHEN c < 10000 THEN 'CAUTION' ELSE 'HIGH RISK' END AS conditioning FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 7 > 0 THEN abs(s_acctbal) / 50000 END AS g, CASE WHEN s_suppkey % 5 > 0 THEN abs(s_acctbal) * 3 END AS c FROM supplier)")
def labels_of_numbers(spark, sf):
    k = F.col("s_suppkey")
    nan = F.lit(math.nan)
    g, c = F.when(k % 7 > 0, F.abs("s_acctbal") / 50000).otherwise(nan), F.when(k % 5 > 0, F.abs("s_acctbal") * 3).otherwise(nan)
    return table(spark, sf, "supplier").select("s_suppkey", text.gradient_label(g).alias("gradient"), text.condition_label(c).alias("conditioning"))


@query("spectral_shares", "WITH a AS (SELECT c_mktsegment, abs(c_acctbal) AS a, c_custkey FROM customer), r AS (SELECT *, sum(a) OVER (PARTITION BY c_mktsegment ORDER BY a DESC, c_custkey ROWS UNBOUNDED PRECEDING) / sum(a) OVER (PARTITION BY c_mktsegment) AS run, row_number() OVER (PARTITION BY c_mktsegment ORDER BY a DESC, c_custkey) AS k FROM a) SELECT c_mktsegment, min(k) FILTER (run >= 0.5 - 1e-12) AS k_50, min(k) FILTER (run >= 0.9 - 1e-12) AS k_90 FROM r GROUP BY 1")
def spectral_shares(spark, sf):
    """How many of the largest absolute values hold half and nine tenths of their sum."""
    return aggregates.largest_holding(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal", "c_custkey", {"k_50": 0.5, "k_90": 0.9})


@query(
    "token_stream",
    "SELECT 'nation' AS part, n_nationkey AS n, n_name AS name, n_regionkey::DOUBLE AS a, NULL::DOUBLE AS b FROM nation UNION ALL SELECT 'lineitem', l_orderkey, l_returnflag || ' by \"' || l_linestatus || '\"', l_extendedprice, l_linenumber::DOUBLE FROM lineitem",
)
def token_stream(spark, sf):
    """A stream with a version, single values and two counted collections, the second one all of lineitem; many tasks
    write it and many read it."""
    from lakewright.sources.streams import TokenStream, write_stream

    nation, lines = table(spark, sf, "nation"), table(spark, sf, "lineitem")
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.concat("l_returnflag", F.lit(' by "'), "l_linestatus", F.lit('"')), '"', '\\\\"'), F.lit('"'))
    head = spark.createDataFrame([(0, 0, f"LAKEWRIGHT_1 1992 1998 4\n3 3 3 3 {nation.count()}"), (2, 0, str(lines.count()))], "s int, k long, line string")
    body = nation.select(F.lit(1).alias("s"), F.col("n_nationkey").cast("long").alias("k"), F.format_string('%d "%s"\t%d', F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey")).alias("line"))
    rows = lines.select(F.lit(3).alias("s"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), F.concat_ws(" ", "l_orderkey", quoted, "l_extendedprice", "l_linenumber").alias("line"))
    path = folder(spark, "stream")
    write_stream(head.unionByName(body).unionByName(rows), path, "s", "k")
    stream = TokenStream(spark, path, "LAKEWRIGHT_1")
    stream.numbers(7)
    nations = stream.collection("key int, name string, region int", most=1000)
    items = stream.collection("key int, name string, price double, place int")
    stream.finish()
    a = nations.select(F.lit("nation").alias("part"), F.col("key").cast("long").alias("n"), "name", F.col("region").cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    return a.unionByName(items.select(F.lit("lineitem").alias("part"), F.col("key").cast("long").alias("n"), "name", F.col("price").alias("a"), F.col("place").cast("double").alias("b")))


@query(
    "control_file",
    """SELECT o_orderkey AS key, abs(CASE o_orderpriority WHEN '5-LOW' THEN -999 ELSE year(o_orderdate) END)::INTEGER AS year, o_totalprice AS value, o_orderpriority = '5-LOW' AS initial, o_orderpriority <> '5-LOW' AND o_orderstatus = 'P' AS excluded,
CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE CASE WHEN year(o_orderdate) BETWEEN 1992 AND 1994 THEN 1 WHEN year(o_orderdate) BETWEEN 1995 AND 1998 THEN 2 ELSE 0 END END::INTEGER AS part FROM orders""",
)
def control_file(spark, sf):
    """A control file made from orders: flags, block patterns, parameters with priors, a table up to its sentinel with
    excluded and initial rows, and an end mark; read by many tasks, each order with its time block's part."""
    from lakewright.sources.streams import PARAMETER, ControlFile, block_parameters, estimated, prior_nll, write_stream

    top = "0 1 # flags\n2 # block patterns\n1 2\n1996 1997\n1992 1994 1995 1998\n\n# parameters\n3\n-5 5 0.5 0 1 6 2 2 # with a prior and blocks\n0 1 0.25 0 0 0 -1 0\n1 9 4 5 2 6 1 0"
    year = F.when(F.col("o_orderpriority") == "5-LOW", -999).when(F.col("o_orderstatus") == "P", -F.year("o_orderdate")).otherwise(F.year("o_orderdate"))
    body = table(spark, sf, "orders").select(F.lit(1).alias("s"), F.col("o_orderkey").alias("k"), F.concat_ws(" ", "o_orderkey", year.cast("string"), F.col("o_totalprice").cast("string"), F.concat(F.lit("# "), "o_orderpriority")).alias("line"))
    head = spark.createDataFrame([(0, 0, top), (2, 0, "-9999 0 0\n999")], "s int, k long, line string")
    path = folder(spark, "control")
    write_stream(head.unionByName(body), path, "s", "k")
    control = ControlFile(spark, path)
    control.expect(0, 1)
    (patterns,) = control.numbers(1)
    ranges = []
    for block, n in enumerate(control.numbers(int(patterns)), 1):
        years = control.numbers(2 * int(n))
        ranges += [(block, part + 1, int(years[2 * part]), int(years[2 * part + 1])) for part in range(int(n))]
    parameters = estimated(control.counted(PARAMETER)).withColumn("name", F.concat(F.lit("p"), "n"))
    parts = block_parameters(parameters, spark.createDataFrame(ranges, "block int, part int, first int, last int"))
    if round(parameters.agg(F.sum(prior_nll(F.col("initial"), F.col("prior_mean"), F.col("prior_sd"), F.col("prior_type")))).first()[0], 6) != 0.25:
        raise ValueError("priors differ")
    rows = readers.catch_flags(control.table("key int, year int, value double"))
    control.finish()
    # ranges of block patterns, a few
    met = rows.join(F.broadcast(parts), F.col("abs_year").between(F.col("first"), F.col("last")) & ~F.col("initial"), "left")
    return met.select(F.col("key").cast("long").alias("key"), F.col("abs_year").cast("int").alias("year"), "value", "initial", "excluded", F.coalesce("part", F.lit(0)).alias("part"))
