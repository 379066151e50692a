"""Queries over tool reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import logs
from netloom.operators import reports
from netloom.plans.registry import query
from netloom.session import table
from netloom.sources.store import META, expected_grid

DRC = r"coalesce(TRY_CAST(nullif(regexp_extract({0}, '(?i)Total\s+Violations\s*:\s*(\d+)', 1), '') AS BIGINT), 0)"
COUNTS = f"""
  cnt AS (SELECT source_design, meta_type, max({DRC.format('drc_text')}) AS drc_num, max({DRC.format('drc_eco_text')}) AS drc_eco_num FROM drc_report GROUP BY ALL)"""


def counts(spark: SparkSession, d: str) -> DataFrame:
    """Violations by design and kind; of repeated reports the largest count."""
    r = table(spark, d, "drc_report").select("source_design", "meta_type", logs.violations(F.col("drc_text")).alias("a"), logs.violations(F.col("drc_eco_text")).alias("b"))
    return r.groupBy("source_design", "meta_type").agg(F.max("a").alias("drc_num"), F.max("b").alias("drc_eco_num"))


@query(f"WITH {COUNTS} SELECT * FROM cnt")
def r1_violations(spark: SparkSession, d: str) -> DataFrame:
    """Violations before and after repair."""
    return counts(spark, d)


@query(
    f"""
WITH {COUNTS}
SELECT g.source_design, k.meta_type, c.drc_num, c.drc_eco_num FROM designs g CROSS JOIN (VALUES ('GT'), ('PRED'), ('POST')) AS k(meta_type)
LEFT JOIN cnt c ON c.source_design = g.source_design AND c.meta_type = k.meta_type"""
)
def j5_expected_reports(spark: SparkSession, d: str) -> DataFrame:
    """Every design and kind, with nulls where there is no report."""
    return expected_grid(spark, table(spark, d, "designs"), counts(spark, d))


@query(
    f"""
WITH {COUNTS}, s AS (SELECT meta_type, sum(drc_num) AS drc_num, sum(drc_eco_num) AS drc_eco_num FROM cnt GROUP BY meta_type)
SELECT meta_type, drc_num / nullif(max(drc_num) OVER (), 0) AS drc_num, drc_eco_num / nullif(max(drc_eco_num) OVER (), 0) AS drc_eco_num FROM s"""
)
def a17_by_largest(spark: SparkSession, d: str) -> DataFrame:
    """Sums by kind over the largest."""
    return reports.by_largest(counts(spark, d), "meta_type", ["drc_num", "drc_eco_num"])


@query(
    f"""
WITH {COUNTS}, s AS (SELECT meta_type, sum(drc_num) AS a, sum(drc_eco_num) AS b FROM cnt GROUP BY meta_type), g AS (SELECT a AS ga, b AS gb FROM s WHERE meta_type = 'GT')
SELECT meta_type, CASE WHEN ga > 0 THEN a / ga END AS drc_num, CASE WHEN gb > 0 THEN b / gb END AS drc_eco_num FROM s LEFT JOIN g ON true"""
)
def a18_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Totals over those of the original."""
    return reports.normalised(counts(spark, d), "meta_type", ["drc_num", "drc_eco_num"], "GT")


@query(
    f"WITH {COUNTS} SELECT source_design, "
    + ", ".join(f"max({v}) FILTER (meta_type = '{k}') AS \"{v} ({k})\"" for v in ("drc_num", "drc_eco_num") for k in META)
    + " FROM cnt GROUP BY source_design"
)
def a19_pivot(spark: SparkSession, d: str) -> DataFrame:
    """A column for each figure and kind."""
    return reports.pivoted(counts(spark, d), "source_design", "meta_type", META, ["drc_num", "drc_eco_num"])


@query(f"WITH {COUNTS} SELECT source_design, coalesce(bool_or(drc_num <> 0), false) AS has_any FROM cnt GROUP BY source_design")
def a37_any_violation(spark: SparkSession, d: str) -> DataFrame:
    """Whether a design has a figure that is not zero."""
    return counts(spark, d).groupBy("source_design").agg(F.coalesce(F.bool_or(F.col("drc_num") != 0), F.lit(False)).alias("has_any"))


@query(
    f"""
WITH {COUNTS}, m AS (SELECT source_design, count(*) AS nets FROM net_seqs WHERE source_design IS NOT NULL GROUP BY source_design)
SELECT g.source_design, g.process_node, coalesce(m.nets, 0) AS nets, c.drc_num, round(coalesce(m.nets, 0) * 0.015923, 2) AS inference
FROM designs g LEFT JOIN m ON m.source_design = g.source_design LEFT JOIN cnt c ON c.source_design = g.source_design AND c.meta_type = 'PRED'"""
)
def j6_design_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Designs with their nets, violations and time of inference."""
    nets = table(spark, d, "net_seqs").filter("source_design is not null").groupBy("source_design").agg(F.count(F.lit(1)).alias("nets"))
    pred = counts(spark, d).filter("meta_type = 'PRED'").select("source_design", "drc_num")
    out = table(spark, d, "designs").select("source_design", "process_node").join(nets, "source_design", "left").join(pred, "source_design", "left")
    n = F.coalesce("nets", F.lit(0))
    return out.select("source_design", "process_node", n.alias("nets"), "drc_num", logs.inference_runtime(n, F.lit(None).cast("double")).alias("inference"))


@query(
    r"""
WITH l AS (SELECT source_design, meta_type, unnest(string_split(drc_text, chr(10))) AS line FROM drc_report),
  x AS (SELECT *, regexp_extract(line, '^\s+([A-Z]+)\s+(M\d+)\s*:\s*(\d+)', 1) AS rule, regexp_extract(line, '^\s+([A-Z]+)\s+(M\d+)\s*:\s*(\d+)', 2) AS layer, regexp_extract(line, '^\s+([A-Z]+)\s+(M\d+)\s*:\s*(\d+)', 3) AS n FROM l)
SELECT rule, layer, count(*) AS n_lines, CAST(sum(CAST(n AS BIGINT)) AS BIGINT) AS violations FROM x WHERE rule <> '' GROUP BY ALL"""
)
def r1_rules(spark: SparkSession, d: str) -> DataFrame:
    """Violations by rule and layer, from the lines of all reports."""
    pattern = r"^\s+([A-Z]+)\s+(M\d+)\s*:\s*(\d+)"
    lines = table(spark, d, "drc_report").select(F.explode(F.split("drc_text", "\n")).alias("line")).filter(F.col("line").rlike(pattern))
    part = lambda i: F.regexp_extract("line", pattern, i)
    return lines.groupBy(part(1).alias("rule"), part(2).alias("layer")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(part(3).cast("long")).alias("violations"))


#: A log built from each design's figures, to be scraped back.
LOG = (
    r"'#% End globalDetailRoute (total cpu=0:01:02.5, real=0:00:' || lpad(CAST(n_layers AS VARCHAR), 2, '0') || '.0)' || chr(10)"
    r" || '#Total number of routable nets = ' || CAST(floor(core_area) AS BIGINT) || chr(10) || '#Total number of nets in the design = ' || (CAST(floor(core_area) AS BIGINT) + n_layers) || chr(10)"
    r" || 'Placement Density: ' || n_layers || '.5%(10/20)' || chr(10) || '** info: there are ' || n_layers * 7 || ' stdCell insts.' || chr(10)"
    r" || '#Complete Post Route Wire Spread.' || chr(10) || '#Total wire length = ' || n_layers * 1000 || ' um.' || chr(10) || '#Total number of vias = ' || n_layers * 31"
)


@query(
    f"""
WITH t AS (SELECT source_design, {LOG} AS t FROM designs)
SELECT source_design, 62.5 AS eco_cpu, CAST(regexp_extract(t, 'real=0:00:([\\d.]+)', 1) AS DOUBLE) AS eco_real, regexp_extract(t, '#Total number of routable nets = (\\d+)', 1) AS routable_nets,
  regexp_extract(t, '#Total number of nets in the design = (\\d+)', 1) AS nets, regexp_extract(t, 'Placement Density: ?([\\d.]+)%', 1) AS density, regexp_extract(t, 'there are (\\d+) stdCell', 1) AS std_cells,
  CAST(regexp_extract(t, '#Total wire length = (\\d+) um', 1) AS BIGINT) AS wire_length, CAST(regexp_extract(t, '#Total number of vias = (\\d+)', 1) AS BIGINT) AS vias
FROM t"""
)
def r2_scraped_logs(spark: SparkSession, d: str) -> DataFrame:
    """Times, wire and placement figures scraped from logs."""
    rows = table(spark, d, "designs").select("source_design", F.expr(LOG.replace("chr(10)", "char(10)").replace("VARCHAR", "STRING")).alias("t"))
    t = F.col("t")
    return rows.select("source_design", *logs.eco(t), *logs.placement(t), *logs.wire(t))


@query(
    """
SELECT row_number() OVER (ORDER BY nets, source_design) AS rank, source_design, nets
FROM (SELECT source_design, CAST(regexp_extract(x, '^\\d+$') AS BIGINT) AS nets FROM (SELECT source_design, CAST(CAST(floor(core_area) AS BIGINT) AS VARCHAR) AS x FROM designs) WHERE regexp_matches(x, '^\\d+$'))"""
)
def sel21_numeric_order(spark: SparkSession, d: str) -> DataFrame:
    """Figures that are whole numbers, in the order of numbers."""
    from netloom.operators.ranking import ordered

    text = table(spark, d, "designs").select("source_design", F.col("core_area").cast("bigint").cast("string").alias("x"))
    rows = text.filter(F.col("x").rlike(r"^\d+$")).select("source_design", F.col("x").cast("bigint").alias("nets"))
    return ordered(rows, ["nets", "source_design"]).select("rank", "source_design", "nets")
