"""Per-key results on skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.selection import heavy_values, quantiles_by_key
from netloom.plans.registry import query
from netloom.session import table

PER_DESIGN = """
WITH r AS (
    SELECT source_design, len(tree_seq) AS v, row_number() OVER (PARTITION BY source_design ORDER BY len(tree_seq)) AS r,
      count(*) OVER (PARTITION BY source_design) AS n_rows, count(tree_seq) OVER (PARTITION BY source_design) AS n
    FROM net_seqs)
SELECT source_design, max(n_rows) AS n_rows, max(n) AS n, min(v) AS lowest, max(v) AS highest,
  max(CASE WHEN r = (n * 500 + 999) // 1000 THEN v END) AS q500,
  max(CASE WHEN r = (n * 900 + 999) // 1000 THEN v END) AS q900,
  max(CASE WHEN r = (n * 990 + 999) // 1000 THEN v END) AS q990
FROM r GROUP BY source_design"""


@query(PER_DESIGN)
def p3_design_quantiles(spark: SparkSession, d: str) -> DataFrame:
    nets = table(spark, d, "net_seqs").select("source_design", F.when(F.col("tree_seq").isNotNull(), F.size("tree_seq")).alias("length"))
    return quantiles_by_key(nets, "source_design", "length")


@query(
    """SELECT source_design FROM net_seqs WHERE source_design IS NOT NULL GROUP BY source_design
       HAVING count(*) > 0.05 * (SELECT count(*) FROM net_seqs)"""
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_values(table(spark, d, "net_seqs"), "source_design", 50).select("source_design")
