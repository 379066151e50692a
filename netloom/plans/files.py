"""Queries that write tables out and read them back, and checks of stored trees."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import logs
from netloom.operators import trees
from netloom.plans.coords import IS_POINT, NUMBER
from netloom.plans.forests import NET_TREE
from netloom.plans.registry import query
from netloom.plans.texts import TREE
from netloom.session import table, work_dir
from netloom.sources import store


def folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    """
SELECT 'design_graph' AS kind, count(*) AS n_rows, count(*) AS n_recorded, count(DISTINCT source_design) AS n_designs FROM design_graph
UNION ALL SELECT 'net_seqs', count(*), count(*), count(DISTINCT source_design) FROM net_seqs"""
)
def s3_design_folder(spark: SparkSession, d: str) -> DataFrame:
    """A folder with tables and metadata, written, found, kept, and read again."""
    base = folder(spark, "designs")
    tables = {k: table(spark, d, k) for k in ("net_seqs", "design_graph")}
    store.write_design(spark, f"{base}/all", "all", tables | {"pin2pin_loc_seqs": tables["net_seqs"].limit(0)})
    counts = store.write_design(spark, f"{base}/all", "all", {}, rebuild=False)
    (name,) = store.discover_designs(spark, base)
    read = store.read_design(spark, f"{base}/{name}", ["net_seqs", "design_graph", "pin2pin_loc_seqs"])
    parts = [df.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n_rows"), F.lit(counts[k]).cast("long").alias("n_recorded"), F.countDistinct("source_design").alias("n_designs")) for k, df in read.items()]
    return parts[0].unionByName(parts[1])


@query(
    """
SELECT model_type, count(*) AS n_rows, count(wirelength_pred) AS n_pred, CAST(sum(wirelength_pred) AS BIGINT) AS wirelength_pred, count(*) FILTER (is_graceful) AS n_graceful, count(DISTINCT eval_day) AS n_days
FROM eval_metrics GROUP BY model_type"""
)
def s14_metrics_file(spark: SparkSession, d: str) -> DataFrame:
    """Metrics through CSV and back, with their types."""
    path = folder(spark, "metrics")
    store.write_metrics(table(spark, d, "eval_metrics"), path)
    back = store.read_metrics(spark, path)
    return back.groupBy("model_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("wirelength_pred").alias("n_pred"), F.sum("wirelength_pred").cast("long").alias("wirelength_pred"),
        F.count_if("is_graceful").alias("n_graceful"), F.countDistinct("eval_day").alias("n_days"),
    )


@query(
    NET_TREE
    + """
SELECT source_design, count(DISTINCT s.net_id) AS n_nets, count(e.id) AS n_edges, CAST(coalesce(sum(abs(x - px) + abs(y - py) + abs(m - pm)), 0) AS BIGINT) AS length
FROM net_seqs s LEFT JOIN edg e ON e.id = s.net_id GROUP BY source_design"""
)
def s16_edges_files(spark: SparkSession, d: str) -> DataFrame:
    """Edges of every net through JSON lines by design and back."""
    nets = table(spark, d, "net_seqs")
    edges = trees.tree_edges(nets, ["net_id", "source_design"], "tree_seq")
    path = folder(spark, "edges")
    store.write_partitioned(store.edges_export(edges, "source_design", "net_id", "edges").withColumnRenamed("design", "source_design"), path, "source_design")
    point = "struct<x:bigint,y:bigint,layer:bigint>"
    back = spark.read.schema(f"net_name bigint, edges array<struct<start:{point},end:{point}>>, source_design string").json(path)
    size = F.aggregate("edges", F.lit(0).cast("long"), lambda a, e: a + F.abs(e["start"]["x"] - e["end"]["x"]) + F.abs(e["start"]["y"] - e["end"]["y"]) + F.abs(e["start"]["layer"] - e["end"]["layer"]))
    return back.groupBy("source_design").agg(F.count(F.lit(1)).alias("n_nets"), F.sum(F.size("edges")).alias("n_edges"), F.sum(size).alias("length"))


#: Logs built from the figures of a design, to be written as files and scraped.
TIMING = (
    "'timeDesign Summary' || chr(10) || 'Setup views included:' || chr(10) || ' all' || chr(10) || '| Setup mode | all | reg2reg | default |' || chr(10) || '| WNS (ns):| -0.' || n_layers || ' | 0.1 |' || chr(10)"
    " || '| TNS (ns):| -' || n_layers * 3 || '.5 | 0 |' || chr(10) || 'Density: ' || n_layers || '.25%' || chr(10)"
)
POWER = (
    "'Total Power' || chr(10) || '-----------' || chr(10) || 'Total Internal Power: ' || n_layers || '.1' || chr(10) || 'Total Switching Power: ' || n_layers || '.2' || chr(10)"
    " || 'Total Leakage Power: 0.' || n_layers || chr(10) || 'Total Power: ' || n_layers * 2 || '.5' || chr(10)"
)
ROUTING = (
    "'#% End routeDesign (total cpu=0:01:' || lpad(CAST(n_layers AS VARCHAR), 2, '0') || '.9, real=0:02:00.0)' || chr(10) || '**optDesign ... cpu = 0:00:01.0, real = 0:00:01.0' || chr(10)"
    " || '**optDesign ... cpu = 0:00:' || lpad(CAST(n_layers AS VARCHAR), 2, '0') || '.7, real = 0:00:09.0' || chr(10) || 'Total number of combinational cells: ' || n_layers * 100 || chr(10)"
    " || 'Total number of sequential cells: ' || n_layers * 10 || chr(10) || '#Total number of nets in the design = ' || n_layers * 120 || chr(10)"
)
LOG = f"{TIMING} || {POWER} || {ROUTING}"
#: Every second layer count has only some kinds of report.
WRITTEN = "meta_type = 'GT' OR meta_type = 'POST' AND n_layers % 2 = 0"


@query(
    f"""
WITH k AS (SELECT source_design, n_layers, meta_type, {WRITTEN} AS w FROM designs CROSS JOIN (VALUES ('GT'), ('PRED'), ('POST')) AS m(meta_type))
SELECT source_design, meta_type, CASE WHEN w THEN '-0.' || n_layers END AS wns, CASE WHEN w THEN '-' || n_layers * 3 || '.5' END AS tns, CASE WHEN w THEN n_layers || '.25' END AS density,
  CASE WHEN w THEN n_layers || '.1' END AS internal_power, CASE WHEN w THEN n_layers || '.2' END AS switching_power, CASE WHEN w THEN '0.' || n_layers END AS leakage_power,
  CASE WHEN w THEN n_layers * 2 || '.5' END AS total_power, CASE WHEN w THEN 60.0 + n_layers END AS route_cpu, CASE WHEN w THEN CAST(n_layers AS DOUBLE) END AS opt_cpu,
  CASE WHEN w THEN n_layers * 110 END AS cells, CASE WHEN w THEN n_layers * 120 END AS nets
FROM k"""
)
def s18_log_files(spark: SparkSession, d: str) -> DataFrame:
    """Logs in folders by design and kind, read as whole files and scraped; kinds without a file are null."""
    base = folder(spark, "logs")
    designs = table(spark, d, "designs")
    kinds = designs.select("source_design", "n_layers", F.explode(F.array(*map(F.lit, store.META))).alias("meta_type")).filter(WRITTEN)
    text = F.expr(LOG.replace("chr(10)", "char(10)").replace("VARCHAR", "STRING"))
    # a folder a report, as the tools leave them
    kinds.select(text.alias("value"), "source_design", "meta_type").repartition("source_design", "meta_type").write.partitionBy("source_design", "meta_type").text(base)
    files = store.whole_files(spark, f"{base}/*/*/*.txt", r"source_design=([^/]+)/meta_type=([^/]+)/", ["source_design", "meta_type"])
    t = F.col("text")
    found = files.select("source_design", "meta_type", *logs.timing(t), *logs.power(t), *logs.routing(t))
    out = store.expected_grid(spark, designs, found)
    return out.select("source_design", "meta_type", "wns", "tns", "density", "internal_power", "switching_power", "leakage_power", "total_power", "route_cpu", "opt_cpu", "cells", "nets")


@query(
    """
SELECT 'human' AS kind, 2 AS dimensions, count(*) AS n_rows, count(DISTINCT label) AS n_labels, round(sum(CAST(embedding[1] AS DOUBLE)), 3) AS x, CAST(NULL AS DOUBLE) AS z FROM embeddings
UNION ALL SELECT 'domain', 3, count(*), count(DISTINCT label), round(sum(CAST(embedding[1] AS DOUBLE)), 3), round(sum(CAST(embedding[3] AS DOUBLE)), 3) FROM embeddings"""
)
def s29_coordinate_files(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates through CSVs whose names tell their kind."""
    base = folder(spark, "coordinates")
    rows = table(spark, d, "embeddings").select("label", F.col("vec_id").cast("string").alias("token"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    rows.drop("z").write.csv(f"{base}/human_points.csv", header=True)
    rows.write.csv(f"{base}/domain_points.csv", header=True)
    rows.limit(0).write.csv(f"{base}/other.csv", header=True)
    back = store.read_coordinates(spark, base)
    return back.groupBy("kind", "dimensions").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("label").alias("n_labels"), F.round(F.sum("x"), 3).alias("x"), F.round(F.sum("z"), 3).alias("z")
    )


@query(
    "WITH RECURSIVE "
    + TREE.format(key="sample_id", tree="relative_tree_seq", table="token_dataset")
    + f""",
  ends AS (SELECT id, x, y, m FROM edg UNION ALL SELECT id, px, py, pm FROM edg),
  leaf AS (
    SELECT o.id, o.x, o.y, o.m FROM (SELECT id, x, y, m FROM ends GROUP BY ALL HAVING count(*) = 1) o
    JOIN nod r ON r.id = o.id AND r.parent IS NULL AND NOT (o.x = r.x AND o.y = r.y AND o.m = r.m)),
  ld AS (SELECT DISTINCT id, {', '.join(f"{NUMBER.format('e', k)} AS {n}" for k, n in ((1, 'x'), (2, 'y'), (3, 'm')))}
    FROM (SELECT sample_id AS id, unnest(relative_loads) AS e FROM token_dataset) WHERE {IS_POINT.format('e')}),
  n AS (SELECT id, count(*) AS n, count(DISTINCT (x, y, m)) AS distinct_n FROM nod GROUP BY id),
  bent AS (SELECT DISTINCT id FROM edg WHERE (x <> px)::INT + (y <> py)::INT + (m <> pm)::INT <> 1),
  loose AS (SELECT DISTINCT id FROM leaf ANTI JOIN ld USING (id, x, y, m)),
  off AS (SELECT DISTINCT id FROM ld ANTI JOIN nod USING (id, x, y, m)),
  c AS (SELECT s.sample_id, coalesce(n.n, 0) AS n_points, coalesce(n.distinct_n < n.n, false) AS has_duplicates, bent.id IS NULL AS is_rectilinear, loose.id IS NULL AS leaves_are_loads, off.id IS NULL AS loads_are_points
    FROM token_dataset s LEFT JOIN n ON n.id = s.sample_id LEFT JOIN bent ON bent.id = s.sample_id LEFT JOIN loose ON loose.id = s.sample_id LEFT JOIN off ON off.id = s.sample_id)
SELECT *, n_points > 0 AND NOT has_duplicates AND is_rectilinear AND leaves_are_loads AND loads_are_points AS is_valid FROM c"""
)
def sel16_valid_trees(spark: SparkSession, d: str) -> DataFrame:
    """Strict checks of stored trees."""
    return trees.validate(table(spark, d, "token_dataset"), "sample_id", "relative_tree_seq", "relative_loads")
