"""Queries over evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.tokens import base_of, variant_of
from netloom.operators import reports, rewards
from netloom.operators.ranking import ordered
from netloom.plans.registry import query
from netloom.session import table

CLEAN = "CASE WHEN isfinite(CAST({0} AS DOUBLE)) THEN CAST({0} AS DOUBLE) END"
MEANS = ", ".join(f"avg({CLEAN.format(m)}) AS {m}" for m in reports.MEANS)
RATIOS = ", ".join(f"CAST(sum({a}) AS DOUBLE) / nullif(CAST(sum({b}) AS DOUBLE), 0) AS {n}" for n, (a, b) in reports.RATIOS.items())


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_metrics")


@query(f"SELECT model_type, count(*) AS n_rows, {MEANS}, {RATIOS} FROM eval_metrics GROUP BY model_type")
def a12_model_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means and ratios of sums by model."""
    return reports.summary(metrics(spark, d), ["model_type"])


@query(f"SELECT source_design, model_type, count(*) AS n_rows, {MEANS}, {RATIOS} FROM eval_metrics GROUP BY ALL")
def a11_design_summary(spark: SparkSession, d: str) -> DataFrame:
    """The same by design and model, groups of any size."""
    return reports.summary(metrics(spark, d), ["source_design", "model_type"])


FLAGS = ["is_perfect_match", "is_connected_all_loads", "is_graceful"]


@query(
    f"""
SELECT model_type, checkpoint_step, count(*) AS n_rows, {', '.join(f'count(*) FILTER ({f}) AS n_{f}, count(*) FILTER ({f}) * 100.0 / count(*) AS pct_{f}' for f in FLAGS)}
FROM eval_metrics GROUP BY ALL HAVING count(*) >= 5"""
)
def a16_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How many predictions match, connect and are graceful, by model and checkpoint; groups under five rows are left out."""
    return reports.counts_of(metrics(spark, d), ["model_type", "checkpoint_step"], FLAGS)


@query(
    """
SELECT model_type, count(*) AS n_rows, CAST(sum(wirelength_pred) AS BIGINT) AS wirelength, CAST(sum(num_vias_pred) AS BIGINT) AS vias
FROM eval_metrics WHERE NOT is_graceful GROUP BY model_type"""
)
def sel8_not_graceful(spark: SparkSession, d: str) -> DataFrame:
    """Wire and vias of predictions that need repair."""
    rows = metrics(spark, d).filter(~F.col("is_graceful"))
    return rows.groupBy("model_type").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("wirelength_pred").alias("wirelength"), F.sum("num_vias_pred").alias("vias"))


SIZES = ["small", "medium", "large"]


@query(
    f"""
WITH o AS (SELECT * FROM (VALUES {', '.join(f"('{s}', {i})" for i, s in enumerate(SIZES))}) AS t(category, position)),
  m AS (SELECT split_part(model_type, '-', 1) AS category, avg({CLEAN.format('bleu_4')}) AS bleu_4, avg({CLEAN.format('red_similarity_score')}) AS red_similarity_score FROM eval_metrics WHERE model_type IS NOT NULL GROUP BY 1)
SELECT o.position, o.category, m.bleu_4, m.red_similarity_score FROM o LEFT JOIN m ON m.category = o.category"""
)
def a13_size_means(spark: SparkSession, d: str) -> DataFrame:
    """Means by model size, in the order of sizes."""
    return reports.ordered_categories(metrics(spark, d), base_of(F.col("model_type")), ["bleu_4", "red_similarity_score"], SIZES, spark)


@query(
    f"""
WITH m AS (SELECT model_type, avg({CLEAN.format('red_similarity_score')}) AS score FROM eval_metrics GROUP BY model_type)
SELECT model_type, score, max(score) OVER (PARTITION BY split_part(model_type, '-', 1)) AS best, score = max(score) OVER (PARTITION BY split_part(model_type, '-', 1)) AS is_best FROM m"""
)
def a14_best_variant(spark: SparkSession, d: str) -> DataFrame:
    """The best variant of each model size."""
    score = metrics(spark, d).groupBy("model_type").agg(F.avg(reports.number("red_similarity_score")).alias("score"))
    return reports.best_in_group(score, base_of(F.col("model_type")), "score")


@query(
    """
WITH m AS (SELECT split_part(model_type, '-', 1) AS base, regexp_replace(model_type, '^[^-]*-', '') AS variant, avg(wirelength_pred) AS v FROM eval_metrics WHERE wirelength_pred >= 0 GROUP BY ALL),
  p AS (SELECT base, max(v) FILTER (variant LIKE 'seg%') AS a, max(v) FILTER (variant LIKE 'concat%') AS b FROM m GROUP BY base)
SELECT base, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN abs(a) < 1e-12 THEN b ELSE (a + b) / 2 END AS combined FROM p"""
)
def a15_combined_variants(spark: SparkSession, d: str) -> DataFrame:
    """Two kinds of variant combined into one figure."""
    m = metrics(spark, d).filter("wirelength_pred >= 0").groupBy(base_of(F.col("model_type")).alias("base"), variant_of(F.col("model_type")).alias("variant")).agg(F.avg("wirelength_pred").alias("v"))
    pick = lambda p: F.max(F.when(F.col("variant").startswith(p), F.col("v")))
    return m.groupBy("base").agg(pick("seg").alias("a"), pick("concat").alias("b")).select("base", reports.combine_pair(F.col("a"), F.col("b")).alias("combined"))


@query(
    f"""
WITH v AS (SELECT model_type, {CLEAN.format('bleu_4')} AS v FROM eval_metrics), e AS (SELECT model_type, min(v) AS lo, quantile_cont(v, 0.95) AS hi FROM v WHERE v IS NOT NULL GROUP BY model_type)
SELECT v.model_type, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 50)), 49) END AS INTEGER) AS bin, count(*) AS count
FROM v JOIN e ON e.model_type = v.model_type WHERE v <= hi GROUP BY ALL"""
)
def x4_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Plot-ready histogram of BLEU by model, up to the 95th percentile."""
    return reports.histogram(metrics(spark, d), "bleu_4", 50, ["model_type"])


@query(
    f"""
WITH v AS (SELECT {CLEAN.format('red_similarity_score')} AS value FROM eval_metrics), c AS (SELECT value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY value)
SELECT value, sum(n) OVER (ORDER BY value) / sum(n) OVER () AS share FROM c"""
)
def x4_ecdf(spark: SparkSession, d: str) -> DataFrame:
    """Plot-ready distribution of scores."""
    return reports.ecdf(metrics(spark, d), "red_similarity_score")


SCORE = CLEAN.format("red_similarity_score")


@query(
    f"""
WITH s AS (SELECT eval_id, sample_id, {SCORE} AS v FROM eval_metrics),
  g AS (SELECT sample_id, avg(v) AS m, coalesce(stddev_samp(v), 0) AS s FROM s GROUP BY sample_id)
SELECT s.eval_id, round(g.m, 9) AS group_mean, round(g.s, 9) AS group_std, round((s.v - g.m) / (g.s + 1e-4), 6) AS advantage FROM s JOIN g ON g.sample_id = s.sample_id"""
)
def a29_advantages(spark: SparkSession, d: str) -> DataFrame:
    """Scores against the mean and deviation of their sample."""
    out = rewards.advantages(metrics(spark, d).select("eval_id", "sample_id", "red_similarity_score"), "sample_id", "red_similarity_score")
    return out.select("eval_id", F.round("group_mean", 9).alias("group_mean"), F.round("group_std", 9).alias("group_std"), F.round("advantage", 6).alias("advantage"))


@query(
    f"""
SELECT eval_id, coalesce({SCORE}, 0) * 0.8 + coalesce({CLEAN.format('bleu_4')}, 0) * 0.1 + coalesce({CLEAN.format('rougel_f')}, 0) * 0.1 AS total FROM eval_metrics"""
)
def a30_weighted_sum(spark: SparkSession, d: str) -> DataFrame:
    """Weighted sums of scores that pass over nulls and NaN."""
    values = F.array("red_similarity_score", "bleu_4", "rougel_f")
    return metrics(spark, d).select("eval_id", rewards.weighted_sum(values, [0.8, 0.1, 0.1]).alias("total"))


COMPONENTS = {"red": "red_similarity_score", "bleu": "bleu_4", "rouge": "rougel_f"}


@query(
    "WITH c AS ("
    + " UNION ALL ".join(f"SELECT model_type, '{k}' AS component, {CLEAN.format(v)} AS value FROM eval_metrics" for k, v in COMPONENTS.items())
    + """)
SELECT model_type, component, count(value) AS n, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std, avg((value >= 0.99)::INT) AS pass_rate FROM c GROUP BY ALL"""
)
def a32_components(spark: SparkSession, d: str) -> DataFrame:
    """Mean, deviation and pass rate of each component of a map."""
    parts = F.create_map(*[x for k, v in COMPONENTS.items() for x in (F.lit(k), reports.number(v))])
    out = rewards.component_statistics(metrics(spark, d).select("model_type", parts.alias("parts")), "parts", ["model_type"])
    return out.select("model_type", "component", "n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "pass_rate")


@query(
    """
WITH t AS (SELECT sample_id, CAST(wirelength_pred AS DOUBLE) AS l, CAST(wirelength_pred >= 0 AS INT) AS k FROM eval_metrics WHERE wirelength_pred IS NOT NULL),
  p AS (SELECT sample_id, sum(l * k) AS l, CAST(sum(k) AS DOUBLE) AS n FROM t GROUP BY sample_id)
SELECT avg(l / greatest(n, 1)) AS grpo, sum(l) / greatest(sum(n), 1) AS bnpo, sum(l) / (count(*) * 512) AS dr_grpo FROM p"""
)
def a33_loss_reductions(spark: SparkSession, d: str) -> DataFrame:
    """Three reductions of masked losses."""
    rows = metrics(spark, d).filter("wirelength_pred is not null").select("sample_id", F.col("wirelength_pred").alias("loss"), (F.col("wirelength_pred") >= 0).cast("int").alias("mask"))
    return rewards.masked_losses(rows, "sample_id", "loss", "mask", 512)


@query("SELECT least(min(wirelength_pred) FILTER (wirelength_pred > 0), min(num_vias_pred) FILTER (num_vias_pred > 0)) AS least_positive FROM eval_metrics")
def a35_least_positive(spark: SparkSession, d: str) -> DataFrame:
    """The least positive figure."""
    return reports.least_positive(metrics(spark, d), "wirelength_pred", "num_vias_pred")


@query(
    f"""
WITH s AS (SELECT model_type, avg({SCORE}) AS v FROM eval_metrics GROUP BY model_type),
  l AS (SELECT list(v ORDER BY model_type) AS a, list(model_type ORDER BY model_type) AS n FROM s)
SELECT unnest(list_filter(list_transform(a, lambda v, i: CASE WHEN v = list_max(a) THEN CAST(i - 1 AS INTEGER) END), lambda i: i IS NOT NULL)) AS position FROM l"""
)
def a20_best_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions of the best models in a list by name."""
    s = metrics(spark, d).groupBy("model_type").agg(F.avg(reports.number("red_similarity_score")).alias("v"))
    lists = s.agg(F.transform(F.sort_array(F.collect_list(F.struct("model_type", "v"))), lambda x: x["v"]).alias("a"))
    return lists.select(F.explode(reports.best_positions(F.col("a"), lower=False)).alias("position"))


@query(
    """
WITH g AS (SELECT source_design, count(*) AS n, sum(greatest(wirelength_pred, 0)) AS w FROM eval_metrics GROUP BY source_design)
SELECT coalesce(source_design, '(none)') AS design, CAST(n AS BIGINT) AS n, CAST(w AS BIGINT) AS w FROM g UNION ALL SELECT 'Total', CAST(sum(n) AS BIGINT), CAST(sum(w) AS BIGINT) FROM g"""
)
def a34_totals(spark: SparkSession, d: str) -> DataFrame:
    """Figures by design with a row of totals."""
    g = metrics(spark, d).groupBy(F.coalesce("source_design", F.lit("(none)")).alias("design")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest("wirelength_pred", F.lit(0))).alias("w"))
    return reports.with_total(g, "design", ["n", "w"])


@query(
    """
WITH m AS (SELECT model_type, params_m FROM eval_models)
SELECT row_number() OVER (ORDER BY CASE split_part(model_type, '-', 1) WHEN 'small' THEN 0 WHEN 'medium' THEN 1 WHEN 'large' THEN 2 ELSE 3 END, params_m, model_type) AS rank, model_type, params_m FROM m"""
)
def t10_display_order(spark: SparkSession, d: str) -> DataFrame:
    """Models in display order: size, parameters, name."""
    size = F.coalesce(F.create_map(*[x for i, s in enumerate(SIZES) for x in (F.lit(s), F.lit(i))])[base_of(F.col("model_type"))], F.lit(len(SIZES)))
    rows = table(spark, d, "eval_models").select("model_type", "params_m", size.alias("size"))
    return ordered(rows, ["size", "params_m", "model_type"]).select("rank", "model_type", "params_m")


@query(
    """
WITH m AS (SELECT model_type, checkpoint_step, avg(CASE WHEN isfinite(bleu_4) THEN bleu_4 END) AS v FROM eval_metrics GROUP BY ALL)
SELECT model_type, max(checkpoint_step) AS step, max_by(v, checkpoint_step) AS latest_bleu FROM m GROUP BY model_type"""
)
def s23_latest_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """The figures of each model's latest checkpoint."""
    m = metrics(spark, d).groupBy("model_type", "checkpoint_step").agg(F.avg(reports.number("bleu_4")).alias("v"))
    return m.groupBy("model_type").agg(F.max("checkpoint_step").alias("step"), F.max_by("v", "checkpoint_step").alias("latest_bleu"))


@query(
    """
SELECT m.model_type, m.params_m, s.step, (s.step IS NOT NULL) AS has_runs
FROM eval_models m LEFT JOIN (SELECT model_type, max(checkpoint_step) AS step FROM eval_metrics GROUP BY model_type) s ON s.model_type = m.model_type"""
)
def s31_parameter_table(spark: SparkSession, d: str) -> DataFrame:
    """Models with their parameters and whether they have runs."""
    runs = metrics(spark, d).groupBy("model_type").agg(F.max("checkpoint_step").alias("step"))
    return table(spark, d, "eval_models").join(runs, "model_type", "left").select("model_type", "params_m", "step", F.col("step").isNotNull().alias("has_runs"))
