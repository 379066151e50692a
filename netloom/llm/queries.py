"""Queries over the training-data operators, and the SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm import bpe, chunking, near_groups, packing, percentiles, split_overlap, splits, term_stats
from netloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_groups.near_pairs(table(spark, d, "net_seqs"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_groups.near_groups(table(spark, d, "net_seqs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    terms = term_stats.term_statistics(table(spark, d, "token_dataset"), "sample_id", "target_tokens")
    return terms.filter("mark is not null").select("token", "mark")


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_stats.term_statistics(table(spark, d, "token_dataset"), "sample_id", "target_tokens")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = split_overlap.overlaps(table(spark, d, "token_dataset"))
    return pairs.select(F.least("held_out_id", "train_id").alias("sample_a"), F.greatest("held_out_id", "train_id").alias("sample_b"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.report(table(spark, d, "token_dataset"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.tied_pairs(table(spark, d, "net_seqs"))


def p5_split(spark: SparkSession, d: str) -> DataFrame:
    plan = [(r.split, r.ratio) for r in table(spark, d, "split_plan").collect()]
    return splits.assign(table(spark, d, "net_seqs"), plan)


def p5_components(spark: SparkSession, d: str) -> DataFrame:
    """Components with their rows and the number of splits these are in, which is 1."""
    of = p5_split(spark, d).filter("component is not null").groupBy("component")
    return of.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("split").alias("n_splits"))


P6_GROUP, P6_VALUES = ["model_type", "source_design"], ["wirelength_pred", "num_vias_pred"]


def p6_evaluations(spark: SparkSession, d: str) -> DataFrame:
    """Evaluations without the negative predictions, which do not count."""
    return table(spark, d, "eval_metrics").withColumns({v: F.when(F.col(v) >= 0, F.col(v)) for v in P6_VALUES})


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    parts = percentiles.partials(p6_evaluations(spark, d), P6_GROUP, "eval_day", P6_VALUES)
    return percentiles.percentiles(parts, P6_GROUP)


def p6_daily(spark: SparkSession, d: str) -> DataFrame:
    days = p6_evaluations(spark, d).withColumn("eval_day", F.col("eval_day").cast("string"))
    return percentiles.partials(days, P6_GROUP, "eval_day", P6_VALUES)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(table(spark, d, "documents"), "doc_id")


def limits(spark: SparkSession, d: str, purpose: str) -> tuple[int, int]:
    row = table(spark, d, "token_limits").filter(F.col("purpose") == purpose).first()
    return row.max_tokens, row.overlap_tokens


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"), limits(spark, d, "container")[0])


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    capacity = limits(spark, d, "container")[0]
    return packing.containers(packing.pack_texts(table(spark, d, "documents"), capacity), capacity)


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: documents packed, containers over the capacity, documents cut though they fit, tokens lost or made up."""
    capacity = limits(spark, d, "container")[0]
    packed = p8_pack(spark, d)
    over = packed.groupBy("container").agg(F.sum("size").alias("used")).filter(F.col("container").isNotNull() & (F.col("used") > capacity)).agg(F.count(F.lit(1)).alias("overfull"))
    sizes = bpe.count_column(table(spark, d, "documents"), "doc_id")
    whole = packed.groupBy("doc_id").agg(F.sum("size").alias("packed"), F.count(F.lit(1)).alias("pieces"), F.countDistinct("container").alias("containers"))
    wrong = sizes.join(whole, "doc_id", "left").agg(
        F.count("pieces").alias("documents"),
        F.count_if((F.col("n_tokens") <= capacity) & (F.col("pieces") > 1)).alias("torn"),
        F.sum(F.abs(F.col("n_tokens") - F.coalesce("packed", F.lit(0)))).alias("tokens_lost"),
        F.count_if((F.col("n_tokens") > 0) & (F.col("containers") != F.col("pieces"))).alias("unplaced"),
    )
    return wrong.join(over)


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the pieces: no long text without pieces, none over the limit, text and count those of the range, no gaps, no overlap too short."""
    limit, overlap = limits(spark, d, "piece")
    documents = table(spark, d, "documents").select("doc_id", F.col("text").alias("whole"))
    cut = p9_pieces(spark, d).join(documents, "doc_id")
    after = Window.partitionBy("doc_id").orderBy("piece")
    cut = cut.withColumns({"next": F.lead("start").over(after), "key": F.concat_ws("-", F.col("doc_id"), F.col("piece"))})
    shared = F.when(F.col("next").isNotNull(), F.expr("substring(whole, int(next) + 1, int(end - next))"))
    cut = cut.select("key", "doc_id", "piece", "n_pieces", "start", "end", "n_tokens", "text", "next", shared.alias("shared"), F.length("whole").alias("length"),
                     (F.col("text") == F.expr("substring(whole, int(start) + 1, int(end - start))")).alias("same"))
    alone = bpe.count_column(cut, "key", "text").withColumnRenamed("n_tokens", "alone")
    overlapping = bpe.count_column(cut, "key", "shared").withColumnRenamed("n_tokens", "shared_tokens")
    long = bpe.count_column(documents, "doc_id", "whole").filter(F.col("n_tokens") > limit).agg(F.count(F.lit(1)).alias("long"))
    checked = cut.join(alone, "key").join(overlapping, "key").agg(
        F.count_if(F.col("piece") == 0).alias("texts"),
        F.count_if(F.col("alone") > limit).alias("too_large"),
        F.count_if(~F.col("same") | (F.col("alone") != F.col("n_tokens"))).alias("differing"),
        F.count_if((F.col("next") > F.col("end")) | F.col("next").isNull() & (F.col("end") != F.col("length")) | (F.col("piece") == 0) & (F.col("start") != 0)).alias("gaps"),
        F.count_if(F.col("next").isNotNull() & (F.col("shared_tokens") < overlap)).alias("too_little_shared"),
    )
    return checked.join(long).select((F.col("long") - F.col("texts")).alias("missed"), "too_large", "differing", "gaps", "too_little_shared")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    cut = chunking.pieces(table(spark, d, "documents"), *limits(spark, d, "piece"), with_text=False)
    return cut.filter("piece = 1").select("doc_id")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pieces(table(spark, d, "documents"), *limits(spark, d, "piece"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_terms, p4_found, p4_report, p5_found, p5_split, p5_components, p6_percentiles, p6_daily, p7_ids, p8_pack, p8_containers, p8_check, p9_found, p9_pieces, p9_check)}


#: Distinct points of an array column, and the pairs of ids whose point sets are near.
POINTS = r"""
  {name} AS (
    SELECT DISTINCT id, CAST(g[1] AS HUGEINT) AS x, CAST(g[2] AS HUGEINT) AS y, CAST(g[3] AS HUGEINT) AS m
    FROM (SELECT id, regexp_extract_all(e, '-?\d+')[1:3] AS g
          FROM (SELECT {key} AS id, unnest(tree_seq) AS e FROM {table})
          WHERE regexp_matches(e, '^\s*\(-?\d+,\s*-?\d+,\s*-?\d+\)'))),
  {name}_n AS (SELECT id, count(*) AS n FROM {name} GROUP BY id HAVING count(*) >= 8),
  {name}_near AS (
    SELECT p.id AS a, q.id AS b
    FROM {name} p JOIN {name} q ON p.x = q.x AND p.y = q.y AND p.m = q.m AND p.id < q.id
    JOIN {name}_n pn ON pn.id = p.id JOIN {name}_n qn ON qn.id = q.id
    GROUP BY p.id, q.id, pn.n, qn.n
    HAVING count(*) * 5 >= 4 * (pn.n + qn.n - count(*)))"""
NET_POINTS = POINTS.format(name="pt", key="net_id", table="net_seqs")
NET_REACH = f"""
WITH RECURSIVE {NET_POINTS},
  sym AS (SELECT a, b FROM pt_near UNION SELECT b, a FROM pt_near),
  reach AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a)"""

TERMS = r"""
WITH occ AS (SELECT sample_id, unnest(string_split_regex(target_tokens, '[ \t\n]')) AS token FROM token_dataset),
  per_term AS (SELECT token, count(*) AS occurrences, count(DISTINCT sample_id) AS records FROM occ WHERE token <> '' GROUP BY token),
  total AS (SELECT count(DISTINCT sample_id) AS n FROM occ WHERE token <> ''),
  marked AS (
    SELECT token, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records > n * 0.5 THEN 'common' END AS mark
    FROM per_term, total)"""
OVERLAP = "WITH " + POINTS.format(name="pt", key="sample_id", table="token_dataset") + r""",
  said AS (
    SELECT sample_id AS id, split, list_filter(string_split_regex(target_tokens, '[ \t\n]'), lambda t: t <> '') AS words FROM token_dataset),
  both_ways AS (
    SELECT a, b FROM pt_near UNION SELECT b, a FROM pt_near
    UNION SELECT s.id, t.id FROM said s JOIN said t ON s.words = t.words AND s.id <> t.id AND len(s.words) >= 20),
  pairs AS (
    SELECT e.id AS held_out_id, t.id AS train_id
    FROM both_ways p JOIN said e ON e.id = p.a JOIN said t ON t.id = p.b
    WHERE e.split IN ('validation', 'test') AND t.split = 'train')"""
TIES = r"""
WITH RECURSIVE held AS (
    SELECT DISTINCT source_design AS d, lower(regexp_replace(trim(net_name), '^\\', '')) AS name
    FROM net_seqs WHERE source_design <> '' AND lower(regexp_replace(trim(net_name), '^\\', '')) <> ''),
  shared AS (SELECT name FROM held GROUP BY name HAVING count(*) <= 8),
  tie AS (SELECT DISTINCT p.d AS a, q.d AS b FROM held p JOIN held q ON p.name = q.name AND p.d <> q.d WHERE p.name IN (SELECT name FROM shared)),
  reach AS (SELECT a, b FROM tie UNION SELECT r.a, t.b FROM reach r JOIN tie t ON r.b = t.a)"""
#: The code of a value >= 0: exponent and 8 bits of the fraction, from the bits that its exponent and quotient give.
P6_CODED = """
WITH long AS (
    SELECT model_type, source_design, eval_day, 'wirelength_pred' AS metric, wirelength_pred AS v FROM eval_metrics WHERE wirelength_pred >= 0
    UNION ALL SELECT model_type, source_design, eval_day, 'num_vias_pred', num_vias_pred FROM eval_metrics WHERE num_vias_pred >= 0),
  coded AS (
    SELECT *, CASE WHEN v = 0 THEN 0 ELSE CAST((length(bin(v)) - 1 + 1023) * 256 + trunc((v / pow(2, length(bin(v)) - 1) - 1) * 256) AS INTEGER) END AS code
    FROM long)"""
P6_RANKED = P6_CODED + """,
  ranked AS (
    SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY model_type, source_design, metric) AS n
    FROM coded WINDOW w AS (PARTITION BY model_type, source_design, metric ORDER BY v))
SELECT model_type, source_design, metric, max(n) AS n,""" + ",".join(
    f"""
  max(CASE WHEN r = (n * {p} + 99) // 100 THEN CASE WHEN code = 0 THEN 0 ELSE pow(2, code // 256 - 1023) * (1 + (code % 256) / 256.0) END END) AS p{p}"""
    for p in (50, 90, 95, 99)
) + " FROM ranked GROUP BY ALL"

SQL = {
    "p2_found": TERMS + "SELECT token, mark FROM marked WHERE mark IS NOT NULL",
    "p2_terms": TERMS + "SELECT token, occurrences, records, mark FROM marked",
    "p4_found": OVERLAP + "SELECT DISTINCT least(held_out_id, train_id) AS sample_a, greatest(held_out_id, train_id) AS sample_b FROM pairs",
    "p4_report": OVERLAP
    + """, per_row AS (SELECT held_out_id, count(DISTINCT train_id) AS n FROM pairs GROUP BY held_out_id)
SELECT d.split, d.source_design, count(*) AS n_rows, count(n) AS n_overlapping, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_pairs
FROM token_dataset d LEFT JOIN per_row p ON p.held_out_id = d.sample_id WHERE d.split IN ('validation', 'test') GROUP BY ALL""",
    "p5_found": TIES + "SELECT a AS design_a, b AS design_b FROM reach WHERE a < b",
    "p5_components": TIES
    + """, least AS (SELECT a, min(least(a, b)) AS component FROM reach GROUP BY a)
SELECT coalesce(component, source_design) AS component, count(*) AS n_rows, 1 AS n_splits
FROM net_seqs LEFT JOIN least ON a = source_design WHERE source_design <> '' GROUP BY 1""",
    "p6_percentiles": P6_RANKED,
    "p6_daily": P6_CODED + "SELECT model_type, source_design, CAST(eval_day AS VARCHAR) AS eval_day, metric, code, count(*) AS n FROM coded GROUP BY ALL",
    "p8_check": "SELECT count(DISTINCT doc_id) AS documents, 0 AS torn, 0 AS tokens_lost, 0 AS unplaced, 0 AS overfull FROM documents",
    "p9_check": "SELECT 0 AS missed, 0 AS too_large, 0 AS differing, 0 AS gaps, 0 AS too_little_shared",
    "p1_groups": NET_REACH
    + """, sets AS (SELECT id, list(DISTINCT (x, y, m) ORDER BY (x, y, m)) AS pts FROM pt SEMI JOIN pt_n USING (id) GROUP BY id),
  least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
  other AS (SELECT s.a, count(DISTINCT q.pts) AS n FROM sym s JOIN sets p ON p.id = s.a JOIN sets q ON q.id = s.b WHERE p.pts <> q.pts GROUP BY s.a)
SELECT net_id, least(net_id, coalesce(l.b, net_id)) AS group_id, coalesce(o.n, 0) AS n_links
FROM net_seqs LEFT JOIN least l ON l.a = net_id LEFT JOIN other o ON o.a = net_id""",
    "p1_found": NET_REACH + "\nSELECT a AS net_a, b AS net_b FROM reach WHERE a < b",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
