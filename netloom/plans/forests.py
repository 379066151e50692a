"""Queries over coordinate trees, predictions and their repair."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import coords as c
from netloom.functions.tokens import rectilinear
from netloom.operators import netseq, rewards, text_metrics, trees
from netloom.operators.arrow import spread
from netloom.operators.repair import repair_trees
from netloom.plans.coords import IS_POINT, relative
from netloom.plans.registry import query
from netloom.plans.texts import TARGETS, TREE
from netloom.session import table

NET_TREE = "WITH RECURSIVE " + TREE.format(key="net_id", tree="tree_seq", table="net_seqs")


@query(
    NET_TREE
    + """,
  dep AS (SELECT id, i, 0 AS depth FROM nod WHERE parent IS NULL UNION ALL SELECT n.id, n.i, d.depth + 1 FROM nod n JOIN dep d ON d.id = n.id AND d.i = n.parent),
  dd AS (SELECT id, max(depth) AS max_depth FROM dep GROUP BY id),
  ch AS (SELECT id, parent, count(*) AS n FROM nod WHERE parent IS NOT NULL GROUP BY id, parent),
  br AS (SELECT id, sum(n) AS n_branches FROM ch WHERE n > 1 GROUP BY id),
  ends AS (SELECT id, x, y, m FROM edg UNION ALL SELECT id, px, py, pm FROM edg),
  one AS (SELECT id, x, y, m FROM ends GROUP BY ALL HAVING count(*) = 1),
  lf AS (SELECT o.id, count(*) AS n_leaves FROM one o JOIN nod r ON r.id = o.id AND r.parent IS NULL AND NOT (o.x = r.x AND o.y = r.y AND o.m = r.m) GROUP BY o.id),
  e AS (SELECT id, count(*) AS n_edges, sum(abs(x - px) + abs(y - py)) AS wirelength, sum(abs(m - pm) // 2) AS vias FROM edg GROUP BY id),
  n AS (SELECT id, count(*) AS n_nodes FROM nod GROUP BY id)
SELECT s.net_id, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_edges, 0) AS n_edges, coalesce(n_leaves, 0) AS n_leaves, CAST(coalesce(n_branches, 0) AS BIGINT) AS n_branches,
  coalesce(max_depth, 0) AS max_depth, CAST(coalesce(wirelength, 0) AS BIGINT) AS wirelength, CAST(coalesce(vias, 0) AS BIGINT) AS vias
FROM net_seqs s LEFT JOIN n ON n.id = s.net_id LEFT JOIN e ON e.id = s.net_id LEFT JOIN lf ON lf.id = s.net_id LEFT JOIN br ON br.id = s.net_id LEFT JOIN dd ON dd.id = s.net_id"""
)
def g1_tree_shape(spark: SparkSession, d: str) -> DataFrame:
    """Nodes, edges, leaves, branches, depth, wire and vias of every net."""
    return trees.tree_shape(table(spark, d, "net_seqs"), "net_id", "tree_seq")


@query(
    NET_TREE
    + """
SELECT s.net_id, coalesce(string_agg(px || ',' || py || ',' || pm || '>' || x || ',' || y || ',' || m, ' ' ORDER BY i), '') AS edges
FROM net_seqs s LEFT JOIN edg e ON e.id = s.net_id GROUP BY s.net_id"""
)
def g4_tree_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of every net in pre-order."""
    text = lambda p: F.concat_ws(",", p["x"], p["y"], p["m"])
    edges = F.transform("edges", lambda e: F.concat(text(e["s"]), F.lit(">"), text(e["e"])))
    return trees.tree_edges(table(spark, d, "net_seqs"), "net_id", "tree_seq").select("net_id", F.array_join(edges, " ").alias("edges"))


@query(
    NET_TREE
    + """
SELECT id AS net_id, count(*) AS n_edges, count(*) FILTER ((x <> px)::INT + (y <> py)::INT + (m <> pm)::INT <= 1) AS n_rectilinear FROM edg GROUP BY id"""
)
def sel14_rectilinear(spark: SparkSession, d: str) -> DataFrame:
    """Edges that differ on at most one axis."""
    e = trees.tree_edges(table(spark, d, "net_seqs"), "net_id", "tree_seq").select("net_id", F.explode("edges").alias("e"))
    return e.groupBy("net_id").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(rectilinear(F.col("e.s"), F.col("e.e"))).alias("n_rectilinear"))


@query(
    NET_TREE
    + """,
  ch AS (SELECT id, parent, count(*) AS n, min(i) AS child FROM nod WHERE parent IS NOT NULL GROUP BY id, parent),
  tri AS (
    SELECT a.id, a.i, sign(a.x - p.x) = sign(k.x - a.x) AND sign(a.y - p.y) = sign(k.y - a.y) AND sign(a.m - p.m) = sign(k.m - a.m)
        OR (a.x = p.x AND a.y = p.y AND a.m = p.m) OR (a.x = k.x AND a.y = k.y AND a.m = k.m) AS redundant
    FROM nod a JOIN nod p ON p.id = a.id AND p.i = a.parent JOIN ch ON ch.id = a.id AND ch.parent = a.i AND ch.n = 1 JOIN nod k ON k.id = a.id AND k.i = ch.child)
SELECT s.net_id, coalesce(string_agg('(' || n.x || ', ' || n.y || ', ' || n.m || ')', ' ' ORDER BY n.i) FILTER (NOT coalesce(redundant, false)), '') AS points,
  CAST(coalesce((SELECT sum(n) FROM ch WHERE ch.id = s.net_id AND ch.n > 1), 0) AS BIGINT) AS n_branches
FROM net_seqs s LEFT JOIN nod n ON n.id = s.net_id LEFT JOIN tri t ON t.id = n.id AND t.i = n.i GROUP BY s.net_id"""
)
def g2_simplified(spark: SparkSession, d: str) -> DataFrame:
    """Simplified trees: their points in order, and how many branches they have."""
    out = trees.simplify(table(spark, d, "net_seqs"), "net_id", "tree_seq")
    points = F.filter("simplified", lambda t: ~t.isin("[BRANCH]", "[END]"))
    branches = F.size(F.filter("simplified", lambda t: t == "[BRANCH]")).cast("long")
    return out.select("net_id", F.array_join(points, " ").alias("points"), branches.alias("n_branches"))


def routed(spark: SparkSession, d: str) -> DataFrame:
    """Each sample with the tree its target tokens draw, and its true relative tree, both simplified."""
    rows = spread(table(spark, d, "token_dataset").select("sample_id", "relative_loads", "relative_tree_seq", "target_tokens"))
    source = rows.select("sample_id", "relative_loads", "relative_tree_seq", trees.move_tokens(F.col("target_tokens")).alias("moves"))
    return trees.drawn_and_true(source, "sample_id", "moves", "relative_tree_seq", ["relative_loads"])


@query()
def f28_routing(spark: SparkSession, d: str) -> DataFrame:
    """The trees that target tokens draw."""
    out = trees.routing(table(spark, d, "token_dataset"), "sample_id", "target_tokens")
    return out.select("sample_id", F.array_join("routing", " ").alias("routing"))


@query()
def m2_routing_metrics(spark: SparkSession, d: str) -> DataFrame:
    """All metrics of drawn trees against true ones."""
    return trees.routing_metrics(routed(spark, d), "sample_id", "relative_loads", "pred", "true")


@query()
def m4_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Repaired trees and their costs, with the metrics after repair."""
    fixed = repair_trees(routed(spark, d), "sample_id", "pred", "relative_loads", ["relative_loads", "true"])
    costs = [f"post_{x}_{y}_cost" for x in ("remove", "add") for y in ("wirelength", "via")]
    after = trees.routing_metrics(fixed, "sample_id", "relative_loads", "post_tree_seq", "true", "post_", ["post_tree_seq", *costs])
    return after.withColumn("post_tree_seq", F.array_join("post_tree_seq", " "))


def _side(letter: str, tree: str) -> str:
    """The tree's named subqueries with a prefix, and its sets of edges and leaves."""
    names = "tok|knd|sm|lvl|pt|fin|par|cut|nod|edg"
    text = TREE.format(key="sample_id", tree=tree, table="src")
    text = re.sub(rf"\b({names})\b(?=\s+(AS \(|[a-z] |WHERE|GROUP|LEFT|JOIN|WINDOW|\)|,))|(?<=FROM )\b({names})\b|(?<=JOIN )\b({names})\b", lambda m: f"{letter}_{m.group(0)}", text)
    return (
        text
        + f""",
  {letter}_ends AS (SELECT id, x, y, m FROM {letter}_edg UNION ALL SELECT id, px, py, pm FROM {letter}_edg),
  {letter}_leaf AS (
    SELECT o.id, o.x, o.y, o.m FROM (SELECT id, x, y, m FROM {letter}_ends GROUP BY ALL HAVING count(*) = 1) o
    JOIN {letter}_nod r ON r.id = o.id AND r.parent IS NULL AND NOT (o.x = r.x AND o.y = r.y AND o.m = r.m)),
  {letter}_set AS (SELECT DISTINCT id, px, py, pm, x, y, m FROM {letter}_edg),
  {letter}_sum AS (SELECT id, count(*) AS n, sum(abs(x - px) + abs(y - py)) AS w, sum(abs(m - pm) // 2) AS v FROM {letter}_edg GROUP BY id)"""
    )


TRUE_TREE = f"list_transform(tree_seq, lambda e: CASE WHEN e IS NULL THEN NULL WHEN NOT {IS_POINT.format('e')} THEN e ELSE {relative('e')} END)"
SHARED = """
  {0}s AS (SELECT s.sample_id AS id, (SELECT count(*) FROM p_{1} p WHERE p.id = s.sample_id) AS np, (SELECT count(*) FROM t_{1} t WHERE t.id = s.sample_id) AS nt,
    (SELECT count(*) FROM p_{1} p JOIN t_{1} t USING ({2}) WHERE p.id = s.sample_id) AS nb FROM src s)"""


@query(
    f"WITH src AS (SELECT *, {TRUE_TREE} AS true_tree FROM token_dataset WHERE {IS_POINT.format('driver')}), "
    + _side("p", "relative_tree_seq") + ", " + _side("t", "true_tree") + ", " + SHARED.format("e", "set", "id, px, py, pm, x, y, m") + ", " + SHARED.format("l", "leaf", "id, x, y, m")
    + """
SELECT s.sample_id, coalesce(s.relative_tree_seq, []) = coalesce(s.true_tree, []) AS is_perfect_match, coalesce(p.n, 0) AS num_edges_pred, coalesce(t.n, 0) AS num_edges_true,
  e.nb / greatest(e.nt, 1) AS edge_recall, e.nb / greatest(e.np, 1) AS edge_precision, e.nb / greatest(e.np + e.nt - e.nb, 1) AS edge_iou,
  l.np AS num_leaves_pred, l.nt AS num_leaves_true, l.nb / greatest(l.np + l.nt - l.nb, 1) AS leaf_iou, l.np = l.nb AND l.nt = l.nb AS is_leaf_set_match,
  CAST(coalesce(p.w, 0) AS BIGINT) AS wirelength_pred, CAST(coalesce(t.w, 0) AS BIGINT) AS wirelength_true, CAST(coalesce(p.v, 0) AS BIGINT) AS num_vias_pred, CAST(coalesce(t.v, 0) AS BIGINT) AS num_vias_true
FROM src s JOIN es e ON e.id = s.sample_id JOIN ls l ON l.id = s.sample_id LEFT JOIN p_sum p ON p.id = s.sample_id LEFT JOIN t_sum t ON t.id = s.sample_id"""
)
def m2_structure(spark: SparkSession, d: str) -> DataFrame:
    """Structural metrics of the stored relative trees against those made from the absolute ones."""
    rows = table(spark, d, "token_dataset").filter(c.is_coordinate("driver"))
    both = rows.select("sample_id", "relative_loads", "relative_tree_seq", c.relative_tree(F.col("driver"), F.col("tree_seq")).alias("true_tree"))
    out = trees.routing_metrics(both, "sample_id", "relative_loads", "relative_tree_seq", "true_tree")
    return out.select(
        "sample_id", "is_perfect_match", "num_edges_pred", "num_edges_true", "edge_recall", "edge_precision", "edge_iou", "num_leaves_pred", "num_leaves_true", "leaf_iou",
        "is_leaf_set_match", "wirelength_pred", "wirelength_true", "num_vias_pred", "num_vias_true",
    )


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Each sample's tokens and those that its true tree gives."""
    rows = spread(table(spark, d, "token_dataset").select("sample_id", "target_tokens", "relative_loads", "relative_tree_seq"))
    made = trees.target_tokens(rows, "sample_id", "relative_tree_seq", keep=["target_tokens", "relative_loads"])
    return made.select("sample_id", "target_tokens", "relative_loads", F.array_join("target", " ").alias("made"))


@query()
def m1_text_metrics(spark: SparkSession, d: str) -> DataFrame:
    """M1: BLEU and ROUGE of target tokens against those of the true tree."""
    return text_metrics.text_metrics(texts(spark, d), "sample_id", "made", "target_tokens")


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '\\s+'), lambda t: t <> '')"


def _grams(side: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT id, {n} AS n, unnest(list_transform(range(1, len({side}) - {n} + 2), lambda i: array_to_string({side}[i:i + {n - 1}], ' '))) AS g FROM pair" for n in range(1, 5)
    )
    return f"{side}_g AS (SELECT id, n, g, count(*) AS c FROM ({parts}) GROUP BY ALL)"


def _bleu(n: int) -> str:
    logs = " + ".join(f"ln(CASE WHEN s{i} > 0 THEN s{i} ELSE 0.1 END / greatest(np - {i - 1}, 1))" for i in range(1, n + 1))
    return f"CASE WHEN nt > 0 AND np > 0 AND s1 > 0 THEN round(exp(CASE WHEN np > nt THEN 0 ELSE 1 - nt / np END + ({logs}) / {n}), 9) ELSE 0 END AS bleu_{n}"


@query(
    f"""
WITH made AS ({TARGETS}),
  pair AS (SELECT s.sample_id AS id, {_words('m.target')} AS t, {_words('s.target_tokens')} AS p, trim(coalesce(m.target, ''), ' \t\n\r') = trim(coalesce(s.target_tokens, ''), ' \t\n\r') AS same
    FROM token_dataset s LEFT JOIN made m ON m.sample_id = s.sample_id),
  {_grams('t')}, {_grams('p')},
  sh AS (SELECT id, {', '.join(f'coalesce(sum(least(a.c, b.c)) FILTER (n = {i}), 0) AS s{i}' for i in range(1, 5))} FROM t_g a JOIN p_g b USING (id, n, g) GROUP BY id),
  f AS (SELECT b.id, same, len(t) AS nt, len(p) AS np, {', '.join(f'coalesce(s{i}, 0) AS s{i}' for i in range(1, 5))} FROM pair b LEFT JOIN sh ON sh.id = b.id)
SELECT id AS sample_id, round(CASE WHEN s1 > 0 THEN 2 * s1 / (nt + np) ELSE 0 END, 9) AS rouge1_f, round(CASE WHEN s2 > 0 THEN 2 * s2 / (nt + np - 2) ELSE 0 END, 9) AS rouge2_f,
  {_bleu(1)}, {_bleu(2)}, {_bleu(4)}, CAST(same AS DOUBLE) AS exact_match FROM f""".replace("' \\t\\n\\r'", "' ' || chr(9) || chr(10) || chr(13)").replace("' \t\n\r'", "' ' || chr(9) || chr(10) || chr(13)")
)
def m1_ngram_metrics(spark: SparkSession, d: str) -> DataFrame:
    """M1: the metrics of token runs, which SQL can count."""
    out = m1_text_metrics(spark, d).drop("rougel_f")
    return out.select("sample_id", *[F.round(n, 9).alias(n) for n in ("rouge1_f", "rouge2_f", "bleu_1", "bleu_2", "bleu_4")], "exact_match")


@query()
def m6_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Every reward of a sample's tokens."""
    found = rewards.measures(texts(spark, d), "sample_id", "target_tokens", "made", "relative_loads")
    return found.select("sample_id", *[rewards.reward(n).alias(n) for n in rewards.REWARDS])


@query()
def g10_net_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of raw nets, and why some have none."""
    raw = netseq.raw_from_trees(table(spark, d, "net_seqs").withColumn("name", F.col("net_id").cast("string")), "name", "source_design", "tree_seq")
    out = netseq.net_sequences(raw)
    join = lambda c_: F.array_join(c_, " ")
    return out.select("source_design", "net_name", "driver", join("loads").alias("loads"), join("tree_seq").alias("tree_seq"), join(F.flatten("patterns")).alias("patterns"), "skip_reason")


@query()
def a3_pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    """A3: how often each pin-to-pin pattern occurs."""
    raw = netseq.raw_from_trees(table(spark, d, "net_seqs").withColumn("name", F.col("net_id").cast("string")), "name", "source_design", "tree_seq")
    return netseq.patterns_of(netseq.net_sequences(raw))


@query(
    r"""
WITH l AS (SELECT sample_id, unnest(list_distinct(relative_loads)) AS e FROM token_dataset),
  n AS (SELECT sample_id, unnest(list_distinct(relative_tree_seq)) AS e FROM token_dataset)
SELECT l.sample_id, count(*) AS n_loads, count(n.e) AS n_met, count(*) - count(n.e) AS n_missing
FROM l LEFT JOIN n ON n.sample_id = l.sample_id AND n.e = l.e WHERE l.e IS NOT NULL GROUP BY l.sample_id"""
)
def j11_unconnected_loads(spark: SparkSession, d: str) -> DataFrame:
    """Loads that are points of the tree, and those that are not."""
    rows = table(spark, d, "token_dataset")
    loads = F.filter(F.array_distinct("relative_loads"), lambda e: e.isNotNull())
    nodes = F.coalesce("relative_tree_seq", F.array().cast("array<string>"))
    sizes = [F.size(loads).cast("long").alias("n_loads"), F.size(F.array_intersect(loads, nodes)).cast("long").alias("n_met"), F.size(F.array_except(loads, nodes)).cast("long").alias("n_missing")]
    return rows.select("sample_id", *sizes).filter("n_loads > 0")


@query(
    f"""
WITH l AS (SELECT net_id, unnest(list_distinct(loads)) AS e, tree_seq FROM net_seqs),
  p AS (SELECT net_id, unnest(tree_seq) AS t FROM net_seqs),
  q AS (SELECT DISTINCT net_id, {", ".join(f"CAST(regexp_extract(t, '{c.COORDINATE}', {i}) AS BIGINT) AS {n}" for i, n in enumerate('xym', 1))} FROM p WHERE regexp_matches(t, '{c.COORDINATE}')),
  k AS (SELECT net_id, {", ".join(f"CAST(regexp_extract(e, '{c.COORDINATE}', {i}) AS BIGINT) AS {n}" for i, n in enumerate('xym', 1))} FROM l WHERE regexp_matches(e, '{c.COORDINATE}'))
SELECT k.net_id, k.x || ',' || k.y || ',' || k.m AS load, min(abs(k.x - q.x) + abs(k.y - q.y) + abs(k.m - q.m)) AS distance
FROM (SELECT DISTINCT * FROM k) k JOIN q ON q.net_id = k.net_id GROUP BY ALL"""
)
def j12_nearest_node(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each load to the nearest point of its tree."""
    from netloom.operators.spatial import nearest

    points = lambda a: F.array_distinct(F.filter(F.transform(a, c.parse), lambda p: p.isNotNull()))
    rows = table(spark, d, "net_seqs").select("net_id", points("tree_seq").alias("nodes"), F.explode(points("loads")).alias("p"))
    p = F.col("p")
    return rows.filter("size(nodes) > 0").select("net_id", F.concat_ws(",", p["x"], p["y"], p["m"]).alias("load"), nearest(p, F.col("nodes"))["distance"].alias("distance"))
