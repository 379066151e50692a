"""Queries over drawn trees, prefix trees and neighbour blocks, with the SQL that builds the same trees relation by relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import netseq, rewards, trees
from netloom.plans.coords import ANGLES, IS_POINT, NUMBER
from netloom.plans.forests import NET_TREE, _words, f28_routing, m1_text_metrics, m4_repaired, routed, texts
from netloom.plans.registry import attach, query
from netloom.plans.texts import DRIVER_MOVES, FUNNEL, LIST, MOVES, SEGMENTED, TARGETS, TREE
from netloom.session import table

STEP = " ".join(f"WHEN '{up}' THEN '(' || {one} || ')' WHEN '{down}' THEN '(' || {two} || ')'" for (up, down), one, two in (
    ("RL", "t[2:] || ', 0, 0'", "'-' || t[2:] || ', 0, 0'"), ("UD", "'0, ' || t[2:] || ', 0'", "'0, -' || t[2:] || ', 0'"), ("TB", "'0, 0, ' || t[2:]", "'0, 0, -' || t[2:]")
))
#: Nodes of a tree without redundant points, with the parent each keeps; ``pos`` are the nodes before.
KEPT = """
  ch AS (SELECT id, parent, count(*) AS n, min(i) AS child FROM pos WHERE parent IS NOT NULL GROUP BY id, parent),
  tri AS (
    SELECT a.id, a.i, (sign(a.x - p.x) = sign(k.x - a.x) AND sign(a.y - p.y) = sign(k.y - a.y) AND sign(a.m - p.m) = sign(k.m - a.m))
        OR (a.x = p.x AND a.y = p.y AND a.m = p.m) OR (a.x = k.x AND a.y = k.y AND a.m = k.m) AS redundant
    FROM pos a JOIN pos p ON p.id = a.id AND p.i = a.parent JOIN ch ON ch.id = a.id AND ch.parent = a.i AND ch.n = 1 JOIN pos k ON k.id = a.id AND k.i = ch.child),
  mark AS (SELECT a.*, coalesce(t.redundant, false) AS gone FROM pos a LEFT JOIN tri t ON t.id = a.id AND t.i = a.i),
  anc AS (
    SELECT id, i, x, y, m, gone, CAST(NULL AS BIGINT) AS up FROM mark WHERE parent IS NULL
    UNION ALL SELECT k.id, k.i, k.x, k.y, k.m, k.gone, CASE WHEN a.gone THEN a.up ELSE a.i END FROM mark k JOIN anc a ON a.id = k.id AND a.i = k.parent)
SELECT id, i, x, y, m, up AS parent FROM anc WHERE NOT gone"""
#: The simplified tree that target tokens draw.
DRAWN = (
    f"""(WITH RECURSIVE wrd AS (SELECT sample_id, {SEGMENTED.format(LIST.replace('target_tokens', "coalesce(target_tokens, '')"))} AS w FROM token_dataset),
  upto AS (SELECT sample_id, CASE WHEN list_position(w, '<EOS>') > 0 THEN w[1:list_position(w, '<EOS>') - 1] ELSE w END AS w FROM wrd),
  src AS (
    SELECT sample_id, list_prepend('(0, 0, 0)', list_transform(w, lambda t: CASE WHEN t = '<PUSH>' THEN '[BRANCH]' WHEN t = '<POP>' THEN '[END]'
      WHEN regexp_matches(t, '^[RLUDTB][0-9]{{1,18}}$') AND regexp_matches(t, '[1-9]') THEN CASE t[1:1] {STEP} END ELSE 'x' END)) AS moves FROM upto),"""
    + TREE.format(key="sample_id", tree="moves", table="src")
    + """,
  pos AS (
    SELECT id, i, parent, x, y, m FROM nod WHERE parent IS NULL
    UNION ALL SELECT n.id, n.i, n.parent, p.x + n.x, p.y + n.y, p.m + n.m FROM nod n JOIN pos p ON p.id = n.id AND p.i = n.parent),"""
    + KEPT + ")"
)
GIVEN = "(WITH RECURSIVE" + TREE.format(key="sample_id", tree="relative_tree_seq", table="token_dataset") + ",\n  pos AS (SELECT id, i, parent, x, y, m FROM nod)," + KEPT + ")"


def _measured(s: str) -> str:
    """Edges, leaves and sums of the tree ``<s>_sim``."""
    return f"""
  {s}_e AS (SELECT c.id, p.x AS px, p.y AS py, p.m AS pm, c.x, c.y, c.m FROM {s}_sim c JOIN {s}_sim p ON p.id = c.id AND p.i = c.parent),
  {s}_ends AS (SELECT id, x, y, m FROM {s}_e UNION ALL SELECT id, px, py, pm FROM {s}_e),
  {s}_leaf AS (
    SELECT o.id, o.x, o.y, o.m FROM (SELECT id, x, y, m FROM {s}_ends GROUP BY ALL HAVING count(*) = 1) o
    JOIN {s}_sim r ON r.id = o.id AND r.parent IS NULL AND NOT (o.x = r.x AND o.y = r.y AND o.m = r.m)),
  {s}_sum AS (SELECT id, count(*) AS n, sum(abs(x - px) + abs(y - py)) AS w, sum(abs(m - pm) // 2) AS v, sum(abs(m - pm) / 2) AS half FROM {s}_e GROUP BY id),
  {s}_set AS (SELECT DISTINCT * FROM {s}_e), {s}_ns AS (SELECT id, count(*) AS n FROM {s}_set GROUP BY id), {s}_nl AS (SELECT id, count(*) AS n FROM {s}_leaf GROUP BY id)"""


LOADS = f"""
  ld AS (SELECT DISTINCT id, {', '.join(f"{NUMBER.format('e', k)} AS {n}" for k, n in ((1, 'x'), (2, 'y'), (3, 'm')))}
    FROM (SELECT sample_id AS id, unnest(relative_loads) AS e FROM token_dataset) WHERE {IS_POINT.format('e')}),
  nd AS (SELECT id, count(*) AS n FROM ld GROUP BY id),
  met AS (SELECT id, count(*) AS n FROM ld SEMI JOIN p_sim USING (id, x, y, m) GROUP BY id),
  usd AS (SELECT id, count(*) AS n FROM ld SEMI JOIN p_leaf USING (id, x, y, m) GROUP BY id)"""


@query(
    f"""WITH sim AS {DRAWN},
  br AS (SELECT id, sum(n) AS n FROM (SELECT id, count(*) AS n FROM sim WHERE parent IS NOT NULL GROUP BY id, parent) WHERE n > 1 GROUP BY id)
SELECT s.id AS sample_id, string_agg('(' || x || ', ' || y || ', ' || m || ')', ' ' ORDER BY i) AS points, CAST(coalesce(max(br.n), 0) AS BIGINT) AS n_branches
FROM sim s LEFT JOIN br ON br.id = s.id GROUP BY s.id"""
)
def f28_points(spark: SparkSession, d: str) -> DataFrame:
    """Points and branches of the trees that target tokens draw."""
    words = F.regexp_extract_all("routing", F.lit(r"(\([^)]*\)|\[\w+\])"), 1)
    out = f28_routing(spark, d).select("sample_id", words.alias("w"))
    points = F.array_join(F.filter("w", lambda t: t.startswith("(")), " ")
    return out.select("sample_id", points.alias("points"), F.size(F.filter("w", lambda t: t == "[BRANCH]")).cast("long").alias("n_branches"))


@query(
    f"""WITH p_sim AS {DRAWN}, t_sim AS {GIVEN},{_measured('p')},{_measured('t')},{LOADS},
  se AS (SELECT id, count(*) AS n FROM p_set JOIN t_set USING (id, px, py, pm, x, y, m) GROUP BY id),
  sl AS (SELECT id, count(*) AS n FROM p_leaf JOIN t_leaf USING (id, x, y, m) GROUP BY id),
  f AS (SELECT s.sample_id, """
    + ", ".join(f"coalesce({t}.n, 0) AS {t}" for t in "p_ns t_ns se p_nl t_nl sl nd met usd".split())
    + ", "
    + ", ".join(f"coalesce({s}_sum.{c}, 0) AS {s}_{c}" for s in "pt" for c in "nwv")
    + " FROM token_dataset s "
    + " ".join(f"LEFT JOIN {t} ON {t}.id = s.sample_id" for t in "p_ns t_ns se p_nl t_nl sl nd met usd p_sum t_sum".split())
    + """)
SELECT sample_id, p_n AS num_edges_pred, t_n AS num_edges_true, se / greatest(t_ns, 1) AS edge_recall, se / greatest(p_ns, 1) AS edge_precision, se / greatest(p_ns + t_ns - se, 1) AS edge_iou,
  p_nl AS num_leaves_pred, t_nl AS num_leaves_true, sl / greatest(t_nl, 1) AS leaf_recall, sl / greatest(p_nl, 1) AS leaf_precision, sl / greatest(p_nl + t_nl - sl, 1) AS leaf_iou,
  p_nl = sl AND t_nl = sl AS is_leaf_set_match, nd = met AS is_connected_all_loads, nd = met AND usd = p_nl AS is_graceful,
  CAST(p_w AS BIGINT) AS wirelength_pred, CAST(t_w AS BIGINT) AS wirelength_true, CAST(p_v AS BIGINT) AS num_vias_pred, CAST(t_v AS BIGINT) AS num_vias_true,
  CASE WHEN t_w > 0 THEN p_w / t_w WHEN p_w = 0 THEN 1.0 ELSE 0.0 END AS wirelength_ratio, CASE WHEN t_v > 0 THEN p_v / t_v WHEN p_v = 0 THEN 1.0 ELSE 0.0 END AS via_ratio
FROM f"""
)
def m2_drawn(spark: SparkSession, d: str) -> DataFrame:
    """Structure, connection and size of drawn trees against true ones, of all metrics."""
    out = trees.routing_metrics(routed(spark, d), "sample_id", "relative_loads", "pred", "true")
    return out.select(
        "sample_id", "num_edges_pred", "num_edges_true", "edge_recall", "edge_precision", "edge_iou", "num_leaves_pred", "num_leaves_true", "leaf_recall", "leaf_precision",
        "leaf_iou", "is_leaf_set_match", "is_connected_all_loads", "is_graceful", "wirelength_pred", "wirelength_true", "num_vias_pred", "num_vias_true", "wirelength_ratio", "via_ratio",
    )


@query(
    f"""WITH p_sim AS {DRAWN},{_measured('p')},{LOADS},
  f AS (SELECT s.sample_id, trim(coalesce(target_tokens, ''), ' ' || chr(9) || chr(10) || chr(13)) = '' AS empty, coalesce(len(relative_loads), 0) > 0 AS has_loads,
    coalesce(nd.n, 0) AS nd, coalesce(met.n, 0) AS met, coalesce(p_nl.n, 0) AS nl, coalesce(usd.n, 0) AS usd, coalesce(p_sum.w, 0) AS w, coalesce(p_sum.half, 0) AS half
    FROM token_dataset s {" ".join(f"LEFT JOIN {t} ON {t}.id = s.sample_id" for t in ("nd", "met", "p_nl", "usd", "p_sum"))})
SELECT sample_id, CAST(w AS BIGINT) AS wire_pred, CAST(half AS DOUBLE) AS via_pred, nd AS n_loads, met AS n_met, nl AS n_leaves, usd AS n_useful,
  CASE WHEN NOT has_loads THEN 1.0 WHEN empty THEN -1.0 WHEN met = nd THEN 1.0 ELSE -1.0 END AS connectivity,
  CASE WHEN NOT has_loads THEN 1.0 WHEN empty THEN -1.0 WHEN nd > 0 THEN met / nd ELSE 1.0 END AS share_connected,
  CASE WHEN empty OR NOT has_loads THEN -1.0 WHEN met = nd AND usd = nl THEN 1.0 ELSE -1.0 END AS graceful,
  CASE WHEN empty OR NOT has_loads THEN -1.0 WHEN nd > 0 THEN 0.5 * met / nd + 0.5 * CASE WHEN nl > 0 THEN usd / nl ELSE 0 END WHEN nl = 0 THEN 1.0 ELSE 0.0 END AS share_graceful
FROM f"""
)
def m6_connectivity(spark: SparkSession, d: str) -> DataFrame:
    """M7-M9: measures of drawn trees and the rewards for loads met and for leaves that are loads."""
    found = rewards.measures(texts(spark, d), "sample_id", "target_tokens", "made", "relative_loads")
    return found.select(
        "sample_id", "wire_pred", "via_pred", "n_loads", "n_met", "n_leaves", "n_useful", rewards.connectivity().alias("connectivity"), rewards.connectivity(True).alias("share_connected"),
        rewards.graceful().alias("graceful"), rewards.graceful(True).alias("share_graceful"),
    )


@query("SELECT count(*) AS n_rows, 0 AS n_unconnected, 0 AS n_loose, 0 AS n_negative FROM token_dataset")
def m4_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold after repair: all rows, every load met, no end that is no load, no negative cost."""
    out = m4_repaired(spark, d).join(table(spark, d, "token_dataset").select("sample_id", "relative_loads"), "sample_id")
    from netloom.functions.coords import is_coordinate

    wanted = F.exists(F.coalesce("relative_loads", F.array().cast("array<string>")), lambda e: F.coalesce(is_coordinate(e), F.lit(False)))
    costs = [F.col(f"post_{x}_{y}_cost") < 0 for x in ("remove", "add") for y in ("wirelength", "via")]
    return out.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(wanted & ~F.col("post_is_connected_all_loads")).alias("n_unconnected"),
        F.count_if(wanted & ~F.col("post_is_graceful")).alias("n_loose"), F.count_if(costs[0] | costs[1] | costs[2] | costs[3]).alias("n_negative"),
    )


@query(
    f"""
WITH made AS ({TARGETS}),
  pair AS (SELECT s.sample_id AS id, {_words('m.target')} AS t, {_words('s.target_tokens')} AS p FROM token_dataset s LEFT JOIN made m ON m.sample_id = s.sample_id),
  eq AS (SELECT id, len(t) AS nt, len(p) AS np, list_transform(t, lambda a: list_transform(p, lambda b: CASE WHEN a = b THEN 1 ELSE 0 END)) AS e, list_transform(p, lambda b: 0) AS zero FROM pair WHERE t <> p AND len(t) > 0 AND len(p) > 0),
  rows AS (SELECT id, nt, np, list_reduce(list_prepend(zero, e), lambda s, r:
      list_transform(range(1, len(r) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(s[i], coalesce(s[i - 1], 0) + r[i]))))) AS last FROM eq)
SELECT p.id AS sample_id, CASE WHEN p.t = p.p AND len(p.t) > 0 THEN 1.0 ELSE round(coalesce(2 * r.last[-1] / (r.nt + r.np), 0), 9) END AS rougel_f FROM pair p LEFT JOIN rows r ON r.id = p.id"""
)
def m1_rougel(spark: SparkSession, d: str) -> DataFrame:
    """M1: ROUGE-L, whose table of common subsequences SQL builds row by row."""
    return m1_text_metrics(spark, d).select("sample_id", F.round("rougel_f", 9).alias("rougel_f"))


PATHS = NET_TREE + """,
  pth AS (SELECT id, i, '' AS up, x || ',' || y || ',' || m AS path FROM nod WHERE parent IS NULL
    UNION ALL SELECT n.id, n.i, p.path, p.path || '>' || n.x || ',' || n.y || ',' || n.m FROM nod n JOIN pth p ON p.id = n.id AND p.i = n.parent),
  dis AS (SELECT DISTINCT id, path, up FROM pth),
  lds AS (
    SELECT id, count(*) AS n, string_agg('(' || replace(regexp_extract(path, '[^>]*$'), ',', ', ') || ')', ' ' ORDER BY regexp_extract(path, '[^>]*$')) AS loads
    FROM dis a ANTI JOIN (SELECT id, up AS path FROM dis) USING (id, path) GROUP BY id),
  cnt AS (SELECT id, count(*) AS n FROM dis GROUP BY id)"""


@query(
    PATHS
    + """
SELECT CAST(s.net_id AS VARCHAR) AS net_name, s.source_design, CASE WHEN k.n > 1 THEN '(' || r.x || ', ' || r.y || ', ' || r.m || ')' END AS driver, CASE WHEN k.n > 1 THEN cnt.n END AS n_points,
  CASE WHEN k.n > 1 THEN lds.n END AS n_loads, CASE WHEN k.n > 1 THEN lds.loads END AS loads, CASE WHEN k.n = 1 THEN 'no routing' END AS skip_reason
FROM net_seqs s JOIN (SELECT id, count(*) AS n FROM nod GROUP BY id) k ON k.id = s.net_id JOIN nod r ON r.id = s.net_id AND r.parent IS NULL JOIN cnt ON cnt.id = s.net_id JOIN lds ON lds.id = s.net_id"""
)
def g10_prefix_trees(spark: SparkSession, d: str) -> DataFrame:
    """Driver, points and loads of the sequences of raw nets; nets without routing have none."""
    raw = netseq.raw_from_trees(table(spark, d, "net_seqs").withColumn("name", F.col("net_id").cast("string")), "name", "source_design", "tree_seq")
    out = netseq.net_sequences(raw)
    bare = F.array_sort(F.transform("loads", lambda x: F.translate(x, "() ", "")))
    points = F.filter("tree_seq", lambda t: t.startswith("("))
    done = F.col("skip_reason").isNull()
    return out.select(
        "net_name", "source_design", "driver", F.when(done, F.size(points).cast("long")).alias("n_points"), F.when(done, F.size("loads").cast("long")).alias("n_loads"),
        F.when(done, F.array_join(F.transform(bare, lambda x: F.concat(F.lit("("), F.replace(x, F.lit(","), F.lit(", ")), F.lit(")"))), " ")).alias("loads"), "skip_reason",
    )


attach(
    "a3_pattern_counts",
    NET_TREE
    + """,
  par_ AS (SELECT DISTINCT id, parent AS i FROM nod WHERE parent IS NOT NULL),
  up AS (SELECT n.id, n.i AS leaf, n.i FROM nod n ANTI JOIN par_ USING (id, i) WHERE n.parent IS NOT NULL
    UNION ALL SELECT u.id, u.leaf, n.parent FROM up u JOIN nod n ON n.id = u.id AND n.i = u.i WHERE n.parent IS NOT NULL)
SELECT CASE WHEN x = px AND y = py AND m = pm THEN '' WHEN x = px AND y = py THEN CASE WHEN pm < m THEN 'T' ELSE 'B' END || abs(m - pm)
  WHEN x = px THEN CASE WHEN py < y THEN 'U' ELSE 'D' END || abs(y - py) ELSE CASE WHEN px < x THEN 'R' ELSE 'L' END || abs(x - px) END AS pattern, count(*) AS count
FROM up u JOIN edg e ON e.id = u.id AND e.i = u.i GROUP BY pattern"""
)



attach(
    "sel13_available_sequences",
    FUNNEL
    + rf""",
  r AS (SELECT net_id, regexp_replace(replace(replace(usable, '>', '[BRANCH]'), '<', '[END]'), '\((-?\d+),(-?\d+),(-?\d+)\)', '(\1, \2, \3)', 'g') AS restored FROM u),
  l AS (SELECT net_id, unnest(list_transform(regexp_extract_all(restored, '\(-?\d+\s*,\s*-?\d+\s*,\s*-?\d+\)'), lambda e, i: {{'e': e, 'i': i}})) AS p FROM r),
  n AS (SELECT net_id, p.i AS i, {', '.join(f"{NUMBER.format('p.e', k)} AS {c}" for k, c in ((1, 'x'), (2, 'y'), (3, 'm')))} FROM l),
  s AS (SELECT net_id, i, {', '.join(f'{c} - lag({c}) OVER (PARTITION BY net_id ORDER BY i) AS d{c}' for c in 'xym')} FROM n),
  a AS (SELECT net_id, bool_and(i = 1 OR (dx <> 0)::INT + (dy <> 0)::INT + (dm <> 0)::INT = 1) AS ok, string_agg(concat_ws(' ', {MOVES}), ' ' ORDER BY i) FILTER (i > 1) AS w FROM s GROUP BY net_id)
SELECT r.net_id, CASE WHEN ok THEN concat_ws(' ', w, '<EOS>') ELSE '' END AS prediction FROM r LEFT JOIN a ON a.net_id = r.net_id"""
)



def _block(kind: int, name: str) -> str:
    return f"""CASE WHEN len({('overlap', 'connected')[kind]}_info) > 0 THEN concat_ws(' ', '<{name}_START>', (SELECT string_agg(nullif(concat_ws(' ', CASE WHEN i > 1 THEN '<{name}_SEP>' END, item), ''), ' ' ORDER BY i)
      FROM item WHERE item.net_id = n.net_id AND kind = {kind}), '<{name}_END>') END"""


attach(
    "f26_with_neighbours",
    f"""
WITH {ANGLES.replace('pins', 'own_pins').replace('moved', 'own_moved').replace('placed', 'own')},
  nbr AS (
    SELECT net_id AS net, kind, e.i AS i, net_id * 20 + kind * 10 + e.i AS net_id, e.n.driver AS driver, e.n.loads AS loads FROM (
      SELECT net_id, 0 AS kind, unnest(list_transform(overlap_info[1:5], lambda n, i: {{'n': n, 'i': i}})) AS e FROM net_seqs
      UNION ALL SELECT net_id, 1, unnest(list_transform(connected_info[1:5], lambda n, i: {{'n': n, 'i': i}})) FROM net_seqs)),
  {ANGLES.replace('net_seqs', 'nbr')},
  l AS (SELECT net_id, string_agg(concat_ws(' ', '<LOAD>', {MOVES}), ' ' ORDER BY r) AS loads FROM own GROUP BY net_id),
  bl AS (SELECT p.net_id, string_agg(concat_ws(' ', CASE kind WHEN 0 THEN '<OVERLAP_LOAD>' ELSE '<CONNECTED_LOAD>' END, {MOVES}), ' ' ORDER BY r) AS loads FROM placed p JOIN nbr b ON b.net_id = p.net_id GROUP BY p.net_id),
  item AS (
    SELECT b.net AS net_id, kind, i, CASE WHEN {IS_POINT.format('driver')} THEN concat_ws(' ', CASE kind WHEN 0 THEN '<OVERLAP_DRIVER>' ELSE '<CONNECTED_DRIVER>' END, {DRIVER_MOVES}, bl.loads) END AS item
    FROM nbr b LEFT JOIN bl ON bl.net_id = b.net_id)
SELECT n.net_id, concat_ws(' ', '<BOS>', CASE WHEN {IS_POINT.format('driver')} THEN concat_ws(' ', '<DRIVER>', {DRIVER_MOVES}) END, l.loads,
  {_block(0, 'OVERLAP')}, {_block(1, 'CONNECTED')}, '<SRC_END>') AS source
FROM net_seqs n LEFT JOIN l ON l.net_id = n.net_id"""
)
