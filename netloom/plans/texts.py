"""Queries over token texts and their rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import tokens as t
from netloom.operators import trees
from netloom.plans.coords import ANGLES, IS_POINT, NUMBER
from netloom.plans.registry import query
from netloom.session import table

LIST = "list_filter(string_split_regex(target_tokens, '\\s+'), lambda t: t <> '')"
SEGMENTED = "flatten(list_transform({0}, lambda t: CASE WHEN len(regexp_extract_all(t, '[RLUDTB][0-9]+')) > 1 THEN regexp_extract_all(t, '[RLUDTB][0-9]+') ELSE [t] END))"


def words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "token_dataset").filter("target_tokens is not null").select("sample_id", t.split_words(F.col("target_tokens")).alias("w"))


@query(f"SELECT sample_id, array_to_string({SEGMENTED.format(LIST)}, ' ') AS tokens FROM token_dataset WHERE target_tokens IS NOT NULL")
def f9_segmented(spark: SparkSession, d: str) -> DataFrame:
    """tokens of several moves cut apart."""
    return words(spark, d).select("sample_id", F.array_join(t.rewrite(F.col("w"), seg=True), " ").alias("tokens"))


@query(
    f"""
WITH w AS (SELECT sample_id, {SEGMENTED.format(LIST)} AS w FROM token_dataset WHERE target_tokens IS NOT NULL)
SELECT sample_id, array_to_string(flatten(list_transform(w, lambda t:
  CASE WHEN regexp_matches(t, '^[RLUD]\\d+$') AND CAST(t[2:] AS HUGEINT) > 10
    THEN list_filter(list_transform(range(1, length(CAST(CAST(t[2:] AS HUGEINT) AS VARCHAR)) + 1), lambda i:
      CASE WHEN substr(CAST(CAST(t[2:] AS HUGEINT) AS VARCHAR), i, 1) <> '0'
        THEN t[1:1] || rpad(substr(CAST(CAST(t[2:] AS HUGEINT) AS VARCHAR), i, 1), CAST(length(CAST(CAST(t[2:] AS HUGEINT) AS VARCHAR)) - i + 1 AS INTEGER), '0') END), lambda x: x IS NOT NULL)
    ELSE [t] END)), ' ') AS tokens
FROM w"""
)
def f8_decomposed(spark: SparkSession, d: str) -> DataFrame:
    """Moves cut into decimal places."""
    return words(spark, d).select("sample_id", F.array_join(t.rewrite(F.col("w"), decimal=True), " ").alias("tokens"))


@query(
    f"""
WITH w AS (SELECT sample_id, unnest(list_transform({LIST}, lambda t, i: {{'t': t, 'i': i}})) AS x FROM token_dataset WHERE target_tokens IS NOT NULL),
  f AS (SELECT sample_id, x.t AS t, x.i AS i, regexp_matches(x.t, '^[RLUDrlud]\\d+$') AS flat FROM w),
  s AS (SELECT *, CASE WHEN flat AND coalesce(lag(flat) OVER (PARTITION BY sample_id ORDER BY i), false) THEN 0 ELSE 1 END AS fresh FROM f),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY sample_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM s),
  j AS (SELECT sample_id, run, string_agg(t, '' ORDER BY i) AS t FROM g GROUP BY sample_id, run)
SELECT sample_id, string_agg(t, ' ' ORDER BY run) AS tokens FROM j GROUP BY sample_id"""
)
def f10_concatenated(spark: SparkSession, d: str) -> DataFrame:
    """Runs of in-layer moves joined."""
    return words(spark, d).filter("size(w) > 0").select("sample_id", F.array_join(t.rewrite(F.col("w"), concat=True), " ").alias("tokens"))


def _replaced(gap: str) -> str:
    text = "target_tokens"
    for m in t.special_tokens():
        text = f"replace({text}, '{m}', '{gap}')"
    return f"array_to_string(list_filter(string_split_regex({text}, '\\s+'), lambda t: t <> ''), ' ')"


@query(f"SELECT sample_id, {_replaced(' ')} AS spaced, {_replaced('')} AS glued FROM token_dataset WHERE target_tokens IS NOT NULL")
def f13_without_markers(spark: SparkSession, d: str) -> DataFrame:
    """markers removed as substrings, with a space or nothing in their place."""
    text = F.col("target_tokens")
    rows = table(spark, d, "token_dataset").filter("target_tokens is not null")
    return rows.select("sample_id", t.remove_markers(text, t.special_tokens()).alias("spaced"), t.remove_markers(text, t.special_tokens(), "").alias("glued"))


def _move(n: str, up: str, down: str) -> str:
    return f"CASE WHEN {n} > 0 THEN '{up}' || {n} WHEN {n} < 0 THEN '{down}' || (-{n}) END"


MOVES = ", ".join(_move(n, *p) for n, p in (("dx", "RL"), ("dy", "UD"), ("dm", "TB")))
DRIVER_MOVES = ", ".join(_move(NUMBER.format("driver", i), *p) for i, p in ((1, "RL"), (2, "UD"), (3, "TB")))


@query(
    f"""
WITH {ANGLES},
  l AS (SELECT net_id, string_agg(concat_ws(' ', '<LOAD>', {MOVES}), ' ' ORDER BY r) AS loads FROM placed GROUP BY net_id)
SELECT n.net_id, concat_ws(' ', '<BOS>', CASE WHEN {IS_POINT.format('driver')} THEN concat_ws(' ', '<DRIVER>', {DRIVER_MOVES}) END, l.loads, '<SRC_END>') AS source
FROM net_seqs n LEFT JOIN l ON l.net_id = n.net_id"""
)
def f26_source_text(spark: SparkSession, d: str) -> DataFrame:
    """the source sentence of a net."""
    nets = table(spark, d, "net_seqs")
    return nets.select("net_id", F.array_join(t.source_tokens(F.col("driver"), F.col("loads")), " ").alias("source"))


def f26_with_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Source sentences with the blocks of neighbours."""
    nets = table(spark, d, "net_seqs")
    full = t.source_tokens(F.col("driver"), F.col("loads"), F.col("overlap_info"), F.col("connected_info"))
    return nets.select("net_id", F.array_join(full, " ").alias("source"))


query()(f26_with_neighbours)

#: Tokens of a tree column with kind, point, open branches and parent, by window sums and the range in which a node stays current.
PARSED = r"""
  tok AS (SELECT id, x.i AS i, x.t AS t FROM (SELECT {key} AS id, unnest(list_transform({tree}, lambda t, i: {{'t': t, 'i': i}})) AS x FROM {table})),
  knd AS (
    SELECT id, i, t, CASE WHEN t = '[BRANCH]' THEN 'B' WHEN t = '[END]' THEN 'E' WHEN regexp_matches(t, '^\s*\(-?\d+,\s*-?\d+,\s*-?\d+\)') THEN 'C' ELSE 'N' END AS k FROM tok),
  sm AS (SELECT *, sum(CASE k WHEN 'B' THEN 1 WHEN 'E' THEN -1 ELSE 0 END) OVER w AS s FROM knd WINDOW w AS (PARTITION BY id ORDER BY i)),
  lvl AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY id ORDER BY i)) AS lv FROM sm),
  pt AS (
    SELECT id, i, lv, CAST(regexp_extract(t, '^\s*\((-?\d+),\s*(-?\d+),\s*(-?\d+)\)', 1) AS BIGINT) AS x, CAST(regexp_extract(t, '^\s*\((-?\d+),\s*(-?\d+),\s*(-?\d+)\)', 2) AS BIGINT) AS y,
      CAST(regexp_extract(t, '^\s*\((-?\d+),\s*(-?\d+),\s*(-?\d+)\)', 3) AS BIGINT) AS m
    FROM lvl WHERE k = 'C'),
  fin AS (SELECT p.id, p.i, coalesce(min(l.i), 1000000000) AS until FROM pt p LEFT JOIN lvl l ON l.id = p.id AND l.i > p.i AND l.lv < p.lv GROUP BY p.id, p.i),
  par AS (SELECT p.id, p.i, max(f.i) AS parent FROM pt p JOIN fin f ON f.id = p.id AND f.i < p.i AND f.until > p.i GROUP BY p.id, p.i)"""
#: Nodes of the tree proper: of several roots only the first keeps its nodes.
TREE = PARSED + """,
  cut AS (
    SELECT id, min(i) AS i FROM (
      SELECT p.id, p.i, row_number() OVER (PARTITION BY p.id ORDER BY p.i) AS r FROM pt p LEFT JOIN par q ON q.id = p.id AND q.i = p.i WHERE q.parent IS NULL)
    WHERE r > 1 GROUP BY id),
  nod AS (
    SELECT p.*, q.parent FROM pt p LEFT JOIN par q ON q.id = p.id AND q.i = p.i LEFT JOIN cut c ON c.id = p.id WHERE c.i IS NULL OR p.i < c.i),
  edg AS (SELECT c.id, c.i, p.i AS pi, p.x AS px, p.y AS py, p.m AS pm, c.x, c.y, c.m FROM nod c JOIN nod p ON p.id = c.id AND p.i = c.parent)"""


TARGETS = (
    "WITH "
    + PARSED.format(key="sample_id", tree="relative_tree_seq", table="token_dataset")
    + f""",
  d AS (SELECT p.id, p.i, p.x - coalesce(q.x, 0) AS dx, p.y - coalesce(q.y, 0) AS dy, p.m - coalesce(q.m, 0) AS dm
    FROM pt p LEFT JOIN par r ON r.id = p.id AND r.i = p.i LEFT JOIN pt q ON q.id = p.id AND q.i = r.parent),
  w AS (SELECT l.id, l.i, CASE l.k WHEN 'B' THEN '<PUSH>' WHEN 'E' THEN '<POP>' ELSE nullif(concat_ws(' ', {MOVES}), '') END AS w FROM lvl l LEFT JOIN d ON d.id = l.id AND d.i = l.i),
  a AS (SELECT id, string_agg(w, ' ' ORDER BY i) AS w FROM w GROUP BY id),
  o AS (SELECT id, arg_max(lv, i) AS lv FROM lvl GROUP BY id)
SELECT s.sample_id, concat_ws(' ', a.w, CASE WHEN o.lv > 0 THEN rtrim(repeat('<POP> ', CAST(o.lv AS INTEGER))) END, '<EOS>') AS target
FROM token_dataset s LEFT JOIN a ON a.id = s.sample_id LEFT JOIN o ON o.id = s.sample_id WHERE s.relative_tree_seq IS NOT NULL"""
)


@query(TARGETS)
def f27_target_text(spark: SparkSession, d: str) -> DataFrame:
    """The moves that draw a relative tree."""
    rows = table(spark, d, "token_dataset").filter("relative_tree_seq is not null")
    return trees.target_tokens(rows, "sample_id", "relative_tree_seq").select("sample_id", F.array_join("target", " ").alias("target"))


@query("SELECT sample_id, concat_ws(' ', source_tokens, target_tokens) AS text, length(concat_ws(' ', source_tokens, target_tokens)) AS n_chars FROM token_dataset")
def f30_training_text(spark: SparkSession, d: str) -> DataFrame:
    """source and target in one text."""
    text = t.training_text(F.col("source_tokens"), F.col("target_tokens"))
    return table(spark, d, "token_dataset").select("sample_id", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


@query(
    f"""
SELECT net_id, replace('{t.INSTRUCTION.replace("'", "''")}' || chr(10) || 'Driver: ' || driver || chr(10) || 'Loads: ' || array_to_string(loads, ';'), ', ', ',') AS prompt,
  replace(replace(replace(array_to_string(tree_seq, ''), ', ', ','), '[BRANCH]', '>'), '[END]', '<') AS completion
FROM net_seqs"""
)
def f31_prompts(spark: SparkSession, d: str) -> DataFrame:
    """prompts and completions."""
    nets = table(spark, d, "net_seqs")
    return nets.select("net_id", t.sft_prompt(F.col("driver"), F.col("loads")).alias("prompt"), t.sft_completion(F.col("tree_seq")).alias("completion"))


COMPLETION = "coalesce(replace(replace(replace(array_to_string(tree_seq, ''), ', ', ','), '[BRANCH]', '>'), '[END]', '<'), '')"
FUNNEL = (
    f"""
WITH c AS (SELECT net_id, source_design, {COMPLETION} AS c FROM net_seqs),
  k AS (SELECT *, CASE WHEN instr(c, ')') > 0 THEN regexp_extract(c, '(?s)^(.*\\))', 1) ELSE c END AS tail FROM c),
  p AS (SELECT *, regexp_replace(regexp_replace(tail, '^\\s+', ''), '\\s+$', '') AS stripped FROM k),
  q AS (SELECT *, CASE WHEN regexp_matches(stripped, '^[0-9,()<>\\s]*$') THEN stripped ELSE '' END AS pure FROM p),
  u AS (SELECT *, CASE WHEN len(list_filter(regexp_extract_all(pure, '\\(-?\\d+,\\s*-?\\d+,\\s*-?\\d+\\)'), lambda x: regexp_matches(x, '[(,\\s](-?0\\d|-0[,)])'))) > 0 THEN '' ELSE pure END AS usable FROM q)"""
)


def completions(spark: SparkSession, d: str) -> DataFrame:
    nets = table(spark, d, "net_seqs").select("net_id", "source_design", F.coalesce(t.sft_completion(F.col("tree_seq")), F.lit("")).alias("c"))
    tail = nets.withColumn("tail", t.cut_tail(F.col("c")))
    return tail.withColumn("pure", t.pure(F.col("tail"))).withColumn("usable", t.complete(F.col("pure")))


@query(
    FUNNEL
    + r"""
SELECT net_id, tail, pure, usable,
  regexp_replace(replace(replace(usable, '>', '[BRANCH]'), '<', '[END]'), '\((-?\d+),(-?\d+),(-?\d+)\)', '(\1, \2, \3)', 'g') AS restored
FROM u"""
)
def sel10_usable_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Completions through the filters, and restored."""
    return completions(spark, d).select("net_id", "tail", "pure", "usable", t.restore(F.col("usable")).alias("restored"))


@query(
    FUNNEL
    + """
SELECT source_design, count(*) AS n_rows, count(*) FILTER (tail <> '') AS n_tail, count(*) FILTER (pure <> '') AS n_pure, count(*) FILTER (usable <> '') AS n_usable,
  count(*) FILTER (usable <> '') / nullif(count(*) FILTER (pure <> ''), 0) AS retained, count(*) FILTER (usable <> '') / count(*) AS overall
FROM u GROUP BY source_design"""
)
def a21_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Rows left after each filter, by design."""
    full = lambda c: F.count_if(F.col(c) != "")
    out = completions(spark, d).groupBy("source_design").agg(
        F.count(F.lit(1)).alias("n_rows"), full("tail").alias("n_tail"), full("pure").alias("n_pure"), full("usable").alias("n_usable")
    )
    return out.withColumns({"retained": F.try_divide(F.col("n_usable"), F.col("n_pure")), "overall": F.col("n_usable") / F.col("n_rows")})


def sel13_available_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Usable sequences whose steps are on one axis, as moves from their first point.

    Branch marks are lost on the way to the check, as they are no longer ``<`` and ``>`` after restoring: branched nets become
    chains there.
    """
    rows = sel10_usable_sequences(spark, d)
    points = F.regexp_extract_all("restored", F.lit(r"(\(-?\d+\s*,\s*-?\d+\s*,\s*-?\d+\))"), 1)
    from netloom.functions.coords import parse

    p = rows.select("net_id", F.transform(points, parse).alias("p"))
    ok = p.withColumn("available", (F.size("p") > 0) & t.chain_steps_valid(F.col("p")))
    moved = ok.withColumn("tree", F.when(F.col("available"), t.rebased(F.col("p"))))
    out = trees.target_tokens(moved.select("net_id", "tree"), "net_id", "tree")
    return out.select("net_id", F.coalesce(F.array_join("target", " "), F.lit("")).alias("prediction"))


query()(sel13_available_sequences)


@query(
    """
SELECT model_type, params_m, split_part(model_type, '-', 1) AS base, CASE WHEN contains(model_type, '-') THEN regexp_replace(model_type, '^[^-]*-', '') ELSE '' END AS variant,
  CASE WHEN params_m >= 1000 THEN model_type || '-' || (params_m // 1000) || 'K' ELSE model_type || '-' || params_m END AS alias
FROM eval_models"""
)
def f36_variants(spark: SparkSession, d: str) -> DataFrame:
    """names of models and their parts."""
    m = F.col("model_type")
    return table(spark, d, "eval_models").select(m, "params_m", t.base_of(m).alias("base"), t.variant_of(m).alias("variant"), t.variant_alias(m, F.col("params_m")).alias("alias"))


@query(
    r"""
WITH x AS (SELECT doc_id, regexp_extract(text, '(\d+:\d\d:\d\d(\.\d+)?)', 1) AS t FROM documents)
SELECT doc_id, t AS time, CAST(split_part(t, ':', 1) AS DOUBLE) * 3600 + CAST(split_part(t, ':', 2) AS DOUBLE) * 60 + CAST(split_part(t, ':', 3) AS DOUBLE) AS seconds
FROM x WHERE t <> ''"""
)
def f39_seconds(spark: SparkSession, d: str) -> DataFrame:
    """the first time of day in a document, in seconds."""
    x = table(spark, d, "documents").select("doc_id", F.regexp_extract("text", r"(\d+:\d\d:\d\d(\.\d+)?)", 1).alias("time")).filter("time <> ''")
    return x.withColumn("seconds", t.seconds(F.col("time")))
