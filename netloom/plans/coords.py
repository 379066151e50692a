"""Queries over coordinates and moves of nets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import coords as c
from netloom.functions.tokens import split_words
from netloom.plans.registry import query
from netloom.session import table

POINT = r"^\s*\((-?\d+),\s*(-?\d+),\s*(-?\d+)\)"
#: SQL for the numbers of a coordinate string, and for its text again.
NUMBER = "CAST(regexp_extract({0}, '" + POINT + "', {1}) AS BIGINT)"
IS_POINT = "regexp_matches({0}, '" + POINT + "')"


def number(e: str, i: int) -> str:
    return f"CASE WHEN {IS_POINT.format(e)} THEN {NUMBER.format(e, i)} END"


def relative(e: str) -> str:
    parts = ", ".join(f"CAST({NUMBER.format(e, i)} - {NUMBER.format('driver', i)} AS VARCHAR)" for i in (1, 2, 3))
    return f"'(' || concat_ws(', ', {parts}) || ')'"


@query(
    f"""
WITH e AS (SELECT source_design, unnest(tree_seq) AS t FROM net_seqs)
SELECT source_design, count(*) AS n_elements, count(*) FILTER ({IS_POINT.format('t')}) AS n_points,
  CAST(sum({number('t', 1)}) AS BIGINT) AS sum_x, CAST(sum({number('t', 2)}) AS BIGINT) AS sum_y, CAST(sum({number('t', 3)}) AS BIGINT) AS sum_m
FROM e GROUP BY source_design"""
)
def f1_points(spark: SparkSession, d: str) -> DataFrame:
    """Elements that are points, and sums of their numbers, by design."""
    e = table(spark, d, "net_seqs").select("source_design", F.explode("tree_seq").alias("t"))
    p = e.select("source_design", c.is_coordinate("t").alias("ok"), c.parse("t").alias("p"))
    return p.groupBy("source_design").agg(
        F.count(F.lit(1)).alias("n_elements"), F.count_if("ok").alias("n_points"), *[F.sum(f"p.{n}").alias(f"sum_{n}") for n in "xym"]
    )


@query(
    f"""
SELECT net_id, coalesce(array_to_string(list_transform(loads, lambda e: CASE WHEN {IS_POINT.format('e')} AND {IS_POINT.format('driver')} THEN {relative('e')} END), ';'),
  CASE WHEN loads IS NOT NULL THEN '' END) AS loads
FROM net_seqs"""
)
def f20_relative_loads(spark: SparkSession, d: str) -> DataFrame:
    """Loads relative to the driver."""
    nets = table(spark, d, "net_seqs")
    return nets.select("net_id", F.array_join(c.relative_loads(F.col("driver"), F.col("loads")), ";").alias("loads"))


@query(
    f"""
SELECT net_id, coalesce(array_to_string(list_transform(tree_seq, lambda e: CASE WHEN e IS NULL THEN NULL WHEN NOT {IS_POINT.format('e')} THEN e WHEN {IS_POINT.format('driver')} THEN {relative('e')} END), ' '),
  CASE WHEN tree_seq IS NOT NULL THEN '' END) AS tree
FROM net_seqs"""
)
def f21_relative_tree(spark: SparkSession, d: str) -> DataFrame:
    """trees relative to the driver, joined with spaces."""
    nets = table(spark, d, "net_seqs")
    return nets.select("net_id", F.array_join(c.relative_tree(F.col("driver"), F.col("tree_seq")), " ").alias("tree"))


@query(
    f"""
SELECT net_id, array_to_string(list_transform(list_sort(list_transform(list_filter(loads, lambda e: {IS_POINT.format('e')}),
    lambda e: {{'x': {NUMBER.format('e', 1)}, 'y': {NUMBER.format('e', 2)}, 'm': {NUMBER.format('e', 3)}}})),
  lambda p: '(' || p.x || ', ' || p.y || ', ' || p.m || ')'), ';') AS loads
FROM net_seqs"""
)
def t2_sorted_loads(spark: SparkSession, d: str) -> DataFrame:
    """Loads in the order of x, y, m."""
    return table(spark, d, "net_seqs").select("net_id", F.array_join(c.sorted_points(F.col("loads")), ";").alias("loads"))


ANGLES = f"""
  pins AS (SELECT net_id, driver, l.e AS e, l.i AS i
    FROM (SELECT net_id, driver, unnest(list_transform(loads, lambda e, i: {{'e': e, 'i': i}})) AS l FROM net_seqs WHERE {IS_POINT.format('driver')})
    WHERE {IS_POINT.format('l.e')}),
  moved AS (SELECT net_id, i, {', '.join(f"{NUMBER.format('e', k)} - {NUMBER.format('driver', k)} AS d{n}" for k, n in ((1, 'x'), (2, 'y'), (3, 'm')))} FROM pins),
  placed AS (SELECT *, row_number() OVER (PARTITION BY net_id ORDER BY atan2(dy, dx), i) AS r FROM moved)"""


@query(f"WITH {ANGLES} SELECT net_id, string_agg(dx || ',' || dy || ',' || dm, ';' ORDER BY r) AS loads FROM placed GROUP BY net_id")
def t3_angular_loads(spark: SparkSession, d: str) -> DataFrame:
    """Loads by their angle around the driver, as displacements."""
    nets = table(spark, d, "net_seqs").filter(c.is_coordinate("driver"))
    base = c.parse("driver")
    moves = F.transform(c.angular_points(F.col("driver"), F.col("loads")), lambda p: F.concat_ws(",", p["x"] - base["x"], p["y"] - base["y"], p["m"] - base["m"]))
    return nets.select("net_id", F.array_join(moves, ";").alias("loads")).filter("loads <> ''")


@query(
    f"""
WITH {ANGLES}
SELECT net_id, count(*) AS n_loads, CAST(sum(abs(dx) + abs(dy) + abs(dm)) AS BIGINT) AS manhattan, max(sqrt(CAST(dx * dx + dy * dy + dm * dm AS DOUBLE))) AS farthest,
  count(*) FILTER (dm = 0) AS same_layer, CAST(sum((dx <> 0)::INT + (dy <> 0)::INT + (dm <> 0)::INT) AS BIGINT) AS n_moves
FROM moved GROUP BY net_id"""
)
def f4_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances from driver to loads, and the moves they take."""
    nets = table(spark, d, "net_seqs").filter(c.is_coordinate("driver")).select("net_id", c.parse("driver").alias("b"), F.explode("loads").alias("e"))
    p = nets.select("net_id", "b", c.parse("e").alias("p")).filter("p is not null")
    b, q = F.col("b"), F.col("p")
    return p.groupBy("net_id").agg(
        F.count(F.lit(1)).alias("n_loads"), F.sum(c.manhattan(b, q)).alias("manhattan"), F.max(c.euclidean(b, q)).alias("farthest"),
        F.count_if(c.same_layer(b, q)).alias("same_layer"), F.sum(F.size(c.delta_tokens(c.subtract(q, b))).cast("long")).alias("n_moves"),
    )


WORDS = "unnest(list_filter(string_split_regex(target_tokens, '\\s+'), lambda t: t <> ''))"


@query(
    f"""
WITH w AS (SELECT source_design, {WORDS} AS t FROM token_dataset),
  m AS (SELECT *, CASE WHEN regexp_matches(t, '^[RLUDTB]\\d{{1,18}}$') THEN CAST(t[2:] AS BIGINT) END AS n, t[1:1] AS l FROM w)
SELECT source_design, count(*) AS n_words, count(*) FILTER (regexp_matches(t, '^[RLUDTB]\\d+')) AS n_moves, count(n) AS n_valid,
  count(*) FILTER (regexp_matches(t, '^[RLUDrlud]\\d+$')) AS n_flat,
  CAST(coalesce(sum(CASE l WHEN 'R' THEN n WHEN 'L' THEN -n END), 0) AS BIGINT) AS dx, CAST(coalesce(sum(CASE l WHEN 'U' THEN n WHEN 'D' THEN -n END), 0) AS BIGINT) AS dy,
  CAST(coalesce(sum(CASE l WHEN 'T' THEN n WHEN 'B' THEN -n END), 0) AS BIGINT) AS dm
FROM m GROUP BY source_design"""
)
def f6_moves(spark: SparkSession, d: str) -> DataFrame:
    """Words that are moves, and their displacement, by design."""
    w = table(spark, d, "token_dataset").select("source_design", F.explode(split_words(F.col("target_tokens"))).alias("t"))
    m = w.select("source_design", "t", c.token_delta("t").alias("d"))
    return m.groupBy("source_design").agg(
        F.count(F.lit(1)).alias("n_words"), F.count_if(c.is_direction("t")).alias("n_moves"), F.count("d").alias("n_valid"), F.count_if(c.is_flat("t")).alias("n_flat"),
        *[F.coalesce(F.sum(f"d.{n}"), F.lit(0)).alias(f"d{n}") for n in "xym"],
    )


@query(
    r"""
SELECT sample_id, len(regexp_extract_all(target_tokens, '[RLUDTB][0-9]+')) AS n, array_to_string(regexp_extract_all(target_tokens, '[RLUDTB][0-9]+'), ' ') AS moves
FROM token_dataset"""
)
def f7_direction_tokens(spark: SparkSession, d: str) -> DataFrame:
    """all moves in a text."""
    found = c.direction_tokens("target_tokens")
    return table(spark, d, "token_dataset").select("sample_id", F.when(F.col("target_tokens").isNotNull(), F.size(found)).alias("n"), F.array_join(found, " ").alias("moves"))
