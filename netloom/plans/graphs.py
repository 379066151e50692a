"""Queries over design graphs and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import spatial
from netloom.plans.coords import IS_POINT, NUMBER
from netloom.plans.registry import query
from netloom.session import stored, table

PINS = f"""
  pin AS (SELECT net_id, source_design, unnest(list_append(loads, driver)) AS e FROM net_seqs),
  box AS (
    SELECT net_id, source_design, {', '.join(f"{f}({NUMBER.format('e', i)}) AS {n}{k}" for k, f in ((1, 'min'), (2, 'max')) for i, n in enumerate('xym', 1))}
    FROM pin WHERE {IS_POINT.format('e')} GROUP BY net_id, source_design)"""
MEET = " AND ".join(f"least(p.{n}2, q.{n}2) >= greatest(p.{n}1, q.{n}1)" for n in "xym")
SIDES = [f"greatest(0, least(p.{n}2, q.{n}2) - greatest(p.{n}1, q.{n}1))" for n in "xym"]
VOLUME = f"CAST(CASE WHEN {SIDES[2]} > 0 THEN {SIDES[0]} * {SIDES[1]} * {SIDES[2]} ELSE {SIDES[0]} * {SIDES[1]} END AS DOUBLE)"
OVERLAPS = PINS + f""",
  ovl AS (
    SELECT p.source_design, p.net_id AS a, q.net_id AS b, {VOLUME} AS overlap
    FROM box p JOIN box q ON p.source_design = q.source_design AND p.net_id < q.net_id AND {MEET})"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    nets = table(spark, d, "net_seqs").select("net_id", "source_design", F.concat("loads", F.array("driver")).alias("pins"), "driver")
    pins = F.coalesce("pins", F.array("driver"))
    return spatial.net_boxes(nets.withColumn("pins", pins), "net_id", "pins", ["source_design"])


@query(f"WITH {PINS} SELECT * FROM box")
def a1_boxes(spark: SparkSession, d: str) -> DataFrame:
    """A1: the box of each net's pins."""
    return boxes(spark, d)


@query(f"WITH {OVERLAPS} SELECT * FROM ovl")
def j2_overlapping(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of nets of a design whose boxes meet, with what they share."""
    return spatial.range_join(boxes(spark, d), "net_id", "source_design")


@query(f"WITH {OVERLAPS} SELECT o.* FROM ovl o JOIN box p ON p.net_id = a JOIN box q ON q.net_id = b WHERE {MEET.replace('>=', '>')}")
def j3_strictly_overlapping(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of nets that share a volume."""
    return spatial.range_join(boxes(spark, d), "net_id", "source_design", strict=True)


#: Nets meet where the point of one's driver is a load of another's.
CONNECTED = """
  drv AS (SELECT source_design, net_name AS net, max_by(driver, net_id) AS pin FROM net_seqs WHERE net_name IS NOT NULL AND driver IS NOT NULL GROUP BY ALL),
  lod AS (SELECT DISTINCT source_design, net_name AS net, unnest(loads) AS pin FROM net_seqs WHERE net_name IS NOT NULL),
  con AS (
    SELECT DISTINCT d.source_design, least(d.net, l.net) AS a, greatest(d.net, l.net) AS b
    FROM drv d JOIN lod l ON l.source_design = d.source_design AND l.pin = d.pin AND l.net <> d.net)"""


def connected(spark: SparkSession, d: str) -> DataFrame:
    nets = table(spark, d, "net_seqs").filter("net_name is not null")
    drivers = nets.filter("driver is not null").select("source_design", F.col("net_name").alias("net"), F.col("driver").alias("instance"), F.col("net_id").alias("pin"))
    loads = nets.select("source_design", F.col("net_name").alias("net"), F.explode("loads").alias("instance"))
    return spatial.connect(drivers, loads, "source_design")


@query(f"WITH {CONNECTED} SELECT * FROM con")
def j1_connected(spark: SparkSession, d: str) -> DataFrame:
    """Nets of a design where one's driver is another's load."""
    return connected(spark, d)


@query(
    f"""
WITH {OVERLAPS}, {CONNECTED},
  nam AS (SELECT o.source_design, least(p.net_name, q.net_name) AS a, greatest(p.net_name, q.net_name) AS b, max(overlap) AS overlap
    FROM ovl o JOIN net_seqs p ON p.net_id = o.a JOIN net_seqs q ON q.net_id = o.b WHERE p.net_name <> q.net_name GROUP BY ALL)
SELECT coalesce(n.source_design, c.source_design) AS source_design, coalesce(n.a, c.a) AS source, coalesce(n.b, c.b) AS target,
  CASE WHEN n.a IS NOT NULL THEN 'nearby_to' ELSE 'connects_to' END AS relation, n.overlap
FROM con c FULL JOIN nam n ON n.source_design = c.source_design AND n.a = c.a AND n.b = c.b"""
)
def g13_design_graph(spark: SparkSession, d: str) -> DataFrame:
    """One edge a pair of nets, overlap before connection."""
    names = table(spark, d, "net_seqs").filter("net_name is not null").select("net_id", "net_name")
    near = spatial.range_join(boxes(spark, d), "net_id", "source_design")
    named = (
        near.join(names.select(F.col("net_id").alias("a"), F.col("net_name").alias("na")), "a").join(names.select(F.col("net_id").alias("b"), F.col("net_name").alias("nb")), "b")
        .filter("na <> nb").groupBy("source_design", F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).agg(F.max("overlap").alias("overlap"))
    )
    return spatial.design_graph(connected(spark, d).filter("source_design is not null"), named)


NEIGHBOURS = """
  two AS (
    SELECT source_design, source AS net, target AS neighbour, overlap, relation FROM design_graph WHERE source <> target
    UNION ALL SELECT source_design, target, source, overlap, relation FROM design_graph WHERE source <> target),
  bst AS (SELECT source_design, net, neighbour, {value} AS overlap FROM two WHERE relation = '{relation}' GROUP BY source_design, net, neighbour),
  rnk AS (SELECT *, row_number() OVER (PARTITION BY source_design, net ORDER BY overlap DESC, neighbour) AS rank FROM bst)"""
NEAR = NEIGHBOURS.format(value="max(coalesce(overlap, 0))", relation="nearby_to")


@query(f"WITH {NEAR} SELECT * FROM rnk WHERE rank <= 5")
def w4_top_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """The five neighbours that overlap a net most."""
    return spatial.neighbours(table(spark, d, "design_graph"), "source_design", "nearby_to")


@query(f"WITH {NEIGHBOURS.format(value='0.0', relation='connects_to')} SELECT source_design, net, neighbour, CAST(overlap AS DOUBLE) AS overlap, rank FROM rnk WHERE rank <= 5")
def w5_top_connections(spark: SparkSession, d: str) -> DataFrame:
    """Five connected neighbours of a net, with volume 0, by name."""
    return spatial.neighbours(table(spark, d, "design_graph"), "source_design", "connects_to")


@query(
    f"""
WITH {NEAR},
  inf AS (SELECT source_design, net_name AS neighbour, max_by(struct_pack(d := coalesce(driver, ''), l := array_to_string(loads, ';')), net_id) AS v FROM net_seqs WHERE net_name IS NOT NULL GROUP BY ALL)
SELECT r.source_design, r.net, string_agg(r.neighbour || '|' || coalesce(v.d, '') || '|' || coalesce(v.l, ''), ' ' ORDER BY rank) AS overlap_info
FROM rnk r LEFT JOIN inf i ON i.source_design = r.source_design AND i.neighbour = r.neighbour WHERE rank <= 5 GROUP BY r.source_design, r.net"""
)
def j4_neighbour_info(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours with their drivers and loads, as an array by rank."""
    nets = table(spark, d, "net_seqs").filter("net_name is not null")
    one = nets.groupBy("source_design", F.col("net_name").alias("net")).agg(F.max_by(F.struct("driver", "loads"), "net_id").alias("v")).select("source_design", "net", "v.driver", "v.loads")
    near = spatial.neighbours(table(spark, d, "design_graph"), "source_design", "nearby_to")
    out = spatial.attach(one, near, "source_design", "info")
    text = F.transform("info", lambda i: F.concat_ws("|", i["net_name"], i["driver"], F.array_join(i["loads"], ";")))
    return out.select("source_design", "net", F.array_join(text, " ").alias("overlap_info"))


@query(
    f"""
WITH l AS (SELECT net_id, unnest(loads) AS e FROM net_seqs),
  s AS (SELECT net_id, max({NUMBER.format('e', 1)}) - min({NUMBER.format('e', 1)}) AS w, max({NUMBER.format('e', 2)}) - min({NUMBER.format('e', 2)}) AS h FROM l WHERE {IS_POINT.format('e')} GROUP BY net_id)
SELECT n.net_id, coalesce(len(loads), 0) AS n_loads, coalesce(w * h, 0) AS area, row_number() OVER (ORDER BY coalesce(len(loads), 0) DESC, coalesce(w * h, 0) DESC, n.net_id) AS rank
FROM net_seqs n LEFT JOIN s ON s.net_id = n.net_id"""
)
def t1_net_order(spark: SparkSession, d: str) -> DataFrame:
    """Nets by number of loads, then by the area of their box."""
    from netloom.operators.ranking import ordered

    sized = spatial.order_nets(table(spark, d, "net_seqs").select("net_id", "loads"), "loads", "net_id").select("net_id", F.col("n_loads").cast("long").alias("n_loads"), "area")
    return ordered(sized, ["-n_loads", "-area", "net_id"])


@query(
    """
SELECT source_design, relation, count(*) AS n_edges, count(DISTINCT (least(source, target), greatest(source, target))) AS n_pairs, count(*) FILTER (source = target) AS n_loops
FROM design_graph GROUP BY ALL"""
)
def u4_edge_pairs(spark: SparkSession, d: str) -> DataFrame:
    """U4: edges, distinct undirected pairs and loops by design and relation."""
    g = table(spark, d, "design_graph")
    pair = F.struct(F.least("source", "target"), F.greatest("source", "target"))
    return g.groupBy("source_design", "relation").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct(pair).alias("n_pairs"), F.count_if(F.col("source") == F.col("target")).alias("n_loops"))
