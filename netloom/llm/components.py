"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.session import drop_stored, stored

MAX_ROUNDS = 60


def large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node`` and ``component`` (its least node) of every node of an edge list.

    Each round writes its edges to the shared folder, so lineage stays short and a lost executor costs
    one round at most. Rounds end when a pass changes nothing; their number grows with the logarithm of
    the number of nodes. No group is ever gathered: a node's least neighbour is a partial aggregate, and
    edges of a hub meet it in a join that the engine splits where it is skewed.

    Null ends and loops are left out; repeated edges and either direction count once. Nodes without an
    edge do not come out. An empty edge list gives an empty result.
    """
    clean = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u is not null and v is not null and u <> v")
    now = stored(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _sum(now)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        then = stored(small_star(large_star(now)), "edges")
        drop_stored(now)
        now, after = then, _sum(then)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
