"""Design graphs: which nets share an instance, which boxes overlap, and the nearest neighbours of a net."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.coords import parse, render
from netloom.session import stored

CELLS_PER_BOX = 16
BOXES_PER_CELL = 4


def net_boxes(df: DataFrame, key: str, points: str, by: Sequence[str] = ()) -> DataFrame:
    """``key``, ``by`` and the box ``x1, y1, m1, x2, y2, m2`` of the points of each row; rows without a point are left out."""
    ok = F.filter(F.transform(F.col(points), parse), lambda p: p.isNotNull())
    rows = df.select(key, *by, ok.alias("_p"))
    of = lambda f, n: f(F.transform("_p", lambda p: p[n]))
    ends = [of(f, n).alias(f"{n}{i}") for i, f in ((1, F.array_min), (2, F.array_max)) for n in "xym"]
    return rows.filter(F.size("_p") > 0).select(key, *by, *ends)


def overlap(a: str = "a", b: str = "b") -> Column:
    """Shared volume of two boxes given as structs; their shared area where they share no height."""
    side = [F.expr(f"greatest(0L, least({a}.{n}2, {b}.{n}2) - greatest({a}.{n}1, {b}.{n}1))") for n in "xym"]
    return F.when(side[2] > 0, side[0] * side[1] * side[2]).otherwise(side[0] * side[1]).cast("double")


def range_join(boxes: DataFrame, key: str, by: str, cell: int | None = None, strict: bool = False, cells_per_box: int = CELLS_PER_BOX) -> DataFrame:
    """``by``, ``a`` < ``b`` and ``overlap`` of all pairs of boxes of a ``by`` that meet.

    Boxes are laid on a plane grid and meet in a cell; a pair counts only in the cell that holds the lower corner of what it
    shares, so there is nothing to deduplicate. A box of more than ``cells_per_box`` cells is put on coarser grids, each
    four times as wide, until it fits; finer boxes also look at those grids. So a large box costs a few rows, not thousands.
    Closed intervals: touching counts, unless ``strict``. A ``by`` of many boxes is spread over its cells. Without ``cell``, the side of a cell
    is taken from each ``by``: such that ``BOXES_PER_CELL`` boxes would lie in one if they lay evenly.
    """
    box = F.struct(*[F.col(f"{n}{i}") for i in (1, 2) for n in "xym"])
    # boxes come out of parsed texts and are used several times
    rows = stored(boxes.filter(F.col(by).isNotNull()).select(F.col(by).alias("g"), F.col(key).alias("id"), box.alias("box")), "boxes")
    if cell is None:
        extent = lambda n: f"(max(box.{n}2) - min(box.{n}1) + 1D)"
        side = F.expr(f"cast(greatest(1D, ceil(sqrt({extent('x')} * {extent('y')} * {BOXES_PER_CELL} / count(1)))) as bigint)")
        rows = rows.join(rows.groupBy("g").agg(side.alias("side")), "g")
    else:
        rows = rows.withColumn("side", F.lit(cell).cast("bigint"))
    width = lambda level: f"(side * shiftleft(1L, 2 * {level}))"
    spans = lambda level: F.expr(
        f"(floor(box.x2 / {width(level)}) - floor(box.x1 / {width(level)}) + 1) * (floor(box.y2 / {width(level)}) - floor(box.y1 / {width(level)}) + 1)"
    )
    level = F.lit(MAX_LEVEL)
    for i in range(MAX_LEVEL - 1, -1, -1):
        level = F.when(spans(i) <= cells_per_box, i).otherwise(level)
    rows = rows.withColumn("level", level.cast("int"))

    def on_grid(df: DataFrame, grid: str) -> DataFrame:
        cells = df.withColumn("cx", F.explode(F.expr(f"sequence(floor(box.x1 / {width(grid)}), floor(box.x2 / {width(grid)}))")))
        return cells.withColumn("cy", F.explode(F.expr(f"sequence(floor(box.y1 / {width(grid)}), floor(box.y2 / {width(grid)}))")))

    used = [r.level for r in rows.select("level").distinct().collect()]
    own = on_grid(rows.withColumn("grid", F.col("level")), "grid")
    # each box also stands on the coarser grids in use
    above = F.filter(F.array(*[F.lit(u) for u in sorted(used)]), lambda u: u >= F.col("level"))
    every = on_grid(rows.withColumn("grid", F.explode(above)), "grid")
    a = own.select("g", "grid", "cx", "cy", "side", F.col("id").alias("a"), F.col("box").alias("ba"))
    b = every.select("g", "grid", "cx", "cy", F.col("id").alias("b"), F.col("box").alias("bb"), F.col("level").alias("lb"))
    meet = " and ".join(f"least(ba.{n}2, bb.{n}2) {'>' if strict else '>='} greatest(ba.{n}1, bb.{n}1)" for n in "xym")
    home = " and ".join(f"c{n} = floor(greatest(ba.{n}1, bb.{n}1) / {width('grid')})" for n in "xy")
    # a pair of equal levels is met from both sides, of different ones only from the coarser
    once = "(lb < grid or a < b)"
    pairs = a.join(b, ["g", "grid", "cx", "cy"]).filter(f"a <> b and {once} and {meet} and {home}")
    return pairs.select(F.col("g").alias(by), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), overlap("ba", "bb").alias("overlap"))


MAX_LEVEL = 8


def connect(drivers: DataFrame, loads: DataFrame, by: str | None = None) -> DataFrame:
    """Pairs ``a`` < ``b`` of nets where one's driver instance is a load instance of the other.

    Both sides have ``net`` and ``instance``; of several drivers of a net the last, by ``pin``, counts. Instances meet within a
    ``by``, if given. Nulls never meet; a net does not meet itself.
    """
    keys = [by] if by else []
    last = drivers.groupBy(*keys, "net").agg(F.max_by("instance", "pin").alias("instance"))
    one, two = last.withColumnRenamed("net", "n1"), loads.select(*keys, "instance", F.col("net").alias("n2")).distinct()
    pairs = one.join(two, [*keys, "instance"]).filter("n1 <> n2")
    return pairs.select(*keys, F.least("n1", "n2").alias("a"), F.greatest("n1", "n2").alias("b")).distinct()


def design_graph(connected: DataFrame, overlapping: DataFrame, by: str = "source_design") -> DataFrame:
    """One undirected edge a pair: ``nearby_to`` with its overlap where boxes meet, else ``connects_to`` without one."""
    near = overlapping.select(by, "a", "b", F.col("overlap"))
    both = connected.select(by, "a", "b").join(near, [by, "a", "b"], "full")
    relation = F.when(F.col("overlap").isNotNull(), "nearby_to").otherwise("connects_to")
    return both.select(by, F.col("a").alias("source"), F.col("b").alias("target"), relation.alias("relation"), "overlap")


def neighbours(edges: DataFrame, by: str, relation: str, k: int = 5) -> DataFrame:
    """``by``, ``net``, ``neighbour``, ``overlap``, ``rank``: the first ``k`` neighbours of each net.

    Edges count in both directions, loops not; repeated edges once, with their largest overlap. ``nearby_to`` neighbours rank
    by overlap, largest first, nulls as 0; ``connects_to`` neighbours have volume 0. Ties go by the neighbour's name.
    """
    mine = edges.filter((F.col("relation") == relation) & (F.col("source") != F.col("target")))
    size = F.coalesce("overlap", F.lit(0.0)) if relation == "nearby_to" else F.lit(0.0)
    both = mine.select(by, F.col("source").alias("net"), F.col("target").alias("neighbour"), size.alias("overlap")).unionByName(
        mine.select(by, F.col("target").alias("net"), F.col("source").alias("neighbour"), size.alias("overlap"))
    )
    best = both.groupBy(by, "net", "neighbour").agg(F.max("overlap").alias("overlap"))
    order = Window.partitionBy(by, "net").orderBy(F.desc("overlap"), "neighbour")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def attach(nets: DataFrame, near: DataFrame, by: str, name: str) -> DataFrame:
    """``by``, ``net`` and an array ``name`` of ``net_name, overlap_volume, driver, loads`` of its neighbours in rank order.

    ``nets`` has ``by, net, driver, loads``, one row a net; a neighbour without a row has an empty driver and no loads. At most
    ``k`` neighbours a net are gathered.
    """
    info = nets.select(by, F.col("net").alias("neighbour"), "driver", "loads")
    full = near.join(info, [by, "neighbour"], "left")
    item = F.struct(
        "rank", F.struct(F.col("neighbour").alias("net_name"), F.col("overlap").alias("overlap_volume"), F.coalesce("driver", F.lit("")).alias("driver"),
                         F.coalesce("loads", F.array().cast("array<string>")).alias("loads")).alias("info"))
    return full.groupBy(by, "net").agg(F.transform(F.sort_array(F.collect_list(item)), lambda i: i["info"]).alias(name))


def order_nets(df: DataFrame, loads: str, tie: str) -> DataFrame:
    """Nets by number of loads, then by the plane area of their box, both descending, then by ``tie``; adds ``n_loads`` and ``area``."""
    ok = F.filter(F.transform(F.col(loads), parse), lambda p: p.isNotNull())
    span = lambda n: F.coalesce(F.array_max(F.transform(ok, lambda p: p[n])) - F.array_min(F.transform(ok, lambda p: p[n])), F.lit(0))
    sized = df.withColumns({"n_loads": F.coalesce(F.size(loads), F.lit(0)), "area": span("x") * span("y")})
    return sized.orderBy(F.desc("n_loads"), F.desc("area"), tie)


def on_segment(p: Column, s: Column, e: Column) -> Column:
    """Whether a point is on an axis-parallel edge and not one of its ends."""
    between = lambda n, open_: (
        (p[n] > F.least(s[n], e[n])) & (p[n] < F.greatest(s[n], e[n])) if open_ else p[n].between(F.least(s[n], e[n]), F.greatest(s[n], e[n]))
    )
    flat = lambda n: (s[n] == e[n]) & (e[n] == p[n])
    inside = (
        F.when(flat("x"), between("y", True) & between("m", False)).when(flat("y"), between("x", True) & between("m", False))
        .when(flat("m"), between("x", False) & between("y", False)).otherwise(False)
    )
    return inside & (p != s) & (p != e)


def nearest(p: Column, nodes: Column) -> Column:
    """The node of an array nearest to a point by Manhattan distance, ties by its coordinates; null for an empty array."""
    away = lambda n: F.abs(n["x"] - p["x"]) + F.abs(n["y"] - p["y"]) + F.abs(n["m"] - p["m"])
    return F.array_min(F.transform(nodes, lambda n: F.struct(away(n).alias("distance"), n.alias("node"))))


def as_text(points: Column) -> Column:
    return F.transform(points, render)
