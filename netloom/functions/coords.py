"""Coordinates and direction tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a coordinate begins with, and the axis and sign of each direction letter.
COORDINATE = r"^\s*\((-?\d+),\s*(-?\d+),\s*(-?\d+)\)"
DIRECTION = r"^[RLUDTB]\d+"
LETTERS = {"x": ("R", "L"), "y": ("U", "D"), "m": ("T", "B")}


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_coordinate(c: str | Column) -> Column:
    """True where a string begins, after white space, with a coordinate; whatever follows it. Null counts as false."""
    return F.coalesce(_c(c).rlike(COORDINATE), F.lit(False))


def is_direction(c: str | Column) -> Column:
    """True where a string begins with a direction letter and a digit; null counts as false."""
    return F.coalesce(_c(c).rlike(DIRECTION), F.lit(False))


def is_flat(c: str | Column) -> Column:
    """True for a move within a layer: one of R, L, U, D in either case, then digits only."""
    return F.coalesce(_c(c).rlike(r"^[RLUDrlud]\d+$"), F.lit(False))


def parse(c: str | Column) -> Column:
    """Struct ``x, y, m`` of a coordinate string, null if it is none or a number exceeds 64 bits."""
    parts = [F.regexp_extract(_c(c), COORDINATE, i).try_cast("bigint") for i in (1, 2, 3)]
    point = F.struct(*[p.alias(n) for p, n in zip(parts, "xym")])
    return F.when(is_coordinate(c) & parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull(), point)


def render(p: str | Column) -> Column:
    """``(x, y, m)`` of a struct; null of null."""
    p = _c(p)
    return F.when(p.isNotNull(), F.format_string("(%d, %d, %d)", p["x"], p["y"], p["m"]))


def point(x: Column, y: Column, m: Column) -> Column:
    return F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), m.cast("bigint").alias("m"))


def add(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), point(a["x"] + b["x"], a["y"] + b["y"], a["m"] + b["m"]))


def subtract(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), point(a["x"] - b["x"], a["y"] - b["y"], a["m"] - b["m"]))


def scale(a: Column, by: Column) -> Column:
    """Each part times a number, cut towards zero."""
    return F.when(a.isNotNull(), point(*[F.expr("1D") * a[n].cast("double") * by for n in "xym"]))


def divide(a: Column, by: Column) -> Column:
    """Each part over a number, cut towards zero; null for zero."""
    return F.when(a.isNotNull() & (by != 0), point(*[F.try_divide(a[n].cast("double"), by) for n in "xym"]))


def floor_divide(a: Column, by: Column) -> Column:
    """Each part over a number, rounded down; null for zero."""
    return F.when(a.isNotNull() & (by != 0), point(*[F.floor(F.try_divide(a[n].cast("double"), by)) for n in "xym"]))


def manhattan(a: Column, b: Column) -> Column:
    return F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"]) + F.abs(a["m"] - b["m"])


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(sum((F.pow((a[n] - b[n]).cast("double"), F.lit(2.0)) for n in "ym"), F.pow((a["x"] - b["x"]).cast("double"), F.lit(2.0))))


def same_layer(a: Column, b: Column) -> Column:
    return a["m"] == b["m"]


def delta_tokens(d: Column) -> Column:
    """Direction tokens of a displacement in the order x, y, m; none for parts that are zero."""
    moves = [
        F.when(d[n] > 0, F.concat(F.lit(up), d[n].cast("string"))).when(d[n] < 0, F.concat(F.lit(down), (-d[n]).cast("string")))
        for n, (up, down) in LETTERS.items()
    ]
    return F.filter(F.array(*moves), lambda t: t.isNotNull())


def token_delta(t: str | Column) -> Column:
    """Displacement of a direction token, null if the rest after the letter is no number or the letter is unknown."""
    t = _c(t)
    letter, size = F.substring(t, 1, 1), F.when(F.substring(t, 2, 40).rlike(r"^\d+$"), F.substring(t, 2, 40)).try_cast("bigint")
    part = lambda up, down: F.when(letter == up, size).when(letter == down, -size).otherwise(F.lit(0))
    return F.when(size.isNotNull() & letter.isin(*"RLUDTB"), point(*[part(*LETTERS[n]) for n in "xym"]))


def direction_tokens(text: str | Column) -> Column:
    """All direction tokens in a text, in order."""
    return F.regexp_extract_all(_c(text), F.lit("([RLUDTB][0-9]+)"), 1)


def relative_loads(driver: Column, loads: Column) -> Column:
    """Loads relative to the driver, as strings; null where the driver or the load is no coordinate."""
    base = parse(driver)
    return F.transform(loads, lambda e: render(subtract(parse(e), base)))


def relative_tree(driver: Column, tree: Column) -> Column:
    """A tree relative to the driver; what is no coordinate stays as it is."""
    base = parse(driver)
    return F.transform(tree, lambda e: F.when(is_coordinate(e), render(subtract(parse(e), base))).otherwise(e))


def sorted_points(loads: Column) -> Column:
    """Coordinates in the order of x, y, m, as strings; what is no coordinate is left out."""
    return F.transform(F.array_sort(F.filter(F.transform(loads, parse), lambda p: p.isNotNull())), render)


def angular_points(driver: Column, loads: Column) -> Column:
    """Coordinates by ascending ``atan2(dy, dx)`` around the driver, ties in input order; what is no coordinate is left out."""
    base = parse(driver)
    keyed = F.transform(
        loads,
        lambda e, i: F.when(
            is_coordinate(e),
            F.struct(F.atan2((parse(e)["y"] - base["y"]).cast("double"), (parse(e)["x"] - base["x"]).cast("double")).alias("angle"), i.alias("at"), parse(e).alias("p")),
        ),
    )
    return F.transform(F.array_sort(F.filter(keyed, lambda k: k.isNotNull())), lambda k: k["p"])
