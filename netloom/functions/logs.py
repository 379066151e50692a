"""Figures scraped from tool logs, as columns over whole texts. A figure that is not found is null; a null text has none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netloom.functions.tokens import seconds

#: Patterns of the tools' reports.
VIOLATIONS = r"(?i)Total\s+Violations\s*:\s*(\d+)"
ECO = r"#% End globalDetailRoute.*total cpu=(\d+:\d+:[\d.]+).*real=(\d+:\d+:[\d.]+)"
TIMING = (
    r"(?s)timeDesign Summary.*?Setup views included:.*?all.*?reg2reg.*?default.*?\|\s*WNS \(ns\):\|\s*([-\d.]+)\s*\|.*?"
    r"\|\s*TNS \(ns\):\|\s*([-\d.]+)\s*\|.*?Density:\s*([\d.]+)%"
)
POWER = (
    r"(?s)Total Power\s*\n-+\s*\nTotal Internal Power:\s*([\d.]+).*?\nTotal Switching Power:\s*([\d.]+).*?\n"
    r"Total Leakage Power:\s*([\d.]+).*?\nTotal Power:\s*([\d.]+)"
)
WIRE = r"(?s)#Complete Post Route Wire Spread\..*?#Total wire length = (\d+) um\..*?#Total number of vias = (\d+)"
ROUTE = r"#% End routeDesign.*total cpu=(\d+:\d+:[\d.]+).*real=(\d+:\d+:[\d.]+)"
OPTIMISE = r"\*\*optDesign.*cpu = (\d+:\d+:[\d.]+), real = (\d+:\d+:[\d.]+)"
COMBINATIONAL = r"Total number of combinational cells:\s*(\d+)"
SEQUENTIAL = r"Total number of sequential cells:\s*(\d+)"
NETS = r"#Total number of nets in the design = (\d+)"
ROUTABLE = r"#Total number of routable nets = (\d+)"
DENSITY = r"Placement Density: ?([\d.]+)%\((\d+)/(\d+)\)"
CELLS = r"\*\* info: there are (\d+) stdCell insts\."

#: Fixed value: seconds of inference a net.
INFERENCE_PER_NET = 0.015923


def first(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def last(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), group)
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def violations(text: Column) -> Column:
    """Total violations of a rule-check report; 0 if the text has no total or is null."""
    return F.coalesce(first(text, VIOLATIONS).try_cast("bigint"), F.lit(0))


def eco(text: Column) -> list[Column]:
    return [seconds(first(text, ECO, i)).alias(n) for i, n in ((1, "eco_cpu"), (2, "eco_real"))]


def timing(text: Column) -> list[Column]:
    return [first(text, TIMING, i).alias(n) for i, n in enumerate(("wns", "tns", "density"), 1)]


def power(text: Column) -> list[Column]:
    return [first(text, POWER, i).alias(n) for i, n in enumerate(("internal_power", "switching_power", "leakage_power", "total_power"), 1)]


def wire(text: Column) -> list[Column]:
    return [first(text, WIRE, i).try_cast("bigint").alias(n) for i, n in enumerate(("wire_length", "vias"), 1)]


def routing(text: Column) -> list[Column]:
    """CPU of routing and of the last optimisation, cut to whole seconds, their total, and the cells and nets."""
    whole = lambda t: seconds(F.regexp_replace(t, r"\..*$", ""))
    route, opt = whole(first(text, ROUTE)), whole(last(text, OPTIMISE))
    comb, seq = first(text, COMBINATIONAL).try_cast("bigint"), first(text, SEQUENTIAL).try_cast("bigint")
    return [
        route.alias("route_cpu"), opt.alias("opt_cpu"), (F.coalesce(route, F.lit(0.0)) + F.coalesce(opt, F.lit(0.0))).alias("total_cpu"),
        comb.alias("combinational"), seq.alias("sequential"), (comb + seq).alias("cells"), first(text, NETS).try_cast("bigint").alias("nets"),
    ]


def placement(text: Column) -> list[Column]:
    return [first(text, p).alias(n) for p, n in ((ROUTABLE, "routable_nets"), (NETS, "nets"), (DENSITY, "density"), (CELLS, "std_cells"))]


def inference_runtime(nets: Column, eco_cpu: Column) -> Column:
    """Seconds of inference, rounded to two places, plus those of repair."""
    return F.round(nets * INFERENCE_PER_NET, 2) + F.coalesce(eco_cpu, F.lit(0.0))
