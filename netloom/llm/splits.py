"""Splits that keep related records together: components of tied entities, hashed into ranges of the wanted proportions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.components import components
from netloom.session import stored

MOST_DESIGNS = 8
SEEDS = 64
BUCKETS = 1024


def ties(df: DataFrame, entity: str = "source_design", name: str = "net_name", most: int = MOST_DESIGNS) -> DataFrame:
    """Pairs ``u`` > ``v`` of entities that share a name: each entity with the least one of the name.

    Names are compared without outer spaces, then without one leading backslash, in lower case. Null and empty names and
    entities do not count, nor do names that more than ``most`` entities hold.
    """
    clean = F.lower(F.regexp_replace(F.trim(F.col(name)), r"^\\", ""))
    held = df.select(F.col(entity).alias("u"), clean.alias("name")).filter("u <> '' and name <> ''").distinct()
    shared = held.groupBy("name").agg(F.count(F.lit(1)).alias("holders"), F.min("u").alias("v")).filter(F.col("holders").between(2, most))
    return held.join(shared.select("name", "v"), "name").filter("u <> v").select("u", "v").distinct()


def grouped(tie: DataFrame) -> DataFrame:
    """``id`` and ``component`` of the entities of some ties, both as 64-bit hashes of names: rounds move and compare numbers."""
    return components(tie.select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v"))).withColumnRenamed("node", "id")


def tied_pairs(df: DataFrame, entity: str = "source_design", name: str = "net_name", most: int = MOST_DESIGNS) -> DataFrame:
    """Pairs ``design_a`` < ``design_b`` that must share a split, directly or through others."""
    tie = stored(ties(df, entity, name, most), "ties")
    names = tie.select(F.explode(F.array("u", "v")).alias("design")).distinct()
    of = names.withColumn("id", F.xxhash64("design")).join(grouped(tie), "id")
    left, right = of.select("component", F.col("design").alias("design_a")), of.select("component", F.col("design").alias("design_b"))
    return left.join(right, "component").filter("design_a < design_b").select("design_a", "design_b")


def place_of(*what: Column) -> Column:
    """A hash as a place in [0, 1)."""
    return F.pmod(F.xxhash64(*what), F.lit(1 << 52)) / float(1 << 52)


@dataclass(frozen=True)
class Ranges:
    """A seed, and the ranges of [0, 1) by split: each ends where the next begins."""

    seed: int
    ends: tuple[tuple[str, float], ...]

    def split_of(self, what: Column) -> Column:
        place = place_of(what, F.lit(self.seed))
        out = F
        for split, end in self.ends[:-1]:
            out = out.when(place < end, split)
        last = self.ends[-1][0]
        return F.lit(last) if out is F else out.otherwise(last)


def ranges_for(sizes: DataFrame, plan: Sequence[tuple[str, float]], loose: int = 0, seeds: int = SEEDS) -> Ranges:
    """Ranges of the hash of ``component`` that hold ``rows`` in the ratios of ``plan``, the longest first.

    The line is counted in ``BUCKETS`` buckets and cut between buckets where the rows so far are nearest to the ratios; of the seeds below
    ``seeds`` the one that comes nearest is taken. ``loose`` rows lie evenly. At most ``seeds * BUCKETS`` counts reach the driver.
    """
    plan = sorted(plan, key=lambda x: (-x[1], x[0]))
    wanted = np.cumsum([r for _, r in plan]) / sum(r for _, r in plan)
    tried = sizes.select("component", "rows", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    counts = tried.groupBy("seed", F.floor(place_of(F.col("component"), F.col("seed")) * BUCKETS).cast("int").alias("bucket")).agg(F.sum("rows").alias("rows")).toArrow()
    line = np.full((seeds, BUCKETS), loose / BUCKETS)
    line[counts["seed"].to_numpy(), counts["bucket"].to_numpy()] += counts["rows"].to_numpy()
    upto = np.concatenate([np.zeros((seeds, 1)), np.cumsum(line, axis=1)], axis=1)
    upto /= np.maximum(upto[:, -1:], 1)
    best, chosen = np.inf, Ranges(0, tuple((n, float(w)) for (n, _), w in zip(plan, wanted)))
    for seed in range(seeds):
        at = np.abs(upto[seed][:, None] - wanted).argmin(axis=0)
        at[-1] = BUCKETS
        share = np.diff(np.concatenate([[0], upto[seed][at]]))
        miss = np.abs(share - [r for r in np.diff(np.concatenate([[0], wanted]))]).max()
        if upto[seed][-1] and miss < best - 1e-12:
            best, chosen = miss, Ranges(seed, tuple((n, float(x / BUCKETS)) for (n, _), x in zip(plan, at)))
    return chosen


def sized(df: DataFrame, entity: str = "source_design", name: str = "net_name") -> tuple[DataFrame, DataFrame]:
    """``node`` and ``c`` of every entity, and ``c``, ``component`` (its least entity) and ``rows`` of every component."""
    weights = df.select(F.col(entity).alias("node")).filter("node <> ''").groupBy("node").agg(F.count(F.lit(1)).alias("rows")).withColumn("id", F.xxhash64("node"))
    found = weights.join(grouped(ties(df, entity, name)), "id", "left").select("node", "rows", F.coalesce("component", "id").alias("c"))
    groups = stored(found, "groups")
    return groups, stored(groups.groupBy("c").agg(F.min("node").alias("component"), F.sum("rows").alias("rows")), "sizes")


def assign(
    df: DataFrame, plan: Sequence[tuple[str, float]], key: str = "net_id", entity: str = "source_design", name: str = "net_name", ranges: Ranges | None = None
) -> DataFrame:
    """``key``, ``component`` (its least entity) and ``split`` of every row.

    All rows of a component share a split: its identifier is hashed with a seed into [0, 1), which is cut into ranges that hold rows in
    the ratios of ``plan``. One rule for components of every size. A seed places large components by chance, so without ``ranges``
    :func:`ranges_for` takes the best of ``SEEDS``; give the ranges of an earlier run to keep every component that has not changed in its
    split when rows arrive.

    Rows with a null or empty entity are components of their own, by the hash of their key, and come out with a null component.
    Repeated rows stay. Shares are met to about the rows of a bucket, unless single components are too large for any seed.
    """
    if sum(ratio for _, ratio in plan) <= 0 or any(ratio < 0 for _, ratio in plan):
        raise ValueError("ratios must not be negative, and not all zero")
    rows = df.select(F.col(key).alias("key"), F.col(entity).alias("node"))
    groups, sizes = sized(df, entity, name)
    if ranges is None:
        ranges = ranges_for(sizes, plan, rows.filter("node is null or node = ''").count())
    laid = sizes.select("c", "component", ranges.split_of(F.col("component")).alias("split"))
    known = rows.filter("node <> ''").join(groups.join(laid, "c").select("node", "component", "split"), "node").select("key", "component", "split")
    rest = rows.filter("node is null or node = ''").select("key", F.lit(None).cast("string").alias("component"), ranges.split_of(F.col("key")).alias("split"))
    return known.unionByName(rest).withColumnRenamed("key", key)
