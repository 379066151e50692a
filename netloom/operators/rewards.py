"""Rewards of completions, their combination, and normalisation within groups.

One Arrow pass draws both trees and measures them; every reward is then a column expression over the measures.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.tokens import strip
from netloom.operators.arrow import map_batches
from netloom.operators.forest import common_by_row, flat, mix, parse_points
from netloom.operators.trees import _moves, _sinks, elmore, move_tokens, scale_factor

EPS = 1e-4


def measures(df: DataFrame, key: str, completion: str, target: str, loads: str) -> DataFrame:
    """``key`` and what rewards need: lengths, half layer steps and delays of both trees, loads met, useful leaves.

    ``empty`` and ``no_target`` mark blank texts, ``n_loads`` counts distinct loads that are coordinates, ``has_loads`` says
    whether any were given.
    """
    blank = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) == ""
    rows = df.select(
        F.col(key).alias("k"), blank(completion).alias("empty"), blank(target).alias("no_target"), (F.coalesce(F.size(loads), F.lit(0)) > 0).alias("has_loads"),
        move_tokens(F.col(completion)).alias("p"), move_tokens(F.col(target)).alias("t"), F.col(loads).alias("l"),
    )

    def simplified(lists: pa.Array):
        from netloom.operators.forest import Forest

        f = _moves(lists)
        return Forest.parse(f.serialise(f.simplified()))

    def run(p_: pa.Array, t_: pa.Array, l_: pa.Array) -> list:
        p, t = simplified(p_), simplified(t_)
        n = p.rows
        half = lambda f: f.by_row(f.edges(), f.steps()[f.edges(), 2] / 2.0)
        values, offsets = flat(l_)
        ok, at = parse_points(values.cast(pa.string()))
        row, at = np.repeat(np.arange(n), np.diff(offsets))[ok], at[ok]
        name = mix(at[:, 0], at[:, 1], at[:, 2])
        names, leaf = p.names(), p.leaves()
        n_loads, _, met = common_by_row(name, row, names, p.row, n)
        _, n_leaves, useful = common_by_row(name, row, names[leaf], p.row[leaf], n)
        factor = scale_factor(p, t)
        scaled = np.where(factor[row] == 1.0, at[:, 2], np.trunc(at[:, 2] * factor[row])).astype(np.int64)
        name = mix(at[:, 0], at[:, 1], scaled)
        delay = [elmore(f, _sinks(f, name, row)) for f in (p.scaled(factor), t.scaled(factor))]
        return [p.lengths(), t.lengths(), half(p), half(t), n_loads, met, n_leaves, useful, *delay]

    fields = "wire_pred bigint, wire_true bigint, via_pred double, via_true double, n_loads bigint, n_met bigint, n_leaves bigint, n_useful bigint, delay_pred double, delay_true double"
    keep = ["k", "empty", "no_target", "has_loads"]
    return map_batches(rows, ["p", "t", "l"], fields, run, keep).withColumnRenamed("k", key)


def improvement(true: Column, pred: Column) -> Column:
    return (true - pred) / F.greatest(true, pred, F.lit(1e-6))


def _clipped(score: Column, clip: float) -> Column:
    return F.greatest(F.lit(-clip), F.least(F.lit(clip), score))


def wirelength(failure: float = -0.2, clip: float = 1.0) -> Column:
    """Relative saving of wire, clipped; ``failure`` for blank texts and trees without wire."""
    ok = ~F.col("empty") & ~F.col("no_target") & (F.col("wire_pred") > 0) & (F.col("wire_true") > 0)
    return F.when(ok, _clipped(improvement(F.col("wire_true"), F.col("wire_pred")), clip)).otherwise(failure)


def wirelength_via(via_weight: float = 0.3, failure: float = -0.2, clip: float = 1.0) -> Column:
    """As :func:`wirelength`, plus the weighted saving of vias, a via being half a layer step."""
    ok = ~F.col("empty") & ~F.col("no_target") & (F.col("wire_pred") > 0) & (F.col("wire_true") > 0)
    vias = F.when((F.col("via_true") <= 0) & (F.col("via_pred") <= 0), 0.0).otherwise(improvement(F.col("via_true"), F.col("via_pred")))
    return F.when(ok, _clipped(improvement(F.col("wire_true"), F.col("wire_pred")) + via_weight * vias, clip)).otherwise(failure)


def connectivity(continuous: bool = False, penalty: float = -1.0, failure: float = -1.0) -> Column:
    """1 if all loads are met, else the penalty, or with ``continuous`` the share met. 1 without loads."""
    share = F.when(F.col("n_loads") > 0, F.col("n_met") / F.col("n_loads")).otherwise(1.0)
    score = share if continuous else F.when(F.col("n_met") == F.col("n_loads"), 1.0).otherwise(penalty)
    return F.when(~F.col("has_loads"), 1.0).when(F.col("empty"), failure).otherwise(score)


def graceful(continuous: bool = False, penalty: float = -1.0, failure: float = -1.0) -> Column:
    """1 if all loads are met and every leaf is a load, else the penalty, or with ``continuous`` half of each share. Fails without loads."""
    leaves = F.when(F.col("n_leaves") > 0, F.col("n_useful") / F.col("n_leaves")).otherwise(0.0)
    both = F.when(F.col("n_loads") > 0, 0.5 * F.col("n_met") / F.col("n_loads") + 0.5 * leaves).otherwise(F.when(F.col("n_leaves") == 0, 1.0).otherwise(0.0))
    whole = F.when((F.col("n_met") == F.col("n_loads")) & (F.col("n_useful") == F.col("n_leaves")), 1.0).otherwise(penalty)
    return F.when(F.col("empty") | ~F.col("has_loads"), failure).otherwise(both if continuous else whole)


def elmore_delay(failure: float = -0.2, clip: float = 1.0, scale: float = 1.0) -> Column:
    """Relative saving of the largest delay, on trees with layers scaled to the plane."""
    ok = ~F.col("empty") & (F.col("delay_pred") > 0) & (F.col("delay_true") > 0)
    return F.when(ok, _clipped(improvement(F.col("delay_true"), F.col("delay_pred")), clip) * scale).otherwise(failure)


def gated(main: Column, gates: dict[str, Column], direction: Column | None = None) -> Column:
    """Struct ``final, mask, components``: the main reward counts through the product of gates clamped to 0 .. 1.

    A direction that is not positive turns the mask negative. A positive mask weighs the gain; otherwise only a loss counts.
    """
    mask = F.lit(1.0)
    items = {"improvement": main}
    for name, gate in gates.items():
        clamp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(gate), 0.0).otherwise(F.coalesce(gate, F.lit(0.0)))))
        items |= {name: gate, f"{name}_mask": clamp}
        mask = mask * clamp
    if direction is not None:
        sign = F.when(direction > 0, 1.0).otherwise(-1.0)
        items |= {"direction": direction, "direction_mask": sign}
        mask = mask * sign
    final = F.when(mask > 0, mask * F.greatest(main, F.lit(0.0))).otherwise(F.least(main, F.lit(0.0)))
    return F.struct(final.alias("final"), mask.alias("mask"), _map(items | {"mask": mask, "final": final}).alias("components"))


def weighted(parts: dict[str, tuple[Column, float]]) -> Column:
    """Struct ``final, components``: the weighted sum of rewards."""
    items = {k: c for k, (c, _) in parts.items()} | {f"{k}_weighted": c * w for k, (c, w) in parts.items()}
    total = F.lit(0.0)
    for c, w in parts.values():
        total = total + c * w
    return F.struct(total.alias("final"), _map(items | {"final": total}).alias("components"))


def _map(items: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, c in items.items() for x in (F.lit(k), c.cast("double"))])


#: Rewards by name.
REWARDS: dict[str, Callable[[], Column]] = {
    "wirelength": wirelength,
    "wirelength_via": wirelength_via,
    "connectivity": connectivity,
    "graceful": graceful,
    "elmore": elmore_delay,
    "gated_wirelength": lambda: gated(wirelength(), {"connectivity": connectivity(True), "graceful": graceful(True)})["final"],
    "gated_elmore": lambda: gated(elmore_delay(), {"connectivity": connectivity(True), "graceful": graceful(True)})["final"],
    "weighted": lambda: weighted({"improvement": (wirelength(), 0.8), "connectivity": (connectivity(True), 0.1), "graceful": (graceful(True), 0.1)})["final"],
}


def reward(name: str) -> Column:
    """A reward column by name, with default weights."""
    if name not in REWARDS:
        raise ValueError(f"unknown reward {name}; there are {', '.join(REWARDS)}")
    return REWARDS[name]()


def advantages(df: DataFrame, group: str | Sequence[str], value: str) -> DataFrame:
    """Adds ``group_mean``, ``group_std`` (sample) and ``advantage = (value - mean) / (std + 1e-4)``.

    Statistics are a partial aggregation joined back, so a group of a third of all rows is never sorted or gathered. NaN counts
    as null; a group of one has a deviation of 0.
    """
    keys = [group] if isinstance(group, str) else list(group)
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    stats = df.groupBy(*keys).agg(F.avg(v).alias("group_mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("group_std"))
    named = stats.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "group_mean", "group_std")
    on = [df[k].eqNullSafe(named[f"_{i}"]) for i, k in enumerate(keys)]
    out = df.join(named, on).drop(*[f"_{i}" for i in range(len(keys))])
    return out.withColumn("advantage", (v - F.col("group_mean")) / (F.col("group_std") + EPS))


def weighted_sum(values: Column, weights: Sequence[float]) -> Column:
    """Weighted sum of an array of rewards; null and NaN count as 0."""
    clean = F.transform(values, lambda x: F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0)))
    return F.aggregate(F.zip_with(clean, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: F.coalesce(x * w, F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)


def component_statistics(df: DataFrame, components: str, by: Sequence[str] = ()) -> DataFrame:
    """Per component of a map: rows, mean, population deviation and the share of at least 0.99."""
    rows = df.select(*by, F.explode(components).alias("component", "value"))
    return rows.groupBy(*by, "component").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.avg((F.col("value") >= 0.99).cast("double")).alias("pass_rate")
    )


def masked_losses(df: DataFrame, sample: str, loss: str, mask: str, max_length: int) -> DataFrame:
    """One row of three reductions of token losses: mean of sample means, mean over tokens, and sum over samples times ``max_length``."""
    m = F.col(mask).cast("double")
    per = df.groupBy(sample).agg(F.sum(F.col(loss) * m).alias("l"), F.sum(m).alias("n"))
    return per.agg(
        F.avg(F.col("l") / F.greatest("n", F.lit(1.0))).alias("grpo"), (F.sum("l") / F.greatest(F.sum("n"), F.lit(1.0))).alias("bnpo"),
        (F.sum("l") / (F.count(F.lit(1)) * max_length)).alias("dr_grpo"),
    )
