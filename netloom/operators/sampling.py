"""Seeded samples, splits and sampling orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.ranking import ordered


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds ``rank``: the position of each row in an order that depends on its key and the seed alone."""
    return ordered(df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))), ["_h", key]).drop("_h")


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows by the hash of their key, or all if there are fewer: a top-k, without sorting the table."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def train_test(df: DataFrame, key: str, test: float, seed: int) -> DataFrame:
    """Adds ``split``: ``test`` for exactly ``ceil(rows * test)`` rows of the shuffled order, else ``train``."""
    placed = shuffled(df, key, seed)
    size = df.count()
    cut = -int(-(size * test) // 1)
    return placed.withColumn("split", F.when(F.col("rank") <= cut, "test").otherwise("train")).drop("rank")


def repeat_order(n: int, batch: int, repeat: int, mini: int, spark) -> DataFrame:
    """``position`` and ``index`` of a sampler: whole batches of indices in turn, each batch ``repeat`` times, each index ``mini`` times.

    Indices that fill no batch are left out.
    """
    full = n // batch * batch
    each = batch * repeat * mini
    rows = spark.range(full // batch * each if full else 0).withColumnRenamed("id", "position")
    return rows.select("position", F.expr(f"position div {each} * {batch} + position % {batch * mini} div {mini}").alias("index"))


def chunks(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Adds ``chunk``: ``n`` equal runs of rows in an order; the rest that fills no run is left out."""
    placed = ordered(df, order)
    size = df.count() // n
    return placed.withColumn("chunk", F.expr(f"(rank - 1) div {max(size, 1)}")).filter(F.col("rank") <= size * n).drop("rank")


def truncate_protected(ids: Column, length: int, protected: Sequence[int]) -> Column:
    """An array cut to ``length``: protected values stay, of the others the last ones; null if the protected alone are too many."""
    is_kept = lambda x: x.isin(*protected)
    others = F.size(F.filter(ids, lambda x: ~is_kept(x)))
    need = F.lit(length) - (F.size(ids) - others)
    # the number of unprotected values before each place decides
    before = lambda i: F.size(F.filter(F.slice(ids, 1, i), lambda x: ~is_kept(x)))
    cut = F.filter(ids, lambda x, i: is_kept(x) | (before(i) >= others - need))
    return F.when(need >= 0, cut)


def truncate(ids: Column, length: int) -> Column:
    return F.slice(ids, 1, length)


def mask_padding(ids: Column, pad: int, label: int = -100) -> Column:
    """Labels of token ids: padding becomes ``label``."""
    return F.transform(ids, lambda x: F.when(x == pad, F.lit(label)).otherwise(x))
