"""Exact order statistics by key, by refining histograms.

No key's values are ever gathered: a round counts values in equal bins of each key's open intervals, with partial counts before
the shuffle, and keeps the bin that holds each rank. Bins are the values that share their leading bits, so nothing overflows;
the next interval is from the least to the largest value in the bin. What is left after a round is one row a key. A key of a third of all rows
costs its share of a scan and about ``bins`` counts a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.session import drop_stored, stored

BROADCAST_KEYS = 100_000
SALT = 32
#: Every round halves the open intervals at least, and values have 64 bits.
MAX_ROUNDS = 66


def _with_state(data: DataFrame, state: DataFrame, keys: int) -> DataFrame:
    """Joins the state of each key to its rows: broadcast up to ``BROADCAST_KEYS`` keys, else with salted keys."""
    if keys <= BROADCAST_KEYS:
        return data.join(F.broadcast(state), data["key"].eqNullSafe(state["key"])).drop(state["key"])
    left = data.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALT)))
    right = state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")))
    return left.join(right, left["key"].eqNullSafe(right["key"]) & (left["salt"] == right["salt"])).drop(right["key"]).drop("salt")


def quantiles_by_key(df: DataFrame, key: str, value: str, permille: Sequence[int] = (500, 900, 990), bins: int = 1024, counts: bool = False) -> DataFrame:
    """``key``, ``n_rows``, ``n``, ``lowest``, ``highest`` and one column ``q<permille>`` for each quantile wanted; with ``counts`` also
    ``c<permille>``, the rows of the key that have just that value, which is the count of the bin its rank ended in.

    The quantile of p thousandths is the value of rank ``ceil(n * p / 1000)`` among the key's values, by exact counts; ``value``
    must be of an integral type. ``n_rows`` counts all rows of the key, ``n`` those whose value is not null; a key without
    values has null results. A null key is a key of its own. An empty table gives an empty result. Other columns are not read.
    """
    if not all(0 < p <= 1000 for p in permille) or bins < 2:
        raise ValueError("permille must be in 1 .. 1000, and bins at least 2")
    # equal values of a key are one row with a count from here on
    data = stored(
        df.select(F.col(key).alias("key"), F.col(value).cast("long").alias("value")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("count")), "values"
    )
    base = stored(
        data.groupBy("key").agg(
            F.sum("count").alias("n_rows"), F.coalesce(F.sum(F.expr("if(value is not null, count, 0)")), F.lit(0)).alias("n"),
            F.min("value").alias("lowest"), F.max("value").alias("highest"),
        ), "keys"
    )
    keys = base.count()
    # open: the ranks still to find, each with its interval and its rank within it
    ranks = F.array(*[F.struct(F.lit(p).alias("p"), F.expr(f"(n * {p} + 999) div 1000").alias("rank"), F.col("lowest").alias("lo"), F.col("highest").alias("hi"), F.col("n").alias("count")) for p in permille])
    state = stored(base.filter("n > 0").select("key", F.explode(ranks).alias("o")).select("key", "o.*"), "ranks")
    found = state.filter("lo = hi").select("key", "p", F.col("lo").alias("quantile"), "count")
    parts = [found]
    todo = state.filter("lo < hi")
    values = data.filter("value is not null")
    for _ in range(MAX_ROUNDS):
        if todo.isEmpty():
            break
        shift = F.expr(f"cast(greatest(0D, ceil(log2((cast(hi as double) - cast(lo as double) + 1) / {bins}) - 1e-9)) as int)")
        by_key = todo.drop("count").withColumn("shift", shift).groupBy("key").agg(F.collect_list(F.struct("p", "rank", "lo", "hi", "shift")).alias("open"))
        hits = _with_state(values, by_key, keys).select("key", "value", "count", F.explode("open").alias("o")).filter("value between o.lo and o.hi")
        hits = hits.select("key", "o.*", "count", "value", F.expr("shiftright(value, o.shift)").alias("bin"))
        counted = hits.groupBy("key", "p", "rank", "lo", "hi", "shift", "bin").agg(F.sum("count").alias("count"), F.min("value").alias("least"), F.max("value").alias("most"))
        order = Window.partitionBy("key", "p").orderBy("bin")
        chosen = (
            counted.withColumn("upto", F.sum("count").over(order))
            .filter("upto >= rank and upto - count < rank")
            .selectExpr("key", "p", "rank - (upto - count) as rank", "least as lo", "most as hi", "count")
        )
        then = stored(chosen, "ranks")
        parts.append(then.filter("lo = hi").select("key", "p", F.col("lo").alias("quantile"), "count"))
        todo = then.filter("lo < hi")
    else:
        raise RuntimeError(f"ranks did not resolve in {MAX_ROUNDS} rounds")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    columns = [("q", "quantile")] + [("c", "count")] * counts
    wide = result.groupBy("key").agg(*[F.max(F.when(F.col("p") == p, F.col(c))).alias(f"{name}{p}") for name, c in columns for p in permille])
    out = base.join(wide, base["key"].eqNullSafe(wide["key"]), "left").drop(wide["key"])
    out = stored(out.select(F.col("key").alias(key), "n_rows", "n", "lowest", "highest", *[f"{name}{p}" for name, _ in columns for p in permille]), "quantiles")
    for step in (data, base):
        drop_stored(step)
    return out


def heavy_values(df: DataFrame, column: str, permille: int = 50) -> DataFrame:
    """``column`` and ``count`` of the values, other than null, that hold more than ``permille`` thousandths of all rows, nulls among these.

    In the order of their hashes, such a value covers more ranks than lie between two ranks that are as many thousandths apart, so
    it stands at one of these: the ranks are selected over all rows as a single key, and the last bins are the exact counts.
    At most ``1000 / permille`` values are looked up again. An empty table gives an empty result.
    """
    steps = [*range(permille, 1000, permille), 1000]
    hashed = df.select(F.lit(0).alias("all"), F.when(F.col(column).isNotNull(), F.xxhash64(column)).alias("hash"))
    row = quantiles_by_key(hashed, "all", "hash", steps, 1 << 16, counts=True).first()
    found = {row[f"q{p}"]: row[f"c{p}"] for p in steps if row[f"q{p}"] is not None and row[f"c{p}"] * 1000 > row.n_rows * permille} if row else {}
    values = df.sparkSession.createDataFrame(sorted(found.items()), "hash bigint, count bigint")
    names = df.filter(F.xxhash64(column).isin(*found) & F.col(column).isNotNull()).select(column, F.xxhash64(column).alias("hash")).distinct()
    return names.join(F.broadcast(values), "hash").select(column, "count")
