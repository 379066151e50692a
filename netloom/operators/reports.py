"""Roll-ups of evaluation metrics and of tool results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEANS = ["is_connected_all_loads", "is_graceful", "is_perfect_match", "red_similarity_score", "bleu_4", "rougel_f"]
RATIOS = {"wirelength_ratio": ("wirelength_pred", "wirelength_true"), "via_ratio": ("num_vias_pred", "num_vias_true")}


def number(c: str) -> Column:
    """A column as double, NaN as null."""
    v = F.col(c).cast("double")
    return F.nanvl(v, F.lit(None).cast("double"))


def ratio_of_sums(a: str, b: str) -> Column:
    """Sum over sum; null where the lower sum is 0."""
    return F.sum(F.col(a).cast("double")) / F.nullif(F.sum(F.col(b).cast("double")), F.lit(0.0))


def summary(df: DataFrame, by: Sequence[str], means: Sequence[str] = MEANS, ratios: dict[str, tuple[str, str]] = RATIOS) -> DataFrame:
    """Per group: rows, means of metrics (true as 1, nulls and NaN left out) and ratios of sums. A null group is one of its own."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.avg(number(m)).alias(m) for m in means], *[ratio_of_sums(a, b).alias(n) for n, (a, b) in ratios.items()]
    )


def counts_of(df: DataFrame, by: Sequence[str], flags: Sequence[str], least: int = 5) -> DataFrame:
    """Per group of at least ``least`` rows: rows, how many have each flag, and the percentages."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags])
    out = out.filter(F.col("n_rows") >= least)
    return out.select(*by, "n_rows", *[c for f in flags for c in (F.col(f"n_{f}"), (F.col(f"n_{f}") * 100.0 / F.col("n_rows")).alias(f"pct_{f}"))])


def best_in_group(df: DataFrame, base: Column, value: str, lower: bool = False) -> DataFrame:
    """Adds ``best`` of each base and ``is_best``, ties included."""
    w = Window.partitionBy(base)
    top = (F.min if lower else F.max)(value).over(w)
    return df.withColumn("best", top).withColumn("is_best", F.coalesce(F.col(value) == F.col("best"), F.lit(False)))


def combine_pair(bpe: Column, bbpe: Column) -> Column:
    """The one that is there; the second where the first is about 0; else their mean."""
    return F.when(bpe.isNull(), bbpe).when(bbpe.isNull(), bpe).when(F.abs(bpe) < 1e-12, bbpe).otherwise((bpe + bbpe) / 2)


def with_total(df: DataFrame, by: str, values: Sequence[str], label: str = "Total") -> DataFrame:
    """Rows of ``df`` and one with the sums."""
    total = df.agg(*[F.sum(v).alias(v) for v in values]).select(F.lit(label).alias(by), *values)
    return df.select(by, *values).unionByName(total)


def normalised(df: DataFrame, by: str, values: Sequence[str], base: str) -> DataFrame:
    """Sums by kind over those of the kind ``base``; null where that sum is not positive."""
    sums = df.groupBy(by).agg(*[F.sum(v).alias(v) for v in values])
    ref = sums.filter(F.col(by) == base).select(*[F.col(v).alias(f"_{v}") for v in values])
    return sums.join(ref, F.lit(True), "left").select(by, *[F.when(F.col(f"_{v}") > 0, F.col(v) / F.col(f"_{v}")).alias(v) for v in values])


def by_largest(df: DataFrame, by: str, values: Sequence[str]) -> DataFrame:
    """Sums by kind, each over the largest sum of all kinds; null where that is 0."""
    sums = df.groupBy(by).agg(*[F.sum(v).alias(v) for v in values])
    tops = sums.agg(*[F.max(v).alias(f"_{v}") for v in values])
    return sums.join(tops, F.lit(True)).select(by, *[(F.col(v) / F.nullif(F.col(f"_{v}"), F.lit(0))).alias(v) for v in values])


def pivoted(df: DataFrame, row: str, column: str, kinds: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row for each ``row`` and a column ``value (KIND)`` for each value and kind; of repeated cells the largest."""
    return df.groupBy(row).agg(*[F.max(F.when(F.col(column) == k, F.col(v))).alias(f"{v} ({k})") for v in values for k in kinds])


def best_positions(values: Column, lower: bool = True) -> Column:
    """Positions, from 0, of the best of an array, ties included; nulls never are."""
    clean = F.filter(values, lambda v: v.isNotNull())
    top = F.array_min(clean) if lower else F.array_max(clean)
    return F.filter(F.transform(values, lambda v, i: F.when(v == top, i)), lambda i: i.isNotNull())


def least_positive(df: DataFrame, *values: str) -> DataFrame:
    """The least positive value over some columns."""
    return df.agg(F.least(*[F.min(F.when(F.col(v) > 0, F.col(v))) for v in values]).alias("least_positive") if len(values) > 1 else F.min(F.when(F.col(values[0]) > 0, F.col(values[0]))).alias("least_positive"))


def reindexed(df: DataFrame, key: str, order: DataFrame, position: str) -> DataFrame:
    """Rows in the order of a dimension; members without a row come out with nulls."""
    return order.join(df, key, "left").orderBy(position)


def ordered_categories(df: DataFrame, category: Column, values: Sequence[str], order: Sequence[str], spark) -> DataFrame:
    """Means by category in a given order; rows without a category are dropped, categories without rows stay."""
    dims = spark.createDataFrame([(c, i) for i, c in enumerate(order)], "category string, position int")
    means = df.withColumn("category", category).filter("category is not null").groupBy("category").agg(*[F.avg(number(v)).alias(v) for v in values])
    return dims.join(means, "category", "left").select("position", "category", *values)


def interpolated_quantile(df: DataFrame, by: Sequence[str], value: str, q: float) -> DataFrame:
    """Per group ``lo``, the least value, and ``hi``, the quantile with linear interpolation, of a column without nulls.

    Values are counted before they are sorted, and sorting spills: no group has to fit into memory.
    """
    from netloom.operators.ranking import ordered

    counts = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    if by:
        upto = counts.withColumn("cum__c", F.sum("_c").over(Window.partitionBy(*by).orderBy("_v")))
    else:
        upto = ordered(counts, ["_v"], ["_c"])
    totals = counts.groupBy(*by).agg(F.sum("_c").alias("_n"), F.min("_v").alias("lo")).withColumn("_at", (F.col("_n") - 1) * q)
    named = totals.select(*[F.col(b).alias(f"_{b}") for b in by], "lo", "_at")
    on = F.lit(True)
    for b in by:
        on = on & upto[b].eqNullSafe(named[f"_{b}"])
    both = upto.join(named, on)
    pick = lambda f: F.max(F.when((F.col("cum__c") - F.col("_c") < f("_at") + 1) & (f("_at") + 1 <= F.col("cum__c")), F.col("_v")))
    ends = both.groupBy(*by).agg(F.first("lo").alias("lo"), F.first("_at").alias("_at"), pick(F.floor).alias("_a"), pick(F.ceil).alias("_b"))
    return ends.select(*by, "lo", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))).alias("hi"))


def histogram(df: DataFrame, value: str, bins: int = 50, by: Sequence[str] = (), upper: float = 0.95) -> DataFrame:
    """Counts in equal bins between the least value and a quantile, for plots; larger values are left out. Null and NaN do not count."""
    rows = df.select(*by, number(value).alias("v")).filter("v is not null")
    ends = interpolated_quantile(rows, by, "v", upper)
    named = ends.select(*[F.col(b).alias(f"_{b}") for b in by], "lo", "hi")
    on = F.lit(True)
    for b in by:
        on = on & rows[b].eqNullSafe(named[f"_{b}"])
    width = (F.col("hi") - F.col("lo")) / bins
    binned = rows.join(named, on).filter("v <= hi").withColumn("bin", F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).cast("int"))
    return binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count"))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """``value`` and the share of values up to it, for each distinct value; ranks come from counts of distinct values."""
    from netloom.operators.ranking import ordered

    counts = df.select(number(value).alias("value")).filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return ordered(counts, ["value"], ["n"]).select("value", (F.col("cum_n") / total).alias("share"))


def resampled(curves: DataFrame, curve: str, x: str, y: str, points: int = 100) -> DataFrame:
    """Each curve at equal steps between its ends, by linear interpolation of log10 of ``y``. Curves come as at most a few thousand points.

    ``x`` ascends within a curve; ``y`` must be positive, other points do not count.
    """
    rows = curves.filter(F.col(y) > 0).select(curve, F.col(x).cast("double").alias("x"), F.log10(F.col(y).cast("double")).alias("y"))
    w = Window.partitionBy(curve).orderBy("x")
    pieces = rows.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)})
    ends = rows.groupBy(curve).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    full = pieces.join(ends, curve)
    # the grid steps that fall on a piece, without a join on the grid
    at = lambda v: f"case when hi = lo then 0D else ({v} - lo) / (hi - lo) * {points - 1} end"
    steps = full.withColumn("i", F.explode(F.expr(
        f"case when x2 is null then array(cast({points - 1} as bigint)) when ceil({at('x')}) <= ceil({at('x2')}) - 1 then sequence(cast(ceil({at('x')}) as bigint), cast(ceil({at('x2')}) - 1 as bigint)) end"
    )))
    gx = F.expr(f"lo + (hi - lo) * i / {points - 1}")
    gy = F.when(F.col("x2").isNull(), F.col("y")).otherwise(F.col("y") + (F.col("y2") - F.col("y")) * (gx - F.col("x")) / (F.col("x2") - F.col("x")))
    return steps.select(curve, F.col("i").cast("int").alias("step"), gx.alias("x"), gy.alias("log_y"))


def geometric_band(resampled_: DataFrame, step: str = "step") -> DataFrame:
    """Mean curve and band of one deviation, over log10 values, by grid step."""
    out = resampled_.groupBy(step).agg(F.avg("log_y").alias("m"), F.coalesce(F.stddev_pop("log_y"), F.lit(0.0)).alias("s"))
    ten = F.lit(10.0)
    return out.select(step, F.pow(ten, "m").alias("mean"), F.pow(ten, F.col("m") - F.col("s")).alias("low"), F.pow(ten, F.col("m") + F.col("s")).alias("high"))


def marker_positions(df: DataFrame, x: str, index: str, markers: int = 5) -> DataFrame:
    """The distinct indices nearest to ``markers`` equal steps of ``x`` between its ends."""
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    steps = F.explode(F.transform(F.sequence(F.lit(0), F.lit(markers - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / max(markers - 1, 1)))
    # at most ``markers`` targets meet each row, in one pass
    rows = df.select(F.col(x).alias("x"), F.col(index).alias("i")).join(F.broadcast(ends), F.lit(True))
    near = rows.select("x", "i", steps.alias("target")).groupBy("target").agg(F.min_by("i", F.struct(F.abs(F.col("x") - F.col("target")), F.col("i"))).alias("position"))
    return near.select("position").distinct()
