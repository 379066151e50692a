"""Percentiles of large numeric columns by radix selection over mergeable digit counts.

A value is read as the order-preserving integer of its IEEE bits, of which sign, exponent (with the sign the first digit) and 8 bits of
the fraction (the second digit) are kept. Counts by code are the partial result: of one day, one file, one partition, they add up.
Days are summed by code first, with partial sums before the shuffle. Then the first digit is counted; only the digits that hold a
wanted rank are followed, and the second digit is counted within these.

Stated error: the result is the value of the code next to zero, so it is off the true order statistic towards zero by less than
``2 ** -8`` (0.4 %) of it; whole numbers up to 511 in size, and zero, are exact. No row is left out of the ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRACTION_BITS = 8
STEPS = 1 << FRACTION_BITS


def code(value: str) -> Column:
    """Exponent and 8 bits of the fraction of the IEEE form of a value, as an integer in the order of the values.

    Negative values have the mirrored codes from -1 down. Sizes below the least normal number count as zero. Exact: powers of two and
    divisions by them do not round.
    """
    v = f"abs(cast({value} as double))"
    guess = f"floor(log2({v}))"
    # log2 may round over a power of two, by one at most
    e = f"({guess} - if({v} < power(2D, {guess}), 1, 0) + if({guess} < 1023 and {v} >= power(2D, {guess} + 1), 1, 0))"
    size = f"""case when {v} < 2.2250738585072014E-308D then 0 when {v} = double('Infinity') then 2047 * {STEPS}
               else ({e} + 1023) * {STEPS} + floor(({v} / power(2D, {e}) - 1D) * {STEPS}D) end"""
    return F.expr(f"cast(if({value} < 0, -1 - ({size}), {size}) as int)")


def value_of(c: str) -> Column:
    """The value of a code that is nearest to zero."""
    size = lambda x: f"if({x} = 0, 0D, if({x} div {STEPS} = 2047, double('Infinity'), power(2D, {x} div {STEPS} - 1023) * (1D + ({x} % {STEPS}) / {STEPS}D)))"
    return F.expr(f"if({c} < 0, -({size(f'(-1 - {c})')}), {size(c)})")


def partials(df: DataFrame, by: Sequence[str], day: str, values: Sequence[str]) -> DataFrame:
    """Counts ``n`` by group, day, ``metric`` and ``code``: the partial results, one set for each day.

    Null and NaN values are left out; a null group or day is one of its own.
    """
    # the metric goes through the shuffle as a small number
    metrics = F.array(*[F.struct(F.lit(i).cast("byte").alias("metric"), F.when(F.expr(f"not isnan(cast({v} as double))"), code(v)).alias("code")) for i, v in enumerate(values)])
    rows = df.select(*by, day, *values).select(*by, day, F.inline(metrics)).filter("code is not null")
    counts = rows.groupBy(*by, day, "metric", "code").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("metric", F.element_at(F.array(*map(F.lit, values)), F.col("metric") + 1))


def percentiles(parts: DataFrame, by: Sequence[str], percent: Sequence[int] = (50, 90, 95, 99)) -> DataFrame:
    """Group, ``metric``, number of values ``n`` and a column ``p<percent>`` for each percentile, from any union of partials.

    The rank of a percentile is ``ceil(n * percent / 100)``. What meets in one task of a group is a sum for each code it has, never its
    values or days.
    """
    group = [*by, "metric"]
    summed = parts.groupBy(*group, "code").agg(F.sum("n").alias("c")).withColumn("first", F.expr(f"shiftright(code, {FRACTION_BITS})"))
    rank = {p: f"((n * {p} + 99) div 100)" for p in percent}
    whole, digit = Window.partitionBy(*group), Window.partitionBy(*group, "first")
    counted = summed.withColumns({
        "n": F.sum("c").over(whole), "upto": F.sum("c").over(whole.orderBy("first").rangeBetween(Window.unboundedPreceding, Window.currentRow)), "here": F.sum("c").over(digit),
    })
    holds = {p: f"({rank[p]} > upto - here and {rank[p]} <= upto)" for p in percent}
    followed = counted.filter(" or ".join(holds.values())).withColumn("within", F.sum("c").over(digit.orderBy("code")))
    picks = [
        F.max(F.when(F.expr(f"{holds[p]} and {rank[p]} - (upto - here) > within - c and {rank[p]} - (upto - here) <= within"), F.col("code"))).alias(f"c{p}") for p in percent
    ]
    found = followed.groupBy(*group).agg(F.max("n").alias("n"), *picks)
    return found.select(*group, "n", *[value_of(f"c{p}").alias(f"p{p}") for p in percent])
