"""Sets of points of coordinate sequences, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a point begins with, without outer spaces: three integers in brackets, white space only after the commas.
POINT = r"(?s)^(-?)0*(\d+),\s*(-?)0*(\d+),\s*(-?)0*(\d+)\).*$"
MIN_POINTS = 8


def point_hashes(tree: str) -> Column:
    """Sorted distinct hashes of the points of an array of strings.

    Points are equal if their integers are: leading zeros and ``-0`` are read as numbers, of any length.
    Null elements, markers and anything else that is no point are left out; a null array stays null.
    Two different points share a 64-bit hash with a chance of about 1e-19 a pair.
    """
    return F.expr(
        f"""sort_array(array_distinct(transform(
              filter(
                transform(
                  filter({tree}, e -> ltrim(' \\t\\r\\n', e) like '(%'),
                  e -> regexp_replace(substring(ltrim(' \\t\\r\\n', e), 2), r'{POINT}', '$1$2,$3$4,$5$6')),
                s -> not s like '%)%'),
              s -> xxhash64(if(s like '%-0%', regexp_replace(s, r'-0(?=,|$)', '0'), s)))))"""
    )


def with_sets(df: DataFrame, key: str, tree: str, *keep: str) -> DataFrame:
    """``key``, the columns to keep, ``pts``, ``n`` and the 128-bit name ``k1``, ``k2`` of the set, of rows with at least 8 points."""
    sets = df.select(F.col(key), *keep, point_hashes(tree).alias("pts")).withColumn("n", F.size("pts"))
    return sets.filter(F.col("n") >= MIN_POINTS).withColumns({"k1": F.xxhash64("pts"), "k2": F.xxhash64("pts", F.lit(1))})


def budget(a: Column, b: Column) -> Column:
    """Most points two sets of these sizes can differ by, at a similarity of 0.8: floor((a + b) / 9).

    With d points in only one of the sets, the similarity is (a + b - d) / (a + b + d).
    """
    return F.floor((a + b) / F.lit(9)).cast("int")
