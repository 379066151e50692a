"""Positions and running sums over a whole table, without one task for all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.session import stored


def ordered(df: DataFrame, order: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Adds ``rank``, from 1 in the order of the given columns, descending where a name begins with ``-``, and ``cum_<name>`` for each column of ``sums``.

    Rows are range-partitioned and sorted; each partition counts and sums its own rows, and only one row a partition, its
    totals, passes the driver. The order must be total for the ranks to be determined; nulls count as 0 in sums.
    """
    names = [c for c in df.columns]
    by = [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]
    kept = stored(
        df.repartitionByRange(*by).sortWithinPartitions(*by)
        .withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}),
        "ordered",
    )
    totals = kept.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), *[F.coalesce(F.sum(s), F.lit(0)).alias(f"_t{i}") for i, s in enumerate(sums)])
    rows = sorted(totals.collect(), key=lambda r: r["_p"])
    offsets, seen = [], [0] * (len(sums) + 1)
    for r in rows:
        offsets.append((r["_p"], *seen))
        seen = [a + r[c] for a, c in zip(seen, ["_n", *[f"_t{i}" for i in range(len(sums))]])]
    schema = ", ".join(["_p int", "_n bigint", *[f"_t{i} {totals.schema[f'_t{i}'].dataType.simpleString()}" for i in range(len(sums))]])
    base = df.sparkSession.createDataFrame(offsets, schema)
    upto = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    out = kept.join(F.broadcast(base), "_p")
    out = out.withColumns({"rank": F.col("_n") + F.col("_i") + 1} | {f"cum_{s}": F.col(f"_t{i}") + F.coalesce(F.sum(s).over(upto), F.lit(0)) for i, s in enumerate(sums)})
    return out.select(*names, "rank", *[f"cum_{s}" for s in sums])

