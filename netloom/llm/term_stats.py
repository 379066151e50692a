"""How often every term occurs, and in how many records, by a range-partitioned external sort and a run-length scan.

Each record first counts its own terms (sort and run lengths inside the row), so a pair travels once however often the term
stands in the record. Pairs of term and record are range-partitioned and sorted, spilling to disk where they exceed memory;
since the record is part of the sort key, a term of a third of all records spreads over as many partitions as it needs.
A scan of equal neighbours then gives one partial row for each term and partition, and partials are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.session import stored

#: Runs without space, tab and line feed.
TERMS = "filter(split({0}, '[ \\\\t\\\\n]'), t -> t <> '')"


def record_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """``token``, ``record``, ``occ`` and ``first``: the distinct terms of every row with their number in it, one of them marked as the first."""
    rows = df.select(F.col(key).alias("record"), F.col(text).cast("string").alias("text")).filter("text is not null")
    rows = rows.select("record", F.expr(f"sort_array({TERMS.format('text')})").alias("s")).filter("size(s) > 0")
    rows = rows.select("record", "s", F.expr("filter(sequence(0, size(s) - 1), i -> i = 0 or s[i] <> s[i - 1])").alias("at"))
    runs = "transform(at, (p, j) -> struct(s[p] as token, coalesce(get(at, j + 1), size(s)) - p as occ, j = 0 as first))"
    return rows.select("record", F.expr(f"inline({runs})")).select("token", "record", F.col("occ").cast("long").alias("occ"), "first")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        token, occ = batch.column(0), batch.column(1).to_numpy()
        new = pc.not_equal(token.slice(1), token.slice(0, len(token) - 1)).to_numpy(zero_copy_only=False)
        head = np.concatenate([[0], np.flatnonzero(new) + 1])
        length = np.diff(np.concatenate([head, [len(token)]]))
        yield pa.RecordBatch.from_arrays(
            [token.take(pa.array(head)), pa.array(np.add.reduceat(occ, head)), pa.array(length, pa.int64())], names=["token", "occurrences", "records"]
        )


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``token``, ``occurrences`` and ``records`` of every term of ``text``.

    Terms are compared as written. Null, empty and blank texts have none. Every row counts as a record, also one that repeats
    another or its key; the key only spreads the sort. An empty table gives an empty result.
    """
    return _sorted_counts(stored(record_terms(df, key, text), "record-terms"))


def _sorted_counts(terms: DataFrame) -> DataFrame:
    # range boundaries are sampled in a pass of their own, so the texts are split once, into a table, which is read twice
    pairs = terms.select("token", "record", "occ").repartitionByRange(F.col("token"), F.col("record")).sortWithinPartitions("token", "record")
    partial = pairs.select("token", "occ").mapInArrow(_scan, "token string, occurrences bigint, records bigint")
    return partial.groupBy("token").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark(records: Column, total: Column, rare: int = 2, common: float = 0.5) -> Column:
    """``rare`` for terms of at most ``rare`` records, else ``common`` for those of more than that share of all; else null."""
    return F.when(records <= rare, "rare").when(records > total * common, "common")


def term_statistics(df: DataFrame, key: str, text: str, rare: int = 2, common: float = 0.5) -> DataFrame:
    """:func:`term_counts` with a ``mark``; the share is of the rows that have a term."""
    terms = stored(record_terms(df, key, text), "record-terms")
    total = terms.filter("first").count()
    return _sorted_counts(terms).withColumn("mark", mark(F.col("records"), F.lit(total), rare, common))
