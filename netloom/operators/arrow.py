"""Batched map functions over Arrow: the engine's UDF surface for what column expressions cannot say."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_batches(df: DataFrame, columns: Sequence[str], schema: str, f: Callable[..., Sequence], keep: Sequence[str] = (), rows: int = 2000) -> DataFrame:
    """Adds columns that ``f`` computes from whole batches of ``columns``.

    ``f`` gets an Arrow array for each of ``columns`` and returns one array or list for each field of ``schema``, of the same
    length. Only ``keep`` and ``columns`` are read; the result has ``keep`` and the new fields. Batches have at most ``rows``
    rows, so memory does not grow with the data. No shuffle.
    """
    source = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    n = len(keep)
    names = [x.strip().split(" ")[0].strip("`") for x in _fields(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                out = f(*[part.column(n + i) for i in range(len(columns))])
                arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in out]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n)] + arrays, names=[f"k{i}" for i in range(n)] + names)

    kept = [f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}" for i in range(n)]
    out = source.mapInArrow(run, ", ".join(kept + [schema]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names)


def spread(scan: DataFrame) -> DataFrame:
    """A scan for work that outweighs its input by far: dealt out anew if it has fewer tasks than there are cores, as one small file has, else as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def _fields(schema: str) -> list[str]:
    """Fields of a schema text, cut at commas outside angle brackets."""
    parts, depth, now = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(now)
            now = ""
        else:
            now += c
    return [*parts, now]
