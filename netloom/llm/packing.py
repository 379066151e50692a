"""Filling containers of fixed capacity by harmonic classes.

An item of size s is of class ``j = capacity div s``, so no item of the class is larger than ``capacity div j``. Classes are taken from
the largest items down. A container with room r takes exactly ``r div (capacity div j)`` items of class j, which always fit: a
fixed count, whatever their own sizes. So j items fill an empty container, and finer classes fill the room that coarser ones left.
Items are placed by counting, all items of a class at once; sizes are never compared, and workers do not see each other.

There are about twice the root of the capacity classes that whole sizes can have, all used.

An item over the capacity is cut: full pieces are containers by themselves, the rest is an item like any other. What a worker
wastes beyond its last few containers is room smaller than the least items left, so waste does not grow with the data; but each
worker leaves containers unfinished, so many workers with few items each waste more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.bpe import DEFAULT_VOCAB, count_column

WINDOW = 1 << 18
#: Containers a worker keeps open between windows, those with the most room.
OPEN = 1 << 12


class Packer:
    """Numbers containers for the items of one worker, window by window; between windows only open containers are kept."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.next = 0
        self.names = np.zeros(0, dtype=np.int64)
        self.rooms = np.zeros(0, dtype=np.int64)

    def pack(self, sizes: np.ndarray) -> np.ndarray:
        """Container of each item; items of size 0 get -1. Sizes must not exceed the capacity."""
        box = np.full(len(sizes), -1, dtype=np.int64)
        some = np.flatnonzero(sizes > 0)
        kind = self.capacity // sizes[some]
        order = np.argsort(kind, kind="stable")
        some, kind = some[order], kind[order]
        starts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else np.zeros(0, np.int64)
        for lo, hi in zip(starts, [*starts[1:], len(kind)]):
            box[some[lo:hi]] = self._place(sizes[some[lo:hi]], int(kind[lo]))
        # the room that is left, largest first
        kept = np.argsort(-self.rooms, kind="stable")[:OPEN]
        kept = kept[self.rooms[kept] > 0]
        self.names, self.rooms = self.names[kept], self.rooms[kept]
        return box

    def _place(self, sizes: np.ndarray, j: int) -> np.ndarray:
        """Containers of the items of class ``j``: first the room of those there are, then new ones."""
        counts = self.rooms // (self.capacity // j)
        able = np.flatnonzero(counts)
        # the least count first, so that wide room is kept for longer
        able = able[np.argsort(counts[able], kind="stable")]
        fresh = -(-max(0, len(sizes) - int(counts.sum())) // j)
        self.names = np.concatenate([self.names, np.arange(self.next, self.next + fresh)])
        self.rooms = np.concatenate([self.rooms, np.full(fresh, self.capacity)])
        self.next += fresh
        slots = np.concatenate([np.repeat(able, counts[able]), np.repeat(np.arange(len(counts), len(self.rooms)), j)])[: len(sizes)]
        np.subtract.at(self.rooms, slots, sizes)
        return self.names[slots]


def pack(items: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``key``, ``piece``, ``start``, ``size`` and ``container`` of every item, or of every piece of an item over the capacity.

    ``start`` is where the piece begins in its item. Items of null, zero or negative size are one piece of size 0 without a
    container (null). Container numbers are unique; they hold the partition in their upper bits. Every row comes out, repeated
    ones too. No shuffle: each partition packs its own rows.
    """
    if capacity <= 0:
        raise ValueError("the capacity must be positive")
    source = items.select(F.col(key).alias("key"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity)
        base = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []

        def emit() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            keys, sizes = table.column(0).combine_chunks(), np.maximum(table.column(1).to_numpy(), 0)
            pieces = np.maximum(-(-sizes // capacity), 1)
            row = np.repeat(np.arange(len(sizes)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = number * capacity
            part = np.minimum(capacity, sizes[row] - start)
            box = packer.pack(part)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(part), pa.array(box + base, mask=box < 0)],
                names=["key", "piece", "start", "size", "container"],
            )

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= WINDOW:
                yield from emit()
                held, rows = [], 0
        if rows:
            yield from emit()

    kind = source.schema["key"].dataType.simpleString()
    packed = source.mapInArrow(run, f"key {kind}, piece int, start bigint, size bigint, container bigint")
    return packed.select(F.col("key").alias(key), "piece", "start", "size", "container")


def pack_texts(df: DataFrame, capacity: int, key: str = "doc_id", text: str = "text", vocab_path: str = DEFAULT_VOCAB) -> DataFrame:
    """:func:`pack` of texts sized in tokens of a public tokenizer; null and empty texts have size 0."""
    return pack(count_column(df, key, text, vocab_path), capacity, key)


def containers(packed: DataFrame, capacity: int) -> DataFrame:
    """``container``, ``items``, ``used`` and ``unused`` of every container."""
    used = packed.filter("container is not null").groupBy("container").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("used"))
    return used.withColumn("unused", capacity - F.col("used"))
