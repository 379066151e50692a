"""Groups of rows whose point sets are near, by a Gray-order hierarchical index.

Exact at every size: near rows (similarity of point sets >= 0.8, at least 8 points each) always end in one group.

1. Rows with the same set become one *representative*; copies cost one partial aggregation, however many there are.
2. A fingerprint has two parts. Its *words*: the points of a set are dealt by hash to ``m`` words, one more than two sets of the
   size class can differ in points, and a word is the exclusive or of its points. So near sets agree on a whole word. Its
   *parity*: bit ``h mod 128`` is flipped by each point, so parities never differ in more bits than the sets in points.
3. The upper nodes of the index are shared masked patterns: size class, number of a word and its first bits. They spread over
   the tasks; with ``NODE_ROWS`` sets below each on average there are few of them, and finding pairs is left to the index.
4. Below an upper node, fingerprints (the word, then the parity) are sorted by Gray rank and built into a tree: a node
   holds the bits on which all below it agree (mask and pattern). Pairs of nodes are searched from the top. The bits in which two
   patterns differ under both masks can only grow downwards, so both whole groups are pruned as soon as they differ in the
   word, or in more of the parity than their sizes allow.
5. An upper node of more than ``BLOCK_ROWS`` sets (a point of a third of all rows, or a word without points) is refined: its
   sets are dealt anew to ``m`` other words, whose patterns make the upper nodes of the next level. That costs ``m`` rows a set,
   whatever the size of the node. Only what is still as large after ``LEVELS`` levels, sets that agree on a pattern of every
   level, is searched by pairs of tiles. Nothing is capped.
6. Candidates are checked on their full sets, and links are closed by alternating large-star and small-star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.components import components
from netloom.llm.pointsets import MIN_POINTS, with_sets
from netloom.session import stored

NODE_ROWS = 1024
BLOCK_ROWS = 8192
LEVELS = 2
FAN = 4
FRONTIER = 1 << 17
BATCH_ROWS = 1 << 16
#: Size classes: the least size of each, half as large again as the last.
CLASSES = [MIN_POINTS]
while CLASSES[-1] < 1 << 31:
    CLASSES.append(CLASSES[-1] * 3 // 2)
WORDS = np.array([(c - 1) // 4 + 1 for c in CLASSES[1:]], dtype=np.int64)
ONE = np.uint64(1)


def gray_rank(words: np.ndarray) -> np.ndarray:
    """Position of codes, given as columns of uint64 from the highest on, in the reflected Gray sequence."""
    out = words.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    for i in range(1, out.shape[1]):
        # the parity of a word runs on through the next
        out[:, i] ^= np.where(out[:, i - 1] & ONE == 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    return out


class GrayIndex:
    """Trees over fingerprints, one for each block, all in the same arrays.

    Level 0 holds the fingerprints in order of block and Gray rank. A node of level k covers up to FAN
    neighbouring nodes of level k - 1 of its block, until each block has one node. Column 0 of ``codes`` must be equal in a
    pair, the others may differ in ``(x + y) // 9`` bits for sets of sizes x and y. Rows of equal ``side`` are not paired,
    unless it is negative.
    """

    def __init__(self, block: np.ndarray, codes: np.ndarray, sizes: np.ndarray, side: np.ndarray | None = None) -> None:
        rank = gray_rank(codes)
        self.order = np.lexsort((*rank.T[::-1], block))
        block, codes, sizes = block[self.order], codes[self.order], sizes[self.order]
        side = np.full(len(block), -1, dtype=np.int64) if side is None else side[self.order].astype(np.int64)
        full = np.full(codes.shape, np.uint64(0xFFFFFFFFFFFFFFFF))
        #: of every level: pattern, mask, least and largest set below, side of all below, first child, end of children
        self.levels = [(codes, full, sizes, sizes, side, np.arange(len(block)), np.arange(len(block)) + 1)]
        #: of every level: pairs tested, pairs pruned, and pairs of rows below those pruned
        self.tested: dict[int, int] = {}
        self.pruned: dict[int, int] = {}
        self.pruned_rows: dict[int, int] = {}
        self.weight = [np.ones(len(block), dtype=np.int64)]
        while True:
            code, mask, least, most, side, _, _ = self.levels[-1]
            heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
            if len(heads) == len(block):
                break
            counts = np.diff(np.concatenate([heads, [len(block)]]))
            within = np.arange(len(block)) - np.repeat(heads, counts)
            first = np.flatnonzero(within % FAN == 0)
            both = np.bitwise_and.reduceat(code, first) ^ np.bitwise_or.reduceat(code, first)
            mask = np.bitwise_and.reduceat(mask, first) & ~both
            end = np.concatenate([first[1:], [len(block)]])
            one = np.minimum.reduceat(side, first)
            one = np.where(one == np.maximum.reduceat(side, first), one, -1)
            self.levels.append((np.bitwise_and.reduceat(code, first) & mask, mask, np.minimum.reduceat(least, first), np.maximum.reduceat(most, first), one, first, end))
            self.weight.append(np.add.reduceat(self.weight[-1], first))
            block = block[first]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of a block that can be near."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        # pairs of nodes still to test, or tested and still to open; never more than FRONTIER of a level are made at once
        stack = [(top, roots, roots, False)]
        while stack:
            level, a, b, tested = stack.pop()
            code, mask, least, most, side, first, end = self.levels[level]
            if not tested:
                if len(a) > FRONTIER:
                    stack += [(level, a[FRONTIER:], b[FRONTIER:], False), (level, a[:FRONTIER], b[:FRONTIER], False)]
                    continue
                able = self._able(level, a, b)
                a, b = a[able], b[able]
                if level == 0:
                    if len(a):
                        yield self.order[a], self.order[b]
                    continue
                if not len(a):
                    continue
            na, nb = end[a] - first[a], end[b] - first[b]
            count = na * nb
            cut = max(1, int(np.searchsorted(np.cumsum(count), FRONTIER, side="right")))
            if cut < len(a):
                stack.append((level, a[cut:], b[cut:], True))
                a, b, nb, count = a[:cut], b[:cut], nb[:cut], count[:cut]
            row = np.repeat(np.arange(len(a)), count)
            k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            ca, cb = first[a][row] + k // nb[row], first[b][row] + k % nb[row]
            keep = ca < cb if level == 1 else ca <= cb
            stack.append((level - 1, ca[keep], cb[keep], False))

    def _able(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code, mask, least, most, side, _, _ = self.levels[level]
        able = (side[a] != side[b]) | (side[a] < 0)
        able &= (code[a, 0] ^ code[b, 0]) & mask[a, 0] & mask[b, 0] == 0
        if level == 0 and len(self.levels) == 1:
            able &= a != b
        at = np.flatnonzero(able)
        p, q = a[at], b[at]
        differ = np.zeros(len(at), dtype=np.int64)
        for i in range(1, code.shape[1]):
            differ += np.bitwise_count((code[p, i] ^ code[q, i]) & mask[p, i] & mask[q, i])
        # sizes x, y allow (x + y) // 9 different points, and x - y is part of these
        gap = np.maximum(least[p] - most[q], least[q] - most[p])
        able[at] = np.maximum(differ, gap) <= (most[p] + most[q]) // 9
        out, w = np.flatnonzero(~able), self.weight[level]
        self.tested[level] = self.tested.get(level, 0) + len(a)
        self.pruned[level] = self.pruned.get(level, 0) + len(out)
        self.pruned_rows[level] = self.pruned_rows.get(level, 0) + int((w[a[out]] * w[b[out]]).sum())
        return able


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _fingerprints(batch: pa.RecordBatch, level: int) -> dict[str, np.ndarray]:
    """One row for each word of each set and scheme: ``row`` in the batch, ``scheme``, ``word`` and its number ``j``; and parities by row.

    A set takes part in the scheme of its own size class and, where a set of 0.8 of its size is of a lower class, in that one;
    below the first level only in the scheme of its upper node.
    """
    n = batch.column("n").to_numpy().astype(np.int64)
    lists = batch.column("pts")
    offsets = lists.offsets.to_numpy()
    points = lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
    of = np.repeat(np.arange(len(n)), np.diff(offsets))
    parity = np.zeros(len(n) * 2, dtype=np.uint64)
    np.bitwise_xor.at(parity, of * 2 + ((points >> np.uint64(6)) & ONE).astype(np.int64), ONE << (points & np.uint64(63)))
    own = np.searchsorted(CLASSES, n, side="right") - 1
    if level:
        row, scheme = np.arange(len(n)), batch.column("scheme").to_numpy().astype(np.int64)
    else:
        lower = np.searchsorted(CLASSES, (4 * n + 4) // 5, side="right") - 1
        below = np.flatnonzero((lower < own) & (lower >= 0))
        row, scheme = np.concatenate([np.arange(len(n)), below]), np.concatenate([own, lower[below]])
    m = WORDS[scheme]
    base = np.cumsum(m) - m
    words = np.zeros(int(m.sum()), dtype=np.uint64)
    deal = _mix(points, 2 * level + 1)
    value = _mix(points, 2 * level + 2)
    counts = np.diff(offsets)[row]
    at = np.repeat((offsets[:-1] - offsets[0])[row] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    within = np.repeat(np.arange(len(row)), counts)
    np.bitwise_xor.at(words, base[within] + (deal[at] % m[within].astype(np.uint64)).astype(np.int64), value[at])
    entry = np.repeat(np.arange(len(row)), m)
    return {
        "row": row[entry], "scheme": scheme[entry], "guest": (own[row] > scheme)[entry], "word": words,
        "j": np.arange(len(words)) - base[entry], "parity": parity.reshape(-1, 2),
    }


def _nodes(batch: pa.RecordBatch, e: dict[str, np.ndarray], bits: int) -> np.ndarray:
    """The upper node of each entry: its node of the level before, scheme, number of the word and first bits of the word."""
    up = batch.column("node").to_numpy()[e["row"]].view(np.uint64)
    first = e["word"] >> np.uint64(64 - bits) if bits else np.zeros(len(e["word"]), np.uint64)
    with np.errstate(over="ignore"):
        place = (e["scheme"] * (1 << 32) + e["j"]).astype(np.uint64)
        return _mix(_mix(up + place, 101) ^ first, 102).view(np.int64)


def node_sizes(work: DataFrame, level: int, bits: int) -> DataFrame:
    """``node`` and ``rows``, the sets below it; counted by batch before the sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                node, rows = np.unique(_nodes(batch, _fingerprints(batch, level), bits), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(rows.astype(np.int64))], names=["node", "rows"])

    return work.mapInArrow(run, "node bigint, rows bigint").groupBy("node").agg(F.sum("rows").alias("rows"))


def entries(work: DataFrame, level: int, bits: int) -> DataFrame:
    """One row for each word: ``node``, ``scheme``, ``sid``, ``n``, ``word``, parities ``f1``, ``f2``, and ``side``, 0 for sets above the size class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                e = _fingerprints(batch, level)
                row = e["row"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_nodes(batch, e, bits)), pa.array(e["scheme"].astype(np.int32)), pa.array(batch.column("sid").to_numpy()[row]),
                        pa.array(batch.column("n").to_numpy()[row]), pa.array(e["word"].view(np.int64)), pa.array(e["parity"][row, 0].view(np.int64)),
                        pa.array(e["parity"][row, 1].view(np.int64)), pa.array(np.where(e["guest"], 0, -1).astype(np.int32)),
                    ],
                    names=["node", "scheme", "sid", "n", "word", "f1", "f2", "side"],
                )

    return work.mapInArrow(run, "node bigint, scheme int, sid bigint, n int, word bigint, f1 bigint, f2 bigint, side int")


def index_of(table: pa.Table, keys: list[str]) -> tuple[GrayIndex, np.ndarray] | None:
    """The index of the blocks of several rows of a table sorted by ``keys``, and the ids of its rows."""
    key = np.stack([table[c].to_numpy() for c in keys], axis=1)
    block = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) - 1
    often = np.bincount(block)[block] > 1
    if not often.any():
        return None
    codes = np.stack([table[c].to_numpy()[often] for c in ("word", "f1", "f2")], axis=1).view(np.uint64)
    return GrayIndex(block[often], codes, table["n"].to_numpy()[often].astype(np.int64), table["side"].to_numpy()[often]), table["sid"].to_numpy()[often]


def search(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs ``a`` < ``b`` that the index lets through, of blocks of equal ``keys``."""

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        found = index_of(table, keys)
        if found:
            index, sid = found
            for a, b in index.pairs():
                pair = np.sort(np.stack([sid[a], sid[b]], axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted; a batch is cut where a block ends
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < BATCH_ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            new = np.zeros(table.num_rows - 1, dtype=bool)
            for c in keys:
                value = table[c].to_numpy()
                new |= value[1:] != value[:-1]
            ends = np.flatnonzero(new)
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut:
                yield from emit(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = table.num_rows - cut
        if size:
            yield from emit(pa.Table.from_batches(held).combine_chunks())

    needed = [*keys, "sid", "n", "word", "f1", "f2", "side"]
    return rows.select(*needed).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint")


def tiled(rows: DataFrame, block_rows: int) -> DataFrame:
    """The rows of nodes that stayed large, by pairs of tiles; ``rows`` is the size of the node.

    Sets that agree this far are mostly near each other, so the pairs to find outnumber the copies by far.
    """
    tiles = F.ceil(F.col("rows") / block_rows).cast("int")
    own = F.pmod(F.xxhash64("sid"), tiles).cast("int")
    # tile pair (t, u), t <= u, is number t * tiles + u; within a pair of different tiles only rows of different sides meet
    meets = F.transform(
        F.sequence(F.lit(0), tiles - 1),
        lambda u: F.struct(
            (F.least(u, own).cast("long") * tiles + F.greatest(u, own)).alias("tile"),
            F.when(u == own, F.col("side")).otherwise((own > u).cast("int") + 1).alias("side"),
        ),
    )
    return rows.select("node", "sid", "n", "word", "f1", "f2", F.inline(meets)).select("node", "tile", "sid", "n", "word", "f1", "f2", "side")


def representatives(sets: DataFrame) -> DataFrame:
    """One row ``sid``, ``n``, ``pts``, ``k1``, ``k2`` for each distinct set; ``sid`` is its least id."""
    return sets.groupBy("pts", "n", "k1", "k2").agg(F.min("id").alias("sid"))


def candidates(reps: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Distinct pairs ``a`` < ``b`` of representatives that the index lets through."""
    bits = max(0, (reps.count() // NODE_ROWS).bit_length())
    work = reps.select("sid", "n", "pts", F.lit(0).cast("long").alias("node"), F.lit(0).alias("scheme"))
    found = []
    for level in range(LEVELS):
        rows = entries(work, level, bits)
        large = stored(node_sizes(work, level, bits).filter(F.col("rows") > block_rows), "large-nodes")
        if large.isEmpty():
            found.append(search(rows, ["node"]))
            break
        found.append(search(rows.join(large, "node", "left_anti"), ["node"]))
        below = rows.join(large, "node")
        if level + 1 == LEVELS:
            found.append(search(tiled(below, block_rows), ["node", "tile"]))
        else:
            # a set is below a node as often as it has words there, which is once
            again = below.select("node", "scheme", "sid")
            work = stored(again.join(reps.select("sid", "n", "pts"), "sid").select("sid", "n", "pts", "node", "scheme"), "refined")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def links(reps: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All near pairs ``a`` < ``b`` of representatives."""
    one = reps.select(F.col("sid").alias("a"), F.col("pts").alias("pa"), F.col("n").alias("na"))
    two = reps.select(F.col("sid").alias("b"), F.col("pts").alias("pb"), F.col("n").alias("nb"))
    checked = candidates(reps, block_rows).join(one, "a").join(two, "b").withColumn("both", F.size(F.array_intersect("pa", "pb")))
    return checked.filter("both * 5 >= (na + nb - both) * 4").select("a", "b")


def near_groups(df: DataFrame, key: str = "net_id", tree: str = "tree_seq", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``key``, ``group_id`` and ``n_links`` of every row of ``df``.

    ``group_id`` is the least key of the group: rows are in one group if their sets are near, also through other rows.
    ``n_links`` counts the near sets other than the row's own. Rows with fewer than 8 points, null or empty trees are
    groups of their own. Keys must be whole numbers; a null key comes out with itself as group. Rows that share a key share
    its least group. Other columns are not read.
    """
    rows, groups, near = _grouped(df, key, tree, block_rows)
    degree = near.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count(F.lit(1)).alias("n_links"))
    of_set = groups.join(degree, "sid", "left").select("k1", "k2", "group_id", "n_links")
    of_row = rows.select("id", "k1", "k2").join(of_set, ["k1", "k2"]).select("id", "group_id", "n_links")
    everything = df.select(F.col(key).alias("id"))
    return everything.join(of_row.groupBy("id").agg(F.min("group_id").alias("group_id"), F.max("n_links").alias("n_links")), "id", "left").select(
        F.col("id").alias(key), F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def near_pairs(df: DataFrame, key: str = "net_id", tree: str = "tree_seq", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs ``net_a`` < ``net_b`` of keys in the same group, copies included. Its size is that of the result asked for.

    Keys must be unique: a key whose rows are in two groups is in pairs of both, and two such keys are a pair of each.
    """
    rows, groups, _ = _grouped(df, key, tree, block_rows)
    shared = rows.select("id", "k1", "k2").join(groups, ["k1", "k2"]).select("group_id", "id").distinct()
    left, right = shared.select("group_id", F.col("id").alias("net_a")), shared.select("group_id", F.col("id").alias("net_b"))
    return left.join(right, "group_id").filter("net_a < net_b").select("net_a", "net_b")


def _grouped(df: DataFrame, key: str, tree: str, block_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = stored(with_sets(df.select(F.col(key).cast("long").alias("id"), F.col(tree).alias("tree")).filter("id is not null"), "id", "tree"), "point-sets")
    reps = stored(representatives(rows), "representatives")
    near = stored(links(reps, block_rows), "links")
    joined = components(near, "a", "b").withColumnRenamed("node", "sid").withColumnRenamed("component", "group_id")
    groups = reps.select("sid", "k1", "k2").join(joined, "sid", "left").select("sid", "k1", "k2", F.coalesce("group_id", "sid").alias("group_id"))
    return rows, groups, near
