"""Trees of a whole batch of rows in flat arrays.

A tree is a list of tokens: coordinates, ``[BRANCH]`` and ``[END]``. All rows of a batch are parsed together by array passes over
nesting levels; nothing is done token by token. Nodes stand in the order of their tokens, which is depth-first pre-order, so
the nodes below a node are the range that follows it.

Rules: a coordinate's parent is the node that is current at its level; ``[BRANCH]`` remembers the current node and ``[END]``
returns to it, or does nothing where no branch is open; open branches at the end are closed. Other tokens and nulls are passed
over. Of several roots only the first keeps its nodes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from netloom.functions.tokens import TREE

NONE, COORD, BRANCH, END = 0, 1, 2, 3
POINT = r"^\s*\((?P<x>-?[0-9]+),\s*(?P<y>-?[0-9]+),\s*(?P<m>-?[0-9]+)\)"


def flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Elements of a list array and offsets from 0; a null list is empty."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    values = lists.flatten()
    return values, offsets


def parse_points(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether each string begins with a coordinate, and its three numbers. Numbers beyond 64 bits are no coordinates."""
    parts = pc.extract_regex(values, pattern=POINT)
    found = parts.is_valid().to_numpy(zero_copy_only=False)
    fields = [pc.struct_field(parts, n) for n in "xym"]
    try:
        xyz = [pc.fill_null(f.cast(pa.int64()), 0).to_numpy(zero_copy_only=False) for f in fields]
    except pa.ArrowInvalid:
        fits = np.ones(len(values), dtype=bool)
        for f in fields:
            fits &= np.array([v.as_py() is None or -(2**63) <= int(v.as_py()) < 2**63 for v in f], dtype=bool)
        found &= fits
        xyz = [np.array([int(v.as_py()) if ok else 0 for v, ok in zip(f, found)], dtype=np.int64) for f in fields]
    return found, np.stack(xyz, axis=1) if len(values) else np.zeros((0, 3), np.int64)


def levels(kind: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Number of open branches after each token; an END without one changes nothing."""
    step = (kind == BRANCH).astype(np.int64) - (kind == END)
    total = np.cumsum(step)
    if not len(total):
        return total
    first = np.concatenate([[True], row[1:] != row[:-1]])
    before = np.where(first, total - step, 0)
    base = before[np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))]
    total -= base
    far = np.int64(1) << 40
    lowest = np.minimum.accumulate(total - row * far) + row * far
    return total - np.minimum(lowest, 0)


def parents(kind: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Token index of the parent of each coordinate; -1 without one."""
    n = len(kind)
    parent = np.full(n, -1, dtype=np.int64)
    if not n:
        return parent
    level = levels(kind, row)
    index = np.arange(n)
    at = index
    current = np.full(n, -1, dtype=np.int64)
    depth = 0
    while len(at):
        here = level[at] == depth
        node = np.maximum.accumulate(np.where(here & (kind[at] == COORD), at, -1))
        node = np.where(node >= start[row[at]], node, -1)
        if depth:
            opened = np.maximum.accumulate(np.where(here & (kind[at] == BRANCH), at, -1))
            current = np.where(node > opened, node, current)
        else:
            current = node
        # a coordinate sees the node that was current one token before
        mine = np.flatnonzero(here & (kind[at] == COORD))
        if len(mine):
            before = at[mine] - 1
            place = np.searchsorted(at, before)
            ok = (before >= start[row[at[mine]]]) & (place < len(at)) & (at[np.minimum(place, len(at) - 1)] == before)
            parent[at[mine]] = np.where(ok, current[np.minimum(place, len(at) - 1)], -1)
        keep = level[at] > depth
        at, current = at[keep], current[keep]
        depth += 1
    return parent


@dataclass
class Forest:
    """Nodes of the trees of ``rows`` rows: their row, coordinates and parent (index of a node or -1), in pre-order."""

    rows: int
    row: np.ndarray
    xyz: np.ndarray
    parent: np.ndarray

    @classmethod
    def parse(cls, lists: pa.Array) -> Forest:
        values, offsets = flat(lists)
        rows = len(offsets) - 1
        coord, xyz = parse_points(values.cast(pa.string()))
        kind = np.where(coord, COORD, NONE)
        kind[pc.fill_null(pc.equal(values, TREE["BRANCH"]), False).to_numpy(zero_copy_only=False)] = BRANCH
        kind[pc.fill_null(pc.equal(values, TREE["END"]), False).to_numpy(zero_copy_only=False)] = END
        row = np.repeat(np.arange(rows), np.diff(offsets))
        return cls.of_tokens(kind, xyz, row, offsets)

    @classmethod
    def of_tokens(cls, kind: np.ndarray, xyz: np.ndarray, row: np.ndarray, offsets: np.ndarray) -> Forest:
        parent = parents(kind, row, offsets[:-1])
        rows = len(offsets) - 1
        node = np.flatnonzero(kind == COORD)
        root = node[parent[node] < 0]
        # nodes from a row's second root on are dropped
        again = root[1:][row[root[1:]] == row[root[:-1]]]
        limit = np.full(rows, len(kind), dtype=np.int64)
        np.minimum.at(limit, row[again], again)
        node = node[node < limit[row[node]]]
        name = np.full(len(kind) + 1, -1, dtype=np.int64)
        name[node] = np.arange(len(node))
        return cls(rows, row[node], xyz[node], name[parent[node]])

    # -- shape ----------------------------------------------------------------

    @property
    def n(self) -> int:
        return len(self.row)

    def children(self) -> np.ndarray:
        return np.bincount(self.parent[self.parent >= 0], minlength=self.n)

    def along_path(self, weight: np.ndarray) -> np.ndarray:
        """Sum of weights from the root to each node, by doubling steps."""
        total, up = weight.copy(), self.parent.copy()
        while (up >= 0).any():
            some = np.flatnonzero(up >= 0)
            add, further = total[up[some]], up[up[some]]
            total[some] += add
            up[some] = further
        return total

    def depth(self) -> np.ndarray:
        return self.along_path((self.parent >= 0).astype(np.int64))

    def below(self, weight: np.ndarray) -> np.ndarray:
        """Sum of weights over each node and all below it, level by level."""
        total = weight.copy()
        depth = self.depth()
        order = np.argsort(-depth, kind="stable")
        cut = np.flatnonzero(np.diff(depth[order])) + 1
        for part in np.split(order, cut):
            part = part[self.parent[part] >= 0]
            np.add.at(total, self.parent[part], total[part])
        return total

    def heads(self) -> np.ndarray:
        """Offsets of each row's nodes."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))

    def edges(self) -> np.ndarray:
        """Nodes that end an edge; the edge begins at their parent."""
        return np.flatnonzero(self.parent >= 0)

    def scaled(self, factor: np.ndarray) -> Forest:
        """Layers times a factor by row, cut towards zero."""
        xyz = self.xyz.copy()
        xyz[:, 2] = np.trunc(xyz[:, 2] * factor[self.row]).astype(np.int64)
        return replace(self, xyz=xyz)

    # -- measures by row ------------------------------------------------------

    def by_row(self, at: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        if weight is None:
            return np.bincount(self.row[at], minlength=self.rows)
        if weight.dtype.kind == "f":
            return np.bincount(self.row[at], weights=weight, minlength=self.rows).astype(np.float64)
        total = np.zeros(self.rows, dtype=np.int64)
        np.add.at(total, self.row[at], weight)
        return total

    def steps(self) -> np.ndarray:
        """Absolute differences of each node to its parent; zero for roots."""
        up = np.where(self.parent >= 0, self.parent, np.arange(self.n))
        return np.abs(self.xyz - self.xyz[up])

    def lengths(self) -> np.ndarray:
        """Wire length in the plane by row."""
        e = self.edges()
        return self.by_row(e, self.steps()[e, :2].sum(axis=1))

    def vias(self) -> np.ndarray:
        """Vias by row: half the layer difference of each edge, rounded down."""
        e = self.edges()
        return self.by_row(e, self.steps()[e, 2] // 2)

    def total_lengths(self) -> np.ndarray:
        """Length on all three axes by row."""
        return self.by_row(np.arange(self.n), self.steps().sum(axis=1)).astype(np.float64)

    def names(self) -> np.ndarray:
        """A 64-bit name for the coordinates of each node."""
        return mix(self.xyz[:, 0], self.xyz[:, 1], self.xyz[:, 2])

    def edge_names(self) -> np.ndarray:
        names, e = self.names(), self.edges()
        return mix(names[self.parent[e]], names[e])

    def leaves(self) -> np.ndarray:
        """Nodes whose coordinates occur once among all ends of the row's edges and are not the root's."""
        e = self.edges()
        name = self.names()
        ends = np.concatenate([e, self.parent[e]])
        key = mix(self.row[ends], name[ends])
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        once = ends[first[count == 1]]
        root = np.full(self.rows, -1, dtype=np.int64)
        top = np.flatnonzero(self.parent < 0)
        root[self.row[top]] = top
        return np.sort(once[name[once] != name[root[self.row[once]]]])

    # -- text -----------------------------------------------------------------

    def serialise(self, keep: np.ndarray | None = None) -> pa.ListArray:
        """The tokens of each row, with markers around each child of a node with several; nodes not kept are left out."""
        keep = np.ones(self.n, dtype=bool) if keep is None else keep
        wrapped = np.zeros(self.n, dtype=np.int64)
        e = self.edges()
        wrapped[e] = self.children()[self.parent[e]] > 1
        depth = self.along_path(wrapped)
        # branches closed before a node, and after the last of a row
        heads = self.heads()
        first = np.zeros(self.n + 1, dtype=bool)
        first[heads] = True
        close = np.zeros(self.n, dtype=np.int64)
        later = np.flatnonzero(~first[: self.n])
        close[later] = depth[later - 1] - depth[self.parent[later]]
        last = heads[1:] - 1
        tail = np.where(np.diff(heads) > 0, depth[np.maximum(last, 0)] if self.n else 0, 0)
        size = close + wrapped + keep
        total = np.concatenate([[0], np.cumsum(size)])
        tails = np.concatenate([[0], np.cumsum(tail)])
        offsets = total[heads] + tails
        text = render(self.xyz[keep])
        words = pa.concat_arrays([pa.array([TREE["BRANCH"], TREE["END"]], pa.string()), text])
        out = np.ones(int(offsets[-1]), dtype=np.int64)
        begin = total[:-1] + tails[self.row]
        out[(begin + close)[wrapped == 1]] = 0
        out[(begin + close + wrapped)[keep]] = np.arange(int(keep.sum())) + 2
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), words.take(pa.array(out)))

    def simplified(self) -> np.ndarray:
        """Which nodes stay: not those with a parent and one child that go on in the same direction or repeat a neighbour."""
        keep = np.ones(self.n, dtype=bool)
        if not self.n:
            return keep
        count = self.children()
        child = np.zeros(self.n, dtype=np.int64)
        e = self.edges()
        child[self.parent[e]] = e
        mid = np.flatnonzero((count == 1) & (self.parent >= 0))
        into = self.xyz[mid] - self.xyz[self.parent[mid]]
        out = self.xyz[child[mid]] - self.xyz[mid]
        straight = (np.sign(into) == np.sign(out)).all(axis=1)
        keep[mid] = ~(straight | (into == 0).all(axis=1) | (out == 0).all(axis=1))
        return keep


def mix(*columns: np.ndarray) -> np.ndarray:
    """A 64-bit hash of rows of integers. Rows of different width start apart, so hashes may be hashed again with others."""
    h = np.full(len(columns[0]), 0x243F6A8885A308D3 ^ (len(columns) * 0x3C6EF372FE94F82B & (1 << 64) - 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            h = (h ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
    return h


def render(xyz: np.ndarray) -> pa.Array:
    """``(x, y, m)`` of each row of numbers."""
    x, y, m = (pa.array(xyz[:, i]).cast(pa.string()) for i in range(3))
    return pc.binary_join_element_wise(pc.binary_join_element_wise("(", x, ""), y, pc.binary_join_element_wise(m, ")", ""), ", ")


def count_by_row(name: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, name) as one sorted key, and their number by row."""
    key = np.unique(mix(row, name))
    _, first = np.unique(mix(row, name), return_index=True)
    return key, np.bincount(row[first], minlength=rows)


def common_by_row(a: np.ndarray, a_row: np.ndarray, b: np.ndarray, b_row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes by row of two sets and of what they share."""
    ka, ia = np.unique(mix(a_row, a), return_index=True)
    kb, ib = np.unique(mix(b_row, b), return_index=True)
    both = np.isin(ka, kb, assume_unique=True)
    return (
        np.bincount(a_row[ia], minlength=rows), np.bincount(b_row[ib], minlength=rows), np.bincount(a_row[ia][both], minlength=rows)
    )
