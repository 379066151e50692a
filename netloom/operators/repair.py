"""Repair of predicted trees: every load connected at low cost, nothing left over.

A tree's edges are cut wherever loads or other edges touch them. Loads off the tree get lattice edges to their nearest node on
an allowed layer. In the graph of both, a Steiner tree over driver and loads is approximated by shortest paths between the
regions around terminals (Mehlhorn 1988), then stripped of ends that serve nothing.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from netloom.functions.tokens import TREE
from netloom.operators.arrow import map_batches
from netloom.operators.forest import Forest, flat, parse_points

#: Cells of edges by points that are compared at once.
CELLS = 1 << 20
#: Which of two ends each corner of a box takes on each axis.
CORNERS = np.indices((2, 2, 2)).reshape(3, 8).T

Point = tuple[int, int, int]
Edge = tuple[Point, Point]


def distance(a: Point, b: Point) -> int:
    return abs(a[0] - b[0]) + abs(a[1] - b[1]) + abs(a[2] - b[2])


def cut_edges(edges: list[Edge], points: list[Point]) -> list[Edge]:
    """Edges cut at every one of the points that lies inside them, in order from their start."""
    if not edges or not points:
        return edges
    ends = np.array(edges, dtype=np.int64)
    p = np.array(points, dtype=np.int64)
    step = max(1, CELLS // len(points))
    out: list[Edge] = []
    for lo in range(0, len(edges), step):
        part = edges[lo : lo + step]
        stops: dict[int, set[Point]] = {}
        for i, j in zip(*(x.tolist() for x in np.nonzero(_inside(ends[lo : lo + step, None, 0], ends[lo : lo + step, None, 1], p[None])))):
            stops.setdefault(i, set()).add(points[j])
        for i, (a, b) in enumerate(part):
            if i not in stops:
                out.append((a, b))
                continue
            way = [a, *sorted(stops[i], key=lambda q, a=a: (distance(a, q), q)), b]
            out += [(x, y) for x, y in zip(way, way[1:]) if x != y]
    return out


def _inside(s: np.ndarray, e: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether points lie inside edges, by edge and point."""
    low, high = np.minimum(s, e), np.maximum(s, e)
    at = ((p >= low) & (p <= high)).all(axis=2)
    # along the plane axes the ends of the long side are excluded; within a layer a box counts as a whole
    flat_ = (s == e) & (e == p)
    strict = (p > low) & (p < high)
    on = np.where(flat_[..., 0], strict[..., 1], np.where(flat_[..., 1], strict[..., 0], flat_[..., 2]))
    return at & on & (p != s).any(axis=2) & (p != e).any(axis=2)


def crossings(edges: list[Edge]) -> list[Point]:
    """Points that axis-parallel edges of different axes share."""
    if not edges:
        return []
    s, e = (np.array([x[i] for x in edges], dtype=np.int64) for i in (0, 1))
    same = s == e
    axis = np.select([same[:, 0] & same[:, 2], same[:, 1] & same[:, 2], same[:, 0] & same[:, 1]], [1, 0, 2], default=-1)
    low, high = np.minimum(s, e), np.maximum(s, e)
    found: set[Point] = set()
    for one, two, level in ((0, 1, 2), (0, 2, 1), (1, 2, 0)):
        a, b = np.flatnonzero(axis == one), np.flatnonzero(axis == two)
        if not len(a) or not len(b):
            continue
        # both lie on one level of the third axis; edges along ``one`` are sorted by it and by their place on ``two``, so those an
        # edge along ``two`` can meet are a range
        places, levels = np.unique(low[a, two]), np.unique(low[a, level])
        width = len(places) + 1
        key = np.searchsorted(levels, low[a, level]) * width + np.searchsorted(places, low[a, two])
        order = np.argsort(key, kind="stable")
        a, key = a[order], key[order]
        at = np.searchsorted(levels, low[b, level])
        known = levels[np.minimum(at, len(levels) - 1)] == low[b, level]
        b, at = b[known], at[known] * width
        first = np.searchsorted(key, at + np.searchsorted(places, low[b, two], side="left"), side="left")
        last = np.searchsorted(key, at + np.searchsorted(places, high[b, two], side="right") - 1, side="right")
        count = np.maximum(last - first, 0)
        of = np.repeat(np.arange(len(b)), count)
        x = a[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        y = b[of]
        met = (low[x, one] <= low[y, one]) & (low[y, one] <= high[x, one])
        found |= set(map(tuple, np.maximum(low[x[met]], low[y[met]]).tolist()))
    return sorted(found)


def split_all(edges: list[Edge]) -> list[Edge]:
    return cut_edges(edges, crossings(edges))


def lattice(a: Point, b: Point, barred: set[int]) -> list[Edge]:
    """The sides of the box between two points: its corners that differ on one axis. In the plane not on barred layers; a line is one edge anyway."""
    corners = np.unique(np.array([a, b])[CORNERS, np.arange(3)], axis=0)
    one, two = np.triu_indices(len(corners), 1)
    differs = corners[one] != corners[two]
    side = differs.sum(axis=1) == 1
    if len(corners) > 2:
        side &= differs[:, 2] | ~np.isin(corners[one, 2], list(barred))
    elif len(corners) < 2:
        return [(a, a)]
    return list(zip(map(tuple, corners[one[side]].tolist()), map(tuple, corners[two[side]].tolist())))


def connections(edges: list[Edge], loads: list[Point], driver: Point) -> list[Edge]:
    """Edges from every load off the tree to its nearest allowed node. Layers of loads are barred unless the tree has no others."""
    nodes = {p for edge in edges for p in edge}
    missing = [p for p in loads if p not in nodes]
    if not missing:
        return []
    nodes.discard(driver)
    if not nodes:
        nodes = {driver}
    barred = {p[2] for p in loads}
    if {p[2] for p in nodes} <= barred:
        barred = set()
    open_ = sorted(p for p in nodes if p[2] not in barred)
    out: list[Edge] = []
    if open_:
        grid = np.array(open_, dtype=np.int64)
        for p in missing:
            out += lattice(open_[int(np.abs(grid - np.array(p)).sum(axis=1).argmin())], p, barred)
    return split_all(out)


def steiner(edges: list[Edge], terminals: list[Point]) -> list[Edge]:
    """Edges of a tree over the terminals that can be reached, of at most twice the least cost."""
    near: dict[Point, dict[Point, int]] = defaultdict(dict)
    for a, b in edges:
        if a != b:
            near[a][b] = near[b][a] = distance(a, b)
    ends = sorted({t for t in terminals if t in near})
    if len(ends) < 2:
        return []
    # shortest paths from all terminals at once: the terminal, distance and last step of every node
    best: dict[Point, tuple[int, Point, Point | None]] = {}
    heap: list[tuple[int, Point, Point, Point | None]] = [(0, t, t, None) for t in ends]
    while heap:
        d, node, source, back = heapq.heappop(heap)
        if node in best:
            continue
        best[node] = (d, source, back)
        for other, size in near[node].items():
            if other not in best:
                heapq.heappush(heap, (d + size, other, source, node))
    bridges = sorted(
        (best[a][0] + size + best[b][0], a, b) for a in best for b, size in near[a].items() if a < b and best[a][1] != best[b][1]
    )
    root = {t: t for t in ends}

    def find(x: Point) -> Point:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links: dict[Point, set[Point]] = defaultdict(set)
    for _, a, b in bridges:
        x, y = find(best[a][1]), find(best[b][1])
        if x == y:
            continue
        root[x] = y
        links[a].add(b)
        links[b].add(a)
        for node in (a, b):
            while (back := best[node][2]) is not None:
                links[node].add(back)
                links[back].add(node)
                node = back
    # the union of shortest paths is a tree; strip ends that are no terminals
    wanted = set(ends)
    loose = [p for p in links if len(links[p]) == 1 and p not in wanted]
    while loose:
        p = loose.pop()
        (q,) = links.pop(p)
        links[q].discard(p)
        if len(links[q]) == 1 and q not in wanted:
            loose.append(q)
    return sorted((a, b) for a in links for b in links[a] if a < b)


def rooted(edges: list[Edge], driver: Point) -> tuple[list[str], list[Edge]]:
    """Tokens and parent-to-child edges of the tree of some edges, from the driver, or from the first point if it is not on it."""
    near: dict[Point, list[Point]] = defaultdict(list)
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    root = driver if driver in near or not near else min(near)
    tokens: list[str] = []
    out: list[Edge] = []
    seen = {root}
    stack: list[object] = [(root, False)]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            tokens.append(top)
            continue
        node, wrapped = top
        if wrapped:
            tokens.append(TREE["BRANCH"])
            stack.append(TREE["END"])
        tokens.append(f"({node[0]}, {node[1]}, {node[2]})")
        below = [p for p in near[node] if p not in seen]
        seen.update(below)
        out += [(node, p) for p in below]
        stack += [(p, len(below) > 1) for p in reversed(below)]
    return tokens, out


def cost(edges: set[Edge]) -> tuple[float, float]:
    """Plane length and vias of some edges; a via is half a layer step, rounded down."""
    return (float(sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for a, b in edges)), float(sum(abs(a[2] - b[2]) // 2 for a, b in edges)))


def repair(driver: Point, edges: list[Edge], loads: list[Point]) -> tuple[list[str], tuple[float, float, float, float]]:
    """Tokens of the repaired tree, and removed and added plane length and vias."""
    pieces = split_all(cut_edges(edges, loads))
    added = connections(pieces, loads, driver)
    graph = pieces + added
    if not graph:
        if loads and loads != [driver]:
            graph = [e for p in loads if p != driver for e in lattice(driver, p, set())]
        if not graph:
            return [f"({driver[0]}, {driver[1]}, {driver[2]})"], (0.0, 0.0, 0.0, 0.0)
    chosen = steiner(graph, [driver, *loads])
    tokens, final = rooted(chosen, driver)
    old, new = set(pieces), set(final)
    removed, grown = cost(old - new), cost(new - old)
    return tokens, (removed[0], removed[1], grown[0], grown[1])


def repair_trees(df: DataFrame, key: str, tree: str, loads: str, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """``key``, ``keep``, ``post_tree_seq`` and ``post_remove_wirelength_cost, post_remove_via_cost, post_add_wirelength_cost, post_add_via_cost``.

    Trees and loads are relative to the driver. Rows without loads keep their tree, re-serialised, at no cost; loads that are no
    coordinates are left out. A null or empty tree is its driver alone.
    """

    def run(trees: pa.Array, targets: pa.Array) -> list:
        f = Forest.parse(trees)
        heads = f.heads()
        values, offsets = flat(targets)
        ok, at = parse_points(values.cast(pa.string()))
        plain = f.serialise().to_pylist()
        points = list(map(tuple, f.xyz.tolist()))
        where = list(map(tuple, at.tolist()))
        out, costs = [], []
        for r in range(f.rows):
            lo, hi = heads[r], heads[r + 1]
            wanted = list(dict.fromkeys(where[i] for i in range(offsets[r], offsets[r + 1]) if ok[i]))
            if not wanted:
                out.append(plain[r])
                costs.append((0.0, 0.0, 0.0, 0.0))
                continue
            edges = [(points[f.parent[i]], points[i]) for i in range(lo, hi) if f.parent[i] >= 0]
            tokens, c = repair(points[lo] if hi > lo else (0, 0, 0), edges, wanted)
            out.append(tokens)
            costs.append(c)
        columns = list(zip(*costs)) if costs else [[], [], [], []]
        return [pa.array(out, pa.list_(pa.string()))] + [pa.array(c, pa.float64()) for c in columns]

    names = ["post_remove_wirelength_cost", "post_remove_via_cost", "post_add_wirelength_cost", "post_add_via_cost"]
    return map_batches(df, [tree, loads], "post_tree_seq array<string>, " + ", ".join(f"{n} double" for n in names), run, [key, *keep], rows=500)
