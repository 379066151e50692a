"""Operators on coordinate trees: parsing, simplification, move sequences and the metrics of a predicted tree.

All run as Arrow maps over :class:`~netloom.operators.forest.Forest`: row-local, without shuffles, also on streams.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.tokens import CORE, TREE, segment, split_words
from netloom.operators.arrow import map_batches
from netloom.operators.forest import BRANCH, COORD, END, NONE, Forest, common_by_row, flat, levels, mix, parents, parse_points

EMPTY = ["(0, 0, 0)"]
DB_UNIT = 2000.0
CELLS = 1 << 20


# -- parsing and rewriting -----------------------------------------------------


def tree_shape(df: DataFrame, key: str, tree: str) -> DataFrame:
    """``key`` and ``n_nodes, n_edges, n_leaves, n_branches, max_depth, wirelength, vias`` of each row's tree; zeros for null and empty trees."""

    def run(lists: pa.Array) -> list:
        f = Forest.parse(lists)
        e = f.edges()
        deep = np.zeros(f.rows, dtype=np.int64)
        np.maximum.at(deep, f.row, f.depth())
        names = f.names()
        leaf = f.leaves()
        _, first = np.unique(mix(f.row[leaf], names[leaf]), return_index=True)
        split = f.children() > 1
        return [f.by_row(np.arange(f.n)), f.by_row(e), f.by_row(leaf[first]), f.by_row(np.flatnonzero(split), f.children()[split]), deep, f.lengths(), f.vias()]

    fields = "n_nodes bigint, n_edges bigint, n_leaves bigint, n_branches bigint, max_depth bigint, wirelength bigint, vias bigint"
    return map_batches(df, [tree], fields, run, [key])


def tree_edges(df: DataFrame, key: str | list[str], tree: str) -> DataFrame:
    """``key`` (one or several columns) and ``edges``, the parent-to-child pairs of points of each row in pre-order."""

    def run(lists: pa.Array) -> list:
        f = Forest.parse(lists)
        e = f.edges()
        point = lambda at: pa.StructArray.from_arrays([pa.array(f.xyz[at, i]) for i in range(3)], names=["x", "y", "m"])
        pair = pa.StructArray.from_arrays([point(f.parent[e]), point(e)], names=["s", "e"])
        at = np.searchsorted(f.row[e], np.arange(f.rows + 1)).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(at), pair)]

    kind = "struct<x:bigint,y:bigint,m:bigint>"
    return map_batches(df, [tree], f"edges array<struct<s:{kind},e:{kind}>>", run, [key] if isinstance(key, str) else key)


def simplify(df: DataFrame, key: str, tree: str, name: str = "simplified") -> DataFrame:
    """``key`` and the tree without redundant points.

    A point with a parent and a single child is redundant if the way goes on in the same direction, by the signs of the
    three differences, or if it repeats one of both; always against its neighbours in the tree as given. Markers stand around
    each child of a point with several. Null and empty trees, and those without a point, give an empty list.
    """

    def run(lists: pa.Array) -> list:
        f = Forest.parse(lists)
        return [f.serialise(f.simplified())]

    return map_batches(df, [tree], f"{name} array<string>", run, [key])


def target_tokens(df: DataFrame, key: str, tree: str, name: str = "target", keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """``key``, ``keep`` and the array of moves that draws a tree relative to its driver.

    Each point is the moves from the point before it in the tree, in the order x, y, layer, from (0, 0, 0) for a first one;
    ``[BRANCH]`` and ``[END]`` become ``<PUSH>`` and ``<POP>``; open branches are closed and ``<EOS>`` ends the sequence. A null
    tree stays null.
    """

    def run(lists: pa.Array) -> list:
        values, offsets = flat(lists)
        rows = len(offsets) - 1
        row = np.repeat(np.arange(rows), np.diff(offsets))
        coord, xyz = parse_points(values.cast(pa.string()))
        kind = np.where(coord, COORD, NONE)
        for token, k in ((TREE["BRANCH"], BRANCH), (TREE["END"], END)):
            kind[pc.fill_null(pc.equal(values, token), False).to_numpy(zero_copy_only=False)] = k
        parent = parents(kind, row, offsets[:-1])
        delta = xyz - np.where((parent >= 0)[:, None], xyz[np.maximum(parent, 0)], 0)
        n = len(kind)
        # four slots a token: moves on three axes, and a marker
        size = np.zeros((n, 4), dtype=bool)
        size[:, :3] = (kind == COORD)[:, None] & (delta != 0)
        size[:, 3] = (kind == BRANCH) | (kind == END)
        words = [pa.array(["<PUSH>", "<POP>", "<EOS>"], pa.string())]
        code = np.zeros((n, 4), dtype=np.int64)
        code[:, 3] = kind == END
        used = 3
        for axis, (up, down) in enumerate(("RL", "UD", "TB")):
            at = np.flatnonzero(size[:, axis])
            letter = pa.array(np.where(delta[at, axis] > 0, up, down).astype(object), pa.string())
            words.append(pc.binary_join_element_wise(letter, pa.array(np.abs(delta[at, axis])).cast(pa.string()), ""))
            code[at, axis] = used + np.arange(len(at))
            used += len(at)
        open_ = np.zeros(rows, dtype=np.int64)
        filled = np.flatnonzero(np.diff(offsets) > 0)
        open_[filled] = levels(kind, row)[offsets[filled + 1] - 1]
        total = np.concatenate([[0], np.cumsum(size.sum(axis=1))])[offsets]
        ends = total[1:] + np.cumsum(open_ + 1)
        starts = np.concatenate([[0], ends[:-1]])
        out = np.ones(int(ends[-1]) if rows else 0, dtype=np.int64)
        body = np.flatnonzero(size.reshape(-1))
        shift = starts - total[:-1]
        out[np.arange(len(body)) + shift[row[body // 4]]] = code.reshape(-1)[body]
        out[ends - 1] = 2
        result = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.concat_arrays(words).take(pa.array(out)))
        null = lists.is_null()
        return [pc.if_else(null, pa.nulls(rows, result.type), result) if null.true_count else result]

    return map_batches(df, [tree], f"{name} array<string>", run, [key, *keep])


def move_tokens(text: Column) -> Column:
    """The moves and markers of a token text: cut apart, up to the first end token, without padding and start tokens. Null has none."""
    tokens = segment(split_words(text))
    end = F.array_position(tokens, CORE["EOS"]).cast("int")
    return F.filter(F.when(end > 0, F.slice(tokens, 1, end - 1)).otherwise(tokens), lambda t: ~t.isin(CORE["PAD"], CORE["BOS"]))


def _moves(lists: pa.Array) -> Forest:
    """The tree that moves draw from (0, 0, 0). Moves by nothing, malformed moves and other tokens draw no point."""
    values, offsets = flat(lists)
    rows = len(offsets) - 1
    parts = pc.extract_regex(values, pattern=r"^(?P<d>[RLUDTB])(?P<n>[0-9]{1,18})$")
    letter = pc.fill_null(pc.struct_field(parts, "d"), "").to_numpy(zero_copy_only=False)
    size = pc.fill_null(pc.struct_field(parts, "n").cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
    delta = np.zeros((len(values) + rows, 3), dtype=np.int64)
    kind = np.zeros(len(values) + rows, dtype=np.int64)
    # a root before each row's tokens
    at = np.arange(len(values)) + np.repeat(np.arange(rows), np.diff(offsets)) + 1
    begin = offsets[:-1] + np.arange(rows)
    for axis, (up, down) in enumerate(("RL", "UD", "TB")):
        delta[at, axis] = size * ((letter == up).astype(np.int64) - (letter == down))
    kind[at] = np.where(delta[at].any(axis=1), COORD, NONE)
    for token, k in ((TREE["PUSH"], BRANCH), (TREE["POP"], END)):
        kind[at[pc.fill_null(pc.equal(values, token), False).to_numpy(zero_copy_only=False)]] = k
    kind[begin] = COORD
    row = np.repeat(np.arange(rows), np.diff(offsets) + 1)
    f = Forest.of_tokens(kind, delta, row, offsets + np.arange(rows + 1))
    f.xyz = np.stack([f.along_path(f.xyz[:, i]) for i in range(3)], axis=1) if f.n else f.xyz
    return f


def routing(df: DataFrame, key: str, text: str, name: str = "routing") -> DataFrame:
    """``key`` and the simplified coordinate tree that a token text draws; ``(0, 0, 0)`` for null and empty texts."""
    source = df.select(F.col(key).alias("k"), move_tokens(F.col(text)).alias("moves"))

    def run(lists: pa.Array) -> list:
        f = _moves(lists)
        return [f.serialise(f.simplified())]

    return map_batches(source, ["moves"], f"{name} array<string>", run, ["k"]).withColumnRenamed("k", key)


def drawn_and_true(df: DataFrame, key: str, moves: str, tree: str, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """``key``, ``keep``, ``pred``, the simplified tree that an array of moves draws, and ``true``, the simplified tree given."""

    def run(moved: pa.Array, given: pa.Array) -> list:
        p, t = _moves(moved), Forest.parse(given)
        return [p.serialise(p.simplified()), t.serialise(t.simplified())]

    return map_batches(df, [moves, tree], "pred array<string>, true array<string>", run, [key, *keep])


def validate(df: DataFrame, key: str, tree: str, loads: str) -> DataFrame:
    """``key``, ``n_points`` and the checks of a strict routing tree: ``has_duplicates`` (a point twice, which also is a cycle), ``is_rectilinear``
    (every edge on one axis), ``leaves_are_loads``, ``loads_are_points`` and ``is_valid``, all of them for a tree with a point.

    Points that do not hang on the first root are no part of the tree, so what is in it can be reached. Null and empty trees are not valid.
    """

    def run(lists: pa.Array, targets: pa.Array) -> list:
        f = Forest.parse(lists)
        names, leaf, e = f.names(), f.leaves(), f.edges()
        n = f.by_row(np.arange(f.n))
        distinct, _, _ = common_by_row(names, f.row, names, f.row, f.rows)
        straight = (f.steps()[e] != 0).sum(axis=1) == 1
        values, offsets = flat(targets)
        ok, at = parse_points(values.cast(pa.string()))
        row, at = np.repeat(np.arange(f.rows), np.diff(offsets))[ok], at[ok]
        wanted = mix(at[:, 0], at[:, 1], at[:, 2])
        n_loads, _, met = common_by_row(wanted, row, names, f.row, f.rows)
        n_leaves, _, useful = common_by_row(names[leaf], f.row[leaf], wanted, row, f.rows)
        twice, rectilinear = distinct < n, f.by_row(e[~straight]) == 0
        checks = [n_leaves == useful, n_loads == met]
        return [n, twice, rectilinear, *checks, (n > 0) & ~twice & rectilinear & checks[0] & checks[1]]

    fields = "n_points bigint, has_duplicates boolean, is_rectilinear boolean, leaves_are_loads boolean, loads_are_points boolean, is_valid boolean"
    return map_batches(df, [tree, loads], fields, run, [key])


# -- metrics -------------------------------------------------------------------


def scale_factor(a: Forest, b: Forest) -> np.ndarray:
    """By row: half the sum of both plane extents of two trees together, over their layer extent; 1 without layers."""
    low = np.full((a.rows, 3), np.iinfo(np.int64).max)
    high = np.full((a.rows, 3), np.iinfo(np.int64).min)
    for f in (a, b):
        np.minimum.at(low, f.row, f.xyz)
        np.maximum.at(high, f.row, f.xyz)
    some = high[:, 0] >= low[:, 0]
    extent = np.where(some[:, None], high - np.where(some[:, None], low, 0), 0).astype(np.float64)
    return np.where(extent[:, 2] != 0, (extent[:, 0] + extent[:, 1]) / 2 / np.where(extent[:, 2] == 0, 1, extent[:, 2]), 1.0)


def elmore(f: Forest, sinks: np.ndarray, resistance: float = 1.0, capacitance: float = 1.0, load: float = 1.0) -> np.ndarray:
    """Largest Elmore delay by row. ``sinks`` marks nodes at loads; nodes without children count as ends too.

    Lengths are in the plane, over 2000. An edge delays by its resistance times all capacitance below it, its own included.
    """
    length = f.steps()[:, :2].sum(axis=1) / DB_UNIT
    below = f.below(length * capacitance + sinks * load)
    delay = f.along_path(length * resistance * np.where(f.parent >= 0, below, 0.0))
    end = np.flatnonzero((f.parent >= 0) & (sinks | (f.children() == 0)))
    most = np.zeros(f.rows)
    np.maximum.at(most, f.row[end], delay[end])
    return most


def _sinks(f: Forest, loads: np.ndarray, load_row: np.ndarray) -> np.ndarray:
    """Nodes at a load; in rows without loads the leaves, else the root."""
    name = mix(f.row, f.names())
    at = np.isin(name, mix(load_row, loads))
    has = np.bincount(load_row, minlength=f.rows) > 0
    leaf = np.zeros(f.n, dtype=bool)
    leaf[f.leaves()] = True
    leaf = np.isin(name, name[leaf])
    some_edge = f.by_row(f.edges()) > 0
    other = np.where(some_edge[f.row], leaf, f.parent < 0)
    return np.where(has[f.row], at, other)


def match_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy one-to-one matching of two sets of points: the closest pair first, ties by the order of ``a``, then ``b``.

    Up to ``CELLS`` distances are sorted at once. Beyond, each point of ``a`` keeps its nearest free point of ``b``, and looks for another
    when that is taken; memory then grows with the points, not their pairs.
    """
    if len(a) * len(b) > CELLS:
        return _match_by_nearest(a, b)
    near = np.abs(a[:, None, :] - b[None, :, :]).sum(axis=2).reshape(-1)
    free_a, free_b = np.ones(len(a), dtype=bool), np.ones(len(b), dtype=bool)
    left, right = [], []
    most = min(len(a), len(b))
    for at in np.argsort(near, kind="stable").tolist():
        i, j = divmod(at, len(b))
        if free_a[i] and free_b[j]:
            free_a[i] = free_b[j] = False
            left.append(i)
            right.append(j)
            if len(left) == most:
                break
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def _match_by_nearest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    free = np.arange(len(b))
    taken = np.zeros(len(b), dtype=bool)

    def nearest(i: int) -> tuple[int, int, int]:
        away = np.abs(b[free] - a[i]).sum(axis=1)
        away[taken[free]] = np.iinfo(np.int64).max
        j = int(away.argmin())
        return int(away[j]), i, int(free[j])

    heap = [nearest(i) for i in range(len(a))]
    heapq.heapify(heap)
    left, right = [], []
    while heap and len(right) < len(b):
        _, i, j = heapq.heappop(heap)
        if taken[j]:
            if len(free) > 2 * (len(b) - len(right)):
                free = free[~taken[free]]
            heapq.heappush(heap, nearest(i))
            continue
        taken[j] = True
        left.append(i)
        right.append(j)
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def _equal_nodes(a: Forest, b: Forest) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of both whose points are equal, paired within rows: the first of a point with the first, the second with the second."""
    sides = []
    for f in (a, b):
        name = mix(f.row, f.names())
        order = np.argsort(name, kind="stable")
        fresh = np.concatenate([[True], name[order][1:] != name[order][:-1]]) if f.n else np.zeros(0, bool)
        index = np.arange(f.n)
        nth = index - np.maximum.accumulate(np.where(fresh, index, 0)) if f.n else index
        sides.append((order, mix(name[order].view(np.int64), nth)))
    (oa, ka), (ob, kb) = sides
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    return oa[i], ob[j]


def edit_costs(a: Forest, b: Forest) -> dict[str, np.ndarray]:
    """Costs by row of turning tree ``a`` into ``b``: distances of matched points, and edge lengths of those left over.

    The closest pairs match first, so equal points match, in their order; only what both sides have left is compared by distance.
    """
    i, j = _equal_nodes(a, b)
    rest_a, rest_b = np.ones(a.n, dtype=bool), np.ones(b.n, dtype=bool)
    rest_a[i], rest_b[j] = False, False
    matches = a.by_row(i)
    moved = np.zeros(a.rows)
    left, right = np.flatnonzero(rest_a), np.flatnonzero(rest_b)
    at, bt = (np.searchsorted(f.row[x], np.arange(a.rows + 1)) for f, x in ((a, left), (b, right)))
    for r in np.flatnonzero((np.diff(at) > 0) & (np.diff(bt) > 0)).tolist():
        x, y = left[at[r] : at[r + 1]], right[bt[r] : bt[r + 1]]
        p, q = match_nodes(a.xyz[x], b.xyz[y])
        rest_a[x[p]], rest_b[y[q]] = False, False
        matches[r] += len(p)
        moved[r] = np.abs(a.xyz[x[p]] - b.xyz[y[q]]).sum()
    lost = a.by_row(np.flatnonzero(rest_a), a.steps().sum(axis=1)[rest_a]).astype(np.float64)
    grown = b.by_row(np.flatnonzero(rest_b), b.steps().sum(axis=1)[rest_b]).astype(np.float64)
    return {
        "red_substitution_cost": moved, "red_deletion_cost": lost, "red_insertion_cost": grown, "red_total_cost": moved + lost + grown,
        "red_num_pred_nodes": a.by_row(np.arange(a.n)), "red_num_gt_nodes": b.by_row(np.arange(b.n)), "red_num_matches": matches,
    }


METRICS = (
    "is_perfect_match boolean, is_branch_struct_match boolean, branch_count_pred bigint, branch_count_true bigint, num_edges_pred bigint, "
    "num_edges_true bigint, num_leaves_pred bigint, num_leaves_true bigint, edge_accuracy double, edge_precision double, edge_recall double, "
    "edge_iou double, leaf_accuracy double, leaf_precision double, leaf_recall double, leaf_iou double, is_leaf_set_match boolean, "
    "len_coords_pred bigint, len_coords_true bigint, is_connected_all_loads boolean, is_graceful boolean, num_vias_pred bigint, "
    "num_vias_true bigint, via_ratio double, wirelength_pred bigint, wirelength_true bigint, wirelength_ratio double, "
    "max_elmore_delay_pred double, max_elmore_delay_true double, max_elmore_delay_ratio double, red_total_cost double, "
    "red_substitution_cost double, red_deletion_cost double, red_insertion_cost double, red_num_pred_nodes bigint, red_num_gt_nodes bigint, "
    "red_num_matches bigint, red_total_wirelength_pred double, red_total_wirelength_true double, red_normalization_factor double, "
    "red_similarity_score double"
)
NAMES = [f.split()[0] for f in METRICS.split(", ")]


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b; without b, 1 where there is no a either, else 0."""
    return np.where(b > 0, a / np.where(b > 0, b, 1), np.where(a == 0, 1.0, 0.0))


def part(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, a / np.maximum(b, 1), 0.0)


def _same_lists(a: pa.Array, b: pa.Array, only: tuple[str, ...] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Whether two list columns are equal by row, of all elements or only some, and the number of ``[BRANCH]`` in each."""
    out, counts = [], []
    for x in (a, b):
        values, offsets = flat(x)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        branch = pc.fill_null(pc.equal(values, TREE["BRANCH"]), False).to_numpy(zero_copy_only=False)
        counts.append(np.bincount(row[branch], minlength=len(offsets) - 1))
        if only:
            keep = pc.fill_null(pc.is_in(values, pa.array(only, pa.string())), False).to_numpy(zero_copy_only=False)
            values, row = values.filter(pa.array(keep)), row[keep]
        out.append((values.fill_null("\x00"), row, np.bincount(row, minlength=len(offsets) - 1)))
    (va, ra, na), (vb, rb, nb) = out
    same = na == nb
    ka, kb = same[ra], same[rb]
    differ = pc.not_equal(va.filter(pa.array(ka)), vb.filter(pa.array(kb))).to_numpy(zero_copy_only=False)
    same[ra[ka][differ]] = False
    return same, counts


def routing_metrics_batch(loads: pa.Array, pred: pa.Array, true: pa.Array) -> dict[str, np.ndarray]:
    """All metrics by name of predicted and true trees relative to the driver; nulls count as empty."""
    p, t = Forest.parse(pred), Forest.parse(true)
    rows = p.rows
    m: dict[str, np.ndarray] = {}
    m["is_perfect_match"], (bp, bt) = _same_lists(pred, true)
    m["is_branch_struct_match"], _ = _same_lists(pred, true, (TREE["BRANCH"], TREE["END"]))
    m["branch_count_pred"], m["branch_count_true"] = bp, bt
    pe, te = p.edges(), t.edges()
    np_, nt, both = common_by_row(p.edge_names(), p.row[pe], t.edge_names(), t.row[te], rows)
    m["num_edges_pred"], m["num_edges_true"] = p.by_row(pe), t.by_row(te)
    m["edge_accuracy"] = m["edge_recall"] = part(both, nt)
    m["edge_precision"], m["edge_iou"] = part(both, np_), part(both, np_ + nt - both)
    pl, tl = p.leaves(), t.leaves()
    pn, tn = p.names(), t.names()
    np_, nt, both = common_by_row(pn[pl], p.row[pl], tn[tl], t.row[tl], rows)
    m["num_leaves_pred"], m["num_leaves_true"] = np_, nt
    m["leaf_accuracy"] = m["leaf_recall"] = part(both, nt)
    m["leaf_precision"], m["leaf_iou"] = part(both, np_), part(both, np_ + nt - both)
    m["is_leaf_set_match"] = (np_ == both) & (nt == both)
    m["len_coords_pred"], m["len_coords_true"] = np.diff(flat(pred)[1]), np.diff(flat(true)[1])
    values, offsets = flat(loads)
    load_row = np.repeat(np.arange(rows), np.diff(offsets))
    ok, at = parse_points(values.cast(pa.string()))
    load_row, at = load_row[ok], at[ok]
    name = mix(at[:, 0], at[:, 1], at[:, 2])
    n_loads, _, met = common_by_row(name, load_row, pn, p.row, rows)
    _, _, useful = common_by_row(name, load_row, pn[pl], p.row[pl], rows)
    m["is_connected_all_loads"] = n_loads == met
    m["is_graceful"] = m["is_connected_all_loads"] & (useful == m["num_leaves_pred"])
    for k, f in (("pred", p), ("true", t)):
        m[f"num_vias_{k}"], m[f"wirelength_{k}"] = f.vias(), f.lengths()
    factor = scale_factor(p, t)
    sp, st = p.scaled(factor), t.scaled(factor)
    scaled = np.where(factor[load_row] == 1.0, at[:, 2], np.trunc(at[:, 2] * factor[load_row])).astype(np.int64)
    name = mix(at[:, 0], at[:, 1], scaled)
    for k, f in (("pred", sp), ("true", st)):
        m[f"max_elmore_delay_{k}"] = elmore(f, _sinks(f, name, load_row))
    for k, a, b in (("via", "num_vias", ""), ("wirelength", "wirelength", ""), ("max_elmore_delay", "max_elmore_delay", "")):
        m[f"{k}_ratio"] = ratio(m[f"{a}_pred"], m[f"{a}_true"])
    m |= edit_costs(sp, st)
    m["red_total_wirelength_pred"], m["red_total_wirelength_true"] = sp.total_lengths(), st.total_lengths()
    norm = m["red_normalization_factor"] = m["red_total_wirelength_pred"] + m["red_total_wirelength_true"]
    m["red_similarity_score"] = np.where(
        norm > 0, np.maximum(0.0, 1.0 - m["red_total_cost"] / np.where(norm > 0, norm, 1)), np.where(m["red_total_cost"] == 0, 1.0, 0.0)
    )
    return m


def routing_metrics(df: DataFrame, key: str, loads: str, pred: str, true: str, prefix: str = "", keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """``key``, ``keep`` and 41 metrics of a predicted tree against the true one, both relative to the driver, as are the loads."""

    def run(*columns: pa.Array) -> list:
        m = routing_metrics_batch(*columns)
        return [pa.array(m[n]) for n in NAMES]

    fields = ", ".join(prefix + f for f in METRICS.split(", "))
    return map_batches(df, [loads, pred, true], fields, run, [key, *keep], rows=1000)
