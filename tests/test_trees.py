"""The batch kernel against trees built node by node."""

import numpy as np
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netloom.operators import text_metrics, trees
from netloom.operators.forest import Forest
from netloom.operators.repair import repair, repair_trees

POINT = re.compile(r"\s*\((-?\d+),\s*(-?\d+),\s*(-?\d+)\)")


class Node:
    def __init__(self, p=None, up=None):
        self.p, self.up, self.down = p, up, []


def build(tokens):
    top = now = Node()
    stack = []
    for t in tokens or []:
        m = POINT.match(t) if t else None
        if m:
            child = Node(tuple(map(int, m.groups())), now)
            now.down.append(child)
            now = child
        elif t == "[BRANCH]":
            stack.append(now)
        elif t == "[END]" and stack:
            now = stack.pop()
    if not top.down:
        return None
    root = top.down[0]
    root.up = None
    return root


def walk(n):
    if n:
        yield n
        for c in n.down:
            yield from walk(c)


def text(n, keep=lambda n: True):
    out = [f"({n.p[0]}, {n.p[1]}, {n.p[2]})"] if keep(n) else []
    for c in n.down:
        out += ["[BRANCH]", *text(c, keep), "[END]"] if len(n.down) > 1 else text(c, keep)
    return out


def sign(a, b):
    return tuple((y > x) - (y < x) for x, y in zip(a, b))


def needed(n):
    if not n.up or len(n.down) != 1:
        return True
    c = n.down[0]
    return not (sign(n.up.p, n.p) == sign(n.p, c.p) or n.p in (n.up.p, c.p))


def edges(n):
    return [(m.p, c.p) for m in walk(n) for c in m.down]


def preorder_edges(n):
    return [e for c in (n.down if n else []) for e in [(n.p, c.p), *preorder_edges(c)]]


def leaves(n):
    count = Counter(p for e in edges(n) for p in e)
    return {p for p, k in count.items() if k == 1 and p != n.p}


def far(a, b):
    return sum(abs(x - y) for x, y in zip(a, b))


def random_tree(rng, n, dirty=True):
    out, p = [], [0, 0, 0]
    for _ in range(n):
        r = rng.random()
        if r < 0.15:
            out.append("[BRANCH]")
        elif r < 0.3:
            out.append("[END]")
        elif dirty and r < 0.34:
            out.append(rng.choice([None, "x", "", "(1,2)", " (3,4,  5)z"]))
        else:
            p[rng.randrange(3)] += rng.choice([-200, -10, 0, 10, 20, 300])
            out.append(f"({p[0]}, {p[1]}, {p[2]})")
    return out


def samples(seed, n=150, dirty=True):
    rng = random.Random(seed)
    return [[], None, ["[END]", "[BRANCH]"], ["[BRANCH]", "(1, 2, 3)", "[END]", "(4, 5, 6)", "(7, 8, 9)"]] + [random_tree(rng, rng.randrange(1, 40), dirty) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_parse_serialise_and_simplify(seed):
    lists = samples(seed)
    f = Forest.parse(pa.array(lists, pa.list_(pa.string())))
    plain, simple = f.serialise().to_pylist(), f.serialise(f.simplified()).to_pylist()
    heads = f.heads()
    for i, t in enumerate(lists):
        root = build(t)
        assert list(map(tuple, f.xyz[heads[i] : heads[i + 1]].tolist())) == [n.p for n in walk(root)]
        assert plain[i] == (text(root) if root else [])
        assert simple[i] == (text(root, needed) if root else [])


def test_deep_chain():
    t = [x for i in range(3000) for x in (f"({i}, 0, 0)", "[BRANCH]")]
    f = Forest.parse(pa.array([t]))
    assert f.depth().max() == 2999 and f.below(f.xyz[:, 0] * 0 + 1)[0] == 3000


def test_huge_numbers_are_no_points():
    f = Forest.parse(pa.array([["(1, 2, 3)", "(99999999999999999999, 0, 0)", "(4, 5, 6)"]]))
    assert f.xyz.tolist() == [[1, 2, 3], [4, 5, 6]]


def moves(tokens):
    """Target tokens of a tree, and the tree that tokens draw, by a stack."""
    out, stack, last = [], [], (0, 0, 0)
    for t in tokens or []:
        m = POINT.match(t) if t else None
        if t == "[BRANCH]":
            out.append("<PUSH>")
            stack.append(last)
        elif t == "[END]":
            out.append("<POP>")
            last = stack.pop() if stack else last
        elif m:
            now = tuple(map(int, m.groups()))
            out += [(u if b > a else d) + str(abs(b - a)) for a, b, (u, d) in zip(last, now, ("RL", "UD", "TB")) if a != b]
            last = now
    return out + ["<POP>"] * len(stack) + ["<EOS>"]


def test_target_tokens(spark):
    lists = samples(7)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(lists)], "k bigint, tree array<string>, target int")
    for r in trees.target_tokens(df, "k", "tree").collect():
        assert r.target == (None if lists[r.k] is None else moves(lists[r.k]))


def test_round_trip_of_simplified_trees(spark):
    rng = random.Random(3)
    lists = []
    while len(lists) < 80:
        t = random_tree(rng, 25, dirty=False)
        root = build(["(0, 0, 0)", *t])
        simple = text(root, needed)
        # without repeated points and steps on several axes, moves draw the same tree again
        again = build(simple)
        if text(again, needed) == simple and all(sum(x != y for x, y in zip(a, b)) == 1 for a, b in edges(again)):
            lists.append(simple)
    df = spark.createDataFrame([(i, " ".join(moves(t)) + " R5 <PAD>") for i, t in enumerate(lists)], "k bigint, t string")
    for r in trees.routing(df, "k", "t").collect():
        assert r.routing == lists[r.k]


def test_routing_of_odd_texts(spark):
    cases = {
        "": ["(0, 0, 0)"], "R10 <EOS> U5": ["(0, 0, 0)", "(10, 0, 0)"], "<BOS> R10U5 <PAD> T2": ["(0, 0, 0)", "(10, 0, 0)", "(10, 5, 0)", "(10, 5, 2)"],
        "R10abc U0 x D7 <POP> L2": ["(0, 0, 0)", "(0, -7, 0)", "(-2, -7, 0)"], "R5 <PUSH> U5 <POP> <PUSH> D5": ["(0, 0, 0)", "(5, 0, 0)", "[BRANCH]", "(5, 5, 0)", "[END]", "[BRANCH]", "(5, -5, 0)", "[END]"],
    }
    df = spark.createDataFrame([*cases.items()], "k string, v array<string>").selectExpr("k", "k as t")
    for r in trees.routing(df, "k", "t").collect():
        assert r.routing == cases[r.k], r.k
    assert trees.routing(spark.createDataFrame([(1, None)], "k int, t string"), "k", "t").first().routing == ["(0, 0, 0)"]


def delay(root, sinks):
    best = [0.0]
    length = lambda n: (abs(n.p[0] - n.up.p[0]) + abs(n.p[1] - n.up.p[1])) / 2000
    cap = lambda n: (n.p in sinks) + sum(length(c) + cap(c) for c in n.down)

    def go(n, t):
        for c in n.down:
            here = t + length(c) * (cap(c) + length(c))
            if c.p in sinks or not c.down:
                best.append(here)
            go(c, here)

    go(root, 0.0)
    return max(best)


def expected_metrics(loads, pred, true):
    p, t = build(pred), build(true)
    m = {"is_perfect_match": pred == true, "num_edges_pred": len(edges(p)), "num_edges_true": len(edges(t))}
    pe, te, pl, tl = set(edges(p)), set(edges(t)), leaves(p), leaves(t)
    m |= {"edge_recall": len(pe & te) / len(te) if te else 0.0, "edge_iou": len(pe & te) / len(pe | te) if pe | te else 0.0}
    m |= {"num_leaves_pred": len(pl), "leaf_precision": len(pl & tl) / len(pl) if pl else 0.0, "is_leaf_set_match": pl == tl}
    want = {tuple(map(int, POINT.match(x).groups())) for x in loads}
    met = want <= {n.p for n in walk(p)}
    m |= {"is_connected_all_loads": met, "is_graceful": met and pl <= want}
    m["num_vias_pred"] = sum(abs(a[2] - b[2]) // 2 for a, b in edges(p))
    m["wirelength_true"] = sum(far(a[:2], b[:2]) for a, b in edges(t))
    pts = [n.p for r in (p, t) for n in walk(r)]
    ext = [max(x[i] for x in pts) - min(x[i] for x in pts) for i in range(3)]
    k = (ext[0] + ext[1]) / 2 / ext[2] if ext[2] else 1.0
    scale = lambda q: (q[0], q[1], int(q[2] * k))
    for r in (p, t):
        for n in walk(r):
            n.p = scale(n.p)
    want = {scale(q) if k != 1.0 else q for q in want}
    for name, r in (("pred", p), ("true", t)):
        sinks = want or leaves(r) or {r.p}
        m[f"max_elmore_delay_{name}"] = delay(r, sinks)
    a, b = list(walk(p)), list(walk(t))
    pairs = sorted(((far(x.p, y.p), i, j) for i, x in enumerate(a) for j, y in enumerate(b)))
    ua, ub, sub = set(), set(), 0
    for d, i, j in pairs:
        if i not in ua and j not in ub:
            ua.add(i), ub.add(j)
            sub += d
    gone = sum(far(n.p, n.up.p) for i, n in enumerate(a) if i not in ua and n.up)
    new = sum(far(n.p, n.up.p) for j, n in enumerate(b) if j not in ub and n.up)
    norm = sum(far(n.p, n.up.p) for n in a + b if n.up)
    m |= {"red_substitution_cost": sub, "red_total_cost": sub + gone + new, "red_normalization_factor": norm, "red_num_matches": len(ua)}
    m["red_similarity_score"] = max(0.0, 1 - m["red_total_cost"] / norm) if norm else float(m["red_total_cost"] == 0)
    return m


def test_metrics_equal_node_by_node(spark):
    rng = random.Random(11)
    rows = []
    for i in range(120):
        true = ["(0, 0, 0)", *random_tree(rng, rng.randrange(1, 25), dirty=False)]
        pred = list(true)
        for _ in range(rng.randrange(4)):
            j = rng.randrange(1, len(pred)) if len(pred) > 1 else 0
            pred[j] = rng.choice(["[END]", "(10, 10, 2)", pred[j]])
        root = build(true)
        loads = [f"({p[0]}, {p[1]}, {p[2]})" for p in sorted(leaves(root))][: rng.randrange(5)]
        rows.append((i, loads, pred, true, "x"))
    df = spark.createDataFrame(rows, "k bigint, loads array<string>, pred array<string>, true array<string>, via_ratio string")
    for r in trees.routing_metrics(df, "k", "loads", "pred", "true").collect():
        _, loads, pred, true, _ = rows[r.k]
        for name, value in expected_metrics(loads, pred, true).items():
            assert r[name] == pytest.approx(value), (r.k, name)


def test_metrics_of_equal_and_empty_trees(spark):
    t = ["(0, 0, 0)", "(5, 0, 0)", "(5, 0, 2)"]
    df = spark.createDataFrame([(1, [t[-1]], t, t), (2, None, None, None), (3, [], [], t)], "k int, l array<string>, p array<string>, t array<string>")
    one, two, three = sorted(trees.routing_metrics(df, "k", "l", "p", "t").collect())
    assert one.is_perfect_match and one.is_graceful and one.red_similarity_score == 1.0 and one.red_total_cost == 0 and one.wirelength_ratio == 1.0
    assert two.is_perfect_match and two.red_similarity_score == 1.0 and two.num_edges_pred == 0 and two.wirelength_ratio == 1.0
    assert not three.is_perfect_match and three.wirelength_ratio == 0.0
    empty = spark.createDataFrame([], "k int, l array<string>, p array<string>, t array<string>")
    assert trees.routing_metrics(empty, "k", "l", "p", "t").count() == 0


def test_repair_connects_all_loads(spark):
    rng = random.Random(5)
    rows = []
    for i in range(80):
        x, y, tree = 0, 0, ["(0, 0, 0)", "(0, 0, 2)"]
        for _ in range(rng.randrange(1, 8)):
            x, y = (x + rng.choice([-100, 50, 100]), y) if rng.random() < 0.5 else (x, y + rng.choice([-100, 50, 100]))
            tree.append(f"({x}, {y}, 2)")
        loads = [f"({rng.randrange(-5, 5) * 50}, {rng.randrange(-5, 5) * 50}, 0)" for _ in range(rng.randrange(0, 5))]
        rows.append((i, tree, loads))
    df = spark.createDataFrame(rows + [(1000, None, ["(5, 5, 0)"]), (1001, [], []), (1002, ["(0, 0, 0)"], ["x", None])], "k bigint, tree array<string>, loads array<string>")
    out = {r.k: r for r in repair_trees(df, "k", "tree", "loads").collect()}
    assert len(out) == 83
    for k, tree, loads in rows:
        root = build(out[k].post_tree_seq)
        points = [n.p for n in walk(root)]
        want = {tuple(map(int, POINT.match(x).groups())) for x in loads}
        if not want:
            assert out[k].post_tree_seq == text(build(tree)) and out[k].post_add_wirelength_cost == 0
            continue
        assert want <= set(points) and len(points) == len(set(points)) and root.p == (0, 0, 0)
        assert all(sum(a != b for a, b in zip(*e)) == 1 for e in edges(root))
        assert leaves(root) <= want
    assert out[1000].post_tree_seq[0] == "(0, 0, 0)" and "(5, 5, 0)" in out[1000].post_tree_seq
    assert out[1001].post_tree_seq == [] and out[1002].post_tree_seq == ["(0, 0, 0)"]


@pytest.mark.parametrize("seed", range(4))
def test_crossings_equal_all_pairs(seed):
    from netloom.operators.repair import crossings

    rng = random.Random(seed)
    edges_ = []
    for _ in range(60):
        a = [rng.randrange(8) for _ in range(3)]
        b = list(a)
        b[rng.randrange(3)] = rng.randrange(8)
        edges_.append((tuple(a), tuple(b)))
    axes = lambda e: [i for i in range(3) if e[0][i] != e[1][i]]
    want = set()
    for e in edges_:
        for f in edges_:
            if len(axes(e)) == len(axes(f)) == 1 and axes(e) != axes(f):
                lo = [max(min(e[0][i], e[1][i]), min(f[0][i], f[1][i])) for i in range(3)]
                hi = [min(max(e[0][i], e[1][i]), max(f[0][i], f[1][i])) for i in range(3)]
                if all(x <= y for x, y in zip(lo, hi)):
                    want.add(tuple(lo))
    assert set(crossings([e for e in edges_ if axes(e)])) == want


def test_sides_of_a_box():
    from netloom.operators.repair import lattice

    pairs = lambda x: {frozenset(e) for e in x}
    assert pairs(lattice((0, 0, 2), (0, 0, 2), set())) == {frozenset([(0, 0, 2)])} and pairs(lattice((0, 0, 2), (5, 0, 2), {2})) == {frozenset([(0, 0, 2), (5, 0, 2)])}
    assert len(lattice((0, 0, 2), (5, 5, 2), set())) == 4 and lattice((0, 0, 2), (5, 5, 2), {2}) == []
    assert len(lattice((0, 0, 2), (5, 5, 4), set())) == 12 and len(lattice((0, 0, 2), (5, 5, 4), {4})) == 8 and len(lattice((0, 0, 2), (5, 0, 4), {4})) == 3


@pytest.mark.parametrize("seed", range(4))
def test_matching_without_all_distances_is_the_same(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 6, (40, 3)), rng.integers(0, 6, (33, 3))
    want = trees.match_nodes(a, b)
    monkeypatch.setattr(trees, "CELLS", 10)
    got = trees.match_nodes(a, b)
    assert want[0].tolist() == got[0].tolist() and want[1].tolist() == got[1].tolist()


def test_repair_keeps_what_is_right_and_drops_what_is_loose():
    edges_ = [((0, 0, 0), (0, 0, 2)), ((0, 0, 2), (100, 0, 2)), ((100, 0, 2), (100, 0, 0)), ((100, 0, 2), (100, 70, 2))]
    tokens, cost = repair((0, 0, 0), edges_, [(100, 0, 0)])
    assert tokens == ["(0, 0, 0)", "(0, 0, 2)", "(100, 0, 2)", "(100, 0, 0)"] and cost == (70.0, 0.0, 0.0, 0.0)


def bleu(ref, hyp, n):
    if not ref or not hyp:
        return 0.0
    logs = []
    for k in range(1, 5):
        r, h = (Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1)) for x in (ref, hyp))
        hit = sum(min(c, r[g]) for g, c in h.items())
        if k == 1 and not hit:
            return 0.0
        logs.append(math.log((hit or 0.1) / max(1, len(hyp) - k + 1)))
    bp = 1.0 if len(hyp) > len(ref) else math.exp(1 - len(ref) / len(hyp))
    return bp * math.exp(sum(logs[:n]) / n)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            row[j], prev = (prev + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_text_metrics_of_ids(spark):
    rows = [(1, [5, 6, 7, 8], [5, 6, 7, 9]), (2, [1], None), (3, [2, 2], [2, 2])]
    ids = spark.createDataFrame(rows, "k int, t array<int>, p array<int>")
    text = ids.select("k", *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in "tp"])
    a, b = (sorted(map(tuple, text_metrics.text_metrics(df, "k", "t", "p").collect())) for df in (ids, text))
    assert a == b and a[0][3] == pytest.approx(0.75) and a[2][7] == 1.0


def test_text_metrics(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["R1", "U2", "D3", "<PUSH>", "<POP>"])
    rows = [(0, "", ""), (1, None, "a"), (2, "a b", None), (3, " a  b ", "a  b"), (4, "a", "b")]
    rows += [(10 + i, " ".join(word() for _ in range(rng.randrange(1, 12))), " ".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(150)]
    df = spark.createDataFrame(rows, "k bigint, t string, p string")
    for r in text_metrics.text_metrics(df, "k", "t", "p").collect():
        _, t, p = next(x for x in rows if x[0] == r.k)
        a, b = (t or "").split(), (p or "").split()
        for n in (1, 2, 4):
            assert r[f"bleu_{n}"] == pytest.approx(bleu(a, b, n)), (r.k, n)
        for n in (1, 2):
            x, y = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (a, b))
            hit, total = sum((x & y).values()), sum(x.values()) + sum(y.values())
            assert r[f"rouge{n}_f"] == pytest.approx(2 * hit / total if hit else 0.0)
        common = lcs(a, b)
        assert r.rougel_f == pytest.approx(2 * common / (len(a) + len(b)) if common else 0.0)
        assert r.exact_match == float((t or "").strip() == (p or "").strip())
