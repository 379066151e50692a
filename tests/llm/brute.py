"""Plain versions of the operators' definitions, for small tables."""

import re
from collections import defaultdict
from itertools import combinations

POINT = re.compile(r"\((-?\d+),\s*(-?\d+),\s*(-?\d+)\)", re.ASCII)


def points(tree):
    found = set()
    for e in tree or []:
        m = POINT.match(e.strip()) if e is not None else None
        if m:
            found.add(tuple(map(int, m.groups())))
    return found


def near(a, b):
    both = len(a & b)
    return min(len(a), len(b)) >= 8 and both * 5 >= 4 * (len(a) + len(b) - both)


def closed(pairs):
    """Groups of the closure of some links."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    groups = defaultdict(list)
    for x in list(root):
        groups[find(x)].append(x)
    return groups


def pairs_within(groups):
    return {tuple(sorted(p)) for members in groups.values() for p in combinations(members, 2)}


def terms(text):
    return [t for t in re.split("[ \t\n]", text or "") if t]


def walk(rng, n):
    """A tree of about n points, as a list of strings with markers."""
    x, y, m, out = rng.randrange(10**6), rng.randrange(10**6), 0, []
    for _ in range(n):
        out.append(f"({x}, {y}, {m})")
        if rng.random() < 0.2:
            out.append(rng.choice(["[BRANCH]", "[END]"]))
        x, y, m = x + rng.randrange(-50, 50), y + rng.randrange(-50, 50), rng.randrange(0, 9, 2)
    return out


def edited(rng, tree, edits):
    tree = list(tree)
    for _ in range(edits):
        i = rng.randrange(len(tree))
        kind = rng.randrange(4)
        if kind == 0:
            tree[i] = f"({rng.randrange(10**6)},{rng.randrange(10**6)},  {rng.randrange(9)});x"
        elif kind == 1:
            del tree[i]
        elif kind == 2:
            tree.insert(i, f" ({rng.randrange(10**6)}, 0{rng.randrange(10**5)}, -0) ")
        else:
            rng.shuffle(tree)
        tree = tree or ["x"]
    return tree
