import random

import numpy as np
import pytest
from brute import closed, edited, near, pairs_within, points, walk

from netloom.llm import near_groups as g
from netloom.llm.components import components

SCHEMA = "net_id bigint, tree_seq array<string>, pts string, n double, sid string, point int"


def rows_of(seed, families=12, size=5):
    rng = random.Random(seed)
    trees = [None, [], [None], ["[BRANCH]", None], ["(1, 2, 3)"] * 40]
    for _ in range(families):
        base = walk(rng, rng.choice([7, 8, 9, 12, 20, 40, 160]))
        trees.append(base)
        trees += [edited(rng, base, rng.randrange(0, 8)) for _ in range(size)]
    trees += [trees[8]] * 5
    return [(i + 1, t, "x", 1.0, None, 7) for i, t in enumerate(trees)]


def expected(rows):
    sets = {r[0]: points(r[1]) for r in rows}
    return closed((a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b]))


@pytest.mark.parametrize("seed,block_rows,node_rows", [(1, 4096, 1024), (2, 3, 4), (3, 1, 2)])
def test_pairs_equal_brute_force(spark, monkeypatch, seed, block_rows, node_rows):
    monkeypatch.setattr(g, "NODE_ROWS", node_rows)
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r.net_a, r.net_b) for r in g.near_pairs(df, block_rows=block_rows).collect()}
    assert found == pairs_within(expected(rows))


def test_tiles_split_a_block_that_all_share(spark):
    rng = random.Random(5)
    # the same points hold most of many sets that differ in one
    base = walk(rng, 30)
    rows = [(i, edited(rng, base, 1) if i % 3 else walk(rng, 20) + base[:2], "", 0.0, "", 0) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r.net_a, r.net_b) for r in g.near_pairs(df, block_rows=16).collect()}
    assert found == pairs_within(expected(rows))


def test_one_row_for_each_row(spark):
    rows = rows_of(4) + [(None, ["(1, 2, 3)"], "", 0.0, "", 0), (3, None, "", 0.0, "", 0)]
    out = g.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(r.net_id) for r in out) == sorted(str(r[0]) for r in rows)
    group = {x: min(members) for members in expected([r for r in rows if r[0]]).values() for x in members}
    for r in out:
        assert r.group_id == group.get(r.net_id, r.net_id)
        assert (r.n_links == 0) or r.net_id in group


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert g.near_pairs(df).count() == 0 and g.near_groups(df).count() == 0


def test_gray_rank_orders_neighbours_one_bit_apart():
    values = np.arange(64, dtype=np.uint64)
    codes = np.stack([np.zeros(64, np.uint64), values ^ (values >> np.uint64(1))], axis=1)
    high, low = g.gray_rank(codes).T
    assert (low == values).all() and (high == 0).all()
    # a set bit in the high word reverses the low one
    assert g.gray_rank(np.array([[1, 0]], dtype=np.uint64))[0, 1] == 2**64 - 1


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_what_a_full_comparison_finds(seed):
    rng = np.random.default_rng(seed)
    n = 600
    block = rng.integers(0, 7, n)
    base = rng.integers(0, 2**63, (20, 2)).astype(np.uint64)
    codes = base[rng.integers(0, 20, n)] ^ (np.uint64(1) << rng.integers(0, 64, (n, 2)).astype(np.uint64))
    sizes = rng.integers(8, 60, n)
    word = rng.integers(0, 3, n).astype(np.uint64)
    codes = np.concatenate([word[:, None], codes], axis=1)
    found = {tuple(sorted(p)) for a, b in g.GrayIndex(block, codes, sizes).pairs() for p in zip(a.tolist(), b.tolist())}
    wanted = set()
    for i in range(n):
        for j in range(i + 1, n):
            if block[i] == block[j] and word[i] == word[j]:
                d = int(np.bitwise_count(codes[i] ^ codes[j]).sum())
                if max(d, abs(int(sizes[i]) - int(sizes[j]))) <= (sizes[i] + sizes[j]) // 9:
                    wanted.add((i, j))
    assert found == wanted


def test_most_pairs_are_pruned_above_the_leaves():
    rng = np.random.default_rng(9)
    n = 3000
    codes = rng.integers(0, 2**63, (n, 3)).astype(np.uint64)
    codes[1::100] = codes[::100]
    index = g.GrayIndex(np.zeros(n, np.int64), codes, np.full(n, 30))
    found = sum(len(a) for a, _ in index.pairs())
    assert found == n // 100
    assert sum(v for k, v in index.pruned_rows.items() if k) > 0.9 * n * n / 2


@pytest.mark.parametrize("seed", range(20))
def test_near_sets_share_a_word(seed):
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    n = int(rng.integers(8, 120))
    one = rng.choice(2**62, n, replace=False)
    d = n // 4
    lost = int(rng.integers(0, d + 1))
    two = np.concatenate([one[lost:], rng.choice(2**62, d - lost, replace=False)])
    if (len(one) + len(two)) // 9 < d:
        return
    batch = pa.RecordBatch.from_pydict({"n": np.array([len(one), len(two)], np.int32), "pts": [sorted(one.tolist()), sorted(two.tolist())], "scheme": [0, 0]})
    e = g._fingerprints(batch, 0)
    keys = [{(s, j, w) for r, s, j, w in zip(e["row"], e["scheme"], e["j"], e["word"]) if r == i} for i in (0, 1)]
    assert keys[0] & keys[1]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200 + i) for i in range(1, 30)]
    edges += [(None, 1), (5, 5), (3, None)]
    out = components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    got = {r.node: r.component for r in out}
    assert len(got) == len(out)
    assert got == {x: min(m) for m in closed((a, b) for a, b in edges if a is not None and b is not None and a != b).values() for x in m}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0
