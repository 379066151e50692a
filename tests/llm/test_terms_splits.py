import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import closed, edited, near, pairs_within, points, terms, walk

from netloom.llm import percentiles, split_overlap, splits, term_stats

TEXTS = [None, "", " \t\n", "a b a", "a\tb\n\nc", "a", " a ", "é   a\r b", "a b", "x" * 50_000, "a b " * 3000, "b a"]


def test_term_statistics(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(TEXTS)] + [(3, "a b a", "", None), (None, "a q", "", None)]
    df = spark.createDataFrame(rows, "sample_id bigint, target_tokens string, token string, occ bigint")
    out = {r.token: r for r in term_stats.term_statistics(df, "sample_id", "target_tokens").collect()}
    count, records = Counter(), Counter()
    for _, t, *_ in rows:
        count.update(terms(t))
        records.update(set(terms(t)))
    total = sum(1 for r in rows if terms(r[1]))
    assert {t: (r.occurrences, r.records) for t, r in out.items()} == {t: (count[t], records[t]) for t in count}
    for t, r in out.items():
        assert r.mark == ("rare" if records[t] <= 2 else "common" if records[t] > total / 2 else None)


def test_term_statistics_of_nothing(spark):
    df = spark.createDataFrame([], "sample_id bigint, target_tokens string")
    assert term_stats.term_statistics(df, "sample_id", "target_tokens").count() == 0
    df = spark.createDataFrame([(1, None), (2, " ")], "sample_id bigint, target_tokens string")
    assert term_stats.term_statistics(df, "sample_id", "target_tokens").count() == 0


OVERLAP = "sample_id bigint, split string, source_design string, tree_seq array<string>, target_tokens string, pts string, e int, key string"


def overlap_rows(seed):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(40):
        base = walk(rng, rng.choice([7, 8, 9, 10, 11, 16, 33, 120]))
        words = " ".join(rng.choice("RLUD") + str(rng.randrange(9)) for _ in range(rng.choice([3, 19, 20, 40])))
        for _ in range(4):
            i += 1
            text = words if rng.random() < 0.5 else words.replace(" ", "\t ") if rng.random() < 0.5 else words + " x"
            rows.append((i, rng.choice(["train", "train", "validation", "test", None, "other"]), rng.choice(["d", None]), edited(rng, base, rng.randrange(0, 6)), text, "", 1, ""))
    rows += [(i + 1, "train", None, None, None, "", 0, ""), (i + 2, "test", None, [], " ", "", 0, ""), (i + 3, "test", "d", [None], "", "", 0, "")]
    return rows


def overlap_expected(rows):
    sets = [(r[0], r[1], points(r[3]), terms(r[4])) for r in rows]
    out = set()
    for a, sa, pa, ta in sets:
        for b, sb, pb, tb in sets:
            if sa in ("validation", "test") and sb == "train" and (near(pa, pb) or (ta == tb and len(ta) >= 20)):
                out.add((a, b))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlaps_equal_brute_force(spark, seed):
    rows = overlap_rows(seed)
    out = split_overlap.overlaps(spark.createDataFrame(rows, OVERLAP)).collect()
    found = {(r.held_out_id, r.train_id) for r in out}
    assert len(found) == len(out) and found == overlap_expected(rows)


def test_overlap_report(spark):
    rows = overlap_rows(4)
    out = {(r.split, r.source_design): (r.n_rows, r.n_overlapping, r.n_pairs) for r in split_overlap.report(spark.createDataFrame(rows, OVERLAP)).collect()}
    pairs = overlap_expected(rows)
    want = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        if r[1] in ("validation", "test"):
            mine = sum(a == r[0] for a, _ in pairs)
            for k, v in enumerate((1, bool(mine), mine)):
                want[r[1], r[2]][k] += v
    assert out == {k: tuple(v) for k, v in want.items()}


def test_report_of_other_split_names(spark):
    rows = [(r[0], {"train": "fit", "validation": "dev", "test": "dev"}.get(r[1], r[1]), *r[2:]) for r in overlap_rows(4)]
    df = spark.createDataFrame(rows, OVERLAP)
    out = split_overlap.report(df, train=("fit",), held_out=("dev",)).collect()
    back = overlap_expected([(r[0], {"fit": "train", "dev": "test"}.get(r[1], r[1]), *r[2:]) for r in rows])
    assert sum(r.n_pairs for r in out) == len(back) > 0 and {r.split for r in out} == {"dev"}


def test_band_of_long_strings():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 10**9, 5000))
    near, far = base[rng.random(len(base)) > 0.1], np.unique(rng.integers(0, 10**9, 4900))
    a, b = np.concatenate([base, base]), np.concatenate([near, far])
    at = [0, len(base), 2 * len(base)], [0, len(near), len(near) + len(far)]
    k = np.array([len(base) - len(near), (len(base) + len(far)) // 9])
    assert split_overlap.edits_within(a, np.array(at[0]), b, np.array(at[1]), k).tolist() == [True, False]
    assert split_overlap.edits_within(a, np.array(at[0]), b, np.array(at[1]), k - 1).tolist() == [False, False]


def test_overlaps_of_nothing(spark):
    assert split_overlap.overlaps(spark.createDataFrame([], OVERLAP)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_band_equals_set_difference(seed):
    rng = np.random.default_rng(seed)
    a, b = [], []
    for _ in range(60):
        base = np.unique(rng.integers(0, 10**6, rng.integers(8, 200)))
        other = np.union1d(base[rng.random(len(base)) < 0.9], rng.integers(0, 10**6, rng.integers(0, 8)))
        a.append(base)
        b.append(other)
    at = lambda x: np.concatenate([[0], np.cumsum([len(y) for y in x])])
    k = np.array([(len(x) + len(y)) // 9 for x, y in zip(a, b)])
    found = split_overlap.edits_within(np.concatenate(a), at(a), np.concatenate(b), at(b), k)
    assert found.tolist() == [len(np.setxor1d(x, y)) <= d for x, y, d in zip(a, b, k)]
    assert found.any() and not found.all()


NETS = "net_id bigint, source_design string, net_name string, component string, node string, rows bigint"


def net_rows(seed, n=400):
    rng = random.Random(seed)
    designs = [f"d{i}" for i in range(40)] + [None, ""]
    rows = []
    for i in range(n):
        name = rng.choice([f"n{rng.randrange(500)}", f" \\N{rng.randrange(500)} ", "clk", None, "", "  ", "\\"])
        rows.append((i, rng.choice(designs), name, "", "", 0))
    return rows


def tie_groups(rows):
    held = defaultdict(set)
    for r in rows:
        name = (r[2] or "").strip(" ")
        name = (name[1:] if name.startswith("\\") else name).lower()
        if r[1] and name:
            held[name].add(r[1])
    return closed((a, b) for ds in held.values() if len(ds) <= 8 for a in ds for b in ds if a < b)


@pytest.mark.parametrize("seed", [1, 2])
def test_tied_pairs(spark, seed):
    rows = net_rows(seed, 150)
    found = {(r.design_a, r.design_b) for r in splits.tied_pairs(spark.createDataFrame(rows, NETS)).collect()}
    assert found == pairs_within(tie_groups(rows))


def test_assignment_keeps_groups_and_ratios(spark):
    rows = net_rows(3, 120) + [(1000 + i, f"s{i // 3}", f"u{i}", "", "", 0) for i in range(6000)] + [(9000 + i, "hot", None, "", "", 0) for i in range(3000)]
    df = spark.createDataFrame(rows, NETS)
    out = splits.assign(df, [("test", 0.1), ("train", 0.8), ("validation", 0.1)]).collect()
    assert sorted(r.net_id for r in out) == sorted(r[0] for r in rows)
    of = {r.net_id: r.split for r in out}
    by_design = defaultdict(set)
    for r in rows:
        if r[1]:
            by_design[r[1]].add(of[r[0]])
    assert all(len(s) == 1 for s in by_design.values())
    for members in tie_groups(rows).values():
        assert len(set.union(*(by_design[m] for m in members))) == 1
    share = Counter(r.split for r in out)
    assert abs(share["train"] / len(rows) - 0.8) < 0.02 and abs(share["test"] / len(rows) - 0.1) < 0.02
    assert {(r.net_id, r.split) for r in splits.assign(df, [("train", 0.8), ("validation", 0.1), ("test", 0.1)]).collect()} == set(of.items())


def test_given_ranges_keep_components_in_their_split(spark):
    rows = net_rows(3, 120)
    plan = [("train", 0.5), ("test", 0.5)]
    df = spark.createDataFrame(rows, NETS)
    ranges = splits.ranges_for(splits.sized(df)[1], plan)
    before = {r.component: r.split for r in splits.assign(df, plan, ranges=ranges).collect() if r.component}
    more = rows + [(1000 + i, f"s{i // 3}", f"u{i}", "", "", 0) for i in range(600)]
    after = {r.component: r.split for r in splits.assign(spark.createDataFrame(more, NETS), plan, ranges=ranges).collect() if r.component}
    assert before and {c: after[c] for c in before} == before and len(after) > len(before)


def test_splits_of_nothing(spark):
    df = spark.createDataFrame([], NETS)
    assert splits.tied_pairs(df).count() == 0 and splits.assign(df, [("train", 1.0)]).count() == 0
    only = spark.createDataFrame([(1, None, None, "", "", 0), (2, "", "x", "", "", 0)], NETS)
    assert splits.assign(only, [("train", 1.0)]).count() == 2
    with pytest.raises(ValueError):
        splits.assign(df, [("train", 0.0)])


def test_percentiles_within_the_stated_error(spark):
    rng = random.Random(1)
    rows = []
    for i in range(4000):
        v = rng.choice([None, -1.5, 0.0, 1e-300, float("nan"), float("inf"), -float("inf"), 2.0**52 - 1, 1e308] + [rng.lognormvariate(3, 3), -rng.lognormvariate(3, 3)] * 20)
        rows.append((rng.choice(["a", "b", None]), rng.choice(["x", None]), rng.choice(["d1", "d2", None]), v, rng.choice([None, -3, 0, *range(600)])))
    rows.append(("tiny", "x", "d1", 5.0, 7))
    rows.append(("none", "x", "d1", None, -1))
    df = spark.createDataFrame(rows, "g string, h string, day string, v double, w bigint")
    parts = [percentiles.partials(df.filter(f"day <=> {d}"), ["g", "h"], "day", ["v", "w"]) for d in ("'d1'", "'d2'", "null")]
    out = percentiles.percentiles(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["g", "h"]).collect()
    kept = defaultdict(list)
    for g_, h, _, v, w in rows:
        if v is not None and v == v:
            kept[g_, h, "v"].append(v)
        if w is not None:
            kept[g_, h, "w"].append(w)
    assert {(r.g, r.h, r.metric) for r in out} == set(kept)
    for r in out:
        values = sorted(kept[r.g, r.h, r.metric])
        assert r.n == len(values)
        for p in (50, 90, 95, 99):
            true = values[-(-len(values) * p // 100) - 1]
            got = r[f"p{p}"]
            if abs(true) == float("inf") or r.metric == "w" and abs(true) < 512:
                assert got == true
            else:
                assert true * got >= 0 and abs(got) <= abs(true) <= abs(got) * (1 + 2**-8) or abs(true) < 2.3e-308


def test_codes_are_the_leading_bits(spark):
    rng = random.Random(2)
    values = [0.0, 1.0, 2.0, 3.0, 0.1, 1e-300, 1.7e308, float("inf")] + [2.0**e * f for e in range(-1000, 1000, 37) for f in (1, 1 - 2**-53, 1 + 2**-52)]
    values += [rng.uniform(0, 1) * 10.0 ** rng.randrange(-200, 200) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(percentiles.code("v")).collect()]
    assert got == (np.array(values).view(np.int64) >> 44).tolist()


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([], "g string, day date, v bigint")
    assert percentiles.percentiles(percentiles.partials(df, ["g"], "day", ["v"]), ["g"]).count() == 0
