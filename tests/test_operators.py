import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions import logs
from netloom.functions import tokens as t
from netloom.functions.coords import add, delta_tokens, divide, floor_divide, parse, render, scale
from netloom.operators import netseq, ranking, rewards, sampling, spatial, vocab
from netloom.operators.selection import heavy_values, quantiles_by_key


def one(spark, value, f, kind="array<string>"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(
    "f,given,wanted",
    [
        (t.decompose, "R2200 B2 D300 U10 L11 R10305 R007", "R2000 R200 B2 D300 U10 L10 L1 R10000 R300 R5 R007"),
        (t.segment, "R200U2000R200 B2 xR5y D300", "R200 U2000 R200 B2 xR5y D300"),
        (t.concatenate, "R200 U2000 R200 B2 D300 <PUSH> l5 R6", "R200U2000R200 B2 D300 <PUSH> l5R6"),
        (t.decompose, "", ""),
    ],
)
def test_rewriting(spark, f, given, wanted):
    assert one(spark, given.split(), f) == wanted.split()


def test_contradicting_options():
    for options in ((True, True, False), (False, True, True)):
        with pytest.raises(ValueError):
            t.rewrite(F.lit(None), *options)


def test_points(spark):
    row = spark.sql("select struct(7L x, -7L y, 3L m) a, struct(1L x, 2L y, 3L m) b")
    a, b = F.col("a"), F.col("b")
    r = row.select(add(a, b), scale(a, F.lit(0.5)), divide(a, F.lit(2)), floor_divide(a, F.lit(2)), divide(a, F.lit(0)), render(a), delta_tokens(a)).first()
    assert [tuple(x) if x is not None else None for x in r[:5]] == [(8, -5, 6), (3, -3, 1), (3, -3, 1), (3, -4, 1), None]
    assert r[5] == "(7, -7, 3)" and r[6] == ["R7", "D7", "T3"]
    texts = [" (1, -2,3)x", "(1,2)", None, "", "(99999999999999999999, 1, 1)", "( 1, 2, 3)"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, c string").orderBy("i").select(parse("c").alias("p")).collect()
    assert [tuple(r.p) if r.p else None for r in got] == [(1, -2, 3), None, None, None, None, None]


@pytest.mark.parametrize(
    "text,wanted", [("(0,0,0)(-5,0,0)", ""), ("(007,1,2)", ""), (" (1,2,3)>(4,5,6)< ", "(1,2,3)>(4,5,6)<"), ("(1,2,3) x", ""), ("", ""), (None, ""), ("(1,0,10)", "(1,0,10)")]
)
def test_filters(spark, text, wanted):
    assert one(spark, text, t.usable, "string") == wanted


def test_logs(spark):
    text = "#% End globalDetailRoute (total cpu=1:02:03.5, real=0:00:07.0)\nTotal  Violations : 12 Viols.\ncpu = x\n**optDesign a cpu = 0:00:01.9, real = 0:00:01\n**optDesign b cpu = 0:01:01.9, real = 0:00:01\n"
    row = spark.createDataFrame([(text,)], "c string").select(*logs.eco(F.col("c")), logs.violations(F.col("c")).alias("v"), *logs.routing(F.col("c"))).first()
    assert (row.eco_cpu, row.eco_real, row.v, row.opt_cpu, row.route_cpu, row.total_cpu) == (3723.5, 7.0, 12, 61.0, None, 61.0)
    assert one(spark, "no totals", logs.violations, "string") == 0 and one(spark, None, logs.violations, "string") == 0


@pytest.mark.parametrize("bins", [7, 1024])
def test_quantiles_equal_sorting(spark, bins):
    rng = random.Random(bins)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([None, rng.randrange(-(10**6), 10**6), 5, -(2**63), 2**63 - 1]), 0) for _ in range(600)]
    rows += [("nulls", None, 0), ("one", 42, 0)]
    df = spark.createDataFrame(rows, "key string, v bigint, value int")
    out = {r.key: r for r in quantiles_by_key(df, "key", "v", bins=bins).collect()}
    groups = defaultdict(list)
    for k, v, _ in rows:
        groups[k].append(v)
    assert set(out) == set(groups)
    for k, values in groups.items():
        kept = sorted(v for v in values if v is not None)
        r = out[k]
        assert (r.n_rows, r.n) == (len(values), len(kept))
        for p in (500, 900, 990):
            assert r[f"q{p}"] == (kept[-(-len(kept) * p // 1000) - 1] if kept else None)


def test_quantiles_of_nothing_and_salted(spark, monkeypatch):
    from netloom.operators import selection

    assert quantiles_by_key(spark.createDataFrame([], "key string, v bigint"), "key", "v").count() == 0
    monkeypatch.setattr(selection, "BROADCAST_KEYS", 0)
    df = spark.createDataFrame([("a" if i % 3 else None, i * i) for i in range(500)], "key string, v bigint")
    out = {r.key: r.q500 for r in quantiles_by_key(df, "key", "v").collect()}
    for k in ("a", None):
        values = sorted(i * i for i in range(500) if bool(i % 3) == bool(k))
        assert out[k] == values[-(-len(values) // 2) - 1]


@pytest.mark.parametrize("strict", [False, True])
def test_range_join_equals_all_pairs(spark, strict):
    rng = random.Random(4)
    boxes = []
    for i in range(250):
        size = rng.choice([0, 5, 50, 400, 20_000, 3_000_000])
        x, y, m = rng.randrange(-2000, 2000), rng.randrange(-2000, 2000), rng.randrange(4)
        boxes.append((i, rng.choice("ab") if i else None, x, y, m, x + rng.randrange(size + 1), y + rng.randrange(size + 1), m + rng.randrange(3)))
    df = spark.createDataFrame(boxes, "id bigint, g string, x1 bigint, y1 bigint, m1 bigint, x2 bigint, y2 bigint, m2 bigint")
    out = spatial.range_join(df, "id", "g", 10, strict).collect()
    assert sorted(map(str, spatial.range_join(df, "id", "g", None, strict).collect())) == sorted(map(str, out))
    got = {(r.a, r.b): r.overlap for r in out}
    want = {}
    for p in boxes:
        for q in boxes:
            if p[0] < q[0] and p[1] and p[1] == q[1]:
                side = [min(p[5 + i], q[5 + i]) - max(p[2 + i], q[2 + i]) for i in range(3)]
                if all(s > 0 if strict else s >= 0 for s in side):
                    want[p[0], q[0]] = float(side[0] * side[1] * (side[2] or 1))
    assert len(out) == len(got) and got == want


def test_boxes_that_touch(spark):
    df = spark.createDataFrame([(1, "d", 0, 0, 0, 5, 4, 0), (2, "d", 5, 0, 0, 9, 4, 0), (3, "d", 2, 1, 0, 5, 5, 0)], "id bigint, g string, x1 bigint, y1 bigint, m1 bigint, x2 bigint, y2 bigint, m2 bigint")
    assert {(r.a, r.b): r.overlap for r in spatial.range_join(df, "id", "g", 100).collect()} == {(1, 2): 0.0, (1, 3): 9.0, (2, 3): 0.0}
    assert spatial.range_join(df.limit(0), "id", "g", 100).count() == 0


def test_connections_and_graph(spark):
    drivers = spark.createDataFrame([("a", "i1", 1), ("a", "i2", 2), ("b", "i3", 1), (None, "i9", 1)], "net string, instance string, pin int")
    loads = spark.createDataFrame([("b", "i2"), ("b", "i2"), ("c", "i1"), ("a", "i2"), ("a", "i3"), ("c", None)], "net string, instance string")
    pairs = spatial.connect(drivers, loads)
    assert [tuple(r) for r in pairs.collect()] == [("a", "b")]
    con = spark.createDataFrame([("d", "a", "b"), ("d", "a", "c")], "source_design string, a string, b string")
    near = spark.createDataFrame([("d", "a", "b", 3.0)], "source_design string, a string, b string, overlap double")
    got = {(r.source, r.target): (r.relation, r.overlap) for r in spatial.design_graph(con, near).collect()}
    assert got == {("a", "b"): ("nearby_to", 3.0), ("a", "c"): ("connects_to", None)}


def raw_net(vertices, edges):
    v = [{"id": i, "x": x, "y": y, "layer_id": m, "is_pin": k != "w", "is_driver_pin": k == "d"} for i, (x, y, m, k) in enumerate(vertices)]
    e = [{"source_id": a, "target_id": b, "path": [{"x": x, "y": y, "layer_id": m} for x, y, m in path]} for a, b, path in edges]
    return {"vertices": v, "edges": e}


def test_net_sequences():
    net = raw_net([(0, 0, 0, "d"), (9, 0, 0, "w"), (9, 5, 0, "l"), (9, -5, 0, "l")], [(1, 0, [(9, 0, 0), (0, 0, 0)]), (1, 2, [(9, 0, 0), (9, 5, 0)]), (3, 1, [(9, -5, 0), (9, 0, 0)])])
    out = netseq.net_sequence(net, 4)
    assert out["driver"] == "(0, 0, 0)" and out["loads"] == ["(9, 5, 0)", "(9, -5, 0)"] and out["patterns"] == [["R9", "U5"], ["R9", "D5"]]
    assert out["tree_seq"] == ["(0, 0, 0)", "(9, 0, 0)", "[BRANCH]", "(9, 5, 0)", "[END]", "[BRANCH]", "(9, -5, 0)", "[END]"]
    cycle = raw_net([(0, 0, 0, "d"), (1, 0, 0, "l"), (1, 1, 0, "w")], [(0, 1, [(0, 0, 0), (1, 0, 0)]), (1, 2, [(1, 0, 0), (1, 1, 0)]), (2, 0, [(1, 1, 0), (0, 0, 0)])])
    apart = raw_net([(0, 0, 0, "d"), (1, 0, 0, "l"), (5, 5, 0, "l")], [(0, 1, [(0, 0, 0), (1, 0, 0)])])
    headless = raw_net([(0, 0, 0, "l"), (1, 0, 0, "l")], [(0, 1, [(0, 0, 0), (1, 0, 0)])])
    assert [netseq.net_sequence(n, 4).get("skip_reason") for n in (cycle, apart, headless, {"vertices": None, "edges": []})] == ["cycle", "not connected", "no driver", "no routing"]


def test_prefix_trees_of_many_nets():
    from netloom.operators.forest import Forest

    rng = random.Random(3)
    row, paths = [], []
    for r in range(40):
        for _ in range(rng.randrange(0, 6)):
            row.append(r)
            paths.append([(0, 0, 0)] + [(d + 1, rng.randrange(2), 0) for d in range(rng.randrange(0, 6))])
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
    f = netseq.merged(np.array(row), offsets, np.array([q for p in paths for q in p]), 40)
    for r in range(40):
        mine, seen = [p for p, x in zip(paths, row) if x == r], {}
        for p in mine:
            for d in range(1, len(p) + 1):
                seen.setdefault(tuple(p[:d]), len(seen))
        got = {}
        for i in np.flatnonzero(f.row == r):
            up = tuple(got[f.parent[i]]) if f.parent[i] >= 0 else ()
            got[i] = (*up, tuple(f.xyz[i].tolist()))
        assert sorted(got.values()) == sorted(seen)
        # pre-order, children in order of first use
        first = lambda q: [min(k for k, p in enumerate(mine) if tuple(p[:d]) == q[:d]) for d in range(1, len(q) + 1)]
        assert list(got.values()) == sorted(seen, key=first)
    assert Forest.parse(f.serialise()).parent.tolist() == f.parent.tolist()


@pytest.mark.parametrize("seed,permille", [(1, 50), (2, 50), (3, 100), (4, 300)])
def test_heavy_values(spark, seed, permille):
    rng = random.Random(seed)
    names = [None] * 4 + ["", "hot"] * 6 + [f"d{i}" for i in range(12)] * 2 + [f"s{i}" for i in range(60)]
    rows = [(rng.choice(names), 1, 2) for _ in range(rng.choice([20, 21, 400, 1001]))]
    df = spark.createDataFrame(rows, "g string, count int, hash int")
    want = {g: n for g, n in Counter(r[0] for r in rows).items() if g is not None and n * 1000 > len(rows) * permille}
    assert {r.g: r["count"] for r in heavy_values(df, "g", permille).collect()} == want


def test_heavy_values_of_few(spark):
    df = spark.createDataFrame([], "g string")
    assert heavy_values(df, "g").count() == 0
    assert heavy_values(spark.createDataFrame([(None,), (None,)], "g string"), "g").count() == 0
    assert [tuple(r) for r in heavy_values(spark.createDataFrame([("a",), ("a",)], "g string"), "g").collect()] == [("a", 2)]


def test_patterns():
    path = [(i, i % 2, 0) for i in range(20)]
    parts = netseq.halves(path, 4)
    assert all(len(p) <= 5 for p in parts) and netseq.flatten(parts) == path and netseq.halves(path[:6], 4) == [path[:6]]
    assert netseq.pattern_name([(0, 0, 0), (0, 0, 0), (5, 0, 0), (5, 3, 0), (5, 3, 2), (4, 3, 2)]) == "R5U3T2L1" and netseq.pattern_name([(1, 1, 1)]) == ""
    with pytest.raises(ValueError):
        netseq.oriented(path, (7, 7, 7))


def test_ordered_positions(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(50), rng.choice([None, 1, 2])) for i in range(700)]
    df = spark.createDataFrame(rows, "k bigint, v bigint, w bigint")
    out = ranking.ordered(df.repartition(7), ["-v", "k"], ["w"]).collect()
    want, total = sorted(rows, key=lambda r: (-r[1], r[0])), 0
    for r, w in zip(sorted(out, key=lambda r: r["rank"]), want):
        total += w[2] or 0
        assert (r.k, r.v, r.w, r.cum_w) == (*w, total)
    assert [r["rank"] for r in sorted(out, key=lambda r: r["rank"])] == list(range(1, 701))
    assert ranking.ordered(df.limit(0), ["k"], ["w"]).count() == 0


def test_sampling(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a, b = (sorted(r.k for r in sampling.sample(df.repartition(n), "k", 50, 3).collect()) for n in (2, 9))
    assert a == b and len(set(a)) == 50 and sampling.sample(df, "k", 5000, 3).count() == 1000
    parts = Counter(r.split for r in sampling.train_test(df, "k", 0.25, 1).collect())
    assert parts == {"test": 250, "train": 750}
    order = [r["index"] for r in sampling.repeat_order(7, 3, 4, 2, spark).orderBy("position").collect()]
    assert order == [i for c in ((0, 1, 2), (3, 4, 5)) for _ in range(4) for i in c for _ in range(2)]
    cut = lambda ids, n: one(spark, ids, lambda c: sampling.truncate_protected(c, n, [9]), "array<int>")
    assert cut([1, 9, 2, 3, 9, 4], 4) == [9, 3, 9, 4] and cut([9, 9, 9], 2) is None and cut([1, 2], 5) == [1, 2]


def test_vocabulary(spark):
    df = spark.createDataFrame([(1, "b a <EOS>"), (2, None), (3, " é B a  zz"), (4, "")], "k int, t string")
    words = {r.token: r.id for r in vocab.word_vocabulary(df, "t", specials=["<EOS>", "<UNK_LEN>"]).collect()}
    assert words == {"B": 0, "a": 1, "b": 2, "zz": 3, "é": 4, "<EOS>": 5, "<UNK_LEN>": 6}
    table = vocab.word_vocabulary(df.filter("k = 1"), "t", specials=["<EOS>", "<UNK_LEN>"])
    for most in (100, 2):
        out = {r.k: r.ids for r in vocab.encode_words(df, "k", "t", table, most=most).collect()}
        assert out == {1: [1, 0, 2], 2: [], 3: [3, 3, 0, 3], 4: []}
    for most in (100, 0):
        none = vocab.encode_words(df, "k", "t", table.filter("token = 'a'"), most=most).collect()
        assert {r.k: r.ids for r in none} == {1: [None, 0, None], 2: [], 3: [None, None, 0, None], 4: []}
    even = vocab.distribution(spark.createDataFrame([("a", 5), ("b", 5)], "token string, count bigint")).first()
    assert even.entropy == pytest.approx(1.0) and even.gini == pytest.approx(0.0)


def test_rewards(spark):
    good, loads = "R100 <PUSH> U50 <POP> <PUSH> R100 <POP> <EOS>", ["(100, 50, 0)", "(200, 0, 0)"]
    rows = [(1, good, good, loads), (2, "", good, loads), (3, "R100 U50", good, loads), (4, good, good, []), (5, None, None, None), (6, good, "", loads)]
    df = spark.createDataFrame(rows, "k int, c string, t string, l array<string>")
    m = rewards.measures(df, "k", "c", "t", "l")
    both = rewards.gated(rewards.wirelength(), {"met": rewards.connectivity(True)}, F.lit(1.0))
    out = {r.k: r for r in m.select("k", *[rewards.reward(n).alias(n) for n in rewards.REWARDS], rewards.graceful(True).alias("share"), both.alias("both")).collect()}
    assert (out[1].wirelength, out[1].connectivity, out[1].graceful, out[1].elmore) == (0.0, 1.0, 1.0, 0.0)
    assert (out[2].wirelength, out[2].connectivity, out[2].graceful) == (-0.2, -1.0, -1.0)
    assert out[3].wirelength == pytest.approx(100 / 250) and out[3].connectivity == -1.0 and out[3].share == pytest.approx(0.5 * 0.5 + 0.5)
    assert out[3].both.final == pytest.approx(0.4 * 0.5) and out[3].both.components["met_mask"] == 0.5
    assert (out[4].connectivity, out[4].graceful) == (1.0, -1.0) and out[5].wirelength == -0.2 and out[6].wirelength == -0.2
    with pytest.raises(ValueError):
        rewards.reward("none")


def test_advantages(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", 2.0), (3, "a", 2.0), (4, None, 1.0), (5, None, 3.0), (6, "n", float("nan")), (7, "s", 9.0)], "k int, g string, r double")
    out = {r.k: r.advantage for r in rewards.advantages(df, "g", "r").collect()}
    assert out[1] == 0.0 and out[6] is None and out[7] == 0.0 and len(out) == 7
    assert out[5] == pytest.approx(1 / (np.std([1, 3], ddof=1) + 1e-4))


def test_timing_and_power_reports(spark):
    text = (
        "timeDesign Summary\n-----\nSetup views included:\n v\n| Setup mode | all | reg2reg | default |\n"
        "|  WNS (ns):|  -0.125 | 1 | 2 |\n|  TNS (ns):|  -3.5 | 1 | 2 |\nDensity: 71.25%\n"
        "Total Power\n-----\nTotal Internal Power:   1.5  (30%)\nTotal Switching Power:  2.25 x\nTotal Leakage Power: 0.5 y\nTotal Power:  4.25\n"
    )
    df = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "k int, c string")
    out = {r.k: r for r in df.select("k", *logs.timing(F.col("c")), *logs.power(F.col("c"))).collect()}
    assert tuple(out[1])[1:] == ("-0.125", "-3.5", "71.25", "1.5", "2.25", "0.5", "4.25")
    assert all(v is None for k in (2, 3) for v in tuple(out[k])[1:])


@pytest.mark.parametrize("upper", [0.5, 0.95])
def test_interpolated_quantiles(spark, upper):
    from netloom.operators.reports import interpolated_quantile

    rng = random.Random(9)
    rows = [(rng.choice(["a", None]), rng.choice([1.0, 2.5, rng.random()])) for _ in range(201)]
    df = spark.createDataFrame(rows, "g string, v double")
    whole = interpolated_quantile(df, [], "v", upper).first()
    assert whole.hi == pytest.approx(np.quantile([v for _, v in rows], upper))
    for r in interpolated_quantile(df, ["g"], "v", upper).collect():
        values = [v for g, v in rows if g == r.g]
        assert r.hi == pytest.approx(np.quantile(values, upper)) and r.lo == min(values)
