import json

import pytest
from pyspark.sql import functions as F

from netloom.sources import store
from netloom.streaming import jobs


def frame(spark, n, extra=False):
    df = spark.range(n).selectExpr("cast(id as string) as net_name", "array('(0, 0, 0)') as tree_seq")
    return df.withColumn("note", F.lit("x")) if extra else df


def test_designs(spark, tmp_path):
    base = str(tmp_path)
    assert store.write_design(spark, f"{base}/a", "a", {"net_seqs": frame(spark, 3), "design_graph": frame(spark, 0)}) == {"net_seqs": 3}
    store.write_design(spark, f"{base}/b", "b", {"net_seqs": frame(spark, 2, True)})
    (tmp_path / "broken").mkdir()
    assert store.discover_designs(spark, base) == ["a", "b"]
    assert store.write_design(spark, f"{base}/a", "a", {"net_seqs": frame(spark, 9)}, rebuild=False) == {"net_seqs": 3}
    assert json.loads((tmp_path / "a/metadata.json").read_text())["data_counts"] == {"net_seqs": 3}
    assert list(store.read_design(spark, f"{base}/a", ["net_seqs", "pin2pin_loc_seqs"])) == ["net_seqs"] and list(store.read_design(spark, f"{base}/a")) == ["net_seqs"]
    tables = store.aggregate(spark, base)
    assert tables["net_seqs"].filter("source_design = 'a' and note is null").count() == 3
    totals = {(r.data_type, r.source_design): r["count"] for r in store.statistics(tables).collect()}
    assert totals == {("net_seqs", "a"): 3, ("net_seqs", "b"): 2, ("net_seqs", None): 5, (None, None): 5}
    assert store.flat_corpus(spark, base, f"{base}/out", ["a", "b", "missing"]).count() == 5
    assert json.loads((tmp_path / "out/aggregation.json").read_text()) == {"requested": ["a", "b", "missing"], "loaded": ["a", "b"]}
    assert store.load_corpus(spark, f"{base}/out").count() == 5
    with pytest.raises(FileNotFoundError):
        store.load_corpus(spark, f"{base}/nowhere")


def test_splits(spark):
    df = spark.createDataFrame([("validation", 1), ("test", 2), (None, 3)], "split string, k int")
    assert [r.k for r in store.choose_split(df).collect()] == [2] and store.choose_split(df, "validation").count() == 1
    assert store.choose_split(df.limit(0)).count() == 0


def test_reports_and_logs(spark, tmp_path):
    for d, m in (("a", "GT"), ("a", "PRED"), ("b", "GT")):
        (tmp_path / d / m).mkdir(parents=True)
        (tmp_path / d / m / "drc.rpt").write_text(f"Total Violations : {len(d + m)} Viols.\n\n")
    found = store.whole_files(spark, f"{tmp_path}/*/*/drc.rpt", r"/([^/]+)/([^/]+)/drc\.rpt$", ["source_design", "meta_type"])
    grid = store.expected_grid(spark, spark.createDataFrame([("a",), ("b",), ("c",)], "source_design string"), found)
    assert grid.count() == 9 and grid.filter("text is not null").count() == 3
    assert store.whole_files(spark, f"{tmp_path}/*/none", "x", ["d"]).count() == 0
    assert store.read_metrics(spark, f"{tmp_path}/none.csv") is None
    df = spark.createDataFrame([(1, ["a"], 0.5), (2, None, None)], "k int, t array<string>, v double")
    store.write_metrics(df, f"{tmp_path}/m.csv")
    back = {r.k: (r.t, r.v) for r in store.read_metrics(spark, f"{tmp_path}/m.csv").collect()}
    assert back == {1: ('["a"]', 0.5), 2: (None, None)}
    assert store.markdown(df.select("k", "v").orderBy("k")).splitlines() == ["| k | v |", "| --- | --- |", "| 1 | 0.5 |", "| 2 |  |"]
    assert r"1 & 0.5 \\" in store.latex(df.select("k", "v"))
    with pytest.raises(ValueError):
        store.markdown(df, most=1)


def test_json_paths_and_checkpoints(spark):
    df = spark.createDataFrame([('{"a": {"b": 1}, "c": [4, 5]}',), ("{}",), (None,)], "j string")
    got = [r[0] for r in df.select(store.nested_value(F.col("j"), ["c", "a.b"])).collect()]
    assert got == ["1", None, None]
    assert df.select(store.nested_value(F.col("j"), ["a.b", "c"])).first()[0] == "5"
    names = spark.createDataFrame([("m/checkpoint-9",), ("m/checkpoint-10",), ("m/final",)], "path string")
    assert store.latest_checkpoint(names).first().path == "m/checkpoint-10"


def test_exports(spark, tmp_path):
    from netloom.operators.trees import tree_edges

    nets = spark.createDataFrame([("d", "n", ["(0, 0, 0)", "(0, 0, 4)", "(5, 0, 4)"]), ("d", "e", None)], "design string, net string, tree array<string>")
    edges = nets.select("design", "net").join(tree_edges(nets, "net", "tree"), "net")
    rows = {r.net_name: r for r in store.edges_export(edges, "design", "net", "edges").collect()}
    assert rows["e"].edges == [] and rows["n"].design == "d" and rows["n"].edges[0].end.layer == 4
    lines = {r.value for r in store.edges_text(edges, "design", "net", "edges").collect()}
    assert "net_name\nn\n0 0 0 0 0 2\n0 0 2 5 0 2" in lines
    store.write_partitioned(store.edges_text(edges, "design", "net", "edges"), f"{tmp_path}/t", "design", "text")
    assert spark.read.text(f"{tmp_path}/t").count() == 6


def test_coordinates_grids_and_predictions(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "human_a.csv").write_text("label,token,x,y\nl,t,1.5,2\nl,u,x,\n")
    (tmp_path / "c" / "domain_b.csv").write_text("label,token,x,y,z\nm,v,1,2,3\n")
    (tmp_path / "c" / "other.csv").write_text("a\n1\n")
    got = sorted(tuple(r) for r in store.read_coordinates(spark, f"{tmp_path}/c").collect())
    assert got[0] == ("domain", "m", "v", 1.0, 2.0, 3.0, 3) and got[1] == ("human", "l", "t", 1.5, 2.0, None, 2) and got[2][3:] == (None, None, None, 2)
    assert store.read_coordinates(spark, f"{tmp_path}/none").count() == 0
    for name in ("BPE-1000", "BPE-4000", "Unigram-1000"):
        (tmp_path / "g" / name).mkdir(parents=True)
        (tmp_path / "g" / name / "metadata.json").write_text('{"vocab": 7}')
    grid = store.metadata_grid(spark, f"{tmp_path}/g", ["BPE", "WordPiece"], [1000, 16000]).collect()
    assert [(r.algorithm, r.vocab_size, r.metadata) for r in grid] == [("BPE", 1000, '{"vocab": 7}')]
    rows, found = spark.range(3).withColumn("a", F.lit(1)), spark.range(3).withColumn("p", F.lit("x"))
    assert store.with_predictions(rows, found, "id").filter("p = 'x' and a = 1").count() == 3
    for bad in (found.filter("id > 0"), found.union(found.filter("id = 0")), found.withColumn("id", F.col("id") + 1)):
        with pytest.raises(ValueError):
            store.with_predictions(rows, bad, "id")


def test_config():
    c = store.EngineConfig(workspace="/a/x", seed=7)
    assert store.EngineConfig.from_dict(c.to_dict()) == c and c.with_prefix("/a", "/b").workspace == "/b/x"
    with pytest.raises(TypeError):
        store.EngineConfig.from_dict({"unknown": 1})


def test_streams(spark, tmp_path):
    from netloom.operators.trees import target_tokens

    schema = "k bigint, tree array<string>, at timestamp"
    part = lambda lo: spark.range(lo, lo + 5).selectExpr("id as k", "array('(0, 0, 0)', '(5, 0, 0)') as tree", "timestamp_seconds(id * 86400) as at")
    part(0).write.parquet(f"{tmp_path}/in/0")
    stream = lambda: jobs.read_folder(spark, f"{tmp_path}/in/*", schema)
    go = lambda: jobs.run(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", lambda df: target_tokens(df, "k", "tree"))
    go()
    part(5).write.parquet(f"{tmp_path}/in/1")
    go()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.k for r in rows) == list(range(10)) and all(r.target == ["R5", "<EOS>"] for r in rows)
    jobs.run(stream(), f"{tmp_path}/days", f"{tmp_path}/cp2", lambda df: jobs.arrivals(df.withColumn("g", F.lit("x")), "at", "g", late="1 day"))
    assert spark.read.parquet(f"{tmp_path}/days").count() >= 7
