"""Reading and writing of design data, corpora, metrics and exports."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, is_dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds of table of a design, and the routing kinds of a report.
KINDS = ["net_seqs", "pin2pin_pattern_seqs", "pin2pin_loc_seqs", "design_graph"]
META = ["GT", "PRED", "POST"]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, sorted; none if it is missing."""
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def valid_design(spark: SparkSession, path: str) -> bool:
    """Whether a folder has metadata and at least one table."""
    names = children(spark, path)
    return "metadata.json" in names and any(f"{k}.parquet" in names for k in KINDS)


def discover_designs(spark: SparkSession, base: str) -> list[str]:
    return [n for n in children(spark, base) if valid_design(spark, f"{base}/{n}")]


def read_design(spark: SparkSession, path: str, kinds: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Tables of a design by kind; without kinds all there are, missing ones are left out."""
    wanted = kinds or [n[: -len(".parquet")] for n in children(spark, path) if n.endswith(".parquet")]
    return {k: spark.read.parquet(f"{path}/{k}.parquet") for k in wanted if exists(spark, f"{path}/{k}.parquet")}


def write_design(spark: SparkSession, path: str, design: str, tables: dict[str, DataFrame], rebuild: bool = True) -> dict[str, int]:
    """Writes non-empty tables and a metadata file with their row counts; keeps a valid folder unless ``rebuild``."""
    if not rebuild and valid_design(spark, path):
        return json.loads(read_text(spark, f"{path}/metadata.json"))["data_counts"]
    counts = {}
    for kind, df in tables.items():
        if df.isEmpty():
            continue
        target = f"{path}/{kind}.parquet"
        df.write.mode("overwrite").parquet(target)
        counts[kind] = spark.read.parquet(target).count()
    meta = {"design_name": design, "generation_timestamp": datetime.now(UTC).isoformat(), "data_counts": counts}
    write_text(spark, f"{path}/metadata.json", json.dumps(meta, indent=2))
    return counts


def aggregate(spark: SparkSession, base: str, designs: Sequence[str] | None = None, kinds: Sequence[str] = KINDS) -> dict[str, DataFrame]:
    """One table for each kind over all designs, with ``source_design``; columns a design lacks are null."""
    found = [d for d in (designs or discover_designs(spark, base)) if valid_design(spark, f"{base}/{d}")]
    out: dict[str, list[DataFrame]] = {}
    for d in found:
        for kind, df in read_design(spark, f"{base}/{d}", kinds).items():
            out.setdefault(kind, []).append(df.withColumn("source_design", F.lit(d)))
    return {k: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs) for k, dfs in out.items()}


def flat_corpus(spark: SparkSession, base: str, output: str, designs: Sequence[str] | None = None) -> DataFrame:
    """The net sequences of all designs in one table, by design, with a record of designs asked for and found."""
    tables = aggregate(spark, base, designs, ["net_seqs"])
    tables["net_seqs"].write.mode("overwrite").partitionBy("source_design").parquet(f"{output}/flat_corpus")
    asked = list(designs or discover_designs(spark, base))
    loaded = [d for d in asked if valid_design(spark, f"{base}/{d}")]
    write_text(spark, f"{output}/aggregation.json", json.dumps({"requested": asked, "loaded": loaded}))
    return spark.read.parquet(f"{output}/flat_corpus")


def load_corpus(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A corpus folder, or the ``flat_corpus`` or ``aggregated/flat_corpus`` in it; of one split, by default train, else the first."""
    for tail in ("/flat_corpus", "/aggregated/flat_corpus", ""):
        if exists(spark, path + tail):
            df = spark.read.parquet(path + tail)
            return choose_split(df, split) if "split" in df.columns else df
    raise FileNotFoundError(path)


def choose_split(df: DataFrame, split: str | None = None) -> DataFrame:
    """Rows of a split; without a name of train if there is one, else of the first by name."""
    if split is None:
        names = sorted(r.split for r in df.select("split").filter("split is not null").distinct().collect())
        split = "train" if "train" in names or not names else names[0]
    return df.filter(F.col("split") == split)


def statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows by design and kind, with totals by kind and over all."""
    parts = [df.select("source_design", F.lit(k).alias("data_type")) for k, df in tables.items()]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.rollup("data_type", "source_design").agg(F.count(F.lit(1)).alias("count"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    """A metrics CSV with inferred types; None if it is missing."""
    return spark.read.csv(path, header=True, inferSchema=True) if exists(spark, path) else None


def write_metrics(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns become JSON text."""
    nested = ("array", "map", "struct")
    df.select(*[F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").csv(path, header=True)


def edges_export(df: DataFrame, design: str, net: str, edges: str) -> DataFrame:
    """``design``, ``net_name`` and ``edges`` of each net, for JSON by design: a net is a line, so a design of any size is never gathered."""
    point = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["m"].alias("layer"))
    item = F.transform(edges, lambda e: F.struct(point(e["s"]).alias("start"), point(e["e"]).alias("end")))
    return df.select(F.col(design).alias("design"), F.col(net).alias("net_name"), item.alias("edges"))


def edges_text(df: DataFrame, design: str, net: str, edges: str) -> DataFrame:
    """``design`` and ``value``: lines of each net, its name and two points an edge with halved layers."""
    line = lambda p: F.concat_ws(" ", p["x"], p["y"], F.expr("1L") * F.floor(p["m"] / 2))
    lines = F.transform(edges, lambda e: F.concat_ws(" ", line(e["s"]), line(e["e"])))
    return df.select(F.col(design).alias("design"), F.concat_ws("\n", F.lit("net_name"), F.col(net), F.when(F.size(lines) > 0, F.array_join(lines, "\n"))).alias("value"))


def write_partitioned(df: DataFrame, path: str, by: str, kind: str = "json") -> None:
    writer = df.write.mode("overwrite").partitionBy(by)
    writer.json(path) if kind == "json" else writer.text(path)


def whole_files(spark: SparkSession, pattern: str, path_regex: str, names: Sequence[str]) -> DataFrame:
    """``names`` taken from the path by the groups of a pattern, and ``text``, of whole files; an empty table without files."""
    schema = ", ".join(f"{n} string" for n in (*names, "text"))
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    if not (p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []):
        return spark.createDataFrame([], schema)
    files = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("_f"), F.col("value").alias("text"))
    return files.select(*[F.regexp_extract("_f", path_regex, i).alias(n) for i, n in enumerate(names, 1)], "text")


def read_coordinates(spark: SparkSession, folder: str) -> DataFrame:
    """``kind``, ``label``, ``token``, ``x``, ``y``, ``z`` and ``dimensions`` of the coordinate CSVs of a folder.

    The kind is how a file (or the folder a file is in) is named: ``human_`` or ``domain_``; others are not read. A file has two or three
    dimensions, by its header; ``z`` is null in two. An empty table without files.
    """
    schema = "kind string, label string, token string, x double, y double, z double, dimensions int"
    out = None
    for kind in ("human", "domain"):
        for name in children(spark, folder):
            if not name.startswith(kind + "_"):
                continue
            rows = spark.read.csv(f"{folder}/{name}", header=True)
            flat = "z" not in rows.columns
            z = F.lit(None) if flat else F.col("z")
            part = rows.select(F.lit(kind).alias("kind"), "label", "token", *[F.col(c).try_cast("double").alias(c) for c in "xy"], z.try_cast("double").alias("z"), F.lit(2 if flat else 3).alias("dimensions"))
            out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def metadata_grid(spark: SparkSession, base: str, algorithms: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """``algorithm``, ``vocab_size`` and ``metadata`` (JSON text) of the folders ``<algorithm>-<size>`` there are; missing ones are left out."""
    found = whole_files(spark, f"{base}/*/metadata.json", r"([^/]+)-(\d+)/metadata\.json$", ["algorithm", "vocab_size"])
    wanted = F.col("algorithm").isin(*algorithms) & F.col("vocab_size").cast("int").isin(*sizes)
    return found.filter(wanted).select("algorithm", F.col("vocab_size").cast("int").alias("vocab_size"), F.col("text").alias("metadata"))


def with_predictions(dataset: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """The dataset with its predictions, by key. An error if a row has no prediction or several, or a prediction no row."""
    marked = dataset.withColumn("_d", F.lit(1)).join(predictions.withColumn("_p", F.lit(1)), key, "full")
    rows, found, pairs = dataset.count(), predictions.count(), marked.agg(F.count_if(F.col("_d").isNotNull() & F.col("_p").isNotNull())).first()[0]
    if not rows == found == pairs:
        raise ValueError(f"{rows} rows and {found} predictions make {pairs} pairs")
    return marked.drop("_d", "_p")


def expected_grid(spark: SparkSession, designs: DataFrame, found: DataFrame, kinds: Sequence[str] = META, key: str = "source_design") -> DataFrame:
    """Every design and kind, with what was found for it or nulls."""
    grid = designs.select(key, F.explode(F.array(*[F.lit(k) for k in kinds])).alias("meta_type"))
    return grid.join(found, [key, "meta_type"], "left")


def nested_value(json_text: Column, paths: Sequence[str]) -> Column:
    """The last of some dotted paths that has a value in a JSON text; of a list its last element."""
    parsed = [F.get_json_object(json_text, "$." + p) for p in reversed(paths)]
    value = F.coalesce(*parsed)
    items = F.from_json(value, "array<string>")
    return F.when(value.startswith("["), F.element_at(items, -1)).otherwise(value)


def latest_checkpoint(names: DataFrame, name: str = "path") -> DataFrame:
    """The path with the largest number at its end."""
    step = F.regexp_extract(name, r"(\d+)/?$", 1).try_cast("bigint")
    return names.filter(step.isNotNull()).agg(F.max_by(name, step).alias("path"), F.max(step).alias("step"))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table of at most ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has at most {most} rows")
    line = lambda v: "| " + " | ".join(v) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(["" if x is None else str(x) for x in r]) for r in rows]])


def latex(df: DataFrame, most: int = 1000) -> str:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has at most {most} rows")
    clean = lambda x: "--" if x is None else str(x).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    body = [" & ".join(map(clean, r)) + r" \\" for r in [df.columns, *rows]]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", r"\toprule", body[0], r"\midrule", *body[1:], r"\bottomrule", r"\end{tabular}"])


@dataclass
class TokenizationConfig:
    algorithm: str = "DecimalWordLevel"
    decimal: bool = True
    concatenate: bool = False
    segment: bool = False
    overlap_top_k: int = 0
    connected_top_k: int = 0


@dataclass
class EngineConfig:
    """Settings of a run; unknown keys of a file are an error, missing ones have their default."""

    workspace: str = ""
    test_ratio: float = 0.1
    seed: int = 42
    tokenization: TokenizationConfig = field(default_factory=TokenizationConfig)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, data: dict) -> EngineConfig:
        data = dict(data)
        if isinstance(data.get("tokenization"), dict):
            data["tokenization"] = TokenizationConfig(**data["tokenization"])
        return cls(**data)

    def with_prefix(self, old: str, new: str) -> EngineConfig:
        """The same settings with a path prefix replaced."""

        def moved(x):
            if isinstance(x, str):
                return new + x[len(old) :] if x.startswith(old) else x
            return {k: moved(v) for k, v in x.items()} if isinstance(x, dict) else x

        assert is_dataclass(self)
        return EngineConfig.from_dict(moved(self.to_dict()))
