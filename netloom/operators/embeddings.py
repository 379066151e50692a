"""Embedding tables: lookup, reduction, clusters and nearest points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.session import stored

#: Moves that mirror each other.
MIRRORED = {"U": "D", "L": "R", "T": "B"}


def select(embeddings: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of the embeddings whose key is wanted, each once."""
    return embeddings.join(wanted.select(key).distinct(), key)


def wide(df: DataFrame, key: str, vector: str, size: int, labels: Sequence[str] = ()) -> DataFrame:
    """``emb_0`` and so on as columns."""
    return df.select(key, *labels, *[F.get(vector, F.lit(i)).alias(f"emb_{i}") for i in range(size)])


def reduce_pca(df: DataFrame, key: str, vector: str, k: int = 2, labels: Sequence[str] = ()) -> DataFrame:
    """``key``, labels and the first ``k`` principal coordinates, centred. Rows with null vectors are left out."""
    rows = df.filter(F.col(vector).isNotNull()).select(key, *labels, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows)
    out = model.transform(rows).select(key, *labels, vector_to_array("_p").alias("_p"))
    centre = out.agg(*[F.avg(F.col("_p")[i]).alias(f"_c{i}") for i in range(k)])
    return out.join(F.broadcast(centre), F.lit(True)).select(key, *labels, *[(F.col("_p")[i] - F.col(f"_c{i}")).alias(c) for i, c in enumerate("xyz"[:k])])


def kmeans(df: DataFrame, key: str, columns: Sequence[str], k: int, seed: int = 1, labels: Sequence[str] = ()) -> DataFrame:
    """``key``, labels, coordinates and ``cluster`` of k-means over some columns."""
    rows = df.select(key, *labels, *columns, array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])).alias("_v"))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("_v")


def cluster_ranks(df: DataFrame, columns: Sequence[str], cluster: str = "cluster", pad: float = 0.1) -> DataFrame:
    """Clusters by density, members over area of their box, with the box and its padding."""
    ends = [f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))]
    out = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("members"), *ends)
    area = F.lit(1.0)
    for c in columns:
        area = area * F.greatest(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(1e-9))
    out = out.withColumn("density", F.col("members") / area)
    padded = [x for c in columns for x in ((F.col(f"lo_{c}") - pad * (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).alias(f"lo_{c}"), (F.col(f"hi_{c}") + pad * (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).alias(f"hi_{c}"))]
    # one row a cluster is ranked, not one a point
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("density"), cluster))).select(cluster, "members", "density", "rank", *padded)


def centroid_distances(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """``key``, label and the Euclidean distance of each vector to the mean of its label."""
    parts = df.select(label, F.posexplode(vector).alias("_i", "_x")).groupBy(label, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    means = parts.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_c")).select(label, F.col("_c._m").alias("_c"))
    away = F.sqrt(F.aggregate(F.zip_with(vector, "_c", lambda x, m: F.pow(x.cast("double") - m, F.lit(2.0))), F.lit(0.0), lambda a, b: a + b))
    return df.join(means, label).select(key, label, away.alias("distance"))


def nearest_to_centroid(df: DataFrame, key: str, label: str, vector: str, k: int) -> DataFrame:
    """The ``k`` nearest of each label to its mean, with their rank; ties by key."""
    w = Window.partitionBy(label).orderBy("distance", key)
    return centroid_distances(df, key, label, vector).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


ROUNDS = 64


def densest_cluster(df: DataFrame, key: str, columns: Sequence[str], eps: float = 1.5, least: int = 5) -> DataFrame:
    """Keys of the largest DBSCAN cluster; without one, of the points within one deviation of the mean on every column.

    Points lie in cells whose diagonal is ``eps``, so all of a cell are neighbours. Points meet only those of cells close by;
    a cell of ``least`` points or more is core as a whole and is not counted out. Core cells that touch are joined by passing on the least
    label and then the label's own label, so rounds grow with the logarithm of a chain of cells; ``ROUNDS`` bounds them.
    """
    d = len(columns)
    side = eps / d**0.5
    reach = int(d**0.5) + 1
    pts = df.select(F.col(key).alias("k"), F.array(*[F.col(c).cast("double") for c in columns]).alias("p")).filter(F.forall("p", lambda v: v.isNotNull()))
    pts = stored(pts.withColumn("cell", F.transform("p", lambda v: F.floor(v / side))), "points")
    shifts = [()]
    for _ in range(d):
        shifts = [(*s, i) for s in shifts for i in range(-reach, reach + 1)]
    around = F.explode(F.array(*[F.array(*[F.lit(i) for i in s]) for s in shifts]))
    near = pts.withColumn("s", around).select("k", "p", F.col("cell").alias("own"), F.zip_with("cell", "s", lambda a, b: a + b).alias("cell"))
    other = pts.select(F.col("k").alias("k2"), F.col("p").alias("p2"), "cell")
    away = F.aggregate(F.zip_with("p", "p2", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    pairs = near.join(other, "cell").filter(away <= eps * eps).select("k", "own", "k2", F.col("cell").alias("cell2"))
    full = stored(pts.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(F.col("cell").alias("own")), "full-cells")
    thin = pairs.join(full, "own", "left_anti").groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("k")
    core = stored(thin.unionByName(pts.join(full.withColumnRenamed("own", "cell"), "cell", "left_semi").select("k")), "core")
    links = pairs.join(core, "k").join(core.withColumnRenamed("k", "k2"), "k2").select("own", "cell2").distinct()
    links = stored(links, "cells")
    label = links.select(F.col("own").alias("cell"), F.col("own").alias("label")).distinct()
    before = -1
    for _ in range(ROUNDS):
        least_label = links.join(label, links["cell2"] == label["cell"]).groupBy("own").agg(F.min("label").alias("mid")).withColumnRenamed("own", "cell")
        ahead = label.select(F.col("cell").alias("mid"), F.col("label").alias("further"))
        label = stored(least_label.join(ahead, "mid").select("cell", F.least("mid", "further").alias("label")), "labels")
        now = label.agg(F.sum(F.xxhash64("label").cast("decimal(38,0)"))).first()[0]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"cells did not join in {ROUNDS} rounds")
    mine = core.join(pairs, "k").join(label.withColumnRenamed("cell", "own"), "own").select(F.col("k2").alias("k"), "label").distinct()
    best = mine.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(1)
    found = mine.join(best, "label").select("k")
    if found.isEmpty():
        ends = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
        ok = F.lit(True)
        for c in columns:
            ok = ok & (F.abs(F.col(c) - F.col(f"m_{c}")) <= F.col(f"s_{c}"))
        found = df.join(F.broadcast(ends), F.lit(True)).filter(ok).select(F.col(key).alias("k"))
    return found.select(F.col("k").alias(key))


def mirrored_pairs(tokens: DataFrame) -> DataFrame:
    """Pairs ``token_a``, ``token_b`` of moves that mirror each other and have the same length, both among the tokens."""
    parts = tokens.select("token", F.substring("token", 1, 1).alias("d"), F.substring("token", 2, 40).alias("n")).filter(F.col("token").rlike(r"^[UDLRTB]\d+$")).distinct()
    mate = F.create_map(*[F.lit(x) for pair in MIRRORED.items() for x in pair])
    a = parts.filter(F.col("d").isin(*MIRRORED)).select(F.col("token").alias("token_a"), mate[F.col("d")].alias("d"), "n")
    return a.join(parts.select("d", "n", F.col("token").alias("token_b")), ["d", "n"]).select("token_a", "token_b")
