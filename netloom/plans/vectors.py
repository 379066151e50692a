"""Queries over embeddings, samples and sampling orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import embeddings as emb
from netloom.operators import sampling, vocab
from netloom.plans.corpus import COUNTED, IDS, encoded
from netloom.plans.registry import query
from netloom.session import stored, table

CENTROIDS = """
WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
  c AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM x GROUP BY ALL),
  q AS (SELECT x.vec_id, x.label, sqrt(sum(pow(CAST(x.v AS DOUBLE) - c.m, 2))) AS distance FROM x JOIN c ON c.label = x.label AND c.i = x.i GROUP BY ALL)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


@query(CENTROIDS + " SELECT vec_id, label, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM q) WHERE rank <= 5")
def t15_nearest_to_centroid(spark: SparkSession, d: str) -> DataFrame:
    """The five vectors nearest to the mean of their label."""
    return emb.nearest_to_centroid(vectors(spark, d), "vec_id", "label", "embedding", 5).withColumn("distance", F.round("distance", 6))


@query("SELECT e.vec_id, e.label, e.embedding[1] AS emb_0, e.embedding[2] AS emb_1 FROM embeddings e WHERE vec_id IN (SELECT DISTINCT l_partkey FROM lineitem)")
def j16_selected(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings of the ids in use, as columns."""
    wanted = table(spark, d, "lineitem").select(F.col("l_partkey").alias("vec_id"))
    return emb.wide(emb.select(vectors(spark, d), wanted, "vec_id"), "vec_id", "embedding", 2, ["label"])


@query(
    f"""
WITH {COUNTED}, t AS (SELECT token, token[1:1] AS d, token[2:] AS n FROM cnt WHERE regexp_matches(token, '^[UDLRTB]\\d+$'))
SELECT a.token AS token_a, b.token AS token_b FROM t a JOIN t b ON a.n = b.n AND (a.d || b.d) IN ('UD', 'LR', 'TB')"""
)
def j17_mirrored(spark: SparkSession, d: str) -> DataFrame:
    """Moves that mirror each other."""
    return emb.mirrored_pairs(vocab.token_counts(table(spark, d, "token_dataset"), "target_tokens"))


@query()
def k7_pca(spark: SparkSession, d: str) -> DataFrame:
    """Two principal coordinates."""
    return emb.reduce_pca(vectors(spark, d), "vec_id", "embedding", 2, ["label"])


@query()
def k8_densest(spark: SparkSession, d: str) -> DataFrame:
    """K8: the densest cluster of the principal coordinates."""
    flat = stored(emb.reduce_pca(vectors(spark, d), "vec_id", "embedding", 2), "pca")
    return emb.densest_cluster(flat, "vec_id", ["x", "y"], eps=0.05)


@query()
def k9_clusters(spark: SparkSession, d: str) -> DataFrame:
    """K9: clusters of the principal coordinates by density, with their boxes."""
    flat = stored(emb.reduce_pca(vectors(spark, d), "vec_id", "embedding", 2), "pca")
    return emb.cluster_ranks(emb.kmeans(flat, "vec_id", ["x", "y"], 4), ["x", "y"])


@query("WITH p AS (SELECT range AS position FROM range((SELECT count(*) FROM designs) // 8 * 8 * 2 * 3)) SELECT position, position // 48 * 8 + position % 24 // 3 AS index FROM p")
def t9_repeat_order(spark: SparkSession, d: str) -> DataFrame:
    """Positions of a repeat sampler over designs: batches of 8, twice, each index three times."""
    return sampling.repeat_order(table(spark, d, "designs").count(), 8, 2, 3, spark)


@query()
def t6_sample(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of tokens."""
    return sampling.sample(vocab.token_counts(table(spark, d, "token_dataset"), "target_tokens"), "token", 100, 7)


@query(
    """
SELECT split, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER () <= ceil((SELECT count(*) FROM net_seqs) * 0.1) THEN 'test' ELSE 'train' END AS split FROM net_seqs) GROUP BY split"""
)
def t7_split_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of a seeded split; which rows it takes is its own."""
    return sampling.train_test(table(spark, d, "net_seqs").select("net_id"), "net_id", 0.1, 42).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT chunk, count(*) AS n, min(net_id) AS first, max(net_id) AS last FROM (SELECT net_id, (row_number() OVER (ORDER BY net_id) - 1) // ((SELECT count(*) FROM net_seqs) // 7) AS chunk FROM net_seqs) WHERE chunk < 7 GROUP BY chunk")
def t12_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Equal runs of rows."""
    rows = sampling.chunks(table(spark, d, "net_seqs").select("net_id"), ["net_id"], 7)
    return rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("net_id").alias("first"), F.max("net_id").alias("last"))


def markers(words: DataFrame, *tokens: str) -> list[int]:
    """Ids of some markers."""
    of = {r.token: r.id for r in words.filter(F.col("token").isin(*tokens)).collect()}
    return [of[t] for t in tokens]


@query(
    IDS
    + """
SELECT sample_id, array_to_string(l[1:16], ' ') AS head, array_to_string(list_transform(l, lambda x: CASE WHEN x = (SELECT id FROM voc WHERE token = '<PAD>') THEN -100 ELSE x END), ' ') AS labels FROM e""".replace(
        "(SELECT id FROM voc WHERE token = '<PAD>')", "p"
    ).replace("FROM e", "FROM e, (SELECT id AS p FROM voc WHERE token = '<PAD>')")
)
def t14_truncated(spark: SparkSession, d: str) -> DataFrame:
    """Target ids cut to a length, and labels with padding masked."""
    ids, words = encoded(spark, d)
    (pad,) = markers(words, "<PAD>")
    text = lambda c: F.array_join(c.cast("array<string>"), " ")
    rows = ids.filter("size(ids) > 0")
    return rows.select("sample_id", text(sampling.truncate(F.col("ids"), 16)).alias("head"), text(sampling.mask_padding(F.col("ids"), pad)).alias("labels"))


@query(
    IDS
    + """,
  k AS (SELECT id FROM voc WHERE token IN ('<PUSH>', '<POP>')),
  r AS (SELECT sample_id, id AS v, i, id IN (SELECT id FROM k) AS kept FROM v),
  s AS (SELECT *, sum((NOT kept)::INT) OVER (PARTITION BY sample_id ORDER BY i DESC) AS back, sum(kept::INT) OVER (PARTITION BY sample_id) AS n_kept FROM r)
SELECT sample_id, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY i) AS ids FROM s WHERE n_kept <= 20 AND (kept OR back <= 20 - n_kept) GROUP BY sample_id"""
)
def t13_protected(spark: SparkSession, d: str) -> DataFrame:
    """Target ids cut to 20, those of branch markers kept."""
    ids, words = encoded(spark, d)
    cut = ids.select("sample_id", sampling.truncate_protected(F.col("ids"), 20, markers(words, "<PUSH>", "<POP>")).alias("ids")).filter("size(ids) > 0")
    return cut.select("sample_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))
