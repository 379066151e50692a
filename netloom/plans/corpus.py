"""Queries over vocabularies, token statistics and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.tokens import group_label, special_tokens, split_words
from netloom.operators import reports, vocab
from netloom.operators.ranking import ordered
from netloom.plans.registry import query
from netloom.session import stored, table


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '\\s+'), lambda t: t <> '')"


SOURCE, TARGET = _words("source_tokens"), _words("target_tokens")
COUNTED = f"""
  wrd AS (SELECT unnest({TARGET}) AS token FROM token_dataset), cnt AS (SELECT token, count(*) AS count FROM wrd GROUP BY token)"""
BOTH = f"""
  wrd AS (SELECT unnest({SOURCE} || {TARGET}) AS token FROM token_dataset), cnt AS (SELECT token, count(*) AS count FROM wrd GROUP BY token)"""
SPECIAL = ", ".join(f"('{t}', {i})" for i, t in enumerate(special_tokens()))
VOCAB = f"""
  mrk AS (SELECT * FROM (VALUES {SPECIAL}) AS t(token, place)),
  wds AS (SELECT token, row_number() OVER (ORDER BY token COLLATE "binary") - 1 AS id FROM cnt WHERE token NOT IN (SELECT token FROM mrk)),
  voc AS (SELECT token, id FROM wds UNION ALL SELECT token, (SELECT count(*) FROM wds) + place FROM mrk)""".replace(' COLLATE "binary"', "")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "token_dataset")


@query(f"WITH {COUNTED} SELECT row_number() OVER (ORDER BY count DESC, token) AS rank, token, count, sum(count) OVER (ORDER BY count DESC, token) * 100.0 / sum(count) OVER () AS cum_percent FROM cnt")
def w1_symbol_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Target tokens by frequency, with the share up to each."""
    return vocab.ranked_frequencies(vocab.token_counts(tokens(spark, d), "target_tokens"))


@query(f"WITH {BOTH} SELECT * FROM cnt")
def a7_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of sources and targets together."""
    return vocab.token_counts(tokens(spark, d), "source_tokens", "target_tokens")


@query(f"WITH {COUNTED} SELECT token, count FROM cnt WHERE NOT regexp_matches(token, '[<>]') ORDER BY count DESC, token LIMIT 10")
def t4_top_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent tokens that are no markers."""
    counts = vocab.token_counts(tokens(spark, d), "target_tokens").filter(~F.col("token").rlike("[<>]"))
    return counts.orderBy(F.desc("count"), "token").limit(10)


STATS = "count(n) AS n_rows, min(n) AS min_length, max(n) AS max_length, avg(n) AS mean_length, " + ", ".join(f"quantile_cont(n, {p / 100}) AS q{p}" for p in (50, 85, 90, 95))


@query(f"WITH l AS (SELECT split, len({TARGET}) AS n FROM token_dataset) SELECT split, {STATS} FROM l WHERE n > 0 GROUP BY split")
def a4_target_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of targets by split, empty ones left out."""
    return vocab.length_statistics(tokens(spark, d), F.size(split_words(F.col("target_tokens"))), ["split"], positive=True)


@query(f"SELECT {STATS} FROM (SELECT len({SOURCE}) AS n FROM token_dataset)")
def a5_source_lengths(spark: SparkSession, d: str) -> DataFrame:
    """A5: lengths of sources, empty ones kept."""
    return vocab.length_statistics(tokens(spark, d), F.size(split_words(F.col("source_tokens"))))


@query("SELECT source, count(text) AS n_rows, min(length(text)) AS min_length, max(length(text)) AS max_length, avg(length(text)) AS mean_length FROM documents GROUP BY source")
def a23_text_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of texts by source; a null text does not count."""
    n = F.length("text")
    return table(spark, d, "documents").groupBy("source").agg(F.count("text").alias("n_rows"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(n).alias("mean_length"))


@query(f"WITH {BOTH} SELECT count(*) AS n_distinct, CAST(sum(count) AS BIGINT) AS n_tokens, CAST(sum(count) AS DOUBLE) / (SELECT count(*) FROM token_dataset) AS per_sequence FROM cnt")
def a9_token_totals(spark: SparkSession, d: str) -> DataFrame:
    """Distinct and all tokens, and tokens a sequence."""
    rows = tokens(spark, d)
    counts = vocab.token_counts(rows, "source_tokens", "target_tokens")
    n = rows.agg(F.count(F.lit(1))).scalar()
    return counts.agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("count").alias("n_tokens")).withColumn("per_sequence", F.col("n_tokens") / n)


@query(f"WITH {BOTH}, {VOCAB} SELECT token, id FROM voc")
def k1_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """K1: word-level vocabulary, markers last."""
    return vocab.word_vocabulary(tokens(spark, d), "source_tokens", "target_tokens")


#: The ids of each sample's target, as a list and as text.
IDS = f"""
WITH {COUNTED.replace("token_dataset", "(SELECT * FROM token_dataset WHERE split = 'train')")}, {VOCAB},
  w AS (SELECT sample_id, unnest(list_transform({TARGET}, lambda t, i: {{'t': t, 'i': i}})) AS x FROM token_dataset),
  v AS (SELECT sample_id, x.i AS i, coalesce(v.id, (SELECT id FROM voc WHERE token = '<UNK_LEN>')) AS id FROM w LEFT JOIN voc v ON v.token = x.t),
  e AS (SELECT sample_id, list(id ORDER BY i) AS l, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY i) AS ids FROM v GROUP BY sample_id)"""


@query(
    IDS
    + """
SELECT s.sample_id, coalesce(e.ids, '') AS ids FROM token_dataset s LEFT JOIN e ON e.sample_id = s.sample_id"""
)
def k5_encoded(spark: SparkSession, d: str) -> DataFrame:
    """Targets as ids of a vocabulary of the training split, others as the unknown marker."""
    return encoded(spark, d)[0].select("sample_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


def encoded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Targets as ids, and the vocabulary."""
    rows = tokens(spark, d)
    words = stored(vocab.word_vocabulary(rows.filter("split = 'train'"), "target_tokens"), "vocabulary")
    return vocab.encode_words(rows, "sample_id", "target_tokens", words), words


@query(
    f"""
WITH {COUNTED}, {VOCAB.replace("wds AS (SELECT token, row_number()", "trn AS (SELECT DISTINCT unnest(" + TARGET + ") AS token FROM token_dataset WHERE split = 'train'), wds AS (SELECT token, row_number()").replace("FROM cnt WHERE", "FROM trn WHERE")},
  tst AS (SELECT DISTINCT unnest({TARGET}) AS token FROM token_dataset WHERE split = 'test')
SELECT count(*) AS vocab_size, count(t.token) AS n_used, count(*) - count(t.token) AS n_unused, count(t.token) * 100.0 / count(*) AS utilisation FROM voc v LEFT JOIN tst t ON t.token = v.token"""
)
def a8_utilisation(spark: SparkSession, d: str) -> DataFrame:
    """How much of a training vocabulary the test split uses."""
    rows = tokens(spark, d)
    words = stored(vocab.word_vocabulary(rows.filter("split = 'train'"), "target_tokens"), "vocabulary")
    return vocab.utilisation(words, vocab.token_counts(rows.filter("split = 'test'"), "target_tokens"))


@query(
    f"""
WITH {COUNTED}, p AS (SELECT *, count / sum(count) OVER () AS p, row_number() OVER (ORDER BY count, token) AS i FROM cnt)
SELECT count(*) AS n_tokens, CAST(sum(count) AS BIGINT) AS total, round(avg(count), 6) AS mean_frequency, round(stddev_pop(count), 6) AS std_frequency, quantile_cont(count, 0.5) AS median_frequency,
  min(count) AS min_frequency, max(count) AS max_frequency, round(-sum(p * log2(p)), 6) AS entropy, round(sum((2 * i - (SELECT count(*) FROM cnt) - 1) * count) / (count(*) * sum(count)), 6) AS gini FROM p"""
)
def a27_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Entropy, Gini and moments of token counts."""
    out = vocab.distribution(vocab.token_counts(tokens(spark, d), "target_tokens"))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_frequency", "std_frequency", "entropy", "gini")})


def _relevance() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(token, '{p}') THEN '{n}'" for n, p in vocab.RELEVANCE) + " ELSE 'none' END"


@query(f"WITH {BOTH} SELECT {_relevance()} AS class, count(*) AS n_tokens, CAST(sum(count) AS BIGINT) AS occurrences, count(*) / sum(count(*)) OVER () AS share FROM cnt GROUP BY 1")
def a26_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Classes of tokens."""
    counts = vocab.token_counts(tokens(spark, d), "source_tokens", "target_tokens")
    out = counts.groupBy(vocab.relevance(F.col("token")).alias("class")).agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("count").alias("occurrences"))
    total = counts.agg(F.count(F.lit(1))).scalar()
    return out.withColumn("share", F.col("n_tokens") / total)


@query(
    f"""
WITH {COUNTED}, g AS (SELECT count, CASE WHEN regexp_matches(token, '^[UDLRTB]') THEN token[1:1] || '*' ELSE 'SPECIAL' END AS six,
    CASE WHEN token[1:1] IN ('U', 'D') THEN 'U-D' WHEN token[1:1] IN ('L', 'R') THEN 'L-R' WHEN token[1:1] IN ('T', 'B') THEN 'T-B' ELSE 'SPECIAL' END AS four FROM cnt)
SELECT six, four, count(*) AS n_tokens, CAST(sum(count) AS BIGINT) AS occurrences FROM g GROUP BY six, four"""
)
def f37_groups(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by the groups of their direction."""
    counts = vocab.token_counts(tokens(spark, d), "target_tokens")
    t = F.col("token")
    return counts.groupBy(group_label(t).alias("six"), group_label(t, six=False).alias("four")).agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("count").alias("occurrences"))


def _split(name: str) -> str:
    return f"(SELECT DISTINCT unnest({TARGET}) AS token FROM token_dataset WHERE split = '{name}')"


@query(
    f"""
WITH a AS {_split('train')}, b AS {_split('test')}, j AS (SELECT a.token AS x, b.token AS y FROM a FULL JOIN b ON a.token = b.token)
SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_shared, count(*) FILTER (y IS NULL) AS n_only_a, count(*) FILTER (x IS NULL) AS n_only_b,
  count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) * 100.0 / count(*) AS jaccard_percent FROM j"""
)
def a28_vocabulary_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that the training and test splits share."""
    part = lambda s: vocab.token_counts(tokens(spark, d).filter(F.col("split") == s), "target_tokens")
    return vocab.vocabulary_overlap(part("train"), part("test"))


@query(
    f"""
SELECT split, CAST(sum(length(target_tokens)) AS BIGINT) AS n_chars, CAST(sum(len({TARGET})) AS BIGINT) AS n_tokens, CAST(sum(len({TARGET})) AS DOUBLE) / nullif(sum(length(target_tokens)), 0) AS density
FROM token_dataset GROUP BY split"""
)
def a25_compression(spark: SparkSession, d: str) -> DataFrame:
    """Tokens a character by split."""
    out = tokens(spark, d).groupBy("split").agg(F.sum(F.length("target_tokens")).alias("n_chars"), F.sum(F.size(split_words(F.col("target_tokens"))).cast("long")).alias("n_tokens"))
    return out.withColumn("density", F.try_divide(F.col("n_tokens"), F.col("n_chars")))


CURVES = f"""
WITH w AS (SELECT split, unnest({TARGET}) AS token FROM token_dataset WHERE split IS NOT NULL), c AS (SELECT split, token, count(*) AS count FROM w GROUP BY ALL),
  r AS (SELECT split, count, row_number() OVER (PARTITION BY split ORDER BY count DESC, token) AS x FROM c),
  e AS (SELECT split, min(x) AS lo, max(x) AS hi FROM r GROUP BY split),
  g AS (SELECT split, s AS step, lo + (hi - lo) * s / 99.0 AS x FROM e, range(100) t(s)),
  b AS (SELECT g.split, g.step, g.x, least(CAST(floor(g.x + 1e-9) AS BIGINT), e.hi) AS x1 FROM g JOIN e ON e.split = g.split),
  i AS (SELECT b.split, b.step, b.x, log10(p.count) + coalesce((log10(q.count) - log10(p.count)) * (b.x - b.x1), 0) AS log_y FROM b JOIN r p ON p.split = b.split AND p.x = b.x1 LEFT JOIN r q ON q.split = b.split AND q.x = b.x1 + 1)"""


def curves(spark: SparkSession, d: str) -> DataFrame:
    """Frequency curves of three splits at a hundred steps of rank each."""
    counts = vocab.token_counts(tokens(spark, d).filter("split is not null"), "target_tokens", by=["split"])
    parts = None
    for split in ("train", "validation", "test"):
        one = ordered(counts.filter(F.col("split") == split), ["-count", "token"]).select("split", F.col("rank").alias("x"), "count")
        parts = one if parts is None else parts.unionByName(one)
    return reports.resampled(parts, "split", "x", "count")


@query(CURVES + " SELECT split, step, round(x, 6) AS x, round(log_y, 6) AS log_y FROM i")
def w2_resampled_curves(spark: SparkSession, d: str) -> DataFrame:
    """Frequency curves on a common grid."""
    return curves(spark, d).select("split", "step", F.round("x", 6).alias("x"), F.round("log_y", 6).alias("log_y"))


@query(CURVES + " SELECT step, round(pow(10, avg(log_y)), 4) AS mean, round(pow(10, avg(log_y) - stddev_pop(log_y)), 4) AS low, round(pow(10, avg(log_y) + stddev_pop(log_y)), 4) AS high FROM i GROUP BY step")
def a36_mean_band(spark: SparkSession, d: str) -> DataFrame:
    """Mean curve and band over splits."""
    return reports.geometric_band(curves(spark, d)).select("step", *[F.round(c, 4).alias(c) for c in ("mean", "low", "high")])


@query(
    f"""
WITH {COUNTED}, r AS (SELECT row_number() OVER (ORDER BY count DESC, token) - 1 AS i, sum(count) OVER (ORDER BY count DESC, token) * 100.0 / sum(count) OVER () AS x FROM cnt),
  e AS (SELECT min(x) AS lo, max(x) AS hi FROM r), t AS (SELECT lo + (hi - lo) * s / 4.0 AS target FROM e, range(5) g(s))
SELECT DISTINCT position FROM (SELECT target, arg_min(i, (abs(x - target), i)) AS position FROM t, r GROUP BY target)"""
)
def w3_markers(spark: SparkSession, d: str) -> DataFrame:
    """Ranks nearest to five equal steps of coverage."""
    ranks = w1_symbol_frequencies(spark, d).select((F.col("rank") - 1).alias("i"), F.col("cum_percent").alias("x"))
    return reports.marker_positions(ranks, "x", "i")


@query(
    """
SELECT source_design, 'net_seqs' AS data_type, count(*) AS count FROM net_seqs GROUP BY 1 UNION ALL SELECT source_design, 'design_graph', count(*) FROM design_graph GROUP BY 1
UNION ALL SELECT NULL, 'net_seqs', count(*) FROM net_seqs UNION ALL SELECT NULL, 'design_graph', count(*) FROM design_graph
UNION ALL SELECT NULL, NULL, (SELECT count(*) FROM net_seqs) + (SELECT count(*) FROM design_graph)"""
)
def s10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Rows by design and kind with totals."""
    from netloom.sources.store import statistics

    return statistics({k: table(spark, d, k) for k in ("net_seqs", "design_graph")})


@query("SELECT coalesce(split, '(none)') AS split, count(*) AS n_rows FROM token_dataset WHERE split = 'train' GROUP BY 1")
def s12_chosen_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the split that is chosen without a name."""
    from netloom.sources.store import choose_split

    return choose_split(tokens(spark, d)).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    f"""
SELECT net_id, len(tree_seq) AS n_elements, len(loads) AS n_loads FROM net_seqs WHERE len(tree_seq) <= 12 AND len(loads) = 2"""
)
def sel4_short_nets(spark: SparkSession, d: str) -> DataFrame:
    """Short nets of two loads."""
    sizes = table(spark, d, "net_seqs").filter("tree_seq is not null and loads is not null").select("net_id", F.size("tree_seq").cast("long").alias("n_elements"), F.size("loads").cast("long").alias("n_loads"))
    return sizes.filter("n_elements <= 12 and n_loads = 2")


@query(f"SELECT sample_id, len({TARGET}) AS n FROM token_dataset WHERE target_tokens IS NOT NULL AND len({TARGET}) <= 64")
def sel5_within_length(spark: SparkSession, d: str) -> DataFrame:
    """P5: targets of at most 64 words; nulls are dropped."""
    rows = tokens(spark, d).filter("target_tokens is not null").select("sample_id", F.size(split_words(F.col("target_tokens"))).cast("long").alias("n"))
    return rows.filter("n <= 64")
