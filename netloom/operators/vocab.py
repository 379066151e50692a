"""Vocabularies, token counts and their statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.tokens import CORE, special_tokens, split_words
from netloom.operators.arrow import map_batches
from netloom.operators.forest import flat
from netloom.operators.ranking import ordered

#: Entries of a vocabulary that is sent to every worker: some 50 MB.
BROADCAST_WORDS = 1 << 20


def token_counts(df: DataFrame, *texts: str, by: Sequence[str] = ()) -> DataFrame:
    """``token`` and ``count`` over the words of some text columns together; null and blank texts have none."""
    words = F.explode(F.concat(*[split_words(F.col(t)) for t in texts]))
    return df.select(*by, words.alias("token")).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("count"))


def word_vocabulary(df: DataFrame, *texts: str, specials: Sequence[str] | None = None) -> DataFrame:
    """``token`` and ``id``: the distinct words but markers in binary order from 0, then the markers in their own order."""
    marks = list(special_tokens() if specials is None else specials)
    words = token_counts(df, *texts).filter(~F.col("token").isin(*marks)).select("token")
    ids = ordered(words, ["token"]).select("token", (F.col("rank") - 1).alias("id"))
    size = ids.count()
    tail = df.sparkSession.createDataFrame([(m, size + i) for i, m in enumerate(marks)], "token string, id bigint")
    return ids.unionByName(tail)


def encode_words(df: DataFrame, key: str, text: str, vocabulary: DataFrame, unknown: str = CORE["UNK"], most: int = BROADCAST_WORDS) -> DataFrame:
    """``key`` and ``ids``, the ids of the words of a text in order; words outside the vocabulary have the unknown marker's id. Blank
    and null texts have an empty list.

    A vocabulary of at most ``most`` entries, which are counted, goes to every worker once and is looked up by whole batches, without a
    shuffle. A larger one is joined on the word; keys must be unique then.
    """
    other = vocabulary.filter(F.col("token") == unknown).select("id").scalar()
    words = df.select(F.col(key).alias("k"), split_words(F.col(text)).alias("w"))
    known = vocabulary.select("token", F.col("id").cast("bigint").alias("id")).limit(most + 1).toArrow()
    if known.num_rows <= most:
        unknown_id = vocabulary.filter(F.col("token") == unknown).agg(F.max("id")).first()[0]
        held = df.sparkSession.sparkContext.broadcast((known["token"].combine_chunks(), known["id"].to_numpy()))

        def run(lists: pa.Array) -> list:
            tokens, ids = held.value
            values, offsets = flat(lists)
            at = pc.index_in(values.cast(pa.string()), value_set=tokens.cast(pa.string()))
            found = at.is_valid().to_numpy(zero_copy_only=False)
            if not len(ids):
                out = pa.array([unknown_id] * len(values), pa.int64())
            else:
                out = pa.array(np.where(found, ids[pc.fill_null(at, 0).to_numpy(zero_copy_only=False)], -1 if unknown_id is None else unknown_id), pa.int64(), mask=~found if unknown_id is None else None)
            return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), out)]

        return map_batches(words, ["w"], "ids array<bigint>", run, ["k"]).withColumnRenamed("k", key)
    found = words.select("k", F.posexplode("w").alias("at", "token")).join(vocabulary, "token", "left").select("k", "at", F.coalesce("id", other).alias("id"))
    lists = found.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("s")).select("k", F.col("s.id").alias("ids"))
    return df.select(F.col(key).alias("k")).join(lists, "k", "left").select(F.col("k").alias(key), F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))


def ranked_frequencies(counts: DataFrame) -> DataFrame:
    """``rank``, ``token``, ``count`` and ``cum_percent``: the tokens by descending count, ties by token, with the share up to each."""
    placed = ordered(counts.select("token", "count"), ["-count", "token"], ["count"])
    total = counts.agg(F.sum("count")).scalar()
    return placed.select("rank", "token", "count", (F.col("cum_count") * 100.0 / total).alias("cum_percent"))


def length_statistics(df: DataFrame, length: Column, by: Sequence[str] = (), positive: bool = False) -> DataFrame:
    """Number, least, largest and mean length, and the median and 0.85, 0.90, 0.95 quantiles with linear interpolation. With ``positive`` zeros are left out."""
    rows = df.select(*by, length.alias("n"))
    rows = rows.filter("n > 0") if positive else rows.filter("n is not null")
    q = F.percentile("n", F.array(*[F.lit(p) for p in (0.5, 0.85, 0.9, 0.95)]))
    out = rows.groupBy(*by).agg(
        F.count("n").alias("n_rows"), F.min("n").alias("min_length"), F.max("n").alias("max_length"), F.avg("n").alias("mean_length"), q.alias("q")
    )
    return out.select(*by, "n_rows", "min_length", "max_length", "mean_length", *[F.col("q")[i].alias(f"q{p}") for i, p in enumerate((50, 85, 90, 95))])


def utilisation(vocabulary: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: size of the vocabulary, used and unused entries, and the percentage used."""
    used = vocabulary.join(counts.filter(F.col("count") > 0), "token", "left_semi")
    row = vocabulary.agg(F.count(F.lit(1)).alias("vocab_size")).withColumn("n_used", used.agg(F.count(F.lit(1))).scalar())
    return row.select("vocab_size", "n_used", (F.col("vocab_size") - F.col("n_used")).alias("n_unused"), (F.col("n_used") * 100.0 / F.nullif("vocab_size", F.lit(0))).alias("utilisation"))


def distribution(counts: DataFrame) -> DataFrame:
    """One row of measures of token counts: entropy in bits, Gini coefficient, mean, population deviation, median, least and largest.

    Gini: sum of ``(2 i - n - 1) c_i`` over ``n * total``, counts ascending.
    """
    per = counts.groupBy("count").agg(F.count(F.lit(1)).alias("times"))
    # equal counts share their middle position, so only distinct counts are ranked
    placed = ordered(per.select("count", "times"), ["count"], ["times"])
    c, t = F.col("count").cast("double"), F.col("times").cast("double")
    total = counts.agg(F.sum("count").cast("double")).scalar()
    n = counts.agg(F.count(F.lit(1)).cast("double")).scalar()
    middle = F.col("cum_times") - (t - 1) / 2
    sums = placed.agg(
        F.sum(-t * (c / total) * F.log2(c / total)).alias("entropy"), (F.sum(t * (2 * middle - n - 1) * c) / F.max(n * total)).alias("gini")
    )
    plain = counts.agg(
        F.count(F.lit(1)).alias("n_tokens"), F.sum("count").alias("total"), F.avg("count").alias("mean_frequency"), F.stddev_pop("count").alias("std_frequency"),
        F.percentile("count", F.lit(0.5)).alias("median_frequency"), F.min("count").alias("min_frequency"), F.max("count").alias("max_frequency"),
    )
    return plain.join(sums, F.lit(True))


#: Classes of tokens by the first of these patterns that a token holds.
RELEVANCE = [("direction", "[UDLRTB]"), ("number", "[0-9]+"), ("tree", "PUSH|POP|BRANCH|END"), ("pin", "DRIVER|LOAD"), ("special", "SRC_END|BOS|EOS")]


def relevance(token: Column) -> Column:
    """The class of a token; ``none`` without a match."""
    out = F.lit("none")
    for name, pattern in reversed(RELEVANCE):
        out = F.when(token.rlike(pattern), name).otherwise(out)
    return out


def vocabulary_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: shared, only in the first, only in the second, and the Jaccard percentage of two sets of tokens."""
    one, two = a.select("token").distinct().withColumn("a", F.lit(1)), b.select("token").distinct().withColumn("b", F.lit(1))
    both = one.join(two, "token", "full").agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_shared"), F.count_if(F.col("b").isNull()).alias("n_only_a"), F.count_if(F.col("a").isNull()).alias("n_only_b")
    )
    total = F.nullif(F.col("n_shared") + F.col("n_only_a") + F.col("n_only_b"), F.lit(0))
    return both.withColumn("jaccard_percent", F.col("n_shared") * 100.0 / total)
