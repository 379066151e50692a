"""BLEU and ROUGE of token texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from netloom.functions.tokens import split_words, strip
from netloom.operators.arrow import map_batches
from netloom.operators.forest import flat, mix

EPSILON = 0.1


def gram_overlap(a: np.ndarray, a_row: np.ndarray, b: np.ndarray, b_row: np.ndarray, rows: int) -> np.ndarray:
    """Number by row of elements two multisets share."""
    ka, ia, na = np.unique(mix(a_row, a), return_index=True, return_counts=True)
    kb, nb = np.unique(mix(b_row, b), return_counts=True)
    at = np.minimum(np.searchsorted(kb, ka), max(len(kb) - 1, 0))
    both = (kb[at] == ka) if len(kb) else np.zeros(len(ka), dtype=bool)
    shared = np.minimum(na[both], nb[at[both]])
    return np.bincount(a_row[ia[both]], weights=shared, minlength=rows).astype(np.int64)


def grams(name: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and rows of the runs of n tokens."""
    if len(name) < n:
        return name[:0], row[:0]
    m = len(name) - n + 1
    ok = row[:m] == row[n - 1 :]
    return mix(*[name[i : m + i] for i in range(n)])[ok], row[:m][ok]


def longest_common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit vectors over ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    free = full
    for x in b:
        hit = free & where.get(x, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def f_measure(shared: np.ndarray, wanted: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Harmonic mean of recall and precision, which is 2 * shared / (wanted + given)."""
    return np.where(shared > 0, 2.0 * shared / np.maximum(wanted + given, 1), 0.0)


def text_metrics(df: DataFrame, key: str, target: str, prediction: str) -> DataFrame:
    """``key``, ``rouge1_f, rouge2_f, rougel_f, bleu_1, bleu_2, bleu_4, exact_match`` of two token texts, or of two arrays of
    tokens or ids, as a tokenizer gives them.

    Tokens of a text stand between white space. BLEU is the clipped precision of runs up to 4 tokens with the brevity penalty; a precision
    without a match counts as 0.1 over the number of runs, but without a single common token BLEU is 0. Null counts as empty; an
    empty side gives 0. ``exact_match`` compares the texts without outer white space.
    """
    if isinstance(df.schema[target].dataType, ArrayType):
        t, p = (F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")) for c in (target, prediction))
        same = t == p
    else:
        t, p = split_words(F.col(target)), split_words(F.col(prediction))
        same = strip(F.coalesce(F.col(target), F.lit(""))) == strip(F.coalesce(F.col(prediction), F.lit("")))
    rows = df.select(F.col(key).alias("k"), t.alias("t"), p.alias("p"), same.cast("double").alias("exact_match"))

    def run(target_: pa.Array, given_: pa.Array, exact: pa.Array) -> list:
        (tv, to), (gv, go) = flat(target_), flat(given_)
        n = len(to) - 1
        code = pa.concat_arrays([tv.cast(pa.string()), gv.cast(pa.string())]).dictionary_encode().indices.to_numpy().astype(np.int64)
        t, g = code[: len(tv)], code[len(tv) :]
        tr, gr = (np.repeat(np.arange(n), np.diff(o)) for o in (to, go))
        tn, gn = np.diff(to), np.diff(go)
        filled = (tn > 0) & (gn > 0)
        shared, logs = [], []
        for size in range(1, 5):
            a, b = grams(t, tr, size), grams(g, gr, size)
            both = gram_overlap(*a, *b, n)
            shared.append(both)
            runs = np.maximum(gn - size + 1, 1)
            logs.append(np.log(np.where(both > 0, both, EPSILON) / runs))
        short = np.where(gn > tn, 0.0, 1.0 - tn / np.maximum(gn, 1))
        live = filled & (shared[0] > 0)
        bleu = lambda m: np.where(live, np.exp(short + sum(logs[:m]) / m), 0.0)
        common = np.zeros(n, dtype=np.int64)
        tl, gl = t.tolist(), g.tolist()
        for r in np.flatnonzero(filled):
            x, y = tl[to[r] : to[r + 1]], gl[go[r] : go[r + 1]]
            common[r] = len(x) if x == y else longest_common(x, y)
        return [
            f_measure(shared[0], tn, gn), f_measure(shared[1], np.maximum(tn - 1, 0), np.maximum(gn - 1, 0)), f_measure(common, tn, gn),
            bleu(1), bleu(2), bleu(4), pc.cast(exact, pa.float64()),
        ]

    fields = "rouge1_f double, rouge2_f double, rougel_f double, bleu_1 double, bleu_2 double, bleu_4 double, exact_match double"
    return map_batches(rows, ["t", "p", "exact_match"], fields, run, ["k"]).withColumnRenamed("k", key)
