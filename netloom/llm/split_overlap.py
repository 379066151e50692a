"""Records of evaluation splits that reappear in training, exactly or almost, by a segment join on sorted point sequences.

A point set in hash order is a string without repeats, and the number of points in only one of two sets is the number of
insertions and deletions between their strings. So "similarity >= 0.8" is "at most ``k = floor((a + b) / 9)`` edits", and an
edit-distance join answers it exactly:

1. An evaluation string of length ``a`` may meet at most ``floor(a / 4)`` edits. It is cut into one segment more, so one
   segment is untouched in every near training string. Segments have three or four elements; the first three (two in the one
   case of a segment of two, ``a = 8``) are the key, so that a training string needs its substrings of one length only.
2. A training string offers its substrings of that length; they match where the position moved by at most ``k``.
3. Matches are verified by dynamic programming over a band of ``k`` around the diagonal, many pairs at once.

Copies of a set or of a term sequence are one representative until the result asks for ids. Nothing is capped; keys shared by
many records meet in a join that the engine splits where it is skewed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.pointsets import MIN_POINTS, budget, point_hashes
from netloom.session import stored

MIN_TERMS = 20
CELLS = 1 << 20


def edits_within(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether strings i of both sides are at most ``k[i]`` insertions and deletions apart.

    ``a`` and ``b`` are concatenated strings with offsets. The table is kept for a band of ``k`` around the diagonal, row by
    row for all pairs of similar size, of at most ``CELLS`` cells or of a single pair. A pair is given up as soon as its whole row exceeds
    ``k``, so only strings that are near cost their length times the band.
    """
    na, nb = np.diff(a_at), np.diff(b_at)
    good = np.zeros(len(k), dtype=bool)
    todo = np.flatnonzero(np.abs(na - nb) <= k)
    todo = todo[np.lexsort((k[todo], na[todo]))]
    lo = 0
    while lo < len(todo):
        # pairs up to a quarter longer than the shortest, as many as keep the band small
        hi = int(np.searchsorted(na[todo], na[todo[lo]] * 5 // 4 + 4, side="right"))
        band = int(k[todo[lo:hi]].max())
        hi = min(hi, lo + max(1, CELLS // (2 * band + 1)))
        part = todo[lo:hi]
        good[part] = _band(a, a_at, b, b_at, na, nb, k, part, int(k[part].max()))
        lo = hi
    return good


def _band(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, na: np.ndarray, nb: np.ndarray, k: np.ndarray, part: np.ndarray, w: int) -> np.ndarray:
    far = np.int32(1 << 29)
    offset = np.arange(-w, w + 1, dtype=np.int32)
    good = np.zeros(len(part), dtype=bool)
    # pairs still in the table
    live = np.arange(len(part))
    # row 0: j insertions
    now = np.where((offset >= 0) & (offset <= nb[part][:, None]), offset, far).astype(np.int32)
    i = 0
    while len(live):
        at = part[live]
        rows, ends, most = na[at], nb[at], k[at]
        i += 1
        j = i + offset
        inside = (j >= 1) & (j <= ends[:, None])
        left = b[np.where(inside, b_at[at][:, None] + j - 1, 0)]
        step = np.where(inside & (left == a[a_at[at] + i - 1][:, None]), now, far)
        step[:, :-1] = np.minimum(step[:, :-1], now[:, 1:] + 1)
        if i <= w:
            step[:, w - i] = np.minimum(step[:, w - i], i)
        step[(j < 0) | (j > ends[:, None])] = far
        now = np.minimum.accumulate(step - offset, axis=1) + offset
        last = np.flatnonzero(rows == i)
        good[live[last]] = now[last, (ends - rows + w)[last].astype(np.int64)] <= most[last]
        stay = (rows > i) & (now.min(axis=1) <= most)
        live, now = live[stay], now[stay]
    return good


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pts = [batch.column(batch.schema.get_field_index(c)) for c in ("pe", "pt")]
        at = [x.offsets.to_numpy() for x in pts]
        values = [x.values.to_numpy() for x in pts]
        k = (np.diff(at[0]) + np.diff(at[1])) // 9
        good = pa.array(edits_within(values[0], at[0], values[1], at[1], k))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["e", "t"])


def segment_keys(reps: DataFrame) -> DataFrame:
    """``e``, ``n``, ``start`` and ``key`` of the segments of evaluation strings."""
    m = "(n div 4 + 1)"
    start = f"i * (n div {m}) + greatest(0, i - ({m} - n % {m}))"
    return reps.selectExpr("sid as e", "n as ne", f"explode(transform(sequence(0, n div 4), i -> struct(int({start}) as start, {_key('pts', start, f'if(n div {m} < 3 and i < {m} - n % {m}, 2, 3)')} as key))) as s").select("e", "ne", "s.start", "s.key")


def _key(pts: str, at: str, size: str) -> str:
    return f"if({size} = 2, xxhash64({pts}[int({at})], {pts}[int({at}) + 1]), xxhash64({pts}[int({at})], {pts}[int({at}) + 1], {pts}[int({at}) + 2]))"


def substring_keys(reps: DataFrame) -> DataFrame:
    """``t``, ``n``, ``at`` and ``key`` of the substrings of training strings that segments can match.

    Only ``a = 8`` has a segment of two, at its start; a near string then has at most 10 points and two edits.
    """
    three = "transform(sequence(0, n - 3), p -> struct(int(p) as at, xxhash64(pts[p], pts[p + 1], pts[p + 2]) as key))"
    two = "transform(sequence(0, 2), p -> struct(int(p) as at, xxhash64(pts[p], pts[p + 1]) as key))"
    return reps.selectExpr("sid as t", "n as nt", f"explode(if(n <= 10, concat({three}, {two}), {three})) as s").select("t", "nt", "s.at", "s.key")


def near_links(reps: DataFrame) -> DataFrame:
    """All near pairs ``e``, ``t`` of evaluation and training representatives."""
    evaluation, training = reps.filter("held_out"), reps.filter("not held_out")
    k = budget(F.col("ne"), F.col("nt"))
    matched = (
        substring_keys(training)
        .join(segment_keys(evaluation), "key")
        .filter((F.abs(F.col("ne") - F.col("nt")) <= k) & (F.abs(F.col("start") - F.col("at")) <= k))
        .select("e", "t")
        .distinct()
    )
    one = evaluation.select(F.col("sid").alias("e"), F.col("pts").alias("pe"))
    two = training.select(F.col("sid").alias("t"), F.col("pts").alias("pt"))
    return matched.join(one, "e").join(two, "t").select("e", "t", "pe", "pt").mapInArrow(_verify, "e bigint, t bigint")


def terms(text: str) -> str:
    """Array of the terms of a text: longest runs without space, tab and line feed."""
    return f"filter(split({text}, '[ \\t\\n]'), t -> t <> '')"


def overlaps(
    df: DataFrame, key: str = "sample_id", split: str = "split", tree: str = "tree_seq", tokens: str = "target_tokens",
    train: tuple[str, ...] = ("train",), held_out: tuple[str, ...] = ("validation", "test"),
) -> DataFrame:
    """Distinct pairs ``held_out_id``, ``train_id`` whose point sets are near or whose terms are the same, at least 20, in order.

    Rows of other or null splits take no part, nor do rows with too few points and terms; null and empty trees and tokens
    have none. Sets and term sequences are compared by 128-bit hashes.
    """
    name = F.expr(terms("tokens"))
    picked = (
        df.select(F.col(key).cast("long").alias("id"), F.col(split).alias("split"), F.col(tree).alias("tree"), F.col(tokens).alias("tokens"))
        .filter(F.col("id").isNotNull() & F.col("split").isin(*train, *held_out))
        .select("id", F.col("split").isin(*held_out).alias("held_out"), F.coalesce(point_hashes("tree"), F.expr("array(0L, 0L)")).alias("pts"), name.alias("terms"))
        .withColumns({"n": F.size("pts"), "long": F.coalesce(F.size("terms") >= MIN_TERMS, F.lit(False))})
        .filter((F.col("n") >= MIN_POINTS) | F.col("long"))
        .select("id", "held_out", F.when(F.col("n") >= MIN_POINTS, F.col("pts")).alias("pts"), "n",
                F.xxhash64("pts").alias("k1"), F.xxhash64("pts", F.lit(1)).alias("k2"),
                F.when(F.col("long"), F.xxhash64("terms")).alias("t1"), F.when(F.col("long"), F.xxhash64("terms", F.lit(1))).alias("t2"))
    )
    rows = stored(picked, "overlap-rows")
    sets = rows.filter(F.col("pts").isNotNull())
    reps = stored(sets.groupBy("held_out", "pts", "n", "k1", "k2").agg(F.min("id").alias("sid")), "overlap-sets")
    names = reps.select("sid", "k1", "k2")
    links = (
        near_links(reps)
        .join(names.select(F.col("sid").alias("e"), F.col("k1").alias("e1"), F.col("k2").alias("e2")), "e")
        .join(names.select(F.col("sid").alias("t"), F.col("k1").alias("s1"), F.col("k2").alias("s2")), "t")
        .select("e1", "e2", "s1", "s2")
    )
    held, trained = sets.filter("held_out"), sets.filter("not held_out")
    near = links.join(held.select(F.col("k1").alias("e1"), F.col("k2").alias("e2"), F.col("id").alias("held_out_id")), ["e1", "e2"]).join(
        trained.select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), F.col("id").alias("train_id")), ["s1", "s2"]
    )
    spoken = rows.filter(F.col("t1").isNotNull())
    same = (
        spoken.filter("held_out").select("t1", "t2", F.col("id").alias("held_out_id"))
        .join(spoken.filter("not held_out").select("t1", "t2", F.col("id").alias("train_id")), ["t1", "t2"])
    )
    return near.select("held_out_id", "train_id").unionByName(same.select("held_out_id", "train_id")).distinct()


def report(
    df: DataFrame, key: str = "sample_id", split: str = "split", design: str = "source_design", held_out: tuple[str, ...] = ("validation", "test"), **names: str | tuple[str, ...]
) -> DataFrame:
    """Per split and design of the held-out rows: rows, rows that reappear in training, and pairs.

    A null design is a group of its own. ``names`` go to :func:`overlaps`.
    """
    found = overlaps(df, key, split, held_out=held_out, **names).groupBy("held_out_id").agg(F.count(F.lit(1)).alias("pairs"))
    rows = df.select(F.col(key).cast("long").alias("held_out_id"), F.col(split).alias("split"), F.col(design).alias("source_design"))
    return (
        rows.filter(F.col("split").isin(*held_out))
        .join(found, "held_out_id", "left")
        .groupBy("split", "source_design")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count("pairs").alias("n_overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"))
    )
