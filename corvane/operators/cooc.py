"""Windowed co-occurrence and positive pointwise mutual information."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.company import company, starts_of
from corvane.session import checkpointed

#: Content words up to so many places apart co-occur; nearer pairs weigh more.
REACH = 5


def pair_weights(arrays: DataFrame, reach: int = REACH) -> DataFrame:
    """(a, b, w), a <= b: for content words d <= reach places apart w grows by reach + 1 - d; places count stopwords too.

    Words travel as numbers, pairs in sorted runs that are summed before they are shuffled and again by ranges of pairs.
    """
    found = company(arrays, reach)
    if found is None:
        return _pair_weights_of_names(arrays, reach)
    words, shared = found.lex.words, found.lex.names

    def named(keys: np.ndarray, weights: list[np.ndarray]) -> pa.Table:
        names = shared.value
        return pa.table({"a": names.take(pa.array(keys // words)).cast(pa.string()), "b": names.take(pa.array(keys % words)).cast(pa.string()), "w": pa.array(weights[0])})

    return found.pairs(False, named, "a string, b string, w bigint")


def _pair_weights_of_names(arrays: DataFrame, reach: int) -> DataFrame:
    """``pair_weights`` of any number of words.

    Pairs come from shifted copies of one array, so that the only shuffle is that of the sums.
    """
    size = F.size("tokens")

    def shifted(d: int):
        return F.transform(F.arrays_zip(F.slice("tokens", 1, F.greatest(size - d, F.lit(0))).alias("x"), F.slice("tokens", d + 1, F.greatest(size, F.lit(1))).alias("y")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(reach + 1 - d).alias("w")))

    pairs = arrays.select(F.explode(F.concat(*(shifted(d) for d in range(1, reach + 1)))).alias("p")).select("p.*").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    content = pairs.where(~T.is_stopword(F.col("x")) & ~T.is_stopword(F.col("y")))
    return content.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w"))


def marginals(pairs: DataFrame) -> DataFrame:
    """(token, m): the weight of all pairs with a token; a pair of a token with itself counts twice."""
    both = reduce(DataFrame.unionByName, (pairs.select(F.col(c).alias("token"), "w") for c in ("a", "b")))
    return both.groupBy("token").agg(F.sum("w").alias("m"))


def ppmi(pairs: DataFrame) -> DataFrame:
    """(a, b, w, ppmi) of the pairs whose ln(total * w / (m_a * m_b)) is positive. The pairs are written first, as they are read thrice."""
    pairs = checkpointed(pairs)
    m = marginals(pairs)
    total = pairs.agg(F.sum("w").alias("_total"))
    rows = pairs.join(m.select(F.col("token").alias("a"), F.col("m").alias("m_a")), "a").join(m.select(F.col("token").alias("b"), F.col("m").alias("m_b")), "b").crossJoin(F.broadcast(total))
    score = F.log(F.col("_total").cast("double") * F.col("w") / (F.col("m_a").cast("double") * F.col("m_b")))
    return rows.withColumn("ppmi", score).where(F.col("ppmi") > 0).select("a", "b", "w", "ppmi")


def neighbours(scored: DataFrame, k: int = 5) -> DataFrame:
    """(token, neighbour, rank, ppmi): the ``k`` best partners of each token, ties by name."""
    flipped = scored.where("a <> b").select(F.col("b").alias("token"), F.col("a").alias("neighbour"), "ppmi")
    both = scored.select(F.col("a").alias("token"), F.col("b").alias("neighbour"), "ppmi").unionByName(flipped)
    order = Window.partitionBy("token").orderBy(F.round("ppmi", 9).desc(), "neighbour")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("token", "neighbour", "rank", "ppmi")


def nearest(arrays: DataFrame, k: int = 5) -> DataFrame:
    """``neighbours`` of the PPMI of a corpus, ranked where the pairs are summed: of each range of pairs the ``k`` best of a word go on."""
    found = company(arrays)
    if found is None:
        return neighbours(ppmi(_pair_weights_of_names(arrays, REACH)), k)
    shared = found.lex.names

    def best(a: np.ndarray, b: np.ndarray, scores: list[np.ndarray]) -> pa.Table:
        starts, left = starts_of(a), np.rint(scores[0] * 1e9)
        row, chosen = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(a)))), []
        for _ in range(k if len(a) else 0):  # the first of the largest, in order of names, k times
            at = np.flatnonzero((left == np.maximum.reduceat(left, starts)[row]) & (left >= 0))
            at = at[starts_of(row[at])]
            chosen.append(at)
            left[at] = -1
        at, names = np.concatenate([np.zeros(0, np.int64), *chosen]), shared.value
        return pa.table({"token": names.take(pa.array(a[at])).cast(pa.string()), "neighbour": names.take(pa.array(b[at])).cast(pa.string()), "ppmi": pa.array(scores[0][at])})

    order = Window.partitionBy("token").orderBy(F.round("ppmi", 9).desc(), "neighbour")
    rows = found.scored(best, "token string, neighbour string, ppmi double").withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= k).select("token", "neighbour", "rank", "ppmi")


def merge_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pair weights of two disjoint corpora together; the same as of both at once."""
    return old.unionByName(new).groupBy("a", "b").agg(F.sum("w").alias("w"))
