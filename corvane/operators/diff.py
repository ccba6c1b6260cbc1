"""What changed between two states of a corpus: documents, words, their use and their company."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import cooc, corpus
from corvane.operators.company import company as counted
from corvane.operators.company import starts_of
from corvane.operators.lexicon import AFTER, BEFORE

#: Words in fewer documents than this say nothing about use.
LEAST_DF = 3


def document_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, change): added, removed or modified. Both: (doc_id, text) with unique ids."""
    a = before.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("x"))
    b = after.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("y"))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "modified")
    return a.join(b, "doc_id", "full").select("doc_id", change.alias("change")).where("change is not null")


def word_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(token, change): appeared or vanished. Both: (doc_id, tokens), read once each."""
    sides = [x.select(F.explode("tokens").alias("token")).distinct().withColumn("side", F.lit(s)) for x, s in ((before, 1), (after, 2))]
    held = sides[0].unionByName(sides[1]).groupBy("token").agg(F.sum("side").alias("held"))
    return held.where("held < 3").select("token", F.when(F.col("held") == 1, "vanished").otherwise("appeared").alias("change"))


def collocation_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(a, b, change): collocations born or dead."""
    sides = [corpus.collocations(x).select("a", "b", F.lit(s).alias("side")) for x, s in ((before, 1), (after, 2))]
    held = sides[0].unionByName(sides[1]).groupBy("a", "b").agg(F.sum("side").alias("held"))
    return held.where("held < 3").select("a", "b", F.when(F.col("held") == 1, "dead").otherwise("born").alias("change"))


def in_order(changes: DataFrame, key: str = "change", *by) -> DataFrame:
    """``changes`` with place, its number in the list of its kind: by ``by``, else by the other columns, as a report shows it."""
    order = by or [c for c in changes.columns if c != key]
    return changes.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def usage(before: DataFrame, after: DataFrame, least_df: int = LEAST_DF) -> DataFrame:
    """(token, df_before, df_after, ratio): (after - before) / the larger, for words of both states in ``least_df`` documents of one."""
    a = corpus.vocabulary(before).select("token", F.col("df").alias("df_before"))
    b = corpus.vocabulary(after).select("token", F.col("df").alias("df_after"))
    most = F.greatest("df_before", "df_after")
    rows = a.join(b, "token").where((most >= least_df) & (F.col("df_before") != F.col("df_after")))
    return rows.select("token", "df_before", "df_after", F.round((F.col("df_after") - F.col("df_before")) / most, 6).alias("ratio"))


def company(before: DataFrame, after: DataFrame, least_df: int = LEAST_DF) -> DataFrame:
    """``company_of`` two tables (doc_id, tokens)."""
    return company_of(before.select("doc_id", "tokens", F.lit(BEFORE).alias("side")).unionByName(after.select("doc_id", "tokens", F.lit(AFTER).alias("side"))), least_df)


def company_of(arrays: DataFrame, least_df: int = LEAST_DF) -> DataFrame:
    """(token, drift): 1 - cosine of a word's PPMI partners before and after; 0 exactly if they are equal, 1 if either has none.

    For words in ``least_df`` documents of both states. ``arrays``: (doc_id, tokens, side), side 1 before, 2 after, 3 for a document that
    is the same in both and so is read once.
    """
    found = counted(arrays, side="side")
    if found is None:
        return _company_by_joins(*(arrays.where(F.col("side").bitwiseAND(bit) > 0) for bit in (BEFORE, AFTER)), least_df)
    shared = arrays.sparkSession.sparkContext.broadcast((found.lex.df >= least_df).all(0))
    names = found.lex.names

    def sums(a: np.ndarray, b: np.ndarray, scores: list[np.ndarray]) -> pa.Table:
        some = shared.value[a]
        a, (x, y) = a[some], (s[some] for s in scores)
        starts = starts_of(a)
        add = lambda v: pa.array(np.add.reduceat(v, starts) if len(starts) else v)
        apart = np.maximum.reduceat(np.abs(x - y), starts) if len(starts) else x
        return pa.table({"token": names.value.take(pa.array(a[starts])).cast(pa.string()), "dot": add(x * y), "xx": add(x * x), "yy": add(y * y), "apart": pa.array(apart)})

    parts = found.scored(sums, "token string, dot double, xx double, yy double, apart double")
    return _drift(parts.groupBy("token").agg(*(F.sum(c).alias(c) for c in ("dot", "xx", "yy")), F.max("apart").alias("apart")))


def _drift(sums: DataFrame) -> DataFrame:
    drift = F.when(F.col("apart") == 0, 0.0).when((F.col("xx") == 0) | (F.col("yy") == 0), 1.0).otherwise(1 - F.col("dot") / F.sqrt(F.col("xx") * F.col("yy")))
    return sums.select("token", F.round(drift, 6).alias("drift"))


def _company_by_joins(before: DataFrame, after: DataFrame, least_df: int) -> DataFrame:
    """``company_of`` any number of words."""
    rows = None
    for name, arrays in (("x", before), ("y", after)):
        scored = cooc.ppmi(cooc.pair_weights(arrays.select("doc_id", "tokens")))
        both = scored.select(F.col("a").alias("token"), F.col("b").alias("other"), F.col("ppmi").alias(name)).unionByName(scored.where("a <> b").select(F.col("b").alias("token"), F.col("a").alias("other"), F.col("ppmi").alias(name)))
        df = corpus.vocabulary(arrays).where(F.col("df") >= least_df).select("token")
        both = both.join(df, "token", "left_semi")
        rows = both if rows is None else rows.join(both, ["token", "other"], "full")
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    sums = rows.groupBy("token").agg(F.sum(x * y).alias("dot"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.max(F.abs(x - y)).alias("apart"))
    words = [corpus.vocabulary(s).where(F.col("df") >= least_df).select("token") for s in (before, after)]
    sums = sums.join(words[0], "token", "left_semi").join(words[1], "token", "left_semi")
    return _drift(sums)


def grid_drift(before: DataFrame, after: DataFrame, changes: DataFrame) -> DataFrame:
    """(doc_id, modified, drift): 1 - cosine of a document's grids in both states. Grids: (doc_id, q, norm); changes of ``document_changes``."""
    a, b = before.alias("a"), after.alias("b")
    dot = F.aggregate(F.zip_with("a.q", "b.q", lambda x, y: x.cast("bigint") * y.cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    drift = F.when(F.col("a.q") == F.col("b.q"), 0.0).when((F.col("a.norm") == 0) | (F.col("b.norm") == 0), 1.0).otherwise(1 - dot / (F.col("a.norm") * F.col("b.norm")))
    rows = a.join(b, F.col("a.doc_id") == F.col("b.doc_id")).select(F.col("a.doc_id").alias("doc_id"), F.round(drift, 6).alias("drift"))
    modified = changes.where("change = 'modified'").select("doc_id", F.lit(True).alias("modified"))
    return rows.join(modified, "doc_id", "left").select("doc_id", F.coalesce("modified", F.lit(False)).alias("modified"), "drift")
