"""Versions of one document: similar dated documents are grouped, the newest stands for the group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.graph import components

#: Cosine from which two hits are versions of one document.
LEAST_COSINE = 0.55


def similar_pairs(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(qid, a, b) of the hits of one query whose vectors reach the cosine. ``vectors``: (qid, doc_id, q, norm), the top hits alone."""
    a, b = vectors.alias("a"), vectors.alias("b")
    dot = F.aggregate(F.zip_with("a.q", "b.q", lambda x, y: x.cast("bigint") * y.cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    near = dot / (F.col("a.norm") * F.col("b.norm")) >= least
    both = (F.col("a.qid") == F.col("b.qid")) & (F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.norm") > 0) & (F.col("b.norm") > 0)
    return a.join(b, both).where(near).select(F.col("a.qid").alias("qid"), F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"))


def current_versions(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(qid, doc_id, rank, date, canonical, current): of each group of similar hits the newest is current, the earlier hit on equal dates.

    ``hits``: (qid, doc_id, rank, date); ``pairs``: (qid, a, b). Groups are connected components within a query.
    """
    name = lambda q, d: F.concat_ws("\x1f", q.cast("string"), d.cast("string"))
    roots = components(pairs.select(name(F.col("qid"), F.col("a")).alias("a"), name(F.col("qid"), F.col("b")).alias("b")))
    rows = hits.withColumn("_name", name(F.col("qid"), F.col("doc_id")))
    rows = rows.join(roots.select(F.col("id").alias("_name"), "root"), "_name", "left").withColumn("_group", F.coalesce("root", "_name"))
    newest = Window.partitionBy("_group").orderBy(F.desc("date"), "rank")
    first = F.first("doc_id").over(newest)
    return rows.select("qid", "doc_id", "rank", "date", first.alias("canonical"), (first == F.col("doc_id")).alias("current"))
