"""Exact questions over facets (doc_id, type, date, refs): counts, months, latest, references, and their use in ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.retrieve import RRF


def extract(docs: DataFrame, path: str = "path", text: str = "text", extra: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, type, date, refs) of files with a path and a text."""
    both = F.concat_ws(" ", path, text)
    return docs.select(F.col(path).alias("doc_id"), T.document_kind(F.col(path), F.length(F.trim(F.coalesce(F.col(text), F.lit("")))), extra).alias("type"), T.path_date(F.col(path)).alias("date"), T.codes(both).alias("refs"))


def select(facets: DataFrame, contains: str | None = None, kind: str | None = None, date: str | None = None, dated: bool = False) -> DataFrame:
    """The rows whose path contains a part, of one type, whose date begins with ``date``, with a date at all."""
    if contains is not None:
        facets = facets.where(T.path_contains(F.col("doc_id"), contains))
    if kind is not None:
        facets = facets.where(F.col("type") == kind)
    if date is not None:
        facets = facets.where(F.startswith(F.col("date"), F.lit(date)))
    return facets.where(F.col("date") != T.NO_DATE) if dated else facets


def count(facets: DataFrame, **filters) -> DataFrame:
    """One row: n, and how many of them have no date."""
    return select(facets, **filters).agg(F.count("*").alias("n"), F.count_if(F.col("date") == T.NO_DATE).alias("undated"))


def by_month(facets: DataFrame, **filters) -> DataFrame:
    """(month, n) of the dated rows."""
    return select(facets, dated=True, **filters).groupBy(F.substring("date", 1, 7).alias("month")).agg(F.count("*").alias("n"))


def types(facets: DataFrame) -> DataFrame:
    """(type, n), most frequent first."""
    return facets.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def latest(facets: DataFrame, k: int = 1, **filters) -> DataFrame:
    """The ``k`` latest dated rows, ties by path: a top-k report."""
    return select(facets, dated=True, **filters).select("doc_id", "type", "date").orderBy(F.desc("date"), "doc_id").limit(k)


def holders(facets: DataFrame, codes: DataFrame) -> DataFrame:
    """(ref, doc_id, type, date, place) of the documents with each code, place by date, the latest first, then doc_id. ``codes``: (ref)."""
    rows = facets.select("doc_id", "type", "date", F.explode(F.array_distinct("refs")).alias("ref"))
    order = Window.partitionBy("ref").orderBy(F.desc("date"), "doc_id")
    return rows.join(codes.select("ref").distinct(), "ref").select("ref", "doc_id", "type", "date", F.row_number().over(order).alias("place"))


def pool_size(k: int, kind: bool, recency: bool, code: bool) -> int:
    """How many hits facets work on: those ranked below are never brought up."""
    if kind or code:
        return max(40 * k, 400)
    return max(5 * k, 50) if recency else k


def apply(hits: DataFrame, facets: DataFrame, k: int = 10, kind: str | None = None, recency: float = 0.0, codes: list[str] = (), asked: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, rank, score, type, date, exact) from hits (qid, doc_id, rank, score), the pool already cut to ``pool_size``.

    Of one type if asked; holders of a code first, in the order of the hits; the others by (1 - recency) / (60 + rank) + recency / (60 +
    rank by date, latest first). Documents without facets have type "?" and no date. ``asked``: (qid, codes), the codes of each query
    beside ``codes``.
    """
    if not 0 <= recency <= 1:
        raise ValueError("recency is from 0 to 1")
    rows = hits.join(facets, "doc_id", "left").select("qid", "doc_id", F.col("rank").alias("_r"), "score", F.coalesce("type", F.lit("?")).alias("type"), F.coalesce("date", F.lit(T.NO_DATE)).alias("date"), F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))
    if kind is not None:
        rows = rows.where(F.col("type") == kind)
    wanted = F.lit(list(codes)).cast("array<string>")
    if asked is not None:
        rows = rows.join(asked.select("qid", F.col("codes").alias("_codes")), "qid", "left")
        wanted = F.concat(wanted, F.coalesce("_codes", F.array().cast("array<string>")))
    held = F.arrays_overlap("refs", wanted) if codes or asked is not None else F.lit(False)
    rows = rows.withColumn("exact", held)
    rest = Window.partitionBy("qid", "exact")
    sense = F.row_number().over(rest.orderBy("_r"))
    newest = F.row_number().over(rest.orderBy(F.desc("date"), "_r"))
    rows = rows.withColumn("_s", sense).withColumn("_d", newest)
    value = F.when(F.col("exact"), 1 / (RRF + F.col("_s"))).otherwise((1 - recency) / (RRF + F.col("_s")) + recency / (RRF + F.col("_d")))
    order = Window.partitionBy("qid").orderBy(F.desc("exact"), F.round(value, 12).desc(), "_r")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"), "type", "date", "exact")


def empty_filter_report(hits: DataFrame, facets: DataFrame, kind: str) -> DataFrame:
    """Per query for which a type leaves nothing: (qid, n, first_doc, types), what there is without the filter."""
    rows = hits.join(facets.select("doc_id", "type"), "doc_id", "left").withColumn("type", F.coalesce("type", F.lit("?")))
    counts = rows.groupBy("qid", "type").agg(F.count("*").alias("n"), F.min(F.struct("rank", "doc_id")).alias("first"))
    every = counts.groupBy("qid").agg(F.sum("n").alias("n"), F.min("first")["doc_id"].alias("first_doc"), F.array_sort(F.collect_list(F.struct("type", "n"))).alias("types"), F.max(F.col("type") == kind).alias("_some"))
    return every.where(~F.col("_some")).drop("_some")
