"""Entities in paths, documents that share them, and hops from one to the next."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

YEAR = "^20[0-9]{2}$"
MONTH_YEAR = r"^(0[1-9]|1[0-2])\.(20[0-9]{2})$"
MONTH_LABEL = r"^(0[1-9]|1[0-2])-\p{L}"
ORDER_PREFIX = r"^[0-9]+[_.-]+"


def path_segments(paths: DataFrame, col: str = "doc_id") -> DataFrame:
    """(doc_id, pos, segment) of the folders; the last segment is the file's name."""
    parts = F.split(F.col(col), "/")
    return paths.select(F.col(col).alias("doc_id"), F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("pos", "segment"))


def path_edges(paths: DataFrame, col: str = "doc_id") -> DataFrame:
    """(doc_id, role, entity, pos), each once: years, months (MM.YYYY, or MM-Label below a year) and folders without their order prefix.

    Years and MM.YYYY are no folders. Works inside each path's array of folders: nothing is shuffled.
    """
    parts = F.split(F.lower(F.col(col)), "/")
    rows = paths.select(F.col(col).alias("doc_id"), F.slice(parts, 1, F.size(parts) - 1).alias("segments"))
    year = lambda s: F.when(s.rlike(YEAR), s).when(s.rlike(MONTH_YEAR), F.regexp_extract(s, MONTH_YEAR, 2))
    begin = F.struct(F.lit(None).cast("string").alias("year"), F.array().cast("array<struct<role:string,entity:string>>").alias("out"))

    def edge(role: str, value):
        return F.struct(F.lit(role).alias("role"), value.alias("entity"))

    def step(state, s):
        none = F.array().cast("array<struct<role:string,entity:string>>")
        month = F.when(s.rlike(MONTH_LABEL) & state["year"].isNotNull(), F.array(edge("month", F.concat_ws("-", state["year"], F.regexp_extract(s, MONTH_LABEL, 1))))).otherwise(none)
        folder = F.concat(F.array(edge("folder", T.entity(F.regexp_replace(s, F.lit(ORDER_PREFIX), F.lit(""))))), month)
        dated = F.array(edge("month", F.concat_ws("-", F.regexp_extract(s, MONTH_YEAR, 2), F.regexp_extract(s, MONTH_YEAR, 1))))
        found = F.when(s.rlike(YEAR), F.array(edge("year", s))).when(s.rlike(MONTH_YEAR), dated).otherwise(folder)
        return F.struct(F.coalesce(year(s), state["year"]).alias("year"), F.concat(state["out"], found).alias("out"))

    edges = F.array_distinct(F.filter(F.aggregate("segments", begin, step, lambda x: x["out"]), lambda e: e["entity"] != ""))
    return rows.select("doc_id", F.posexplode(edges).alias("pos", "e")).select("doc_id", "e.role", "e.entity", "pos")


def path_edges_by_rules(paths: DataFrame, rules: list[tuple[str, str, str | None]], col: str = "doc_id") -> DataFrame:
    """``path_edges`` by declared rules (pattern, role, template): the first that matches a folder wins; {1} stands for a group."""
    if not rules:
        raise ValueError("no rule")
    rows = path_segments(paths, col).withColumn("s", F.lower("segment"))
    plain = T.entity(F.regexp_replace("s", F.lit(ORDER_PREFIX), F.lit("")))
    role = entity = None
    for pattern, name, template in rules:
        begin = f"^(?:{pattern})"
        value = plain
        if template:
            pieces = [F.regexp_extract("s", begin, int(p[1:-1])) if re.fullmatch(r"\{\d+\}", p) else F.lit(p) for p in re.split(r"(\{\d+\})", template) if p]
            value = F.concat(*pieces)
        hit = F.col("s").rlike(begin)
        role = F.when(hit, F.lit(name)) if role is None else role.when(hit, F.lit(name))
        entity = F.when(hit, value) if entity is None else entity.when(hit, value)
    found = rows.select("doc_id", "pos", role.alias("role"), entity.alias("entity")).where("role is not null and entity <> ''")
    return found.groupBy("doc_id", "role", "entity").agg(F.min("pos").alias("pos"))


def related(edges: DataFrame, entities: DataFrame, k: int = 10) -> DataFrame:
    """(entity, doc_id, rank, score): documents that hold an entity in any role, by the number of its roles over all they hold; ``entities``: (entity)."""
    size = edges.groupBy("doc_id").agg(F.count("*").alias("held"))
    asked = entities.select(T.entity(F.col("entity")).alias("entity")).distinct()
    hits = edges.join(asked, "entity").groupBy("entity", "doc_id").agg(F.count("*").alias("roles"))
    score = F.round(F.col("roles") / F.sqrt("held"), 6)
    order = Window.partitionBy("entity").orderBy(F.desc("score"), "doc_id")
    return hits.join(size, "doc_id").withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("entity", "doc_id", "rank", "score")


def siblings(edges: DataFrame, start: DataFrame, k: int = 10) -> DataFrame:
    """(start_doc, role, entity, doc_id, rank): from each document of ``start`` (doc_id) to its entities and on to others with them, by path.

    Of each entity only the first ``k`` + 1 documents can be among the first ``k`` that aren't the start, so the others go before the
    join, most of them before the shuffle.
    """
    order = Window.partitionBy("role", "entity").orderBy("doc_id")
    first = edges.select("role", "entity", "doc_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    mine = edges.join(start.select("doc_id"), "doc_id").select(F.col("doc_id").alias("start_doc"), "role", "entity")
    both = mine.join(first.drop("rank"), ["role", "entity"]).where("doc_id <> start_doc")
    order = Window.partitionBy("start_doc", "role", "entity").orderBy("doc_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("start_doc", "role", "entity", "doc_id", "rank")


def suggested_roles(paths: DataFrame, col: str = "doc_id") -> DataFrame:
    """(depth, n_documents, n_values, kind): what each level of folders looks like, as a start for rules."""
    rows = path_segments(paths, col)
    s = F.lower("segment")
    kind = F.when(s.rlike(YEAR), "year").when(s.rlike(MONTH_YEAR) | s.rlike(MONTH_LABEL), "month").otherwise("folder")
    return rows.groupBy(F.col("pos").alias("depth"), kind.alias("kind")).agg(F.count("*").alias("n_documents"), F.countDistinct("segment").alias("n_values"))
