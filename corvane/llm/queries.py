"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import chat, chunks, decontaminate, html, langid, licenses, media, packing, simhash, wordpieces


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.flat(chat.windows(_table(spark, sf_dir, "conversations")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of all documents, each with its pieces in order."""
    return packing.bins(packing.pack(_table(spark, sf_dir, "documents")))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_spans(_table(spark, sf_dir, "documents"))


def op6_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.removed_passages(_table(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts as transport streams, some with a lost packet, taken apart again."""
    return media.elementary_packets(media.media_table(_table(spark, sf_dir, "documents"), lose=7))


def op8_wordpieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpieces.token_counts(_table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_decontaminate, op2_langid, op3_chat, op4_packing, op5_licenses, op6_chunks, op7_media, op8_wordpieces, op9_html, op10_simhash)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": chat.windows_sql(), "op9_html": html.main_text_sql()}
