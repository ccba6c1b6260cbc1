"""Documents to training bins: language ID, near-dedup, substring dedup, decontamination, packing."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import chunks, decontaminate, langid, packing, simhash
from corvane.session import delete, shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is known, with all their columns, extra ones too.

    Null and empty texts and those without a letter go, and those unlike every labelled language. Repeated rows and null ids are rows
    like others; ties between languages go by name. Without labels or rows the result is empty.
    """
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group of near copies, and what is in no group, with all columns as they are.

    Null ids and texts without a word are in no group and stay. Rows that repeat a doc_id stay or go together. An empty table stays empty.
    """
    return simhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all rows, without the passages that stand earlier in the corpus, in the order of doc_id and place; n_chars follows the text.

    Rows with a null id or text stay as they are and cause nothing. Equal rows are treated alike. A text may be empty afterwards. Other
    columns stay, whatever their names. An empty table stays empty.
    """
    return chunks.drop_repeated_passages(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without a benchmark item, with all columns as they are.

    Rows with a null id or a text without a word hold no item and stay. Rows that repeat a doc_id go together. Without items nothing
    goes; an empty table stays empty.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every token of the documents in bins; a document without tokens has one row and no bin.

    Null ids and repeated rows are items of their own; items of one size are interchangeable. Other columns aren't read. An empty table
    gives an empty result.
    """
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontaminate_benchmark),
    ("best-fit packing", pack_bins),
]

#: SVM scores, bit-parallel distances and greedy packing aren't SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared folder and read again, then the one before it goes."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs
