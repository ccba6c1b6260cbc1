import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang]); the other columns follow."""

    def table(rows, parts=2):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts) if full else spark.createDataFrame([], DOCS)

    return table


@pytest.fixture(scope="session")
def odd(spark, make):
    """Nulls in every column, empty and long texts, repeated rows, and a column whose name clashes with inner ones."""
    from pyspark.sql import functions as F

    long = "a very long text of many words indeed " * 4000
    rows = make([(1, None), (2, ""), (3, "   \n\t "), (None, "a text without a number " * 9), (4, long), (4, long), (5, "!!! ... ???"), (6, "word"), (7, "x" * 5000), (8, "é" * 300 + " ünï", None)])
    for name in ("_row", "id", "digest", "at", "_of", "_gone", "bin", "item_id", "_text", "_repeats", "_new", "_spans"):
        rows = rows.withColumn(name, F.lit("x"))
    return rows
