"""Pairs of words by number: packed tables, ranges that split a word, sides, and the same rows as the joins give."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import company, cooc, corpus, diff, explain, lexicon


@pytest.fixture
def arrays(spark):
    """Two thousand words, some of them in most documents, stopwords and empty documents among them."""
    pick = random.Random(5)
    words = ["le", "pas", "the", "of", *(f"w{i}" for i in range(300))]
    docs = [[words[min(int(pick.expovariate(0.05)), len(words) - 1)] for _ in range(pick.choice((0, 1, 3, 60)))] for _ in range(120)]
    return spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, tokens array<string>").repartition(3)


@pytest.fixture
def small(monkeypatch):
    """Lines, runs and ranges of a few pairs, so that many of each are needed and frequent words are split."""
    monkeypatch.setattr(company, "LINE", 64)
    monkeypatch.setattr(company, "RUN", 200)
    monkeypatch.setattr(company, "RANGE", 150)


def rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_packed_tables():
    keys = np.array([3, 4, 1 << 20, (1 << 20) + 1, 1 << 55], np.int64)
    values = np.array([1, 255, 256, 7, 1 << 33], np.int64)
    assert [x.tolist() for x in lexicon.unpacked(lexicon.packed(keys, values))] == [keys.tolist(), values.tolist()]
    got = lexicon.merged([lexicon.packed(keys, values), lexicon.packed(keys[1:3], values[1:3]), lexicon.packed(keys[:1], values[:1])], most=2)
    assert [x.tolist() for x in got] == [keys.tolist(), [2, 510, 512, 7, 1 << 33]]
    assert [x.tolist() for x in lexicon.summed(np.array([1 << 61, 1, 1 << 61]), np.array([1 << 20, 1, 1]))] == [[1, 1 << 61], [1, (1 << 20) + 1]]


def test_words_are_numbered_in_order(arrays):
    lex = lexicon.lexicon(arrays)
    names = lex.names.value.to_pylist()
    assert names == sorted(names) and lex.words == arrays.select(F.explode("tokens")).distinct().count()
    assert lexicon.lexicon(arrays, most=lex.words - 1) is None
    hashes = arrays.sparkSession.createDataFrame([(["w1", "never seen", "le"],)], "t array<string>").select(lex.hashed(F.col("t"))).first()[0]
    assert lexicon.numbers(lex.places.value, np.array(hashes)).tolist() == [names.index("w1"), -1, names.index("le")]


def test_pairs_in_runs(arrays, small, monkeypatch):
    want = rows(cooc._pair_weights_of_names(arrays, 5))
    assert rows(cooc.pair_weights(arrays)) == want and len(want) > 1000
    found = company.company(arrays)
    assert len(found.bounds(True)) > 5 and any(found.bounds(True) % found.lex.words)
    m = {r.token: r.m for r in cooc.marginals(cooc._pair_weights_of_names(arrays, 5)).collect()}
    assert dict(zip(found.lex.names.value.to_pylist(), found.marginals[0].tolist())) == {w: m.get(w, 0) for w in found.lex.names.value.to_pylist()}
    monkeypatch.setattr(lexicon, "MAX_WORDS", 5)
    assert rows(cooc.pair_weights(arrays)) == want


def test_neighbours_are_ranked_where_pairs_are_summed(arrays, small):
    assert rows(cooc.nearest(arrays, 3)) == rows(cooc.neighbours(cooc.ppmi(cooc._pair_weights_of_names(arrays, 5)), 3))


def test_pairs_are_shuffled_packed(arrays):
    """A pair takes some four bytes in a shuffle; its names and weight took over thirty."""
    lex = lexicon.lexicon(arrays)
    found = company.Company(arrays, lex)
    runs = company._runs(found.lines, lex.words, found.bounds(False), False, 5)
    assert runs.agg(F.sum(F.length("data"))).first()[0] < 6 * cooc.pair_weights(arrays).count()


@pytest.mark.parametrize("least", [1, 3])
def test_company_of_marked_documents(arrays, small, least):
    sides = arrays.withColumn("side", F.when(F.col("doc_id") % 10 == 0, 2).when(F.col("doc_id") % 10 == 1, 1).otherwise(3))
    halves = [arrays.where(F.col("doc_id") % 10 != i) for i in (0, 1)]
    want = rows(diff._company_by_joins(*halves, least))
    assert rows(diff.company_of(sides, least)) == want == rows(diff.company(*halves, least)) and len({d for _, d in want}) > 20


@pytest.mark.parametrize("most_pairs", [40, 4_000_000])
def test_near_words_where_partners_are_summed(arrays, small, monkeypatch, most_pairs):
    monkeypatch.setattr(explain, "ASKED_PAIRS", most_pairs)
    monkeypatch.setattr(explain, "PRODUCTS", 100)
    asked = arrays.sparkSession.createDataFrame([("w1",), ("w3",), ("w90",), ("nowhere",), ("le",), ("the",)], "token string")
    want = explain.near_words(cooc.ppmi(cooc._pair_weights_of_names(arrays, 5)), corpus.vocabulary(arrays), arrays.count(), asked, 4)
    assert rows(explain.near_words_of(arrays, asked, 4)) == rows(want) and want.count() > 8


def test_bigrams_in_runs(arrays, small, monkeypatch):
    """Bigrams as they stand in the text, and documents merged where they are."""
    got = corpus.collocations(arrays, 2, 0.5)
    first, merged = rows(got), corpus.merge_collocations(arrays, got)
    assert "hashpartitioning" not in merged._jdf.queryExecution().executedPlan().toString()
    merged = rows(merged)
    assert any("_" in t for r in merged for t in r[1])
    monkeypatch.setattr(lexicon, "MAX_WORDS", 0)
    assert rows(corpus.collocations(arrays, 2, 0.5)) == first and rows(corpus.merge_collocations(arrays, got)) == merged
