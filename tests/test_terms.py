"""Weights of single documents told where the documents are: the rows of the joins, without a shuffle of documents' words."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import evaluate, explain, lexicon, scorer, terms, vectors


@pytest.fixture(scope="module")
def arrays(spark):
    pick = random.Random(7)
    words = ["le", "pas", "sans", "the", "of", "12", "ab12cd", *(f"w{i}" for i in range(200))]
    docs = [[words[min(int(pick.expovariate(0.03)), len(words) - 1)] for _ in range(pick.choice((0, 1, 3, 90)))] for _ in range(60)]
    return spark.createDataFrame([(i, d, f"s{i % 3}") for i, d in enumerate(docs)], "doc_id bigint, tokens array<string>, source string").repartition(2)


@pytest.fixture
def both(monkeypatch):
    """Rows of a plan with numbers and of the same with joins; the first may not shuffle unless told so."""
    monkeypatch.setattr(terms, "STEP", 100)

    def run(plan, module=lexicon, limit="MAX_WORDS", shuffles=False):
        df = plan()
        if not shuffles:
            assert "hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
        got = rows(df)
        with monkeypatch.context() as m:
            m.setattr(module, limit, 0)
            assert got == rows(plan()) and got
        return got

    return run


def rows(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def test_top_terms(arrays, both):
    both(lambda: explain.top_terms(arrays.select("doc_id", "tokens"), 5))


def test_boilerplate_reads_groups_with_the_documents(arrays, both):
    assert len({r[4] for r in both(lambda: explain.top_terms(arrays, 5, ("source",)).select("doc_id", "token", "rank", "weight", "source"))}) == 3


def test_identity_cards(arrays, both):
    both(lambda: explain.identity_cards(arrays, "source", 0.2, terms=10))


def test_held_out(arrays, both):
    both(lambda: evaluate.held_out(arrays.select("doc_id", "tokens"), 3, 4))


def test_heat_map(arrays, both):
    both(lambda: vectors.heat_map_of(arrays.select("doc_id", "tokens"), 64))


@pytest.mark.parametrize("kept", [0, 5, 1 << 17])
def test_grids(arrays, both, monkeypatch, kept):
    monkeypatch.setattr(vectors, "_KEPT", kept)
    both(lambda: vectors.document_grids(arrays.select("doc_id", "tokens")))


def test_signatures_made_together():
    words = [f"x{i}" for i in range(50)]
    got = terms.signatures(words, 64, 40, vectors.signature)  # so few places that three hashes don't always do
    assert all(r[r >= 0].tolist() == vectors.signature(w, 64).tolist() for r, w in zip(got, words))


def test_nearest_words_by_sums_of_columns(arrays, both, monkeypatch):
    monkeypatch.setattr(explain, "DOC_BLOCK", 7)
    monkeypatch.setattr(explain, "WORD_BLOCK", 16)
    some = arrays.where("doc_id % 3 = 0").select("doc_id", "tokens")
    both(lambda: explain.nearest_words_of(arrays.select("doc_id", "tokens"), some, 4), shuffles=True)


def test_only_asked_documents_are_encoded(arrays):
    a = arrays.select("doc_id", "tokens")
    grids, words = vectors.grids_and_words(a, arrays.sparkSession.createDataFrame([(0, ["w1", "nowhere"])], "qid int, tokens array<string>"))
    assert [r.token for r in words.collect()] == ["w1"]
    assert rows(grids(a.where("doc_id < 9"))) == rows(vectors.document_grids(a).where("doc_id < 9"))


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(0, ["w1", "w1", "the"]), (1, ["nowhere"]), (2, ["w40", "of", "w7"]), (3, [])], "qid bigint, tokens array<string>")


def test_bm25_where_documents_are(arrays, asked, both, monkeypatch):
    from corvane.operators import retrieve

    a = arrays.select("doc_id", "tokens")
    monkeypatch.setattr(scorer, "ROWS", 3)
    both(lambda: retrieve.bm25_scores(a, asked), scorer, "MOST_WORDS")
    both(lambda: retrieve.bm25_topk(a, asked, 3), scorer, "MOST_WORDS", shuffles=True)
    both(lambda: retrieve.bm25_confidence(a, asked, 3), scorer, "MOST_WORDS", shuffles=True)


@pytest.mark.parametrize("weights", [(0.6, 0.4), (1.0, 0.0), (0.0, 1.0)])
def test_two_channels_in_one_place(arrays, asked, both, weights):
    from corvane.operators import retrieve

    spark, pick = arrays.sparkSession, random.Random(3)
    v = spark.createDataFrame([(i, [pick.gauss(0, 1) for _ in range(4)]) for i in range(40, 90)] + [(90, [0.0] * 4), (91, [])], "doc_id bigint, vec array<float>")
    q = v.where("doc_id in (41, 42, 90)").select((F.col("doc_id") - 41).alias("qid"), "vec")
    both(lambda: retrieve.convex_with_vectors(arrays.select("doc_id", "tokens"), asked, v, q, weights, 4), scorer, "MOST_WORDS", shuffles=True)


def test_weights_are_tried_in_one_reading(arrays, asked):
    from corvane.operators import retrieve

    a, triples = arrays.select("doc_id", "tokens"), ((0.5, 0.0, 0.5), (1.0, 0.0, 0.0), (0.2, 0.3, 0.5))
    pick = random.Random(4)
    v = arrays.sparkSession.createDataFrame([(i, [pick.gauss(0, 1) for _ in range(4)]) for i in range(30)], "doc_id bigint, vec array<float>")
    q = v.where("doc_id < 3").select(F.col("doc_id").alias("qid"), "vec")
    truth = arrays.sparkSession.createDataFrame([(0, 4), (2, 9), (2, 30)], "qid bigint, doc_id bigint")
    dense = vectors.cosine_scores(v, q, None, doc_vec="vec", query_vec="vec")
    want = evaluate.sweep({"signature": retrieve.bm25_scores(a, asked), "embedding": dense}, truth, triples)
    assert rows(evaluate.sweep_of(retrieve.mixed_with_vectors(a, asked, v, q, [(t[0], t[2]) for t in triples]), truth, triples)) == rows(want)


def test_moments_of_equal_scores():
    import numpy as np

    m = scorer.Moments(2)
    for piece in ([[0.1, np.nan], [0.1, 4.0]], [[0.1, np.nan]], [[np.nan, 2.0], [0.1, 0.0]]):
        m.add(np.array(piece))
    assert m.spread[0] < 1e-12 and m.n.tolist() == [4, 3] and abs(m.mean[1] - 2) < 1e-12 and abs(m.spread[1] - (8 / 3) ** 0.5) < 1e-12


def test_typed_search_where_documents_are(arrays, both):
    from corvane.operators import typed

    a = arrays.select("doc_id", "tokens").unionByName(arrays.sparkSession.createDataFrame([(100, ["zz999", "w1", "w5"]), (101, ["zz999", "w1"])], "doc_id bigint, tokens array<string>"))
    q = arrays.sparkSession.createDataFrame([(0, "w1", 2), (0, "zz999", 1), (1, "w3", 1), (1, "ab12cd", 2), (2, "nowhere", 1), (3, "of", 1)], "qid int, token string, qtf bigint")
    both(lambda: typed.typed_search_of(a, q, 3), shuffles=True)
