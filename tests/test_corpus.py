"""Corpus statistics, co-occurrence, vectors, ranking on hand-made tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import cooc, corpus, diff, embeddings, evaluate, explain, retrieve, typed, vectors, versions


@pytest.fixture(scope="module")
def arrays(spark):
    return lambda *docs: spark.createDataFrame([(i, d.split()) for i, d in enumerate(docs)], "doc_id bigint, tokens array<string>")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_collocations_and_merge(arrays):
    docs = [f"w{i} alpha beta x{i}" for i in range(8)] + [f"y{i} gamma delta" for i in range(3)] + [f"z{i} de la" for i in range(8)]
    docs.append(" ".join(f"f{i}" for i in range(300)))
    c = corpus.collocations(arrays(*docs))
    assert [(r.a, r.b, r.n_ab) for r in c.collect()] == [("alpha", "beta", 8)]
    pairs = arrays("a").sparkSession.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    got = corpus.merge_collocations(arrays("a b c", "b c", "x a b b c a", "", "a b a b", "a"), pairs)
    assert [" ".join(r.tokens) for r in got.orderBy("doc_id").collect()] == ["a_b c", "b_c", "x a_b b_c a", "", "a_b a_b", "a"]


def test_lexicons(spark, arrays):
    lex = corpus.compile_lexicon(spark.createDataFrame([("main_line", "feeder"), ("de_x", "y"), ("z", "de_la")], "key string, value string")).collect()
    assert [(r.key, r.value) for r in lex] == [(["main", "line"], ["feeder"])]
    got = corpus.canonical(arrays("a main line b main", ""), [(["main", "line"], ["feeder"]), (["main"], ["chief"])]).orderBy("doc_id").collect()
    assert [r.tokens for r in got] == [["a", "feeder", "b", "chief"], []]
    both = corpus.merge_lexicons(*(spark.createDataFrame(x, "key string, value string") for x in ([("a", "1")], [("a", "2"), ("b", "3")])))
    assert rows(both) == [("a", "1"), ("b", "3")]


def test_signed_counts(arrays):
    got = corpus.signed_counts(arrays("chat sans le chien chat", "pas", "jamais jamais rouge bleu", ""))
    assert rows(got) == [(0, "chat", False, 2), (0, "chien", True, 1), (2, "bleu", False, 1), (2, "rouge", True, 1)]


def test_unknown_fragments(spark, arrays):
    q = spark.createDataFrame([(1, ["chat", "loup"]), (2, [])], "qid int, tokens array<string>")
    got = corpus.unknown_fragments(q, arrays("chat").select(F.explode("tokens").alias("token")))
    assert rows(got) == [(1, ["chat", "loup", "§^lo", "§lou", "§oup", "§up$"]), (2, [])]


def test_pairs(arrays):
    assert rows(cooc.pair_weights(arrays("a1 b1"))) == [("a1", "b1", 5)]
    p = cooc.pair_weights(arrays("x le la z x", "", "x"))
    assert rows(p) == [("x", "x", 2), ("x", "z", 8)]
    assert dict(rows(cooc.marginals(p))) == {"x": 12, "z": 8}
    want = math.log(10 * 8 / (12 * 8))
    assert rows(cooc.ppmi(p)) == [] and want < 0
    far = cooc.pair_weights(arrays("p1 q1", "r1 s1"))
    assert {(r.a, r.b): round(r.ppmi, 6) for r in cooc.ppmi(far).collect()} == {("p1", "q1"): round(math.log(10 * 5 / 25), 6), ("r1", "s1"): round(math.log(2), 6)}


def test_pairs_add_up(arrays):
    a, b = arrays("u v w u", "v x"), arrays("w u v")
    whole = arrays("u v w u", "v x", "w u v")
    assert rows(cooc.merge_pairs(cooc.pair_weights(a), cooc.pair_weights(b))) == rows(cooc.pair_weights(whole))


def test_signatures(spark):
    got = spark.createDataFrame([("mot",), ("été",)], "t string").select("t", vectors.signature_places(F.col("t")).alias("p")).collect()
    for r in got:
        assert r.p == vectors.signature(r.t).tolist() and len(set(r.p)) == vectors.ACTIVE and max(r.p) < vectors.DIM


def test_grids(arrays):
    g = {r.doc_id: r for r in vectors.document_grids(arrays("chat noir chat", "sans chat", "le la", "chien")).collect()}
    assert max(map(abs, g[0].q)) == 127 and abs(g[0].norm - np.linalg.norm(g[0].q)) < 1e-9
    assert set(g[2].q) == {0} and g[2].norm == 0
    assert np.dot(g[0].q, g[1].q) < 0
    assert vectors.quantized(np.array([[1, 2, -254, 0]])).tolist() == [[0, 1, -127, 0]]


def test_bound_entities_come_back(spark):
    edges = spark.createDataFrame([("d1", "folder", "north"), ("d1", "year", "2026"), ("d2", "folder", "south")], "doc_id string, role string, entity string")
    got = vectors.unbind(vectors.bind(edges), edges.select("role", "entity"), least=0.4)
    assert rows(got.select("doc_id", "role", "entity")) == rows(edges)
    assert vectors.grid_dim(768, 5000) == 12288 and vectors.grid_dim(768, 5000, False) == 768
    with pytest.raises(ValueError):
        vectors.grid_dim(700, 1)


def test_bm25(spark, arrays):
    a = arrays("chat chien chat", "chien oiseau")
    q = spark.createDataFrame([(1, ["chat"]), (2, ["chat", "chat"]), (3, ["absent"]), (4, [])], "qid int, tokens array<string>")
    got = {(r.qid, r.doc_id): r.score for r in retrieve.bm25_scores(a, q).collect()}
    assert set(got) == {(1, 0), (2, 0)} and abs(got[1, 0] - 0.930399) < 1e-6 and abs(got[2, 0] - 2 * got[1, 0]) < 1e-12


def test_bm25_by_matrix_and_by_join(spark, arrays, monkeypatch):
    docs = arrays(*(" ".join(f"w{(i * j) % 23}" for j in range(i % 40)) for i in range(300)))
    q = spark.createDataFrame([(f"q{i}", [f"w{(i * j) % 29}" for j in range(i % 9)]) for i in range(30)], "qid string, tokens array<string>")
    scores = lambda: {(r.qid, r.doc_id): round(r.score, 9) for r in retrieve.bm25_scores(docs, q).collect()}
    first = scores()
    monkeypatch.setattr(retrieve, "BROADCAST_LIMIT", 0)
    assert scores() == first and len(first) > 1000
    assert retrieve.bm25_scores(docs, q.limit(0)).collect() == retrieve.bm25_scores(docs.limit(0), q).collect() == []


def test_bm25_does_not_depend_on_partitions(spark, arrays):
    docs = arrays(*(f"w{i % 7} w{i % 5} w{i % 3} x" for i in range(60)))
    q = spark.createDataFrame([(i, [f"w{i}", "x"]) for i in range(7)], "qid int, tokens array<string>")
    first = rows(retrieve.bm25_topk(docs, q))
    for n in (1, 8, 50):
        assert rows(retrieve.bm25_topk(docs.repartition(n), q.repartition(n))) == first


def test_fusions(spark):
    hits = spark.createDataFrame([("a", "x", 1, 0.9), ("a", "x", 2, 0.88), ("a", "z", 3, 0.87), ("b", "x", 1, 0.3), ("b", "u", 2, 0.1), ("b", "v", 3, 0.09)], "source string, id string, rank int, score double")
    got = {(r.source, r.id): r.score for r in retrieve.fuse_ranks(hits, 10).collect()}
    assert got["a", "x"] == round(1 / 61 + 1 / 62, 6) and got["b", "x"] == round(1 / 61, 6)
    own = spark.createDataFrame([("a", f"a{i}", i, s) for i, s in ((1, 0.9), (2, 0.88), (3, 0.87))] + [("b", f"b{i}", i, s) for i, s in ((1, 0.3), (2, 0.1), (3, 0.09))], "source string, id string, rank int, score double")
    assert {r.id for r in retrieve.fuse_zscores(own, 2).collect()} == {"a1", "b1"}
    same = spark.createDataFrame([("a", str(i), i, 0.5) for i in range(1, 4)], "source string, id string, rank int, score double")
    assert {r.score for r in retrieve.fuse_zscores(same, 5).collect()} == {0.0}
    assert rows(retrieve.by_source(hits)) == [("a", 3, 0.9), ("b", 3, 0.3)]


def test_confidence(spark):
    kind = "qid int, doc_id int, score double"
    assert rows(retrieve.confidence(spark.createDataFrame([(1, i, float(i == 0)) for i in range(4)] + [(2, i, 0.5) for i in range(3)] + [(3, 0, 0.0)], kind), 2)) == [(1, 2.0), (2, 0.0), (3, 0.0)]
    assert rows(retrieve.confidence(spark.createDataFrame([], kind))) == []


def rrf_by_hand(channels, ids, k):
    """Every document ranked by every channel that has a positive score."""
    total = {}
    for scores in channels:
        if max(scores.values(), default=0) > 0:
            order = sorted(ids, key=lambda i: (-round(scores.get(i, 0.0), 9), i))
            for rank, i in enumerate(order, 1):
                total[i] = total.get(i, 0.0) + 1 / (60 + rank)
    return [(i, round(total[i], 6)) for i in sorted(total, key=lambda i: (-round(total[i], 9), i))[:k]]


@pytest.mark.parametrize("n", [4, 60, 400])
def test_rrf_ranks_every_document(spark, n):
    rng = np.random.default_rng(n)
    ids = spark.createDataFrame([(i,) for i in range(n)], "doc_id bigint")
    grids = rng.integers(-3, 4, (n, 6)).astype(np.int8)
    docs = spark.createDataFrame([(i, g.tolist()) for i, g in enumerate(grids)], "doc_id bigint, q array<tinyint>")
    asked = rng.integers(-3, 4, (5, 6)).astype(np.int8)
    asked[3] = 0
    queries = spark.createDataFrame([(j, q.tolist()) for j, q in enumerate(asked)], "qid bigint, q array<tinyint>")
    sparse = [{int(i): float(rng.integers(1, 4)) for i in rng.choice(n, int(n * share), replace=False)} for share in (0.9, 0.1, 0.0, 0.5, 1.0)]
    scores = spark.createDataFrame([(j, i, s) for j, found in enumerate(sparse) for i, s in found.items()], "qid bigint, doc_id bigint, score double")
    got = {}
    for r in retrieve.rrf({"a": retrieve.sparse_channel(scores, ids), "b": retrieve.dense_channel(docs, queries)}, 5).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.doc_id, r.score))
    for j in range(5):
        length = np.linalg.norm(grids.astype(float), axis=1) * np.linalg.norm(asked[j].astype(float))
        cosine = dict(enumerate(np.where(length > 0, grids.astype(float) @ asked[j] / np.where(length > 0, length, 1), 0.0).tolist()))
        assert got.get(j, []) == rrf_by_hand([sparse[j], cosine], range(n), 5), j


def test_connected_queries_are_differences_of_cosines(spark):
    rng = np.random.default_rng(2)
    grids, a, b = rng.integers(-9, 9, (50, 4)), rng.integers(-9, 9, (3, 4)), rng.integers(-9, 9, (3, 4))
    frame = lambda m, name: spark.createDataFrame([(i, v.tolist(), float(np.linalg.norm(v))) for i, v in enumerate(m)], f"{name} bigint, q array<tinyint>, norm double")
    got = retrieve.connected(frame(grids, "doc_id"), frame(a, "qid"), frame(b[:2], "qid"), k=50).collect()
    cos = lambda x, y: x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    assert len(got) == 150
    for r in got:
        want = cos(grids[r.doc_id], a[r.qid]) - (0.7 * cos(grids[r.doc_id], b[r.qid]) if r.qid < 2 else 0)
        assert abs(r.score - want) < 1e-5


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((90, 5))
    v = spark.createDataFrame([(f"v{i:02}", r.tolist()) for i, r in enumerate(x)], "doc_id string, q array<double>").repartition(5)
    cos = (x / np.linalg.norm(x, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    for limit in (16 << 20, 0):
        monkeypatch.setattr(vectors, "BROADCAST_LIMIT", limit)
        got = {}
        for r in vectors.cosine_topk(v, v.withColumnRenamed("doc_id", "qid"), 4).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.doc_id)
        assert got == {f"v{i:02}": [f"v{j:02}" for j in np.argsort(-cos[i], kind="stable")[:4]] for i in range(90)}
    assert vectors.cosine_scores(v, v.withColumnRenamed("doc_id", "qid"), None).count() == 8100


def test_verbatim_items(spark):
    docs = spark.createDataFrame([(1, "an item here, and the other"), (2, "the other"), (3, None), (4, "an ITEM here")], "doc_id int, text string")
    items = spark.createDataFrame([("a", "an item here"), ("b", "the other"), ("c", "the other"), ("d", ""), ("e", None)], "qid string, text string")
    assert rows(evaluate.verbatim(docs, items)) == [("a", 1), ("b", 1), ("b", 2), ("c", 1), ("c", 2)]
    assert evaluate.verbatim(docs, items.limit(0)).collect() == []


def test_blend_and_connectors(spark):
    kind = "qid int, doc_id int, score double"
    base = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.8), (1, 2, 0.7)], kind)
    other = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0)], kind)
    assert [r.doc_id for r in retrieve.blend(base, other, depth=2, k=3).orderBy("rank").collect()] == [1, 0, 2]
    assert rows(retrieve.combine(base, other, k=1).select("doc_id", "score")) == [(0, 0.9)]


def test_cosines(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0])], "doc_id bigint, q array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0])], "qid bigint, q array<double>")
    assert rows(vectors.cosine_topk(d, q, 3), "qid", "rank") == [(7, 0, 1, 1.0), (7, 3, 2, 1.0), (7, 1, 3, 0.707107), (8, 0, 1, 0.0), (8, 1, 2, 0.0), (8, 2, 3, 0.0)]
    assert vectors.cosine_topk(d, q.limit(0)).collect() == [] and vectors.cosine_topk(d.limit(0), q).collect() == []


def test_embeddings(spark):
    lines = spark.createDataFrame([(0, "2 2"), (1, "Chat 1 0"), (2, "chat 0 1"), (3, "chien 1 1")], "line_no int, value string")
    table = embeddings.from_text(lines)
    assert rows(table) == [("chat", [1.0, 0.0]), ("chien", [1.0, 1.0])]
    assert rows(embeddings.nearest(table, table.where("word = 'chat'"), 1)) == [("chat", "chien", 1, 0.707107)]
    more = embeddings.from_text(lines, 1, spark.createDataFrame([("Chien",), ("absent",)], "word string"))
    assert rows(more) == rows(table) and rows(embeddings.from_text(lines, 1)) == rows(table)[:1]
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 6)) + np.array([9, 0, 0, 0, 0, 0])
    t = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "word string, vec array<double>")
    left = np.array([r.vec for r in embeddings.without_common(t, 1).collect()])
    assert abs(left.mean(0)).max() < 1e-9 and np.linalg.matrix_rank(left, 1e-6) == 5
    assert len(embeddings.projected(t, 6, 48).first().vec) == 48
    low = rng.standard_normal((40, 3)) @ rng.standard_normal((3, 30))
    assert np.allclose(embeddings.smoothed(low, 3), low) and embeddings.smoothed(low, 0) is low
    two = spark.createDataFrame([(str(i), (rng.standard_normal(4) * 0.1 + (8 if i % 2 else -8)).tolist()) for i in range(60)], "word string, vec array<double>")
    cells = {r.token: r.cell for r in embeddings.word_map(two, side=4, rounds=8).collect()}
    assert not {cells[str(i)] for i in range(0, 60, 2)} & {cells[str(i)] for i in range(1, 60, 2)}
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id int, embedding array<double>")
    sets = spark.createDataFrame([("both", 0), ("both", 1), ("both", 1), ("one", 2), ("none", 99)], "sid string, vec_id int")
    assert rows(embeddings.like(v, sets)) == [("both", 2, 1, 1.0), ("one", 0, 1, 0.707107), ("one", 1, 2, 0.707107)]


def test_diff(spark, arrays):
    docs = lambda *t: spark.createDataFrame(list(enumerate(t)), "doc_id int, text string")
    before, after = docs("chat noir dort", "chat noir mange", "chat noir"), docs("chat blanc dort", "chat noir mange", "chat noir", "neuf")
    changes = diff.document_changes(before, after)
    assert rows(changes) == [(0, "modified"), (3, "added")] and diff.document_changes(before, before).collect() == []
    a, b = corpus.token_arrays(before), corpus.token_arrays(after)
    assert rows(diff.word_changes(a, b)) == [("blanc", "appeared"), ("neuf", "appeared")] and diff.word_changes(a, a).collect() == []
    assert rows(diff.usage(a, b)) == [("noir", 3, 2, round(-1 / 3, 6))]
    assert {r.drift for r in diff.company(a, a).collect()} <= {0.0}
    g, h = vectors.document_grids(a), vectors.document_grids(b)
    assert {r.drift for r in diff.grid_drift(g, g, diff.document_changes(before, before)).collect()} == {0.0}
    drift = {r.doc_id: r for r in diff.grid_drift(g, h, changes).collect()}
    assert drift[0].modified and drift[0].drift > 0 and not drift[2].modified


def test_evaluation(spark, arrays):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 2)], "qid int, doc_id int, rank int")
    truth = spark.createDataFrame([(1, 11), (1, 12), (2, 20), (3, 30)], "qid int, doc_id int")
    assert rows(evaluate.quality(hits, truth)) == [(3, round((0.5 + 0.5) / 3, 6), 0.5, round(2 / 3, 6))]
    text = " ".join(f"w{i}" for i in range(50))
    held = evaluate.held_out(arrays(text, "short")).collect()
    assert len(held) == 1 and set(held[0].query.split()) <= {f"w{i}" for i in range(25, 50)} and len(held[0].query.split()) == 6
    assert [len(r.tokens) for r in evaluate.first_halves(arrays(text, "short")).orderBy("doc_id").collect()] == [25, 1]
    kind = "qid int, doc_id int, score double"
    good, bad = spark.createDataFrame([(1, 11, 1.0), (1, 5, 0.1), (2, 20, 1.0), (3, 30, 1.0)], kind), spark.createDataFrame([(1, 5, 1.0), (2, 5, 1.0), (3, 5, 1.0)], kind)
    swept = evaluate.sweep({"signature": good, "embedding": bad}, truth)
    best = swept.where("recommended").collect()
    assert swept.count() == len(evaluate.TRIPLES) and len(best) == 1 and float(best[0].weights.split("/")[0]) > 0.4 and not best[0].reliable
    with pytest.raises(ValueError):
        evaluate.sweep({"signature": good}, truth)


def test_typed_precedence(spark, arrays):
    a = arrays("pompe MFN710 pompe pompe".lower(), "pompe pompe eau", "vanne mfn999 pompe")
    counts = typed.routed(a)
    vocab = corpus.with_idf(corpus.vocabulary_from_counts(counts), a)
    q = spark.createDataFrame([(1, "mfn999", 1), (1, "pompe", 1)], "qid int, token string, qtf int")
    assert typed.typed_search(counts, vocab, q).orderBy("rank").first().doc_id == 2
    kinds = spark.createDataFrame([("zx12345",), ("eau",), ("pn16",)], "t string").select(typed.grid_of(F.col("t"), [("pressure", "pn[0-9]+")])).collect()
    assert [r[0] for r in kinds] == ["code", "meaning", "pressure"]
    filed = spark.createDataFrame([(0, ["pompe", "mfn710"], "plans/pompe_1.md")], "doc_id int, tokens array<string>, path string")
    assert rows(typed.routed(filed, path="path")) == [(0, "1", 1, "path"), (0, "md", 1, "path"), (0, "mfn710", 1, "code"), (0, "plans", 1, "path"), (0, "pompe", 1, "meaning"), (0, "pompe", 1, "path")]


def test_explain(spark, arrays):
    a = arrays("alpha beta", "alpha gamma", "alpha delta")
    terms = explain.top_terms(a)
    assert rows(explain.boilerplate(terms.withColumn("source", F.lit("s")), "source")) == [("s", "alpha", 3, 3)]
    cards = explain.identity_card(terms, spark.createDataFrame([("alpha",)], "token string"), least=1)
    assert rows(cards) == [(0, ["beta"]), (1, ["gamma"]), (2, ["delta"])]
    assert rows(explain.stats(arrays("a b a", ""))) == [(2, 3, 2, 1)]


def test_versions(spark):
    hits = spark.createDataFrame([(1, "a", 1, "2024-01-01"), (1, "b", 2, "2025-01-01"), (1, "c", 3, "2023-01-01"), (1, "x", 4, "2020-01-01")], "qid int, doc_id string, rank int, date string")
    pairs = spark.createDataFrame([(1, "a", "b"), (1, "b", "c")], "qid int, a string, b string")
    got = {r.doc_id: (r.canonical, r.current) for r in versions.current_versions(hits, pairs).collect()}
    assert got == {"a": ("b", False), "b": ("b", True), "c": ("b", False), "x": ("x", True)}
    v = spark.createDataFrame([(1, "a", [1, 0], 1.0), (1, "b", [1, 0], 1.0), (1, "c", [0, 1], 1.0), (2, "a", [1, 0], 1.0)], "qid int, doc_id string, q array<int>, norm double")
    assert rows(versions.similar_pairs(v)) == [(1, "a", "b")]


def test_dictionary_import(spark):
    rows_ = [("cable", "câble | fil", 5.0), ("cable", "corde", 9.0), ("chat", "discussion", 3.0), ("lamp", "chat | lampe", 3.0), ("main line", "ligne principale", 2.0), ("bad'word", "mot", 5.0), ("rare", "peu", 0.1), ("table", "table", 4.0), ("go", "aller", 5.0), ("one two three four five", "x", 5.0), ("known", "connu", 5.0), ("long", "un deux trois quatre cinq", 5.0)]
    core = spark.createDataFrame([("known", "su")], "key string, value string")
    got = corpus.import_dictionary(spark.createDataFrame(rows_, "word string, translations string, score double"), core, {"go"}, least=1.0)
    # "chat" is a word of the other language, "table" translates to itself
    assert rows(got) == [("cable", "corde"), ("lamp", "chat"), ("main_line", "ligne_principale"), ("table", "table")]
    assert corpus.import_dictionary(spark.createDataFrame([], "word string, translations string, score double"), core).collect() == []


def test_stored_embeddings(spark, tmp_path):
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.5, 2.0])], "word string, vec array<float>")
    embeddings.write_table(table, f"{tmp_path}/t", removed=2)
    assert rows(embeddings.open_table(spark, f"{tmp_path}/t", removed=2)) == rows(table)
    with pytest.raises(ValueError, match="directions"):
        embeddings.open_table(spark, f"{tmp_path}/t")
    table.limit(1).write.mode("append").parquet(f"{tmp_path}/t/vectors")
    with pytest.raises(ValueError, match="written"):
        embeddings.open_table(spark, f"{tmp_path}/t", removed=2)
    assert embeddings.open_table(spark, f"{tmp_path}/t", removed=2, check=False).count() == 3
    assert embeddings.digest(table) == embeddings.digest(table.repartition(3))
    with pytest.raises(ValueError):
        embeddings.smoothed(np.zeros((embeddings.MAX_TRAINED + 1, 1)), 1)


def test_text_vectors(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r.vec for r in embeddings.text_vectors(docs, lambda texts: [[len(t), 2.0 * len(t)] for t in texts]).collect()}
    want = (np.array([1, 2]) / 5**0.5).astype(np.float16).astype(float).tolist()
    assert got == {1: want, 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_explain_by_vectors(spark, arrays):
    a = arrays("alpha beta alpha", "sans alpha gamma", "delta")
    grids = vectors.document_grids(a)
    best = explain.nearest_words(grids, spark.createDataFrame([("alpha",), ("delta",), ("absent",)], "token string"), 1)
    assert {r.doc_id: r.token for r in best.collect()}[2] == "delta" and [r.score for r in best.where("doc_id = 2").collect()] == [1.0]
    vocab = corpus.with_idf(corpus.vocabulary(a), a)
    q = spark.createDataFrame([(1, ["alpha"]), (2, ["sans", "alpha"])], "qid int, tokens array<string>")
    hits = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "qid int, doc_id bigint")
    got = {(r.qid, r.doc_id): r.part for r in explain.match_terms(grids, vocab, q, hits).collect()}
    assert got[1, 0] > 0 > got[1, 1] and got[2, 1] == -got[1, 1]


def test_lists_of_changes_are_in_order(spark):
    changes = spark.createDataFrame([("b", "new"), ("a", "new"), ("c", "gone")], "what string, change string")
    assert rows(diff.in_order(changes), "change", "place") == [("c", "gone", 1), ("a", "new", 1), ("b", "new", 2)]


def test_word_vectors(spark, arrays):
    scored = spark.createDataFrame([("eau", "lac", 5, 1.0), ("lac", "lac", 5, 0.5)], "a string, b string, w int, ppmi double")
    p = {r.token: np.array(r.profile) for r in vectors.profiles(scored).collect()}
    full = lambda t: np.bincount(vectors.signature(t), weights=vectors._signs(vectors.ACTIVE), minlength=vectors.DIM)
    assert np.allclose(p["eau"], full("lac")) and np.allclose(p["lac"], full("eau") + full("lac"))
    words = spark.createDataFrame([("eau",), ("seul",)], "token string")
    got = {r.token: np.array(r.vec) for r in vectors.word_vectors(words, vectors.profiles(scored), weights=(0.9, 0.1, 0.0)).collect()}
    want = full("eau") / 40**0.5 + full("lac") / 40**0.5
    assert np.allclose(got["eau"], want / np.linalg.norm(want)) and np.allclose(got["seul"], full("seul") / 40**0.5)
    table = spark.createDataFrame([("eau", [1.0] + [0.0] * (vectors.DIM - 1))], "word string, vec array<double>")
    pure = vectors.word_vectors(words, None, table, (0.0, 0.0, 1.0)).where("token = 'eau'").first().vec
    assert pure[0] == 1.0 and sum(pure) == 1.0
    grids = vectors.document_grids(arrays("eau lac", "lac"))
    mixed = {r.doc_id: np.array(r.vec) for r in vectors.with_document_channel(grids, spark.createDataFrame([(0, [2.0] + [0.0] * (vectors.DIM - 1))], "doc_id bigint, vec array<double>"), 0.5).collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in mixed.values()) and mixed[0][0] > 0.5


def test_near_words(spark):
    """Words with the partners of the asked word, against cosines by hand."""
    kind = "a string, b string, w int, ppmi double"
    pairs = [("cat", "milk", 5, 2.0), ("cat", "purr", 5, 1.0), ("kitten", "milk", 5, 2.0), ("kitten", "purr", 5, 1.0), ("dog", "milk", 5, 1.0), ("bark", "dog", 5, 3.0), ("le", "milk", 5, 9.0)]
    scored = spark.createDataFrame(pairs, kind)
    vocab = spark.createDataFrame([(t, 1) for t in ("cat", "kitten", "dog", "milk", "purr", "bark", "le")], "token string, df int")
    got = rows(explain.near_words(scored, vocab, 10, spark.createDataFrame([("cat",)], "token string")), "rank")
    assert got == [("cat", "kitten", 1, 1.0), ("cat", "dog", 2, round(2 / (5**0.5 * 10**0.5), 6))]
    common = vocab.where("token <> 'kitten'").unionByName(spark.createDataFrame([("kitten", 5)], "token string, df int"))
    assert [r[1] for r in rows(explain.near_words(scored, common, 10, spark.createDataFrame([("cat",)], "token string")), "rank")] == ["dog"]
