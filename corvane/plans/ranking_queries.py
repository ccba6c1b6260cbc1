"""Queries that rank documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import questions
from corvane.functions import text as T
from corvane.operators import corpus, embeddings, evaluate, explain, retrieve, typed, vectors, versions
from corvane.plans.corpus_queries import GRID, SIGNED
from corvane.plans.tables import BM25, NEG, QRY, STOP, VOC, benchmark_queries, doc_arrays, in_sql, table, texts, top_sql
from corvane.session import checkpointed, join_checked

#: What the single-query reports look for.
ASKED = "the and of"
CONNECTED = "the thing mais pas of that"


def _literal(spark, text):
    return spark.range(1).select(F.lit(0).cast("bigint").alias("qid"), T.tokens(F.lit(text)).alias("tokens"))


def bm25_topk(spark, d):
    """The ten best documents for one query."""
    return retrieve.bm25_topk(doc_arrays(spark, d), _literal(spark, ASKED), 10)


def bm25_batch_benchmark(spark, d):
    return retrieve.bm25_topk(doc_arrays(spark, d), benchmark_queries(spark, d), 10)


def _grids(spark, d, arrays):
    """Grids of the documents and of the benchmark's items, (doc_id, q, norm) and (qid, q), from one count of the vocabulary."""
    rows = benchmark_queries(spark, d).withColumnRenamed("qid", "doc_id")
    docs, vocab = vectors.grids_and_words(arrays, rows)
    asked = vectors.encode(corpus.signed_counts(rows), vocab, rows).where("norm > 0").select(F.col("doc_id").alias("qid"), "q")
    return docs(arrays), asked


def grid_cosine_topk(spark, d):
    docs, asked = _grids(spark, d, doc_arrays(spark, d))
    return vectors.cosine_topk(docs, asked)


def connector_search(spark, d):
    a = doc_arrays(spark, d)
    parts = [retrieve.bm25_scores(a, spark.range(1).select(F.lit(0).cast("bigint").alias("qid"), T.tokens(questions.wanted(F.lit(CONNECTED), s)).alias("tokens"))) for s in (1, -1)]
    return retrieve.combine(*parts)


def dense_cosine_topk(spark, d):
    """For every vector whose number is divisible by 100 the ten nearest of all others."""
    v = table(spark, d, "embeddings")
    scores = vectors.cosine_scores(v, v.where("vec_id % 100 = 0"), 11, doc_id="vec_id", doc_vec="embedding", query_id="vec_id", query_vec="embedding").where("qid <> doc_id")
    return vectors.ranked(scores, 10).select("qid", "doc_id", "rank", F.round("score", 5).alias("score"))


def like_document(spark, d):
    """What resembles each vector whose number is divisible by 100."""
    v = table(spark, d, "embeddings")
    return embeddings.like(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("sid"), "vec_id"))


def like_mix(spark, d):
    """What resembles the mean of each label's vectors, these left out."""
    v = table(spark, d, "embeddings")
    return embeddings.like(v, v.select(F.col("label").alias("sid"), "vec_id"))


def _dense_channel(spark, d):
    """Cosine of each document's vector with the vector whose number is the query's: a stand-in for an encoder."""
    v = table(spark, d, "embeddings")
    q = v.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    return vectors.cosine_scores(v, q, None, doc_id="vec_id", doc_vec="embedding", query_id="vec_id", query_vec="embedding")


def _dense_vectors(spark, d):
    """What ``_dense_channel`` compares: (doc_id, vec) and (qid, vec)."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    return v, v.withColumnRenamed("doc_id", "qid").join(table(spark, d, "benchmark").select(F.col("item_id").alias("qid")), "qid", "left_semi")


def rerank_blend(spark, d):
    return retrieve.blend(retrieve.bm25_scores(doc_arrays(spark, d), benchmark_queries(spark, d)), _dense_channel(spark, d))


def rrf_fusion(spark, d):
    """BM25 and the grid, every document ranked by both."""
    a = doc_arrays(spark, d)
    q = benchmark_queries(spark, d)
    docs, asked = (checkpointed(x) for x in _grids(spark, d, a))
    return retrieve.rrf({"bm25": retrieve.sparse_channel(retrieve.bm25_scores(a, q), a), "grid": retrieve.dense_channel(docs, asked)})


def _shards(spark, d):
    """The ten best of each source for one query, scored within that source."""
    docs = table(spark, d, "documents").select("doc_id", "source", T.tokens(F.col("text")).alias("tokens"))
    q = T.tokens(F.lit(ASKED))
    rows = docs.select("source", "doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("token")).where(F.array_contains(q, F.col("token"))).groupBy("source", "doc_id", "dl", "token").agg(F.count("*").alias("tf"))
    stats = docs.groupBy("source").agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    df = rows.groupBy("source", "token").agg(F.count("*").alias("df"))
    part = corpus.bm25_idf(F.col("n"), F.col("df")) * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    scores = rows.join(df, ["source", "token"]).join(stats, "source").groupBy("source", "doc_id").agg(F.sum(part).alias("score"))
    return vectors.ranked(scores, 10, key="source").select("source", F.col("doc_id").alias("id"), "rank", "score")


def meta_rrf(spark, d):
    return retrieve.fuse_ranks(_shards(spark, d), 20)


def meta_znorm(spark, d):
    return retrieve.fuse_zscores(_shards(spark, d), 20)


def meta_summary(spark, d):
    return retrieve.by_source(_shards(spark, d))


def query_confidence(spark, d):
    return retrieve.bm25_confidence(doc_arrays(spark, d), benchmark_queries(spark, d))


def convex_fusion(spark, d):
    """Weighted z-scores of BM25 and the dense stand-in."""
    return retrieve.convex_with_vectors(doc_arrays(spark, d), benchmark_queries(spark, d), *_dense_vectors(spark, d), (0.6, 0.4))


def typed_search(spark, d):
    q = benchmark_queries(spark, d).select("qid", F.explode("tokens").alias("token")).groupBy("qid", "token").agg(F.count("*").alias("qtf"))
    return typed.typed_search_of(doc_arrays(spark, d), q)


def explain_match(spark, d):
    """What each token of the benchmark's queries adds in the best ten documents."""
    a, q = doc_arrays(spark, d), benchmark_queries(spark, d)
    hits = checkpointed(retrieve.bm25_topk(a, q, 10))
    grids, vocab = vectors.grids_and_words(a, q)
    return explain.match_terms(grids(_held(a, hits)), vocab, q, hits)


def _held(arrays, hits):
    """The documents that are among the hits."""
    return join_checked(arrays, hits.select("doc_id").distinct(), "doc_id", "left_semi", row_bytes=64)


def weight_sweep(spark, d):
    """Shares of BM25 and the dense stand-in, held against the documents that hold an item verbatim."""
    truth = checkpointed(evaluate.verbatim(texts(spark, d), table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")))
    v, asked = _dense_vectors(spark, d)
    rows = retrieve.mixed_with_vectors(doc_arrays(spark, d), benchmark_queries(spark, d), v, asked, [(t[0], t[2]) for t in evaluate.TRIPLES])
    if rows is not None:
        return evaluate.sweep_of(rows, truth)
    channels = {"signature": checkpointed(retrieve.bm25_scores(doc_arrays(spark, d), benchmark_queries(spark, d))), "embedding": checkpointed(_dense_channel(spark, d))}
    return evaluate.sweep(channels, truth)


def mrr_recall(spark, d):
    """How well BM25 finds the documents that hold an item verbatim."""
    truth = evaluate.verbatim(texts(spark, d), table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text"))
    return evaluate.quality(bm25_batch_benchmark(spark, d), truth)


def version_groups(spark, d):
    """Among the best 20 documents of each query, those that are versions of one; doc_id stands for the date."""
    a, q = doc_arrays(spark, d), benchmark_queries(spark, d)
    hits = checkpointed(retrieve.bm25_topk(a, q, 20).select("qid", "doc_id", "rank", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("date")))
    grids = checkpointed(vectors.grids_and_words(a, q)[0](_held(a, hits)).select("doc_id", "q", "norm"))
    return versions.current_versions(hits, versions.similar_pairs(hits.join(grids, "doc_id").select("qid", "doc_id", "q", "norm")))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_batch_benchmark, grid_cosine_topk, connector_search, dense_cosine_topk, like_document, like_mix, rerank_blend, rrf_fusion, meta_rrf, meta_znorm, meta_summary, query_confidence, convex_fusion, typed_search, explain_match, mrr_recall, version_groups, weight_sweep)}


def _literal_sql(text: str) -> str:
    words = text.split()
    return "qry as (select 0::bigint as qid, token, count(*) as qtf from (values " + ", ".join(f"('{w}')" for w in words) + ") v(token) group by all)"


def _bm(name: str, qry: str) -> str:
    return BM25.replace("bm as", f"{name} as").replace("from qry", f"from {qry}")


_QGRID = """qkept as (select * from qpos where token in {neg} or token not in {stop}),
qlag as (select *, coalesce(lag(token) over (partition by qid order by pos), '') in {neg} as negated from qkept),
qsign as (select qid, token, negated, count(*) as tf from qlag where token not in {neg} group by all),
qw as (select qid, token, (case when negated then -1 else 1 end) * round((1 + ln(tf)) * idf * 1000000)::bigint as w from qsign join voc using (token)),
qcell as (select qid, place as idx, sum(w * case when r <= 20 then 1 else -1 end)::bigint as v from qw join sig using (token) group by all),
qgrid as (select qid, idx, round_even(v * 127.0::double / max(abs(v)) over (partition by qid), 0)::int as q from qcell),
gn as (select doc_id, sqrt(sum(q * q)) as n from grid group by 1), qn as (select qid, sqrt(sum(q * q)) as n from qgrid group by 1),
gs as (select qid, doc_id, case when gn.n * qn.n > 0 then s / (gn.n * qn.n) else 0 end as score from (select qid, doc_id, sum(g.q * x.q) as s from grid g join qgrid x using (idx) group by all) join gn using (doc_id) join qn using (qid) where qn.n > 0)"""


def _qgrid() -> str:
    return _QGRID.format(neg=NEG, stop=STOP)


_COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"
_DENSE = f"dense as (select b.vec_id as qid, a.vec_id as doc_id, {_COS} as score from embeddings a, embeddings b where b.vec_id in (select item_id from benchmark))"
_ASKED = in_sql(ASKED.split())
_SHARDS = f"""with {VOC}, s as (select source, count(*) as n, avg(len(tokens)) as avgdl from arr join documents using (doc_id) group by 1),
c as (select source, doc_id, len(tokens) as dl, token, tf from cnt join arr using (doc_id) join documents using (doc_id) where token in {_ASKED}),
f as (select source, token, count(*) as df from c group by all),
x as (select source, doc_id as id, sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / s.avgdl))) as score from c join f using (source, token) join s using (source) group by all),
h as (select source, id, r::int as rank, score from (select *, row_number() over (partition by source order by round(score, 9) desc, id) as r from x) where r <= 10)"""
_FUSED = "select row_number() over (order by round(score, 9) desc, source, local_rank, id)::int as position, source, id, local_rank, round(score, 6) as score from {} order by round(score, 9) desc, source, local_rank, id limit 20"

SQL = {
    "bm25_topk": f"with {VOC}, {_literal_sql(ASKED)}, {BM25} {top_sql('bm', 10)}",
    "bm25_batch_benchmark": f"with {VOC}, {QRY}, {BM25} {top_sql('bm', 10)}",
    "grid_cosine_topk": f"with {VOC}, {SIGNED}, {GRID}, {QRY}, {_qgrid()} {top_sql('gs', 10)}",
    "connector_search": f"with {VOC}, {_literal_sql('the thing').replace('qry as', 'q1 as')}, {_literal_sql('of that').replace('qry as', 'q2 as')}, {_bm('b1', 'q1')}, {_bm('b2', 'q2').replace('dl as (select', 'dl2 as (select').replace('join dl ', 'join dl2 ')}, c as (select qid, doc_id, sum(score) as score from (select * from b1 union all select qid, doc_id, -0.7 * score from b2) group by all) {top_sql('c', 10)}",
    "dense_cosine_topk": f"with s as (select b.vec_id as qid, a.vec_id as doc_id, {_COS} as score from embeddings a, embeddings b where b.vec_id % 100 = 0 and a.vec_id <> b.vec_id) {top_sql('s', 10, digits=5)}",
    "like_document": f"with s as (select b.vec_id as sid, a.vec_id as doc_id, {_COS} as score from embeddings a, embeddings b where b.vec_id % 100 = 0 and a.vec_id <> b.vec_id) select sid, doc_id, r::int as rank, round(score, 6) as score from (select *, row_number() over (partition by sid order by round(score, 9) desc, doc_id) as r from s) where r <= 10",
    "like_mix": """with u as (select label, i, avg(x / n) as x from (select label, unnest(embedding)::double as x, unnest(range(len(embedding))) as i, sqrt(list_sum(list_transform(embedding, lambda e: e::double * e))) as n from embeddings) group by all),
m as (select label as sid, list(x order by i) as v from u group by 1), s as (select sid, vec_id as doc_id, list_cosine_similarity(embedding::double[], v) as score from embeddings, m where label <> sid)
select sid, doc_id, r::int as rank, round(score, 6) as score from (select *, row_number() over (partition by sid order by round(score, 9) desc, doc_id) as r from s) where r <= 10""",
    "rerank_blend": f"""with {VOC}, {QRY}, {BM25}, {_DENSE},
b as (select *, row_number() over (partition by qid order by round(score, 9) desc, doc_id) as base_rank from bm),
j as (select b.*, case when base_rank <= 50 then 0.7::double * b.score + (1 - 0.7::double) * coalesce(dense.score, 0) end as blended from b left join dense using (qid, doc_id) where base_rank <= 50)
select qid, doc_id, r::int as rank, round(score, 6) as score, round(blended, 6) as blended from (select *, row_number() over (partition by qid order by round(blended, 9) desc, doc_id) as r from j) where r <= 10""",
    "rrf_fusion": f"""with {VOC}, {SIGNED}, {GRID}, {QRY}, {_qgrid()}, {BM25},
e1 as (select q.qid, arr.doc_id, coalesce(score, 0) as score from (select qid from bm group by 1 having max(score) > 0) q cross join arr left join bm on bm.qid = q.qid and bm.doc_id = arr.doc_id),
e2 as (select q.qid, arr.doc_id, coalesce(score, 0) as score from (select qid from gs group by 1 having max(score) > 0) q cross join arr left join gs on gs.qid = q.qid and gs.doc_id = arr.doc_id),
u as (select qid, doc_id, 1.0::double / (60 + row_number() over (partition by qid order by round(score, 9) desc, doc_id)) as s from e1 union all select qid, doc_id, 1.0::double / (60 + row_number() over (partition by qid order by round(score, 9) desc, doc_id)) from e2),
f as (select qid, doc_id, sum(s) as score from u group by all) {top_sql('f', 10)}""",
    "meta_rrf": f"{_SHARDS}, m as (select source, id, rank as local_rank, 1.0::double / (60 + rank) as score from h) {_FUSED.format('m')}",
    "meta_znorm": f"{_SHARDS}, m as (select source, id, rank as local_rank, (score - avg(score) over (partition by source)) / case when stddev_pop(score) over (partition by source) > 1e-12 then stddev_pop(score) over (partition by source) else 1 end as score from h) {_FUSED.format('m')}",
    "meta_summary": f"{_SHARDS} select source, count(*) as n, round(max(score), 6) as best from h group by 1",
    "query_confidence": f"""with {VOC}, {QRY}, {BM25}, r as (select *, row_number() over (partition by qid order by round(score, 9) desc, doc_id) as r from bm)
select qid, round(case when abs(avg(score)) > 0 then coalesce(stddev_pop(score) filter (r <= 10), 0) / abs(avg(score)) else 0 end, 6) as nqc from r group by 1""",
    "convex_fusion": f"""with {VOC}, {QRY}, {BM25}, {_DENSE}, z(qid, doc_id, w, score) as (select qid, doc_id, 0.6::double, score from bm union all select qid, doc_id, 0.4::double, score from dense),
y as (select qid, doc_id, w * (score - avg(score) over p) / case when stddev_pop(score) over p > 1e-12 then stddev_pop(score) over p else 1 end as score from z window p as (partition by qid, w)),
c as (select qid, doc_id, sum(score) as score from y group by all) {top_sql('c', 10)}""",
    "typed_search": f"""with {VOC}, {QRY}, t as (select token, df, idf, case when (length(b) >= 5 and regexp_matches(b, '[A-Za-z]') and regexp_matches(b, '[0-9]')) or (length(b) >= 6 and regexp_matches(b, '^[0-9]+$')) then 'code' else 'meaning' end as grid
  from (select *, regexp_replace(token, '[^0-9A-Za-z]', '', 'g') as b from voc)),
q as (select qid, token, grid, df, idf, (1 + ln(qtf)) * idf as qw from qry join t using (token)),
p as (select *, mass / sum(mass) over (partition by qid) as share, max(cdf) over (partition by qid) as code_df from (select qid, grid, sum(idf) as mass, sqrt(sum(qw * qw)) as qn, max(case when grid = 'code' then df end) as cdf from q group by all)),
d as (select doc_id, token, grid, (1 + ln(tf)) * idf as dw from cnt join t using (token)), dn as (select doc_id, grid, sqrt(sum(dw * dw)) as dn from d group by all),
c as (select qid, doc_id, grid, sum(qw * dw) as dot from d join q using (token, grid) group by all),
r as (select qid, doc_id, grid, share, code_df, dot / (dn * qn) as cos from c join dn using (doc_id, grid) join p using (qid, grid)),
s as (select qid, doc_id, sum(share * cos) as score, coalesce(max(case when grid = 'code' then round(cos, 4) end), 0) as code_score, max(code_df) as code_df from r group by all)
select qid, doc_id, r::int as rank, round(score, 6) as score, code_score::double as code_score from (select *, row_number() over (partition by qid order by case when code_df <= 2 then code_score else 0 end desc, round(score, 9) desc, doc_id) as r from s) where r <= 10""",
    "explain_match": f"""with {VOC}, {SIGNED}, {GRID}, {QRY}, {_qgrid()}, {BM25}, h as ({top_sql('bm', 10)}),
w as (select qid, token, negated, (case when negated then -1 else 1 end) * (1 + ln(tf)) * idf as w from qsign join voc using (token))
select qid, doc_id, token, negated, round(any_value(w) * sum(g.q * case when r <= 20 then 1 else -1 end) / (any_value(gn.n) * sqrt(40)), 6) as part
from h join w using (qid) join sig using (token) join grid g using (doc_id) join gn using (doc_id) where g.idx = place and gn.n > 0 group by all""",
    "version_groups": f"""with recursive {VOC}, {SIGNED}, {GRID}, {QRY}, {BM25}, h as ({top_sql('bm', 20)}),
hq as (select qid, doc_id, list(q order by idx) as v from h join grid using (doc_id) group by all),
near as (select x.qid, x.doc_id as a, y.doc_id as b from hq x join hq y on x.qid = y.qid and x.doc_id <> y.doc_id
  where list_sum(list_transform(x.v, lambda e: e * e)) > 0 and list_sum(list_transform(y.v, lambda e: e * e)) > 0
    and list_inner_product(x.v::double[], y.v::double[]) / (sqrt(list_sum(list_transform(x.v, lambda e: e * e))) * sqrt(list_sum(list_transform(y.v, lambda e: e * e)))) >= 0.55),
reach as (select qid, doc_id as a, doc_id as b from h union select r.qid, r.a, n.b from reach r join near n on n.qid = r.qid and n.a = r.b)
select h.qid, h.doc_id, h.rank, lpad(h.doc_id::varchar, 12, '0') as date, max(b) as canonical, max(b) = h.doc_id as current from h join reach on reach.qid = h.qid and reach.a = h.doc_id group by h.qid, h.doc_id, h.rank""",
    "weight_sweep": f"""with {VOC}, {QRY}, {BM25}, {_DENSE}, tr(nth, weights, ws, we) as (values {', '.join(f"({i}, '{'/'.join(map(str, t))}', {t[0]}::double, {t[2]}::double)" for i, t in enumerate(evaluate.TRIPLES))}),
t as (select distinct item_id as qid, doc_id from documents d join benchmark b on contains(d.text, b.text) where length(b.text) > 0),
u as (select nth, qid, doc_id, ws * score as s from bm, tr where ws > 0 union all select nth, qid, doc_id, we * score from dense, tr where we > 0),
h as (select nth, qid, doc_id, row_number() over (partition by nth, qid order by round(sum(s), 9) desc, doc_id) as rank from u group by nth, qid, doc_id qualify rank <= 10),
e as (select tr.nth, weights, t.qid, min(rank) as first, count(rank) as got, count(*) as al from tr cross join t left join h on h.nth = tr.nth and h.qid = t.qid and h.doc_id = t.doc_id group by all),
m as (select nth, weights, count(*) as queries, round(avg(coalesce(1.0::double / first, 0)), 6) as mrr, round(avg(got / al), 6) as recall from e group by all),
b as (select arg_min(nth, (-mrr, nth)) as best, max(mrr) as top, max(mrr) filter (nth = 0) as base from m)
select weights, queries, mrr, recall, nth = best and top - base >= 0.02 as recommended, queries >= 10 as reliable from m, b""",
    "mrr_recall": f"""with {VOC}, {QRY}, {BM25}, h as ({top_sql('bm', 10)}), t as (select distinct item_id as qid, doc_id from documents d join benchmark b on contains(d.text, b.text)),
e as (select qid, min(rank) as first, count(rank) as got, count(*) as al from t left join h using (qid, doc_id) group by 1)
select count(*) as queries, round(avg(coalesce(1.0::double / first, 0)), 6) as mrr, round(avg(got / al), 6) as recall, round(avg((first is not null)::int), 6) as hit_rate from e""",
}
