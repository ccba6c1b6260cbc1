"""Ranking: BM25, channel fusion, blends, connectors and confidence, for a whole table of queries in one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.pandas.types import to_arrow_type

from corvane.operators.corpus import bm25_idf
from corvane.operators.scorer import mixed, scorer
from corvane.operators.vectors import better_counts, cosine_scores, pair_cosines, ranked
from corvane.session import BROADCAST_LIMIT, checkpointed, join_checked

K1, B = 1.5, 0.75
#: Constant of reciprocal-rank fusion.
RRF = 60
#: Hits of the base order that ``blend`` goes into.
DEPTH = 50


def postings(arrays: DataFrame) -> DataFrame:
    """(token, doc_id, tf, dl); doc_id must be unique."""
    rows = arrays.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("token"))
    return rows.groupBy("token", "doc_id", "dl").agg(F.count("*").alias("tf"))


def bm25_scores(arrays: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, doc_id, score) of the documents with a query token. ``queries``: (qid, tokens); repeated tokens count each time.

    Only the tokens of the queries are counted in the documents, where these are, if the queries' weights can be sent along; else both
    sides are shuffled.
    """
    found = scorer(arrays, queries)
    return _bm25_by_joins(arrays, queries) if found is None else found.scores()


def _bm25_by_joins(arrays: DataFrame, queries: DataFrame) -> DataFrame:
    rows = arrays.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("token"))
    wanted = queries.select(F.explode("tokens").alias("token")).distinct()
    hits = join_checked(rows, wanted, "token", "left_semi", row_bytes=64).groupBy("token", "doc_id", "dl").agg(F.count("*").alias("tf"))
    return _bm25(hits, arrays.select(F.size("tokens").alias("dl")), queries)


def bm25_from_postings(posted: DataFrame, lengths: DataFrame, queries: DataFrame) -> DataFrame:
    """``bm25_scores`` from stored postings (token, doc_id, tf, dl) and lengths (doc_id, dl): only the postings of query tokens are read on."""
    wanted = queries.select(F.explode("tokens").alias("token")).distinct()
    return _bm25(join_checked(posted.select("token", "doc_id", "tf", "dl"), wanted, "token", "left_semi", row_bytes=64), lengths, queries)


def _bm25(hits: DataFrame, lengths: DataFrame, queries: DataFrame) -> DataFrame:
    """Scores from postings (token, doc_id, dl, tf) of the queries' tokens.

    If the weights of all query tokens are few, they go out as one matrix, and a document's row of term parts is multiplied with it where
    the document is; else postings and weights are joined.
    """
    hits = checkpointed(hits)
    terms = queries.select("qid", F.explode("tokens").alias("token")).groupBy("qid", "token").agg(F.count("*").alias("qtf"))
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    corpus = checkpointed(lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))
    weights = checkpointed(terms.join(df, "token").crossJoin(F.broadcast(corpus)).select("qid", "token", (F.col("qtf") * bm25_idf(F.col("n"), F.col("df"))).alias("weight")))
    tf = F.col("tf")
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    parts = hits.crossJoin(F.broadcast(corpus)).select("doc_id", "token", part.alias("part"))  # one row
    words, asked = weights.agg(F.count_distinct("token"), F.count_distinct("qid")).first()
    if 8 * words * asked > BROADCAST_LIMIT:
        return parts.join(weights, "token").groupBy("qid", "doc_id").agg(F.sum(F.col("part") * F.col("weight")).alias("score"))
    rows = weights.collect()  # a matrix within BROADCAST_LIMIT
    qids = sorted({r.qid for r in rows})
    place, column = {t: i for i, t in enumerate(sorted({r.token for r in rows}))}, {q: j for j, q in enumerate(qids)}
    matrix = np.zeros((len(place), len(qids)))
    for r in rows:
        matrix[place[r.token], column[r.qid]] = r.weight
    shared = hits.sparkSession.sparkContext.broadcast((place, qids, matrix))
    schema = ST.StructType([queries.schema["qid"], hits.schema["doc_id"], ST.StructField("score", ST.DoubleType())])
    qtype = to_arrow_type(queries.schema["qid"].dataType)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, qids, matrix = shared.value
        names = pa.array(qids, qtype)
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                docs = batch.slice(at, 256)
                held = docs.column(1)
                flat = held.flatten()
                tokens = flat.field("token").dictionary_encode()
                index = np.array([place[t] for t in tokens.dictionary.to_pylist()], np.int64)[tokens.indices.to_numpy()]
                m = np.zeros((docs.num_rows, len(place)))
                m[np.repeat(np.arange(docs.num_rows), np.diff(held.offsets.to_numpy())), index] = flat.field("part").to_numpy()
                score = m @ matrix
                x, y = np.nonzero(score)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(y)), docs.column(0).take(pa.array(x)), pa.array(score[x, y])], ["qid", "doc_id", "score"])

    return parts.groupBy("doc_id").agg(F.collect_list(F.struct("token", "part")).alias("terms")).mapInArrow(batches, schema)


def bm25_topk(arrays: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(qid, doc_id, rank, score to 6 places); a task keeps its best ``k`` of a query."""
    found = scorer(arrays, queries)
    scores = _bm25_by_joins(arrays, queries) if found is None else found.top(k)
    return ranked(scores, k).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


@dataclass
class Channel:
    """One ranking of all documents for each query that it says something about, asked for in parts.

    ``top(r)``: (qid, doc_id, rank) of the first r; ``ranks(pairs)``: (qid, doc_id, rank) of given (qid, doc_id) that aren't among them.
    """

    top: Callable[[int], DataFrame]
    ranks: Callable[[DataFrame], DataFrame]


def _ordinals(ids: DataFrame) -> DataFrame:
    """(doc_id, nth) in the order of ids from 0, by ranges: each task counts its own, and starts where those before it end."""
    parts = checkpointed(ids.select("doc_id").repartitionByRange("doc_id").select("doc_id", F.spark_partition_id().alias("part")))
    sizes = parts.groupBy("part").count().withColumn("base", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("part").orderBy("doc_id")) - 1
    return parts.withColumn("local", local).join(F.broadcast(sizes.select("part", "base")), "part").select("doc_id", (F.col("base") + F.col("local")).alias("nth"))


def sparse_channel(scores: DataFrame, ids: DataFrame) -> Channel:
    """The ranking by (qid, doc_id, score): positive scores first, then all other documents by id. A query without a positive score has none.

    The documents without a score are never multiplied with the queries: their ranks follow from their place among all ids, less the
    documents with a score before them.
    """
    scores = checkpointed(scores.where("score > 0").select("qid", "doc_id", F.round("score", 9).alias("score")))
    live = scores.groupBy("qid").agg(F.count("*").alias("n"))

    def top(r: int) -> DataFrame:
        best = ranked(scores, r).select("qid", "doc_id", "rank")
        first = ids.select("doc_id").orderBy("doc_id").limit(r)  # the others that can be among the first r are among these
        rest = live.where(F.col("n") < r).crossJoin(F.broadcast(first)).join(scores.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
        rest = rest.withColumn("rank", (F.col("n") + F.row_number().over(Window.partitionBy("qid").orderBy("doc_id"))).cast("int"))
        return best.unionByName(rest.where(F.col("rank") <= r).select("qid", "doc_id", "rank"))

    def ranks(pairs: DataFrame) -> DataFrame:
        found = checkpointed(pairs.select("qid", "doc_id").join(live, "qid").join(scores, ["qid", "doc_id"], "left"))
        key = F.struct((-F.col("score")).alias("s"), F.col("doc_id"))
        asked = found.where("score is not null").groupBy("qid").agg(F.array_sort(F.collect_list(key)).alias("asked"))
        before = F.size(F.filter("asked", lambda x: x < key))
        counts = scores.join(asked, "qid").groupBy("qid", before.alias("before")).agg(F.count("*").alias("n"))
        each = asked.select("qid", F.posexplode("asked").alias("at", "x"))
        scored = each.join(counts, "qid").where("before <= at").groupBy("qid", "x.doc_id").agg(F.sum("n").cast("int").alias("rank"))
        blank = found.where("score is null")
        held = blank.groupBy("qid").agg(F.array_sort(F.collect_list("doc_id")).alias("asked"))
        under = scores.join(held, "qid").groupBy("qid", F.size(F.filter("asked", lambda x: x < F.col("doc_id"))).alias("before")).agg(F.count("*").alias("under"))
        spots = held.select("qid", F.posexplode("asked").alias("at", "doc_id")).join(under, "qid", "left").groupBy("qid", "doc_id", "at").agg(F.coalesce(F.sum(F.when(F.col("before") <= F.col("at"), F.col("under"))), F.lit(0)).alias("under"))
        rest = blank.join(spots, ["qid", "doc_id"]).join(_ordinals(ids), "doc_id").select("qid", "doc_id", (F.col("n") + F.col("nth") - F.col("under") + 1).cast("int").alias("rank"))
        return scored.unionByName(rest)

    return Channel(top, ranks)


def dense_channel(docs: DataFrame, queries: DataFrame) -> Channel:
    """The ranking by cosine of (doc_id, q) with (qid, q). A query without a positive cosine has none."""

    def top(r: int) -> DataFrame:
        best = ranked(cosine_scores(docs, queries, r), r)
        live = best.where("rank = 1 and score > 0").select("qid")
        return best.join(live, "qid", "left_semi").select("qid", "doc_id", "rank")

    def ranks(pairs: DataFrame) -> DataFrame:
        return better_counts(docs, queries, pair_cosines(docs, queries, pairs)).select("qid", "doc_id", (F.col("better") + 1).cast("int").alias("rank"))

    return Channel(top, ranks)


def rrf(channels: dict[str, Channel], k: int = 10) -> DataFrame:
    """(qid, doc_id, rank, score): the ``k`` best by the sum of 1 / (RRF + rank) over the channels, each of which ranks all documents.

    With c channels only documents among the first r = c * (RRF + k) - RRF of one can win: any other has at most c / (RRF + r + 1),
    less than the 1 / (RRF + k) that each of the first ``k`` of a channel has. So the first r of each channel are taken, then the exact
    ranks of these in the other channels.
    """
    depth = len(channels) * (RRF + k) - RRF
    tops = {name: checkpointed(c.top(depth)) for name, c in channels.items()}
    chosen = checkpointed(reduce(DataFrame.unionByName, (t.select("qid", "doc_id") for t in tops.values())).distinct())
    parts = []
    for name, c in channels.items():
        live = tops[name].select("qid").distinct()
        missing = chosen.join(live, "qid", "left_semi").join(tops[name].select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
        parts += [tops[name], c.ranks(checkpointed(missing))]
    rows = reduce(DataFrame.unionByName, (p.select("qid", "doc_id", (1 / (F.lit(RRF) + F.col("rank"))).alias("part")) for p in parts))
    return ranked(rows.groupBy("qid", "doc_id").agg(F.sum("part").alias("score")), k).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


def blend(base: DataFrame, other: DataFrame, depth: int = DEPTH, share: float = 0.7, k: int = 10) -> DataFrame:
    """(qid, doc_id, rank, score, blended): within the first ``depth`` of base order share * base + (1 - share) * other; the rest as it was.

    ``base``: (qid, doc_id, score), ``other`` likewise; a document that other lacks has 0 there.
    """
    first = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "doc_id")
    rows = base.withColumn("base_rank", F.row_number().over(first)).where(F.col("base_rank") <= max(depth, k))
    rows = rows.join(other.select("qid", "doc_id", F.col("score").alias("_other")), ["qid", "doc_id"], "left")
    rows = rows.withColumn("blended", F.when(F.col("base_rank") <= depth, share * F.col("score") + (1 - share) * F.coalesce("_other", F.lit(0.0))))
    order = Window.partitionBy("qid").orderBy((F.col("base_rank") > depth), F.round("blended", 9).desc_nulls_last(), F.when(F.col("base_rank") > depth, F.col("base_rank")), "doc_id")
    out = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("qid", "doc_id", "rank", F.round("score", 6).alias("score"), F.round("blended", 6).alias("blended"))


def combine(wanted: DataFrame, unwanted: DataFrame, penalty: float = 0.7, k: int = 10) -> DataFrame:
    """(qid, doc_id, rank, score): score of the wanted terms minus ``penalty`` times that of the unwanted."""
    rows = wanted.select("qid", "doc_id", "score").unionByName(unwanted.select("qid", "doc_id", (-penalty * F.col("score")).alias("score")))
    return ranked(rows.groupBy("qid", "doc_id").agg(F.sum("score").alias("score")), k).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


def connected(docs: DataFrame, wanted: DataFrame, unwanted: DataFrame, penalty: float = 0.7, k: int = 10) -> DataFrame:
    """(qid, doc_id, rank, score): cosine with the wanted terms less ``penalty`` times that with the unwanted, over all documents.

    Both are products with a document's unit vector, so their difference is one with the difference of the unit query vectors: a search
    for one vector a query. ``docs``: (doc_id, q); ``wanted``, ``unwanted``: (qid, q, norm).
    """
    unit = lambda df, name, w: df.where("norm > 0").select("qid", F.transform("q", lambda x: F.lit(w) * x / F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, y: s + y.cast("double") * y))).alias(name))
    both = unit(wanted, "a", 1.0).join(unit(unwanted, "b", -penalty), "qid", "full")
    mixed = F.when(F.col("b").isNull(), F.col("a")).when(F.col("a").isNull(), F.col("b")).otherwise(F.zip_with("a", "b", lambda x, y: x + y))
    queries = checkpointed(both.select("qid", mixed.alias("q")))
    size = queries.select("qid", F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, y: s + y * y)).alias("size"))
    scores = cosine_scores(docs, queries, k).join(size, "qid").select("qid", "doc_id", (F.col("score") * F.col("size")).alias("score"))
    return ranked(scores, k).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


def fuse_ranks(hits: DataFrame, k: int = 10) -> DataFrame:
    """Fusion over sources of (source, id, rank): a key is source and id, so that one id in two sources is two rows."""
    summed = hits.groupBy("source", "id").agg(F.sum(1 / (F.lit(RRF) + F.col("rank"))).alias("score"), F.min("rank").alias("local_rank"))
    return _fused(summed, k)


def fuse_zscores(hits: DataFrame, k: int = 10) -> DataFrame:
    """Fusion of (source, id, rank, score) by the score's distance from its source's mean in standard deviations; 1 stands for a deviation of 0."""
    source = Window.partitionBy("source")
    mean, spread = F.avg("score").over(source), F.stddev_pop("score").over(source)
    z = (F.col("score") - mean) / F.when(spread > 1e-12, spread).otherwise(1.0)
    return _fused(hits.select("source", "id", F.col("rank").alias("local_rank"), z.alias("score")), k)


def _fused(rows: DataFrame, k: int) -> DataFrame:
    order = Window.orderBy(F.round("score", 9).desc(), "source", "local_rank", "id")
    best = rows.orderBy(F.round("score", 9).desc(), "source", "local_rank", "id").limit(k)  # the report; only k rows reach the one window
    return best.withColumn("position", F.row_number().over(order)).select("position", "source", "id", "local_rank", F.round("score", 6).alias("score"))


def by_source(hits: DataFrame) -> DataFrame:
    """(source, n, best): how many hits each source has, and its best score."""
    return hits.groupBy("source").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"))


def confidence(scores: DataFrame, k: int = 10) -> DataFrame:
    """(qid, nqc): deviation of the ``k`` best scores over the size of the mean of all; 0 if that mean is 0."""
    return _confidence(scores, scores.groupBy("qid").agg(F.abs(F.avg("score")).alias("mean")), k)


def _confidence(scores: DataFrame, means: DataFrame, k: int) -> DataFrame:
    best = ranked(scores, k).groupBy("qid").agg(F.stddev_pop("score").alias("spread"))
    ratio = F.when(F.col("mean") > 0, F.coalesce("spread", F.lit(0.0)) / F.col("mean")).otherwise(0.0)
    return means.join(best, "qid", "left").select("qid", F.round(ratio, 6).alias("nqc"))


def bm25_confidence(arrays: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``confidence`` of BM25, from each task's best and sums."""
    found = scorer(arrays, queries)
    return confidence(_bm25_by_joins(arrays, queries), k) if found is None else _confidence(found.top(k), found.means().select("qid", F.abs("mean").alias("mean")), k)


def mixed_with_vectors(arrays: DataFrame, queries: DataFrame, vectors: DataFrame, asked: DataFrame, mixes: list[tuple[float, float]], k: int = 10) -> DataFrame | None:
    """(nth, qid, doc_id, score), ``scorer.mixed`` by each pair of weights; None if queries or their vectors are too many for it."""
    found = scorer(arrays, queries)
    return None if found is None else mixed(found, vectors, asked, mixes, False, k)


def convex_with_vectors(arrays: DataFrame, queries: DataFrame, vectors: DataFrame, asked: DataFrame, weights: tuple[float, float], k: int = 10) -> DataFrame:
    """``convex`` of BM25 and of the cosine of documents (doc_id, vec) with queries (qid, vec), each document scored in one place."""
    found = scorer(arrays, queries)
    rows = None if found is None else mixed(found, vectors, asked, [weights], True, k)
    if rows is None:
        return convex({"bm25": (bm25_scores(arrays, queries), weights[0]), "dense": (cosine_scores(vectors, asked, None, doc_vec="vec", query_vec="vec"), weights[1])}, k)
    return ranked(rows, k).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


def convex(channels: dict[str, tuple[DataFrame, float]], k: int = 10) -> DataFrame:
    """(qid, doc_id, rank, score): weighted sum of each channel's z-scores within its query, from one row of moments a query."""
    parts = []
    for scores, weight in channels.values():
        moments = scores.groupBy("qid").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread"))
        z = weight * (F.col("score") - F.col("mean")) / F.when(F.col("spread") > 1e-12, F.col("spread")).otherwise(1.0)
        parts.append(scores.join(moments, "qid").select("qid", "doc_id", z.alias("score")))
    return ranked(reduce(DataFrame.unionByName, parts).groupBy("qid", "doc_id").agg(F.sum("score").alias("score")), k).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))
