"""An index as a folder of Parquet tables: built at once or appended to, opened lazily, searched by any circuit."""

from __future__ import annotations

import hashlib
import json
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import grammar, questions
from corvane.functions import text as T
from corvane.operators import cooc, corpus, facets, relations, retrieve, typed, vectors
from corvane.session import checkpointed

DEFAULTS = {"dim": vectors.DIM, "fragments": 0, "paths": True, "kinds": False, "grids": True, "facets": True, "relations": True, "grammar": False, "pairs": False}
_TABLES = ("arrays", "counts", "lengths", "signed", "facets", "edges", "roles", "pairs")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and renamed, so that a reader sees the old or the new."""
    fs, p = _fs(spark, path)
    _, tmp = _fs(spark, f"{path}.{uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    fs.rename(tmp, p)


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r[0] for r in spark.read.text(path).collect())  # one small file


class Index:
    """Tables of one index. Every append is a generation of its own; meta.json names those that count and is written last.

    Counts, postings and facets add up: an index that was appended to equals one built from all documents at once. Document grids and
    idf are derived from them when asked for, with the corpus as it is then.
    """

    def __init__(self, spark: SparkSession, path: str, meta: dict):
        self.spark, self.path, self.meta = spark, path, meta

    @classmethod
    def build(cls, spark: SparkSession, path: str, docs: DataFrame, **options) -> Index:
        """From (doc_id STRING, text) with unique ids; an empty corpus is refused."""
        unknown = set(options) - set(DEFAULTS)
        if unknown:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        index = cls(spark, path, {"options": DEFAULTS | options, "generations": [], "docs": 0})
        vectors.grid_dim(index.meta["options"]["dim"], 0, False)
        return index.append(docs)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        text = _read_text(spark, f"{path}/meta.json")
        if text is None:
            raise ValueError(f"no index in {path}")
        index = cls(spark, path, json.loads(text))
        n, distinct = index.table("lengths").agg(F.count("*"), F.count_distinct("doc_id")).first()
        if n != index.meta["docs"] or n != distinct:
            raise ValueError(f"torn index: {distinct} documents of {index.meta['docs']}")
        for name in _TABLES:
            index.table(name)  # a channel whose folder is gone is an error here, not in the first search
        return index

    def append(self, docs: DataFrame) -> Index:
        """Adds documents whose ids are new; nothing is changed if one isn't."""
        o, name = self.meta["options"], f"g{len(self.meta['generations']):05d}-{uuid4().hex[:8]}"
        docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
        kind = T.document_kind(F.col("doc_id"), F.length(F.trim(F.coalesce("text", F.lit("")))))
        arrays = corpus.token_arrays(docs.withColumn("kind", kind), path_col="doc_id" if o["paths"] else None, kind_col="kind" if o["kinds"] else None)
        if o["fragments"]:
            arrays = arrays.select("doc_id", T.with_fragments(F.col("tokens"), o["fragments"]).alias("tokens"))
        at = f"{self.path}/{name}"
        arrays.write.parquet(f"{at}/arrays")
        arrays = self.spark.read.parquet(f"{at}/arrays")
        n, distinct = arrays.agg(F.count("*"), F.count_distinct("doc_id")).first()
        if not n:
            raise ValueError("no documents")
        if n != distinct:
            raise ValueError("a doc_id is there twice")
        if self.meta["generations"] and self.table("lengths").join(arrays.select("doc_id"), "doc_id", "left_semi").limit(1).count():
            raise ValueError("a doc_id is there already")
        retrieve.postings(arrays).write.parquet(f"{at}/counts")
        arrays.select("doc_id", F.size("tokens").alias("dl")).write.parquet(f"{at}/lengths")
        corpus.signed_counts(arrays).write.parquet(f"{at}/signed")
        if o["pairs"]:
            cooc.pair_weights(arrays).write.parquet(f"{at}/pairs")
        if o["facets"]:
            facets.extract(docs.withColumn("path", F.col("doc_id"))).write.parquet(f"{at}/facets")
        if o["relations"]:
            relations.path_edges(docs).write.parquet(f"{at}/edges")
        if o["grammar"]:
            docs.select("doc_id", F.explode(grammar.roles(F.col("text"))).alias("e")).select("doc_id", "e.role", "e.entity").write.parquet(f"{at}/roles")
        self.meta = self.meta | {"generations": [*self.meta["generations"], name], "docs": self.meta["docs"] + n}
        _write_text(self.spark, f"{self.path}/meta.json", json.dumps(self.meta, sort_keys=True))
        return self

    def table(self, name: str) -> DataFrame | None:
        """A channel's table over all generations; None if the index has no such channel."""
        channel = {"edges": "relations", "roles": "grammar"}.get(name, name)
        if name not in _TABLES:
            raise ValueError(f"no table {name}")
        if not self.meta["options"].get(channel, True):
            return None
        rows = self.spark.read.parquet(*(f"{self.path}/{g}/{name}" for g in self.meta["generations"]))
        return cooc.merge_pairs(rows, rows.limit(0)) if name == "pairs" else rows

    def arrays(self) -> DataFrame:
        return self.table("arrays")

    def vocabulary(self) -> DataFrame:
        return corpus.with_idf(corpus.vocabulary_from_counts(self.table("counts")), self.table("lengths"))

    def grids(self) -> DataFrame:
        """(doc_id, q, norm) with the idf of the index as it is: encoded once for a list of generations, then read."""
        state = hashlib.sha256("/".join(self.meta["generations"]).encode()).hexdigest()[:16]
        at = f"{self.path}/grids-{state}"
        fs, p = _fs(self.spark, at)
        if not fs.exists(p):
            _, tmp = _fs(self.spark, f"{at}.{uuid4().hex}")
            vectors.encode(self.table("signed"), self.vocabulary(), self.table("lengths"), self.meta["options"]["dim"]).write.parquet(tmp.toString())
            if not fs.rename(tmp, p):
                fs.delete(tmp, True)
        return self.spark.read.parquet(at)

    def _queries(self, queries: DataFrame, cleaned: bool) -> DataFrame:
        text = questions.clean(F.col("text"))["text"] if cleaned else F.col("text")
        rows = queries.select("qid", T.tokens(text).alias("tokens"))
        n = self.meta["options"]["fragments"]
        return corpus.unknown_fragments(rows, self.vocabulary(), n) if n else rows

    def _query_grids(self, queries: DataFrame) -> DataFrame:
        arrays = queries.select(F.col("qid").alias("doc_id"), "tokens")
        grids = vectors.encode(corpus.signed_counts(arrays), self.vocabulary(), arrays, self.meta["options"]["dim"])
        return checkpointed(grids.where("norm > 0").select(F.col("doc_id").alias("qid"), "q", "norm"))

    def _bm25(self, queries: DataFrame) -> DataFrame:
        return retrieve.bm25_from_postings(self.table("counts"), self.table("lengths"), queries)

    def search(self, queries: DataFrame, k: int = 10, method: str = "bm25", cleaned: bool = False, kind: str | None = None, recency: float = 0.0, codes: list[str] = (), rerank: DataFrame | None = None, boost: bool = False) -> DataFrame:
        """Hits of (qid, text) by "bm25", "grid", "fusion" of both, "typed", "connectors" or "grammar"; facets are applied to the pool if asked.

        ``boost``: documents that hold a code that is in the query come first, each query by its own codes. ``rerank``: scores (qid,
        doc_id, score) that the first hits are blended with. Connectors, grammar and typed go with neither types, recency nor codes.
        """
        if k < 1:
            raise ValueError("k is at least 1")
        wants = kind is not None or recency > 0 or bool(codes) or boost
        if method in ("connectors", "grammar", "typed") and wants:
            raise ValueError(f"{method} doesn't go with types, recency or codes")
        pool = facets.pool_size(k, kind is not None, recency > 0, bool(codes) or boost)
        depth = pool if rerank is None else max(pool, retrieve.DEPTH)
        if method == "bm25":
            hits = vectors.ranked(self._bm25(self._queries(queries, cleaned)), depth).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))
        elif method == "grid":
            hits = vectors.cosine_topk(self.grids(), self._query_grids(self._queries(queries, cleaned)), depth)
        elif method == "fusion":
            q = self._queries(queries, cleaned)
            hits = retrieve.rrf({"bm25": retrieve.sparse_channel(self._bm25(q), self.table("lengths")), "grid": retrieve.dense_channel(self.grids(), self._query_grids(q))}, depth)
        elif method == "connectors":
            wanted, unwanted = (self._query_grids(queries.select("qid", T.tokens(questions.wanted(F.col("text"), s)).alias("tokens"))) for s in (1, -1))
            return retrieve.connected(self.grids(), wanted, unwanted, k=k)
        elif method == "typed":
            counts = self.table("counts").withColumn("grid", typed.grid_of(F.col("token")))
            q = self._queries(queries, cleaned).select("qid", F.explode("tokens").alias("token")).groupBy("qid", "token").agg(F.count("*").alias("qtf"))
            return typed.typed_search(counts, self.vocabulary(), q, k)
        elif method == "grammar":
            if self.table("roles") is None:
                raise ValueError("the index has no grammar")
            grids = self._query_grids(self._queries(queries, cleaned))
            asked = queries.select("qid", F.explode(grammar.roles(F.col("text"))).alias("e")).select("qid", "e.role", "e.entity")
            return grammar_blend(self.grids(), grids, self.table("roles"), asked, k)
        else:
            raise ValueError(f"no method {method}")
        if rerank is not None:
            hits = retrieve.blend(hits, rerank, k=pool).select("qid", "doc_id", "rank", F.coalesce("blended", "score").alias("score"))
        if not wants:
            return hits
        if self.table("facets") is None:
            raise ValueError("the index has no facets")
        asked = queries.select("qid", T.codes(F.col("text")).alias("codes")) if boost else None
        return facets.apply(hits, self.table("facets"), k, kind, recency, codes, asked)

    def ask(self, queries: DataFrame) -> DataFrame:
        """(qid, text, route): advice on how to answer each question; nothing is done on it."""
        return queries.select("qid", "text", questions.route(F.col("text")).alias("route"))


def grammar_blend(docs: DataFrame, queries: DataFrame, roles: DataFrame, asked: DataFrame, k: int = 10, share: float = 0.5) -> DataFrame:
    """(qid, doc_id, rank, score): the grid's cosine plus ``share`` times the cosine of the sets of (role, entity) of query and document.

    Only documents with an entity of the query gain by it, so the best are among these and the first ``k`` by the grid alone.
    """
    d = roles.distinct()
    size = d.groupBy("doc_id").agg(F.sqrt(F.count("*")).alias("dn"))
    q = asked.distinct()
    qsize = q.groupBy("qid").agg(F.sqrt(F.count("*")).alias("qn"))
    both = q.join(d, ["role", "entity"]).groupBy("qid", "doc_id").agg(F.count("*").alias("same")).join(size, "doc_id").join(qsize, "qid")
    extra = checkpointed(both.select("qid", "doc_id", (share * F.col("same") / (F.col("dn") * F.col("qn"))).alias("extra")))
    first = vectors.ranked(vectors.cosine_scores(docs, queries, k), k).select("qid", "doc_id", "score")
    base = first.unionByName(vectors.pair_cosines(docs, queries, extra.join(first, ["qid", "doc_id"], "left_anti")))
    # a query of entities alone has no grid: then these decide
    rows = base.join(extra, ["qid", "doc_id"], "full").select("qid", "doc_id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("extra", F.lit(0.0))).alias("score"))
    return vectors.ranked(rows, k).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


def across(indexes: dict[str, Index], queries: DataFrame, k: int = 10, depth: int = 20, fusion: str = "rrf") -> DataFrame:
    """One query over several indexes: "rrf" or "znorm" over (source, id)."""
    if not indexes:
        raise ValueError("no index")
    hits = reduce(DataFrame.unionByName, (i.search(queries, depth).select(F.lit(n).alias("source"), F.col("doc_id").alias("id"), "rank", "score") for n, i in indexes.items()))
    return retrieve.fuse_zscores(hits, k) if fusion == "znorm" else retrieve.fuse_ranks(hits, k)
