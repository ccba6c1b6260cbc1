"""Token tables and corpus statistics: document frequencies, collocations, signed counts, postings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from corvane.functions import text as T
from corvane.operators.company import Company, company
from corvane.operators.lexicon import Lexicon, lexicon, numbers
from corvane.session import checkpointed, join_checked

#: A bigram is a collocation from so many occurrences and so much pointwise mutual information on.
MIN_PAIRS, MIN_PMI = 5, 3.0
#: Bytes of pairs that are sent along to be merged, 24 a pair.
PAIRS_LIMIT = 1 << 28


def token_arrays(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, kind_col: str | None = None) -> DataFrame:
    """(doc_id, tokens): of the text, after those of the kind and the path where these are given."""
    parts = [T.tokens(F.col(kind_col))] if kind_col else []
    parts += [T.path_tokens(F.col(path_col))] if path_col else []
    parts.append(T.tokens(F.col(text_col)))
    return docs.select(F.col(id_col).alias("doc_id"), (F.concat(*parts) if len(parts) > 1 else parts[0]).alias("tokens"))


def token_rows(arrays: DataFrame) -> DataFrame:
    """(doc_id, pos, token), a row for each token."""
    return arrays.select("doc_id", F.posexplode("tokens").alias("pos", "token"))


def silent_fallback(docs: DataFrame, path_col: str, text_col: str = "text") -> Column:
    """The text, or the words of the path for a document that was read and is blank."""
    return F.when(F.length(F.trim(F.coalesce(F.col(text_col), F.lit("")))) > 0, F.col(text_col)).otherwise(F.array_join(T.path_tokens(F.col(path_col)), " "))


def term_counts(arrays: DataFrame) -> DataFrame:
    """(doc_id, token, tf)."""
    return arrays.select("doc_id", F.explode("tokens").alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


def vocabulary(arrays: DataFrame) -> DataFrame:
    """(token, df, cf): documents and occurrences of each token. A document is a row.

    A row's tokens are sorted, and the first of a kind counts for df; so one aggregation by token does, with partial sums.
    """
    rows = arrays.select(F.sort_array("tokens").alias("s"))
    each = F.transform("s", lambda t, i: F.struct(t.alias("token"), F.when((i == 0) | (F.col("s")[F.greatest(i - 1, F.lit(0))] != t), 1).otherwise(0).alias("first")))
    return rows.select(F.explode(each).alias("e")).select("e.*").groupBy("token").agg(F.sum("first").alias("df"), F.count("*").alias("cf"))


def vocabulary_from_counts(counts: DataFrame) -> DataFrame:
    """``vocabulary`` from (doc_id, token, tf), in one aggregation; doc_id must be unique."""
    return counts.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def grid_idf(n: Column, df: Column) -> Column:
    """ln(1 + N / (1 + df))."""
    return F.log(1 + n / (1 + df))


def bm25_idf(n: Column, df: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5))."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def with_idf(vocab: DataFrame, arrays: DataFrame) -> DataFrame:
    """vocab with idf as the grid weighs words; the number of documents is one row, so its join is a broadcast."""
    total = arrays.agg(F.count("*").alias("_n"))
    return vocab.crossJoin(F.broadcast(total)).select(*vocab.columns, grid_idf(F.col("_n"), F.col("df")).alias("idf"))


def length_stats(arrays: DataFrame) -> DataFrame:
    """(n_docs, n_tokens, avgdl, max_tokens)."""
    size = F.size("tokens")
    return arrays.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("n_tokens"), F.avg(size).alias("avgdl"), F.max(size).cast("bigint").alias("max_tokens"))


def bigrams(arrays: DataFrame) -> DataFrame:
    """(a, b) of neighbouring tokens, without a shuffle."""
    pairs = F.arrays_zip(F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0))).alias("a"), F.slice("tokens", 2, F.greatest(F.size("tokens"), F.lit(1))).alias("b"))
    return arrays.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def collocations(arrays: DataFrame, min_pairs: int = MIN_PAIRS, min_pmi: float = MIN_PMI) -> DataFrame:
    """(a, b, n_ab, pmi): bigrams without stopwords, frequent and more so than chance; all tokens count in the total."""
    return _collocations(arrays, company(arrays, 1), min_pairs, min_pmi)


def _collocations(arrays: DataFrame, found: Company | None, min_pairs: int, min_pmi: float) -> DataFrame:
    """``collocations``, the bigrams counted by number and in packed runs, or by name if there are too many words."""
    if found is None:
        pairs = bigrams(arrays).where(~T.is_stopword(F.col("a")) & ~T.is_stopword(F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= min_pairs)
    else:
        words, shared = found.lex.words, found.lex.names

        def frequent(keys: np.ndarray, weights: list[np.ndarray]) -> pa.Table:
            some = weights[0] >= min_pairs
            a, b = (shared.value.take(pa.array(x)).cast(pa.string()) for x in (keys[some] // words, keys[some] % words))
            return pa.table({"a": a, "b": b, "n_ab": pa.array(weights[0][some])})

        pairs = checkpointed(found.pairs(False, frequent, "a string, b string, n_ab bigint", ordered=True))
    singles = arrays.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    total = arrays.agg(F.sum(F.size("tokens")).alias("_total"))
    both = pairs.join(singles.select(F.col("token").alias("a"), F.col("n").alias("n_a")), "a").join(singles.select(F.col("token").alias("b"), F.col("n").alias("n_b")), "b").crossJoin(F.broadcast(total))
    pmi = F.log(F.col("n_ab").cast("double") * F.col("_total") / (F.col("n_a").cast("double") * F.col("n_b")))
    return both.withColumn("pmi", pmi).where(F.col("pmi") >= min_pmi).select("a", "b", "n_ab", "pmi")


def merged_by_collocations(arrays: DataFrame) -> DataFrame:
    """``merge_collocations`` by the corpus's own, its words numbered once."""
    found = company(arrays, 1)
    return merge_collocations(arrays, _collocations(arrays, found, MIN_PAIRS, MIN_PMI), None if found is None else found.lex)


def merge_collocations(arrays: DataFrame, pairs: DataFrame, lex: Lexicon | None = None) -> DataFrame:
    """(doc_id, tokens) with the pairs joined by "_", from left to right without overlap.

    In a run of places that begin a pair, the first, third, fifth ... merge. A document is merged where it is if the pairs can be sent along.
    """
    lex = lexicon(arrays) if lex is None else lex
    pairs = checkpointed(pairs.select("a", "b"))  # counted, then collected or joined
    if lex is None or 24 * pairs.count() > PAIRS_LIMIT:
        return _merged_by_windows(arrays, pairs)
    asked = pairs.select(*(F.xxhash64(F.lit(lex.seed), c) for c in ("a", "b"))).toArrow()
    a, b = (numbers(lex.places.value, c.to_numpy()).astype(np.int64) for c in asked.columns)
    keys = np.sort((a * lex.words + b)[(a >= 0) & (b >= 0)])
    shared, places, words = arrays.sparkSession.sparkContext.broadcast(keys), lex.places, lex.words

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        for batch in it:
            column, hashed = batch.column(1), batch.column(2)
            offsets = column.offsets.to_numpy()
            flat, ids = column.flatten(), numbers(places.value, hashed.flatten().to_numpy()).astype(np.int64)
            n = np.diff(offsets)
            place = np.arange(len(ids))
            last = np.zeros(len(ids), bool)
            last[(offsets[1:] - offsets[0] - 1)[n > 0]] = True
            pair = ids * words + np.append(ids[1:], 0)
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            hit = ~last & (keys[at] == pair) if len(keys) else last & False
            # since the last place that begins no pair; the end of a document never does
            reset = np.maximum.accumulate(np.where(hit, -1, place)) if len(ids) else place
            starts = hit & ((place - reset) % 2 == 1)
            taken = np.append(False, starts[:-1]) if len(ids) else starts
            kept = np.flatnonzero(~taken)
            joined = pc.binary_join_element_wise(flat.take(pa.array(np.flatnonzero(starts))), flat.take(pa.array(np.flatnonzero(starts) + 1)), "_")
            source = np.where(starts[kept], len(ids) + np.cumsum(starts[kept]) - 1, kept)
            ends = np.append(0, np.cumsum(~taken))[offsets - offsets[0]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays([flat, joined]).take(pa.array(source)))], ["doc_id", "tokens"])

    schema = ST.StructType([arrays.schema["doc_id"], ST.StructField("tokens", ST.ArrayType(ST.StringType()))])
    return arrays.select("doc_id", "tokens", lex.hashed(F.col("tokens")).alias("h")).mapInArrow(batches, schema)


def _merged_by_windows(arrays: DataFrame, pairs: DataFrame) -> DataFrame:
    """``merge_collocations`` of any number of words and pairs; doc_id must be unique."""
    rows = token_rows(arrays.select("doc_id", F.col("tokens")))
    doc = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("next", F.lead("token").over(doc))
    pairs = pairs.select(F.col("a").alias("token"), F.col("b").alias("next"), F.lit(1).alias("hit"))
    marked = join_checked(rows, pairs, ["token", "next"], "left", row_bytes=64)
    run = Window.partitionBy("doc_id").orderBy("pos")
    marked = marked.withColumn("reset", F.max(F.when(F.col("hit").isNull(), F.col("pos"))).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    starts = F.col("hit").isNotNull() & ((F.col("pos") - F.coalesce("reset", F.lit(-1))) % 2 == 1)
    marked = marked.withColumn("starts", starts).withColumn("taken", F.coalesce(F.lag("starts").over(run), F.lit(False)))
    kept = marked.where(~F.col("taken")).select("doc_id", "pos", F.when(F.col("starts"), F.concat_ws("_", "token", "next")).otherwise(F.col("token")).alias("token"))
    merged = kept.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))
    return arrays.select("doc_id").join(merged, "doc_id", "left").select("doc_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def compile_lexicon(lexicon: DataFrame) -> DataFrame:
    """(key ARRAY, value ARRAY) from (key, value) joined by "_"; keys with a stopword and values of stopwords alone go."""
    rows = lexicon.select(F.split("key", "_").alias("key"), F.split("value", "_").alias("value"))
    return rows.where(~F.exists("key", T.is_stopword) & ~F.forall("value", T.is_stopword))


def merge_lexicons(core: DataFrame, extra: DataFrame) -> DataFrame:
    """Both (key, value) tables; core wins where both have a key."""
    return core.unionByName(extra.join(core.select("key"), "key", "left_anti").select("key", "value"))


def import_dictionary(rows: DataFrame, core: DataFrame, excluded: Iterable[str] = (), longest: int = 4, least: float = 0.0) -> DataFrame:
    """(key, value) joined by "_", from a bilingual dictionary of (word, translations, score), translations with " | " between.

    Rows under ``least`` aren't read. Of a word's rows the one with most score counts, then the first by translations; of these the first
    translation. Keys and values are ``longest`` tokens at most, of signs that texts have. Single words of ``excluded``, keys of ``core``
    (key, value) and single words that some translation holds, unless they translate to themselves, are left out.
    """
    def clean(c: Column) -> Column:
        words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
        found = T.tokens(F.array_join(words, " "))
        return F.when((F.size(words) > 0) & (F.size(words) <= longest) & (found == words), words)

    read = rows.where(F.col("score") >= least).select("word", "translations", "score", clean(F.col("word")).alias("key"), F.split("translations", r"\|").alias("all"))
    foreign = read.select(F.explode("all").alias("t")).select(F.explode(clean(F.trim("t"))).alias("_foreign")).distinct()
    read = read.withColumn("value", clean(F.trim(F.col("all")[0]))).where("key is not null and value is not null")
    single = F.size("key") == 1
    read = read.where(~(single & F.col("key")[0].isin(list(excluded)))) if excluded else read
    read = read.select(F.array_join("key", "_").alias("key"), F.array_join("value", "_").alias("value"), F.when(single, F.col("key")[0]).alias("_word"), "word", "score", "translations")
    read = read.join(core.select("key"), "key", "left_anti").join(foreign, F.col("_word") == F.col("_foreign"), "left").where(F.col("_foreign").isNull() | (F.col("key") == F.col("value")))
    return read.groupBy("key").agg(F.min_by("value", F.struct("word", -F.col("score"), "translations")).alias("value"))


def canonical(arrays: DataFrame, entries: Iterable[tuple[list[str], list[str]]], longest: int = 4) -> DataFrame:
    """(doc_id, tokens) with lexicon keys replaced, from left to right, the longest window of up to ``longest`` tokens first.

    ``entries`` are supplied by the caller and bounded: more than 16 MB of them are refused.
    """
    table = {tuple(k): list(v) for k, v in entries}
    if sum(len(w) for k, v in table.items() for w in (*k, *v)) > 16 << 20:
        raise ValueError("the lexicon is too large to send to each executor")
    single = {k[0]: v for k, v in table.items() if len(k) == 1}
    if len(single) == len(table):
        if not table:
            return arrays.select("doc_id", "tokens")
        lookup = F.create_map(*(x for k, v in single.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
        return arrays.select("doc_id", F.flatten(F.transform("tokens", lambda t: F.coalesce(lookup[t], F.array(t)))).alias("tokens"))
    sizes = sorted({len(k) for k in table if len(k) <= longest}, reverse=True)

    @F.pandas_udf("array<string>")
    def replaced(column):
        def one(words):
            words, out, i = list(words), [], 0
            while i < len(words):
                for n in sizes:
                    value = table.get(tuple(words[i : i + n]))
                    if value is not None and i + n <= len(words):
                        out += value
                        i += n
                        break
                else:
                    out.append(words[i])
                    i += 1
            return out

        return column.map(one)

    return arrays.select("doc_id", replaced("tokens").alias("tokens"))


def signed_counts(arrays: DataFrame) -> DataFrame:
    """(doc_id, token, negated, tf): a negator flips the next content word; stopwords between them don't matter."""
    kept = F.filter("tokens", lambda t: T.is_negator(t) | ~T.is_stopword(t))
    rows = arrays.select("doc_id", kept.alias("kept"))
    before = F.concat(F.array(F.lit("")), F.slice("kept", 1, F.greatest(F.size("kept") - 1, F.lit(0))))
    pairs = rows.select("doc_id", F.explode(F.arrays_zip(F.col("kept").alias("token"), before.alias("before"))).alias("p")).select("doc_id", "p.token", "p.before")
    pairs = pairs.where(F.col("token").isNotNull() & ~T.is_negator(F.col("token")))
    return pairs.groupBy("doc_id", "token", T.is_negator(F.col("before")).alias("negated")).agg(F.count("*").alias("tf"))


def unknown_fragments(queries: DataFrame, vocab: DataFrame, n: int = 3) -> DataFrame:
    """(qid, tokens): a query's tokens and, for those that no document has, their character fragments. ``queries``: (qid, tokens)."""
    words = queries.select("qid", F.explode(F.array_distinct("tokens")).alias("token"))
    unknown = words.join(vocab.select("token"), "token", "left_anti").groupBy("qid").agg(F.collect_set("token").alias("unknown"))
    rows = queries.join(unknown, "qid", "left")
    extra = F.flatten(F.transform(F.filter("tokens", lambda t: F.coalesce(F.array_contains("unknown", t), F.lit(False))), lambda t: T.fragments(t, n)))
    return rows.select("qid", F.concat("tokens", extra).alias("tokens"))
