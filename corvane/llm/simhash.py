"""SimHash near-duplicates: fingerprints split into blocks of which close pairs must share one, verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm._text import WORD_LUT, buffers, mix, slices, span_hashes, word_bounds
from corvane.operators.graph import components
from corvane.session import checkpointed, join_checked

#: Blocks of a fingerprint, and the signs in each.
BLOCKS, ROWS = 64, 3
#: Bits of a sign; a block is a whole number of ROWS * SIGN_BITS of them.
SIGN_BITS = 21
#: Signs of two close fingerprints that may differ: fewer than there are blocks, so at least one block is whole in both.
MAX_DISTANCE = BLOCKS - 1
#: Two low bits of each sign, 32 signs to a number: where these differ, the signs do.
SKETCH = [f"s{i}" for i in range(BLOCKS * ROWS // 32)]
_ORDERS = mix(np.arange(1, BLOCKS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_FIRST, _LAST, _PAIR = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557), np.uint64(0xD6E8FEB86659FD93)


def _shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash), in order of documents: two neighbouring words each, where a text's begin and end count as words."""
    low = WORD_LUT[data]
    starts, ends, doc = word_bounds(low, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = span_hashes(low, starts, ends)
    opens = np.r_[True, doc[1:] != doc[:-1]]
    closes = np.r_[opens[1:], True]
    before = np.where(opens, _FIRST, np.r_[np.uint64(0), words[:-1]])
    pairs = mix(before * _PAIR + words)
    # each text has one shingle more than words: its last word with the end, put behind the others
    n, extra = len(doc), np.flatnonzero(closes)
    out, where = np.empty(n + len(extra), np.uint64), np.arange(n) + np.cumsum(opens) - 1
    out[where] = pairs
    out[where[extra] + 1] = mix(words[extra] * _PAIR + _LAST)
    at = np.empty(n + len(extra), np.int64)
    at[where], at[where[extra] + 1] = doc, doc[extra]
    return at, out


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents x BLOCKS whole numbers of ROWS signs, has words) for texts in ``data``, whose offsets begin at 0.

    Each sign has an order of its own over all shingles, and takes its bits from the shingle of the text that comes first in it: two
    texts differ in a sign with a probability that is the share of the shingles of either that they don't have in common.
    """
    doc, hashes = _shingles(data, offsets)
    out, some = np.zeros((len(offsets) - 1, BLOCKS), np.uint64), np.zeros(len(offsets) - 1, bool)
    if not len(doc):
        return out.view(np.int64), some
    heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    some[doc[heads]] = True
    for block in range(BLOCKS):
        value = np.zeros(len(heads), np.uint64)
        for order in _ORDERS[block * ROWS : (block + 1) * ROWS]:
            value = (value << np.uint64(SIGN_BITS)) | (mix(np.minimum.reduceat(hashes * order, heads)) >> np.uint64(64 - SIGN_BITS))
        out[doc[heads], block] = value
    return out.view(np.int64), some


def sketches(prints: np.ndarray) -> np.ndarray:
    """Fingerprints x len(SKETCH) whole numbers."""
    low = np.stack([(prints.view(np.uint64) >> np.uint64(SIGN_BITS * k)) & np.uint64(3) for k in range(ROWS)], 2).reshape(len(prints), len(SKETCH), 32)
    return (low << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(2, dtype=np.uint64).view(np.int64)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = buffers(batch.column(1))
        for a, b in slices(offsets):
            prints, some = fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            prints = np.ascontiguousarray(prints[some])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(prints) + 1, dtype=np.int32) * BLOCKS), pa.array(prints.ravel()))
            same = pa.array([xxhash.xxh3_128_digest(p) for p in prints], pa.binary())
            short = sketches(prints)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).filter(pa.array(some)), same, lists, *(pa.array(np.ascontiguousarray(c)) for c in short.T)], ["doc_id", "same", "blocks", *SKETCH])


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, same, blocks, s0, s1, ...) of the documents that have an id and a word: the fingerprint, its digest of 128 bits and its sketch."""
    kinds = [("doc_id", docs.schema["doc_id"].dataType), ("same", T.BinaryType()), ("blocks", T.ArrayType(T.LongType())), *((c, T.LongType()) for c in SKETCH)]
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    return rows.mapInArrow(_fingerprint_batches, T.StructType([T.StructField(*k) for k in kinds]))


def distance(a: Column, b: Column) -> Column:
    """The Hamming distance of two fingerprints, in signs."""
    masks = [((1 << SIGN_BITS) - 1) << (SIGN_BITS * k) for k in range(ROWS)]

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        return sum((F.when(z.bitwiseAND(F.lit(m).cast("bigint")) != 0, 1).otherwise(0) for m in masks), F.lit(0))

    return F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)


def _at_least(a: str, b: str) -> Column:
    """A bound that the distance of two fingerprints isn't below, from the sketches a.s0, ... and b.s0, ..."""
    total = F.lit(0)
    for c in SKETCH:
        z = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        total = total + F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(0x5555555555555555).cast("bigint")))
    return total


def close_pairs(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Edges (a, b) that connect the same fingerprints as all pairs that differ in ``max_distance`` signs at most.

    ``prints``: (id, blocks, s0, s1, ...); an id with several fingerprints stands for all of them. ``max_distance`` is below BLOCKS, so
    such a pair has a block in common (pigeonhole), and joining on blocks misses none. A member of a block's bucket is compared with the
    bucket's least id; only those too far from it are compared with the whole bucket, so thousands of close copies cost a row each, not
    a square. Sketches travel with the buckets and rule out most unlike pairs where they meet; what is left is verified with the whole
    fingerprints. Nothing is capped; a bucket is met by aggregation and joins alone, which split it if it is large.
    """
    if not 0 <= max_distance < BLOCKS:
        raise ValueError("the distance must be below the number of blocks")
    sketch = prints.select("id", *SKETCH)
    keyed = prints.select("id", F.explode(F.transform("blocks", lambda x, i: F.xxhash64(i, x))).alias("key"))
    leads = keyed.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead")
    led = checkpointed(keyed.join(leads, "key").where("id <> lead").join(sketch, "id"))
    a, b = prints.select(F.col("id").alias("x"), F.col("blocks").alias("xs")), prints.select(F.col("id").alias("y"), F.col("blocks").alias("ys"))

    def verified(pairs: DataFrame) -> DataFrame:
        return pairs.distinct().join(a, "x").join(b, "y").where(distance(F.col("xs"), F.col("ys")) <= max_distance).select("x", "y")

    may = _at_least("p", "q") <= max_distance
    p, q = led.alias("p"), sketch.alias("q")
    close = checkpointed(verified(p.join(q, F.col("p.lead") == F.col("q.id")).where(may).select(F.col("p.id").alias("x"), F.col("p.lead").alias("y"))))
    far = led.join(close, (led["id"] == close["x"]) & (led["lead"] == close["y"]), "left_anti").alias("p")
    both = far.join(led.alias("q"), F.col("p.key") == F.col("q.key")).where((F.col("p.id") != F.col("q.id")) & may)
    more = verified(both.select(F.greatest("p.id", "q.id").alias("x"), F.least("p.id", "q.id").alias("y")))
    return close.unionByName(more).toDF("a", "b")


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, kept_id) of every document that goes, as a near or exact copy of the group's least doc_id, which stays.

    Groups are the connected components of all pairs whose fingerprints differ in ``max_distance`` of the BLOCKS * ROWS signs at most.
    Case, punctuation and white space don't count. Documents without a word (null and empty texts among them) or with a null doc_id are
    in no group. doc_id keeps its type. Rows with one doc_id are one document, which is in the groups of all its texts: repeated rows
    change nothing. Other columns are not read, whatever their names. An empty table gives an empty result. Texts are read whole,
    however short or long.
    """
    signed = checkpointed(fingerprint_table(docs))
    prints = checkpointed(signed.groupBy("same").agg(F.min("doc_id").alias("lead"), *(F.first(c).alias(c) for c in ("blocks", *SKETCH))))
    member = signed.select("doc_id", "same").join(prints.select("same", F.col("lead").alias("id")), "same").select("doc_id", "id").distinct()
    several = member.groupBy("doc_id").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    linked = several.join(member, "doc_id").where("a <> id").select("a", F.col("id").alias("b"))
    roots = components(close_pairs(prints.drop("same").withColumnRenamed("lead", "id"), max_distance).unionByName(linked))
    kept = member.join(roots, "id", "left").select("doc_id", F.coalesce("root", "id").alias("kept_id"))
    return kept.where("doc_id <> kept_id").distinct()


def drop_near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` without the documents that ``near_duplicates`` names; all columns and other rows stay as they are."""
    gone = checkpointed(near_duplicates(docs, max_distance).select(F.col("doc_id").alias("_gone")))
    return join_checked(docs, gone, docs["doc_id"] == gone["_gone"], "left_anti", row_bytes=40)
