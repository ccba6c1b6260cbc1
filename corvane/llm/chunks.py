"""Substring deduplication by content-defined chunks, cut where a gear rolling hash is least among its neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm._text import buffers, mix, slices
from corvane.session import checkpointed

#: A cut is a character whose gear hash is the least among so many bytes to either side: a chunk has 2 * REACH + 1 bytes on average, REACH at least.
REACH = 20
#: A passage is a run of repeated chunks of so many bytes; what is shorter, a few words that any two texts may share, is no repetition.
MIN_RUN = 100
#: Bytes that a gear hash looks back on.
GEAR_BYTES = 16

_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """At i the gear hash of the GEAR_BYTES bytes that end before i: the sum of G[byte] << age, by doubling windows."""
    h = np.zeros(len(data) + 1, np.uint32)
    h[1:] = _GEAR[data]
    for step in (1, 2, 4, 8):
        older = h[:-step] << np.uint32(step)
        h[step:] += older
    return h


def _least_ahead(x: np.ndarray, n: int) -> np.ndarray:
    """At i the least of x[i : i + n], by doubling windows."""
    out, size = x.copy(), 1
    while size < n:
        step = min(size, n - size)
        out[:-step] = np.minimum(out[:-step], out[step:])
        size += step
    return out


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunk starts, document of each) for texts in ``data``; a text's first chunk starts at its first byte.

    Cuts depend on the bytes near them alone, and are REACH bytes or more from the ends of a text: an insertion moves those within
    REACH + GEAR_BYTES of it, no others.
    """
    heads = offsets[:-1][np.diff(offsets) > 0]
    inner = np.zeros(0, np.int64)
    if len(data) > 2 * REACH:
        value = gear(data)[:-1].astype(np.uint32)
        value[(data & 0xC0) == 0x80] = 0xFFFFFFFF  # inside a character
        first = (heads[:, None] + np.arange(GEAR_BYTES)).ravel()
        value[first[first < len(data)]] = 0xFFFFFFFF  # these look back into the text before, so they are neither cuts nor compared
        ahead = _least_ahead(value, REACH)
        inner = REACH + np.flatnonzero((value[REACH:-REACH] < ahead[: -2 * REACH]) & (value[REACH:-REACH] <= ahead[REACH + 1 : len(data) - REACH + 1]))
        doc = np.searchsorted(offsets, inner, side="right") - 1
        inner = inner[(inner - offsets[doc] >= REACH) & (offsets[doc + 1] - inner >= REACH)]
    at = np.union1d(inner, heads)
    return at, np.searchsorted(offsets, at, side="right") - 1


def _chunked(offsets: np.ndarray, data: np.ndarray, a: int, b: int):
    """(starts, ends, document, index in it, digest of 2 * 64 bits) of the chunks of documents a to b."""
    base = int(offsets[a])
    part = data[base : offsets[b]]
    at = offsets[a : b + 1] - base
    starts, doc = cuts(part, at)
    ends = np.minimum(np.r_[starts[1:], len(part)], at[doc + 1]) if len(starts) else starts
    view = memoryview(part)
    digest = b"".join(map(xxhash.xxh3_128_digest, (view[s:e] for s, e in zip(starts.tolist(), ends.tolist()))))
    index = np.arange(len(doc)) - np.searchsorted(doc, doc)
    return starts, ends, doc, index, np.frombuffer(digest, np.int64).reshape(-1, 2)


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = buffers(batch.column(1))
        ids = batch.column(0)
        for a, b in slices(offsets):
            _, _, doc, index, digest = _chunked(offsets, data, a, b)
            yield pa.RecordBatch.from_arrays([pa.array(digest[:, 0]), pa.array(digest[:, 1]), ids.take(pa.array(doc + a)), pa.array(index.astype(np.int32))], ["digest", "more", "doc_id", "at"])


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = buffers(batch.column(0))
        for a, b in slices(offsets):
            yield pa.RecordBatch.from_arrays([pa.array(_chunked(offsets, data, a, b)[4][:, 0])], ["digest"])


def chunk_table(docs: DataFrame) -> DataFrame:
    """(digest, more, doc_id, at): every chunk of the documents with an id and a text, its digest as two numbers."""
    kinds = [("digest", T.LongType()), ("more", T.LongType()), ("doc_id", docs.schema["doc_id"].dataType), ("at", T.IntegerType())]
    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(_chunk_batches, T.StructType([T.StructField(*k) for k in kinds]))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(_of, _repeats): for each document the chunks (at, digest) that stand earlier in the order of doc_id and place as well.

    First the halves of digests that occur more than once are counted, with partial sums, so a chunk that is everywhere is a row a task;
    then only chunks with such a half go on, and each digest's first place is an aggregate too.
    """
    halves = docs.where("doc_id is not null and text is not null").select("text").mapInArrow(_digest_batches, "digest bigint")
    common = checkpointed(halves.groupBy("digest").count().where(F.col("count") > 1).select(F.col("digest").alias("_half")))
    some = checkpointed(chunk_table(docs).join(common, F.col("digest") == F.col("_half"), "left_semi"))
    firsts = some.groupBy("digest", "more").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    repeats = some.join(firsts, ["digest", "more"]).where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("at") != F.col("first.at")))
    return repeats.groupBy(F.col("doc_id").alias("_of")).agg(F.collect_list(F.struct("at", "digest")).alias("_repeats"))


def runs(starts: np.ndarray, ends: np.ndarray, repeated: np.ndarray, least: int = MIN_RUN) -> list[tuple[int, int]]:
    """Bounds of the runs of repeated chunks that have ``least`` bytes."""
    edge = np.diff(np.r_[0, repeated.astype(np.int8), 0])
    spans = zip(starts[np.flatnonzero(edge == 1)].tolist(), ends[np.flatnonzero(edge == -1) - 1].tolist())
    return [(s, e) for s, e in spans if e - s >= least]


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (text, _repeats, ...) with _new (the text without its runs) and _spans ([start, end) in characters) instead of these two, in slices."""
    for batch in batches:
        repeats = batch.column(batch.schema.get_field_index("_repeats"))
        old = batch.column(batch.schema.get_field_index("text"))
        rest = batch.drop_columns(["text", "_repeats"])
        offsets, data = buffers(old)
        counts = pc.fill_null(pc.list_value_length(repeats), 0).to_numpy(zero_copy_only=False)
        flat = repeats.flatten()
        where = flat.field("at").to_numpy(zero_copy_only=False).astype(np.int64)
        digests = flat.field("digest").to_numpy(zero_copy_only=False)
        first = np.r_[0, np.cumsum(counts)]
        for a, b in slices(offsets):
            new, spans = old.slice(a, b - a).to_pylist(), [[] for _ in range(b - a)]
            some = first[a] < first[b]
            if some:
                starts, ends, doc, index, digest = _chunked(offsets, data, a, b)
                heads = np.searchsorted(doc, np.arange(b - a + 1))
            for d in range(a, b) if some else ():
                lo, hi = heads[d - a], heads[d - a + 1]
                p, q = first[d], first[d + 1]
                if p == q or lo == hi:
                    continue
                flags = np.zeros(hi - lo, bool)
                at, value = where[p:q], digests[p:q]
                ok = at < hi - lo
                at, value = at[ok], value[ok]
                flags[at[digest[lo:hi, 0][at] == value]] = True
                origin = int(offsets[d]) - int(offsets[a])
                out = runs(starts[lo:hi] - origin, ends[lo:hi] - origin, flags)
                if out:
                    raw = data[offsets[d] : offsets[d + 1]].tobytes()
                    kept, pos, chars, done = [], 0, 0, []
                    for s, e in out:
                        chars += len(piece := raw[pos:s].decode())
                        kept.append(piece)
                        done.append({"start": chars, "end": (chars := chars + len(raw[s:e].decode()))})
                        pos = e
                    kept.append(raw[pos:].decode())
                    new[d - a], spans[d - a] = "".join(kept), done
            part = rest.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(new, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], [*part.schema.names, "_new", "_spans"])


def _with_cuts(docs: DataFrame) -> DataFrame:
    """(doc_id, _row, _new, _spans); the other columns travel inside _row, so that their names can't clash. The old text doesn't come back."""
    repeats = checkpointed(repeated_chunks(docs))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(*others).alias("_row")) if others else docs.select("doc_id", "text")
    rows = rows.join(repeats, F.col("doc_id") == F.col("_of"), "left").drop("_of")
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*(f for f in rows.schema.fields if f.name not in ("text", "_repeats")), T.StructField("_new", T.StringType()), T.StructField("_spans", spans)])
    return rows.mapInArrow(_cut_batches, schema)


def removed_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, chars_removed, text): the documents that lose text, where they lose it, and what is left.

    A chunk is repeated if the same bytes are a chunk at an earlier (doc_id, place); runs of repeated chunks of MIN_RUN bytes or more
    go, so the first copy of a passage stays. Spans are [start, end) in characters of the old text. Null and empty texts and rows
    with a null doc_id neither lose nor cause anything. Rows that share a doc_id are matched by place and digest: identical rows are
    treated alike and don't count as copies of each other, but a passage that stands twice in one text loses its second copy. doc_id
    keeps its type. Other columns are not read, whatever their names. An empty table gives an empty result. Texts are read whole; one
    rule cuts them all, with or without white space.
    """
    rows = _with_cuts(docs.select("doc_id", "text")).where(F.size("_spans") > 0)
    lost = F.aggregate("_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", F.col("_spans").alias("spans"), lost.alias("chars_removed"), F.col("_new").alias("text"))


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with the passages of ``removed_passages`` cut from text, and n_chars, if there is one, brought up to date; all rows stay."""
    rows = _with_cuts(docs)
    changed = F.size("_spans") > 0
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("_new").alias("text"))
        elif c == "n_chars":
            out.append(F.when(changed, F.length("_new").cast(dict(docs.dtypes)[c])).otherwise(F.col("_row.n_chars")).alias(c))
        else:
            out.append(F.col(c if c == "doc_id" else f"_row.`{c}`").alias(c))
    return rows.select(*out)
