"""Benchmark decontamination by pigeonhole edit matching: exact hits of pieces, verified with Myers' bit-parallel distance."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from uuid import uuid4

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corvane.llm._text import held
from corvane.session import checkpointed, join_checked

#: Edits allowed for each character of an item.
EDIT_RATE = 0.06
#: Characters of items in one automaton; more items than that are searched in several passes.
AUTOMATON_CHARS = 4_000_000


_SIGNS = re.compile(r"[\W_]+")


def normalize(text: str) -> str:
    """The words in lower case, with one space before, between and behind them, so that a match of a short text begins and ends with a word."""
    words = _SIGNS.sub(" ", text.lower()).strip()
    return f" {words} " if words else ""


def budget(length: int, rate: float = EDIT_RATE) -> int:
    """Edits allowed for a normalized item of ``length`` characters, of which the outer spaces don't count."""
    return int(max(0, length - 2) * rate)


def pieces(text: str, rate: float = EDIT_RATE) -> list[tuple[int, str]]:
    """(place, piece): one piece more than the error budget, so that at least one is whole in every match."""
    n = budget(len(text), rate) + 1
    bounds = [len(text) * i // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(bounds, bounds[1:])]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, limit: int) -> tuple[int, int]:
    """(distance, end) of the best match of a pattern of m characters anywhere in ``text``, leftmost end on ties; (limit + 1, -1) if none."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, limit + 1, -1
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
        if score < best:
            best, end = score, j + 1
    return best, end


def merged(starts: list[int], size: int) -> list[tuple[int, int]]:
    """The union of the windows of ``size`` from each start, as disjoint windows in order."""
    out: list[tuple[int, int]] = []
    for lo in sorted(set(starts)):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], lo + size)
        else:
            out.append((lo, lo + size))
    return out


class Matcher:
    """All items of one slice of the benchmark."""

    def __init__(self, items: Iterable[tuple[int, str]], rate: float = EDIT_RATE):
        self.items = [(item, text, budget(len(text), rate), masks(text), masks(text[::-1])) for item, text in items]
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, *_rest) in enumerate(self.items):
            for at, piece in pieces(text, rate):
                places.setdefault(piece, []).append((i, at))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of each item's best match in a normalized text; the bounds are those of its words."""
        out: list[tuple[int, int, int, int]] = []
        windows: dict[int, list[int]] = {}
        if len(self.automaton):
            for last, (size, where) in self.automaton.iter(text):
                for i, at in where:
                    windows.setdefault(i, []).append(last + 1 - size - at - self.items[i][2])
        for i, mine in windows.items():
            item, pattern, k, peq, back = self.items[i]
            best = None
            for lo, hi in merged(mine, len(pattern) + 2 * k):
                lo, hi = max(0, lo), min(len(text), hi)
                exact = text.find(pattern, lo, hi)
                if exact >= 0:
                    found = (0, exact, exact + len(pattern))
                else:
                    distance, end = myers(peq, len(pattern), text[lo:hi], k)
                    if distance > k:
                        continue
                    end += lo
                    _, length = myers(back, len(pattern), text[max(lo, end - len(pattern) - k) : end][::-1], distance)
                    found = (distance, end - length, end)
                if best is None or found < best:
                    best = found
            if best is not None:
                distance, start, end = best
                while start < end and text[start] == " ":
                    start += 1
                while start < end and text[end - 1] == " ":
                    end -= 1
                out.append((item, distance, start, end))
        return out


def _slices(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The normalized items, each once, in slices of AUTOMATON_CHARS."""
    chunk, size = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text")
    for item, text in rows.toLocalIterator():
        text = normalize(text)
        if not text:
            continue
        chunk.append((item, text))
        size += len(text)
        if size >= AUTOMATON_CHARS:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """(doc_id, item_id, distance, start, end): the best match of each item in each document that holds it.

    An item whose words, with single spaces between, have m characters matches if a stretch of the document is within floor(rate * m)
    edits of it; both are taken as words in lower case, without signs, and a space at either end counts as a character, so that an item
    too short for an edit matches whole words alone. start and end count characters of ``normalize(text)``; the least distance wins,
    then the leftmost stretch. Items of any length are searched in the same way. Null ids, null texts and items or documents without a
    word match nothing. Ids keep their types. Repeated rows give one row; if texts differ under one doc_id or item_id, the best match of
    any counts. Other columns are not read. Texts are searched whole, however long. Without documents or items the result is empty. A
    benchmark beyond AUTOMATON_CHARS takes several passes over the documents, one after the other.
    """
    kinds = [("doc_id", docs.schema["doc_id"].dataType), ("item_id", benchmark.schema["item_id"].dataType), ("distance", T.IntegerType()), ("start", T.LongType()), ("end", T.LongType())]
    schema, arrow, names = T.StructType([T.StructField(*k) for k in kinds]), [to_arrow_type(k) for _, k in kinds], [n for n, _ in kinds]
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")

    def scan(items: list[tuple]) -> tuple[DataFrame, object]:
        shared, key = spark.sparkContext.broadcast((items, rate)), uuid4().hex

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = held(key, lambda: Matcher(*shared.value))
            for batch in it:
                rows = [(doc, *found) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for found in matcher.find(normalize(text))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow)], names)

        return texts.mapInArrow(batches, schema), shared

    def best(rows: DataFrame) -> DataFrame:
        return rows.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "start", "end")).alias("m")).select("doc_id", "item_id", "m.*")

    done, last = [], None
    for items in _slices(benchmark):
        if last is not None:
            done.append(checkpointed(last[0]))
            last[1].destroy()  # so that one slice at a time is held
        last = scan(items)
    if last is None:
        return spark.createDataFrame([], schema)
    return best(reduce(DataFrame.unionByName, [*done, last[0]]))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns and other rows stay as they are."""
    gone = checkpointed(contamination(docs, benchmark, rate).select(F.col("doc_id").alias("_gone")).distinct())
    return join_checked(docs, gone, docs["doc_id"] == gone["_gone"], "left_anti", row_bytes=40)
