"""Pairs of words that occur together, by their numbers: counted in runs, packed, and summed by ranges of pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.lexicon import AFTER, BEFORE, STOP, Lexicon, lexicon, merged, numbers, packed
from corvane.session import checkpointed

#: Tokens of a line of words, pairs that are sorted at once, and pairs that one range of them has.
LINE, RUN, RANGE = 1 << 18, 6_000_000, 8_000_000
#: Ranges of words by which marginals are summed.
_PARTS = 32


def _lines(arrays: DataFrame, lex: Lexicon, reach: int, side: str | None) -> DataFrame:
    """(part, side, data): the corpus as lines of numbers, -1 for what is no content word and ``reach`` times between documents (part -1), and the marginals of each task by ranges of words."""
    shared, words = lex.places, lex.words
    step = -(-max(words, 1) // _PARTS)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        stop = (places[2] & STOP) > 0
        marginals: dict[int, np.ndarray] = {}

        def row(part: int, s: int, data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([s], pa.int8()), pa.array([data], pa.binary())], ["part", "side", "data"])

        for batch in it:
            column, sides = batch.column(0), batch.column(1).to_numpy()
            for s in np.unique(sides):
                docs = column.filter(pa.array(sides == s)) if len(np.unique(sides)) > 1 else column
                offsets = docs.offsets.to_numpy()
                counts, flat = np.diff(offsets), docs.flatten().to_numpy()
                lo = 0
                while lo < len(counts):
                    hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + LINE, "right")) - 1)
                    some = counts[lo:hi]
                    ids = numbers(places, flat[offsets[lo] - offsets[0] : offsets[hi] - offsets[0]])
                    ids[stop[ids]] = -1
                    line = np.full(len(ids) + reach * len(some), -1, np.int32)
                    line[np.arange(len(ids)) + reach * np.repeat(np.arange(len(some)), some)] = ids
                    lo = hi
                    there = line >= 0
                    if not there.any():
                        continue
                    near = np.zeros(len(line), np.int64)
                    for d in range(1, min(reach, len(line) - 1) + 1):
                        near[d:] += (reach + 1 - d) * there[:-d]
                        near[:-d] += (reach + 1 - d) * there[d:]
                    if s not in marginals:
                        marginals[s] = np.zeros(words, np.int64)
                    np.add.at(marginals[s], line[there], near[there])
                    yield row(-1, s, line.tobytes())
        for s, m in marginals.items():
            for part in range(_PARTS):
                at = np.flatnonzero(m[part * step : (part + 1) * step])
                if len(at):
                    yield row(part, s, packed(at + part * step, m[at + part * step]))

    rows = arrays.select(lex.hashed(F.col("tokens")).alias("h"), (F.col(side) if side else F.lit(BEFORE)).cast("tinyint").alias("side"))
    return checkpointed(rows.mapInArrow(batches, "part int, side tinyint, data binary"))


def _marginals(lines: DataFrame, words: int) -> dict[int, np.ndarray]:
    """For each side the weight of all pairs of each word."""

    def added(table: pa.Table) -> pa.Table:
        k, v = merged(x.as_buffer().to_pybytes() for x in table.column("data"))
        return pa.table({"side": pa.array(table.column("side").to_pylist()[:1], pa.int8()), "data": pa.array([packed(k, v)], pa.binary())})

    out: dict[int, np.ndarray] = {}
    for r in lines.where("part >= 0").groupBy("part", "side").applyInArrow(added, "side tinyint, data binary").toLocalIterator():
        k, v = merged([bytes(r.data)])
        out.setdefault(r.side, np.zeros(words, np.int64))[k] = v
    return out


def _bounds(weight: np.ndarray, whole: bool, reach: int) -> np.ndarray:
    """Where ranges of about RANGE pairs end, as a * words + b. Only a word with more pairs than that is in several."""
    words = len(weight)
    mass = weight / max((reach + 2) / 3, 1)  # pairs, by their usual weight
    if not whole:
        mass = mass * (1 - (np.cumsum(weight) - weight / 2) / max(weight.sum(), 1))
    ends = np.cumsum(mass)
    n = int(np.ceil(ends[-1] / RANGE)) if words else 0
    goal = np.arange(1, max(n, 1)) * (ends[-1] / max(n, 1)) if words else np.zeros(0)
    a = np.minimum(np.searchsorted(ends, goal), max(words - 1, 0))
    low = np.zeros(len(a), np.int64) if whole else a  # b from here on
    share = (goal - (ends[a] - mass[a])) / np.maximum(mass[a], 1e-9) if words else goal
    share = np.where(mass[a] > RANGE, np.clip(share, 0, 1), 0) if words else share
    return np.unique(a * words + low + (share * (words - low)).astype(np.int64))


def _runs(lines: DataFrame, words: int, bounds: np.ndarray, whole: bool, reach: int, ordered: bool = False) -> DataFrame:
    """(range, side, data): packed pairs (a * words + b) and their weights, a <= b, or both ways if ``whole``; a before b in the text if ``ordered``."""
    shared = lines.sparkSession.sparkContext.broadcast(bounds)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def pieces(k: np.ndarray, w: np.ndarray, s: int) -> pa.RecordBatch:
            cut = np.concatenate([[0], np.searchsorted(k, shared.value), [len(k)]])
            at = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.full(len(at), s), pa.int8()), pa.array([packed(k[cut[i] : cut[i + 1]], w[cut[i] : cut[i + 1]]) for i in at], pa.binary())], ["range", "side", "data"])

        def flushed(s: int) -> Iterator[pa.RecordBatch]:
            both = np.concatenate(held.pop(s))
            both.sort()
            k = both >> 3
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            both &= 7
            w, k = np.add.reduceat(both, starts), k[starts]
            yield pieces(k, w, s)
            if whole:
                a, b = k // words, k % words
                other = a != b
                k, w = (b * words + a)[other], w[other]
                if len(k):
                    order = np.argsort(k)
                    yield pieces(k[order], w[order], s)

        for batch in it:
            for s, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                line = np.frombuffer(data.as_buffer(), np.int32)
                for d in range(1, reach + 1):
                    x, y = line[:-d], line[d:]
                    there = (x >= 0) & (y >= 0)
                    x, y = x[there].astype(np.int64), y[there].astype(np.int64)
                    if len(x):
                        held.setdefault(s, []).append((((x * words + y) if ordered else (np.minimum(x, y) * words + np.maximum(x, y))) << 3) | (reach + 1 - d))
                if sum(map(len, held.get(s, ()))) > RUN:
                    yield from flushed(s)
        for s in list(held):
            yield from flushed(s)

    return lines.where("part < 0").select("side", "data").mapInArrow(batches, "range int, side tinyint, data binary")


class Company:
    """What the words of a corpus occur with. ``sides``: a column of documents that tells which states of the corpus they are in, as bits."""

    def __init__(self, arrays: DataFrame, lex: Lexicon, reach: int = 5, side: str | None = None):
        if reach > 7:
            raise ValueError("at most seven places")
        self.lex, self.reach, self.spark = lex, reach, arrays.sparkSession
        self.lines = _lines(arrays, lex, reach, side)
        found = _marginals(self.lines, lex.words)
        zero = np.zeros(lex.words, np.int64)
        self.marginals = [sum((m for s, m in found.items() if s & bit), zero) for bit in ((BEFORE, AFTER) if side else (BEFORE,))]
        self.weight = sum(found.values(), zero)

    def bounds(self, whole: bool) -> np.ndarray:
        return _bounds(self.weight, whole, self.reach)

    def pairs(self, whole: bool, finish: Callable[..., pa.Table], schema: str, ordered: bool = False) -> DataFrame:
        """``finish`` of (pairs a * words + b ascending, a list of their weights by side) for each range of pairs, a <= b, both ways if ``whole``, or as they stand in the text if ``ordered``."""
        bounds = self.bounds(whole or ordered)
        sides = [BEFORE, AFTER][: len(self.marginals)]

        def one(table: pa.Table) -> pa.Table:
            of = np.array(table.column("side").to_pylist())
            parts = {int(s): merged(table.column("data")[i].as_buffer().to_pybytes() for i in np.flatnonzero(of == s)) for s in np.unique(of)}
            keys = next(iter(parts.values()))[0] if len(parts) == 1 else np.unique(np.concatenate([k for k, _ in parts.values()]))
            weights = [np.zeros(len(keys), np.int64) for _ in sides]
            for s, (k, w) in parts.items():
                at = np.searchsorted(keys, k)
                for bit, total in zip(sides, weights):
                    if s & bit:
                        total[at] += w
            return finish(keys, weights)

        return _runs(self.lines, self.lex.words, bounds, whole, self.reach, ordered).groupBy("range").applyInArrow(one, schema)

    def scored(self, finish: Callable[..., pa.Table], schema: str) -> DataFrame:
        """``finish`` of (a, b, a list of PPMI by side, 0 where it isn't positive) for each range of pairs, both ways, in order of a and b."""
        words = self.lex.words
        shared = self.spark.sparkContext.broadcast([m.astype(np.float64) for m in self.marginals])

        def one(keys: np.ndarray, weights: list[np.ndarray]) -> pa.Table:
            a, b = keys // words, keys % words
            scores = []
            for w, m in zip(weights, shared.value):
                with np.errstate(divide="ignore", invalid="ignore"):
                    x = np.log(m.sum() / 2 * w / (m[a] * m[b]))
                scores.append(np.where(x > 0, x, 0.0))
            some = sum(x > 0 for x in scores) > 0
            return finish(a[some], b[some], [x[some] for x in scores])

        return self.pairs(True, one, schema)


def starts_of(a: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)


def company(arrays: DataFrame, reach: int = 5, side: str | None = None) -> Company | None:
    """None if there are too many words to be sent along."""
    lex = lexicon(arrays, side)
    return None if lex is None else Company(arrays, lex, reach, side)
