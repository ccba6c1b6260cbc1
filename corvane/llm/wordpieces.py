"""Token counts by the linear longest-match automaton: a trie with failure links and counts of the pieces that a link pops."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corvane.llm._text import buffers, slices, span_hashes

#: One line a piece: base64 and rank. A piece with a leading space opens a word, the others continue one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Longer words go through the automaton one by one, not side by side.
LONG = 256
ROOT, INNER, NONE = 0, 1, -1


def load(path: str = VOCABULARY) -> tuple[list[bytes], list[bytes]]:
    """(pieces that open a word, with their space; pieces that continue one) of a vocabulary file."""
    pieces = [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line.strip()]
    plain = [p for p in pieces if p and not any(c <= 32 for c in p[1:])]
    return [p for p in plain if p[0] == 32 and len(p) > 1] + ([b" "] if b" " in plain else []), [p for p in plain if p[0] > 32]


class Automaton:
    """``link[v]``: where to go on when v has no edge for the next byte; ``popped[v]``: pieces that this completes; ``rest[v]``: pieces at a word's end."""

    def __init__(self, opening: Iterable[bytes], inner: Iterable[bytes]):
        edges: dict[int, int] = {}
        parent, byte, piece = [NONE, NONE], [0, 0], [False, False]
        for root, words in ((ROOT, opening), (INNER, inner)):
            for word in words:
                v = root
                for c in word:
                    key = v << 8 | c
                    u = edges.get(key)
                    if u is None:
                        u = edges[key] = len(parent)
                        parent.append(v)
                        byte.append(c)
                        piece.append(False)
                    v = u
                piece[v] = v > INNER
        n = len(parent)
        depth = [0] * n
        for v in range(2, n):
            depth[v] = depth[parent[v]] + 1
        link, popped, rest = [NONE] * n, [0] * n, [0] * n
        for v in sorted(range(2, n), key=depth.__getitem__):
            if piece[v]:
                link[v], popped[v] = INNER, 1
            else:
                u = parent[v]
                z, count = link[u], popped[u]
                while z != NONE and z << 8 | byte[v] not in edges:
                    count += popped[z]
                    z = link[z]
                if z != NONE:
                    link[v], popped[v] = edges[z << 8 | byte[v]], count
        whole = [v == INNER for v in range(n)]
        for v in sorted(range(2, n), key=lambda v: (0 if link[v] == INNER else 1, depth[v])):
            z, count, chain = v, 0, True
            while z != INNER:
                if z == NONE or link[z] == NONE:
                    chain = False
                    break
                count += popped[z]
                z = link[z]
            whole[v], rest[v] = chain, count
        self.edges = edges
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.keys, self.to = np.r_[keys[order], np.int64(1 << 62)], np.r_[np.fromiter(edges.values(), np.int64, len(edges))[order], 0]
        self.link, self.popped, self.rest, self.whole = (np.array(x) for x in (link, popped, rest, whole))
        self.slow = (link, popped, rest, whole)

    def count(self, word: bytes) -> int:
        """Pieces of one word; 1 if it can't be cut into pieces, as it is one unknown token then."""
        link, popped, rest, whole = self.slow
        edges, v, total = self.edges, ROOT, 0
        for c in word:
            while (u := edges.get(v << 8 | c)) is None:
                if link[v] == NONE:
                    return 1
                total += popped[v]
                v = link[v]
            v = u
        return total + rest[v] if whole[v] else 1

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """``count`` of b" " + data[start:end] for each word, all words side by side, byte by byte."""
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        begin, size = starts[order], size[order]
        state = np.zeros(len(order), np.int64)
        total = np.zeros(len(order), np.int64)
        unknown = np.zeros(len(order), bool)
        alive = len(order)
        for k in range(-1, int(size[0]) if len(size) else -1):
            alive = int(np.searchsorted(-size, -k, side="left")) if k >= 0 else alive
            todo = np.arange(alive)
            byte = np.full(alive, 32, np.int64) if k < 0 else data[begin[:alive] + k].astype(np.int64)
            while len(todo):
                v = state[todo]
                key = v << 8 | byte[todo]
                at = np.searchsorted(self.keys, key)
                hit = self.keys[at] == key
                state[todo[hit]] = self.to[at[hit]]
                todo, v = todo[~hit], v[~hit]
                dead = self.link[v] == NONE
                unknown[todo[dead]] = True
                state[todo[dead]] = INNER
                todo, v = todo[~dead], v[~dead]
                total[todo] += self.popped[v]
                state[todo] = self.link[v]
        out = np.empty(len(order), np.int64)
        out[order] = np.where(unknown | ~self.whole[state], 1, total + self.rest[state])
        return out


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the stretches without ASCII white space or control characters."""
    inside = data > 32
    edge = np.zeros(len(data) + 1, np.int8)
    edge[:-1] = inside
    edge[1:] -= inside
    start, end = edge == 1, edge == -1
    for b in offsets[1:-1]:
        if 0 < b < len(data) and inside[b - 1] and inside[b]:
            start[b] = end[b] = True
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def text_counts(automaton: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, tokens) of each text; a word that occurs several times goes through the automaton once."""
    n = len(offsets) - 1
    starts, ends, doc = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    _, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    long = ends[first] - starts[first] > LONG
    each = np.zeros(len(first), np.int64)
    each[~long] = automaton.counts(data, starts[first[~long]], ends[first[~long]])
    for i in np.flatnonzero(long):
        each[i] = automaton.count(b" " + data[starts[first[i]] : ends[first[i]]].tobytes())
    return np.bincount(doc, minlength=n), np.bincount(doc, weights=each[which], minlength=n).astype(np.int64)


@lru_cache(maxsize=2)
def _automaton(opening: tuple[bytes, ...], inner: tuple[bytes, ...]) -> Automaton:
    return Automaton(opening, inner)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row of ``docs``: greedy longest pieces of each word between white space.

    A word counts with the space before it, the first of a text too. A word that has no division into pieces is one token. A null or
    empty text has none. Rows that repeat a doc_id, null ids too, have each their row; other columns are not read. Texts are counted
    whole. doc_id keeps its type. The vocabulary is read on the driver and sent once to each executor; its size doesn't depend on the documents. An empty
    table gives an empty result.
    """
    opening, inner = load(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((tuple(opening), tuple(inner)))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(*shared.value)
        for batch in it:
            offsets, data = buffers(batch.column(1))
            for a, b in slices(offsets, 4 << 20):
                words, tokens = text_counts(automaton, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words), pa.array(tokens)], ["doc_id", "n_words", "n_tokens"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(batches, T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]))
