"""Licence scans: an inverted index of winnowed template fingerprints picks candidates, banded alignment measures them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corvane.llm._text import WORD_LUT, buffers, mix, slices, span_hashes, word_bounds
from corvane.llm.license_texts import TEMPLATES

#: Words of a fingerprint, and of these how many neighbours share one that is kept: GRAM + WINDOW - 1 words in common are always seen.
GRAM, WINDOW = 3, 2
#: An alignment may leave the diagonal of its fingerprints by so many words.
BAND = 8
#: Share of a template's words that must be matched in order; of a notice, which a single word may turn into another's, all.
MIN_COVERAGE = {"text": 0.8, "notice": 1.0}
_FOUND = [("license", T.StringType()), ("template", T.IntegerType()), ("coverage", T.DoubleType()), ("matched_words", T.IntegerType()), ("start", T.LongType()), ("end", T.LongType())]
_MATCH, _OTHER, _GAP = 2, -1, -1


def _words(text: str) -> np.ndarray:
    low = WORD_LUT[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = word_bounds(low, np.array([0, len(low)]))
    return span_hashes(low, starts, ends)


def grams(words: np.ndarray, size: int = GRAM) -> np.ndarray:
    if len(words) < size:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k]
    return mix(out)


def winnowed(hashes: np.ndarray) -> list[int]:
    """Places whose hash is the least of some WINDOW neighbours, the rightmost on ties."""
    if len(hashes) <= WINDOW:
        return list(range(len(hashes)))
    return sorted({i + max(k for k in range(WINDOW) if hashes[i + k] == hashes[i : i + WINDOW].min()) for i in range(len(hashes) - WINDOW + 1)})


class Index:
    """Fingerprint to the templates and places that have it; a template of fewer than GRAM words is one fingerprint."""

    def __init__(self, templates: list[tuple[str, str, str]]):
        templates = [x for x in templates if len(_words(x[2]))]
        self.names = [x[0] for x in templates]
        self.words = [_words(x[2]) for x in templates]
        self.lists = [w.tolist() for w in self.words]
        self.counts = [Counter(w) for w in self.lists]
        self.need = [MIN_COVERAGE[x[1]] * len(w) for x, w in zip(templates, self.lists)]
        postings: dict[int, list[tuple[int, int]]] = {}
        self.sizes = sorted({min(GRAM, len(w)) for w in self.words})
        for t, words in enumerate(self.words):
            hashes = grams(words, min(GRAM, len(words)))
            for i in winnowed(hashes):
                postings.setdefault(int(hashes[i]), []).append((t, i))
        self.keys = np.array(sorted(postings), np.uint64)
        self.postings = [postings[int(k)] for k in self.keys]


def align(template: list[int], words: list[int], low: int, high: int) -> list[tuple[int, int, int, int]]:
    """(score, matched words, first, end) of the best local alignment that ends in each word, on diagonals (word minus template place) from
    low to high, best first.

    Ties go to the earlier end in the template, then in the words.
    """
    width = high - low + 1
    dead = (0, 0, -1)  # score, matches, first word
    above, n = [dead] * (width + 1), len(words)
    best: dict[int, tuple[int, int, int, int]] = {}  # score, matches, first word, template place, by last word
    for i, word in enumerate(template):
        row, left = [dead] * (width + 1), dead
        for b in range(width):
            j = i + low + b
            if j < 0 or j >= n:
                left = dead
                continue
            s, m, f = above[b]
            cell = (s + _MATCH, m + 1, f if f >= 0 else j) if words[j] == word else (s + _OTHER, m, f)
            up = above[b + 1]
            if up[0] + _GAP > cell[0]:
                cell = (up[0] + _GAP, up[1], up[2])
            if left[0] + _GAP > cell[0]:
                cell = (left[0] + _GAP, left[1], left[2])
            if cell[0] <= 0:
                cell = dead
            row[b] = left = cell
            if words[j] == word and (j not in best or cell[:2] > best[j][:2]):
                best[j] = (*cell, i)
        above = row
    return [(s, m, f, j + 1) for j, (s, m, f, _) in sorted(best.items(), key=lambda x: (-x[1][0], -x[1][1], x[1][3], x[0]))]


def stretches(template: list[int], counts: Counter, words: list[int], low: int, high: int, need: float) -> list[tuple[int, int, int]]:
    """(matched words, first, end) of the best local alignment, then of the best in what lies before and after it, and so on.

    Those with fewer than ``need`` matched words are left out.
    """
    out, todo = [], [(0, len(words))]
    while todo:
        a, b = todo.pop()
        have = Counter(words[a:b])
        if sum(min(n, have[w]) for w, n in counts.items()) < need:  # can't be covered enough, however aligned
            continue
        used, taken = bytearray(b - a), []
        for _, matched, first, end in align(template, words[a:b], max(low - a, 1 - len(template)), min(high - a, b - a - 1)):
            if used[end - 1]:
                continue
            if 1 in used[first:end]:  # without the words that are taken, another alignment may end here
                break
            used[first:end] = b"\1" * (end - first)
            taken.append((first, end))
            if matched >= need:
                out.append((matched, a + first, a + end))
        at = 0
        for first, end in sorted(taken):
            todo.append((a + at, a + first))
            at = end
        if taken:
            todo.append((a + at, b))
    return out


def _scan_document(index: Index, words: np.ndarray, at: np.ndarray, which: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(template, matched, first word, end word) in one document; ``at``, ``which``: places of fingerprints and their postings."""
    diagonals: dict[int, list[int]] = {}
    for i, k in zip(at.tolist(), which.tolist()):
        for t, place in index.postings[k]:
            diagonals.setdefault(t, []).append(i - place)
    found, out = [], []
    for t, ds in diagonals.items():
        template, counts = index.lists[t], index.counts[t]
        need = index.need[t]
        ds = sorted(set(ds))
        groups = [[ds[0], ds[0]]]
        for d in ds[1:]:
            if d - groups[-1][1] <= 2 * BAND:
                groups[-1][1] = d
            else:
                groups.append([d, d])
        for first, last in groups:
            lo = max(0, first - BAND)
            part = words[lo : last + BAND + len(template)].tolist()
            found += [(t, matched, lo + a, lo + b) for matched, a, b in stretches(template, counts, part, first - BAND - lo, last + BAND - lo, need)]
    for x in sorted(found, key=lambda x: (-x[1], len(index.lists[x[0]]), x[2], x[0])):
        if not any(x[2] < y[3] and y[2] < x[3] for y in out):
            out.append(x)
    return sorted(out)


@lru_cache(maxsize=1)
def _index(templates: tuple[tuple[str, str, str], ...]) -> Index:
    return Index(list(templates))


def scan_texts(index: Index, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
    """(document, licence, template, coverage, matched words, start, end) for texts in ``data``; bounds are characters of the text."""
    low = WORD_LUT[data]
    starts, ends, doc = word_bounds(low, offsets)
    words = span_hashes(low, starts, ends)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for size in index.sizes:
        hashes = grams(words, size)
        slot = np.minimum(np.searchsorted(index.keys, hashes), len(index.keys) - 1)
        at = np.flatnonzero((index.keys[slot] == hashes) & (doc[: len(hashes)] == doc[size - 1 : len(doc)][: len(hashes)]))
        found.append((at, slot[at]))
    hits, which = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(hits, kind="stable")
    hits, which = hits[order], which[order]
    for d in np.unique(doc[hits]):
        lo, hi = np.searchsorted(doc[hits], d), np.searchsorted(doc[hits], d + 1)
        a, b = np.searchsorted(doc, d), np.searchsorted(doc, d + 1)
        for t, matched, first, end in _scan_document(index, words[a:b], hits[lo:hi] - a, which[lo:hi]):
            text = data[offsets[d] : offsets[d + 1]]
            s, e = int(starts[a + first] - offsets[d]), int(ends[a + end - 1] - offsets[d])
            before = int(((text[:s] & 0xC0) != 0x80).sum())
            inside = int(((text[s:e] & 0xC0) != 0x80).sum())
            yield int(d), index.names[t], t, round(matched / len(index.lists[t]), 6), matched, before, before + inside


def folder_templates(folder: str) -> list[tuple[str, str, str]]:
    """A "text" template for each file of a folder of licences, named like the file."""
    files = sorted(p for p in Path(folder).iterdir() if p.is_file())
    return [(p.name.removesuffix(".txt"), "text", p.read_text(encoding="utf-8", errors="replace")) for p in files]


def license_spans(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, license, template, coverage, matched_words, start, end) of every stretch that covers MIN_COVERAGE of a template.

    Words are compared without case and signs. coverage: matched words of the best local alignment over the template's words, then of
    the best in the words around it, until none covers enough; start and end are characters of the text. Of overlapping stretches the
    one with most matched words stays, then that of the shorter template, then the first. A stretch is seen if it has GRAM + WINDOW - 1
    of the template's words in a row, or a template of fewer as a whole. The band of an alignment is BAND diagonals to either side of
    those that fingerprints lie on; diagonals that near are aligned together. Null and empty texts and templates without a word hold
    nothing. doc_id keeps its type. Rows that repeat a doc_id, null ids too, are scanned each on its own. Other columns are not read,
    whatever their names. Texts are scanned whole. An empty table or list of templates gives an empty result. Templates are sent once
    to each executor; they don't grow with the documents.
    """
    kinds = [("doc_id", docs.schema["doc_id"].dataType), *_FOUND]
    arrow, names = [to_arrow_type(k) for _, k in kinds], [n for n, _ in kinds]
    shared = docs.sparkSession.sparkContext.broadcast(tuple(templates))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared.value)
        for batch in it:
            if not len(index.keys):
                continue
            offsets, data = buffers(batch.column(1))
            ids = batch.column(0)
            for a, b in slices(offsets):
                rows = [(ids[a + d].as_py(), *x) for d, *x in scan_texts(index, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), arrow)], names)

    return docs.where("text is not null").select("doc_id", "text").mapInArrow(batches, T.StructType([T.StructField(*k) for k in kinds]))
