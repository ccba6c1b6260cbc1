"""What the words of single documents weigh, told where the documents are: nothing but results is shuffled."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.company import starts_of
from corvane.operators.lexicon import CODE, NEGATOR, NOISE, STOP, Lexicon, numbers

#: Tokens that a step takes at once.
STEP = 1 << 18


def idf_of(lex: Lexicon, docs: int) -> np.ndarray:
    """``corpus.grid_idf`` of each word."""
    return np.log(1 + docs / (1 + lex.df[0]))


def slices(offsets: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of whole rows with about STEP entries, and no more than 4,096 rows."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (most or STEP), "right")) - 1)
        hi = min(hi, lo + 4096)
        yield lo, hi
        lo = hi


def per_document(arrays: DataFrame, lex: Lexicon, work: Callable[[pa.Array, np.ndarray, np.ndarray, list[pa.Array]], pa.RecordBatch | None], schema, keep: tuple[str, ...] = ()) -> DataFrame:
    """``work`` of (ids, row of each token from 0, number of each token, the columns ``keep``) for slices of the documents (doc_id, tokens)."""
    shared = lex.places

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in it:
            column = batch.column(1)
            offsets, flat = column.offsets.to_numpy(), column.flatten().to_numpy()
            for lo, hi in slices(offsets):
                ids = numbers(places, flat[offsets[lo] - offsets[0] : offsets[hi] - offsets[0]])
                row = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
                out = work(batch.column(0).slice(lo, hi - lo), row, ids, [batch.column(2 + i).slice(lo, hi - lo) for i in range(len(keep))])
                if out is not None and out.num_rows:
                    yield out

    return arrays.select("doc_id", lex.hashed(F.col("tokens")).alias("h"), *keep).mapInArrow(batches, schema)


def counted(row: np.ndarray, ids: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, tf), each row and word once, in order."""
    key = row.astype(np.int64) * words + ids
    key.sort()
    starts = starts_of(key)
    return key[starts] // words, key[starts] % words, np.diff(np.append(starts, len(key)))


def first_of(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``k`` largest whole scores of each row, ties in order of words, and their ranks from 1."""
    order = np.lexsort((ids, -score, row))
    starts = starts_of(row[order])
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order)))) + 1
    return order[rank <= k], rank[rank <= k]


def best_terms(row: np.ndarray, ids: np.ndarray, idf: np.ndarray, kinds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, rank, weight in millionths) of the content words with the largest (1 + ln tf) * idf."""
    content = (kinds[ids] & STOP) == 0
    row, ids, tf = counted(row[content], ids[content], len(idf))
    weight = np.rint((1 + np.log(tf)) * idf[ids] * 1e6).astype(np.int64)
    at, rank = first_of(row, weight, ids, k)
    return row[at], ids[at], rank, weight[at]


def signatures(words: list[str], dim: int, active: int, one: Callable[[str, int], np.ndarray]) -> np.ndarray:
    """Places of the words' signatures, a row each: ``one`` for the few words whose first three hashes have too few places."""
    digests = b"".join(hashlib.sha256(f"{w}#{b}".encode()).digest() for w in words for b in range(3))
    places = (np.frombuffer(digests, ">u2").reshape(len(words), 48) % dim).astype(np.int16)
    order = np.argsort(places, axis=1, kind="stable")
    ordered = np.take_along_axis(places, order, 1)
    again = np.zeros(places.shape, bool)
    np.put_along_axis(again, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
    nth = np.cumsum(~again, 1)
    out = np.full((len(words), active), -1, np.int16)
    whole = nth[:, -1] >= active
    out[whole] = places[whole][(~again & (nth <= active))[whole]].reshape(-1, active)
    for i in np.flatnonzero(~whole):
        found = one(words[i], dim)
        out[i, : len(found)] = found
    return out


def negated(row: np.ndarray, ids: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether a negator stands before it) of the content words that aren't negators, as ``corpus.signed_counts`` has them."""
    kind = kinds[ids]
    kept = np.flatnonzero(((kind & STOP) == 0) | ((kind & NEGATOR) > 0))
    row, no = row[kept], (kind[kept] & NEGATOR) > 0
    before = np.concatenate([[False], no[:-1] & (row[1:] == row[:-1])]) if len(row) else no
    return kept[~no], before[~no]


__all__ = ["CODE", "NOISE", "best_terms", "counted", "first_of", "idf_of", "negated", "per_document", "signatures", "slices"]
