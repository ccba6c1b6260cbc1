"""Words as numbers: a sorted vocabulary that is sent along, so that tokens are looked up where their text is and aren't shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.session import checkpointed

#: Words of a vocabulary that is sent along: some 12 bytes a word where numbers are looked up, 20 where names are. Beyond it, joins do the work.
MAX_WORDS = 1 << 25
#: What a word is, as bits.
STOP, NEGATOR, CODE, NOISE = 1, 2, 4, 8
#: Sides of a comparison that a document is on, as bits.
BEFORE, AFTER = 1, 2


class Lexicon:
    """The words of a corpus, numbered in their order as strings, so that numbers compare as words do.

    Tokens are known by a hash of 64 bits, computed where the tokens are made; a seed is sought for which no two words share one.
    """

    def __init__(self, spark, names: pa.Array, hashes: np.ndarray, kinds: np.ndarray, df: np.ndarray, seed: int):
        self.spark, self.words, self.seed, self.kinds, self.df = spark, len(names), seed, kinds, df
        order = np.argsort(hashes)
        self.places = spark.sparkContext.broadcast((hashes[order], order.astype(np.int32), kinds))
        self.names = spark.sparkContext.broadcast(names)

    def hashed(self, tokens: Column) -> Column:
        return F.transform(tokens, lambda t: F.xxhash64(F.lit(self.seed), t))


def numbers(places: tuple[np.ndarray, np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """The numbers of words by their hashes; -1 for one that isn't a word of the corpus."""
    known, number, _ = places
    if not len(known):
        return np.full(len(hashes), -1, np.int32)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, number[at], -1)


def lexicon(arrays: DataFrame, side: str | None = None, most: int | None = None) -> Lexicon | None:
    """Of (doc_id, tokens[, side]); None if the corpus has more than ``most`` words. df counts documents: a row for each side, or one."""
    spark = arrays.sparkSession
    sides = F.col(side) if side else F.lit(BEFORE)
    rows = arrays.select(F.explode(F.array_distinct("tokens")).alias("token"), sides.cast("int").alias("_s"))
    counts = [F.sum((F.col("_s").bitwiseAND(bit) > 0).cast("int")).alias(f"n{bit}") for bit in ((BEFORE, AFTER) if side else (BEFORE,))]
    bit = lambda c, n: F.when(c, n).otherwise(0)
    kind = bit(T.is_stopword(F.col("token")), STOP) + bit(T.is_negator(F.col("token")), NEGATOR) + bit(T.is_code(F.col("token")), CODE) + bit(T.is_noise(F.col("token")), NOISE)
    words = checkpointed(rows.groupBy("token").agg(*counts))
    if words.count() > (MAX_WORDS if most is None else most):
        return None
    for seed in range(42, 52):
        found = words.select("token", F.xxhash64(F.lit(seed), "token").alias("h"), kind.cast("tinyint").alias("kind"), *(c for c in words.columns if c != "token")).toArrow()
        hashes = found.column("h").to_numpy()
        if len(np.unique(hashes)) == len(hashes):
            break
    else:
        raise ValueError("no seed keeps the words apart")
    found = found.set_column(0, "token", found.column("token").cast(pa.large_string()))
    found = found.take(pc.sort_indices(found.column("token"))).combine_chunks()
    names = pa.concat_arrays(found.column("token").chunks) if found.num_rows else pa.array([], pa.large_string())
    df = np.stack([found.column(c).to_numpy() for c in found.column_names if c.startswith("n")])
    return Lexicon(spark, names, found.column("h").to_numpy(), found.column("kind").to_numpy(), df, seed)


def packed(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Ascending whole numbers and a positive number for each, in bytes: differences and values by planes, of which those without content are left out."""
    first = int(keys[0])
    gaps = np.diff(keys)
    out = [np.array([len(keys), first], np.int64).tobytes()]
    for x in (gaps, values):
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        out += [bytes([width]), np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    return b"".join(out)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, first = np.frombuffer(data, np.int64, 2).tolist()
    at, out = 16, []
    for size in (n - 1, n):
        width = data[at]
        planes = np.zeros((size, 8), np.uint8)
        planes[:, :width] = np.frombuffer(data, np.uint8, size * width, at + 1).reshape(width, size).T
        out.append(planes.view("<i8").ravel())
        at += 1 + size * width
    return np.concatenate([[first], first + np.cumsum(out[0])]), out[1]


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, ascending, with the sum of its values. Both travel in one number while they fit, as sorting that is far quicker."""
    if not len(keys):
        return keys, values
    low, bits = int(keys.min()), int(values.max()).bit_length()
    if (int(keys.max()) - low).bit_length() + bits <= 62:
        both = ((keys - low) << bits) | values
        both.sort()
        keys, values = (both >> bits) + low, both & ((1 << bits) - 1)
    else:
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(values, starts)


def merged(blobs: Iterator[bytes], most: int = 1 << 23) -> tuple[np.ndarray, np.ndarray]:
    """The sum of packed tables, ``most`` entries or more at a time."""
    keys, values, size = [], [], 0
    for blob in blobs:
        k, v = unpacked(blob)
        keys.append(k)
        values.append(v)
        size += len(k)
        if size > most and len(keys) > 1:
            k, v = summed(np.concatenate(keys), np.concatenate(values))
            keys, values, size = [k], [v], 0
    return summed(np.concatenate(keys), np.concatenate(values)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
