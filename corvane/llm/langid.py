"""Language ID in two levels: the family first, then one-versus-one linear SVMs between the languages of that family."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm._text import buffers, slices
from corvane.session import join_checked

#: Features: counts of hashed byte trigrams.
BITS = 15
#: Labelled rows of each language that the models are fitted on.
MAX_TRAIN_ROWS = 300
#: A document is rejected if fewer of its trigrams than this share occur in the training rows of any language.
MIN_KNOWN = 0.35
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance"}

_LUT = np.full(256, 32, np.uint8)
_LUT[97:123] = np.arange(97, 123)
_LUT[65:91] = np.arange(97, 123)
_LUT[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigram, document): lower case, digits and signs as space; trigrams without a letter are left out."""
    low = _LUT[data].astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    ok = (low[1:-1] != 32) | ((low[:-2] != 32) & (low[2:] != 32))
    ends = offsets[1:]
    for back in (1, 2):
        last = ends - back
        last = last[(last >= 0) & (last < len(ok))]
        ok[last] = False
    at = np.flatnonzero(ok)
    return ((code[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64), np.searchsorted(offsets, at, side="right") - 1


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = buffers(batch.column(1))
        lang = batch.column(0)
        for i in range(len(offsets) - 1):
            code, _ = trigrams(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
            index, count = np.unique(code, return_counts=True)
            if len(index):
                yield pa.RecordBatch.from_arrays([lang.slice(i, 1), pa.array([index.astype(np.int32)], pa.list_(pa.int32())), pa.array([count.astype(np.int32)], pa.list_(pa.int32()))], ["lang", "index", "count"])


@dataclass
class Model:
    """Columns of ``weights``: a score per family, a margin per pair of languages of one family, and 1 for known trigrams."""

    languages: list[str]
    family_of: dict[str, str]
    families: list[str] = field(default_factory=list)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = None
    bias: np.ndarray = None

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents x columns of mean weights plus bias, number of trigrams)."""
        n = len(offsets) - 1
        code, doc = trigrams(data, offsets)
        total = np.bincount(doc, minlength=n)
        out = np.zeros((n, self.weights.shape[0]))
        if len(doc):
            heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            for c, w in enumerate(self.weights):
                out[doc[heads], c] = np.add.reduceat(w[code], heads, dtype=np.float64)
        return out / np.maximum(total, 1)[:, None] + self.bias, total

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list, list, np.ndarray, np.ndarray]:
        """(family, language, margin, share of known trigrams); both names are None for a document without a letter."""
        scores, total = self.scores(data, offsets)
        n, f = len(total), len(self.families)
        if not f:
            return [None] * n, [None] * n, np.zeros(n), np.zeros(n)
        best = scores[:, :f].argmax(1)
        votes = np.zeros((n, len(self.languages)))
        strength = np.zeros((n, len(self.languages)))
        for p, (a, b) in enumerate(self.pairs):
            margin = scores[:, f + p]
            ia, ib = self.languages.index(a), self.languages.index(b)
            votes[:, ia] += margin >= 0
            votes[:, ib] += margin < 0
            strength[:, ia] += margin
            strength[:, ib] -= margin
        place = np.array([self.families.index(self.family_of[x]) for x in self.languages])
        rank = np.where(place[None, :] == best[:, None], votes + 1e-3 * np.tanh(strength), -np.inf)
        choice = rank.argmax(1)
        margin = np.round(strength[np.arange(n), choice], 6)
        families = [self.families[i] if t else None for i, t in zip(best, total)]
        return families, [self.languages[i] if t else None for i, t in zip(choice, total)], margin, np.round(scores[:, -1], 6)


def _svm(rows: np.ndarray, index: np.ndarray, value: np.ndarray, n: int, y: np.ndarray, c: float = 10.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss on sparse rows, by accelerated gradient descent; classes weigh the same."""
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * n * c / n
    heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    w, b = np.zeros(1 << BITS), 0.0
    v, vb, t = w, b, 1.0
    rate = 1.0 / (1.0 + 4.0 * c)
    for _ in range(steps):
        out = np.add.reduceat(v[index] * value, heads) + vb
        slack = np.maximum(0.0, 1.0 - y * out) * y * cost
        nw = v - rate * (v * 1e-3 - 2 * np.bincount(index, weights=value * slack[rows], minlength=1 << BITS))
        nb = vb + rate * 2 * slack.sum()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]], families: dict[str, str] = FAMILIES) -> Model:
    """A model from (language, trigrams, counts); a language that ``families`` doesn't have is a family of its own."""
    samples = sorted(samples, key=lambda s: (s[0], len(s[1]), s[1].tobytes(), s[2].tobytes()))
    languages = sorted({s[0] for s in samples})
    family_of = {x: families.get(x, x) for x in languages}
    model = Model(languages, family_of, sorted(set(family_of.values())))
    if not languages:
        model.weights, model.bias = np.zeros((1, 1 << BITS), np.float32), np.zeros(1)
        return model
    lang = np.array([s[0] for s in samples])
    kin = np.array([family_of[x] for x in lang])
    sizes = np.array([len(s[1]) for s in samples])
    rows, index = np.repeat(np.arange(len(samples)), sizes), np.concatenate([s[1] for s in samples]).astype(np.int64)
    count = np.concatenate([s[2] for s in samples]).astype(np.float64)
    seen = np.bincount(index, weights=count, minlength=1 << BITS) > 0
    share = count / np.repeat(np.array([s[2].sum() for s in samples], np.float64), sizes)
    scale = 1 / max(1e-9, float(np.sqrt(np.bincount(rows, weights=share**2)).mean()))
    value = share * scale
    weights, bias = [], []

    def one(mask: np.ndarray, y: np.ndarray) -> None:
        back = np.cumsum(mask) - 1
        some = mask[rows]
        w, b = _svm(back[rows[some]], index[some], value[some], int(mask.sum()), y[mask].astype(np.float64))
        weights.append(w * scale)
        bias.append(b)

    everyone = np.ones(len(samples), bool)
    for name in model.families:
        if len(model.families) > 1:
            one(everyone, np.where(kin == name, 1, -1))
        else:
            weights.append(np.zeros(1 << BITS))
            bias.append(0.0)
        for a, b in combinations([x for x in languages if family_of[x] == name], 2):
            model.pairs.append((a, b))
    for a, b in model.pairs:
        one((lang == a) | (lang == b), np.where(lang == a, 1, -1))
    model.weights = np.vstack([*weights, seen]).astype(np.float32)
    model.bias = np.array([*bias, 0.0])
    return model


def train(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS, families: dict[str, str] = FAMILIES) -> Model:
    """Fit on ``max_rows`` rows a language at most: of those with a doc_id, a lang and a letter in the text the first by a hash of doc_id."""
    labelled = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # a rank below a bound is cut off in each task before the shuffle; repeated rows share a rank, so they go afterwards
    chosen = labelled.select("doc_id", "lang").withColumn("_n", F.dense_rank().over(order)).where(F.col("_n") <= max_rows).select(F.col("doc_id").alias("_chosen"), F.col("lang").alias("_as")).distinct()
    texts = join_checked(labelled.select("doc_id", "lang", "text"), chosen, (F.col("doc_id") == F.col("_chosen")) & (F.col("lang") == F.col("_as")), "left_semi", row_bytes=64)
    rows = texts.select("lang", "text").mapInArrow(_count_batches, "lang string, index array<int>, count array<int>").toArrow()
    return fit([(a, np.array(b), np.array(c)) for a, b, c in zip(*(rows.column(i).to_pylist() for i in range(3)))], families)


def predict(docs: DataFrame, model: Model, columns: list, text_at: int | None = None) -> DataFrame:
    """The given columns with family, language, margin, known and accepted, from ``text``.

    text_at: the place of ``text``, unchanged, among the columns. It is read there then, as a second copy of the texts would double the
    Arrow batches, the most memory that this takes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few columns of 2 ** BITS floats, whatever the input
    inner = docs.select(F.struct(*columns).alias("_row"), *([F.col("text").alias("_text")] if text_at is None else []))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in it:
            row = batch.column(0)
            offsets, data = buffers(batch.column(1) if text_at is None else row.field(text_at))
            for a, b in slices(offsets):
                family, language, margin, known = m.predict(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                accepted = [x is not None and k >= MIN_KNOWN for x, k in zip(language, known)]
                yield pa.RecordBatch.from_arrays([row.slice(a, b - a), pa.array(family, pa.string()), pa.array(language, pa.string()), pa.array(margin), pa.array(known), pa.array(accepted)], ["_row", "_family", "_language", "_margin", "_known", "_accepted"])

    kinds = [("_family", T.StringType()), ("_language", T.StringType()), ("_margin", T.DoubleType()), ("_known", T.DoubleType()), ("_accepted", T.BooleanType())]
    return inner.mapInArrow(batches, T.StructType([inner.schema["_row"], *(T.StructField(n, k) for n, k in kinds)]))


def identify(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS, families: dict[str, str] = FAMILIES) -> DataFrame:
    """(doc_id, family, language, margin, known, accepted) for every row of ``docs``, null ids and repeated rows too.

    The family is the best of one-versus-rest linear models; within it, each pair of languages has a linear SVM and the language with
    most votes wins, ties by summed margin, then by name. ``known``: the share of the text's trigrams that training saw. A null or
    empty text, or one without a letter, has no language and is not accepted; nor is one with ``known`` under MIN_KNOWN. Rows with a
    null lang or without a letter aren't trained on and take no place among those that are. If no row has a label, no language is known
    and nothing is accepted. doc_id keeps its type; other columns, whatever their names, are of no effect. An empty table gives an empty
    result. Texts are read whole.
    """
    out = predict(docs, train(docs, max_rows, families), [F.col("doc_id")])
    return out.select(F.col("_row.doc_id").alias("doc_id"), F.col("_family").alias("family"), F.col("_language").alias("language"), F.col("_margin").alias("margin"), F.col("_known").alias("known"), F.col("_accepted").alias("accepted"))


def keep_identified(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS, families: dict[str, str] = FAMILIES) -> DataFrame:
    """The rows of ``docs`` that ``identify`` accepts, with all their columns as they are, null ids and repeated rows too."""
    at = docs.columns.index("text") if "text" in docs.columns else None  # a name in other letters may be that of another column
    out = predict(docs, train(docs, max_rows, families), [F.col(f"`{c}`") for c in docs.columns], at)
    return out.where("_accepted").select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
