"""Streams of documents and facts: additive tables by micro-batch, beliefs kept per slot with late facts counted in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators import corpus
from corvane.plans.index import Index

BELIEF = "entity string, attribute string, value string, contested boolean, n_facts bigint, t double"
_STATE = "ts array<double>, vs array<string>"


def count_words(docs: DataFrame) -> DataFrame:
    """(token, df, cf) of a stream of (doc_id, text), for outputMode "complete" or "update": sums, so the order of arrival is of no effect.

    df counts rows: a stream must hold each document once.
    """
    return corpus.vocabulary(corpus.token_arrays(docs))


def append_to(index: Index, docs: DataFrame, checkpoint: str, available_now: bool = True):
    """The query that appends each micro-batch of (doc_id, text) to an index.

    A batch that is run again after a failure brings ids that are there already; these are left out, so nothing is counted twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        now = Index.open(index.spark, index.path)
        new = batch.join(now.table("lengths").select("doc_id"), "doc_id", "left_anti").dropDuplicates(["doc_id"])
        if not new.isEmpty():
            now.append(new)

    writer = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _believe(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    times, values = (list(x) for x in state.get) if state.exists else ([], [])
    for frame in frames:
        times += [float(t) for t in frame["t"]]
        values += [str(v) for v in frame["value"]]
    state.update((times, values))
    last = max(times)
    found = sorted({v for t, v in zip(times, values) if t == last})
    yield pd.DataFrame([{"entity": key[0], "attribute": key[1], "value": found[0] if len(found) == 1 else None, "contested": len(found) > 1, "n_facts": len(times), "t": last}])


def beliefs(facts: DataFrame) -> DataFrame:
    """The current value of each slot of a stream of (entity, attribute, value, t), outputMode "update".

    The whole history of a slot is its state, so that a late fact counts as if it had come in time; none is dropped.
    """
    rows = facts.where("value is not null and t is not null")
    return rows.groupBy("entity", "attribute").applyInPandasWithState(_believe, BELIEF, _STATE, "update", GroupStateTimeout.NoTimeout)


_BUNDLE = "entity string, attribute string, weights map<string,double>, t double"
_SUMS = "ts array<double>, vs array<array<string>>, ns array<array<bigint>>, t double, ws map<string,double>"


def _decayed(gamma: float):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        weights, counts = {}, {}  # value -> weight; t -> value -> facts
        last = None
        if state.exists:
            ts, vs, ns, last, held = state.get
            counts = {t: dict(zip(v, n)) for t, v, n in zip(ts, vs, ns)}
            weights = dict(held)
        for frame in frames:
            for t, value in zip(frame["t"].astype(float), frame["value"].astype(str)):
                known = t in counts
                counts.setdefault(t, {}).setdefault(value, 0)
                counts[t][value] += 1
                if last is None or t >= last:  # in order: one step for all that is older, whatever its number
                    if last is not None and not known:
                        weights = {v: w * gamma for v, w in weights.items()}
                    weights[value] = weights.get(value, 0.0) + 1.0
                    last = t
                else:  # late: the bundle is made anew from the counts
                    weights = {}
                    for age, at in enumerate(sorted(counts, reverse=True)):
                        for v, n in counts[at].items():
                            weights[v] = weights.get(v, 0.0) + n * gamma**age
        times = sorted(counts)
        state.update((times, [list(counts[t]) for t in times], [list(counts[t].values()) for t in times], last, weights))
        yield pd.DataFrame([{"entity": key[0], "attribute": key[1], "weights": weights, "t": last}])

    return step


def bundles(facts: DataFrame, gamma: float = 0.6) -> DataFrame:
    """(entity, attribute, weights, t) of a stream of facts, outputMode "update": each value's weight by recency, as ``belief.weights``.

    A fact in order multiplies the slot's weights by ``gamma`` and adds one; only a late fact makes them anew, from the counts of each
    instant that are kept beside them.
    """
    rows = facts.where("value is not null and t is not null")
    return rows.groupBy("entity", "attribute").applyInPandasWithState(_decayed(gamma), _BUNDLE, _SUMS, "update", GroupStateTimeout.NoTimeout)


def answer(index: Index, queries: DataFrame, sink: str, checkpoint: str, available_now: bool = True, **options):
    """The query that searches an index for each micro-batch of (qid, text) and adds the hits to ``sink``.

    The index is opened anew for each batch, so appended documents are found. A batch that is run again overwrites its own part.
    """

    def search(batch: DataFrame, number: int) -> None:
        Index.open(index.spark, index.path).search(batch, **options).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = queries.writeStream.foreachBatch(search).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def sessions(journal: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(pid, start, end, n): sittings of a stream of journal lines (ts, pid), apart by ``gap``; lines over ``late`` behind are left out."""
    window = F.session_window("ts", gap)
    rows = journal.withWatermark("ts", late).groupBy("pid", window.alias("w")).agg(F.count("*").alias("n"))
    return rows.select("pid", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
