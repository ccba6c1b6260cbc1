"""Beliefs: the current value of each (entity, attribute) from dated facts, with graded confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DIM = 1024
GAMMA = 0.6
#: Below this margin a belief is contested.
LEAST_MARGIN = 0.05
_SLOT = ["entity", "attribute"]


def sign_bits(symbol: Column) -> Column:
    """DIM bits of a symbol as 16 integers of 64 bits, of which a bit stands for +1 or -1."""
    halves = [F.sha2(F.concat(symbol, F.lit(f"#{i}")), 256) for i in range(DIM // 256)]
    words = [F.conv(F.substring(h, 16 * j + 1 + 8 * k, 8), 16, 10).cast("bigint") for h in halves for j in range(4) for k in (0, 1)]
    return F.array(*(F.shiftleft(words[2 * i], 32).bitwiseOR(words[2 * i + 1]) for i in range(DIM // 64)))


def history(facts: DataFrame) -> DataFrame:
    """Facts (entity, attribute, value, t) with their place in the order of t, then value."""
    order = Window.partitionBy(*_SLOT).orderBy("t", "value")
    return facts.select(*_SLOT, "value", "t").withColumn("place", F.row_number().over(order))


def weights(facts: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """(entity, attribute, value, n, age, w): w is the sum of gamma ** age over its facts, age the number of later distinct t."""
    order = Window.partitionBy(*_SLOT).orderBy(F.desc("t"))
    aged = facts.select(*_SLOT, "value", (F.dense_rank().over(order) - 1).alias("age"))
    return aged.groupBy(*_SLOT, "value").agg(F.count("*").alias("n"), F.min("age").alias("age"), F.sum(F.pow(F.lit(gamma), F.col("age"))).alias("w"))


def margins(facts: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """(entity, attribute, nearest, second, margin): clean-up of the recency bundle against all values of the attribute.

    The similarity of a candidate is the sum over the slot's values of w times the dot product of their signs over DIM. Candidates are
    the attribute's values; pairs of values are formed once per attribute, not per slot.
    """
    w = weights(facts, gamma)
    values = facts.select("attribute", "value").distinct().withColumn("bits", sign_bits(F.concat_ws(":", F.lit("V"), "attribute", "value")))
    a, b = values.alias("a"), values.alias("b")
    same = F.aggregate(F.zip_with(F.col("a.bits"), F.col("b.bits"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    dots = a.join(b, F.col("a.attribute") == F.col("b.attribute")).select(F.col("a.attribute").alias("attribute"), F.col("a.value").alias("candidate"), F.col("b.value").alias("value"), (1 - 2 * same / DIM).alias("dot"))
    sims = w.select(*_SLOT, "value", "w").join(dots, ["attribute", "value"]).groupBy(*_SLOT, "candidate").agg(F.sum(F.col("w") * F.col("dot")).alias("sim"))
    order = Window.partitionBy(*_SLOT).orderBy(F.round("sim", 9).desc(), "candidate")
    top = sims.withColumn("r", F.row_number().over(order)).where("r <= 2")
    wide = top.groupBy(*_SLOT).agg(F.max(F.when(F.col("r") == 1, F.col("candidate"))).alias("nearest"), F.max(F.when(F.col("r") == 2, F.col("candidate"))).alias("second"), (F.max(F.when(F.col("r") == 1, F.col("sim"))) - F.coalesce(F.max(F.when(F.col("r") == 2, F.col("sim"))), F.lit(0.0))).alias("margin"))
    return wide


def latest(facts: DataFrame) -> DataFrame:
    """(entity, attribute, value, candidates, t): the value at the last t, null if there are several. One aggregation, with partial sums."""
    last = facts.groupBy(*_SLOT, "t").agg(F.array_sort(F.collect_set("value")).alias("found"))
    best = last.groupBy(*_SLOT).agg(F.max(F.struct("t", "found")).alias("m"))
    return best.select(*_SLOT, F.when(F.size("m.found") == 1, F.col("m.found")[0]).alias("value"), F.col("m.found").alias("candidates"), F.col("m.t").alias("t"))


def current(facts: DataFrame, least_margin: float = LEAST_MARGIN, gamma: float = GAMMA) -> DataFrame:
    """(entity, attribute, value, confidence, contested, to_clarify, candidates).

    Contested: several values at the last t, or a margin under ``least_margin``; to be clarified also where the bundle's value is another
    than the last. candidates: the values in question, none if nothing is.
    """
    rows = latest(facts).join(margins(facts, gamma), _SLOT)
    tie, weak = F.col("value").isNull(), F.round("margin", 9) < least_margin
    other = ~tie & (F.col("nearest") != F.col("value"))
    none = F.array().cast("array<string>")
    seen = F.when(tie, F.col("candidates")).when(weak, F.filter(F.array("nearest", "second"), lambda x: x.isNotNull())).otherwise(none)
    return rows.select(*_SLOT, "value", F.round("margin", 4).alias("confidence"), (tie | weak).alias("contested"), (tie | weak | other).alias("to_clarify"), seen.alias("candidates"))


def calibrate(facts: DataFrame, alpha: float = 0.05, least_slots: int = 30, gamma: float = GAMMA) -> DataFrame:
    """(threshold, slots, answered, error): the least margin from which on at most ``alpha`` of the slots are wrong.

    Slots with one value at the last t, of attributes with two values at least, count. slots < ``least_slots`` gives a null threshold. If no
    margin will do, the threshold lies above the largest. Errors are counted by distinct margin, so the sequential part is a window over
    one row for each margin rounded to nine places.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha is between 0 and 1")
    rows = latest(facts).where("value is not null").join(margins(facts, gamma).where("second is not null"), _SLOT)
    points = rows.groupBy(F.round("margin", 9).alias("margin")).agg(F.count("*").alias("n"), F.count_if(F.col("nearest") != F.col("value")).alias("wrong"))
    above = Window.orderBy(F.desc("margin")).rowsBetween(Window.unboundedPreceding, 0)
    tails = points.select("margin", F.sum("n").over(above).alias("kept"), F.sum("wrong").over(above).alias("bad"))
    fits = F.col("bad") / F.col("kept") <= alpha
    sums = tails.agg(F.min(F.when(fits, F.col("margin"))).alias("least"), F.min_by(F.struct("kept", "bad"), F.when(fits, F.col("margin"))).alias("at"), F.max("margin").alias("largest"), F.max("kept").alias("slots"))
    enough = F.col("slots") >= least_slots
    return sums.select(
        F.when(enough, F.coalesce("least", F.col("largest") + 1e-9)).alias("threshold"),
        F.coalesce("slots", F.lit(0)).alias("slots"),
        F.when(enough, F.round(F.coalesce(F.col("at.kept"), F.lit(0)) / F.col("slots"), 4)).alias("answered"),
        F.when(enough, F.round(F.coalesce(F.col("at.bad") / F.col("at.kept"), F.lit(0.0)), 4)).alias("error"),
    )


def resolve(beliefs: DataFrame, evidence: DataFrame, least: float = 0.05, asked: DataFrame | None = None) -> DataFrame:
    """(entity, attribute, status, value, margin): contested beliefs settled by ``evidence`` (entity, attribute, value, score).

    A value's evidence is the sum of its three best scores. "clear" without need, "resolved" if the best is positive and leads by
    ``least``, else "undecided". ``asked``: (entity, attribute); one that has no belief is "unknown".
    """
    top = Window.partitionBy(*_SLOT, "value").orderBy(F.desc("score"))
    sums = evidence.withColumn("r", F.row_number().over(top)).where("r <= 3").groupBy(*_SLOT, "value").agg(F.round(F.sum("score"), 4).alias("proof"))
    order = Window.partitionBy(*_SLOT).orderBy(F.desc("proof"), "value")
    best = sums.withColumn("r", F.row_number().over(order)).where("r <= 2").groupBy(*_SLOT).agg(F.max(F.when(F.col("r") == 1, F.col("value"))).alias("proved"), F.max(F.when(F.col("r") == 1, F.col("proof"))).alias("first"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("proof"))), F.lit(0.0)).alias("next"))
    held = beliefs.select(*_SLOT, "value", "to_clarify")
    if asked is not None:
        held = asked.select(*_SLOT).distinct().join(held, _SLOT, "left")
    rows = held.join(best, _SLOT, "left")
    margin = F.round(F.coalesce("first", F.lit(0.0)) - F.coalesce("next", F.lit(0.0)), 4)
    status = F.when(F.col("to_clarify").isNull(), "unknown").when(~F.col("to_clarify"), "clear").when((F.coalesce("first", F.lit(0.0)) > 0) & (margin >= least), "resolved").otherwise("undecided")
    return rows.select(*_SLOT, status.alias("status"), F.when(status == "resolved", F.col("proved")).otherwise(F.col("value")).alias("value"), margin.alias("margin"))


def reasserted(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """``facts`` and, for each slot that ``resolve`` settled, its value once more at the slot's last t + 1."""
    last = facts.groupBy(*_SLOT).agg((F.max("t") + 1).alias("t"))
    new = resolved.where("status = 'resolved'").select(*_SLOT, "value").join(last, _SLOT).select(*_SLOT, "value", "t")
    return facts.select(*_SLOT, "value", "t").unionByName(new)


def store(facts: DataFrame, path: str) -> None:
    """Adds facts to a folder of JSON lines; bundles are never stored, they follow from the facts."""
    facts.select(*_SLOT, "value", F.col("t").cast("double").alias("t")).write.mode("append").json(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The facts of such a folder; lines that are none are passed over."""
    rows = spark.read.schema("entity string, attribute string, value string, t double").option("mode", "DROPMALFORMED").json(path)
    return rows.where("entity is not null and attribute is not null and value is not null and t is not null")
