"""Heads of a multi-task model and the verdicts that follow from them, as Columns on arrays of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import argmax, softmax

#: Labels of each head, in order (see vocabulary): presence 3, presentation, addressee and authority 5 each.
SIZES = {"presence": 3, "presentation": 5, "addressee": 5, "authority": 5}


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x.cast("double")))


def label_id(x: Column, vocabulary: list[str]) -> Column:
    """Index of a label; an unknown one fails."""
    at = F.array_position(F.array(*[F.lit(v) for v in vocabulary]), x)
    return F.when(at > 0, at - 1).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(x, F.lit("null"))))).cast("long")


def multi_hot(labels: Column, vocabulary: list[str]) -> Column:
    return F.transform(F.array(*[F.lit(v) for v in vocabulary]), lambda v: F.array_contains(labels, v).cast("double"))


def heads(vectors: DataFrame, vector: str = "embedding", steep: float = 8.0) -> DataFrame:
    """vectors with the probabilities of each head, `direct` (a binary head) and `derived`: that all four heads say what a detection needs."""
    at, out = 1, vectors
    for name, size in SIZES.items():
        out = out.withColumn(name, softmax(F.slice(vector, at, size)))
        at += size
    p = lambda head, k: F.get(head, F.lit(k))
    derived = p("presence", 1) * p("presentation", 0) * p("addressee", 0) * (p("authority", 1) + p("authority", 2))
    return out.withColumn("direct", sigmoid(F.get(vector, F.lit(at - 1)).cast("double") * steep)).withColumn("derived", F.least(F.greatest(derived, F.lit(0.0)), F.lit(1.0)))


def strategies(rows: DataFrame, direct: float, derived: float, blended: float, alpha: float) -> DataFrame:
    """vec_id and the verdict by the direct head, by the derived probability (UNCERTAIN where presence is undetermined), and by their blend."""
    said = lambda p, least: F.when(p >= least, "DETECTED").otherwise("NOT_DETECTED")
    open_ = argmax(F.col("presence")) == 2
    blend = F.lit(alpha) * F.col("direct") + F.lit(1 - alpha) * F.col("derived")
    return rows.select("vec_id", said(F.col("direct"), direct).alias("direct"), F.when(open_, "UNCERTAIN").otherwise(said(F.col("derived"), derived)).alias("derived"), said(blend, blended).alias("blended"))


def best_alpha(rows: DataFrame, least: float, cost: float) -> DataFrame:
    """alpha, objective: the share of the direct head, on a grid of tenths, with the best macro F1 less cost times the rate of false alarms; ties: the smaller."""
    grid = rows.select("truth", "direct", "derived", F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: k / F.lit(10.0))).alias("alpha"))
    hit = F.col("alpha") * F.col("direct") + (1 - F.col("alpha")) * F.col("derived") >= least
    n = lambda truth, said: F.count(F.when((F.col("truth") == truth) & (hit == F.lit(said)), 1))
    c = grid.groupBy("alpha").agg(n(1, True).alias("tp"), n(1, False).alias("fn"), n(0, True).alias("fp"), n(0, False).alias("tn"))
    f1 = lambda x: 2 * F.col(x) / F.greatest(2 * F.col(x) + F.col("fp") + F.col("fn"), F.lit(1))
    score = (f1("tp") + f1("tn")) / 2 - cost * F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1))
    return c.select("alpha", F.round(score, 9).alias("objective")).orderBy(F.desc("objective"), "alpha").limit(1)
