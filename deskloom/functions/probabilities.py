"""Class-probability vectors: ranking, margin, entropy, ambiguity, triage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskloom.functions.rules import LIMITS, Limits


def ranked(probs: Column) -> Column:
    """Array of (p, i), most probable first; of equal ones the later class comes first."""
    return F.sort_array(
        F.transform(probs, lambda p, i: F.struct(p.cast("double").alias("p"), i.alias("i"))), False
    )


def entropy(probs: Column) -> Column:
    """Shannon entropy in bits, p clipped to [1e-12, 1], 4 digits."""
    total = F.aggregate(
        probs,
        F.lit(0.0),
        lambda acc, p: acc
        - F.greatest(F.lit(1e-12), F.least(F.lit(1.0), p.cast("double")))
        * F.log2(F.greatest(F.lit(1e-12), F.least(F.lit(1.0), p.cast("double")))),
    )
    return F.round(total, 4)


def is_ambiguous(confidence: Column, margin: Column) -> Column:
    """Narrow lead or low confidence, on unrounded numbers."""
    return (margin < 0.15) | (confidence < 0.60)


def uniform(n: int) -> Column:
    """Prior used when no model is configured."""
    return F.array_repeat(F.lit(1.0 / n), n)


def probability_map(probs: Column, labels: Sequence[str]) -> Column:
    """Map label -> probability with 4 digits."""
    return F.map_from_arrays(
        F.array(*[F.lit(name) for name in labels]),
        F.transform(probs, lambda p: F.round(p.cast("double"), 4)),
    )


def prediction_detail(probs: Column, labels: Sequence[str]) -> Column:
    """Struct with intent, confidence, probabilities, top2, margin, entropy, ambiguous."""
    names = F.array(*[F.lit(name) for name in labels])

    def detail(probs: Column, order: Column) -> Column:
        first, second = order[0], order[F.least(F.lit(1), F.size(order) - 1)]
        return F.struct(
            names[first["i"]].alias("intent"),
            F.round(first["p"], 4).alias("confidence"),
            probability_map(probs, labels).alias("probabilities"),
            F.array(
                *[
                    F.struct(
                        names[top["i"]].alias("intent"),
                        F.round(top["p"], 4).alias("probability"),
                    )
                    for top in (first, second)
                ]
            ).alias("top2"),
            (first["p"] - second["p"]).alias("margin"),
            entropy(probs).alias("entropy"),
            is_ambiguous(first["p"], first["p"] - second["p"]).alias("ambiguous"),
        )

    def of(probs: Column) -> Column:
        return F.transform(F.array(ranked(probs)), lambda order: detail(probs, order))[0]

    return F.transform(F.array(probs), of)[0]  # ``probs`` may read a whole text: evaluated once


def triage(confidence: Column, limits: Limits = LIMITS) -> Column:
    """ACCEPT, QUEUE for verification, or DROP a machine-labelled text."""
    return (
        F.when(confidence >= limits.accept_at, "ACCEPT")
        .when(confidence >= limits.queue_at, "QUEUE")
        .otherwise("DROP")
    )
