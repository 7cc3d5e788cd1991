"""Batch classification with reuse of earlier results and one scoring per text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.functions.probabilities import prediction_detail, uniform
from deskloom.functions.rules import LIMITS, TAXONOMY
from deskloom.functions.text import fingerprint
from deskloom.operators.matching import keep_first
from deskloom.operators.sampling import batches
from deskloom.session import materialize


def validate_requests(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows with ``valid`` and ``reason``; the length is checked untrimmed."""
    size = F.length(F.col(text))
    reason = (
        F.when(F.col(text).isNull(), "missing")
        .when(size < LIMITS.min_request_chars, "too_short")
        .when(size > LIMITS.max_request_chars, "too_long")
    )
    return df.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def request_batches(df: DataFrame, order: str, size: int = LIMITS.max_batch) -> DataFrame:
    """Rows numbered into batches of at most ``size``."""
    return batches(df, order, size)


def score_new(
    requests: DataFrame,
    prior: DataFrame | None,
    score: Callable[[Column], Column] | None = None,
    order: str = "request_id",
    labels: Sequence[str] = TAXONOMY,
) -> DataFrame:
    """(text_key, detail) for each distinct text without a prior result.

    ``score`` maps a text column to a probability array; without one the prior is uniform.
    """
    keyed = requests.filter(F.col("text").isNotNull()).select(fingerprint(F.col("text")).alias("text_key"), "text", order)
    missing = keyed if prior is None else keyed.join(prior, "text_key", "left_anti")
    one_each = keep_first(missing, "text_key", [order])
    probs = uniform(len(labels)) if score is None else score(F.col("text"))
    return (
        one_each.withColumn("_probs", probs)
        .select("text_key", prediction_detail(F.col("_probs"), labels).alias("detail"))
    )


def classify_batch(
    requests: DataFrame,
    prior: DataFrame,
    score: Callable[[Column], Column] | None = None,
    order: str = "request_id",
    labels: Sequence[str] = TAXONOMY,
) -> DataFrame:
    """Every request with its ``detail`` and whether it was ``cached``.

    ``prior`` is (text_key, detail), one row per key. The result table is unique by key;
    copies of a text sit on the request side of the join, where skew is split. A request
    without a text is not scored: its key and detail are null and it is not cached.
    """
    prior = materialize(prior.select("text_key", "detail"), "prior")  # read by two branches
    fresh = score_new(requests, prior.select("text_key"), score, order, labels)
    known = prior.select("text_key", "detail", F.lit(True).alias("cached")).unionByName(
        fresh.select("text_key", "detail", F.lit(False).alias("cached"))
    )
    keyed = requests.withColumn("text_key", fingerprint(F.col("text")))
    answered = keyed.filter(F.col("text").isNotNull()).join(known, "text_key")
    nothing = F.lit(None).cast(fresh.schema["detail"].dataType)
    refused = keyed.filter(F.col("text").isNull()).select(*keyed.columns, nothing.alias("detail"), F.lit(False).alias("cached"))
    return answered.unionByName(refused)


def batch_stats(classified: DataFrame) -> DataFrame:
    """One row: batch size, reuse hits, and rows saved by in-batch dedup. Refused requests, those
    without a text, count in the size only."""
    per_key = classified.groupBy("text_key", "cached").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("batch_size"),
        F.coalesce(F.sum(F.when(F.col("cached"), F.col("n"))), F.lit(0)).alias("cache_hits"),
        F.coalesce(F.sum(F.when(~F.col("cached") & F.col("text_key").isNotNull(), F.col("n") - 1)), F.lit(0)).alias(
            "deduplicated_count"
        ),
    )
