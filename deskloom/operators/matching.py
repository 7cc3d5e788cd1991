"""Dedup, lookups and set operations between tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskloom.functions.rules import OTHER
from deskloom.functions.text import fingerprint


def keep_first(df: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """First row per key in the given order.

    ``rank = 1`` is pruned in every map task, so a key with a third of all rows sends
    one row per task through the shuffle.
    """
    first = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def unique_texts(df: DataFrame, text: str, order: str, key: str = "text_key") -> DataFrame:
    """One row per normalised text: key, first raw text in order, copies."""
    keyed = df.select(fingerprint(F.col(text)).alias(key), text, order)
    sizes = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    return keep_first(keyed, key, [order]).join(sizes, key)


def batch_dedup_stats(df: DataFrame, text: str) -> DataFrame:
    """One row: batch size, distinct normalised texts, and how many rows dedup saves."""
    per_key = df.select(fingerprint(F.col(text)).alias("k")).groupBy("k").agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("batch_size"),
        F.count(F.lit(1)).alias("distinct_texts"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("deduplicated_count"),
    )


def split_by_reuse(
    requests: DataFrame, prior: DataFrame, key: str = "text_key"
) -> tuple[DataFrame, DataFrame]:
    """(hits with the prior result, misses) of requests against a keyed results table.

    ``prior`` holds one row per key; hot keys sit on the request side only.
    """
    return requests.join(prior, key), requests.join(prior, key, "left_anti")


def without_seen(df: DataFrame, *seen: DataFrame, key: str = "text") -> DataFrame:
    """Rows whose key occurs in none of the seen tables.

    Keys are compared by digest: short rows of the seen tables move, not their texts.
    """
    digest = F.sha2(F.col(key).cast("string").cast("binary"), 256)
    columns = df.columns
    marked = df.withColumn("_digest", digest)
    for other in seen:
        marked = marked.join(other.select(digest.alias("_digest")).distinct(), "_digest", "left_anti")
    return marked.select(*columns)


def drop_leaked(
    train: DataFrame, held_out: DataFrame, text: str = "text", minimum: int = 0
) -> DataFrame:
    """Training rows whose text is not in the held-out set (a null text is in none).

    The join is on a digest, so no text is shuffled as a key. With ``minimum`` above 0, all
    rows stay, leaked ones too, if fewer than that would remain; off by default.
    """
    held = held_out.select(F.sha2(F.col(text).cast("binary"), 256).alias("_held")).filter("_held is not null").distinct()
    marked = train.join(held, F.sha2(F.col(text).cast("binary"), 256) == F.col("_held"), "left")
    if minimum <= 0:
        return marked.filter("_held is null").select(*train.columns)
    enough = (
        marked.filter("_held is null")
        .limit(minimum)
        .agg((F.count(F.lit(1)) >= minimum).alias("enough"))
    )
    return marked.filter(F.col("_held").isNull() | ~enough.scalar()).select(*train.columns)


def fall_back_group(
    queries: DataFrame, groups: DataFrame, group: str = "intent", other: str = OTHER
) -> DataFrame:
    """Queries with ``target``: their group, or ``other`` if the store has no such group.

    ``groups`` is the store (or its index); its distinct groups are few.
    """
    known = groups.select(F.col(group).alias("_known")).distinct()
    wanted = F.upper(F.col(group))
    return queries.join(known, wanted == F.col("_known"), "left").select(
        *queries.columns, F.coalesce("_known", F.lit(other)).alias("target")
    )


def tagged_union(**sources: DataFrame) -> DataFrame:
    """Union of (text, intent) tables, each tagged with its name as ``source``."""
    combined = None
    for name, df in sources.items():
        part = df.select("text", "intent", F.lit(name).alias("source"))
        combined = part if combined is None else combined.unionByName(part)
    return combined
