"""Vault mining: a deduplicated table of question-answer pairs per intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.functions.intents import Cues, classify_by_cues
from deskloom.functions.rules import BRAND, CUES, Brand, LIMITS
from deskloom.functions.text import contains_any, dedup_key, sanitize_customer, sanitize_reply
from deskloom.operators.matching import keep_first
from deskloom.operators.ordering import top_n_per_group
from deskloom.operators.sampling import pair_ids
from deskloom.operators.threads import first_adjacent_pair, first_pair_in_array


def pair_is_useful(query: Column, reply: Column, keywords: tuple[str, ...] = BRAND.keywords) -> Column:
    """Long enough on both sides, and a reply that points somewhere."""
    return (
        (F.length(query) >= LIMITS.min_query_chars)
        & (F.length(reply) >= LIMITS.min_reply_chars)
        & (F.contains(reply, F.lit("{")) | contains_any(F.lower(reply), keywords))
    )


def curate_pairs(
    pairs: DataFrame,
    order: str,
    cues: Cues = CUES,
    brand: Brand = BRAND,
    max_per_intent: int | None = None,
) -> DataFrame:
    """Vault rows from (``order``, case_id, customer_text, agent_text).

    ``order`` is a unique integer giving the source order: of pairs with the same wording
    the first stays, and ids count along it.
    """
    clean = pairs.select(
        order,
        F.col("case_id").cast("string").alias("case_id"),
        sanitize_customer(F.col("customer_text")).alias("customer_query"),
        sanitize_reply(F.col("agent_text"), brand).alias("agent_reply"),
    ).filter(pair_is_useful(F.col("customer_query"), F.col("agent_reply"), brand.keywords))
    keyed = clean.withColumn("_key", dedup_key(F.col("customer_query")))
    distinct = keep_first(keyed, "_key", [order]).drop("_key")
    labeled = distinct.withColumn(
        "intent", classify_by_cues(F.col("customer_query"), cues)["intent"]
    )
    if max_per_intent is not None:
        labeled = top_n_per_group(labeled, ["intent"], [F.col(order)], max_per_intent).drop("rn")
    return pair_ids(labeled, order).select(
        "pair_id", "case_id", "intent", "customer_query", "agent_reply"
    )


def build_vault(
    turns: DataFrame,
    is_brand: Column,
    group: str = "conv_id",
    order: str = "turn",
    text: str = "text",
    **options,
) -> DataFrame:
    """Vault from long-form threads: the first answered turn of each conversation."""
    pairs = first_adjacent_pair(turns, is_brand, group, order, text)
    return curate_pairs(pairs.withColumn("case_id", F.col(group)), group, **options)


def build_vault_from_cases(cases: DataFrame, order: str, brand: Brand = BRAND, **options) -> DataFrame:
    """Vault from case rows that carry their turns as an array."""
    found = cases.filter(F.size("raw_turns") >= 2).withColumn(
        "_pair", first_pair_in_array(F.col("raw_turns"), brand.author)
    )
    pairs = found.filter("_pair is not null").select(order, "case_id", "_pair.*")
    return curate_pairs(pairs, order, brand=brand, **options)
