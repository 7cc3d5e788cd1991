"""Case extraction: customer messages of the threads a brand took part in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.functions.rules import BRAND
from deskloom.functions.text import clean_message, parse_created_at, strip
from deskloom.operators.threads import select_threads


def extract_cases(
    messages: DataFrame, brand: str = BRAND.author, bad_time: Column | None = None
) -> DataFrame:
    """One nested case row per customer message with text, of any selected thread.

    ``messages`` is (msg_id, author_id, text, created_at, parent_id). An unreadable
    ``created_at`` becomes ``bad_time`` (NULL unless given). ``thread_id`` ties the
    messages of a thread together.
    """
    target = brand.lstrip("@").lower()
    selected = select_threads(messages, brand)
    customers = (
        messages.filter(F.lower("author_id") != target)
        .withColumn("raw_text", strip(F.col("text")))
        .withColumn("clean_text", clean_message(F.col("raw_text")))
        .filter(F.col("clean_text") != "")
    )
    created = parse_created_at(F.col("created_at"), bad_time)
    return customers.join(selected, "msg_id").select(
        F.col("msg_id").alias("case_id"),
        F.col("author_id").alias("customer_id"),
        F.lit("twitter").alias("channel"),
        F.array(
            F.struct(
                F.col("msg_id").alias("tweet_id"),
                "author_id",
                F.col("raw_text").alias("text"),
                created.alias("created_at"),
            )
        ).alias("raw_turns"),
        "clean_text",
        F.lit("en").alias("locale"),
        F.lit("STANDARD").alias("account_tier"),
        created.alias("timestamp"),
        F.col("root_id").alias("thread_id"),
    )
