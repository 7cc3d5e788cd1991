"""Bulk decisioning: safety, intent, precedent, route and reply for every case."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.functions.intents import classify_by_cues
from deskloom.functions.payloads import coerce_confidence, coerce_label
from deskloom.functions.replies import guard_draft
from deskloom.functions.routing import LEXICAL, best_template, route, zone
from deskloom.functions.rules import BRAND, Brand, OTHER, SAFE_TRIAGE, Zones
from deskloom.functions.safety import assess_safety, escalation_priority
from deskloom.functions.text import at_handle, clean_draft, fingerprint, strip
from deskloom.operators.matching import fall_back_group, keep_first
from deskloom.operators.vectors import LexicalIndex, build_index, lexical_matches
from deskloom.session import materialize


def triage_cases(
    cases: DataFrame,
    classify: Callable[[Column], Column] | None = None,
    verdicts: DataFrame | None = None,
) -> DataFrame:
    """Cases (case_id, text, handle) with safety and intent columns.

    ``classify`` maps a text column to a struct (intent, confidence); its answer is coerced
    to the taxonomy. ``verdicts`` is (case_id, response) from an external verifier.
    """
    base = cases.select(
        "case_id", strip(F.col("text")).alias("text"), at_handle(F.col("handle")).alias("handle")
    )
    verdict = None
    if verdicts is not None:
        base = base.join(verdicts.select("case_id", F.col("response").alias("_verdict")), "case_id", "left")
        verdict = F.col("_verdict")
    checked = base.withColumn("safety", assess_safety(F.col("text"), verdict))
    if classify is None:
        guess = classify_by_cues(F.col("text"))
        checked = checked.withColumn("_guess", guess)
        intent, confidence = F.col("_guess.intent"), F.col("_guess.confidence")
    else:
        checked = checked.withColumn("_guess", classify(F.col("text")))
        intent = coerce_label(F.col("_guess.intent"))
        confidence = coerce_confidence(F.col("_guess.confidence"))
    return checked.select(
        "case_id", "text", "handle", "safety", intent.alias("intent"), confidence.alias("confidence")
    )


def search(
    queries: DataFrame,
    vault: DataFrame,
    k: int = 3,
    index: LexicalIndex | None = None,
) -> DataFrame:
    """Best precedents per query, without their texts: (query_key, target, best, top_similarity).

    ``queries`` is (query_key, text, target) with one row per key; ``best`` holds at most k structs
    (rank, item, score), best first.
    """
    index = index or build_index(
        vault.select("pair_id", "intent", "customer_query"), "pair_id", "intent", "customer_query", k
    )
    # Rows per (query, item) move through shuffles: a number for each query in place of its digest.
    numbered = materialize(
        queries.select("query_key", "text", "target", F.monotonically_increasing_id().alias("query")), "queries"
    )
    found = lexical_matches(numbered, index, "query", "target", "text", k)
    return (
        found.join(vault.select(F.col("pair_id").alias("item")), "item", "left_semi")
        .groupBy("query")
        .agg(
            F.array_sort(F.collect_list(F.struct("rank", "item", "score"))).alias("best"),
            F.max("score").alias("top_similarity"),
        )
        .join(numbered.select("query", "query_key", "target"), "query")
        .select("query_key", "target", "best", "top_similarity")
    )


def matched_pairs(found: DataFrame, vault: DataFrame, row: str) -> DataFrame:
    """(``row``, matches) of (``row``, target, best): the precedents with their texts.

    Texts of k precedents move once, to the row that they belong to."""
    pairs = vault.select(F.col("pair_id").alias("item"), "case_id", "customer_query", "agent_reply")
    match = F.struct(
        "rank",
        F.col("item").alias("pair_id"),
        "case_id",
        F.col("target").alias("intent"),
        "customer_query",
        "agent_reply",
        F.col("score").alias("similarity_score"),
    )
    listed = found.select(row, "target", F.inline("best")).join(pairs, "item")
    return listed.groupBy(row).agg(F.array_sort(F.collect_list(match)).alias("matches"))


def retrieve(
    rows: DataFrame, queries: DataFrame, vault: DataFrame, k: int = 3, index: LexicalIndex | None = None
) -> DataFrame:
    """(_row, target, best, top_similarity) of the rows (_row, query_key, target) that have precedents.

    A written table of numbers and ids; ``matched_pairs`` adds the texts where they are wanted."""
    found = search(queries, vault, k, index)
    placed = rows.select("_row", "query_key", "target").join(found, ["query_key", "target"])
    return materialize(placed.select("_row", "target", "best", "top_similarity"), "best-items")


def decide(
    cases: DataFrame,
    vault: DataFrame,
    classify: Callable[[Column], Column] | None = None,
    verdicts: DataFrame | None = None,
    drafts: DataFrame | None = None,
    index: LexicalIndex | None = None,
    zones: Zones = LEXICAL,
    brand: Brand = BRAND,
    k: int = 3,
) -> DataFrame:
    """One decision row per case (case_id, text, handle).

    Cases blocked for safety never reach the similarity join; each remaining text is
    searched once, however many cases repeat it. ``drafts`` is (case_id, draft) from an
    external generator; a missing or rule-breaking draft is replaced by the best template.
    """
    checked = triage_cases(cases, classify, verdicts).withColumn("query_key", fingerprint(F.col("text")))
    targets = fall_back_group(checked, vault.select("intent"))
    triaged = materialize(targets.withColumn("_row", F.monotonically_increasing_id()), "triaged")
    blocked = F.col("safety.is_hazard")
    targeted = triaged.filter(~blocked)
    queries = keep_first(
        targeted.select("query_key", "text", "target").withColumn(
            "_k", F.concat_ws("|", "query_key", "target")
        ),
        "_k",
        ["text"],
    ).drop("_k")
    found = retrieve(targeted, queries, vault, k, index)
    searched = targeted.join(found.select("_row", "top_similarity"), "_row", "left").join(
        matched_pairs(found, vault, "_row"), "_row", "left"
    )
    if drafts is not None:
        searched = searched.join(
            drafts.select("case_id", F.col("draft").alias("_draft")), "case_id", "left"
        )
    else:
        searched = searched.withColumn("_draft", F.lit(None).cast("string"))

    similarity = F.coalesce("top_similarity", F.lit(0.0))
    graded = (
        searched.withColumn("top_similarity", similarity)
        .withColumn("confidence_zone", zone(F.col("top_similarity"), zones))
        .withColumn(
            "_template",
            best_template(F.col("confidence_zone"), F.get("matches", F.lit(0))["agent_reply"], SAFE_TRIAGE),
        )
        .withColumn(
            "routing",
            route(F.col("intent"), F.col("confidence"), F.col("top_similarity"), F.col("confidence_zone")),
        )
        .withColumn(
            "_reply",
            guard_draft(
                clean_draft(F.col("_draft"), F.col("handle"), brand), F.col("_template"), F.col("handle"), brand
            ),
        )
    )
    answered = F.col("routing.decision") != "HANDOFF"
    open_rows = graded.select(
        "case_id",
        F.col("text").alias("customer_text"),
        F.col("handle").alias("customer_handle"),
        "intent",
        "confidence",
        F.col("target").alias("retrieval_intent"),
        "matches",
        "top_similarity",
        "confidence_zone",
        "routing.*",
        F.when(answered, F.col("_reply.reply")).alias("draft_reply"),
        (answered & F.col("_reply.failsafe_used")).alias("failsafe_used"),
    )
    blocked_rows = triaged.filter(blocked).select(
        "case_id",
        F.col("text").alias("customer_text"),
        F.col("handle").alias("customer_handle"),
        F.lit(OTHER).alias("intent"),
        F.lit(0.0).alias("confidence"),
        F.lit(OTHER).alias("retrieval_intent"),
        F.lit(None).cast(open_rows.schema["matches"].dataType).alias("matches"),
        F.lit(0.0).alias("top_similarity"),
        F.lit("SAFETY_BLOCKED").alias("confidence_zone"),
        F.lit("HANDOFF").alias("decision"),
        escalation_priority(F.col("safety.category")).alias("priority"),
        F.col("safety.rule_code").alias("rule_code"),
        F.col("safety.stated_reason").alias("stated_reason"),
        F.lit(None).cast("string").alias("draft_reply"),
        F.lit(False).alias("failsafe_used"),
    )
    return open_rows.unionByName(blocked_rows).withColumn(
        "character_count", F.coalesce(F.length("draft_reply"), F.lit(0))
    )


def prompt_table(
    searched: DataFrame, has_device: Column, has_version: Column, brand: Brand = BRAND
) -> DataFrame:
    """(case_id, system_instruction, prompt) for a bulk generation job.

    ``searched`` is (case_id, text, handle, intent, matches). The wording is the brand's.
    """
    matches = F.coalesce("matches", F.array().cast(searched.schema["matches"].dataType))
    lines = F.array_join(
        F.transform(
            F.slice(matches, 1, 3),
            lambda m, i: F.concat(
                (i + 1).cast("string"), F.lit(". Q: "), m["customer_query"], F.lit("\n   A: "), m["agent_reply"]
            ),
        ),
        "\n",
    )
    ask = F.when(has_device & has_version, brand.ask_nothing).otherwise(brand.ask_device)
    return searched.select(
        "case_id",
        F.concat(F.lit(brand.instruction), ask, F.lit("\nOpen with the handle "), F.col("handle"), F.lit(".")).alias(
            "system_instruction"
        ),
        F.concat(
            F.lit("Earlier answers, topic "), F.col("intent"), F.lit(":\n"), lines, F.lit("\n\nQuestion: "), F.col("text")
        ).alias("prompt"),
    )
