"""Confidence zones and the three-tier routing decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskloom.functions.rules import OTHER, SAFE_TRIAGE, Zones

LEXICAL = Zones()


def zone(similarity: Column, zones: Zones = LEXICAL) -> Column:
    """Confidence zone of the best precedent; ``similarity`` is rounded to 4 digits."""
    return (
        F.when(similarity >= zones.high, "HIGH_PREPARATION")
        .when(similarity >= zones.moderate, "MODERATE_STYLE_ONLY")
        .otherwise("LOW_OUT_OF_DISTRIBUTION")
    )


def best_template(zone_name: Column, reply: Column, fallback: str = SAFE_TRIAGE) -> Column:
    """Reply of the best precedent, or the universal triage text in the low zone."""
    return F.when(
        zone_name.isin("HIGH_PREPARATION", "MODERATE_STYLE_ONLY") & reply.isNotNull(), reply
    ).otherwise(fallback)


def _two(number: Column) -> Column:
    return F.format_string("%.2f", number)


def route(intent: Column, confidence: Column, similarity: Column, zone_name: Column) -> Column:
    """Struct (decision, priority, rule_code, stated_reason)."""

    def decide(decision: str, priority: str, code: str, *reason: Column | str) -> Column:
        parts = [F.lit(p) if isinstance(p, str) else p for p in reason]
        return F.struct(
            F.lit(decision).alias("decision"),
            F.lit(priority).alias("priority"),
            F.lit(code).alias("rule_code"),
            F.concat(*parts).alias("stated_reason"),
        )

    return (
        F.when(
            (intent == OTHER) & (confidence < 0.50) & (similarity < 0.12),
            decide(
                "HANDOFF",
                "NORMAL_P3",
                "LOW_CONFIDENCE_UNRELIABLE_TWIN",
                "No clear intent (confidence ",
                _two(confidence),
                ") and no close precedent (similarity ",
                _two(similarity),
                "): a person decides.",
            ),
        )
        .when(
            (confidence >= 0.80) & (zone_name == "HIGH_PREPARATION"),
            decide(
                "AUTO_REPLY",
                "NORMAL_P3",
                "RULE_AUTO_ROUTINE_TRIAGE",
                "Clear intent '",
                intent,
                "' (",
                _two(confidence),
                ") and a close precedent (similarity ",
                _two(similarity),
                "): answered automatically.",
            ),
        )
        .otherwise(
            decide(
                "ASSISTED_REPLY",
                "PRIORITY_P2",
                "RULE_ASSISTED_MODERATE_AMBIGUITY",
                "Likely intent '",
                intent,
                "' (",
                _two(confidence),
                "), precedent (",
                zone_name,
                ", similarity ",
                _two(similarity),
                "): a draft to review.",
            )
        )
    )
