"""Model-written JSON: tolerant extraction, recovery, coercion, judge calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskloom.functions import replies, rules as R
from deskloom.functions.text import contains_any, strip


def json_object(raw: Column) -> Column:
    """The outermost ``{...}`` in a response that may hold fences or prose; NULL if none."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when(body != "", body)


def is_json_object(text: Column) -> Column:
    """True if the text parses as a JSON object."""
    return F.coalesce(F.json_object_keys(text).isNotNull(), F.lit(False))


def json_fields(raw: Column, names: Sequence[str]) -> Column:
    """Struct of the named fields as strings; NULL if the response holds no JSON object."""
    body = json_object(raw)
    fields = F.from_json(body, ", ".join(f"{name} string" for name in names))
    return F.when(is_json_object(body), fields)


def _number(text: Column) -> Column:
    return text.try_cast("double")


def coerce_label(label: Column, labels: Sequence[str] = R.TAXONOMY, other: str = R.OTHER) -> Column:
    """Label upper-cased; anything outside the taxonomy becomes ``other``."""
    upper = F.upper(label)
    return F.when(upper.isin(*labels), upper).otherwise(other)


def coerce_confidence(value: Column) -> Column:
    """Confidence as a number in [0, 1]; unreadable or absent counts as 1."""
    number = _number(value)
    number = F.when(F.isnan(number), F.lit(1.0)).otherwise(number)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(1.0))))


PAYLOAD_FIELDS = (
    "primary_intent",
    "requested_action",
    "issue_state",
    "urgency",
    "confidence",
    "reasoning",
)


def recover_payload(raw: Column, labels: Sequence[str] = R.PAYLOAD_INTENTS) -> Column:
    """Strict intent payload from a raw response, repaired where it breaks the schema.

    An unknown intent becomes UNKNOWN with confidence at most 0.35. If confidence leaves
    [0, 1] or the reasoning exceeds 500 characters, the whole payload takes the fallback
    shape: upper-cased fields and clamped confidence.
    """

    def build(p: Column) -> Column:
        named = F.coalesce(F.upper(strip(p["primary_intent"])), F.lit(R.OTHER))
        known = named.isin(*labels)
        given = _number(p["confidence"])
        stated = F.when(known, given).otherwise(
            F.least(F.coalesce(given, F.lit(0.35)), F.lit(0.35))
        )
        confidence = F.coalesce(stated, F.lit(0.85))
        reasoning = F.coalesce(p["reasoning"], F.lit(""))
        valid = (
            (confidence >= 0.0)
            & (confidence <= 1.0)
            & (F.length(reasoning) <= 500)
            & (p["confidence"].isNull() | given.isNotNull())
        )

        def text(name: str, default: str) -> Column:
            value = F.coalesce(p[name], F.lit(default))
            return F.when(valid, value).otherwise(F.upper(value)).alias(name)

        clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(stated, F.lit(0.40))))
        recovered = F.coalesce(p["reasoning"], F.lit("taken from an invalid answer"))
        return F.struct(
            F.when(known, named).otherwise(R.OTHER).alias("primary_intent"),
            text("requested_action", "INQUIRY"),
            text("issue_state", "INFORMATIONAL"),
            text("urgency", "LOW"),
            F.when(valid, confidence).otherwise(clamped).alias("confidence"),
            F.when(valid, reasoning).otherwise(recovered).alias("reasoning"),
        )

    nothing = F.struct(
        *[F.lit(None).cast("string").alias(name) for name in PAYLOAD_FIELDS]
    )
    fields = F.coalesce(json_fields(raw, PAYLOAD_FIELDS), nothing)
    return F.transform(F.array(fields), build)[0]


def escalate_high_risk(text: Column, payload: Column, pattern: str | None = None) -> Column:
    """The payload, replaced by a fixed escalation where a high-risk term occurs."""
    pattern = R.same_case(pattern or R.high_risk_pattern())
    fixed = F.struct(
        F.lit("UNKNOWN").alias("primary_intent"),
        F.lit("SAFETY_ESCALATION").alias("requested_action"),
        F.lit("BLOCKED").alias("issue_state"),
        F.lit("HIGH").alias("urgency"),
        F.lit(0.99).alias("confidence"),
        F.lit(
            "A high-risk term: a person must answer."
        ).alias("reasoning"),
    )
    return F.when(F.rlike(F.lower(text), F.lit(pattern)), fixed).otherwise(payload)


def batch_label_items(raw: Column) -> Column:
    """Array of (id, intent) from a JSON array answer; NULL if it does not parse."""
    return F.from_json(raw, "array<struct<id: string, intent: string>>")


JUDGE_FIELDS = (
    "diagnostic_probe",
    "privacy_pivot",
    "zero_liability",
    "overall_score",
    "rationale",
)


def calibrate_judgement(
    raw: Column, customer: Column, reply: Column, intent: Column
) -> Column:
    """Judge scores from a raw response, corrected by verified facts.

    The corrections run in order, later ones override earlier ones. A response without
    usable scores is replaced by the rule-based judgement.
    """
    facts = replies.hard_checks(reply)
    clean, link = facts["zero_liability_compliant"], facts["has_dm_link"]
    said, asked = F.lower(reply), F.lower(customer)
    canned = F.contains(said, F.lit("sorry to hear you are having trouble")) & F.contains(
        said, F.lit("device details")
    )
    touchy = intent.isin("BILLING_DISPUTE", "ACCOUNT_ACCESS") | contains_any(
        asked, ("love", "smoke")
    )
    asks = (
        replies.asks_version(reply)
        | replies.asks_model(reply)
        | contains_any(said, ("reportaproblem", "iforgot"))
    )

    def score(value: Column) -> Column:
        number = F.coalesce(_number(value), F.lit(3.0))
        return F.greatest(F.lit(1.0), F.least(F.lit(5.0), number)).cast("int")

    def build(p: Column) -> Column:
        clean, link, excellent = p["zero_liability_compliant"], p["has_dm_link"], p["excellent"]
        overall = F.when(clean, score(p["overall_score"])).otherwise(1)
        overall = F.when(~link, F.least(overall, F.lit(3))).otherwise(overall)
        overall = (
            F.when(p["canned"] & p["touchy"], F.least(overall, F.lit(2)))
            .when(p["canned"], F.least(overall, F.lit(3)))
            .otherwise(overall)
        )
        brief = p["char_length"] <= R.LIMITS.ideal_chars
        overall = F.when(excellent & brief, 5).when(excellent, 4).otherwise(overall)
        diagnostic, privacy = score(p["diagnostic_probe"]), score(p["privacy_pivot"])
        said_why = strip(F.coalesce(p["rationale"], F.lit("")))
        why = F.when(
            ~clean,
            F.concat(
                F.lit("Makes a promise. "),
                said_why,
            ),
        ).otherwise(said_why)
        praise = F.lit(
            "Asks what is needed, links the private channel, promises nothing."
        )
        return F.struct(
            F.when(excellent, F.greatest(diagnostic, F.lit(4)))
            .otherwise(diagnostic)
            .alias("diagnostic_probe"),
            F.when(link, F.greatest(privacy, F.lit(4)))
            .otherwise(F.least(privacy, F.lit(3)))
            .alias("privacy_pivot"),
            F.when(clean, 5).otherwise(1).alias("zero_liability"),
            overall.alias("overall_score"),
            F.when(excellent & (why == ""), praise).otherwise(why).alias("rationale"),
            *[p[name].alias(name) for name in facts],
        )

    fields = json_fields(raw, JUDGE_FIELDS)
    usable = fields.isNotNull()
    for name in JUDGE_FIELDS[:4]:
        usable = usable & (fields[name].isNull() | _number(fields[name]).isNotNull())
    # Scores and facts are bound once; the corrections then refer to them by name.
    bound = F.struct(
        *[fields[name].alias(name) for name in JUDGE_FIELDS],
        *[column.alias(name) for name, column in facts.items()],
        (link & clean & asks).alias("excellent"),
        canned.alias("canned"),
        touchy.alias("touchy"),
    )
    judged = F.transform(F.array(bound), build)[0]
    return F.when(usable, judged).otherwise(replies.judge_by_rules(customer, reply, intent))
