"""Reply checks and scores: promises, links, device mentions, rubric, judge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskloom.functions import rules as R
from deskloom.functions.text import at_handle, contains_any, fill_template, strip


def makes_promise(reply: Column, rule_set: str = "engine") -> Column:
    """Forbidden promise in the reply, by one of the named phrase sets."""
    return F.rlike(reply, F.lit(R.any_case(R.PROMISSORY[rule_set])))


def has_link(reply: Column) -> Column:
    return F.rlike(reply, F.lit(R.any_case(R.LINK)))


def names_version(text: Column) -> Column:
    return F.rlike(F.lower(text), F.lit(R.same_case(R.VERSION)))


def names_device(text: Column, words: tuple[str, ...] = R.DEVICES) -> Column:
    return contains_any(F.lower(text), words)


def asks_version(reply: Column) -> Column:
    return F.rlike(reply, F.lit(R.any_case(R.JUDGE_ASKS_VERSION)))


def asks_model(reply: Column) -> Column:
    return F.rlike(reply, F.lit(R.any_case(R.JUDGE_ASKS_MODEL)))


def canned_reply(handle: Column) -> Column:
    """The same polite sentence for everyone."""
    return F.concat_ws(" ", at_handle(handle), F.lit(R.CANNED_REPLY))


def keyword_reply(text: Column, handle: Column) -> Column:
    """Reply picked by the first keyword group found in the text."""
    lowered = F.lower(text)
    (words, reply), *others = R.KEYWORD_REPLIES
    body = F.when(contains_any(lowered, words), reply)
    for words, reply in others:
        body = body.when(contains_any(lowered, words), reply)
    return F.concat_ws(" ", at_handle(handle), body.otherwise(R.KEYWORD_REPLY_ELSE))


def guard_draft(
    draft: Column, template: Column, handle: Column, brand: R.Brand = R.BRAND
) -> Column:
    """Struct (reply, failsafe_used): the draft if it obeys the rules, else the template.

    A NULL draft stands for a generator that failed.
    """
    broken = (
        draft.isNull()
        | (F.length(draft) > R.LIMITS.reply_chars)
        | makes_promise(draft, "engine")
        | ~draft.startswith(handle)
    )
    return F.struct(
        F.when(broken, fill_template(template, handle, brand)).otherwise(draft).alias("reply"),
        broken.alias("failsafe_used"),
    )


def _scaled(*levels: tuple[Column, float], otherwise: float) -> Column:
    (condition, value), *rest = levels
    column = F.when(condition, F.lit(value))
    for condition, value in rest:
        column = column.when(condition, F.lit(value))
    return column.otherwise(F.lit(otherwise))


DIMENSIONS = (
    "diagnostic_probe",
    "privacy_pivot",
    "zero_liability_shield",
    "brevity_constraint",
    "brand_persona",
    "overall",
)


def rubric(customer: Column, reply: Column) -> Column:
    """Struct of five brand dimensions (1-5) and their mean; an empty reply scores 0."""
    said, asked = F.lower(reply), F.lower(customer)
    specified = contains_any(asked, R.DEVICES) & F.rlike(asked, F.lit(R.same_case(R.VERSION)))
    device, version = contains_any(said, R.ASKS_DEVICE), contains_any(said, R.ASKS_VERSION)
    word, link = contains_any(said, R.DM_WORDS), contains_any(said, R.DM_LINKS)
    size = F.length(reply)
    filler = contains_any(said, R.FILLER)
    warmth = F.when(contains_any(said, R.EMPATHY) & ~filler, 1.0).when(filler, -1.0).otherwise(0.0)
    persona = F.lit(3.0) + F.when(reply.startswith("@"), 1.0).otherwise(0.0) + warmth

    scores = {
        "diagnostic_probe": _scaled(
            (specified | (device & version), 5.0), (device | version, 4.0), otherwise=1.0
        ),
        "privacy_pivot": _scaled((word & link, 5.0), (word | link, 4.0), otherwise=1.0),
        "zero_liability_shield": _scaled(
            (makes_promise(reply, "benchmark"), 1.0), otherwise=5.0
        ),
        "brevity_constraint": _scaled(
            (size <= 240, 5.0), (size <= 280, 4.0), (size <= 320, 2.0), otherwise=1.0
        ),
        "brand_persona": F.greatest(F.lit(1.0), F.least(F.lit(5.0), persona)),
    }
    blank = reply.isNull() | (strip(reply) == "")
    columns = {k: F.when(blank, F.lit(0.0)).otherwise(v) for k, v in scores.items()}
    total = F.lit(0.0)
    for column in columns.values():
        total = total + column
    return F.struct(
        *[column.alias(name) for name, column in columns.items()],
        F.round(total / 5.0, 2).alias("overall"),
    )


def full_marks() -> Column:
    """Rubric of a blocked case: suppressing the reply was right on every dimension."""
    return F.struct(*[F.lit(5.0).alias(name) for name in DIMENSIONS])


def hard_checks(reply: Column) -> dict[str, Column]:
    """Facts about a reply no judge may contradict."""
    return {
        "char_length": F.length(reply),
        "length_compliant": F.length(reply) <= R.LIMITS.reply_chars,
        "has_dm_link": has_link(reply),
        "zero_liability_compliant": ~makes_promise(reply, "judge"),
    }


def judge_by_rules(customer: Column, reply: Column, intent: Column) -> Column:
    """Deterministic judge: struct of four scores, rationale and hard checks."""
    said = F.lower(reply)
    facts = hard_checks(reply)
    clean, short, link = (
        facts["zero_liability_compliant"],
        facts["length_compliant"],
        facts["has_dm_link"],
    )
    probed = contains_any(F.lower(customer), R.DEVICES) | contains_any(said, R.ASKS_DIAGNOSTIC)
    private = contains_any(said, ("dm", "direct message"))
    misplaced = (
        F.contains(said, F.lit("sorry to hear"))
        & F.contains(said, F.lit("device details"))
        & (intent == "BILLING_DISPUTE")
    )
    verdict = (
        F.when(
            ~clean,
            _verdict(1, "Promises something that nobody may promise."),
        )
        .when(~short, _verdict(2, "Longer than a post may be."))
        .when(
            misplaced,
            _verdict(
                2,
                "Asks for the device in a question about money.",
            ),
        )
        .when(
            probed & private,
            _verdict(
                F.when(link & (facts["char_length"] <= R.LIMITS.ideal_chars), 5).otherwise(4),
                "Asks what is needed and moves to a private channel.",
            ),
        )
        .otherwise(_verdict(3, "Asks too little or stays in public."))
    )
    return F.struct(
        F.when(probed, 5).otherwise(1).alias("diagnostic_probe"),
        F.when(private & link, 5).when(private, 3).otherwise(1).alias("privacy_pivot"),
        F.when(clean, 5).otherwise(1).alias("zero_liability"),
        verdict["overall"].alias("overall_score"),
        verdict["rationale"].alias("rationale"),
        *[column.alias(name) for name, column in facts.items()],
    )


def judge_prompt(customer: Column, reply: Column, intent: Column, brand: R.Brand = R.BRAND) -> Column:
    """Question put to an external judge about one reply."""
    return F.concat(
        F.lit(brand.judge_instruction + "\nTopic: "),
        intent,
        F.lit("\nQuestion: "),
        customer,
        F.lit("\nAnswer: "),
        reply,
    )


def _verdict(overall: int | Column, rationale: str) -> Column:
    score = overall if isinstance(overall, Column) else F.lit(overall)
    return F.struct(score.alias("overall"), F.lit(rationale).alias("rationale"))
