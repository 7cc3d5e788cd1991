"""DuckDB expressions equivalent to the column functions, built from the same rule data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from deskloom.catalog.base import quote
from deskloom.functions import rules as R
from deskloom.functions.text import HANDLE, PLACEHOLDERS, SPACE, SPACES, URL, WORD


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {quote(pattern)}, {quote(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(x: str) -> str:
    return f"trim({sub(x, SPACE + '+', ' ')})"


def clean_message(x: str) -> str:
    return squeeze(sub(sub(x, URL, ""), HANDLE, ""))


def sanitize_customer(x: str) -> str:
    return squeeze(sub(sub(x, HANDLE, ""), URL, ""))


def sanitize_reply(x: str) -> str:
    body = f"regexp_replace({strip(x)}, {quote('^' + HANDLE + SPACE + '*')}, '{{customer_handle}} ')"
    body = sub(body, rf"{R.BRAND_TAG}({NOT_WORD}|$)", r"\1")
    body = sub(body, HANDLE, "{customer_handle}")
    private = f"(contains(lower({body}), 'dm') OR contains(lower({body}), 'direct message'))"
    linked = (
        f"CASE WHEN {private} THEN {sub(body, URL, '{dm_link}')} ELSE {sub(body, URL, '{help_link}')} END"
    )
    return squeeze(linked)


def dedup_key(x: str) -> str:
    return squeeze(sub(sub(f"lower({x})", PLACEHOLDERS, ""), rf"[^\p{{L}}\p{{N}}_{SPACES}]", ""))


def fingerprint(x: str) -> str:
    return f"sha256({squeeze(f'lower({x})')})"


def contains_any(lowered: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({lowered}, {quote(w)})" for w in words) + ")"


NOT_WORD = WORD.replace("[", "[^", 1)


def re2(pattern: str, any_case: bool = True) -> str:
    """Pattern for RE2, whose word boundary is ASCII and which has no lookaround.

    Outer boundaries become consumed neighbours, so the words are group 1; a gap between
    two boundaries must start and end with a character that is not part of a word.
    """
    gap = rf"(?:[^\p{{L}}\p{{N}}_\n](?:.*?[^\p{{L}}\p{{N}}_\n])?)"
    body = pattern.replace(r"\b.*?\b", gap)
    if body.startswith(r"\b"):
        body = rf"(?:^|{NOT_WORD})" + body[2:]
    if body.endswith(r"\b"):
        body = body[:-2] + rf"(?:{NOT_WORD}|$)"
    body = body.replace(r"\s", SPACE).replace(r"\S", f"[^{SPACES}]").replace(r"\d", r"\p{Nd}")
    assert r"\b" not in body, body
    return ("(?i)" if any_case else "") + body


def matches(x: str, pattern: str, any_case: bool = True) -> str:
    return f"regexp_matches({x}, {quote(re2(pattern, any_case))})"


def any_match(x: str, patterns: Sequence[str]) -> str:
    return "(" + " OR ".join(matches(x, p) for p in patterns) + ")"


def placeholders(x: str, handle: str) -> str:
    return (
        f"replace(replace(replace({x}, '{{customer_handle}}', {handle}), "
        f"'{{dm_link}}', {quote(R.DM_LINK)}), '{{help_link}}', {quote(R.HELP_LINK)})"
    )


def fill_template(template: str, handle: str) -> str:
    filled = placeholders(template, handle)
    addressed = f"CASE WHEN starts_with({filled}, {handle}) THEN {filled} ELSE {handle} || ' ' || {filled} END"
    return (
        f"CASE WHEN length({addressed}) > 280 THEN substring({addressed}, 1, 277) || '...' "
        f"ELSE {addressed} END"
    )


def clean_draft(x: str, handle: str) -> str:
    bare = sub(strip(x), '^"+|"+$', "")
    return placeholders(strip(sub(bare, "^'+|'+$", "")), handle)


def safety_columns(x: str, verdict: str | None = None) -> str:
    """rule_code, category, keyword-bearing reason, is_hazard and cleared flag of ``x``."""
    body = strip(x)

    def word(p: str) -> str:
        return f"regexp_extract({body}, {quote(re2(p))}, 1)"

    def reason(before: str, p: str, after: str) -> str:
        return f"{quote(before + chr(39))} || {word(p)} || {quote(chr(39) + after)}"

    rules = [
        (f"{body} = ''", "SAFE_PASS", None, quote("Empty message."), False),
        (
            matches(body, R.LEGAL),
            "LEGAL_PR_RISK",
            "LEGAL_PR",
            reason(
                "Legal or press wording (",
                R.LEGAL,
                "): no public answer, the legal team takes over.",
            ),
            False,
        ),
        (
            matches(body, R.FRAUD),
            "SECURITY_FRAUD_RISK",
            "SECURITY_FRAUD",
            reason(
                "Possible fraud or stolen account (",
                R.FRAUD,
                "): no automatic answer, the fraud team takes over.",
            ),
            False,
        ),
        (
            matches(body, R.CHURN),
            "REPEAT_CONTACT_HIGH_FRUSTRATION",
            "REPEAT_CHURN",
            reason(
                "Repeated contact or threat to leave (",
                R.CHURN,
                "): the retention team takes over.",
            ),
            False,
        ),
        (
            any_match(body, R.NEGATIONS),
            "SAFE_SLANG_NEGATION_CLEARED",
            None,
            quote(
                "The danger is denied; handled as usual."
            ),
            True,
        ),
        (
            matches(body, R.HAZARD),
            "SAFETY_HAZARD_DETECTED",
            "SAFETY_HAZARD",
            reason(
                "Dangerous device behaviour (",
                R.HAZARD,
                "): no automatic answer, the device safety team takes over.",
            ),
            False,
        ),
        (
            f"{matches(body, R.AMBIGUOUS)} AND {any_match(body, R.SLANG)}",
            "SAFE_SLANG_NEGATION_CLEARED",
            None,
            reason(
                "The word ",
                R.AMBIGUOUS,
                " is used as slang; handled as usual.",
            ),
            True,
        ),
    ]
    if verdict is not None:
        rules.append(
            (
                f"{matches(body, R.AMBIGUOUS)} AND NOT contains(upper({verdict}), 'YES')",
                "SAFE_SEMANTIC_VERIFIED",
                None,
                reason("The verifier takes ", R.AMBIGUOUS, " for a figure of speech."),
                True,
            )
        )
    rules.append(
        (
            matches(body, R.AMBIGUOUS),
            "SAFETY_HAZARD_DETECTED",
            "SAFETY_HAZARD",
            reason(
                "Danger word ",
                R.AMBIGUOUS,
                " without any sign of slang: the device safety team takes over.",
            ),
            False,
        )
    )
    otherwise = ("SAFE_PASS", None, quote("No safety rule fired."), False)

    def case(values, last) -> str:
        whens = " ".join(f"WHEN {rule[0]} THEN {value}" for rule, value in zip(rules, values))
        return f"CASE {whens} ELSE {last} END"

    codes = case([quote(r[1]) for r in rules], quote(otherwise[0]))
    categories = case([quote(r[2]) if r[2] else "NULL" for r in rules], "NULL")
    reasons = case([r[3] for r in rules], otherwise[2])
    hazards = case(["true" if r[2] else "false" for r in rules], "false")
    cleared = case(["true" if r[4] else "false" for r in rules], "false")
    return (
        f"{hazards} AS is_hazard, {categories} AS category, {codes} AS rule_code, "
        f"{reasons} AS stated_reason, {cleared} AS is_slang_or_negation"
    )


def cue_hits(lowered: str, words: Sequence[str]) -> str:
    return "(" + " + ".join(f"contains({lowered}, {quote(w)})::INT" for w in words) + ")"


def cue_columns(
    relation: str, key: str, text: str, cues: Mapping[str, Sequence[str]], other: str = R.OTHER
) -> str:
    """SELECT of (key, intent, hits, confidence) over ``relation``."""
    parts = " UNION ALL ".join(
        f"SELECT {key} AS k, {rank} AS ord, {quote(intent)} AS intent, "
        f"{cue_hits('lt', words)} AS hits FROM lowered"
        for rank, (intent, words) in enumerate(cues.items())
    )
    return (
        f"(WITH lowered AS (SELECT {key}, lower({text}) AS lt FROM {relation}), "
        f"scored AS ({parts}), "
        "best AS (SELECT k, intent, hits, row_number() OVER (PARTITION BY k ORDER BY hits DESC, ord) AS rn "
        "FROM scored) "
        f"SELECT k AS {key}, CASE WHEN hits > 0 THEN intent ELSE {quote(other)} END AS intent, hits, "
        "CASE WHEN hits > 0 THEN round(least(0.95, 0.70 + hits * 0.10), 2) ELSE 0.40 END::DOUBLE AS confidence "
        "FROM best WHERE rn = 1)"
    )


def first_cue(x: str, cues: Mapping[str, Sequence[str]]) -> str:
    whens = " ".join(
        f"WHEN {contains_any(f'lower({x})', words)} THEN {quote(intent)}" for intent, words in cues.items()
    )
    return f"CASE {whens} END"


def at_handle(x: str) -> str:
    return f"CASE WHEN starts_with({x}, '@') THEN {x} ELSE '@' || {x} END"


def zone(score: str, high: float = 0.25, moderate: float = 0.12) -> str:
    return (
        f"CASE WHEN {score} >= {high} THEN 'HIGH_PREPARATION' WHEN {score} >= {moderate} "
        "THEN 'MODERATE_STYLE_ONLY' ELSE 'LOW_OUT_OF_DISTRIBUTION' END"
    )


def two(x: str) -> str:
    return f"printf('%.2f', {x})"


def route_columns(intent: str, conf: str, sim: str, zone_name: str) -> str:
    low = f"{intent} = 'UNKNOWN' AND {conf} < 0.5 AND {sim} < 0.12"
    auto = f"{conf} >= 0.8 AND {zone_name} = 'HIGH_PREPARATION'"

    def case(a: str, b: str, c: str) -> str:
        return f"CASE WHEN {low} THEN {a} WHEN {auto} THEN {b} ELSE {c} END"

    return ", ".join(
        [
            case("'HANDOFF'", "'AUTO_REPLY'", "'ASSISTED_REPLY'") + " AS decision",
            case("'NORMAL_P3'", "'NORMAL_P3'", "'PRIORITY_P2'") + " AS priority",
            case(
                "'LOW_CONFIDENCE_UNRELIABLE_TWIN'",
                "'RULE_AUTO_ROUTINE_TRIAGE'",
                "'RULE_ASSISTED_MODERATE_AMBIGUITY'",
            )
            + " AS rule_code",
            case(
                f"'No clear intent (confidence ' || {two(conf)} || ') and no close precedent (similarity ' || {two(sim)} || "
                "'): a person decides.'",
                f"'Clear intent ''' || {intent} || ''' (' || {two(conf)} || ') and a close precedent "
                f"(similarity ' || {two(sim)} || '): answered automatically.'",
                f"'Likely intent ''' || {intent} || ''' (' || {two(conf)} || '), precedent (' || {zone_name} || "
                f"', similarity ' || {two(sim)} || '): a draft to review.'",
            )
            + " AS stated_reason",
        ]
    )


def rubric_columns(customer: str, reply: str) -> dict[str, str]:
    """Expressions of the five dimensions; blank replies score 0."""
    said, asked = f"lower({reply})", f"lower({customer})"
    specified = f"({contains_any(asked, R.DEVICES)} AND {matches(asked, R.VERSION, False)})"
    device, version = contains_any(said, R.ASKS_DEVICE), contains_any(said, R.ASKS_VERSION)
    word, link = contains_any(said, R.DM_WORDS), contains_any(said, R.DM_LINKS)
    filler = contains_any(said, R.FILLER)
    blank = f"({reply} IS NULL OR {strip(reply)} = '')"
    size = f"length({reply})"
    columns = {
        "diagnostic_probe": f"CASE WHEN {specified} OR ({device} AND {version}) THEN 5.0 WHEN {device} OR {version} THEN 4.0 ELSE 1.0 END",
        "privacy_pivot": f"CASE WHEN {word} AND {link} THEN 5.0 WHEN {word} OR {link} THEN 4.0 ELSE 1.0 END",
        "zero_liability_shield": f"CASE WHEN {matches(reply, R.PROMISSORY['benchmark'])} THEN 1.0 ELSE 5.0 END",
        "brevity_constraint": f"CASE WHEN {size} <= 240 THEN 5.0 WHEN {size} <= 280 THEN 4.0 WHEN {size} <= 320 THEN 2.0 ELSE 1.0 END",
        "brand_persona": f"greatest(1.0, least(5.0, 3.0 + CASE WHEN starts_with({reply}, '@') THEN 1.0 ELSE 0.0 END + CASE WHEN {contains_any(said, R.EMPATHY)} AND NOT {filler} THEN 1.0 WHEN {filler} THEN -1.0 ELSE 0.0 END))",
    }
    return {k: f"(CASE WHEN {blank} THEN 0.0 ELSE {v} END)::DOUBLE" for k, v in columns.items()}


def judge_columns(customer: str, reply: str, intent: str) -> dict[str, str]:
    """Expressions of the rule-based judge."""
    said = f"lower({reply})"
    clean = f"(NOT {matches(reply, R.PROMISSORY['judge'])})"
    link = matches(reply, R.LINK)
    probed = f"({contains_any(f'lower({customer})', R.DEVICES)} OR {contains_any(said, R.ASKS_DIAGNOSTIC)})"
    private = contains_any(said, ("dm", "direct message"))
    misplaced = (
        f"(contains({said}, 'sorry to hear') AND contains({said}, 'device details') AND {intent} = 'BILLING_DISPUTE')"
    )
    return {
        "diagnostic_probe": f"CASE WHEN {probed} THEN 5 ELSE 1 END",
        "privacy_pivot": f"CASE WHEN {private} AND {link} THEN 5 WHEN {private} THEN 3 ELSE 1 END",
        "zero_liability": f"CASE WHEN {clean} THEN 5 ELSE 1 END",
        "overall_score": (
            f"CASE WHEN NOT {clean} THEN 1 WHEN length({reply}) > 280 THEN 2 WHEN {misplaced} THEN 2 "
            f"WHEN {probed} AND {private} THEN CASE WHEN {link} AND length({reply}) <= 240 THEN 5 ELSE 4 END ELSE 3 END"
        ),
        "char_length": f"length({reply})",
        "length_compliant": f"length({reply}) <= 280",
        "has_dm_link": link,
        "zero_liability_compliant": clean,
    }


def select_columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{expression} AS {name}" for name, expression in columns.items())
