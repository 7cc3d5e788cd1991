"""Rule expectations: safety, routing, replies, payloads, probabilities."""

import math

import pytest
from pyspark.sql import functions as F

from deskloom.functions import payloads as P
from deskloom.functions import probabilities as PR
from deskloom.functions import replies as RP
from deskloom.functions import routing as RT
from deskloom.functions import rules as R
from deskloom.functions import text as X
from deskloom.functions.intents import classify_by_cues, first_cue_intent, label_id
from deskloom.functions.safety import assess_safety

HAZARD, CLEARED, PASS = "SAFETY_HAZARD_DETECTED", "SAFE_SLANG_NEGATION_CLEARED", "SAFE_PASS"

# Example sentences with a given outcome; the rules are anchored by them.
SAFETY = [
    ("My phone charger started smoking and sparking!", HAZARD),
    ("The battery swelled up and the screen shattered!", HAZARD),
    ("This new iOS update is straight fire!", CLEARED),
    ("The camera on this iPhone is the bomb", CLEARED),
    ("I was afraid it would start smoking, but thankfully there's no smoke.", CLEARED),
    ("My phone died with no sparks or smoke, just shut off.", CLEARED),
    ("You charged me unauthorized and I am filing a lawsuit with my lawyer.", "LEGAL_PR_RISK"),
    ("Someone hacked my apple id and changed my security questions.", "SECURITY_FRAUD_RISK"),
    ("there is a fire in my kitchen from the charger", HAZARD),
    ("My charger sparked!", PASS),
    ("3rd time calling, no smoke", "REPEAT_CONTACT_HIGH_FRUSTRATION"),
    ("worried it would melt\nbut it did not", PASS),
    ("  \t ", PASS),
    ("no burn marks", CLEARED),
]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,code", SAFETY)
def test_safety(spark, text, code):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(assess_safety(F.col("text"))["rule_code"]).first()[0] == code


def test_verifier_decides_ambiguous_words(spark):
    rows = [("a fire", "NO"), ("a fire", "Yes."), ("a fire", None), ("it is smoking", "NO")]
    df = spark.createDataFrame(rows, "text string, answer string")
    got = [r[0] for r in df.select(assess_safety(F.col("text"), F.col("answer"))["rule_code"]).collect()]
    assert got == ["SAFE_SEMANTIC_VERIFIED", HAZARD, HAZARD, HAZARD]


def test_colloquial_intents(spark):
    expected = [
        ("battery dies within two hours of charging", "BATTERY_DRAIN"),
        ("it is in a boot loop after a restart", "DEVICE_BOOT"),
        ("icloud passcode is locked", "ACCOUNT_ACCESS"),
        ("an unauthorized subscription from itunes", "BILLING_DISPUTE"),
        ("software update stops: update failed", "UPDATE_FAILURE"),
        ("store hours in the city?", "UNKNOWN"),
        ("charge", "BATTERY_DRAIN"),  # a tie: the earlier list entry
        ("nothing to see", "UNKNOWN"),
    ]
    df = spark.createDataFrame(expected, "text string, want string")
    rows = df.select("want", classify_by_cues(F.col("text")).alias("s")).collect()
    assert [r.s.intent for r in rows] == [r.want for r in rows]
    assert rows[-1].s.confidence == 0.40 and rows[-2].s.confidence == 0.8


def test_first_cue_and_label_ids(spark):
    assert one(spark, first_cue_intent(F.lit("Password of my battery"))) == "ACCOUNT_ACCESS"
    assert one(spark, first_cue_intent(F.lit("zzz"))) is None
    assert one(spark, label_id(F.lit(" device_boot "), R.TAXONOMY)) == 3
    assert one(spark, label_id(F.lit("?"), R.TAXONOMY)) == 4


@pytest.mark.parametrize(
    "intent,conf,sim,decision",
    [
        ("UNKNOWN", 0.4, 0.11, "HANDOFF"),
        ("UNKNOWN", 0.4, 0.12, "ASSISTED_REPLY"),
        ("BATTERY_DRAIN", 0.8, 0.25, "AUTO_REPLY"),
        ("BATTERY_DRAIN", 0.79, 0.9, "ASSISTED_REPLY"),
        ("BATTERY_DRAIN", 0.3, 0.0, "ASSISTED_REPLY"),
    ],
)
def test_routing(spark, intent, conf, sim, decision):
    zone = RT.zone(F.lit(sim))
    assert one(spark, RT.route(F.lit(intent), F.lit(conf), F.lit(sim), zone)["decision"]) == decision


def test_text_functions(spark):
    assert one(spark, X.clean_message(F.lit("@a hi  https://x.y/z @élan\tthere you "))) == "hi there you"
    # The order matters: handle first leaves the colon-slash tail, link first leaves nothing.
    assert one(spark, X.sanitize_customer(F.lit("@https://a.b"))) == "://a.b"
    assert one(spark, X.clean_message(F.lit("@https://a.b"))) == "@"
    reply = one(spark, X.sanitize_reply(F.lit("@bob Hi @115858 @amy, DM us https://t.co/x")))
    assert reply == "{customer_handle} Hi {customer_handle}, DM us {dm_link}"
    assert one(spark, X.sanitize_reply(F.lit("see https://t.co/x"))) == "see {help_link}"
    assert one(spark, X.fingerprint(F.lit(" A  b\n"))) == one(spark, X.fingerprint(F.lit("a B")))
    assert one(spark, X.dedup_key(F.lit("{dm_link} It's  OK!"))) == "its ok"


def test_template_keeps_dollar_signs_and_length(spark):
    filled = one(spark, X.fill_template(F.lit("{dm_link} costs $1 \\2 " + "x" * 400), F.lit("@u")))
    assert filled.startswith("@u https://") and "$1 \\2" in filled
    assert len(filled) == 280 and filled.endswith("...")


def test_timestamps(spark):
    stamp = X.parse_created_at(F.lit("Tue Oct 31 22:10:47 +0000 2017")).cast("string")
    assert one(spark, stamp) == "2017-10-31 22:10:47"
    assert one(spark, X.parse_created_at(F.lit("yesterday"))) is None
    assert one(spark, X.parse_created_at(F.lit(""), F.current_timestamp())) is not None


def test_context_prompt(spark):
    turns = F.expr(
        "array(named_struct('author_id','a','text','one'), named_struct('author_id','b','text','two'))"
    )
    assert one(spark, X.context_prompt(turns, F.lit("two"))).startswith(
        "Said before:\n- a: one\n\nMessage to label"
    )
    assert one(spark, X.context_prompt(F.slice(turns, 1, 1), F.lit("x"))).startswith("Message to label")


@pytest.mark.parametrize(
    "draft,failsafe",
    [
        (None, True),
        ("@u we will refund you", True),
        ("hello", True),
        ("@u " + "x" * 280, True),
        ("@u DM us", False),
    ],
)
def test_guarded_draft(spark, draft, failsafe):
    got = one(spark, RP.guard_draft(F.lit(draft).cast("string"), F.lit("{customer_handle} hi"), F.lit("@u")))
    assert got.failsafe_used is failsafe
    assert got.reply == ("@u hi" if failsafe else draft)


def test_rubric_extremes(spark):
    assert one(spark, RP.rubric(F.lit("x"), F.lit("  "))).overall == 0.0
    good = one(
        spark,
        RP.rubric(F.lit("help"), F.lit("@u We'd like to help. Which model and iOS version? DM us https://t.co/x")),
    )
    assert good.overall == 5.0
    bad = one(spark, RP.rubric(F.lit("help"), F.lit("we are truly sorry, free repair")))
    assert (bad.zero_liability_shield, bad.brand_persona) == (1.0, 2.0)


def test_calibration_order(spark):
    raw = F.lit('{"overall_score": 1, "diagnostic_probe": 1, "privacy_pivot": 1}')
    # A canned reply is capped, but the last rule lifts a reply that also asks and links.
    reply = F.lit("sorry to hear you are having trouble, device details? which model https://t.co/x")
    got = one(spark, P.calibrate_judgement(raw, F.lit("hm"), reply, F.lit("BILLING_DISPUTE")))
    assert (got.overall_score, got.diagnostic_probe, got.privacy_pivot) == (5, 4, 4)
    fallback = one(spark, P.calibrate_judgement(F.lit("oops"), F.lit("hm"), reply, F.lit("X")))
    assert fallback.overall_score == one(spark, RP.judge_by_rules(F.lit("hm"), reply, F.lit("X"))).overall_score


def test_payload_shapes(spark):
    high = one(spark, P.recover_payload(F.lit('{"primary_intent": "x", "confidence": 0.9}')))
    assert (high.primary_intent, high.confidence) == ("UNKNOWN", 0.35)
    over = one(spark, P.recover_payload(F.lit('{"primary_intent": "UNKNOWN", "confidence": 7, "urgency": "low"}')))
    assert (over.confidence, over.urgency) == (1.0, "LOW")
    none = one(spark, P.recover_payload(F.lit("not json")))
    assert (none.primary_intent, none.confidence, none.reasoning) == ("UNKNOWN", 0.85, "")
    risky = one(spark, P.escalate_high_risk(F.lit("my lawyer"), P.recover_payload(F.lit("{}"))))
    assert risky.requested_action == "SAFETY_ESCALATION"


def test_probabilities(spark):
    detail = one(spark, PR.prediction_detail(PR.uniform(6), R.TAXONOMY))
    assert math.isclose(detail.entropy, math.log2(6), abs_tol=1e-4)
    assert detail.ambiguous and detail.intent == "UPDATE_FAILURE"
    sure = F.array(*[F.lit(p) for p in (0.95, 0.01, 0.01, 0.01, 0.01, 0.01)])
    detail = one(spark, PR.prediction_detail(sure, R.TAXONOMY))
    assert detail.intent == "ACCOUNT_ACCESS" and not detail.ambiguous
    assert math.isclose(sum(detail.probabilities.values()), 1.0, abs_tol=1e-3)


def test_stop_words_are_sparks_own(spark):
    listed = spark._jvm.org.apache.spark.ml.feature.StopWordsRemover.loadDefaultStopWords("english")
    assert set(R.STOP_WORDS) == {w for w in listed if "'" not in w}
