"""Safety, intents, routing, rubric, judge and probability vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskloom.catalog import sqltext as S
from deskloom.catalog.base import (
    LANGUAGE_CUES,
    REPLIES_SQL,
    REQUESTS_SQL,
    pick,
    query,
    replies,
    requests,
    sql_list,
    sql_pick,
    table,
)
from deskloom.functions import intents as I
from deskloom.functions import payloads as P
from deskloom.functions import probabilities as PR
from deskloom.functions import replies as RP
from deskloom.functions import routing as RT
from deskloom.functions import rules as R
from deskloom.functions.safety import assess_safety

_VERDICTS = ("YES", "No.", "yes, it is", "NO")


def _assessed(spark, sf):
    verdict = F.when(
        F.col("request_id") % 3 != 0, pick(_VERDICTS, F.col("request_id"))
    )
    return requests(spark, sf).select(
        "request_id", assess_safety(F.col("text"), verdict).alias("s")
    ).select("request_id", "s.*")


_SAFETY_SQL = f"""{REQUESTS_SQL}, v AS (
  SELECT request_id, text, CASE WHEN request_id % 3 <> 0 THEN {sql_pick(_VERDICTS, 'request_id')} END AS verdict
  FROM requests),
assessed AS (SELECT request_id, {S.safety_columns('text', 'verdict')} FROM v)"""


@query("safety_cascade", f"WITH {_SAFETY_SQL} SELECT * FROM assessed")
def safety_cascade(spark, sf):
    return _assessed(spark, sf)


@query(
    "safety_counts",
    f"WITH {_SAFETY_SQL} SELECT rule_code, count(*) AS n, count(*) FILTER (is_hazard) AS hazards "
    "FROM assessed GROUP BY rule_code",
)
def safety_counts(spark, sf):
    return _assessed(spark, sf).groupBy("rule_code").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_hazard").alias("hazards")
    )


@query(
    "cue_classify",
    f"""WITH {REQUESTS_SQL},
    support AS {S.cue_columns('requests', 'request_id', 'text', R.CUES)},
    language AS {S.cue_columns('requests', 'request_id', 'text', LANGUAGE_CUES, 'none')}
    SELECT s.request_id, s.intent, s.hits, s.confidence, l.intent AS language, l.hits AS language_hits
    FROM support s JOIN language l USING (request_id)""",
)
def cue_classify(spark, sf):
    text = F.col("text")
    return (
        requests(spark, sf)
        .select(
            "request_id",
            I.classify_by_cues(text).alias("s"),
            I.classify_by_cues(text, LANGUAGE_CUES, "none").alias("l"),
        )
        .select(
            "request_id",
            "s.intent",
            "s.hits",
            "s.confidence",
            F.col("l.intent").alias("language"),
            F.col("l.hits").alias("language_hits"),
        )
    )


@query(
    "cue_first_match",
    f"WITH {REQUESTS_SQL} SELECT request_id, {S.first_cue('text', R.CUES)} AS intent FROM requests",
)
def cue_first_match(spark, sf):
    return requests(spark, sf).select("request_id", I.first_cue_intent(F.col("text")).alias("intent"))


_ROUTE_INPUT = (
    "SELECT event_id, "
    + sql_pick(R.TAXONOMY, "event_id")
    + " AS intent, ((event_id % 20) / 20.0)::DOUBLE AS confidence, round((value % 0.5), 4)::DOUBLE AS similarity FROM events"
)


def _route_input(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        pick(R.TAXONOMY, F.col("event_id")).alias("intent"),
        ((F.col("event_id") % 20) / F.lit(20.0)).alias("confidence"),
        F.round(F.col("value") % 0.5, 4).alias("similarity"),
    )


@query(
    "retrieval_zone",
    f"""WITH i AS ({_ROUTE_INPUT}) SELECT event_id, {S.zone('similarity')} AS lexical_zone,
    {S.zone('similarity * 2', 0.75, 0.55)} AS dense_zone FROM i""",
)
def retrieval_zone(spark, sf):
    return _route_input(spark, sf).select(
        "event_id",
        RT.zone(F.col("similarity")).alias("lexical_zone"),
        RT.zone(F.col("similarity") * 2, R.DENSE_ZONES).alias("dense_zone"),
    )


@query(
    "routing",
    f"""WITH i AS ({_ROUTE_INPUT}), z AS (SELECT *, {S.zone('similarity')} AS zone FROM i)
    SELECT event_id, {S.route_columns('intent', 'confidence', 'similarity', 'zone')} FROM z""",
)
def routing(spark, sf):
    zone = RT.zone(F.col("similarity"))
    routed = RT.route(F.col("intent"), F.col("confidence"), F.col("similarity"), F.col("zone"))
    return (
        _route_input(spark, sf)
        .withColumn("zone", zone)
        .select("event_id", routed.alias("r"))
        .select("event_id", "r.*")
    )


_RUBRIC = S.rubric_columns("customer_text", "agent_text")


@query(
    "reply_rubric",
    f"""WITH {REPLIES_SQL}, s AS (SELECT case_id, {S.select_columns(_RUBRIC)} FROM replies)
    SELECT *, round(({' + '.join(_RUBRIC)}) / 5.0, 2) AS overall FROM s""",
)
def reply_rubric(spark, sf):
    marks = RP.rubric(F.col("customer_text"), F.col("agent_text"))
    return replies(spark, sf).select("case_id", marks.alias("m")).select("case_id", "m.*")


_CASES_SQL = f"""{REPLIES_SQL},
cued AS {S.cue_columns('replies', 'case_id', 'customer_text', R.CUES)},
cases AS (SELECT r.*, c.intent FROM replies r JOIN cued c USING (case_id))"""


def _cases(spark, sf):
    return replies(spark, sf).withColumn(
        "intent", I.classify_by_cues(F.col("customer_text"))["intent"]
    )


_JUDGE = S.judge_columns("customer_text", "agent_text", "intent")
_JUDGED = [
    "diagnostic_probe", "privacy_pivot", "zero_liability", "overall_score", "char_length",
    "length_compliant", "has_dm_link", "zero_liability_compliant",
]


@query(
    "judge_heuristic",
    f"WITH {_CASES_SQL} SELECT case_id, {S.select_columns(_JUDGE)} FROM cases",
)
def judge_heuristic(spark, sf):
    judged = RP.judge_by_rules(F.col("customer_text"), F.col("agent_text"), F.col("intent"))
    return _cases(spark, sf).select("case_id", judged.alias("j")).select(
        "case_id", *[f"j.{c}" for c in _JUDGED]
    )


_RAW_JUDGE_SQL = (
    "CASE case_id % 5 WHEN 0 THEN 'judge is offline' "
    "WHEN 1 THEN '```json' || chr(10) || '{\"overall_score\": 9, \"privacy_pivot\": 0, \"rationale\": \" fine \"}' || chr(10) || '```' "
    "WHEN 2 THEN '{\"overall_score\": 4, \"diagnostic_probe\": 2, \"privacy_pivot\": 5, \"zero_liability\": 2, \"rationale\": \"\"}' "
    "WHEN 3 THEN 'Score: {\"overall_score\": 2, \"diagnostic_probe\": 5, \"privacy_pivot\": 2}' "
    "ELSE '{\"diagnostic_probe\": 1}' END"
)


def _raw_judge():
    part = F.col("case_id") % 5
    return (
        F.when(part == 0, "judge is offline")
        .when(part == 1, '```json\n{"overall_score": 9, "privacy_pivot": 0, "rationale": " fine "}\n```')
        .when(
            part == 2,
            '{"overall_score": 4, "diagnostic_probe": 2, "privacy_pivot": 5, "zero_liability": 2, "rationale": ""}',
        )
        .when(part == 3, 'Score: {"overall_score": 2, "diagnostic_probe": 5, "privacy_pivot": 2}')
        .otherwise('{"diagnostic_probe": 1}')
    )


def _score_sql(name: str) -> str:
    return f"greatest(1, least(5, coalesce(TRY_CAST(body ->> '{name}' AS DOUBLE), 3)))::INT"


_CANNED_SQL = (
    "contains(lower(agent_text), 'sorry to hear you are having trouble') AND contains(lower(agent_text), 'device details')"
)
_TOUCHY_SQL = (
    "(intent IN ('BILLING_DISPUTE', 'ACCOUNT_ACCESS') OR contains(lower(customer_text), 'love') "
    "OR contains(lower(customer_text), 'smoke'))"
)


@query(
    "judge_calibrate",
    f"""WITH {_CASES_SQL},
    raw AS (SELECT *, regexp_extract({_RAW_JUDGE_SQL}, '(?s)\\{{.*\\}}', 0) AS body0 FROM cases),
    p AS (SELECT *, CASE WHEN body0 <> '' AND json_valid(body0) THEN body0 END AS body,
            {S.matches('agent_text', R.LINK)} AS link,
            NOT {S.matches('agent_text', R.PROMISSORY['judge'])} AS clean,
            ({_CANNED_SQL}) AS canned, {_TOUCHY_SQL} AS touchy,
            ({S.matches('agent_text', R.JUDGE_ASKS_VERSION)} OR {S.matches('agent_text', R.JUDGE_ASKS_MODEL)}
             OR contains(lower(agent_text), 'reportaproblem') OR contains(lower(agent_text), 'iforgot')) AS asks
          FROM raw),
    s0 AS (SELECT *, link AND clean AND asks AS excellent,
             {_score_sql('overall_score')} AS o, {_score_sql('diagnostic_probe')} AS d,
             {_score_sql('privacy_pivot')} AS pv FROM p),
    s1 AS (SELECT *, CASE WHEN clean THEN o ELSE 1 END AS o1 FROM s0),
    s2 AS (SELECT *, CASE WHEN NOT link THEN least(o1, 3) ELSE o1 END AS o2 FROM s1),
    s3 AS (SELECT *, CASE WHEN canned AND touchy THEN least(o2, 2) WHEN canned THEN least(o2, 3) ELSE o2 END AS o3 FROM s2),
    s4 AS (SELECT *, CASE WHEN excellent AND length(agent_text) <= 240 THEN 5 WHEN excellent THEN 4 ELSE o3 END AS o4 FROM s3)
    SELECT case_id,
      CASE WHEN body IS NULL THEN {_JUDGE['overall_score']} ELSE o4 END AS overall_score,
      CASE WHEN body IS NULL THEN {_JUDGE['diagnostic_probe']} WHEN excellent THEN greatest(d, 4) ELSE d END AS diagnostic_probe,
      CASE WHEN body IS NULL THEN {_JUDGE['privacy_pivot']} WHEN link THEN greatest(pv, 4) ELSE least(pv, 3) END AS privacy_pivot,
      CASE WHEN clean THEN 5 ELSE 1 END AS zero_liability,
      link AS has_dm_link FROM s4""",
)
def judge_calibrate(spark, sf):
    judged = P.calibrate_judgement(
        _raw_judge(), F.col("customer_text"), F.col("agent_text"), F.col("intent")
    )
    return _cases(spark, sf).select("case_id", judged.alias("j")).select(
        "case_id",
        "j.overall_score",
        "j.diagnostic_probe",
        "j.privacy_pivot",
        "j.zero_liability",
        "j.has_dm_link",
    )


# Probability vectors: softmax of six components of each embedding.
_PROBS_SQL = """v AS (SELECT vec_id, list_transform(embedding[1:6], lambda x: exp(x::DOUBLE * 8)) AS e FROM embeddings),
probs AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM v)"""


def _probs(spark, sf):
    exp = F.transform(F.slice("embedding", 1, 6), lambda x: F.exp(x.cast("double") * 8))
    raw = table(spark, sf, "embeddings").select("vec_id", exp.alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return raw.select("vec_id", "e", total.alias("t")).select(
        "vec_id", F.transform("e", lambda x: x / F.col("t")).alias("p")
    )


@query(
    "entropy",
    f"""WITH {_PROBS_SQL} SELECT vec_id, round(list_sum(list_transform(p,
      lambda x: -greatest(1e-12, least(1.0, x)) * log2(greatest(1e-12, least(1.0, x))))), 4) AS entropy FROM probs""",
)
def entropy(spark, sf):
    return _probs(spark, sf).select("vec_id", PR.entropy(F.col("p")).alias("entropy"))


_RANKED_SQL = f"""{_PROBS_SQL},
long AS (SELECT vec_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM probs),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i DESC) AS rn FROM long),
top AS (SELECT a.vec_id, a.i AS i1, a.p AS p1, b.i AS i2, b.p AS p2 FROM r a JOIN r b USING (vec_id)
        WHERE a.rn = 1 AND b.rn = 2)"""


@query(
    "top2_margin",
    f"""WITH {_RANKED_SQL}, names AS (SELECT {sql_list(R.TAXONOMY)} AS n)
    SELECT vec_id, n[i1] AS intent, round(p1, 4) AS confidence, n[i2] AS second,
           round(p2, 4) AS second_probability, round(p1 - p2, 4) AS margin,
           round((SELECT p FROM long l WHERE l.vec_id = top.vec_id AND l.i = 1), 4) AS first_class
    FROM top, names""",
)
def top2_margin(spark, sf):
    detail = PR.prediction_detail(F.col("p"), R.TAXONOMY)
    return _probs(spark, sf).select("vec_id", detail.alias("d")).select(
        "vec_id",
        "d.intent",
        "d.confidence",
        F.col("d.top2")[1]["intent"].alias("second"),
        F.col("d.top2")[1]["probability"].alias("second_probability"),
        F.round("d.margin", 4).alias("margin"),
        F.col("d.probabilities")[R.TAXONOMY[0]].alias("first_class"),
    )


@query(
    "ambiguity_flags",
    f"WITH {_RANKED_SQL} SELECT vec_id, (p1 - p2 < 0.15 OR p1 < 0.60) AS ambiguous FROM top",
)
def ambiguity_flags(spark, sf):
    detail = PR.prediction_detail(F.col("p"), R.TAXONOMY)
    return _probs(spark, sf).select("vec_id", detail["ambiguous"].alias("ambiguous"))


@query(
    "confidence_triage",
    f"""WITH {_RANKED_SQL} SELECT vec_id, CASE WHEN p1 >= 0.8 THEN 'ACCEPT' WHEN p1 >= 0.6 THEN 'QUEUE'
    ELSE 'DROP' END AS tier FROM top""",
)
def confidence_triage(spark, sf):
    return _probs(spark, sf).select("vec_id", PR.triage(F.array_max("p")).alias("tier"))


@query(
    "label_map",
    f"""WITH l AS (SELECT event_id, {sql_pick((' battery_drain', 'UNKNOWN', 'nope', 'device_boot '), 'event_id')} AS name,
                         CAST(event_id % 8 AS INTEGER) AS id FROM events)
    SELECT event_id, coalesce(list_position({sql_list(R.TAXONOMY)}, upper(trim(name))) - 1, 4)::INT AS label,
           coalesce(({sql_list(R.TAXONOMY)})[id + 1], 'UNKNOWN') AS intent FROM l""",
)
def label_map(spark, sf):
    name = pick((" battery_drain", "UNKNOWN", "nope", "device_boot "), F.col("event_id"))
    return table(spark, sf, "events").select(
        "event_id",
        I.label_id(name, R.TAXONOMY).alias("label"),
        I.label_name(F.col("event_id") % 8, R.TAXONOMY).alias("intent"),
    )
