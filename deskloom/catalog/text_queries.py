"""Text functions over whole documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskloom.catalog import sqltext as S
from deskloom.catalog.base import (
    REPLIES_SQL,
    REPLY_PHRASES,
    REQUESTS_SQL,
    TURNS_SQL,
    pick,
    query,
    quote,
    replies,
    requests,
    sql_pick,
    table, texts,
    turns,
)
from deskloom.functions import payloads as P
from deskloom.functions import replies as RP
from deskloom.functions import rules as R
from deskloom.functions import text as X
from deskloom.operators.sampling import batches, numbered_prompts
from deskloom.operators.threads import context_lines
from deskloom.plans.classify import request_batches, validate_requests
from deskloom.plans.expand import batch_labels


@query(
    "clean_text",
    f"WITH {REQUESTS_SQL} SELECT request_id, {S.clean_message('text')} AS clean_text FROM requests",
)
def clean_text(spark, sf):
    return requests(spark, sf).select("request_id", X.clean_message(F.col("text")).alias("clean_text"))


@query(
    "sanitize_customer",
    f"WITH {TURNS_SQL} SELECT conv_id, turn, {S.sanitize_customer('text')} AS customer_query "
    "FROM turns WHERE role <> 'assistant'",
)
def sanitize_customer(spark, sf):
    return (
        turns(spark, sf)
        .filter(F.col("role") != "assistant")
        .select("conv_id", "turn", X.sanitize_customer(F.col("text")).alias("customer_query"))
    )


@query(
    "sanitize_reply",
    f"WITH {TURNS_SQL} SELECT conv_id, turn, {S.sanitize_reply('text')} AS agent_reply "
    "FROM turns WHERE role = 'assistant'",
)
def sanitize_reply(spark, sf):
    return (
        turns(spark, sf)
        .filter(F.col("role") == "assistant")
        .select("conv_id", "turn", X.sanitize_reply(F.col("text")).alias("agent_reply"))
    )


@query(
    "dedup_key",
    f"WITH {REQUESTS_SQL} SELECT request_id, {S.dedup_key('text')} AS dedup_key FROM requests",
)
def dedup_key(spark, sf):
    return requests(spark, sf).select("request_id", X.dedup_key(F.col("text")).alias("dedup_key"))


@query(
    "text_fingerprint",
    f"SELECT doc_id, {S.fingerprint('text')} AS text_key FROM documents",
)
def text_fingerprint(spark, sf):
    return texts(spark, sf, "documents").select(
        "doc_id", X.fingerprint(F.col("text")).alias("text_key")
    )


@query(
    "case_fingerprint",
    "SELECT page_id, page_id || '_' || substring(sha256(html), 1, 16) AS case_key FROM pages",
)
def case_fingerprint(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", X.case_key(F.col("page_id"), F.col("html")).alias("case_key")
    )


@query(
    "parse_ts",
    """WITH raw AS (
      SELECT event_id, CASE event_id % 7 WHEN 3 THEN '' WHEN 5 THEN 'not a time'
             ELSE strftime(ts, '%a %b %d %H:%M:%S +0000 %Y') END AS created_at FROM events)
    SELECT event_id, try_strptime(created_at, '%a %b %d %H:%M:%S +0000 %Y') AS created FROM raw""",
)
def parse_ts(spark, sf):
    shaped = F.date_format(F.col("ts").cast("timestamp"), "EEE MMM dd HH:mm:ss Z yyyy")
    raw = (
        F.when(F.col("event_id") % 7 == 3, "")
        .when(F.col("event_id") % 7 == 5, "not a time")
        .otherwise(shaped)
    )
    return (
        table(spark, sf, "events")
        .select("event_id", raw.alias("created_at"))
        .select("event_id", X.parse_created_at(F.col("created_at")).cast("timestamp_ntz").alias("created"))
    )


_HANDLES = ("@user", "user_7", "@someone_else", "grüße")


@query(
    "fill_template",
    f"""WITH {TURNS_SQL}, t AS (
      SELECT conv_id, turn, {S.sanitize_reply('text')} AS template,
             {S.at_handle(sql_pick(_HANDLES, 'conv_id + turn'))} AS handle
      FROM turns WHERE role = 'assistant')
    SELECT conv_id, turn, {S.fill_template('template', 'handle')} AS reply FROM t""",
)
def fill_template(spark, sf):
    return (
        turns(spark, sf)
        .filter(F.col("role") == "assistant")
        .select(
            "conv_id",
            "turn",
            X.sanitize_reply(F.col("text")).alias("template"),
            X.at_handle(pick(_HANDLES, F.col("conv_id") + F.col("turn"))).alias("handle"),
        )
        .select("conv_id", "turn", X.fill_template(F.col("template"), F.col("handle")).alias("reply"))
    )


_RAW_DRAFT_SQL = (
    "CASE request_id % 5 WHEN 0 THEN NULL "
    "WHEN 1 THEN ' \"@user ' || {p} || '\" ' WHEN 2 THEN '''{{customer_handle}} DM us: {{dm_link}}''' "
    "WHEN 3 THEN '@user ' || text ELSE {p} || chr(9) END"
)


def _raw_draft():
    phrase = pick(REPLY_PHRASES, F.col("request_id"))
    part = F.col("request_id") % 5
    return (
        F.when(part == 0, F.lit(None).cast("string"))
        .when(part == 1, F.concat(F.lit(' "@user '), phrase, F.lit('" ')))
        .when(part == 2, F.lit("'{customer_handle} DM us: {dm_link}'"))
        .when(part == 3, F.concat(F.lit("@user "), F.col("text")))
        .otherwise(F.concat(phrase, F.lit("\t")))
    )


_DRAFTS_SQL = (
    f"{REQUESTS_SQL}, drafts AS (SELECT request_id, text, "
    + _RAW_DRAFT_SQL.format(p=sql_pick(REPLY_PHRASES, "request_id"))
    + " AS raw FROM requests)"
)


@query(
    "draft_cleanup",
    f"WITH {_DRAFTS_SQL} SELECT request_id, {S.clean_draft('raw', quote('@user'))} AS draft FROM drafts",
)
def draft_cleanup(spark, sf):
    return (
        requests(spark, sf)
        .withColumn("raw", _raw_draft())
        .select("request_id", X.clean_draft(F.col("raw"), F.lit("@user")).alias("draft"))
    )


@query(
    "guarded_draft",
    f"""WITH {_DRAFTS_SQL}, c AS (
      SELECT request_id, {S.clean_draft('raw', quote('@user'))} AS draft FROM drafts),
    b AS (SELECT *, (draft IS NULL OR length(draft) > 280
                 OR {S.matches('draft', R.PROMISSORY['engine'])}
                 OR NOT starts_with(draft, '@user')) AS failsafe_used FROM c)
    SELECT request_id, failsafe_used,
           CASE WHEN failsafe_used THEN {S.fill_template(quote(R.SAFE_TRIAGE), quote('@user'))}
                ELSE draft END AS reply FROM b""",
)
def guarded_draft(spark, sf):
    user = F.lit("@user")
    return (
        requests(spark, sf)
        .withColumn("draft", X.clean_draft(_raw_draft(), user))
        .withColumn("g", RP.guard_draft(F.col("draft"), F.lit(R.SAFE_TRIAGE), user))
        .select("request_id", "g.reply", "g.failsafe_used")
    )


@query(
    "turn_context",
    f"""WITH {TURNS_SQL}, last AS (SELECT conv_id, max(turn) AS last_turn FROM turns GROUP BY conv_id)
    SELECT conv_id, turn, '- ' || role || ': ' || text AS line
    FROM turns JOIN last USING (conv_id) WHERE turn < last_turn""",
)
def turn_context(spark, sf):
    return context_lines(turns(spark, sf))


@query(
    "prompt_batches",
    f"""WITH n AS (
      SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn
      FROM documents),
    b AS (SELECT *, (rn - 1) // 10 AS batch, (rn - 1) % 10 + 1 AS item FROM n)
    SELECT lang, batch, count(*) AS items,
           string_agg(item || '. "' || text || '"', chr(10) ORDER BY item) AS prompt
    FROM b GROUP BY lang, batch""",
)
def prompt_batches(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "doc_id", "text")
    return numbered_prompts(batches(docs, "doc_id", 10, ["lang"]), "text", ["lang"])


_RESPONSE_KINDS = 9


def _response(id_col: str):
    """Raw model answers of many shapes, derived from the row id."""
    n = F.col(id_col)
    intents = F.array(*[F.lit(v) for v in (*R.PAYLOAD_INTENTS, "battery_drain ", "NONSENSE")])
    intent = F.element_at(intents, (n % 10 + 1).cast("int"))
    conf = F.format_string("%.2f", (n % 120) / F.lit(100.0))
    plain = F.concat(
        F.lit('{"primary_intent": "'), intent, F.lit('", "urgency": "High", "confidence": '),
        conf, F.lit(', "reasoning": "because '), n.cast("string"), F.lit('"}'),
    )
    kind = n % _RESPONSE_KINDS
    return (
        F.when(kind == 0, plain)
        .when(kind == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Sure! Here it is: "), plain, F.lit(" Hope it helps.")))
        .when(kind == 3, F.lit("no json at all"))
        .when(kind == 4, F.lit('{"primary_intent": broken'))
        .when(kind == 5, F.concat(F.lit('{"primary_intent": "'), intent, F.lit('"}')))
        .when(kind == 6, F.lit('{"urgency": "low", "confidence": 0.5}'))
        .when(
            kind == 7,
            F.concat(
                F.lit('{"primary_intent": "'), intent, F.lit('", "reasoning": "'),
                F.repeat(F.lit("x"), 501), F.lit('"}'),
            ),
        )
        .otherwise(F.lit("{}"))
    )


def _response_sql(id_col: str) -> str:
    names = "[" + ", ".join(quote(v) for v in (*R.PAYLOAD_INTENTS, "battery_drain ", "NONSENSE")) + "]"
    intent = f"({names})[CAST({id_col} % 10 + 1 AS INTEGER)]"
    plain = (
        f"'{{\"primary_intent\": \"' || {intent} || '\", \"urgency\": \"High\", \"confidence\": ' || "
        f"printf('%.2f', ({id_col} % 120) / 100.0::DOUBLE) || ', \"reasoning\": \"because ' || {id_col} || '\"}}'"
    )
    return (
        f"CASE {id_col} % {_RESPONSE_KINDS} WHEN 0 THEN {plain} "
        f"WHEN 1 THEN '```json' || chr(10) || {plain} || chr(10) || '```' "
        f"WHEN 2 THEN 'Sure! Here it is: ' || {plain} || ' Hope it helps.' "
        "WHEN 3 THEN 'no json at all' WHEN 4 THEN '{\"primary_intent\": broken' "
        f"WHEN 5 THEN '{{\"primary_intent\": \"' || {intent} || '\"}}' "
        "WHEN 6 THEN '{\"urgency\": \"low\", \"confidence\": 0.5}' "
        f"WHEN 7 THEN '{{\"primary_intent\": \"' || {intent} || '\", \"reasoning\": \"' || repeat('x', 501) || '\"}}' "
        "ELSE '{}' END"
    )


_JSON_SQL = f"""raw AS (SELECT doc_id, {_response_sql('doc_id')} AS response FROM documents),
obj AS (SELECT doc_id, regexp_extract(response, '(?s)\\{{.*\\}}', 0) AS body FROM raw),
ok AS (SELECT doc_id, CASE WHEN body <> '' AND json_valid(body) THEN body END AS body FROM obj)"""


@query(
    "json_extract",
    f"""WITH {_JSON_SQL}
    SELECT doc_id, body IS NOT NULL AS parsed, body ->> 'primary_intent' AS primary_intent,
           body ->> 'urgency' AS urgency, TRY_CAST(body ->> 'confidence' AS DOUBLE) AS confidence
    FROM ok""",
)
def json_extract(spark, sf):
    fields = P.json_fields(_response("doc_id"), P.PAYLOAD_FIELDS)
    return (
        texts(spark, sf, "documents")
        .select("doc_id", fields.alias("p"))
        .select(
            "doc_id",
            F.col("p").isNotNull().alias("parsed"),
            "p.primary_intent",
            "p.urgency",
            F.col("p.confidence").try_cast("double").alias("confidence"),
        )
    )


@query(
    "payload_recover",
    f"""WITH {_JSON_SQL},
    f AS (SELECT doc_id, coalesce(upper({S.strip("(body ->> 'primary_intent')")}), 'UNKNOWN') AS named,
                 TRY_CAST(body ->> 'confidence' AS DOUBLE) AS given, body ->> 'urgency' AS urgency,
                 body ->> 'reasoning' AS reasoning FROM ok),
    g AS (SELECT *, named IN ({', '.join(quote(v) for v in R.PAYLOAD_INTENTS)}) AS known FROM f),
    h AS (SELECT *, CASE WHEN known THEN given ELSE least(coalesce(given, 0.35), 0.35) END AS stated FROM g),
    v AS (SELECT *, coalesce(stated, 0.85) BETWEEN 0 AND 1 AND length(coalesce(reasoning, '')) <= 500 AS valid
          FROM h)
    SELECT doc_id, CASE WHEN known THEN named ELSE 'UNKNOWN' END AS primary_intent,
           CASE WHEN valid THEN coalesce(urgency, 'LOW') ELSE upper(coalesce(urgency, 'LOW')) END AS urgency,
           (CASE WHEN valid THEN coalesce(stated, 0.85)
                ELSE greatest(0.0, least(1.0, coalesce(stated, 0.40))) END)::DOUBLE AS confidence,
           CASE WHEN valid THEN coalesce(reasoning, '')
                ELSE coalesce(reasoning, 'taken from an invalid answer') END AS reasoning,
           'INQUIRY' AS requested_action, 'INFORMATIONAL' AS issue_state FROM v""",
)
def payload_recover(spark, sf):
    return (
        texts(spark, sf, "documents")
        .select("doc_id", P.recover_payload(_response("doc_id")).alias("p"))
        .select("doc_id", "p.*")
    )


@query(
    "high_risk_override",
    f"""WITH {REQUESTS_SQL}, r AS (
      SELECT request_id, {S.matches('lower(text)', R.high_risk_pattern(), False)} AS risky FROM requests)
    SELECT request_id, CASE WHEN risky THEN 'SAFETY_ESCALATION' ELSE 'INQUIRY' END AS requested_action,
           CASE WHEN risky THEN 'BLOCKED' ELSE 'INFORMATIONAL' END AS issue_state,
           CASE WHEN risky THEN 'HIGH' ELSE 'LOW' END AS urgency,
           (CASE WHEN risky THEN 0.99 ELSE 0.85 END)::DOUBLE AS confidence FROM r""",
)
def high_risk_override(spark, sf):
    payload = P.recover_payload(F.lit("{}"))
    return (
        requests(spark, sf)
        .select("request_id", P.escalate_high_risk(F.col("text"), payload).alias("p"))
        .select("request_id", "p.requested_action", "p.issue_state", "p.urgency", "p.confidence")
    )


_PROPOSALS = ("battery_drain", "DEVICE_BOOT", "other", "Update_Failure", "unknown")
_CONFIDENCES = ("0.5", "1.7", "-0.2", "abc", "NaN", "0.25", "1")


@query(
    "coerce_labels",
    f"""WITH p AS (SELECT event_id, {sql_pick(_PROPOSALS, 'event_id')} AS label,
                         {sql_pick(_CONFIDENCES, 'event_id')} AS conf FROM events)
    SELECT event_id,
           CASE WHEN upper(label) IN ({', '.join(quote(v) for v in R.TAXONOMY)}) THEN upper(label)
                ELSE 'UNKNOWN' END AS intent,
           greatest(0.0, least(1.0, CASE WHEN isnan(TRY_CAST(conf AS DOUBLE)) THEN 1.0
                ELSE coalesce(TRY_CAST(conf AS DOUBLE), 1.0) END))::DOUBLE AS confidence FROM p""",
)
def coerce_labels(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        P.coerce_label(pick(_PROPOSALS, F.col("event_id"))).alias("intent"),
        P.coerce_confidence(pick(_CONFIDENCES, F.col("event_id"))).alias("confidence"),
    )


@query(
    "batch_labels",
    f"""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents),
    b AS (SELECT doc_id, pos // 10 AS batch, pos % 10 + 1 AS item FROM n)
    SELECT doc_id, CASE WHEN batch % 4 >= 2 THEN 'DISCARD' WHEN item = 1 THEN 'BATTERY_DRAIN'
           WHEN item = 2 THEN 'UPDATE_FAILURE' ELSE 'DISCARD' END AS verified FROM b""",
)
def batch_label_answers(spark, sf):
    docs = batches(table(spark, sf, "documents").select("doc_id"), "doc_id", 10)
    # One answer per batch; of four one is not JSON and one has an id that is no number.
    good = (
        '[{"id": 1, "intent": "battery_drain "}, {"id": "2", "intent": "UNKNOWN"}, '
        '{"id": 2, "intent": "Update_Failure"}, {"id": 3, "intent": "NOPE"}, {"id": 11, "intent": "UNKNOWN"}'
    )
    part = F.col("batch") % 4
    answer = (
        F.when(part == 3, "sorry, cannot do that")
        .when(part == 2, good + ', {"id": "x", "intent": "UNKNOWN"}]')
        .otherwise(good + "]")
    )
    answers = docs.select("batch").distinct().withColumn("response", answer)
    return batch_labels(docs, answers, ["batch"]).select("doc_id", "verified")


@query(
    "canned_reply",
    f"""WITH {TURNS_SQL} SELECT conv_id, turn, {S.at_handle('author_id')} || ' ' || {quote(R.CANNED_REPLY)} AS reply
    FROM turns""",
)
def canned_reply(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", RP.canned_reply(F.col("author_id")).alias("reply"))


_KEYWORD_SQL = " ".join(
    f"WHEN {S.contains_any('lower(text)', words)} THEN {quote(reply)}" for words, reply in R.KEYWORD_REPLIES
)


@query(
    "keyword_reply",
    f"""WITH {REQUESTS_SQL} SELECT request_id,
    '@user ' || CASE {_KEYWORD_SQL} ELSE {quote(R.KEYWORD_REPLY_ELSE)} END AS reply FROM requests""",
)
def keyword_reply(spark, sf):
    return requests(spark, sf).select(
        "request_id", RP.keyword_reply(F.col("text"), F.lit("user")).alias("reply")
    )


@query(
    "pair_quality",
    f"""WITH {REPLIES_SQL}, c AS (
      SELECT case_id, {S.sanitize_customer('customer_text')} AS q, {S.sanitize_reply('agent_text')} AS a FROM replies)
    SELECT case_id, length(q) AS query_chars, length(a) AS reply_chars FROM c
    WHERE length(q) >= 15 AND length(a) >= 20
      AND (contains(a, '{{') OR {S.contains_any('lower(a)', R.PAIR_KEYWORDS)})""",
)
def pair_quality(spark, sf):
    from deskloom.plans.vault import pair_is_useful

    clean = replies(spark, sf).select(
        "case_id",
        X.sanitize_customer(F.col("customer_text")).alias("q"),
        X.sanitize_reply(F.col("agent_text")).alias("a"),
    )
    return clean.filter(pair_is_useful(F.col("q"), F.col("a"))).select(
        "case_id", F.length("q").alias("query_chars"), F.length("a").alias("reply_chars")
    )


@query(
    "validate_split",
    f"""WITH {REQUESTS_SQL}, v AS (
      SELECT request_id, CASE WHEN length(text) < 2 THEN 'too_short' WHEN length(text) > 500 THEN 'too_long' END AS reason,
             row_number() OVER (ORDER BY request_id) AS rn FROM requests)
    SELECT request_id, reason, reason IS NULL AS valid, (rn - 1) // 256 AS batch, (rn - 1) % 256 + 1 AS item FROM v""",
)
def validate_split(spark, sf):
    checked = validate_requests(requests(spark, sf)).select("request_id", "reason", "valid")
    return request_batches(checked, "request_id")


@query(
    "promissory_flags",
    f"""WITH {TURNS_SQL} SELECT conv_id, turn, """
    + ", ".join(f"{S.matches('text', p)} AS by_{name}" for name, p in R.PROMISSORY.items())
    + " FROM turns WHERE role = 'assistant'",
)
def promissory_flags(spark, sf):
    return (
        turns(spark, sf)
        .filter(F.col("role") == "assistant")
        .select(
            "conv_id",
            "turn",
            *[RP.makes_promise(F.col("text"), name).alias(f"by_{name}") for name in R.PROMISSORY],
        )
    )


@query(
    "entity_flags",
    f"""WITH {REQUESTS_SQL} SELECT request_id,
      {S.contains_any('lower(text)', R.DRAFT_DEVICES)} AS draft_device,
      {S.contains_any('lower(text)', R.DEVICES)} AS device,
      {S.matches('lower(text)', R.VERSION, False)} AS version,
      {S.matches('text', R.JUDGE_ASKS_VERSION)} AS judge_version,
      {S.matches('text', R.JUDGE_ASKS_MODEL)} AS judge_model,
      {S.matches('text', R.LINK)} AS link FROM requests""",
)
def entity_flags(spark, sf):
    text = F.col("text")
    return requests(spark, sf).select(
        "request_id",
        RP.names_device(text, R.DRAFT_DEVICES).alias("draft_device"),
        RP.names_device(text).alias("device"),
        RP.names_version(text).alias("version"),
        RP.asks_version(text).alias("judge_version"),
        RP.asks_model(text).alias("judge_model"),
        RP.has_link(text).alias("link"),
    )
