"""Prompts for external models, an external scorer on Arrow batches, and result tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from deskloom.catalog import sqltext as S
from deskloom.catalog.base import REPLIES_SQL, REQUESTS_SQL, TURNS_SQL, pick, query, quote, replies, requests, sql_pick, table, turns
from deskloom.functions import rules as R
from deskloom.functions.replies import judge_prompt
from deskloom.functions.safety import assess_safety, verifier_prompt
from deskloom.functions.text import context_prompt
from deskloom.operators.learners import batch_scorer, blank_to_other
from deskloom.plans.classify import score_new
from deskloom.session import scratch_path
from deskloom.sources.readers import read_table
from deskloom.sources.writers import write_result


@query(
    "context_prompts",
    f"""WITH {TURNS_SQL}, last AS (SELECT conv_id, max(turn) AS last_turn FROM turns GROUP BY conv_id),
    before AS (SELECT conv_id, string_agg('- ' || author_id || ': ' || text, chr(10) ORDER BY turn) AS said
               FROM turns JOIN last USING (conv_id) WHERE turn < last_turn GROUP BY conv_id)
    SELECT t.conv_id, coalesce('Said before:' || chr(10) || said || chr(10) || chr(10), '') || 'Message to label:' || chr(10) ||
           text || chr(10) || chr(10) || 'Answer with one JSON object.' AS prompt
    FROM turns t JOIN last l ON t.conv_id = l.conv_id AND t.turn = last_turn LEFT JOIN before b ON t.conv_id = b.conv_id""",
)
def context_prompts(spark, sf):
    """One prompt per conversation: a prompt is one value, so its turns meet in one row."""
    said = F.array_sort(F.collect_list(F.struct("turn", "author_id", "text")))
    grouped = turns(spark, sf).groupBy("conv_id").agg(said.alias("said"))
    prompt = context_prompt(F.col("said"), F.element_at("said", -1)["text"])
    return grouped.select("conv_id", prompt.alias("prompt"))


@query(
    "judge_prompts",
    f"""WITH {REPLIES_SQL} SELECT case_id, {quote(R.BRAND.judge_instruction)} || chr(10) || 'Topic: ' || {sql_pick(R.TAXONOMY, 'conv_id')}
    || chr(10) || 'Question: ' || customer_text || chr(10) || 'Answer: ' || agent_text AS prompt FROM replies""",
)
def judge_prompts(spark, sf):
    intent = pick(R.TAXONOMY, F.col("conv_id"))
    return replies(spark, sf).select(
        "case_id", judge_prompt(F.col("customer_text"), F.col("agent_text"), intent).alias("prompt")
    )


@query(
    "verifier_prompts",
    f"""WITH {REQUESTS_SQL}, s AS (SELECT request_id, {S.strip('text')} AS body, {S.safety_columns('text')} FROM requests)
    SELECT request_id, 'Message: ' || body || chr(10) || 'Does ''' || regexp_extract(body, {quote(S.re2(R.AMBIGUOUS))}, 1) ||
           ''' mean real physical danger here? Say YES or NO.' AS prompt
    FROM s WHERE stated_reason LIKE 'Danger word %'""",
)
def verifier_prompts(spark, sf):
    """Questions about the messages whose danger word nothing else explains."""
    asked = requests(spark, sf).withColumn("safety", assess_safety(F.col("text")))
    return asked.filter(F.col("safety.stated_reason").startswith("Danger word ")).select(
        "request_id", verifier_prompt(F.col("text")).alias("prompt")
    )


def _load_keyword_scorer():
    """Stands for loading a model: once per worker."""

    def classify(texts: list[str]) -> pd.DataFrame:
        battery = ["battery" in t.lower() for t in texts]
        return pd.DataFrame(
            {
                "intent": ["BATTERY_DRAIN" if b else "UNKNOWN" for b in battery],
                "confidence": [0.95 if b else 0.4 for b in battery],
            }
        )

    return classify


@query(
    "batch_scorer",
    f"""WITH {TURNS_SQL}, t AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 3 THEN ' ' WHEN turn % 7 = 5 THEN NULL ELSE text END AS text FROM turns)
    SELECT conv_id, turn, CASE WHEN contains(lower(text), 'battery') THEN 'BATTERY_DRAIN' ELSE 'UNKNOWN' END AS intent,
           (CASE WHEN text IS NULL OR text = ' ' THEN 0.0 WHEN contains(lower(text), 'battery') THEN 0.95 ELSE 0.4 END)::DOUBLE AS confidence
    FROM t""",
)
def batch_scorer_rows(spark, sf):
    """An external classifier on Arrow batches; blank texts take the fallback."""
    part = F.col("turn") % 7
    text = F.when(part == 3, " ").when(part == 5, F.lit(None)).otherwise(F.col("text"))
    said = turns(spark, sf).select("conv_id", "turn", text.alias("text"))
    scored = said.withColumn("guess", batch_scorer(_load_keyword_scorer)(F.col("text")))
    answer = blank_to_other(F.col("text"), F.col("guess.intent"), F.col("guess.confidence"))
    return scored.select("conv_id", "turn", answer.alias("a")).select("conv_id", "turn", "a.*")


@query(
    "uniform_prior",
    f"""WITH {REQUESTS_SQL}, k AS (SELECT DISTINCT {S.fingerprint('text')} AS text_key FROM requests)
    SELECT text_key, round(1 / 6.0::DOUBLE, 4) AS confidence, round(log2(6.0::DOUBLE), 4) AS entropy, true AS ambiguous FROM k""",
)
def uniform_prior(spark, sf):
    """Without a model every label is as likely, and every answer ambiguous."""
    return score_new(requests(spark, sf).select("request_id", "text"), None).select(
        "text_key", "detail.confidence", "detail.entropy", "detail.ambiguous"
    )


@query("result_table", "SELECT lang, count(*) AS n, max(doc_id) AS last FROM documents GROUP BY lang")
def result_table(spark, sf):
    """A result written to a run's own path and read back with its schema."""
    counts = table(spark, sf, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")
    )
    path = scratch_path(spark, "result")
    write_result(counts, path)
    return read_table(spark, path, "lang string, n long, last long", whole_file=False)
