"""Composite jobs over conversations, model-backed operators and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskloom.catalog import sqltext as S
from deskloom.catalog.base import (
    REPLIES_SQL,
    REQUESTS_SQL,
    TURNS_SQL,
    MOST_TURNS,
    pick,
    query,
    quote,
    replies,
    requests,
    sql_list,
    sql_pick,
    table,
    texts,
    turn_number,
    turns,
)
from deskloom.catalog.metric_queries import _macro_sql, _report_sql
from deskloom.catalog.source_queries import messages
from deskloom.catalog.vector_queries import index_sql, match_sql
from deskloom.functions import replies as RP
from deskloom.functions import rules as R
from deskloom.functions.intents import classify_by_cues, cue_hits, first_cue_intent
from deskloom.functions.text import fingerprint
from deskloom.operators import learners as L
from deskloom.operators.sampling import stratified_split
from deskloom.plans import classify as C
from deskloom.plans import evaluate as E
from deskloom.plans.cases import extract_cases
from deskloom.plans.decide import decide, prompt_table
from deskloom.plans.expand import expand_dataset
from deskloom.plans.vault import build_vault
from deskloom.session import materialize, scratch_path, settle
from deskloom.streaming import flows
from deskloom.catalog.join_queries import CLOSURE_SQL


@query(
    "extract_cases",
    f"""WITH RECURSIVE {CLOSURE_SQL}
    SELECT msg_id AS case_id, author_id AS customer_id, 'twitter' AS channel,
           {S.clean_message('text')} AS clean_text, {S.strip('text')} AS raw_text, 1 AS n_turns,
           'en' AS locale, 'STANDARD' AS account_tier, created AS timestamp
    FROM messages WHERE msg_id IN (SELECT id FROM reached) AND lower(author_id) <> 'applesupport'
      AND {S.clean_message('text')} <> ''""",
)
def extract_cases_rows(spark, sf):
    return extract_cases(messages(spark, sf)).select(
        "case_id",
        "customer_id",
        "channel",
        "clean_text",
        F.col("raw_turns")[0]["text"].alias("raw_text"),
        F.size("raw_turns").alias("n_turns"),
        "locale",
        "account_tier",
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
    )


VAULT_SQL = f"""{REPLIES_SQL},
first_pairs AS (SELECT conv_id, customer_text, agent_text FROM replies
                QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY case_id) = 1),
sanitized AS MATERIALIZED (SELECT conv_id, {S.sanitize_customer('customer_text')} AS customer_query,
                                  {S.sanitize_reply('agent_text')} AS agent_reply FROM first_pairs),
useful AS (SELECT *, {S.dedup_key('customer_query')} AS k FROM sanitized
           WHERE length(customer_query) >= 15 AND length(agent_reply) >= 20
             AND (contains(agent_reply, '{{') OR {S.contains_any('lower(agent_reply)', R.PAIR_KEYWORDS)})),
distinct_pairs AS MATERIALIZED (SELECT * FROM useful QUALIFY row_number() OVER (PARTITION BY k ORDER BY conv_id) = 1),
vault_cues AS {S.cue_columns('distinct_pairs', 'conv_id', 'customer_query', R.CUES)},
vault AS MATERIALIZED (SELECT printf('pair_%05d', row_number() OVER (ORDER BY conv_id)) AS pair_id,
          conv_id::VARCHAR AS case_id, c.intent, customer_query, agent_reply
          FROM distinct_pairs JOIN vault_cues c USING (conv_id))"""


def vault(spark, sf):
    return build_vault(turns(spark, sf), F.col("role") == "assistant")


@query("build_vault", f"WITH {VAULT_SQL} SELECT * FROM vault")
def build_vault_rows(spark, sf):
    return vault(spark, sf)


def customer_cases(spark, sf):
    """Every turn that is not the agent's, as a case."""
    return turns(spark, sf).filter("role <> 'assistant'").select(
        F.concat_ws("-", "conv_id", "turn").alias("case_id"), "text", F.col("author_id").alias("handle")
    )


def decide_sql(k: int = 3) -> str:
    """CTEs up to ``decided`` for the customer turns against the mined vault."""
    return f"""{VAULT_SQL},
cases AS MATERIALIZED (SELECT conv_id || '-' || turn AS case_id, {S.strip('text')} AS text,
                              {S.at_handle('author_id')} AS handle FROM turns WHERE role <> 'assistant'),
safety AS MATERIALIZED (SELECT case_id, {S.safety_columns('text')} FROM cases),
case_cues AS {S.cue_columns('cases', 'case_id', 'text', R.CUES)},
triaged AS MATERIALIZED (SELECT c.*, s.is_hazard, s.category, s.rule_code AS safety_code, s.stated_reason AS safety_reason,
             q.intent, q.confidence, CASE WHEN q.intent IN (SELECT intent FROM vault) THEN q.intent ELSE 'UNKNOWN' END AS target
             FROM cases c JOIN safety s USING (case_id) JOIN case_cues q USING (case_id)),
items AS (SELECT pair_id AS item, intent AS grp, customer_query AS text FROM vault),
asked AS (SELECT case_id AS item, target AS grp, text FROM triaged WHERE NOT is_hazard),
{index_sql('items')}, {match_sql('items', 'asked', k)},
best AS (SELECT m.query AS case_id, m.score, v.agent_reply, m.item AS best_pair FROM matches m
         JOIN vault v ON v.pair_id = m.item WHERE m.rank = 1),
found AS (SELECT query AS case_id, count(*) AS n_matches FROM matches GROUP BY query),
graded AS (SELECT t.*, coalesce(b.score, 0.0) AS top_similarity, b.agent_reply, b.best_pair, coalesce(n_matches, 0) AS n_matches,
           {S.zone('coalesce(b.score, 0.0)')} AS zone FROM triaged t LEFT JOIN best b USING (case_id) LEFT JOIN found USING (case_id)),
routed AS (SELECT *, {S.route_columns('intent', 'confidence', 'top_similarity', 'zone')},
           CASE WHEN zone <> 'LOW_OUT_OF_DISTRIBUTION' AND agent_reply IS NOT NULL THEN agent_reply
                ELSE {quote(R.SAFE_TRIAGE)} END AS template FROM graded),
replied AS (SELECT *, {S.fill_template('template', 'handle')} AS filled FROM routed),
decided AS MATERIALIZED (SELECT case_id, text AS customer_text, handle AS customer_handle,
  CASE WHEN is_hazard THEN 'UNKNOWN' ELSE intent END AS intent,
  (CASE WHEN is_hazard THEN 0.0 ELSE confidence END)::DOUBLE AS confidence,
  CASE WHEN is_hazard THEN 0.0 ELSE top_similarity END AS top_similarity,
  CASE WHEN is_hazard THEN 'SAFETY_BLOCKED' ELSE zone END AS confidence_zone,
  CASE WHEN is_hazard THEN NULL ELSE best_pair END AS best_pair,
  CASE WHEN is_hazard THEN 0 ELSE n_matches END AS n_matches,
  CASE WHEN is_hazard THEN 'HANDOFF' ELSE decision END AS decision,
  CASE WHEN NOT is_hazard THEN priority WHEN category = 'SAFETY_HAZARD' THEN 'URGENT_P1' ELSE 'PRIORITY_P2' END AS priority,
  CASE WHEN is_hazard THEN safety_code ELSE rule_code END AS rule_code,
  CASE WHEN is_hazard THEN safety_reason ELSE stated_reason END AS stated_reason,
  CASE WHEN NOT is_hazard AND decision <> 'HANDOFF' THEN filled END AS draft_reply,
  NOT is_hazard AND decision <> 'HANDOFF' AS failsafe_used FROM replied)"""


_DECISION = [
    "case_id", "customer_text", "customer_handle", "intent", "confidence", "top_similarity",
    "confidence_zone", "best_pair", "n_matches", "decision", "priority", "rule_code",
    "stated_reason", "draft_reply", "failsafe_used",
]


DECIDED_SQL = f"WITH {decide_sql()} SELECT {', '.join(_DECISION)} FROM decided"


@query("decide", DECIDED_SQL)
def decide_rows(spark, sf):
    store = settle(spark, lambda: vault(spark, sf), "vault")
    decided = decide(customer_cases(spark, sf), store)
    counted = decided.withColumn("n_matches", F.when(F.col("matches").isNull(), 0).otherwise(F.size("matches")))
    return counted.withColumn("best_pair", F.get("matches", F.lit(0))["pair_id"]).select(*_DECISION)


@query(
    "prompt_table",
    f"""WITH {decide_sql()}, lines AS (SELECT m.query AS case_id,
      string_agg(m.rank || '. Q: ' || v.customer_query || chr(10) || '   A: ' || v.agent_reply, chr(10) ORDER BY m.rank) AS lines
      FROM matches m JOIN vault v ON v.pair_id = m.item GROUP BY m.query)
    SELECT d.case_id, 'Earlier answers, topic ' || d.intent || ':' || chr(10) || coalesce(lines, '') ||
      chr(10) || chr(10) || 'Question: ' || d.customer_text AS prompt,
      {S.contains_any('lower(d.customer_text)', R.DRAFT_DEVICES)} AND {S.matches('lower(d.customer_text)', R.VERSION, False)} AS specified
    FROM decided d LEFT JOIN lines USING (case_id) WHERE d.decision <> 'HANDOFF'""",
)
def prompt_table_rows(spark, sf):
    store = settle(spark, lambda: vault(spark, sf), "vault")
    decided = decide(customer_cases(spark, sf), store).filter("decision <> 'HANDOFF'").select(
        "case_id", F.col("customer_text").alias("text"), F.col("customer_handle").alias("handle"), "intent", "matches"
    )
    text = F.col("text")
    prompts = prompt_table(decided, RP.names_device(text, R.DRAFT_DEVICES), RP.names_version(text))
    acknowledged = F.contains("system_instruction", F.lit(R.BRAND.ask_nothing))
    return prompts.select("case_id", "prompt", acknowledged.alias("specified"))


# Batch classification: probabilities are smoothed cue counts.
def smoothed_cues(text: Column) -> Column:
    """Probability array over the taxonomy: (hits + 1) / (all hits + labels)."""
    hits = F.transform(  # the text is lower-cased once, not for every cue
        F.array(F.lower(text)), lambda lowered: F.array(*[cue_hits(lowered, R.CUES[name]) for name in R.TAXONOMY])
    )
    return F.transform(
        hits,
        lambda h: F.transform(
            h, lambda n: (n + 1) / (F.aggregate(h, F.lit(0), lambda a, x: a + x) + F.lit(float(len(R.TAXONOMY))))
        ),
    )[0]


_HITS_SQL = "[" + ", ".join(S.cue_hits("lt", R.CUES[name]) for name in R.TAXONOMY) + "]"
CLASSIFIED_SQL = f"""{REQUESTS_SQL},
keyed AS MATERIALIZED (SELECT request_id, text, lang, {S.fingerprint('text')} AS text_key FROM requests),
h AS (SELECT text_key, any_value(lower(text)) AS lt FROM keyed GROUP BY text_key),
hh AS MATERIALIZED (SELECT text_key, {_HITS_SQL} AS hits FROM h),
p AS (SELECT text_key, list_transform(hits, lambda x: (x + 1) / (list_sum(hits) + 6.0)) AS p FROM hh),
long AS (SELECT text_key, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM p),
best AS (SELECT text_key, i, p FROM long QUALIFY row_number() OVER (PARTITION BY text_key ORDER BY p DESC, i DESC) = 1),
second AS (SELECT text_key, p FROM long QUALIFY row_number() OVER (PARTITION BY text_key ORDER BY p DESC, i DESC) = 2),
ent AS (SELECT text_key, round(-sum(p * log2(p)), 4) AS entropy FROM long GROUP BY text_key),
prior AS (SELECT DISTINCT text_key FROM keyed WHERE lang = 'en'),
classified AS MATERIALIZED (SELECT k.request_id, k.text_key, ({sql_list(R.TAXONOMY)})[b.i] AS intent, round(b.p, 4) AS confidence,
  entropy, (b.p - s.p < 0.15 OR b.p < 0.6) AS ambiguous, k.text_key IN (SELECT text_key FROM prior) AS cached
  FROM keyed k JOIN best b USING (text_key) JOIN second s USING (text_key) JOIN ent USING (text_key))"""


def classified(spark, sf):
    asked = requests(spark, sf)
    earlier = asked.filter("lang = 'en'").select("request_id", "text")
    prior = C.score_new(earlier, None, smoothed_cues)
    return C.classify_batch(asked.select("request_id", "text"), prior, smoothed_cues)


@query(
    "batch_classify",
    f"WITH {CLASSIFIED_SQL} SELECT request_id, intent, confidence, entropy, ambiguous, cached FROM classified",
)
def batch_classify(spark, sf):
    return classified(spark, sf).select(
        "request_id", "detail.intent", "detail.confidence", "detail.entropy", "detail.ambiguous", "cached"
    )


@query(
    "batch_stats",
    f"""WITH {CLASSIFIED_SQL} SELECT count(*) AS batch_size, count(*) FILTER (cached) AS cache_hits,
    count(*) FILTER (NOT cached) - count(DISTINCT text_key) FILTER (NOT cached) AS deduplicated_count FROM classified""",
)
def batch_stats(spark, sf):
    return C.batch_stats(classified(spark, sf))


# Three systems over the answered questions; the derived golden intent is a label by thread.
def _golden(spark, sf):
    def cases():
        return replies(spark, sf, answers=False).select(
            "case_id", F.col("customer_text").alias("text"), pick(R.TAXONOMY, F.col("conv_id")).alias("intent")
        )

    return settle(spark, cases, "golden")


def _systems(spark, sf):
    """The simple system classifies by the first cue, so that the twin can, too."""
    store = settle(spark, lambda: vault(spark, sf), "vault")
    by_cue = lambda text: F.coalesce(first_cue_intent(text), F.lit(R.OTHER))
    return E.score_replies(E.system_replies(_golden(spark, sf), None, store, by_cue))


_MARKS = S.rubric_columns("text", "reply")
_GOLD_CASES = (
    decide_sql()
    .replace(
        "cases AS MATERIALIZED (SELECT conv_id || '-' || turn AS case_id, "
        f"{S.strip('text')} AS text,\n                              {S.at_handle('author_id')} AS handle "
        "FROM turns WHERE role <> 'assistant')",
        f"cases AS MATERIALIZED (SELECT case_id, {S.strip('customer_text')} AS text, '@user' AS handle FROM replies)",
    )
)
SYSTEMS_SQL = f"""{_GOLD_CASES},
golden AS MATERIALIZED (SELECT case_id, customer_text AS text, {sql_pick(R.TAXONOMY, 'conv_id')} AS actual FROM replies),
majority AS (SELECT actual FROM golden GROUP BY actual ORDER BY count(*) DESC, actual LIMIT 1),
systems AS (
  SELECT 'trivial' AS model, case_id, text, actual, (SELECT actual FROM majority) AS predicted,
         '@user ' || {quote(R.CANNED_REPLY)} AS reply, false AS suppressed FROM golden
  UNION ALL SELECT 'simple', case_id, text, actual, coalesce({S.first_cue('text', R.CUES)}, 'UNKNOWN'),
         '@user ' || CASE {' '.join(f"WHEN {S.contains_any('lower(text)', w)} THEN {quote(r)}" for w, r in R.KEYWORD_REPLIES)}
         ELSE {quote(R.KEYWORD_REPLY_ELSE)} END, false FROM golden
  UNION ALL SELECT 'proposed', g.case_id, g.text, g.actual, r.intent, CASE WHEN NOT r.is_hazard THEN r.filled END, r.is_hazard
         FROM golden g JOIN replied r USING (case_id)),
marks AS (SELECT *, {S.select_columns(_MARKS)} FROM systems),
scored AS MATERIALIZED (SELECT model, case_id, actual, predicted, reply, suppressed,
  {', '.join(f"CASE WHEN suppressed THEN 5.0::DOUBLE ELSE {d} END AS {d}" for d in _MARKS)},
  CASE WHEN suppressed THEN 5.0::DOUBLE ELSE round(({' + '.join(_MARKS)}) / 5.0, 2) END AS overall FROM marks)"""


@query(
    "benchmark_metrics",
    f"""WITH {SYSTEMS_SQL}, {_report_sql('model', 'scored', digits=None)},
    m AS ({_macro_sql('model')}),
    r AS (SELECT model, {', '.join(f'round(avg({d}), 2) AS {d}' for d in RP.DIMENSIONS)} FROM scored GROUP BY model)
    SELECT model, round(accuracy * 100, 2) AS accuracy, macro_precision, macro_recall, macro_f1, weighted_f1,
           {', '.join(RP.DIMENSIONS)} FROM m JOIN r USING (model)""",
)
def benchmark_metrics(spark, sf):
    return E.benchmark_metrics(materialize(_systems(spark, sf), "systems"))


def training_turns(spark, sf):
    """(case_id, text, intent) that the fitted system learns from."""
    return turns(spark, sf).filter("role <> 'assistant'").select(
        F.concat_ws("-", "conv_id", "turn").alias("case_id"),
        F.concat(F.col("text"), F.lit(" again")).alias("text"),
        pick(R.TAXONOMY, F.col("conv_id")).alias("intent"),
    )


@query("system_replies")
def system_replies(spark, sf):
    """The three systems with the fitted text model; its weights are not SQL."""
    store = settle(spark, lambda: vault(spark, sf), "vault")
    scored = E.score_replies(E.system_replies(_golden(spark, sf), training_turns(spark, sf), store))
    return scored.select("model", "case_id", "actual", "predicted", "reply", "suppressed", "overall")


@query(
    "rubric_means",
    f"""WITH {SYSTEMS_SQL} SELECT model, count(*) AS n, {', '.join(f'round(avg({d}), 2) AS {d}' for d in RP.DIMENSIONS)}
    FROM scored GROUP BY model""",
)
def rubric_means(spark, sf):
    return _systems(spark, sf).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(d), 2).alias(d) for d in RP.DIMENSIONS]
    )


@query(
    "sample_rows",
    f"""WITH {SYSTEMS_SQL} SELECT model, case_id, reply, overall,
    row_number() OVER (PARTITION BY model ORDER BY case_id) AS sample FROM scored
    WHERE reply IS NOT NULL AND NOT suppressed QUALIFY sample <= 3""",
)
def sample_rows(spark, sf):
    return E.sample_replies(_systems(spark, sf), "case_id").select("model", "case_id", "reply", "overall", "sample")


# Dataset expansion over all turns; the scorer's confidence grows with the number of cues.
_EXPAND_POOL, _EXPAND_QUOTA = 60, 25


def _expand_score(text: Column) -> Column:
    best = classify_by_cues(text)
    return F.struct(
        best["intent"].alias("intent"),
        F.when(best["hits"] > 0, F.lit(0.45) + best["hits"] * F.lit(0.15)).otherwise(0.3).alias("confidence"),
    )


def _expand_verify(text: Column) -> Column:
    return F.when(F.length(text) % 4 == 0, "DISCARD").otherwise(first_cue_intent(text))


def _expand_sql() -> str:
    parts, taken = [], []
    for name, cues in R.CUES.items():
        t = f"pool_{name.lower()}"
        free = "".join(f" AND ord NOT IN (SELECT ord FROM {x})" for x in taken)
        parts.append(
            f"{t} AS MATERIALIZED (SELECT text, ord, {quote(name)} AS pool FROM corpus "
            f"WHERE {S.contains_any('lower(text)', cues)}{free} ORDER BY ord LIMIT {_EXPAND_POOL})"
        )
        taken.append(t)
    labels = ", ".join(quote(v) for v in R.TAXONOMY)
    return f"""WITH {TURNS_SQL},
    golden AS MATERIALIZED (SELECT text, {sql_pick(R.TAXONOMY, 'item_id')} AS intent FROM benchmark),
    corpus AS MATERIALIZED (SELECT text, min(conv_id * {MOST_TURNS} + turn) AS ord FROM turns
      WHERE length(text) BETWEEN 25 AND 250 AND text NOT IN (SELECT text FROM golden) GROUP BY text),
    {', '.join(parts)},
    have AS (SELECT intent, count(*) AS n FROM golden GROUP BY intent),
    pools AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(f'SELECT * FROM {t}' for t in taken)})
      WHERE pool NOT IN (SELECT intent FROM have WHERE n >= {_EXPAND_QUOTA})),
    cued AS {S.cue_columns('pools', 'ord', 'text', R.CUES)},
    scored AS MATERIALIZED (SELECT p.text, p.pool, c.intent, md5('42:' || p.ord) AS hash,
      CASE WHEN hits > 0 THEN 0.45::DOUBLE + hits * 0.15::DOUBLE ELSE 0.3 END AS conf FROM pools p JOIN cued c USING (ord)),
    accepted AS MATERIALIZED (SELECT text, intent FROM (
      SELECT text, intent, row_number() OVER (PARTITION BY intent ORDER BY hash) AS rn FROM scored WHERE conf >= 0.8)
      LEFT JOIN have USING (intent) WHERE rn <= {_EXPAND_QUOTA} - coalesce(n, 0)),
    counts AS (SELECT intent, count(*) AS n FROM (SELECT intent FROM golden UNION ALL SELECT intent FROM accepted) GROUP BY intent),
    queued AS (SELECT text, pool, hash, row_number() OVER (PARTITION BY pool ORDER BY hash) AS rank
      FROM scored WHERE conf >= 0.6 AND conf < 0.8),
    kept AS (SELECT text, hash, CASE WHEN length(text) % 4 = 0 THEN 'DISCARD' ELSE {S.first_cue('text', R.CUES)} END AS verified
      FROM queued q LEFT JOIN have h ON q.pool = h.intent WHERE rank <= 2 * ({_EXPAND_QUOTA} - coalesce(n, 0))),
    verified AS (SELECT text, verified AS intent FROM (
      SELECT text, verified, row_number() OVER (PARTITION BY verified ORDER BY hash) AS rn FROM kept WHERE verified IN ({labels})) v
      LEFT JOIN counts c ON v.verified = c.intent WHERE rn <= {_EXPAND_QUOTA} - coalesce(n, 0))
    SELECT text, intent, 'golden' AS source FROM golden UNION ALL SELECT text, intent, 'gpu_high_conf' FROM accepted
    UNION ALL SELECT text, intent, 'llm_verified' FROM verified"""


@query("expand_dataset", _expand_sql())
def expand_dataset_rows(spark, sf):
    golden = table(spark, sf, "benchmark").select("text", pick(R.TAXONOMY, F.col("item_id")).alias("intent"))
    corpus = turns(spark, sf).select("text", turn_number().alias("ord"))
    return expand_dataset(
        golden, corpus, _expand_score, _expand_verify, pool_size=_EXPAND_POOL, quota=_EXPAND_QUOTA
    )


# Model-backed operators. Fitted weights are not SQL; the rows are checked by tests.
def _quality(spark, sf, hint=None):
    labels = table(spark, sf, "labels")
    docs = texts(spark, sf, "documents").join(labels.hint(hint) if hint else labels, "doc_id")
    return materialize(docs.select("doc_id", "text", "quality"), "quality")


@query("tfidf_lr")
def tfidf_lr(spark, sf):
    rows = materialize(stratified_split(_quality(spark, sf), "quality", "doc_id"), "split")
    model = L.fit_text_model(rows.filter("split = 'train'"), "doc_id", "text", "quality", ("low", "high"))
    return L.predict_text(model, rows.filter("split = 'test'"), "doc_id", "text").select(
        "doc_id", "quality", "predicted", "confidence"
    )


@query("embedding_classify")
def embedding_classify(spark, sf):
    rows = materialize(
        stratified_split(table(spark, sf, "embeddings"), "label", "vec_id"), "embedding-split"
    )
    model = L.fit_embedding_model(rows.filter("split = 'train'"), "embedding", "label")
    labels = [str(i) for i in range(10)]
    return L.predict_embeddings(model, rows.filter("split = 'test'"), "embedding", labels).select(
        "vec_id", "label", "predicted", "confidence"
    )


@query("cross_validation")
def cross_validation(spark, sf):
    dealt = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    from deskloom.operators.sampling import stratified_folds

    folds = materialize(stratified_folds(dealt, "label", "vec_id"), "folds")
    labels = [str(i) for i in range(10)]
    parts = []
    for fold in range(5):
        model = L.fit_embedding_model(folds.filter(F.col("fold") != fold), "embedding", "label", max_iter=20)
        held = folds.filter(F.col("fold") == fold)
        parts.append(L.predict_embeddings(model, held, "embedding", labels).select("fold", "label", "predicted"))
    predictions = reduce(lambda a, b: a.unionByName(b), parts).select(
        "fold", F.col("label").cast("string").alias("actual"), "predicted"
    )
    return E.summarise_folds(predictions, labels)


@query("text_cross_validation")
def text_cross_validation(spark, sf):
    """Folds of the fitted text model over the labelled documents."""
    labels = ("low", "high")
    marked = _quality(spark, sf, "merge")  # labels grow with the documents: never held whole
    predictions = E.cross_validate(marked, "doc_id", "text", "quality", labels, max_iter=20)
    return E.summarise_folds(predictions, labels)


# Streams over the same tables, run to the end of what is there.
def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    limited = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16)
    return limited.parquet(f"{sf}/{name}*.parquet")


@query("stream_decide", DECIDED_SQL)
def stream_decide(spark, sf):
    store = settle(spark, lambda: vault(spark, sf), "vault")
    conv, turn = F.col("conv_id"), F.col("turn")
    from deskloom.catalog.base import CUSTOMER_PHRASES

    arriving = _stream(spark, sf, "conversations").filter("role <> 'assistant'").select(
        F.concat_ws("-", "conv_id", "turn").alias("case_id"),
        F.concat(pick(CUSTOMER_PHRASES, conv * 5 + turn), F.lit("\n"), F.col("text")).alias("text"),
        F.when(F.col("role") == "system", "system")
        .otherwise(F.concat(F.lit("cust_"), conv.cast("string")))
        .alias("handle"),
    )
    out = scratch_path(spark, "stream-decisions")
    flows.decide_stream(arriving, store, out, scratch_path(spark, "stream-state")).awaitTermination()
    decided = spark.read.parquet(out)
    counted = decided.withColumn("n_matches", F.when(F.col("matches").isNull(), 0).otherwise(F.size("matches")))
    return counted.withColumn("best_pair", F.get("matches", F.lit(0))["pair_id"]).select(*_DECISION)


_STREAM_MISSES = """WITH RECURSIVE e AS (SELECT event_id, user_id || '/' || event_type AS key,
                                  CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
    misses AS (SELECT key, min(sec) AS sec FROM e GROUP BY key
               UNION ALL
               SELECT m.key, (SELECT min(e.sec) FROM e WHERE e.key = m.key AND e.sec >= m.sec + 3600) AS sec
               FROM misses m WHERE m.sec IS NOT NULL),
    first AS (SELECT min(e.event_id) AS event_id FROM e JOIN misses m ON e.key = m.key AND e.sec = m.sec
              GROUP BY e.key, e.sec)"""


def _rocksdb(spark):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


@query("stream_dedup", f"{_STREAM_MISSES} SELECT event_id FROM first")
def stream_dedup(spark, sf):
    _rocksdb(spark)
    events = _stream(spark, sf, "events").select(
        "event_id", "ts", F.concat_ws("/", "user_id", "event_type").alias("text")
    )
    out = scratch_path(spark, "stream-dedup")
    flows.run_available(
        flows.dedup_stream(events, "text", "ts", "event_id"), out, scratch_path(spark, "stream-state")
    )
    return spark.read.parquet(out).select("event_id")


@query(
    "stream_reuse",
    f"{_STREAM_MISSES} SELECT key, event_id, event_id NOT IN (SELECT event_id FROM first) AS hit FROM e",
)
def stream_reuse(spark, sf):
    _rocksdb(spark)
    events = _stream(spark, sf, "events").select(
        "event_id", "ts", F.concat_ws("/", "user_id", "event_type").alias("key")
    )
    out = scratch_path(spark, "stream-reuse")
    flows.run_available(
        flows.reuse_stream(events, "key", "ts", "event_id"), out, scratch_path(spark, "stream-state")
    )
    return spark.read.parquet(out)
