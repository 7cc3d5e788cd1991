"""Threads, lookups, dedup, ranking, splits and reuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskloom.catalog import sqltext as S
from deskloom.catalog.base import (
    REPLIES_SQL,
    query,
    quote,
    sql_pick,
    pick,
    table, texts,
    turns,
)
from deskloom.catalog.source_queries import MESSAGES_SQL, messages
from deskloom.functions.text import dedup_key, fingerprint
from deskloom.operators import matching as MT
from deskloom.operators import sampling as SM
from deskloom.operators import threads as TH
from deskloom.operators.ordering import top_n_per_group
from deskloom.operators.reuse import reuse_summary, ttl_reuse
from deskloom.plans.evaluate import first_examples
from deskloom.plans.expand import candidate_texts, merge_verified

# Undirected closure by recursion, the other way to the same result.
CLOSURE_SQL = f"""{MESSAGES_SQL},
edges AS (SELECT msg_id AS a, parent_id AS b FROM messages WHERE parent_id IS NOT NULL
          UNION SELECT parent_id, msg_id FROM messages WHERE parent_id IS NOT NULL),
reached AS (SELECT msg_id AS id FROM messages WHERE lower(author_id) = 'applesupport'
            UNION SELECT edges.b FROM reached JOIN edges ON reached.id = edges.a)"""


@query(
    "thread_closure",
    f"""WITH RECURSIVE {CLOSURE_SQL},
    up AS (SELECT msg_id, msg_id AS at FROM messages
           UNION ALL SELECT up.msg_id, m.parent_id FROM up JOIN messages m ON m.msg_id = up.at
           WHERE m.parent_id IS NOT NULL),
    top AS (SELECT up.msg_id, up.at AS root_id FROM up
            LEFT JOIN messages m ON m.msg_id = up.at WHERE m.msg_id IS NULL OR m.parent_id IS NULL)
    SELECT msg_id, root_id FROM top WHERE msg_id IN (SELECT id FROM reached)""",
)
def thread_closure(spark, sf):
    return TH.select_threads(messages(spark, sf))


@query(
    "semi_join_selected",
    f"""WITH {MESSAGES_SQL}, answered AS (SELECT parent_id AS id FROM messages WHERE lower(author_id) = 'applesupport')
    SELECT msg_id, author_id FROM messages WHERE msg_id IN (SELECT id FROM answered WHERE id IS NOT NULL)""",
)
def semi_join_selected(spark, sf):
    rows = messages(spark, sf)
    answered = rows.filter(F.lower("author_id") == "applesupport").select(F.col("parent_id").alias("id"))
    return rows.join(answered, rows.msg_id == answered.id, "left_semi").select("msg_id", "author_id")


@query(
    "multi_turn",
    "SELECT conv_id, turn FROM conversations WHERE conv_id IN "
    "(SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) >= 2)",
)
def multi_turn(spark, sf):
    return TH.multi_turn(table(spark, sf, "conversations")).select("conv_id", "turn")


@query(
    "first_qa_pair",
    f"""WITH {REPLIES_SQL} SELECT conv_id, case_id % 100 AS turn, customer_text, agent_text
    FROM replies QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY case_id) = 1""",
)
def first_qa_pair(spark, sf):
    return TH.first_adjacent_pair(turns(spark, sf), F.col("role") == "assistant")


@query(
    "intent_fallback",
    f"""WITH q AS (SELECT event_id, {sql_pick(('click', 'VIEW', 'nothing', 'Purchase'), 'event_id')} AS intent FROM events),
    known AS (SELECT DISTINCT upper(event_type) AS k FROM events)
    SELECT event_id, intent, coalesce(k, 'UNKNOWN') AS target FROM q LEFT JOIN known ON upper(intent) = k""",
)
def intent_fallback(spark, sf):
    events = table(spark, sf, "events")
    store = events.select(F.upper("event_type").alias("intent"))
    asked = events.select(
        "event_id", pick(("click", "VIEW", "nothing", "Purchase"), F.col("event_id")).alias("intent")
    )
    return MT.fall_back_group(asked, store)


@query(
    "reuse_hits",
    f"""WITH prior AS (SELECT DISTINCT {S.fingerprint('text')} AS text_key FROM documents WHERE lang = 'en'),
    d AS (SELECT doc_id, {S.fingerprint('text')} AS text_key FROM documents)
    SELECT doc_id, text_key, text_key IN (SELECT text_key FROM prior) AS reused FROM d""",
)
def reuse_hits(spark, sf):
    docs = texts(spark, sf, "documents").select("doc_id", fingerprint(F.col("text")).alias("text_key"), "lang")
    prior = docs.filter("lang = 'en'").select("text_key").distinct()
    hits, misses = MT.split_by_reuse(docs.drop("lang"), prior)
    return hits.withColumn("reused", F.lit(True)).unionByName(misses.withColumn("reused", F.lit(False))).select(
        "doc_id", "text_key", "reused"
    )


@query(
    "candidate_band",
    """SELECT doc_id FROM documents WHERE length(text) BETWEEN 25 AND 250
    AND text NOT IN (SELECT text FROM benchmark)""",
)
def candidate_band(spark, sf):
    return candidate_texts(table(spark, sf, "documents"), table(spark, sf, "benchmark")).select("doc_id")


@query(
    "anti_seen",
    "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE source IN ('src1', 'src2')) "
    "AND text NOT IN (SELECT text FROM benchmark)",
)
def anti_seen(spark, sf):
    docs = table(spark, sf, "documents")
    seen = docs.filter(F.col("source").isin("src1", "src2"))
    return MT.without_seen(docs, seen, table(spark, sf, "benchmark")).select("doc_id")


@query(
    "leakage_filter",
    """WITH train AS (SELECT doc_id, text FROM documents UNION ALL
                     SELECT 1000000000 + item_id, text FROM benchmark),
    marked AS (SELECT doc_id, text IN (SELECT text FROM benchmark) AS held FROM train)
    SELECT doc_id FROM marked WHERE NOT held""",
)
def leakage_filter(spark, sf):
    held_out = table(spark, sf, "benchmark")
    train = (
        table(spark, sf, "documents")
        .select("doc_id", "text")
        .unionByName(held_out.select((F.lit(1000000000) + F.col("item_id")).alias("doc_id"), "text"))
    )
    return MT.drop_leaked(train, held_out).select("doc_id")


@query(
    "dedup_keep_first",
    f"""WITH d AS (SELECT doc_id, source, {S.dedup_key('text')} AS k FROM documents)
    SELECT doc_id, source FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1""",
)
def dedup_keep_first(spark, sf):
    docs = texts(spark, sf, "documents").select("doc_id", "source", dedup_key(F.col("text")).alias("k"))
    return MT.keep_first(docs, "k", ["doc_id"]).drop("k")


@query(
    "batch_dedup_stats",
    f"""SELECT count(*) AS batch_size, count(DISTINCT {S.fingerprint('text')}) AS distinct_texts,
    count(*) - count(DISTINCT {S.fingerprint('text')}) AS deduplicated_count FROM documents""",
)
def batch_dedup_stats(spark, sf):
    return MT.batch_dedup_stats(texts(spark, sf, "documents"), "text")


@query(
    "dedup_representatives",
    f"""WITH d AS (SELECT doc_id, text, {S.fingerprint('text')} AS text_key FROM documents)
    SELECT text_key, min(doc_id) AS doc_id, count(*) AS copies FROM d GROUP BY text_key""",
)
def dedup_representatives(spark, sf):
    return MT.unique_texts(texts(spark, sf, "documents"), "text", "doc_id").drop("text")


@query(
    "cap_per_group",
    "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents "
    "QUALIFY rn <= 20",
)
def cap_per_group(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id")
    return top_n_per_group(docs, ["source"], [F.col("doc_id")], 20)


@query(
    "pair_ids",
    f"""WITH d AS (SELECT doc_id, {S.dedup_key('text')} AS k FROM documents),
    u AS (SELECT doc_id FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1)
    SELECT doc_id, printf('pair_%05d', row_number() OVER (ORDER BY doc_id)) AS pair_id FROM u""",
)
def pair_ids(spark, sf):
    docs = texts(spark, sf, "documents").select("doc_id", dedup_key(F.col("text")).alias("k"))
    return SM.pair_ids(MT.keep_first(docs, "k", ["doc_id"]).select("doc_id"), "doc_id")


@query(
    "first_per_group",
    "SELECT source, min(doc_id) AS doc_id, arg_min(text, doc_id) AS text FROM documents GROUP BY source",
)
def first_per_group(spark, sf):
    return first_examples(table(spark, sf, "documents"), "source", "text", "doc_id")


_CAPPED_CUES = {
    "ALPHA": ["the ", "tion"],
    "BETA": ["ing", "sch"],
    "GAMMA": ["ent", "ción"],
    "DELTA": ["a"],
}
_POOL = 25


def _capped_sql() -> str:
    """Intent by intent: the first texts no earlier intent took."""
    parts, taken = [], []
    for name, cues in _CAPPED_CUES.items():
        free = "".join(f" AND ord NOT IN (SELECT ord FROM {t})" for t in taken)
        parts.append(
            f"{name.lower()} AS MATERIALIZED (SELECT ord, {quote(name)} AS intent FROM distinct_texts "
            f"WHERE {S.contains_any('lower(text)', cues)}{free} ORDER BY ord LIMIT {_POOL})"
        )
        taken.append(name.lower())
    union = " UNION ALL ".join(f"SELECT * FROM {t}" for t in taken)
    return (
        "WITH distinct_texts AS MATERIALIZED (SELECT text, min(doc_id) AS ord FROM documents GROUP BY text), "
        + ", ".join(parts)
        + f" {union}"
    )


@query("capped_mining", _capped_sql())
def capped_mining(spark, sf):
    docs = texts(spark, sf, "documents").select("text", F.col("doc_id").alias("ord"))
    return SM.mine_pools(docs, cues=_CAPPED_CUES, pool_size=_POOL).select("ord", "intent")


@query(
    "quota_fill",
    """WITH taken AS (SELECT CASE WHEN quality = 1 THEN 'en' ELSE 'fr' END AS lang, count(*) AS n
                     FROM labels WHERE toxic = 1 GROUP BY 1),
    c AS (SELECT doc_id, lang, CASE WHEN source = 'src3' THEN 0 ELSE 1 END AS pr, md5('42:' || doc_id) AS h FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY pr, h) AS rn FROM c)
    SELECT doc_id, lang FROM r LEFT JOIN taken USING (lang) WHERE rn <= 120 - coalesce(n, 0)""",
)
def quota_fill(spark, sf):
    labels = table(spark, sf, "labels").filter("toxic = 1")
    taken = SM.label_counts(
        labels.select(F.when(F.col("quality") == 1, "en").otherwise("fr").alias("lang")), "lang"
    )
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    order = [SM.by_priority({"src3": 0}, F.col("source")), SM.seeded_hash(F.col("doc_id"))]
    return SM.fill_quota(docs, "lang", order, taken).select("doc_id", "lang")


@query(
    "verified_merge",
    """WITH h AS (SELECT doc_id, lang AS intent, md5('42:' || doc_id) AS hash FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY hash) AS rank FROM h),
    needed AS (SELECT lang AS intent, count(*) // 10 AS needed FROM documents GROUP BY lang),
    kept AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'DISCARD' WHEN 1 THEN intent ELSE 'en' END AS verified, hash
             FROM r JOIN needed USING (intent) WHERE rank <= 2 * needed)
    SELECT doc_id, verified FROM kept WHERE verified <> 'DISCARD'
    QUALIFY row_number() OVER (PARTITION BY verified ORDER BY hash) <= 60""",
)
def verified_merge(spark, sf):
    from deskloom.operators.ordering import number_rows

    docs = table(spark, sf, "documents")
    hashed = docs.select("doc_id", F.col("lang").alias("intent"), SM.seeded_hash(F.col("doc_id")).alias("hash"))
    ranked = number_rows(hashed, ["hash"], ["intent"], name="rank")
    answer = (
        F.when(F.col("doc_id") % 3 == 0, "DISCARD").when(F.col("doc_id") % 3 == 1, F.col("intent")).otherwise("en")
    )
    needed = docs.groupBy(F.col("lang").alias("intent")).agg(
        F.floor(F.count(F.lit(1)) / 10).alias("needed")
    )
    kept = merge_verified(ranked.withColumn("verified", answer), needed, ("de", "en", "es", "fr"))
    return SM.fill_quota(kept, "verified", [F.col("hash")], quota=60).select("doc_id", "verified")


@query(
    "stratified_split",
    """WITH h AS (SELECT doc_id, quality, md5('42:' || doc_id) AS hash FROM labels),
    r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY hash) AS rn,
                 count(*) OVER (PARTITION BY quality) AS n FROM h)
    SELECT doc_id, quality, CASE WHEN rn <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r""",
)
def stratified_split(spark, sf):
    return SM.stratified_split(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query(
    "stratified_folds",
    """SELECT doc_id, lang, ((row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id)) - 1) % 5)::INT AS fold
    FROM documents""",
)
def stratified_folds(spark, sf):
    return SM.stratified_folds(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query(
    "ttl_reuse",
    """WITH RECURSIVE e AS (SELECT event_id, user_id || '/' || event_type AS key,
                                  CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
    misses AS (SELECT key, min(sec) AS sec FROM e GROUP BY key
               UNION ALL
               SELECT m.key, (SELECT min(e.sec) FROM e WHERE e.key = m.key AND e.sec >= m.sec + 3600) AS sec
               FROM misses m WHERE m.sec IS NOT NULL),
    first AS (SELECT min(e.event_id) AS event_id FROM e JOIN misses m ON e.key = m.key AND e.sec = m.sec
              GROUP BY e.key, e.sec)
    SELECT event_id, event_id NOT IN (SELECT event_id FROM first) AS hit FROM e""",
)
def ttl_reuse_rows(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", "ts", F.concat_ws("/", "user_id", "event_type").alias("key")
    )
    return ttl_reuse(events, "key", "ts", "event_id").select("event_id", "hit")


@query(
    "ttl_reuse_by_type",
    """WITH RECURSIVE e AS (SELECT event_type AS key, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
    s AS MATERIALIZED (SELECT DISTINCT key, sec FROM e),
    misses AS (SELECT key, min(sec) AS sec FROM s GROUP BY key
               UNION ALL
               SELECT m.key, (SELECT min(s.sec) FROM s WHERE s.key = m.key AND s.sec >= m.sec + 3600) AS sec
               FROM misses m WHERE m.sec IS NOT NULL),
    n AS (SELECT key, count(sec) AS misses FROM misses GROUP BY key),
    t AS (SELECT key, count(*) AS rows FROM e GROUP BY key)
    SELECT key AS event_type, rows - misses AS hits, misses FROM t JOIN n USING (key)""",
)
def ttl_reuse_by_type(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "event_type")
    return reuse_summary(ttl_reuse(events, "event_type", "ts", "event_id"), "event_type")
