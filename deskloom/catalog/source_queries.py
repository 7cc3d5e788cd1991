"""Readers and writers: tables go out in a record shape and come back through its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskloom.catalog import sqltext as S
from deskloom.catalog.base import REPLIES_SQL, REQUESTS_SQL, TURNS_SQL, query, quote, replies, requests, sql_list, sql_pick, pick, table, turns
from deskloom.functions import rules as R
from deskloom.operators import metrics as M
from deskloom.operators.matching import tagged_union
from deskloom.operators.ordering import int_bucket
from deskloom.session import scratch_path
from deskloom.sources import readers, writers

_TIME_FORMAT = "EEE MMM dd HH:mm:ss Z yyyy"


def messages(spark, sf):
    """Message graph of the conversations: each turn answers the one before it.

    System turns are no messages, so some parents are not in the table.
    """
    rows = turns(spark, sf).filter(F.col("role") != "system")
    created = F.timestamp_seconds(F.lit(1509487847) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return rows.select(
        F.concat_ws("-", "conv_id", "turn").alias("msg_id"),
        "author_id",
        "text",
        F.when(F.col("turn") % 5 == 4, "soon").otherwise(F.date_format(created, _TIME_FORMAT)).alias("created_at"),
        F.when(F.col("turn") > 0, F.concat_ws("-", "conv_id", F.col("turn") - 1)).alias("parent_id"),
    )


MESSAGES_SQL = f"""{TURNS_SQL}, messages AS (
  SELECT conv_id || '-' || turn AS msg_id, author_id, text, turn,
         CASE WHEN turn % 5 <> 4 THEN to_timestamp(1509487847 + conv_id * 3600 + turn * 60) AT TIME ZONE 'UTC' END AS created,
         CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS parent_id
  FROM turns WHERE role <> 'system')"""


@query(
    "scan_messages",
    f"""WITH {MESSAGES_SQL} SELECT msg_id, author_id, {S.strip('text')} AS text, parent_id,
    created IS NULL AS bad_time FROM messages""",
)
def scan_messages(spark, sf):
    path = scratch_path(spark, "messages-csv")
    messages(spark, sf).select(
        F.concat(F.lit(" "), F.col("msg_id")).alias("tweet_id"),
        "author_id",
        "text",
        "created_at",
        F.col("parent_id").alias("in_response_to_tweet_id"),
    ).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return readers.read_messages(spark, path).select(
        "msg_id", "author_id", "text", "parent_id", (F.col("created_at") == "soon").alias("bad_time")
    )


@query(
    "scan_jsonl_quarantine",
    """SELECT doc_id, CASE doc_id % 11 WHEN 4 THEN true ELSE false END AS quarantined,
       CASE doc_id % 11 WHEN 4 THEN NULL ELSE length(text) END AS chars
       FROM documents""",
)
def scan_jsonl_quarantine(spark, sf):
    path = scratch_path(spark, "cases-jsonl")
    # Each line starts with its id, so a broken line can be told apart.
    good = F.to_json(F.struct(F.col("doc_id").cast("string").alias("case_id"), F.col("text").alias("clean_text")))
    line = (
        F.when(F.col("doc_id") % 11 == 4, F.concat(F.lit("{"), F.col("doc_id").cast("string"), F.lit(", broken")))
        .otherwise(good)
    )
    # A blank line after every record.
    lines = F.explode(F.array(line, F.lit("   ")))
    table(spark, sf, "documents").select(lines.alias("value")).write.text(path)
    rows, bad = readers.read_cases(spark, path)
    return rows.select(
        F.col("case_id").cast("long").alias("doc_id"),
        F.lit(False).alias("quarantined"),
        F.length("clean_text").alias("chars"),
    ).unionByName(
        bad.select(
            F.regexp_extract("line", r"(\d+)", 1).cast("long").alias("doc_id"),
            F.lit(True).alias("quarantined"),
            F.lit(None).cast("int").alias("chars"),
        )
    )


@query(
    "vault_flatten",
    f"""WITH {REPLIES_SQL}, p AS (SELECT *, {sql_pick(R.TAXONOMY, 'case_id')} AS intent FROM replies)
    SELECT 'pair_' || case_id AS pair_id, conv_id::VARCHAR AS case_id, intent, customer_text AS customer_query,
           agent_text AS agent_reply FROM p""",
)
def vault_flatten(spark, sf):
    path = scratch_path(spark, "vault-json")
    pairs = replies(spark, sf).select(
        int_bucket(F.col("conv_id"), 16).alias("file"),
        pick(R.TAXONOMY, F.col("case_id")).alias("intent"),
        F.struct(
            F.concat(F.lit("pair_"), F.col("case_id")).alias("pair_id"),
            F.col("conv_id").cast("string").alias("case_id"),
            pick(R.TAXONOMY, F.col("case_id")).alias("intent"),
            F.col("customer_text").alias("customer_query"),
            F.col("agent_text").alias("apple_reply"),
        ).alias("pair"),
    )
    # One vault document per sixteen conversations, one document per line.
    lists = pairs.groupBy("file", "intent").agg(F.collect_list("pair").alias("pairs"))
    documents = lists.groupBy("file").agg(
        F.map_from_entries(F.collect_list(F.struct("intent", "pairs"))).alias("vault")
    )
    documents.select("vault").write.json(path)
    return readers.read_vault(spark, path, whole_file=False)


_RAW_INTENTS = ("battery_drain", " DEVICE_BOOT ", "nonsense", "UNKNOWN")


@query(
    "golden_flatten",
    f"""WITH g AS (SELECT doc_id, CASE WHEN doc_id % 13 = 5 THEN '  ' ELSE text END AS text,
                         upper(trim({sql_pick(_RAW_INTENTS, 'doc_id')})) AS intent FROM documents)
    SELECT doc_id::VARCHAR AS case_id, {S.strip('text')} AS text, intent FROM g
    WHERE {S.strip('text')} <> '' AND intent IN ({', '.join(quote(v) for v in R.TAXONOMY)})""",
)
def golden_flatten(spark, sf):
    path = scratch_path(spark, "golden-json")
    text = F.when(F.col("doc_id") % 13 == 5, "  ").otherwise(F.col("text"))
    cases = table(spark, sf, "documents").select(
        int_bucket(F.col("doc_id"), 16).alias("file"),
        F.struct(
            F.struct(F.col("doc_id").cast("string").alias("case_id"), text.alias("clean_text")).alias("case"),
            F.struct(pick(_RAW_INTENTS, F.col("doc_id")).alias("intent")).alias("expected"),
        ).alias("c"),
    )
    cases.groupBy("file").agg(F.collect_list("c").alias("cases")).select("cases").write.json(path)
    return readers.read_golden(spark, path, whole_file=False)


@query(
    "labeled_union",
    f"""WITH l AS (SELECT d.doc_id, {S.strip('text')} AS text, upper(trim({sql_pick(_RAW_INTENTS, 'd.doc_id')})) AS intent
                  FROM documents d JOIN labels USING (doc_id))
    SELECT sha256(text) AS text_hash, intent, list_position({sql_list(R.TAXONOMY)}, intent)::INT - 1 AS label
    FROM l WHERE text <> '' AND intent IN ({', '.join(quote(v) for v in R.TAXONOMY)})""",
)
def labeled_union(spark, sf):
    path = scratch_path(spark, "labeled-json")
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    intent = pick(_RAW_INTENTS, F.col("doc_id"))
    nested = F.col("doc_id") % 2 == 0
    rows.select(
        F.when(~nested, F.col("text")).alias("text"),
        F.when(~nested, intent).alias("intent"),
        F.when(nested, F.struct(F.col("text").alias("clean_text"))).alias("case"),
        F.when(nested, F.struct(intent.alias("intent"))).alias("expected"),
    ).write.json(path)
    raw = spark.read.schema(readers.LABELED).json(path)
    return readers.normalise_labeled(raw).select(
        F.sha2("text", 256).alias("text_hash"), "intent", "label"
    )


@query(
    "vault_metadata",
    f"""WITH {REPLIES_SQL}, p AS (SELECT {sql_pick(R.TAXONOMY, 'case_id')} AS intent FROM replies)
    SELECT (SELECT count(*) FROM p) AS total_pairs, intent, count(*) AS pairs FROM p GROUP BY intent""",
)
def vault_metadata(spark, sf):
    path = scratch_path(spark, "vault-tables")
    vault = replies(spark, sf).select("case_id", pick(R.TAXONOMY, F.col("case_id")).alias("intent"))
    writers.write_vault(vault, path, "conversations")
    stored = spark.read.schema(
        "source string, total_pairs long, counts_by_intent map<string, long>"
    ).json(f"{path}/metadata")
    return stored.select("total_pairs", F.explode("counts_by_intent").alias("intent", "pairs"))


@query(
    "case_sink",
    f"WITH {REQUESTS_SQL} SELECT count(*) AS written, sum(length(text))::BIGINT AS chars FROM requests",
)
def case_sink(spark, sf):
    path = scratch_path(spark, "case-sink")
    written = writers.write_counted(requests(spark, sf).select("request_id", "text"), path)
    stored = spark.read.parquet(path)
    return stored.agg(F.lit(written).alias("written"), F.sum(F.length("text")).alias("chars"))


@query(
    "expand_union",
    """SELECT sha256(text) AS text_hash, 'en' AS intent, 'golden' AS source FROM benchmark
    UNION ALL SELECT sha256(text), lang, 'gpu_high_conf' FROM documents
    UNION ALL SELECT sha256(text), role, 'llm_verified' FROM conversations""",
)
def expand_union(spark, sf):
    return tagged_union(
        golden=table(spark, sf, "benchmark").select("text", F.lit("en").alias("intent")),
        gpu_high_conf=table(spark, sf, "documents").select("text", F.col("lang").alias("intent")),
        llm_verified=table(spark, sf, "conversations").select("text", F.col("role").alias("intent")),
    ).select(F.sha2("text", 256).alias("text_hash"), "intent", "source")


@query(
    "array_table",
    """SELECT doc_id, lang, CASE WHEN doc_id % 7 <> 3 THEN source END AS source, text, length(text)::INT AS chars
    FROM documents""",
)
def array_table(spark, sf):
    """A held-out split as files of one JSON array each, read back whole."""
    path = scratch_path(spark, "split-json")
    source = F.when(F.col("doc_id") % 7 != 3, F.col("source")).alias("source")
    writers.write_array(table(spark, sf, "documents").select("doc_id", "lang", source, "text"), path, 2000)
    back = readers.read_table(spark, path, "doc_id long, lang string, source string, text string")
    return back.withColumn("chars", F.length("text"))


@query(
    "intent_counts",
    "SELECT lang, count(*) AS n FROM documents GROUP BY ROLLUP (lang)",
)
def intent_counts(spark, sf):
    return M.counts_with_total(table(spark, sf, "documents"), "lang")
