"""Scans of the record shapes the engine works on. Schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom.functions.rules import TAXONOMY
from deskloom.functions.text import strip

MESSAGES = (
    "tweet_id string, author_id string, text string, created_at string, "
    "in_response_to_tweet_id string"
)
TURN = "struct<tweet_id: string, author_id: string, text: string, created_at: string>"
CASES = (
    f"case_id string, customer_id string, channel string, raw_turns array<{TURN}>, "
    "clean_text string, locale string, account_tier string, timestamp string"
)
PAIR = (
    "struct<pair_id: string, case_id: string, intent: string, customer_query: string, "
    "apple_reply: string>"
)
VAULT = (
    "metadata struct<source: string, total_pairs: long, max_per_intent: long, "
    f"counts_by_intent: map<string, long>>, vault map<string, array<{PAIR}>>"
)
GOLDEN = (
    "cases array<struct<case: struct<case_id: string, clean_text: string>, "
    "expected: struct<intent: string, mode: string, reason: string>, "
    "acceptable_evidence_ids: array<string>, reference_answer: string, "
    "review_status: string>>"
)
LABELED = (
    "text string, label int, intent string, source string, "
    "case struct<clean_text: string>, expected struct<intent: string>"
)
RATINGS = (
    "case_id string, model_type string, intent string, customer_tweet string, "
    "generated_reply string, human_overall_score int, human_diagnostic_probe int, "
    "human_privacy_pivot int, human_zero_liability int, human_rationale string"
)


def read_messages(spark: SparkSession, path: str, quoted_newlines: bool = True) -> DataFrame:
    """Message graph from CSV: trimmed ids, empty ids as NULL.

    A file with newlines inside quotes can't be split, so it is one task; give many files, or
    say ``quoted_newlines=False`` where texts have none.

    One pass; both the edges and the texts come from the same scan.
    """
    raw = (
        spark.read.schema(MESSAGES)
        .option("header", True)
        .option("multiLine", quoted_newlines)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )

    def key(name: str) -> Column:
        return F.nullif(F.trim(F.col(name)), F.lit(""))

    return raw.select(
        key("tweet_id").alias("msg_id"),
        F.trim("author_id").alias("author_id"),
        strip(F.coalesce("text", F.lit(""))).alias("text"),
        "created_at",
        key("in_response_to_tweet_id").alias("parent_id"),
    )


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined lines) of a JSON-lines file.

    Blank lines are dropped; a line that is not valid JSON for the schema is set aside.
    """
    lines = spark.read.text(path).filter(strip(F.col("value")) != "")
    parsed = lines.select(
        "value",
        F.from_json(
            "value",
            f"{schema}, _corrupt_record string",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
        ).alias("r"),
    )
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    good = parsed.filter(~bad).select("r.*").drop("_corrupt_record")
    return good, parsed.filter(bad).select(F.col("value").alias("line"))


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, quarantined lines) of a case file."""
    return read_jsonl(spark, path, CASES)


def read_vault(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """Flat pairs from vault documents ``{vault: {intent: [pair, ...]}}``.

    ``whole_file`` reads one pretty-printed document per file; otherwise one per line.
    """
    documents = spark.read.schema(VAULT).option("multiLine", whole_file).json(path)
    return (
        documents.select(F.explode("vault").alias("partition", "pairs"))
        .select("partition", F.inline("pairs"))
        .select(
            "pair_id",
            "case_id",
            F.col("partition").alias("intent"),
            "customer_query",
            F.col("apple_reply").alias("agent_reply"),
        )
    )


def read_golden(
    spark: SparkSession,
    path: str,
    labels: Sequence[str] = TAXONOMY,
    whole_file: bool = True,
) -> DataFrame:
    """(case_id, text, intent) of golden cases with a text and a listed intent."""
    documents = spark.read.schema(GOLDEN).option("multiLine", whole_file).json(path)
    cases = documents.select(F.explode("cases").alias("c")).select(
        F.col("c.case.case_id").alias("case_id"),
        strip(F.col("c.case.clean_text")).alias("text"),
        F.upper(strip(F.col("c.expected.intent"))).alias("intent"),
    )
    return cases.filter((F.col("text") != "") & F.col("intent").isin(*labels))


def normalise_labeled(df: DataFrame, labels: Sequence[str] = TAXONOMY) -> DataFrame:
    """(text, intent, label) from flat or nested labelled rows; invalid rows go.

    ``df`` has the ``LABELED`` columns; a row with ``case`` is nested.
    """
    nested = F.col("case").isNotNull()
    text = strip(F.when(nested, F.col("case.clean_text")).otherwise(F.col("text")))
    intent = F.upper(strip(F.when(nested, F.col("expected.intent")).otherwise(F.col("intent"))))
    ids = F.create_map(*[F.lit(v) for i, name in enumerate(labels) for v in (name, i)])
    return (
        df.select(text.alias("text"), intent.alias("intent"))
        .filter((F.col("text") != "") & F.col("intent").isin(*labels))
        .withColumn("label", F.try_element_at(ids, F.col("intent")))
    )


def read_labeled(
    spark: SparkSession,
    path: str,
    labels: Sequence[str] = TAXONOMY,
    fallback: str | None = None,
) -> DataFrame:
    """Labelled set from a JSON array (or a golden set if ``path`` does not exist)."""
    if fallback is not None and not _exists(spark, path):
        return normalise_labeled(
            read_golden(spark, fallback, labels).selectExpr(
                "text", "intent",
                "cast(null as struct<clean_text: string>) as case",
                "cast(null as struct<intent: string>) as expected",
            ),
            labels,
        )
    rows = spark.read.schema(LABELED).option("multiLine", True).json(path)
    return normalise_labeled(rows, labels)


def read_table(spark: SparkSession, path: str, schema: str, whole_file: bool = True) -> DataFrame:
    """Flat table from a JSON array file (held-out split, human ratings)."""
    return spark.read.schema(schema).option("multiLine", whole_file).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
