"""Corpus pipeline: documents in, token sequences out.

Every stage takes the rows that its predecessor kept, whole texts and all columns, also extra ones
whatever their names, and all but the last give the same columns back. Null and wordless texts
fail the quality rule; given to a later stage they are rows like others. Repeated rows have one
fingerprint, so the second stage leaves one of them. Null ids and columns are values like others.
An empty table gives an empty table at every stage, an empty benchmark or label table removes and
moves nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom.llm import decontaminate, mixing, quality, simhash, tokens
from deskloom.llm.common import prepare, table, written
from deskloom.llm.queries import ANCHOR, DOMAIN, END_ID, WEIGHTS, vocabulary

#: Bytes of text that a worker holds in the stages whose words are many small objects.
BATCH = 6 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their group's fences. Nulls in lang or source are a
    group; null texts go; copies are judged alike; no documents, no fences and no rows."""
    prepare(spark)
    return quality.filter_quality(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that with the least id, null ids last; of
    repeated rows one. Null and wordless texts are one component."""
    prepare(spark, BATCH)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark contamination. Null texts on either side hold no window;
    repeated rows stay or go together; without items all stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rate says, at most ``mixing.MOST`` times. Texts without
    tokens have a rate like others; copies of a row have the same; without labels all stay once."""
    labels = table(spark, sf_dir, "labels")
    return mixing.resampled(docs, labels, F.expr(DOMAIN), WEIGHTS, anchor=ANCHOR)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, listed per document from the written files in order of the id, null ids
    first; a null text is its end id; rows that stage four repeats are listed as often."""
    prepare(spark, BATCH)
    return tokens.tokenized(docs, vocabulary(), END_ID)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("mix_to_targets", mix_to_targets),
    ("token_output", token_output),
]

#: No SQL: fingerprints, the tokenizer and fitted rates have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
