"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom.llm import (
    decontaminate,
    infill,
    jaccard,
    licenses,
    mixing,
    quality,
    simhash,
    substring,
    tokens,
    toxicity,
    turns,
    twins,
    urls,
    warc,
)
from deskloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY, END_ID = "word_bpe_49k.json", 2
RULES = [
    urls.parse_rule(*rule)
    for rule in (
        ("block", "net/"),
        ("allow", "example.net/en/"),
        ("block", "example.com/de/"),
        ("allow", "org/fr/"),
    )
]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_warc", twins.OP1)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived and read back."""
    read = warc.archived(table(spark, sf_dir, "pages"))
    return read.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return quality.judged(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op6_url_filter", twins.op6(RULES))
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return urls.judge(table(spark, sf_dir, "pages"), RULES, ["page_id"]).select(
        "row.page_id", "host", "path", "rule", "verdict"
    )


@query("op7_tokens")
def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document tokenized, written as sequences and listed from the files."""
    return tokens.tokenized(table(spark, sf_dir, "documents"), vocabulary(), END_ID)


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@query("op10_decontaminate", twins.OP10)
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark matches of every document."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    counted = found.select(
        "row.doc_id",
        "n_words",
        decontaminate.hit_words(F.col("matches")).alias("n_hit"),
        decontaminate.hit_items(F.col("matches")).alias("items"),
    )
    return counted.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


@query("op3_substring_dedup", twins.OP3)
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated windows."""
    untouched, affected = substring.deduplicated(table(spark, sf_dir, "documents"))
    nothing = F.lit(0).cast("long").alias("n_removed")
    return untouched.select("doc_id", "n_words", nothing, F.col("digest").alias("kept_sha256")).unionByName(
        affected.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
    )


@query("op4_licenses", twins.op4())
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template matches of every document."""
    found = licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    word = F.transform("places", lambda p: p["word"])
    base, more = F.transform("places", lambda p: p["label"]), F.transform("found", lambda p: p["label"])
    best = F.array_max(F.transform("found", lambda p: p["share"]))
    return found.select(
        "row.doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, ["doc_id"]).select(
        "row.doc_id",
        F.coalesce(toxicity.fold(F.col("row.doc_id")) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


#: Domains of the labelled table and the wanted shares of tokens.
DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' WHEN quality = 1 THEN 'clean' END"
WEIGHTS, ANCHOR = {"clean": 0.95, "poor": 0.04, "toxic": 0.01}, "clean"


@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, domain posteriors, rate and copies of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows, classifier = mixing.mixed(docs, labels, F.expr(DOMAIN), WEIGHTS, ["doc_id"], anchor=ANCHOR)
    p = [F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(classifier.domains)]
    times = mixing.copies(F.col("rate"), F.col("row.doc_id")).alias("copies")
    return rows.select("row.doc_id", "n_tokens", *p, "rate", times)


@query("op11_infill", twins.OP11)
def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its form for filling in the middle, and restored from it."""
    made = infill.transform(table(spark, sf_dir, "documents"), ["doc_id"])
    return made.select(
        "row.doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@query("op12_jaccard", twins.OP12)
def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by shingle sets."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op13_turns", twins.OP13)
def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged, its faults counted, and repaired at least cost."""
    whole = table(spark, sf_dir, "conversations")
    made = turns.repair(turns.damaged(whole))
    ids = whole.select("conv_id").distinct()
    counts = [c for c in made.conversations.columns if c not in ("conv_id", "n_rows", "audit")]

    def left(df: DataFrame, other: DataFrame) -> DataFrame:
        own = other.withColumnRenamed("conv_id", "own_id")
        return df.join(own, F.col("conv_id").eqNullSafe(F.col("own_id")), "left").drop("own_id")

    return left(left(ids, made.conversations), turns.digests(made.turns)).select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
