"""TF-IDF statistics, lexical and dense similarity search."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskloom.catalog import sqltext as S
from deskloom.catalog.base import LANGUAGE_CUES, query, quote, table, texts
from deskloom.catalog.rule_queries import _CASES_SQL, _cases
from deskloom.functions import routing as RT
from deskloom.functions.intents import classify_by_cues
from deskloom.functions.rules import DENSE_ZONES, STOP_WORDS
from deskloom.operators import cells as C
from deskloom.operators import vectors as V
from deskloom.session import materialize

_STOPS = ", ".join(quote(w) for w in STOP_WORDS)
TOKEN = quote(V.TOKEN)


def terms_sql(name: str, relation: str) -> str:
    """CTE ``name`` (item, grp, term, tf) of ``relation`` (item, grp, text)."""
    return (
        f"{name}_tok AS MATERIALIZED (SELECT item, grp, tok, lead(tok) OVER (PARTITION BY item, grp ORDER BY pos) AS nxt "
        f"FROM (SELECT item, grp, unnest(t) AS tok, generate_subscripts(t, 1) AS pos "
        f"FROM (SELECT item, grp, regexp_extract_all(lower(text), {TOKEN}) AS t FROM {relation})) "
        f"WHERE tok NOT IN ({_STOPS})), "
        f"{name} AS MATERIALIZED (SELECT item, grp, term, count(*) AS tf FROM ("
        f"SELECT item, grp, tok AS term FROM {name}_tok UNION ALL "
        f"SELECT item, grp, tok || ' ' || nxt FROM {name}_tok WHERE nxt IS NOT NULL) GROUP BY ALL)"
    )


def index_sql(relation: str) -> str:
    """CTEs idx_terms, idx_n, idx_idf, idx_w over ``relation`` (item, grp, text)."""
    return (
        terms_sql("idx_terms", relation)
        + f", idx_n AS MATERIALIZED (SELECT grp, count(*) AS n FROM {relation} GROUP BY grp), "
        "idx_idf AS MATERIALIZED (SELECT grp, term, count(*) AS df, any_value(n) AS n, "
        "ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM idx_terms JOIN idx_n USING (grp) GROUP BY grp, term), "
        + weights_sql("idx_w", "idx_terms")
    )


def weights_sql(name: str, terms: str) -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT item, grp, term, w / sqrt(sum(w * w) OVER (PARTITION BY item, grp)) AS w FROM ("
        f"SELECT t.item, t.grp, t.term, (1 + ln(tf)) * idf AS w FROM {terms} t JOIN idx_idf USING (grp, term)))"
    )


def match_sql(items: str, queries: str, k: int, name: str = "matches") -> str:
    """CTE ``name`` (query, grp, item, score, rank) of ``queries`` (item, grp, text)."""
    return (
        terms_sql("q_terms", queries)
        + ", "
        + weights_sql("q_w", "q_terms")
        + f""", {name}_s AS MATERIALIZED (SELECT q.item AS query, q.grp, d.item, round(sum(q.w * d.w), 4) AS score
      FROM q_w q JOIN idx_w d USING (grp, term) GROUP BY ALL),
    {name}_pad AS (SELECT grp, item FROM (SELECT grp, item, row_number() OVER (PARTITION BY grp ORDER BY item) AS rn
      FROM {items}) WHERE rn <= {k}),
    {name}_all AS (SELECT query, grp, item, max(score) AS score FROM (
      SELECT query, grp, item, score FROM {name}_s UNION ALL
      SELECT q.item, q.grp, p.item, 0.0 FROM {queries} q JOIN {name}_pad p USING (grp)) GROUP BY ALL),
    {name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query, grp ORDER BY score DESC, item) AS rank
      FROM {name}_all QUALIFY rank <= {k})"""
    )


@query(
    "tfidf_df",
    "WITH items AS (SELECT doc_id AS item, lang AS grp, text FROM documents), "
    + index_sql("items")
    + " SELECT grp, term, df, n, round(idf, 6) AS idf FROM idx_idf",
)
def tfidf_df(spark, sf):
    docs = texts(spark, sf, "documents")
    terms = V.document_frequencies(docs, "doc_id", "lang", "text", STOP_WORDS)
    sizes = docs.groupBy(F.col("lang").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return V.idf_table(terms, sizes).withColumn("idf", F.round("idf", 6))


_PAIR_ITEMS = f"WITH {_CASES_SQL}, items AS (SELECT case_id AS item, intent AS grp, customer_text AS text FROM cases), "


@query(
    "tfidf_weights",
    _PAIR_ITEMS + index_sql("items") + " SELECT item, grp, term, round(w, 6) AS w FROM idx_w",
)
def tfidf_weights(spark, sf):
    pairs = materialize(_cases(spark, sf).select("case_id", "intent", "customer_text"), "pairs")
    index = V.build_index(pairs, "case_id", "intent", "customer_text")
    return index.postings.withColumn("w", F.round("w", 6))


# Every answered question against all others of its intent.
@query(
    "similar_pairs",
    _PAIR_ITEMS
    + index_sql("items")
    + ", "
    + match_sql("items", "items", 3)
    + " SELECT query, grp, item, score, rank FROM matches",
)
def similar_pairs(spark, sf):
    pairs = materialize(_cases(spark, sf).select("case_id", "intent", "customer_text"), "pairs")
    index = V.build_index(pairs, "case_id", "intent", "customer_text")
    return V.lexical_matches(
        pairs, index, "case_id", "intent", "customer_text", vectors=index.vectors
    )


_PASSAGES = f"""cued AS {S.cue_columns('benchmark', 'item_id', 'text', LANGUAGE_CUES, 'en')},
passages AS (SELECT b.item_id AS item, c.intent AS grp, b.text FROM benchmark b JOIN cued c USING (item_id))"""


@query(
    "topk_matches",
    f"WITH {_PASSAGES}, items AS (SELECT doc_id AS item, lang AS grp, text FROM documents), "
    + index_sql("items")
    + ", "
    + match_sql("items", "passages", 3)
    + f" SELECT query, grp, item, score, rank, {S.zone('score')} AS zone FROM matches",
)
def topk_matches(spark, sf):
    docs = texts(spark, sf, "documents").select("doc_id", "lang", "text")
    guess = classify_by_cues(F.col("text"), LANGUAGE_CUES, "en")["intent"]
    passages = table(spark, sf, "benchmark").select("item_id", "text", guess.alias("lang"))
    asked = V.explode_terms(passages, "item_id", "lang", "text", STOP_WORDS).select("grp", "term")
    index = V.build_index(docs, "doc_id", "lang", "text", wanted=asked)
    found = V.lexical_matches(passages, index, "item_id", "lang", "text")
    return found.withColumn("zone", RT.zone(F.col("score")))


@query(
    "dense_topk",
    f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT a.vec_id AS query, a.label AS grp, b.vec_id AS item,
                 round(list_cosine_similarity(a.e, b.e), 4) AS score
          FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id)
    SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank,
           {S.zone('score', 0.75, 0.55)} AS zone FROM s QUALIFY rank <= 3""",
)
def dense_topk(spark, sf):
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec")
    )
    found = V.dense_matches(vectors, vectors, "label", 3, skip_same_id=True)
    return found.withColumn("zone", RT.zone(F.col("score"), DENSE_ZONES))


def _asked_and_all(spark, sf):
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.lit(0).alias("label"), F.col("embedding").alias("vec")
    )
    return vectors.filter("id % 50 = 0"), vectors


@query("dense_cells")
def dense_cells(spark, sf):
    """Every 50th vector against all, through the coarse cells."""
    asked, vectors = _asked_and_all(spark, sf)
    found = C.cell_matches(asked, C.build_cells(vectors, "label"), "label", 3, skip_same_id=True)
    return found.select("query", "item", "score", "rank", RT.zone(F.col("score"), DENSE_ZONES).alias("zone"))


# The search through cells finds nine of ten of the exact best three.
@query(
    "dense_cells_recall",
    """WITH q AS (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0), n AS (SELECT count(*) AS n FROM embeddings)
    SELECT count(*) AS queries, sum(least(3, n - 1))::BIGINT AS wanted, true AS reached FROM q, n""",
)
def dense_cells_recall(spark, sf):
    asked, vectors = _asked_and_all(spark, sf)
    found = C.cell_matches(asked, C.build_cells(vectors, "label"), "label", 3, skip_same_id=True)
    exact = V.dense_matches(asked, vectors, "label", 3, skip_same_id=True)
    rated = C.recall(found, exact)
    return rated.crossJoin(asked.agg(F.count(F.lit(1)).alias("queries"))).select(  # one row each
        "queries", "wanted", (F.col("hits") >= 0.9 * F.col("wanted")).alias("reached")
    )
