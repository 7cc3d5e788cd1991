"""Metrics over rule predictions: languages by cues, and replies by the rule judge."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskloom.catalog import sqltext as S
from deskloom.catalog.base import LANGUAGES, LANGUAGE_CUES, pick, query, quote, replies, sql_list, sql_pick, table, texts
from deskloom.catalog.rule_queries import _CASES_SQL, _JUDGE, _cases
from deskloom.functions.intents import classify_by_cues
from deskloom.operators import metrics as M
from deskloom.operators.sampling import stratified_folds
from deskloom.plans import evaluate as E

PREDICTED_SQL = f"""cued AS {S.cue_columns('documents', 'doc_id', 'text', LANGUAGE_CUES, 'none')},
predicted AS (SELECT d.doc_id, d.source, d.lang AS actual, c.intent AS predicted
              FROM documents d JOIN cued c USING (doc_id))"""


def predicted(spark, sf):
    """(doc_id, source, actual, predicted): language of each document, told by cues."""
    guess = classify_by_cues(F.col("text"), LANGUAGE_CUES, "none")["intent"]
    return texts(spark, sf, "documents").select(
        "doc_id", "source", F.col("lang").alias("actual"), guess.alias("predicted")
    )


def _report_sql(by: str = "", relation: str = "predicted", labels=None, digits: int | None = 4) -> str:
    """CTEs ``sides`` and ``report`` over (by, actual, predicted)."""
    g = f"{by}, " if by else ""
    cut = (lambda x: f"round({x}, {digits})") if digits is not None else (lambda x: x)
    source = "sides"
    extra = ""
    if labels is not None:
        wanted = ", ".join(f"({quote(v)})" for v in labels)
        groups = f"(SELECT DISTINCT {by} FROM {relation})" if by else "(SELECT 1)"
        extra = (
            f", wanted AS (SELECT {g}label FROM {groups} g, (VALUES {wanted}) w(label)), "
            f"full_sides AS (SELECT {g}label, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, "
            f"coalesce(hits, 0) AS hits FROM wanted LEFT JOIN sides USING ({g}label))"
        )
        source = "full_sides"
    return (
        f"sides AS (SELECT {g}label, sum(s)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(h)::BIGINT AS hits FROM ("
        f"SELECT {g}actual AS label, 1 AS s, 0 AS p, (actual = predicted)::INT AS h FROM {relation} UNION ALL "
        f"SELECT {g}predicted, 0, 1, 0 FROM {relation}) GROUP BY ALL){extra}, "
        f"report AS (SELECT {g}label, {cut('CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END')}::DOUBLE AS precision, "
        f"{cut('CASE WHEN support = 0 THEN 0 ELSE hits / support END')}::DOUBLE AS recall, "
        f"{cut('CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hits / (support + predicted) END')}::DOUBLE AS f1, "
        f"support FROM {source})"
    )


def _macro_sql(by: str = "", digits: int | None = 4) -> str:
    cut = (lambda x: f"round({x}, {digits})") if digits is not None else (lambda x: x)
    g = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return (
        f"SELECT {g}{cut('sum(recall * support) / sum(support)')} AS accuracy, "
        f"{cut('avg(precision)')} AS macro_precision, {cut('avg(recall)')} AS macro_recall, "
        f"{cut('avg(f1)')} AS macro_f1, {cut('sum(f1 * support) / sum(support)')} AS weighted_f1 FROM report{tail}"
    )


@query(
    "majority_class",
    """SELECT source AS majority, n, round(n / (SELECT count(*) FROM documents), 4) AS share
    FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) ORDER BY n DESC, source LIMIT 1""",
)
def majority_class(spark, sf):
    return M.majority_class(table(spark, sf, "documents"), "source")


@query(
    "majority_predict",
    """WITH top AS (SELECT lang FROM documents GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)
    SELECT doc_id, (SELECT lang FROM top) AS predicted, 0.345::DOUBLE AS confidence FROM documents""",
)
def majority_predict(spark, sf):
    from deskloom.operators.learners import majority_predict as predict

    return predict(table(spark, sf, "documents").select("doc_id", "lang"), "lang").drop("lang")


@query(
    "accuracy",
    f"WITH {PREDICTED_SQL} SELECT round(avg((actual = predicted)::INT), 4) AS accuracy, count(*) AS n FROM predicted",
)
def accuracy(spark, sf):
    return M.accuracy(predicted(spark, sf), "actual", "predicted")


@query(
    "class_report",
    f"WITH {PREDICTED_SQL}, {_report_sql(labels=(*LANGUAGES, 'it'))} SELECT * FROM report",
)
def class_report(spark, sf):
    return M.class_report(predicted(spark, sf), "actual", "predicted", (*LANGUAGES, "it"))


@query("macro_metrics", f"WITH {PREDICTED_SQL}, {_report_sql(digits=None)} {_macro_sql()}")
def macro_metrics(spark, sf):
    return M.macro_metrics(predicted(spark, sf), "actual", "predicted")


_COLUMNS = (*LANGUAGES, "none")


@query(
    "confusion_matrix",
    f"WITH {PREDICTED_SQL} SELECT l.actual, "
    + ", ".join(f"count(*) FILTER (predicted = {quote(c)}) AS {c}" for c in _COLUMNS)
    + f" FROM (SELECT unnest({sql_list(_COLUMNS)}) AS actual) l LEFT JOIN predicted p ON l.actual = p.actual GROUP BY l.actual",
)
def confusion_matrix(spark, sf):
    return M.confusion_matrix(predicted(spark, sf), "actual", "predicted", _COLUMNS)


@query(
    "heldout_eval",
    f"""WITH {PREDICTED_SQL}, {_report_sql(labels=LANGUAGES)}
    SELECT label, precision, recall, f1, support, """
    + ", ".join(
        f"(SELECT count(*) FROM predicted p WHERE p.actual = label AND p.predicted = {quote(c)}) AS as_{c}"
        for c in LANGUAGES
    )
    + " FROM report",
)
def heldout_eval(spark, sf):
    report, matrix, _ = E.heldout_report(predicted(spark, sf), LANGUAGES)
    named = matrix.select(
        F.col("actual").alias("label"), *[F.col(c).alias(f"as_{c}") for c in LANGUAGES]
    )
    return report.join(named, "label", "left").na.fill(0, [f"as_{c}" for c in LANGUAGES])


@query(
    "latency_by_type",
    """SELECT event_type, count(*) AS items, round(avg(value), 3) AS mean_ms,
    round(count(*) / (sum(value) / 1000.0), 1) AS items_per_sec,
    round(quantile_cont(value, 0.95), 3) AS p95_ms FROM events GROUP BY event_type""",
)
def latency_by_type(spark, sf):
    return M.latency_stats(table(spark, sf, "events"), "value", ["event_type"])


@query(
    "latency_stats",
    """SELECT count(*) AS items, round(avg(value), 3) AS mean_ms,
    round(count(*) / (sum(value) / 1000.0), 1) AS items_per_sec,
    round(quantile_cont(value, 0.95), 3) AS p95_ms FROM events""",
)
def latency_stats(spark, sf):
    return M.latency_stats(table(spark, sf, "events"), "value")


TIERS = E.TIERS

RATINGS_SQL = f"""{_CASES_SQL}, ratings AS (
  SELECT case_id, {sql_pick((*TIERS, 'retired'), 'conv_id')} AS model_type,
         1 + CAST((case_id * 7 + conv_id) % 5 AS INT) AS human, {S.select_columns(_JUDGE)} FROM cases)"""


def judged(spark, sf):
    """Answered turns rated by a derived human score and by the rule judge."""
    ratings = _cases(spark, sf).select(
        "case_id",
        pick((*TIERS, "retired"), F.col("conv_id")).alias("model_type"),
        "intent",
        F.col("customer_text").alias("customer_tweet"),
        F.col("agent_text").alias("generated_reply"),
        (1 + (F.col("case_id") * 7 + F.col("conv_id")) % 5).cast("int").alias("human_overall_score"),
    )
    return E.judge_ratings(ratings)


@query(
    "agreement_rates",
    f"""WITH {RATINGS_SQL} SELECT round(avg((human = overall_score)::INT) * 100, 2) AS exact_pct,
    round(avg((abs(human - overall_score) <= 1)::INT) * 100, 2) AS tolerance_1_pct, count(*) AS n FROM ratings""",
)
def agreement_rates(spark, sf):
    return M.agreement_rates(judged(spark, sf), "human_overall_score", "judge_score")


# Written the long way: observed and expected matrices over the labels seen.
_KAPPA_SQL = """k_pairs AS (SELECT human AS a, overall_score AS b, count(*) AS n FROM ratings GROUP BY ALL),
k_labels AS (SELECT l, row_number() OVER (ORDER BY l) - 1 AS i FROM (SELECT a AS l FROM k_pairs UNION SELECT b FROM k_pairs)),
k_cells AS (SELECT x.i AS i, y.i AS j,
   coalesce((SELECT n FROM k_pairs WHERE a = x.l AND b = y.l), 0) AS o,
   coalesce((SELECT sum(n) FROM k_pairs WHERE a = x.l), 0) * coalesce((SELECT sum(n) FROM k_pairs WHERE b = y.l), 0)
     / (SELECT sum(n) FROM k_pairs) AS e FROM k_labels x, k_labels y),
kappa AS (SELECT round(1 - sum((i - j) * (i - j) * o) / sum((i - j) * (i - j) * e), 4) AS quadratic_kappa,
   round(1 - sum(abs(i - j) * o) / sum(abs(i - j) * e), 4) AS linear_kappa, sum(o)::BIGINT AS n FROM k_cells)"""


@query("weighted_kappa", f"WITH {RATINGS_SQL}, {_KAPPA_SQL} SELECT * FROM kappa")
def weighted_kappa(spark, sf):
    return M.weighted_kappa(judged(spark, sf), "human_overall_score", "judge_score")


_RHO_SQL = """r_ranks AS (SELECT rank() OVER (ORDER BY human) + (count(*) OVER (PARTITION BY human) - 1) / 2 AS x,
   rank() OVER (ORDER BY overall_score) + (count(*) OVER (PARTITION BY overall_score) - 1) / 2 AS y FROM ratings),
rho AS (SELECT corr(x, y) AS rho, count(*) AS n FROM r_ranks)"""


@query(
    "spearman",
    f"""WITH {RATINGS_SQL}, {_RHO_SQL}
    SELECT round(rho, 4) AS rho, round(rho * sqrt((n - 2) / (1 - rho * rho)), 4) AS t, n FROM rho""",
)
def spearman(spark, sf):
    return M.spearman(judged(spark, sf), "human_overall_score", "judge_score")


@query(
    "spearman_values",
    """WITH e AS (SELECT value AS a, CAST(event_id % 1000 AS DOUBLE) AS b FROM events),
    r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS x,
                 rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS y FROM e),
    c AS (SELECT corr(x, y) AS rho, count(*) AS n FROM r)
    SELECT round(rho, 4) AS rho, round(rho * sqrt((n - 2) / (1 - rho * rho)), 4) AS t, n FROM c""",
)
def spearman_values(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("value").alias("a"), (F.col("event_id") % 1000).cast("double").alias("b")
    )
    return M.spearman(events, "a", "b")


@query(
    "constraint_rates",
    f"""WITH {RATINGS_SQL} SELECT round(avg(length_compliant::INT) * 100, 1) AS length_compliant_pct,
    round(avg(has_dm_link::INT) * 100, 1) AS has_dm_link_pct,
    round(avg(zero_liability_compliant::INT) * 100, 1) AS zero_liability_compliant_pct FROM ratings""",
)
def constraint_rates(spark, sf):
    return M.pass_rates(judged(spark, sf), ["length_compliant", "has_dm_link", "zero_liability_compliant"])


@query(
    "tier_summary",
    f"""WITH {RATINGS_SQL}, t AS (SELECT unnest([{', '.join(map(quote, (*TIERS, 'empty_tier')))}]) AS tier),
    s AS (SELECT model_type AS tier, count(*) AS cases, avg(human) AS h, avg(overall_score) AS j FROM ratings GROUP BY 1)
    SELECT tier, coalesce(cases, 0) AS cases, round(coalesce(h, 0), 2) AS human_mean,
           round(coalesce(j, 0), 2) AS judge_mean, round(coalesce(j, 0) - coalesce(h, 0), 2) AS mean_delta
    FROM t LEFT JOIN s USING (tier)""",
)
def tier_summary(spark, sf):
    return M.tier_summary(
        judged(spark, sf), "model_type", "human_overall_score", "judge_score", (*TIERS, "empty_tier")
    )


@query(
    "top_disagreements",
    f"""WITH {RATINGS_SQL} SELECT case_id, overall_score - human AS score_diff FROM ratings
    WHERE overall_score <> human ORDER BY abs(overall_score - human) DESC, case_id LIMIT 3""",
)
def top_disagreements(spark, sf):
    return M.top_disagreements(judged(spark, sf), "human_overall_score", "judge_score", "case_id").select(
        "case_id", "score_diff"
    )


@query(
    "agreement_study",
    f"""WITH {RATINGS_SQL}, {_KAPPA_SQL}, {_RHO_SQL},
    a AS (SELECT round(avg((human = overall_score)::INT) * 100, 2) AS exact_pct,
          round(avg((abs(human - overall_score) <= 1)::INT) * 100, 2) AS tolerance_1_pct, count(*) AS n,
          round(avg(length_compliant::INT) * 100, 1) AS l, round(avg(has_dm_link::INT) * 100, 1) AS d,
          round(avg(zero_liability_compliant::INT) * 100, 1) AS z FROM ratings)
    SELECT 'exact_pct' AS metric, exact_pct::DOUBLE AS value FROM a
    UNION ALL SELECT 'tolerance_1_pct', tolerance_1_pct FROM a UNION ALL SELECT 'n', n FROM a
    UNION ALL SELECT 'quadratic_kappa', quadratic_kappa FROM kappa
    UNION ALL SELECT 'linear_kappa', linear_kappa FROM kappa
    UNION ALL SELECT 'rho', round(rho, 4) FROM rho
    UNION ALL SELECT 'length_compliant_pct', l FROM a UNION ALL SELECT 'has_dm_link_pct', d FROM a
    UNION ALL SELECT 'zero_liability_compliant_pct', z FROM a""",
)
def agreement_study(spark, sf):
    return E.agreement_study(judged(spark, sf))


@query(
    "all_pass",
    f"""WITH {PREDICTED_SQL} SELECT bool_and(actual = predicted) AS all_pass,
    count(*) FILTER (actual = predicted) AS passed, count(*) AS n FROM predicted""",
)
def all_pass(spark, sf):
    return M.all_pass(predicted(spark, sf), F.col("actual") == F.col("predicted"))


@query(
    "expectation_rows",
    f"""WITH {PREDICTED_SQL}, f AS (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source)
    SELECT p.source, p.actual AS expected, p.predicted, CASE WHEN actual = predicted THEN 'PASS' ELSE 'FAIL' END AS status
    FROM predicted p JOIN f USING (doc_id)""",
)
def expectation_rows(spark, sf):
    first = E.first_examples(predicted(spark, sf), "source", "actual", "doc_id").select("doc_id")
    rows = predicted(spark, sf).join(first, "doc_id", "left_semi").withColumnRenamed("actual", "expected")
    return E.expectation_check(rows).select("source", "expected", "predicted", "status")


@query(
    "cv_summary",
    f"""WITH {PREDICTED_SQL}, dealt AS (
      SELECT *, (row_number() OVER (PARTITION BY actual ORDER BY md5('42:' || doc_id)) - 1) % 5 AS fold FROM predicted),
    present AS (WITH {_report_sql('fold', 'dealt', digits=None)} SELECT * FROM report),
    listed AS (WITH {_report_sql('fold', 'dealt', LANGUAGES, digits=None)} SELECT * FROM report),
    per_fold AS (SELECT fold, sum(recall * support) / sum(support) AS accuracy, avg(f1) AS macro_f1 FROM present GROUP BY fold),
    v AS (SELECT 'accuracy' AS metric, '*' AS label, accuracy AS v FROM per_fold
          UNION ALL SELECT 'macro_f1', '*', macro_f1 FROM per_fold
          UNION ALL SELECT 'f1', label, f1 FROM listed)
    SELECT metric, label, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std FROM v GROUP BY metric, label""",
)
def cv_summary(spark, sf):
    dealt = stratified_folds(predicted(spark, sf), "actual", "doc_id")
    return E.summarise_folds(dealt, LANGUAGES)
