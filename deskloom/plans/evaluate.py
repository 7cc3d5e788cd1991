"""Evaluation jobs: system benchmark, judge agreement, held-out report, cross-validation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.functions.intents import label_name
from deskloom.functions.payloads import calibrate_judgement
from deskloom.functions.replies import (
    DIMENSIONS,
    canned_reply,
    full_marks,
    judge_by_rules,
    keyword_reply,
    rubric,
)
from deskloom.functions.routing import best_template, zone
from deskloom.functions.rules import TAXONOMY
from deskloom.functions.text import fill_template, fingerprint
from deskloom.operators import metrics as M
from deskloom.operators.learners import (
    fit_text_model,
    fold_table,
    majority_predict,
    predict_text,
    text_regression,
)
from deskloom.operators.matching import drop_leaked, fall_back_group
from deskloom.operators.ordering import top_n_per_group
from deskloom.operators.sampling import stratified_folds
from deskloom.plans.decide import retrieve, triage_cases
from deskloom.session import materialize

TIERS = ("baseline_1_trivial", "baseline_2_simple", "proposed_production")


def score_replies(replies: DataFrame) -> DataFrame:
    """(model, case_id, text, actual, predicted, reply, suppressed) with rubric columns.

    A suppressed reply (blocked hazard) counts as right on every dimension.
    """
    marks = F.when(F.col("suppressed"), full_marks()).otherwise(rubric(F.col("text"), F.col("reply")))
    return replies.withColumn("_marks", marks).select(*replies.columns, "_marks.*")


def benchmark_metrics(scored: DataFrame, by: str = "model") -> DataFrame:
    """One row per model: classification metrics (accuracy in percent) and rubric means."""
    labels = M.macro_metrics(scored, "actual", "predicted", [by])
    means = scored.groupBy(by).agg(*[F.round(F.avg(d), 2).alias(d) for d in DIMENSIONS])
    return labels.withColumn("accuracy", F.round(F.col("accuracy") * 100, 2)).join(means, by)


def sample_replies(scored: DataFrame, order: str, n: int = 3) -> DataFrame:
    """First replies per model, suppressed ones left out."""
    spoken = scored.filter(F.col("reply").isNotNull() & ~F.col("suppressed"))
    return top_n_per_group(spoken, ["model"], [F.col(order)], n, name="sample")


Classifier = Callable[[Column], Column]


def template_replies(
    golden: DataFrame, vault: DataFrame, classify: Classifier | None = None, k: int = 2
) -> DataFrame:
    """(case_id, predicted, reply, suppressed): every case is classified, hazards get no
    reply, all others the filled template of their best precedent, whatever their route."""
    cases = golden.select("case_id", "text", F.lit("@user").alias("handle"))
    checked = triage_cases(cases, classify).withColumn("query_key", fingerprint(F.col("text")))
    targets = fall_back_group(checked, vault.select("intent"))
    triaged = materialize(targets.withColumn("_row", F.monotonically_increasing_id()), "triaged")
    hazard = F.col("safety.is_hazard")
    targeted = triaged.filter(~hazard)
    queries = targeted.groupBy("query_key", "target").agg(F.min("text").alias("text"))
    # Of the precedents only the best one's reply is said; it moves once, to its case.
    found = retrieve(targeted, queries, vault, k)
    best = found.select("_row", "top_similarity", F.get("best", F.lit(0))["item"].alias("pair_id"))
    first = F.min(F.struct("case_id", "customer_query", "agent_reply"))["agent_reply"]
    replies = vault.groupBy("pair_id").agg(first.alias("agent_reply"))
    zoned = (
        targeted.select("_row", "case_id", "handle")
        .join(best, "_row", "left")
        .join(replies, "pair_id", "left")
        .withColumn("_zone", zone(F.coalesce("top_similarity", F.lit(0.0))))
    )
    template = best_template(F.col("_zone"), F.col("agent_reply"))
    spoken = zoned.select("case_id", fill_template(template, F.col("handle")).alias("reply"))
    return triaged.join(spoken, "case_id", "left").select(
        "case_id", F.col("intent").alias("predicted"), "reply", hazard.alias("suppressed")
    )


def system_replies(
    golden: DataFrame, train: DataFrame | None, vault: DataFrame, simple: Classifier | None = None
) -> DataFrame:
    """Predictions and replies of the three systems over a golden set.

    ``golden`` and ``train`` are (case_id, text, intent). Trivial: majority label, canned
    reply. Simple: TF-IDF with logistic regression fitted on ``train`` (or the label column
    function ``simple``), keyword reply. Proposed: cue classifier, safety, template replies.
    """
    user, no = F.lit("@user"), F.lit(False)
    out = ["model", "case_id", "text", "actual", "predicted", "reply", "suppressed"]
    gold = golden.withColumnRenamed("intent", "actual")
    trivial = (
        majority_predict(gold, "actual")
        .withColumn("model", F.lit("trivial"))
        .withColumn("reply", canned_reply(user))
        .withColumn("suppressed", no)
    )
    if simple is not None:
        guessed = gold.withColumn("predicted", simple(F.col("text")))
    else:
        labels = list(TAXONOMY)
        fit_on = drop_leaked(train, golden).withColumn(
            "_label", F.array_position(F.array(*map(F.lit, labels)), F.col("intent")) - 1
        )
        model = fit_text_model(fit_on, "case_id", "text", "_label", labels)
        guessed = predict_text(model, gold, "case_id", "text")
    plain = (
        guessed.withColumn("model", F.lit("simple"))
        .withColumn("reply", keyword_reply(F.col("text"), user))
        .withColumn("suppressed", no)
    )
    proposed = gold.join(template_replies(gold, vault), "case_id").withColumn("model", F.lit("proposed"))
    return trivial.select(out).unionByName(plain.select(out)).unionByName(proposed.select(out))


def judge_ratings(ratings: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """Human ratings with judge columns.

    ``responses`` is (case_id, response) from an external judge; without one, or where it
    cannot be read, the rule-based judge decides.
    """
    customer, reply, intent = F.col("customer_tweet"), F.col("generated_reply"), F.col("intent")
    if responses is None:
        judged = ratings.withColumn("_judge", judge_by_rules(customer, reply, intent))
    else:
        joined = ratings.join(responses.select("case_id", "response"), "case_id", "left")
        judged = joined.withColumn(
            "_judge", calibrate_judgement(F.col("response"), customer, reply, intent)
        ).drop("response")
    return judged.select(
        *ratings.columns,
        F.col("_judge.overall_score").alias("judge_score"),
        F.col("_judge.diagnostic_probe").alias("judge_diagnostic"),
        F.col("_judge.privacy_pivot").alias("judge_privacy"),
        F.col("_judge.zero_liability").alias("judge_liability"),
        F.col("_judge.rationale").alias("judge_rationale"),
        "_judge.length_compliant",
        "_judge.has_dm_link",
        "_judge.zero_liability_compliant",
    )


def agreement_study(judged: DataFrame, human: str = "human_overall_score") -> DataFrame:
    """Long table (metric, value) of agreement statistics and hard-check rates."""
    judged = materialize(judged, "judged")
    rates = M.agreement_rates(judged, human, "judge_score")
    kappa = M.weighted_kappa(judged, human, "judge_score")
    rank = M.spearman(judged, human, "judge_score")
    checks = M.pass_rates(judged, ["length_compliant", "has_dm_link", "zero_liability_compliant"])

    def long(df: DataFrame, names: Sequence[str]) -> DataFrame:
        pairs = F.array(
            *[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
        )
        return df.select(F.inline(pairs))

    return (
        long(rates, ["exact_pct", "tolerance_1_pct", "n"])
        .unionByName(long(kappa, ["quadratic_kappa", "linear_kappa"]))
        .unionByName(long(rank, ["rho"]))
        .unionByName(long(checks, checks.columns))
    )


def heldout_report(
    predictions: DataFrame, labels: Sequence[str] = TAXONOMY
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(class report, confusion matrix, macro metrics) of (actual, predicted) rows."""
    return (
        M.class_report(predictions, "actual", "predicted", labels),
        M.confusion_matrix(predictions, "actual", "predicted", labels),
        M.macro_metrics(predictions, "actual", "predicted"),
    )


def summarise_folds(
    predictions: DataFrame, labels: Sequence[str], fold: str = "fold"
) -> DataFrame:
    """Mean and population deviation over folds: overall accuracy and F1, F1 per label.

    ``predictions`` is (fold, actual, predicted); ``label`` is ``*`` for overall rows.
    """
    overall = M.macro_metrics(predictions, "actual", "predicted", [fold], digits=None)
    total = overall.select(
        F.inline(
            F.array(
                F.struct(F.lit("accuracy").alias("metric"), F.lit("*").alias("label"), F.col("accuracy").alias("v")),
                F.struct(F.lit("macro_f1").alias("metric"), F.lit("*").alias("label"), F.col("macro_f1").alias("v")),
            )
        )
    )
    report = M.class_report(predictions, "actual", "predicted", labels, [fold], digits=None)
    per_label = report.select(F.lit("f1").alias("metric"), "label", F.col("f1").alias("v"))
    return total.unionByName(per_label).groupBy("metric", "label").agg(
        F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_pop("v"), 4).alias("std")
    )


def cross_validate(
    df: DataFrame,
    item: str,
    text: str,
    label: str,
    labels: Sequence[str],
    folds: int = 5,
    max_iter: int = 1000,
) -> DataFrame:
    """(fold, actual, predicted) of a text model fitted once per fold on the other folds.

    Folds are dealt to ids; one count of terms serves the vocabularies of all folds, and a fold's
    vectors are made as its model reads them."""
    dealt = materialize(stratified_folds(df.select(item, label), label, item, folds), "folds")
    table = fold_table(df, dealt, item, text, label, folds)
    named = F.array(*map(F.lit, labels))
    parts = []
    for fold in range(folds):
        others, own = (table.rows.filter(c) for c in (F.col("fold") != fold, F.col("fold") == fold))
        train = table.vectors([fold], others).withColumn("_y", F.col("label").cast("double"))
        model = text_regression(others.count(), max_iter).fit(train)
        parts.append(
            model.transform(table.vectors([fold], own)).select(
                "fold",
                "item",
                named[F.col("label")].alias("actual"),
                label_name(F.col("prediction"), labels).alias("predicted"),
            )
        )
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part)
    return materialize(combined, "fold-predictions")  # summaries read it more than once


def expectation_check(predictions: DataFrame) -> DataFrame:
    """Rows with PASS or FAIL against the expected label."""
    return predictions.withColumn(
        "status", F.when(F.col("predicted") == F.col("expected"), "PASS").otherwise("FAIL")
    )


def first_examples(df: DataFrame, label: str, text: str, order: str) -> DataFrame:
    """First text of each label in order."""
    return df.groupBy(label).agg(
        F.min(order).alias(order), F.min_by(text, order).alias(text)
    )
