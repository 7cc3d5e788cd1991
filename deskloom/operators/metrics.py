"""Classification reports, agreement statistics and summaries.

Everything is a partial aggregate: rows collapse to (label, label) counts in the map
tasks, and the statistics are computed from those counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskloom.operators.ordering import value_ranks


def counts_with_total(df: DataFrame, column: str) -> DataFrame:
    """Rows per value plus a grand-total row with a NULL value."""
    return df.rollup(column).agg(F.count(F.lit(1)).alias("n"))


def majority_class(df: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent value (smallest on a tie), its count and share."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias("majority"),
        F.max("n").alias("n"),
        F.round(F.try_divide(F.max("n"), F.sum("n")), 4).alias("share"),
    )


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: share of equal labels and the number of rows."""
    return df.agg(
        F.round(F.avg((F.col(actual) == F.col(predicted)).cast("int")), 4).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def _sides(df: DataFrame, actual: str, predicted: str, by: Sequence[str]) -> DataFrame:
    """(by, label): support, predicted and hits, from (actual, predicted) counts."""
    n, none = F.col("n"), F.lit(0).cast("long")
    pairs = df.groupBy(*by, actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    hits = F.when(F.col(actual) == F.col(predicted), n).otherwise(none)
    # Both sides of a pair from one pass over the input.
    sides = F.array(
        F.struct(F.col(actual).alias("label"), n.alias("s"), none.alias("p"), hits.alias("h")),
        F.struct(F.col(predicted).alias("label"), none.alias("s"), n.alias("p"), none.alias("h")),
    )
    return (
        pairs.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))
    )


def class_report(
    df: DataFrame,
    actual: str,
    predicted: str,
    labels: Sequence[str] | None = None,
    by: Sequence[str] = (),
    digits: int | None = 4,
) -> DataFrame:
    """Precision, recall, F1 and support per label; an empty denominator gives 0.

    With ``labels`` every listed label has a row, also one that never occurs; without,
    the labels present in either column.
    """
    by = list(by)
    found = _sides(df, actual, predicted, by)
    if labels is not None:
        spark = df.sparkSession
        wanted = spark.createDataFrame([(v,) for v in labels], "label string")
        if by:  # one row per fold or model and label
            groups = found.select(*by).distinct()
            wanted = groups.select(*by, F.explode(F.array(*map(F.lit, labels))).alias("label"))
        found = wanted.join(found, [*by, "label"], "left").na.fill(
            0, ["support", "predicted", "hits"]
        )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    cut = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    p, r = ratio("hits", "predicted"), ratio("hits", "support")
    f1 = F.coalesce(
        F.try_divide(2 * F.col("hits"), F.col("support") + F.col("predicted")), F.lit(0.0)
    )
    return found.select(
        *by,
        "label",
        cut(p).alias("precision"),
        cut(r).alias("recall"),
        cut(f1).alias("f1"),
        "support",
    )


def macro_metrics(
    df: DataFrame, actual: str, predicted: str, by: Sequence[str] = (), digits: int | None = 4
) -> DataFrame:
    """Accuracy, macro precision/recall/F1 and weighted F1 over the labels present."""
    report = class_report(df, actual, predicted, None, by, digits=None)
    cut = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    rows = F.sum("support")
    return report.groupBy(*by).agg(
        cut(F.try_divide(F.sum(F.col("recall") * F.col("support")), rows)).alias("accuracy"),
        cut(F.avg("precision")).alias("macro_precision"),
        cut(F.avg("recall")).alias("macro_recall"),
        cut(F.avg("f1")).alias("macro_f1"),
        cut(F.try_divide(F.sum(F.col("f1") * F.col("support")), rows)).alias("weighted_f1"),
    )


def confusion_matrix(
    df: DataFrame, actual: str, predicted: str, labels: Sequence[str]
) -> DataFrame:
    """One row per listed label, one column per listed label, in list order.

    Rows whose actual label is not listed are left out; labels that never occur count 0.
    """
    spark = df.sparkSession
    listed = spark.createDataFrame([(i, str(x)) for i, x in enumerate(labels)], "_position int, _label string")
    counted = df.groupBy(F.col(actual).cast("string").alias("_label")).agg(
        *[F.count_if(F.col(predicted) == x).alias(x) for x in labels]
    )
    return (
        listed.join(counted, "_label", "left")
        .na.fill(0, subset=list(labels))
        .orderBy("_position")
        .select(F.col("_label").alias(actual), *labels)
    )


def percentiles(
    df: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact percentiles with linear interpolation: (by..., point, value).

    Works on ranks of distinct values, so no task holds the column or a group of it.
    """
    by = list(by)
    ranks = value_ranks(df, value, by)
    total = ranks.groupBy(*by).agg(F.sum("n").alias("total"))
    wanted = (
        total.select(
            *by, "total", F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("point")
        )
        .withColumn("_at", F.col("point") * (F.col("total") - 1))
        .select(
            *[F.col(g).alias(f"_w{i}") for i, g in enumerate(by)],
            "point",
            F.col("_at"),
            F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_rank"),
        )
    )
    # A handful of wanted ranks (per group) against the rank intervals.
    inside = (F.col("_rank") >= F.col("rows_before")) & (
        F.col("_rank") < F.col("rows_before") + F.col("n")
    )
    for i, g in enumerate(by):
        inside = F.col(g).eqNullSafe(F.col(f"_w{i}")) & inside
    weight = F.when(F.floor("_at") == F.ceil("_at"), F.lit(1.0)).otherwise(
        1.0 - F.abs(F.col("_at") - F.col("_rank"))
    )
    few = wanted if by else F.broadcast(wanted)
    return (
        ranks.join(few, inside)
        .groupBy(*by, "point")
        .agg(F.sum(F.col(value) * weight).alias("value"))
    )


def latency_stats(
    df: DataFrame, value: str, by: Sequence[str] = (), exact: bool = True
) -> DataFrame:
    """Mean, P95 and items per second of a column of milliseconds, per group if ``by`` is given.

    ``exact=False`` gives an approximate P95 in one pass, under the name ``p95_approx_ms``.
    """
    by = list(by)
    summary = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"),
        F.round(F.avg(value), 3).alias("mean_ms"),
        F.round(F.try_divide(F.count(F.lit(1)), F.sum(value) / 1000.0), 1).alias("items_per_sec"),
        *([] if exact else [F.percentile_approx(value, 0.95, 100000).alias("p95_approx_ms")]),
    )
    if not exact:
        return summary
    p95 = percentiles(df, value, [0.95], by)
    if not by:
        return summary.withColumn("p95_ms", p95.select(F.round("value", 3).alias("p95_ms")).scalar())
    named = p95.select(*[F.col(g).alias(f"_p{i}") for i, g in enumerate(by)], F.round("value", 3).alias("p95_ms"))
    same = reduce(
        lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_p{i}")) for i, g in enumerate(by)]
    )
    return summary.join(named, same, "left").select(*summary.columns, "p95_ms")


def agreement_rates(df: DataFrame, a: str, b: str) -> DataFrame:
    """Percent of equal ratings and of ratings at most one apart."""
    gap = F.abs(F.col(a) - F.col(b))
    return df.agg(
        F.round(F.avg((gap == 0).cast("int")) * 100, 2).alias("exact_pct"),
        F.round(F.avg((gap <= 1).cast("int")) * 100, 2).alias("tolerance_1_pct"),
        F.count(F.lit(1)).alias("n"),
    )


def weighted_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa with quadratic and linear weights.

    Weights count steps between positions among the labels seen in either column. The
    expected disagreement needs only the marginals: moments for quadratic weights, running
    counts per label for linear ones, so no product of the label sets is formed.
    """
    pairs = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(
        F.count(F.lit(1)).alias("n")
    )
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("a").alias("label"), F.col("n").alias("na"), none.alias("nb")),
        F.struct(F.col("b").alias("label"), none.alias("na"), F.col("n").alias("nb")),
    )
    marginals = (
        pairs.select(F.inline(sides))
        .groupBy("label")
        .agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    )
    # One row per rating value; the scale is short.
    order = Window.partitionBy().orderBy("label")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scale = marginals.select(
        "label",
        (F.row_number().over(order) - 1).cast("double").alias("pos"),
        F.col("na").cast("double").alias("na"),
        F.col("nb").cast("double").alias("nb"),
        F.sum("na").over(upto).cast("double").alias("ca"),
        F.sum("nb").over(upto).cast("double").alias("cb"),
    )
    expected = scale.agg(
        F.sum("na").alias("total"),
        F.sum(F.col("na") * F.col("pos")).alias("sa"),
        F.sum(F.col("nb") * F.col("pos")).alias("sb"),
        F.sum((F.col("na") + F.col("nb")) * F.col("pos") * F.col("pos")).alias("squares"),
        F.sum(F.col("ca") * F.col("cb")).alias("cc"),
        F.sum(F.col("ca") + F.col("cb")).alias("csum"),
    )
    place = scale.select("label", "pos")
    observed = (
        pairs.join(place.select(F.col("label").alias("a"), F.col("pos").alias("pa")), "a")
        .join(place.select(F.col("label").alias("b"), F.col("pos").alias("pb")), "b")
        .agg(
            F.sum(F.col("n") * F.pow(F.col("pa") - F.col("pb"), 2)).alias("o2"),
            F.sum(F.col("n") * F.abs(F.col("pa") - F.col("pb"))).alias("o1"),
        )
    )
    total = F.col("total")
    e2 = F.col("squares") - F.try_divide(2 * F.col("sa") * F.col("sb"), total)
    # Sum over thresholds of ca*(total-cb) + (total-ca)*cb, divided by the total.
    e1 = F.col("csum") - F.try_divide(2 * F.col("cc"), total)
    kappa = lambda o, e: F.round(1 - F.try_divide(F.col(o), e), 4)
    one = F.lit(1).alias("_one")  # one row on each side
    both = expected.select("*", one).join(observed.select("*", one), "_one")
    return both.select(
        kappa("o2", e2).alias("quadratic_kappa"),
        kappa("o1", e1).alias("linear_kappa"),
        F.col("total").cast("long").alias("n"),
    )


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks for ties, its t statistic and n."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    # Equal (a, b) pairs are merged before their ranks are looked up.
    pairs = rows.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(
        F.count(F.lit(1)).cast("double").alias("w")
    )
    ra = value_ranks(rows, a).select(F.col(a).alias("_a"), F.col("avg_rank").alias("x"))
    rb = value_ranks(rows, b).select(F.col(b).alias("_b"), F.col("avg_rank").alias("y"))
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    sums = pairs.join(ra, "_a").join(rb, "_b").agg(
        F.sum(w).alias("n"),
        F.sum(w * x).alias("sx"),
        F.sum(w * y).alias("sy"),
        F.sum(w * x * y).alias("sxy"),
        F.sum(w * x * x).alias("sxx"),
        F.sum(w * y * y).alias("syy"),
    )
    n = F.col("n")
    # NULL where a column is constant.
    rho = F.try_divide(
        n * F.col("sxy") - F.col("sx") * F.col("sy"),
        F.sqrt(
            (n * F.col("sxx") - F.col("sx") * F.col("sx"))
            * (n * F.col("syy") - F.col("sy") * F.col("sy"))
        ),
    )
    t = F.col("rho") * F.sqrt(F.try_divide(n - 2, 1 - F.col("rho") * F.col("rho")))
    return sums.select(rho.alias("rho"), "n").select(
        F.round("rho", 4).alias("rho"),
        F.round(t, 4).alias("t"),
        n.cast("long").alias("n"),
    )


def pass_rates(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Percent of rows with each flag set, one column per flag."""
    return df.agg(
        *[F.round(F.avg(F.col(f).cast("int")) * 100, 1).alias(f"{f}_pct") for f in flags]
    )


def tier_summary(
    df: DataFrame, tier: str, human: str, judge: str, tiers: Sequence[str]
) -> DataFrame:
    """Count and mean scores per listed tier; others are left out, an empty tier scores 0."""
    listed = df.sparkSession.createDataFrame([(t,) for t in tiers], "tier string")
    scores = df.groupBy(F.col(tier).alias("tier")).agg(
        F.count(F.lit(1)).alias("cases"), F.avg(human).alias("h"), F.avg(judge).alias("j")
    )
    h, j = F.coalesce("h", F.lit(0.0)), F.coalesce("j", F.lit(0.0))
    return listed.join(scores, "tier", "left").select(
        "tier",
        F.coalesce("cases", F.lit(0)).alias("cases"),
        F.round(h, 2).alias("human_mean"),
        F.round(j, 2).alias("judge_mean"),
        F.round(j - h, 2).alias("mean_delta"),
    )


def mean_and_spread(df: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation of each column."""
    stats: list[Column] = []
    for v in values:
        stats.append(F.round(F.avg(v), 4).alias(f"{v}_mean"))
        stats.append(F.round(F.stddev_pop(v), 4).alias(f"{v}_std"))
    return df.groupBy(*by).agg(*stats)


def top_disagreements(
    df: DataFrame, a: str, b: str, tie: str, n: int = 3
) -> DataFrame:
    """The ``n`` rows whose scores differ most; equal rows are left out."""
    gap = F.col(b) - F.col(a)
    return (
        df.withColumn("score_diff", gap)
        .filter(F.col("score_diff") != 0)
        .orderBy(F.abs("score_diff").desc(), tie)
        .limit(n)
    )


def all_pass(df: DataFrame, ok: Column) -> DataFrame:
    """One row: whether every row passes, and how many do."""
    return df.agg(
        F.coalesce(F.bool_and(ok), F.lit(True)).alias("all_pass"),
        F.coalesce(F.sum(ok.cast("int")), F.lit(0)).alias("passed"),
        F.count(F.lit(1)).alias("n"),
    )
