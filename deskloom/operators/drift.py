"""Drift of scores and percentiles of latencies from statistics that merge.

A day's or hour's statistics are written once and merged to any range later: bin counts by
addition, quantile sketches by their own merge. No row is read twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a score between its bounds; factor of the distance that one in twenty samples reaches.
BINS, CRITICAL = 50, 1.358
#: Size of the levels of a quantile sketch, and the rank error that goes with it (99 percent).
SKETCH_K, RANK_ERROR = 200, 0.0165


def bin_of(score: Column, low: float, high: float, bins: int = BINS) -> Column:
    """Bin 0 to ``bins - 1``; scores outside the bounds fall into the outer bins."""
    place = F.floor((score - F.lit(low)) / F.lit((high - low) / bins))
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), place)).cast("int")


def bin_counts(
    scores: DataFrame, keys: Sequence[str], score: str, low: float = 0.0, high: float = 1.0, bins: int = BINS
) -> DataFrame:
    """(keys, bin, n) of the known scores: partial sums, at most ``bins`` rows per key."""
    known = scores.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    binned = known.select(*keys, bin_of(F.col(score), low, high, bins).alias("bin"))
    return binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def merged_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bin counts of coarser keys."""
    return counts.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))


def distances(windows: DataFrame, reference: DataFrame, window: Sequence[str], group: Sequence[str]) -> DataFrame:
    """(window, group, n, n_reference, distance, limit, drifted): the greatest difference of the
    cumulative shares (Kolmogorov and Smirnov's) of every window's bins to the reference's of its
    group. A group without a reference has no row; a window without scores has none either.

    ``windows``: (window, group, bin, n); ``reference``: (group, bin, n).
    """
    keys = [*window, *group]
    names = [F.col(g).alias(f"_r{i}") for i, g in enumerate(group)]
    other = reference.select(*names, F.col("bin").alias("_bin"), F.col("n").alias("_n"))
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_r{i}"))
    each = windows.select(*keys).distinct().join(other, same).select(*keys, F.col("_bin").alias("bin"), F.lit(0).alias("n"), "_n")
    both = windows.select(*keys, "bin", "n", F.lit(0).alias("_n")).unionByName(each)
    bins = both.groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.sum("_n").alias("_n"))
    # At most as many rows as there are bins in each window of a group.
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    total, total_r = F.sum("n").over(all_), F.sum("_n").over(all_)
    apart = F.abs(F.sum("n").over(upto) / total - F.sum("_n").over(upto) / total_r)
    rows = bins.select(*keys, "n", "_n", apart.alias("apart"), total_r.alias("known")).filter("known > 0")
    n, m = F.sum("n"), F.sum("_n")
    return (
        rows.groupBy(*keys)
        .agg(
            n.alias("n"),
            m.alias("n_reference"),
            F.round(F.max("apart"), 6).alias("distance"),
            F.round(F.lit(CRITICAL) * F.sqrt((n + m) / (n * m)), 6).alias("limit"),
        )
        .withColumn("drifted", F.col("distance") > F.col("limit"))
    )


def latency_sketches(rows: DataFrame, keys: Sequence[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """(keys, n, sketch): a quantile sketch of the known values of each key, a few kB each."""
    known = rows.filter(F.col(value).isNotNull())
    sketch = F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch")
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sketch)


def share_name(share: float) -> str:
    """Column of a percentile: q50, q99_9."""
    return f"q{share:g}".replace(".", "_")


def merged_quantiles(sketches: DataFrame, keys: Sequence[str], shares: Sequence[float], k: int = SKETCH_K) -> DataFrame:
    """(keys, n, q50, ...) of merged sketches; ``shares`` in percent name the columns."""
    merged = sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch")
    )
    each = [F.kll_sketch_get_quantile_double("sketch", F.lit(s / 100)).alias(share_name(s)) for s in shares]
    return merged.select(*keys, "n", *each)


def rank_errors(rows: DataFrame, quantiles: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(keys, n, error): how far the rank of each sketched quantile is from its share, at most.

    A value that many rows share covers a range of ranks; the nearest of them counts."""
    names = [share_name(s) for s in shares]
    known = rows.filter(F.col(value).isNotNull()).join(quantiles.select(*keys, *names), list(keys))
    below = [F.avg((F.col(value) < F.col(q)).cast("double")).alias(f"_b{q}") for q in names]
    upto = [F.avg((F.col(value) <= F.col(q)).cast("double")).alias(f"_u{q}") for q in names]
    ranked = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *below, *upto)
    off = [
        F.greatest(F.lit(0.0), F.col(f"_b{q}") - F.lit(s / 100), F.lit(s / 100) - F.col(f"_u{q}")) for q, s in zip(names, shares)
    ]
    return ranked.select(*keys, "n", F.greatest(*off, F.lit(0.0)).alias("error"))
