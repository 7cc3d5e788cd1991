"""Splits, folds, quotas, pools and numbering: rows picked by a fixed order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.functions.intents import Cues, matching_intents
from deskloom.functions.rules import CUES, LIMITS
from deskloom.operators.matching import keep_first
from deskloom.operators.ordering import number_rows, top_n_per_group
from deskloom.session import materialize

SEED = 42


def seeded_hash(id_col: Column, seed: int = SEED) -> Column:
    """Hex hash that puts rows in a fixed random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), id_col.cast("string")))


def _numbered(df: DataFrame, label: str, id_col: str, seed: int) -> DataFrame:
    hashed = df.withColumn("_hash", seeded_hash(F.col(id_col), seed))
    return number_rows(hashed, ["_hash"], [label], name="_rn").drop("_hash")


def stratified_split(
    df: DataFrame, label: str, id_col: str, test_share: float = 0.2, seed: int = SEED
) -> DataFrame:
    """Rows with ``split`` = test or train; exactly round(n * share) test rows per label."""
    sizes = df.groupBy(F.col(label).alias("_l")).agg(
        F.round(F.count(F.lit(1)) * F.lit(test_share)).cast("long").alias("_test")
    )
    numbered = _numbered(df, label, id_col, seed)
    return numbered.join(sizes, F.col(label).eqNullSafe(F.col("_l"))).select(
        *df.columns,
        F.when(F.col("_rn") <= F.col("_test"), "test").otherwise("train").alias("split"),
    )


def stratified_folds(
    df: DataFrame, label: str, id_col: str, folds: int = 5, seed: int = SEED
) -> DataFrame:
    """Rows with ``fold`` 0..folds-1, dealt out in turn per label."""
    numbered = _numbered(df, label, id_col, seed)
    return numbered.select(
        *df.columns, ((F.col("_rn") - 1) % folds).cast("int").alias("fold")
    )


def pair_ids(df: DataFrame, order: str, name: str = "pair_id") -> DataFrame:
    """Sequential ids ``pair_00001`` along a unique column."""
    numbered = number_rows(df, [order], name="_rn")
    number = F.col("_rn").cast("string")
    padded = F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number)
    return numbered.select(*df.columns, F.concat(F.lit("pair_"), padded).alias(name))


def batches(df: DataFrame, order: str, size: int, group: Sequence[str] = ()) -> DataFrame:
    """Rows with ``batch`` and ``item`` numbers: consecutive runs of ``size`` rows."""
    numbered = number_rows(df, [order], group, name="_rn")
    return numbered.select(
        *df.columns,
        F.floor((F.col("_rn") - 1) / size).cast("long").alias("batch"),
        ((F.col("_rn") - 1) % size + 1).cast("int").alias("item"),
    )


def numbered_prompts(batched: DataFrame, text: str, group: Sequence[str] = ()) -> DataFrame:
    """One prompt per batch: its texts as numbered, quoted lines. A batch is ten or so rows."""
    lines = F.array_sort(
        F.collect_list(
            F.struct("item", F.format_string('%d. "%s"', F.col("item"), F.col(text)).alias("line"))
        )
    )
    return batched.groupBy(*group, "batch").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"),
        F.count(F.lit(1)).alias("items"),
    )


def fill_quota(
    candidates: DataFrame,
    label: str,
    order: Sequence[Column],
    taken: DataFrame | None = None,
    quota: int = LIMITS.quota,
) -> DataFrame:
    """Candidates accepted until each label has ``quota`` rows, counting those in ``taken``.

    ``taken`` is (label, n).
    """
    first = top_n_per_group(candidates, [label], order, quota, name="_rn")
    if taken is None:
        return first.drop("_rn")
    have = taken.select(F.col(label).alias("_l"), F.col("n").alias("_have"))
    return (
        first.join(have, F.col(label) == F.col("_l"), "left")
        .filter(F.col("_rn") <= quota - F.coalesce("_have", F.lit(0)))
        .select(*candidates.columns)
    )


def mine_pools(
    df: DataFrame,
    text: str = "text",
    order: str = "ord",
    cues: Cues = CUES,
    pool_size: int = LIMITS.pool_size,
) -> DataFrame:
    """Capped pools: a text joins the first intent with a matching cue and room left.

    Equal to scanning in order and is done intent by intent: of the texts no earlier
    intent took, the first ``pool_size`` matching ones. Earlier intents can take at most
    ``pool_size`` texts each, so the first ``position * pool_size`` matches per intent are
    all that is needed; that bounded table is what the rounds read.
    """
    names = list(cues)
    distinct = keep_first(df.select(text, order), text, [order])
    matches = distinct.select(
        text, order, F.explode(matching_intents(F.col(text), cues)).alias("pos")
    )
    first = top_n_per_group(matches, ["pos"], [F.col(order)], pool_size * len(names))
    pool = materialize(first.filter(F.col("rn") <= F.col("pos") * pool_size).drop("rn"), "pools")
    picked: list[DataFrame] = []
    for pos, name in enumerate(names, start=1):
        left = pool.filter(F.col("pos") == pos).select(text, order)
        if picked:
            left = left.join(reduce(DataFrame.unionByName, picked).select(order), order, "left_anti")
        took = left.orderBy(order).limit(pool_size).select(text, order, F.lit(name).alias("intent"))
        picked.append(materialize(took, "pool"))
    return reduce(DataFrame.unionByName, picked)


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def by_priority(priorities: Mapping[str, int], source: Column) -> Column:
    """Position of a source tag in the fill order."""
    column = F.lit(len(priorities))
    for name, rank in priorities.items():
        column = F.when(source == name, rank).otherwise(column)
    return column
