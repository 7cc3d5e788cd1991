"""Order-dependent work without ever sorting one whole group in one task.

A group (an intent, a label, a thread) may hold a third of all rows, so numbering,
neighbours and ranks are computed in two levels: inside ranges of about equal size that
follow the order, and across the range totals, which are few.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskloom.session import materialize


def int_bucket(order: Column, width: int = 65536) -> Column:
    """Bucket of a unique integer order column: at most ``width`` rows each."""
    return F.floor(order / F.lit(width)).cast("long")


def number_rows(
    df: DataFrame, order: Sequence[str], group: Sequence[str] = (), name: str = "rn"
) -> DataFrame:
    """Exact 1-based row number per group (or overall), sorted range by range.

    Rows are numbered where they are sorted, so they move once; only the range counts are ordered
    as a whole: one row per range and group in it.
    """
    group = list(group)
    keys = [*group, *order]
    sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # ``_place`` holds the number of the range above bit 33 and the place in it below.
    placed = materialize(sorted_.withColumn("_place", F.monotonically_increasing_id()), "parts")
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    counts = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_part").alias("_offset_part"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    same = F.col("_part") == F.col("_offset_part")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (
        placed.join(materialize(offsets, "offsets"), same)
        .withColumn(name, F.col("_place") + F.col("_shift"))
        .select(*df.columns, name)
    )


def with_next(
    df: DataFrame, group: str, order: str, columns: Sequence[str], prefix: str = "next_", keep: Column | None = None
) -> DataFrame:
    """Each row with columns of the following row of its group; only rows for which ``keep`` holds,
    a condition on a row's own and the following row's columns.

    ``order`` is unique within the group. Rows move once, into sorted ranges, and are paired there;
    the last row of a range takes the first row of the next one that has its group. Of a range only
    these two and the rows that are kept are written.
    """
    columns = list(columns)
    names = list(df.columns)
    at = [names.index(c) for c in columns]
    place = names.index(group)
    sorted_ = df.repartitionByRange(group, order).sortWithinPartitions(group, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head = None, True
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
                held = rows.slice(len(rows) - 1)
                yield from pairs(rows.slice(0, len(rows) - 1), rows.slice(1), head)
                head = head and len(rows) == 1
        if held is not None:
            yield from pairs(held, None, head)

    def pairs(rows: pa.Table, following: pa.Table | None, head: bool) -> Iterator[pa.RecordBatch]:
        """``rows`` with the rows after them; the last row of a range has none yet."""
        n = len(rows)
        if following is None:
            nexts = [pa.nulls(n, rows.schema.field(i).type) for i in at]
        else:
            alike = _alike(rows.column(place), following.column(place))
            nexts = [following.column(i).combine_chunks().take(pa.array(np.arange(n), mask=~alike)) for i in at]
        first = np.zeros(n, bool)
        first[:1] = head
        last = np.full(n, following is None)
        out = [*rows.columns, *nexts, first, last]
        yield from pa.table(out, names=[*names, *(prefix + c for c in columns), "_head", "_tail"]).combine_chunks().to_batches()

    fields = [T.StructField(prefix + c, df.schema[c].dataType) for c in columns]
    edges = [T.StructField("_head", T.BooleanType()), T.StructField("_tail", T.BooleanType())]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema), *fields, *edges])
    paired = sorted_.mapInArrow(run, schema).withColumn("_part", F.spark_partition_id())
    placed = materialize(paired if keep is None else paired.filter(keep | F.col("_head") | F.col("_tail")), "parts")
    # One row for each end of a range; the one after a tail in its group is the next range's head.
    edge = placed.select(
        F.col(group).alias("_g"), F.col("_part").alias("_b"), F.struct(*columns).alias("_first"), "_head", "_tail"
    )
    heads = edge.filter("_head").select("_g", "_b", "_first", F.lit(False).alias("_last"))
    tails = edge.filter("_tail").select("_g", "_b", F.lit(None).cast(heads.schema["_first"].dataType).alias("_first"), F.lit(True).alias("_last"))
    across = Window.partitionBy("_g").orderBy("_b", "_last")
    follow = (
        heads.unionByName(tails)
        .select("_b", "_last", F.lead("_first").over(across).alias("_follow"))
        .filter(F.col("_last") & F.col("_follow").isNotNull())
        .select("_b", "_follow")
    )
    joined = placed.join(materialize(follow, "follow"), F.col("_tail") & (F.col("_part") == F.col("_b")), "left")
    chosen = [F.coalesce(F.col("_follow")[c], F.col(prefix + c)).alias(prefix + c) for c in columns]
    found = joined.select(*names, *chosen)
    return found if keep is None else found.filter(keep)


def _alike(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """Where two columns hold the same value; null is like null, and NaN like NaN."""
    if pa.types.is_nested(a.type):
        return np.array([x == y for x, y in zip(a.to_pylist(), b.to_pylist())], bool)
    alike = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    if pa.types.is_floating(a.type):
        alike = pc.or_(alike, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return alike.to_numpy()


def top_n_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, name: str = "rn"
) -> DataFrame:
    """First ``n`` rows of each group, with their rank.

    Up to the planner's limit the ``rank <= n`` filter already prunes every map task
    to ``n`` rows per group before the shuffle. Above it, a salted first pass does.
    """
    group = list(group)
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if n > threshold:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(256)))
        first = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_rn", F.row_number().over(first))
            .filter(F.col("_rn") <= n)
            .drop("_rn", "_salt")
        )
    last = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(last)).filter(F.col(name) <= n)


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value (and group): count, rows before it, and average rank.

    Equal values are merged first, then the distinct values are range-partitioned and
    written, so that partition totals and local running counts refer to the same split.
    """
    by = list(by)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("n")
    )
    split = materialize(
        counted.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()),
        "value-ranks",
    )
    before_part = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        split.groupBy(*by, "_part")
        .agg(F.sum("n").alias("_total"))
        .select(
            *[F.col(g).alias(f"_g{i}") for i, g in enumerate(by)],
            F.col("_part").alias("_total_part"),
            F.coalesce(F.sum("_total").over(before_part), F.lit(0)).alias("_base"),
        )
    )
    before = (
        Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    same = F.col("_part") == F.col("_total_part")
    for i, g in enumerate(by):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (
        split.withColumn("_local", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(totals, same)
        .select(
            *by,
            value,
            "n",
            (F.col("_base") + F.col("_local")).alias("rows_before"),
            (F.col("_base") + F.col("_local") + (F.col("n") + 1) / 2).alias("avg_rank"),
        )
    )
