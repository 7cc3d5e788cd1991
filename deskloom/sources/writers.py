"""Sinks. Row counts come from what was stored, so retried tasks cannot inflate them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskloom.operators.metrics import counts_with_total
from deskloom.session import materialize


def write_counted(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> int:
    """Write, then count the rows stored; the input is computed once.

    Of Parquet files only the footers are read for the count.

    A count while writing would need an ``Observation``, which leaves a session unable to
    serialize the ML closures that refer to it (Spark 4.1).
    """
    df.write.format(fmt).mode(mode).save(path)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(path).count()


def write_vault(vault: DataFrame, path: str, source: str, max_per_intent: int | None = None) -> None:
    """Pairs partitioned by intent under ``pairs``, one-row metadata under ``metadata``."""
    vault.write.mode("overwrite").partitionBy("intent").parquet(f"{path}/pairs")
    stored = vault.sparkSession.read.parquet(f"{path}/pairs")
    vault_metadata(stored, source, max_per_intent).write.mode("overwrite").json(f"{path}/metadata")


def vault_metadata(vault: DataFrame, source: str, max_per_intent: int | None = None) -> DataFrame:
    """One row: source, total pairs, cap, and a map of pairs per intent."""
    counts = counts_with_total(vault, "intent")
    per_intent = F.map_from_entries(
        F.array_sort(F.collect_list(F.when(F.col("intent").isNotNull(), F.struct("intent", "n"))))
    )
    return counts.agg(
        F.lit(source).alias("source"),
        F.coalesce(F.max(F.when(F.col("intent").isNull(), F.col("n"))), F.lit(0)).alias("total_pairs"),
        F.lit(max_per_intent).cast("long").alias("max_per_intent"),
        per_intent.alias("counts_by_intent"),
    )


def write_result(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Result table (split, expanded set, metrics, agreement) to a run's own path."""
    df.write.format(fmt).mode("overwrite").save(path)


def _array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one JSON array from one JSON object a row; an empty array without rows."""
    before = "["
    for batch in batches:
        lines = []
        for value in batch.column(0).to_pylist():
            lines.append(before + value)
            before = ","
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"])], names=["value"])


def write_array(df: DataFrame, path: str, rows: int = 100_000) -> None:
    """Files that hold one JSON array each, of about ``rows`` rows.

    A reader takes such a file whole, so its size has to be bounded; rows are dealt out evenly
    and pass a task one batch at a time. Columns without a value are left out of their object.
    """
    stored = materialize(df, "array-rows")  # counted and dealt, computed once
    files = max(-(-stored.count() // rows), 1)
    objects = stored.select(F.to_json(F.struct(*stored.columns)).alias("value")).repartition(files)
    objects.mapInArrow(_array_lines, "value string").write.mode("overwrite").text(path)
