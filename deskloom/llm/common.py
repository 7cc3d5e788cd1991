"""Helpers of the training-data operators: text batches, word rules, row packing."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskloom.session import configure, scratch_path

#: Rows and bytes of text that a Python worker holds at a time.
BATCH_ROWS, BATCH_BYTES = 4000, 16 << 20

#: Bytes outside 0-9, a-z and UTF-8 sequences become spaces; A-Z become a-z.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the library's source to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="deskloom-")) / "deskloom.zip"  # the driver serves it
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def prepare(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> SparkSession:
    """The SQL settings that the operators of this package rely on; the workers get its code."""
    configure(spark)
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(_ALNUM).split()


def spaced_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, unchanged."""
    return text.split()


def packed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add nothing, drop nothing: ``columns`` inside one struct ``row``, safe from name clashes."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))


def map_texts(
    df: DataFrame,
    column: str,
    keep: Sequence[str],
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[list[bytes]], list[pa.Array]]],
) -> DataFrame:
    """(row struct of ``keep``, fields...): ``make()`` builds, once per task, the function
    that turns the UTF-8 texts of a batch (null: empty) into one Arrow array per field.

    The batches follow the scan's partitions: no shuffle.
    """
    inside = column in keep
    schema = df.schema
    row_type = T.StructType([schema[c] for c in keep])
    source = packed(df, keep)
    if not inside:
        text = F.col(f"`{column}`").cast("string").alias("text")
        source = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text)
    at = list(keep).index(column) if inside else -1
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            row = batch.column(0)
            texts = row.field(at) if inside else batch.column(1)
            filled = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([row, *apply(filled)], names=["row", *names])

    out = T.StructType([T.StructField("row", row_type), *fields])
    return source.mapInArrow(run, out)


def written(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, outlives executors. ``narrow``:
    rows of a few numbers, written by at most four tasks a core, not as a file for each of many partitions."""
    path = scratch_path(df.sparkSession, f"llm-{label}")
    if narrow:
        df = df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lists(offsets, values: pa.Array) -> pa.ListArray:
    """Arrow list array of ``values`` cut at ``offsets``."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
