"""A precedent store in numbered versions, its text statistics kept up to date by differences.

A version adds pairs or removes some. It writes what it adds or removes (pairs, term counts) and
the differences of document frequencies and sizes, then a commit mark; readers see committed
versions only. Statistics at a version are sums of differences, so an append costs its own size,
and the index after any number of appends is that of the remaining pairs built at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom.functions.rules import STOP_WORDS
from deskloom.operators.vectors import LexicalIndex, explode_terms, index_of
from deskloom.session import materialize


@dataclass(frozen=True)
class PairStore:
    """Folder of a store; ids are unique within a version and among the pairs that are present."""

    spark: SparkSession
    path: str
    item: str = "pair_id"
    group: str = "intent"
    text: str = "customer_query"
    stops: Sequence[str] = STOP_WORDS

    def _at(self, kind: str, version: int) -> str:
        return f"{self.path}/{kind}/v{version:09d}"

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        done = [n for n in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def latest(self) -> int:
        """Newest committed version; 0 if there is none."""
        return max(self.versions(), default=0)

    def _write(self, kind: str, version: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._at(kind, version))

    def _commit(self, version: int, terms: DataFrame, ids: DataFrame, sign: int) -> int:
        """Differences of a version from its term counts and (item, grp) rows, then its mark."""
        df = terms.groupBy("grp", "term").agg((F.lit(sign) * F.count(F.lit(1))).alias("df"))
        self._write("frequencies", version, df)
        sizes = ids.groupBy("grp").agg((F.lit(sign) * F.count(F.lit(1))).alias("n"))
        self._write("sizes", version, sizes)
        self._write("commits", version, self.spark.range(1).select(F.lit(sign).alias("sign")))
        return version

    def append(self, pairs: DataFrame) -> int:
        """Add pairs; the new version. One writer at a time: a version that was not committed
        is written over."""
        version = self.latest() + 1
        self._write("pairs", version, pairs)
        stored = self.spark.read.parquet(self._at("pairs", version))
        self._write("terms", version, explode_terms(stored, self.item, self.group, self.text, self.stops))
        ids = stored.select(F.col(self.item).alias("item"), F.col(self.group).alias("grp"))
        return self._commit(version, self.spark.read.parquet(self._at("terms", version)), ids, 1)

    def remove(self, ids: DataFrame) -> int:
        """Remove pairs by id (a column named like the item); absent ids are no matter."""
        now = self.latest()
        version = now + 1
        gone = ids.select(F.col(self.item).alias("item")).distinct()
        present = self._present(now).join(gone, "item", "left_semi")
        self._write("removed", version, present.select("item"))
        removed = self.spark.read.parquet(self._at("removed", version))
        return self._commit(
            version,
            self._live("terms", now).join(removed, "item", "left_semi"),
            present.join(removed, "item", "left_semi"),
            -1,
        )

    def _read(self, kind: str, version: int) -> DataFrame | None:
        """Rows of a kind up to a version, with the version that wrote them as ``_v``."""
        paths = []
        for v in self.versions():
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(kind, v))
            files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            if v <= version and files.exists(folder):
                paths.append(self._at(kind, v))
        if not paths:
            return None
        number = F.regexp_extract(F.input_file_name(), rf"/{kind}/v(\d+)/", 1).cast("long")
        return self.spark.read.parquet(*paths).withColumn("_v", number)

    def _live(self, kind: str, version: int) -> DataFrame:
        """Rows of pairs that no later version up to this one has removed."""
        rows, removed = self._read(kind, version), self._read("removed", version)
        if rows is None:
            raise ValueError(f"{self.path} holds no version up to {version}")
        if removed is None:
            return rows.drop("_v")
        name = self.item if kind == "pairs" else "item"
        last = removed.groupBy(F.col("item").alias("_item")).agg(F.max("_v").alias("_gone"))
        joined = rows.join(last, F.col(name) == F.col("_item"), "left")
        return joined.filter(F.col("_gone").isNull() | (F.col("_v") > F.col("_gone"))).drop("_v", "_gone", "_item")

    def _present(self, version: int) -> DataFrame:
        return self.pairs(version).select(F.col(self.item).alias("item"), F.col(self.group).alias("grp"))

    def pairs(self, version: int | None = None) -> DataFrame:
        """Pairs that are present at a version (the newest)."""
        return self._live("pairs", self.latest() if version is None else version)

    def frequencies(self, version: int | None = None) -> DataFrame:
        """(grp, term, df) at a version: sums of differences."""
        rows = self._read("frequencies", self.latest() if version is None else version)
        return rows.groupBy("grp", "term").agg(F.sum("df").alias("df")).filter("df > 0")

    def sizes(self, version: int | None = None) -> DataFrame:
        """(grp, n) at a version."""
        rows = self._read("sizes", self.latest() if version is None else version)
        return rows.groupBy("grp").agg(F.sum("n").alias("n")).filter("n > 0")

    def index(self, version: int | None = None, k: int = 3) -> LexicalIndex:
        """Index at a version; no text is split anew."""
        version = self.latest() if version is None else version
        terms = materialize(self._live("terms", version).select("item", "grp", "term", "tf"), "store-terms")
        return index_of(self._present(version), terms, self.frequencies(version), self.sizes(version), k)
