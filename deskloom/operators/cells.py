"""Approximate dense search by coarse cells: inverted lists of the nearest centroid.

Centroids are fitted on a bounded sample; every item is listed under its nearest one. A query
looks at the lists of its ``probes`` nearest centroids only. A list is cut into parts and the
queries of a list into blocks, so a list or group of any size is many tasks, and a task returns k
rows per query; only the lists that queries probe are read, and items are copied once for each
block of queries at their own list, not for all queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskloom.operators.vectors import dense_matches
from deskloom.session import materialize, spread

#: Rows that centroids are fitted on at most, and rounds of the fit.
SAMPLE, ROUNDS = 20_000, 12
#: Rows of a part of a list, and of a block of queries.
PART, BLOCK = 4096, 2048
#: Vectors that a worker holds scores of at a time.
CHUNK = 256
#: Items that a list should hold about.
LIST_ROWS = 64
#: Queries that the number of probes is fitted on at most, and their recall that it has to reach.
TRIED, TARGET = 256, 0.95


@dataclass(frozen=True)
class CellIndex:
    """Centroids, and the written table of items (grp, cell, part, item, vec) of unit length."""

    centroids: np.ndarray
    items: DataFrame
    sizes: DataFrame  # grp, cell, parts


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero vectors stay zero."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def fit_centroids(items: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """``cells`` unit centroids (at most as many as there are rows) by spherical k-means on at most
    ``sample`` rows of ``items`` (id, vec), chosen by a hash of the id."""
    chosen = items.filter(F.col("vec").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(sample)
    found = chosen.select("vec").toArrow().column(0).combine_chunks()
    if not len(found):
        return np.zeros((0, 0))
    width = len(found[0])
    x = unit(found.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, width))
    centroids = x[: min(cells, len(x))].copy()  # the first of a hash order are a random choice
    for _ in range(rounds):
        nearest = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        held = np.bincount(nearest, minlength=len(centroids)) > 0
        centroids[held] = unit(sums[held])
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray, n: int, chunk: int = CHUNK) -> np.ndarray:
    """Places of the ``n`` nearest centroids of every row, best first; scores of ``chunk`` rows
    are held at a time. Among equal scores the lower place goes first."""
    near = np.zeros((len(x), n), np.int32)
    for a in range(0, len(x), chunk) if n else ():
        score = x[a : a + chunk] @ centroids.T
        if n == 1:
            near[a : a + chunk, 0] = score.argmax(axis=1)
        else:
            near[a : a + chunk] = np.argsort(-score, axis=1, kind="stable")[:, :n]
    return near


def _assigned(df: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """(id, grp, vec of unit length, cells): the ``probes`` nearest centroids of every vector."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    schema = T.StructType(
        [
            df.schema["id"],
            df.schema["grp"],
            T.StructField("vec", T.ArrayType(T.DoubleType())),
            T.StructField("cells", T.ArrayType(T.IntegerType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch.column(2).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(batch.num_rows, -1))
            n = min(probes, len(known))
            near = nearest(x, known, n)
            vec = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], vec, cells], names=["id", "grp", "vec", "cells"])

    return spread(df.select("id", "grp", "vec")).mapInArrow(run, schema)


def build_cells(items: DataFrame, group: str, cells: int | None = None, part: int = PART, sample: int = SAMPLE) -> CellIndex:
    """Index of ``items`` (id, ``group``, vec); a null vector is not listed. Without ``cells`` there
    are as many as make lists of about ``LIST_ROWS`` rows, at most a tenth of the sample."""
    rows = items.select("id", F.col(group).alias("grp"), "vec").filter(F.col("vec").isNotNull())
    if cells is None:
        cells = int(max(1, min(rows.count() / LIST_ROWS, sample / 10)))
    centroids = fit_centroids(rows, cells, sample)
    placed = _assigned(rows, centroids, 1).select("grp", F.get("cells", F.lit(0)).alias("cell"), F.col("id").alias("item"), "vec")
    placed = materialize(placed, "cells")
    parts = F.ceil(F.count(F.lit(1)) / F.lit(part)).cast("int").alias("parts")
    sizes = materialize(placed.groupBy("grp", "cell").agg(parts), "cell-sizes")
    return CellIndex(centroids, placed, sizes)


def fit_probes(
    queries: DataFrame, index: CellIndex, k: int = 3, target: float = TARGET, tried: int = TRIED, skip_same_id: bool = False
) -> int:
    """Lists to probe so that at most ``tried`` queries (id, grp, vec), chosen by a hash of the id,
    find the share ``target`` of their exact best k: these are searched among all items, and the
    place of each one's list among the query's nearest counts."""
    chosen = materialize(queries.orderBy(F.xxhash64("id"), "id").limit(tried), "tried")
    items = index.items.select(F.col("item").alias("id"), "grp", "vec")
    exact = dense_matches(chosen, items, "grp", k, skip_same_id=skip_same_id)
    ranked = _assigned(chosen, index.centroids, len(index.centroids)).select(F.col("id").alias("query"), "grp", "cells")
    homes = exact.select("query", "grp", "item").join(index.items.select("grp", "item", "cell"), ["grp", "item"])
    place = F.array_position("cells", F.col("cell")).alias("place")
    counts = homes.join(ranked, ["grp", "query"]).groupBy(place).count().orderBy("place").collect()
    reached = np.cumsum([r["count"] for r in counts])
    if not len(reached):
        return 1
    return int(counts[int(np.searchsorted(reached, target * reached[-1]))]["place"])


def cell_matches(
    queries: DataFrame,
    index: CellIndex,
    group: str,
    k: int = 3,
    probes: int | None = None,
    block: int = BLOCK,
    skip_same_id: bool = False,
) -> DataFrame:
    """(grp, query, item, score, rank): the best k items by cosine, of the probed lists of the
    query's group. ``queries`` is (id, ``group``, vec). Ties go to the lower id. A query with a null
    vector, or in a group without items, has no rows. Without ``probes`` they are fitted."""
    rows = queries.select("id", F.col(group).alias("grp"), "vec").filter(F.col("vec").isNotNull())
    if probes is None:
        probes = fit_probes(rows, index, k, skip_same_id=skip_same_id)
    asked = _assigned(rows, index.centroids, probes)
    asked = materialize(asked.select(F.col("id").alias("query"), "grp", "vec", F.explode("cells").alias("cell")), "probes")
    keys = ["grp", "cell"]
    blocks = F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks")
    shape = materialize(asked.groupBy(*keys).agg(blocks).join(index.sizes, keys), "cell-shape")
    left = asked.join(shape, keys).select(
        *keys,
        F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        "query",
        "vec",
    )
    right = index.items.join(shape, keys).select(
        *keys,
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("qb"),
        F.pmod(F.xxhash64("item"), F.col("parts")).cast("int").alias("part"),
        "item",
        "vec",
    )
    schema = T.StructType(
        [left.schema["grp"], left.schema["query"], right.schema["item"], T.StructField("score", T.DoubleType())]
    )

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["grp", "query", "item", "score"]
        if not len(a) or not len(b):
            return pa.Table.from_arrays([a["grp"][:0], a["query"][:0], b["item"][:0], pa.array([], pa.float64())], names=names)
        b = b.sort_by("item")
        sides = [t["vec"].combine_chunks().flatten().to_numpy().reshape(len(t), -1) for t in (a, b)]
        asked, listed = a["query"].to_numpy(), b["item"].to_numpy()
        n = min(k, len(b))
        tops, values = [], []
        for at in range(0, len(a), CHUNK):
            score = np.round(sides[0][at : at + CHUNK] @ sides[1].T, 4)
            if skip_same_id:
                score[asked[at : at + CHUNK, None] == listed[None, :]] = -np.inf
            tops.append(np.argsort(-score, axis=1, kind="stable")[:, :n])
            values.append(np.take_along_axis(score, tops[-1], axis=1).ravel())
        top, value = np.concatenate(tops).ravel(), np.concatenate(values)
        row = np.repeat(np.arange(len(a)), n)
        row, top, value = (x[np.isfinite(value)] for x in (row, top, value))
        return pa.Table.from_arrays([a["grp"].take(row), a["query"].take(row), b["item"].take(top), pa.array(value)], names=names)

    together = [*keys, "qb", "part"]
    found = left.groupBy(*together).cogroup(right.groupBy(*together)).applyInArrow(best, schema)
    order = Window.partitionBy("grp", "query").orderBy(F.col("score").desc(), "item")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(grp, hits, wanted) of found against exact rows (grp, query, item, score, rank). An item as
    good as the last exact one counts as a hit."""
    last = exact.groupBy("grp", "query").agg(F.count(F.lit(1)).alias("wanted"), F.min("score").alias("least"))
    hit = F.count_if(F.col("score") >= F.col("least") - 1e-9)
    return (
        last.join(found.select("grp", "query", "score"), ["grp", "query"], "left")
        .groupBy("grp", "query")
        .agg(F.least(hit, F.first("wanted")).alias("hits"), F.first("wanted").alias("wanted"))
        .groupBy("grp")
        .agg(F.sum("hits").alias("hits"), F.sum("wanted").alias("wanted"))
    )
