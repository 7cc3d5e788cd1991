"""Search through coarse cells: exact when all are probed, recall otherwise, hot lists split."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskloom.operators import cells as C
from deskloom.operators import vectors as V

SCHEMA = "id long, g int, vec array<float>"


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16))
    rows = [(i, i % 2, (centres[i % 20] + 0.3 * rng.normal(size=16)).astype("float32").tolist()) for i in range(1500)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows_of(df):
    return sorted((r["grp"], r["query"], r["item"], round(r["score"], 4), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("part,block", [(4096, 2048), (13, 7)])
def test_all_cells_are_exact(clustered, part, block):
    asked = clustered.filter("id % 50 = 0")
    index = C.build_cells(clustered, "g", cells=9, part=part)
    found = C.cell_matches(asked, index, "g", 3, probes=9, block=block, skip_same_id=True)
    assert rows_of(found) == rows_of(V.dense_matches(asked, clustered, "g", 3, skip_same_id=True))


def test_recall_with_few_probes(clustered):
    asked = clustered.filter("id % 50 = 0")
    index = C.build_cells(clustered, "g", cells=20)
    probes = C.fit_probes(asked.withColumn("grp", F.col("g")), index, 3, skip_same_id=True)
    found = C.cell_matches(asked, index, "g", 3, probes=probes, skip_same_id=True)
    rated = C.recall(found, V.dense_matches(asked, clustered, "g", 3, skip_same_id=True)).collect()
    assert probes <= 6 and sum(r["hits"] for r in rated) >= 0.9 * sum(r["wanted"] for r in rated)
    assert sum(r["wanted"] for r in rated) == 90


def test_edges(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [0.0, 0.0]), (3, 0, None), (4, 1, [0.0, 2.0]), (5, 0, [1.0, 0.0]), (5, 0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    index = C.build_cells(df, "g", cells=50)
    found = rows_of(C.cell_matches(df, index, "g", 2, probes=50))
    assert (0, 1, 1, 1.0, 1) in found and (0, 1, 5, 1.0, 2) in found and (1, 4, 4, 1.0, 1) in found
    assert not [r for r in found if r[1] == 3 or r[2] == 3]
    none = df.limit(0)
    assert C.cell_matches(none, index, "g").count() == 0
    assert C.cell_matches(df, C.build_cells(none, "g"), "g").count() == 0


def test_scores_of_few_vectors_are_held_at_a_time():
    rng = np.random.default_rng(3)
    x, known = rng.normal(size=(6000, 8)), rng.normal(size=(400, 8))
    want = np.argsort(-(x @ known.T), axis=1, kind="stable")
    for n in (1, 5):
        tracemalloc.start()
        got = C.nearest(x, known, n)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (got == want[:, :n]).all() and peak < 6000 * 400 * 8 / 4
