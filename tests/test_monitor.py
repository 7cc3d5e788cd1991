"""Telemetry and order on streams, drift, merged sketches."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from deskloom.operators import drift
from deskloom.streaming import telemetry

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "id long, ts timestamp, who string, unsure boolean, bits double"


@pytest.fixture(scope="module")
def rocksdb(spark):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def arriving(spark, folder, batches):
    import time

    for rows in batches:
        timed = [(i, None if t is None else START + timedelta(seconds=t), w, i % 3 == 0, i / 8) for i, t, w in rows]
        spark.createDataFrame(timed, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{folder}/in")
        time.sleep(1.1 if len(batches) > 1 else 0)  # files are read in the order of their times
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/in")


def result(spark, found, folder):
    telemetry.run_to_end(found, f"file://{folder}/out", f"file://{folder}/state")
    return spark.read.parquet(f"file://{folder}/out")


@pytest.mark.parametrize("files", [1, 4])
def test_windows_do_not_depend_on_batches(spark, rocksdb, tmp_path, files):
    rng = random.Random(3)
    rows = [(i, i * 50 + rng.randint(-100, 100), rng.choice(["a", "b", None])) for i in range(400)]
    rows += [(1000, None, "a")]
    step = -(-len(rows) // files)
    source = arriving(spark, tmp_path, [rows[i : i + step] for i in range(0, len(rows), step)])
    out = result(spark, telemetry.telemetry_stream(source, "ts", "id", "who", "unsure", "bits", window=600, delay="200 seconds"), tmp_path)
    got = {(int((r["window"].replace(tzinfo=timezone.utc) - START).total_seconds()), r["label"]): r for r in telemetry.telemetry_windows(out).collect()}
    end = max(t for _, t, _ in rows if t is not None) - 200
    wanted = {}
    for i, t, w in rows:
        if t is not None and (t // 600 + 1) * 600 <= end:
            wanted.setdefault((t // 600 * 600, w), []).append(i)
    assert {k: r["n"] for k, r in got.items()} == {k: len(v) for k, v in wanted.items()}
    for k, ids in wanted.items():
        assert got[k]["ambiguous"] == sum(i % 3 == 0 for i in ids) and got[k]["entropy_max"] == max(ids) / 8
        assert got[k]["mean_entropy"] == pytest.approx(sum(ids) / 8 / len(ids))
    assert out.filter("kind = 'late'").count() == 0


def test_late_rows_leave_by_themselves(spark, rocksdb, tmp_path):
    source = arriving(spark, tmp_path, [[(1, 10, "a"), (2, 2000, "a")], [(3, 20, "a"), (4, 2100, "b")], [(5, 30, "a"), (6, 9000, "a")]])
    out = result(spark, telemetry.telemetry_stream(source, "ts", "id", "who", "unsure", "bits", window=600, delay="60 seconds"), tmp_path)
    assert {r["id"] for r in out.filter("kind = 'late'").collect()} == {3, 5}
    windows = {(r["window"].replace(tzinfo=timezone.utc) - START).total_seconds(): r["n"] for r in telemetry.telemetry_windows(out).filter("label = 'a'").collect()}
    assert windows == {0: 1, 1800: 1}


@pytest.mark.parametrize("files", [1, 3])
def test_order_per_customer(spark, rocksdb, tmp_path, files):
    """Rows in any order within the delay come out in order, whatever the batches."""
    rng = random.Random(7)
    rows = [(i, i * 10 // 3, rng.choice("xyz")) for i in range(150)]
    last = (999, 10_000, "x")  # moves the watermark past the others
    parts = [rows[i * 150 // files : (i + 1) * 150 // files] for i in range(files)]
    for p in parts:
        rng.shuffle(p)
    parts[-1] = [*parts[-1], last, (998, None, "y")]
    out = result(spark, telemetry.ordered_stream(arriving(spark, tmp_path, parts), "who", "ts", "id", "unsure", "600 seconds"), tmp_path)
    got = {}
    for r in out.orderBy("who", "seq").collect():
        assert not r["late"]
        got.setdefault(r["who"], []).append((r["seq"], r["id"], r["gap_us"]))
    for who in "xyz":
        own = [(t, i) for i, t, w in rows if w == who]
        gaps = [None] + [(b[0] - a[0]) * 1_000_000 for a, b in zip(own, own[1:])]
        assert got[who] == [(n, i, g) for n, ((_, i), g) in enumerate(zip(own, gaps), 1)]


def test_order_marks_late_rows(spark, rocksdb, tmp_path):
    source = arriving(spark, tmp_path, [[(1, 10, "x"), (2, 500, "x")], [(3, 900, "x")], [(4, 20, "x"), (5, 5000, "x")]])
    rows = result(spark, telemetry.ordered_stream(source, "who", "ts", "id", "bits", "60 seconds"), tmp_path).collect()
    assert {(r["id"], r["seq"], r["late"]) for r in rows} == {(1, 1, False), (2, 2, False), (3, 3, False), (4, None, True)}


def test_order_holds_rows_as_arrays():
    """Rows that arrive together are one entry of the state, and leave in order over several entries."""
    state = {"waiting": [], "released": None, "next": None}

    class Value:
        def __init__(self, name, *_):
            self.name = name

        def get(self):
            return iter(list(state[self.name])) if self.name == "waiting" else state[self.name]

        def update(self, value):
            state[self.name] = value

        put = update

        def appendValue(self, value):
            state[self.name].append(value)

        def clear(self):
            state[self.name] = [] if self.name == "waiting" else None

    class Handle:
        getListState = getValueState = lambda self, name, *_: Value(name)

        def registerTimer(self, ms):
            pass

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    order = telemetry.InOrder()
    order.init(Handle())
    chunks = [pd.DataFrame({"us": [9_000_000, 2_000_000], "id": [3, 1], "payload": [None, "a"]})]
    chunks.append(pd.DataFrame({"us": [4_000_000], "id": [2], "payload": ["b"]}))
    assert list(order.handleInputRows(("x",), iter(chunks), Now(0))) == []
    assert len(state["waiting"]) == 2 and state["next"] == (2000,)
    (out,) = order.handleExpiredTimer(("x",), Now(5000), None)
    assert out[["id", "us", "seq"]].to_numpy().tolist() == [[1, 2_000_000, 1], [2, 4_000_000, 2]]
    assert out["gap_us"].isna().tolist() == [True, False] and out["gap_us"][1] == 2_000_000
    (late,) = order.handleInputRows(("x",), iter([pd.DataFrame({"us": [3_000_000, 9_500_000], "id": [4, 5], "payload": ["c", "d"]})]), Now(5000))
    assert late["id"].tolist() == [4] and late["late"].all() and late["seq"].isna().all()
    (out,) = order.handleExpiredTimer(("x",), Now(10_000), None)
    assert out[["id", "seq", "gap_us"]].to_numpy().tolist() == [[3, 3, 5_000_000], [5, 4, 500_000]] and out["payload"][0] is None
    assert state == {"waiting": [], "released": (4, 9_500_000), "next": None}


def test_distances_match_the_definition(spark):
    rng = random.Random(1)
    rows = [(d, "g", rng.gauss(0.4 + 0.15 * (d == 2), 0.1)) for d in range(3) for _ in range(300)]
    rows += [(0, "h", None), (1, "h", float("nan")), (1, "new", 0.5), (1, None, 0.1), (0, None, 0.1)]
    df = spark.createDataFrame(rows, "day int, g string, score double")
    counts = drift.bin_counts(df, ["day", "g"], "score")
    reference = drift.merged_counts(counts.filter("day = 0"), ["g"])
    found = {(r["day"], r["g"]): r for r in drift.distances(counts.filter("day > 0"), reference, ["day"], ["g"]).collect()}
    assert set(found) == {(1, "g"), (2, "g"), (1, None)}
    bins = {d: [0] * 50 for d in range(3)}
    for d, g, x in rows:
        if g == "g":
            bins[d][max(0, min(49, int(x // 0.02)))] += 1
    for d in (1, 2):
        apart = max(abs(sum(bins[d][: i + 1]) - sum(bins[0][: i + 1])) / 300 for i in range(50))
        assert found[d, "g"]["distance"] == pytest.approx(apart, abs=1e-6)
    assert not found[1, "g"]["drifted"] and found[2, "g"]["drifted"]
    assert drift.distances(counts.limit(0), reference, ["day"], ["g"]).count() == 0


def test_sketches_merge(spark):
    rows = spark.range(20_000).select((F.col("id") % 24).alias("hour"), (F.pow(F.rand(3), 3) * 100).alias("ms"))
    rows = rows.unionByName(spark.createDataFrame([(30, None), (31, 5.0)], "hour long, ms double")).cache()
    hourly = drift.latency_sketches(rows, ["hour"], "ms").withColumn("all", F.lit(0))
    shares = [50.0, 95.0, 99.9]
    found = drift.merged_quantiles(hourly, ["all"], shares)
    error = drift.rank_errors(rows.withColumn("all", F.lit(0)), found, ["all"], "ms", shares).first()
    assert error["n"] == 20_001 and error["error"] <= drift.RANK_ERROR
    single = drift.merged_quantiles(hourly.filter("hour = 31"), ["hour"], shares).first()
    assert single["q50"] == single["q99_9"] == 5.0 and hourly.filter("hour = 30").count() == 0
