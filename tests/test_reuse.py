"""Reuse with a time-to-live: blocks of one key, streams in small chunks, scratch of a batch."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from deskloom import session
from deskloom.operators import reuse
from deskloom.streaming import flows

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def plain(rows, ttl):
    """rows (id, key, second) -> ids of the hits."""
    hits, stored = set(), {}
    for i, key, second in sorted(rows, key=lambda r: (r[2], r[0])):
        if key in stored and second - stored[key] < ttl:
            hits.add(i)
        else:
            stored[key] = second
    return hits


def rows_of(seed, n=400):
    rng = random.Random(seed)
    out, at = [], 0
    for i in range(n):
        at += rng.choice([0, 0, 1, 1, 2, 3, 40, 150])
        out.append((i, rng.choice("aaaaaaab"), at - rng.choice([0, 0, 5])))
    return out


def frame(spark, rows):
    timed = [(i, k, START + timedelta(seconds=s)) for i, k, s in rows]
    return spark.createDataFrame(timed, "id long, key string, ts timestamp")


@pytest.mark.parametrize("ttl,span", [(7, 2), (10, 1), (3, 64), (50, 3)])
def test_blocks_of_a_key(spark, ttl, span):
    rows = rows_of(ttl)
    flagged = reuse.ttl_reuse(frame(spark, rows).repartition(4), "key", "ts", "id", ttl, span)
    assert {r.id for r in flagged.filter("hit").collect()} == plain(rows, ttl)
    assert flagged.count() == len(rows)


def test_exits_follow_the_pointers():
    rng = np.random.default_rng(1)
    for _ in range(200):
        ttl, start = int(rng.integers(1, 20)), int(rng.integers(0, 5)) * 100
        seconds = np.unique(start + rng.integers(0, 100, rng.integers(1, 60)))
        entries, exits = reuse.block_exits(seconds, start, ttl)
        for a, b in zip(entries, exits):
            places, last = reuse.miss_places(seconds[seconds >= a], None, ttl)
            assert last == b and len(places)
        for before in range(start - ttl, start):  # any earlier miss leads to one of the entries
            later = seconds[seconds >= before + ttl]
            assert not len(later) or later[0] in entries


def test_one_key_is_many_tasks(spark):
    """All events of a single key: the blocks of its seconds are worked on in several partitions."""
    rows = [(i, "k", i * 20) for i in range(3000)]
    flagged = reuse.ttl_reuse(frame(spark, rows), "key", "ts", "id", 60, 4)
    assert {r.id for r in flagged.filter("hit").collect()} == plain(rows, 60)
    blocks = frame(spark, rows).selectExpr("key AS _key", "floor(unix_seconds(ts) / 240) AS _block")
    parts = blocks.repartition(8, "_key", "_block").selectExpr("spark_partition_id() AS part").distinct()
    assert parts.count() > 1


@pytest.mark.parametrize("held", [20_000, 3])
@pytest.mark.parametrize("files", [1, 3])
def test_stream_in_chunks(spark, tmp_path, held, files):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    rows = sorted(((i, k, s) for i, k, s in rows_of(5, 60)), key=lambda r: r[2])
    for f in range(files):
        part = rows[f * len(rows) // files : (f + 1) * len(rows) // files]
        more = [(1000 + f, None, START), (2000 + f, "a", None)]
        df = frame(spark, part).unionByName(spark.createDataFrame(more, "id long, key string, ts timestamp"))
        df.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{f}")
    stream = (
        spark.readStream.schema("id long, key string, ts timestamp")
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .parquet(f"file://{tmp_path}/in")
    )
    # Rows may arrive in any order of files, so files are compared by what a stream sees.
    flagged = flows.reuse_stream(stream, "key", "ts", "id", 30, held=held)
    flows.run_available(flagged, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert len(got) == len(rows) + 2 * files
    hits = {r["id"] for r in got if r["hit"]}
    assert not hits & {1000 + f for f in range(files)} | hits & {2000 + f for f in range(files)}
    if files == 1:
        assert hits == plain(rows, 30)


def test_scratch_of_a_block_goes(spark):
    kept = session.materialize(spark.range(5), "kept")
    with session.scratch_scope(spark):
        gone = session.materialize(spark.range(7), "gone")
        assert gone.count() == 7
        path = session._scope.paths[0]
    assert kept.count() == 5 and path not in session._scratch
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


class _Value:
    """A value state that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def test_a_key_asks_the_state_server_twice():
    import pandas as pd

    worker = flows.LastMiss("key", "bigint", 3600, 7200, False)
    worker.stored_at, worker.waiting = _Value(), None
    out = []
    for seconds, ids in [([0, 0, 3599, 3600], [2, 1, 3, 4]), ([7199, 7200], [5, 6])]:
        worker.stored_at.calls = 0
        chunk = pd.DataFrame({"key": "a", "id": ids, "event_sec": seconds})
        out += pd.concat(worker.handleInputRows(("a",), iter([chunk]), None))[["id", "hit"]].values.tolist()
        assert worker.stored_at.calls == 2
    assert [i for i, hit in out if not hit] == [1, 4, 6]
