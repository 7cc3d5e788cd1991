"""Result reuse with a time-to-live: which requests are answered from an earlier result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskloom.session import materialize

TTL_SECONDS = 3600


def miss_places(seconds: np.ndarray, stored: int | None, ttl: int) -> tuple[list[int], int | None]:
    """(places of the misses among ascending times, stored time afterwards).

    A time before ``stored`` is a hit if it is less than ``ttl`` earlier; else it is a miss
    whose result isn't kept, as a later one is there already.
    """
    places, at, n = [], 0, len(seconds)
    if stored is not None:
        late = int(np.searchsorted(seconds, stored - ttl, side="right"))
        places.extend(range(late))
        at = int(np.searchsorted(seconds, stored + ttl, side="left"))
    while at < n:
        stored = int(seconds[at])
        places.append(at)
        at = int(np.searchsorted(seconds, stored + ttl, side="left"))
    return places, stored


#: Times to live in a block of a key's seconds: the rows of a block are bounded by clock time.
SPAN = 256


def block_exits(seconds: np.ndarray, start: int, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries, exits) of a block's ascending distinct seconds.

    The last miss before the block is older than ``start``, so the block's first miss is one of
    the seconds less than ``ttl`` after it, or the next one. Each second points at the next miss
    after it; doubling the pointers leads every entry to the last miss inside the block.
    """
    following = np.searchsorted(seconds, seconds + ttl)
    jump = np.append(following, len(seconds))
    last = np.arange(len(seconds) + 1)
    while (jump[:-1] < len(seconds)).any():
        last = np.where(jump < len(seconds), last[np.minimum(jump, len(seconds))], last)
        jump = jump[jump]
    n = min(len(seconds), int(np.searchsorted(seconds, start + ttl)) + 1)
    return seconds[:n], seconds[last[:n]]


def _groups(batches: Iterator[pa.RecordBatch], columns: int):
    """(key, block, arrays of the other columns) of rows sorted by key and block."""
    name, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, blocks = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        changed = np.array(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False), bool) | (np.diff(blocks) != 0)
        cut = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:]):
            here = (keys[a].as_py(), int(blocks[a]))
            if here != name:
                if held:
                    yield *name, [pa.concat_arrays(c) for c in zip(*held)]
                name, held = here, []
            held.append([batch.column(2 + i)[a : b] for i in range(columns)])
    if held:
        yield *name, [pa.concat_arrays(c) for c in zip(*held)]


def _summaries(ttl: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block, (seconds,) in _groups(batches, 1):
            entries, exits = block_exits(seconds.to_numpy(zero_copy_only=False), block * width, ttl)
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (entries, exits)]
            columns = [pa.array([key], pa.string()), pa.array([block], pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "_block", "entries", "exits"])

    return run


def _entries(ttl: int):
    """The second at which each block's misses begin, from summaries sorted by (key, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, stored = None, None
        for batch in batches:
            keys, begins = batch.column(0).to_pylist(), []
            for key, entries, exits in zip(keys, batch.column(2), batch.column(3)):
                if key != last:
                    last, stored = key, None
                entry = entries.values.to_numpy()
                at = 0 if stored is None else int(np.searchsorted(entry, stored + ttl))
                begins.append(int(entry[at]) if at < len(entry) else None)
                if at < len(entry):
                    stored = exits.values[at].as_py()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(begins, pa.int64())], names=["_key", "_block", "_sec"]
            )

    return run


def _misses(ttl: int):
    """Ids of the missed seconds, from a block's entry (without an id) and its seconds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, (seconds, ids, first) in _groups(batches, 3):
            entry, at = seconds[0].as_py(), seconds[1:].to_numpy(zero_copy_only=False)
            assert first[0].as_py() and len(at) == len(seconds) - 1
            if entry is None:
                continue
            begin = int(np.searchsorted(at, entry))
            places, _ = miss_places(at[begin:], None, ttl)
            found = ids[1:].take(pa.array(np.array(places, np.int64) + begin))
            yield pa.RecordBatch.from_arrays([found], names=["_miss_id"])

    return run


def ttl_reuse(
    events: DataFrame, key: str, ts: str, event_id: str, ttl: int = TTL_SECONDS, span: int = SPAN
) -> DataFrame:
    """Events with ``hit``: true iff a result of the same key is younger than ``ttl``.

    A result is stored at a miss and reads do not extend it. Which misses follow depends
    on earlier misses, so a key is one chain; but only its distinct seconds matter. They are
    merged before the shuffle and cut into blocks of ``span`` times to live, so one key is many
    tasks: each block tells where its chain ends for every second at which it may begin, a walk
    over a key's blocks (one row each) finds where they do begin, and the blocks mark their
    misses. A null key or time is always a miss.
    """
    width = span * ttl
    second = F.unix_seconds(F.col(ts).cast("timestamp"))
    timed = events.select(F.col(key).cast("string").alias("_key"), second.alias("_sec"), F.col(event_id).alias("_id"))
    per_second = timed.dropna(subset=["_key", "_sec"]).groupBy("_key", "_sec").agg(F.min("_id").alias("_first"))
    block = F.floor(F.col("_sec") / F.lit(width)).cast("long")
    blocked = materialize(per_second.select("_key", block.alias("_block"), "_sec", "_first"), "seconds")

    def together(df: DataFrame, *order: str) -> DataFrame:
        return df.repartition("_key", "_block").sortWithinPartitions("_key", "_block", *order)

    name = "_key string, _block long"
    ends = together(blocked.select("_key", "_block", "_sec"), "_sec").mapInArrow(
        _summaries(ttl, width), f"{name}, entries array<long>, exits array<long>"
    )
    chains = ends.repartition("_key").sortWithinPartitions("_key", "_block")
    begins = chains.mapInArrow(_entries(ttl), f"{name}, _sec long")
    id_type = events.schema[event_id].dataType
    rows = blocked.withColumn("_entry", F.lit(False)).unionByName(
        begins.select("_key", "_block", "_sec", F.lit(None).cast(id_type).alias("_first"), F.lit(True).alias("_entry"))
    )
    marked = rows.withColumn("_later", ~F.col("_entry"))
    ordered = together(marked, "_later", "_sec").select("_key", "_block", "_sec", "_first", "_entry")
    # The earliest event of a missed second computes the result; the others reuse it.
    first = ordered.mapInArrow(_misses(ttl), T.StructType([T.StructField("_miss_id", id_type)]))
    known = F.col(key).isNotNull() & F.col(ts).isNotNull()
    return events.join(first, F.col(event_id) == F.col("_miss_id"), "left").select(
        *events.columns, (F.col("_miss_id").isNull() & known).alias("hit")
    )


def reuse_summary(flagged: DataFrame, key: str) -> DataFrame:
    """Hits and misses per key."""
    return flagged.groupBy(key).agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")
    )
