"""Streaming forms: the batch functions on unbounded inputs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from deskloom.functions.text import fingerprint
from deskloom.operators.reuse import TTL_SECONDS, miss_places
from deskloom.operators.store import PairStore
from deskloom.operators.vectors import LexicalIndex, build_index
from deskloom.plans.decide import decide
from deskloom.session import scratch_scope


def decide_stream(
    cases: DataFrame,
    vault: DataFrame,
    path: str,
    checkpoint: str,
    index: LexicalIndex | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Decide every arriving case against a static vault; one folder per micro-batch.

    Rewriting a batch's folder on a retry keeps the output exactly-once. The precedent
    index is built once, before the first batch. Intermediate tables of a batch are deleted once
    it is written, so the stream may run for ever.
    """
    index = index or build_index(
        vault.select("pair_id", "intent", "customer_query"), "pair_id", "intent", "customer_query"
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            decide(batch, vault, index=index).write.mode("overwrite").parquet(
                f"{path}/batch={batch_id}"
            )

    writer = cases.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def decide_stream_versions(
    cases: DataFrame, store: PairStore, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Decide every arriving case against the newest version of a store at the time of its
    micro-batch. The index is made anew only when the version has changed; output rows name it."""
    held: dict[str, object] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        version = store.latest()
        if held.get("version") != version:
            held.update(version=version, index=store.index(version))
        with scratch_scope(batch.sparkSession):
            decided = decide(batch, store.pairs(version), index=held["index"])
            decided.withColumn("store_version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = cases.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


#: Rows of a key and micro-batch that a worker holds; more go through the state store.
HELD_ROWS = 20_000


def _plain(chunk: pd.DataFrame, name: str) -> bool:
    """Whether ids and seconds are integers without nulls; most keys have a few such rows, and
    pandas' grouping costs them more than the work itself."""
    return all(isinstance(d, np.dtype) and d.kind == "i" for d in (chunk["event_sec"].dtype, chunk[name].dtype))


def _least_ids(chunk: pd.DataFrame, name: str) -> Iterator[tuple]:
    """(second, least id) of the rows that have a time."""
    if not _plain(chunk, name):
        yield from chunk.dropna(subset=["event_sec"]).groupby("event_sec")[name].min().items()
        return
    least: dict[int, int] = {}
    for second, number in zip(chunk["event_sec"].tolist(), chunk[name].tolist()):
        known = least.get(second)
        least[second] = number if known is None or number < known else known
    yield from least.items()


class LastMiss(StatefulProcessor):
    """Remembers, per key, the event time of the last miss; one number.

    The misses of a micro-batch follow from its distinct seconds, of which there are no more
    than clock time allows; only they are sorted. Its rows are marked chunk by chunk afterwards,
    and those beyond ``HELD_ROWS`` wait in the state store, so a hot key needs no more memory than
    others. The number is forgotten when the key has been silent for ``forget`` of wall-clock
    time, which must exceed the ttl and the lateness of events.
    """

    def __init__(self, key: str, id_type: str, ttl: int, forget: int, only_misses: bool, held: int = HELD_ROWS) -> None:
        self.key, self.id_type = key, id_type
        self.ttl, self.forget, self.only_misses, self.held = ttl, forget, only_misses, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored_at = handle.getValueState("stored_at", "sec long", self.forget * 1000)
        self.waiting = handle.getListState("waiting", f"id {self.id_type}, sec long")

    def handleInputRows(
        self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object
    ) -> Iterator[pd.DataFrame]:
        names, chunks, held, spilled = [], [], 0, False
        first: dict[int, object] = {}  # second: least id
        for chunk in rows:
            if not len(chunk):
                continue
            names = list(chunk.columns)
            for second, least in _least_ids(chunk, names[1]):
                known = first.get(int(second))
                first[int(second)] = least if known is None else min(known, least)
            if held + len(chunk) <= self.held:
                chunks.append(chunk)
                held += len(chunk)
            else:
                seconds = [None if pd.isna(s) else int(s) for s in chunk["event_sec"]]
                self.waiting.appendList(list(zip(chunk[names[1]].tolist(), seconds)))
                spilled = True
        missed: set = set()
        if key[0] is not None and first:  # null keys and times are misses, never stored
            seconds = np.array(sorted(first), np.int64)
            last = self.stored_at.get()  # None if there is none; every call goes to the state server
            stored = last[0] if last is not None else None
            places, stored = miss_places(seconds, stored, self.ttl)
            missed = {first[int(s)] for s in seconds[places]}
            self.stored_at.update((stored,))
        for chunk in chunks:
            yield from self._marked(chunk, key[0], missed, names)
        if spilled:
            part = []
            for row in self.waiting.get():
                part.append(row)
                if len(part) == self.held:
                    yield from self._marked(self._frame(part, key[0], names), key[0], missed, names)
                    part = []
            if part:
                yield from self._marked(self._frame(part, key[0], names), key[0], missed, names)
            self.waiting.clear()

    def _frame(self, rows: list[tuple], key: object, names: list[str]) -> pd.DataFrame:
        ids, seconds = zip(*rows)
        return pd.DataFrame({names[0]: [key] * len(ids), names[1]: ids, names[2]: pd.array(seconds, "Int64")})

    def _marked(self, chunk: pd.DataFrame, key: object, missed: set, names: list[str]) -> Iterator[pd.DataFrame]:
        chunk = chunk.copy()
        if key is not None and _plain(chunk, names[1]):
            chunk["hit"] = np.array([i not in missed for i in chunk[names[1]].tolist()], bool)
        else:
            untimed = chunk["event_sec"].isna().to_numpy() | (key is None)
            chunk["hit"] = ~(untimed | chunk[names[1]].isin(missed).to_numpy())
        chunk[self.key] = key
        yield chunk[~chunk["hit"]] if self.only_misses else chunk

    def close(self) -> None:
        pass


#: Seconds of wall-clock silence after which a key's state is forgotten.
FORGET = 7 * 86400


def _by_last_miss(
    events: DataFrame, key: str, ts: str, event_id: str, ttl: int, forget: int, only_misses: bool, held: int = HELD_ROWS
) -> DataFrame:
    second = F.unix_seconds(F.col(ts).cast("timestamp")).alias("event_sec")
    timed = events.select(key, event_id, second)
    id_type = timed.schema[event_id].dataType.simpleString()
    schema = T.StructType([*timed.schema.fields, T.StructField("hit", T.BooleanType())])
    return timed.groupBy(key).transformWithStateInPandas(
        statefulProcessor=LastMiss(key, id_type, ttl, forget, only_misses, held),
        outputStructType=schema,
        outputMode="Append",
        timeMode="ProcessingTime",
    )


def dedup_stream(
    requests: DataFrame,
    text: str,
    ts: str,
    request_id: str,
    horizon: int = TTL_SECONDS,
    forget: int = FORGET,
) -> DataFrame:
    """(text_key, request id) of the requests that stay: those without a kept request of the
    same normalised text less than ``horizon`` seconds before, in event time.

    The result doesn't depend on how the requests fall into micro-batches as long as these
    follow the event time; a late request is compared with the last kept one.
    """
    keyed = requests.withColumn("text_key", fingerprint(F.col(text)))
    return _by_last_miss(keyed, "text_key", ts, request_id, horizon, forget, True).select("text_key", request_id)


def reuse_stream(
    events: DataFrame,
    key: str,
    ts: str,
    event_id: str,
    ttl: int = TTL_SECONDS,
    forget: int = FORGET,
    held: int = HELD_ROWS,
) -> DataFrame:
    """(key, event id, hit) of a stream: reuse with a time-to-live fixed at the miss.

    State is one number per key, and a large micro-batch's rows while it is worked on (``held``
    of a key stay in memory). Needs the RocksDB state store; event ids are unique.
    """
    return _by_last_miss(events, key, ts, event_id, ttl, forget, False, held).select(key, event_id, "hit")


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that is there, append to a Parquet folder, and stop.

    State with a time-to-live asks for another batch for ever; batches without data are off.
    """
    df.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    query = (
        df.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
