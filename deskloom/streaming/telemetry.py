"""Telemetry of decisions by event time, and turns of a customer in order, on streams.

Both read the watermark themselves, so a row that comes too late is not dropped in silence but
leaves by an output of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds of a window, delay of the watermark, parts that a window and label are spread over.
WINDOW, DELAY, PARTS = 3600, "10 minutes", 2

_SUMS = "n long, ambiguous long, entropy_sum double, entropy_max double"


class WindowSums(StatefulProcessor):
    """Sums of one window, label and part; they leave when the watermark passes the window's end."""

    def __init__(self, window: int) -> None:
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", _SUMS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        end = (key[0] + self.window) * 1000
        late = end <= timerValues.getCurrentWatermarkInMs()
        n, ambiguous, total, most = self.sums.get() if not late and self.sums.exists() else (0, 0, 0.0, None)
        for chunk in rows:
            if late:
                yield pd.DataFrame(
                    {"kind": "late", "window": key[0], "label": key[1], "id": chunk["id"], "n": 1, "ambiguous": chunk["ambiguous"]}
                    | {"entropy_sum": chunk["entropy"], "entropy_max": chunk["entropy"]}
                )
                continue
            n += len(chunk)
            ambiguous += int(chunk["ambiguous"].sum())
            known = chunk["entropy"].dropna()
            if len(known):
                total += float(known.sum())
                most = float(known.max()) if most is None else max(most, float(known.max()))
        if not late:
            self.sums.update((n, ambiguous, total, most))
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        n, ambiguous, total, most = self.sums.get()
        self.sums.clear()
        row = {"kind": ["window"], "window": [key[0]], "label": [key[1]], "id": pd.array([None], "Int64"), "n": [n]}
        yield pd.DataFrame(row | {"ambiguous": [ambiguous], "entropy_sum": [total], "entropy_max": [most]})

    def close(self) -> None:
        pass


def telemetry_stream(
    decisions: DataFrame, ts: str, event_id: str, label: str, ambiguous: str, entropy: str,
    window: int = WINDOW, delay: str = DELAY, parts: int = PARTS,
) -> DataFrame:
    """Partial sums of closed event-time windows (kind ``window``) and the rows that came after
    their window had closed (kind ``late``, with their id). A window and label, however hot, is
    spread over ``parts`` states; ``telemetry_windows`` adds them up. Rows without a time have no
    window and are left out; null labels are a label. Needs the RocksDB state store."""
    second = F.unix_seconds(F.col(ts))
    rows = decisions.withWatermark(ts, delay).filter(F.col(ts).isNotNull())
    # The watermarked column itself goes no further, or Spark would drop late rows unseen.
    keyed = rows.select(
        (F.floor(second / F.lit(window)) * window).cast("long").alias("window"),
        F.col(label).cast("string").alias("label"),
        F.pmod(F.xxhash64(event_id), F.lit(parts)).cast("int").alias("part"),
        F.col(event_id).cast("long").alias("id"),
        F.coalesce(F.col(ambiguous).cast("long"), F.lit(0)).cast("long").alias("ambiguous"),
        F.col(entropy).cast("double").alias("entropy"),
    )
    return keyed.groupBy("window", "label", "part").transformWithStateInPandas(
        statefulProcessor=WindowSums(window),
        outputStructType=f"kind string, window long, label string, id long, {_SUMS}",
        outputMode="Append",
        timeMode="EventTime",
    )


def telemetry_windows(partials: DataFrame) -> DataFrame:
    """(window, label, n, ambiguous, entropy_sum, mean_entropy, entropy_max) of closed windows."""
    return (
        partials.filter("kind = 'window'")
        .groupBy(F.timestamp_seconds("window").alias("window"), "label")
        .agg(
            F.sum("n").alias("n"),
            F.sum("ambiguous").alias("ambiguous"),
            F.round(F.sum("entropy_sum"), 4).alias("entropy_sum"),
            (F.sum("entropy_sum") / F.sum("n")).alias("mean_entropy"),
            F.max("entropy_max").alias("entropy_max"),
        )
    )


class InOrder(StatefulProcessor):
    """Holds a customer's rows until the watermark has passed them, then releases them in order.

    Rows that arrive together wait as one entry of three arrays: a state entry for each row costs
    more than the work on it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us array<long>, id array<long>, payload array<string>")
        self.released = handle.getValueState("released", "n long, us long")
        self.next = handle.getValueState("next", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        earliest = None
        for chunk in rows:
            held = [chunk[name].tolist() for name in ("us", "id", "payload")]
            if now > 0 and held[0] and min(held[0]) // 1000 <= now:
                each = list(zip(*held))
                late = [r for r in each if r[0] // 1000 <= now]
                held = [list(c) for c in zip(*(r for r in each if r[0] // 1000 > now))]
                yield self._rows(key, late, None, None)
            if held and held[0]:
                self.waiting.appendValue(tuple(held))
                first = min(held[0]) // 1000
                earliest = first if earliest is None else min(first, earliest)
        if earliest is not None:
            known = self.next.get()
            if known is None or earliest < known[0]:
                self.next.update((earliest,))
                self.handle.registerTimer(earliest)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due, later = [], []
        for entry in self.waiting.get():
            for row in zip(*(np.asarray(c).tolist() for c in entry)):
                (due if row[0] // 1000 <= now else later).append(row)
        if later:
            self.waiting.put([tuple(list(c) for c in zip(*later))])
            first = min(r[0] for r in later) // 1000
            self.next.update((first,))
            self.handle.registerTimer(first)
        else:
            self.waiting.clear()
            self.next.clear()
        if due:
            due.sort()
            n, before = self.released.get() or (0, None)
            yield self._rows(key, due, n, before)
            self.released.update((n + len(due), due[-1][0]))

    def _rows(self, key: tuple, rows: list, n: int | None, before: int | None) -> pd.DataFrame:
        us, none = np.array([r[0] for r in rows], np.int64), np.full(len(rows), n is None)
        first = none.copy()
        first[0] |= before is None
        gaps = np.diff(us, prepend=us[0] if before is None else before)
        return pd.DataFrame(
            {
                "customer": key[0],
                "id": [r[1] for r in rows],
                "payload": [r[2] for r in rows],
                "us": us,
                "seq": pd.arrays.IntegerArray(np.arange(1, len(rows) + 1) + (n or 0), none),
                "gap_us": pd.arrays.IntegerArray(gaps, first),
                "late": n is None,
            }
        )

    def close(self) -> None:
        pass


def ordered_stream(
    turns: DataFrame, customer: str, ts: str, event_id: str, payload: str, delay: str = DELAY
) -> DataFrame:
    """(``customer``, id, payload, ts, seq, gap_us, late): each customer's rows in order of time and
    id, numbered, with the time since the one before, as soon as the watermark has passed them.

    A row that comes after that is given out at once, marked late and without a number. Rows
    of a customer that wait, no more than ``delay`` of event time, are held in the state store.
    Rows without a time are left out. Ids are unique. Needs the RocksDB state store."""
    rows = turns.withWatermark(ts, delay).filter(F.col(ts).isNotNull())
    keyed = rows.select(
        F.col(customer).alias("customer"),
        F.unix_micros(F.col(ts)).alias("us"),
        F.col(event_id).cast("long").alias("id"),
        F.col(payload).cast("string").alias("payload"),
    )
    schema = T.StructType(
        [
            keyed.schema["customer"],
            T.StructField("id", T.LongType()),
            T.StructField("payload", T.StringType()),
            T.StructField("us", T.LongType()),
            T.StructField("seq", T.LongType()),
            T.StructField("gap_us", T.LongType()),
            T.StructField("late", T.BooleanType()),
        ]
    )
    found = keyed.groupBy("customer").transformWithStateInPandas(
        statefulProcessor=InOrder(), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
    return found.select(
        F.col("customer").alias(customer), "id", "payload", F.timestamp_micros("us").alias("ts"), "seq", "gap_us", "late"
    )


def run_to_end(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there, with a last batch that moves the watermark, and stop."""
    df.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    writer.outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
