"""Telemetry, order, drift and latency sketches over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskloom.catalog.base import query, table
from deskloom.catalog.job_queries import _rocksdb, _stream
from deskloom.functions.probabilities import entropy
from deskloom.operators import drift as D
from deskloom.session import materialize, scratch_path
from deskloom.streaming import telemetry as T

# An event's value as the odds of the first of two classes.
_P = "(value + 1) / (value + 51)"
_SCORED_SQL = f"""scored AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec,
    round(-(p * log2(p)) - (1 - p) * log2(1 - p), 4) AS bits, abs(2 * p - 1) < 0.15 OR greatest(p, 1 - p) < 0.60 AS unsure
    FROM (SELECT event_id, ts, event_type, {_P} AS p FROM events))"""


_TOLD = ("n", "ambiguous", "entropy_sum", "entropy_max")


def _arriving(spark, sf):
    return _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _scored(events):
    p = F.expr(_P)
    lead, best = F.abs(2 * p - 1), F.greatest(p, 1 - p)
    return events.select(
        "event_id", "ts", "event_type", entropy(F.array(p, 1 - p)).alias("bits"), ((lead < 0.15) | (best < 0.60)).alias("unsure")
    )


@query(
    "stream_telemetry",
    f"""WITH {_SCORED_SQL}, closed AS (SELECT epoch_ms(max(ts)) - 600000 AS ms FROM events)
    SELECT (sec // 3600) * 3600 AS window_sec, event_type AS label, count(*) AS n,
      count(*) FILTER (unsure) AS ambiguous, round(sum(bits), 4) AS entropy_sum, max(bits) AS entropy_max
    FROM scored, closed WHERE ((sec // 3600) + 1) * 3600000 <= ms GROUP BY ALL""",
)
def stream_telemetry(spark, sf):
    """Hourly counts, doubts and entropy of decisions, from closed windows."""
    _rocksdb(spark)
    decisions = _scored(_arriving(spark, sf))
    partials = T.telemetry_stream(decisions, "ts", "event_id", "event_type", "unsure", "bits")
    out = scratch_path(spark, "telemetry")
    T.run_to_end(partials, out, scratch_path(spark, "stream-state"))
    return T.telemetry_windows(spark.read.parquet(out)).select(F.unix_seconds("window").alias("window_sec"), "label", *_TOLD)


@query(
    "stream_ordered",
    """SELECT user_id, event_id AS id, event_type AS payload, epoch_us(ts) AS us, row_number() OVER w AS seq,
      epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap_us, false AS late
    FROM events, (SELECT epoch_ms(max(ts)) - 600000 AS ms FROM events) WHERE epoch_ms(ts) <= ms
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def stream_ordered(spark, sf):
    """Every user's events in order, numbered, once the watermark has passed them."""
    _rocksdb(spark)
    found = T.ordered_stream(_arriving(spark, sf), "user_id", "ts", "event_id", "event_type")
    out = scratch_path(spark, "ordered")
    T.run_to_end(found, out, scratch_path(spark, "stream-state"))
    return spark.read.parquet(out).withColumn("us", F.unix_micros("ts")).drop("ts")


@query(
    "score_drift",
    """WITH b AS (SELECT event_type, date_trunc('day', ts)::DATE AS day,
        greatest(0, least(49, floor(value / 2.0)))::INTEGER AS bin FROM events WHERE value IS NOT NULL),
    c AS (SELECT event_type, day, bin, count(*) AS n FROM b GROUP BY ALL),
    start AS (SELECT min(day) AS first FROM b),
    r AS (SELECT event_type, bin, sum(n) AS m FROM c, start WHERE day < first + 7 GROUP BY ALL),
    w AS (SELECT DISTINCT event_type, day FROM c, start WHERE day >= first + 7),
    grid AS (SELECT event_type, day, unnest(range(50)) AS bin FROM w),
    f AS (SELECT event_type, day, bin, coalesce(c.n, 0) AS n, coalesce(r.m, 0) AS m FROM grid
      LEFT JOIN c USING (event_type, day, bin) LEFT JOIN r USING (event_type, bin)),
    k AS (SELECT *, abs(sum(n) OVER u / sum(n) OVER a - sum(m) OVER u / sum(m) OVER a) AS apart FROM f
      WINDOW a AS (PARTITION BY event_type, day), u AS (PARTITION BY event_type, day ORDER BY bin)),
    d AS (SELECT event_type, day, sum(n)::BIGINT AS n, sum(m)::BIGINT AS n_reference, round(max(apart), 6) AS distance,
      round(1.358 * sqrt((sum(n) + sum(m)) / (sum(n) * sum(m))), 6) AS "limit" FROM k GROUP BY ALL HAVING sum(m) > 0)
    SELECT *, distance > "limit" AS drifted FROM d""",
)
def score_drift(spark, sf):
    """Each day's scores of a type against those of the first week."""
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    daily = materialize(D.bin_counts(events, ["event_type", "day"], "value", 0.0, 100.0), "bin-counts")
    first = daily.agg(F.min("day").alias("first"))
    dated = daily.crossJoin(F.broadcast(first)).withColumn("early", F.col("day") < F.date_add("first", 7))  # one row
    reference = D.merged_counts(dated.filter("early"), ["event_type"])
    return D.distances(dated.filter("NOT early"), reference, ["day"], ["event_type"])


_SHARES = (50.0, 90.0, 95.0, 99.0)


@query(
    "latency_sketches",
    """SELECT event_type, count(*) AS n, true AS within FROM events WHERE value IS NOT NULL GROUP BY event_type""",
)
def latency_sketches(spark, sf):
    """Hourly sketches merged per type: ranks of their quantiles against the rows themselves."""
    events = table(spark, sf, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    hourly = materialize(D.latency_sketches(events, ["event_type", "hour"], "value"), "latency-sketches")
    found = D.merged_quantiles(hourly, ["event_type"], _SHARES)
    errors = D.rank_errors(events, found, ["event_type"], "value", _SHARES)
    return errors.select("event_type", "n", (F.col("error") <= D.RANK_ERROR).alias("within"))
