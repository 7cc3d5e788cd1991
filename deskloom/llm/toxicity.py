"""Toxicity by compression distance: two zstandard dictionaries, ordinary and toxic.

A window of ``WINDOW`` words is compressed once with the ordinary dictionary and once with the
toxic one before it; the bytes saved are the distance. A text's distances (how many windows
save so much, their mean) go through a logistic scale that is fitted on labelled texts which
neither dictionary has seen.

The dictionaries are trained on a bounded sample of labelled rows (``Bounds``), chosen by a hash
of the id. Toxic words are few among ordinary ones in a toxic text, so the toxic samples are
those words of toxic texts that are far more frequent there and stand in varied contexts (a
copied passage has the same neighbours everywhere). Scoring reads every whole text in the
order of the scan, without a shuffle; only dictionaries and weights are broadcast.

Empty and null texts get the score of a text without windows. Without toxic labels the score
is 0. Rows with a null id are scored, never learned from, and not held out. Repeated label rows
count once, toxic if any of them is. Nothing but the text enters a score.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskloom.llm.common import map_texts

WINDOW, LEVEL, LEAST_MATCH = 12, 13, 4
ORDINARY_BYTES, TOXIC_BYTES = 8192, 8192
#: Bytes saved that are counted; mean saving and number of windows follow as features.
SAVED = (1, 2, 3, 4, 5, 6)
RATES = (1, 2, 3)
N_FEATURES = len(SAVED) + len(RATES) + 2
#: A toxic sample word: share of toxic texts, times as frequent as in ordinary ones, contexts per text.
LEAST_SHARE, LEAST_RATIO, LEAST_CONTEXTS = 0.01, 8.0, 0.7
THRESHOLD = 0.7


@dataclass(frozen=True)
class Bounds:
    """Labelled rows that are learned from, at most, and bytes of a text used for dictionaries."""

    toxic: int = 2000
    ordinary: int = 4000
    scale: int = 6000
    text_bytes: int = 16384


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = ((features - self.centre) / self.spread) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    words = text.lower().split()
    return [b" ".join(words[i : i + size]) for i in range(0, len(words), size)]


def _dictionary(samples: Sequence[bytes], size: int) -> bytes:
    """Trained on the samples; their own text where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, list(samples)).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def dictionaries(toxic: Sequence[bytes], ordinary: Sequence[bytes]) -> tuple[bytes, bytes]:
    """(ordinary, toxic followed by ordinary) dictionary contents."""
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary))
    inside, outside = Counter(), Counter()
    for text in toxic:
        inside.update(set(text.lower().split()))
    for text in ordinary:
        outside.update(set(text.lower().split()))
    before: dict[bytes, set] = {}
    for text in toxic:
        last = b""
        for word in text.lower().split():
            before.setdefault(word, set()).add(last)
            last = word

    def telling(word: bytes) -> bool:
        n = inside[word]
        if n < max(3, LEAST_SHARE * len(toxic)) or len(before[word]) < LEAST_CONTEXTS * n:
            return False
        return n / len(toxic) >= LEAST_RATIO * (outside[word] + 0.5) / max(1, len(ordinary))

    chosen = {word for word in inside if telling(word)}
    plain = [w for text in ordinary for w in windows(text, 4)]
    random.Random(7).shuffle(plain)
    common = _dictionary(plain[:100_000], ORDINARY_BYTES)
    samples = [w + b" " for text in toxic for w in text.lower().split() if w in chosen]
    return common, (_dictionary(samples, TOXIC_BYTES) if samples else b"") + common


def feature_function(ordinary: bytes, toxic: bytes):
    """Function from a text to its features."""
    settings = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, min_match=LEAST_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False
    )

    def compressor(content: bytes):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(compression_params=settings, dict_data=held).compress

    plain, rude = compressor(ordinary), compressor(toxic)

    def features(text: bytes) -> list[float]:
        parts = windows(text)
        if not parts:
            return [0.0] * N_FEATURES
        saved = np.array([len(plain(w)) - len(rude(w)) for w in parts])
        least = [int((saved >= k).sum()) for k in SAVED]
        rates = [least[SAVED.index(k)] / len(parts) for k in RATES]
        return [*np.log1p(least), *rates, saved.mean(), np.log1p(len(parts))]

    return features


def logistic(features: np.ndarray, truth: np.ndarray, ridge: float = 1e-2, rounds: int = 50):
    """(centre, spread, weights with the intercept last) by Newton steps."""
    centre, spread = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.c_[(features - centre) / spread, np.ones(len(features))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        bend = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(bend, x.T @ (p - truth) + ridge * w)
    return centre, spread, w


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 3).cast("int")


def _sample(labels: DataFrame, n: int, wanted: Column) -> DataFrame:
    return labels.filter(wanted).orderBy(F.xxhash64("id"), "id").limit(n)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label_id: str = "doc_id",
    label: str = "toxic",
    held_out: int = 1,
    bounds: Bounds = Bounds(),
) -> Model:
    """Dictionaries from one fold of the labelled rows, the scale from the other."""
    learn = [f for f in range(3) if f != held_out]
    known = (
        labels.select(F.col(f"`{label_id}`").alias("id"), F.col(f"`{label}`").alias("is"))
        .filter(F.col("id").isNotNull() & F.col("is").isNotNull())
        .groupBy("id")
        .agg(F.max("is").alias("is"))
        .withColumn("fold", fold(F.col("id")))
    )
    first, second = F.col("fold") == learn[0], F.col("fold") == learn[1]
    toxic, plain = F.col("is") == 1, F.col("is") != 1
    chosen = (
        _sample(known, bounds.toxic, first & toxic)
        .unionByName(_sample(known, bounds.ordinary, first & plain))
        .unionByName(_sample(known, bounds.scale, second))
    )
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), body.alias("text"))
    labelled = rows.join(F.broadcast(chosen), "id")  # at most the sum of the bounds
    short = F.octet_length("text") <= bounds.text_bytes
    most = bounds.toxic + bounds.ordinary
    seen = labelled.filter(short & first).select("text", "is").limit(most).collect()
    common, rude = dictionaries(
        [r[0].encode() for r in seen if r[1] == 1], [r[0].encode() for r in seen if r[1] != 1]
    )
    measured = _features(labelled.filter(second).limit(bounds.scale), "text", ["is"], common, rude).select("row.is", "x")
    found = measured.collect()
    truth = np.array([float(r[0] == 1) for r in found])
    if not truth.any():
        none = np.zeros(N_FEATURES)
        return Model(common, rude, none, none + 1, np.append(none, -60.0))
    return Model(common, rude, *logistic(np.array([r[1] for r in found]), truth))


def _features(rows: DataFrame, text: str, keep: Sequence[str], common: bytes, rude: bytes) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((common, rude))

    def make():
        features = feature_function(*shared.value)

        def apply(texts: list[bytes]) -> list[pa.Array]:
            return [pa.array([features(t) for t in texts], pa.list_(pa.float64()))]

        return apply

    return map_texts(rows, text, keep, [T.StructField("x", T.ArrayType(T.DoubleType()))], make)


def scored(docs: DataFrame, model: Model, keep: Sequence[str], text: str = "text") -> DataFrame:
    """(row struct of ``keep``, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        held = shared.value
        features = feature_function(held.ordinary, held.toxic)

        def apply(texts: list[bytes]) -> list[pa.Array]:
            x = np.array([features(t) for t in texts]).reshape(len(texts), N_FEATURES)
            return [pa.array(held.scores(x), pa.float64())]

        return apply

    return map_texts(docs, text, keep, [T.StructField("score", T.DoubleType())], make)
