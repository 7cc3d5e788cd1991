"""Mixing to target weights with soft membership.

A classifier fitted on a labelled table gives every document posteriors over domains. Rates r_d
(expected copies) then meet the targets and move as little as they can:

    min  1/2 sum_k (sum_d r_d n_d p_dk - T_k)^2 / T_k  +  1/2 ridge sum_d n_d (r_d - 1)^2

over 0 <= r_d <= ``MOST``, with n_d tokens, posteriors p_dk and targets T_k, by projected
gradient steps on the rates (Nesterov's, restarted where the step turns back):

    r_d <- clip(y_d - step * (sum_k p_dk (t_k - T_k) / T_k + ridge (y_d - 1)), 0, MOST)

with t_k the expected tokens under y. The gradient is divided by n_d, so documents with equal
posteriors have equal rates: posteriors are rounded to multiples of 1 / ``GRAIN``, documents with
equal ones are merged (one aggregate with partial sums), and a step is an aggregate over the
merged table. A step's K residuals are all that reaches the driver; rates are replayed from the
residuals of the steps, so nothing per document is stored or moved.

Residuals are divided by the targets: a domain whose posteriors are tiny everywhere pulls no more
than its tokens, and its own documents get at most ``MOST`` copies. What remains unmet is reported
(``Rates.expected`` against ``Rates.wanted``).

Empty and null texts have no tokens, the posteriors of an empty text, and a rate like others.
Repeated rows get equal rates. Without labels there is one posterior for all, the even one; with
no tokens at all every rate is 1. Empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskloom.llm.common import map_texts, written

#: Labelled rows learned from at most, text bytes of one, words of the vocabulary.
LEARNED, LEARNED_BYTES, VOCABULARY = 8000, 16384, 50_000
#: Ridge (moves a reachable total by less than itself, relative to it), greatest rate, grain of the posteriors.
RIDGE, MOST, GRAIN = 1e-3, 8.0, 1024
#: Steps at most; root mean square move of a rate by a step (by tokens) at which they end.
STEPS, STILL = 200, 1e-5

_SHAPES = 4


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    words: dict[bytes, int]
    odds: np.ndarray  # word by domain; row 0 is for unknown words
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[(x - self.centre) / self.spread, np.ones(len(x))] @ self.weights
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _features(words: dict[bytes, int], odds: np.ndarray, text: bytes) -> tuple[int, np.ndarray]:
    """(tokens, mean and largest log-odds by domain and shares of shapes)."""
    found = text.lower().split()
    k = odds.shape[1]
    if not found:
        return 0, np.zeros(2 * k + _SHAPES)
    each = odds[np.fromiter(map(words.get, found, repeat(0)), np.int64, len(found))]
    size = len(text)
    lower = len(text.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    upper = size - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    signs = size - len(text.translate(None, b"#*$%&|<>!"))
    shapes = [upper / size, signs / size, lower / size, len(set(found)) / len(found)]
    return len(found), np.concatenate((each.mean(axis=0), each.max(axis=0), shapes))


def fit_classifier(samples: Sequence[tuple[bytes, str]]) -> Classifier:
    """From (text, domain): naive Bayes odds on one half, softmax regression on the other."""
    domains = tuple(sorted({d for _, d in samples})) or ("all",)
    k = len(domains)
    size = 2 * k + _SHAPES
    if k == 1:
        return Classifier(domains, {}, np.zeros((1, 1)), np.zeros(size), np.ones(size), np.zeros((size + 1, 1)))
    number = {d: i for i, d in enumerate(domains)}
    first, second = samples[::2], samples[1::2]
    counts, rows = [Counter() for _ in domains], np.ones(k)
    for text, domain in first:
        counts[number[domain]].update(set(text.lower().split()))
        rows[number[domain]] += 1
    total = Counter()
    for c in counts:
        total.update(c)
    chosen = sorted((w for w, n in total.items() if n >= 5), key=lambda w: (-total[w], w))[:VOCABULARY]
    words = {w: i + 1 for i, w in enumerate(chosen)}
    share = np.array([[0.0] * k] + [[c[w] for c in counts] for w in chosen])
    inside = (share + 0.5) / (rows + 1)
    outside = (share.sum(axis=1, keepdims=True) - share + 0.5) / (rows.sum() - rows + 1)
    odds = np.log(inside / outside)
    odds[0] = 0
    x = np.array([_features(words, odds, text)[1] for text, _ in second])
    y = np.eye(k)[[number[d] for _, d in second]]
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - centre) / spread, np.ones(len(x))]
    weights = np.zeros((z.shape[1], k))
    step = 4.0 / np.linalg.norm(z, ord=2) ** 2
    for _ in range(1500):
        p = np.exp(z @ weights - (z @ weights).max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        weights -= step * (z.T @ (p - y) + 1e-2 * weights)
    return Classifier(domains, words, odds, centre, spread, weights)


def train(
    docs: DataFrame, labels: DataFrame, domain: Column, text: str = "text", doc_id: str = "doc_id", most: int = LEARNED
) -> Classifier:
    """Classifier for ``domain``, an expression over ``labels`` (null: not learned from), from at
    most ``most`` labelled texts of at most ``LEARNED_BYTES``, chosen by a hash of the id."""
    known = labels.select(F.col(doc_id).alias("id"), domain.alias("domain")).dropna()
    known = known.groupBy("id").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("id"), "id").limit(most)
    body = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), body.alias("text"))
    rows = rows.filter(F.octet_length("text") <= LEARNED_BYTES).join(F.broadcast(known), "id").limit(most)
    found = sorted({(r["text"].encode(), r["domain"]) for r in rows.select("text", "domain").collect()})
    order = np.random.default_rng(7).permutation(len(found))
    return fit_classifier([found[i] for i in order])


def memberships(docs: DataFrame, classifier: Classifier, keep: Sequence[str], text: str = "text") -> DataFrame:
    """(row struct of ``keep``, n_tokens, p: array of posteriors) of every row, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def make():
        held = shared.value

        def apply(texts: list[bytes]) -> list[pa.Array]:
            sizes, x = zip(*(_features(held.words, held.odds, t) for t in texts))
            p = held.posteriors(np.array(x))
            return [pa.array(sizes, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))]

        return apply

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))]
    return map_texts(docs, text, keep, fields, make)


@dataclass(frozen=True)
class Rates:
    """Steps of a fit, from which the rate of any posterior is replayed."""

    pulls: np.ndarray  # residuals over targets, a row per step
    momenta: np.ndarray
    step: float
    ridge: float
    most: float
    wanted: dict[str, float]
    expected: dict[str, float]

    def of(self, p: np.ndarray) -> np.ndarray:
        """Rates of posteriors, one row each."""
        return replay(rounded(p), self.pulls, self.momenta, self.step, self.ridge, self.most)[0]

    def column(self, p: Column) -> Column:
        size = len(self.wanted)

        def rate(x: pa.Array) -> pa.Array:
            return pa.array(self.of(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)), pa.float64())

        return F.arrow_udf(rate, "double")(p)


def rounded(p: np.ndarray) -> np.ndarray:
    """Posteriors in multiples of 1 / GRAIN; they need not add up to 1."""
    return np.floor(p * GRAIN + 0.5) / GRAIN


def replay(
    p: np.ndarray, pulls: np.ndarray, momenta: np.ndarray, step: float, ridge: float, most: float
) -> tuple[np.ndarray, np.ndarray]:
    """(rates after the steps, rates before the last one)."""
    rate = before = np.ones(len(p))
    for pull, momentum in zip(pulls, momenta):
        ahead = rate + momentum * (rate - before)
        before, rate = rate, np.clip(ahead - step * (p @ pull + ridge * (ahead - 1)), 0, most)
    return rate, before


def _totals(merged: DataFrame, size: int, pulls: np.ndarray, momenta: np.ndarray, step: float, ridge: float, most: float):
    """(tokens by domain under the rates, and under those before, tokens times squared move,
    tokens times (look-ahead - rate) times move): sums over the merged table."""
    shape = np.array(pulls).reshape(-1, size), np.array(momenta)

    def run(batches):
        total = np.zeros(2 * size + 2)
        for batch in batches:
            n = batch.column(0).to_numpy()
            p = batch.column(1).flatten().to_numpy().reshape(-1, size) / GRAIN
            rate, before = replay(p, *shape, step, ridge, most)
            older = replay(p, shape[0][:-1], shape[1][:-1], step, ridge, most)[1] if len(shape[0]) else before
            ahead = before + (shape[1][-1] * (before - older) if len(shape[0]) else 0)
            total[:size] += (n * rate) @ p
            total[size:-2] += (n * before) @ p
            total[-2] += n @ (rate - before) ** 2
            total[-1] += n @ ((ahead - rate) * (rate - before))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=[f"x{i}" for i in range(len(total))])

    schema = ", ".join(f"x{i} double" for i in range(2 * size + 2))
    sums = merged.select("n", "p").mapInArrow(run, schema).agg(*[F.sum(f"x{i}") for i in range(2 * size + 2)]).first()
    found = np.array([float(x or 0) for x in sums])
    return found[:size], found[size:-2], found[-2], found[-1]


def fit_rates(
    members: DataFrame,
    domains: Sequence[str],
    weights: Mapping[str, float],
    anchor: str | None = None,
    ridge: float = RIDGE,
    most: float = MOST,
    steps: int = STEPS,
) -> Rates:
    """``weights``: wanted shares of tokens; a domain without one is wanted nowhere. The wanted
    total is that which leaves ``anchor`` as it is, else the present total."""
    size = len(domains)
    grains = F.transform("p", lambda x: F.floor(x * GRAIN + 0.5).cast("int"))
    merged = members.select(grains.alias("p"), "n_tokens").groupBy("p").agg(F.sum("n_tokens").cast("double").alias("n"))
    merged = written(merged.filter("n > 0").withColumn("p", F.col("p").cast("array<double>")), "memberships-merged")
    p = [F.col("p")[i] / GRAIN for i in range(size)]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    found = merged.agg(*[F.sum(F.col("n") * x) for x in p], *[F.sum(F.col("n") * p[i] * p[j]) for i, j in pairs]).first()
    present = np.array([float(x or 0) for x in found[:size]])
    total = present.sum()
    none = np.zeros((0, size)), np.zeros(0)
    if total <= 0:
        still = dict.fromkeys(domains, 0.0)
        return Rates(*none, 0.0, ridge, most, still, still)
    share = np.array([weights.get(d, 0.0) for d in domains])
    share = share / share.sum() if share.sum() else present / total
    place = list(domains).index(anchor) if anchor in domains else None
    wanted = share * (present[place] / share[place] if place is not None and share[place] and present[place] else total)
    scale = np.maximum(wanted, 1e-4 * total)  # a target of nothing is held as one of so little
    gram = np.zeros((size, size))
    for (i, j), x in zip(pairs, found[size:]):
        gram[i, j] = gram[j, i] = float(x or 0)
    # The greatest curvature in the metric of the tokens.
    step = 1 / (np.linalg.eigvalsh(gram / np.sqrt(np.outer(scale, scale)))[-1] + ridge)
    pulls, momenta, t, now, before = [], [], 1.0, present, present
    for _ in range(steps):
        following = (1 + (1 + 4 * t * t) ** 0.5) / 2
        momentum = (t - 1) / following
        ahead = now + momentum * (now - before)
        pulls.append((ahead - wanted) / scale)
        momenta.append(momentum)
        now, before, moved, back = _totals(merged, size, pulls, momenta, step, ridge, most)
        t = 1.0 if back > 0 else following
        if moved <= total * STILL**2:
            break
    wants, has = dict(zip(domains, wanted.tolist())), dict(zip(domains, now.tolist()))
    return Rates(np.array(pulls), np.array(momenta), step, ridge, most, wants, has)


def copies(rate: Column, key: Column) -> Column:
    """Whole copies whose mean over the keys is the rate: floor, and one more for the rest by hash."""
    u = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixed(
    docs: DataFrame,
    labels: DataFrame,
    domain: Column,
    weights: Mapping[str, float],
    keep: Sequence[str],
    anchor: str | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
) -> tuple[DataFrame, Classifier]:
    """((row struct of ``keep``, n_tokens, p, rate) of every row, classifier)."""
    classifier = train(docs, labels, domain, text, doc_id)
    members = written(memberships(docs, classifier, keep, text), "memberships")
    rates = fit_rates(members, classifier.domains, weights, anchor)
    return members.withColumn("rate", rates.column(F.col("p"))), classifier


def resampled(docs: DataFrame, labels: DataFrame, domain: Column, weights: Mapping[str, float], **options) -> DataFrame:
    """``docs`` with every row as often as its rate says; columns unchanged."""
    doc_id = options.get("doc_id", "doc_id")
    rows, _ = mixed(docs, labels, domain, weights, docs.columns, **options)
    times = copies(F.col("rate"), F.col("row").getField(doc_id))
    kept = rows.withColumn("times", times).filter("times > 0")
    return kept.withColumn("nth", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
