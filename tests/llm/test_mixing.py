"""Rates against a plain solver over documents: common, scarce and absent domains."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from deskloom.llm import mixing
from deskloom.llm.queries import ANCHOR, DOMAIN, WEIGHTS

DOMAINS = ["clean", "poor", "toxic"]


def plain_rates(n, p, wanted, rounds=60_000):
    """Projected gradient without momentum, a rate per document."""
    p = mixing.rounded(p)
    scale = np.maximum(wanted, 1e-4 * (n @ p).sum())
    a = np.sqrt(n)[:, None] * p / np.sqrt(scale)
    step = 1 / (np.linalg.norm(a, 2) ** 2 + mixing.RIDGE)
    r = np.ones(len(n))
    for _ in range(rounds):
        pull = ((r * n) @ p - wanted) / scale
        new = np.clip(r - step * (p @ pull + mixing.RIDGE * (r - 1)), 0, mixing.MOST)
        if np.abs(new - r).max() < 1e-10:
            break
        r = new
    return r


def members_of(spark, n, p):
    rows = [(i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(n, p))]
    return spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>").repartition(3)


def rates_of(members, rates):
    return np.array([r[1] for r in sorted(members.select("doc_id", rates.column(F.col("p"))).collect())])


def test_three_targets(spark):
    rng = np.random.default_rng(3)
    p, n = rng.dirichlet([0.4, 0.4, 0.4], 300), rng.integers(0, 900, 300)
    members = members_of(spark, n, p)
    rates = mixing.fit_rates(members, ["a", "b", "c"], {"a": 0.7, "b": 0.2, "c": 0.1})
    wanted = np.array([0.7, 0.2, 0.1]) * (n @ mixing.rounded(p)).sum()
    got = rates_of(members, rates)
    assert np.abs(got - plain_rates(n, p, wanted)).max() < 0.03  # flat directions, held by the ridge alone, end a little early
    assert np.allclose([rates.expected[d] for d in "abc"], (got * n) @ mixing.rounded(p), rtol=1e-6)


@pytest.mark.parametrize("blur", [0.0, 0.05, 0.2])
@pytest.mark.parametrize("toxic", [0.11, 0.001, 0.0])
def test_production_settings(spark, blur, toxic):
    """Each target that the greatest rate allows is met; a scarce or absent domain moves no other."""
    shares = np.array([0.87 - toxic, 0.13, toxic])
    rng = np.random.default_rng(5)
    sure = np.eye(3)[rng.choice(3, 4000, p=shares)]
    p = (1 - blur) * sure + blur * shares
    if toxic == 0:
        p[:, 2] = 1e-7 * rng.random(len(p))
    n = rng.integers(1, 900, len(p))
    members = members_of(spark, n, p)
    rates = mixing.fit_rates(members, DOMAINS, WEIGHTS, ANCHOR)
    got = rates_of(members, rates)
    present = n @ mixing.rounded(p)
    wanted = np.array([WEIGHTS[d] / WEIGHTS[ANCHOR] for d in DOMAINS]) * present[0]
    assert np.abs(got - plain_rates(n, p, wanted)).max() < 0.02
    assert got.max() <= mixing.MOST and (got > 0).mean() > 0.5
    total = (got * n) @ mixing.rounded(p)
    if blur == 0 and toxic == 0.11:
        assert (np.abs(total / wanted - 1) < 2e-3).all()
    if toxic == 0:
        assert (np.abs(total / wanted - 1) < 0.01)[:2].all() and total[2] == 0
    if toxic == 0.001 and blur == 0:
        assert np.allclose(got[sure[:, 2] == 1], mixing.MOST) and (np.abs(total / wanted - 1) < 2e-3)[:2].all()


def test_query_rates_and_copies(spark):
    """The registered query: rates from its own posteriors by the plain solver, copies by the hash."""
    rows = entry.queries()["op8_mixing"](spark, "/root/testdata/sf0.01").collect()
    p = np.array([[r[f"p_{d}"] for d in DOMAINS] for r in rows])
    n = np.array([r["n_tokens"] for r in rows])
    wanted = np.array([WEIGHTS[d] / WEIGHTS[ANCHOR] for d in DOMAINS]) * (n @ mixing.rounded(p))[0]
    rate = np.array([r["rate"] for r in rows])
    assert np.abs(rate - plain_rates(n, p, wanted)).max() < 0.02
    ids = spark.createDataFrame([(r["doc_id"], r["rate"]) for r in rows], "doc_id long, rate double")
    u = {r[0]: r[1] for r in ids.selectExpr("doc_id", "pmod(xxhash64(doc_id, 'copies'), 1073741824) / 1073741824D").collect()}
    assert all(r["copies"] == int(r["rate"]) + (u[r["doc_id"]] < r["rate"] - int(r["rate"])) for r in rows)


def test_nothing_to_mix(spark):
    members = members_of(spark, [0, 0], [[0.5, 0.5], [1.0, 0.0]])
    rates = mixing.fit_rates(members, ["a", "b"], {"a": 1.0})
    assert rates_of(members, rates).tolist() == [1.0, 1.0]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert mixing.resampled(docs, labels, F.expr(DOMAIN), WEIGHTS, anchor=ANCHOR).count() == 2
