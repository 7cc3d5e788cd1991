"""Appends against building at once: threads, store, requests without a text."""

import random

import pytest
from pyspark.sql import functions as F

from deskloom.operators import threads as TH
from deskloom.operators import vectors as V
from deskloom.operators.store import PairStore
from deskloom.plans.classify import batch_stats, classify_batch
from deskloom.functions.text import fingerprint
from deskloom.functions.rules import TAXONOMY
from deskloom.functions.probabilities import prediction_detail, uniform

SCHEMA = "msg_id string, parent_id string"


def graph(seed):
    """Random chains, missing parents, children of one parent, cycles (with tails), self-parents."""
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        kind = rng.random()
        parent = None if kind < 0.15 else f"m{rng.randrange(max(1, i))}" if kind < 0.85 else f"x{rng.randrange(20)}"
        rows.append((f"m{i}", parent))
    for c in range(6):
        size = rng.randint(1, 6)
        names = [f"c{c}_{rng.randrange(1000)}_{j}" for j in range(size)]
        rows += [(a, names[(j + 1) % size]) for j, a in enumerate(names)]
        rows += [(f"t{c}_{j}", rng.choice([*names, f"t{c}_{j - 1}"] if j else names)) for j in range(4)]
    rows += [(f"x{i}", f"m{i * 7}" if i % 3 else None) for i in range(8)]  # missing parents that come
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_appended_messages(spark, seed):
    rows = graph(seed)
    rng = random.Random(seed)
    step = {m: rng.randrange(3) for m, _ in rows}
    wanted = {r.msg_id: r.root_id for r in TH.thread_roots(spark.createDataFrame(rows, SCHEMA)).collect()}
    there = spark.createDataFrame([r for r in rows if step[r[0]] == 0], SCHEMA)
    roots = TH.materialize(TH.thread_roots(there), "roots")
    for n in (1, 2):
        appended = spark.createDataFrame([r for r in rows if step[r[0]] == n], SCHEMA)
        fresh, changed = TH.extend_roots(roots, appended, there)
        before = {r.msg_id: r.root_id for r in roots.collect()}
        assert all(before[r.msg_id] != r.root_id for r in changed.collect())
        roots = TH.materialize(TH.replace_roots(roots, fresh, changed), "roots")
        there = there.unionByName(appended)
    got = {r.msg_id: r.root_id for r in roots.collect()}
    assert got == wanted and roots.count() == len(rows)


def test_append_to_nothing_and_nothing(spark):
    rows = spark.createDataFrame(graph(5), SCHEMA)
    none = rows.limit(0)
    fresh, changed = TH.extend_roots(TH.thread_roots(none), rows, none)
    assert changed.count() == 0 and sorted(fresh.collect()) == sorted(TH.thread_roots(rows).collect())
    fresh, changed = TH.extend_roots(TH.thread_roots(rows), none, rows)
    assert fresh.count() == changed.count() == 0


def test_store_versions(spark, tmp_path):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, "AB"[i % 3 == 0], " ".join(rng.choices(words, k=rng.randint(0, 8)))) for i in range(90)]
    schema = "pair_id long, intent string, customer_query string"
    store = PairStore(spark, f"file://{tmp_path}/store")
    assert store.versions() == [] and store.latest() == 0
    with pytest.raises(ValueError):
        store.pairs()
    pairs = spark.createDataFrame(rows, schema)
    for part in range(3):
        assert store.append(pairs.filter(F.col("pair_id") % 3 == part)) == part + 1
    ids = spark.createDataFrame([(0,), (4,), (5,), (1000,)], "pair_id long")
    assert store.remove(ids) == 4
    assert store.append(spark.createDataFrame([(4, "B", "w1 new words")], schema)) == 5

    def check(version, present):
        now = spark.createDataFrame(present, schema)
        built, kept = V.build_index(now, "pair_id", "intent", "customer_query"), store.index(version)
        for name in ("idf", "impacts", "bounds", "groups"):
            a, b = getattr(built, name), getattr(kept, name)
            shown = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in a.dtypes]
            assert sorted(map(repr, a.select(shown).collect())) == sorted(map(repr, b.select(shown).collect())), name
        assert sorted(store.pairs(version).collect()) == sorted(now.collect())

    check(5, [r for r in rows if r[0] not in (0, 4, 5)] + [(4, "B", "w1 new words")])
    check(2, [r for r in rows if r[0] % 3 < 2])
    # A version without its mark is not seen, and is written over.
    spark.range(3).write.parquet(f"file://{tmp_path}/store/pairs/v000000006")
    assert store.latest() == 5 and store.append(pairs.limit(0)) == 6
    assert store.pairs().count() == 88


def test_requests_without_a_text(spark):
    rows = [(1, "a b"), (2, None), (3, "A  b"), (4, "c"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "request_id long, text string")
    prior = df.filter("request_id = 4").select(
        fingerprint(F.col("text")).alias("text_key"), prediction_detail(uniform(6), TAXONOMY).alias("detail")
    )
    done = classify_batch(df, prior)
    got = {r.request_id: r for r in done.collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert [i for i in got if got[i].detail is None] == [i for i in got if i in (2, 5)] and got[4].cached
    assert not got[2].cached and got[2].text_key is None
    stats = batch_stats(done).first()
    assert (stats.batch_size, stats.cache_hits, stats.deduplicated_count) == (6, 1, 1)


def test_a_text_is_scored_once(spark):
    """The score of a text stands once in the plan, however many parts of the detail read it."""
    df = spark.createDataFrame([("has zqx",), ("none",)], "text string")
    score = F.when(F.contains("text", F.lit("zqx")), F.array(F.lit(0.7), F.lit(0.3))).otherwise(uniform(2))
    detail = df.select(prediction_detail(score, ("a", "b")).alias("detail"))
    assert detail._jdf.queryExecution().optimizedPlan().toString().count("zqx") == 1
    rows = [r.detail for r in detail.collect()]
    assert [(r.intent, r.confidence, r.ambiguous) for r in rows] == [("a", 0.7, False), ("b", 0.5, True)]
    assert [r.entropy for r in rows] == [0.8813, 1.0] and rows[0].probabilities == {"a": 0.7, "b": 0.3}
