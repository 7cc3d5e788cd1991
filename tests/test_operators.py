"""Operators on small fixtures, against brute force where SQL is no help."""

import json
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskloom.functions import rules as R
from deskloom.operators import learners as L
from deskloom.operators import metrics as M
from deskloom.operators import ordering as O
from deskloom.operators import sampling as SM
from deskloom.operators import threads as TH
from deskloom.operators import vectors as V
from deskloom.operators.reuse import reuse_summary, ttl_reuse
from deskloom.plans.classify import batch_stats, classify_batch, score_new
from deskloom.plans.cases import extract_cases
from deskloom.plans.decide import decide
from deskloom.plans.expand import batch_labels
from deskloom.plans.vault import build_vault_from_cases
from deskloom.sources import readers, writers
from deskloom.streaming import flows


def components(edges):
    """Undirected components by repeated labelling."""
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(a)
        if b is not None:
            near[a].add(b)
            near[b].add(a)
    label, out = 0, {}
    for start in near:
        if start in out:
            continue
        stack, label = [start], label + 1
        while stack:
            node = stack.pop()
            if node not in out:
                out[node] = label
                stack.extend(near[node])
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_thread_roots_on_forests_chains_and_cycles(spark, seed):
    rng = random.Random(seed)
    edges = [("r0", None)] + [(f"c{i}", f"c{i-1}" if i else "r0") for i in range(40)]
    edges += [(f"t{i}", rng.choice(["gone1", "gone2", None] + [f"t{j}" for j in range(i)])) for i in range(40)]
    edges += [(f"z{i}", f"z{(i + 1) % 7}") for i in range(7)] + [("self", "self")]
    edges += [("a9", "z3")] + [(f"a{i}", f"a{i + 1}") for i in range(9)]  # a long tail into the cycle
    df = spark.createDataFrame(edges, "msg_id string, parent_id string").repartition(4)
    got = {r.msg_id: r.root_id for r in TH.thread_roots(df).collect()}
    want = components(edges)
    assert set(got) == {a for a, _ in edges}
    groups = defaultdict(set)
    for node, root in got.items():
        groups[root].add(want[node])
    assert all(len(g) == 1 for g in groups.values())
    assert len({want[a] for a, _ in edges}) == len(groups)


def test_extract_cases(spark):
    rows = [
        ("1", "u1", "help @AppleSupport", "Tue Oct 31 22:10:47 +0000 2017", None),
        ("2", "APPLESUPPORT", "sure", "bad", "1"),
        ("3", "u1", "@AppleSupport", "bad", "2"),  # cleaned to nothing
        ("4", "u2", "me too", "bad", "gone"),
        ("5", "AppleSupport", "hi", "bad", "gone"),
        ("6", "u3", "unrelated", "bad", None),
    ]
    df = spark.createDataFrame(rows, "msg_id string, author_id string, text string, created_at string, parent_id string")
    got = {r.case_id: r for r in extract_cases(df).collect()}
    assert set(got) == {"1", "4"}
    assert got["1"].clean_text == "help" and got["1"].raw_turns[0].text == "help @AppleSupport"
    assert got["4"].timestamp is None and got["4"].thread_id == "gone"


def test_number_rows_and_next_match_plain_windows(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i * rng.randint(1, 3) + i * 5) for i in range(200)]
    df = spark.createDataFrame(sorted(set(rows)), "g string, k long").repartition(5)
    numbered = O.number_rows(df, ["k"], ["g"]).collect()
    seen = defaultdict(list)
    for g, k in sorted(set(rows)):
        seen[g].append(k)
    assert {(r.g, r.k): r.rn for r in numbered} == {
        (g, k): i + 1 for g, ks in seen.items() for i, k in enumerate(ks)
    }
    nexts = O.with_next(df, "g", "k", ["k"]).collect()
    assert {(r.g, r.k): r.next_k for r in nexts} == {
        (g, k): (ks[i + 1] if i + 1 < len(ks) else None) for g, ks in seen.items() for i, k in enumerate(ks)
    }


def test_top_n_above_planner_limit(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), "id")
    got = O.top_n_per_group(df, ["g"], [F.col("id")], 1500)
    assert got.count() == 3000 and got.agg(F.max("id")).first()[0] == 2999


def test_top_n_is_pruned_before_the_shuffle(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), "id")
    plan = O.top_n_per_group(df, ["g"], [F.col("id")], 5)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_ttl_reuse(spark):
    rows = [(i, "k", t) for i, t in enumerate([0, 10, 3599, 3600, 3700, 7300])]
    df = spark.createDataFrame(rows, "id long, key string, t long").select(
        "id", "key", F.timestamp_seconds("t").alias("ts")
    )
    flagged = ttl_reuse(df.repartition(3), "key", "ts", "id")
    assert [r.hit for r in flagged.orderBy("id").collect()] == [False, True, True, False, True, False]
    assert reuse_summary(flagged, "key").first().hits == 3


def test_ttl_reuse_on_events(spark):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("event_id", "ts", "event_type")
    got = {
        r.event_type: (r.hits, r.misses)
        for r in reuse_summary(ttl_reuse(events, "event_type", "ts", "event_id"), "event_type").collect()
    }
    assert {k.strip(): v for k, v in got.items()} == {
        "click": (1472, 534), "error": (1484, 530), "purchase": (1450, 531),
        "signup": (1481, 536), "view": (1452, 530),
    }


def brute_scores(items, queries, k):
    """Cosine of tf-idf by hand, k best with padding, ties to the lower id."""

    def grams(text):
        words = [w for w in text.lower().split() if w not in R.STOP_WORDS]
        return words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    def tf(text):
        counts = defaultdict(int)
        for g in grams(text):
            counts[g] += 1
        return {g: 1 + math.log(n) for g, n in counts.items()}

    out = {}
    for qid, qg, qt in queries:
        group = [(i, t) for i, g, t in items if g == qg]
        df = defaultdict(int)
        for _, t in group:
            for g in set(grams(t)):
                df[g] += 1
        idf = {g: math.log((1 + len(group)) / (1 + n)) + 1 for g, n in df.items()}

        def vec(text):
            v = {g: w * idf[g] for g, w in tf(text).items() if g in idf}
            norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
            return {g: x / norm for g, x in v.items()}

        q = vec(qt)
        scored = [(round(sum(q.get(g, 0) * w for g, w in vec(t).items()), 4), i) for i, t in group]
        out[qid] = [(i, s) for s, i in sorted(scored, key=lambda x: (-x[0], x[1]))[:k]]
    return out


@pytest.mark.parametrize("seeds", [8, 2, 0])
def test_lexical_matches_are_exact_whatever_is_skipped(spark, seeds):
    rng = random.Random(11)
    # Skewed vocabulary: a few words are nearly everywhere.
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    line = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    items = [(i, "AB"[i % 7 == 0], line(rng.randint(2, 12))) for i in range(120)]
    queries = [(i, "AB"[i % 5 == 0], line(rng.randint(1, 10))) for i in range(25)]
    queries += [(98, "A", "unknown words only"), (99, "B", "w0 w0")]
    idf = spark.createDataFrame(items, "id long, g string, t string").repartition(4)
    qdf = spark.createDataFrame(queries, "id long, g string, t string").repartition(3)
    index = V.build_index(idf, "id", "g", "t")
    rows = V.lexical_matches(qdf, index, "id", "g", "t", 3, seeds).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query, r["rank"])):
        got[r.query].append((r.item, r.score))
    want = brute_scores(items, queries, 3)
    assert set(got) == set(want)
    for q, best in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in best], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in best], atol=1.1e-4)


def test_few_pairs_are_candidates(spark):
    """Texts of common words and some rare ones: pairs that share common words only are skipped."""
    rng = random.Random(2)
    items = []
    for i in range(400):
        rare = [f"r{(i // 4) * 8 + j}" for j in range(8)]
        items.append((i, "A", " ".join(rng.sample(rare, 6) + rng.choices([f"c{j}" for j in range(30)], k=12))))
    df = spark.createDataFrame(items, "id long, g string, t string")
    index = V.build_index(df, "id", "g", "t")
    candidates, _ = V.pruned_candidates(index.vectors, index, 3)
    assert candidates.count() < 400 * 400 / 20
    got = {(r.query, r["rank"]): r.item for r in V.lexical_matches(df, index, "id", "g", "t", 3, vectors=index.vectors).collect()}
    assert got == {(q, n): i for q, best in brute_scores(items, items, 3).items() for n, (i, _) in enumerate(best, 1)}


@pytest.mark.parametrize("block", [2048, 7])
def test_dense_matches_blocks(spark, block):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 8)).astype("float32")
    df = spark.createDataFrame(
        [(i, i % 2, v.tolist()) for i, v in enumerate(vectors)], "id long, g int, vec array<float>"
    )
    got = V.dense_matches(df, df, "g", 3, block, skip_same_id=True).collect()
    unit = vectors.astype("float64") / np.linalg.norm(vectors.astype("float64"), axis=1, keepdims=True)
    for q in range(60):
        others = [i for i in range(60) if i % 2 == q % 2 and i != q]
        best = sorted(others, key=lambda i: (-round(float(unit[q] @ unit[i]), 4), i))[:3]
        assert [r.item for r in sorted(got, key=lambda r: r["rank"]) if r.query == q] == best


def test_class_report_with_an_absent_label(spark):
    labels = list("abc")
    matrix = [[5, 1, 0], [0, 3, 1], [0, 0, 0]]
    rows = [(labels[i], labels[j]) for i in range(3) for j in range(3) for _ in range(matrix[i][j])]
    df = spark.createDataFrame(rows, "actual string, predicted string")
    report = {r.label: r for r in M.class_report(df, "actual", "predicted", labels).collect()}
    assert (report["a"].precision, report["a"].recall) == (1.0, 0.8333)
    assert (report["c"].precision, report["c"].recall, report["c"].f1, report["c"].support) == (0, 0, 0, 0)
    macro = M.macro_metrics(df, "actual", "predicted").first()
    assert macro.accuracy == 0.8


def test_kappa_and_rank_of_equal_raters(spark):
    df = spark.createDataFrame([(i % 5, i % 5) for i in range(50)], "a int, b int")
    kappa = M.weighted_kappa(df, "a", "b").first()
    assert (kappa.quadratic_kappa, kappa.linear_kappa) == (1.0, 1.0)
    opposite = spark.createDataFrame([(i, -i) for i in range(9)], "a int, b int")
    assert M.spearman(opposite, "a", "b").first().rho == -1.0
    constant = spark.createDataFrame([(i, 1) for i in range(9)], "a int, b int")
    assert M.spearman(constant, "a", "b").first().rho is None


def test_percentile_interpolates(spark):
    df = spark.range(1, 11).select(F.col("id").cast("double").alias("v"))
    got = {r.point: round(r.value, 4) for r in M.percentiles(df.repartition(4), "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    assert got == {0.0: 1.0, 0.5: 5.5, 0.95: 9.55, 1.0: 10.0}


def test_split_sizes_and_order_independence(spark):
    df = spark.range(720).select("id", (F.col("id") % 6).alias("label"))
    split = SM.stratified_split(df, "label", "id")
    again = SM.stratified_split(df.orderBy(F.rand(1)).repartition(7), "label", "id")
    counts = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert all(n == (24 if s == "test" else 96) for (_, s), n in counts.items()) and len(counts) == 12
    assert split.exceptAll(again).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_pools_equal_the_sequential_scan(spark, seed):
    rng = random.Random(seed)
    cues = {"X": ["a"], "Y": ["b"], "Z": ["c"]}
    texts = ["".join(rng.choices("abcde", k=rng.randint(1, 4))) for _ in range(80)]
    pools, seen = defaultdict(list), set()
    for text in texts:
        if text in seen:
            continue
        for intent, words in cues.items():
            if len(pools[intent]) < 6 and any(w in text for w in words):
                pools[intent].append(text)
                seen.add(text)
                break
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, text string").repartition(3)
    got = defaultdict(set)
    for r in SM.mine_pools(df, cues=cues, pool_size=6).collect():
        got[r.intent].add(r.text)
    assert got == {k: set(v) for k, v in pools.items()}


def test_quota_counts_what_is_there(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"))
    taken = spark.createDataFrame([("a", 4)], "label string, n long")
    got = SM.fill_quota(df, "label", [F.col("id")], taken, quota=10).groupBy("label").count()
    assert {r.label: r["count"] for r in got.collect()} == {"a": 6, "b": 10}


def vault_fixture(spark):
    rows = [
        ("p1", "c1", "BATTERY_DRAIN", "battery drains after the charge", "{customer_handle} DM us: {dm_link}"),
        ("p2", "c2", "BATTERY_DRAIN", "the charger cable is loose", "{customer_handle} try another cable"),
        ("p3", "c3", "UNKNOWN", "what are the store hours", "{customer_handle} see {help_link}"),
    ]
    return spark.createDataFrame(
        rows, "pair_id string, case_id string, intent string, customer_query string, agent_reply string"
    )


def test_decide(spark):
    cases = spark.createDataFrame(
        [
            ("1", "My charger sparked and is smoking!", "u"),
            ("2", "battery drains after the charge, cable", "@u"),
            ("3", "battery drains after the charge, cable", "@v"),
            ("4", "zzz qqq", "u"),
            ("5", "password locked", "u"),
        ],
        "case_id string, text string, handle string",
    )
    drafts = spark.createDataFrame([("2", '"@u hello"'), ("3", "we guarantee it")], "case_id string, draft string")
    got = {r.case_id: r for r in decide(cases, vault_fixture(spark), drafts=drafts).collect()}
    assert len(got) == 5
    assert (got["1"].decision, got["1"].priority, got["1"].draft_reply) == ("HANDOFF", "URGENT_P1", None)
    assert got["2"].decision == "AUTO_REPLY" and got["2"].draft_reply == "@u hello" and not got["2"].failsafe_used
    assert got["3"].failsafe_used and got["3"].draft_reply == f"@v DM us: {R.DM_LINK}"
    assert [m.intent for m in got["2"].matches] == ["BATTERY_DRAIN"] * 2
    assert got["4"].decision == "HANDOFF" and got["4"].rule_code == "LOW_CONFIDENCE_UNRELIABLE_TWIN"
    # No ACCOUNT_ACCESS pairs: the UNKNOWN partition is searched, which holds one pair.
    assert got["5"].retrieval_intent == "UNKNOWN" and len(got["5"].matches) == 1
    assert got["5"].draft_reply.startswith("@u We'd like")


def test_second_batch_is_served_from_the_first(spark):
    texts = spark.createDataFrame([(1, "A b"), (2, " a  B "), (3, "c")], "request_id long, text string")
    none = score_new(texts, None).limit(0)
    first = classify_batch(texts, none)
    assert batch_stats(first).first().asDict() == {"batch_size": 3, "cache_hits": 0, "deduplicated_count": 1}
    second = classify_batch(texts, score_new(texts, None))
    assert batch_stats(second).first().cache_hits == 3


def test_vault_from_case_arrays(spark, tmp_path):
    good = (
        '{"case_id": "%s", "raw_turns": [{"author_id": "AppleSupport", "text": "first"},'
        '{"author_id": "u", "text": "my battery drain is bad %s"},'
        '{"author_id": "AppleSupport", "text": "@u DM us https://t.co/x please"}]}'
    )
    lines = [good % ("1", "a"), "", "{broken", good % ("2", "A!"), good % ("3", "b"), '{"case_id": "4", "raw_turns": []}']
    path = tmp_path / "cases.jsonl"
    path.write_text("\n".join(lines))
    cases, bad = readers.read_cases(spark, str(path))
    assert bad.count() == 1 and cases.count() == 4
    ordered = cases.withColumn("ord", F.col("case_id").cast("long"))
    vault = build_vault_from_cases(ordered, "ord").orderBy("pair_id").collect()
    assert [(v.pair_id, v.case_id) for v in vault] == [("pair_00001", "1"), ("pair_00002", "3")]
    assert vault[0].agent_reply == "{customer_handle} DM us {dm_link} please"


def test_labeled_falls_back_to_golden(spark, tmp_path):
    golden = tmp_path / "golden.json"
    golden.write_text('{"cases": [{"case": {"clean_text": " hi "}, "expected": {"intent": "unknown"}}]}')
    rows = readers.read_labeled(spark, str(tmp_path / "none.json"), fallback=str(golden)).collect()
    assert [(r.text, r.intent, r.label) for r in rows] == [("hi", "UNKNOWN", 4)]


def test_text_model_learns(spark):
    rows = [(i, f"alpha beta word{i % 3}" if i % 2 else f"gamma delta word{i % 3}", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    model = L.fit_text_model(df, "id", "text", "label", ("even", "odd"), max_features=50, max_iter=50)
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "delta"), (3, "nothing known")], "id long, text string")
    got = {r.id: r for r in L.predict_text(model, asked, "id", "text").collect()}
    assert (got[1].predicted, got[2].predicted) == ("odd", "even")
    assert got[1].confidence > 0.6 and 3 in got


def test_ttl_reuse_nulls_are_misses(spark):
    rows = [(1, None, 0), (2, None, 1), (3, "k", None), (4, "k", 5), (5, "k", 6)]
    df = spark.createDataFrame(rows, "id long, key string, t long").select(
        "id", "key", F.timestamp_seconds("t").alias("ts")
    )
    got = {r.id: r.hit for r in ttl_reuse(df, "key", "ts", "id").collect()}
    assert got == {1: False, 2: False, 3: False, 4: False, 5: True}


def test_numbering_with_sparse_ids(spark):
    rows = [(i % 3, 10**12 + i * 7_777_777_777) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, k long").repartition(4)
    got = sorted(tuple(r) for r in O.number_rows(df, ["k"], ["g"]).collect())
    seen: dict[int, int] = {}
    for g, k, rn in sorted(got, key=lambda r: (r[0], r[1])):
        seen[g] = seen.get(g, 0) + 1
        assert rn == seen[g]
    following = {(r.g, r.k): r.next_k for r in O.with_next(df, "g", "k", ["k"]).collect()}
    for g in range(3):
        keys = sorted(k for h, k in rows if h == g)
        assert [following[g, k] for k in keys] == [*keys[1:], None]


def test_rows_move_once_to_be_numbered_or_paired(spark):
    """One shuffle by ranges for the rows; groups that cross ranges, null groups, kept rows only."""
    rows = [(g, k, f"{g}{k}") for g, n in [("a", 300), (None, 40), ("b", 1)] for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, t string").repartition(5)
    keep = (F.col("k") % 3 == 0) & F.col("next_t").isNotNull()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        paired = O.with_next(df, "g", "k", ["t"], keep=keep)
        numbered = O.number_rows(df, ["k"], ["g"])
        for plan in (paired, numbered):
            assert "Exchange" not in plan._jdf.queryExecution().toString().replace("BroadcastExchange", "")
        got = {(r.g, r.k): r.next_t for r in paired.collect()}
        assert got == {(g, k): f"{g}{k + 1}" for g, n in [("a", 300), (None, 40)] for k in range(0, n - 1, 3)}
        assert {(r.g, r.k): r.rn for r in numbered.collect()} == {(g, k): k + 1 for g, k, _ in rows}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_latency_by_group(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(101)] + [("b", 7.0)], "m string, v double")
    got = {r.m: r.p95_ms for r in M.latency_stats(df, "v", ["m"]).collect()}
    assert got == {"a": 95.0, "b": 7.0}


def test_confusion_matrix_lists_every_label(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("z", "a")], "actual string, predicted string")
    got = [tuple(r) for r in M.confusion_matrix(df, "actual", "predicted", ["a", "b", "c"]).collect()]
    assert got == [("a", 1, 1, 0), ("b", 0, 0, 0), ("c", 0, 0, 0)]


def test_one_bad_id_voids_a_batch_answer(spark):
    items = spark.createDataFrame([(b, i) for b in (1, 2) for i in (1, 2)], "batch int, item int")
    answers = spark.createDataFrame(
        [(1, '[{"id": "1", "intent": "UNKNOWN"}, {"intent": "UNKNOWN"}]'), (2, '[{"id": 1, "intent": "UNKNOWN"}, {"id": "x"}]')],
        "batch int, response string",
    )
    got = {(r.batch, r.item): r.verified for r in batch_labels(items, answers, ["batch"]).collect()}
    assert got == {(1, 1): "UNKNOWN", (1, 2): "DISCARD", (2, 1): "DISCARD", (2, 2): "DISCARD"}


@pytest.mark.parametrize("files", [1, 6])
def test_dedup_stream_keeps_what_lies_outside_the_horizon(spark, tmp_path, files):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    rows = [(i, t, key) for i, (t, key) in enumerate([(0, "A"), (5, " a"), (3599, "a"), (3600, "a"), (3700, "b"), (7000, "a"), (7200, "a"), (7300, "b"), (None, "a")])]
    step = -(-len(rows) // files)
    source = f"{tmp_path}/in"
    for at in range(0, len(rows), step):
        part = spark.createDataFrame(rows[at : at + step], "id long, t long, text string")
        part.select("id", F.timestamp_seconds("t").alias("ts"), "text").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long, ts timestamp, text string").option("maxFilesPerTrigger", 1).parquet(source)
    flows.run_available(flows.dedup_stream(stream, "text", "ts", "id"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 3, 4, 6, 7, 8]


def test_array_files(spark, tmp_path):
    """Every file is one JSON array; rows, nulls and odd characters survive; no rows, an empty array."""
    schema = "id long, text string, kind string"
    texts = ['plain', 'two\nlines', 'quote " and \\ back', '', None, '[{"id": 1}]', 'é 漢 🙂', '  end']
    rows = [(i, texts[i % len(texts)], None if i % 3 else "k") for i in range(97)] + [(None, None, None)]
    for name, some in (("rows", rows), ("none", [])):
        path = str(tmp_path / name)
        writers.write_array(spark.createDataFrame(some, schema), path, rows=20)
        files = list((tmp_path / name).glob("part-*"))
        arrays = [json.loads(f.read_text(encoding="utf-8")) for f in files]
        assert all(isinstance(a, list) for a in arrays) and sum(map(len, arrays)) == len(some)
        assert len(files) == (5 if some else 1) and max(map(len, arrays)) <= 24
        back = [tuple(r) for r in readers.read_table(spark, path, schema).collect()]
        assert sorted(back, key=repr) == sorted(some, key=repr)


def test_only_the_best_of_a_block_leave_it(spark, monkeypatch):
    """Texts that share most words: all pairs share terms, a task returns k rows for each query."""
    rng = random.Random(4)
    words = [f"c{j}" for j in range(25)]
    items = [(i, "A", " ".join(rng.choices(words, k=14))) for i in range(150)]
    monkeypatch.setattr(V, "BLOCK_ROWS", 60)
    df = spark.createDataFrame(items, "id long, g string, t string")
    index = V.build_index(df, "id", "g", "t")
    candidates, shape = V.pruned_candidates(index.vectors, index, 3)
    assert [(r["_qn"], r["_in"]) for r in shape.collect()] == [(3, 3)]
    assert candidates.count() <= 3 * 3 * len(items)
    got = {(r.query, r["rank"]): r.item for r in V.lexical_matches(df, index, "id", "g", "t", 3, vectors=index.vectors).collect()}
    assert got == {(q, n): i for q, best in brute_scores(items, items, 3).items() for n, (i, _) in enumerate(best, 1)}


def test_index_of_wanted_terms_finds_the_same(spark):
    """Only terms that are asked for are listed; scores are those of the whole index. An id twice, null ids."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i if i % 9 else None, "ab"[i % 2], " ".join(rng.choices(words, k=12))) for i in range(120)] + [(7, "b", "w1 w2 w3")]
    df = spark.createDataFrame(rows, "id long, g string, t string")
    queries = spark.createDataFrame([(i, "ab"[i % 2], " ".join(rng.choices(words[:5], k=4))) for i in range(8)], "q long, g string, t string")
    wanted = V.explode_terms(queries, "q", "g", "t", V.STOP_WORDS)
    some, every = V.build_index(df, "id", "g", "t", wanted=wanted), V.build_index(df, "id", "g", "t")
    asked = {(r.grp, r.term) for r in wanted.collect()}
    listed = {(r.grp, r.term) for r in some.postings.collect()}
    assert listed and listed <= asked < {(r.grp, r.term) for r in every.postings.collect()} | asked
    weights = lambda index: {(r["item"], r.grp, r.term): round(r.w, 9) for r in index.postings.collect() if (r.grp, r.term) in asked}
    assert weights(some) == weights(every)


@pytest.mark.parametrize("chunk", [60, 400, 8_000_000])
def test_index_of_wanted_terms_makes_no_row_of_a_term(spark, monkeypatch, chunk):
    """Chunks of texts tell their counts to each other; few or many of them, ids twice, null ids, texts and groups."""
    rng = random.Random(8)
    words = [f"ü{i}" for i in range(50)] + ["the"]
    line = lambda: " ".join(rng.choices(words, [1 / (n + 1) for n in range(51)], k=rng.randint(0, 20)))
    rows = [(i if i % 8 else None, "abc"[i % 3], line()) for i in range(90)]
    rows += [(5, "c", line()), (91, "a", None), (92, "b", ""), (93, None, line())]
    df = spark.createDataFrame(rows, "id long, g string, t string").repartition(5)
    wanted = spark.createDataFrame([(g, t) for g in ("a", "b", "d", None) for t in ("ü0", "ü1", "ü2 ü0", "no", "ü0 ü0")], "grp string, term string")
    every = V.build_index(df, "id", "g", "t")
    asked = {(r.grp, r.term) for r in wanted.collect()}
    expected = {(r["item"], r.grp, r.term): round(r.w, 9) for r in every.postings.collect() if (r.grp, r.term) in asked}
    counts = {(r.grp, r.term): (r.df, r.n, round(r.idf, 9)) for r in every.idf.collect() if (r.grp, r.term) in asked}
    monkeypatch.setattr(V, "CHUNK", chunk, raising=False)
    monkeypatch.setattr(V, "MEET", 1, raising=False)
    monkeypatch.delattr(V, "explode_terms")
    some = V.build_index(df, "id", "g", "t", wanted=wanted)
    assert expected and {(r["item"], r.grp, r.term): round(r.w, 9) for r in some.postings.collect()} == expected
    assert {(r.grp, r.term): (r.df, r.n, round(r.idf, 9)) for r in some.idf.collect()} == counts
    key = lambda r: str(r.grp)
    assert sorted(some.groups.collect(), key=key) == sorted(every.groups.collect(), key=key)
    nothing = V.build_index(df, "id", "g", "t", wanted=wanted.filter("term = 'no'"))
    assert nothing.postings.count() == 0 and nothing.groups.count() == 3


@pytest.mark.parametrize("k", [1, 3, 9])
def test_best_of_block_partitions_no_whole_block(monkeypatch, k):
    """The best of a block, ties to the lower item, without a partition of all its scores for each query."""
    rng = np.random.default_rng(6)
    weights = 1 / np.arange(1, 301)
    bag = lambda n: np.sort(rng.choice(300, n, replace=False, p=weights / weights.sum()))
    rows = [bag(rng.integers(1, 15)) for _ in range(700)]
    rows[40:50] = [rows[40]] * 10  # equal scores
    x = np.zeros((len(rows), 300))
    for i, terms in enumerate(rows):
        x[i, terms] = 1 + 1 / (1 + terms)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    flat = lambda part: (np.array([(r > 0).sum() for r in part]), np.concatenate([np.flatnonzero(r) for r in part]) * 7919, part[part > 0])
    partition = np.partition
    most = []
    monkeypatch.setattr(V.np, "partition", lambda a, n: most.append(len(a)) or partition(a, n))
    query, item, score = V._best_of_block(flat(x[:120]), flat(x), k, V.SEEDS)
    assert k > 8 or max(most, default=0) < 256
    every = np.round(x[:120] @ x.T, 4)
    for q in range(120):
        best = [i for i in np.argsort(-every[q], kind="stable")[:k] if every[q, i] > 0]
        assert item[query == q].tolist() == best and np.allclose(score[query == q], every[q, best], atol=6e-5)


@pytest.mark.parametrize("k", [1, 3, 8, 9, 400])
def test_kth_leaves_the_values(k):
    values = np.random.default_rng(k).integers(0, 50, 300).astype(float)
    was = values.copy()
    assert V._kth(values, k) == (np.sort(was)[::-1][k - 1] if k <= 300 else -np.inf)
    assert (values == was).all()
