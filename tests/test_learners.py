"""Fitted models recomputed: terms, weights and vocabulary in plain Python, predictions from the
exported coefficients, and the fit itself by its gradient."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import __spark_entry__ as entry
from deskloom.catalog import job_queries as J
from deskloom.functions.rules import STOP_WORDS, TAXONOMY
from deskloom.plans.decide import matched_pairs, retrieve
from deskloom.operators import learners as L
from deskloom.operators.sampling import stratified_folds, stratified_split
from deskloom.operators.matching import drop_leaked
from deskloom.plans import evaluate as E
from parity import connect

SF = "/root/testdata/sf0.01"


def grams(text):
    words = [w for w in regex.findall(r"[\p{L}\p{N}_]{2,}", (text or "").lower()) if w not in STOP_WORDS]
    return Counter([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))])


def vocabulary_of(counts, size=3000):
    total, df = Counter(), Counter()
    for c in counts:
        total.update(c)
        df.update(c.keys())
    top = sorted(sorted(total, key=lambda t: (-total[t], t.encode()))[:size], key=str.encode)
    return {t: (i, math.log((1 + len(counts)) / (1 + df[t])) + 1) for i, t in enumerate(top)}


def matrix(counts, vocabulary, width):
    x = np.zeros((len(counts), width))
    for row, c in zip(x, counts):
        for t, n in c.items():
            if t in vocabulary:
                i, idf = vocabulary[t]
                row[i] = (1 + math.log(n)) * idf
        row /= np.linalg.norm(row) or 1
    return x


def softmax(model, x):
    z = x @ model.coefficientMatrix.toArray().T + model.interceptVector.toArray()
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def check_fit(model, x, y, penalty, near):
    """The gradient of the penalised mean loss vanishes at the exported coefficients."""
    p = softmax(model, x) - np.eye(len(model.interceptVector))[y]
    slope = p.T @ x / len(x) + penalty * model.coefficientMatrix.toArray()
    assert np.abs(slope).max() < near and np.abs(p.mean(axis=0)).max() < near


def labelled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    return docs.select("doc_id", "text", "quality")


def test_tfidf_lr(spark):
    split = L.materialize(stratified_split(labelled(spark), "quality", "doc_id"), "split")
    rows = split.collect()
    model = L.fit_text_model(split.filter("split = 'train'"), "doc_id", "text", "quality", ("low", "high"), max_iter=50)
    train, test = ([r for r in rows if r.split == s] for s in ("train", "test"))
    counts = [grams(r.text) for r in train]
    vocabulary = vocabulary_of(counts)
    kept = {r.term: (r.idx, r.idf) for r in model.vocabulary.collect()}
    assert {t: i for t, (i, _) in kept.items()} == {t: i for t, (i, _) in vocabulary.items()}
    assert all(kept[t][1] == pytest.approx(idf) for t, (_, idf) in vocabulary.items())
    x = matrix(counts, vocabulary, model.size)
    check_fit(model.model, x, [r.quality for r in train], 1 / len(train), 2e-3)
    p = softmax(model.model, matrix([grams(r.text) for r in test], vocabulary, model.size))
    got = {r.doc_id: r for r in entry.queries()["tfidf_lr"](spark, SF).collect()}
    assert set(got) == {r.doc_id for r in test}
    for r, each in zip(test, p):
        assert got[r.doc_id].confidence == pytest.approx(each.max(), abs=1e-3)
        if abs(each[0] - each[1]) > 1e-3:
            assert got[r.doc_id].predicted == ("low", "high")[each.argmax()]


def test_tfidf_lr_is_fitted_to_the_end(spark, tmp_path, monkeypatch):
    """The fit has the model's 1000 iterations and ends because it converged."""
    pick = random.Random(7)
    docs = [(i, " ".join(pick.choices([f"word{n}" for n in range(600)], k=60))) for i in range(500)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, int(pick.random() < 0.8)) for i, _ in docs]
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    fitted, fit = [], L.fit_text_model
    monkeypatch.setattr(L, "fit_text_model", lambda *a, **b: fitted.append(fit(*a, **b)) or fitted[-1])
    assert entry.queries()["tfidf_lr"](spark, str(tmp_path)).count() == 100
    model = fitted[0].model
    assert model.summary.totalIterations < model.getMaxIter() == 1000


def test_folds_share_one_count(spark):
    dealt = L.materialize(stratified_folds(labelled(spark), "quality", "doc_id", 5), "dealt")
    rows = dealt.collect()
    single = L._term_rows(dealt, "doc_id", "text").join(dealt.select(F.col("doc_id").alias("item"), "fold"), "item")
    sizes = dealt.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    found = {}
    for r in L.fold_vocabularies(single.select("fold", "item", "term", "tf"), sizes, 5).collect():
        found.setdefault(r.fold, {})[r.term] = (r.idx, r.idf)
    features = L.fold_features(dealt, "doc_id", "text", "quality", 5)
    vectors = {(r.model, r.item): r.features.toArray() for r in features.collect()}
    assert len(vectors) == 5 * len(rows)
    for fold in range(5):
        vocabulary = vocabulary_of([grams(r.text) for r in rows if r.fold != fold])
        assert {t: i for t, (i, _) in found[fold].items()} == {t: i for t, (i, _) in vocabulary.items()}
        assert all(found[fold][t][1] == pytest.approx(idf) for t, (_, idf) in vocabulary.items())
        x = matrix([grams(r.text) for r in rows], vocabulary, 3000)
        assert np.allclose(x, np.stack([vectors[fold, r.doc_id] for r in rows]))


def test_rare_terms_are_not_written(spark, monkeypatch):
    """Most terms come once: what the folds write are frequent terms, a row for each text and counts."""
    pick = random.Random(4)
    common = [f"word{n}" for n in range(30)]
    texts = [" ".join(w for n in range(40) for w in (pick.choice(common), f"rare{i}x{n}")) for i in range(60)]
    dealt = spark.createDataFrame([(i, t, i % 2, i % 3) for i, t in enumerate(texts)], "id long, t string, y int, fold int")
    written = []
    keep = lambda df, label: written.append(L_materialize(df, label)) or written[-1]
    L_materialize = L.materialize
    monkeypatch.setattr(L, "materialize", keep)
    monkeypatch.setattr(L, "SHARE", 1e-3, raising=False)
    assert L.fold_features(dealt, "id", "t", "y", 3, 20).count() == 180
    assert sum(df.count() for df in written) < 60 * 40


@pytest.mark.parametrize("settings", [{}, {"SHARE": 0.2}, {"PART": 3}, {"CANDIDATES": 0}, {"COUNTED": 50, "SHARE": 0.02}])
def test_folds_whatever_terms_are_candidates(spark, monkeypatch, settings):
    """An id with two texts and two folds, null and empty texts, pairs; too few or too many candidates at first."""
    for name, value in settings.items():
        monkeypatch.setattr(L, name, value)
    pick = random.Random(5)
    words = [f"é{n}" for n in range(40)] + ["the", "x"]
    line = lambda: " ".join(pick.choices(words, [1 / (n + 1) for n in range(42)], k=pick.randint(0, 30)))
    rows = [(i, line(), i % 2, i % 3) for i in range(40)] + [(7, line(), 1, 0), (40, None, 0, 1), (41, "", 1, 2), (None, line(), 0, 1)]
    dealt = spark.createDataFrame(rows, "id long, t string, y int, fold int")
    got = [(r.model, r.item, r.fold, r.label, r.features.toArray()) for r in L.fold_features(dealt, "id", "t", "y", 3, 25).collect()]
    assert sorted((m, str(i), f, y) for m, i, f, y, _ in got) == sorted((m, str(i), f, y) for m in range(3) for i, _, y, f in rows)
    bag = {i: sum((grams(t) for j, t, *_ in rows if j == i), Counter()) for i, *_ in rows}
    bag[None] = Counter()  # a null id has no terms
    for model in range(3):
        train = [bag[i] for i, _, _, f in rows if f != model]
        vocabulary = vocabulary_of(train, 25)
        for m, i, _, _, features in got:
            if m == model:
                assert np.allclose(features, matrix([bag[i]], vocabulary, 25)[0])


def test_text_cross_validation(spark):
    """Predictions of every fold from separately fitted and exported models."""
    df = L.materialize(labelled(spark), "quality")
    dealt = L.materialize(stratified_folds(df, "quality", "doc_id", 5), "dealt")
    got = {r.item: r for r in E.cross_validate(df, "doc_id", "text", "quality", ("low", "high"), max_iter=20).collect()}
    rows = dealt.collect()
    assert {r.doc_id: r.fold for r in rows} == {i: r.fold for i, r in got.items()}
    for fold in range(2):
        train = [r for r in rows if r.fold != fold]
        model = L.fit_text_model(dealt.filter(F.col("fold") != fold), "doc_id", "text", "quality", ("low", "high"), max_iter=20)
        vocabulary = vocabulary_of([grams(r.text) for r in train])
        held = [r for r in rows if r.fold == fold]
        p = softmax(model.model, matrix([grams(r.text) for r in held], vocabulary, model.size))
        for r, each in zip(held, p):
            assert got[r.doc_id].actual == ("low", "high")[r.quality]
            if abs(each[0] - each[1]) > 0.02:
                assert got[r.doc_id].predicted == ("low", "high")[each.argmax()]


def test_embedding_queries(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    split = L.materialize(stratified_split(table, "label", "vec_id"), "split")
    rows = split.collect()
    model = L.fit_embedding_model(split.filter("split = 'train'"), "embedding", "label")
    test = [r for r in rows if r.split == "test"]
    p = softmax(model, np.array([r.embedding for r in test], float))
    got = {r.vec_id: r for r in entry.queries()["embedding_classify"](spark, SF).collect()}
    assert set(got) == {r.vec_id for r in test}
    for r, each in zip(test, p):
        first, second = np.sort(each)[::-1][:2]
        assert got[r.vec_id].confidence == pytest.approx(first, abs=1e-3)
        if first - second > 1e-3:
            assert got[r.vec_id].predicted == str(each.argmax())
    dealt = L.materialize(stratified_folds(table, "label", "vec_id"), "folds")
    rows, right = dealt.collect(), []
    for fold in range(5):
        model = L.fit_embedding_model(dealt.filter(F.col("fold") != fold), "embedding", "label", max_iter=20)
        held = [r for r in rows if r.fold == fold]
        p = softmax(model, np.array([r.embedding for r in held], float))
        right.append(np.mean([r.label == each.argmax() for r, each in zip(held, p)]))
    summary = {(r.metric, r.label): r for r in entry.queries()["cross_validation"](spark, SF).collect()}
    assert summary["accuracy", "*"].mean == pytest.approx(np.mean(right), abs=5e-3)
    assert summary["accuracy", "*"]["std"] == pytest.approx(np.std(right), abs=5e-3)


def test_system_replies(spark):
    """The fitted system from its exported coefficients; every other value from the benchmark's SQL."""
    got = {(r.model, r.case_id): r for r in entry.queries()["system_replies"](spark, SF).collect()}
    sql = f"WITH {J.SYSTEMS_SQL} SELECT model, case_id, actual, predicted, reply, suppressed, overall FROM scored"
    plain = connect(SF).sql(sql).fetchall()
    assert set(got) == {row[:2] for row in plain}
    for model, case, actual, predicted, reply, suppressed, overall in plain:
        r = got[model, case]
        assert (r.actual, r.reply, r.suppressed) == (actual, reply, suppressed)
        assert r.overall == pytest.approx(overall) and (model == "simple" or r.predicted == predicted)

    golden = J._golden(spark, SF)
    train = L.materialize(drop_leaked(J.training_turns(spark, SF), golden), "train")
    held = {r.text for r in golden.collect()}
    rows = train.collect()
    assert len(rows) == sum(r.text not in held for r in J.training_turns(spark, SF).collect())
    labels = list(TAXONOMY)
    numbered = train.withColumn("_y", F.array_position(F.array(*map(F.lit, labels)), F.col("intent")) - 1)
    model = L.fit_text_model(numbered, "case_id", "text", "_y", labels)
    vocabulary = vocabulary_of([grams(r.text) for r in rows])
    x = matrix([grams(r.text) for r in rows], vocabulary, model.size)
    check_fit(model.model, x, [labels.index(r.intent) for r in rows], 1 / len(rows), 2e-3)
    cases = golden.collect()
    p = softmax(model.model, matrix([grams(r.text) for r in cases], vocabulary, model.size))
    sure = 0
    for r, each in zip(cases, p):
        first, second = np.sort(each)[::-1][:2]
        if first - second > 1e-3:
            sure += 1
            assert got["simple", r.case_id].predicted == labels[each.argmax()]
    assert sure > len(cases) / 2


def test_terms_outside_the_vocabulary_do_not_move(spark):
    """Terms meet the vocabulary in a broadcast join, whatever size Spark takes it for."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        terms = spark.createDataFrame([(1, "all", "a", 2), (1, "all", "b", 1), (2, "all", "x", 1)], "item long, grp string, term string, tf long")
        vocabulary = spark.createDataFrame([("a", 0, 1.5), ("b", 1, 2.0)], "term string, idx int, idf double")
        featured = L._features(spark.createDataFrame([(1,), (2,)], "id long"), "id", terms, vocabulary, 2)
        plan = featured._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin [term") == 1 and "SortMergeJoin [term" not in plan
        a, b = (1 + math.log(2)) * 1.5, 2.0
        got = {r.id: r.features.toArray().tolist() for r in featured.collect()}
        assert np.allclose(got[1], [a / math.hypot(a, b), b / math.hypot(a, b)]) and got[2] == [0.0, 0.0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_retrieve_moves_no_texts(spark):
    """What a search gives its rows are ids, once for rows that share a text; texts come by one lookup."""
    pairs = [("p1", "c1", "X", "battery drains fast", "reply one"), ("p2", "c2", "X", "screen is black", "reply two")]
    vault = spark.createDataFrame(pairs, "pair_id string, case_id string, intent string, customer_query string, agent_reply string")
    asked = [(1, "k", "X", "my battery drains"), (2, "k", "X", "my battery drains"), (3, "m", "Y", "none")]
    rows = spark.createDataFrame(asked, "_row long, query_key string, target string, text string")
    found = retrieve(rows, rows.select("query_key", "text", "target").distinct(), vault, 2)
    assert found.columns == ["_row", "target", "best", "top_similarity"]
    got = {r["_row"]: [b["item"] for b in r["best"]] for r in found.collect()}
    assert got == {1: ["p1", "p2"], 2: ["p1", "p2"]}
    matches = {r["_row"]: [(m["pair_id"], m["agent_reply"]) for m in r["matches"]] for r in matched_pairs(found, vault, "_row").collect()}
    assert matches[2] == [("p1", "reply one"), ("p2", "reply two")]
