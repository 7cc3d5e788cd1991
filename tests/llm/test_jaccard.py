"""Set join by several token orders against all pairs."""

import random

import numpy as np
import pytest

from deskloom.llm import jaccard
from llm import brute
from llm.test_edges import ROWS, docs  # noqa: F401  (fixture)


def texts_of(seed: int) -> list[str]:
    """Groups of near copies with few and with many changed words, shared passages, short texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    passage = rng.choices(words, k=60)
    texts = []
    for group in range(40):
        base = rng.choices(words, k=rng.choice([1, 3, 5, 8, 20, 60, 200]))
        if rng.random() < 0.5:
            base[rng.randrange(len(base)) :] = passage
        for _ in range(rng.choice([1, 2, 3, 30])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.2:
                own = own[rng.randrange(len(own)) :] + own[:2]
            texts.append(" ".join(own) if rng.random() < 0.9 else "\n".join(own).upper())
    return texts


def found_by(df, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, **options).collect()}


@pytest.mark.parametrize("percent", [85, 60])
def test_matches_all_pairs(spark, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "FIRST", 2)
    monkeypatch.setattr(jaccard, "GROWTH", 3)
    texts = texts_of(percent)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = brute.shingle_sets(enumerate(texts))
    wanted = brute.jaccard_components(sets, percent)
    assert found_by(df, percent=percent) == {k: (len(sets[k]), wanted[k]) for k in sets}
    assert len(set(wanted.values())) < len(wanted)


def test_unrelated_texts_with_common_words(spark):
    """Long lists whose members are far apart, beside pairs of near copies; many heavy tokens."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(45)]
    texts = []
    for i in range(150):
        own = [f"o{rng.randrange(10**6)}" for _ in range(15 + i % 6)]
        at = rng.randrange(len(own))
        texts.append(" ".join(own[:at] + common + own[at:]))
        if i % 10 == 0:
            texts.append(texts[-1] + " more")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = brute.shingle_sets(enumerate(texts))
    wanted = brute.jaccard_components(sets)
    assert found_by(df) == {k: (len(sets[k]), wanted[k]) for k in sets}


def test_edges(docs):  # noqa: F811
    got = jaccard.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    sets = brute.shingle_sets((i, r[1]) for i, r in enumerate(ROWS))
    assert sorted(r["n_shingles"] for r in got) == sorted(map(len, sets.values()))
    component = {}
    for r in got:
        component.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert component[1] == component[2] == {1}
    assert component[3] == {3} and component[4] == {4} and component[5] == {5}
    assert component[7] == {7} and component[None] == {7, None}  # near the text of 7, and alone
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_null_ids_join_a_group(spark):
    df = spark.createDataFrame([(None, "a b c d e f g"), (7, "a b c d e f g"), (9, "A B c d e f g"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == sorted([(None, 4, 7), (7, 4, 7), (9, 4, 7), (None, 0, None)], key=repr)


def test_prefixes_meet_under_every_order():
    """Two sets at the threshold share a prefix token under each order, whatever else is known."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        a, b = base.copy(), base.copy()
        for s in (a, b):
            change = rng.random(n) < rng.choice([0, 0.03, 0.08])
            s[change] = rng.integers(0, 1 << 63, int(change.sum()), dtype=np.uint64)
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if 100 * common < 85 * (len(a) + len(b) - common):
            continue
        every = np.union1d(a, b)
        counted = every[every % np.uint64(jaccard.COUNTED) == 0]
        bucket, low = jaccard._codes(counted, 16)
        codes = (bucket << 32) | low.astype(np.int64)
        df = np.where(np.isin(counted, a) & np.isin(counted, b), rng.integers(2, 9, len(codes)), rng.integers(1, 3, len(codes)))
        heavy = np.sort(codes[(df > 1) & (rng.random(len(codes)) < 0.2)])
        known = (df > 1) & ~np.isin(codes, heavy)
        prefixes = [jaccard.orders(s, codes[known], df[known], heavy, 16, 85) for s in (a, b)]
        for x, y in zip(*prefixes):
            assert len(np.intersect1d(x, y))


def test_lists_with_the_same_members_are_read_once(spark):
    """Tokens 1, 2 and 3 are in the same texts; 4 in others, 5 in one only."""
    rows = [(t, n) for t in (1, 2, 3) for n in (10, 11, 12)] + [(4, 10), (4, 11), (4, 13), (5, 10)]
    kept = jaccard.distinct_lists(spark.createDataFrame(rows, "token long, node long"))
    assert sorted((r.token, r.node) for r in kept.collect()) == [(1, 10), (1, 11), (1, 12), (4, 10), (4, 11), (4, 13)]


def test_near_copies_make_a_pair_each(spark):
    """In the first round, m near copies in several lists make m - 1 pairs a list."""
    members = list(range(10, 22))
    lists = {1: members, 2: members[1:], 3: members[:5]}
    bits = bytes(64)
    rows = [(t, 100, n, n, bits) for t, nodes in lists.items() for n in nodes]
    df = spark.createDataFrame(rows, "token long, n long, node long, component long, bits binary")
    got = {tuple(r) for r in jaccard.candidates(df, 0, jaccard.FIRST, 85).collect()}
    assert got == {(nodes[0], n) for nodes in lists.values() for n in nodes[1:]}


def test_near_copies_meet_in_one_list_first(spark, monkeypatch):
    """Of 40 near copies that share dozens of lists, no pair is made twice, and no link is lost."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(40):
        words = list(base)
        for at in rng.choice(300, 3, replace=False):
            words[at] = f"x{i}{at}"
        texts.append(" ".join(words))
    made = []
    plain = jaccard.candidates

    def counted(lists, begin, end, percent):
        found = plain(lists, begin, end, percent)
        entries = lists.select("token", "node").collect()
        made.append((begin, len(entries), len({r.node for r in entries})))
        return found

    monkeypatch.setattr(jaccard, "candidates", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = brute.shingle_sets(enumerate(texts))
    wanted = brute.jaccard_components(sets)
    assert found_by(df) == {k: (len(sets[k]), wanted[k]) for k in sets}
    assert made[0][1] == made[0][2] > 0  # an entry for each node


def test_lists_of_a_common_passage_take_few_rounds(spark, monkeypatch):
    """150 texts far apart that share a passage: no member is near another, so the lists are done at once."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(45)]
    texts = [" ".join([f"o{rng.randrange(10**6)}" for _ in range(20)] + common) for _ in range(150)]
    texts.append(texts[0] + " more")
    rounds, plain = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda *a: rounds.append(1) or plain(*a))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = brute.shingle_sets(enumerate(texts))
    wanted = brute.jaccard_components(sets)
    assert found_by(df) == {k: (len(sets[k]), wanted[k]) for k in sets}
    assert wanted[150] == 0 and len(rounds) <= 2


@pytest.mark.parametrize("size", [12, 40])
def test_lists_with_more_pairs_are_told(spark, size):
    """Members of a list meet two earlier ones of other components, and the list goes on if there are more."""
    members = list(range(10, 10 + size))
    rows = [(t, 100, n, n, bytes(64)) for t in (1, 2, 3) for n in (members if t == 2 else members[:3])]
    df = spark.createDataFrame(rows, "token long, n long, node long, component long, bits binary").coalesce(1)
    got = {tuple(r) for r in jaccard.compared(df, 0, 2, 85).collect()}
    assert got == {(x, n) for n in members for x in members[:2] if x < n} | {(2, None)}
