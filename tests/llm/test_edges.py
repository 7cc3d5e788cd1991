"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from deskloom.llm import decontaminate, licenses, mixing, quality, simhash, substring, tokens, toxicity, urls, warc
from deskloom.llm.common import prepare
from deskloom.llm.queries import ANCHOR, DOMAIN, END_ID, RULES, WEIGHTS, vocabulary
from llm import brute

PROSE = " ".join(f"word{i % 97} item{i % 89} thing{i % 83}" for i in range(40))
OTHER = " ".join(f"alpha{i} beta{i}" for i in range(60))
LONG = " ".join(f"w{i * 7919 % 50021}" for i in range(60_000))
ROWS = [
    (1, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, " \t\n ", "en", "b"),
    (6, LONG, "de", "b"),
    (7, OTHER + "\nReleased under the MIT License.\nAll rights reserved.", "en", "b"),
    (8, "one two", "en", "b"),
    (None, OTHER, "en", "b"),
    (None, "lonely text", "en", "b"),
    (9, "\u00dcber \u6f22\u5b57 \U0001f600 e\u0301 <|endoftext|> it's 3.14 ... x\u00a0y\u2028z \u0130", "en", "b"),
]
CLASHES = "row fp kept found n_words id key before p doc text2 print root n_tokens rate copies times nth base_failed".split()
ITEMS = [(1, " ".join(OTHER.split()[20:40])), (2, "two"), (3, None), (4, ""), (5, "!!"), (None, "lonely text"), (1, "thing1")]


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    base = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return base.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES]).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_quality(docs):
    got = quality.judged(docs, ["doc_id", "text", "kept"]).select("row.doc_id", "row.text", *quality.COUNTS, "base_failed", "kept")
    found = got.collect()
    assert len(found) == len(ROWS)
    for r in found:
        n, chars, symbols, lines, repeats, failed = brute.base_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (n, chars, symbols, lines)
        assert (r["n_repeat_words"], r["base_failed"]) == (repeats, failed)
    assert quality.filter_quality(docs).columns == docs.columns
    assert quality.filter_quality(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a a", "a b a b a b x y", "p q r s p q r t p q", "x y", ""])
def test_repeated_words(spark, text):
    got = spark.range(1).select(quality.counts(F.lit(text)).alias("c")).select("c.words.n_repeat_words").first()[0]
    assert got == brute.base_counts(text)[4]


def test_fences_follow_the_group(spark):
    """A symbol rate that is normal in one source is an outlier in another."""
    body = " ".join(f"plain{i}" for i in range(100))
    marked = " ".join(f"plain{i}#" for i in range(100))
    rows = [(i, marked, "en", "code") for i in range(300)] + [(i, body, "en", "news") for i in range(1000, 1300)]
    df = spark.createDataFrame([*rows, (5000, marked, "en", "news")], "doc_id long, text string, lang string, source string")
    kept = {r[0] for r in quality.judged(df, ["doc_id"]).filter("kept").select("row.doc_id").collect()}
    assert kept == {r[0] for r in rows}


def test_fences_follow_the_spread(spark):
    """The same symbols go in a source of like texts and stay in a mixed one; poor texts lift no fence."""

    def body(words: int, symbols: int) -> str:
        return " ".join(f"plain{i}" for i in range(words)) + " " + "#" * symbols

    rows, wanted = [], set()
    for source, spread in (("narrow", 10), ("wide", 1500)):
        for i in range(300):
            rows.append((len(rows), body(200 + spread * (i % 20) // 20, 0), "en", source))
            wanted.add(rows[-1][0])
        rows.append((len(rows), body(300, 12), "en", source))
        wanted |= {rows[-1][0]} if source == "wide" else set()
        rows.append((len(rows), body(190, 0), "en", source))
        wanted.add(rows[-1][0])
        rows += [(len(rows) + i, body(300, 300), "en", source) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r[0] for r in quality.judged(df, ["doc_id"]).filter("kept").select("row.doc_id").collect()}
    assert kept == wanted


def plain_verdicts(rows, least_rows=quality.LEAST_ROWS):
    """rows (id, text, lang, source) -> id: kept, from exact quantiles of lists."""
    import math

    measured, groups = {}, {}
    for i, text, lang, source in rows:
        n, chars, symbols, repeated, _, failed = brute.base_counts(text)
        lines = sum(bool(brute.SPACED.search(x)) for x in (text or "").split("\n"))
        if not failed:
            each = (math.log((symbols + 0.5) / (n + 1)), math.log((repeated + 0.5) / (lines + 1)), math.log(chars / n))
            measured[i] = each
            for g in ((lang, source), (lang,), ()):
                groups.setdefault(g, []).append(each)

    def fence(g, m):
        values = sorted(v[m] for v in groups[g])
        middle, high = (values[math.ceil(q * len(values)) - 1] for q in (0.5, quality.HIGH))
        reach, tie = list(quality.MEASURES.values())[m]
        return high + reach * max(high - middle, tie)

    out = {}
    for i, _, lang, source in rows:
        fit = next((g for g in ((lang, source), (lang,)) if len(groups.get(g, ())) >= least_rows), ())
        out[i] = i in measured and all(measured[i][m] <= fence(fit, m) + 1e-12 for m in range(3))
    return out


def test_kept_matches_exact_quantiles(spark):
    """The registered query against lists; groups of 200 rows and more are held whole by their sketch."""
    from deskloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    got = {r["doc_id"]: r["kept"] for r in QUERIES["op2_quality"](spark, sf).collect()}
    assert got == plain_verdicts(rows)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    failed = {i for i, t, *_ in rows if brute.base_counts(t)[5]}
    assert not any(got[i] for i, q in labels.items() if q == 0)
    assert all(got[i] for i, q in labels.items() if q == 1 and i not in failed)


def test_simhash(docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    prints = {d: brute.simhash(t) for d, t, *_ in ROWS if d is not None}
    assert {d: by_id[d]["fp"] % 2**64 for d in by_id} == prints
    assert by_id[1]["component_id"] == by_id[2]["component_id"] == 1
    assert by_id[3]["component_id"] == by_id[4]["component_id"] == by_id[5]["component_id"] == 3
    lone = next(r for r in got if r["doc_id"] is None and r["fp"] % 2**64 == brute.simhash("lonely text"))
    assert lone["component_id"] is None


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert (1, PROSE) in texts and len([t for t in texts if t[1] == PROSE]) == 1
    assert len([t for t in texts if not (t[1] or "").strip()]) == 1
    assert (None, "lonely text") in texts
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_links_chain_and_block(spark):
    """A chain of 4-bit steps is one component; 5 bits apart is not linked."""
    base = 0x0F0F_1234_5678_9ABC
    chain = [base]
    for i in range(12):
        chain.append(chain[-1] ^ (0b1111 << (4 * i)))
    far = (base ^ ((1 << 64) - 1)) & ((1 << 63) - 1)
    near_far = far ^ 0b11111
    signed = [x - 2**64 if x >= 2**63 else x for x in [*chain, far, near_far]]
    marked = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.fingerprint_components(marked, "doc_id").collect()}
    prints = {i: x % 2**64 for i, x in enumerate(signed)}
    assert {i: got[x] for i, x in enumerate(signed)} == brute.linked(prints)


@pytest.mark.parametrize("long", [2, 5, 1 << 14])
def test_long_lists_are_split(spark, monkeypatch, long):
    """Lists above the size of a task give the same components, of near and of far members."""
    import random

    monkeypatch.setattr(simhash, "LONG", long)
    rng = random.Random(long)
    prints = [rng.getrandbits(32) << 32 | 0x12345678 for _ in range(40)]  # four bytes in common
    for p in prints[:10]:
        prints += [p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(3)]
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    marked = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.fingerprint_components(marked, "doc_id").collect()}
    assert {i: got[x] for i, x in enumerate(signed)} == brute.linked(dict(enumerate(prints)))


def test_decontaminate(docs, items):
    found = decontaminate.matches(docs, items, ["doc_id", "text", "found"])
    wanted = {}
    for i, (_, text, *_) in enumerate(ROWS):
        wanted[text] = brute.benchmark_hits([(0, text)], [("null" if k is None else k, t) for k, t in ITEMS])[0]
    for r in found.select("row.text", "n_words", "matches", decontaminate.hit_words(F.col("matches")).alias("n_hit")).collect():
        n, hit, n_items, digest, _ = wanted[r["text"]]
        ids = sorted({m["item_id"] for m in r["matches"]})
        assert (r["n_words"], r["n_hit"], len(ids)) == (n, hit, n_items)
        assert hashlib.sha256(",".join(ids).encode()).hexdigest() == digest
    small = decontaminate.matches(docs, items, ["doc_id", "text", "found"], block_bytes=10)
    same = ["row.doc_id", "row.text", "n_words", decontaminate.hit_words(F.col("matches")), decontaminate.hit_items(F.col("matches"))]
    assert rows_of(small.select(*same)) == rows_of(found.select(*same))
    assert decontaminate.decontaminate(docs, items).columns == docs.columns
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == len(ROWS)
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0


def test_longest_match(spark, items):
    df = spark.createDataFrame([(1, "x x " + " ".join(OTHER.split()[18:38]) + " y")], "doc_id long, text string")
    found = decontaminate.matches(df, items.filter("item_id = 1"), ["doc_id"]).first()["matches"]
    assert [tuple(m) for m in found] == [("1", 0, 4, 18)]


def test_substring(docs):
    untouched, affected = substring.deduplicated(docs)
    got = [(r["doc_id"], r["n_words"], 0, r["digest"]) for r in untouched.collect()]
    got += [
        (r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest())
        for r in affected.collect()
    ]
    wanted = brute.substring_dedup([(i, t) for i, (_, t, *_) in enumerate(ROWS)])
    assert sorted(got, key=repr) == sorted(((ROWS[i][0], *v) for i, v in wanted.items()), key=repr)
    assert substring.deduplicated(docs.limit(0))[0].count() == 0


def test_substring_periodic_and_branching(spark):
    common = [f"c{i}" for i in range(60)]
    texts = [
        "la " * 200,
        "la la lu " * 70,
        " ".join([*common, "end", "one"]),
        " ".join(["start", *common[:50], "fork"]),
        " ".join([*common[10:45], "z"]),
        " ".join(common[20:54]),
        " ".join(["q", *common[3:40], *common[20:60]]),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    untouched, affected = substring.deduplicated(df)
    got = {r["doc_id"]: 0 for r in untouched.collect()} | {r["doc_id"]: r["n_removed"] for r in affected.collect()}
    assert got == {k: v[1] for k, v in brute.substring_dedup(list(enumerate(texts))).items()}


def test_licenses(docs):
    found = licenses.scan(docs, ["doc_id", "text", "found"]).select("row.text", "n_words", "places", "found").collect()
    assert len(found) == len(ROWS)
    for r in found:
        n, n_base, first, last, labels = brute.base_licenses(r["text"])
        starts = [p["word"] for p in r["places"]]
        assert (r["n_words"], len(starts), min(starts, default=None), max(starts, default=None)) == (n, n_base, first, last)
        assert ",".join(sorted({p["label"] for p in r["places"]})) == labels
        if "MIT" in (r["text"] or ""):
            assert {f["label"] for f in r["found"]} == {"mit", "reserved"}
    assert licenses.scan(docs, ["doc_id"], templates=()).count() == len(ROWS)
    assert licenses.scan(docs.limit(0), ["doc_id"]).count() == 0


def test_license_join_is_exact(spark):
    """Every block at or above the share is found, whatever the filters skip."""
    words = [f"t{i}" for i in range(12)]
    templates = [("x", " ".join(words)), ("y", " ".join(words[4:] + ["u", "v"])), ("z", "t1 u")]
    lines = [" ".join(words[i:j]) + " filler more" for i in range(6) for j in range(i + 1, 13)]
    lines += ["v u " + " ".join(words[k:]) for k in range(8)] + ["u t1", "t1", " ".join(["pad"] * 200 + words + ["pad"] * 200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    got = licenses.scan(df, ["doc_id"], templates=templates, phrases={}).select("row.doc_id", "found").collect()
    for r in got:
        wanted = set()
        for _, block in licenses.blocks(lines[r["doc_id"]].encode()):
            held = {w.decode() for w in block}
            for label, text in templates:
                t = set(text.split())
                if len(held & t) / len(t) >= licenses.SHARE - 1e-12:
                    wanted.add((label, len(held & t) / len(t)))
        assert {(f["label"], f["share"]) for f in r["found"]} == wanted


@pytest.mark.parametrize("width,mark", [(70, ""), (80, " * "), (72, "# ")])
def test_wrapped_notices(spark, width, mark):
    """A notice is found however its lines are cut, also where it begins within a line."""
    import textwrap

    rows, wanted = [], []
    for label, text in licenses.TEMPLATES:
        lines = textwrap.wrap(f"{' '.join(['pad'] * 11)} {text} {' '.join(['pad'] * 30)}", width - len(mark))
        rows.append((len(rows), "\n".join(mark + line for line in lines)))
        wanted.append({label})
    long = " ".join(f"clause{i}" for i in range(300))
    rows.append((len(rows), long))
    wanted.append({"long"})
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = licenses.scan(df, ["doc_id"], templates=[*licenses.TEMPLATES, ("long", long)], phrases={}).select("row.doc_id", "found")
    got = {r["doc_id"]: {f["label"] for f in r["found"] if f["share"] == 1} for r in found.collect()}
    assert [got[i] - {"reserved"} or got[i] for i in range(len(rows))] == wanted


def test_creative_commons_labels(spark, tmp_path):
    """A CC line gets its own label besides that of its phrase, and no other license's."""
    from deskloom.llm.queries import QUERIES

    wanted = {
        "Licensed under CC BY 4.0.": "cc-by",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "Licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa",
        "Licensed under CC\nBY-NC 4.0.": "cc-by,cc-by-nc",
        "Licensed under the Mozilla License, Version 2.0.": "",
        "CC BY": "cc-by",
    }
    df = spark.createDataFrame(list(enumerate(wanted)), "doc_id long, text string")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op4_licenses"](spark, f"file://{tmp_path}").collect()}
    assert [got[i]["labels"] for i in range(len(wanted))] == list(wanted.values())
    assert [got[i]["base_labels"] for i in range(len(wanted))] == ["cc-by" if "CC" in t else "" for t in wanted]


def test_wrapped_notices_against_the_twin(spark, tmp_path):
    """The DuckDB form finds notices over line ends and inside long lines as well."""
    import textwrap

    import duckdb

    from deskloom.llm.queries import ORACLES, QUERIES
    from parity import compare

    rows = []
    for width in (30, 64, 5000):
        for _, text in licenses.TEMPLATES:
            words = text.split()
            for gone in (0, 1, 3):
                body = " ".join(words[:2] + words[2 + gone :])
                rows.append((len(rows), "\n".join(textwrap.wrap("pad " * (len(rows) % 140) + body + " pad" * 9, width))))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "All rights\nreserved. CC-BY")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(spark, con, f"file://{tmp_path}", QUERIES["op4_licenses"], ORACLES["op4_licenses"]) is None


def test_stretches_match_brute_force():
    import random

    rng = random.Random(4)
    templates = [("x", "a b c d e f g h i j"), ("y", "a c e k l m n o p"), ("z", "b b d n")]
    index = licenses.build_index(templates, {w: 1 for _, t in templates for w in t.encode().split()})
    for _ in range(400):
        words = [rng.choice("abcdefghijklmnopqr") for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice("\n\n ") for w in words).encode()
        best = {}
        for number, (_, t) in enumerate(templates):
            tokens, size = set(t.split()), index.templates[number].stretch
            held = [set(words[i : i + size]) for i in range(len(words))]
            held += [{w.decode() for w in block} for _, block in licenses.blocks(text)]
            most = max((len(h & tokens) / len(tokens) for h in held), default=0)
            if most >= licenses.SHARE:
                best[number] = most
        got = {}
        for _, number, share in licenses.text_matches(index, text, [w.encode() for w in words]):
            got[number] = max(got.get(number, 0), share)
        assert got == best


def test_toxicity_and_mixing(spark, docs):
    rude = [(100 + i, f"{OTHER} nastyword{i % 3} {PROSE[i * 7 : i * 7 + 90]} nastyword{(i + 1) % 3}") for i in range(90)]
    nice = [(400 + i, f"{PROSE[i * 5 : i * 5 + 200]} {OTHER[i * 3 : i * 3 + 200]}") for i in range(120)]
    labels = [(d, 1, 1) for d, _ in rude] + [(d, 1, 0) for d, _ in nice] + [(1, 0, 0), (1, 0, 0), (None, 1, 1), (2, None, None)]
    more = spark.createDataFrame([(d, t, "en", "a") for d, t in rude + nice], "doc_id long, text string, lang string, source string")
    all_docs = docs.unionByName(more, allowMissingColumns=True)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(all_docs, known)
    got = toxicity.scored(all_docs, model, ["doc_id", "rate"]).select("row.doc_id", "score").collect()
    assert len(got) == len(ROWS) + len(rude) + len(nice) and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    assert min(score[d] for d, _ in rude) > max(score[d] for d, _ in nice)
    none = toxicity.fit(all_docs, known.limit(0))
    assert all(r["score"] < 1e-9 for r in toxicity.scored(docs, none, ["doc_id"]).collect())

    options = dict(anchor=ANCHOR, keep=["doc_id", "rate"])
    rows, classifier = mixing.mixed(all_docs, known, F.expr(DOMAIN), WEIGHTS, **options)
    found = rows.select("row.doc_id", "n_tokens", "p", "rate").collect()
    assert len(found) == len(got) and all(abs(sum(r["p"]) - 1) < 1e-9 and r["rate"] >= 0 for r in found)
    assert mixing.resampled(all_docs, known, F.expr(DOMAIN), WEIGHTS, anchor=ANCHOR).columns == all_docs.columns
    assert mixing.resampled(docs, known.limit(0), F.expr(DOMAIN), WEIGHTS, anchor=ANCHOR).count() == len(ROWS)
    assert mixing.resampled(docs.limit(0), known, F.expr(DOMAIN), WEIGHTS, anchor=ANCHOR).count() == 0


def test_urls(spark):
    texts = [None, "", "no scheme", "http://", "HTTPS://A.Example.NET/en/x?y#z", "http://example.net/en", "x://net/", "x://net",
             "http://example.com/de/a://b.org/fr/", "http://notexample.com/de/", "http://u@b.org:80/fr/", "http://b.org/fr/?q", "http://K\u0130.org/fr/"]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "page_id long, url string, host string")
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    got = urls.judge(df, RULES, ["page_id", "host"]).select("row.page_id", "host", "path", "rule", "verdict").collect()
    for r in got:
        best = brute.url_rule(texts[r["page_id"]], rules)
        assert (r["host"], r["path"]) == brute.url_parts(texts[r["page_id"]])
        assert (r["rule"], r["verdict"]) == (best or (None, "allow"))
    assert urls.judge(df.limit(0), RULES, ["page_id"]).count() == 0
    with pytest.raises(ValueError):
        urls.build_trie([("block", "x" * 100, "y" * urls.MOST_RULE_BYTES)])


def test_trie_prefers_longest():
    trie = urls.build_trie([urls.parse_rule("block", "a.b"), urls.parse_rule("allow", "a.b/x"), urls.parse_rule("block", "a.b/x/y"), urls.parse_rule("allow", "b/x/y/z"), urls.parse_rule("allow", "a.b/x")])
    assert urls.match(trie, "a.b", "") == ("a.b", "block")
    assert urls.match(trie, "c.a.b", "/xyz") == ("a.b/x", "allow")
    assert urls.match(trie, "a.b", "/x/yes") == ("a.b/x/y", "block")
    assert urls.match(trie, "q.b", "/x/y/z1") == ("b/x/y/z", "allow")
    assert urls.match(trie, "q.b", "/x/y") is None


def test_warc(spark):
    big, small = "x" * 1500, "y" * 999
    rows = [(1, "u\r\nX: 1", big), (5, "u", big), (5, "u", big), (3, None, big), (7, "v", small), (8, "v", small), (9, "w", None), (10, "w", ""), (None, "n", big), (11, "\u00fc", "\u00e9" * 600)]
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, digest string")
    read = warc.archived(pages)
    got = rows_of(read.select("page_id", F.octet_length("payload"), "record_type", "refers_to"))
    wanted = [(1, 1500, "revisit", 5), (5, 1500, "response", None), (5, 1500, "response", None), (3, 1500, "revisit", 5), (7, 999, "response", None), (8, 999, "response", None), (9, 0, "response", None), (10, 0, "response", None), (None, 1500, "revisit", 5), (11, 1200, "response", None)]
    assert got == sorted(wanted, key=repr)
    for r in read.select("header", "payload", "record_type", warc.record_bytes(read).alias("record")).collect():
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert block[size:] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
        assert block[:size].partition(b"\r\n\r\n")[2] == (r["payload"] if r["record_type"] == "response" else b"")
    assert warc.archived(pages.limit(0)).count() == 0


def test_damaged_payload_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    archive = warc.write_archive(pages, f"file://{tmp_path}/a")
    bad = spark.read.parquet(archive.payloads).withColumn("payload", F.lit(b"other"))
    bad.write.parquet(f"file://{tmp_path}/bad")
    with pytest.raises(Exception, match="doesn't fit its digest"):
        warc.read_archive(spark, warc.Archive(archive.records, f"file://{tmp_path}/bad")).collect()


def test_tokens(spark, docs, tmp_path):
    files = tokens.write_sequences(docs, f"file://{tmp_path}/t", vocabulary(), END_ID, sequence=64, batch=4)
    read = tokens.read_documents(files).collect()
    assert len(read) == len(ROWS)
    wanted = brute.token_rows([(i, t) for i, (_, t, *_) in enumerate(ROWS)], vocabulary(), END_ID)
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in read) == sorted(v[1:] for v in wanted.values())
    ordered = sorted(read, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x or 0))
    assert [r["start"] for r in ordered] == [sum(x["n_tokens"] for x in ordered[:i]) for i in range(len(ordered))]
    path = max(files.collect(), key=lambda f: f["n_tokens"])["path"]
    ids, mask = tokens.sequence_at(path, 5, batch=4)
    assert ids.shape == mask.shape == (64,) and mask.all()
    reader = tokens.open_sequences(path)
    assert {reader.get_batch(i).num_rows for i in range(reader.num_record_batches - 1)} <= {4}
    assert tokens.tokenized(docs.limit(0), vocabulary(), END_ID).count() == 0


def test_letters_compose_with_few_marks():
    import string
    import unicodedata

    marks = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "M"]
    joined = {m for m in marks for x in string.ascii_letters if len(unicodedata.normalize("NFC", x + m)) == 1}
    assert joined and all("\u0300" <= m <= "\u037f" for m in joined)


def test_ids_are_those_of_whole_texts():
    """Strings of letters, marks, digits and spaces of many kinds, against the library itself."""
    import random

    import numpy as np
    from tokenizers import Tokenizer

    whole, code = Tokenizer.from_file(vocabulary()), tokens.Encoder(vocabulary())
    rng = random.Random(12)
    letters = list("aAjJhHtTwWyYsSiIkKzZ") + list("\u0130\u0131\u00df\u1e9e\u03a3\u03c3\u00c9\u00e9\u212a\u01c5\ufb01\u6f22\u0915\U0001f600")
    marks = list("\u030c\u0331\u0308\u030a\u0301\u0307\u0323\u093c\u200d\ufe0f")
    others = list("0129.,!?'-_<|>\"") + ["'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "<|"] + list("\u00b2\u0664\u00bd")
    spaces = [" ", " ", "\n", "\t", "\r", "\x0b", "\x0c", "\x00", "\x1c", "\x85", "\u00a0", "\u2028", "\u200b", "\u3000", "\ufeff"]
    texts = ["J\u030cos\u00e9 was here", "H\u0331 T\u0308, W\u030a. Y\u030a"]
    for _ in range(4000):
        kinds = rng.choices([letters, marks, others, spaces], weights=[6, 3, 2, 2], k=rng.randint(0, 25))
        texts.append("".join(rng.choice(k) for k in kinds))
    got = code.encode([t.encode() for t in texts])
    for text, raw in zip(texts, got):
        assert np.frombuffer(raw, code.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids, ascii(text)


def test_pipeline_stages_on_edges(spark, docs):
    here = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        here = stage(spark, here, "/root/testdata/sf0.001")
        assert here.columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, here, "/root/testdata/sf0.001").count() == here.count()
