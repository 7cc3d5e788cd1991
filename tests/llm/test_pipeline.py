"""The chain of stages against plain re-computations of each, and on an empty corpus."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from deskloom.llm import mixing
from deskloom.llm.common import table, written
from deskloom.llm.queries import ANCHOR, DOMAIN, END_ID, WEIGHTS, vocabulary
from llm import brute
from llm.test_edges import plain_verdicts

SF = "/root/testdata/sf0.001"


def test_chain(spark):
    docs = table(spark, SF, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    after, here = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        here = written(stage(spark, here, SF), name)
        after[name] = here.collect()
    kept = plain_verdicts([(i, r["text"], r["lang"], r["source"]) for i, r in rows.items()])
    wanted = {i for i, k in kept.items() if k}
    assert {r["doc_id"] for r in after["quality_rules"]} == wanted and len(wanted) < len(rows)
    component = brute.linked({i: brute.simhash(rows[i]["text"]) for i in wanted})
    wanted = set(component.values())
    assert {r["doc_id"] for r in after["simhash_dedup"]} == wanted
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    hits = brute.benchmark_hits([(i, rows[i]["text"]) for i in wanted], items)
    wanted = {i for i in wanted if not hits[i][-1]}
    assert {r["doc_id"] for r in after["decontamination"]} == wanted
    for name in ("quality_rules", "simhash_dedup", "decontamination"):
        assert len(after[name]) == len({r["doc_id"] for r in after[name]})
        assert all(r == rows[r["doc_id"]] for r in after[name])
    labels = table(spark, SF, "labels")
    left = docs.filter(F.col("doc_id").isin(sorted(wanted)))
    members, _ = mixing.mixed(left, labels, F.expr(DOMAIN), WEIGHTS, ["doc_id"], anchor=ANCHOR)
    times = members.select("row.doc_id", mixing.copies(F.col("rate"), F.col("row.doc_id")).alias("n"))
    copies = {r["doc_id"]: r["n"] for r in times.collect()}
    assert Counter(r["doc_id"] for r in after["mix_to_targets"]) == Counter({i: n for i, n in copies.items() if n})
    once = brute.token_rows([(i, rows[i]["text"]) for i in wanted], vocabulary(), END_ID)
    shown = sorted(after["token_output"], key=lambda r: r["start"])
    assert [r["doc_id"] for r in shown] == sorted(r["doc_id"] for r in after["mix_to_targets"])
    at = 0
    for r in shown:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, *once[r["doc_id"]][1:])
        at += r["n_tokens"]


def test_empty_corpus(spark):
    none = table(spark, SF, "documents").withColumn("kept", F.lit("own")).limit(0)
    here = none
    for name, stage in corpus_pipeline.STAGES:
        here = written(stage(spark, here, SF), name)
        assert here.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert here.columns == none.columns
