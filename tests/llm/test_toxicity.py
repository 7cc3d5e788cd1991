"""Scores of the registered query, recomputed from the fitted dictionaries and weights."""

import math
import zlib

import zstandard

import __spark_entry__ as entry
from deskloom.llm import toxicity

SF = "/root/testdata/sf0.01"


def lengths(content: bytes):
    """Function from a window to its compressed bytes after ``content``."""
    settings = zstandard.ZstdCompressionParameters.from_level(
        toxicity.LEVEL, min_match=toxicity.LEAST_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return lambda w: len(zstandard.ZstdCompressor(compression_params=settings, dict_data=held).compress(w))


def plain_score(model, plain, rude, text: str | None) -> float:
    words = (text or "").encode().lower().split()
    saved = [plain(w) - rude(w) for w in (b" ".join(words[i : i + 12]) for i in range(0, len(words), 12))]
    x = [0.0] * 11
    if saved:
        least = [sum(s >= k for s in saved) for k in range(1, 7)]
        x = [math.log1p(n) for n in least] + [n / len(saved) for n in least[:3]]
        x += [sum(saved) / len(saved), math.log1p(len(saved))]
    z = model.weights[-1] + sum(w * (v - c) / s for w, v, c, s in zip(model.weights, x, model.centre, model.spread))
    return 1 / (1 + math.exp(-max(-60, min(60, z))))


def test_query(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    plain, rude = lengths(model.ordinary), lengths(model.toxic)
    got = {r["doc_id"]: r for r in entry.queries()["op5_toxicity"](spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        score = plain_score(model, plain, rude, r["text"])
        row = got[r["doc_id"]]
        assert abs(row["score"] - score) < 1e-6
        assert row["predicted"] == int(row["score"] >= 0.7)
        assert row["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.scored(docs, toxicity.fit(docs, labels), ["doc_id"]).count() == 0
