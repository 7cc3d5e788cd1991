"""Fill-in-the-middle: places of code points, forms, exact round trip."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskloom.llm import infill
from llm import brute
from llm.test_edges import ROWS, docs  # noqa: F401  (fixture)

SIGNS = ["a", " ", "\n", "\0", "\x7f", "\u0080", "é", "߿", "ࠀ", "漢", "￿", "\U00010000", "😀", "\U0010ffff"]


def test_cuts_match_python():
    rng = random.Random(11)
    for _ in range(300):
        texts = ["".join(rng.choices(SIGNS, k=rng.choice((0, 0, 1, 2, 7, 8, 9, 40)))) for _ in range(rng.randint(1, 9))]
        raw = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, raw)])
        draws = np.array([[rng.getrandbits(32), rng.getrandbits(32)] for _ in texts])
        n, points, places = infill.cut(np.frombuffer(b"".join(raw), np.uint8), offsets, draws)
        for i, t in enumerate(texts):
            a, b = sorted(int(d) % (len(t) + 1) for d in draws[i])
            assert (n[i], *points[i]) == (len(t), a, b)
            assert list(places[i] - offsets[i]) == [len(t[:a].encode()), len(t[:b].encode())]


def test_rank_and_select_agree():
    raw = "xé漢😀".encode() * 9
    ends = infill.Ends(np.frombuffer(raw, np.uint8), np.array([0]))
    wanted = [i + 1 for i in range(len(raw)) if i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80]
    assert ends.select(np.arange(37)).tolist() == [0, *wanted]
    assert ends.rank(np.array([0, *wanted])).tolist() == list(range(37))


def test_edges(docs):  # noqa: F811
    made = infill.transform(docs, ["doc_id", "text", "row", "key"])
    got = made.select(
        "row.doc_id",
        "row.text",
        F.struct(
            "n",
            "form",
            "prefix_chars",
            "middle_chars",
            F.sha2("output", 256),
            F.sha2(infill.restored(F.col("output"), F.col("form")), 256),
        ).alias("found"),
    ).collect()
    assert len(got) == len(ROWS)
    assert all(tuple(r["found"]) == brute.infill(r["doc_id"], r["text"]) for r in got)
    assert infill.transform(docs.limit(0), ["doc_id"]).count() == 0


def test_seams_and_markers(spark):
    """Texts of marker pieces come back whole; those with a marker stay as they are."""
    rng = random.Random(5)
    texts = ["".join(rng.choices(["<", ">", "P", "S", "M", "<P", "S>", "\\Q", "|"], k=rng.randint(0, 12))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = infill.transform(df, ["doc_id", "text"])
    rows = made.select("row.*", "form", "output", infill.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert r["back"] == r["text"]
        assert hashlib.sha256(r["output"].encode()).hexdigest() == brute.infill(r["doc_id"], r["text"])[4]


def test_own_markers(spark):
    df = spark.createDataFrame([(i, "a. b" * i) for i in range(40)], "doc_id long, text string")
    marks = ("<|.*|>", "[S]", "\\E(M)")
    made = infill.transform(df, ["text"], markers=marks, transformed=100, suffix_first=50)
    back = made.select("row.text", "form", infill.restored(F.col("output"), F.col("form"), marks).alias("back")).collect()
    assert all(r["text"] == r["back"] for r in back) and {r["form"] for r in back} == {"plain", "psm", "spm"}
    with pytest.raises(ValueError):
        infill.transform(df, ["text"], markers=("<P>", "<<P>", "x"))
