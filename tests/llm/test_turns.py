"""Conversation repair against every possible edit."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from deskloom.llm import turns
from llm import brute

SCHEMA = "conv_id long, turn long, role string, text string, conv string, at string, same string, kind string, block string"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_parse_matches_every_edit():
    rng = random.Random(8)
    cases = []
    for _ in range(1500):
        n = rng.randint(1, 11)
        signs = rng.choice(["sua", "suax", "ua", "x", "a", "us"])
        cases.append([(rng.choice(signs), rng.choice(turns.FAULTS if rng.random() < 0.5 else turns.FAULTS[:1])) for _ in range(n)])
    kinds = [bytes(4 * (turns.SYMBOLS + "x").index(s) + turns.FAULTS.index(f) for s, f in c) for c in cases]
    parse, flat = turns.parse_kinds(kinds)
    cost, root = parse.roots()
    leaves, at = parse.leaves(root[:, None])[:, 0], 0
    for i, case in enumerate(cases):
        edits = "".join(turns.KIND_EDITS[flat[j]][leaves[j]] for j in range(at, at + len(case))) + turns.ENDINGS[root[i]]
        at += len(case)
        wanted = brute.repaired([(s, "t") for s, _ in case], [f for _, f in case])
        assert (cost[i], turns.audit_of(edits)) == wanted[:2], case


def test_long_sequences_stay_cheap():
    """20,000 rows: a parse by halves, not by all spans."""
    rng = np.random.default_rng(2)
    flat = rng.integers(0, 16, 20_000).astype(np.uint8)
    parse, _ = turns.parse_kinds([flat.tobytes()])
    cost, root = parse.roots()
    leaves = parse.leaves(root[:, None])[:, 0]
    rows = turns.KIND_COSTS.reshape(16, 16)[flat, leaves]
    assert cost[0] == rows.sum() + turns.INSERT * len(turns.ENDINGS[root[0]])
    assert leaves[0] // 4 == 0 and (leaves[1:] // 4 == leaves[:-1] % 4).all()


def rows_of(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "User", "", None, "user"]
    texts = ["Hi.", "Yes?", "cut", "", " \t\n", None, "So: a.\nb!", "end. \n", " ", "ü漢.", "no\0"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.choice([1, 2, 3, 6, 14])):
            place = None if rng.random() < 0.1 else turn + (rng.random() < 0.2)
            role = rng.choice(roles) if rng.random() < 0.4 else ["user", "assistant"][turn % 2]
            rows.append((conv, place, role, rng.choice(texts) if rng.random() < 0.5 else f"text {turn}."))
    rows += [(70, None, "user", "a."), (70, None, None, None), (71, 3, "user", "x."), (71, 3, "user", "x.")]
    rows += [(72, i, ["user", "assistant"][i % 2], f"t{i}" + "." * (i % 7 > 0)) for i in range(300)]
    return rows


@pytest.mark.parametrize("block", [4, 1024])
def test_repair_on_edges(spark, block):
    rows = rows_of(block)
    df = spark.createDataFrame([(*r, *["own"] * 5) for r in rows], SCHEMA).repartition(5)
    made = turns.repair(df, block=block)
    got = made.conversations.join(
        turns.digests(made.turns).withColumnRenamed("conv_id", "own"), F.col("own").eqNullSafe(F.col("conv_id")), "left"
    ).collect()
    plain = [(c, t, *(" " if x is None else x for x in (r, x))) for c, t, r, x in rows]
    wanted = brute.conversations(plain, {r[0] for r in rows})
    empty = brute.hashlib.sha256(b"").hexdigest()
    found = {r["conv_id"]: (*(r[c] for c in COLUMNS[:-1]), r["sha256"] or empty) for r in got}
    assert len(got) == len(found) and found == wanted
    assert sum(r["n_rows"] for r in got) == len(rows)
    signs = {}
    for r in made.turns.orderBy("at", "nth").collect():
        signs.setdefault(r["conv_id"], []).append(r["role"][0])
        assert r["edit"] == "Keep" or r["role"] in ("user", "assistant")
        assert r["edit"] != "Insert" or r["text"] == ""
    assert all(brute.re.fullmatch("(s?(ua)+)?", "".join(s)) for s in signs.values())


def test_empty(spark):
    made = turns.repair(spark.createDataFrame([], SCHEMA))
    assert made.conversations.count() == 0 and turns.digests(made.turns).count() == 0
    with pytest.raises(ValueError):
        turns.repair(spark.createDataFrame([], SCHEMA), block=1000)


def test_query(spark, tmp_path):
    """The registered query on a table with nulls, dropped conversations and repeated rows."""
    rows = rows_of(3) + [(1000 + i, i % 3, "user", "One.") for i in range(60)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = entry.queries()["op13_turns"](spark, f"file://{tmp_path}").collect()
    found = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got}
    assert found == brute.conversations(list(brute.damage(rows)), {r[0] for r in rows})
    assert any(v[5] == 0 and v[6] == "" for v in found.values())
