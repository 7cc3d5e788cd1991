"""The opN queries over whole small tables, against plain re-computations."""

import duckdb
import pytest

import __spark_entry__ as entry
from llm import brute

SF = "/root/testdata/sf0.01"
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def rows():
    con = duckdb.connect()

    def read(name: str, *columns: str):
        return con.execute(f"SELECT {', '.join(columns)} FROM '{SF}/{name}.parquet'").fetchall()

    return read


def result(spark, name: str, key: str, *columns: str) -> dict:
    found = QUERIES[name](spark, SF).select(key, *columns).collect()
    out = {r[0]: tuple(r[1:]) for r in found}
    assert len(out) == len(found)
    return out


def test_op1(spark, rows):
    got = result(spark, "op1_warc", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == brute.archive(rows("pages", "page_id", "html"))


def test_op2(spark, rows):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = result(spark, "op2_quality", "doc_id", *columns)
    assert {k: v[:6] for k, v in got.items()} == {
        d: brute.base_counts(t) for d, t in rows("documents", "doc_id", "text")
    }
    assert not any(v[5] and v[6] for v in got.values())


def test_op6(spark, rows):
    got = result(spark, "op6_url_filter", "page_id", "host", "path", "rule", "verdict")
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    for page, url in rows("pages", "page_id", "url"):
        best = brute.url_rule(url, rules)
        assert got[page] == (*brute.url_parts(url), best and best[0], best[1] if best else "allow")


def test_op7(spark, rows):
    from deskloom.llm.queries import END_ID, vocabulary

    got = result(spark, "op7_tokens", "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == brute.token_rows(rows("documents", "doc_id", "text"), vocabulary(), END_ID)


def test_op9(spark, rows):
    got = result(spark, "op9_simhash", "doc_id", "fingerprint", "component_id")
    prints = {d: brute.simhash(t) for d, t in rows("documents", "doc_id", "text")}
    assert {d: v[0] for d, v in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {d: v[1] for d, v in got.items()} == brute.linked(prints)


def test_op10(spark, rows):
    got = result(spark, "op10_decontaminate", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.benchmark_hits(rows("documents", "doc_id", "text"), rows("benchmark", "item_id", "text"))


def test_op3(spark, rows):
    got = result(spark, "op3_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring_dedup(rows("documents", "doc_id", "text"))
