"""URL filters: a trie over reversed host labels, then path segments, broadcast to all tasks.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's.
The rule with the longest host wins, among those the one with the longest path; an exact tie
between allow and block goes to block. Rules are bounded: a list above ``MOST_RULE_BYTES`` is
refused, as it could not be broadcast.

Urls without ``://`` and null urls have an empty host and path and fit no rule.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_RULE_BYTES = 64 << 20

#: (action, host, path)
Rule = tuple[str, str, str]


def parse_rule(action: str, entry: str) -> Rule:
    """``net/`` or ``example.net/en/`` as (action, host, path)."""
    host, slash, path = entry.partition("/")
    return action, host.lower(), slash + path


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nodes are dicts. Under a host node, None leads to the trie over path segments; its
    ``ends`` hold the last segments of rules, which match as prefixes of a url's segment."""
    root: dict = {}
    total = 0
    for action, host, path in rules:
        total += len(host) + len(path)
        if total > MOST_RULE_BYTES:
            raise ValueError(f"rules exceed {MOST_RULE_BYTES} bytes and can't be broadcast")
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(None, {"next": {}, "ends": {}})
        *whole, last = path.split("/")
        for segment in whole:
            node = node["next"].setdefault(segment, {"next": {}, "ends": {}})
        held = node["ends"].get(last)
        if held is None or action == "block":
            node["ends"][last] = (host + path, action)
    return root


def _path_match(node: dict, path: str) -> tuple[str, str] | None:
    best = None
    for segment in path.split("/"):
        ends = node["ends"]
        for size in sorted({len(e) for e in ends if len(e) <= len(segment)}, reverse=True):
            if segment[:size] in ends:
                best = ends[segment[:size]]
                break
        node = node["next"].get(segment)
        if node is None:
            break
    return best


def match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, action) of the longest fitting rule."""
    best, node = None, trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        if None in node:
            best = _path_match(node[None], path) or best
    return best


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    lower = "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(rest, lower.upper(), lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: Iterable[Rule], keep: list[str], url: str = "url", otherwise: str = "allow") -> DataFrame:
    """(row struct of ``keep``, host, path, rule, verdict) of every row; rule is null and the
    verdict ``otherwise`` where no rule fits."""
    shared = pages.sparkSession.sparkContext.broadcast(build_trie(rules))
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        host_of(F.col(f"`{url}`").cast("string")).alias("host"),
        path_of(F.col(f"`{url}`").cast("string")).alias("path"),
    )

    def run(batches):
        trie = shared.value
        for batch in batches:
            found = [match(trie, h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            rule = pa.array([f and f[0] for f in found], pa.string())
            verdict = pa.array([f[1] if f else otherwise for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[*batch.schema.names, "rule", "verdict"])

    added = [T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added]))
