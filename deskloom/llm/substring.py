"""Substring deduplication on a compacted de Bruijn graph of token k-mers.

A window of ``WIDTH`` words is an edge of the graph. Consecutive edges of a document whose
least ``GRAM``-word seed is the same occurrence form a path, at most ``WIDTH - GRAM + 1`` edges
long; equal windows always choose the same seed, so equal edges can only lie in paths of one
seed. Paths, about one per 14 words, are what Spark shuffles, never single words.

1. Each text becomes its paths: (seed, body hash, source coordinates).
2. Seeds that occur twice are kept by a join. If all paths of a seed are equal, the path is
   repeated and nonbranching: it stays compact and all its edges are repeated.
3. Where paths of a seed differ, one source of each distinct path is looked up by its
   coordinates and opened into edges, which are counted with the path's multiplicity; a bit
   mask then says which edges of the path are repeated.
4. Masks return to all sources of a path, and each affected text drops the words under its
   repeated edges.

Edges and paths are compared by two independent 64-bit hashes (seed and content).

Null texts have no words. Repeated rows are copies of each other like any others. Texts of
fewer than ``WIDTH`` words keep all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskloom.llm.common import lists, map_texts, written

#: Words of a window and of a seed.
WIDTH, GRAM = 35, 8

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

PATH = T.StructType(
    [
        T.StructField("seed", T.LongType()),
        T.StructField("body", T.LongType()),
        T.StructField("at", T.IntegerType()),
        T.StructField("n", T.IntegerType()),
    ]
)


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, remembered."""
    held = _powers.get(name)
    if held is None or len(held) < n:
        size = max(n, 1 << 14)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        held = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return held[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any word range of a text, from prefix sums."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        digest = xxhash.xxh64_digest
        each = np.frombuffer(b"".join([digest(w) for w in words]), np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(each * _power("inverse", _INVERSE, n), dtype=np.uint64, out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        scale = _power("base", _BASE, len(self.sums))
        return _mixed((self.sums[end] - self.sums[begin]) * scale[end - 1])


def paths(words: list[bytes], width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(seed, body, at, n): runs of n windows from word ``at`` that share a seed occurrence."""
    windows = len(words) - width + 1
    if windows < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    hashes = Hashes(words)
    places = np.arange(len(words) - gram + 1)
    seeds = hashes.of(places, places + gram)
    least = np.lib.stride_tricks.sliding_window_view(seeds, width - gram + 1).argmin(axis=1)
    owner = least + np.arange(windows)
    at = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
    n = np.diff(np.append(at, windows))
    body = hashes.of(at, at + n + width - 1) ^ n.astype(np.uint64)
    return seeds[owner[at]].view(np.int64), body.view(np.int64), at.astype(np.int32), n.astype(np.int32)


def _read_paths(width: int, gram: int):
    def make():
        def apply(texts: list[bytes]) -> list[pa.Array]:
            sizes, digests, parts, offsets = [], [], [], [0]
            for text in texts:
                words = text.split()
                sizes.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                parts.append(paths(words, width, gram))
                offsets.append(offsets[-1] + len(parts[-1][0]))
            columns = [pa.array(np.concatenate(c)) for c in zip(*parts)] if parts else [
                pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            ]
            found = pa.StructArray.from_arrays(columns, names=PATH.names)
            return [pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), lists(offsets, found)]

        return apply

    return make


def _rows(array: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and numpy fields of a list-of-structs column."""
    offsets = array.offsets.to_numpy()
    values = array.flatten()
    return offsets - offsets[0], [f.to_numpy(zero_copy_only=False) for f in values.flatten()]


def _opened(width: int):
    """Texts with the paths to open: (seed, edge hash, body, bit, total) of every edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, (seed, body, at, n, total) = _rows(batch.column(1))
            out = []
            for i, text in enumerate(batch.column(0).cast(pa.binary()).to_pylist()):
                a, b = offsets[i], offsets[i + 1]
                if a == b:
                    continue
                hashes, runs = Hashes(text.split()), n[a:b]
                bit = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
                start = np.repeat(at[a:b], runs) + bit
                edge = hashes.of(start, start + width).view(np.int64)
                out.append((*(np.repeat(x[a:b], runs) for x in (seed, body, total)), edge, bit))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
            names = ["seed", "body", "total", "edge", "bit"]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

    return run


def _cut(width: int, masks: int):
    """Affected texts with (at, mask) pairs: what is left of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.arange(masks)
        for batch in batches:
            offsets, (at, mask) = _rows(batch.column(2))
            sizes, gone, kept = [], [], []
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                words = text.split()
                a, b = offsets[i], offsets[i + 1]
                row, bit = np.nonzero((mask[a:b, None] >> bits) & 1)
                edge = np.zeros(len(words) + 1, np.int64)
                starts = np.unique(at[a:b][row] + bit)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + width, -1)
                cover = np.cumsum(edge)[:-1] > 0
                sizes.append(len(words))
                gone.append(int(cover.sum()))
                kept.append(b" ".join([w for w, c in zip(words, cover.tolist()) if not c]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["row", "n_words", "n_removed", "kept_text"],
            )

    return run


def _to_open(hits: DataFrame) -> DataFrame:
    """(id, print, open) of every text with a repeated seed; ``open`` holds the paths of
    branching seeds whose one source to open lies in this text."""
    distinct = (
        hits.filter("branching")
        .groupBy("seed", "body")
        .agg(F.count("*").alias("total"), F.min(F.struct("id", "print", "at", "n")).alias("first"))
    )
    path = F.struct("seed", "body", F.col("first.at").alias("at"), F.col("first.n").alias("n"), "total")
    chosen = distinct.select("first.id", "first.print", path.alias("path"))
    others = hits.select("id", "print", F.lit(None).cast(chosen.schema["path"].dataType).alias("path")).distinct()
    return chosen.unionByName(others).groupBy("id", "print").agg(F.collect_list("path").alias("open"))


def _masks(affected: DataFrame, width: int) -> DataFrame:
    """(seed, body, mask) of every path of a branching seed.

    A path found twice is repeated as a whole; its edges count for other paths only. Rows
    that repeat an id and a text open their paths again, which are such paths already.
    """
    opened = written(
        affected.filter(F.size("open") > 0)
        .select("text", "open")
        .mapInArrow(_opened(width), "seed long, body long, total long, edge long, bit long"),
        "edges",
    )
    common = written(
        opened.groupBy("seed", "edge").agg(F.sum("total").alias("n")).filter("n > 1").select("seed", "edge"), "common"
    )
    bit = F.expr("shiftleft(1L, cast(bit AS int))")
    single = opened.filter("total = 1").join(common, ["seed", "edge"]).select("seed", "body", bit.alias("bits"))
    twice = opened.filter("total > 1").select("seed", "body", bit.alias("bits"))
    return single.unionByName(twice).groupBy("seed", "body").agg(F.bit_or("bits").alias("mask"))


def deduplicated(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, gram: int = GRAM
) -> tuple[DataFrame, DataFrame]:
    """Two tables that together have every row once: untouched (doc_id, n_words, digest of the
    words joined by spaces) and affected (doc_id, n_words, n_removed, kept_text)."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    number = F.col(f"`{doc_id}`").cast("long")
    source = docs.select(
        number.alias("doc_id"),
        F.coalesce(number, F.xxhash64(body)).alias("id"),
        F.hash(body).alias("print"),
        body.alias("text"),
    )
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("digest", T.StringType()),
        T.StructField("paths", T.ArrayType(PATH)),
    ]
    read = written(
        map_texts(source, "text", ["doc_id", "id", "print"], fields, _read_paths(width, gram)).select(
            "row.*", "n_words", "digest", "paths"
        ),
        "paths",
    )
    places = read.select("id", "print", F.explode("paths").alias("p")).select("id", "print", "p.*")
    seeds = written(
        places.groupBy("seed")
        .agg(F.count("*").alias("n"), F.min("body").alias("low"), F.max("body").alias("high"))
        .filter("n > 1")
        .select("seed", (F.col("low") != F.col("high")).alias("branching")),
        "seeds",
    )
    hits = written(places.join(seeds, "seed"), "hits")
    affected = written(source.join(written(_to_open(hits), "open"), ["id", "print"]), "affected")
    masks = written(_masks(affected, width), "masks")
    whole = hits.filter("not branching").select(
        "id", "print", "at", (F.expr("shiftleft(1L, n)") - 1).alias("mask")
    )
    partly = hits.filter("branching").join(masks, ["seed", "body"]).select("id", "print", "at", "mask")
    cuts = written(
        whole.unionByName(partly).groupBy("id", "print").agg(F.collect_set(F.struct("at", "mask")).alias("cuts")), "cuts"
    )
    row = F.struct("doc_id").alias("row")
    reduced = (
        affected.select("doc_id", "id", "print", "text")
        .join(cuts, ["id", "print"])
        .select(row, "text", "cuts")
        .mapInArrow(_cut(width, width - gram + 1), "row struct<doc_id: long>, n_words long, n_removed long, kept_text string")
        .select("row.doc_id", "n_words", "n_removed", "kept_text")
    )
    rest = read.select("doc_id", "id", "print", "n_words", "digest").join(cuts.select("id", "print"), ["id", "print"], "left_anti")
    return rest.select("doc_id", "n_words", "digest"), reduced
