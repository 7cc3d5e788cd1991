"""SimHash near-duplicates: byte-position inverted index with count filtering.

A fingerprint is 8 positional bytes. Two fingerprints that differ in at most 4 bits differ in
at most 4 bytes, so they share at least 4 positional bytes: that is the guaranteed count. The
index therefore holds each distinct fingerprint under each of its 70 choices of 4 positions,
which makes a posting list exactly the fingerprints that have reached the count together on
those positions; tallies below it are never formed. Within a list, every fingerprint still
waiting is compared with those already reached (verification by bits), and what is reached
stops waiting: a list of m near copies costs about m comparisons and yields m - 1 links, so no
group's pairs are ever written out. Equal fingerprints are merged before. A list of more than
``LONG`` members is not compared in one task: its members are dealt into blocks, and each pair of
blocks is a task of its own, so members that share the bytes but differ in more bits cost no task
more than ``LONG`` squared.

Links are joined to components by rounds of joins on (fingerprint, parent) tables.

Null and wordless texts have fingerprint zero and link like any other. Repeated rows share
their component. Null ids never become a component's id unless it holds no other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from deskloom.llm.common import map_texts, written

#: Words of a shingle, hash seed, bytes of a fingerprint, most differing bits of a link.
SHINGLE, SEED, BYTES, MOST_BITS = 4, 42, 8, 4
#: Members of a posting list that one task compares.
LONG = 1 << 14


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """Big-endian fingerprint: a bit is set if it is set in over half the shingle hashes."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return bytes(BYTES)
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_digest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_digest
    spans = zip((ends - sizes)[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    hashes = b"".join([digest(joined[a:b], seed) for a, b in spans])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 8 * BYTES)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes()


def fingerprints(docs: DataFrame, keep: Sequence[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(row struct of ``keep``, fp) where fp holds the 64 bits as a signed long."""

    def make():
        def apply(texts: list[bytes]) -> list[pa.Array]:
            raw = b"".join(fingerprint(t, shingle) for t in texts)
            return [pa.array(np.frombuffer(raw, ">i8").astype(np.int64), pa.int64())]

        return apply

    return map_texts(docs, text, keep, [T.StructField("fp", T.LongType())], make)


def _groups(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[tuple, int, np.ndarray | None]]:
    """(name, size, fingerprints) of each posting list with two or more, which may span batches;
    the columns before the last name it. Of lists above ``longest`` only the size is kept."""
    held: list[np.ndarray] = []
    last, size = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        *names, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        changed = np.zeros(len(fp) - 1, bool)
        for c in names:
            changed |= np.diff(c) != 0
        cut = np.concatenate(([0], np.flatnonzero(changed) + 1, [len(fp)]))
        many = np.diff(cut) > 1
        many[0] = many[-1] = True  # these may have company in a neighbouring batch
        for a, b in zip(cut[:-1][many], cut[1:][many]):
            name = tuple(int(c[a]) for c in names)
            if name != last:
                if size > 1:
                    yield last, size, np.concatenate(held) if size <= longest else None
                held, size = [], 0
            last, size = name, size + int(b - a)
            if size <= longest:
                held.append(fp[a:b])
            else:
                held = []
    if size > 1:
        yield last, size, np.concatenate(held) if size <= longest else None


def _links(group: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(fingerprint, least fingerprint of its component), within one posting list."""
    waiting = group
    while len(waiting) > 1:
        reached, todo = [waiting[:1]], [waiting[0]]
        waiting = waiting[1:]
        while todo and len(waiting):
            near = np.bitwise_count((waiting ^ todo.pop()).view(np.uint64)) <= most
            if near.any():
                reached.append(waiting[near])
                todo.extend(waiting[near])
                waiting = waiting[~near]
        members = np.concatenate(reached)
        least = members.min()
        yield from ((int(m), int(least)) for m in members if m != least)


def links(distinct: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(node, parent) pairs, parent < node, that connect what differs by at most ``most`` bits.

    ``distinct``: one row per fingerprint, column fp.
    """
    shared = BYTES - most
    masks = [
        int.from_bytes(bytes(255 if i in chosen else 0 for i in range(BYTES)), "big", signed=True)
        for chosen in combinations(range(BYTES), shared)
    ]
    index = distinct.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")).select(
        "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
    )
    found = written(_compared(index, ["mask", "key"], most, LONG), "list-links")
    near = found.filter("parent IS NOT NULL").select("node", "parent")
    long = found.filter("parent IS NULL").select("mask", "key", "size")
    if not long.isEmpty():
        # Every two members meet in the pair of their blocks.
        blocks = F.ceil(F.col("size") / F.lit(LONG // 2)).cast("int")
        dealt = index.join(long, ["mask", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
        other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
        met = dealt.select("mask", "key", "own", other, "fp")
        met = met.select("mask", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
        again = _compared(met, ["mask", "key", "a", "b"], most, 1 << 62)
        near = near.unionByName(again.select("node", "parent"))
    return near.distinct()


def _compared(lists: DataFrame, names: Sequence[str], most: int, longest: int) -> DataFrame:
    """(node, parent) links of the lists (``names``, fp), and (mask, key, size) of those above ``longest``."""
    ordered = lists.select(*names, "fp").repartition(*names).sortWithinPartitions(*names)

    def run(batches):
        nodes, parents, long = [], [], []
        for name, size, group in _groups(batches, longest):
            if group is None:
                long.append((*name[:2], size))
                continue
            for node, parent in _links(group, most):
                nodes.append(node)
                parents.append(parent)
            if len(nodes) > 50_000:
                yield _pairs(nodes, parents, [])
                nodes, parents = [], []
        yield _pairs(nodes, parents, long)

    return ordered.mapInArrow(run, "node long, parent long, mask long, key long, size long")


def _pairs(nodes: list[int], parents: list[int], long: list[tuple]) -> pa.RecordBatch:
    none, gap = [None] * len(nodes), [None] * len(long)
    columns = [nodes + gap, parents + gap, *(none + [x[i] for x in long] for i in range(3))]
    names = ["node", "parent", "mask", "key", "size"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the links reaches; roots have no row.

    Each round keeps every node's least parent, hangs its other parents below that one, and
    skips over the parent where that has a parent itself. A written table ends each round.
    """
    edges = written(edges.select("node", "parent"), "links", narrow=True)
    while True:
        best = written(edges.groupBy("node").agg(F.min("parent").alias("up")), "parents", narrow=True)
        above = best.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hops = best.join(above, "up", "left").select(
            "node", F.coalesce("top", "up").alias("parent"), F.col("top").isNotNull().alias("moved")
        )
        others = (
            edges.join(best, "node")
            .filter(F.col("parent") != F.col("up"))
            .select(
                F.greatest("parent", "up").alias("node"), F.least("parent", "up").alias("parent"), F.lit(True).alias("moved")
            )
        )
        following = written(hops.unionByName(others), "links", narrow=True)
        if following.filter("moved").isEmpty():
            return best.withColumnRenamed("up", "root")
        edges = following.groupBy("node", "parent").agg(F.max("moved").alias("moved")).select("node", "parent")


def fingerprint_components(marked: DataFrame, doc_id: str, most: int = MOST_BITS) -> DataFrame:
    """(fp, root, component_id) of every fingerprint in ``marked`` (doc_id, fp), a written table."""
    distinct = written(marked.groupBy("fp").agg(F.min(F.col(f"`{doc_id}`")).alias("first")), "fingerprints")
    roots = components(links(distinct.select("fp"), most)).select(F.col("node").alias("fp"), "root")
    rooted = written(
        distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted"
    )
    least = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    return written(rooted.join(least, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = MOST_BITS) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    marked = written(
        fingerprints(docs, [doc_id], text).select(F.col(f"row.`{doc_id}`").alias("doc_id"), "fp"), "marked"
    )
    return marked.join(fingerprint_components(marked, "doc_id", most), "fp").drop("root")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = MOST_BITS) -> DataFrame:
    """``docs`` with one row of each component: the one with the least id (null last; of
    several rows with that id the one with the least content hash). Columns unchanged."""
    number, body = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    name = F.concat_ws(":", F.coalesce(number.cast("string"), F.lit("null")), F.hex(F.xxhash64(body)))
    ident = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        body.alias("text"),
        number.alias("id"),
        name.alias("key"),
    )
    marked = written(fingerprints(ident, ["id", "key"], "text").select("row.id", "row.key", "fp"), "marked")
    choice = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    chosen = written(
        marked.join(fingerprint_components(marked, "id", most), "fp")
        .groupBy("root")
        .agg(F.min(choice).alias("best"))
        .select("best.key"),
        "chosen",
    )
    repeated = W.partitionBy("key").orderBy("key")
    return (
        ident.select("doc", "key")
        .join(chosen, "key", "left_semi")
        .withColumn("nth", F.row_number().over(repeated))
        .filter("nth = 1")
        .select("doc.*")
    )
