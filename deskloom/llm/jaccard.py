"""N-gram Jaccard join with several global token orders.

A text's set holds the 64-bit hashes of its distinct word shingles. Texts with equal sets are one
class, and only classes are compared. A set of n that reaches the threshold with another shares
at least ``ceil(t n)`` tokens with it, so under any order of all tokens each one's first
``n - ceil(t n) + 1`` tokens (its prefix) hold a common one. Here a pair has to share a prefix
token under each of three orders:

- by document frequency, rarest first, for the tokens that are counted (one in ``COUNTED``, by
  hash), then the others by hash, and the tokens of one in ``HEAVY`` classes last;
- twice by a hash of the token, but unique counted tokens first and the heavy ones last.

Tokens that no other class holds lie at the front of each order and can't be shared; a class
whose prefix holds no other token has no partner and is left behind before any list is built.
That is so for most texts, so one count of a quarter of the tokens takes the place of an index
of all. Lists of the first order give pairs whose sizes fit and whose bitmaps (parities of the
tokens by 512 slots, a bound on the difference) don't exclude them; they go on if their prefixes
overlap in the second and in the third order, and what remains is verified on the whole sets.

Of lists with the same members one is kept, and a class meets the others of its largest list before
those of the rest, where most are in its component by then. Lists of many near copies: a member is
compared with the first one before it that size and bitmap allow, links are joined to components, and
then in all lists with the first eight of other components. A list where all that are allowed were
compared is done, as lists of a common passage are at once; of the others, those that still lie in
several components go on with eight times as many. So no link between components is lost, and pairs
inside a group are never written out.

Bounds: the heavy tokens are at most ``HEAVY`` times the mean set size, as each is in one of
``HEAVY`` classes; they are broadcast. The texts of the classes left are found again by one of
``SLOTS`` hash slots of their ids (broadcast: at most ``SLOTS`` numbers). A worker holds a batch of
texts, the counted tokens of one bucket, of which there are several for each scan partition, or the
numbers and bitmaps (88 bytes) of the members of one list.

Equal hashes count as equal shingles. Null and wordless texts have an empty set and link with
nothing. Repeated rows share their component; null ids never become a component's id unless it
holds no other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskloom.llm.common import written
from deskloom.llm.simhash import components

#: Words of a shingle, least percent of the union that is common, hash seed.
SHINGLE, PERCENT, SEED = 4, 85, 42
#: One token in so many is counted; a token of one in so many classes is heavy; slots of ids.
COUNTED, HEAVY, SLOTS = 4, 100, 1 << 20
#: Earlier members that each of a list is compared with in the first round, and their growth by round.
#: With one, m near copies make m - 1 pairs a list; more would make pairs inside groups still unlinked.
FIRST, GROWTH = 1, 8
#: Lists up to this long are compared all at once; members that one is compared with at a time.
_SHORT, _CHUNK = 16, 1 << 14
_LONG = np.int64(1) << 62
_SPREADS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    if n <= shingle:
        return np.frombuffer(digest(joined, SEED), ">u8").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    spans = zip((ends - sizes)[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return np.unique(np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), ">u8").astype(np.uint64))


def class_of(tokens: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def prefix_size(n, percent: int = PERCENT):
    return n - (percent * n + 99) // 100 + 1


def _counted(tokens: np.ndarray) -> np.ndarray:
    return tokens % np.uint64(COUNTED) == 0


def _codes(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 32 more bits) of counted tokens."""
    low = (tokens >> np.uint64(2)) & np.uint64(0xFFFFFFFF)
    return ((tokens >> np.uint64(34)) % np.uint64(buckets)).astype(np.int64), low.astype(np.uint32)


def _blobs(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, bytes of each column) for every bucket."""
    order = np.argsort(bucket, kind="stable")
    held = bucket[order]
    cut = np.concatenate(([0], np.flatnonzero(np.diff(held)) + 1, [len(held)]))
    sorted_ = [c[order] for c in columns]
    for a, b in zip(cut[:-1], cut[1:]):
        if b > a:
            yield (int(held[a]), *(c[a:b].tobytes() for c in sorted_))


#: Rows of the scan: texts, counted tokens by bucket, tokens that are frequent in their batch.
_TEXT, _TOKENS, _FREQUENT = range(3)


def _scan(docs: DataFrame, text: str, doc_id: str, shingle: int, buckets: int) -> DataFrame:
    """(kind, id, node, n, held, bucket, tokens, nodes), a written table."""
    source = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    id_type = source.schema["id"].dataType
    types = {"kind": pa.int32(), "id": pa.null(), **dict.fromkeys(("node", "n", "held", "bucket"), pa.int64())}
    types |= {"tokens": pa.binary(), "nodes": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies inside a task are counted once
        for batch in batches:
            sets = [shingle_set(t or b"", shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            names = [class_of(s) if len(s) else None for s in sets]
            held = [s[_counted(s)] for s in sets]
            new = []
            for i, name in enumerate(names):
                if name is not None and name not in seen:
                    seen.add(name)
                    new.append(i)
            types["id"] = batch.column(0).type
            yield _rows(
                batch.num_rows,
                kind=pa.array([_TEXT] * batch.num_rows, pa.int32()),
                id=batch.column(0),
                node=pa.array(names, pa.int64()),
                n=pa.array([len(s) for s in sets], pa.int64()),
                held=pa.array([len(h) for h in held], pa.int64()),
            )
            if not new:
                continue
            tokens = np.concatenate([held[i] for i in new])
            nodes = np.repeat(np.array([names[i] for i in new], np.int64), [len(held[i]) for i in new])
            bucket, low = _codes(tokens, buckets)
            yield _blob_rows(_TOKENS, list(_blobs(bucket, low, nodes)))
            code, times = np.unique((bucket << 32) | low.astype(np.int64), return_counts=True)
            often = times >= max(2, len(new) // HEAVY)
            if often.any():
                yield _blob_rows(_FREQUENT, list(_blobs(code[often] >> 32, code[often], times[often].astype(np.int64))))

    def _rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
        arrays = [columns[name] if name in columns else pa.nulls(size, kind) for name, kind in types.items()]
        return pa.RecordBatch.from_arrays(arrays, names=list(types))

    def _blob_rows(kind: int, rows: list[tuple]) -> pa.RecordBatch:
        bucket, tokens, nodes = zip(*rows) if rows else ((), (), ())
        return _rows(
            len(rows),
            kind=pa.array([kind] * len(rows), pa.int32()),
            bucket=pa.array(bucket, pa.int64()),
            tokens=pa.array(tokens, pa.binary()),
            nodes=pa.array(nodes, pa.binary()),
        )

    long = T.LongType()
    fields = [
        T.StructField("kind", T.IntegerType()),
        T.StructField("id", id_type),
        *[T.StructField(name, long) for name in ("node", "n", "held", "bucket")],
        T.StructField("tokens", T.BinaryType()),
        T.StructField("nodes", T.BinaryType()),
    ]
    return written(source.mapInArrow(run, T.StructType(fields)), "shingles")


def _heavy(scanned: DataFrame) -> np.ndarray:
    """Codes of the counted tokens that are in at least one of ``HEAVY`` texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                columns = [pa.array(np.frombuffer(x, np.int64)) for x in (codes, times)]
                yield pa.RecordBatch.from_arrays(columns, names=["code", "n"])

    rows = scanned.filter(F.col("kind") == _TEXT).filter("n > 0").count()
    found = scanned.filter(F.col("kind") == _FREQUENT).select("tokens", "nodes").mapInArrow(run, "code long, n long")
    heavy = found.groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(HEAVY, rows / HEAVY))
    return np.sort(np.array([r["code"] for r in heavy.select("code").collect()], np.int64))


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _company(scanned: DataFrame, heavy: np.ndarray, buckets: int) -> DataFrame:
    """(node, code, df): the counted tokens of every class that others hold too; a row with a null
    code has the number of its heavy tokens instead."""
    shared = scanned.sparkSession.sparkContext.broadcast(heavy)
    schema = "bucket long, heavy boolean, tokens binary, nodes binary"

    def lighten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        for batch in batches:
            rows, gone = [], []
            for bucket, t, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                tokens, nodes = np.frombuffer(t, np.uint32), np.frombuffer(n, np.int64)
                drop = _among((bucket << 32) | tokens.astype(np.int64), codes)
                gone.append(nodes[drop])
                if not drop.all():
                    rows.append((bucket, False, tokens[~drop].tobytes(), nodes[~drop].tobytes()))
            nodes, times = np.unique(np.concatenate(gone), return_counts=True) if gone else ([], [])
            if len(nodes):
                rows += [(b, True, t, n) for b, t, n in _blobs(nodes % buckets, times.astype(np.uint32), nodes)]
            if rows:
                types = (pa.int64(), pa.bool_(), pa.binary(), pa.binary())
                arrays = [pa.array(c, kind) for c, kind in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "heavy", "tokens", "nodes"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tokens, nodes = None, [], []
        for batch in batches:
            for bucket, heavy_, t, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if heavy_:
                    number = np.frombuffer(n, np.int64)
                    none = pa.nulls(len(number), pa.int64())
                    yield _known(number, none, np.frombuffer(t, np.uint32))
                    continue
                if bucket != last:
                    yield from _shared(last, tokens, nodes)
                    last, tokens, nodes = bucket, [], []
                tokens.append(np.frombuffer(t, np.uint32))
                nodes.append(np.frombuffer(n, np.int64))
        yield from _shared(last, tokens, nodes)

    blobs = scanned.filter(F.col("kind") == _TOKENS).select("bucket", "tokens", "nodes").mapInArrow(lighten, schema)
    ordered = blobs.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(count, "node long, code long, df long")


def _known(nodes, codes: pa.Array, df) -> pa.RecordBatch:
    arrays = [pa.array(nodes, pa.int64()), codes, pa.array(np.asarray(df).astype(np.int64))]
    return pa.RecordBatch.from_arrays(arrays, names=["node", "code", "df"])


def _shared(bucket: int | None, tokens: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The tokens of a bucket that two or more classes hold, for each of these."""
    if not tokens:
        return
    token, node = np.concatenate(tokens), np.concatenate(nodes)
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    first = np.concatenate(([True], (np.diff(token) != 0) | (np.diff(node) != 0)))
    token, node = token[first], node[first]
    cut = np.concatenate(([0], np.flatnonzero(np.diff(token)) + 1, [len(token)]))
    size = np.diff(cut)
    df = np.repeat(size, size)
    many = df > 1
    codes = (np.int64(bucket) << 32) | token[many].astype(np.int64)
    if many.any():
        yield _known(node[many], pa.array(codes, pa.int64()), df[many])


def _bitmap(tokens: np.ndarray) -> bytes:
    slots = np.bincount((tokens >> np.uint64(55)).astype(np.int64), minlength=512)
    return np.packbits(slots & 1).tobytes()


def orders(tokens: np.ndarray, codes: np.ndarray, df: np.ndarray, heavy: np.ndarray, buckets: int, percent: int) -> list[np.ndarray]:
    """The prefix of a set under each order, without the tokens that no other class holds."""
    p = prefix_size(len(tokens), percent)
    weight = np.full(len(tokens), _LONG >> 8, np.int64)  # not counted
    counted = _counted(tokens)
    bucket, low = _codes(tokens[counted], buckets)
    own = (bucket << 32) | low.astype(np.int64)
    at = np.argsort(codes)
    known = np.ones(len(own), np.int64)
    if len(codes):
        found = _among(own, codes[at])
        known[found] = df[at][np.searchsorted(codes[at], own[found])]
    known[_among(own, heavy)] = _LONG
    weight[counted] = known
    unique = weight == 1
    rough = np.where(unique, 0, np.where(weight == _LONG, 2, 1))
    out = []
    for key, tie in [(weight, tokens), *((rough, tokens * s) for s in _SPREADS)]:
        first = np.lexsort((tie, key))[:p]
        out.append(tokens[first[~unique[first]]])
    return out


def _ordered(left: DataFrame, heavy: np.ndarray, buckets: int, percent: int) -> DataFrame:
    """``left`` (node, known, tokens) with the prefixes and the bitmap."""
    shared = left.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for codes, df, tokens in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                held = np.array(tokens, np.int64).view(np.uint64)
                known = np.array(codes or [], np.int64), np.array(df or [], np.int64)
                prefixes = orders(held, *known, shared.value, buckets, percent)
                rows.append((*(x.view(np.int64) for x in prefixes), _bitmap(held)))
            if rows:
                a, b, c, bits = zip(*rows)
                longs = pa.list_(pa.int64())
                arrays = [
                    batch.column(0),
                    pa.array([len(t) for t in batch.column(3).to_pylist()], pa.int64()),
                    *(pa.array(x, longs) for x in (a, b, c)),
                    batch.column(3).cast(longs),
                    pa.array(bits, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "n", "first", "second", "third", "tokens", "bits"])

    schema = "node long, n long, first array<long>, second array<long>, third array<long>, tokens array<long>, bits binary"
    known = F.col("known")
    return left.select("node", known["code"].alias("codes"), known["df"].alias("df"), "tokens").mapInArrow(run, schema)


def near(n, bits, component, n0, bits0, component0, percent: int):
    """Whether the sizes and bitmaps of members allow the threshold with members of other components
    that are not larger; either side may be one member."""
    total = n + n0
    apart = total - 2 * ((percent * total + 99 + percent) // (100 + percent))
    fits = (component != component0) & (percent * n <= 100 * n0)
    return fits & (np.bitwise_count(bits ^ bits0).sum(axis=-1, dtype=np.int64) <= apart)


@dataclass
class _List:
    """A list, ordered by size; each of its columns is held as the parts that were read."""

    token: int
    parts: list[tuple]  # (n, node, component, bits)

    def pairs(self, begin: int, end: int, percent: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], bool]:
        """Pairs as in ``compared``, and whether a member has more."""
        n, node, component, bits = (np.concatenate(column) for column in zip(*self.parts))
        low = np.searchsorted(n, -(-percent * n // 100))
        found, more = [], False
        for i in range(1, len(n)):
            close: list[int] = []
            for a in range(int(low[i]), i, _CHUNK):
                b = min(i, a + _CHUNK)
                ok = near(n[i], bits[i], component[i], n[a:b], bits[a:b], component[a:b], percent)
                close += (a + np.flatnonzero(ok)).tolist()
                if len(close) > end:
                    more = True
                    break
            if own := close[begin:end]:
                found.append((node[own], np.full(len(own), node[i])))
        return found, more


def compared(lists: DataFrame, begin: int, end: int, percent: int) -> DataFrame:
    """(x, y): every member of a list and, of the earlier members of other components that are near
    it, those from the ``begin``-th up to the ``end``-th. A list with a member that has more gives its
    token as x, with a null y. ``lists``: (token, n, node, component, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: _List | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            token, n, node, component = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            bits = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(-1, 8)
            cut = np.concatenate(([0], np.flatnonzero(np.diff(token)) + 1, [len(token)]))
            size = np.diff(cut)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            short = (size > 1) & (size <= _SHORT)
            short[[0, -1]] = False  # may go on in a neighbouring batch
            length = np.repeat(np.where(short, size, 0), size)
            place = np.arange(len(token)) - np.repeat(cut[:-1], size)
            times = np.zeros(len(token), np.int64)
            for step in range(int(length.max(initial=0)) - 1, 0, -1):  # the earliest first
                a = np.flatnonzero(place + step < length)
                b = a + step
                ok = near(n[b], bits[b], component[b], n[a], bits[a], component[a], percent)
                use = ok & (times[b] >= begin) & (times[b] < end)
                times[b[ok]] += 1
                found.append((node[a[use]], node[b[use]]))
            more = np.unique(token[times > end]).tolist()
            long = (size > _SHORT) & ~short
            long[[0, -1]] = True
            for a, b in zip(cut[:-1][long].tolist(), cut[1:][long].tolist()):
                if here is None or here.token != token[a]:
                    if here is not None:
                        yield _pairs(*here.pairs(begin, end, percent), here.token)
                    here = _List(int(token[a]), [])
                here.parts.append((n[a:b], node[a:b], component[a:b], bits[a:b]))
            yield _pairs(found, False, 0, more)
        if here is not None:
            yield _pairs(*here.pairs(begin, end, percent), here.token)

    def _pairs(found: list[tuple], more: bool, token: int, tokens: Sequence[int] = ()) -> pa.RecordBatch:
        x, y = (np.concatenate(side) for side in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        marks = [*tokens, *([token] if more else [])]
        left = np.concatenate((pairs[:, 0], np.array(marks, np.int64)))
        right = pa.concat_arrays([pa.array(pairs[:, 1], pa.int64()), pa.nulls(len(marks), pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), right], names=["x", "y"])

    ordered = lists.select("token", "n", "node", "component", "bits").repartition("token")
    return ordered.sortWithinPartitions("token", "n", "node").mapInArrow(run, "x long, y long").distinct()


def candidates(lists: DataFrame, begin: int, end: int, percent: int) -> DataFrame:
    """The pairs (x, y) of ``compared``."""
    return compared(lists, begin, end, percent).filter("y IS NOT NULL")


def verified(pairs: DataFrame, left: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that share prefix tokens under the other orders and reach the threshold."""

    def side(name: str) -> DataFrame:
        columns = [F.col(c).alias(f"{name}_{c}") for c in ("n", "second", "third", "tokens")]
        return left.select(F.col("node").alias(name), *columns)

    joined = pairs.join(side("x"), "x").join(side("y"), "y")
    overlap = F.arrays_overlap("x_second", "y_second") & F.arrays_overlap("x_third", "y_third")
    common = F.size(F.array_intersect("x_tokens", "y_tokens")).cast("long")
    enough = 100 * common >= percent * (F.col("x_n") + F.col("y_n") - common)
    return joined.filter(overlap).filter(enough).select("x", "y")


def distinct_lists(lists: DataFrame) -> DataFrame:
    """``lists`` (token, node, ...) without those of one member, and one of those with the same
    members: near copies share dozens of tokens, each of which would give the same pairs. Lists are
    told apart by their size and 128 bits of hash of the members."""
    members = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"h{i}") for i in (0, 1)]
    size = F.count(F.lit(1)).alias("size")
    marked = lists.groupBy("token").agg(size, *members).filter("size > 1")
    kept = marked.groupBy("size", "h0", "h1").agg(F.min("token").alias("token"))
    return lists.join(kept.select("token"), "token", "left_semi")


def largest_lists(lists: DataFrame) -> DataFrame:
    """The entry of every node in the largest of its lists: no pair is in two of these lists."""
    size = lists.groupBy("token").agg(F.count(F.lit(1)).alias("size"))
    sized = lists.select("token", "node").join(size, "token")
    own = sized.groupBy("node").agg(F.max(F.struct("size", "token"))["token"].alias("token"))
    return lists.join(own, ["node", "token"], "left_semi")


def _apart(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """``lists`` whose members lie in two components or more, as of ``roots``."""
    placed = lists.drop("component").join(roots, "node", "left").withColumn("component", F.coalesce("root", "node"))
    todo = placed.groupBy("token").agg((F.min("component") != F.max("component")).alias("apart")).filter("apart")
    return written(placed.drop("root").join(todo.select("token"), "token", "left_semi"), "lists")


def _links(left: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the classes that have links.

    Near copies share dozens of lists, and each would give the same pairs. So a node first meets the
    others of one list only, and then those that are still in other components in all its lists.
    """

    def links_of(pairs: DataFrame) -> DataFrame:
        more = verified(pairs, left, percent).select(F.col("y").alias("node"), F.col("x").alias("parent"))
        return written(more, "jaccard-links", narrow=True)

    own = F.col("node").alias("component")
    every = left.select("node", "n", own, "bits", F.explode("first").alias("token"))
    lists = written(distinct_lists(every), "lists")
    met = candidates(written(largest_lists(lists), "lists"), 0, FIRST, percent)
    roots = components(links_of(written(met, "pairs", narrow=True)))
    most = FIRST
    while True:
        most *= GROWTH
        lists = _apart(lists, roots)
        pairs = written(compared(lists, 0, most, percent), "pairs", narrow=True)
        more = links_of(pairs.filter("y IS NOT NULL"))
        if not more.isEmpty():
            roots = components(roots.withColumnRenamed("root", "parent").unionByName(more))
        cut = pairs.filter("y IS NULL").select(F.col("x").alias("token"))
        if cut.isEmpty():
            return roots
        lists = lists.join(cut, "token", "left_semi")


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    buckets: int | None = None,
) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row of ``docs``: size and name of its
    set (null: empty), least id that is reached by links of at least ``percent`` percent."""
    if buckets is None:
        buckets = 4 * max(docs.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism)
    scanned = _scan(docs, text, doc_id, shingle, buckets)
    heavy = _heavy(scanned)
    company = _company(scanned, heavy, buckets).groupBy("node").agg(
        F.collect_list(F.when(F.col("code").isNotNull(), F.struct("code", "df"))).alias("known"),
        F.sum(F.when(F.col("code").isNull(), F.col("df"))).alias("heavy"),
    )
    texts = scanned.filter(F.col("kind") == _TEXT).select("id", "node", "n", "held")
    classes = written(
        texts.filter("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("held").alias("held")),
        "set-classes",
        narrow=True,
    )
    unique = F.col("held") - F.coalesce(F.size("known"), F.lit(0)) - F.coalesce("heavy", F.lit(0))
    prefix = F.expr(f"n - (({percent} * n + 99) div 100) + 1")
    open_ = written(classes.join(company, "node", "left").filter(unique < prefix).select("node", "id", "known"), "open-classes")
    found = _sets_of(docs, open_, text, doc_id, shingle).join(open_.drop("id"), "node").dropDuplicates(["node"])
    left = written(_ordered(found, heavy, buckets, percent), "prefixes")
    roots = _links(left, percent)
    rooted = classes.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    placed = written(rooted.join(least, "root").select("node", "component_id"), "components", narrow=True)
    linked = texts.filter("n > 0").join(placed, "node")
    empty = texts.filter("n = 0").withColumn("component_id", F.col("id"))
    both = linked.select(texts.columns + ["component_id"]).unionByName(empty)
    return both.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("node").alias("class_id"), "component_id")


def _slot(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SLOTS))


def _sets_of(docs: DataFrame, classes: DataFrame, text: str, doc_id: str, shingle: int) -> DataFrame:
    """(node, tokens) of the texts whose ids fall into the slots of ``classes``."""
    slots = classes.select(_slot(F.col("id")).alias("slot")).distinct()  # at most SLOTS rows
    number = F.col(f"`{doc_id}`")
    source = docs.select(_slot(number).alias("slot"), F.col(f"`{text}`").cast("string").alias("text"))
    source = source.join(F.broadcast(slots), "slot", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            names, sets = [], []
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                tokens = shingle_set(t or b"", shingle)
                name = class_of(tokens)
                if len(tokens) and name not in seen:
                    seen.add(name)
                    names.append(name)
                    sets.append(tokens.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "tokens"]
            )

    return source.mapInArrow(run, "node long, tokens array<long>")
