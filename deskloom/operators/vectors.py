"""TF-IDF per group, lexical similarity search, dense similarity search.

The lexical index is relational. Its search takes a block of queries and one of items per task:
the greatest weight of every term bounds what an item can score, so most pairs are never looked
at, and none but each query's best leave the task; see ``lexical_matches``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from deskloom.functions.rules import STOP_WORDS
from deskloom.operators.grams import Splitter, hash_terms, hash_words, splitter, spread_bits
from deskloom.session import materialize, spread


TOKEN = r"[\p{L}\p{N}_]+"


def tokens_of(text: Column, stops: Sequence[str], token: str = TOKEN) -> Column:
    """Array of lower-cased tokens without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(token), F.lit(0))
    return F.filter(words, lambda t: ~t.isin(*stops))


def explode_terms(
    df: DataFrame,
    item: str,
    group: str,
    text: str,
    stops: Sequence[str],
    token: str = TOKEN,
) -> DataFrame:
    """(item, grp, term, tf) of every text; bigrams are formed after stop words went.

    Texts are dealt out by (item, grp), so their terms are counted where they are."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = df.select(item, group, text).repartition(tasks, item, group)
    # Not ``explode``: its filter on empty arrays would go below the exchange, and split texts there too.
    grams = _grams(dealt, item, group, text, stops, token)
    terms = grams.select("item", "grp", F.explode_outer("grams").alias("term")).filter("term is not null")
    return terms.groupBy("item", "grp", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(
    df: DataFrame, item: str, group: str, text: str, stops: Sequence[str], token: str = TOKEN
) -> DataFrame:
    """(grp, term, df): each text counts a term once, so one aggregate with partial sums does."""
    return (
        _grams(spread(df.select(item, group, text)), item, group, text, stops, token)
        .select("grp", F.explode(F.array_distinct("grams")).alias("term"))
        .groupBy("grp", "term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def _grams(
    df: DataFrame, item: str, group: str, text: str, stops: Sequence[str], token: str
) -> DataFrame:
    """(item, grp, grams): words and pairs of words of every text."""
    tokens = df.select(
        F.col(item).alias("item"), F.col(group).alias("grp"), tokens_of(F.col(text), stops, token).alias("tokens")
    )
    following = F.slice(F.col("tokens"), F.lit(2), F.greatest(F.size("tokens") - 1, F.lit(0)))
    grams = F.concat(
        F.col("tokens"),
        F.filter(
            F.zip_with("tokens", following, lambda a, b: F.concat(a, F.lit(" "), b)),
            lambda g: g.isNotNull(),
        ),
    )
    return tokens.select("item", "grp", grams.alias("grams"))


def idf_table(frequencies: DataFrame, sizes: DataFrame) -> DataFrame:
    """(grp, term, df, n, idf) with idf = ln((1+n)/(1+df)) + 1.

    ``frequencies`` is (grp, term, df), ``sizes`` is (grp, n).
    """
    return (
        frequencies.join(sizes, "grp")
        .select(
            "grp",
            "term",
            "df",
            "n",
            (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"),
        )
    )


def weigh(terms: DataFrame, idf: DataFrame) -> DataFrame:
    """(item, grp, terms): array of (term, w) with unit L2 norm, w = (1+ln tf)*idf.

    Terms the group does not know are dropped before the norm is taken. The array is one
    text's terms, so its size is bounded by that text.
    """
    raw = terms.join(idf.select("grp", "term", "idf"), ["grp", "term"]).select(
        "item", "grp", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w")
    )
    per_item = raw.groupBy("item", "grp").agg(
        F.collect_list(F.struct("term", "w")).alias("terms"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
    )
    return per_item.select(
        "item",
        "grp",
        F.transform(
            "terms", lambda t: F.struct(t["term"].alias("term"), (t["w"] / F.col("norm")).alias("w"))
        ).alias("terms"),
    )


def flat(weighted: DataFrame) -> DataFrame:
    """(item, grp, term, w) rows of weighted arrays."""
    return weighted.select("item", "grp", F.inline("terms"))


@dataclass(frozen=True)
class LexicalIndex:
    """Tables of one precedent store; ``vectors``, ``idf`` and ``groups`` are written, the others
    read these."""

    postings: DataFrame  # grp, term, item, w
    vectors: DataFrame  # item, grp, terms
    impacts: DataFrame  # grp, key (hash of the term), item, w
    bounds: DataFrame  # grp, key, df, top (greatest w)
    idf: DataFrame  # grp, term, df, n, idf
    groups: DataFrame  # grp, n, padding items


def build_index(
    df: DataFrame,
    item: str,
    group: str,
    text: str,
    k: int = 3,
    stops: Sequence[str] = STOP_WORDS,
    wanted: DataFrame | None = None,
) -> LexicalIndex:
    """TF-IDF index of a precedent table, partitioned by group.

    With ``wanted`` (grp, term), the terms that will be asked for, it lists these terms only, at
    their weights among all terms of a text: a term that no query has adds to no score.
    """
    if wanted is not None:
        return _index_for(df, item, group, text, k, stops, wanted)
    ids = df.select(F.col(item).alias("item"), F.col(group).alias("grp"))
    terms = materialize(explode_terms(df, item, group, text, stops), "index-terms")
    counted = terms.groupBy("grp", "term").agg(F.count(F.lit(1)).alias("df"))
    return index_of(ids, terms, counted, ids.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), k)


#: Characters of the texts that are counted together, and such chunks whose counts meet in one task.
CHUNK, MEET = 8_000_000, 4


def _index_for(
    df: DataFrame, item: str, group: str, text: str, k: int, stops: Sequence[str], wanted: DataFrame
) -> LexicalIndex:
    """The index of the terms in ``wanted``, which every task holds.

    Texts are dealt out in chunks. A chunk tells each of its terms once, as a hash, with the number
    of its texts that have it; it gets the numbers of all texts back in the same order, and weighs
    its texts. No other terms are written, and none move once per text."""
    ids = df.select(F.col(item).alias("item"), F.col(group).alias("grp"))
    sizes = materialize(ids.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "index-sizes")
    asked = wanted.select("grp", "term").filter("grp is not null").distinct().toArrow()
    keys = _in_group(hash_terms(asked["term"].to_pylist()), hash_words(_names(asked["grp"]).to_pylist()))
    order = np.argsort(keys)
    keys, terms = keys[order], asked["term"].take(order).combine_chunks()
    split = splitter(df.sparkSession, stops)
    chunks = (df.agg(F.sum(F.length(text))).first()[0] or 0) // CHUNK + 1
    buckets = chunks // MEET + 1
    edges = np.array([i * (1 << 64) // buckets for i in range(1, buckets)], np.uint64)
    lowered = df.select(F.col(item).alias("item"), F.col(group).alias("grp"), F.lower(text).alias("text"))
    chunk = F.pmod(F.xxhash64("item", "grp"), F.lit(chunks)).cast("int").alias("chunk")
    dealt = lowered.join(sizes, "grp").select(chunk, "item", "grp", "n", "text")

    def tell(texts: pa.Table) -> pa.Table:
        c = _count_chunk(split, texts)
        ends = [0, *np.searchsorted(c.keys, edges).tolist(), len(c.keys)]
        parts = list(zip(ends, ends[1:]))
        columns = [
            pa.array(np.full(buckets, texts["chunk"][0].as_py()), pa.int32()),
            pa.array(np.arange(buckets), pa.int32()),
            pa.array([_packed(c.keys[a:b]) for a, b in parts], pa.binary()),
            pa.array([c.df[a:b].astype("<i4").tobytes() for a, b in parts], pa.binary()),
        ]
        return pa.table(columns, ["chunk", "bucket", "keys", "df"])

    def add(told: pa.Table) -> pa.Table:
        each = [_unpacked(x) for x in told["keys"].to_pylist()]
        df = np.concatenate([np.frombuffer(x, "<i4") for x in told["df"].to_pylist()])
        of = np.unique(np.concatenate(each), return_inverse=True)[1]
        every = np.bincount(of, df).astype("<i4")[of] if len(of) else df
        parts = np.split(every, np.cumsum([len(x) for x in each])[:-1])
        return told.select(["chunk", "bucket"]).append_column("df", pa.array([x.tobytes() for x in parts], pa.binary()))

    def weigh_chunk(texts: pa.Table, added: pa.Table) -> pa.Table:
        c = _count_chunk(split, texts) if len(texts) else None
        if c is None or not len(c.keys):
            return schema_of.empty_table()
        added = added.take(pc.sort_indices(added["bucket"]))
        df = np.concatenate([np.frombuffer(x, "<i4") for x in added["df"].to_pylist()])
        n = texts["n"].to_numpy()[c.first][c.row]
        w = (1 + np.log(c.tf)) * (np.log((1 + n) / (1 + df[c.term])) + 1)
        norm = np.sqrt(np.bincount(c.row, w * w, minlength=len(c.first)))
        place = np.minimum(np.searchsorted(keys, c.keys), max(len(keys) - 1, 0))
        some = np.flatnonzero((keys[place] == c.keys)[c.term]) if len(keys) else np.zeros(0, np.int64)
        some = some[np.argsort(c.row[some], kind="stable")]
        row = c.row[some]
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        entries = pa.StructArray.from_arrays([terms.take(place[c.term[some]]), w[some] / norm[row]], ["term", "w"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(row)), pa.int32()), entries)
        at = c.first[row[begin]]
        return pa.Table.from_arrays([texts["item"].take(at), texts["grp"].take(at), lists], names=["item", "grp", "terms"])

    entry = T.StructType([T.StructField("term", T.StringType()), T.StructField("w", T.DoubleType())])
    schema = T.StructType([dealt.schema["item"], dealt.schema["grp"], T.StructField("terms", T.ArrayType(entry))])
    schema_of = to_arrow_schema(schema)
    told = dealt.groupBy("chunk").applyInArrow(tell, "chunk int, bucket int, keys binary, df binary")
    added = told.groupBy("bucket").applyInArrow(add, "chunk int, bucket int, df binary")
    weighed = dealt.groupBy("chunk").cogroup(added.groupBy("chunk")).applyInArrow(weigh_chunk, schema)
    vectors = materialize(weighed, "index-vectors")
    counted = flat(vectors).groupBy("grp", "term").agg(F.count(F.lit(1)).alias("df"))
    groups = materialize(_padded(ids, sizes, k), "index-groups")
    idf = materialize(idf_table(counted, groups.select("grp", "n")), "index-idf")
    return _over(vectors, idf, groups)


@dataclass(frozen=True)
class ChunkCounts:
    """Terms of a chunk of texts; texts that share item and group are one."""

    first: np.ndarray  # of each text: a row of it
    keys: np.ndarray  # sorted hashes of (group, term)
    df: np.ndarray  # of each key: texts that have it
    row: np.ndarray  # of each entry: the text,
    term: np.ndarray  # the place in ``keys``
    tf: np.ndarray


def _packed(ascending: np.ndarray) -> bytes:
    """Differences of sorted keys, first bytes first: these are mostly zero and compress."""
    return np.diff(ascending, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


def _in_group(terms: np.ndarray, groups: np.ndarray) -> np.ndarray:
    return spread_bits(terms ^ spread_bits(groups))


def _names(groups: pa.ChunkedArray) -> pa.ChunkedArray:
    return pc.cast(groups, pa.string())


def _count_chunk(split: Splitter, texts: pa.Table) -> ChunkCounts:
    """Counts of (item, grp, text); no group is null."""
    groups = _names(texts["grp"]).combine_chunks().dictionary_encode()
    items = texts["item"].combine_chunks().dictionary_encode(null_encoding="encode").indices
    of_group = groups.indices.to_numpy().astype(np.int64)
    _, first, row = np.unique(of_group * len(texts) + items.to_numpy(), return_index=True, return_inverse=True)
    rank = np.argsort(np.argsort(first))  # texts in the order they come
    first, row = np.sort(first), rank[row]
    said, order = texts["text"], None
    if len(first) < len(texts):
        order = np.argsort(row, kind="stable")
        said, row = said.take(order), row[order]
    salt = hash_words(groups.dictionary.to_pylist())[of_group if order is None else of_group[order]]
    pieces = [(row[p.row], _in_group(p.hash, salt[p.row])) for p in split.pieces(said)]
    of, key = (np.concatenate(x) for x in zip(*pieces))
    order = np.argsort(key, kind="stable")  # texts ascend among equal keys
    of, key = of[order], key[order]
    other = np.ones(len(key), bool)
    other[1:] = key[1:] != key[:-1]
    entry = other.copy()
    entry[1:] |= of[1:] != of[:-1]
    at = np.flatnonzero(entry)
    term = np.cumsum(other)[at] - 1
    tf = np.diff(np.append(at, len(key)))
    return ChunkCounts(first, key[other], np.bincount(term, minlength=int(other.sum())), of[at], term, tf)


def index_of(ids: DataFrame, terms: DataFrame, frequencies: DataFrame, sizes: DataFrame, k: int = 3) -> LexicalIndex:
    """Index from (item, grp), (item, grp, term, tf), (grp, term, df) and (grp, n)."""
    groups = materialize(_padded(ids, sizes, k), "index-groups")
    idf = materialize(idf_table(frequencies, groups.select("grp", "n")), "index-idf")
    return _over(materialize(weigh(terms, idf), "index-vectors"), idf, groups)


def _padded(ids: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """(grp, n, padding): the lowest ``k`` items of each group."""
    first = Window.partitionBy("grp").orderBy("item")
    padding = (
        ids.withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") <= k)
        .groupBy("grp")
        .agg(F.array_sort(F.collect_list("item")).alias("padding"))
    )
    return sizes.join(padding, "grp")


def _over(vectors: DataFrame, idf: DataFrame, groups: DataFrame) -> LexicalIndex:
    impacts = keyed(vectors)
    bounds = impacts.groupBy("grp", "key").agg(F.count(F.lit(1)).alias("df"), F.max("w").alias("top"))
    return LexicalIndex(flat(vectors), vectors, impacts, bounds, idf, groups)


def keyed(weighted: DataFrame) -> DataFrame:
    """(grp, key, item, w) rows of weighted arrays, terms as 64-bit hashes."""
    return flat(weighted).select("grp", F.xxhash64("term").alias("key"), "item", "w")


def query_vectors(
    df: DataFrame,
    item: str,
    group: str,
    text: str,
    index: LexicalIndex,
    stops: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """Query terms in the vocabulary of their group: (item, grp, terms)."""
    return weigh(explode_terms(df, item, group, text, stops), index.idf)


#: Terms of a query that give its threshold, and most items that one of them is looked up in.
SEEDS, SEED_ITEMS = 8, 256
#: Scores are rounded to four digits; what may round to the threshold counts as reaching it.
MARGIN = 1e-4
#: Weighed terms and rows that a block of queries or items holds about.
BLOCK_TERMS, BLOCK_ROWS = 4_000_000, 32_768


def lexical_matches(
    queries: DataFrame,
    index: LexicalIndex,
    item: str,
    group: str,
    text: str,
    k: int = 3,
    seeds: int = SEEDS,
    stops: Sequence[str] = STOP_WORDS,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Exact top-k items per query by cosine: (query, grp, item, score, rank).

    Every query gets k rows when its group has k items: lowest item ids pad the list with
    score 0. Ties go to the lower item id. ``vectors`` are the weighed queries, if they are
    known already (an index searched with its own items: ``index.vectors``).
    """
    if vectors is None:
        vectors = materialize(
            query_vectors(queries, item, group, text, index, stops), "query-vectors"
        )
    asked = queries.select(F.col(item).alias("query"), F.col(group).alias("grp"))
    candidates, _ = pruned_candidates(vectors, index, k, seeds)
    return _rank(candidates, asked, index, k)


def _block_counts(weighted: DataFrame, name: str) -> DataFrame:
    """(grp, ``name``): blocks that the texts of a group are cut into."""
    by_terms = F.ceil(F.sum(F.size("terms")) / F.lit(BLOCK_TERMS))
    by_rows = F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS))
    return weighted.groupBy("grp").agg(F.greatest(by_terms, by_rows, F.lit(1)).cast("int").alias(name))


def pruned_candidates(
    vectors: DataFrame, index: LexicalIndex, k: int = 3, seeds: int = SEEDS
) -> tuple[DataFrame, DataFrame]:
    """((query, grp, item, score) of the pairs that may be among the best k; (grp, _qn, _in), the
    blocks of queries and items of each group).

    Queries and items of a group are cut into blocks, and a task takes one block of each. It
    returns the best k items of the block for each query, so sums of other pairs stay in the
    task; see ``_best_of_block``. What moves are the weighed texts, once for each block of the
    other side.
    """
    queries = vectors.filter(F.col("item").isNotNull())
    shape = materialize(
        _block_counts(queries, "_qn").join(_block_counts(index.vectors, "_in"), "grp"), "search-blocks"
    )
    keys = F.transform("terms", lambda t: F.xxhash64(t["term"])).alias("keys")
    weights = F.transform("terms", lambda t: t["w"]).alias("w")
    grp = F.col("grp").alias("grp")  # a column of its own: an index may be searched with its own items
    left = queries.join(shape, "grp").select(
        grp,
        F.pmod(F.xxhash64("item"), F.col("_qn")).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.col("_in") - 1)).alias("ib"),
        F.col("item").alias("query"),
        keys,
        weights,
    )
    right = index.vectors.join(shape, "grp").select(
        "grp",
        F.explode(F.sequence(F.lit(0), F.col("_qn") - 1)).alias("qb"),
        F.pmod(F.xxhash64("item"), F.col("_in")).cast("int").alias("ib"),
        "item",
        keys,
        weights,
    )
    schema = T.StructType(
        [left.schema["query"], left.schema["grp"], right.schema["item"], T.StructField("score", T.DoubleType())]
    )

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if len(a) and len(b):
            b = b.take(pc.sort_indices(b, sort_keys=[("item", "ascending")], null_placement="at_start"))
            query, item, score = _best_of_block(_flat(a), _flat(b), k, seeds)
        else:
            query, item, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        columns = [a["query"].take(query), a["grp"].take(query), b["item"].take(item), pa.array(score)]
        return pa.Table.from_arrays(columns, names=["query", "grp", "item", "score"])

    together = ["grp", "qb", "ib"]
    found = left.groupBy(*together).cogroup(right.groupBy(*together)).applyInArrow(run, schema)
    return materialize(found, "candidates"), shape


def _flat(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms of every row, their keys, their weights) of a block."""
    keys = block["keys"].combine_chunks()
    sizes = keys.value_lengths().to_numpy(zero_copy_only=False)
    weights = block["w"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return sizes, keys.flatten().to_numpy(zero_copy_only=False), weights


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th best value; below all if there are fewer."""
    if len(values) < k:
        return -np.inf
    if k > 8 or len(values) < 256:
        return float(np.partition(values, len(values) - k)[len(values) - k])
    best = []  # a few passes over all are less work than a partition
    for _ in range(k):
        at = int(values.argmax())
        best.append((at, values[at]))
        values[at] = -np.inf
    for at, value in best:
        values[at] = value
    return float(best[-1][1])


def _best_of_block(
    queries: tuple[np.ndarray, np.ndarray, np.ndarray], items: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, seeds: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, score) by place in the block: the best k items that share a term, for each query.

    A term adds at most its own weight times the greatest weight of it in the block. The few
    rare terms of a query that may add most are looked up first; the k-th best of these sums
    bounds the k-th best score from below. Then the most frequent terms whose bounds stay below it
    together are skipped: an item that shares no other term can't be among the best. The
    postings of the remaining, rarer terms give sums; the k-th best of them is a higher bound, and
    only items that reach it with all skipped terms get these added.
    """
    sizes, keys, weights = items
    order = np.argsort(keys, kind="stable")
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]  # postings, items ascending
    weight, sorted_ = weights[order], keys[order]
    if not len(sorted_):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    start = np.concatenate(([0], np.flatnonzero(np.diff(sorted_)) + 1))
    known, df = sorted_[start], np.diff(np.append(start, len(sorted_)))
    top = np.maximum.reduceat(weight, start)

    def sums(terms: np.ndarray, w: np.ndarray) -> np.ndarray:
        few = df[terms] <= SEED_ITEMS
        size = df[terms[few]]
        at = np.repeat(start[terms[few]] - np.cumsum(size) + size, size)
        at += np.arange(len(at))
        score = np.bincount(row[at], np.repeat(w[few], size) * weight[at], len(sizes)) if len(at) else np.zeros(len(sizes))
        for t, x in zip(terms[~few].tolist(), w[~few].tolist()):
            listed = slice(start[t], start[t] + df[t])
            score[row[listed]] += x * weight[listed]
        return score

    def scored(terms: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(items, their scores): at least the best k of those that share a term."""
        most = w * top[terms]
        rare = np.flatnonzero(df[terms] <= SEED_ITEMS)
        rare = rare[np.argsort(-most[rare], kind="stable")[:seeds]]
        floor = _kth(sums(terms[rare], w[rare]), k) - MARGIN if len(rare) else 0.0
        frequent = np.argsort(-df[terms], kind="stable")
        n = int(np.searchsorted(np.cumsum(most[frequent]), floor))  # bounds below it together
        skipped, left = frequent[:n], frequent[n:]
        score = sums(terms[left], w[left])
        least = max(floor, _kth(score, k) - MARGIN)
        if not n:
            some = np.flatnonzero(score >= least) if least > 0 else np.flatnonzero(score)
            return some, score[some]
        some = np.flatnonzero(score >= least - most[skipped].sum() - 1e-12)
        total = score[some]
        for t, x in zip(terms[skipped].tolist(), w[skipped].tolist()):
            listed = row[start[t] : start[t] + df[t]]
            place = np.minimum(np.searchsorted(listed, some), len(listed) - 1)
            hit = listed[place] == some
            total[hit] += x * weight[start[t] + place[hit]]
        return some, total

    sizes_, asked, w = queries
    place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    shared = known[place] == asked
    ends = np.cumsum(sizes_)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, (a, b) in enumerate(zip((ends - sizes_).tolist(), ends.tolist())):
        of = shared[a:b]
        if not of.any():
            continue
        some, score = scored(place[a:b][of], w[a:b][of])
        rounded = np.round(score, 4)
        near = np.flatnonzero(rounded >= _kth(rounded, k))
        best = near[np.argsort(-rounded[near], kind="stable")[:k]]  # the lower item first among equals
        found.append((np.full(len(best), i), some[best], score[best]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    query, item, score = (np.concatenate(c) for c in zip(*found))
    return query, item, score


def _rank(scores: DataFrame, asked: DataFrame, index: LexicalIndex, k: int) -> DataFrame:
    """Top k per query after adding the padding rows."""
    padding = (
        asked.join(index.groups.select("grp", "padding"), "grp")
        .select("query", "grp", F.explode("padding").alias("item"), F.lit(0.0).alias("score"))
    )
    # Padding only matters where fewer than k items share a term; prune the scores first.
    order = [F.col("score").desc(), F.col("item")]
    top = Window.partitionBy("query", "grp").orderBy(*order)
    rounded = scores.withColumn("score", F.round("score", 4))
    best = (
        rounded.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k).drop("rank")
    )
    merged = (
        best.unionByName(padding.select("query", "grp", "item", "score"))
        .groupBy("query", "grp", "item")
        .agg(F.max("score").alias("score"))
    )
    return merged.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)


def dense_matches(
    queries: DataFrame,
    items: DataFrame,
    group: str,
    k: int = 3,
    block: int = 2048,
    skip_same_id: bool = False,
) -> DataFrame:
    """Exact top-k items per query by cosine of dense vectors, within a group.

    Both tables hold (id, ``group``, vec). Queries and items of a group are cut into
    blocks of about ``block`` rows; every block pair is one small matrix product that
    returns k rows per query, and a last ranking merges the blocks. A group of any size is
    spread over block pairs, and no pair of rows is ever emitted.
    """

    def cut(df: DataFrame, name: str) -> DataFrame:
        sizes = df.groupBy(group).agg(
            F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias(name)
        )
        return sizes

    shape = cut(queries, "_qn").join(cut(items, "_in"), group)
    q = queries.join(shape, group).select(
        F.col(group).alias("grp"),
        F.pmod(F.xxhash64("id"), F.col("_qn")).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.col("_in") - 1)).alias("ib"),
        F.col("id").alias("query"),
        F.col("vec").alias("qvec"),
    )
    i = items.join(shape, group).select(
        F.col(group).alias("grp"),
        F.explode(F.sequence(F.lit(0), F.col("_qn") - 1)).alias("qb"),
        F.pmod(F.xxhash64("id"), F.col("_in")).cast("int").alias("ib"),
        F.col("id").alias("item"),
        F.col("vec").alias("ivec"),
    )
    schema = T.StructType(
        [
            T.StructField("grp", q.schema["grp"].dataType),
            T.StructField("query", q.schema["query"].dataType),
            T.StructField("item", i.schema["item"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def best_of_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["grp", "query", "item", "score"])
        right = right.sort_values("item", ignore_index=True)
        a = np.stack(left["qvec"].to_numpy()).astype("float64")
        b = np.stack(right["ivec"].to_numpy()).astype("float64")
        for side in (a, b):  # a zero vector scores 0 with everything
            norm = np.linalg.norm(side, axis=1, keepdims=True)
            np.divide(side, norm, out=side, where=norm > 0)
        score = np.round(a @ b.T, 4)
        if skip_same_id:
            score[left["query"].to_numpy()[:, None] == right["item"].to_numpy()[None, :]] = -np.inf
        n = min(k, len(right))
        # Stable sort on the score keeps the lower item id first among equal ones.
        top = np.argsort(-score, axis=1, kind="stable")[:, :n]
        rows = np.repeat(np.arange(len(left)), n)
        out = pd.DataFrame(
            {
                "grp": left["grp"].to_numpy()[rows],
                "query": left["query"].to_numpy()[rows],
                "item": right["item"].to_numpy()[top.ravel()],
                "score": score[rows, top.ravel()],
            }
        )
        return out[np.isfinite(out["score"])]

    keys = ["grp", "qb", "ib"]
    blocks = q.groupBy(*keys).cogroup(i.groupBy(*keys)).applyInPandas(best_of_block, schema)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "item")
    return blocks.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
