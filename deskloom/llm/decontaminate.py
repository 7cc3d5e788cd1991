"""Benchmark decontamination with training suffix arrays.

Every Arrow batch of whole training documents is a shard. In a shard, words that the test
set doesn't use become one separator symbol, runs shorter than the shortest window are left
out (they can't hold a match), and a suffix array is built over the rest by prefix doubling.
Every test suffix is searched by bisection; equal ranges give the locations, and neighbouring
windows on one diagonal join to the longest verbatim matches.

The test set is read in blocks of bounded size, each broadcast once; the training rows never
shuffle. Null or wordless texts have no words and no match; an empty test set matches nothing;
repeated rows are judged one by one; a null item id counts as the text ``null``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskloom.llm.common import alnum_words, lists, map_texts, written

#: Words of a window; an item of fewer words, but not none, is one window.
WIDTH = 13
#: Text bytes of the test set searched at a time (one item more at most).
BLOCK_BYTES = 8 << 20
#: Test suffixes compared at a time.
SEARCH_ROWS = 1 << 16

MATCH = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("item_word", T.IntegerType()),
        T.StructField("doc_word", T.IntegerType()),
        T.StructField("n_words", T.IntegerType()),
    ]
)


@dataclass
class TestBlock:
    """Test windows as rows of word numbers, padded with -1."""

    __test__ = False

    numbers: dict[bytes, int]
    windows: np.ndarray
    widths: np.ndarray
    item: np.ndarray
    word: np.ndarray
    item_ids: list[str]
    longest: int

    @property
    def shortest(self) -> int:
        return int(self.widths.min()) if len(self.widths) else 0


def test_block(items: Sequence[tuple[object, str | None]], width: int = WIDTH) -> TestBlock:
    numbers: dict[bytes, int] = {}
    rows, widths, item, word, ids, longest = [], [], [], [], [], 0
    for item_id, text in items:
        words = [numbers.setdefault(w, len(numbers) + 1) for w in alnum_words((text or "").encode())]
        if not words:
            continue
        size = min(width, len(words))
        longest = max(longest, len(words))
        for at in range(len(words) - size + 1):
            rows.append(words[at : at + size] + [-1] * (width - size))
            widths.append(size)
            item.append(len(ids))
            word.append(at)
        ids.append("null" if item_id is None else str(item_id))
    windows = np.array(rows, np.int32).reshape(len(rows), width)
    return TestBlock(
        numbers, windows, np.array(widths, np.int64), np.array(item, np.int64), np.array(word, np.int64), ids, longest
    )


test_block.__test__ = False


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, ordered by their first ``depth`` symbols at least."""
    rank = symbols.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    reach = 1
    while reach < depth:
        following = np.zeros_like(rank)
        following[:-reach] = rank[reach:]
        key = rank * (int(rank.max()) + 1) + following
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty_like(rank)
        rank[order] = fresh
        if fresh[-1] == len(fresh) - 1:
            break
        reach *= 2
    return order


def _bisect(symbols: np.ndarray, suffixes: np.ndarray, windows: np.ndarray, after: bool) -> np.ndarray:
    """First place whose suffix isn't below (``after``: is above) each window."""
    low = np.zeros(len(windows), np.int64)
    high = np.full(len(windows), len(suffixes), np.int64)
    columns, open_ = np.arange(windows.shape[1]), np.arange(len(windows))
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        wanted = windows[open_]
        apart = symbols[suffixes[middle][:, None] + columns] - wanted
        apart[wanted < 0] = 0
        first = apart[np.arange(len(open_)), (apart != 0).argmax(axis=1)]
        right = first <= 0 if after else first < 0
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]
        open_ = open_[low[open_] < high[open_]]
    return low


def shard_matches(shard: np.ndarray, test: TestBlock) -> tuple[np.ndarray, ...]:
    """(place, item, item word, words) of every longest match. ``shard``: word numbers of
    documents, 0 for words unknown to the test set, and a 0 behind each document."""
    none = (np.zeros(0, np.int64),) * 4
    if not len(test.widths) or not len(shard):
        return none
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (shard > 0).view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= test.shortest
    starts, sizes = starts[long], (ends - starts)[long] + 1
    if not len(starts):
        return none
    place = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    symbols = shard[place]
    suffixes = suffix_array(symbols, test.longest)
    symbols = np.concatenate((symbols, np.zeros(test.windows.shape[1], symbols.dtype)))
    places, found = [], []
    for at in range(0, len(test.windows), SEARCH_ROWS):
        part = test.windows[at : at + SEARCH_ROWS]
        low = _bisect(symbols, suffixes, part, after=False)
        count = _bisect(symbols, suffixes, part, after=True) - low
        total = int(count.sum())
        window = np.repeat(np.arange(len(part)), count)
        nth = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        places.append(place[suffixes[low[window] + nth]])
        found.append(window + at)
    p, w = np.concatenate(places), np.concatenate(found)
    item, word, width = test.item[w], test.word[w], test.widths[w]
    order = np.lexsort((word, p - word, item))
    p, item, word, width = p[order], item[order], word[order], width[order]
    if not len(p):
        return none
    new = np.ones(len(p), bool)
    new[1:] = (item[1:] != item[:-1]) | (p[1:] - word[1:] != p[:-1] - word[:-1]) | (word[1:] != word[:-1] + 1)
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(p)))
    return p[first], item[first], word[first], width[first] + runs - 1


def _matcher(block):
    """Batch function: texts to (number of words, longest matches)."""

    def make():
        test: TestBlock = block.value

        def apply(texts: list[bytes]) -> list[pa.Array]:
            number = test.numbers.get
            parts, counts = [], []
            for text in texts:
                words = alnum_words(text)
                counts.append(len(words))
                words.append(b" ")  # not a word: the separator
                parts.append(np.fromiter(map(number, words, repeat(0)), np.int32, len(words)))
            sizes = np.array(counts, np.int64)
            begins = np.cumsum(sizes + 1) - (sizes + 1)
            shard = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            place, item, word, length = shard_matches(shard, test)
            order = np.argsort(place, kind="stable")
            place, item, word, length = place[order], item[order], word[order], length[order]
            doc = np.searchsorted(begins, place, side="right") - 1
            ids = pa.array(test.item_ids, pa.string()).take(pa.array(item)) if len(item) else pa.array([], pa.string())
            columns = [ids, *(pa.array(x, pa.int32()) for x in (word, place - begins[doc], length))]
            offsets = np.searchsorted(doc, np.arange(len(texts) + 1))
            found = pa.StructArray.from_arrays(columns, names=MATCH.names)
            return [pa.array(sizes, pa.int64()), lists(offsets, found)]

        return apply

    return make


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list]:
    """Items in blocks of at most ``limit`` text bytes (one item more at most); one block at least."""
    block, size, given = [], 0, False
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string"), F.col(f"`{text}`").cast("string"))
    for row in rows.toLocalIterator():
        block.append((row[0], row[1]))
        size += len((row[1] or "").encode())
        if size >= limit:
            yield block
            block, size, given = [], 0, True
    if block or not given:
        yield block


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: Sequence[str],
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(row struct of ``keep``, n_words, matches) of every document.

    matches: array of (item_id, item_word, doc_word, n_words), the longest verbatim matches
    that hold at least one window of the item.
    """
    spark = docs.sparkSession
    fields = [T.StructField("n_words", T.LongType()), T.StructField("found", T.ArrayType(MATCH))]
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    block, ahead = next(blocks), next(blocks, None)
    carried = list(keep) if ahead is None else list(dict.fromkeys([*keep, text]))
    current = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("doc"),
        F.col(f"`{text}`").alias("text"),
        F.lit(None).cast(T.ArrayType(MATCH)).alias("before"),
    )
    while True:
        shared = spark.sparkContext.broadcast(test_block(block, width))
        step = map_texts(current, "text", ["doc", "before"], fields, _matcher(shared)).select(
            F.col("row.doc").alias("doc"),
            "n_words",
            F.concat(F.coalesce("row.before", F.array().cast(T.ArrayType(MATCH))), "found").alias("before"),
        )
        if ahead is None:
            row = F.struct(*[F.col("doc").getField(c).alias(c) for c in keep]).alias("row")
            return step.select(row, "n_words", F.col("before").alias("matches"))
        # The texts travel with their matches; a written step keeps one block in memory at a time.
        step = written(step, "matches")
        current = step.select("doc", F.col("doc").getField(text).alias("text"), "before")
        block, ahead = ahead, next(blocks, None)


def hit_words(found: Column) -> Column:
    """Number of document words inside any match: the length of the union of their spans."""
    spans = F.array_sort(
        F.transform(
            found, lambda m: F.struct(m["doc_word"].alias("a"), (m["doc_word"] + m["n_words"]).alias("b"))
        )
    )
    start = F.struct(F.lit(0).cast("int").alias("end"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(
        spans,
        start,
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["b"]).alias("end"),
            (acc["total"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))).alias("total"),
        ),
        lambda acc: acc["total"],
    )


def hit_items(found: Column) -> Column:
    """Sorted distinct ids of the matched items."""
    return F.array_sort(F.array_distinct(F.transform(found, lambda m: m["item_id"])))


def contaminated(n_words: Column, n_hit: Column, share: int = 20) -> Column:
    """A document is affected if at least one word in ``share`` lies inside a match."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the affected documents; columns unchanged."""
    found = matches(docs, benchmark, docs.columns, text=text, **options)
    keep = ~contaminated(F.col("n_words"), hit_words(F.col("matches")))
    return found.filter(keep).select("row.*")
