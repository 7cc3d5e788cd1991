"""Fill-in-the-middle transformation: whole texts cut at two points and put together anew.

Cut points are counted in code points and found in the UTF-8 bytes of a whole Arrow batch, eight
bytes at a time: the batch's text buffer is viewed as little-endian uint64 words. A byte
``10xxxxxx`` continues a code point, so bit arithmetic on a word marks the bytes that end one
(those before a byte that continues none). ``bitwise_count`` of the marks gives the code points
of every word, their running sum is searched for the word that holds the k-th end, and inside
that word a multiplication spreads the prefix sums of the marks over its bytes, of which those
below the rank are counted (select). No text is decoded and no text is walked byte by byte.

A text of n code points is cut after ``d1 % (n + 1)`` and ``d2 % (n + 1)`` of them, with draws d1
to d4 from SHA-256 of the seed and the row's key: the result depends on nothing else, so it is
the same after a retry and on any partitioning. Forms are ``plain``, ``psm`` and ``spm``; a text
that holds a marker, or none at all, stays plain. No marker arises at a seam, as none begins
inside another, so ``restored`` gives the exact text back.

Null texts are empty and plain. A null key draws like the text ``null``. Repeated rows get equal
results. Rows are handled one by one in the scan's partitions: no shuffle, and a worker holds one
batch. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are transformed, and of these the percent in suffix-first order.
TRANSFORMED, SUFFIX_FIRST, SEED = 90, 20, 1

_ONES = np.uint64(0x0101010101010101)
_HIGHS = np.uint64(0x8080808080808080)


class Ends:
    """Ranks and places of code point ends in a buffer of UTF-8 texts, lying end to end.

    ``starts`` are the texts' first bytes: one begins a code point whatever it holds.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        size = len(data)
        padded = np.zeros(-(-size // 8) * 8 + 8, np.uint8)
        padded[:size] = data
        words = padded.view("<u8")
        # Bit 0 of each byte: set if the byte continues a code point.
        goes_on = (words >> np.uint64(7)) & ~(words >> np.uint64(6)) & _ONES
        goes_on.view(np.uint8)[starts] = 0
        following = (goes_on[:-1] >> np.uint64(8)) | (goes_on[1:] << np.uint64(56))
        self.marks = ~following & _ONES
        self.marks.view(np.uint8)[size:] = 0
        self.total = np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that end before byte ``at``."""
        word, inside = at >> 3, (at & 7).astype(np.uint64)
        before = np.concatenate(([0], self.total))[word]
        held = np.append(self.marks, np.uint64(0))[word]
        below = held & ((np.uint64(1) << (inside << np.uint64(3))) - np.uint64(1))
        return before + np.bitwise_count(below).astype(np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte after the k-th end, from 1; 0 for k = 0."""
        if not len(self.total):
            return np.zeros(len(k), np.int64)
        word = np.searchsorted(self.total, np.maximum(k, 1))
        left = (k - np.concatenate(([0], self.total))[word]).astype(np.uint64)
        sums = self.marks[word] * _ONES  # byte j: ends in bytes 0 to j
        reached = ((sums | _HIGHS) - left * _ONES) & _HIGHS
        place = 8 - np.bitwise_count(reached).astype(np.int64)
        return np.where(k > 0, 8 * word + place + 1, 0)


def cut(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, code points before the cuts, bytes of the cuts) of texts ``data[offsets[i]:offsets[i + 1]]``;
    two columns of ``draws``."""
    filled = np.flatnonzero(np.diff(offsets) > 0)
    ends = Ends(data, offsets[filled])
    rank = ends.rank(offsets)
    n = np.diff(rank)
    points = np.sort(draws % (n[:, None] + 1), axis=1)
    places = np.maximum(ends.select((rank[:-1, None] + points).ravel()).reshape(points.shape), offsets[:-1, None])
    return n, points, places


def draws(key: Column, seed: int = SEED) -> Column:
    """Four unsigned 32-bit draws: the first groups of hex digits of SHA-256 of ``seed:key``."""
    name = F.coalesce(key.cast("string"), F.lit("null"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), name), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a binary array; null: empty."""
    filled = texts.cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(filled.buffers()[1], np.int32, len(filled) + 1, 4 * filled.offset).astype(np.int64)
    held = filled.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def transform(
    docs: DataFrame,
    keep: Sequence[str],
    text: str = "text",
    key: str = "doc_id",
    seed: int = SEED,
    markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
    transformed: int = TRANSFORMED,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """(row struct of ``keep``, n, form, prefix_chars, middle_chars, output) of every row.

    ``markers`` stand before prefix, suffix and middle; they begin with a character that none of
    them holds again.
    """
    p, s, m = (x.encode() for x in markers)
    if any(a[:1] in b[1:] for a in (p, s, m) for b in (p, s, m)) or not (p and s and m):
        raise ValueError("no marker may begin inside another")
    row_type = T.StructType([docs.schema[c] for c in keep])
    out = T.StructType(
        [
            T.StructField("row", row_type),
            T.StructField("n", T.LongType()),
            T.StructField("form", T.StringType()),
            T.StructField("prefix_chars", T.LongType()),
            T.StructField("middle_chars", T.LongType()),
            T.StructField("output", T.StringType()),
        ]
    )
    source = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.col(f"`{text}`").cast("string").alias("text"),
        draws(F.col(f"`{key}`"), seed).alias("draws"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = _buffers(batch.column(1))
            drawn = batch.column(2).flatten().to_numpy().reshape(-1, 4)
            n, points, places = cut(data, offsets, drawn[:, :2])
            raw = data.tobytes()
            forms, outputs = [], []
            for i, (a, b, c, d) in enumerate(
                zip(offsets[:-1].tolist(), places[:, 0].tolist(), places[:, 1].tolist(), offsets[1:].tolist())
            ):
                whole = raw[a:d]
                if a == d or drawn[i, 2] % 100 >= transformed or p in whole or s in whole or m in whole:
                    forms.append("plain")
                    outputs.append(whole)
                elif drawn[i, 3] % 100 < suffix_first:
                    forms.append("spm")
                    outputs.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
                else:
                    forms.append("psm")
                    outputs.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
            plain = np.array([f == "plain" for f in forms])
            columns = [
                batch.column(0),
                pa.array(n, pa.int64()),
                pa.array(forms, pa.string()),
                pa.array(points[:, 0], pa.int64(), mask=plain),
                pa.array(points[:, 1] - points[:, 0], pa.int64(), mask=plain),
                pa.array(outputs, pa.binary()).cast(pa.string(), safe=False),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return source.mapInArrow(run, out)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``output`` was made from."""
    parts = F.split(output, "|".join(map(re.escape, markers)), -1)

    def joined(*order: int) -> Column:
        return F.concat(*[F.get(parts, F.lit(i)) for i in order])

    return F.when(form == "psm", joined(1, 3, 2)).when(form == "spm", joined(2, 3, 1)).otherwise(output)
