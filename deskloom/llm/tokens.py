"""Token ids in Arrow files of fixed-size lists.

Documents are range-partitioned in id order; each partition writes one file of sequences of
equal length, so files don't depend on each other and a lost task rewrites only its own. A file
is in the Arrow IPC file format with columns

- ``input_ids``: fixed-size list of unsigned ids (16 bits if the vocabulary fits), zero-padded,
- ``mask``: fixed-size list of booleans, true for ids, false for the padding at the file's end,
- ``spans``: list of (doc_id, first, at, n): the pieces of documents in this sequence; ``first``
  marks the piece that begins a document.

All record batches but the last hold the same number of sequences, so sequence i is batch
``i // batch``, row ``i % batch``, read through a memory map without copying.

The library's normalizer, pre-tokenizer and model run once per distinct piece of text between
ASCII white space. This encoder is for vocabularies whose normalizer lowers case and whose
pre-tokenizer drops white space (as ``word_bpe_49k.json``): neither joins nor looks across white
space, so the ids are those of whole texts; ``Encoder`` refuses other files.
Null and empty texts hold the end id alone. Null ids come first. Repeated rows are all kept.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from deskloom.llm.common import written
from deskloom.session import scratch_path

#: Ids of a sequence, sequences of a record batch, pieces of text that a worker remembers.
SEQUENCE, BATCH, REMEMBERED = 2048, 256, 1_000_000

_SPAN = pa.struct([("doc_id", pa.int64()), ("first", pa.bool_()), ("at", pa.int32()), ("n", pa.int32())])
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole texts as little-endian bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.encode("A b.", add_special_tokens=False).tokens != ["a</w>", "b</w>", ".</w>"]:
            raise ValueError(f"{path}: words must be lower-cased, apart from white space, with word ends")
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.model = self.tokenizer.model
        self.normal = self.tokenizer.normalizer.normalize_str
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.pieces: dict[bytes, bytes] = {}

    def learn(self, texts: list[list[bytes]]) -> None:
        fresh = {p for text in texts for p in text} - self.pieces.keys()
        if len(self.pieces) + len(fresh) > REMEMBERED:
            self.pieces = {}
            fresh = {p for text in texts for p in text}
        for piece in fresh:
            self.pieces[piece] = self._ids(piece)

    def _ids(self, piece: bytes) -> bytes:
        """Ids of a piece without white space; special tokens go the library's whole way."""
        if b"<|" in piece:
            ids = self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids
            return np.array(ids, self.dtype).tobytes()
        # A final comma or stop behind an ASCII letter is always a piece of its own.
        if len(piece) > 1 and piece[-1:] in (b",", b".") and piece[-2:-1].isalnum():
            return self._known(piece[:-1]) + self._known(piece[-1:])
        return self._known(piece)

    def _known(self, piece: bytes) -> bytes:
        # An ASCII letter may compose with a mark of U+0300 to U+037F, and with no other character,
        # to a letter that its other case lacks: there the normalizer lowers the case after composing.
        if b"\xcc" not in piece and b"\xcd" not in piece:
            piece = piece.lower()
        held = self.pieces.get(piece)
        if held is None:
            if piece.isalpha():  # ASCII letters: one token run, bytes as they are
                runs = [piece.decode()]
            else:
                runs = [r for r, _ in self.split(self.normal(piece.decode()))]
            held = np.array([t.id for r in runs for t in self.model.tokenize(r)], self.dtype).tobytes()
            self.pieces[piece] = held
        return held

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        self.learn(split)
        piece = self.pieces.__getitem__
        return [b"".join(map(piece, words)) for words in split]


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


class Shard:
    """Writes one file, a record batch at a time."""

    def __init__(self, path: str, dtype: np.dtype, sequence: int, batch: int):
        fs, place = filesystem(path)
        fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
        self.sequence, self.room, self.dtype = sequence, sequence * batch, dtype
        self.schema = pa.schema(
            [
                ("input_ids", pa.list_(pa.from_numpy_dtype(dtype), sequence)),
                ("mask", pa.list_(pa.bool_(), sequence)),
                ("spans", pa.list_(_SPAN)),
            ]
        )
        self.sink = fs.open_output_stream(place)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self._clear()

    def _clear(self) -> None:
        self.ids = np.zeros(self.room, self.dtype)
        self.used, self.spans = 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            place = self.used % self.sequence
            n = min(len(ids) - at, self.sequence - place)
            self.ids[self.used : self.used + n] = ids[at : at + n]
            self.spans.append((self.used // self.sequence, doc_id, at == 0, place, n))
            self.used, at = self.used + n, at + n
            if self.used == self.room:
                self.flush()

    def flush(self) -> None:
        if not self.used:
            return
        rows = -(-self.used // self.sequence)
        ids = self.ids[: rows * self.sequence]
        mask = np.arange(len(ids)) < self.used
        row, doc, first, place, n = zip(*self.spans)
        values = [pa.array(doc, pa.int64()), pa.array(first), pa.array(place, pa.int32()), pa.array(n, pa.int32())]
        spans = pa.StructArray.from_arrays(values, fields=list(_SPAN))
        offsets = pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32())
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(ids), self.sequence),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence),
            pa.ListArray.from_arrays(offsets, spans),
        ]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self._clear()

    def close(self) -> None:
        self.flush()
        self.writer.close()
        self.sink.close()


def write_sequences(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    end_id: int,
    text: str = "text",
    doc_id: str = "doc_id",
    sequence: int = SEQUENCE,
    batch: int = BATCH,
) -> DataFrame:
    """Write the files; (shard, path, n_docs, n_tokens, start) of each, a written table.

    A task names its file anew at each attempt, and only the attempt that Spark accepts is
    listed, so retries and speculative copies do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard, n_docs, n_tokens = encoder(vocabulary), None, 0, 0
        number = TaskContext.get().partitionId()
        path = f"{folder}/shard-{number:06d}-{uuid.uuid4().hex}.arrow"
        for part in batches:
            texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
            end = np.array([end_id], code.dtype).tobytes()
            for name, raw in zip(part.column(0).to_pylist(), code.encode(texts)):
                ids = np.frombuffer(raw + end, code.dtype)
                shard = shard or Shard(path, code.dtype, sequence, batch)
                shard.add(name, ids)
                n_docs, n_tokens = n_docs + 1, n_tokens + len(ids)
        if shard:
            shard.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": [number], "path": [path], "n_docs": [n_docs], "n_tokens": [n_tokens]}
            )

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    keys = [F.col("id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    files = written(ordered.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long"), "shards")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def open_sequences(path: str) -> pa.ipc.RecordBatchFileReader:
    """Random access to a file's batches; a local file is mapped, not read."""
    fs, place = filesystem(path)
    source = pa.memory_map(place) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(place)
    return pa.ipc.open_file(source)


def sequence_at(path: str, number: int, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """Ids (a view of the file) and mask of one sequence."""
    part = open_sequences(path).get_batch(number // batch)
    row = number % batch
    ids, mask = part.column("input_ids"), part.column("mask")
    return ids[row].values.to_numpy(), mask[row].values.to_numpy(zero_copy_only=False)


def _documents(path: str, start: int) -> Iterator[list[tuple]]:
    """(doc_id, start, n_tokens, crc32) of a file's documents, a list per record batch."""
    reader = open_sequences(path)
    doc = None
    for i in range(reader.num_record_batches):
        part, done = reader.get_batch(i), []
        lists, spans = part.column("input_ids"), part.column("spans")
        ids, length = lists.flatten().to_numpy(), lists.type.list_size
        piece = spans.flatten()
        row = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
        at = row * length + piece.field("at").to_numpy()
        for name, first, a, n in zip(
            piece.field("doc_id").to_pylist(), piece.field("first").to_pylist(), at.tolist(), piece.field("n").to_pylist()
        ):
            if first:
                if doc:
                    done.append(tuple(doc))
                    start += doc[2]
                doc = [name, start, 0, 0]
            doc[2] += n
            doc[3] = zlib.crc32(ids[a : a + n].astype("<u4").tobytes(), doc[3])
        yield done
    if doc:
        yield [tuple(doc)]


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for done in _documents(path, start):
                    if done:
                        columns = [pa.array(c, pa.int64()) for c in zip(*done)]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = files.select("path", "start")
    tasks = listed.sparkSession.sparkContext.defaultParallelism * 4
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return listed.repartition(tasks, "path").mapInArrow(run, schema)


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, **options) -> DataFrame:
    """Write ``docs`` as sequences below the shared folder and list their documents from there."""
    folder = scratch_path(docs.sparkSession, "sequences")
    return read_documents(write_sequences(docs, folder, vocabulary, end_id, **options))
