"""Token ids as Arrow stream files of equal-length sequences, read back at any place without copying.

A file is one Arrow IPC stream whose batches hold two fixed-size-list columns,
``ids`` (the smallest unsigned type that holds the vocabulary) and ``mask``
(true where an id is real). Every batch but the last has the same number of
sequences and no nulls, so all of them take the same number of bytes: the place
of batch i is the end of the schema message plus i times that number, and a
sequence is a view of the mapped file, found without an index or a footer.

Documents are range-partitioned by id; a part becomes one file, written batch by
batch, so memory does not depend on its size. Ids run on from one document to
the next over the borders of sequences; only the last sequence of a file is
padded. Beside each file of sequences lies a second stream with a row for each
document: its id, the place of its first token in the file, and its number of
tokens. The manifest, one row per file, names the files of the attempts that
succeeded; what a lost attempt has written is never read.

Files go to a folder that all executors share (any file system that both Spark
and Arrow open). Reading deals ranges of documents, not files, so one large file
is read by many tasks.

Defined cases: a null or empty text is the single end id. Very long texts span
as many sequences and batches as they need. Rows that repeat an id, or a whole
row, stay documents of their own, ordered by a hash of their text; a null id
comes first. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainfold.llm.frames import keep_in_folder, parts, pick
from grainfold.llm.packing import Encoder
from grainfold.session import scratch_path

SEQUENCE, END_ID, PAD_ID = 2048, 2, 0
BATCH_ROWS = 64  # sequences in a batch
INDEX_ROWS = 1 << 14  # documents in a batch of the second stream
READ_TOKENS = 1 << 22  # tokens of the documents that a task reads at a time
MANIFEST = "part int, tokens string, documents string, n_documents bigint, n_tokens bigint"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a Spark path."""
    for theirs, ours in (("s3a://", "s3://"), ("s3n://", "s3://"), ("file:/", "file:///")):
        if path.startswith(theirs) and not path.startswith(ours):
            path = ours + path.removeprefix(theirs).lstrip("/")
    return fs.FileSystem.from_uri(path)


def _source(path: str) -> pa.NativeFile:
    """A mapped file where the file system allows it."""
    system, place = opened(path)
    return pa.memory_map(place) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(place)


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


class SequenceWriter:
    """One file of equal-length sequences with masks; at most one batch is held."""

    def __init__(self, sink, dtype: np.dtype, sequence: int = SEQUENCE, rows: int = BATCH_ROWS, pad_id: int = PAD_ID):
        self.sequence, self.pad_id, self.written = sequence, pad_id, 0
        self.buffer, self.filled = np.full(rows * sequence, pad_id, dtype), 0
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([pa.field("ids", pa.list_(pa.field("id", kind, False), sequence), False), pa.field("mask", pa.list_(pa.field("real", pa.bool_(), False), sequence), False)])
        self.stream = pa.ipc.new_stream(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, len(self.buffer) - self.filled)
            self.buffer[self.filled : self.filled + n] = ids[at : at + n]
            at += n
            self.filled += n
            if self.filled == len(self.buffer):
                self._flush()
        self.written += len(ids)

    def _flush(self) -> None:
        size = -(-self.filled // self.sequence) * self.sequence
        self.buffer[self.filled : size] = self.pad_id
        columns = (pa.array(self.buffer[:size]), pa.array(np.arange(size) < self.filled))
        self.stream.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(c, type=f.type) for c, f in zip(columns, self.schema)], schema=self.schema))
        self.filled = 0

    def close(self) -> None:
        if self.filled:
            self._flush()
        self.stream.close()


class Sequences:
    """Random access to a file of sequences; ids and masks are views of the file where it can be mapped."""

    def __init__(self, path: str):
        self.source = _source(path)
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(self.source))
        self.sequence = self.schema.field("ids").type.list_size
        self.head = self.source.tell()
        self.rows = len(self._next() or ())  # of every batch but the last
        self.stride = self.source.tell() - self.head
        end = self.source.size()
        self.full = (end - self.head) // self.stride if self.rows else 0
        rest = self._at(self.full) if self.rows else None
        self.n = self.full * self.rows + len(rest or ())

    def _next(self) -> pa.RecordBatch | None:
        try:
            message = pa.ipc.read_message(self.source)
        except EOFError:
            return None
        return pa.ipc.read_record_batch(message, self.schema)

    def _at(self, number: int) -> pa.RecordBatch | None:
        self.source.seek(self.head + number * self.stride)
        return self._next()

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids of sequence i, padding included, and its mask."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        batch, at = self._at(i // self.rows), i % self.rows
        a, b = at * self.sequence, (at + 1) * self.sequence
        return batch.column("ids").values.to_numpy()[a:b], batch.column("mask").values[a:b]

    def span(self, first: int, length: int) -> Iterator[np.ndarray]:
        """Views, one per batch, of ``length`` ids from place ``first`` of the file on."""
        each = self.rows * self.sequence
        while length > 0:
            batch, at = self._at(first // each), first % each
            n = min(length, each - at)
            yield batch.column("ids").values.to_numpy()[at : at + n]
            first, length = first + n, length - n


@lru_cache(maxsize=1)
def _encoder(tokenizer: str) -> Encoder:
    """A worker keeps its tokenizer and the ids of common words from task to task."""
    return Encoder(tokenizer)


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, *, doc_id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE,
          end_id: int = END_ID, pad_id: int = PAD_ID, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write the ids of all texts in ascending order of their ids; gives the manifest, a row for each file."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    kept = pick(docs, doc_id=doc_id, text=text).withColumn("tie", F.xxhash64("text"))
    # equal rows are parted by a running number, so no id or copy is too much for one part
    dealt = kept.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts(spark), "doc_id", "tie", "row")
    dealt = dealt.sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")

    def save(batches):
        from pyspark import TaskContext

        encoder = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if encoder is None:
                encoder = _encoder(tokenizer)
                system, place = opened(folder)
                system.create_dir(place, recursive=True)
                names = [f"{kind}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.arrows" for kind in ("tokens", "documents")]
                sinks = [system.open_output_stream(f"{place}/{name}") for name in names]
                tokens = SequenceWriter(sinks[0], id_type(encoder.tokenizer.get_vocab_size()), sequence, batch_rows, pad_id)
                schema = pa.schema([("doc_id", batch.schema.field(0).type), ("first", pa.int64()), ("n_tokens", pa.int64())])
                index, n = pa.ipc.new_stream(sinks[1], schema), 0
            first, size = [], []
            for ids in encoder.texts(batch.column(1)):
                first.append(tokens.written)
                tokens.add(ids)
                tokens.add(np.array([end_id]))
                size.append(tokens.written - first[-1])
            index.write_table(pa.table([batch.column(0), pa.array(first, pa.int64()), pa.array(size, pa.int64())], schema=schema), max_chunksize=INDEX_ROWS)
            n += batch.num_rows
        if encoder is None:
            return
        tokens.close()
        index.close()
        for sink in sinks:
            sink.close()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([TaskContext.get().partitionId()], pa.int32()), **{k: [f"{folder}/{name}"] for k, name in zip(("tokens", "documents"), names)},
            "n_documents": [n], "n_tokens": [tokens.written]})

    return keep_in_folder(dealt.mapInArrow(save, MANIFEST), "token-manifest")  # a file is a part: no part may join another


def index(manifest: DataFrame, id_type: T.DataType | None = None) -> DataFrame:
    """Per document: doc_id, tokens (its file), first (place in it), start (ids of all documents before it), n_tokens."""
    return _read(manifest, id_type or T.LongType(), False)


def read(manifest: DataFrame, id_type: T.DataType | None = None) -> DataFrame:
    """The same with ids_crc32, the checksum of a document's ids as little-endian unsigned 32-bit numbers, from the files."""
    return _read(manifest, id_type or T.LongType(), True)


def _read(manifest: DataFrame, id_type: T.DataType, content: bool) -> DataFrame:
    spark = manifest.sparkSession
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    # about as many ranges of a file's documents as its tokens ask for
    ranges = F.greatest(F.lit(1), F.least("n_documents", F.ceil(F.col("n_tokens") / READ_TOKENS)))
    dealt = placed.withColumn("of", ranges).withColumn("range", F.explode(F.sequence(F.lit(1), "of")))
    dealt = dealt.select("tokens", "documents", "before", F.expr("(range - 1) * n_documents div of").alias("lo"), F.expr("range * n_documents div of").alias("hi"))
    dealt = dealt.repartition(parts(spark))
    schema = T.StructType([T.StructField("doc_id", id_type)] + ([] if content else [T.StructField("tokens", T.StringType())])
                          + [T.StructField(c, T.LongType()) for c in (("start", "n_tokens", "ids_crc32") if content else ("first", "start", "n_tokens"))])

    def load(batches):
        for batch in batches:
            for work in batch.to_pylist():
                sequences, at = Sequences(work["tokens"]) if content else None, 0
                for found in pa.ipc.open_stream(_source(work["documents"])):
                    own = found.slice(max(0, work["lo"] - at), max(0, min(found.num_rows, work["hi"] - at) - max(0, work["lo"] - at)))
                    at += found.num_rows
                    if not own.num_rows:
                        continue
                    first, size = own.column("first").to_numpy(), own.column("n_tokens").to_numpy()
                    start = pa.array(first + work["before"])
                    if not content:
                        yield pa.RecordBatch.from_arrays([own.column(0), pa.array([work["tokens"]] * own.num_rows), own.column("first"), start, own.column("n_tokens")], names=schema.names)
                        continue
                    check = np.zeros(own.num_rows, np.int64)
                    for i in range(own.num_rows):
                        value = 0
                        for ids in sequences.span(int(first[i]), int(size[i])):
                            value = zlib.crc32(ids.astype("<u4", copy=False).tobytes(), value)
                        check[i] = value
                    yield pa.RecordBatch.from_arrays([own.column(0), start, own.column("n_tokens"), pa.array(check)], names=schema.names)

    return dealt.mapInArrow(load, schema)
