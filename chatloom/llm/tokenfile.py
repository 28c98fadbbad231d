"""Token ids in Arrow files of fixed-size-list batches (operator 4).

Documents are dealt out by ranges of doc_id; each range becomes one Arrow IPC file. The ids of its documents, each followed
by an end id, form one run that is cut into sequences of equal length, so a file is a column of fixed-size lists. All its
batches but the last have the same number of sequences: a sequence is found by arithmetic and can be used from mapped memory
without a copy. Two more fixed-size lists of bits go
with it: ``mask`` (true on ids, false on the padding of a file's last sequence) and ``ends`` (true on each document's last
id). A second Arrow file lists the documents (doc_id, start in the file, number of ids). Files are written under another
name and renamed, so a lost or repeated task leaves whole files only; a manifest table names them with their counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.llm.wordids import word_ids
from chatloom.llm.workers import in_small_batches, slices

#: Bytes of text of one file at most, where ranges are even (ids take about half as many bytes).
FILE_BYTES = 256 << 20
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "part int, tokens_file string, index_file string, n_docs long, n_tokens long, n_sequences long"


def _store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI (or plain path) and the path in it."""
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pa.fs.LocalFileSystem(), uri)


def layout(id_type: pa.DataType, length: int) -> pa.Schema:
    """The schema of a token file."""
    return pa.schema([("ids", pa.list_(id_type, length)), ("mask", pa.list_(pa.bool_(), length)), ("ends", pa.list_(pa.bool_(), length))])


def _bits(flags: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.bool_(), len(flags), [None, pa.py_buffer(np.packbits(flags, bitorder="little").tobytes())])


def _batch(schema: pa.Schema, length: int, ids: np.ndarray, ends: np.ndarray, pad: int = 0) -> pa.RecordBatch:
    """Whole sequences as one record batch; the last ``pad`` places are padding."""
    mask = np.ones(len(ids) + pad, bool)
    mask[len(ids) :] = False
    ids, ends = np.concatenate([ids, np.zeros(pad, ids.dtype)]), np.concatenate([ends, np.zeros(pad, bool)])
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(x, length) for x in (pa.array(ids), _bits(mask), _bits(ends))], schema=schema)


def _write(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str, end_id: int, length: int, rows: int) -> Iterator[pa.RecordBatch]:
    words, part, token = None, TaskContext.get().partitionId(), uuid.uuid4().hex
    store, root = _store(folder)
    names = [f"{root}/{kind}-{part:06d}.arrow" for kind in ("tokens", "index")]
    dtype = np.dtype("<u4")
    held: list[np.ndarray] = []
    index: list[tuple[int | None, int, int]] = []
    n = total = docs = sequences = 0
    tokens_out = index_out = None
    sinks: list = []

    left = np.zeros(0, bool)  # the ends in held[0], where that is what the last flush left over

    def flush(last: bool) -> None:
        nonlocal held, left, n, sequences
        run = np.concatenate(held)
        ends = np.zeros(len(run), bool)
        ends[np.cumsum([len(x) for x in held])[bool(len(left)) :] - 1] = True
        ends[: len(left)] = left
        whole = len(run) if last else len(run) // (rows * length) * (rows * length)
        for at in range(0, whole, rows * length):
            part = run[at : min(at + rows * length, whole)]
            tokens_out.write_batch(_batch(schema, length, part, ends[at : at + len(part)], -len(part) % length))
            sequences += -(-len(part) // length)
        held, left, n = ([run[whole:]] if whole < len(run) else []), ends[whole:], len(run) - whole

    for part_rows, texts in slices(batches, 1):
        for doc_id, text in zip(part_rows.column(0).to_pylist(), texts, strict=True):
            if words is None:
                words = word_ids(vocabulary)
                dtype = np.dtype("<u2" if max(words.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else "<u4")
                schema = layout(pa.from_numpy_dtype(dtype), length)
                store.create_dir(root, recursive=True)
                sinks = [store.open_output_stream(f"{x}.{token}") for x in names]
                tokens_out, index_out = pa.ipc.new_file(sinks[0], schema), pa.ipc.new_file(sinks[1], INDEX)
            ids = np.append(np.frombuffer(words.encode(text), "<u4"), np.uint32(end_id)).astype(dtype)
            index.append((doc_id, total, len(ids)))
            total, docs, n = total + len(ids), docs + 1, n + len(ids)
            held.append(ids)
            if n >= rows * length:
                flush(last=False)
            if len(index) >= 8192:
                index_out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*index, strict=True)], schema=INDEX))
                index = []
    if tokens_out is None:
        return
    if held:
        flush(last=True)
    if index:
        index_out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*index, strict=True)], schema=INDEX))
    for out, sink, name in zip((tokens_out, index_out), sinks, names, strict=True):
        out.close()
        sink.close()
        store.move(f"{name}.{token}", name)
    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "tokens_file": [names[0].rpartition("/")[2]], "index_file": [names[1].rpartition("/")[2]], "n_docs": [docs], "n_tokens": [total], "n_sequences": [sequences]})


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, length: int = 2048, files: int | None = None, rows: int = 256) -> DataFrame:
    """Encode every whole text and write it in ascending doc_id order below ``folder``; returns the manifest.

    ``files`` ranges of doc_id are written side by side, one file each, in batches of ``rows`` sequences of ``length`` ids; by
    default one for each 256 MB of text, and at least the session's shuffle partitions. Ids are stored in 16 bits where the
    vocabulary allows, else in 32.

    Null or empty text: the end id alone. Null doc_id: first in the order. Equal doc_ids: by crc32 of the text. Repeated
    rows: each is written. Empty table: an empty manifest. Other columns are not read.
    """
    spark = docs.sparkSession
    rows_in = in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    if not files:
        size = rows_in.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    tie = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    ranges = rows_in.repartitionByRange(files, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    ranges.mapInArrow(lambda b: _write(b, folder, vocabulary, end_id, length, rows), MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each file, with the number of ids and sequences in all files before it."""
    # As many rows as files, a number the writer was given; so one task may run through them in order.
    order = Window.orderBy("part")
    found = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return found.withColumns({f"{c}_before": F.sum(f"n_{c}").over(order) - F.col(f"n_{c}") for c in ("tokens", "sequences")})


class TokenFile:
    """Random access to the sequences of one token file; on a local disk the memory is mapped and nothing is copied."""

    def __init__(self, uri: str):
        store, path = _store(uri)
        source = pa.memory_map(path) if isinstance(store, pa.fs.LocalFileSystem) else store.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.batches = self.reader.num_record_batches
        self.rows = self.reader.get_batch(0).num_rows if self.batches else 0
        self.read = -1

    def _at(self, batch: int) -> pa.RecordBatch:
        if self.read != batch:
            self.read, self.held = batch, self.reader.get_batch(batch)
        return self.held

    def __len__(self) -> int:
        return (self.batches - 1) * self.rows + self._at(self.batches - 1).num_rows if self.batches else 0

    def sequence(self, i: int, column: str = "ids") -> pa.Array:
        """Sequence ``i`` of the file: its ids, mask or ends."""
        batch, row = divmod(i, self.rows or 1)
        if not 0 <= batch < self.batches or row >= self._at(batch).num_rows:
            raise IndexError(i)
        return self._at(batch).column(column).values.slice(row * self.length, self.length)

    def runs(self) -> Iterator[np.ndarray]:
        """The ids without padding, batch by batch."""
        for b in range(self.batches):
            batch = self.reader.get_batch(b)
            ids = batch.column("ids").values.to_numpy(zero_copy_only=True)
            yield ids if b < self.batches - 1 else ids[: int(np.count_nonzero(batch.column("mask").values.to_numpy(zero_copy_only=False)))]


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tokens_file, index_file, before in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            store, root = _store(folder)
            runs = TokenFile(f"{folder}/{tokens_file}").runs()
            have = np.zeros(0, "<u4")
            with store.open_input_file(f"{root}/{index_file}") as f:
                index = pa.ipc.open_file(f)
                for part in (index.get_batch(i) for i in range(index.num_record_batches)):
                    out, size = [], 0
                    lengths = part.column("n_tokens").to_numpy()
                    done = 0
                    for k, n in enumerate(lengths.tolist()):
                        if len(have) < n:
                            parts, m = [have], len(have)
                            while m < n:
                                parts.append(next(runs))
                                m += len(parts[-1])
                            have = np.concatenate(parts)
                        out.append(have[:n].astype("<u4").tobytes())
                        have, size = have[n:], size + n
                        if size >= 1 << 20 or k == len(lengths) - 1:
                            rows = part.slice(done, k + 1 - done)
                            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(rows.column("start").to_numpy() + before), rows.column("n_tokens"), pa.array(out, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                            out, size, done = [], 0, k + 1


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents read back from the files: doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    files = read_manifest(spark, folder).select("tokens_file", "index_file", "tokens_before").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.mapInArrow(lambda b: _read(b, folder), "doc_id long, start long, n_tokens long, ids binary")
