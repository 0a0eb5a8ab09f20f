"""Token-ID output: Arrow stream files of fixed-size-list batches.

A folder holds, for each range of the order, ``part-*.arrows`` with the columns ``ids``
(fixed-size list of unsigned integers) and ``mask`` (fixed-size list of booleans; false on the
padding of the last sequence), and ``part-*.docs.arrows`` with ``doc_id``, ``start`` (within the
part) and ``n_tokens``. All batches but a part's last have the same number of sequences, so that
sequence ``i`` is row ``i % rows`` of batch ``i // rows``: a view of the mapped file, nothing is
copied or decoded.

Defined cases: null text counts as empty (its document is the end id alone); rows without a
doc_id come first; rows that share a doc_id follow each other in the order of their texts; an
empty table gives parts without sequences; other columns of the input are not read.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, new_path
from .tokens import encoder

END = 2
SEQUENCE = 2048
BATCH = 64


#: Bytes of text of a part, roughly.
PART_BYTES = 256 << 20
#: Batches that a reader of a file that isn't mapped holds.
HELD = 4
#: Schemes of Hadoop's file systems that Arrow calls otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _fs(uri: str):
    from pyarrow import fs

    scheme, mark, rest = uri.partition("://")
    if not mark:
        return fs.FileSystem.from_uri("file://" + uri.removeprefix("file:"))
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


class _Writer:
    """Cuts a stream of ids into sequences of equal length and writes them in equal batches."""

    def __init__(self, sink, length: int, rows: int, kind: pa.DataType):
        self.length, self.rows, self.kind = length, rows, kind
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        size = self.length * self.rows
        if self.n_held >= size:
            flat = np.concatenate(self.held)
            whole = len(flat) // size * size
            for i in range(0, whole, size):
                self._write(flat[i : i + size], size)
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x, t), self.length) for x, t in ((flat.astype(self.kind.to_pandas_dtype()), self.kind), (mask, pa.bool_()))]
        self.out.write_batch(pa.record_batch(cols, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            self._write(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        self.out.close()


class TokenFile:
    """Random access to one part: ``sequence(i)``, ``mask(i)`` and ``ids(start, n)``.

    All batches but the last take the same number of bytes, so the place of each follows from
    the first one. A local file is mapped; of any other only the batches in use are read.
    """

    def __init__(self, uri: str):
        fs, path = _fs(uri)
        self._source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        reader = pa.ipc.open_stream(self._source)
        self.schema, self._first = reader.schema, self._source.tell()
        self.length = self.schema.field("ids").type.list_size
        first = next(iter(reader), None)
        self._step = self._source.tell() - self._first
        self.rows = first.num_rows if first else 1
        self._held = {0: self._columns(first)} if first else {}

    def close(self) -> None:
        self._held = {}
        self._source.close()

    def _columns(self, batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
        return batch.column("ids").flatten().to_numpy(), batch.column("mask").flatten()

    def _batch(self, b: int) -> tuple[np.ndarray, pa.Array]:
        if b not in self._held:
            if len(self._held) >= HELD:
                del self._held[next(iter(self._held))]
            self._source.seek(self._first + b * self._step)
            self._held[b] = self._columns(pa.ipc.read_record_batch(pa.ipc.read_message(self._source), self.schema))
        return self._held[b]

    def sequence(self, i: int) -> np.ndarray:
        b, r = divmod(i, self.rows)
        return self._batch(b)[0][r * self.length : (r + 1) * self.length]

    def mask(self, i: int) -> pa.Array:
        b, r = divmod(i, self.rows)
        return self._batch(b)[1].slice(r * self.length, self.length)

    def ids(self, start: int, n: int) -> np.ndarray:
        """A view where the range lies in one batch, else a copy of its parts."""
        size, got = self.rows * self.length, []
        while n > 0:
            b, at = divmod(start, size)
            got.append(self._batch(b)[0][at : at + n])
            start, n = start + len(got[-1]), n - len(got[-1])
        return got[0] if len(got) == 1 else np.concatenate(got) if got else np.empty(0, np.uint32)


def write(docs: DataFrame, folder: str, tokenizer: str, sequence: int = SEQUENCE, rows: int = BATCH, key: str = "doc_id", text: str = "text", end: int = END) -> list[tuple[str, str, int]]:
    """Write the documents in ascending order of ``key``; gives (file, index file, ids) of each
    part in order, which is one entry a partition.

    The order is made by ranges of the key (of key and text, where rows share a key), as many as
    the bytes of the texts ask for, and no fewer than there are cores. A task writes one part under
    a name of its own attempt, and only names of finished tasks are returned and listed in
    ``parts.json``, so lost or repeated tasks do no harm.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    ordered = read.repartitionByRange(parts, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        kind = pa.uint16() if enc.whole.get_vocab_size() <= 1 << 16 else pa.uint32()
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        fs, path = _fs(name)
        fs.create_dir(_fs(folder)[1])
        index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        at = 0
        with fs.open_output_stream(path + ".arrows") as sink, fs.open_output_stream(path + ".docs.arrows") as index_sink:
            out = _Writer(sink, sequence, rows, kind)
            with pa.ipc.new_stream(index_sink, index_schema) as index:
                for batch in batches:
                    ids, starts, ns = batch.column(0), [], []
                    for t in batch.column(1):
                        x = np.append(enc.encode(t.as_py() or ""), np.uint32(end))
                        out.add(x)
                        starts.append(at)
                        ns.append(len(x))
                        at += len(x)
                    index.write_batch(pa.record_batch([ids, pa.array(starts, pa.int64()), pa.array(ns, pa.int64())], schema=index_schema))
            out.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name + ".arrows"], "doc_file": [name + ".docs.arrows"], "n": [at]})

    done = ordered.mapInArrow(lean(run), "part long, file string, doc_file string, n long").collect()
    out = [(r.file, r.doc_file, r.n) for r in sorted(done)]
    fs, path = _fs(f"{folder}/parts.json")
    fs.create_dir(_fs(folder)[1])  # an empty table has no task that made it
    with fs.open_output_stream(path) as sink:
        sink.write(json.dumps(out).encode())
    return out


def listed(folder: str) -> list[tuple[str, str, int]]:
    """The parts of a folder as ``write`` returned them."""
    fs, path = _fs(f"{folder}/parts.json")
    with fs.open_input_file(path) as source:
        return [tuple(x) for x in json.loads(source.read())]


def read_digests(spark, parts: list[tuple[str, str, int]]) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids of all documents before it),
    n_tokens and the CRC-32 of its ids as little-endian unsigned 32-bit integers."""
    base = np.cumsum([0, *(n for _, _, n in parts)]).tolist()
    todo = spark.createDataFrame([(f, i, b) for (f, i, _), b in zip(parts, base)], "file string, index string, base long").repartitionByRange(max(1, len(parts)), "base", "file")

    def run(batches):
        for batch in batches:
            for file, index, first in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = TokenFile(file)
                fs, path = _fs(index)
                with fs.open_input_file(path) as f:
                    for rows in pa.ipc.open_stream(f):
                        ids, starts, ns = rows.columns
                        crc = [zlib.crc32(tokens.ids(s, n).astype("<u4").tobytes()) for s, n in zip(starts.to_pylist(), ns.to_pylist())]
                        yield pa.RecordBatch.from_arrays([ids, pa.array(starts.to_numpy() + first), ns, pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                tokens.close()

    return todo.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    parts = write(table(spark, sf_dir, "documents"), new_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    return read_digests(spark, parts)
