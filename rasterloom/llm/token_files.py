"""Token ids in Arrow file format: record batches of fixed-size lists, one column of ids and one of masks.

A part file holds the ids of a run of documents in ascending doc_id order, cut into sequences of equal
length; only its last sequence is padded, with the mask false there. Sequence ``i`` is row ``i % rows`` of
batch ``i // rows``, so a memory map gives it without a copy. A second file lists the part's documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import arrow_map, shared_dir, staged
from .subwords import encoder, vocabulary

#: Ids in a sequence, and sequences in a record batch.
LENGTH, ROWS = 2048, 256
END_ID = 2
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    item = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(pa.field("item", item, False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))])


class PartWriter:
    """Writes one part; it holds no more than one record batch of ids. The file appears under its name only
    when it is complete, so that a task that is lost or runs twice leaves no torn part."""

    def __init__(self, fs, path: str, dtype: np.dtype, length: int, rows: int, attempt: int):
        self.fs, self.path, self.length, self.rows, self.tmp = fs, path, length, rows, f".attempt-{attempt}"
        self.schema, self.dtype = _schema(dtype, length), dtype
        self.sinks = [fs.open_output_stream(f"{path}{ext}{self.tmp}") for ext in (".arrow", ".docs.arrow")]
        self.ids, self.docs = (pa.ipc.new_file(s, x) for s, x in zip(self.sinks, (self.schema, DOCS)))
        self.buffer, self.held, self.total, self.index = [], 0, 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id, self.total, len(ids)))
        self.total += len(ids)
        self.buffer.append(ids)
        self.held += len(ids)
        size = self.length * self.rows
        if self.held >= size:
            flat = np.concatenate(self.buffer)
            whole = len(flat) // size * size
            for at in range(0, whole, size):
                self._batch(flat[at : at + size], size)
            self.buffer, self.held = [flat[whole:]], len(flat) - whole
        if len(self.index) >= 50_000:
            self._flush_docs()

    def _batch(self, flat: np.ndarray, used: int) -> None:
        mask = np.arange(len(flat)) < used
        self.ids.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(v, f.type.value_type), type=f.type) for v, f in zip((flat, mask), self.schema)], schema=self.schema))

    def _flush_docs(self) -> None:
        if self.index:
            self.docs.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.index)], schema=DOCS))
            self.index = []

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.buffer)
            self._batch(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        self._flush_docs()
        for w, s, ext in zip((self.ids, self.docs), self.sinks, (".arrow", ".docs.arrow")):
            w.close()
            s.close()
            self.fs.move(f"{self.path}{ext}{self.tmp}", f"{self.path}{ext}")


    def abort(self) -> None:
        """Remove what an attempt that failed has written."""
        for s, ext in zip(self.sinks, (".arrow", ".docs.arrow")):
            s.close()
            self.fs.delete_file(f"{self.path}{ext}{self.tmp}")


class PartReader:
    """Random access to a part. On a local or mounted disk it is a memory map and sequences are views."""

    def __init__(self, fs, path: str):
        mapped = isinstance(fs, pa.fs.LocalFileSystem)
        opened = [pa.memory_map(f"{path}{x}") if mapped else fs.open_input_file(f"{path}{x}") for x in (".arrow", ".docs.arrow")]
        self.file, self.docs = map(pa.ipc.open_file, opened)
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        batch = self.file.get_batch(i // self.rows)
        i %= self.rows
        return batch["ids"].flatten().to_numpy()[i * self.length : (i + 1) * self.length], batch["mask"].flatten()[i * self.length : (i + 1) * self.length]

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the part, gathered batch by batch."""
        size, out = self.length * self.rows, []
        for b in range(start // size, -(-(start + n) // size)):
            at = b * size
            out.append(self.file.get_batch(b)["ids"].flatten().to_numpy()[max(0, start - at) : start + n - at])
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint16)


def write_token_files(docs: DataFrame, folder: str, vocab: str | None = None, end_id: int = END_ID, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Encode docs (doc_id, text, ...) into part files under ``folder``; returns the manifest
    (part, path, n_docs, n_tokens), one row per part, ordered as the documents are.

    A null text is empty and yields only the end id; a very long one is written whole, a record batch at a time.
    A null doc_id comes first. Repeated rows are written as often as they occur, in no fixed order among equals.
    Other columns are ignored, whatever their names. An empty table gives no parts.
    """
    vocab = vocab or vocabulary()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, enc, out, n = TaskContext.get(), encoder(vocab), None, 0
        fs, root = pa.fs.FileSystem.from_uri(folder)
        try:
            for batch in batches:
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                    if out is None:
                        fs.create_dir(root)
                        path = f"{root}/part-{task.partitionId():06d}"
                        out = PartWriter(fs, path, enc.dtype, length, rows, task.taskAttemptId())
                    out.add(doc_id, np.append(np.frombuffer(enc.encode(text.as_py()), enc.dtype), enc.dtype.type(end_id)))
                    n += 1
        except BaseException:
            if out:
                out.abort()
            raise
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [path], "n_docs": [n], "n_tokens": [out.total]})

    rows_in = docs.select(F.col("doc_id").cast("long"), "text")
    ordered = rows_in.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return staged(arrow_map(ordered, write, "part long, path string, n_docs long, n_tokens long"), "manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the part files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, before in zip(batch["path"].to_pylist(), batch["before"].to_pylist()):
                part = PartReader(fs, path)
                for b in range(part.docs.num_record_batches):
                    d = part.docs.get_batch(b)
                    crc = [zlib.crc32(part.tokens(s, n).astype("<u4").tobytes()) for s, n in zip(d["start"].to_pylist(), d["n_tokens"].to_pylist())]
                    yield pa.RecordBatch.from_arrays([d["doc_id"], pa.array(d["start"].to_numpy() + before), d["n_tokens"], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.select("part", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))
    parts = parts.repartition(max(1, manifest.count()), "part")
    return arrow_map(parts.select("path", "before"), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark, name: str) -> str:
    """A fresh folder, as a URI, in the place that all executors share."""
    import uuid

    # Spark's own file system and scheme for the path, so that the files lie where staged tables do
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/rasterloom-{name}-{uuid.uuid4().hex}")
    return arrow_uri(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString())


def arrow_uri(path: str) -> str:
    """A Hadoop path as pyarrow names it: s3 in place of s3a and s3n, file with an empty host. pyarrow writes to
    local and mounted disks, hdfs, s3, gs and abfss; a store of another kind must be mounted."""
    scheme, _, rest = path.partition(":")
    rest = "//" + rest if not rest.startswith("//") else rest
    return f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}:{rest}"


def token_digest(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """Write the files of ``docs`` to a fresh shared folder and read them back."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, vocab), folder)
