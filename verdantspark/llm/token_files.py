"""Token ids in Arrow stream files of fixed-size-list batches, written and read back in document order."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, documents, shared_dir, slices
from .tokens import WordEncoder

#: Ids of a sequence; a multiple of 8, as masks are packed bits.
SEQUENCE = 2048
#: Sequences of a record batch.
BATCH = 256

MANIFEST = "part int, path string, n_docs long, n_tokens long"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def filesystem(uri: str):
    """Arrow's file system for a URI or a plain path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


class SequenceWriter:
    """Writes a stream of ids as rows of `ids` (fixed-size list) and `mask` (fixed-size list of packed bits, lowest first)."""

    def __init__(self, uri: str, dtype: np.dtype, length: int = SEQUENCE) -> None:
        self.fs, path = filesystem(uri)
        self.length, self.dtype, self.held, self.n = length, dtype, [], 0
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.uint8(), length // 8))])
        self.sink = self.fs.open_output_stream(path)
        self.out = pa.ipc.new_stream(self.sink, self.schema)

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.length * BATCH * self.dtype.itemsize:
            self.flush(False)

    def flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.held), self.dtype)
        rows = -(-len(flat) // self.length) if last else len(flat) // self.length
        now, later = flat[: rows * self.length], flat[rows * self.length :]
        mask = np.ones(rows * self.length, bool)
        if len(now) < len(mask):
            mask[len(now) :] = False
            now = np.concatenate([now, np.zeros(len(mask) - len(now), self.dtype)])
        if rows:
            bits = np.packbits(mask, bitorder="little")
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), k) for v, k in ((now, self.length), (bits, self.length // 8))]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.held, self.n = ([later.tobytes()], later.nbytes) if len(later) else ([], 0)

    def close(self) -> None:
        self.flush(True)
        self.out.close()
        self.sink.close()


class SequenceFile:
    """A file of SequenceWriter, mapped where it is local: sequence i's ids and mask bits are views of the file."""

    def __init__(self, uri: str) -> None:
        fs, path = filesystem(uri)
        self.source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        self.batches = list(pa.ipc.open_stream(self.source))
        self.first = np.concatenate([[0], np.cumsum([b.num_rows for b in self.batches])]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.first[-1])

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        b = int(np.searchsorted(self.first, i, side="right")) - 1
        batch, k = self.batches[b], i - int(self.first[b])
        ids, mask = batch.column(0), batch.column(1)
        n, m = ids.type.list_size, mask.type.list_size
        return ids.values.to_numpy(zero_copy_only=True)[(ids.offset + k) * n :][:n], mask.values.to_numpy(zero_copy_only=True)[(mask.offset + k) * m :][:m]

    def streams(self) -> Iterator[np.ndarray]:
        """The masked-in ids, batch by batch."""
        for batch in self.batches:
            ids, mask = (batch.column(c).flatten().to_numpy(zero_copy_only=True) for c in (0, 1))
            keep = np.unpackbits(mask, bitorder="little").astype(bool)
            yield ids if keep.all() else ids[keep]


INDEX = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, length: int = SEQUENCE) -> DataFrame:
    """Encode all texts in ascending doc_id order into Arrow stream files in `folder`; returns the manifest.

    A range partition by doc_id makes one file part-*.arrows of ids and masks and one part-*.index of (doc_id, n_tokens).
    A file's name is its attempt's own; the manifest, written by Spark, names those of the attempts that succeeded. Null or
    empty texts are their end id; a null doc_id comes first; rows with one doc_id follow in the order of their texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = WordEncoder.of(tokenizer)
        end = np.asarray([end_id], encoder.dtype).tobytes()
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        out, index, n_docs, n_tokens = None, None, 0, 0
        for batch in batches:
            for rows in slices(batch):
                if out is None:
                    out = SequenceWriter(f"{path}.arrows", encoder.dtype, length)
                    fs, p = filesystem(f"{path}.index")
                    sink = fs.open_output_stream(p)
                    index = pa.ipc.new_stream(sink, INDEX)
                lens = []
                for ids in encoder.encode(rows.column("text").to_pylist()):
                    out.add(ids + end)
                    lens.append(len(ids) // encoder.dtype.itemsize + 1)
                index.write_batch(pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(lens, pa.int64())], schema=INDEX))
                n_docs, n_tokens = n_docs + len(lens), n_tokens + sum(lens)
        if out is not None:
            out.close()
            index.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    fs, p = filesystem(folder)
    fs.create_dir(p, recursive=True)
    ordered = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(run, MANIFEST), "token-manifest", narrow=True)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32.

    Files are read where their manifest row goes. The offsets of files come from a running sum over the manifest, which
    has one row per file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, p = filesystem(f"{row['path']}.index")
                with fs.open_input_stream(p) as source:
                    index = pa.ipc.open_stream(source).read_all()
                lens = index["n_tokens"].to_numpy()
                crcs = np.zeros(len(lens), np.int64)
                data = SequenceFile(f"{row['path']}.arrows")
                k, need, crc = 0, int(lens[0]), 0
                for ids in data.streams():
                    at = 0
                    while at < len(ids):
                        take = min(need, len(ids) - at)
                        crc = zlib.crc32(ids[at : at + take].astype("<u4").tobytes(), crc)
                        at, need = at + take, need - take
                        if not need:
                            crcs[k] = crc
                            k += 1
                            need, crc = (int(lens[k]) if k < len(lens) else 0), 0
                if k != len(lens) or need:
                    raise ValueError(f"{row['path']}: the index and the ids differ")
                yield pa.RecordBatch.from_arrays([index["doc_id"].combine_chunks(), pa.array(np.cumsum(lens) - lens + row["base"]), pa.array(lens), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    return manifest.select("part", "path", base).repartition(n, "part").mapInArrow(run, DIGEST)


def token_file_digest(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write the files, by default into the shared folder, and read them back."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, tokenizer, folder))
