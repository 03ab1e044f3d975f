"""Token ids as flat binary files that are read by memory map.

A shard is two files: `N.bin`, unsigned little-endian ids of its documents one
after the other, and `N.idx`, all 64-bit: the number n of documents, n + 1
offsets into the ids, n document ids, n flags (1: the id is null). Shards hold
ascending ranges of doc_id (null ids first, repeated ids by text); the manifest
has one row per shard with its base, the prefix sum of the tokens before it.

A shard is written under a name of its own and then renamed, so a repeated task
replaces it by the same bytes. Defined results: null text counts as empty; each
document ends with `end_id`, so an empty text is that id alone; an empty table
gives an empty manifest.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import checkpoint_root, text_or_empty
from tracewright.llm.tokens import TextEncoder, arrow_slices


def _files(folder: str):
    """The file system of a folder's URI and the folder's path in it."""
    from pyarrow import fs
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    uri = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    return fs.FileSystem.from_uri(uri)


def _shard_writer(folder: str, vocab_path: str, end_id: int, dtype: str, as_loaded: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId()
        store, base = _files(folder)
        encode, end = TextEncoder(vocab_path, dtype, as_loaded), np.array([end_id], dtype).tobytes()
        ids, nulls, lengths, out, own = [], [], [], None, f"{base}/.{shard}-{uuid.uuid4().hex}"
        width = np.dtype(dtype).itemsize
        for batch in batches:
            texts, keys = batch.column(1), batch.column(0)
            ids.append(keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            nulls.append(keys.is_null().to_numpy(zero_copy_only=False))
            if len(texts) and out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(own + ".bin")
            for a, b in arrow_slices(texts):
                made = encode(texts.slice(a, b - a))
                lengths.extend(len(x) // width + 1 for x in made)
                out.write(end.join(made) + end)
        if out is None:
            return
        out.close()
        n = len(lengths)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        with store.open_output_stream(own + ".idx") as index:
            index.write(np.concatenate([[n], offsets, *ids, *nulls]).astype("<i8").tobytes())
        for kind in (".bin", ".idx"):
            store.move(own + kind, f"{base}/{shard}{kind}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "n_docs": pa.array([n], pa.int64()), "n_tokens": pa.array([int(offsets[-1])], pa.int64())})
    return write


def write_tokens(docs: DataFrame, vocab_path: str, end_id: int, folder: str | None = None, dtype: str = "<u2",
                 as_loaded: bool = False) -> tuple[str, DataFrame]:
    """Write doc_id, text as shards below `folder`; the folder and the manifest (shard, n_docs, n_tokens, base). as_loaded: see TextEncoder."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_root(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = sorted(map(tuple, rows.mapInArrow(_shard_writer(folder, vocab_path, end_id, dtype, as_loaded), "shard long, n_docs long, n_tokens long").collect()))
    bases = np.concatenate([[0], np.cumsum([s[2] for s in shards])]).astype(int).tolist()
    manifest = spark.createDataFrame([(*s, b) for s, b in zip(shards, bases)], "shard long, n_docs long, n_tokens long, base long")
    return folder, manifest


def _mapped(store, path: str, dtype: str) -> np.ndarray:
    """A file as an array: mapped where it is local, else read."""
    from pyarrow import fs
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if store.get_file_info(path).size else np.empty(0, dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_shard(folder: str, shard: int, dtype: str = "<u2") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, offsets, document ids and null flags of a shard; the ids are mapped, not loaded."""
    store, base = _files(folder)
    index = np.asarray(_mapped(store, f"{base}/{shard}.idx", "<i8"))
    n = int(index[0])
    return _mapped(store, f"{base}/{shard}.bin", dtype), index[1:n + 2], index[n + 2:2 * n + 2], index[2 * n + 2:].astype(bool)


def read_tokens(folder: str, manifest: DataFrame, dtype: str = "<u2") -> DataFrame:
    """From the files: doc_id, start (tokens of all documents before), n_tokens, ids (binary, unsigned 32-bit little-endian)."""
    def read(batches):
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens, offsets, ids, nulls = read_shard(folder, shard, dtype)
                for a in range(0, len(ids), 1000):
                    b = min(a + 1000, len(ids))
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(ids[a:b], pa.int64(), mask=nulls[a:b]), "start": pa.array(base + offsets[a:b], pa.int64()),
                        "n_tokens": pa.array(np.diff(offsets[a:b + 1]), pa.int64()),
                        "ids": pa.array([tokens[x:y].astype("<u4").tobytes() for x, y in zip(offsets[a:b], offsets[a + 1:b + 1])], pa.binary())})
    parts = manifest.select("shard", "base").repartition(max(1, manifest.count()))
    return parts.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def crc32_of(binary: str):
    """Unsigned CRC-32 of a binary column, by Spark's own function."""
    return F.crc32(F.col(binary))
