"""Token ids in flat binary files.

A set of files holds one part for each range of document ids:

* `ids-*`: the ids of the part's documents one after another, unsigned little-endian, without any header; 16 bits each where the
  vocabulary's ids and the end id fit in them, else 32;
* `off-*`: n + 1 unsigned 64-bit offsets, in ids; document i of the part is ids[off[i]:off[i + 1]];
* `doc-*`: the n document ids (-2^63 stands for null), signed 64-bit, ascending over the part and over the parts in order.

The manifest has a row for each part with its counts and the bytes of an id; a part's base, the ids before it in the whole set, is a prefix
sum over the manifest. Files are memory-mapped where the folder is mounted, else read through pyarrow's file systems.

Cases: a null or empty text has only the end id. Documents with a null id come first, repeated ids stay next to each other,
ordered by a hash of the text. Every attempt of a task writes files of its own, and the manifest names those of the
attempt that Spark committed, so a lost executor leaves unnamed files behind but no wrong ones. An empty table gives no part."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEPT, require, scratch, stash
from .tokens import UnitEncoder

NULL_ID = -(1 << 63)
_encoders: dict[tuple[str, bool], UnitEncoder] = {}
KEPT["tokens"] = _encoders.clear


def encoder(name: str, spaces: bool) -> UnitEncoder:
    """One for each worker process, so that its cache outlives a task."""
    if (name, spaces) not in _encoders:
        _encoders[name, spaces] = UnitEncoder(name, spaces)
    return _encoders[name, spaces]


def _fs(folder: str):
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


def _mapped(system, path: str, dtype: str) -> np.ndarray:
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if system.get_file_info(path).size else np.zeros(0, dtype)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, spaces: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode every whole text, append end_id, write the files; returns the manifest: part, name, n_docs, n_tokens."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        system, root = _fs(folder)
        system.create_dir(root, recursive=True)
        name, end = f"{part:06d}-{uuid.uuid4().hex}", np.array([end_id], "<u4").tobytes()
        n_docs = n_tokens = width = 0
        enc, files = None, []
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if enc is None:
                    enc = encoder(tokenizer, spaces)
                    width = 2 if max(enc.largest, end_id) < 1 << 16 else 4
                    files = [system.open_output_stream(f"{root}/{kind}-{name}") for kind in ("ids", "off", "doc")]
                    files[1].write(np.zeros(1, "<u8").tobytes())
                sizes = []
                for ids in enc.ids(x.as_py() for x in batch.column(1)):
                    files[0].write(np.frombuffer(ids + end, "<u4").astype(f"<u{width}").tobytes())
                    sizes.append(len(ids) // 4 + 1)
                offsets = n_tokens + np.cumsum(sizes)
                files[1].write(offsets.astype("<u8").tobytes())
                files[2].write(batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_docs, n_tokens = n_docs + len(sizes), int(offsets[-1])
        finally:
            for f in files:
                f.close()
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64()), "width": pa.array([width], pa.int32())})

    rows = require(docs, doc_id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    return stash(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, "part int, name string, n_docs long, n_tokens long, width int"), "token-manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, from the files."""
    parts = manifest.orderBy("part").collect()  # a row for each part
    bases = np.cumsum([0, *(p.n_tokens for p in parts)]).tolist()
    rows = [(p.name, base, p.n_docs, p.width) for p, base in zip(parts, bases, strict=False)]
    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], out)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _fs(folder)
        for batch in batches:
            for name, base, n, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, off, doc = (_mapped(system, f"{root}/{kind}-{name}", dtype) for kind, dtype in (("ids", f"<u{width}"), ("off", "<u8"), ("doc", "<i8")))
                off = off.astype(np.int64)
                assert len(off) == n + 1 and off[-1] == len(ids), f"{name} is not whole"
                for i in range(0, n, 4096):
                    at = off[i : i + 4097]
                    crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    docs = np.asarray(doc[i : i + 4096])
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64(), mask=docs == NULL_ID), "start": pa.array(at[:-1] + base, pa.int64()), "n_tokens": pa.array(np.diff(at), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return spark.createDataFrame(rows, "name string, base long, n long, width int").repartition(len(rows)).mapInArrow(read, out)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "token-files")
    return read_token_files(spark, folder, write_token_files(docs, folder))
