"""What the training-data operators share: the shared folder, written tables, word hashes, column guards."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
#: Texts are hashed in slices of about so many bytes; a longer document is a slice of its own.
SLICE = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset on a local master, an own one."""
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them again: lineage ends there, and a lost executor costs no recomputation.

    An empty table keeps its schema. Spark deletes the shuffle files behind the rows once the driver's JVM has collected what refers to them; asking
    for that here keeps them from piling up over the steps of an operator."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a stash that nothing reads any more."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n + 1 offsets into them; null counts as empty."""
    col = (col.fill_null("") if col.null_count else col).cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of texts, A-Z lower-cased, with numpy alone.

    A word's hash is a polynomial of its bytes modulo 2^64, taken as a difference of prefix sums and mixed."""

    def __init__(self) -> None:
        self.n = 0

    def _tables(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, SLICE)
            with np.errstate(over="ignore"):
                self.up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(self.n, _P, np.uint64)]))
                self.down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(self.n, _P_INV, np.uint64)]))

    def __call__(self, col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For slices of the column: index of the first text, word hashes, and offsets of each text's words in them."""
        data, off = string_bytes(col)
        i = 0
        while i < len(off) - 1:
            j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE, "right")) - 1)
            j = min(j, len(off) - 1)
            yield (i, *self.words(data[off[i] : off[j]], off[i : j + 1] - off[i]))
            i = j
        if len(off) - 1 > 0 and self.n > 8 * SLICE:
            self.n = 0
            del self.up, self.down

    def words(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
        self._tables(n)
        space = SPACE[data]
        cut = np.zeros(n + 1, bool)
        cut[off] = True
        before, after = cut[:-1].copy(), cut[1:].copy()
        before[1:] |= space[:-1]
        after[:-1] |= space[1:]
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
            h = mix((sums[ends] - sums[starts]) * self.down[starts])
        return h, np.searchsorted(starts, off)


def combine(*parts: np.ndarray) -> np.ndarray:
    """One hash of a sequence of hashes; the order counts."""
    with np.errstate(over="ignore"):
        h = mix(parts[0] + np.uint64(len(parts)))
        for p in parts[1:]:
            h = mix(h * np.uint64(_P) + p)
    return h


def crc_remainder(column: str, n: int):
    """crc32 of an id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % F.lit(n)


#: What a worker keeps for its next tasks, by name, and how to let go of it.
KEPT: dict[str, Callable[[], None]] = {}


def keep_only(name: str) -> None:
    for other, drop in KEPT.items():
        if other != name:
            drop()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same for mapInArrow, after which a worker gives back the memory that it holds for reuse: workers outlive their tasks. What tasks of
    another kind have left behind, but for `keeps`, goes before."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(keeps)
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns, whatever their names, can't clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def unused(name: str, columns: list[str]) -> str:
    """The name, with as many underscores before it as keep it apart from the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
