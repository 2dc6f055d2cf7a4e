"""Helpers that the training-data operators share.

Everything here works on Arrow buffers or on the session: tokenising whole
batches with Arrow's C++ kernels, hashing, tables kept in the folder that all
executors share, and access to that folder through ``pyarrow.fs``.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUB_BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a new temporary one only where it is unset and all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="framelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{uuid.uuid4().hex}-{name}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/framelake/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application stored; results that are still to be read among them."""
    _delete(spark, _own_dir(spark))


def small_batches(spark: SparkSession, most: int = 4 * SUB_BATCH_BYTES) -> None:
    """Lowers the session's Arrow batches to ``most`` bytes: at the default of 64 MB, rows of long texts fill that much in the JVM and in Python, in every task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > most:
        spark.conf.set(name, str(most))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends here and file sizes are known to the optimizer."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._framelake_path = path
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return out


_SCRATCH: list[list[str]] = []


class scratch:
    """On leaving the block, deletes the tables stored in it, but for those that ``keep`` was given: what is still to be read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, set()

    def __enter__(self) -> scratch:
        _SCRATCH.append([])
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df._framelake_path)
        return df

    def __exit__(self, *error) -> None:
        for path in _SCRATCH.pop():
            if path not in self.kept:
                _delete(self.spark, path)
            elif _SCRATCH:
                _SCRATCH[-1].append(path)
        release(self.spark)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for df in tables:
        path = getattr(df, "_framelake_path", None)
        if path:
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Asks the driver's JVM for a collection, after which the context cleaner removes shuffle files of finished steps."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


HOT_ROWS, HOT_KEYS = 10_000, 50_000


def with_counts(rows: DataFrame, counts: DataFrame, *key: str) -> DataFrame:
    """rows joined with their key's row of the stored table ``counts``, which has the number of such rows as ``counts``.

    Keys with over ``HOT_ROWS`` rows and over 1 / ``HOT_KEYS`` of all are at most
    ``HOT_KEYS``; their counts are broadcast, so that the rows of a hot key never
    meet in one task. All others go through an equi-join.
    """
    hot = F.col("counts") > max(HOT_ROWS, (counts.agg(F.sum("counts")).first()[0] or 0) // HOT_KEYS)
    looked = rows.join(F.broadcast(counts.where(hot)), list(key), "left")
    cold = looked.where("counts IS NULL").drop(*(c for c in counts.columns if c not in key))
    return looked.where("counts IS NOT NULL").unionByName(cold.join(counts.where(~hot), list(key)))


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI, for executors that write or read plain files in the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def cut(batches: Iterator[pa.RecordBatch], column: str, most: int = SUB_BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose values of ``column`` have about ``most`` bytes together; one long value is a slice of its own.

    At the end of a partition the worker, which waits for the next task, gives free memory back.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def texts_of(column: pa.Array) -> pa.StringArray:
    """The column as a string array without nulls (null: empty) that starts at offset 0 of its buffer."""
    column = pc.fill_null(column.cast(pa.string()), "")
    return pa.concat_arrays([column, pa.array([], pa.string())]) if column.offset else column


def raw(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; offsets start at 0."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def translated(column: pa.StringArray, table: bytes) -> pa.BinaryArray:
    """The texts with each byte replaced by table; made on the whole buffer at once."""
    data, offsets = raw(column)
    moved = data.tobytes().translate(table)
    return pa.BinaryArray.from_buffers(pa.string(), len(column), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(moved)])


class Words:
    """The ASCII-white-space separated words of each text: ``codes[offsets[i]:offsets[i + 1]]`` index ``vocabulary``."""

    def __init__(self, column: pa.StringArray):
        lists = pc.ascii_split_whitespace(column)
        flat = lists.values.dictionary_encode()
        codes = flat.indices.to_numpy(zero_copy_only=False)
        ends = lists.offsets.to_numpy()
        self.dictionary: pa.BinaryArray = flat.dictionary.cast(pa.binary())
        empty = pc.index(self.dictionary, pa.scalar(b"", pa.binary())).as_py()
        if empty >= 0:
            real = codes != empty
            ends = np.concatenate([[0], np.cumsum(real)])[ends]
            codes = codes[real]
        self.codes, self.offsets = codes, ends.astype(np.int64)

    @cached_property
    def vocabulary(self) -> list[bytes]:
        return self.dictionary.to_pylist()

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owner(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1, dtype=np.int64), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.dictionary):
            return np.zeros(0, np.uint64)
        return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.vocabulary), np.uint64, len(self.vocabulary))[self.codes]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def windows_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` consecutive values; the result is width - 1 shorter."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k : k + n]
        out ^= out >> np.uint64(29)
    return mixed(out)


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
"""Lower-cases A-Z and leaves all other bytes alone."""
