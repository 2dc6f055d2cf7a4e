"""Recordings from files and into files.

TIFF and NPY files are read in runs of pages (``pages``), where a filter on t or
rec_id spares what it excludes. Other files, and stores that only Spark can open, are
read with Spark's ``binaryFile`` source: each file is one task's row and becomes frames
there. Parquet is the native format: it keeps frame rows, prunes columns and skips row
groups by t. Sinks
that are single files per recording stream the recording's sorted frames through
one task with one frame in memory.
"""

from __future__ import annotations

import importlib.util
import io
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sequence as sq
from . import formats, pages

READERS = {"tif": "tiff", "tiff": "tiff", "npy": "npy", "npz": "npy", "mat": "mat", "h5": "hdf5", "hdf5": "hdf5", "hdf": "hdf5", "parquet": "parquet", "mdf": "mdf"}
WRITERS = ("TIFF", "SUITE2P_TIFF", "MAT", "HDF5", "MULTIFILE_TIFF", "MULTIFILE_MAT", "MULTIFILE_HDF5", "CAIMAN_HDF5", "BEGONIA", "ARRAY", "NULL", "PARQUET", "NPY")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the folder of ``spark.checkpoint.dir`` and reads it back; a local session without that setting gets a temporary folder."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="framelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/framelake/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stacked(array: np.ndarray) -> np.ndarray:
    """An array as (t, h, w, c): three axes are (h, w, c) if the last has at most four, else (t, h, w)."""
    if array.ndim == 2:
        return array[None, :, :, None]
    if array.ndim == 3:
        return array[None] if array.shape[-1] <= 4 else array[..., None]
    if array.ndim == 4:
        return array
    raise ValueError("a recording has two to four axes")


def from_array(spark: SparkSession, array: np.ndarray, rec_id: str = "0") -> DataFrame:
    """An in-memory recording as frames."""
    stack = stacked(np.asarray(array))
    n, h, w, c = stack.shape
    table = pa.table({
        "rec_id": [rec_id] * n, "t": pa.array(range(n), pa.int64()), **{k: pa.array([v] * n, pa.int32()) for k, v in (("h", h), ("w", w), ("c", c))},
        "dtype": [str(stack.dtype)] * n, "data": pa.array(list(stack.reshape(n, -1).astype(float)), pa.list_(pa.float64())),
    })
    return spark.createDataFrame(table)


def to_array(frames: DataFrame) -> np.ndarray:
    """All frames of one recording on the driver, (t, h, w, c), in their own type."""
    rows = frames.orderBy("t").toArrow()
    shape = [rows.column(k)[0].as_py() for k in ("h", "w", "c")]
    out = np.stack(rows.column("data").combine_chunks().to_numpy(zero_copy_only=False)).reshape(len(rows), *shape)
    return out.astype(rows.column("dtype")[0].as_py()) if "dtype" in rows.schema.names else out


def read_frames(spark: SparkSession, source, fmt: str | None = None, bin_size: int = 1, channels: int = 1, datasets: list[str] | None = None) -> DataFrame:
    """Frames of a path (or glob), a list of paths (one per channel) or an array.

    ``channels`` joins that many consecutive pages into a frame; ``bin_size``
    averages frames as batch reading does. Every file is a recording, named by its
    file name.
    """
    if isinstance(source, DataFrame):
        frames = source
    elif isinstance(source, np.ndarray):
        frames = from_array(spark, source)
    elif isinstance(source, list | tuple):
        parts = [read_frames(spark, p, fmt).withColumn("rec_id", F.lit("0")) for p in source]
        frames = sq.zipped_channels(parts).withColumn("dtype", F.lit("float64"))
    else:
        kind = fmt or READERS.get(source.rstrip("/").rpartition(".")[2].lower())
        if kind is None:
            raise ValueError(f"no reader for {source}")
        if kind == "mdf":
            raise NotImplementedError("MDF files need a vendor library of another system")
        if kind == "hdf5" and not importlib.util.find_spec("h5py"):
            raise ImportError("HDF5 files need h5py")
        frames = spark.read.parquet(source) if kind == "parquet" else _files(spark, source, kind, datasets)
    if channels > 1:
        frames = sq.deinterleaved(frames, channels).withColumn("dtype", F.lit("float64"))
    if bin_size > 1:
        frames = sq.binned(frames, bin_size, padded=True).withColumn("dtype", F.lit("float64"))
    return frames


def load(data: bytes, kind: str, datasets: list[str] | None = None) -> np.ndarray:
    """The bytes of a file as (t, h, w, c)."""
    if kind == "tiff":
        return formats.read_tiff(data)
    if kind == "npy":
        return stacked(formats.read_npy(data))
    if kind == "mat":
        arrays = formats.read_mat(data)
        names = datasets or formats.pick_dataset({k: a.shape for k, a in arrays.items()})
        return np.stack([np.moveaxis(arrays[n], 2, 0) for n in names], -1)
    import h5py

    with h5py.File(io.BytesIO(data)) as f:
        found: dict[str, np.ndarray] = {}
        f.visititems(lambda n, d: found.setdefault(n, d[()]) if isinstance(d, h5py.Dataset) and d.ndim in (3, 4) else None)
    names = datasets or formats.pick_dataset({k: a.shape for k, a in found.items()})
    return found[names[0]] if found[names[0]].ndim == 4 else np.stack([found[n] for n in names], -1)


def _files(spark: SparkSession, path: str, kind: str, datasets: list[str] | None) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                stack = load(data.as_py(), kind, datasets)
                for a in range(0, len(stack), 64):
                    yield pages.frame_batch(os.path.basename(name), a, stack[a : a + 64])

    files = spark.read.format("binaryFile").load(path)
    if kind in pages.KINDS:
        names = [r["path"] for r in files.select("path").collect()]  # names alone, no content
        if all(pages.reachable(name) for name in names):
            return pages.read_pages(spark, names, kind)
    return files.select("path", "content").mapInArrow(read, pages.FRAMES)


def write_frames(frames: DataFrame, path: str | None, fmt: str, dtype: str = "float64", deflate: bool = False):
    """Writes every recording; returns (rec_id, path, frames) rows, or an array or counts for the sinks without a file. ``deflate`` packs the pages of TIFF files."""
    fmt = fmt.upper()
    if fmt not in WRITERS:
        raise ValueError(f"unknown format {fmt}; known are {', '.join(WRITERS)}")
    if fmt == "BEGONIA":
        raise NotImplementedError("this format cannot be written")
    if fmt.endswith("HDF5"):
        raise ImportError("HDF5 files need h5py") if not importlib.util.find_spec("h5py") else NotImplementedError("write MAT or TIFF")
    if fmt == "ARRAY":
        return to_array(frames)
    if fmt == "NULL":
        return sq.counted(frames).collect()
    if fmt == "PARQUET":
        frames.repartition("rec_id").sortWithinPartitions("rec_id", "t").write.partitionBy("rec_id").parquet(path)
        return None
    if fmt == "SUITE2P_TIFF":
        frames, fmt = sq.interleaved(frames), "TIFF"
    if fmt.startswith("MULTIFILE"):
        single = frames.withColumn("ch", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        plane = F.filter("data", lambda x, i: i % F.col("c") == F.col("ch"))
        single = single.withColumn("data", plane).withColumn("rec_id", F.concat("rec_id", F.lit("_ch"), F.col("ch") + 1)).withColumn("c", F.lit(1))
        frames, fmt = single, fmt.removeprefix("MULTIFILE_")
    total = sq.counted(frames).select("rec_id", "n_frames")
    rows = frames.join(total, "rec_id").select("rec_id", "t", "h", "w", "c", "data", "n_frames").repartition("rec_id").sortWithinPartitions("rec_id", "t")
    ending = {"TIFF": "tif", "MAT": "mat", "NPY": "npy"}[fmt]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
        files.create_dir(folder, recursive=True)
        now, sink, n, held = None, None, 0, []
        done: list[tuple] = []

        def close():
            if fmt == "TIFF":
                sink[1].close()
            elif fmt == "MAT":
                stack = np.stack(held)
                sink[0].write(formats.write_mat({f"ch{k + 1}": np.moveaxis(stack[..., k], 0, 2) for k in range(stack.shape[-1])}))
            sink[0].close()
            files.move(f"{folder}/.{now}.{ending}.part", f"{folder}/{now}.{ending}")
            done.append((now, f"{path}/{now}.{ending}", n))

        for batch in batches:
            for i, (rec, h, w, c, total) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("rec_id", "h", "w", "c", "n_frames")), strict=True)):
                page = batch.column("data")[i].values.to_numpy(zero_copy_only=False).reshape(h, w, c).astype(dtype)
                if rec != now:
                    if sink:
                        close()
                    now, n, held = rec, 0, []
                    out = files.open_output_stream(f"{folder}/.{rec}.{ending}.part", compression=None)
                    sink = (out, formats.TiffWriter(out, deflate) if fmt == "TIFF" else None)
                    if fmt == "NPY":
                        np.lib.format.write_array_header_2_0(out, {"descr": np.dtype(dtype).str, "fortran_order": False, "shape": (total, h, w, c)})
                n += 1
                if fmt == "TIFF":
                    sink[1].add(page)
                elif fmt == "NPY":
                    sink[0].write(page.tobytes())
                else:
                    held.append(page)
        if sink:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done]), pa.array([d[2] for d in done], pa.int64())], ["rec_id", "path", "frames"])

    return rows.mapInArrow(write, "rec_id string, path string, frames bigint").collect()
