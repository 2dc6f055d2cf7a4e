"""TIFF and NPY files as a Spark data source whose partitions are runs of pages.

A partition seeks to its pages and reads nothing else, so files may be larger than
a task's memory. Filters on t and rec_id are pushed down: they spare whole files,
runs and, inside a run, pages. The places of pages are found when the query is
planned, by a few threads: one small read for each directory of a TIFF file, one
for an NPY file's header.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import formats

FRAMES = "rec_id string, t bigint, h int, w int, c int, dtype string, data array<double>"
KINDS = ("tiff", "npy")
RUN_BYTES, BATCH_BYTES = 64 << 20, 16 << 20  # of frames as rows


def _opened(path: str):
    files, where = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
    return files.open_input_file(where)


def reachable(path: str) -> bool:
    """Whether ranges of the file can be read: arrays in bundles or in column order, and unknown stores, are read as a whole."""
    if path.lower().endswith(".npz"):
        return False
    try:
        with _opened(path) as file:
            return not path.lower().endswith(".npy") or not _npy_header(file)[1]
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def frame_batch(rec_id: str, first: int, stack: np.ndarray) -> pa.RecordBatch:
    """Consecutive frames of a recording as rows."""
    n, h, w, c = stack.shape
    lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (h * w * c), stack.reshape(-1).astype(float))
    fixed = [pa.array([v] * n, pa.int32()) for v in (h, w, c)]
    return pa.RecordBatch.from_arrays([pa.array([rec_id] * n), pa.array(range(first, first + n), pa.int64()), *fixed, pa.array([str(stack.dtype)] * n), lists], ["rec_id", "t", "h", "w", "c", "dtype", "data"])


def _npy_header(file) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    version = np.lib.format.read_magic(file)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, columns_first, dtype = read(file)
    return shape, columns_first and len(shape) > 1, dtype, file.tell()


def _npy_shape(shape: tuple[int, ...]) -> tuple[int, int, int, int]:
    """As of (t, h, w, c): three axes are (h, w, c) if the last has at most four, else (t, h, w)."""
    if len(shape) not in (2, 3, 4):
        raise ValueError("a recording has two to four axes")
    if len(shape) == 4:
        return shape
    if len(shape) == 3:
        return (1, *shape) if shape[-1] <= 4 else (*shape, 1)
    return (1, *shape, 1)


@dataclass
class Run(InputPartition):
    """Pages of a file from ``first`` on; places are those of a TIFF file's directories, or one byte offset for each page."""

    path: str
    first: int
    places: list = field(default_factory=list)

    def __post_init__(self):
        super().__init__(self.first)


class PageReader(DataSourceReader):
    def __init__(self, paths: list[str], kind: str, run_bytes: int):
        self.paths, self.kind, self.run_bytes = paths, kind, run_bytes
        self.low, self.high, self.only, self.names = 0, 1 << 62, None, None

    def pushFilters(self, filters):  # noqa: N802
        """Notes bounds of t and values of rec_id; Spark applies all filters again."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("t",):
                if isinstance(f, EqualTo | In):
                    given = {value} if isinstance(f, EqualTo) else set(value)
                    self.only = given if self.only is None else self.only & given
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                elif isinstance(f, LessThan | LessThanOrEqual):
                    self.high = min(self.high, value + isinstance(f, LessThanOrEqual))
            elif getattr(f, "attribute", None) == ("rec_id",) and isinstance(f, EqualTo | In):
                given = {value} if isinstance(f, EqualTo) else set(value)
                self.names = given if self.names is None else self.names & given
            yield f

    def wanted(self, t: int) -> bool:
        return self.low <= t < self.high and (self.only is None or t in self.only)

    def runs(self, path: str) -> list[Run]:
        if self.names is not None and os.path.basename(path) not in self.names:
            return []
        with _opened(path) as file:
            if self.kind == "tiff":
                tiff = formats.TiffFile(file)
                places = tiff.places()
                values = int(np.prod(tiff.shape(places[0]))) if places else 1
            else:
                shape, _, dtype, start = _npy_header(file)
                n, *page = _npy_shape(shape)
                values = int(np.prod(page))
                places = range(start, start + n * values * dtype.itemsize, max(1, values * dtype.itemsize))
        step = max(1, self.run_bytes // (8 * max(1, values)))
        found = [Run(path, a, places[a : a + step]) for a in range(0, len(places), step)]
        return [r for r in found if any(self.wanted(t) for t in range(r.first, r.first + len(r.places)))]

    def partitions(self):
        with ThreadPoolExecutor(16) as pool:
            found = [run for runs in pool.map(self.runs, self.paths) for run in runs]
        return found or [Run("", 0)]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        if not run.places:
            return
        with _opened(run.path) as file:
            if self.kind == "tiff":
                page, shape = formats.TiffFile(file).page, None
            else:
                shape, _, dtype, _ = _npy_header(file)
                shape = _npy_shape(shape)[1:]

                def page(at):
                    file.seek(at)
                    data = np.frombuffer(file.read(int(np.prod(shape)) * dtype.itemsize), dtype)
                    return data.reshape(shape).astype(dtype.newbyteorder("="))

            held, first = [], run.first
            for t, place in enumerate(run.places, run.first):
                if self.wanted(t):
                    if not held:
                        first = t
                    frame = page(place)
                    if shape is not None and frame.shape != tuple(shape):
                        raise ValueError("the pages of a stack have one shape")
                    shape = frame.shape
                    held.append(frame)
                if held and (not self.wanted(t) or len(held) * held[0].size * 8 >= BATCH_BYTES):
                    yield frame_batch(os.path.basename(run.path), first, np.stack(held))
                    held = []
            if held:
                yield frame_batch(os.path.basename(run.path), first, np.stack(held))


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framelake_pages"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> PageReader:
        return PageReader(json.loads(self.options["files"]), self.options["kind"], int(self.options["run_bytes"]))


def read_pages(spark: SparkSession, paths: list[str], kind: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Frames of the files, each a recording named by its file name."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
    return spark.read.format("framelake_pages").options(files=json.dumps(paths), kind=kind, run_bytes=run_bytes).load()
