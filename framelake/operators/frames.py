"""Frames as rows, and the two ways to work on them.

``frames`` has one row per frame: rec_id, t, h, w, c and the interleaved values.
Iterative and stencil operators run as ``map_stacks``: each Arrow batch becomes
one stack of frames per shape and goes through a vectorised kernel; nothing is
shuffled, and a frame crosses between JVM and Python once. Relational operators
work on the frame rows themselves or, where they are about single pixels, on
``pixels``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME_COLUMNS = ("rec_id", "t", "h", "w", "c", "data")
MOST_REFERENCE_BYTES = 256 << 20
WORK_BYTES, WORK_COPIES = 64 << 20, 72  # what one call of a kernel may take, and how many times a frame's bytes it takes (72 were measured for the solver, 76 graduated)


def frames(df: DataFrame, data: Column, h: int, w: int, c: int = 1, t: Column | str = "t", rec_id: Column | None = None) -> DataFrame:
    """Rows of a table as frames of a fixed shape."""
    return df.select(
        (F.lit("0") if rec_id is None else rec_id.cast("string")).alias("rec_id"), (F.col(t) if isinstance(t, str) else t).cast("long").alias("t"),
        F.lit(h).alias("h"), F.lit(w).alias("w"), F.lit(c).alias("c"), data.cast("array<double>").alias("data"),
    )


def pixels(df: DataFrame, data: str = "data", value: str = "val") -> DataFrame:
    """One row per value: rec_id, t, y, x, ch."""
    rows = df.select("rec_id", "t", "w", "c", F.posexplode(data).alias("i", value))
    at = F.col("i").cast("long")
    return rows.select("rec_id", "t", F.floor(at / (F.col("w") * F.col("c"))).alias("y"), (F.floor(at / F.col("c")) % F.col("w")).alias("x"), (at % F.col("c")).alias("ch"), value)


def map_stacks(df: DataFrame, kernel: Callable[..., dict], outputs: dict[str, str], inputs: tuple[str, ...] = ("data",), keep: tuple[str, ...] = ("rec_id", "t", "h", "w", "c"), work: Callable[[int, int, int], int] | None = None) -> DataFrame:
    """Applies ``kernel(stack, ...)`` to the frames of each batch, by shape.

    The kernel gets a (n, h, w, c) array for each input column and returns for
    each output an array of n rows; outputs of type ``array<...>`` are flattened.
    ``work(h, w, c)`` is what the kernel takes for a frame, in bytes, if that is not
    ``WORK_COPIES`` times the frame: a call gets as many frames as ``WORK_BYTES``
    allow, at least one. So a frame's result may not depend on the others.
    """
    columns = list(dict.fromkeys([*keep, "h", "w", "c"]))
    kept = df.select(*keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [f"`{n}` {t}" for n, t in outputs.items()])

    def solved(part: pa.RecordBatch, shape: np.ndarray) -> pa.RecordBatch:
        stacks = [part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, *shape) for c in inputs]
        found = kernel(*stacks)
        arrays = [part.column(k) for k in keep]
        for name, kind in outputs.items():
            value = np.asarray(found[name])
            if kind.startswith("array"):
                flat = value.reshape(part.num_rows, -1)
                item = {"array<double>": pa.float64(), "array<float>": pa.float32(), "array<boolean>": pa.bool_(), "array<bigint>": pa.int64()}[kind]
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * flat.shape[1])
                arrays.append(pa.ListArray.from_arrays(ends, pa.array(flat.ravel()).cast(item)))
            else:
                arrays.append(pa.array(value).cast({"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}[kind]))
        return pa.RecordBatch.from_arrays(arrays, [*keep, *outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            shapes = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in ("h", "w", "c")], 1)
            for shape in np.unique(shapes, axis=0):
                whole = batch.filter(pa.array((shapes == shape).all(1)))
                taken = work(*shape.tolist()) if work else WORK_COPIES * 8 * int(shape.prod())
                step = max(1, WORK_BYTES // max(1, taken))
                for a in range(0, whole.num_rows, step):
                    yield solved(whole.slice(a, step), shape)

    return df.select(*columns, *inputs).mapInArrow(run, schema)


def map_frames(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], size: tuple[int, int] = (0, 0)) -> DataFrame:
    """Frames to frames of possibly another size; ``size`` is the new one where it may be much larger."""

    def sized(stack):
        out = np.asarray(kernel(stack), float)
        n = len(out)
        return {"h2": np.full(n, out.shape[1]), "w2": np.full(n, out.shape[2]), "c2": np.full(n, out.shape[3]), "out": out}

    work = lambda h, w, c: 8 * c * max(WORK_COPIES * h * w, 8 * max(h, size[0]) * max(w, size[1]))
    rows = map_stacks(df, sized, {"h2": "int", "w2": "int", "c2": "int", "out": "array<double>"}, keep=("rec_id", "t"), work=work)
    return rows.select("rec_id", "t", F.col("h2").alias("h"), F.col("w2").alias("w"), F.col("c2").alias("c"), F.col("out").alias("data"))


def one_frame(df: DataFrame) -> np.ndarray:
    """A single-row frame table as an (h, w, c) array on the driver; refuses more than one row or a frame beyond 256 MiB."""
    rows = df.select("h", "w", "c", F.when(F.size("data") * 8 <= MOST_REFERENCE_BYTES, F.col("data")).alias("data")).limit(2).collect()
    if len(rows) != 1 or rows[0]["data"] is None:
        raise ValueError("a reference is exactly one frame of at most 256 MiB")
    r = rows[0]
    return np.array(r["data"], float).reshape(r["h"], r["w"], r["c"])


def one_volume(df: DataFrame) -> np.ndarray:
    """The slices of one volume in order of t, (z, h, w, c), on the driver; refuses more than 256 MiB."""
    size = df.agg(F.sum(F.size("data"))).first()[0] or 0
    if not 0 < size * 8 <= MOST_REFERENCE_BYTES:
        raise ValueError("a volume has at least one slice and at most 256 MiB")
    rows = df.orderBy("t").collect()
    return np.stack([np.array(r["data"], float).reshape(r["h"], r["w"], r["c"]) for r in rows])
