"""Depth alignment: where in a reference volume each pixel of each frame was, correction to one depth, and simulation.

Frames go in batches with a halo of real frames of the adjacent batches, wide
enough for the temporal filters; a batch with its halo is what a task holds. The
volume is one array of at most 256 MiB that travels with the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.columns import RANGES
from ..operators import sequence as sq
from ..operators.frames import MOST_REFERENCE_BYTES, one_volume
from . import registration
from .options import DepthOptions

RESULT = "rec_id string, t bigint, h int, w int, c int, z array<double>, corrected array<double>"


def halo_size(options: DepthOptions) -> int:
    return math.ceil(4 * options.temporal_sigma) + math.ceil(4 * options.smooth_temporal)


def _smooth(stack: np.ndarray, space: float, time: float) -> np.ndarray:
    planes = [K.gaussian(stack[..., c], (space, space)) for c in range(stack.shape[-1])]
    return np.stack([K.convolve(p, K.gaussian_weights(time), 0) if time > 0 else p for p in planes], -1)


def _distance(volume: np.ndarray, stack: np.ndarray, options: DepthOptions) -> np.ndarray:
    return K.gradient_distance(_smooth(volume, options.spatial_sigma, 0), _smooth(stack, options.spatial_sigma, options.temporal_sigma))


def _stored_type(x: np.ndarray, dtype: str) -> np.ndarray:
    if dtype not in RANGES:
        return x
    return np.rint(np.clip(x, *RANGES[dtype]))


def anchor_of(frames: DataFrame, volume: np.ndarray, options: DepthOptions) -> int:
    """The slice that the first batch with its halo fits best, the first of equals; refuses a batch beyond 256 MiB."""
    first = frames.where(F.col("t") < options.input_buffer + halo_size(options))
    recordings, size = first.agg(F.count_distinct("rec_id"), F.sum(F.size("data"))).first()
    if recordings != 1 or size * 8 > MOST_REFERENCE_BYTES:
        raise ValueError("depth is aligned for one recording, with a first batch of at most 256 MiB")
    rows = first.orderBy("t").select("h", "w", "c", "data").collect()
    stack = np.stack([np.array(r["data"], float).reshape(r["h"], r["w"], r["c"]) for r in rows])
    smooth, slices = _smooth(stack, options.spatial_sigma, options.temporal_sigma), _smooth(volume, options.spatial_sigma, 0)
    return int(np.argmin([K.gradient_distance(slices[z : z + 1], smooth).sum() for z in range(len(slices))]))


def depth_aligned(frames: DataFrame, volume_frames: DataFrame, options: DepthOptions | None = None) -> DataFrame:
    """Per frame of one recording: z (1-based, as stored) and the frame corrected to the anchor's depth, in the output type."""
    options = options or DepthOptions()
    volume = one_volume(volume_frames)
    if len(volume) < 2:
        raise ValueError("a volume has at least two slices")
    anchor = anchor_of(frames, volume, options)
    lo, hi = max(0, anchor - options.win_half), min(len(volume) - 1, anchor + options.win_half)
    rows = sq.with_halo(frames.select("rec_id", "t", "h", "w", "c", "data"), options.input_buffer, halo_size(options))
    rows = rows.repartition("rec_id", "batch").sortWithinPartitions("rec_id", "batch", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def finish():
            stack = np.stack([f for _, _, f in held])
            z = K.depth_map(_distance(volume, stack, options), anchor, options.win_half, options.patch_size, options.overlap, options.tau_scale)
            z = np.clip(_smooth(z[..., None], options.smooth_spatial, options.smooth_temporal)[..., 0], lo, hi)
            core = [k for k, (_, role, _) in enumerate(held) if role == "core"]
            fixed = _stored_type(stack[core] + volume[anchor] - K.along_depth(volume, z[core]), options.output_dtype)
            n, h, w, c = fixed.shape
            lists = [pa.array(list(x.reshape(n, -1)), pa.list_(pa.float64())) for x in (z[core] + 1, fixed)]
            sizes = [pa.array([k] * n, pa.int32()) for k in (h, w, c)]
            return pa.RecordBatch.from_arrays([pa.array([unit[0]] * n), pa.array([held[k][0] for k in core], pa.int64()), *sizes, *lists], ["rec_id", "t", "h", "w", "c", "z", "corrected"])

        for batch in batches:
            for i, r in enumerate(batch.select(["rec_id", "batch", "t", "role", "h", "w", "c"]).to_pylist()):
                if (r["rec_id"], r["batch"]) != unit:
                    if held:
                        yield finish()
                    unit, held = (r["rec_id"], r["batch"]), []
                held.append((r["t"], r["role"], np.array(batch.column("data")[i].values.to_numpy(zero_copy_only=False)).reshape(r["h"], r["w"], r["c"])))
        if held:
            yield finish()

    return rows.select("rec_id", "batch", "t", "role", "h", "w", "c", "data").mapInArrow(run, RESULT)


def simulated(depths: DataFrame, volume_frames: DataFrame, dtype: str = "uint16") -> DataFrame:
    """Frames as the volume would show them at stored (1-based) depths."""
    from ..operators.motion import map_stacks

    volume = one_volume(volume_frames)
    rows = depths.select("rec_id", "t", "h", "w", F.lit(1).alias("c"), "z")
    return map_stacks(rows, lambda z: {"simulated": _stored_type(K.along_depth(volume, z[..., 0] - 1), dtype)}, {"simulated": "array<double>"}, inputs=("z",))


def source_mean(source: DataFrame, options: DepthOptions) -> DataFrame:
    """The reference of a pre-alignment: the mean of a recording's first frames, in bins."""
    size = options.reference_source_bin_size
    return sq.first_mean(sq.binned(source, size, padded=True) if size > 1 else source, options.reference_source_frames)


def run_depth(frames: DataFrame, stack: DataFrame, path: str, options: DepthOptions | None = None, source: DataFrame | None = None, stages: tuple[int, ...] = (1, 2, 3)) -> dict[str, DataFrame]:
    """The stages of depth alignment of one recording, as Parquet under ``path``.

    1: volume, the stack registered to ``source``'s mean (or to its own reference), or as
    it is without ``prealign_stack``. 2: with ``prealign_recording``, the recording is
    registered first (prealigned); depths, and frames corrected to the anchor's depth with
    ``write_corrected``. 3: simulated, with ``write_simulated``. Later stages read what
    earlier ones wrote; with ``resume``, tables that were written to their end stay.
    """
    options = options or DepthOptions()
    spark, out = frames.sparkSession, {}

    def one_reference(df: DataFrame, own: DataFrame | None, flow) -> DataFrame:
        if own is None:
            return registration.references_of(df, flow)
        return df.select("rec_id").distinct().crossJoin(F.broadcast(source_mean(own, options).drop("rec_id"))).select("rec_id", "h", "w", "c", "data")

    def written(name: str, made) -> DataFrame:
        """A table of the folder; ``made`` is called where it has to be written."""
        if made is not None:
            try:
                if not options.resume:
                    raise FileNotFoundError
                out[name] = spark.read.parquet(f"{path}/{name}")  # a table's files appear when its job ends
                return out[name]
            except (AnalysisException, FileNotFoundError):
                made().write.mode("overwrite").parquet(f"{path}/{name}")
        out[name] = spark.read.parquet(f"{path}/{name}")
        return out[name]

    def volume() -> DataFrame:
        raw = stack
        if options.prealign_stack:
            flow = options.stack_flow()
            raw = registration.compensate(stack, one_reference(stack, source, flow), flow)
        size = options.stack_scans_per_slice or options.volume_bin_size
        raw = raw.select("rec_id", "t", "h", "w", "c", "data")
        return sq.binned(raw, size, padded=True) if size > 1 else raw

    def prealigned() -> DataFrame:
        flow = options.recording_flow()
        return registration.compensate(frames, one_reference(frames, source if source is not None else frames, flow), flow).drop("u", "v")

    def depths() -> DataFrame:
        rows = frames.select("rec_id", "t", "h", "w", "c", "data")
        if options.prealign_recording:
            rows = written("prealigned", prealigned)
        elif options.input_bin_size > 1:
            rows = sq.binned(rows, options.input_bin_size, padded=True)
        found = depth_aligned(rows, out["volume"], options)
        return found if options.write_corrected else found.drop("corrected")

    written("volume", volume if 1 in stages else None)
    if 2 in stages or 3 in stages:
        written("depths", depths if 2 in stages else None)
    if 3 in stages and options.write_simulated:
        written("simulated", lambda: simulated(out["depths"], out["volume"], options.output_dtype))
    return out
