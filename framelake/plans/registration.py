"""Motion correction as plans over frame rows.

``compensate`` is for recordings of any length: frames are dealt by recording,
sorted by time and streamed through the corrector one buffer at a time, each
recording's reference ahead of its frames, so that a task holds one buffer and
recordings run side by side. A recording is inherently sequential as long as a
batch starts from the flows of the one before. Where neither the start nor the
reference is carried over, ``compensate_apart`` deals single batches instead: one
long recording then uses the whole cluster.
"""

from __future__ import annotations

import struct
import warnings
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import kernels as K
from ..operators import frames as fr
from ..operators import motion as mo
from ..operators import sequence as sq
from ..sources import formats
from ..sources.frames_io import read_frames, stored, write_frames
from .corrector import Corrector, LiveCorrector, preregistered
from .options import FlowOptions, LiveOptions, SessionOptions, get_backend

RESULT = "rec_id string, t bigint, h int, w int, c int, data array<double>, u array<double>, v array<double>"
RESULT_ARROW = pa.schema([("rec_id", pa.string()), ("t", pa.int64()), *((k, pa.int32()) for k in "hwc"), *((k, pa.list_(pa.float64())) for k in ("data", "u", "v"))])


def _emit(rec: str, ts: list[int], registered: np.ndarray, flow: np.ndarray) -> pa.RecordBatch:
    n, h, w, c = registered.shape
    lists = [pa.array(list(np.asarray(x, float).reshape(n, -1)), pa.list_(pa.float64())) for x in (registered, flow[..., 0], flow[..., 1])]
    fixed = [pa.array([k] * n, pa.int32()) for k in (h, w, c)]
    return pa.RecordBatch.from_arrays([pa.array([rec] * n), pa.array(ts, pa.int64()), *fixed, *lists], schema=RESULT_ARROW)


class Hooks(NamedTuple):
    """Functions called in the task that solved a batch, after it; a task that is run again calls them again, and their errors become warnings.

    progress(rec_id, frames done, frames in all), flows(rec_id, (n, h, w, 2), first,
    stop) and registered(rec_id, (n, h, w, c), first, stop). They travel to the
    executors, so what they tell has to leave there: a file, a socket, a queue. On the
    driver, ``observed`` tells the number of frames.
    """

    progress: tuple[Callable, ...] = ()
    flows: tuple[Callable, ...] = ()
    registered: tuple[Callable, ...] = ()

    def tell(self, rec: str, ts: list[int], done: int, total: int, registered: np.ndarray, flow: np.ndarray) -> None:
        span = (ts[0], ts[-1] + 1)
        for hooks, told in ((self.progress, (done, total)), (self.flows, (flow, *span)), (self.registered, (registered, *span))):
            for hook in hooks:
                try:
                    hook(rec, *told)
                except Exception as error:  # noqa: BLE001
                    warnings.warn(f"{hook}: {error}", stacklevel=2)


def _dealt(frames: DataFrame, references: DataFrame, counting: bool = False) -> DataFrame:
    """References ahead of their frames, with the number of their frames as t where it is wanted."""
    ahead = references.select("rec_id", F.lit(False).alias("frame"), F.lit(0).cast("long").alias("t"), "h", "w", "c", "data")
    if counting:
        ahead = ahead.drop("t").join(sq.counted(frames).select("rec_id", F.col("n_frames").alias("t")), "rec_id").select(*ahead.columns)
    both = ahead.unionByName(frames.select("rec_id", F.lit(True).alias("frame"), "t", "h", "w", "c", "data"))
    return both.repartition("rec_id").sortWithinPartitions("rec_id", "frame", "t")


def _streamed(rows: DataFrame, size: int, start, step, hooks: Hooks | None = None) -> DataFrame:
    """Runs sorted rows through per-recording state: start(reference) makes it, step(state, stack) takes at most ``size`` frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rec, state, held, ts, done, total = None, None, [], [], 0, 0

        def flush():
            nonlocal done
            registered, flow = step(state, np.stack(held))
            done += len(held)
            if hooks:
                hooks.tell(rec, ts, done, total, registered, flow)
            out = _emit(rec, ts[:], registered, flow)
            held.clear()
            ts.clear()
            return out

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("rec_id", "frame", "t", "h", "w", "c")]
            for i, (r, is_frame, t, h, w, c) in enumerate(zip(*columns, strict=True)):
                frame = batch.column("data")[i].values.to_numpy(zero_copy_only=False).reshape(h, w, c)
                if held and (r != rec or len(held) == size):
                    yield flush()
                if r != rec:
                    rec, state = r, None
                if not is_frame:
                    state, done, total = start(frame), 0, t
                    continue
                if state is None:
                    raise ValueError(f"recording {r} has no reference")
                held.append(np.array(frame))
                ts.append(t)
        if held:
            yield flush()

    return rows.select("rec_id", "frame", "t", "h", "w", "c", "data").mapInArrow(run, RESULT)


def references_of(frames: DataFrame, options: FlowOptions, preregister: bool = True) -> DataFrame:
    """One reference frame per recording, from its ``reference_frames``: registered to their own mean first, or just averaged.

    Indices beyond the last frame count as the last one (with repeats). A task
    holds the chosen frames of one recording, so their number bounds its memory. A path
    or an array stands for all recordings; of several pages the mean is taken.
    """
    if not isinstance(options.reference_frames, list):
        given = sq.mean_frames(read_frames(frames.sparkSession, options.reference_frames).withColumn("rec_id", F.lit("0"))).drop("rec_id")
        if (given.agg(F.sum(F.size("data"))).first()[0] or 0) * 8 > fr.MOST_REFERENCE_BYTES:
            raise ValueError("a reference has at most 256 MiB")
        return frames.select("rec_id").distinct().crossJoin(F.broadcast(given)).select("rec_id", "h", "w", "c", "data")
    counts = sq.counted(frames).select("rec_id", (F.col("n_frames") - 1).alias("last"))
    wanted = counts.select("rec_id", F.explode(F.array(*[F.lit(i) for i in options.reference_frames])).alias("i"), "last")
    wanted = wanted.groupBy("rec_id", F.least("i", "last").cast("long").alias("t")).agg(F.count("*").alias("times"))
    chosen = frames.select("rec_id", "t", "h", "w", "c", "data").join(wanted, ["rec_id", "t"])
    if not preregister:
        return sq.mean_frames(chosen.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "times"))))
    rows = chosen.repartition("rec_id").sortWithinPartitions("rec_id", "t")
    told = options.model_copy(update={"input_file": None})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rec, held = None, []

        def finish():
            frame = preregistered(np.stack(held), told)[None]
            return _emit(rec, [0], frame, np.zeros((*frame.shape[:3], 2)))

        for batch in batches:
            for i, r in enumerate(batch.select(["rec_id", "h", "w", "c", "times"]).to_pylist()):
                if r["rec_id"] != rec:
                    if held:
                        yield finish()
                    rec, held = r["rec_id"], []
                held += [np.array(batch.column("data")[i].values.to_numpy(zero_copy_only=False)).reshape(r["h"], r["w"], r["c"])] * r["times"]
        if held:
            yield finish()

    return rows.select("rec_id", "h", "w", "c", "data", "times").mapInArrow(run, RESULT).select("rec_id", "h", "w", "c", "data")


def observed(frames: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """The frames, and an observation of their number and last index that is filled as they are written."""
    seen = Observation(name)
    return frames.observe(seen, F.count(F.lit(1)).alias("frames"), F.max("t").alias("last")), seen


def compensate(frames: DataFrame, references: DataFrame, options: FlowOptions, solver=None, hooks: Hooks | None = None) -> DataFrame:
    """Registered frames and flows of every recording; ``references`` has one frame per recording.

    Frames are binned by ``bin_size`` first, and registered ones are cast to
    ``output_typename`` (integers: cut and clipped). The solver is looked up here, so
    that one registered by name on the driver serves all executors.
    """
    solver = solver or options.solver()
    told = options.model_copy(update={"input_file": None})  # what travels
    if options.bin_size > 1:
        frames = sq.binned(frames, options.bin_size, padded=True)
    rows = _dealt(frames, references, counting=bool(hooks and hooks.progress))
    rows = _streamed(rows, options.buffer_size, lambda ref: Corrector(ref, told, solver), lambda s, stack: s.batch(stack), hooks)
    if options.output_typename == "single":
        return rows.withColumn("data", F.transform("data", lambda x: x.cast("float").cast("double")))
    return rows.withColumn("data", C.truncated(F.col("data"), options.output_typename)) if options.output_typename in C.RANGES else rows


def write_result(registered: DataFrame, references: DataFrame, path: str, options: FlowOptions) -> dict[str, DataFrame]:
    """Writes what a correction gave as Parquet tables under ``path``, and reads them back.

    frames always, reference and statistics with ``save_meta_info``, w (the flows) with
    ``save_w``, and valid_mask (pixels that stay inside, of each frame) with
    ``save_valid_mask`` or ``save_valid_idx``. The
    correction runs once: the other tables are read from what the first write left.
    """
    spark = registered.sparkSession
    shape = ["rec_id", "t", "h", "w", "c"]
    registered.write.mode("overwrite").parquet(f"{path}/registered")
    rows = spark.read.schema(registered.schema).parquet(f"{path}/registered")
    flows = rows.withColumn("c", F.lit(1))
    parts = {"frames": rows.select(*shape, "data")}
    if options.save_meta_info:
        parts |= {"reference": references, "statistics": mo.flow_statistics(flows).drop("h", "w", "c")}
    if options.save_w:
        parts["w"] = rows.select(*shape, "u", "v")
    if options.save_valid_mask or options.save_valid_idx:
        parts["valid_mask"] = mo.valid_masks(flows)
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/registered")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return {name: spark.read.schema(df.schema).parquet(f"{path}/{name}") for name, df in parts.items()}


def correct(spark: SparkSession, options: FlowOptions, solver=None, hooks: Hooks | None = None) -> dict[str, DataFrame]:
    """All that the options say: reads ``input_file``, keeps ``channel_idx``, registers, and writes under ``output_path``.

    Frames go into a file of ``output_format`` for each recording, called compensated
    (with the recording's name before it for several ones or by the batch convention)
    or ``output_file_name``; the other parts, and frames in the format PARQUET, are tables
    as of ``write_result``.
    """
    frames = read_frames(spark, options.input_file).withColumn("rec_id", F.regexp_replace("rec_id", r"\.[A-Za-z0-9]+$", ""))
    if options.channel_idx is not None:
        frames = sq.channels(frames, options.channel_idx)
    references = references_of(frames, options)
    parts = write_result(compensate(frames, references, options, solver, hooks), references, options.output_path, options)
    counts = sq.counted(parts["frames"])
    names = counts.count()
    if options.verbose:
        counts.show(truncate=False)
    if options.output_format.upper() != "PARQUET":
        if options.output_file_name and names > 1:
            raise ValueError("output_file_name is for one recording")
        several = names > 1 or options.naming_convention == "batch"
        named = F.lit(options.output_file_name.rpartition(".")[0] or options.output_file_name) if options.output_file_name else F.concat("rec_id", F.lit("_compensated")) if several else F.lit("compensated")
        write_frames(parts["frames"].withColumn("rec_id", named), options.output_path, options.output_format, STORED.get(options.output_typename, options.output_typename))
    return parts


STORED = {"double": "float64", "single": "float32"}


def compensate_apart(frames: DataFrame, references: DataFrame, options: FlowOptions, solver=None) -> DataFrame:
    """As ``compensate`` where no batch depends on another; batches of one recording run in parallel."""
    if options.update_reference or options.update_initialization_w:
        raise ValueError("batches depend on each other with these options")
    parts = frames.withColumn("part", F.concat_ws("\x1f", "rec_id", F.floor(F.col("t") / options.buffer_size)))
    keys = parts.select("rec_id", "part").distinct()
    ahead = references.join(keys, "rec_id").select(F.col("part").alias("rec_id"), "h", "w", "c", "data")
    rows = compensate(parts.drop("rec_id").withColumnRenamed("part", "rec_id"), ahead, options, solver)
    return rows.withColumn("rec_id", F.substring_index("rec_id", "\x1f", 1))


def compensate_pair(fixed: np.ndarray, moving: np.ndarray, options: FlowOptions) -> np.ndarray:
    """The flow of the second of two frames."""
    return Corrector(fixed if fixed.ndim == 3 else fixed[..., None], options).batch((moving if moving.ndim == 3 else moving[..., None])[None])[1][0]


def live(frames: DataFrame, references: DataFrame, options: LiveOptions, solver=None) -> DataFrame:
    """What the live mode gives for recorded frames, in order."""
    solver = solver or get_backend(options.flow.flow_backend)
    return _streamed(_dealt(frames, references), 64, lambda ref: LiveCorrector(options, ref, solver), lambda s, stack: s.register_frames(stack))


def live_references(frames: DataFrame, references: DataFrame, options: LiveOptions, solver=None) -> DataFrame:
    """The reference of each recording after its last frame in live mode."""
    solver = solver or get_backend(options.flow.flow_backend)

    def step(state: LiveCorrector, stack: np.ndarray):
        state.register_frames(stack)
        return np.broadcast_to(state.raw, stack.shape), np.zeros((*stack.shape[:3], 2))

    rows = _streamed(_dealt(frames, references), 64, lambda ref: LiveCorrector(options, ref, solver), step)
    return rows.groupBy("rec_id").agg(F.max_by(F.struct("h", "w", "c", "data"), "t").alias("last")).select("rec_id", "last.*")


def session(frames: DataFrame, options: SessionOptions, flow: FlowOptions | None = None, compensated: DataFrame | None = None) -> dict[str, DataFrame]:
    """Recordings registered to themselves, then to the middle one.

    compensated: registered frames and flows; averages: mean registered frame per
    recording; between: displacement of each average to the centre's (zero for the
    centre itself); masks: pixels of each recording that are always valid, in the
    centre's frame; session_mask: pixels valid in all of them; aligned: registered
    frames in the centre's frame.
    """
    flow = flow or FlowOptions(**options.flow_options)
    if compensated is None:
        # read by averages, masks and alignment: stored, so that recordings are solved once
        compensated = stored(compensate(frames, sq.first_mean(frames, INITIAL_FRAMES), flow), "compensated")
    averages = sq.mean_frames(compensated)
    between = displaced(averages, options)
    return {"compensated": compensated, "averages": averages, "between": between, **joined(compensated, averages, between, options)}


def _middle(averages: DataFrame, options: SessionOptions) -> DataFrame:
    """One row: the centre recording and its average."""
    names = averages.select("rec_id").distinct()
    center = averages.where(F.col("rec_id") == options.center) if options.center else averages.join(sq.center_recording(names), "rec_id")
    return center.select(F.col("rec_id").alias("center"), F.col("data").alias("center_data"))


def displaced(averages: DataFrame, options: SessionOptions) -> DataFrame:
    """The displacement of each recording's average to the centre's."""
    pairs = averages.crossJoin(F.broadcast(_middle(averages, options)))

    def displace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shape = (r["h"], r["w"], r["c"])
                fixed, moving = (np.array(r[k]).reshape(shape) for k in ("center_data", "data"))
                field = np.zeros((*shape[:2], 2))
                if r["rec_id"] != r["center"]:
                    low, high = fixed.min(), fixed.max()
                    a, b = ((K.gaussian(((x - low) / (high - low or 1)).transpose(2, 0, 1), (options.sigma_smooth,) * 2)).transpose(1, 2, 0) for x in (fixed, moving))
                    shift = K.rigid_shift(a, b[None], upsample=options.cc_upsample)[0]
                    start = np.broadcast_to(shift, field.shape)
                    moved = K.warp(b[None], start[None, ..., 0], start[None, ..., 1], a[None], "linear").astype(float)
                    field = start + K.displacement(a, moved, alpha=options.alpha_between, iterations=options.iterations_between, constancy=options.constancy_between)[0]
                yield _emit(r["rec_id"], [0], moving[None], field[None])

    return pairs.select("rec_id", "h", "w", "c", "data", "center", "center_data").mapInArrow(displace, RESULT)


def joined(compensated: DataFrame, averages: DataFrame, between: DataFrame, options: SessionOptions) -> dict[str, DataFrame]:
    """Masks and registered frames in the centre's frame."""
    always = mo.mask_and(mo.valid_masks(compensated.select("rec_id", "t", "h", "w", "c", "u", "v").withColumn("c", F.lit(1))))
    fields = between.select("rec_id", F.col("u").alias("bu"), F.col("v").alias("bv"))
    shape = between.select("rec_id", "t", "h", "w", F.lit(1).alias("c"), "u", "v")
    carried = shape.join(always, "rec_id").withColumn("mask", F.transform("valid", lambda x: x.cast("double")))
    masks = mo.warped_masks(carried.drop("valid"))
    moved = compensated.select("rec_id", "t", "h", "w", "c", "data").join(fields, "rec_id").crossJoin(F.broadcast(_middle(averages, options).select("center_data")))
    spread = lambda name: F.flatten(F.transform(name, lambda x: F.array_repeat(x, F.col("c"))))
    aligned = mo.warped(moved.select("rec_id", "t", "h", "w", "c", "data", F.col("center_data").alias("fill"), spread("bu").alias("u"), spread("bv").alias("v")))
    return {"masks": masks, "session_mask": mo.mask_and(masks, ()), "aligned": aligned}


INITIAL_FRAMES = 22


def run_session(frames: DataFrame, path: str, options: SessionOptions, flow: FlowOptions | None = None, stages: tuple[int, ...] = (1, 2, 3)) -> dict[str, DataFrame]:
    """``session`` with its parts as Parquet under ``path``; with ``resume``, recordings whose status says done are not corrected again.

    Stage 1 corrects recordings, stage 2 writes averages and the displacements between
    them, stage 3 masks and aligned frames; a stage reads what those before it wrote,
    now or in another run. A recording's status is written after its frames, so what an
    interrupted run left without a status is corrected anew and replaced.
    """
    spark = frames.sparkSession
    flow = flow or FlowOptions(**options.flow_options)
    status_path, frames_path = f"{path}/status", f"{path}/compensated"
    done: set[str] = set()
    if options.resume:
        try:
            done = {r["rec_id"] for r in spark.read.parquet(status_path).where("state = 'done'").select("rec_id").distinct().collect()}
        except AnalysisException:
            done = set()
    left = frames.where(~F.col("rec_id").isin(list(done))) if done else frames
    if 1 in stages and left.head(1):
        corrected = compensate(left, sq.first_mean(left, INITIAL_FRAMES), flow).withColumn("recording", F.col("rec_id"))
        corrected.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("recording").parquet(frames_path)
        left.select("rec_id").distinct().withColumn("state", F.lit("done")).write.mode("append").parquet(status_path)
    out = {"compensated": spark.read.schema(RESULT).parquet(frames_path)}

    def written(name: str, df: DataFrame | None) -> DataFrame:
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        out[name] = spark.read.parquet(f"{path}/{name}")
        return out[name]

    if 2 in stages or 3 in stages:
        averages = written("averages", sq.mean_frames(out["compensated"]) if 2 in stages else None)
        between = written("between", displaced(averages, options) if 2 in stages else None)
    if 3 in stages:
        for name, df in joined(out["compensated"], averages, between, options).items():
            written(name, df)
    return out


def session_bundle(parts: dict[str, DataFrame], path: str, options: SessionOptions) -> dict[str, np.ndarray]:
    """The session's mask as PNG, and masks, fields and averages of all recordings (in order of names) as NPZ and MAT, in the local folder ``path``.

    Everything is on the driver: refused beyond 256 MiB. ``middle_idx`` counts from one in the MAT file.
    """
    size = sum((parts[k].agg(F.sum(F.size(c))).first()[0] or 0) * n for k, c, n in (("averages", "data", 8), ("between", "u", 16), ("masks", "valid", 8)))
    if size > fr.MOST_REFERENCE_BYTES:
        raise ValueError("a bundle has at most 256 MiB; read the tables instead")
    rows = {k: parts[k].orderBy("rec_id").collect() for k in ("averages", "between", "masks")}
    images = lambda k, c, n=1: np.stack([np.array(r[c], float).reshape(r["h"], r["w"], -1)[..., :n] for r in rows[k]])
    h, w = rows["averages"][0]["h"], rows["averages"][0]["w"]
    names = [r["rec_id"] for r in rows["averages"]]
    middle = names.index(_middle(parts["averages"], options).first()["center"])
    final = np.array(parts["session_mask"].first()["valid"], np.uint8).reshape(h, w)
    averages = images("averages", "data", rows["averages"][0]["c"])
    aligned = np.stack([np.array(r["valid"], np.uint8).reshape(h, w) for r in rows["masks"]])
    found = {
        "final_valid": final, "aligned_valid_masks": aligned, "displacement_fields_u": images("between", "u")[..., 0], "displacement_fields_v": images("between", "v")[..., 0],
        "temporal_averages": averages, "reference_average": averages[middle],
    }
    folder = Path(path)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "final_valid_idx.png").write_bytes(grey_png(final * 255))
    np.savez(folder / "final_valid_idx.npz", middle_idx=middle, recordings=np.array(names), **found)
    (folder / "final_valid_idx.mat").write_bytes(formats.write_mat({**found, "middle_idx": np.array([[middle + 1.0]])}))
    return found


def grey_png(image: np.ndarray) -> bytes:
    """A picture of bytes (h, w) as a PNG file."""
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w = image.shape
    rows = np.pad(image.astype(np.uint8), ((0, 0), (1, 0))).tobytes()  # each row after its filter, 0
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def queries(gray, sessions) -> dict:
    """Registered pipelines over the provided frames."""
    light = FlowOptions(alpha=1.5, iterations=15, buffer_size=100, weight=[1.0])

    def compensate_query(spark, sf_dir):
        df = sessions(spark, sf_dir)
        flows = compensate(df, sq.first_mean(df, INITIAL_FRAMES), light)
        stats = mo.flow_statistics(flows.withColumn("c", F.lit(1)))
        return stats.select("rec_id", "t", "mean_disp", "max_disp", "mean_div", "mean_translation")

    def compensate_independent(spark, sf_dir):
        df = gray(spark, sf_dir)
        apart = light.model_copy(update={"update_initialization_w": False})
        return compensate_apart(df, sq.mean_frames(df), apart).select("rec_id", "t", "data", "u", "v")

    def compensate_rigid(spark, sf_dir):
        df = sessions(spark, sf_dir)
        rigid = light.model_copy(update={"cc_initialization": True, "update_reference": True})
        return compensate(df, sq.first_mean(df, INITIAL_FRAMES), rigid).select("rec_id", "t", "data", "u", "v")

    def live_register(spark, sf_dir):
        df = sessions(spark, sf_dir)
        return live(df, sq.first_mean(df, INITIAL_FRAMES), LiveOptions(flow=FlowOptions(quality_setting="fast", iterations=10, weight=[1.0], flow_backend="redblack"))).select("rec_id", "t", "data", "u", "v")

    def session_part(name):
        def run(spark, sf_dir):
            df = sessions(spark, sf_dir)
            quick = SessionOptions(sigma_smooth=1.0, iterations_between=20)
            return session(df, quick, light)[name]

        return run

    return {
        "compensate": compensate_query, "compensate_independent": compensate_independent, "compensate_rigid": compensate_rigid, "live_register": live_register,
        "session_between": session_part("between"), "session_mask": session_part("session_mask"), "session_full": session_part("aligned"),
    }


__all__ = ["compensate", "compensate_apart", "compensate_pair", "live", "session", "fr"]
