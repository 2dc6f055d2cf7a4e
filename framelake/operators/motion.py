"""Stencils, resampling, warps, flows, masks and depth as frame-row operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from .frames import map_frames, map_stacks


def _planes(stack: np.ndarray, kernel) -> np.ndarray:
    return np.stack([kernel(stack[..., c]) for c in range(stack.shape[-1])], -1)


def smoothed(frames: DataFrame, sigma: tuple[float, float], truncate: float = 4.0) -> DataFrame:
    """Spatial Gaussian of (rows, columns) of every channel."""
    return map_frames(frames, lambda s: _planes(s, lambda p: K.gaussian(p, sigma, truncate)))


def smoothed_in_time(frames: DataFrame, sigma: float, batch: int, causal: bool = False, truncate: float = 4.0) -> DataFrame:
    """Temporal Gaussian inside each batch of ``batch`` frames, reflected at its ends; or causal with weights renormalised to the frames there are.

    A batch is one group, so at most ``batch`` frames meet in a task; the batch
    size is part of the result, as in batch reading.
    """
    group = frames.withColumn("batch", F.floor(F.col("t") / batch))
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema.fields}

    def run(pdf):
        pdf = pdf.sort_values("t")
        stack = np.stack(pdf["data"].to_numpy())
        if causal:
            out = np.empty_like(stack)
            for k in range(len(stack)):
                w = K.half_weights(sigma, k + 1, truncate, float)
                out[k] = (w[:, None] * stack[k::-1][: len(w)]).sum(0)
        else:
            out = K.convolve(stack, K.gaussian_weights(sigma, truncate), 0) if sigma > 0 else stack
        pdf["data"] = list(out)
        return pdf[list(kinds)]

    return group.groupBy("rec_id", "batch").applyInPandas(run, ", ".join(f"{k} {t}" for k, t in kinds.items()))


def gradients(frames: DataFrame, hy=1.0, hx=1.0) -> DataFrame:
    """Arrays gy and gx."""

    def run(s):
        gy, gx = K.gradient(s, hy, hx)
        return {"gy": gy, "gx": gx}

    return map_stacks(frames, run, {"gy": "array<double>", "gx": "array<double>"})


def second_differences(frames: DataFrame, hy=1.0, hx=1.0) -> DataFrame:
    def run(s):
        pairs = [K.second_differences(s[..., c], hy, hx) for c in range(s.shape[-1])]
        return {"fxx": np.stack([p[0] for p in pairs], -1), "fyy": np.stack([p[1] for p in pairs], -1)}

    return map_stacks(frames, run, {"fxx": "array<double>", "fyy": "array<double>"})


TENSOR_PLANES = ("j11", "j22", "j33", "j12", "j13", "j23")


def motion_tensors(pairs: DataFrame, constancy: str = "gc", hy=1.0, hx=1.0) -> DataFrame:
    """From columns fixed and moving: the six planes of the motion tensor with their ring, of one channel."""

    def run(fixed, moving):
        return dict(zip(TENSOR_PLANES, K.TENSORS[constancy](fixed[..., 0], moving[..., 0], hy, hx), strict=True))

    return map_stacks(pairs, run, dict.fromkeys(TENSOR_PLANES, "array<double>"), inputs=("fixed", "moving"))


def padded(frames: DataFrame, mode: str = "edge") -> DataFrame:
    """A ring of one pixel: ``edge`` repeats the border, ``symmetric`` reflects it."""
    return map_frames(frames, lambda s: np.pad(s, ((0, 0), (1, 1), (1, 1), (0, 0)), mode=mode))


def medians(frames: DataFrame) -> DataFrame:
    return map_frames(frames, lambda s: _planes(s, K.median5))


def resized(frames: DataFrame, size: tuple[int, int], anti_alias: bool = True) -> DataFrame:
    return map_frames(frames, lambda s: K.resize(s.astype(np.float32), size) if anti_alias else K.resize_plain(s, size), size)


def warped(flows: DataFrame, method: str = "cubic") -> DataFrame:
    """From columns data, fill, u, v: the warped frames."""

    def run(data, fill, u, v):
        return {"warped": K.warp(data, u[..., 0], v[..., 0], fill, method)}

    return map_stacks(flows, run, {"warped": "array<double>"}, inputs=("data", "fill", "u", "v"))


def aligned(frames: DataFrame, flow: np.ndarray, reference: np.ndarray, method: str = "cubic") -> DataFrame:
    """All frames warped by one field (h, w, 2); pixels from outside come from the reference."""
    return map_frames(frames, lambda s: K.warp(s, np.broadcast_to(flow[..., 0], s.shape[:3]), np.broadcast_to(flow[..., 1], s.shape[:3]), np.broadcast_to(reference, s.shape), method))


def resampled(frames: DataFrame, size: tuple[int, int], kind: str = "linear") -> DataFrame:
    """Resize by one of the plain kernels: nearest, linear, cubic, lanczos or area."""
    return map_frames(frames, lambda s: K.resample(s, size, kind), size)


def enlarged_warp(flows: DataFrame, scale: int = 4) -> DataFrame:
    """Super-resolution preview: frames enlarged by cubic and flows by linear resampling, then warped linearly; outside is 0."""

    def run(data, u, v):
        size = (data.shape[1] * scale, data.shape[2] * scale)
        big = K.resample(data, size, "cubic")
        large = [K.resample(f[..., 0], size, "linear") * scale for f in (u, v)]
        return {"warped": K.warp(big, *large, np.zeros_like(big), "linear")}

    # 16 to 18 values for each one of the picture were measured
    return map_stacks(flows, run, {"warped": "array<double>"}, inputs=("data", "u", "v"), work=lambda h, w, c: 18 * 8 * h * w * c * scale**2)


def valid_masks(flows: DataFrame) -> DataFrame:
    return map_stacks(flows, lambda u, v: {"valid": K.valid_mask(u[..., 0], v[..., 0])}, {"valid": "array<boolean>"}, inputs=("u", "v"))


def warped_masks(flows: DataFrame, mask: str = "mask") -> DataFrame:
    return map_stacks(flows, lambda m, u, v: {"valid": K.warp_mask(m[..., 0], u[..., 0], v[..., 0])}, {"valid": "array<boolean>"}, inputs=(mask, "u", "v"))


def flow_statistics(flows: DataFrame) -> DataFrame:
    names = ("mean_disp", "max_disp", "mean_div", "mean_translation")
    return map_stacks(flows, lambda u, v: K.flow_statistics(np.stack([u[..., 0], v[..., 0]], -1)), dict.fromkeys(names, "double"), inputs=("u", "v"))


def endpoint_errors(flows: DataFrame, border: int = 25) -> DataFrame:
    """From u, v, true_u, true_v: the mean distance inside a border."""

    def run(u, v, tu, tv):
        d = np.sqrt((u - tu) ** 2 + (v - tv) ** 2)[:, border : u.shape[1] - border, border : u.shape[2] - border]
        return {"epe": d.reshape(len(u), -1).mean(1)}

    return map_stacks(flows, run, {"epe": "double"}, inputs=("u", "v", "true_u", "true_v"))


def mask_and(masks: DataFrame, by: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Pixels that are valid in every mask of a group; masks of a group have one size.

    Each task ANDs the masks of its batches to one per group, and only these are
    shuffled, as whole arrays; ANDing them again gives the result.
    """
    keys = list(by)
    kinds = {f.name: f.dataType.simpleString() for f in masks.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "valid array<boolean>"])

    def reduced(table: pa.Table | pa.RecordBatch) -> pa.RecordBatch:
        groups: dict[tuple, np.ndarray] = {}
        lists = table.column("valid")
        for i, key in enumerate(zip(*(table.column(k).to_pylist() for k in keys), strict=True) if keys else [()] * table.num_rows):
            one = lists[i].values.to_numpy(zero_copy_only=False)
            groups[key] = groups[key] & one if key in groups else one.copy()
        columns = [pa.array([g[k] for g in groups], table.schema.field(name).type) for k, name in enumerate(keys)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(groups.values()), pa.list_(pa.bool_()))], [*keys, "valid"])

    def partial(batches):
        for batch in batches:
            if batch.num_rows:
                yield reduced(batch)

    parts = masks.select(*keys, "valid").mapInArrow(partial, schema)
    return parts.groupBy(*keys).applyInArrow(lambda table: pa.Table.from_batches([reduced(table)]), schema)


def displacements(frames: DataFrame, reference: np.ndarray, **options) -> DataFrame:
    """Flows u, v that register every frame to the reference; options are those of the kernel."""
    solve = options.pop("solver", None) or K.displacement

    def run(stack):
        flow = solve(reference, stack, **options)
        return {"u": flow[..., 0], "v": flow[..., 1]}

    return map_stacks(frames, run, {"u": "array<double>", "v": "array<double>"})


def rigid_shifts(frames: DataFrame, reference: np.ndarray, **options) -> DataFrame:
    def run(stack):
        d = K.rigid_shift(reference, stack, **options)
        return {"dx": d[:, 0].astype(float), "dy": d[:, 1].astype(float)}

    return map_stacks(frames, run, {"dx": "double", "dy": "double"})


# -- depth -------------------------------------------------------------------


def _depth_work(slices: int):
    """Bytes for a frame that is compared with all slices: their distances, twice, and its own gradients."""
    return lambda h, w, c: 8 * h * w * (2 * slices + 8 * c + 4)


def slice_errors(frames: DataFrame, volume: np.ndarray) -> DataFrame:
    """Total gradient distance of each frame to each slice of the volume: one row per frame and slice."""
    rows = map_stacks(frames, lambda s: {"err": K.gradient_distance(volume, s).sum((2, 3))}, {"err": "array<double>"}, work=_depth_work(len(volume)))
    return rows.select("rec_id", "t", F.posexplode("err").alias("z", "err"))


def anchor_slice(errors: DataFrame) -> DataFrame:
    """The slice with the least total error, the first of equals."""
    total = errors.groupBy("rec_id", "z").agg(F.sum("err").alias("err"))
    return total.groupBy("rec_id").agg(F.min(F.struct("err", "z")).alias("best")).select("rec_id", F.col("best.z").cast("long").alias("anchor"), F.col("best.err").alias("err"))


def depth_maps(frames: DataFrame, volume: np.ndarray, anchor: int, **options) -> DataFrame:
    return map_stacks(frames, lambda s: {"z": K.depth_map(K.gradient_distance(volume, s), anchor, **options)}, {"z": "array<double>"}, work=_depth_work(len(volume)))


def depth_corrected(rows: DataFrame, volume: np.ndarray, anchor: int) -> DataFrame:
    """From data and z: frames plus the volume's difference between the anchor slice and their own depth."""
    return map_stacks(rows, lambda data, z: {"corrected": data + volume[anchor] - K.along_depth(volume, z[..., 0])}, {"corrected": "array<double>"}, inputs=("data", "z"))


def depth_simulated(rows: DataFrame, volume: np.ndarray) -> DataFrame:
    return map_stacks(rows, lambda z: {"simulated": K.along_depth(volume, z[..., 0])}, {"simulated": "array<double>"}, inputs=("z",))


# -- pictures ----------------------------------------------------------------


def two_colors(frames: DataFrame) -> DataFrame:
    """Two channels as RGB in 0..255: red, their mean, blue; each channel scaled to its own range."""

    def run(s):
        low, high = s.min((1, 2), keepdims=True), s.max((1, 2), keepdims=True)
        x = np.where(high > low, (s - low) / np.where(high > low, high - low, 1), 0)
        return {"rgb": np.floor(np.clip(np.stack([x[..., 0], (x[..., 0] + x[..., 1]) * 0.5, x[..., 1]], -1), 0, 1) * 255)}

    return map_stacks(frames, run, {"rgb": "array<double>"})


def referenced_colors(frames: DataFrame, left: tuple[float, float], right: tuple[float, float]) -> DataFrame:
    """As ``two_colors`` with given ranges; the right channel's range ends at its own maximum less the left minimum, as in the established figure code."""

    def run(s):
        a = (s[..., 0] - left[0]) / ((left[1] - left[0]) or 1)
        b = (s[..., 1] - right[0]) / (right[1] - left[0] if right[1] > left[0] else 1)
        return {"rgb": np.clip(np.stack([a, (a + b) * 0.5, b], -1), 0, 1)}

    return map_stacks(frames, run, {"rgb": "array<double>"})


def flow_colors(flows: DataFrame, max_flow: float | None = None) -> DataFrame:
    """The common colour code of flows: the direction picks a hue of the 55-step wheel, white fades into it with the speed.

    Speeds are relative to ``max_flow``, or to the frame's greatest; hues of faster
    pixels are darkened to three quarters, flows beyond 1e9 are unknown and black.
    """
    hues = K.color_wheel() / 255
    angles = np.linspace(-np.pi, np.pi, len(hues))

    def run(u, v):
        flow = u[..., 0] + 1j * v[..., 0]
        lost = np.maximum(np.abs(flow.real), np.abs(flow.imag)) > 1e9
        flow[lost] = 0
        speed = np.abs(flow)
        speed = speed / np.maximum(max_flow or speed.max((1, 2), keepdims=True), np.finfo(float).eps)
        direction = np.angle(-flow)
        hue = np.stack([np.interp(direction, angles, band) for band in hues.T], -1)
        picture = np.where(speed[..., None] > 1, 0.75 * hue, 1 + speed[..., None] * (hue - 1))
        picture[lost] = 0
        return {"rgb": np.floor(255 * picture)}

    return map_stacks(flows, run, {"rgb": "array<double>"}, inputs=("u", "v"))


def multispectral(frames: DataFrame, axes: np.ndarray | None = None) -> DataFrame:
    """Any number of bands as RGB in [0, 1]: one is grey, two are red and blue with their mean, three are taken as they are, more are projected on ``axes`` (bands, 3).

    Every picture channel is scaled to its own range.
    """

    def run(s):
        c = s.shape[-1]
        x = s[..., [0, 0, 0]] if c == 1 else np.stack([s[..., 0], s.mean(-1), s[..., 1]], -1) if c == 2 else s if c == 3 else s @ axes
        low, high = x.min((1, 2), keepdims=True), x.max((1, 2), keepdims=True)
        return {"rgb": np.where(high > low, (x - low) / np.where(high > low, high - low, 1), 0)}

    return map_stacks(frames, run, {"rgb": "array<double>"})


def band_axes(frames: DataFrame) -> np.ndarray:
    """The three main axes of the bands' covariance, over all pixels of all frames; the sign makes the largest weight positive.

    Only sums of products travel: one row per task, bands x bands numbers.
    """

    def sums(s):
        flat = s.reshape(len(s), -1, s.shape[-1])
        n = np.full(len(s), float(flat.shape[1]))
        return {"n": n, "one": flat.sum(1), "two": np.einsum("npa,npb->nab", flat, flat)}

    rows = map_stacks(frames, sums, {"n": "double", "one": "array<double>", "two": "array<double>"}, keep=("c",))
    spread = rows.select("c", "n", F.posexplode(F.concat("one", "two")).alias("i", "v"))
    total = rows.agg(F.sum("n"), F.max("c")).first()
    values = np.array([r["v"] for r in spread.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])
    n, c = total
    mean, square = values[:c] / n, values[c:].reshape(c, c) / n
    _, vectors = np.linalg.eigh(square - np.outer(mean, mean))
    top = vectors[:, ::-1][:, :3]
    return top * np.sign(top[np.abs(top).argmax(0), np.arange(top.shape[1])])


def sampled_vectors(flows: DataFrame, step: int = 8) -> DataFrame:
    """The flow at every ``step``-th pixel: rows (rec_id, t, y, x, u, v) for arrow plots."""
    pairs = F.transform(F.arrays_zip("u", "v"), lambda p, i: F.struct(F.floor(i / F.col("w")).alias("y"), (i % F.col("w")).cast("long").alias("x"), p["u"].alias("u"), p["v"].alias("v")))
    rows = flows.withColumn("p", F.explode(F.filter(pairs, lambda p: (p["y"] % step == 0) & (p["x"] % step == 0))))
    return rows.select("rec_id", "t", "p.y", "p.x", "p.u", "p.v")
