"""The state machines of batch and live motion correction, in numpy; Spark decides where they run."""

from __future__ import annotations

import numpy as np

from ..functions import kernels as K
from .options import FlowOptions, LiveOptions, get_backend, register_backend


def _named(order):
    def solve(fixed, moving, **options):
        return K.displacement(fixed, moving, order=order, **options)

    return solve


for _order in ("lexicographic", "redblack"):
    register_backend(_order, _named(_order))

INITIAL, CARRIED, REFRESHED = 22, 20, 100
WORK_BYTES, WORK_COPIES = 256 << 20, 40  # what a solve may take, and how many times a slice's bytes it takes (36 were measured)


def slices_of(stack: np.ndarray) -> list[slice]:
    """Consecutive slices of frames that are solved together: as many as ``WORK_BYTES`` allow, at least one."""
    step = max(1, WORK_BYTES // (WORK_COPIES * 8 * max(1, int(np.prod(stack.shape[1:])))))
    return [slice(a, a + step) for a in range(0, len(stack), step)]


def warped(stack: np.ndarray, flow: np.ndarray, fill: np.ndarray, method: str) -> np.ndarray:
    """Frames moved by their flows, a slice at a time; ``fill`` is one frame."""
    parts = [K.warp(stack[s], flow[s, ..., 0], flow[s, ..., 1], np.broadcast_to(fill, stack[s].shape), method) for s in slices_of(stack)]
    return np.concatenate(parts)


def value_range(reference: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray]:
    axes = (0, 1) if mode == "separate" else None
    return reference.min(axes), reference.max(axes)


class Corrector:
    """Registers batches of one recording to a reference, in order."""

    def __init__(self, reference: np.ndarray, options: FlowOptions, solver=None):
        self.raw, self.options = np.asarray(reference, float), options
        self.solver = solver or get_backend(options.flow_backend)
        self.range = value_range(self.raw, options.channel_normalization)
        self.proc = self.prepared(self.raw[None], temporal=False)[0]
        self.start: np.ndarray | None = None

    def prepared(self, stack: np.ndarray, temporal: bool = True) -> np.ndarray:
        """Normalised by the raw reference's range, then smoothed in space and, inside the batch, in time."""
        low, high = self.range
        x = (stack - low) / (high - low + 1e-8)
        planes = []
        for c in range(x.shape[-1]):
            sy, sx, st = self.options.sigma_at(c)
            p = K.gaussian(x[..., c], (sy, sx))
            planes.append(K.convolve(p, K.gaussian_weights(st), 0) if temporal and st > 0 else p)
        return np.stack(planes, -1)

    def solve(self, proc: np.ndarray, start: np.ndarray, rigid: bool) -> np.ndarray:
        """Flows from a start; with rigid pre-alignment the start and the shift are applied first and the rest is solved from zero. Frames do not depend on each other, so memory follows the slice."""
        return np.concatenate([self._solve(proc[s], start, rigid) for s in slices_of(proc)])

    def _solve(self, proc: np.ndarray, start: np.ndarray, rigid: bool) -> np.ndarray:
        o = self.options.solver_options(proc.shape[-1])
        if not rigid:
            return self.solver(self.proc, proc, uv=start, **o)
        moved = warped(proc, np.broadcast_to(start, (*proc.shape[:3], 2)), self.proc, "linear")
        shift = K.rigid_shift(self.proc, moved, self.options.cc_hw, self.options.cc_up, self.options.weights_for(proc.shape[-1]))
        both = start + shift[:, None, None, :]
        moved = warped(proc, both, self.proc, "linear").astype(float)
        return both + self.solver(self.proc, moved, uv=None, **o)

    def batch(self, stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(registered frames, flows) of the next batch."""
        o = self.options
        proc = self.prepared(stack)
        zero = np.zeros((*stack.shape[1:3], 2))
        if self.start is None:
            self.start = zero
            if o.update_initialization_w:
                head = proc[:INITIAL]
                self.start = self.solve(head, zero, o.cc_initialization and len(head) > 4).mean(0)
        flow = self.solve(proc, self.start, o.cc_initialization)
        registered = warped(stack, flow, self.raw, o.interpolation_method)
        if o.update_initialization_w:
            self.start = flow[-CARRIED:].mean(0)
        if o.update_reference:
            last = slice(-REFRESHED, None)
            self.proc = warped(proc[last], flow[last], self.proc, o.interpolation_method).astype(float).mean(0)
        return registered, flow


def preregistered(stack: np.ndarray, options: FlowOptions) -> np.ndarray:
    """A reference from some frames: the mean of the frames as registered to the mean of their smoothed, normalised selves, with two more of alpha."""
    planes = []
    for c in range(stack.shape[-1]):
        sy, sx, st = options.sigma_at(c)
        planes.append(K.convolve(K.gaussian(stack[..., c].astype(float), (sy + 1, sx + 1)), K.gaussian_weights(st + 0.5), 0))
    smooth = np.stack(planes, -1)
    axes = (0, 1, 2) if options.channel_normalization == "separate" else None
    low, high = smooth.min(axes), smooth.max(axes)
    smooth = (smooth - low) / (high - low + 1e-8)
    same = ("levels", "eta", "update_lag", "iterations", "a_smooth", "a_data", "constancy_assumption", "weight", "buffer_size")
    draft = FlowOptions(alpha=tuple(a + 2 for a in options.alpha), min_level=options.effective_min_level(), quality_setting="custom", **{k: getattr(options, k) for k in same})
    tool, size = Corrector(smooth.mean(0), draft), options.buffer_size
    flow = np.concatenate([tool.batch(smooth[a : a + size])[1] for a in range(0, len(smooth), size)])
    return warped(stack, flow, stack.mean(0), "cubic").astype(float).mean(0)


class LiveCorrector:
    """Registers one frame at a time: causal smoothing, warm start, and a reference that follows slowly."""

    def __init__(self, options: LiveOptions | None = None, reference: np.ndarray | None = None, solver=None):
        self.options = options or LiveOptions()
        self.solver = solver
        self.waiting: list[np.ndarray] = []
        self.proc = self.raw = self.flow = None
        self.recent: list[np.ndarray] = []
        self.count = 0
        if reference is not None:
            self.set_reference(reference)

    def set_reference(self, frames: np.ndarray | None = None) -> None:
        """From one frame (h, w, c), a stack (t, h, w, c), or what has been buffered."""
        if frames is None:
            if not self.waiting:
                raise ValueError("no frames are buffered")
            frames = np.stack(self.waiting)
        self.raw = preregistered(frames, self.options.flow) if frames.ndim == 4 else np.asarray(frames, float)
        self.range = value_range(self.raw, self.options.flow.channel_normalization)
        self.proc = self._spatial(self.raw)
        self.flow, self.recent, self.waiting = np.zeros((*self.raw.shape[:2], 2)), [], []

    def reset_reference(self) -> None:
        self.proc = self.raw = self.flow = None
        self.recent, self.count = [], 0

    def snapshot(self) -> dict:
        """All state but the options, as plain values."""
        return {k: v for k, v in vars(self).items() if k not in ("options", "solver")}

    @classmethod
    def resumed(cls, options: LiveOptions, state: dict) -> LiveCorrector:
        out = cls(options)
        vars(out).update(state)
        return out

    def set_flow_init(self, flow: np.ndarray) -> None:
        self.flow = np.asarray(flow, float)

    def _spatial(self, frame: np.ndarray) -> np.ndarray:
        low, high = self.range
        sy, sx, _ = self.options.flow.sigma_at(0)
        x = (frame - low) / (high - low + 1e-8)
        return np.stack([K.gaussian(x[None, ..., c], (sy, sx))[0] for c in range(x.shape[-1])], -1)

    def __call__(self, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(registered frame, flow); before there is a reference, the frame itself and zero."""
        frame = np.asarray(frame, float)
        if self.raw is None:
            self.waiting = [*self.waiting, frame][-self.options.buffer :]
            return frame, np.zeros((*frame.shape[:2], 2))
        o = self.options.flow
        sigma = max(s[2] for s in o.sigma)
        depth = int(self.options.truncate * sigma + 0.5) + 1
        self.recent = [*self.recent, self._spatial(frame)][-depth:]
        w = K.half_weights(sigma, len(self.recent), self.options.truncate).astype(float)
        smooth = sum(a * f for a, f in zip(w, self.recent[::-1], strict=False))
        self.flow = (self.solver or get_backend(o.flow_backend))(self.proc, smooth[None], uv=self.flow, **o.solver_options(frame.shape[-1]))[0]
        u, v = self.flow[None, ..., 0], self.flow[None, ..., 1]
        registered = K.warp(frame[None], u, v, self.raw[None], o.interpolation_method)[0]
        self.count += 1
        if self.count % self.options.update_interval == 0:
            share = self.options.update_weight
            seen = K.warp(smooth[None], u, v, self.proc[None], o.interpolation_method)[0]
            self.proc, self.raw = (1 - share) * self.proc + share * seen, (1 - share) * self.raw + share * registered
            self.range = value_range(self.proc, o.channel_normalization)
        return registered, self.flow

    def register_frames(self, frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(registered frames, flows) of consecutive frames."""
        pairs = [self(f) for f in frames]
        return np.stack([p[0] for p in pairs]), np.stack([p[1] for p in pairs])

    def get_current_flow(self) -> np.ndarray | None:
        """The flow of the last frame, from which the next one starts."""
        return None if self.flow is None else self.flow.copy()
