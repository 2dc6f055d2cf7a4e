"""Options of the pipelines: names, defaults and checks."""

from __future__ import annotations

import json
import warnings
from pathlib import Path
from typing import Any, Literal

import numpy as np
from pydantic import BaseModel, ConfigDict, Field, field_validator

CONSTANCY = {"gc": "gc", "gradient": "gc", "gray": "gray", "brightness": "gray", "cs": "cs", "census": "cs"}
LEVELS = {"quality": 0, "balanced": 4, "fast": 6}

_BACKENDS: dict[str, Any] = {}


def register_backend(name: str, solver) -> None:
    """Makes a displacement function (reference, frames, **options) available by name."""
    _BACKENDS[name] = solver


def get_backend(name: str):
    if name not in _BACKENDS:
        raise ValueError(f"unknown backend {name}; known are {', '.join(list_backends())}")
    return _BACKENDS[name]


def list_backends() -> list[str]:
    return sorted(_BACKENDS)


def is_backend_available(name: str) -> bool:
    return name in _BACKENDS


class FlowOptions(BaseModel):
    """Motion correction of recordings; unknown names are refused.

    Names and defaults are fixed values of the interface. ``n_references`` beyond one
    means the one reference again, and ``min_frames_per_reference`` then has no effect.
    """

    model_config = ConfigDict(extra="forbid", arbitrary_types_allowed=True, validate_assignment=True)

    input_file: Any = None
    output_path: str = "results"
    output_format: str = "MAT"
    output_file_name: str | None = None
    naming_convention: Literal["default", "batch"] = "default"
    channel_idx: list[int] | None = None
    verbose: bool = False
    save_meta_info: bool = True
    save_valid_idx: bool = False
    n_references: int = Field(1, ge=1)
    min_frames_per_reference: int = Field(20, ge=1)
    get_displacement_impl: Any = Field(None, exclude=True)
    get_displacement_factory: Any = Field(None, exclude=True)
    alpha: tuple[float, float] = (1.5, 1.5)
    weight: list[float] = [0.5, 0.5]
    levels: int = Field(100, ge=1)
    min_level: int = Field(-1, ge=-1)
    quality_setting: Literal["quality", "balanced", "fast", "custom"] = "quality"
    eta: float = Field(0.8, gt=0, le=1)
    update_lag: int = Field(5, ge=1)
    iterations: int = Field(50, ge=1)
    a_smooth: float = Field(1.0, ge=0)
    a_data: float = Field(0.45, gt=0, le=1)
    gnc_schedule: tuple[float, ...] | None = None
    warping_steps: int | None = Field(None, ge=1)
    sigma: list[list[float]] = [[1.0, 1.0, 0.1], [1.0, 1.0, 0.1]]
    bin_size: int = Field(1, ge=1)
    buffer_size: int = Field(400, ge=1)
    reference_frames: list[int] | str | np.ndarray = Field(default_factory=lambda: list(range(50, 500)))
    update_reference: bool = False
    update_initialization_w: bool = True
    save_w: bool = False
    save_valid_mask: bool = False
    output_typename: Literal["single", "double", "uint8", "uint16", "int16", "int32"] = "double"
    channel_normalization: Literal["joint", "separate"] = "joint"
    interpolation_method: Literal["cubic", "linear"] = "cubic"
    cc_initialization: bool = False
    cc_hw: tuple[int, int] = (256, 256)
    cc_up: int = Field(1, ge=1)
    constancy_assumption: str = "gc"
    flow_backend: str = "lexicographic"
    backend_params: dict[str, Any] = {}

    @field_validator("alpha", mode="before")
    @classmethod
    def _alpha(cls, v):
        pair = (v, v) if np.isscalar(v) else tuple(v)
        if len(pair) == 1:
            pair = pair * 2
        if len(pair) != 2 or min(pair) <= 0:
            raise ValueError("alpha is one or two numbers over 0")
        return pair

    @field_validator("weight", mode="before")
    @classmethod
    def _weight(cls, v):
        v = [float(x) for x in np.atleast_1d(v)]
        if min(v) < 0 or sum(v) <= 0:
            raise ValueError("weights are at least 0 and not all 0")
        return [x / sum(v) for x in v]

    @field_validator("sigma", mode="before")
    @classmethod
    def _sigma(cls, v):
        v = np.atleast_2d(np.asarray(v, float))
        if v.shape[1] != 3 or (v < 0).any():
            raise ValueError("sigma has three numbers of at least 0 for each channel")
        return v.tolist()

    @field_validator("cc_hw", mode="before")
    @classmethod
    def _cc_hw(cls, v):
        return (v, v) if np.isscalar(v) else tuple(v)

    @field_validator("reference_frames", "output_path", mode="before")
    @classmethod
    def _path(cls, v):
        return str(v) if isinstance(v, Path) else v

    @field_validator("n_references")
    @classmethod
    def _one_reference(cls, v):
        if v > 1:
            warnings.warn("several references mean one reference again", stacklevel=2)
        return v

    @field_validator("constancy_assumption")
    @classmethod
    def _constancy(cls, v):
        if v.lower() not in CONSTANCY:
            raise ValueError(f"constancy is one of {', '.join(CONSTANCY)}")
        return CONSTANCY[v.lower()]

    @field_validator("gnc_schedule")
    @classmethod
    def _schedule(cls, v):
        if v is not None and (not v or min(v) < 0 or max(v) > 1 or list(v) != sorted(v)):
            raise ValueError("a schedule rises within [0, 1]")
        return v

    def effective_min_level(self) -> int:
        return self.min_level if self.min_level >= 0 else LEVELS.get(self.quality_setting, 0)

    def sigma_at(self, channel: int) -> list[float]:
        """The channel's sigma, or the first one's."""
        return self.sigma[channel] if channel < len(self.sigma) else self.sigma[0]

    def weights_for(self, channels: int) -> np.ndarray:
        """Extra weights are cut and the rest renormalised; missing ones are 1 / channels."""
        if len(self.weight) >= channels:
            w = np.array(self.weight[:channels])
            return w / w.sum()
        return np.array([*self.weight, *[1 / channels] * (channels - len(self.weight))])

    def solver_options(self, channels: int) -> dict[str, Any]:
        return {
            "alpha": self.alpha, "update_lag": self.update_lag, "iterations": self.iterations, "min_level": self.effective_min_level(), "levels": self.levels, "eta": self.eta,
            "a_smooth": self.a_smooth, "a_data": self.a_data, "constancy": self.constancy_assumption, "weight": self.weights_for(channels), "gnc_schedule": self.gnc_schedule,
            "warping_steps": self.warping_steps, **self.backend_params,
        }

    def solver(self):
        """The displacement function: one that was given, else what a given factory makes of ``backend_params``, else the named backend."""
        if self.get_displacement_impl:
            return self.get_displacement_impl
        return self.get_displacement_factory(**self.backend_params) if self.get_displacement_factory else get_backend(self.flow_backend)

    def save(self, path: str) -> None:
        """As JSON after one line of text; a reference that is an array goes into an NPY file beside it, an input that is no path is left out."""
        plain = self.model_copy()
        if isinstance(plain.reference_frames, np.ndarray):
            beside = f"{path}.reference.npy"
            np.save(beside, plain.reference_frames)
            plain = plain.model_copy(update={"reference_frames": beside})
        if not isinstance(plain.input_file, str | list | None):
            plain = plain.model_copy(update={"input_file": str(plain.input_file) if isinstance(plain.input_file, Path) else None})
        Path(path).write_text("Options of motion correction\n" + plain.model_dump_json(indent=2))

    @classmethod
    def load(cls, path: str) -> FlowOptions:
        """Reads from the first line that starts with a brace."""
        lines = Path(path).read_text().splitlines(keepends=True)
        start = next(k for k, line in enumerate(lines) if line.startswith("{"))
        return cls(**json.loads("".join(lines[start:])))


class SessionOptions(BaseModel):
    """Several recordings to one common frame."""

    model_config = ConfigDict(extra="forbid")

    center: str | None = None
    resume: bool = True
    sigma_smooth: float = Field(6.0, ge=0)
    alpha_between: float = Field(25.0, gt=0)
    iterations_between: int = Field(100, ge=1)
    cc_upsample: int = Field(4, ge=1)
    constancy_between: str = "gc"
    flow_options: dict[str, Any] = {}


PROTECTED = ("input_file", "output_path", "output_format", "output_file_name", "naming_convention", "reference_frames")


class DepthOptions(BaseModel):
    """Depth alignment: stage 1 registers the stack of the volume, stage 2 finds depths and corrects, stage 3 simulates.

    ``stack_scans_per_slice`` scans of a slice follow each other in the stack: each slice
    is then a buffer of its own, the reference follows, and the scans are averaged.
    """

    model_config = ConfigDict(extra="forbid")

    win_half: int = Field(10, ge=1)
    patch_size: int = Field(128, ge=1)
    overlap: float = Field(0.75, ge=0, lt=1)
    spatial_sigma: float = Field(1.5, ge=0)
    temporal_sigma: float = Field(1.5, ge=0)
    smooth_spatial: float = Field(5.0, ge=0)
    smooth_temporal: float = Field(1.5, ge=0)
    tau_scale: float = Field(1e-3, ge=0)
    input_buffer: int = Field(50, ge=1)
    input_bin_size: int = Field(1, ge=1)
    output_dtype: str = "uint16"
    prealign_stack: bool = True
    prealign_recording: bool = False
    write_corrected: bool = True
    write_simulated: bool = True
    resume: bool = True
    reference_source_frames: int = Field(2000, ge=1)
    reference_source_bin_size: int = Field(20, ge=1)
    stage1_alpha: float = Field(5.0, gt=0)
    stage1_quality_setting: str = "quality"
    stage1_buffer_size: int = Field(500, ge=1)
    stage1_bin_size: int = Field(1, ge=1)
    stage1_update_reference: bool = True
    stack_scans_per_slice: int | None = Field(None, ge=1)
    volume_bin_size: int = Field(1, ge=1)
    flow_backend: str = "lexicographic"
    backend_params: dict[str, Any] = {}
    stage1_flow_options: dict[str, Any] = {}
    recording_prealign_flow_options: dict[str, Any] = {}

    def stack_flow(self) -> FlowOptions:
        """How stage 1 registers the stack; input, output and reference cannot be overridden."""
        scans = self.stack_scans_per_slice
        own = {k: v for k, v in self.stage1_flow_options.items() if k not in PROTECTED}
        fixed = {"buffer_size": scans, "update_reference": True} if scans else {}
        base = {"buffer_size": self.stage1_buffer_size, "bin_size": self.stage1_bin_size, "update_reference": self.stage1_update_reference}
        return FlowOptions(**self._shared() | base | own | fixed)

    def recording_flow(self) -> FlowOptions:
        own = {k: v for k, v in self.recording_prealign_flow_options.items() if k not in PROTECTED}
        return FlowOptions(**self._shared() | {"buffer_size": self.input_buffer, "bin_size": self.input_bin_size} | own)

    def _shared(self) -> dict[str, Any]:
        return {"alpha": self.stage1_alpha, "quality_setting": self.stage1_quality_setting, "flow_backend": self.flow_backend, "backend_params": self.backend_params}


class LiveOptions(BaseModel):
    model_config = ConfigDict(extra="forbid")

    buffer: int = Field(50, ge=1)
    update_interval: int = Field(20, ge=1)
    update_weight: float = Field(0.2, ge=0, le=1)
    truncate: float = 4.0
    flow: FlowOptions = Field(default_factory=lambda: FlowOptions(quality_setting="fast"))
