"""Column functions on frame arrays and scalars; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGES = {"uint8": (0, 255), "uint16": (0, 65535), "int16": (-32768, 32767), "int32": (-2147483648, 2147483647)}
PSI_EPSILON = 1e-5


def zeros_like(data: Column) -> Column:
    return F.transform(data, lambda x: F.lit(0.0))


def normalized(data: Column, low: Column, high: Column, eps: float = 1e-8) -> Column:
    """(x - low) / (high - low + eps), not clipped."""
    return F.transform(data, lambda x: (x - low) / (high - low + F.lit(eps)))


def normalized_channels(data: Column, low: Column, high: Column, channels: Column, eps: float = 1e-8) -> Column:
    """As ``normalized`` with arrays of bounds, one for each channel of interleaved data."""

    def one(x, i):
        k = (i % channels + 1).cast("int")
        return (x - F.element_at(low, k)) / (F.element_at(high, k) - F.element_at(low, k) + F.lit(eps))

    return F.transform(data, one)


def clip_cast(data: Column, dtype: str) -> Column:
    """Integers are clipped to the type's range, rounded half to even; other types pass."""
    if dtype not in RANGES:
        return data
    low, high = RANGES[dtype]
    return F.transform(data, lambda x: F.rint(F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))))


def truncated(data: Column, dtype: str) -> Column:
    """Assignment of floats to an integer type: cut towards zero, clipped where the type ends."""
    low, high = RANGES[dtype]
    return F.transform(data, lambda x: F.least(F.greatest(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"), F.lit(float(low))), F.lit(float(high))))


def quantized(data: Column) -> Column:
    """[0, 1] to 0..255, cut."""
    return F.transform(data, lambda x: F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 255).cast("double"))


def weighted_gray(data: Column, weights: list[float]) -> Column:
    """One channel: the weighted mean of interleaved channels, weights normalised."""
    n, total = len(weights), float(sum(weights))
    pixels = F.sequence(F.lit(0), (F.size(data) / n - 1).cast("int"))
    return F.transform(pixels, lambda p: sum((F.element_at(data, p * n + k + 1) * F.lit(w / total) for k, w in enumerate(weights)), F.lit(0.0)))


def charbonnier(s: Column, a: float) -> Column:
    return F.lit(a) * F.pow(F.greatest(s, F.lit(0.0)) + F.lit(PSI_EPSILON), F.lit(a - 1))


def gnc_blend(weight: Column, a: float, beta: float) -> Column:
    return F.lit(1 - beta) + F.lit(beta) * weight if 0 < a < 1 and beta < 1 else weight


def planar(data: Column, channels: Column) -> Column:
    """Interleaved (H, W, C) to planar (C, H, W)."""
    n = (F.size(data) / channels).cast("int")
    return F.transform(F.sequence(F.lit(0), F.size(data) - 1), lambda i: F.element_at(data, ((i % n) * channels + F.floor(i / n)).cast("int") + 1))


def effective_min_level(quality: Column, min_level: Column) -> Column:
    named = F.when(quality == "quality", 0).when(quality == "balanced", 4).when(quality == "fast", 6).otherwise(0)
    return F.when(min_level >= 0, min_level).otherwise(named).cast("long")


def depth_of(side: Column, eta: float, levels: int) -> Column:
    """Pyramid levels until the side rounds to under 10; the level that does so counts."""
    counted = F.filter(F.sequence(F.lit(1), F.lit(levels)), lambda k: F.rint(side * F.pow(F.lit(eta), k)) < 10)
    return F.coalesce(F.element_at(counted, 1), F.lit(levels)).cast("long")
