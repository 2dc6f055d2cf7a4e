"""Operators along the time axis of recordings: selection, binning, batches, channel joins, means.

Means over many frames are taken in two steps: each task sums its frames per
group in numpy and emits one partial sum per group and batch, and only these
partial sums are shuffled, so a recording of millions of frames costs a few
frames of shuffle per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counted(frames: DataFrame, bin_size: int = 1) -> DataFrame:
    """rec_id, n_frames, n_bins of each recording."""
    n = frames.groupBy("rec_id").agg(F.count("*").alias("n_frames"))
    return n.withColumn("n_bins", F.ceil(F.col("n_frames") / bin_size).cast("long"))


def binned(frames: DataFrame, size: int, padded: bool) -> DataFrame:
    """Element-wise means of ``size`` consecutive frames.

    The last bin may be partial: ``padded`` repeats its last frame up to the full
    size (batch reading), else only existing frames count (indexed access).
    """
    rows = frames.groupBy("rec_id", F.floor(F.col("t") / size).alias("bin")).agg(F.first("h").alias("h"), F.first("w").alias("w"), F.first("c").alias("c"), F.array_sort(F.collect_list(F.struct("t", "data"))).alias("own"))
    data = F.transform("own", lambda x: x["data"])
    total = F.aggregate(data, F.transform(F.element_at(data, 1), lambda x: F.lit(0.0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    n = F.size("own")
    if padded:
        mean = F.zip_with(total, F.element_at(data, -1), lambda a, b: (a + b * (F.lit(size) - n)) / F.lit(float(size)))
    else:
        mean = F.transform(total, lambda a: a / n)
    return rows.select("rec_id", F.col("bin").alias("t"), "h", "w", "c", mean.alias("data"))


def sliced(frames: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Frames of a Python slice of each recording, numbered anew in the slice's order."""
    n = F.col("n_frames")
    bound = lambda x, low, high: F.least(F.greatest(F.lit(x) + F.when(F.lit(x) < 0, n).otherwise(0), low), high)
    first = bound(start, F.lit(0), n) if start is not None else (F.lit(0) if step > 0 else n - 1)
    last = bound(stop, F.lit(0), n) if stop is not None else (n if step > 0 else F.lit(-1))
    joined = frames.join(counted(frames).select("rec_id", "n_frames"), "rec_id")
    k = F.col("t") - first
    inside = (F.col("t") >= first) & (F.col("t") < last) if step > 0 else (F.col("t") <= first) & (F.col("t") > last)
    return joined.where(inside & (k % step == 0)).withColumn("k", F.floor(k / step)).drop("n_frames")


def selected(frames: DataFrame, indices: list[int]) -> DataFrame:
    """Frames by index; order and repeats are those of ``indices``, negative ones count from the end."""
    wanted = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(i).cast("long").alias("i")) for k, i in enumerate(indices)])
    recordings = counted(frames).select("rec_id", "n_frames", F.inline(wanted))
    recordings = recordings.withColumn("t", F.when(F.col("i") < 0, F.col("i") + F.col("n_frames")).otherwise(F.col("i"))).select("rec_id", "k", "t")
    return frames.join(recordings, ["rec_id", "t"])


def batched(frames: DataFrame, size: int) -> DataFrame:
    return frames.withColumn("batch", F.floor(F.col("t") / size))


def batch_ranges(frames: DataFrame, size: int) -> DataFrame:
    """rec_id, batch, first frame, end, number of frames and running number so far."""
    rows = batched(frames, size).groupBy("rec_id", "batch").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("stop"), F.count("*").alias("n"))
    return rows.withColumn("done", F.sum("n").over(Window.partitionBy("rec_id").orderBy("batch")))


def with_halo(frames: DataFrame, size: int, halo: int) -> DataFrame:
    """Frames of each batch and up to ``halo`` real frames of the adjacent batches; role is left, core or right."""
    b = F.floor(F.col("t") / size)
    place = F.col("t") % size
    last = F.col("last_batch")
    ends = frames.groupBy("rec_id").agg(F.floor(F.max("t") / size).alias("last_batch"))
    targets = F.array_compact(F.array(F.struct(b.alias("batch"), F.lit("core").alias("role")), F.when((place >= size - halo) & (b < last), F.struct((b + 1).alias("batch"), F.lit("left").alias("role"))), F.when((place < halo) & (b > 0), F.struct((b - 1).alias("batch"), F.lit("right").alias("role")))))
    return frames.join(ends, "rec_id").withColumn("target", F.explode(targets)).select(*frames.columns, "target.batch", "target.role")


def channels(frames: DataFrame, chosen: list[int]) -> DataFrame:
    """Frames with some of their channels, in the order given; a number that a frame does not have is an error."""
    spots = F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)
    data = F.flatten(F.transform(spots, lambda p: F.array(*[F.element_at("data", p * F.col("c") + k + 1) for k in chosen])))
    there = F.assert_true(F.lit(min(chosen) >= 0) & (F.lit(max(chosen)) < F.col("c")), "no such channel")
    # the arrays first: inside a lambda a name would mean the select's own new column
    rest = [n for n in frames.columns if n not in ("c", "data")]
    return frames.withColumn("picked", F.when(there.isNull(), data)).select(*rest, F.lit(len(chosen)).alias("c"), F.col("picked").alias("data"))


def zipped_channels(parts: list[DataFrame]) -> DataFrame:
    """Recordings with the same frames, their channels side by side; an inner join on (rec_id, t)."""
    out = parts[0]
    for k, part in enumerate(parts[1:]):
        names = {n: f"{n}_{k}" for n in ("h", "w", "c", "data")}
        right = part.select("rec_id", "t", *(F.col(a).alias(b) for a, b in names.items()))
        joined = out.join(right, ["rec_id", "t"]).where((F.col("h") == F.col(names["h"])) & (F.col("w") == F.col(names["w"])))
        spots = F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)
        both = F.flatten(F.transform(spots, lambda p: F.concat(F.slice("data", p * F.col("c") + 1, F.col("c")), F.slice(names["data"], p * F.col(names["c"]) + 1, F.col(names["c"])))))  # noqa: B023
        # the arrays first: inside a lambda a name would mean the select's own new column
        out = joined.withColumn("both", both).select("rec_id", "t", "h", "w", (F.col("c") + F.col(names["c"])).alias("c"), F.col("both").alias("data"))
    return out


def deinterleaved(pages: DataFrame, channels: int) -> DataFrame:
    """Pages of one channel each, stored in turn, as frames of ``channels`` channels; an incomplete last frame is dropped."""
    rows = pages.groupBy("rec_id", F.floor(F.col("t") / channels).alias("frame")).agg(F.first("h").alias("h"), F.first("w").alias("w"), F.array_sort(F.collect_list(F.struct("t", "data"))).alias("own")).where(F.size("own") == channels)
    spots = F.sequence(F.lit(1), F.col("h") * F.col("w"))
    data = F.flatten(F.transform(spots, lambda p: F.transform("own", lambda x: F.element_at(x["data"], p))))
    return rows.select("rec_id", F.col("frame").alias("t"), "h", "w", F.lit(channels).alias("c"), data.alias("data"))


def interleaved(frames: DataFrame) -> DataFrame:
    """Each channel as a page of its own: page t * c + ch."""
    rows = frames.withColumn("ch", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    spots = F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)
    data = F.transform(spots, lambda p: F.element_at("data", (p * F.col("c") + F.col("ch") + 1).cast("int")))
    rows = rows.withColumn("page", data)
    return rows.select("rec_id", (F.col("t") * F.col("c") + F.col("ch")).alias("t"), "h", "w", F.lit(1).alias("c"), F.col("page").alias("data"))


def ranked(frames: DataFrame, last: bool) -> DataFrame:
    """With the number k (from 1) of each frame from the start or the end of its recording."""
    order = F.col("t").desc() if last else F.col("t").asc()
    return frames.withColumn("k", F.row_number().over(Window.partitionBy("rec_id").orderBy(order)))


def mean_frames(frames: DataFrame, by: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """The mean frame of each group, and the number of frames; an infinite or missing value raises an error."""
    keys = list(by)
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema.fields}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, list] = {}
            columns = [batch.column(k).to_pylist() for k in (*keys, "h", "w", "c")]
            for i, key in enumerate(zip(*columns, strict=True)):
                groups.setdefault(key, []).append(i)
            rows = []
            for key, members in groups.items():
                taken = batch.column("data").take(pa.array(members))
                stack = taken.flatten().to_numpy(zero_copy_only=False).reshape(len(members), -1)
                if not np.isfinite(stack).all():
                    raise ValueError("a mean needs finite values")
                rows.append((*key, stack.sum(0), len(members)))
            if rows:
                names = [*keys, "h", "w", "c", "part", "n"]
                types = [batch.schema.field(k).type for k in (*keys, "h", "w", "c")] + [pa.list_(pa.float64()), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = ", ".join(f"{k} {kinds[k]}" for k in (*keys, "h", "w", "c")) + ", part array<double>, n bigint"
    parts = frames.select(*keys, "h", "w", "c", "data").mapInArrow(partial, schema)
    spread = parts.select(*keys, "h", "w", "c", "n", F.posexplode("part").alias("i", "v"))
    sums = spread.groupBy(*keys, "h", "w", "c", "i").agg((F.sum("v") / F.sum("n")).alias("v"), F.sum("n").alias("n"))
    out = sums.groupBy(*keys, "h", "w", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("data"), F.max("n").alias("n"))
    return out


def first_mean(frames: DataFrame, k: int) -> DataFrame:
    return mean_frames(ranked(frames, last=False).where(F.col("k") <= k))


def last_mean(frames: DataFrame, k: int) -> DataFrame:
    return mean_frames(ranked(frames, last=True).where(F.col("k") <= k))


def bounds(frames: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Least and greatest value over all frames of each group (of all, by default)."""
    return frames.groupBy(*by).agg(F.min(F.array_min("data")).alias("low"), F.max(F.array_max("data")).alias("high"))


def channel_bounds(frames: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """As ``bounds``, an array with one value for each channel."""
    one = lambda k: F.filter("data", lambda x, i: i % F.col("c") == k)
    per = frames.withColumn("ch", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    per = per.groupBy(*by, "ch").agg(F.min(F.array_min(one(F.col("ch")))).alias("low"), F.max(F.array_max(one(F.col("ch")))).alias("high"))
    pick = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("ch", name))), lambda x: x[name])
    return per.groupBy(*by).agg(pick("low").alias("low"), pick("high").alias("high"))


def pending(work: DataFrame, status: DataFrame, keys: list[str]) -> DataFrame:
    """Work that is not done yet."""
    return work.join(status.where("state = 'done'").select(*keys).distinct(), keys, "left_anti")


def center_recording(names: DataFrame, column: str = "rec_id") -> DataFrame:
    """The lexicographic middle, (n + 1) // 2 counted from 1."""
    ordered = names.select(column).distinct().withColumn("k", F.row_number().over(Window.orderBy(column)))
    n = ordered.agg(F.count("*").alias("n"))
    return ordered.crossJoin(F.broadcast(n)).where("k = (n + 1) div 2").select(column)
