"""Registered frame queries over the provided tables, each with the same computation in SQL.

``embeddings`` rows are read as frames of 8 x 8 pixels, t = vec_id, or as 8 x 4
frames of two channels; ``label`` names the recording where there are several,
and frames are then numbered within it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import kernels as K
from ..operators import frames as fr
from ..operators import motion as mo
from ..operators import sequence as sq
from ..sources import formats, metadata
from . import depth, registration
from .options import DepthOptions, FlowOptions, LiveOptions

QUERIES: dict = {}
SQL: dict = {}

PX = "px AS (SELECT vec_id AS t, label::VARCHAR AS rec_id, i // 8 AS y, i % 8 AS x, embedding[i + 1]::DOUBLE AS val FROM embeddings, (SELECT unnest(range(64)) AS i))"
PX2 = "p2 AS (SELECT vec_id AS t, i // 8 AS y, (i // 2) % 4 AS x, i % 2 AS ch, embedding[i + 1]::DOUBLE AS val FROM embeddings, (SELECT unnest(range(64)) AS i))"
SESSION = "nr AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings), sx AS (SELECT k AS t, label::VARCHAR AS rec_id, i // 8 AS y, i % 8 AS x, embedding[i + 1]::DOUBLE AS val FROM nr, (SELECT unnest(range(64)) AS i))"
FLOW = "fl AS (SELECT t, y, x, val, 0.75 * sin(y + 0.1 * (t % 7)) AS u, 0.5 * cos(x - 0.2 * (t % 5)) AS v FROM px)"
RING = "ring AS (SELECT t, y, x, val FROM px UNION ALL SELECT t, y + 8 * sy, x + 8 * sx, NULL FROM px, (SELECT 9 AS sy, 9 AS sx) WHERE false)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gray(spark, sf_dir, recordings: bool = False) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return fr.frames(df, F.col("embedding"), 8, 8, t="vec_id", rec_id=F.col("label") if recordings else None)


def color(spark, sf_dir) -> DataFrame:
    return fr.frames(table(spark, sf_dir, "embeddings"), F.col("embedding"), 8, 4, 2, t="vec_id")


def sessions(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    return fr.frames(df, F.col("embedding"), 8, 8, t="k", rec_id=F.col("label"))


def with_flow(df: DataFrame) -> DataFrame:
    """A smooth synthetic field, the same on both sides of a comparison."""
    at = F.sequence(F.lit(0), F.lit(63))
    u = F.transform(at, lambda i: F.lit(0.75) * F.sin(F.floor(i / 8) + F.lit(0.1) * (F.col("t") % 7)))
    v = F.transform(at, lambda i: F.lit(0.5) * F.cos(i % 8 - F.lit(0.2) * (F.col("t") % 5)))
    return df.withColumn("u", u).withColumn("v", v)


def out(df: DataFrame, array: str = "data", width: int = 8, channels: int = 1, digits: int = 6, more: tuple[str, ...] = ("t",), value: str = "val") -> DataFrame:
    """Arrays as rows (more..., y, x[, ch], value), rounded."""
    i = F.col("i").cast("long")
    rows = df.select(*more, F.posexplode(array).alias("i", "v"))
    place = [F.floor(i / (width * channels)).alias("y"), (F.floor(i / channels) % width).alias("x")] + ([(i % channels).alias("ch")] if channels > 1 else [])
    return rows.select(*more, *place, rounded(F.col("v"), digits).alias(value))


def rounded(x, digits: int = 6):
    return F.round(x.cast("double"), digits) + F.lit(0.0)


def reference(spark, sf_dir) -> np.ndarray:
    return fr.one_frame(sq.mean_frames(gray(spark, sf_dir)))


# -- sources and selection ---------------------------------------------------


@query(f"WITH {PX} SELECT t, y, x, round(val, 6) + 0.0 AS val FROM px")
def pixels_explode(spark, sf_dir):
    return out(gray(spark, sf_dir))


@query(f"WITH {PX2} SELECT t, ch, y * 4 + x AS p, round(val, 6) + 0.0 AS val FROM p2")
def planar_order(spark, sf_dir):
    rows = color(spark, sf_dir).select("t", F.posexplode(C.planar(F.col("data"), F.col("c"))).alias("i", "v"))
    i = F.col("i").cast("long")
    return rows.select("t", F.floor(i / 32).alias("ch"), (i % 32).alias("p"), rounded(F.col("v")).alias("val"))


@query("SELECT label::VARCHAR AS rec_id, count(*) AS n_frames, (count(*) + 6) // 7 AS n_bins FROM embeddings GROUP BY label")
def frame_counts(spark, sf_dir):
    return sq.counted(gray(spark, sf_dir, recordings=True), 7)


_BINS = f"WITH {PX}, b AS (SELECT *, t // 7 AS bin, count(*) OVER (PARTITION BY t // 7, y, x) AS n, max(t) OVER (PARTITION BY t // 7, y, x) AS last FROM px)"


@query(f"{_BINS} SELECT bin AS t, y, x, round((sum(val) + sum(CASE WHEN t = last THEN val ELSE 0 END) * (7 - max(n))) / 7, 6) + 0.0 AS val FROM b GROUP BY bin, y, x")
def bin_readbatch(spark, sf_dir):
    return out(sq.binned(gray(spark, sf_dir), 7, padded=True))


@query(f"{_BINS} SELECT bin AS t, y, x, round(avg(val), 6) + 0.0 AS val FROM b GROUP BY bin, y, x")
def bin_index(spark, sf_dir):
    return out(sq.binned(gray(spark, sf_dir), 7, padded=False))


@query(f"WITH {SESSION}, n AS (SELECT rec_id, max(t) + 1 AS n FROM sx GROUP BY rec_id) SELECT rec_id, (t - greatest(n - 9, 0)) // 2 AS k, t, y, x, round(val, 6) + 0.0 AS val FROM sx JOIN n USING (rec_id) WHERE t >= greatest(n - 9, 0) AND t < n - 1 AND (t - greatest(n - 9, 0)) % 2 = 0")
def slice_negative(spark, sf_dir):
    return out(sq.sliced(sessions(spark, sf_dir), -9, -1, 2), more=("rec_id", "k", "t"))


_FANCY = [5, 2, 2, -1, 0, -3]


@query(f"WITH {SESSION}, n AS (SELECT rec_id, max(t) + 1 AS n FROM sx GROUP BY rec_id), w(k, i) AS (VALUES {', '.join(f'({k}, {i})' for k, i in enumerate(_FANCY))}) SELECT rec_id, k::BIGINT AS k, t, y, x, round(val, 6) + 0.0 AS val FROM n, w JOIN sx USING (rec_id) WHERE sx.t = CASE WHEN i < 0 THEN i + n ELSE i END".replace("FROM n, w JOIN sx USING (rec_id) WHERE", "FROM n CROSS JOIN w JOIN sx USING (rec_id) WHERE"))
def fancy_select(spark, sf_dir):
    return out(sq.selected(sessions(spark, sf_dir), _FANCY), more=("rec_id", "k", "t"))


@query("WITH b AS (SELECT vec_id // 40 AS batch, min(vec_id) AS start, max(vec_id) + 1 AS stop, count(*) AS n FROM embeddings GROUP BY 1) SELECT '0' AS rec_id, *, sum(n) OVER (ORDER BY batch)::BIGINT AS done FROM b")
def batch_ranges(spark, sf_dir):
    return sq.batch_ranges(gray(spark, sf_dir), 40)


@query("""WITH b AS (SELECT vec_id AS t, vec_id // 40 AS b, vec_id % 40 AS p, (SELECT max(vec_id) // 40 FROM embeddings) AS last FROM embeddings)
SELECT b AS batch, 'core' AS role, t FROM b UNION ALL SELECT b + 1, 'left', t FROM b WHERE p >= 35 AND b < last UNION ALL SELECT b - 1, 'right', t FROM b WHERE p < 5 AND b > 0""")
def halo_batches(spark, sf_dir):
    return sq.with_halo(gray(spark, sf_dir), 40, 5).select("batch", "role", "t")


@query(f"WITH {PX}, a AS (SELECT * FROM px), b AS (SELECT t, y, x, -2 * val AS val FROM px) SELECT t, y, x, 0::BIGINT AS ch, round(val, 6) + 0.0 AS val FROM a UNION ALL SELECT t, y, x, 1, round(val, 6) + 0.0 FROM b")
def multichannel_zip(spark, sf_dir):
    a = gray(spark, sf_dir)
    return out(sq.zipped_channels([a, a.withColumn("data", F.transform("data", lambda x: x * -2))]), channels=2)


@query(f"WITH {PX} SELECT t // 4 AS t, y, x, t % 4 AS ch, round(val, 6) + 0.0 AS val FROM px WHERE t // 4 < (SELECT (max(t) + 1) // 4 FROM px)")
def deinterleave_pages(spark, sf_dir):
    return out(sq.deinterleaved(gray(spark, sf_dir), 4), channels=4)


@query(f"WITH {PX2} SELECT t * 2 + ch AS t, y, x, round(val, 6) + 0.0 AS val FROM p2")
def interleaved_pages(spark, sf_dir):
    return out(sq.interleaved(color(spark, sf_dir)), width=4)


@query("SELECT vec_id AS t, label::VARCHAR AS rec_id FROM embeddings WHERE vec_id IN (SELECT event_id * 3 FROM events WHERE event_type = 'click')")
def subset_semi(spark, sf_dir):
    wanted = table(spark, sf_dir, "events").where("event_type = 'click'").select((F.col("event_id") * 3).alias("t"))
    return gray(spark, sf_dir, recordings=True).join(wanted, "t", "left_semi").select("t", "rec_id")


@query("SELECT DISTINCT label::VARCHAR AS rec_id FROM embeddings WHERE label % 3 <> 0")
def resume_anti(spark, sf_dir):
    work = gray(spark, sf_dir, recordings=True).select("rec_id").distinct()
    status = work.select("rec_id", F.when(F.col("rec_id").cast("int") % 3 == 0, "done").otherwise("open").alias("state"))
    return sq.pending(work, status, ["rec_id"])


@query("SELECT label::VARCHAR AS rec_id FROM (SELECT label, row_number() OVER (ORDER BY label::VARCHAR) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT label FROM embeddings)) WHERE k = (n + 1) // 2")
def center_recording(spark, sf_dir):
    return sq.center_recording(gray(spark, sf_dir, recordings=True))


@query("SELECT 'roi' || c_nationkey || '/Chan ' || c_custkey AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS channel FROM customer")
def channel_discovery(spark, sf_dir):
    """Each nation's customers as the datasets of a file, which has a smaller group and a large dataset of another kind besides."""
    name = F.concat(F.lit("roi"), "c_nationkey", F.lit("/Chan "), "c_custkey")

    def pick(files):
        for part in files:
            found = [formats.pick_dataset({"other/ch1": (900, 900, 900), **dict.fromkeys(names, (9, 8, 8))}) for names in part["names"]]
            yield pd.DataFrame({"names": found})

    files = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.shuffle(F.collect_list(name)).alias("names"))
    chosen = files.select("names").mapInPandas(pick, "names array<string>").select(F.posexplode("names").alias("k", "name"))
    return chosen.select("name", (F.col("k") + 1).cast("long").alias("channel"))


@query(f"WITH {SESSION}, n AS (SELECT rec_id, max(t) AS last FROM sx GROUP BY rec_id), i AS (SELECT unnest(range(20, 90)) AS i), c AS (SELECT rec_id, least(i, last) AS t FROM n, i) SELECT c.rec_id, y, x, round(avg(val), 6) + 0.0 AS val FROM c JOIN sx ON sx.rec_id = c.rec_id AND sx.t = c.t GROUP BY c.rec_id, y, x")
def clipped_indices(spark, sf_dir):
    """Reference frames by indices, of which those beyond the end count as the last frame."""
    rows = registration.references_of(sessions(spark, sf_dir), FlowOptions(reference_frames=list(range(20, 90))), preregister=False)
    return out(rows, more=("rec_id",))


@query("SELECT event_id, event_id % 50 + 1 AS slices, (event_id % 7 + 1) * 1.5 AS rate FROM events")
def acquisition_metadata(spark, sf_dir):
    """Numbers out of page descriptions."""
    lines = F.concat(F.lit("SI.hStackManager.numSlices = "), F.col("event_id") % 50 + 1, F.lit("\nSI.hRoiManager.scanFrameRate = "), (F.col("event_id") % 7 + 1) * F.lit(1.5))
    text = table(spark, sf_dir, "events").select("event_id", lines.alias("text"))
    return text.select("event_id", metadata.field(F.col("text"), "slices").cast("long").alias("slices"), metadata.field(F.col("text"), "rate").cast("double").alias("rate"))


# -- projections -------------------------------------------------------------


@query(f"WITH {PX}, m AS (SELECT min(val) AS lo, max(val) AS hi FROM px) SELECT t, y, x, round((val - lo) / (hi - lo + 1e-8), 6) + 0.0 AS val FROM px, m")
def norm_joint(spark, sf_dir):
    df = gray(spark, sf_dir)
    rows = df.crossJoin(F.broadcast(sq.bounds(df)))  # one row
    return out(rows.withColumn("data", C.normalized(F.col("data"), F.col("low"), F.col("high"))))


@query(f"WITH {PX2}, m AS (SELECT ch, min(val) AS lo, max(val) AS hi FROM p2 GROUP BY ch) SELECT t, y, x, ch, round((val - lo) / (hi - lo + 1e-8), 6) + 0.0 AS val FROM p2 JOIN m USING (ch)")
def norm_separate(spark, sf_dir):
    df = color(spark, sf_dir)
    rows = df.crossJoin(F.broadcast(sq.channel_bounds(df)))  # one row
    return out(rows.withColumn("data", C.normalized_channels(F.col("data"), F.col("low"), F.col("high"), F.col("c"))), width=4, channels=2)


_REF = f"WITH {PX}, r AS (SELECT y, x, avg(val) AS ref FROM px GROUP BY y, x), m AS (SELECT min(ref) AS lo, max(ref) AS hi FROM r)"


@query(f"{_REF} SELECT t, y, x, round((val - lo) / (hi - lo + 1e-8), 6) + 0.0 AS val FROM px, m")
def norm_by_ref(spark, sf_dir):
    df = gray(spark, sf_dir)
    rows = df.crossJoin(F.broadcast(sq.bounds(sq.mean_frames(df))))  # one row
    return out(rows.withColumn("data", C.normalized(F.col("data"), F.col("low"), F.col("high"))))


@query(f"{_REF} SELECT t, y, x, round((val - lo) / (hi - lo), 6) + 0.0 AS val FROM px, m")
def mat2gray(spark, sf_dir):
    df = gray(spark, sf_dir)
    rows = df.crossJoin(F.broadcast(sq.bounds(sq.mean_frames(df))))  # one row
    return out(rows.withColumn("data", C.normalized(F.col("data"), F.col("low"), F.col("high"), 0.0)))


def _clip(name, low, high, scale):
    @query(f"WITH {PX} SELECT t, y, x, round_even(least(greatest(val * {scale}, {low}), {high}), 0) + 0.0 AS val FROM px")
    def run(spark, sf_dir):
        df = gray(spark, sf_dir).withColumn("data", F.transform("data", lambda x: x * F.lit(float(scale))))
        return out(df.withColumn("data", C.clip_cast(F.col("data"), name)))

    return run


for _name, _low, _high, _scale in (("uint8", "0.0", "255.0", 150.0), ("uint16", "0.0", "65535.0", 30000.0), ("int16", "-32768.0", "32767.0", 20000.0)):
    _f = _clip(_name, _low, _high, _scale)
    for _d in (QUERIES, SQL):
        _d[f"clip_cast_{_name}"] = _d.pop("run")


@query(f"WITH {PX} SELECT t, y, x, floor(least(greatest(val, 0.0), 1.0) * 255) + 0.0 AS val FROM px")
def quantize_uint8(spark, sf_dir):
    return out(gray(spark, sf_dir).withColumn("data", C.quantized(F.col("data"))))


@query(f"WITH {PX} SELECT t, y, x, least(greatest(trunc(val * 150), -32768.0), 32767.0) + 0.0 AS val FROM px")
def truncate_int16(spark, sf_dir):
    df = gray(spark, sf_dir).withColumn("data", F.transform("data", lambda x: x * 150))
    return out(df.withColumn("data", C.truncated(F.col("data"), "int16")))


@query(f"WITH {PX2} SELECT t, y, x, round(sum(val * CASE ch WHEN 0 THEN 0.75 ELSE 0.25 END), 6) + 0.0 AS val FROM p2 GROUP BY t, y, x")
def channel_gray(spark, sf_dir):
    return out(color(spark, sf_dir).withColumn("data", C.weighted_gray(F.col("data"), [3.0, 1.0])), width=4)


@query(f"WITH {PX} SELECT t, y, x, round(0.45 * pow(greatest(val, 0) + 1e-5, -0.55), 6) + 0.0 AS val FROM px")
def charbonnier_weight(spark, sf_dir):
    return out(gray(spark, sf_dir).withColumn("data", F.transform("data", lambda x: C.charbonnier(x, 0.45))))


@query(f"WITH {PX} SELECT t, y, x, round(0.75 + 0.25 * (0.45 * pow(greatest(val, 0) + 1e-5, -0.55)), 6) + 0.0 AS val FROM px")
def gnc_blend(spark, sf_dir):
    return out(gray(spark, sf_dir).withColumn("data", F.transform("data", lambda x: C.gnc_blend(C.charbonnier(x, 0.45), 0.45, 0.25))))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 > 2 THEN o_custkey % 5 ELSE CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 4 WHEN 'P' THEN 6 ELSE 0 END END::BIGINT AS level FROM orders")
def effective_level(spark, sf_dir):
    quality = F.when(F.col("o_orderstatus") == "F", "quality").when(F.col("o_orderstatus") == "O", "balanced").when(F.col("o_orderstatus") == "P", "fast")
    given = F.when(F.col("o_custkey") % 5 > 2, F.col("o_custkey") % 5).otherwise(F.lit(-1))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.effective_min_level(quality, given).alias("level"))


_SIDES = "sides AS (SELECT DISTINCT 8 + 4 * c_nationkey AS side FROM customer)"


@query(f"WITH {_SIDES}, k AS (SELECT side, unnest(range(1, 101)) AS k FROM sides) SELECT side::BIGINT AS side, coalesce(min(CASE WHEN round_even(side * pow(0.8, k), 0) < 10 THEN k END), 100) AS depth FROM k GROUP BY side")
def pyramid_depth(spark, sf_dir):
    sides = table(spark, sf_dir, "customer").select((F.lit(8) + 4 * F.col("c_nationkey")).cast("long").alias("side")).distinct()
    return sides.select("side", C.depth_of(F.col("side"), 0.8, 100).alias("depth"))


@query(f"WITH {_SIDES} SELECT side::BIGINT AS side, k AS level, round_even(side * pow(0.8, k), 0)::BIGINT AS size FROM sides, (SELECT unnest(range(0, 12)) AS k) WHERE k = 0 OR round_even(side * pow(0.8, k - 1), 0) >= 10 OR k = 1")
def pyramid_sizes(spark, sf_dir):
    sides = table(spark, sf_dir, "customer").select((F.lit(8) + 4 * F.col("c_nationkey")).cast("long").alias("side")).distinct()
    depth = F.least(C.depth_of(F.col("side"), 0.8, 100), F.lit(11).cast("long"))
    return sides.select("side", F.explode(F.sequence(F.lit(0).cast("long"), depth)).alias("level")).select("side", "level", F.rint(F.col("side") * F.pow(F.lit(0.8), "level")).cast("long").alias("size"))


# -- means and aggregates ----------------------------------------------------


@query(f"WITH {PX} SELECT rec_id, y, x, round(avg(val), 6) + 0.0 AS val FROM px GROUP BY rec_id, y, x")
def temporal_mean(spark, sf_dir):
    return out(sq.mean_frames(gray(spark, sf_dir, recordings=True)), more=("rec_id",))


def _mean_sql(order, k):
    return f"WITH {PX}, n AS (SELECT *, row_number() OVER (PARTITION BY rec_id, y, x ORDER BY t {order}) AS k FROM px) SELECT rec_id, y, x, round(avg(val), 6) + 0.0 AS val FROM n WHERE k <= {k} GROUP BY rec_id, y, x"


@query(_mean_sql("", 22))
def first22_mean(spark, sf_dir):
    return out(sq.first_mean(gray(spark, sf_dir, recordings=True), 22), more=("rec_id",))


@query(_mean_sql("DESC", 20))
def last20_mean(spark, sf_dir):
    return out(sq.last_mean(gray(spark, sf_dir, recordings=True), 20), more=("rec_id",))


@query(_mean_sql("DESC", 100))
def last100_mean(spark, sf_dir):
    return out(sq.last_mean(gray(spark, sf_dir, recordings=True), 100), more=("rec_id",))


@query(f"{_REF}, d AS (SELECT t, y, x, abs((val - ref) / (hi - lo + 1e-8)) AS d FROM px JOIN r USING (y, x), m) SELECT t, round(avg(d), 6) + 0.0 AS mean_dev, round(max(d), 6) + 0.0 AS max_dev FROM d GROUP BY t")
def reference_deviation(spark, sf_dir):
    """Per frame: mean and greatest distance from the normalised mean reference."""
    ref = reference(spark, sf_dir)
    low, high = ref.min(), ref.max()

    def run(s):
        d = np.abs((s - ref) / (high - low + 1e-8)).reshape(len(s), -1)
        return {"mean_dev": d.mean(1), "max_dev": d.max(1)}

    rows = fr.map_stacks(gray(spark, sf_dir), run, {"mean_dev": "double", "max_dev": "double"})
    return rows.select("t", rounded(F.col("mean_dev")).alias("mean_dev"), rounded(F.col("max_dev")).alias("max_dev"))


# -- stencils ----------------------------------------------------------------


def _gauss(sigma: float, truncate: float = 4.0) -> str:
    """Rows (o, w) of a Gaussian's weights, from its formula."""
    r = int(truncate * sigma + 0.5)
    return f"k AS (SELECT o, exp(-0.5 * o * o / ({sigma} * {sigma})) / sum(exp(-0.5 * o * o / ({sigma} * {sigma}))) OVER () AS w FROM (SELECT unnest(range(-{r}, {r + 1})) AS o))"


def _mirror(e: str, n: int = 8) -> str:
    """Half-sample reflection of an index expression."""
    m = f"((({e}) % {2 * n} + {2 * n}) % {2 * n})"
    return f"CASE WHEN {m} < {n} THEN {m} ELSE {2 * n - 1} - {m} END"


@query(f"WITH {PX}, {_gauss(1.0)}, a AS (SELECT q.t, q.y, q.x, sum(k.w * s.val) AS val FROM px q CROSS JOIN k JOIN px s ON s.t = q.t AND s.x = q.x AND s.y = {_mirror('q.y + k.o')} GROUP BY q.t, q.y, q.x) SELECT q.t, q.y, q.x, round(sum(k.w * s.val), 6) + 0.0 AS val FROM a q CROSS JOIN k JOIN a s ON s.t = q.t AND s.y = q.y AND s.x = {_mirror('q.x + k.o')} GROUP BY q.t, q.y, q.x")
def gauss_spatial(spark, sf_dir):
    return out(mo.smoothed(gray(spark, sf_dir), (1.0, 1.0)))


@query(f"WITH {PX}, {_gauss(0.6)}, n AS (SELECT t // 25 AS b, max(t % 25) + 1 AS n FROM px GROUP BY 1), q AS (SELECT px.*, n.n FROM px JOIN n ON n.b = px.t // 25), m AS (SELECT q.t, q.y, q.x, q.n, k.w, ((q.t % 25 + k.o) % (2 * q.n) + 2 * q.n) % (2 * q.n) AS m FROM q CROSS JOIN k) SELECT m.t, m.y, m.x, round(sum(m.w * s.val), 6) + 0.0 AS val FROM m JOIN px s ON s.y = m.y AND s.x = m.x AND s.t = (m.t // 25) * 25 + CASE WHEN m.m < m.n THEN m.m ELSE 2 * m.n - 1 - m.m END GROUP BY m.t, m.y, m.x")
def gauss_temporal_batch(spark, sf_dir):
    return out(mo.smoothed_in_time(gray(spark, sf_dir), 0.6, 25))


_GH = np.exp(-0.5 * (np.arange(7) / 1.4) ** 2)


@query(f"WITH {PX}, k(o, w) AS (VALUES {', '.join(f'({k}, {float(w)!r}::DOUBLE)' for k, w in enumerate(_GH))}), s AS (SELECT q.t, q.y, q.x, sum(k.w * s.val) / sum(k.w) AS val FROM px q CROSS JOIN k JOIN px s ON s.y = q.y AND s.x = q.x AND s.t = q.t - k.o AND s.t // 25 = q.t // 25 GROUP BY q.t, q.y, q.x) SELECT t, y, x, round(val, 6) + 0.0 AS val FROM s")
def half_kernel(spark, sf_dir):
    return out(mo.smoothed_in_time(gray(spark, sf_dir), 1.4, 25, causal=True))


_LAG = "WINDOW wx AS (PARTITION BY t, y ORDER BY x), wy AS (PARTITION BY t, x ORDER BY y)"


def _dx(c: str, last: int, over: str = "wx", at: str = "x", first: int = 0) -> str:
    return f"CASE WHEN {at} = {first} THEN lead({c}) OVER {over} - {c} WHEN {at} = {last} THEN {c} - lag({c}) OVER {over} ELSE (lead({c}) OVER {over} - lag({c}) OVER {over}) / 2 END"


@query(f"WITH {PX} SELECT t, y, x, round({_dx('val', 7, 'wy', 'y')}, 6) + 0.0 AS gy, round({_dx('val', 7)}, 6) + 0.0 AS gx FROM px {_LAG}")
def gradient_xy(spark, sf_dir):
    df = mo.gradients(gray(spark, sf_dir))
    i = F.col("p.i").cast("long")
    rows = df.select("t", F.explode(F.transform(F.arrays_zip("gy", "gx"), lambda g, k: F.struct(k.alias("i"), g["gy"].alias("gy"), g["gx"].alias("gx")))).alias("p"))
    return rows.select("t", F.floor(i / 8).alias("y"), (i % 8).alias("x"), rounded(F.col("p.gy")).alias("gy"), rounded(F.col("p.gx")).alias("gx"))


@query(f"WITH {PX} SELECT t, y, x, CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 THEN round(lag(val) OVER wx - 2 * val + lead(val) OVER wx, 6) + 0.0 ELSE 0.0 END AS fxx FROM px {_LAG}")
def second_difference(spark, sf_dir):
    return out(mo.second_differences(gray(spark, sf_dir)), "fxx", value="fxx")


@query(f"WITH {PX}, g AS (SELECT unnest(range(10)) AS k) SELECT px.t, a.k AS y, b.k AS x, round(px.val, 6) + 0.0 AS val FROM g a CROSS JOIN g b JOIN px ON px.y = least(greatest(a.k - 1, 0), 7) AND px.x = least(greatest(b.k - 1, 0), 7)")
def edge_ring(spark, sf_dir):
    return out(mo.padded(gray(spark, sf_dir)), width=10)


_PAIR = f"""WITH {PX}, r AS (SELECT y, x, avg(val) AS ref FROM px GROUP BY y, x), g AS (SELECT unnest(range(10)) AS k),
pad AS (SELECT px.t, a.k AS y, b.k AS x, r.ref AS f1, px.val AS f2 FROM g a CROSS JOIN g b JOIN px ON px.y = least(greatest(a.k - 1, 0), 7) AND px.x = least(greatest(b.k - 1, 0), 7) JOIN r ON r.y = px.y AND r.x = px.x)"""
_IN = "x BETWEEN 1 AND 8 AND y BETWEEN 1 AND 8"


def _inner(name: str, columns: dict[str, str], source: str) -> str:
    """Interior values with the border reflected again."""
    raw = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    picked = ", ".join(f"s.{c}" for c in columns)
    return f"{name}0 AS (SELECT t, y, x, {raw} FROM {source} {_LAG}), {name} AS (SELECT q.t, q.y, q.x, {picked} FROM {source} q JOIN {name}0 s ON s.t = q.t AND s.y = least(greatest(q.y, 1), 8) AND s.x = least(greatest(q.x, 1), 8))"


def _tensor_rows(expressions: dict[str, str]) -> str:
    return ", ".join(f"CASE WHEN {_IN} THEN round({e}, 5) + 0.0 ELSE 0.0 END AS {c}" for c, e in expressions.items())


_GRAY = {"j11": "gx * gx", "j22": "gy * gy", "j33": "gt * gt", "j12": "gx * gy", "j13": "gx * gt", "j23": "gy * gt"}
_GC = {
    "j11": "rx * fxx * fxx + ry * fxy * fxy", "j22": "rx * fxy * fxy + ry * fyy * fyy", "j33": "rx * fxt * fxt + ry * fyt * fyt",
    "j12": "rx * fxx * fxy + ry * fxy * fyy", "j13": "rx * fxx * fxt + ry * fxy * fyt", "j23": "rx * fxy * fxt + ry * fyy * fyt",
}


def _tensor(spark, sf_dir, constancy):
    ref = reference(spark, sf_dir)
    fixed = F.array(*[F.lit(float(x)) for x in ref.ravel()])
    pairs = gray(spark, sf_dir).select("rec_id", "t", "h", "w", "c", fixed.alias("fixed"), F.col("data").alias("moving"))
    planes = mo.motion_tensors(pairs, constancy)
    zipped = F.transform(F.arrays_zip(*mo.TENSOR_PLANES), lambda g, k: F.struct(k.alias("i"), *(g[c].alias(c) for c in mo.TENSOR_PLANES)))
    i = F.col("p.i").cast("long")
    return planes.select("t", F.explode(zipped).alias("p")).select("t", F.floor(i / 10).alias("y"), (i % 10).alias("x"), *(rounded(F.col(f"p.{c}"), 5).alias(c) for c in mo.TENSOR_PLANES))


@query(f"{_PAIR}, {_inner('d', {'gx': '((' + _dx('f1', 9) + ') + (' + _dx('f2', 9) + ')) / 2', 'gy': '((' + _dx('f1', 9, 'wy', 'y') + ') + (' + _dx('f2', 9, 'wy', 'y') + ')) / 2', 'gt': 'f2 - f1'}, 'pad')} SELECT t, y, x, {_tensor_rows(_GRAY)} FROM d")
def tensor_gray(spark, sf_dir):
    return _tensor(spark, sf_dir, "gray")


_SECOND = "(lag({c}) OVER {w} - 2 * {c} + lead({c}) OVER {w})"
_GC_INNER = _inner("d", {"fx": "((" + _dx("f1", 9) + ") + (" + _dx("f2", 9) + ")) / 2", "ft": "f2 - f1"}, "pad")
_GC_CTE = f"""{_PAIR}, {_GC_INNER}, e AS (SELECT d.t, d.y, d.x, {_dx('fx', 9, 'wy', 'y')} AS fxy, {_dx('ft', 9)} AS fxt, {_dx('ft', 9, 'wy', 'y')} AS fyt FROM d {_LAG}),
s AS (SELECT t, y, x, ({_SECOND.format(c='f1', w='wx')} + {_SECOND.format(c='f2', w='wx')}) / 2 AS fxx, ({_SECOND.format(c='f1', w='wy')} + {_SECOND.format(c='f2', w='wy')}) / 2 AS fyy FROM pad {_LAG}),
z AS (SELECT *, 1 / (fxx * fxx + fxy * fxy + 1e-6) AS rx, 1 / (fxy * fxy + fyy * fyy + 1e-6) AS ry FROM e JOIN s USING (t, y, x))"""


@query(f"{_GC_CTE} SELECT t, y, x, {_tensor_rows(_GC)} FROM z")
def tensor_gc(spark, sf_dir):
    return _tensor(spark, sf_dir, "gc")


_EPS2 = repr(K.CENSUS_EPSILON**2)
_CENSUS = f"""{_PAIR}, o AS (SELECT dy, dx, sqrt(dy * dy + dx * dx) AS dist FROM (SELECT unnest([-1, 0, 1]) AS dy) a, (SELECT unnest([-1, 0, 1]) AS dx) b WHERE dy <> 0 OR dx <> 0),
n0 AS (SELECT c.t, c.y, c.x, o.dy, o.dx, (n.f1 - c.f1) / dist AS r1, (n.f2 - c.f2) / dist AS r2 FROM pad c CROSS JOIN o JOIN pad n ON n.t = c.t AND n.y = c.y + dy AND n.x = c.x + dx WHERE c.x BETWEEN 1 AND 8 AND c.y BETWEEN 1 AND 8),
n1 AS (SELECT t, y, x, dy, dx, 0.5 * (1 + r1 / sqrt(r1 * r1 + {_EPS2})) AS s1, 0.5 * (1 + r2 / sqrt(r2 * r2 + {_EPS2})) AS s2 FROM n0),
p AS (SELECT s.t, a.k AS y, b.k AS x, s.dy, s.dx, s.s1, s.s2 FROM g a CROSS JOIN g b JOIN n1 s ON s.y = least(greatest(a.k, 1), 8) AND s.x = least(greatest(b.k, 1), 8)),
d AS (SELECT t, y, x, (({_dx('s1', 9)}) + ({_dx('s2', 9)})) / 2 AS gx, (({_dx('s1', 9, 'wy', 'y')}) + ({_dx('s2', 9, 'wy', 'y')})) / 2 AS gy, s2 - s1 AS gt FROM p WINDOW wx AS (PARTITION BY t, dy, dx, y ORDER BY x), wy AS (PARTITION BY t, dy, dx, x ORDER BY y))
SELECT t, y, x, {', '.join(f"CASE WHEN {_IN} THEN round(sum({e}) / 4, 5) + 0.0 ELSE 0.0 END AS {c}" for c, e in _GRAY.items())} FROM d GROUP BY t, y, x"""


@query(_CENSUS)
def tensor_census(spark, sf_dir):
    return _tensor(spark, sf_dir, "cs")


@query(f"WITH {PX}, {FLOW}, g AS (SELECT t, y, x, {_dx('u', 7)} AS ux, {_dx('u', 7, 'wy', 'y')} AS uy, {_dx('v', 7)} AS vx, {_dx('v', 7, 'wy', 'y')} AS vy FROM fl {_LAG}) SELECT t, y, x, round(0.45 * pow(ux * ux + uy * uy + vx * vx + vy * vy + 1e-5, -0.55), 6) + 0.0 AS val FROM g")
def smoothness_weight(spark, sf_dir):
    df = with_flow(gray(spark, sf_dir))
    rows = fr.map_stacks(df, lambda u, v: {"psi": K.smoothness(u[..., 0], v[..., 0], 0.45, 1.0, 1.0)}, {"psi": "array<double>"}, inputs=("u", "v"))
    return out(rows, "psi")


_WHOLE = "CASE WHEN {e} < 0 THEN -({e}) WHEN {e} > 7 THEN 14 - ({e}) ELSE {e} END"


@query(f"WITH {PX}, o AS (SELECT unnest(range(-2, 3)) AS o) SELECT q.t, q.y, q.x, round(median(s.val), 6) + 0.0 AS val FROM px q CROSS JOIN o a CROSS JOIN o b JOIN px s ON s.t = q.t AND s.y = {_WHOLE.format(e='q.y + a.o')} AND s.x = {_WHOLE.format(e='q.x + b.o')} GROUP BY q.t, q.y, q.x")
def median5(spark, sf_dir):
    return out(mo.medians(gray(spark, sf_dir)))


def _matrix(m: np.ndarray) -> str:
    return ", ".join(f"({i}, {j}, {float(m[i, j])!r}::DOUBLE)" for i in range(m.shape[0]) for j in range(m.shape[1]) if m[i, j])


def _resize_sql(m: np.ndarray, digits: int) -> str:
    return f"WITH {PX}, m(o, i, w) AS (VALUES {_matrix(m)}), a AS (SELECT t, y, o AS x, sum(w * val) AS val FROM px JOIN m ON m.i = px.x GROUP BY t, y, o) SELECT t, o::BIGINT AS y, x::BIGINT AS x, round(sum(w * val), {digits}) + 0.0 AS val FROM a JOIN m ON m.i = a.y GROUP BY t, o, x"


@query(_resize_sql(K.resize_matrix(8, 6, 0.6 / 0.75), 3))
def resize_level(spark, sf_dir):
    return out(mo.resized(gray(spark, sf_dir), (6, 6)), width=6, digits=3)


@query(_resize_sql(K.resize_plain(np.eye(8)[None, :, :], (12, 8))[0], 6))
def resize_plain(spark, sf_dir):
    return out(mo.resized(gray(spark, sf_dir), (12, 12), anti_alias=False), width=12)


def _resample(kind):
    m = K.sampling_matrix(8, 5, kind)

    @query(_resize_sql(m, 6))
    def run(spark, sf_dir):
        return out(mo.resampled(gray(spark, sf_dir), (5, 5), kind), width=5)

    for d in (QUERIES, SQL):
        d[f"resample_{kind}"] = d.pop("run")


for _kind in ("nearest", "linear", "lanczos", "area"):
    _resample(_kind)


# -- warps and flows ---------------------------------------------------------

_FLOAT = "f AS (SELECT t, y, x, val, (x + u)::FLOAT AS mx, (y + v)::FLOAT AS my FROM fl), q AS (SELECT *, mx < 0 OR mx >= 8 OR my < 0 OR my >= 8 AS oob, least(greatest(mx, 0), 7)::DOUBLE AS cx, least(greatest(my, 0), 7)::DOUBLE AS cy FROM f)"
_CUBIC = "CASE WHEN {d} <= 1 THEN ((1.25 * {d} - 2.25) * {d}) * {d} + 1 WHEN {d} < 2 THEN ((-0.75 * {d} + 3.75) * {d} - 6) * {d} + 3 ELSE 0 END"


def _warp_sql(taps: str, weight: str) -> str:
    wx, wy = weight.format(d="abs(cx - (floor(cx) + a.o))"), weight.format(d="abs(cy - (floor(cy) + b.o))")
    return f"""WITH {PX}, {FLOW}, {_FLOAT}, o AS (SELECT unnest({taps}) AS o), r AS (SELECT y, x, avg(val) AS ref FROM px GROUP BY y, x)
SELECT q.t, q.y, q.x, round(CASE WHEN any_value(q.oob) THEN any_value(r.ref)::FLOAT ELSE sum(({wx}) * ({wy}) * s.val)::FLOAT END::DOUBLE, 4) + 0.0 AS val
FROM q CROSS JOIN o a CROSS JOIN o b JOIN px s ON s.t = q.t AND s.x = least(greatest(floor(cx)::BIGINT + a.o, 0), 7) AND s.y = least(greatest(floor(cy)::BIGINT + b.o, 0), 7) JOIN r ON r.y = q.y AND r.x = q.x GROUP BY q.t, q.y, q.x"""


def _warp(spark, sf_dir, method):
    ref = F.array(*[F.lit(float(x)) for x in reference(spark, sf_dir).ravel()])
    return out(mo.warped(with_flow(gray(spark, sf_dir)).withColumn("fill", ref), method), "warped", digits=4)


@query(_warp_sql("[0, 1]", "(1 - {d})"))
def warp_linear(spark, sf_dir):
    return _warp(spark, sf_dir, "linear")


@query(_warp_sql("[-1, 0, 1, 2]", _CUBIC))
def warp_cubic(spark, sf_dir):
    return _warp(spark, sf_dir, "cubic")


_INSIDE = "x + u >= 0 AND x + u < 8 AND y + v >= 0 AND y + v < 8"


@query(f"WITH {PX}, {FLOW} SELECT t, y, x, CASE WHEN {_INSIDE} THEN 1.0 ELSE 0.0 END AS val FROM fl")
def valid_mask(spark, sf_dir):
    return out(mo.valid_masks(with_flow(gray(spark, sf_dir))), "valid")


@query(f"WITH {PX}, {FLOW}, pl AS (SELECT t, y, x, {_INSIDE} AS inside, round_even(least(greatest(x + u, 0), 7), 0)::BIGINT AS sx, round_even(least(greatest(y + v, 0), 7), 0)::BIGINT AS sy FROM fl) SELECT pl.t, pl.y, pl.x, CASE WHEN inside AND px.val > 0 THEN 1.0 ELSE 0.0 END AS val FROM pl JOIN px ON px.t = pl.t AND px.x = pl.sx AND px.y = pl.sy")
def warp_nearest_mask(spark, sf_dir):
    df = with_flow(gray(spark, sf_dir)).withColumn("mask", F.transform("data", lambda x: F.when(x > 0, 1.0).otherwise(0.0)))
    return out(mo.warped_masks(df), "valid")


@query(f"WITH {PX}, {FLOW}, g AS (SELECT *, {_dx('u', 7)} + {_dx('v', 7, 'wy', 'y')} AS div FROM fl {_LAG}) SELECT t, round(avg(sqrt(u * u + v * v)), 6) + 0.0 AS mean_disp, round(max(sqrt(u * u + v * v)), 6) + 0.0 AS max_disp, round(avg(div), 6) + 0.0 AS mean_div, round(sqrt(avg(u) * avg(u) + avg(v) * avg(v)), 6) + 0.0 AS mean_translation FROM g GROUP BY t")
def flow_stats(spark, sf_dir):
    df = mo.flow_statistics(with_flow(gray(spark, sf_dir)))
    return df.select("t", *(rounded(F.col(c)).alias(c) for c in ("mean_disp", "max_disp", "mean_div", "mean_translation")))


@query(f"WITH {PX}, {FLOW} SELECT t, round(avg(sqrt((u - 0.1) * (u - 0.1) + (v + 0.2) * (v + 0.2))), 6) + 0.0 AS epe FROM fl WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 GROUP BY t")
def epe_border(spark, sf_dir):
    const = lambda x: F.transform("data", lambda _: F.lit(x))
    df = with_flow(gray(spark, sf_dir)).withColumn("true_u", const(0.1)).withColumn("true_v", const(-0.2))
    return mo.endpoint_errors(df, 2).select("t", rounded(F.col("epe")).alias("epe"))


_MASKS = f"WITH {PX} SELECT rec_id, y, x, CASE WHEN bool_and(val > -0.3) THEN 1.0 ELSE 0.0 END AS val FROM px GROUP BY rec_id, y, x"


def _masks(spark, sf_dir):
    return gray(spark, sf_dir, recordings=True).withColumn("valid", F.transform("data", lambda x: x > -0.3))


@query(_MASKS)
def mask_temporal_and(spark, sf_dir):
    return out(mo.mask_and(_masks(spark, sf_dir)), "valid", more=("rec_id",))


@query(f"WITH s AS ({_MASKS.replace('-0.3', '-0.4')}) SELECT y, x, min(val) AS val FROM s GROUP BY y, x")
def mask_session_and(spark, sf_dir):
    df = gray(spark, sf_dir, recordings=True).withColumn("valid", F.transform("data", lambda x: x > -0.4))
    return out(mo.mask_and(mo.mask_and(df), ()), "valid", more=())


# -- depth -------------------------------------------------------------------

_SLICES = 9
_VOLUME = f"""WITH {PX}, gp AS (SELECT t, y, x, val, {_dx('val', 7)} AS gx, {_dx('val', 7, 'wy', 'y')} AS gy FROM px {_LAG}), vol AS (SELECT t AS z, y, x, val, gx, gy FROM gp WHERE t < {_SLICES}), fm AS (SELECT * FROM gp WHERE t >= {_SLICES}),
e AS (SELECT fm.t, z, fm.y, fm.x, abs(vol.gx - fm.gx) + abs(vol.gy - fm.gy) AS err FROM fm JOIN vol ON vol.y = fm.y AND vol.x = fm.x)"""


def volume_of(spark, sf_dir) -> tuple[np.ndarray, DataFrame]:
    df = gray(spark, sf_dir)
    return fr.one_volume(df.where(F.col("t") < _SLICES)), df.where(F.col("t") >= _SLICES)


@query(f"{_VOLUME}, s AS (SELECT z, sum(err) AS err FROM e GROUP BY z) SELECT z AS anchor, round(err, 3) + 0.0 AS err FROM s ORDER BY s.err, z LIMIT 1")
def z_anchor(spark, sf_dir):
    volume, df = volume_of(spark, sf_dir)
    return mo.anchor_slice(mo.slice_errors(df, volume)).select("anchor", rounded(F.col("err"), 3).alias("err"))


_PATCH = f"""{_VOLUME}, st AS (SELECT unnest([0, 2, 4]) AS s), sc AS (SELECT t, r.s AS r, c.s AS c, z, -sum(err) AS s FROM e JOIN st r ON e.y >= r.s AND e.y < r.s + 4 JOIN st c ON e.x >= c.s AND e.x < c.s + 4 GROUP BY t, r.s, c.s, z)"""
_PARABOLA = f"""{_PATCH}, nb AS (SELECT *, coalesce(lag(s) OVER w, s) AS sm, coalesce(lead(s) OVER w, s) AS sp, row_number() OVER (PARTITION BY t, r, c ORDER BY s DESC, z) AS k FROM sc WHERE z BETWEEN 1 AND 7 WINDOW w AS (PARTITION BY t, r, c ORDER BY z)),
zh AS (SELECT t, r, c, least(greatest(z + CASE WHEN abs(sm - 2 * s + sp) < 1e-3 * greatest(abs(s), 1) THEN 0 ELSE least(greatest(0.5 * (sm - sp) / (sm - 2 * s + sp), -0.5), 0.5) END, 1), 7) AS zh FROM nb WHERE k = 1),
zm AS (SELECT t, y, x, avg(zh) AS z FROM zh, (SELECT unnest(range(8)) AS y), (SELECT unnest(range(8)) AS x) WHERE y >= r AND y < r + 4 AND x >= c AND x < c + 4 GROUP BY t, y, x)"""


@query(f"{_PATCH} SELECT t, r::BIGINT AS r, c::BIGINT AS c, z, round(s, 5) + 0.0 AS score FROM sc")
def z_patch_score(spark, sf_dir):
    volume, df = volume_of(spark, sf_dir)

    def run(s):
        d = K.gradient_distance(volume, s)
        return {"score": np.stack([-d[:, :, r : r + 4, c : c + 4].sum((2, 3)) for r in (0, 2, 4) for c in (0, 2, 4)], 1)}

    rows = fr.map_stacks(df, run, {"score": "array<double>"}).select("t", F.posexplode("score").alias("i", "s"))
    i = F.col("i").cast("long")
    return rows.select("t", (F.floor(i / (3 * _SLICES)) * 2).alias("r"), (F.floor(i / _SLICES) % 3 * 2).alias("c"), (i % _SLICES).alias("z"), rounded(F.col("s"), 5).alias("score"))


def _depth(spark, sf_dir):
    volume, df = volume_of(spark, sf_dir)
    maps = mo.depth_maps(df, volume, 4, win_half=3, patch=4, overlap=0.5)
    return volume, df, maps


@query(f"{_PARABOLA} SELECT t, y, x, round(z, 5) + 0.0 AS val FROM zm")
def z_patch_average(spark, sf_dir):
    return out(_depth(spark, sf_dir)[2], "z", digits=5)


_LOOKUP = f"{_PARABOLA}, zz AS (SELECT t, y, x, z, floor(z)::BIGINT AS z0, least(floor(z)::BIGINT + 1, {_SLICES - 1}) AS z1, z - floor(z) AS a FROM zm), lk AS (SELECT zz.t, zz.y, zz.x, (1 - a) * v0.val + a * v1.val AS val FROM zz JOIN vol v0 ON v0.z = z0 AND v0.y = zz.y AND v0.x = zz.x JOIN vol v1 ON v1.z = z1 AND v1.y = zz.y AND v1.x = zz.x)"


@query(f"{_LOOKUP} SELECT t, y, x, round(val, 4) + 0.0 AS val FROM lk")
def z_simulate(spark, sf_dir):
    volume, _, maps = _depth(spark, sf_dir)
    return out(mo.depth_simulated(maps, volume), "simulated", digits=4)


@query(f"{_LOOKUP} SELECT lk.t, lk.y, lk.x, round(fm.val + v.val - lk.val, 4) + 0.0 AS val FROM lk JOIN fm USING (t, y, x) JOIN vol v ON v.z = 4 AND v.y = lk.y AND v.x = lk.x")
def z_correct(spark, sf_dir):
    volume, df, maps = _depth(spark, sf_dir)
    joined = df.select("rec_id", "t", "h", "w", "c", "data").join(maps.select("rec_id", "t", "z"), ["rec_id", "t"])
    return out(mo.depth_corrected(joined, volume, 4), "corrected", digits=4)


@query("SELECT length, start FROM (SELECT k AS length, unnest(list_distinct(list_append(range(0, greatest(k - 16, 0) + 1, 6), greatest(k - 16, 0)))) AS start FROM (SELECT unnest(range(8, 40)) AS k))")
def patch_starts(spark, sf_dir):
    starts = [(n, K.patch_starts(n, 16, 6)) for n in range(8, 40)]
    return spark.createDataFrame(starts, "length bigint, starts array<bigint>").select("length", F.explode("starts").alias("start"))


# -- pictures ----------------------------------------------------------------


@query(f"WITH {PX2}, m AS (SELECT t, ch, min(val) AS lo, max(val) AS hi FROM p2 GROUP BY t, ch), s AS (SELECT t, y, x, ch, CASE WHEN hi > lo THEN (val - lo) / (hi - lo) ELSE 0 END AS v FROM p2 JOIN m USING (t, ch)), w AS (SELECT t, y, x, max(CASE WHEN ch = 0 THEN v END) AS a, max(CASE WHEN ch = 1 THEN v END) AS b FROM s GROUP BY t, y, x) SELECT t, y, x, unnest([0, 1, 2])::BIGINT AS ch, floor(least(greatest(unnest([a, (a + b) * 0.5, b]), 0), 1) * 255) + 0.0 AS val FROM w")
def color_2ch(spark, sf_dir):
    return out(mo.two_colors(color(spark, sf_dir)), "rgb", width=4, channels=3)


_WHEEL = ", ".join(f"({k}, {r!r}, {g!r}, {b!r})" for k, (r, g, b) in enumerate((K.color_wheel() / 255).tolist()))


@query(f"WITH {PX}, {FLOW}, wheel(k, r, g, b) AS (VALUES {_WHEEL}), n AS (SELECT t, y, x, u / m AS u, v / m AS v FROM fl JOIN (SELECT t, max(sqrt(u * u + v * v)) AS m FROM fl GROUP BY t) USING (t)), p AS (SELECT t, y, x, sqrt(u * u + v * v) AS rad, (atan2(-v, -u) / pi() + 1) / 2 * 54 AS fk FROM n), c AS (SELECT t, y, x, rad, fk - floor(fk) AS f, c0.r AS r0, c0.g AS g0, c0.b AS b0, c1.r AS r1, c1.g AS g1, c1.b AS b1 FROM p JOIN wheel c0 ON c0.k = floor(fk)::INT JOIN wheel c1 ON c1.k = (floor(fk)::INT + 1) % 55), z AS (SELECT t, y, x, unnest([0, 1, 2])::BIGINT AS ch, rad, (1 - f) * unnest([r0, g0, b0]) + f * unnest([r1, g1, b1]) AS col FROM c) SELECT t, y, x, ch, round((CASE WHEN rad <= 1 THEN 1 - rad * (1 - col) ELSE col * 0.75 END) * 255 / 4) AS val FROM z")
def flow_to_color(spark, sf_dir):
    """In steps of four, so that the last bit of the arc tangent does not matter."""
    wheel_out = mo.flow_colors(with_flow(gray(spark, sf_dir)))
    return out(wheel_out, "rgb", channels=3).select("t", "y", "x", "ch", F.round(F.col("val") / 4).alias("val"))


@query(f"WITH {PX}, {FLOW} SELECT t, y, x, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v FROM fl WHERE y % 4 = 0 AND x % 4 = 0")
def sampled_vectors(spark, sf_dir):
    rows = mo.sampled_vectors(with_flow(gray(spark, sf_dir)), 4)
    return rows.select("t", "y", "x", rounded(F.col("u")).alias("u"), rounded(F.col("v")).alias("v"))


@query()
def multispectral(spark, sf_dir):
    """Four bands, projected on their main axes."""
    df = fr.frames(table(spark, sf_dir, "embeddings"), F.col("embedding"), 4, 4, 4, t="vec_id")
    return mo.multispectral(df, mo.band_axes(df)).select("t", "rgb")


@query()
def super_resolution(spark, sf_dir):
    return mo.enlarged_warp(with_flow(gray(spark, sf_dir)), 3).select("t", "warped")


@query()
def z_align(spark, sf_dir):
    """The whole depth pipeline: smoothed gradients, anchor, patches, smoothed depth, correction."""
    df = gray(spark, sf_dir)
    options = DepthOptions(win_half=3, patch_size=4, overlap=0.5, spatial_sigma=0.5, temporal_sigma=0.5, smooth_spatial=1.0, smooth_temporal=0.5, output_dtype="float64")
    return depth.depth_aligned(df.where(F.col("t") >= _SLICES).withColumn("t", F.col("t") - _SLICES), df.where(F.col("t") < _SLICES), options).select("rec_id", "t", "z", "corrected")


@query("WITH e AS (SELECT vec_id AS t, label, (SELECT avg(x)::DOUBLE FROM unnest(embedding) AS q(x)) AS m FROM embeddings) SELECT t // 20 AS step, round(avg(m), 6) + 0.0 AS mean FROM e GROUP BY 1")
def batch_brightness(spark, sf_dir):
    df = gray(spark, sf_dir)
    mean = F.aggregate("data", F.lit(0.0), lambda s, x: s + x) / F.size("data")
    return df.groupBy(F.floor(F.col("t") / 20).alias("step")).agg(rounded(F.avg(mean)).alias("mean"))


_BLEND = 0.2


@query(f"WITH {SESSION}, n AS (SELECT rec_id, max(t) + 1 AS frames, (max(t) + 1) // 20 AS n FROM sx GROUP BY rec_id), a AS (SELECT rec_id, y, x, avg(val) AS m FROM sx WHERE t < 5 GROUP BY rec_id, y, x), u AS (SELECT rec_id, y, x, sum({_BLEND} * pow({1 - _BLEND}, n - (t + 1) // 20) * val) AS m FROM sx JOIN n USING (rec_id) WHERE (t + 1) % 20 = 0 GROUP BY rec_id, y, x) SELECT a.rec_id, a.y, a.x, round(pow({1 - _BLEND}, n) * a.m + coalesce(u.m, 0), 4) + 0.0 AS val FROM a JOIN n ON n.rec_id = a.rec_id LEFT JOIN u ON u.rec_id = a.rec_id AND u.y = a.y AND u.x = a.x")
def live_ema_reference(spark, sf_dir):
    """The reference that the live mode ends with where nothing moves: every 20th frame is blended in."""
    df = sessions(spark, sf_dir)
    options = LiveOptions(update_interval=20, update_weight=_BLEND, flow=FlowOptions(weight=[1.0]))
    rows = registration.live_references(df, sq.mean_frames(df.where("t < 5")), options, solver=lambda fixed, moving, **_: np.zeros((*moving.shape[:3], 2)))
    return out(rows, digits=4, more=("rec_id",))


# -- registration ------------------------------------------------------------


@query()
def rigid_shift(spark, sf_dir):
    return mo.rigid_shifts(gray(spark, sf_dir), reference(spark, sf_dir), upsample=4).select("rec_id", "t", "dx", "dy")


def _solve(spark, sf_dir, **options):
    flows = mo.displacements(gray(spark, sf_dir), reference(spark, sf_dir), **options)
    return flows.select("rec_id", "t", "u", "v")


@query()
def flow_solve(spark, sf_dir):
    return _solve(spark, sf_dir, alpha=1.5, iterations=20)


@query()
def flow_solve_gnc(spark, sf_dir):
    return _solve(spark, sf_dir, alpha=1.5, iterations=10, gnc_schedule=(0.0, 0.5, 1.0), warping_steps=2)


@query()
def flow_solve_redblack(spark, sf_dir):
    return _solve(spark, sf_dir, alpha=1.5, iterations=20, order="redblack")


QUERIES.update(registration.queries(gray, sessions))


def flagship(spark, sf_dir):
    """Batch motion correction of the embedding frames, with statistics per frame."""
    return QUERIES["compensate"](spark, sf_dir)

