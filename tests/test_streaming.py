import numpy as np

from framelake.plans.corrector import LiveCorrector
from framelake.plans.options import FlowOptions, LiveOptions
from framelake.sources import frames_io
from framelake.streaming.live import register_stream

OPTIONS = LiveOptions(buffer=4, update_interval=3, flow=FlowOptions(quality_setting="custom", min_level=0, iterations=5, weight=[1.0]))


def test_stream_equals_calls_in_order(spark, tmp_path):
    r = np.random.default_rng(8)
    stack = r.random((9, 10, 10, 1))
    frames = frames_io.from_array(spark, stack, "a").drop("dtype")
    for k in range(3):
        frames.where(f"t div 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = register_stream(stream, OPTIONS, reference_after=3).writeStream.format("memory").queryName("live_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    got = {row["t"]: np.array(row["u"]) for row in spark.table("live_out").collect()}
    live, expected = LiveCorrector(OPTIONS), {}
    for t, f in enumerate(stack):
        expected[t] = live(f)[1][..., 0].ravel()
        if t == 2:
            live.set_reference()
    assert got.keys() == expected.keys()
    for t in got:
        np.testing.assert_allclose(got[t], expected[t], atol=1e-9)
