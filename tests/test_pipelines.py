import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import kernels as K
from framelake.operators import sequence as sq
from framelake.plans import registration as reg
from framelake.plans.corrector import Corrector, LiveCorrector, preregistered
from framelake.plans.options import FlowOptions, LiveOptions, SessionOptions
from framelake.sources import frames_io

OPTIONS = FlowOptions(alpha=4.0, iterations=20, buffer_size=4, weight=[1.0], sigma=[[1.0, 1.0, 0.1]])


def scene(dx=0.0, dy=0.0, n=32):
    y, x = np.mgrid[:n, :n]
    x, y = x - dx, y - dy
    return (np.exp(-((x - 14) ** 2 + (y - 13) ** 2) / 60) + 0.6 * np.exp(-((x - 22) ** 2 + (y - 21) ** 2) / 30) + 0.3 * np.sin(x / 3) * np.cos(y / 4))[..., None]


SHIFTS = [(0, 0), (1, 0), (0.5, -0.5), (-1, 1), (1, 1), (0, 0.5), (-0.5, 0), (1.2, -0.3), (0.2, 0.2)]


@pytest.fixture(scope="module")
def frames(spark):
    a = frames_io.from_array(spark, np.stack([scene(*s) for s in SHIFTS]), "a")
    b = frames_io.from_array(spark, np.stack([scene(y, x) for x, y in SHIFTS[:6]]), "b")
    return a.unionByName(b).drop("dtype")


@pytest.fixture(scope="module")
def references(frames):
    return frames.where("t = 0").select("rec_id", "h", "w", "c", "data")


def collected(df):
    return {(r["rec_id"], r["t"]): np.stack([r["u"], r["v"]]) for r in df.collect()}


def test_batches_equal_the_corrector_and_partitions_do_not_matter(spark, frames, references):
    one = collected(reg.compensate(frames, references, OPTIONS))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    two = collected(reg.compensate(frames.repartition(5), references, OPTIONS))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one.keys() == two.keys() and len(one) == 15
    tool = Corrector(scene(), OPTIONS)
    flows = np.concatenate([tool.batch(np.stack([scene(*s) for s in SHIFTS[k : k + 4]]))[1] for k in range(0, 9, 4)])
    for k in range(9):
        np.testing.assert_allclose(one["a", k], two["a", k])
        np.testing.assert_allclose(one["a", k][0], flows[k, ..., 0].ravel())


def test_shifts_are_found(frames, references):
    for (rec, t), uv in collected(reg.compensate(frames, references, OPTIONS)).items():
        dx, dy = SHIFTS[t] if rec == "a" else SHIFTS[t][::-1]
        mid = uv.reshape(2, 32, 32)[:, 7:-7, 7:-7].mean((1, 2))
        assert np.abs(mid - (dx, dy)).max() < 0.4


def test_independent_batches_equal_the_stream(frames, references):
    apart = OPTIONS.model_copy(update={"update_initialization_w": False})
    one, two = collected(reg.compensate(frames, references, apart)), collected(reg.compensate_apart(frames, references, apart))
    assert one.keys() == two.keys()
    for k in one:
        np.testing.assert_allclose(one[k], two[k])
    with pytest.raises(ValueError):
        reg.compensate_apart(frames, references, OPTIONS)


def test_reference_update_and_rigid_start(frames, references):
    o = OPTIONS.model_copy(update={"update_reference": True, "cc_initialization": True})
    for uv in collected(reg.compensate(frames, references, o)).values():
        assert np.isfinite(uv).all() and np.abs(uv).max() < 10


def test_own_solver_is_used(frames, references):
    def nothing(fixed, moving, **options):
        return np.zeros((*moving.shape[:3], 2))

    assert all((uv == 0).all() for uv in collected(reg.compensate(frames, references, OPTIONS, nothing)).values())


def test_pair_and_prereference():
    flow = reg.compensate_pair(scene(), scene(1, 0), OPTIONS)
    assert abs(flow[7:-7, 7:-7, 0].mean() - 1) < 0.3
    ref = preregistered(np.stack([scene(*s) for s in SHIFTS]), OPTIONS)
    assert ref.shape == (32, 32, 1) and np.isfinite(ref).all()


def test_live_follows_frames_and_needs_a_reference():
    live = LiveCorrector(LiveOptions(buffer=3, update_interval=4, flow=FlowOptions(quality_setting="custom", min_level=0, alpha=4.0, iterations=20, weight=[1.0])))
    with pytest.raises(ValueError):
        live.set_reference()
    same, flow = live(scene())
    assert (same == scene()).all() and not flow.any()
    live.set_reference(scene())
    for s in SHIFTS:
        registered, flow = live(scene(*s))
        assert registered.shape == (32, 32, 1)
    assert live.count == len(SHIFTS)
    live.reset_reference()
    assert live.raw is None


def test_session_brings_recordings_together(spark):
    recs = []
    for k, (name, dx, dy) in enumerate((("r0", 2.0, -1.0), ("r1", 0.0, 0.0), ("r2", -1.5, 1.0))):
        recs.append(frames_io.from_array(spark, np.stack([scene(dx + 0.1 * i, dy) for i in range(3)]), name))
    frames = recs[0].unionByName(recs[1]).unionByName(recs[2]).drop("dtype")
    found = reg.session(frames, SessionOptions(sigma_smooth=1.0, alpha_between=4.0, iterations_between=40), OPTIONS)
    between = {r["rec_id"]: np.stack([r["u"], r["v"]]).reshape(2, 32, 32)[:, 8:-8, 8:-8].mean((1, 2)) for r in found["between"].collect()}
    assert (between["r1"] == 0).all()
    assert np.abs(between["r0"] - (2, -1)).max() < 0.5 and np.abs(between["r2"] - (-1.5, 1)).max() < 0.5
    mask = np.array(found["session_mask"].first()["valid"])
    assert mask.shape == (1024,) and 0 < mask.sum() < 1024
    assert found["aligned"].count() == 9


def test_session_resumes(spark, tmp_path):
    recs = [frames_io.from_array(spark, np.stack([scene(dx + 0.1 * i, 0) for i in range(3)]), name) for name, dx in (("r0", 1.0), ("r1", 0.0))]
    frames = recs[0].unionByName(recs[1]).drop("dtype")
    options = SessionOptions(sigma_smooth=1.0, alpha_between=4.0, iterations_between=20)
    first = reg.run_session(recs[0].drop("dtype"), str(tmp_path), options, OPTIONS)
    assert first["compensated"].count() == 3
    second = reg.run_session(frames, str(tmp_path), options, OPTIONS)
    assert second["compensated"].groupBy("rec_id").count().count() == 2 and second["aligned"].count() == 6
    assert sorted(r["rec_id"] for r in spark.read.parquet(f"{tmp_path}/status").collect()) == ["r0", "r1"]
    stage = reg.run_session(frames, str(tmp_path), options, OPTIONS, stages=(2,))
    assert set(stage) == {"compensated", "averages", "between"}
    again = reg.run_session(frames, str(tmp_path), options, OPTIONS)
    found = reg.session_bundle(again, f"{tmp_path}/final_results", options)
    assert found["displacement_fields_u"].shape == (2, 32, 32) and (found["final_valid"] == np.array(again["session_mask"].first()["valid"]).reshape(32, 32)).all()
    assert again["session_mask"].count() == 1
    assert spark.read.parquet(f"{tmp_path}/status").count() == 2


def test_references_clip_indices_and_observe(spark, frames):
    o = OPTIONS.model_copy(update={"reference_frames": [0, 1, 500]})
    plain = {r["rec_id"]: np.array(r["data"]) for r in reg.references_of(frames, o, preregister=False).collect()}
    expected = np.mean([scene(*SHIFTS[k]) for k in (0, 1, 8)], axis=0).ravel()
    np.testing.assert_allclose(plain["a"], expected)
    ready = {r["rec_id"]: np.array(r["data"]) for r in reg.references_of(frames, o).collect()}
    assert ready.keys() == plain.keys() and np.isfinite(ready["a"]).all()
    df, seen = reg.observed(frames)
    df.collect()
    assert seen.get["frames"] == 15 and seen.get["last"] == 8


def test_mean_frames_refuses_infinite_values(spark):
    df = frames_io.from_array(spark, np.full((2, 3, 3, 1), np.inf)).drop("dtype")
    with pytest.raises(Exception, match="finite"):
        sq.mean_frames(df).collect()


def test_depth_is_read_back(spark):
    volume = np.stack([K.gaussian(np.random.default_rng(z).normal(size=(1, 16, 16)), (1.0, 1.0))[0] for z in range(7)])[..., None]
    z = K.depth_map(K.gradient_distance(volume, volume[[2, 4]]), 3, win_half=3, patch=8, overlap=0.5)
    assert np.abs(z[0] - 2).max() <= 0.5 and np.abs(z[1] - 4).max() <= 0.5
    np.testing.assert_allclose(K.along_depth(volume, np.full((1, 16, 16), 2.5))[0], (volume[2] + volume[3]) / 2)


def test_empty_frames(spark, frames, references):
    none = frames.where(F.lit(False))
    assert reg.compensate(none, references, OPTIONS).count() == 0
    assert sq.mean_frames(none).count() == 0


def still(fixed, moving, **_):
    return np.zeros((*moving.shape[:3], 2))


def test_options_have_their_effects(spark, tmp_path):
    """bin_size, output_typename, save_w and save_valid_mask; a frame with a negative t is a frame."""
    stack = np.random.default_rng(2).uniform(-3, 300, (7, 12, 12, 1))
    frames = frames_io.from_array(spark, stack).withColumn("t", F.col("t") - 1)
    reference = sq.mean_frames(frames)
    plain = {r["t"]: np.array(r["data"]) for r in reg.compensate(frames, reference, FlowOptions(weight=[1.0]), still).collect()}
    assert sorted(plain) == list(range(-1, 6)) and np.allclose(plain[-1], stack[0].ravel(), atol=1e-3)
    cast = {r["t"]: np.array(r["data"]) for r in reg.compensate(frames, reference, FlowOptions(weight=[1.0], output_typename="uint8"), still).collect()}
    assert all((cast[t] == np.clip(np.trunc(plain[t]), 0, 255)).all() for t in plain)
    whole = frames_io.from_array(spark, stack)
    binned = reg.compensate(whole, reference, FlowOptions(weight=[1.0], bin_size=3), still).orderBy("t").collect()
    assert [r["t"] for r in binned] == [0, 1, 2] and np.allclose(binned[0]["data"], stack[:3].mean(0).ravel(), atol=1e-3)
    rows = reg.compensate(whole, reference, FlowOptions(weight=[1.0]), still)
    few = reg.write_result(rows, reference, f"{tmp_path}/few", FlowOptions())
    many = reg.write_result(rows, reference, f"{tmp_path}/many", FlowOptions(save_w=True, save_valid_mask=True))
    assert set(few) == {"frames", "reference", "statistics"} and set(many) == {*few, "w", "valid_mask"}
    assert all(df.count() == (1 if name == "reference" else 7) for name, df in many.items())
    assert all(all(r["valid"]) for r in many["valid_mask"].collect()) and "u" not in few["frames"].columns


@pytest.mark.parametrize("options", [SessionOptions, LiveOptions, FlowOptions])
def test_unknown_options_are_refused(options):
    with pytest.raises(ValueError):
        options(no_such_option=1)


def test_slices_of_a_batch_change_nothing(monkeypatch):
    from framelake.plans import corrector

    stack = np.stack([scene(*s) for s in SHIFTS])
    for more in ({}, {"cc_initialization": True, "update_reference": True}):
        o = OPTIONS.model_copy(update=more)
        whole = Corrector(stack[0], o).batch(stack)
        monkeypatch.setattr(corrector, "WORK_BYTES", 1)
        assert len(corrector.slices_of(stack)) == len(stack)
        alone = Corrector(stack[0], o).batch(stack)
        monkeypatch.undo()
        assert np.allclose(whole[0], alone[0]) and np.allclose(whole[1], alone[1])


def test_preregistration_takes_the_callers_options(monkeypatch):
    from framelake.plans import corrector

    seen = []
    monkeypatch.setattr(corrector, "get_backend", lambda name: lambda fixed, moving, **o: seen.append((fixed, o)) or still(fixed, moving))
    stack = np.stack([scene(*s) for s in SHIFTS])
    given = FlowOptions(alpha=(2, 3), quality_setting="fast", a_smooth=0.7, a_data=0.6, update_lag=3, levels=7, iterations=9, eta=0.9, weight=[1.0], buffer_size=2)
    out = preregistered(stack, given)
    assert np.allclose(out, stack.mean(0), atol=1e-3)
    _, o = seen[0]
    assert (o["alpha"], o["min_level"], o["a_smooth"], o["a_data"], o["update_lag"], o["levels"], o["iterations"], o["eta"]) == ((4, 5), 6, 0.7, 0.6, 3, 7, 9, 0.9)
    assert len(seen) == 1 + -(-len(stack) // 2)  # the initial flow, then one solve for each buffer


def test_live_range_follows_the_processed_reference():
    live = LiveCorrector(LiveOptions(update_interval=1, update_weight=0.5, flow=FlowOptions(weight=[1.0])), scene(0, 0), still)
    registered, flows = live.register_frames(np.stack([2 * scene(0, 0)] * 2))
    assert registered.shape[0] == 2 and (live.get_current_flow() == flows[-1]).all()
    assert np.allclose(live.range, (live.proc.min(), live.proc.max()))


def test_hooks_hear_of_every_batch(spark, tmp_path, frames, references):
    folder = str(tmp_path)

    def note(rec, *told):
        name = "-".join(str(x if np.isscalar(x) else x.shape) for x in told)
        open(f"{folder}/{rec} {name}", "w").close()

    def broken(*_):
        raise RuntimeError("no")

    hooks = reg.Hooks(progress=(broken, note), flows=(note,), registered=(note,))
    plain = collected(reg.compensate(frames, references, OPTIONS, still))
    told = collected(reg.compensate(frames, references, OPTIONS, still, hooks))
    assert told.keys() == plain.keys()
    heard = {p.name for p in tmp_path.iterdir()}
    assert {"a 4-9", "a 8-9", "a 9-9", "b 4-6", "b 6-6", "a (4, 32, 32, 2)-4-8", "a (1, 32, 32, 1)-8-9", "b (2, 32, 32, 2)-4-6"} <= heard and len(heard) == 15


@pytest.mark.parametrize("kind", ["path", "array"])
def test_a_whole_correction(spark, tmp_path, kind):
    stack = np.random.default_rng(1).integers(0, 999, (5, 12, 12, 3)).astype(np.uint16)
    np.save(tmp_path / "rec.npy", stack)
    image = stack[..., [2, 0]][0].astype(float)
    np.save(tmp_path / "ref.npy", image[None])
    given = str(tmp_path / "ref.npy") if kind == "path" else image[None]
    options = FlowOptions(input_file=str(tmp_path / "rec.npy"), output_path=f"{tmp_path}/out", output_format="TIFF", channel_idx=[2, 0], reference_frames=given, output_typename="uint16", naming_convention="batch", get_displacement_impl=still, save_valid_idx=True)
    parts = reg.correct(spark, options)
    assert set(parts) == {"frames", "reference", "statistics", "valid_mask"}
    assert (np.array(parts["reference"].first()["data"]) == image.ravel()).all()
    back = frames_io.to_array(frames_io.read_frames(spark, f"{tmp_path}/out/rec_compensated.tif"))
    assert back.dtype == np.uint16 and np.abs(back.astype(int) - stack[..., [2, 0]]).max() <= 1
    few = reg.correct(spark, options.model_copy(update={"output_path": f"{tmp_path}/few", "output_format": "PARQUET", "save_meta_info": False, "save_valid_idx": False, "channel_idx": None, "reference_frames": [0, 1]}))
    assert set(few) == {"frames"} and few["frames"].first()["c"] == 3
    with pytest.raises(Exception, match="no such channel"):
        reg.correct(spark, options.model_copy(update={"channel_idx": [3]}))
