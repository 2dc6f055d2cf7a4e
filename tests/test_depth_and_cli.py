import json

import numpy as np
import pytest

from framelake import __main__ as cli
from framelake.functions import kernels as K
from framelake.plans import depth
from framelake.plans.options import DepthOptions
from framelake.sources import formats, frames_io, metadata

OPTIONS = DepthOptions(win_half=3, patch_size=8, overlap=0.5, spatial_sigma=0.5, temporal_sigma=0.3, smooth_spatial=0.5, smooth_temporal=0.3, input_buffer=4)


@pytest.fixture(scope="module")
def volume():
    r = np.random.default_rng(3)
    return 1000 + 500 * np.stack([K.gaussian(r.normal(size=(1, 24, 24)), (1.5, 1.5))[0] for _ in range(7)])[..., None]


def test_depth_is_found_stored_from_one_and_corrected(spark, volume):
    truth = [3, 3, 3, 3, 2, 2, 2, 2, 4, 4, 4, 4]
    frames = frames_io.from_array(spark, volume[truth]).drop("dtype")
    slices = frames_io.from_array(spark, volume).drop("dtype")
    rows = {r["t"]: r for r in depth.depth_aligned(frames, slices, OPTIONS).collect()}
    assert sorted(rows) == list(range(12))
    for t in (1, 2, 5, 6, 9, 10):
        assert abs(np.median(rows[t]["z"]) - 1 - truth[t]) < 0.6
    assert all(0 <= x <= 65535 and x == int(x) for x in rows[0]["corrected"])
    seen = depth.simulated(depth.depth_aligned(frames, slices, OPTIONS), slices)
    assert seen.count() == 12


def test_anchor_is_the_first_of_equals(spark, volume):
    twice = np.concatenate([volume[:1], volume[:1], volume[1:]])
    assert depth.anchor_of(frames_io.from_array(spark, volume[[0, 0]]), twice, OPTIONS) == 0


def test_a_volume_needs_slices(spark, volume):
    with pytest.raises(ValueError, match="two slices"):
        depth.depth_aligned(frames_io.from_array(spark, volume[:2]), frames_io.from_array(spark, volume[:1]), OPTIONS)


def test_values_of_overrides():
    assert [cli.value_of(x) for x in ("yes", "False", "none", "3", "[1, 2]", "a b", '{"k": 1}')] == [True, False, None, 3, [1, 2], "a b", {"k": 1}]
    assert cli.options_of(None, ["alpha=2", "name=x=y"]) == {"alpha": 2, "name": "x=y"}
    with pytest.raises(SystemExit):
        cli.options_of(None, ["alpha"])


def test_command_line_runs(spark, tmp_path, volume):
    frames = frames_io.from_array(spark, volume[:3], "rec")
    frames_io.write_frames(frames, f"file://{tmp_path}/in", "TIFF", "float32")
    cli.main(["compensate", "--input", f"{tmp_path}/in/rec.tif", "--output", f"{tmp_path}/out", "iterations=3", "quality_setting=fast", "weight=[1]", "reference_frames=[0]"])
    assert spark.read.parquet(f"{tmp_path}/out/frames").count() == 3 and spark.read.parquet(f"{tmp_path}/out/statistics").count() == 3
    cli.main(["session", "--input", f"{tmp_path}/in/rec.tif", "--output", f"{tmp_path}/s", 'flow_options={"iterations": 2, "quality_setting": "fast", "weight": [1]}'])
    bundle = np.load(f"{tmp_path}/s/final_results/final_valid_idx.npz")
    assert bundle["final_valid"].shape == (24, 24) and bundle["middle_idx"] == 0
    assert formats.read_mat(open(f"{tmp_path}/s/final_results/final_valid_idx.mat", "rb").read())["middle_idx"] == 1


def test_number_of_a_job(monkeypatch):
    assert cli.task_index() is None
    monkeypatch.setenv("SGE_TASK_ID", "undefined")
    assert cli.task_index() is None
    monkeypatch.setenv("PBS_ARRAY_INDEX", "7")
    monkeypatch.setenv("SLURM_ARRAY_TASK_ID", "3")
    assert cli.task_index() == 2


def test_stages_of_depth_alignment(spark, tmp_path, volume):
    """Two scans of each slice, the second one moved; stages run one by one and resume."""
    scans = np.concatenate([[v, np.roll(v, 1, 1)] for v in volume])
    stack, frames = frames_io.from_array(spark, scans).drop("dtype"), frames_io.from_array(spark, volume[[3, 3, 2, 2]]).drop("dtype")
    quick = {"iterations": 10, "weight": [1.0], "quality_setting": "fast", "input_file": "ignored", "buffer_size": 99}
    options = OPTIONS.model_copy(update={"stack_scans_per_slice": 2, "stage1_flow_options": quick, "prealign_recording": True, "recording_prealign_flow_options": quick, "reference_source_bin_size": 2})
    assert options.stack_flow().buffer_size == 2 and options.stack_flow().input_file is None and options.recording_flow().buffer_size == 99
    with pytest.raises(Exception, match="volume"):
        depth.run_depth(frames, stack, str(tmp_path), options, stages=(2,))
    first = depth.run_depth(frames, stack, str(tmp_path), options, stages=(1,))
    assert first["volume"].count() == 7
    rest = depth.run_depth(frames, stack, str(tmp_path), options, stages=(2, 3))
    assert set(rest) == {"volume", "prealigned", "depths", "simulated"} and rest["simulated"].count() == rest["prealigned"].count() == 4
    assert depth.run_depth(frames.limit(0), stack, str(tmp_path), options)["depths"].count() == 4
    raw = OPTIONS.model_copy(update={"prealign_stack": False, "write_simulated": False, "write_corrected": False})
    plain = depth.run_depth(frames, frames_io.from_array(spark, volume).drop("dtype"), f"{tmp_path}/raw", raw)
    assert set(plain) == {"volume", "depths"} and "corrected" not in plain["depths"].columns
    assert (np.array(plain["volume"].orderBy("t").first()["data"]) == volume[0].ravel()).all()


def test_metadata():
    text = "SI.hChannels.channelSave = [1;2]\nSI.hStackManager.numSlices = 3\nSI.hStackManager.framesPerSlice = 2\nSI.hRoiManager.scanFrameRate = 30.5"
    assert metadata.parse(text) == {"channels": 2, "slices": 3, "volumes": 1, "per_slice": 2, "rate": 30.5}
    assert metadata.parse(json.dumps({"SI.hChannels.channelSave": 1}))["channels"] == 1
    assert metadata.interleave(text, 12) == 2 and metadata.interleave(text, 13) == 1


def test_damaged_files_are_refused():
    for read in (formats.read_tiff, formats.read_mat):
        with pytest.raises(ValueError):
            read(b"x" * 200)


def test_resamplers_keep_constants():
    for kind in K.KERNELS:
        np.testing.assert_allclose(K.resample(np.full((1, 9, 7), 2.0), (5, 12), kind), 2.0)
