import numpy as np
import pytest
from pydantic import ValidationError

from framelake.plans.options import FlowOptions, get_backend, is_backend_available, list_backends, register_backend


def test_defaults_and_normalisation():
    o = FlowOptions(alpha=3, weight=[1, 3], sigma=[1, 2, 0.5], constancy_assumption="Census")
    assert o.alpha == (3, 3) and o.weight == [0.25, 0.75] and o.constancy_assumption == "cs"
    assert o.sigma_at(4) == [1, 2, 0.5]


@pytest.mark.parametrize("bad", [{"alpha": 0}, {"alpha": (1, 2, 3)}, {"eta": 0}, {"a_data": 1.5}, {"weight": [0, 0]}, {"sigma": [1, 2]}, {"unknown": 1}, {"gnc_schedule": (1.0, 0.5)}, {"constancy_assumption": "x"}, {"interpolation_method": "nearest"}])
def test_refused(bad):
    with pytest.raises((ValidationError, ValueError)):
        FlowOptions(**bad)


def test_levels_and_weights():
    assert [FlowOptions(quality_setting=q).effective_min_level() for q in ("quality", "balanced", "fast")] == [0, 4, 6]
    assert FlowOptions(min_level=2, quality_setting="fast").effective_min_level() == 2
    assert FlowOptions(weight=[1, 1, 2]).weights_for(2).tolist() == [0.5, 0.5]
    assert FlowOptions(weight=[1.0]).weights_for(2).tolist() == [1.0, 0.5]


def test_saved_and_loaded(tmp_path):
    o = FlowOptions(alpha=(2, 4), gnc_schedule=(0.0, 1.0))
    o.save(str(tmp_path / "o.json"))
    assert FlowOptions.load(str(tmp_path / "o.json")) == o
    FlowOptions(reference_frames=np.ones((3, 4)), input_file=np.zeros((2, 3, 4)), cc_hw=64).save(str(tmp_path / "a.json"))
    back = FlowOptions.load(str(tmp_path / "a.json"))
    assert back.input_file is None and back.cc_hw == (64, 64) and (np.load(back.reference_frames) == 1).all()


def test_displacement_given_before_factory_before_name():
    made = lambda **k: k
    assert FlowOptions(get_displacement_impl=print, get_displacement_factory=made).solver() is print
    assert FlowOptions(get_displacement_factory=made, backend_params={"a": 1}).solver() == {"a": 1}
    with pytest.warns(UserWarning, match="references"):
        FlowOptions(n_references=2)


def test_backends():
    import framelake.plans.corrector  # noqa: F401  registers its own

    register_backend("mine", lambda *a, **k: None)
    assert is_backend_available("mine") and {"lexicographic", "redblack", "mine"} <= set(list_backends())
    with pytest.raises(ValueError):
        get_backend("none")
