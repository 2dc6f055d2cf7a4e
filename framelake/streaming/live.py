"""Live motion correction on Structured Streaming.

State per recording: the corrector's references, ring buffer and last flow,
pickled. Frames of a micro-batch are taken in order of t; a frame not later than
the last one taken is dropped. The state is bounded by a few frames per recording.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.corrector import LiveCorrector
from ..plans.options import LiveOptions

OUTPUT = "rec_id string, t bigint, data array<double>, u array<double>, v array<double>"


def register_stream(frames: DataFrame, options: LiveOptions, reference_after: int | None = None) -> DataFrame:
    """Registers a stream of frames. Frames pass unchanged until ``reference_after`` of them (default: a full buffer) make the reference."""
    wanted = reference_after or options.buffer

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, last, seen = pickle.loads(state.get[0]) if state.exists else ({}, -1, 0)
        live = LiveCorrector.resumed(options, kept)
        rows = pd.concat(list(chunks)).sort_values("t")
        out = []
        for r in rows.itertuples():
            if r.t <= last:
                continue
            frame = np.asarray(r.data, float).reshape(r.h, r.w, r.c)
            registered, flow = live(frame)
            last, seen = r.t, seen + 1
            if live.raw is None and seen >= wanted:
                live.set_reference()
            out.append((key[0], r.t, registered.ravel().astype(float), flow[..., 0].ravel(), flow[..., 1].ravel()))
        state.update((pickle.dumps((live.snapshot(), last, seen)),))
        yield pd.DataFrame(out, columns=["rec_id", "t", "data", "u", "v"])

    return frames.groupBy("rec_id").applyInPandasWithState(step, OUTPUT, "state binary", "append", GroupStateTimeout.NoTimeout)
