"""Command line: compensate, session and z-align runs over recordings, with key=value overrides.

    python -m framelake compensate --input 'in/*.tif' --output out [alpha=2 quality_setting=fast ...]
    python -m framelake session --input 'in/*.tif' --output out [--config session.toml] [center=rec_b ...]
    python -m framelake z-align --input rec.tif --volume stack.tif --output out [win_half=5 ...]
"""

from __future__ import annotations

import argparse
import json
import os
import tomllib
from pathlib import Path


def value_of(text: str):
    """True, false, none, numbers and JSON as such; anything else is text."""
    low = text.strip().lower()
    if low in ("true", "yes", "on", "false", "no", "off"):
        return low in ("true", "yes", "on")
    if low in ("none", "null"):
        return None
    try:
        return json.loads(text)
    except ValueError:
        return text


def options_of(config: str | None, overrides: list[str]) -> dict:
    out = tomllib.loads(Path(config).read_text()) if config else {}
    for item in overrides:
        key, mark, value = item.partition("=")
        if not mark:
            raise SystemExit(f"{item} is not key=value")
        out[key] = value_of(value)
    return out


def task_index() -> int | None:
    """The place, from 0, of a job of a job array."""
    found = [os.environ[name] for name in ("SLURM_ARRAY_TASK_ID", "SGE_TASK_ID", "PBS_ARRAY_INDEX") if os.environ.get(name, "").isdigit()]
    return int(found[0]) - 1 if found else None


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="framelake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("compensate", "session", "z-align"))
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--volume")
    parser.add_argument("--config")
    parser.add_argument("--source", help="recording whose mean pre-aligns the volume")
    parser.add_argument("--stage", choices=("1", "2", "3", "all"), default="all")
    parser.add_argument("--task-index", type=int, default=task_index(), help="run only the recording with this number, in order of names; a job array's number less one")
    parser.add_argument("overrides", nargs="*")
    args = parser.parse_intermixed_args(argv)
    from pyspark.sql import SparkSession

    from .plans import depth, registration
    from .plans.options import DepthOptions, FlowOptions, SessionOptions
    from .sources.frames_io import read_frames

    spark = SparkSession.builder.appName(f"framelake {args.command}").getOrCreate()
    options, frames = options_of(args.config, args.overrides), read_frames(spark, args.input)
    stages = (1, 2, 3) if args.stage == "all" else (int(args.stage),)
    if args.task_index is not None:
        names = sorted(r["rec_id"] for r in frames.select("rec_id").distinct().collect())
        frames = frames.where(frames["rec_id"] == names[args.task_index])
    if args.command == "compensate":
        flow = FlowOptions(**{"output_path": args.output, "output_format": "PARQUET"} | options | {"input_file": frames})
        registration.correct(spark, flow)
    elif args.command == "session":
        chosen = SessionOptions(**options)
        parts = registration.run_session(frames, args.output, chosen, stages=stages)
        if 3 in stages and "://" not in args.output:
            registration.session_bundle(parts, f"{args.output}/final_results", chosen)
    else:
        source = read_frames(spark, args.source) if args.source else None
        depth.run_depth(frames, read_frames(spark, args.volume), args.output, DepthOptions(**options), source, stages)


if __name__ == "__main__":
    main()
